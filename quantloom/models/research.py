"""Search, ablation, out-of-fold and meta-model jobs (N13-N18, Q8); cross-validation over schemes is in ``folds``.

Folds and trials are a short driver-side list; each one is a distributed fit on a stored frame, and trials may overlap.
"""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.models.specs import FOREST, META, Spec
from quantloom.models.training import FittedModel, fit, stored
from quantloom.operators import splits
from quantloom.operators.labels import meta_label
from quantloom.operators.merge import stack
from quantloom.operators.metrics import information_coefficients, precision_recall_at, ranking_quality, strategy_evaluation


def fold_frames(panel: DataFrame, folds: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of one fold."""
    part = lambda role: splits.rows_on_dates(panel, folds.filter((F.col("fold") == fold) & (F.col("role") == role)))
    return part("train"), part("test")


def fold_ids(folds: DataFrame) -> list[int]:
    return sorted(r["fold"] for r in folds.select("fold").distinct().collect())  # a handful of folds


def large_enough(panel: DataFrame, folds: DataFrame, min_train: int, min_test: int) -> list[int]:
    """Folds with enough training and test rows, all counted in one job."""
    sizes = panel.select(F.to_date("date").alias("date")).join(folds, "date").groupBy("fold").agg(
        *[F.sum((F.col("role") == role).cast("long")).alias(role) for role in ("train", "test")]
    )
    return sorted(r["fold"] for r in sizes.collect() if r["train"] >= min_train and r["test"] >= min_test)  # a handful of folds


def group_comparison(train: DataFrame, test: DataFrame, groups: dict[str, Sequence[str]], spec: Spec = FOREST, label: str = "target", leave_out: Sequence[str] = ()) -> DataFrame:
    """The same model on different feature groups, one evaluation row each.

    A feature that the rows lack is an error unless ``leave_out`` names it; groups left with fewer than two features have no row.
    """
    absent = sorted({f for features in groups.values() for f in features} - set(train.columns) - set(leave_out))
    if absent:
        raise ValueError(f"features absent from the rows: {absent}")
    rows = []
    for name, features in groups.items():
        have = [f for f in features if f not in leave_out]
        if len(have) < 2:
            continue
        scored = fit(spec.with_features(have), train, label).score(test).withColumnRenamed("probability", "score").withColumn("target", F.col(label))
        rows.append(scored.select("ticker", "date", "forward_return", "target", "score", F.lit(name).alias("strategy"), F.lit(len(have)).alias("n_features")))
    return strategy_evaluation(stored(stack(rows), "group-scores"), ["strategy", "n_features"])


def rank_ic_objective(model: FittedModel, validation: DataFrame) -> float:
    scored = model.score(validation).withColumnRenamed("probability", "score")
    value = information_coefficients(scored).first()["rank_ic_mean"]  # one value
    return float("-inf") if value is None else float(value)


def precision_objective(model: FittedModel, validation: DataFrame, label: str = "target", share: float = 0.2) -> float:
    scored = model.score(validation).withColumnRenamed("probability", "score").withColumn("target", F.col(label))
    k = F.greatest(F.lit(1), F.floor(F.col("n") * share).cast("long"))
    return float(precision_recall_at(scored, [], k, ["ticker", "date"]).first()["precision_at_k"])


Space = dict[str, Callable[[random.Random], object]]


def whole(low: int, high: int) -> Callable[[random.Random], object]:
    return lambda rng: rng.randint(low, high)


def real(low: float, high: float) -> Callable[[random.Random], object]:
    return lambda rng: rng.uniform(low, high)


def log_real(low: float, high: float) -> Callable[[random.Random], object]:
    import math

    return lambda rng: math.exp(rng.uniform(math.log(low), math.log(high)))


def share_text(low: float, high: float) -> Callable[[random.Random], object]:
    return lambda rng: f"{rng.uniform(low, high):.3f}"


# search ranges of the research forest and of the boosted trees (fixed values)
FOREST_SPACE: Space = {
    "numTrees": whole(80, 320),
    "maxDepth": whole(4, 14),
    "minInstancesPerNode": whole(1, 10),
    "featureSubsetStrategy": share_text(0.3, 1.0),
}
BOOST_SPACE: Space = {
    "maxIter": whole(100, 600),
    "maxDepth": whole(3, 7),
    "stepSize": log_real(0.01, 0.15),
    "subsamplingRate": real(0.6, 1.0),
    "featureSubsetStrategy": share_text(0.5, 1.0),
    "minInstancesPerNode": whole(1, 10),
}


def search(spec: Spec, space: Space, objective: Callable[[Spec], float], trials: int, seed: int = 42, parallelism: int = 2) -> tuple[Spec, list[tuple[int, float, dict]]]:
    """Seeded random search: the spec with the best objective and the log of trials."""
    rng = random.Random(seed)
    draws = [{name: draw(rng) for name, draw in space.items()} for _ in range(trials)]
    kind, base = spec.parts[0]
    specs = [Spec(spec.model_id, spec.features, ((kind, {**base, **d}),)) for d in draws]
    with ThreadPoolExecutor(parallelism) as pool:
        values = list(pool.map(objective, specs))
    log = [(i, v, d) for i, (v, d) in enumerate(zip(values, draws, strict=True))]
    best = max(range(trials), key=lambda i: values[i])
    return specs[best], log


def validation_objective(train: DataFrame, validation: DataFrame, measure: Callable[[FittedModel, DataFrame], float], label: str, spec: Spec) -> float:
    return measure(fit(spec, train, label), validation)


def search_on_validation(spec: Spec, space: Space, train: DataFrame, validation: DataFrame, trials: int, label: str = "target", measure=rank_ic_objective, **options):
    """Search maximising a measure on validation rows."""
    return search(spec, space, partial(validation_objective, train, validation, measure, label), trials, **options)


def fold_auc(panel: DataFrame, folds: DataFrame, spec: Spec, label: str = "target") -> DataFrame:
    """ROC-AUC and date range of each fold's test rows (Q8)."""
    rows = []
    for fold in fold_ids(folds):
        train, test = fold_frames(panel, folds, fold)
        scored = fit(spec, train, label).score(test).withColumnRenamed("probability", "score").withColumn("fold", F.lit(fold + 1)).withColumn("target", F.col(label))
        span = scored.groupBy("fold").agg(F.min("date").alias("val_start"), F.max("date").alias("val_end"))
        rows.append(ranking_quality(scored, ["fold"]).select("fold", F.round("roc_auc", 4).alias("auc")).join(span, "fold"))
    return stack(rows)


def cv_auc(panel: DataFrame, folds: DataFrame, label: str, spec: Spec) -> float:
    return float(fold_auc(panel, folds, spec, label).agg(F.avg("auc").alias("m")).first()["m"])  # one value


def search_on_folds(spec: Spec, space: Space, panel: DataFrame, folds: DataFrame, trials: int, label: str = "target", **options):
    """Search maximising mean AUC over time-ordered folds."""
    return search(spec, space, partial(cv_auc, panel, folds, label), trials, **options)


def out_of_fold_splits(panel: DataFrame) -> DataFrame:
    """Purged folds whose number follows the number of dates, walk-forward when none survives."""
    n = panel.select("date").distinct().count()
    folds = splits.purged_kfold(panel, 5 if n > 200 else 4 if n > 120 else 3 if n > 80 else 2, embargo=5, horizon=1)
    return folds if not folds.isEmpty() else splits.walk_forward(panel, max(1, min(2, n // 40)))


def out_of_fold(panel: DataFrame, folds: DataFrame, spec: Spec = FOREST, label: str = "target", min_train: int = 30, min_test: int = 10) -> DataFrame:
    """Out-of-fold probabilities of the primary model as (ticker, date, proba_primary)."""
    parts = []
    for fold in large_enough(panel, folds, min_train, min_test):
        train, test = fold_frames(panel, folds, fold)
        parts.append(fit(spec, train, label).score(test).select("ticker", "date", F.col("probability").alias("proba_primary")))
    return stack(parts)


def fit_meta(panel: DataFrame, primary: DataFrame, fallback: DataFrame | None, features: Sequence[str], threshold: float = 0.5, spec: Spec = META, min_rows: int = 80) -> FittedModel:
    """Meta-model on features and primary score: is the primary call right? Below ``min_rows`` the validation rows are used."""
    rows = stored(panel.join(primary.select("ticker", "date", "proba_primary"), ["ticker", "date"]), "meta")
    if rows.count() < min_rows and fallback is not None:
        rows = fallback
    labelled = meta_label(rows, "ret_1d", "proba_primary", threshold)
    return fit(spec.with_features([*features, "proba_primary"]), labelled, "meta_label")


def gate(df: DataFrame, primary_threshold: float, meta_threshold: float = 0.55) -> DataFrame:
    """Position only when the primary says up and the meta-model trusts it."""
    taken = (F.col("proba_primary") >= primary_threshold) & (F.col("proba_meta") >= meta_threshold)
    return df.withColumn("signal_meta", taken.cast("double"))
