"""Many fits over one stored, binned matrix: schemes, folds and feature groups are row marks and column choices.

* Split points are learnt once over all rows (quantile sketches of the features alone, no labels) and every feature is stored as its bin number, which is all that
  tree learners use. Test dates help to place the split points and nothing else.
* The folds of all schemes reach a row as two short arrays of fold names, joined once on the date.
* One aggregate counts (stretch of dates with the same folds, feature, bin); class weights and median bins of all folds come out of it, so no fit looks for them.
* A fit reads the columns of its feature group in the rows of its fold. Fits run side by side, each in its own scheduler pool, and write their test scores as one
  partition of a table that is evaluated once, grouped by scheme, group and fold.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantloom.models.specs import FOREST, Spec
from quantloom.models.training import FittedModel, assembled_estimators, stored
from quantloom.operators.merge import stack
from quantloom.operators.metrics import ranking_quality, strategy_evaluation
from quantloom.session import scratch_path

BINS = 32  # the default number of bins of the tree learners, so each bin number is a split point
KEYS = ["ticker", "date", "ret_1d", "forward_return"]
TASK_ROWS = 1 << 16  # of a fold in one task; a tree level is one short job, whose tasks cost more than the rows of a smaller one


def marks(schemes: Mapping[str, DataFrame]) -> DataFrame:
    """One row per date with the names ``scheme#fold`` of the folds that train and test on it."""
    named = [folds.select(F.to_date("date").alias("date"), "role", F.concat(F.lit(f"{name}#"), F.col("fold").cast("string")).alias("_fold")) for name, folds in schemes.items()]
    part = lambda role: F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("_fold")))).alias(f"_{role}")  # noqa: E731 - as many as there are folds
    return stack(named).groupBy("date").agg(part("train"), part("test"))


def split_points(panel: DataFrame, features: Sequence[str], bins: int, error: float = 0.001) -> dict[str, list[float]]:
    """Growing split points of every feature, at most ``bins`` - 1; a feature without values has none.

    One pass of mergeable quantile sketches over all features; ``error`` bounds how far a point's rank may be off, as a share of the rows.
    """
    found = panel.select(*[F.col(f).cast("double").alias(f) for f in features]).approxQuantile(list(features), [i / bins for i in range(1, bins)], error)
    return {f: sorted({q + 0.0 for q in values}) for f, values in zip(features, found, strict=True)}


def binned(panel: DataFrame, features: Sequence[str], points: Mapping[str, list[float]]) -> DataFrame:
    """Each feature as the number of split points not above it; NULL and NaN become NULL."""
    inf = float("inf")
    raw, bin_of = [f"_v_{f}" for f in features], [f"_n_{f}" for f in features]
    edges = [[-inf, *[p for p in points.get(f, []) if -inf < p < inf], inf] for f in features]
    others = [c for c in panel.columns if c not in features]
    rows = panel.select(*others, *[F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(v) for f, v in zip(features, raw, strict=True)])
    out = Bucketizer(splitsArray=edges, inputCols=raw, outputCols=bin_of, handleInvalid="keep").transform(rows)
    kept = [F.when(~F.isnan(v), F.col(b)).cast("short").alias(f) for f, v, b in zip(features, raw, bin_of, strict=True)]
    return out.select(*others, *kept)


@dataclass(frozen=True)
class FoldMatrix:
    """``rows`` hold keys, label, bin numbers and the fold marks; ``sizes``, ``weights`` and ``fills`` are keyed by fold name."""

    rows: DataFrame
    label: str
    features: tuple[str, ...]
    sizes: dict[str, tuple[int, int]]
    weights: dict[str, float]
    fills: dict[tuple[str, str], float]

    def part(self, role: str, fold: str, features: Sequence[str]) -> DataFrame:
        """Rows of a fold's role with the bins of some features, gaps filled by the fold's training medians."""
        rows = self.rows.filter(F.array_contains(f"_{role}", fold))
        rows = rows.coalesce(max(1, -(-self.sizes[fold][role == "test"] // TASK_ROWS)))
        filled = [F.coalesce(F.col(f).cast("double"), F.lit(self.fills.get((fold, f), 0.0))).alias(f) for f in features]
        label = F.col(self.label).cast("double")
        return rows.select(*[c for c in KEYS if c in rows.columns], label.alias(self.label), *filled, F.when(label == 1, self.weights[fold]).otherwise(1.0).alias("_w"))

    def fit(self, spec: Spec, fold: str) -> FittedModel:
        train = self.part("train", fold, spec.features)
        parts = [Pipeline(stages=assembled_estimators(kind, settings, spec.features, self.label)).fit(train) for kind, settings in spec.parts]
        return FittedModel(spec, parts)


def build(panel: DataFrame, features: Sequence[str], schemes: Mapping[str, DataFrame], label: str = "target", bins: int = BINS) -> FoldMatrix:
    """The stored matrix of all schemes. Rows without a label or in no fold are left out."""
    features = list(features)
    absent = [f for f in features if f not in panel.columns]
    if absent:
        raise ValueError(f"features absent from the rows: {absent}")
    labelled = panel.filter(F.col(label).isNotNull()).withColumn("date", F.to_date("date"))
    labelled = labelled.select(*[c for c in KEYS if c in panel.columns], *([] if label in KEYS else [label]), *features)
    rows = binned(labelled, features, split_points(labelled, features, bins)).join(marks(schemes), "date")
    rows = stored(rows, "fold-matrix")

    stretch = rows.groupBy("_train", "_test").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("up"))
    by_fold = lambda role, *aggs: {r["f"]: r for r in stretch.select(F.explode(f"_{role}").alias("f"), "n", "up").groupBy("f").agg(*aggs).collect()}  # noqa: E731 - one row per fold
    trains = by_fold("train", F.sum("n").alias("n"), F.sum("up").alias("up"))
    tests = by_fold("test", F.sum("n").alias("n"))
    sizes = {f: (trains[f]["n"] if f in trains else 0, tests[f]["n"] if f in tests else 0) for f in {*trains, *tests}}
    weights = {f: (r["n"] - r["up"]) / r["up"] if 0 < r["up"] < r["n"] else 1.0 for f, r in trains.items()}

    long = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in features]))
    counts = rows.select("_train", long.alias("x")).filter(F.col("x.bin").isNotNull()).groupBy("_train", "x.feature", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    counts = counts.select(F.explode("_train").alias("f"), "feature", "bin", "n").groupBy("f", "feature", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy("f", "feature")  # at most as many rows as bins
    upto = counts.select("*", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.sum("n").over(w).alias("all"))
    medians = upto.filter(2 * F.col("upto") >= F.col("all")).groupBy("f", "feature").agg(F.min("bin").alias("bin"))
    fills = {(r["f"], r["feature"]): float(r["bin"]) for r in medians.collect()}  # folds x features
    return FoldMatrix(rows, label, tuple(features), sizes, weights, fills)


def scores(matrix: FoldMatrix, groups: Mapping[str, Sequence[str]], spec: Spec = FOREST, only: Mapping[str, Sequence[str]] | None = None, min_train: int = 50, min_test: int = 20,
           with_train: bool = False, parallelism: int | None = None) -> DataFrame:
    """Scores of every (scheme, ablation, fold) as one table (split_name, ablation, fold, n_train, n_test, role, ticker, date, returns, target, score).

    ``only`` names the groups that a scheme runs, all by default. Groups with fewer than two features and folds below the minimum have no rows.
    ``parallelism`` fits run side by side, by default as many as there are cores, up to 16.
    """
    spark = matrix.rows.sparkSession
    parallelism = parallelism or min(16, max(4, spark.sparkContext.defaultParallelism))
    jobs = []
    for fold, (n_train, n_test) in sorted(matrix.sizes.items()):
        scheme, number = fold.rsplit("#", 1)
        names = groups if only is None or scheme not in only else only[scheme]
        jobs += [(scheme, g, int(number), fold) for g in names if len(groups[g]) >= 2 and n_train >= min_train and n_test >= min_test]
    if not jobs:
        raise ValueError("no fold is large enough")
    folder = scratch_path(spark, "fold-scores")

    @inheritable_thread_target(spark)
    def run(item: tuple[int, tuple[str, str, int, str]]) -> None:
        at, (scheme, group, number, fold) = item
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"folds-{at % parallelism}")
        model = matrix.fit(replace(spec, features=tuple(groups[group])), fold)
        n_train, n_test = matrix.sizes[fold]
        lead = [F.lit(scheme).alias("split_name"), F.lit(group).alias("ablation"), F.lit(number).alias("fold"), F.lit(n_train).cast("long").alias("n_train"), F.lit(n_test).cast("long").alias("n_test")]
        out = []
        for role in ("train", "test") if with_train else ("test",):
            rows = model.raw_score(matrix.part(role, fold, groups[group]), "score")
            out.append(rows.select(*lead, F.lit(role).alias("role"), *[c for c in KEYS if c in rows.columns], F.col(matrix.label).alias("target"), "score"))
        stack(out).write.parquet(f"{folder}/job={at}")

    with ThreadPoolExecutor(parallelism) as pool:
        list(pool.map(run, enumerate(jobs)))
    return spark.read.parquet(folder).drop("job")


BY = ["split_name", "ablation", "fold"]


def fold_metrics(scored: DataFrame, top_frac: float = 0.2) -> DataFrame:
    """Precision@k, IC and rank-IC of every fold (M12): one evaluation over all of them."""
    return strategy_evaluation(scored.filter("role = 'test'"), BY, top_frac).select(*BY, "precision_at_k", "ic", "rank_ic")


def fold_sizes(scored: DataFrame) -> DataFrame:
    """Rows trained on, rows tested on and (ticker, date) keys scored, per fold."""
    return scored.filter("role = 'test'").groupBy(*BY).agg(F.max("n_train").alias("n_train"), F.max("n_test").alias("n_test"), F.count_distinct("ticker", "date").alias("n_scored"))


def ablation_auc(scored: DataFrame) -> DataFrame:
    """ROC-AUC on training and test rows of every feature group, and what a group adds to the one before it."""
    both = ranking_quality(scored.select("ablation", "role", "ticker", "date", "score", "target"), ["ablation", "role"])
    wide = both.groupBy("ablation").agg(*[F.max(F.when(F.col("role") == role, F.col("roc_auc"))).alias(f"auc_{role}") for role in ("train", "test")])
    gain = F.col("auc_test") - F.lag("auc_test").over(Window.partitionBy(F.lit(0)).orderBy("ablation"))  # one row per group
    return wide.select("ablation", "auc_train", "auc_test", gain.alias("gain"))
