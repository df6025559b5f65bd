"""Fit, calibrate, score, save and load models as Spark ML jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.functions.safe import sigmoid
from quantloom.models.isotonic import IsotonicCurve
from quantloom.models.specs import Spec
from quantloom.operators.merge import stack
from quantloom.operators.ordering import average_ranks
from quantloom.operators.projections import confidence, signal
from quantloom.operators.summaries import positive_weight
from quantloom.operators.technical import latest_indicators
from quantloom.session import scratch_path

SEED = 42
_TEMP = ["_x", "_z", "_pc", "rawPrediction", "_vec", "prediction"]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a training frame to the shared folder and read it back: every later pass scans files, not the feature plan."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _prepare(features: Sequence[str]) -> list[Estimator | Transformer]:
    """Median imputation learnt on the training rows, then one vector."""
    filled = [f"_i_{f}" for f in features]
    return [Imputer(strategy="median", inputCols=list(features), outputCols=filled), VectorAssembler(inputCols=filled, outputCol="_x")]


def _components(df: DataFrame, prepared: PipelineModel, width: int, variance: float) -> int:
    """Fewest principal components that explain ``variance``."""
    explained = PCA(k=width, inputCol="_z", outputCol="_pc").fit(prepared.transform(df)).explainedVariance
    total, k = 0.0, 0
    while k < width and total < variance:
        total += float(explained[k])
        k += 1
    return max(1, k)


def _trees(kind: str, settings: dict, common: dict) -> Estimator:
    p = dict(settings)
    if kind == "forest":
        return RandomForestClassifier(featuresCol="_x", probabilityCol="_vec", seed=SEED, **common, **p)
    if p.pop("validationFraction", None) is not None:
        common = {**common, "validationIndicatorCol": "_held"}
    booster = GBTClassifier(featuresCol="_x", seed=SEED, **common, **p)
    booster.set(booster.probabilityCol, "_vec")
    return booster


def assembled_estimators(kind: str, settings: dict, features: Sequence[str], label: str) -> list[Estimator | Transformer]:
    """Stages of a tree learner on features without gaps and rows weighted by ``_w``."""
    if kind not in ("forest", "gbt") or "validationFraction" in settings:
        raise ValueError(f"binned rows suit plain tree learners, not {kind!r}")
    return [VectorAssembler(inputCols=list(features), outputCol="_x"), _trees(kind, settings, {"labelCol": label, "weightCol": "_w"})]


def _estimators(kind: str, settings: dict, df: DataFrame, features: Sequence[str], label: str) -> list[Estimator | Transformer]:
    p = dict(settings)
    common = {"labelCol": label, "weightCol": "_w"}
    stages = _prepare(features)
    if kind in ("logistic", "pca_logistic"):
        rows = max(1, df.count())
        penalty = 1.0 / (p.pop("C") * rows)
        variance = p.pop("variance", None)
        stages.append(StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True))
        source = "_z"
        if variance is not None:
            k = _components(df, Pipeline(stages=stages).fit(df), len(features), variance)
            stages.append(PCA(k=k, inputCol="_z", outputCol="_pc"))
            source = "_pc"
        stages.append(LogisticRegression(featuresCol=source, probabilityCol="_vec", regParam=penalty, **common, **p))
    elif kind in ("forest", "gbt"):
        stages.append(_trees(kind, p, common))
    elif kind == "ranker":
        stages.append(GBTRegressor(featuresCol="_x", labelCol="_relevance", seed=SEED, **p))
    else:
        raise ValueError(f"unknown model kind {kind!r}")
    return stages


@dataclass
class FittedModel:
    """Fitted parts of one model; ``score`` adds a ``probability`` column, the mean over parts."""

    spec: Spec
    parts: list[PipelineModel]
    calibrator: IsotonicCurve | None = None
    status: dict[str, str] = field(default_factory=dict)

    def raw_score(self, df: DataFrame, name: str = "probability") -> DataFrame:
        keep, names = df.columns, []
        for i, ((kind, _), part) in enumerate(zip(self.spec.parts, self.parts, strict=True)):
            df = part.transform(df)
            value = sigmoid("prediction") if kind == "ranker" else vector_to_array("_vec")[1]
            names.append(f"_p{i}")
            df = df.select(*keep, *names[:-1], value.alias(names[-1]))
        total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
        return df.select(*keep, (total / len(names)).alias(name))

    def score(self, df: DataFrame) -> DataFrame:
        out = self.raw_score(df)
        if self.calibrator is None:
            return out
        keep = df.columns
        return self.calibrator.transform(out).select(*keep, F.col("_calibrated").alias("probability"))

    def importances(self, spark: SparkSession) -> DataFrame:
        """Feature importances of a tree part, one row per feature."""
        model = self.parts[0].stages[-1]
        values = model.featureImportances.toArray()
        return spark.createDataFrame([(f, float(v)) for f, v in zip(self.spec.features, values, strict=True)], "feature string, importance double")

    def save(self, path: str, spark: SparkSession) -> None:
        """Parts, calibrator and the feature-set sidecar."""
        for i, part in enumerate(self.parts):
            part.write().overwrite().save(f"{path}/part-{i}")
        if self.calibrator is not None:
            self.calibrator.save(f"{path}/calibrator")
        row = [(self.spec.model_id, list(self.spec.features), [k for k, _ in self.spec.parts], self.calibrator is not None)]
        meta = spark.createDataFrame(row, "model_id string, features array<string>, kinds array<string>, calibrated boolean")
        meta.coalesce(1).write.mode("overwrite").json(f"{path}/sidecar")


def load_model(path: str, spark: SparkSession) -> FittedModel:
    meta = spark.read.json(f"{path}/sidecar").first()
    spec = Spec(meta["model_id"], tuple(meta["features"]), tuple((k, {}) for k in meta["kinds"]))
    parts = [PipelineModel.load(f"{path}/part-{i}") for i in range(len(meta["kinds"]))]
    return FittedModel(spec, parts, IsotonicCurve.load(f"{path}/calibrator", spark) if meta["calibrated"] else None)


def fit(spec: Spec, train: DataFrame, label: str = "target", keys: Sequence[str] = ("ticker", "date")) -> FittedModel:
    """Fit every part of a model with the positive class weighted by its scarcity."""
    features = list(spec.features)
    missing = [c for c in features if c not in train.columns]
    if missing:
        raise ValueError(f"frame lacks model features: {','.join(missing[:8])}")
    weight = positive_weight(train, label).first()["positive_weight"]  # one value
    rows = train.withColumn(label, F.col(label).cast("double")).withColumn("_w", F.when(F.col(label) == 1, float(weight)).otherwise(1.0))
    parts = []
    for kind, settings in spec.parts:
        frame = rows
        if "validationFraction" in settings:
            share = int(1000 * settings["validationFraction"])
            frame = frame.withColumn("_held", F.pmod(F.xxhash64(*keys), F.lit(1000)) < share)
        if kind == "ranker":
            frame = average_ranks(frame, ["date"], {"forward_return": "_relevance"}, pct=True).filter(F.col("_relevance").isNotNull())
        parts.append(Pipeline(stages=_estimators(kind, settings, frame, features, label)).fit(frame))
    return FittedModel(spec, parts)


def calibrate(model: FittedModel, validation: DataFrame, label: str = "target", min_rows: int = 50) -> FittedModel:
    """Isotonic calibration on validation rows; the status says what happened."""
    if any(kind == "ranker" for kind, _ in model.spec.parts):
        return FittedModel(model.spec, model.parts, None, {"calibration": "skipped_ranking_model"})
    seen = validation.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(label).alias("k")).first()
    if seen["n"] < min_rows:
        return FittedModel(model.spec, model.parts, None, {"calibration": f"skipped_val_lt_{min_rows}"})
    if seen["k"] < 2:
        return FittedModel(model.spec, model.parts, None, {"calibration": "skipped_single_class_in_val"})
    curve = IsotonicCurve.fit(model.raw_score(validation), "probability", label)
    return FittedModel(model.spec, model.parts, curve, {"calibration": "isotonic_applied"})


def predict_latest(models: dict[str, FittedModel], features: DataFrame) -> DataFrame:
    """Newest row of every ticker scored by every model, with signal and confidence."""
    wanted = sorted({f for m in models.values() for f in m.spec.features})
    last = latest_indicators(features, wanted)
    out = []
    for name, model in models.items():
        p = model.score(last).select("ticker", "date", F.lit(name).alias("model_id"), "probability")
        out.append(p.withColumn("signal", signal(F.col("probability"))).withColumn("confidence", confidence(F.col("probability"))))
    return stack(out)


def compare_latest(models: dict[str, FittedModel], asked: Sequence[str], features: DataFrame) -> DataFrame:
    """Every asked model for every ticker; a model that is not there is a row with ok = false."""
    have = predict_latest(models, features)
    tickers = features.select("ticker").distinct().withColumn("model_id", F.explode(F.array(*[F.lit(m) for m in asked])))
    out = tickers.join(have, ["ticker", "model_id"], "left").withColumn("ok", F.col("probability").isNotNull())
    return out.withColumn("error", F.when(~F.col("ok"), F.lit("model artifact not found")))


def soft_vote(df: DataFrame, columns: Sequence[str], name: str = "probability") -> DataFrame:
    """Mean of probability columns."""
    return df.withColumn(name, sum((F.col(c) for c in columns[1:]), F.col(columns[0])) / len(columns))
