"""Model attributions: exact ones of tree models, and sampled permutations for any model (Q2, Q3, Q7).

``tree_attributions`` is exact. In ``permutation_attributions`` every explained row walks from a background row to itself, one feature at a time in a random order; each step's change in
the prediction belongs to the feature that moved. Rows, orders and steps are exploded and scored in one batch, so attributions of
a row add up exactly to its prediction minus the mean prediction of the whole background sample.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.models.training import FittedModel
from quantloom.operators.explain import deterministic_sample
from quantloom.session import scratch_path


def walks(background: DataFrame, features: Sequence[str], permutations: int, seed: int = 42) -> list[tuple[list[int], list[float | None]]]:
    """Feature orders paired with background rows: at least ``permutations`` walks, the same number from each row; at most 100 background rows are read."""
    rows = [[row[f] for f in features] for row in background.select(*features).limit(100).collect()]
    rng = random.Random(seed)
    out = []
    for i in range(-(-permutations // len(rows)) * len(rows)):
        order = list(range(len(features)))
        rng.shuffle(order)
        places = [0] * len(features)
        for place, feature in enumerate(order):
            places[feature] = place
        out.append((places, rows[i % len(rows)]))
    return out


def permutation_attributions(model: FittedModel, df: DataFrame, background: DataFrame, permutations: int = 20, keys: Sequence[str] = ("ticker", "date"), seed: int = 42) -> DataFrame:
    """(keys, feature, value) for every row of ``df``."""
    features = list(model.spec.features)
    width = len(features)
    sample = deterministic_sample(background, keys, 100, seed)
    drawn = walks(sample, features, permutations, seed)
    number = lambda v: F.lit(None).cast("double") if v is None else F.lit(float(v))
    paths = F.array(
        *[
            F.struct(F.array(*[F.lit(p) for p in places]).alias("places"), F.array(*[number(v) for v in row]).alias("start"))
            for places, row in drawn
        ]
    )
    steps = df.select(*keys, *features).withColumn("_path", F.explode(paths)).withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(width))))
    mixed = steps.select(
        *keys,
        F.col("_path.places").alias("_places"),
        "_step",
        *[F.when(F.col("_path.places")[j] < F.col("_step"), F.col(f)).otherwise(F.col("_path.start")[j]).alias(f) for j, f in enumerate(features)],
    )
    scored = model.score(mixed).select(*keys, "_places", "_step", "probability")
    # the score at step s ends the move of the feature placed s-1 and starts the move of the feature placed s
    moved = lambda place: F.array_position("_places", place)
    name = lambda index: F.element_at(F.array(*[F.lit(f) for f in features]), index.cast("int"))
    ends = F.when(F.col("_step") > 0, F.struct(name(moved(F.col("_step") - 1)).alias("feature"), F.col("probability").alias("v")))
    starts = F.when(F.col("_step") < width, F.struct(name(moved(F.col("_step"))).alias("feature"), (-F.col("probability")).alias("v")))
    parts = scored.select(*keys, F.inline(F.array_compact(F.array(ends, starts))))
    return parts.groupBy(*keys, "feature").agg((F.sum("v") / len(drawn)).alias("value"))


def background_mean(model: FittedModel, background: DataFrame, permutations: int = 20, keys: Sequence[str] = ("ticker", "date"), seed: int = 42) -> DataFrame:
    """Base value: mean prediction over the background rows the walks start from (Q7)."""
    features = list(model.spec.features)
    drawn = walks(deterministic_sample(background, keys, 100, seed), features, permutations, seed)
    schema = ", ".join(f"`{f}` double" for f in features)
    rows = [tuple(None if v is None else float(v) for v in row) for _, row in drawn]
    return model.score(background.sparkSession.createDataFrame(rows, schema)).agg(F.avg("probability").alias("base_value"))


# --- exact attributions of tree models -------------------------------------------------------------------------


@dataclass(frozen=True)
class Leaves:
    """All leaves of an ensemble: the features on each leaf's path with the interval (low, high] that leads there, and what the leaf adds."""

    feature: np.ndarray  # leaves x slots; -1 where a path has fewer features
    low: np.ndarray
    high: np.ndarray
    value: np.ndarray


def _tree_part(model: FittedModel) -> tuple[str, PipelineModel]:
    if len(model.parts) != 1 or model.spec.parts[0][0] not in ("forest", "gbt", "ranker"):
        raise ValueError("exact attributions need a model of one tree part")
    return model.spec.parts[0][0], model.parts[0]


def explained(model: FittedModel, df: DataFrame, name: str = "explained") -> DataFrame:
    """The sum over leaves that attributions divide: a forest's probability; of boosted trees the log-odds, of the ranker the score under its sigmoid."""
    kind, part = _tree_part(model)
    value = F.col("prediction") if kind == "ranker" else vector_to_array("_vec")[1] if kind == "forest" else 2 * vector_to_array("rawPrediction")[1]
    return part.transform(df).select(*df.columns, value.alias(name))


def read_leaves(model: FittedModel, spark: SparkSession) -> Leaves:
    """Leaves from the saved form of the ensemble; as large as the model."""
    kind, part = _tree_part(model)
    path = scratch_path(spark, "trees")
    part.stages[-1].write().overwrite().save(path)
    node = F.col("nodeData")
    fields = [node["id"].alias("id"), node["leftChild"].alias("left"), node["rightChild"].alias("right"), node["split"]["featureIndex"].alias("f"), F.get(node["split"]["leftCategoriesOrThreshold"], 0).alias("t"), node["prediction"].alias("p"), node["impurityStats"].alias("stats")]
    nodes = spark.read.parquet(f"{path}/data").select("treeID", *fields).toArrow().to_pylist()
    weight = {r["_1"]: r["_3"] for r in spark.read.parquet(f"{path}/treesMetadata").select("_1", "_3").collect()}
    trees: dict[int, dict[int, dict]] = {}
    for n in nodes:
        trees.setdefault(n["treeID"], {})[n["id"]] = n
    found = []
    for tree, by in trees.items():
        todo: list[tuple[int, dict[int, tuple[float, float]]]] = [(0, {})]
        while todo:
            at, box = todo.pop()
            n = by[at]
            if n["left"] < 0:
                share = n["stats"][1] / sum(n["stats"]) / len(trees) if kind == "forest" else n["p"] * weight[tree] * (2 if kind == "gbt" else 1)
                found.append((box, share))
                continue
            low, high = box.get(n["f"], (-np.inf, np.inf))
            todo.append((n["left"], {**box, n["f"]: (low, min(high, n["t"]))}))
            todo.append((n["right"], {**box, n["f"]: (max(low, n["t"]), high)}))
    slots = max(1, max(len(box) for box, _ in found))
    feature = np.full((len(found), slots), -1)
    low, high = np.full(feature.shape, -np.inf), np.full(feature.shape, np.inf)
    for i, (box, _) in enumerate(found):
        for k, (f, (a, b)) in enumerate(sorted(box.items())):
            feature[i, k], low[i, k], high[i, k] = f, a, b
    return Leaves(feature, low, high, np.array([v for _, v in found]))


def _fits(leaves: Leaves, x: np.ndarray) -> np.ndarray:
    """rows x leaves: one bit per slot, set where the row lies in the slot's interval."""
    out = np.zeros((len(x), len(leaves.value)), np.int64)
    for k in range(leaves.feature.shape[1]):
        value = x[:, leaves.feature[:, k]]
        out |= (((value > leaves.low[:, k]) & (value <= leaves.high[:, k])) | (leaves.feature[:, k] < 0)).astype(np.int64) << k
    return out


class _Shares:
    """Closed form of the attributions against a background, prepared once per task.

    For a row, a background row and a leaf, the row must bring the features U that only it satisfies and must not bring the features V that only the background row
    satisfies; a leaf with a feature that neither satisfies is out of reach. Averaged over all orders each feature of U gets (|U|-1)! |V|! / (|U|+|V|)! of the leaf's value
    and each of V loses |U|! (|V|-1)! / (|U|+|V|)! of it. Background rows matter only by the bits they satisfy on a path, so equal ones are counted together.
    """

    def __init__(self, leaves: Leaves, background: np.ndarray, width: int):
        self.leaves, self.width = leaves, width
        bits = _fits(leaves, background)
        slots = leaves.feature.shape[1]
        code, n = np.unique((np.arange(len(leaves.value)) << slots) | bits, return_counts=True)
        self.leaf, self.mask = code >> slots, code & ((1 << slots) - 1)
        self.value = leaves.value[self.leaf] * n / len(background)
        self.full = (1 << slots) - 1
        fact = [math.factorial(i) for i in range(2 * slots + 1)]
        self.plus, self.minus = np.zeros((slots + 1, slots + 1)), np.zeros((slots + 1, slots + 1))
        for p in range(slots + 1):
            for q in range(slots + 1):
                if p:
                    self.plus[p, q] = fact[p - 1] * fact[q] / fact[p + q]
                if q:
                    self.minus[p, q] = fact[p] * fact[q - 1] / fact[p + q]
        owner = leaves.feature[self.leaf]
        self.at = [(k, f, np.flatnonzero(owner[:, k] == f)) for k in range(slots) for f in np.unique(owner[:, k]).tolist() if f >= 0]

    def __call__(self, x: np.ndarray, cells: int = 2_000_000) -> np.ndarray:
        """rows x features attributions; rows go in blocks of about ``cells`` (row, leaf, background) entries."""
        out = np.zeros((len(x), self.width))
        step = max(1, cells // max(1, len(self.leaf)))
        for s in range(0, len(x), step):
            own = _fits(self.leaves, x[s : s + step])[:, self.leaf]
            reach = ((own | self.mask) == self.full) * self.value
            brings, keeps = own & ~self.mask, self.mask & ~own
            p, q = np.bitwise_count(brings), np.bitwise_count(keeps)
            gain, loss = self.plus[p, q] * reach, self.minus[p, q] * reach
            for k, f, at in self.at:
                out[s : s + step, f] += (gain[:, at] * ((brings[:, at] >> k) & 1) - loss[:, at] * ((keeps[:, at] >> k) & 1)).sum(axis=1)
        return out


def _vectors(model: FittedModel, df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys and the model's input after its own imputation, as an array."""
    _, part = _tree_part(model)
    return PipelineModel(part.stages[:-1]).transform(df).select(*keys, vector_to_array("_x").alias("_x"))


def tree_attributions(model: FittedModel, df: DataFrame, background: DataFrame, keys: Sequence[str] = ("ticker", "date"), rows: int = 100, seed: int = 42) -> DataFrame:
    """(keys, feature, value): exact Shapley values of every row of ``df`` against ``rows`` rows of the background (Q2, Q3).

    They sum to ``explained`` less ``tree_base`` of the same background. The driver holds the model's leaves and the background rows; the rows to explain stay distributed.
    """
    spark, features = df.sparkSession, list(model.spec.features)
    sample = np.array([r["_x"] for r in _vectors(model, deterministic_sample(background, keys, rows, seed), keys).collect()], float)  # at most ``rows`` rows
    shared = spark.sparkContext.broadcast((read_leaves(model, spark), sample))  # as large as the model
    inputs = _vectors(model, df, keys)
    schema = T.StructType([*[f for f in inputs.schema.fields if f.name != "_x"], T.StructField("values", T.ArrayType(T.DoubleType()))])

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shares = _Shares(*shared.value, len(features))
        for batch in batches:
            x = np.array(batch.column("_x").to_pylist(), float).reshape(batch.num_rows, len(features))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], pa.array(shares(x).tolist(), pa.list_(pa.float64()))], names=[*keys, "values"])

    names = F.array(*[F.lit(f) for f in features])
    return inputs.mapInArrow(explain, schema).select(*keys, F.inline(F.arrays_zip(names.alias("feature"), F.col("values").alias("value"))).alias("feature", "value"))


def tree_base(model: FittedModel, background: DataFrame, keys: Sequence[str] = ("ticker", "date"), rows: int = 100, seed: int = 42) -> DataFrame:
    """Base value of ``tree_attributions``: the mean of ``explained`` over the background rows (Q7)."""
    return explained(model, deterministic_sample(background, keys, rows, seed)).agg(F.avg("explained").alias("base_value"), F.count(F.lit(1)).alias("rows"))
