"""Helpers shared by the operators: reading, scratch tables, Arrow annotation, byte buffers of text columns, copy classes and components."""

from __future__ import annotations

import ctypes
import gc
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.session import scratch_path

#: Text is worked on in slices of about so many bytes, so that memory does not follow the length of an Arrow batch.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` under the shared folder and read it back: lineage is cut and lost executors lose nothing."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_of(column: str) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary"))


def crc32_text(value: str) -> int:
    return zlib.crc32(value.encode())


def give_back() -> None:
    """Return freed memory to the system at the end of a task: the Python worker stays, and other stages and the JVM share its executor."""
    _trim()


def _trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library, which gives memory back by itself
        pass


#: What an operator keeps in a Python worker from task to task. The worker outlives the stage, so tasks that work in large arrays empty it.
KEPT: list[dict] = []


def make_room() -> None:
    """Forget what tasks of other operators left in this worker."""
    if any(KEPT):
        for cache in KEPT:
            cache.clear()
        _trim()


def trimmed(work: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``work`` on a group, and ``give_back`` of what it held."""

    def run(group: pa.Table) -> pa.Table:
        make_room()
        out = work(group)
        give_back()
        return out

    return run


Make = Callable[[], Callable[[pa.RecordBatch], list]]


def annotate(df: DataFrame, fields: Sequence[T.StructField], make: Make) -> DataFrame:
    """Append ``fields`` to every row. ``make`` runs once a task and gives the function from a batch to the new columns.

    Columns of ``df`` that carry one of the new names are replaced; all others pass through untouched.
    """
    names = {f.name for f in fields}
    kept = [f.name for f in df.schema if f.name not in names]
    schema = T.StructType([f for f in df.schema if f.name not in names] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            new = work(batch)
            yield pa.RecordBatch.from_arrays([batch.column(k) for k in kept] + new, names=[f.name for f in schema])
            batch = new = None  # not held while the next one is read
        give_back()

    return df.mapInArrow(run, schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column without copying; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes; a longer text stands alone, whole."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = int(np.searchsorted(offsets, offsets[start] + size, "right")) - 1
        end = min(n, max(start + 1, end))
        yield start, end
        start = end


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (public splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def copies(df: DataFrame, key: Sequence[str], ident: str, salts: int = 32) -> DataFrame:
    """Rows of ``df`` with ``class_id`` (smallest ``ident`` with equal ``key``) and ``class_size``.

    Every key is split by a salt of the identifier, so a key with a third of all rows never meets in one task.
    """
    key = list(key)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(ident), F.lit(salts)))
    part = salted.groupBy(*key, "_salt").agg(F.min(ident).alias("_m"), F.count(F.lit(1)).alias("_n"))
    whole = part.groupBy(*key).agg(F.min("_m").alias("class_id"), F.sum("_n").alias("class_size"))
    back = part.drop("_m", "_n").join(whole, key)
    return salted.join(back, [*key, "_salt"]).drop("_salt")


def spread_join(rows: DataFrame, table: DataFrame, key: str | Sequence[str], ident: str, how: str = "inner", salts: int = 32, present: bool = False) -> DataFrame:
    """Join ``rows`` with a ``table`` of one row per key; a key with a third of all rows is dealt over ``salts`` partitions.

    ``present`` repeats a key's row only for the salts that its rows have, which is less when most keys have few rows.
    """
    key = [key] if isinstance(key, str) else list(key)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(ident), F.lit(salts)))
    if present:
        return salted.join(salted.select(*key, "_salt").distinct().join(table, key), [*key, "_salt"], how).drop("_salt")
    wide = table.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))).alias("_salt"))
    return salted.join(wide, [*key, "_salt"], how).drop("_salt")


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning star per connected part of the links a - b: (node, smallest node)."""
    nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = inv[: len(a)], inv[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return nodes, nodes[label]


def components(edges: DataFrame, name: str = "components", limit: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the smallest node reachable.

    Alternating large-star and small-star steps, each written to the shared folder; about log(n) rounds. Loops keep their node.
    """
    shape = [F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")]
    nodes = edges.select(F.explode(F.array(*shape)).alias("node")).distinct()
    now = stored(edges.select(*shape).filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    before = None
    for _ in range(limit):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        now = stored(small.filter("a <> b").distinct(), name)
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if before == seen:
            break
        before = seen
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now, nodes.node == now.a, "left").select("node", F.coalesce("b", "node").alias("root"))
