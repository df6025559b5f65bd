"""Near-duplicate vectors by PCA-ordered tiled comparison.

Unit vectors are rotated onto the principal axes (products do not change), so leading dimensions carry most of a product. Linked vectors lie
within sqrt(2 - 2t) of each other, so only tiles of the same or neighbouring cells of a grid over the first axes
are compared. Inside a pair of tiles products are accumulated a few dimensions at a time; the rest is bounded by the product of the suffix
norms, and a pair of vectors is given up once its cosine cannot reach the threshold. Cosines within 1e-9 of the threshold
are computed again from the unrotated vectors.

A task returns one count per vector and a spanning forest of its links, never the pairs, and equal vectors are compared once as a class. So a group with a third of all
rows costs sums, not rows.

Tiles lie in files of bounded size. A task reads two of them and compares their tiles, so pairs of tiles need no shuffle: the disk holds two shuffles and two tables of the
vectors, however many pairs there are. Classes are found by a 128-bit hash of a vector; identifiers travel with that hash alone.

Defined results: vectors that are null, empty, zero, or hold a null or non-finite component link with nothing (their own component); vectors of
unequal length never link; rows without identifier are left out; repeated rows of one identifier count as rows of its class. Links are
pairs with cosine >= the threshold in double precision.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm.common import components, forest, spread_join, stored
from quantloom.llm.topk import vectors

TILE = 1024
AXES = 3  # of the grid
LEAST_WIDTH = 1 / 32  # of a cell, so that a length of vectors has at most 66**3 cells
FILE_BYTES = 64 << 20  # of tiles in one file, at most about half a read split
HELD = 1 << 20  # counts and edges that a task gathers before it sums them
STEPS = (8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096)
SLACK = 1e-9


def _unit(a: np.ndarray) -> np.ndarray | None:
    top = np.abs(a).max()
    if top == 0:
        return None
    a = a / top
    return a / np.sqrt((a * a).sum())


def _units(raw: bytes, dim: int, kind: str) -> np.ndarray:
    a = np.frombuffer(raw, kind).reshape(-1, dim).astype(np.float64)
    a = a / np.abs(a).max(axis=1, keepdims=True)
    return a / np.sqrt((a * a).sum(axis=1, keepdims=True))


def _moments(classes: DataFrame) -> dict[int, np.ndarray]:
    """Second moments of the unit vectors by length: lengths squared numbers each."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for v in vectors(batch.column("vec")):
                u = _unit(v) if v is not None else None
                if u is not None:
                    sums.setdefault(len(u), np.zeros((len(u), len(u))))
                    sums[len(u)] += np.outer(u, u)
        for dim, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(s.size, dim, np.int32)), pa.array(np.arange(s.size, dtype=np.int64)), pa.array(s.ravel())], names=["dim", "cell", "v"])

    out: dict[int, np.ndarray] = {}
    for r in classes.select("vec").mapInArrow(run, "dim int, cell long, v double").groupBy("dim", "cell").agg(F.sum("v").alias("v")).collect():
        out.setdefault(r["dim"], np.zeros(r["dim"] ** 2))[r["cell"]] = r["v"]
    return {d: m.reshape(d, d) for d, m in out.items()}


def _axes(moments: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Orthonormal axes, strongest first."""
    return {d: np.linalg.eigh(m)[1][:, ::-1].copy() for d, m in moments.items()}


def _kind(classes: DataFrame) -> str:
    """Number type in which vectors travel: that of the column."""
    return "<f4" if classes.schema["vec"].dataType.elementType.typeName() == "float" else "<f8"


def _files(spark: SparkSession, size: int) -> int:
    """Files of about half the size of a read split, so that none is cut; a few for each core when the vectors are small, as tasks are pairs of files."""
    split = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return max(-(-size // max(1, min(FILE_BYTES, split // 2))), math.ceil(math.sqrt(8 * spark.sparkContext.defaultParallelism)))


def _tiles(classes: DataFrame, axes, width: float) -> DataFrame:
    """Tiles of about TILE vectors: (dim, cell, sub, ids, sizes, vectors as they are stored)."""
    kind = _kind(classes)

    def place(batches):
        for batch in batches:
            cid, size, dims, cells, plain = [], [], [], [], []
            for c, n, v in zip(batch.column("class_id").to_pylist(), batch.column("class_size").to_pylist(), vectors(batch.column("vec")), strict=True):
                u = _unit(v) if v is not None else None
                if u is None:
                    continue
                y = u @ axes.value[len(u)]
                cid.append(c)
                size.append(n)
                dims.append(len(u))
                cells.append([int(x) for x in np.floor(np.pad(y[:AXES], (0, max(0, AXES - len(y)))) / width)])
                plain.append(v.astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cid, pa.int64()), pa.array(size, pa.int64()), pa.array(dims, pa.int32()), pa.array(cells, pa.list_(pa.int32())), pa.array(plain, pa.binary())],
                names=["cid", "size", "dim", "cell", "plain"],
            )

    placed = classes.select("class_id", "class_size", "vec").mapInArrow(place, "cid long, size long, dim int, cell array<int>, plain binary")
    counted = placed.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"))
    counted = stored(counted, "vector-cells")  # LEAST_WIDTH bounds it
    total = counted.agg(F.sum(F.col("n") * F.col("dim"))).first()[0] or 0
    sizes = counted.select("dim", "cell", F.ceil(F.col("n") / TILE).cast("int").alias("subs"))
    subbed = placed.join(F.broadcast(sizes), ["dim", "cell"]).withColumn("sub", F.pmod(F.xxhash64("cid"), F.col("subs")).cast("int"))
    files = _files(classes.sparkSession, total * int(kind[2]))

    def tile(t: pa.Table) -> pa.Table:
        t = t.sort_by("cid")
        one = lambda c: t.column(c)[0]
        joined = lambda c: b"".join(t.column(c).to_pylist())
        raw = lambda c: t.column(c).to_numpy().astype("<i8").tobytes()
        return pa.Table.from_arrays(
            [pa.array([one("dim").as_py()], pa.int32()), pa.array([one("cell").as_py()], pa.list_(pa.int32())), pa.array([one("sub").as_py()], pa.int32())]
            + [pa.array([x], pa.binary()) for x in (raw("cid"), raw("size"), joined("plain"))],
            names=["dim", "cell", "sub", "ids", "sizes", "plain"],
        )

    return stored(subbed.repartition(files, "dim", "cell", "sub").groupBy("dim", "cell", "sub").applyInArrow(tile, "dim int, cell array<int>, sub int, ids binary, sizes binary, plain binary"), "vector-tiles")


def linked(ya: np.ndarray, yb: np.ndarray, ua: np.ndarray, ub: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs with cosine >= t: dense blocks of dimensions while many pairs live, single pairs after that."""
    dim = ya.shape[1]
    suffix = lambda y, d: np.sqrt((y[:, d:] ** 2).sum(axis=1))
    done, dense, product = 0, True, np.zeros((len(ya), len(yb)))
    i = j = None
    for step in (*[s for s in STEPS if s < dim], dim):
        if dense:
            product += ya[:, done:step] @ yb[:, done:step].T
            live = product + np.outer(suffix(ya, step), suffix(yb, step)) >= t - SLACK
            n = int(live.sum())
            if n * 16 < live.size:
                dense = False
                i, j = np.nonzero(live)
                product = product[i, j]
        else:
            product = product + np.einsum("ij,ij->i", ya[i, done:step], yb[j, done:step])
            live = product + suffix(ya, step)[i] * suffix(yb, step)[j] >= t - SLACK
            i, j, product = i[live], j[live], product[live]
        done = step
        if not dense and not len(i):
            return i, j
    if dense:
        i, j = np.nonzero(product >= t - SLACK)
        product = product[i, j]
    near = np.abs(product - t) <= SLACK
    keep = product > t
    if near.any():
        keep[near] = np.einsum("ij,ij->i", ua[i[near]], ub[j[near]]) >= t
    return i[keep], j[keep]


def _compare(pairs: DataFrame, t: float, axes, kind: str) -> DataFrame:
    """kind 0: links of a vector; kind 1: an edge of the forest."""

    def run(batches):
        ids, counts, one, two, held = [], [], [], [], 0
        for batch in batches:
            for k in range(batch.num_rows):  # one pair of tiles at a time
                r = {c: batch.column(c)[k].as_py() for c in ("dim", "same", "ids", "sizes", "plain", "b_ids", "b_sizes", "b_plain")}
                a, b = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["b_ids"], "<i8")
                na, nb = np.frombuffer(r["sizes"], "<i8"), np.frombuffer(r["b_sizes"], "<i8")
                ua, ub = _units(r["plain"], r["dim"], kind), _units(r["b_plain"], r["dim"], kind)
                i, j = linked(ua @ axes.value[r["dim"]], ub @ axes.value[r["dim"]], ua, ub, t)
                if r["same"]:
                    up = i < j
                    i, j = i[up], j[up]
                if not len(i):
                    continue
                u, n = _summed([a[i], b[j]], [nb[j], na[i]])
                nodes, roots = forest(a[i], b[j])
                off = nodes != roots
                for into, new in ((ids, u), (counts, n), (one, nodes[off]), (two, roots[off])):
                    into.append(new)
                held += len(u) + int(off.sum())
                if held > HELD:
                    ids, counts, one, two = _gathered(ids, counts, one, two)
                    held = len(ids[0]) + len(one[0])
                    if held > HELD // 2:
                        yield _found(ids, counts, one, two)
                        ids, counts, one, two, held = [], [], [], [], 0
        if ids:
            yield _found(*_gathered(ids, counts, one, two))

    return pairs.mapInArrow(run, "kind int, a long, b long")


def _summed(ids: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(np.concatenate(ids), return_inverse=True)
    n = np.zeros(len(u), np.int64)
    np.add.at(n, inv, np.concatenate(counts))
    return u, n


def _gathered(ids, counts, one, two):
    """One count per vector and one forest of all edges so far."""
    u, n = _summed(ids, counts)
    nodes, roots = forest(np.concatenate(one), np.concatenate(two))
    off = nodes != roots
    return [u], [n], [nodes[off]], [roots[off]]


def _found(ids, counts, one, two) -> pa.RecordBatch:
    u, n, nodes, roots = ids[0], counts[0], one[0], two[0]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(len(u), np.int32), np.ones(len(nodes), np.int32)])), pa.array(np.concatenate([u, nodes])), pa.array(np.concatenate([n, roots]))], names=["kind", "a", "b"])


def _pairs(tiles: DataFrame) -> DataFrame:
    """Tiles of the same or a neighbouring cell, each pair once. Every task reads one file of each side, and nothing is shuffled."""
    wide = ["ids", "sizes", "plain"]
    at = tiles.select("*", F.xxhash64("dim", "cell", "sub").alias("at"))  # which of two tiles comes first: any order that spreads the work evenly
    b = at.select(*[F.col(c).alias(f"b_{c}") for c in ("dim", "cell", "sub", "at", *wide)])
    # written so that Spark finds no key to shuffle by
    near = (F.col("dim") - F.col("b_dim")) == 0
    for k in range(AXES):
        near &= F.abs(F.col("cell")[k] - F.col("b_cell")[k]) <= 1
    same = ((F.col("sub") - F.col("b_sub")) == 0) & ((F.size("cell") - F.size("b_cell")) == 0)
    for k in range(AXES):
        same &= (F.col("cell")[k] - F.col("b_cell")[k]) == 0
    rest = F.struct("at", "cell", "sub") < F.struct("b_at", "b_cell", "b_sub")
    pairs = at.join(b.hint("shuffle_replicate_nl"), near & (same | rest))
    return pairs.select("dim", same.alias("same"), *wide, *[f"b_{c}" for c in wide])


def near_duplicates(vecs: DataFrame, threshold: float = 0.95, ident: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row with an identifier."""
    if not 0 < threshold <= 1:
        raise ValueError("threshold must lie in (0, 1]")
    spark = vecs.sparkSession
    rows = vecs.select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("vec")).filter("id is not null")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.coalesce(bad, F.lit(True)) & F.coalesce(F.exists("vec", lambda x: x != 0), F.lit(False))
    zeroless = F.transform("vec", lambda x: x + 0.0)  # -0.0 counts as 0.0
    keyed = rows.filter(usable).withColumns({"h": F.xxhash64(zeroless), "g": F.xxhash64(F.lit(1), zeroless)})
    # summed by every task before the shuffle, so a vector with a third of all rows is one row of each
    classes = stored(keyed.groupBy("h", "g").agg(F.min("id").alias("class_id"), F.count(F.lit(1)).alias("class_size"), F.min_by("vec", "id").alias("vec")), "vector-classes")
    keys = classes.select("h", "g", "class_id")
    twice = classes.groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.max("class_size").alias("size"), F.min(F.struct("h", "g")).alias("first")).filter("n > 1")
    if not twice.isEmpty():  # an identifier stands first in several classes: one of them stands for all
        one = F.col("first").isNull() | (F.struct("h", "g") == F.col("first"))
        classes = classes.join(twice, "class_id", "left").filter(one).select("class_id", F.coalesce("size", "class_size").alias("class_size"), "vec")
    axes = spark.sparkContext.broadcast(_axes(_moments(classes)))  # lengths squared numbers
    width = max(float(np.sqrt(2 - 2 * threshold)) + 1e-6, LEAST_WIDTH)
    found = stored(_compare(_pairs(_tiles(classes, axes, width)), threshold, axes, _kind(classes)), "vector-links")
    roots = components(found.filter("kind = 1").select("a", "b"), "vector-components")
    links = found.filter("kind = 0").groupBy("a").agg(F.sum("b").alias("n"))
    by_class = (
        classes.select("class_id", "class_size")
        .join(links, F.col("class_id") == F.col("a"), "left").drop("a")
        .join(roots, F.col("class_id") == F.col("node"), "left")
        .select("class_id", (F.coalesce("n", F.lit(0)) + F.col("class_size") - 1).alias("n_links"), F.coalesce("root", "class_id").alias("component_id"))
    )
    out = spread_join(keyed.select("id", "h", "g"), keys.join(by_class, "class_id"), ["h", "g"], "id", present=True).select(F.col("id").alias("vec_id"), "n_links", "component_id")
    alone = rows.filter(~F.coalesce(usable, F.lit(False))).select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
