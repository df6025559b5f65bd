"""Exact top-k inner-product search by distributed histogram selection.

Queries and candidates are packed into blocks by a hash of their identifier; a task scores one block of each. The scores are never
stored: every round scores again and keeps, per query, a histogram of the scores inside the query's current
interval (only the bins from the top down to the block's own k-th score can matter, so only those leave the task). The summed
histograms give the bin with the k-th score, which is the next interval, until bins are one integer wide. A last round emits the scores above the k-th
value, and of those equal to it the smallest identifiers that are still needed.

Defined results: vectors that are null, empty or hold a null or non-finite component take no part, neither do rows without identifier; only vectors of equal length
are compared; repeated rows of the query's own identifier are not its candidates, other repeated rows each count; ties go to the smaller
identifier; a query with fewer candidates returns them all; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantloom.llm.common import stored

CANDIDATE_BLOCK, QUERY_BLOCK, BINS = 2048, 512, 256
SCALE = 64.0
_BLOCK = "dim int, blk long, ids binary, data binary, norm double"


def vectors(column: pa.Array) -> list[np.ndarray | None]:
    """Usable vectors as doubles; None for the others."""
    out: list[np.ndarray | None] = []
    for x in column:
        v = x.values if x.is_valid else None
        if v is None or len(v) == 0 or v.null_count:
            out.append(None)
            continue
        a = v.to_numpy(zero_copy_only=False).astype(np.float64)
        out.append(a if np.isfinite(a).all() else None)
    return out


def _pack(rows: DataFrame, size: int, scale: float) -> DataFrame:
    """Blocks of about ``size`` scaled integer vectors of one length."""
    n = rows.count()
    blocks = max(1, -(-n // size))
    keyed = rows.select(F.size("vec").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("blk"), "id", "vec")

    def block(t: pa.Table) -> pa.Table:
        vecs = vectors(t.column("vec").combine_chunks())
        ids = t.column("id").to_numpy()
        good = [i for i, v in enumerate(vecs) if v is not None]
        names = ["dim", "blk", "ids", "data", "norm"]
        if not good:
            return pa.Table.from_arrays([pa.array([], x) for x in (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.float64())], names=names)
        order = np.array(good)[np.argsort(ids[good], kind="stable")]
        data = np.floor(scale * np.stack([vecs[i] for i in order]))
        dim, blk = t.column("dim")[0].as_py(), t.column("blk")[0].as_py()
        norm = float(np.sqrt((data**2).sum(axis=1).max()))
        return pa.Table.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([blk], pa.int64()), pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), pa.array([data.tobytes()], pa.binary()), pa.array([norm])], names=names
        )

    return keyed.groupBy("dim", "blk").applyInArrow(block, _BLOCK)


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products; doubles are exact below 2^53, longer ones take the slow integer way."""
    if a.size and b.size and np.abs(a).max() * np.abs(b).max() * a.shape[1] >= 2.0**52:
        return a.astype(np.int64) @ b.astype(np.int64).T
    return (a @ b.T).astype(np.int64)


def _blocks(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    dim = row["dim"]
    return (
        np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["q_data"], np.float64).reshape(-1, dim),
        np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["data"], np.float64).reshape(-1, dim),
    )


def top_k(vecs: DataFrame, is_query: Column, k: int, ident: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` highest integer inner products of floor(scale * component)."""
    rows = vecs.select(F.col(ident).cast("long").alias("id"), F.col(vector).alias("vec"), is_query.alias("is_q")).filter("id is not null and size(vec) > 0")
    cand = stored(_pack(rows.select("id", "vec"), CANDIDATE_BLOCK, scale), "topk-candidates")
    query = _pack(rows.filter("is_q").select("id", "vec").dropDuplicates(["id"]), QUERY_BLOCK, scale)
    query = stored(query.select("dim", F.col("blk").alias("qb"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("norm").alias("q_norm")), "topk-queries")
    bound = cand.agg(F.max("norm").alias("c")).crossJoin(query.agg(F.max("q_norm").alias("q"))).first()  # one row each
    top = int((bound["c"] or 0) * (bound["q"] or 0)) + 1
    pairs = query.join(cand, "dim")
    width = 1
    while width * BINS < 2 * top + 1:
        width *= BINS
    # where each query's interval begins, and how many of its scores from the interval's top down are still to be found
    state = query.select("dim", "qb", F.lit(None).cast("array<struct<qi:int,lo:long,need:long>>").alias("at"))
    first = -top
    while True:
        found = stored(_histograms(pairs.join(state, ["dim", "qb"]), width, k, first), "topk-histograms")
        state = _next(found, state, width, k, first)
        if width == 1:
            break
        width //= BINS
    hits = _emit(pairs.join(state, ["dim", "qb"]), k, first)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _start(row: dict, nq: int, k: int, first: int) -> tuple[np.ndarray, np.ndarray]:
    lo, need = np.full(nq, first, np.int64), np.full(nq, k, np.int64)
    for x in row["at"] or []:
        lo[x["qi"]], need[x["qi"]] = x["lo"], x["need"]
    return lo, need


def _histograms(pairs: DataFrame, width: int, k: int, first: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                qi, q, ci, c = _blocks(row)
                s = _scores(q, c)
                lo, need = _start(row, len(qi), k, first)
                bins = (s - lo[:, None]) // width
                bins[qi[:, None] == ci[None, :]] = -1
                ok = (bins >= 0) & (bins < BINS)
                flat = bins + (np.arange(len(qi)) * BINS)[:, None]
                h = np.bincount(flat[ok], minlength=len(qi) * BINS).reshape(len(qi), BINS)
                above = h[:, ::-1].cumsum(axis=1)[:, ::-1] - h  # scores in higher bins of this block
                r, b = np.nonzero((h > 0) & (above < need[:, None]))
                n = len(r)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(n, row["dim"], np.int32)), pa.array(np.full(n, row["qb"], np.int64)), pa.array(r.astype(np.int32)), pa.array(lo[r] + b * width), pa.array(need[r]), pa.array(h[r, b].astype(np.int64))],
                    names=["dim", "qb", "qi", "lo", "need", "n"],
                )

    return pairs.mapInArrow(run, "dim int, qb long, qi int, lo long, need long, n long").groupBy("dim", "qb", "qi", "lo", "need").agg(F.sum("n").alias("n"))


def _next(found: DataFrame, state: DataFrame, width: int, k: int, first: int) -> DataFrame:
    """The bin with the k-th score. A query with too few candidates keeps the whole range: it starts at ``first`` and still needs ``k``.

    Blocks without any score in their interval keep a row without entries, which means the same for all their queries.
    """
    upto = F.sum("n").over(Window.partitionBy("dim", "qb", "qi").orderBy(F.col("lo").desc()).rowsBetween(Window.unboundedPreceding, 0))  # at most BINS rows
    run = found.withColumn("upto", upto)
    pick = run.groupBy("dim", "qb", "qi").agg(
        F.max(F.when(F.col("upto") >= F.col("need"), F.col("lo"))).alias("lo"),
        F.max_by(F.col("need") - (F.col("upto") - F.col("n")), F.when(F.col("upto") >= F.col("need"), F.col("lo"))).alias("need_in"),
        F.max("need").alias("need"),
    )
    fixed = pick.select("dim", "qb", F.struct("qi", F.coalesce("lo", F.lit(first)).alias("lo"), F.coalesce("need_in", "need").cast("long").alias("need")).alias("x"))
    packed = fixed.groupBy("dim", "qb").agg(F.collect_list("x").alias("at"))  # at most a block of queries a row
    return stored(state.select("dim", "qb").join(packed, ["dim", "qb"], "left"), "topk-state")


def _emit(pairs: DataFrame, k: int, first: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
                qi, q, ci, c = _blocks(row)
                s = _scores(q, c)
                lo, need = _start(row, len(qi), k, first)
                other = qi[:, None] != ci[None, :]
                equal = other & (s == lo[:, None])
                equal &= equal.cumsum(axis=1) <= need[:, None]  # blocks are ordered by identifier
                r, j = np.nonzero((other & (s > lo[:, None])) | equal)
                yield pa.RecordBatch.from_arrays([pa.array(qi[r]), pa.array(ci[j]), pa.array(s[r, j])], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")
