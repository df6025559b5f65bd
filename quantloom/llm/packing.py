"""Packing of documents into training sequences along a space-filling curve.

Every document gets a hashed vector (byte pairs, each with fixed pseudo-random signs) projected to three numbers, made even by quantiles over all documents and
turned into a Hilbert key. Documents are range-partitioned and sorted by that key, then laid end to end: neighbours on the curve share sequences. A document is
cut where a sequence is full, so only the last sequence of a partition is padded.

Hot groups: the partition bounds are quantiles of (key, hash of the identifier), so copies with one key spread over several
partitions. Texts travel once, ids never do.

Defined results: null text counts as empty (only the end id); repeated rows are packed each; an empty table gives no rows; rows without identifier are packed
as well. A sequence is padded to ``length`` unless its own length is a power of two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import give_back, mix, slices, stored, text_bytes
from quantloom.llm.pieces import coder

DIMS, BITS = 3, 8
PART_BYTES = 16 << 20  # text of one partition
_SIGNS: list[np.ndarray] = []


def _signs() -> list[np.ndarray]:
    """A value in -8..7 for each pair of bytes and each dimension."""
    if not _SIGNS:
        h = mix(np.arange(1, 65537, dtype=np.uint64))
        _SIGNS.extend(((h >> np.uint64(4 * d)) & np.uint64(15)).astype(np.int64) - 8 for d in range(DIMS))
    return _SIGNS


def project(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x DIMS: mean of the pairs' values; 0 for texts under two bytes."""
    out = np.zeros((len(offsets) - 1, DIMS))
    for s, e in slices(offsets):
        part, po = raw[offsets[s] : offsets[e]], offsets[s : e + 1] - offsets[s]
        if len(part) < 2:
            continue
        pair = (part[:-1].astype(np.uint16) << 8) | part[1:]
        n = np.maximum(0, np.diff(po) - 1)
        for d, table in enumerate(_signs()):
            c = np.concatenate(([0], np.cumsum(table[pair])))
            out[s:e, d] = (c[np.maximum(po[:-1], np.minimum(po[1:] - 1, len(pair)))] - c[np.minimum(po[:-1], len(pair))]) / np.maximum(1, n)
    return out


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of integer cells (rows x dims), by the published transpose algorithm, vectorised over rows."""
    x = [cells[:, d].astype(np.int64) for d in range(cells.shape[1])]
    q = 1 << (bits - 1)
    while q > 1:
        for d in range(len(x)):
            high = (x[d] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[d]) & (q - 1))
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
        q >>= 1
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[-1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x = [v ^ t for v in x]
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for v in x:
            key = (key << 1) | ((v >> b) & 1)
    return key


def _key(points: np.ndarray, edges: list[np.ndarray], tie: np.ndarray) -> np.ndarray:
    """Hilbert key above 31 bits of the tie breaker."""
    cells = np.stack([np.searchsorted(edges[d], points[:, d], "right") for d in range(DIMS)], axis=1)
    return (hilbert(np.minimum(cells, (1 << BITS) - 1)) << 31) | tie


def pack(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: (doc_id, start, length, ids, doc_tokens, sequence_id, offset); ``ids`` are packed little-endian unsigned 32-bit."""
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 31) - 1)))

    def place(batches):
        for batch in batches:
            raw, offs = text_bytes(batch.column("text"))
            p = project(raw, offs)
            yield pa.RecordBatch.from_arrays([pa.array(p[:, d]) for d in range(DIMS)] + [batch.column("tie"), pa.array(np.diff(offs))], names=["p0", "p1", "p2", "tie", "n"])

    placed = stored(rows.mapInArrow(place, "p0 double, p1 double, p2 double, tie long, n long"), "packing-points")
    steps = [k / (1 << BITS) for k in range(1, 1 << BITS)]
    seen = placed.agg(F.sum("n").alias("n"), *[F.percentile_approx(f"p{d}", steps, 4096).alias(f"e{d}") for d in range(DIMS)]).first()  # one row
    if seen["n"] is None:
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    edges = [np.array(seen[f"e{d}"]) for d in range(DIMS)]
    parts = max(1, -(-int(seen["n"]) // PART_BYTES))

    def keys(batches):
        for batch in batches:
            p = np.stack([batch.column(f"p{d}").to_numpy() for d in range(DIMS)], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(_key(p, edges, batch.column("tie").to_numpy()))], names=["key"])

    bounds = placed.mapInArrow(keys, "key long").agg(F.percentile_approx("key", [k / parts for k in range(1, parts)] or [0.5], max(10_000, 20 * parts)).alias("b")).first()["b"]  # one row
    bounds = np.array(bounds[: parts - 1], np.int64)

    def assign(batches):
        for batch in batches:
            raw, offs = text_bytes(batch.column("text"))
            k = _key(project(raw, offs), edges, batch.column("tie").to_numpy())
            part = np.searchsorted(bounds, k, "left").astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(k), pa.array(part)], names=["doc_id", "text", "key", "part"])

    dealt = rows.mapInArrow(assign, "doc_id long, text string, key long, part int").repartitionById(parts, "part").sortWithinPartitions("part", "key", "doc_id")
    return dealt.mapInArrow(_layer(path, length, end_id), _SCHEMA)


_SCHEMA = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("doc_id", "start", "length")]
    + [T.StructField("ids", T.BinaryType())]
    + [T.StructField(n, T.LongType()) for n in ("doc_tokens", "sequence_id", "offset")]
)


def _layer(path: str, length: int, end_id: int):
    """Lay the sorted documents of a partition end to end."""

    def run(batches):
        words = coder(path, spaced=True, ranks=True)
        part, used = None, 0  # tokens laid so far in this partition
        end = np.array([end_id], words.dtype).tobytes()
        for batch in batches:
            ids, parts = batch.column("doc_id"), batch.column("part").to_numpy()
            column = batch.column("text")
            sizes = np.concatenate(([0], np.cumsum(text_bytes(column)[1][1:] - text_bytes(column)[1][:-1])))
            for s, e in slices(sizes):
                cols: list[list] = [[] for _ in range(7)]
                docs = ids.slice(s, e - s).to_pylist()
                for k, packed in enumerate(words.encode(column.slice(s, e - s).to_pylist())):
                    if parts[s + k] != part:
                        part, used = parts[s + k], 0
                    a = np.frombuffer(packed + end, words.dtype).astype("<u4")
                    at = 0
                    while at < len(a):
                        take = min(len(a) - at, length - used % length)
                        row = (docs[k], at, take, a[at : at + take].tobytes(), len(a), (int(part) << 32) | (used // length), used % length)
                        for c, v in zip(cols, row, strict=True):
                            c.append(v)
                        at, used = at + take, used + take
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 3 else pa.int64()) for i, c in enumerate(cols)], names=[f.name for f in _SCHEMA])
        words.release()
        give_back()

    return run
