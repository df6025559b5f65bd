"""Best-fit packing with certified bin counts.

``cut`` turns documents into pieces of at most ``capacity`` tokens; only longer documents are cut. ``pack`` puts pieces into sequences (bins):

* A full piece is a sequence by itself. All other pieces are dealt at random to partitions of about ``part_items`` pieces, whatever their document, so groups of copies spread.
* Every partition is packed by best-fit decreasing: longest first, each into the open bin that it leaves the least room in.
* Lower bounds by dual-feasible functions (identity, rounding down to k parts, threshold, and one over the number of pieces that fit) certify a partition's bin count:
  no packing of its pieces has fewer bins than the largest bound, so a partition that meets it is done.
* Partitions with a gap exchange documents: their bins with room are taken apart, together with the emptiest bin of every partition (what rounding up to whole bins loses), dealt anew
  and packed again, in fewer partitions from round to round. A round that needs more bins is not kept. Rounds end when the total meets the bound of all pieces together, when a
  single partition saves none, or after ``rounds``.

Memory of a task follows ``part_items``, never the number of copies or the length of a document. The driver sees the piece count of each length (at most ``capacity`` numbers)
and counts of bins.

Defined results: null text is empty and has the end id only; rows without identifier and repeated rows are packed each; an empty table gives no rows; any columns of ``pieces`` pass
through ``pack``, only ``sequence_id``, ``offset`` and ``certified`` are replaced. Equal inputs in equal files give equal sequences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import slices, stored, text_bytes
from quantloom.llm.pieces import coder

PART_ITEMS = 1 << 15
ROUNDS = 8

_PIECES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]
    + [T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
)


def cut(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: (doc_id, piece, start, length, doc_tokens, ids); ``ids`` are packed little-endian unsigned 32-bit, the last one of a document is ``end_id``."""
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def run(batches):
        words = coder(path, spaced=False, ranks=True)
        size, end = words.dtype.itemsize, np.array([end_id], words.dtype).tobytes()
        for batch in batches:
            column = batch.column("text")
            if column.null_count:
                column = column.fill_null("")
            for s, e in slices(text_bytes(column)[1]):
                packed = [p + end for p in words.encode(column.slice(s, e - s).to_pylist())]
                total = np.array([len(p) // size for p in packed], np.int64)
                each = -(-total // capacity)
                doc = np.repeat(np.arange(e - s), each)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
                start = piece * capacity
                length = np.minimum(capacity, total[doc] - start)
                data = np.frombuffer(b"".join(packed), words.dtype).astype("<u4")
                offsets = np.concatenate(([0], np.cumsum(length) * 4)).astype(np.int64)
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(s, e - s).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(total[doc]), ids], names=_PIECES.names)

    return rows.mapInArrow(run, _PIECES)


def lower_bound(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> int:
    """The largest of the dual-feasible bounds on the bins that ``counts`` pieces of ``lengths`` (1 to capacity) need; whole numbers throughout."""
    x, c = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    if not len(x):
        return 0
    up = lambda total, unit: -(-int(total) // int(unit))
    best = up(x @ c, capacity)
    for k in range(1, 21):  # rounding down to k parts
        y = x * (k + 1)
        best = max(best, up(np.where(y % capacity == 0, x * k, y // capacity * capacity) @ c, k * capacity))
    for e in np.unique(x[2 * x <= capacity]):  # a new value at a length that occurs is all that can change the result
        threshold = np.where(x > capacity - e, capacity, np.where(x < e, 0, x))
        best = max(best, up(threshold @ c, capacity))
        fit = capacity // e
        share = np.where(2 * x > capacity, fit - (capacity - x) // e, np.where(x >= e, 1, 0))
        best = max(best, up(share @ c, fit))
    large = 2 * x > capacity
    return max(best, int(c[large].sum()))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: (bin of each piece, its offset there, room left in each bin). Open bins are stacked by room; one bit a stack tells which are not empty."""
    order = np.argsort(-lengths, kind="stable")
    place, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    stacks: dict[int, list[int]] = {}
    mask, bins = 0, 0
    room: list[int] = []
    for i in order.tolist():
        need = int(lengths[i])
        fits = mask >> need
        if fits:
            left = need + (fits & -fits).bit_length() - 1
            stack = stacks[left]
            b = stack.pop()
            if not stack:
                mask ^= 1 << left
        else:
            left, b = capacity, bins
            bins += 1
            room.append(capacity)
        place[i], offset[i] = b, capacity - left
        left -= need
        room[b] = left
        if left:
            stacks.setdefault(left, []).append(b)
            mask |= 1 << left
    return place, offset, np.array(room, np.int64)


def _place(items: DataFrame, parts: int, salt: int, capacity: int, name: str) -> DataFrame:
    """Items (pid, length) packed in ``parts`` partitions: (pid, length, bin, offset, room, gap, last); ``bin`` is the smallest pid in it, ``last`` marks its partition's emptiest bin."""

    def run(batches):
        got: dict[int, list] = {}
        for batch in batches:
            part = batch.column("part").to_numpy()
            for p in np.unique(part).tolist():
                at = np.flatnonzero(part == p)
                got.setdefault(p, []).append((batch.column("pid").to_numpy()[at], batch.column("length").to_numpy()[at]))
        for p in sorted(got):
            pid, length = (np.concatenate(x) for x in zip(*got.pop(p), strict=True))
            order = np.argsort(pid)
            pid, length = pid[order], length[order]
            place, offset, room = best_fit(length, capacity)
            name_of = np.full(len(room), np.iinfo(np.int64).max)
            np.minimum.at(name_of, place, pid)
            gap = len(room) - lower_bound(*np.unique(length, return_counts=True), capacity)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x) for x in (pid, length, name_of[place], offset, room[place], np.full(len(pid), gap), place == int(np.argmax(room)))],
                names=["pid", "length", "bin", "offset", "room", "gap", "last"],
            )

    dealt = items.withColumn("part", F.pmod(F.xxhash64("pid", F.lit(salt)), F.lit(parts)).cast("int")).repartitionById(parts, "part")
    return stored(dealt.mapInArrow(run, "pid long, length long, bin long, offset long, room long, gap long, last boolean"), name)


def pack(pieces: DataFrame, capacity: int = 4096, part_items: int = PART_ITEMS, rounds: int = ROUNDS) -> DataFrame:
    """``pieces`` with ``sequence_id``, ``offset`` and ``certified`` (whether the partition that packed the piece last met its lower bound); ``length`` is 1 to ``capacity``."""
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset", "certified")]
    base = stored(pieces.select(F.struct(*kept).alias("row"), F.col("length").cast("long").alias("length"), F.monotonically_increasing_id().alias("pid")), "bestfit-pieces")
    items = base.filter(F.col("length") < capacity).select("pid", "length")
    found = items.groupBy("length").count().collect()  # one row per length below the capacity
    lengths = np.array([r["length"] for r in found], np.int64)
    counts = np.array([r["count"] for r in found], np.int64)
    bound, left = lower_bound(lengths, counts, capacity), int(counts.sum()) if len(counts) else 0
    bins_of = lambda df: df.filter("pid = bin").count()
    now, settled = _place(items, max(1, -(-left // part_items)), 0, capacity, "bestfit-0"), None
    total = bins_of(now)
    for k in range(1, rounds + 1):
        if total <= bound:
            break
        open_ = "(gap > 0 and room > 0) or (last and room > 0)"
        given = now.filter(open_)
        before, left = bins_of(given), given.count()
        parts = max(1, -(-left // part_items))
        again = _place(given.select("pid", "length"), parts, k, capacity, f"bestfit-{k}")
        saved = before - bins_of(again)
        if saved < 0 or (saved == 0 and parts == 1):
            break
        rest = now.filter(f"not ({open_})")
        settled, now, total = rest if settled is None else settled.unionByName(rest), again, total - saved
    placed = now if settled is None else settled.unionByName(now)
    placed = placed.select("pid", F.col("bin").alias("sequence_id"), "offset", (F.col("gap") <= 0).alias("certified"))
    full = base.filter(F.col("length") >= capacity).select("row.*", F.col("pid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    joined = base.filter(F.col("length") < capacity).join(placed, "pid").select("row.*", "sequence_id", "offset", "certified")
    return joined.unionByName(full)
