"""Alignment of two tokenizers: which tokens cover the same bytes, how common each pair is in the corpus, and how usual a document's links are.

Every text is encoded by both tokenizers; byte positions where a token of each ends cut both sequences into groups, and all pairs of tokens of one group are links.

Inverted pair bitmaps: documents are numbered within blocks (at most ``BLOCK_DOCS`` documents and about ``BLOCK_POSTINGS`` postings). For every pair of ids a block keeps the set of
documents that hold it, as a compressed bitmap (a sorted array of 16-bit numbers, or plain bits where that is smaller), and bit planes with the multiplicity less one
of each of these documents. The texts of a block are OR-ed into the same bitmaps; blocks have no document in common, so the bits of a pair over all blocks are the popcounts'
sum, which Spark adds up. The counts then go back to the postings, and every block turns its bitmaps and planes into scores of its documents.

Skew: a pair has one row per block however many documents hold it; blocks are bounded; the highest count per id of the first tokenizer is broadcast, its rows are at most the vocabulary.
A text is cut at single spaces between other characters, where both tokenizers start anew; what a piece gives is remembered (``MEMO_BYTES`` a Python worker, then forgotten).

Defined results: null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros and empty groups. Strings of special tokens are
ordinary text. Repeated rows and rows without identifier are documents of their own; an empty table gives no rows. Other columns are not carried.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import slices, text_bytes
from quantloom.llm.pieces import _INNER_SPACE, load
from quantloom.llm.ranks import Ranks, token_bytes
from quantloom.session import scratch_path

BLOCK_DOCS, BLOCK_POSTINGS = 1 << 16, 2_000_000
MEMO_BYTES = 96 << 20
WIDE = 1 << 16  # groups with more links are reduced to distinct ids before pairs are made
_ALIGNERS: dict[tuple, Aligner] = {}

_DOC = ["pos", "doc_id", "n_a", "n_b", "n_groups", "n_links"]
_INDEX = T.StructType(
    [T.StructField("kind", T.StringType()), T.StructField("block", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in _DOC]
    + [T.StructField("groups", T.StringType()), T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]
    + [T.StructField("docs", T.BinaryType()), T.StructField("planes", T.BinaryType()), T.StructField("n_docs", T.LongType()), T.StructField("n_uses", T.LongType())]
)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range, one range after another."""
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


class Aligner:
    """Both tokenizers and what they give for pieces met so far: counts, the group text, and distinct pairs with their numbers."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = load(path_a)
        self.a.encode_special_tokens = True
        self.ranks = Ranks.of(path_a)
        if self.ranks:
            self.ranks.special = []
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = token_bytes(path_a)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(n[3:5], 16)]) if self.b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        #: Pieces of a text can stand alone if no token of the second tokenizer reaches over the start of a word.
        self.cuts = not any("▁" in n.lstrip("▁") for n in names)
        self.shift = int(len(names)).bit_length()
        most = max(len(self.bytes_a), len(names))
        self.written = [f"{i}{sep}" for sep in ",|;" for i in range(most)]
        self.most = most
        self.forget()

    def forget(self) -> None:
        self.memo: dict[str, int] = {}
        self.text: list[str] = []
        self.numbers = np.zeros((0, 4), np.int64)  # tokens of a, of b, groups, links; -1 where bytes are lost
        self.start = np.zeros(1, np.int64)
        self.codes, self.mult = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.held = 0

    def pieces(self, text: str) -> list[str]:
        if not text:
            return []
        return _INNER_SPACE.split(text) if self.cuts else [text]

    def _encode(self, todo: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        easy = [bool(self.ranks) and not p[0].isspace() and not p[-1].isspace() and self.ranks.simple(p) for p in todo]
        out: list = [None] * len(todo)
        quick = [i for i, e in enumerate(easy) if e]
        if quick:
            for i, ids in zip(quick, self.ranks.encode([todo[i] for i in quick], np.dtype("<u4")), strict=True):
                out[i] = np.frombuffer(ids, "<u4").tolist()
        slow = [i for i, e in enumerate(easy) if not e]
        if slow:
            for i, e in zip(slow, self.a.encode_batch_fast([" " + todo[i] for i in slow], add_special_tokens=False), strict=True):
                out[i] = e.ids
        return out, self.b.encode(todo, num_threads=1)

    def learn(self, todo: list[str]) -> None:
        """Align new pieces, all in one go."""
        ids_a, ids_b = self._encode(todo)
        whole = [(" " + p).encode() for p in todo]
        good = [b"".join([self.bytes_a[i] for i in x]) == w == b"".join([self.bytes_b[i] for i in y]) for x, y, w in zip(ids_a, ids_b, whole, strict=True)]
        keep = np.array(good, bool)
        a = np.array([i for x, g in zip(ids_a, good, strict=True) if g for i in x], np.int64)
        b = np.array([i for x, g in zip(ids_b, good, strict=True) if g for i in x], np.int64)
        ends = np.cumsum([len(w) for w, g in zip(whole, good, strict=True) if g] or [0])
        end_a, end_b = np.cumsum(self.sizes_a[a]), np.cumsum(self.sizes_b[b])
        common = np.intersect1d(end_a, end_b, assume_unique=True)
        of_a, of_b = np.searchsorted(common, end_a), np.searchsorted(common, end_b)
        n_a, n_b = np.bincount(of_a, minlength=len(common)), np.bincount(of_b, minlength=len(common))
        first_a, first_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        owner = np.searchsorted(ends, common)  # the kept piece of each group

        place_a, place_b = np.arange(len(a)) + first_b[of_a], np.arange(len(b)) + (first_a + n_a)[of_b]
        code = np.empty(len(a) + len(b), np.int64)
        code[place_a] = a + self.most * (np.arange(len(a)) == (first_a + n_a - 1)[of_a])
        code[place_b] = b + 2 * self.most * (np.arange(len(b)) == (first_b + n_b - 1)[of_b])
        parts = list(map(self.written.__getitem__, code.tolist()))
        tokens = np.bincount(owner, n_a + n_b, minlength=len(ends)).astype(np.int64) if len(common) else np.zeros(len(ends), np.int64)
        stop = np.cumsum(tokens).tolist()
        texts = iter(["".join(parts[s:e]) for s, e in zip([0, *stop], stop, strict=False)])

        small = n_a * n_b <= WIDE
        pick = small[of_a]
        each = n_b[of_a[pick]]
        left, right = np.repeat(a[pick], each), b[_ranges(first_b[of_a[pick]], each)]
        piece = np.repeat(owner[of_a[pick]], each)
        number = np.ones(len(left), np.int64)
        for g in np.flatnonzero(~small).tolist():
            x, nx = np.unique(a[first_a[g] : first_a[g] + n_a[g]], return_counts=True)
            y, ny = np.unique(b[first_b[g] : first_b[g] + n_b[g]], return_counts=True)
            left, right = np.concatenate((left, np.repeat(x, len(y)))), np.concatenate((right, np.tile(y, len(x))))
            piece, number = np.concatenate((piece, np.full(len(x) * len(y), owner[g]))), np.concatenate((number, np.outer(nx, ny).ravel()))
        pair = (left << self.shift) | right
        order = np.lexsort((pair, piece))
        piece, pair, number = piece[order], pair[order], number[order]
        new = np.ones(len(pair), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (pair[1:] != pair[:-1])
        at = np.flatnonzero(new)
        mult = np.add.reduceat(number, at) if len(at) else number
        per = np.bincount(piece[at], minlength=len(ends)) if len(at) else np.zeros(len(ends), np.int64)

        table = np.full((len(todo), 4), -1, np.int64)
        if keep.any():
            sums = [np.bincount(owner, w, minlength=len(ends)) for w in (n_a, n_b, np.ones(len(common)), n_a * n_b)]
            table[keep] = np.stack(sums, axis=1).astype(np.int64)
        sizes = np.zeros(len(todo), np.int64)
        sizes[keep] = per[: int(keep.sum())]
        base = len(self.text)
        self.text += [next(texts) if g else "" for g in good]
        self.memo.update(zip(todo, range(base, base + len(todo)), strict=True))
        self.numbers = np.concatenate((self.numbers, table))
        self.start = np.concatenate((self.start, self.start[-1] + np.cumsum(sizes)))
        self.codes, self.mult = np.concatenate((self.codes, pair[at])), np.concatenate((self.mult, mult))
        self.held += sum(len(w) for w in whole) + len(todo) * 260 + sum(map(len, parts)) + 16 * len(at)

    def align(self, texts: list[str | None]) -> tuple[np.ndarray, list[str], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(tokens of a, of b, groups, links) and the group text of each text; postings (text, pair, number) by text."""
        cut = [self.pieces(t or "") for t in texts]
        if self.held > MEMO_BYTES:
            self.forget()
        todo = list(set().union(*cut).difference(self.memo))
        if todo:
            self.learn(todo)
        get = self.memo.__getitem__
        index = [list(map(get, c)) for c in cut]
        size = np.array([len(c) for c in cut], np.int64)
        flat = np.fromiter((i for x in index for i in x), np.int64, int(size.sum()))
        doc = np.repeat(np.arange(len(texts)), size)
        lost = np.bincount(doc[self.numbers[flat, 0] < 0], minlength=len(texts)) > 0
        sums = np.stack([np.bincount(doc, self.numbers[flat, k], minlength=len(texts)) for k in range(4)], axis=1).astype(np.int64)
        sums[lost] = 0
        groups = ["" if bad or not x else "".join([self.text[i] for i in x])[:-1] for x, bad in zip(index, lost.tolist(), strict=True)]
        ok = ~lost[doc]
        both, times = np.unique((doc[ok] << 32) | flat[ok], return_counts=True)
        who, which = both >> 32, both & 0xFFFFFFFF
        many = self.start[which + 1] - self.start[which]
        at = _ranges(self.start[which], many)
        who, pair, number = np.repeat(who, many), self.codes[at], self.mult[at] * np.repeat(times, many)
        order = np.lexsort((pair, who))
        who, pair, number = who[order], pair[order], number[order]
        new = np.ones(len(pair), bool)
        new[1:] = (who[1:] != who[:-1]) | (pair[1:] != pair[:-1])
        first = np.flatnonzero(new)
        return sums, groups, (who[first], pair[first], np.add.reduceat(number, first) if len(first) else number)


def aligner(path_a: str, path_b: str) -> Aligner:
    key = (path_a, path_b)
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(path_a, path_b)
    return _ALIGNERS[key]


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def bitmaps(pair: np.ndarray, doc: np.ndarray, number: np.ndarray, n: int) -> tuple[np.ndarray, pa.Array, pa.Array, np.ndarray, np.ndarray]:
    """Inverted index of one block of ``n`` documents, from postings in order of documents: (pair, document bitmap, multiplicity planes, documents, links)."""
    order = np.argsort(pair, kind="stable")
    pair, doc, number = pair[order], doc[order], number[order]
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1]))) if len(pair) else np.zeros(0, np.int64)
    count = np.diff(np.concatenate((first, [len(pair)])))
    width = -(-n // 8)
    dense = 2 * count > width
    row, rank = np.repeat(np.arange(len(first)), count), _ranges(np.zeros(len(first), np.int64), count)
    sizes = np.where(dense, width, 2 * count)
    at = np.cumsum(sizes) - sizes
    data = np.zeros(int(sizes.sum()), np.uint8)
    d = dense[row]
    thin = at[row[~d]] + 2 * rank[~d]
    data[thin], data[thin + 1] = doc[~d] & 0xFF, doc[~d] >> 8
    np.bitwise_or.at(data, at[row[d]] + (doc[d] >> 3), (128 >> (doc[d] & 7)).astype(np.uint8))
    more = number - 1
    most = np.maximum.reduceat(more, first) if len(first) else more
    planes = np.zeros(len(first), np.int64)
    k = 0
    while (most >> k).any():
        planes += (most >> k) > 0
        k += 1
    wide = -(-count // 8)
    plane_sizes = planes * wide
    plane_at = np.cumsum(plane_sizes) - plane_sizes
    bits = np.zeros(int(plane_sizes.sum()) * 8, bool)
    for j in range(k):
        on = (more >> j) & 1 == 1
        bits[(plane_at[row[on]] + j * wide[row[on]]) * 8 + rank[on]] = True
    uses = np.add.reduceat(number, first) if len(first) else number
    return pair[first], _binary(data, sizes), _binary(np.packbits(bits), plane_sizes), count, uses


def postings(docs: pa.Array, planes: pa.Array, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, document, number) of every bit of the rows' bitmaps in a block of ``n`` documents."""
    raw, at = text_bytes(docs)
    width = -(-n // 8)
    dense = 2 * count > width
    thick = np.repeat(dense, np.diff(at))
    row_s = np.repeat(np.flatnonzero(~dense), count[~dense])
    doc_s = raw[~thick].view("<u2").astype(np.int64)
    row_d, doc_d = np.nonzero(np.unpackbits(raw[thick].reshape(-1, max(1, width)), axis=1)) if dense.any() else (np.zeros(0, np.int64),) * 2
    row_d = np.flatnonzero(dense)[row_d]
    row, doc = np.concatenate((row_s, row_d)), np.concatenate((doc_s, doc_d))
    before = np.zeros(len(count), np.int64)
    before[~dense] = np.cumsum(count[~dense]) - count[~dense]
    before[dense] = len(row_s) + np.cumsum(count[dense]) - count[dense]
    rank = np.arange(len(row)) - before[row]
    raw, at = text_bytes(planes)
    bits, wide = np.unpackbits(raw), -(-count // 8)
    have = np.diff(at) // np.maximum(1, wide)
    number = np.ones(len(row), np.int64)
    for k in range(int(have.max(initial=0))):
        on = have[row] > k
        number[on] += bits[(at[row[on]] + k * wide[row[on]]) * 8 + rank[on]].astype(np.int64) << k
    return row, doc, number


def index(docs: DataFrame, path_a: str, path_b: str, ident: str = "doc_id", text: str = "text", digest: bool = False, block_docs: int = BLOCK_DOCS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """The written index: rows of kind ``doc`` (block, pos, doc_id, n_a, n_b, n_groups, n_links, groups) and of kind ``pair`` (block, a, b, docs, planes, n_docs, n_uses).

    ``groups`` lists the ids as ``a1,a2|b1;a3|b2,b3``; with ``digest`` its SHA-256 in lowercase hex (empty without tokens), so that the long lists are not written.
    """
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = _INDEX.names
    types = [pa.string(), *[pa.int64()] * 7, pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]

    def shaped(n: int, kind: str, block: int, **have) -> pa.RecordBatch:
        have |= {"kind": pa.array([kind] * n, pa.string()), "block": pa.array(np.full(n, block))}
        return pa.RecordBatch.from_arrays([have[c].cast(t) if c in have else pa.nulls(n, t) for c, t in zip(names, types, strict=True)], names=names)

    def run(batches):
        both = aligner(path_a, path_b)
        block, filled = TaskContext.get().partitionId() << 24, 0
        held: list[tuple] = []

        def flush():
            pair, doc, number = (np.concatenate(x) for x in zip(*held, strict=True)) if held else (np.zeros(0, np.int64),) * 3
            held.clear()
            if len(pair):
                code, bits, planes, count, uses = bitmaps(pair, doc, number, filled)
                for s in range(0, len(code), 50_000):
                    e = min(len(code), s + 50_000)
                    ids = {"a": pa.array((code[s:e] >> both.shift).astype(np.int32)), "b": pa.array((code[s:e] & ((1 << both.shift) - 1)).astype(np.int32))}
                    yield shaped(e - s, "pair", block, docs=bits[s:e], planes=planes[s:e], n_docs=pa.array(count[s:e]), n_uses=pa.array(uses[s:e]), **ids)

        for batch in batches:
            column = batch.column("text")
            for s, e in slices(text_bytes(column)[1]):
                if filled and (filled + e - s > block_docs or sum(len(x[0]) for x in held) > block_postings):
                    yield from flush()
                    block, filled = block + 1, 0
                for s2 in range(s, e, block_docs):  # a slice of many short texts can exceed a small block
                    e2 = min(e, s2 + block_docs)
                    if filled + e2 - s2 > block_docs:
                        yield from flush()
                        block, filled = block + 1, 0
                    sums, groups, (who, pair, number) = both.align(column.slice(s2, e2 - s2).to_pylist())
                    if digest:
                        groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
                    held.append((pair, who + filled, number))
                    numbers = dict(zip(_DOC[2:], map(pa.array, sums.T), strict=True))
                    yield shaped(e2 - s2, "doc", block, pos=pa.array(np.arange(filled, filled + e2 - s2)), doc_id=batch.column("doc_id").slice(s2, e2 - s2), groups=pa.array(groups, pa.string()), **numbers)
                    filled += e2 - s2
        yield from flush()

    spark = docs.sparkSession
    path = scratch_path(spark, "align-index")
    rows.mapInArrow(run, _INDEX).write.partitionBy("kind").parquet(path)
    return spark.read.schema(_INDEX).parquet(path)


def pair_counts(made: DataFrame) -> DataFrame:
    """(a, b, n_docs, n_uses, best): documents and links of every pair in the corpus, and whether no pair of the same ``a`` is in more documents."""
    pairs = made.filter("kind = 'pair'").groupBy("a", "b").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_uses").alias("n_uses"))
    top = pairs.groupBy("a").agg(F.max("n_docs").alias("top"))
    return pairs.join(F.broadcast(top), "a").select("a", "b", "n_docs", "n_uses", (F.col("n_docs") == F.col("top")).alias("best"))  # at most one row per id


_SCORED = T.StructType([T.StructField(c, T.LongType()) for c in (*_DOC[1:], "n_best", "count_sum")] + [T.StructField("groups", T.StringType())])


def scores(made: DataFrame) -> DataFrame:
    """One row per document: (doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)."""
    pairs = pair_counts(made).select("a", "b", F.col("n_docs").alias("corpus"), "best")
    bits = made.filter("kind = 'pair'").select("block", "a", "b", "docs", "planes", "n_docs").join(pairs, ["a", "b"]).drop("a", "b")
    docs = made.filter("kind = 'doc'").select(F.col("block").alias("own"), *_DOC, "groups")

    def settle(docs: pa.Table, bits: pa.Table) -> pa.Table:
        n = docs.num_rows
        best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
        if bits.num_rows:
            row, doc, number = postings(bits.column("docs"), bits.column("planes"), bits.column("n_docs").to_numpy(), n)
            np.add.at(total, doc, number * bits.column("corpus").to_numpy()[row])
            np.add.at(best, doc, number * bits.column("best").to_numpy().astype(np.int64)[row])
        pos = docs.column("pos").to_numpy()
        out = [docs.column(c) for c in _DOC[1:]] + [pa.array(best[pos]), pa.array(total[pos]), docs.column("groups")]
        return pa.Table.from_arrays(out, names=_SCORED.names)

    return docs.groupBy("own").cogroup(bits.groupBy("block")).applyInArrow(settle, _SCORED)
