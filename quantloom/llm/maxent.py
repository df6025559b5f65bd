"""Language-model scores of a hashed maximum-entropy model.

log P(word | history) = log P(class | history) + log P(word | class). Classes group words by frequency (the most frequent have one each). P(class | history) is
a softmax over hashed features of the history: the last word, the second and third last as skip features, and the last two together. P(word | class) is the
word's smoothed share of its class, so the model is a proper distribution over all words, unknown ones included.

* Counts: every training word, exactly, packed by bucket of the hash range. Words above total / 2**20 (so at most 2**20 of them) form the head, which travels to
  the tasks; the others are looked up bucket by bucket in one shuffle, so no table of all words ever has to fit anywhere.
* Training: each round covers its own part of the training documents; all rounds together cover every one of them. Tasks sum the gradient (observed minus expected feature
  counts) and its curvature over their texts; the sums, of fixed size, are added up in two levels, and one scaled gradient step follows.
* Scoring: sparse batches; rows of the weight tables are gathered and added, a softmax over the classes follows.

Defined results: null text is empty and has one token, the end; without training documents every score is 0-based on the smoothing alone; rows are scored one by
one, so repeated rows score alike; texts of any length are scored whole. Scores are log10.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import mix, slices, stored, text_bytes
from quantloom.llm.words import word_hashes

CLASSES, SINGLE = 32, 16
WORD_ROWS, PAIR_ROWS, RANKED = 4096, 8192, 3072
ROWS = 3 * WORD_ROWS + PAIR_ROWS
HEAD = 1 << 20
ROUNDS, SMOOTH, STEP_LIMIT = 3, 100.0, 1.0
END = np.uint64(0x5EED0E4D)
BUCKET_BYTES = 32 << 20
FLUSH = 3_000_000
_SLOTS = 1 << 22
_GROUP = "g int, a binary, b binary, c binary"


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(token hashes with an END after each text, tokens before each text: one more than texts)."""
    h, at = word_hashes(raw, offsets)
    n = len(offsets) - 1
    begin = at + np.arange(n + 1)
    out = np.full(len(h) + n, END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(n), np.diff(at))] = h
    return out, begin


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def _sums(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    u, inv = np.unique(keys, return_inverse=True)
    return u, np.bincount(inv, weights=weights, minlength=len(u)).astype(np.int64)


def _empty(schema: str) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    return pa.table({f.split()[0]: pa.array([], kinds[f.split()[1]]) for f in schema.split(", ")})


def count_words(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, words, counts) packed; one row a bucket, words ascending."""

    def run(batches):
        def flush():
            u, n = _sums(np.concatenate(keys), np.concatenate(counts))
            b = _bucket(u, buckets)
            order = np.argsort(b, kind="stable")
            ends = np.searchsorted(b[order], np.arange(buckets + 1))
            u, n = u[order], n[order]
            use = [k for k in range(buckets) if ends[k] < ends[k + 1]]
            cut = lambda x, k: x[ends[k] : ends[k + 1]].tobytes()
            return pa.RecordBatch.from_arrays([pa.array(use, pa.int32()), pa.array([cut(u, k) for k in use], pa.binary()), pa.array([cut(n, k) for k in use], pa.binary())], names=["bucket", "words", "counts"])

        keys: list = []
        counts: list = []
        held = 0
        for batch in batches:
            raw, offs = text_bytes(batch.column("text"))
            for s, e in slices(offs):
                t, _ = tokens(raw[offs[s] : offs[e]], offs[s : e + 1] - offs[s])
                u, n = np.unique(t, return_counts=True)
                keys.append(u)
                counts.append(n)
                held += len(u)
                if held >= FLUSH:
                    yield flush()
                    keys, counts, held = [], [], 0
        if keys:
            yield flush()

    def merge(t: pa.Table) -> pa.Table:
        u, n = _sums(np.concatenate([np.frombuffer(x, np.uint64) for x in t.column("words").to_pylist()]), np.concatenate([np.frombuffer(x, np.int64) for x in t.column("counts").to_pylist()]))
        return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()], pa.int32()), "words": pa.array([u.tobytes()], pa.binary()), "counts": pa.array([n.tobytes()], pa.binary()), "total": pa.array([int(n.sum())]), "distinct": pa.array([len(u)])})

    schema = "bucket int, words binary, counts binary"
    return rows.mapInArrow(run, schema).groupBy("bucket").applyInArrow(merge, schema + ", total long, distinct long")


@dataclass
class Lexicon:
    """The head of the vocabulary with counts and classes, and what normalises all words."""

    words: np.ndarray  # ascending hashes
    counts: np.ndarray
    rank: np.ndarray  # by frequency
    kind: np.ndarray  # class of each head word; all others have the last class
    total: int
    distinct: int
    mass: np.ndarray  # smoothed count of each class
    slots: np.ndarray | None = None

    def __getstate__(self):
        return {**self.__dict__, "slots": None}

    @property
    def norm(self) -> float:
        return self.total + 0.5 * (self.distinct + 1)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash in the head, -1 for the others."""
        if not len(self.words):
            return np.full(len(h), -1, np.int32)
        if self.slots is None:
            self.slots = np.full(_SLOTS, -1, np.int32)
            order = np.argsort(-self.rank)  # the most frequent word of a slot is written last
            self.slots[(self.words[order] & np.uint64(_SLOTS - 1)).astype(np.int64)] = order
        at = self.slots[(h & np.uint64(_SLOTS - 1)).astype(np.int64)]
        off = np.flatnonzero((at >= 0) & (self.words[at] != h))
        if len(off):
            spot = np.minimum(np.searchsorted(self.words, h[off]), len(self.words) - 1)
            at[off] = np.where(self.words[spot] == h[off], spot, -1)
        return at


def lexicon(counted: DataFrame) -> Lexicon:
    """Totals over all buckets and the head words."""
    seen = counted.agg(F.sum("total").alias("n"), F.sum("distinct").alias("v")).first()  # one row
    total, distinct = int(seen["n"] or 0), int(seen["v"] or 0)
    least = max(1, -(-total // HEAD))

    def head(batches):
        for batch in batches:
            for w, c in zip(batch.column("words").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                w, c = np.frombuffer(w, np.uint64), np.frombuffer(c, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([w[c >= least].tobytes()], pa.binary()), pa.array([c[c >= least].tobytes()], pa.binary())], names=["w", "c"])

    rows = counted.select("words", "counts").mapInArrow(head, "w binary, c binary").collect()  # at most HEAD words in all
    words = np.concatenate([np.zeros(0, np.uint64)] + [np.frombuffer(bytes(r["w"]), np.uint64) for r in rows])
    counts = np.concatenate([np.zeros(0, np.int64)] + [np.frombuffer(bytes(r["c"]), np.int64) for r in rows])
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    order = np.lexsort((words, -counts))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    share = np.cumsum(np.where(np.arange(len(words)) < SINGLE, 0, counts[order]))
    bins = CLASSES - 1 - SINGLE
    kind = np.empty(len(words), np.int64)
    kind[order] = np.where(np.arange(len(words)) < SINGLE, np.arange(len(words)), SINGLE + np.minimum(bins - 1, share * bins // max(1, int(share[-1]) + 1 if len(share) else 1)))
    mass = np.bincount(kind, weights=counts + 0.5, minlength=CLASSES).astype(float)
    mass[-1] += (total - counts.sum()) + 0.5 * (distinct - len(words) + 1)
    return Lexicon(words, counts, rank, kind, total, distinct, mass)


def features(lex: Lexicon, h: np.ndarray, at: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """Table rows of the four feature kinds for each token's history."""
    ranks = np.where(at >= 0, lex.rank[at], RANKED) if len(lex.words) else np.full(len(h), RANKED)
    word = np.where(ranks < RANKED, ranks, RANKED + (h & np.uint64(WORD_ROWS - RANKED - 2)).astype(np.int64))
    first = np.zeros(len(h), np.int64)
    first[begin[:-1]] = 1
    place = np.arange(len(h)) - np.repeat(begin[:-1], np.diff(begin))
    out = []
    last: list[np.ndarray] = []
    for k in (1, 2, 3):
        w = np.full(len(h), WORD_ROWS - 1, np.int64)  # before the text
        inside = place >= k
        w[inside] = word[np.flatnonzero(inside) - k]
        last.append(w)
        out.append((k - 1) * WORD_ROWS + w)
    pair = mix((last[0] * WORD_ROWS + last[1]).astype(np.uint64)) & np.uint64(PAIR_ROWS - 1)
    out.append(3 * WORD_ROWS + pair.astype(np.int64))
    return out


def log_classes(weights: np.ndarray, bias: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
    """log P(class | history), tokens x classes."""
    z = weights[rows[0]]
    for r in rows[1:]:
        z += weights[r]
    z += bias
    z -= z.max(axis=1, keepdims=True)
    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
    return z


def _kinds(lex: Lexicon, at: np.ndarray) -> np.ndarray:
    return np.where(at >= 0, lex.kind[at], CLASSES - 1) if len(lex.words) else np.full(len(at), CLASSES - 1)


def _gradient(rows: DataFrame, lex, model) -> np.ndarray:
    """(observed, expected) counts of feature row x class over all texts of ``rows``: arrays of fixed size, added up in two levels."""
    blocks = 16

    def run(batches):
        lexi, (weights, bias) = lex.value, model.value
        seen, hoped = np.zeros(ROWS * CLASSES), np.zeros((CLASSES, ROWS))
        any_text = False
        for batch in batches:
            raw, offs = text_bytes(batch.column("text"))
            for s, e in slices(offs):
                h, begin = tokens(raw[offs[s] : offs[e]], offs[s : e + 1] - offs[s])
                at = lexi.find(h)
                kind = _kinds(lexi, at)
                f = features(lexi, h, at, begin)
                any_text = True
                for r in f:
                    seen += np.bincount(r * CLASSES + kind, minlength=ROWS * CLASSES)
                if weights is None:
                    continue
                p = np.exp(log_classes(weights, bias, f)).T.copy()
                for r in f:
                    low = int(r.min()) // WORD_ROWS * WORD_ROWS
                    size = PAIR_ROWS if low >= 3 * WORD_ROWS else WORD_ROWS
                    low = min(low, 3 * WORD_ROWS)
                    for c in range(CLASSES):
                        hoped[c, low : low + size] += np.bincount(r - low, weights=p[c], minlength=size)
        if any_text:
            if weights is None:
                hoped = np.outer(np.exp(bias), seen.reshape(ROWS, CLASSES).sum(axis=1))
            both = np.concatenate([seen, hoped.T.ravel()]).astype(np.float32).reshape(blocks, -1)
            salt = TaskContext.get().partitionId() % 32
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)), pa.array(np.full(blocks, salt, np.int32)), pa.array([b.tobytes() for b in both], pa.binary())], names=["block", "salt", "data"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float32).astype(np.float64) for x in t.column("data").to_pylist())
        return pa.table({"block": t.column("block")[:1], "salt": pa.array([0], pa.int32()), "data": pa.array([total.astype(np.float32).tobytes()], pa.binary())})

    schema = "block int, salt int, data binary"
    parts = rows.mapInArrow(run, schema).groupBy("block", "salt").applyInArrow(add, schema).groupBy("block").applyInArrow(add, schema).collect()  # fixed size
    if not parts:
        return np.zeros((2, ROWS, CLASSES))
    flat = np.concatenate([np.frombuffer(bytes(r["data"]), np.float32) for r in sorted(parts, key=lambda r: r["block"])])
    return flat.reshape(2, ROWS, CLASSES).astype(np.float64)


def train(rows: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias). ``rows``: (text, part) with part spreading the documents over the rounds."""
    context = rows.sparkSession.sparkContext
    bias = np.log(np.maximum(lex.mass, 1e-9) / lex.mass.sum())
    weights = None
    shared = context.broadcast(lex)
    for k in range(rounds):
        model = context.broadcast((None if weights is None else weights.astype(np.float32), bias.astype(np.float32)))
        seen, hoped = _gradient(rows.filter(F.pmod("part", F.lit(rounds)) == k).select("text"), shared, model)
        prior = SMOOTH * np.exp(bias)
        if weights is None:  # a first step from zero, in closed form
            weights = 0.4 * np.log((seen + prior) / (hoped + prior))
        else:
            weights += np.clip((seen - hoped) / (4 * (hoped + prior)), -STEP_LIMIT, STEP_LIMIT)
        model.unpersist()
    return weights.astype(np.float32), bias.astype(np.float32)


def _score_head(rows: DataFrame, shared, buckets: int) -> DataFrame:
    """Packed by bucket: words outside the head (a: hashes, b: row keys), and documents (c: key, id, held out, tokens, known, base, gain)."""

    def run(batches):
        lex, weights, bias = shared.value
        logs = np.log10(lex.counts + 0.5)
        gain_of = np.log10(np.maximum(lex.mass, 1e-300) / lex.norm)
        key = TaskContext.get().partitionId() << 36
        tails: list = []
        owners: list = []
        docs: list = []
        held = 0

        def flush():
            h, own = np.concatenate([np.zeros(0, np.uint64), *tails]), np.concatenate([np.zeros(0, np.int64), *owners])
            b = _bucket(h, buckets)
            order = np.argsort(b, kind="stable")
            ends = np.searchsorted(b[order], np.arange(buckets + 1))
            h, own = h[order], own[order]
            mine = np.concatenate(docs)
            cols: list[list] = [[], [], [], []]
            for k in range(buckets):
                d = mine[k::buckets]
                if ends[k] < ends[k + 1] or len(d):
                    for c, v in zip(cols, (k, h[ends[k] : ends[k + 1]].tobytes(), own[ends[k] : ends[k + 1]].tobytes(), d.tobytes()), strict=True):
                        c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32())] + [pa.array(c, pa.binary()) for c in cols[1:]], names=["g", "a", "b", "c"])

        for batch in batches:
            raw, offs = text_bytes(batch.column("text"))
            ids, out = batch.column("doc_id").fill_null(0).to_numpy(), batch.column("held_out").to_numpy(zero_copy_only=False)
            valid = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            for s, e in slices(offs):
                h, begin = tokens(raw[offs[s] : offs[e]], offs[s : e + 1] - offs[s])
                at = lex.find(h)
                known = at >= 0
                per = lambda x: np.add.reduceat(x, begin[:-1])  # noqa: B023, E731
                base = per(np.where(known, logs[at] if len(logs) else 0.0, 0.0))
                gain = np.zeros(e - s)
                if weights is not None:
                    kind = _kinds(lex, at)
                    z = log_classes(weights, bias, features(lex, h, at, begin))
                    gain = per(z[np.arange(len(h)), kind] / np.log(10) - gain_of[kind])
                keys = key + np.arange(e - s)
                key += e - s
                own = np.repeat(keys, np.diff(begin))
                tails.append(h[~known])
                owners.append(own[~known])
                d = np.zeros(e - s, [("key", "i8"), ("id", "i8"), ("valid", "?"), ("out", "?"), ("n", "i8"), ("known", "i8"), ("base", "f8"), ("gain", "f8")])
                for name, v in (("key", keys), ("id", ids[s:e]), ("valid", valid[s:e]), ("out", out[s:e]), ("n", np.diff(begin)), ("known", per(known.astype(np.int64))), ("base", base), ("gain", gain)):
                    d[name] = v
                docs.append(d)
                held += len(tails[-1]) + e - s
                if held >= FLUSH:
                    yield flush()
                    tails, owners, docs, held = [], [], [], 0
        if docs:
            yield flush()

    return rows.mapInArrow(run, _GROUP)


DOC = np.dtype([("key", "i8"), ("id", "i8"), ("valid", "?"), ("out", "?"), ("n", "i8"), ("known", "i8"), ("base", "f8"), ("gain", "f8")])
PART = np.dtype([("key", "i8"), ("known", "i8"), ("base", "f8")])


def _look_up(tails: DataFrame, counted: DataFrame, groups: int) -> DataFrame:
    """Counts of the words outside the head, summed per document and packed by group of documents (a: parts, c: documents)."""

    def look(x: pa.Table, y: pa.Table) -> pa.Table:
        if not x.num_rows:
            return _empty(_GROUP)
        h = np.concatenate([np.frombuffer(v, np.uint64) for v in x.column("a").to_pylist()])
        own = np.concatenate([np.frombuffer(v, np.int64) for v in x.column("b").to_pylist()])
        docs = np.concatenate([np.frombuffer(v, DOC) for v in x.column("c").to_pylist()])
        count = np.zeros(len(h))
        if y.num_rows:
            words, counts = np.frombuffer(y.column("words")[0].as_py(), np.uint64), np.frombuffer(y.column("counts")[0].as_py(), np.int64)
            spot = np.minimum(np.searchsorted(words, h), len(words) - 1)
            count = np.where(words[spot] == h, counts[spot], 0)
        u, inv = np.unique(own, return_inverse=True)
        part = np.zeros(len(u), PART)
        part["key"] = u
        part["known"] = np.bincount(inv, weights=count > 0, minlength=len(u))
        part["base"] = np.bincount(inv, weights=np.log10(count + 0.5), minlength=len(u))
        rows = []
        for g in range(groups):
            p, d = part[_group(part["key"], groups) == g], docs[_group(docs["key"], groups) == g]
            if len(p) or len(d):
                rows.append((g, p.tobytes(), b"", d.tobytes()))
        return pa.Table.from_arrays([pa.array([r[0] for r in rows], pa.int32())] + [pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3)], names=["g", "a", "b", "c"])

    return tails.groupBy("g").cogroup(counted.groupBy("bucket")).applyInArrow(look, _GROUP)


def _group(key: np.ndarray, groups: int) -> np.ndarray:
    return (mix(key.astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def score(docs: DataFrame, learn: Column, held_out: Column, ident: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row; ``learn`` marks the training rows."""
    spark = docs.sparkSession
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"), learn.alias("learn"), held_out.alias("held_out"), F.pmod(F.xxhash64(ident), F.lit(1 << 20)).alias("part"))
    volume = int(rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0)  # one row
    buckets = max(1, -(-volume // BUCKET_BYTES))
    teach = rows.filter("learn").select("text", "part")
    counted = stored(count_words(teach.select("text"), buckets), "maxent-counts")
    lex = lexicon(counted)
    weights, bias = train(teach, lex, rounds) if lex.total else (None, None)
    shared = spark.sparkContext.broadcast((lex, weights, bias))  # at most HEAD words and tables of fixed size
    found = _look_up(_score_head(rows.select("doc_id", "text", "held_out"), shared, buckets), counted.select("bucket", "words", "counts"), buckets)
    total, norm = lex.total, float(np.log10(lex.norm))
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def whole(t: pa.Table) -> pa.Table:
        d = np.concatenate([np.frombuffer(v, DOC) for v in t.column("c").to_pylist()])
        p = np.concatenate([np.frombuffer(v, PART) for v in t.column("a").to_pylist()])
        d = d[np.argsort(d["key"])]
        at = np.searchsorted(d["key"], p["key"])
        known = d["known"] + np.bincount(at, weights=p["known"], minlength=len(d)).astype(np.int64)
        base = d["base"] + np.bincount(at, weights=p["base"], minlength=len(d)) - d["n"] * norm
        cols = [pa.array(d["id"], mask=~d["valid"]), pa.array(d["out"]), pa.array(d["n"]), pa.array(known), pa.array(np.full(len(d), total)), pa.array(base), pa.array(base + d["gain"])]
        return pa.Table.from_arrays(cols, names=[f.split()[0] for f in out.split(", ")])

    return found.groupBy("g").applyInArrow(whole, out)
