"""Best-fit packing, tokenizer alignment and importance resampling beside brute force: nulls, empty and very long texts, ties, repeated rows, empty tables, clashing columns."""

import hashlib
import math
import re
import zlib
from bisect import bisect_right
from collections import Counter, defaultdict
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from quantloom.llm import align, bestfit, bpe, pieces, ranks, resample

WORD_BPE, BYTE_BPE, PIECES = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, rank int, bin int, line string, kind string, sequence_id string"


def texts():
    rng = np.random.default_rng(11)
    words = "The quick brown fox jumped, naïvely; over 12 lazy dogs' élan don't we've x1y2 Straße ŒUVRE — “quoted” 100% e-mail@example.org".split()
    odd = [None, "", " ", "   \n ", "\n\n", "a", " lead and trail ", "two  spaces\tand\ttabs \n newline", "<|endoftext|> plain <|startoftext|> <s> </s>", "▁under score", "日本語のテキスト and русский текст", "é café İstanbul ſ ǅ"]
    odd += ["aaaaaaaaaaaaaaaaaaaaaaaaa" * 40, "​ zero width   sep", "emoji 🙂🙃 mix", "nul \0 byte", "=" * 900, "é" * 500 + " ́x"]
    odd += [" ".join(rng.choice(words, 40)) for _ in range(25)] + ["\n".join(" ".join(rng.choice(words, 8)) for _ in range(6)) for _ in range(12)]
    odd += ["shared line of seven plain words here\n" + " ".join(rng.choice(words, 25)) for _ in range(20)]
    return odd + [odd[20]] * 30 + [" ".join(rng.choice(words, 9000)), "word " * 300_000]


ROWS = [(None if i == 25 else i - (i == 30), t, 1, 2, "x", "doc", "s") for i, t in enumerate(texts())]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(5).cache()


def test_rank_encoder_gives_the_ids_of_the_library():
    for path, spaced in ((WORD_BPE, False), (BYTE_BPE, True)):
        plain, quick = pieces.load(path), pieces.PieceCoder(path, spaced, ranks=True)
        assert quick.ranks is not None
        all_texts = [t or "" for t in texts()]
        want = [np.array(plain.encode(t, add_special_tokens=False).ids, quick.dtype).tobytes() for t in all_texts]
        assert quick.encode(all_texts) == want and quick.encode(all_texts[::-1]) == want[::-1]
    assert not ranks.Ranks.of(BYTE_BPE).simple("a <|endoftext|>") and not ranks.Ranks.of(BYTE_BPE).simple("日本")


def cut_by_library(capacity):
    t = Tokenizer.from_file(WORD_BPE)
    t.no_truncation()
    out = Counter()
    for doc_id, text, *_ in ROWS:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for k, s in enumerate(range(0, len(ids), capacity)):
            part = ids[s : s + capacity]
            out[doc_id, k, s, len(part), len(ids), np.array(part, "<u4").tobytes()] += 1
    return out


def check_layout(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_best_fit(spark, docs):
    capacity = 512
    made = bestfit.cut(docs, WORD_BPE, capacity)
    rows = bestfit.pack(made, capacity, part_items=20).collect()  # several partitions
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.doc_tokens, bytes(r.ids)) for r in rows) == cut_by_library(capacity)
    bins = check_layout(rows, capacity)
    lengths, counts = np.unique([r.length for r in rows], return_counts=True)
    bound = bestfit.lower_bound(lengths, counts, capacity)
    assert bound <= bins <= bound + 1
    assert bestfit.pack(bestfit.cut(docs.limit(0), WORD_BPE, capacity), capacity).count() == 0


def test_partitions_with_gaps_exchange_documents(spark):
    """Every partition alone ends with a bin that is nearly empty; together they need fewer."""
    rng = np.random.default_rng(2)
    rows = [(i, int(x), "mine") for i, x in enumerate(rng.integers(1, 60, 4000))] + [(9000 + i, 100, "full") for i in range(7)]
    df = spark.createDataFrame(rows, "doc_id long, length long, certified string")
    alone = check_layout(bestfit.pack(df, 100, part_items=80, rounds=0).collect(), 100)
    got = bestfit.pack(df, 100, part_items=80).collect()
    together = check_layout(got, 100)
    assert sorted((r.doc_id, r.length) for r in got) == sorted((i, n) for i, n, _ in rows)
    bound = bestfit.lower_bound(*np.unique([n for _, n, _ in rows], return_counts=True), 100)
    assert bound <= together <= bound * 1.01 and together <= alone - 20 and isinstance(got[0].certified, bool)


def fewest(lengths, capacity):
    """Bins of an optimal packing, by trying everything."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= lengths[i]:
                k = rooms.index(r)
                go(i + 1, rooms[:k] + [r - lengths[i]] + rooms[k + 1 :])
        go(i + 1, [*rooms, capacity - lengths[i]])

    go(0, [])
    return best[0]


def test_bounds_never_exceed_the_optimum():
    rng = np.random.default_rng(8)
    sharp = 0
    for _ in range(150):
        x = rng.integers(1, 31, rng.integers(1, 9))
        bound, best = bestfit.lower_bound(*np.unique(x, return_counts=True), 30), fewest(x.tolist(), 30)
        place, offset, room = bestfit.best_fit(x, 30)
        assert bound <= best <= len(room)
        assert all(x[place == b].sum() + room[b] == 30 for b in range(len(room))) and (offset + x <= 30).all()
        sharp += bound == best
    assert sharp > 130
    assert bestfit.lower_bound(np.array([16]), np.array([9]), 30) == 9  # over half each
    assert bestfit.lower_bound(np.array([11]), np.array([5]), 30) == 3  # two a bin, by size alone two bins


def aligned(text, a, b, bytes_a, bytes_b):
    """Groups of (ids of a, ids of b), or none where bytes are lost."""
    if not text:
        return []
    x, y = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    if b"".join(bytes_a[i] for i in x) != (" " + text).encode() or b"".join(bytes_b[i] for i in y) != (" " + text).encode():
        return []
    ends = []
    for ids, size in ((x, bytes_a), (y, bytes_b)):
        at, here = 0, []
        for i in ids:
            at += len(size[i])
            here.append(at)
        ends.append(here)
    common = [0, *sorted(set(ends[0]) & set(ends[1]))]
    return [tuple(ids[bisect_right(at, s) : bisect_right(at, t)] for ids, at in ((x, ends[0]), (y, ends[1]))) for s, t in pairwise(common)]


@pytest.mark.parametrize("sizes", [{}, {"block_docs": 7, "block_postings": 300}])
def test_alignment(spark, docs, sizes):
    a = Tokenizer.from_file(BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    bytes_a = ranks.token_bytes(BYTE_BPE)
    bytes_b = [bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(b.id_to_piece(list(range(b.get_piece_size()))))]
    short = [r for r in ROWS if r[1] is None or len(r[1]) < 100_000]
    known, counts = [], Counter()
    for doc_id, text, *_ in short:
        groups = aligned(text, a, b, bytes_a, bytes_b)
        links = Counter((x, y) for p, q in groups for x in p for y in q)
        counts.update(set(links))
        known.append((doc_id, groups, links))
    top = Counter()
    for (x, _), n in counts.items():
        top[x] = max(top[x], n)
    want = Counter()
    for doc_id, groups, links in known:
        listed = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        best = sum(n for p, n in links.items() if counts[p] == top[p[0]])
        row = (doc_id, sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), links.total(), best, sum(n * counts[p] for p, n in links.items()), listed)
        want[row] += 1
    few = docs.filter("text is null or length(text) < 100000")
    made = align.index(few, BYTE_BPE, PIECES, **sizes)
    got = align.scores(made).collect()
    assert Counter(tuple(r) for r in got) == want
    uses = Counter()
    for _, _, links in known:
        uses.update(links)
    assert {((r.a, r.b), r.n_docs, r.n_uses, r.best) for r in align.pair_counts(made).collect()} == {(p, n, uses[p], n == top[p[0]]) for p, n in counts.items()}
    if not sizes:
        hashed = {(r.doc_id, r.groups) for r in align.scores(align.index(few, BYTE_BPE, PIECES, digest=True)).collect()}
        assert hashed == {(r[0], hashlib.sha256(r[-1].encode()).hexdigest() if r[-1] else "") for r in want}
        assert align.scores(align.index(docs.limit(0), BYTE_BPE, PIECES)).count() == 0


def test_bitmaps_and_planes_give_their_postings_back():
    rng = np.random.default_rng(4)
    n = 1000
    pair = np.concatenate((np.full(900, 3), np.full(5, 7), rng.integers(10, 400, 3000)))
    doc = np.concatenate((np.arange(900), [1, 5, 9, 700, 999], rng.integers(0, n, 3000)))
    both = np.unique(np.stack((doc, pair), 1), axis=0)
    doc, pair = both[:, 0], both[:, 1]
    number = rng.integers(1, 40, len(doc)) * rng.integers(0, 2, len(doc)) + 1
    code, bits, planes, count, uses = align.bitmaps(pair, doc, number, n)
    row, d, m = align.postings(bits, planes, count, n)
    assert sorted(zip(code[row], d, m, strict=True)) == sorted(zip(pair, doc, number, strict=True))
    assert bits.nbytes < 2 * len(doc) + 9 * len(code) and dict(zip(code, uses, strict=True)) == {p: number[pair == p].sum() for p in code}


def test_pathological_groups_are_reduced_to_distinct_ids(monkeypatch):
    monkeypatch.setattr(align, "WIDE", 1)
    one = align.Aligner(BYTE_BPE, PIECES)
    monkeypatch.setattr(align, "WIDE", 1 << 16)
    two = align.Aligner(BYTE_BPE, PIECES)
    text = [t for t in texts() if t and len(t) < 2000]
    monkeypatch.setattr(align, "WIDE", 1)
    x = one.align(text)
    monkeypatch.setattr(align, "WIDE", 1 << 16)
    y = two.align(text)
    assert x[1] == y[1] and (x[0] == y[0]).all() and all((p == q).all() for p, q in zip(x[2], y[2], strict=True))


def resampled(rows, target, n_min, n_max, buckets, percent, least, seed=2024):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(UP))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(n_min, n_max + 1) for i in range(len(w) - n + 1)]

    s, t = np.zeros(buckets), np.zeros(buckets)
    for texts_, into in (([r[1] for r in rows], s), (target, t)):
        for x in texts_:
            for f in features(x)[1]:
                into[f] += 1
    gain = [math.floor(1000 * math.log((t[i] + 1) * (s.sum() + buckets) / ((s[i] + 1) * (t.sum() + buckets)))) for i in range(buckets)]
    out = []
    for doc_id, text, *_ in rows:
        w, f = features(text)
        weight = sum(gain[x] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least])
    fit = sorted((x for x in out if x[4]), key=lambda x: (-x[3], math.inf if x[0] is None else x[0], x[1], x[2]))
    drawn = fit[: percent * len(fit) // 100]
    left = Counter(map(tuple, out)) - Counter(map(tuple, drawn))
    return Counter([(*x[:4], k + 1) for k, x in enumerate(drawn)]) + Counter({(*x[:4], None): n for x, n in left.items()})


@pytest.mark.parametrize(("n_min", "n_max", "buckets", "percent", "least"), [(1, 1, 10_000, 10, 20), (1, 3, 500, 60, 1), (2, 2, 97, 100, 0)])
def test_resampling(spark, docs, n_min, n_max, buckets, percent, least):
    target = ["the quick brown fox\nshared line of seven plain words here", None, "", "élan Élan ÉLAN x1y2", "shared line of seven plain words here"]
    aims = spark.createDataFrame([(t, "x") for t in target], "text string, bucket string")
    got = resample.resample(docs, aims, percent, least, buckets=buckets, n_min=n_min, n_max=n_max).collect()
    assert Counter(tuple(r) for r in got) == resampled(ROWS, target, n_min, n_max, buckets, percent, least)


def test_resampling_of_empty_tables(spark, docs):
    aims = spark.createDataFrame([("a b",)], "text string")
    assert resample.resample(docs.limit(0), aims).count() == 0
    got = resample.resample(docs, aims.limit(0)).collect()
    assert Counter(tuple(r) for r in got) == resampled(ROWS, [], 1, 1, 10_000, 10, 20)


def test_a_line_in_most_documents_is_broadcast_with_equal_results(spark):
    rows = [(i, "one very common line\n" + (f"own words {i} " * 9 if i % 3 else "")) for i in range(1500)]
    rows += [(7, "one very common line")] * 500
    got = resample.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([("common words",)], "text string"), 30, 3).collect()
    assert Counter(tuple(r) for r in got) == resampled(rows, ["common words"], 1, 1, 10_000, 30, 3)


def test_the_chunk_table_stays_bounded_over_many_tasks(monkeypatch):
    """Every task makes its own coder; the table and its size belong to the worker."""
    monkeypatch.setattr(bpe, "TABLE_BYTES", 200_000)
    monkeypatch.setattr(bpe, "_TABLES", {})
    rng = np.random.default_rng(0)
    most = 0
    for _ in range(30):
        text = " ".join("".join(rng.choice(list("abcdefgh"), 6)) for _ in range(6000)).encode()
        raw = np.frombuffer(text, np.uint8)
        bpe.ChunkCoder(WORD_BPE).encode(raw, np.array([0, len(raw)]))
        most = max(most, len(bpe._TABLES[WORD_BPE][0]))
    assert most < 120
