"""Training-data operators beside brute force on small tables with nulls, empty and long texts, ties, copies and clashing column names."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quantloom.llm import bpe, common, jaccard, language, licences, maxent, neardup, packing, pieces, private, topk, urls

EN = "the quick brown fox jumps over the lazy dog while the old man reads his morning paper near the river "
FR = "le petit chat noir dort sur la chaise pendant que la vieille dame lit son journal dans le jardin "
SCHEMA = "doc_id long, text string, lang string, source string, score double"
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def texts():
    words = (EN + FR).split()
    rng = np.random.default_rng(3)
    out = [None, "", "   \n ", "12 34 !!", "a", "one two three", "<|endoftext|> odd  spaces \n here <|startoftext|>", "é" * 70 + " ́x " + "word " * 3000]
    out += [" ".join(rng.choice(words, 60)) for _ in range(12)]
    base = [" ".join(rng.choice(words, 80)) for _ in range(3)]
    for b in base:
        w = b.split()
        out += [b, b, b.upper()] + [" ".join(w[:k] + ["changed"] + w[k + 1 :]) for k in (5, 40, 70)]
    return out + [EN, FR]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 7 == 0 else ("fr" if t and " le " in t and t.count("le") > t.count("the") else "en"), None if i % 5 else "s", 0.5) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))


def test_language(spark, docs, empty):
    train = spark.createDataFrame([(EN, "en"), (FR, "fr"), (EN * 3, "en"), (None, "en"), ("x", None)], "text string, lang string")
    model = language.fit(train)
    got = {r.doc_id: r for r in language.identify(docs, model).collect()}
    assert [got[i].lang_pred for i in (0, 1, 2, 3)] == ["und"] * 4 and got[0].score == 0
    n = len(texts())
    assert (got[n - 2].lang_pred, got[n - 1].lang_pred) == ("en", "fr") and len(got) == n
    assert language.identify(empty, model).count() == 0
    assert {r.lang_pred for r in language.identify(docs, language.fit(train.limit(0))).collect()} == {"und"}


def test_language_stage_rejects_noise_and_languages_without_label(spark, sf_dir):
    import base64

    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rng = np.random.default_rng(1)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    bad = [base64.b64encode(rng.bytes(3000)).decode(), "".join(rng.choice(letters, 3000)), "быстрая лиса прыгает через ленивую собаку " * 40, "敏捷的棕色狐狸跳过懒狗 " * 80]
    bad += ["nopea ruskea kettu hyppää laiskan koiran yli ja juoksee metsään " * 20, "".join(rng.choice(letters, 40)), "0x1f2e " * 300]
    extra = spark.createDataFrame([(-1 - k, t, None) for k, t in enumerate(bad)], "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.unionByName(extra), sf_dir).select("doc_id").collect()}
    assert kept == {r.doc_id for r in docs.select("doc_id").collect()}


def brute_links(vecs, t):
    ids, ok = list(vecs), {}
    for i in ids:
        v = vecs[i]
        good = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        ok[i] = np.array(v) / np.linalg.norm(v) if good else None
    return {(a, b) for a in ids for b in ids if a < b and ok[a] is not None and ok[b] is not None and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] >= t}


def roots(ids, links):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.fixture(scope="module")
def vecs():
    rng = np.random.default_rng(5)
    out = {i: [float(x) for x in rng.normal(size=8)] for i in range(40)}
    for i in range(40, 60):
        out[i] = [x + 0.05 * float(rng.normal()) for x in out[i % 4]]
    out.update({60: out[1], 61: out[1], 62: None, 63: [], 64: [0.0] * 8, 65: [1.0] + [None] * 7, 66: [float("nan")] * 8, 67: [1.0, 2.0], 68: [2.0, 4.0], 69: [float("inf")] * 8})
    return out


def test_near_vectors(spark, vecs):
    df = spark.createDataFrame([(k, v, 1) for k, v in vecs.items()], "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: r for r in neardup.near_duplicates(df, 0.95).collect()}
    links = brute_links(vecs, 0.95)
    count, root = Counter(x for p in links for x in p), roots(vecs, links)
    assert {k: (r.n_links, r.component_id, r.kept) for k, r in got.items()} == {k: (count[k], root[k], root[k] == k) for k in vecs}
    assert neardup.near_duplicates(df.limit(0), 0.95).count() == 0


def test_near_vectors_over_many_tiles(spark, monkeypatch):
    """Cells of several tiles, repeated identifiers and vectors, zeros of both signs; tasks that sum what they gathered again and again."""
    monkeypatch.setattr(neardup, "TILE", 8)
    monkeypatch.setattr(neardup, "HELD", 6)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(30, 4))
    many = {i: [float(x) for x in base[i % 30] + 0.02 * rng.normal(size=4)] for i in range(120)}
    many |= {200 + i: many[3] for i in range(20)} | {300: [0.0, 1.0, 0.0, -1.0], 301: [-0.0, 1.0, 0.0, -1.0]}
    df = spark.createDataFrame([*many.items(), (3, many[3]), (None, many[3])], "vec_id long, embedding array<double>")
    rows = [tuple(r) for r in neardup.near_duplicates(df, 0.95).collect()]
    links = brute_links(many, 0.95)
    count, root = Counter(x for p in links for x in p), roots(many, links)
    near3 = {x for p in links if 3 in p for x in p}
    want = [(k, count[k] + (k in near3), root[k], root[k] == k) for k in many]
    assert sorted(rows) == sorted([*want, next(w for w in want if w[0] == 3)])


def test_pairs_of_tiles_are_not_shuffled(spark):
    tiles = spark.createDataFrame([(2, [0, 0, k % 5], k, b"", b"", b"") for k in range(40)], "dim int, cell array<int>, sub int, ids binary, sizes binary, plain binary")
    pairs = neardup._pairs(tiles)
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    near = lambda a, b: abs(a % 5 - b % 5) <= 1
    assert pairs.count() == sum(near(a, b) for a in range(40) for b in range(a + 1)) and pairs.filter("same").count() == 40


def test_top_k(spark, vecs):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(vecs.items()), "vec_id long, embedding array<double>")
    got = {}
    for r in topk.top_k(df, F.col("vec_id") % 20 == 0, 7).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = {k: np.floor(64 * np.array(v)) for k, v in vecs.items() if v and all(x is not None and math.isfinite(x) for x in v)}
    for q in (k for k in good if k % 20 == 0):
        s = sorted((-int(good[q] @ v), k) for k, v in good.items() if k != q and len(v) == len(good[q]))[:7]
        assert sorted(got[q]) == [(i + 1, k, -x) for i, (x, k) in enumerate(s)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0, 7).count() == 0


@pytest.mark.parametrize("k", [2, 100])
def test_top_k_above_the_number_of_candidates(spark, vecs, k):
    """Queries of a rare length (67 and 68) and, with k = 100, all queries return every candidate they have."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(vecs.items()), "vec_id long, embedding array<double>")
    asked = (0, 20, 64, 67, 68)
    got = {q: [] for q in asked}
    for r in topk.top_k(df, F.col("vec_id").isin(*asked), k).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    good = {i: np.floor(64 * np.array(v)) for i, v in vecs.items() if v and all(x is not None and math.isfinite(x) for x in v)}
    for q in asked:
        s = sorted((-int(good[q] @ v), i) for i, v in good.items() if i != q and len(v) == len(good[q]))[:k]
        assert sorted(got[q]) == [(n + 1, i, -x) for n, (x, i) in enumerate(s)]
    assert [len(got[q]) for q in (67, 68)] == [1, 1]


def test_bpe_and_packing(docs, empty):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for r in bpe.digests(bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))).collect():
        ids = t.encode(texts()[r.doc_id] or "", add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded == t.decode(ids, skip_special_tokens=False)
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    pieces = packing.pack(docs, path, length=64).collect()
    for i, text in enumerate(texts()):
        mine = sorted((p for p in pieces if p.doc_id == i), key=lambda p: p.start)
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert b"".join(bytes(p.ids) for p in mine) == np.array(ids, "<u4").tobytes() and mine[0].start == 0
    full = Counter()
    for p in pieces:
        full[p.sequence_id] += p.length
    assert max(full.values()) == 64 and sum(v < 64 for v in full.values()) <= 1
    assert packing.pack(empty, path).count() == 0 and bpe.encode(empty, path).count() == 0


def test_chunk_cuts_depend_on_content_alone():
    rng = np.random.default_rng(1)
    shared = rng.integers(97, 123, 20000).astype(np.uint8)
    a, b = bpe.cuts(shared), bpe.cuts(np.concatenate([rng.integers(97, 123, 777).astype(np.uint8), shared])) - 777
    assert len(a) > 5 and set(a.tolist()) == {x for x in b.tolist() if x > bpe.WINDOW}


def test_jaccard(docs, empty):
    sets = {}
    for i, t in enumerate(texts()):
        w = words(t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())
    links = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    root = roots(sets, links)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.components_of(docs).collect()}
    assert got == {k: (len(s), root[k]) for k, s in sets.items()}
    assert jaccard.components_of(empty).count() == 0


def test_deduplication_leaves_one_row_of_each_group(spark, empty):
    rng = np.random.default_rng(11)
    a, b, c, d = (" ".join("".join(rng.choice(list("abcdef"), 6)) for _ in range(80)) for _ in range(4))
    near = " ".join(a.split()[:79])
    rows = [(1, a, "en"), (1, a, "en"), (1, near, "en"), (2, near, "en"), (None, a, "en"), (None, b, "en"), (None, b, "en"), (None, b, "de")]
    rows += [(5, c, "en"), (5, d, "en"), (3, d, "en"), (7, "", "en"), (7, "", "en"), (8, None, "en"), (None, "", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = jaccard.deduplicated(df.repartition(3))
    assert kept.columns == df.columns
    got = Counter((r.doc_id, r.text) for r in kept.collect())
    first = [key for key in got if key[0] == 1]
    assert len(first) == 1 and first[0][1] in (a, near)
    assert got == Counter([first[0], (None, b), (5, c), (3, d), (7, ""), (8, None), (None, "")])
    assert jaccard.deduplicated(empty).count() == 0


def test_jaccard_gives_memory_back(docs, monkeypatch):
    """Every Python step over documents or their sets, the packed documents read alone and once."""
    given, kept = [], []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1))
    table = pa.table({"x": [1]})
    assert common.trimmed(lambda t: t)(table) is table and given == [1]
    store = jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, name: kept.append(name) or store(df, name))
    monkeypatch.setattr(jaccard, "_documents", lambda passed, read=jaccard._documents: kept.append(tuple(passed.columns)) or read(passed))
    jaccard.components_of(docs)
    assert kept.count(("classes",)) == 1 and kept.count("jaccard-members") == 1


def test_tasks_begin_with_room():
    """Tokenizers that packing left in a worker go before sets are compared; packing loads them again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    first = pieces.coder(path, spaced=True, ranks=True)
    assert pieces.coder(path, spaced=True, ranks=True) is first
    table = pa.table({"x": [1]})
    assert common.trimmed(lambda t: t)(table) is table and not pieces._CODERS
    assert pieces.coder(path, spaced=True, ranks=True).encode([EN]) == first.encode([EN])


def test_jaccard_works_on_small_slices(monkeypatch):
    """Shingles of a large batch come from slices of bounded bytes, whole texts each, and are those of the texts alone."""
    texts = [f"{k} {EN * (k % 30)}" for k in range(1500)] + [EN * 4000, None, ""]
    alone = [list(jaccard.sets_of(pa.array([t], pa.string()), 5))[0] for t in texts]
    seen, hashes = [], jaccard.word_hashes
    monkeypatch.setattr(jaccard, "word_hashes", lambda raw, offsets: seen.append((len(raw), len(offsets) - 1)) or hashes(raw, offsets))
    together = list(jaccard.sets_of(pa.array(texts, pa.string()), 5))
    assert len(together) == len(texts) and all(np.array_equal(a, b) for a, b in zip(alone, together, strict=True))
    assert sum(n for n, _ in seen) > 2 << 20 and all(n <= 1 << 18 or rows == 1 for n, rows in seen)


def test_jaccard_compares_members_of_one_leader():
    """Two sets far from their leader but near each other are linked on their sets."""
    a, b = np.arange(100, dtype=np.uint64), np.arange(10, 110, dtype=np.uint64)
    item = lambda c, s: {"cls": c, "n": len(s), "comp": c, "over": 40, "words": s.tobytes()}
    x, y = jaccard._between([item(7, a)], [item(9, b)], False, 90, 75)
    assert (x.tolist(), y.tolist()) == ([9], [7])


def test_maxent(docs, empty):
    from pyspark.sql import functions as F

    learn = F.col("doc_id") % 3 != 0
    got = {r.doc_id: r for r in maxent.score(docs, learn, ~learn).collect()}
    toks = {i: words(t) + [None] for i, t in enumerate(texts())}
    c = Counter(w for i, t in toks.items() if i % 3 for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in toks.items():
        base = sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert got[i].base_score == pytest.approx(base) and got[i].score < 0
    assert maxent.score(empty, learn, ~learn).count() == 0


def test_licences(spark):
    rows = [(1, "x y.\nReleased under the MIT License.\nAll rights reserved."), (2, None), (3, ""), (4, "released under the mit license")]
    got = {r.doc_id: (r.n_sentences, r.licences) for r in licences.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, "mit,all-rights-reserved"), 2: (0, ""), 3: (0, ""), 4: (1, "mit")}


APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0
"""
MIT = """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
BSD = """Copyright (c) 2001, Somebody. All  rights\r
reserved.

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
FREE = """ * This {} is free software{} you can redistribute it and/or
 * modify it under the terms of the GNU {}General Public License as
 * published by the Free Software Foundation, either version {} of the
 * License, or (at your option) any later version.
"""


def test_licences_over_several_lines(spark):
    mpl = "/* This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed"
    isc = "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.\n"
    rows = [
        (APACHE, "apache-2-the-license,apache-2-comply,apache-2-copy", "apache-2.0"), (MIT, "mit-title,mit-grant,mit-notice", "mit"), (BSD, "reserved,bsd-source,bsd-binary", "bsd,all-rights-reserved"),
        (FREE.format("program", ":", "", "3"), "gpl-free", "gpl-3.0-or-later"), (FREE.format("program", ";", "", "2"), "gpl-free-2", "gpl-2.0-or-later"), (FREE.format("library", ";", "Lesser ", "2.1"), "lgpl-free-2.1", "lgpl-2.1-or-later"),
        (FREE.format("program", ":", "Affero ", "3"), "agpl-free", "agpl-3.0-or-later"), (mpl, "mpl-2", "mpl-2.0"), (isc, "isc-grant", "isc"), ("This work is in the public-domain", "public-domain", "public-domain"),
        ("Licensed under the Apache License, Version 2.0\n(the License)", "apache-2-under", "apache-2.0"), ("not released under the MIT license", "", ""), ("so it is released under\nthe MIT license", "mit-title", ""), ("Released under\nthe MIT license!\nx", "mit-released", "mit"),
        ("\n" * 50000 + "a. " * 50000, "", ""),
    ]
    got = {r.doc_id: (r.sentence_ids, r.licences) for r in licences.scan(spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(rows)], "doc_id long, text string")).collect()}
    assert got == {k: (ids, names) for k, (_, ids, names) in enumerate(rows)}


def test_urls(spark):
    rules = [("allow", "org/"), ("block", "example.org/es/"), ("block", "com/de/")]
    rows = [(1, "http://A.Example.ORG/es/1?x"), (2, "https://x.org/es/"), (3, "http://notorg/"), (4, None), (5, "x.org/es"), (6, "http://bad-host.net/p/12"), (7, "http://good.net/p/12"), (8, "http://x.org")]
    rows += [(100 + k, f"http://bad-host.net/p/{k}") for k in range(30)] + [(200 + k, f"http://good.net/p/{k}") for k in range(60)]
    labels = spark.createDataFrame([(k, k < 200) for k in range(100, 260)], "id long, blocked boolean")
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string"), labels, rules).collect()}
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert [got[k].rule for k in (2, 3, 4, 5, 8)] == ["org/", None, None, None, None] and (got[4].host, got[5].path) == ("", "")
    assert (got[6].verdict, got[7].verdict, got[3].verdict) == ("block", "allow", "allow")


def base_spans(t):
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and sum(int(x) if k % 2 == 0 else sum(divmod(2 * int(x), 10)) for k, x in enumerate(d[::-1])) % 10 == 0),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
    ]
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, t, re.A) if ok(m[0])]
    return ",".join(f"{name}:{s}:{e}" for s, _, name, e in sorted(found))


def test_private_base_spans_and_redaction(spark):
    rows = ["", None, "é a@b.c_d@e.f x@y z@w.co.uk.", "1.2.3.4.5.6.7.8 and 1.2.3.999 0001.2.3.4", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (988) 555-2485) +12 +1 2 3"]
    rows += ["9" * 20000, "a.b@" * 3000, "1.2." * 5000, "x" * 50000, "mail ünï bosbt.42@mail8.example.com +1 (269) 555-3296 4524132264652876 25.102.19.31"]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    found = private.find(df, private.Chooser()).withColumn("base", private.listing("_base"))
    got = {r.doc_id: r for r in found.select("doc_id", "base", private.listing("_spans").alias("spans"), private.redact().alias("clean")).collect()}
    for i, t in enumerate(rows):
        assert got[i].base == base_spans(t or ""), i
        assert set(filter(None, got[i].base.split(","))) <= set(got[i].spans.split(","))
    assert got[10].clean == "mail ünï [EMAIL] [PHONE] [CARD] [IP]" and got[1].clean is None


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = corpus_pipeline.drop_near_duplicates(spark, corpus_pipeline.identify_language(spark, docs, sf_dir), sf_dir)
    assert kept.columns == docs.columns
    comp = {r.doc_id: r.component_id for r in jaccard.components_of(docs).collect()}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, c in comp.items() if d == c}
    pieces = corpus_pipeline.pack_sequences(spark, kept, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").distinct().collect()} == {d for d, c in comp.items() if d == c}


def test_crc_matches_the_contract(spark):
    from quantloom.llm.common import crc_of

    got = {r.doc_id: r.c for r in spark.range(50).withColumnRenamed("id", "doc_id").withColumn("c", crc_of("doc_id")).collect()}
    assert got == {k: zlib.crc32(str(k).encode()) for k in got}


def test_private_classifier_sees_every_candidate_once_by_weight(spark, monkeypatch):
    """20,100 base spans and 36 false ones (an address, its first number and its digits as a number, 12 times): all are counted, as few distinct rows."""
    seen = []
    monkeypatch.setattr(private, "stored", lambda df, name: seen.append(df.cache()) or seen[-1])
    good = " ".join(f"write a{i % 10}@b.org" for i in range(201))
    df = spark.createDataFrame([(good,)] * 100 + [("at 999.1.1.1 now",)] * 12, "text string")
    private.fit(df)
    weights = {r["label"]: (r["n"], r["rows"]) for r in seen[0].groupBy("label").agg(F.sum("w").alias("n"), F.count(F.lit(1)).alias("rows")).collect()}
    assert weights[1.0][0] == 20_100 and weights[0.0][0] == 36 and weights[1.0][1] <= 60
    seen[0].unpersist()
