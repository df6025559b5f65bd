"""Exact Jaccard self-join of word n-gram sets by prefix lists, with set-relation skipping.

1. Texts become sets of hashed shingles; equal texts are one class. Every class posts the shingles with small hashes (a fixed share of the hash
   range, at least the prefix), as packed blocks per bucket of the hash range. A bucket counts in how many classes each shingle occurs.
2. Shingles are ordered rare first inside that range, by hash after it. Two sets of similarity t share a shingle among the first n - ceil(t n) + 1 of each.
   A class whose prefix holds only shingles of its own has no partner and is done; usually these are nearly all.
3. Each list (a prefix shingle with its classes) has a leader, its smallest class. Every class is compared with the leaders of its
   lists, exactly, on whole sets. Their links give first components; a list inside one component has nothing left to find.
4. The classes that share a leader and are not yet in one component are blocked by set size. Block pairs whose sizes cannot reach the threshold are skipped whole; inside the others the
   answer of a pair is derived from the answers already computed against the common leader: with overlaps p and q with a leader of size l, the
   pair shares at least p + q - l and at most min(p, q) + min(m - p, n - q) shingles. Only pairs that neither bound decides are compared on their sets.

Links of copies are not expanded; the result is a component per document. No list, component or set of all documents reaches the driver or one
task: hot lists are split into blocks, hot classes by a salt.

Shingles are 64-bit hashes; equal hashes of different shingles would have to meet inside a pair to matter.

Defined results: text null, empty or of white space only has an empty set and links with nothing; under ``width`` words the whole sequence is one shingle; rows
without identifier are left out; repeated rows are copies. The component is the smallest identifier reachable.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import components, crc32_text, forest, give_back, make_room, slices, spread_join, stored, text_bytes, trimmed
from quantloom.llm.words import shingles, word_hashes

SHARE = 0.4  # of the hash range that every class posts
BUCKET_BYTES = 12 << 20  # of text for each bucket of the hash range
FLUSH = 400_000  # postings a task gathers before it hands over
SLICE = 1 << 18  # bytes of text worked on at a time; a byte takes some 50 on its way to the shingles
LIST_BLOCK = 256
PAIRS = 2000  # that one group compares


def prefix_length(n, percent: int):
    """n - ceil(t n) + 1 in integers."""
    return n - (-(-percent * n // 100)) + 1


def sets_of(column: pa.Array, width: int):
    """Sorted shingle sets of a batch of texts."""
    raw, offs = text_bytes(column)
    for s, e in slices(offs, SLICE):
        h, at = word_hashes(raw[offs[s] : offs[e]], offs[s : e + 1] - offs[s])
        for i in range(e - s):
            yield shingles(h[at[i] : at[i + 1]], width)


def _post(rows: DataFrame, width: int, percent: int, buckets: int, share: float) -> DataFrame:
    """Packed per bucket of the hash range: postings (classes, sizes, shingles, class index), and some of the documents (id, class, n) to pass on."""
    limit = np.uint64(int(share * 2.0**64))
    step = np.uint64(((1 << 64) - 1) // buckets + 1) if buckets > 1 else None
    names = ["bucket", "classes", "sizes", "keys", "at", "docs"]

    def flush(cls: list, sizes: list, posted: list, docs: list, turn: int):
        keys = np.concatenate([np.zeros(0, np.uint64), *posted])
        at = np.repeat(np.arange(len(cls), dtype=np.uint32), [len(p) for p in posted])
        b = (keys // step).astype(np.int64) if step else np.zeros(len(keys), np.int64)
        order = np.argsort(b, kind="stable")
        keys, at, ends = keys[order], at[order], np.searchsorted(b[order], np.arange(buckets + 1))
        classes, counts = np.array(cls, np.int64), np.array(sizes, np.int32)
        blobs: list[list] = [[] for _ in names]
        for k in range(buckets):
            x, y = ends[k], ends[k + 1]
            mine = np.array(docs, np.int64).tobytes() if k == turn % buckets else b""
            if x == y and not mine:
                continue
            used, inv = np.unique(at[x:y], return_inverse=True)
            for c, v in zip(blobs, (k, classes[used].tobytes(), counts[used].tobytes(), keys[x:y].tobytes(), inv.astype(np.uint32).tobytes(), mine), strict=True):
                c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(blobs[0], pa.int32())] + [pa.array(x, pa.binary()) for x in blobs[1:]], names=names)

    def run(batches):
        make_room()
        cls: list = []
        sizes: list = []
        posted: list = []
        docs: list = []
        seen: set = set()
        total = turn = 0
        for batch in batches:
            for d, c, one in zip(batch.column("doc_id").to_pylist(), batch.column("cls").to_pylist(), sets_of(batch.column("text"), width), strict=True):
                docs.append((d, c, len(one)))
                turn = crc32_text(str(d)) if len(docs) == 1 else turn
                if len(one) and c not in seen:  # copies in one task post once
                    seen.add(c)
                    cls.append(c)
                    sizes.append(len(one))
                    posted.append(one[: max(int(np.searchsorted(one, limit)), prefix_length(len(one), percent))].copy())
                    total += len(posted[-1])
                if total >= FLUSH or len(docs) >= FLUSH:
                    yield flush(cls, sizes, posted, docs, turn)
                    cls, sizes, posted, docs, seen, total = [], [], [], [], set(), 0
            batch = one = None  # not held while the next one is read
        if docs:
            yield flush(cls, sizes, posted, docs, turn)
        cls, sizes, posted, docs, seen = [], [], [], [], set()
        give_back()

    return rows.mapInArrow(run, "bucket int, classes binary, sizes binary, keys binary, at binary, docs binary")


def _count(posts: DataFrame, groups: int, share: float) -> DataFrame:
    """Per bucket: how many posted shingles of a class are its own, and the shared ones with their class counts, packed by group of classes.

    Group -1 holds the documents that came along.
    """
    limit = np.uint64(int(share * 2.0**64))

    def bucket(t: pa.Table) -> pa.Table:
        cols = {c: t.column(c).to_pylist() for c in ("classes", "sizes", "keys", "at")}
        docs = b"".join(t.column("docs").to_pylist())
        tables = [np.frombuffer(x, np.int64) for x in cols["classes"]]
        names, inv = np.unique(np.concatenate(tables), return_inverse=True)
        size = np.zeros(len(names), np.int32)
        size[inv] = np.concatenate([np.frombuffer(x, np.int32) for x in cols["sizes"]])
        starts = np.cumsum([0] + [len(x) for x in tables])
        at = np.concatenate([inv[s : s + len(x)][np.frombuffer(a, np.uint32)] for s, x, a in zip(starts, tables, cols["at"], strict=False)]).astype(np.int32)
        keys = np.concatenate([np.frombuffer(x, np.uint64) for x in cols["keys"]])
        cols.clear()
        order = np.argsort(keys)
        keys, at = keys[order], at[order]
        new = np.concatenate(([True], keys[1:] != keys[:-1]))
        alone = new & np.concatenate((new[1:], [True]))
        own = [at[alone][keys[alone] < limit]]
        keys, at = keys[~alone], at[~alone]
        order = np.lexsort((at, keys))
        keys, at = keys[order], at[order]
        if len(keys):
            first = np.concatenate(([True], (keys[1:] != keys[:-1]) | (at[1:] != at[:-1])))  # copies from several tasks
            keys, at = keys[first], at[first]
            new = np.concatenate(([True], keys[1:] != keys[:-1]))
            run = np.cumsum(new) - 1
            df = np.bincount(run)[run]
            single = df == 1
            own.append(at[single][keys[single] < limit])
            keys, at, df = keys[~single], at[~single], df[~single]
        else:
            df = np.zeros(0, np.int64)
        mine = np.bincount(np.concatenate(own), minlength=len(names)).astype(np.int32)
        group = (names.astype(np.uint64) % np.uint64(groups)).astype(np.int64)
        out: list[list] = [[-1], [docs], [b""], [b""], [b""], [b""], [b""]]
        where = group[at]
        for g in range(groups):
            c, p = np.flatnonzero(group == g), np.flatnonzero(where == g)
            if len(c):
                row = (g, names[c].tobytes(), size[c].tobytes(), mine[c].tobytes(), names[at[p]].tobytes(), keys[p].tobytes(), df[p].astype(np.int32).tobytes())
                for x, v in zip(out, row, strict=True):
                    x.append(v)
        return pa.Table.from_arrays([pa.array(out[0], pa.int32())] + [pa.array(x, pa.binary()) for x in out[1:]], names=["g", "classes", "sizes", "own", "p_class", "p_key", "p_df"])

    return posts.groupBy("bucket").applyInArrow(trimmed(bucket), "g int, classes binary, sizes binary, own binary, p_class binary, p_key binary, p_df binary")


def _prefixes(counted: DataFrame, percent: int, share: float) -> DataFrame:
    """(key, cls, n, pos) for the shared shingles in each class's prefix."""
    limit = np.uint64(int(share * 2.0**64))

    def group(t: pa.Table) -> pa.Table:
        join = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in t.column(c).to_pylist()])
        names, inv = np.unique(join("classes", np.int64), return_inverse=True)
        own = np.bincount(inv, weights=join("own", np.int32), minlength=len(names)).astype(np.int64)
        n = np.zeros(len(names), np.int64)
        n[inv] = join("sizes", np.int32)
        key, df = join("p_key", np.uint64), join("p_df", np.int32)
        at = np.searchsorted(names, join("p_class", np.int64))
        df = np.where(key < limit, df, np.int32(2**31 - 1))  # beyond the range every class posts, only the hash orders
        order = np.lexsort((key, df, at))
        key, at = key[order], at[order]
        begin = np.searchsorted(at, np.arange(len(names)))
        pos = np.arange(len(at)) - begin[at] + own[at]
        keep = pos < prefix_length(n, percent)[at]
        key, at, pos = key[keep], at[keep], pos[keep]
        return pa.Table.from_arrays([pa.array(key.view(np.int64)), pa.array(names[at]), pa.array(n[at].astype(np.int32)), pa.array(pos.astype(np.int32))], names=["key", "cls", "n", "pos"])

    return counted.groupBy("g").applyInArrow(trimmed(group), "key long, cls long, n int, pos int")


def _fits(a: str, b: str, percent: int):
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Exact overlap of (a, b) pairs: (a, b, na, nb, both). The sets of ``a`` travel once per group of pairs, so a common leader is no hot key."""
    groups = max(1, -(-pairs.count() // PAIRS))
    dealt = pairs.withColumn("pid", F.pmod(F.xxhash64("b"), F.lit(groups)).cast("int"))
    right = dealt.select(F.col("a").alias("lead"), F.col("pid").alias("lead_pid")).distinct().join(sets.select(F.col("cls").alias("lead"), F.col("words").alias("a_words")), "lead")
    left = dealt.join(sets.select(F.col("cls").alias("b"), F.col("words").alias("b_words")), "b")

    def compare(x: pa.Table, y: pa.Table) -> pa.Table:
        lead = {a: np.frombuffer(w, np.uint64) for a, w in zip(y.column("lead").to_pylist(), y.column("a_words").to_pylist(), strict=True)}
        out: list[list[int]] = [[], [], [], [], []]
        for a, b, w in zip(x.column("a").to_pylist(), x.column("b").to_pylist(), x.column("b_words").to_pylist(), strict=True):
            if a not in lead:
                continue
            one, two = lead[a], np.frombuffer(w, np.uint64)
            both = np.concatenate([one, two])
            both.sort()
            for c, v in zip(out, (a, b, len(one), len(two), int((both[1:] == both[:-1]).sum())), strict=True):
                c.append(v)
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b", "na", "nb", "both"])

    return stored(left.groupBy("pid").cogroup(right.groupBy("lead_pid")).applyInArrow(compare, "a long, b long, na long, nb long, both long"), "jaccard-overlaps")


def _linked(percent: int):
    return F.expr(f"100 * both >= {percent} * (na + nb - both)")


def _rest(members: DataFrame, percent: int) -> DataFrame:
    """Links between members of one leader that are in different components: (a, b), a spanning forest per pair of blocks.

    Input: (lead, cls, n, comp, lead_n, over, words). Members are blocked by set size; block pairs whose sizes cannot reach the threshold are skipped whole.
    """
    banded = members.withColumn("band", F.floor(F.log("n") / F.lit(float(np.log(1.1)))).cast("int"))
    sizes = banded.groupBy("lead", "band").agg(F.ceil(F.count(F.lit(1)) / LIST_BLOCK).cast("int").alias("subs"))
    dealt = spread_join(banded, sizes, ["lead", "band"], "cls").withColumn("sub", F.pmod(F.xxhash64("cls"), F.col("subs")).cast("int"))
    names = ("cls", "n", "comp", "over", "words")
    item = F.struct(*[F.coalesce(c, F.lit(-1)).alias(c) if c == "over" else F.col(c) for c in names])
    blocks = stored(dealt.groupBy("lead", "band", "sub").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max("lead_n").alias("lead_n"), F.collect_list(item).alias("items")), "jaccard-blocks")
    other = blocks.select("lead", *[F.col(c).alias(f"b_{c}") for c in ("band", "sub", "low", "high", "items")])
    pairs = blocks.join(other, "lead").filter(f"(band < b_band or (band = b_band and sub <= b_sub)) and 100 * high >= {percent} * b_low and 100 * b_high >= {percent} * low")

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in ("band", "sub", "b_band", "b_sub", "lead_n", "items", "b_items")}
                same = (r["band"], r["sub"]) == (r["b_band"], r["b_sub"])
                a, b = _between(r["items"], r["b_items"], same, r["lead_n"], percent)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])
        give_back()

    return pairs.mapInArrow(run, "a long, b long").distinct()


def _between(one: list[dict], two: list[dict], same: bool, lead_n: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of two blocks as a forest. The leader's answers decide what they can; the others are counted on their sets."""
    column = lambda items, c: np.array([x[c] for x in items], np.int64)
    na, nb = column(one, "n")[:, None], column(two, "n")[None, :]
    need = -(-percent * (na + nb) // (100 + percent))
    ok = (column(one, "comp")[:, None] != column(two, "comp")[None, :]) & (np.minimum(na, nb) >= need)
    if same:
        ok &= np.triu(np.ones(ok.shape, bool), 1)
    p, q = column(one, "over")[:, None], column(two, "over")[None, :]
    known = (p >= 0) & (q >= 0)
    ok &= ~known | (np.minimum(p, q) + np.minimum(na - p, nb - q) >= need)
    sure = ok & known & (p + q - lead_n >= need)
    i, j = np.flatnonzero((ok & ~sure).any(axis=1)), np.flatnonzero((ok & ~sure).any(axis=0))
    if len(i):
        sets = [np.frombuffer(one[k]["words"], np.uint64) for k in i] + [np.frombuffer(two[k]["words"], np.uint64) for k in j]
        words, at = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        both = np.zeros((len(i), len(j)))
        for low in range(0, len(words), 8192):  # incidence of a range of shingles at a time
            use = (at >= low) & (at < low + 8192)
            m = np.zeros((len(sets), min(8192, len(words) - low)), np.float32)
            m[row[use], at[use] - low] = 1
            both += m[: len(i)] @ m[len(i) :].T
        sure[np.ix_(i, j)] |= ok[np.ix_(i, j)] & (both >= need[np.ix_(i, j)])
    x, y = np.nonzero(sure)
    if not len(x):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    nodes, roots = forest(column(one, "cls")[x], column(two, "cls")[y])
    return nodes[nodes != roots], roots[nodes != roots]


def components_of(docs: DataFrame, ident: str = "doc_id", text: str = "text", percent: int = 75, width: int = 5, share: float = SHARE) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row with an identifier."""
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    rows = rows.withColumn("cls", F.xxhash64("text", F.length("text")))
    volume = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0  # one row
    buckets = max(1, -(-int(volume) // BUCKET_BYTES))
    both = stored(_count(_post(rows, width, percent, buckets, share), buckets, share), "jaccard-counted")
    members = stored(_documents(both.filter("g = -1").select("classes")), "jaccard-members")  # four steps read it; the packed postings beside it are read once
    prefixes = stored(_prefixes(both.filter("g >= 0"), percent, share), "jaccard-prefixes")
    lists = prefixes.groupBy("key").agg(F.min(F.struct("cls", "n")).alias("l"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("key", "size", F.col("l.cls").alias("lead"), F.col("l.n").alias("lead_n"))
    led = stored(prefixes.join(lists, "key"), "jaccard-lists")
    alive = led.select("cls").distinct()
    reps = members.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("doc_id")).join(alive, "cls")
    whole = rows.select("doc_id", "text", F.col("cls").alias("_c")).join(reps, "doc_id").filter("_c = cls").dropDuplicates(["cls"])

    def sets(batches):
        make_room()
        for batch in batches:
            packed = [x.tobytes() for x in sets_of(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([batch.column("cls"), pa.array(packed, pa.binary())], names=["cls", "words"])
            batch = packed = None  # not held while the next one is read
        give_back()

    words = stored(whole.select("cls", "text").mapInArrow(sets, "cls long, words binary"), "jaccard-sets")
    first = led.filter("cls <> lead").filter(_fits("n", "lead_n", percent)).select(F.col("lead").alias("a"), F.col("cls").alias("b")).distinct()
    answers = _overlaps(first, words)
    links = answers.filter(_linked(percent)).select("a", "b")
    roots = components(links, "jaccard-components")
    # two classes of one list have its leader in common, whose own pairs are answered: what is left lies among the other members of a leader
    others = led.filter("size > 2 and cls <> lead").select("lead", "cls", "n", "lead_n").distinct()
    placed = others.join(roots, others.cls == roots.node, "left").withColumn("comp", F.coalesce("root", "cls")).drop("node", "root")
    many = placed.groupBy("lead").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("lead")
    known = answers.select(F.col("a").alias("lead"), F.col("b").alias("cls"), F.col("both").alias("over"))
    open_groups = placed.join(many, "lead").join(known, ["lead", "cls"], "left").join(words, "cls")
    more = stored(_rest(open_groups, percent), "jaccard-rest")
    roots = components(links.unionByName(more), "jaccard-components")
    classes = members.groupBy("cls").agg(F.min("doc_id").alias("low")).join(roots, F.col("cls") == F.col("node"), "left")
    classes = classes.select("cls", "low", F.coalesce("root", "cls").alias("root"))
    least = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    of_class = classes.join(least, "root").select("cls", "component_id")
    full = spread_join(members.filter("n > 0"), of_class, "cls", "doc_id", present=True).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    empty = members.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def _documents(passed: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for x in batch.column("classes").to_pylist():
                d = np.frombuffer(x, np.int64).reshape(-1, 3)
                yield pa.RecordBatch.from_arrays([pa.array(d[:, 0].copy()), pa.array(d[:, 1].copy()), pa.array(d[:, 2].astype(np.int32))], names=["doc_id", "cls", "n"])
        give_back()

    return passed.mapInArrow(run, "doc_id long, cls long, n int")


def deduplicated(docs: DataFrame, ident: str = "doc_id", **options) -> DataFrame:
    """One row of each component stays: one with the smallest identifier; rows without identifier come last.

    Rows are told apart by a generated key, so repeated rows, other texts under the same identifier and rows without identifier take part like all
    others. Rows without a word are no copies of each other; of those that repeat an identifier one stays.
    """
    keyed = stored(docs.withColumn("_row", F.monotonically_increasing_id()), "jaccard-rows")
    found = components_of(keyed, "_row", **options).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_group"), "n_shingles")
    named = keyed.select("_row", F.col(ident).alias("_id")).join(found, "_row")
    wordless = (F.col("n_shingles") == 0) & F.col("_id").isNotNull()
    groups = named.groupBy(F.when(wordless, F.col("_id")).alias("_same"), F.when(~wordless, F.col("_group")).alias("_group"))
    best = groups.agg(F.min(F.struct(F.col("_id").isNull().alias("none"), "_id", "_row")).alias("_best")).select(F.col("_best._row").alias("_row"))
    return keyed.join(best, "_row").drop("_row")
