"""Importance resampling towards a target text collection, with every distinct line counted once.

Features are the runs of ``n_min`` to ``n_max`` consecutive words, hashed to buckets. A bucket's gain compares how often the target texts and the documents hold it; a document's weight
is the floored mean gain of its features; a fixed pseudo-random value per identifier (Gumbel noise) is added and the highest sums are drawn.

Segment deduplication: newlines separate words, so a text is its lines. Distinct lines are grouped with their number of occurrences before any word is cut; the features of a
distinct line are hashed once, written once, multiplied by the occurrences for the corpus counts, and summed once for the weights. Runs over a line's end (only with ``n_max`` above
1) are counted per document and added separately.

Skew: lines are combined on the map side; a line with more than a 1/1000 of all occurrences is one of at most 1000, which are broadcast, and all rows of such lines stay where they are.
Ranks come from the counts per score: scores are whole numbers in a range that the buckets and the noise bound, so their histogram does not follow the input; equal result rows are
one row with a multiplicity until the end.

Defined results: null or empty text, or text without a word, has no features and weight 0; a null identifier is hashed as empty text; repeated rows are kept and ranked each;
an empty table gives no rows; an empty target gives gains of the same formula with all its counts 0. Other columns are not carried.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import slices, stored, text_bytes

WORD = r"[0-9A-Za-z\x{80}-\x{10FFFF}]"
HOT_SHARE = 1000
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def words_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Lower-cased words of each text in order, and the number of words before each text (one more than texts)."""
    solid = _WORD[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], solid[:-1])) if len(raw) else solid
    start = np.flatnonzero(solid & (~before | edge[:-1]))
    clean = np.where(solid, _LOWER[raw], np.uint8(0x20))
    cut = offsets[(offsets > 0) & (offsets < len(raw))]
    cut = cut[solid[cut] & solid[cut - 1]]  # two texts that touch
    joined = np.insert(clean, cut, 0x20).tobytes()
    return joined.split(), np.searchsorted(start, offsets)


def buckets_of(words: list[bytes], buckets: int, memo: dict[bytes, int]) -> np.ndarray:
    """Bucket of each word; ``memo`` holds the distinct words of one slice."""
    for w in set(words).difference(memo):
        memo[w] = zlib.crc32(w) % buckets
    return np.fromiter(map(memo.__getitem__, words), np.int64, len(words))


def runs(words: list[bytes], bounds: np.ndarray, buckets: int, n_min: int, n_max: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, bucket) of every run of words inside its owner, owners being consecutive ranges of ``words``."""
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    out = []
    for n in range(n_min, n_max + 1):
        if n == 1:
            out.append((owner, buckets_of(words, buckets, {})))
        elif len(words) >= n:
            at = np.flatnonzero(owner[: len(words) - n + 1] == owner[n - 1 :])
            out.append((owner[at], buckets_of([b" ".join(words[i : i + n]) for i in at.tolist()], buckets, {})))
    return (np.concatenate([o for o, _ in out]), np.concatenate([b for _, b in out])) if out else (owner[:0], owner[:0])


def _packed(owner: np.ndarray, bucket: np.ndarray, n: int) -> tuple[np.ndarray, pa.Array]:
    """Features of each of ``n`` owners: how many, and their buckets as packed unsigned 32-bit numbers."""
    order = np.argsort(owner, kind="stable")
    count = np.bincount(owner, minlength=n)
    offsets = np.concatenate(([0], np.cumsum(count) * 4)).astype(np.int64)
    data = bucket[order].astype("<u4")
    return count, pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).cast(pa.binary())


def _line_keys(line: str) -> list[Column]:
    """128 bits that stand for a line."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), F.col(line)).alias("h2")]


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))


def distinct_lines(texts: DataFrame, buckets: int, n_min: int, n_max: int) -> DataFrame:
    """Every distinct line that holds a word, of rows (text, n, m): (h1, h2, n, m, words, features, packed).

    ``n`` and ``m`` add up over the line's occurrences (in documents and in target texts); then its words, its features and their buckets.
    """
    lines = texts.select("n", "m", F.explode(_lines(F.col("text"))).alias("line")).groupBy("line").agg(F.sum("n").alias("n"), F.sum("m").alias("m")).select(*_line_keys("line"), "n", "m", "line")
    kept = ["h1", "h2", "n", "m"]

    def run(batches):
        for batch in batches:
            raw, offs = text_bytes(batch.column("line"))
            for s, e in slices(offs):
                words, bounds = words_of(raw[offs[s] : offs[e]], offs[s : e + 1] - offs[s])
                count, packed = _packed(*runs(words, bounds, buckets, n_min, n_max), e - s)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(s, e - s) for c in kept), pa.array(np.diff(bounds)), pa.array(count), packed], names=[*kept, "words", "features", "packed"])

    return lines.mapInArrow(run, "h1 long, h2 long, n long, m long, words long, features long, packed binary")


def _crossing(texts: DataFrame, buckets: int, n_min: int, n_max: int) -> DataFrame:
    """``texts`` with ``crossing``: buckets of the runs that reach over a newline, packed."""
    names = texts.columns
    schema = T.StructType([*texts.schema.fields, T.StructField("crossing", T.BinaryType())])

    def of(text: str) -> np.ndarray:
        raw = np.frombuffer(text.encode(), np.uint8)
        ends = np.concatenate(([0], np.flatnonzero(raw == 0x0A) + 1, [len(raw)]))
        words, bounds = words_of(raw, ends)
        line = np.repeat(np.arange(len(ends) - 1), np.diff(bounds))
        out = []
        for n in range(max(2, n_min), n_max + 1):
            at = np.flatnonzero(line[: max(0, len(line) - n + 1)] != line[n - 1 :]) if len(line) >= n else []
            out.append(buckets_of([b" ".join(words[i : i + n]) for i in list(at)], buckets, {}))
        return np.concatenate(out).astype("<u4")

    def run(batches):
        for batch in batches:
            found = [of(t).tobytes() if t and "\n" in t else b"" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(found, pa.binary())], names=[*names, "crossing"])

    return texts.mapInArrow(run, schema)


def gains(counted: DataFrame, buckets: int) -> np.ndarray:
    """Gain of every bucket from rows (n, m, packed): packed buckets, ``n`` times in documents and ``m`` times in target texts.

    Every task adds into two arrays of ``buckets`` numbers and gives their non-zero entries; one row per bucket reaches the driver.
    """

    def run(batches):
        total = np.zeros((2, buckets), np.int64)
        for batch in batches:
            raw, offs = text_bytes(batch.column("packed"))
            bucket, each = np.frombuffer(raw.tobytes(), "<u4"), np.diff(offs // 4)
            for k, c in enumerate(("n", "m")):
                # whole numbers below 2 ** 53 are exact in the sums of bincount
                total[k] += np.bincount(bucket, np.repeat(batch.column(c).to_numpy(), each), buckets).astype(np.int64)
        some = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(some), *map(pa.array, total[:, some])], names=["bucket", "s", "t"])

    found = counted.mapInArrow(run, "bucket long, s long, t long").groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    s, t = np.zeros(buckets), np.zeros(buckets)
    for r in found.collect():
        s[r["bucket"]], t[r["bucket"]] = r["s"], r["t"]
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def _summed(packed: DataFrame, gain: np.ndarray) -> DataFrame:
    """Rows with ``packed`` replaced by ``gain``, the sum of their buckets' gains."""
    kept = [c for c in packed.columns if c != "packed"]
    schema = T.StructType([*packed.select(*kept).schema.fields, T.StructField("gain", T.LongType())])

    def run(batches):
        for batch in batches:
            raw, offs = text_bytes(batch.column("packed"))
            c = np.concatenate(([0], np.cumsum(gain[np.frombuffer(raw.tobytes(), "<u4")])))
            at = offs // 4
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array(c[at[1:]] - c[at[:-1]])], names=[*kept, "gain"])

    return packed.mapInArrow(run, schema)


def weights(docs: DataFrame, target: DataFrame, buckets: int = 10_000, n_min: int = 1, n_max: int = 1, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document row: (doc_id, n_features, n_words, weight)."""
    rows = docs.select(F.col(ident).alias("doc_id"), F.col(text).alias("text"))
    aims = target.select(F.col(text).alias("text"))
    one, none, cross = F.lit(1).cast("long"), F.lit(0).cast("long"), n_max > 1
    both = rows.select("text", one.alias("n"), none.alias("m")).unionByName(aims.select("text", none.alias("n"), one.alias("m")))
    lines = stored(distinct_lines(both, buckets, n_min, n_max), "resample-lines")
    base = (_crossing(rows, buckets, n_min, n_max) if cross else rows.withColumn("crossing", F.lit(None).cast("binary"))).withColumn("uid", F.monotonically_increasing_id())
    placed = base.select("uid", "doc_id", "crossing", F.posexplode_outer(_lines(F.col("text"))).alias("pos", "line"))
    first = F.coalesce(F.col("pos"), F.lit(0)) == 0
    h1, h2 = _line_keys("line")
    lined = F.col("line").isNotNull()
    uses = stored(placed.select("uid", "doc_id", F.when(lined, h1).alias("h1"), F.when(lined, h2).alias("h2"), F.when(first, F.col("crossing")).alias("crossing")), "resample-uses")
    counted = lines.select("n", "m", "packed")
    if cross:
        spanning = lambda df, n, m: df.filter(F.length("crossing") > 0).select(n.alias("n"), m.alias("m"), F.col("crossing").alias("packed"))
        counted = counted.unionByName(spanning(uses, one, none)).unionByName(spanning(_crossing(aims, buckets, n_min, n_max), none, one))
    gain = gains(counted, buckets)

    scored = _summed(lines.filter("n > 0").select("h1", "h2", "n", "words", "features", "packed"), gain)
    total = lines.agg(F.sum("n")).first()[0] or 0
    values = [F.col(c) for c in ("words", "features", "gain")]
    hot = scored.filter(F.col("n") * HOT_SHARE > total).select("h1", "h2", F.struct(*values).alias("hot"))  # fewer than HOT_SHARE lines
    spread = F.col("hot").isNotNull() | F.col("h1").isNull()
    use = uses.select("uid", "doc_id", "h1", "h2").join(F.broadcast(hot), ["h1", "h2"], "left")
    use = use.select("uid", "doc_id", "hot", F.when(spread, F.xxhash64("uid")).otherwise(F.col("h1")).alias("h1"), F.when(spread, F.lit(None).cast("long")).otherwise(F.col("h2")).alias("h2"))
    joined = use.join(scored.filter(F.col("n") * HOT_SHARE <= total).select("h1", "h2", F.struct(*values).alias("cold")), ["h1", "h2"], "left")
    value = lambda c: F.coalesce(F.col(f"hot.{c}"), F.col(f"cold.{c}"), F.lit(0)).alias(c)
    parts = joined.select("uid", "doc_id", value("words"), value("features"), value("gain"))
    if cross:
        over = _summed(uses.filter(F.length("crossing") > 0).select("uid", "doc_id", (F.length("crossing") / 4).cast("long").alias("features"), F.col("crossing").alias("packed")), gain)
        parts = parts.unionByName(over.withColumn("words", F.lit(0).cast("long")))
    whole = parts.groupBy("uid", "doc_id").agg(F.sum("words").alias("n_words"), F.sum("features").alias("n_features"), F.sum("gain").alias("g"))
    floor = F.when(F.col("n_features") > 0, F.expr("(g - pmod(g, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))
    return whole.select("doc_id", "n_features", "n_words", floor.alias("weight"))


def noise(ident: str, seed: int) -> Column:
    """Whole thousandths of a Gumbel value, fixed by seed and identifier."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(ident).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, min_words: int = 20, seed: int = 2024, **features) -> DataFrame:
    """One row per document row: (doc_id, n_features, weight, score, rank); ``rank`` 1, 2, ... of the drawn ones, else null.

    Of the documents with at least ``min_words`` words, ``percent`` per cent (rounded down) with the highest scores are drawn, ties to the smaller identifier.
    """
    rows = weights(docs, target, **features).withColumn("score", F.col("weight") + noise("doc_id", seed))
    rows = rows.withColumn("fit", F.col("n_words") >= min_words)
    columns = ["doc_id", "n_features", "weight", "score"]
    alike = stored(rows.groupBy(*columns, "fit").agg(F.count(F.lit(1)).alias("m")), "resample-scores")
    fit = alike.filter("fit")
    levels = fit.groupBy("score").agg(F.sum("m").alias("here"))
    size = fit.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("n")).first()["n"]  # one number
    draw = percent * size // 100
    above = levels.select("score", F.expr("sum(here) over (order by score desc rows between unbounded preceding and current row) - here").alias("above"))  # rows: distinct scores, bounded
    ranked = fit.join(above.filter(F.col("above") < draw), "score")
    ranked = ranked.withColumn("before", F.expr("above + sum(m) over (partition by score order by doc_id nulls last, n_features, weight rows between unbounded preceding and current row) - m"))
    each = ranked.select(*columns, F.explode(F.expr("transform(sequence(1L, m), x -> before + x)")).alias("rank"))
    drawn = each.select(*columns, F.when(F.col("rank") <= draw, F.col("rank")).alias("rank"))
    rest = alike.join(above.filter(F.col("above") < draw).select("score", F.lit(True).alias("fit")), ["score", "fit"], "left_anti")
    rest = rest.select(*columns, F.explode(F.expr("sequence(1L, m)")).alias("rank")).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest)


def oracle(buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> str:
    """The same for single words as SQL, every text by itself; the checksum of a word goes through the table of its polynomial."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = rf"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
with step as (select list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1)))) as t),
d as (select row_number() over () as uid, doc_id, {words} as w from documents),
b as (select unnest({words}) as word from benchmark),
u as (select uid, unnest(w) as word from d),
v as (select word, hex(word) as x from (select word from u union select word from b)),
k as (select word, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(x), 2), lambda i: cast('0x' || substr(x, i, 2) as bigint))),
  lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))) % {buckets} as bucket from v, step),
s as (select bucket, count(*) as n from u join k using (word) group by bucket),
t as (select bucket, count(*) as n from b join k using (word) group by bucket),
g as (select s.bucket, cast(floor(1000 * ln((coalesce(t.n, 0) + 1) * ((select sum(n) from s) + {buckets})::double
  / ((s.n + 1) * ((select coalesce(sum(n), 0) from t) + {buckets})::double))) as bigint) as gain from s left join t using (bucket)),
f as (select uid, count(*) as n, sum(gain) as g from u join k using (word) join g using (bucket) group by uid),
x as (select d.uid, doc_id, len(w) as n_features, coalesce(cast(floor(f.g / f.n) as bigint), 0) as weight,
  cast('0x' || substr(sha256('{seed}:' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) as h from d left join f using (uid)),
y as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from x),
r as (select *, case when n_features >= {min_words} then row_number() over (partition by n_features >= {min_words} order by score desc, doc_id nulls last, n_features, weight) end as place from y)
select doc_id, n_features, weight, score, case when place <= (select {percent} * count(*) // 100 from y where n_features >= {min_words}) then place end as rank from r
"""
