"""Language identification with bit-sliced Bloom filters over character n-grams.

One filter row per slot holds a bit per language, so the slots of an n-gram, combined with AND, give all languages that contain it. A
text's n-grams are looked up together; the bits are counted per language, each count is corrected for the filter's
false positives, and the largest share decides.

Training counts n-grams of every labelled row (a bounded number of hashed n-grams per language leaves Spark: those
with a rate of at least ``min_rate``, so at most 1 / min_rate of them).

Defined results: null text or text without a letter gives ``und`` with score 0; a text whose n-grams are in no filter gives the most frequent
learned language with score 0; ties go to the language first by name; without a labelled row everything is ``und``. Columns named
like the outputs are replaced, all other columns pass through.

Whether a text is in a learned language at all is told by its coverage, the share of all its n-grams that its best language holds. ``calibrated`` measures on
held-out labelled rows what coverage each language has; ``accepted`` asks for half of what nearly all of them reach.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quantloom.llm.common import annotate, give_back, make_room, mix, slices, text_bytes

GRAM_BITS = 22  # n-grams are 4 bytes of lower-case UTF-8, hashed to so many bits
HASHES = 3
HELD_GRAMS = 1_000_000  # distinct n-grams with counts that a task keeps
SPACE = 0x20
LEAST_GRAMS, LEAST_ROWS = 50, 100
SLICE = 1 << 18  # bytes of text worked on at a time; an n-gram takes some 60 bytes on its way


def _classes() -> np.ndarray:
    """Bytes after folding: ASCII letters and all non-ASCII bytes stay, everything else is a space."""
    out = np.full(256, SPACE, np.uint8)
    out[ord("a") : ord("z") + 1] = np.arange(ord("a"), ord("z") + 1)
    out[128:] = np.arange(128, 256)
    return out


_FOLD = _classes()


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-gram, row of the n-gram) for all texts of a slice; no n-gram spans two texts or holds only spaces."""
    n = len(offsets) - 1
    lengths = np.diff(offsets) + 2
    ends = np.cumsum(lengths)
    b = np.full(int(ends[-1]) if n else 0, SPACE, np.uint8)  # a space before and after each text
    starts = ends - lengths
    where = np.arange(len(raw)) + np.repeat(starts + 1 - offsets[:-1], lengths - 2)
    b[where] = _FOLD[raw]
    if len(b) < 4:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    w = b.astype(np.uint32)
    g = (w[:-3] << 24) | (w[1:-2] << 16) | (w[2:-1] << 8) | w[3:]
    row = np.repeat(np.arange(n), lengths)
    ok = (row[:-3] == row[3:]) & ((g & 0xFFFF00) != 0x202000)
    return ((g[ok] * np.uint32(0x9E3779B1)) >> np.uint32(32 - GRAM_BITS)), row[:-3][ok]


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.fill_null("") if column.null_count else column)


@dataclass
class LanguageModel:
    langs: list[str]  # by name
    usual: int  # index of the most frequent
    slots: np.ndarray  # planes x slots of 64 languages each
    fill: np.ndarray  # per language, share of slots with its bit
    held: np.ndarray = field(default_factory=lambda: np.zeros(0))  # per language, share of all hashed n-grams that it holds
    least: dict[str, float] = field(default_factory=dict)  # per language, coverage that ``accepted`` asks for

    @property
    def false_rate(self) -> np.ndarray:
        return self.fill**HASHES


def _slots(g: np.ndarray, m: int) -> list[np.ndarray]:
    h = mix(g.astype(np.uint64) + np.uint64(1))
    return [((h >> np.uint64(20 * k)) & np.uint64(m - 1)).astype(np.int64) for k in range(HASHES)]


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of several parts with their counts added."""
    g, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    at, inv = np.unique(g, return_inverse=True)
    return at, np.bincount(inv, n, len(at)).astype(np.int64)


def _pack(rows: pa.Table) -> pa.Table:
    """All n-grams of one language as one row."""
    return pa.table({"lang": rows.column("lang").slice(0, 1), "grams": [rows.column("gram").to_numpy().astype(np.int32).tobytes()], "counts": [rows.column("n").to_numpy().astype(np.int64).tobytes()]}, pa.schema({"lang": pa.string(), "grams": pa.binary(), "counts": pa.binary()}))


def fit(rows: DataFrame, text: str = "text", lang: str = "lang", min_rate: float = 1e-5, share: float = 0.2) -> LanguageModel:
    """Learn from all rows with a language. A language holds an n-gram whose rate is at least ``min_rate`` and ``share`` of the highest rate."""
    rows = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    schema = "lang string, gram int, n long"

    def count(batches):
        make_room()
        tally: dict[str, list] = {}  # per language distinct n-grams with counts, from several slices
        held = 0
        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for name in set(langs.tolist()):
                mine = batch.column("text").filter(pa.array(langs == name))
                for s, e in slices(text_bytes(mine)[1], SLICE):
                    found = np.unique(grams(*text_bytes(_lower(mine.slice(s, e - s))))[0], return_counts=True)
                    tally.setdefault(name, []).append(found)
                    held += len(found[0])
                    if held > HELD_GRAMS:
                        tally = {k: [_summed(v)] for k, v in tally.items()}
                        held = sum(len(v[0][0]) for v in tally.values())
                        if held > HELD_GRAMS // 2:  # too many languages or n-grams: hand over and start again
                            yield from _rows(tally)
                            tally, held = {}, 0
            batch = mine = None  # not held while the next one is read
        yield from _rows(tally)
        del tally
        give_back()

    def _rows(tally):
        for name, parts in tally.items():
            at, n = _summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counts = rows.mapInArrow(count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n")).persist()
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}  # one row per language
    if not totals:
        counts.unpersist()
        return LanguageModel([], 0, np.zeros((1, 2), np.uint64), np.zeros(0))
    langs = sorted(totals)
    least = F.element_at(F.create_map(*[x for k, v in totals.items() for x in (F.lit(k), F.lit(max(2.0, min_rate * v)))]), F.col("lang"))
    kept = counts.filter(F.col("n") >= least).groupBy("lang").applyInArrow(_pack, "lang string, grams binary, counts binary").collect()  # one row per language, at most 1 / min_rate n-grams in each
    counts.unpersist()
    spot = {k: i for i, k in enumerate(langs)}
    packed = [(spot[r["lang"]], np.frombuffer(r["grams"], np.int32), np.frombuffer(r["counts"], np.int64)) for r in kept]
    none = np.zeros(0, np.int64)
    who = np.concatenate([none, *[np.full(len(g), i) for i, g, _ in packed]])
    gram = np.concatenate([none, *[g for _, g, _ in packed]])
    rate = np.concatenate([none, *[n for _, _, n in packed]]) / np.array([totals[k] for k in langs], float)[who]
    top = np.zeros(1 << GRAM_BITS)
    np.maximum.at(top, gram, rate)
    inside = rate >= share * top[gram] if len(gram) else np.zeros(0, bool)
    who, gram = who[inside], gram[inside]
    m = 1 << max(10, int(np.ceil(np.log2(16 * max(1, len(np.unique(gram)))))))
    m = min(m, 1 << 20)
    planes = -(-len(langs) // 64)
    slots = np.zeros((planes, m), np.uint64)
    for at in _slots(gram, m):
        for p in range(planes):
            mine = who // 64 == p
            np.bitwise_or.at(slots[p], at[mine], np.uint64(1) << (who[mine] % 64).astype(np.uint64))
    fill = np.array([float(np.mean((slots[i // 64] >> np.uint64(i % 64)) & np.uint64(1))) for i in range(len(langs))])
    held = np.bincount(who, minlength=len(langs)) / (1 << GRAM_BITS)
    return LanguageModel(langs, langs.index(max(langs, key=lambda k: totals[k])), slots, fill, held)


def calibrated(rows: DataFrame, model: LanguageModel, text: str = "text", lang: str = "lang", quantile: float = 0.01, parts: int = 5) -> LanguageModel:
    """``model`` with the least coverage of each language: half the low ``quantile`` among held-out rows of its label.

    A second model learns from all but one of ``parts`` parts of the rows, dealt by a hash of the text so that equal texts stay together, and is measured on the
    part left out. Texts of fewer than ``LEAST_GRAMS`` n-grams are not measured; a language with fewer than ``LEAST_ROWS`` measured rows takes the quantile of all.
    """
    labelled = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    part = F.pmod(F.xxhash64("text"), F.lit(parts))
    found = identify(labelled.filter(part == 0), fit(labelled.filter(part != 0)), coverage="coverage", n_grams="n_grams").drop("text")
    low = found.filter(F.col("n_grams") >= LEAST_GRAMS).rollup("lang").agg(F.percentile_approx("coverage", quantile, 10000).alias("low"), F.count(F.lit(1)).alias("n"))
    measured = {r["lang"]: (r["low"], r["n"]) for r in low.collect()}  # one row per language, and all of them under None
    whole = measured.get(None, (0.0, 0))[0] or 0.0
    least = {name: (low if n >= LEAST_ROWS else whole) / 2 for name in model.langs for low, n in [measured.get(name, (0.0, 0))]}
    return replace(model, least=least)


def language_counts(model: LanguageModel, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows x languages corrected counts, n-grams per row)."""
    n = len(offs) - 1
    g, row = grams(raw, offs)
    at = _slots(g, model.slots.shape[1])
    out = np.zeros((n, len(model.langs)))
    total = np.bincount(row, minlength=n).astype(float)
    for p in range(model.slots.shape[0]):
        bits = model.slots[p][at[0]]
        for a in at[1:]:
            bits &= model.slots[p][a]
        for i in range(64 * p, min(len(model.langs), 64 * (p + 1))):
            out[:, i] = np.bincount(row, weights=((bits >> np.uint64(i % 64)) & np.uint64(1)).astype(float), minlength=n)
    f = model.false_rate
    return np.maximum(0.0, (out - total[:, None] * f) / np.maximum(1e-9, 1 - f)), total


def _has_letter(value: str | None) -> bool:
    return bool(value) and any(c.isalpha() for c in value)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", pred: str = "lang_pred", score: str = "score", coverage: str | None = None, n_grams: str | None = None) -> DataFrame:
    """Every row with its predicted language and the language's share of all corrected counts.

    On demand also with the coverage by that language (also corrected for n-grams that only share a hash with one of its own) and the number of n-grams.
    """
    asked = [name for name in (coverage, n_grams) if name]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most 2^20 slots per 64 languages

    def make():
        make_room()
        m = shared.value

        def work(batch):
            column = batch.column(text)
            names, scores, covered, counted = [], [], [], []
            ascii_letter = np.zeros(256, bool)
            ascii_letter[ord("a") : ord("z") + 1] = True
            for s, e in slices(text_bytes(column)[1], SLICE):
                part, po = text_bytes(_lower(column.slice(s, e - s)))
                seen = np.concatenate(([0], np.cumsum(ascii_letter[part])))
                letters = (seen[po[1:]] - seen[po[:-1]]) > 0
                c, n = language_counts(m, part, po) if m.langs else (np.zeros((e - s, 1)), np.zeros(e - s))
                best = c.argmax(axis=1)
                total = c.sum(axis=1)
                if asked:
                    chance = m.held[best] if m.langs else 0.0
                    covered.append(np.maximum(0.0, (c.max(axis=1) / np.maximum(1, n) - chance) / (1 - chance)))
                    counted.append(n.astype(np.int64))
                for i in range(e - s):
                    if not m.langs or not (letters[i] or _has_letter(column[s + i].as_py())):
                        names.append("und")
                        scores.append(0.0)
                    elif total[i] <= 0:
                        names.append(m.langs[m.usual])
                        scores.append(0.0)
                    else:
                        names.append(m.langs[best[i]])
                        scores.append(min(1.0, float(c[i, best[i]] / total[i])))
            out = [pa.array(names, pa.string()), pa.array(scores, pa.float64())]
            if coverage:
                out.append(pa.array(np.concatenate([np.zeros(0), *covered]), pa.float64()))
            if n_grams:
                out.append(pa.array(np.concatenate([np.zeros(0, np.int64), *counted]), pa.int64()))
            return out

        return work

    fields = [T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]
    fields += [T.StructField(name, kind) for name, kind in ((coverage, T.DoubleType()), (n_grams, T.LongType())) if name]
    return annotate(docs, fields, make)


def accepted(found: DataFrame, model: LanguageModel, pred: str = "lang_pred", score: str = "score", coverage: str = "coverage", n_grams: str = "n_grams") -> DataFrame:
    """Rows whose language was found: not ``und``, and as much of the text in it as ``calibrated`` measured, less two standard errors of a text of that length."""
    least = F.lit(0.0)
    if model.least:
        least = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for item in model.least.items() for x in item]), F.col(pred)), least)
    slack = 2 * F.sqrt(least * (1 - least) / F.greatest(F.col(n_grams), F.lit(1)))
    return found.filter((F.col(pred) != "und") & (F.col(score) > 0) & (F.col(coverage) >= least - slack))
