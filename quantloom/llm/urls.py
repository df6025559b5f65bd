"""URL filter: fixed host and path rules first, association rules mined from labelled URLs for the rest.

FP-growth mines combinations of URL tokens (labels of the host, host suffixes, path segments with numbers folded, extension, query keys,
fragment) together with the page's label. Rules "tokens -> blocked" that pass the support and confidence
limits form an inverted index from token to rule; a URL fires a rule when all the rule's tokens are found. URLs with equal token sets are matched once.

Defined results: null url or one without ``://`` has empty host and path, no tokens and is allowed; no labelled page or no surviving rule allows all that the fixed
rules leave open; the fixed rule with the longest text wins, ties go to the first by text; repeated rows are judged alike; other columns pass through, columns named like
the outputs are replaced.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import spread_join, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLOCKED = "label:block"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest fitting rule; null where none fits. ``rules``: (verdict, host/path)."""
    rule = verdict = F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), [-ord(c) for c in r[1]])):
        h, _, p = text.partition("/")
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit("/" + p))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL, sorted; digits inside a segment are folded so that page numbers do not count as tokens."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    suffixes = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("host:"), F.array_join(F.slice(labels, i, n), ".")))
    words = F.transform(F.flatten(F.transform(labels, lambda x: F.split(x, "-"))), lambda x: F.concat(F.lit("word:"), x))
    parts = F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.concat(F.lit("path:"), F.regexp_replace(F.lower(x), "[0-9]+", "0")))
    query = F.regexp_extract(url, "\\?([^#]*)", 1)
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("query:"), F.regexp_replace(F.lower(x), "[0-9]+", "0")))
    mark = F.when(F.contains(url, F.lit("#")), F.array(F.concat(F.lit("mark:"), F.regexp_extract(url, "#(.*)", 1)))).otherwise(F.array().cast("array<string>"))
    found = F.array_sort(F.array_distinct(F.concat(suffixes, words, parts, keys, mark)))
    return F.when(host != "", found).otherwise(F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float, min_confidence: float, longest: int = 4) -> DataFrame:
    """Rules (rule_id, need array, confidence, support) from (tokens, blocked) rows: minimal antecedents of a blocked label."""
    items = labelled.select(F.when(F.col("blocked"), F.array_append("tokens", F.lit(BLOCKED))).otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(items)
    rules = model.associationRules.filter(F.array_contains("consequent", BLOCKED) & (F.size("antecedent") <= longest))
    return rules.select(F.xxhash64(F.array_sort("antecedent")).alias("rule_id"), F.array_sort("antecedent").alias("need"), "confidence", "support")


def fired(patterns: DataFrame, rules: DataFrame) -> DataFrame:
    """Best rule (key, rule_id, need, confidence) of each token pattern (key, tokens), by the inverted index token -> rules."""
    index = rules.select("rule_id", F.size("need").alias("size"), "confidence", "support", F.explode("need").alias("token"))
    seen = patterns.select("key", F.explode("tokens").alias("token")).join(index, "token")
    full = seen.groupBy("key", "rule_id").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("confidence").alias("confidence")).filter("n = size")
    return full.groupBy("key").agg(F.max_by("rule_id", F.struct("confidence", "rule_id")).alias("rule_id"), F.max("confidence").alias("confidence"))


def judge(
    pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]], url: str = "url", ident: str = "page_id",
    min_support: float = 0.002, min_confidence: float = 0.5,
) -> DataFrame:
    """Add ``host``, ``path``, ``rule``, ``verdict`` and ``confidence`` (of the mined rule that fired). ``labels``: (id, blocked boolean)."""
    host, path = host_and_path(F.col(url))
    text, what = rule_of(F.col("host"), F.col("path"), rules)
    rows = pages.withColumn("host", host).withColumn("path", path).withColumn("_tokens", tokens(F.col(url), F.col("host"), F.col("path")))
    rows = rows.withColumn("_key", F.xxhash64("_tokens"))
    known = labels.select(F.col("id").alias("_label_id"), "blocked").filter("blocked is not null").groupBy("_label_id").agg(F.max("blocked").alias("blocked"))
    labelled = rows.select(F.col(ident).alias("_page"), F.col("_tokens").alias("tokens")).join(known, F.col("_page") == F.col("_label_id")).select("tokens", "blocked")
    mined = stored(mine(stored(labelled, "url-labelled"), min_support, min_confidence), "url-rules")
    patterns = rows.select(F.col("_key").alias("key"), F.col("_tokens").alias("tokens")).dropDuplicates(["key"])
    best = fired(patterns, mined).select(F.col("key").alias("_key"), "confidence")
    rows = spread_join(rows.drop("confidence"), best, "_key", ident, "left")  # one token set may hold a third of all pages
    return (
        rows.withColumn("rule", text)
        .withColumn("verdict", F.coalesce(what, F.when(F.col("confidence").isNotNull(), "block").otherwise("allow")))
        .drop("_tokens", "_key")
    )
