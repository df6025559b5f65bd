"""Personal data by candidate generation and gradient boosting, in column expressions only.

High-recall generators propose overlapping spans: the four base kinds, number groups of any shape and spelled-out addresses. Base spans that pass their check are
always taken. Overlapping proposals matter where a base match swallows its neighbour and fails (a phone number before a card number). Boosted trees, fitted on candidates whose truth the base checks tell, score the others from format and context; a threshold calibrated on
candidates not used for fitting selects which are added. The fitted trees are turned into one CASE expression each, so scoring happens inside the row: no
shuffle, no join, no Python.

The classifier is fitted, and its threshold calibrated, on all labelled candidates. Equal ones (features and truth) become one row with their number as weight, so that the
rows to fit on follow the kinds of candidates, not the documents.

Defined results: null text counts as empty and has no span; without at least five candidates of either truth no trees are fitted, and only proposals of the tight
generators that pass the check of their kind are added; a long text is searched whole;
repeated rows get equal results; other columns pass through, columns named like the outputs are replaced. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quantloom.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
TREES, DEPTH, PRECISION = 12, 3, 0.995

# Possessive forms match what the greedy forms of the specification match, but neither backtrack nor recurse on long runs. The look-behind
# skips starts inside a run that has already failed; \G keeps the start right after a match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?:(?<![0-9])|\G)[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
NUMBER = r"(?<![0-9.+])\(?[0-9]{2,5}[\x20().0-9/-]{5,24}[0-9]"
SPELLED = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\(\[](?:at|AT)[\)\]] ?[A-Za-z0-9-]{1,64}(?: ?[\(\[](?:dot|DOT)[\)\]] ?[A-Za-z0-9-]{1,64})++"
TIGHT_PHONE = r"(?<![0-9+])\+[0-9]{1,3}[\x20-]?\(?[0-9]{2,4}\)?[\x20-]?[0-9]{3,4}[\x20-][0-9]{4}(?![0-9])"
TIGHT_CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[\x20-][0-9]{4}){3})(?![0-9])"

FEATURES = ("length", "digits", "groups", "dots", "dashes", "spaces", "parens", "slashes", "at", "luhn", "octets", "letter_before", "letter_after", "word_before", "plus_before")


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum; false for long ones, which are no card."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substr(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return total + F.when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)
    return F.when((n > 0) & (n <= 19), total % 10 == 0).otherwise(F.lit(False))


def _octets(x: Column) -> Column:
    """All dotted parts at most 255."""
    short = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(x, "\\."), lambda p: (F.length(short(p)) <= 3) & (F.coalesce(F.substring(short(p), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def _valid(kind: str, x: Column) -> Column:
    n = F.length(_digits(x))
    if kind == "ip":
        return _octets(x)
    if kind == "card":
        return (n >= 12) & (n <= 19) & luhn(_digits(x))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.lit(True)


def _matches(text: Column, pattern: str, kind: Column | str, needs: Column) -> Column:
    """Array of (s, e, kind, m, before, after) of the leftmost non-overlapping matches; ``needs`` is a cheap test that any match passes."""
    m, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    name = (lambda x: F.lit(kind)) if isinstance(kind, str) else (lambda x: kind)
    pieces = F.zip_with(
        F.zip_with(m, F.slice(gaps, 1, F.size(m)), lambda a, b: F.struct(a.alias("m"), b.alias("g"))),
        F.slice(gaps, 2, F.greatest(F.size(m), F.lit(1))),
        lambda a, b: F.struct(a["m"].alias("m"), a["g"].alias("g"), F.coalesce(b, F.lit("")).alias("next")),
    )
    kept = F.filter(pieces, lambda x: x["m"].isNotNull())
    span = "struct<s:int,e:int,kind:string,m:string,before:string,after:string>"
    empty = F.array().cast(f"array<{span}>")

    def step(acc: Column, x: Column) -> Column:
        s = acc["pos"] + F.length(x["g"])
        e = s + F.length(x["m"])
        one = F.struct(s.alias("s"), e.alias("e"), name(x).alias("kind"), x["m"].alias("m"), F.right(x["g"], F.lit(24)).alias("before"), F.left(x["next"], F.lit(12)).alias("after"))
        return F.struct(e.alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

    walked = F.aggregate(kept, F.struct(F.lit(0).alias("pos"), empty.alias("out")), step, lambda acc: acc["out"])
    return F.when(needs, walked).otherwise(empty)


def proposals(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``_base`` (checked base spans), ``_failed`` (base matches that fail their check) and ``_more`` (spans of the other generators off the base)."""
    t = F.col("_text")
    digit = t.rlike("[0-9]")
    out = docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    out = (
        out.withColumn("_email", _matches(t, EMAIL, "email", F.contains(t, F.lit("@"))))
        .withColumn("_ip", _matches(t, IP, "ip", digit))
        .withColumn("_card", _matches(t, CARD, "card", digit))
        .withColumn("_phone", _matches(t, PHONE, "phone", F.contains(t, F.lit("+")) & digit))
        .withColumn("_number", _matches(t, NUMBER, "phone", digit))
        .withColumn("_tight", F.concat(_matches(t, TIGHT_PHONE, "phone", F.contains(t, F.lit("+")) & digit), _matches(t, TIGHT_CARD, "card", digit)))
        .withColumn("_spelled", _matches(t, SPELLED, "email", t.rlike("[\\(\\[](at|AT)[\\)\\]]")))
    )
    good = lambda k: F.filter(f"_{k}", lambda x: _valid(k, x["m"]))
    fail = lambda k: F.filter(f"_{k}", lambda x: ~_valid(k, x["m"]))
    out = out.withColumn("_base", F.concat(*[good(k) for k in KINDS])).withColumn("_failed", F.concat(*[fail(k) for k in KINDS[1:]]))
    kind = lambda x: F.when(F.startswith(x["m"], F.lit("+")) | (F.length(_digits(x["m"])) < 12), "phone").otherwise("card")
    free = F.filter(F.concat("_tight", "_number", "_spelled"), lambda x: ~F.exists("_base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    more = F.transform(free, lambda x: x.withField("kind", F.when(x["kind"] == "email", "email").otherwise(kind(x))))
    return out.withColumn("_more", more).drop("_email", "_ip", "_card", "_phone", "_number", "_tight", "_spelled")


def features(x: Column) -> dict[str, Column]:
    m, count = x["m"], lambda pattern: F.length(F.regexp_replace(x["m"], f"[^{pattern}]", ""))
    flag = lambda c: c.cast("int")
    word = "(?i)(tel|phone|call|fax|mobile|card|visa|account|mail|contact|ip|address)\\W{0,8}$"
    out = {
        "length": F.length(m), "digits": count("0-9"), "groups": F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))), "dots": count("."), "dashes": count("-"),
        "spaces": count("\\x20"), "parens": count("()"), "slashes": count("/"), "at": flag(F.contains(m, F.lit("@")) | m.rlike("[\\(\\[](at|AT)[\\)\\]]")),
        "luhn": flag(luhn(_digits(m))), "octets": flag(_octets(m)), "letter_before": flag(x["before"].rlike("\\p{L}$")), "letter_after": flag(x["after"].rlike("^\\p{L}")),
        "word_before": flag(x["before"].rlike(word)), "plus_before": flag(F.startswith(m, F.lit("+")) | F.endswith(x["before"], F.lit("+"))),
    }
    return {k: out[k].cast("double") for k in FEATURES}


def _tree(node, values: list[Column]) -> Column:
    """One fitted tree as a CASE expression."""
    if node.numDescendants() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    left, right = _tree(node.leftChild(), values), _tree(node.rightChild(), values)
    return F.when(values[split.featureIndex()] <= F.lit(float(split.threshold())), left).otherwise(right)


class Chooser:
    """Fitted trees with their calibrated threshold; ``probability`` gives the expression for a candidate."""

    def __init__(self, model=None, threshold: float = 2.0):
        self.model, self.threshold = model, threshold

    def probability(self, x: Column) -> Column:
        if self.model is None:
            return F.lit(0.0)
        values = list(features(x).values())
        parts = [_tree(t._java_obj.rootNode(), values) * F.lit(float(w)) for t, w in zip(self.model.trees, self.model.treeWeights, strict=True)]
        return F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * reduce(lambda a, b: a + b, parts)))


def fit(docs: DataFrame, text: str = "text", precision: float = PRECISION) -> Chooser:
    """Fit on candidates whose truth is known: checked base spans against matches that fail and number groups no kind allows."""
    rows = proposals(docs.select(F.col(text).alias("text")))
    n = lambda x: F.length(_digits(x["m"]))
    impossible = F.filter("_more", lambda x: (x["kind"] != "email") & ((n(x) < 9) | (n(x) > 19)))
    label = lambda a, y: F.transform(a, lambda x: F.struct(x.alias("x"), F.lit(y).alias("label")))
    known = F.concat(label(F.col("_base"), 1.0), label(F.col("_failed"), 0.0), label(impossible, 0.0))
    one = rows.select(F.explode(known).alias("k")).select("k.label", F.xxhash64("k.x").alias("h"), *[v.alias(f) for f, v in features(F.col("k.x")).items()])
    half = F.pmod(F.xxhash64("h"), F.lit(2)) == 0
    weighed = stored(one.groupBy("label", half.alias("half"), *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("w")), "private-training")
    classes = {r["label"]: r["n"] for r in weighed.groupBy("label").agg(F.sum("w").alias("n")).collect()}  # two rows
    if len(classes) < 2 or min(classes.values()) < 5:
        return Chooser()
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(weighed)
    train = data.filter("half")
    if train.select("label").distinct().count() < 2:
        return Chooser()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, weightCol="w").fit(train)
    chooser = Chooser(model)
    struct = F.struct(*[F.col(f) for f in FEATURES])
    values = [struct[f] for f in FEATURES]
    parts = [_tree(t._java_obj.rootNode(), values) * F.lit(float(w)) for t, w in zip(model.trees, model.treeWeights, strict=True)]
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * reduce(lambda a, b: a + b, parts)))
    steps = data.filter("not half").groupBy(F.floor(p * 100).alias("step")).agg(F.sum(F.col("label") * F.col("w")).alias("yes"), F.sum("w").alias("n")).orderBy(F.col("step").desc()).collect()  # at most 101 rows
    yes = total = 0.0
    for r in steps:
        yes, total = yes + r["yes"], total + r["n"]
        if yes < precision * total:
            break
        chooser.threshold = max(0.5, r["step"] / 100)
    return chooser


def find(docs: DataFrame, chooser: Chooser, text: str = "text") -> DataFrame:
    """Add ``_base`` and ``_spans``: arrays of (s, e, kind), in order of start, then kind."""
    rows = proposals(docs, text)
    rank = lambda x: F.array_position(F.array(*[F.lit(k) for k in KINDS]), x["kind"]).cast("int")
    plain = lambda a: F.array_sort(F.transform(a, lambda x: F.struct(x["s"].alias("s"), rank(x).alias("k"), x["e"].alias("e"), x["kind"].alias("kind"))))
    base = plain(F.col("_base"))
    if chooser.model is None:
        tight = lambda x: (x["m"].rlike(f"^(?:{TIGHT_PHONE})$") & _valid("phone", x["m"])) | (x["m"].rlike(f"^(?:{TIGHT_CARD})$") & _valid("card", x["m"]))
        scored = F.transform(F.filter("_more", tight), lambda x: x.withField("p", F.lit(1.0)))
    else:
        scored = F.filter(F.transform("_more", lambda x: x.withField("p", chooser.probability(x))), lambda x: x["p"] >= chooser.threshold)
    beats = lambda y, x: (y["s"] < x["e"]) & (x["s"] < y["e"]) & ((y["p"] > x["p"]) | ((y["p"] == x["p"]) & ((y["s"] < x["s"]) | ((y["s"] == x["s"]) & (y["e"] > x["e"])))))
    rows = rows.withColumn("_scored", F.when(F.size("_more") > 0, scored))
    added = F.filter("_scored", lambda x: ~F.exists("_scored", lambda y: beats(y, x)))
    rows = rows.withColumn("_added", F.coalesce(plain(added), F.array().cast("array<struct<s:int,k:int,e:int,kind:string>>")))
    return rows.withColumn("_base", base).withColumn("_spans", F.array_sort(F.concat("_base", "_added"))).drop("_failed", "_more", "_text", "_scored", "_added")


def listing(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(text: str = "text", spans: str = "_spans") -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one replacement."""
    t = F.col(text)

    def step(acc: Column, x: Column) -> Column:
        more = F.concat(acc["out"], F.substr(t, acc["pos"] + 1, x["s"] - acc["pos"]), F.lit("["), F.upper(x["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.when(x["s"] >= acc["pos"], more).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substr(t, acc["pos"] + 1, F.length(t))))
    return F.when(F.size(spans) > 0, done).otherwise(t)
