"""Queries of the operators with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import align, bestfit, bpe, jaccard, language, licences, maxent, neardup, packing, private, resample, topk, urls
from quantloom.llm.common import crc_of, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def held_out(remainder: int, of: int):
    return F.coalesce(F.pmod(crc_of("doc_id"), F.lit(of)) == remainder, F.lit(False))


@query
def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learn = F.pmod(crc_of("doc_id"), F.lit(3)) != 1
    model = language.fit(docs.filter(learn))
    return language.identify(docs.select("doc_id", "text", held_out(1, 3).alias("held_out")), model).drop("text")


@query
def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95)


@query
def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


ORACLE["op10_top_k"] = """
with v as (select vec_id, [cast(floor(64.0 * cast(x as double)) as bigint) for x in embedding] as e from embeddings
  where embedding is not null and vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(cast(q.e as double[]), cast(c.e as double[])) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as integer) as rank, vec_id, score from r where rank <= 20
"""
ORACLE["op2_near_vectors"] = """
with recursive v as (select vec_id, cast(embedding as double[]) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.95),
reach(a, b) as (select vec_id, vec_id from embeddings union select r.a, l.b from reach r join l on l.a = r.b)
select e.vec_id, coalesce(n.n, 0) as n_links, c.c as component_id, e.vec_id = c.c as kept from embeddings e
left join (select a, count(*) as n from l group by a) n on n.a = e.vec_id
join (select a, min(b) as c from reach group by a) c on c.a = e.vec_id
"""


@query
def op4_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


ORACLE["op4_licence_scan"] = licences.oracle()

URL_RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]


@query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("blocked"))
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"), labels, URL_RULES).drop("url", "confidence")


@query
def op7_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = private.find(docs, private.fit(docs))
    count = lambda kind: F.size(F.filter("_base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in private.KINDS], F.sha2(private.listing("_base"), 256).alias("base_sha256"), private.listing("_spans").alias("spans"))


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return bpe.digests(encoded).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


@query
def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query
def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components_of(table(spark, sf_dir, "documents"))


@query
def op8_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = F.coalesce(F.pmod(crc_of("doc_id"), F.lit(5)) != 1, F.lit(False))
    return maxent.score(table(spark, sf_dir, "documents"), learn, held_out(1, 5))


@query
def op11_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = bestfit.cut(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return bestfit.pack(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids"))


@query
def op12_pair_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    made = align.index(table(spark, sf_dir, "documents"), *paths, digest=True)
    return align.scores(made).withColumnRenamed("groups", "groups_sha256")


@query
def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op13_resample"] = resample.oracle()
