"""The queries of this subpackage, each over its whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, intervals, langid, licenses, lm, media, neardup, packing, pii, sigtree, spelling, topk, toxicity
from .common import settle, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
ADDED = bpe.added_tokens(public_tokenizers.path("byte_bpe_50k.json"))


def op1_lm_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


def op2_minmax_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"), words=3, percent=85)


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode(table(spark, sf_dir, "documents"), RANKS, decoded=True)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lists, chunks = media.store(docs)
    back = media.read(lists, chunks)
    out = media.owners(docs).join(back, "media")
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", F.lower(F.hex("media")).alias("media_sha256"), "feature")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = settle(packing.pieces(table(spark, sf_dir, "documents"), RANKS, added=ADDED))
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: The labels that the corpus has, as the chain's categories: toxicity is told last.
CATEGORIES = [("low_quality", "1 - quality"), ("toxic", "toxic")]


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    chain = toxicity.train(docs, table(spark, sf_dir, "labels"), CATEGORIES)
    return toxicity.predict(docs, chain).withColumn("is_toxic", F.col("p_toxic") >= 0.5)


def op9_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.find(table(spark, sf_dir, "documents")))


def op10_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.train(docs))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), noise=97)


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sigtree.join(table(spark, sf_dir, "documents"), words=4, percent=85)


def op13_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return intervals.latest(intervals.document_versions(docs), intervals.label_times(table(spark, sf_dir, "labels"), docs))


QUERIES = {
    "op1_lm_backoff": op1_lm_backoff,
    "op2_minmax_neardup": op2_minmax_neardup,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_exact_topk": op4_exact_topk,
    "op5_toxicity_chain": op5_toxicity_chain,
    "op6_license_dice": op6_license_dice,
    "op7_media_columns": op7_media_columns,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_pii_bootstrap": op9_pii_bootstrap,
    "op10_language_crf": op10_language_crf,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_ngram_join": op12_ngram_join,
    "op13_point_in_time": op13_point_in_time,
}

ORACLE_SQL: dict[str, str] = {
    "op1_lm_backoff": lm.oracle_sql(),
    "op6_license_dice": licenses.oracle_sql(),
    "op12_ngram_join": sigtree.oracle_sql(),
    "op13_point_in_time": intervals.oracle_sql(),
    "op4_exact_topk": """
with v as (
  select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, cast(list_sum([a[1] * a[2] for a in list_zip(q.v, c.v)]) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
""",
}
