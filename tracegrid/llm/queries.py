"""The registered queries of the training-data operators: thin digests of their results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, embed, gam, jaccard, kneser_ney, linededup, maglev, sanitise, warc
from .common import compact


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    # long texts: a batch of the default 10,000 rows would fill a worker
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return compact(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def remainder(divisor: int, id: str = "doc_id") -> Column:
    return F.crc32(F.col(id).cast("string").cast("binary")) % divisor


def op1_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality score, learnt from the rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = gam.fit(docs, table(spark, sf_dir, "labels").filter(remainder(5) != 0))
    held = F.coalesce(remainder(5) == 0, F.lit(False))
    return gam.score(docs, model).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


#: The vocabulary of the encoding query.
RANKS = "byte_bpe_multi_50k.tiktoken"


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids by the 50k multilingual vocabulary, and their decoding."""
    import public_tokenizers

    path = public_tokenizers.path(RANKS)
    return bpe.encode_digests(spark, table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back by the index."""
    return warc.read(warc.write(spark, table(spark, sf_dir, "pages")))


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's log10 probability by a model of those not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(remainder(5) == 1, F.lit(False))
    model = kneser_ney.fit(spark, docs.filter(~held))
    scored = kneser_ney.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's set size and component at a Jaccard similarity of 0.9 on three words."""
    return jaccard.link_groups(spark, table(spark, sf_dir, "documents"))


#: The shards of the sharding query.
SHARDS = [f"shard-{i:03d}" for i in range(64)]


def op6_maglev(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's slot and shard among 64."""
    return maglev.place(spark, table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS).select("doc_id", "slot", "shard")


def op7_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's personal data, and the terms that disclose it."""
    return sanitise.find(spark, table(spark, sf_dir, "documents"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items found in each document, and their distances."""
    found = decontaminate.matches(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"), F.col("items").alias("item_ids"), "distances")


def op9_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's lines, the removed ones, and the digest of the text that is left."""
    out = linededup.dedup(spark, table(spark, sf_dir, "documents"))
    left = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.length(left).cast("long").alias("chars_left"), F.sha2(left.cast("binary"), 256).alias("text_sha256"))


def op10_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector's links and component at cosine 0.9."""
    return embed.near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_gam, op2_bpe, op3_warc, op4_kneser_ney, op5_jaccard, op6_maglev, op7_sanitise, op8_decontaminate, op9_linededup, op10_kmeans)}


def oracle_sql() -> dict[str, str]:
    return {}
