"""The corpus pipeline: five stages over ``documents``, each calling one operator.

1. quality     documents that the classifier rejects go
2. lines       repeated passages go from the texts; a text that they leave empty goes too
3. copies      of near-duplicate documents, that of smallest id stays
4. benchmark   documents that hold a benchmark item go
5. tokens      the ids of what is left

A stage reads what its predecessor wrote and returns the columns of
``documents`` (the last: doc_id, n_tokens, ids), whatever they are called: what
a stage adds for itself gets a free name. Null and empty texts go through as
empty ones, unless the classifier rejects them; rows that repeat a kept id stay
or go together; an empty table goes through all stages as one. Texts are
treated whole, however long.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegrid.llm import bpe, decontaminate, gam, jaccard, linededup
from tracegrid.llm.common import compact, free_name, saved
from tracegrid.llm.queries import RANKS, remainder, table

THRESHOLD = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a score of at least THRESHOLD; the labels' ids are matched, no column is an input."""
    model, out = gam.fit(docs, table(spark, sf_dir, "labels").filter(remainder(5) != 0)), free_name(docs, "score")
    return gam.score(compact(docs), model, out=out).filter(F.col(out) >= THRESHOLD).drop(out)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; ``n_chars`` follows where lines went, and a text left blank goes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    counts = free_name(docs, "n_lines"), free_name(docs, "n_removed")
    removed = F.col(counts[1]) > 0
    out = linededup.dedup(spark, compact(docs), counts=counts).filter(~removed | F.col("text").rlike(r"\S"))
    return out.withColumn("n_chars", F.when(removed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop(*counts)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of smallest id: five words at 0.8 (op5's query has its own values)."""
    return jaccard.keep_one(spark, compact(docs), percent=80, width=5)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found."""
    return decontaminate.clean(spark, compact(docs), table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids) of each document."""
    import public_tokenizers

    ids = bpe.encode(spark, compact(docs), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return ids.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("lines", lines), ("copies", copies), ("benchmark", benchmark), ("tokens", tokens)]
#: The classifier, the hashes and the merges have no SQL form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), spark, name)
    return STAGES[-1][1](spark, docs, sf_dir)
