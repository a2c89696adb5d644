"""Tokens to operations to samples and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import FILL
from .tokens import in_order


def ops(tok: DataFrame, repeat_last: bool = True) -> DataFrame:
    """(stream, op, kind, value, run_len, out_index). With ``repeat_last`` each run of
    fills is one RUN91; else every token is a LITERAL."""
    w = in_order()
    fill = (F.col("sym") == FILL) if repeat_last else F.lit(False)
    new = F.when(fill & F.coalesce(F.lag("sym").over(w) == FILL, F.lit(False)), 0).otherwise(1)
    rows = tok.withColumn("_op", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    one = rows.groupBy("stream", "_op").agg(F.min("pos").cast("bigint").alias("out_index"), F.count("*").alias("n"), F.min_by("sym", "pos").alias("sym"))
    run = (F.col("sym") == FILL) if repeat_last else F.lit(False)
    return one.select(
        "stream", F.col("_op").cast("bigint").alias("op"), F.when(run, "RUN91").otherwise("LITERAL").alias("kind"),
        F.when(~run, F.col("sym")).alias("value"), F.when(run, F.col("n")).otherwise(F.lit(1)).cast("bigint").alias("run_len"), "out_index",
    )


def samples(tok: DataFrame, repeat_last: bool = True) -> DataFrame:
    """One sample a token: a fill repeats the last literal, 0 before the first."""
    value = F.col("sym")
    if repeat_last:
        literal = F.when(F.col("sym") != FILL, F.col("sym"))
        value = F.coalesce(F.last(literal, ignorenulls=True).over(in_order().rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return tok.select("stream", F.col("pos").cast("bigint").alias("idx"), value.alias("sample"))


def rebuild(operations: DataFrame) -> DataFrame:
    """The samples that operations stand for."""
    w = Window.partitionBy("stream").orderBy("op").rowsBetween(Window.unboundedPreceding, 0)
    filled = operations.withColumn("sample", F.coalesce(F.last("value", ignorenulls=True).over(w), F.lit(0)))
    at = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("run_len") - 1))
    return filled.select("stream", "out_index", "sample", at.alias("_k")).select("stream", (F.col("out_index") + F.col("_k")).alias("idx"), "sample")


def stats(operations: DataFrame) -> DataFrame:
    run = F.col("kind") == "RUN91"
    return operations.groupBy("stream").agg(
        F.count("*").alias("ops"), F.count_if(~run).alias("literals"), F.count_if(run).alias("runs"), F.sum("run_len").alias("samples"),
        F.coalesce(F.max(F.when(run, F.col("run_len"))), F.lit(0)).cast("bigint").alias("best_run"), F.coalesce(F.sum(F.when(run, F.col("run_len"))), F.lit(0)).cast("bigint").alias("total_run"),
    )


def counts(samples_: DataFrame) -> DataFrame:
    return samples_.groupBy("stream").agg(F.count("*").alias("samples"))


def compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """Sample counts of two forms side by side; equal where both have the stream's number."""
    a, b = counts(left).withColumnRenamed("samples", "left_samples"), counts(right).withColumnRenamed("samples", "right_samples")
    return a.join(b, "stream", "left").withColumn("equal", F.coalesce(F.col("left_samples") == F.col("right_samples"), F.lit(False)))
