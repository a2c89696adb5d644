"""Series ``(cycle, idx, value)``: stitching and level maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def concat(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def stitch_mode(series: DataFrame, tie: str = "last") -> DataFrame:
    """The commonest value at each index over cycles of equal length; a tie goes to
    the value of the last cycle (or the smallest value)."""
    votes = series.groupBy("idx", "value").agg(F.count("*").alias("n"), F.max("cycle").alias("late"))
    order = (F.desc("n"), F.desc("late")) if tie == "last" else (F.desc("n"), F.asc("value"))
    return votes.withColumn("_r", F.row_number().over(Window.partitionBy("idx").orderBy(*order))).filter("_r = 1").select("idx", "value")


def stitch_longest(series: DataFrame) -> DataFrame:
    """The longest cycle, the first by name among equals."""
    best = series.groupBy("cycle").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "cycle").limit(1)
    return series.join(F.broadcast(best.select("cycle")), "cycle").select("cycle", "idx", "value")  # one row


def stitch(series: DataFrame, tie: str = "last") -> DataFrame:
    """By mode where all cycles have one length, else the longest."""
    lengths = series.groupBy("cycle").agg(F.count("*").alias("n")).agg((F.countDistinct("n") <= 1).alias("same"))
    by_mode = stitch_mode(series, tie).crossJoin(F.broadcast(lengths)).filter("same").drop("same")
    longest = stitch_longest(series).drop("cycle").crossJoin(F.broadcast(lengths)).filter("not same").drop("same")
    return by_mode.unionByName(longest)  # `lengths` is one row


def identity_map(series: DataFrame) -> DataFrame:
    return series.select(F.col("value").alias("level")).distinct().withColumn("mapped", F.col("level"))


def map_levels(series: DataFrame, levels: DataFrame) -> DataFrame:
    """Values by ``levels(level, mapped)``; a level that is missing there stays as it is."""
    joined = series.join(levels, series.value == levels.level, "left")
    return joined.select(*series.columns, F.coalesce("mapped", "value").alias("value_mapped"))


def level_histogram(series: DataFrame) -> DataFrame:
    return series.groupBy(F.col("value").alias("level")).agg(F.count("*").alias("count"))


def map_used(mapped: DataFrame) -> DataFrame:
    """The pairs that occur, with the index where each is first seen."""
    return mapped.groupBy(F.col("value").alias("level"), "value_mapped").agg(F.min("idx").alias("first_idx"))


def unmapped(series: DataFrame, levels: DataFrame) -> DataFrame:
    return series.select(F.col("value").alias("level")).distinct().join(levels.select("level"), "level", "left_anti")
