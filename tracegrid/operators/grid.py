"""Period search over ``series(cycle, idx, value)``.

A period p cuts a series in rows of p columns. Column profiles of all candidate
periods come from one exploded aggregation; grids stay in long form and are
only pivoted at a sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import PERIODS, PREFERRED
from ..functions.scalar import divisors


def lengths(series: DataFrame) -> DataFrame:
    return series.groupBy("cycle").agg(F.count("*").alias("n"))


def candidates(series: DataFrame, first: tuple[int, ...] = PERIODS, extra: tuple[int, ...] = (), remainder: bool = False) -> DataFrame:
    """(ord, period, n): fixed candidates, the divisors of the longest length n, then ``extra``
    ones; only p > 1 that divide n (any p <= n with ``remainder``) into several rows."""
    longest = lengths(series).agg(F.max("n").alias("n"))
    fixed, more = (F.array(*(F.lit(p).cast("bigint") for p in ps)).cast("array<bigint>") for ps in (first, extra))
    every = longest.select("n", F.posexplode(F.array_distinct(F.concat(fixed, divisors(F.col("n")), more))).alias("ord", "period"))
    fits = (F.col("period") <= F.col("n")) if remainder else ((F.col("n") % F.col("period") == 0) & (F.col("n") / F.col("period") > 1))
    return every.filter((F.col("period") > 1) & fits).select(F.col("ord").cast("bigint").alias("ord"), "period", "n")


def reshape(series: DataFrame, periods: DataFrame, remainder: bool = False) -> DataFrame:
    """(cycle, period, row, col, value) for each candidate; cycles that the period
    does not divide are left out, or lose their tail with ``remainder``."""
    # candidates are at most the divisors of one length
    rows = series.join(lengths(series).withColumnRenamed("n", "len"), "cycle").crossJoin(F.broadcast(periods))
    if remainder:
        rows = rows.filter((F.col("len") >= F.floor(F.col("n") / F.col("period")) * F.col("period")) & (F.col("idx") < F.floor(F.col("n") / F.col("period")) * F.col("period")))
    else:
        rows = rows.filter(F.col("len") % F.col("period") == 0)
    return rows.select("cycle", "ord", "period", F.floor(F.col("idx") / F.col("period")).cast("bigint").alias("row"), (F.col("idx") % F.col("period")).cast("bigint").alias("col"), "value")


def profiles(grids: DataFrame) -> DataFrame:
    """Of each column: distinct values, variance, entropy, binary shares, monotony, constancy."""
    key = ["cycle", "ord", "period", "col"]
    w = Window.partitionBy(*key).orderBy("row")
    moves = grids.withColumn("_up", F.coalesce(F.col("value") >= F.lag("value").over(w), F.lit(True)))
    per_value = moves.groupBy(*key, "value").agg(F.count("*").alias("f"), F.bool_and("_up").alias("up"))
    total = F.sum("f").over(Window.partitionBy(*key))
    per_value = per_value.withColumn("n", total)
    share = F.col("f") / F.col("n")
    return per_value.groupBy(*key).agg(
        F.count("*").alias("distinct_values"),
        (F.round(F.sum(F.col("f") * F.col("value") * F.col("value")) / F.max("n") - F.pow(F.sum(F.col("f") * F.col("value")) / F.max("n"), 2), 6) + 0.0).alias("variance"),
        (F.round(F.sum(-share * F.log2(share)), 6) + 0.0).alias("entropy"),
        F.round(F.sum(F.when(F.col("value").isin(0, 1), F.col("f")).otherwise(0)) / F.max("n"), 6).alias("pct01"),
        F.round(F.sum(F.when(F.col("value").isin(0, 255), F.col("f")).otherwise(0)) / F.max("n"), 6).alias("pct0255"),
        F.bool_and("up").alias("monotonic"), (F.count("*") == 1).alias("constant"),
    )


def scores(profiles_: DataFrame, per_column: bool = False) -> DataFrame:
    """(ord, period, cycle, score) of each cycle."""
    flag = lambda c: F.when(F.col(c), 2.0).otherwise(0.0)
    one = F.greatest(F.lit(0.0), 8 - F.col("entropy")) + 4 * F.greatest("pct01", "pct0255") + flag("monotonic") + flag("constant")
    total = F.sum(one) / F.first("period") if per_column else F.sum(one)
    return profiles_.groupBy("ord", "period", "cycle").agg(F.round(total, 4).alias("score"))


def totals(scores_: DataFrame) -> DataFrame:
    return scores_.groupBy("ord", "period").agg(F.round(F.sum("score"), 3).alias("total"))


def best(totals_: DataFrame) -> DataFrame:
    """The period of the largest total, the earlier candidate among equals."""
    return totals_.orderBy(F.desc("total"), "ord").limit(1).select("period", "total")


def resolve(best_: DataFrame, series: DataFrame) -> DataFrame:
    """(period): the best one if there is one over 1, else a preferred divisor of the longest length, else that length."""
    n = lengths(series).agg(F.max("n").alias("n")).select("n", divisors(F.col("n")).alias("d"))
    liked = F.array(*(F.lit(p).cast("bigint") for p in PREFERRED))
    spare = n.select(F.coalesce(F.get(F.filter(liked, lambda p: F.array_contains("d", p)), F.lit(0)), F.get("d", F.size("d") - 1)).alias("spare"))
    found = best_.filter("period > 1").agg(F.max("period").alias("found"))
    # both are one row
    return spare.crossJoin(F.broadcast(found)).select(F.coalesce("found", "spare").cast("bigint").alias("period")).filter("period is not null")


def long_grid(series: DataFrame, period: int | DataFrame) -> DataFrame:
    """(cycle, row, col, value) with the tail that fills no row dropped; the period is a number or a table of one row."""
    rows = series.join(lengths(series), "cycle")
    if isinstance(period, DataFrame):
        rows, period = rows.crossJoin(F.broadcast(period.select(F.col("period").alias("_p")))), F.col("_p")
    rows = rows.filter(F.col("idx") < F.floor(F.col("n") / period) * period)
    return rows.select("cycle", F.floor(F.col("idx") / period).cast("bigint").alias("row"), (F.col("idx") % period).cast("bigint").alias("col"), "value")


def wide_grid(grid: DataFrame, period: int) -> DataFrame:
    """For sinks: columns c0, c1, ..."""
    out = grid.groupBy("cycle", "row").pivot("col", list(range(period))).agg(F.first("value"))
    return out.select("cycle", "row", *(F.col(str(c)).alias(f"c{c}") for c in range(period)))
