"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SPANS = 1024


def low_byte(v: Column) -> Column:
    return v.bitwiseAND(255)


def nibbles(v: Column) -> tuple[Column, Column]:
    """High and low half of a byte."""
    return F.shiftright(low_byte(v), 4), v.bitwiseAND(15)


def align(x: Column, to: int = 16) -> Column:
    """The next multiple of ``to``."""
    return x + F.pmod(-x, F.lit(to))


def reverse_bits(v: Column, width: int) -> Column:
    return F.conv(F.reverse(F.lpad(F.bin(v), width, "0")), 2, 10).cast("bigint")


def lenient_int(s: Column) -> Column:
    """Decimal, else hexadecimal with or without 0x, else 0."""
    s = F.trim(s)
    hexa = F.when(F.regexp_like(s, F.lit("^(0[xX])?[0-9a-fA-F]{1,15}$")), F.conv(F.regexp_replace(s, "^0[xX]", ""), 16, 10).cast("bigint"))
    return F.coalesce(s.try_cast("bigint"), hexa, F.lit(0).cast("bigint"))


def first_int(s: Column) -> Column:
    return F.nullif(F.regexp_extract(s, r"([-+]?\d+)", 1), F.lit("")).try_cast("bigint")


def last_int(s: Column) -> Column:
    """The last integer in a line, null where there is none."""
    found = F.regexp_extract_all(s, F.lit(r"([-+]?\d+)"), F.lit(1))
    return F.get(found, F.size(found) - 1).try_cast("bigint")


def sanitise(s: Column) -> Column:
    """Line breaks become spaces, commas semicolons."""
    return F.translate(s, "\n\r,", "  ;")


def divisors(n: Column) -> Column:
    """Divisors over 1, ascending; those up to the root are tried, the others are their partners."""
    n, one = n.cast("bigint"), F.lit(1).cast("bigint")
    low = F.filter(F.sequence(one, F.sqrt(n).cast("bigint") + 1), lambda d: (d * d <= n) & (n % d == 0))
    both = F.concat(low, F.reverse(F.transform(low, lambda d: F.call_function("div", n, d))))
    return F.when(n > 1, F.array_except(both, F.array(one))).otherwise(F.array().cast("array<bigint>"))


def linear_index(i1: Column, i2: Column, i3: Column, n1: int | Column, n2: int | Column) -> Column:
    """Place in a table whose third axis is slowest."""
    n1, n2 = (F.lit(n) if isinstance(n, int) else n for n in (n1, n2))
    return i3 * n1 * n2 + i2 * n1 + i1


def coordinates(index: Column, n1: int | Column, n2: int | Column) -> tuple[Column, Column, Column]:
    """The inverse of linear_index."""
    n1, n2 = (F.lit(n) if isinstance(n, int) else n for n in (n1, n2))
    return index % n1, F.floor(index / n1) % n2, F.floor(index / (n1 * n2))


def next_offsets(offsets: DataFrame, column: str) -> DataFrame:
    """Each distinct offset with the next higher one, null after the last: sorted inside SPANS equal
    spans of the offsets, whose first values, one row in all, close the gaps between spans."""
    own = offsets.select(column).filter(F.col(column).isNotNull()).distinct()
    ends = own.agg(F.min(column).alias("_low"), F.max(column).alias("_high"))
    width = F.ceil((F.col("_high") - F.col("_low") + 1) / SPANS)
    dealt = own.crossJoin(F.broadcast(ends)).select(column, F.floor((F.col(column) - F.col("_low")) / width).alias("_span"))
    firsts = dealt.groupBy("_span").agg(F.min(column).alias("_first")).agg(F.collect_list("_first").alias("_firsts"))
    later = F.array_min(F.filter("_firsts", lambda x: x > F.col(column)))
    rows = dealt.withColumn("_next", F.lead(column).over(Window.partitionBy("_span").orderBy(column))).crossJoin(F.broadcast(firsts))
    return rows.select(column, F.coalesce("_next", F.when(F.col("_next").isNull(), later)).alias(f"next_{column}"))


def in_range(lens: Column, high: int = 15) -> Column:
    return F.forall(lens, lambda x: (x >= 0) & (x <= high))


def all_unique(values: Column) -> Column:
    return F.size(F.array_distinct(values)) == F.size(values)


def kraft_ok(lens: Column) -> Column:
    """Whether a prefix code of these lengths exists (lengths 0 are unused)."""
    most = F.array_max(lens).cast("int")
    one = F.lit(1).cast("bigint")
    bit = lambda n: F.call_function("shiftleft", one, n.cast("int"))
    total = F.aggregate(lens, F.lit(0).cast("bigint"), lambda a, x: a + F.when(x > 0, bit(F.greatest(most - x, F.lit(0)))).otherwise(F.lit(0)))
    return (most > 0) & (total <= bit(most))


def segment_tag(i1: Column, i2: Column, i3: Column) -> Column:
    return F.format_string("seg_%02d_%02d_%02d", i1, i2, i3)
