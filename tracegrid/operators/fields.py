"""Field inference, validation and records over ``grid(cycle, row, col, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

COUNTER_VARIANCE = 5.0
PAIR_VARIANCE = 50.0


def column_facts(grid: DataFrame) -> DataFrame:
    """What decides about a column: constant, binary, monotonic, and the variance of its steps."""
    w = Window.partitionBy("cycle", "col").orderBy("row")
    step = grid.withColumn("_d", F.col("value") - F.lag("value").over(w))
    return step.groupBy("cycle", "col").agg(
        F.count("*").alias("rows"), (F.min("value") == F.max("value")).alias("constant"), F.min("value").alias("low"),
        F.bool_and(F.col("value").isin(0, 1)).alias("bin01"), F.bool_and(F.col("value").isin(0, 255)).alias("bin0255"),
        F.coalesce(F.min("_d") >= 0, F.lit(True)).alias("mono"), F.round(F.coalesce(F.var_pop("_d"), F.lit(0.0)), 6).alias("step_var"),
        F.round(F.var_pop("value"), 3).alias("var"),
    )


def low_byte(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).bitwiseAND(255)


def with_next(grid: DataFrame) -> DataFrame:
    """The grid with the value of each cell's right neighbour, null where there is none."""
    w = Window.partitionBy("cycle", "row").orderBy("col")
    return grid.withColumn("next", F.when(F.lead("col").over(w) == F.col("col") + 1, F.lead("value").over(w)))


def facts(grid: DataFrame) -> DataFrame:
    """``column_facts`` and ``pair_scores`` side by side: what inference and validation both ask."""
    return column_facts(grid).join(pair_scores(grid), ["cycle", "col"], "left")


def pair_scores(grid: DataFrame) -> DataFrame:
    """Of each column and its right neighbour, both byte orders: variance of steps, distinct values."""
    both = with_next(grid).filter("next is not null")
    both = both.select("cycle", "row", "col", (low_byte("value") + low_byte("next") * 256).alias("le"), (low_byte("next") + low_byte("value") * 256).alias("be"))
    w = Window.partitionBy("cycle", "col").orderBy("row")
    both = both.withColumn("dle", F.col("le") - F.lag("le").over(w)).withColumn("dbe", F.col("be") - F.lag("be").over(w))
    var = lambda c: F.round(F.coalesce(F.var_pop(c), F.lit(0.0)), 3)
    out = both.groupBy("cycle", "col").agg(var("dle").alias("le_var"), var("dbe").alias("be_var"), F.countDistinct("le").alias("le_distinct"), F.countDistinct("be").alias("be_distinct"))
    better = lambda a, b: (F.col(f"{a}_var") < F.col(f"{b}_var")) | ((F.col(f"{a}_var") == F.col(f"{b}_var")) & (F.col(f"{a}_distinct") < F.col(f"{b}_distinct")))
    kind = F.when(better("le", "be") & (F.col("le_var") < PAIR_VARIANCE), "U16_LE").when(better("be", "le") & (F.col("be_var") < PAIR_VARIANCE), "U16_BE")
    return out.withColumn("pair", kind)


def infer(grid: DataFrame, facts_: DataFrame | None = None) -> DataFrame:
    """(cycle, start_col, width, kind): CONST, FLAG, COUNTER, U16 pairs, UNKNOWN, from left to right.

    A pair start takes its right neighbour whatever that is, so in each run of
    consecutive columns that could start a pair, every second one does.
    """
    known = facts_ if facts_ is not None else facts(grid)
    counter = F.col("mono") & (F.col("rows") >= 3) & (F.col("step_var") < COUNTER_VARIANCE)
    alone = F.when(F.col("constant"), "CONST").when(F.col("bin01") | F.col("bin0255"), "FLAG").when(counter, "COUNTER")
    w = Window.partitionBy("cycle").orderBy("col")
    rows = known.withColumn("alone", alone).withColumn("ok", F.col("alone").isNull() & F.col("pair").isNotNull())
    rows = rows.withColumn("_run", F.sum((~F.col("ok")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("cycle", "_run", "ok").orderBy("col")) - 1
    rows = rows.withColumn("starts", F.col("ok") & (place % 2 == 0))
    rows = rows.withColumn("taken", F.coalesce(F.lag("starts").over(w), F.lit(False)))
    kind = F.when(F.col("starts"), F.col("pair")).otherwise(F.coalesce("alone", F.lit("UNKNOWN")))
    return rows.filter(~F.col("taken")).select("cycle", F.col("col").alias("start_col"), F.when(F.col("starts"), 2).otherwise(1).cast("bigint").alias("width"), kind.alias("kind"))


def validate(layout: DataFrame, grid: DataFrame, facts_: DataFrame | None = None) -> DataFrame:
    """The layout with ``valid`` and ``reason``: each kind's test again, over the same grid."""
    period = grid.groupBy("cycle").agg((F.max("col") + 1).alias("cols"))
    known = (facts_ if facts_ is not None else facts(grid)).withColumnRenamed("col", "start_col")
    rows = layout.join(period, "cycle", "left").join(known, ["cycle", "start_col"], "left")
    wide = F.col("kind").startswith("U16")
    test = (
        F.when(F.col("kind") == "CONST", F.col("constant")).when(F.col("kind") == "FLAG", F.col("bin01") | F.col("bin0255"))
        .when(F.col("kind") == "COUNTER", F.col("mono") & (F.col("step_var") < COUNTER_VARIANCE))
        .when(F.col("kind") == "U16_LE", F.col("le_var") < PAIR_VARIANCE).when(F.col("kind") == "U16_BE", F.col("be_var") < PAIR_VARIANCE).otherwise(True)
    )
    outside = F.coalesce((F.col("start_col") < 0) | (F.col("start_col") + F.col("width") > F.col("cols")), F.lit(True))
    tested = F.col("kind").isin("CONST", "FLAG", "COUNTER", "U16_LE", "U16_BE")
    reason = F.when(outside, "out of bounds").when(wide & (F.col("width") != 2), "width must be 2").when(~tested, "not tested").when(F.coalesce(test, F.lit(False)), "ok").otherwise("test failed")
    return rows.select("cycle", "start_col", "width", "kind", reason.isin("ok", "not tested").alias("valid"), reason.alias("reason"))


def field_name() -> Column:
    return F.format_string("%s_c%02d", F.lower("kind"), F.col("start_col"))


def records(grid: DataFrame, layout: DataFrame) -> DataFrame:
    """(cycle, row, field, value) of the valid fields, in long form."""
    rows = with_next(grid).join(layout.filter("valid").select("cycle", F.col("start_col").alias("col"), "kind"), ["cycle", "col"])
    low, high = low_byte("value"), F.coalesce(low_byte("next"), F.lit(0))
    value = F.when(F.col("kind") == "U16_LE", low + high * 256).when(F.col("kind") == "U16_BE", high + low * 256).otherwise(low)
    return rows.withColumn("start_col", F.col("col")).select("cycle", "row", field_name().alias("field"), value.cast("bigint").alias("value"))


def wide_records(records_: DataFrame, names: list[str]) -> DataFrame:
    """One column a field; fields that a cycle lacks are null."""
    return records_.groupBy("cycle", "row").pivot("field", names).agg(F.first("value"))


def final_export(by_cycle: DataFrame, series: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The flat table of the records in wide form, and its (rows, cols): those of the ``series``
    where it has any, else of all cycles with their names; without any, a column ``idx``."""
    for rows, keys in ((series, ["row"]), (by_cycle, ["cycle", "row"])):
        names = sorted(r.field for r in rows.select("field").distinct().collect()) if rows is not None else []  # a record's fields, not its rows
        if names:
            wide = rows.groupBy(*keys).pivot("field", names).agg(F.first("value")).orderBy(*keys)
            wide = wide.drop("row")
            return wide, wide.agg(F.count("*").alias("rows")).withColumn("cols", F.lit(len(wide.columns)).cast("bigint"))
    none = by_cycle.select(F.col("row").alias("idx")).limit(0)
    return none, none.agg(F.count("*").alias("rows")).withColumn("cols", F.lit(1).cast("bigint"))


def union_all(parts: list[DataFrame]) -> DataFrame:
    """Tables of different fields by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
