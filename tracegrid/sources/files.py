"""Lenient readers of the engine's text files, and the plain writer. Line numbers count inside a file, by the blocks that tasks read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import first_int, last_int, lenient_int

VALUE_NAMES = ("value", "val", "sample", "level")
#: The layout files' names, and the engine's.
LAYOUT_NAMES = {"startcol": "start_col", "widthcols": "width"}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) of the non-empty lines, without byte order marks and blanks around them. Each block
    is numbered by itself; the blocks' counts, one row each, tell where its numbers begin."""
    at = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block")]
    rows = spark.read.text(path).select(*at, F.monotonically_increasing_id().alias("_id"), F.trim(F.regexp_replace("value", "^﻿|\r$", "")).alias("value")).filter("value <> ''")
    inside = F.row_number().over(Window.partitionBy("_path", "_block").orderBy("_id")) - 1
    counts = rows.groupBy("_path", "_block").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_path", "_block", F.coalesce(before, F.lit(0)).alias("_before"))
    out = rows.withColumn("_in", inside).join(starts, ["_path", "_block"])
    return out.select("file", (F.col("_before") + F.col("_in")).cast("bigint").alias("line"), "value")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, sym): the last integer of each line that has one; the file names the cycle."""
    found = numbered_lines(spark, path).withColumn("sym", last_int(F.col("value"))).filter("sym is not null")
    place = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1
    return found.select("file", place.cast("bigint").alias("line"), "sym")


def cycle_number(file: Column) -> Column:
    return F.regexp_extract(file, r"(\d+)", 1).try_cast("int")


def read_cycles(spark: SparkSession, path: str) -> DataFrame:
    """(cycle, pos, sym) of files named by their cycle's number; the files are found by the path's pattern."""
    rows = read_tokens(spark, path).select(cycle_number(F.col("file")).alias("cycle"), F.col("line").alias("pos"), "sym")
    return rows.filter("cycle is not null")


def read_rle(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, sym, run_len): the first two integers of each line below the header that has two."""
    found = F.regexp_extract_all("value", F.lit(r"([-+]?\d+)"), F.lit(1))
    rows = numbered_lines(spark, path).filter("line > 0").withColumn("_all", found).filter(F.size("_all") > 1)
    return rows.select("file", "line", F.col("_all")[0].try_cast("bigint").alias("sym"), F.col("_all")[1].try_cast("bigint").alias("run_len"))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header, all columns as strings, its byte order mark removed."""
    df = spark.read.csv(path, header=True)
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def _cells(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, cells, head): the lines below each file's first one, cut at commas, beside that one."""
    lines = numbered_lines(spark, path).withColumn("cells", F.transform(F.split("value", ","), lambda x: F.trim(x))).drop("value")
    heads = lines.filter("line = 0").select("file", F.transform("cells", F.lower).alias("head"))
    return lines.join(F.broadcast(heads), "file")  # a row a file


def _named(names: tuple[str, ...], spare: Column) -> Column:
    """The place, from 0, of the first column of one of the names, else ``spare``."""
    places = [F.nullif(F.array_position("head", n), F.lit(0)) for n in names]
    return F.coalesce(F.array_min(F.array(*places)) - 1, spare).cast("int")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, sample): the column named value, val, sample or level, else the second one; lines without an integer there are left out."""
    second = F.when(F.size("head") >= 2, 1).otherwise(0)
    rows = _cells(spark, path).filter("line > 0").withColumn("sample", F.get("cells", _named(VALUE_NAMES, second)).try_cast("bigint")).filter("sample is not null")
    place = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1
    return rows.select("file", place.cast("bigint").alias("idx"), "sample")


def read_doubles(spark: SparkSession, path: str) -> DataFrame:
    """(file, idx, value): doubles of the column ``value``, else of each line's last one (the first line
    too, if it names no value); what is no number is left out."""
    named = F.exists("head", lambda h: F.contains(h, F.lit("value")))
    last = F.size("cells") - 1
    place = F.when(named, _named(("value",), last)).otherwise(last)
    rows = _cells(spark, path).filter((F.col("line") > 0) | ~named)
    rows = rows.withColumn("value", F.coalesce(F.get("cells", place), F.get("cells", last)).try_cast("double")).filter("value is not null")
    idx = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1
    return rows.select("file", idx.cast("bigint").alias("idx"), "value")


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """series(cycle, idx, value) from idx,value or idx,cycle_00,... or cycle,idx,value."""
    df = read_table(spark, path)
    low = {c.lower(): c for c in df.columns}
    if "cycle" in low:
        value = next((low[v] for v in VALUE_NAMES if v in low), df.columns[-1])
        rows = df.select(F.col(low["cycle"]).alias("cycle"), lenient_int(F.col(low["idx"])).alias("idx"), lenient_int(F.col(value)).alias("value"))
    elif len(df.columns) > 2:
        idx = low.get("idx", df.columns[0])
        rows = df.unpivot([idx], [c for c in df.columns if c != idx], "cycle", "v").filter("v is not null")
        rows = rows.select("cycle", lenient_int(F.col(idx)).alias("idx"), lenient_int(F.col("v")).alias("value"))
    else:
        value = next((low[v] for v in VALUE_NAMES if v in low), df.columns[-1])
        idx = lenient_int(F.col(low.get("idx", df.columns[0])))
        rows = df.select(F.lit("series").alias("cycle"), idx.alias("idx"), lenient_int(F.col(value)).alias("value"))
    place = F.row_number().over(Window.partitionBy("cycle").orderBy("idx")) - 1
    return rows.select("cycle", place.cast("bigint").alias("idx"), "value")


def grid_cycle(file: Column) -> Column:
    """The cycle that a grid file is named by."""
    return F.nullif(F.regexp_extract(file, r"grid_(.+)_period_\d+", 1), F.lit(""))


def read_grid(spark: SparkSession, path: str, cycle: str | None = None) -> DataFrame:
    """grid(cycle, row, col, value) from files with columns c0, c1, ...; a file's name tells its cycle (else "series")."""
    name = F.lit(cycle) if cycle else F.coalesce(grid_cycle(F.col("file")), F.lit("series"))
    rows = _cells(spark, path).filter("line > 0").select(name.alias("cycle"), (F.col("line") - 1).alias("row"), F.posexplode("cells").alias("col", "v"))
    return rows.select("cycle", "row", F.col("col").cast("bigint").alias("col"), lenient_int(F.col("v")).alias("value"))


def read_layout(spark: SparkSession, path: str, only_valid: bool = False) -> DataFrame:
    """A layout (cycle, start_col, width, kind, ...), under the engine's names or those of its files."""
    df = read_table(spark, path)
    df = df.toDF(*(LAYOUT_NAMES.get(c.lower(), c) for c in df.columns))
    df = df.select(*(first_int(F.col(c)).alias(c) if c in ("start_col", "width") else (F.lower(c) == "true").alias(c) if c == "valid" else F.col(c) for c in df.columns))
    return df.filter("valid") if only_valid else df


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    df = read_table(spark, path)
    low = {c.lower(): c for c in df.columns}
    return df.select(lenient_int(F.col(low.get("level", df.columns[0]))).alias("level")).distinct()


def best_period(spark: SparkSession, path: str) -> DataFrame:
    """(period): the first ``period=N`` of a summary, null where it names none."""
    found = numbered_lines(spark, path).withColumn("p", F.regexp_extract("value", r"\bperiod\s*=\s*(\d+)", 1).try_cast("bigint")).filter("p is not null")
    return found.agg(F.min_by("p", "line").alias("period"))


def period_of_names(spark: SparkSession, path: str) -> DataFrame:
    """(period): the commonest period in the names of grid or column-statistics files, the larger of equals."""
    names = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"_period_(\d{3})(_trim)?\.csv$", 1).try_cast("bigint").alias("period"))
    return names.filter("period > 1").groupBy("period").agg(F.count("*").alias("n")).agg(F.max_by("period", F.struct("n", "period")).alias("period"))


def write_csv(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).csv(path, header=True)
