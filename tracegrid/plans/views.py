"""Views of the event table in the shapes that the operators take, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tok(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens(stream, pos, sym): each user's events as symbols."""
    e, v = F.col("event_type"), F.col("value")
    sym = (
        F.when(e.isin("view", "click") & (v >= 2), 91).when(e.isin("view", "click"), 61).when(e == "purchase", 195)
        .when((e == "signup") & (v < 40), 249).when(e == "signup", 63).when(v < 25, 251).otherwise(210)
    )
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), pos.cast("bigint").alias("pos"), sym.alias("sym"))


def ser(spark: SparkSession, sf_dir: str, n: int = 100, whole: bool = True) -> DataFrame:
    """series(cycle, idx, value): cycles of n events each; the last, shorter one only if not ``whole``."""
    rows = table(spark, sf_dir, "events").select(
        F.format_string("cycle_%06d", F.floor(F.col("event_id") / n)).alias("cycle"), (F.col("event_id") % n).alias("idx"),
        (F.floor("value") % 256).cast("int").alias("value"),
    )
    size = F.count("*").over(Window.partitionBy("cycle"))
    return rows.withColumn("_n", size).filter(F.col("_n") == n).drop("_n") if whole else rows


def usr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series(stream, idx, value): each user's values, of unequal lengths."""
    idx = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream"), idx.cast("bigint").alias("idx"), F.floor("value").cast("int").alias("value"))


def usr_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usr(spark, sf_dir).select(F.format_string("user_%06d", "stream").alias("cycle"), "idx", "value")


TOK = """tok AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
  CAST(CASE WHEN event_type IN ('view','click') AND value >= 2 THEN 91 WHEN event_type IN ('view','click') THEN 61
    WHEN event_type = 'purchase' THEN 195 WHEN event_type = 'signup' AND value < 40 THEN 249 WHEN event_type = 'signup' THEN 63
    WHEN value < 25 THEN 251 ELSE 210 END AS INTEGER) AS sym FROM events)"""


def ser_sql(n: int = 100, whole: bool = True) -> str:
    return f"""ser AS (SELECT cycle, idx, value FROM (SELECT printf('cycle_%06d', event_id // {n}) AS cycle, event_id % {n} AS idx,
  CAST(CAST(floor(value) AS BIGINT) % 256 AS INTEGER) AS value, count(*) OVER (PARTITION BY event_id // {n}) AS n FROM events) WHERE n = {n} OR {not whole})"""


USR = """usr AS (SELECT user_id AS stream, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  CAST(floor(value) AS INTEGER) AS value FROM events)"""


def _shaped(size: int, fills: int, places: dict[int, tuple[int, ...]]) -> list[int]:
    """A group of fills and sevens, with symbols at given places."""
    out = [91] * fills + [7] * (size - fills)
    for sym, at in places.items():
        for p in at:
            out[p] = sym
    return out


#: Groups of the types A to E; a stream has one to three such cycles, and all but every fourth a group before.
TYPICAL = (
    _shaped(30, 0, {195: (8, 9), 63: (24,)}), _shaped(20, 0, {210: (0,), 195: (4, 6)}), [91, 91, 91, 195, 249, 249, 91],
    _shaped(70, 62, {63: (31,), 210: (34, 40), 195: (1, 3, 5, 7, 9, 11)}), _shaped(100, 0, {63: (19, 35, 70), 195: tuple(range(1, 18, 2)), 249: tuple(range(40, 56, 2))}),
)
_CYCLE = [s for g in TYPICAL for s in (251, *g)]
_BEFORE = [251, 7, 91, 7, 7]


def cycles_of_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tokens(stream, pos, sym): a stream a nation, with cycles of the groups A to E; those of key 3 have a broken one."""
    one = lambda xs: F.array(*map(F.lit, xs))
    n = F.col("n_nationkey")
    parts = F.concat(F.when(n % 4 > 0, one(_BEFORE)).otherwise(F.array().cast("array<int>")), F.when(n % 5 == 3, one(_CYCLE[32:])).otherwise(one(_CYCLE)), F.when(n % 3 > 0, one(_CYCLE)).otherwise(one(_BEFORE)), F.when(n % 3 > 1, one(_CYCLE)).otherwise(one(_BEFORE)))
    rows = table(spark, sf_dir, "nation").select(n.cast("bigint").alias("stream"), F.posexplode(parts).alias("pos", "sym"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


CYCLES = f"""tok AS (SELECT CAST(n_nationkey AS BIGINT) AS stream, CAST(unnest(range(0, len(l))) AS BIGINT) AS pos, unnest(l) AS sym FROM (SELECT n_nationkey,
  list_concat(CASE WHEN n_nationkey % 4 > 0 THEN {_BEFORE} ELSE [] END, CASE WHEN n_nationkey % 5 = 3 THEN {_CYCLE[32:]} ELSE {_CYCLE} END, CASE WHEN n_nationkey % 3 > 0 THEN {_CYCLE} ELSE {_BEFORE} END, CASE WHEN n_nationkey % 3 > 1 THEN {_CYCLE} ELSE {_BEFORE} END) AS l FROM nation))"""
