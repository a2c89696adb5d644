"""Sequence statistics over ``tokens(stream, pos, sym)``: n-grams, runs, positions.

Every window is partitioned by stream, so streams spread over the cluster; one
stream is at most a segment's 200,000 bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONTROL, FILL, RARE_SYMBOLS

NAMES = "abcdefgh"


def in_order(*more: str) -> Window:
    return Window.partitionBy("stream", *more).orderBy("pos")


def top(df: DataFrame, k: int, by: tuple, part: tuple[str, ...] = ("stream",), name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each part in the order ``by`` (which must be total), ranked from 1."""
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*part).orderBy(*by)).cast("bigint"))
    return ranked.filter(F.col(name) <= k)


def histogram(tok: DataFrame, *keys: str) -> DataFrame:
    return tok.groupBy(*(keys or ("stream",)), "sym").agg(F.count("*").alias("count"))


def ngrams(tok: DataFrame, n: int) -> DataFrame:
    """Counts of the n-grams of each stream, as columns a, b, c ..."""
    w = in_order()
    names = list(NAMES[:n])
    grams = tok.select("stream", *(F.lead("sym", i).over(w).alias(c) if i else F.col("sym").alias(c) for i, c in enumerate(names)))
    return grams.filter(F.col(names[-1]).isNotNull()).groupBy("stream", *names).agg(F.count("*").alias("count"))


def top_ngrams(tok: DataFrame, n: int, k: int) -> DataFrame:
    return top(ngrams(tok, n), k, (F.desc("count"), *NAMES[:n]))


def runs(tok: DataFrame) -> DataFrame:
    """Maximal runs in order: (stream, run, sym, start, run_len)."""
    w = in_order()
    new = F.when(F.lag("sym").over(w) == F.col("sym"), 0).otherwise(1)
    marked = tok.withColumn("_new", new).withColumn("run", (F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("bigint"))
    return marked.groupBy("stream", "run", "sym").agg(F.min("pos").cast("bigint").alias("start"), F.count("*").alias("run_len"))


def run_histogram(tok: DataFrame) -> DataFrame:
    return runs(tok).groupBy("stream", "sym", "run_len").agg(F.count("*").alias("count"))


def best_run(tok: DataFrame, sym: int = FILL) -> DataFrame:
    """The longest run of ``sym`` in each stream, 0 where it is absent."""
    return runs(tok).groupBy("stream").agg(F.coalesce(F.max(F.when(F.col("sym") == sym, F.col("run_len"))), F.lit(0)).cast("bigint").alias("best_run"))


def rare_positions(tok: DataFrame, symbols=RARE_SYMBOLS, limit: int = 64) -> DataFrame:
    return top(tok.filter(F.col("sym").isin(*symbols)).select("stream", "sym", "pos"), limit, ("pos",), ("stream", "sym"))


def positions(tok: DataFrame, *keys: str) -> DataFrame:
    """Each symbol's positions, ascending, joined by commas."""
    at = F.array_join(F.transform(F.array_sort(F.collect_list("pos")), lambda p: p.cast("string")), ",")
    return tok.groupBy(*(keys or ("stream",)), "sym").agg(at.alias("positions"))


def transitions(tok: DataFrame, k: int) -> DataFrame:
    """The k commonest successors of each symbol."""
    return top(ngrams(tok, 2), k, (F.desc("count"), "b"), ("stream", "a"))


def top_runs(tok: DataFrame, k: int) -> DataFrame:
    """The k commonest run lengths of each symbol."""
    return top(run_histogram(tok), k, (F.desc("count"), "run_len"), ("stream", "sym"))


def top_histogram(tok: DataFrame, k: int) -> DataFrame:
    return top(histogram(tok), k, (F.desc("count"), "sym"))


def heuristics(tok: DataFrame, bits: int = 8) -> DataFrame:
    """Totals of each stream: distinct symbols, fills, controls, and bits per distinct symbol."""
    return tok.groupBy("stream").agg(
        F.count("*").alias("tokens"), F.countDistinct("sym").alias("distinct_syms"),
        F.count_if(F.col("sym") == FILL).alias("fills"), F.count_if(F.col("sym") == CONTROL).alias("controls"),
        F.round(F.count("*") * F.lit(float(bits)) / F.countDistinct("sym"), 6).alias("bits_per_distinct"),
    )


def sample(tok: DataFrame, n: int = 256) -> DataFrame:
    return top(tok.select("stream", "pos", "sym"), n, ("pos",)).drop("rank")


def symbol_counts(tok: DataFrame, symbols: tuple[int, ...] = (0, 1)) -> DataFrame:
    """Distinct symbols of each stream, and how often some occur (n_0 and n_1: zeros and ones)."""
    return tok.groupBy("stream").agg(F.countDistinct("sym").alias("unique_symbols"), *(F.count_if(F.col("sym") == s).alias(f"n_{s}") for s in symbols))
