"""The whole analysis of a grid file as one lazy chain, keyed by segment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..config import PAD_EXPORT
from ..functions import huffman, scalar
from ..operators import expand, fields, grid, groups, quality, series, tokens
from ..sources import segment_grid, sinks


def decoded(spark: SparkSession, path: str, **options) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Tables, assembled streams, tokens(stream, pos, sym) and the chosen readings of all segments; decoded once."""
    tables = huffman.search(segment_grid.load(spark, path, "records", **options))
    assembled = segment_grid.assemble(tables)
    streams = huffman.decode_streams(assembled.select("stream", "data", "symbols", "lens", "bits"))
    tok = streams.select("stream", F.posexplode("tokens").alias("pos", "sym")).withColumn("pos", F.col("pos").cast("bigint"))
    return tables, assembled, tok, streams


def analyze(spark: SparkSession, path: str, pad_threshold: float = PAD_EXPORT, period: int | None = None, levels: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """Every stage's table by name. A segment that fails has an ``error`` in ``tables`` and no rows elsewhere.

    Without ``period`` the best one decides, else a divisor of the series' length.
    ``levels(level, mapped)`` maps samples (else they stay). The streams' symbols are
    kept in memory and on disk until ``release(tables)``.
    """
    header = segment_grid.load(spark, path, "header")
    tables, assembled, _, streams = decoded(spark, path, **options)
    streams = streams.persist(StorageLevel.MEMORY_AND_DISK)
    tok = streams.select("stream", F.posexplode("tokens").alias("pos", "sym")).withColumn("pos", F.col("pos").cast("bigint"))
    split = groups.split(tok)
    merged = groups.merge_padding(split, pad_threshold)
    typed = groups.classify(groups.features(merged))
    cut = groups.extract_cycles(merged, typed)
    ops = expand.ops(tok)
    samples = expand.samples(tok)
    named = samples.select(F.col("stream").alias("cycle"), "idx", F.col("sample").cast("bigint").alias("value"))
    profiles = grid.profiles(grid.reshape(named, grid.candidates(named)))
    scores = grid.scores(profiles)
    best = grid.best(grid.totals(scores))
    chosen = spark.range(1).select(F.lit(period).cast("bigint").alias("period")) if period else grid.resolve(best, named)
    g = grid.long_grid(named, chosen)
    facts = fields.facts(g)
    layout = fields.validate(fields.infer(g, facts), g, facts)
    records = fields.records(g, layout)
    final, final_counts = fields.final_export(records)
    code = tables.filter("table is not null").select(scalar.segment_tag(F.col("s1"), F.col("s2"), F.col("s3")).alias("stream"), "table.n", "table.payload_start", "table.total_bits")
    return {
        "header": header, "header_checks": quality.header_checks(header), "tables": tables, "record_checks": quality.record_checks(tables), "assembly_checks": quality.assembly_checks(assembled),
        "verdict": quality.verdict(header, tables, assembled), "streams": streams, "code_lengths": huffman.length_histogram(tables.filter("table is not null"), "path", "s1", "s2", "s3"),
        "tokens": tok, "histogram": tokens.histogram(tok), "bigrams": tokens.ngrams(tok, 2), "trigrams": tokens.ngrams(tok, 3), "runs": tokens.run_histogram(tok),
        "groups": typed, "cycles": groups.cycles(typed), "cycle_tokens": cut, "dense": groups.dense_diagnostics(tok), "schema": sinks.group_schema(typed, groups.cycles(typed), merged, code),
        "meta": sinks.stream_meta(streams, split, merged, pad_threshold), "trace": groups.trace(tok), "ops": ops, "op_stats": expand.stats(ops), "samples": samples, "named": named,
        "series": series.stitch(named), "mapped": series.map_levels(named, levels if levels is not None else series.identity_map(named)), "profiles": profiles, "period_scores": scores, "best_period": best, "period": chosen,
        "grid": g, "layout": layout, "records": records, "final": final, "final_counts": final_counts,
    }


def release(out: dict[str, DataFrame]) -> None:
    """Gives back what ``analyze`` keeps."""
    out["streams"].unpersist()


def run(spark: SparkSession, path: str, base: str, **options) -> DataFrame:
    """The whole analysis of a grid file, written under ``base``; gives the manifest."""
    out = analyze(spark, path, **options)
    try:
        return sinks.write_all(spark, out, base)
    finally:
        release(out)
