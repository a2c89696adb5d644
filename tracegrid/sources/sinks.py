"""The engine's files: every table under its own name, with the columns its readers know.

``artefacts`` names the tables of an analysis, ``write_all`` writes them, and the
manifest tells where. A table is a folder of parts, written by many tasks; text
summaries and JSON documents are small and have one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PAD_EXPORT
from ..functions.huffman import CONFIGS
from ..operators import groups, signal
from ..operators.tokens import top
from .files import write_csv


def nine(c: str) -> Column:
    """A double with nine digits after the point."""
    return F.format_string("%.9f", F.col(c).cast("double"))


def signal_files(series: DataFrame) -> dict[str, DataFrame]:
    """Autocorrelation, spectrum, peaks and the text summary of ``series(stream, idx, value)``."""
    auto, spectrum, bins = signal.autocorrelation(series), signal.dft(series), signal.histogram(series)
    best = signal.peaks(auto, spectrum)
    lags = F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "lag", F.struct(-F.col("value"), "index")))), lambda x: x["index"].cast("string"))
    tops = best.groupBy("stream").agg(lags.alias("lags"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == "bin", F.struct(-F.col("value"), "index")))), lambda x: x["index"].cast("string")), ", ").alias("bins"))
    hist = bins.groupBy("stream").agg(F.transform(F.array_sort(F.collect_list(F.struct("centre", "count"))), lambda x: F.format_string("  binCenter=%.6f, count=%d", x["centre"], x["count"])).alias("hist"))
    text = series.groupBy("stream").agg(F.count("*").alias("n")).join(hist, "stream").join(tops, "stream", "left")
    joined = F.coalesce(F.array_join("lags", ", "), F.lit(""))
    lines = F.concat(
        F.array(F.format_string("Series length: %d", "n"), F.lit("Histogram (approx 64 bins):")), "hist",
        F.array(F.format_string("Top autocorrelation lags (excluding lag 0): [%s]", joined), F.format_string("Top FFT bins: [%s]", F.coalesce("bins", F.lit("")))),
        F.when(F.size("lags") > 0, F.array(F.concat(F.lit("Candidate period (dominant lag): "), F.get("lags", F.lit(0))))).otherwise(F.array().cast("array<string>")),
    )
    return {
        "stage11_autocorr": auto.select("stream", "lag", nine("autocorr").alias("autocorr")),
        "stage11_fft": spectrum.select("stream", "k", nine("freq").alias("freq_norm"), nine("magnitude").alias("magnitude")),
        "stage11_peaks": best.select("stream", F.when(F.col("type") == "lag", "autocorr").otherwise("fft").alias("type"), "index", nine("value").alias("value")),
        "stage11_summary": text.select("stream", F.array_join(lines, "\n").alias("value")),
    }


def period_files(profiles: DataFrame, best: DataFrame, series: DataFrame) -> dict[str, DataFrame]:
    """Column statistics of all periods, and the summary of the best one."""
    six = lambda c, n=6: F.format_string(f"%.{n}f", F.col(c).cast("double"))
    stats = profiles.select("period", "cycle", "col", F.col("distinct_values").alias("distinct"), six("entropy").alias("entropyBits"), six("variance").alias("variance"), six("pct01", 4).alias("pctBinary01"), six("pct0255", 4).alias("pctBinary0255"), "monotonic", "constant")
    facts = series.groupBy("cycle").agg(F.count("*").alias("n")).agg(F.max("n").alias("n"), F.count("*").alias("cycles"))
    told = facts.crossJoin(F.broadcast(best.agg(F.max("period").alias("period"), F.max("total").alias("total"))))  # one row each
    text = F.concat_ws("\n", F.format_string("seriesLen=%d", "n"), F.format_string("cycles=%d", "cycles"), F.coalesce(F.format_string("BEST=period=%d score=%.3f", F.when(F.col("period").isNotNull(), F.col("period")), "total"), F.lit("BEST=<none>")))
    return {"stage12_colstats": stats, "stage12_best_period": told.select(F.when(F.col("period").isNull(), F.concat_ws("\n", F.format_string("seriesLen=%d", "n"), F.format_string("cycles=%d", "cycles"), F.lit("BEST=<none>"))).otherwise(text).alias("value"))}


def layout_lines(layout: DataFrame, checked: bool) -> DataFrame:
    """(cycle, value): the fields of each cycle as lines of text."""
    end = F.col("start_col") + F.col("width") - 1
    line = F.format_string("  - col %d..%d %-9s -> %s (%s)", "start_col", end, "kind", F.when(F.col("valid"), "OK").otherwise("FAIL"), "reason") if checked else F.format_string("  - col %d..%d %s", "start_col", end, "kind")
    rows = layout.withColumn("_line", line).groupBy("cycle").agg(F.array_sort(F.collect_list(F.struct("start_col", "_line"))).alias("_all"))
    return rows.select("cycle", F.concat(F.lit("["), "cycle", F.lit("]\n"), F.array_join(F.transform("_all", lambda x: x["_line"]), "\n")).alias("value"))


def layout_files(layout: DataFrame) -> dict[str, DataFrame]:
    names = [F.col("start_col").alias("startCol"), F.col("width").alias("widthCols")]
    return {
        "stage13_layout": layout.select("cycle", *names, "kind"),
        "stage13_layout_txt": layout_lines(layout, False),
        "stage14_layout_final": layout.select("cycle", *names, "kind", "valid", F.translate("reason", "\n\r,", "  ;").alias("reason")),
        "stage14_layout_final_txt": layout_lines(layout, True),
    }


def group_schema(features: DataFrame, cycles: DataFrame, groups_: DataFrame, code: DataFrame | None = None, k: int = 8, dense: int = 12, half_even: bool = False) -> DataFrame:
    """(stream, json): the code's facts, the summary of a dense stream, groups and cycles as one document.

    ``code(stream, n, payload_start, total_bits)`` may be missing; a stream is dense here
    if it is one group without 63, 195, 210 and 249. The share of fills has four digits: of its
    shortest decimal form, halves up, or with ``half_even`` of its exact value, halves to even.
    """
    share = F.format_number("density", 4) if half_even else F.format_string("%.4f", "density")
    counts = groups_.groupBy("stream", "sg", "sym").agg(F.count("*").alias("count"))
    pairs = lambda c: F.transform(c, lambda x: F.struct(x["sym"].alias("sym"), x["count"].alias("count")))
    ranked = top(counts, dense, (F.desc("count"), "sym"), ("stream", "sg"))
    tops = ranked.groupBy("stream", "sg").agg(F.array_sort(F.collect_list(F.struct("rank", "sym", "count"))).alias("_top"))
    one = features.join(tops, ["stream", "sg"], "left")
    entry = F.struct(
        F.col("sg").alias("index"), "type", "size", share.alias("fillPct"), F.col("best_run").alias("bestRun91"), F.col("at_param").alias("pos63"),
        F.col("at_control").alias("pos195"), F.col("at_mark").alias("pos210"), F.col("at_rare").alias("pos61"), F.col("soft").alias("count249"), F.col("pair").alias("has195Pair"), pairs(F.slice("_top", 1, k)).alias("top"),
    )
    sparse = (F.size("at_param") == 0) & (F.size("at_control") == 0) & (F.size("at_mark") == 0) & (F.col("soft") == 0)
    docs = one.groupBy("stream").agg(
        F.array_sort(F.collect_list(entry)).alias("superGroups"), (F.count("*") == 1).alias("_single"), F.bool_and(sparse).alias("_sparse"),
        F.first(pairs("_top")).alias("_symbols"), F.sum("size").alias("_size"),
    )
    summary = F.when(F.col("_single") & F.col("_sparse"), F.struct(F.col("_symbols").alias("topSymbols"), F.col("_size").alias("countSymbols")))
    spans = cycles.groupBy("stream").agg(F.array_sort(F.collect_list(F.struct("start", "len"))).alias("cycles"))
    docs = docs.join(spans, "stream", "left").withColumn("cycles", F.coalesce("cycles", F.array().cast("array<struct<start: bigint, len: bigint>>")))
    parts = [summary.alias("denseSummary"), F.col("superGroups"), F.col("cycles")]
    if code is not None:
        docs = docs.join(code.select("stream", F.struct(F.col("n").alias("N"), F.col("payload_start").alias("payloadStartByte"), F.col("total_bits").alias("totalBits")).alias("huffman")), "stream", "left")
        parts.insert(0, F.col("huffman"))
    return docs.select("stream", F.to_json(F.struct(*parts)).alias("json"))


def stream_meta(streams: DataFrame, before: DataFrame, after: DataFrame, threshold: float = PAD_EXPORT) -> DataFrame:
    """(stream, json): the chosen reading of the bits, and the numbers of groups before and after merging."""
    number = lambda g, c: g.groupBy("stream").agg(F.countDistinct("sg").alias(c))
    bits = reduce(lambda a, kc: a.when(F.col("config") == kc[0], F.struct(F.lit("LSB" if kc[1][0] else "MSB").alias("bits"), F.lit(kc[1][1]).alias("invert"), F.lit(kc[1][2]).alias("shift"))), list(enumerate(CONFIGS))[1:], F.when(F.col("config") == 0, F.struct(F.lit("LSB").alias("bits"), F.lit(CONFIGS[0][1]).alias("invert"), F.lit(CONFIGS[0][2]).alias("shift"))))
    rows = streams.select("stream", bits.alias("_c")).join(number(before, "superGroupsBefore"), "stream", "left").join(number(after, "superGroupsAfter"), "stream", "left")
    return rows.select("stream", F.to_json(F.struct("_c.bits", "_c.invert", "_c.shift", "superGroupsBefore", "superGroupsAfter", F.lit(threshold).alias("padMergeThreshold"))).alias("json"))


def manifest(spark: SparkSession, base: str, outputs: dict[str, str], best: DataFrame | None = None, layout: DataFrame | None = None, final: str | None = None) -> DataFrame:
    """(json): the base folder, what was written where, the best period, the layout's lines and the final table."""
    one = spark.range(1).select(F.lit(base).alias("baseDir"), F.create_map(*(F.lit(x) for kv in sorted(outputs.items()) for x in kv)).alias("outputs") if outputs else F.lit(None).cast("map<string,string>").alias("outputs"), F.lit(final).alias("finalCsv"))
    if best is not None:
        one = one.crossJoin(F.broadcast(best.agg(F.max("period").alias("bestPeriod"))))
    if layout is not None:
        lines = layout_lines(layout, True).agg(F.transform(F.array_sort(F.collect_list(F.struct("cycle", "value"))), lambda x: x["value"]).alias("layoutFinalTxt"))
        one = one.crossJoin(F.broadcast(lines))  # one row each
    return one.select(F.to_json(F.struct(*one.columns)).alias("json"))


def artefacts(out: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of an analysis as files know them; columns named ``value`` or ``json`` alone are text."""
    named = out["samples"].select("stream", "idx", F.col("sample").alias("value"))
    files = {
        "hist": out["histogram"], "bigrams": out["bigrams"], "trigrams": out["trigrams"], "runs": out["runs"],
        "stage4_schema": out["schema"], "stage5_tokens": out["cycle_tokens"], "stage5_meta": out["meta"],
        "stage5_hist": groups.top_symbols(out["cycle_tokens"].select("stream", "sg", "gpos", "sym"), 256).drop("rank"), "stage6_trace": out["trace"],
        "stage7_ops": out["ops"], "stage7_samples": out["samples"].select("stream", "idx", F.col("sample").alias("value")),
        "stage9_concat": named.select(F.col("stream").alias("cycle"), "idx", "value"), "stage9_series": out["series"],
        "stage12_grid": out["grid"], "stage15_records": out["records"], "stage16_final": out["final"], "stage16_counts": out["final_counts"],
    }
    mapped = out["mapped"]
    files |= {
        "stage10_mapped": mapped.select("cycle", "idx", F.col("value").alias("level"), "value_mapped"), "stage10_level_hist": mapped.groupBy(F.col("value").alias("level")).agg(F.count("*").alias("count")),
        "stage10_map_used": mapped.groupBy(F.col("value").alias("level"), "value_mapped").agg(F.count("*").alias("count")).drop("count"),
    }
    return files | signal_files(named) | period_files(out["profiles"], out["best_period"], out["named"]) | layout_files(out["layout"])


def write_text(df: DataFrame, path: str) -> None:
    """The one text column ``value`` or ``json``, in one part a task."""
    df.select("value" if "value" in df.columns else "json").write.mode("overwrite").text(path)


def write_all(spark: SparkSession, out: dict[str, DataFrame], base: str) -> DataFrame:
    """Writes every table of an analysis under ``base`` and gives the manifest, which is written too."""
    where = {}
    for name, df in artefacts(out).items():
        where[name] = f"{base}/{name}"
        if "json" in df.columns or name.endswith(("_txt", "_summary", "_best_period")):
            write_text(df, where[name])
        elif name == "stage5_tokens":
            write_csv(df, where[name], ("stream", "cycle"))
        elif name == "stage12_grid":
            write_csv(df, where[name], ("cycle",))
        else:
            write_csv(df, where[name])
    doc = manifest(spark, base, where, out["best_period"], out["layout"], where["stage16_final"])
    write_text(doc, f"{base}/manifest")
    return doc
