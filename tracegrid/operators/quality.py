"""Structural checks as boolean columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import huffman, scalar
from ..sources.segment_grid import first_segment


def header_checks(header: DataFrame) -> DataFrame:
    """``ok`` needs positions in order and some cells; ``warn`` tells of odd lengths or distances."""
    expected = F.col("ot_pos") + F.col("n_cells") * 8 + F.col("hdr_len")
    far = F.least(F.abs(F.col("rec_pos_0") - expected), F.abs(F.col("rec_pos_0") - expected - 8)) > 64
    ok = (F.col("ot_pos") >= 1024) & (F.col("hdr_pos") > F.col("ot_pos")) & (F.col("rec_pos_0") >= F.col("hdr_pos")) & (F.col("n_cells") > 0)
    warn = (F.col("rec_len") != 8192) | ~F.col("hdr_len").between(1024, 65536) | far
    return header.select("path", ok.alias("ok"), warn.alias("warn"))


def record_checks(tables: DataFrame) -> DataFrame:
    t = lambda c: F.col(f"table.{c}")
    size = huffman.RECORD - t("payload_start")
    ok = scalar.in_range(t("lens")) & scalar.kraft_ok(t("lens")) & (t("n") >= 2) & (t("payload_start") >= 512) & (t("payload_start") % 16 == 0) & size.between(1, 8192) & (t("total_bits") > 0)
    return tables.select("path", "s1", "s2", "s3", F.coalesce(ok, F.lit(False)).alias("ok"), "error")


def assembly_checks(assembled: DataFrame) -> DataFrame:
    """``ok`` if the bits are all there; ``warn`` if fewer than 8 symbols decode under the fixed configuration."""
    @F.pandas_udf("int")
    def preview(data: pd.Series, symbols: pd.Series, lens: pd.Series) -> pd.Series:
        return pd.Series([len(huffman.decode(huffman.bits_of(d, False, True, 0, 4096), huffman.codes(list(s), list(n)), 64)[0]) for d, s, n in zip(data, symbols, lens)])

    seen = preview("data", "symbols", "lens")
    return assembled.select("stream", (F.length("data") * 8 >= F.col("bits")).alias("ok"), (seen < 8).alias("warn"))


def verdict(header: DataFrame, tables: DataFrame, assembled: DataFrame) -> DataFrame:
    """(path, segment, header_ok, record_ok, assembly_ok, ok) of a file's first non-empty segment; a file
    without one, or with an empty header row, is not ok."""
    first = first_segment(tables)
    records = record_checks(first).select("path", scalar.segment_tag(F.col("s1"), F.col("s2"), F.col("s3")).alias("segment"), F.col("ok").alias("record_ok"))
    bits = assembly_checks(assembled).select(F.col("stream").alias("segment"), F.col("ok").alias("assembly_ok"))
    rows = header_checks(header).select("path", F.col("ok").alias("header_ok")).join(records, "path", "left").join(bits, "segment", "left")
    ok = F.coalesce(F.col("header_ok") & F.col("record_ok") & F.col("assembly_ok"), F.lit(False))
    return rows.select("path", "segment", "header_ok", "record_ok", "assembly_ok", ok.alias("ok"))
