"""A Spark data source for segmented grid files.

    spark.dataSource.register(SegmentGrid)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # without it, Spark refuses sources that take filters
    spark.read.format("segment_grid").option("view", "records").load(path)

Views: ``header`` (one row), ``segments`` (non-empty cells of the offset table)
and ``records`` (with their bytes). A partition is a run of table entries, so a
large table is read by many tasks, and no task holds more than its records.
Options: ``cells_per_partition``; ``probe_max`` (only coordinates below it, as
a bounded probe would); ``stop_after_empty`` (``a,b,c``: a probe of the three axes
gives up after so many empty lines in a row; it looks at the table alone and asks
for a positive offset); ``followers`` (records read after a record, only as many
as the largest possible number of bits may need). Comparisons of s1, s2 and s3
with constants are pushed down: cells outside are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..functions.huffman import CAP_BITS
from ..functions.scalar import segment_tag
from .layout import FIELDS, RECORD, Extents, cells, read_header

HEADER_SCHEMA = "path string, size long, extents int, " + ", ".join(f"{n} {'int' if f == 'i' else 'long'}" for n, f in FIELDS) + ", little boolean, score int, n_cells long, ot_base long, magic_little boolean"
SEGMENT_SCHEMA = "path string, s1 int, s2 int, s3 int, idx long, rec_start long, little boolean"
RECORD_SCHEMA = SEGMENT_SCHEMA + ", record binary, following binary"


@dataclass
class Cells(InputPartition):
    start: int
    stop: int


class SegmentGrid(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segment_grid"

    def schema(self) -> str:
        return {"header": HEADER_SCHEMA, "segments": SEGMENT_SCHEMA, "records": RECORD_SCHEMA}[self.options.get("view", "segments")]

    def reader(self, schema) -> DataSourceReader:
        return Reader(dict(self.options))


def probed(offsets: np.ndarray, shape: tuple[int, int, int], stops: tuple[int, int, int], most: int) -> np.ndarray:
    """Which cells a probe finds that goes through the axes from coordinate 0, the third one
    fastest, and gives up an axis after so many empty lines in a row."""
    nx, ny, nz = (min(n, most) for n in shape)
    full = (offsets.reshape(shape[2], shape[1], shape[0]) > 0).transpose(2, 1, 0)[:nx, :ny, :nz]
    out = np.zeros(shape, bool)

    def until(hits: np.ndarray, stop: int) -> int:
        """How far a walk over ``hits`` gets before ``stop`` misses in a row."""
        since = np.arange(len(hits)) - np.maximum.accumulate(np.where(hits, np.arange(len(hits)), -1))
        over = np.flatnonzero(since >= stop)
        return int(over[0]) + 1 if len(over) else len(hits)

    lines = np.zeros((nx, ny), bool)
    for x in range(nx):
        for y in range(ny):
            end = until(full[x, y], stops[2])
            out[x, y, :end] = full[x, y, :end]
            lines[x, y] = full[x, y, :end].any()
        end = until(lines[x], stops[1])
        lines[x, end:] = False
        out[x, end:] = False
    out[until(lines.any(axis=1), stops[0]) :] = False
    return out.transpose(2, 1, 0).reshape(-1)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.view = options.get("view", "segments")
        self.step = int(options.get("cells_per_partition", 4096))
        self.probe = int(options["probe_max"]) if "probe_max" in options else None
        self.followers = int(options.get("followers", 3))
        self.stops = tuple(int(x) for x in options["stop_after_empty"].split(",")) if "stop_after_empty" in options else None
        self.bounds: dict[str, list[int]] = {}

    def pushFilters(self, filters):
        """Keeps the bounds of s1, s2 and s3; Spark tests every filter again."""
        for f in filters:
            name, value = getattr(f, "attribute", (None,))[0], getattr(f, "value", None)
            if name in ("s1", "s2", "s3") and isinstance(value, int):
                low, high = self.bounds.setdefault(name, [-(2**31), 2**31])
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = max(low, value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = min(high, value - isinstance(f, LessThan))
                self.bounds[name] = [low, high]
        return filters

    def _wanted(self, **at: int) -> bool:
        return all(low <= at[c] <= high for c, (low, high) in self.bounds.items())

    def partitions(self) -> list[InputPartition]:
        if self.view == "header":
            return [Cells(0, 0)]
        n = read_header(Extents(self.path))["n_cells"]
        if self.stops:  # a probe goes through the whole table in order
            return [Cells(0, n)]
        return [Cells(s, min(n, s + self.step)) for s in range(0, n, self.step)] or [Cells(0, 0)]

    def read(self, partition: Cells):
        file = Extents(self.path)
        h = read_header(file)
        if self.view == "header":
            yield (self.path, file.size, len(file.paths), *(h[n] for n, _ in FIELDS), h["little"], h["score"], h["n_cells"], h["ot_base"], h["magic_little"])
            return
        nx, ny, _ = cells(h)
        raw = file.read(h["ot_base"] + 8 * partition.start, 8 * (partition.stop - partition.start))
        offsets = np.frombuffer(raw[: len(raw) // 8 * 8], "<i8" if h["little"] else ">i8")
        if self.stops and len(offsets) == h["n_cells"]:
            offsets = np.where(probed(offsets, cells(h), self.stops, self.probe or 64), offsets, 0)
        for k, at in enumerate(offsets.tolist()):
            idx = partition.start + k
            s1, s2, s3 = h["min_1"] + idx % nx, h["min_2"] + idx // nx % ny, h["min_3"] + idx // (nx * ny)
            if at <= 0 or (self.probe is not None and max(s1, s2, s3) >= self.probe) or not self._wanted(s1=s1, s2=s2, s3=s3):
                continue
            row = (self.path, s1, s2, s3, idx, at, h["little"])
            if self.view == "records":
                # CAP_BITS bits from any payload's start: no more followers can be asked for
                both = file.read(at, RECORD * (1 + min(self.followers, -(-CAP_BITS // 8 // RECORD))))
                if len(both) < RECORD:  # cut off by the file's end
                    row += (None, None)
                else:
                    row += (both[:RECORD], both[RECORD : len(both) // RECORD * RECORD])
            yield row


def load(spark: SparkSession, path: str, view: str = "segments", **options) -> DataFrame:
    spark.dataSource.register(SegmentGrid)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")  # without it, Spark refuses sources that take filters
    return spark.read.format("segment_grid").options(view=view, **{k: str(v) for k, v in options.items()}).load(path)


def first_segment(segments: DataFrame) -> DataFrame:
    return segments.filter("rec_start > 0").orderBy("idx").limit(1)


def assemble(tables: DataFrame) -> DataFrame:
    """(path, stream, data, symbols, lens, bits, short): each segment's payload, continued by the records
    that follow it in the file, whole, and cut at the number of bytes its bits need."""
    need = F.ceil(F.col("table.total_bits") / 8).cast("int")
    whole = F.concat(F.substring(F.col("record"), F.col("table.payload_start") + 1, F.lit(RECORD)), F.coalesce("following", F.lit(b"")))
    rows = tables.filter("table is not null").withColumn("data", F.substring(whole, F.lit(1), need))
    tag = segment_tag(F.col("s1"), F.col("s2"), F.col("s3"))
    return rows.select("path", tag.alias("stream"), "data", F.col("table.symbols").alias("symbols"), F.col("table.lens").alias("lens"), F.col("table.total_bits").alias("bits"), (F.length("data") < need).alias("short"))
