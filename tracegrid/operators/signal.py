"""Signal inspection of ``series(stream, idx, value)``: histogram, autocorrelation, DFT, peaks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tokens import top


def histogram(series: DataFrame, bins: int = 64) -> DataFrame:
    """Counts by equal-width bins, named by centre; a constant series has one bin at its value."""
    ends = series.groupBy("stream").agg(F.min("value").cast("double").alias("lo"), F.max("value").cast("double").alias("hi"))
    rows = series.join(ends, "stream").withColumn("step", (F.col("hi") - F.col("lo")) / bins)
    at = F.when(F.col("step") > 0, F.least(F.floor((F.col("value") - F.col("lo")) / F.nullif(F.col("step"), F.lit(0.0))), F.lit(bins - 1))).otherwise(F.lit(0))
    rows = rows.withColumn("bin", at.cast("bigint"))
    centre = F.when(F.col("step") > 0, F.col("lo") + (F.col("bin") + 0.5) * F.col("step")).otherwise(F.col("lo"))
    return rows.groupBy("stream", "bin", F.round(centre, 6).alias("centre")).agg(F.count("*").alias("count"))


def by_stream(series: DataFrame, work, schema: str) -> DataFrame:
    """(stream, ...) of ``work(values)`` for each stream in order: rows are dealt and sorted by stream,
    and a task goes through them batch by batch, holding one stream that may go on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None

        def done(part: pa.Table, ends: list[int]) -> pa.RecordBatch:
            names, values = part.column("stream").combine_chunks(), part.column("value").to_numpy().astype(float)
            got = [work(values[s:e]) for s, e in zip([0, *ends], ends)]
            n = [len(next(iter(g.values()))) for g in got]
            owner = pa.array(np.repeat([e - 1 for e in ends], n))
            return pa.RecordBatch.from_pydict({"stream": names.take(owner), **{c: pa.array(np.concatenate([g[c] for g in got])) for c in got[0]}})

        for batch in batches:
            part = pa.Table.from_batches([batch])
            part = pa.concat_tables([rest, part]) if rest is not None else part
            name = part.column("stream").combine_chunks()
            ends = (np.flatnonzero(pc.not_equal(name[1:], name[:-1]).to_numpy(zero_copy_only=False)) + 1).tolist()
            if ends:
                yield done(part, ends)
            rest = part.slice(ends[-1] if ends else 0)
        if rest is not None and rest.num_rows:
            yield done(rest, [rest.num_rows])

    kind = dict(series.dtypes)["stream"]
    rows = series.select("stream", "idx", "value").filter("stream is not null").repartition("stream").sortWithinPartitions("stream", "idx")
    return rows.mapInArrow(run, f"stream {kind}, {schema}")


def autocorrelation(series: DataFrame, limit: int = 256) -> DataFrame:
    """Biased autocorrelation of lags 0..max(4, min(limit, n/2)), at most n-1, lag 0 at least;
    by NumPy, as a join would carry each sample once a lag."""

    def lags(x: np.ndarray) -> dict[str, np.ndarray]:
        x = x - x.mean()
        n = len(x)
        most = max(min(max(4, min(limit, n // 2)), n - 1), 0)
        power = float(x @ x) or 1e-12
        got = np.array([x[: n - k] @ x[k:] for k in range(most + 1)]) / power
        return {"lag": np.arange(most + 1), "autocorr": np.round(got, 6) + 0.0}

    return by_stream(series, lags, "lag long, autocorr double")


def dft(series: DataFrame, all_bins: bool = False) -> DataFrame:
    """(stream, k, freq, magnitude) for k = 0..n/2 (or all), by NumPy's FFT."""

    def spectrum(x: np.ndarray) -> dict[str, np.ndarray]:
        n = len(x)
        got = np.abs(np.fft.fft(x))[: n if all_bins else n // 2 + 1]
        k = np.arange(len(got))
        return {"k": k, "freq": np.round(k / n, 6), "magnitude": np.round(got, 6) + 0.0}

    return by_stream(series, spectrum, "k long, freq double, magnitude double")


def dft_joined(series: DataFrame) -> DataFrame:
    """``dft`` by sums of products, without leaving the JVM; meant for streams up to some thousand samples."""
    n = F.count("*").over(Window.partitionBy("stream"))
    rows = series.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(F.col("n") / 2).cast("bigint"))))
    angle = F.lit(2.0) * F.pi() * F.col("k") * F.col("idx") / F.col("n")
    sums = rows.groupBy("stream", "k", "n").agg(F.sum(F.col("value") * F.cos(angle)).alias("re"), F.sum(F.col("value") * F.sin(angle)).alias("im"))
    return sums.select("stream", "k", F.round(F.col("k") / F.col("n"), 6).alias("freq"), (F.round(F.hypot("re", "im"), 6) + 0.0).alias("magnitude"))


def top_lags(auto: DataFrame, k: int = 5) -> DataFrame:
    return top(auto.filter("lag > 0"), k, (F.desc("autocorr"), "lag"))


def top_bins(spectrum: DataFrame, k: int = 5) -> DataFrame:
    """The strongest bins strictly between 0 and Nyquist; none for a single sample."""
    inner = spectrum.withColumn("_last", F.max("k").over(Window.partitionBy("stream"))).filter("k > 0 and k < _last").drop("_last")
    return top(inner, k, (F.desc("magnitude"), "k"))


def peaks(auto: DataFrame, spectrum: DataFrame, k: int = 5) -> DataFrame:
    """(stream, type, index, value) of the top lags and bins."""
    a = top_lags(auto, k).select("stream", F.lit("lag").alias("type"), F.col("lag").alias("index"), F.col("autocorr").alias("value"))
    return a.unionByName(top_bins(spectrum, k).select("stream", F.lit("bin").alias("type"), F.col("k").alias("index"), F.col("magnitude").alias("value")))
