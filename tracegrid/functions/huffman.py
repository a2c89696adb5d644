"""Bit-serial work: prefix-code search, probing and decoding, as NumPy kernels and Arrow functions."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The record's layout and the heuristics' bounds
RECORD = 8192
BASES = range(256, 1024)
SIZES = range(2, 65)
MIN_PAYLOAD, PREVIEW, CAP_BITS, FALLBACK_BITS = 512, 256, 200_000, 44_000
CONFIGS = tuple((lsb, inverted, shift) for lsb in (True, False) for inverted in (False, True) for shift in range(4))

TABLE = "n: int, base: int, symbols: array<int>, lens: array<int>, payload_start: int, score: int, total_bits: bigint, min_delta: double, max_delta: double"


def bits_of(data: bytes, lsb: bool, inverted: bool = False, shift: int = 0, limit: int | None = None) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little" if lsb else "big")[:limit][shift:]
    return bits ^ 1 if inverted else bits


def codes(symbols: list[int], lens: list[int], by_symbol: bool = False, reverse: bool = False) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of the canonical code. Inside a length the codes follow
    the input's order, or the symbols' with ``by_symbol``."""
    used = sorted((n, s if by_symbol else i, s) for i, (s, n) in enumerate(zip(symbols, lens)) if n > 0)
    out, code, before = {}, 0, used[0][0] if used else 0
    for n, _, s in used:
        code <<= n - before
        before = n
        out.setdefault((n, int(format(code, f"0{n}b")[::-1], 2) if reverse else code), s)
        code += 1
    return out


def decode(bits: np.ndarray, table: dict[tuple[int, int], int], limit: int | None = None, strict: bool = False) -> tuple[list[int], list[int]]:
    """Symbols and their code lengths up to the end, ``limit`` or the first bits that are
    no code (an error with ``strict``). Each step is one lookup of the next bits."""
    most = max((n for n, _ in table), default=0)
    if not most:
        return [], []
    symbol, length = np.full(1 << most, -1), np.zeros(1 << most, np.int64)
    for (n, c), s in sorted(table.items(), reverse=True):  # shorter codes win
        symbol[c << (most - n) : (c + 1) << (most - n)] = s
        length[c << (most - n) : (c + 1) << (most - n)] = n
    padded = np.concatenate([bits, np.zeros(most, np.uint8)]).astype(np.int64)
    ahead = np.zeros(len(bits), np.int64)
    for k in range(most):
        ahead = ahead << 1 | padded[k : k + len(bits)]
    symbol, length = symbol[ahead].tolist(), length[ahead].tolist()
    out, lens, at, end = [], [], 0, len(bits)
    while at < end and (limit is None or len(out) < limit):
        n = length[at]
        if not n or at + n > end:
            if strict and not n:
                raise ValueError(f"no code at bit {at}")
            break
        out.append(symbol[at])
        lens.append(n)
        at += n
    return out, lens


def config_score(data: bytes, symbols, lens, config, limit_bits: int, prefix: int) -> int:
    """Decoded symbols plus twice the distinct ones among the first ``prefix``, over 4096 bits."""
    lsb, inverted, shift = config
    got, _ = decode(bits_of(data, lsb, inverted, shift, min(limit_bits, 4096)), codes(symbols, lens), prefix)
    return len(got) + 2 * len(set(got))


def best_config(data: bytes, symbols, lens, limit_bits: int, prefix: int = 256) -> tuple[int, int]:
    """The number of the first configuration with the highest score, and that score."""
    scores = [config_score(data, symbols, lens, c, limit_bits, prefix) for c in CONFIGS]
    k = int(np.argmax(scores))
    return k, scores[k]


def plausible(symbols: list[int], lens: list[int], payload: bytes) -> bool:
    """Whether some configuration decodes 64 symbols with 4 distinct ones from the payload's start."""
    for lsb in (True, False):
        table = codes(symbols, lens, by_symbol=True, reverse=lsb)
        for inverted in (False, True):
            for shift in range(4):
                got, _ = decode(bits_of(payload, lsb, inverted, shift, 2048), table, 64)
                if len(got) == 64 and len(set(got)) >= 4:
                    return True
    return False


def find_table(record: bytes) -> dict | None:
    """The prefix-code table of highest score that passes the cheap tests and the probe.

    The tests run over all bases at once for each size; the probe is only tried
    in order of preference, until one table passes.
    """
    raw = np.frombuffer(record, np.uint8).astype(np.int64)
    bases = np.arange(BASES.start, BASES.stop)
    found = []
    for n in SIZES:
        half = (n + 1) // 2
        syms = raw[bases[:, None] + np.arange(n)]
        packed = raw[bases[:, None] + n + np.arange(half)]
        lens = np.stack([packed >> 4, packed & 15], axis=2).reshape(len(bases), -1)[:, :n]
        most = lens.max(axis=1)
        weight = np.where(lens > 0, 1 << np.maximum(most[:, None] - lens, 0), 0).sum(axis=1)
        start = -(-(bases + n + half) // 16) * 16
        used = (lens > 0).sum(axis=1)
        distinct = (np.diff(np.sort(syms, axis=1), axis=1) > 0).all(axis=1)
        ok = distinct & (most > 0) & (weight <= 1 << most) & (used >= 2) & (start >= MIN_PAYLOAD) & (start < RECORD)
        score = 3 * (n >= 3) + 1 + np.minimum(most, 8) + used + 4 * (32 <= n <= 48)
        found += [(-int(score[i]), int(start[i]), int(bases[i]), n, syms[i].tolist(), lens[i].tolist()) for i in np.flatnonzero(ok)]
    for score, start, base, n, syms, lens in sorted(found, key=lambda f: f[:4]):
        if plausible(syms, lens, record[start : start + PREVIEW]):
            return {"n": n, "base": base, "symbols": syms, "lens": lens, "payload_start": start, "score": -score}
    return None


def total_bits(record: bytes, start: int, little: bool) -> int:
    """The first 32-bit number before the payload that can be its length in bits, else a guess."""
    have = (RECORD - start) * 8
    low = max(0, start - 512)
    window = record[low : low + min(512, start)]
    for i in range(len(window) - 3):
        v = int.from_bytes(window[i : i + 4], "little" if little else "big")
        if have < v <= CAP_BITS:
            return v
    return min(have + FALLBACK_BITS, CAP_BITS)


def read_table(record: bytes, little: bool) -> dict | None:
    table = find_table(record)
    if table is None:
        return None
    low, high = (0.0 if x != x else x for x in struct.unpack("<2d" if little else ">2d", record[:16]))
    return {**table, "total_bits": total_bits(record, table["payload_start"], little), "min_delta": low, "max_delta": high}


def search(records: DataFrame) -> DataFrame:
    """``records(path, s1, s2, s3, little, record)`` with ``table`` (null if none is found) and ``error``."""
    keep = [f for f in records.schema.fields if f.name not in ("table", "error")]
    names = [f.name for f in keep]
    kind = pa.struct([("n", pa.int32()), ("base", pa.int32()), ("symbols", pa.list_(pa.int32())), ("lens", pa.list_(pa.int32())), ("payload_start", pa.int32()), ("score", pa.int32()), ("total_bits", pa.int64()), ("min_delta", pa.float64()), ("max_delta", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tables = [read_table(r, little) if r is not None and len(r) == RECORD else None for r, little in zip(b.column("record").to_pylist(), b.column("little").to_pylist())]
            errors = [None if t else "no prefix-code table" for t in tables]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(tables, kind), pa.array(errors, pa.string())], names=[*names, "table", "error"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keep)
    return records.mapInArrow(run, f"{schema}, table struct<{TABLE}>, error string")


def length_histogram(tables: DataFrame, *keys: str, lens: str = "table.lens") -> DataFrame:
    """(keys, len, count, max_len, used) of the code lengths of each row of ``tables``: how many symbols
    have each length, the longest one, and how many symbols are used."""
    rows = tables.select(*keys, F.col(lens).alias("lens"))
    rows = rows.select(*keys, F.array_max("lens").alias("max_len"), F.size(F.filter("lens", lambda n: n > 0)).alias("used"), F.explode("lens").alias("len"))
    return rows.groupBy(*keys, "len", "max_len", "used").agg(F.count("*").alias("count"))


def decode_with(assembled: DataFrame, lsb: bool = False, inverted: bool = False, shift: int = 0, by_symbol: bool = False, reverse: bool = False, strict: bool = False, limit: int | None = None) -> DataFrame:
    """(stream, tokens, last_length): ``assembled(stream, data, symbols, lens, bits)`` decoded in one given
    way. Symbols may be of 8 or 16 bits; codes of one length follow the input's order or the symbols'
    (``by_symbol``) and are read from either end (``reverse``); bits that are no code end a stream, or
    with ``strict`` the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [
                decode(bits_of(data, lsb, inverted, shift, bits), codes(symbols, lens, by_symbol, reverse), limit, strict)
                for data, symbols, lens, bits in zip(*(b.column(c).to_pylist() for c in ("data", "symbols", "lens", "bits")))
            ]
            yield pa.RecordBatch.from_arrays([b.column("stream"), pa.array([t for t, _ in got], pa.list_(pa.int32())), pa.array([n[-1] if n else None for _, n in got], pa.int32())], names=["stream", "tokens", "last_length"])

    kind = dict(assembled.dtypes)["stream"]
    return assembled.select("stream", "data", "symbols", "lens", "bits").mapInArrow(run, f"stream {kind}, tokens array<int>, last_length int")


def decode_streams(assembled: DataFrame, prefix: int = 256) -> DataFrame:
    """``assembled(stream, data, symbols, lens, bits)`` with the chosen configuration, its score and the symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data, symbols, lens, bits in zip(*(b.column(c).to_pylist() for c in ("data", "symbols", "lens", "bits"))):
                k, score = best_config(data, symbols, lens, bits, prefix)
                rows.append((k, score, decode(bits_of(data, *CONFIGS[k], bits), codes(symbols, lens))[0]))
            cols = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([b.column("stream"), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.list_(pa.int32()))], names=["stream", "config", "score", "tokens"])

    return assembled.mapInArrow(run, "stream string, config int, score int, tokens array<int>")
