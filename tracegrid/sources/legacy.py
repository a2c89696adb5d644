"""Views of older record forms: the data header, a segment's metadata, a code's prelude.

Plain functions over bytes, and ``legacy_views`` for a table of them.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# The fields in the order of the bytes
HEADER_FIELDS = (
    ("ident", "i"), ("version", "i"), ("cmp_method", "i"), ("hpos", "i"), ("hlen", "i"), ("distortion", "i"), ("null_value", "f"),
    ("min_1", "i"), ("max_1", "i"), ("min_2", "i"), ("max_2", "i"), ("min_3", "i"), ("max_3", "i"),
    ("amin_1", "i"), ("amax_1", "i"), ("amin_2", "i"), ("amax_2", "i"), ("amin_3", "i"), ("amax_3", "i"),
)
TABLE, BLOCKS = 256, 64

_KINDS = {"i": "int", "f": "float"}
HEADER_SCHEMA = "struct<" + ", ".join(f"{n}: {_KINDS[k]}" for n, k in HEADER_FIELDS) + ", huffman: array<double>, metered: array<double>>"
METADATA_SCHEMA = "struct<min_delta: float, max_delta: float, quantized_deltas: array<int>, block_sizes_bits: array<int>>"
PRELUDE_SCHEMA = "struct<symbol_count: int, code_lengths: array<int>, symbols: array<int>, byte_size: int>"


def _order(little: bool) -> str:
    return "<" if little else ">"


def data_header(raw: bytes, little: bool) -> dict | None:
    """The data header's fields and its two tables of doubles; None if bytes are missing."""
    fmt = _order(little) + "".join(k for _, k in HEADER_FIELDS)
    size = struct.calcsize(fmt)
    if len(raw) < size + 16 * TABLE:
        return None
    doubles = np.frombuffer(raw, _order(little) + "f8", 2 * TABLE, size).astype(float).tolist()
    return {**dict(zip((n for n, _ in HEADER_FIELDS), struct.unpack(fmt, raw[:size]))), "huffman": doubles[:TABLE], "metered": doubles[TABLE:]}


def segment_metadata(raw: bytes, little: bool) -> dict | None:
    """Delta bounds, and 64 unsigned 16-bit deltas and block sizes; None if bytes are missing."""
    if len(raw) < 8 + 4 * BLOCKS:
        return None
    low, high = struct.unpack(_order(little) + "2f", raw[:8])
    numbers = np.frombuffer(raw, _order(little) + "u2", 2 * BLOCKS, 8).astype(int).tolist()
    return {"min_delta": low, "max_delta": high, "quantized_deltas": numbers[:BLOCKS], "block_sizes_bits": numbers[BLOCKS:]}


def code_prelude(raw: bytes, little: bool) -> dict | None:
    """A count, that many code lengths and that many symbols (bytes); None if bytes are missing."""
    n = int.from_bytes(raw[:2], "little" if little else "big")
    if len(raw) < 2 + 2 * n or len(raw) < 2:
        return None
    return {"symbol_count": n, "code_lengths": list(raw[2 : 2 + n]), "symbols": list(raw[2 + n : 2 + 2 * n]), "byte_size": 2 + 2 * n}


def legacy_views(rows: DataFrame, raw: str = "raw", little: str = "little") -> DataFrame:
    """``rows`` with the structs ``data_header``, ``segment_metadata`` and ``code_prelude`` of each row's bytes, null where they are too few."""
    fields = [f for f in rows.schema.fields if f.name not in ("data_header", "segment_metadata", "code_prelude")]
    names = [f.name for f in fields]
    kinds = {
        "data_header": pa.struct([(n, pa.int32() if k == "i" else pa.float32()) for n, k in HEADER_FIELDS] + [("huffman", pa.list_(pa.float64())), ("metered", pa.list_(pa.float64()))]),
        "segment_metadata": pa.struct([("min_delta", pa.float32()), ("max_delta", pa.float32()), ("quantized_deltas", pa.list_(pa.int32())), ("block_sizes_bits", pa.list_(pa.int32()))]),
        "code_prelude": pa.struct([("symbol_count", pa.int32()), ("code_lengths", pa.list_(pa.int32())), ("symbols", pa.list_(pa.int32())), ("byte_size", pa.int32())]),
    }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = list(zip(b.column(raw).to_pylist(), b.column(little).to_pylist()))
            new = [pa.array([f(x, bool(e)) if x is not None else None for x, e in both], kinds[f.__name__]) for f in (data_header, segment_metadata, code_prelude)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), *new], names=[*names, *kinds])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return rows.mapInArrow(run, f"{schema}, data_header {HEADER_SCHEMA}, segment_metadata {METADATA_SCHEMA}, code_prelude {PRELUDE_SCHEMA}")
