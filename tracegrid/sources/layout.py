"""The binary layout: header, offset table, extents. Plain functions over positional reads."""

from __future__ import annotations

import os
import struct
from bisect import bisect_right

# The header's fields in file order, from byte 0, and its sizes
FIELDS = (
    ("dirty", "i"), ("ident", "i"), ("version", "i"), ("ot_pos", "q"), ("hdr_pos", "q"), ("rec_pos_0", "q"), ("rec_pos_1", "q"), ("hdr_len", "i"), ("rec_len", "i"),
    ("min_1", "i"), ("max_1", "i"), ("min_2", "i"), ("max_2", "i"), ("min_3", "i"), ("max_3", "i"), ("fast", "i"), ("middle", "i"), ("slow", "i"),
)
FORMAT = "".join(f for _, f in FIELDS)
HEADER, RECORD = 1024, 8192
MAGIC, VERSIONS = 390179341, range(1000, 1101)


class Extents:
    """A file and its numbered continuations (name00001.ext, ...), read as one."""

    def __init__(self, path: str):
        stem, ext = os.path.splitext(path)
        self.paths, self.starts, self.size = [], [], 0
        while os.path.isfile(p := path if not self.paths else f"{stem}{len(self.paths):05d}{ext}"):
            self.paths.append(p)
            self.starts.append(self.size)
            self.size += os.path.getsize(p)
        if not self.paths:
            raise FileNotFoundError(path)
        if self.size < HEADER:
            raise ValueError(f"{path}: {self.size} bytes are no header")

    def read(self, at: int, size: int) -> bytes:
        """Up to ``size`` bytes from ``at``, across extents; fewer at the end."""
        out = b""
        while size > 0 and 0 <= at < self.size:
            k = bisect_right(self.starts, at) - 1
            with open(self.paths[k], "rb") as f:
                f.seek(at - self.starts[k])
                part = f.read(size)
            out, at, size = out + part, at + len(part), size - len(part)
        return out


def cells(h: dict) -> tuple[int, int, int]:
    return tuple(h[f"max_{k}"] - h[f"min_{k}"] + 1 for k in (1, 2, 3))


def count(h: dict) -> int:
    a, b, c = cells(h)
    return a * b * c if min(a, b, c) > 0 else -1


def parse_header(raw: bytes, little: bool) -> dict:
    fmt = ("<" if little else ">") + FORMAT
    return dict(zip((n for n, _ in FIELDS), struct.unpack(fmt, raw[: struct.calcsize(fmt)].ljust(struct.calcsize(fmt), b"\0"))))


def score_terms(h: dict, size: int) -> dict[str, int]:
    """The points for each way in which a header makes sense; 16 in all."""
    n = count(h)
    expected = h["ot_pos"] + 8 * n + h["hdr_len"]
    return {
        "table": 2 * (HEADER <= h["ot_pos"] < size),
        "header": 2 * (h["ot_pos"] < h["hdr_pos"] < size),
        "first": 2 * (h["hdr_pos"] <= h["rec_pos_0"] < size),
        "last": 2 * (h["rec_pos_0"] < h["rec_pos_1"] <= max(size, h["rec_pos_0"]) + (64 << 20)),
        "record": 2 * (h["rec_len"] == RECORD),
        "length": 1 * (1024 <= h["hdr_len"] <= 1 << 16),
        "count": 2 * (0 < n < 10**9),
        "distance": 3 * (n > 0 and min(abs(h["rec_pos_0"] - expected), abs(h["rec_pos_0"] - expected - 8)) <= 32),
    }


def by_magic(raw: bytes) -> bool | None:
    """Whether the file is little-endian by its magic and version; None if neither order fits."""
    for little in (False, True):
        h = parse_header(raw, little)
        if h["ident"] == MAGIC and h["version"] in VERSIONS:
            return little
    return None


def offset_base(file: Extents, h: dict, little: bool) -> int:
    """Where the offset table starts: at ot_pos or 8 bytes on, by which has more plausible entries at both ends."""
    n = count(h)
    order = "little" if little else "big"

    def hits(base: int) -> int:
        take = min(16, n)
        ends = []
        for start in (base, base + 8 * (n - take)):
            raw = file.read(start, 8 * take)
            ends += [int.from_bytes(raw[i : i + 8], order, signed=True) for i in range(0, len(raw) - 7, 8)]
        return sum(0 <= off < h["rec_pos_1"] or off == 0 for off in ends)

    plain, led = h["ot_pos"], h["ot_pos"] + 8
    base = led if hits(led) > hits(plain) else plain
    if h["rec_pos_0"] < base + 8 * n + h["hdr_len"] - 64:
        base = plain if base == led else led
    return base


def read_header(file: Extents) -> dict:
    """The header in the byte order of the higher score, with little, score, n_cells, ot_base and magic_little (by_magic)."""
    raw = file.read(0, HEADER)
    both = [(sum(score_terms(h, file.size).values()), little, h) for little in (False, True) for h in (parse_header(raw, little),)]
    score, little, h = max(both, key=lambda x: x[0])  # big-endian comes first and wins ties
    if score <= 0:
        raise ValueError("the header makes sense in neither byte order")
    if not h["ot_pos"] < h["hdr_pos"] < h["rec_pos_0"]:
        raise ValueError(f"positions out of order: {h['ot_pos']}, {h['hdr_pos']}, {h['rec_pos_0']}")
    h["rec_len"] = h["rec_len"] if h["rec_len"] > 0 else RECORD
    return {**h, "little": little, "score": score, "n_cells": count(h), "ot_base": offset_base(file, h, little), "magic_little": by_magic(raw)}
