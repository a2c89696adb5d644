"""Line dedup by content-defined chunks.

A text is cut in lines (at line breaks, and inside them after the ends of
sentences and clauses, so that a line's edit spoils little of a passage).
A rolling hash over the hashes of WINDOW lines marks chunk boundaries, so a
boundary depends on the lines beside it alone and moves along with a passage.
Units are the chunks of several lines and, at every line's start, the shortest
run of lines of RUN words or more: a passage of that many words in whole lines
begins with such a run, so it is found whatever stands beside it. A unit that
stands elsewhere too is kept in the document of smallest id (its first place
there) and removed from all other places, after a comparison of the bytes,
together with equal lines on its sides.

Three narrow passes over the texts, and two small stores between them:
units' hashes are counted with a combiner; the repeated ones go to a hash store
with the document that keeps them; that document's bytes go to a second one in
pieces that neighbouring units share (with a few lines on each side), dealt by
hash. Texts are never shuffled, and a unit that stands in a third of all
documents is one row of a store.

A null text stays null and an empty one empty. Rows that repeat an id count
as the same document: what one of them keeps, the other keeps; of ties the
first place in a text is kept. A text without a unit that qualifies is
unchanged. Lines may hold any characters, and texts may be very long (a text is
one task's at a time); lines are compared as bytes, without the ASCII blanks at
their ends. An empty table gives no rows. Columns beside id and text pass
through; the two ``counts`` replace columns so named.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import HashStore, U64, bucket_bits, hash_bytes, mix, raw_texts, scan_bytes, shared_dir, slices, span_codes, tidy, write_store

#: Where lines begin.
CUT = re.compile(r"(?<=\n)|(?<=[.!?,;:] )")
CLAUSE = np.isin(np.arange(256), list(b".!?,;:"))
BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
BYTES = np.random.default_rng(23).integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)  # of a line's hash
WINDOW = 2
MEAN = 2  # a boundary after one line in so many
WORDS = 8  # of a chunk, at least
RUN = 30  # words of a run of lines, at least
SIDE = 6  # lines kept on each side of a unit for the comparison, at least
PIECE = 48  # lines in which the units of a piece begin
ODD, INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def _trim(raw: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the lines begin and end without blanks."""
    head, tail = low.copy(), high.copy()
    for step in range(4):
        tail -= (tail > head) & BLANK[raw[tail - 1]]
        if step < 2:
            head += (head < tail) & BLANK[raw[np.minimum(head, len(raw) - 1)]]
    more = (tail > head) & (BLANK[raw[tail - 1]] | BLANK[raw[np.minimum(head, len(raw) - 1)]])
    for i in np.flatnonzero(more).tolist():
        line = raw[head[i] : tail[i]].tobytes()
        head[i] += len(line) - len(line.lstrip())
        tail[i] = head[i] + len(line.strip())
    return head, tail


class Chunks:
    """The lines and units of a batch of texts, as flat arrays; a key's units in the order of their places."""

    def __init__(self, col: pa.Array):
        raw, ends = raw_texts(col)
        cut = np.zeros(len(raw) + 1, bool)
        cut[1:][raw == 10] = True
        cut[2:][(raw[1:] == 32) & CLAUSE[raw[:-1]]] = True
        cut[ends[ends < len(raw)]] = True
        cut[len(raw) :] = False
        low = np.flatnonzero(cut)
        high = np.r_[low[1:], len(raw)][: len(low)]
        self.start = np.searchsorted(low, ends)
        self.count = np.diff(self.start)
        self.low, self.high = low, high
        self.head, self.tail = _trim(raw, low, high)
        self.bytes = raw.tobytes()
        n = len(low)
        own = np.repeat(np.arange(len(ends) - 1), self.count)
        h = span_codes(raw, self.head, self.tail, BYTES)
        spaces = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(raw == 32, out=spaces[1:])
        words_ = np.where(self.tail > self.head, spaces[self.tail] - spaces[self.head] + 1, 0)
        inside = np.arange(n) - np.repeat(self.start[:-1], self.count)
        roll = h.copy()
        for k in range(1, WINDOW):
            at = np.flatnonzero(inside >= k)  # a text's first lines know nothing of the text before
            roll[at] = mix(roll[at] * U64(3) + h[at - k] * U64(2 * k + 5))
        last = np.zeros(n, bool)
        if n:
            last = roll % U64(MEAN) == 0
            last[:-1] |= own[1:] != own[:-1]
            last[-1] = True
        first = np.flatnonzero(np.r_[True, last[:-1]]) if n else np.empty(0, np.int64)
        end = np.r_[first[1:], n] if n else first
        place = np.arange(n) - np.repeat(first, end - first)
        code = mix(h + place.astype(U64) * U64(0x9E3779B97F4A7C15))
        key = np.add.reduceat(code, first) if n else np.empty(0, U64)
        self.total = np.concatenate([[0], np.cumsum(words_)])
        good = (self.total[end] - self.total[first] >= WORDS) & (end - first > 1)
        # runs, by differences of a polynomial's sums
        head = np.flatnonzero(words_ > 0)
        tail = np.searchsorted(self.total, self.total[head] + RUN)
        fits = tail <= self.start[1:][own[head]]
        head, tail = head[fits], tail[fits]
        power, back = (np.cumprod(np.r_[U64(1), np.full(n, c, U64)], dtype=U64) for c in (ODD, INVERSE))
        sums = np.r_[U64(0), np.cumsum(h * power[:n], dtype=U64)]
        runs = mix((sums[tail] - sums[head]) * back[head] + (tail - head).astype(U64))
        self.first, self.end, self.key = np.r_[first[good], head], np.r_[end[good], tail], np.r_[key[good], runs]
        self.doc = own[self.first]

    def raw(self, s: int, e: int) -> list[bytes]:
        """The lines s to e without the blanks at their ends."""
        return [self.bytes[x:y] for x, y in zip(self.head[s:e].tolist(), self.tail[s:e].tolist())]

    def left(self, doc: int, gone: np.ndarray) -> str:
        """The text of a document without the lines that are gone."""
        s, e = self.start[doc], self.start[doc + 1]
        return b"".join([self.bytes[x:y] for x, y, g in zip(self.low[s:e].tolist(), self.high[s:e].tolist(), gone[s:e].tolist()) if not g]).decode()

    def pieces(self, at: np.ndarray) -> Iterator[tuple[int, int, list[int]]]:
        """First line and end of each piece for the units ``at``, with the units that begin in it."""
        at = at[np.argsort(self.first[at], kind="stable")].tolist()
        k = 0
        while k < len(at):
            d, low, end, m = self.doc[at[k]], self.first[at[k]], self.end[at[k]], k + 1
            while m < len(at) and self.first[at[m]] < min(end + 1, low + PIECE, self.start[d + 1]):
                end = max(end, self.end[at[m]])
                m += 1
            ahead = max(end + SIDE, int(np.searchsorted(self.total, self.total[end] + RUN)))
            yield int(max(self.start[d], low - SIDE)), int(min(self.start[d + 1], ahead)), at[k:m]
            k = m


def _pack(lines: list[bytes]) -> bytes:
    size = np.array([len(lines), *(len(x) for x in lines)], np.int32)
    return b"".join([size.tobytes(), *lines])


def _lines(raw: bytes) -> list[bytes]:
    n = int(np.frombuffer(raw, np.int32, 1)[0])
    ends = np.r_[0, np.cumsum(np.frombuffer(raw, np.int32, n, 4))] + 4 * n + 4
    return [raw[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist())]


def dedup(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with repeated units removed from the text, and the numbers of lines and of removed ones as ``counts``."""
    bits = bucket_bits(scan_bytes(docs), 64 << 20)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))

    def unit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                c = Chunks(part.column("text"))
                yield pa.RecordBatch.from_pydict({"key": pa.array(c.key.view(np.int64)), "id": part.column("id").take(pa.array(c.doc))})

    keepers = shared_dir(spark, "keepers")
    counted = rows.mapInArrow(tidy(unit_keys), "key long, id long").groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("id"))
    write_store(counted.filter("n > 1").select("key", F.coalesce("id", F.lit(-1)).alias("id")), keepers, bits)

    def kept_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = HashStore(keepers, bits)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                c = Chunks(part.column("text"))
                own = np.array(part.column("id").fill_null(-1))[c.doc]
                found, got = store.find(c.key, id=np.int64)
                at = np.flatnonzero(found & (got["id"] == own))
                at = at[np.lexsort((c.first[at], c.key[at], c.doc[at]))]
                doc, key = c.doc[at], c.key[at]
                at = at[np.r_[True, (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])][: len(at)]]
                keys, piece, off, blob = [], [], [], []
                for s, e, units in c.pieces(at):
                    raw = _pack(c.raw(s, e))
                    name = int(hash_bytes([raw]).view(np.int64)[0])
                    keys += [name, *c.key[units].view(np.int64).tolist()]
                    piece += [0, *[name] * len(units)]
                    off += [0, *(c.first[units] - s).tolist()]
                    blob += [raw, *[b""] * len(units)]
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "piece": pa.array(piece, pa.int64()), "off": pa.array(off, pa.int64()), "own": pa.array(blob, pa.binary())})

    kept = shared_dir(spark, "kept")
    place = F.min(F.struct("piece", "off"))
    whole = rows.mapInArrow(tidy(kept_bytes), "key long, piece long, off long, own binary").groupBy("key").agg(place.alias("p"), F.max("own").alias("own"))
    write_store(whole.select("key", "p.piece", "p.off", "own"), kept, bits, blob="own")
    fields = [f for f in docs.schema.fields if f.name not in counts]
    schema = StructType([StructField(f.name, StringType() if f.name == text else f.dataType) for f in fields] + [StructField(c, LongType()) for c in counts])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keeper, bytes_ = HashStore(keepers, bits), HashStore(kept, bits)
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                col = part.column(text)
                c = Chunks(col)
                own = np.array(part.column(id).cast(pa.int64()).fill_null(-1))[c.doc]
                found, got = keeper.find(c.key, id=np.int64)
                at, who = np.flatnonzero(found), got["id"][found]
                gone = np.zeros(len(c.low), bool)
                seen: set[tuple[int, int]] = set()
                start = c.start.tolist()
                have, where = bytes_.find(c.key[at], piece=np.int64, off=np.int64)
                names = np.unique(where["piece"][have])
                held = {p: _lines(x) for p, x in zip(names.tolist(), bytes_.blobs(names.view(U64))) if x}
                done: dict[tuple[int, int], tuple[int, int]] = {}  # by piece and its place: lines found equal
                units = (x.tolist() for x in (c.first[at], c.end[at], c.doc[at], c.key[at], who == own[at], where["piece"], where["off"]))
                for s, e, d, key, keeps, p, o in zip(*units):
                    if keeps and (d, key) not in seen:
                        seen.add((d, key))
                        continue
                    piece = held.get(p)
                    if piece is None:
                        continue
                    if not keeps:
                        low, high = done.get((p, s - o), (0, 0))
                        if low <= s and e <= high:
                            continue
                    if piece[o : o + e - s] != c.raw(s, e):
                        continue
                    if not keeps:
                        low, high, m, at_piece = start[d], start[d + 1], o + e - s, s - o
                        while s > low and o > 0 and c.raw(s - 1, s)[0] == piece[o - 1]:
                            s, o = s - 1, o - 1
                        while e < high and m < len(piece) and c.raw(e, e + 1)[0] == piece[m]:
                            e, m = e + 1, m + 1
                        done[p, at_piece] = s, e
                    gone[s:e] = True
                removed = np.diff(np.r_[0, np.cumsum(gone)][c.start])
                new = col.cast(pa.string())
                if gone.any():
                    at = np.flatnonzero(removed)
                    cut = np.zeros(len(new), bool)
                    cut[at] = True
                    new = pa.compute.replace_with_mask(pa.concat_arrays([new]), pa.array(cut), pa.array([c.left(d, gone) for d in at.tolist()], pa.string()))
                cols = {f.name: (new if f.name == text else part.column(f.name)) for f in fields}
                yield pa.RecordBatch.from_arrays([*cols.values(), pa.array(c.count), pa.array(removed)], names=[*cols, *counts])

    return docs.select(*(f.name for f in fields)).mapInArrow(tidy(strip), schema)
