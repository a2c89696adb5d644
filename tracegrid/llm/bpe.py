"""Byte-level BPE: distinct words are folded through ranked merges by Spark
higher-order functions over a literal rank map; decoding concatenates the
binary pieces of the ids.

1. Python workers cut each text where the tokenizer's pattern is sure to cut (at
   single spaces and line breaks), and chunks of plain letters, digits and signs
   where the class of the characters changes; the distinct other chunks are cut
   by the pattern itself. Only distinct pieces leave a task.
2. Spark folds each distinct piece: an array of its bytes loses the pair of
   lowest rank step by step until no pair has a rank (``encode_pieces``).
3. The piece -> ids table becomes a hash store on the shared folder, which the
   workers map to write out each document's ids, gathered in NumPy. No text is ever shuffled, and nothing that grows with the corpus is
   broadcast.

Nulls and empty texts have no ids; the digests are then those of no bytes.
Repeated rows each get their own result; an empty table gives no rows. Of pairs
with the lowest rank the leftmost merges first. Texts may be of any length. Columns beyond ``id`` and ``text`` are
not read, so they may have any names. Pieces may have any length: those over
``LONG`` bytes merge all places of a pair in one step.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, HashStore, bucket_bits, gather, raw_texts, remove, saved, scan_bytes, shared_dir, slices, span_codes, tidy, write_store

_BYTE = np.arange(256)
#: ASCII characters that are visible, and lead bytes of UTF-8 that begin no white space.
SEEN = (_BYTE > 32) & (_BYTE < 127)
BEGINS = SEEN | ((_BYTE > 0xC2) & ~np.isin(_BYTE, [0xE1, 0xE2, 0xE3]))
#: Classes of bytes: the space, the line break, letters (with the lead bytes of two-byte letters
#: alone, and the bytes that follow a lead), digits, other visible ones; HARD: any other.
HARD = 5
CLASS = np.full(256, HARD, np.uint8)
CLASS[SEEN] = 4
CLASS[32], CLASS[10], CLASS[39] = 0, 1, HARD  # contractions begin with an apostrophe
CLASS[(_BYTE >= 48) & (_BYTE < 58)] = 3
CLASS[((_BYTE | 32) >= 97) & ((_BYTE | 32) < 123) & (_BYTE < 128)] = 2
CLASS[[0xC3, *range(0xC4, 0xCA), 0xD0, 0xD1, *range(0x80, 0xC0)]] = 2  # U+00C0 to U+027F, U+0400 to U+047F
ID = 17  # bits of a token id
MASK = (1 << ID) - 1
STEPS, SLOTS = 1 << 15, 1 << 18  # of the rank map
NONE = 1 << ID  # the rank of a pair that has none
LONG = 1024
CACHE = 1_000_000  # hashes of pieces that a task remembers
SLICE = 1 << 19
PIECES = np.random.default_rng(22).integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)  # the hash of a piece


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def piece_pattern(pattern: str):
    """The tokenizer's pattern with White_Space spelled out, as tiktoken reads it."""
    import regex

    return regex.compile(pattern.replace("\\s", "\\p{White_Space}").replace("\\S", "\\P{White_Space}"))


def pair_ranks(ranks: dict[bytes, int]) -> Iterator[tuple[tuple[int, int], int]]:
    """Every two tokens that join to a token, with its rank."""
    return (((ranks[t[:i]], ranks[t[i:]]), r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks)


def rank_table(ranks: dict[bytes, int]) -> np.ndarray:
    """The rank map as one flat array: STEPS steps, then SLOTS entries ``key << ID | rank``, -1 where there is none.

    A key is two packed ids. Its hash picks a step, and hash and step the one
    entry that can be its: steps are chosen so that no two keys share an entry.
    """
    pairs = [(x << ID | y, r) for (x, y), r in pair_ranks(ranks)]
    key, rank = np.array(pairs, np.int64).reshape(-1, 2).T
    h = np.fromiter((xxhash.xxh64_intdigest(k.to_bytes(8, "little"), seed=42) for k in key.tolist()), U64)
    group, first, stride = ((h >> U64(by)).astype(np.int64) & (size - 1) for by, size in ((0, STEPS), (15, SLOTS), (33, 1 << 31)))
    out = np.full(STEPS + SLOTS, -1)
    out[:STEPS] = 0
    order = np.argsort(group, kind="stable")
    groups = np.split(order, 1 + np.flatnonzero(np.diff(group[order]))) if len(order) else []
    for at in sorted(groups, key=len, reverse=True):
        for step in range(SLOTS):
            slots = STEPS + (first[at] + step * stride[at] & (SLOTS - 1))
            if (out[slots] < 0).all() and len(set(slots.tolist())) == len(at):
                out[group[at[0]]], out[slots] = step, key[at] << ID | rank[at]
                break
        else:
            raise ValueError("the rank map's keys find no places")
    return out


def rank_map(ranks: dict[bytes, int]) -> Column:
    """The literal rank map, as ``rank_table``.

    The driver holds it in every plan and task, and describes each plan in full
    before it cuts the description, so it is one flat array.
    """
    return F.from_json(F.lit("[" + ",".join(map(str, rank_table(ranks).tolist())) + "]"), "array<bigint>")


def _let(value: Column, body) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def encode_pieces(pieces: DataFrame, ranks: dict[bytes, int]) -> DataFrame:
    """``pieces(piece binary)`` with ``ids array<bigint>``, by Spark functions alone; null for those of over LONG bytes.

    The literal rank map is bound once as a lambda variable, so the plan holds it once.
    """
    singles = F.from_json(F.lit(json.dumps([ranks[bytes([b])] for b in range(256)])), "array<bigint>")
    ids = _let(rank_map(ranks), lambda table: _let(singles, lambda one: _folded(F.col("_s"), table, one)))
    return pieces.withColumn("_s", F.when(F.length("piece") <= LONG, F.decode("piece", "ISO-8859-1"))).withColumn("ids", ids).drop("_s")


def _folded(s: Column, table: Column, singles: Column) -> Column:
    """The ids of a piece given as Latin-1: one character a byte.

    The state is an array of longs: the rank of the pair that starts here, the
    byte offset and the token id, packed in this order. Its minimum is thus the
    leftmost pair of lowest rank, and that rank is the joined token's id. A
    first element that joins with nothing stands before the piece.
    """
    none, low = F.lit(NONE << 44), (1 << 44) - 1

    def rank(key: Column) -> Column:
        def entry(h: Column) -> Column:
            step = F.get(table, h.bitwiseAND(STEPS - 1).cast("int"))
            return F.get(table, ((F.shiftrightunsigned(h, 15) + step * F.shiftrightunsigned(h, 33)).bitwiseAND(SLOTS - 1) + STEPS).cast("int"))

        return _let(_let(F.xxhash64(key), entry), lambda e: F.when(F.shiftright(e, ID) == key, F.shiftleft(e.bitwiseAND(MASK), 44)).otherwise(none))

    def key(x: Column, y: Column) -> Column:
        return F.shiftleft(x, ID).bitwiseOR(y)

    def token(e: Column) -> Column:
        return e.bitwiseAND(MASK)

    def start(ids: Column) -> Column:
        ranks = F.transform(F.transform(ids, lambda x, i: key(x, F.get(ids, i + 1))), rank)
        pack = lambda r: F.transform(ids, lambda x, i: F.get(r, i).bitwiseOR(F.shiftleft(i.cast("bigint"), ID)).bitwiseOR(x))
        return F.concat(F.array(F.lit(NONE << 44 | MASK)), _let(ranks, pack))

    def merge(a: Column, m: Column, p: Column, before: Column, joined: Column) -> Column:
        """The pair at p (from 1) becomes one token; the pairs on its sides get new ranks."""
        new = F.transform(F.array(key(token(before), joined), key(joined, token(F.get(a, p + 1)))), rank)
        middle = _let(new, lambda r: F.array(F.get(r, F.lit(0)).bitwiseOR(before.bitwiseAND(low)), F.get(r, F.lit(1)).bitwiseOR(m.bitwiseAND(low ^ MASK)).bitwiseOR(joined)))
        return F.concat(F.slice(a, F.lit(1), p - 2), middle, F.slice(a, p + 2, F.size(a)))

    def step(a: Column, _: Column) -> Column:
        def at(m: Column) -> Column:
            place = lambda p: merge(a, m, p, F.get(a, p - 2), F.shiftright(m, 44))
            return F.when(m >= none, a).otherwise(_let(F.array_position(a, m).cast("int"), place))

        return _let(F.array_min(a), at)

    ids = F.transform(F.split(s, ""), lambda c: F.get(singles, F.ascii(c)))
    return F.aggregate(F.sequence(F.lit(1), F.length(s)), _let(ids, start), step, lambda a: F.transform(F.slice(a, F.lit(2), F.size(a)), token))


def heap_encode(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same merges by a heap, for pieces over LONG bytes: the fold's time
    grows with the square of a piece's length."""
    import heapq

    part = [piece[i : i + 1] for i in range(len(piece))]
    after = list(range(1, len(part) + 1))
    before = list(range(-1, len(part) - 1))
    heap = [(r, i, part[i], part[i + 1]) for i in range(len(part) - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, x, y = heapq.heappop(heap)
        j = after[i]
        if part[i] != x or j >= len(part) or part[j] != y:
            continue
        part[i], part[j], after[i] = x + y, b"", after[j]
        if after[i] < len(part):
            before[after[i]] = i
        for k in (before[i], i):
            if k >= 0 and after[k] < len(part) and (s := ranks.get(part[k] + part[after[k]])) is not None:
                heapq.heappush(heap, (s, k, part[k], part[after[k]]))
    return [ranks[x] for x in part if x]


def cut_units(col: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
    """The units of all texts in order, which distinct ones are pieces for sure, and each text's number of units.

    A unit is a piece or a chunk of several. Chunks begin before a space that a
    visible character follows, and on both sides of a line break between two
    visible ones: the pattern has a boundary there, and what it finds on one side
    does not depend on the other. Inside a chunk without HARD bytes and other
    white space, pieces begin where the class changes, but for the space.
    """
    raw, ends = raw_texts(col)
    start = np.zeros(len(raw) + 1, bool)
    kind = CLASS[raw]
    rough = kind == HARD
    if len(raw) > 2:
        start[:-2] = (raw[:-1] == 32) & BEGINS[raw[1:]]
        line = 1 + np.flatnonzero((raw[1:-1] == 10) & SEEN[raw[:-2]] & BEGINS[raw[2:]])
        start[line] = start[line + 1] = True
        rough[:-1] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))  # the signs of multiplication and division
    start[ends[1:-1][ends[1:-1] > 0] - 1] = False  # the next character is another text's
    rough |= (kind < 2) & ~start[:-1]
    start[ends] = True
    first = np.flatnonzero(start)  # the last one is the end
    total = np.r_[0, np.cumsum(rough)]
    plain = np.repeat(total[first[1:]] == total[first[:-1]], np.diff(first))
    if len(raw):
        start[1:-1] |= (kind[1:] != kind[:-1]) & (kind[:-1] != 0) & plain[1:]
        first = np.flatnonzero(start)
    units = pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(np.ascontiguousarray(first, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
    units = units.dictionary_encode()
    sure = np.zeros(len(units.dictionary), bool)
    sure[np.asarray(units.indices)[plain[first[:-1]]]] = True
    return units, sure, np.diff(np.searchsorted(first, ends))


def keys_of(pieces: pa.Array) -> np.ndarray:
    """The hashes of pieces given as large_binary."""
    ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1] if len(pieces) else np.zeros(1, np.int64)
    raw = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]] if len(pieces) else np.empty(0, np.uint8)
    return span_codes(raw, ends[:-1] - ends[0], ends[1:] - ends[0], PIECES)


def distinct_pieces(docs: DataFrame, text: str, pattern: str) -> DataFrame:
    """The distinct pieces of all texts, as ``piece binary``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = piece_pattern(pattern).findall, np.empty(0, U64)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                units, sure, _ = cut_units(part.column(text))
                names, more = units.dictionary, {p for c in units.dictionary.filter(pa.array(~sure)).to_pylist() for p in find(c.decode())}
                pieces = pa.concat_arrays([names.filter(pa.array(sure)), pa.array([p.encode() for p in more], pa.large_binary())])
                key = keys_of(pieces)
                order = np.argsort(key)
                at = np.searchsorted(seen, key[order])
                old = at < len(seen)
                old[old] = seen[at[old]] == key[order][old]
                new = np.ones(len(key), bool)
                new[order] = ~old
                seen = np.insert(seen, at[~old], key[order][~old]) if len(seen) < CACHE else key[order]
                yield pa.RecordBatch.from_pydict({"piece": pieces.filter(pa.array(new)).cast(pa.binary())})

    return docs.select(text).mapInArrow(tidy(cut), "piece binary").distinct()


@contextmanager
def short_plans(spark: SparkSession) -> Iterator[None]:
    """Inside, descriptions of plans are cut: the driver keeps each one, and the rank map would stand in all of them."""
    name = "spark.sql.maxPlanStringLength"
    before = spark.conf.get(name)
    spark.conf.set(name, "65536")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def piece_store(spark: SparkSession, docs: DataFrame, text: str, rank_path: str, pattern: str) -> tuple[str, int]:
    """A store of the ids of every distinct piece: path and bits."""
    bits = bucket_bits(scan_bytes(docs), 32 << 20)
    ranks = load_ranks(rank_path)
    # an even deal: a task reads the literal anew, so there are as many as make them worth it
    pieces = saved(distinct_pieces(docs, text, pattern).repartition(min(4096, max(8, scan_bytes(docs) >> 24))), spark, "pieces")
    encoded = encode_pieces(pieces, ranks)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, ends = np.asarray(b.column("ids").flatten(), "<u4"), 4 * np.asarray(b.column("ids").offsets)
            flat, ends = memoryview(flat).cast("B"), (ends - ends[0]).tolist()
            raw = [flat[s:e] for s, e in zip(ends, ends[1:])]
            for i in np.flatnonzero(b.column("ids").is_null()).tolist():  # long ones
                raw[i] = np.array(heap_encode(b.column("piece")[i].as_py(), ranks), "<u4").tobytes()
            key = keys_of(b.column("piece").cast(pa.large_binary()))
            yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "raw": pa.array(raw, pa.binary())})

    path = shared_dir(spark, "bpe")
    with short_plans(spark):
        write_store(encoded.mapInArrow(tidy(packed), "key long, raw binary"), path, bits, blob="raw", distinct=True)
    remove(pieces)
    return path, bits


class Encoder:
    """Ids of texts by a piece store, which holds each piece of them."""

    def __init__(self, path: str, bits: int, pattern: str):
        self.store, self.find = HashStore(path, bits), piece_pattern(pattern).findall

    def __call__(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and the places where texts begin and end."""
        units, sure, counts = cut_units(col)
        n_pieces, pieces = np.ones(len(sure), np.int64), units.dictionary
        if not sure.all():
            own = [[c] if k else [p.encode() for p in self.find(c.decode())] for c, k in zip(pieces.to_pylist(), sure.tolist())]
            n_pieces, pieces = np.fromiter(map(len, own), np.int64, len(own)), pa.array([p for ps in own for p in ps], pa.large_binary())
        flat, size = self.store.runs(keys_of(pieces), "<u4")
        size = np.add.reduceat(size, np.cumsum(n_pieces) - n_pieces) if len(size) else size  # no unit is without a piece
        which = np.asarray(units.indices)
        ends = np.r_[0, np.cumsum(size[which])]
        return gather(flat, (np.cumsum(size) - size)[which], size[which]), ends[np.r_[0, np.cumsum(counts)]]


def encode(spark: SparkSession, docs: DataFrame, rank_path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>) of each row of ``docs``."""
    return _encoded(spark, docs, rank_path, pattern, id, text, digests=False)


def encode_digests(spark: SparkSession, docs: DataFrame, rank_path: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): the ids' digest and that of their decoding."""
    return _encoded(spark, docs, rank_path, pattern, id, text, digests=True)


def _digests(data: memoryview, ends: np.ndarray) -> list[str]:
    ends = ends.tolist()
    return [hashlib.sha256(data[s:e]).hexdigest() for s, e in zip(ends, ends[1:])]


def _encoded(spark, docs, rank_path, pattern, id, text, digests):
    path, bits = piece_store(spark, docs, text, rank_path, pattern)
    ranks = load_ranks(rank_path)
    vocabulary = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        vocabulary[rank] = piece
    vocabulary = spark.sparkContext.broadcast(vocabulary)  # of the tokenizer's fixed size

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, names = Encoder(path, bits, pattern), pa.array(vocabulary.value, pa.binary())
        for batch in batches:
            for part in slices(batch, text, SLICE):
                ids, ends = encoder(part.column(text))
                if digests:
                    decoded = names.take(pa.array(ids))  # its bytes stand in one buffer
                    at = np.frombuffer(decoded.buffers()[1], np.int32)[: len(ids) + 1][ends] if len(ids) else ends
                    new = {
                        "n_tokens": pa.array(np.diff(ends)),
                        "ids_sha256": _digests(memoryview(ids).cast("B"), 4 * ends),
                        "decoded_sha256": _digests(memoryview(decoded.buffers()[2] or b""), at),
                    }
                else:
                    new = {"ids": pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))}
                yield pa.RecordBatch.from_pydict({id: part.column(id), **new})

    kind = dict(docs.dtypes)[id]
    out = f"`{id}` {kind}, " + ("n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>")
    return docs.select(id, text).mapInArrow(tidy(write), out)


def decode(encoded: DataFrame, rank_path: str, id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, decoded binary): the ids' pieces, joined by Spark functions; null ids give no bytes."""
    ranks = load_ranks(rank_path)
    table = [""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        table[rank] = piece.hex()
    names = F.split(F.lit(",".join(table)), ",")
    pieces = F.transform(F.coalesce(F.col(ids), F.array().cast("array<int>")), lambda i: F.get(names, i))
    return encoded.select(id, F.unhex(F.array_join(pieces, "")).alias("decoded"))
