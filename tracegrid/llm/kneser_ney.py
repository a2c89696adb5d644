"""Language-model scoring: interpolated modified Kneser-Ney over words.

A bigram model. (With this corpus a trigram table would hold nearly as many
entries as the corpus has tokens; see the README.)

1. Words are counted in Spark; a store keeps each word's count and its place in
   the sorted order, its number.
2. Bigrams are packed (left number, right number) in one long, counted with a
   combiner in each task, dealt by hash, and written as sorted hash arrays with
   their counts. Each bucket also adds up what it knows of each left word (sum
   and counts-of-counts) and of each right word (continuations); those are
   dealt by word number, so a very common word is a small array entry.
3. Workers memory-map the arrays; a batch's bigrams are looked up sorted.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, then one end. The
base is the unigram score with add-half smoothing. A null text is empty and
has one token, its end. Unknown words get the share that smoothing leaves over
a uniform distribution. Repeated rows each get a score. With no training text
at all, every token has the uniform probability. Very long texts are scored
whole, one at a time; ties cannot arise. An empty table gives no rows. Extra
columns are not read.
"""

from __future__ import annotations

import os
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HashStore, U64, bucket_bits, hash_bytes, mix, put_bucket, saved, scan_bytes, shared_dir, slices, tidy, words

END = 0  # the number of the end token; words count from 2
START = 1  # the context of a first word
UNKNOWN = np.int64(0xFFFFFFFF)
SLICE = 4 << 20
RANGE_BITS = 13  # word numbers a range file holds
COLUMNS = ("sum", "n1", "n2", "n3", "cont")  # of a word in a range file
OPEN = 512  # range files that a worker keeps mapped


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """(key long, word binary, n long) of each distinct word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, SLICE):
                idx, names, _ = words(part.column(text))
                n = np.bincount(idx, minlength=len(names))
                yield pa.RecordBatch.from_pydict({"key": pa.array(hash_bytes(names).view(np.int64)), "n": pa.array(n, pa.int64())})

    return docs.select(text).mapInArrow(tidy(count), "key long, n long").filter("n > 0").groupBy("key").agg(F.sum("n").alias("n"))


class Lexicon:
    """Word numbers and counts; a word's number is its place among all sorted keys, plus 2."""

    def __init__(self, path: str, bits: int, first: list[int]):
        self.store, self.first = HashStore(path, bits), np.array(first, np.int64)

    def __call__(self, names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        keys = hash_bytes(names)
        number, count = np.full(len(keys), UNKNOWN), np.zeros(len(keys), np.int64)
        for b, rows, at in self.store._runs(keys):
            number[rows] = self.first[b] + at + 2
            count[rows] = self.store.column(b, "n")[at]
        return number, count


def _bigrams(part: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, ...]:
    """Of each token of each text (ends included): left and right numbers, counts, known; and tokens a text."""
    idx, names, lens = words(part)
    number, count = lexicon(names)
    n = len(lens)
    stops = np.cumsum(lens)
    right = np.insert(number[idx] if len(idx) else np.empty(0, np.int64), stops, END)
    counts = np.insert(count[idx] if len(idx) else np.empty(0, np.int64), stops, -1)
    left = np.empty_like(right)
    left[1:] = right[:-1]
    left[np.r_[0, (stops + np.arange(1, n + 1))[:-1]]] = START
    return left, right, counts, lens + 1


class Model:
    """A trained model's places and totals; small, and sent with the tasks."""

    def __init__(self, **parts):
        self.__dict__.update(parts)

    def opened(self) -> Model:
        out = Model(**self.__dict__)
        out.lexicon = Lexicon(self.words, self.word_bits, self.first)
        out.pairs = HashStore(self.bigrams, self.pair_bits)
        out.ranges = OrderedDict()
        return out

    def range_file(self, r: int) -> np.ndarray | None:
        if r not in self.ranges:
            file = f"{self.dense}/{r:05d}.t.npy"
            self.ranges[r] = np.load(file, mmap_mode="r") if os.path.exists(file) else None
            if len(self.ranges) > OPEN:
                self.ranges.popitem(last=False)
        return self.ranges[r]

    def of_word(self, number: np.ndarray, names: tuple[str, ...]) -> list[np.ndarray]:
        """Dense per-word columns: sum, n1, n2, n3 of what follows a word, and its continuations."""
        out = [np.zeros(len(number), np.int64) for _ in names]
        where = number >> RANGE_BITS
        for r in np.unique(where[number != UNKNOWN]):
            rows = np.flatnonzero(where == r)
            if (have := self.range_file(int(r))) is not None:
                for o, name in zip(out, names):
                    o[rows] = have[COLUMNS.index(name), number[rows] & ((1 << RANGE_BITS) - 1)]
        return out

    def score(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """log10 probability of each right word after its left one."""
        word, back = np.unique(np.r_[left, right], return_inverse=True)
        total, n1, n2, n3, cont = self.of_word(word, ("sum", "n1", "n2", "n3", "cont"))
        d1, d2, d3 = self.low_discounts
        types = max(1, self.types)
        spare = (d1 * self.low[0] + d2 * self.low[1] + d3 * self.low[2]) / types if self.types else 1.0
        discount = np.choose(np.minimum(cont, 3), [0.0, d1, d2, d3])
        low = np.maximum(cont - discount, 0) / types + spare / (self.vocabulary + 1)
        e1, e2, e3 = self.discounts
        left_at, right_at = back[: len(left)], back[len(left) :]
        kept = np.where(total > 0, (e1 * n1 + e2 * n2 + e3 * n3) / np.maximum(total, 1), 1.0)
        p = kept[left_at] * low[right_at]
        pair, again = np.unique(mix(left.astype(U64) << U64(32) | right.astype(U64)), return_inverse=True)
        _, got = self.pairs.find(pair, n=np.int64)
        c = got["n"][again]
        seen = c > 0
        top = np.maximum(c - np.choose(np.minimum(c, 3), [0.0, e1, e2, e3]), 0)
        p[seen] += top[seen] / total[left_at][seen]
        return np.log10(p)


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the counts of counts 1 to 4; 0.5, 1, 1.5 where a count is missing."""
    n1, n2, n3, n4 = n
    if min(n1, n2, n3) == 0:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(float(min(k, max(0.0, d))) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def fit(spark: SparkSession, docs: DataFrame, text: str = "text") -> Model:
    size = scan_bytes(docs)
    # ---- words
    bits, path = bucket_bits(size, 32 << 20), shared_dir(spark, "words")

    def write_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        key, n = table.column("key").to_numpy().view(U64), table.column("n").to_numpy()
        order = np.argsort(key)
        key, n = key[order], n[order]
        where = (key >> U64(64 - bits)).astype(np.int64)
        for b in np.unique(where):
            s = slice(*np.searchsorted(where, [b, b + 1]))
            put_bucket(path, int(b), {"key": key[s], "n": n[s]})
            yield pa.RecordBatch.from_pydict({"b": pa.array([int(b)], pa.int64()), "v": pa.array([len(key[s])], pa.int64()), "n": pa.array([int(n[s].sum())], pa.int64())})

    counted = count_words(docs, text).withColumn("_b", F.shiftrightunsigned("key", 64 - bits)).repartition(2**bits, "_b").drop("_b")
    sizes = np.zeros(2**bits, np.int64)
    tokens = 0
    for r in counted.mapInArrow(tidy(write_words), "b long, v long, n long").collect():  # a row a bucket
        sizes[r.b] = r.v
        tokens += r.n
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]]).tolist()
    vocabulary = int(sizes.sum())
    if vocabulary + 2 >= int(UNKNOWN):
        raise ValueError("more words than 32-bit numbers")
    # ---- bigrams
    pair_bits = bucket_bits(size, 8 << 20)
    shift = U64(64 - pair_bits)

    def count_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(path, bits, first)
        for batch in batches:
            for part in slices(batch, text, SLICE):
                left, right, _, lens = _bigrams(part.column(text), lexicon)
                key, n = np.unique(mix(left.astype(U64) << U64(32) | right.astype(U64)), return_counts=True)
                where = (key >> shift).astype(np.int64)
                cuts = np.searchsorted(where, np.arange(2**pair_bits + 1))
                some = np.flatnonzero(np.diff(cuts))
                blobs = [_pack(key[cuts[b] : cuts[b + 1]], np.minimum(n[cuts[b] : cuts[b + 1]], 255).astype(np.uint8), np.array(n[cuts[b] : cuts[b + 1]][n[cuts[b] : cuts[b + 1]] >= 255], np.int64)) for b in some]
                yield pa.RecordBatch.from_pydict({"b": pa.array(some, pa.int64()), "size": pa.array(np.diff(cuts)[some], pa.int64()), "docs": pa.array([len(lens) if k == 0 else 0 for k in range(len(some))], pa.int64()), "blob": pa.array(blobs, pa.binary())})

    grams = shared_dir(spark, "bigrams")

    def unpack(blob: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
        key = np.frombuffer(blob, U64, size)
        n = np.frombuffer(blob, np.uint8, size, 8 * size).astype(np.int64)
        n[n == 255] = np.frombuffer(blob[9 * size :], np.int64)
        return key, n

    def write_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        texts_ = 0
        for batch in batches:
            for b, size, n, blob in zip(*(batch.column(c).to_pylist() for c in ("b", "size", "docs", "blob"))):
                parts.setdefault(b, []).append(unpack(blob, size))
                texts_ += n
        for b, some in parts.items():
            key = np.concatenate([k for k, _ in some])
            n = np.concatenate([c for _, c in some])
            order = np.argsort(key, kind="stable")
            key, n = key[order], n[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            key, n = key[starts], np.add.reduceat(n, starts)
            put_bucket(grams, b, {"key": key, "n": n.astype(np.uint32) if n.max() < 2**32 else n})
            pair = unmix(key)
            left, right = (pair >> U64(32)).astype(np.int64), (pair & U64(0xFFFFFFFF)).astype(np.int64)
            counts = np.bincount(np.minimum(n, 5), minlength=6)[1:5]
            for kind, number, columns in ((0, left, (n, n == 1, n == 2, n >= 3)), (1, right, (np.ones(len(n), np.int64),))):
                ids, back = np.unique(number, return_inverse=True)
                sums = [np.bincount(back, c).astype(np.int64) for c in columns]
                where = ids >> RANGE_BITS
                for r in np.unique(where):
                    s = slice(*np.searchsorted(where, [r, r + 1]))
                    yield pa.RecordBatch.from_pydict({"kind": pa.array([kind], pa.int32()), "r": pa.array([int(r)], pa.int64()), "size": pa.array([s.stop - s.start], pa.int64()), "blob": pa.array([_pack(ids[s], *(c[s] for c in sums))], pa.binary())})
            yield pa.RecordBatch.from_pydict({"kind": pa.array([2], pa.int32()), "r": pa.array([texts_], pa.int64()), "size": pa.array([len(n)], pa.int64()), "blob": pa.array([_pack(counts.astype(np.int64))], pa.binary())})
            texts_ = 0

    pairs = docs.select(text).mapInArrow(tidy(count_pairs), "b long, size long, docs long, blob binary").repartition(2**pair_bits, "b")
    sums = saved(pairs.mapInArrow(tidy(write_pairs), "kind int, r long, size long, blob binary"), spark, "sums")
    # ---- per word
    dense, width = shared_dir(spark, "dense"), 1 << RANGE_BITS

    def write_dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in batches:
            for kind, r, size, blob in zip(*(batch.column(c).to_pylist() for c in ("kind", "r", "size", "blob"))):
                table = tables.setdefault(r, np.zeros((5, width), np.int64))
                rows = np.frombuffer(blob, np.int64).reshape(-1, size)
                at = rows[0] & (width - 1)
                if kind == 0:
                    table[:4, at] += rows[1:]
                else:
                    table[4, at] += rows[1]
        for r, table in tables.items():
            put_bucket(dense, r, {"t": table})
            c = table[4]
            low = [int((c == k).sum()) for k in (1, 2, 3, 4)]
            yield pa.RecordBatch.from_pydict({"c": pa.array([[*low, int((c >= 3).sum()), int(c.sum())]], pa.list_(pa.int64()))})

    files = (vocabulary + 2 >> RANGE_BITS) + 1
    tasks = max(1, min(files, 1 << 16, size >> 24))
    got = sums.filter("kind < 2").repartition(tasks, "r").mapInArrow(tidy(write_dense), "c array<bigint>").collect()  # a row a range file
    low = np.sum([r.c for r in got], axis=0) if got else np.zeros(6, np.int64)
    top = np.zeros(4, np.int64)
    ends = 0
    for r in sums.filter("kind = 2").select("r", "blob").collect():  # a row a bucket
        top += np.frombuffer(r.blob, np.int64)
        ends += r.r
    return Model(
        words=path, word_bits=bits, first=first, bigrams=grams, pair_bits=pair_bits, dense=dense,
        tokens=int(tokens + ends), ends=int(ends), vocabulary=vocabulary + (ends > 0), types=int(low[5]),
        low=(int(low[0]), int(low[1]), int(low[4])), low_discounts=discounts(low[:4].tolist()), discounts=discounts(top.tolist()),
    )


def unmix(x: np.ndarray) -> np.ndarray:
    """Undoes mix()."""
    x = x.astype(U64, copy=True)
    x ^= (x >> U64(31)) ^ (x >> U64(62))
    x *= U64(0x319642B2D24D8EC3)
    x ^= (x >> U64(27)) ^ (x >> U64(54))
    x *= U64(0x96DE1B173F119089)
    x ^= (x >> U64(30)) ^ (x >> U64(60))
    return x


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score, perplexity) of each whole text."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.opened()
        for batch in batches:
            for part in slices(batch, text, SLICE // 4):
                left, right, count, lens = _bigrams(part.column(text), m.lexicon)
                count = np.where(count < 0, m.ends, count)
                own = np.repeat(np.arange(len(lens)), lens)
                base = np.bincount(own, np.log10((count + 0.5) / (m.tokens + 0.5 * (m.vocabulary + 1))), len(lens))
                total = np.bincount(own, m.score(left, right), len(lens))
                new = {
                    "n_tokens": pa.array(lens, pa.int64()), "n_known": pa.array(np.bincount(own, count > 0, len(lens)).astype(np.int64)),
                    "train_tokens": pa.array(np.full(len(lens), m.tokens, np.int64)), "base_score": pa.array(base), "score": pa.array(total), "perplexity": pa.array(10 ** (-total / lens)),
                }
                yield pa.RecordBatch.from_pydict({id: part.column(id), **new})

    kind = dict(docs.dtypes)[id]
    return docs.select(id, text).mapInArrow(tidy(rate), f"`{id}` {kind}, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")
