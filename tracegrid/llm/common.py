"""What several operators share: tokens and hashes in NumPy, and hash stores on the shared folder.

A hash store is a set of bucket files, each holding sorted 64-bit keys and
aligned value arrays. Executors write the buckets (one task a bucket, so a lost
task only rewrites its own files) and Python workers memory-map them, so a
lookup table may be far larger than a worker's memory and is never broadcast.
"""

from __future__ import annotations

import ctypes
import math
import mmap
import os
import shutil
import tempfile
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64


# ---------------------------------------------------------------- shared folder


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under spark.checkpoint.dir, as a path that workers can open.

    Stores are memory-mapped, so the folder has to be mounted on every node.
    Without that setting a local master gets a temporary folder; a cluster's
    nodes share none, so there it is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all nodes share")
        root = "file://" + tempfile.mkdtemp(prefix="tracegrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    if "://" in root or root.startswith("file:"):
        scheme, _, rest = root.partition(":")
        if scheme != "file":
            raise ValueError(f"hash stores need a mounted shared folder, not {root}")
        root = "/" + rest.lstrip("/")
    path = f"{root}/tracegrid/{name}-{uuid.uuid4().hex}"
    os.makedirs(path, exist_ok=True)
    return path


def saved(df: DataFrame, spark: SparkSession, name: str, files: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder, in ``files`` files at most, and read back: cuts the lineage.

    A task then works through several partitions, one after the other.
    """
    path = "file://" + shared_dir(spark, name)
    (df.coalesce(files) if files else df).write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(*gone: str | DataFrame) -> None:
    """Deletes stores and saved tables of ``shared_dir`` that nothing reads any more."""
    for x in gone:
        for path in [x] if isinstance(x, str) else {os.path.dirname(f) for f in x.inputFiles()}:
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (Spark tells names apart without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def scan_bytes(df: DataFrame) -> int:
    """Size of what ``df`` scans, as the optimizer knows it; 64 MB for rows whose size it doesn't know."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 60 else 64 << 20


def few(spark: SparkSession, size: int) -> int:
    """Partitions enough for ``size`` bytes: one for each 4 MB, and one a core."""
    return max(spark.sparkContext.defaultParallelism, size >> 22)


def compact(df: DataFrame) -> DataFrame:
    """``df`` without the many small partitions of a table of many small files.

    Each partition that is written is a file again, and each file costs its
    executor several new processes where Hadoop has no native library (each
    shows for a moment as a second copy of the JVM). Partitions of 4 MB and more stay as
    they are, so a large table is never dealt anew.
    """
    return df.coalesce(few(df.sparkSession, scan_bytes(df)))


def bucket_bits(size: int, per_bucket: int = 8 << 20) -> int:
    """Bits that name a bucket so that each holds its share of ``size`` bytes."""
    return min(20, max(6, math.ceil(math.log2(max(1, size) / per_bucket))))


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 (the splitmix64 finaliser)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def hash_bytes(items) -> np.ndarray:
    """xxh64 of each bytes object."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x) for x in items), U64)


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


# ---------------------------------------------------------------- words


def texts(col: pa.Array) -> pa.Array:
    """Null texts as empty ones, in buffers of their own (some kernels misread slices)."""
    if col.offset:
        col = col.take(pa.array(np.arange(len(col))))
    return pc.fill_null(col.cast(pa.large_string()), "")


def words(col: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """A-Z lower-cased words ``[^\\x20\\x09-\\x0D]+`` of each text.

    Gives the words' places in a list of distinct words, that list, and how
    many words each text has.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts(col)))
    flat = split.flatten()
    ends = np.asarray(split.offsets, dtype=np.int64)
    coded = flat.dictionary_encode()
    idx = np.asarray(coded.indices, dtype=np.int64)
    names = coded.dictionary.cast(pa.large_binary()).to_pylist()
    counts = np.diff(ends)
    if b"" in names:
        keep = idx != names.index(b"")
        owner = np.repeat(np.arange(len(counts)), counts)[keep]
        idx, counts = idx[keep], np.bincount(owner, minlength=len(counts))
    return idx, names, counts


#: Odd 64-bit constants: of byte values (A-Z as a-z), and the base of the sums over places.
_OF_BYTE = np.random.default_rng(20).integers(1, 2**63, 256, dtype=U64)[[i + 32 * (65 <= i <= 90) for i in range(256)]] * U64(2) + U64(1)
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_BASE = 0x9E3779B97F4A7C15
_powers = {c: np.ones(1, U64) for c in (_BASE, pow(_BASE, -1, 1 << 64))}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        _powers[base] = np.cumprod(np.r_[U64(1), np.full(max(n, 1 << 20), base, U64)], dtype=U64)
    return _powers[base][:n]


def raw_texts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes in one array, and the places where texts begin and end."""
    got = texts(col)
    ends = np.frombuffer(got.buffers()[1], np.int64)[got.offset : got.offset + len(got) + 1] if len(got) else np.zeros(1, np.int64)
    data = got.buffers()[2] if len(got) else None
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, ends - ends[0]


def span_codes(raw: np.ndarray, first: np.ndarray, end: np.ndarray, of_byte: np.ndarray = _OF_BYTE) -> np.ndarray:
    """A 64-bit hash of each span of bytes, by differences of one running sum."""
    n = len(raw)
    sums, value = np.zeros(n + 1, U64), of_byte[raw]
    value *= _power(_BASE, n)
    np.cumsum(value, out=sums[1:])
    return mix((sums[end] - sums[first]) * _power(pow(_BASE, -1, 1 << 64), n + 1)[first] + (end - first).astype(U64))


def word_codes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each A-Z lower-cased word ``[^\\x20\\x09-\\x0D]+`` in order, and each text's number of words."""
    raw, ends = raw_texts(col)
    if not len(raw):
        return np.empty(0, U64), np.zeros(len(col), np.int64)
    inside = np.concatenate([[False], ~_SPACE[raw], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    seam = np.unique(ends[1:-1])
    seam = seam[inside[seam] & inside[seam + 1]]  # here one text's word ends and the next one's begins
    edge = np.sort(np.concatenate([edge, seam, seam]))
    first, end = edge[0::2], edge[1::2]
    return span_codes(raw, first, end), np.diff(np.searchsorted(first, ends))


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose ``column`` holds about ``limit`` bytes."""
    if not batch.num_rows:
        return
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column).cast(pa.large_binary())), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = size[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


# ---------------------------------------------------------------- hash stores


def _put(path: str, write) -> None:
    """Writes a file whole or not at all; a repeated task writes the same bytes."""
    own = f"{path}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        write(f)
    os.replace(own, path)


def put_bucket(path: str, bucket: int, columns: dict[str, np.ndarray], blob: list[bytes] | None = None) -> None:
    for name, values in columns.items():
        _put(f"{path}/{bucket:05d}.{name}.npy", lambda f, v=values: np.save(f, v))
    if blob is not None:
        ends = np.concatenate([[0], np.cumsum([len(x) for x in blob])]).astype(np.int64)
        _put(f"{path}/{bucket:05d}.ends.npy", lambda f: np.save(f, ends))
        _put(f"{path}/{bucket:05d}.blob", lambda f: f.writelines(blob))


def _values(col: pa.ChunkedArray) -> np.ndarray:
    if not pa.types.is_binary(col.type):
        return col.to_numpy()
    raw = col.to_pylist()
    return np.frombuffer(b"".join(raw), np.dtype((np.void, len(raw[0]))))


def write_store(df: DataFrame, path: str, bits: int, blob: str | None = None, distinct: bool = False) -> int:
    """Writes ``df(key long, values...)`` as a store. Gives the rows.

    A bucket is the top ``bits`` bits of the key; the keys are hashes, so the
    buckets are of one size whatever the data's skew. Of rows with one key, one
    stays (they have to be alike; where they are ``distinct`` things, a key
    twice is an error). Other binary columns have one width.
    """
    names = [c for c in df.columns if c not in ("key", blob)]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(got) if (got := list(batches)) else None
        if table is not None and table.num_rows:
            key = table.column("key").to_numpy().view(U64)
            order = np.argsort(key, kind="stable")
            order = order[np.r_[True, key[order[1:]] != key[order[:-1]]]]
            if distinct and len(order) < len(key):
                raise ValueError("two values share a 64-bit hash")
            key = key[order]
            where = (key >> U64(64 - bits)).astype(np.int64)
            cols = {c: _values(table.column(c))[order] for c in names}
            raw = table.column(blob).take(pa.array(order)).to_pylist() if blob else None
            for b in np.unique(where):
                s = slice(*np.searchsorted(where, [b, b + 1]))
                put_bucket(path, int(b), {"key": key[s], **{c: v[s] for c, v in cols.items()}}, raw[s] if blob else None)
            yield pa.RecordBatch.from_pydict({"n": pa.array([len(key)], pa.int64())})

    dealt = df.withColumn("_b", F.shiftrightunsigned("key", 64 - bits)).repartition(2**bits, "_b").drop("_b")
    return sum(r.n for r in dealt.mapInArrow(tidy(write), "n long").collect())


class HashStore:
    """Reads a store; buckets are mapped when first asked for, the lately used OPEN of them stay so."""

    OPEN = 512  # files, as a process may have 1,024

    def __init__(self, path: str, bits: int):
        self.path, self.bits, self.open = path, bits, OrderedDict()

    def column(self, bucket: int, name: str) -> np.ndarray | None:
        at = (bucket, name)
        if at not in self.open:
            file = f"{self.path}/{bucket:05d}.{name}"
            if name == "blob":
                size = os.path.getsize(file) if os.path.exists(file) else 0
                with open(file if size else os.devnull, "rb") as f:
                    self.open[at] = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) if size else b""
            else:
                self.open[at] = np.load(f"{file}.npy", mmap_mode="r") if os.path.exists(f"{file}.npy") else None
            if len(self.open) > self.OPEN:
                self.open.popitem(last=False)
        else:
            self.open.move_to_end(at)
        return self.open[at]

    def _runs(self, keys: np.ndarray):
        """Buckets with the places of their keys in ``keys``, found keys only."""
        order = np.argsort(keys)
        sorted_keys = keys[order]
        where = (sorted_keys >> U64(64 - self.bits)).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, where[1:] != where[:-1]]) if len(where) else np.empty(0, np.int64)
        for s, e in zip(starts, np.r_[starts[1:], len(where)]):
            b = int(where[s])
            have = self.column(b, "key")
            if have is None:
                continue
            at = np.minimum(np.searchsorted(have, sorted_keys[s:e]), len(have) - 1)
            hit = have[at] == sorted_keys[s:e]
            yield b, order[s:e][hit], at[hit]

    def find(self, keys: np.ndarray, **names) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Which keys there are, and the named columns' values (dtype given), 0 where none."""
        found = np.zeros(len(keys), bool)
        out = {c: np.zeros(len(keys), d) for c, d in names.items()}
        for b, rows, at in self._runs(keys):
            found[rows] = True
            for c in names:
                out[c][rows] = self.column(b, c)[at]
        return found, out

    def runs(self, keys: np.ndarray, kind: str) -> tuple[np.ndarray, np.ndarray]:
        """The blobs of all keys as one array of ``kind``, and how many elements each has (none where no key is)."""
        width, size, parts, whose = np.dtype(kind).itemsize, np.zeros(len(keys), np.int64), [], []
        for b, rows, at in self._runs(keys):
            ends = self.column(b, "ends")
            size[rows] = (ends[at + 1] - ends[at]) // width
            parts.append(gather(np.frombuffer(self.column(b, "blob"), kind), ends[at] // width, size[rows]))
            whose.append(rows)
        if not parts:
            return np.empty(0, kind), size
        flat, rows = np.concatenate(parts), np.concatenate(whose)
        first = np.zeros(len(keys), np.int64)
        first[rows] = np.cumsum(size[rows]) - size[rows]
        return gather(flat, first, size), size

    def blobs(self, keys: np.ndarray) -> list[bytes | None]:
        out: list[bytes | None] = [None] * len(keys)
        for b, rows, at in self._runs(keys):
            ends, raw = self.column(b, "ends"), self.column(b, "blob")
            for r, s, e in zip(rows.tolist(), ends[at].tolist(), ends[at + 1].tolist()):
                out[r] = raw[s:e]
        return out


def gather(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``data`` that begin at ``first``, one after the other."""
    ends = np.cumsum(size)
    return data[np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def tidy(work):
    """``work`` as a function of mapInArrow that leaves no unused memory in its worker, as workers are reused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)

    return run


def keep_columns(batch: pa.RecordBatch, **new: pa.Array) -> pa.RecordBatch:
    """The batch with columns set or replaced by name."""
    cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)} | new
    return pa.RecordBatch.from_pydict(cols)
