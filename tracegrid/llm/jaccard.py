"""N-gram Jaccard join by set-relation skipping.

A document's set is that of its distinct word shingles. Two documents link
when 100 * |intersection| >= percent * |union|. The join finds all links'
components exactly; it does not write out pairs.

1. Texts with equal sets fold to one set; a hash store names the first one and
   holds its signature (how many members fall in each of PARTS classes; the sum
   of two signatures' lesser counts bounds the overlap from above). A count
   sketch over all shingles gives a global order, rare ones first.
2. A set is indexed under its prefix: a partner must share one of those
   shingles. The prefix shingles are counted first, so an entry is only written
   if its list holds another one.
3. Entries without a partner that size, position and signature allow go; only
   the sets that are left are stored, for the workers to map.
4. An index list is worked through in one task. It is sorted by size, in blocks
   that know their sizes and first positions; a block is skipped when its best
   possible overlap is too small (index level). A set that is like an earlier
   one of the list, its leader, comes after it: where the leader's overlap with
   a third set is known, only the two sets' differences are looked up in the
   third, or not even those (answer level). Sets that are connected already are
   not compared. Lists of the same sets are dealt to the same task.
5. Lists of more than LIST sets are dealt in hashed blocks first. Then only
   members outside the list's largest component meet the other blocks, so a
   large group of near copies costs what its outsiders cost, and no task gets
   more than two blocks.

A null or empty text, or one without words, has an empty set and links with
nothing; with fewer words than ``width`` the whole sequence is the one
shingle. Very long texts are sets like others (a text is one task's at a time).
Repeated rows and ids are rows with equal sets; of ties the smallest id names a
component. A null id takes part, but is a component's id only where there is no
other. An empty table gives no rows. Extra columns are not read. Shingles and
sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, HashStore, bucket_bits, few, mix, put_bucket, remove, saved, scan_bytes, shared_dir, slices, tidy, word_codes, write_store
from .components import Union, components

LIST = 256
SKIP = 16  # list entries in a block that is skipped at once
RANGE = 18  # bits of a sketch file's slots
PARTS = 64  # classes of a signature
SIGNED = 65535  # members that a signed set may have
CACHE = 64 << 20  # bytes of sets a worker keeps at hand
SLICE = 1 << 20
NO_ID = -(2**63)
_OF_PLACE = np.random.default_rng(21).integers(1, 2**63, 64, dtype=U64) * U64(2) + U64(1)


def shingle_sets(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingle hashes, sorted inside each text, and each text's number of them."""
    code, counts = word_codes(col)
    ends = np.cumsum(counts)
    h = code * _OF_PLACE[0]
    for k in range(1, width):
        h[:-k] += code[k:] * _OF_PLACE[k]
    keep = np.ones(len(code), bool)
    for k in range(1, width):
        keep[ends[counts >= k] - k] = False
    for i in np.flatnonzero((counts > 0) & (counts < width)).tolist():  # the whole sequence
        s, e = ends[i] - counts[i], ends[i]
        keep[s], h[s] = True, (code[s:e] * _OF_PLACE[: e - s]).sum(dtype=U64)
    h = mix(h[keep])
    n = np.where(counts < width, counts > 0, counts - width + 1)
    last = np.cumsum(n)
    for s, e in zip((last - n).tolist(), last.tolist()):
        h[s:e].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[(last - n)[n > 0]] = True
    total = np.r_[0, np.cumsum(new)]
    return h[new], total[last] - total[last - n]


def set_ids(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set, 0 for the empty one."""
    total = np.add.reduceat(np.r_[mix(h ^ U64(0x5BF03635)), U64(0)], np.minimum(np.cumsum(sizes) - sizes, len(h)))
    return np.where(sizes > 0, mix(total + sizes.astype(U64)), U64(0))


def signatures(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How many members each set has of each class (without meaning for sets of more than SIGNED)."""
    own = np.repeat(np.arange(len(sizes)) * PARTS, sizes)
    return np.minimum(np.bincount(own + (h % U64(PARTS)).astype(np.int64), minlength=len(sizes) * PARTS), 65535).astype(np.uint16).reshape(-1, PARTS)


def read_sketch(path: str, bits: int) -> np.ndarray:
    """The steps of the shingles' counts, a byte a slot."""
    files = 1 << max(0, bits - RANGE)
    return np.concatenate([np.load(f"{path}/{r:05d}.n.npy") for r in range(files)])


def by_rarity(h: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, bits: int) -> np.ndarray:
    """The members of each set as keys in the global order: rare ones first, then by hash."""
    key = (sketch[(h >> U64(64 - bits)).astype(np.int64)].astype(U64) << U64(56)) | (h >> U64(8))
    last = np.cumsum(sizes)
    for s, e in zip((last - sizes).tolist(), last.tolist()):
        key[s:e].sort()
    return key


class Sets:
    """Token arrays of sets by id, the lately used kept."""

    def __init__(self, path: str, bits: int):
        self.store, self.near, self.held = HashStore(path, bits), OrderedDict(), 0

    def __call__(self, sid: int) -> np.ndarray:
        if sid not in self.near:
            raw = self.store.blobs(np.array([sid], np.int64).view(U64))[0]
            self.near[sid] = np.frombuffer(raw, U64)
            self.held += len(raw)
            while self.held > CACHE and len(self.near) > 2:
                self.held -= self.near.popitem(last=False)[1].nbytes
        self.near.move_to_end(sid)
        return self.near[sid]


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common members of sorted arrays; the shorter is looked up in the longer."""
    if len(x) > len(y):
        x, y = y, x
    if not len(x):
        return 0
    return int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))


def needed(percent: int, n, m):
    """The least overlap with which sets of n and m members link."""
    return -(-percent * (n + m) // (100 + percent))


class Matcher:
    """Works through index lists, and keeps what a task has found."""

    def __init__(self, sets, percent: int):
        self.sets, self.percent, self.number, self.forest, self.edges = sets, percent, {}, Union(0), []
        self.apart: set[tuple[int, int]] = set()  # pairs of another list that do not link
        self.full = self.derived = self.spared = 0

    def node(self, sid: int) -> int:
        if sid not in self.number:
            self.number[sid] = len(self.forest.up)
            self.forest.up.append(self.number[sid])
        return self.number[sid]

    def joined(self, a: int, b: int) -> bool:
        return self.forest.root(self.node(a)) == self.forest.root(self.node(b))

    def links(self, common: int, n: int, m: int) -> bool:
        return 100 * common >= self.percent * (n + m - common)

    def work(self, sid: list[int], size: np.ndarray, pos: np.ndarray, left: list[bool] | None = None) -> None:
        """One list. With ``left`` given, only pairs of one marked and one unmarked set, or two marked ones, count."""
        order = np.lexsort((pos, size)).tolist()
        sid, size, pos = [sid[i] for i in order], size[order], pos[order]
        left = [left[i] for i in order] if left is not None else None
        starts = range(0, len(sid), SKIP)
        low, high = [int(size[s]) for s in starts], [int(size[min(s + SKIP, len(sid)) - 1]) for s in starts]
        rest = [int((size[s : s + SKIP] - pos[s : s + SKIP]).max()) for s in starts]
        size, pos = size.tolist(), pos.tolist()
        leader: dict[int, int] = {}  # a set's leader, both as places in the list
        differ: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # own members, and the leader's that are missing
        for j, (n, p) in enumerate(zip(size, pos)):
            known: dict[int, int] = {}  # overlaps of leaders with j
            for b in range(bisect_left(high, -(-self.percent * n // 100)), j // SKIP + 1):
                if min(n - p, rest[b]) < needed(self.percent, n, low[b]):
                    continue
                for i in range(b * SKIP, min(b * SKIP + SKIP, j)):
                    m = size[i]
                    least = needed(self.percent, n, m)
                    if sid[i] == sid[j] or (left is not None and not (left[i] or left[j])) or min(n - p, m - pos[i], m) < least or self.joined(sid[i], sid[j]):
                        continue
                    pair = (sid[i], sid[j]) if sid[i] < sid[j] else (sid[j], sid[i])
                    if pair in self.apart:
                        continue
                    x, y = self.sets(sid[i]), self.sets(sid[j])
                    lead = leader.get(i)
                    if lead in known and known[lead] + len(differ[i][0]) < least:
                        self.spared += 1
                        continue
                    if lead in known:
                        own, missing = differ[i]
                        common = known[lead] - overlap(missing, y) + overlap(own, y)
                        self.derived += 1
                    else:
                        common = overlap(x, y)
                        self.full += 1
                    if lead is None:
                        known[i] = common
                    if self.links(common, m, n):
                        self.forest.join(self.node(sid[i]), self.node(sid[j]))
                        self.edges.append((sid[i], sid[j]))
                        if j not in leader and lead is None:
                            leader[j] = i
                            differ[j] = (np.setdiff1d(y, x, assume_unique=True), np.setdiff1d(x, y, assume_unique=True))
                    else:
                        if len(self.apart) > 200_000:
                            self.apart.clear()
                        self.apart.add(pair)

    def take(self) -> pa.RecordBatch:
        edges, self.edges = self.edges, []
        return pa.RecordBatch.from_pydict({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})


def _lists(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[dict]:
    """The task's rows by list: columns as arrays."""
    got = list(batches)
    if not got:
        return
    table = pa.Table.from_batches(got)
    cols = {c: table.column(c).to_numpy() for c in table.column_names}
    order = np.lexsort([cols[k] for k in reversed(keys)])
    cols = {c: v[order] for c, v in cols.items()}
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= cols[k][1:] != cols[k][:-1]
    bounds = np.r_[0, np.flatnonzero(new), len(order)]
    for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if e - s > 1:
            yield {c: v[s:e] for c, v in cols.items()}


def possible(lists: np.ndarray, n: np.ndarray, pos: np.ndarray, sig: np.ndarray, percent: int) -> np.ndarray:
    """Which entries, sorted by list and size, have a partner in their list that size, position and signature allow."""
    keep, at, d = np.zeros(len(n), bool), np.arange(len(n)), 0
    while len(at):
        d += 1
        at = at[at + d < len(n)]
        at = at[(lists[at] == lists[at + d]) & (100 * n[at] >= percent * n[at + d])]
        least = needed(percent, n[at], n[at + d])
        far = np.minimum(n[at] - pos[at], n[at + d] - pos[at + d]) >= least
        ask = np.flatnonzero(far & ~(keep[at] & keep[at + d]))
        for s in range(0, len(ask), 1 << 15):
            k = ask[s : s + (1 << 15)]
            i, j = at[k], at[k] + d
            fits = (np.minimum(sig[i], sig[j]).sum(axis=1, dtype=np.int64) >= least[k]) | (n[j] > SIGNED)
            keep[i[fits]] = keep[j[fits]] = True
    return keep


def link_groups(spark: SparkSession, docs: DataFrame, percent: int = 90, width: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of each row of ``docs``."""
    size = scan_bytes(docs)
    bits = bucket_bits(size, 64 << 20)
    slots = min(26, max(16, round(math.log2(max(1, size))) - 4))  # a byte each in every worker
    ranges = 1 << max(0, slots - RANGE)
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), size >> 25)
    files = few(spark, size)
    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))

    def read(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                h, n = shingle_sets(part.column("text"), width)
                yield part.column("id"), h, n, set_ids(h, n)

    # ---- 1: sizes, set ids and signatures, and the sketch
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << slots, np.uint8)
        for ids, h, n, sid in read(batches):
            slot = (h >> U64(64 - slots)).astype(np.int64)
            for s in range(0, len(slot), 1 << 18):
                some, times = np.unique(slot[s : s + (1 << 18)], return_counts=True)
                count[some] = np.minimum(count[some] + times, 255)
            sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(2 * PARTS), len(n), [None, pa.py_buffer(signatures(h, n))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(sid.view(np.int64)), sig, pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary())], names=["id", "n", "sid", "sig", "r", "part"])
        none = pa.nulls(1, pa.int64())
        for r, part in enumerate(count.reshape(ranges, -1)):
            if part.any():
                yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(1, pa.binary()), pa.array([r], pa.int64()), pa.array([zlib.compress(part.tobytes(), 1)], pa.binary())], names=["id", "n", "sid", "sig", "r", "part"])

    measured = saved(rows.mapInArrow(tidy(measure), "id long, n long, sid long, sig binary, r long, part binary"), spark, "measured", files)
    own = measured.filter("r is null").select("id", "n", "sid")
    sketch = shared_dir(spark, "sketch")

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for r, part in zip(b.column("r").to_pylist(), b.column("part").to_pylist()):
                got = np.frombuffer(zlib.decompress(part), np.uint8)
                total[r] = total.get(r, np.zeros(len(got), np.uint32)) + got
        for r, part in total.items():
            put_bucket(sketch, r, {"n": np.minimum(16 * np.log2(1 + part), 255).astype(np.uint8)})
            yield pa.RecordBatch.from_pydict({"r": pa.array([r], pa.int64())})

    added = measured.filter("r is not null").select("r", "part").repartition(ranges, "r").mapInArrow(tidy(add_up), "r long").collect()  # a row a range
    for r in set(range(ranges)) - {x.r for x in added}:
        put_bucket(sketch, r, {"n": np.zeros((1 << slots) // ranges, np.uint8)})
    first = shared_dir(spark, "first")
    same = measured.filter("r is null and sid <> 0").groupBy("sid").agg(F.min("id").alias("id"), F.first("sig").alias("sig"))
    write_store(same.select(F.col("sid").alias("key"), F.coalesce("id", F.lit(NO_ID)).alias("id"), "sig"), first, bits)

    # ---- 2: the index
    def prefixes(batches: Iterator[pa.RecordBatch]):
        """(set ids, members' owners, sizes, positions, tokens) of the prefixes of each set's first document."""
        rarity, named = read_sketch(sketch, slots), HashStore(first, bits)
        for ids, h, n, sid in read(batches):
            _, got = named.find(sid, id=np.int64)
            mine = (n > 0) & (got["id"] == np.array(ids.fill_null(NO_ID)))
            h, n, sid = h[np.repeat(mine, n)], n[mine], sid[mine]
            key = by_rarity(h, n, rarity, slots)
            long = n - (percent * n + 99) // 100 + 1
            who = np.repeat(np.arange(len(n)), long)
            pos = np.arange(len(who)) - np.repeat(np.cumsum(long) - long, long)
            yield sid, who, n, pos, mix(key[(np.cumsum(n) - n)[who] + pos])

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, _, tok in prefixes(batches):
            some, times = np.unique(tok, return_counts=True)
            yield pa.RecordBatch.from_pydict({"tok": pa.array(some.view(np.int64)), "c": pa.array(times.astype(np.int32))})

    shared = shared_dir(spark, "shared")
    write_store(rows.mapInArrow(tidy(tokens), "tok long, c int").groupBy(F.col("tok").alias("key")).agg(F.sum("c").alias("c")).filter("c > 1"), shared, bits)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = HashStore(shared, bits)
        for sid, who, n, pos, tok in prefixes(batches):
            found, got = counted.find(tok, c=np.int64)
            who, pos, tok = who[found], pos[found], tok[found]
            blocks = -(-got["c"][found] // LIST)
            block = (mix(sid)[who] % blocks.astype(U64)).astype(np.int32)
            yield pa.RecordBatch.from_pydict({"tok": pa.array(tok.view(np.int64)), "block": pa.array(block), "blocks": pa.array(blocks.astype(np.int32)), "sid": pa.array(sid[who].view(np.int64)), "n": pa.array(n[who].astype(np.int32)), "pos": pa.array(pos.astype(np.int32))})

    entry = "tok long, block int, blocks int, sid long, n int, pos int"

    # ---- 3: entries with a possible partner (all of a list of several blocks), and the sets that they name
    def fitting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        tok, block, blocks, sid, n, pos = (table.column(c).to_numpy() for c in table.column_names)
        order = np.lexsort((n, block, tok))
        number = np.zeros(len(order), np.int64)
        number[1:] = np.cumsum((tok[order][1:] != tok[order][:-1]) | (block[order][1:] != block[order][:-1]))
        some, at = np.unique(sid, return_inverse=True)
        sig = HashStore(first, bits).find(some.view(U64), sig=np.dtype((np.void, 2 * PARTS)))[1]["sig"].view(np.uint16).reshape(-1, PARTS)
        wide = blocks[order] > 1
        keep = wide.copy()
        narrow = np.flatnonzero(~wide)
        keep[narrow] = possible(number[narrow], n[order][narrow].astype(np.int64), pos[order][narrow].astype(np.int64), sig[at[order][narrow]], percent)
        order, number = order[keep], number[keep]
        if not len(order):
            return
        # lists whose smallest set is the same go to the same task
        starts = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
        lead = np.repeat(np.minimum.reduceat(sid[order], starts), np.diff(np.r_[starts, len(order)]))
        yield from table.take(pa.array(order)).append_column("lead", pa.array(lead)).combine_chunks().to_batches()

    lists = saved(rows.mapInArrow(tidy(index), entry).repartition(n_tasks, "tok", "block").mapInArrow(tidy(fitting), entry + ", lead long"), spark, "lists", files)
    active, stored = shared_dir(spark, "active"), shared_dir(spark, "sets")
    write_store(lists.select(F.col("sid").alias("key")).distinct(), active, bits)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, named = HashStore(active, bits), HashStore(first, bits)
        for ids, h, n, sid in read(batches):
            found, _ = wanted.find(sid)
            _, got = named.find(sid, id=np.int64)
            at = np.flatnonzero(found & (n > 0) & (got["id"] == np.array(ids.fill_null(NO_ID))))
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_pydict({"key": pa.array(sid[at].view(np.int64)), "raw": pa.array([h[ends[i] - n[i] : ends[i]].tobytes() for i in at.tolist()], pa.binary())})

    write_store(rows.mapInArrow(tidy(arrays), "key long, raw binary"), stored, bits, blob="raw")

    # ---- 4 and 5: lists, then the blocks of long ones
    def by_list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        match = Matcher(Sets(stored, bits), percent)
        for part in _lists(batches, ("tok", "block")):
            match.work(part["sid"].tolist(), part["n"].astype(np.int64), part["pos"].astype(np.int64))
            yield match.take()

    near = saved(lists.select("tok", "block", "sid", "n", "pos", "lead").repartition(n_tasks, "lead").mapInArrow(tidy(by_list), "a long, b long"), spark, "near", files)
    long = lists.filter("blocks > 1")
    if not long.isEmpty():
        groups = components(spark, near)
        long = saved(long.drop("lead").join(groups.withColumnRenamed("node", "sid"), "sid", "left").withColumn("g", F.coalesce("component", "sid")), spark, "long", files)
        sizes = long.groupBy("tok", "g").agg(F.count("*").alias("k"))
        main = sizes.groupBy("tok").agg(F.max_by("g", F.struct("k", "g")).alias("main"), F.count("*").alias("groups")).filter("groups > 1")
        long = saved(long.join(main, "tok").withColumn("out", F.col("g") != F.col("main")), spark, "outsiders", files)
        # an outsider meets each block of its list, each block meets the outsiders of each other one
        crowd = long.groupBy("tok", "block").agg(F.count_if("out").alias("k")).filter("k > 0").groupBy("tok").agg(F.collect_list("block").alias("with"))
        pairs = (
            long.join(crowd, "tok")
            .withColumn("other", F.explode(F.when(F.col("out"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.col("with"))))
            .filter("other <> block").select("tok", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "sid", "n", "pos", "out", "g")
        )

        def by_pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = Matcher(Sets(stored, bits), percent)
            for part in _lists(batches, ("tok", "i", "j")):
                first: dict[int, int] = {}
                for s, g in zip(part["sid"].tolist(), part["g"].tolist()):
                    match.forest.join(match.node(first.setdefault(g, s)), match.node(s))
                match.work(part["sid"].tolist(), part["n"].astype(np.int64), part["pos"].astype(np.int64), part["out"].tolist())
                yield match.take()

        near = saved(near.union(pairs.repartition(n_tasks, "tok", "i", "j").mapInArrow(tidy(by_pair), "a long, b long")), spark, "near", files)
    groups = components(spark, near)
    final = shared_dir(spark, "groups")

    def with_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = HashStore(first, bits)
        for b in batches:
            _, got = named.find(b.column("node").to_numpy().view(U64), id=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got["id"], mask=got["id"] == NO_ID)], names=["node", "component", "id"])

    named = saved(groups.mapInArrow(tidy(with_ids), "node long, component long, id long"), spark, "named", files)
    least = named.groupBy("component").agg(F.min("id").alias("least"))
    write_store(named.join(least, "component").select(F.col("node").alias("key"), F.coalesce("least", F.lit(NO_ID)).alias("id")), final, bits)
    remove(sketch, shared, active, stored, lists, near, named)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stores = HashStore(first, bits), HashStore(final, bits)
        for b in batches:
            sid = b.column("sid").to_numpy().view(U64)
            best = np.array(b.column("id").fill_null(NO_ID))
            for store in stores:
                found, got = store.find(sid, id=np.int64)
                best = np.where(found & (sid != 0), got["id"], best)
            yield pa.RecordBatch.from_pydict({id: b.column("id"), "n_shingles": b.column("n"), "component_id": pa.array(best, mask=best == NO_ID)})

    return own.mapInArrow(tidy(name), f"`{id}` long, n_shingles long, component_id long")


def keep_one(spark: SparkSession, docs: DataFrame, percent: int = 90, width: int = 3, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group, that of smallest id.

    The ids that go stand in a hash store, so the texts are not shuffled. Rows
    that repeat a kept id all stay, and so do rows without an id.
    """
    groups = link_groups(spark, docs, percent, width, id, text)
    gone, bits = shared_dir(spark, "gone"), bucket_bits(scan_bytes(docs), 64 << 20)

    def key_of(col: pa.Array) -> np.ndarray:
        return mix(np.array(col.cast(pa.int64()).fill_null(NO_ID)).view(U64))

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = key_of(b.column("id"))
            yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "one": pa.array(np.ones(len(key), np.int32))})

    write_store(groups.filter(F.col(id) != F.col("component_id")).select(F.col(id).alias("id")).distinct().mapInArrow(tidy(keyed), "key long, one int"), gone, bits)

    @F.arrow_udf("boolean")
    def goes(ids: Iterator[pa.Array]) -> Iterator[pa.Array]:
        store = HashStore(gone, bits)
        for x in ids:
            yield pa.array(store.find(key_of(x))[0])

    return docs.filter(~goes(F.col(id)))
