"""Embedding near-duplicates: spherical k-means cells, blocked cosine products
inside each cell, one representative a group.

Vectors are scaled to unit length, and equal ones fold to one row first (grouped
with partial sums, so a very common vector does no harm). Centroids are fitted
on at most ``SAMPLE`` rows; every vector has its nearest one's cell as home and
is compared with all vectors at home there. It also visits other cells: a
partner at the threshold is ``cos * y + sin * z`` with z a unit vector at right
angles to y, and it is at home in another cell only if z leans towards that
centroid by a share of the two centroids' distance. A vector visits each cell
for which that share is at most ``REACH / sqrt(dimensions - 1)``, REACH standard
deviations of a random z. Two vectors meet if either visits the other's home, so
both have to fail for a link to be missed (recall in the README; with
``reach=None`` the share is 1, every z's bound, and no link can be missed). Of
two meetings only that in the lower home counts.

A home of more than BLOCK vectors is cut in blocks. A block is one file on the
shared folder, written by one task, and what leaves that task is a list a
visited cell. An item of work is a block and the visitors from another one, or
two blocks of one home; it holds two blocks in memory, whatever is hot. Link
counts and spanning edges leave a task, never pairs, and vectors are shuffled
once. Every link reported is exact (double precision).

Null, empty and zero vectors, and those with null or non-finite components,
link with nothing. Vectors of different lengths are not compared. Repeated ids
count as rows of their own, so do ties; of a group the smallest id names it. An
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _put, remove, saved, shared_dir, tidy
from .components import components

SAMPLE = 32_768
PER_CELL = 256
CELLS = 4096
BLOCK = 1024
REACH = 2.0


def unit_rows(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 5, seed: int = 7) -> np.ndarray:
    """k unit centroids of unit rows; an empty cell keeps its centroid."""
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        own = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.maximum(size, 1e-300), c)
    return c


def visits(x: np.ndarray, c: np.ndarray, threshold: float, reach: float | None) -> tuple[np.ndarray, np.ndarray]:
    """The home of each row, and whether it visits each cell (its home: yes)."""
    near = x @ c.T
    home = near.argmax(axis=1)
    rise = np.sqrt(max(0.0, 1 - threshold**2)) / threshold if threshold > 0 else np.inf
    share = 1.0 if reach is None or x.shape[1] < 2 else min(1.0, reach / np.sqrt(x.shape[1] - 1))
    apart = np.sqrt(np.maximum(2 - 2 * (c[home] @ c.T), 0))
    go = near.max(axis=1, keepdims=True) - near <= rise * share * apart + 1e-9 if np.isfinite(rise) else np.ones(near.shape, bool)
    go[np.arange(len(x)), home] = True
    return home, go


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, raw): unit vectors as doubles, null where the vector can't link."""
    for b in batches:
        raw = []
        for v in b.column(1).to_pylist():
            x = np.array(v, np.float64) if v and None not in v else np.empty(0)
            if x.size and np.isfinite(x).all() and (top := np.abs(x).max()) > 0:
                x = x / top  # squares can neither overflow nor vanish
                raw.append((x / np.linalg.norm(x) + 0.0).tobytes())
            else:
                raw.append(None)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(raw, pa.binary())], names=["id", "raw"])


class Blocks:
    """Block files, the lately used kept: (gid, copies, vectors, visited cells, their ends, their visitors)."""

    def __init__(self, path: str):
        self.path, self.near = path, OrderedDict()

    def __call__(self, cell: int, block: int) -> tuple[np.ndarray, ...]:
        at = (cell, block)
        if at not in self.near:
            with open(f"{self.path}/{cell}.{block}", "rb") as f:
                self.near[at] = tuple(np.load(f) for _ in range(6))
            if len(self.near) > 64:
                self.near.popitem(last=False)
        self.near.move_to_end(at)
        return self.near[at]


def _write_blocks(path: str):
    """Writes the task's blocks and gives (cell, home, hblock, who): the visitors of each cell from each block."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = list(batches)
        if not got:
            return
        table = pa.Table.from_batches(got)
        home, block, gid, m = (table.column(c).to_numpy() for c in ("home", "block", "gid", "m"))
        order = np.lexsort((gid, block, home))
        starts = np.flatnonzero(np.r_[True, (home[order][1:] != home[order][:-1]) | (block[order][1:] != block[order][:-1])])
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
            at = order[s:e]
            rows = table.select(["raw", "visits"]).take(pa.array(at))
            cells = [np.frombuffer(v, np.int64) for v in rows.column("visits").to_pylist()]
            who, cells = np.repeat(np.arange(len(at)), [len(c) for c in cells]), np.concatenate(cells)
            by_cell = np.argsort(cells, kind="stable")
            who, cells = who[by_cell].astype(np.int32), cells[by_cell]
            first = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]][: len(cells)])
            ends = np.r_[first, len(cells)]
            parts = gid[at], m[at], unit_rows(rows.column("raw").to_pylist()), cells[first], ends, who
            _put(f"{path}/{home[at[0]]}.{block[at[0]]}", lambda f, parts=parts: [np.save(f, x) for x in parts])
            n = len(first)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cells[first]), "home": pa.array(np.full(n, home[at[0]])), "hblock": pa.array(np.full(n, block[at[0]])), "who": pa.array([who[a:b].tobytes() for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.binary())})

    return write


def labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number of each one's component among 0..n-1 joined by pairs."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _compare(path: str, threshold: float):
    """Works through items; gives (gid, n, root) with link counts and spanning edges, added up in the task."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = Blocks(path)
        counts: list[tuple[np.ndarray, np.ndarray]] = []
        edges: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            gid, at = np.unique(np.concatenate([g for g, _ in counts]), return_inverse=True)
            n = np.bincount(at, np.concatenate([c for _, c in counts])).astype(np.int64)
            own = np.unique(np.concatenate(edges), axis=0)
            counts.clear(), edges.clear()
            zero = pa.nulls(len(own), pa.int64())
            return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(gid), pa.array(own[:, 0])]), pa.concat_arrays([pa.array(n), zero]), pa.concat_arrays([pa.nulls(len(gid), pa.int64()), pa.array(own[:, 1])])], names=["gid", "n", "root"])

        for batch in batches:
            cols = (batch.column(c).to_pylist() for c in ("cell", "block", "home", "hblock", "who"))
            for cell, block, home, hblock, who in zip(*cols):
                gid, m, x, to, ends, visitors = blocks(cell, block)
                gid2, m2, y, *_ = blocks(home, hblock)
                if who is not None:
                    who = np.frombuffer(who, np.int32)
                    gid2, m2, y = gid2[who], m2[who], y[who]
                a, b = np.nonzero(x @ y.T >= threshold)
                if who is None and block == hblock:
                    a, b = a[a < b], b[a < b]
                elif cell > home and len(a):  # those that visit that home met there
                    k = int(np.searchsorted(to, home))
                    if k < len(to) and to[k] == home:
                        met = np.zeros(len(gid), bool)
                        met[visitors[ends[k] : ends[k + 1]]] = True
                        a, b = a[~met[a]], b[~met[a]]
                if not len(a):
                    continue
                n, n2 = np.bincount(a, m2[b], len(gid)), np.bincount(b, m[a], len(gid2))
                counts += [(gid[n > 0], n[n > 0]), (gid2[n2 > 0], n2[n2 > 0])]
                names = np.concatenate([gid, gid2])
                label = labels(len(names), a, b + len(gid))
                far = np.flatnonzero(label != np.arange(len(label)))
                edges.append(np.stack([names[far], names[label[far]]], axis=1))
                if sum(map(len, edges)) > 1 << 18:
                    yield flush()
        if counts:
            yield flush()

    return work


def links(spark: SparkSession, df: DataFrame, threshold: float = 0.9, id: str = "vec_id", vector: str = "embedding", reach: float | None = REACH) -> DataFrame:
    """(id, n_links, component_id) of each row of ``df``."""
    rows = saved(df.select(F.col(id).cast("long").alias("id"), vector).mapInArrow(tidy(_packed), "id long, raw binary").withColumn("copy", F.sha2("raw", 256)), spark, "vectors")
    folded = rows.filter("raw is not null").groupBy("copy").agg(F.min("id").alias("least"), F.count("*").alias("m"), F.first("raw").alias("raw"))
    groups = saved(folded.withColumn("gid", F.monotonically_increasing_id()), spark, "copies")  # ids may be null or repeated
    centroids: dict[int, np.ndarray] = {}
    for r in groups.groupBy(F.length("raw").alias("d")).agg(F.count("*").alias("n")).filter(F.col("n") >= 2 * PER_CELL).collect():
        sample = groups.filter(F.length("raw") == r.d).orderBy(F.xxhash64("copy")).limit(SAMPLE).select("raw").toPandas()["raw"]
        centroids[r.d] = spherical_kmeans(x := unit_rows(list(sample)), max(1, min(CELLS, len(x) // 8, r.n // PER_CELL)))
    shared = spark.sparkContext.broadcast(centroids)  # at most CELLS centroids a common vector length

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 512):
                part = b.slice(s, 512)
                raw = part.column("raw").to_pylist()
                size = np.array([len(r) for r in raw])
                home, went = np.zeros(len(raw), np.int64), [b""] * len(raw)
                for d in np.unique(size).tolist():
                    at, base = np.flatnonzero(size == d), d * CELLS
                    home[at] = base
                    if d in shared.value:
                        own, go = visits(unit_rows([raw[i] for i in at]), shared.value[d], threshold, reach)
                        home[at] += own
                        go[np.arange(len(at)), own] = False
                        for i, g in zip(at.tolist(), go):
                            went[i] = (base + np.flatnonzero(g)).tobytes()
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("gid", "m", "raw")), pa.array(home), pa.array(went, pa.binary())], names=["gid", "m", "raw", "home", "visits"])

    placed = saved(groups.select("gid", "m", "raw").mapInArrow(tidy(assign), "gid long, m long, raw binary, home long, visits binary"), spark, "cells")
    sizes = saved(placed.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb")), spark, "homes")
    n_tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), groups.count() >> 16)
    path = shared_dir(spark, "blocks")
    dealt = placed.join(sizes, "home").withColumn("block", F.pmod(F.xxhash64("gid"), F.col("nb")).cast("int")).drop("nb")
    going = saved(dealt.repartition(n_tasks, "home", "block").mapInArrow(tidy(_write_blocks(path)), "cell long, home long, hblock int, who binary"), spark, "visits")
    # the visitors of a cell meet each block at home there; so does each of these blocks, once
    number = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    guests = going.join(sizes.select(F.col("home").alias("cell"), "nb"), "cell").select("cell", number.alias("block"), "home", "hblock", "who")
    first = sizes.select("home", "nb", number.alias("block"))
    at_home = first.select(F.col("home").alias("cell"), "block", "home", F.explode(F.sequence("block", F.col("nb") - 1)).alias("hblock"), F.lit(None).cast("binary").alias("who"))
    items = guests.union(at_home).repartition(4 * n_tasks, "cell", "block").sortWithinPartitions("cell", "block")
    found = saved(items.mapInArrow(tidy(_compare(path, threshold)), "gid long, n long, root long"), spark, "links")
    remove(path, placed, sizes, going)
    groups_of = components(spark, found.filter("root is not null").select(F.col("gid").alias("a"), F.col("root").alias("b")))
    counts = found.filter("n is not null").groupBy("gid").agg(F.sum("n").alias("n"))
    whole = (
        groups.select("copy", "gid", "m", "least").join(counts, "gid", "left").join(groups_of.withColumnRenamed("node", "gid"), "gid", "left")
        .select("copy", "least", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "gid").alias("component"))
    )
    least = whole.groupBy("component").agg(F.min("least").alias("component_id"))
    out = rows.select("id", "copy").join(whole.join(least, "component").select("copy", "n_links", "component_id"), "copy", "left")
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))


def near_duplicates(spark: SparkSession, df: DataFrame, threshold: float = 0.9, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``links`` with ``kept``: the one representative of each group."""
    return links(spark, df, threshold, id, vector).withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True)))
