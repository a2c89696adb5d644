import base64
import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from tracegrid.llm import components, embed, warc


# ---------------------------------------------------------------- 3


def test_warc(spark):
    rows = [(5, "http://a", "<p>é</p>"), (3, "http://b\r\nX: y", "<p>é</p>"), (9, None, "<p>é</p>"), (1, "u", None), (2, "u", ""), (4, "http://c", "own"), (3, "again", "<p>é</p>"), (None, "n", "own"), (None, "m", "only here")]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    index = warc.write(spark, pages)
    assert index.count() == len(rows)
    got = sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(index).collect()), key=str)
    code = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {"<p>é</p>": 3, "": 1, "own": 4}
    want = []
    for i, _, t in rows:
        f = first.get(t or "")
        revisit = f is not None and f != i
        want.append((i, len((t or "").encode()), code(t), "revisit" if revisit else "response", f if revisit else None))
    assert got == sorted(want, key=str)
    some = warc.read(index.filter("page_id = 4"), payloads=True).collect()
    assert [(r.page_id, bytes(r.payload)) for r in some] == [(4, b"own")]
    big = warc.read(warc.write(spark, pages, min_bytes=4))
    assert {r.page_id for r in big.filter("record_type = 'revisit'").collect()} == {5, 9}
    assert warc.read(warc.write(spark, pages.limit(0))).count() == 0


def test_ranges_coalesce():
    got = warc.ranges([("a", 0, 10), ("a", 10, 10), ("a", 10**6, 5), ("b", 0, 4)])
    assert [(f, s, e, len(k)) for f, s, e, k in got] == [("a", 0, 20, 2), ("a", 10**6, 10**6 + 5, 1), ("b", 0, 4, 1)]


# ---------------------------------------------------------------- 10


@pytest.mark.parametrize("block", [1024, 16])
def test_embeddings(spark, block, monkeypatch):
    monkeypatch.setattr(embed, "BLOCK", block)
    monkeypatch.setattr(embed, "PER_CELL", 32)
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 16))
    near = [base[rng.integers(20)] + rng.normal(scale=0.15, size=16) for _ in range(150)]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate([*base, *near])] + [(400, [float(x) for x in base[0]]), (401, [float(2 * x) for x in base[0]])]
    odd = [(500, None), (501, []), (502, [0.0] * 16), (503, [float("nan")] + [1.0] * 15), (504, [None] + [1.0] * 15), (505, [float("inf")] * 16), (506, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows + odd], "vec_id long, embedding array<double>, n_links int")
    got = {r.vec_id: r for r in embed.near_duplicates(spark, df).collect()}
    x = np.array([v for _, v in rows])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    assert sum(got[i].n_links for i, _ in rows) >= 0.97 * linked.sum()
    assert all(got[i].n_links <= n for (i, _), n in zip(rows, linked.sum(1)))
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in odd)
    assert got[400].component_id == got[0].component_id == got[401].component_id
    assert embed.near_duplicates(spark, df.limit(0)).count() == 0


def test_embeddings_of_many_cells(spark, monkeypatch):
    """All links are found with 256 cells, near the threshold and with centroids that don't know the pairs."""
    monkeypatch.setattr(embed, "PER_CELL", 8)
    rng = np.random.default_rng(3)
    apart = np.random.default_rng(4).normal(size=(256, 64))
    apart /= np.linalg.norm(apart, axis=1, keepdims=True)
    monkeypatch.setattr(embed, "spherical_kmeans", lambda x, k: apart[:k])
    x = rng.normal(size=(1024, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=x.shape)
    side -= (side * x).sum(1, keepdims=True) * x
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    cos = rng.uniform(0.901, 0.96, (1024, 1))
    x = np.concatenate([x, cos * x + np.sqrt(1 - cos**2) * side])
    got = embed.near_duplicates(spark, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()
    linked = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    assert [r.n_links for r in sorted(got)] == linked.sum(1).tolist()


def test_embeddings_of_extreme_lengths(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(40, 8))
    rows = [(k, (v * (1e200 if k % 3 == 0 else 1e-200 if k % 3 == 1 else 1)).tolist()) for k, v in enumerate(np.concatenate([base, base + rng.normal(scale=0.1, size=base.shape)]))]
    x = np.array([np.array(v) / np.abs(v).max() for _, v in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for reach in (embed.REACH, None):
        got = sorted(embed.links(spark, df, reach=reach).collect())
        assert [r.n_links for r in got] == linked.sum(1).tolist() and linked.any()
    twice = embed.links(spark, df.union(df).union(spark.createDataFrame([(None, rows[0][1])], df.schema))).collect()
    assert len(twice) == 161 and all(r.n_links == 2 * linked[r.vec_id].sum() + 1 + linked[r.vec_id][0] + (r.vec_id == 0) for r in twice if r.vec_id is not None)


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (None, 3), (5, 4)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(120)]
    got = {r.node: r.component for r in components.components(spark, spark.createDataFrame(edges, "a long, b long")).collect()}
    up = {}
    for a, b in edges:
        if a is not None and a != b:
            up.setdefault(a, a), up.setdefault(b, b)
    for _ in range(500):
        for a, b in edges:
            if a is not None and a != b:
                up[a] = up[b] = min(up[a], up[b])
    assert got == up


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.saved(stage(spark, docs, sf), spark, name)
        assert docs.columns == names and 0.5 * kept <= docs.count() <= kept
        kept = docs.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(out) == kept and all(r.n_tokens == len(r.ids) for r in out)
