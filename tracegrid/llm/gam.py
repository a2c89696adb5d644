"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a whole text are put in quantile bins. Boosting goes round and
round the features: each turn fits one shallow tree on that feature's bins to
the residual and adds it to the feature's lookup table; afterwards the pairs
of features with the largest gain get tables the same way. A score is the
logistic of the sum of table entries, so scoring is additions of looked-up
bins over whole Arrow batches.

Learning takes at most ``sample`` labelled rows (those of smallest hash of the
id, whatever the tables' order), so what reaches the driver has a fixed bound;
every document is scored over its whole text. Null and empty texts have all
features 0 and get a score like others; very long texts are measured whole, one
at a time. Rows without a label are not learnt from; an id labelled twice takes
its smallest label, an id with several texts the least features. Ties of a
split go to the lowest bin, those of pairs to the first features. Repeated rows
are scored each. With no usable label all scores are 0.5; an empty table gives
no rows. Extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts, tidy, words

SAMPLE = 20_000
BINS = 32
COARSE = 8
ROUNDS = 150
PAIR_ROUNDS = 60
PAIRS = 12
RATE = 0.15

#: Byte classes that are counted: every byte has one.
CLASSES = ("upper", "lower", "digit", "space", "newline", "stop", "comma", "shout", "bar", "symbol", "quote", "other")
_SETS = {"digit": b"0123456789", "space": b" \t\r\f\v", "newline": b"\n", "stop": b".?:;", "comma": b",", "shout": b"!", "bar": b"|", "symbol": b"#$%&*+/<=>@[\\]^_`{}~", "quote": b"\"'()-"}
_CLASS = np.full(256, CLASSES.index("other"), np.int64)
for _b in range(256):
    if 65 <= _b <= 90:
        _CLASS[_b] = 0
    elif 97 <= _b <= 122 or _b >= 128:
        _CLASS[_b] = 1
for _name, _set in _SETS.items():
    _CLASS[list(_set)] = CLASSES.index(_name)

FEATURES = (
    "log_bytes", "log_words", *(f"share_{c}" for c in CLASSES), "mean_word", "spread_word", "longest_word",
    "distinct_words", "repeated_next", "top_word", "short_words", "words_per_line", "distinct_log",
)


def features(col: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    text = texts(col)
    n = len(text)
    text = text.cast(pa.large_binary())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + n + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    size = np.diff(ends)
    k = len(CLASSES)
    owner = np.repeat(np.arange(n) * k, size)
    share = np.bincount(owner + _CLASS[raw], minlength=n * k).reshape(n, k).astype(float)
    newlines = share[:, CLASSES.index("newline")].copy()
    share /= np.maximum(size, 1)[:, None]

    idx, names, counts = words(col)
    own = np.repeat(np.arange(n), counts)
    some = np.maximum(counts, 1)
    length = np.fromiter((len(w) for w in names), float, len(names))[idx] if len(idx) else np.empty(0)
    mean = np.bincount(own, length, n) / some
    spread = np.sqrt(np.maximum(np.bincount(own, length**2, n) / some - mean**2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, own, length)
    pairs, times = np.unique(own << 32 | idx, return_counts=True)
    who = pairs >> 32
    distinct = np.bincount(who, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, who, times)
    again = np.zeros(n)
    if len(idx) > 1:
        same = (idx[1:] == idx[:-1]) & (own[1:] == own[:-1])
        again = np.bincount(own[1:][same], minlength=n)
    short = np.bincount(own, length <= 3, n)
    return np.column_stack([
        np.log1p(size), np.log1p(counts), share, mean, spread, np.minimum(longest, 200), distinct / some, again / some,
        top / some, short / some, counts / (newlines + 1), np.log1p(distinct) / np.log1p(some),
    ])


@dataclass
class Model:
    edges: list[np.ndarray]
    base: float
    single: np.ndarray  # feature x bin
    pairs: list[tuple[int, int]]
    double: np.ndarray  # pair x coarse bin x coarse bin
    coarse: list[np.ndarray]  # per feature: coarse bin of each bin

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)]) if len(x) else np.zeros((0, len(self.edges)), int)

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        z = np.full(len(x), self.base)
        for j in range(b.shape[1]):
            z += self.single[j, b[:, j]]
        for t, (i, j) in enumerate(self.pairs):
            z += self.double[t, self.coarse[i][b[:, i]], self.coarse[j][b[:, j]]]
        return 1 / (1 + np.exp(-z))


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Leaf values along the bins of a tree of ``depth`` cuts grown by gain."""
    if depth == 0 or len(g) < 2:
        return np.full(len(g), g.sum() / (h.sum() + 1.0))
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = left_g**2 / (left_h + 1) + (g.sum() - left_g) ** 2 / (h.sum() - left_h + 1)
    cut = int(np.argmax(gain)) + 1
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _corner(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The best two-way cut of a pair's grid: its gain over no cut, and its four leaves."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a_g, a_h = cg[:-1, :-1], ch[:-1, :-1]
    b_g, b_h = cg[:-1, -1:] - a_g, ch[:-1, -1:] - a_h
    c_g, c_h = cg[-1:, :-1] - a_g, ch[-1:, :-1] - a_h
    d_g, d_h = cg[-1, -1] - a_g - b_g - c_g, ch[-1, -1] - a_h - b_h - c_h
    gain = sum(x**2 / (y + 1) for x, y in ((a_g, a_h), (b_g, b_h), (c_g, c_h), (d_g, d_h)))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    out = np.empty_like(g)
    for rows in (slice(0, i + 1), slice(i + 1, None)):
        for cols in (slice(0, j + 1), slice(j + 1, None)):
            out[rows, cols] = g[rows, cols].sum() / (h[rows, cols].sum() + 1)
    return float(gain[i, j] - cg[-1, -1] ** 2 / (ch[-1, -1] + 1)), out


def learn(x: np.ndarray, y: np.ndarray) -> Model:
    d = len(FEATURES)
    if len(y) == 0:
        return Model([np.empty(0)] * d, 0.0, np.zeros((d, BINS)), [], np.zeros((0, COARSE, COARSE)), [np.zeros(BINS, int)] * d)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(d)]
    coarse = [np.minimum(np.arange(BINS) * COARSE // (len(e) + 1), COARSE - 1) for e in edges]
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Model(edges, float(np.log(p / (1 - p))), np.zeros((d, BINS)), [], np.zeros((0, COARSE, COARSE)), coarse)
    b = model.bins(x)
    z = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j in range(d):
            q = 1 / (1 + np.exp(-z))
            n = len(edges[j]) + 1
            step = np.zeros(BINS)
            step[:n] = RATE * _tree(np.bincount(b[:, j], y - q, n), np.bincount(b[:, j], q * (1 - q), n))
            model.single[j] += step
            z += step[b[:, j]]
    c = np.column_stack([coarse[j][b[:, j]] for j in range(d)])

    def grid(i: int, j: int) -> tuple[float, np.ndarray]:
        q = 1 / (1 + np.exp(-z))
        at = c[:, i] * COARSE + c[:, j]
        return _corner(*(np.bincount(at, w, COARSE * COARSE).reshape(COARSE, COARSE) for w in (y - q, q * (1 - q))))

    found = sorted(((grid(i, j)[0], i, j) for i in range(d) for j in range(i + 1, d)), key=lambda t: (-t[0], t[1], t[2]))
    model.pairs = [(i, j) for _, i, j in found[:PAIRS]]
    model.double = np.zeros((len(model.pairs), COARSE, COARSE))
    for _ in range(PAIR_ROUNDS):
        for t, (i, j) in enumerate(model.pairs):
            step = RATE * grid(i, j)[1]
            model.double[t] += step
            z += step[c[:, i], c[:, j]]
    return model


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """A model of ``labels(id, label)``; keep held-out rows out of ``labels``."""
    some = (
        labels.filter(F.col(label).isNotNull() & F.col(id).isNotNull())
        .groupBy(id).agg(F.min(label).cast("double").alias("y"))
        .orderBy(F.xxhash64(F.col(id).cast("string")), id).limit(sample)
    )
    # at most `sample` ids: the bound that allows the broadcast
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).join(F.broadcast(some.withColumnRenamed(id, "id")), "id")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                x = features(part.column("text"))
                yield pa.RecordBatch.from_pydict({"i": part.column("id").cast(pa.string()), "y": part.column("y"), "x": pa.array(list(x), pa.list_(pa.float64()))})

    one = rows.mapInArrow(tidy(measure), "i string, y double, x array<double>").groupBy("i").agg(F.min("y").alias("y"), F.min("x").alias("x"))
    got = one.toPandas().sort_values("i", kind="stable")
    x = np.array(got["x"].tolist(), float).reshape(-1, len(FEATURES))
    return learn(x, got["y"].to_numpy(float))


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text as column ``out``, replacing one of that name."""
    docs = docs.drop(out)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text, 1 << 20):
                s = model.score(features(part.column(text)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(s)], names=[*part.schema.names, out])

    from pyspark.sql.types import DoubleType, StructField, StructType

    return docs.mapInArrow(tidy(rate), StructType([*docs.schema.fields, StructField(out, DoubleType())]))
