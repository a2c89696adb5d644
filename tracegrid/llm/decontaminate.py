"""Benchmark decontamination by pigeonhole edit matching.

A test item of m normalised characters may be found with k = error * m edits.
Cut in k + 1 pieces, at least one piece of any such occurrence is unchanged;
and of the pieces taken by twos, some two have at most one edit together, so
the hit's sibling must stand beside it with at most one.
So all items' pieces are looked for at once (Aho-Corasick over the whole
text); a piece hit gives a window, which is checked first by the q-gram lemma
and then by Myers' bit-parallel distance (item anywhere in the window).

The items are shared with the workers in blocks of BLOCK characters at most,
whatever the size of the benchmark; each document is scanned for each block,
one after the other (what a block found is written before the next one is
looked for, so a worker holds one). Nothing is shuffled.

Texts and items are compared in lower case with white space and punctuation as
single spaces. Items of under ``MIN`` characters then are looked for as whole
words without edits; null items and those without a character are not looked
for. Null and empty texts contain nothing, and very long ones are scanned whole.
Of several places the least distance counts. Repeated documents get a row each,
repeated items are all reported, with null item ids last; an empty benchmark
finds nothing, an empty table gives no rows. Extra columns pass through, but
those named like ``out``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .common import free_name, remove, saved, slices, texts, tidy

ERROR = 0.1
MIN = 24
GRAM = 3
BLOCK = 16 << 20

_SPACES = bytes(i if i > 127 or chr(i).isalnum() else 32 for i in range(256))


def normal(text: str) -> str:
    return b" ".join(text.lower().encode().translate(_SPACES).split()).decode()


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    return [(s, item[s:e]) for s, e in zip(cuts, cuts[1:])]


def beside(text: str, start: int, end: int, sibling: str, right: bool) -> bool:
    """Whether ``sibling`` can stand next to text[start:end] with at most one edit: one
    of its halves is then unchanged, shifted by one place at most."""
    half = len(sibling) // 2
    a, b = sibling[:half], sibling[half:]
    if right:
        near = text[end : end + len(sibling) + 1]
        return near.startswith(a) or b in near[max(0, half - 1) :]
    near = text[max(0, start - len(sibling) - 1) : start]
    return near.endswith(b) or a in near[: half + 2]


def myers(item: str, text: str, limit: int) -> int | None:
    """The least edit distance of ``item`` to any part of ``text``, None if over ``limit``."""
    m = len(item)
    masks: dict[str, int] = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        vertical = eq | minus
        horizontal = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (full & ~(horizontal | plus))
        down = plus & horizontal
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        best = min(best, score)
        up, down = up << 1 & full, down << 1 & full
        plus = down | (full & ~(vertical | up))
        minus = up & vertical
    return best if best <= limit else None


class Finder:
    """Items found in texts."""

    def __init__(self, items: list[tuple[int | None, str]], error: float):
        import ahocorasick

        own = [(i, normal(t or "")) for i, t in items]
        self.items = [(i, t, int(error * len(t)) if len(t) >= MIN else 0) for i, t in own if t]
        self.grams = [Counter(t[j : j + GRAM] for j in range(len(t) - GRAM + 1)) for _, t, _ in self.items]
        at: dict[str, list[tuple]] = {}
        for n, (_, t, k) in enumerate(self.items):
            cut = pieces(t, k)
            for j, (offset, piece) in enumerate(cut):
                sibling = cut[j ^ 1][1] if j ^ 1 < len(cut) else None
                at.setdefault(piece, []).append((n, offset, sibling, j % 2 == 0))
        self.machine = ahocorasick.Automaton()
        for piece, where in at.items():
            self.machine.add_word(piece, (len(piece), where))
        if at:
            self.machine.make_automaton()
        self.any = bool(at)

    def __call__(self, text: str) -> dict[int, int]:
        """The least distance at which each item (by number) is found."""
        found: dict[int, int] = {}
        if not self.any or not text:
            return found
        text = normal(text)
        tried: set[tuple[int, int]] = set()
        for end, (length, where) in self.machine.iter(text):
            for n, offset, sibling, right in where:
                if sibling is not None and not beside(text, end + 1 - length, end + 1, sibling, right):
                    continue
                start = end + 1 - length - offset
                _, item, k = self.items[n]
                if len(item) < MIN and not (text[max(0, start - 1) : start] in ("", " ") and text[end + 1 : end + 2] in ("", " ")):
                    continue
                if found.get(n) == 0 or (n, start) in tried:
                    continue
                tried.add((n, start))
                window = text[max(0, start - k) : start + len(item) + k]
                if item in window:
                    found[n] = 0
                    continue
                have = Counter(window[j : j + GRAM] for j in range(len(window) - GRAM + 1))
                common = sum(min(c, have[g]) for g, c in self.grams[n].items() if g in have)
                if common < len(item) - GRAM + 1 - k * GRAM:
                    continue
                distance = myers(item, window, min(k, found.get(n, k)))
                if distance is not None:
                    found[n] = distance
        return found


def matches(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", error: float = ERROR, out: tuple[str, str] = ("items", "distances")) -> DataFrame:
    """``docs`` with the found items and their distances as ``out`` (arrays, in order of item id; empty for clean documents)."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t"))
    total = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // BLOCK) or 1
    fields = [f for f in docs.schema.fields if f.name not in out]
    schema = StructType([*fields, *(StructField(c, ArrayType(LongType())) for c in out)])
    found = docs.select(*(f"`{f.name}`" for f in fields)).withColumns({c: F.array().cast("array<bigint>") for c in out})
    for b in range(blocks):
        # of BLOCK characters or so: the size is bounded by the choice of `blocks`
        own = spark.sparkContext.broadcast([(r.i, r.t) for r in items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()])

        def find(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            finder = Finder(own.value, error)
            for batch in batches:
                for part in slices(batch, text):
                    rows = []
                    for t, ids, distances in zip(texts(part.column(text)).to_pylist(), part.column(out[0]).to_pylist(), part.column(out[1]).to_pylist()):
                        got = [(finder.items[n][0], d) for n, d in finder(t).items()]
                        rows.append(sorted(got + list(zip(ids, distances)), key=lambda x: (x[0] is None, x[0] or 0, x[1])))
                    new = {c: pa.array([[x[k] for x in r] for r in rows], pa.list_(pa.int64())) for k, c in enumerate(out)}
                    yield pa.RecordBatch.from_arrays([new.get(f, part.column(f)) for f in part.schema.names], names=part.schema.names)

        before, found = found, found.mapInArrow(tidy(find), schema)
        if b < blocks - 1:
            found = saved(found, spark, "items")
        if 0 < b < blocks - 1:
            remove(before)
    return found


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents in which no item is found, with their own columns."""
    out = free_name(docs, "items"), free_name(docs, "distances")
    return matches(spark, docs, benchmark, out=out, **kw).filter(F.size(out[0]) == 0).select(*(f"`{c}`" for c in docs.columns))
