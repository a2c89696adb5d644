"""Personal data: patterns, and terms that reveal it by the corpus' statistics.

Base: e-mail addresses, IPv4 addresses, card and phone numbers, each kind
found from left to right without overlaps; a match that fails its check (parts
over 255, Luhn, number of digits) is dropped and not tried again in part.

Terms: every distinct value found is a protected entity c of information
IC(c) = -log2 p(c), p over documents. A word t of a document that mentions c
discloses c as far as PMI(c; t) = log2 p(c, t) / (p(c) p(t)) reaches IC(c):
near equality means that t stands in no document without c. All of p are over
documents and the words outside of mentions; t's documents count as SMOOTH
more, so a pair met once reaches the less the smaller the corpus is. Terms from
GENERALISE of IC(c) on are generalised, from REMOVE on removed.

The counts cover all documents: pairs and entities from all mentions, and the
document frequency of every word that is in a pair. They are summed with
combiners, and the pairs that disclose go to a hash store that workers map.

A null or empty text has no spans. Repeated rows count as documents of their
own. Positions are code points, ends exclusive. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, HashStore, bucket_bits, hash_bytes, mix, saved, scan_bytes, shared_dir, slices, texts, tidy, words, write_store

KINDS = ("email", "ip", "card", "phone")
SMOOTH = 1
GENERALISE = 0.6
REMOVE = 0.9

# The kinds' patterns, with runs that can't give back what they took
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_EDGES = ".,;:!?\"'()[]"

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    doubled = [2 * int(d) for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """An address starts where the run of its characters before the @ does, or after the last address."""
    out, base, at = [], 0, text.find("@")
    while at >= 0:
        run = text[base:at]
        start = base + len(run.rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
            base = domain.end()
        else:
            base = at + 1
        at = text.find("@", base)
    return out


def base_spans(text: str) -> list[Span]:
    """All kinds' spans, by kind and place."""
    out: list[Span] = [("email", s, e) for s, e in emails(text)]
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def entity(text: str, span: Span) -> bytes:
    """A mention's value: numbers by their digits, addresses in lower case."""
    raw = text[span[1] : span[2]]
    return f"{span[0]}:{_digits(raw) if span[0] in ('card', 'phone') else raw.lower()}".encode()


def outside(text: str, spans: list[Span]) -> list[Span]:
    """The text's words that no mention touches, with their places."""
    taken = sorted((s, e) for _, s, e in spans)
    tops, reach = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    out = []
    for m in _WORD.finditer(text):
        s, e = m.span()
        core = m[0].strip(_EDGES)
        i = bisect_left(tops, e)
        if core and core[0].isalnum() and not (i and reach[i - 1] > s):
            at = text.index(core, s)
            out.append((core.translate(_LOWER), at, at + len(core)))
    return out


def mentioned(text: str, spans: list[Span]) -> list[bytes]:
    return sorted({entity(text, span) for span in spans})


def pair_key(c: np.ndarray, t: np.ndarray) -> np.ndarray:
    return mix(c * U64(3) + mix(t))


def disclosures(spark: SparkSession, docs: DataFrame, text: str = "text") -> tuple[str, int]:
    """The store of (entity, term) pairs that disclose: path and bits. Values: the share of IC that PMI reaches."""
    bits = bucket_bits(scan_bytes(docs), 64 << 20)

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield pairs_of(0, 0, part.num_rows)
                for x in texts(part.column(text)).to_pylist():
                    if spans := base_spans(x):
                        c, t = (hash_bytes(v).view(np.int64) for v in (mentioned(x, spans), [w.encode() for w in {w for w, _, _ in outside(x, spans)}]))
                        step = max(1, (1 << 20) // (len(t) + 1))
                        for k in range(0, len(c), step):
                            yield pairs_of(c[k : k + step], t)

    def pairs_of(c, t, n: int = 0) -> pa.RecordBatch:
        """Each entity alone and with each term; or the number of documents."""
        if n:
            return pa.RecordBatch.from_pydict({"c": pa.nulls(1, pa.int64()), "t": pa.nulls(1, pa.int64()), "n": pa.array([n], pa.int64())})
        k = len(t) + 1
        none = np.tile(np.arange(k) == 0, len(c))
        return pa.RecordBatch.from_pydict({"c": pa.array(np.repeat(c, k)), "t": pa.array(np.tile(np.r_[np.int64(0), t], len(c)), mask=none), "n": pa.array(np.ones(len(none), np.int64))})

    seen = saved(docs.select(text).mapInArrow(tidy(mentions), "c long, t long, n long").groupBy("c", "t").agg(F.sum("n").alias("n")), spark, "mentions")
    total = seen.filter("c is null").agg(F.sum("n")).first()[0] or 0
    pairs = seen.filter(F.col("c").isNotNull() & F.col("t").isNotNull())
    terms = shared_dir(spark, "terms")
    write_store(pairs.select(F.col("t").alias("key")).distinct().withColumn("one", F.lit(1)), terms, bits)

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, parts, held = HashStore(terms, bits), [], 0
        for batch in batches:
            for part in slices(batch, text):
                with_spans = []
                for i, x in enumerate(texts(part.column(text)).to_pylist()):
                    if spans := base_spans(x):
                        with_spans.append(i)
                        own = hash_bytes({w.encode() for w, _, _ in outside(x, spans)})
                        parts.append((own, np.ones(len(own), np.int64)))
                        held += len(own)
                idx, names, counts = words(part.filter(pa.array(~np.isin(np.arange(part.num_rows), with_spans))).column(text))
                bare = [w.strip(_EDGES.encode()) for w in names]
                key = hash_bytes(bare)
                found, _ = store.find(key)
                ids, back = np.unique(key, return_inverse=True)
                keep = found[idx] if len(idx) else np.empty(0, bool)
                own = np.repeat(np.arange(len(counts)), counts)[keep]
                once = np.unique(own << 32 | back[idx[keep]]) & 0xFFFFFFFF
                n = np.bincount(once, minlength=len(ids))
                parts.append((ids[n > 0], n[n > 0]))
                held += len(parts[-1][0])
                if held > 1 << 22:
                    yield summed(parts)
                    parts, held = [], 0
        if parts:
            yield summed(parts)

    def summed(parts: list) -> pa.RecordBatch:
        """A task's counts, one row a term."""
        ids, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
        n = np.bincount(back, np.concatenate([c for _, c in parts]), len(ids)).astype(np.int64)
        return pa.RecordBatch.from_pydict({"t": pa.array(ids.view(np.int64)), "n": pa.array(n)})

    docs_with = docs.select(text).mapInArrow(tidy(frequency), "t long, n long").groupBy("t").agg(F.sum("n").alias("nt"))
    entities = seen.filter("c is not null and t is null").select("c", F.col("n").alias("nc"))
    ic = F.log2(F.lit(float(max(total, 1))) / F.col("nc"))
    pmi = F.log2(F.col("n") * F.lit(float(max(total, 1))) / (F.col("nc") * (F.col("nt") + SMOOTH)))
    share = pairs.join(entities, "c").join(docs_with, "t").filter(ic > 0).withColumn("share", pmi / ic).filter(F.col("share") >= GENERALISE)
    path = shared_dir(spark, "disclosures")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = pair_key(*(b.column(x).to_numpy().view(U64) for x in ("c", "t")))
            yield pa.RecordBatch.from_pydict({"key": pa.array(key.view(np.int64)), "share": b.column("share")})

    write_store(share.select("c", "t", "share").mapInArrow(tidy(keyed), "key long, share double"), path, bits)
    return path, bits


def term_spans(text: str, spans: list[Span], store: HashStore) -> list[tuple[int, int, bool]]:
    """The document's disclosing words: start, end, and whether to remove them."""
    places = outside(text, spans)
    if not places:
        return []
    names = sorted({w for w, _, _ in places})
    t = hash_bytes([w.encode() for w in names])
    best = np.zeros(len(names))
    for c in hash_bytes(mentioned(text, spans)):
        best = np.maximum(best, store.find(pair_key(c, t), share=np.float64)[1]["share"])
    share = dict(zip(names, best.tolist()))
    return [(s, e, share[w] >= REMOVE) for w, s, e in places if share[w] > 0]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def sanitise(text: str, spans: list[Span], terms: list[tuple[int, int, bool]]) -> str:
    """Mentions become their kind, terms a word of no meaning or nothing."""
    edits = sorted([(s, e, f"[{k}]") for k, s, e in spans] + [(s, e, "" if gone else "[term]") for s, e, gone in terms])
    out, at = [], 0
    for s, e, new in edits:
        if s < at:  # inside an earlier mention
            at = max(at, e)
            continue
        out += [text[at:s], new]
        at = e
    return "".join([*out, text[at:]])


def find(spark: SparkSession, docs: DataFrame, id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term) of each row, and the sanitised text if asked."""
    path, bits = disclosures(spark, docs, text)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = HashStore(path, bits)
        for batch in batches:
            for part in slices(batch, text):
                rows = []
                for x in texts(part.column(text)).to_pylist():
                    spans = base_spans(x)
                    terms = term_spans(x, spans, store) if spans else []
                    counts = [sum(k == kind for k, _, _ in spans) for kind in KINDS]
                    base = written(spans)
                    rows.append((*counts, hashlib.sha256(base.encode()).hexdigest(), written(spans + [("term", s, e) for s, e, _ in terms]), len(terms), sanitise(x, spans, terms) if with_text else None))
                kinds = (*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), pa.string())
                names = [id, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_term", "sanitised"]
                yield pa.RecordBatch.from_arrays([part.column(id), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=names)

    kind = dict(docs.dtypes)[id]
    out = docs.select(id, text).mapInArrow(tidy(mark), f"`{id}` {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_term long, sanitised string")
    return out if with_text else out.drop("sanitised")
