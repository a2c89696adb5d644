import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
import xxhash

from tracegrid.llm import bpe, decontaminate, gam, jaccard, kneser_ney, linededup, maglev, sanitise

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


# ---------------------------------------------------------------- 1


def test_classifier(spark, docs, empty):
    rng = random.Random(2)
    good = [(i, " ".join(rng.choice("alpha beta gamma delta eps".split()) + str(rng.randint(0, 99)) for _ in range(40))) for i in range(300)]
    bad = [(1000 + i, " ".join([rng.choice("AA BB".split()) + "!!"] * 30)) for i in range(100)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(5, None), (None, 1), (7, 1)], "doc_id long, quality int")
    model = gam.fit(spark.createDataFrame(good + bad, "doc_id long, text string"), labels)
    got = {r.doc_id: r.score for r in gam.score(spark.createDataFrame(good + bad, "doc_id long, text string"), model).collect()}
    assert min(got[i] for i, _ in good) > 0.8 and max(got[i] for i, _ in bad) < 0.2
    scored = gam.score(docs, model)
    assert scored.columns == [*(c for c in docs.columns if c != "score"), "score"]
    assert all(0 <= r.score <= 1 for r in scored.collect()) and scored.count() == docs.count()
    none = gam.fit(empty.select("doc_id", "text"), labels)
    assert {r.score for r in gam.score(docs, none).collect()} == {0.5}
    assert gam.score(empty, model).count() == 0


# ---------------------------------------------------------------- 2


def test_bpe(spark, docs, rows, empty):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(RANKS), special_tokens={})
    rng = random.Random(1)
    more = ["".join(rng.choice("ab \n'st1.!é") for _ in range(200)) for _ in range(50)] + ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(60, 300))) for _ in range(50)]
    both = spark.createDataFrame([(i, t) for i, t in enumerate([t for _, t in rows] + more)], "doc_id long, text string")
    ids = bpe.encode(spark, both, RANKS, P.PATTERN)
    got = {r.doc_id: r.ids for r in ids.collect()}
    assert [i for i, t in enumerate([t for _, t in rows] + more) if got[i] != enc.encode_ordinary(t or "")] == []
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, RANKS).collect()}
    assert all(back[i] == (t or "").encode() for i, t in enumerate([t for _, t in rows] + more))
    digests = bpe.encode_digests(spark, docs, RANKS, P.PATTERN).collect()
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == collections.Counter(
        (i, len(x := enc.encode_ordinary(t or "")), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows
    )
    assert bpe.encode(spark, empty, RANKS, P.PATTERN).count() == 0


def test_bpe_rank_map_is_short(spark):
    """The driver writes each plan out in full, with the rank map."""
    pieces = spark.createDataFrame([(b"one",)], "piece binary")
    assert len(bpe.encode_pieces(pieces, bpe.load_ranks(RANKS))._jdf.queryExecution().optimizedPlan().toString()) < 3 << 20


# ---------------------------------------------------------------- 4


def test_kneser_ney(spark, docs, rows, empty):
    train = [(i, t) for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    model = kneser_ney.fit(spark, spark.createDataFrame(train, "doc_id long, text string"))
    got = kneser_ney.score(docs, model)
    assert got.columns[:6] == ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    toks = lambda s: [w for w in re.split(rb"[\x20\x09-\x0d]+", (s or "").encode().lower()) if w] + [0]
    count, pairs = collections.Counter(), collections.Counter()
    for _, t in train:
        w = toks(t)
        count.update(w)
        pairs.update(zip([1, *w], w))
    n, v = sum(count.values()), len(count)
    after = collections.Counter(b for _, b in pairs)
    ways = lambda c: collections.Counter(c.values())
    high, low = (kneser_ney.discounts([ways(c)[k] for k in (1, 2, 3, 4)]) for c in (pairs, after))
    cut = lambda d, c: d[min(c, 3) - 1] if c else 0
    spare = sum(cut(low, c) for c in after.values()) / len(pairs)
    context = collections.defaultdict(list)
    for (a, _), c in pairs.items():
        context[a].append(c)

    def p(a, b):
        one = max(after[b] - cut(low, after[b]), 0) / len(pairs) + spare / (v + 1)
        if a not in context:
            return one
        return max(pairs[a, b] - cut(high, pairs[a, b]), 0) / sum(context[a]) + sum(cut(high, c) for c in context[a]) / sum(context[a]) * one

    assert abs(sum(p(b"the", b) for b in count) + spare / (v + 1) * sum(cut(high, c) for c in context[b"the"]) / sum(context[b"the"]) - 1) < 1e-9
    texts = dict(rows)
    for r in got.collect():
        w = toks(texts[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in count for x in w), n)
        assert r.score == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip([1, *w], w)))
        assert r.base_score == pytest.approx(sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w))
    none = kneser_ney.score(docs, kneser_ney.fit(spark, empty))
    assert all(math.isfinite(r.score) and r.train_tokens == 0 for r in none.collect())


# ---------------------------------------------------------------- 5


def shingles(t, width=3):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()


def brute_components(rows, percent=90):
    sets = [(i, shingles(t)) for i, t in rows]
    up = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                old, new = up[a], up[b]
                up = [new if u == old else u for u in up]
    least = {}
    for (i, _), u in zip(sets, up):
        least[u] = min(least.get(u, i), i)
    return sorted((i, len(s), least[u]) for (i, s), u in zip(sets, up))


@pytest.mark.parametrize("block", [256, 3])
def test_jaccard(spark, docs, rows, empty, block, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST", block)
    rng = random.Random(8)
    base = [rng.choice("abcdefghij") + str(rng.randint(0, 999)) for _ in range(120)]
    crowd = list(rows)
    for k in range(40):  # a group whose members link in chains
        for _ in range(2):
            base[rng.randrange(len(base))] = f"w{rng.randint(0, 10**6)}"
        crowd.append((1000 + k, " ".join(base)))
    got = jaccard.link_groups(spark, spark.createDataFrame(crowd, "doc_id long, text string"))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got.collect()) == brute_components(crowd)
    if block == 256:
        kept = jaccard.keep_one(spark, docs)
        assert kept.columns == docs.columns
        assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _, c in brute_components(rows) if i == c)
        assert jaccard.link_groups(spark, empty).count() == 0
        assert jaccard.link_groups(spark, spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "z")], "doc_id long, text string")).filter("component_id = 4").count() == 2


def test_copies_stage(spark, rows):
    import corpus_pipeline

    rng = random.Random(12)
    near = [[f"w{rng.randint(0, 10**6)}" for _ in range(100)] for _ in range(4)]
    crowd = list(rows)
    for k, words in enumerate(near):
        crowd.append((2000 + k, " ".join(words)))
        for m, spoilt in enumerate([(30, 70), (20, 50, 80)]):  # 86 of 106 shingles of five words, 81 of 111
            crowd.append((3000 + 10 * k + m, " ".join(f"x{i}" if i in spoilt else w for i, w in enumerate(words))))
    sets = [(i, shingles(t, 5)) for i, t in crowd]
    up = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                up = [up[b] if u == up[a] else u for u in up]
    least = {u: min(i for (i, _), v in zip(sets, up) if v == u) for u in up}
    want = sorted(i for (i, _), u in zip(sets, up) if i == least[u])
    got = corpus_pipeline.copies(spark, spark.createDataFrame(crowd, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in got.collect()) == want
    assert {3000, 3010, 3020, 3030}.isdisjoint(want)


# ---------------------------------------------------------------- 6


def test_maglev(spark, docs, empty):
    table = maglev.lookup_table([f"s{i}" for i in range(10)], 1009)
    sizes = np.bincount(table)
    assert (table >= 0).all() and sizes.max() - sizes.min() <= 1
    less = maglev.lookup_table([f"s{i}" for i in range(9)], 1009)
    assert (table[table < 9] == less[table < 9]).mean() > 0.8
    names = [f"s{i}" for i in range(10)]
    got = maglev.place(spark, docs, "doc_id", names, 1009)
    one = got.collect()
    assert len(one) == docs.count() and all(names[table[r.slot]] == r.shard for r in one)
    assert len({r.shard for r in one if r.doc_id == 7}) == 1
    assert maglev.place(spark, empty, "doc_id", names, 1009).count() == 0
    with pytest.raises(ValueError):
        maglev.lookup_table(["a"], 10)


# ---------------------------------------------------------------- 7


def test_personal_data_patterns():
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def brute(t):
        out = []
        for k, pattern in kinds.items():
            for m in re.finditer(pattern, t):
                d = re.sub("[^0-9]", "", m[0])
                fine = {"email": True, "ip": k != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and sanitise.luhn(d), "phone": 9 <= len(d) <= 15}[k]
                out += [(k, m.start(), m.end())] * fine
        return out

    rng = random.Random(3)
    for _ in range(4000):
        t = "".join(rng.choice("a@.1 23-+()45_é%A\n") for _ in range(60))
        assert sanitise.base_spans(t) == brute(t)
    assert sanitise.luhn("4111111111111111") and not sanitise.luhn("4111111111111112")
    for long in ("@" * 100_000, "1" * 100_000, "1." * 50_000, "a" * 100_000, "+1" + " " * 100_000):
        sanitise.base_spans(long)


def test_sanitise(spark, empty):
    who = "Write to Zorbius Quandle at z.q@mail.example.com about the work of the day and that is all"
    rows = [(i, who) for i in range(3)] + [(10 + i, "the work of the day at that is all about to write") for i in range(60)] + [(90, None), (91, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in sanitise.find(spark, df, with_text=True).collect()}
    assert got[0].n_email == 1 and got[90].spans == "" and got[91].base_sha256 == hashlib.sha256(b"").hexdigest()
    s = who.index("z.q@")
    assert got[0].spans.startswith(f"email:{s}:{s + 20}")
    marked = {who[int(a) : int(b)] for _, a, b in (x.split(":") for x in got[0].spans.split(",")[1:])}
    assert {"Zorbius", "Quandle"} <= marked and not marked & {"the", "work", "at", "about"}
    assert "z.q" not in got[0].sanitised and "Zorbius" not in got[0].sanitised and got[10].sanitised == rows[3][1]
    assert sanitise.find(spark, empty).count() == 0


def test_sanitise_whole_document(spark):
    """Terms far from a mention, codes that start with digits, and entities of one document count."""
    common = "the work of the day at that is all about to write " * 5
    far = f"Zorbius said so. {common} mail z.q@mail.example.com {common} his file is 77X-1009, by Quandle."
    rows = [(0, far)] + [(10 + i, common) for i in range(3000)] + [(5000 + i, "Half known, as is " + common) for i in range(300)]
    got = {r.doc_id: r for r in sanitise.find(spark, spark.createDataFrame(rows, "doc_id long, text string"), with_text=True).collect()}
    marked = {far[int(a) : int(b)] for _, a, b in (x.split(":") for x in got[0].spans.split(",")[1:])}
    assert {"Zorbius", "Quandle", "77X-1009"} <= marked and not marked & set(common.split())
    assert all(x not in got[0].sanitised for x in ("Zorbius", "Quandle", "77X-1009"))
    assert got[10].n_term == got[5000].n_term == 0
    assert got[0].n_term == sum(x in marked for x in re.findall(r"[\w-]+", far.replace("z.q@mail.example.com", "")))


# ---------------------------------------------------------------- 8


def edit_distance(item, text):
    row = list(range(len(item) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
        row = new
        best = min(best, row[-1])
    return best


def test_myers_against_the_table():
    rng = random.Random(4)
    for _ in range(300):
        a = "".join(rng.choice("ab ") for _ in range(rng.randint(1, 70)))
        b = "".join(rng.choice("ab ") for _ in range(rng.randint(0, 90)))
        assert decontaminate.myers(a, b, 100) == edit_distance(a, b)


def test_decontaminate(spark, docs, rows, empty):
    rng = random.Random(6)
    items = [(k, " ".join(rows[k][1].split()[:14])) for k in range(0, 20, 2)] + [(900, None), (901, "too short"), (902, "nowhere to be found in any of these documents at all")]
    hurt = []
    for k, t in items[:6]:
        c = list(t)
        for _ in range(k):
            c[rng.randrange(len(c))] = "q"
        hurt.append((500 + k, "Before it. " + "".join(c).upper() + " after it."))
    own = spark.createDataFrame([*rows, *hurt], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = collections.Counter((r.doc_id, tuple(zip(r["items"], r.distances))) for r in decontaminate.matches(spark, own, bench).collect())
    want = collections.Counter()
    for i, t in [*rows, *hurt]:
        t = decontaminate.normal(t or "")
        found = []
        for k, x in items:
            x = decontaminate.normal(x or "")
            if len(x) >= decontaminate.MIN and (d := edit_distance(x, t)) <= int(decontaminate.ERROR * len(x)):
                found.append((k, d))
        want[i, tuple(found)] += 1
    assert got == want
    assert decontaminate.clean(spark, docs, bench).columns == docs.columns
    assert decontaminate.matches(spark, empty, bench).count() == 0
    assert decontaminate.clean(spark, docs, bench.limit(0)).count() == docs.count()


# ---------------------------------------------------------------- 9


def test_line_dedup(spark, docs, rows, empty):
    rng = random.Random(9)
    passage = "".join(f"Passage {rng.randint(0, 10**6)} with words {rng.randint(0, 10**6)} and more, then {rng.randint(0, 10**6)} ends it. " for _ in range(12))
    fresh = lambda k: "".join(f"Own line {k} {rng.randint(0, 10**9)} of this document only. " for _ in range(6))
    own = [(k, fresh(k) + passage + fresh(k)) for k in range(5)] + [(50, fresh(50)), (60, None), (61, ""), (70, passage + fresh(70) + passage)]
    got = {r.doc_id: r for r in linededup.dedup(spark, spark.createDataFrame(own, "doc_id long, text string")).collect()}
    texts = dict(own)
    assert got[0].text == texts[0] and got[50].text == texts[50] and got[60].text is None and got[61].text == ""
    for k in (1, 2, 3, 4, 70):
        left = got[k].text
        assert sum(len(x) for x in linededup.CUT.split(passage) if x and x in left) < 0.25 * len(passage)
        assert all(x in left for x in linededup.CUT.split(texts[k]) if x.startswith("Own"))
    out = linededup.dedup(spark, docs)
    assert out.columns == [*(c for c in docs.columns if c != "n_lines"), "n_lines", "n_removed"] and out.count() == len(rows)
    assert linededup.dedup(spark, empty).count() == 0
    twice = "One line of some words here, another one of some more words. And a third one that is long. " * 4
    alone = linededup.dedup(spark, spark.createDataFrame([(1, twice)], "doc_id long, text string")).first()
    assert 0 < len(alone.text) <= len(twice)


@pytest.mark.parametrize("clauses, size", [(1, 60), (1, 31), (2, 30), (3, 20), (4, 14), (5, 12), (6, 10), (8, 7)])
def test_line_dedup_few_clauses(spark, clauses, size):
    """A passage that two documents share, between neighbours of their own, leaves the second one."""
    rng = random.Random(100 * clauses + size)
    clause = lambda n: " ".join(f"w{rng.randint(0, 10**7)}" for _ in range(n)) + ", "
    own = lambda: "".join(clause(rng.randint(3, 12)) for _ in range(rng.randint(1, 5)))
    texts, want = [], {}
    for k in range(60):
        passage = "".join(clause(size) for _ in range(clauses))
        for i in (2 * k, 2 * k + 1):
            before, after = own(), own()
            texts.append((i, before + passage + after))
            want[i] = before + after if i % 2 else before + passage + after
    got = linededup.dedup(spark, spark.createDataFrame(texts, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == want


# ---------------------------------------------------------------- brute force and odd inputs


def test_classifier_scores_by_hand(spark, docs, rows):
    """Scores equal those added up from the tables one by one."""
    rng = random.Random(4)
    some = [(i, " ".join(rng.choice(["alpha", "BETA!", "x9", "the"]) for _ in range(rng.randint(1, 80)))) for i in range(200)]
    labels = spark.createDataFrame([(i, int("BETA" not in t[:40])) for i, t in some], "doc_id long, quality int")
    model = gam.fit(spark.createDataFrame(some + some, "doc_id long, text string"), labels)
    got = {(r.doc_id, r.text): r.quality for r in gam.score(docs, model, out="quality").collect()}
    for i, t in rows:
        x = gam.features(pa.array([t], pa.string()))[0]
        place = [sum(1 for e in edges if v >= e) for v, edges in zip(x, model.edges)]
        z = model.base + sum(model.single[j][b] for j, b in enumerate(place))
        for (a, b), table in zip(model.pairs, model.double):
            z += table[model.coarse[a][place[a]]][model.coarse[b][place[b]]]
        assert got[i, t] == pytest.approx(1 / (1 + math.exp(-z)))


def test_maglev_by_a_slow_fill(spark):
    names, size = [f"s{k}" for k in range(7)], 101
    turn = {n: [(xxhash.xxh64_intdigest(n.encode(), seed=1) + k * (xxhash.xxh64_intdigest(n.encode(), seed=2) % (size - 1) + 1)) % size for k in range(size)] for n in names}
    table = {}
    while len(table) < size:
        for n in names:
            free = [x for x in turn[n] if x not in table]
            if free:
                table[free[0]] = n
    keys = spark.createDataFrame([(k,) for k in [*range(300), None]], "k long")
    slot = {r.k: r.s for r in keys.selectExpr("k", f"pmod(xxhash64(k), {size}) as s").collect()}
    got = maglev.place(spark, keys, "k", names, size).collect()
    assert len(got) == 301 and all(r.slot == slot[r.k] and r.shard == table[r.slot] for r in got)
    counts = collections.Counter(table.values())
    assert max(counts.values()) - min(counts.values()) <= 1


def test_answers_are_derived():
    """A leader's overlaps are known before its followers', and spare or shorten theirs; the groups stay those of brute force."""
    rng = np.random.default_rng(6)
    base = [rng.choice(10**6, 200, replace=False) for _ in range(6)]
    sets = {}
    for g, b in enumerate(base):
        for k in range(6):
            own = np.concatenate([b[6:], base[(g + 1) % 6][:120]]) if k % 2 else b[4:]
            sets[100 * g + k + 1] = np.sort(np.unique(np.concatenate([own, rng.choice(10**7, 4) + 10**6])).astype(np.uint64))
    ids = list(sets)
    match = jaccard.Matcher(sets.__getitem__, 90)
    match.work(ids, np.array([len(sets[i]) for i in ids]), np.zeros(len(ids), int))
    assert match.derived + match.spared > 0
    up = {i: i for i in ids}
    for a in ids:
        for b in ids:
            common = len(np.intersect1d(sets[a], sets[b]))
            if 100 * common >= 90 * (len(sets[a]) + len(sets[b]) - common):
                x, y = up[a], up[b]
                up = {k: min(x, y) if v in (x, y) else v for k, v in up.items()}
    assert all(match.joined(a, b) == (up[a] == up[b]) for a in ids for b in ids)


def test_control_characters_in_lines(spark):
    for mark in "\x1e", "\x1f", "\x85", "\x00":
        passage = "".join(f"Sentence {k} of{mark}a passage with some words. " for k in range(24))
        own = [(k, f"Own start {k} of it. {passage}Own end {k} of it.") for k in range(3)]
        got = {r.doc_id: r for r in linededup.dedup(spark, spark.createDataFrame(own, "doc_id long, text string")).collect()}
        assert got[0].n_removed == 0 and got[0].text == own[0][1]
        assert all(got[k].n_removed == 24 and got[k].text == f"Own start {k} of it. Own end {k} of it." for k in (1, 2))


def test_line_dedup_by_brute_force(spark, monkeypatch):
    """Every run of 30 words that stands elsewhere too goes, and nothing goes that stands nowhere else."""
    monkeypatch.setattr(linededup, "WORDS", 10**9)  # runs alone
    rng = random.Random(10)
    pool = [f"{k} " + " ".join(rng.choice("one two three four five six".split()) for _ in range(rng.randint(3, 12))) + rng.choice([". ", "\n", ", "]) for k in range(60)]
    own = [(k, "".join(f"own {k} {rng.random()} line. " if rng.random() < 0.2 else pool[(s + j) % 60] for j in range(rng.randint(4, 14)))) for k in range(40) for s in [rng.randrange(60)]]
    got = {r.doc_id: r for r in linededup.dedup(spark, spark.createDataFrame(own, "doc_id long, text string")).collect()}
    lines = {k: [x for x in linededup.CUT.split(t) if x] for k, t in own}
    bare = {k: [x.strip() for x in ls] for k, ls in lines.items()}
    places = collections.defaultdict(list)
    for k in sorted(bare):
        for s in range(len(bare[k])):
            e, n = s, 0
            while e < len(bare[k]) and n < linededup.RUN:
                n += len(bare[k][e].split(" "))
                e += 1
            if n >= linededup.RUN:
                places[tuple(bare[k][s:e])].append((k, s, e))
    must = {(k, j) for at in places.values() if len(at) > 1 for k, s, e in at[1:] for j in range(s, e)}
    twice = {x for x, n in collections.Counter(x for ls in bare.values() for x in ls).items() if n > 1}
    assert len(must) > 30
    for k, ls in lines.items():
        left, at, gone = got[k].text, 0, set()
        for j, x in enumerate(ls):  # what is left is a part of the lines, in order
            if left.startswith(x, at) and (k, j) not in must:
                at += len(x)
            else:
                gone.add((k, j))
        assert at == len(left) and len(gone) == got[k].n_removed, k
        assert all(bare[k][j] in twice for _, j in gone)


def text_of(rng):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(12))


def test_decontaminate_short_items_blocks_and_names(spark, monkeypatch):
    rng = random.Random(13)
    long = [text_of(rng) for _ in range(6)]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(long)] + [(50, "Yes, sir"), (51, "..."), (52, None)], "item_id long, text string")
    own = [(k, f"before {t} after") for k, t in enumerate(long)] + [(20, "he said yes sir to it"), (21, "eyes sir"), (22, "yes sirs"), (23, "YES SIR"), (24, None)]
    docs = spark.createDataFrame([(i, t, [7, 8], [9]) for i, t in own], "doc_id long, text string, items array<int>, distances array<int>")
    want = {**{k: [k] for k in range(6)}, 20: [50], 21: [], 22: [], 23: [50], 24: []}
    for block in (1 << 20, 200):
        monkeypatch.setattr(decontaminate, "BLOCK", block)
        assert {r.doc_id: r["items"] for r in decontaminate.matches(spark, docs, items).collect()} == want
    kept = decontaminate.clean(spark, docs, items).collect()
    assert sorted(r.doc_id for r in kept) == [21, 22, 24] and all((r["items"], r.distances) == ([7, 8], [9]) for r in kept)


def test_pipeline_stages_on_odd_rows(spark, docs, rows, empty):
    """Nulls, empty texts, repeated rows, clashing columns and an empty table, stage by stage."""
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
        got = stage(spark, docs, sf).collect()
        if name == "tokens":
            assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in rows)
            continue
        assert all((r.lang, r.n_lines, r.score, r["items"]) == ("en", 1, 2.0, [3]) for r in got) and len(got) <= len(rows)
        assert stage(spark, docs, sf).columns == docs.columns
        if name in ("copies", "benchmark"):
            before = collections.Counter((i, t) for i, t in rows)
            assert not collections.Counter((r.doc_id, r.text) for r in got) - before
        if name == "copies":  # one of each group, by brute force
            sets = {i: shingles(t, 5) for i, t in rows}
            group = {i: i for i in sets}
            for a in sets:
                for b in sets:
                    if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                        x, y = group[a], group[b]
                        group = {k: min(x, y) if v in (x, y) else v for k, v in group.items()}
            assert {r.doc_id for r in got} == {i for i in group if group[i] == i}
