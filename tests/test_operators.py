import glob

import duckdb
import pytest

from tracegrid.functions import scalar
from tracegrid.operators import expand, fields, grid, groups, series, signal, tokens
from tracegrid.plans import registry
from tracegrid.sources import files

DATA = "/root/testdata/sf0.001"


def stream(spark, values, name=1):
    return spark.createDataFrame([(name, i, v) for i, v in enumerate(values)], "stream long, pos long, sym int")


def by_group(df):
    out = {}
    for r in df.orderBy("sg", "gpos").collect():
        out.setdefault(r.sg, []).append(r.sym)
    return [out[k] for k in sorted(out)]


def test_fills(spark):
    t = stream(spark, [91, 91, 5, 91, 6])
    assert [r.sample for r in expand.samples(t).orderBy("idx").collect()] == [0, 0, 5, 5, 6]
    ops = expand.ops(t)
    assert [(r.kind, r.value, r.run_len) for r in ops.orderBy("op").collect()] == [("RUN91", None, 2), ("LITERAL", 5, 1), ("RUN91", None, 1), ("LITERAL", 6, 1)]
    assert expand.rebuild(ops).orderBy("idx").collect() == expand.samples(t).orderBy("idx").collect()


def test_splits(spark):
    assert by_group(groups.split(stream(spark, [251, 251, 1, 251, 2, 3, 251]))) == [[1], [2, 3]]
    pad = groups.split(stream(spark, [1, 251, 91, 91, 91, 251, 2]))
    assert by_group(groups.merge_padding(pad, 0.7)) == [[1, 91, 91, 91], [2]]
    soft = stream(spark, [1, 249, 2, 251, 3])
    assert len(by_group(groups.split(soft))) == 2 and len(by_group(groups.split(soft, (251, 249)))) == 3
    assert by_group(groups.promote(groups.split(soft, (251, 249)))) == [[1, 249, 2, 249, 3]]


def test_trace(spark):
    rows = groups.trace(stream(spark, [91, 91, 195, 1, 2, 3, 4, 5, 6, 7, 8, 9, 91])).orderBy("seg").collect()
    assert [(r.start, r.length, r.kind) for r in rows] == [(0, 2, "PAD/RLE"), (2, 8, "CTRL"), (10, 2, "DATA?"), (12, 1, "PAD/RLE")]


def shaped(size, fills, **at):
    g = [91] * fills + [7] * (size - fills)
    places = {p: s for s, ps in at.items() for p in ps}
    for p, s in places.items():
        g[p] = int(s[1:])
    return g


def test_cycle(spark):
    a = shaped(30, 0, s195=(8, 9), s63=(24,))
    b = shaped(20, 0, s210=(0,), s195=(4, 6))
    c = [91, 91, 91, 195, 249, 249, 91]
    d = shaped(70, 62, s63=(31,), s210=(34, 40), s195=(1, 3, 5, 7, 9, 11))
    e = shaped(100, 0, s63=(19, 35, 70), s195=range(1, 18, 2), s249=range(40, 56, 2))
    toks = []
    for g in (a, b, c, d, e):
        toks += [251, *g]
    typed = groups.classify(groups.features(groups.split(stream(spark, toks))))
    assert [r.type for r in typed.orderBy("sg").collect()] == list("ABCDE")
    assert [(r.cycle, r.start, r.len) for r in groups.cycles(typed).collect()] == [(0, 0, 5)]
    assert groups.extract_cycles(groups.split(stream(spark, toks)), typed).count() == len(toks) - 5
    none = groups.classify(groups.features(groups.split(stream(spark, [1, 251, 2, 251, 3]))))
    assert {r.sg for r in groups.extract_cycles(groups.split(stream(spark, [1, 251, 2, 251, 3])), none, max_groups=2).collect()} == {0, 1}


def test_stitch_ties(spark):
    s = spark.createDataFrame([("a", 0, 1), ("b", 0, 9), ("a", 1, 4), ("b", 1, 4)], "cycle string, idx long, value int")
    assert [r.value for r in series.stitch(s).orderBy("idx").collect()] == [9, 4]
    assert [r.value for r in series.stitch(s, tie="smallest").orderBy("idx").collect()] == [1, 4]


def test_short_signals(spark):
    one = spark.createDataFrame([(1, 0, 7)], "stream long, idx long, value int")
    assert [(r.lag, r.autocorr) for r in signal.autocorrelation(one).collect()] == [(0, 0.0)]
    assert signal.peaks(signal.autocorrelation(one), signal.dft(one)).count() == 0
    assert signal.histogram(one).collect()[0]["centre"] == 7.0


def test_layout_edits(spark):
    g = spark.createDataFrame([("c", r, c, v) for r in range(4) for c, v in enumerate([5, r % 2, 250 + 3 * r & 255, (250 + 3 * r) >> 8, 9])], "cycle string, row long, col long, value long")
    layout = fields.infer(g)
    assert {(r.start_col, r.kind) for r in layout.collect()} == {(0, "CONST"), (1, "FLAG"), (2, "U16_LE"), (4, "CONST")}
    edited = spark.createDataFrame([("c", 1, 1, "CONST"), ("c", 2, 1, "U16_LE"), ("c", 9, 1, "FLAG"), ("c", 0, 1, "OTHER")], "cycle string, start_col long, width long, kind string")
    assert {r.start_col: (r.valid, r.reason) for r in fields.validate(edited, g).collect()} == {1: (False, "test failed"), 2: (False, "width must be 2"), 9: (False, "out of bounds"), 0: (True, "not tested")}


def test_counts_add_up(spark):
    t = stream(spark, [1, 1, 2, 3, 3, 3, 1])
    assert tokens.ngrams(t, 2).agg({"count": "sum"}).first()[0] == 6
    assert tokens.ngrams(t, 3).agg({"count": "sum"}).first()[0] == 5
    assert sum(r.run_len * r["count"] for r in tokens.run_histogram(t).collect()) == 7


def test_series_files(spark, tmp_path):
    (tmp_path / "w.csv").write_text("﻿idx,cycle_00,cycle_01\n0,1,0x10\n1,2,\n2,junk,3\n")
    got = {(r.cycle, r.idx): r.value for r in files.read_series(spark, str(tmp_path / "w.csv")).collect()}
    assert got == {("cycle_00", 0): 1, ("cycle_00", 1): 2, ("cycle_00", 2): 0, ("cycle_01", 0): 16, ("cycle_01", 1): 3}
    (tmp_path / "t.csv").write_text("h\na,5\nb,-6,x\n")
    assert [r.sym for r in files.read_tokens(spark, str(tmp_path / "t.csv")).orderBy("line").collect()] == [5, -6]
    files.write_csv(spark.range(3), str(tmp_path / "out"))
    assert len(glob.glob(str(tmp_path / "out" / "part-*"))) > 0


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    doubles = lambda t: [r.value for r in files.read_doubles(spark, put("d.csv", t)).orderBy("idx").collect()]
    assert doubles("idx,value,x\n0,1.5,9\n1,2.75,9\n2,no,9\n3,-1e3,9\n") == [1.5, 2.75, -1000.0]
    assert doubles("0,1.5\n1,2\n") == [1.5, 2.0] and doubles("") == []
    rle = files.read_rle(spark, put("r.csv", "sym,len\n91, 3\nonly 1\nrun 7 of -2 and 5\n")).orderBy("line").collect()
    assert [(r.sym, r.run_len) for r in rle] == [(91, 3), (7, -2)]
    samples = lambda t: [r.sample for r in files.read_samples(spark, put("s.csv", t)).orderBy("idx").collect()]
    assert samples("a,b,c\n1,10,3\n2,x,3\n3,30,3\n") == [10, 30] and samples("a,b,Level\n1,10,300\n") == [300] and samples("q\n5\n") == [5]
    (tmp_path / "cycles").mkdir()
    put("cycles/cycle_07_tokens.csv", "i,t\n0,200\n1,100\n")
    assert [(r.cycle, r.pos, r.sym) for r in files.read_cycles(spark, str(tmp_path / "cycles" / "*.csv")).orderBy("pos").collect()] == [(7, 0, 200), (7, 1, 100)]
    grid_file = put("stage12_grid_cycle_03_period_003.csv", "c0,c1,c2\n1,2,0x10\n4,5,6\n")
    got = files.read_grid(spark, grid_file).orderBy("row", "col").collect()
    assert [(r.cycle, r.row, r.col, r.value) for r in got] == [("cycle_03", 0, 0, 1), ("cycle_03", 0, 1, 2), ("cycle_03", 0, 2, 16), ("cycle_03", 1, 0, 4), ("cycle_03", 1, 1, 5), ("cycle_03", 1, 2, 6)]
    layout = files.read_layout(spark, put("l.csv", "cycle,startCol,widthCols,kind,valid,reason,notes\nc,3,2,U16_LE,true,ok,\nc,5,1,CONST,False,no,\n"))
    assert [(r.start_col, r.width, r.valid) for r in layout.orderBy("start_col").collect()] == [(3, 2, True), (5, 1, False)]
    assert sorted(r.level for r in files.read_levels(spark, put("v.csv", "idx,level\n0,4\n1,4\n2,9\n")).collect()) == [4, 9]
    assert files.best_period(spark, put("b.txt", "seriesLen=9\nBEST=period=39 score=1\nperiod=4\n")).first().period == 39
    assert files.period_of_names(spark, str(tmp_path / "*_period_*.csv")).first().period == 3
    for text, want in (("idx,value\n1,5\n0,4\n", [("series", 0, 4), ("series", 1, 5)]), ("cycle,idx,value\nb,1,8\nb,0,7\na,4,1\n", [("a", 0, 1), ("b", 0, 7), ("b", 1, 8)])):
        assert sorted((r.cycle, r.idx, r.value) for r in files.read_series(spark, put("f.csv", text)).collect()) == want


def test_empty_series(spark):
    none = spark.createDataFrame([], "stream long, idx long, value int")
    assert [f(none).count() for f in (signal.histogram, signal.autocorrelation, signal.dft)] == [0, 0, 0]
    assert signal.peaks(signal.autocorrelation(none), signal.dft(none)).count() == 0


def test_candidates_in_order(spark):
    s = spark.createDataFrame([("a", i, 1) for i in range(12)], "cycle string, idx long, value int")
    got = [r.period for r in grid.candidates(s, first=(4,), extra=(6, 5, 9), remainder=True).orderBy("ord").collect()]
    assert got == [4, 2, 3, 6, 12, 5, 9]


def test_next_offsets(spark):
    values = [8192 * k for k in (5, 1, 9, 9, 700, 40, 41)] + [None]
    got = scalar.next_offsets(spark.createDataFrame([(v,) for v in values], "off long"), "off").orderBy("off").collect()
    own = sorted(set(values) - {None})
    assert [(r.off, r.next_off) for r in got] == list(zip(own, [*own[1:], None]))


def test_export_prefers_the_series(spark):
    rows = spark.createDataFrame([("a", 0, "x", 1), ("a", 0, "y", 2), ("a", 1, "x", 3)], "cycle string, row long, field string, value long")
    wide, n = fields.final_export(rows)
    assert wide.columns == ["cycle", "x", "y"] and n.first() == (2, 3)
    wide, n = fields.final_export(rows, rows.filter("field = 'y'"))
    assert wide.columns == ["y"] and n.first() == (1, 1)
    wide, n = fields.final_export(rows.limit(0))
    assert wide.columns == ["idx"] and n.first() == (0, 1)


def sql_tables(con):
    for t in ("events", "lineitem", "part", "orders", "customer", "nation"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")


@pytest.mark.parametrize("name", [
    "trigrams", "classify_groups", "promote_groups", "autocorr", "dft_export", "peaks", "period_scores", "records", "merge_padding_85", "cycles_typed", "cycle_extract_typed", "stage_compare", "validate_edited", "reverse_bits", "first_int",
    "segment_tag", "lens_in_range", "dense_without_fill", "dense_diagnostics", "code_length_hist", "header_checks", "record_checks", "group_schema", "final_export_counts", "decode_msb", "decode_lsb", "divisors",
    "period_candidates", "token_counts", "resolved_period", "manifest",
])
def test_sql(spark, name):
    con = duckdb.connect()
    sql_tables(con)
    ours = registry.queries()[name](spark, DATA).toPandas()
    theirs = con.execute(registry.oracle_sql()[name]).df()
    cols = sorted(ours.columns)
    assert cols == sorted(theirs.columns)
    assert sorted(map(str, ours[cols].astype(str).values.tolist())) == sorted(map(str, theirs[cols].astype(str).values.tolist()))


def test_divisors_of_the_whole_table(spark):
    data = DATA.replace("0.001", "0.1")
    rows = registry.queries()["divisors"](spark, data).collect()
    keys = [r.p_partkey for r in spark.read.parquet(f"{data}/part.parquet").select("p_partkey").collect()]
    found = {n: [] for n in range(max(keys) + 1)}
    for d in range(2, max(keys) + 1):
        for n in range(d, max(keys) + 1, d):
            found[n].append(d)
    assert sorted((r.p_partkey, r.divisors) for r in rows) == sorted((n, ",".join(map(str, found[n]))) for n in keys)
    assert len(rows) > 501


@pytest.mark.parametrize("name", ["decode_lsb", "decode_msb"])
def test_keys_over_32_bits(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT unnest([0, 1, 542362, 542363, 1199999, {2**40}, -1])::BIGINT AS p_partkey) TO '{tmp_path}/part.parquet'")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    ours = sorted(map(tuple, registry.queries()[name](spark, str(tmp_path)).collect()))
    assert ours == sorted(con.execute(registry.oracle_sql()[name]).fetchall())


def test_schema_shares_that_are_ties(spark, tmp_path):
    con = duckdb.connect()  # a stream's size and its fills; 1/32 and 9/32 end in a five at the fifth digit, 1/160 does so only in decimal
    shapes = [(32, f) for f in range(33)] + [(160, f) for f in range(1, 160, 2)]
    con.execute("CREATE TABLE shape AS SELECT unnest(?) AS s", [[{"u": i, "n": n, "f": f} for i, (n, f) in enumerate(shapes)]])
    con.execute(f"""COPY (SELECT row_number() OVER () AS event_id, TIMESTAMP '2024-01-01' + to_seconds(k) AS ts, s.u::BIGINT AS user_id,
      CASE WHEN k < s.f THEN 'view' ELSE 'purchase' END AS event_type, 50.0::DOUBLE AS value FROM shape, range(160) r(k) WHERE k < s.n) TO '{tmp_path}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    ours = sorted(map(tuple, registry.queries()["group_schema"](spark, str(tmp_path)).collect()))
    assert ours == sorted(con.execute(registry.oracle_sql()["group_schema"]).fetchall())
    assert len(ours) == len(shapes) and sum('"fillPct":"0.2812"' in json for _, json in ours) > 0
