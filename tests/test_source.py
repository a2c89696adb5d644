import json
import struct

import pytest
from gridfile import write
from pyspark.sql import functions as F

from tracegrid.functions import huffman
from tracegrid.operators import grid, quality
from tracegrid.plans.analyze import analyze, decoded, run
from tracegrid.sources import files, layout, legacy, segment_grid


@pytest.mark.parametrize(("little", "lead", "shape", "empty"), [(False, 0, ((0, 1), (0, 0), (0, 1)), (1,)), (True, 8, ((0, 0), (2, 3), (5, 5)), ())])
def test_round_trip(spark, tmp_path, little, lead, shape, empty):
    path = str(tmp_path / "grid.dat")
    truth = write(path, little, shape, empty, lead)
    h = segment_grid.load(spark, path, "header").first()
    assert h.little == little and h.score == 16 and h.ot_base == 1024 + lead
    segments = segment_grid.load(spark, path).collect()
    assert {(r.s1, r.s2, r.s3) for r in segments} == set(truth)
    tables, assembled, tok, _ = decoded(spark, path)
    got = {}
    for r in tok.orderBy("stream", "pos").collect():
        got.setdefault(r.stream, []).append(r.sym)
    assert got == {"seg_%02d_%02d_%02d" % c: t for c, t in truth.items()}
    row = tables.first()
    assert (row.table.base, row.table.n, row.table.payload_start, row.table.total_bits) == (960, 40, 1024, 60000)
    assert all(r.ok for r in quality.record_checks(tables).collect())
    assert all(r.ok for r in quality.assembly_checks(assembled).collect())
    assert quality.header_checks(segment_grid.load(spark, path, "header")).first()[1:] == (True, False)


def test_extents_and_cut_records(spark, tmp_path):
    path = tmp_path / "grid.dat"
    truth = write(str(path), shape=((0, 0), (0, 0), (0, 1)))
    raw = path.read_bytes()
    path.write_bytes(raw[:20000])
    (tmp_path / "grid00001.dat").write_bytes(raw[20000:])
    assert layout.Extents(str(path)).read(19990, 20) == raw[19990:20010]
    assert segment_grid.load(spark, str(path), "header").first().extents == 2
    assert decoded(spark, str(path))[2].count() == sum(map(len, truth.values()))
    write(str(tmp_path / "cut.dat"), shape=((0, 0), (0, 0), (0, 0)), cut=8192 + 100)
    rows = huffman.search(segment_grid.load(spark, str(tmp_path / "cut.dat"), "records")).collect()
    assert [r.error for r in rows] == ["no prefix-code table"]


def test_bad_files(tmp_path):
    (tmp_path / "small").write_bytes(b"x" * 10)
    with pytest.raises(ValueError):
        layout.Extents(str(tmp_path / "small"))
    (tmp_path / "zero").write_bytes(bytes(4096))
    with pytest.raises(ValueError):
        layout.read_header(layout.Extents(str(tmp_path / "zero")))


def test_codes_agree_only_when_symbols_ascend():
    assert huffman.codes([1, 2, 3], [1, 2, 2]) == huffman.codes([1, 2, 3], [1, 2, 2], by_symbol=True)
    assert huffman.codes([3, 2, 1], [2, 2, 1]) != huffman.codes([3, 2, 1], [2, 2, 1], by_symbol=True)


def test_run_writes_everything(spark, tmp_path):
    path, base = str(tmp_path / "grid.dat"), str(tmp_path / "out")
    truth = write(path, shape=((0, 1), (0, 0), (0, 0)))
    doc = json.loads(run(spark, path, base).first().json)
    assert doc["baseDir"] == base and doc["bestPeriod"] is not None or "bestPeriod" not in doc
    assert set(doc["outputs"]) >= {"hist", "stage4_schema", "stage5_meta", "stage7_ops", "stage9_series", "stage10_mapped", "stage11_summary", "stage12_colstats", "stage14_layout_final", "stage15_records", "stage16_final"}
    assert doc["finalCsv"] == f"{base}/stage16_final" and any("[seg_" in x for x in doc["layoutFinalTxt"])
    final = spark.read.csv(f"{base}/stage16_final", header=True)
    counts = spark.read.csv(f"{base}/stage16_counts", header=True).first()
    assert (int(counts.rows), int(counts.cols)) == (final.count(), len(final.columns)) and counts.rows != "0"
    layout = files.read_layout(spark, f"{base}/stage14_layout_final", only_valid=True)
    assert layout.count() > 0 and {"cycle", "start_col", "width", "kind", "valid", "reason"} == set(layout.columns)
    schema = json.loads(spark.read.text(f"{base}/stage4_schema").first().value)
    assert schema["huffman"] == {"N": 40, "payloadStartByte": 1024, "totalBits": 60000} and schema["superGroups"][0]["index"] == 0 and len(schema["superGroups"][0]["top"]) <= 8
    assert json.loads(spark.read.text(f"{base}/stage5_meta").first().value)["bits"] == "LSB"
    assert files.read_samples(spark, f"{base}/stage7_samples").count() == sum(map(len, truth.values()))


def test_period_is_resolved(spark):
    of = lambda n: spark.createDataFrame([("a", i, 1) for i in range(n)], "cycle string, idx long, value int")
    none = spark.createDataFrame([], "period long, total double")
    assert [grid.resolve(none, of(n)).first().period for n in (234, 39 * 5, 52, 14, 13, 7)] == [78, 39, 26, 14, 13, 7]
    assert grid.resolve(none, of(1)).count() == 0
    assert grid.resolve(spark.createDataFrame([(5, 1.0)], "period long, total double"), of(78)).first().period == 5


def test_probe_and_pushed_bounds(spark, tmp_path):
    path = str(tmp_path / "grid.dat")
    write(path, shape=((0, 1), (0, 0), (0, 5)), empty=(2, 3, 4, 5, 6, 7))  # third axis 1 to 3 is empty
    found = lambda **o: sorted((r.s1, r.s2, r.s3) for r in segment_grid.load(spark, path, **o).collect())
    assert found() == [(0, 0, 0), (0, 0, 4), (0, 0, 5), (1, 0, 0), (1, 0, 4), (1, 0, 5)]
    assert found(stop_after_empty="2,3,3") == [(0, 0, 0), (1, 0, 0)]
    assert found(stop_after_empty="2,3,4") == found()
    some = segment_grid.load(spark, path).filter("s1 = 1 and s3 >= 4 and s3 < 5")
    assert [(r.s1, r.s3) for r in some.collect()] == [(1, 4)]
    assert segment_grid.first_segment(segment_grid.load(spark, path)).first().idx == 0
    reader = segment_grid.Reader({"path": path})
    list(reader.pushFilters([segment_grid.EqualTo(("s1",), 1), segment_grid.GreaterThan(("s3",), 3)]))
    assert [r[1:4] for p in reader.partitions() for r in reader.read(p)] == [(1, 0, 4), (1, 0, 5)]
    assert segment_grid.load(spark, path, "header").first().magic_little is False


def test_verdict(spark, tmp_path):
    path = str(tmp_path / "grid.dat")
    write(path, shape=((0, 0), (0, 0), (0, 1)), empty=(0,))
    tables, assembled, _, _ = decoded(spark, path)
    row = quality.verdict(segment_grid.load(spark, path, "header"), tables, assembled).first()
    assert (row.segment, row.ok) == ("seg_00_00_01", True)
    bad = quality.verdict(segment_grid.load(spark, path, "header"), tables.filter("false"), assembled).first()
    assert bad.ok is False


def test_decoder_options(spark):
    rows = spark.createDataFrame([(1, b"\x1b", [700, 5, 9, 2], [2, 2, 2, 2], 8)], "stream long, data binary, symbols array<int>, lens array<int>, bits long")
    one = lambda **o: huffman.decode_with(rows, **o).first()
    assert one().tokens == [700, 5, 9, 2] and one().last_length == 2
    assert one(by_symbol=True).tokens == [2, 5, 9, 700]
    assert one(inverted=True).tokens == [2, 9, 5, 700]
    assert one(lsb=True, reverse=True).tokens == [2, 9, 5, 700]
    assert one(shift=2, limit=2).tokens == [5, 9]
    odd = rows.withColumn("lens", F.array(*map(F.lit, (1, 2, 0, 0))))
    assert huffman.decode_with(odd).first().tokens == [700, 700, 700]
    with pytest.raises(Exception, match="no code"):
        huffman.decode_with(odd, strict=True).collect()


def test_legacy_views(spark):
    head = struct.pack("<6if12i", *range(6), 1.5, *range(12)) + struct.pack("<512d", *range(512))
    meta = struct.pack("<2f128H", 0.5, 2.5, *range(128))
    code = struct.pack("<H", 2) + bytes([3, 4, 65, 66])
    rows = spark.createDataFrame([(1, head, True), (2, meta, True), (3, code, True), (4, None, True), (5, struct.pack(">H", 1) + b"\x01\x07", False)], "id int, raw binary, little boolean")
    got = {r.id: r for r in legacy.legacy_views(rows).collect()}
    assert got[1].data_header.null_value == 1.5 and got[1].data_header.amax_3 == 11 and got[1].data_header.metered[255] == 511.0
    assert got[2].data_header is None and got[2].segment_metadata.quantized_deltas[:2] == [0, 1] and got[2].segment_metadata.block_sizes_bits[-1] == 127 and got[2].segment_metadata.max_delta == 2.5
    assert (got[3].code_prelude.code_lengths, got[3].code_prelude.symbols, got[3].code_prelude.byte_size) == ([3, 4], [65, 66], 6)
    assert got[4].code_prelude is None and got[5].code_prelude.symbols == [7]


def test_analyze_runs_to_records(spark, tmp_path):
    path = str(tmp_path / "grid.dat")
    truth = write(path, shape=((0, 0), (0, 0), (0, 0)))
    out = analyze(spark, path, period=78)
    (tokens,) = truth.values()
    assert out["samples"].count() == out["tokens"].count() == len(tokens)
    assert out["histogram"].agg({"count": "sum"}).first()[0] == len(tokens)
    assert out["records"].count() > 0 and out["best_period"].count() <= 1
