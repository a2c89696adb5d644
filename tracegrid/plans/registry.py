"""Registered queries of the engine's operators, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from ..functions import huffman, scalar
from ..operators import expand, fields, grid, groups, quality, series, signal, tokens
from ..sources import sinks
from .views import CYCLES, TOK, USR, cycles_of_types, ser, ser_sql, table, tok, usr, usr_cycles

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir)."""

    def put(f: Callable) -> Callable:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return put


def queries() -> dict[str, Callable]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def over(view: Callable, f: Callable) -> Callable:
    return lambda spark, sf_dir: f(view(spark, sf_dir))


# ---------------------------------------------------------------- tokens

W = "OVER (PARTITION BY stream ORDER BY pos)"
RUNS = f"""{TOK}, chg AS (SELECT *, CASE WHEN lag(sym) {W} = sym THEN 0 ELSE 1 END AS c FROM tok),
isl AS (SELECT *, sum(c) {W} - 1 AS run FROM chg),
runs AS (SELECT stream, CAST(run AS BIGINT) AS run, sym, min(pos) AS start, count(*) AS run_len FROM isl GROUP BY ALL)"""
BI = f"{TOK}, bi AS (SELECT stream, a, b, count(*) AS count FROM (SELECT stream, sym AS a, lead(sym) {W} AS b FROM tok) WHERE b IS NOT NULL GROUP BY ALL)"
TRI = f"{TOK}, tri AS (SELECT stream, a, b, c, count(*) AS count FROM (SELECT stream, sym AS a, lead(sym) {W} AS b, lead(sym, 2) {W} AS c FROM tok) WHERE c IS NOT NULL GROUP BY ALL)"
RUNH = f"{RUNS}, rh AS (SELECT stream, sym, run_len, count(*) AS count FROM runs GROUP BY ALL)"


def ranked(part: str, order: str, source: str, k: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY {order}) AS rank FROM {source}) WHERE rank <= {k}"


query("sym_hist", f"WITH {TOK} SELECT stream, sym, count(*) AS count FROM tok GROUP BY ALL")(over(tok, tokens.histogram))
query("bigrams", f"WITH {BI} SELECT * FROM bi")(over(tok, lambda t: tokens.ngrams(t, 2)))
query("trigrams", f"WITH {TRI} SELECT * FROM tri")(over(tok, lambda t: tokens.ngrams(t, 3)))
query("topk_ngrams", f"WITH {TRI} " + ranked("stream", "count DESC, a, b, c", "tri", 8))(over(tok, lambda t: tokens.top_ngrams(t, 3, 8)))
query("run_hist", f"WITH {RUNH} SELECT * FROM rh")(over(tok, tokens.run_histogram))
query("rle", f"WITH {RUNS} SELECT * FROM runs")(over(tok, tokens.runs))
query("best_fill_run", f"WITH {RUNS} SELECT stream, CAST(coalesce(max(run_len) FILTER (WHERE sym = 91), 0) AS BIGINT) AS best_run FROM runs GROUP BY stream")(over(tok, tokens.best_run))
query("rare_positions", f"WITH {TOK} SELECT * FROM (SELECT stream, sym, pos, row_number() OVER (PARTITION BY stream, sym ORDER BY pos) AS rank FROM tok WHERE sym IN (63,95,195,210,249,251)) WHERE rank <= 64")(over(tok, tokens.rare_positions))
query("positions_by_sym", f"WITH {TOK} SELECT stream, sym, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS positions FROM tok GROUP BY ALL")(over(tok, tokens.positions))
query("transitions_topk", f"WITH {BI} " + ranked("stream, a", "count DESC, b", "bi", 3))(over(tok, lambda t: tokens.transitions(t, 3)))
query("runs_topk", f"WITH {RUNH} " + ranked("stream, sym", "count DESC, run_len", "rh", 3))(over(tok, lambda t: tokens.top_runs(t, 3)))
query("hist_topk", f"WITH {TOK}, h AS (SELECT stream, sym, count(*) AS count FROM tok GROUP BY ALL) " + ranked("stream", "count DESC, sym", "h", 3))(over(tok, lambda t: tokens.top_histogram(t, 3)))
query("token_heuristics", f"""WITH {TOK} SELECT stream, count(*) AS tokens, count(DISTINCT sym) AS distinct_syms, count(*) FILTER (WHERE sym = 91) AS fills,
  count(*) FILTER (WHERE sym = 195) AS controls, round(count(*) * 8.0::DOUBLE / count(DISTINCT sym), 6) AS bits_per_distinct FROM tok GROUP BY stream""")(over(tok, tokens.heuristics))
query("token_sample", f"WITH {TOK} SELECT stream, pos, sym FROM (SELECT *, row_number() {W} AS r FROM tok) WHERE r <= 16")(over(tok, lambda t: tokens.sample(t, 16)))

# ---------------------------------------------------------------- groups


def split_sql(separators: str, name: str = "g") -> str:
    return f"""cut_{name} AS (SELECT *, sum(CASE WHEN sym IN ({separators}) THEN 1 ELSE 0 END) {W} AS n FROM tok),
{name} AS (SELECT stream, sg, row_number() OVER (PARTITION BY stream, sg ORDER BY pos) - 1 AS gpos, pos, sym FROM (
  SELECT stream, dense_rank() OVER (PARTITION BY stream ORDER BY n) - 1 AS sg, pos, sym FROM cut_{name} WHERE sym NOT IN ({separators})))"""


def merge_sql(threshold: float, name: str = "m") -> str:
    return f"""{TOK}, {split_sql('251')}, den AS (SELECT stream, sg, avg(CASE WHEN sym = 91 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS density FROM g GROUP BY ALL),
tgt AS (SELECT stream, sg, sum(CASE WHEN sg = 0 OR density < {threshold}::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY sg) - 1 AS t FROM den),
{name} AS (SELECT stream, CAST(t AS BIGINT) AS sg, row_number() OVER (PARTITION BY stream, t ORDER BY pos) - 1 AS gpos, pos, sym FROM g JOIN tgt USING (stream, sg))"""


FEAT = """fr AS (SELECT *, sum(c) OVER (PARTITION BY stream, sg ORDER BY gpos) AS run FROM (SELECT *, CASE WHEN lag(sym) OVER (PARTITION BY stream, sg ORDER BY gpos) = sym THEN 0 ELSE 1 END AS c FROM m)),
fl AS (SELECT *, count(*) OVER (PARTITION BY stream, sg, run) AS len FROM fr),
f AS (SELECT stream, sg, count(*) AS size, avg(CASE WHEN sym = 91 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS density,
  CAST(coalesce(max(len) FILTER (WHERE sym = 91), 0) AS BIGINT) AS best_run, coalesce(max(len) FILTER (WHERE sym = 195) >= 2, false) AS pair,
  count(*) FILTER (WHERE sym = 249) AS soft, coalesce(list(gpos ORDER BY gpos) FILTER (WHERE sym = 63), []) AS at_param, coalesce(list(gpos ORDER BY gpos) FILTER (WHERE sym = 195), []) AS at_control,
  coalesce(list(gpos ORDER BY gpos) FILTER (WHERE sym = 210), []) AS at_mark, coalesce(list(gpos ORDER BY gpos) FILTER (WHERE sym = 61), []) AS at_rare FROM fl GROUP BY stream, sg)"""
TYPED = """ty AS (SELECT *, CASE
  WHEN sg = 0 AND len(at_mark) = 1 AND len(at_control) >= 2 AND density >= 0.7::DOUBLE THEN 'P'
  WHEN size BETWEEN 28 AND 38 AND pair AND list_contains(at_param, 24) AND list_contains(at_control, 8) AND list_contains(at_control, 9) THEN 'A'
  WHEN size BETWEEN 18 AND 24 AND list_contains(at_mark, 0) AND list_contains(at_control, 4) AND list_contains(at_control, 6) THEN 'B'
  WHEN size BETWEEN 6 AND 8 AND list_contains(at_control, 3) AND soft >= 2 AND density BETWEEN 0.45::DOUBLE AND 0.75::DOUBLE THEN 'C'
  WHEN size BETWEEN 65 AND 85 AND density BETWEEN 0.65::DOUBLE AND 0.8::DOUBLE AND list_contains(at_param, 31) AND list_contains(at_mark, 34) AND list_contains(at_mark, 40) AND len(at_control) >= 6 THEN 'D'
  WHEN size BETWEEN 90 AND 110 AND list_contains(at_param, 19) AND list_contains(at_param, 35) AND list_contains(at_param, 70) AND len(at_control) >= 9 AND soft >= 8 THEN 'E'
  WHEN sg >= count(*) OVER (PARTITION BY stream) - 3 AND len(at_mark) = 0 AND len(at_control) >= 3 THEN 'T'
  WHEN density >= 0.7::DOUBLE AND best_run >= 3 THEN 'D?' ELSE 'M' END AS type FROM f)"""
M70, M85 = merge_sql(0.7), merge_sql(0.85)
TRACE = f"""{TOK}, ti AS (SELECT *, sum(c) {W} AS i FROM (SELECT *, CASE WHEN lag(sym = 91) {W} = (sym = 91) THEN 0 ELSE 1 END AS c FROM tok)),
tc AS (SELECT *, CASE WHEN sym = 91 THEN 0 ELSE (pos - min(pos) OVER (PARTITION BY stream, i)) // 8 END AS ch FROM ti)"""


def merged(threshold: float):
    return lambda t: groups.merge_padding(groups.split(t), threshold)


def typed(t):
    return groups.classify(groups.features(merged(0.85)(t)))


query("split_strong", f"WITH {TOK}, {split_sql('251')} SELECT * FROM g")(over(tok, groups.split))
query("split_any", f"WITH {TOK}, {split_sql('251, 249')} SELECT * FROM g")(over(tok, lambda t: groups.split(t, (251, 249))))
query("promote_groups", f"""WITH {TOK}, {split_sql('251, 249')}, lg AS (SELECT *, lag(sym) OVER (PARTITION BY stream, sg ORDER BY gpos) AS p FROM g),
fa AS (SELECT stream, sg, count(*) AS size, coalesce(bool_or(sym = 195 AND p = 195), false) AS pair, bool_or(sym = 63) AS param FROM lg GROUP BY ALL),
tt AS (SELECT stream, sg, coalesce(sum(CASE WHEN (pair AND size <= 16) OR param THEN 1 ELSE 0 END) OVER (PARTITION BY stream ORDER BY sg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS t FROM fa),
ti AS (SELECT *, coalesce(lag(t) OVER (PARTITION BY stream ORDER BY sg) = t, false) AS inside FROM tt),
al AS (SELECT stream, sg, gpos, sym, t FROM g JOIN ti USING (stream, sg) UNION ALL SELECT stream, sg, -1, 249, t FROM ti WHERE inside)
SELECT stream, CAST(t AS BIGINT) AS sg, row_number() OVER (PARTITION BY stream, t ORDER BY sg, gpos) - 1 AS gpos, CAST(sym AS INTEGER) AS sym FROM al""")(over(tok, lambda t: groups.promote(groups.split(t, (251, 249)))))
query("merge_padding_70", f"WITH {M70} SELECT * FROM m")(over(tok, merged(0.7)))
query("merge_padding_85", f"WITH {M85} SELECT * FROM m")(over(tok, merged(0.85)))
_LISTS = ", ".join(f"array_to_string({c}, ',') AS {c}" for c in ("at_param", "at_control", "at_mark", "at_rare"))
query("group_features", f"WITH {M70}, {FEAT} SELECT stream, sg, size, round(density, 6) AS density, best_run, pair, soft, {_LISTS} FROM f")(
    over(tok, lambda t: groups.written(groups.features(merged(0.7)(t))).withColumn("density", F.round("density", 6)))
)
query("classify_groups", f"WITH {M85}, {FEAT}, {TYPED} SELECT stream, sg, size, type FROM ty")(over(tok, lambda t: typed(t).select("stream", "sg", "size", "type")))
query("classify_super", f"""WITH {M70}, {FEAT} SELECT stream, sg, CASE WHEN len(at_param) > 0 AND density < 0.5::DOUBLE THEN 'header/meta' WHEN pair THEN 'control'
  WHEN density >= 0.7::DOUBLE AND best_run >= 3 THEN 'padding/RLE' WHEN soft >= 2 AND density < 0.8::DOUBLE THEN 'composite' ELSE 'mixed' END AS kind FROM f""")(
    over(tok, lambda t: groups.classify_super(groups.features(merged(0.7)(t))).select("stream", "sg", "kind"))
)
_CYC = "WINDOW w AS (PARTITION BY stream ORDER BY sg)"
query("cycles", f"""WITH {M85}, {FEAT}, {TYPED}, hit AS (SELECT stream, sg, type = 'M' AND lead(type) OVER w = 'M' AND lead(type, 2) OVER w = 'D?' AS h FROM ty {_CYC})
SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY sg) - 1 AS cycle, sg AS start, CAST(3 AS BIGINT) AS len FROM hit WHERE h""")(
    over(tok, lambda t: groups.cycles(typed(t), ["M", "M", "D?"]))
)
query("cycle_extract", f"""WITH {M85}, {FEAT}, {TYPED}, w5 AS (SELECT stream, coalesce(min(sg) FILTER (WHERE type = 'A'), 0) AS start FROM ty GROUP BY stream)
SELECT stream, CAST(0 AS BIGINT) AS cycle, sg, type, gpos, sym FROM m JOIN w5 USING (stream) JOIN (SELECT stream, sg, type FROM ty) USING (stream, sg) WHERE sg >= start AND sg < start + 5""")(
    over(tok, lambda t: groups.extract_cycles(merged(0.85)(t), typed(t)))
)
TYPES = f"{CYCLES}, {split_sql('251')}, m AS (SELECT * FROM g), {FEAT}, {TYPED}"
query("cycles_typed", f"""WITH {TYPES}, hit AS (SELECT stream, sg, type = 'A' AND lead(type) OVER w = 'B' AND lead(type, 2) OVER w = 'C' AND lead(type, 3) OVER w = 'D' AND lead(type, 4) OVER w = 'E' AS h FROM ty {_CYC})
SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY sg) - 1 AS cycle, sg AS start, CAST(5 AS BIGINT) AS len FROM hit WHERE h""")(
    over(cycles_of_types, lambda t: groups.cycles(groups.classify(groups.features(groups.split(t)))))
)
query("cycle_extract_typed", f"""WITH {TYPES}, hit AS (SELECT stream, sg, type = 'A' AND lead(type) OVER w = 'B' AND lead(type, 2) OVER w = 'C' AND lead(type, 3) OVER w = 'D' AND lead(type, 4) OVER w = 'E' AS h FROM ty {_CYC}),
cy AS (SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY sg) - 1 AS cycle, sg AS start FROM hit WHERE h),
sp AS (SELECT * FROM cy UNION ALL SELECT stream, 0, coalesce(min(sg) FILTER (WHERE type = 'A'), 0) FROM ty WHERE stream NOT IN (SELECT stream FROM cy) GROUP BY stream)
SELECT stream, cycle, sg, type, gpos, sym FROM m JOIN sp USING (stream) JOIN (SELECT stream, sg, type FROM ty) USING (stream, sg) WHERE sg >= start AND sg < start + 5""")(
    over(cycles_of_types, lambda t: groups.extract_cycles(groups.split(t), groups.classify(groups.features(groups.split(t)))))
)
query("dense_without_fill", f"WITH {TOK}, {split_sql('251')} SELECT stream, max(sg) = 0 AND NOT bool_or(sym IN (63,195,210,249)) AS dense FROM g GROUP BY stream")(over(tok, lambda t: groups.dense_streams(groups.split(t), (63, 195, 210, 249))))
_DENSE = "td AS (SELECT stream, pos, CASE WHEN sym IN (63, 249) AND stream % 2 = 0 THEN 61 ELSE sym END AS sym FROM tok), dn AS (SELECT stream FROM td GROUP BY stream HAVING NOT bool_or(sym IN (63, 249))), tok2 AS (SELECT * FROM td WHERE stream IN (SELECT stream FROM dn))"
_D1 = ranked("stream", "count DESC, sym", "(SELECT stream, sym, count(*) AS count FROM tok2 GROUP BY ALL)", 12)
_D2 = ranked("stream", "count DESC, a, b", f"(SELECT stream, a, b, count(*) AS count FROM (SELECT stream, sym AS a, lead(sym) {W} AS b FROM tok2) WHERE b IS NOT NULL GROUP BY ALL)", 8)
_D3 = ranked("stream", "count DESC, a, b, c", f"(SELECT stream, a, b, c, count(*) AS count FROM (SELECT stream, sym AS a, lead(sym) {W} AS b, lead(sym, 2) {W} AS c FROM tok2) WHERE c IS NOT NULL GROUP BY ALL)", 8)
query("dense_diagnostics", f"""WITH {TOK.replace('251 ELSE', '210 ELSE')}, {_DENSE} SELECT stream, 'symbol' AS kind, rank, CAST(sym AS VARCHAR) AS item, count FROM ({_D1})
UNION ALL SELECT stream, 'pair', rank, a || ' ' || b, count FROM ({_D2}) UNION ALL SELECT stream, 'triple', rank, a || ' ' || b || ' ' || c, count FROM ({_D3})""")(
    over(tok, lambda t: groups.dense_diagnostics(t.withColumn("sym", F.when(F.col("sym") == 251, 210).when(F.col("sym").isin(63, 249) & (F.col("stream") % 2 == 0), 61).otherwise(F.col("sym"))), (63, 249)))
)
_JSON = "array_to_string(list_transform({0}, lambda x: CAST(x AS VARCHAR)), ',')"
query("group_schema", f"""WITH {M85}, {FEAT}, {TYPED}, tc AS ({ranked("stream, sg", "count DESC, sym", "(SELECT stream, sg, sym, count(*) AS count FROM m GROUP BY ALL)", 12)}),
tj AS (SELECT stream, sg, string_agg(printf('{{"sym":%d,"count":%d}}', sym, count), ',' ORDER BY rank) FILTER (WHERE rank <= 8) AS top, string_agg(printf('{{"sym":%d,"count":%d}}', sym, count), ',' ORDER BY rank) AS wide FROM tc GROUP BY ALL),
hit AS (SELECT stream, sg, type = 'M' AND lead(type) OVER w = 'M' AND lead(type, 2) OVER w = 'D?' AS h FROM ty {_CYC}),
cj AS (SELECT stream, string_agg(printf('{{"start":%d,"len":3}}', sg), ',' ORDER BY sg) FILTER (WHERE h) AS cycles FROM hit GROUP BY stream),
gj AS (SELECT stream, string_agg('{{"index":' || sg || ',"type":"' || type || '","size":' || size || ',"fillPct":"' || printf('%.4f', density) || '","bestRun91":' || best_run || ',"pos63":[' || {_JSON.format('at_param')} || '],"pos195":[' || {_JSON.format('at_control')} ||
  '],"pos210":[' || {_JSON.format('at_mark')} || '],"pos61":[' || {_JSON.format('at_rare')} || '],"count249":' || soft || ',"has195Pair":' || pair || ',"top":[' || top || ']}}', ',' ORDER BY sg) AS groups,
  count(*) = 1 AND bool_and(len(at_param) + len(at_control) + len(at_mark) + soft = 0) AS dense, first(wide) AS wide, sum(size) AS n FROM ty JOIN tj USING (stream, sg) GROUP BY stream)
SELECT stream, '{{' || CASE WHEN dense THEN '"denseSummary":{{"topSymbols":[' || wide || '],"countSymbols":' || n || '}},' ELSE '' END || '"superGroups":[' || groups || '],"cycles":[' || coalesce(cycles, '') || ']}}' AS json FROM gj JOIN cj USING (stream)""")(
    over(tok, lambda t: sinks.group_schema(ty := typed(t), groups.cycles(ty, ["M", "M", "D?"]), merged(0.85)(t), half_even=True))
)
query("group_topk", f"WITH {M85}, c AS (SELECT stream, sg, sym, count(*) AS count FROM m GROUP BY ALL) " + ranked("stream, sg", "count DESC, sym", "c", 6))(over(tok, lambda t: groups.top_symbols(merged(0.85)(t), 6)))
query("group_size_summary", f"""WITH {M70}, s AS (SELECT stream, sg, count(*) AS size FROM m GROUP BY ALL)
SELECT stream, count(*) AS groups, min(size) AS min_size, quantile_cont(size, 0.5) AS median_size, round(avg(size), 6) AS mean_size, max(size) AS max_size FROM s GROUP BY stream""")(over(tok, lambda t: groups.size_summary(merged(0.7)(t))))
query("dense_streams", f"WITH {TOK}, {split_sql('251')} SELECT stream, max(sg) = 0 AND NOT bool_or(sym IN (63,91,195,210,249,251)) AS dense FROM g GROUP BY stream")(over(tok, lambda t: groups.dense_streams(groups.split(t))))
query("proto_trace", f"""WITH {TRACE}, tp AS (SELECT stream, i, ch, min(pos) AS start, count(*) AS length, arg_min(sym, pos) AS first, count(*) FILTER (WHERE sym IN (195,249,63,210,61)) AS markers,
  array_to_string(list_slice(list(sym ORDER BY pos), 1, 8), ' ') AS preview FROM tc GROUP BY ALL)
SELECT stream, row_number() OVER (PARTITION BY stream ORDER BY start) - 1 AS seg, start, length,
  CASE WHEN first = 91 THEN 'PAD/RLE' WHEN first IN (195,249,63,210,61) THEN 'CTRL' ELSE 'DATA?' END AS kind, preview, markers FROM tp""")(over(tok, groups.trace))
query("proto_trace_totals", f"WITH {TOK} SELECT stream, count(*) FILTER (WHERE sym = 91) AS samples, count(*) FILTER (WHERE sym IN (195,249,63,210,61)) AS markers FROM tok GROUP BY stream")(over(tok, groups.trace_totals))

# ---------------------------------------------------------------- operations and samples

OPS = f"""{TOK}, oi AS (SELECT *, sum(CASE WHEN sym = 91 AND p = 91 THEN 0 ELSE 1 END) {W} - 1 AS op FROM (SELECT *, coalesce(lag(sym) {W}, -1) AS p FROM tok)),
ops AS (SELECT stream, CAST(op AS BIGINT) AS op, CASE WHEN min(sym) = 91 THEN 'RUN91' ELSE 'LITERAL' END AS kind, CASE WHEN min(sym) <> 91 THEN min(sym) END AS value,
  count(*) AS run_len, min(pos) AS out_index FROM oi GROUP BY stream, op)"""
SAMPLES = f"{TOK}, sm AS (SELECT stream, pos AS idx, coalesce(last_value(CASE WHEN sym <> 91 THEN sym END IGNORE NULLS) OVER (PARTITION BY stream ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS sample FROM tok)"
query("ops_repeat_last", f"WITH {OPS} SELECT stream, op, kind, value, run_len FROM ops")(over(tok, lambda t: expand.ops(t).drop("out_index")))
query("ops_zero_run", f"WITH {TOK} SELECT stream, pos AS op, 'LITERAL' AS kind, sym AS value, CAST(1 AS BIGINT) AS run_len, pos AS out_index FROM tok")(over(tok, lambda t: expand.ops(t, repeat_last=False)))
query("samples", f"WITH {SAMPLES} SELECT * FROM sm")(over(tok, expand.samples))
query("ops_offsets", f"WITH {OPS} SELECT stream, op, CAST(sum(run_len) OVER (PARTITION BY stream ORDER BY op) - run_len AS BIGINT) AS out_index FROM ops")(over(tok, lambda t: expand.ops(t).select("stream", "op", "out_index")))
query("op_stats", f"""WITH {OPS} SELECT stream, count(*) AS ops, count(*) FILTER (WHERE kind = 'LITERAL') AS literals, count(*) FILTER (WHERE kind = 'RUN91') AS runs, CAST(sum(run_len) AS BIGINT) AS samples,
  CAST(coalesce(max(run_len) FILTER (WHERE kind = 'RUN91'), 0) AS BIGINT) AS best_run, CAST(coalesce(sum(run_len) FILTER (WHERE kind = 'RUN91'), 0) AS BIGINT) AS total_run FROM ops GROUP BY stream""")(over(tok, lambda t: expand.stats(expand.ops(t))))
query("rebuild_samples", f"WITH {SAMPLES} SELECT * FROM sm")(over(tok, lambda t: expand.rebuild(expand.ops(t))))
query("cycle_counts", f"WITH {TOK} SELECT stream, count(*) AS samples FROM tok GROUP BY stream")(over(tok, lambda t: expand.counts(expand.rebuild(expand.ops(t)))))
query("stage_compare", f"WITH {SAMPLES}, lost AS (SELECT * FROM sm WHERE NOT (stream % 3 = 0 AND idx = 2)) SELECT l.stream, l.n AS left_samples, r.n AS right_samples, coalesce(l.n = r.n, false) AS equal FROM (SELECT stream, count(*) AS n FROM sm GROUP BY stream) l LEFT JOIN (SELECT stream, count(*) AS n FROM lost GROUP BY stream) r ON l.stream = r.stream")(
    over(tok, lambda t: expand.compare(expand.samples(t), expand.rebuild(expand.ops(t)).filter("not (stream % 3 = 0 and idx = 2)")))
)
query("token_counts", f"WITH {TOK} SELECT stream, count(DISTINCT sym) AS unique_symbols, count(*) FILTER (WHERE sym = 61) AS n_61, count(*) FILTER (WHERE sym = 63) AS n_63 FROM tok GROUP BY stream")(over(tok, lambda t: tokens.symbol_counts(t, (61, 63))))

# ---------------------------------------------------------------- series

SER, SER78 = ser_sql(), ser_sql(78, whole=False)
LEVELS = "lv AS (SELECT level, level * 2 + 1 AS mapped FROM range(0, 200) t(level) WHERE level % 3 <> 0)"


def levels(spark):
    return spark.range(200).select(F.col("id").alias("level"), (F.col("id") * 2 + 1).alias("mapped")).filter("level % 3 <> 0")


def long_value(df):
    return df.withColumn("value", F.col("value").cast("bigint"))


query("concat_series", f"WITH {SER}, {USR} SELECT cycle, idx, value FROM ser UNION ALL SELECT printf('user_%06d', stream), idx, value FROM usr")(lambda s, d: series.concat(ser(s, d), usr_cycles(s, d)))
_MODE = "SELECT idx, value FROM (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY n DESC, late DESC) AS r FROM (SELECT idx, value, count(*) AS n, max(cycle) AS late FROM ser GROUP BY idx, value)) WHERE r = 1"
query("stitch_mode", f"WITH {SER} {_MODE}")(over(ser, series.stitch_mode))
query("stitch", f"WITH {SER} {_MODE}")(over(ser, series.stitch))
query("stitch_longest", f"WITH {USR}, b AS (SELECT stream FROM usr GROUP BY stream ORDER BY count(*) DESC, printf('user_%06d', stream) LIMIT 1) SELECT printf('user_%06d', stream) AS cycle, idx, value FROM usr WHERE stream IN (SELECT stream FROM b)")(over(usr_cycles, series.stitch_longest))
query("identity_map", f"WITH {SER} SELECT DISTINCT value AS level, value AS mapped FROM ser")(over(ser, series.identity_map))
query("level_map", f"WITH {SER}, {LEVELS} SELECT cycle, idx, CAST(value AS BIGINT) AS value, coalesce(mapped, value) AS value_mapped FROM ser LEFT JOIN lv ON value = level")(lambda s, d: series.map_levels(long_value(ser(s, d)), levels(s)))
query("map_used", f"WITH {SER}, {LEVELS} SELECT CAST(value AS BIGINT) AS level, coalesce(mapped, value) AS value_mapped, min(idx) AS first_idx FROM ser LEFT JOIN lv ON value = level GROUP BY ALL")(lambda s, d: series.map_used(series.map_levels(long_value(ser(s, d)), levels(s))))
query("level_hist", f"WITH {SER} SELECT value AS level, count(*) AS count FROM ser GROUP BY ALL")(over(ser, series.level_histogram))
query("unmapped_levels", f"WITH {SER}, {LEVELS} SELECT DISTINCT CAST(value AS BIGINT) AS level FROM ser WHERE value NOT IN (SELECT level FROM lv)")(lambda s, d: series.unmapped(long_value(ser(s, d)), levels(s)))

# ---------------------------------------------------------------- signal

AUTO = f"""{USR}, c AS (SELECT *, value - avg(value) OVER (PARTITION BY stream) AS x, count(*) OVER (PARTITION BY stream) AS n FROM usr),
lags AS (SELECT stream, unnest(range(0, greatest(least(greatest(4, least(256, max(n) // 2)), max(n) - 1), 0) + 1)) AS lag FROM c GROUP BY stream),
vv AS (SELECT stream, sum(x * x) AS v FROM c GROUP BY stream),
auto AS (SELECT stream, lag, round(sum(a.x * b.x) / first(CASE WHEN v > 0 THEN v ELSE 1e-12 END), 6) + 0.0 AS autocorr FROM c a JOIN lags USING (stream) JOIN vv USING (stream) JOIN c b USING (stream) WHERE b.idx = a.idx + lag GROUP BY stream, lag)"""
DFT = """nn AS (SELECT *, count(*) OVER (PARTITION BY stream) AS n FROM usr), kk AS (SELECT *, unnest(range(0, n // 2 + 1)) AS k FROM nn),
dft AS (SELECT stream, k, round(k / n, 6) AS freq, round(sqrt(sum(value * cos(2 * pi() * k * idx / n)) ** 2 + sum(value * sin(2 * pi() * k * idx / n)) ** 2), 6) + 0.0 AS magnitude FROM kk GROUP BY stream, k, n)"""
LAGS = "tl AS (" + ranked("stream", "autocorr DESC, lag", "(SELECT * FROM auto WHERE lag > 0)", 5) + ")"
BINS = "tb AS (" + ranked("stream", "magnitude DESC, k", "(SELECT stream, k, freq, magnitude FROM (SELECT *, max(k) OVER (PARTITION BY stream) AS last FROM dft) WHERE k > 0 AND k < last)", 5) + ")"
query("value_hist64", f"""WITH {USR}, e AS (SELECT stream, min(value)::DOUBLE AS lo, max(value)::DOUBLE AS hi FROM usr GROUP BY stream),
h AS (SELECT stream, lo, (hi - lo) / 64 AS step, value FROM usr JOIN e USING (stream)),
b AS (SELECT stream, lo, step, CAST(CASE WHEN step > 0 THEN least(floor((value - lo) / nullif(step, 0)), 63) ELSE 0 END AS BIGINT) AS bin FROM h)
SELECT stream, bin, round(CASE WHEN step > 0 THEN lo + (bin + 0.5) * step ELSE lo END, 6) AS centre, count(*) AS count FROM b GROUP BY ALL""")(over(usr, signal.histogram))
query("autocorr", f"WITH {AUTO} SELECT * FROM auto")(over(usr, signal.autocorrelation))
query("dft_mag", f"WITH {USR}, {DFT} SELECT stream, k, magnitude FROM dft")(over(usr, lambda u: signal.dft_joined(u).drop("freq")))
query("dft_export", f"WITH {USR}, {DFT} SELECT * FROM dft")(over(usr, signal.dft))
query("top_lags", f"WITH {AUTO}, {LAGS} SELECT * FROM tl")(over(usr, lambda u: signal.top_lags(signal.autocorrelation(u))))
query("top_bins", f"WITH {USR}, {DFT}, {BINS} SELECT * FROM tb")(over(usr, lambda u: signal.top_bins(signal.dft(u))))
query("peaks", f"WITH {AUTO}, {DFT}, {LAGS}, {BINS} SELECT stream, 'lag' AS type, lag AS index, autocorr AS value FROM tl UNION ALL SELECT stream, 'bin', k, magnitude FROM tb")(over(usr, lambda u: signal.peaks(signal.autocorrelation(u), signal.dft(u))))

# ---------------------------------------------------------------- periods


def candidates_sql(view: str = "ser", keep: str = "n % period = 0 AND n // period > 1") -> str:
    return f"""ln AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM {view} GROUP BY cycle)),
dd AS (SELECT n, list_concat([39, 78, 117], list_filter(range(2, n + 1), lambda d: n % d = 0 AND d NOT IN (39, 78, 117))) AS l FROM ln),
cand AS (SELECT ord - 1 AS ord, period, n FROM (SELECT n, unnest(l) AS period, generate_subscripts(l, 1) AS ord FROM dd) WHERE period > 1 AND {keep})"""


PROFILE = """gr AS (SELECT cycle, ord, period, idx // period AS row, idx % period AS col, value FROM ser, cand),
mv AS (SELECT *, coalesce(value >= lag(value) OVER (PARTITION BY cycle, period, col ORDER BY row), true) AS up FROM gr),
pv AS (SELECT cycle, ord, period, col, value, count(*) AS f, bool_and(up) AS up FROM mv GROUP BY ALL), pn AS (SELECT *, sum(f) OVER (PARTITION BY cycle, period, col) AS n FROM pv),
pr AS (SELECT cycle, ord, period, col, count(*) AS distinct_values, round(sum(f * value * value) / max(n) - (sum(f * value) / max(n)) ** 2, 6) + 0.0 AS variance,
  round(sum(-(f / n) * log2(f / n)), 6) + 0.0 AS entropy, round(sum(CASE WHEN value IN (0, 1) THEN f ELSE 0 END) / max(n), 6) AS pct01,
  round(sum(CASE WHEN value IN (0, 255) THEN f ELSE 0 END) / max(n), 6) AS pct0255, bool_and(up) AS monotonic, count(*) = 1 AS constant FROM pn GROUP BY cycle, ord, period, col),
sc AS (SELECT ord, period, cycle, round(sum(greatest(0, 8 - entropy) + 4 * greatest(pct01, pct0255) + CASE WHEN monotonic THEN 2.0::DOUBLE ELSE 0 END + CASE WHEN constant THEN 2.0::DOUBLE ELSE 0 END), 4) AS score FROM pr GROUP BY ord, period, cycle)"""
FITS, TRIM = candidates_sql(), candidates_sql(keep="period <= n")


def profiled(s):
    return grid.profiles(grid.reshape(s, grid.candidates(s)))


query("period_candidates", f"WITH {SER78}, {candidates_sql()} SELECT ord, period, n FROM cand")(lambda s, d: grid.candidates(ser(s, d, 78, whole=False)))
query("resolved_period", f"WITH {SER78} SELECT CAST(78 AS BIGINT) AS period FROM ser WHERE idx = 0 LIMIT 1")(lambda s, d: grid.resolve(s.createDataFrame([], "period long, total double"), ser(s, d, 78, whole=False)))
query("col_profile", f"WITH {SER}, {FITS}, {PROFILE} SELECT * FROM pr")(over(ser, profiled))
query("period_scores", f"WITH {SER}, {FITS}, {PROFILE} SELECT * FROM sc")(over(ser, lambda s: grid.scores(profiled(s))))
query("best_period", f"WITH {SER}, {FITS}, {PROFILE} SELECT period, round(sum(score), 3) AS total FROM sc GROUP BY ord, period ORDER BY total DESC, ord LIMIT 1")(over(ser, lambda s: grid.best(grid.totals(grid.scores(profiled(s))))))
query("grid_long", f"WITH {SER} SELECT cycle, idx // 10 AS row, idx % 10 AS col, value FROM ser")(over(ser, lambda s: grid.long_grid(s, 10)))
query("grid_wide", f"WITH {SER} SELECT cycle, idx // 10 AS row, {', '.join(f'max(value) FILTER (WHERE idx % 10 = {c}) AS c{c}' for c in range(10))} FROM ser GROUP BY ALL")(over(ser, lambda s: grid.wide_grid(grid.long_grid(s, 10), 10)))
query("period_scores_trim", f"WITH {SER}, {TRIM}, {PROFILE.replace('FROM ser, cand)', 'FROM ser, cand WHERE idx < n // period * period)')} SELECT * FROM sc")(
    over(ser, lambda s: grid.scores(grid.profiles(grid.reshape(s, grid.candidates(s, remainder=True), remainder=True))))
)

# ---------------------------------------------------------------- fields

GRID = f"{SER}, g AS (SELECT cycle, idx // 25 AS row, idx % 25 AS col, CASE WHEN idx % 25 IN (3, 4) THEN 7 WHEN idx % 25 = 6 THEN value % 2 WHEN idx % 25 = 8 THEN (idx // 25) * 2 WHEN idx % 25 IN (10, 13, 15) THEN 16 + (idx // 25) WHEN idx % 25 IN (11, 12, 14, 16) THEN 1 + value % 2 ELSE value END AS value FROM ser)"
FACTS = """st AS (SELECT *, value - lag(value) OVER (PARTITION BY cycle, col ORDER BY row) AS d FROM g),
cf AS (SELECT cycle, col, count(*) AS rows, min(value) = max(value) AS constant, bool_and(value IN (0, 1)) AS bin01, bool_and(value IN (0, 255)) AS bin0255,
  coalesce(min(d) >= 0, true) AS mono, round(coalesce(var_pop(d), 0), 6) AS step_var FROM st GROUP BY cycle, col),
pb AS (SELECT a.cycle, a.row, a.col, (a.value & 255) + (b.value & 255) * 256 AS le, (b.value & 255) + (a.value & 255) * 256 AS be FROM g a JOIN g b ON a.cycle = b.cycle AND a.row = b.row AND b.col = a.col + 1),
pd AS (SELECT *, le - lag(le) OVER w AS dle, be - lag(be) OVER w AS dbe FROM pb WINDOW w AS (PARTITION BY cycle, col ORDER BY row)),
ps AS (SELECT cycle, col, round(coalesce(var_pop(dle), 0), 3) AS le_var, round(coalesce(var_pop(dbe), 0), 3) AS be_var, count(DISTINCT le) AS le_distinct, count(DISTINCT be) AS be_distinct FROM pd GROUP BY cycle, col),
pp AS (SELECT *, CASE WHEN (le_var < be_var OR (le_var = be_var AND le_distinct < be_distinct)) AND le_var < 50 THEN 'U16_LE'
  WHEN (be_var < le_var OR (le_var = be_var AND be_distinct < le_distinct)) AND be_var < 50 THEN 'U16_BE' END AS pair FROM ps)"""
LAYOUT = """al AS (SELECT cf.cycle, cf.col, pair, CASE WHEN constant THEN 'CONST' WHEN bin01 OR bin0255 THEN 'FLAG' WHEN mono AND rows >= 3 AND step_var < 5 THEN 'COUNTER' END AS alone FROM cf LEFT JOIN pp ON cf.cycle = pp.cycle AND cf.col = pp.col),
ok AS (SELECT *, alone IS NULL AND pair IS NOT NULL AS ok FROM al), rn AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY cycle ORDER BY col) AS run FROM ok),
sp AS (SELECT *, ok AND (row_number() OVER (PARTITION BY cycle, run, ok ORDER BY col) - 1) % 2 = 0 AS starts FROM rn),
tk AS (SELECT *, coalesce(lag(starts) OVER (PARTITION BY cycle ORDER BY col), false) AS taken FROM sp),
lay AS (SELECT cycle, col AS start_col, CAST(CASE WHEN starts THEN 2 ELSE 1 END AS BIGINT) AS width, CASE WHEN starts THEN pair ELSE coalesce(alone, 'UNKNOWN') END AS kind FROM tk WHERE NOT taken)"""
RECORDS = """rec AS (SELECT g.cycle, g.row, lower(kind) || '_c' || lpad(CAST(start_col AS VARCHAR), 2, '0') AS field,
  CAST(CASE kind WHEN 'U16_LE' THEN (g.value & 255) + coalesce(h.value & 255, 0) * 256 WHEN 'U16_BE' THEN coalesce(h.value & 255, 0) + (g.value & 255) * 256 ELSE g.value & 255 END AS BIGINT) AS value
  FROM g JOIN lay ON g.cycle = lay.cycle AND g.col = start_col LEFT JOIN g h ON g.cycle = h.cycle AND g.row = h.row AND h.col = g.col + 1)"""


def sample_grid(spark, sf_dir):
    """A grid of 25 columns in which some are made constant, binary, counting or paired."""
    g = grid.long_grid(ser(spark, sf_dir), 25)
    c, r, v = F.col("col"), F.col("row"), F.col("value").cast("bigint")
    value = (
        F.when(c.isin(3, 4), F.lit(7)).when(c == 6, v % 2).when(c == 8, r * 2).when(c.isin(10, 13, 15), 16 + r).when(c.isin(11, 12, 14, 16), 1 + v % 2).otherwise(v)
    )
    return g.withColumn("value", value.cast("bigint"))


def laid_out(g):
    known = fields.facts(g)
    return fields.validate(fields.infer(g, known), g, known)


def edited(layout):
    """A layout as an editor may leave it: wrong kinds and widths, columns out of bounds."""
    c = F.col("start_col")
    return layout.select(
        "cycle", F.when(c == 24, c + 1).otherwise(c).alias("start_col"), F.when(c % 5 == 0, 3).otherwise(F.col("width")).cast("bigint").alias("width"),
        F.when(c % 7 == 1, "COUNTER").when(c % 7 == 2, "CONST").when(c % 7 == 4, "U16_BE").when(c == 9, "FLAG").when(c == 17, "OTHER").otherwise(F.col("kind")).alias("kind"),
    )


query("infer_fields", f"WITH {GRID}, {FACTS}, {LAYOUT} SELECT * FROM lay")(over(sample_grid, fields.infer))
query("pair_scores", f"WITH {GRID}, {FACTS} SELECT * FROM pp")(over(sample_grid, fields.pair_scores))
query("validate_layout", f"WITH {GRID}, {FACTS}, {LAYOUT} SELECT *, true AS valid, CASE WHEN kind = 'UNKNOWN' THEN 'not tested' ELSE 'ok' END AS reason FROM lay")(over(sample_grid, laid_out))
query("validate_edited", f"""WITH {GRID}, {FACTS}, {LAYOUT}, ed AS (SELECT cycle, CASE WHEN start_col = 24 THEN 25 ELSE start_col END AS start_col, CAST(CASE WHEN start_col % 5 = 0 THEN 3 ELSE width END AS BIGINT) AS width,
  CASE WHEN start_col % 7 = 1 THEN 'COUNTER' WHEN start_col % 7 = 2 THEN 'CONST' WHEN start_col % 7 = 4 THEN 'U16_BE' WHEN start_col = 9 THEN 'FLAG' WHEN start_col = 17 THEN 'OTHER' ELSE kind END AS kind FROM lay),
ck AS (SELECT ed.*, CASE WHEN start_col < 0 OR start_col + width > 25 THEN 'out of bounds' WHEN kind LIKE 'U16%' AND width <> 2 THEN 'width must be 2' WHEN kind NOT IN ('CONST', 'FLAG', 'COUNTER', 'U16_LE', 'U16_BE') THEN 'not tested'
  WHEN coalesce(CASE kind WHEN 'CONST' THEN constant WHEN 'FLAG' THEN bin01 OR bin0255 WHEN 'COUNTER' THEN mono AND step_var < 5 WHEN 'U16_LE' THEN le_var < 50 ELSE be_var < 50 END, false) THEN 'ok' ELSE 'test failed' END AS reason
  FROM ed LEFT JOIN cf ON ed.cycle = cf.cycle AND start_col = cf.col LEFT JOIN ps ON ed.cycle = ps.cycle AND start_col = ps.col)
SELECT cycle, start_col, width, kind, reason IN ('ok', 'not tested') AS valid, reason FROM ck""")(over(sample_grid, lambda g: fields.validate(edited(fields.infer(g)), g)))
query("final_export_counts", f"WITH {GRID}, {FACTS}, {LAYOUT}, {RECORDS} SELECT (SELECT count(*) FROM (SELECT DISTINCT cycle, row FROM rec)) AS rows, (SELECT count(DISTINCT field) FROM rec) + 1 AS cols")(over(sample_grid, lambda g: fields.final_export(fields.records(g, laid_out(g)))[1]))
query("manifest", f"""WITH {GRID}, {FACTS}, {LAYOUT}, ln AS (SELECT cycle, '[' || cycle || ']' || chr(10) || string_agg(printf('  - col %d..%d %-9s -> %s (%s)', start_col, start_col + width - 1, kind, 'OK', CASE WHEN kind = 'UNKNOWN' THEN 'not tested' ELSE 'ok' END), chr(10) ORDER BY start_col) AS t FROM lay GROUP BY cycle)
SELECT '{{"baseDir":"out","outputs":{{"hist":"out/hist"}},"finalCsv":"out/final","bestPeriod":25,"layoutFinalTxt":[' || (SELECT string_agg('"' || replace(t, chr(10), '\\n') || '"', ',' ORDER BY cycle) FROM ln) || ']}}' AS json""")(
    over(sample_grid, lambda g: sinks.manifest(g.sparkSession, "out", {"hist": "out/hist"}, g.sparkSession.range(1).select(F.lit(25).alias("period")), laid_out(g), "out/final"))
)
query("records", f"WITH {GRID}, {FACTS}, {LAYOUT}, {RECORDS} SELECT * FROM rec")(over(sample_grid, lambda g: fields.records(g, laid_out(g))))
query("records_union", f"WITH {GRID}, {FACTS}, {LAYOUT}, {RECORDS} SELECT cycle, row, {', '.join(f'max(value) FILTER (WHERE field = {chr(39)}{n}{chr(39)}) AS {n}' for n in ('const_c03', 'flag_c06', 'counter_c08'))} FROM rec GROUP BY cycle, row")(
    over(sample_grid, lambda g: fields.wide_records(fields.records(g, laid_out(g)), ["const_c03", "flag_c06", "counter_c08"]))
)
query("global_union", f"WITH {GRID} SELECT 'seg_00_00_00' AS segment, cycle, count(*) AS cells, CAST(NULL AS BIGINT) AS total FROM g GROUP BY cycle UNION ALL SELECT 'seg_00_00_01', cycle, NULL, CAST(sum(value) AS BIGINT) FROM g GROUP BY cycle")(
    over(sample_grid, lambda g: fields.union_all([g.groupBy("cycle").agg(F.count("*").alias("cells")).select(F.lit("seg_00_00_00").alias("segment"), "cycle", "cells"), g.groupBy("cycle").agg(F.sum("value").alias("total")).select(F.lit("seg_00_00_01").alias("segment"), "cycle", "total")]))
)

# ---------------------------------------------------------------- scalars

query("offset_index", "SELECT l_orderkey, i1, i2, i3, i3 * 20 + i2 * 5 + i1 AS idx, round(l_quantity, 2) AS q FROM (SELECT l_orderkey, l_quantity, l_orderkey % 5 AS i1, l_partkey % 4 AS i2, l_suppkey % 3 AS i3 FROM lineitem)")(
    lambda s, d: table(s, d, "lineitem").select("l_orderkey", (F.col("l_orderkey") % 5).alias("i1"), (F.col("l_partkey") % 4).alias("i2"), (F.col("l_suppkey") % 3).alias("i3"), F.round("l_quantity", 2).alias("q")).withColumn("idx", scalar.linear_index(F.col("i1"), F.col("i2"), F.col("i3"), 5, 4))
)
query("offset_inverse", "SELECT p_partkey, p_partkey % 5 AS i1, p_partkey // 5 % 4 AS i2, p_partkey // 20 AS i3 FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", *(c.alias(n) for c, n in zip(scalar.coordinates(F.col("p_partkey"), 5, 4), ("i1", "i2", "i3"))))
)
query("next_offset", "SELECT off, lead(off) OVER (ORDER BY off) AS next_off FROM (SELECT DISTINCT p_size * 8192 AS off FROM part)")(
    lambda s, d: scalar.next_offsets(table(s, d, "part").select((F.col("p_size") * 8192).alias("off")), "off")
)
_LENS = "list_transform(range(1, 9), lambda i: (p_partkey * i) % 7)"
query("kraft_check", f"SELECT p_partkey, list_max(l) > 0 AND list_sum(list_transform(l, lambda x: CASE WHEN x > 0 THEN CAST(2 ** (list_max(l) - x) AS BIGINT) ELSE 0 END)) <= CAST(2 ** list_max(l) AS BIGINT) AS ok FROM (SELECT p_partkey, {_LENS} AS l FROM part)")(
    lambda s, d: table(s, d, "part").select("p_partkey", scalar.kraft_ok(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.col("p_partkey") * i) % 7)).alias("ok"))
)
query("unique_symbols", f"SELECT p_partkey, len(list_distinct(l)) = len(l) AS ok FROM (SELECT p_partkey, {_LENS.replace('% 7', '% 11')} AS l FROM part)")(
    lambda s, d: table(s, d, "part").select("p_partkey", scalar.all_unique(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: (F.col("p_partkey") * i) % 11)).alias("ok"))
)
query("nibble_unpack", "SELECT p_partkey, (p_partkey & 255) >> 4 AS hi, p_partkey & 15 AS lo, p_partkey & 255 AS low FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", *(c.alias(n) for c, n in zip((*scalar.nibbles(F.col("p_partkey")), scalar.low_byte(F.col("p_partkey"))), ("hi", "lo", "low"))))
)
query("align16", "SELECT o_orderkey, (o_orderkey + 15) // 16 * 16 AS aligned FROM orders")(lambda s, d: table(s, d, "orders").select("o_orderkey", scalar.align(F.col("o_orderkey")).alias("aligned")))
query("lenient_int", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderkey WHEN 1 THEN CAST('0x' || printf('%x', o_orderkey) AS BIGINT) WHEN 2 THEN 0 ELSE 171 END AS v FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_orderkey", scalar.lenient_int(
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderkey").cast("string")).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("0x"), F.lower(F.hex("o_orderkey")))).when(F.col("o_orderkey") % 4 == 2, F.lit("no number")).otherwise(F.lit("ab"))
    ).alias("v"))
)
query("divisors", """SELECT p_partkey, array_to_string(list_filter(list_sort(list_distinct(list_concat(l, list_transform(l, lambda d: p_partkey // d)))), lambda d: d > 1), ',') AS divisors
FROM (SELECT p_partkey, list_filter(range(1, CAST(sqrt(p_partkey) AS BIGINT) + 2), lambda d: d * d <= p_partkey AND p_partkey % d = 0) AS l FROM part)""")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(F.transform(scalar.divisors(F.col("p_partkey")), lambda x: x.cast("string")), ",").alias("divisors"))
)
query("reverse_bits", "SELECT p_partkey, CAST(list_sum(list_transform(range(0, 12), lambda i: ((p_partkey >> i) & 1) << (11 - i))) AS BIGINT) AS reversed FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", scalar.reverse_bits(F.col("p_partkey") % 4096, 12).alias("reversed"))
)
query("first_int", "SELECT c_custkey, CAST(nullif(regexp_extract(c_mktsegment || ' ' || c_name || ' -7', '([-+]?[0-9]+)', 1), '') AS BIGINT) AS v FROM customer")(
    lambda s, d: table(s, d, "customer").select("c_custkey", scalar.first_int(F.concat_ws(" ", "c_mktsegment", "c_name", F.lit("-7"))).alias("v"))
)
query("segment_tag", "SELECT p_partkey, printf('seg_%02d_%02d_%02d', p_partkey % 5, p_partkey // 5 % 4, p_partkey // 20) AS tag FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", scalar.segment_tag(*(c.cast("int") for c in scalar.coordinates(F.col("p_partkey"), 5, 4))).alias("tag"))
)


def lens_of(top: int):
    return F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: ((F.col("p_partkey") * i) % top).cast("int"))


query("lens_in_range", f"SELECT p_partkey, list_max(l) <= 15 AS ok FROM (SELECT p_partkey, {_LENS.replace('% 7', '% 17')} AS l FROM part)")(lambda s, d: table(s, d, "part").select("p_partkey", scalar.in_range(lens_of(17)).alias("ok")))
query("code_length_hist", f"SELECT p_partkey, CAST(n AS INTEGER) AS len, CAST(list_max(l) AS INTEGER) AS max_len, CAST(len(list_filter(l, lambda x: x > 0)) AS INTEGER) AS used, count(*) AS count FROM (SELECT p_partkey, l, unnest(l) AS n FROM (SELECT p_partkey, {_LENS} AS l FROM part)) GROUP BY ALL")(
    lambda s, d: huffman.length_histogram(table(s, d, "part").select("p_partkey", lens_of(7).alias("lens")), "p_partkey", lens="lens")
)
query("header_checks", """WITH h AS (SELECT p_partkey, 1000 + p_partkey % 50 AS ot_pos, 1100 + p_partkey % 90 AS hdr_pos, 1024 + p_partkey % 7 AS hdr_len, p_partkey % 9 AS n_cells, 8190 + p_partkey % 3 AS rec_len, 2100 + p_partkey % 150 AS rec_pos_0 FROM part)
SELECT CAST(p_partkey AS VARCHAR) AS path, ot_pos >= 1024 AND hdr_pos > ot_pos AND rec_pos_0 >= hdr_pos AND n_cells > 0 AS ok,
  rec_len <> 8192 OR hdr_len NOT BETWEEN 1024 AND 65536 OR least(abs(rec_pos_0 - (ot_pos + n_cells * 8 + hdr_len)), abs(rec_pos_0 - (ot_pos + n_cells * 8 + hdr_len) - 8)) > 64 AS warn FROM h""")(
    lambda s, d: quality.header_checks(table(s, d, "part").select(
        F.col("p_partkey").cast("string").alias("path"), (1000 + F.col("p_partkey") % 50).alias("ot_pos"), (1100 + F.col("p_partkey") % 90).alias("hdr_pos"), (1024 + F.col("p_partkey") % 7).alias("hdr_len"),
        (F.col("p_partkey") % 9).alias("n_cells"), (8190 + F.col("p_partkey") % 3).alias("rec_len"), (2100 + F.col("p_partkey") % 150).alias("rec_pos_0"),
    ))
)
query("record_checks", f"""SELECT CAST(p_partkey AS VARCHAR) AS path, CAST(p_partkey % 5 AS INTEGER) AS s1, 0 AS s2, 0 AS s3, CAST(NULL AS VARCHAR) AS error,
  coalesce(list_max(l) <= 15 AND list_max(l) > 0 AND list_sum(list_transform(l, lambda x: CASE WHEN x > 0 THEN CAST(2 ** (list_max(l) - x) AS BIGINT) ELSE 0 END)) <= CAST(2 ** list_max(l) AS BIGINT)
  AND p_partkey % 4 >= 2 AND st >= 512 AND st % 16 = 0 AND 8192 - st BETWEEN 1 AND 8192 AND p_partkey % 11 > 0, false) AS ok FROM (SELECT p_partkey, p_partkey * 8 % 9000 AS st, {_LENS} AS l FROM part)""")(
    lambda s, d: quality.record_checks(table(s, d, "part").select(
        F.col("p_partkey").cast("string").alias("path"), (F.col("p_partkey") % 5).cast("int").alias("s1"), F.lit(0).alias("s2"), F.lit(0).alias("s3"), F.lit(None).cast("string").alias("error"),
        F.struct(lens_of(7).alias("lens"), (F.col("p_partkey") % 4).alias("n"), (F.col("p_partkey") * 8 % 9000).alias("payload_start"), (F.col("p_partkey") % 11).alias("total_bits")).alias("table"),
    ))
)


def coded(spark, sf_dir):
    """Each part's key as 32 bits of a prefix code of four symbols, with 1, 2, 3 and 3 bits. Of a larger product the low 32 bits count."""
    codes = [F.array(*map(F.lit, x)).alias(n) for x, n in (((61, 91, 195, 249), "symbols"), ((1, 2, 3, 3), "lens"))]
    low = (F.col("p_partkey") * 7919).bitwiseAND(0xFFFFFFFF)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("stream"), F.unhex(F.lpad(F.hex(low), 8, "0")).alias("data"), *codes, F.lit(32).cast("bigint").alias("bits"))


def decoded_sql(bit: str) -> str:
    return f"""SELECT stream, array_to_string(list_transform(l, lambda c: CASE c WHEN '0' THEN 61 WHEN '10' THEN 91 WHEN '110' THEN 195 ELSE 249 END), ' ') AS tokens, CAST(len(l[-1]) AS INTEGER) AS last_length FROM (
SELECT p_partkey AS stream, regexp_extract_all(array_to_string(list_transform(range(0, 32), lambda i: ((p_partkey * 7919) >> {bit}) & 1), ''), '0|10|110|111') AS l FROM part)"""


def told(df):
    return df.withColumn("tokens", F.array_join(F.transform("tokens", lambda x: x.cast("string")), " "))


query("decode_msb", decoded_sql("(31 - i)"))(lambda s, d: told(huffman.decode_with(coded(s, d))))
query("decode_lsb", decoded_sql("(8 * (3 - i // 8) + i % 8)"))(lambda s, d: told(huffman.decode_with(coded(s, d), lsb=True)))
query("last_int", "SELECT c_custkey, CAST(regexp_extract(c_name, '([0-9]+)[^0-9]*$', 1) AS BIGINT) AS v, replace(c_mktsegment || ',x', ',', ';') AS clean FROM customer")(
    lambda s, d: table(s, d, "customer").select("c_custkey", scalar.last_int(F.col("c_name")).alias("v"), scalar.sanitise(F.concat("c_mktsegment", F.lit(",x"))).alias("clean"))
)
