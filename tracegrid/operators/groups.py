"""Splitting at separators, merging, features, classes, cycles and traces.

Groups are in long form: (stream, sg, gpos, sym), sg and gpos from 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import CONTROL, CONTROL_SYMBOLS, FILL, MARK, PARAM, RARE, SOFT, STRONG
from .tokens import NAMES, in_order, top, top_ngrams

RUNNING = (Window.unboundedPreceding, 0)


def _numbered(df: DataFrame, group: Column) -> DataFrame:
    """Groups numbered from 0 without gaps, and their tokens from 0."""
    df = df.withColumn("_g", group)
    df = df.withColumn("sg", (F.dense_rank().over(Window.partitionBy("stream").orderBy("_g")) - 1).cast("bigint"))
    at = Window.partitionBy("stream", "sg").orderBy("pos")
    return df.withColumn("gpos", (F.row_number().over(at) - 1).cast("bigint")).select("stream", "sg", "gpos", "pos", "sym")


def split(tok: DataFrame, separators: tuple[int, ...] = (STRONG,)) -> DataFrame:
    """Tokens between separators; separators and empty groups go."""
    cut = F.col("sym").isin(*separators)
    counted = tok.withColumn("_n", F.sum(cut.cast("int")).over(in_order().rowsBetween(*RUNNING)))
    return _numbered(counted.filter(~cut), F.col("_n"))


def _group_facts(groups: DataFrame) -> DataFrame:
    """What decides about a group's neighbours: density, control pair, parameter."""
    before = F.lag("sym").over(Window.partitionBy("stream", "sg").orderBy("gpos"))
    pair = ((F.col("sym") == CONTROL) & (before == CONTROL)).cast("int")
    return groups.withColumn("_pair", F.coalesce(pair, F.lit(0))).groupBy("stream", "sg").agg(
        F.count("*").alias("size"), F.avg((F.col("sym") == FILL).cast("double")).alias("density"),
        (F.max("_pair") == 1).alias("pair"), F.bool_or(F.col("sym") == PARAM).alias("param"),
    )


def merge_padding(groups: DataFrame, threshold: float) -> DataFrame:
    """A group whose fill density reaches ``threshold`` joins the one before it. The
    density is that of the group as split, so a running sum decides."""
    density = F.avg((F.col("sym") == FILL).cast("double")).over(Window.partitionBy("stream", "sg"))
    rows = groups.withColumn("_density", density)
    opens = ((F.col("gpos") == 0) & ((F.col("sg") == 0) | (F.col("_density") < threshold))).cast("int")
    to = F.sum(opens).over(Window.partitionBy("stream").orderBy("sg", "gpos").rowsBetween(*RUNNING))
    return _numbered(rows.withColumn("_to", to).drop("sg"), F.col("_to"))


def promote(groups: DataFrame) -> DataFrame:
    """Joins groups with a soft separator between them, up to a group that has a
    control pair and at most 16 tokens, or a parameter."""
    facts = _group_facts(groups)
    w = Window.partitionBy("stream").orderBy("sg")
    ends = ((F.col("pair") & (F.col("size") <= 16)) | F.col("param")).cast("int")
    to = facts.withColumn("to", F.coalesce(F.sum(ends).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    to = to.withColumn("inner", F.coalesce(F.lag("to").over(w) == F.col("to"), F.lit(False)))
    glue = to.filter("inner").select("stream", "sg", F.lit(-1).cast("bigint").alias("gpos"), F.lit(SOFT).alias("sym"), "to")
    rows = groups.join(to.select("stream", "sg", "to"), ["stream", "sg"]).select("stream", "sg", "gpos", "sym", "to").unionByName(glue)
    place = F.row_number().over(Window.partitionBy("stream", "to").orderBy("sg", "gpos")) - 1
    return rows.select("stream", F.col("to").cast("bigint").alias("sg"), place.cast("bigint").alias("gpos"), "sym")


def features(groups: DataFrame) -> DataFrame:
    """One row a group: size, density, best fill run, counts and positions."""
    w = Window.partitionBy("stream", "sg").orderBy("gpos")
    change = F.when(F.lag("sym").over(w) == F.col("sym"), 0).otherwise(1)
    facts = groups.withColumn("_run", F.sum(change).over(w.rowsBetween(*RUNNING)))
    facts = facts.withColumn("_len", F.count("*").over(Window.partitionBy("stream", "sg", "_run")))
    pair = F.coalesce((F.max(F.when(F.col("sym") == CONTROL, F.col("_len"))) >= 2), F.lit(False))
    at = lambda s: F.array_sort(F.collect_list(F.when(F.col("sym") == s, F.col("gpos"))))
    return facts.groupBy("stream", "sg").agg(
        F.count("*").alias("size"), F.avg((F.col("sym") == FILL).cast("double")).alias("density"),
        F.coalesce(F.max(F.when(F.col("sym") == FILL, F.col("_len"))), F.lit(0)).cast("bigint").alias("best_run"),
        pair.alias("pair"), F.count_if(F.col("sym") == SOFT).alias("soft"),
        at(PARAM).alias("at_param"), at(CONTROL).alias("at_control"), at(MARK).alias("at_mark"), at(RARE).alias("at_rare"),
    )


def written(features_: DataFrame) -> DataFrame:
    """The features with position lists as strings."""
    return features_.withColumns({c: F.array_join(F.transform(c, lambda p: p.cast("string")), ",") for c in ("at_param", "at_control", "at_mark", "at_rare")})


def _has(column: str, *places: int) -> Column:
    return reduce(lambda a, b: a & b, (F.array_contains(column, F.lit(p).cast("bigint")) for p in places))


def classify(features_: DataFrame) -> DataFrame:
    """Adds ``type``: the first rule that holds."""
    total = F.count("*").over(Window.partitionBy("stream"))
    size, density, soft = F.col("size"), F.col("density"), F.col("soft")
    n = {c: F.size(c) for c in ("at_param", "at_control", "at_mark")}
    rules = (
        ("P", (F.col("sg") == 0) & (n["at_mark"] == 1) & (n["at_control"] >= 2) & (density >= 0.7)),
        ("A", size.between(28, 38) & F.col("pair") & _has("at_param", 24) & _has("at_control", 8, 9)),
        ("B", size.between(18, 24) & _has("at_mark", 0) & _has("at_control", 4, 6)),
        ("C", size.between(6, 8) & _has("at_control", 3) & (soft >= 2) & density.between(0.45, 0.75)),
        ("D", size.between(65, 85) & density.between(0.65, 0.8) & _has("at_param", 31) & _has("at_mark", 34, 40) & (n["at_control"] >= 6)),
        ("E", size.between(90, 110) & _has("at_param", 19, 35, 70) & (n["at_control"] >= 9) & (soft >= 8)),
        ("T", (F.col("sg") >= total - 3) & (n["at_mark"] == 0) & (n["at_control"] >= 3)),
        ("D?", (density >= 0.7) & (F.col("best_run") >= 3)),
    )
    kind = F.lit("M")
    for name, rule in reversed(rules):
        kind = F.when(rule, name).otherwise(kind)
    return features_.withColumn("type", kind)


def classify_super(features_: DataFrame) -> DataFrame:
    """Adds ``kind``: header/meta, control, padding/RLE, composite or mixed."""
    density = F.col("density")
    kind = (
        F.when((F.size("at_param") > 0) & (density < 0.5), "header/meta").when(F.col("pair"), "control")
        .when((density >= 0.7) & (F.col("best_run") >= 3), "padding/RLE").when((F.col("soft") >= 2) & (density < 0.8), "composite").otherwise("mixed")
    )
    return features_.withColumn("kind", kind)


def cycles(classified: DataFrame, wanted: str = "ABCDE") -> DataFrame:
    """(stream, cycle, start, len) of each place where the types follow each other."""
    w = Window.partitionBy("stream").orderBy("sg")
    match = reduce(lambda a, b: a & b, (F.lead("type", i).over(w) == t if i else F.col("type") == t for i, t in enumerate(wanted)))
    hits = classified.withColumn("_hit", match).filter("_hit")
    return hits.select("stream", (F.row_number().over(w) - 1).cast("bigint").alias("cycle"), F.col("sg").alias("start"), F.lit(len(wanted)).cast("bigint").alias("len"))


def extract_cycles(groups: DataFrame, classified: DataFrame, max_groups: int | None = 5, wanted: str = "ABCDE") -> DataFrame:
    """The tokens of each cycle; a stream without one gives its first ``max_groups``
    groups from the first of type A (else from its start) as cycle 0."""
    w = Window.partitionBy("stream").orderBy("sg")
    per = Window.partitionBy("stream")
    match = reduce(lambda a, b: a & b, (F.lead("type", i).over(w) == t if i else F.col("type") == t for i, t in enumerate(wanted)))
    rows = classified.select("stream", "sg", "type").withColumn("_hit", F.coalesce(match, F.lit(False)))
    begin = F.coalesce(F.min(F.when(F.col("type") == wanted[0], F.col("sg"))).over(per), F.lit(0))
    rows = rows.withColumn("_none", ~F.max("_hit").over(per)).withColumn("_begin", begin)
    starts = F.array(*(F.when(F.lag("_hit", i).over(w) if i else F.col("_hit"), F.col("sg") - i) for i in range(len(wanted))))
    spare = F.when(F.col("_none") & (F.col("sg") >= F.col("_begin")) & (F.col("sg") < F.col("_begin") + (max_groups or 2**40)), F.col("_begin"))
    rows = rows.withColumn("_starts", F.array_compact(F.concat(starts, F.array(spare)))).withColumn("_start", F.explode("_starts"))
    place = F.dense_rank().over(Window.partitionBy("stream").orderBy("_start")) - 1
    spans = rows.select("stream", "sg", "type", place.cast("bigint").alias("cycle"))
    return groups.join(spans, ["stream", "sg"]).select("stream", "cycle", "sg", "type", "gpos", "sym")


def top_symbols(groups: DataFrame, k: int = 8) -> DataFrame:
    """The k commonest symbols of each group."""
    counts = groups.groupBy("stream", "sg", "sym").agg(F.count("*").alias("count"))
    return top(counts, k, (F.desc("count"), "sym"), ("stream", "sg"))


def size_summary(groups: DataFrame) -> DataFrame:
    sizes = groups.groupBy("stream", "sg").agg(F.count("*").alias("size"))
    return sizes.groupBy("stream").agg(
        F.count("*").alias("groups"), F.min("size").alias("min_size"), F.percentile("size", F.lit(0.5)).alias("median_size"),
        F.round(F.avg("size"), 6).alias("mean_size"), F.max("size").alias("max_size"),
    )


def dense_streams(groups: DataFrame, symbols: tuple[int, ...] = (PARAM, FILL, CONTROL, MARK, SOFT, STRONG)) -> DataFrame:
    """Whether a stream is one group without any of ``symbols``."""
    return groups.groupBy("stream").agg(((F.max("sg") == 0) & ~F.bool_or(F.col("sym").isin(*symbols))).alias("dense"))


def dense_diagnostics(tok: DataFrame, symbols: tuple[int, ...] = (PARAM, FILL, CONTROL, MARK, SOFT, STRONG), k: int = 12, grams: int = 8) -> DataFrame:
    """(stream, kind, rank, item, count) of dense streams: the commonest symbols, pairs and triples."""
    dense = dense_streams(split(tok), symbols).filter("dense").select("stream")
    mine = tok.join(dense, "stream", "left_semi")
    out = top(mine.groupBy("stream", "sym").agg(F.count("*").alias("count")), k, (F.desc("count"), "sym")).select("stream", F.lit("symbol").alias("kind"), "rank", F.col("sym").cast("string").alias("item"), "count")
    for n, kind in ((2, "pair"), (3, "triple")):
        names = NAMES[:n]
        best = top_ngrams(mine, n, grams)
        out = out.unionByName(best.select("stream", F.lit(kind).alias("kind"), "rank", F.concat_ws(" ", *(F.col(c).cast("string") for c in names)).alias("item"), "count"))
    return out


def trace(tok: DataFrame, chunk: int = 8) -> DataFrame:
    """Runs of fills, and chunks of at most ``chunk`` other tokens, which restart after each fill run."""
    w = in_order()
    fill = (F.col("sym") == FILL).cast("int")
    change = F.when(F.lag(fill).over(w) == fill, 0).otherwise(1)
    rows = tok.withColumn("_f", fill).withColumn("_i", F.sum(change).over(w.rowsBetween(*RUNNING)))
    first = F.min("pos").over(Window.partitionBy("stream", "_i"))
    rows = rows.withColumn("_c", F.when(F.col("_f") == 1, F.lit(0)).otherwise(F.floor((F.col("pos") - first) / chunk)))
    parts = rows.groupBy("stream", "_i", "_c").agg(
        F.min("pos").cast("bigint").alias("start"), F.count("*").alias("length"), F.min_by("sym", "pos").alias("first"), F.max("_f").alias("fill"),
        F.count_if(F.col("sym").isin(*CONTROL_SYMBOLS)).alias("markers"),
        F.array_join(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("pos", "sym"))), 1, 8), lambda x: x["sym"].cast("string")), " ").alias("preview"),
    )
    kind = F.when(F.col("fill") == 1, "PAD/RLE").when(F.col("first").isin(*CONTROL_SYMBOLS), "CTRL").otherwise("DATA?")
    seg = F.row_number().over(Window.partitionBy("stream").orderBy("start")) - 1
    return parts.select("stream", seg.cast("bigint").alias("seg"), "start", "length", kind.alias("kind"), "preview", "markers")


def trace_totals(tok: DataFrame) -> DataFrame:
    return tok.groupBy("stream").agg(F.count_if(F.col("sym") == FILL).alias("samples"), F.count_if(F.col("sym").isin(*CONTROL_SYMBOLS)).alias("markers"))
