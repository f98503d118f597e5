"""Position lookups as as-of joins: segments and probes are united and sorted once, and the last segment is carried on.

One exchange and one sort serve a lookup: both windows read the same order. Probes are (probe_id, map_id, line, col) with
probe_id of any type, and keep every further column; no side is broadcast and nothing is joined back. Segments without
an is_range column take no part in the range rules, which cost further steps; with it, only maps that have a range do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HIT = ("gen_line", "gen_col", "source_idx", "orig_line", "orig_col", "name_idx")
PLACE = ("source_idx", "orig_line", "orig_col", "name_idx")


def _asof(segs: DataFrame, probes: DataFrame, keys: list[str], at: str, order: list[str], payload: tuple[str, ...], lub: bool, js: bool = False) -> DataFrame:
    """Each probe (keys, probe_at, ask) with `hit`: the row of its keys at the probe's place, otherwise the nearest before (lub: after).

    Of rows at the place itself the first counts (lub: the last; js: the other way round); of rows at the nearest place
    the last (lub: the first).
    """
    seg = F.struct(*payload)
    held = segs.select(*keys, F.col(at).alias("at"), F.lit(0).alias("kind"), *order, seg.alias("seg"))
    asked = probes.select(*keys, F.col("probe_at").alias("at"), F.lit(1).alias("kind"), "ask")
    rows = held.unionByName(asked, allowMissingColumns=True)
    way: list[Column] = [F.desc(c) if lub else F.asc(c) for c in order]
    near = Window.partitionBy(*keys).orderBy(F.desc("at") if lub else F.asc("at"), "kind", *way).rowsBetween(Window.unboundedPreceding, 0)
    same = Window.partitionBy(*keys, "at").orderBy("kind", *way).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("near", F.last("seg", ignorenulls=True).over(near))
    exact = F.last("seg", ignorenulls=True) if js else F.first("seg", ignorenulls=True)
    rows = rows.withColumn("exact", exact.over(same)).where("kind = 1")
    return rows.select(*keys, F.col("at").alias("probe_at"), "ask", F.coalesce("exact", "near").alias("hit"))


def _placed(rows: DataFrame, keep: list[str], line: Column, col: Column) -> DataFrame:
    hit = lambda c: F.col(f"hit.{c}").alias(c)
    return rows.select(*[F.col(f"ask.{c}").alias(c) for c in keep], hit("source_idx"), line.cast("int").alias("orig_line"), col.cast("int").alias("orig_col"), hit("name_idx"))


def original_position(segs: DataFrame, probes: DataFrame, lub: bool = False, js: bool = False) -> DataFrame:
    """(probe_id, source_idx, orig_line, orig_col, name_idx) of each probe, and its further columns; nulls where nothing is found."""
    keep = [c for c in probes.columns if c not in ("map_id", "line", "col")]
    asked = probes.select("map_id", F.col("line").alias("gen_line"), F.col("col").alias("probe_at"), F.struct(*keep).alias("ask"))
    ranged = "is_range" in segs.columns
    payload = (*HIT, "is_range") if ranged else HIT
    out = _asof(segs, asked, ["map_id", "gen_line"], "gen_col", ["seg_idx"], payload, lub, js)
    if not ranged:
        return _placed(out, keep, F.col("hit.orig_line"), F.col("hit.orig_col"))
    past = F.col("hit.is_range") & (F.col("probe_at") >= F.col("hit.gen_col"))
    found = _placed(out.where("hit is not null"), keep, F.col("hit.orig_line"), F.col("hit.orig_col") + F.when(past, F.col("probe_at") - F.col("hit.gen_col")).otherwise(0))
    # Nothing on the line, or (not for lub) nothing before the probe: the mapping just before may be a range. Each line's
    # last segment is all that matters, of maps that have ranges at all.
    none, maps = out.where("hit is null"), segs.where("is_range").select("map_id").distinct()
    idle = _placed(none.join(maps, "map_id", "left_anti"), keep, F.lit(None), F.lit(None))
    ends = segs.join(maps, "map_id", "left_semi").groupBy("map_id", "gen_line").agg(F.max_by(F.struct(*payload), "seg_idx").alias("seg"))
    ends = ends.select("map_id", "gen_line", F.lit(0 if lub else 1).alias("kind"), "seg")
    asks = none.join(maps, "map_id", "left_semi").select("map_id", "gen_line", F.lit(1 if lub else 0).alias("kind"), "ask")
    w = Window.partitionBy("map_id").orderBy("gen_line", "kind").rowsBetween(Window.unboundedPreceding, 0)
    back = ends.unionByName(asks, allowMissingColumns=True).withColumn("last", F.last("seg", ignorenulls=True).over(w)).where("ask is not null")
    fits = F.col("last.is_range") & F.col("last.source_idx").isNotNull() & (F.col("last.gen_line") < F.col("gen_line"))
    back = back.withColumn("hit", F.when(fits, F.col("last")))
    back = _placed(back, keep, F.col("hit.orig_line") + F.col("gen_line") - F.col("hit.gen_line"), F.col("hit.orig_col"))
    return found.unionByName(idle).unionByName(back)


def trace_segment(segs: DataFrame, probes: DataFrame) -> DataFrame:
    """The segment itself that each probe (0-based) falls on, of equal ones the last; it may have no source."""
    keep = [c for c in probes.columns if c not in ("map_id", "line", "col")]
    asked = probes.select("map_id", F.col("line").alias("gen_line"), F.col("col").alias("probe_at"), F.struct(*keep).alias("ask"))
    out = _asof(segs, asked, ["map_id", "gen_line"], "gen_col", ["seg_idx"], HIT, False, True)
    return out.select(*[F.col(f"ask.{c}").alias(c) for c in keep], F.col("hit.gen_col").alias("gen_col"), *[F.col(f"hit.{c}").alias(c) for c in PLACE])


def named(found: DataFrame, sources: DataFrame, names: DataFrame) -> DataFrame:
    """Looked-up positions that carry map_id with source and name for their indexes."""
    out = found.join(sources.select("map_id", "source_idx", "source"), ["map_id", "source_idx"], "left")
    return out.join(names.select("map_id", "name_idx", "name"), ["map_id", "name_idx"], "left").drop("source_idx", "name_idx")


def original_position_1based(segs: DataFrame, probes: DataFrame, sources: DataFrame, names: DataFrame, lub: bool = False) -> DataFrame:
    """The script libraries' form: lines count from 1, of equal segments the last counts (lub: the first), ranges don't.

    (probe_id, source, line, col, name), all null where nothing is found. Lines under 1 and columns under 0 are errors.
    """
    wrong = F.when((F.col("line") < 1) | (F.col("col") < 0), F.raise_error(F.lit("line must be greater than 0 and column not negative")))
    asked = probes.select("probe_id", "map_id", F.coalesce(wrong.cast("int"), F.col("line") - 1).alias("line"), "col", F.col("map_id").alias("of"))
    found = original_position(segs.drop("is_range"), asked, lub, True).withColumnRenamed("of", "map_id")
    out = named(found, sources, names)
    return out.select("probe_id", "source", F.when(F.col("source").isNotNull(), F.col("orig_line") + 1).alias("line"), F.when(F.col("source").isNotNull(), F.col("orig_col")).alias("col"), F.when(F.col("source").isNotNull(), F.col("name")).alias("name"))


def by_source(probes: DataFrame, sources: DataFrame) -> DataFrame:
    """Probes on a source's name with its index: the raw name first, otherwise the resolved one; of equal names the last."""
    both = sources.select("map_id", F.col("raw_source").alias("asked"), "source_idx", F.lit(1).alias("rank")).unionByName(sources.select("map_id", F.col("source").alias("asked"), "source_idx", F.lit(0).alias("rank")))
    index = both.groupBy("map_id", "asked").agg(F.max_by("source_idx", F.struct("rank", "source_idx")).alias("source_idx"))
    return probes.join(index, (probes.map_id == index.map_id) & (probes.source == index.asked)).select(probes["*"], "source_idx").drop("source")


def generated_position(segs: DataFrame, probes: DataFrame, lub: bool = False) -> DataFrame:
    """Probes (probe_id, map_id, source_idx, line, col) on original positions, further columns kept; only the same original line counts."""
    keep = [c for c in probes.columns if c not in ("map_id", "source_idx", "line", "col")]
    asked = probes.select("map_id", "source_idx", F.col("line").alias("orig_line"), F.col("col").alias("probe_at"), F.struct(*keep).alias("ask"))
    out = _asof(segs.where("source_idx is not null"), asked, ["map_id", "source_idx", "orig_line"], "orig_col", ["gen_line", "gen_col", "seg_idx"], ("gen_line", "gen_col"), lub)
    return out.select(*[F.col(f"ask.{c}").alias(c) for c in keep], F.col("hit.gen_line").alias("gen_line"), F.col("hit.gen_col").alias("gen_col"))


def all_generated_positions(segs: DataFrame, probes: DataFrame) -> DataFrame:
    asked = probes.select("probe_id", "map_id", "source_idx", F.col("line").alias("orig_line"), F.col("col").alias("orig_col"))
    return segs.join(asked, ["map_id", "source_idx", "orig_line", "orig_col"]).select("probe_id", "gen_line", "gen_col")


def map_range(segs: DataFrame, probes: DataFrame) -> DataFrame:
    """Probes (probe_id, map_id, line, col, end_line, end_col): both ends in one source, or no row. Both ends are looked up at once."""
    ends = F.array(F.struct(F.lit(0).alias("end"), "line", "col"), F.struct(F.lit(1).alias("end"), F.col("end_line").alias("line"), F.col("end_col").alias("col")))
    found = original_position(segs, probes.select("probe_id", "map_id", F.inline(ends)))
    at = lambda k, c: F.max(F.when(F.col("end") == k, F.col(c)))
    both = found.groupBy("probe_id").agg(at(0, "source_idx").alias("source_idx"), at(1, "source_idx").alias("s"), at(0, "orig_line").alias("start_line"), at(0, "orig_col").alias("start_col"), at(1, "orig_line").alias("end_line"), at(1, "orig_col").alias("end_col"))
    return both.where("source_idx = s").drop("s")


def each_mapping(segs: DataFrame, sources: DataFrame, names: DataFrame, original_order: bool = False) -> DataFrame:
    """All mappings with names, lines counted from 1, and their place in generated order (or by source, line and column)."""
    order = ["source_idx", "orig_line", "orig_col", "gen_line", "gen_col", "seg_idx"] if original_order else ["gen_line", "gen_col", "seg_idx"]
    rows = named(segs.withColumn("n", F.row_number().over(Window.partitionBy("map_id").orderBy(*order)) - 1), sources, names)
    return rows.select("map_id", "n", (F.col("gen_line") + 1).alias("generated_line"), F.col("gen_col").alias("generated_column"), "source", (F.col("orig_line") + 1).alias("original_line"), F.col("orig_col").alias("original_column"), "name")


def listing(segs: DataFrame, sources: DataFrame, names: DataFrame, map_id: object, source: str | None = None, offset: int = 0, limit: int = 50) -> DataFrame:
    """A page of one map's mappings in generated order, all or those of one source, each row with the total and whether more follow."""
    rows = named(segs.where(F.col("map_id") == map_id), sources, names)
    rows = rows if source is None else rows.where(F.col("source") == source)
    rows = rows.withColumn("total", F.count("*").over(Window.partitionBy("map_id")))
    page = rows.orderBy("gen_line", "gen_col", "seg_idx").offset(offset).limit(limit)
    return page.withColumn("has_more", F.col("total") > offset + limit)


def with_context(found: DataFrame, sources: DataFrame, lines: int) -> DataFrame:
    """Looked-up positions that carry map_id with the source's lines around them: context, from context_line on."""
    rows = found.join(sources.where("content is not null").select("map_id", "source_idx", "content"), ["map_id", "source_idx"], "left")
    text = F.split(F.regexp_replace("content", "\r\n?", "\n"), "\n", -1)
    first = F.greatest(F.col("orig_line") - lines, F.lit(0))
    return rows.withColumn("context_line", F.when(F.col("content").isNotNull(), first)).withColumn("context", F.slice(text, first + 1, F.col("orig_line") - first + lines + 1)).drop("content")
