"""Concatenation and composition of maps, and interning of their dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.text import safe_path
from meridian.operators.lookup import original_position
from meridian.operators.mappings import decode_mappings


def intern(uses: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, idx): each distinct value's index by its first use."""
    first = uses.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("first"))
    return first.select(key, value, (F.row_number().over(Window.partitionBy(key).orderBy("first")) - 1).cast("int").alias("idx"))


def concat_offsets(maps: DataFrame) -> DataFrame:
    """(bundle_id, map_id, offset) of maps (bundle_id, ord, map_id, n_lines): lines of all maps before."""
    before = Window.partitionBy("bundle_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    return maps.select("bundle_id", "map_id", F.coalesce(F.sum("n_lines").over(before), F.lit(0)).cast("int").alias("offset"))


def concat(maps: DataFrame, segs: DataFrame) -> DataFrame:
    """The segments of each bundle, generated lines moved by the offsets; source and name stay with map_id."""
    return segs.join(concat_offsets(maps), "map_id").withColumn("gen_line", F.col("gen_line") + F.col("offset")).drop("offset")


def drop_repeats(rows: DataFrame) -> DataFrame:
    """Skips what the candidate before on the line already says: a sourceless one after none or another, a sourced one after its equal."""
    w = Window.partitionBy("map_id", "gen_line").orderBy("seg_idx")
    said = F.struct("source", "orig_line", "orig_col", "name")
    last = F.lag(said).over(w)
    same = last.isNotNull() & (last["source"] == F.col("source")) & (last["orig_line"] == F.col("orig_line")) & (last["orig_col"] == F.col("orig_col")) & last["name"].eqNullSafe(F.col("name"))
    skip = F.when(F.col("source").isNull(), last.isNull() | last["source"].isNull()).otherwise(same)
    return rows.withColumn("skip", F.coalesce(skip, F.lit(False))).where("not skip").drop("skip")


def candidates(outer: DataFrame, edges: DataFrame, upstream: DataFrame, outer_names: DataFrame, names: DataFrame, sources: DataFrame) -> DataFrame:
    """What composition may write, repeats included: (map_id, gen_line, seg_idx, gen_col, source, orig_line, orig_col, name, is_range).

    edges (map_id, source_idx, upstream_id or null, source): a null upstream_id passes the source through.
    outer_names and names are (map_id, name_idx, name); sources is (map_id, source_idx, source) of upstream maps.
    A sourced segment that its upstream map can't place is dropped. The outer segment travels with its probe.
    """
    if "is_range" not in outer.columns:
        outer = outer.withColumn("is_range", F.lit(False))
    rows = outer.join(edges, ["map_id", "source_idx"], "left").join(outer_names.withColumnRenamed("name", "outer_name"), ["map_id", "name_idx"], "left")
    own = ("map_id", "gen_line", "seg_idx", "gen_col", "is_range", "outer_name")
    traced = rows.where("upstream_id is not null").select(F.struct(*own).alias("own"), F.col("upstream_id").alias("map_id"), F.col("orig_line").alias("line"), F.col("orig_col").alias("col"), F.col("upstream_id").alias("of"))
    hit = original_position(upstream, traced).where("source_idx is not null")
    found = hit.join(sources.select(F.col("map_id").alias("of"), "source_idx", "source"), ["of", "source_idx"], "left").join(names.select(F.col("map_id").alias("of"), "name_idx", "name"), ["of", "name_idx"], "left")
    out = ["map_id", "gen_line", "seg_idx", "gen_col", "source", "orig_line", "orig_col", "name", "is_range"]
    done = found.select(*[F.col(f"own.{c}").alias(c) for c in ("map_id", "gen_line", "seg_idx", "gen_col", "is_range")], F.nullif("source", F.lit("")).alias("source"), "orig_line", "orig_col", F.coalesce("name", "own.outer_name").alias("name"))
    rest = rows.where("upstream_id is null").select("map_id", "gen_line", "seg_idx", "gen_col", F.nullif("source", F.lit("")).alias("source"), "orig_line", "orig_col", F.col("outer_name").alias("name"), "is_range")
    bare = lambda c: F.when(F.col("source").isNotNull(), F.col(c)).alias(c)
    return done.select(*out).unionByName(rest.select(*out)).select("map_id", "gen_line", "seg_idx", "gen_col", "source", bare("orig_line"), bare("orig_col"), bare("name"), "is_range")


def remap(outer: DataFrame, edges: DataFrame, upstream: DataFrame, outer_names: DataFrame, names: DataFrame, sources: DataFrame) -> DataFrame:
    """Composes outer maps with the maps their sources come from (see candidates), repeats dropped."""
    return drop_repeats(candidates(outer, edges, upstream, outer_names, names, sources))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows of (map_id, gen_line, seg_idx, ...) with the places that are left counted anew."""
    w = Window.partitionBy("map_id", "gen_line").orderBy("seg_idx")
    return rows.withColumn("seg_idx", (F.row_number().over(w) - 1).cast("int"))


def remap_maps(outer: DataFrame, edges: DataFrame, upstream: DataFrame, outer_names: DataFrame, names: DataFrame, sources: DataFrame, outer_sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Composition as maps: segments with indexes, sources (map_id, source_idx, source, content, ignored) and names.

    Sources and names are those used, in the order of their first use. sources and outer_sources hold content and ignored;
    of a source's owners (upstream maps, and the outer map where it passes through) one with a content gives it.
    """
    every = candidates(outer, edges, upstream, outer_names, names, sources)
    at = F.struct("gen_line", "seg_idx")
    uses = every.withColumn("at", at)
    source_of = intern(uses, "map_id", "source", "at").withColumnRenamed("idx", "source_idx")
    name_of = intern(uses, "map_id", "name", "at").withColumnRenamed("idx", "name_idx")
    rows = numbered(drop_repeats(every)).join(source_of, ["map_id", "source"], "left").join(name_of, ["map_id", "name"], "left")
    through = edges.where("upstream_id is null").select("map_id", "source_idx").join(outer_sources, ["map_id", "source_idx"]).select("map_id", "source", "content", "ignored")
    traced = edges.where("upstream_id is not null").select("map_id", "upstream_id").distinct().join(sources.withColumnRenamed("map_id", "upstream_id"), "upstream_id").select("map_id", "source", "content", "ignored")
    owners = through.unionByName(traced).groupBy("map_id", "source").agg(F.min("content").alias("content"), F.max("ignored").alias("ignored"))
    held = source_of.join(owners, ["map_id", "source"], "left").select("map_id", "source_idx", "source", "content", F.coalesce("ignored", F.lit(False)).alias("ignored"))
    return rows.select("map_id", "gen_line", "seg_idx", "gen_col", "source_idx", "orig_line", "orig_col", "name_idx", "is_range"), held, name_of.select("map_id", "name_idx", "name")


def remap_text(texts: DataFrame, edges: DataFrame, upstream: DataFrame, outer_names: DataFrame, names: DataFrame, sources: DataFrame) -> DataFrame:
    """Composition of maps given as texts (map_id, mappings), read up to their first error; ranges aren't known there."""
    outer = decode_mappings(texts.select("map_id", "mappings"), partial=True).drop("is_range")
    return remap(outer, edges, upstream, outer_names, names, sources)


def pair_edges(outer_sources: DataFrame, inner: DataFrame) -> DataFrame:
    """Which inner map each outer source of a pair comes from: the one of its file's name, or, if it has no file, of the
    outer map's only source that isn't empty.

    outer_sources (map_id, source_idx, source), inner (map_id, file): pairs share their map_id.
    """
    filled = outer_sources.where("source != ''").groupBy("map_id").agg(F.count("*").alias("n"))
    rows = outer_sources.join(inner.select("map_id", "file", F.lit(True).alias("inner")), "map_id", "left").join(filled, "map_id", "left")
    hit = F.col("inner") & F.when(F.col("file").isNull(), (F.col("n") == 1) & (F.col("source") != "")).otherwise(F.col("file") == F.col("source"))
    return rows.select("map_id", "source_idx", F.when(F.coalesce(hit, F.lit(False)), F.col("map_id")).alias("upstream_id"), "source")


def remap_chain(levels: list[tuple[DataFrame, DataFrame, DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Chains of maps, the outermost level first, composed from the innermost pair outwards; chains share their map_id.

    A level is (segments, sources with content and ignored, names, heads (map_id, file)). The number of levels is the
    driver's loop; where a checkpoint folder is set, each level is written there, so plans don't grow with the depth. A
    composed map has the outer map's file. One level is given back as it is.
    """
    segs, sources, names, heads = levels[-1]
    written = segs.sparkSession.sparkContext.getCheckpointDir() or segs.sparkSession.conf.get("spark.checkpoint.dir", None)
    for outer, outer_sources, outer_names, outer_heads in reversed(levels[:-1]):
        edges = pair_edges(outer_sources, heads)
        segs, sources, names = remap_maps(outer, edges, segs, outer_names, names, sources, outer_sources)
        if written:
            segs, sources, names = segs.checkpoint(), sources.checkpoint(), names.checkpoint()
        heads = outer_heads
    return segs, sources, names


def resolve_edges(outer_sources: DataFrame, files: DataFrame, given: DataFrame | None = None) -> DataFrame:
    """The map file of each outer source: the one given for it, or else `<source>.map`, or else `<stem>.map`; sources that
    aren't safe paths pass through.

    outer_sources (map_id, source_idx, source), files (path, upstream_id), given (source, upstream_id).
    """
    path = safe_path(F.col("source"))
    named = outer_sources.select("map_id", "source_idx", "source", F.posexplode(F.array(F.concat(path, F.lit(".map")), F.concat(F.regexp_replace(path, "\\.[^./]*$", ""), F.lit(".map")))).alias("rank", "path"))
    found = named.join(files, "path").select("map_id", "source_idx", F.col("rank") + 1, "upstream_id").toDF("map_id", "source_idx", "rank", "upstream_id")
    if given is not None:
        found = found.unionByName(outer_sources.join(given, "source").select("map_id", "source_idx", F.lit(0).alias("rank"), "upstream_id"))
    best = found.groupBy("map_id", "source_idx").agg(F.min_by("upstream_id", F.struct("rank", "upstream_id")).alias("upstream_id"))
    return outer_sources.select("map_id", "source_idx", "source").join(best, ["map_id", "source_idx"], "left").select("map_id", "source_idx", "upstream_id", "source")
