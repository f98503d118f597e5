"""Checks, metadata projections and generation rules over the map tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.text import shared_parts


def validate_deep(segs: DataFrame, sources: DataFrame, names: DataFrame, ignores: DataFrame) -> DataFrame:
    """(map_id, warning, detail): disorder, indexes out of bounds, sources that no segment uses.

    sources (map_id, source_idx), names (map_id, name_idx), ignores (map_id, source_idx).
    """
    w = Window.partitionBy("map_id").orderBy("gen_line", "seg_idx")
    last = F.lag(F.struct("gen_line", "gen_col")).over(w)
    order = segs.withColumn("last", last).where("struct(gen_line, gen_col) < last").select("map_id", F.lit("order").alias("warning"), F.concat_ws(":", "gen_line", "gen_col").alias("detail"))
    out = order
    for rows, known, key, kind in ((segs, sources, "source_idx", "source"), (segs, names, "name_idx", "name"), (ignores, sources, "source_idx", "ignore")):
        used = rows.where(F.col(key).isNotNull()).select("map_id", key).distinct()
        out = out.unionByName(used.join(known, ["map_id", key], "left_anti").select("map_id", F.lit(kind).alias("warning"), F.col(key).cast("string").alias("detail")))
    idle = sources.select("map_id", "source_idx").join(segs.select("map_id", "source_idx"), ["map_id", "source_idx"], "left_anti")
    return out.unionByName(idle.select("map_id", F.lit("unreferenced").alias("warning"), F.col("source_idx").cast("string").alias("detail")))


def maybe_add(rows: DataFrame) -> DataFrame:
    """Skips a mapping whose predecessor has the same generated line, source and original position (names and columns don't count)."""
    w = Window.partitionBy("map_id").orderBy("ord")
    said = F.struct("gen_line", "source_idx", "orig_line", "orig_col")
    return rows.withColumn("skip", F.coalesce(F.lag(said).over(w).eqNullSafe(said), F.lit(False)) & F.col("source_idx").isNotNull()).where("not skip").drop("skip")


def flatten_sections(sections: DataFrame, segs: DataFrame) -> DataFrame:
    """Segments of sections (map_id, section_idx) moved by the offsets (line, column); columns move on a section's first line only."""
    rows = segs.join(sections.select("map_id", "section_idx", "line", "column"), ["map_id", "section_idx"])
    rows = rows.withColumn("gen_col", F.col("gen_col") + F.when(F.col("gen_line") == 0, F.col("column")).otherwise(0)).withColumn("gen_line", F.col("gen_line") + F.col("line"))
    w = Window.partitionBy("map_id", "gen_line").orderBy("gen_col", "section_idx", "seg_idx")
    return rows.withColumn("new_idx", F.row_number().over(w) - 1).drop("seg_idx", "line", "column").withColumnRenamed("new_idx", "seg_idx")


def section_errors(sections: DataFrame) -> DataFrame:
    """(map_id, kind) of indexed maps whose sections aren't strictly ascending, or hold sections themselves."""
    w = Window.partitionBy("map_id").orderBy("section_idx")
    at = F.struct("line", "column")
    kind = F.when(F.get_json_object("json", "$.sections").isNotNull(), "NestedIndexMap").when(F.lag(at).over(w) >= at, "SectionsNotOrdered")
    return sections.withColumn("kind", kind).where("kind is not null").groupBy("map_id").agg(F.min_by("kind", "section_idx").alias("kind"))


def prefix_of(sources: Column) -> Column:
    """The directories that all absolute paths of an array share, if there are two or more such paths and one such directory."""
    dirs = F.transform(F.filter(sources, lambda s: s.startswith("/")), lambda s: F.slice(F.split(s, "/"), F.lit(1), F.size(F.split(s, "/")) - 1))
    # Whatever all share, the smallest and the largest path share, and the reverse.
    low, high = F.array_min(dirs), F.array_max(dirs)
    n = shared_parts(low, high)
    return F.when((F.size(dirs) > 1) & (n > 1), F.concat(F.array_join(F.slice(low, F.lit(1), n), "/"), F.lit("/")))


def common_prefix(sources: DataFrame) -> DataFrame:
    """(map_id, prefix): the directories that all absolute paths of a map share, if there are two or more."""
    ends = sources.where("source like '/%'").groupBy("map_id").agg(F.min(F.split("source", "/")).alias("a"), F.max(F.split("source", "/")).alias("b"), F.count("*").alias("n")).where("n > 1")
    return ends.select("map_id", prefix_of(F.array(F.array_join("a", "/"), F.array_join("b", "/"))).alias("prefix")).where("prefix is not null")


def filter_extensions(fields: str = "fields") -> Column:
    """Of a map of fields those that begin with x_ or x-."""
    return F.map_filter(fields, lambda k, _: k.startswith("x_") | k.startswith("x-"))
