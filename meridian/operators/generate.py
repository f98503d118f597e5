"""Making maps from rows that name their sources: dictionaries, order, decoded views, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.operators.compose import drop_repeats, intern, numbered
from meridian.operators.mappings import FIELDS, encode_maps
from meridian.sources.maps import assembled


def generate(rows: DataFrame, maybe: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, sources and names of added mappings (map_id, ord, gen_line, gen_col, source, orig_line, orig_col, name[, is_range]).

    Dictionaries are in the order of addition, segments by place and then by addition. A mapping without source has no
    original place and no name. maybe: what the mapping before on the line already says is left out.
    """
    if "is_range" not in rows.columns:
        rows = rows.withColumn("is_range", F.lit(False))
    has = F.col("source").isNotNull()
    rows = rows.withColumns({c: F.when(has, F.col(c)) for c in ("orig_line", "orig_col", "name")})
    source_of = intern(rows, "map_id", "source", "ord").withColumnRenamed("idx", "source_idx")
    name_of = intern(rows, "map_id", "name", "ord").withColumnRenamed("idx", "name_idx")
    place = Window.partitionBy("map_id", "gen_line").orderBy("gen_col", "ord")
    placed = rows.withColumn("seg_idx", (F.row_number().over(place) - 1).cast("int"))
    if maybe:
        placed = numbered(drop_repeats(placed))
    segs = placed.join(source_of, ["map_id", "source"], "left").join(name_of, ["map_id", "name"], "left")
    bare = lambda x: x.withColumn("content", F.lit(None).cast("string")).withColumn("ignored", F.lit(False))
    return segs.select("map_id", "gen_line", "seg_idx", *FIELDS, "is_range"), bare(source_of).select("map_id", "source_idx", "source", "content", "ignored"), name_of.select("map_id", "name_idx", "name")


def with_contents(sources: DataFrame, contents: DataFrame) -> DataFrame:
    """Sources with the contents and ignore marks set for them: contents (map_id, source, content, ignored)."""
    set_ = contents.groupBy("map_id", "source").agg(F.max("content").alias("c"), F.max("ignored").alias("i"))
    rows = sources.join(set_, ["map_id", "source"], "left")
    return rows.select("map_id", "source_idx", "source", F.coalesce("c", "content").alias("content"), F.coalesce("i", "ignored").alias("ignored"))


def parts(segs: DataFrame, sources: DataFrame, names: DataFrame, heads: DataFrame) -> DataFrame:
    """Generated maps without JSON around them: texts and dictionaries as columns, heads (map_id, file, ...) kept."""
    return assembled(encode_maps(segs), sources, names, heads)


def decoded(segs: DataFrame) -> DataFrame:
    """(map_id, lines): segments as arrays of 1, 4 or 5 numbers by line, lines without any as empty, none after the last."""
    sourced = F.col("source_idx").isNotNull()
    fields = F.when(sourced & F.col("name_idx").isNotNull(), F.array(*FIELDS)).when(sourced, F.array(*FIELDS[:4])).otherwise(F.array("gen_col"))
    lines = segs.groupBy("map_id", "gen_line").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", fields.alias("f")))), lambda x: x["f"]).alias("segs"))
    held = lines.groupBy("map_id").agg(F.map_from_entries(F.collect_list(F.struct("gen_line", "segs"))).alias("m"), F.max("gen_line").alias("last"))
    none = F.array().cast("array<array<int>>")
    return held.select("map_id", F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.coalesce(F.try_element_at("m", i), none)).alias("lines"))


def from_decoded(maps: DataFrame) -> DataFrame:
    """(map_id, lines) to segments."""
    rows = maps.select("map_id", F.posexplode("lines").alias("gen_line", "line")).select("map_id", "gen_line", F.posexplode("line").alias("seg_idx", "f"))
    return rows.select("map_id", "gen_line", "seg_idx", *[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(FIELDS)])


def content_for(sources: DataFrame, asked: DataFrame) -> DataFrame:
    """(map_id, name, content, ignored) of sources asked for by (map_id, name): by the raw name, or else by the resolved one."""
    both = sources.select("map_id", F.col("raw_source").alias("name"), F.lit(1).alias("rank"), "source_idx", "content", "ignored").unionByName(sources.select("map_id", F.col("source").alias("name"), F.lit(0).alias("rank"), "source_idx", "content", "ignored"))
    best = both.groupBy("map_id", "name").agg(F.max_by(F.struct("content", "ignored"), F.struct("rank", "source_idx")).alias("x"))
    return asked.join(best, ["map_id", "name"], "left").select("map_id", "name", "x.content", F.coalesce("x.ignored", F.lit(False)).alias("ignored"))


def statistics(segs: DataFrame, sources: DataFrame, names: DataFrame) -> DataFrame:
    """What a concatenation or composition made: mappings, sources and names of each map."""
    n = lambda x, c: x.groupBy("map_id").agg(F.count("*").alias(c))
    out = n(segs, "n_mappings").join(n(sources, "n_sources"), "map_id", "left").join(n(names, "n_names"), "map_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("map_id", "n_mappings", zero("n_sources"), zero("n_names"))


def tree_lines(scopes: DataFrame) -> DataFrame:
    """(map_id, what, id, line) of decoded scopes as an indented listing, in pre-order."""
    place = lambda k: F.concat_ws(":", f"{k}_line", f"{k}_col")
    label: Column = F.concat_ws(" ", F.coalesce("kind", F.lit("")), F.coalesce("name", F.lit("")), F.concat(place("start"), F.lit("-"), place("end")))
    return scopes.where("error is null").select("map_id", "what", "id", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.trim(label)).alias("line"))
