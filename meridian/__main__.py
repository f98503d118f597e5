"""Commands over many maps: python -m meridian VERB MAPS ..., MAPS being JSON files (a path or pattern), rows as JSON lines out.

map_id is the file's path. Positions count from 0, as in the tables; `resolve` looks upwards unless told otherwise.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import text
from meridian.operators import compose, lookup, mappings, scopes, symbolicate
from meridian.sources import maps

VERBS = ("info", "validate", "lookup", "resolve", "decode", "encode", "mappings", "concat", "remap", "symbolicate", "scopes", "sources", "schema")


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("map_id"), F.col("value").alias("json"))


def run(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    if o.verb == "schema":
        return spark.createDataFrame([(v,) for v in VERBS], "verb string")
    m = maps.parse(read(spark, o.maps))
    good = m.where("error is null and not is_indexed")
    segs, sources, names = maps.segments(good), maps.map_sources(good), maps.map_names(good)
    if o.verb == "info":
        return maps.info(m).withColumn("size", text.byte_size(F.col("raw_bytes")))
    if o.verb == "validate":
        return maps.checked(m)
    if o.verb == "lookup":
        probes = good.select("map_id", F.lit(o.line).alias("line"), F.lit(o.col).alias("col"), F.col("map_id").alias("of")).withColumn("probe_id", F.col("map_id"))
        found = lookup.original_position(segs, probes, o.bias == "lub").withColumnRenamed("of", "map_id")
        return lookup.named(lookup.with_context(found, sources, o.context), sources, names).drop("probe_id")
    if o.verb == "resolve":
        probes = good.select("map_id", F.lit(o.source).alias("source"), F.lit(o.line).alias("line"), F.lit(o.col).alias("col")).withColumn("probe_id", F.col("map_id"))
        return lookup.generated_position(segs, lookup.by_source(probes, sources), o.bias != "glb").withColumnRenamed("probe_id", "map_id")
    if o.verb == "decode":
        return segs
    if o.verb == "encode":
        return mappings.encode_maps(segs)
    if o.verb == "mappings":
        rows = lookup.named(segs, sources, names)
        return rows.orderBy("map_id", "gen_line", "seg_idx").offset(o.offset).limit(o.limit)
    if o.verb == "concat":
        lines = compose.concat_offsets(good.select(F.lit("bundle").alias("bundle_id"), F.col("map_id").alias("ord"), "map_id", "n_lines"))
        parts = lines.select(F.col("bundle_id").alias("out_id"), F.col("map_id").alias("ord"), "map_id", F.col("offset").alias("line"), F.lit(0).alias("column"))
        made = [x.withColumnRenamed("out_id", "map_id") for x in maps.put_together(parts, segs, sources, names, last_content=True)]
        heads = spark.createDataFrame([("bundle", o.file)], "map_id string, file string")
        return maps.to_json(maps.assembled(mappings.encode_maps(made[0]), made[1], made[2], heads))
    if o.verb == "remap":
        up = maps.parse(read(spark, o.upstream)).where("error is null")
        files = up.select(F.element_at(F.split("map_id", "/"), -1).alias("path"), F.col("map_id").alias("upstream_id"))
        edges = compose.resolve_edges(sources.select("map_id", "source_idx", "source"), files)
        made = compose.remap_maps(segs, edges, maps.segments(up), names, maps.map_names(up), maps.map_sources(up), sources)
        return maps.to_json(maps.assembled(mappings.encode_maps(made[0]), made[1], made[2], good.select("map_id", "file")))
    if o.verb == "symbolicate":
        traces = spark.read.text(o.stacks, wholetext=True).select(F.col("_metadata.file_path").alias("trace_id"), F.col("value").alias("stack"))
        functions = symbolicate.function_ranges(scopes.decode_scopes(good.select("map_id", "scopes", "names")))
        files = good.select(F.coalesce("file", F.regexp_replace(F.element_at(F.split("map_id", "/"), -1), "\\.map$", "")).alias("file"), "map_id")
        frames = symbolicate.symbolicate(text.stack_frames(traces), files, segs, sources, names, functions)
        return (symbolicate.json_stacks if o.json else symbolicate.format_stacks)(frames, text.stack_messages(traces))
    if o.verb == "scopes":
        return scopes.decode_scopes(good.select("map_id", "scopes", "names"))
    return sources.select("map_id", "source_idx", "source", F.col("content").isNotNull().alias("has_content"), F.coalesce(F.octet_length("content"), F.lit(0)).alias("content_size"), "ignored")


def arguments(args: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="meridian", description=__doc__)
    p.add_argument("verb", choices=VERBS)
    p.add_argument("maps", nargs="?")
    for name, kind, default in (("line", int, 0), ("col", int, 0), ("context", int, 0), ("offset", int, 0), ("limit", int, 50), ("source", str, None), ("bias", str, None), ("file", str, None), ("upstream", str, None), ("stacks", str, None)):
        p.add_argument(f"--{name}", type=kind, default=default)
    p.add_argument("--json", action="store_true")
    return p.parse_args(args)


def main(args: list[str]) -> int:
    o = arguments(args)
    spark = SparkSession.builder.appName("meridian").getOrCreate()
    out = run(spark, o)
    for row in out.toJSON().toLocalIterator():
        print(row)
    return int(o.verb == "validate" and not out.where("not ok").isEmpty())


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
