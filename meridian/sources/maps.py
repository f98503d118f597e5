"""Source maps as tables: parsing JSON to rows, indexed maps merged, and rows written as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.text import resolve_source
from meridian.operators.mappings import decode_mappings, mapping_errors

_BEFORE = "version int, file string, sourceRoot string, sources array<string>, "
_AFTER = "names array<string>, mappings string, ignoreList array<int>, x_google_ignoreList array<int>, debugId string, debug_id string, scopes string, rangeMappings string"
SCHEMA = f"{_BEFORE}sourcesContent array<string>, {_AFTER}"


def extensions(json: str = "json") -> Column:
    """The fields x_* and x-* of a JSON object, each as JSON."""
    own = f"map_filter(try_variant_get(try_parse_json({json}), '$', 'map<string,variant>'), (k, v) -> startswith(k, 'x_') or startswith(k, 'x-'))"
    return F.expr(f"transform_values({own}, (k, v) -> to_json(v))")


def parse(texts: DataFrame, content: bool = True) -> DataFrame:
    """(map_id, json) to one row per map; `error` says why a map has no other fields.

    content: without it neither the sources' texts nor the extensions are read, and indexed maps are errors.
    """
    shape = SCHEMA if content else _BEFORE + _AFTER
    rows = texts.select("map_id", "json", F.from_json("json", shape).alias("m"), F.get_json_object("json", "$.sections").isNotNull().alias("is_indexed"))
    bad = F.when(F.col("m").isNull() | (F.col("m.version").isNull() & ~F.col("is_indexed")) | F.try_parse_json("json").isNull(), "Json").when(F.col("m.version") != 3, "InvalidVersion")
    if not content:
        bad = bad.when(F.col("is_indexed"), "NestedIndexMap")
    more = [F.col("m.sourcesContent").alias("contents"), extensions().alias("extensions")] if content else [F.lit(None).cast("array<string>").alias("contents"), F.lit(None).cast("map<string,string>").alias("extensions")]
    # A list that is there but empty keeps the older field from counting.
    ignored = F.coalesce("m.ignoreList", "m.x_google_ignoreList")
    return rows.select("map_id", "is_indexed", "m.version", "m.file", F.col("m.sourceRoot").alias("source_root"), F.coalesce("m.sources", F.array().cast("array<string>")).alias("sources"), more[0], F.coalesce("m.names", F.array().cast("array<string>")).alias("names"), F.coalesce("m.mappings", F.lit("")).alias("mappings"), F.col("m.rangeMappings").alias("range_mappings"), ignored.alias("ignore_list"), F.coalesce("m.debugId", "m.debug_id").alias("debug_id"), F.col("m.scopes").alias("scopes"), more[1], F.octet_length("json").alias("raw_bytes"), F.when(F.length("m.mappings") > 0, F.size(F.split("m.mappings", ";", -1))).otherwise(0).alias("n_lines"), bad.alias("error"))


def checked(maps: DataFrame) -> DataFrame:
    """(map_id, ok, error, at): whether each parsed map reads as a whole, its mappings included."""
    found = mapping_errors(maps.where("error is null and not is_indexed").select("map_id", "mappings")).withColumnRenamed("kind", "vlq")
    out = maps.join(found, "map_id", "left")
    return out.select("map_id", F.coalesce("error", "vlq").isNull().alias("ok"), F.coalesce("error", "vlq").alias("error"), "at")


def sections(texts: DataFrame) -> DataFrame:
    """(map_id, section_idx, line, column, json) of indexed maps."""
    shape = "sections array<struct<offset:struct<line:int,column:int>,map:string>>"
    rows = texts.select("map_id", F.posexplode(F.from_json("json", shape)["sections"]).alias("section_idx", "s"))
    return rows.select("map_id", "section_idx", "s.offset.line", "s.offset.column", F.col("s.map").alias("json"))


def map_sources(maps: DataFrame) -> DataFrame:
    rows = maps.select("map_id", "source_root", "contents", "ignore_list", F.posexplode("sources").alias("source_idx", "raw_source"))
    return rows.select("map_id", "source_idx", "raw_source", resolve_source(F.col("source_root"), F.col("raw_source")).alias("source"), F.get("contents", F.col("source_idx")).alias("content"), F.coalesce(F.array_contains("ignore_list", F.col("source_idx")), F.lit(False)).alias("ignored"))


def map_names(maps: DataFrame) -> DataFrame:
    return maps.select("map_id", F.posexplode("names").alias("name_idx", "name"))


def segments(maps: DataFrame) -> DataFrame:
    """The segments of parsed maps, range flags included."""
    return decode_mappings(maps.where("error is null").select("map_id", "mappings", "range_mappings"))


def info(maps: DataFrame) -> DataFrame:
    """Counts of each parsed map: sources, those with content and its bytes, names, mappings, ranges, lines, bytes of JSON."""
    size = F.expr("cast(aggregate(coalesce(contents, cast(array() as array<string>)), 0L, (t, x) -> t + coalesce(octet_length(x), 0)) as bigint)")
    counts = segments(maps).groupBy("map_id").agg(F.count("*").alias("n_mappings"), F.count_if("is_range").alias("n_ranges"))
    out = maps.where("error is null").join(counts, "map_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("map_id", F.size("sources").alias("n_sources"), F.expr("size(filter(coalesce(contents, cast(array() as array<string>)), x -> x is not null))").alias("n_contents"), size.alias("content_bytes"), F.size("names").alias("n_names"), zero("n_mappings"), zero("n_ranges"), "n_lines", "raw_bytes")


def merged(parts: DataFrame, values: DataFrame, value: str, idx: str) -> tuple[DataFrame, DataFrame]:
    """Dictionaries of parts put together: each value once, in the order of its first use.

    parts (out_id, ord, map_id), values (map_id, idx, value). Gives (out_id, idx, value) and (out_id, ord, old idx as
    local_idx, new idx).
    """
    uses = parts.join(values.select("map_id", F.col(idx).alias("local_idx"), value), "map_id").select("out_id", "ord", "local_idx", value)
    first = uses.groupBy("out_id", value).agg(F.min(F.struct("ord", "local_idx")).alias("first"))
    dictionary = first.select("out_id", (F.row_number().over(Window.partitionBy("out_id").orderBy("first")) - 1).cast("int").alias(idx), value)
    index = uses.join(dictionary, ["out_id", value]).select("out_id", "ord", "local_idx", idx)
    return dictionary, index


def put_together(parts: DataFrame, segs: DataFrame, sources: DataFrame, names: DataFrame, last_content: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, sources and names of each out_id by its parts (out_id, ord, map_id, line, column).

    Lines are moved; columns only on a part's first line. Sources and names are merged by text in the order of their first
    mention; of a source's contents the first one counts (last_content: the last there is), and it is ignored if one part
    ignores it.
    """
    sources_of, source_index = merged(parts, sources, "source", "source_idx")
    names_of, name_index = merged(parts, names, "name", "name_idx")
    told = parts.join(sources.select("map_id", F.col("source_idx").alias("local_idx"), "source", "content", "ignored"), "map_id")
    at = F.struct("ord", "local_idx")
    content = F.max_by("content", F.when(F.col("content").isNotNull(), at)) if last_content else F.min_by("content", at)
    extra = told.groupBy("out_id", "source").agg(content.alias("content"), F.max("ignored").alias("ignored"))
    sources_of = sources_of.join(extra, ["out_id", "source"])
    rows = segs.join(parts.select("out_id", "ord", "map_id", "line", "column"), "map_id")
    rows = rows.withColumn("gen_col", F.col("gen_col") + F.when(F.col("gen_line") == 0, F.col("column")).otherwise(0)).withColumn("gen_line", F.col("gen_line") + F.col("line"))
    rows = rows.withColumnsRenamed({"source_idx": "s", "name_idx": "n"})
    rows = rows.join(source_index.withColumnRenamed("local_idx", "s"), ["out_id", "ord", "s"], "left").join(name_index.withColumnRenamed("local_idx", "n"), ["out_id", "ord", "n"], "left")
    w = Window.partitionBy("out_id", "gen_line").orderBy("gen_col", "ord", "seg_idx")
    rows = rows.withColumn("new_idx", (F.row_number().over(w) - 1).cast("int"))
    out = rows.select("out_id", "gen_line", F.col("new_idx").alias("seg_idx"), "gen_col", "source_idx", "orig_line", "orig_col", "name_idx", *[c for c in ("is_range",) if c in segs.columns])
    return out, sources_of.select("out_id", "source_idx", "source", "content", "ignored"), names_of.select("out_id", "name_idx", "name")


def merge_indexed(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Segments, sources and names of indexed maps (map_id, json), their sections flattened. Nested or disordered ones have none (see section_errors)."""
    cut = sections(texts)
    part = F.struct("map_id", "section_idx")
    inner = parse(cut.select(part.alias("map_id"), "json"))
    parts = cut.select(F.col("map_id").alias("out_id"), F.col("section_idx").alias("ord"), part.alias("map_id"), "line", "column")
    segs, sources, names = put_together(parts, segments(inner), map_sources(inner), map_names(inner))
    return tuple(x.withColumnRenamed("out_id", "map_id") for x in (segs, sources, names))


def kept_root(maps: DataFrame) -> Column:
    """The root if every source that isn't empty begins with it."""
    return F.when(F.forall("sources", lambda s: F.coalesce(s, F.lit("")).isin("") | s.startswith(F.col("source_root"))), F.col("source_root"))


def _quoted(x: Column) -> Column:
    """A JSON string: what to_json gives for the element of an array."""
    return F.substr(F.to_json(F.array(x)), F.lit(2), F.length(F.to_json(F.array(x))) - 2)


def to_json(maps: DataFrame, exclude_content: bool = False, generated: bool = False) -> DataFrame:
    """(map_id, json) in the fields' fixed order, extensions last and sorted.

    Empty fields but sources, names and mappings are left out. generated: as a generator writes it, with the ignore list
    before the range mappings and no extensions.
    """
    field = lambda k, c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f',"{k}":'), _quoted(F.col(c))))
    listed = lambda k, c: F.concat(F.lit(f',"{k}":'), F.to_json(F.coalesce(c, F.array().cast("array<string>")), {"ignoreNullFields": "false"}))
    some = F.exists("contents", lambda x: x.isNotNull())
    contents = F.when(F.coalesce(some, F.lit(False)) & F.lit(not exclude_content), listed("sourcesContent", "contents"))
    ranges = F.when(F.length("range_mappings") > 0, field("rangeMappings", "range_mappings"))
    ignores = F.when(F.size("ignore_list") > 0, F.concat(F.lit(',"ignoreList":'), F.to_json("ignore_list")))
    more = [] if generated else [F.array_join(F.transform(F.array_sort(F.map_entries("extensions")), lambda e: F.concat(F.lit(","), _quoted(e["key"]), F.lit(":"), e["value"])), "")]
    parts = [F.lit('{"version":3'), field("file", "file"), field("sourceRoot", "source_root"), listed("sources", "sources"), contents, listed("names", "names"), field("mappings", "mappings"), *((ignores, ranges) if generated else (ranges, ignores)), field("debugId", "debug_id"), field("scopes", "scopes"), *more, F.lit("}")]
    have = set(maps.columns)
    for c, kind in (("scopes", "string"), ("extensions", "map<string,string>"), ("debug_id", "string"), ("range_mappings", "string"), ("ignore_list", "array<int>"), ("contents", "array<string>"), ("file", "string"), ("source_root", "string")):
        if c not in have:
            maps = maps.withColumn(c, F.lit(None).cast(kind))
    return maps.select("map_id", F.concat_ws("", *parts).alias("json"))


def assembled(segs_text: DataFrame, sources: DataFrame, names: DataFrame, heads: DataFrame) -> DataFrame:
    """Maps ready for to_json: heads (map_id, file, ...) with encoded texts (map_id, mappings, range_mappings) and dictionaries as arrays."""
    in_order = lambda rows, idx, *cs: rows.groupBy("map_id").agg(F.array_sort(F.collect_list(F.struct(idx, *cs))).alias("x"))
    s = in_order(sources, "source_idx", "source", "content", "ignored")
    s = s.select("map_id", F.transform("x", lambda e: e["source"]).alias("sources"), F.transform("x", lambda e: e["content"]).alias("contents"), F.transform(F.filter("x", lambda e: e["ignored"]), lambda e: e["source_idx"]).alias("ignore_list"))
    n = in_order(names, "name_idx", "name").select("map_id", F.transform("x", lambda e: e["name"]).alias("names"))
    out = heads.join(segs_text, "map_id", "left").join(s, "map_id", "left").join(n, "map_id", "left")
    return out.withColumn("mappings", F.coalesce("mappings", F.lit(""))).withColumn("sources", F.coalesce("sources", F.array().cast("array<string>"))).withColumn("names", F.coalesce("names", F.array().cast("array<string>")))


def to_data_url(json: str = "json") -> Column:
    # Base 64 as one line, as the URL needs it.
    return F.concat(F.lit("data:application/json;base64,"), F.replace(F.base64(F.encode(json, "UTF-8")), F.lit("\r\n"), F.lit("")))


def rewrite_sources(maps: DataFrame, prefixes: tuple[str, ...] = (), with_names: bool = True, with_contents: bool = True) -> DataFrame:
    """Parsed maps with prefixes taken off their sources: `~` stands for the common directory, of the others the first that fits.

    Without names the names are gone (drop name_idx of the segments too); without contents each is null.
    """
    from meridian.operators.validate import prefix_of

    if "~" in prefixes:
        maps = maps.withColumn("__auto", prefix_of(F.col("sources")))
        maps = maps.withColumn("sources", F.transform("sources", lambda s: F.when(s.startswith(F.col("__auto")), F.substr(s, F.length("__auto") + 1)).otherwise(s))).drop("__auto")
    own = [p for p in prefixes if p != "~"]

    def strip(s: Column) -> Column:
        out = None
        for p in own:
            hit = s.startswith(p)
            out = F.when(hit, F.substr(s, F.lit(len(p) + 1))) if out is None else out.when(hit, F.substr(s, F.lit(len(p) + 1)))
        return s if out is None else out.otherwise(s)

    maps = maps.withColumn("sources", F.transform("sources", strip))
    if not with_names:
        maps = maps.withColumn("names", F.array().cast("array<string>"))
    if not with_contents:
        maps = maps.withColumn("contents", F.transform("contents", lambda x: F.lit(None).cast("string")))
    return maps


def write_contents(maps: DataFrame, path: str) -> DataFrame:
    """The sources that have a content and a safe path, written as Parquet by map; gives (map_id, path, content)."""
    from meridian.functions.text import safe_path

    rows = map_sources(maps).where("content is not null").select("map_id", safe_path(F.col("source")).alias("path"), "content").where("path is not null")
    # Of sources with one path the first is written.
    rows = rows.groupBy("map_id", "path").agg(F.min("content").alias("content"))
    rows.write.mode("errorifexists").parquet(path)
    return maps.sparkSession.read.schema(rows.schema).parquet(path)


def function_maps(maps: DataFrame) -> DataFrame:
    """(map_id, source_idx, names, mappings) of the field x_facebook_sources; of several for one source the first."""
    shape = "array<array<struct<names:array<string>,mappings:string>>>"
    rows = maps.select("map_id", F.posexplode(F.from_json(F.col("extensions")["x_facebook_sources"], shape)).alias("source_idx", "f"))
    return rows.where("size(f) > 0").select("map_id", "source_idx", F.col("f")[0]["names"].alias("names"), F.col("f")[0]["mappings"].alias("mappings"))


def module_fields(maps: DataFrame) -> DataFrame:
    """(map_id, offsets, paths, for_ram_bundle): the fields of bundles of modules."""
    offsets = F.from_json(F.col("extensions")["x_facebook_offsets"], "array<int>")
    return maps.select("map_id", offsets.alias("offsets"), F.from_json(F.col("extensions")["x_metro_module_paths"], "array<string>").alias("paths"), offsets.isNotNull().alias("for_ram_bundle"))


def write_json(maps: DataFrame, path: str, exclude_content: bool = False) -> None:
    """Each map as a line of text; JSON escapes line ends, so a line is a whole map."""
    to_json(maps, exclude_content).select("json").write.mode("errorifexists").text(path)


def with_fields(maps: DataFrame, **fields: Column) -> DataFrame:
    """Parsed maps with file, source_root, debug_id, ignore_list or sources set; a new root doesn't touch the sources, new sources are raw."""
    known = {"file", "source_root", "debug_id", "ignore_list", "sources"}
    if not fields.keys() <= known:
        raise ValueError(f"can be set: {sorted(known)}")
    return maps.withColumns(fields)
