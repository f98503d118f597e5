"""Queries of whole maps: JSON, sections, ranges, composition, scopes, function maps, bundles and text, with SQL for DuckDB.

Maps are made from the given tables by SQL that both engines read, so the expected rows follow from arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import text, vlq
from meridian.operators import compose, generate, lookup, mappings, scopes, symbolicate, validate
from meridian.queries import ONE_OF, PROBES, SEGS, asof_sql
from meridian.sources import maps, ram_bundle

#: One map per supplier; its mappings say what VALUES lists.
MAPPINGS = "AAAA;AACA,EAAEA;;ACAF"
VALUES = "(values (0, 0, 0, 0, 0, 0, cast(null as int)), (1, 0, 0, 0, 1, 0, null), (1, 1, 2, 0, 1, 2, 0), (3, 0, 0, 1, 1, 0, null)) v(gen_line, seg_idx, gen_col, source_idx, orig_line, orig_col, name_idx)"
JSON = f"""(select s_suppkey as map_id, concat('{{"version":3,"file":"f', s_suppkey, '.js"', case when s_suppkey % 2 = 0 then ',"sourceRoot":"src/"' else '' end, ',"sources":["a', s_suppkey % 3, '.ts","lib/b.ts"],"sourcesContent":["let x', s_suppkey, ';",null],"names":["n', s_suppkey % 5, '"],"mappings":"{MAPPINGS}"', case when s_suppkey % 3 = 0 then ',"rangeMappings":"A;B"' else '' end, case when s_suppkey % 4 = 0 then ',"ignoreList":[1]' else '' end, case when s_suppkey % 5 = 0 then concat(',"debugId":"id', s_suppkey % 7, '"') else '' end, ',"x_tool":{{"k":', s_suppkey, '}}}}') as json from supplier)"""
BROKEN = f"""(select map_id, case when map_id % 11 = 0 then replace(json, '"version":3', '"version":2') when map_id % 13 = 0 then left(json, 40) when map_id % 17 = 0 then replace(json, '"version":3,', '') when map_id % 19 = 0 then replace(json, 'EAAEA', 'EAA') else json end as json from {JSON} j)"""
INDEXED = f"""(select map_id, concat('{{"version":3,"sections":[{{"offset":{{"line":0,"column":0}},"map":', json, '}},{{"offset":{{"line":', case when map_id % 23 = 0 then 0 else 5 end, ',"column":', case when map_id % 23 = 0 then 0 else 3 end, '}},"map":{{"version":3,"sources":["new.ts","lib/b.ts"],"names":["m"],"mappings":"{MAPPINGS}"}}}}]}}') as json from {JSON} j)"""
ROOT = "case when map_id % 2 = 0 then 'src/' else '' end"
SOURCE = f"case when source_idx = 0 then {ROOT} || 'a' || (map_id % 3) || '.ts' else {ROOT} || 'lib/b.ts' end"
SCOPES = "BFAAA,CDB,EGAA,FF"
FUNCTIONS = "AAA,ECA,GAC"
RANGED = f"(select *, coalesce(gen_col % 5 = 0 and source_idx is not null, false) as is_range from {SEGS} r)"


def _view(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def _sql(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    _view(spark, sf_dir, *tables)
    return spark.sql(f"select * from {sql} q")


def _parsed(spark: SparkSession, sf_dir: str, sql: str = JSON) -> DataFrame:
    return maps.parse(_sql(spark, sf_dir, sql, "supplier"))


def _ranged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, RANGED, "lineitem")


def parsed_maps(spark, sf_dir):
    m = _parsed(spark, sf_dir, BROKEN)
    return m.select("map_id", F.when(F.col("error").isNull(), F.col("file")).alias("file"), F.when(F.col("error").isNull(), F.col("source_root")).alias("source_root"), F.when(F.col("error").isNull(), F.col("debug_id")).alias("debug_id"), "error")


def parsed_without_content(spark, sf_dir):
    m = maps.parse(_sql(spark, sf_dir, JSON, "supplier"), content=False)
    return m.select("map_id", F.size("sources").cast("long").alias("n_sources"), F.col("contents").isNull().alias("bare"), "error")


def checked_maps(spark, sf_dir):
    return maps.checked(_parsed(spark, sf_dir, BROKEN)).select("map_id", "ok", "error")


def listed_sources(spark, sf_dir):
    return maps.map_sources(_parsed(spark, sf_dir)).select("map_id", "source_idx", "source", "content", "ignored")


def listed_names(spark, sf_dir):
    return maps.map_names(_parsed(spark, sf_dir))


def map_counts(spark, sf_dir):
    out = maps.info(_parsed(spark, sf_dir))
    return out.select("map_id", *[F.col(c).cast("long").alias(c) for c in out.columns[1:]], text.byte_size(F.col("raw_bytes") * 100).alias("size"))


def written_maps(spark, sf_dir):
    m = _parsed(spark, sf_dir)
    segs = maps.segments(m)
    return maps.to_json(m.drop("mappings", "range_mappings").join(mappings.encode_maps(segs), "map_id"))


def generated_maps(spark, sf_dir):
    m = _parsed(spark, sf_dir)
    heads = m.select("map_id", "file", "source_root", "debug_id")
    sources = maps.map_sources(m).select("map_id", "source_idx", F.col("raw_source").alias("source"), "content", "ignored")
    out = maps.assembled(mappings.encode_maps(maps.segments(m)), sources, maps.map_names(m), heads)
    return maps.to_json(out, exclude_content=True, generated=True)


def data_urls(spark, sf_dir):
    j = _sql(spark, sf_dir, JSON, "supplier")
    plain = F.concat(F.lit(text.PLAIN_PREFIX), F.replace(F.replace("json", F.lit('"'), F.lit("%22")), F.lit("{"), F.lit("%7b")))
    url = F.when(F.col("map_id") % 2 == 0, maps.to_data_url()).otherwise(plain)
    return j.select("map_id", text.from_data_url(url).alias("json"))


def script_urls(spark, sf_dir):
    j = _sql(spark, sf_dir, JSON, "supplier")
    own = F.when(F.col("map_id") % 3 == 0, F.concat(F.lit("/*# sourceMappingURL=b"), "map_id", F.lit(".map */\nend();"))).when(F.col("map_id") % 3 == 1, F.concat(F.lit("//# sourceMappingURL="), maps.to_data_url())).otherwise("no more")
    found = text.sourcemap_url(F.concat(F.lit("run();\n//@ sourceMappingURL=first.map\n"), own))
    return j.select("map_id", found["kind"].alias("kind"), found["value"].alias("value"))


def sniffed_maps(spark, sf_dir):
    return _sql(spark, sf_dir, BROKEN, "supplier").select("map_id", text.is_sourcemap(F.col("json")).alias("is_map"))


def flattened_sections(spark, sf_dir):
    segs, sources, names = maps.merge_indexed(_sql(spark, sf_dir, INDEXED, "supplier"))
    out = lookup.named(segs, sources, names)
    return out.select("map_id", "gen_line", "gen_col", "source", "orig_line", "orig_col", "name", "is_range")


def section_dictionaries(spark, sf_dir):
    return maps.merge_indexed(_sql(spark, sf_dir, INDEXED, "supplier"))[1]


def section_faults(spark, sf_dir):
    return validate.section_errors(maps.sections(_sql(spark, sf_dir, INDEXED, "supplier")))


def concat_maps(spark, sf_dir):
    m = _parsed(spark, sf_dir)
    offsets = compose.concat_offsets(m.selectExpr("map_id % 10 as bundle_id", "map_id as ord", "map_id", "n_lines"))
    parts = offsets.selectExpr("bundle_id as out_id", "map_id as ord", "map_id", "offset as line", "0 as column")
    segs, sources, names = maps.put_together(parts, maps.segments(m), maps.map_sources(m), maps.map_names(m), last_content=True)
    rows = segs.withColumnRenamed("out_id", "map_id").join(sources.withColumnRenamed("out_id", "map_id"), ["map_id", "source_idx"]).join(names.withColumnRenamed("out_id", "map_id"), ["map_id", "name_idx"], "left")
    return rows.select("map_id", "gen_line", "gen_col", "source_idx", "source", "content", "ignored", "name")


def ranges_round_trip(spark, sf_dir):
    return mappings.decode_mappings(mappings.encode_maps(_ranged(spark, sf_dir)))


def lookup_ranged_glb(spark, sf_dir):
    return lookup.original_position(_ranged(spark, sf_dir), _sql(spark, sf_dir, PROBES, "events", "supplier"))


def lookup_ranged_lub(spark, sf_dir):
    return lookup.original_position(_ranged(spark, sf_dir), _sql(spark, sf_dir, PROBES, "events", "supplier"), lub=True)


def lookup_js_glb(spark, sf_dir):
    return lookup.original_position(_sql(spark, sf_dir, SEGS, "lineitem"), _sql(spark, sf_dir, PROBES, "events", "supplier"), js=True)


def lookup_js_lub(spark, sf_dir):
    return lookup.original_position(_sql(spark, sf_dir, SEGS, "lineitem"), _sql(spark, sf_dir, PROBES, "events", "supplier"), lub=True, js=True)


def traced_segments(spark, sf_dir):
    return lookup.trace_segment(_sql(spark, sf_dir, SEGS, "lineitem"), _sql(spark, sf_dir, PROBES, "events", "supplier"))


def lookup_1based(spark, sf_dir):
    m = _parsed(spark, sf_dir)
    probes = _sql(spark, sf_dir, f"(select event_id as probe_id, {ONE_OF} as map_id, cast(event_id % 6 + 1 as int) as line, cast(event_id % 4 as int) as col from events)", "events", "supplier")
    return lookup.original_position_1based(maps.segments(m), probes, maps.map_sources(m), maps.map_names(m))


def lookup_by_source(spark, sf_dir):
    m = _parsed(spark, sf_dir)
    probes = _sql(spark, sf_dir, f"(select event_id as probe_id, {ONE_OF} as map_id, case when event_id % 2 = 0 then 'lib/b.ts' else 'src/lib/b.ts' end as source, 1 as line, cast(event_id % 3 as int) as col from events)", "events", "supplier")
    return lookup.generated_position(maps.segments(m), lookup.by_source(probes, maps.map_sources(m)))


def lookup_context(spark, sf_dir):
    m = _parsed(spark, sf_dir)
    probes = _sql(spark, sf_dir, "(select s_suppkey as probe_id, s_suppkey as map_id, 0 as line, 0 as col from supplier)", "supplier").withColumn("of", F.col("map_id"))
    found = lookup.original_position(maps.segments(m), probes).withColumnRenamed("of", "map_id")
    return lookup.with_context(found, maps.map_sources(m), 2).select("map_id", "context_line", F.array_join("context", "|").alias("context"))


def each_mapping(spark, sf_dir):
    m = _parsed(spark, sf_dir)
    return lookup.each_mapping(maps.segments(m), maps.map_sources(m), maps.map_names(m))


def mapping_page(spark, sf_dir):
    m = _parsed(spark, sf_dir)
    page = lookup.listing(maps.segments(m), maps.map_sources(m), maps.map_names(m), 2, None, 1, 2)
    return page.select("gen_line", "gen_col", "source", "total", "has_more")


def partial_lines(spark, sf_dir):
    m = mappings.encode_mappings(_sql(spark, sf_dir, SEGS, "lineitem"))
    return mappings.decode_mappings(m, lines=(10, 20)).drop("is_range")


def line_counts(spark, sf_dir):
    return mappings.line_offsets(_sql(spark, sf_dir, SEGS, "lineitem"))


def decode_errors(spark, sf_dir):
    bad = "(select s_suppkey as map_id, case s_suppkey % 7 when 0 then 'AAAA,AC' when 1 then 'AAAA;AA!A' when 2 then 'AAAA,g' when 3 then 'A,ggggggggggggggA' when 4 then 'ACA,AAAA' when 5 then 'Ag,AAAA' else 'AAAA' end as mappings from supplier)"
    return mappings.mapping_errors(_sql(spark, sf_dir, bad, "supplier"))


def read_until_error(spark, sf_dir):
    bad = "(select s_suppkey as map_id, case when s_suppkey % 2 = 0 then 'AAAA;AACA,AC;AACA' else 'AAAA;AACA' end as mappings from supplier)"
    return mappings.decode_mappings(_sql(spark, sf_dir, bad, "supplier"), partial=True).select("map_id", "gen_line", "gen_col", "orig_line")


def vlq_values(spark, sf_dir):
    v = _sql(spark, sf_dir, "(select l_orderkey * 1000003 * (l_linenumber % 2 * 2 - 1) as v, l_orderkey as u from lineitem)", "lineitem").distinct()
    out = v.select("v", "u", vlq.vlq_encode(F.col("v")).alias("t"), vlq.vlq_encode_unsigned(F.col("u")).alias("n"))
    return out.select("v", "u", vlq.vlq_signed(F.col("t")).alias("back"), vlq.vlq_unsigned(F.col("n")).alias("u_back"), F.length("n").alias("n_digits"))


def vlq_errors(spark, sf_dir):
    rows = _sql(spark, sf_dir, "(select s_suppkey as id, case s_suppkey % 4 when 0 then 'gA' when 1 then 'g!' when 2 then 'gg' else 'gggggggggggggA' end as t from supplier)", "supplier")
    return rows.select("id", vlq.vlq_error(F.col("t")).alias("kind"))


def _remap_inputs(spark, sf_dir):
    segs = _sql(spark, sf_dir, SEGS, "lineitem")
    edges = segs.where("source_idx is not null").select("map_id", "source_idx").distinct().selectExpr("map_id", "source_idx", "case when source_idx < 4 then map_id % 10 + 1 end as upstream_id", "case when source_idx = 5 then '' else concat('s', source_idx) end as source")
    of = lambda c, k: segs.where(f"{c} is not null").select("map_id", c).distinct().withColumn("name" if c == "name_idx" else "source", F.concat(F.lit(k), c))
    return segs.withColumn("orig_line", (F.col("orig_line") % 70).cast("int")), edges, segs, of("name_idx", "o"), of("name_idx", "u"), of("source_idx", "up")


def remapped(spark, sf_dir):
    return compose.remap(*_remap_inputs(spark, sf_dir)).drop("is_range")


def remapped_sources(spark, sf_dir):
    outer, edges, up, on, un, us = _remap_inputs(spark, sf_dir)
    told = lambda x: x.withColumn("content", F.lit(None).cast("string")).withColumn("ignored", F.col("source").endswith("1"))
    return compose.remap_maps(outer, edges, up, on, un, told(us), told(edges.select("map_id", "source_idx", "source")))[1].drop("content")


def remapped_chain(spark, sf_dir):
    """Three levels: each line's mapping goes one line on in the next, and the innermost file names the source."""

    def level(file, source, mapping):
        base = _sql(spark, sf_dir, f"(select s_suppkey as map_id, '{mapping}' as mappings from supplier)", "supplier")
        ids = base.select("map_id")
        sources = ids.select("map_id", F.lit(0).alias("source_idx"), F.lit(source).alias("source"), F.lit("text").alias("content"), F.lit(False).alias("ignored"))
        names = ids.where("false").select("map_id", F.lit(0).alias("name_idx"), F.lit("").alias("name"))
        return mappings.decode_mappings(base).drop("is_range"), sources, names, ids.select("map_id", F.lit(file).alias("file"))

    segs, sources, _ = compose.remap_chain([level("out.js", "mid.js", "AAAA;AACA"), level("mid.js", "in.js", "AACA;AACA;AACA"), level(None, "a.ts", "AACA;AACA;AACA;AACA")])
    return segs.join(sources, ["map_id", "source_idx"]).select("map_id", "gen_line", "gen_col", "source", "orig_line", "content")


def resolved_edges(spark, sf_dir):
    m = _parsed(spark, sf_dir)
    files = spark.createDataFrame([("a0.ts.map", 1), ("a0.map", 2), ("a1.map", 3), ("src/lib/b.map", 4)], "path string, upstream_id long")
    given = spark.createDataFrame([("lib/b.ts", 9)], "source string, upstream_id long")
    return compose.resolve_edges(maps.map_sources(m).select("map_id", "source_idx", "source"), files, given)


def kept_additions(spark, sf_dir):
    rows = _sql(spark, sf_dir, f"(select map_id, gen_line * 1000000 + seg_idx as ord, gen_line, gen_col, source_idx % 2 as source_idx, orig_line % 2 as orig_line, orig_col % 2 as orig_col from {SEGS} s)", "lineitem")
    return validate.maybe_add(rows).select("map_id", "ord")


def rewritten_sources(spark, sf_dir):
    m = _parsed(spark, sf_dir).withColumn("sources", F.array(F.concat(F.lit("/p/q/a"), "map_id"), F.lit("/p/q/r/b"), F.lit("webpack:///c")))
    out = maps.rewrite_sources(m, ("~", "webpack:///"), with_names=False, with_contents=False)
    return out.select("map_id", F.array_join("sources", ",").alias("sources"), F.size("names").alias("n_names"), F.size("contents").alias("n_contents"))


def common_prefixes(spark, sf_dir):
    rows = _sql(spark, sf_dir, "(select s_suppkey as map_id, concat('/r', s_suppkey % 4, '/d', s_suppkey % 3, '/a.ts') as source from supplier union all select s_suppkey, concat('/r', s_suppkey % 2, '/d', s_suppkey % 3, '/e/b.ts') from supplier union all select s_suppkey, 'x.ts' from supplier)", "supplier")
    return validate.common_prefix(rows)


def path_functions(spark, sf_dir):
    rows = _sql(spark, sf_dir, "(select s_suppkey as id, concat('/a/b', s_suppkey % 3, '/c.js') as base, concat('/a/b', s_suppkey % 2, '/d/e.js') as target, concat('x/./y', s_suppkey, '/../z/') as loose from supplier)", "supplier")
    url = F.concat(F.lit("https://H.example:443/p"), "base")
    return rows.select("id", text.relative_path(F.col("base"), F.col("target")).alias("relative"), text.normalized_path(F.col("loose")).alias("normal"), text.resolved_map_path(F.col("base"), F.lit("../m.map")).alias("map_path"), text.resolved_url(url, F.lit("../m.map?v=1")).alias("url"), text.same_origin(url, F.lit("https://h.example/q")).alias("same"), text.safe_path(F.concat(F.lit("webpack:///./"), "loose")).alias("unsafe"), text.safe_path(F.concat(F.lit("file://s"), "id", F.lit(".ts"))).alias("safe"))


def identifiers(spark, sf_dir):
    rows = _sql(spark, sf_dir, "(select s_suppkey as id, case s_suppkey % 4 when 0 then concat('$f', s_suppkey) when 1 then concat(s_suppkey, 'x') when 2 then 'é_1 (x)' else '' end as t from supplier)", "supplier")
    return rows.select("id", text.is_identifier(F.col("t")).alias("whole"), text.leading_identifier(F.col("t")).alias("head"))


def kept_extensions(spark, sf_dir):
    m = _parsed(spark, sf_dir).select("map_id", F.map_concat("extensions", F.create_map(F.lit("y"), F.lit("1"))).alias("fields"))
    return m.select("map_id", F.explode(validate.filter_extensions()).alias("k", "v"))


def byte_offsets(spark, sf_dir):
    docs = _sql(spark, sf_dir, "(select doc_id as asset_id, text, doc_id * 37 % (n_chars + 1) as p from documents where text is not null)", "documents")
    offsets = docs.select(F.col("asset_id").alias("probe_id"), "asset_id", F.octet_length(F.expr("left(text, cast(p as int))")).alias("offset"))
    return text.offset_positions(docs.select("asset_id", "text"), offsets).select("probe_id", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"))


def offset_originals(spark, sf_dir):
    docs = _sql(spark, sf_dir, "(select doc_id as asset_id, text, doc_id % 60 as p from documents where length(text) > 60)", "documents")
    offsets = docs.select(F.col("asset_id").alias("probe_id"), "asset_id", F.octet_length(F.expr("left(text, cast(p as int))")).alias("offset"), F.col("asset_id").alias("map_id"))
    at = text.offset_positions(docs.select("asset_id", "text"), offsets)
    segs = mappings.decode_mappings(docs.select(F.col("asset_id").alias("map_id"), F.lit(MAPPINGS).alias("mappings"))).drop("is_range")
    return lookup.original_position(segs, at).select("probe_id", "source_idx", "orig_line", "orig_col")


def line_slices(spark, sf_dir):
    docs = _sql(spark, sf_dir, "(select doc_id as asset_id, concat('😀', text) as text from documents where text is not null)", "documents")
    probes = docs.selectExpr("asset_id as probe_id", "asset_id", "0 as line", "cast(asset_id % 4 as int) as col", "5 as span")
    return text.line_slices(docs, probes)


def decoded_scopes(spark, sf_dir):
    rows = _sql(spark, sf_dir, f"(select s_suppkey as map_id, case when s_suppkey % 9 = 0 then 'BAAA' else '{SCOPES}' end as scopes, array(concat('fn', s_suppkey)) as names from supplier)", "supplier")
    return scopes.decode_scopes(rows).select("map_id", "what", "id", "start_line", "start_col", "end_line", "end_col", "name", "is_stack_frame", "definition", "error")


def scopes_round_trip(spark, sf_dir):
    rows = _sql(spark, sf_dir, "(select s_suppkey as map_id, 'BHCAAC,DCC,BAAB,CAB,CDB,,BAAA,CAC,EDBAA,GCAD,HACAC,ICDE,EGAA,FB,FBA' as scopes, array('f', 'function', concat('v', s_suppkey)) as names from supplier)", "supplier")
    back = scopes.encode_scopes(scopes.decode_scopes(rows), rows.select("map_id", "names", F.lit(3).alias("n_sources")))
    return back.select("map_id", "scopes", F.size("names").alias("n_names"))


def scope_definitions(spark, sf_dir):
    rows = _sql(spark, sf_dir, f"(select s_suppkey as map_id, '{SCOPES}' as scopes, array(concat('fn', s_suppkey)) as names from supplier)", "supplier")
    out = symbolicate.function_ranges(scopes.decode_scopes(rows))
    return out.select("map_id", "range_id", "name", F.col("end.col").alias("end_col"))


def symbolicated_scopes(spark, sf_dir):
    m = _parsed(spark, sf_dir)
    rows = m.select("map_id", F.lit(SCOPES).alias("scopes"), F.array(F.concat(F.lit("fn"), "map_id")).alias("names"))
    functions = symbolicate.function_ranges(scopes.decode_scopes(rows))
    frames = _sql(spark, sf_dir, "(select event_id as trace_id, 0 as frame_no, 'own' as function_name, concat('f', user_id % ((select count(*) from supplier) + 3), '.js') as file, 1 as line, cast(event_id % 9 + 1 as int) as col from events)", "events", "supplier")
    return symbolicate.symbolicate(frames, m.select("file", "map_id"), maps.segments(m), maps.map_sources(m), maps.map_names(m), functions)


def json_stacks(spark, sf_dir):
    frames = _sql(spark, sf_dir, "(select s_suppkey as trace_id, 0 as frame_no, cast(null as string) as function_name, concat('f', s_suppkey, '.js') as file, 1 as line, 2 as col, true as symbolicated from supplier)", "supplier")
    messages = frames.select("trace_id", F.lit("Error: e").alias("message"))
    return symbolicate.json_stacks(frames, messages)


def stack_texts(spark, sf_dir):
    frames = _sql(spark, sf_dir, "(select s_suppkey as trace_id, 0 as frame_no, concat('g', s_suppkey) as function_name, concat('f', s_suppkey, '.js') as file, 1 as line, 2 as col, true as symbolicated from supplier)", "supplier")
    return symbolicate.format_stacks(frames, frames.select("trace_id", F.lit("Error: e").alias("message")))


def eval_frames(spark, sf_dir):
    traces = _sql(spark, sf_dir, "(select event_id as trace_id, case event_id % 3 when 0 then concat('Error: e\n    at eval (eval at bar (a.js:1:2), <anonymous>:', event_id, ':4)') when 1 then 'TypeError\n    at foo (bundle.js:10)\n    at new Foo (b.js:3:4)' else '@x.js:1:99999999999999\nf@y.js:5:6' end as stack from events)", "events", "supplier")
    return text.stack_frames(traces)


def stack_messages(spark, sf_dir):
    traces = _sql(spark, sf_dir, "(select event_id as trace_id, case event_id % 2 when 0 then concat('Error: e', user_id, '\n    at a.js:1:2') else 'f@y.js:5:6' end as stack from events)", "events", "supplier")
    return text.stack_messages(traces)


def debug_ids(spark, sf_dir):
    return symbolicate.by_debug_id(_parsed(spark, sf_dir))


def hermes_functions(spark, sf_dir):
    m = _sql(spark, sf_dir, "(select s_suppkey as map_id, 0 as source_idx, case when s_suppkey % 8 = 0 then 'AA,ECA' else 'AAA,ECA,GAC' end as mappings from supplier)", "supplier")
    return symbolicate.decode_hermes(m)


def hermes_names(spark, sf_dir):
    ext = f"""(select map_id, concat(left(json, length(json) - 1), ',"x_facebook_sources":[[{{"names":["top","low"],"mappings":"{FUNCTIONS}"}}],null]}}') as json from {JSON} j)"""
    m = _parsed(spark, sf_dir, ext)
    functions = maps.function_maps(m)
    probes = _sql(spark, sf_dir, f"(select event_id as probe_id, {ONE_OF} as map_id, cast(event_id % 4 as int) as line, cast(event_id % 5 as int) as col from events)", "events", "supplier")
    return symbolicate.hermes_names(maps.segments(m).drop("is_range"), symbolicate.decode_hermes(functions), functions.select("map_id", "source_idx", "names"), probes)


def ram_modules(spark, sf_dir):
    code = "hex(encode(concat('m', s_suppkey + 1000000), 'UTF-8'))"
    rows = _sql(spark, sf_dir, f"(select s_suppkey as bundle_id, unhex(concat(case when s_suppkey % 6 = 0 then '00000000' else 'E5D10BFB' end, '03000000', '04000000', '0000000008000000', '0000000000000000', '0800000003000000', hex('init'), {code}, hex('end'))) as content from supplier)", "supplier")
    return ram_bundle.modules(rows)



_ADDED = f"(select map_id, gen_line * 1000000 + (case when gen_line % 2 = 0 then seg_idx else 999 - seg_idx end) as ord, gen_line, gen_col, 's' || (source_idx % 3) as source, orig_line % 4 as orig_line, orig_col % 2 as orig_col, 'n' || name_idx as name from {SEGS} s)"


def generated_rows(spark, sf_dir):
    segs, sources, names = generate.generate(_sql(spark, sf_dir, _ADDED, "lineitem"))
    return lookup.named(segs, sources, names).drop("is_range")


def generated_dictionaries(spark, sf_dir):
    return generate.generate(_sql(spark, sf_dir, _ADDED, "lineitem"))[1].select("map_id", "source_idx", "source")


def generated_maybe(spark, sf_dir):
    segs, sources, names = generate.generate(_sql(spark, sf_dir, _ADDED, "lineitem"), maybe=True)
    return lookup.named(segs, sources, names).select("map_id", "gen_line", "gen_col", "source", "orig_line", "orig_col", "name")


def generated_parts(spark, sf_dir):
    m = _parsed(spark, sf_dir)
    sources = generate.with_contents(maps.map_sources(m).withColumn("content", F.lit(None).cast("string")), m.select("map_id", F.lit("lib/b.ts").alias("source"), F.lit("B").alias("content"), F.lit(True).alias("ignored")))
    out = generate.parts(maps.segments(m), sources, maps.map_names(m), m.select("map_id", "file"))
    return out.select("map_id", "file", "mappings", "range_mappings", F.array_join("sources", ",").alias("sources"), F.array_join("contents", ",").alias("contents"), F.array_join("ignore_list", ",").alias("ignored"), F.array_join("names", ",").alias("names"))


def decoded_views(spark, sf_dir):
    segs = _sql(spark, sf_dir, SEGS, "lineitem")
    return generate.from_decoded(generate.decoded(segs))


def decoded_text(spark, sf_dir):
    out = generate.decoded(maps.segments(_parsed(spark, sf_dir)))
    return out.select("map_id", F.to_json("lines").alias("lines"))


def source_contents(spark, sf_dir):
    m = _parsed(spark, sf_dir)
    asked = m.select("map_id", F.explode(F.array(F.concat(F.lit("a"), F.col("map_id") % 3, F.lit(".ts")), F.lit("src/lib/b.ts"))).alias("name"))
    return generate.content_for(maps.map_sources(m), asked)


def merge_statistics(spark, sf_dir):
    return generate.statistics(*maps.merge_indexed(_sql(spark, sf_dir, INDEXED, "supplier")))


def kept_roots(spark, sf_dir):
    m = _parsed(spark, sf_dir).withColumn("sources", F.when(F.col("map_id") % 4 == 0, F.array(F.lit("src/x.ts"), F.lit(""))).otherwise(F.col("sources")))
    return m.select("map_id", maps.kept_root(m).alias("root"))


def scope_listing(spark, sf_dir):
    rows = _sql(spark, sf_dir, f"(select s_suppkey as map_id, '{SCOPES}' as scopes, array(concat('fn', s_suppkey)) as names from supplier)", "supplier")
    return generate.tree_lines(scopes.decode_scopes(rows)).select("map_id", "what", "line")


def merged_scopes(spark, sf_dir):
    """Two sections of one map on the same source: the first one's scopes count, the second one's range points to them."""
    rows = _sql(spark, sf_dir, f"(select s_suppkey as out_id, k as ord, concat(s_suppkey, '-', k) as map_id, k * 7 as line, k * 2 as `column`, '{SCOPES}' as scopes, array(concat('fn', k)) as names from supplier lateral view explode(array(0, 1)) t as k)", "supplier")
    index = rows.selectExpr("out_id", "ord", "0 as local_idx", "0 as source_idx")
    out = scopes.merge_scopes(rows.select("out_id", "ord", "map_id", "line", "column"), scopes.decode_scopes(rows), index)
    return out.select(F.col("map_id").cast("long").alias("map_id"), "what", "id", "start_line", "start_col", "end_line", "end_col", "name", "definition")


def module_fields(spark, sf_dir):
    ext = f"""(select map_id, concat(left(json, length(json) - 1), case when map_id % 2 = 0 then ',"x_facebook_offsets":[0,null,7],"x_metro_module_paths":["p.js"]' else '' end, '}}') as json from {JSON} j)"""
    out = maps.module_fields(_parsed(spark, sf_dir, ext))
    return out.select("map_id", F.size("offsets").alias("n_offsets"), F.array_join("paths", ",").alias("paths"), "for_ram_bundle")


def hermes_faults(spark, sf_dir):
    m = _sql(spark, sf_dir, "(select s_suppkey as map_id, 0 as source_idx, case s_suppkey % 4 when 0 then 'AA,ECA' when 1 then 'DAA' when 2 then 'AAA,E!A' else 'AAA' end as mappings from supplier)", "supplier")
    return symbolicate.hermes_errors(m)


def function_names(spark, sf_dir):
    rows = _sql(spark, sf_dir, "(select s_suppkey as map_id, concat('ab', case s_suppkey % 3 when 0 then '' when 1 then '=' else '==' end, '(1)') as text, 'AAAAA,EAAC' as mappings from supplier)", "supplier")
    segs = mappings.decode_mappings(rows).drop("is_range")
    names = rows.select("map_id", F.lit(0).alias("name_idx"), F.concat(F.lit("n"), "map_id").alias("name"))
    probes = rows.select(F.col("map_id").alias("probe_id"), "map_id", F.lit(0).alias("source_idx"), F.lit(0).alias("line"), F.lit(1).alias("col"), F.when(F.col("map_id") % 5 == 0, "xy").otherwise("ab").alias("minified_name"))
    return symbolicate.original_function_names(segs, names, rows, probes)


def remapped_text(spark, sf_dir):
    outer, *rest = _remap_inputs(spark, sf_dir)
    return compose.remap_text(mappings.encode_mappings(outer), *rest).drop("is_range")


def set_fields(spark, sf_dir):
    m = maps.with_fields(_parsed(spark, sf_dir), source_root=F.lit("new/"), debug_id=F.concat(F.lit("d"), "map_id"), ignore_list=F.array(F.lit(0)))
    return maps.map_sources(m).select("map_id", "source_idx", "raw_source", "source", "ignored")


def ram_startup(spark, sf_dir):
    rows = _sql(spark, sf_dir, "(select s_suppkey as bundle_id, unhex(concat('E5D10BFB', '01000000', '05000000', '0000000002000000', hex(concat('in', s_suppkey % 10, 'x')), '00', hex('ab'))) as content from supplier)", "supplier")
    return ram_bundle.startup(rows)


_ERROR = "case when map_id % 11 = 0 then 'InvalidVersion' when map_id % 13 = 0 then 'Json' when map_id % 17 = 0 then 'Json' end"
_SUPPLIERS = "(select s_suppkey as map_id from supplier) m"
_OFFSETS = "(select map_id, map_id % 10 as out_id, cast(4 * (row_number() over (partition by map_id % 10 order by map_id) - 1) as int) as off from (select s_suppkey as map_id from supplier) m)"
_FORWARD = "map_id=map_id,gen_line=line"
_PLACE = "source_idx,orig_line,orig_col,name_idx"


def _ranged_sql(lub: bool) -> str:
    """The lookup with ranges: the hit, moved by the columns past it, or the last mapping of the last line before."""
    sign, way, tie, exact = (">", "asc", "asc", "desc") if lub else ("<", "desc", "desc", "asc")
    line_empty = "and not exists (select 1 from s where s.map_id = p.map_id and s.gen_line = p.line)" if lub else ""
    return f"""with s as (select * from {RANGED} q), p as (select * from {PROBES} q),
h as (select p.probe_id, p.col, s.*, row_number() over (partition by p.probe_id order by s.gen_col {way}, case when s.gen_col = p.col then s.seg_idx end {exact}, s.seg_idx {tie}) as rn from p join s on s.map_id = p.map_id and s.gen_line = p.line and s.gen_col {sign}= p.col),
e as (select * from (select *, row_number() over (partition by map_id, gen_line order by seg_idx desc) as rn from s) x where rn = 1),
b as (select p.probe_id, p.line, e.*, row_number() over (partition by p.probe_id order by e.gen_line desc) as k from p join e on e.map_id = p.map_id and e.gen_line < p.line where not exists (select 1 from h where h.probe_id = p.probe_id) {line_empty})
select p.probe_id, case when h.probe_id is not null then h.source_idx else b.source_idx end as source_idx, case when h.probe_id is not null then h.orig_line else cast(b.orig_line + b.line - b.gen_line as int) end as orig_line,
 case when h.probe_id is not null then cast(h.orig_col + case when h.is_range and h.col >= h.gen_col then h.col - h.gen_col else 0 end as int) else b.orig_col end as orig_col, case when h.probe_id is not null then h.name_idx else b.name_idx end as name_idx
from p left join (select * from h where rn = 1) h on h.probe_id = p.probe_id left join (select * from b where k = 1 and is_range and source_idx is not null) b on b.probe_id = p.probe_id"""


_REMAP = f"""with s as (select * from {SEGS} q), o as (select map_id, gen_line, seg_idx, gen_col, source_idx, cast(orig_line % 70 as int) as orig_line, orig_col, name_idx from s),
t as (select o.*, o.map_id % 10 + 1 as up from o where source_idx < 4),
h as (select t.map_id, t.gen_line, t.seg_idx, t.gen_col, t.name_idx as own, u.source_idx, u.orig_line, u.orig_col, u.name_idx, row_number() over (partition by t.map_id, t.gen_line, t.seg_idx order by u.gen_col desc, case when u.gen_col = t.orig_col then u.seg_idx end asc, u.seg_idx desc) as rn from t join s u on u.map_id = t.up and u.gen_line = t.orig_line and u.gen_col <= t.orig_col),
c as (select map_id, gen_line, seg_idx, gen_col, 'up' || source_idx as source, orig_line, orig_col, coalesce('u' || name_idx, 'o' || own) as name from h where rn = 1 and source_idx is not null
 union all select map_id, gen_line, seg_idx, gen_col, case when source_idx = 4 or source_idx = 6 then 's' || source_idx end, case when source_idx = 4 or source_idx = 6 then orig_line end, case when source_idx = 4 or source_idx = 6 then orig_col end, case when source_idx = 4 or source_idx = 6 then 'o' || name_idx end from o where source_idx is null or source_idx >= 4)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (parsed_maps, parsed_without_content, checked_maps, listed_sources, listed_names, map_counts, written_maps, generated_maps, data_urls, script_urls, sniffed_maps, flattened_sections, section_dictionaries, section_faults, concat_maps, ranges_round_trip, lookup_ranged_glb, lookup_ranged_lub, lookup_js_glb, lookup_js_lub, traced_segments, lookup_1based, lookup_by_source, lookup_context, each_mapping, mapping_page, partial_lines, line_counts, decode_errors, read_until_error, vlq_values, vlq_errors, remapped, remapped_sources, remapped_chain, resolved_edges, kept_additions, rewritten_sources, common_prefixes, path_functions, identifiers, kept_extensions, byte_offsets, offset_originals, line_slices, decoded_scopes, scopes_round_trip, scope_definitions, symbolicated_scopes, json_stacks, stack_texts, eval_frames, stack_messages, debug_ids, hermes_functions, hermes_names, ram_modules, generated_rows, generated_dictionaries, generated_maybe, generated_parts, decoded_views, decoded_text, source_contents, merge_statistics, kept_roots, scope_listing, merged_scopes, module_fields, hermes_faults, function_names, remapped_text, set_fields, ram_startup)}

ORACLE_SQL: dict[str, str] = {
    "parsed_maps": f"select map_id, case when e is null then 'f' || map_id || '.js' end as file, case when e is null and map_id % 2 = 0 then 'src/' end as source_root, case when e is null and map_id % 5 = 0 then 'id' || (map_id % 7) end as debug_id, e as error from (select map_id, {_ERROR} as e from {_SUPPLIERS}) x",
    "parsed_without_content": f"select map_id, cast(2 as bigint) as n_sources, true as bare, cast(null as varchar) as error from {_SUPPLIERS}",
    "checked_maps": f"select map_id, e is null as ok, e as error from (select map_id, coalesce({_ERROR}, case when map_id % 19 = 0 then 'InvalidSegmentLength' end) as e from {_SUPPLIERS}) x",
    "listed_sources": f"select map_id, cast(source_idx as int) as source_idx, {SOURCE} as source, case when source_idx = 0 then 'let x' || map_id || ';' end as content, source_idx = 1 and map_id % 4 = 0 as ignored from {_SUPPLIERS}, range(2) r(source_idx)",
    "listed_names": f"select map_id, 0 as name_idx, 'n' || (map_id % 5) as name from {_SUPPLIERS}",
    "map_counts": f"select map_id, 2::bigint as n_sources, 1::bigint as n_contents, length('let x' || map_id || ';')::bigint as content_bytes, 1::bigint as n_names, 4::bigint as n_mappings, case when map_id % 3 = 0 then 2 else 0 end::bigint as n_ranges, 4::bigint as n_lines, length(json)::bigint as raw_bytes, printf('%.1f KB', length(json) * 100 / 1024.0) as size from {JSON} j",
    "written_maps": f"select map_id, json from {JSON} j",
    "generated_maps": f"""select map_id, regexp_replace(regexp_replace(regexp_replace(json, ',"sourcesContent":\\[[^\\]]*\\]', ''), ',"x_tool":[^}}]*}}', ''), '(,"rangeMappings":"[^"]*")(,"ignoreList":\\[1\\])', '\\2\\1') as json from {JSON} j""",
    "data_urls": f"select map_id, json from {JSON} j",
    "script_urls": f"select map_id, case when map_id % 3 = 1 then 'inline' else 'external' end as kind, case map_id % 3 when 0 then 'b' || map_id || '.map' when 1 then json else 'first.map' end as value from {JSON} j",
    "sniffed_maps": f"select map_id, not (map_id % 11 <> 0 and (map_id % 13 = 0 or map_id % 17 = 0)) as is_map from {_SUPPLIERS}",
    "flattened_sections": f"select map_id, cast(gen_line + case when k = 1 and map_id % 23 <> 0 then 5 else 0 end as int) as gen_line, cast(gen_col + case when k = 1 and map_id % 23 <> 0 and gen_line = 0 then 3 else 0 end as int) as gen_col, case when k = 0 then {SOURCE} when source_idx = 0 then 'new.ts' else 'lib/b.ts' end as source, orig_line, orig_col, case when name_idx is not null then case when k = 0 then 'n' || (map_id % 5) else 'm' end end as name, k = 0 and map_id % 3 = 0 and ((gen_line = 0 and seg_idx = 0) or (gen_line = 1 and seg_idx = 1)) as is_range from {_SUPPLIERS}, range(2) r(k), {VALUES}",
    "section_dictionaries": f"with u as (select map_id, k * 2 + source_idx as pos, case when k = 0 then {SOURCE} when source_idx = 0 then 'new.ts' else 'lib/b.ts' end as source, case when k = 0 and source_idx = 0 then 'let x' || map_id || ';' end as content, k = 0 and source_idx = 1 and map_id % 4 = 0 as ignored from {_SUPPLIERS}, range(2) r(k), range(2) t(source_idx)), g as (select map_id, source, min(pos) as pos, max(content) as content, bool_or(ignored) as ignored from u group by all) select map_id, cast(row_number() over (partition by map_id order by pos) - 1 as int) as source_idx, source, content, ignored from g",
    "section_faults": f"select map_id, 'SectionsNotOrdered' as kind from {_SUPPLIERS} where map_id % 23 = 0",
    "concat_maps": f"with u as (select o.out_id, o.map_id, o.map_id * 2 + s as pos, o.off, v.*, {SOURCE.replace('map_id', 'o.map_id').replace('source_idx', 's')} as source, s from {_OFFSETS} o, range(2) r(s), {VALUES} where true), d as (select out_id, source, min(pos) as first, arg_max('let x' || map_id || ';', case when s = 0 then pos end) as content, bool_or(s = 1 and map_id % 4 = 0) as ignored from u group by all), n as (select *, cast(row_number() over (partition by out_id order by first) - 1 as int) as idx from d) select u.out_id as map_id, cast(u.gen_line + u.off as int) as gen_line, u.gen_col, n.idx as source_idx, u.source, n.content, n.ignored, case when u.name_idx is not null then 'n' || (u.map_id % 5) end as name from u join n on n.out_id = u.out_id and n.source = u.source where u.s = u.source_idx",
    "ranges_round_trip": f"select * from {RANGED} q",
    "lookup_ranged_glb": _ranged_sql(False),
    "lookup_ranged_lub": _ranged_sql(True),
    "lookup_js_glb": asof_sql(_FORWARD, PROBES, "gen_col", "col", _PLACE, "seg_idx", False, js=True),
    "lookup_js_lub": asof_sql(_FORWARD, PROBES, "gen_col", "col", _PLACE, "seg_idx", True, js=True),
    "traced_segments": asof_sql(_FORWARD, PROBES, "gen_col", "col", f"gen_col,{_PLACE}", "seg_idx", False, js=True),
    "lookup_1based": f"with p as (select event_id as probe_id, {ONE_OF} as map_id, event_id % 6 as line, event_id % 4 as col from events), h as (select p.probe_id, p.map_id, v.*, row_number() over (partition by p.probe_id order by v.gen_col desc) as rn from p join {VALUES} on v.gen_line = p.line and v.gen_col <= p.col join supplier on s_suppkey = p.map_id) select p.probe_id, {SOURCE.replace('map_id', 'h.map_id')} as source, h.orig_line + 1 as line, h.orig_col as col, case when h.name_idx is not null then 'n' || (h.map_id % 5) end as name from p left join h on h.probe_id = p.probe_id and rn = 1".replace("case when source_idx = 0", "case when h.source_idx is null then null when h.source_idx = 0"),
    "lookup_by_source": f"with p as (select event_id as probe_id, {ONE_OF} as map_id, event_id % 2 as odd from events) select probe_id, 3 as gen_line, 0 as gen_col from p join supplier on s_suppkey = map_id where odd = 0 or map_id % 2 = 0",
    "lookup_context": f"select map_id, 0 as context_line, 'let x' || map_id || ';' as context from {_SUPPLIERS}",
    "each_mapping": f"select map_id, cast(row_number() over (partition by map_id order by gen_line, gen_col) - 1 as int) as n, gen_line + 1 as generated_line, gen_col as generated_column, {SOURCE} as source, orig_line + 1 as original_line, orig_col as original_column, case when name_idx is not null then 'n' || (map_id % 5) end as name from {_SUPPLIERS}, {VALUES}",
    "mapping_page": "select * from (values (1, 0, 'src/a2.ts', 4::bigint, true), (1, 2, 'src/a2.ts', 4::bigint, true)) v(gen_line, gen_col, source, total, has_more) where exists (select 1 from supplier where s_suppkey = 2)",
    "partial_lines": f"select * from {SEGS} s where gen_line >= 10 and gen_line < 20",
    "line_counts": f"select map_id, gen_line, count(*) as n from {SEGS} s group by all",
    "decode_errors": f"select map_id, kind, cast(pos as bigint) as \"at\", cast(fields as int) as fields from {_SUPPLIERS} join (values (0, 'InvalidSegmentLength', 7, 2), (1, 'InvalidBase64', 7, null), (2, 'UnexpectedEof', 6, null), (3, 'VlqOverflow', 2, null), (4, 'InvalidSegmentLength', 3, 3), (5, 'InvalidBase64', 2, null)) v(k, kind, pos, fields) on map_id % 7 = k",
    "read_until_error": f"select map_id, gen_line, 0 as gen_col, gen_line as orig_line from {_SUPPLIERS}, (values (0), (1)) v(gen_line)",
    "vlq_values": "select distinct v, u, v as back, u as u_back, cast(greatest(1, ceil(length(bin(u)) / 5)) as int) as n_digits from (select l_orderkey * 1000003 * (l_linenumber % 2 * 2 - 1) as v, l_orderkey as u from lineitem) x",
    "vlq_errors": "select s_suppkey as id, case s_suppkey % 4 when 1 then 'InvalidBase64' when 2 then 'UnexpectedEof' when 3 then 'VlqOverflow' end as kind from supplier",
    "remapped": f"{_REMAP}, w as (select *, row_number() over z as n, lag(source) over z as ps, lag(orig_line) over z as pl, lag(orig_col) over z as pc, lag(name) over z as pn from c window z as (partition by map_id, gen_line order by seg_idx)) select map_id, gen_line, seg_idx, gen_col, source, orig_line, orig_col, name from w where case when source is null then n > 1 and ps is not null else not coalesce(ps = source and pl = orig_line and pc = orig_col and pn is not distinct from name, false) end",
    "remapped_sources": f"{_REMAP}, f as (select map_id, source, min(gen_line * 1000000 + seg_idx) as first from c where source is not null group by all) select map_id, cast(row_number() over (partition by map_id order by first) - 1 as int) as source_idx, source, source[-1] = '1' as ignored from f",
    "remapped_chain": f"select map_id, gen_line, 0 as gen_col, 'a.ts' as source, gen_line + 2 as orig_line, 'text' as content from {_SUPPLIERS}, (values (0), (1)) v(gen_line)",
    "resolved_edges": f"select map_id, cast(source_idx as int) as source_idx, case when source = 'lib/b.ts' then 9 when source = 'src/lib/b.ts' then 4 when source = 'a0.ts' then 1 when source = 'a1.ts' then 3 end::bigint as upstream_id, source from (select map_id, source_idx, {SOURCE} as source from {_SUPPLIERS}, range(2) r(source_idx)) x",
    "kept_additions": f"with r as (select map_id, gen_line * 1000000 + seg_idx as ord, gen_line as g, source_idx % 2 as s, orig_line % 2 as l, orig_col % 2 as c from {SEGS} s), w as (select *, lag(g) over z as pg, lag(s) over z as ps, lag(l) over z as pl, lag(c) over z as pc from r window z as (partition by map_id order by ord)) select map_id, ord from w where not coalesce(s is not null and g = pg and s = ps and l = pl and c = pc, false)",
    "rewritten_sources": f"select map_id, 'a' || map_id || ',r/b,c' as sources, 0 as n_names, 2 as n_contents from {_SUPPLIERS}",
    "common_prefixes": "select s_suppkey as map_id, case when s_suppkey % 4 = s_suppkey % 2 then '/r' || (s_suppkey % 2) || '/d' || (s_suppkey % 3) || '/' end as prefix from supplier where s_suppkey % 4 = s_suppkey % 2",
    "path_functions": "select s_suppkey as id, case when s_suppkey % 3 = s_suppkey % 2 then 'd/e.js' else '../b' || (s_suppkey % 2) || '/d/e.js' end as relative, 'x/z' as normal, '/a/m.map' as map_path, 'https://H.example:443/p/a/m.map?v=1' as url, true as same, cast(null as varchar) as unsafe, 's' || s_suppkey || '.ts' as safe from supplier",
    "identifiers": "select s_suppkey as id, s_suppkey % 4 = 0 as whole, case s_suppkey % 4 when 0 then '$f' || s_suppkey when 2 then 'é_1' end as head from supplier",
    "kept_extensions": f"select map_id, 'x_tool' as k, '{{\"k\":' || map_id || '}}' as v from {_SUPPLIERS}",
    "byte_offsets": "with h as (select doc_id, left(text, cast(doc_id * 37 % (n_chars + 1) as int)) as h from documents where text is not null) select doc_id as probe_id, cast(length(h) - length(replace(h, chr(10), '')) as bigint) as line, cast(length(string_split(h, chr(10))[-1]) as bigint) as col from h",
    "offset_originals": f"with h as (select doc_id, left(text, cast(doc_id % 60 as int)) as h from documents where length(text) > 60), p as (select doc_id as probe_id, length(h) - length(replace(h, chr(10), '')) as line, length(string_split(h, chr(10))[-1]) as col from h), a as (select p.probe_id, v.*, row_number() over (partition by p.probe_id order by v.gen_col desc) as rn from p join {VALUES} on v.gen_line = p.line and v.gen_col <= p.col) select p.probe_id, a.source_idx, a.orig_line, a.orig_col from p left join a on a.probe_id = p.probe_id and rn = 1",
    "line_slices": "with l as (select doc_id, string_split(text, chr(10))[1] as l from documents where text is not null) select doc_id as probe_id, case doc_id % 4 when 0 then case when length(l) >= 3 then '😀' || left(l, 3) end when 2 then case when length(l) >= 5 then left(l, 5) end when 3 then case when length(l) >= 6 then substring(l, 2, 5) end end as text from l",
    "decoded_scopes": f"select map_id, 'scope' as what, 0 as id, 0 as start_line, 0 as start_col, 3 as end_line, 1 as end_col, 'fn' || map_id as name, true as is_stack_frame, cast(null as int) as definition, cast(null as varchar) as error from {_SUPPLIERS} where map_id % 9 <> 0 union all select map_id, 'range', 0, 0, 0, 0, 5, null, true, 0, null from {_SUPPLIERS} where map_id % 9 <> 0 union all select map_id, null, null, null, null, null, null, null, null, null, 'UnclosedScope' from {_SUPPLIERS} where map_id % 9 = 0",
    "scopes_round_trip": f"select map_id, 'BHCAAC,DCC,BAAB,CAB,CDB,,BAAA,CAC,EDBAA,GCAD,HACAC,ICDE,EGAA,FB,FBA' as scopes, 3 as n_names from {_SUPPLIERS}",
    "scope_definitions": f"select map_id, 0 as range_id, 'fn' || map_id as name, 5 as end_col from {_SUPPLIERS}",
    "symbolicated_scopes": "select event_id as trace_id, 0 as frame_no, case when s_suppkey is null then 'own' when event_id % 9 <= 5 then 'fn' || m else 'own' end as function_name, case when s_suppkey is null then 'f' || m || '.js' else case when m % 2 = 0 then 'src/' else '' end || 'a' || (m % 3) || '.ts' end as file, 1 as line, case when s_suppkey is null then cast(event_id % 9 + 1 as int) when m % 3 = 0 then cast(event_id % 9 + 1 as int) else 1 end as col, s_suppkey is not null as symbolicated from (select *, user_id % ((select count(*) from supplier) + 3) as m from events) e left join supplier on s_suppkey = m",
    "json_stacks": """select s_suppkey as trace_id, '{"frames":[{"column":2,"file":"f' || s_suppkey || '.js","functionName":null,"line":1,"symbolicated":true}],"message":"Error: e"}' as json from supplier""",
    "stack_texts": "select s_suppkey as trace_id, 'Error: e' || chr(10) || '    at g' || s_suppkey || ' (f' || s_suppkey || '.js:1:2)' as text from supplier",
    "eval_frames": "select event_id as trace_id, 1 as frame_no, 'eval (eval at bar' as function_name, 'a.js:1:2), <anonymous>' as file, cast(event_id as int) as line, 4 as col from events where event_id % 3 = 0 union all select event_id, 2, 'new Foo', 'b.js', 3, 4 from events where event_id % 3 = 1 union all select event_id, 1, 'f', 'y.js', 5, 6 from events where event_id % 3 = 2",
    "stack_messages": "select event_id as trace_id, case when event_id % 2 = 0 then 'Error: e' || user_id end as message from events",
    "debug_ids": f"select 'id' || (map_id % 7) as debug_id, min(map_id) as map_id from {_SUPPLIERS} where map_id % 5 = 0 group by 1",
    "hermes_functions": f"select map_id, 0 as source_idx, ord, line, col, name_idx from {_SUPPLIERS}, (values (0, 0, 0, 0), (1, 0, 2, 1), (2, 1, 5, 1)) v(ord, line, col, name_idx) where map_id % 8 <> 0",
    "hermes_names": f"with p as (select event_id as probe_id, {ONE_OF} as map_id, event_id % 4 as line, event_id % 5 as col from events), h as (select p.probe_id, v.*, row_number() over (partition by p.probe_id order by v.gen_col desc) as rn from p join {VALUES} on v.gen_line = p.line and v.gen_col <= p.col join supplier on s_suppkey = p.map_id) select probe_id, case when source_idx = 0 then case when orig_line = 0 and orig_col < 2 then 'top' else 'low' end end as name from h where rn = 1",
    "ram_modules": "select s_suppkey as bundle_id, 0 as module_id, 'm' || (s_suppkey + 1000000) as source_code from supplier where s_suppkey % 6 <> 0 union all select s_suppkey, 2, 'end' from supplier where s_suppkey % 6 <> 0",
    "generated_rows": f"select map_id, gen_line, cast(row_number() over (partition by map_id, gen_line order by gen_col, ord) - 1 as int) as seg_idx, gen_col, source, case when source is not null then orig_line end as orig_line, case when source is not null then orig_col end as orig_col, case when source is not null then name end as name from {_ADDED} a",
    "generated_dictionaries": f"select map_id, cast(row_number() over (partition by map_id order by first) - 1 as int) as source_idx, source from (select map_id, source, min(ord) as first from {_ADDED} a where source is not null group by all) f",
    "generated_maybe": f"with r as (select map_id, gen_line, gen_col, ord, source, case when source is not null then orig_line end as orig_line, case when source is not null then orig_col end as orig_col, case when source is not null then name end as name from {_ADDED} a), w as (select *, row_number() over z as n, lag(source) over z as ps, lag(orig_line) over z as pl, lag(orig_col) over z as pc, lag(name) over z as pn from r window z as (partition by map_id, gen_line order by gen_col, ord)) select map_id, gen_line, gen_col, source, orig_line, orig_col, name from w where case when source is null then n > 1 and ps is not null else not coalesce(ps = source and pl = orig_line and pc = orig_col and pn is not distinct from name, false) end",
    "generated_parts": f"select map_id, 'f' || map_id || '.js' as file, '{MAPPINGS}' as mappings, case when map_id % 3 = 0 then 'A;B' end as range_mappings, {ROOT} || 'a' || (map_id % 3) || '.ts,' || {ROOT} || 'lib/b.ts' as sources, case when map_id % 2 = 1 then 'B' else '' end as contents, case when map_id % 2 = 1 or map_id % 4 = 0 then '1' else '' end as ignored, 'n' || (map_id % 5) as names from {_SUPPLIERS}",
    "decoded_views": f"select * from {SEGS} s",
    "decoded_text": f"select map_id, '[[[0,0,0,0]],[[0,0,1,0],[2,0,1,2,0]],[],[[0,1,1,0]]]' as lines from {_SUPPLIERS}",
    "source_contents": f"select map_id, 'a' || (map_id % 3) || '.ts' as name, 'let x' || map_id || ';' as content, false as ignored from {_SUPPLIERS} union all select map_id, 'src/lib/b.ts', null, map_id % 4 = 0 from {_SUPPLIERS}",
    "merge_statistics": f"select map_id, 8::bigint as n_mappings, case when map_id % 2 = 0 then 4 else 3 end::bigint as n_sources, 2::bigint as n_names from {_SUPPLIERS}",
    "kept_roots": f"select map_id, case when map_id % 4 = 0 then 'src/' end as root from {_SUPPLIERS}",
    "scope_listing": f"select map_id, 'scope' as what, 'fn' || map_id || ' 0:0-3:1' as line from {_SUPPLIERS} union all select map_id, 'range', '0:0-0:5' from {_SUPPLIERS}",
    "merged_scopes": f"select map_id, 'scope' as what, 0 as id, 0 as start_line, 0 as start_col, 3 as end_line, 1 as end_col, 'fn0' as name, cast(null as int) as definition from {_SUPPLIERS} union all select map_id, 'range', k, k * 7, k * 2, k * 7, 5 + k * 2, null, 0 from {_SUPPLIERS}, (values (0), (1)) v(k)",
    "module_fields": f"select map_id, case when map_id % 2 = 0 then 3 end as n_offsets, case when map_id % 2 = 0 then 'p.js' end as paths, map_id % 2 = 0 as for_ram_bundle from {_SUPPLIERS}",
    "hermes_faults": f"select map_id, 0 as source_idx, case map_id % 4 when 2 then 'InvalidBase64' else 'InvalidFunctionMap' end as kind from {_SUPPLIERS} where map_id % 4 < 3",
    "function_names": f"select map_id as probe_id, 'n' || map_id as name from {_SUPPLIERS} where map_id % 5 <> 0",
    "set_fields": f"select map_id, cast(source_idx as int) as source_idx, case when source_idx = 0 then 'a' || (map_id % 3) || '.ts' else 'lib/b.ts' end as raw_source, 'new/' || case when source_idx = 0 then 'a' || (map_id % 3) || '.ts' else 'lib/b.ts' end as source, source_idx = 0 as ignored from {_SUPPLIERS}, range(2) r(source_idx)",
    "ram_startup": "select s_suppkey as bundle_id, 1::bigint as n_modules, 'in' || (s_suppkey % 10) || 'x' as startup_code from supplier",
}
ORACLE_SQL["remapped_text"] = ORACLE_SQL["remapped"]
