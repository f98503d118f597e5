"""Queries of the map operators on corpora derived from the given tables, with SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.functions import text
from meridian.operators import compose, lookup, mappings, symbolicate, validate

#: The same SQL in both engines; probes go to all maps.
ONE_OF = "user_id % (select count(*) from supplier)"
SEGS = """(select map_id, gen_line, cast(row_number() over (partition by map_id, gen_line order by gen_col, coalesce(source_idx, -1), coalesce(orig_line, -1), coalesce(orig_col, -1), coalesce(name_idx, -1)) - 1 as int) as seg_idx, gen_col, source_idx, orig_line, orig_col, name_idx from (
 select distinct map_id, gen_line, gen_col, source_idx, case when source_idx is not null then ol end as orig_line, case when source_idx is not null then oc end as orig_col, case when source_idx is not null and oc % 3 = 0 then cast(oc % 5 as int) end as name_idx from (
  select l_suppkey as map_id, cast(l_orderkey % 64 as int) as gen_line, cast(cast(l_quantity as int) * 4 + l_linenumber as int) as gen_col, case when l_partkey % 7 = 6 then null else cast(l_partkey % 7 as int) end as source_idx, cast(l_orderkey % 500 as int) as ol, cast(l_partkey % 120 as int) as oc from lineitem) a) b)"""
PROBES = f"(select event_id as probe_id, {ONE_OF} as map_id, cast(event_id % 70 as int) as line, cast((event_id * 7919) % 220 as int) as col from events)"
BACK = f"(select event_id as probe_id, {ONE_OF} as map_id, cast(event_id % 6 as int) as source_idx, cast((event_id * 31) % 500 as int) as line, cast((event_id * 7919) % 130 as int) as col from events)"
EVERY = f"(select distinct concat_ws(':', map_id, source_idx, orig_line, orig_col) as probe_id, map_id, source_idx, orig_line as line, orig_col as col from {SEGS} e where source_idx is not null)"
SPANS = f"(select event_id as probe_id, {ONE_OF} as map_id, cast(event_id % 70 as int) as line, cast((event_id * 7919) % 220 as int) as col, cast(event_id % 70 as int) as end_line, cast((event_id * 7919) % 220 + 9 as int) as end_col from events)"


def _read(spark: SparkSession, sf_dir: str, *names: str) -> None:
    for n in names:
        spark.read.parquet(f"{sf_dir}/{n}.parquet").createOrReplaceTempView(n)


def _segs(spark: SparkSession, sf_dir: str) -> DataFrame:
    _read(spark, sf_dir, "lineitem")
    return spark.sql(f"select * from {SEGS} s")


def _probes(spark: SparkSession, sf_dir: str, sql: str = PROBES) -> DataFrame:
    _read(spark, sf_dir, "events", "lineitem", "supplier")
    return spark.sql(f"select * from {sql} p")


def lookup_original_glb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.original_position(_segs(spark, sf_dir), _probes(spark, sf_dir))


def lookup_original_lub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.original_position(_segs(spark, sf_dir), _probes(spark, sf_dir), lub=True)


def lookup_generated_glb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.generated_position(_segs(spark, sf_dir), _probes(spark, sf_dir, BACK))


def lookup_generated_lub(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.generated_position(_segs(spark, sf_dir), _probes(spark, sf_dir, BACK), lub=True)


def lookup_all_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.all_generated_positions(_segs(spark, sf_dir), _probes(spark, sf_dir, EVERY))


def map_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.map_range(_segs(spark, sf_dir), _probes(spark, sf_dir, SPANS))


def validate_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = _segs(spark, sf_dir)
    known = segs.select("map_id").distinct()
    sources = known.select("map_id", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("source_idx"))
    names = known.select("map_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("name_idx"))
    return validate.validate_deep(segs, sources, names, known.select("map_id", F.lit(8).alias("source_idx")))


def symbolicated_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    _read(spark, sf_dir, "events", "supplier")
    frames = spark.sql(f"select probe_id as trace_id, 0 as frame_no, 'f' as function_name, concat('file', map_id, '.js') as file, line + 1 as line, col + 1 as col from {PROBES} p")
    segs = _segs(spark, sf_dir)
    files = segs.select("map_id").distinct().select(F.concat(F.lit("file"), "map_id", F.lit(".js")).alias("file"), "map_id")
    sources = segs.where("source_idx is not null").select("map_id", "source_idx").distinct().withColumn("source", F.concat(F.lit("src"), "source_idx"))
    names = segs.where("name_idx is not null").select("map_id", "name_idx").distinct().withColumn("name", F.concat(F.lit("name"), "name_idx"))
    return symbolicate.symbolicate(frames, files, segs, sources, names)


def interned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    uses = _segs(spark, sf_dir).select("map_id", "name_idx", F.struct("gen_line", "seg_idx").alias("at"))
    return compose.intern(uses, "map_id", "name_idx", "at")


def codec_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mappings.decode_mappings(mappings.encode_mappings(_segs(spark, sf_dir))).drop("is_range")


def map_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segs(spark, sf_dir).groupBy("map_id").agg(F.count("*").alias("n_mappings"), F.countDistinct("source_idx").alias("n_sources"), F.countDistinct("name_idx").alias("n_names"), (F.max("gen_line") + 1).alias("n_lines"), F.max("orig_line").alias("max_line"))


def concat_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    segs = _segs(spark, sf_dir)
    maps = segs.groupBy("map_id").agg((F.max("gen_line") + 1).alias("n_lines")).selectExpr("map_id % 10 as bundle_id", "map_id as ord", "map_id", "n_lines")
    return compose.concat(maps, segs).select("bundle_id", "map_id", "gen_line", "seg_idx", "gen_col")


def dedup_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _segs(spark, sf_dir).selectExpr("map_id", "gen_line", "seg_idx", "cast(source_idx % 2 as string) as source", "orig_line % 2 as orig_line", "orig_col % 2 as orig_col", "cast(null as string) as name")
    return compose.drop_repeats(rows).drop("name")


def source_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id as asset_id", "html as text")
    return text.source_lines(pages).groupBy("asset_id").agg(F.count("*").alias("n_lines"), F.sum(F.length("text")).alias("n_chars"))


def stack_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    _read(spark, sf_dir, "events")
    traces = spark.sql("select event_id as trace_id, case when event_id % 2 = 0 then concat('Error: e\n    at f', user_id, ' (app.js:', event_id % 90 + 1, ':', user_id, ')\n    at app.js:', user_id, ':2') else concat('g', user_id, '@http://h:80/app.js:', event_id % 90 + 1, ':', user_id, '\n@lib.js:1:2') end as stack from events")
    return text.stack_frames(traces)


def asof_sql(keys: str, probes: str, at: str, probe_at: str, cols: str, order: str, lub: bool, where: str = "", js: bool = False) -> str:
    sign, way, tie = (">", "asc", "asc") if lub else ("<", "desc", "desc")
    exact_tie = "desc" if lub != js else "asc"
    on = " and ".join(f"s.{a} = p.{b}" for a, b in (k.split("=") for k in keys.split(",")))
    picked = ", ".join(f"h.{c}" for c in cols.split(","))
    rank = ", ".join(f"case when s.{at} = p.{probe_at} then s.{o} end {exact_tie}, s.{o} {tie}" for o in order.split(","))
    return f"""with s as (select * from {SEGS} q {where}), p as (select * from {probes} q),
h as (select p.probe_id, s.*, row_number() over (partition by p.probe_id order by s.{at} {way}, {rank}) as rn from p join s on {on} and s.{at} {sign}= p.{probe_at})
select p.probe_id, {picked} from p left join (select * from h where rn = 1) h on h.probe_id = p.probe_id"""


_ORIG = "source_idx,orig_line,orig_col,name_idx"
_GEN = "gen_line,gen_col"
_FORWARD = "map_id=map_id,gen_line=line"
ENDS = f"(select probe_id, map_id, end_line as line, end_col as col from {SPANS} e)"
_BACK_KEYS = "map_id=map_id,source_idx=source_idx,orig_line=line"
_LINES = "with x as (select page_id, string_split(regexp_replace(html, '\\r\\n?', chr(10), 'g'), chr(10)) as l from pages), y as (select page_id, case when l[-1] = '' then l[:-2] else l end as l from x) select page_id as asset_id, cast(len(l) as bigint) as n_lines, cast(list_sum(list_transform(l, lambda z: length(z))) as bigint) as n_chars from y where len(l) > 0"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (lookup_original_glb, lookup_original_lub, lookup_generated_glb, lookup_generated_lub, lookup_all_generated, codec_round_trip, map_info, map_range, validate_deep, symbolicated_frames, interned_names, concat_bundles, dedup_candidates, source_lines, stack_frames)}
ORACLE_SQL: dict[str, str] = {
    "lookup_original_glb": asof_sql("map_id=map_id,gen_line=line", PROBES, "gen_col", "col", _ORIG, "seg_idx", False),
    "lookup_original_lub": asof_sql("map_id=map_id,gen_line=line", PROBES, "gen_col", "col", _ORIG, "seg_idx", True),
    "lookup_generated_glb": asof_sql(_BACK_KEYS, BACK, "orig_col", "col", _GEN, "gen_line,gen_col,seg_idx", False, "where source_idx is not null"),
    "lookup_generated_lub": asof_sql(_BACK_KEYS, BACK, "orig_col", "col", _GEN, "gen_line,gen_col,seg_idx", True, "where source_idx is not null"),
    "map_range": f"with a as ({asof_sql(_FORWARD, SPANS, 'gen_col', 'col', _ORIG, 'seg_idx', False)}), b as ({asof_sql(_FORWARD, ENDS, 'gen_col', 'col', _ORIG, 'seg_idx', False)}) select a.probe_id, a.source_idx, a.orig_line as start_line, a.orig_col as start_col, b.orig_line as end_line, b.orig_col as end_col from a join b on a.probe_id = b.probe_id and a.source_idx = b.source_idx",
    "validate_deep": f"with s as (select * from {SEGS} q) select distinct map_id, 'source' as warning, '0' as detail from s where source_idx = 0 union all select distinct map_id, 'name', cast(name_idx as varchar) from s where name_idx > 2 union all select distinct map_id, 'ignore', '8' from s union all select m.map_id, 'unreferenced', cast(k as varchar) from (select distinct map_id from s) m, range(1, 8) r(k) where not exists (select 1 from s where s.map_id = m.map_id and s.source_idx = k)",
    "symbolicated_frames": f"with o as ({asof_sql(_FORWARD, PROBES, 'gen_col', 'col', _ORIG, 'seg_idx', False)}) select p.probe_id as trace_id, 0 as frame_no, coalesce('name' || o.name_idx, 'f') as function_name, case when o.source_idx is null then 'file' || p.map_id || '.js' else 'src' || o.source_idx end as file, case when o.source_idx is null then p.line + 1 else o.orig_line + 1 end as line, case when o.source_idx is null then p.col + 1 else o.orig_col + 1 end as col, o.source_idx is not null as symbolicated from {PROBES} p join o on o.probe_id = p.probe_id",
    "interned_names": f"select map_id, name_idx, cast(row_number() over (partition by map_id order by g) - 1 as int) as idx from (select map_id, name_idx, min(gen_line * 1000000 + seg_idx) as g from {SEGS} s where name_idx is not null group by map_id, name_idx) f",
    "lookup_all_generated": f"select p.probe_id, s.gen_line, s.gen_col from {SEGS} s join {EVERY} p on s.map_id = p.map_id and s.source_idx = p.source_idx and s.orig_line = p.line and s.orig_col = p.col",
    "codec_round_trip": f"select * from {SEGS} s",
    "map_info": f"select map_id, count(*) as n_mappings, count(distinct source_idx) as n_sources, count(distinct name_idx) as n_names, max(gen_line) + 1 as n_lines, max(orig_line) as max_line from {SEGS} s group by map_id",
    "concat_bundles": f"with s as (select * from {SEGS} q), m as (select map_id, max(gen_line) + 1 as n from s group by map_id), o as (select map_id, map_id % 10 as bundle_id, cast(coalesce(sum(n) over (partition by map_id % 10 order by map_id rows between unbounded preceding and 1 preceding), 0) as int) as off from m) select o.bundle_id, s.map_id, cast(s.gen_line + o.off as int) as gen_line, s.seg_idx, s.gen_col from s join o on s.map_id = o.map_id",
    "dedup_candidates": f"with r as (select map_id, gen_line, seg_idx, cast(source_idx % 2 as varchar) as source, orig_line % 2 as orig_line, orig_col % 2 as orig_col from {SEGS} s), w as (select *, row_number() over z as n, lag(source) over z as ps, lag(orig_line) over z as pl, lag(orig_col) over z as pc from r window z as (partition by map_id, gen_line order by seg_idx)) select map_id, gen_line, seg_idx, source, orig_line, orig_col from w where case when source is null then n > 1 and ps is not null else not (ps is not null and ps = source and pl = orig_line and pc = orig_col) end",
    "source_lines": _LINES,
    "stack_frames": "with e as (select event_id, user_id, event_id % 90 + 1 as l from events) select event_id as trace_id, 1 as frame_no, 'f' || user_id as function_name, 'app.js' as file, cast(l as int) as line, cast(user_id as int) as col from e where event_id % 2 = 0 union all select event_id, 2, null, 'app.js', cast(user_id as int), 2 from e where event_id % 2 = 0 union all select event_id, 0, 'g' || user_id, 'http://h:80/app.js', cast(l as int), cast(user_id as int) from e where event_id % 2 = 1 union all select event_id, 1, null, 'lib.js', 1, 2 from e where event_id % 2 = 1",
}
