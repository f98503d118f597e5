"""Symbolication of stack frames, scopes by containment, Hermes function maps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.text import is_identifier, line_slice, source_lines, utf16_length
from meridian.operators.lookup import generated_position, original_position
from meridian.operators.mappings import Values


def symbolicate(frames: DataFrame, files: DataFrame, segs: DataFrame, sources: DataFrame, names: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """Frames (trace_id, frame_no, function_name, file, line, col; 1-based) by files (file, map_id).

    A frame that can't be placed stays as it is with symbolicated = false; otherwise the mapping's name goes before the
    name of the scope around it, and that before the frame's. functions: ranges for enclosing_function. Of a file's maps
    the smallest map_id counts. Frames travel with their probes, so nothing is joined by an invented key. Joins are by sort
    and merge: dictionaries and ranges shrink in shuffles, so Spark would broadcast more than a driver holds.
    """
    of = files.groupBy("file").agg(F.min("map_id").alias("map_id"))
    rows = frames.join(of.hint("merge"), "file", "left")
    own = F.struct("trace_id", "frame_no", "function_name", "file", "line", "col").alias("probe_id")
    zero = lambda c: F.greatest(F.col(c) - 1, F.lit(0)).alias(c)
    probes = rows.where("map_id is not null").select(own, "map_id", zero("line"), zero("col"), F.col("map_id").alias("of"))
    hit = original_position(segs, probes).withColumnRenamed("of", "map_id")
    hit = hit.join(sources.select("map_id", "source_idx", "source").hint("merge"), ["map_id", "source_idx"], "left").join(names.select("map_id", "name_idx", "name").hint("merge"), ["map_id", "name_idx"], "left")
    if functions is not None:
        around = enclosing_function(probes.drop("of"), functions).withColumnRenamed("name", "scope")
        hit = hit.join(around.hint("merge"), "probe_id", "left")
    else:
        hit = hit.withColumn("scope", F.lit(None).cast("string"))
    done = F.col("source_idx").isNotNull()
    frame = lambda c: F.col(f"probe_id.{c}")
    placed = hit.select(frame("trace_id"), frame("frame_no"), F.when(done, F.coalesce("name", "scope", "probe_id.function_name")).otherwise(frame("function_name")).alias("function_name"), F.when(done, F.col("source")).otherwise(frame("file")).alias("file"), F.when(done, F.col("orig_line") + 1).otherwise(frame("line")).alias("line"), F.when(done, F.col("orig_col") + 1).otherwise(frame("col")).alias("col"), done.alias("symbolicated"))
    rest = rows.where("map_id is null").select("trace_id", "frame_no", "function_name", "file", "line", "col", F.lit(False).alias("symbolicated"))
    return placed.unionByName(rest)


def format_stacks(frames: DataFrame, messages: DataFrame) -> DataFrame:
    """(trace_id, text) of symbolicated frames and (trace_id, message)."""
    line = F.concat(F.lit("    at "), F.coalesce("function_name", F.lit("<anonymous>")), F.lit(" ("), F.concat_ws(":", "file", "line", "col"), F.lit(")"))
    text = frames.select("trace_id", "frame_no", line.alias("line")).groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frame_no", "line"))), lambda x: x["line"]), "\n").alias("body"))
    return messages.join(text, "trace_id", "left").select("trace_id", F.concat_ws("\n", "message", "body").alias("text"))


def json_stacks(frames: DataFrame, messages: DataFrame) -> DataFrame:
    """(trace_id, json): message and frames in order, absent names as null."""
    frame = F.struct("frame_no", F.struct(F.col("column"), "file", F.col("function_name").alias("functionName"), "line", "symbolicated").alias("f"))
    listed = frames.withColumnRenamed("col", "column").groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(frame)), lambda x: x["f"]).alias("frames"))
    both = messages.join(listed, "trace_id", "left").withColumn("frames", F.when(F.col("frames").isNull(), F.expr("filter(array(struct(0 as column, '' as file, '' as functionName, 0 as line, false as symbolicated)), x -> false)")).otherwise(F.col("frames")))
    return both.select("trace_id", F.to_json(F.struct("frames", "message"), {"ignoreNullFields": "false"}).alias("json"))


def by_debug_id(maps: DataFrame) -> DataFrame:
    """(debug_id, map_id): of several maps with one id the smallest."""
    return maps.where("debug_id is not null").groupBy("debug_id").agg(F.min("map_id").alias("map_id"))


def enclosing_function(probes: DataFrame, ranges: DataFrame) -> DataFrame:
    """(probe_id, name): the innermost named function range around each probe (probe_id, map_id, line, col).

    ranges (map_id, range_id, parent, depth, start, end, is_stack_frame, is_hidden, name), start and end as structs of line
    and col, closed on both ends; a hidden range, or one without a name, leaves the name to the ranges around it. Ranges
    are cut into power-of-two runs of lines, a range of n lines into 2 * log2(n) at most; a probe asks the 31 runs that
    hold its line, so a range over a whole bundle costs a few rows and the join has an equality.
    """
    a, z = F.col("start.line"), F.col("end.line")
    # A run of length 2^k from line i * 2^k belongs to a range if it lies within it and the run around it doesn't.
    around = lambda k, i: (F.call_function("shiftleft", F.call_function("shiftright", i, F.lit(1)), k + 1) >= a) & (F.call_function("shiftleft", F.call_function("shiftright", i, F.lit(1)) + 1, k + 1) - 1 <= z)
    first = lambda k: F.call_function("shiftright", a + F.call_function("shiftleft", F.lit(1), k) - 1, k)
    last = lambda k: F.call_function("shiftright", z + 1, k) - 1
    ends = lambda k: F.filter(F.array_distinct(F.array(first(k), last(k))), lambda i: (first(k) <= last(k)) & ~around(k, i))
    levels = F.filter(F.sequence(F.lit(0), F.lit(30)), lambda k: F.call_function("shiftleft", F.lit(1), k) <= z - a + 1)
    runs = F.flatten(F.transform(levels, lambda k: F.transform(ends(k), lambda i: F.struct(k.alias("k"), i.alias("run")))))
    own = F.when(F.col("is_stack_frame") & ~F.col("is_hidden"), F.col("name"))
    cut = ranges.select("map_id", "range_id", "parent", "depth", "start", "end", own.alias("name"), F.inline(runs))
    asks = probes.select("probe_id", "map_id", F.struct("line", "col").alias("at"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(30)), lambda k: F.call_function("shiftright", F.col("line"), k))).alias("k", "run"))
    rows = asks.join(cut.hint("merge"), ["map_id", "k", "run"]).where((F.col("start") <= F.col("at")) & (F.col("at") <= F.col("end")))
    # From the outside in: each next range must stand in the one before. As many rows a probe as ranges are nested.
    path = rows.groupBy("probe_id").agg(F.array_sort(F.collect_list(F.struct("depth", "range_id", "parent", "name"))).alias("path"))
    walked = F.aggregate("path", F.struct(F.lit(None).cast("int").alias("last"), F.lit(None).cast("string").alias("name")), lambda t, x: F.when(x["parent"].eqNullSafe(t["last"]), F.struct(x["range_id"].cast("int").alias("last"), F.coalesce(x["name"], t["name"]).alias("name"))).otherwise(t))
    return path.select("probe_id", F.nullif(walked["name"], F.lit("")).alias("name")).where("name is not null")


def function_ranges(scopes: DataFrame) -> DataFrame:
    """Ranges for enclosing_function from decoded scopes: each with the name of the scope it is defined by.

    A definition that no scope has makes an empty name.
    """
    of = scopes.where("what = 'scope'").select("map_id", F.col("id").alias("definition"), F.col("name").alias("scope_name"), F.lit(True).alias("there"))
    rows = scopes.where("what = 'range'").drop("name").join(of.hint("merge"), ["map_id", "definition"], "left")
    name = F.when(F.col("definition").isNotNull() & F.col("there").isNull(), "").otherwise(F.col("scope_name"))
    place = lambda k: F.struct(F.col(f"{k}_line").alias("line"), F.col(f"{k}_col").alias("col")).alias(k)
    return rows.select("map_id", F.col("id").alias("range_id"), "parent", "depth", place("start"), place("end"), "is_stack_frame", "is_hidden", name.alias("name"))


def decode_hermes(maps: DataFrame) -> DataFrame:
    """(map_id, source_idx, ord, line, col, name_idx) of function maps (map_id, source_idx, mappings): three running sums.

    Function maps with an error (see hermes_errors) give no rows.
    """
    rows, schema = maps.select("map_id", "source_idx", "mappings"), f"map_id {maps.schema['map_id'].dataType.simpleString()}, source_idx int, ord int, line int, col int, name_idx int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [triples(t or "") for t in b.column(2).to_pylist()]
            keep = [i for i, (_, e) in enumerate(got) if e is None and len(got[i][0])]
            if keep:
                at = np.repeat(keep, [len(got[i][0]) for i in keep])
                x = np.concatenate([got[i][0] for i in keep]).astype(np.int32)
                order = np.concatenate([np.arange(len(got[i][0])) for i in keep]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), b.column(1).take(pa.array(at)), pa.array(order), pa.array(x[:, 2]), pa.array(x[:, 0]), pa.array(x[:, 1])], ["map_id", "source_idx", "ord", "line", "col", "name_idx"])

    return rows.mapInArrow(run, schema)


def hermes_errors(maps: DataFrame) -> DataFrame:
    """(map_id, source_idx, kind) of function maps that don't decode."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, e) for i, t in enumerate(b.column(2).to_pylist()) if (e := triples(t or "")[1])]
            if found:
                at = pa.array([i for i, _ in found])
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array([e for _, e in found])], ["map_id", "source_idx", "kind"])

    return maps.select("map_id", "source_idx", "mappings").mapInArrow(run, f"map_id {maps.schema['map_id'].dataType.simpleString()}, source_idx int, kind string")


def triples(text: str) -> tuple[np.ndarray, str | None]:
    """Running (column, name, line) of a function map and the first error: values go by threes, a comma within is an error."""
    v = Values(text.replace(";", "!"))
    value = v.signed()
    n = len(value) // 3 * 3
    run = np.cumsum(v.kind >= 64)[v.start] if len(v.start) else v.start
    split = np.flatnonzero((run[0:n:3] != run[1:n:3]) | (run[1:n:3] != run[2:n:3])) if n else run
    total = np.cumsum(value[:n].reshape(-1, 3), axis=0)
    below = np.flatnonzero((total < 0).any(1))
    if len(split) and not (len(below) and below[0] < split[0]):
        return total, "InvalidFunctionMap"
    if len(below):
        return total, "InvalidFunctionMap"
    if v.error is not None:
        over = len(value) > n and v.kind[v.end[-1] + 1 :][:1].tolist() == [64]
        return total, "InvalidFunctionMap" if over else v.error[1]
    return total, "InvalidFunctionMap" if len(value) > n else None


def hermes_function(offsets: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe_id, name_idx): the last offset at or before each probe (probe_id, map_id, source_idx, line, col), across lines."""
    at = F.struct("line", "col")
    held = offsets.select("map_id", "source_idx", at.alias("at"), F.lit(0).alias("kind"), F.col("ord").cast("int").alias("ord"), "name_idx", F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"))
    asked = probes.select("map_id", "source_idx", at.alias("at"), F.lit(1).alias("kind"), F.lit(0).alias("ord"), F.lit(None).cast("int").alias("name_idx"), "probe_id")
    w = Window.partitionBy("map_id", "source_idx").orderBy("at", "kind", "ord").rowsBetween(Window.unboundedPreceding, 0)
    return held.unionByName(asked).withColumn("name_idx", F.last("name_idx", ignorenulls=True).over(w)).where("kind = 1").select("probe_id", "name_idx")


def hermes_names(segs: DataFrame, offsets: DataFrame, names: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe_id, name) of generated positions: looked up in the map, then in the function map of the source found.

    names (map_id, source_idx, names) are the function maps' own; an index beyond them gives null.
    """
    hit = original_position(segs, probes.select("probe_id", "map_id", "line", "col", F.col("map_id").alias("of"))).where("source_idx is not null")
    asked = hit.select(F.struct("probe_id", F.col("of").alias("map_id"), "source_idx").alias("probe_id"), F.col("of").alias("map_id"), "source_idx", F.col("orig_line").alias("line"), F.col("orig_col").alias("col"))
    found = hermes_function(offsets, asked).select("probe_id.*", "name_idx")
    return found.join(names, ["map_id", "source_idx"], "left").select("probe_id", F.get("names", F.col("name_idx")).alias("name"))


def original_function_names(segs: DataFrame, names: DataFrame, scripts: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe_id, name): what the function around a minified name was called, guessed from the script's text.

    scripts (map_id, text), probes (probe_id, map_id, source_idx, line, col, minified_name) on original positions. The
    identifier that ends just before the generated position, but for `(`, `,`, `:` or a plain `=`, must be the minified
    name; the mapping as many columns before the position as it is long gives the name.
    """
    at = generated_position(segs, probes.withColumn("of", F.col("map_id"))).where("gen_line is not null")
    lines = source_lines(scripts.select(F.col("map_id").alias("asset_id"), "text")).select(F.col("asset_id").alias("of"), F.col("line").alias("gen_line"), "text")
    before = F.rtrim(line_slice(F.col("text"), F.lit(0), F.col("gen_col")), F.lit(" \t\r\n\f"))
    word = F.regexp_extract(before, "([\\p{L}\\p{N}_$\u200c\u200d]+)\\s*(?:[(,:]|(?<![=!<>+*/%|&^?-])=)?$", 1)
    rows = at.join(lines, ["of", "gen_line"]).withColumn("word", word).where(is_identifier(F.col("word")) & (F.col("word") == F.col("minified_name")))
    asked = rows.select("probe_id", F.col("of").alias("map_id"), F.col("gen_line").alias("line"), (F.col("gen_col") - utf16_length(F.col("word"))).alias("col"), "of")
    found = original_position(segs, asked).where("name_idx is not null").withColumnRenamed("of", "map_id")
    return found.join(names.select("map_id", "name_idx", "name"), ["map_id", "name_idx"]).select("probe_id", "name")
