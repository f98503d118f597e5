"""Validation, sections, symbolication, function maps and bundles."""

import struct

from meridian.operators import scopes, symbolicate, validate
from meridian.sources import ram_bundle

SEG = "map_id int, gen_line int, seg_idx int, gen_col int, source_idx int, orig_line int, orig_col int, name_idx int, is_range boolean"


def test_validate(spark):
    segs = spark.createDataFrame([(1, 0, 0, 5, 0, 0, 0, 9, False), (1, 0, 1, 2, 7, 0, 0, None, False)], SEG)
    sources = spark.createDataFrame([(1, 0), (1, 1)], "map_id int, source_idx int")
    names = spark.createDataFrame([(1, 0)], "map_id int, name_idx int")
    ignores = spark.createDataFrame([(1, 4)], "map_id int, source_idx int")
    assert {(r.warning, r.detail) for r in validate.validate_deep(segs, sources, names, ignores).collect()} == {("order", "0:2"), ("source", "7"), ("name", "9"), ("ignore", "4"), ("unreferenced", "1")}


def test_sections_and_prefix(spark):
    parts = spark.createDataFrame([(1, 0, 0, 0, "{}"), (1, 1, 2, 3, "{}")], "map_id int, section_idx int, line int, column int, json string")
    segs = spark.createDataFrame([(1, 1, 0, 0, 1), (1, 1, 1, 0, 1)], "map_id int, section_idx int, gen_line int, seg_idx int, gen_col int")
    assert {(r.gen_line, r.gen_col) for r in validate.flatten_sections(parts, segs).collect()} == {(2, 4), (3, 1)}
    bad = spark.createDataFrame([(1, 0, 1, 0, "{}"), (1, 1, 0, 0, "{}"), (2, 0, 0, 0, '{"sections":[]}')], "map_id int, section_idx int, line int, column int, json string")
    assert {r.map_id: r.kind for r in validate.section_errors(bad).collect()} == {1: "SectionsNotOrdered", 2: "NestedIndexMap"}
    paths = spark.createDataFrame([(1, "/a/b/c.js"), (1, "/a/b/d/e.js"), (1, "rel.js"), (2, "/x/y.js")], "map_id int, source string")
    assert {r.map_id: r.prefix for r in validate.common_prefix(paths).collect()} == {1: "/a/b/"}


def test_symbolicate(spark):
    segs = spark.createDataFrame([(1, 9, 0, 4, 0, 41, 2, 0, False)], SEG)
    frames = spark.createDataFrame([(1, 1, "f", "b.js", 10, 5), (1, 2, None, "other.js", 1, 1)], "trace_id int, frame_no int, function_name string, file string, line int, col int")
    files = spark.createDataFrame([("b.js", 1)], "file string, map_id int")
    sources = spark.createDataFrame([(1, 0, "src.ts")], "map_id int, source_idx int, source string")
    names = spark.createDataFrame([(1, 0, "render")], "map_id int, name_idx int, name string")
    out = symbolicate.symbolicate(frames, files, segs, sources, names)
    assert [tuple(r) for r in out.orderBy("frame_no").collect()] == [(1, 1, "render", "src.ts", 42, 3, True), (1, 2, None, "other.js", 1, 1, False)]
    text = symbolicate.format_stacks(out, spark.createDataFrame([(1, "Error: x")], "trace_id int, message string")).first().text
    assert text == "Error: x\n    at render (src.ts:42:3)\n    at <anonymous> (other.js:1:1)"


def test_hermes(spark):
    offsets = symbolicate.decode_hermes(spark.createDataFrame([(1, 0, "AAA,ECA,GGC")], "map_id int, source_idx int, mappings string"))
    assert [(r.line, r.col, r.name_idx) for r in offsets.orderBy("ord").collect()] == [(0, 0, 0), (0, 2, 1), (1, 5, 4)]
    probes = spark.createDataFrame([(1, 1, 0, 0, 1), (2, 1, 0, 1, 0), (3, 1, 0, 9, 9)], "probe_id long, map_id int, source_idx int, line int, col int")
    assert {r.probe_id: r.name_idx for r in symbolicate.hermes_function(offsets, probes).collect()} == {1: 0, 2: 1, 3: 4}


def test_enclosing_function(spark):
    ranges = spark.createDataFrame([(1, 0, None, 0, (0, 0), (9, 0), True, False, "outer"), (1, 1, 0, 1, (2, 0), (3, 5), True, False, "inner")], "map_id int, range_id int, parent int, depth int, start struct<line:int,col:int>, end struct<line:int,col:int>, is_stack_frame boolean, is_hidden boolean, name string")
    probes = spark.createDataFrame([(1, 1, 2, 4), (2, 1, 3, 6), (3, 1, 9, 0), (4, 1, 9, 1)], "probe_id long, map_id int, line int, col int")
    assert {r.probe_id: r.name for r in symbolicate.enclosing_function(probes, ranges).collect()} == {1: "inner", 2: "outer", 3: "outer"}


def test_ram_bundle(spark):
    data = struct.pack("<III", 0xFB0BD1E5, 3, 4) + struct.pack("<IIIIII", 0, 3, 0, 0, 3, 2) + b"init" + b"aaabb"
    rows = ram_bundle.modules(spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"no"))], "bundle_id int, content binary")).collect()
    assert {(r.module_id, r.source_code) for r in rows} == {(0, "aaa"), (2, "bb")}


def test_enclosing_function_rules(spark):
    rows = [(1, 0, None, 0, (0, 0), (5000, 0), True, False, "a"), (1, 1, 0, 1, (10, 0), (20, 0), True, True, "hidden"), (1, 2, 0, 1, (20, 0), (30, 0), True, False, "b"), (1, 3, 2, 2, (20, 0), (21, 0), True, False, None), (1, 4, 0, 1, (40, 0), (50, 0), True, False, "")]
    ranges = spark.createDataFrame(rows, "map_id int, range_id int, parent int, depth int, start struct<line:int,col:int>, end struct<line:int,col:int>, is_stack_frame boolean, is_hidden boolean, name string")
    asked = [(i, 1, line, 0) for i, line in enumerate((0, 15, 20, 25, 45, 5000, 5001))]
    got = {r.probe_id: r.name for r in symbolicate.enclosing_function(spark.createDataFrame(asked, "probe_id long, map_id int, line int, col int"), ranges).collect()}
    # At 20 the hidden range is the first of the two that share the border; an empty name ends the search at 45.
    assert got == {0: "a", 1: "a", 2: "a", 3: "b", 5: "a"}


def test_hermes_errors(spark):
    rows = [(1, 0, "AAA,EC"), (2, 0, "DAA"), (3, 0, "AAA,EC!"), (4, 0, ""), (5, 0, "AAAA"), (6, 0, "AAAEC,A"), (7, 0, "AAA,,ECA")]
    maps = spark.createDataFrame(rows, "map_id int, source_idx int, mappings string")
    assert {r.map_id: r.kind for r in symbolicate.hermes_errors(maps).collect()} == {1: "InvalidFunctionMap", 2: "InvalidFunctionMap", 3: "InvalidBase64", 5: "InvalidFunctionMap", 6: "InvalidFunctionMap"}
    assert {r.map_id for r in symbolicate.decode_hermes(maps).collect()} == {7}


def test_stream(spark, tmp_path):
    from meridian.streaming.lookup import follow

    segs = spark.createDataFrame([(1, 0, 0, 4, 0, 41, 2, 0)], SEG.removesuffix(", is_range boolean"))
    spark.createDataFrame([(7, 1, 0, 9), (8, 1, 0, 1)], "probe_id long, map_id int, line int, col int").write.parquet(f"{tmp_path}/in")
    probes = spark.readStream.schema("probe_id long, map_id int, line int, col int").parquet(f"{tmp_path}/in")
    follow(probes, lambda: segs, f"{tmp_path}/out", f"{tmp_path}/cp", once=True).awaitTermination(120)
    assert {(r.probe_id, r.orig_line) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {(7, 41), (8, None)}


def test_commands(spark, tmp_path, capsys):
    import json

    from meridian import __main__ as command

    outer = {"version": 3, "file": "o.js", "sources": ["mid.ts"], "names": ["n"], "mappings": "AAAAA;AACA"}
    inner = {"version": 3, "sources": ["deep.ts"], "sourcesContent": ["a\nb\nc"], "names": [], "mappings": "AACA;AACA"}
    for name, m in (("o.js.map", outer), ("up/mid.map", inner), ("bad.map", {"version": 2, "mappings": ""})):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(json.dumps(m))
    (tmp_path / "s.txt").write_text("Error: e\n    at f (o.js:1:1)")
    stop, spark.stop = spark.stop, lambda: None

    def rows(*args):
        code = command.main([str(a) for a in args])
        return code, [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    one = tmp_path / "o.js.map"
    try:
        assert rows("info", one)[1][0]["n_mappings"] == 2
        assert rows("validate", tmp_path / "bad.map") [0] == 1 and rows("validate", one)[0] == 0
        assert rows("lookup", one, "--line", 1)[1][0] | {"map_id": 0} == {"map_id": 0, "orig_line": 1, "orig_col": 0, "source": "mid.ts"}
        assert rows("resolve", one, "--source", "mid.ts", "--line", 1)[1][0]["gen_line"] == 1
        assert len(rows("decode", one)[1]) == 2 and rows("encode", one)[1][0]["mappings"] == outer["mappings"]
        assert len(rows("mappings", one, "--limit", 1)[1]) == 1 and rows("sources", one)[1][0]["has_content"] is False
        made = json.loads(rows("remap", one, "--upstream", tmp_path / "up" / "*.map")[1][0]["json"])
        assert made["sources"] == ["deep.ts"] and made["names"] == ["n"] and made["mappings"] == "AACAA;AACA" and made["sourcesContent"] == ["a\nb\nc"]
        made = json.loads(rows("concat", one, "--file", "b.js")[1][0]["json"])
        assert made["file"] == "b.js" and made["mappings"] == outer["mappings"]
        assert rows("symbolicate", one, "--stacks", tmp_path / "s.txt")[1][0]["text"] == "Error: e\n    at n (mid.ts:1:1)"
        assert rows("scopes", one)[1] == [] and len(rows("schema")[1]) == len(command.VERBS)
    finally:
        spark.stop = stop


def test_written_contents(spark, tmp_path):
    import json

    from meridian.sources import maps

    m = maps.parse(spark.createDataFrame([(1, json.dumps({"version": 3, "sources": ["webpack:///./a.ts", "../b.ts", "c.ts"], "sourcesContent": ["A", "B", None], "mappings": ""}))], "map_id int, json string"))
    assert [tuple(r) for r in maps.write_contents(m, f"{tmp_path}/contents").collect()] == [(1, "a.ts", "A")]


def test_files_of_maps_and_modules(spark, tmp_path):
    from meridian.sources import maps

    m = maps.parse(spark.createDataFrame([(1, '{"version":3,"sources":["a"],"sourcesContent":["x\\ny"],"names":[],"mappings":"AAAA"}')], "map_id int, json string"))
    maps.write_json(m, f"{tmp_path}/maps")
    assert [r.value for r in spark.read.text(f"{tmp_path}/maps").collect()] == ['{"version":3,"sources":["a"],"sourcesContent":["x\\ny"],"names":[],"mappings":"AAAA"}']
    (tmp_path / "un" / "js-modules").mkdir(parents=True)
    for name, code in (("0.js", "zero"), ("12.js", "twelve"), ("UNBUNDLE.js", "no")):
        (tmp_path / "un" / "js-modules" / name).write_text(code)
    assert {tuple(r) for r in ram_bundle.unbundled(spark, f"{tmp_path}/un").collect()} == {(0, "zero"), (12, "twelve")}


def test_symbolicate_broadcasts_nothing(spark):
    segs = spark.createDataFrame([(1, 9, 0, 4, 0, 41, 2, None, False)], SEG).drop("is_range")
    frames = spark.createDataFrame([(1, 1, "f", "b.js", 10, 5)], "trace_id int, frame_no int, function_name string, file string, line int, col int")
    files = spark.createDataFrame([("b.js", 1)], "file string, map_id int")
    sources = spark.createDataFrame([(1, 0, "src.ts")], "map_id int, source_idx int, source string")
    names = spark.createDataFrame([(1, 0, "render")], "map_id int, name_idx int, name string")
    functions = symbolicate.function_ranges(scopes.decode_scopes(spark.createDataFrame([(1, "BFAAA,CDB,EGAA,FKF", ["outer"])], "map_id int, scopes string, names array<string>")))
    out = symbolicate.symbolicate(frames, files, segs, sources, names, functions)
    assert [tuple(r) for r in out.collect()] == [(1, 1, "outer", "src.ts", 42, 3, True)]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
