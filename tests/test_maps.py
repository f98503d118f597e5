"""Golden rows of the map operators, and round trips."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from meridian.functions import text
from meridian.functions.vlq import vlq_encode, vlq_signed
from meridian.map_queries import ORACLE_SQL, QUERIES
from meridian.operators import compose, lookup, mappings
from meridian.sources import maps


def decoded(spark, *rows):
    return mappings.decode_mappings(spark.createDataFrame(list(rows), "map_id int, mappings string, range_mappings string"))


def probe(spark, segs, line, col, lub=False):
    r = lookup.original_position(segs, spark.createDataFrame([(1, 1, line, col)], "probe_id long, map_id int, line int, col int"), lub).first()
    return (r.orig_line, r.orig_col)


def test_vlq(spark):
    values = [0, 1, -1, 15, 16, -16, 31, 32, 1000, -123456, 2**31]
    rows = spark.createDataFrame([(v,) for v in values], "v long").select("v", vlq_encode(F.col("v")).alias("t")).select("v", "t", vlq_signed(F.col("t")).alias("back")).collect()
    assert [r.t for r in rows][:3] == ["A", "C", "D"] and all(r.v == r.back for r in rows)


def test_decode_and_errors(spark):
    got = decoded(spark, (1, "AAAA;AACA,EAAE", None), (2, "AC", None), (3, "", None), (4, "AAAA;;;AACA", None), (5, "AAAAAA", None)).orderBy("map_id", "gen_line", "seg_idx").collect()
    assert [(r.gen_line, r.gen_col, r.source_idx, r.orig_line, r.orig_col) for r in got if r.map_id == 1] == [(0, 0, 0, 0, 0), (1, 0, 0, 1, 0), (1, 2, 0, 1, 2)]
    assert [(r.gen_line, r.orig_line) for r in got if r.map_id == 4] == [(0, 0), (3, 1)]
    assert not [r for r in got if r.map_id in (2, 3)] and [r.name_idx for r in got if r.map_id == 5] == [0, None]
    bad = spark.createDataFrame([(1, "AC"), (2, "AA!A"), (3, "g"), (4, "ggggggggggggggA"), (5, "ACA"), (6, "AAAA")], "map_id int, mappings string")
    assert {r.map_id: r.kind for r in mappings.mapping_errors(bad).collect()} == {1: "InvalidSegmentLength", 2: "InvalidBase64", 3: "UnexpectedEof", 4: "VlqOverflow", 5: "InvalidSegmentLength"}


def test_encode_round_trip(spark):
    texts = {1: "AAAA;AACA,EAAE", 2: "AAAA;;;AACA", 3: "AAAAA,SACIC", 4: "AAAAA;ACAAC,KACCC", 5: ";;A,CAAC"}
    segs = decoded(spark, *[(k, v, None) for k, v in texts.items()])
    assert {r.map_id: r.mappings for r in mappings.encode_mappings(segs).collect()} == texts
    flagged = decoded(spark, (1, "AAAA,CAAC,GAAG", "A,C"), (2, "AAAA,CAAC;AAAA,CAAC", "A;B"))
    assert [r.is_range for r in flagged.orderBy("map_id", "gen_line", "seg_idx").collect()] == [True, False, True, True, False, False, True]
    assert {r.map_id: r.range_mappings for r in mappings.encode_ranges(flagged).collect()} == {1: "A,C", 2: "A;B"}


def test_lookup_with_ranges(spark):
    segs = decoded(spark, (1, "AAAA,GAAG", "A"))
    assert [probe(spark, segs, 0, c) for c in range(4)] == [(0, 0), (0, 1), (0, 2), (0, 3)]
    segs = decoded(spark, (1, "AAAA;KACK", "A"))
    assert probe(spark, segs, 1, 2) == (1, 0) and probe(spark, segs, 7, 2) == (None, None)
    segs = decoded(spark, (1, "AAAA", "A"))
    assert probe(spark, segs, 2, 10) == (2, 0)
    segs = decoded(spark, (1, "KAAK", "A"))
    assert probe(spark, segs, 0, 2) == (None, None) and probe(spark, segs, 0, 2, lub=True) == (0, 5)


def test_compose(spark):
    outer, inner = decoded(spark, (1, "AAAA;AACA", None)), decoded(spark, (9, "AACA;AACA", None))
    edges = spark.createDataFrame([(1, 0, 9, "mid.js")], "map_id int, source_idx int, upstream_id int, source string")
    none = spark.createDataFrame([], "map_id int, name_idx int, name string")
    sources = spark.createDataFrame([(9, 0, "original.js")], "map_id int, source_idx int, source string")
    got = compose.remap(outer, edges, inner, none, none, sources).orderBy("gen_line").collect()
    assert [(r.source, r.orig_line) for r in got] == [("original.js", 1), ("original.js", 2)]


def test_parse_and_sources(spark):
    ok = {"version": 3, "sourceRoot": "src", "sources": ["a.js", None], "names": ["x"], "mappings": "AAAA", "ignoreList": [], "x_google_ignoreList": [1]}
    rows = maps.parse(spark.createDataFrame([("a", json.dumps(ok)), ("b", '{"version":2,"mappings":""}'), ("c", "{")], "map_id string, json string"))
    assert {r.map_id: r.error for r in rows.collect()} == {"a": None, "b": "InvalidVersion", "c": "Json"}
    assert [(r.source, r.ignored) for r in maps.map_sources(rows.where("error is null")).orderBy("source_idx").collect()] == [("srca.js", False), ("", False)]


def test_text(spark):
    assets = spark.createDataFrame([(1, "a😀\r\nb\rc\n"), (2, "")], "asset_id int, text string")
    assert [(r.line, r.text) for r in text.source_lines(assets).where("asset_id = 1").orderBy("line").collect()] == [(0, "a😀"), (1, "b"), (2, "c")]
    probes = spark.createDataFrame([(i, 1, i) for i in range(14)], "probe_id int, asset_id int, offset int")
    got = {r.probe_id: (r.line, r.col) for r in text.offset_positions(assets, probes).collect()}
    assert got == {0: (0, 0), 1: (0, 1), 5: (0, 3), 6: (0, 3), 7: (1, 0), 8: (1, 1), 9: (2, 0), 10: (2, 1), 11: (3, 0)}
    stacks = spark.createDataFrame([(1, "Error: test\n    at foo (bundle.js:10:5)\n    at bundle.js:20:10"), (2, "handler@http://localhost:8080/app.js:42:13\n@b.js:1:2")], "trace_id int, stack string")
    assert [(r.function_name, r.file, r.line, r.col) for r in text.stack_frames(stacks).orderBy("trace_id", "frame_no").collect()] == [("foo", "bundle.js", 10, 5), (None, "bundle.js", 20, 10), ("handler", "http://localhost:8080/app.js", 42, 13), (None, "b.js", 1, 2)]


def test_eval_frames_and_messages(spark):
    stacks = [(1, "Error: x\n    at eval (eval at bar (a.js:1:2), <anonymous>:3:4)\n    at foo (b.js:5)"), (2, "@a.js:1:99999999999"), (3, "    at f (x.js:1:2)\r\n    at (:1:2)"), (4, ""), (5, None)]
    rows = spark.createDataFrame(stacks, "trace_id int, stack string")
    got = [tuple(r) for r in text.stack_frames(rows).orderBy("trace_id", "frame_no").collect()]
    assert got == [(1, 1, "eval (eval at bar", "a.js:1:2), <anonymous>", 3, 4), (3, 0, "f", "x.js", 1, 2)]
    assert {r.trace_id: r.message for r in text.stack_messages(rows).collect()} == {1: "Error: x", 2: None, 3: None, 4: ""}


def test_codec_equals_plain_reader():
    import random

    digit = {c: i for i, c in enumerate(mappings.ALPHABET)}

    def value(b, pos):
        i, total, n = pos, 0, 0
        while True:
            if i >= len(b):
                raise ValueError((i, "UnexpectedEof", i, 0))
            if b[i] not in digit:
                raise ValueError((i, "InvalidBase64", i, 0))
            n += 1
            if n > 13:
                raise ValueError((i, "VlqOverflow", pos, 0))
            total += (digit[b[i]] & 31) << 5 * (n - 1)
            i += 1
            if digit[b[i - 1]] < 32:
                break
        out = -(total >> 1) if total & 1 else total >> 1
        if not -(2**63) <= out < 2**63:
            raise ValueError((i - 1, "VlqOverflow", pos, 0))
        return out, i

    def plain(b):
        out, run, line, col, pos = [], [0] * 4, 0, 0, 0
        try:
            while pos < len(b):
                if b[pos] in ",;":
                    line, col, pos = (line + 1, 0, pos + 1) if b[pos] == ";" else (line, col, pos + 1)
                    continue
                got = []
                while pos < len(b) and b[pos] not in ",;" and len(got) < 5:
                    d, pos = value(b, pos)
                    got.append(d)
                if len(got) in (2, 3):
                    raise ValueError((pos, "InvalidSegmentLength", pos, len(got)))
                col += got[0]
                run = [r + d for r, d in zip(run, got[1:] + [0] * (5 - len(got)), strict=False)]
                out.append((line, len(got), col, *run[: len(got) - 1]))
        except ValueError as e:
            return out, e.args[0]
        return out, None

    rng = random.Random(3)
    for t in range(2000):
        pool = rng.choice(["AC;,DEg", "ACDgh/;,;", "ACDEFGHg", "ABCDEFGHIJKLMNOPQ;,,gh!", " A,;", "g/9A"])
        s = "".join(rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 5, 9, 30])))
        if t % 9 == 0:
            s = "h" + "g" * 11 + rng.choice("ABCDPQR") + rng.choice(["", ",A", "AAA"])
        got, error = mappings.read(s)
        rows = [tuple(int(got[k][i]) for k in ("line", "n", *mappings.FIELDS)) for i in range(len(got["line"]))]
        assert ([(*r[:3], *r[3 : 2 + r[1]]) for r in rows], error) == plain(s), s


def test_batches_of_one_map(spark):
    """A map whose rows come in many batches, and maps whose ids are strings or null."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(k, i // 3, i % 3, i % 3 * 2, *((i % 2, i * 5 % 11, i % 4, i % 3 if i % 5 else None) if i % 6 else (None,) * 4), i % 7 == 1) for k in ("a", None, "b") for i in range(40)]
        segs = spark.createDataFrame(rows, "map_id string, gen_line int, seg_idx int, gen_col int, source_idx int, orig_line int, orig_col int, name_idx int, is_range boolean")
        back = mappings.decode_mappings(mappings.encode_maps(segs)).select(*segs.columns)
        assert sorted(map(str, back.collect())) == sorted(map(str, segs.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_json_round_trip(spark):
    raw = '{"version":3,"file":"o\\"ut.js","sources":["a.js",null],"sourcesContent":["x",null],"names":["é"],"mappings":"AAAA","ignoreList":[1],"debugId":"d","scopes":"BAAA,CAA","x_b":{"z":[1,"s"]},"x_a":"t"}'
    rows = maps.parse(spark.createDataFrame([(1, raw), (2, '{"version":3,"mappings":"","sources":[],"names":[],"other":1}'), (3, "[]"), (4, None)], "map_id int, json string"))
    assert {r.map_id: r.error for r in rows.collect()} == {1: None, 2: None, 3: "Json", 4: "Json"}
    out = {r.map_id: r.json for r in maps.to_json(rows.where("error is null")).collect()}
    want = json.loads(raw)
    assert json.loads(out[1]) == want and list(json.loads(out[1]))[-2:] == ["x_a", "x_b"]
    assert out[2] == '{"version":3,"sources":[],"names":[],"mappings":""}'


def test_urls(spark):
    rows = spark.createDataFrame([("data:application/json;charset=UTF-8;base64,e30",), ("data:application/json,%7B%22a+b%22:%zz1%7D",), ("x.map",), ("data:application/json;base64,!",)], "u string")
    assert [r[0] for r in rows.select(text.from_data_url(F.col("u"))).collect()] == ["{}", '{"a+b":%zz1}', None, None]
    scripts = spark.createDataFrame([("a\n//# sourceMappingURL=x.map\nb",), ("/*# sourceMappingURL=y.map */",), ("//# sourceMappingURL=data:application/json;base64,e30=",), ("none",), ("//# sourceMappingURL=data:application/json;base64,!",)], "t string")
    got = [tuple(r[0]) if r[0] else None for r in scripts.select(text.sourcemap_url(F.col("t"))).collect()]
    assert got == [("external", "x.map"), ("external", "y.map"), ("inline", "{}"), None, ("external", "data:application/json;base64,!")]


def long_line(spark, n=25000):
    """A map with all segments on one line, more than a few of Spark's batches (10,000 rows) hold."""
    return spark.range(n).selectExpr("1 as map_id", "2 as gen_line", "cast(id as int) as seg_idx", "cast(id * 3 as int) as gen_col", "cast(id % 7 as int) as source_idx", "cast(id % 40 as int) as orig_line", "cast(id % 9 as int) as orig_col", "cast(null as int) as name_idx", "id % 5 = 0 as is_range")


def test_encode_line_over_batches(spark):
    segs = long_line(spark)
    back = mappings.decode_mappings(mappings.encode_mappings(segs)).drop("is_range")
    assert back.count() == 25000 and not back.exceptAll(segs.drop("is_range")).count()


def test_partial_lines_over_batches(spark):
    segs = long_line(spark).drop("is_range")
    after = segs.selectExpr("map_id", "3 as gen_line", "seg_idx", *segs.columns[3:])
    got = mappings.decode_mappings(mappings.encode_mappings(segs.unionByName(after)), lines=(3, 4)).drop("is_range")
    assert got.count() == 25000 and not got.exceptAll(after).count()


def test_ranges_over_batches(spark):
    segs = long_line(spark)
    back = mappings.decode_mappings(mappings.encode_maps(segs))
    assert back.where("is_range").count() == 5000 and not back.exceptAll(segs).count()


def test_remap_text_over_batches(spark):
    outer = long_line(spark).drop("is_range")
    edges = spark.range(7).selectExpr("1 as map_id", "cast(id as int) as source_idx", "cast(null as int) as upstream_id", "concat('s', id) as source")
    none = spark.createDataFrame([], "map_id int, name_idx int, name string")
    sources = spark.createDataFrame([], "map_id int, source_idx int, source string")
    got = compose.remap_text(mappings.encode_mappings(outer), edges, outer, none, none, sources)
    want = outer.selectExpr("map_id", "gen_line", "seg_idx", "gen_col", "concat('s', source_idx) as source", "orig_line", "orig_col")
    assert got.count() == 25000 and not got.select(*want.columns).exceptAll(want).count()


@pytest.mark.parametrize("name", ["partial_lines", "ranges_round_trip", "remapped_text"])
def test_query_over_small_batches(spark, name):
    """Batches of three rows cut most lines, many of them where the rest of the map's rows goes on with the line."""
    sf, batch = "/root/testdata/sf0.001", "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "3")
    try:
        got = [tuple(r) for r in QUERIES[name](spark, sf).collect()]
    finally:
        spark.conf.set(batch, before)
    con = duckdb.connect()
    con.execute(f"create view lineitem as select * from '{sf}/lineitem.parquet'")
    want = con.execute(ORACLE_SQL[name]).fetchall()
    assert want and sorted(got, key=repr) == sorted(want, key=repr)
