"""Scopes text to rows: original scopes and generated ranges flattened by pre-order, one map's text at a time.

A map's scopes are a stack machine's program, so this runs in Arrow batches, one map per row; a bad program
gives one row with `error`. Trees are flattened: `parent` points to the row around, `depth` counts from 0.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.vlq import ALPHABET

#: The items' tags and the flags of a scope's and a range's start.
SCOPE_START, SCOPE_END, SCOPE_VARIABLES, RANGE_START, RANGE_END, BINDINGS, SUB_RANGE, CALL_SITE = range(1, 9)
HAS_NAME, HAS_KIND, IS_FRAME = 1, 2, 4
HAS_LINE, HAS_DEFINITION, RANGE_FRAME, RANGE_HIDDEN = 1, 2, 4, 8
SCHEMA = "map_id long, what string, id int, parent int, depth int, source_idx int, start_line int, start_col int, end_line int, end_col int, name string, kind string, is_stack_frame boolean, is_hidden boolean, definition int, call_site array<int>, variables array<string>, bindings array<string>, sub_ranges array<struct<variable:int,line:int,col:int,expression:string>>, error string"
VALUE = {c: i for i, c in enumerate(ALPHABET)}


class BadScopes(ValueError):
    pass


def unsigned(item: str) -> list[int]:
    out, value, shift = [], 0, 0
    for c in item:
        if c not in VALUE:
            raise BadScopes("InvalidBase64")
        value |= (VALUE[c] & 31) << shift
        shift += 5
        if not VALUE[c] & 32:
            out.append(value)
            value = shift = 0
    if shift:
        raise BadScopes("UnexpectedEof")
    return out


def signed(x: int) -> int:
    return -(x >> 1) if x & 1 else x >> 1


def read(text: str, names: list[str]) -> list[dict]:
    """The rows of one map's scopes."""

    def name(i: int) -> str:
        if not 0 <= i < len(names):
            raise BadScopes("InvalidNameIndex")
        return names[i]

    scopes: list[dict] = []
    ranges: list[dict] = []
    around: list[dict] = []
    open_ranges: list[dict] = []
    source = line = col = names_at = kinds_at = vars_at = g_line = g_col = defs_at = variable = 0
    for item in text.split(",") if text else ():
        if not item:  # a source without scopes
            if around:
                raise BadScopes("UnclosedScope")
            source += 1
            continue
        tag, *x = unsigned(item)
        x = iter(x)
        take = lambda: next(x, None)  # noqa: B023, E731
        need = lambda: _some(take())  # noqa: B023, E731
        if tag == SCOPE_START:
            if not around:
                line = col = 0
            flags, d = need(), need()
            line, col = line + d, need() + (0 if d else col)
            row = {"what": "scope", "id": len(scopes), "parent": around[-1]["id"] if around else None, "depth": len(around), "source_idx": source, "start_line": line, "start_col": col, "is_stack_frame": bool(flags & IS_FRAME), "variables": []}
            if flags & HAS_NAME:
                names_at += signed(need())
                row["name"] = name(names_at)
            if flags & HAS_KIND:
                kinds_at += signed(need())
                row["kind"] = name(kinds_at)
            scopes.append(row)
            around.append(row)
        elif tag == SCOPE_END:
            if not around:
                raise BadScopes("UnmatchedScopeEnd")
            d = need()
            line, col = line + d, need() + (0 if d else col)
            around.pop().update(end_line=line, end_col=col)
            source += not around
        elif tag == SCOPE_VARIABLES and around:
            for v in x:
                vars_at += signed(v)
                around[-1]["variables"].append(name(vars_at))
        elif tag == RANGE_START:
            flags = need()
            d = need() if flags & HAS_LINE else 0
            g_line, g_col = g_line + d, need() + (0 if d else g_col)
            row = {"what": "range", "id": len(ranges), "parent": open_ranges[-1]["id"] if open_ranges else None, "depth": len(open_ranges), "start_line": g_line, "start_col": g_col, "is_stack_frame": bool(flags & RANGE_FRAME), "is_hidden": bool(flags & RANGE_HIDDEN), "bindings": [], "sub_ranges": []}
            variable = 0
            if flags & HAS_DEFINITION:
                defs_at += signed(need())
                row["definition"] = defs_at
            ranges.append(row)
            open_ranges.append(row)
        elif tag == RANGE_END:
            if not open_ranges:
                raise BadScopes("UnmatchedRangeEnd")
            a, b = need(), take()
            d, c = (0, a) if b is None else (a, b)
            g_line, g_col = g_line + d, c + (0 if d else g_col)
            row = open_ranges.pop()
            row.update(end_line=g_line, end_col=g_col)
            told = {v: parts for v, parts in row.pop("parts", []) if v < len(row["bindings"])}
            row["sub_ranges"] = [p for v in sorted(told) for p in told[v]]
        elif tag == BINDINGS and open_ranges:
            open_ranges[-1]["bindings"] += [name(v - 1) if v else None for v in x]
        elif tag == SUB_RANGE and open_ranges:
            # Places run on from the range's start. A variable that has no binding has no sub-ranges either.
            row = open_ranges[-1]
            variable += need()
            at_line, at_col, parts = row["start_line"], row["start_col"], []
            for v in x:
                d = need()
                at_line, at_col = at_line + d, need() + (0 if d else at_col)
                parts.append({"variable": variable, "line": at_line, "col": at_col, "expression": name(v - 1) if v else None})
            row.setdefault("parts", []).append((variable, parts))
        elif tag == CALL_SITE and open_ranges:
            open_ranges[-1]["call_site"] = [need(), need(), need()]
    if around or open_ranges:
        raise BadScopes("UnclosedScope" if around else "UnclosedRange")
    return scopes + ranges


def _some(value: int | None) -> int:
    if value is None:
        raise BadScopes("UnexpectedEof")
    return value


_INTS, _TEXTS = ("id", "parent", "depth", "source_idx", "start_line", "start_col", "end_line", "end_col", "definition"), ("what", "name", "kind", "error")


def arrow_schema(map_id: pa.DataType) -> pa.Schema:
    part = pa.struct([("variable", pa.int32()), ("line", pa.int32()), ("col", pa.int32()), ("expression", pa.string())])
    kinds = {"call_site": pa.list_(pa.int32()), "variables": pa.list_(pa.string()), "bindings": pa.list_(pa.string()), "sub_ranges": pa.list_(part), "is_stack_frame": pa.bool_(), "is_hidden": pa.bool_(), "map_id": map_id}
    kinds |= dict.fromkeys(_INTS, pa.int32()) | dict.fromkeys(_TEXTS, pa.string())
    return pa.schema([(c, kinds[c]) for c in (f.split()[0] for f in re.split(r", (?![^<]*>)", SCHEMA))])


def decode_scopes(maps: DataFrame) -> DataFrame:
    """(map_id, scopes, names) to rows of SCHEMA; map_id keeps its type."""
    kind = maps.schema["map_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            schema = arrow_schema(b.schema.field(0).type)
            for map_id, text, names in zip(*(c.to_pylist() for c in b.columns), strict=True):
                try:
                    rows = read(text or "", names or [])
                except BadScopes as e:
                    rows = [{"error": str(e)}]
                if rows:
                    yield pa.RecordBatch.from_pylist([r | {"map_id": map_id} for r in rows], schema)

    return maps.select("map_id", "scopes", "names").mapInArrow(run, SCHEMA.replace("map_id long", f"map_id {kind}"))


def _digits(value: int) -> str:
    out = ""
    while True:
        value, five = value >> 5, value & 31
        out += ALPHABET[five | (32 if value else 0)]
        if not value:
            return out


def _zigzag(value: int) -> str:
    return _digits(-value * 2 + 1 if value < 0 else value * 2)


def write(rows: list[dict], names: list[str], n_sources: int) -> tuple[str, list[str]]:
    """The text of one map's rows, and the names with those added that it needs. Rows are in pre-order by id."""
    names = list(names)
    index = {n: i for i, n in reversed(list(enumerate(names)))}

    def of(name: str) -> int:
        if name not in index:
            index[name] = len(names)
            names.append(name)
        return index[name]

    items: list[str] = []
    scopes = sorted((r for r in rows if r["what"] == "scope"), key=lambda r: r["id"])
    ranges = sorted((r for r in rows if r["what"] == "range"), key=lambda r: r["id"])
    names_at = kinds_at = vars_at = defs_at = 0

    def place(at: list[int], line: int, col: int) -> tuple[int, str]:
        """The step in lines and the column's digits; at is moved on."""
        d = line - at[0]
        digits = _digits(col if d else col - at[1])
        at[:] = line, col
        return d, digits

    def end_scope(at: list[int], r: dict) -> None:
        d, col = place(at, r["end_line"], r["end_col"])
        items.append(_digits(SCOPE_END) + _digits(d) + col)

    def tree(rows: list[dict], begin, end) -> None:
        """Calls begin and end of rows in pre-order as their nesting has it."""
        around: list[dict] = []
        for r in rows:
            while around and around[-1]["id"] != r["parent"]:
                end(around.pop())
            begin(r)
            around.append(r)
        while around:
            end(around.pop())

    by_source: dict[int, list[dict]] = {}
    for r in scopes:
        by_source.setdefault(r["source_idx"], []).append(r)
    # Sources after the last one with scopes need no item.
    for source in range(max(by_source, default=-1) + 1 if not n_sources else max(n_sources, max(by_source, default=-1) + 1)):
        at = [0, 0]

        def begin(r: dict, at: list[int] = at) -> None:
            nonlocal names_at, kinds_at, vars_at
            flags = (HAS_NAME if r["name"] is not None else 0) | (HAS_KIND if r["kind"] is not None else 0) | (IS_FRAME if r["is_stack_frame"] else 0)
            d, col = place(at, r["start_line"], r["start_col"])
            item = _digits(SCOPE_START) + _digits(flags) + _digits(d) + col
            if r["name"] is not None:
                i = of(r["name"])
                item, names_at = item + _zigzag(i - names_at), i
            if r["kind"] is not None:
                i = of(r["kind"])
                item, kinds_at = item + _zigzag(i - kinds_at), i
            items.append(item)
            if r["variables"]:
                item = _digits(SCOPE_VARIABLES)
                for v in r["variables"]:
                    i = of(v)
                    item, vars_at = item + _zigzag(i - vars_at), i
                items.append(item)

        if source in by_source:
            tree(by_source[source], begin, lambda r, at=at: end_scope(at, r))
        else:
            items.append("")

    at = [0, 0]
    binding = lambda e: _digits(0 if e is None else of(e) + 1)

    def begin_range(r: dict) -> None:
        nonlocal defs_at
        d, col = place(at, r["start_line"], r["start_col"])
        flags = (HAS_LINE if d else 0) | (HAS_DEFINITION if r["definition"] is not None else 0) | (RANGE_FRAME if r["is_stack_frame"] else 0) | (RANGE_HIDDEN if r["is_hidden"] else 0)
        item = _digits(RANGE_START) + _digits(flags) + (_digits(d) if d else "") + col
        if r["definition"] is not None:
            item, defs_at = item + _zigzag(r["definition"] - defs_at), r["definition"]
        items.append(item)
        if r["bindings"]:
            items.append(_digits(BINDINGS) + "".join(binding(e) for e in r["bindings"]))
        last = 0
        parts: dict[int, list[dict]] = {}
        for p in r["sub_ranges"] or ():
            parts.setdefault(p["variable"], []).append(p)
        for v in sorted(parts):
            here = [r["start_line"], r["start_col"]]
            item, last = _digits(SUB_RANGE) + _digits(v - last), v
            for p in parts[v]:
                text = binding(p["expression"])
                d, col = place(here, p["line"], p["col"])
                item += text + _digits(d) + col
            items.append(item)
        if r["call_site"] is not None:
            items.append(_digits(CALL_SITE) + "".join(map(_digits, r["call_site"])))

    def end_range(r: dict) -> None:
        d, col = place(at, r["end_line"], r["end_col"])
        items.append(_digits(RANGE_END) + (_digits(d) if d else "") + col)

    tree(ranges, begin_range, end_range)
    return ",".join(items), names


def encode_scopes(rows: DataFrame, maps: DataFrame) -> DataFrame:
    """(map_id, scopes, names) of rows of SCHEMA; maps (map_id, names, n_sources) give the names to begin with."""
    kind = maps.schema["map_id"].dataType.simpleString()
    held = rows.where("error is null").groupBy("map_id").agg(F.collect_list(F.struct(*[c for c in rows.columns if c not in ("map_id", "error")])).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [write(r or [], n or [], k or 0) for r, n, k in zip(*(b.column(i).to_pylist() for i in (1, 2, 3)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in made], pa.string()), pa.array([n for _, n in made], pa.list_(pa.string()))], ["map_id", "scopes", "names"])

    both = held.join(maps, "map_id").select("map_id", "rows", "names", "n_sources")
    return both.mapInArrow(run, f"map_id {kind}, scopes string, names array<string>")


def merge_scopes(parts: DataFrame, scopes: DataFrame, source_index: DataFrame) -> DataFrame:
    """Scopes of flattened sections: of a source's scopes those of the first section count, ranges are moved, definitions renumbered.

    parts (out_id, ord, map_id, line, column), scopes are rows of SCHEMA by map_id, source_index is
    (out_id, ord, local_idx, source_idx). Gives rows of SCHEMA by out_id as map_id.
    """
    of = parts.select("out_id", "ord", "map_id", "line", "column")
    rows = scopes.where("error is null").join(of, "map_id")
    own = rows.where("what = 'scope'").join(source_index.select("out_id", "ord", F.col("local_idx").alias("source_idx"), F.col("source_idx").alias("new_source")), ["out_id", "ord", "source_idx"])
    first = own.groupBy("out_id", "new_source").agg(F.min(F.struct("ord", "source_idx")).alias("first"))
    chosen = own.join(first, ["out_id", "new_source"]).withColumn("chosen", F.struct("ord", "source_idx") == F.col("first"))
    # Places within a source's tree stay; the trees follow each other by source.
    place = F.row_number().over(Window.partitionBy("out_id", "ord", "source_idx").orderBy("id")) - 1
    placed = chosen.withColumn("place", place)
    sizes = placed.where("chosen").groupBy("out_id", "new_source").agg(F.count("*").alias("n"))
    before = Window.partitionBy("out_id").orderBy("new_source").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    # Every section's definitions point into the tree that counts.
    numbered = placed.join(bases, ["out_id", "new_source"]).withColumn("new_id", (F.col("base") + F.col("place")).cast("int"))
    ids = numbered.select("out_id", "ord", F.col("id").alias("definition"), F.col("new_id").alias("new_definition"))
    up = numbered.select("out_id", "ord", F.col("id").alias("parent"), F.col("new_id").alias("new_parent"))
    kept = numbered.where("chosen").join(up, ["out_id", "ord", "parent"], "left")
    out_scopes = kept.withColumns({"id": F.col("new_id"), "parent": F.col("new_parent"), "source_idx": F.col("new_source"), "map_id": F.col("out_id")})
    ranges = rows.where("what = 'range'").join(ids, ["out_id", "ord", "definition"], "left")
    move = lambda line, col: F.when(line == 0, col + F.col("column")).otherwise(col)
    shift = {f"{k}_col": move(F.col(f"{k}_line"), F.col(f"{k}_col")).cast("int") for k in ("start", "end")}
    ranges = ranges.withColumns(shift | {"sub_ranges": F.transform("sub_ranges", lambda p: F.struct(p["variable"].alias("variable"), (p["line"] + F.col("line")).cast("int").alias("line"), move(p["line"], p["col"]).cast("int").alias("col"), p["expression"].alias("expression")))})
    ranges = ranges.withColumns({f"{k}_line": (F.col(f"{k}_line") + F.col("line")).cast("int") for k in ("start", "end")})
    w = Window.partitionBy("out_id").orderBy("ord", "id")
    ranges = ranges.withColumn("old", F.col("id")).withColumn("id", (F.row_number().over(w) - 1).cast("int"))
    parents = ranges.select("out_id", "ord", F.col("old").alias("parent"), F.col("id").alias("new_parent"))
    ranges = ranges.join(parents, ["out_id", "ord", "parent"], "left")
    site = source_index.select("out_id", "ord", F.col("local_idx").alias("site"), F.col("source_idx").alias("new_site"))
    ranges = ranges.withColumn("site", F.get("call_site", F.lit(0))).join(site, ["out_id", "ord", "site"], "left")
    sited = F.when(F.col("call_site").isNotNull(), F.concat(F.array("new_site"), F.slice("call_site", 2, 2)))
    ranges = ranges.withColumns({"parent": F.col("new_parent"), "definition": F.col("new_definition"), "call_site": sited, "map_id": F.col("out_id")})
    return out_scopes.select(*scopes.columns).unionByName(ranges.select(*scopes.columns))
