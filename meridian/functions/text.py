"""Text and position functions: lines, UTF-16 columns, byte offsets, stack frames, paths and URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The comments that name a map, and the schemes of embedded ones.
URL_COMMENTS = ("//# sourceMappingURL=", "//@ sourceMappingURL=", "/*# sourceMappingURL=", "/*@ sourceMappingURL=")
BASE64_PREFIXES = ("data:application/json;base64,", "data:application/json;charset=utf-8;base64,", "data:application/json;charset=UTF-8;base64,")
PLAIN_PREFIX = "data:application/json,"


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def line_slice(line: Column, col: Column, span: Column) -> Column:
    """span UTF-16 units from col on; null if it begins or ends inside a character or passes the end."""
    units = F.encode(line, "UTF-16BE")
    unit = lambda i: F.hex(F.substr(units, (i * 2 + 1).cast("int"), F.lit(1)))
    inside = lambda i: unit(i).between("DC", "DF")
    ok = (col >= 0) & (span >= 0) & (col + span <= utf16_length(line)) & ~inside(col) & ~inside(col + span)
    return F.when(ok, F.decode(F.substr(units, (col * 2 + 1).cast("int"), (span * 2).cast("int")), "UTF-16BE"))


def source_lines(assets: DataFrame) -> DataFrame:
    """(asset_id, line, text) of (asset_id, text): LF, CR and CRLF end lines; a trailing end adds none."""
    lines = F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n", -1)
    rows = assets.select("asset_id", lines.alias("lines"))
    rows = rows.withColumn("lines", F.when(F.element_at("lines", -1) == "", F.slice("lines", F.lit(1), F.size("lines") - 1)).otherwise(F.col("lines")))
    return rows.select("asset_id", F.posexplode("lines").alias("line", "text"))


def line_slices(assets: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe_id, text) of probes (probe_id, asset_id, line, col, span); null where there is no such slice."""
    lines = source_lines(assets).withColumnRenamed("text", "whole")
    return probes.join(lines, ["asset_id", "line"], "left").select("probe_id", line_slice(F.col("whole"), F.col("col"), F.col("span")).alias("text"))


def offset_positions(assets: DataFrame, offsets: DataFrame) -> DataFrame:
    """(probe_id, line, col) of byte offsets (probe_id, asset_id, offset) of (asset_id, text), and their further columns.

    Columns are UTF-16 units. A line end's bytes map to the line's end; inside a character or out of bounds there is no
    row. A trailing line end adds a line. Lines and offsets are united and sorted by bytes, so an offset meets its line
    only, however large the asset.
    """
    pieces = assets.select("asset_id", F.posexplode(F.split("text", "(?<=\n)|(?<=\r)(?!\n)", -1)).alias("line", "piece"))
    size = F.octet_length("piece")
    before = Window.partitionBy("asset_id").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    starts = pieces.select("asset_id", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("at"), F.lit(0).alias("kind"), F.struct("line", "piece", F.coalesce(F.sum(size).over(before), F.lit(0)).alias("start")).alias("own"))
    keep = [c for c in offsets.columns if c not in ("asset_id", "offset")]
    asked = offsets.select("asset_id", F.col("offset").cast("long").alias("at"), F.lit(1).alias("kind"), F.struct(*keep).alias("ask"))
    w = Window.partitionBy("asset_id").orderBy("at", "kind", "own.line").rowsBetween(Window.unboundedPreceding, 0)
    rows = starts.unionByName(asked, allowMissingColumns=True).withColumn("own", F.last("own", ignorenulls=True).over(w)).where("kind = 1 and own is not null")
    rows = rows.select("ask", F.col("own.line").alias("line"), (F.col("at") - F.col("own.start")).cast("int").alias("k"), F.encode("own.piece", "UTF-8").alias("raw"), F.rtrim(F.col("own.piece"), F.lit("\r\n")).alias("content"))
    inside = F.expr("hex(substring(raw, k + 1, 1))").rlike("^[89AB]")
    rows = rows.where((F.col("k") <= F.octet_length("raw")) & ~inside)
    col = F.when(F.col("k") >= F.octet_length("content"), utf16_length(F.col("content"))).otherwise(utf16_length(F.expr("decode(substring(raw, 1, k), 'UTF-8')")))
    return rows.select(*[F.col(f"ask.{c}").alias(c) for c in keep], "line", col.alias("col"))


def _frames(traces: DataFrame) -> DataFrame:
    rows = traces.select("trace_id", F.split("stack", "\r?\n").alias("lines"))
    head = F.trim(F.get("lines", F.lit(0)))
    at_sign = head.contains("@") & ~head.contains("    at ")
    rows = rows.select("trace_id", at_sign.alias("at_sign"), F.posexplode("lines").alias("frame_no", "whole")).withColumn("text", F.trim("whole"))
    rest = F.expr("substring(text, 4)")
    tail = F.substring_index(rest, "(", -1)
    call = rest.contains("(")
    v8 = ~F.col("at_sign") & F.col("text").startswith("at ")
    at = F.col("at_sign") & F.col("text").contains("@")
    place = F.when(v8 & call, F.trim(F.regexp_replace(tail, "\\)+$", ""))).when(v8, rest).when(at, F.expr("substring(text, instr(text, '@') + 1)"))
    name = F.when(v8 & call, F.trim(F.left(rest, F.length(rest) - F.length(tail) - 1))).when(at, F.expr("substring(text, 1, instr(text, '@') - 1)"))
    part = lambda k: F.regexp_extract("place", "(?s)^(.+):([0-9]+):([0-9]+)$", k)
    number = lambda k: F.nullif(part(k), F.lit("")).try_cast("int")
    rows = rows.select("trace_id", "frame_no", "whole", (v8 | at).alias("framed"), F.nullif(name, F.lit("")).alias("function_name"), place.alias("place"))
    return rows.select("trace_id", "frame_no", "whole", "framed", "function_name", F.nullif(part(1), F.lit("")).alias("file"), number(2).alias("line"), number(3).alias("col"))


def stack_frames(traces: DataFrame) -> DataFrame:
    """(trace_id, frame_no, function_name, file, line, col) of (trace_id, stack).

    The first line tells the engine: with an `@` it is name@place, otherwise `at name (place)` or `at place`. A place is
    file:line:col, split from the right; lines without one are no frames.
    """
    return _frames(traces).where("file is not null and line is not null and col is not null").select("trace_id", "frame_no", "function_name", "file", "line", "col")


def stack_messages(traces: DataFrame) -> DataFrame:
    """(trace_id, message): a stack's first line, unless that is a frame."""
    head = _frames(traces).where("frame_no = 0")
    return head.select("trace_id", F.when(~F.col("framed") & F.col("whole").isNotNull(), F.col("whole")).alias("message"))


def resolve_source(root: Column, source: Column) -> Column:
    """The root is put before the source as it is, without a slash; a null source is empty."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.coalesce(root, F.lit("")), source))


def percent_decoded(text: Column) -> Column:
    """Percent signs without two hexadecimal digits and plus signs stay; bytes that aren't UTF-8 leave the text as it is."""
    safe = F.replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    out = F.try_url_decode(safe)
    return F.when(out.contains("�") & ~text.contains("�") & ~text.contains("%EF%BF%BD"), text).otherwise(F.coalesce(out, text))


def base64_decoded(text: Column) -> Column:
    """The text that base 64 stands for; padding may lack; null if it isn't base 64 or not UTF-8."""
    bare = F.regexp_replace(F.regexp_replace(text, "[ \\t\\r\\n\\f]", ""), "=+$", "")
    whole = F.rpad(bare, (F.ceil(F.length(bare) / 4) * 4).cast("int"), F.lit("="))
    return F.when(bare.rlike("^[A-Za-z0-9+/]*$"), F.try_validate_utf8(F.try_to_binary(whole, F.lit("base64")).cast("string")))


def from_data_url(url: Column) -> Column:
    """The JSON within a data URL, in base 64 or percent-encoded; null for other URLs."""
    out = F.when(url.startswith(PLAIN_PREFIX), percent_decoded(F.substr(url, F.lit(len(PLAIN_PREFIX) + 1))))
    for p in BASE64_PREFIXES:
        out = out.when(url.startswith(p), base64_decoded(F.substr(url, F.lit(len(p) + 1))))
    return out


def sourcemap_url(text: Column) -> Column:
    """(kind, value) of the last comment that names a map: `inline` with the JSON, or `external` with the URL; null without one."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(" \t\r")))
    target = lambda x: F.trim(F.when(x.startswith("/*"), F.regexp_replace(F.substr(x, F.lit(len(URL_COMMENTS[0]) + 1)), "(\\*/)+$", "")).otherwise(F.substr(x, F.lit(len(URL_COMMENTS[0]) + 1))))
    any_of = lambda x: x.startswith(URL_COMMENTS[0]) | x.startswith(URL_COMMENTS[1]) | x.startswith(URL_COMMENTS[2]) | x.startswith(URL_COMMENTS[3])
    found = F.filter(F.transform(F.filter(lines, any_of), target), lambda x: x != "")
    last = F.get(found, F.size(found) - 1)
    json = F.when(~last.startswith(PLAIN_PREFIX), from_data_url(last))
    return F.when(F.size(found) > 0, F.struct(F.when(json.isNotNull(), "inline").otherwise("external").alias("kind"), F.coalesce(json, last).alias("value")))


def is_sourcemap(json: Column) -> Column:
    """Whether a text looks like a map: an object with sections, or with version, mappings and a field on sources."""
    keys = F.when(F.try_parse_json(json).isNotNull(), F.json_object_keys(json))
    has = lambda k: F.array_contains(keys, k)
    return F.coalesce(has("sections") | has("version") & has("mappings") & (has("sources") | has("names") | has("sourceRoot") | has("sourcesContent")), F.lit(False))


def shared_parts(a: Column, b: Column) -> Column:
    """How many leading elements two arrays share."""
    same = F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"].eqNullSafe(x["b"]))
    first = F.array_position(same, F.lit(False))
    return F.when(F.coalesce(first, F.lit(0)) > 0, first - 1).otherwise(F.least(F.size(a), F.size(b))).cast("int")


def relative_path(base: Column, target: Column) -> Column:
    """The way from base's directory to target; `.` from a path to itself."""
    a, b = F.split(base, "/"), F.split(target, "/")
    dirs = lambda x: F.slice(x, F.lit(1), F.size(x) - 1)
    n = shared_parts(dirs(a), dirs(b))
    out = F.concat(F.repeat(F.lit("../"), F.size(a) - 1 - n), F.array_join(F.slice(b, n + 1, F.size(b) - n), "/"))
    return F.when((base == target) | (out == ""), ".").otherwise(out)


def normalized_path(path: Column) -> Column:
    """A path without `.`, with each `..` taking the part before it, and single slashes."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    stack = F.aggregate(parts, F.array().cast("array<string>"), lambda t, p: F.when(p == "..", F.slice(t, F.lit(1), F.greatest(F.size(t) - 1, F.lit(0)))).otherwise(F.array_append(t, p)))
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(stack, "/"))


def resolved_map_path(script: Column, reference: Column) -> Column:
    """A map's path by the script's path and the reference in it."""
    parent = F.regexp_extract(script, "^(.*/)?[^/]*$", 1)
    return normalized_path(F.when(reference.startswith("/"), reference).otherwise(F.concat(parent, reference)))


def resolved_url(base: Column, reference: Column) -> Column:
    """A reference joined to an http(s) or file URL; null for data URLs and for bases that aren't absolute."""
    origin = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_replace(F.substr(base, F.length(origin) + 1), "[?#].*$", "")
    ref_path, ref_tail = F.regexp_extract(reference, "^([^?#]*)", 1), F.regexp_extract(reference, "([?#].*)$", 1)
    joined = F.when(ref_path.startswith("/"), ref_path).otherwise(F.concat(F.regexp_extract(path, "^(.*/)?[^/]*$", 1), ref_path))
    slash = F.when(joined.rlike("(/|/\\.|/\\.\\.)$"), "/").otherwise("")
    normal = F.concat(F.lit("/"), F.regexp_replace(normalized_path(joined), "^/", ""))
    normal = F.when(normal.endswith("/"), normal).otherwise(F.concat(normal, slash))
    out = F.when(reference.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), reference).when(reference.startswith("//"), F.concat(F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*:)", 1), reference)).otherwise(F.concat(origin, normal, ref_tail))
    return F.when((origin != "") & ~reference.startswith("data:"), out)


def same_origin(a: Column, b: Column) -> Column:
    """Equal scheme, host and port, default ports filled in."""

    def origin(u: Column) -> Column:
        scheme = F.lower(F.regexp_extract(u, "^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
        host = F.lower(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
        port = F.nullif(F.regexp_extract(u, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)", 1), F.lit(""))
        return F.struct(scheme, host, F.coalesce(port, F.when(scheme == "https", "443").when(scheme == "http", "80").otherwise("")))

    return origin(a) == origin(b)


def is_identifier(text: Column) -> Column:
    return text.rlike("^[\\p{IsAlphabetic}_$][\\p{IsAlphabetic}\\p{IsDigit}\\p{Mn}\\p{Mc}\\p{Pc}$‌‍]*$")


def leading_identifier(text: Column) -> Column:
    """The identifier that a text begins with, or null."""
    return F.nullif(F.regexp_extract(text, "^([\\p{IsAlphabetic}_$][\\p{IsAlphabetic}\\p{IsDigit}\\p{Mn}\\p{Mc}\\p{Pc}$‌‍]*)", 1), F.lit(""))


def safe_path(source: Column) -> Column:
    """A source's path for writing files: the scheme goes; null if it is absolute, leaves its folder or has odd characters."""
    bare = F.regexp_replace(source, "^(webpack:///|webpack://|file:///|file://)", "")
    bare = F.regexp_replace(bare, "^(\\./)+", "")
    bad = bare.rlike("[\\x00-\\x1F\\x7F?#%\\\\]") | bare.rlike("^([A-Za-z]:|/)") | bare.rlike("(^|/)\\.\\.(/|$)") | (bare == "")
    return F.when(~bad, bare)


def byte_size(n: Column) -> Column:
    """Bytes for people."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(F.format_string("%.1f", n / 1024.0), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", n / 1048576.0), F.lit(" MB")))
