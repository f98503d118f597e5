"""Mappings text to rows and back.

A map's text is one value, so decoding needs no exchange at all: each text is cut into values and summed up in arrays,
a batch of maps at a time, and rows leave in batches of bounded size. Encoding sorts the rows of each map once and
streams through them; deltas and digits are made in arrays, and only the text under way is held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from meridian.functions.vlq import ALPHABET

FIELDS = ("gen_col", "source_idx", "orig_line", "orig_col", "name_idx")
ROWS = 1 << 16
COMMA, SEMICOLON, BAD = 64, 65, 255
MOST_DIGITS = 13
_CLASS = np.full(256, BAD, np.uint8)
_CLASS[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(64)
_CLASS[ord(",")], _CLASS[ord(";")] = COMMA, SEMICOLON
_LETTER = np.frombuffer(ALPHABET.encode(), np.uint8)


class Values:
    """The values of a text up to its first error: raw (unsigned), where each begins and ends, and the error met.

    error is (position of detection, kind, reported offset), or None.
    """

    def __init__(self, text: str) -> None:
        data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        c = _CLASS[data]
        more = (c < 64) & (c >= 32)
        after = np.zeros(len(c), bool)
        after[1:] = more[:-1]
        bad = np.flatnonzero((c == BAD) | (after & (c >= 64)))
        self.error = None
        if len(bad):
            self.error = (int(bad[0]), "InvalidBase64", int(bad[0]))
            c, after, more = c[: bad[0]], after[: bad[0]], more[: bad[0]]
        elif len(c) and more[-1]:
            self.error = (len(c), "UnexpectedEof", len(c))
        self.kind = c
        self.start = np.flatnonzero((c < 64) & ~after)
        self.end = np.flatnonzero(c < 32)
        # A value cut by the error has no end.
        long = np.flatnonzero(np.append(self.end, [len(c)] * (len(self.start) - len(self.end))) - self.start >= MOST_DIGITS)
        self.start = self.start[: len(self.end)] if not len(long) else self.start
        if len(long):
            at = int(self.start[long[0]])
            self.error = (at + MOST_DIGITS, "VlqOverflow", at)
            self.start, self.end = self.start[: long[0]], self.end[: long[0]]
        self.raw = np.zeros(0, np.uint64)
        if len(self.start):
            place = np.arange(len(c))
            digits = np.flatnonzero(c[: self.end[-1] + 1] < 64)
            token = np.repeat(np.arange(len(self.start)), self.end - self.start + 1)
            shift = (place[digits] - self.start[token]) * 5
            five = c[digits].astype(np.uint64) & np.uint64(31)
            first = np.searchsorted(token, np.arange(len(self.start)))
            self.raw = np.add.reduceat(five << shift.astype(np.uint64), first)
            # The 13th digit has room for four bits only, but for the smallest number of all.
            high = np.flatnonzero((shift == 60) & (five > 15))
            wide = [t for t, d in zip(token[high].tolist(), five[high].tolist(), strict=True) if not (d == 16 and int(self.raw[t]) == 1)]
            self.least = {int(t) for t in token[high]} - set(wide)
            if wide:
                self.cut(wide[0], (int(self.end[wide[0]]), "VlqOverflow", int(self.start[wide[0]])))
        else:
            self.least = set()

    def cut(self, n: int, error: tuple[int, str, int]) -> None:
        self.start, self.end, self.raw, self.error = self.start[:n], self.end[:n], self.raw[:n], error

    def signed(self) -> np.ndarray:
        half = (self.raw >> np.uint64(1)).astype(np.int64)
        out = np.where(self.raw & np.uint64(1), -half, half)
        for t in self.least:
            out[t] = np.iinfo(np.int64).min
        return out


def read(text: str) -> tuple[dict[str, np.ndarray], tuple[int, str, int, int] | None]:
    """Segments as arrays (line, n fields, the five running fields) and the first error (position, kind, offset, fields).

    What stands before the error is read. Five values are a segment; what follows without a comma is another.
    """
    v = Values(text)
    gap = np.cumsum(v.kind >= 64)
    run = gap[v.start] if len(v.start) else np.zeros(0, np.int64)
    line = np.cumsum(v.kind == SEMICOLON)[v.start] if len(v.start) else run
    first = np.flatnonzero(np.append(True, run[1:] != run[:-1])) if len(run) else run
    sizes = np.diff(np.append(first, len(run)))
    field = (np.arange(len(run)) - np.repeat(first, sizes)) % 5
    # Runs that end with two or three values are errors, found where the run ends; an open last run may be one too.
    error = None if v.error is None else (*v.error, 0)
    wrong = np.flatnonzero(np.isin(sizes % 5, (2, 3)))
    if len(wrong):
        at = int(v.end[first[wrong[0]] + sizes[wrong[0]] - 1]) + 1
        # A run that another error cuts isn't over.
        if v.kind[at] >= 64 if at < len(v.kind) else error is None:
            error = (at, "InvalidSegmentLength", at, int(sizes[wrong[0]] % 5))
    value = v.signed()
    begin = np.flatnonzero(field == 0)
    n = np.diff(np.append(begin, len(run)))
    if error is not None:
        # A segment is over with its fifth value, or where a separator follows one of a right length.
        last = v.end[begin + n - 1] + 1 if len(begin) else begin
        whole = (last <= error[0]) & ((n == 5) | np.isin(n, (1, 4)) & (np.append(v.kind, BAD)[last] >= 64) & (last < len(v.kind)))
        keep = int(np.argmin(whole)) if not whole.all() else len(whole)
        begin, n = begin[:keep], n[:keep]
    out = {"line": line[begin] if len(begin) else begin, "n": n}
    for k in range(5):
        has = n > (0 if k == 0 else 3 if k < 4 else 4)
        d = np.zeros(len(begin), np.int64)
        d[has] = value[begin[has] + k]
        out[FIELDS[k]] = np.cumsum(d)
    if len(begin):
        at = np.flatnonzero(np.append(True, out["line"][1:] != out["line"][:-1]))
        before = np.append(0, out["gen_col"])[at]
        out["gen_col"] = out["gen_col"] - np.repeat(before, np.diff(np.append(at, len(begin))))
    return out, error


def flags(text: str | None, line: np.ndarray, seg: np.ndarray) -> np.ndarray:
    """Which segments a range text marks: per line, running sums of indexes; those outside a line mark nothing."""
    out = np.zeros(len(line), bool)
    if text:
        v = Values(text)
        at = np.cumsum(v.kind == SEMICOLON)[v.start] if len(v.start) else v.start
        total = np.cumsum(v.raw.astype(np.int64))
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else at
        total = total - np.repeat(np.append(0, total)[first], np.diff(np.append(first, len(at))))
        # Lines and places within them are ascending, so one search finds a segment.
        wide = int(max(seg.max(initial=0), total.max(initial=0))) + 1
        key, want = line * wide + seg, at * wide + total
        place = np.searchsorted(key, want)
        place = place[(place < len(key))]
        hit = np.isin(key, want)
        out[hit] = True
    return out


def _schema(maps: DataFrame) -> StructType:
    ints = [StructField(c, IntegerType()) for c in ("gen_line", "seg_idx", *FIELDS)]
    return StructType([StructField("map_id", maps.schema["map_id"].dataType), *ints])


def _column(x: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    """32-bit integers; null where there is none, or where it isn't an index (below 0 or over 31 bits)."""
    ok = (x >= 0) & (x < 1 << 31)
    if there is not None:
        ok &= there
    return pa.array(np.where(ok, x, 0).astype(np.int32), mask=~ok)


def decode_mappings(maps: DataFrame, partial: bool = False, lines: tuple[int, int] | None = None) -> DataFrame:
    """(map_id, mappings[, range_mappings]) to one row per segment; is_range says what range_mappings marks.

    A map with a bad segment gives no rows (see mapping_errors); partial: those before its first error. lines: only
    generated lines from the first up to but not including the second.
    """
    ranged = "range_mappings" in maps.columns
    schema = StructType([*_schema(maps).fields, StructField("is_range", maps.sparkSession.range(1).selectExpr("true as x").schema[0].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held, n = [], 0
            texts = b.column(1).to_pylist()
            marks = b.column(2).to_pylist() if ranged else [None] * len(texts)
            for i, (text, mark) in enumerate(zip(texts, marks, strict=True)):
                got, error = read(text or "")
                if error is not None and not partial:
                    continue
                line = got["line"]
                at = np.flatnonzero(np.append(True, line[1:] != line[:-1])) if len(line) else line
                seg = np.arange(len(line)) - np.repeat(at, np.diff(np.append(at, len(line))))
                got["seg"], got["range"], got["map"] = seg, flags(mark, line, seg), np.full(len(line), i)
                if lines:
                    cut = slice(*np.searchsorted(line, lines))
                    got = {k: x[cut] for k, x in got.items()}
                held.append(got)
                n += len(got["line"])
                if n >= ROWS:
                    yield from emit(b, held)
                    held, n = [], 0
            if n:
                yield from emit(b, held)

    def emit(b: pa.RecordBatch, held: list[dict[str, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        x = {k: np.concatenate([h[k] for h in held]) for k in held[0]}
        sourced, named = x["n"] >= 4, x["n"] >= 5
        there = {"name_idx": named, "gen_col": None}
        columns = [b.column(0).take(pa.array(x["map"])), _column(x["line"]), _column(x["seg"]), *[_column(x[f], there.get(f, sourced)) for f in FIELDS], pa.array(x["range"])]
        out = pa.RecordBatch.from_arrays(columns, schema.names)
        yield from (out.slice(i, ROWS) for i in range(0, out.num_rows, ROWS))

    return maps.select("map_id", "mappings", *["range_mappings"] * ranged).mapInArrow(run, schema)


def mapping_errors(maps: DataFrame) -> DataFrame:
    """(map_id, kind, at, fields) of maps that don't decode: the first error, the byte offset it names, and the number of
    fields of a segment of a wrong length."""
    schema = StructType([StructField("map_id", maps.schema["map_id"].dataType), StructField("kind", StringType()), StructField("at", LongType()), StructField("fields", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, e) for i, t in enumerate(b.column(1).to_pylist()) if (e := read(t or "")[1]) is not None]
            if found:
                ids, errors = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(ids)), pa.array([e[1] for e in errors]), pa.array([e[2] for e in errors], pa.int64()), pa.array([e[3] or None for e in errors], pa.int32())], schema.names)

    return maps.select("map_id", "mappings").mapInArrow(run, schema)


def digits(value: np.ndarray, there: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The letters of each unsigned value, a row each, and which of them are used."""
    n = np.ones(len(value), np.int64)
    rest = value >> np.uint64(5)
    while rest.any():
        n += rest > 0
        rest >>= np.uint64(5)
    width = int(n.max(initial=1))
    k = np.arange(width)
    five = (value[:, None] >> (5 * k).astype(np.uint64)) & np.uint64(31)
    return _LETTER[(five | np.where(k < n[:, None] - 1, 32, 0).astype(np.uint64)).astype(np.int64)], (k < n[:, None]) & there[:, None]


class Writer:
    """Texts of maps whose rows come in order, a batch at a time."""

    def __init__(self) -> None:
        self.open, self.id = False, None

    def begin(self, id_: object) -> None:
        self.open, self.id, self.line, self.out, self.marks, self.mark_line = True, id_, 0, bytearray(), bytearray(), 0
        self.last = np.zeros(5, np.int64)
        self.seg = -1

    def close(self) -> tuple:
        self.open = False
        return self.id, self.out.decode(), self.marks.decode() or None

    def add(self, line: np.ndarray, seg: np.ndarray, fields: list[np.ndarray], there: list[np.ndarray], ranged: np.ndarray) -> None:
        """Rows of the open map."""
        n, fresh = len(line), not self.out
        new = np.empty(n, bool)
        new[0] = fresh or line[0] != self.line
        new[1:] = line[1:] != line[:-1]
        delta = []
        for k, (x, ok) in enumerate(zip(fields, there, strict=True)):
            at = np.maximum.accumulate(np.where(ok, np.arange(n), -1))
            prior = np.append(-1, at[:-1])
            before = np.where(prior >= 0, x[prior], self.last[k])
            delta.append(x - (np.where(new, 0, before) if k == 0 else before))
            if at[-1] >= 0:
                self.last[k] = x[at[-1]]
        parts = [digits(np.where(d < 0, (-d).astype(np.uint64) * np.uint64(2) + np.uint64(1), d.astype(np.uint64) * np.uint64(2)), ok) for d, ok in zip(delta, there, strict=True)]
        comma = (np.full((n, 1), ord(","), np.uint8), ~new[:, None])
        letters = np.hstack([comma[0], *[p[0] for p in parts]])
        used = np.hstack([comma[1], *[p[1] for p in parts]])
        text, ends = letters[used].tobytes(), np.append(0, np.cumsum(used.sum(1)))
        at = np.flatnonzero(new)
        if not len(at) or at[0]:
            self.out += text[: ends[at[0] if len(at) else n]]
        # All rows may go on with the line under way.
        for i, j in zip(at.tolist(), np.append(at, n)[1:].tolist(), strict=True):
            self.out += b";" * int(line[i] - self.line) + text[ends[i] : ends[j]]
            self.line = int(line[i])
        for i in np.flatnonzero(ranged).tolist():
            if line[i] != self.mark_line:
                self.marks += b";" * int(line[i] - self.mark_line)
                self.mark_line, self.seg = int(line[i]), -1
            elif self.seg >= 0:
                self.marks += b","
            step = np.array([seg[i] - max(self.seg, 0)], np.uint64)
            self.marks += digits(step, np.ones(1, bool))[0].tobytes()
            self.seg = int(seg[i])


def encode_maps(rows: DataFrame) -> DataFrame:
    """Segments to (map_id, mappings, range_mappings): the latter null where no row's is_range is true."""
    has = "is_range" in rows.columns
    schema = StructType([StructField("map_id", rows.schema["map_id"].dataType), StructField("mappings", StringType()), StructField("range_mappings", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, done = Writer(), []
        kind = None

        def flush() -> pa.RecordBatch:
            ids, texts, marks = zip(*done, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(texts, pa.string()), pa.array(marks, pa.string())], schema.names)

        for b in batches:
            if not b.num_rows:
                continue
            kind = b.schema.field(0).type
            code = b.column(0).dictionary_encode()
            names, code = code.dictionary.to_pylist(), code.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            there = [np.asarray(b.column(3 + k).is_valid()) for k in range(5)]
            line, seg, *fields = (b.column(k).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(1, 8))
            # A segment without a source has no other field; a name needs the other four.
            there = [np.ones(len(line), bool), *[there[1]] * 3, there[1] & there[4]]
            ranged = b.column(8).fill_null(False).to_numpy(zero_copy_only=False) if has else np.zeros(len(line), bool)
            cuts = np.flatnonzero(np.append(True, code[1:] != code[:-1])).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(line)], strict=True):
                id_ = names[code[i]] if code[i] >= 0 else None
                if w.open and w.id != id_:
                    done.append(w.close())
                if not w.open:
                    w.begin(id_)
                w.add(line[i:j], seg[i:j], [f[i:j] for f in fields], [t[i:j] for t in there], ranged[i:j])
            if sum(len(t[1]) for t in done) > 1 << 20:
                yield flush()
                done.clear()
        if w.open:
            done.append(w.close())
        if done:
            yield flush()

    order = ["map_id", "gen_line", "seg_idx"]
    held = rows.select(*order, *FIELDS, *["is_range"] * has).repartition("map_id").sortWithinPartitions(*order)
    return held.mapInArrow(run, schema)


def encode_mappings(rows: DataFrame) -> DataFrame:
    """Segments to (map_id, mappings)."""
    return encode_maps(rows.select("map_id", "gen_line", "seg_idx", *FIELDS)).select("map_id", "mappings")


def encode_ranges(rows: DataFrame) -> DataFrame:
    """Flagged segments to (map_id, range_mappings); maps without any give no row."""
    return encode_maps(rows.where("is_range")).select("map_id", "range_mappings")


def line_offsets(rows: DataFrame) -> DataFrame:
    """(map_id, gen_line, n): how many segments each line that has any holds."""
    return rows.groupBy("map_id", "gen_line").count().withColumnRenamed("count", "n")


def decode_ranges(maps: DataFrame) -> DataFrame:
    """(map_id, gen_line, seg_idx) that range_mappings marks among the segments of mappings."""
    return decode_mappings(maps).where("is_range").select("map_id", "gen_line", "seg_idx")
