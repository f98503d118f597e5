"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions near hits, embedded checksums.

Null text counts as empty and gives no spans. Repeated rows each give a row. Offsets are code points,
end exclusive. Kinds `github` and `npm` are added to the base kinds where the token's embedded
CRC-32 (six base-62 digits) is right.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from meridian.llm.common import by_slices, pick, plain

KINDS = ("assign", "access", "hex", "github", "npm")
#: Keywords of the assign expression, prefixes of tokens.
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_PREFIX = "akia"
CHECKED_PREFIXES = {"ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm"}
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CHECKED = re.compile(r"(?:gh[pousr]|npm)_[A-Za-z0-9]{36}(?![A-Za-z0-9])")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62(n: int) -> str:
    out = ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = DIGITS[r] + out
    return out


def checksum_ok(token: str) -> bool:
    body = token.partition("_")[2]
    return base62(zlib.crc32(body[:30].encode())) == body[30:]


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for w in (*ASSIGN_WORDS, ACCESS_PREFIX, *CHECKED_PREFIXES):
        a.add_word(w, w)
    a.make_automaton()
    return a


def find(text: str, a) -> list[tuple[int, str, int]]:
    """(start, kind, end) of all spans, by start and then kind as listed."""
    folded = text.lower() if text.isascii() else text.encode().lower().decode()  # A-Z only: offsets stay
    spans, ends = [], {"assign": 0, "access": 0}
    for start, word in sorted((last + 1 - len(w), w) for last, w in a.iter(folded)):
        if word == ACCESS_PREFIX:
            if start >= ends["access"] and (m := ACCESS.match(text, start)):
                ends["access"] = m.end()
                if m.end() - start >= 20:
                    spans.append((start, 1, m.end()))
        elif word in CHECKED_PREFIXES:
            if (m := CHECKED.match(text, start)) and checksum_ok(m[0]):
                spans.append((start, KINDS.index(CHECKED_PREFIXES[word]), m.end()))
        elif start >= ends["assign"] and (m := ASSIGN.match(text, start)):
            ends["assign"] = m.end()
            if len(m[2]) >= 6:
                spans.append((start, 0, m.end()))
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(s, KINDS[k], e) for s, k, e in sorted(spans)]


def scan(df: DataFrame) -> DataFrame:
    """doc_id and spans (array of start, kind, end) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())]))
        for b in by_slices(batches):
            found = [[{"start": s, "kind": k, "end": e} for s, k, e in find(t or "", a)] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], ["doc_id", "spans"])

    return pick(df, "doc_id", "text").mapInArrow(run, "doc_id long, spans array<struct<start:long,kind:string,end:long>>")


def report(df: DataFrame) -> DataFrame:
    """The digest columns of the secret scan, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans")}
            for spans in b.column(1).to_pylist():
                base = [x for x in spans if x["kind"] in KINDS[:3]]
                line = lambda xs: ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in xs)
                for k in KINDS[:3]:
                    out[f"n_{k}"].append(sum(x["kind"] == k for x in base))
                out["base_sha256"].append(hashlib.sha256(line(base).encode()).hexdigest())
                out["spans"].append(line(spans))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(v, pa.int64() if k[0] == "n" else pa.string()) for k, v in out.items()]], ["doc_id", *out])

    return scan(df).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(df: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns; spans in text are replaced by mark, n_chars (if there) counts the new text."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, at = automaton(), names.index("text")
        for b in by_slices(batches):
            texts = []
            for t in b.column(at).to_pylist():
                if t:
                    parts, last = [], 0
                    for s, _, e in find(t, a):
                        if e > last:
                            if s >= last:
                                parts += [t[last:s], mark]
                            last = e
                    t = "".join([*parts, t[last:]])
                texts.append(t)
            cols = list(b.columns)
            cols[at] = pa.array(texts, b.schema.field(at).type)
            if "n_chars" in names:
                n = names.index("n_chars")
                cols[n] = pa.array([None if t is None else len(t) for t in texts], b.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    flat = plain(df, "text")
    schema = flat.schema
    return flat.mapInArrow(run, schema).toDF(*names)
