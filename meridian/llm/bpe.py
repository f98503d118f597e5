"""BPE encoding and decoding by a prefix-sharing trie traversal.

The distinct words of a slice are walked in sorted order, which is a depth-first walk of their trie: the
last-token state of each shared prefix is computed once. The last token of a prefix is the longest
vocabulary suffix that BPE would keep beside the last token of what stands before it.
Null text counts as empty (no tokens). Special tokens' strings become their ids, as the library does.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meridian.llm.common import SLICE_CHARS, by_slices, pick

#: Bounds of what a worker keeps: pairs of tokens looked at, and bytes of words with their ids (twice: lately and before).
PAIRS_KEPT, KEPT_BYTES, ENTRY_BYTES = 400_000, 24_000_000, 200


def _ranges(kind: str) -> str:
    """The code points of a general category's first letter, as ranges of a character class."""
    out, start = [], None
    for c in range(0x110001):
        inside = c < 0x110000 and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@functools.cache
def splitter() -> re.Pattern:
    """The byte-level pre-tokenizer's split, with Unicode classes written out. Words come first: the order of the
    alternatives is free as they begin with different characters."""
    letters, numbers, space = _ranges("L"), _ranges("N"), "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
    return re.compile(f" ?[{letters}]+|'(?:[sdmt]|ll|ve|re)| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+|[{space}]+(?![^{space}])|[{space}]+")


#: The same split for texts of Latin-1 characters only, whose classes are short and so much faster.
LATIN = re.compile(" ?[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff]+|'(?:[sdmt]|ll|ve|re)| ?[0-9\xb2\xb3\xb9\xbc-\xbe]+| ?[^\t-\r \x85\xa0A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+|[\t-\r \x85\xa0]+(?![^\t-\r \x85\xa0])|[\t-\r \x85\xa0]+")


def split(text: str) -> list[str]:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return splitter().findall(text)
    return LATIN.findall(text)


class Vocabulary:
    """Tokens as bytes, and the pair of tokens that merge to each."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        raw = lambda s: bytes(byte_of[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.id = {raw(s): i for s, i in vocab.items()}
        self.bytes = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for b, i in self.id.items():
            self.bytes[i] = b
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.merge, self.parts, self.rank = {}, {}, {}
        for r, m in enumerate(spec["model"]["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            pair = (vocab[left], vocab[right])
            whole = vocab[left + right]
            self.merge[pair] = r
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = pair, r
        self.reach: dict[bytes, int] = {}  # the longest token that ends with up to three given bytes
        for b in self.id:
            for n in (1, 2, 3):
                if n <= len(b):
                    self.reach[b[-n:]] = max(self.reach.get(b[-n:], 0), len(b))
        self.kept: dict[int, bool] = {}
        self.special_re = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def stays(self, left: int, right: int) -> bool:
        """Whether BPE, given the two tokens' bytes together, ends with these two tokens.

        Takes the tokens' merges back, the latest first; at each point, a merge across the border that is
        due before the merges taken back would have come first.
        """
        a, b, due, ok = left, right, 1 << 60, True
        while True:
            r = self.merge.get((a, b))
            if r is not None and r < due:
                ok = False
                break
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                break
            # Of equal merges the left one is made first, so the right one is taken back first, and a merge
            # across the border of the same rank as one to its right comes before it.
            if ra > rb:
                a, due = self.parts[a][1], ra
            else:
                b, due = self.parts[b][0], rb + 1
        if len(self.kept) > PAIRS_KEPT:
            self.kept.clear()
        self.kept[left << 32 | right] = ok
        return ok


@functools.cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode_words(words: list[str], v: Vocabulary) -> dict[str, bytes]:
    """Each distinct word's ids as little-endian 32-bit integers."""
    out: dict[str, bytes] = {}
    token_of, stays, kept, reach = v.id.get, v.stays, v.kept.get, v.reach.get
    path, last, size = b"", [], []  # the walk's path; the last token of each prefix and its length
    for raw, word in sorted((w.encode("utf-8", "surrogatepass"), w) for w in words):
        shared, most = 0, min(len(raw), len(path))
        while shared < most and raw[shared] == path[shared]:
            shared += 1
        del last[shared:], size[shared:]
        for end in range(shared + 1, len(raw) + 1):
            for start in range(max(0, end - reach(raw[max(0, end - 3) : end], 2)), end):
                token = token_of(raw[start:end])
                if token is not None:
                    if not start:
                        break
                    before = last[start - 1]
                    ok = kept(before << 32 | token)
                    if ok or ok is None and stays(before, token):
                        break
            last.append(token)
            size.append(end - start)
        path, found, end = raw, [], len(raw)
        while end:
            found.append(last[end - 1])
            end -= size[end - 1]
        found.reverse()
        out[word] = struct.pack(f"<{len(found)}I", *found)
    return out


class Encoder:
    """Encodes texts, keeping the ids of words seen lately."""

    def __init__(self, path: str) -> None:
        self.v, self.known, self.older, self.size = vocabulary(path), {}, {}, 0

    def _pieces(self, text: str) -> list[tuple[bool, str]]:
        if not self.v.special_re:
            return [(False, text)]
        out, last = [], 0
        for m in self.v.special_re.finditer(text):
            out += [(False, text[last : m.start()]), (True, m[0])]
            last = m.end()
        return [*out, (False, text[last:])]

    def encode(self, texts: list[str], special: bool = True) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers. special: special tokens' strings become their ids."""
        known, out = self.known, []
        pieces = [[(s, p if s else split(p)) for s, p in (self._pieces(t) if special else [(False, t)])] for t in texts]
        if self.size > KEPT_BYTES:
            self.older, self.size = known, 0
            self.known = known = {}
        new = {w for t in pieces for s, p in t if not s for w in p if w not in known}
        if self.older:
            again = {w: x for w in new if (x := self.older.get(w)) is not None}
            known.update(again)
            self.size += sum(len(w) + len(x) + ENTRY_BYTES for w, x in again.items())
            new = {w for w in new if w not in known}
        made = encode_words(list(new), self.v)
        self.size += sum(len(w) + len(x) + ENTRY_BYTES for w, x in made.items())
        known.update(made)
        for t in pieces:
            out.append(b"".join([np.uint32(self.v.special[p]).tobytes() if s else b"".join([known[w] for w in p]) for s, p in t]))
        return out

    def decode(self, ids: bytes) -> str:
        token = self.v.bytes
        return b"".join([token[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and vocabulary."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def tokenize(df: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit integers) of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in by_slices(batches, SLICE_CHARS // 2):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(e.encode([t or "" for t in b.column(1).to_pylist()]), pa.binary())], ["doc_id", "ids"])
        # The worker goes on to other tasks: what was in use before the last rotation isn't kept for them.
        e.older = {}

    return pick(df, "doc_id", "text").mapInArrow(run, "doc_id long, ids binary")


def digests(df: DataFrame, path: str) -> DataFrame:
    """Per document: n_tokens, SHA-256 of the ids and of the text decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids = b.column(1).to_pylist()
            sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(e.decode(x).encode() for x in ids)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return tokenize(df, path).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
