"""Language ID by cross-parsing entropy.

A suffix automaton of labelled text per language gives the longest match at each place; a text is cut greedily into
such matches, characters that the language's text lacks being phrases of their own. A phrase costs what it takes to
point into the language's text, so its count is weighted by the logarithm of that text's length, and languages with
little text compare with others. The cheapest language wins; equal ones go to the one that sorts first.

Automata are double arrays (an entry per transition, however large the alphabet). Texts are parsed side by side in lock
step, long ones in blocks whose phrases are then corrected until they equal the parse from the start on.
Null text or text without a letter (Unicode category L) gives `und` and score 0; with nothing learned, everything is
`und`. Rows of one doc_id are rows of their own; repeated rows each give a row.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import SLICE_CHARS, by_slices, pick

BLOCK = 512
#: Blocks are corrected side by side in so many rounds, and one by one what is left, or where they are few.
ROUNDS, FEW = 4, 48
#: Bounds of the labelled sample, per language: rows at most, and characters after which no further row is taken. Rows
#: are learned from as a whole; those of over ROW_CHARS come last.
SAMPLE_DOCS, SAMPLE_CHARS, ROW_CHARS = 60, 30_000, 5_000
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4 == 2


def fold(text: str) -> str:
    """Lower case, with one space for whatever stands around the letters."""
    words = WORD.findall(text.lower())
    # Numbers that aren't digits are words for the expression, not letters.
    if not all(map(str.isalpha, words)):
        words = "".join(c if c.isalpha() else " " for c in " ".join(words)).split()
    return f" {' '.join(words)} "


def learn(df: DataFrame) -> dict[str, str]:
    """Folded sample text per language of the rows that aren't held out, the same for the same rows; see the bounds above."""
    rows = pick(df, "doc_id", "text", "lang").where("lang is not null and text is not null").where(~F.coalesce(held_out(), F.lit(False)))
    # First the rows are chosen without their texts: at most SAMPLE_DOCS of a language leave each task.
    size = F.length("text")
    keys = rows.select("lang", "doc_id", size.alias("size"), F.xxhash64("doc_id", "text").alias("h")).where("size > 0")
    order = Window.partitionBy("lang").orderBy((F.col("size") > ROW_CHARS).cast("int"), "h", "doc_id")
    first = keys.withColumn("at", F.row_number().over(order)).where(F.col("at") <= SAMPLE_DOCS)
    before = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = [(r.lang, r.h) for r in first.withColumn("before", before).where(F.col("before") < SAMPLE_CHARS).select("lang", "h").distinct().collect()]
    if not chosen:
        return {}
    h = F.xxhash64("doc_id", "text")
    got = rows.where(h.isin(sorted({h for _, h in chosen}))).select("lang", "text", h.alias("h")).distinct().collect()
    out: dict[str, str] = {}
    for r in sorted(got, key=lambda r: (r.lang, r.h, r.text)):
        out[r.lang] = out.get(r.lang, "") + fold(r.text)
    return {x: t for x, t in out.items() if t.strip()}


class Automaton:
    """The suffix automaton of a text as a double array.

    The transition of state s by symbol c is entry base[s] + c, if owner says that it belongs to s. State 0 has none: a
    phrase begins there. Symbol 0 stands for all that the text lacks.
    """

    def __init__(self, text: str) -> None:
        nxt, link, length, last = [{}], [-1], [0], 0
        for c in text:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in nxt[p]:
                nxt[p][c] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][c]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(c) == q:
                        nxt[p][c] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur
        letters = sorted(nxt[0])
        symbol = {c: i + 1 for i, c in enumerate(letters)}
        n = len(letters) + 1
        self.symbols = np.array([ord(c) for c in letters], np.uint32)
        # States of many transitions are placed first, those of one fill the gaps.
        base, room = np.zeros(len(nxt) + 1, np.int32), bytearray(4 * len(nxt) + 4 * n)
        hint = gap = 1
        for s in sorted(range(len(nxt)), key=lambda s: -len(nxt[s])):
            at = [symbol[c] for c in nxt[s]]
            if len(at) == 1:
                gap = room.index(0, gap)
                room[gap] = 1
                base[s + 1] = gap - at[0]
            elif at:
                low, tried = min(at), 0
                b = room.index(0, hint) - low
                while any(room[b + k] for k in at):
                    b, tried = room.index(0, b + low + 1) - low, tried + 1
                    if b + n >= len(room):
                        room.extend(bytes(len(room)))
                # Where places are found late only, the next search begins there.
                hint = b + low if tried > 20 else hint
                for k in at:
                    room[b + k] = 1
                base[s + 1] = b
                if b + 2 * n >= len(room):
                    room.extend(bytes(len(room)))
        low, high = int(base.min()), int(base.max())
        base -= min(low, 0)
        # An entry's two halves: where the transition leads and whose it is.
        self.entry = np.zeros((high - min(low, 0) + n + 1, 2), np.int32)
        self.entry[:, 1] = -1
        self.start = np.zeros(n, np.int32)
        for s, moves in enumerate(nxt):
            for c, q in moves.items():
                self.entry[base[s + 1] + symbol[c]] = q + 1, s + 1
        for c, q in nxt[0].items():
            self.start[symbol[c]] = q + 1
        self.base = base
        self.packed = self.entry.view(np.int64).ravel()
        self.price = float(np.log2(len(text) + 1))

    @functools.cached_property
    def lists(self) -> tuple[list[int], ...]:
        return self.base.tolist(), self.entry[:, 1].tolist(), self.entry[:, 0].tolist(), self.start.tolist()

    def step(self, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and where a phrase begins; after a character that the text lacks the state is 0."""
        at = self.base.take(state, mode="clip")
        at += symbol
        entry = self.packed.take(at, mode="clip").view(np.int32).reshape(-1, 2)
        new = entry[:, 1] != state
        return np.where(new, self.start.take(symbol, mode="clip"), entry[:, 0]), new

    def code(self, points: np.ndarray) -> np.ndarray:
        table = np.zeros(0x110000, np.int32)
        table[self.symbols] = np.arange(1, len(self.symbols) + 1)
        return table[points]


def walk(a: Automaton, codes: np.ndarray, begin: np.ndarray, length: np.ndarray, follows: np.ndarray, starts: np.ndarray, state: np.ndarray, lane: int, now: int, done: set[int]) -> None:
    """Parses on from a block's begin in state now, through the blocks that follow (noted in done), until a phrase begins where one did."""
    base, owner, to, start = a.lists
    while lane >= 0:
        done.add(lane)
        n = int(length[lane])
        new = starts[:n, lane].tolist()
        for i, c in enumerate(codes[begin[lane] : begin[lane] + n].tolist()):
            at = base[now] + c
            if owner[at] == now:
                now, new[i] = to[at], False
            else:
                now = start[c]
                if new[i]:
                    starts[:n, lane] = new
                    return
                new[i] = True
        starts[:n, lane] = new
        if state[lane] == now:
            return
        state[lane] = now
        lane = int(follows[lane])


def parse(a: Automaton, codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The number of greedy phrases of each text; codes holds the texts one after the other."""
    blocks = -(-sizes // BLOCK)
    total = int(blocks.sum())
    text = np.repeat(np.arange(len(sizes)), blocks)
    nth = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    begin = (np.cumsum(sizes) - sizes)[text] + nth * BLOCK
    length = np.minimum(BLOCK, sizes[text] - nth * BLOCK)
    # Full blocks first, so the lanes of a step are the first ones.
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    active = np.searchsorted(-length, -np.arange(1, BLOCK + 1), side="right")
    starts = np.zeros((BLOCK, total), bool)
    state = np.zeros(total, np.int32)
    # A step's symbols side by side; places beyond a block's end are never read.
    rows = np.ascontiguousarray(codes.take(begin[:, None] + np.arange(BLOCK), mode="clip").T)
    for i in range(BLOCK):
        n = active[i]
        if not n:
            break
        state[:n], starts[i, :n] = a.step(state[:n], rows[i, :n])
    # Blocks were parsed as if a phrase began with them. From the first on, each is parsed again with the state that the
    # block before ends in, until a phrase begins where one did; a block that changes to its end changes the next.
    where = np.empty(total, np.int64)
    where[order] = np.arange(total)
    lane = where[np.flatnonzero(nth > 0)]
    before = where[np.flatnonzero(nth > 0) - 1]
    follows = np.full(total, -1)
    follows[before] = lane
    entered = state[before]
    for _ in range(ROUNDS):
        if len(lane) <= FEW:
            break
        now, live, ends = entered.copy(), np.arange(len(lane)), np.zeros(len(lane), bool)
        for i in range(BLOCK):
            live = live[length[lane[live]] > i]
            if not len(live):
                break
            at = lane[live]
            now[live], new = a.step(now[live], rows[i, at])
            old = starts[i, at]
            starts[i, at] = new
            live = live[~(new & old)]
        # Blocks still parsed anew at their end may end in another state.
        ends[live] = True
        changed = lane[ends]
        moved = state[changed] != now[ends]
        state[changed] = now[ends]
        changed = changed[moved]
        nextlane = follows[changed]
        entered, lane = state[changed][nextlane >= 0], nextlane[nextlane >= 0]
    # The rest is walked one by one from the first on; a walk that reaches another one's block has done that too.
    done: set[int] = set()
    for i in np.argsort(begin[lane]).tolist():
        if int(lane[i]) not in done:
            walk(a, codes, begin, length, follows, starts, state, int(lane[i]), int(entered[i]), done)
    out = np.zeros(len(sizes), np.int64)
    np.add.at(out, text[order], starts.sum(0))
    return out


class Parser:
    def __init__(self, samples: dict[str, str]) -> None:
        self.langs = sorted(samples)
        self.automata = [Automaton(samples[x]) for x in self.langs]

    def costs(self, texts: list[str]) -> np.ndarray:
        """Bits per text and language."""
        sizes = np.array([len(t) for t in texts])
        points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4")
        return np.stack([parse(a, a.code(points), sizes) * a.price for a in self.automata], 1)


_parsers: dict[int, Parser] = {}


def predict(df: DataFrame, samples: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred and score; the score is the lead of the winner over the next language, as a share of the latter's bits."""
    if not samples:
        return pick(df, "doc_id").select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    key = hash(tuple(sorted(samples.items())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _parsers:
            _parsers.clear()
            _parsers[key] = Parser(samples)
        p = _parsers[key]
        for b in by_slices(batches, 2 * SLICE_CHARS):
            texts = [fold(t or "") for t in b.column(1).to_pylist()]
            has = [bool(t.strip()) for t in texts]
            n = p.costs(texts)
            best = n.argmin(axis=1)
            least = n.min(axis=1)
            rest = np.sort(n, axis=1)[:, 1] if n.shape[1] > 1 else 2 * least
            score = np.where(rest > 0, (rest - least) / np.maximum(rest, 1), 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.langs[i] if ok else "und" for i, ok in zip(best, has, strict=True)]), pa.array(np.where(has, score, 0.0))], ["doc_id", "lang_pred", "score"])

    return pick(df, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(df: DataFrame) -> DataFrame:
    """Learns from the rows that aren't held out and predicts every row."""
    return predict(df, learn(df)).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
