"""Chat formatting by token-level assembly.

Each turn is encoded by itself, control strings in its text escaped; reserved ids that no text encodes to mark
turns; the loss mask follows from prefix sums of the segments' lengths. Turns are put together in streams of sorted
rows, so a conversation of any length is never held as a whole. Turns are ordered by turn, null
first, then by role and text as strings of bytes; null text and role count as empty; rows without conv_id are one conversation. Repeated rows stay.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.bpe import encoder
from meridian.llm.common import by_slices, pick

#: The strings that steer a chat; in texts a backslash is put after their first character.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
CONTROL = re.compile("|".join(f"{re.escape(c[0])}\\\\*{re.escape(c[1:])}" for c in CONTROLS))
ESCAPED = re.compile("|".join(f"{re.escape(c[0])}\\\\+{re.escape(c[1:])}" for c in CONTROLS))
#: Reserved marks, numbered from the vocabulary's end on: start of a turn, end of its role, end of the turn.
MARKS = ("<|im_start|>", "\n", "<|im_end|>")


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[0][0] + m[0][2:], text)


def segments(turns: DataFrame, path: str) -> DataFrame:
    """Per turn its ids: mark, role, mark, text, mark; head and body are the lengths before and of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        first = len(e.v.bytes)
        mark = [np.uint32(first + i).tobytes() for i in range(3)]
        for b in by_slices(batches):
            role = e.encode([escape(r or "") for r in b.column(2).to_pylist()], special=False)
            text = e.encode([escape(t or "") for t in b.column(3).to_pylist()], special=False)
            ids = [mark[0] + r + mark[1] + t + mark[2] for r, t in zip(role, text, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(ids, pa.binary()), pa.array([2 + len(r) // 4 for r in role], pa.int64()), pa.array([len(t) // 4 for t in text], pa.int64())], ["conv_id", "turn", "role", "text", "ids", "head", "body"])

    return pick(turns, "conv_id", "turn", "role", "text").mapInArrow(run, "conv_id long, turn long, role string, text string, ids binary, head long, body long")


def assembled(turns: DataFrame, path: str) -> DataFrame:
    """Per turn, in order: its ids and from where to where in the conversation's tokens it stands; loss_start and
    loss_end bound its part of the loss mask (empty but for assistant turns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, at = None, 0
        started = False
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column(0).to_pylist()
            head, body = b.column(3).to_numpy(), b.column(4).to_numpy()
            size = head + body + 1
            sums = np.cumsum(size) - size
            base, start = np.empty(len(ids), np.int64), 0
            for i, c in enumerate(ids):
                if not started or c != conv:
                    at, start, conv, started = 0, int(sums[i]), c, True
                base[i] = at - start
            begin = sums + base
            at = int(begin[-1] + size[-1])
            loss = np.array([r == "assistant" for r in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(begin), pa.array(begin + size), pa.array(begin + head), pa.array(begin + head + np.where(loss, body, 0))], ["conv_id", "ids", "start", "end", "loss_start", "loss_end"])

    rows = segments(turns, path).withColumn("__role", F.coalesce("role", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
    order = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "__role", "text")
    return order.select("conv_id", "role", "ids", "head", "body").mapInArrow(run, "conv_id long, ids binary, start long, end long, loss_start long, loss_end long")


def digests(turns: DataFrame, path: str) -> DataFrame:
    """Per conversation the digests of what is read back from its tokens and mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        first, schema = len(e.v.bytes), pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        now, out = None, []
        for b in batches:
            for conv, ids, start, a, z in zip(*(b.column(i).to_pylist() for i in (0, 1, 2, 4, 5)), strict=True):
                if start == 0:
                    if now:
                        out.append(close(now))
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                x = np.frombuffer(ids, "<u4")
                cut = np.flatnonzero(x >= first)
                role, text = (e.decode(x[i + 1 : j].tobytes()) for i, j in zip(cut, cut[1:], strict=False))
                loss = unescape(e.decode(x[a - start : z - start].tobytes()))
                now[1] += 1
                now[2].update(f"{unescape(role)}\n{unescape(text)}\n".encode())
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += sum(map(len, MARKS)) + len(role) + len(text)
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if now:
            out.append(close(now))
        yield pa.RecordBatch.from_pylist(out, schema)

    def close(c: list) -> dict:
        return {"conv_id": c[0], "n_turns": c[1], "turns_sha256": c[2].hexdigest(), "loss_chars": c[3], "loss_sha256": c[4].hexdigest(), "formatted_chars": c[5]}

    return assembled(turns, path).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The digests in DuckDB SQL.
SQL = r"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e as (select *, regexp_replace(text, '([<\[])(\\*(?:s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>))', '\1\\\2', 'g') as escaped from t)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
 cast(sum(case when role = 'assistant' then length(text) else 0 end) as bigint) as loss_chars,
 sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
 cast(sum(23 + length(role) + length(escaped)) as bigint) as formatted_chars
from e group by conv_id
"""
