"""Embedding near-dedup by spherical-cap filters.

Vectors are rotated and cut into PARTS pieces; a filter direction joins one random code vector of each piece's
code. There are about as many filters as vectors, so buckets don't grow with the table. Each vector is list-decoded to
all directions whose inner product with it is within MARGIN of its largest, without trying all: of each piece only codes
that can still reach that. Vectors of one label that share a filter are compared exactly, in double precision. Equal
vectors are compared once. A bucket is cut into blocks of BLOCK vectors; pairs of blocks are the tasks, links are counted
there, once per pair in its first shared filter. Single-precision vectors stay so until they are compared.
Null or zero vectors, null or non-finite components and null labels link with nothing. Vectors of unlike
length don't link. Rows with one vec_id are vectors of their own, each with the links and the component of its vector.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import components, pick, stored

COSINE = 0.98
PARTS, LEAST_CODES, MARGIN, BLOCK = 2, 64, 0.04, 2048
#: Scores that are held at once while decoding.
SCORES = 1 << 21


def n_codes(vectors: int) -> int:
    """Codes of each piece: a power of two, so that there are as many filters as vectors or up to four times as many."""
    return max(LEAST_CODES, 1 << max(0, math.ceil(math.log2(max(1, vectors)) / PARTS)))


@functools.lru_cache(4)
def codes(dim: int, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The rotation and the codes, the same everywhere."""
    rng = np.random.default_rng(20 + dim)
    turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    out = []
    for k in np.array_split(np.arange(dim), min(PARTS, dim)):
        c = rng.normal(size=(n, len(k)))
        out.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(min(PARTS, dim)))
    return turn, out


def decode(x: np.ndarray, n: int) -> list[np.ndarray]:
    """Per unit vector the ids of all filters within MARGIN of its best one, ascending."""
    step = max(1, SCORES // n)
    return [f for i in range(0, len(x), step) for f in _decode(x[i : i + step], n)]


def _decode(x: np.ndarray, n: int) -> list[np.ndarray]:
    turn, code = codes(x.shape[1], n)
    y = x @ turn
    cuts = np.cumsum([0, *[c.shape[1] for c in code]])
    scores = [y[:, a:b] @ c.T for c, a, b in zip(code, cuts, cuts[1:], strict=False)]
    rest = np.cumsum([s.max(1) for s in scores][::-1], axis=0)[::-1]
    row, ids, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    for k, s in enumerate(scores):
        after = rest[k + 1] if k + 1 < len(scores) else np.zeros(len(x))
        out = []
        for i in range(0, len(row), max(1, SCORES // n)):
            part = slice(i, i + max(1, SCORES // n))
            r = row[part]
            now = total[part][:, None] + s[r]
            at, c = np.nonzero(now + after[r][:, None] >= (rest[0] - MARGIN)[r][:, None])
            out.append((r[at], ids[part][at] * n + c, now[at, c]))
        row, ids, total = (np.concatenate(z) for z in zip(*out, strict=True))
    order = np.lexsort((ids, row))
    return np.split(ids[order], np.cumsum(np.bincount(row, minlength=len(x)))[:-1])


def usable(v: object, kind: str) -> bytes | None:
    if v is None or len(v) == 0 or any(c is None for c in v):
        return None
    a = np.array(v, kind)
    return (a + a.dtype.type(0)).tobytes() if np.isfinite(a).all() and a.any() else None


def unit(raw: list[bytes], kind: str) -> np.ndarray:
    a = np.stack([np.frombuffer(r, kind) for r in raw]).astype(np.float64)
    a = a / np.abs(a).max(1, keepdims=True)
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def kind_of(df: DataFrame) -> str:
    """How components are kept: in the precision they come in."""
    return "<f4" if df.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"


def packed(df: DataFrame) -> DataFrame:
    rows, kind = pick(df, "vec_id", "label", "embedding"), kind_of(pick(df, "embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = [usable(v, kind) if y is not None else None for v, y in zip(b.column(2).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], ["vec_id", "label", "vec"])

    return rows.select("vec_id", F.col("label").cast("string").alias("label"), "embedding").mapInArrow(run, "vec_id long, label string, vec binary")


def filtered(reps: DataFrame, n: int, kind: str) -> DataFrame:
    """A row per vector and filter, without the vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            raw = b.column(1).to_pylist()
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                lists = decode(unit([raw[i] for i in at], kind), n)
                rows = pa.array(np.repeat(at, [len(x) for x in lists]))
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(2).take(rows), pa.array(np.full(len(rows), size)), pa.array(np.concatenate(lists))], ["rep", "label", "bytes", "filter"])

    return reps.select("rep", "vec", "label").mapInArrow(run, "rep long, label string, bytes long, filter long")


def linked(reps: DataFrame, n: int, kind: str) -> DataFrame:
    """(a, b, n): a links with n vectors in one task, b is the smallest vector that its links reach there."""
    # Buckets are found by ids alone; only vectors that share one are shuffled, once for each bucket and block they meet.
    rows = stored(filtered(reps, n, kind))
    sizes = rows.groupBy("label", "filter", "bytes").count().where("count > 1").select("label", "filter", "bytes", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks"))
    shared = rows.join(sizes, ["label", "filter", "bytes"]).groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("filter", "blocks"))).alias("shared"))
    rows = reps.join(shared, "rep").withColumn("bytes", F.octet_length("vec")).withColumn("filters", F.col("shared.filter"))
    rows = rows.select("rep", "label", "copies", "bytes", "vec", "filters", F.inline("shared"))
    own = F.expr("cast(pmod(xxhash64(rep), blocks) as int)")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))

    keys = ["label", "filter", "bytes", "low", "high"]
    rows = rows.select(*keys, "own", "rep", "copies", "vec", "filters").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(lambda batches: _linked_in_groups(batches, kind), "a long, b long, n long")


def _linked_in_groups(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    """The links of each run of rows with equal keys; a run holds two blocks at most."""
    key, group = None, []
    for b in batches:
        out = []
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if row[:5] != key:
                out += _links(key, group, kind)
                key, group = row[:5], []
            group.append(row[5:])
        yield _rows(out)
    yield _rows(_links(key, group, kind))


def _rows(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    cols = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 3
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["a", "b", "n"])


def _links(key: tuple | None, group: list[tuple], kind: str) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(vectors, the smallest each reaches here, the number of links) of one pair of blocks; rows are (own, rep, copies, vec, filters)."""
    if key is None or len(group) < 2:
        return []
    _, f, _, low, high = key
    x, y = [r for r in group if r[0] == low], [r for r in group if r[0] == high]
    if not x or not y:
        return []
    hit = np.argwhere(unit([r[3] for r in x], kind) @ unit([r[3] for r in y], kind).T >= COSINE)
    xi, yi = np.array([r[1] for r in x]), np.array([r[1] for r in y])
    if low == high:
        hit = hit[xi[hit[:, 0]] < yi[hit[:, 1]]]
    if not len(hit):
        return []
    hit = hit[~_earlier(x, y, hit, f)]
    if not len(hit):
        return []
    xc, yc = np.array([r[2] for r in x]), np.array([r[2] for r in y])
    ends = np.concatenate([np.stack([xi[hit[:, 0]], yi[hit[:, 1]]], 1), np.stack([yi[hit[:, 1]], xi[hit[:, 0]]], 1)])
    ids, ends = np.unique(ends, return_inverse=True)
    ends = ends.reshape(-1, 2)
    root = np.arange(len(ids))
    while True:
        new = root.copy()
        np.minimum.at(new, ends[:, 0], root[ends[:, 1]])
        new = new[new]
        if (new == root).all():
            break
        root = new
    copies = np.concatenate([yc[hit[:, 1]], xc[hit[:, 0]]])
    return [(ids, ids[root], np.bincount(ends[:, 0], copies, len(ids)))]


def _earlier(x: list[tuple], y: list[tuple], hit: np.ndarray, f: int) -> np.ndarray:
    """Whether each pair (places in x and y) shares a filter before f: it is counted there."""
    sides = []
    for z, at in ((x, hit[:, 0]), (y, hit[:, 1])):
        rows, place = np.unique(at, return_inverse=True)
        lists = [np.array(z[i][4], np.int64) for i in rows]
        lists = [v[: np.searchsorted(v, f)] for v in lists]
        sides.append((place, np.repeat(np.arange(len(rows)), [len(v) for v in lists]), np.concatenate(lists), len(rows)))
    (px, rx, fx, nx), (py, ry, fy, ny) = sides
    found = np.zeros((nx, ny), bool)
    # A filter's own pairs at a time: as many as its members on both sides make.
    for g in np.intersect1d(fx, fy):
        found[np.ix_(rx[fx == g], ry[fy == g])] = True
    return found[px, py]


def classes(df: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    held, kind = stored(packed(df)), kind_of(pick(df, "embedding"))
    # The numbers of distinct vectors are fixed by being written.
    reps = stored(held.where("vec is not null").groupBy("label", "vec").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")).withColumn("rep", F.monotonically_increasing_id()))
    found = stored(linked(reps, n_codes(reps.count()), kind))
    root = components(found.select("a", "b"))
    counts = found.groupBy("a").agg(F.sum("n").alias("n"))
    of = reps.select("label", "vec", "rep", "id", "copies").join(root, F.col("rep") == root.node, "left").join(counts, F.col("rep") == counts.a, "left")
    of = stored(of.select("label", "vec", "id", F.coalesce("root", "rep").alias("root"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    least = of.groupBy("root").agg(F.min("id").alias("component_id"))
    named = of.join(least, "root").select(F.col("label").alias("l"), F.col("vec").alias("v"), "n_links", "component_id")
    out = held.join(named, (held.label == named.l) & (held.vec == named.v), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
