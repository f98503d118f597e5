"""SimHash near-duplicates by ball hashing that meets in the middle, and a stage that removes them.

`fingerprints` and `classes` link fingerprints at two or fewer differing bits: each distinct fingerprint
emits itself and its 64 one-bit neighbours, and two fingerprints within two bits share one of them. All
members of a bucket are within two bits of each other, so the pairs (smallest member, other member)
connect the same rows as all pairs would. Null or empty texts get fingerprint zero and link like others.
Repeated rows each give a row; a null doc_id never becomes a component id.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import by_slices, components, forget, pick, stored, without

AT_ONCE = 255 * 256
SKETCH = 256
#: Pairs whose sketches put them so far under the similarity are not compared on their whole sets (eight standard errors at 0.8).
FAR_BELOW = 0.2
TABLES, SAMPLED = 12, 3
#: Pairs of members that two blocks of a bucket make, shingles of a block, and how many of these are compared at a time.
PAIRS, BLOCK_SHINGLES, COLUMNS = 1 << 20, 500_000, 2048


def shingle_hashes(text: str | None, width: int, distinct: bool = False) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word shingles, at most AT_ONCE at a time; A-Z are lower-cased, words end at ASCII white space."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if words:
        h, n = xxhash.xxh64_intdigest, max(1, len(words) - width + 1)
        for s in range(0, n, AT_ONCE):
            part = words[s : s + AT_ONCE + width - 1]
            rows = zip(*[part[i:] for i in range(width)], strict=False) if len(words) >= width else [words]
            yield np.array([h(b" ".join(x), 42) for x in rows], np.uint64)


def majority(parts: Iterator[np.ndarray]) -> int:
    """The bits set in over half of the hashes; 0 if there are none."""
    total, n = np.zeros(64, np.int64), 0
    for h in parts:
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        whole = len(bits) // 255 * 255
        total += np.add.reduce(np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8), axis=0, dtype=np.int64)
        total += np.add.reduce(bits[whole:], axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(2 * total > n, bitorder="little").tobytes(), "little") if n else 0


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(df: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and its 64-bit fingerprint (as a signed long) over word shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([signed(majority(shingle_hashes(t, width))) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "fp"])

    return pick(df, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def variants(fp: str = "fp") -> F.Column:
    """The fingerprint and its 64 neighbours at one bit."""
    return F.explode(F.expr(f"transform(sequence(0, 64), i -> if(i = 64, {fp}, {fp} ^ shiftleft(1L, i)))"))


def links(prints: DataFrame) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints within two bits that connect all such pairs."""
    # As many tasks as shuffles have, not fewer for the few bytes of the fingerprints: each becomes 65 rows.
    tasks = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    balls = prints.select("fp").distinct().repartition(tasks, "fp").select("fp", variants().alias("key"))
    # A bucket holds 65 fingerprints at most: the key and its neighbours.
    low = balls.groupBy("key").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    pairs = low.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b"))
    return pairs.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).distinct()


def classes(df: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each row."""
    held = stored(fingerprints(df, width))
    root = components(links(held))
    # Of each fingerprint the smallest doc_id, then of each component; documents meet them by fingerprint.
    least = held.groupBy("fp").agg(F.min("doc_id").alias("least"))
    of = stored(least.join(root, least.fp == root.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    best = of.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(of.join(best, "root").select("fp", "component_id"))
    return held.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def sampled_majorities(h: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """Of each order, given by an odd factor, the bits set in over half of the SAMPLED hashes that come first."""
    if not len(h):
        return np.zeros(0, np.uint64)
    out = []
    # Long texts take the orders one by one.
    for c in np.array_split(odd, len(odd) if len(h) > AT_ONCE else 1):
        m = h * c[:, None]
        m ^= m >> np.uint64(29)
        first = h[np.argpartition(m, SAMPLED, axis=1)[:, :SAMPLED]] if len(h) > SAMPLED else np.broadcast_to(h, m.shape)
        of = first.shape[1]
        votes = [np.bitwise_and.reduce(first[:, list(x)], axis=1) for x in combinations(range(of), of // 2 + 1)]
        out.append(np.bitwise_or.reduce(votes))
    return np.concatenate(out)


def sketches(df: DataFrame, width: int) -> DataFrame:
    """Per distinct text: the smallest doc_id, the fingerprint, the sampled fingerprints, the sketch of its shingles.

    Each of TABLES sampled fingerprints is the majority of the SAMPLED shingles that come first in an order
    of its own. The sketch is the SKETCH smallest distinct shingle hashes, so up to that many shingles
    it is the whole set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odd = np.array([xxhash.xxh64_intdigest(str(i), 7) | 1 for i in range(TABLES)], np.uint64)
        for b in by_slices(batches):
            out = {"text_key": [], "fp": [], "sampled": [], "sketch": []}
            for t in b.column(1).to_pylist():
                parts = list(shingle_hashes(t, width))
                h = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
                keys = sampled_majorities(h, odd)
                out["text_key"].append(xxhash.xxh128(t or "").digest())
                out["fp"].append(signed(majority(iter(parts))))
                out["sampled"].append(keys.view(np.int64))
                out["sketch"].append(((h[:SKETCH] >> np.uint64(32)) if len(h) > SKETCH else h >> np.uint64(32)).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out["text_key"], pa.binary()), pa.array(out["fp"], pa.int64()), pa.array(out["sampled"], pa.list_(pa.int64())), pa.array(out["sketch"], pa.binary())], ["doc_id", *out])

    return pick(df, "doc_id", "text").mapInArrow(run, "doc_id long, text_key binary, fp long, sampled array<long>, sketch binary")


def overlap(a: bytes, b: bytes) -> float:
    """Jaccard similarity by two sketches: exact while both hold their whole sets."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    union = np.union1d(x, y)
    if len(x) >= SKETCH or len(y) >= SKETCH:
        union = union[:SKETCH]
    both = np.intersect1d(x, y, assume_unique=False)
    return float(np.isin(union, both).sum() / len(union)) if len(union) else 1.0


def whole_sets(df: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """doc_id and its distinct shingle hashes, of the wanted (doc_id)."""
    rows = pick(df, "doc_id", "text").join(wanted, "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_slices(batches):
            out = []
            for t in b.column(1).to_pylist():
                parts = list(shingle_hashes(t, width))
                out.append(np.unique(np.concatenate(parts)).view(np.int64) if parts else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "whole"])

    return rows.mapInArrow(run, "doc_id long, whole array<long>").distinct()


def verified(df: DataFrame, text: DataFrame, pairs: DataFrame, width: int, least: float) -> DataFrame:
    """The pairs (a, b) of the similarity: sketches drop those far below it, whole shingle sets decide on the others."""
    side = lambda x, c, v: x.select(F.col("doc_id").alias(c), F.col(v).alias(f"{v}_{c}"))
    both = pairs.join(side(text, "a", "sketch"), "a").join(side(text, "b", "sketch"), "b").select("a", "b", "sketch_a", "sketch_b")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [overlap(x, y) >= least - FAR_BELOW for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = stored(both.mapInArrow(near, "a long, b long").distinct())
    sets = stored(whole_sets(df, left.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), width))
    shared, total = F.size(F.array_intersect("whole_a", "whole_b")), F.size("whole_a") + F.size("whole_b")
    sure = left.join(side(sets, "a", "whole"), "a").join(side(sets, "b", "whole"), "b").where((total == 0) | (shared >= (total - shared) * F.lit(least)))
    out = stored(sure.select("a", "b").distinct())
    for x in (left, sets):
        forget(x)
    return out


def shared_counts(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of x has in common with each of y."""
    sizes = [len(v) for v in (*x, *y)]
    _, code = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    mine = row < len(x)
    # Only shingles of both sides count; they are the columns of two matrices of ones, some at a time.
    both = (np.bincount(code[mine], minlength=code.max(initial=-1) + 1) > 0) & (np.bincount(code[~mine], minlength=code.max(initial=-1) + 1) > 0)
    use = both[code]
    row, column = row[use], (np.cumsum(both) - 1)[code[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(x), len(y)), np.float32)
    for start in range(0, int(both.sum()), COLUMNS):
        part = slice(*np.searchsorted(column, (start, start + COLUMNS)))
        ones = np.zeros((len(sizes), COLUMNS), np.float32)
        ones[row[part], column[part] - start] = 1
        out += ones[: len(x)] @ ones[len(x) :].T
    return out


def block_links(group: list[tuple], low: int, high: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids and the smallest id that each reaches by links of the similarity between two blocks; rows are (own, doc_id, root, whole).

    Members of one class are linked already, so only pairs of different classes count.
    """
    x, y = [r for r in group if r[0] == low], [r for r in group if r[0] == high]
    none = np.zeros(0, np.int64)
    if not x or not y:
        return none, none
    (xi, xr), (yi, yr) = (np.array([r[1:3] for r in z], np.int64).T for z in (x, y))
    if len(np.unique(np.append(xr, yr))) < 2:
        return none, none
    total = np.add.outer([len(r[3]) for r in x], [len(r[3]) for r in y]).astype(np.float64)
    shared = shared_counts([r[3] for r in x], [r[3] for r in y]).astype(np.float64)
    i, j = np.nonzero(((total == 0) | (shared >= (total - shared) * least)) & (xr[:, None] != yr))
    ids, ends = np.unique(np.stack([xi[i], yi[j]]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(ids))
    while True:
        new = root.copy()
        np.minimum.at(new, a, root[b])
        np.minimum.at(new, b, root[a])
        new = new[new]
        if (new == root).all():
            return ids, ids[root]
        root = new


def between_classes(df: DataFrame, held: DataFrame, root: DataFrame, width: int, least: float) -> DataFrame:
    """(a, b): links that join the classes which the pairs with the smallest members have left apart in one bucket.

    All members of buckets that hold several classes are compared on whole shingle sets. A bucket is cut into blocks of
    bounded size, pairs of blocks are compared in one task as matrices, and what leaves it is at most one row per member:
    rows don't grow with the pairs.
    """
    named = held.where("n > 2").join(root, F.col("doc_id") == F.col("node"), "left").select("t", "key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    mixed = named.groupBy("t", "key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("t", "key")
    named = stored(named.join(mixed, ["t", "key"]))
    sets = stored(whole_sets(df, named.select("doc_id").distinct(), width))
    sizes = named.join(sets.select("doc_id", F.size("whole").alias("m")), "doc_id").groupBy("t", "key").agg(F.ceil(F.greatest(F.sum("m") / BLOCK_SHINGLES, F.count("*") / PAIRS**0.5)).cast("int").alias("blocks"))
    rows = named.join(sizes, ["t", "key"]).withColumn("own", F.expr("cast(pmod(xxhash64(doc_id), blocks) as int)")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    keys = ["t", "key", "low", "high"]
    rows = rows.select("t", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "doc_id", "root").join(sets, "doc_id")
    rows = rows.select(*keys, "own", "doc_id", "root", "whole").repartition(*keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for b in batches:
            out = []
            whole = b.column(7)
            flat, cuts = whole.values.to_numpy(), whole.offsets.to_numpy()
            for i, row in enumerate(zip(*(c.to_pylist() for c in b.columns[:7]), strict=True)):
                if row[:4] != key:
                    out.append(block_links(group, key[2], key[3], least) if key else ((), ()))
                    key, group = row[:4], []
                group.append((*row[4:], flat[cuts[i] : cuts[i + 1]].copy()))
            yield made(out)
        yield made([block_links(group, key[2], key[3], least)] if key else [])

    def made(found: list[tuple]) -> pa.RecordBatch:
        a, b = ([np.asarray(x, np.int64) for x in z] for z in (zip(*found, strict=True) if found else ((), ())))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (a, b)], ["a", "b"])

    out = stored(rows.mapInArrow(run, "a long, b long").where("a != b").distinct())
    for t in (named, sets):
        forget(t)
    return out


def near_duplicates(df: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """(doc_id, keep_id) of the documents that have a class of others; keep_id is the smallest doc_id of the class.

    At five words and similarity 0.8 whole-text fingerprints differ in up to 16 bits, beyond any ball
    that can be emitted. So texts also meet in sampled fingerprints (see sketches); every pair is verified on whole
    shingle sets. Null and empty texts are copies of each other; texts under `width` words have one shingle, the whole.
    Rows without doc_id take no part and stay; rows of one doc_id go or stay together, by any of their texts.
    """
    made = stored(sketches(df, width))
    text = stored(made.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.min_by(F.struct("fp", "sampled", "sketch"), "doc_id").alias("x")).select("text_key", "doc_id", "x.*"))
    copies = made.select("text_key", F.col("doc_id").alias("copy")).join(text.select("text_key", "doc_id"), "text_key").where("copy > doc_id").select(F.col("copy").alias("a"), F.col("doc_id").alias("b"))
    keys = text.select("doc_id", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), F.col("sampled"))).alias("t", "key"), "fp").where("t > 0").select("doc_id", "t", "key")
    balls = text.select("doc_id", F.lit(0).alias("t"), variants().alias("key"))
    held = stored(balls.unionByName(keys))
    first = stored(held.groupBy("t", "key").agg(F.min("doc_id").alias("b"), F.count("*").alias("n")).where("n > 1").select("t", "key", "b", "n"))
    held_by = stored(held.join(first, ["t", "key"]))
    forget(held)
    pairs = stored(held_by.where("doc_id > b").select(F.col("doc_id").alias("a"), "b").distinct())
    sure = verified(df, text, pairs, width, least).unionByName(copies)
    sure = stored(sure)
    more = between_classes(df, held_by, components(sure), width, least)
    forget(held_by)
    root = components(sure.unionByName(more))
    for t in (made, text, first, pairs, more):
        forget(t)
    return root.select(F.col("node").alias("doc_id"), F.col("root").alias("keep_id"))


def without_duplicates(df: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of df less those of a near-duplicate class that aren't its kept document."""
    return without(df, near_duplicates(df, width, least).where("doc_id != keep_id"))
