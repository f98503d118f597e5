"""Benchmark decontamination with DataFrame functions only.

Texts are lower-cased and cut into runs of letters and digits; shingles are five words. A window is any run of as many
words as an item has (a shorter text is one window). Windows are made where they can reach the similarity, which loses
none: the text holds one of the item's rarest shingles, and the window as many of the item's shingles as the similarity
needs, in whatever order. Windows and items are compared by SimHash (bits set in over half of the shingles, repeats
counted): fingerprints are cut into BLOCKS blocks, of which one differs in at most one bit if the whole differs in RADIUS
or fewer; items are indexed by all one-bit variants of their blocks. Pairs that meet are verified by exact weighted
Jaccard similarity (weight: how often a shingle occurs). At 0.8, fingerprints of unlike pairs differ in 9.7 bits of 64 on
average with a deviation of 2.9, so RADIUS leaves out about one pair of 1,000.

Items of one to four words have the whole sequence as their one shingle, so they match where it stands word by word.
Null or empty texts and items match nothing. Rows of one doc_id are told apart by their text; equal rows and equal
results are given once; of equally similar windows the first one counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import pick, small, stored, without

WIDTH, SIMILARITY = 5, 0.8
#: Blocks of the fingerprint; any RADIUS differing bits leave one of them at most one.
BLOCKS = 10
RADIUS = 2 * BLOCKS - 1
#: First bit and number of bits of each block.
CUTS = [(64 * i // BLOCKS, 64 * (i + 1) // BLOCKS - 64 * i // BLOCKS) for i in range(BLOCKS)]


def words(text: str) -> str:
    return f"filter(split(regexp_replace(lower(coalesce({text}, '')), '[^\\\\p{{L}}\\\\p{{N}}]+', ' '), ' '), w -> w != '')"


def shingles(text: str, width: int = WIDTH) -> Column:
    """The hashes of a text's shingles in order, none if it has fewer words. The words are bound once by a one-element array."""
    each = ", ".join(f"w[i + {k}]" for k in range(width))
    return F.expr(f"transform(array({words(text)}), w -> if(size(w) < {width}, cast(array() as array<bigint>), transform(sequence(0, greatest(size(w), {width}) - {width}), i -> xxhash64({each}))))[0]")


def half_counts(h: Column) -> list[Column]:
    """How many of the hashes have bits k and k + 32 set, in the two halves of one number for each k."""
    return [F.sum(F.shiftright(h, k).bitwiseAND(F.lit(0x0000000100000001))).alias(f"n{k}") for k in range(32)]


def fingerprint() -> Column:
    """The SimHash by the sums of half_counts and the number m of hashes."""
    low = [F.when(2 * F.col(f"n{k}").bitwiseAND(F.lit(0xFFFFFFFF)) > F.col("m"), F.lit(1 << k)).otherwise(F.lit(0)) for k in range(32)]
    high = [F.when(2 * F.shiftright(f"n{k}", 32) > F.col("m"), F.lit((1 << k + 32) - (1 << 64 if k == 31 else 0))).otherwise(F.lit(0)) for k in range(32)]
    total = F.lit(0).cast("long")
    for b in [*low, *high]:
        total = total.bitwiseOR(b.cast("long"))
    return total


def blocks(fp: str) -> Column:
    """(block, value) of a fingerprint."""
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << n) - 1)).cast("int").alias("value")) for i, (a, n) in enumerate(CUTS)])


def ball(index: DataFrame) -> DataFrame:
    """The items' blocks and their variants at one bit."""
    own = index.select("item_key", "item_fp", "h", F.explode(blocks("item_fp")).alias("x")).select("item_key", "item_fp", "h", "x.*")
    width = F.element_at(F.array(*[F.lit(n) for _, n in CUTS]), F.col("block") + 1)
    flips = F.transform(F.sequence(F.lit(0), width), lambda i: F.when(i == width, F.col("value")).otherwise(F.col("value").bitwiseXOR(F.call_function("shiftleft", F.lit(1), i))))
    return own.select("item_key", "item_fp", "h", "block", F.explode(flips).alias("value"))


def similarity(a: str, b: str) -> Column:
    """Weighted Jaccard: shared weight over all weight."""
    both = f"aggregate(transform(array_distinct(array_intersect({a}, {b})), s -> least(size(filter({a}, x -> x = s)), size(filter({b}, x -> x = s)))), 0, (t, x) -> t + x)"
    return F.expr(f"transform(array({both}), s -> s / (size({a}) + size({b}) - s))[0]")


def need(m: Column) -> Column:
    """How many of an item's m shingles a window of the similarity holds at least, repeats counted."""
    return F.ceil(m * F.lit(SIMILARITY) - 1e-9).cast("int")


def rarest(grams: DataFrame) -> DataFrame:
    """Of each item the shingles of which a window of the similarity holds one; those held by few items come first."""
    held = grams.groupBy("gram").agg(F.count_distinct("item_key").alias("held"))
    place = F.row_number().over(Window.partitionBy("item_key").orderBy("held", "gram", "at"))
    return grams.join(held, "gram").withColumn("place", place).where(F.col("place") <= F.col("m") - need(F.col("m")) + 1).select("gram", "item_key").distinct()


def items_of(benchmark: DataFrame) -> DataFrame:
    """(item_key, n_words, width, h, item_id): the key stands for the item's words."""
    rows = pick(benchmark, "item_id", "text").select("item_id", F.expr(words("text")).alias("w")).where("size(w) > 0")
    rows = rows.select("item_id", F.md5(F.array_join("w", " ")).alias("item_key"), F.array_join("w", " ").alias("t"), F.size("w").alias("n_words"))
    width = F.least("n_words", F.lit(WIDTH))
    h = F.when(width == WIDTH, shingles("t"))
    for k in range(1, WIDTH):
        h = h.when(width == k, shingles("t", k))
    return rows.select("item_key", "n_words", width.alias("width"), h.alias("h"), "item_id")


def candidates(docs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(doc_id, key, item_key, start, wh): the windows that hold enough of an item's shingles, as the hashes of theirs."""
    grams = stored(texts.select("item_key", "n_words", F.size("h").alias("m"), F.posexplode("h").alias("at", "gram")))
    keys = stored(rarest(grams))
    source = pick(docs, "doc_id", "text").select("doc_id", F.md5(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("key"), "text")
    found = source.select("doc_id", "key", F.explode(shingles("text", width)).alias("gram")).join(small(keys, 80), "gram")
    pairs = stored(found.select("doc_id", "key", "item_key").distinct())
    # Only texts with a rare shingle are looked at again: all places of the shingles of the items they may hold.
    marked = pairs.select("doc_id", "key").distinct()
    held = stored(source.join(marked, [source.doc_id.eqNullSafe(marked.doc_id), source.key == marked.key], "left_semi").distinct().select("doc_id", "key", shingles("text", width).alias("all")))
    every = grams.select("item_key", "m", "gram").distinct()
    hits = held.select("doc_id", "key", F.size("all").alias("n"), F.posexplode("all").alias("place", "gram")).join(small(every, 80), "gram")
    hits = hits.join(pairs.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), F.col("item_key").alias("i")), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")) & (F.col("item_key") == F.col("i")), "left_semi")
    lists = hits.groupBy("doc_id", "key", "item_key", "m", "n").agg(F.array_sort(F.collect_list("place")).alias("p"))
    lists = lists.withColumn("need", need(F.col("m"))).where(F.size("p") >= F.col("need"))
    # The need places i to i + need - 1 stand in the windows that start from the last of them on back to the first.
    run = "transform(filter(sequence(0, size(p) - need), i -> p[i + need - 1] - p[i] < m), i -> struct(greatest(0, p[i + need - 1] - m + 1) as a, least(p[i], greatest(0, n - m)) as b))"
    starts = F.expr(f"array_distinct(flatten(transform(filter({run}, x -> x.a <= x.b), x -> sequence(x.a, x.b))))")
    starts = lists.select("doc_id", "key", "item_key", "m", F.explode(starts).alias("start"))
    at = starts.select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "item_key", "m", "start")
    windows = at.join(held, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("key")))
    return windows.select("doc_id", "key", "item_key", "start", F.expr("slice(all, start + 1, m)").alias("wh"))


def verified(windows: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs of the similarity among windows and items whose fingerprints meet within RADIUS."""
    windows = stored(windows)
    at = ["doc_id", "key", "item_key", "start"]
    parts = windows.select(*at, F.size("wh").alias("m"), F.explode("wh").alias("gram")).groupBy(*at, "m").agg(*half_counts(F.col("gram")))
    prints = parts.select(*at, fingerprint().alias("fp"))
    probes = prints.select(*at, "fp", F.explode(blocks("fp")).alias("x")).select(*at, "fp", "x.*")
    index = texts.select("item_key", "h", F.size("h").alias("m"), F.explode("h").alias("gram")).groupBy("item_key", "h", "m").agg(*half_counts(F.col("gram"))).select("item_key", "h", fingerprint().alias("item_fp"))
    index = stored(index)
    met = probes.join(ball(index).drop("h"), ["item_key", "block", "value"])
    met = met.select(*at, F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("distance")).where(F.col("distance") <= RADIUS).distinct()
    near = met.join(windows.select(*[F.col(c).alias(f"_{c}") for c in at], "wh"), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("key") == F.col("_key")) & (F.col("item_key") == F.col("_item_key")) & (F.col("start") == F.col("_start"))).select(*at, "distance", "wh")
    sure = near.join(index.select("item_key", "h"), "item_key").withColumn("similarity", similarity("wh", "h")).where(F.col("similarity") >= SIMILARITY)
    return sure.select(*at, "distance", "similarity")


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, n_words, distance, similarity): per document and item the most similar window, the first of equal ones."""
    items = stored(items_of(benchmark))
    # Items of equal words are searched once. Widths are five at most.
    texts = stored(items.groupBy("item_key").agg(F.first("n_words").alias("n_words"), F.first("width").alias("width"), F.first("h").alias("h")))
    found = None
    for (width,) in texts.select("width").distinct().orderBy("width").collect():
        own = texts.where(F.col("width") == width)
        x = verified(candidates(docs, own, width), own)
        found = x if found is None else found.unionByName(x)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, start long, n_words long, distance long, similarity double")
    best = found.groupBy("doc_id", "item_key").agg(F.min_by(F.struct("start", "distance", "similarity"), F.struct(-F.col("similarity"), F.col("start"))).alias("x"))
    return best.join(items, "item_key").select("doc_id", "item_id", F.col("x.start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"), F.col("x.distance").cast("long").alias("distance"), F.col("x.similarity").alias("similarity")).distinct()


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item."""
    return without(docs, stored(matches(docs, benchmark).select("doc_id").distinct()))
