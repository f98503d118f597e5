"""Indexed RAM bundles: binary in, module rows out, with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The magic number's bytes as stored, and the sizes of the header and an entry.
MAGIC, HEADER, ENTRY = "E5D10BFB", 12, 8


def u32(content: Column, at: Column) -> Column:
    """The little-endian unsigned integer at a byte offset."""
    part = lambda k: F.conv(F.hex(F.substr(content, (at + 1 + k).cast("int"), F.lit(1))), 16, 10).cast("long") * 256**k
    return part(0) + part(1) + part(2) + part(3)


def is_ram_bundle(content: str = "content") -> Column:
    return F.hex(F.substring(content, 1, 4)) == MAGIC


def modules(bundles: DataFrame) -> DataFrame:
    """(bundle_id, module_id, source_code) of (bundle_id, content); empty slots give no row."""
    rows = bundles.where(is_ram_bundle()).select("bundle_id", "content", u32(F.col("content"), F.lit(4)).alias("n"), u32(F.col("content"), F.lit(8)).alias("startup"))
    rows = rows.where("n > 0").select("*", F.explode(F.expr("sequence(0, cast(n as int) - 1)")).alias("module_id"))
    entry = HEADER + F.col("module_id") * ENTRY
    rows = rows.select("bundle_id", "module_id", "content", (HEADER + F.col("n") * ENTRY + F.col("startup")).alias("base"), u32(F.col("content"), entry).alias("at"), u32(F.col("content"), entry + 4).alias("size"))
    code = F.substr("content", (F.col("base") + F.col("at") + 1).cast("int"), F.col("size").cast("int"))
    return rows.where("at != 0 or size != 0").select("bundle_id", "module_id", F.decode(code, "UTF-8").alias("source_code"))


def startup(bundles: DataFrame) -> DataFrame:
    """(bundle_id, n_modules, startup_code) of (bundle_id, content): slots, empty ones included, and the code before them."""
    rows = bundles.where(is_ram_bundle()).select("bundle_id", "content", u32(F.col("content"), F.lit(4)).alias("n"), u32(F.col("content"), F.lit(8)).alias("size"))
    # The stated size counts a closing zero byte where there is one.
    code = F.decode(F.substr("content", (HEADER + F.col("n") * ENTRY + 1).cast("int"), F.col("size").cast("int")), "UTF-8")
    return rows.select("bundle_id", F.col("n").alias("n_modules"), F.rtrim(code, F.lit("\0")).alias("startup_code"))


def is_unbundle(paths: Column) -> Column:
    """Whether a folder's list of paths is that of modules in files of their own."""
    return F.exists(paths, lambda p: p.startswith("js-modules/") | p.contains("/js-modules/"))


def unbundled(spark: SparkSession, path: str) -> DataFrame:
    """(module_id, source_code) of a folder of modules in files of their own, named by their numbers."""
    rows = spark.read.text(f"{path.rstrip('/')}/js-modules/*.js", wholetext=True)
    number = F.regexp_extract(F.col("_metadata.file_name"), "^([0-9]+)\\.js$", 1)
    return rows.select(F.nullif(number, F.lit("")).try_cast("int").alias("module_id"), F.col("value").alias("source_code")).where("module_id is not null")
