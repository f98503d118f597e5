"""Base64 VLQ as column expressions: no UDF, so they stay in the JVM. Whole mappings texts go through operators.mappings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the base-64 alphabet.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
#: One value: digits with the continuation bit, then one without.
TOKEN = "[g-z0-9+/]*[A-Za-f]"


def vlq_unsigned(token: Column) -> Column:
    """The unsigned value of one token, by shifts so that all 63 bits are exact; null for null."""
    value = lambda d: F.instr(F.lit(ALPHABET), d).cast("long") - 1
    shifted = lambda i: F.call_function("shiftleft", value(F.substr(token, i, F.lit(1))).bitwiseAND(31), (i - 1) * 5)
    return F.aggregate(F.sequence(F.lit(1), F.length(token)), F.lit(0).cast("long"), lambda t, i: t.bitwiseOR(shifted(i)))


def vlq_signed(token: Column) -> Column:
    raw = vlq_unsigned(token)
    half = F.shiftrightunsigned(raw, 1)
    return F.when(raw.bitwiseAND(1) == 1, -half).otherwise(half)


def vlq_encode_unsigned(value: Column) -> Column:
    n = F.greatest(F.lit(1), F.ceil(F.length(F.bin(value)) / 5)).cast("int")
    five = lambda i: F.call_function("shiftrightunsigned", value.cast("long"), i * 5).bitwiseAND(31).cast("int")
    letter = lambda i: F.substr(F.lit(ALPHABET), five(i) + F.when(i < n - 1, 32).otherwise(0) + 1, F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), letter), "")


def vlq_encode(value: Column) -> Column:
    return vlq_encode_unsigned(F.when(value < 0, -value * 2 + 1).otherwise(value * 2))


def vlq_error(text: Column) -> Column:
    """Why a text isn't one value (null if it is): InvalidBase64, UnexpectedEof or VlqOverflow (over 13 digits)."""
    digits = F.length(F.regexp_extract(text, "^[g-z0-9+/]*[A-Za-f]?", 0))
    bad = F.when(text.rlike("^[g-z0-9+/]{13}"), "VlqOverflow").when(text.rlike("^[g-z0-9+/]*[^A-Za-z0-9+/]"), "InvalidBase64").when(text.rlike("^[g-z0-9+/]*$"), "UnexpectedEof")
    return F.when(text.isNotNull() & (digits >= 0), bad)
