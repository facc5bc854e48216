"""Hashes, ids and scores as column expressions.  Unsigned 32-bit values are longs, 64-bit ones decimal(20,0)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOOM_BITS, BLOOM_HASHES = 40_000_000, 7
_MASK = 4294967295


def _byte_values(text: Column) -> Column:
    """The UTF-8 bytes of a text as longs."""
    h = F.hex(text.cast("binary"))
    n = F.octet_length(text)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.substring(h, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def fnv1a32(text: Column) -> Column:
    return F.aggregate(_byte_values(text), F.lit(2166136261).cast("long"), lambda h, b: h.bitwiseXOR(b).__mul__(F.lit(16777619).cast("long")).bitwiseAND(F.lit(_MASK).cast("long")))


def djb2(text: Column) -> Column:
    return F.aggregate(_byte_values(text), F.lit(5381).cast("long"), lambda h, b: (h * 33 + b).bitwiseAND(F.lit(_MASK).cast("long")))


def bloom_indexes(text: Column) -> Column:
    """The bits of a text in the clean-word Bloom filter."""
    both = F.struct(fnv1a32(text).alias("a"), djb2(text).bitwiseOR(F.lit(1).cast("long")).alias("b"))
    return F.transform(F.array(both), lambda h: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BLOOM_HASHES - 1).cast("long")), lambda i: (h["a"] + i * (h["b"] + i)).bitwiseAND(F.lit(_MASK).cast("long")) % BLOOM_BITS))[0]


def fnv1a64(text: Column) -> Column:
    """FNV-1a over 64 bits, 0 replaced by 1, in two halves of 32 bits so that no product leaves a long."""
    start = F.struct(F.lit(0xCBF29CE4).cast("long").alias("hi"), F.lit(0x84222325).cast("long").alias("lo"))
    mask = F.lit(_MASK).cast("long")

    def step(h, b):
        lo = h["lo"].bitwiseXOR(b)
        low = lo * F.lit(0x1B3).cast("long")
        # the prime is 2^40 + 0x1b3: the high half takes the low one shifted by 8 more bits
        hi = h["hi"] * F.lit(0x1B3).cast("long") + F.shiftright(low, 32) + F.shiftleft(lo, 8)
        return F.struct(hi.bitwiseAND(mask).alias("hi"), low.bitwiseAND(mask).alias("lo"))

    h = F.aggregate(_byte_values(text), start, step, lambda x: x["hi"].cast("decimal(20,0)") * F.lit(4294967296).cast("decimal(20,0)") + x["lo"].cast("decimal(20,0)")).cast("decimal(20,0)")
    return F.when(h == 0, F.lit(1).cast("decimal(20,0)")).otherwise(h)


def uuid_of(namespace: str, text: Column) -> Column:
    """A UUID-shaped id from SHA-1 of `namespace::text`."""
    h = F.sha1(F.concat(F.lit(f"{namespace}::"), text).cast("binary"))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def decision(score: Column, review: float, block: float) -> Column:
    return F.when(score >= block, F.lit("block")).when(score >= review, F.lit("review")).otherwise(F.lit("allow"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of doubles by higher-order functions."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def clamped(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def to_float(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.lit(0.0))


def to_int(x: Column) -> Column:
    return F.floor(x.try_cast("double")).try_cast("int")


def percent(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part / whole * 100.0)
