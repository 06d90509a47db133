"""64-bit perceptual hashes as two 32-bit halves in BIGINT, and vector helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def halves(hex_hash: Column) -> Column:
    """A 16-digit hex hash to ``struct<h1, h2>``; null stays null."""
    padded = F.lpad(hex_hash, 16, "0")
    return F.when(
        hex_hash.isNotNull(),
        F.struct(
            F.conv(F.substring(padded, 1, 8), 16, 10).cast("bigint").alias("h1"),
            F.conv(F.substring(padded, 9, 8), 16, 10).cast("bigint").alias("h2"),
        ),
    )


def to_hex(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h1), 8, "0"), F.lpad(F.hex(h2), 8, "0")))


def hamming(h1: Column, h2: Column, t1: Column, t2: Column) -> Column:
    return F.bit_count(h1.bitwiseXOR(t1)) + F.bit_count(h2.bitwiseXOR(t2))


def sign_bits(vector: Column, start: int) -> Column:
    """32 sign bits of a vector, from 1-based ``start``, packed into a BIGINT."""
    return F.aggregate(
        F.slice(vector, start, 32), F.lit(0).cast("bigint"), lambda acc, x: acc * 2 + F.when(x > 0, 1).otherwise(0)
    )


def l2_normalise(vector: Column) -> Column:
    """Unit length; a zero vector is left as it is."""
    wide = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda acc, x: acc + x * x))
    return F.when(norm == 0, wide).otherwise(
        F.transform(F.arrays_zip(wide.alias("v"), F.array_repeat(norm, F.size(wide)).alias("n")), lambda z: z["v"] / z["n"])
    )
