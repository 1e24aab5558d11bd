"""Scalar expressions: quantisation, error measures, bit widths.  All stay inside code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INT32_MAX = 2147483647
#: Fixed value: scale of the logarithmic overflow code.
LOG_SCALE = 1e5


def quantise(x: Column, decimals: int = 6) -> Column:
    """Half-even rounding to a long at ``decimals`` decimal places."""
    return F.rint(x * F.lit(float(10**decimals))).cast("long")


def dequantise(q: Column, decimals: int = 6) -> Column:
    return q.cast("double") / F.lit(float(10**decimals))


def has_fraction(x: Column) -> Column:
    """Aggregate: some value of the stream has a fractional part."""
    return F.coalesce(F.bool_or(F.abs(x - F.rint(x)) > 1e-9), F.lit(False))


def log_code(x: Column, precision: Column) -> Column:
    """Scaled integer code; beyond 32 bits a negative logarithmic one."""
    s = x * precision
    return F.when(s <= INT32_MAX, F.rint(s)).otherwise(-F.rint(F.log2(s) * LOG_SCALE)).cast("long")


def log_decode(code: Column, precision: Column) -> Column:
    return F.when(code >= 0, code / precision).otherwise(F.pow(F.lit(2.0), -code / LOG_SCALE) / precision)


def level_code(x: Column, high: Column, bits: Column) -> Column:
    """N-bit level of x against the segment's maximum (1 where that is not positive)."""
    top = F.when(high > 0, high).otherwise(1.0)
    steps = F.pow(F.lit(2.0), bits) - 1
    return F.least(F.greatest(F.rint(x / top * steps), F.lit(0.0)), steps).cast("long")


def relative_error(ref: Column, val: Column) -> Column:
    return F.when(ref == 0, F.when(val == 0, 0.0).otherwise(float("inf"))).otherwise(F.abs(val - ref) / F.abs(ref))


def ratio(a: Column, b: Column) -> Column:
    """a / b where both are positive, else null."""
    return F.when((a > 0) & (b > 0), a / b)


def zigzag(x: Column) -> Column:
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-(z.bitwiseAND(F.lit(1))))


def bit_width(x: Column) -> Column:
    """Bits of a non-negative long; 0 for 0."""
    return F.when(x <= 0, 0).otherwise(F.length(F.bin(x)))


def packed_bytes(high: Column, n: Column, fixed: int = 8) -> Column:
    """Bytes of n values of the width of the largest, after a fixed header."""
    return (F.lit(fixed) + F.ceil(bit_width(high) * n / 8.0)).cast("long")


def first_match(text: Column, rules: list[tuple[str, str]], default: str) -> Column:
    """Label of the first rule whose pattern is found."""
    return reduce(lambda acc, r: F.when(text.rlike(r[0]), r[1]).otherwise(acc), reversed(rules), F.lit(default))


def size_bytes(text: Column) -> Column:
    """``12.3 GiB`` as bytes; K, M, G, T are powers of 1024."""
    pattern = r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([KMGT]?)I?B?\s*$"
    unit = F.upper(F.regexp_extract(text, pattern, 2))
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return F.rint(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).cast("double") * F.pow(F.lit(1024.0), power)).cast("long")
