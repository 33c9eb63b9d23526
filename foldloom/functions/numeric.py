"""Numeric expressions: finiteness, rounding, bins, hashing to [0, 1)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def is_infinite(c: Column) -> Column:
    return F.abs(c.cast("double")) == F.lit(INF)


def finite(c: Column) -> Column:
    """The value as double, NULL where it is NaN or infinite."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(INF)), x)


def finite_or_zero(c: Column) -> Column:
    return F.coalesce(finite(c), F.lit(0.0))


def or_one(scale: Column) -> Column:
    """A scale to divide by: 0 (constant column) and NULL become 1."""
    return F.coalesce(F.nullif(scale, F.lit(0.0)), F.lit(1.0))


def half_even(c: Column, digits: int = 3) -> Column:
    return F.bround(c, digits)


def ratio(numerator: Column, denominator: Column) -> Column:
    """Division that yields NULL, not an error, for a zero denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def equal_width_bin(c: Column, lo: Column, hi: Column, bins: int) -> Column:
    """0-based bin; the last one is closed, a constant column is all bin 0."""
    position = F.floor((c - lo) / or_one((hi - lo) / F.lit(bins)))
    return F.least(F.lit(bins - 1), F.greatest(F.lit(0), position)).cast("int")


def spread(key: Column, modulus: int = 10007, factor: int = 7919, shift: int = 0) -> Column:
    """Arithmetic shuffle key: the same in any engine, no overflow for any 64-bit key."""
    return F.pmod(F.pmod(key, F.lit(modulus)) * F.lit(factor) + F.lit(shift), F.lit(modulus))


def unit(key: Column, salt: Column | int = 0, modulus: int = 10007) -> Column:
    """Deterministic pseudo-uniform number in [0, 1) from an integer key and a salt."""
    salt = F.lit(salt) if isinstance(salt, int) else salt
    mixed = F.pmod(key, F.lit(modulus)) * F.lit(7919) + salt * F.lit(104729)
    return F.pmod(mixed, F.lit(modulus)) / F.lit(float(modulus))


MERSENNE = 2147483647


def mixed_unit(key: Column, salt: int) -> Column:
    """Well-mixed deterministic uniform in (0, 1): two quadratic rounds modulo 2^31 - 1.

    Products stay below 2^63, so the result is the same in any engine.
    """
    m = F.lit(MERSENNE)
    x = F.pmod(F.pmod(key.cast("long"), m) + F.lit(salt * 7919 + 1), m)
    x = (x * x + x * F.lit(48271)) % m
    x = (x * x + x * F.lit(16807) + F.lit(salt)) % m
    return (x + F.lit(0.5)) / F.lit(float(MERSENNE))


def normal(key: Column, salt: int) -> Column:
    """Standard normal by Box-Muller from two deterministic uniforms."""
    radius = F.sqrt(F.lit(-2.0) * F.ln(mixed_unit(key, 2 * salt + 1)))
    return radius * F.cos(F.lit(2.0 * math.pi) * mixed_unit(key, 2 * salt + 2))
