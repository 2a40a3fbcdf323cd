"""Scalar functions as column expressions; all stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def pair_of(a: str, b: str) -> tuple[Column, Column]:
    """Both in order."""
    return F.least(a, b), F.greatest(a, b)


def zero_if_null(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), F.lit(0.0))


def clip(c: Column, low: float = 0.0, high: float = 5.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def n_listed(c: str | Column) -> Column:
    """Number of comma-separated values; null, '' and 'None' in any case have none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.isNull() | F.lower(c).isin("", "none"), 0).otherwise(F.size(F.split(c, ",")))


def n_keys(m: str) -> Column:
    return F.coalesce(F.size(F.map_keys(m)), F.lit(0))


def n_true(m: str) -> Column:
    """Values 'True' of a map, and of the maps that its values spell out."""
    inner = lambda v: F.size(F.regexp_extract_all(v, F.lit(r":\s*'?(True)\b"), F.lit(1)))
    count = F.aggregate(F.map_values(m), F.lit(0), lambda n, v: n + F.when(v == "True", 1).when(v.startswith("{"), inner(v)).otherwise(0))
    return F.coalesce(count, F.lit(0))


def sum_of_values(m: str) -> Column:
    return F.coalesce(F.aggregate(F.map_values(m), F.lit(0).cast("long"), lambda n, v: n + v), F.lit(0))


def days_between(a: str, b: str) -> Column:
    return F.abs(F.datediff(F.to_date(a), F.to_date(F.lit(b))))


def bytes_mod(c: str | Column, m: int) -> Column:
    """The UTF-8 bytes of a text, read as one big number, modulo m; folded, so nothing overflows."""
    c = F.col(c) if isinstance(c, str) else c
    h = F.hex(F.encode(c, "UTF-8"))
    digits = F.transform(F.filter(F.split(h, ""), lambda x: x != ""), lambda x: F.conv(x, 16, 10).cast("long"))
    return F.aggregate(digits, F.lit(0).cast("long"), lambda acc, x: (acc * 16 + x) % m)


def linear_hash(x: Column, a: int, b: int, m: int) -> Column:
    return (x * a + b) % m


def coefficients(k: int) -> list[tuple[int, int]]:
    """Fixed (a, b) of k linear hashes, by a rule."""
    return [(1009 * (j + 1) + 7, 2003 * (j + 1) + 13) for j in range(k)]


def trailing_zeros(c: Column) -> Column:
    """Of the binary digits; zero has one."""
    b = F.bin(c)
    return F.length(b) - F.length(F.rtrim(b, F.lit("0")))


def n_hashes(bits: int, batch: int, batches: int) -> int:
    """Best number of Bloom hashes, one at least."""
    return max(1, math.floor(bits * math.log(2) / (batch * batches)))


def bloom_rate(bits: int, k: int, m: Column) -> Column:
    """Expected share of false positives after m insertions."""
    return F.pow(1 - F.exp(-k * m / F.lit(float(bits))), F.lit(float(k)))


def deviation(n: Column, total: Column, squares: Column, floor: float = 1e-9) -> Column:
    """Standard deviation from moments, guarded against zero and rounding."""
    return F.sqrt(F.greatest(F.lit(floor), squares / n - F.pow(total / n, F.lit(2.0))))
