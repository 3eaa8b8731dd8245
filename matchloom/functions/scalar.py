"""Scalar and aggregate expressions whose results match the usual SQL-on-one-node engines.

Spark differs from those in rounding casts, bias correction and calendar differences;
these expressions are built-in functions only, so they stay within generated code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_half_even_long(x: Column) -> Column:
    """A double as bigint, halves to the even neighbour (2.5 to 2). Null stays null."""
    return F.rint(x).cast("bigint")


def skewness_adjusted(x: Column) -> Column:
    """Bias-corrected skewness; null for fewer than three values."""
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis_adjusted(x: Column) -> Column:
    """Bias-corrected excess kurtosis; null for fewer than four values."""
    n = F.count(x).cast("double")
    return F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def epoch_seconds(ts: Column) -> Column:
    """Seconds since 1970 with fraction, as double."""
    return F.unix_micros(ts.cast("timestamp")) / 1e6


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400e6


def quarter_label(ts: Column) -> Column:
    """2024-Q1"""
    return F.concat(F.year(ts).cast("string"), F.lit("-Q"), F.quarter(ts).cast("string"))


def month_boundaries(start: Column, end: Column) -> Column:
    """Month boundaries crossed from start to end (31 January to 1 March: 2)."""
    return (F.year(end) * 12 + F.month(end)) - (F.year(start) * 12 + F.month(start))


def fixed_bin(x: Column, width: float) -> Column:
    """The lower edge of x's bin of fixed width."""
    return F.floor(x / width) * width


def log10_bin(x: Column) -> Column:
    """The power of ten at or below x; null unless x is positive."""
    return F.when(x > 0, F.floor(F.log10(x)).cast("int"))


def gap_bucket(days: Column) -> Column:
    """'first' (null), '<1d', '1-7d', '7-30d' or '>30d'."""
    return F.when(days.isNull(), "first").when(days < 1, "<1d").when(days < 7, "1-7d").when(days < 30, "7-30d").otherwise(">30d")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def pair_key(a: Column, b: Column) -> Column:
    """The same key for (a, b) and (b, a)."""
    return F.concat_ws("|", F.least(a, b).cast("string"), F.greatest(a, b).cast("string"))


def overlap_seconds(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Seconds that two intervals share, 0 if they are apart."""
    return F.greatest(epoch_seconds(F.least(e1, e2)) - epoch_seconds(F.greatest(s1, s2)), F.lit(0.0))


def hash_parity(key: Column, seed: int = 0) -> Column:
    """0 or 1, evenly and reproducibly."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(2)).cast("int")


def file_pattern(name: Column) -> Column:
    """A file name with its dates, hashes and numbers as {date}, {hash} and {N}."""
    dated = F.regexp_replace(name, r"\d{4}-\d{2}-\d{2}", "{date}")
    return F.regexp_replace(F.regexp_replace(dated, "[0-9a-f]{16,}", "{hash}"), r"\d+(?![A-Za-z\d])", "{N}")


def relative_name(path: Column, root: str) -> Column:
    """A path below `root`, which may come with or without a scheme."""
    plain = F.regexp_replace(path, r"^[a-z0-9]+:/+", "/")
    base = root.rstrip("/") + "/"
    return F.when(plain.startswith(base), F.substr(plain, F.lit(len(base) + 1))).otherwise(plain)
