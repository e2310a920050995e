"""Column-expression builders shared by all operators (everything stays JVM-side)."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE_US = 60_000_000
DAY_US = 86_400_000_000
Z_ROUNDED = 1.96
Z_EXACT = 1.959963984540054


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ, independent of the session zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def minutes_between(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(60_000_000.0)


def fixed_text(x: Column, digits: int) -> Column:
    """Decimal text as C and Python print it: the binary value itself is rounded, so a decimal that only looks like a tie is none."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits))


def half_even(x: Column, scale: int = 0) -> Column:
    return F.bround(x, scale)


def half_up_index(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def finite_or_null(text: Column) -> Column:
    """Optional number: NULL when blank, unparsable or not finite."""
    value = text.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def tolerant_bool(text: Column) -> Column:
    return F.lower(F.trim(text)) == "true"


def cases(pairs: Sequence[tuple[Column, object]], otherwise: object = None) -> Column:
    """First matching branch of an ordered (condition, value) list."""
    out = None
    for condition, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(condition, value) if out is None else out.when(condition, value)
    return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))


def reasons(pairs: Sequence[tuple[Column, object]]) -> Column:
    """Ordered array of the labels whose condition holds (NULL counts as not holding)."""
    items = [F.when(c, v if isinstance(v, Column) else F.lit(v)) for c, v in pairs]
    return F.array_compact(F.array(*items))


def ratio(numerator: Column, denominator: Column) -> Column:
    return F.when(denominator != 0, numerator / denominator)


def lit_rows(rows: Sequence[dict], name: str) -> Column:
    """Explode a short constant table beside every row (fixed fan-out, not a join)."""
    return F.explode(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])).alias(name)


# --------------------------------------------------------------------- hash randomness
def hash_uniform(*parts: Column | str | int) -> Column:
    """Uniform on [0, 1) from md5 of the ':'-joined key; same value in every engine and partitioning."""
    cols = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.substring(F.md5(F.concat_ws(":", *cols)), 1, 13)
    return F.conv(digest, 16, 10).cast("double") / F.lit(float(2**52))


def hash_normal(*parts: Column | str | int) -> Column:
    """Standard normal by Box-Muller on two hash uniforms."""
    u = F.greatest(hash_uniform(*parts, "u"), F.lit(2.0**-52))
    v = hash_uniform(*parts, "v")
    return F.sqrt(-2.0 * F.log(u)) * F.cos(F.lit(2.0 * math.pi) * v)


def hash_sign(*parts: Column | str | int) -> Column:
    return F.when(hash_uniform(*parts, "u") < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0))


# The six-point multiplier distribution, equal probability each.
SIX_POINTS = (-math.sqrt(1.5), -1.0, -math.sqrt(0.5), math.sqrt(0.5), 1.0, math.sqrt(1.5))


def hash_six_point(*parts: Column | str | int) -> Column:
    slot = F.least(F.floor(hash_uniform(*parts, "u") * 6).cast("int"), F.lit(5))
    return F.element_at(F.array(*[F.lit(v) for v in SIX_POINTS]), slot + 1)


def hash_exponential(*parts: Column | str | int) -> Column:
    return -F.log(F.greatest(hash_uniform(*parts, "u"), F.lit(2.0**-52)))


MULTIPLIERS = {"gaussian": hash_normal, "rademacher": hash_sign, "webb": hash_six_point}


# ------------------------------------------------------------------------- statistics
def wilson(successes: Column, n: Column, z: float = Z_EXACT) -> tuple[Column, Column]:
    """Wilson score interval; NULL when there are no trials."""
    p = successes / n
    z2 = z * z
    scale = F.lit(1.0) + F.lit(z2) / n
    centre = (p + F.lit(z2 / 2.0) / n) / scale
    half = F.lit(z) * F.sqrt(p * (1.0 - p) / n + F.lit(z2 / 4.0) / (n * n)) / scale
    return F.when(n > 0, centre - half), F.when(n > 0, centre + half)


def binomial_se(successes: Column, n: Column) -> Column:
    p = successes / n
    return F.when(n > 0, F.sqrt(p * (1.0 - p) / n))


def finite_p(exceed: Column, draws: Column) -> Column:
    return (F.lit(1.0) + exceed) / (draws + F.lit(1.0))


def sample_skew(n: Column, m2: Column, m3: Column) -> Column:
    """Bias-corrected skewness from central moments (divisor n)."""
    g1 = m3 / F.pow(m2, 1.5)
    return F.when((n > 2) & (m2 > 0), F.sqrt(n * (n - 1.0)) / (n - 2.0) * g1)


def sample_excess_kurtosis(n: Column, m2: Column, m4: Column) -> Column:
    g2 = m4 / (m2 * m2) - 3.0
    return F.when((n > 3) & (m2 > 0), (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6.0))
