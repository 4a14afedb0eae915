"""Small Column expressions used across operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(num: Column, den: Column) -> Column:
    """``num / den``, NULL for a zero denominator (ANSI mode raises otherwise)."""
    return F.try_divide(num, den)


def distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNull(), None).otherwise(
        F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))
    )


def wrap_degrees(delta: Column) -> Column:
    """Map an angle difference into [-180, 180)."""
    return F.pmod(delta + F.lit(180.0), F.lit(360.0)) - F.lit(180.0)


def hashed(*parts: Column | str | int) -> Column:
    """Deterministic 60-bit draw from md5 of ``a|b|...``; the same on any engine."""
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    digest = F.md5(F.concat_ws("|", *[c.cast("string") for c in cols]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """Deterministic draw in [0, 1)."""
    return hashed(*parts) / F.lit(float(2**60))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone."""
    days = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    seconds = days * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60
    fraction = F.extract(F.lit("SECOND"), ts).cast("decimal(18,6)") * 1_000_000
    return seconds * 1_000_000 + fraction.cast("long")


def logit(p: Column, floor: float) -> Column:
    q = clip(p, floor, 1.0 - floor)
    return F.ln(q / (1 - q))


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two equal-length arrays, zero vectors give NULL."""
    def dot(u: Column, v: Column) -> Column:
        return F.aggregate(
            F.zip_with(u, v, lambda p, q: p.cast("double") * q.cast("double")),
            F.lit(0.0),
            lambda acc, x: acc + x,
        )
    return ratio(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every floating column (and turn -0.0 into 0.0) for stable comparison."""
    return df.select(
        *[
            (F.round(F.col(n), digits) + F.lit(0.0)).alias(n)
            if t in ("double", "float") else F.col(n)
            for n, t in df.dtypes
        ]
    )
