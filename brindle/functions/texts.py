"""Text functions, Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def entropy_milli(v: Column) -> Column:
    """Shannon entropy in bits per character, in thousandths, rounded half up."""
    chars = F.split(v, "")
    n = F.length(v).cast("double")
    parts = F.transform(F.array_sort(F.array_distinct(chars)), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double"))
    h = F.aggregate(parts, F.lit(0.0), lambda acc, k: acc - k / n * F.log2(k / n))
    return F.floor(h * 1000 + 0.5).cast("long")


def mask(v: Column, visible: int = 4) -> Column:
    """All stars up to twice ``visible`` characters; else at most a quarter shows on each side."""
    n = F.length(v)
    e = F.least(F.lit(visible), F.floor(n / 4).cast("int"))
    return F.when(n <= 2 * visible, F.repeat(F.lit("*"), n)).otherwise(F.concat(F.left(v, e), F.repeat(F.lit("*"), n - 2 * e), F.right(v, e)))


#: Token shapes that reports must not show (fixed values).
TOKENS = (
    r"(?i)(Bearer|Basic) +[A-Za-z0-9._~+/=-]+",
    r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    r"(?i)(sk|pk)_(live|test)_[A-Za-z0-9]{12,}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"AIza[0-9A-Za-z_-]{20,}",
    r"[0-9a-f]{40}",
)


def redact(v: Column) -> Column:
    for t in TOKENS:
        v = F.regexp_replace(v, t, "[REDACTED]")
    return v


def words(v: Column) -> Column:
    return F.filter(F.split(v, "[ \t\n\r\f\x0b]+"), lambda w: w != "")
