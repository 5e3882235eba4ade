"""Column expressions with the comparison and division rules of float32 images and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAN = float("nan")
INF = float("inf")
_RANGES = {"tinyint": 7, "smallint": 15, "int": 31, "bigint": 63}


def finite(c: Column) -> Column:
    """True for values that are neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(INF))


def only_finite(c: Column) -> Column:
    """The value, or null where it is not finite: what aggregates then skip."""
    return F.when(finite(c), c)


def divide(n: Column, d: Column) -> Column:
    """IEEE division of doubles, whatever the ANSI setting; the sign of a zero divisor is ignored."""
    n, d = n.cast("double"), d.cast("double")
    return F.when(d != 0, n / F.when(d != 0, d)).when((n == 0) | F.isnan(n), F.lit(NAN)).otherwise(F.signum(n) * F.lit(INF))


def literal_for(value: float, kind: T.DataType) -> Column:
    """A literal converted to the column's type before it is compared: 3.7 is 3 to an integer, 287.43 its float32.

    Values beyond an integer type's range are set to its end.
    """
    name = kind.simpleString()
    if name in _RANGES:
        top = 2 ** _RANGES[name]
        return F.lit(max(-top, min(top - 1, int(value)))).cast(kind)
    if name == "boolean":
        return F.lit(bool(value))
    return F.lit(float(value)).cast(kind)


def compare(c: Column, op: str, kind: T.DataType, value: float, upper: float | None = None) -> Column:
    """The eight numeric comparisons. NaN equals nothing, is neither above nor below anything, and differs from all."""
    lo = literal_for(value, kind)
    real = ~F.isnan(c) if kind.simpleString() in ("float", "double") else F.lit(True)
    if op == "ne":
        return c != lo
    if op in ("eq", "lt", "gt", "le", "ge"):
        plain = {"eq": c == lo, "lt": c < lo, "gt": c > lo, "le": c <= lo, "ge": c >= lo}[op]
        return plain & real
    hi = literal_for(upper, kind)
    if op == "range_closed":
        return (c >= lo) & (c <= hi) & real
    if op == "range_open":
        return (c > lo) & (c < hi) & real
    raise ValueError(f"unknown comparison {op}")


def float_bin(v: Column, low: Column, width: Column, bins: int) -> Column:
    """Histogram bin in float32 arithmetic: truncated and kept within the bins."""
    at = ((v - low).cast("float") / width).cast("float")
    return F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(bins - 1)).cast("int")


def keep_where(v: Column, mask: Column) -> Column:
    """The value where the mask holds, else NaN."""
    return F.when(mask, v).otherwise(F.lit(NAN).cast("double"))


def join_same(left: DataFrame, right: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """An inner join on columns in which null equals null; those of the right side are dropped."""
    other = right.select(*[F.col(c).alias(f"__{c}") if c in names else F.col(c) for c in right.columns])
    return left.join(other, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in names]).drop(*[f"__{c}" for c in names])
