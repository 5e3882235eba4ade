"""Catalog tables: filters, sorting, paging. Filters become one conjunction, so they reach the Parquet scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import compare


@dataclass(frozen=True)
class Filter:
    """A filter of one column. Numeric operators: eq ne lt gt le ge range_closed range_open; text: contains."""

    column: str
    op: str
    value: object
    upper: float | None = None
    ignore_case: bool = False


def predicate(df: DataFrame, f: Filter) -> Column | None:
    """The filter's condition; None if the column is missing or its kind does not suit the operator (it is then skipped)."""
    if f.column not in df.columns:
        return None
    kind = df.schema[f.column].dataType
    c = F.col(f.column)
    if f.op == "contains":
        if kind.simpleString() != "string":
            return None
        if f.ignore_case:
            return F.contains(F.lower(c), F.lit(str(f.value).lower()))
        return F.contains(c, F.lit(str(f.value)))
    if kind.simpleString() not in ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean"):
        return None
    return compare(c, f.op, kind, f.value, f.upper)


def _all(df: DataFrame, filters: list[Filter]) -> Column:
    out = F.lit(True)
    for f in filters:
        p = predicate(df, f)
        if p is not None:
            out = out & F.coalesce(p, F.lit(False))
    return out


def select_rows(df: DataFrame, filters: list[Filter]) -> DataFrame:
    """Rows that pass all filters."""
    return df.where(_all(df, filters))


def inverted(df: DataFrame, filters: list[Filter]) -> DataFrame:
    """Rows that the filters leave out."""
    return df.where(~_all(df, filters))


def combined(df: DataFrame, first: list[Filter], second: list[Filter]) -> DataFrame:
    """Union of two selections of one table: each row once."""
    return df.where(_all(df, first) | _all(df, second))


def ordered(df: DataFrame, column: str, descending: bool = False, row_id: str = "row_id") -> DataFrame:
    """Sorted by one column, NaN and null last either way, ties by row id; text by code point."""
    kind = df.schema[column].dataType.simpleString()
    if kind not in ("string", "tinyint", "smallint", "int", "bigint", "float", "double", "boolean"):
        raise ValueError(f"column {column} of type {kind} cannot be sorted")
    c = F.col(column)
    keys = [F.isnan(c).asc()] if kind in ("float", "double") else []
    keys.insert(0, c.isNull().asc())
    return df.orderBy(*keys, c.desc() if descending else c.asc(), F.col(row_id).asc())


def page(df: DataFrame, start: int = -1, end: int = -1) -> DataFrame:
    """Rows [start, end) of an ordered table; negative: from the first, to the last. Past the end: no rows."""
    start = max(start, 0)
    df = df.offset(start) if start else df
    return df.limit(max(end - start, 0)) if end >= 0 else df


def preview(df: DataFrame, rows: int = 50, row_id: str = "row_id") -> DataFrame:
    return df.orderBy(row_id).limit(rows)


def project(df: DataFrame, columns: list[int]) -> DataFrame:
    """Columns by index, those out of range left out."""
    return df.select([df.columns[i] for i in columns if 0 <= i < len(df.columns)])


def with_row_id(df: DataFrame, key: str) -> DataFrame:
    """The natural key as row id."""
    return df.withColumn("row_id", F.col(key).cast("long"))


def pages(df: DataFrame, rows: int = 100_000):
    """The ordered table as an iterator of lists of rows, with the share done so far; read partition by partition."""
    total, part, sent = df.count(), [], 0
    for r in df.toLocalIterator(prefetchPartitions=True):
        part.append(r)
        if len(part) == rows:
            sent += len(part)
            yield part, sent / total
            part = []
    if part or not sent:
        yield part, 1.0


def restored(df: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The table in its own order again."""
    return df.orderBy(row_id)


def page_numbers(df: DataFrame, rows: int, row_id: str = "row_id") -> DataFrame:
    """Adds page and place, both from 0, of every row in the order of a dense row_id that starts at 0."""
    return df.withColumns({"page": F.floor(F.col(row_id) / rows), "place": F.col(row_id) % rows})
