"""From statements to DataFrames. Conditions become plain column comparisons, so that they reach the Parquet scan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import types
from tidemark.errors import InvalidPredicate
from tidemark.plans.sqlparse import Condition, Select

#: Column of a row's id; its order is the order of a scan.
TID = "_tid"


@dataclass(frozen=True)
class Predicate:
    """A typed condition: column, one of = < >, and a value of the column's type."""

    column: str
    sign: str
    value: object


def field_of(df: DataFrame, name: str):
    """The first column of that name, whatever its case."""
    for field in df.schema:
        if field.name.lower() == name.lower():
            return field
    raise InvalidPredicate(f"no column {name!r}")


def comparison(df: DataFrame, name: str, sign: str, value) -> Column:
    if sign not in ("=", "<", ">"):
        raise InvalidPredicate(f"unknown comparison {sign!r}")
    field = field_of(df, name)
    column, literal = F.col(f"`{field.name}`"), F.lit(value)
    if field.dataType.typeName() == "timestamp_ntz":
        literal = F.to_timestamp_ntz(F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")))  # read as UTC; a constant, so it is folded
    return {"=": column == literal, "<": column < literal, ">": column > literal}[sign]


def condition(df: DataFrame, where: Condition) -> Column:
    """A condition of the dialect, its literal bound to the column's type."""
    field = field_of(df, where.column)
    return comparison(df, where.column, where.sign, types.bind_comparison(where.value, types.of_field(field)))


def predicate(df: DataFrame, where: Predicate) -> Column:
    """A typed condition; a value of another type is refused rather than never matched."""
    kind = types.of_field(field_of(df, where.column))
    if where.value is None:
        raise InvalidPredicate("a comparison with null is never true; it is refused")
    try:
        value = types.check_value(where.value, kind) if kind in types.SPARK else where.value
    except types.InvalidArgument as e:
        raise InvalidPredicate(str(e)) from e
    return comparison(df, where.column, where.sign, value)


def filtered(df: DataFrame, where: Condition | Predicate | None) -> DataFrame:
    if where is None:
        return df
    return df.filter(condition(df, where) if isinstance(where, Condition) else predicate(df, where))


def visible(df: DataFrame) -> list[str]:
    """The table's own columns."""
    return [c for c in df.columns if not c.startswith("_")]


def picked(df: DataFrame, columns: tuple[str, ...] | None) -> list[Column]:
    if columns is None:
        return [F.col(f"`{c}`") for c in visible(df)]
    known = df.select(*[F.col(f"`{c}`") for c in visible(df)])
    return [F.col(f"`{field_of(known, c).name}`").alias(c) for c in columns]


def select(df: DataFrame, statement: Select, ordered: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows in order and cut, with all columns; the same projected).

    Nulls sort lowest and ties keep the scan's order. A limit makes this one top-k, which keeps ``limit`` rows per task;
    ``ordered``: whether a statement without an order and limit promises the scan's order too."""
    rows = filtered(df, statement.where)
    names = picked(df, statement.columns)  # unknown columns are errors before anything runs
    if TID not in rows.columns:
        rows = rows.withColumn(TID, F.monotonically_increasing_id())
    keys = []
    if statement.order:
        key = F.col(f"`{field_of(df.select(*visible(df)), statement.order[0]).name}`")
        keys = [key.desc_nulls_last() if statement.order[1] else key.asc_nulls_first()]
    if keys or statement.limit is not None or ordered:
        rows = rows.orderBy(*keys, F.col(TID).asc())
    if statement.limit is not None:
        rows = rows.limit(statement.limit)
    return rows, rows.select(*names)
