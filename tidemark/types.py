"""The six SQL types, their Spark types, and how literals bind to them."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import types as T

from tidemark.errors import InvalidArgument, InvalidPredicate

INT4, INT8, TEXT, BYTEA, TIMESTAMPTZ, UUID = "int4", "int8", "text", "bytea", "timestamptz", "uuid"

SPELLINGS = {
    "int": INT4, "int4": INT4, "integer": INT4, "bigint": INT8, "int8": INT8, "text": TEXT, "varchar": TEXT,
    "bytea": BYTEA, "timestamptz": TIMESTAMPTZ, "uuid": UUID,
}
SPARK = {INT4: T.IntegerType(), INT8: T.LongType(), TEXT: T.StringType(), BYTEA: T.BinaryType(), TIMESTAMPTZ: T.TimestampType(), UUID: T.StringType()}
#: Object ids and widths as the catalogue shows them; -1: varying.
OIDS = {INT4: (23, 4), INT8: (20, 8), TEXT: (25, -1), BYTEA: (17, -1), TIMESTAMPTZ: (1184, 8), UUID: (2950, 16)}
INDEXABLE = {INT4, INT8, TEXT, BYTEA}
EPOCH = dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)


@dataclass(frozen=True)
class Column:
    name: str
    type: str

    def __post_init__(self):
        if not self.name:
            raise InvalidArgument("a column needs a name")
        if self.type not in SPARK:
            raise InvalidArgument(f"unknown type {self.type!r}")

    @property
    def field(self) -> T.StructField:
        return T.StructField(self.name, SPARK[self.type], True, {"sql": self.type})


def of_field(field: T.StructField) -> str:
    """The SQL type of a Spark field; Spark types beyond the six keep Spark's name and can only be read."""
    if declared := (field.metadata or {}).get("sql"):
        return declared
    plain = {T.IntegerType: INT4, T.ShortType: INT4, T.ByteType: INT4, T.LongType: INT8, T.StringType: TEXT, T.BinaryType: BYTEA, T.TimestampType: TIMESTAMPTZ, T.TimestampNTZType: TIMESTAMPTZ}
    return plain.get(type(field.dataType), field.dataType.simpleString())


def _ranged(value: int, kind: str) -> int:
    low, high = (-(1 << 31), (1 << 31) - 1) if kind == INT4 else (-(1 << 63), (1 << 63) - 1)
    if not low <= value <= high:
        raise InvalidArgument(f"{value} is out of range for {kind}")
    return value


def bind_literal(value: int | str | None, kind: str):
    """A literal of the dialect as a value for a column: integers for the integer types and, as microseconds, for
    timestamps; strings for text and, as their UTF-8 bytes, for bytea. There are no other casts."""
    if value is None:
        return None
    if isinstance(value, int) and not isinstance(value, bool):
        if kind in (INT4, INT8):
            return _ranged(value, kind)
        if kind == TIMESTAMPTZ:
            return EPOCH + dt.timedelta(microseconds=_ranged(value, INT8))
    if isinstance(value, str):
        if kind == TEXT:
            return value
        if kind == BYTEA:
            return value.encode()
    raise InvalidArgument(f"{value!r} is no {kind}")


def bind_comparison(value: int | str | None, kind: str):
    """A literal to compare a column with; null and types without an order in the dialect are errors."""
    if value is None:
        raise InvalidPredicate("a comparison with NULL is never true; it is refused")
    if kind in (BYTEA, UUID):
        raise InvalidPredicate(f"{kind} can't be compared in a statement; use the typed API")
    if kind in SPARK:
        try:
            return bind_literal(value, kind)
        except InvalidArgument as e:
            raise InvalidPredicate(str(e)) from e
    if kind in ("double", "float") and isinstance(value, int):
        return value
    raise InvalidPredicate(f"{value!r} can't be compared with {kind}")


def check_value(value, kind: str):
    """A typed value for a column of a table, or an error."""
    good = {
        INT4: lambda v: isinstance(v, int) and not isinstance(v, bool) and _ranged(v, INT4) == v,
        INT8: lambda v: isinstance(v, int) and not isinstance(v, bool) and _ranged(v, INT8) == v,
        TEXT: lambda v: isinstance(v, str),
        BYTEA: lambda v: isinstance(v, (bytes, bytearray)),
        TIMESTAMPTZ: lambda v: isinstance(v, dt.datetime) and v.tzinfo is not None,
        UUID: lambda v: isinstance(v, uuid.UUID),
    }[kind]
    if value is None:
        return None
    if not good(value):
        raise InvalidArgument(f"{value!r} is no {kind}")
    return str(value) if kind == UUID else bytes(value) if kind == BYTEA else value
