"""Tokenizers: functions from a text column to an array of terms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Tokenizer = Callable[[Column], Column]


def words(text: Column) -> Column:
    """Lower-cased runs between white space."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda x: x != "")


def without(tokenizer: Tokenizer, stop: frozenset[str]) -> Tokenizer:
    """Leaves stop words out."""
    return lambda text: F.filter(tokenizer(text), lambda x: ~x.isin(sorted(stop)))


def stemmed(tokenizer: Tokenizer, suffixes: tuple[str, ...] = ("ing", "ed", "es", "s")) -> Tokenizer:
    """Cuts one of the suffixes off terms that keep three characters."""
    pattern = f"^(.{{3,}}?)(?:{'|'.join(suffixes)})$"
    return lambda text: F.transform(tokenizer(text), lambda x: F.regexp_replace(x, pattern, "$1"))
