"""Typed values and scores as Columns."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Halves go up, also below zero: -2.5 becomes -2."""
    return F.floor(x + F.lit(0.5))


def number(value: Column, kind: str) -> Column:
    """int, long: rounded; float, double: kept; date: milliseconds. What isn't a finite number is null."""
    if kind == "date":
        return F.unix_millis(F.try_to_timestamp(value.cast("string")))
    x = value.try_cast("double")
    x = F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)
    return half_up(x) if kind in ("int", "long") else x


def boolean(value: Column) -> Column:
    """true, 1, "true", "1"; false, 0, "false", "0"; else null."""
    text = value.cast("string")
    return F.when(text.isin("true", "1"), F.lit(True)).when(text.isin("false", "0"), F.lit(False))


def boolean_code(value: Column) -> Column:
    """2, 1, 0 for true, false, null."""
    return F.when(value, F.lit(2)).when(~value, F.lit(1)).otherwise(F.lit(0))


def range_value(value, kind: str):
    """A bound as it is stored: dates as milliseconds."""
    if value is None or value == "":
        return None
    if kind == "date" and isinstance(value, str):
        text = value.replace("Z", "+00:00")
        at = datetime.fromisoformat(text)
        at = at if at.tzinfo else at.replace(tzinfo=timezone.utc)
        return int(at.timestamp() * 1000)
    return value


def saturate(x: Column, k1: float) -> Column:
    return F.lit(k1 + 1) * x / (F.lit(k1) + x)


def score_int(score: Column) -> Column:
    return F.greatest(F.lit(1), half_up(score * F.lit(1000.0))).cast("long")


def idf(df: Column, n: int) -> Column:
    return F.log(F.lit(1.0) + (F.lit(float(n)) - df + F.lit(0.5)) / (df + F.lit(0.5)))


def impact(score: Column, df: Column, n: int) -> Column:
    return F.greatest(F.lit(1), half_up(score * idf(df, n) / F.lit(10.0))).cast("long")


def shard_key(term: Column, depth: int) -> Column:
    return F.rpad(F.substring(F.coalesce(term, F.lit("")), 1, depth), depth, "_")


def values_of(column: Column, kind: str) -> Column:
    """A facet's values as an array of strings; null and "" have none."""
    if kind.startswith("array"):
        return F.filter(F.coalesce(column, F.array()).cast("array<string>"), lambda x: x.isNotNull() & (x != ""))
    text = column.cast("string")
    return F.when(text.isNotNull() & (text != ""), F.array(text)).otherwise(F.array().cast("array<string>"))


def text_of(column: Column, kind: str) -> Column:
    """A text field's value: arrays joined by spaces, null as ""."""
    if kind.startswith("array"):
        column = F.array_join(column.cast("array<string>"), " ")
    return F.coalesce(column.cast("string"), F.lit(""))
