"""Metadata filter expressions and the row predicates every reader applies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

COMPARISONS = ("$eq", "$ne", "$gt", "$gte", "$lt", "$lte", "$in", "$nin")
MAX_HOURS = 744


class FilterError(ValueError):
    """The filter expression is malformed."""


def validate_where(where: Mapping[str, Any] | None) -> None:
    """Refuse malformed filters before any plan exists."""
    if where is None:
        return
    if not isinstance(where, Mapping) or len(where) != 1:
        raise FilterError("a filter level holds exactly one condition; combine several with $and / $or")
    (key, operand), = where.items()
    if key in ("$and", "$or"):
        if not isinstance(operand, (list, tuple)) or len(operand) < 2:
            raise FilterError(f"{key} needs a list of at least two conditions")
        for part in operand:
            validate_where(part)
    elif key.startswith("$"):
        raise FilterError(f"unknown logical operator {key}")
    elif isinstance(operand, Mapping):
        if len(operand) != 1:
            raise FilterError(f"{key}: one operator per condition")
        (op, value), = operand.items()
        if op not in COMPARISONS:
            raise FilterError(f"{key}: operator {op} is not supported on scalar metadata")
        if op in ("$in", "$nin") and not isinstance(value, (list, tuple)):
            raise FilterError(f"{key}: {op} needs a list")
    elif operand is None:
        raise FilterError(f"{key}: cannot filter by a missing value")
    elif not isinstance(operand, (str, int, float, bool)):
        raise FilterError(f"{key}: unsupported value type {type(operand).__name__}")


def _kind(data_type: T.DataType) -> str:
    if isinstance(data_type, T.BooleanType | T.NumericType):
        return "number"
    return "string" if isinstance(data_type, T.StringType) else "other"


def _comparable(schema: T.StructType, key: str, value: Any) -> bool:
    kind = "string" if isinstance(value, str) else "number"
    return key in schema.names and _kind(schema[key].dataType) == kind


def _literal(schema: T.StructType, key: str, value: Any) -> Column:
    if isinstance(schema[key].dataType, T.BooleanType) and not isinstance(value, bool):
        return F.lit(value == 1) if value in (0, 1) else F.lit(None).cast("boolean")
    return F.lit(int(value)) if isinstance(value, bool) and _kind(schema[key].dataType) == "number" and not isinstance(
        schema[key].dataType, T.BooleanType
    ) else F.lit(value)


def _compare(schema: T.StructType, key: str, op: str, value: Any) -> Column:
    if op in ("$ne", "$nin"):
        return ~_compare(schema, key, "$eq" if op == "$ne" else "$in", value)
    if op == "$in":
        usable = [v for v in value if v is not None and _comparable(schema, key, v)]
        if not usable:
            return F.lit(False)
        return F.coalesce(F.col(key).isin([_literal(schema, key, v) for v in usable]), F.lit(False))
    if value is None or not _comparable(schema, key, value):
        return F.lit(False)
    left, right = F.col(key), _literal(schema, key, value)
    result = {
        "$eq": left == right, "$gt": left > right, "$gte": left >= right, "$lt": left < right, "$lte": left <= right
    }[op]
    return F.coalesce(result, F.lit(False))


def where_to_column(where: Mapping[str, Any] | None, schema: T.StructType) -> Column:
    """Filter expression as a predicate; it is plain Column algebra, so it reaches the scan.

    A missing value satisfies ``$ne`` and ``$nin`` and nothing else; comparing unlike types is false.
    """
    validate_where(where)
    if where is None:
        return F.lit(True)
    (key, operand), = where.items()
    if key in ("$and", "$or"):
        parts = [where_to_column(part, schema) for part in operand]
        return reduce(lambda a, b: a & b if key == "$and" else a | b, parts)
    if isinstance(operand, Mapping):
        (op, value), = operand.items()
        return _compare(schema, key, op, value)
    return _compare(schema, key, "$eq", operand)


def last_hours(df: DataFrame, ts: str, hours: int, now: str) -> DataFrame:
    """Rows of the last ``hours`` (1 to 744) before ``now``; ``now`` is an argument so results repeat."""
    return df.filter(F.col(ts) >= window_start(hours, now))


def window_start(hours: int, now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz") - F.make_interval(hours=F.lit(clamp_hours(hours)))


def clamp_hours(hours: int) -> int:
    return min(max(int(hours), 1), MAX_HOURS)


def search_name(df: DataFrame, cols: Sequence[str], keyword: str | None) -> DataFrame:
    """Rows whose name or description contains the keyword; blank keywords keep every row."""
    if not keyword or not keyword.strip():
        return df
    return df.filter(reduce(lambda a, b: a | b, [F.coalesce(F.col(c).contains(keyword.strip()), F.lit(False)) for c in cols]))


def live(df: DataFrame) -> DataFrame:
    return df.filter(F.col("deleted_at").isNull())


def active_kbs(df: DataFrame) -> DataFrame:
    return live(df).filter("is_active")
