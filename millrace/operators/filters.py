"""The filter operation: one predicate a step."""

from __future__ import annotations

from datetime import date, datetime, time
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.errors import OperationError
from .base import existing, needed, quoted, register

_COMPARE = {"eq": "__eq__", "==": "__eq__", "ne": "__ne__", "!=": "__ne__", "gt": "__gt__", ">": "__gt__", "ge": "__ge__", ">=": "__ge__", "lt": "__lt__", "<": "__lt__", "le": "__le__", "<=": "__le__"}
OPERATORS = [*_COMPARE, "in", "not_in", "between", "contains", "starts_with", "ends_with", "is_null", "is_not_null"]


def typed(value: Any, kind: T.DataType) -> Any:
    """An ISO string as the date or timestamp that a column of this type needs; other values as they are."""
    if not isinstance(value, str):
        return value
    try:
        if isinstance(kind, T.DateType):
            return date.fromisoformat(value)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return datetime.fromisoformat(value)
        if kind.typeName() == "time":
            return time.fromisoformat(value)
    except ValueError:
        raise OperationError(f"{value!r} isn't in ISO format (2024-01-31 or 2024-01-31T12:00:00)") from None
    return value


def predicate(df: DataFrame, name: str, operator: str, value: Any) -> Column:
    """The condition; a comparison with null is null, so the row goes."""
    column, kind = F.col(quoted(name)), df.schema[name].dataType

    def literal(v: Any) -> Column:
        if isinstance(v, Column):
            return v
        v = typed(v, kind)
        return F.lit(v).cast(kind) if isinstance(v, (date, datetime)) else F.lit(v)

    if operator in ("is_null", "is_not_null"):
        return column.isNull() if operator == "is_null" else column.isNotNull()
    if value is None:
        raise OperationError("parameter 'value' is missing")
    if operator in _COMPARE:
        return getattr(column, _COMPARE[operator])(literal(value))
    if operator in ("in", "not_in"):
        if isinstance(value, (str, bytes)) or not hasattr(value, "__iter__"):
            raise OperationError(f"{operator} needs a list")
        found = column.isin(*map(literal, value)) if len(value) else F.lit(False)
        return found if operator == "in" else ~found
    if operator == "between":
        if not hasattr(value, "__len__") or len(value) != 2:
            raise OperationError("between needs two values")
        return column.between(literal(value[0]), literal(value[1]))
    text = column.cast("string")
    if operator == "contains":
        return F.contains(text, value if isinstance(value, Column) else F.lit(str(value)))
    if operator == "matches":
        return text.rlike(str(value))
    if operator in ("starts_with", "ends_with"):
        return getattr(text, operator.replace("_", ""))(value if isinstance(value, Column) else F.lit(str(value)))
    raise OperationError(f"unknown operator {operator!r}; known: {', '.join(OPERATORS)}")


@register("filter")
def filter_rows(df: DataFrame, params: dict, context=None) -> DataFrame:
    """``{column, operator = "eq", value, regex = false}``; ``contains`` is literal unless ``regex`` is set."""
    (name,) = existing(df, [needed(params, "column")])
    operator = params.get("operator") or "eq"
    if operator == "contains" and params.get("regex"):
        operator = "matches"
    return df.filter(predicate(df, name, operator, params.get("value")))
