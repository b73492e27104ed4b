"""Operations on columns: select, drop, rename, cast, compute."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import OperationError
from ..functions.guards import check_expression
from ..functions.types import type_of
from .base import existing, listed, needed, quoted, register


@register("select")
def select(df: DataFrame, params: dict, context=None) -> DataFrame:
    """``{columns}``, in this order."""
    return df.select(*map(quoted, existing(df, listed(needed(params, "columns")))))


@register("drop")
def drop(df: DataFrame, params: dict, context=None) -> DataFrame:
    """``{columns}``; an unknown one is an error."""
    return df.drop(*existing(df, listed(needed(params, "columns"))))


@register("rename")
def rename(df: DataFrame, params: dict, context=None) -> DataFrame:
    """``{mapping: {old: new}}``; order stays."""
    mapping = needed(params, "mapping")
    existing(df, list(mapping))
    names = [mapping.get(c, c) for c in df.columns]
    if len(set(names)) < len(names):
        raise OperationError("two columns would have the same name")
    return df.withColumnsRenamed(mapping)


@register("cast")
def cast(df: DataFrame, params: dict, context=None) -> DataFrame:
    """``{columns: {name: type}, on_error: "null" | "raise"}``; values that don't convert become null unless asked."""
    columns = needed(params, "columns")
    existing(df, list(columns))
    strict = params.get("on_error", "null") == "raise"
    return df.withColumns({c: (F.col(quoted(c)).cast if strict else F.col(quoted(c)).try_cast)(type_of(t)) for c, t in columns.items()})


@register("compute")
def compute(df: DataFrame, params: dict, context=None) -> DataFrame:
    """``{columns: [{name, expr}]}``, in sequence: later expressions see earlier columns, and a known name is replaced."""
    for item in needed(params, "columns"):
        df = df.withColumn(needed(item, "name"), F.expr(check_expression(needed(item, "expr"))))
    return df
