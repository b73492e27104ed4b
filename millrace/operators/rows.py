"""Operations on rows: sort, limit, unique, fill_null, drop_nulls."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.errors import OperationError
from .base import existing, fresh, listed, needed, quoted, register


def ordering(df: DataFrame, by, descending=False) -> list[Column]:
    """Sort keys with nulls last, whichever the direction."""
    names = existing(df, listed(by))
    down = list(descending) if isinstance(descending, (list, tuple)) else [bool(descending)] * len(names)
    if len(down) != len(names):
        raise OperationError("descending needs one value for each column")
    return [F.col(quoted(n)).desc_nulls_last() if d else F.col(quoted(n)).asc_nulls_last() for n, d in zip(names, down, strict=True)]


@register("sort")
def sort(df: DataFrame, params: dict, context=None) -> DataFrame:
    """``{by, descending = false}``; nulls last."""
    return df.orderBy(*ordering(df, needed(params, "by"), params.get("descending", False)))


@register("limit")
def limit(df: DataFrame, params: dict, context=None) -> DataFrame:
    """``{n}``."""
    n = params.get("n")
    if not isinstance(n, int) or isinstance(n, bool) or n < 0:
        raise OperationError("n must be a whole number")
    return df.limit(n)


@register("unique")
def unique(df: DataFrame, params: dict, context=None) -> DataFrame:
    """``{subset?, keep = "any" | "first" | "last" | "none", order_by?, descending?}``.

    ``first`` and ``last`` need ``order_by``, with all columns as tie-break; ``none`` drops every row whose key repeats.
    """
    subset, keep = params.get("subset"), params.get("keep") or "any"
    names = existing(df, listed(subset)) if subset else df.columns
    if keep == "any":
        return df.dropDuplicates(names) if subset else df.distinct()
    by = [quoted(c) for c in names]
    n = fresh(df, "_n")
    if keep == "none":
        # counted before the shuffle: a key that most rows share is one row of each task
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias(n), F.first(F.struct(*map(quoted, df.columns))).alias(row := fresh(df, "_row"))).filter(F.col(n) == 1).select(f"{row}.*")
    if keep not in ("first", "last"):
        raise OperationError(f"unknown keep {keep!r}; known: any, first, last, none")
    order = needed(params, "order_by")
    down = params.get("descending", False)
    flip = [not d for d in (down if isinstance(down, list) else [down] * len(listed(order)))]
    keys = ordering(df, order, flip if keep == "last" else down) + ordering(df, df.columns)
    return df.withColumn(n, F.row_number().over(W.partitionBy(*by).orderBy(*keys))).filter(F.col(n) == 1).drop(n)


@register("fill_null")
def fill_null(df: DataFrame, params: dict, context=None) -> DataFrame:
    """``{columns: {name: value}}`` or ``{value}`` for all columns of a matching type."""
    if columns := params.get("columns"):
        existing(df, list(columns))
        return df.withColumns({c: F.coalesce(F.col(quoted(c)), v if isinstance(v, Column) else F.lit(v).cast(df.schema[c].dataType)) for c, v in columns.items()})
    value = needed(params, "value")
    kinds = T.BooleanType if isinstance(value, bool) else T.NumericType if isinstance(value, (int, float)) else T.StringType
    own = [f.name for f in df.schema if isinstance(f.dataType, kinds)]
    return df.withColumns({c: F.coalesce(F.col(quoted(c)), F.lit(value).cast(df.schema[c].dataType)) for c in own}) if own else df


@register("drop_nulls")
def drop_nulls(df: DataFrame, params: dict, context=None) -> DataFrame:
    """``{subset?}``; a null in any of the columns (default: all) drops the row."""
    names = existing(df, listed(params["subset"])) if params.get("subset") else df.columns
    return df.filter(reduce(lambda a, b: a & b, (F.col(quoted(n)).isNotNull() for n in names)))
