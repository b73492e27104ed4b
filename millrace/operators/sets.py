"""The union operation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import OperationError
from ..functions.types import common_type
from .base import needed, quoted, register


def relaxed(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both, columns matched by name; a missing one is null, types are brought to a common one, duplicates stay."""
    kinds = {f.name: f.dataType for f in left.schema}
    for f in right.schema:
        kinds[f.name] = common_type(kinds[f.name], f.dataType) if f.name in kinds else f.dataType

    def shaped(df: DataFrame) -> DataFrame:
        return df.select(*((F.col(quoted(n)) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in kinds.items()))

    return shaped(left).union(shaped(right))


def strict(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of both; names and types must agree."""
    of = lambda df: [(f.name, f.dataType.simpleString()) for f in df.schema]
    if of(left) != of(right):
        raise OperationError("a strict union needs the same columns and types in the same order")
    return left.union(right)


@register("union")
def union(df: DataFrame, params: dict, context=None) -> DataFrame:
    """``{right: source or list of sources, strategy = "relaxed" | "strict"}``; sources may be sub-flows."""
    how = {"relaxed": relaxed, "strict": strict}.get(params.get("strategy") or "relaxed")
    if how is None:
        raise OperationError(f"unknown strategy {params['strategy']!r}; known: relaxed, strict")
    others = needed(params, "right")
    return reduce(how, map(context.source, others if isinstance(others, list) else [others]), df)
