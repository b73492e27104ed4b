"""The sql operation."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.guards import run_isolated
from .base import needed, register


@register("sql")
def sql(df: DataFrame, params: dict, context=None) -> DataFrame:
    """``{query}`` over ``self`` (or ``input``); resolved at once, so that errors show before anything runs."""
    return run_isolated(df, needed(params, "query"))
