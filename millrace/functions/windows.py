"""Windows the operations need beside plain SQL text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import Window as W


def running(value: Column, by: Sequence[Column | str], order: Sequence[Column | str]) -> Column:
    """A running aggregate row by row: rows that tie in the order are not summed together, as SQL's default would."""
    return value.over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
