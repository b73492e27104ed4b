"""Joins of a table's rows with items that each ask for a range of one column's values, without a nested loop.

The items' bounds, or a sample of them if they are many, cut the values into bands. A row lies in one band, an item is repeated for
each band that its range touches, and the join is one of equal bands. Only pairs in bands where a range begins or ends are formed
in vain; the conditions themselves are still to be applied.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.errors import OperationError
from .base import fresh, quoted


def orderable(value: Column, kind: T.DataType) -> Column | None:
    """The value as something that compares alike and comes back from the driver unchanged; None if there is no such thing."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(value)
    return value if isinstance(kind, (T.NumericType, T.DateType)) or kind == T.StringType() else None


def band(value: Column, edges: list[Column]) -> Column:
    """How many of the sorted edges are at most the value, by binary search."""
    if not edges:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(edges).bit_length()))]
    every = F.array(*edges)

    def further(found: Column, step: Column) -> Column:
        at = found["at"] + step
        return F.struct(F.when((at <= len(edges)) & (F.get(every, at - 1) <= found["v"]), at).otherwise(found["at"]).alias("at"), found["v"].alias("v"))

    # the value goes along in the state: columns named only inside a lambda are lost to Spark when it infers filters across the join
    return F.aggregate(F.array(*map(F.lit, steps)), F.struct(F.lit(0).alias("at"), value.alias("v")), further, lambda found: found["at"])


def band_join(df: DataFrame, items: DataFrame, name: str, kind: T.DataType, lower: list[Column], upper: list[Column], most_bands: int = 4095, most_pairs: int = 0, most_sent: int = 100_000) -> DataFrame:
    """All columns of both, in at least those pairs whose value of ``name`` lies from every ``lower`` to every ``upper`` bound.

    Bounds are columns of ``items`` of type ``kind``, in which values are compared; without upper (lower) bounds ranges are open.
    Null values and items with a null bound meet nothing; the same row or item twice is joined twice. At most ``most_bands`` bounds
    come to the driver as edges, chosen by hash. A value that many rows share makes one large band, which Spark splits when it
    joins. With ``most_pairs`` above 0 the pairs are counted first, band by band, and more of them are refused. Items that are more than
    ``most_sent`` when repeated for their bands are merged with the rows, never broadcast; at most 10 000 are always sent to all tasks.
    """
    low, high, at = fresh(df, "_low"), fresh(df, "_high"), fresh(df, "_band")
    key = orderable(F.col(quoted(name)).cast(kind), kind)
    ends = {low: F.greatest(*lower) if len(lower) > 1 else (lower or [None])[0], high: F.least(*upper) if len(upper) > 1 else (upper or [None])[0]}
    ends = {k: orderable(v, kind) for k, v in ends.items() if v is not None}
    whole = items
    for bound in (*lower, *upper):
        whole = whole.filter(bound.isNotNull())
    whole = whole.withColumns(ends)
    bounds = whole.select(F.explode(F.array(*map(F.col, ends))).alias("v"))
    typed = bounds.schema["v"].dataType
    literal = lambda v: F.lit(v).cast(typed)
    least, most = bounds.agg(F.min("v"), F.max("v")).first()
    edges = [r["v"] for r in bounds.distinct().orderBy(F.xxhash64("v"), "v").limit(most_bands).orderBy("v").collect()]
    edges = [literal(v) for v in edges]
    first = band(F.col(low), edges) if low in ends else F.lit(0)
    last = band(F.col(high), edges) if high in ends else F.lit(len(edges))
    touched = whole.withColumns({low: first, high: last}).filter(F.col(low) <= F.col(high)).withColumn(at, F.explode(F.sequence(low, high))).drop(low, high)
    within = df.filter(key.isNotNull())
    if low in ends:
        within = within.filter(key >= literal(least))
    if high in ends:
        within = within.filter(key <= literal(most))
    placed = within.withColumn(at, band(key, edges))
    if most_pairs > 0:
        a, b = placed.groupBy(at).agg(F.count(F.lit(1)).alias("a")), touched.groupBy(at).agg(F.count(F.lit(1)).alias("b"))
        pairs = a.join(b, at).agg(F.sum(F.col("a").cast("decimal(38,0)") * F.col("b"))).first()[0]
        if (pairs or 0) > most_pairs:
            raise OperationError(f"the loop would pair rows and items {pairs} times, more than {most_pairs}")
    # an item in many bands is more than Spark makes of the items' files: only few are left to be sent to all tasks
    n = touched.limit(most_sent + 1).count()
    return placed.join(touched.hint("broadcast") if n <= 10_000 else touched if n <= most_sent else touched.hint("merge"), at).drop(at)
