"""group_by, pivot, unpivot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.errors import OperationError
from ..functions.storage import stored
from ..functions.types import common_type
from .base import existing, fresh, listed, needed, quoted, register

_FUNCTIONS = {
    "sum": F.sum, "mean": F.avg, "avg": F.avg, "min": F.min, "max": F.max, "count": F.count, "median": F.median,
    "std": F.stddev_samp, "var": F.var_samp, "n_unique": F.count_distinct, "first": F.first, "last": F.last,
}


def aggregate(name: str, func: str, order_by: str | None = None, approximate: bool = False, count_nulls: bool = False) -> Column:
    """One aggregate of a column.

    ``approximate`` replaces exact medians and distinct counts by sketches of fixed size. ``first`` and ``last`` follow
    ``order_by``; without it they're arbitrary. ``count_nulls`` makes ``n_unique`` count null as a value.
    """
    column = F.col(quoted(name))
    if func not in _FUNCTIONS:
        raise OperationError(f"unknown function {func!r}; known: {', '.join(_FUNCTIONS)}")
    if func in ("first", "last") and order_by:
        pick = F.min_by if func == "first" else F.max_by
        return pick(F.struct(column.alias("v")), F.struct(F.col(quoted(order_by)), column))["v"]
    if func == "median" and approximate:
        return F.percentile_approx(column, 0.5)
    if func == "n_unique":
        found = F.approx_count_distinct(column) if approximate else F.count_distinct(column)
        return found + F.max(column.isNull().cast("long")) if count_nulls else found
    return _FUNCTIONS[func](column)


def ranked_medians(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """``by`` and ``m0, m1, ...``: exact medians of the columns, for groups of any size.

    A sketch of fixed size per group gives two values with the median between them: its ranks are at most 1e-4 of the rows wrong, the
    values lie 4e-4 to each side. Then each group's rows are counted before the shuffle: one count for those below, one for those
    above, and one for each value between. Only these few are sorted, to find the values at the middle ranks. The bounds are stored.
    """
    keys = [f"k{i}" for i in range(len(by))]
    values = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), (F.col(quoted(c)).cast("double") + 0.0).alias("v")) for i, c in enumerate(columns)))).alias("e")
    rows = df.select(*(F.col(quoted(c)).alias(k) for c, k in zip(by, keys, strict=True)), values).select(*keys, "e.i", "e.v").filter("v IS NOT NULL")
    group, endless = [*keys, "i"], F.lit(float("inf"))  # NaN comes after it and is in no sketch
    around = rows.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.percentile_approx(F.when(F.isnan("v"), endless).otherwise(F.col("v")), [0.4996, 0.5004], 10_000).alias("b"))
    around = stored(around)  # so that Spark knows how few groups there are, and doesn't move all rows to them
    sides = around.select(*(F.col(k).alias(f"{k}_") for k in group), "n", F.col("b")[0].alias("low"), F.col("b")[1].alias("high"))
    met = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"{k}_")) for k in group))
    side = F.when(F.col("v") < F.col("low"), -1).when((F.col("v") > F.col("high")) & (F.col("high") < endless), 1).otherwise(0)
    placed = rows.join(sides, met).select(*group, "n", side.alias("side"), F.when(side == 0, F.col("v")).alias("v"))
    counted = placed.groupBy(*group, "n", "side", "v").agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*group).orderBy("side", "v").rowsBetween(Window.unboundedPreceding, 0))
    at = {"a": F.floor((F.col("n") - 1) / 2), "b": F.floor(F.col("n") / 2)}
    held = {k: (F.col("upto") > r) & (F.col("upto") - F.col("c") <= r) for k, r in at.items()}
    value = F.when(F.col("side") == 0, F.col("v")).otherwise(F.raise_error(F.lit("a median lies outside the bounds of its sketch")).cast("double"))
    found = counted.withColumn("upto", upto).groupBy(*group).agg(*(F.max(F.when(h, value)).alias(k) for k, h in held.items()))
    middle = F.col("a") * 0.5 + F.col("b") * 0.5
    return found.groupBy(*keys).agg(*(F.max(F.when(F.col("i") == i, middle)).alias(f"m{i}") for i in range(len(columns))))


@register("group_by")
def group_by(df: DataFrame, params: dict, context=None) -> DataFrame:
    """``{by, aggregations: [{column, func = "sum", alias?}]}``; the default alias is ``column_func``.

    A table of more than ``median_rows`` rows (a query that stops there finds out) gets its exact medians by ``ranked_medians``; in
    smaller ones they are Spark's, which holds a group's values in memory. The results are the same.
    """
    by = existing(df, listed(needed(params, "by")))
    most = context.median_rows if context else 1_000_000
    made, ranked = [], {}
    for i, a in enumerate(needed(params, "aggregations")):
        (column,) = existing(df, [needed(a, "column")])
        func, options = a.get("func") or "sum", {k: a[k] for k in ("order_by", "approximate", "count_nulls") if k in a}
        made.append((aggregate(column, func, **options), a.get("alias") or f"{column}_{func}"))
        if func == "median" and not options.get("approximate") and isinstance(df.schema[column].dataType, T.NumericType):
            ranked[i] = column
    if not ranked or df.limit(most + 1).count() <= most:
        return df.groupBy(*map(quoted, by)).agg(*(c.alias(alias) for c, alias in made))
    columns = list(dict.fromkeys(ranked.values()))
    medians = ranked_medians(df, by, columns)
    named = df.select(*(F.col(quoted(c)).alias(f"g{i}") for i, c in enumerate(by)), *map(quoted, df.columns))
    groups, others = named.groupBy(*(f"g{i}" for i in range(len(by)))), [c.alias(f"a{i}") for i, (c, _) in enumerate(made) if i not in ranked]
    whole = groups.agg(*others or [F.count(F.lit(1)).alias("rows")])
    met = reduce(lambda a, b: a & b, (whole[f"g{i}"].eqNullSafe(medians[f"k{i}"]) for i in range(len(by))))
    value = lambda i: medians[f"m{columns.index(ranked[i])}"] if i in ranked else whole[f"a{i}"]
    return whole.join(medians, met, "left").select(*(whole[f"g{i}"].alias(c) for i, c in enumerate(by)), *(value(i).alias(alias) for i, (_, alias) in enumerate(made)))


@register("pivot")
def pivot(df: DataFrame, params: dict, context=None) -> DataFrame:
    """``{index, on, values, func = "sum"}``: groups become rows, values of ``on`` become columns, sorted.

    Several ``on`` columns are joined by ``_``. A missing cell is null, 0 for counts. A null in ``on`` makes no column, but its
    index row stays. More than ``pivot_limit`` columns are an error, found by a query that stops there.
    """
    index, on = existing(df, listed(needed(params, "index"))), existing(df, listed(needed(params, "on")))
    (value,) = existing(df, [needed(params, "values")])
    func = params.get("func") or "sum"
    most = context.pivot_limit if context else 500
    parts = [F.col(quoted(c)).cast("string") for c in on]
    header = reduce(lambda a, b: a & b, (p.isNotNull() for p in parts))
    made = fresh(df, "_on")
    keyed = df.withColumn(made, F.when(header, F.concat_ws("_", *parts)))
    names = sorted(r[0] for r in keyed.select(made).filter(F.col(made).isNotNull()).distinct().limit(most + 1).collect())
    if len(names) > most:
        raise OperationError(f"the pivot would have more than {most} columns")
    if both := [n for n in names if n in index]:
        raise OperationError(f"the pivot's column {both[0]!r} is an index column as well")
    cell = aggregate(value, func)
    if func == "median":  # of groups of any size; then there is one value in each cell
        middle = fresh(keyed, "_median")
        keyed = group_by(keyed, {"by": [*index, made], "aggregations": [{"column": value, "func": func, "alias": middle}]}, context)
        cell = F.first(middle)
    out = keyed.groupBy(*map(quoted, index)).pivot(made, names).agg(cell) if names else df.select(*map(quoted, index)).distinct()
    return out.withColumns({n: F.coalesce(F.col(quoted(n)), F.lit(0)) for n in names}) if func in ("count", "n_unique") and names else out


@register("unpivot")
def unpivot(df: DataFrame, params: dict, context=None) -> DataFrame:
    """``{index?, on?, variable_name = "variable", value_name = "value"}``; nulls stay, mixed types become their common type."""
    index = existing(df, listed(params.get("index") or []))
    on = existing(df, listed(params.get("on") or [])) or [c for c in df.columns if c not in index]
    if not on:
        raise OperationError("there is no column to unpivot")
    try:
        kind = reduce(common_type, (df.schema[c].dataType for c in on))
    except OperationError:
        kind = T.StringType()
    values = [F.col(quoted(c)).cast(kind).alias(c) for c in on]
    return df.select(*map(quoted, index), *values).unpivot(list(map(quoted, index)), list(map(quoted, on)), params.get("variable_name") or "variable", params.get("value_name") or "value")
