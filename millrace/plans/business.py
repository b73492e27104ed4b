"""Margins, shares over time and values valid at a date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import stored
from ..functions.types import common_type
from ..operators.base import quoted


def valid_at(facts: DataFrame, ranges: DataFrame, key: str, at: str, start: str = "valid_from", end: str | None = "valid_to") -> DataFrame:
    """Facts with the row of ``ranges`` valid at their time: ``start <= at <= end``, a null end being open.

    Without ``end``, a range ends where the key's next one begins (``as_of``). With it, ranges may overlap, and a fact meets each that
    is valid: an equality join on the key with the rest as a condition; where they don't, ``as_of`` with ``end`` gives the same
    without pairing a key's facts with all its ranges. Facts without a valid row stay, with nulls.
    """
    if end is None:
        return as_of(facts, ranges, key, at, start)
    r = ranges.withColumnsRenamed({c: f"_r_{c}" for c in ranges.columns})
    within = (F.col(f"_r_{start}") <= F.col(at)) & (F.col(f"_r_{end}").isNull() | (F.col(at) <= F.col(f"_r_{end}")))
    met = facts.join(r, (F.col(key) == F.col(f"_r_{key}")) & within, "left")
    return met.select(*facts.columns, *(F.col(f"_r_{c}").alias(c) for c in ranges.columns if c != key))


def as_of(
    facts: DataFrame, ranges: DataFrame, key: str, at: str, start: str = "valid_from", end: str | None = None, slice_rows: int = 1_000_000, sizes: DataFrame | None = None
) -> DataFrame:
    """Facts with the row of ``ranges`` that began last before or at their time; with ``end``, only if that one isn't over by then.

    A merge: facts and ranges in one table, sorted by key and time, the last range carried forward. A key of more than
    ``slice_rows`` rows is cut into slices of time at its quantiles, each sorted by itself; the last range of the slices before
    is passed on to it (one row for each slice). Work is linear in facts and ranges, however many of them a key has. ``sizes`` is a
    table with at least as many rows of each key as the facts, if there is one that is cheaper to count.

    Facts with a null key or time, or before the first range, stay, with nulls. Ranges with a null key or start are never met. Of ranges that
    begin at the same time the greatest row counts. Repeated facts stay.
    """
    kept = [c for c in ranges.columns if c != key]
    when = common_type(facts.schema[at].dataType, ranges.schema[start].dataType)
    name = lambda c: F.col(quoted(c))
    # facts' columns stay columns, so that those nobody reads aren't shuffled
    alike = facts.schema[key].dataType == ranges.schema[key].dataType
    own = {c: f"f{i}" for i, c in enumerate(facts.columns) if not (alike and c == key)}
    row = F.struct(*map(name, kept)).alias("row")
    met_by = ranges.filter(name(key).isNotNull() & name(start).isNotNull())
    no_row = F.lit(None).cast(ranges.select(row).schema[0].dataType).alias("row")
    rows = facts.select(name(key).alias("key"), name(at).cast(when).alias("time"), F.lit(True).alias("fact"), no_row, *(name(c).alias(f) for c, f in own.items()))
    rows = rows.unionByName(met_by.select(
        name(key).alias("key"), name(start).cast(when).alias("time"), F.lit(False).alias("fact"), row, *(F.lit(None).cast(facts.schema[c].dataType).alias(f) for c, f in own.items())))
    # counts and quantiles are summed up before the shuffle; only keys beyond slice_rows are left, one row each
    counted = rows if sizes is None else sizes.select(name(key).alias("key")).union(met_by.select(name(key)))
    counts = counted.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > slice_rows)
    if counts.isEmpty():
        placed, before = rows.withColumn("slice", F.lit(0)), None
    else:
        large = stored(counts.withColumn("parts", F.least(F.ceil(F.col("n") / slice_rows), F.lit(1000)).cast("int")))
        thousandths = F.percentile_approx("time", [i / 1000 for i in range(1, 1000)], 10_000)
        cuts = stored(rows.join(large, "key").groupBy("key").agg(thousandths.alias("all"), F.first("parts").alias("parts")))
        # as many of the thousandths as the key needs slices, evenly
        cuts = cuts.select("key", F.expr("array_distinct(transform(sequence(1, parts - 1), i -> all[cast(i * 1000 / parts as int) - 1]))").alias("cuts"))
        plain = [f for c, f in own.items() if isinstance(facts.schema[c].dataType, T.AtomicType)]
        spread = F.when(F.col("key").isNull(), F.pmod(F.xxhash64("time", *plain), F.lit(1000)).cast("int"))  # they meet nothing, so any slice does
        placed = rows.join(cuts, "key", "left").withColumn("slice", F.coalesce(spread, _cuts_before("cuts", "time"), F.lit(0))).drop("cuts")
        last = placed.join(cuts.select("key"), "key", "left_semi").groupBy("key", "slice").agg(F.max(F.when(F.col("row").isNotNull(), F.struct("time", "row"))).alias("last"))
        carried = F.last("last", ignorenulls=True).over(W.partitionBy("key").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
        before = stored(last.select("key", "slice", carried["row"].alias("carried")))
    order = W.partitionBy("key", "slice").orderBy("time", "fact", "row").rowsBetween(W.unboundedPreceding, W.currentRow)
    found = placed.withColumn("met", F.last("row", ignorenulls=True).over(order)).filter("fact")
    if before is not None:
        found = found.join(before, ["key", "slice"], "left").withColumn("met", F.coalesce("met", "carried"))
    # facts without a time are sorted first, but where a slice passes a range on they'd have it too
    valid = F.col("time").isNotNull() if end is None else F.col("time").isNotNull() & F.coalesce(F.col("met").getField(end) >= F.col("time"), F.lit(True))
    found = found.withColumn("met", F.when(valid, F.col("met")))
    return found.select(*(F.col(own.get(c, "key")).alias(c) for c in facts.columns), *(F.col("met").getField(c).alias(c) for c in kept))


def _cuts_before(cuts: str, time: str) -> Column:
    """How many of at most 1023 sorted cuts are less than the time, by binary search; null if one of both is."""
    def further(found: Column, step: Column) -> Column:
        at = found["at"] + step
        less = (at <= F.size(found["cuts"])) & (F.get(found["cuts"], at - 1) < found["time"])
        return F.struct(F.when(less, at).otherwise(found["at"]).alias("at"), found["cuts"].alias("cuts"), found["time"].alias("time"))

    # the state holds what is compared: columns named only inside a lambda are lost to Spark when it infers filters across joins
    state = F.struct(F.lit(0).alias("at"), F.col(cuts).alias("cuts"), F.col(time).alias("time"))
    searched = F.aggregate(F.array(*(F.lit(1 << i) for i in reversed(range(10)))), state, further, lambda found: found["at"])
    return F.when(F.col(cuts).isNotNull() & F.col(time).isNotNull(), searched)


def line_margin(lines: DataFrame, quantity: Column, price: Column, discount: Column, unit_cost: Column, line_cost: Column) -> DataFrame:
    """Revenue, production cost, commercial cost and margin of each line."""
    return lines.withColumns({"revenue": quantity * price * (1 - discount), "production": quantity * unit_cost, "commercial": line_cost}).withColumn(
        "margin", F.col("revenue") - F.col("production") - F.col("commercial")
    )


def share(df: DataFrame, period: Column, by: str, value: Column) -> DataFrame:
    """``(period, by, value, share)``: each group's part of its period."""
    sums = df.groupBy(period.alias("period"), by).agg(F.sum(value).alias("value"))
    return sums.withColumn("share", F.col("value") / F.sum("value").over(W.partitionBy("period")))


def status_rates(df: DataFrame, period: Column, by: str, status: str, values: list[str]) -> DataFrame:
    """``(period, by, n, rate_<value>...)``: the share of each status in a group and period."""
    return df.groupBy(period.alias("period"), by).agg(F.count("*").alias("n"), *((F.count(F.when(F.col(status) == v, 1)) / F.count("*")).alias(f"rate_{v}") for v in values))


def network(people: DataFrame, levels: tuple[str, ...] = ("agent", "inspector", "head")) -> DataFrame:
    """``(agent, inspector, head)``: each of ``people(id, manager_id)`` with those above, as many as ``levels`` has names.

    A self-join a level; who has nobody above at a level has null there. 0 stands for nobody, like null.
    """
    above = people.select(F.col("id").alias("_id"), F.nullif(F.col("manager_id"), F.lit(0)).alias("_up"))
    out = people.select(F.col("id").alias(levels[0]), F.nullif(F.col("manager_id"), F.lit(0)).alias("_next"))
    for level in levels[1:]:
        out = out.withColumnRenamed("_next", level).join(above, F.col(level) == F.col("_id"), "left").drop("_id").withColumnRenamed("_up", "_next")
    return out.drop("_next")
