"""The join operation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.errors import OperationError
from .base import existing, listed, needed, quoted, register

KINDS = ("inner", "left", "right", "full", "semi", "anti", "cross")
#: The most rows of a cross join if the context gives no limit.
CROSSED = 50_000_000


def check_cross(left: DataFrame, right: DataFrame, most: int) -> None:
    """A cross join of too many rows is refused before it runs; 0 or less switches the check off."""
    if most > 0 and (a := left.count()) * (b := right.count()) > most:
        raise OperationError(f"the cross join would have {a} x {b} rows, more than {most}")


def suffixed(name: str, taken: set[str]) -> str:
    """The name, with ``_right`` as often as it takes to be new."""
    while name in taken:
        name += "_right"
    return name


def equi_join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], how: str) -> DataFrame:
    """Joined on equal keys; null keys never match.

    Right columns whose names the left has get the suffix ``_right``. Keys with the same names appear once (coalesced in right
    and full joins); keys with different names both stay. Semi and anti joins have left columns only.
    """
    same = left_on == right_on
    taken = set(left.columns)
    renamed, names = [], {}
    for c in right.columns:
        new = c
        if same and c in right_on:
            new = f"_key_{c}"
        elif c in taken:
            new = suffixed(f"{c}_right", taken | set(right.columns))
            taken.add(new)
        names[c] = new
        renamed.append(F.col(quoted(c)).alias(new))
    other = right.select(*renamed)
    match = reduce(lambda a, b: a & b, (left[quoted(a)] == other[quoted(names[b])] for a, b in zip(left_on, right_on, strict=True)))
    if how in ("semi", "anti"):
        return left.join(other, match, f"left_{how}")
    joined = left.join(other, match, how)
    if not same:
        return joined
    keys = {c: F.coalesce(F.col(quoted(c)), F.col(quoted(f"_key_{c}"))) if how in ("right", "full") else F.col(quoted(c)) for c in left_on}
    rest = [F.col(quoted(names[c])) for c in right.columns if c not in right_on]
    return joined.select(*(keys[c].alias(c) if c in keys else F.col(quoted(c)) for c in left.columns), *rest)


@register("join")
def join(df: DataFrame, params: dict, context=None) -> DataFrame:
    """``{right, on | left_on + right_on, how = "inner", hint?}``; ``right`` may be a sub-flow. Spark picks the algorithm."""
    how = params.get("how") or "inner"
    if how not in KINDS:
        raise OperationError(f"unknown kind of join {how!r}; known: {', '.join(KINDS)}")
    right = context.source(needed(params, "right"))
    if hint := params.get("hint"):
        right = right.hint(hint)
    if how == "cross":
        check_cross(df, right, CROSSED if context.cross_join_limit is None else context.cross_join_limit)
        taken, names = set(df.columns), []
        for c in right.columns:
            names.append(suffixed(f"{c}_right", taken | set(right.columns)) if c in taken else c)
            taken.add(names[-1])
        return df.crossJoin(right.select(*(F.col(quoted(c)).alias(n) for c, n in zip(right.columns, names, strict=True))))
    if params.get("on"):
        left_on = right_on = listed(params["on"])
    else:
        left_on, right_on = listed(needed(params, "left_on")), listed(needed(params, "right_on"))
    if len(left_on) != len(right_on):
        raise OperationError("left_on and right_on differ in length")
    existing(df, left_on), existing(right, right_on)
    return equi_join(df, right, left_on, right_on, how)
