"""What user-written expressions and queries may hold."""

from __future__ import annotations

import json
import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import DataFrame, SparkSession

from .errors import OperationError

_REFLECTION = re.compile(r"\b(?:try_)?(?:reflect|java_method)\s*\(", re.IGNORECASE)
_FORBIDDEN_IN_EXPRESSION = re.compile(r";|--|/\*", re.IGNORECASE)
_SUB_QUERY = re.compile(r"\.(?:\w*Subquery\w*|ListQuery|Exists|UnresolvedRelation)\"")
_FORBIDDEN_IN_QUERY = re.compile(r";|--|/\*|global_temp|\b(?:read_files|read_parquet|read_csv|parquet_scan|range_scan|identifier)\s*\(", re.IGNORECASE)


def without_literals(text: str) -> str:
    """The text with string literals emptied and quoted names kept, so that words inside strings don't count."""
    return re.sub(r"'(?:[^'\\]|\\.|'')*'", "''", text)


def check_expression(text: str) -> str:
    """An expression over columns; sub-queries, readers and calls into the JVM are refused.

    The text is parsed, and the tree looked through for sub-queries: words like ``from`` are fine inside functions.
    """
    if not isinstance(text, str) or not text.strip():
        raise OperationError("an expression is empty")
    bare = without_literals(text)
    if found := _FORBIDDEN_IN_EXPRESSION.search(bare) or _REFLECTION.search(bare):
        raise OperationError(f"{found[0].strip()!r} isn't allowed in an expression")
    try:
        tree = SparkSession.getActiveSession()._jsparkSession.sessionState().sqlParser().parseExpression(text).toJSON()
    except ParseException as e:
        raise OperationError(f"the expression is invalid: {str(e).strip().splitlines()[0]}") from e
    if _SUB_QUERY.search(tree):
        raise OperationError("a sub-query isn't allowed in an expression")
    return text


def _each(found) -> list:
    return [found.apply(i) for i in range(found.size())]


def _refuse_others(plan, own: set[str]) -> None:
    """Everything that an analysed plan reads must be one of the views ``own``, or constants.

    A view of ours is not looked into, whatever it holds; any other view is refused whatever it holds, and so is any other relation, also
    one that the input reads itself. Sub-queries are looked through where they stand.
    """
    if plan.nodeName() == "View":
        if plan.desc().identifier().table() in own:
            return
        raise OperationError("only self and input can be read in a query")
    below = _each(plan.children())
    if not below and plan.nodeName() not in ("OneRowRelation", "LocalRelation", "Range", "CTERelationRef"):
        raise OperationError("only self and input can be read in a query")
    for part in (*below, *_each(plan.subqueries())):
        _refuse_others(part, own)


def run_isolated(df: DataFrame, query: str) -> DataFrame:
    """The result of a query in which the input is ``self`` and ``input`` and nothing else can be read.

    The query is parsed alone first (one statement, balanced), then resolved as a sub-query, which refuses definitions and changes,
    in a session whose only views are those two and that doesn't read files by path; then the resolved plan is looked through.
    """
    if not isinstance(query, str) or not query.strip():
        raise OperationError("the query is empty")
    bare = without_literals(query)
    if found := _FORBIDDEN_IN_QUERY.search(bare) or _REFLECTION.search(bare):
        raise OperationError(f"{found[0].strip()!r} isn't allowed in a query")
    if not re.search(r"\b(?:self|input)\b", bare, re.IGNORECASE):
        raise OperationError("the query must read self or input")
    spark = df.sparkSession
    import uuid

    shared, own = f"input_{uuid.uuid4().hex}", {"self", "input"}
    try:
        spark._jsparkSession.sessionState().sqlParser().parsePlan(query)
        alone: SparkSession = spark.newSession()
        for key in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions", "spark.sql.ansi.enabled"):
            alone.conf.set(key, spark.conf.get(key))
        alone.conf.set("spark.sql.runSQLOnFiles", "false")
        df.createGlobalTempView(shared)
        for name in ("self", "input"):
            alone.table(f"global_temp.{shared}").createOrReplaceTempView(name)
        result = alone.sql(f"SELECT * FROM (\n{query}\n)")
        _refuse_others(result._jdf.queryExecution().analyzed(), own)
        if "CallMethodViaReflection" in json.dumps(json.loads(result._jdf.queryExecution().analyzed().toJSON())):
            raise OperationError("calls into the JVM aren't allowed in a query")
        return result
    except (AnalysisException, ParseException) as e:
        raise OperationError(f"the query is invalid: {str(e).splitlines()[0]}") from e
    finally:
        spark.catalog.dropGlobalTempView(shared)
