"""What operations refuse, previews, exports, and sources beside files: queries whose result is an outcome, over whole tables."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.errors import OperationError
from ..functions.storage import work_folder
from ..operators import apply
from ..plans import history, preview, reuse
from ..sources import files, jdbc, sinks
from ..streaming import jobs
from . import context, query, step, table


def outcomes(name: str, source: str, cases: dict[str, list[dict]], refused: dict[str, str], limits: dict | None = None) -> None:
    """A query ``(case, refused, n)``: for each case the word that its refusal must name (empty if it's allowed), and the rows of the
    table, or, where it's allowed, of the result."""
    allowed = [c for c in cases if c not in refused]
    if set(refused) - set(cases):
        raise ValueError("a case is unknown")
    text = lambda x: "'" + x.replace("'", "''") + "'"
    lines = [f'SELECT {text(c)} AS "case", {text(refused.get(c, ""))} AS refused, count(*) AS n FROM {source}' for c in cases]

    def run(s: SparkSession, d: str) -> DataFrame:
        found = None
        for case, steps in cases.items():
            where = context(s, d)
            for k, v in (limits or {}).items():
                setattr(where, k, v)
            rows, word = table(s, d, source), ""
            try:
                rows = apply(rows, steps, where)
            except OperationError as e:
                word = refused.get(case, "?") if refused.get(case, "?") in str(e) else str(e)
            one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(case).alias("case"), F.lit(word).alias("refused"), "n")
            found = one if found is None else found.union(one)
        return found

    assert allowed or refused
    query(name, " UNION ALL ".join(lines))(run)


def _computed(expression: str) -> list[dict]:
    return [step("compute", columns=[{"name": "x", "expr": expression}])]


outcomes("refused_expressions", "nation", {
    "sub-query": _computed("(select max(n_nationkey) from nation)"), "exists": _computed("exists (select 1)"), "in": _computed("n_nationkey in (select 1)"),
    "two statements": _computed("1; select 2"), "reflection": _computed("reflect('java.lang.Math', 'abs', 1)"), "not SQL": _computed("1 +"),
    "trim": _computed("trim(both 'A' from n_name)"), "substring": _computed("substring(n_name from 2)"), "extract": _computed("extract(year from date'2024-01-01')"),
    "lambda": _computed("exists(array(1), v -> v = n_nationkey)"), "word in text": _computed("'select from'"),
}, {"sub-query": "sub-query", "exists": "sub-query", "in": "sub-query", "two statements": "';'", "reflection": "reflect", "not SQL": "invalid"})
outcomes("refused_pivots", "orders", {
    "too wide": [step("pivot", index="o_orderstatus", on="o_orderkey", values="o_totalprice")], "no index": [step("pivot", index=[], on="o_orderstatus", values="o_totalprice")],
    "no header": [step("pivot", index="o_orderstatus", on=[], values="o_totalprice")], "bad function": [step("pivot", index="o_orderpriority", on="o_orderstatus", values="o_totalprice", func="mode")],
}, {"too wide": "more than 500", "no index": "'index'", "no header": "'on'", "bad function": "'mode'"})
outcomes("refused_joins", "nation", {
    "unknown kind": [step("join", right="region", how="outer", on="n_name")], "unknown source": [step("join", right="secrets", on="n_name")], "unknown column": [step("join", right="region", on="n_name")],
    "too many rows": [step("join", right="nation", how="cross")], "left": [step("join", right="region", how="left", left_on="n_regionkey", right_on="r_regionkey")],
}, {"unknown kind": "inner, left, right, full, semi, anti, cross", "unknown source": "'secrets'", "unknown column": "'n_name'", "too many rows": "more than 600"}, {"cross_join_limit": 600})
outcomes("refused_unions", "nation", {
    "unknown strategy": [step("union", right="nation", strategy="loose")], "strict": [step("union", right="region", strategy="strict")],
}, {"unknown strategy": "relaxed, strict", "strict": "strict union"})
outcomes("refused_loops", "nation", {
    "data choose right": [step("foreach", items=[{"x": "region"}], body=[step("union", right="{{x}}")])], "data choose source": [step("foreach", items=[{"x": "region"}], body=[step("union", right={"source": "{{ x }}"})])],
    "data choose driver": [step("foreach", items=[{"x": "region"}], body=[step("foreach", driver="{{x}}", body=[step("limit", n=1)])])], "data choose path": [step("foreach", items=[{"x": "/a"}], body=[step("union", right=[{"path": "{{x}}"}])])],
    "too many passes": [step("foreach", items=[{"x": i} for i in range(6)], body=[step("limit", n=1)])], "too many in all": [step("foreach", items=[{"x": i} for i in range(4)], body=[step("foreach", items=[{"y": i} for i in range(4)], body=[step("limit", n=1)])])],
    "no items": [step("foreach", items=[], body=[step("limit", n=1)])], "no body": [step("foreach", items=[{"x": 1}], body=[])], "which pass": [step("foreach", items=[{"x": "n_name"}, {"x": "no"}], body=[step("sort", by="{{x}}")])],
}, {"data choose right": "chosen by data", "data choose source": "chosen by data", "data choose driver": "chosen by data", "data choose path": "chosen by data", "too many passes": "more than 5 passes",
    "too many in all": "more than 12 passes", "no items": "'items'", "no body": "'body'", "which pass": "iteration 2/2"}, {"loop_limit": 5, "loop_total": 12})
outcomes("error_position", "nation", {
    "third step": [step("limit", n=5), step("drop", columns=["n_regionkey"]), step("filter", column="gone", value=1)], "unknown type": [step("limit", n=5), {"type": "explode", "params": {}}], "Spark's own": [step("limit", n=5), *_computed("no_such + 1")],
}, {"third step": "3", "unknown type": "unknown operation", "Spark's own": "no_such"})


def _over(kind: str, value: str, *more: dict) -> list[dict]:
    return [step("foreach", items=[{"x": v} for v in value.split()], body=[*more, step("filter", column="c_custkey", operator=kind, value="{{x}}")])]


_TOP = step("group_by", by=["c_custkey"], aggregations=[{"column": "c_acctbal", "func": "max", "alias": "top"}])
outcomes("refused_cross_loops", "customer", {
    "all pairs": _over("lt", "1 2 3"), "text that is no number": _over("lt", "10.5"), "pairs behind a group": [step("foreach", items=[{"x": i} for i in range(3)], body=[_TOP, step("filter", column="top", operator="gt", value="{{x}}")])],
    "no pairs": [step("foreach", items=[{"x": 0}], body=[step("compute", columns=[{"name": "zero", "expr": "c_custkey - c_custkey"}]), step("filter", column="zero", operator="eq", value="{{x}}")])],
}, {"all pairs": "cross join", "text that is no number": "10.5", "pairs behind a group": "cross join"}, {"cross_join_limit": 100})


@query("dotted_names", "SELECT n_regionkey AS region, count(*) AS n, count(*) FILTER (n_nationkey % 2 = 0) AS even, sum(n_nationkey)::BIGINT AS keys FROM nation WHERE n_nationkey % 5 > 0 GROUP BY 1")
def _(s: SparkSession, d: str) -> DataFrame:
    """A table whose names have dots, through operations that name columns."""
    odd = table(s, d, "nation").select(
        F.when(F.col("n_nationkey") % 5 > 0, F.col("n_nationkey")).alias("key.of"), F.col("n_regionkey").alias("re.gion"), F.when(F.col("n_nationkey") % 2 == 0, "1.5").alias("_on"), F.col("n_name").alias("na`me")
    )
    steps = [
        step("drop_nulls", subset=["key.of"]), step("fill_null", columns={"_on": "2.5"}), step("fill_null", value="-"), step("unique", subset=["key.of"]), step("sort", by=["na`me"]), step("rename", mapping={"na`me": "na.me"}),
        step("compute", columns=[{"name": "one.more", "expr": "`key.of` * 1"}]), step("pivot", index=["re.gion", "key.of"], on=["_on"], values="na.me", func="count"), step("filter", column="key.of", operator="ge", value=0),
    ]
    wide = apply(odd, steps, context(s, d))
    return wide.groupBy(F.col("`re.gion`").alias("region")).agg(F.sum(F.col("`1.5`") + F.col("`2.5`")).alias("n"), F.sum("`1.5`").alias("even"), F.sum("`key.of`").alias("keys"))


@query("partitioned_versions", "SELECT o_orderstatus AS _n, o_orderpriority AS _file, o_orderkey + 9 AS k, 0 AS failed FROM orders")
def _(s: SparkSession, d: str) -> DataFrame:
    """Ten rewrites of a partitioned dataset while another thread reads it over and over: each read finds one whole version."""
    folder, stop, seen = work_folder(s), threading.Event(), []
    rows = table(s, d, "orders").select(F.col("o_orderstatus").alias("_n"), F.col("o_orderpriority").alias("_file"), F.col("o_orderkey").alias("k"))
    n, low = rows.agg(F.count(F.lit(1)), F.min("k")).first()
    sinks.write_snapshot(rows, folder, 4, ["_n"])

    def read() -> None:
        while not stop.is_set():
            try:
                found = sinks.read_snapshot(s, folder).agg(F.count(F.lit(1)), F.min("k")).first()
                seen.append(found[0] == n and 0 <= found[1] - low <= 9)
            except Exception:  # noqa: BLE001  what a reader mustn't see, whatever it is
                seen.append(False)

    reader = threading.Thread(target=read)
    reader.start()
    for k in range(1, 10):
        sinks.write_snapshot(rows.withColumn("k", F.col("k") + k), folder, 4, ["_n"])
    try:  # one that fails changes nothing
        sinks.write_snapshot(rows.withColumn("k", F.when(F.col("k") > low, F.raise_error(F.lit("broken")).cast("long")).otherwise(0)), folder, 4, ["_n"])
        seen.append(False)
    except PySparkException:
        pass
    stop.set()
    reader.join()
    return sinks.read_snapshot(s, folder).withColumn("failed", F.lit(seen.count(False) if seen else -1))


@query("stream_again", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(s: SparkSession, d: str) -> DataFrame:
    """A stream drained twice with the same checkpoint: the second call finds what the first has committed."""
    checkpoint, rows = work_folder(s), table(s, d, "events")
    rows.write.parquet(f"{checkpoint}-in")
    for _ in range(2):
        out = jobs.drained(s.readStream.schema(rows.schema).parquet(f"{checkpoint}-in").select("event_type"), "again", checkpoint)
    return out.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("refused_queries", "SELECT * FROM (VALUES ('other database', 'only self'), ('catalog table', 'only self'), ('own table', 'only self'), ('identifier', 'allowed'), ('file', 'invalid'), ('definition', 'invalid'), ('nothing read', 'must read'), ('plain', '')) t(\"case\", refused), (SELECT count(*) AS n FROM nation)")
def _(s: SparkSession, d: str) -> DataFrame:
    db = f"other_{uuid.uuid4().hex[:8]}"
    path = f"{d}/region.parquet"
    s.sql(f"CREATE DATABASE {db}")
    try:
        s.sql(f"CREATE TABLE {db}.secret USING parquet LOCATION '{path}'")
        s.sql(f"CREATE TABLE {db}.own USING parquet LOCATION '{d}/nation.parquet'")
        cases = {
            "own table": f"select * from self union all select * from {db}.own", "identifier": "select self.* from self, identifier('global' || '_temp.secret')",
            "other database": f"select self.* from self cross join {db}.secret", "catalog table": f"select self.* from self where exists (select 1 from {db}.secret)", "file": f"select self.* from self, parquet.`{path}`",
            "definition": "create table x as select * from self", "nothing read": "select 1", "plain": "with t as (select * from self) select t.* from t join (values (1)) v(x)",
        }
        words = {"own table": "only self", "identifier": "allowed", "other database": "only self", "catalog table": "only self", "file": "invalid", "definition": "invalid", "nothing read": "must read"}
        found = None
        for case, text in cases.items():
            rows, word = table(s, d, "nation"), ""
            try:
                rows = apply(rows, [step("sql", query=text)], context(s, d))
            except OperationError as e:
                word = words.get(case, "?") if words.get(case, "?") in str(e) else str(e)
            one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(case).alias("case"), F.lit(word).alias("refused"), "n")
            found = one if found is None else found.union(one)
        return found
    finally:
        for name in ("secret", "own"):
            s.sql(f"DROP TABLE IF EXISTS {db}.{name}")
        s.sql(f"DROP DATABASE {db}")


@query("loop_mixed_types", """SELECT 'ge' AS op, n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey >= 10.5 UNION ALL SELECT 'lt', n_nationkey FROM nation WHERE n_nationkey < 10.5
UNION ALL SELECT 'eq', n_nationkey FROM nation WHERE n_nationkey = 10.5 UNION ALL SELECT 'eq 9', n_nationkey FROM nation WHERE n_nationkey = 9 UNION ALL SELECT 'ge', n_nationkey FROM nation WHERE n_nationkey >= 23.5""")
def _(s: SparkSession, d: str) -> DataFrame:
    rows, where = table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("k")), context(s, d)
    cases = [("ge", "ge", [10.5, 23.5]), ("lt", "lt", [10.5]), ("eq", "eq", [10.5]), ("eq 9", "eq", ["9"])]
    found = None
    for name, operator, values in cases:
        one = apply(rows, [step("foreach", items=[{"q": v} for v in values], body=[step("filter", column="k", operator=operator, value="{{q}}")])], where).select(F.lit(name).alias("op"), "k")
        found = one if found is None else found.union(one)
    return found


@query("reuse_sources", "SELECT 'whole' AS \"case\", count(*) AS n FROM nation UNION ALL SELECT 'filtered', count(*) FROM nation WHERE n_nationkey < 3 UNION ALL SELECT 'join', count(*) FROM nation UNION ALL SELECT 'join of less', count(*) FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 'made', 3")
def _(s: SparkSession, d: str) -> DataFrame:
    folder, nation, region = work_folder(s), table(s, d, "nation"), table(s, d, "region")
    plain, joined = [step("sort", by="n_name")], [step("join", right="other", left_on="n_regionkey", right_on="r_regionkey")]
    cases = [("whole", nation, plain, None), ("filtered", nation.filter("n_nationkey < 3"), plain, None), ("join", nation, joined, region), ("join of less", nation, joined, region.filter("r_regionkey = 1")), ("made", s.range(3).selectExpr("id AS n_name"), plain, None)]
    found = None
    for name, rows, steps, other in cases:
        where = context(s, d)
        where.sources = {**where.sources, "other": other}
        one = reuse.apply_reusing(rows, steps, folder, where).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("case"), "n")
        found = one if found is None else found.union(one)
    return found


@query("cross_names", "SELECT a.n_nationkey AS k, b.r_regionkey AS k_right, b.r_regionkey AS k_right_right FROM nation a, region b")
def _(s: SparkSession, d: str) -> DataFrame:
    left = table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.lit(0).alias("k_right"))
    right = table(s, d, "region").select(F.col("r_regionkey").alias("k"))
    return apply(left, [step("join", right=right, how="cross")], context(s, d)).select("k", F.col("k_right_right").alias("k_right"), "k_right_right")


_ODD = """p_name || '"q", ' || chr(10) || 'x' AS odd"""


_TYPED = "SELECT p_partkey, '00' || p_size AS code, CASE WHEN p_partkey % 2 = 0 THEN 'y' ELSE 'n' END AS flag, p_size || 'd' AS suffixed, '2024-0' || (1 + p_size % 9) AS month"
_TYPED += ", p_partkey || '01234567890123456789' AS many, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS whole, CAST(p_size AS DOUBLE) / 4 AS quarter, p_size > 20 AS large FROM part"


@query("csv_types", _TYPED)
def _(s: SparkSession, d: str) -> DataFrame:
    """Codes, flags, months and long numbers stay text; numbers and booleans become such."""
    folder = work_folder(s)
    table(s, d, "part").createOrReplaceTempView(name := f"part_{uuid.uuid4().hex}")
    sinks.write_csv(s.sql(_TYPED.replace("FROM part", f"FROM {name}")), f"{folder}/typed.csv")
    s.catalog.dropTempView(name)
    return files.read_any(s, f"{folder}/typed.csv")


@query("csv_ragged", "SELECT 'longer' AS \"case\", 'has 3 fields' AS refused, 0 AS n UNION ALL SELECT 'shorter', '', count(*) FROM part UNION ALL SELECT 'bytes', 'UTF-8', 0")
def _(s: SparkSession, d: str) -> DataFrame:
    """Lines with more fields than the header and bytes that aren't UTF-8 fail the read; missing fields are null."""
    folder, part = work_folder(s), table(s, d, "part").select("p_partkey", "p_name")
    last = part.agg(F.max("p_partkey")).first()[0]
    line = F.concat_ws(",", "p_partkey", F.lit("x"))
    cases = {
        "longer": F.when(F.col("p_partkey") == last, F.concat(line, F.lit(",more"))).otherwise(line),
        "shorter": F.when(F.col("p_partkey") == last, F.col("p_partkey").cast("string")).otherwise(line),
        "bytes": F.when(F.col("p_partkey") == last, F.concat(line.cast("binary"), F.unhex(F.lit("E9"))).cast("string")).otherwise(line),
    }
    out = []
    for case, said in cases.items():
        part.select(said.alias("k,v")).write.option("emptyValue", "").text(f"{folder}/{case}.csv")
        n, word = 0, ""
        try:
            n = files.read_csv(s, f"{folder}/{case}.csv", has_header=False).filter("column_1 IS NOT NULL").count()
        except (OperationError, PySparkException) as e:
            word = next((w for w in ("has 3 fields", "UTF-8") if w in str(e)), str(e))
        out.append((case, word, n))
    return s.createDataFrame(out, "case string, refused string, n long")


@query("csv_quotes", f"SELECT p_partkey, {_ODD}, CASE WHEN p_partkey = (SELECT max(p_partkey) FROM part) THEN 'late' ELSE CAST(p_size AS VARCHAR) END AS mixed FROM part")
def _(s: SparkSession, d: str) -> DataFrame:
    folder, rows = work_folder(s), table(s, d, "part")
    last = rows.agg(F.max("p_partkey").alias("last"))
    odd = F.concat("p_name", F.lit('"q", \nx'))
    made = rows.crossJoin(last).select("p_partkey", odd.alias("odd"), F.when(F.col("p_partkey") == F.col("last"), "late").otherwise(F.col("p_size").cast("string")).alias("mixed"))
    sinks.write_csv(made, f"{folder}/odd.csv")
    return files.read_any(s, f"{folder}/odd.csv")


@query("json_array", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name FROM nation")
def _(s: SparkSession, d: str) -> DataFrame:
    folder = work_folder(s)
    arrays = table(s, d, "nation").groupBy("n_regionkey").agg(F.to_json(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("value"))
    arrays.write.partitionBy("n_regionkey").text(f"{folder}/nations.json")
    return files.read_any(s, f"{folder}/nations.json").select("n_nationkey", "n_name")


@query("normalised", "SELECT count(*) AS written, count(*) AS read, 5 AS columns FROM customer")
def _(s: SparkSession, d: str) -> DataFrame:
    folder = work_folder(s)
    rows, columns = files.normalise(table(s, d, "customer"), folder)
    return files.read_parquet(s, folder).agg(F.count(F.lit(1)).alias("read")).select(F.lit(rows).cast("long").alias("written"), "read", F.lit(len(columns)).alias("columns"))


def _database() -> jdbc.Connection:
    return jdbc.Connection("derby", database=f"memory:m{uuid.uuid4().hex[:8]}")


@query("jdbc_table", "SELECT c_custkey, c_name, c_nationkey FROM customer")
def _(s: SparkSession, d: str) -> DataFrame:
    where, rows = _database(), table(s, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    jdbc.write_table(rows, where, "customer")
    return jdbc.read_table(s, where, "customer", ("c_custkey", 1, rows.count(), 4))


@query("jdbc_refused", "SELECT 'two columns of a name' AS \"case\", 'aliases' AS refused, count(*) AS n FROM nation UNION ALL SELECT 'empty', 'empty', count(*) FROM nation UNION ALL SELECT 'table name', 'bad table name', count(*) FROM nation")
def _(s: SparkSession, d: str) -> DataFrame:
    where, rows = _database(), table(s, d, "nation")
    jdbc.write_table(rows, where, "nation")
    cases: dict[str, tuple[str, Callable]] = {
        "two columns of a name": ("aliases", lambda: jdbc.read_query(s, where, 'SELECT "n_name" AS "x", "n_regionkey" AS "X" FROM "nation"')),
        "empty": ("empty", lambda: jdbc.read_query(s, where, " ; ")), "table name": ("bad table name", lambda: jdbc.read_table(s, where, 'a"b')),
    }
    found = None
    for case, (word, read) in cases.items():
        try:
            said = str(read().columns)
        except OperationError as e:
            said = word if word in str(e) else str(e)
        one = jdbc.read_table(s, where, "nation").agg(F.count(F.lit(1)).alias("n")).select(F.lit(case).alias("case"), F.lit(said).alias("refused"), "n")
        found = one if found is None else found.union(one)
    return found


@query("jdbc_snapshot", "SELECT count(*) AS written, count(*) AS read, sum(s_suppkey)::BIGINT AS keys FROM supplier")
def _(s: SparkSession, d: str) -> DataFrame:
    where, folder = _database(), work_folder(s)
    jdbc.write_table(table(s, d, "supplier").select("s_suppkey", "s_name"), where, "supplier")
    rows, _ = jdbc.snapshot(jdbc.read_table(s, where, "supplier"), folder)
    return s.read.parquet(folder).agg(F.lit(rows).cast("long").alias("written"), F.count(F.lit(1)).alias("read"), F.sum("s_suppkey").alias("keys"))


@query("jdbc_types_post_sql", "SELECT o_orderkey, round(o_totalprice * 2, 2) AS o_totalprice, o_custkey % 2 = 0 AS even, o_orderdate::DATE AS day FROM orders WHERE o_orderstatus <> 'P'")
def _(s: SparkSession, d: str) -> DataFrame:
    where = _database()
    rows = table(s, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_custkey") % 2 == 0).alias("even"), F.to_date("o_orderdate").alias("day"), F.substring("o_orderstatus", 1, 1).alias("status"))
    jdbc.write_table(rows, where, "orders", mode="replace", post_sql='UPDATE "orders" SET "o_totalprice" = "o_totalprice" * 2; DELETE FROM "orders" WHERE CAST("status" AS VARCHAR(1)) = \'P\'')
    return jdbc.read_table(s, where, "orders").select("o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"), "even", "day")


@query("preview_rows", "SELECT n_nationkey, n_name, true AS truncated, 3 AS columns FROM nation ORDER BY n_name LIMIT 7")
def _(s: SparkSession, d: str) -> DataFrame:
    shown = preview.preview(table(s, d, "nation").orderBy("n_name"), 7)
    rows = [(r["n_nationkey"], r["n_name"], shown.truncated, len(shown.columns)) for r in shown.rows]
    return s.createDataFrame(rows, "n_nationkey int, n_name string, truncated boolean, columns int")


@query("exported_view", f"SELECT p_partkey, {_ODD} FROM part WHERE p_size > 20")
def _(s: SparkSession, d: str) -> DataFrame:
    folder = work_folder(s)
    preview.export_csv(table(s, d, "part").filter("p_size > 20").select("p_partkey", F.concat("p_name", F.lit('"q", \nx')).alias("odd")), f"{folder}/view", f"{folder}/view.csv")
    return files.read_csv(s, f"{folder}/view.csv")


@query("storage_sizes", "SELECT 'datasets' AS prefix, 1::BIGINT AS objects, true AS filled FROM region HAVING count(*) > 0 UNION ALL SELECT 'raw', 2, true FROM nation HAVING count(*) > 0")
def _(s: SparkSession, d: str) -> DataFrame:
    folder = work_folder(s)
    table(s, d, "region").coalesce(1).write.parquet(f"{folder}/datasets/region")
    for name in ("nation", "region"):
        table(s, d, name).coalesce(1).write.parquet(f"{folder}/raw/{name}")
    return history.storage_sizes(s, folder).select("prefix", "objects", (F.col("bytes") > 0).alias("filled"))
