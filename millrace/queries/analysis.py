"""Views, run history, audit, lineage, hierarchies and business questions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.windows import running
from ..plans import business, graph, history, preview
from . import query, table

# views
query("distinct_values", "SELECT DISTINCT p_brand FROM part ORDER BY 1 LIMIT 200")(lambda s, d: preview.distinct_values(table(s, d, "part"), "p_brand"))
query("chart_bar", "SELECT l_partkey, sum(l_quantity) AS value FROM lineitem GROUP BY 1 ORDER BY value DESC, 1 LIMIT 20")(lambda s, d: preview.bars(table(s, d, "lineitem"), "l_partkey", "l_quantity"))
query("chart_line", "SELECT p_size, count(p_partkey) AS value FROM part GROUP BY 1 ORDER BY 1 LIMIT 1000")(lambda s, d: preview.line(table(s, d, "part"), "p_size", "p_partkey", "count"))
query("chart_series", """
WITH cells AS (SELECT p_size, p_brand, count(p_partkey) AS value FROM part GROUP BY 1, 2), sums AS (SELECT p_brand, sum(abs(value)) AS t FROM cells GROUP BY 1),
kept AS (SELECT * FROM cells SEMI JOIN (SELECT p_brand FROM sums ORDER BY t DESC, p_brand LIMIT 5) USING (p_brand))
SELECT p_size, p_brand, value, (SELECT greatest(count(*) - 5, 0) FROM sums) AS dropped FROM kept
SEMI JOIN (SELECT p_size FROM kept GROUP BY 1 ORDER BY sum(value) DESC, p_size LIMIT 20) USING (p_size)""")(lambda s, d: preview.series(table(s, d, "part"), "p_size", "p_brand", "p_partkey", "count"))
query("chart_other", """
WITH c AS (SELECT CAST(p_size AS VARCHAR) AS p_size, p_size AS o, count(p_partkey) AS value FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (ORDER BY value DESC, o) AS n FROM c)
SELECT CASE WHEN n <= 5 THEN p_size ELSE 'Other' END AS p_size, CAST(sum(value) AS BIGINT) AS value FROM r GROUP BY 1""")(lambda s, d: preview.shares(table(s, d, "part"), "p_size", "p_partkey", "count"))
query("chart_top_only", "SELECT p_size, max(p_partkey) AS value FROM part GROUP BY 1 ORDER BY value DESC, 1 LIMIT 5")(lambda s, d: preview.shares(table(s, d, "part"), "p_size", "p_partkey", "max"))
query("chart_scatter", """
WITH p AS (SELECT o_custkey, o_orderpriority, count(o_orderkey) AS x, max(o_totalprice) AS y FROM orders GROUP BY 1, 2)
SELECT * FROM p SEMI JOIN (SELECT o_orderpriority FROM p GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 5) USING (o_orderpriority) ORDER BY x DESC, o_custkey, o_orderpriority LIMIT 1000""")(
    lambda s, d: preview.scatter(table(s, d, "orders"), "o_custkey", ("o_orderkey", "count"), ("o_totalprice", "max"), "o_orderpriority"))
query("viewer_pivot", """
SELECT o_orderpriority, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) FILTER (o_orderstatus = 'F') AS BIGINT) AS "F",
  CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) FILTER (o_orderstatus = 'O') AS BIGINT) AS "O", CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) FILTER (o_orderstatus = 'P') AS BIGINT) AS "P"
FROM orders WHERE o_orderkey > 10 GROUP BY o_orderpriority ORDER BY o_orderpriority LIMIT 500""")(
    lambda s, d: preview.viewer(table(s, d, "orders"), [{"column": "o_orderkey", "operator": "gt", "value": 10}], [{"name": "big", "expr": "case when o_totalprice > 100000 then 1 else 0 end"}], {"index": "o_orderpriority", "on": "o_orderstatus", "values": "big"}))
query("outline_rows", """
WITH g AS (SELECT o_orderstatus AS s, o_orderpriority AS p, year(o_orderdate) AS y, count(*) AS n FROM orders GROUP BY ALL),
f AS (SELECT *, lag(s) OVER w AS ls, lag(p) OVER w AS lp FROM g WINDOW w AS (ORDER BY s, p, y))
SELECT CASE WHEN s = ls THEN NULL ELSE s END AS s, CASE WHEN s = ls AND p = lp THEN NULL ELSE p END AS p, CAST(y AS INTEGER) AS y, n FROM f""")(
    lambda s, d: preview.outline(table(s, d, "orders").groupBy(F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"), F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n")), ["s", "p"], ["s", "p", "y"]))


# run history: an event is a run of the flow user_id % 20; errors fail, clicks are scheduled, every fifth was started by the one before
def runs(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events")
    return e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 20).alias("flow_id"), F.col("user_id").alias("launched_by"), F.col("event_type").alias("kind"), F.col("props").alias("task_id"),
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("status"), F.when(F.col("event_type") == "click", "schedule").when(F.col("event_type") == "view", None).otherwise("manual").alias("trigger_type"),
        F.when(F.col("event_id") % 5 == 0, F.col("event_id") - 1).alias("parent_run_id"), F.col("ts").alias("started_at"),
        F.when(F.col("event_id") % 7 != 0, F.col("ts") + F.make_dt_interval(secs=F.floor(F.abs("value")).cast("decimal(18,6)"))).alias("finished_at"),
        F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "worker exited: SIGKILL").otherwise("bad file")).alias("error"),
    )


RUNS = """(SELECT event_id AS id, user_id % 20 AS flow_id, user_id AS launched_by, event_type AS kind, props AS task_id, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS status,
CASE WHEN event_type = 'click' THEN 'schedule' WHEN event_type <> 'view' THEN 'manual' END AS trigger_type, CASE WHEN event_id % 5 = 0 THEN event_id - 1 END AS parent_run_id, ts AS started_at,
CASE WHEN event_id % 7 <> 0 THEN ts + to_seconds(CAST(floor(abs(value)) AS BIGINT)) END AS finished_at,
CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'worker exited: SIGKILL' ELSE 'bad file' END END AS error FROM events) runs"""
_at = lambda text: F.lit(text).cast("timestamp_ntz")
_COUNTS = "count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'failure') AS failure, count(*) FILTER (trigger_type = 'schedule') AS scheduled, count(*) FILTER (COALESCE(trigger_type, '') <> 'schedule') AS manual"
query("activity_day", f"SELECT strftime(started_at - INTERVAL 60 MINUTE, '%Y-%m-%d') AS bucket, {_COUNTS} FROM {RUNS} WHERE parent_run_id IS NULL AND started_at >= '2024-01-05' AND started_at < '2024-01-20' GROUP BY 1")(
    lambda s, d: history.activity(runs(s, d), _at("2024-01-05"), _at("2024-01-20"), "day", 60))
query("activity_hour", f"SELECT strftime(started_at, '%H') AS bucket, {_COUNTS} FROM {RUNS} WHERE parent_run_id IS NULL AND started_at >= '2024-01-10' AND started_at < '2024-01-11' GROUP BY 1")(
    lambda s, d: history.activity(runs(s, d), _at("2024-01-10"), _at("2024-01-11"), "hour"))


def _flows(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))


def _users(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


@query("run_search", f"""SELECT r.id, n_name AS flow_name, c_name AS user_name, status, error FROM {RUNS} r LEFT JOIN nation ON flow_id = n_nationkey LEFT JOIN customer ON launched_by = c_custkey
WHERE status = 'failure' AND (contains(lower(n_name), 'a') OR contains(lower(COALESCE(c_name, '')), 'a') OR contains(lower(kind), 'a') OR contains(status, 'a') OR contains(lower(task_id), 'a') OR contains(lower(COALESCE(error, '')), 'a'))
ORDER BY started_at DESC, id DESC OFFSET 20 LIMIT 50""".replace("runs r", "r"))
def _(s: SparkSession, d: str) -> DataFrame:
    found = history.search_runs(runs(s, d), _flows(s, d), _users(s, d), "A", "failure")
    return history.page(found, [F.desc("started_at"), F.desc("id")], 20, 50)[0].select("id", "flow_name", "user_name", "status", "error")


query("flow_stats", f"""WITH r AS (SELECT * FROM {RUNS}), m AS (SELECT *, row_number() OVER (PARTITION BY flow_id ORDER BY started_at DESC, id DESC) AS n FROM r WHERE finished_at IS NOT NULL)
SELECT flow_id, count(*) AS runs, count(*) FILTER (status = 'success') AS successes, count(*) FILTER (status = 'failure') AS failures, strftime(max(started_at), '%Y-%m-%d %H:%M') AS last_start,
(SELECT round(avg(date_diff('second', started_at, finished_at)), 2) FROM m WHERE m.flow_id = r.flow_id AND n <= 500 AND finished_at >= started_at) AS mean_seconds FROM r GROUP BY flow_id""")(
    lambda s, d: history.flow_statistics(runs(s, d)).withColumn("last_start", F.date_format("last_start", "yyyy-MM-dd HH:mm")))
query("latest_run", f"""SELECT flow_id, arg_max(id, (started_at, id)) AS run_id, arg_max(status, (started_at, id)) AS status, strftime(max(started_at) FILTER (status = 'success'), '%Y-%m-%d %H:%M') AS last_success FROM {RUNS} GROUP BY 1""")(
    lambda s, d: history.latest_runs(runs(s, d)).withColumn("last_success", F.date_format("last_success", "yyyy-MM-dd HH:mm")))


# audit: an event is an action; views are logins, which fail for every fourth user
def audit(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select(
        F.col("event_id").alias("id"), "ts", F.col("user_id").alias("actor_id"), F.col("user_id").cast("string").alias("actor_label"), F.when(F.col("event_type") == "view", "login").otherwise(F.col("event_type")).alias("action"),
        F.when(F.col("user_id") % 4 == 0, "denied").otherwise("success").alias("outcome"), F.lit("flow").alias("target_type"), F.lit(None).cast("string").alias("target_label"), F.col("props").alias("detail"),
    )


AUDIT = "(SELECT event_id AS id, ts, user_id AS actor_id, CASE WHEN event_type = 'view' THEN 'login' ELSE event_type END AS action, CASE WHEN user_id % 4 = 0 THEN 'denied' ELSE 'success' END AS outcome, props AS detail FROM events) audit"
query("audit_search", f"SELECT id, action FROM {AUDIT} WHERE outcome = 'denied' AND ts BETWEEN '2024-01-03' AND '2024-01-12' AND (contains(CAST(actor_id AS VARCHAR), '1') OR contains(action, '1') OR contains(lower(detail), '1'))")(
    lambda s, d: history.search_audit(audit(s, d), "1", _at("2024-01-03"), _at("2024-01-12"), outcome="denied").select("id", "action"))
query("audit_actions", f"SELECT DISTINCT action FROM {AUDIT}")(lambda s, d: history.actions(audit(s, d)))
query("hourly_access", f"""SELECT strftime(h, '%Y-%m-%d %H') AS hour, count(*) FILTER (outcome = 'success') AS succeeded, count(*) FILTER (outcome <> 'success') AS failed
FROM generate_series(TIMESTAMP '2024-01-09 02:00:00', TIMESTAMP '2024-01-10 01:00:00', INTERVAL 1 HOUR) t(h) LEFT JOIN (SELECT * FROM {AUDIT} WHERE action = 'login') ON date_trunc('hour', ts + INTERVAL 1 HOUR) = h GROUP BY h""")(
    lambda s, d: history.hourly_access(audit(s, d), _at("2024-01-10 00:30:00"), 24, "Europe/Rome").withColumn("hour", F.date_format("hour", "yyyy-MM-dd HH")))
query("active_users", f"SELECT actor_id, strftime(max(ts), '%Y-%m-%d %H:%M') AS last_seen, max(ts) >= TIMESTAMP '2024-01-30 23:00:00' - INTERVAL 15 MINUTE AS online FROM {AUDIT} GROUP BY 1")(
    lambda s, d: history.active_users(audit(s, d), _at("2024-01-30 23:00:00")).withColumn("last_seen", F.date_format("last_seen", "yyyy-MM-dd HH:mm")))
query("timeline", f"SELECT id, CAST(greatest(0, date_diff('second', started_at, COALESCE(finished_at, TIMESTAMP '2024-02-01'))) AS DOUBLE) AS seconds FROM (SELECT id, date_trunc('second', started_at) AS started_at, date_trunc('second', finished_at) AS finished_at, started_at AS o FROM {RUNS} ORDER BY o DESC, id DESC LIMIT 20)")(
    lambda s, d: history.timeline(runs(s, d).withColumns({c: F.date_trunc("second", c).cast("timestamp_ntz") for c in ("started_at", "finished_at")}), _at("2024-02-01")).select("id", "seconds"))


def fired(s: SparkSession, d: str) -> DataFrame:
    """Schedules: a nation's flow runs at minute key % 30 and the next half hour, in every hour or (odd keys) in hours key and 9, region 1 on working days only, region 2 on the
    3rd and 5th, region 3 on Mondays and on the 4th, region 4 in February only."""
    n = table(s, d, "nation")
    k = F.col("n_nationkey")
    on = lambda region, days: F.when(F.col("n_regionkey") == region, F.array(*map(F.lit, days)))
    region = F.col("n_regionkey")
    made = n.select(k.cast("string").alias("id"), F.col("n_name").alias("name"), F.when(region == 2, F.array(F.lit(3), F.lit(5))).when(region == 3, F.array(F.lit(4))).alias("month_days"), on(4, [2]).alias("months"), F.array(k % 30, k % 30 + 30).cast("array<int>").alias("minutes"), F.when(k % 2 == 1, F.array(k, F.lit(9))).cast("array<int>").alias("hours"), F.when(region == 1, F.array(*map(F.lit, range(5)))).when(region == 3, F.array(F.lit(0))).cast("array<int>").alias("weekdays"))
    return history.firings(made, _at("2024-01-01"), 7)


FIRED = """fired AS (SELECT n_name AS name, m AS minute FROM nation, generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-07 23:59:00', INTERVAL 1 MINUTE) t(m)
WHERE minute(m) % 30 = n_nationkey % 30 AND (n_nationkey % 2 = 0 OR hour(m) IN (n_nationkey, 9)) AND (n_regionkey <> 1 OR isodow(m) <= 5)
  AND (n_regionkey <> 2 OR day(m) IN (3, 5)) AND (n_regionkey <> 3 OR day(m) = 4 OR isodow(m) = 1) AND n_regionkey <> 4), per AS (SELECT minute, count(*) AS jobs, string_agg(name, ',' ORDER BY name) AS names FROM fired GROUP BY 1)"""
query("schedule_grid", f"WITH {FIRED} SELECT CAST(isodow(minute) - 1 AS INTEGER) AS weekday, CAST(hour(minute) AS INTEGER) AS hour, CAST(sum(jobs) AS BIGINT) AS firings, max(jobs) AS peak, max(jobs) > 1 AS critical FROM per GROUP BY 1, 2")(lambda s, d: history.load_grid(fired(s, d), 1))
query("collisions", f"WITH {FIRED} SELECT strftime(minute, '%Y-%m-%d %H:%M') AS minute, jobs, jobs - 2 AS queued, names FROM per WHERE jobs > 2 ORDER BY jobs DESC, minute LIMIT 30")(lambda s, d: history.collisions(fired(s, d), 2).withColumn("minute", F.date_format("minute", "yyyy-MM-dd HH:mm")))
query("error_class", f"SELECT CASE WHEN error IS NULL THEN NULL WHEN contains(lower(error), 'sigkill') THEN 'out_of_memory' ELSE 'other' END AS class, count(*) AS n FROM {RUNS} GROUP BY 1")(lambda s, d: runs(s, d).groupBy(history.error_class(F.col("error")).alias("class")).agg(F.count("*").alias("n")))
query("stale_runs", f"SELECT id, 'failure' AS status FROM {RUNS} WHERE finished_at IS NULL AND started_at < TIMESTAMP '2024-01-20' - INTERVAL 3900 SECOND")(lambda s, d: history.stale_runs(runs(s, d), _at("2024-01-20")).select("id", "status"))
query("catalog_search", "SELECT p_partkey AS id FROM part WHERE contains(lower(p_name), 're') OR contains(lower(p_type), 're')")(
    lambda s, d: history.search_catalog(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description")), "RE").select("id"))


query("win_running_rows", "SELECT o_custkey, o_orderpriority, o_orderkey, CAST(count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n FROM orders")(
    lambda s, d: table(s, d, "orders").select("o_custkey", "o_orderpriority", "o_orderkey", running(F.count("*"), ["o_custkey"], ["o_orderpriority", "o_orderkey"]).alias("n")))
query("run_search_total", f"SELECT count(*) AS total FROM {RUNS} WHERE status = 'failure'")(lambda s, d: history.page(history.search_runs(runs(s, d), _flows(s, d), _users(s, d), status="failure"), [F.col("id")], 0, 10)[1])


# lineage: part -> lineitem -> orders -> customer -> nation -> region, a node for each key
def nodes(s: SparkSession, d: str) -> DataFrame:
    of = lambda t, key, kind: table(s, d, t).select(F.concat(F.lit(kind), F.col(key).cast("string")).alias("id"), F.lit(kind).alias("type"))
    return of("customer", "c_custkey", "c").union(of("nation", "n_nationkey", "n")).union(of("region", "r_regionkey", "r")).union(of("supplier", "s_suppkey", "s"))


def edges(s: SparkSession, d: str) -> DataFrame:
    def of(t: str, a: str, ka: str, b: str, kb: str, kind: str) -> DataFrame:
        return table(s, d, t).select(F.concat(F.lit(ka), F.col(a).cast("string")).alias("source"), F.concat(F.lit(kb), F.col(b).cast("string")).alias("target"), F.lit(kind).alias("kind"))

    return of("customer", "c_custkey", "c", "c_nationkey", "n", "read").union(of("supplier", "s_suppkey", "s", "s_nationkey", "n", "refresh")).union(of("nation", "n_nationkey", "n", "n_regionkey", "r", "write")).union(of("nation", "n_regionkey", "r", "n_nationkey", "n", "orchestrate"))


GRAPH = """nodes AS (SELECT 'c' || c_custkey AS id, 'c' AS type FROM customer UNION ALL SELECT 'n' || n_nationkey, 'n' FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' FROM region UNION ALL SELECT 's' || s_suppkey, 's' FROM supplier),
edges AS (SELECT 'c' || c_custkey AS source, 'n' || c_nationkey AS target, 'read' AS kind FROM customer UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'refresh' FROM supplier
UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'write' FROM nation UNION ALL SELECT 'r' || n_regionkey, 'n' || n_nationkey, 'orchestrate' FROM nation)"""
_CENTER = ("c1",)


def _ids(s: SparkSession, d: str, condition: str) -> DataFrame:
    return nodes(s, d).filter(condition).select("id")


query("edges", """SELECT DISTINCT * FROM (SELECT 'd' || p_size AS source, CAST(p_partkey AS VARCHAR) AS target, 'read' AS kind FROM part UNION ALL SELECT CAST(p_partkey AS VARCHAR), 'o' || p_brand, 'write' FROM part
UNION ALL SELECT CAST(p_partkey AS VARCHAR), CAST(p_partkey + 1 AS VARCHAR), 'orchestrate' FROM part)""")(
    lambda s, d: graph.flow_edges(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.to_json(F.array(
        F.struct(F.lit("source").alias("type"), F.concat(F.lit("d"), "p_size").alias("dataset"), F.lit(None).cast("string").alias("flow")),
        F.struct(F.lit("output").alias("type"), F.concat(F.lit("o"), "p_brand").alias("dataset"), F.lit(None).cast("string").alias("flow")),
        F.struct(F.lit("output").alias("type"), F.concat(F.lit("o"), "p_brand").alias("dataset"), F.lit(None).cast("string").alias("flow")),
        F.struct(F.lit("runflow").alias("type"), F.lit(None).cast("string").alias("dataset"), (F.col("p_partkey") + 1).cast("string").alias("flow")))).alias("definition"))))
query("catalog_edges", """
SELECT CAST(o_custkey AS VARCHAR) AS source, CAST(o_orderkey AS VARCHAR) AS target, 'publish' AS kind FROM orders
WHERE o_orderstatus <> 'P' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
UNION SELECT CAST(o_orderkey % 40 AS VARCHAR), CAST(o_orderkey AS VARCHAR), 'ingest' FROM orders WHERE o_orderkey % 40 IN (SELECT n_nationkey FROM nation)""")(
    lambda s, d: graph.catalog_edges(
        table(s, d, "orders").select(
            F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("flow_id"), (F.col("o_orderkey") % 40).alias("connection_id")
        ),
        table(s, d, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("id")),
        table(s, d, "nation").select(F.col("n_nationkey").alias("id")),
    ))
query("sink_edges", """
SELECT DISTINCT CAST(p_partkey AS VARCHAR) AS source, 'table:' || (p_size % 7) || '/' || CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '?' END AS target, 'write' AS kind FROM part
UNION SELECT CAST(p_partkey AS VARCHAR), 'file:lake/' || CASE WHEN p_size % 3 = 0 THEN p_type ELSE '?' END, 'write' FROM part""")(
    lambda s, d: graph.flow_edges(table(s, d, "part").select(F.col("p_partkey").alias("id"), F.to_json(F.array(
        F.struct(F.lit("output").alias("type"), (F.col("p_size") % 7).cast("string").alias("connection"), F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(" ").alias("table"),
            F.lit(None).cast("string").alias("bucket"), F.lit(None).cast("string").alias("key")),
        F.struct(F.lit("output").alias("type"), F.lit(None).cast("string").alias("connection"), F.lit(None).cast("string").alias("table"),
            F.lit("lake").alias("bucket"), F.when(F.col("p_size") % 3 == 0, F.col("p_type")).alias("key")))).alias("definition"))))
query("dangling", f"WITH {GRAPH} SELECT DISTINCT id, CASE WHEN starts_with(id, 's') THEN 'unreadable' ELSE 'removed' END AS reason FROM (SELECT source AS id FROM edges UNION SELECT target FROM edges) WHERE left(id, 1) IN ('s', 'r')")(
    lambda s, d: graph.dangling(edges(s, d), nodes(s, d).filter("type NOT IN ('s', 'r')"), nodes(s, d).filter("type <> 'r'")))
query("stale_direct", "SELECT DISTINCT 'n' || c_nationkey AS id FROM customer WHERE c_acctbal > c_nationkey * 100")(
    lambda s, d: graph.directly_stale(edges(s, d), table(s, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("id"), F.col("c_acctbal").alias("at")), table(s, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("id"), (F.col("n_nationkey") * 100).cast("double").alias("at"))))
query("stale_cascade", f"WITH RECURSIVE {GRAPH}, hit AS (SELECT id FROM nodes WHERE id IN ('c1', 'c2', 'n3') UNION SELECT target FROM hit JOIN edges ON source = id WHERE kind IN ('read', 'publish', 'write')) SELECT id, CASE WHEN id IN ('c1', 'c2', 'n3') THEN 'direct' ELSE 'inherited' END AS reason FROM hit")(
    lambda s, d: graph.stale(edges(s, d), _ids(s, d, "id IN ('c1', 'c2', 'n3')")))
query("neighbourhood", f"WITH RECURSIVE {GRAPH}, every AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges), hit AS (SELECT 'c1' AS id, 0 AS depth UNION SELECT target, depth + 1 FROM hit JOIN every ON source = id WHERE depth < 3) SELECT id, min(depth) AS depth FROM hit GROUP BY 1")(
    lambda s, d: graph.neighbourhood(edges(s, d), _ids(s, d, "id = 'c1'"), "both", 3))
query("impact", f"WITH RECURSIVE {GRAPH}, hit AS (SELECT id FROM nodes WHERE type = 'c' UNION SELECT target FROM hit JOIN edges ON source = id WHERE kind IN ('read', 'publish', 'write')) SELECT type, count(*) AS n FROM nodes SEMI JOIN hit USING (id) WHERE type <> 'c' GROUP BY 1")(
    lambda s, d: graph.impact(edges(s, d), nodes(s, d), _ids(s, d, "type = 'c'")))
query("neighbours", f"WITH {GRAPH} SELECT id, len(list_distinct(list(u) FILTER (u IS NOT NULL))) AS ups, len(list_distinct(list(w) FILTER (w IS NOT NULL))) AS downs FROM (SELECT target AS id, source AS u, NULL AS w FROM edges UNION ALL SELECT source, NULL, target FROM edges) GROUP BY 1".replace("len(", "COALESCE(len(").replace("IS NOT NULL)))", "IS NOT NULL))), 0)"))(
    lambda s, d: graph.neighbours(edges(s, d)).select("id", F.size("ups").cast("long").alias("ups"), F.size("downs").cast("long").alias("downs")))
query("problem_counts", f"WITH {GRAPH} SELECT count(*) FILTER (id IN ('c1', 'n3')) AS stale, count(*) FILTER (type = 's') AS restricted, count(*) FILTER (type = 'r') AS never_run FROM nodes")(
    lambda s, d: graph.problem_counts(nodes(s, d).withColumn("restricted", F.col("type") == "s").withColumn("last_run", F.when(F.col("type") != "r", 1)), _ids(s, d, "id IN ('c1', 'n3')")))


def tree(s: SparkSession, d: str) -> DataFrame:
    """A customer's parent is the one with half its key."""
    return table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2)).alias("parent_id"))


query("closure", "WITH RECURSIVE t AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent FROM customer), hit AS (SELECT 5::BIGINT AS id, 0 AS depth UNION ALL SELECT t.id, depth + 1 FROM hit JOIN t ON t.parent = hit.id) SELECT id, depth FROM hit")(
    lambda s, d: graph.tree_closure(tree(s, d), tree(s, d).filter("id = 5")))
query("ancestors", "WITH RECURSIVE t AS (SELECT c_custkey AS id, CASE WHEN c_custkey > 1 THEN c_custkey // 2 END AS parent FROM customer), hit AS (SELECT 77::BIGINT AS id, 0 AS depth UNION ALL SELECT t.parent, depth + 1 FROM hit JOIN t ON t.id = hit.id WHERE t.parent IS NOT NULL) SELECT id, depth FROM hit WHERE id IS NOT NULL")(
    lambda s, d: graph.tree_closure(tree(s, d), tree(s, d).filter("id = 77"), up=True))
query("layers", "WITH RECURSIVE hit AS (SELECT c_custkey AS id, 0 AS depth FROM customer UNION SELECT c.c_custkey, depth + 1 FROM hit JOIN customer c ON c.c_custkey // 2 = hit.id AND c.c_custkey > 1) SELECT id, max(depth) AS layer FROM hit GROUP BY 1")(
    lambda s, d: graph.layers(tree(s, d).filter("parent_id > 0").select(F.col("parent_id").alias("source"), F.col("id").alias("target")), tree(s, d)))

# business questions
_MONEY = "decimal(18, 4)"


def costs(s: SparkSession, d: str) -> DataFrame:
    """Dated unit costs of each part; a cost is valid until the next one."""
    p = table(s, d, "part")
    row = lambda day, f: p.select(F.col("p_partkey").alias("l_partkey"), F.lit(day).cast("timestamp_ntz").alias("valid_from"), F.round(F.col("p_retailprice") * f, 2).alias("unit_cost"))
    return row("1992-03-01", 0.25).union(row("1996-01-01", 0.5))


def margins(s: SparkSession, d: str) -> DataFrame:
    parts = table(s, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate", "o_orderpriority")
    lines = table(s, d, "lineitem")
    # each line has one order, so lines can be counted instead; parts come last, when lines are dealt by part already
    lines = business.as_of(lines.join(orders, "l_orderkey"), costs(s, d), "l_partkey", "o_orderdate", sizes=lines).join(parts, "l_partkey")
    money = lambda c: F.round(c, 4).cast(_MONEY)
    price = F.col("l_extendedprice") / F.col("l_quantity")
    out = business.line_margin(lines, F.col("l_quantity"), price, F.col("l_discount"), F.coalesce("unit_cost", F.lit(0.0)), F.col("l_extendedprice") * F.col("l_tax"))
    return out.withColumns({c: money(F.col(c)) for c in ("revenue", "production", "commercial")}).withColumn("margin", F.col("revenue") - F.col("production") - F.col("commercial"))


MARGINS = """costs AS (SELECT p_partkey AS part, TIMESTAMP '1992-03-01' AS a, TIMESTAMP '1996-01-01' AS b, round(p_retailprice * 0.25, 2) AS cost FROM part
  UNION ALL SELECT p_partkey, TIMESTAMP '1996-01-01', NULL, round(p_retailprice * 0.5, 2) FROM part),
margins AS (
  SELECT *, revenue - production - commercial AS margin FROM (
    SELECT *, CAST(round(l_quantity * (l_extendedprice / l_quantity) * (1 - l_discount), 4) AS DECIMAL(18, 4)) AS revenue,
      CAST(round(l_quantity * COALESCE(cost, 0), 4) AS DECIMAL(18, 4)) AS production, CAST(round(l_extendedprice * l_tax, 4) AS DECIMAL(18, 4)) AS commercial
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey
    LEFT JOIN costs ON part = l_partkey AND a <= o_orderdate AND (b IS NULL OR o_orderdate < b)))"""
_SUMS = ("revenue", "production", "commercial", "margin")
query("line_margin", f"WITH {MARGINS} SELECT p_type, {', '.join(f'CAST(sum({c}) AS DOUBLE) AS {c}' for c in _SUMS)} FROM margins GROUP BY 1")(
    lambda s, d: margins(s, d).groupBy("p_type").agg(*(F.sum(c).cast("double").alias(c) for c in _SUMS)))


@query("margin_by_network", f"""
WITH {MARGINS}, people AS (SELECT s_suppkey AS id, NULLIF(s_suppkey // 4, 0) AS up FROM supplier),
network AS (SELECT a.id AS agent, a.up AS inspector, b.up AS head FROM people a LEFT JOIN people b ON a.up = b.id)
SELECT head, inspector, r_name, o_orderpriority, CAST(sum(margin) AS DOUBLE) AS margin
FROM margins JOIN customer ON o_custkey = c_custkey JOIN network ON agent = c_custkey % (SELECT count(*) FROM supplier) + 1
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4""")
def _(s: SparkSession, d: str) -> DataFrame:
    """Customers belong to an agent, agents to inspectors, these to area heads: three levels of one table."""
    suppliers = table(s, d, "supplier")
    people = business.network(suppliers.select(F.col("s_suppkey").alias("id"), F.floor(F.col("s_suppkey") / 4).alias("manager_id")))
    customers = table(s, d, "customer").crossJoin(suppliers.agg(F.count(F.lit(1)).alias("agents"))).withColumn("agent", F.col("c_custkey") % F.col("agents") + 1)  # one row
    customers = customers.join(people, "agent").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    met = margins(s, d).join(customers.select(F.col("c_custkey").alias("o_custkey"), "head", "inspector", "r_name"), "o_custkey")
    return met.groupBy("head", "inspector", "r_name", "o_orderpriority").agg(F.sum("margin").cast("double").alias("margin"))


for _name, _by in (("category_share", "p_type"), ("channel_share", "o_orderpriority")):
    query(_name, f"WITH {MARGINS}, g AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, {_by}, CAST(sum(round(l_extendedprice)) AS BIGINT) AS value FROM margins GROUP BY 1, 2) SELECT period, {_by}, value, round(CAST(value AS DOUBLE) / CAST(sum(value) OVER (PARTITION BY period) AS DOUBLE), 7) AS share FROM g")(
        lambda s, d, by=_by: business.share(margins(s, d), F.date_format("o_orderdate", "yyyy-MM"), by, F.round("l_extendedprice").cast("long")).withColumn("share", F.round("share", 7)))
query("cancel_rate", "SELECT strftime(o_orderdate, '%Y') AS period, o_orderpriority, count(*) AS n, round(count(*) FILTER (o_orderstatus = 'F') / count(*), 9) AS \"rate_F\", round(count(*) FILTER (o_orderstatus = 'O') / count(*), 9) AS \"rate_O\" FROM orders GROUP BY 1, 2")(
    lambda s, d: business.status_rates(table(s, d, "orders"), F.date_format("o_orderdate", "yyyy"), "o_orderpriority", "o_orderstatus", ["F", "O"]).withColumns({c: F.round(c, 9) for c in ("rate_F", "rate_O")}))


def prices(s: SparkSession, d: str) -> DataFrame:
    """Two dated prices of each part; the second is open."""
    p = table(s, d, "part")
    row = lambda a, b, f: p.select(F.col("p_partkey").alias("l_partkey"), F.lit(a).cast("timestamp_ntz").alias("valid_from"), F.lit(b).cast("timestamp_ntz").alias("valid_to"), F.round(F.col("p_retailprice") * f, 2).alias("price"))
    return row("1992-06-01", "1995-12-31 23:59:59", 1.0).union(row("1996-01-01", None, 2.0))


PRICES = "prices AS (SELECT p_partkey, TIMESTAMP '1992-06-01' AS a, TIMESTAMP '1995-12-31 23:59:59' AS b, round(p_retailprice * 1.0, 2) AS price FROM part UNION ALL SELECT p_partkey, TIMESTAMP '1996-01-01', NULL, round(p_retailprice * 2.0, 2) FROM part)"
query("price_asof", f"WITH {PRICES} SELECT l_orderkey, l_partkey, l_linenumber, price FROM lineitem LEFT JOIN prices ON l_partkey = p_partkey AND a <= l_shipdate AND (b IS NULL OR l_shipdate <= b)")(
    lambda s, d: business.valid_at(table(s, d, "lineitem"), prices(s, d), "l_partkey", "l_shipdate").select("l_orderkey", "l_partkey", "l_linenumber", "price"))
query("price_asof_next", f"WITH {PRICES} SELECT l_orderkey, l_partkey, l_linenumber, price FROM lineitem LEFT JOIN (SELECT *, lead(a) OVER (PARTITION BY p_partkey ORDER BY a) AS e FROM prices) ON l_partkey = p_partkey AND a <= l_shipdate AND (e IS NULL OR l_shipdate < e)")(
    lambda s, d: business.valid_at(table(s, d, "lineitem"), prices(s, d).drop("valid_to"), "l_partkey", "l_shipdate", end=None).select("l_orderkey", "l_partkey", "l_linenumber", "price"))


_STEPS = "SELECT o_custkey % 3 AS k, o_orderdate AS since, max(o_orderkey) AS rate, max(o_orderdate) + INTERVAL (max(o_orderkey) % 4) DAY AS until FROM orders GROUP BY 1, 2"
query("asof_hot", f"""WITH r AS (SELECT *, lead(since) OVER (PARTITION BY k ORDER BY since) AS next FROM ({_STEPS}))
SELECT l_orderkey, l_linenumber, CASE WHEN until >= l_shipdate THEN rate END AS rate
FROM lineitem LEFT JOIN r ON l_partkey % 3 = k AND since <= l_shipdate AND (next IS NULL OR l_shipdate < next)""")(
    lambda s, d: business.as_of(
        table(s, d, "lineitem").withColumn("k", F.col("l_partkey") % 3),
        table(s, d, "orders").groupBy((F.col("o_custkey") % 3).alias("k"), F.col("o_orderdate").alias("since")).agg(F.max("o_orderkey").alias("rate")).withColumn("until", F.expr("since + make_dt_interval(cast(rate % 4 as int))")),
        "k", "l_shipdate", "since", "until", slice_rows=5000,
    ).select("l_orderkey", "l_linenumber", "rate")
)
