"""Lineage, staleness and hierarchies over ``nodes(id, type, ...)`` and ``edges(source, target, kind)``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.storage import scratch, stored

#: Edges along which data flows.
DATA_KINDS = ("read", "publish", "write")


def flow_edges(flows: DataFrame) -> DataFrame:
    """Edges from flow definitions ``(id, definition)``, JSON lists of nodes
    ``{type, dataset?, flow?, connection?, table?, bucket?, key?}``; duplicates removed.

    An output writes a dataset, a table of a connection (``table:<connection>/<table>``) or a file (``file:<bucket>/<key>``);
    ``?`` stands for a table or key without name.
    """
    node = "array<struct<type:string,dataset:string,flow:string,connection:string,table:string,bucket:string,key:string>>"
    nodes = flows.select(F.col("id").cast("string").alias("flow"), F.explode(F.from_json("definition", node)).alias("n"))
    kind = F.col("n.type")

    def sink(prefix: str, place: str, name: str) -> Column:
        return F.concat(F.lit(prefix), F.trim(f"n.{place}"), F.lit("/"), F.coalesce(F.nullif(F.trim(f"n.{name}"), F.lit("")), F.lit("?")))

    written = F.coalesce("n.dataset", sink("table:", "connection", "table"), sink("file:", "bucket", "key"))
    return nodes.select(
        F.when(kind == "source", F.col("n.dataset")).otherwise(F.col("flow")).alias("source"),
        F.when(kind == "source", F.col("flow")).when(kind == "runflow", F.col("n.flow")).when(kind == "output", written).otherwise(F.col("n.dataset")).alias("target"),
        F.create_map(*(F.lit(x) for x in ("source", "read", "output", "write", "refresh", "refresh", "runflow", "orchestrate")))[kind].alias("kind"),
    ).dropna().distinct()


def catalog_edges(datasets: DataFrame, flows: DataFrame, connections: DataFrame) -> DataFrame:
    """Edges from the catalog ``(id, flow_id, connection_id)``: a known flow publishes a dataset, a known connection feeds one."""

    def of(column: str, known: DataFrame, kind: str) -> DataFrame:
        met = datasets.join(known.select(F.col("id").alias(column)), column, "left_semi")
        return met.select(F.col(column).cast("string").alias("source"), F.col("id").cast("string").alias("target"), F.lit(kind).alias("kind"))

    return of("flow_id", flows, "publish").union(of("connection_id", connections, "ingest")).distinct()


def dangling(edges: DataFrame, nodes: DataFrame, existing: DataFrame) -> DataFrame:
    """Referenced ids without a readable node: ``removed`` if nothing of that id exists, else ``unreadable``."""
    ids = edges.select(F.col("source").alias("id")).union(edges.select("target")).distinct().join(nodes.select("id"), "id", "left_anti")
    there = existing.select("id").distinct().withColumn("there", F.lit(True))
    return ids.join(there, "id", "left").select("id", F.when(F.col("there"), "unreadable").otherwise("removed").alias("reason"))


def directly_stale(edges: DataFrame, refreshed: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Flows that read a source refreshed after their last success: ``(id)`` from ``refreshed(id, at)``, ``succeeded(id, at)``."""
    read = edges.filter("kind = 'read'").join(refreshed.select(F.col("id").alias("source"), F.col("at").alias("refreshed_at")), "source")
    return read.join(succeeded.select(F.col("id").alias("target"), F.col("at").alias("succeeded_at")), "target").filter("refreshed_at > succeeded_at").select(F.col("target").alias("id")).distinct()


def _merged(df: DataFrame, most: int = 100_000) -> DataFrame:
    """The table, to be joined by merging if it has many rows: files of paths are so small that Spark would send all of them to the driver."""
    return df if df.limit(most + 1).count() <= most else df.hint("merge")


def _chained(links: DataFrame, stops: DataFrame, stored: Callable) -> DataFrame:
    """``(id, anchor, offset)`` for nodes with exactly one link into them that aren't stops: the nearest node before them that is a
    stop or has none or several links into it, and how far it is.

    Pointers double in each round, so a path of n nodes takes about log2(n) rounds. Nodes that no anchor leads to (cycles) are left out.
    """
    weight = F.max("weight") if "weight" in links.columns else F.lit(1)
    into = links.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("source").alias("anchor"), weight.cast("long").alias("offset"))
    single = into.filter("n = 1").join(_merged(stops.select("id")), "id", "left_anti").select("id", "anchor", "offset", F.lit(False).alias("ended"))
    pointers = stored(single)
    for _ in range(pointers.count().bit_length() + 1):
        further = pointers.select(F.col("id").alias("anchor"), F.col("anchor").alias("next"), F.col("offset").alias("more"))
        moved = pointers.filter("NOT ended").join(_merged(further), "anchor", "left").select(
            "id", F.coalesce("next", "anchor").alias("anchor"), (F.col("offset") + F.coalesce("more", F.lit(0))).alias("offset"), F.col("next").isNull().alias("ended"))
        pointers = stored(moved.union(pointers.filter("ended")))
        if pointers.filter("NOT ended").isEmpty():
            break
    return pointers.filter("ended").drop("ended")


def _shortcuts(links: DataFrame, chained: DataFrame, stops: DataFrame, longest: bool, stored: Callable) -> DataFrame:
    """``(source, target, weight)``: links into nodes with several of them, drawn from the anchors of their sources."""
    heads = links.groupBy("target").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").join(_merged(stops.select(F.col("id").alias("target"))), "target", "left_anti").select("target")
    drawn = links.join(heads, "target", "left_semi").join(_merged(chained.withColumnRenamed("id", "source")), "source", "left")
    weight = F.coalesce("offset", F.lit(0)) + (F.col("weight") if "weight" in links.columns else 1)
    return stored(drawn.groupBy(F.coalesce("anchor", "source").alias("source"), "target").agg((F.max(weight) if longest else F.min(weight)).alias("weight")))


def reach(edges: DataFrame, seeds: DataFrame, hops: int = 6) -> DataFrame:
    """``(id, depth)``: everything that can be reached over ``edges(source, target)`` from the seeds ``(id)``, and how far it is.

    Breadth first for ``hops`` rounds, in which most graphs end; each joins the newest nodes only with the edges. What lies deeper is
    found by shortcuts: nodes with one link into them hang on their anchors by doubled pointers, and rounds go on only over nodes with
    several. So a tree or chain of any depth takes about log2(depth) rounds more, and cycles end. Tables of rounds are deleted.
    """
    with scratch(seeds.sparkSession) as kept:
        return stored(_reach(edges, seeds, hops, kept))


def _reach(edges: DataFrame, seeds: DataFrame, hops: int, stored: Callable) -> DataFrame:
    links = stored(edges.select("source", "target").dropna().distinct())
    found = frontier = stored(seeds.select("id").dropna().distinct().withColumn("depth", F.lit(0).cast("long")))
    for depth in range(1, hops + 1):
        step = links.join(frontier.select(F.col("id").alias("source")), "source").select(F.col("target").alias("id")).distinct()
        frontier = stored(step.join(_merged(found), "id", "left_anti").withColumn("depth", F.lit(depth).cast("long")))
        if frontier.isEmpty():
            return found.withColumn("depth", F.col("depth").cast("int"))
        found = stored(found.union(frontier))
    chained = _chained(links, found, stored)
    short = _shortcuts(links, chained, found, longest=False, stored=stored)
    newest = found
    while True:
        step = short.join(newest.withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.min(F.col("depth") + F.col("weight")).alias("offered"))
        newest = stored(step.join(_merged(found), "id", "left").filter("depth IS NULL OR offered < depth").select("id", F.col("offered").alias("depth")))
        if newest.isEmpty():
            break
        found = stored(found.union(newest).groupBy("id").agg(F.min("depth").alias("depth")))
    hung = _merged(chained).join(found.withColumnRenamed("id", "anchor"), "anchor").select("id", (F.col("depth") + F.col("offset")).alias("depth"))
    return found.union(hung).withColumn("depth", F.col("depth").cast("int"))


def follow(links: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(id, depth)``: what the seeds reach where every source of ``links(source, target)`` has one target, as parents in a tree.

    Each round doubles the length of all jumps and of the paths looked at, so log2(depth) rounds do; cycles end.
    """
    with scratch(seeds.sparkSession) as kept:
        return stored(_follow(links, seeds, kept))


def _follow(links: DataFrame, seeds: DataFrame, stored: Callable) -> DataFrame:
    jumps = stored(links.select("source", "target").dropna().groupBy("source").agg(F.min("target").alias("target")))
    found = stored(seeds.select("id").dropna().distinct().withColumn("depth", F.lit(0).cast("long")))
    known, length = found.count(), 1
    while True:
        jumps = _merged(jumps)
        jumped = jumps.join(_merged(found.withColumnRenamed("id", "source")), "source").select(F.col("target").alias("id"), (F.col("depth") + length).alias("depth"))
        found = stored(found.union(jumped).groupBy("id").agg(F.min("depth").alias("depth")))
        grown = found.count()
        if grown == known:
            return found.withColumn("depth", F.col("depth").cast("int"))
        known, length = grown, 2 * length
        jumps = stored(jumps.join(jumps.select(F.col("source").alias("target"), F.col("target").alias("next")), "target").select("source", F.col("next").alias("target")))


def stale(edges: DataFrame, direct: DataFrame) -> DataFrame:
    """``(id, reason)``: directly stale nodes, and everything downstream of them over data edges as ``inherited``."""
    all_of = reach(edges.filter(F.col("kind").isin(*DATA_KINDS)), direct)
    return all_of.select("id", F.when(F.col("depth") == 0, "direct").otherwise("inherited").alias("reason"))


def neighbourhood(edges: DataFrame, center: DataFrame, direction: str = "both", depth: int = 1) -> DataFrame:
    """``(id, depth)`` within ``depth`` (1 to 8) steps; ``both`` may turn at each step.

    One plan of ``depth`` joins, without jobs or stored tables between them: each sends the newest nodes' neighbours beside the
    nodes themselves and keeps the smallest depth of each, reduced before the shuffle.
    """
    if direction not in ("upstream", "downstream", "both") or not 1 <= depth <= 8:
        raise ValueError("direction is upstream, downstream or both; depth is 1 to 8")
    down, up = edges.select("source", "target"), edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    links = {"downstream": down, "upstream": up, "both": down.union(up).distinct()}[direction].filter("target IS NOT NULL")
    found = center.select("id").distinct().withColumn("depth", F.lit(0))
    for i in range(depth):
        newest = found.join(links, (F.col("id") == F.col("source")) & (F.col("depth") == i), "left")
        pairs = newest.select(F.explode(F.array(F.struct("id", "depth"), F.struct(F.col("target").alias("id"), F.lit(i + 1).alias("depth")))).alias("n"), "target")
        found = pairs.filter(f"n.depth <= {i} OR target IS NOT NULL").groupBy(F.col("n.id").alias("id")).agg(F.min("n.depth").alias("depth"))
    return found


def impact(edges: DataFrame, nodes: DataFrame, start: DataFrame) -> DataFrame:
    """How many nodes of each type are downstream of the start over data edges."""
    hit = reach(edges.filter(F.col("kind").isin(*DATA_KINDS)), start).filter("depth > 0")
    return nodes.join(hit, "id", "left_semi").groupBy("type").agg(F.count("*").alias("n"))


def neighbours(edges: DataFrame) -> DataFrame:
    """``(id, ups, downs)``: direct neighbours of each node, sorted lists."""
    downs = edges.groupBy(F.col("source").alias("id")).agg(F.array_sort(F.collect_set("target")).alias("downs"))
    ups = edges.groupBy(F.col("target").alias("id")).agg(F.array_sort(F.collect_set("source")).alias("ups"))
    return ups.join(downs, "id", "full").select("id", F.coalesce("ups", F.array().cast("array<string>")).alias("ups"), F.coalesce("downs", F.array().cast("array<string>")).alias("downs"))


def problem_counts(nodes: DataFrame, stale_ids: DataFrame) -> DataFrame:
    """One row: stale, restricted and never run nodes of ``nodes(id, restricted, last_run)``."""
    marked = nodes.join(stale_ids.select("id").withColumn("_stale", F.lit(True)), "id", "left")
    n = lambda c: F.count(F.when(c, 1))
    return marked.agg(n(F.col("_stale")).alias("stale"), n(F.col("restricted")).alias("restricted"), n(F.col("last_run").isNull()).alias("never_run"))


def tree_closure(parents: DataFrame, roots: DataFrame, up: bool = False) -> DataFrame:
    """Descendants (or ancestors) of the roots ``(id)`` in ``parents(id, parent_id)``; cycles end."""
    links = parents.filter("parent_id IS NOT NULL")
    if up:
        return follow(links.select(F.col("id").alias("source"), F.col("parent_id").alias("target")), roots)
    return reach(links.select(F.col("parent_id").alias("source"), F.col("id").alias("target")), roots)


def layers(edges: DataFrame, nodes: DataFrame, rounds: int | None = None) -> DataFrame:
    """``(id, layer)``: the longest path from a root, in at most as many rounds as there are nodes (or ``rounds``), so that cycles end.

    Without ``rounds`` and without cycles, nodes with one link into them hang on their anchors by doubled pointers, and rounds go on
    only over nodes with several.
    """
    with scratch(nodes.sparkSession) as kept:
        return stored(_layers(edges, nodes, rounds, kept))


def _layers(edges: DataFrame, nodes: DataFrame, rounds: int | None, stored: Callable) -> DataFrame:
    ids = stored(nodes.select("id"))
    if rounds is None:
        known = ids.distinct()
        links = edges.select("source", "target").dropna().distinct()
        for end in ("source", "target"):
            links = links.join(_merged(known.withColumnRenamed("id", end)), end, "left_semi")
        links = stored(links.select("source", "target"))
        found = _layers_without_cycles(links, known, stored)
        if found is not None:
            return _merged(ids).join(found, "id", "left").select("id", F.coalesce("layer", F.lit(0)).cast("int").alias("layer"))
    current = stored(ids.withColumn("layer", F.lit(0)))
    for _ in range(current.count() if rounds is None else rounds):
        offered = edges.join(current.select(F.col("id").alias("source"), "layer"), "source").groupBy(F.col("target").alias("id")).agg((F.max("layer") + 1).alias("offered"))
        nxt = stored(current.join(offered, "id", "left").select("id", F.greatest("layer", F.coalesce("offered", F.lit(0))).alias("layer"), (F.coalesce("offered", F.lit(0)) > F.col("layer")).alias("moved")))
        current = nxt.select("id", "layer")
        if nxt.filter("moved").isEmpty():
            break
    return current


def _layers_without_cycles(links: DataFrame, nodes: DataFrame, stored: Callable) -> DataFrame | None:
    """``(id, layer)`` of nodes with links into them; None if there is a cycle.

    Nodes with one link into them are hung on their anchors and left out. Of several links from one anchor to a node the longest stays,
    so there may be nodes with one link again: this is repeated as long as it takes out a tenth of the nodes, then rounds do the rest.
    """
    none, hung, before = nodes.limit(0), [], None
    while True:
        into = links.groupBy("target").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") == 1).alias("single"), F.count_if(F.col("n") > 1).alias("several")).first()
        if into["single"] == 0 or before is not None and into["single"] + into["several"] > 0.9 * before and into["several"] > 0:
            break
        chained = _chained(links, none, stored)
        if chained.count() < into["single"]:
            return None
        hung.append(stored(chained))
        before = into["single"] + into["several"]
        links = _shortcuts(links, chained, none, longest=True, stored=stored)
        if into["several"] == 0:
            break
    if "weight" not in links.columns:
        links = links.withColumn("weight", F.lit(1).cast("long"))
    ends = links.select(F.col("source").alias("id")).union(links.select("target"))
    for chained in hung:
        ends = ends.union(chained.select("anchor"))
    ends = ends.distinct()
    for chained in hung:
        ends = ends.join(_merged(chained.select("id")), "id", "left_anti")
    current, newest = stored(ends.withColumn("layer", F.lit(0).cast("long"))), None
    for _ in range(into["several"] + into["single"] + 2):
        offered = links.join((current if newest is None else newest).withColumnRenamed("id", "source"), "source").groupBy(F.col("target").alias("id")).agg(F.max(F.col("layer") + F.col("weight")).alias("offered"))
        newest = stored(offered.join(_merged(current), "id").filter("offered > layer").select("id", F.col("offered").alias("layer")))
        if newest.isEmpty():
            for chained in reversed(hung):
                on = _merged(chained).join(current.withColumnRenamed("id", "anchor"), "anchor").select("id", (F.col("layer") + F.col("offset")).alias("layer"))
                current = stored(current.union(on))
            return current
        current = stored(current.union(newest).groupBy("id").agg(F.max("layer").alias("layer")))
    return None
