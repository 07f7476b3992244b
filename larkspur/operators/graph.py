"""Bounded graph operators over edges (src, dst): neighbourhoods, cycles, closures, hierarchies."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, set from spark.checkpoint.dir where it is not. Where no folder is named, a session that runs in this process alone gets a temporary one; any other one is refused."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[[^]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and keep it as a table in the session's checkpoint folder, so that plans do not grow with the number of rounds.

    A checkpoint would hand on what the optimizer knows about its rows, which doubles from round to round; a table does not.
    """
    kept = f"{folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.parquet(kept)
    return df.sparkSession.read.schema(df.schema).parquet(kept)


def association_edges(associations: DataFrame) -> DataFrame:
    """Edges of associations (model, name, type, class_name): the class named, else the name as a class."""
    from larkspur.functions.text import classify

    return associations.select(F.col("model").alias("src"), F.coalesce("class_name", classify(F.col("name"))).alias("dst"), "type", "through", "polymorphic")


def neighbourhood(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """Nodes within ``depth`` steps in either direction of the start (node), with their distance. Depth is at most 3."""
    both = edges.select(F.explode(F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))).alias("e")).select("e.*")
    return closure(both, start, min(max(depth, 1), 3)).withColumnRenamed("depth", "distance")


def _in_cycles(plain: DataFrame) -> DataFrame:
    """The edges left once nodes without an edge in or without an edge out are gone, again and again; every cycle stays."""
    left, n = cut(plain), None
    while n != (n := left.count()) and n:
        left = cut(left.join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
    return left


def components(edges: DataFrame) -> DataFrame:
    """node and component (its largest node) of every node on a cycle: strongly connected components by forward and backward colouring.

    Every node takes the largest name that reaches it; a component has one colour, so edges between colours go. What reaches the node that
    gave a colour, inside the colour, is its component. The rest is trimmed and coloured again, until no edge is left.
    """
    left, out = _in_cycles(edges.select("src", "dst").where("src is not null and dst is not null").distinct()), None
    while not left.isEmpty():
        colour, total = left.select(F.explode(F.array("src", "dst")).alias("node")).distinct().select("node", F.col("node").alias("c")), None
        while True:
            told = left.join(colour.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node"), "c").unionByName(colour)
            colour = cut(told.groupBy("node").agg(F.max("c").alias("c")))
            if total == (total := colour.agg(F.sum(F.xxhash64("node", "c").cast("decimal(38,0)"))).first()[0]):
                break
        ends = left.join(colour.select(F.col("node").alias("src"), F.col("c").alias("a")), "src").join(colour.select(F.col("node").alias("dst"), F.col("c").alias("b")), "dst")
        inside = cut(ends.where("a = b").select("src", "dst", F.col("a").alias("c")))
        back = closure(inside.select(F.struct("c", F.col("dst").alias("v")).alias("src"), F.struct("c", F.col("src").alias("v")).alias("dst")), colour.where("node = c").select(F.struct("c", F.col("node").alias("v")).alias("node")))
        found = cut(back.select(F.col("node.v").alias("node"), F.col("node.c").alias("component")))
        on_cycle = inside.join(found.select(F.col("node").alias("src")), "src", "left_semi").join(found.select(F.col("node").alias("dst")), "dst", "left_semi")
        kept = cut(found.join(on_cycle.select(F.col("src").alias("node")).distinct(), "node", "left_semi"))
        out = kept if out is None else out.unionByName(kept)
        done = found.select("node")
        left = _in_cycles(inside.select("src", "dst").join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti"))
    return out if out is not None else left.select(F.col("src").alias("node"), F.col("src").alias("component"))


def cycles(edges: DataFrame, longest: int | None = None, most_paths: int = 10_000_000) -> DataFrame:
    """All simple cycles, each once, as its path from the smallest node; of up to ``longest`` nodes where that is given.

    Paths are followed inside strongly connected components alone. A dense component has more paths than any cluster holds: beyond most_paths
    open ones this raises an error instead of leaving some out.
    """
    parts = components(edges)
    ends = edges.select("src", "dst").distinct().join(parts.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(parts.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst")
    plain = cut(ends.where("a = b").select("src", "dst"))
    step = plain.select(F.col("src").alias("a"), F.col("dst").alias("b"))
    paths = plain.select(F.array("src").alias("path"), F.col("dst").alias("at"))
    out, n = None, 0
    while longest is None or n < longest:
        closed = paths.where(F.col("at") == F.get("path", F.lit(0))).select("path")
        out, n = closed if out is None else out.unionByName(closed), n + 1
        on = paths.where((F.col("at") > F.get("path", F.lit(0))) & ~F.array_contains("path", F.col("at")))
        paths = cut(on.join(step, F.col("at") == F.col("a")).select(F.concat("path", F.array("at")).alias("path"), F.col("b").alias("at")))
        if not (open_ := paths.count()):
            break
        if open_ > most_paths:
            raise ValueError(f"over {most_paths} open paths of {n + 1} nodes: give a bound for longest")
    return out


def _dealt(df: DataFrame, key: str, n: int) -> DataFrame:
    """df dealt over n partitions by key and kept so: joins on the key with another frame dealt alike move no row."""
    spark = df.sparkSession
    folder(spark)
    return df.repartition(n, key).checkpoint()


def closure(edges: DataFrame, start: DataFrame, depth: int | None = None, hops: int = 3) -> DataFrame:
    """Nodes reached from the start along the edges, with the least depth, until nothing new is met or to a given depth; cycles end where a node was seen.

    Edges are dealt by their source once, fronts by their nodes: a level moves the nodes it meets, and nothing else. A round goes up to hops
    levels further in one job. What was seen lies in a few runs dealt alike; beyond three, a run joins the one before it unless that is
    more than twice as large, so a node is written again as often as a run doubles.
    """
    n = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = _dealt(edges.select(F.col("src").alias("node"), "dst").dropna(), "node", n)
    found = _dealt(start.select("node").dropna().distinct(), "node", n).withColumn("depth", F.lit(0))
    level, runs = 0, []
    while size := found.count():
        runs.append((size, found))
        while len(runs) > 3 and runs[-2][0] <= 2 * runs[-1][0]:
            (a, older), (b, newer) = runs[-2:]
            runs[-2:] = [(a + b, _dealt(older.unionByName(newer), "node", n))]
        ahead = hops if depth is None else min(hops, depth - level)
        if ahead <= 0:
            break
        front, fronts = found.where(F.col("depth") == level).select("node"), []
        for i in range(1, ahead + 1):
            front = out.join(front, "node").select(F.col("dst").alias("node")).repartition(n, "node").distinct()
            for _, run in runs:
                front = front.join(run.select("node"), "node", "left_anti")
            fronts.append(front.withColumn("depth", F.lit(level + i)))
        found = reduce(DataFrame.unionByName, fronts).repartition(n, "node").groupBy("node").agg(F.min("depth").alias("depth")).checkpoint()
        level += ahead
    return reduce(DataFrame.unionByName, (run for _, run in runs)) if runs else found


def hierarchies(models: DataFrame) -> DataFrame:
    """Bases of models that share a table (model, parent, table): base, table and its sorted children. A base is a model whose parent is none of the models."""
    parents = models.select(F.col("model").alias("parent")).distinct()
    child = models.join(parents, "parent", "left_semi")
    base = models.join(parents.withColumnRenamed("parent", "_p"), F.col("parent") == F.col("_p"), "left_anti")
    grouped = child.groupBy("table").agg(F.sort_array(F.collect_set("model")).alias("children"))
    return base.select(F.col("model").alias("base"), "table").join(grouped, "table")


def nearest_with_rows(parents: DataFrame, rows: DataFrame) -> DataFrame:
    """For each node (node, parent): the nearest of itself and its ancestors that rows (node) holds, and how far it is.

    The walk ends where there is no parent, or where it comes back to the node it started from or to one that it passed.
    """
    have = rows.select(F.col("node").alias("_has")).distinct()
    above = parents.where("parent is not null").select(F.col("node").alias("_n"), "parent")
    at = parents.select("node", F.col("node").alias("ancestor"), F.array("node").alias("_passed"))
    out, d = None, 0
    while True:
        hit = at.join(have, F.col("ancestor") == F.col("_has")).select("node", "ancestor", F.lit(d).alias("distance"))
        out, d = hit if out is None else out.unionByName(hit), d + 1
        rest = at.join(have, F.col("ancestor") == F.col("_has"), "left_anti").join(above, F.col("ancestor") == F.col("_n"))
        at = cut(rest.where(~F.array_contains("_passed", F.col("parent"))).select("node", F.col("parent").alias("ancestor"), F.concat("_passed", F.array("parent")).alias("_passed")))
        if at.isEmpty():
            return out


def through_hops(edges: DataFrame) -> DataFrame:
    """Edges through a third node as two edges; all others as they are."""
    hops = F.when(
        F.col("through").isNotNull(),
        F.array(F.struct(F.col("src"), F.col("through").alias("dst")), F.struct(F.col("through").alias("src"), F.col("dst"))),
    ).otherwise(F.array(F.struct(F.col("src"), F.col("dst"))))
    return edges.select(F.explode(hops).alias("e")).select("e.src", "e.dst").distinct()


def drawn_edges(edges: DataFrame, implementers: DataFrame) -> DataFrame:
    """src, arrow, label and dst of a drawing, each once: edges through a node as two, polymorphic ones to an interface that others (name, model) implement, all others as they are."""
    arrow = lambda src, kind, label, dst: F.struct(src.alias("src"), F.lit(kind).alias("arrow"), label.alias("label"), dst.alias("dst"))
    src, dst, via = F.col("src"), F.col("dst"), F.col("through")
    hops = F.array(arrow(src, "==>", F.lit("through"), via), arrow(via, "==>", F.lit("through"), dst))
    plain = F.when(via.isNotNull(), hops).when(F.col("polymorphic"), F.array(arrow(src, "-.->", F.lit("polymorphic"), dst))).otherwise(F.array(arrow(src, "-->", F.col("type"), dst)))
    drawn = edges.select(F.explode(plain).alias("e")).select("e.*")
    open_ends = edges.where("polymorphic and through is null").join(implementers, F.col("dst") == F.col("name"))
    backs = open_ends.select(F.col("model").alias("src"), F.lit("-.->").alias("arrow"), F.lit("implements").alias("label"), F.col("src").alias("dst"))
    return drawn.unionByName(backs).distinct()


def drawn_text(drawn: DataFrame) -> DataFrame:
    """The lines of a flow chart for each source of :func:`drawn_edges`; names lose what is no letter, digit or underscore."""
    plain = lambda c: F.regexp_replace(F.col(c).cast("string"), "[^A-Za-z0-9_]", "_")
    line = F.concat(plain("src"), F.lit(" "), "arrow", F.lit("|"), "label", F.lit("| "), plain("dst"))
    return drawn.select("src", line.alias("line")).groupBy("src").agg(F.array_join(F.sort_array(F.collect_set("line")), "\n").alias("lines"))


def related(edges: DataFrame, chosen: DataFrame) -> DataFrame:
    """Nodes one step away from the chosen ones (node) and not among them."""
    out = edges.join(chosen.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
    into = edges.join(chosen.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("node"))
    return out.unionByName(into).distinct().join(chosen, "node", "left_anti")


def as_text(edges: DataFrame) -> DataFrame:
    """One line of a flow chart for each source node."""
    line = F.concat_ws(" ", F.col("src").cast("string"), F.lit("-->"), F.col("dst").cast("string"))
    return edges.select("src", line.alias("line")).groupBy("src").agg(F.array_join(F.sort_array(F.collect_set("line")), "\n").alias("lines"))


def ancestors(parents: DataFrame) -> DataFrame:
    """node, ancestor and distance of every node (node, parent) to itself and to all above it; a loop ends where it comes back."""
    above = parents.where("parent IS NOT NULL").select(F.col("node").alias("ancestor"), F.col("parent").alias("_up"))
    at = parents.select("node").distinct().select("node", F.col("node").alias("ancestor"), F.array("node").alias("_passed"))
    out, distance = at.select("node", "ancestor", F.lit(0).alias("distance")), 0
    while True:
        distance += 1
        at = at.join(above, "ancestor").where(~F.array_contains("_passed", F.col("_up")))
        at = cut(at.select("node", F.col("_up").alias("ancestor"), F.concat("_passed", F.array("_up")).alias("_passed")))
        if at.isEmpty():
            return out.groupBy("node", "ancestor").agg(F.min("distance").alias("distance"))
        out = out.unionByName(at.select("node", "ancestor", F.lit(distance).alias("distance")))


def visible_members(parents: DataFrame, members: DataFrame) -> DataFrame:
    """Members (owner, name) that every node has, its own and inherited ones: node, name, origin and distance. The nearest owner of a name wins; of several as near, the smaller."""
    held = ancestors(parents).join(members.select(F.col("owner").alias("ancestor"), "name").distinct(), "ancestor")
    return held.groupBy("node", "name").agg(F.min(F.struct("distance", "ancestor")).alias("x")).select("node", "name", F.col("x.ancestor").alias("origin"), F.col("x.distance").alias("distance"))


def own_members(parents: DataFrame, members: DataFrame) -> DataFrame:
    """Members (owner, name) that none of the owner's ancestors has: what it adds to what it inherits."""
    above = ancestors(parents).where("distance > 0").select(F.col("node").alias("owner"), "ancestor")
    inherited = above.join(members.select(F.col("owner").alias("ancestor"), "name"), "ancestor").select("owner", "name")
    return members.select("owner", "name").distinct().join(inherited, ["owner", "name"], "left_anti")
