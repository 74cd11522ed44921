"""Paths over an edge table (``s``, ``p``, ``o``), which may be a schema graph or data edges.

Each hop is one join; only a path's own nodes, predicates and directions travel with it.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tripleframe.plans.support import BROADCAST_ROWS, broadcast_if_small, cut_lineage, union_all


def pattern_text(nodes: Column, preds: Column, fwd: Column) -> Column:
    """``{A} ->p-> {B} ->^q-> {C}``"""
    steps = F.zip_with(F.zip_with(preds, fwd, lambda p, f: F.concat(F.when(f, "").otherwise("^"), p)),
                       F.slice(nodes, 2, F.size(preds)),
                       lambda p, n: F.concat(F.lit(" ->"), p, F.lit("-> {"), n, F.lit("}")))
    return F.concat(F.lit("{"), F.element_at(nodes, 1), F.lit("}"), F.array_join(steps, ""))


def path_library(edges: DataFrame, h: int = 4, cap: int | None = None, seeds: DataFrame | None = None) -> DataFrame:
    """All simple paths of 1 to ``h`` hops, either way along an edge, ordered by (hops, text).

    All of them by default. ``cap`` keeps the first so many of that order and adds a column ``truncated``, which says on
    every row whether there are more. Since shorter paths come first, the loop can stop
    as soon as the shorter ones alone exceed it. ``seeds`` (one column) restricts where paths start, which
    is how to use it on data edges.
    """
    if h < 1 or (cap is not None and cap < 1):
        raise ValueError("hops and cap start at 1")
    def way(a, b, forward):
        return F.struct(F.col(a).alias("a"), "p", F.col(b).alias("b"), F.lit(forward).alias("f"))

    # A step from a node to itself is on no simple path.
    e = edges.select("s", "p", "o").where("s <> o").distinct()
    step = cut_lineage(e.select(F.inline(F.array(way("s", "o", True), way("o", "s", False)))))
    small_step = step.count() <= BROADCAST_ROWS
    start = step.select(F.col("a").alias("end")).distinct()
    if seeds is not None:
        start = start.join(seeds.toDF("end").distinct(), "end", "left_semi")
    level = start.select(
        "end", F.array("end").alias("nodes"), F.array().cast("array<string>").alias("preds"),
        F.array().cast("array<boolean>").alias("fwd"))
    levels, found, n = [], 0, None
    for hop in range(1, h + 1):
        if small_step:
            step = F.broadcast(step)
        elif n is not None and n <= BROADCAST_ROWS:
            level = F.broadcast(level)
        level = level.join(step, level["end"] == step["a"]).where(~F.array_contains("nodes", F.col("b"))).select(
            F.col("b").alias("end"), F.concat("nodes", F.array("b")).alias("nodes"),
            F.concat("preds", F.array("p")).alias("preds"), F.concat("fwd", F.array("f")).alias("fwd"))
        level = cut_lineage(level)
        n = level.count()
        levels.append(level.select(F.lit(hop).alias("hops"), pattern_text(
            F.col("nodes"), F.col("preds"), F.col("fwd")).alias("pattern"), "nodes", "preds", "fwd"))
        found += n
        if not n or (cap is not None and found > cap):
            break
    out = union_all(levels)
    return out if cap is None else out.orderBy("hops", "pattern").limit(cap).withColumn("truncated", F.lit(found > cap))


def shortest_path(edges: DataFrame, a: str, b: str) -> DataFrame:
    """A shortest directed path from ``a`` to ``b`` by number of hops, as one row; no row if there is none.

    Of several shortest paths the first by (node names, predicates) is taken. Every round keeps a single
    best path per newly reached node, so rows never outnumber nodes.
    """
    spark = edges.sparkSession
    schema = "node string, nodes array<string>, preds array<string>"
    done = "hops int, nodes array<string>, preds array<string>"
    if a == b:
        return spark.createDataFrame([], done)
    # Every round reads all edges, so they are written once instead of being derived again.
    e = cut_lineage(edges.select("s", "p", "o").where("s <> o"))
    frontier = spark.createDataFrame([(a, [a], [])], schema)
    visited, hops = frontier.select("node"), 0
    while True:
        hops += 1
        # While the frontier is small, the edges need no shuffle to meet it.
        near = broadcast_if_small(frontier)
        reached = near.join(e, near["node"] == e["s"]).select(
            F.col("o").alias("next"),
            F.struct(F.concat("nodes", F.array("o")).alias("nodes"),
                     F.concat("preds", F.array("p")).alias("preds")).alias("path"))
        best = reached.groupBy("next").agg(F.min("path").alias("path"))
        frontier = cut_lineage(best.join(visited, best["next"] == visited["node"], "left_anti").select(
            F.col("next").alias("node"), "path.nodes", "path.preds"))
        hit = frontier.where(F.col("node") == b)
        if not hit.isEmpty():
            return hit.select(F.lit(hops).alias("hops"), "nodes", "preds")
        if frontier.isEmpty():
            return spark.createDataFrame([], done)
        visited = visited.union(frontier.select("node"))
        if hops % 8 == 0:
            visited = cut_lineage(visited)


def filter_paths(paths: DataFrame, classes: list[str], preds: list[str],
                 superclasses: DataFrame | None = None) -> DataFrame:
    """Paths that fit required classes and predicates, by the first of these rules that finds any:
    A contains all of both; B contains all classes or all predicates; C touches any of them; D all paths.

    Classes are first joined by their direct superclasses (``child``, ``parent``).
    """
    spark = paths.sparkSession
    cls = set(classes)
    if superclasses is not None and classes:
        rows = superclasses.where(F.col("child").isin(classes)).select("parent").distinct().collect()
        cls |= {r[0] for r in rows}

    def names(xs):
        return F.array(*[F.lit(x) for x in sorted(xs)]).cast("array<string>")

    def inside(xs, col):
        return F.size(F.array_except(names(xs), F.col(col))) == 0

    def touches(xs, col):
        return F.arrays_overlap(names(xs), F.col(col))

    no = F.lit(False)
    all_c, any_c = (inside(cls, "nodes"), touches(cls, "nodes")) if cls else (no, no)
    all_p, any_p = (inside(preds, "preds"), touches(preds, "preds")) if preds else (no, no)
    rule_a = (all_c if cls else F.lit(True)) & (all_p if preds else F.lit(True))
    rule = F.when(rule_a, 1).when(all_c | all_p, 2).when(any_c | any_p, 3).otherwise(4)
    ranked = paths.withColumn("rule", rule)
    best = ranked.agg(F.min("rule").alias("best"))
    # Rule D keeps every path; the others keep what fits them. One row is joined to the paths.
    return ranked.join(F.broadcast(best), F.col("rule") == F.col("best")).drop("best")


def paths_using(paths: DataFrame, preds: list[str]) -> DataFrame:
    """Paths with at least one of the given predicates."""
    return paths.where(F.arrays_overlap("preds", F.array(*[F.lit(p) for p in preds])))
