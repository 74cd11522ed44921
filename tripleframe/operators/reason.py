"""RDFS-style reasoning over triples and hierarchies.

The ontology side of every join is small in practice; its size is checked before it is broadcast.
Rules look only at the triples they are given: no rule feeds another.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe.functions.terms import XSD_NS
from tripleframe.model import RDF_TYPE, TRIPLE_COLS, Tbox
from tripleframe.operators.triplify import MappedTriples, pick
from tripleframe.plans.support import broadcast_if_small, cut_lineage, union_all

# Trimming stops when a round removes a smaller share of the edges than this.
TRIM_SHARE = 0.1


def closure(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """All (child, ancestor) pairs of a hierarchy; on a cycle a node is its own ancestor.

    Distances double: pairs that are exactly ``reach`` steps apart are extended by everything known, so
    a hierarchy of depth d takes log2(d) rounds and each pair is built once per middle node. The loop
    keeps only what is new, so it ends on cycles too.
    """
    known = cut_lineage(edges.select(F.col(child).alias("child"), F.col(parent).alias("ancestor"))
                        .where("child is not null and ancestor is not null").distinct()
                        .withColumn("d", F.lit(1)))
    reach = 1
    while True:
        far = known.where(F.col("d") == reach).select("child", F.col("ancestor").alias("mid"))
        onward = known.select(F.col("child").alias("mid"), "ancestor", (F.col("d") + reach).alias("d"))
        reached = far.join(onward, "mid").groupBy("child", "ancestor").agg(F.min("d").alias("d"))
        new = cut_lineage(reached.join(known.select("child", "ancestor"), ["child", "ancestor"], "left_anti"))
        if new.isEmpty():
            return known.select("child", "ancestor")
        known = known.unionByName(new)
        reach *= 2


def find_cycles(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """Nodes that are their own ancestors.

    Where every node has one parent, or every parent one child, steps are doubled, and the rows of a round are at most the edges. Else nodes
    without parents or without children, which cannot be on a cycle, are trimmed while that removes a fair share; the closure is computed only on
    what is left, which for a sound hierarchy is nothing.
    """
    core = cut_lineage(edges.select(F.col(child).alias("child"), F.col(parent).alias("parent"))
                       .where("child is not null and parent is not null").distinct())
    size = core.count()
    for a, b in (("child", "parent"), ("parent", "child")):
        if core.select(a).distinct().count() == size:
            return _on_cycles(core.select(F.col(a).alias("child"), F.col(b).alias("parent")), size)
    while size:
        kids = core.select(F.col("child").alias("parent")).distinct()
        tops = core.select(F.col("parent").alias("child")).distinct()
        core = cut_lineage(core.join(kids, "parent", "left_semi").join(tops, "child", "left_semi")
                           .select("child", "parent"))
        left, before = core.count(), size
        size = left
        if before - left < before * TRIM_SHARE:
            break
    if not size:
        return core.select(F.col("child").alias("node"))
    return closure(core).where("child = ancestor").select(F.col("child").alias("node"))


def _on_cycles(steps: DataFrame, size: int) -> DataFrame:
    """Nodes on cycles where every child has one parent.

    A round goes twice as far as the one before and keeps nodes that are reached from kept ones and can go on; when none is lost, going that far
    maps the kept nodes onto themselves, so that all are on cycles. Tails of length d take log2(d) rounds, and what is kept shrinks.
    """
    while size:
        onward = steps.select(F.col("child").alias("parent"), F.col("parent").alias("far"))
        reached = steps.select(F.col("parent").alias("child")).distinct()
        steps = cut_lineage(steps.join(onward, "parent").join(reached, "child", "left_semi").select("child", F.col("far").alias("parent")))
        left, before = steps.count(), size
        size = left
        if left == before:
            break
    return steps.select(F.col("child").alias("node"))


def _typed(node, cls) -> list:
    return [node.alias("s"), F.lit(RDF_TYPE).alias("p"), cls.alias("o"), F.lit("iri").alias("o_kind"),
            F.lit(None).cast("string").alias("o_type")]


def widen_types(triples: DataFrame | MappedTriples, tbox: Tbox) -> DataFrame:
    """Type triples that follow from subclass axioms: an instance of a class is one of all its ancestors."""
    up = broadcast_if_small(closure(tbox.sub_class))
    typed = pick(triples, [RDF_TYPE])
    return typed.join(up, typed["o"] == up["child"]).select(*_typed(F.col("s"), F.col("ancestor"))).distinct()


def widen_edges(triples: DataFrame | MappedTriples, tbox: Tbox, literals: bool = False) -> DataFrame:
    """Triples under all super-properties; object properties only, unless ``literals`` is set."""
    up = broadcast_if_small(closure(tbox.sub_prop))
    rows = pick(triples, up.select("child"), None if literals else "iri")
    return rows.join(up, rows["p"] == up["child"]).select(
        "s", F.col("ancestor").alias("p"), "o", "o_kind", "o_type").dropDuplicates(TRIPLE_COLS)


def _declared(tbox: Tbox, part: str) -> DataFrame:
    """Domain or range axioms that name classes; undeclared ones are ignored when classes are declared."""
    axioms = tbox.frames[part].where(~F.col("cls").startswith(XSD_NS)).distinct()
    if tbox.classes.isEmpty():
        return axioms
    return axioms.join(tbox.classes.select("cls").distinct(), "cls", "left_semi")


def type_by_domain(triples: DataFrame | MappedTriples, tbox: Tbox) -> DataFrame:
    """The subject of a property belongs to the property's domain class."""
    dom = broadcast_if_small(_declared(tbox, "domain"))
    rows = pick(triples, dom.select("prop"))
    return rows.join(dom, rows["p"] == dom["prop"]).select(*_typed(F.col("s"), F.col("cls"))).distinct()


def type_by_range(triples: DataFrame | MappedTriples, tbox: Tbox) -> DataFrame:
    """The object of an object property belongs to the property's range class."""
    rng = broadcast_if_small(_declared(tbox, "range"))
    rows = pick(triples, rng.select("prop"), "iri")
    return rows.join(rng, rows["p"] == rng["prop"]).select(*_typed(F.col("o"), F.col("cls"))).distinct()


def inverse_edges(triples: DataFrame | MappedTriples, inverse: DataFrame) -> DataFrame:
    """Triples of each property's inverse, in both directions of the axiom."""
    pairs = canonical_pairs(inverse, *inverse.columns[:2])
    both = broadcast_if_small(pairs.select("a", "b").union(pairs.select("b", "a")).toDF("prop", "inv"))
    rows = pick(triples, both.select("prop"), "iri")
    return rows.join(both, rows["p"] == both["prop"]).select(
        F.col("o").alias("s"), F.col("inv").alias("p"), F.col("s").alias("o"), "o_kind", "o_type").distinct()


def widen(triples: DataFrame | MappedTriples, tbox: Tbox) -> DataFrame:
    """Triples plus everything the four rules add, as a set.

    Only triples under a predicate that a rule can produce are compared; all others pass through
    without a shuffle.
    """
    added = union_all([f(triples, tbox) for f in (widen_types, widen_edges, type_by_domain, type_by_range)])
    made = broadcast_if_small(
        closure(tbox.sub_prop).select(F.col("ancestor").alias("p")).distinct()
        .union(tbox.spark.createDataFrame([(RDF_TYPE,)], "p string")))
    if isinstance(triples, MappedTriples):
        names = {r.p for r in made.where(F.col("p").isin(triples.predicates())).collect()}
        touched, rest = triples.only(sorted(names)), triples.only([p for p in triples.predicates() if p not in names])
    else:
        touched = triples.join(made, "p", "left_semi").select(*TRIPLE_COLS)
        rest = triples.join(made, "p", "left_anti").select(*TRIPLE_COLS)
    return rest.unionByName(touched.unionByName(added).dropDuplicates(TRIPLE_COLS))


def canonical_pairs(df: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Each pair of a symmetric axiom once, smaller name first; pairs with itself are left out."""
    return df.where(F.col(a) != F.col(b)).select(
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()


def disjoint_pairs(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """Which of the given class pairs are disjoint because some list of disjoint classes holds both.

    A list of n classes stands for n(n-1)/2 pairs. They are looked up, never written out: ``lists`` is
    (``list_id``, ``cls``), ``pairs`` is (``a``, ``b``).
    """
    members = lists.select("list_id", "cls").distinct()
    left = members.select("list_id", F.col("cls").alias("a"))
    right = members.select("list_id", F.col("cls").alias("b"))
    asked = canonical_pairs(pairs)
    return asked.join(left, "a").join(right, ["list_id", "b"]).select("a", "b").distinct()


def disjoint_violations(types: DataFrame, lists: DataFrame) -> DataFrame:
    """Instances that belong to more than one class of a list of disjoint classes.

    ``types`` is (``s``, ``cls``). Memberships are grouped per instance, so no pair is ever built.
    """
    hits = types.select("s", "cls").distinct().join(lists.select("list_id", "cls").distinct(), "cls")
    return hits.groupBy("list_id", "s").agg(F.count(F.lit(1)).alias("n_classes"),
                                            F.min("cls").alias("first_class"),
                                            F.max("cls").alias("last_class")).where("n_classes > 1")
