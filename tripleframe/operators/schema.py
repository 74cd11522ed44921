"""What a graph looks like: observed patterns, inferred domains and ranges, samples, vocabulary."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripleframe.functions.terms import XSD_NS, local_name, namespace, xsd_name
from tripleframe.model import RDF_TYPE, Mapping
from tripleframe.operators.triplify import MappedTriples, edge_stats, pick
from tripleframe.plans.support import local_frame, union_all


def _mapped_menu(triples: MappedTriples) -> DataFrame:
    target = F.coalesce("o_class", "o_type")
    kind = F.when(F.col("o_class").isNotNull(), "edge").otherwise("literal")
    out = triples.counts().where(F.col("p") != RDF_TYPE).groupBy("s_class", "p", target.alias("target"), kind.alias("kind")).agg(F.sum("n").alias("n"))
    return out.where("n > 0")


def pattern_menu(triples: DataFrame | MappedTriples, labels: DataFrame | None = None) -> DataFrame:
    """Observed patterns: (subject class, predicate, object class or literal type), with counts.

    Of a mapping whose classes have no IRIs in common, where every node's class is known, the tables are counted and no triple is made. Else
    ``triples`` is a set. Facts meet the class of their subject first; literals are then counted away.
    Edges are counted per (object, subject class, predicate) before they meet the class of their object,
    so an object that a third of all edges point to is joined as a few rows.
    """
    if isinstance(triples, MappedTriples) and triples.typed_apart():
        return _with_labels(_mapped_menu(triples), labels)
    types = pick(triples, [RDF_TYPE]).select(F.col("s").alias("node"), F.col("o").alias("cls"))
    facts = triples.only([p for p in triples.predicates() if p != RDF_TYPE]) if isinstance(triples, MappedTriples) else triples.where(F.col("p") != RDF_TYPE)
    facts = facts.select(
        "s", "p", "o_kind", "o_type", F.when(F.col("o_kind") == "iri", F.col("o")).alias("o"))
    mine = types.select(F.col("node").alias("s"), F.col("cls").alias("s_class"))
    theirs = types.select(F.col("node").alias("o"), F.col("cls").alias("o_class"))
    seen = facts.join(mine, "s", "left").groupBy("s_class", "p", "o_kind", "o_type", "o").agg(F.count(F.lit(1)).alias("n"))
    met = seen.join(theirs, "o", "left")
    target = F.when(F.col("o_kind") == "iri", F.col("o_class")).otherwise(F.col("o_type"))
    kind = F.when(F.col("o_kind") == "iri", "edge").otherwise("literal")
    return _with_labels(met.groupBy("s_class", "p", target.alias("target"), kind.alias("kind")).agg(F.sum("n").alias("n")), labels)


def _with_labels(menu: DataFrame, labels: DataFrame | None) -> DataFrame:
    out = menu.withColumn("self_loop", (F.col("kind") == "edge") & F.coalesce(F.col("s_class") == F.col("target"), F.lit(False)))
    if labels is None:
        return out
    return out.join(labels.select(F.col("name").alias("p"), "label"), "p", "left")


def infer_domain_range(m: Mapping) -> DataFrame:
    """Domain and range of every mapped property, from which class owns the templates at its ends."""
    rows = {(m.iri(p), "data", m.iri(cm.name), XSD_NS + xsd_name(x)) for cm in m.classes for p, (_, x) in cm.props.items()}
    rows |= {(m.iri(l.edge.name), "object", m.iri(l.domain.name), m.iri(l.range.name)) for l in m.links}
    cols = list(zip(*sorted(rows))) or [()] * 4
    return local_frame(m.classes[0].df.sparkSession, p=cols[0], kind=cols[1], domain=cols[2], range=cols[3])


def schema_edges(m: Mapping) -> DataFrame:
    """Class-to-class edges (``s``, ``p``, ``o``) of a mapping that hold at least one row."""
    alive = edge_stats(m).where("n_triples > 0").select("mapping")
    edges = infer_domain_range(m).where("kind = 'object'")
    return edges.withColumn("mapping", F.concat(F.lit("map-"), F.lower(local_name("p")))).join(
        alive, "mapping", "left_semi").select(
        local_name("domain").alias("s"), local_name("p").alias("p"), local_name("range").alias("o"))


def observed_domain_range(triples: DataFrame | MappedTriples) -> DataFrame:
    """Classes that subjects and objects of every predicate really have, with counts."""
    side = lambda name, cls: F.struct(F.lit(name).alias("side"), cls.alias("cls"))
    ends = F.when(F.col("kind") == "edge", F.array(side("domain", F.col("s_class")), side("range", F.col("target")))).otherwise(
        F.array(side("domain", F.col("s_class"))))
    return pattern_menu(triples).select("p", "n", F.inline(ends)).groupBy("p", "side", "cls").agg(F.sum("n").alias("n"))


def sample_values(triples: DataFrame, props: list[str]) -> DataFrame:
    """Smallest value of each property and literal type: numbers by value, others as text (which orders dates too).

    Text that is no number though its type says so comes after all numbers.
    """
    number = F.when(F.col("o_type").isin("integer", "long", "short", "decimal", "double", "float"), F.col("o").try_cast("double"))
    least = F.min(F.struct(number.isNull().alias("text"), number.alias("number"), F.col("o")))
    return triples.where(F.col("p").isin(props) & (F.col("o_kind") == "lit")).groupBy("p", "o_type").agg(least.alias("m")).select(
        "p", F.col("m.o").alias("sample"), "o_type")


def namespaces(iris: DataFrame) -> DataFrame:
    """How often each namespace occurs in a one-column frame of IRIs."""
    return iris.toDF("iri").groupBy(namespace("iri").alias("namespace")).agg(F.count(F.lit(1)).alias("n"))


def major_namespace(iris: DataFrame) -> DataFrame:
    """The most frequent namespace, one row; the first by name on a tie."""
    return namespaces(iris).orderBy(F.desc("n"), "namespace").limit(1)


def _substrings(text):
    """All distinct substrings of at least two characters."""
    n = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1)))
    return F.array_distinct(F.flatten(F.transform(
        starts, lambda i: F.transform(F.sequence(F.lit(2), F.greatest(n - i + 1, F.lit(2))),
                                      lambda k: F.substr(text, i, k)))))


def link_terms(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """Link free terms to vocabulary names.

    ``terms`` has one column, ``vocab`` is (``name``, ``label``); a name without a label is its own label.
    In this order: the name itself, a label that only one name has, a single label that contains the
    term or is contained in it (terms of two characters and more); otherwise unlinked. Case is ignored.

    Containment is an equality join on substrings: labels are cut up and grouped, so that a substring
    is one row (how many names have it, and one of them) however common it is, and no pair of term and
    label is ever formed on suspicion.
    """
    t = terms.toDF("term").where(F.trim("term") != "").select("term", F.lower(F.trim("term")).alias("t")).distinct()
    v = vocab.select("name", F.lower(F.trim(F.coalesce(F.nullif(F.trim("label"), F.lit("")), "name"))).alias("l")).distinct()
    by_name = v.groupBy(F.lower("name").alias("t")).agg(F.max("name").alias("by_name"))
    labels = v.groupBy("l").agg(F.count_distinct("name").alias("l_n"), F.min("name").alias("l_name"))
    by_label = labels.where("l_n = 1").select(F.col("l").alias("t"), F.col("l_name").alias("by_label"))
    keys = t.select("t").distinct()
    # Labels that contain the term (or equal it).
    pieces = labels.where(F.length("l") >= 2).select(F.explode(_substrings(F.col("l"))).alias("t"), "l_n", "l_name")
    inside = pieces.join(keys, "t", "left_semi").groupBy("t").agg(
        F.sum("l_n").alias("n"), F.min("l_name").alias("hit"))
    # Labels that are shorter than the term and contained in it.
    cut = keys.where(F.length("t") >= 2).select(
        "t", F.explode(F.array_union(_substrings(F.col("t")), F.array_distinct(F.split("t", "")))).alias("l"))
    around = cut.where(F.length("l") < F.length("t")).join(labels, "l").groupBy("t").agg(
        F.sum("l_n").alias("n"), F.min("l_name").alias("hit"))
    contained = inside.unionByName(around).groupBy("t").agg(F.sum("n").alias("n"), F.min("hit").alias("hit")).where(
        "n = 1").select("t", F.col("hit").alias("by_part"))
    out = t.join(by_name, "t", "left").join(by_label, "t", "left").join(contained, "t", "left")
    rule = (F.when(F.col("by_name").isNotNull(), "name").when(F.col("by_label").isNotNull(), "label")
            .when(F.col("by_part").isNotNull(), "part").otherwise("unlinked"))
    return out.select("term", F.coalesce("by_name", "by_label", "by_part").alias("name"), rule.alias("rule"))


def summary(triples: DataFrame) -> DataFrame:
    """Totals of a graph: triples, and how many per predicate."""
    per = triples.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return union_all([per, per.agg(F.sum("n").alias("n")).select(F.lit("*").alias("p"), "n")])
