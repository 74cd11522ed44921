"""Data quality of tables, mappings and triples.

Foreign keys are checked on counts per key: the child table is grouped first, with a partial
aggregate per task, so a key that holds a third of all rows is a handful of rows by the time it is
shuffled. Multiplying the counts gives exactly what a row-by-row outer join would count, including
the repeats that duplicated parent keys cause.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tripleframe.functions import terms
from tripleframe.model import RDF_TYPE, ClassMap, Link, Mapping, Tbox, like
from tripleframe.operators.triplify import MappedTriples
from tripleframe.plans.support import broadcast_if_small, deal, union_all

WARN_BELOW = 0.9


def _count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("bigint")


def _nothing(col: Column) -> Column:
    return F.coalesce(F.sum(col), F.lit(0)).cast("bigint")


def _parents(parent: ClassMap, tag: str) -> DataFrame:
    return parent.df.groupBy(*[F.col(k).alias(f"{tag}{i}") for i, k in enumerate(parent.pk)]).agg(
        F.count(F.lit(1)).alias(f"{tag}n"))


def _with_parent(rows: DataFrame, parent: ClassMap, cols, tag: str) -> DataFrame:
    fit = [like(F.col(c), rows.schema[c].dataType, parent.df.schema[k].dataType) for c, k in zip(cols, parent.pk)]
    return rows.join(_parents(parent, tag), [(F.col(c) if x is None else x) == F.col(f"{tag}{i}") for i, (c, x) in enumerate(zip(cols, fit))], "left")


def _two_counts(a: DataFrame, a_name: str, b: DataFrame, b_name: str) -> DataFrame:
    """Row counts of two frames in one row."""
    counted = a.agg(F.count(F.lit(1)).alias(a_name), F.lit(0).cast("bigint").alias(b_name)).unionByName(
        b.agg(F.lit(0).cast("bigint").alias(a_name), F.count(F.lit(1)).alias(b_name)))
    return counted.agg(F.sum(a_name).alias(a_name), F.sum(b_name).alias(b_name))


# ---------------------------------------------------------------- foreign keys

def _checked(link: Link, side: str) -> list[tuple[str, ClassMap, tuple[str, ...], str]]:
    """(name, parent, key columns, column to order a sample by) of what an edge check looks at."""
    name = link.edge.name
    if link.edge.mode != "junction":
        parent, cols = link.parents[0]
        return [(name, parent, cols, (link.s_cols if link.edge.mode == "domain_fk" else link.o_cols)[0])]
    (a, a_cols), (b, b_cols) = link.parents
    out = [(name, b, b_cols, a_cols[0])]
    return out + [(name + ":domain", a, a_cols, b_cols[0])] if side == "both" else out


def _sample(df: DataFrame, cols: list[str], order: str, n: int) -> DataFrame:
    """The first and the last n/2 rows by a column; other columns break ties."""
    half = max(1, n // 2)
    used = list(dict.fromkeys([order, *cols]))
    rows = df.where(F.col(cols[0]).isNotNull()).select(*used)
    rest = [c for c in used if c != order]
    head = rows.orderBy(F.col(order).asc_nulls_first(), *rest).limit(half)
    tail = rows.orderBy(F.col(order).desc_nulls_last(), *rest).limit(half)
    return head.unionAll(tail)


def fk_hit_rates(m: Mapping, edges: list[str] | None = None, sample_n: int | None = None,
                 side: str = "range") -> DataFrame:
    """Per edge: rows with a foreign key, rows of them that find a parent, rate and verdict.

    ``sample_n`` looks only at the head and tail of the table by key: quick, but blind to dirt in the
    middle. For a junction the range side is checked; ``side="both"`` adds the domain side.
    """
    frames = []
    for link in (x.as_given for x in m.links):
        if edges is not None and link.edge.name not in edges:
            continue
        for name, parent, cols, order in _checked(link, side):
            cols = list(cols)
            rows = link.df.where(F.col(cols[0]).isNotNull()) if sample_n is None \
                else _sample(link.df, cols, order, sample_n)
            keys = rows.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
            joined = _with_parent(keys, parent, cols, "__p")
            frames.append(joined.agg(
                _nothing(F.col("n") * F.coalesce("__pn", F.lit(1))).alias("total"),
                _nothing(F.col("n") * F.col("__pn")).alias("hit"),
            ).select(F.lit(name).alias("edge"), F.lit(link.edge.mode).alias("mode"), "total", "hit"))
    out = union_all(frames)
    rate = F.when(F.col("total") > 0, F.col("hit") / F.col("total"))
    verdict = (F.when(F.col("total") == 0, "empty").when(F.col("hit") == 0, "dead")
               .when(rate < WARN_BELOW, "warn").otherwise("ok"))
    return out.select("edge", "mode", "total", "hit", rate.alias("rate"), verdict.alias("verdict"))


def reconcile_edges(m: Mapping, edges: list[str] | None = None) -> DataFrame:
    """Per edge: rows that take part, rows that became edges, rows with a NULL key, dangling rows.

    ``total`` counts the rows of the outer join, ``kept`` those of the inner join, ``null_key`` outer rows
    with a NULL in any key column of either end; what is left over dangles.
    """
    frames = []
    for link in (x.as_given for x in m.links):
        if edges is not None and link.edge.name not in edges:
            continue
        used = list(dict.fromkeys([*link.s_cols, *link.o_cols]))
        group = list(dict.fromkeys(c for _, cols in link.parents for c in cols))
        any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in used])
        rows = link.df.select(*used).groupBy(*group).agg(
            F.count(F.lit(1)).alias("n"), _count_if(any_null).alias("n_null"))
        outer, inner = F.lit(1), F.lit(1)
        for j, (parent, cols) in enumerate(link.parents):
            rows = _with_parent(rows, parent, cols, f"__p{j}_")
            outer = outer * F.coalesce(f"__p{j}_n", F.lit(1))
            inner = inner * F.coalesce(f"__p{j}_n", F.lit(0))
        frames.append(rows.agg(
            _nothing(F.col("n") * outer).alias("total"), _nothing(F.col("n") * inner).alias("kept"),
            _nothing(F.col("n_null") * outer).alias("null_key"),
        ).select(F.lit(f"map-{link.edge.name.lower()}").alias("mapping"), F.lit(link.edge.name).alias("edge"),
                 "total", "kept", "null_key",
                 (F.col("total") - F.col("kept") - F.col("null_key")).alias("dangling")))
    return union_all(frames)


# ---------------------------------------------------------------- literals

def _flat(cm: ClassMap) -> dict[str, str]:
    """Distinct mapped columns of a class that hold plain values, with their declared types."""
    nested = (T.ArrayType, T.MapType, T.StructType, T.BinaryType)
    return {c: x for c, x in cm.props.values() if not isinstance(cm.df.schema[c].dataType, nested)}


def _long(cm: ClassMap) -> DataFrame:
    """(column, v) rows of all mapped columns."""
    cells = [F.struct(F.lit(c).alias("column"), _shown(cm, c, x).alias("v")) for c, x in _flat(cm).items()]
    return cm.df.select(F.inline(F.array(*cells)))


def _shown(cm: ClassMap, col: str, xsd: str) -> Column:
    return terms.lexical(F.col(col), xsd, cm.df.schema[col].dataType)


def profile_literals(m: Mapping, top: int = 3) -> DataFrame:
    """Per mapped column: rows, NULLs, blanks and the most frequent values.

    Counts come from one aggregate over each table. Frequent values are counted per (column, value) with
    partial aggregates; the ranking keeps ``top`` rows per column in every task before it shuffles, so a
    column of distinct values is never gathered in one place.
    """
    totals, values = [], []
    for cm in m.classes:
        flat = _flat(cm)
        if not flat:
            continue
        mid = f"map-{cm.name.lower()}"
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(flat):
            shown = _shown(cm, c, flat[c])
            text = isinstance(cm.df.schema[c].dataType, T.StringType)
            aggs.append(_count_if(F.col(c).isNull()).alias(f"null{i}"))
            aggs.append((_count_if(F.trim(shown, F.lit(" \t\n\r\f\v")) == "") if text
                         else F.lit(0).cast("bigint")).alias(f"blank{i}"))
        one = cm.df.select(*flat).agg(*aggs)
        cells = [F.struct(F.lit(c).alias("column"), F.lit(terms.xsd_name(flat[c])).alias("xsd"),
                          F.col(f"null{i}").alias("null"), F.col(f"blank{i}").alias("blank"))
                 for i, c in enumerate(flat)]
        totals.append(one.select(F.lit(mid).alias("mapping"), "rows", F.inline(F.array(*cells))))
        values.append(_long(cm).select(F.lit(mid).alias("mapping"), "column", "v"))
    total = union_all(totals)
    if not values:
        return total
    counts = union_all(values).where(F.trim("v", F.lit(" \t\n\r\f\v")) != "").groupBy("mapping", "column", "v").agg(
        F.count(F.lit(1)).alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(
        Window.partitionBy("mapping", "column").orderBy(F.desc("n"), F.asc("v")))).where(F.col("rank") <= top)
    best = ranked.groupBy("mapping", "column").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "v", "n"))),
                    lambda t: F.concat(t["v"], F.lit(" x"), t["n"].cast("string"))).alias("top"))
    return total.join(best, ["mapping", "column"], "left").select(
        "mapping", "column", "xsd", "rows", "null", "blank",
        F.coalesce(F.array_join("top", "; "), F.lit("")).alias("top"))


def top_values(m: Mapping, top: int = 3) -> DataFrame:
    """The most frequent values of every mapped column, one row each."""
    frames = [_long(cm).select(F.lit(f"map-{cm.name.lower()}").alias("mapping"), "column", "v")
              for cm in m.classes if _flat(cm)]
    counts = union_all(frames).where(F.trim("v", F.lit(" \t\n\r\f\v")) != "").groupBy("mapping", "column", "v").agg(
        F.count(F.lit(1)).alias("n"))
    return counts.withColumn("rank", F.row_number().over(
        Window.partitionBy("mapping", "column").orderBy(F.desc("n"), F.asc("v")))).where(F.col("rank") <= top)


def audit_notes(m: Mapping) -> DataFrame:
    """What the audits leave out, and how many rows that concerns: nested columns and skipped edges."""
    frames = []
    for cm in m.classes:
        flat = _flat(cm)
        for prop, (col, _) in cm.props.items():
            if col not in flat:
                frames.append(cm.df.agg(F.count(F.lit(1)).alias("rows")).select(
                    F.lit(f"map-{cm.name.lower()}").alias("mapping"),
                    F.lit(f"column {col} of {prop} is nested and cannot be profiled").alias("note"), "rows"))
    spark = m.classes[0].df.sparkSession
    if m.warnings:
        frames.append(spark.createDataFrame([(w.split(":")[0], w, None) for w in m.warnings],
                                            "mapping string, note string, rows bigint"))
    return union_all(frames) if frames else spark.createDataFrame([], "mapping string, note string, rows bigint")


def type_conformance(m: Mapping) -> DataFrame:
    """Per mapped column: values that are not NULL but cannot be read as the declared type."""
    frames = []
    for cm in m.classes:
        flat = _flat(cm)
        if not flat:
            continue
        aggs = []
        for i, (c, x) in enumerate(flat.items()):
            bad = F.col(c).isNotNull() & F.col(c).cast("string").try_cast(terms.value_type(x)).isNull()
            aggs += [F.count(c).alias(f"v{i}"), _count_if(bad).alias(f"b{i}")]
        cells = [F.struct(F.lit(c).alias("column"), F.lit(terms.xsd_name(x)).alias("xsd"),
                          F.lit(xsd_of(cm, c)).alias("column_type"),
                          F.col(f"v{i}").alias("values"), F.col(f"b{i}").alias("bad"))
                 for i, (c, x) in enumerate(flat.items())]
        frames.append(cm.df.select(*flat).agg(*aggs).select(
            F.lit(f"map-{cm.name.lower()}").alias("mapping"), F.inline(F.array(*cells))))
    return union_all(frames)


def xsd_of(cm: ClassMap, col: str) -> str | None:
    from tripleframe.operators.triplify import xsd_for
    kind = xsd_for(cm.df.schema[col].dataType.simpleString())
    return terms.xsd_name(kind) if kind else None


# ---------------------------------------------------------------- IRIs

def iri_overlap(m: Mapping) -> DataFrame:
    """IRIs that several classes give, or one class gives more than once.

    Keys are counted per class first, so a key repeated across a third of a table is one row per task. Only
    classes whose IRIs can meet are compared as text; for the others a repeat shows in the key itself.
    Text is dealt to tasks by the number of rows, so that a task's groups do not grow with the tables.
    """
    alone, together, size = [], [], 0
    for cm in m.classes:
        keys = [f"k{i}" for i in range(len(cm.pk))]
        counts = cm.df.select(*[F.col(k).alias(a) for k, a in zip(cm.pk, keys)]).dropna().groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n"))
        tpl = m.template(cm)
        apart = all(tpl.disjoint(m.template(o)) for o in m.classes if o is not cm) and tpl.injective(cm.dtypes(cm.pk))
        if apart:
            counts = counts.where("n > 1")
        named = counts.select(m.subject(cm, keys, counts).alias("s"), F.lit(cm.name).alias("cls"), "n")
        (alone if apart else together).append(named)
        size += 0 if apart else cm.df.count()
    out = [f.select("s", F.col("cls").alias("classes"), F.col("n").alias("rows"), F.col("n").alias("max_per_class"))
           for f in alone]
    if together:
        per_class = deal(union_all(together), size, "s").groupBy("s", "cls").agg(F.sum("n").alias("n"))
        per_iri = per_class.groupBy("s").agg(
            F.array_join(F.sort_array(F.collect_set("cls")), ",").alias("classes"),
            F.sum("n").alias("rows"), F.max("n").alias("max_per_class"))
        out.append(per_iri.where((F.instr("classes", ",") > 0) | (F.col("max_per_class") > 1)))
    return union_all(out)


def iri_overlap_summary(m: Mapping) -> DataFrame:
    """Overlapping IRIs counted per set of classes."""
    return iri_overlap(m).groupBy("classes").agg(
        F.count(F.lit(1)).alias("iris"), F.sum("rows").cast("bigint").alias("rows"))


def iri_path_conflicts(m: Mapping, sub_class: list[tuple[str, str]]) -> DataFrame:
    """Per (child, parent) class: child instances whose IRI the parent class does not have.

    With equal templates the raw keys are compared; different templates conflict for every instance.
    """
    frames = []
    for child, parent in sub_class:
        a, b = m.by_name.get(child), m.by_name.get(parent)
        if a is None or b is None:
            continue
        kids = a.df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(a.pk)]).dropna().distinct()
        tops = b.df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(b.pk)]).dropna()
        if m.template(a) == m.template(b):
            lost = kids.join(tops, kids.columns, "left_anti")
        elif m.template(a).disjoint(m.template(b)):
            lost = kids
        else:
            render = lambda cm, d: d.select(m.subject(cm, d.columns, d).alias("s"))
            lost = render(a, kids).join(render(b, tops), "s", "left_anti")
        frames.append(_two_counts(kids, "instances", lost, "missing").select(
            F.lit(child).alias("child"), F.lit(parent).alias("parent"),
            F.lit(a.path == b.path).alias("same_path"), "instances", "missing"))
    return union_all(frames)


# ---------------------------------------------------------------- graph against ontology

def _used_names(triples: DataFrame) -> DataFrame:
    """Distinct (predicate, class of a type triple): a schema's worth of rows, from one pass."""
    return triples.groupBy("p", F.when(F.col("p") == RDF_TYPE, F.col("o")).alias("cls")).agg(F.count(F.lit(1)).alias("n"))


def coverage(triples: DataFrame | MappedTriples, tbox: Tbox) -> DataFrame:
    """Declared classes and properties that no triple uses; a property is also used by its inverse.

    For a mapping nothing is written out: its outputs are counted on the tables.
    """
    inv = tbox.inverse.toDF("a", "b")
    both = inv.union(inv.select("b", "a"))
    seen = triples.counts().where("n > 0").select("p", F.when(F.col("p") == RDF_TYPE, F.col("o_class")).alias("cls")) if isinstance(triples, MappedTriples) else _used_names(triples)
    names = seen.select(F.explode(F.array("p", "cls")).alias("name")).where("name is not null")
    used = names.join(both, names["name"] == both["a"], "left").select(
        F.explode(F.array("name", "b")).alias("name")).where("name is not null").distinct()
    declared = tbox.classes.select(F.lit("class").alias("kind"), F.col("cls").alias("name")).union(
        tbox.properties.select(F.lit("property"), "prop")).distinct()
    # An anti join would be pushed into both parts of the declared names, and the triples read for each.
    return declared.join(used.withColumn("used", F.lit(True)), "name", "left").where("used is null").select("kind", "name")


def inverse_duplicates(triples: DataFrame, inverse: DataFrame) -> DataFrame:
    """Pairs of statements that say the same thing under a property and under its inverse."""
    from tripleframe.operators.reason import canonical_pairs
    pairs = broadcast_if_small(canonical_pairs(inverse, *inverse.columns[:2]))
    rows = triples.where("o_kind = 'iri'").select("s", "p", "o")
    left = rows.join(pairs, rows["p"] == pairs["a"]).select("s", "p", "o", F.col("b").alias("inverse"))
    backward = pairs.select(F.col("b").alias("p")).distinct()
    right = rows.join(backward, "p", "left_semi").select(
        F.col("o").alias("s"), F.col("p").alias("inverse"), F.col("s").alias("o"))
    return left.join(right, ["s", "inverse", "o"]).select("s", "p", "o", "inverse")


def graph_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Triples that were added or removed between two snapshots; one shuffle of both sides.

    Each side is grouped with a flag instead of being joined twice.
    """
    cols = ["s", "p", "o", "o_kind", "o_type"]
    both = old.select(*cols, F.lit(1).alias("is_old"), F.lit(0).alias("is_new")).unionByName(
        new.select(*cols, F.lit(0).alias("is_old"), F.lit(1).alias("is_new")))
    sides = both.groupBy(*cols).agg(F.max("is_old").alias("was"), F.max("is_new").alias("is"))
    return sides.where(F.col("was") != F.col("is")).select(
        F.when(F.col("is") == 1, "added").otherwise("removed").alias("change"), *cols)


def tbox_diff(old: Tbox, new: Tbox) -> DataFrame:
    """Classes and properties added or removed, and properties whose domain or range changed."""
    def ends(t: Tbox, part: str) -> DataFrame:
        return t.frames[part].groupBy("prop").agg(
            F.array_join(F.sort_array(F.collect_set("cls")), ",").alias(part))

    def shape(t: Tbox) -> DataFrame:
        props = t.properties.select(F.lit("property").alias("kind"), F.col("prop").alias("name")).distinct()
        props = props.join(ends(t, "domain").withColumnRenamed("prop", "name"), "name", "left").join(
            ends(t, "range").withColumnRenamed("prop", "name"), "name", "left")
        shown = F.concat(F.coalesce("domain", F.lit("")), F.lit(" -> "), F.coalesce("range", F.lit("")))
        none = F.lit(None).cast("string")
        return props.select("kind", "name", shown.alias("ends")).union(
            t.classes.select(F.lit("class"), "cls", none).distinct())

    a = shape(old).withColumnRenamed("ends", "old_ends")
    b = shape(new).withColumnRenamed("ends", "new_ends")
    j = a.withColumn("was", F.lit(True)).join(b.withColumn("is", F.lit(True)), ["kind", "name"], "full")
    change = (F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed")
              .when(~F.col("old_ends").eqNullSafe(F.col("new_ends")), "changed"))
    return j.select(change.alias("change"), "kind", "name", "old_ends", "new_ends").where("change is not null")


def _ns(col: str) -> Column:
    return F.when(F.instr(col, "#") > 0, F.substring_index(col, "#", 1)).otherwise(
        F.regexp_extract(col, "^(.*)/", 1))


def namespace_check(triples: DataFrame, tbox: Tbox) -> DataFrame:
    """Namespaces that subjects and predicates use, how often, and whether the ontology has them."""
    used = triples.where(~F.col("s").startswith("_:")).groupBy(_ns("s").alias("namespace")).agg(
        F.count(F.lit(1)).alias("n")).union(
        triples.groupBy(_ns("p").alias("namespace")).agg(F.count(F.lit(1)).alias("n")))
    used = used.groupBy("namespace").agg(F.sum("n").alias("n"))
    own = tbox.classes.select(_ns("cls").alias("namespace")).union(
        tbox.properties.select(_ns("prop").alias("namespace"))).distinct().withColumn("known", F.lit(True))
    return used.join(own, "namespace", "left").select(
        "namespace", "n", F.coalesce("known", F.lit(False)).alias("in_ontology"))


def label_coverage(labels: DataFrame, pattern: str, warn_above: float = 0.2) -> DataFrame:
    """Entities in total, entities without a label that matches ``pattern``, and whether to warn.

    ``labels`` is (``entity``, ``label``), a NULL label for an entity that has none. An entity counts as
    labelled when any one of its labels matches.
    """
    per = labels.groupBy("entity").agg(F.max(F.coalesce(F.col("label").rlike(pattern), F.lit(False))).alias("ok"))
    out = per.agg(F.count(F.lit(1)).alias("total"), _count_if(~F.col("ok")).alias("missing"))
    share = F.when(F.col("total") > 0, F.col("missing") / F.col("total"))
    return out.select("total", "missing", F.coalesce(share > warn_above, F.lit(False)).alias("warn"))


def reconcile_counts(expected: DataFrame, stored: DataFrame) -> DataFrame:
    """Whether a store holds exactly the triples it should: ``empty``, ``match`` or ``mismatch``."""
    state = (F.when(F.col("expected") == 0, "empty").when(F.col("expected") == F.col("stored"), "match")
             .otherwise("mismatch"))
    return _two_counts(expected, "expected", stored, "stored").select("expected", "stored", state.alias("state"))


def expect(actual: DataFrame, cases: list[tuple[str, int]]) -> DataFrame:
    """Acceptance table: ``actual`` is (``name``, ``n``); a case that is not in it counts as 0."""
    wanted = actual.sparkSession.createDataFrame(cases, "name string, expected bigint")
    return expect_frame(actual, wanted)


def expect_frame(actual: DataFrame, wanted: DataFrame) -> DataFrame:
    got = F.coalesce("n", F.lit(0)).cast("bigint")
    return wanted.join(actual.select("name", "n"), "name", "left").select(
        "name", "expected", got.alias("actual"),
        F.when(got == F.col("expected"), "PASS").otherwise("FAIL").alias("verdict"))


def lint_graph(triples: DataFrame) -> DataFrame:
    """Findings on triples: dangling objects, class or property names that differ only in case, and
    properties with several value types.

    One row per finding with how many triples or spellings it concerns. The triples are read once: every one says what it shows of its nodes,
    names and type, which is counted per node, name and type, and then per finding.
    """
    is_type, is_iri = F.col("p") == RDF_TYPE, F.col("o_kind") == "iri"

    def shown(what: str, a: Column, b: Column, known: Column, uses: Column) -> Column:
        return F.struct(F.lit(what).alias("what"), a.alias("a"), b.alias("b"), known.cast("int").alias("known"), uses.cast("int").alias("uses"))

    none, zero = F.lit(None).cast("string"), F.lit(0)
    cells = F.array(
        shown("dangling_object", F.col("s"), none, F.lit(1), zero),
        F.when(is_iri & ~is_type, shown("dangling_object", F.col("o"), none, zero, F.lit(1))),
        shown("same_up_to_case", F.col("p"), none, zero, zero),
        F.when(is_type, shown("same_up_to_case", F.col("o"), none, zero, zero)),
        F.when(~is_iri, shown("mixed_value_types", F.col("p"), F.coalesce("o_type", F.lit("")), zero, zero)))
    seen = triples.select(F.inline(F.filter(cells, lambda c: c.isNotNull()))).where("a is not null").groupBy("what", "a", "b").agg(F.max("known").alias("known"), F.sum("uses").alias("uses"))
    subject = F.when(F.col("what") == "same_up_to_case", F.lower("a")).otherwise(F.col("a"))
    found = seen.groupBy(F.col("what").alias("finding"), subject.alias("subject")).agg(
        F.max("known").alias("known"), F.sum("uses").alias("uses"), F.count(F.lit(1)).alias("spellings"))
    dangling = F.col("finding") == "dangling_object"
    return found.where(F.when(dangling, (F.col("known") == 0) & (F.col("uses") > 0)).otherwise(F.col("spellings") > 1)).select(
        "finding", "subject", F.when(dangling, F.col("uses")).otherwise(F.col("spellings")).alias("n"))


# Fixed value: endings of column names that look like identifiers, besides the plain name "id".
IDENTIFIER_ENDINGS = ("Id", "ID", "_id", "Code", "Number", "No")


def _named_like_key(name: Column) -> Column:
    """Whether a column of names holds an identifier's: the plain name in any case, or an ending with something in front."""
    bare = F.trim(name)
    return (F.lower(bare) == "id") | (F.length(bare) >= 3) & bare.rlike(f"({'|'.join(IDENTIFIER_ENDINGS)})$")


def candidate_keys(df: DataFrame) -> DataFrame:
    """Per flat column: whether it could be a key by name, by type, and by its values.

    Distinct counts are exact. They are taken by counting rows per (column, value), which spreads over
    all values; one aggregate with many distinct counts would expand every row on every task instead.
    """
    plain = [f for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    cells = [F.struct(F.lit(f.name).alias("column"), F.col(f.name).cast("string").alias("v")) for f in plain]
    per_value = df.select(F.inline(F.array(*cells))).groupBy("column", "v").agg(F.count(F.lit(1)).alias("n"))
    out = per_value.groupBy("column").agg(
        F.sum("n").cast("bigint").alias("rows"),
        _nothing(F.when(F.col("v").isNull(), F.col("n"))).alias("nulls"),
        F.count("v").alias("distinct"))
    good = [f.name for f in plain if isinstance(f.dataType, (T.StringType, T.IntegralType))]
    typed, named = F.col("column").isin(good), _named_like_key(F.col("column"))
    unique = (F.col("nulls") == 0) & (F.col("distinct") == F.col("rows"))
    return out.select("column", "rows", "nulls", "distinct", (typed & named).alias("name_says_key"),
                      (typed & unique).alias("values_say_key"))
