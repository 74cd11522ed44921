"""The plans are the ones wanted: what is read, what is shuffled, what is never built."""
import re

import pytest
from pyspark.sql import functions as F

from suite.tables import NS, mapping, tbox
from tripleframe import Graph, Literal, Mapping, materialize
from tripleframe.operators import audit
from tripleframe.operators.triplify import edge_keys, link_of

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def schemas(text):
    return re.findall(r"ReadSchema: struct<([^>]*)>", text)


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_unique_classes_are_written_without_a_shuffle(spark):
    m = mapping(spark, SF, ["Customer", "Order", "Event", "Part"], [])
    text = plan(materialize(m))
    assert "Exchange" not in text and "Aggregate" not in text
    assert text.count("Scan parquet") == 4


def test_overlapping_classes_compare_only_what_overlaps(spark):
    text = plan(materialize(mapping(spark, SF, ["Order", "UrgentOrder"], []), tbox(spark)))
    # The literals of orders pass through; one shuffle for the triples that say "is an order".
    assert text.count("Exchange hashpartitioning") == 1


def test_match_reads_two_columns_per_table(spark):
    g = Graph.virtual(mapping(spark, SF))
    text = plan(g.match(("?o", "placedBy", "?c"), ("?c", "segment", "?seg")).groupBy("seg").count())
    assert sorted(schemas(text)) == ["c_custkey:bigint,c_mktsegment:string", "o_orderkey:bigint,o_custkey:bigint"]
    assert "concat" not in text and "url_encode" not in text


def test_star_is_one_scan(spark):
    g = Graph.virtual(mapping(spark, SF))
    text = plan(g.match(("?x", "a", "Part"), ("?x", "brand", "?b"), ("?x", "size", "?s"), ("?x", "price", "?p")))
    assert text.count("Scan parquet") == 1 and "Join" not in text


def test_parent_is_not_joined_twice(spark):
    g = Graph.virtual(mapping(spark, SF))
    text = plan(g.match(("?o", "placedBy", "?c"), ("?c", "customerNation", "?n"), ("?n", "nationName", "?name")))
    assert text.count("Scan parquet") == 3
    assert plan(g.match(("?o", "placedBy", "?c"))).count("LeftSemi") == 1


def test_constants_reach_the_scan(spark):
    g = Graph.virtual(mapping(spark, SF))
    assert "EqualTo(o_custkey,7)" in plan(g.match(("?o", "placedBy", f"{NS}customer/7")))
    assert "EqualTo(c_mktsegment,BUILDING)" in plan(g.match(("?c", "segment", Literal("BUILDING"))))
    assert "Scan parquet" not in plan(g.match(("?o", "placedBy", f"{NS}supplier/7")))


def test_typed_filter_is_on_the_raw_column(spark):
    g = Graph.virtual(mapping(spark, SF))
    text = plan(g.match(("?p", "size", "?s"), typed={"s": "integer"}).where("s > 40"))
    assert "GreaterThan(p_size,40)" in text


def test_ranking_is_cut_before_it_is_shuffled(spark):
    m = mapping(spark, SF, ["Order", "Event"], [])
    for text in (plan(audit.profile_literals(m)), plan(audit.top_values(m))):
        first = text[text.rindex("WindowGroupLimit"):]
        assert "Partial" in first


def test_counts_per_key_are_partial(spark, no_broadcast):
    text = plan(audit.fk_hit_rates(mapping(spark, SF, ["Order", "Customer"], ["placedBy"])))
    assert "partial_count" in text and "Cartesian" not in text and "NestedLoop" not in text


def test_pairs_are_made_distinct_before_text(spark, no_broadcast):
    m = mapping(spark, SF, ["Order", "Part"], ["containsPart"])
    text = plan(edge_keys(link_of(m, "containsPart")))
    assert "concat" not in text
    assert text.count("Exchange hashpartitioning(l_orderkey") >= 1


def test_no_case_pairs_everything(spark, no_broadcast):
    import __spark_entry__ as entry
    quick = [n for n in entry.queries() if n[0] in "TQA" and n not in ("A11_inverse_duplicates",)]
    for name in quick:
        text = plan(entry.queries()[name](spark, SF))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_wanted_predicates_prune_tables(spark):
    m = mapping(spark, SF)
    text = plan(materialize(m, preds=["segment"]))
    assert schemas(text) == ["c_custkey:bigint,c_mktsegment:string"]
    assert materialize(Mapping(NS, m.classes), preds=["none"]).count() == 0


def scans(df):
    return plan(df).count("Scan parquet")


def test_unmade_triples_read_only_what_is_asked_for(spark):
    from tripleframe import MappedTriples
    from tripleframe.operators import reason, schema
    m, ontology = mapping(spark, SF), tbox(spark)
    lazy, whole = MappedTriples(m), materialize(m)
    tables = 12  # of the mapping
    for preds in (["segment"], ["placedBy"], ["a"], ["segment", "containsPart"]):
        assert scans(lazy.only(preds)) == scans(materialize(m, preds=preds)) < scans(whole)
    g, stored = Graph.materialized(lazy, NS), Graph.materialized(whole, NS)
    patterns = [("?o", "placedBy", "?c"), ("?c", "segment", "?s"), ("?o", "total", "?t")]
    assert scans(g.match(*patterns)) == 4 and g.match(*patterns).exceptAll(stored.match(*patterns)).isEmpty()
    assert g.count_by(["s"], *patterns).exceptAll(stored.count_by(["s"], *patterns)).isEmpty()
    assert g.match(("?s", "?p", f"{NS}nation/3")).exceptAll(stored.match(("?s", "?p", f"{NS}nation/3"))).isEmpty()
    for rule in (reason.widen_types, reason.widen_edges, reason.type_by_domain, reason.type_by_range):
        few, many = rule(lazy, ontology), rule(whole, ontology)
        assert scans(few) <= 2 * tables < scans(many)
        assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()
    assert reason.widen(lazy, ontology).exceptAll(reason.widen(whole, ontology)).isEmpty()
    assert reason.inverse_edges(lazy, ontology.inverse).exceptAll(reason.inverse_edges(whole, ontology.inverse)).isEmpty()
    few = audit.coverage(lazy, ontology)
    assert scans(few) <= 2 * tables and sorted(few.collect()) == sorted(audit.coverage(whole, ontology).collect())
    apart = mapping(spark, SF, ["Customer", "Nation", "Region", "Order"])
    few, many = schema.pattern_menu(MappedTriples(apart)), schema.pattern_menu(materialize(apart))
    assert scans(few) <= 2 * 4 and "concat" not in plan(few) and sorted(few.select(many.columns).collect()) == sorted(many.collect())
    few, many = schema.pattern_menu(lazy), schema.pattern_menu(whole)  # orders and urgent orders share IRIs
    assert few.exceptAll(many).isEmpty() and many.exceptAll(few).isEmpty()


def test_lint_reads_triples_once(spark):
    m = mapping(spark, SF, ["Customer", "Order"])
    assert scans(audit.lint_graph(materialize(m))) == scans(materialize(m))


def test_stored_lookup_prunes_folders(spark, tmp_path):
    from tripleframe.sources.triples import load_triples, save_triples
    path = str(tmp_path / "s")
    for clustered in (False, True):
        save_triples(materialize(mapping(spark, SF, ["Customer", "Order"])), path, clustered)
        g = Graph.materialized(load_triples(spark, path), NS)
        df = g.match(("?o", "placedBy", "?c"), ("?c", "segment", Literal("BUILDING")))
        text = plan(df)
        assert len(re.findall(r"PartitionFilters: \[isnotnull\(p#\d+\), \(p#\d+ = ", text)) == 2
        assert df.count() == Graph.virtual(mapping(spark, SF)).match(("?o", "placedBy", "?c"), ("?c", "segment", Literal("BUILDING"))).count()
        assert g.match(("?o", "total", "?t")).agg(F.count_distinct("o")).first()[0] == 1500


def test_hot_key_is_split_or_counted_away(spark, no_broadcast, tmp_path):
    """A third of all orders belong to one customer: plain bindings let Spark split the hot partition,
    counts shrink it before it is shuffled."""
    from tripleframe import ClassMap, EdgeMap
    spark.range(300_000).select("id", F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 5000).alias("c")).repartition(8).write.parquet(str(tmp_path / "o"))
    spark.range(5000).select("id", F.concat(F.lit("seg"), F.col("id") % 7).alias("seg")).write.parquet(str(tmp_path / "c"))
    o, c = (spark.read.parquet(str(tmp_path / n)) for n in "oc")
    m = Mapping(NS, [ClassMap("O", o, ["id"], unique=True), ClassMap("C", c, ["id"], props={"seg": ("seg", "string")}, unique=True)],
                [EdgeMap("by", "O", "C", "domain_fk", ["c"])])
    g = Graph.virtual(m)
    patterns = [("?o", "by", "?c"), ("?c", "seg", "?s")]
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = g.match(*patterns)
        n = rows.groupBy("s").agg(F.count("o").alias("n"), F.max("o"))
        want = {r.s: r.n for r in n.collect()}
        assert "skew=true" in plan(n)
        counted = g.count_by(["s"], *patterns)
        assert {r.s: r.n for r in counted.collect()} == want and sum(want.values()) == 300_000
        # Counts per task and key are what is shuffled for the join.
        text = plan(counted)
        text = text[text.index("== Initial Plan =="):]
        join = text[text.index("SortMergeJoin"):]
        assert join.index("HashAggregate") < join.index("partial_sum") and "skew" not in join
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_aggregates_stay_on_raw_keys(spark, no_broadcast):
    g = Graph.virtual(mapping(spark, SF))
    shop = [("?o", "placedBy", "?c"), ("?o", "total", "?t"), ("?c", "customerNation", "?n")]
    for by, aggs in ((["c"], {"s": ("sum", "t")}), (["n"], {"a": ("avg", "t"), "d": ("count_distinct", "c")}), (["c", "n"], {"n2": ("count", None)})):
        text = plan(g.aggregate(by, aggs, *shop, typed={"t": "decimal(18,2)"}))
        assert "Exchange" in text and "concat" not in text  # IRIs are made of what the last aggregate returns


def test_enforced_keys_need_no_join(spark):
    from tripleframe import EdgeMap
    base = mapping(spark, SF, ["Order", "Customer"], [])
    m = Mapping(NS, base.classes, [EdgeMap("placedBy", "Order", "Customer", "domain_fk", ["o_custkey"], enforced=True)])
    checked = mapping(spark, SF, ["Order", "Customer"], ["placedBy"])
    for a, b in ((materialize(m, preds=["placedBy"]), materialize(checked, preds=["placedBy"])),
                 (Graph.virtual(m).match(("?o", "placedBy", "?c")), Graph.virtual(checked).match(("?o", "placedBy", "?c")))):
        assert "Join" not in plan(a) and "Join" in plan(b)
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert audit.fk_hit_rates(m).first().total == audit.fk_hit_rates(checked).first().total


def test_a_line_of_triples_is_matched_once(spark):
    from tripleframe.sources.triples import parse_nt
    lines = spark.createDataFrame([('<http://a> <http://p> "x" .',)], "value string").repartition(2)
    good = parse_nt(lines).where("problem is null").select("s", "p", "o", "o_kind", "o_type")
    assert plan(good).count("regexp_replace(") == 1


def test_overlapping_iris_are_grouped_in_tasks_by_rows(spark, monkeypatch):
    from suite.quality import a7
    from tripleframe.plans import support
    monkeypatch.setattr(support, "TASK_ROWS", 1000)
    found = a7(spark, SF)
    # 6,005 lines and 1,500 orders, say: a task per thousand, and no grouping of texts in other tasks.
    rows = sum(spark.read.parquet(f"{SF}/{n}.parquet").count() for n in ("lineitem", "orders"))
    text = plan(found)
    assert f"hashpartitioning(s#" in text and f", {-(-rows // 1000)}), REPARTITION_BY_NUM" in text
    assert len(re.findall(r"hashpartitioning\(s#\d+L?[^)]*\), ENSURE", text)) == 0


def test_constructed_triples_are_grouped_in_tasks_by_rows(spark, monkeypatch):
    from tripleframe.plans import support
    monkeypatch.setattr(support, "TASK_ROWS", 1000)
    m = mapping(spark, SF, ["Customer", "Order", "Part"], ["placedBy", "containsPart"])
    made = Graph.virtual(m).construct([("?c", "boughtPart", "?p")], ("?o", "placedBy", "?c"), ("?o", "containsPart", "?p"))
    rows = sum(spark.read.parquet(f"{SF}/{n}.parquet").count() for n in ("customer", "orders", "part", "lineitem"))
    assert f", {-(-rows // 1000)}), REPARTITION_BY_NUM" in plan(made)
