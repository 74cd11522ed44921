"""Audits of tables, mappings and triples, on clean and on dirty foreign keys."""
from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import NS, NULL, TYPE, case, i, money, n, t
from suite.scans import fresh
from suite.tables import CLASSES, class_map, mapping, table, tbox
from tripleframe import ClassMap, EdgeMap, Graph, MappedTriples, Mapping, Tbox, edge_triples, materialize
from tripleframe.operators import audit
from tripleframe.sources.store import TripleStore, reconcile_store


def dirty(spark, sf):
    """Edges whose keys fit, partly fit, never fit, are all NULL or are sometimes NULL."""
    e = table(spark, sf, "events")
    nobody = class_map(spark, sf, "Customer", df=table(spark, sf, "customer").where("c_custkey < 0"))
    nobody.name, nobody.path = "Nobody", "nobody"
    base = mapping(spark, sf, ["Customer", "Supplier", "Order", "Event", "Part"], ["placedBy", "containsPart", "places"])
    no_key = e.select("event_id", F.lit(None).cast("bigint").alias("fk"))
    some = e.select("event_id", F.nullif(F.col("user_id"), F.lit(3)).alias("fk"))
    edges = [EdgeMap("eventSupplier", "Event", "Supplier", "domain_fk", ["user_id"]),
             EdgeMap("orderSupplier", "Order", "Supplier", "domain_fk", ["o_custkey"]),
             EdgeMap("eventNobody", "Event", "Nobody", "domain_fk", ["user_id"]),
             EdgeMap("eventEmpty", "Event", "Supplier", "domain_fk", ["fk"], df=no_key),
             EdgeMap("eventSome", "Event", "Supplier", "domain_fk", ["fk"], df=some)]
    return Mapping(NS, base.classes + [nobody], base.edges + edges, strict=True)


def _rates(rows: list[tuple[str, str, str]]) -> str:
    inner = " union all ".join(f"select '{e}' as edge, '{mode}' as mode, count(*) as total, count(hit) as hit from ({q})" for e, mode, q in rows)
    return f"""select edge, mode, total, hit, case when total > 0 then hit / total end as rate,
      case when total = 0 then 'empty' when hit = 0 then 'dead' when hit / total < 0.9 then 'warn' else 'ok' end as verdict from ({inner})"""


def _left(child, fk, parent, pk):
    return f"select {pk} as hit from {child} left join {parent} on {fk} = {pk} where {fk} is not null"


_RATES = [
    ("placedBy", "domain_fk", _left("orders", "o_custkey", "customer", "c_custkey")),
    ("containsPart", "junction", _left("lineitem", "l_partkey", "part", "p_partkey")),
    ("places", "range_fk", _left("orders", "o_custkey", "customer", "c_custkey")),
    ("eventSupplier", "domain_fk", _left("events", "user_id", "supplier", "s_suppkey")),
    ("orderSupplier", "domain_fk", _left("orders", "o_custkey", "supplier", "s_suppkey")),
    ("eventNobody", "domain_fk", _left("events", "user_id", "(select * from customer where c_custkey < 0)", "c_custkey")),
    ("eventEmpty", "domain_fk", "select 1 as hit from events where false"),
    ("eventSome", "domain_fk", "select s_suppkey as hit from (select nullif(user_id, 3) as fk from events) left join supplier on fk = s_suppkey where fk is not null"),
]


@case("A1_fk_hit_rates", _rates(_RATES))
def a1(spark, sf):
    return audit.fk_hit_rates(dirty(spark, sf))


@case("A1_both_sides", _rates([("containsPart", "junction", _left("lineitem", "l_partkey", "part", "p_partkey")),
                               ("containsPart:domain", "junction", _left("lineitem", "l_orderkey", "orders", "o_orderkey"))]))
def a1b(spark, sf):
    return audit.fk_hit_rates(dirty(spark, sf), ["containsPart"], side="both")


@case("A1_repeated_parents", _rates([("lineFlag", "domain_fk", _left("lineitem", "l_partkey", "(select l_suppkey as k from lineitem)", "k"))]))
def a1c(spark, sf):
    """The parent's key repeats, which inflates both counts as a row-by-row join would."""
    line = ClassMap("Line", table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    shipper = ClassMap("Shipper", table(spark, sf, "lineitem"), ["l_suppkey"])
    return audit.fk_hit_rates(Mapping(NS, [line, shipper], [EdgeMap("lineFlag", "Line", "Shipper", "domain_fk", ["l_partkey"])]))


@case("A2_verdicts", f"select edge, verdict from ({_rates(_RATES)}) where verdict <> 'ok'")
def a2(spark, sf):
    return audit.fk_hit_rates(dirty(spark, sf)).where("verdict <> 'ok'").select("edge", "verdict")


@case("A3_sampled_hit_rates", _rates([
    ("eventSupplier", "domain_fk", """select s_suppkey as hit from (
        (select user_id from events where user_id is not null order by event_id, user_id limit 100)
        union all (select user_id from events where user_id is not null order by event_id desc, user_id limit 100))
        left join supplier on user_id = s_suppkey"""),
    ("placedBy", "domain_fk", """select c_custkey as hit from (
        (select o_custkey from orders where o_custkey is not null order by o_orderkey, o_custkey limit 100)
        union all (select o_custkey from orders where o_custkey is not null order by o_orderkey desc, o_custkey limit 100))
        left join customer on o_custkey = c_custkey""")]))
def a3(spark, sf):
    return audit.fk_hit_rates(dirty(spark, sf), ["eventSupplier", "placedBy"], sample_n=200)


def _rec(edge, child, join, left, nulls):
    return f"""select 'map-{edge.lower()}' as mapping, '{edge}' as edge, (select count(*) from {child} {left}) as total,
      (select count(*) from {child} {join}) as kept, (select count(*) from {child} {left} where {nulls}) as null_key"""


def _fk(edge, child, fk, pk_child, parent, pk):
    on = f"join {parent} on {fk} = {pk}"
    return _rec(edge, child, on, "left " + on, f"{fk} is null or {pk_child} is null")


_RECONCILED = " union all ".join([
    _fk("placedBy", "orders", "o_custkey", "o_orderkey", "customer", "c_custkey"),
    _rec("containsPart", "lineitem", "join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey",
         "left join orders on l_orderkey = o_orderkey left join part on l_partkey = p_partkey", "l_orderkey is null or l_partkey is null"),
    _fk("places", "orders", "o_custkey", "o_orderkey", "customer", "c_custkey"),
    _fk("eventSupplier", "events", "user_id", "event_id", "supplier", "s_suppkey"),
    _fk("orderSupplier", "orders", "o_custkey", "o_orderkey", "supplier", "s_suppkey"),
    _fk("eventNobody", "events", "user_id", "event_id", "(select * from customer where c_custkey < 0)", "c_custkey"),
    _fk("eventEmpty", "(select event_id, cast(null as bigint) as fk from events)", "fk", "event_id", "supplier", "s_suppkey"),
    _fk("eventSome", "(select event_id, nullif(user_id, 3) as fk from events)", "fk", "event_id", "supplier", "s_suppkey")])


@case("A4_reconcile_edges", f"select *, total - kept - null_key as dangling from ({_RECONCILED})")
def a4(spark, sf):
    return audit.reconcile_edges(dirty(spark, sf))


@case("A4_repeated_parents", f"""select *, total - kept - null_key as dangling from ({_rec('lineShipper', 'lineitem x',
    'join (select l_suppkey as k from lineitem) on x.l_partkey = k', 'left join (select l_suppkey as k from lineitem) on x.l_partkey = k',
    'x.l_partkey is null or x.l_orderkey is null or x.l_linenumber is null')})""")
def a4b(spark, sf):
    line = ClassMap("Line", table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    shipper = ClassMap("Shipper", table(spark, sf, "lineitem"), ["l_suppkey"])
    return audit.reconcile_edges(Mapping(NS, [line, shipper], [EdgeMap("lineShipper", "Line", "Shipper", "domain_fk", ["l_partkey"])]))


def soiled(spark, sf):
    """Documents whose source is NULL, empty or blank on many rows."""
    d = table(spark, sf, "documents")
    src = F.when(F.col("lang") == "fr", F.lit(None)).when(F.col("lang") == "de", F.lit("")).when(F.col("lang") == "es", F.lit("  ")).otherwise(F.col("source"))
    return d.withColumn("source", src)


_PROFILED = [("map-document", "(select lang, case lang when 'fr' then null when 'de' then '' when 'es' then '  ' else source end as source, n_chars from documents)",
              [("lang", "string", "lang"), ("source", "string", "source"), ("n_chars", "integer", "cast(n_chars as varchar)")]),
             ("map-order", "orders", [("o_orderstatus", "string", "o_orderstatus"), ("o_totalprice", "decimal", money("o_totalprice")),
                                      ("o_orderdate", "date", "cast(cast(o_orderdate as date) as varchar)"), ("o_orderpriority", "string", "o_orderpriority")]),
             ("map-event", "events", [("event_type", "string", "event_type"), ("value", "decimal", money("value")),
                                      ("ts", "dateTime", "replace(cast(ts as varchar), ' ', 'T')")])]


def _profile_sql() -> str:
    parts = []
    for mapping_id, src, cols in _PROFILED:
        for col, xsd, v in cols:
            parts.append(f"""select '{mapping_id}' as mapping, '{col}' as "column", '{xsd}' as xsd, (select count(*) from {src}) as rows,
              (select count(*) from {src} where {col} is null) as "null", (select count(*) from {src} where trim({v}) = '') as blank,
              coalesce((select string_agg(v || ' x' || cast(n as varchar), '; ' order by n desc, v) from (
                select {v} as v, count(*) as n from {src} where trim({v}) <> '' group by 1 order by 2 desc, 1 limit 3)), '') as top""")
    return " union all ".join(parts)


def _profiled(spark, sf):
    doc = class_map(spark, sf, "Document", df=soiled(spark, sf))
    return Mapping(NS, [doc, class_map(spark, sf, "Order"), class_map(spark, sf, "Event")])


@case("A5_profile_literals", _profile_sql())
def a5(spark, sf):
    return audit.profile_literals(_profiled(spark, sf))


@case("A6_audit_notes", """select 'map-vector' as mapping, 'column embedding of embedding is nested and cannot be profiled' as note, count(*) as rows from embeddings
    union all select 'edge toTurn', 'edge toTurn: number of key columns does not fit the class it points to, skipped', null""")
def a6(spark, sf):
    vec = ClassMap("Vector", table(spark, sf, "embeddings"), ["vec_id"], props={"label": ("label", "integer"), "embedding": ("embedding", "string")}, unique=True)
    turn = class_map(spark, sf, "Turn")
    return audit.audit_notes(Mapping(NS, [vec, turn], [EdgeMap("toTurn", "Vector", "Turn", "domain_fk", ["label"])]))


@case("A7_iri_overlap", f"""
    with line as (select {i('thing', 'l_orderkey')} as s, 'Line' as cls from lineitem),
    ord as (select {i('thing', 'o_orderkey')} as s, 'Order' as cls from orders),
    per as (select s, string_agg(distinct cls, ',' order by cls) as classes, count(*) as rows,
              greatest(count(*) filter (cls = 'Line'), count(*) filter (cls = 'Order')) as max_per_class from (select * from line union all select * from ord) group by s)
    select * from per where contains(classes, ',') or max_per_class > 1""")
def a7(spark, sf):
    line = ClassMap("Line", table(spark, sf, "lineitem"), ["l_orderkey"], "thing")
    order = ClassMap("Order", table(spark, sf, "orders"), ["o_orderkey"], "thing")
    return audit.iri_overlap(Mapping(NS, [line, order]))


@case("A7_key_collisions", f"""select 'Line' as classes, count(*) as iris, cast(sum(n) as bigint) as rows from (
    select count(*) as n from lineitem group by l_orderkey, l_linenumber having count(*) > 1)""")
def a7b(spark, sf):
    line = ClassMap("Line", table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])
    return audit.iri_overlap_summary(Mapping(NS, [line, class_map(spark, sf, "Turn")]))


@case("A8_iri_path_conflicts", """
    select 'UrgentOrder' as child, 'Order' as parent, true as same_path, (select count(*) from orders where o_orderpriority = '1-URGENT') as instances, 0 as missing
    union all select 'Flagged', 'Order', false, (select count(*) from orders where o_orderstatus = 'F'), (select count(*) from orders where o_orderstatus = 'F')
    union all select 'Shopper', 'Supplier', true, (select count(distinct user_id) from events), (select count(distinct user_id) from events where user_id not in (select s_suppkey from supplier))""")
def a8(spark, sf):
    o = table(spark, sf, "orders")
    m = Mapping(NS, [class_map(spark, sf, "Order"), class_map(spark, sf, "UrgentOrder"), class_map(spark, sf, "Supplier"),
                     ClassMap("Flagged", o.where("o_orderstatus = 'F'"), ["o_orderkey"], "flagged", unique=True),
                     ClassMap("Shopper", table(spark, sf, "events"), ["user_id"], "supplier")])
    return audit.iri_path_conflicts(m, [("UrgentOrder", "Order"), ("Flagged", "Order"), ("Shopper", "Supplier")])


@case("A9_type_conformance", """
    select 'map-order' as mapping, 'o_orderpriority' as "column", 'integer' as xsd, 'string' as column_type, count(o_orderpriority) as "values",
      count(*) filter (o_orderpriority is not null and try_cast(o_orderpriority as bigint) is null) as bad from orders
    union all select 'map-order', 'o_orderdate', 'date', 'dateTime', count(o_orderdate), 0 from orders
    union all select 'map-part', 'p_brand', 'decimal', 'string', count(p_brand), count(*) filter (p_brand is not null and try_cast(p_brand as decimal(38,10)) is null) from part
    union all select 'map-part', 'p_size', 'integer', 'integer', count(p_size), 0 from part""")
def a9(spark, sf):
    order = class_map(spark, sf, "Order", props={"priority": ("o_orderpriority", "integer"), "day": ("o_orderdate", "date")})
    part = class_map(spark, sf, "Part", props={"brand": ("p_brand", "decimal"), "size": ("p_size", "integer")})
    return audit.type_conformance(Mapping(NS, [order, part]))


_SMALL = ["Customer", "Nation", "Region", "Supplier", "Order"]


def _graph_triples(spark, sf, names=tuple(_SMALL)):
    return materialize(mapping(spark, sf, list(names)))


@case("A10_coverage", f"""
    select 'class' as kind, name from (values ({n('UrgentOrder')}), ({n('Event')}), ({n('Document')}), ({n('Assessment')}), ({n('Turn')}), ({n('Page')}), ({n('Part')}),
      ({n('Party')}), ({n('Agent')}), ({n('Place')})) v(name) where (select count(*) from customer) > 0
    union all select 'property', name from (values ({n('partName')}), ({n('brand')}), ({n('partType')}), ({n('size')}), ({n('price')}), ({n('eventType')}), ({n('value')}), ({n('at')}),
      ({n('lang')}), ({n('source')}), ({n('nChars')}), ({n('quality')}), ({n('toxic')}), ({n('role')}), ({n('url')}), ({n('hasAssessment')}), ({n('containsPart')}),
      ({n('suppliedBy')}), ({n('performedBy')}), ({n('locatedIn')}), ({n('relatedTo')})) v(name)""")
def a10(spark, sf):
    return audit.coverage(MappedTriples(mapping(spark, sf, list(_SMALL))), tbox(spark))


@case("A11_inverse_duplicates", f"""select {i('order', 'o_orderkey')} as s, {n('placedBy')} as p, {i('customer', 'o_custkey')} as o, {n('places')} as inverse
    from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F'""")
def a11(spark, sf):
    """`placedBy` for all orders, `places` for the finished ones only."""
    m = mapping(spark, sf, ["Order", "Customer"], ["placedBy"])
    done = class_map(spark, sf, "Order", df=table(spark, sf, "orders").where("o_orderstatus = 'F'"))
    back = Mapping(NS, [m.by_name["Customer"], done], [EdgeMap("places", "Customer", "Order", "range_fk", ["o_custkey"])])
    both = edge_triples(m, "placedBy").union(edge_triples(back, "places"))
    return audit.inverse_duplicates(both, tbox(spark).inverse)


@case("A12_graph_diff", f"""
    select 'removed' as change, {t(i('order', 'o_orderkey'), n('priority'), 'o_orderpriority', 'string')} from orders where o_orderpriority = '5-LOW'
    union all select 'added', {t(i('order', 'o_orderkey'), n('priority'), "'6-NONE'", 'string')} from orders where o_orderpriority = '5-LOW'
    union all select 'removed', {t(i('order', 'o_orderkey'), TYPE, n('Order'))} from orders where o_orderstatus = 'P'
    union all select 'removed', {t(i('order', 'o_orderkey'), n('priority'), 'o_orderpriority', 'string')} from orders where o_orderstatus = 'P' and o_orderpriority <> '5-LOW'""".replace(
    "where o_orderpriority = '5-LOW'\n    union all select 'removed'", "where o_orderpriority = '5-LOW' and o_orderstatus <> 'P'\n    union all select 'removed'"))
def a12(spark, sf):
    """A later snapshot in which a priority was renamed and pending orders are gone."""
    props = {"priority": ("o_orderpriority", "string")}
    o = table(spark, sf, "orders")
    later = o.where("o_orderstatus <> 'P'").withColumn("o_orderpriority", F.expr("if(o_orderpriority = '5-LOW', '6-NONE', o_orderpriority)"))
    a, b = (materialize(Mapping(NS, [class_map(spark, sf, "Order", df=d, props=props)])) for d in (o, later))
    return audit.graph_diff(a, b)


@case("A12_tbox_diff", f"""
    with old_ as (select distinct '{NS}' || replace(p_brand, '#', '') as prop, '{NS}' || p_type as cls from part),
      new_ as (select distinct '{NS}' || replace(p_brand, '#', '') as prop, '{NS}' || p_type as cls from part where p_name like 'red%'),
      a as (select prop, string_agg(cls, ',' order by cls) || ' -> ' as ends from old_ group by 1), b as (select prop, string_agg(cls, ',' order by cls) || ' -> ' as ends from new_ group by 1)
    select case when a.prop is null then 'added' when b.prop is null then 'removed' else 'changed' end as change, 'property' as kind,
      coalesce(a.prop, b.prop) as name, a.ends as old_ends, b.ends as new_ends from a full join b on a.prop = b.prop where a.ends is distinct from b.ends""")
def a12b(spark, sf):
    """Ontologies read off the data: each brand is a property whose domains are the types it occurs with."""
    p = table(spark, sf, "part").select(
        F.concat(F.lit(NS), F.regexp_replace("p_brand", "#", "")).alias("prop"), F.concat(F.lit(NS), "p_type").alias("cls"), "p_name")

    def box(rows):
        props = rows.select("prop", F.lit("data"), F.lit(None).cast("string")).distinct()
        return Tbox.of(spark, properties=props, domain=rows.select("prop", "cls").distinct())

    return audit.tbox_diff(box(p), box(p.where(F.col("p_name").startswith("red"))))


@case("A13_namespace_check", """
    select namespace, cast(sum(n) as bigint) as n, namespace = 'http://example.org/kg' as in_ontology from (
      select case when contains(url, '#') then split_part(url, '#', 1) else regexp_extract(url, '^(.*)/', 1) end as namespace, 1 as n from pages
      union all select 'http://example.org/kg', 1 from pages) group by 1""")
def a13(spark, sf):
    """Pages named by their own address instead of an IRI of the ontology."""
    rows = table(spark, sf, "pages").select(F.col("url").alias("s"), F.lit(NS + "url").alias("p"), F.col("page_id").cast("string").alias("o"),
                                            F.lit("lit").alias("o_kind"), F.lit("string").alias("o_type"))
    return audit.namespace_check(rows, tbox(spark))


@case("A14_label_coverage", """select count(*) as total, count(*) filter (not regexp_matches(text, '[é-ü]')) as missing,
    count(*) filter (not regexp_matches(text, '[é-ü]')) / count(*) > 0.2 as warn from documents""")
def a14(spark, sf):
    """Documents as entities, their text as the label that should hold accented letters."""
    return audit.label_coverage(table(spark, sf, "documents").select(F.col("doc_id").alias("entity"), F.col("text").alias("label")), "[é-ü]")


@case("A15_reconcile_counts", """
    select 'order' as what, (select count(*) * 5 from orders) + (select count(*) from orders join customer on o_custkey = c_custkey) + (select count(*) * 4 from customer) as expected,
      (select count(*) * 5 from orders) + (select count(*) from orders join customer on o_custkey = c_custkey) + (select count(*) * 4 from customer) as stored, 'match' as state
    union all select 'part', (select count(*) * 6 from part), (select count(*) * 4 from part), 'mismatch'
    union all select 'none', 0, 0, 'empty'""")
def a15(spark, sf):
    full = materialize(mapping(spark, sf, ["Order", "Customer"]))
    checked = Graph.virtual(mapping(spark, sf, ["Order", "Customer"])).triples()
    part = materialize(mapping(spark, sf, ["Part"]))
    some = part.where(~F.col("p").isin(NS + "brand", NS + "price"))
    none = part.where(F.col("s").isNull())
    out = [audit.reconcile_counts(a, b).select(F.lit(w).alias("what"), "*") for w, a, b in
           (("order", full, checked), ("part", part, some), ("none", none, none))]
    return out[0].union(out[1]).union(out[2])


@case("A15_reconcile_store", f"""with o as (select count(*) as n from orders), c as (select count(*) as n from customer)
    select {TYPE} as p, (select n from o) + (select n from c) as expected, (select n from o) + (select n from c) + (select count(*) from region) as stored, 'mismatch' as state
    union all select {n('status')}, count(o_orderstatus), count(o_orderstatus), 'match' from orders
    union all select {n('total')}, count(o_totalprice), count(o_totalprice), 'match' from orders
    union all select {n('orderDate')}, count(o_orderdate), count(o_orderdate), 'match' from orders
    union all select {n('priority')}, count(o_orderpriority), 0, 'missing' from orders
    union all select {n('placedBy')}, count(*), count(*), 'match' from orders where o_custkey in (select c_custkey from customer)
    union all select {n('customerName')}, count(c_name), count(c_name), 'match' from customer
    union all select {n('segment')}, count(c_mktsegment), count(c_mktsegment), 'mismatch' from customer
    union all select {n('balance')}, count(c_acctbal), count(c_acctbal), 'match' from customer
    union all select {n('regionName')}, 0, count(r_name), 'extra' from region""")
def a15b(spark, sf):
    """A store that lacks one property, has one from elsewhere, and has other values of a third, against the graph it should hold."""
    wrong = class_map(spark, sf, "Customer", table(spark, sf, "customer").withColumn("c_mktsegment", F.lower("c_mktsegment")))
    less = class_map(spark, sf, "Order", props={p: x for p, x in CLASSES["Order"][2].items() if p != "priority"})
    stored = TripleStore(spark, fresh(spark, "reconcile"))
    stored.refresh(materialize(mapping(spark, sf, ["Order", "Customer", "Region"]).with_classes(Customer=wrong, Order=less)))
    return reconcile_store(materialize(mapping(spark, sf, ["Order", "Customer"])), stored)


@case("A17_acceptance", """select name, expected, actual, case when expected = actual then 'PASS' else 'FAIL' end as verdict from (
    select 'Customer' as name, (select count(*) from customer) as expected, (select count(*) from customer) as actual
    union all select 'Order', (select count(*) from orders), (select count(*) from orders)
    union all select 'placedBy', (select count(*) from orders), (select count(*) from orders join customer on o_custkey = c_custkey)
    union all select 'inRegion', (select count(*) + 1 from nation), (select count(*) from nation join region on n_regionkey = r_regionkey)
    union all select 'nothing', (select count(*) from part), 0)""")
def a17(spark, sf):
    """Counts of a graph against the row counts of its tables; two of the expectations are wrong on purpose."""
    g = Graph.virtual(mapping(spark, sf))
    local = F.substring_index("cls", "#", -1)
    actual = g.census().select(local.alias("name"), "n")
    for e in ("placedBy", "inRegion"):
        actual = actual.union(g.match(("?s", e, "?o")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(e), "n"))
    rows = lambda name, tab, more=0: table(spark, sf, tab).agg((F.count(F.lit(1)) + more).alias("expected")).select(F.lit(name).alias("name"), "expected")
    wanted = rows("Customer", "customer").union(rows("Order", "orders")).union(rows("placedBy", "orders")).union(
        rows("inRegion", "nation", 1)).union(rows("nothing", "part"))
    return audit.expect_frame(actual, wanted)


@case("A18_lint_graph", f"""
    select 'dangling_object' as finding, {i('supplier', 'user_id')} as subject, count(*) as n from events where user_id not in (select s_suppkey from supplier) group by user_id
    union all select 'same_up_to_case', lower({n('Label')}), 2 where (select count(*) from supplier) > 0
    union all select 'mixed_value_types', {n('amount')}, 2 where (select count(*) from part) > 0""")
def a18(spark, sf):
    """Edges written without looking for the parent, one name in two spellings, one property with two types."""
    m = mapping(spark, sf, ["Supplier", "Event"], [])
    none = F.lit(None).cast("string")
    raw = table(spark, sf, "events").select(F.concat(F.lit(NS + "event/"), F.col("event_id").cast("string")).alias("s"), F.lit(NS + "by").alias("p"),
                                            F.concat(F.lit(NS + "supplier/"), F.col("user_id").cast("string")).alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_type"))
    lit = lambda tab, key, p, o, x: table(spark, sf, tab).select(F.concat(F.lit(NS + tab + "/"), F.col(key).cast("string")).alias("s"), F.lit(NS + p).alias("p"),
                                                                 F.col(o).cast("string").alias("o"), F.lit("lit").alias("o_kind"), F.lit(x).alias("o_type"))
    every = materialize(m).union(raw)
    for args in (("supplier", "s_suppkey", "label", "s_name", "string"), ("part", "p_partkey", "Label", "p_name", "string"),
                 ("part", "p_partkey", "amount", "p_size", "integer"), ("supplier", "s_suppkey", "amount", "s_name", "string")):
        every = every.union(lit(*args))
    return audit.lint_graph(every)


def _keys_sql(tab: str, cols: list[tuple[str, bool, bool]]) -> str:
    return " union all ".join(f"""select '{tab}' as tab, '{c}' as "column", count(*) as rows, count(*) - count({c}) as nulls, count(distinct {c}) as "distinct",
      {str(named).lower()} as name_says_key, {str(typed).lower()} and count(*) = count({c}) and count(distinct {c}) = count(*) as values_say_key from {tab}""" for c, named, typed in cols)


@case("A20_candidate_keys", _keys_sql("events", [("event_id", True, True), ("ts", False, False), ("user_id", True, True), ("event_type", False, True), ("value", False, False), ("props", False, True)])
      + " union all " + _keys_sql("customer", [("c_custkey", False, True), ("c_name", False, True), ("c_nationkey", False, True), ("c_acctbal", False, False), ("c_mktsegment", False, True)]))
def a20(spark, sf):
    return audit.candidate_keys(table(spark, sf, "events")).select(F.lit("events").alias("tab"), "*").union(
        audit.candidate_keys(table(spark, sf, "customer")).select(F.lit("customer").alias("tab"), "*"))
