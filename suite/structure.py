"""Paths, observed schema, samples and term linking."""
from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import NS, case, i, money, n
from suite.tables import mapping, table, tbox
from tripleframe import Graph, MappedTriples, materialize
from tripleframe.functions import local_name
from tripleframe.operators import paths, schema

_PLAIN = ["Region", "Nation", "Customer", "Supplier", "Part", "Order", "Event", "Document", "Assessment"]


def schema_edges(spark, sf):
    """Class-to-class edges that the data really has, by local names."""
    return schema.schema_edges(mapping(spark, sf, _PLAIN))


_EXISTS = [("Nation", "inRegion", "Region", "nation join region on n_regionkey = r_regionkey"),
           ("Customer", "customerNation", "Nation", "customer join nation on c_nationkey = n_nationkey"),
           ("Supplier", "supplierNation", "Nation", "supplier join nation on s_nationkey = n_nationkey"),
           ("Order", "placedBy", "Customer", "orders join customer on o_custkey = c_custkey"),
           ("Document", "hasAssessment", "Assessment", "documents d join labels l on d.doc_id = l.doc_id"),
           ("Order", "containsPart", "Part", "lineitem join orders on l_orderkey = o_orderkey join part on l_partkey = p_partkey"),
           ("Part", "suppliedBy", "Supplier", "lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey"),
           ("Event", "performedBy", "Customer", "events join customer on user_id = c_custkey")]
_EDGES = " union all ".join(f"select '{s}' as s, '{p}' as p, '{o}' as o where exists (select 1 from {q})" for s, p, o, q in _EXISTS)


def _paths_sql(edges: str, starts: str, h: int) -> str:
    return f"""with recursive e as ({edges}), b as (select s as a, p as p, o as b, '' as m from e union all select o, p, s, '^' from e),
      w(hops, pattern, nodes, preds) as (
        select 0, '{{' || a || '}}', [a], cast([] as varchar[]) from (select distinct a from b where {starts})
        union all select hops + 1, pattern || ' ->' || m || p || '-> {{' || b.b || '}}', list_append(nodes, b.b), list_append(preds, p)
        from w join b on b.a = nodes[-1] where hops < {h} and not list_contains(nodes, b.b))
      select hops, pattern, array_to_string(nodes, '|') as nodes, array_to_string(preds, '|') as preds from w where hops > 0"""


def _flat(df):
    return df.select("hops", "pattern", F.array_join("nodes", "|").alias("nodes"), F.array_join("preds", "|").alias("preds"))


@case("G1_path_library", _paths_sql(_EDGES, "true", 4) + " order by hops, pattern limit 300")
def g1(spark, sf):
    return _flat(paths.path_library(schema_edges(spark, sf), 4, 300))


_LOCATED = f"""select {i('nation', 'n_nationkey')} as s, 'inRegion' as p, {i('region', 'n_regionkey')} as o from nation where n_regionkey in (select r_regionkey from region)
    union all select {i('customer', 'c_custkey')}, 'customerNation', {i('nation', 'c_nationkey')} from customer where c_nationkey in (select n_nationkey from nation)
    union all select {i('supplier', 's_suppkey')}, 'supplierNation', {i('nation', 's_nationkey')} from supplier where s_nationkey in (select n_nationkey from nation)
    union all select {i('order', 'o_orderkey')}, 'placedBy', {i('customer', 'o_custkey')} from orders where o_custkey in (select c_custkey from customer)"""


def data_edges(spark, sf, classes, edges):
    triples = materialize(mapping(spark, sf, classes, edges), preds=edges)
    return triples.select("s", local_name("p").alias("p"), "o")


@case("G1_paths_on_data", _paths_sql(_LOCATED, f"starts_with(a, '{NS}region/')", 3))
def g1b(spark, sf):
    """Every path of up to three hops from a region to the nations, customers, suppliers and orders below it."""
    edges = data_edges(spark, sf, ["Region", "Nation", "Customer", "Supplier", "Order"], ["inRegion", "customerNation", "supplierNation", "placedBy"])
    seeds = Graph.virtual(mapping(spark, sf, ["Region"])).match(("?r", "a", "Region"))
    return _flat(paths.path_library(edges, 3, None, seeds))


@case("G2_shortest_path", f"""with recursive e as (select {i('order', 'l_orderkey')} as s, 'containsPart' as p, {i('part', 'l_partkey')} as o from (select distinct l_orderkey, l_partkey from lineitem)
      union all select {i('part', 'l_partkey')}, 'suppliedBy', {i('supplier', 'l_suppkey')} from (select distinct l_partkey, l_suppkey from lineitem)
      union all {_LOCATED}),
    ends as (select {i('order', 'min(o_orderkey)')} as a from orders),
    goal as (select {i('region', 'max(r_regionkey)')} as b from region),
    w(hops, nodes, preds) as (select 0, [a], cast([] as varchar[]) from ends
      union all select hops + 1, list_append(nodes, o), list_append(preds, p) from w join e on e.s = nodes[-1] where hops < 4 and not list_contains(nodes, o))
    select hops, array_to_string(nodes, '|') as nodes, array_to_string(preds, '|') as preds from w, goal where nodes[-1] = b order by hops, w.nodes, w.preds limit 1""")
def g2(spark, sf):
    """From the first order to the last region: through its customer, or through its parts and their suppliers."""
    edges = data_edges(spark, sf, ["Region", "Nation", "Customer", "Supplier", "Order", "Part"],
                       ["inRegion", "customerNation", "supplierNation", "placedBy", "containsPart", "suppliedBy"])
    a = table(spark, sf, "orders").agg(F.min("o_orderkey")).first()[0]
    b = table(spark, sf, "region").agg(F.max("r_regionkey")).first()[0]
    out = paths.shortest_path(edges, f"{NS}order/{a}", f"{NS}region/{b}")
    return out.select("hops", F.array_join("nodes", "|").alias("nodes"), F.array_join("preds", "|").alias("preds"))


_MENU = f"""select {n('Customer')} as s_class, {n('customerNation')} as p, {n('Nation')} as target, 'edge' as kind, count(*) as n, false as self_loop from customer join nation on c_nationkey = n_nationkey
    union all select {n('Nation')}, {n('inRegion')}, {n('Region')}, 'edge', count(*), false from nation join region on n_regionkey = r_regionkey
    union all select {n('Order')}, {n('placedBy')}, {n('Customer')}, 'edge', count(*), false from orders join customer on o_custkey = c_custkey
    union all select {n('Customer')}, {n('customerName')}, 'string', 'literal', count(c_name), false from customer
    union all select {n('Customer')}, {n('segment')}, 'string', 'literal', count(c_mktsegment), false from customer
    union all select {n('Customer')}, {n('balance')}, 'decimal', 'literal', count(c_acctbal), false from customer
    union all select {n('Order')}, {n('status')}, 'string', 'literal', count(o_orderstatus), false from orders
    union all select {n('Order')}, {n('total')}, 'decimal', 'literal', count(o_totalprice), false from orders
    union all select {n('Order')}, {n('orderDate')}, 'date', 'literal', count(o_orderdate), false from orders
    union all select {n('Order')}, {n('priority')}, 'string', 'literal', count(o_orderpriority), false from orders
    union all select {n('Nation')}, {n('nationName')}, 'string', 'literal', count(n_name), false from nation
    union all select {n('Region')}, {n('regionName')}, 'string', 'literal', count(r_name), false from region"""
_MENU_CLASSES = ["Customer", "Nation", "Region", "Order"]


@case("G3_pattern_menu", _MENU)
def g3(spark, sf):
    return schema.pattern_menu(MappedTriples(mapping(spark, sf, _MENU_CLASSES)))


@case("G4_filter_paths", f"""with p as ({_paths_sql(_EDGES, 'true', 4)}),
    r as (select *, case when contains('|' || nodes || '|', '|Customer|') and contains('|' || nodes || '|', '|Region|') and contains('|' || preds || '|', '|placedBy|') then 1 else 2 end as rule from p)
    select hops, pattern, nodes, preds from r where rule = 1""")
def g4(spark, sf):
    """Paths that touch customers and regions and use `placedBy`."""
    every = paths.path_library(schema_edges(spark, sf), 4, None)
    return _flat(paths.filter_paths(every, ["Customer", "Region"], ["placedBy"]))


@case("G4_filter_by_superclass", f"""with p as ({_paths_sql(_EDGES, 'true', 3)})
    select hops, pattern, nodes, preds from p where contains('|' || preds || '|', '|supplierNation|')""")
def g4b(spark, sf):
    """Asked for suppliers: `Party`, the superclass that joins in, is on no path, so having all the predicates decides."""
    up = tbox(spark).sub_class.select(local_name("child").alias("child"), local_name("parent").alias("parent"))
    every = paths.path_library(schema_edges(spark, sf), 3, None)
    return _flat(paths.filter_paths(every, ["Supplier"], ["supplierNation"], up))


@case("G4_paths_using", f"with p as ({_paths_sql(_EDGES, 'true', 3)}) select * from p where contains('|' || preds || '|', '|inRegion|') or contains('|' || preds || '|', '|suppliedBy|')")
def g4c(spark, sf):
    return _flat(paths.paths_using(paths.path_library(schema_edges(spark, sf), 3, None), ["inRegion", "suppliedBy"]))


@case("G7_observed_domain_range", f"""with m as ({_MENU}) select p, 'domain' as side, s_class as cls, n from m
    union all select p, 'range', target, n from m where kind = 'edge'""")
def g7(spark, sf):
    return schema.observed_domain_range(MappedTriples(mapping(spark, sf, _MENU_CLASSES)))


@case("G7_inferred_domain_range", f"""with m as ({_MENU}) select p, s_class as domain,
    case when kind = 'edge' then target else 'http://www.w3.org/2001/XMLSchema#' || target end as range, n from m""")
def g7b(spark, sf):
    """Domains and ranges read off the mapping, next to how many triples bear them out."""
    m = mapping(spark, sf, _MENU_CLASSES)
    seen = materialize(m).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
    return schema.infer_domain_range(m).join(seen, "p").select("p", "domain", "range", "n")


_VOCAB = """select upper(replace(p_name, ' ', '_')) as name, p_name as label from part union select 'n' || cast(n_nationkey as varchar), n_name from nation
    union select 'c' || cast(c_custkey as varchar), c_name from customer union select 's' || cast(s_suppkey as varchar), s_name from supplier
    union select 'b' || cast(p_partkey as varchar), p_brand from part"""
_TERMS = """select lower(replace(p_name, ' ', '_')) as term from part union select upper(p_name) from part union select 'a ' || p_name || '!' from part
    union select split_part(p_name, ' ', 2) from part union select substr(c_name, 10) from customer union select upper(s_name) from supplier
    union select p_brand from part union select o_orderpriority from orders union select left(n_name, 1) from nation"""


@case("G10_link_terms", f"""with v as (select distinct name, lower(trim(coalesce(nullif(trim(label), ''), name))) as l from ({_VOCAB})),
    t as (select distinct term, lower(trim(term)) as t from ({_TERMS}) where trim(term) <> ''),
    a as (select t, max(name) as by_name from t join v on lower(name) = t group by 1),
    b as (select t, min(name) as by_label from t join v on l = t group by 1 having count(distinct name) = 1),
    c as (select t, min(name) as by_part from (select distinct t from t) join v on length(t) >= 2 and (contains(l, t) or contains(t, l)) group by 1 having count(distinct name) = 1)
    select term, coalesce(by_name, by_label, by_part) as name,
      case when by_name is not null then 'name' when by_label is not null then 'label' when by_part is not null then 'part' else 'unlinked' end as rule
    from t left join a using (t) left join b using (t) left join c using (t)""")
def g10(spark, sf):
    tab = lambda name: table(spark, sf, name)
    s = lambda c: F.col(c).cast("string")
    part = tab("part")
    vocab = (part.select(F.upper(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("name"), F.col("p_name").alias("label"))
             .union(tab("nation").select(F.concat(F.lit("n"), s("n_nationkey")), "n_name"))
             .union(tab("customer").select(F.concat(F.lit("c"), s("c_custkey")), "c_name"))
             .union(tab("supplier").select(F.concat(F.lit("s"), s("s_suppkey")), "s_name"))
             .union(part.select(F.concat(F.lit("b"), s("p_partkey")), "p_brand")))
    terms = (part.select(F.lower(F.replace("p_name", F.lit(" "), F.lit("_"))).alias("term"))
             .union(part.select(F.upper("p_name"))).union(part.select(F.concat(F.lit("a "), "p_name", F.lit("!"))))
             .union(part.select(F.split_part("p_name", F.lit(" "), F.lit(2)))).union(tab("customer").select(F.substr("c_name", F.lit(10))))
             .union(tab("supplier").select(F.upper("s_name"))).union(part.select("p_brand"))
             .union(tab("orders").select("o_orderpriority")).union(tab("nation").select(F.left("n_name", F.lit(1)))))
    return schema.link_terms(terms, vocab)


@case("G11_sample_values", f"""select {n('total')} as p, cast(min(cast(o_totalprice as decimal(18,2))) as varchar) as sample, 'decimal' as o_type from orders
    union all select {n('orderDate')}, min(cast(cast(o_orderdate as date) as varchar)), 'date' from orders
    union all select {n('segment')}, min(c_mktsegment), 'string' from customer
    union all select {n('at')}, min(replace(cast(ts as varchar), ' ', 'T')), 'dateTime' from events""")
def g11(spark, sf):
    return schema.sample_values(materialize(mapping(spark, sf, ["Order", "Customer", "Event"])), [NS + p for p in ("total", "orderDate", "segment", "at")])


_NAMESPACES = """select regexp_extract(url, '^(.*#|[^#]*/)', 1) as namespace, count(*) as n from pages where url is not null group by 1"""


@case("G12_namespaces", _NAMESPACES)
def g12(spark, sf):
    return schema.namespaces(table(spark, sf, "pages").where("url is not null").select("url"))


@case("G12_major_namespace", f"select * from ({_NAMESPACES}) order by n desc, namespace limit 1")
def g12b(spark, sf):
    return schema.major_namespace(table(spark, sf, "pages").where("url is not null").select("url"))
