"""Hierarchies and RDFS-style widening."""
from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import NULL, TYPE, case, i, n, t
from suite.scans import fresh
from suite.tables import mapping, table, tbox
from tripleframe import MappedTriples, edge_triples, materialize
from tripleframe.operators import reason
from tripleframe.sources import triples as store

_PARTS = ["Customer", "Supplier", "Nation", "Region", "Order", "UrgentOrder", "Part", "Event"]


def _triples(spark, sf):
    """Types and edges of the mapping, without literals."""
    m = mapping(spark, sf, _PARTS)
    names = {m.iri(p) for c in m.classes for p in c.props}
    return materialize(m, preds=["a"] + [l.edge.name for l in m.links] + ["total"]).where(
        ~F.col("p").isin(list(names - {m.iri("total")})))


def _mapped(spark, sf):
    """All triples of the mapping, of which a rule makes those of its predicates."""
    return MappedTriples(mapping(spark, sf, _PARTS))


_STEPS = """select 'order/' || cast(o_orderkey as varchar) as child, 'customer/' || cast(o_custkey as varchar) as parent from orders
    union select 'customer/' || cast(c_custkey as varchar), 'nation/' || cast(c_nationkey as varchar) from customer
    union select 'nation/' || cast(n_nationkey as varchar), 'region/' || cast(n_regionkey as varchar) from nation"""


def _steps(spark, sf):
    def pairs(name, a, ak, b, bk):
        return table(spark, sf, name).select(F.concat(F.lit(a + "/"), F.col(ak).cast("string")).alias("child"),
                                             F.concat(F.lit(b + "/"), F.col(bk).cast("string")).alias("parent"))
    return pairs("orders", "order", "o_orderkey", "customer", "o_custkey").union(
        pairs("customer", "customer", "c_custkey", "nation", "c_nationkey")).union(
        pairs("nation", "nation", "n_nationkey", "region", "n_regionkey"))


@case("R1_hierarchy_closure", f"""with recursive e as ({_STEPS}),
    c(child, ancestor) as (select child, parent from e union select c.child, e.parent from c join e on c.ancestor = e.child)
    select child, ancestor from c""")
def r1(spark, sf):
    return reason.closure(_steps(spark, sf))


_SUBPROP = """select 'part/' || cast(p_partkey as varchar) as child, 'brand/' || p_brand as parent from part
    union select 'brand/' || p_brand, 'type/' || p_type from part
    union select 'type/' || p_type, 'goods' from part"""


@case("R2_subproperty_closure", f"""with recursive e as ({_SUBPROP}),
    c(child, ancestor) as (select child, parent from e union select c.child, e.parent from c join e on c.ancestor = e.child)
    select child, ancestor from c""")
def r2(spark, sf):
    """A hierarchy where a node has many parents: part, brand, every type the brand occurs with."""
    p = table(spark, sf, "part")
    part, brand = F.concat(F.lit("part/"), F.col("p_partkey").cast("string")), F.concat(F.lit("brand/"), "p_brand")
    kind = F.concat(F.lit("type/"), "p_type")
    edges = p.select(part.alias("child"), brand.alias("parent")).union(p.select(brand, kind)).union(p.select(kind, F.lit("goods")))
    return reason.closure(edges)


@case("R3_type_widening", f"""
    select {t(i('customer', 'c_custkey'), TYPE, 'cls')} from customer, (values ({n('Party')}), ({n('Agent')})) v(cls)
    union all select {t(i('supplier', 's_suppkey'), TYPE, 'cls')} from supplier, (values ({n('Party')}), ({n('Agent')})) v(cls)
    union all select {t(i('nation', 'n_nationkey'), TYPE, n('Place'))} from nation
    union all select {t(i('region', 'r_regionkey'), TYPE, n('Place'))} from region
    union all select {t(i('order', 'o_orderkey'), TYPE, n('Order'))} from orders where o_orderpriority = '1-URGENT'""")
def r3(spark, sf):
    return reason.widen_types(_mapped(spark, sf), tbox(spark))


_LOCATED = f"""
    select {i('customer', 'c_custkey')} as s, {i('nation', 'c_nationkey')} as o from customer join nation on c_nationkey = n_nationkey
    union all select {i('supplier', 's_suppkey')}, {i('nation', 's_nationkey')} from supplier join nation on s_nationkey = n_nationkey
    union all select {i('nation', 'n_nationkey')}, {i('region', 'n_regionkey')} from nation join region on n_regionkey = r_regionkey"""


@case("R4_super_property_edges", f"""select s, p, o, 'iri' as o_kind, {NULL} as o_type
    from ({_LOCATED}), (values ({n('locatedIn')}), ({n('relatedTo')})) v(p)""")
def r4(spark, sf):
    return reason.widen_edges(_mapped(spark, sf), tbox(spark))


@case("R5_domain_typing", f"""
    select {t(i('order', 'k'), TYPE, n('Order'))} from (
      select o_orderkey as k from orders join customer on o_custkey = c_custkey
      union select l_orderkey from lineitem where l_orderkey in (select o_orderkey from orders) and l_partkey in (select p_partkey from part))
    union all select {t(i('event', 'event_id'), TYPE, n('Event'))} from events where user_id in (select c_custkey from customer)""")
def r5(spark, sf):
    return reason.type_by_domain(_mapped(spark, sf), tbox(spark))


@case("R6_range_typing", f"""
    select distinct {t(i('customer', 'o_custkey'), TYPE, n('Customer'))} from orders where o_custkey in (select c_custkey from customer)
    union all select distinct {t(i('nation', 'c_nationkey'), TYPE, n('Nation'))} from customer where c_nationkey in (select n_nationkey from nation)
    union all select distinct {t(i('part', 'l_partkey'), TYPE, n('Part'))} from lineitem
      where l_orderkey in (select o_orderkey from orders) and l_partkey in (select p_partkey from part)""")
def r6(spark, sf):
    return reason.type_by_range(_mapped(spark, sf), tbox(spark))


_WIDE = f"""
    select {TYPE} as p, {n('Customer')} as o, count(*) as n from customer
    union all select {TYPE}, {n('Supplier')}, count(*) from supplier
    union all select {TYPE}, {n('Party')}, (select count(*) from customer) + (select count(*) from supplier)
    union all select {TYPE}, {n('Agent')}, (select count(*) from customer) + (select count(*) from supplier)
    union all select {TYPE}, {n('Place')}, (select count(*) from nation) + (select count(*) from region)
    union all select {TYPE}, {n('Nation')}, count(*) from nation
    union all select {TYPE}, {n('Region')}, count(*) from region
    union all select {TYPE}, {n('Order')}, count(*) from orders
    union all select {TYPE}, {n('UrgentOrder')}, count(*) from orders where o_orderpriority = '1-URGENT'
    union all select {TYPE}, {n('Part')}, count(*) from part
    union all select {TYPE}, {n('Event')}, count(*) from events
    union all select {n('placedBy')}, '-', count(*) from orders join customer on o_custkey = c_custkey
    union all select {n('performedBy')}, '-', count(*) from events join customer on user_id = c_custkey
    union all select {n('containsPart')}, '-', count(*) from (select distinct l_orderkey, l_partkey from lineitem
      where l_orderkey in (select o_orderkey from orders) and l_partkey in (select p_partkey from part))
    union all select {n('suppliedBy')}, '-', count(*) from (select distinct l_partkey, l_suppkey from lineitem
      where l_partkey in (select p_partkey from part) and l_suppkey in (select s_suppkey from supplier))
    union all select {n('customerNation')}, '-', count(*) from customer join nation on c_nationkey = n_nationkey
    union all select {n('supplierNation')}, '-', count(*) from supplier join nation on s_nationkey = n_nationkey
    union all select {n('inRegion')}, '-', count(*) from nation join region on n_regionkey = r_regionkey
    union all select {n('locatedIn')}, '-', count(*) from ({_LOCATED})
    union all select {n('relatedTo')}, '-', count(*) from ({_LOCATED})
    union all select {n('total')}, '-', count(o_totalprice) from orders"""


def _counted(df):
    o = F.when(F.col("p") == "http://www.w3.org/1999/02/22-rdf-syntax-ns#type", F.col("o")).otherwise("-")
    return df.groupBy("p", o.alias("o")).agg(F.count(F.lit(1)).alias("n"))


@case("R3_R6_widened_graph", _WIDE)
def widened(spark, sf):
    """All rules applied to stored triples; each rule reads only the folders of its predicates."""
    path = fresh(spark, "rules")
    store.save_triples(_triples(spark, sf), path)
    return _counted(reason.widen(store.load_triples(spark, path), tbox(spark)))


@case("R3_R6_widened_mapping", _WIDE)
def widened_mapping(spark, sf):
    """The same graph with the rules looked up per mapping, so that no triple is joined to the ontology."""
    m = mapping(spark, sf, _PARTS)
    out = materialize(m, tbox(spark))
    lits = [m.iri(p) for c in m.classes for p in c.props if p != "total"]
    return _counted(out.where(~F.col("p").isin(lits)))


@case("R7_inverse_edges", f"select {t(i('customer', 'o_custkey'), n('places'), i('order', 'o_orderkey'))} from orders join customer on o_custkey = c_custkey")
def r7(spark, sf):
    placed = edge_triples(mapping(spark, sf, ["Order", "Customer"], ["placedBy"]), "placedBy")
    return reason.inverse_edges(placed, tbox(spark).inverse)


@case("R8_symmetric_pairs", """select distinct least(a, b) as a, greatest(a, b) as b from (
      select cast(l_partkey as varchar) as a, cast(l_suppkey as varchar) as b from lineitem
      union all select cast(l_suppkey as varchar), cast(l_partkey as varchar) from lineitem) where a <> b""")
def r8(spark, sf):
    """Part and supplier numbers that occur together, stated in both directions."""
    rows = table(spark, sf, "lineitem").select(F.col("l_partkey").cast("string").alias("a"), F.col("l_suppkey").cast("string").alias("b"))
    return reason.canonical_pairs(rows.union(rows.select("b", "a")))


@case("R9_disjoint_pairs", """with asked as (
      select distinct c.n_name as a, s.n_name as b from lineitem join orders on l_orderkey = o_orderkey
        join customer on o_custkey = c_custkey join supplier on l_suppkey = s_suppkey
        join nation c on c_nationkey = c.n_nationkey join nation s on s_nationkey = s.n_nationkey)
    select distinct least(a, b) as a, greatest(a, b) as b from asked join nation x on a = x.n_name join nation y on b = y.n_name
    where a <> b and x.n_regionkey = y.n_regionkey""")
def r9(spark, sf):
    """Nations of one region are declared mutually disjoint; asked for customer and supplier nations that trade."""
    t_ = lambda name: table(spark, sf, name)
    nat = t_("nation").select("n_nationkey", "n_name")
    asked = (t_("lineitem").select("l_orderkey", "l_suppkey").join(t_("orders").select("o_orderkey", "o_custkey"), F.expr("l_orderkey = o_orderkey"))
             .join(t_("customer").select("c_custkey", "c_nationkey"), F.expr("o_custkey = c_custkey"))
             .join(t_("supplier").select("s_suppkey", "s_nationkey"), F.expr("l_suppkey = s_suppkey"))
             .select("c_nationkey", "s_nationkey").distinct()
             .join(nat.toDF("ck", "a"), F.expr("c_nationkey = ck")).join(nat.toDF("sk", "b"), F.expr("s_nationkey = sk")))
    lists = t_("nation").select(F.col("n_regionkey").alias("list_id"), F.col("n_name").alias("cls"))
    return reason.disjoint_pairs(asked.select("a", "b"), lists)


@case("R9_disjoint_violations", """
    select 'status' as list_id, 'order/' || cast(l_orderkey as varchar) as s, count(distinct l_linestatus) as n_classes,
      min(l_linestatus) as first_class, max(l_linestatus) as last_class
    from lineitem group by l_orderkey having count(distinct l_linestatus) > 1""")
def r9b(spark, sf):
    """Line statuses exclude each other; orders whose lines have several break that."""
    rows = table(spark, sf, "lineitem").select(F.concat(F.lit("order/"), F.col("l_orderkey").cast("string")).alias("s"),
                                               F.col("l_linestatus").alias("cls"))
    lists = rows.select(F.lit("status").alias("list_id"), "cls").distinct()
    return reason.disjoint_violations(rows, lists)


@case("R10_hierarchy_cycles", """with recursive e as (select distinct o_orderkey as child, o_custkey as parent from orders
        where o_orderkey in (select o_custkey from orders)),
    c(child, ancestor) as (select child, parent from e union select c.child, e.parent from c join e on c.ancestor = e.child)
    select child as node from c where child = ancestor""")
def r10(spark, sf):
    """Order numbers below customer numbers, read as one hierarchy of numbers: every node has one parent."""
    return reason.find_cycles(table(spark, sf, "orders"), "o_orderkey", "o_custkey")
