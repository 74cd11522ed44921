"""Triple construction."""
from __future__ import annotations

from pyspark.sql import functions as F

from suite.registry import NS, NULL, TYPE, case, i, money, n, t
from suite.tables import class_map, mapping, table
from tripleframe import ClassMap, EdgeMap, Mapping, class_triples, const_edge, edge_triples, lexical, literal_triples, mapping_stats, materialize
from tripleframe.functions import iri
from tripleframe.operators.triplify import emitted, with_total


@case("T1_iri_template", f"""
    select 'page' as kind, '{NS}page/' || url_encode(url) as iri from pages where url is not null
    union all select 'brand', '{NS}brand/' || url_encode(p_brand) || '-' || url_encode(p_name) from part
    union all select 'source', '{NS}source/' || url_encode(source) || '-' || cast(doc_id as varchar) from documents where source is not null
    union all select 'event', '{NS}props/' || url_encode(props) from events where props is not null""")
def t1(spark, sf):
    pick = lambda name, kind, *cols: table(spark, sf, name).select(
        F.lit(kind).alias("kind"), iri(f"{NS}{kind if kind != 'event' else 'props'}/", [F.col(c) for c in cols]).alias("iri")).where("iri is not null")
    return (pick("pages", "page", "url").union(pick("part", "brand", "p_brand", "p_name"))
            .union(pick("documents", "source", "source", "doc_id")).union(pick("events", "event", "props")))


@case("T2_class_triples", f"select {t(i('customer', 'c_custkey'), TYPE, n('Customer'))} from customer where c_custkey is not null")
def t2(spark, sf):
    return class_triples(mapping(spark, sf, ["Customer"], []), class_map(spark, sf, "Customer"))


@case("T3_literal_triples", f"""
    select {t(i('order', 'o_orderkey'), n('total'), money('o_totalprice'), 'decimal')} from orders where o_totalprice is not null
    union all select {t(i('document', 'doc_id'), n('source'), 'source', 'string')} from documents where source is not null""")
def t3(spark, sf):
    m = mapping(spark, sf, ["Order", "Document"], [])
    return literal_triples(m, m.by_name["Order"], "total").union(literal_triples(m, m.by_name["Document"], "source"))


@case("T4_lexical_forms", """
    select event_id, cast(cast(ts as date) as varchar) as as_date, strftime(ts, '%H:%M:%S') as as_time,
      replace(cast(ts as varchar), ' ', 'T') as as_datetime, cast(cast(value as decimal(18,2)) as varchar) as as_decimal,
      cast(value > 50 as varchar) as as_boolean, cast(user_id as varchar) as as_integer, event_type as as_string from events""")
def t4(spark, sf):
    e = table(spark, sf, "events")
    ts = e.schema["ts"].dataType
    return e.select("event_id", lexical(F.col("ts"), "date", ts).alias("as_date"), lexical(F.col("ts"), "time", ts).alias("as_time"),
                    lexical(F.col("ts"), "dateTime", ts).alias("as_datetime"), lexical(F.col("value"), "decimal(18,2)").alias("as_decimal"),
                    lexical(F.col("value") > 50, "boolean").alias("as_boolean"), lexical(F.col("user_id"), "integer").alias("as_integer"),
                    lexical(F.col("event_type"), "string").alias("as_string"))


_PLACED = t(i("order", "o_orderkey"), n("placedBy"), i("customer", "o_custkey"))


@case("T5_edge_domain_fk", f"select {_PLACED} from orders where exists (select 1 from customer where c_custkey = o_custkey)")
def t5(spark, sf):
    return edge_triples(mapping(spark, sf, ["Order", "Customer"], ["placedBy"]), "placedBy")


@case("T6_edge_range_fk", f"""
    select {t(i('document', 'doc_id'), n('hasAssessment'), i('assessment', 'doc_id'))} from labels
      where doc_id in (select doc_id from documents)
    union all select {t(i('customer', 'o_custkey'), n('places'), i('order', 'o_orderkey'))} from orders
      where o_custkey in (select c_custkey from customer)""")
def t6(spark, sf):
    m = mapping(spark, sf, ["Document", "Assessment", "Customer", "Order"], ["hasAssessment", "places"])
    return edge_triples(m, "hasAssessment").union(edge_triples(m, "places"))


@case("T7_edge_junction", f"""
    select distinct {t(i('order', 'l_orderkey'), n('containsPart'), i('part', 'l_partkey'))} from lineitem
      where l_orderkey in (select o_orderkey from orders) and l_partkey in (select p_partkey from part)
    union all select distinct {t(i('part', 'l_partkey'), n('suppliedBy'), i('supplier', 'l_suppkey'))} from lineitem
      where l_partkey in (select p_partkey from part) and l_suppkey in (select s_suppkey from supplier)""")
def t7(spark, sf):
    m = mapping(spark, sf, ["Order", "Part", "Supplier"], ["containsPart", "suppliedBy"])
    return edge_triples(m, "containsPart").union(edge_triples(m, "suppliedBy"))


@case("T8_composite_keys", f"""
    select {t(i('turn', 'conv_id', 'turn'), n('replyTo'), i('turn', 'conv_id', 'turn - 1'))} from conversations c
      where exists (select 1 from conversations p where p.conv_id = c.conv_id and p.turn = c.turn - 1)
    union all select {t(i('turn', 'conv_id', 'turn'), TYPE, n('Turn'))} from conversations""")
def t8(spark, sf):
    c = table(spark, sf, "conversations").withColumn("before", F.col("turn") - 1)
    turn = ClassMap("Turn", c, ["conv_id", "turn"], unique=True)
    return materialize(Mapping(NS, [turn], [EdgeMap("replyTo", "Turn", "Turn", "domain_fk", ["conv_id", "before"])]))


@case("T10_const_edge", f"select {t(i('supplier', 's_suppkey'), n('partOf'), n('network/main'))} from supplier")
def t10(spark, sf):
    return const_edge(mapping(spark, sf, ["Supplier"], []), class_map(spark, sf, "Supplier"), "partOf", "network/main")


_SMALL = f"""
    select {t(i('nation', 'n_nationkey'), TYPE, n('Nation'))} from nation
    union all select {t(i('nation', 'n_nationkey'), n('nationName'), 'n_name', 'string')} from nation
    union all select {t(i('region', 'r_regionkey'), TYPE, n('Region'))} from region
    union all select {t(i('region', 'r_regionkey'), n('regionName'), 'r_name', 'string')} from region
    union all select {t(i('supplier', 's_suppkey'), TYPE, n('Supplier'))} from supplier
    union all select {t(i('supplier', 's_suppkey'), n('supplierName'), 's_name', 'string')} from supplier
    union all select {t(i('supplier', 's_suppkey'), n('supplierBalance'), money('s_acctbal'), 'decimal')} from supplier
    union all select {t(i('nation', 'n_nationkey'), n('inRegion'), i('region', 'n_regionkey'))} from nation
    union all select {t(i('supplier', 's_suppkey'), n('supplierNation'), i('nation', 's_nationkey'))} from supplier"""


@case("T11_union_of_mappings", _SMALL)
def t11(spark, sf):
    return emitted(mapping(spark, sf, ["Nation", "Region", "Supplier"]))


@case("T12_graph_set", f"""
    select {t(i('line', 'l_orderkey', 'l_linenumber'), TYPE, n('Line'))} from (select distinct l_orderkey, l_linenumber from lineitem)
    union all select distinct {t(i('line', 'l_orderkey', 'l_linenumber'), n('flag'), 'l_returnflag', 'string')} from lineitem
    union all select distinct {t(i('line', 'l_orderkey', 'l_linenumber'), n('ofPart'), i('part', 'l_partkey'))} from lineitem
      where l_partkey in (select p_partkey from part)
    union all select {t(i('part', 'p_partkey'), TYPE, n('Part'))} from part""")
def t12(spark, sf):
    """The key of a line repeats in the data, so lines collapse to a set."""
    line = ClassMap("Line", table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], props={"flag": ("l_returnflag", "string")})
    part = class_map(spark, sf, "Part", props={})
    return materialize(Mapping(NS, [line, part], [EdgeMap("ofPart", "Line", "Part", "domain_fk", ["l_partkey"])]))


@case("T12_materialize_all", f"""
    select p, o_kind, coalesce(o_type, '-') as o_type, count(*) as n, count(distinct s) as subjects from (
      select {t(i('customer', 'c_custkey'), TYPE, n('Customer'))} from customer
      union all select {t(i('customer', 'c_custkey'), n('segment'), 'c_mktsegment', 'string')} from customer where c_mktsegment is not null
      union all select {t(i('customer', 'c_custkey'), n('customerName'), 'c_name', 'string')} from customer where c_name is not null
      union all select {t(i('customer', 'c_custkey'), n('balance'), money('c_acctbal'), 'decimal')} from customer where c_acctbal is not null
      union all select {t(i('order', 'o_orderkey'), TYPE, n('Order'))} from orders
      union all select {t(i('order', 'o_orderkey'), TYPE, n('UrgentOrder'))} from orders where o_orderpriority = '1-URGENT'
      union all select {t(i('order', 'o_orderkey'), n('status'), 'o_orderstatus', 'string')} from orders where o_orderstatus is not null
      union all select {t(i('order', 'o_orderkey'), n('total'), money('o_totalprice'), 'decimal')} from orders where o_totalprice is not null
      union all select {t(i('order', 'o_orderkey'), n('orderDate'), 'cast(cast(o_orderdate as date) as varchar)', 'date')} from orders where o_orderdate is not null
      union all select {t(i('order', 'o_orderkey'), n('priority'), 'o_orderpriority', 'string')} from orders where o_orderpriority is not null
      union all select {_PLACED} from orders where o_custkey in (select c_custkey from customer)
      union all select {t(i('part', 'p_partkey'), TYPE, n('Part'))} from part
      union all select {t(i('part', 'p_partkey'), n('partName'), 'p_name', 'string')} from part where p_name is not null
      union all select {t(i('part', 'p_partkey'), n('brand'), 'p_brand', 'string')} from part where p_brand is not null
      union all select {t(i('part', 'p_partkey'), n('partType'), 'p_type', 'string')} from part where p_type is not null
      union all select {t(i('part', 'p_partkey'), n('size'), 'cast(p_size as varchar)', 'integer')} from part where p_size is not null
      union all select {t(i('part', 'p_partkey'), n('price'), money('p_retailprice'), 'decimal')} from part where p_retailprice is not null
      union all select distinct {t(i('order', 'l_orderkey'), n('containsPart'), i('part', 'l_partkey'))} from lineitem
        where l_orderkey in (select o_orderkey from orders) and l_partkey in (select p_partkey from part)
    ) group by 1, 2, 3""")
def t12b(spark, sf):
    m = mapping(spark, sf, ["Customer", "Order", "UrgentOrder", "Part"], ["placedBy", "containsPart"])
    return materialize(m).groupBy("p", "o_kind", F.coalesce("o_type", F.lit("-")).alias("o_type")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("subjects"))


@case("T13_mapping_stats", f"""
    with c as (select 'map-nation' as mapping, count(*) + count(n_name) as n from nation
      union all select 'map-region', count(*) + count(r_name) from region
      union all select 'map-supplier', count(*) + count(s_name) + count(s_acctbal) from supplier
      union all select 'map-part', count(*) + count(p_name) + count(p_brand) + count(p_type) + count(p_size) + count(p_retailprice) from part
      union all select 'map-inregion', count(*) from nation join region on n_regionkey = r_regionkey
      union all select 'map-suppliernation', count(*) from supplier join nation on s_nationkey = n_nationkey
      union all select 'map-suppliedby', count(*) from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey)
    select mapping, n as n_triples from c union all select 'total', cast(sum(n) as bigint) from c""")
def t13(spark, sf):
    return with_total(mapping_stats(mapping(spark, sf, ["Nation", "Region", "Supplier", "Part"])))


@case("T14_filtered_source", f"select {t(i('order', 'o_orderkey'), TYPE, n('UrgentOrder'))} from orders where o_orderpriority = '1-URGENT'")
def t14(spark, sf):
    return class_triples(mapping(spark, sf, ["UrgentOrder"], []), class_map(spark, sf, "UrgentOrder"))


@case("T2_null_keys_dropped", f"""
    select {t(i('event', 'event_id'), n('performedBy'), i('customer', 'user_id'))} from events where user_id <> 3 and user_id in (select c_custkey from customer)
    union all select {t(i('event', 'event_id'), TYPE, n('Event'))} from events
    union all select {t(i('event', 'event_id'), n('kind'), 'event_type', 'string')} from events where event_type <> 'error'
    union all select {t(i('customer', 'c_custkey'), TYPE, n('Customer'))} from customer""")
def t2b(spark, sf):
    """A NULL key drops the edge, a NULL value drops the literal; nothing else of the row is lost."""
    e = table(spark, sf, "events").select("event_id", F.nullif(F.col("user_id"), F.lit(3)).alias("user_id"),
                                          F.nullif(F.col("event_type"), F.lit("error")).alias("kind"))
    ev = ClassMap("Event", e, ["event_id"], props={"kind": ("kind", "string")}, unique=True)
    cu = class_map(spark, sf, "Customer", props={})
    return materialize(Mapping(NS, [ev, cu], [EdgeMap("performedBy", "Event", "Customer", "domain_fk", ["user_id"])]))
