"""Graph patterns. Most cases read the mapped tables; the ``stored`` ones read generated triples."""
from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import functions as F

from suite.registry import NS, NULL, TYPE, case, i, money, n, t
from suite.scans import fresh
from suite.tables import mapping, table, tbox
from tripleframe import ClassMap, Graph, Literal, Mapping, Range, materialize
from tripleframe.sources.store import TripleStore


def graph(spark, sf, classes=None, edges=None, **kw):
    return Graph.virtual(mapping(spark, sf, classes, edges), **kw)


def stored(spark, sf, classes=None, edges=None):
    return Graph.materialized(materialize(mapping(spark, sf, classes, edges)), NS)


def cnt():
    return F.count(F.lit(1)).alias("n")

_OC = "orders join customer on o_custkey = c_custkey"
O, C = i("order", "o_orderkey"), i("customer", "c_custkey")


@case("Q1_single_pattern", f"select {O} as o, {C} as c from {_OC}")
def q1(spark, sf):
    return graph(spark, sf, ["Order", "Customer"]).match(("?o", "placedBy", "?c"))


@case("Q1_bound_object", f"select {O} as o from orders where o_custkey = (select min(c_custkey) from customer)")
def q1b(spark, sf):
    """The IRI constant becomes a condition on the key column."""
    return graph(spark, sf, ["Order", "Customer"]).match(("?o", "placedBy", f"{NS}customer/0"))


@case("Q2_orders_per_segment", f"select c_mktsegment as seg, count(*) as n from {_OC} group by 1")
def q2(spark, sf):
    return graph(spark, sf).match(("?o", "placedBy", "?c"), ("?c", "segment", "?seg")).groupBy("seg").agg(cnt())


@case("Q2_orders_per_segment_stored", f"select c_mktsegment as seg, count(*) as n from {_OC} group by 1")
def q2b(spark, sf):
    return stored(spark, sf, ["Order", "Customer"]).count_by(["seg"], ("?o", "placedBy", "?c"), ("?c", "segment", "?seg"))


@case("Q3_star", f"""select {i('part', 'p_partkey')} as x, p_name as name, p_brand as brand, p_type as kind, cast(p_size as varchar) as size
    from part where p_name is not null and p_brand is not null and p_type is not null and p_size is not null""")
def q3(spark, sf):
    return graph(spark, sf, ["Part"]).match(("?x", "a", "Part"), ("?x", "partName", "?name"), ("?x", "brand", "?brand"),
                                            ("?x", "partType", "?kind"), ("?x", "size", "?size"))


@case("Q3_star_stored", f"""select {i('part', 'p_partkey')} as x, p_name as name, p_brand as brand, p_type as kind, cast(p_size as varchar) as size
    from part""")
def q3b(spark, sf):
    return stored(spark, sf, ["Part"]).star("Part", {"name": "partName", "brand": "brand", "kind": "partType", "size": "size"})


@case("Q4_orders_per_region", f"""select r_name as region, count(*) as n from {_OC} join nation on c_nationkey = n_nationkey
    join region on n_regionkey = r_regionkey group by 1""")
def q4(spark, sf):
    return graph(spark, sf).count_by(["region"], ("?o", "placedBy", "?c"), ("?c", "customerNation", "?na"), ("?na", "inRegion", "?r"),
                                     ("?r", "regionName", "?region"))


@case("Q4_six_hops", """with op as (select distinct l_orderkey, l_partkey from lineitem), ps as (select distinct l_partkey, l_suppkey from lineitem)
    select r_name as region, count(*) as n from events join customer on user_id = c_custkey join orders on o_custkey = c_custkey
      join op on op.l_orderkey = o_orderkey join part on p_partkey = op.l_partkey join ps on ps.l_partkey = p_partkey
      join supplier on s_suppkey = ps.l_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey
    where event_type = 'error' group by 1""")
def q4b(spark, sf):
    return graph(spark, sf).count_by(
        ["region"], ("?e", "eventType", Literal("error")), ("?e", "performedBy", "?c"), ("?o", "placedBy", "?c"), ("?o", "containsPart", "?p"),
        ("?p", "suppliedBy", "?s"), ("?s", "supplierNation", "?na"), ("?na", "inRegion", "?r"), ("?r", "regionName", "?region"))


@case("Q5_inverse_step", f"select {C} as c, {O} as o, o_orderstatus as status from {_OC}")
def q5(spark, sf):
    return graph(spark, sf, ["Order", "Customer"]).match(("?c", "^placedBy", "?o"), ("?o", "status", "?status"))


@case("Q6_sequence_path", f"""select {O} as o, {i('nation', 'n_nationkey')} as na from {_OC} join nation on c_nationkey = n_nationkey""")
def q6(spark, sf):
    return graph(spark, sf, ["Order", "Customer", "Nation"]).match(("?o", ("placedBy", "customerNation"), "?na"))


@case("Q6_sequence_with_inverse", """select n_name as nation, count(*) as n from supplier join customer on c_nationkey = s_nationkey
    join nation on s_nationkey = n_nationkey group by 1""")
def q6b(spark, sf):
    return graph(spark, sf).count_by(["nation"], ("?s", ("supplierNation", "^customerNation"), "?c"), ("?s", ("supplierNation", "nationName"), "?nation"))


@case("Q7_class_assertion", f"""select {C} as x from customer union all select {i('supplier', 's_suppkey')} from supplier""")
def q7(spark, sf):
    """Members of a class that is only a superclass."""
    return graph(spark, sf, ["Customer", "Supplier"], [], tbox=tbox(spark)).match(("?x", "a", "Party"))


@case("Q7_overlapping_classes", f"select {O} as x, o_orderstatus as status from orders where o_orderstatus is not null")
def q7b(spark, sf):
    """Orders and urgent orders share IRIs; each order is one binding."""
    return graph(spark, sf, ["Order", "UrgentOrder"], [], tbox=tbox(spark)).match(("?x", "a", "Order"), ("?x", "status", "?status"))


@case("Q8_anchored_literal", f"select {C} as c, c_name as name from customer where c_mktsegment = 'MACHINERY'")
def q8(spark, sf):
    return graph(spark, sf, ["Customer"]).match(("?c", "segment", Literal("MACHINERY")), ("?c", "customerName", "?name"))


@case("Q9_numeric_compare", f"select {O} as o, cast(cast(o_totalprice as decimal(18,2)) as double) as total from orders where o_totalprice >= 250000")
def q9(spark, sf):
    return graph(spark, sf, ["Order"]).match(("?o", "total", "?total"), typed={"total": "decimal(18,2)"}, ranges={"total": Range(least=250000)}).select(
        "o", F.col("total").cast("double").alias("total"))


@case("Q9_numeric_compare_stored", f"""select {O} as o, {money('o_totalprice')} as total from orders where o_totalprice >= 250000""")
def q9b(spark, sf):
    from tripleframe import value
    return stored(spark, sf, ["Order"]).match(("?o", "total", "?total")).where(value("total", "decimal") >= 250000)


@case("Q9_range_of_stored_values", f"""select {O} as o, {money('o_totalprice')} as total from orders where o_totalprice >= 250000 and cast(o_totalprice as decimal(18,2)) < 300000.5""")
def q9c(spark, sf):
    """From a store that keeps numbers beside its literals, in their order."""
    kept = TripleStore(spark, fresh(spark, "values"))
    kept.refresh(materialize(mapping(spark, sf, ["Order", "Customer"])))
    return Graph.materialized(kept.load(values=True), NS).match(("?o", "total", "?total"), ranges={"total": Range(least=250000, below=Decimal("300000.5"))})


_AMOUNT = "cast(c_custkey as varchar) || '90071992547409931.00000000001'"


@case("Q9_long_numbers", f"""select {i('account', 'c_custkey')} as c, {_AMOUNT} as amount from customer
    where cast({_AMOUNT} as decimal(38,11)) > cast('790071992547409931.00000000001' as decimal(38,11)) and cast({_AMOUNT} as decimal(38,11)) <= cast('8990071992547409931.00000000001' as decimal(38,11))""")
def q9d(spark, sf):
    """Numbers that neither 64 bits nor doubles tell apart from the bounds, compared exactly."""
    rows = table(spark, sf, "customer").select("c_custkey", F.concat(F.col("c_custkey").cast("string"), F.lit("90071992547409931.00000000001")).alias("amount"))
    m = Mapping(NS, [ClassMap("Account", rows, ["c_custkey"], props={"amount": ("amount", "decimal")}, unique=True)])
    return Graph.virtual(m).match(("?c", "amount", "?amount"), ranges={"amount": Range(
        above=Decimal("790071992547409931.00000000001"), most=Decimal("8990071992547409931.00000000001"))})


@case("Q10_date_range", f"select {O} as o, cast(cast(o_orderdate as date) as varchar) as d from orders where o_orderdate >= date '1997-01-01' and o_orderdate < date '1998-01-01'")
def q10(spark, sf):
    return graph(spark, sf, ["Order"]).match(("?o", "orderDate", "?d"), ranges={"d": Range(least=date(1997, 1, 1), below=date(1998, 1, 1))})


@case("Q10_datetime_range", f"""select {i('event', 'event_id')} as e, replace(cast(ts as varchar), ' ', 'T') as at from events
    where ts >= timestamp '2024-01-05 00:00:00' and ts < timestamp '2024-01-12 12:30:00'""")
def q10b(spark, sf):
    return graph(spark, sf, ["Event"]).match(("?e", "at", "?at"), ranges={"at": Range(least=datetime(2024, 1, 5), below=datetime(2024, 1, 12, 12, 30))})


@case("Q11_in_filter", f"select {i('part', 'p_partkey')} as p, p_brand as brand from part where p_brand in ('Brand#1', 'Brand#12', 'Brand#23')")
def q11(spark, sf):
    return graph(spark, sf, ["Part"]).match(("?p", "brand", "?brand")).where(F.col("brand").isin("Brand#1", "Brand#12", "Brand#23"))


@case("Q12_starts_with", f"select {i('part', 'p_partkey')} as p, p_name as name from part where starts_with(p_name, 'red')")
def q12(spark, sf):
    return graph(spark, sf, ["Part"]).match(("?p", "partName", "?name")).where(F.col("name").startswith("red"))


@case("Q13_contains", f"select {i('page', 'page_id')} as p, url from pages where contains(url, '/en/')")
def q13(spark, sf):
    return graph(spark, sf, ["Page"]).match(("?p", "url", "?url")).where(F.col("url").contains("/en/"))


@case("Q14_tolerance", """select count(*) as n from (select cast(o_totalprice as decimal(18,2)) as a, cast(c_acctbal as decimal(18,2)) as b from orders
    join customer on o_custkey = c_custkey) where abs(a - b * 100) < 1000""")
def q14(spark, sf):
    rows = graph(spark, sf).match(("?o", "total", "?t"), ("?o", "placedBy", "?c"), ("?c", "balance", "?b"),
                                  typed={"t": "decimal(18,2)", "b": "decimal(18,2)"})
    return rows.where(F.abs(F.col("t") - F.col("b") * 100) < 1000).agg(cnt())


@case("Q15_orders_by_month", "select cast(year(o_orderdate) as integer) as y, cast(month(o_orderdate) as integer) as m, count(*) as n from orders group by 1, 2")
def q15(spark, sf):
    return graph(spark, sf, ["Order"]).match(("?o", "orderDate", "?d"), typed={"d": "date"}).groupBy(
        F.year("d").alias("y"), F.month("d").alias("m")).agg(cnt())


@case("Q16_datatype", """select 'decimal' as datatype, count(*) as n from part union all select 'integer', count(*) from part
    union all select 'string', count(*) * 3 from part union all select '-', count(*) from part""")
def q16(spark, sf):
    rows = graph(spark, sf, ["Part"]).match(("?p", "?pred", "?v"), with_types=True)
    return rows.groupBy(F.coalesce("v__type", F.lit("-")).alias("datatype")).agg(cnt())


@case("Q17_lexical_value", f"""select {i('event', 'event_id')} as e, length({money('value')}) as len, {money('value')} as text from events""")
def q17(spark, sf):
    return graph(spark, sf, ["Event"]).match(("?e", "value", "?text")).select("e", F.length("text").cast("bigint").alias("len"), "text")


@case("Q18_boolean_filter", f"""select {i('order', 'o_orderkey')} as o, c_name as name from {_OC}
    where o_orderstatus = 'F' and (c_mktsegment = 'BUILDING' or c_acctbal < 0) and o_totalprice > c_acctbal""")
def q18(spark, sf):
    rows = graph(spark, sf).match(("?o", "status", "?st"), ("?o", "total", "?t"), ("?o", "placedBy", "?c"), ("?c", "segment", "?seg"),
                                  ("?c", "balance", "?b"), ("?c", "customerName", "?name"), typed={"t": "decimal(18,2)", "b": "decimal(18,2)"})
    return rows.where("st = 'F' and (seg = 'BUILDING' or b < 0) and t > b").select("o", "name")


@case("Q19_counts", f"select count(*) as rows, count(c_custkey) as bound, count(distinct c_custkey) as customers from {_OC}")
def q19(spark, sf):
    return graph(spark, sf, ["Order", "Customer"]).aggregate(
        [], {"rows": ("count", None), "bound": ("count", "c"), "customers": ("count_distinct", "c")}, ("?o", "placedBy", "?c"))


@case("Q20_value_by_type", """select event_type as kind, cast(sum(cast(value as decimal(18,2))) as double) as total,
    cast(min(cast(value as decimal(18,2))) as double) as smallest from events group by 1""")
def q20(spark, sf):
    found = graph(spark, sf, ["Event"]).aggregate(["kind"], {"total": ("sum", "v"), "smallest": ("min", "v")}, ("?e", "eventType", "?kind"), ("?e", "value", "?v"), typed={"v": "decimal(18,2)"})
    return found.select("kind", F.col("total").cast("double"), F.col("smallest").cast("double"))


@case("Q21_group_by_two", f"select c_mktsegment as seg, o_orderpriority as pr, count(*) as n from {_OC} group by 1, 2")
def q21(spark, sf):
    return graph(spark, sf).match(("?o", "placedBy", "?c"), ("?c", "segment", "?seg"), ("?o", "priority", "?pr")).groupBy("seg", "pr").agg(cnt())


@case("Q22_big_customers", f"""select {C} as c, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as total from {_OC} group by c_custkey
    having sum(cast(o_totalprice as decimal(18,2))) > 3000000""")
def q22(spark, sf):
    rows = graph(spark, sf).aggregate(["c"], {"s": ("sum", "t")}, ("?o", "placedBy", "?c"), ("?o", "total", "?t"), typed={"t": "decimal(18,2)"})
    return rows.where("s > 3000000").select("c", F.col("s").cast("double").alias("total"))


@case("Q22_spend_per_region", """select r_name as region, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as spent, cast(min(cast(o_totalprice as decimal(18,2))) as double) as least,
      cast(max(cast(o_totalprice as decimal(18,2))) as double) as most, cast(count(*) as bigint) as n, count(distinct c_custkey) as customers,
      cast(sum(cast(c_acctbal as decimal(18,2))) as double) as owed
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by r_name""")
def q22b(spark, sf):
    """Sums, extremes and distinct counts over a chain of joins, carried through it per key."""
    found = graph(spark, sf, ["Order", "Customer", "Nation", "Region"]).aggregate(
        ["region"], {"spent": ("sum", "t"), "least": ("min", "t"), "most": ("max", "t"), "n": ("count", None), "customers": ("count_distinct", "c"), "owed": ("sum", "b")},
        ("?o", "total", "?t"), ("?o", "placedBy", "?c"), ("?c", "balance", "?b"), ("?c", "customerNation", "?n"), ("?n", "inRegion", "?r"), ("?r", "regionName", "?region"),
        typed={"t": "decimal(18,2)", "b": "decimal(18,2)"})
    return found.select("region", "n", "customers", *[F.col(c).cast("double").alias(c) for c in ("spent", "least", "most", "owed")])


@case("Q23_top_customers", f"select {C} as c, count(*) as n from {_OC} group by c_custkey order by 2 desc, 1 limit 5")
def q23(spark, sf):
    return graph(spark, sf, ["Order", "Customer"]).count_by(["c"], ("?o", "placedBy", "?c")).orderBy(F.desc("n"), "c").limit(5)


@case("Q23_offset", f"select {C} as c, count(*) as n from {_OC} group by c_custkey order by 2 desc, 1 limit 10 offset 20")
def q23b(spark, sf):
    return graph(spark, sf, ["Order", "Customer"]).count_by(["c"], ("?o", "placedBy", "?c")).orderBy(F.desc("n"), "c").offset(20).limit(10)


@case("Q24_ask", "select 'yes' as question, exists(select 1 from customer where c_mktsegment = 'MACHINERY') as answer union all select 'no', exists(select 1 from customer where c_mktsegment = 'NOTHING')")
def q24(spark, sf):
    g = graph(spark, sf, ["Customer"])
    yes, no = (g.ask(("?c", "segment", Literal(v))) for v in ("MACHINERY", "NOTHING"))
    return yes.select(F.lit("yes").alias("question"), "answer").union(no.select(F.lit("no"), "answer"))


@case("Q25_construct", f"""
    select distinct {t(C, n('boughtPart'), i('part', 'l_partkey'))} from lineitem join {_OC} on l_orderkey = o_orderkey
      where l_partkey in (select p_partkey from part)
    union all select distinct {t(C, TYPE, n('Buyer'))} from lineitem join {_OC} on l_orderkey = o_orderkey
      where l_partkey in (select p_partkey from part)""")
def q25(spark, sf):
    return graph(spark, sf).construct([("?c", "boughtPart", "?p"), ("?c", "a", "Buyer")], ("?o", "placedBy", "?c"), ("?o", "containsPart", "?p"))


_DESCRIBE = f"""
    with x as (select * from orders where o_orderkey = (select min(o_orderkey) from orders))
    select {t(O, TYPE, n('Order'))} from x union all select {t(O, TYPE, n('UrgentOrder'))} from x where o_orderpriority = '1-URGENT'
    union all select {t(O, n('status'), 'o_orderstatus', 'string')} from x union all select {t(O, n('total'), money('o_totalprice'), 'decimal')} from x
    union all select {t(O, n('orderDate'), 'cast(cast(o_orderdate as date) as varchar)', 'date')} from x
    union all select {t(O, n('priority'), 'o_orderpriority', 'string')} from x
    union all select {t(O, n('placedBy'), i('customer', 'o_custkey'))} from x
    union all select distinct {t(O, n('containsPart'), i('part', 'l_partkey'))} from x join lineitem on l_orderkey = o_orderkey"""


@case("Q26_describe", _DESCRIBE)
def q26(spark, sf):
    return graph(spark, sf).describe(f"{NS}order/0")


@case("Q27_variable_predicate", f"""select p, count(*) as n, count(distinct x) as things from (
      select {C} as x, {n('segment')} as p from customer where c_mktsegment is not null union all select {C}, {n('customerName')} from customer where c_name is not null
      union all select {C}, {n('balance')} from customer where c_acctbal is not null
      union all select {C}, {n('customerNation')} from customer join nation on c_nationkey = n_nationkey
      union all select {C}, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' from customer) group by 1""")
def q27(spark, sf):
    return graph(spark, sf).match(("?x", "a", "Customer"), ("?x", "?p", "?v")).groupBy("p").agg(cnt(), F.count_distinct("x").alias("things"))


@case("Q28_shared_nation", """select n_name as nation, count(*) as n from customer join nation on c_nationkey = n_nationkey
    join supplier on s_nationkey = n_nationkey group by 1""")
def q28(spark, sf):
    return graph(spark, sf).count_by(["nation"], ("?c", "customerNation", "?na"), ("?s", "supplierNation", "?na"), ("?na", "nationName", "?nation"))


@case("Q28_branching", """select c_mktsegment as seg, p_brand as brand, count(*) as n from events join customer on user_id = c_custkey
    join orders on o_custkey = c_custkey join (select distinct l_orderkey, l_partkey from lineitem) on l_orderkey = o_orderkey
    join part on l_partkey = p_partkey where event_type = 'click' group by 1, 2""")
def q28b(spark, sf):
    return graph(spark, sf).count_by(
        ["seg", "brand"], ("?e", "eventType", Literal("click")), ("?e", "performedBy", "?c"), ("?c", "segment", "?seg"), ("?o", "placedBy", "?c"),
        ("?o", "containsPart", "?p"), ("?p", "brand", "?brand"))


@case("Q29_routes_agree", f"""select 'both' as side, {C} as c, r_name as region, o_orderpriority as pr, count(*) as n from {_OC}
    join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by c_custkey, r_name, o_orderpriority""")
def q29(spark, sf):
    """Bindings of both routes, each counted; a group that only one route has would show up under its name."""
    patterns = [("?o", "placedBy", "?c"), ("?c", ("customerNation", "inRegion", "regionName"), "?region"), ("?o", "priority", "?pr")]
    kw = (["Order", "Customer", "Nation", "Region"],)
    a = graph(spark, sf, *kw).match(*patterns).groupBy("c", "region", "pr").agg(cnt())
    b = stored(spark, sf, *kw).match(*patterns).groupBy("c", "region", "pr").agg(cnt())
    sides = a.withColumn("v", F.lit(1)).withColumn("w", F.lit(0)).union(b.withColumn("v", F.lit(0)).withColumn("w", F.lit(1)))
    per = sides.groupBy("c", "region", "pr", "n").agg(F.max("v").alias("v"), F.max("w").alias("w"))
    side = F.when((F.col("v") == 1) & (F.col("w") == 1), "both").when(F.col("v") == 1, "virtual").otherwise("stored")
    return per.select(side.alias("side"), "c", "region", "pr", "n")


@case("Q30_class_census", f"""select {n('Region')} as cls, count(*) as n from region union all select {n('Nation')}, count(*) from nation
    union all select {n('Customer')}, count(*) from customer union all select {n('Supplier')}, count(*) from supplier
    union all select {n('Part')}, count(*) from part union all select {n('Order')}, count(*) from orders
    union all select {n('UrgentOrder')}, count(*) from orders where o_orderpriority = '1-URGENT'
    union all select {n('Event')}, count(*) from events union all select {n('Document')}, count(*) from documents
    union all select {n('Assessment')}, count(*) from labels union all select {n('Turn')}, count(*) from conversations
    union all select {n('Page')}, count(*) from pages""")
def q30(spark, sf):
    return graph(spark, sf).census()


@case("Q30_triple_count", f"""select (select count(*) + count(c_name) + count(c_mktsegment) + count(c_acctbal) from customer)
    + (select count(*) + count(o_orderstatus) + count(o_totalprice) + count(o_orderdate) + count(o_orderpriority) from orders)
    + (select count(*) from {_OC}) as n""")
def q30b(spark, sf):
    return graph(spark, sf, ["Customer", "Order"]).triple_count()


@case("Q31_optional", f"""select {i('document', 'd.doc_id')} as d, lang, cast(quality as varchar) as quality from documents d
    left join labels l on l.doc_id = d.doc_id where lang is not null""")
def q31a(spark, sf):
    g = graph(spark, sf, ["Document", "Assessment"])
    docs = g.match(("?d", "lang", "?lang"))
    return g.optional(docs, ("?d", ("hasAssessment", "quality"), "?quality"))


@case("Q31_minus", f"select {i('document', 'doc_id')} as d, lang from documents where lang is not null and doc_id not in (select doc_id from labels)")
def q31b(spark, sf):
    g = graph(spark, sf, ["Document", "Assessment"])
    return g.minus(g.match(("?d", "lang", "?lang")), ("?d", "hasAssessment", "?a"))


@case("Q31_exists", f"select {C} as c, c_name as name from customer where c_custkey in (select user_id from events where event_type = 'error')")
def q31c(spark, sf):
    g = graph(spark, sf, ["Customer", "Event"])
    return g.exists(g.match(("?c", "customerName", "?name")), ("?e", "performedBy", "?c"), ("?e", "eventType", Literal("error")))


@case("Q31_union", f"select {C} as x, c_name as name from customer union all select {i('supplier', 's_suppkey')}, s_name from supplier")
def q31d(spark, sf):
    g = graph(spark, sf, ["Customer", "Supplier"])
    return g.match(("?x", "customerName", "?name")).unionByName(g.match(("?x", "supplierName", "?name")))


@case("Q31_values", f"select {C} as c, c_mktsegment as seg, case c_mktsegment when 'BUILDING' then 1 else 2 end as rank from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def q31e(spark, sf):
    rows = graph(spark, sf, ["Customer"]).match(("?c", "segment", "?seg"))
    inline = spark.createDataFrame([("BUILDING", 1), ("MACHINERY", 2)], "seg string, rank int")
    return rows.join(inline, "seg")


@case("Q31_bind_distinct_avg_max", """select cast(n_chars // 1000 as bigint) as thousands, lang, cast(avg(n_chars) as double) as mean, max(n_chars) as longest,
    count(distinct source) as sources from documents where lang is not null and source is not null and n_chars is not null group by 1, 2""")
def q31f(spark, sf):
    rows = graph(spark, sf, ["Document"]).match(("?d", "lang", "?lang"), ("?d", "nChars", "?nc"), ("?d", "source", "?src"), typed={"nc": "integer"})
    return rows.withColumn("thousands", F.floor(F.col("nc") / 1000)).groupBy("thousands", "lang").agg(
        F.avg("nc").alias("mean"), F.max("nc").alias("longest"), F.count_distinct("src").alias("sources"))


@case("Q7_inverse_rewriting", f"select {C} as c, {O} as o from {_OC}")
def q7c(spark, sf):
    """`places` is not mapped; it is answered from its inverse `placedBy`."""
    return graph(spark, sf, ["Order", "Customer"], tbox=tbox(spark), inverse=True).match(("?c", "places", "?o"))


@case("Q5_super_property", f"""select {C} as x, {i('nation', 'c_nationkey')} as place from customer join nation on c_nationkey = n_nationkey
    union all select {i('supplier', 's_suppkey')}, {i('nation', 's_nationkey')} from supplier join nation on s_nationkey = n_nationkey
    union all select {i('nation', 'n_nationkey')}, {i('region', 'n_regionkey')} from nation join region on n_regionkey = r_regionkey""")
def q5b(spark, sf):
    return graph(spark, sf, tbox=tbox(spark)).match(("?x", "locatedIn", "?place"))
