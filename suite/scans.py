"""Sources, sinks and mapping compilation."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from suite.registry import NS, TYPE, case, i, money, n, t
from suite.tables import class_map, mapping, table
from tripleframe import ClassMap, EdgeMap, Graph, Mapping, class_triples, direct_map, literal_triples, mapping_stats, materialize
from tripleframe.plans.support import shared_dir, union_all
from tripleframe.sources import ontology, tables as src, triples as store
from tripleframe.sources.store import TripleStore


ENTITIES_PER_FILE = 100_000  # of an ontology, some 25 MB


def fresh(spark, name: str) -> str:
    """A new folder under the shared one for every run."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@case("S1_table_scan", "select o_orderkey, o_custkey, o_orderstatus from orders where o_orderpriority = '1-URGENT'")
def s1(spark, sf):
    return src.source(spark, f"{sf}/orders.parquet").where("o_orderpriority = '1-URGENT'").select(
        "o_orderkey", "o_custkey", "o_orderstatus")


@case("S3_read_ontology", f"""
    select {n('brand/')} || replace(p_brand, '#', '') as target, 'subClassOf' as axiom, 'class' as kind,
           count(*) as n_entities from part group by 1
    union all select {n('size/')} || cast(p_size as varchar), 'disjointWith', 'class', count(*) from part group by 1
    union all select 'label ' || p_name, 'label', 'class', count(*) from part group by 1""")
def s3(spark, sf):
    """One class element per part: its brand is the superclass, its size a disjoint class."""
    path = fresh(spark, "ontology")
    ref = lambda part, col: F.struct(F.concat(F.lit(NS + part), col).alias("_rdf:resource"))
    doc = table(spark, sf, "part").select(
        F.concat(F.lit(NS + "part/"), F.col("p_partkey").cast("string")).alias("_rdf:about"),
        F.col("p_name").alias("rdfs:label"), ref("brand/", F.regexp_replace("p_brand", "#", "")).alias("rdfs:subClassOf"),
        ref("size/", F.col("p_size").cast("string")).alias("owl:disjointWith"))
    root = ("rdf:RDF xmlns:rdf='http://www.w3.org/1999/02/22-rdf-syntax-ns#' "
            "xmlns:rdfs='http://www.w3.org/2000/01/rdf-schema#' xmlns:owl='http://www.w3.org/2002/07/owl#'")
    # An XML file is read whole by one task.
    doc.write.format("xml").option("rootTag", root).option("rowTag", "owl:Class").option(
        "validateName", False).option("maxRecordsPerFile", ENTITIES_PER_FILE).save(path)
    got = ontology.read_ontology(spark, path)
    axioms = got.axioms.groupBy("target", "axiom", "kind").agg(F.count(F.lit(1)).alias("n_entities"))
    labels = got.entities.groupBy(F.concat(F.lit("label "), "label").alias("target"), F.lit("label").alias("axiom"),
                                  "kind").agg(F.count(F.lit(1)).alias("n_entities"))
    return axioms.unionByName(labels)


def _texts(spark, sf):
    """Document texts and page addresses as literals: quotes, tabs, line breaks and accents included."""
    docs = ClassMap("Document", table(spark, sf, "documents"), ["doc_id"], props={"text": ("text", "string")}, unique=True)
    page = ClassMap("Page", table(spark, sf, "pages"), ["page_id"], props={"url": ("url", "string")}, unique=True)
    return Mapping(NS, [docs, page])


_TYPE_SQL = f"""union all select {t(i('document', 'doc_id'), TYPE, n('Document'))} from documents union all select {t(i('page', 'page_id'), TYPE, n('Page'))} from pages"""
_TEXT_SQL = f"""
    select s, p, md5(o) as o_md5, length(o) as o_length, o_kind, o_type from (
      select {t(i('document', 'doc_id'), n('text'), 'text', 'string')} from documents where text is not null
      union all select {t(i('page', 'page_id'), n('url'), 'url', 'string')} from pages where url is not null
      {_TYPE_SQL})"""


@case("S5_read_ntriples", _TEXT_SQL)
def s5(spark, sf):
    path = fresh(spark, "nt")
    store.write_ntriples(materialize(_texts(spark, sf)), path)
    good, _ = store.read_ntriples(spark, path)
    return good.select("s", "p", F.md5("o").alias("o_md5"), F.length("o").cast("bigint").alias("o_length"),
                                               "o_kind", "o_type")


@case("S5_every_escape", f"""
    select {i('document', 'doc_id')} as s, {n('text')} as p, md5(text) as o_md5, '@' || coalesce(lang, 'und') as o_type from documents where text is not null
    union all select '_:b' || cast(page_id as varchar), {n('é')}, md5(url), {n('address')} from pages where url is not null
    union all select {i('customer', 'c_custkey')}, {n('note')}, md5(chr(39) || c_name || chr(9) || chr(8) || chr(12) || chr(13) || chr(92) || 'n'), 'string' from customer""")
def s5c(spark, sf):
    """Texts with all their characters as code points, language tags, types of one's own, blank nodes, every short escape, missing blanks and comments behind triples."""
    path = fresh(spark, "ntescapes")
    long = F.regexp_replace(F.hex(F.encode("text", "UTF-32")), ".{8}", r"\\U$0")
    coded = F.when(F.rlike("text", F.lit(r"[\x{10000}-\x{10FFFF}]")), F.regexp_replace(long, r"\\U0000(.{4})", r"\\u$1")).otherwise(
        F.regexp_replace(F.hex(F.encode("text", "UTF-16BE")), ".{4}", r"\\u$0"))
    iri = lambda path_, key: F.concat(F.lit(f"<{NS}{path_}/"), F.col(key).cast("string"), F.lit(">"))
    docs = table(spark, sf, "documents").where("text is not null").select(F.concat(
        iri("document", "doc_id"), F.lit(f"\t<{NS}text>"), F.lit('"'), coded, F.lit('"@'), F.coalesce("lang", F.lit("und")), F.lit(' .  # "a" <b> .')).alias("value"))
    pages = table(spark, sf, "pages").where("url is not null").select(F.concat(
        F.lit("_:b"), F.col("page_id").cast("string"), F.lit(f' <{NS}\\u00E9> "'), "url", F.lit(f'"^^<{NS}address>.#')).alias("value"))
    notes = table(spark, sf, "customer").select(F.concat(iri("customer", "c_custkey"), F.lit(f" <{NS}note> "), F.lit('"\\\''), "c_name", F.lit('\\t\\b\\f\\r\\\\n" .')).alias("value"))
    union_all([docs, pages, notes]).write.text(path)
    good, bad = store.read_ntriples(spark, path)
    return good.select("s", "p", F.md5("o").alias("o_md5"), "o_type").union(bad.select("line", "problem", "line", "problem"))


@case("S5_ingest_report", """
    select 'triple' as outcome, count(*) as n from customer
    union all select 'comment', count(*) from nation
    union all select 'no_final_dot', count(*) from supplier
    union all select 'not_a_triple', count(*) from region""")
def s5b(spark, sf):
    """Good lines from customers, comments from nations, broken lines from suppliers and regions."""
    path = fresh(spark, "ntmix")
    good = store.to_nt(literal_triples(mapping(spark, sf, ["Customer"], []), class_map(spark, sf, "Customer"), "segment"))
    lines = union_all([
        good, table(spark, sf, "nation").select(F.concat(F.lit("# "), "n_name").alias("value")),
        table(spark, sf, "supplier").select(F.concat(F.lit("<a> <b> <"), "s_name", F.lit(">")).alias("value")),
        table(spark, sf, "region").select(F.concat("r_name", F.lit(" is a region .")).alias("value"))])
    lines.write.text(path)
    return store.ingest_report(spark, path).select("outcome", "n")


@case("S6_write_ntriples", f"""
    select '<' || {i('document', 'doc_id')} || '> <{NS}text> "' ||
      replace(replace(replace(replace(replace(text, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(13), '\\r'), chr(9), '\\t')
      || '"^^<http://www.w3.org/2001/XMLSchema#string> .' as line from documents where text is not null
    union all select '<' || {i('document', 'doc_id')} || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{NS}Document> .'
      from documents
    union all select '<' || {i('page', 'page_id')} || '> <{NS}url> "' ||
      replace(replace(url, '\\', '\\\\'), '"', '\\"') || '"^^<http://www.w3.org/2001/XMLSchema#string> .' from pages where url is not null
    union all select '<' || {i('page', 'page_id')} || '> <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> <{NS}Page> .'
      from pages""")
def s6(spark, sf):
    path = fresh(spark, "ntout")
    store.write_ntriples(materialize(_texts(spark, sf)), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@case("S7_triple_store", f"""
    select p, count(*) as n, count(distinct s) as subjects from (
      select {t(i('order', 'o_orderkey'), n('placedBy'), i('customer', 'o_custkey'))} from orders
      where o_custkey in (select c_custkey from customer)
      union all select {t(i('customer', 'c_custkey'), n('segment'), 'c_mktsegment', 'string')} from customer) group by p""")
def s7(spark, sf):
    path = fresh(spark, "store")
    store.save_triples(materialize(mapping(spark, sf, ["Customer", "Order"], ["placedBy"])), path)
    return store.load_triples(spark, path).where(F.col("p").isin(NS + "placedBy", NS + "segment")).groupBy("p").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("subjects"))


def _version_sql(version: int, orders: str) -> str:
    """Number of triples and subjects per predicate where ``orders`` are the orders."""
    rows = [f"select {t(i('order', 'o_orderkey'), TYPE, n('Order'))} from {orders}", f"select {t(i('customer', 'c_custkey'), TYPE, n('Customer'))} from customer",
            f"select {t(i('order', 'o_orderkey'), n('placedBy'), i('customer', 'o_custkey'))} from {orders} where o_custkey in (select c_custkey from customer)"]
    for tab, path, key, props in ((orders, "order", "o_orderkey", ("status o_orderstatus", "total o_totalprice", "orderDate o_orderdate", "priority o_orderpriority")),
                                  ("customer", "customer", "c_custkey", ("customerName c_name", "segment c_mktsegment", "balance c_acctbal"))):
        rows += [f"select {t(i(path, key), n(p.split()[0]), f'cast({p.split()[1]} as varchar)', 'string')} from {tab} where {p.split()[1]} is not null" for p in props]
    return f"select {version} as version, p, count(*) as n, count(distinct s) as subjects from ({' union all '.join(rows)}) group by p"


@case("S7_versioned_store", f"""
    select v.*, p in ({n('customerName')}, {n('segment')}, {n('balance')}) or version = 1 as as_first_written from (
      {_version_sql(1, 'orders')} union all {_version_sql(2, "(select * from orders where o_orderstatus <> 'O')")}) v""")
def s7b(spark, sf):
    """All predicates of a store before and after open orders went, and whether their files are still those of the first version."""
    kept = TripleStore(spark, fresh(spark, "versions"))
    kept.refresh(materialize(mapping(spark, sf, ["Customer", "Order"], ["placedBy"])))
    closed = class_map(spark, sf, "Order", table(spark, sf, "orders").where("o_orderstatus <> 'O'"))
    kept.refresh(materialize(mapping(spark, sf, ["Customer", "Order"], ["placedBy"]).with_classes(Order=closed)))
    first = kept.manifest(1).select("write").first()[0]
    out = []
    for v in kept.versions():
        found = kept.load(v).groupBy("p").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("s").alias("subjects"))
        same = kept.manifest(v).groupBy("p").agg(F.min(F.col("write") == first).alias("as_first_written"))
        out.append(found.join(same, "p").select(F.lit(v).alias("version"), "p", "n", "subjects", "as_first_written"))
    return union_all(out)


@case("S8_data_binding", f"""
    select {t(i('client', 'c_custkey'), n('name'), 'c_name', 'string')} from customer where c_name is not null
    union all select {t(i('client', 'c_custkey'), n('market'), 'c_mktsegment', 'string')} from customer where c_mktsegment is not null
    union all select {t(i('client', 'c_custkey'), 'x', n('Client')).replace("x as p", "'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' as p")} from customer""")
def s8(spark, sf):
    bound = src.bind(table(spark, sf, "customer"), {"clientId": "c_custkey", "name": "c_name", "market": "c_mktsegment"})
    cm = ClassMap("Client", bound, ["clientId"], props={p: (p, "string") for p in ("name", "market")}, unique=True)
    return materialize(Mapping(NS, [cm]))


@case("S9_compile_mapping", """
    select 'map-turn' as mapping, count(*) * 1 + count(role) as n_triples, 2 as skipped from conversations
    union all select 'map-customer', count(*) + count(c_name) + count(c_mktsegment) + count(c_acctbal), 2 from customer
    union all select 'map-order', count(*) + count(o_orderstatus) + count(o_totalprice) + count(o_orderdate) + count(o_orderpriority), 2 from orders
    union all select 'map-placedby', count(*), 2 from orders join customer on o_custkey = c_custkey""")
def s9(spark, sf):
    """An edge to a class with a two-column key, given one column, and one to an unmapped class are left out."""
    base = mapping(spark, sf, ["Customer", "Order", "Turn"], ["placedBy"])
    bad = [EdgeMap("saidIn", "Order", "Turn", "domain_fk", ["o_orderkey"]),
           EdgeMap("of", "Order", "Nobody", "domain_fk", ["o_custkey"])]
    m = Mapping(NS, base.classes, base.edges + bad)
    return mapping_stats(m).withColumn("skipped", F.lit(len(m.warnings)))


def _result(spark, sf):
    g = Graph.virtual(mapping(spark, sf, ["Customer", "Order"], ["placedBy"]))
    return g.match(("?o", "placedBy", "?c"), ("?c", "segment", "?seg"), ("?o", "priority", "?pr"))


_RESULT_SQL = """select c_mktsegment as seg, o_orderpriority as pr, count(*) as n
    from orders join customer on o_custkey = c_custkey group by 1, 2"""


@case("S10_csv_sink", _RESULT_SQL)
def s10(spark, sf):
    path = fresh(spark, "csv")
    src.to_csv(_result(spark, sf), path)
    return spark.read.option("header", True).csv(path).groupBy("seg", "pr").agg(F.count(F.lit(1)).alias("n"))


@case("S10_json_sink", _RESULT_SQL)
def s10b(spark, sf):
    path = fresh(spark, "json")
    src.to_json(_result(spark, sf), path)
    return spark.read.schema("o string, c string, seg string, pr string").json(path).groupBy("seg", "pr").agg(
        F.count(F.lit(1)).alias("n"))


@case("S11_cap_rows", f"""select {i('order', 'o_orderkey')} as o, {i('customer', 'o_custkey')} as c, true as truncated
    from orders join customer on o_custkey = c_custkey order by 1, 2 limit 1000""")
def s11(spark, sf):
    g = Graph.virtual(mapping(spark, sf, ["Customer", "Order"], ["placedBy"]))
    rows, more = src.cap_rows(g.match(("?o", "placedBy", "?c")), 1000, ["o"])
    return rows.withColumn("truncated", F.lit(more))


@case("S12_preview", f"""
    with tri as (select {i('customer', 'c_custkey')} as s, {n('segment')} as p, c_mktsegment as o from customer
      union all select {i('customer', 'c_custkey')}, {n('customerName')}, c_name from customer
      union all select {i('customer', 'c_custkey')}, {n('balance')}, {money('c_acctbal')} from customer
      union all select {i('customer', 'c_custkey')}, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', {n('Customer')} from customer),
    page as (select * from tri where contains(lower(s || ' ' || p || ' ' || o), 'machinery') order by s, p, o limit 51 offset 25)
    select s, p, o, (select count(*) > 50 from page) as has_more from (select * from page order by s, p, o limit 50)""")
def s12(spark, sf):
    return src.preview(materialize(mapping(spark, sf, ["Customer"], [])), "MACHINERY", limit=50, offset=25)


@case("S13_direct_map", f"""
    select {t(i('nation', 'n_nationkey'), n('n_name'), 'n_name', 'string')} from nation
    union all select {t(i('nation', 'n_nationkey'), n('n_regionkey'), 'cast(n_regionkey as varchar)', 'integer')} from nation
    union all select {i('nation', 'n_nationkey')}, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', {n('nation')}, 'iri', cast(null as varchar) from nation
    union all select {i('labels', 'doc_id')}, {n('quality')}, cast(quality as varchar), 'lit', 'integer' from labels where quality is not null
    union all select {i('labels', 'doc_id')}, {n('toxic')}, cast(toxic as varchar), 'lit', 'integer' from labels where toxic is not null
    union all select {i('labels', 'doc_id')}, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type', {n('labels')}, 'iri', cast(null as varchar) from labels""")
def s13(spark, sf):
    return materialize(Mapping(NS, [direct_map(table(spark, sf, "nation"), "nation", ["n_nationkey"], unique=True),
                                    direct_map(table(spark, sf, "labels"), "labels", ["doc_id"], unique=True)]))


@case("S13_direct_class", f"""select s, p, o, o_kind, o_type from (select {t(i('page', 'page_id'), 'x', n('page'))} from pages)""".replace(
    "x as p", "'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' as p"))
def s13b(spark, sf):
    cm = direct_map(table(spark, sf, "pages"), "page", ["page_id"], unique=True)
    return class_triples(Mapping(NS, [cm]), cm)
