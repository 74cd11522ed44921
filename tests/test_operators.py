"""Operators on small frames with known answers."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tripleframe import ClassMap, EdgeMap, Graph, Mapping, Tbox, iri, lexical, local_name, mapping_stats, materialize, namespace, value
from tripleframe.functions import nt_escape, nt_unescape
from tripleframe.functions.terms import RDF_TYPE
from tripleframe.operators import audit, paths, reason, schema
from tripleframe.sources import ontology, tables, triples as store

NS = "http://t.example/"


def col(df):
    return sorted(tuple(r) for r in df.collect())


# ------------------------------------------------------------ terms

def test_iri_encoding_matches_percent_encoding(spark):
    from urllib.parse import quote
    keys = ["a b", "a/b", "50%", "é", "a+b", "*", "~", "(", "日本", "-_.", "", "#?&="]
    df = spark.createDataFrame([(k,) for k in keys], "k string").select("k", iri(NS, [F.col("k")]).alias("i"))
    assert {r.k: r.i for r in df.collect()} == {k: NS + quote(k, safe="") for k in keys}


def test_null_key_gives_null(spark):
    df = spark.createDataFrame([("a", None), ("a", "b")], "x string, y string")
    assert [r[0] for r in df.select(iri(NS, [F.col("x"), F.col("y")])).collect()] == [None, NS + "a-b"]


def test_lexical_and_value_round_trip(spark):
    df = spark.sql("""select timestamp_ntz'2024-01-02 03:04:05.1' as ts, date'2024-01-02' as d, 1234567890.5D as x, 0.00001D as tiny,
                      true as b, cast(12.30 as decimal(10,2)) as m, 100.0D as whole""")
    dt = {f.name: f.dataType for f in df.schema.fields}
    got = df.select(lexical(F.col("ts"), "dateTime", dt["ts"]), lexical(F.col("ts"), "datetime", dt["ts"]), lexical(F.col("ts"), "date", dt["ts"]),
                    lexical(F.col("ts"), "time", dt["ts"]), lexical(F.col("d"), "date"), lexical(F.col("x"), "decimal", dt["x"]),
                    lexical(F.col("tiny"), "decimal", dt["tiny"]), lexical(F.col("b"), "boolean"), lexical(F.col("m"), "decimal", dt["m"]),
                    lexical(F.col("whole"), "decimal", dt["whole"])).first()
    assert tuple(got) == ("2024-01-02T03:04:05.1", "2024-01-02T03:04:05.1", "2024-01-02", "03:04:05", "2024-01-02", "1234567890.5",
                          "0.00001", "true", "12.30", "100")
    texts = spark.createDataFrame([("12", "x", "2024-01-02T03:04:05.1")], "a string, b string, c string")
    r = texts.select(value("a", "integer"), value("b", "integer"), value("c", "dateTime")).first()
    assert r[0] == 12 and r[1] is None and r[2].microsecond == 100000
    with pytest.raises(ValueError):
        value("a", "duration")


def test_names(spark):
    df = spark.createDataFrame([("http://a/b#c",), ("http://a/b/c",), ("http://a/b#c/d",)], "i string")
    assert col(df.select(local_name("i"), namespace("i"))) == [("c", "http://a/b#"), ("c", "http://a/b/"), ("c/d", "http://a/b#")]


# ------------------------------------------------------------ N-Triples

def test_nt_escapes(spark):
    texts = ['plain', 'q"q', 'a\\nb', 'line\nline', 'tab\t', '\\', '\\\\n', 'cr\r', 'mix\\"\n\\t', '', '\\u0041']
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert all(r[0] == r[1] for r in df.select("t", nt_unescape(nt_escape(F.col("t")))).collect())
    one = spark.createDataFrame([("caf\\u00E9 \\U0001F600 \\\\u0041",)], "t string").select(nt_unescape(F.col("t"))).first()[0]
    assert one == "café 😀 \\u0041"


def test_runs_of_codes_are_decoded_at_once(spark):
    """A pair of surrogates used to abort; runs of both lengths, next to escapes and to each other."""
    cases = {"\\uD83D\\uDE00": "😀", "\\U0001F600\\u0041\\u00E9y\\\\u0041\\n\\u005Cn": "😀Aéy\\u0041\n\\n", "\\\\\\u0041\\\\": "\\A\\", "\\u004": "\\u004", "": ""}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    assert all(r[0] == r[1] for r in df.select(nt_unescape(F.col("t")), "want").collect())
    long = spark.range(1).select(nt_unescape(F.repeat(F.lit("\\u0061"), 200_000)).alias("t")).select(F.length("t"), F.md5("t"), F.md5(F.repeat(F.lit("a"), 200_000))).first()
    assert long[0] == 200_000 and long[1] == long[2]


def test_nt_round_trip_and_rejects(spark, tmp_path):
    lines = ['<http://a> <http://p> "say \\"hi\\"\\n" .', '_:b1 <http://p> <http://o> .', '# a comment', '',
             '<http://a> <http://p> "no dot"', '<http://a> <http://p> "5"^^<http://www.w3.org/2001/XMLSchema#integer> .',
             '<http://a> <http://p> "hallo"@de .', 'nonsense .', '<http://a> <http://p> "x"^^<http://own#type>.']
    (tmp_path / "in.nt").write_bytes("\n".join(lines).encode() + b"\n<http://a> <http://p> \"\xff\xfe\" .\n")
    good, bad = store.read_ntriples(spark, str(tmp_path / "in.nt"))
    assert Counter(r.problem for r in bad.collect()) == {"no_final_dot": 1, "not_a_triple": 1, "not_utf8": 1}
    got = {tuple(r) for r in good.collect()}
    assert ("http://a", "http://p", 'say "hi"\n', "lit", "string") in got
    assert ("_:b1", "http://p", "http://o", "iri", None) in got
    assert ("http://a", "http://p", "5", "lit", "integer") in got
    assert ("http://a", "http://p", "hallo", "lit", "@de") in got
    assert ("http://a", "http://p", "x", "lit", "http://own#type") in got
    store.write_ntriples(good, str(tmp_path / "out"))
    again, none = store.read_ntriples(spark, str(tmp_path / "out"))
    assert {tuple(r) for r in again.collect()} == got and none.isEmpty()
    report = {r.outcome: (r.n, r.samples) for r in store.ingest_report(spark, str(tmp_path / "in.nt")).collect()}
    assert report["comment"][0] == 1 and report["triple"][0] == 5 and len(report["no_final_dot"][1]) == 1


def test_long_literals_do_not_overflow(spark, tmp_path):
    text = 'a "quoted" word\n' * 20000
    df = spark.createDataFrame([("http://s", "http://p", text, "lit", "string")], "s string, p string, o string, o_kind string, o_type string")
    store.write_ntriples(df, str(tmp_path / "long"))
    good, bad = store.read_ntriples(spark, str(tmp_path / "long"))
    assert good.first().o == text and bad.isEmpty()


def test_store_prunes_by_predicate(spark, tmp_path):
    df = spark.range(100).select(F.concat(F.lit("s"), F.col("id")).alias("s"), F.concat(F.lit("http://p/"), F.col("id") % 3).alias("p"),
                                 F.lit("o").alias("o"), F.lit("lit").alias("o_kind"), F.lit("string").alias("o_type"))
    path = str(tmp_path / "store")
    assert store.refresh_triples(df, path, "v1") and not store.refresh_triples(df, path, "v1") and store.refresh_triples(df, path, "v2")
    back = store.load_triples(spark, path)
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in df.collect()}
    plan = back.where("p = 'http://p/1'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(p" in plan
    store.clear_triples(spark, path)
    assert store.load_triples(spark, path).isEmpty()


# ------------------------------------------------------------ hierarchies

CYCLE = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")]


def by_hand(edges):
    up = {}
    for c, p in edges:
        up.setdefault(c, set()).add(p)
    out = set()
    for start in up:
        seen, todo = set(), list(up[start])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += up.get(x, ())
        out |= {(start, x) for x in seen}
    return out


@pytest.mark.parametrize("edges", [CYCLE, [], [(f"n{i}", f"n{i + 1}") for i in range(13)],
                                   [(str(a), str(b)) for a, b in zip(random.Random(1).choices(range(12), k=20), random.Random(2).choices(range(12), k=20))]])
def test_closure(spark, edges):
    df = spark.createDataFrame(edges, "child string, parent string")
    got = [tuple(r) for r in reason.closure(df).collect()]
    assert len(got) == len(set(got)) and set(got) == by_hand(edges)
    assert {r[0] for r in reason.find_cycles(df).collect()} == {c for c, p in by_hand(edges) if c == p}


@pytest.mark.parametrize("turned", [False, True])
def test_cycles_of_one_parent_each_need_no_closure(spark, monkeypatch, turned):
    """A long tail into a cycle, a cycle of its own, a self-loop, a chain that ends: as many rows as edges, however long the tails."""
    monkeypatch.setattr(reason, "closure", lambda *_: pytest.fail("the closure of a tail is quadratic"))
    steps = [(i, i + 1) for i in range(40)] + [(40, 35)] + [(100 + i, 100 + (i + 1) % 3) for i in range(3)] + [(200, 200)] + [(i, i + 1) for i in range(300, 307)]
    df = spark.createDataFrame([(b, a) if turned else (a, b) for a, b in steps] + [(None, 1), (1, None)], "child int, parent int")
    want = {*range(35, 41), 100, 101, 102, 200}
    assert sorted(r[0] for r in reason.find_cycles(df).collect()) == sorted(want)


def test_disjoint_lists(spark):
    lists = spark.createDataFrame([(1, "a"), (1, "b"), (1, "c"), (2, "c"), (2, "d")], "list_id int, cls string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "d"), ("d", "c"), ("a", "a")], "a string, b string")
    assert col(reason.disjoint_pairs(pairs, lists)) == [("a", "b"), ("c", "d")]
    types = spark.createDataFrame([("x", "a"), ("x", "b"), ("y", "a"), ("y", "d"), ("z", "c"), ("z", "d")], "s string, cls string")
    assert [(r.list_id, r.s, r.n_classes) for r in reason.disjoint_violations(types, lists).orderBy("list_id").collect()] == [(1, "x", 2), (2, "z", 2)]


# ------------------------------------------------------------ paths

def edge_frame(spark, text):
    rows = [(a, "r", b) for a, b in (e.split("-") for e in text.split())]
    return spark.createDataFrame(rows, "s string, p string, o string")


def ladder(n, rungs):
    """Two rails of ``n`` steps; a rung leads over at every place in ``rungs``."""
    rails = [f"{r}{i}-{r}{i + 1}" for r in "LR" for i in range(n)]
    return " ".join(rails + [f"L{i}-R{i}" for i in rungs])


def lattice(n):
    return " ".join(f"{x}.{y}-{x + dx}.{y + dy}" for x in range(n) for y in range(n) for dx, dy in ((1, 0), (0, 1), (1, 1)) if x + dx < n and y + dy < n)


def all_shortest(text, a, b):
    """Every shortest directed path, by trying walks of growing length."""
    step = {}
    for e in text.split():
        s, o = e.split("-")
        step.setdefault(s, set()).add(o)
    walks = [[a]]
    while walks and a != b:
        walks = [w + [o] for w in walks for o in step.get(w[-1], ()) if o not in w]
        if done := [w for w in walks if w[-1] == b]:
            return done
    return []


@pytest.mark.parametrize("edges,a,b", [
    (ladder(6, [4]), "L0", "R6"), (ladder(6, [4]), "R0", "L3"), (ladder(5, [1, 3]), "L1", "R4"), (lattice(4), "0.0", "3.2"), (lattice(3), "2.2", "0.0"),
    (lattice(3), "1.1", "1.1"), (ladder(3, []), "L0", "R3"), ("loop-loop loop-out", "loop", "out"), (ladder(12, [0, 12]) + " L0-shortcut shortcut-R11", "L0", "R12")])
def test_shortest_path(spark, edges, a, b):
    rows, want = paths.shortest_path(edge_frame(spark, edges), a, b).collect(), all_shortest(edges, a, b)
    assert [list(r.nodes) for r in rows] == ([min(want)] if want else [])
    assert all(r.hops == len(r.nodes) - 1 == len(r.preds) for r in rows)


def simple_paths(edges, h):
    step = {}
    for s, p, o in edges:
        if s != o:
            step.setdefault(s, set()).add((p, o, ""))
            step.setdefault(o, set()).add((p, s, "^"))
    out, todo = set(), [((n,), "{" + n + "}") for n in step]
    while todo:
        nodes, text = todo.pop()
        if len(nodes) > 1:
            out.add((len(nodes) - 1, text))
        if len(nodes) <= h:
            todo += [(nodes + (o,), f"{text} ->{m}{p}-> {{{o}}}") for p, o, m in step[nodes[-1]] if o not in nodes]
    return sorted(out)


def test_path_library(spark):
    edges = [("Order", "by", "Customer"), ("Order", "has", "Part"), ("Part", "from", "Supplier"), ("Supplier", "in", "Nation"),
             ("Customer", "in", "Nation"), ("Part", "like", "Part"), ("Order", "by", "Customer")]
    df = spark.createDataFrame(edges, "s string, p string, o string")
    want = simple_paths(edges, 4)
    assert sorted((r.hops, r.pattern) for r in paths.path_library(df, 4).collect()) == want
    assert {r.truncated for r in paths.path_library(df, 4, 15).collect()} == {True} and {r.truncated for r in paths.path_library(df, 4, len(want)).collect()} == {False}
    assert [(r.hops, r.pattern) for r in paths.path_library(df, 4, 15).collect()] == want[:15]
    seeds = spark.createDataFrame([("Nation",)], "n string")
    assert col(paths.path_library(df, 2, None, seeds).select("hops", "pattern")) == [w for w in simple_paths(edges, 2) if w[1].startswith("{Nation}")]
    assert len(paths.path_library(df, 9).collect()) == len(simple_paths(edges, 9))
    with pytest.raises(ValueError):
        paths.path_library(df, 0)


def test_filter_rules(spark):
    df = spark.createDataFrame([(["A", "B"], ["p"]), (["B", "C"], ["q"]), (["C", "D"], ["r"])], "nodes array<string>, preds array<string>")
    pick = lambda c, p, up=None: [r.preds[0] for r in paths.filter_paths(df, c, p, up).orderBy("preds").collect()]
    assert pick(["A", "B"], ["p"]) == ["p"]              # both
    assert pick(["A", "B"], ["q"]) == ["p", "q"]         # either
    assert pick(["A", "D"], ["x", "q"]) == ["p", "q", "r"]  # any overlap
    assert pick(["X"], []) == ["p", "q", "r"]            # nothing fits: all
    assert pick([], []) == ["p", "q", "r"]
    up = spark.createDataFrame([("C", "D")], "child string, parent string")
    assert pick(["C"], [], up) == ["r"]
    assert col(paths.paths_using(df, ["q"]).select(F.element_at("preds", 1))) == [("q",)]


def test_link_terms(spark):
    vocab = spark.createDataFrame([("workorder", "Work order"), ("asset", "Asset"), ("assetType", "Asset type"), ("plain", None)], "name string, label string")
    terms = spark.createDataFrame([(t,) for t in ("WORKORDER", "Work Order", "work", "ass", "x", " ", "my plain thing", "Plain")], "t string")
    got = {r.term: (r.name, r.rule) for r in schema.link_terms(terms, vocab).collect()}
    assert got == {"WORKORDER": ("workorder", "name"), "Work Order": ("workorder", "label"), "work": ("workorder", "part"), "ass": (None, "unlinked"),
                   "x": (None, "unlinked"), "my plain thing": ("plain", "part"), "Plain": ("plain", "name")}


# ------------------------------------------------------------ audits

def test_hot_keys_and_repeats(spark):
    """One key holds most rows and its parent is there twice; counts are those of a row-by-row join."""
    child = spark.range(3000).select("id", F.when(F.col("id") < 2000, 7).when(F.col("id") < 2500, F.col("id")).alias("fk"))
    parent = spark.createDataFrame([(7,), (7,), (2001,), (None,)], "pk long")
    m = Mapping(NS, [ClassMap("C", child, ["id"], unique=True), ClassMap("P", parent, ["pk"])], [EdgeMap("of", "C", "P", "domain_fk", ["fk"])])
    r = audit.fk_hit_rates(m).first()
    assert (r.total, r.hit, r.verdict) == (4000 + 500, 4001, "warn")
    r = audit.reconcile_edges(m).first()
    assert (r.total, r.kept, r.null_key, r.dangling) == (4000 + 500 + 500, 4001, 500, 499)
    over = {x.s: x.rows for x in audit.iri_overlap(m).collect()}
    assert over == {f"{NS}p/7": 2}


def test_profile_top_values(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(["b", "b", "a", "a", "c", "", " ", "\t", None, "d"])], "id long, v string")
    m = Mapping(NS, [ClassMap("C", df, ["id"], props={"v": ("v", "string")}, unique=True)])
    r = audit.profile_literals(m).first()
    assert (r.rows, r["null"], r.blank, r.top) == (10, 1, 3, "a x2; b x2; c x1")


def test_expect(spark):
    actual = spark.createDataFrame([("a", 3), ("b", 4)], "name string, n long")
    assert {r.name: r.verdict for r in audit.expect(actual, [("a", 3), ("b", 5), ("c", 0)]).collect()} == {"a": "PASS", "b": "FAIL", "c": "PASS"}


def test_candidate_key_names(spark):
    df = spark.createDataFrame([(1, "x", "v", 1.0)], "deptCode int, id string, valid string, No double")
    assert {r["column"]: r.name_says_key for r in audit.candidate_keys(df).collect()} == {"deptCode": True, "id": True, "valid": False, "No": False}


def test_label_coverage(spark):
    df = spark.createDataFrame([("e1", "Über"), ("e1", "x"), ("e2", None), ("e3", "plain"), ("e4", "ä")], "entity string, label string")
    assert tuple(audit.label_coverage(df, "[äÜ]").first()) == (4, 2, True)


# ------------------------------------------------------------ sources

ONTOLOGY = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns:rdfs="http://www.w3.org/2000/01/rdf-schema#" xmlns:owl="http://www.w3.org/2002/07/owl#">
  <owl:Class rdf:about="http://t.example/Customer"><rdfs:label xml:lang="en">Customer</rdfs:label><rdfs:comment>Buys</rdfs:comment>
    <rdfs:subClassOf rdf:resource="http://t.example/Party"/>
    <rdfs:subClassOf><owl:Restriction><owl:onProperty rdf:resource="http://t.example/x"/></owl:Restriction></rdfs:subClassOf></owl:Class>
  <owl:Class rdf:about="http://t.example/Party"><owl:disjointWith rdf:resource="http://t.example/Order"/></owl:Class>
  <owl:Class rdf:about="http://t.example/Order"/>
  <owl:ObjectProperty rdf:about="http://t.example/places"><rdfs:domain rdf:resource="http://t.example/Customer"/>
    <rdfs:range rdf:resource="http://t.example/Order"/><owl:inverseOf rdf:resource="http://t.example/placedBy"/></owl:ObjectProperty>
  <owl:DatatypeProperty rdf:about="http://t.example/total"><rdfs:label>Total</rdfs:label><rdfs:domain rdf:resource="http://t.example/Order"/>
    <rdfs:range rdf:resource="http://www.w3.org/2001/XMLSchema#decimal"/></owl:DatatypeProperty>
</rdf:RDF>
"""


def test_read_ontology(spark, tmp_path):
    for name in ("one.rdf", "two.rdf"):
        (tmp_path / name).write_text(ONTOLOGY)
    got = ontology.read_ontology(spark, str(tmp_path / "*.rdf"))
    assert got.entities.count() == 10 and {r.file for r in got.entities.collect()} == {"one.rdf", "two.rdf"}
    box = got.tbox()
    assert col(box.sub_class) == [(NS + "Customer", NS + "Party")]
    assert col(box.domain) == [(NS + "places", NS + "Customer"), (NS + "total", NS + "Order")]
    assert col(box.inverse) == [(NS + "places", NS + "placedBy")] and col(box.disjoint) == [(NS + "Party", NS + "Order")]
    assert dict(map(tuple, box.classes.collect()))[NS + "Customer"] == "Customer"
    triples = spark.createDataFrame([(NS + "c1", NS + "places", NS + "o1", "iri", None), (NS + "o1", NS + "total", "5", "lit", "decimal")],
                                    "s string, p string, o string, o_kind string, o_type string")
    assert {(r.s, local) for r in reason.widen(triples, box).where(F.col("p").endswith("type")).collect() for local in [r.o.rsplit("/", 1)[1]]} == {
        (NS + "c1", "Customer"), (NS + "o1", "Order")}


def test_rows_and_preview(spark):
    df = spark.range(10).toDF("k")
    rows, more = tables.cap_rows(df, 3, ["k"])
    assert col(rows) == [(0,), (1,), (2,)] and more
    assert tables.cap_rows(df, 10)[1] is False
    t = df.select(F.concat(F.lit("S"), F.col("k").cast("string")).alias("s"), F.lit("p").alias("p"), F.lit("o").alias("o"))
    page = tables.preview(t, "s", 4, 8)
    assert [r.s for r in page.collect()] == ["S8", "S9"] and not page.first().has_more
    assert tables.preview(t, "S", 4, 0).first().has_more
    many = spark.range(1200).select(F.format_string("S%05d", "id").alias("s"), F.lit("p").alias("p"), F.lit("o").alias("o"))
    assert tables.preview(many, limit=1000).count() == 1000 and tables.preview(many, limit=1200).where("has_more").isEmpty()
    for bad in ({"limit": 0}, {"offset": -1}):
        with pytest.raises(ValueError):
            tables.preview(many, **bad)


def test_tbox_diff(spark):
    a = Tbox.of(spark, NS, classes=[("A", None), ("B", None)], properties=[("p", "object", None), ("q", "object", None)], domain=[("p", "A")], range=[("p", "B")])
    b = Tbox.of(spark, NS, classes=[("A", None), ("C", None)], properties=[("p", "object", None)], domain=[("p", "C")], range=[("p", "B")])
    assert sorted((r.change, r.name.rsplit("/")[-1]) for r in audit.tbox_diff(a, b).collect()) == [
        ("added", "C"), ("changed", "p"), ("removed", "B"), ("removed", "q")]


def test_stream_takes_only_new_files(spark, tmp_path):
    from tripleframe.streaming import stream_triples
    src, out, ckpt = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    schema_ = "id long, v string, at timestamp"
    part = lambda lo, hi: spark.range(lo, hi).selectExpr("id", "concat('v', id) as v", "timestamp'2024-01-01 00:00:00' + make_interval(0,0,0,0,0,id) as at")
    run = lambda: stream_triples(live, m, ClassMap("E", live, ["id"], props={"v": ("v", "string")}), out, ckpt).awaitTermination()
    part(0, 10).coalesce(1).write.mode("append").parquet(src)
    live = spark.readStream.schema(schema_).parquet(src)
    m = Mapping(NS, [ClassMap("E", part(0, 1), ["id"])])
    run()
    part(5, 15).withColumn("at", F.expr("at - interval 5 days")).coalesce(1).write.mode("append").parquet(src)  # five of them again
    run()
    run()
    got = store.load_triples(spark, out)
    assert got.count() == 30 and got.distinct().count() == 30


def test_construct_and_describe(spark):
    t = spark.createDataFrame([("s1", "p", "o1", "iri", None), ("s1", "v", "5", "lit", "integer"), ("o1", "v", "6", "lit", "integer")],
                              "s string, p string, o string, o_kind string, o_type string")
    g = Graph.materialized(t)
    assert col(g.construct([("?o", "back", "?s"), ("?v", "wrong", "?s"), ("?s", "val", "?v")], ("?s", "p", "?o"), ("?s", "v", "?v"))) == [
        ("o1", "back", "s1", "iri", None), ("s1", "val", "5", "lit", "integer")]
    assert g.describe("s1").count() == 2 and g.ask(("?x", "v", "?y")).first()[0] and not g.ask(("?x", "none", "?y")).first()[0]


def test_dirty_values_are_left_out_alike(spark):
    """Values that do not fit their declared type give no triple, end no job, and read the same on both routes."""
    rows = spark.createDataFrame([(1, "2024-01-02", "3.7", "12.5", 3.7, "2024-01-02 03:04:05"), (2, "soon", "12", "much", 4.0, "later"), (3, None, "x", None, None, None)],
                                 "k int, d string, i string, m string, f double, t string")
    kinds = {"d": "date", "i": "integer", "m": "decimal(18,2)", "f": "integer", "t": "dateTime"}
    m = Mapping(NS, [ClassMap("Row", rows, ["k"], props={c: (c, x) for c, x in kinds.items()}, unique=True)])
    virtual, stored = Graph.virtual(m), Graph.materialized(materialize(m), NS)
    for c, x in kinds.items():
        a, b = (col(g.match(("?r", c, "?v"), typed={"v": x}).where("v is not null")) for g in (virtual, stored))
        assert a == b
    assert col(virtual.match(("?r", "d", "?v"))) == [(NS + "row/1", "2024-01-02")] and col(stored.match(("?r", "m", "?v"))) == [(NS + "row/1", "12.50")]


def test_decimals_are_not_rounded(spark):
    from tripleframe.functions import terms
    df = spark.createDataFrame([(1e-11,), (1e29,), (0.1,), (-2.5e15,), (float("nan"),), (1e300,)], "x double")
    got = [r[0] for r in df.select(terms.lexical(F.col("x"), "decimal", df.schema["x"].dataType)).collect()]
    assert got == ["0.00000000001", "1" + "0" * 29, "0.1", "-2500000000000000", None, None]


def test_samples_by_value(spark):
    t = spark.createDataFrame([("a", "n", "100", "lit", "decimal"), ("b", "n", "9.5", "lit", "decimal"), ("c", "n", "none", "lit", "decimal"), ("d", "n", "b", "lit", "string"), ("d", "n", "a", "lit", "string")],
                              "s string, p string, o string, o_kind string, o_type string")
    assert col(schema.sample_values(t, ["n"])) == [("n", "9.5", "decimal"), ("n", "a", "string")]


def test_star_gives_what_match_gives(spark):
    rows = [("x", RDF_TYPE, NS + "C", "iri", None), ("x", NS + "p", "a", "lit", "string"), ("x", NS + "p", "b", "lit", "string"), ("x", NS + "q", "1", "lit", "string"),
            ("y", RDF_TYPE, NS + "C", "iri", None), ("y", NS + "p", "c", "lit", "string"), ("z", NS + "p", "d", "lit", "string"), ("z", NS + "q", "e", "lit", "string")]
    g = Graph.materialized(spark.createDataFrame(rows, "s string, p string, o string, o_kind string, o_type string"), NS)
    assert col(g.star("C", {"p": "p", "q": "q"})) == col(g.match(("?x", "a", "C"), ("?x", "p", "?p"), ("?x", "q", "?q")).select("x", "p", "q")) == [("x", "a", "1"), ("x", "b", "1")]


def test_long_chains_need_no_limit(spark):
    e = spark.createDataFrame([(f"n{i}", NS + "e", f"n{i + 1}", "iri", None) for i in range(10)], "s string, p string, o string, o_kind string, o_type string")
    chain = [(f"?v{i}", "e", f"?v{i + 1}") for i in range(9)]
    assert Graph.materialized(e, NS).match(*chain).count() == 2
    with pytest.raises(ValueError):
        Graph.materialized(e, NS).match(*chain, max_hops=4)


def test_edges_of_late_parents(spark, tmp_path):
    from tripleframe.streaming import complete_edges, missing_edges, stream_triples
    src, out, ckpt, extra = (str(tmp_path / x) for x in ("src", "out", "ckpt", "extra"))
    spark.range(4).selectExpr("id", "id as parent").write.parquet(src)
    live = spark.readStream.schema("id long, parent long").parquet(src)

    def mapping_of(n, kids):
        return Mapping(NS, [ClassMap("Kid", kids, ["id"], unique=True), ClassMap("Parent", spark.range(n), ["id"], unique=True)], [EdgeMap("of", "Kid", "Parent", "domain_fk", ["parent"])], strict=True)
    kids = spark.read.parquet(src)
    stream_triples(live, mapping_of(2, kids), ClassMap("Kid", live, ["id"], unique=True), out, ckpt, edges=("of",)).awaitTermination()
    assert store.load_triples(spark, out).where(F.col("p") == NS + "of").count() == 2
    complete_edges(mapping_of(4, kids), out, extra, ("of",))
    assert store.load_triples(spark, extra).count() == 2
    assert missing_edges(mapping_of(2, kids), out, ("of",)).isEmpty()


def test_lines_follow_the_public_grammar(spark):
    lines = ["<http://s> <http://p> <http://o> .", "_:b1 <http://p> \"x\"@en-GB .", "<http://s><http://p>\"x\".", "<http://a b> <http://p> <http://o> .", '<http://a"b> <http://p> <http://o> .',
             "<http://s> <http://p q> <http://o> .", "_:b! <http://p> <http://o> .", "<http://s> _:p <http://o> .", "<http://s\\u00e9> <http://p> _:b.1 ."]
    got = store.parse_nt(spark.createDataFrame([(x,) for x in lines], "value string")).collect()
    assert [r.problem is None for r in got] == [True, True, True, False, False, False, False, False, True]


def test_literals_follow_the_public_grammar(spark):
    head = "<http://s> <http://p> "
    good = {r'"x" . # note': ("x", "string"), r'"a\tb\bc\nd\re\ff\"g\'h\\i" .': ("a\tb\bc\nd\re\ff\"g'h\\i", "string"), '"raw \x01 # . > mark"@de-CH-1996.#': ("raw \x01 # . > mark", "@de-CH-1996"),
            r'"\u00e9\U0001F600"^^<http://t/\u00e9>.': ("é😀", "http://t/é"), '"" .': ("", "string"), r'"\\u0041\\" .': ("\\u0041\\", "string"), '"5"^^<http://www.w3.org/2001/XMLSchema#integer>\t.': ("5", "integer")}
    bad = [r'"x\q" .', '"x"^^<not an iri> .', '"x"@-1 .', '"x"@1 .', '"x" "y" .', r'"x\" .', r'"\u00g0" .', '"x"^^http://t .', '"x" @en .', "'x' .", "<http://o> . <http://o> ."]
    rows = store.parse_nt(spark.createDataFrame([(head + x,) for x in [*good, *bad]] + [("\x01" + head + '"x" .',)], "value string")).collect()
    assert {r.line[len(head):].strip(): (r.o, r.o_type) for r in rows[:len(good)] if r.problem is None} == {k.strip(): v for k, v in good.items()}
    assert all(r.problem == "not_a_triple" for r in rows[len(good):])


def test_keys_of_different_types(spark):
    """Text keys over numbers find what is a number, and what is none dangles; nothing aborts."""
    kids = spark.createDataFrame([(1, "7", "7"), (2, " 8", "x"), (3, "n", None), (4, None, "9"), (5, "11", "8")], "id int, up string, other string")
    tops = spark.createDataFrame([(7,), (8,), (9,)], "id long")
    links = spark.createDataFrame([("1", 7), ("n", 8), ("3", 99)], "kid string, top int")
    m = Mapping(NS, [ClassMap("Kid", kids, ["id"], unique=True), ClassMap("Top", tops, ["id"], unique=True)],
                [EdgeMap("up", "Kid", "Top", "domain_fk", ["up"]), EdgeMap("down", "Top", "Kid", "range_fk", ["other"]), EdgeMap("tied", "Kid", "Top", "junction", ["kid"], ["top"], links)])
    stored = {tuple(r) for r in materialize(m, preds=["up", "down", "tied"]).select("s", "p", "o").collect()}
    kid, top = (lambda i: f"{NS}kid/{i}"), (lambda i: f"{NS}top/{i}")
    want = {(kid(1), NS + "up", top(7)), (kid(2), NS + "up", top(8)), (top(7), NS + "down", kid(1)), (top(9), NS + "down", kid(4)), (top(8), NS + "down", kid(5)), (kid(1), NS + "tied", top(7))}
    assert stored == want
    g = Graph.virtual(m)
    assert {(r.a, NS + p, r.b) for p in ("up", "down", "tied") for r in g.match(("?a", p, "?b")).collect()} == want
    assert {(r.a, r.b) for r in g.match(("?a", "up", "?t"), ("?b", "tied", "?t")).collect()} == {(kid(1), kid(1))}
    assert g.match(("?a", "up", top(8))).first().a == kid(2)
    rates = {r.edge: (r.total, r.hit) for r in audit.fk_hit_rates(m, side="both").collect()}
    assert rates == {"up": (4, 2), "down": (4, 3), "tied": (3, 2), "tied:domain": (3, 2)}
    edges = {r.edge: (r.kept, r.null_key, r.dangling) for r in audit.reconcile_edges(m).collect()}
    assert edges == {"up": (2, 1, 2), "down": (3, 1, 1), "tied": (1, 0, 2)}
    assert {r.mapping: r.n_triples for r in mapping_stats(m).collect()}["map-up"] == 2
