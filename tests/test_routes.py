"""Mapped tables, generated triples and a plain Python evaluation must agree on random small data."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from tripleframe import ClassMap, EdgeMap, Graph, Literal, Mapping, Tbox, materialize
from tripleframe.functions.terms import RDF_TYPE

NS = "http://t.example/"


def frames(spark, rnd, dirty):
    """A (composite text key), B (number key), L linking both; with NULLs, repeats and dangling keys."""
    pick = lambda *xs: rnd.choice(xs)
    null = lambda v: None if dirty and rnd.random() < 0.15 else v
    keys = [(x, y) for x in ("a", "a-b", "c d", "é/") for y in ("1", "b-1", "~")]
    rnd.shuffle(keys)
    a_rows = [(k[0], k[1], null(pick("red", "blue", "")), null(rnd.randint(0, 3)), null(rnd.randint(0, 5))) for k in keys[:6]]
    if dirty:
        a_rows += [(null(r[0]), r[1], pick("red", "blue"), null(rnd.randint(0, 3)), rnd.randint(0, 5)) for r in a_rows[:4]]
    b_rows = [(i, null(pick("x", "y")), null(round(rnd.uniform(0, 9), 1)), null(rnd.randint(0, 5))) for i in range(4)]
    if dirty:
        b_rows += [(b[0], pick("x", "y"), 1.5, null(rnd.randint(0, 5))) for b in b_rows[:2]]
    l_rows = [(*rnd.choice(keys), null(rnd.randint(0, 5))) for _ in range(12)]
    A = spark.createDataFrame(a_rows, "k1 string, k2 string, colour string, size int, b long")
    B = spark.createDataFrame(b_rows, "id int, tag string, price double, next long")
    L = spark.createDataFrame(l_rows, "k1 string, k2 string, b long")
    return tuple(d.coalesce(1).cache() for d in (A, B, L))


def build(spark, rnd, dirty, sep="-"):
    A, B, L = frames(spark, rnd, dirty)
    return Mapping(NS, [
        ClassMap("A", A, ["k1", "k2"], "thing", {"colour": ("colour", "string"), "size": ("size", "integer")}, sep, unique=not dirty),
        ClassMap("RedA", A.where("colour = 'red'"), ["k1", "k2"], "thing", {"colour": ("colour", "string")}, sep, unique=not dirty),
        ClassMap("B", B, ["id"], "b", {"tag": ("tag", "string"), "price": ("price", "decimal(18,2)")}, unique=not dirty,
                 consts={"in": "world"}),
    ], [EdgeMap("toB", "A", "B", "domain_fk", ["b"]), EdgeMap("next", "B", "B", "domain_fk", ["next"]),
        EdgeMap("ofA", "B", "A", "range_fk", ["b"]), EdgeMap("link", "A", "B", "junction", ["k1", "k2"], ["b"], L)], strict=True)


def box(spark):
    return Tbox.of(spark, NS, classes=[(c, None) for c in ("A", "RedA", "B", "Thing", "Top", "Tagged")],
                   properties=[], sub_class=[("RedA", "A"), ("A", "Thing"), ("B", "Thing"), ("Thing", "Top")],
                   sub_prop=[("toB", "linked"), ("link", "linked"), ("next", "linked")],
                   domain=[("tag", "Tagged"), ("toB", "A"), ("link", "RedA")], range=[("toB", "B"), ("link", "Tagged"), ("tag", "xsd:string")],
                   inverse=[("next", "previous")])


PATTERNS = [
    [("?x", "a", "A")], [("?x", "a", "Thing")], [("?x", "a", "Tagged"), ("?x", "tag", "?t")], [("?x", "a", "?c")],
    [("?x", "colour", "?v"), ("?x", "size", "?s")], [("?x", "colour", Literal("red")), ("?x", "size", "?s")],
    [("?x", "toB", "?b"), ("?b", "tag", "?t")], [("?x", "linked", "?b")], [("?x", "linked", "?b"), ("?b", "price", "?p")],
    [("?x", "toB", "?b"), ("?b", "next", "?c"), ("?c", "tag", "?t")], [("?x", ("toB", "^link"), "?y")],
    [("?b", "ofA", "?x"), ("?x", "colour", "?v")], [("?b", "next", "?b")], [("?x", "?p", "?v")], [("?x", "a", "RedA"), ("?x", "?p", "?v")],
    [("?x", "colour", "?v"), ("?y", "colour", "?v"), ("?x", "link", "?b"), ("?y", "toB", "?b")],
    [("?x", "size", "?n"), ("?y", "size", "?n")], [("?x", "link", f"{NS}b/1")], [(f"{NS}b/1", "?p", "?v")],
    [(f"{NS}thing/a-1", "?p", "?v")], [(f"{NS}thing/a-b-1", "?p", "?v")], [("?x", "?p", f"{NS}b/2")],
    [("?b", "in", "world"), ("?x", "toB", "?b")], [("?a", "toB", "?b"), ("?a", "a", "RedA"), ("?b", "a", "B")],
    [("?x", "?p", "?y"), ("?y", "a", "B")], [("?x", "?p", "?y"), ("?y", "?q", "?z")],
]


def evaluate(triples, patterns):
    """Bindings by trying every triple, one pattern after the other."""
    from tripleframe.plans.patterns import normalise
    full = lambda t: RDF_TYPE if t == "a" else t if "://" in t else NS + t
    rows = [{}]
    for p in normalise(patterns, full):
        new = []
        for r in rows:
            for s, pred, o in triples:
                b = dict(r)
                for want, got in ((p.s, s), (p.p, (pred, "iri", None)), (p.o, o)):
                    got = (got, "iri", None) if isinstance(got, str) else got
                    if isinstance(want, Literal):
                        if got != (want.text, "lit", want.xsd):
                            break
                    elif not want.startswith("?"):
                        if got != (want, "iri", None):
                            break
                    elif b.setdefault(want, got) != got:
                        break
                else:
                    new.append(b)
        rows = new
    names = list(dict.fromkeys(v for p in normalise(patterns, full) for v in p.variables() if not v.startswith("?__")))
    return sorted(tuple(r[v][0] for v in names) for r in rows)


def answers(g, patterns):
    return sorted(tuple(r) for r in g.match(*patterns).collect())


@pytest.mark.parametrize("seed,dirty,sep,with_box", [(2, True, "-", False), (4, False, "/", True)])
def test_three_ways(spark, seed, dirty, sep, with_box):
    m = build(spark, random.Random(seed), dirty, sep)
    tb = box(spark) if with_box else None
    triples = materialize(m, tb).coalesce(1).cache()
    rows = triples.collect()
    assert len(rows) == len(set(rows)), "the graph must be a set"
    plain = [(r.s, r.p, (r.o, r.o_kind, r.o_type)) for r in rows]
    virtual, stored = Graph.virtual(m, tb), Graph.materialized(triples, NS)
    for patterns in PATTERNS:
        if not with_box and any(n in str(patterns) for n in ("linked", "Thing", "Tagged")):
            continue
        want = evaluate(plain, patterns)
        assert answers(stored, patterns) == want, f"stored {patterns}"
        assert answers(virtual, patterns) == want, f"virtual {patterns}"


@pytest.mark.parametrize("seed,dirty,sep,with_box", [(6, True, "-", True)])
def test_counting_without_bindings(spark, seed, dirty, sep, with_box):
    """Counting variables away gives what counting bindings gives, for any choice of variables kept."""
    from collections import Counter
    rnd = random.Random(seed)
    m = build(spark, rnd, dirty, sep)
    tb = box(spark) if with_box else None
    triples = materialize(m, tb).coalesce(1).cache()
    plain = [(r.s, r.p, (r.o, r.o_kind, r.o_type)) for r in triples.collect()]
    virtual, stored = Graph.virtual(m, tb), Graph.materialized(triples, NS)
    for patterns in PATTERNS:
        names = list(dict.fromkeys(x[1:] for p in patterns for x in (p[0], p[1], p[2]) if isinstance(x, str) and x.startswith("?")))
        if len(patterns) < 2 or (not with_box and any(n in str(patterns) for n in ("linked", "Thing", "Tagged"))):
            continue
        by = rnd.sample(names, rnd.randint(0, min(2, len(names))))
        want = Counter(tuple(r[names.index(v)] for v in by) for r in evaluate(plain, patterns))
        for g in (virtual, stored):
            got = {tuple(r)[:-1]: r.n for r in g.count_by(by, *patterns).collect() if r.n}
            assert got == dict(want), f"{type(g).__name__} {by} {patterns}"


def brute_force(m):
    """Triples by going through the rows one by one."""
    from urllib.parse import quote
    out = set()
    iri = lambda cm, vals: None if None in vals else m.template(cm).base + cm.sep.join(quote(str(v), safe="") for v in vals)
    for cm in m.classes:
        for r in cm.df.collect():
            s = iri(cm, [r[k] for k in cm.pk])
            if s is None:
                continue
            out.add((s, RDF_TYPE, m.iri(cm.name), "iri", None))
            for p, (c, x) in cm.props.items():
                if r[c] is not None:
                    text = f"{r[c]:.2f}" if x.startswith("decimal") else str(r[c])
                    out.add((s, m.iri(p), text, "lit", x.split("(")[0]))
            for p, o in cm.consts.items():
                out.add((s, m.iri(p), m.iri(o), "iri", None))
    for link in m.links:
        have = [({tuple(r[k] for k in parent.pk) for r in parent.df.collect()}, cols) for parent, cols in link.parents]
        for r in link.df.collect():
            s, o = iri(link.domain, [r[c] for c in link.s_cols]), iri(link.range, [r[c] for c in link.o_cols])
            if s and o and all(tuple(r[c] for c in cols) in keys for keys, cols in have):
                out.add((s, m.iri(link.edge.name), o, "iri", None))
    return out


@pytest.mark.parametrize("seed,dirty,sep", [(11, False, "-"), (12, True, "-")])
def test_materialize_by_hand(spark, seed, dirty, sep):
    m = build(spark, random.Random(seed), dirty, sep)
    got = [tuple(r) for r in materialize(m).collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_force(m)


@pytest.mark.parametrize("seed,dirty", [(21, False), (22, True)])
def test_widening_two_ways(spark, seed, dirty):
    """Rules looked up per mapping give what the rules give on stored triples."""
    from tripleframe.operators.reason import widen
    m, tb = build(spark, random.Random(seed), dirty), box(spark)
    a = materialize(m, tb).collect()
    b = widen(materialize(m), tb).collect()
    assert len(a) == len(set(a)) and len(b) == len(set(b))
    assert set(a) == set(b)


def test_inverse_is_answered(spark):
    m = build(spark, random.Random(31), False)
    g = Graph.virtual(m, box(spark), inverse=True)
    assert answers(g, [("?x", "previous", "?y")]) == sorted((y, x) for x, y in answers(g, [("?x", "next", "?y")]))


def test_typed_values_agree(spark):
    m = build(spark, random.Random(41), False)
    pats, typed = [("?b", "price", "?p"), ("?b", "tag", "?t")], {"p": "decimal"}
    a = Graph.virtual(m).match(*pats, typed=typed)
    b = Graph.materialized(materialize(m), NS).match(*pats, typed=typed)
    assert a.schema["p"].dataType == b.schema["p"].dataType
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_mapping_stats_counts_rows(spark):
    from tripleframe import mapping_stats
    for seed, dirty in ((51, False), (52, True)):
        m = build(spark, random.Random(seed), dirty)
        got = {r.mapping: r.n_triples for r in mapping_stats(m).collect()}
        for link in m.links:
            n = 0
            tables = [([tuple(r[k] for k in p.pk) for r in p.df.collect()], cols) for p, cols in link.parents]
            for r in link.df.collect():
                if None in [r[c] for c in (*link.s_cols, *link.o_cols)]:
                    continue
                times = 1
                for keys, cols in tables:
                    times *= keys.count(tuple(r[c] for c in cols))
                n += times
            assert got[f"map-{link.edge.name.lower()}"] == n


def test_errors(spark):
    m = build(spark, random.Random(61), False)
    g = Graph.virtual(m)
    with pytest.raises(ValueError, match="no mapping gives"):
        g.match(("?x", "unknown", "?y"))
    with pytest.raises(ValueError, match="share no variable"):
        g.match(("?x", "toB", "?b"), ("?y", "tag", "?t"))
    chain = [(f"?x{i}", "next", f"?x{i + 1}") for i in range(9)]
    with pytest.raises(ValueError, match="8 hops"):
        g.match(*chain, max_hops=7)
    with pytest.raises(ValueError, match="not in its table"):
        ClassMap("X", m.classes[0].df, ["nope"])
    assert list(itertools.islice(Mapping(NS, m.classes, [EdgeMap("bad", "B", "A", "domain_fk", ["next"])]).warnings, 1))
    assert g.match(("?x", "toB", "?b")).where(F.lit(False)).count() == 0


def test_aggregates_equal_those_of_bindings(spark):
    """On graphs of random many-to-many edges, values without order and NULLs, with every kind of aggregate."""
    rnd = random.Random(11)
    for _ in range(1):
        people = [(i, rnd.choice(["a", "b", None]), round(rnd.uniform(-9, 9), 2), rnd.choice(["1.5", "x", None, "2"])) for i in range(30)]
        ties = [(rnd.randrange(34), rnd.randrange(12)) for _ in range(90)]
        clubs = [(i, rnd.randrange(3)) for i in range(12)]
        frame = lambda rows, schema: spark.createDataFrame(rows, schema)
        m = Mapping(NS, [ClassMap("Person", frame(people, "id int, kind string, money double, odd string"), ["id"], props={"kind": ("kind", "string"), "money": ("money", "decimal(9,2)"), "odd": ("odd", "string")}, unique=True),
                         ClassMap("Club", frame(clubs, "id long, size int"), ["id"], props={"size": ("size", "integer")}, unique=True)],
                    [EdgeMap("in", "Person", "Club", "junction", ["p"], ["c"], frame(ties, "p int, c int"))])
        typed = {"m": "decimal(9,2)", "z": "integer", "d": "decimal(9,3)"}
        aggs = {"n": ("count", None), "sm": ("sum", "m"), "am": ("avg", "m"), "lo": ("min", "m"), "hi": ("max", "m"), "sz": ("sum", "z"), "az": ("avg", "z"), "who": ("count_distinct", "p")}
        shapes = [([("?p", "in", "?c"), ("?p", "money", "?m"), ("?c", "size", "?z")], aggs, (["c"], ["c", "z"], [])),
                  ([("?p", "in", "?c"), ("?q", "in", "?c"), ("?p", "money", "?m"), ("?q", "kind", "?k"), ("?c", "size", "?z")], aggs, (["k"], ["q"])),
                  ([("?p", "odd", "?d"), ("?p", "in", "?c")], {"s": ("sum", "d"), "a": ("avg", "d"), "n": ("count", "d"), "v": ("count_distinct", "d")}, (["c"], [])),
                  ([("?p", "?any", "?v")], {"n": ("count", None), "s": ("count_distinct", "p")}, (["any"], []))]
        for g in (Graph.virtual(m), Graph.materialized(materialize(m), NS)):
            for patterns, wanted, groups in shapes:
                for by in groups:
                    names = {v[1:] for p in patterns for v in p if isinstance(v, str) and v.startswith("?")}
                    t = {v: x for v, x in typed.items() if v in names}
                    plain = g.match(*patterns, typed=t).groupBy(*by).agg(*[F.count(F.lit(1)).alias(a) if how == "count" else getattr(F, how)(v).alias(a) for a, (how, v) in wanted.items()])
                    got = g.aggregate(by, wanted, *patterns, typed=t)
                    assert got.dtypes == plain.dtypes
                    assert sorted(map(str, got.collect())) == sorted(map(str, plain.collect())), (by, patterns)
    assert g.aggregate(["c"], {"n": ("count", None)}, ("?p", "in", "?c"), ("?c", "size", Literal("77", "integer"))).count() == 0
    for bad in ({"n": ("median", "m")}, {"n": ("sum", "p")}, {"c": ("count", None)}, {"n": ("min", None)}):
        with pytest.raises(ValueError):
            g.aggregate(["c"], bad, ("?p", "in", "?c"), ("?p", "money", "?m"))
