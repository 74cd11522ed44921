"""The versioned store: what a refresh writes, what readers see meanwhile, and what dying writers leave."""
import pytest
from pyspark.sql import functions as F

from suite.tables import NS, mapping
from tripleframe import Graph, Literal, materialize
from tripleframe.sources.store import TripleStore, digests, reconcile_store

SF = "/root/testdata/sf0.001"
ROWS = [(f"{NS}a/{i}", f"{NS}p{i % 3}", str(i), "lit", "string") for i in range(300)] + [(f"{NS}a/1", f"{NS}e", f"{NS}a/2", "iri", None), (f"{NS}a/1", f"{NS}p0", "", "lit", "@en")]
SCHEMA = "s string, p string, o string, o_kind string, o_type string"


def bag(df):
    return sorted(map(tuple, df.select("s", "p", "o", "o_kind", "o_type").collect()), key=str)


def files(path):
    return {str(f.relative_to(path)) for f in path.rglob("*.parquet")}


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_refresh_writes_what_differs(spark, tmp_path, rows):
    store = TripleStore(spark, str(tmp_path / "s"), bucket_triples=10)
    assert store.load().isEmpty() and store.versions() == []
    first = store.refresh(rows)
    assert first.version == 1 and first.kept == 0 and first.written > 20
    assert bag(store.load()) == bag(rows)
    there = files(tmp_path)
    assert not store.refresh(rows.repartition(7)).changed and files(tmp_path) == there  # order does not matter
    other = rows.where(f"s <> '{NS}a/7'").union(spark.createDataFrame([(f"{NS}a/8", f"{NS}p2", "new", "lit", "string")], SCHEMA))
    second = store.refresh(other)
    assert (second.version, second.written, second.kept) == (2, 2, first.written - 2)
    assert there < files(tmp_path)  # nothing old was touched
    assert bag(store.load()) == bag(other) and bag(store.load(1)) == bag(rows)
    third = store.refresh(rows.where(f"p <> '{NS}p1'"))
    assert third.dropped > 5 and bag(store.load(3)) == bag(rows.where(f"p <> '{NS}p1'"))
    assert store.refresh(rows).version == 4 and bag(store.load()) == bag(rows)
    assert store.clear().version == 5 and store.load().isEmpty() and bag(store.load(2)) == bag(other)
    with pytest.raises(ValueError):
        store.load(9)


def test_buckets_grow_with_a_predicate(spark, tmp_path, rows):
    store = TripleStore(spark, str(tmp_path / "s"), bucket_triples=10)
    small = rows.where(f"p = '{NS}p1'").limit(8)
    small = spark.createDataFrame(small.collect(), SCHEMA)
    store.refresh(small)
    assert store.manifest().first().buckets == 1
    grown = rows.where(f"p = '{NS}p1'")
    store.refresh(grown)
    assert {r.buckets for r in store.manifest().collect()} == {16} and bag(store.load()) == bag(grown)


class Dies(Exception):
    pass


@pytest.mark.parametrize("when", ["data", "manifest", "pointer"])
def test_a_killed_writer_changes_nothing(spark, tmp_path, rows, monkeypatch, when):
    store = TripleStore(spark, str(tmp_path / "s"), bucket_triples=50)
    store.refresh(rows)
    there = files(tmp_path)
    broken, pointers = TripleStore(spark, store.path, 50), store._pointers
    if when == "data":  # some of its files are there
        def half(triples, differ, write):
            TripleStore._write_data(store, triples, differ[:1], write)
            raise Dies
        monkeypatch.setattr(broken, "_write_data", half)
    elif when == "manifest":
        def whole(triples, differ, write):
            TripleStore._write_data(store, triples, differ, write)
            raise Dies
        monkeypatch.setattr(broken, "_write_data", whole)
    else:
        calls = []

        def second():
            calls.append(1)
            if len(calls) > 2:
                raise Dies
            return pointers()
        monkeypatch.setattr(broken, "_pointers", second)
    other = rows.withColumn("o", F.concat("o", F.lit("!")))
    with pytest.raises(Dies):
        broken.refresh(other)
    assert there < files(tmp_path)
    assert store.versions() == [1] and bag(store.load()) == bag(rows)
    assert len(store.vacuum()) == (2 if when == "pointer" else 1) and files(tmp_path) == there
    assert store.refresh(other).version == 2 and bag(store.load()) == bag(other)


def test_another_writer_is_noticed(spark, tmp_path, rows, monkeypatch):
    store, other = TripleStore(spark, str(tmp_path / "s")), TripleStore(spark, str(tmp_path / "s"))
    monkeypatch.setattr(store, "_write_data", lambda *a: (TripleStore._write_data(store, *a), other.refresh(rows.limit(3))))
    with pytest.raises(RuntimeError):
        store.refresh(rows)
    assert other.load().count() == 3


def test_vacuum_keeps_what_is_needed(spark, tmp_path, rows):
    store = TripleStore(spark, str(tmp_path / "s"), bucket_triples=20)
    store.refresh(rows)
    changed = rows.withColumn("o", F.when(F.col("p") == NS + "p1", F.concat("o", F.lit("!"))).otherwise(F.col("o")))
    store.refresh(changed)
    store.refresh(changed.withColumn("o", F.when(F.col("p") == NS + "p1", F.concat("o", F.lit("?"))).otherwise(F.col("o"))))
    assert store.vacuum(keep=2) == [] and store.versions() == [2, 3]  # the first write still holds two predicates
    assert bag(store.load(2)) == bag(changed)
    assert len(store.vacuum()) == 2 and store.versions() == [3] and store.load().count() == len(ROWS)


def test_lookups_open_one_folder(spark, tmp_path):
    store = TripleStore(spark, str(tmp_path / "s"))
    store.refresh(materialize(mapping(spark, SF, ["Customer", "Order"])))
    g = Graph.materialized(store.load(), NS)
    df = g.match(("?o", "placedBy", "?c"), ("?c", "segment", Literal("BUILDING")))
    assert df.count() == Graph.virtual(mapping(spark, SF)).match(("?o", "placedBy", "?c"), ("?c", "segment", Literal("BUILDING"))).count()
    read = g.match(("?c", "segment", "?x"))
    assert read.count() == 150
    listed = read.select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r.f.rsplit("/", 2)[0] for r in listed}) == 1


def test_digests_tell_triples_apart(spark, tmp_path, rows):
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(digests(rows)) == key(digests(rows.repartition(5)))
    assert key(digests(rows)) != key(digests(rows.withColumn("o_type", F.lit("string"))))
    store = TripleStore(spark, str(tmp_path / "s"))
    store.refresh(rows.where(f"p <> '{NS}p1'").withColumn("o", F.when(F.col("p") == NS + "e", f"{NS}a/3").otherwise(F.col("o"))))
    got = {r.p: (r.expected, r.stored, r.state) for r in reconcile_store(rows.where(f"p <> '{NS}p2'"), store).collect()}
    assert got == {NS + "p0": (101, 101, "match"), NS + "p1": (100, 0, "missing"), NS + "p2": (0, 100, "extra"), NS + "e": (1, 1, "mismatch")}


def test_ranges_reach_the_scan_and_are_exact(spark, tmp_path):
    from datetime import date, datetime
    from decimal import Decimal

    from tripleframe import ClassMap, Mapping, Range
    texts = ["0", "-0.0", "1", "1.0", "00000000001", "1e0", "0.00000000001", "0.00000000002", "9007199254740992", "9007199254740993", "9007199254740994", "99999999999999999999",
             "99999999999999999998", "123456789012345678901234567890.5", "123456789012345678901234567890.4", "-5", "NaN", "INF", "x", "", None]
    rows = [(i, t, None if t is None or i > 15 else i * 7 - 20, None if i > 15 else i / 4, date(2024, 1, 1 + i % 28), datetime(2024, 1, 1 + i % 28, i % 24, 30)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id int, t string, n int, d double, day date, at timestamp_ntz")
    df.write.parquet(str(tmp_path / "in"))
    df = spark.read.parquet(str(tmp_path / "in"))
    m = Mapping(NS, [ClassMap("X", df, ["id"], unique=True, props={"t": ("t", "decimal"), "n": ("n", "integer"), "d": ("d", "decimal(9,1)"), "day": ("day", "date"), "at": ("at", "dateTime"), "name": ("t", "string")})])
    store = TripleStore(spark, str(tmp_path / "s"))
    store.refresh(materialize(m))
    kept, plain, mapped = Graph.materialized(store.load(values=True), NS), Graph.materialized(store.load(), NS), Graph.virtual(m)

    def number(text):
        try:
            return Decimal(text.strip()) if text else None
        except ArithmeticError:
            return None
    spark.conf.set("spark.sql.maxMetadataStringLength", 5000)
    ops = {"least": lambda a, b: a >= b, "most": lambda a, b: a <= b, "above": lambda a, b: a > b, "below": lambda a, b: a < b}
    bounds = [0, 1, Decimal("0.00000000001"), 9007199254740993, Decimal("99999999999999999998.5"), Decimal("123456789012345678901234567890.45"), -5.0]
    values = {r.x: r.v for r in plain.match(("?x", "t", "?v")).collect()}
    assert len(values) == len([t for t in texts if t is not None])
    for how in ops:
        for b in bounds:
            want = {x for x, v in values.items() if (y := number(v)) is not None and not y.is_nan() and ops[how](y, Decimal(str(b)))}
            for g in (kept, mapped):
                assert {r.x for r in g.match(("?x", "t", "?v"), ranges={"v": Range(**{how: b})}).collect()} == want, (how, b)
    for prop, r, good in (("n", Range(above=3.5, below=30), lambda r: r[2] is not None and 3.5 < r[2] < 30), ("d", Range(least=Decimal("1.3"), most=2), lambda r: r[3] is not None and Decimal("1.3") <= round(Decimal(str(r[3])) + Decimal("0.0000001"), 1) <= 2),
                          ("day", Range(least=date(2024, 1, 3), below=date(2024, 1, 9)), lambda r: date(2024, 1, 3) <= r[4] < date(2024, 1, 9)),
                          ("at", Range(above=datetime(2024, 1, 2, 1, 30), most=date(2024, 1, 6)), lambda r: datetime(2024, 1, 2, 1, 30) < r[5] <= datetime(2024, 1, 6))):
        want = {f"{NS}x/{row[0]}" for row in rows if good(row)}
        for g in (kept, plain, mapped):
            got = g.match(("?x", prop, "?v"), ranges={"v": r})
            assert {x.x for x in got.collect()} == want and want
            assert g.aggregate([], {"k": ("count", None)}, ("?x", prop, "?v"), ranges={"v": r}).first().k == len(want)
        plan = lambda g: g.match(("?x", prop, "?v"), ranges={"v": r})._jdf.queryExecution().executedPlan().toString()  # noqa: E731, B023
        name = "o_at" if r.temporal else "o_num"
        assert f"OrEqual({name}," in plan(kept) and f"OrEqual({prop}," in plan(mapped)
    assert mapped.match(("?x", "name", "?v"), ranges={"v": Range(least=0)}).isEmpty() and kept.match(("?x", "name", "?v"), ranges={"v": Range(least=0)}).isEmpty()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    for bad in ({}, {"least": 1, "most": date(2024, 1, 1)}, {"least": float("nan")}, {"least": Decimal("1." + "1" * 40)}):
        with pytest.raises(ValueError):
            Range(**bad)
    with pytest.raises(ValueError):
        kept.match(("?x", "t", "?v"), ranges={"x": Range(least=0)})
