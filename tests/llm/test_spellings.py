"""Spelling variants against plain Python."""
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleframe import ClassMap, Mapping, materialize
from tripleframe.llm import spellings
from tripleframe.llm.queries import QUERIES
from tripleframe.llm.rows import send_package

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def sent(spark):
    send_package(spark)


def counted(texts, least=7, misspell=31):
    c = Counter()
    for k, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{k}:{run}".encode())
            if misspell and h % misspell == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            c[run] += len(run) >= least
    return c


def variants(c, factor=10):
    cut, near = defaultdict(set), defaultdict(set)
    for w in c:
        for i in range(len(w)):
            d = w[:i] + w[i + 1:]
            cut[i, d].add(w)
            if d in c:
                near[w].add(d)
                near[d].add(w)
    for g in cut.values():
        for a in g:
            near[a] |= g - {a}
    form = {}
    for w, n in c.items():
        best = min(near[w], key=lambda x: (-c[x], x), default=None)
        form[w] = best if best is not None and c[best] >= factor * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w
    return {w: (n, len(near[w]), form[w], c[form[w]] if form[w] is not None else None, root(w)) for w, n in c.items()}


def result(df):
    rows = df.collect()
    out = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in rows}
    assert len(out) == len(rows)
    return out


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = variants({w: n for w, n in counted(docs).items() if n >= 2})
    assert result(QUERIES["op13_spelling_variants"](spark, SF)) == want and any(v[2] for v in want.values())


def test_random_words(spark):
    rnd = random.Random(3)
    words = {"".join(rnd.choice("abéc") for _ in range(rnd.randrange(0, 8))) for _ in range(1500)}
    c = {w: rnd.choice([1, 1, 2, 3, 10, 10, 11, 30, 100, 1000, 5000]) for w in words | {"a b", "a\tb", "a  b", "\U0001F600a", "\U0001F600b"}}
    df = spark.createDataFrame(list(c.items()), "word string, n long").withColumns({"sig": F.lit("x"), "root": F.lit(1), "other": F.lit(2)})
    want = variants(c)
    assert any(v[2] and v[2] != v[4] for v in want.values())  # chains of forms
    assert result(spellings.word_variants(df)) == want
    assert result(spellings.word_variants(df, 2)) == variants(c, 2)


def test_near_words_share_a_signature():
    rnd = random.Random(8)
    for _ in range(400):
        w = "".join(rnd.choice("abcdefg") for _ in range(rnd.randrange(1, 14)))
        at, x = rnd.randrange(len(w)), rnd.choice("abcxyz")
        for v in (w[:at] + x + w[at + 1:], w[:at] + x + w[at:]):
            if v != w:
                keys, kinds = spellings.signatures([w, v])
                a, b = (spellings.SAME, spellings.SAME) if len(v) == len(w) else (spellings.SHORT, spellings.LONG)
                assert np.intersect1d(keys[0, kinds == a], keys[1, kinds == b]).size


def test_odd_rows(spark):
    long = "z" * 50_000
    rows = [("http://e/a", "http://e/p", "colour Colours, COLOURÉ colour7colour", "lit"), ("http://e/a", "http://e/p", "colour Colours, COLOURÉ colour7colour", "lit"),
            (None, None, "colours", "lit"), ("http://e/b", "http://e/p", None, "lit"), ("http://e/b", "http://e/p", "", "lit"), ("http://e/c", "http://e/p", "http://colours/", "iri"),
            ("http://e/d", "http://e/p", f"{long} {long} {long}y", "lit")]
    df = spark.createDataFrame(rows, "s string, p string, o string, o_kind string").withColumns({"word": F.lit(1), "n": F.lit("n"), "check": F.lit(0)})
    counts = {r.word: r.n for r in spellings.literal_words(df, 6).collect()}
    assert counts == {"colour": 6, "colours": 3, "colourÉ": 2, long: 2, long + "y": 1}
    got = result(spellings.spelling_variants(df, 6, 1, 2))
    assert got["colours"] == (3, 2, "colour", 6, "colour") and got[long + "y"] == (1, 1, long, 2, long)
    marked = counted([(s or "", o) for s, _, o, kind in rows if kind == "lit"], 6, 3)
    assert {r.word: r.n for r in spellings.literal_words(df, 6, 3).collect()} == {w: n for w, n in marked.items() if n}
    assert spellings.spelling_variants(df.where("false")).count() == 0
    none = spark.createDataFrame([(None, 3), ("abc", None), ("abd", 1)], "word string, n long")
    assert result(spellings.word_variants(none)) == {"abd": (1, 0, None, None, "abd")}


def test_triples_of_a_mapping(spark):
    rows = [(i, "necessary parts") for i in range(20)] + [(20, "neccessary parts"), (21, "necesary parts")]
    m = Mapping("http://e/", [ClassMap("Order", spark.createDataFrame(rows, "id int, note string"), ["id"], props={"note": ("note", "string")}, unique=True)])
    got = result(spellings.spelling_variants(materialize(m), least_n=1))
    assert got["neccessary"] == (1, 1, "necessary", 20, "necessary") and set(got) == {"necessary", "neccessary", "necesary"}
