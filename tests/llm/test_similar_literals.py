"""Literals that share nearly all their n-grams, against plain Python."""
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleframe import ClassMap, Mapping, materialize
from tripleframe.llm import gram_join, near_groups
from tripleframe.llm.queries import QUERIES
from tripleframe.llm.rows import send_package

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def sent(spark):
    send_package(spark)


def grams(text, width):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i:i + width]) for i in range(len(w) - width + 1)) or (frozenset([tuple(w)]) if w else frozenset())


def connected(texts, width=3, percent=90):
    sets = {k: grams(t, width) for k, t in texts.items()}
    up = {k: k for k in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    holders, both = {}, Counter()
    for k in texts:
        for g in sets[k]:
            for other in holders.setdefault(g, []):
                both[other, k] += 1
            holders[g].append(k)
    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), find(k)) for k in texts}


def run(spark, texts, **how):
    rows = gram_join.similar_literals(spark.createDataFrame(list(texts.items()), "s long, o string"), **how).collect()
    assert len(rows) == len(texts)
    return {r.s: (r.n_grams, r.component_s) for r in rows}


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in QUERIES["op11_ngram_jaccard_join"](spark, SF).collect()}
    assert got == connected(docs)


def edited(rnd, words, n, vocabulary=5000):
    words = list(words)
    for _ in range(n):
        at = rnd.randrange(len(words))
        what = rnd.randrange(3)
        words[at:at + (what > 0)] = [f"e{rnd.randrange(vocabulary)}"] * (what < 2)
    return words


def test_random_families(spark):
    rnd, texts = random.Random(5), {}
    for family in range(60):
        base = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([3, 9, 11, 12, 14, 20, 33, 60, 140, 400]))]
        for _ in range(rnd.randrange(1, 7)):
            texts[len(texts)] = " ".join(edited(rnd, base, rnd.randrange(0, 2 + len(base) // 60)))
    assert sum(c != k for k, (_, c) in connected(texts).items()) > 50
    assert run(spark, texts) == connected(texts)
    assert run(spark, texts, width=1, percent=70) == connected(texts, 1, 70)


def test_ring_and_common_passage(spark, monkeypatch):
    # Each text is near the next only; and many texts with one passage are not near, though they meet in buckets.
    words = [f"v{i}" for i in range(900)]
    texts = {i: " ".join(words[7 * i:7 * i + 300]) for i in range(40)}
    rnd = random.Random(2)
    shared = [f"p{i}" for i in range(160)]
    for i in range(60):
        texts[100 + i] = " ".join(shared + [f"q{rnd.randrange(10 ** 6)}" for _ in range(12)])
    want = connected(texts)
    assert want[39][1] == 0 and want[150][1] == 150
    assert run(spark, texts) == want
    monkeypatch.setattr(near_groups, "DRAWS", 0)
    monkeypatch.setattr(near_groups, "FEW", 2)
    monkeypatch.setattr(near_groups, "BLOCK", 8)
    assert run(spark, texts) == want
    monkeypatch.setattr(near_groups, "PARTNERS", 2)
    monkeypatch.setattr(near_groups, "FRAGMENT", 16)
    monkeypatch.setattr(near_groups, "BROADCAST_KEYS", 0)
    assert run(spark, texts) == want


def test_similar_sets_have_a_bucket_in_common():
    rnd = np.random.default_rng(1)
    for percent in (60, 80, 90, 95):
        for n in [*range(1, 40), 90, 300, 2000]:
            for _ in range(4):
                # As different as the threshold lets them be, half of the time crowded so that most segments are empty.
                top = 1 << int(rnd.choice([63, 36]))
                a = np.unique(rnd.integers(0, top, n, np.uint64))
                lost = int(rnd.integers(0, 1 + len(a) * (100 - percent) // 100))
                new = rnd.integers(0, top, max(0, (100 * (len(a) - lost)) // percent - len(a)), np.uint64)
                b = np.unique(np.concatenate([np.delete(a, rnd.choice(len(a), lost, replace=False)), new]))
                both = len(np.intersect1d(a, b))
                if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                    h, first = np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)])
                    own, key = gram_join.bucket_keys(h, first, percent)
                    assert len(np.intersect1d(key[own == 0], key[own == 1])), (percent, n)


ODD = [("http://e/a", "http://e/p", "one two three four", "lit", "@en"), ("http://e/a", "http://e/q", "one  TWO three\nfour", "lit", "string"),
       ("http://e/a", "http://e/p", "one two three four", "lit", "@en"), ("http://e/b", "http://e/p", None, "lit", None), ("http://e/b", "http://e/p", "", "lit", "string"),
       (None, "http://e/p", " \n ", "lit", "string"), ("http://e/c", None, "one two three four", "lit", "string"), ("http://e/d", "http://e/p", "http://e/x", "iri", None),
       ("http://e/e", "http://e/p", "x", "lit", "string"), ("http://e/f", "http://e/p", "X", "lit", "string"),
       ("http://e/g", "http://e/p", " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000)), "lit", "string"),
       ("http://e/h", "http://e/p", " ".join(f"w{i % 977}x{i % 31}" for i in range(60_000)) + " tail", "lit", "string")]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, "s string, p string, o string, o_kind string, o_type string").withColumns({"k": F.lit(1), "c": F.lit("c"), "n": F.lit(0.5), "bh": F.lit(None).cast("int")})
    rows = gram_join.similar_literals(df).collect()
    got = {(r.s, r.p): (r.n_grams, r.component_s, r.component_p) for r in rows}
    assert len(rows) == 9  # NULL and empty text of one subject and predicate are one literal; so are repeated rows
    assert got["http://e/a", "http://e/q"] == (2, "http://e/a", "http://e/p") and got["http://e/c", None] == (2, "http://e/a", "http://e/p")
    assert got["http://e/b", "http://e/p"] == (0, "http://e/b", "http://e/p") and got[None, "http://e/p"] == (0, None, "http://e/p")
    assert got["http://e/f", "http://e/p"] == (1, "http://e/e", "http://e/p") and got["http://e/h", "http://e/p"][1] == "http://e/g"
    assert gram_join.similar_literals(df.where("false")).count() == 0
    assert {r.s for r in gram_join.similar_literals(df.select("s", "o")).collect()} >= {"http://e/d", None}


def test_triples_of_a_mapping(spark):
    lines = [(1, "the small red box of the old man", "x"), (2, "the small red box of the old man", None), (3, "another text", "y")]
    parts = spark.createDataFrame(lines, "id int, note string, code string")
    m = Mapping("http://e/", [ClassMap("Part", parts, ["id"], props={"note": ("note", "string"), "code": ("code", "string")}, unique=True)])
    got = {(r.s, r.p): (r.component_s, r.component_p) for r in gram_join.similar_literals(materialize(m)).collect()}
    assert len(got) == 5  # literals only, no class
    assert got["http://e/part/2", "http://e/note"] == ("http://e/part/1", "http://e/note")
    assert got["http://e/part/3", "http://e/code"] == ("http://e/part/3", "http://e/code")
