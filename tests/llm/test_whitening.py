"""Whitening against numpy on whole matrices."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from tripleframe.llm import whitening
from tripleframe.llm.queries import QUERIES
from tripleframe.llm.rows import send_package

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def sent(spark):
    send_package(spark)


def principal(vectors, scale=256):
    x = np.floor(scale * np.array(vectors, np.float64)).astype(np.int64)
    u = np.unique(x, axis=0)
    n, sums = len(u), u.sum(0)
    z = (n * u - sums) / n
    e, c = np.linalg.eigh(z.T @ z / n)
    e, c = e[::-1], c[:, ::-1].T
    c = c * np.where(c[np.arange(len(c)), np.abs(c).argmax(1)] < 0, -1, 1)[:, None]
    return n, e, ((n * x - sums) ** 2).sum(1), (n * x - sums) / n @ c.T / np.sqrt(np.maximum(e, 1e-30))


def compare(rows, vectors, m, tolerance=1e-9):
    n, e, far, white = principal(vectors)
    rows = sorted(rows, key=lambda r: (r.s, r.component))
    assert len(rows) == m * len(vectors)
    for r in rows:
        assert r.n == n and int(r.deviation) == far[r.s]
        assert abs(r.whitened - white[r.s, r.component - 1]) < tolerance * max(1, abs(r.whitened))
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < max(1e-9, tolerance / 100) and r.identity_error < 1e-9


def frame(spark, vectors):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "s long, vector array<double>")


def test_query(spark):
    vectors = [r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()]
    rows = QUERIES["op12_embedding_whitening"](spark, SF).withColumnRenamed("vec_id", "s").collect()
    compare(rows, vectors, 4)


def test_repeats_and_dependent_dimensions(spark):
    rnd = np.random.default_rng(4)
    a = rnd.normal(size=(200, 3)) * [1, 5, 0.3]
    # A constant dimension, a repeated one, a sum of two, one far from zero, and repeated rows.
    v = np.concatenate([a, a[:, :1], np.full((200, 1), 7.0), np.floor(256 * a[:, 1:2]) / 256 + np.floor(256 * a[:, 2:]) / 256, a[:, :1] + 1e6], 1)
    v = np.concatenate([v, v[:50], v[:1], v[:1]])
    compare(whitening.whiten(frame(spark, v)).collect(), v, 3, 1e-6)  # three dimensions are their own
    two = np.round(rnd.normal(size=(40, 1)), 1) * [[1.0, 2.0, -1.0]]
    rows = whitening.whiten(frame(spark, two)).collect()
    assert {r.component for r in rows} >= {1} and all(abs(r.explained - 1) < 1e-4 for r in rows if r.component == 1)


def test_shifted_passes_on_dimensions_that_nearly_depend(spark):
    rnd = np.random.default_rng(9)
    a = rnd.normal(size=(300, 1)) * 1000
    v = np.concatenate([a, a + rnd.normal(size=(300, 3)) * 0.5], 1)
    compare(whitening.whiten(frame(spark, v)).collect(), v, 4, 1e-5)


def test_large_numbers_are_exact(spark):
    v = [[float(i * 2 ** 40), float(-i * i)] for i in range(30)]
    n, far = 30, None
    x = [[int(256 * c) for c in r] for r in v]
    sums = [sum(r[d] for r in x) for d in range(2)]
    far = [sum((n * r[d] - sums[d]) ** 2 for d in range(2)) for r in x]
    got = {r.s: int(r.deviation) for r in whitening.whiten(frame(spark, v)).collect()}
    assert got == dict(enumerate(far)) and max(far) > 1 << 63


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 2.0]), ("b", None), ("c", [1.0, None]), ("d", [nan, 1.0]), ("e", [inf, 1.0]), (None, [3.0, -0.0]), ("a", [1.0, 2.0]), ("f", [5.0]), ("g", []), ("g", [0.0, 0.0])]
    df = spark.createDataFrame(rows, "s string, vector array<double>").withColumns({"x": F.lit("x"), "n": F.lit(1), "component": F.lit(None).cast("string")})
    out = whitening.whiten(df).collect()
    assert sorted((r.s or "", r.component) for r in out) == sorted((s, c) for s in ("a", "a", "", "f", "g", "g") for c in (1, 2))
    assert {r.n for r in out} == {4} and out[0].identity_error < 1e-9
    for none in (df.where("false"), df.where("s = 'a'"), df.where("s = 'b'"), df.where("s = 'g'")):
        assert whitening.whiten(none).count() == 0
    assert whitening.whiten(df.where("s = 'a' or s is null"), most=9).select("component").distinct().count() == 1
