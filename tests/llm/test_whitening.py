"""Embedding whitening against exact fractions, on the smallest tables and on odd ones."""

import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tidewater.llm import whitening


def plain(vectors):
    """n, the sums, the exact covariance and the deviations of lists of floats, in Python's whole numbers."""
    x = [[int(np.floor(1024 * c)) + 100_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(row[i] for row in x) for i in range(d)]
    cov = [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3) for j in range(d)] for i in range(d)]
    return n, cov, [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x]


def test_query_against_fractions(spark, sf_dir):
    table = pq.read_table(f"{sf_dir}/embeddings.parquet")
    ids, vectors = table["vec_id"].to_pylist(), [[float(c) for c in v] for v in table["embedding"].to_pylist()]
    n, cov, far = plain(vectors)
    v = np.array([[float(c) for c in row] for row in cov])
    e, axes = np.linalg.eigh(v)
    e, axes = e[::-1][:8], axes[:, ::-1][:, :8]
    found = whitening.op12_embedding_whitening(spark, sf_dir).toPandas()
    assert len(found) == 8 * n and set(found["n"]) == {n}
    assert dict(zip(found["vec_id"], found["deviation"], strict=True)) == dict(zip(ids, far, strict=True))
    x = np.floor(1024 * np.array(vectors))
    w = (x - x.mean(axis=0)) @ axes / np.sqrt(e)
    got = found.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    signs = np.sign((got * w).sum(axis=0))
    assert np.allclose(got, w * signs, atol=1e-8)
    shares = found.groupby("component")["explained"].first().to_numpy()
    assert np.allclose(shares, e / np.trace(v), rtol=1e-9)
    assert found["identity_error"].nunique() == 1 and found["identity_error"][0] < 1e-9
    assert abs(np.cov(got.T, bias=True) - np.eye(8)).max() < 1e-8


def test_exact_arithmetic():
    random.seed(3)
    for bound in (1, 1 << 10, 1 << 30, 1 << 61):
        y = np.array([[random.randint(-bound, bound) for _ in range(5)] for _ in range(300)], np.int64)
        plain = [[sum(int(r[i]) * int(r[j]) for r in y) for j in range(5)] for i in range(5)]
        assert whitening.cross_products(y).tolist() == plain
        assert whitening.cross_products(y.astype(object)).tolist() == plain
        assert whitening.sums_of_squares(y) == [sum(int(c) ** 2 for c in r) for r in y]
    for value in (0, 5, -5, (1 << 200) - 3, -(1 << 99)):
        assert sum(v << (whitening.LIMB * k) for k, v in whitening._limbs(value)) == value
    wide = whitening.shifted(pa.array([[1e300, -2.5], [0.25]]))
    assert wide.tolist() == [[int(1e300) * 1024, -2560], [256, 0]]


SCHEMA = "vec_id long, embedding array<double>, component int, n long, id string"


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 0.0]), (1, [1.0, 2.0, 0.0]), (None, [3.0, -1.0, 0.5]), (4, None), (5, [1.0, None, 2.0]), (6, [float("nan"), 1.0, 1.0]), (7, [float("inf"), 1.0, 1.0]), (8, [2.0]), (9, [])]
    df = spark.createDataFrame([(*r, 0, 0, "x") for r in rows], SCHEMA)
    found = whitening.whiten(df, "vec_id", "embedding").collect()
    used = [[1.0, 2.0, 0.0], [1.0, 2.0, 0.0], [3.0, -1.0, 0.5], [2.0, 0.0, 0.0], [0.0, 0.0, 0.0]]
    n, _, far = plain(used)
    assert {r.component for r in found} == {1, 2, 3} and {r.n for r in found} == {n}
    per = {r.id: (r.deviation, r.deviation_digits) for r in found}
    assert per == {1: (far[0], str(far[0])), None: (far[2], str(far[2])), 8: (far[3], str(far[3])), 9: (far[4], str(far[4]))}
    assert len(found) == 15 and found[0].identity_error < 1e-9


def test_no_variance_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0, 0, "x")] * 3, SCHEMA)
    assert whitening.whiten(df, "vec_id", "embedding").count() == 0
    assert whitening.whiten(df.limit(0), "vec_id", "embedding").count() == 0


def test_sums_that_pass_a_long(spark):
    values = [1e15, -3e15, 2.5e14, 7.0]
    df = spark.createDataFrame([(i, [v, float(i)], 0, 0, "x") for i, v in enumerate(values)], SCHEMA)
    n, cov, far = plain([[v, float(i)] for i, v in enumerate(values)])
    found = whitening.whiten(df, "vec_id", "embedding", components=1)
    assert {r.id: r.deviation_digits for r in found.collect()} == dict(enumerate(map(str, far)))
    assert found.where(F.col("deviation").isNotNull()).count() == sum(f < 1 << 63 for f in far)
    assert abs(whitening.fit(df, "embedding").covariance[0, 0] / float(cov[0][0]) - 1) < 1e-12
