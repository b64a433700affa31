"""Whitening against numpy's eigendecomposition and exact integers."""

import math

import numpy as np
import pytest

from siftline.llm import jacobi_whitening as jw
from siftline.llm import queries
from siftline.sources.tables import table

SF = "/root/testdata/sf0.01"


def reference(vectors):
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for v in vectors], object)
    n, sums = len(x), x.sum(axis=0)
    deviation = ((x * n - sums) ** 2).sum(axis=1)
    centred = (x * n - sums).astype(float) / n
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, centred, e[::-1], v[:, ::-1]


def test_query_against_eigenvectors(spark):
    rows = table(spark, SF, "embeddings").select("vec_id", "embedding").collect()
    fine = {r["vec_id"]: r["embedding"] for r in rows if r["embedding"] and all(c is not None and math.isfinite(c) for c in r["embedding"])}
    ids = list(fine)
    n, deviation, centred, e, v = reference(fine.values())
    got = queries.QUERIES["op11_jacobi_whitening"](spark, SF).toPandas()
    assert len(got) == 8 * n and set(got.n) == {n} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    for k in range(1, 9):
        one = got[got.component == k].set_index("vec_id").loc[ids]
        assert one.deviation.tolist() == deviation.tolist()
        want = centred @ v[:, k - 1] / np.sqrt(e[k - 1])
        want *= np.sign(want @ one.whitened.to_numpy())
        assert np.allclose(one.whitened, want, atol=1e-9)
        assert np.allclose(one.explained, e[k - 1] / e.sum(), rtol=1e-10)


@pytest.mark.parametrize("d", [1, 2, 5, 16, 33])
def test_jacobi_keeps_small_singular_values(d):
    r = np.random.default_rng(d)
    q, _ = np.linalg.qr(r.normal(size=(d, d)))
    s = np.logspace(0, -12, d)
    v, found = jw.one_sided_jacobi(np.linalg.qr(np.diag(s) @ q.T, mode="r"))
    assert np.allclose(found, s, rtol=1e-3) and np.allclose(v.T @ v, np.eye(d), atol=1e-12)
    assert np.allclose(np.abs(v.T @ q), np.eye(d), atol=1e-4)
    assert not jw.one_sided_jacobi(np.zeros((d, d)))[1].any()


def test_rows_that_have_no_result(spark):
    nan, inf = float("nan"), float("inf")
    good = [[1.0, 2.0], [2.0, 1.0], [0.0, 0.5], [0.0, 0.5]]
    bad = [None, [], [1.0, None], [nan, 1.0], [inf, 1.0], [1e300, 0.0], [1.0, 2.0, 3.0]]
    rows = [(None if k == 3 else k // 2, v, 1.0) for k, v in enumerate(good + bad)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, whitened double").repartition(5)
    out = jw.report(df).toPandas()
    assert len(out) == 8 and set(out.component) == {1, 2} and set(out.n) == {4}
    _, deviation, _, e, _ = reference(good)
    assert sorted(out[out.component == 1].deviation) == sorted(deviation.tolist()) and np.isclose(out.explained.max(), e[0] / e.sum())
    assert out.vec_id.isna().sum() == 2
    assert jw.report(df.limit(0)).count() == 0 and jw.report(df.where("vec_id = 99")).collect() == []


def test_components_without_variance(spark):
    df = spark.createDataFrame([(k, [float(k), 3.0, float(k)]) for k in range(5)], "vec_id long, embedding array<float>")
    out = jw.report(df).toPandas()
    assert len(out) == 15 and out[out.component > 1].whitened.isna().all() and not out[out.component > 1].explained.any()
    assert out[out.component == 1].whitened.notna().all() and out.identity_error.max() < 1e-9
    one = jw.report(df.limit(1)).toPandas()
    assert one.whitened.isna().all() and set(one.deviation) == {0} and not one.explained.any()


def test_deviations_beyond_a_long():
    x = np.array([[1 << 50], [0]])
    model = jw.Whitening(1 << 20, np.array([0]), np.eye(1), np.ones(1), 1.0)
    assert jw.deviations(x, model) == [None, 0]
    assert jw.deviations(np.array([[3_000_000]]), jw.Whitening(1000, np.array([5]), np.eye(1), np.ones(1), 1.0)) == [(3_000_000_000 - 5) ** 2]


def test_whitened_column(spark):
    df = table(spark, SF, "embeddings")
    model = jw.fit(df)
    out = jw.apply(df, model, k=3)
    z = np.array(out.select("whitened").toPandas().whitened.tolist())
    assert out.columns == [*df.columns, "whitened"] and z.shape == (model.n, 3) and np.allclose(z.T @ z / model.n, np.eye(3), atol=1e-9)
    with pytest.raises(ValueError, match="already"):
        jw.apply(out, model)


def test_triangles_do_not_depend_on_the_partitions(spark):
    df = table(spark, SF, "embeddings")
    a, b = jw.fit(df.coalesce(1)), jw.fit(df.repartition(70))
    assert a.n == b.n and (a.sums == b.sums).all() and np.allclose(a.deviations, b.deviations, rtol=1e-12)
    assert np.allclose(a.components[:, :8], b.components[:, :8], atol=1e-9)
