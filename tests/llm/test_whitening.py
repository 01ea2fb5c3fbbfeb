"""Whitening against a dense eigendecomposition, exact integers, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skysift.llm import catalog, whitening

KIND = "vec_id long, embedding array<double>"


def dense(vectors):
    """Exact deviations, eigenvalues, eigenvectors and trace by Python integers and one dense solver."""
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    d = [[n * a - b for a, b in zip(r, s)] for r in x]
    c = np.array(d, dtype=object).astype(np.float64) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return [sum(a * a for a in r) for r in d], c, e[::-1], u[:, ::-1], np.trace(c.T @ c / n)


def table(df, k):
    rows = sorted(df.collect(), key=lambda r: (r.vec_id, r.component))
    ids = sorted({r.vec_id for r in rows})
    assert [(r.vec_id, r.component) for r in rows] == [(i, j) for i in ids for j in range(1, k + 1)]
    return rows, np.array([r.whitened for r in rows]).reshape(len(ids), k)


def agree(rows, w, vectors, k):
    deviation, c, e, u, trace = dense(vectors)
    assert [r.deviation for r in rows[::k]] == deviation and {r.n for r in rows} == {len(vectors)}
    assert np.allclose([r.explained for r in rows[:k]], e[:k] / trace, rtol=1e-9)
    assert len({r.identity_error for r in rows}) == 1 and rows[0].identity_error < 1e-9
    want = c @ u[:, :k] / np.sqrt(e[:k])
    for j in range(k):
        assert min(np.abs(w[:, j] - want[:, j]).max(), np.abs(w[:, j] + want[:, j]).max()) < 1e-6, j


def test_whole_table(spark, data):
    vectors = [r.embedding for r in spark.read.parquet(f"{data}/embeddings.parquet").orderBy("vec_id").collect()]
    df = catalog.queries()["op13_whitening"](spark, data)
    assert [f"{c} {t}" for c, t in df.dtypes] == ["vec_id bigint", "component int", "n bigint", "deviation bigint", "whitened double", "explained double", "identity_error double"]
    agree(*table(df, 32), vectors, 32)


@pytest.mark.parametrize("steep", [True, False])
def test_range_finder(spark, steep):
    """A falling spectrum is found in a few power passes; a flat one needs all dimensions. Both agree with the dense solver."""
    rng = np.random.default_rng(3)
    scale = 100.0 * (0.03 ** np.arange(80) + 1e-9) if steep else np.linspace(10, 9, 80)
    if steep:
        scale[:4] = [400, 300, 200, 100]
        scale[4:] = 0
    v = (rng.normal(size=(500, 80)) * scale) @ np.linalg.qr(rng.normal(size=(80, 80)))[0]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], KIND).repartition(4)
    x = df.mapInArrow(whitening._whole, "vec_id long, dims int, x binary").select("vec_id", "x")
    q = np.floor(64 * v).astype(int) + 1_000_000
    value, vector, trace, full = whitening.components(x, 500, q.sum(0).tolist(), 4 if steep else 32, 16, 6)
    assert full != steep
    _, c, e, u, t = dense(v)
    assert np.allclose(value, e[: len(value)], rtol=1e-10) and np.isclose(trace, t)
    assert np.abs(np.abs((vector * u[:, : len(value)]).sum(0)) - 1).max() < 1e-9


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    good = [(1, [0.5, -1.0, 2.0]), (1, [0.5, -1.0, 2.0]), (2, [3.0, 1.0, -1.0]), (3, [-4.0, 0.25, 0.0]), (4, [1e4, -7.5, 3.0]), (5, [0.1, 0.2, 0.3])]
    odd = [(6, None), (7, []), (8, [1.0, None, 2.0]), (9, [nan, 1.0, 1.0]), (10, [1.0, inf, 1.0]), (11, [1.0, 2.0]), (12, [1e300, 0.0, 0.0])]
    df = spark.createDataFrame(good + odd, KIND)
    extra = df.select("*", *(F.lit(1).alias(c) for c in ("x", "dims", "n", "component", "whitened", "i", "label")))
    rows = sorted(whitening.whiten(extra).collect(), key=lambda r: (r.vec_id, r.component))
    deviation, _, e, _, trace = dense([v for _, v in good])
    assert [(r.vec_id, r.component, r.n) for r in rows] == [(i, j, 6) for i, js in [(1, [1, 1, 2, 2, 3, 3]), *((k, [1, 2, 3]) for k in (2, 3, 4, 5))] for j in js]
    assert [r.deviation for r in rows if r.component == 1] == deviation
    assert np.allclose([r.explained for r in rows if r.vec_id == 2], e / trace, rtol=1e-4)
    assert rows[0].identity_error < 1e-4
    for few in ([], good[:1], good[:2], odd[:5], [(None, [1.0]), (None, [2.0])]):
        out = whitening.whiten(spark.createDataFrame(few, KIND)).collect()
        assert [(r.vec_id, r.component, r.deviation) for r in out] == ([(None, 1, 64 * 64)] * 2 if few and few[0][0] is None else [])


def test_wide_numbers():
    """Deviations are exact beyond 64 bits on the way, and held at the largest long at the end."""
    x = np.array([[2**61, 0], [-(2**61), 1], [5, 2]])
    s = [5, 3]
    d = whitening._deviations(x, 3, s)
    assert d.tolist() == [[3 * 2**61 - 5, -3], [-3 * 2**61 - 5, 0], [10, 3]]
    assert whitening._deviation(d).tolist() == [2**63 - 1, 2**63 - 1, 109]
