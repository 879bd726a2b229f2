import math

import numpy as np
import pytest

from larder.llm.whitening import polar, spectral, whitened_components

SCHEMA = "vec_id long, embedding array<float>, n string, whitened int"


def whole(v):
    return [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]


def brute(rows):
    """n, squared distances, eigenvalues and |whitened| by a library's eigensolver, of vectors of the commonest length."""
    kept = [(i, whole(v)) for i, v, *_ in rows if v is not None and len(v) == 5 and all(c is not None and math.isfinite(c) for c in v)]
    x = [v for _, v in kept]
    n, total = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, total, strict=True)) for v in x]
    y = (n * np.array(x) - np.array(total)) / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, [i for i, _ in kept], deviation, values, y @ vectors / np.sqrt(values)


def odd_rows():
    draw = np.random.default_rng(2)
    mixing = draw.normal(size=(5, 5)) / 3
    rows = [(i, [float(c) for c in draw.normal(size=5) @ mixing], "x", 1) for i in range(700)]
    rows += [(900 + i, rows[3][1], "copy", 2) for i in range(300)]
    rows += [(None, [0.5] * 5, "", 0), (2000, None, "", 0), (2001, [], "", 0), (2002, [1.0, None, 1.0, 1.0, 1.0], "", 0), (2003, [float("nan")] * 5, "", 0)]
    return rows + [(2004, [float("-inf")] * 5, "", 0), (2005, [0.0] * 5, "", 0), (2006, [1.0] * 7, "", 0), rows[0], rows[0]]


def test_components_equal_another_solver(spark):
    rows = odd_rows()
    got = whitened_components(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    n, ids, deviation, values, white = brute(rows)
    assert len(got) == 5 * n and {r.n for r in got} == {n}
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.deviation) for r in got if r.component == 1) == sorted((-1 if i is None else i, d) for i, d in zip(ids, deviation, strict=True))
    by_id = {i: white[k] for k, i in enumerate(ids)}
    signs = {}
    for r in got:
        want = by_id[r.vec_id][r.component - 1]
        if abs(want) > 1e-3:
            assert signs.setdefault(r.component, np.sign(r.whitened * want)) == np.sign(r.whitened * want)
        assert abs(abs(r.whitened) - abs(want)) < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-10)
        assert r.identity_error < 1e-9


def test_only_the_first_components(spark):
    got = whitened_components(spark.createDataFrame(odd_rows(), SCHEMA), components=2).collect()
    assert {r.component for r in got} == {1, 2}


def test_without_variance_there_is_no_component(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert whitened_components(none).collect() == []
    same = spark.createDataFrame([(i, [0.25, 0.5], "", 0) for i in range(4)], SCHEMA)
    assert whitened_components(same).collect() == []
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0], "", 0) for i in range(9)], SCHEMA)
    got = whitened_components(line).collect()
    assert {r.component for r in got} == {1} and len(got) == 9
    assert {r.explained for r in got} == {1.0}


def test_distances_beyond_a_long_are_null(spark):
    far = spark.createDataFrame([(0, [1e9], "", 0), (1, [-1e9], "", 0), (2, [0.0], "", 0)], SCHEMA)
    assert {r.vec_id: r.deviation is None for r in whitened_components(far).collect()} == {0: True, 1: True, 2: False}


def matrices():
    draw = np.random.default_rng(1)
    q, _ = np.linalg.qr(draw.normal(size=(8, 8)))
    x = draw.normal(size=(300, 40))
    x[:, 30:] = x[:, :10]
    yield np.cov(x.T)
    yield np.zeros((3, 3))
    yield np.array([[0.0, 1.0], [1.0, 0.0]])
    yield np.ones((6, 6))
    for values in ([1, 1, 1, 1, 2, 2, 2, 1e-9], [1, 1 + 1e-14, 1, 1, 1, 1 + 1e-13, 1, 1], [1e12, 1, 1e-12, 0, -1, -1e12, 5, 5]):
        yield q @ np.diag(np.array(values, float)) @ q.T


@pytest.mark.parametrize("a", matrices())
def test_spectral_divide_and_conquer(a):
    a = (a + a.T) / 2
    values, vectors = spectral(a)
    scale = max(np.linalg.norm(a), 1e-300)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-14 * scale * len(a)
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13
    assert np.linalg.norm(a @ vectors - vectors * values) < 1e-13 * scale


def test_polar_factor_is_the_sign():
    draw = np.random.default_rng(3)
    q, _ = np.linalg.qr(draw.normal(size=(6, 6)))
    factor = polar(q @ np.diag([5.0, 3.0, 1e-10, -1e-10, -2.0, -9.0]) @ q.T)
    assert np.abs(factor @ factor - np.eye(6)).max() < 1e-12
    assert round(np.trace(factor)) == 0
