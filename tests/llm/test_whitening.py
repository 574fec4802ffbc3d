"""Whitening against exact rational arithmetic and numpy."""

import math
from fractions import Fraction

import numpy as np
import pytest

from domicilia.llm.whitening import Centre, Whitening, covariance, deviations, joined, limbs, pair_squares

SCHEMA = "vec_id long, embedding array<double>, n long, component string, whitened double"


def _frame(spark, rows, parts=5):
    return spark.createDataFrame([(i, v, 1, "x", 0.0) for i, v in rows], SCHEMA).repartition(parts)


def _exact(vectors):
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for v in vectors]
    n, dim = len(x), len(x[0])
    sums = [sum(r[i] for r in x) for i in range(dim)]
    y = [[n * r[i] - sums[i] for i in range(dim)] for r in x]
    cov = [[Fraction(sum(r[i] * r[j] for r in y), n**3) for j in range(dim)] for i in range(dim)]
    return x, sums, cov, [sum(v * v for v in r) for r in y]


def _check(got, ids, vectors, components):
    x, sums, cov, deviation = _exact(vectors)
    n = len(x)
    matrix = np.array([[float(c) for c in row] for row in cov])
    values = np.linalg.eigvalsh(matrix)[::-1]
    rows = {(r.vec_id, r.component): r for r in got}
    assert len(got) == n * components == len(rows)
    white = np.array([[rows[i, k + 1].whitened for k in range(components)] for i in ids])
    centred = np.array(x, float) - np.array([float(Fraction(s, n)) for s in sums])
    for k in range(components):
        r = rows[ids[0], k + 1]
        assert r.n == n and abs(r.explained / (values[k] / values.sum()) - 1) < 1e-9
        # A component's direction follows from its scores; it is a unit eigenvector of the matrix.
        axis = np.linalg.lstsq(centred, white[:, k] * np.sqrt(values[k]), rcond=None)[0]
        assert abs(np.linalg.norm(axis) - 1) < 1e-6 and np.allclose(matrix @ axis, values[k] * axis, atol=1e-6 * values[0])
    own = white - white.mean(0)
    error = np.abs(own.T @ own / n - np.eye(components)).max()
    assert error < 1e-8 and all(r.identity_error < 1e-8 for r in got)
    assert [rows[i, 1].deviation for i in ids] == deviation


def test_random_vectors(spark):
    random = np.random.default_rng(5)
    vectors = (random.normal(size=(400, 6)) @ random.normal(size=(6, 6)) + 50).tolist()
    ids = list(range(400))
    _check(Whitening(components=4).run(_frame(spark, zip(ids, vectors))).collect(), ids, vectors, 4)


def test_hard_rows(spark):
    random = np.random.default_rng(6)
    vectors = random.normal(size=(60, 3)).tolist() + [[0.0, 0.0, 0.0], [1e3, -1e3, 3.0]]
    ids = list(range(62))
    bad = [(900, None), (901, []), (902, [1.0, None, 2.0]), (903, [float("nan"), 1.0, 1.0]), (904, [float("inf"), 0.0, 0.0]), (905, [1e300, 0.0, 0.0]), (906, [1.0, 2.0])]
    got = Whitening().run(_frame(spark, [*zip(ids, vectors), *bad])).collect()
    _check(got, ids, vectors, 3)


def test_repeated_and_null_ids(spark):
    vectors = [[1.0, 2.0], [1.0, 2.0], [3.0, 1.0], [0.0, 5.0]]
    got = Whitening().run(_frame(spark, zip([1, 1, None, 2], vectors))).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(["1"] * 4 + ["None"] * 2 + ["2"] * 2)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(k, [1.0, 2.0]) for k in range(5)]])
def test_nothing_to_whiten(spark, rows):
    assert Whitening().run(_frame(spark, rows, 2)).collect() == []


def test_constant_dimension_gives_no_component(spark):
    vectors = [[float(k), 7.0, float(k % 3)] for k in range(30)]
    got = Whitening().run(_frame(spark, zip(range(30), vectors))).collect()
    assert {r.component for r in got} == {1, 2}


def test_squares_are_exact():
    random = np.random.default_rng(7)
    for size in (5, 1 << 20, 1 << 40):
        z = random.integers(-size, size, (700, 5))
        got = pair_squares(z).tolist()
        rows = [[int(v) for v in r] for r in z]
        expected = [sum(r[i] ** 2 for r in rows) for i in range(5)]
        expected += [sum((r[i] + r[j]) ** 2 for r in rows) for i in range(5) for j in range(i + 1, 5)]
        assert got == expected
        assert [joined(*t) for t in zip(*[[int(v) for v in c] for c in limbs(got)])] == expected


def test_covariance_of_far_values():
    """Differences of large exact numbers lose nothing."""
    z = np.array([[1 << 39, 3], [-(1 << 39), 4], [(1 << 39) - 1, 5]])
    x = [[int(v) + 10**9 for v in r] for r in z]
    centre = Centre(2, 3, tuple(sum(r[i] for r in x) for i in range(2)))
    squares = pair_squares(np.array(x) - np.array(centre.mean)).tolist()
    y = [[3 * r[i] - centre.sums[i] for i in range(2)] for r in x]
    assert covariance(centre, squares)[0, 1] == float(Fraction(sum(r[0] * r[1] for r in y), 27))


def test_deviation_beyond_long_is_null():
    centre = Centre(1, 1 << 30, (0,))
    z = np.array([[1], [2], [3], [4], [1 << 20]])
    assert deviations(z, centre).to_pylist() == [1 << 60, 1 << 62, None, None, None]


def test_given_vectors(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in frame.collect()]
    _check(Whitening().run(frame).collect(), [i for i, _ in rows], [v for _, v in rows], 32)
