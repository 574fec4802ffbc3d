"""Positions, ranks and running totals against plain loops, with one group over all partitions."""

import re
from itertools import accumulate

import pytest

from domicilia.operators.prefix import dense_ranks, positions, running_total
from domicilia.session import shared_path


@pytest.fixture(scope="module")
def rows(spark):
    """One group of 4,000 rows, one of 3, one of NULL key, and ties."""
    data = [("a", k % 1000, float(k % 7)) for k in range(4000)] + [("b", 1, None), ("b", 2, 5.0), ("b", None, 1.0), (None, 3, 2.0)]
    return spark.createDataFrame(data, "g string, k int, v double").repartition(5)


def test_positions(rows):
    got = positions(rows, ["g"], ["k"], partitions=16).collect()
    for group, n in (("a", 4000), ("b", 3), (None, 1)):
        own = sorted((r for r in got if r.g == group), key=lambda r: r.position)
        assert [r.position for r in own] == list(range(n)) and {r.group_rows for r in own} == {n}
        keys = [(r.k is not None, r.k or 0) for r in own]
        assert keys == sorted(keys)


def test_positions_of_one_value(spark):
    got = positions(spark.range(0, 5000, 1, 8).selectExpr("1 as g", "0 as k"), ["g"], ["k"], partitions=16)
    assert sorted(r.position for r in got.collect()) == list(range(5000))


@pytest.mark.parametrize("limit", [200_000, 0])
@pytest.mark.parametrize("kind", ["sum", "product"])
def test_running_total(spark, kind, limit):
    data = [(k % 2 if k < 3000 else 1, k, 1 + (k % 5) / 1000) for k in range(4000)] + [(3, 0, None), (3, 1, 2.0), (3, 2, None)]
    frame = spark.createDataFrame(data, "g int, k int, v double").repartition(7)
    total = running_total(frame, "v", ["g"], ["k"], "t", kind, 12, limit)
    got = {(r.g, r.k): r.t for r in total.collect()}
    for g in (0, 1):
        own = [(k, v) for h, k, v in sorted(data[:4000]) if h == g]
        steps = accumulate((v for _, v in own), None if kind == "sum" else lambda a, b: a * b)
        assert all(abs(got[g, k] - t) < 1e-9 * t for (k, _), t in zip(own, steps, strict=True))
    assert [got[3, k] for k in range(3)] == [None, 2.0, 2.0]
    if limit:  # otherwise the totals of the partitions are scanned in the same plan
        plan = total._jdf.queryExecution().executedPlan().toString()
        assert re.search(r"windowspecdefinition\(_part#\d+, g#", plan) and not re.search(r"windowspecdefinition\(g#", plan)


@pytest.mark.parametrize("descending", [False, True])
def test_dense_ranks(spark, descending):
    values = [float(k % 997) for k in range(5000)] + [None]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    ranks = dense_ranks(frame, "v", "r", descending, partitions=16)
    known = sorted({v for v in values if v is not None}, reverse=descending)
    expected = [*known, None] if descending else [None, *known]
    assert {r.v: r.r for r in ranks.collect()} == {v: k + 1 for k, v in enumerate(expected)}
    assert dense_ranks(frame.limit(0), "v").count() == 0


def test_shared_path_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = {}
        sparkContext = Context()

    with pytest.raises(RuntimeError, match="checkpoint"):
        shared_path(Session())
