"""Post-stratification and bootstrap replicates."""

from collections import Counter, defaultdict
from dataclasses import replace
from math import comb

import numpy as np
import pytest
from pyspark.sql import functions as F

from domicilia.operators import design as d

DESIGN = d.Design(psu="psu", stratum="stratum", weight="weight", post="post", population="pop", replicates=30, buckets=8)


def psu_frame(spark, sizes):
    rows = [(s, 1000 * s + i) for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "stratum int, psu long").withColumns(
        {"weight": 1.0 + F.col("psu") % 3, "post": F.concat(F.lit("p"), F.col("psu") % 4), "pop": F.lit(500.0)}
    )


def counts(frame, replicates):
    """Factor divided by its scale, by stratum, as PSU x replicate arrays of whole numbers."""
    found = defaultdict(dict)
    for r in d.factors(frame, replicates).collect():
        found[r["stratum"]][(r["psu"], r["rep"])] = r["factor"]
    out = {}
    for stratum, cells in found.items():
        psus = sorted({p for p, _ in cells})
        n = len(psus)
        grid = np.array([[cells[p, rep] for rep in range(1, replicates.design.replicates + 1)] for p in psus])
        out[stratum] = grid * ((n - 1) / n if n > 1 else 1)
    return out


def test_weights_meet_the_population(spark):
    weighted = d.post_stratify(psu_frame(spark, {1: 50, 2: 30}), DESIGN)
    sums = {r["post"]: r["s"] for r in weighted.groupBy("post").agg(F.sum("w").alias("s")).collect()}
    assert sums == pytest.approx({f"p{i}": 500.0 for i in range(4)})


def test_rows_stand_for_several(spark):
    frame = psu_frame(spark, {1: 40}).withColumn("rows", 1 + F.col("psu") % 5)
    single = frame.withColumn("rows", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    one = {r["psu"]: r["w"] for r in d.post_stratify(frame, DESIGN, "rows").collect()}
    other = {r["psu"]: r["w"] for r in d.post_stratify(single, DESIGN).collect()}
    assert one == pytest.approx(other)


def test_population_must_be_constant(spark):
    frame = psu_frame(spark, {1: 10}).withColumn("pop", F.col("psu").cast("double"))
    with pytest.raises(Exception, match="must be constant"):
        d.post_stratify(frame, DESIGN)


@pytest.mark.parametrize(
    ("column", "value", "error"),
    [("post", None, "post-stratum"), ("pop", None, "population"), ("weight", 0.0, "no weight"), ("stratum", None, "stratum"), ("psu", None, "PSU")],
)
def test_invalid_designs_are_refused(spark, column, value, error):
    frame = psu_frame(spark, {1: 10})
    hit = F.lit(True) if column == "weight" else F.col("psu") % 10 == 3
    broken = frame.withColumn(column, F.when(hit, F.lit(value).cast(frame.schema[column].dataType)).otherwise(F.col(column)))
    with pytest.raises(Exception, match=error):
        d.post_stratify(broken, DESIGN).collect()


@pytest.mark.parametrize("column", ["stratum", "psu"])
def test_replicates_need_stratum_and_psu(spark, column):
    frame = psu_frame(spark, {1: 10}).withColumn(column, F.expr(f"if(psu % 10 = 3, null, {column})"))
    with pytest.raises(Exception, match="is missing"):
        d.replicate(frame, DESIGN)


@pytest.mark.parametrize("slack", [0.0, 1.0, 6.0, 100.0])
def test_each_replicate_makes_all_draws(spark, slack):
    """Without slack about half of the replicates overshoot and are drawn one by one."""
    sizes = {1: 1, 2: 2, 3: 7, 4: 300}
    got = counts(*d.replicate(psu_frame(spark, sizes), replace(DESIGN, slack=slack)))
    assert {s: g.shape[0] for s, g in got.items()} == sizes
    for stratum, grid in got.items():
        assert np.allclose(grid, np.round(grid))
        assert np.allclose(grid.sum(axis=0), max(sizes[stratum] - 1, 1))
    assert np.all(got[1] == 1)


@pytest.mark.parametrize("slack", [0.0, 1.0, 6.0])
def test_counts_have_the_distribution_of_draws(spark, slack):
    n, reps = 200, 200
    grid = counts(*d.replicate(psu_frame(spark, {1: n}), replace(DESIGN, replicates=reps, slack=slack)))[1].round().astype(int)
    cells = Counter(grid.ravel().tolist())
    chi = 0.0
    for k in range(5):
        expected = n * reps * comb(n - 1, k) * (1 / n) ** k * (1 - 1 / n) ** (n - 1 - k)
        chi += (cells[k] - expected) ** 2 / expected
    assert chi < 25, chi
    # A PSU's counts vary over replicates like draws do, and PSUs do not move together.
    assert grid.var(axis=1).mean() == pytest.approx((n - 1) / n * (1 - 1 / n), rel=0.05)
    correlation = np.corrcoef(grid)[np.triu_indices(n, 1)]
    assert abs(correlation.mean() + 1 / (n - 1)) < 0.003 and correlation.std() == pytest.approx(reps**-0.5, rel=0.1)
    between = np.corrcoef(grid.T)[np.triu_indices(reps, 1)]
    assert abs(between.mean()) < 0.003 and between.std() == pytest.approx(n**-0.5, rel=0.1)


def test_variance_of_a_total(spark):
    """Bootstrap variance of a stratum total is n/(n-1) x sum of squared deviations x n/n."""
    n, reps = 400, 300
    frame, replicates = d.replicate(psu_frame(spark, {1: n}), replace(DESIGN, replicates=reps))
    grid = counts(frame, replicates)[1] * n / (n - 1)
    y = np.sqrt(np.arange(n))
    totals = y @ grid
    expected = n / (n - 1) * ((y - y.mean()) ** 2).sum()
    assert totals.var(ddof=1) == pytest.approx(expected, rel=0.25)
    assert totals.mean() == pytest.approx(y.sum(), rel=0.01)


def test_same_draws_however_the_rows_are_spread(spark):
    frame = psu_frame(spark, {1: 90, 2: 150})
    first = counts(*d.replicate(frame, DESIGN))
    spread = counts(*d.replicate(frame.repartition(13, "psu"), DESIGN))
    unbounded = counts(*d.replicate(frame, replace(DESIGN, side_limit=1)))
    other_seed = counts(*d.replicate(frame, replace(DESIGN, seed=1)))
    for stratum in first:
        assert np.array_equal(first[stratum], spread[stratum])
        assert np.array_equal(first[stratum], unbounded[stratum])
        assert not np.array_equal(first[stratum], other_seed[stratum])


def test_text_keys(spark):
    frame = psu_frame(spark, {1: 20, 2: 5}).withColumns(
        {"psu": F.concat(F.lit("q"), F.col("psu")), "stratum": F.concat(F.lit("s"), F.col("stratum"))}
    )
    got = counts(*d.replicate(frame, DESIGN))
    assert np.allclose(got["s1"].sum(axis=0), 19) and np.allclose(got["s2"].sum(axis=0), 4)


def test_few_draws_are_moved(spark):
    """Draws made one by one grow with the square root of the stratum, not with it."""
    frame, n = spark.range(20_000).select(F.lit(1).alias("stratum"), F.col("id").alias("psu")), 20_000
    _, replicates = d.replicate(frame, DESIGN)
    sizes = d.bounded_side(frame.select("stratum", d._bucket(DESIGN)).groupBy("stratum", "_bucket").agg(F.count("*").alias("_n")))
    strata = d._strata(sizes, DESIGN)
    local = d._with_counts(frame, strata, DESIGN)
    fill = d._fills(local, DESIGN).first()["_fill"]
    assert max(fill) < 12 * n**0.5 and min(fill) > 0


def test_numbers_are_dense(spark):
    frame = psu_frame(spark, {1: 40, 2: 17})
    sizes = d.bounded_side(frame.select("stratum", d._bucket(DESIGN)).groupBy("stratum", "_bucket").agg(F.count("*").alias("_n")))
    numbered = d._numbered(frame, sizes, DESIGN).collect()
    for stratum, n in ((1, 40), (2, 17)):
        assert sorted(r["_idx"] for r in numbered if r["stratum"] == stratum) == list(range(1, n + 1))


def test_summary(spark):
    members = psu_frame(spark, {1: 4, 2: 1}).withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(3))))
    got = {r["stratum"]: (r["n_psu"], r["n_rows"]) for r in d.design_summary(members, DESIGN).collect()}
    assert got == {1: (4, 12), 2: (1, 3)}


def test_counts_are_made_once(spark):
    """Sums of counts take them from one call, with no NULL literal among its inputs."""
    design = d.Design(psu="psu", stratum="stratum", replicates=5, buckets=4)
    psus = spark.range(50).selectExpr("id AS psu", "id % 2 AS stratum")
    sizes = psus.select("stratum", d._bucket(design)).groupBy("stratum", "_bucket").agg(F.count("*").alias("_n"))
    counts = d._with_counts(psus, d._strata(d.bounded_side(sizes), design), design)
    for frame in (d._fills(counts, design), d.Replicates(design).unfold(counts.selectExpr("psu", "struct(1D AS scale, _counts AS counts) AS draws"))):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        calls = [line for line in plan.splitlines() if "ArrowEvalPython" in line]
        assert len(calls) == 1 and "null" not in calls[0]
