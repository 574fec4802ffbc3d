"""Linearised variances against dense numpy, against the bootstrap, and under each policy."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from domicilia.operators import design as d
from domicilia.operators import estimate as e
from domicilia.operators.linearise import Linearised

DESIGN = d.Design(psu="psu", stratum="stratum", weight="weight", post="post", population="pop", replicates=0)


@pytest.fixture(scope="module")
def sample(spark):
    """Members of PSUs in four strata, of which the last two have one PSU each; PSUs hold several post-strata."""
    n = 90
    frame = spark.range(3 * n).select(
        (F.col("id") % n).alias("psu"),
        F.expr(f"case when id % {n} = 88 then 8 when id % {n} = 89 then 9 else id % 2 end").alias("stratum"),
        (1.0 + F.col("id") % 4).alias("weight"),
        (F.col("id") % 5).alias("post"),
        F.lit(700.0).alias("pop"),
        F.when(F.col("id") % 13 != 0, F.concat(F.lit("d"), F.col("id") % 3)).alias("domain"),
        (F.col("id") % 7 + F.col("id") % n / 9).alias("x"),
        (F.col("id") * 7 % 4).cast("int").alias("kind"),
    )
    return d.post_stratify(frame, DESIGN).cache()


def dense(rows, values, policy="adjust", post=True):
    """Variance of the sum of `values`, weighted, one for each row of the sample."""
    values = values.astype(float).copy()
    if post:
        for p in rows["post"].unique():
            own = (rows["post"] == p).to_numpy()
            values[own] -= (rows["w"][own] * values[own]).sum() / rows["w"][own].sum()
    z = (rows["w"] * values).groupby([rows["stratum"], rows["psu"]]).sum()
    total, lone, strata = 0.0, 0.0, 0
    for _, own in z.groupby(level=0):
        strata += 1
        if len(own) > 1:
            total += len(own) / (len(own) - 1) * ((own - own.mean()) ** 2).sum()
        else:
            lone += 1
            total += ((own - z.mean()) ** 2).sum() if policy == "adjust" else 0.0
    return total * strata / (strata - lone) if policy == "average" else total


@pytest.mark.parametrize(("policy", "post"), [("adjust", True), ("adjust", False), ("average", True), ("certainty", True)])
def test_totals(sample, policy, post):
    rows = sample.toPandas()
    linear = Linearised(sample, DESIGN, policy=policy, post_stratified=post)
    got = {r["domain"]: r for r in linear.total(sample, ["domain"], {"t": F.col("x"), "n": None}).collect()}
    assert set(got) == {None, "d0", "d1", "d2"}
    for domain, r in got.items():
        inside = (rows["domain"].isna() if domain is None else rows["domain"] == domain).to_numpy()
        assert r["t"] == pytest.approx((rows["w"] * rows["x"])[inside].sum())
        assert r["t_se"] == pytest.approx(dense(rows, np.where(inside, rows["x"], 0), policy, post) ** 0.5, rel=1e-7)
        assert r["n_se"] == pytest.approx(dense(rows, inside, policy, post) ** 0.5, rel=1e-7)


def test_small_and_large_sides(sample):
    small = Linearised(sample, DESIGN).total(sample, ["domain"], {"t": F.col("x")}).collect()
    large = Linearised(sample, replace(DESIGN, side_limit=1)).total(sample, ["domain"], {"t": F.col("x")}).collect()
    assert {r["domain"]: r["t_se"] for r in small} == pytest.approx({r["domain"]: r["t_se"] for r in large})


def test_means_and_roll_up(sample):
    rows = sample.toPandas()
    linear = Linearised(sample, DESIGN)
    got = {r["domain"]: r for r in linear.mean(sample.filter("domain IS NOT NULL"), ["domain"], {"m": F.col("x")}, fill="all").collect()}
    for domain, r in got.items():
        inside = (~rows["domain"].isna() if domain == "all" else rows["domain"] == domain).to_numpy()
        size = rows["w"][inside].sum()
        mean = (rows["w"] * rows["x"])[inside].sum() / size
        residual = np.where(inside, (rows["x"] - mean) / size, 0)
        assert r["m"] == pytest.approx(mean) and r["m_se"] == pytest.approx(dense(rows, residual) ** 0.5, rel=1e-7)
    assert set(got) == {"all", "d0", "d1", "d2"}


def test_shares(sample):
    rows = sample.toPandas()
    got = Linearised(sample, DESIGN).share(sample, ["domain"], "kind", vartype=["se", "ci"]).collect()
    assert len(got) == rows.groupby(["domain", "kind"], dropna=False).ngroups
    for r in got:
        outer = (rows["domain"].isna() if r["domain"] is None else rows["domain"] == r["domain"]).to_numpy()
        size = rows["w"][outer].sum()
        inner = outer & (rows["kind"] == r["kind"]).to_numpy()
        share = rows["w"][inner].sum() / size
        residual = np.where(outer, (inner - share) / size, 0)
        assert r["pct"] == pytest.approx(share) and r["pct_se"] == pytest.approx(dense(rows, residual) ** 0.5, rel=1e-7)
        assert r["pct_low"] < r["pct"] < r["pct_upp"]


def test_unknown_values_and_single_total(sample):
    unknown = F.when(F.col("psu") != 3, F.col("x"))
    row = Linearised(sample, DESIGN).total(sample, [], {"t": unknown, "n": None}, vartype=["se", "cv"]).first()
    assert row["t"] is None and row["t_se"] is None and row["t_cv"] is None
    # Post-strata meet their populations, so the number of rows is known.
    assert row["n"] == pytest.approx(3500.0) and row["n_se"] == pytest.approx(0.0, abs=1e-4)


def test_single_psus_can_be_refused(sample):
    with pytest.raises(ValueError, match="single PSU"):
        Linearised(sample, DESIGN, policy="fail").total(sample, [], {"n": None})
    with pytest.raises(ValueError, match="no such policy"):
        Linearised(sample, DESIGN, policy="other")


def test_rows_stand_for_several(spark, sample):
    once = sample.groupBy("stratum", "psu", "post").agg(F.max("w").alias("w"), F.count("*").alias("rows"))
    # Equal weights inside a PSU and post-stratum, as rows of a dwelling have.
    full = sample.drop("w").join(once, ["stratum", "psu", "post"])
    one = Linearised(once, DESIGN, rows="rows").total(full, ["domain"], {"n": None}).collect()
    other = Linearised(full, DESIGN).total(full, ["domain"], {"n": None}).collect()
    assert {r["domain"]: r["n_se"] for r in one} == pytest.approx({r["domain"]: r["n_se"] for r in other})


def test_agrees_with_the_bootstrap(spark):
    design = replace(DESIGN, replicates=400, buckets=4)
    frame = spark.range(600).select(
        F.col("id").alias("psu"),
        (F.col("id") % 3).alias("stratum"),
        (1.0 + F.col("id") % 4).alias("weight"),
        (F.col("id") % 2).alias("post"),
        F.lit(900.0).alias("pop"),
        (F.col("id") % 5).alias("domain"),
        (F.col("id") * 37 % 101 / 10).alias("x"),
    )
    weighted, replicates = d.replicate(d.post_stratify(frame, design), design)
    boot = {r["domain"]: r["t_se"] for r in e.survey_total(weighted, ["domain"], {"t": F.col("x")}, replicates).collect()}
    again = e.summarise(e.reposted_totals(weighted, weighted, ["domain"], {"t": F.col("x")}, replicates), ["domain"], ["t"], design, ["se"])
    reposted = {r["domain"]: r["t_se"] for r in again.collect()}
    for post, other in ((False, boot), (True, reposted)):
        linear = Linearised(weighted, design, post_stratified=post).total(weighted, ["domain"], {"t": F.col("x")})
        assert {r["domain"]: r["t_se"] for r in linear.collect()} == pytest.approx(other, rel=0.15)


# Degrees of freedom of replicate weights


def weights_of(spark, rows, size):
    """A frame with given numbers of draws."""
    data = [(k, dom, (1.5, [0, *draws]), 1.0) for k, (dom, draws) in enumerate(rows)]
    schema = f"psu long, domain string, draws {d.DRAWS}, w double"
    return spark.createDataFrame(data, schema).repartition(3), d.Replicates(replace(DESIGN, replicates=size))


def test_rank_of_dependent_replicates(spark):
    rng = np.random.default_rng(2)
    free = rng.integers(0, 4, (40, 5))
    draws = np.hstack([free, free[:, :2] + free[:, 2:4], free[:, :1]])  # three of eight follow from the others
    rows = [("a" if k % 4 else None, v) for k, v in enumerate(draws.tolist())] + [("two", draws[0].tolist()), ("two", draws[1].tolist()), ("none", [0] * 8)]
    frame, replicates = weights_of(spark, rows, 8)
    assert e.degrees_of_freedom(frame, replicates).first()["df"] == np.linalg.matrix_rank(draws) - 1 == 4
    got = {r["domain"]: r["df"] for r in e.degrees_of_freedom(frame, replicates, ["domain"]).collect()}
    assert got == {"a": 4, None: 4, "two": 1, "none": 0}


def test_intervals_use_the_domains_own(spark):
    from domicilia.functions.student import t_quantile

    rng = np.random.default_rng(4)
    rows = [("many", rng.integers(0, 4, 6).tolist()) for _ in range(30)] + [("two", [1, 0, 2, 0, 1, 1]), ("two", [0, 1, 1, 3, 0, 1])]
    rows += [("one", [1, 0, 1, 0, 2, 1])]
    frame, replicates = weights_of(spark, rows, 6)
    df = e.degrees_of_freedom(frame, replicates, ["domain"])
    got = {r["domain"]: r for r in e.survey_total(frame, ["domain"], {"n": None}, replicates, ["se", "ci"], df=df).collect()}
    for domain, k in (("many", 5), ("two", 1)):
        r = got[domain]
        assert r["n_upp"] - r["n"] == pytest.approx(t_quantile(0.95, k) * r["n_se"])
    assert got["one"]["n_low"] is None and got["one"]["n_se"] is not None
    assert "_t" not in e.survey_total(frame, ["domain"], {"n": None}, replicates, ["ci"], df=df).columns


def test_bootstrap_weights_have_full_rank(spark):
    design = replace(DESIGN, replicates=12, buckets=4)
    frame = spark.range(50).select(F.col("id").alias("psu"), (F.col("id") % 3).alias("stratum"), F.lit(1.0).alias("w"))
    weighted, replicates = d.replicate(frame, design)
    assert e.degrees_of_freedom(weighted, replicates).first()["df"] == 11
    wide = d.factors(weighted, replicates).toPandas().pivot(index=["stratum", "psu"], columns="rep", values="factor")
    few = weighted.filter("psu < 5")
    rank = np.linalg.matrix_rank(wide[wide.index.get_level_values(1) < 5].to_numpy())
    assert e.degrees_of_freedom(few, replicates).first()["df"] == rank - 1


def test_sample_is_made_once(spark):
    """Shares and their errors come from stored tables, not from the sample made again for each sum."""
    rows = spark.range(60).selectExpr("id AS psu", "id % 3 AS stratum", "id % 4 AS post", "1.0D + id % 5 AS w", "id % 2 AS g", "id % 7 AS level")
    design = d.Design(psu="psu", stratum="stratum", post="post", replicates=0)
    found = Linearised(rows, design).share(rows, ["g"], "level", vartype=["se"])
    assert "Range (" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.groupBy("g").sum("pct").filter("abs(`sum(pct)` - 1) > 1e-9").isEmpty()
