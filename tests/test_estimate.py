"""Estimates against a plain computation from the replicate factors."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from domicilia.functions.student import t_quantile
from domicilia.operators import design as d
from domicilia.operators import estimate as e

DESIGN = d.Design(psu="psu", stratum="stratum", weight="weight", post="post", population="pop", replicates=25, buckets=4)


@pytest.fixture(scope="module")
def sample(spark):
    frame = spark.range(120).select(
        (F.col("id") % 3).cast("int").alias("stratum"),
        F.col("id").alias("psu"),
        (1.0 + F.col("id") % 4).alias("weight"),
        (F.col("id") % 2).alias("post"),
        F.lit(700.0).alias("pop"),
        F.when(F.col("id") == 5, "solo").otherwise(F.concat(F.lit("d"), F.col("id") % 5)).alias("domain"),
        (F.col("id") % 7).cast("double").alias("x"),
        F.when(F.col("id") != 11, F.col("id") % 2).alias("flag"),
    )
    return d.replicate(d.post_stratify(frame, DESIGN), DESIGN)


@pytest.fixture(scope="module")
def plain(sample):
    """Person weights per replicate, 0 being the full sample."""
    frame, replicates = sample
    rows = frame.drop("draws").toPandas().set_index("psu")
    wide = d.factors(frame, replicates).toPandas().pivot(index="psu", columns="rep", values="factor")
    wide.insert(0, 0, 1.0)
    return rows, wide.mul(rows["w"], axis=0)


def check(result, key, name, values: pd.DataFrame, digits=1e-9):
    """`values`: one row per domain, one column per replicate."""
    got = result.toPandas().set_index(key)
    df = DESIGN.replicates - 1
    for domain, row in values.iterrows():
        estimate, error = row[0], row.drop(0).std(ddof=1)
        assert got.loc[domain, name] == pytest.approx(estimate, rel=digits)
        assert got.loc[domain, f"{name}_se"] == pytest.approx(error, rel=digits)
        assert got.loc[domain, f"{name}_cv"] == pytest.approx(error / estimate, rel=digits)
        assert got.loc[domain, f"{name}_upp"] == pytest.approx(estimate + t_quantile(0.95, df) * error, rel=digits)
    assert len(got) == len(values)


ALL = ["se", "cv", "ci"]


def test_totals(sample, plain):
    rows, weights = plain
    totals = weights.mul(rows["x"], axis=0).groupby(rows["domain"]).sum()
    check(e.survey_total(sample[0], ["domain"], {"t": F.col("x")}, sample[1], ALL), "domain", "t", totals)
    counts = weights.groupby(rows["domain"]).sum()
    check(e.survey_total(sample[0], ["domain"], {"n": None}, sample[1], ALL), "domain", "n", counts)


def test_roll_up_of_totals_and_means(sample, plain):
    rows, weights = plain
    weighted = weights.mul(rows["x"], axis=0)
    totals = pd.concat([weighted.groupby(rows["domain"]).sum(), weighted.sum().to_frame("all").T])
    check(e.survey_total(sample[0], ["domain"], {"t": F.col("x")}, sample[1], ALL, "all"), "domain", "t", totals)
    sizes = pd.concat([weights.groupby(rows["domain"]).sum(), weights.sum().to_frame("all").T])
    means = (totals / sizes).drop(index="solo")
    result = e.survey_mean(sample[0], ["domain"], {"m": F.col("x")}, sample[1], ALL, "all").filter("domain <> 'solo'")
    check(result, "domain", "m", means)


def test_domain_missing_from_a_replicate_counts_as_zero(sample, plain):
    rows, weights = plain
    totals = e.replicate_totals(sample[0], ["domain"], {"n": None}, sample[1]).filter("domain = 'solo'").collect()
    assert len(totals) == DESIGN.replicates + 1 and min(t["n"] for t in totals) == 0.0
    check(
        e.survey_total(sample[0].filter("domain = 'solo'"), ["domain"], {"n": None}, sample[1], ALL),
        "domain", "n", weights.groupby(rows["domain"]).sum().loc[["solo"]],
    )


def test_shares(sample, plain):
    rows, weights = plain
    rows = rows[rows["domain"] != "solo"]
    cells = weights.loc[rows.index].groupby([rows["domain"], rows["x"]]).sum()
    shares = cells / cells.groupby(level=0).transform("sum")
    frame = sample[0].filter("domain <> 'solo'")
    got = e.survey_share(frame, ["domain"], "x", sample[1], "p", ALL).toPandas().set_index(["domain", "x"])
    for key, row in shares.iterrows():
        assert got.loc[key, "p"] == pytest.approx(row[0])
        assert got.loc[key, "p_se"] == pytest.approx(row.drop(0).std(ddof=1))
    assert got.groupby(level=0)["p"].sum().to_numpy() == pytest.approx(1.0)


def test_unknown_values(sample):
    both = e.survey_total(sample[0], ["stratum"], {"f": F.col("flag")}, sample[1])
    known = e.survey_total(sample[0], ["stratum"], {"f": F.col("flag")}, sample[1], na_rm=True)
    assert {r["stratum"]: r["f"] is None for r in both.collect()} == {0: False, 1: False, 2: True}
    assert all(r["f"] is not None for r in known.collect())


def test_reposted_replicates_meet_the_population(sample):
    frame, replicates = sample
    totals = e.reposted_totals(frame, frame, ["post"], {"n": None}, replicates).collect()
    assert len(totals) == 2 * (DESIGN.replicates + 1)
    assert [t["n"] for t in totals] == pytest.approx([700.0] * len(totals))


def test_whole_sample(sample, plain):
    rows, weights = plain
    got = e.survey_total(sample[0], [], {"n": None, "t": F.col("x")}, sample[1], ["se"]).first()
    assert got["n"] == pytest.approx(weights[0].sum()) and got["t"] == pytest.approx((weights[0] * rows["x"]).sum())
