"""Whole pipelines: invariants on the benchmark tables, and a plain computation with a hot household."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from domicilia.functions import codes
from domicilia.operators import joins
from domicilia.operators.design import Design
from domicilia.operators.estimate import survey_total
from domicilia.plans import deficit, demand, density
from domicilia.plans.registry import DESIGN, open_survey
from domicilia.plans.survey import Survey
from domicilia.sources import standin


@pytest.fixture(scope="module")
def survey(spark, sf_dir):
    return open_survey(spark, sf_dir).materialize()


def test_components_and_any_of_them(survey):
    totals = {r["comp"]: r["n"] for r in deficit.component_totals(survey).collect()}
    total = deficit.deficit_total(survey).filter("RA_nome = 'DF'").first()["deficit_habit"]
    assert max(totals.values()) <= total <= sum(totals.values())
    by_region = deficit.deficit_total(survey).filter("RA_nome <> 'DF'").toPandas()["deficit_habit"].sum()
    assert by_region == pytest.approx(total)


def test_all_combinations_occur(spark):
    """Checked one scale up: with few dwellings one combination has none visited in an indexed month."""
    heads = open_survey(spark, "/root/testdata/sf0.01").heads
    assert heads.select(*deficit.COMPONENTS).distinct().count() == 16


def test_labels_partition_the_heads(survey):
    heads = survey.heads.agg(F.sum("w")).first()[0]
    for legacy in (False, True):
        labelled = deficit.composition_label(survey.heads, legacy)
        assert labelled.filter("composicao is null").count() == 0
        in_deficit = deficit.deficit_composition(survey, legacy).agg(F.sum("n")).first()[0]
        none = labelled.filter(F.col("composicao") == codes.NO_COMPONENT).agg(F.sum("w")).first()[0]
        assert in_deficit + none == pytest.approx(heads)


def test_shares_and_rates_agree(survey):
    rate = deficit.deficit_rate(survey).filter("RA_nome <> 'DF'").toPandas().set_index("RA_nome")["deficit_habit"]
    share = deficit.deficit_share(survey).filter("deficit_habit = 1").toPandas().set_index("RA_nome")["n"]
    assert rate.to_dict() == pytest.approx(share.to_dict())


def test_tables_agree_with_totals(survey):
    table = deficit.deficit_final_table(survey).filter("RA_nome = 'DF'").first()
    assert table["adens"] == pytest.approx(deficit.overcrowding(survey).filter("RA_nome = 'DF'").first()["adens"])
    long = deficit.deficit_components_long(survey).filter("RA_nome = 'DF'").toPandas().set_index("componente")["n"]
    assert long["onus_aluguel"] == pytest.approx(table["onus_aluguel"])


def test_headship_rate_and_demand(survey):
    rates = demand.headship_rate(survey).toPandas()
    assert len(rates) == 3 and rates["taxadechefia"].between(0, 1).all()
    cells = demand.dhde_cells(survey).toPandas()
    by_region = demand.dhde_by_region(survey).toPandas()
    assert by_region["dhde"].sum() == pytest.approx(cells["dhde"].sum())
    bands = demand.dhde_by_income_band(survey).toPandas()
    assert len(bands) == 5 * by_region.shape[0] and bands["dhde"].sum() == pytest.approx(cells["dhde"].sum())


def test_population_meets_the_post_strata(survey, spark, sf_dir):
    known = standin.dwellings(spark, sf_dir).groupBy("POS_ESTRATO").agg(F.max("POP_AJUSTADA_PROJ").alias("p"))
    population = density.population_by_region(survey).agg(F.sum("n")).first()[0]
    assert population == pytest.approx(known.agg(F.sum("p")).first()[0])


def test_cumulative_area_ends_at_the_total(spark, sf_dir):
    areas = standin.occupied_areas(spark, sf_dir)
    running = density.occupied_area_cumulative(areas, standin.OCCUPIED_YEARS).toPandas().set_index("ra_cira")
    total = density.occupied_area(areas).toPandas().set_index("ra_cira")["areaocupada"]
    assert running["2001"].to_dict() == pytest.approx(total.to_dict())
    assert (running.T.diff().dropna().min() >= 0).all()


def test_stored_and_lazy_tables_agree(survey, spark, sf_dir):
    key = ["RA_nome", "onus_aluguel", "onus_aluguel_cv"]
    lazy = deficit.rent_burden(open_survey(spark, sf_dir)).toPandas().sort_values("RA_nome")[key]
    stored = deficit.rent_burden(survey).toPandas().sort_values("RA_nome")[key]
    pd.testing.assert_frame_equal(lazy.reset_index(drop=True), stored.reset_index(drop=True))


@pytest.fixture
def hot_people(spark, sf_dir):
    """A third of all residents live in dwelling 3."""
    people = standin.residents(spark, sf_dir)
    guests = people.filter("A01nficha % 2 = 1 and A01ra is not null").withColumns(
        {"A01nficha": F.lit(3).cast("long"), "A01ra": F.lit(4), "E02": F.lit(9)}
    )
    return people.unionByName(guests)


@pytest.mark.parametrize("split", [False, True])
def test_hot_dwelling(spark, sf_dir, hot_people, monkeypatch, split):
    if split:
        monkeypatch.setattr(joins, "HOT_ROWS", 300)
        monkeypatch.setattr(joins, "HOT_FRACTION", 1.0)
    survey = Survey(standin.dwellings(spark, sf_dir), hot_people, standin.price_index(spark, sf_dir), DESIGN)
    assert (survey.hot is not None) == split
    heads = survey_total(survey.dwelling_heads, ["B02"], {"n": None}, survey.by_dwelling.replicates, [])
    people = survey_total(survey.people, ["situacao"], {"n": None}, survey.by_resident.replicates, [])

    hh, pes = standin.dwellings(spark, sf_dir).toPandas(), hot_people.toPandas()
    sample = hh.merge(pes[["A01nficha", "A01ra", "E02"]], on=["A01nficha", "A01ra"], how="left")
    sums = sample.groupby("POS_ESTRATO")["PESO_PRE"].sum()
    sample["w"] = sample["PESO_PRE"] * sample["POP_AJUSTADA_PROJ"] / sample["POS_ESTRATO"].map(sums)
    expected = sample[sample["E02"] == 1].groupby("B02")["w"].sum().to_dict()
    assert heads.toPandas().set_index("B02")["n"].to_dict() == pytest.approx(expected)

    sample = pes[["A01nficha", "E02"]].merge(hh, on="A01nficha")
    sums = sample.groupby("POS_ESTRATO")["PESO_PRE"].sum()
    sample["w"] = sample["PESO_PRE"] * sample["POP_AJUSTADA_PROJ"] / sample["POS_ESTRATO"].map(sums)
    sample["kind"] = np.where(sample["E02"].isna(), "?", np.where(sample["E02"] == 1, codes.HEAD, codes.NOT_HEAD))
    expected = sample.groupby("kind")["w"].sum().to_dict()
    got = people.toPandas().fillna({"situacao": "?"}).set_index("situacao")["n"].to_dict()
    assert got == pytest.approx(expected)


def test_crowding_without_bedrooms(spark):
    from domicilia.plans.survey import dwelling_flags

    cases = {(4, 0): 1, (0, 0): 0, (4, 1): 1, (3, 1): 0, (4, None): 0, (7, 2): 1}
    rows = [(1, 1, 3, 1, 1, 0, n, b) for n, b in cases]
    schema = "B01 int, B02 int, B03 int, B08 int, A01nfamilias int, novo_dom int, A01npessoas int, B12 int"
    got = dwelling_flags(spark.createDataFrame(rows, schema)).collect()
    assert {(r["A01npessoas"], r["B12"]): r["adens"] for r in got} == cases


def test_default_design_uses_fifty_replicates():
    assert Design().replicates == 50


@pytest.mark.parametrize("build", [deficit.deficit_final_table, deficit.rent_burden_share])
def test_heads_are_made_once(spark, build):
    """Estimates that need the heads several times read them from one stored table."""
    found = build(open_survey(spark, "/root/testdata/sf0.001"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "lineitem" not in plan
