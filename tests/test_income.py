"""Incomes and the price inflator."""

import pytest
from pyspark.sql import functions as F

from domicilia.functions import codes
from domicilia.plans import income

PERSON = "A01nficha long, E02 int, G16 double, G19 double, G201 double, G202 double, G203 double, G204 double"


def test_sentinels_differ_between_the_two_incomes(spark):
    rows = [(1, 1, 100.0, 66666.0, 88888.0, 99999.0, 0.0, 5.0), (2, 1, 88888.0, 1.0, 0.0, 0.0, 0.0, 0.0)]
    people = spark.createDataFrame(rows, PERSON)
    own = {r[0]: r[1] for r in people.select("A01nficha", income.individual_income().alias("x")).collect()}
    assert own == {1: None, 2: None}
    shared = {r["A01nficha"]: r["renda_dom"] for r in income.household_income(people).collect()}
    assert shared == {1: 105.0, 2: None}


def test_household_income(spark):
    rows = [
        (1, 1, 100.0, 0.0, 0.0, 0.0, 0.0, 0.0),
        (1, None, 50.0, 0.0, 0.0, 0.0, 0.0, 0.0),
        (1, 17, 77777.0, 0.0, 0.0, 0.0, 0.0, 0.0),
        (2, 1, 10.0, 0.0, 0.0, 0.0, 0.0, 0.0),
        (2, 3, 77777.0, 0.0, 0.0, 0.0, 0.0, 0.0),
        (3, 18, 10.0, 0.0, 0.0, 0.0, 0.0, 0.0),
    ]
    got = {r[0]: tuple(r)[1:] for r in income.household_income(spark.createDataFrame(rows, PERSON)).collect()}
    assert got == {1: (150.0, 2, 75.0), 2: (None, 2, None)}


def index(spark, change):
    rows = [
        (codes.GENERAL_INDEX, f"2018{m:02d}", f"{codes.MONTHS[m]} 2018", change(m)) for m in range(2, 12)
    ]
    return spark.createDataFrame(rows, "classe int, ref string, ref1 string, valor double")


def test_inflator(spark):
    got = {r["mes"]: r["inflator"] for r in income.price_inflator(index(spark, lambda m: 1.0)).collect()}
    assert len(got) == 8 and got["julho"] == 1
    assert got["junho"] == pytest.approx(1.01**2) and got["março"] == pytest.approx(1.01**5)
    assert got["agosto"] == pytest.approx(1.01**-2) and got["outubro"] == pytest.approx(1.01**-4)


def test_inflator_uses_each_month(spark):
    got = {r["mes"]: r["inflator"] for r in income.price_inflator(index(spark, lambda m: float(m))).collect()}
    assert got["maio"] == pytest.approx(1.07 * 1.06 * 1.05)
    assert got["setembro"] == pytest.approx(1 / (1.07 * 1.08 * 1.09))


def test_periods(spark):
    got = income.index_periods(index(spark, lambda m: 0.0)).filter("ref = '201810'").select("mes_n", "mes").first()
    assert tuple(got) == (0.0, "outubro")


def test_inflators_are_one_row_per_month(spark):
    both = index(spark, lambda m: 1.0).unionByName(index(spark, lambda m: 2.0).withColumn("classe", F.lit(codes.RENT_INDEX)))
    rows = income.inflators(both).collect()
    assert len(rows) == 8 and all(r["inflator_geral"] is not None and r["inflator_aluguel"] is not None for r in rows)
