"""Demographic housing demand: headship rates applied to those not yet heads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domicilia.functions import codes
from domicilia.functions.columns import demand_class
from domicilia.operators.aggregates import complete, spread, strict_sum
from domicilia.operators.estimate import survey_total
from domicilia.plans.deficit import region_name
from domicilia.plans.survey import Survey, profile


def adult_totals(survey: Survey) -> DataFrame:
    """People of 24 to 64 with a known income, by age band and headship."""
    adults = survey.people.filter(F.col("renda_individual_real").isNotNull()).filter(F.col("idade_calculada").between(24, 64))
    return survey_total(adults, ["faixa_idade", "situacao"], {"n": None}, survey.by_resident.replicates, ["ci"])


def headship_rate(survey: Survey) -> DataFrame:
    """Heads among adults of each age band; unknown where a cell is missing."""
    wide = spread(adult_totals(survey.point), ["faixa_idade"], "situacao", "n", [codes.HEAD, codes.NOT_HEAD])
    heads, others = F.col(codes.HEAD), F.col(codes.NOT_HEAD)
    return wide.withColumn("taxadechefia", F.try_divide(heads, heads + others))


CELL = ["RA_nome", "faixa_renda_ind", "faixa_idade", "raca", "genero", "job"]


def eligible_totals(survey: Survey) -> DataFrame:
    """People of 24 to 64 with a known income who are neither head, partner nor code 3."""
    people = profile(region_name(survey.people))
    eligible = people.filter(
        F.col("renda_individual_real").isNotNull()
        & (F.col("idade_calculada") >= 24)
        & (F.col("idade_calculada") < 65)
        & (F.col("E02") != 1)
        & (F.col("E02") != 2)
        & (F.col("E02") != 3)
    )
    return survey_total(eligible, CELL, {"pop": None}, survey.by_resident.replicates, ["ci"])


def dhde_cells(survey: Survey) -> DataFrame:
    """Population, headship rate and demand of each cell; the rates are three rows."""
    rate = headship_rate(survey).select("faixa_idade", "taxadechefia")
    cells = eligible_totals(survey.point).select(*CELL, "pop").join(F.broadcast(rate), "faixa_idade", "left")
    return cells.withColumn("dhde", F.col("pop") * F.col("taxadechefia"))


def dhde_by_region(survey: Survey) -> DataFrame:
    return dhde_cells(survey).groupBy("RA_nome").agg(strict_sum(F.col("pop") * F.col("taxadechefia")).alias("dhde"))


def dhde_by_income_band(survey: Survey) -> DataFrame:
    totals = dhde_cells(survey).groupBy("RA_nome", "faixa_renda_ind").agg(strict_sum(F.col("dhde")).alias("dhde"))
    return complete(totals, ["RA_nome"], "faixa_renda_ind", "dhde", codes.INCOME_BANDS)


def dhde_classes(survey: Survey, polygons: DataFrame) -> DataFrame:
    """Demand class of each region and income band, with the number of its polygon."""
    label = F.col("ra")
    for drawn, name in codes.POLYGON_LABELS.items():
        label = F.when(F.col("ra") == drawn, name).otherwise(label)
    regions = polygons.select(label.alias("RA_nome"), "ra_num")
    joined = dhde_by_income_band(survey).join(regions, "RA_nome", "left")
    return joined.withColumn("cat", demand_class(F.col("dhde")))
