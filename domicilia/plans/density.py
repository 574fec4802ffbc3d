"""Occupied area and population densities."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domicilia.functions import codes
from domicilia.functions.columns import member, split_two
from domicilia.operators.aggregates import complete, complete_open, round_numeric, spread, spread_open
from domicilia.operators.estimate import survey_total
from domicilia.operators.joins import join_to_unique
from domicilia.operators.prefix import running_total
from domicilia.plans.deficit import region_name
from domicilia.plans.survey import Survey


def area_by_year(areas: DataFrame, years: Sequence[int]) -> DataFrame:
    """Occupied area by region and year; years without polygons count zero."""
    sums = areas.groupBy("ra_cira", "ano").agg(F.sum("area_1").alias("n"))
    return complete(sums, ["ra_cira"], "ano", "n", years)


def area_by_any_year(areas: DataFrame) -> DataFrame:
    """Occupied area by region and every year that occurs for some region."""
    sums = areas.groupBy("ra_cira", "ano").agg(F.sum("area_1").alias("n"))
    return complete_open(sums, ["ra_cira"], "ano", "n")


def area_by_any_year_wide(areas: DataFrame) -> DataFrame:
    """The same with a column for each year."""
    sums = areas.groupBy("ra_cira", "ano").agg(F.sum("area_1").alias("n"))
    return spread_open(sums, ["ra_cira"], "ano", "n", 0.0)


def occupied_area(areas: DataFrame) -> DataFrame:
    """Area occupied in all years."""
    return areas.groupBy("ra_cira").agg(F.coalesce(F.sum("area_1"), F.lit(0.0)).alias("areaocupada"))


def occupied_area_running(areas: DataFrame, years: Sequence[int]) -> DataFrame:
    return running_total(area_by_year(areas, years), "n", ["ra_cira"], ["ano"], "csum")


def occupied_area_cumulative(areas: DataFrame, years: Sequence[int]) -> DataFrame:
    """Area occupied up to each year, one column per year."""
    return spread(occupied_area_running(areas, years), ["ra_cira"], "ano", "csum", [str(y) for y in years])


def population_by_region(survey: Survey) -> DataFrame:
    """Everybody, by region. Members are counted per dwelling before the replicates."""
    members = survey.counted.groupBy("A01nficha", "A01ra").agg(F.count("*").alias("n"))
    dwellings = survey.by_resident.frame.select("A01setor", "A01nficha", "w", "draws")
    totals = survey_total(members.join(dwellings, "A01nficha"), ["A01ra"], {"n": F.col("n")}, survey.by_resident.replicates, ["ci"])
    return region_name(totals)


def dwelling_type_by_region(survey: Survey) -> DataFrame:
    """Dwellings by type, wide, in whole numbers."""
    survey = survey.point
    kind = F.when(member(F.col("B02"), [1, 3, 4]), codes.FLAT).when(F.col("B02") == 2, codes.HOUSE)
    heads = survey.residents.filter(F.col("E02") == 1).select("A01nficha", "A01ra")
    dwellings = survey.by_resident.frame.select("A01setor", "A01nficha", kind.alias("tipo"), "w", "draws")
    joined = join_to_unique(heads, dwellings, ["A01nficha"], "inner", survey.hot)
    totals = survey_total(joined, ["A01ra", "tipo"], {"n": None}, survey.by_resident.replicates, [])
    return round_numeric(spread(totals, ["A01ra"], "tipo", "n", [codes.FLAT, codes.HOUSE]), 0)


def density_table(survey: Survey, areas: DataFrame, polygons: DataFrame) -> DataFrame:
    """People per occupied hectare and per hectare of the region, with dwelling types."""
    as_text = F.col("A01ra").cast("string").alias("ra_cira")
    area = occupied_area(areas).withColumn("ra_cira", F.col("ra_cira").cast("string"))
    people = population_by_region(survey.point).select(as_text, "RA_nome", "n")
    types = dwelling_type_by_region(survey).select(as_text, codes.FLAT, codes.HOUSE)
    table = area.join(people, "ra_cira", "left").join(polygons.select("ra_cira", "ra_codigo", "area"), "ra_cira", "left")
    ratios = table.withColumns(
        {
            "densidade urbana": F.try_divide("n", "areaocupada"),
            "densidade demográfica": F.try_divide("n", "area"),
        }
    )
    return round_numeric(ratios, 2).join(types, "ra_cira", "left")


def with_code_suffix(polygons: DataFrame) -> DataFrame:
    before, after = split_two(F.col("ra_codigo"), "-")
    return polygons.withColumns({"ant": before, "code": after})
