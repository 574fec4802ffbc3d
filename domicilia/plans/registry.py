"""Named queries over the benchmark tables, one per operator or indicator."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from domicilia.functions import codes
from domicilia.functions import columns as c
from domicilia.operators import aggregates as agg
from domicilia.operators import dissolve
from domicilia.operators import estimate as est
from domicilia.operators import joins
from domicilia.operators.design import Design, design_summary, factors, post_strata, post_stratify, replicate
from domicilia.operators.linearise import Linearised
from domicilia.operators.polygons import centroids, edges
from domicilia.plans import deficit, demand, density, income
from domicilia.plans import survey as sv
from domicilia.session import materialize
from domicilia.sources import standin

REPLICATES = 20
DESIGN = Design(replicates=REPLICATES, buckets=16)

Query = Callable[[SparkSession, str], DataFrame]


def rounded(frame: DataFrame, digits: int = 4) -> DataFrame:
    """Doubles rounded for comparison; sums differ in their last bits between engines."""
    doubles = [f.name for f in frame.schema if f.dataType.typeName() == "double"]
    return frame.withColumns({name: F.round(name, digits) for name in doubles})


def open_survey(spark: SparkSession, sf_dir: str, design: Design = DESIGN) -> sv.Survey:
    return sv.Survey(
        standin.dwellings(spark, sf_dir),
        standin.residents(spark, sf_dir),
        standin.price_index(spark, sf_dir),
        design,
        counted=standin.residents(spark, sf_dir, relation=False),
    )


def _indicator(build: Callable[..., DataFrame], digits: int = 4, **options) -> Query:
    return lambda spark, sf_dir: rounded(build(open_survey(spark, sf_dir), **options), digits)


def _dwelling_query(build: Callable[[DataFrame], DataFrame], digits: int = 4) -> Query:
    return lambda spark, sf_dir: rounded(build(standin.dwellings(spark, sf_dir)), digits)


def _resident_query(build: Callable[[DataFrame], DataFrame], relation: bool = True, digits: int = 4) -> Query:
    return lambda spark, sf_dir: rounded(build(standin.residents(spark, sf_dir, relation)), digits)


def _index_query(build: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: rounded(build(standin.price_index(spark, sf_dir)), 8)


# Projection, filters, labels


def project_columns(pes: DataFrame) -> DataFrame:
    return pes.select("A01nficha", "idade_calculada", *agg.column_range(pes, "G201", "G204"))


def rename_columns(hh: DataFrame) -> DataFrame:
    names = {"A01nficha": "ficha", "A01npessoas": "n_pessoas", "A01nfamilias": "n_familias"}
    return hh.select(*names).withColumnsRenamed(names)


def derive_columns(hh: DataFrame) -> DataFrame:
    return hh.select("A01nficha", "PESO_PRE", "B12").withColumns(
        {"count": F.lit(1), "peso_quartos": F.col("PESO_PRE") * F.col("B12")}
    )


def income_individual(pes: DataFrame) -> DataFrame:
    suffixed = {f"{name}_M": value for name, value in income.individual_parts().items()}
    kept = pes.select("A01nficha", "E02", "idade_calculada", *[v.alias(n) for n, v in suffixed.items()])
    return kept.withColumn("renda_individual", c.row_sum([F.col(n) for n in suffixed]))


def filter_not_equal(pes: DataFrame) -> DataFrame:
    return pes.select("A01nficha", "E02").filter((F.col("E02") != 1) & (F.col("E02") != 2) & (F.col("E02") != 3))


def case_labels(hh: DataFrame) -> DataFrame:
    kind = c.first_label(
        [
            ((F.col("B01") == 1) & (F.col("B08") >= 4) & (F.col("B02") != 3), codes.RUSTIC),
            (F.col("B01") == 2, codes.IMPROVISED),
        ]
    )
    return hh.select("A01nficha", kind.alias("domicilio"))


def bin_right_closed(hh: DataFrame) -> DataFrame:
    return hh.select("A01nficha", c.demand_class(F.col("B05") * 10).alias("classe"))


def recode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    polygons = standin.region_polygons(spark, sf_dir)
    return rounded(polygons.select("ra_cira", F.coalesce(c.lookup(F.col("ra"), codes.POLYGON_LABELS), "ra").alias("ra"), "area"))


def label_concat(hh: DataFrame) -> DataFrame:
    totals = deficit.region_name(hh.groupBy("A01ra").agg(F.sum("PESO_PRE").alias("n")))
    return totals.select(c.number_label(F.col("RA_nome"), F.col("n")).alias("rotulo"))


def scalar_casts(hh: DataFrame) -> DataFrame:
    return hh.select(
        "A01nficha",
        F.col("A01ra").cast("string").alias("ra_texto"),
        F.col("POS_ESTRATO").try_cast("double").alias("estrato_numero"),
        F.substring_index("datavisita", "/", 1).try_cast("double").alias("mes_numero"),
    )


def visit_month(hh: DataFrame) -> DataFrame:
    return sv.with_month(hh).select("A01nficha", c.visit_date(F.col("datavisita")).alias("data"), "mes")


# Joins

HOUSEHOLD = ["B01", "B02", "POS_ESTRATO"]


def join_person_household(spark: SparkSession, sf_dir: str) -> DataFrame:
    hh = standin.dwellings(spark, sf_dir).drop("A01ra", "FATOR_PROJ")
    pes = standin.residents(spark, sf_dir)
    hot = joins.hot_keys(standin.residents(spark, sf_dir, relation=False), ["A01nficha"])
    joined = joins.join_to_unique(pes, hh, ["A01nficha"], "left", hot)
    return joined.select("A01nficha", "A01ra", "E02", "idade_calculada", "FATOR_PROJ", *HOUSEHOLD)


def join_household_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    hh, pes = standin.dwellings(spark, sf_dir), standin.residents(spark, sf_dir, relation=False).drop("FATOR_PROJ")
    hot = joins.hot_keys(pes, ["A01nficha", "A01ra"])
    joined = joins.left_join_fan_out(hh, pes, ["A01nficha", "A01ra"], hot)
    return joined.select("A01nficha", "A01ra", *HOUSEHOLD, "FATOR_PROJ", "idade_calculada", "E21")


def join_inflator(spark: SparkSession, sf_dir: str) -> DataFrame:
    hh = sv.with_inflators(standin.dwellings(spark, sf_dir), standin.price_index(spark, sf_dir))
    return rounded(hh.select("A01nficha", "mes", "inflator_geral", "inflator_aluguel"), 8)


def join_household_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    hh = standin.dwellings(spark, sf_dir).select("A01nficha", "A01ra")
    return rounded(hh.join(income.household_income(standin.residents(spark, sf_dir)), "A01nficha", "left"), 8)


def join_null_safe_natural(pes: DataFrame) -> DataFrame:
    keys = ["A01nficha", "E02", "idade_calculada"]
    incomes = pes.select(*keys, income.individual_income().alias("renda_individual"))
    return joins.natural_join_counts(pes.select(*keys), incomes)


def real_income(spark: SparkSession, sf_dir: str) -> DataFrame:
    hh = sv.with_inflators(standin.dwellings(spark, sf_dir), standin.price_index(spark, sf_dir))
    pes = standin.residents(spark, sf_dir, relation=False).select("A01nficha", income.individual_income().alias("renda"))
    hot = joins.hot_keys(pes, ["A01nficha"])
    joined = joins.join_to_unique(pes, hh.select("A01nficha", "inflator_geral"), ["A01nficha"], "left", hot)
    return rounded(joined.withColumn("renda_real", F.col("renda") * F.col("inflator_geral")).drop("inflator_geral"))


# Aggregation, windows, reshape


def strict_sum(pes: DataFrame) -> DataFrame:
    parts = income.individual_parts()
    return pes.groupBy("A01nficha").agg(agg.strict_sum(parts["G16"]).alias("g16"))


def rollup_total(hh: DataFrame) -> DataFrame:
    named = deficit.region_name(hh)
    sums = [F.sum("PESO_PRE").alias("peso"), F.count("*").alias("n")]
    return agg.total_rows(named, ["RA_nome"], [], sums, codes.TOTAL_LABEL)


def window_partition_sum(pes: DataFrame) -> DataFrame:
    rows = pes.select("A01nficha", "E21", "idade_calculada")
    return agg.partition_sum(rows, c.flag(F.col("E21") == 1), ["A01nficha"], "novo_dom")


def order_by_stat(hh: DataFrame) -> DataFrame:
    totals = deficit.region_name(hh).groupBy("RA_nome").agg(F.sum("PESO_PRE").alias("n"))
    return agg.rank_groups(totals, "RA_nome", F.max("n")).orderBy("rank")


def order_by_group_sum(hh: DataFrame) -> DataFrame:
    totals = deficit.region_name(hh).groupBy("RA_nome", "B02").agg(F.sum("PESO_PRE").alias("n"))
    return agg.rank_groups(totals, "RA_nome", -F.sum("n")).orderBy("rank")


def union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    hh = standin.dwellings(spark, sf_dir).select("A01nficha", "A01ra", "B01")
    pes = standin.residents(spark, sf_dir, relation=False).select("E21", "A01ra", "A01nficha")
    return hh.unionByName(pes, allowMissingColumns=True)


def pivot_spread(hh: DataFrame) -> DataFrame:
    totals = hh.groupBy("A01ra", "B02").agg(F.sum("PESO_PRE").alias("n"))
    wide = agg.spread(totals, ["A01ra"], "B02", "n", [1, 2, 3, 4])
    return wide.withColumnsRenamed({str(k): f"b02_{k}" for k in range(1, 5)})


def unpivot_gather(hh: DataFrame) -> DataFrame:
    return agg.gather(hh, ["A01nficha"], ["B08", "B12", "A01npessoas"], "variavel", "valor")


def split_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density.with_code_suffix(standin.region_polygons(spark, sf_dir)).select("ra_codigo", "ant", "code")


# Sample design


def post_stratified(hh: DataFrame) -> DataFrame:
    return post_stratify(hh, DESIGN).select("A01nficha", "POS_ESTRATO", "w")


def bootstrap_factors(hh: DataFrame) -> DataFrame:
    return factors(*replicate(hh.select("A01setor", "A01nficha"), DESIGN))


def bootstrap_lonely_psu(hh: DataFrame) -> DataFrame:
    """A stratum with one PSU keeps factor 1; sums of factors stay at the number of PSUs."""
    own = F.when(F.col("A01nficha") == 0, 1).otherwise(F.col("A01setor"))
    psus = hh.select(own.alias("A01setor"), "A01nficha")
    rows = factors(*replicate(psus, DESIGN))
    square = F.col("factor") * F.col("factor")
    return rows.groupBy("A01setor", "rep").agg(
        F.count("*").alias("n_psu"), F.sum("factor").alias("factor_sum"), F.sum(square).alias("factor_squares")
    )


def _heads(survey: sv.Survey) -> DataFrame:
    return deficit.region_name(survey.dwelling_heads)


def _with_lonely(frame: DataFrame) -> DataFrame:
    """Every 500th dwelling alone in a stratum of its own."""
    alone = F.col("A01nficha") % 500 == 0
    return frame.withColumn("A01setor", F.when(alone, -F.col("A01nficha") - 1).otherwise(F.col("A01setor")))


def _linearised(survey: sv.Survey) -> tuple[Linearised, DataFrame]:
    survey = survey.point
    sample = _with_lonely(survey.by_dwelling.frame)
    return Linearised(sample, survey.design, rows="_rows"), deficit.region_name(_with_lonely(survey.dwelling_heads))


def linearised_total(survey: sv.Survey) -> DataFrame:
    linear, heads = _linearised(survey)
    measures = {"pessoas": F.col("A01npessoas"), "adens": F.col("adens")}
    return linear.total(heads, ["RA_nome"], measures, vartype=["se", "cv"], fill=codes.TOTAL_LABEL)


def linearised_mean(survey: sv.Survey) -> DataFrame:
    linear, heads = _linearised(survey)
    return linear.mean(heads, ["RA_nome"], {"adens": F.col("adens")}, vartype=["se"], fill=codes.TOTAL_LABEL)


def linearised_share(survey: sv.Survey) -> DataFrame:
    linear, heads = _linearised(survey)
    return linear.share(heads, ["RA_nome"], "B02", vartype=["se"])


def linearised_policies(survey: sv.Survey) -> DataFrame:
    """Variance of one total under each policy for strata of a single PSU."""
    linear, heads = _linearised(survey)
    found = [
        replace(linear, policy=policy).total(heads, [], {"adens": F.col("adens")}).withColumn("regra", F.lit(policy))
        for policy in ("adjust", "average", "remove")
    ]
    return reduce(DataFrame.unionByName, found)


def survey_degrees_of_freedom(survey: sv.Survey) -> DataFrame:
    return est.degrees_of_freedom(_heads(survey), survey.by_dwelling.replicates, ["RA_nome"])


def survey_total_ci_design(survey: sv.Survey) -> DataFrame:
    """Intervals with the degrees of freedom of each region's own replicate weights."""
    heads, replicates = _heads(survey), survey.by_dwelling.replicates
    df = est.degrees_of_freedom(heads, replicates, ["RA_nome"])
    return est.survey_total(heads, ["RA_nome"], {"quartos": F.col("B12")}, replicates, ["ci"], df=df)


def survey_domain_total(survey: sv.Survey) -> DataFrame:
    domain = _heads(survey).filter((F.col("B03") == 3) & (F.col("B12") == 0) & (F.col("B06") == 88))
    return est.survey_total(domain, ["A01setor"], {"n": None}, survey.by_dwelling.replicates, ["se"])


def survey_total(survey: sv.Survey) -> DataFrame:
    return est.survey_total(_heads(survey), ["RA_nome"], {"pessoas": F.col("A01npessoas")}, survey.by_dwelling.replicates, ["se"])


def survey_total_kind(survey: sv.Survey, vartype: str) -> DataFrame:
    return est.survey_total(_heads(survey), ["RA_nome"], {"quartos": F.col("B12")}, survey.by_dwelling.replicates, [vartype])


def survey_total_strict(survey: sv.Survey) -> DataFrame:
    """An unknown rent makes the total unknown; skipped on request."""
    heads = _heads(survey)
    kept = est.survey_total(heads, ["A01setor", "B08"], {"aluguel": F.col("B05")}, survey.by_dwelling.replicates, ["se"])
    skipped = est.survey_total(heads, ["A01setor", "B08"], {"aluguel_conhecido": F.col("B05")}, survey.by_dwelling.replicates, ["se"], na_rm=True)
    return kept.join(skipped, ["A01setor", "B08"])


def survey_count(survey: sv.Survey) -> DataFrame:
    return est.survey_total(_heads(survey), ["RA_nome", "B02"], {"n": None}, survey.by_dwelling.replicates, ["ci"])


def survey_mean(survey: sv.Survey) -> DataFrame:
    measures = {"pessoas": F.col("A01npessoas"), "adens": F.col("adens")}
    return est.survey_mean(_heads(survey), ["RA_nome"], measures, survey.by_dwelling.replicates, ["se", "cv"])


def survey_share(survey: sv.Survey) -> DataFrame:
    return est.survey_share(_heads(survey), ["RA_nome"], "B02", survey.by_dwelling.replicates, "pct", ["se", "ci"])


def survey_multi(survey: sv.Survey) -> DataFrame:
    measures = {"n": None, "pessoas": F.col("A01npessoas"), "quartos": F.col("B12"), "rust": F.col("dom_rust")}
    return est.survey_total(_heads(survey), ["RA_nome"], measures, survey.by_dwelling.replicates, ["se", "cv"])


def survey_rollup(survey: sv.Survey) -> DataFrame:
    return est.survey_total(_heads(survey), ["RA_nome", "B02"], {"n": None}, survey.by_dwelling.replicates, ["se"], codes.TOTAL_LABEL)


def survey_repost(survey: sv.Survey) -> DataFrame:
    sample = survey.by_dwelling
    totals = est.reposted_totals(_heads(survey), sample.frame, ["RA_nome"], {"n": None}, sample.replicates, rows="_rows")
    return est.summarise(totals, ["RA_nome"], ["n"], survey.design, ["se"])


# Groups of people


def profile_gender_race(pes: DataFrame) -> DataFrame:
    return sv.profile(pes).groupBy("genero", "raca").agg(F.count("*").alias("n"))


def profile_job(pes: DataFrame) -> DataFrame:
    return sv.profile(pes).select("A01nficha", "idade_calculada", "job")


def age_bands(pes: DataFrame) -> DataFrame:
    kind = F.when(F.col("E02") == 1, codes.HEAD).when(F.col("E02") != 1, codes.NOT_HEAD)
    return pes.select("A01nficha", c.age_band(F.col("idade_calculada")).alias("faixa_idade"), kind.alias("situacao"))


def income_bands(pes: DataFrame) -> DataFrame:
    return pes.select("A01nficha", c.income_band(income.individual_income()).alias("faixa_renda_ind"))


def _demand_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(demand.dhde_classes(open_survey(spark, sf_dir), standin.region_polygons(spark, sf_dir)))


def _areas(build: Callable[..., DataFrame], spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(build(standin.occupied_areas(spark, sf_dir), standin.OCCUPIED_YEARS))


def _occupied_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(density.occupied_area(standin.occupied_areas(spark, sf_dir)))


def _density(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas, polygons = standin.occupied_areas(spark, sf_dir), standin.region_polygons(spark, sf_dir)
    return density.density_table(open_survey(spark, sf_dir), areas, polygons)


def _with_rings(borders: DataFrame, key: str) -> DataFrame:
    """Area, perimeter and number of edges of borders, with the rings they make and the holes among these."""
    borders = materialize(borders)
    rings = dissolve.chain(borders, [key])
    # The rings' own vertices must give the area again.
    counted = rings.groupBy(key).agg(
        F.count("*").alias("n_vertices"), F.countDistinct("ring").alias("n_rings"), F.countDistinct(F.when(F.col("hole"), F.col("ring"))).alias("n_holes")
    )
    area = dissolve.measures(edges(rings.withColumnRenamed(key, "poly_id")), ["poly_id"]).select(F.col("poly_id").alias(key), F.col("area").alias("ring_area"))
    return dissolve.measures(borders, [key]).join(counted, key).join(area, key)


def dissolved_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    vertices, regions = standin.parcels(spark, sf_dir)
    found = _with_rings(dissolve.boundaries(vertices, regions, "ra_cira"), "ra_cira")
    return rounded(found.select("ra_cira", "area", "perimeter", "n_edges", "n_vertices", "ring_area"))


def repaired_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _with_rings(dissolve.repaired(standin.sketches(spark, sf_dir)), "poly_id")
    return rounded(found.drop("perimeter", "n_edges"))


def _profile_hierarchies(survey: sv.Survey) -> DataFrame:
    parts = [
        deficit.profile_hierarchy(survey, name).withColumn("componente", F.lit(name)) for name in deficit.COMPONENTS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


QUERIES: dict[str, Query] = {
    # sources
    "index_extract": _index_query(lambda index: index),
    "recode_region": _dwelling_query(lambda hh: deficit.region_name(hh).select("A01nficha", "A01ra", "RA_nome")),
    "recode_sector": _dwelling_query(
        lambda hh: hh.select("A01nficha", "A01setor", c.lookup(F.col("A01setor"), codes.SECTORS).alias("ra_setor"))
    ),
    # projection, filters, labels
    "project_columns": _resident_query(project_columns, relation=False),
    "rename_columns": _dwelling_query(rename_columns),
    "derive_columns": _dwelling_query(derive_columns),
    "round_numeric": _dwelling_query(lambda hh: agg.round_numeric(hh.select("A01nficha", "B05"), 0)),
    "filter_heads": _resident_query(lambda pes: pes.filter(F.col("E02") == 1).select("A01nficha", "E03", "E04")),
    "filter_age_range": _resident_query(
        lambda pes: pes.filter(F.col("idade_calculada").between(24, 64)).select("A01nficha", "idade_calculada"), False
    ),
    "filter_not_in": _resident_query(
        lambda pes: pes.filter(~c.member(F.col("E02"), codes.DOMESTIC_STAFF)).select("A01nficha", "E02", "G16")
    ),
    "filter_not_null": _dwelling_query(lambda hh: hh.filter(F.col("B05").isNotNull()).select("A01nficha", "B05")),
    "filter_not_equal": _resident_query(filter_not_equal),
    "case_labels": _dwelling_query(case_labels),
    "bin_right_closed": _dwelling_query(bin_right_closed),
    "recode_labels": recode_labels,
    "scalar_strings": _index_query(lambda index: income.index_periods(index).select("classe", "ref", "mes_n", "mes")),
    "scalar_casts": _dwelling_query(scalar_casts),
    "visit_month": _dwelling_query(visit_month),
    "label_concat": _dwelling_query(label_concat),
    # joins
    "join_person_household": join_person_household,
    "join_household_person": join_household_person,
    "join_inflator": join_inflator,
    "join_household_income": join_household_income,
    "join_null_safe_natural": _resident_query(join_null_safe_natural),
    # aggregation
    "group_sum": _dwelling_query(lambda hh: hh.groupBy("POS_ESTRATO", "B01").agg(F.sum("PESO_PRE").alias("peso"))),
    "strict_sum": _resident_query(strict_sum, relation=False),
    "dissolve_sum": lambda spark, sf_dir: rounded(
        standin.occupied_areas(spark, sf_dir).groupBy("ra_cira", "ano").agg(F.sum("area_1").alias("n"))
    ),
    "poststratum_population": _dwelling_query(lambda hh: post_strata(hh, DESIGN)),
    "distinct_rows": _resident_query(lambda pes: pes.select("A01ra", "E03", "E04", "G05", "G08").distinct(), False),
    "rollup_total": _dwelling_query(rollup_total),
    # windows, order, sets, reshape
    "window_partition_sum": _resident_query(window_partition_sum, relation=False),
    "running_product": _index_query(lambda index: income.running_product(index).select("classe", "ref", "produto")),
    "running_sum": partial(_areas, density.occupied_area_running),
    "order_by_stat": _dwelling_query(order_by_stat),
    "order_by_group_sum": _dwelling_query(order_by_group_sum),
    "union_by_name": union_by_name,
    "pivot_spread": _dwelling_query(pivot_spread),
    "unpivot_gather": _dwelling_query(unpivot_gather),
    "pivot_complete_zero": partial(_areas, density.area_by_year),
    "complete_open_keys": lambda spark, sf_dir: rounded(density.area_by_any_year(standin.occupied_areas(spark, sf_dir))),
    "pivot_open_keys": lambda spark, sf_dir: rounded(density.area_by_any_year_wide(standin.occupied_areas(spark, sf_dir))),
    "pivot_null_key": _indicator(deficit.precarious_null_key_table),
    "split_fixed": split_fixed,
    "polygon_centroid": lambda spark, sf_dir: rounded(centroids(standin.lot_vertices(spark, sf_dir))),
    "dissolved_regions": dissolved_regions,
    "repaired_polygons": repaired_polygons,
    # sample design and estimation
    "design_summary": _dwelling_query(lambda hh: design_summary(hh, DESIGN)),
    "post_stratify": _dwelling_query(post_stratified, 6),
    "bootstrap_factors": _dwelling_query(bootstrap_factors, 8),
    "bootstrap_lonely_psu": _dwelling_query(bootstrap_lonely_psu),
    "survey_domain_total": _indicator(survey_domain_total),
    "survey_total": _indicator(survey_total),
    "survey_total_se": _indicator(survey_total_kind, vartype="se"),
    "survey_total_cv": _indicator(survey_total_kind, vartype="cv"),
    "survey_total_ci": _indicator(survey_total_kind, vartype="ci"),
    "survey_total_strict": _indicator(survey_total_strict),
    "survey_total_ci_design": _indicator(survey_total_ci_design),
    "survey_degrees_of_freedom": _indicator(survey_degrees_of_freedom),
    "linearised_total": _indicator(linearised_total),
    "linearised_mean": _indicator(linearised_mean, 6),
    "linearised_share": _indicator(linearised_share, 6),
    "linearised_policies": _indicator(linearised_policies),
    "survey_count": _indicator(survey_count),
    "survey_mean": _indicator(survey_mean, 6),
    "survey_share": _indicator(survey_share, 6),
    "survey_multi": _indicator(survey_multi),
    "survey_rollup": _indicator(survey_rollup),
    "survey_repost": _indicator(survey_repost),
    # income, prices, groups
    "income_individual": _resident_query(income_individual),
    "income_household": _resident_query(income.household_income, digits=8),
    "price_inflator": _index_query(income.price_inflator),
    "real_income": real_income,
    "profile_gender_race": _resident_query(profile_gender_race, relation=False),
    "profile_job": _resident_query(profile_job, relation=False),
    "age_bands": _resident_query(age_bands),
    "income_bands": _resident_query(income_bands, relation=False),
    # housing demand
    "headship_rate": _indicator(demand.headship_rate, 6),
    "headship_population": _indicator(demand.adult_totals),
    "dhde_population": _indicator(demand.eligible_totals),
    "dhde_cells": _indicator(demand.dhde_cells),
    "dhde_by_region": _indicator(demand.dhde_by_region),
    "dhde_by_income_band": _indicator(demand.dhde_by_income_band),
    "dhde_classes": _demand_classes,
    # housing deficit
    "precarious_class": _indicator(deficit.precarious_class),
    "precarious_by_region": _indicator(deficit.precarious_by_region),
    "precarious_table": _indicator(deficit.precarious_table),
    "precarious_share": _indicator(deficit.precarious_share, 6),
    "precarious_share_table": _indicator(deficit.precarious_share_table, 6),
    "precarious_rollup": _indicator(deficit.precarious_rollup),
    "cohabitation_flags": _indicator(deficit.cohabitation_flags),
    "cohabitation_rollup": _indicator(deficit.cohabitation_rollup),
    "cohabitation_components_long": _indicator(deficit.cohabitation_components_long),
    "cohabitation_class": _indicator(deficit.cohabitation_class),
    "cohabitation_by_region": _indicator(deficit.cohabitation_by_region),
    "cohabitation_share_table": _indicator(deficit.cohabitation_share_table, 6),
    "cohabitation_share": _indicator(deficit.cohabitation_share, 6),
    "cohabitation_table": _indicator(deficit.cohabitation_table),
    "rent_burden": _indicator(deficit.rent_burden),
    "rent_burden_share": _indicator(deficit.rent_burden_share, 6),
    "rent_burden_table": _indicator(deficit.rent_burden_table),
    "overcrowding": _indicator(deficit.overcrowding),
    "overcrowding_share": _indicator(deficit.overcrowding_share, 6),
    "overcrowding_table": _indicator(deficit.overcrowding_table),
    "deficit_total": _indicator(deficit.deficit_total),
    "deficit_rate": _indicator(deficit.deficit_rate, 6),
    "deficit_share": _indicator(deficit.deficit_share, 6),
    "deficit_composition": _indicator(deficit.deficit_composition),
    "deficit_composition_legacy": _indicator(deficit.deficit_composition, legacy=True),
    "composition_table": _indicator(deficit.composition_table),
    "composition_table_legacy": _indicator(deficit.composition_table, legacy=True),
    "deficit_dominant": _indicator(deficit.deficit_dominant),
    "lot_status": _indicator(deficit.lot_status),
    "component_totals": _indicator(deficit.component_totals),
    "deficit_final_table": _indicator(deficit.deficit_final_table),
    "deficit_components_long": _indicator(deficit.deficit_components_long),
    "profile_hierarchy": _indicator(_profile_hierarchies),
    # areas and densities
    "population_by_region": _indicator(density.population_by_region),
    "dwelling_type_by_region": _indicator(density.dwelling_type_by_region),
    "occupied_area": _occupied_area,
    "occupied_area_cumulative": partial(_areas, density.occupied_area_cumulative),
    "density_table": _density,
}
