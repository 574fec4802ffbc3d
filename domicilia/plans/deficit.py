"""Housing deficit: components, totals, rates and compositions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domicilia.functions import codes
from domicilia.functions.columns import composition, dominant, first_label, lookup, path_label
from domicilia.operators.aggregates import gather, spread
from domicilia.operators.estimate import survey_mean, survey_share, survey_total
from domicilia.operators.joins import null_safe_left_join
from domicilia.plans.survey import Survey, known_rent, low_income, profile

COMPONENTS = ["habit_prec", "cohabit_familiar", "onus_aluguel", "adens"]
KINDS = [codes.IMPROVISED, codes.RUSTIC]
SITUATIONS = [codes.ROOM, codes.FAMILIES]


def region_name(frame: DataFrame) -> DataFrame:
    return frame.withColumn("RA_nome", lookup(F.col("A01ra"), codes.REGIONS))


def _flags(names: Sequence[str]) -> dict:
    return {n: F.col(n) for n in names}


def precarious_kind(heads: DataFrame) -> DataFrame:
    """Rustic or improvised dwelling; NULL for all others."""
    kind = first_label([(F.col("dom_rust") == 1, codes.RUSTIC), (F.col("dom_imp") == 1, codes.IMPROVISED)])
    return heads.withColumn("domicilio", kind)


def cohabitation_kind(heads: DataFrame) -> DataFrame:
    """Families sharing the dwelling, else a rented room, else neither."""
    kind = first_label([(F.col("fam_conv") == 1, codes.FAMILIES), (F.col("comodo") == 1, codes.ROOM)], codes.OTHER)
    return heads.withColumn("situacao", kind)


def composition_label(heads: DataFrame, legacy: bool = False) -> DataFrame:
    pairs = codes.PAIR_LABELS_LEGACY if legacy else codes.PAIR_LABELS
    return heads.withColumn("composicao", composition({c: F.col(c) for c in COMPONENTS}, pairs))


def precarious_class(survey: Survey) -> DataFrame:
    heads = region_name(profile(precarious_kind(survey.dwelling_heads)))
    by = ["RA_nome", "genero", "raca", "job", "domicilio"]
    return survey_total(heads, by, {"n": None}, survey.by_dwelling.replicates, ["ci"])


def precarious_table(survey: Survey) -> DataFrame:
    """Both kinds side by side, zero where there are none, and their sum."""
    survey = survey.point
    heads = region_name(precarious_kind(survey.dwelling_heads))
    totals = survey_total(heads, ["RA_nome", "domicilio"], {"n": None}, survey.by_dwelling.replicates, [])
    wide = spread(totals.filter(F.col("domicilio").isNotNull()), ["RA_nome"], "domicilio", "n", KINDS, 0.0)
    return wide.withColumn("habitação precária", F.col(KINDS[0]) + F.col(KINDS[1]))


def precarious_null_key_table(survey: Survey) -> DataFrame:
    """As `precarious_table`, with the dwellings of no kind as a column."""
    survey = survey.point
    heads = region_name(precarious_kind(survey.dwelling_heads))
    totals = survey_total(heads, ["RA_nome", "domicilio"], {"n": None}, survey.by_dwelling.replicates, [])
    labelled = totals.withColumn("domicilio", F.coalesce("domicilio", F.lit("demais domicílios")))
    return spread(labelled, ["RA_nome"], "domicilio", "n", [*KINDS, "demais domicílios"], 0.0)


def precarious_by_region(survey: Survey) -> DataFrame:
    heads = region_name(precarious_kind(survey.dwelling_heads)).filter(F.col("domicilio").isNotNull())
    return survey_total(heads, ["RA_nome"], {"n": None}, survey.by_dwelling.replicates, ["ci"])


def precarious_share(survey: Survey) -> DataFrame:
    heads = region_name(precarious_kind(survey.dwelling_heads))
    shares = survey_share(heads, ["RA_nome"], "domicilio", survey.by_dwelling.replicates, "pct", ["cv"])
    return shares.filter(F.col("domicilio").isNotNull())


def precarious_share_table(survey: Survey) -> DataFrame:
    wide = spread(precarious_share(survey), ["RA_nome"], "domicilio", "pct", KINDS, 0.0)
    return wide.withColumn("habitação precária", F.col(KINDS[0]) + F.col(KINDS[1]))


def precarious_rollup(survey: Survey) -> DataFrame:
    flags = _flags(["dom_rust", "dom_imp", "habit_prec"])
    return survey_total(region_name(survey.dwelling_heads), ["RA_nome"], flags, survey.by_dwelling.replicates, ["cv"], codes.TOTAL_LABEL)


def cohabitation_flags(survey: Survey) -> DataFrame:
    heads = region_name(profile(survey.dwelling_heads))
    flags = _flags(["fam_conv", "comodo", "cohabit_familiar"])
    return survey_total(heads, ["RA_nome", "job", "genero", "raca"], flags, survey.by_dwelling.replicates, ["cv"])


def cohabitation_rollup(survey: Survey) -> DataFrame:
    flags = _flags(["fam_conv", "comodo", "cohabit_familiar"])
    return survey_total(region_name(survey.dwelling_heads), ["RA_nome"], flags, survey.by_dwelling.replicates, ["cv"], codes.TOTAL_LABEL)


def cohabitation_components_long(survey: Survey) -> DataFrame:
    survey = survey.point
    keys = ["RA_nome", "job", "genero", "raca"]
    wide = cohabitation_flags(survey).groupBy(*keys).agg(F.sum("fam_conv").alias("fam_conv"), F.sum("comodo").alias("comodo"))
    return gather(wide, keys, ["fam_conv", "comodo"], "componente", "n")


def cohabitation_class(survey: Survey) -> DataFrame:
    heads = region_name(cohabitation_kind(survey.dwelling_heads))
    return survey_total(heads, ["RA_nome", "situacao"], {"n": None}, survey.by_dwelling.replicates, ["ci"])


def cohabitation_by_region(survey: Survey) -> DataFrame:
    heads = region_name(cohabitation_kind(survey.dwelling_heads)).filter(F.col("situacao") != codes.OTHER)
    return survey_total(heads, ["RA_nome"], {"n": None}, survey.by_dwelling.replicates, ["ci"])


def cohabitation_share(survey: Survey) -> DataFrame:
    heads = region_name(cohabitation_kind(survey.dwelling_heads))
    shares = survey_share(heads, ["RA_nome"], "situacao", survey.by_dwelling.replicates, "pct", ["cv"])
    return shares.filter(F.col("situacao") != codes.OTHER)


def cohabitation_table(survey: Survey) -> DataFrame:
    survey = survey.point
    wide = spread(cohabitation_class(survey), ["RA_nome"], "situacao", "n", [*SITUATIONS, codes.OTHER], 0.0)
    return wide.withColumn("coabitaçao", F.col(SITUATIONS[0]) + F.col(SITUATIONS[1]))


def cohabitation_share_table(survey: Survey) -> DataFrame:
    wide = spread(cohabitation_share(survey), ["RA_nome"], "situacao", "pct", SITUATIONS, 0.0)
    return wide.withColumn("coabitaçao", F.col(SITUATIONS[0]) + F.col(SITUATIONS[1]))


# What `rent_base` and the rent burden take of the heads.
RENT_COLUMNS = ["A01ra", "renda_dom", "inflator_geral", "B05", "onus_aluguel"]


def rent_base(survey: Survey) -> DataFrame:
    """Heads whose household has a known, low, positive real income and no invalid rent."""
    income = F.col("renda_dom") * F.col("inflator_geral")
    return region_name(survey.heads).filter(low_income(income)).filter(known_rent()).filter(F.col("renda_dom").isNotNull())


def rent_burden(survey: Survey) -> DataFrame:
    return survey_total(
        rent_base(survey), ["RA_nome"], _flags(["onus_aluguel"]), survey.by_dwelling.replicates, ["cv"], codes.TOTAL_LABEL
    )


def rent_burden_share(survey: Survey) -> DataFrame:
    """Burdened share of the low-income dwellings, and of all dwellings."""
    survey = survey.with_stored_heads(RENT_COLUMNS)
    among = survey_share(rent_base(survey), ["RA_nome"], "onus_aluguel", survey.by_dwelling.replicates, "pct_renda_baixa", ["cv"])
    burdened = among.filter(F.col("onus_aluguel") == 1).drop("onus_aluguel")
    whole = survey_mean(
        region_name(survey.heads), ["RA_nome"], {"pct_domicilios": F.col("onus_aluguel")}, survey.by_dwelling.replicates, ["cv"]
    )
    return null_safe_left_join(whole, burdened, ["RA_nome"])


def rent_burden_table(survey: Survey) -> DataFrame:
    survey = survey.point
    totals = survey_total(rent_base(survey), ["RA_nome", "onus_aluguel"], {"n": None}, survey.by_dwelling.replicates, [])
    wide = spread(totals, ["RA_nome"], "onus_aluguel", "n", [0, 1], 0.0)
    return wide.withColumnsRenamed({"0": "sem ônus", "1": "ônus excessivo"})


def overcrowding(survey: Survey) -> DataFrame:
    return survey_total(
        region_name(survey.dwelling_heads), ["RA_nome"], _flags(["adens"]), survey.by_dwelling.replicates, ["cv"], codes.TOTAL_LABEL
    )


def overcrowding_share(survey: Survey) -> DataFrame:
    shares = survey_share(region_name(survey.dwelling_heads), ["RA_nome"], "adens", survey.by_dwelling.replicates, "pct", ["cv"])
    return shares.filter(F.col("adens") == 1)


def overcrowding_table(survey: Survey) -> DataFrame:
    survey = survey.point
    heads = region_name(survey.dwelling_heads)
    totals = survey_total(heads, ["RA_nome", "adens"], {"n": None}, survey.by_dwelling.replicates, [])
    wide = spread(totals, ["RA_nome"], "adens", "n", [0, 1], 0.0)
    return wide.withColumnsRenamed({"0": "sem adensamento", "1": "adensamento excessivo"})


def deficit_total(survey: Survey) -> DataFrame:
    """Dwellings in any of the four situations, by region and in all."""
    return survey_total(
        region_name(survey.heads), ["RA_nome"], _flags(["deficit_habit"]), survey.by_dwelling.replicates, ["se", "cv", "ci"], codes.TOTAL_LABEL
    )


def deficit_rate(survey: Survey) -> DataFrame:
    return survey_mean(
        region_name(survey.heads), ["RA_nome"], _flags(["deficit_habit"]), survey.by_dwelling.replicates, ["cv"], codes.TOTAL_LABEL
    )


def deficit_share(survey: Survey) -> DataFrame:
    """The rate as the share of a two-way table."""
    return survey_share(region_name(survey.heads), ["RA_nome"], "deficit_habit", survey.by_dwelling.replicates, "n", ["cv"])


def deficit_composition(survey: Survey, legacy: bool = False) -> DataFrame:
    heads = region_name(composition_label(survey.heads, legacy))
    totals = survey_total(heads, ["RA_nome", "composicao"], {"n": None}, survey.by_dwelling.replicates, ["ci"])
    return totals.filter(F.col("composicao") != codes.NO_COMPONENT)


def composition_table(survey: Survey, legacy: bool = False) -> DataFrame:
    survey = survey.point
    pairs = codes.PAIR_LABELS_LEGACY if legacy else codes.PAIR_LABELS
    labels = dict.fromkeys([codes.ALL_COMPONENTS, *codes.SINGLE_LABELS.values(), *[p[2] for p in pairs]])
    return spread(deficit_composition(survey, legacy), ["RA_nome"], "composicao", "n", list(labels), 0.0)


def deficit_dominant(survey: Survey) -> DataFrame:
    heads = region_name(composition_label(survey.heads)).withColumn("dominante", dominant(F.col("composicao")))
    totals = survey_total(heads, ["RA_nome", "dominante"], {"n": None}, survey.by_dwelling.replicates, ["ci"])
    return totals.filter(F.col("dominante") != codes.NO_DEFICIT)


def lot_status(survey: Survey) -> DataFrame:
    """Dwellings in deficit by what their residents say of the lot."""
    heads = region_name(survey.heads).withColumn("lote", lookup(F.col("B06"), codes.LOT_STATUS))
    totals = survey_total(heads, ["RA_nome", "deficit_habit", "lote"], {"n": None}, survey.by_dwelling.replicates, ["ci"])
    return totals.filter(F.col("deficit_habit") == 1)


def component_totals(survey: Survey) -> DataFrame:
    """The four components of the whole area, in long form."""
    survey = survey.point
    names = {
        "precariedade": F.col("habit_prec"),
        "coabitaçao": F.col("cohabit_familiar"),
        "adensamento": F.col("adens"),
        "onus": F.col("onus_aluguel"),
    }
    return gather(survey_total(survey.heads, [], names, survey.by_dwelling.replicates, ["se"]).select(*names), [], list(names), "comp", "n")


def deficit_final_table(survey: Survey) -> DataFrame:
    """The four components with their CV, by region and in all.

    Rent burden is left out of regions none of whose dwellings pass its filters, so
    its table is joined, while the others come out of one aggregation.
    """
    flags = _flags(["habit_prec", "adens", "cohabit_familiar"])
    survey = survey.with_stored_heads([*RENT_COLUMNS, *flags])
    three = survey_total(region_name(survey.dwelling_heads), ["RA_nome"], flags, survey.by_dwelling.replicates, ["cv"], codes.TOTAL_LABEL)
    return null_safe_left_join(three, rent_burden(survey), ["RA_nome"])


def deficit_components_long(survey: Survey) -> DataFrame:
    survey = survey.point
    columns = ["habit_prec", "adens", "cohabit_familiar", "onus_aluguel"]
    return gather(deficit_final_table(survey).select("RA_nome", *columns), ["RA_nome"], columns, "componente", "n")


def profile_hierarchy(survey: Survey, component: str) -> DataFrame:
    """Dwellings with a component, by a path of the head's gender, job and race."""
    keys = [component, "genero", "job", "raca"]
    totals = survey_total(profile(survey.heads), keys, {"n": None}, survey.by_dwelling.replicates, ["ci"]).filter(F.col(component) != 0)
    return totals.select(path_label([F.col(k) for k in keys]).alias("hierarquia"), "n", "n_low", "n_upp")
