"""The survey as frames ready for estimation."""

from __future__ import annotations

from collections.abc import Sequence
from copy import copy
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from domicilia.functions import codes
from domicilia.functions.columns import age_band, flag, income_band, job_status, gender, month_label, race, visit_date
from domicilia.operators.design import Design, Replicates, post_stratify, replicate
from domicilia.operators.joins import attach, bounded_side, hot_keys, join_to_unique
from domicilia.plans.income import household_income, individual_income, inflators
from domicilia.session import materialize

PERSON_CODES = ["E03", "E04", "G05", "G08", "G09", "G13", "G041"]


def with_month(dwellings: DataFrame) -> DataFrame:
    return dwellings.withColumn("mes", month_label(visit_date(F.col("datavisita"))))


def with_inflators(dwellings: DataFrame, index: DataFrame) -> DataFrame:
    """Factors of the visit month, fetched first: one row per month, unless the index is odd."""
    return attach(with_month(dwellings), bounded_side(inflators(index)), ["mes"], ["A01nficha"])


def profile(frame: DataFrame) -> DataFrame:
    return frame.withColumns(
        {
            "genero": gender(F.col("E03")),
            "raca": race(F.col("E04")),
            "job": job_status(*[F.col(c) for c in ("G05", "G08", "G09", "G13", "G041")]),
        }
    )


@dataclass(frozen=True)
class Sample:
    """One row per sampled dwelling, weighted, and the replicates that go with it."""

    frame: DataFrame
    replicates: Replicates

    def materialize(self) -> Sample:
        return Sample(materialize(self.frame), self.replicates)

    def point(self) -> Sample:
        return Sample(self.frame, self.replicates.none())


class Survey:
    """Dwellings, residents and the price index under one sample design.

    `by_dwelling` has a row for each dwelling of the sample, also those without
    residents; `by_resident` only those with some. Both carry weights and replicates,
    made on the full sample before any domain is chosen. Residents are counted per
    dwelling before they meet it, so weights never need the joined person rows.
    """

    def __init__(
        self, dwellings: DataFrame, residents: DataFrame, index: DataFrame, design: Design, counted: DataFrame | None = None
    ):
        """`counted` may give the residents in a form that is cheaper to read where only
        A01nficha, A01ra and E21 are needed."""
        self.design = design
        self.dwellings = dwellings
        self.residents = residents
        self.counted = residents if counted is None else counted
        self.index = index
        self.stored = False

    @cached_property
    def point(self) -> Survey:
        """The same survey for estimates without errors; no replicates are drawn for it."""
        if not self.design.replicates:
            return self
        return Survey(self.dwellings, self.residents, self.index, replace(self.design, replicates=0), self.counted)

    @cached_property
    def composition(self) -> DataFrame:
        """Residents by dwelling and region, and how many of them want a home of their own."""
        wants = flag(F.col("E21") == 1)
        return self.counted.groupBy("A01nficha", "A01ra").agg(F.count("*").alias("_rows"), F.sum(wants).alias("novo_dom"))

    @cached_property
    def by_dwelling(self) -> Sample:
        joined = self.dwellings.join(self.composition, ["A01nficha", "A01ra"], "left")
        rows = joined.withColumn("_rows", F.coalesce("_rows", F.lit(1)))
        return Sample(*replicate(post_stratify(rows, self.design, "_rows"), self.design))

    @cached_property
    def by_resident(self) -> Sample:
        counts = self.counted.groupBy("A01nficha").agg(F.count("*").alias("_rows"))
        joined = self.dwellings.join(counts, "A01nficha")
        return Sample(*replicate(post_stratify(joined, self.design, "_rows"), self.design))

    def materialize(self) -> Survey:
        """Store the tables that all indicators start from, when many are to follow."""
        self.by_dwelling = self.by_dwelling.materialize()
        self.by_resident = self.by_resident.materialize()
        self.heads = self.dwelling_heads = materialize(self.heads)
        self.people = materialize(self.people)
        self.stored = True
        point = self.point
        if point is not self:
            point.stored = True
            point.by_dwelling, point.by_resident = self.by_dwelling.point(), self.by_resident.point()
            point.heads, point.dwelling_heads, point.people = self.heads, self.dwelling_heads, self.people
        return self

    def with_stored_heads(self, columns: Sequence[str]) -> Survey:
        """The survey with heads that are made once and stored, with these columns, for several estimates from them."""
        if self.stored:
            return self
        heads = materialize(self.heads.select(*columns, "w", "draws"))
        other = copy(self)
        other.heads = other.dwelling_heads = heads
        other.stored = True
        return other

    @cached_property
    def hot(self) -> DataFrame | None:
        """Dwellings that hold very many resident rows, if any."""
        return hot_keys(self.counted, ["A01nficha"])

    def _with_head(self, dwellings: DataFrame) -> DataFrame:
        heads = self.residents.filter(F.col("E02") == 1).select("A01nficha", "A01ra", *PERSON_CODES)
        return join_to_unique(heads, dwellings, ["A01nficha", "A01ra"], "inner", self.hot)

    @cached_property
    def heads(self) -> DataFrame:
        """Dwellings that have a head, with the head's answers, weights and the deficit flags."""
        income = household_income(self.residents)
        dwellings = with_inflators(self.by_dwelling.frame, self.index).join(income, "A01nficha", "left")
        return deficit_flags(self._with_head(dwellings))

    @cached_property
    def dwelling_heads(self) -> DataFrame:
        """As `heads`, for indicators that need no income."""
        return dwelling_flags(self._with_head(self.by_dwelling.frame))

    @cached_property
    def people(self) -> DataFrame:
        """Residents with real income, bands and the weights of their dwelling."""
        income = self.residents.select(
            "A01nficha", "A01ra", "E02", "idade_calculada", *PERSON_CODES, individual_income().alias("renda_individual")
        )
        own = self.by_resident.frame.select("A01nficha", "A01setor", "datavisita", "w", "draws")
        joined = join_to_unique(income, with_inflators(own, self.index), ["A01nficha"], "inner", self.hot)
        real = joined.withColumn("renda_individual_real", F.col("renda_individual") * F.col("inflator_geral"))
        return real.withColumns(
            {
                "faixa_idade": age_band(F.col("idade_calculada")),
                "faixa_renda_ind": income_band(F.col("renda_individual_real")),
                "situacao": F.when(F.col("E02") == 1, codes.HEAD).when(F.col("E02") != 1, codes.NOT_HEAD),
            }
        )


def dwelling_flags(frame: DataFrame) -> DataFrame:
    """Components that follow from the dwelling alone."""
    permanent, rented, room = F.col("B01") == 1, F.col("B03") == 3, F.col("B02") == 3
    first = {
        "dom_rust": flag(permanent & (F.col("B08") >= 4) & ~room),
        "dom_imp": flag(F.col("B01") == 2),
        "fam_conv": flag(permanent & (F.col("A01nfamilias") != 1) & (F.col("novo_dom") > 0)),
        "comodo": flag(room & permanent),
        # Written as a product, so that no bedrooms means crowded as soon as anybody lives there.
        "adens": flag(rented & permanent & (F.col("A01npessoas") > codes.CROWDING_LIMIT * F.col("B12"))),
    }
    second = {
        "habit_prec": F.greatest("dom_rust", "dom_imp"),
        "cohabit_familiar": F.greatest("fam_conv", "comodo"),
    }
    return frame.withColumns(first).withColumns(second)


def deficit_flags(frame: DataFrame) -> DataFrame:
    """All four components and whether any holds."""
    income = F.col("renda_dom") * F.col("inflator_geral")
    rent = F.col("B05") * F.col("inflator_aluguel")
    burden = (
        (F.col("B03") == 3)
        & (F.col("B02") != 3)
        & (F.col("B01") == 1)
        & (rent >= codes.RENT_SHARE * income)
        & low_income(income)
        & known_rent()
    )
    components = ["habit_prec", "cohabit_familiar", "onus_aluguel", "adens"]
    flagged = dwelling_flags(frame).withColumn("onus_aluguel", flag(burden))
    return flagged.withColumn("deficit_habit", F.greatest(*components))


def low_income(income):
    """Real income above zero, up to three minimum wages."""
    return (income > 0) & (income <= 3 * codes.MINIMUM_WAGE)


def known_rent():
    return ~F.coalesce(F.col("B05").isin([codes.UNKNOWN, codes.REFUSED]), F.lit(False))
