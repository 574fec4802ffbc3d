"""Incomes and the price inflator that brings them to one month."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from domicilia.functions import codes
from domicilia.functions.columns import clean_income, member, row_sum
from domicilia.operators.aggregates import running, strict_sum

_ABSENT = [codes.UNKNOWN, codes.REFUSED]
_NOTHING = [codes.NOT_APPLICABLE, codes.NO_INCOME]


def individual_parts() -> dict[str, Column]:
    """The six income sources of a person; both non-answers make a source unknown."""
    sources = codes.LABOUR_INCOME + codes.OTHER_INCOME
    return {c: clean_income(F.col(c), _ABSENT, _NOTHING) for c in sources}


def household_parts() -> dict[str, Column]:
    """As for a person, but "does not know" counts as nothing in the minor sources."""
    labour = {c: clean_income(F.col(c), _ABSENT, _NOTHING) for c in codes.LABOUR_INCOME}
    other = {c: clean_income(F.col(c), [codes.UNKNOWN], [codes.REFUSED, *_NOTHING]) for c in codes.OTHER_INCOME}
    return labour | other


def individual_income() -> Column:
    return row_sum(list(individual_parts().values()))


def household_income(residents: DataFrame, household: str = "A01nficha") -> DataFrame:
    """Household income, people it is shared by, and income per head.

    Live-in staff and their relatives are left out; a person of unknown relation is
    not. One unknown income makes the household's unknown.
    """
    family = residents.filter(~member(F.col("E02"), codes.DOMESTIC_STAFF))
    income = family.select(household, row_sum(list(household_parts().values())).alias("renda_individual"))
    return (
        income.groupBy(household)
        .agg(strict_sum(F.col("renda_individual")).alias("renda_dom"), F.count("*").alias("pessoas"))
        .withColumn("renda_pc", F.col("renda_dom") / F.col("pessoas"))
    )


def index_periods(index: DataFrame) -> DataFrame:
    """Index rows with the digit and the name of their month."""
    return index.withColumns(
        {
            "mes_n": F.substring("ref", 6, 1).try_cast("double"),
            "mes": F.trim(F.regexp_replace("ref1", "[0-9]", "")),
        }
    )


def running_product(index: DataFrame) -> DataFrame:
    """Product of the monthly changes of each class, from the last period back."""
    change = F.col("valor") / 100 + 1
    return index.withColumn("produto", running(change, ["classe"], F.col("ref").desc(), "product"))


def price_inflator(index: DataFrame, first: str = "201803", reference: str = "201807", last: str = "201810") -> DataFrame:
    """Factor that brings an amount of each month to the reference month, per class.

    Months before the reference multiply the changes from the reference back to
    them, later ones divide by the changes from the reference on; the reference's
    own change takes part in both, and its factor is 1. The reference is a row of
    either side, so the index is read once.
    """
    ref = F.col("ref")
    sides = F.array(F.when(ref <= reference, F.lit("before")), F.when(ref >= reference, F.lit("after")))
    periods = index_periods(index.filter(ref.between(first, last))).withColumn("_side", F.explode(F.array_compact(sides)))
    away = F.when(F.col("_side") == "before", -ref.cast("int")).otherwise(ref.cast("int"))
    product = running(F.col("valor") / 100 + 1, ["classe", "_side"], away, "product")
    factor = F.when(ref == reference, 1.0).when(F.col("_side") == "before", F.col("_product")).otherwise(1 / F.col("_product"))
    return periods.withColumn("_product", product).select("classe", "mes", factor.alias("inflator")).distinct()


def inflators(index: DataFrame, classes: Sequence[int] = (codes.GENERAL_INDEX, codes.RENT_INDEX)) -> DataFrame:
    """One row per month with the factors of the given classes, general first."""
    names = ["inflator_geral", "inflator_aluguel"][: len(classes)]
    factors = price_inflator(index.filter(F.col("classe").isin(list(classes))))
    return factors.groupBy("mes").agg(
        *[F.max(F.when(F.col("classe") == c, F.col("inflator"))).alias(n) for c, n in zip(classes, names)]
    )
