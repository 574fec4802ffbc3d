"""Column expressions. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from domicilia.functions import codes


def member(column: Column, values: Sequence) -> Column:
    """Set membership that is never NULL: a NULL value is simply not in the set."""
    return F.coalesce(column.isin(list(values)), F.lit(False))


def lookup(column: Column, labels: Mapping) -> Column:
    """Label of a code; NULL for unknown codes. The list is a literal of the plan."""
    pairs = ", ".join(f"{_literal(code)}, {_literal(label)}" for code, label in labels.items())
    return F.try_element_at(F.expr(f"map({pairs})"), column)


def _literal(value: int | str) -> str:
    return str(value) if isinstance(value, int) else "'" + value.replace("'", "\\'") + "'"


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or NULL."""
    return F.when(condition, 1).otherwise(0)


def right_closed(value: Column, limits: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval (previous limit, limit] that holds the value."""
    chain = F
    for limit, label in zip(limits, labels):
        chain = chain.when(value <= limit, label)
    return chain.when(value > limits[-1], labels[-1])


def first_label(conditions: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """Label of the first condition that holds; NULL conditions never hold."""
    chain = F
    for condition, label in conditions:
        chain = chain.when(condition, label)
    return chain if default is None else chain.otherwise(default)


def clean_income(value: Column, missing: Sequence[int], zero: Sequence[int]) -> Column:
    """Sentinels to NULL or to zero, anything else to double."""
    return (
        F.when(value.isin(list(missing)), F.lit(None).cast("double"))
        .when(value.isin(list(zero)), F.lit(0.0))
        .otherwise(value.cast("double"))
    )


def row_sum(columns: Sequence[Column]) -> Column:
    """Sum across a row, NULL as soon as one part is NULL."""
    total = columns[0]
    for column in columns[1:]:
        total = total + column
    return total


def month_label(date: Column) -> Column:
    return lookup(F.month(date), codes.MONTHS)


def visit_date(text: Column) -> Column:
    """Month/day/year text to a date; NULL when it is no date."""
    return F.try_to_date(text, "M/d/yyyy")


def path_label(columns: Sequence[Column], sep: str = "-") -> Column:
    """Parts joined into one path; a missing part is spelled NA."""
    return F.concat_ws(sep, *[F.coalesce(column.cast("string"), F.lit("NA")) for column in columns])


def number_label(name: Column, number: Column) -> Column:
    """A name and a number in whole units, ties to the even one; a missing part is spelled NA."""
    return path_label([name, F.bround(number, 0).cast("decimal(38,0)")], " ")


def split_two(text: Column, sep: str) -> tuple[Column, Column]:
    """Exactly two parts; the second holds the whole remainder or is empty."""
    parts = F.split(text, sep, 2)
    return parts[0], F.when(text.isNotNull(), F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit("")))


def gender(e03: Column) -> Column:
    return lookup(e03, codes.GENDER)


def race(e04: Column) -> Column:
    return lookup(e04, codes.RACE)


def job_status(g05: Column, g08: Column, g09: Column, g13: Column, g041: Column) -> Column:
    """Employment group; the order of the answers that decide it matters."""
    unregistered = (g13 == 3) & member(g08, [1, 2, 4, 14, 15, 16])
    without_contribution = member(g08, [5, 6, 7, 8]) & (g09 == 2)
    return first_label(
        [
            (unregistered | without_contribution, "informal"),
            (g13 == 88, "Não respondeu"),
            (member(g05, [4, 99]) & (g041 != 1), "Desempregado"),
            (g041 == 1, "Aposentado"),
        ],
        "formal",
    )


def age_band(age: Column) -> Column:
    return first_label([(age.between(low, high), label) for label, (low, high) in codes.AGE_BANDS.items()])


def income_band(income: Column) -> Column:
    return F.when(income >= 0, right_closed(income, codes.INCOME_LIMITS, codes.INCOME_BANDS))


def demand_class(demand: Column) -> Column:
    return right_closed(demand, codes.DEMAND_LIMITS, codes.DEMAND_CLASSES)


def composition(flags: Mapping[str, Column], pairs: Sequence[tuple[str, str, str]]) -> Column:
    """Which components a dwelling has, as one label."""
    count = row_sum(list(flags.values()))
    chain = F.when(count == len(flags), codes.ALL_COMPONENTS)
    for name, label in codes.SINGLE_LABELS.items():
        chain = chain.when((count == 1) & (flags[name] == 1), label)
    for first, second, label in pairs:
        chain = chain.when((flags[first] == 1) & (flags[second] == 1), label)
    return chain.otherwise(codes.NO_COMPONENT)


def dominant(label: Column) -> Column:
    """The component that stands for a composition label."""
    return F.coalesce(lookup(label, codes.DOMINANT), F.lit(codes.NO_DEFICIT))
