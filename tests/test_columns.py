"""Edge cases of column expressions: NULLs, sentinels, ties, closed ends."""

import pytest
from pyspark.sql import functions as F

from domicilia.functions import codes
from domicilia.functions import columns as c
from domicilia.functions.student import t_quantile


def values(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_not_in_keeps_null(spark):
    frame = spark.createDataFrame([(1,), (17,), (18,), (None,)], "E02 int")
    kept = [r[0] for r in frame.filter(~c.member(F.col("E02"), codes.DOMESTIC_STAFF)).collect()]
    assert kept == [1, None]


def test_income_bands_are_right_closed(spark):
    rows = [(x,) for x in (-1.0, 0.0, 1800.0, 1800.5, 2600.0, 9000.0, 9001.0, None)]
    got = values(spark, rows, "x double", c.income_band(F.col("x")))
    b = codes.INCOME_BANDS
    assert got == [None, b[0], b[0], b[1], b[1], b[3], b[4], None]


def test_demand_class(spark):
    rows = [(x,) for x in (-5.0, 0.0, 2000.0, 2000.01, 10000.0, 10000.5)]
    assert values(spark, rows, "x double", c.demand_class(F.col("x"))) == [
        "sem dados", "sem dados", "0-2000", "2000-4000", "8000-10000", "+10000",
    ]


def test_path_spells_missing_parts(spark):
    rows = [("1", None, "x")]
    assert values(spark, rows, "a string, b string, c string", c.path_label([F.col(n) for n in "abc"])) == ["1-NA-x"]


def test_numbers_of_labels_are_rounded(spark):
    rows = [("x", 1234.9), (None, 2.0), ("y", None)]
    assert values(spark, rows, "a string, b double", c.number_label(F.col("a"), F.col("b"))) == ["x 1235", "NA 2", "y NA"]


def test_split_in_two(spark):
    frame = spark.createDataFrame([("RA-IX-2",), ("RA",), (None,)], "s string")
    before, after = c.split_two(F.col("s"), "-")
    assert [tuple(r) for r in frame.select(before, after).collect()] == [("RA", "IX-2"), ("RA", ""), (None, None)]


def test_visit_date_and_month(spark):
    rows = [("3/7/2018",), ("10/31/2018",), ("31/10/2018",), ("x",)]
    dates = values(spark, rows, "s string", c.visit_date(F.col("s")))
    assert [str(d) if d else None for d in dates] == ["2018-03-07", "2018-10-31", None, None]
    months = values(spark, rows, "s string", c.month_label(c.visit_date(F.col("s"))))
    assert months == ["março", "outubro", None, None]


def test_lookup_has_every_code(spark):
    for labels, size in ((codes.REGIONS, 33), (codes.SECTORS, 37), (codes.MONTHS, 12)):
        got = values(spark, [(k,) for k in [*labels, -1]], "k int", c.lookup(F.col("k"), labels))
        assert len(labels) == size and got == [*labels.values(), None]


def test_job_status_order(spark):
    schema = "g05 int, g08 int, g09 int, g13 int, g041 int"
    cases = {
        (1, 14, 1, 3, 1): "informal",
        (1, 6, 2, 88, 1): "informal",
        (4, 9, 1, 88, 2): "Não respondeu",
        (99, 9, 1, 1, 2): "Desempregado",
        (4, 9, 1, 1, 1): "Aposentado",
        (4, 9, 1, 1, None): "formal",
        (1, None, None, None, None): "formal",
    }
    job = c.job_status(*[F.col(n) for n in ("g05", "g08", "g09", "g13", "g041")])
    assert values(spark, list(cases), schema, job) == list(cases.values())


@pytest.mark.parametrize("pairs", [codes.PAIR_LABELS, codes.PAIR_LABELS_LEGACY])
def test_composition_of_all_combinations(spark, pairs):
    names = list(codes.SINGLE_LABELS)
    rows = [tuple((i >> k) & 1 for k in range(4)) for i in range(16)]
    flags = {n: F.col(n) for n in names}
    got = values(spark, rows, ", ".join(f"{n} int" for n in names), c.composition(flags, pairs))
    for row, label in zip(rows, got):
        held = [n for n, v in zip(names, row) if v]
        if not held:
            expected = "nenhum"
        elif len(held) == 4:
            expected = "todos"
        elif len(held) == 1:
            expected = codes.SINGLE_LABELS[held[0]]
        else:
            expected = next(label for a, b, label in pairs if a in held and b in held)
        assert label == expected


def test_dominant_component(spark):
    rows = [("todos",), ("nenhum",), ("Coabitacao e onus",), ("precariedade e adensamento",), ("onus",), ("Precariedade",)]
    got = values(spark, rows, "s string", c.dominant(F.col("s")))
    assert got == ["sem deficit", "sem deficit", "coabitacao", "adensamento", "onus", "Precariedade"]


def test_t_quantile_table_values():
    for df, value in ((1, 12.7062), (5, 2.570582), (19, 2.093024), (49, 2.009575), (1000, 1.962339)):
        assert t_quantile(0.95, df) == pytest.approx(value, abs=1e-4 if df == 1 else 1e-6)
    assert t_quantile(0.95, float("inf")) == pytest.approx(1.959964, abs=1e-6)
