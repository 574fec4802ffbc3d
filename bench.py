"""Headline queries over $BENCH_SF_DIR; prints one JSON line.

Survey indicators run with 50 bootstrap replicates. Each query is built and executed
in full (every row is produced, none is fetched), after one small warm-up query. The
last entry computes all indicators from one survey whose base tables are stored first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from domicilia.operators.design import Design, factors, replicate
from domicilia.plans import deficit, demand, density
from domicilia.plans.registry import QUERIES, open_survey
from domicilia.session import build_session
from domicilia.sources import standin

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
DESIGN = Design(replicates=50)

INDICATORS = {
    "deficit_total": deficit.deficit_total,
    "deficit_rate": deficit.deficit_rate,
    "deficit_composition": deficit.deficit_composition,
    "deficit_final_table": deficit.deficit_final_table,
    "precarious_class": deficit.precarious_class,
    "cohabitation_flags": deficit.cohabitation_flags,
    "rent_burden": deficit.rent_burden,
    "overcrowding": deficit.overcrowding,
    "headship_rate": demand.headship_rate,
    "dhde_cells": demand.dhde_cells,
    "population_by_region": density.population_by_region,
}
OPERATORS = [
    "income_household",
    "price_inflator",
    "join_person_household",
    "join_household_person",
    "join_null_safe_natural",
    "window_partition_sum",
    "rollup_total",
    "occupied_area_cumulative",
    "polygon_centroid",
]


def main() -> None:
    spark = build_session(f"local[{CPUS}]", int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")

    def run(build) -> float:
        start = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    run(lambda: QUERIES["rollup_total"](spark, SF_DIR))
    times = {name: run(lambda: QUERIES[name](spark, SF_DIR)) for name in OPERATORS}
    hh = standin.dwellings(spark, SF_DIR).select("A01setor", "A01nficha")
    times["bootstrap_factors"] = run(lambda: factors(*replicate(hh, DESIGN)))
    for name, build in INDICATORS.items():
        times[name] = run(lambda: build(open_survey(spark, SF_DIR, DESIGN)))
    start = time.perf_counter()
    survey = open_survey(spark, SF_DIR, DESIGN).materialize()
    for build in INDICATORS.values():
        run(lambda: build(survey))
    times["report_of_all_indicators"] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(os.path.normpath(SF_DIR)).removeprefix("sf")
    print(json.dumps({"metric": "total_query_time", "value": total, "unit": "sec", "queries": times, "sf": sf, "cpus": int(CPUS)}))
    spark.stop()


if __name__ == "__main__":
    main()
