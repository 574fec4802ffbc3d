"""What the physical plans must and must not hold."""

import re

import pytest

from domicilia.plans.registry import QUERIES, open_survey
from domicilia.plans import density


def plan_of(frame) -> list[str]:
    frame.collect()
    text = frame._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return text.splitlines()


def depth(line: str) -> int:
    return len(line) - len(line.lstrip(" :+-|"))


@pytest.mark.parametrize("name", ["deficit_total", "dhde_cells", "population_by_region", "survey_repost", "density_table"])
def test_no_pairing_of_all_rows(spark, sf_dir, name):
    plan = plan_of(QUERIES[name](spark, sf_dir))
    assert not [line for line in plan if "CartesianProduct" in line or "NestedLoopJoin" in line]


def test_replicates_are_aggregated_before_the_shuffle(spark, sf_dir):
    """Between the unfolding of replicates and the next exchange there is a partial aggregation."""
    plan = plan_of(QUERIES["deficit_total"](spark, sf_dir))
    unfold = next(i for i, line in enumerate(plan) if "Generate posexplode(_counts" in line)
    above = [line for line in plan[:unfold] if depth(line) < depth(plan[unfold])][::-1]
    first = next(line for line in above if "Exchange" in line or "partial_" in line)
    assert "partial_sum" in first


@pytest.mark.parametrize("name", ["precarious_table", "component_totals", "dhde_cells", "headship_rate", "density_table"])
def test_no_replicates_for_estimates_without_errors(spark, sf_dir, name):
    plan = "\n".join(plan_of(QUERIES[name](spark, sf_dir)))
    assert "posexplode" not in plan and "md5" not in plan


def test_windows_span_no_stratum_and_no_dwelling(spark, sf_dir):
    plan = plan_of(QUERIES["bootstrap_factors"](spark, sf_dir))
    keys = [re.search(r"windowspecdefinition\(([^)]*?)(ASC|DESC)", line).group(1) for line in plan if "Window [" in line]
    assert keys and all("_bucket" in k for k in keys)
    for name in ("window_partition_sum", "deficit_total", "post_stratify"):
        for line in plan_of(QUERIES[name](spark, sf_dir)):
            if "Window [" in line:
                assert "_bucket" in line or "_side" in line


def test_only_needed_columns_are_read(spark, sf_dir):
    plan = "\n".join(plan_of(density.population_by_region(open_survey(spark, sf_dir))))
    schemas = set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan))
    assert schemas <= {
        "struct<l_orderkey:bigint,l_suppkey:bigint>",
        "struct<l_orderkey:bigint>",
        "struct<o_orderkey:bigint,o_custkey:bigint>",
        "struct<c_custkey:bigint,c_mktsegment:string>",
        "struct<c_custkey:bigint>",
    }


def test_filters_reach_the_scan(spark, tmp_path):
    from pyspark.sql import functions as F

    from domicilia.functions import columns as c

    spark.range(100).select(F.col("id").alias("E02"), (F.col("id") % 7).alias("x")).write.parquet(str(tmp_path / "p"))
    people = spark.read.parquet(str(tmp_path / "p"))
    scan = "\n".join(plan_of(people.filter(F.col("E02") == 1).select("x")))
    assert "EqualTo(E02,1)" in scan
    kept = people.filter(~c.member(F.col("E02"), [17, 18]))
    assert kept.count() == 98
