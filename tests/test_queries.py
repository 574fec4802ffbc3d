"""Registered queries against their SQL, whole results compared.

All queries run when ALL_QUERIES is set; otherwise one of each kind does.
"""

import os

import pytest
from compare import connect, difference

import __spark_entry__ as driver
from domicilia.plans.registry import QUERIES as SURVEY

CORE = """
index_extract recode_region recode_sector round_numeric filter_not_in case_labels bin_right_closed visit_month
join_person_household join_household_person join_inflator join_household_income join_null_safe_natural strict_sum
rollup_total window_partition_sum running_product running_sum order_by_group_sum union_by_name pivot_spread
pivot_complete_zero split_fixed polygon_centroid post_stratify bootstrap_factors bootstrap_lonely_psu survey_mean
survey_share survey_rollup survey_repost survey_total_strict price_inflator real_income income_individual
dhde_classes precarious_class cohabitation_flags rent_burden_share deficit_total composition_table deficit_dominant
deficit_final_table profile_hierarchy density_table
""".split()

QUERIES = {name: build for name, build in driver.queries().items() if name in SURVEY}
SQL = {name: sql for name, sql in driver.oracle_sql().items() if name in SURVEY}


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(SQL)


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("ALL_QUERIES") else CORE)
def test_query(spark, sf_dir, con, name):
    assert difference(QUERIES[name](spark, sf_dir), con, SQL[name]) is None


def test_entry(spark):
    assert driver.entry(spark).count() == 34
