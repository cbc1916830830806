"""Every registered query against its SQL, and the shape of the plans that matter."""

import re

import pytest

import __spark_entry__ as contract
import check
from hitloom.workloads.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, connection, name):
    verdict = check.compare(spark, connection, SF, name)
    assert verdict.startswith(("equal", "no oracle")), verdict


def plan(df):
    """The plan, without the spreading of test tables that have a single split."""
    text = df._jdf.queryExecution().executedPlan().toString()
    return re.sub(r".*REPARTITION_BY_NUM.*\n", "", text)


def test_entry(spark):
    assert contract.entry(spark).count() > 0


def test_counting_shuffles_once_and_splits_each_line_once(spark):
    text = plan(contract.queries()["dim_counts"](spark, SF))
    assert len(re.findall(r"Exchange hashpartitioning", text)) == 1
    assert len(re.findall(r"split\(coalesce", text)) == 1


def test_uri_forms_come_from_one_parse(spark):
    text = plan(contract.queries()["normalize_uri"](spark, SF))
    assert "Join" not in text and len(re.findall(r"split\(coalesce", text)) == 1


def test_snapshot_differences_group_once_and_move_each_range_once(spark):
    text = plan(contract.queries()["cidr_diff"](spark, SF))
    assert len(re.findall(r"Exchange hashpartitioning", text)) <= 2


def test_labels_of_a_short_list_need_no_shuffle(spark):
    assert "Exchange" not in plan(contract.queries()["trust_label"](spark, SF))


PLANNED = ("parse_log", "dim_counts", "star_dims", "cidr_changed", "cidr_set_diff", "trust_label", "trusted_requests", "block_counters", "report_ranked")


@pytest.mark.parametrize("name", PLANNED)
def test_no_nested_loops(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text
