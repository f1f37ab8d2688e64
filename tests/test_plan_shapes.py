"""Scale properties of the physical plans, kept as regression tests:
no nested-loop or cartesian joins, one shuffle per upsert, map-only vector
math, scans that read only the needed columns."""

import re

import pytest

from corpusmap.plans.registry import QUERIES

from .conftest import SF_SMALL


def _plan(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


def _shuffles(plan):
    return len(re.findall(r"Exchange (hashpartitioning|rangepartitioning|RoundRobinPartitioning|SinglePartition)", plan))


def _read_columns(plan):
    scans = re.findall(r"FileScan parquet [^\[]*\[([^\]]*)\]", plan)
    return [sorted(c.split("#")[0].strip() for c in s.split(",")) for s in scans]


@pytest.mark.parametrize("name", ["categorize", "nearest_points", "answer_neighbours", "match_events", "map_categories",
                                  "refresh_datasets", "upsert_projects", "parse_gallery", "dataset_membership"])
def test_no_nested_loop_or_cartesian(spark, name):
    plan = _plan(spark, name)
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_vector_math_is_map_only(spark):
    for name in ("categorize", "l2_normalize", "validate_vectors", "project_dense"):
        plan = _plan(spark, name)
        assert _shuffles(plan) == 0 and "Join" not in plan, name
        assert _read_columns(plan) == [["embedding", "vec_id"]], name


def test_upsert_is_one_shuffle(spark):
    assert _shuffles(_plan(spark, "upsert_projects")) == 1


def test_text_work_is_one_projection(spark):
    plan = _plan(spark, "html_to_text")
    assert _shuffles(plan) == 0 and _read_columns(plan) == [["html", "page_id"]]


def test_nearest_is_a_block_join(spark):
    plan = _plan(spark, "nearest_points")
    # points and query blocks meet once, then the limited candidates; nothing is broadcast or taken to the driver
    assert _shuffles(plan) == 3 and "FlatMapCoGroupsInPandas" in plan and "WindowGroupLimit" in plan
    assert "Broadcast" not in plan
