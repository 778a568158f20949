"""What a query computes in steps is computed once a row, also where it is filtered."""

import pytest

from boxloom.plans import registry

SF = "/root/testdata/sf0.001"


def longest_condition(df):
    """Length of the longest filter condition of the optimized plan."""
    return max((len(line) for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if line.lstrip(" :+-").startswith("Filter")), default=0)


@pytest.mark.parametrize("name", ["box_fix", "read_kitti_labels"])
def test_filters_stay_small(spark, name):
    assert longest_condition(registry.QUERIES[name](spark, SF)) < 2500


def test_matching_collects_no_candidates(spark):
    plan = registry.QUERIES["match_iou_or_distance"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_blank_policy_sorts_an_image_once(spark):
    plan = registry.QUERIES["label_blank_policy"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("image_id" in line for line in plan.splitlines() if line.lstrip(" :+-").startswith("Window")) == 1


def test_answers_are_parsed_once(spark):
    plan = registry.QUERIES["repair_json"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().replace("_", "").count("parsejson") == 2  # of the text, and of its part in braces
