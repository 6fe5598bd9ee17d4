"""What the plans must and must not hold."""

import os
import re

import pytest
from pyspark.sql import functions as F

from corpuslens.queries import QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["trace_single", "trace_multi_pattern", "trace_ignore_case", "trace_fixed", "trace_occurrences", "lines_explode", "checkpoints_every_n", "newline_count"])
def test_narrow_queries_stay_in_one_stage_without_python(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "Exchange" not in text and "Python" not in text and "Arrow" not in text


@pytest.mark.parametrize("name", ["profile_basic", "profile_percentiles", "index_stats_bytes"])
def test_profiles_shuffle_once(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert text.count("Exchange hashpartitioning") == 1 and "Python" not in text


def test_scans_read_only_needed_columns_and_push_filters(spark):
    text = plan(QUERIES["trace_single"](spark, SF).filter(F.col("file") < 5))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in text and "LessThan(doc_id,5)" in text


def test_limits_are_top_k(spark):
    assert "TakeOrderedAndProject" in plan(QUERIES["trace_max_results"](spark, SF))


@pytest.mark.parametrize("name", ["context_join", "samples_by_line", "samples_by_offset", "offset_to_line", "frame_overlap", "frame_lookup"])
def test_range_joins_have_an_equality_key(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "NestedLoop" not in text and "Cartesian" not in text


@pytest.mark.parametrize("name", ["samples_by_offset", "offset_to_line", "frame_lookup", "frame_of_offset"])
def test_lookups_of_places_are_dealt_by_cell(spark, name):
    assert re.search(r"Join \[[^]]*FLOOR|HashJoin[^\n]*cell#|hashpartitioning\([^)]*cell#", plan(QUERIES[name](spark, SF)))
