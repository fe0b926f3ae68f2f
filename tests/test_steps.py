"""The steps that many queries share: what they shuffle, and that dealing them out by the size of their tables changes no row."""

import pytest

from tidemark.operators import keyed
from tidemark.plans import catalogue, reader

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_sets_of_stories_are_collected_after_the_shuffle(spark):
    dealt_by = [line for line in _plan(reader._stories(spark, SF)).splitlines() if "hashpartitioning" in line]
    assert not any("l_suppkey" in line for line in dealt_by)


def test_tags_are_distinct_before_stories_join(spark):
    dealt_by = [line for line in _plan(catalogue._tagged(spark, SF)).splitlines() if "hashpartitioning" in line]
    assert dealt_by and not any("p_brand" in line for line in dealt_by)


@pytest.mark.parametrize("step", [reader._stories, catalogue._tagged, catalogue.QUERIES["q2_tag_month_cube"]])
def test_dealt_by_size(spark, monkeypatch, step):
    rows = lambda: sorted(map(repr, step(spark, SF).collect()))
    few = rows()
    monkeypatch.setattr(keyed, "PORTION", 1 << 14)
    assert keyed.portions(catalogue._t(spark, SF, "lineitem")) > 4 and rows() == few
