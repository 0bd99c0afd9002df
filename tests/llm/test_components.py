"""Connected components: stars need no further step, chains end right."""

from __future__ import annotations

import pytest
from gaugeworks.llm import common


@pytest.fixture
def written(monkeypatch):
    tables = []
    keep = common.materialised
    monkeypatch.setattr(common, "materialised", lambda df: tables.append(df) or keep(df))
    return tables


def test_stars_are_not_stepped_through_again(spark, written):
    links = spark.createDataFrame([(5, 1), (2, 1), (1, 9), (8, 7), (3, 3)], "a long, b long")
    found = {tuple(r) for r in common.components(links).collect()}
    assert found == {(1, 1), (2, 1), (5, 1), (9, 1), (7, 7), (8, 7)}
    assert len(written) == 1


def test_chains_and_rings_end_as_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 103), (103, 101), (101, 102), (102, 100)] + [(60, 50), (60, 51)]
    found = dict(tuple(r) for r in common.components(spark.createDataFrame(links, "a long, b long")).collect())
    assert found == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 104)} | {50: 50, 51: 50, 60: 50}


def test_no_links(spark):
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
