"""All registered queries beside their SQL, and what their plans may not hold."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from compare import compare, connect

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_equals_sql(spark, duck, name):
    wrong, rows, _, _, widths = compare(spark, duck, FOLDER, name, entry.queries()[name], entry.oracle_sql().get(name))
    assert wrong is None, wrong
    assert rows > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1


INVENTORY = {"s": 12, "p": 11, "l": 8, "a": 12, "v": 10, "j": 5, "k": 5, "c": 6, "m": 11, "t": 7, "u": 3}


def test_every_inventory_row_has_a_query():
    ids = {name.split("_")[0] for name in entry.queries()}
    wanted = {f"{family}{i}" for family, n in INVENTORY.items() for i in range(1, n + 1)}
    assert wanted - ids == set()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j1_knn", "t1_positive_pairs", "l6_three_way_split", "a8_length_histogram", "v10_tfidf"])
def test_no_cross_joins(spark, name):
    text = plan(entry.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_neighbour_merge_prunes_before_its_shuffle(spark):
    assert "WindowGroupLimit" in plan(entry.queries()["j1_knn"](spark, FOLDER))


def test_cuts_read_narrow_columns_and_keep_texts_in_place(spark):
    text = plan(entry.queries()["l1_sample"](spark, FOLDER))
    # The text is read by the one scan that yields the rows; the cut point is a staged table of one row.
    assert text.count("text:string") == 1
    assert "Exchange hashpartitioning" not in text and "Exchange range" not in text
