"""Searches by the inverted index against searches over all rows."""

import pytest

from acacia.operators import search

NAMES = ["Virunga", "virunga Nord", "Ísland", "ab", "a", "", None, "xYx.xyx", "Ünïted ünï", "Virunga", "naïve %_ \\", "a" * 300, "  ", "日本 park"]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, n, "Land" if i % 3 else None) for i, n in enumerate(NAMES)], "id int, name string, country string").repartition(3)


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    return search.NameIndex(spark, str(tmp_path_factory.mktemp("index")), 8).build(rows, ["name", "country"])


@pytest.mark.parametrize("query", ["virunga", "UNGA N", "ünï", "ÍS", "a", "ab", "xyx", "yx.x", "%_", "\\", "land", "aaaa", " ", "本", "nowhere", "", "x" * 50])
def test_same_rows(rows, index, query):
    for most in (3, 100):
        want = search.matches(rows, ["name", "country"], query, most, ["id"], "k").collect()
        assert search.matches(index.candidates(query), ["name", "country"], query, most, ["id"], "k").collect() == want


def test_reads_one_run(index):
    """The scan is pruned to the part of the rarest run, and the run is pushed down to the files."""
    found = index.candidates("virunga nord")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "gram" in plan.split("PushedFilters: [")[1].split("]")[0]
    assert len(found.collect()) == 1 and "Exchange" not in plan


def test_no_rows_and_clashes(spark, rows, tmp_path):
    index = search.NameIndex(spark, str(tmp_path)).build(rows.limit(0), ["name"])
    assert index.candidates("a").collect() == [] == index.candidates("").collect()
    with pytest.raises(ValueError):
        search.NameIndex(spark, str(tmp_path)).build(rows.withColumnRenamed("id", "part"), ["name"])
