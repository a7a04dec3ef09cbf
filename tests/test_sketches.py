"""Stored sketches: merging, bounds, odd levels, slices written twice."""

import pytest
from pyspark.sql import functions as F

from rowloom.operators import categories
from rowloom.session import fresh_path
from rowloom.sources import sketches

COLS = ["many", "few", "odd"]


@pytest.fixture(scope="module")
def table(spark):
    odd = F.element_at(F.array(F.lit(""), F.lit("NaN"), F.lit(None), F.lit("="), F.lit("é")), (F.col("id") % 5 + 1).cast("int"))
    return spark.range(0, 60000).select(
        (F.col("id") * 7 % 40000).alias("many"), (F.col("id") % 3).cast("double").alias("few"), odd.alias("odd"),
        F.when(F.col("id") % 4 > 0, F.col("id") % 4).alias("day"),
    )


def by_col(df):
    return {r["col"]: r for r in df.collect()}


def test_slices_merge_into_the_sketch_of_all_rows(table):
    whole = by_col(sketches.merged(sketches.column_sketches(table, COLS, 10), log_k=10))
    slices = by_col(sketches.merged(sketches.column_sketches(table, COLS, 10, by="day"), log_k=10))
    assert slices == whole


def test_counts_and_bounds(table):
    true = {r["col"]: r["n_distinct"] for r in categories.distinct_counts(table, COLS).collect()}
    got = by_col(sketches.estimates(sketches.column_sketches(table, COLS, 12, by="day"), 12))
    assert true == {"many": 40000, "few": 3, "odd": 4}
    assert {c: r["exact"] for c, r in got.items()} == {"many": False, "few": True, "odd": True}
    assert got["few"]["n_distinct"] == 3 and got["odd"]["n_distinct"] == 4
    assert got["many"]["low"] <= 40000 <= got["many"]["high"]
    assert got["many"]["high"] - got["many"]["low"] < 40000 * 9 * sketches.deviation(12)
    assert (got["odd"]["rows"], got["odd"]["nulls"]) == (60000, 12000)


def test_full_sketch_is_not_called_exact(spark):
    for n in (1023, 1024, 1025):
        r = sketches.estimates(sketches.column_sketches(spark.range(n), ["id"], 10), 10).first()
        assert r["exact"] == (n < 1024) and r["low"] <= n <= r["high"]


def test_store_replaces_a_slice_and_reads_some(spark, table):
    store = sketches.SketchStore(spark, fresh_path(spark, "test-sketches"))
    for _ in range(2):
        store.add(table, COLS, by="day")
    assert by_col(store.estimates())["many"]["rows"] == 60000
    assert by_col(store.estimates(["1", "3"]))["many"]["rows"] == 30000
    # rows without a slice are those of the slice without a name
    assert {r["slice"] for r in store.load().select("slice").distinct().collect()} == {"1", "2", "3", ""}
    assert by_col(store.estimates([""]))["many"]["rows"] == 15000
    store.add(table.where("day = 1").limit(10), COLS, name="1")
    assert by_col(store.estimates(["1"]))["few"]["rows"] == 10
    with pytest.raises(ValueError):
        store.add(table, COLS)


def test_overlap(table):
    left = sketches.column_sketches(table.where("many < 100"), COLS)
    right = sketches.column_sketches(table.where("many between 90 and 300 and few < 2"), COLS)
    got = by_col(sketches.level_overlap(left, right))
    mine = {r.many for r in table.where("many < 100").select("many").collect()}
    other = {r.many for r in table.where("many between 90 and 300 and few < 2").select("many").collect()}
    assert tuple(got["many"])[1:] == (len(mine), len(other), len(mine & other), len(other - mine))
    assert tuple(got["few"])[1:] == (3, 2, 2, 0)


def test_routing_counts_only_what_bounds_leave_open(table):
    states = sketches.column_sketches(table, COLS, 10, by="day")
    assert sketches.route_by_sketch(states, COLS, 4, log_k=10) == (["many", "odd"], ["few"])
    with pytest.raises(ValueError):
        sketches.route_by_sketch(states, COLS, 40000, log_k=10)
    assert sketches.route_by_sketch(states, COLS, 40000, table, 10) == (["many"], ["few", "odd"])
    assert sketches.route_by_sketch(states, COLS, 40001, table, 10) == ([], ["few", "many", "odd"])


def test_empty_table_and_wrong_sizes(spark, table):
    empty = table.where("many < 0")
    assert sketches.column_sketches(empty, COLS, by="day").count() == 0
    assert by_col(sketches.estimates(sketches.column_sketches(empty, COLS)))["odd"]["n_distinct"] == 0
    with pytest.raises(Exception, match="smaller"):
        sketches.estimates(sketches.column_sketches(table, COLS, 10), 12).collect()
