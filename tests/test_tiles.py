"""Sums that remember which tiles they have taken."""

from acacia.operators import merge

TILES = "park_id string, tile string, built double, share double"


def test_a_tile_counts_once(spark):
    target = spark.createDataFrame([("a", 5.0, 0.5, 1), ("z", 1.0, None, 2)], "park_id string, built double, share double, tiles_available long")
    taken = spark.createDataFrame([("a", "t1"), ("z", "t1"), ("z", "t2")], "park_id string, tile string")
    first = spark.createDataFrame([("a", "t1", 5.0, 0.5), ("a", "t2", 2.0, 0.2), ("a", "t2", 2.0, 0.2), ("b", "t9", 7.0, None), ("b", "t1", None, 0.1), (None, "t1", 3.0, 0.3), ("c", None, 4.0, 0.4)], TILES)
    want = {("a", 7.0, 0.5, 2), ("z", 1.0, None, 2), ("b", 7.0, 0.1, 2), (None, 3.0, 0.3, 1), ("c", 4.0, 0.4, 1)}
    grown, ledger = merge.add_tiles(target, taken, first, "park_id", ["built"], ["share"])
    assert set(map(tuple, grown.collect())) == want and ledger.count() == 8
    again, same = merge.add_tiles(grown, ledger, first, "park_id", ["built"], ["share"])
    assert set(map(tuple, again.collect())) == want and same.count() == 8
    later, _ = merge.add_tiles(grown, ledger, first.selectExpr("park_id", "concat(tile, 'x') as tile", "built", "0.9D as share").where("park_id = 'a'"), "park_id", ["built"], ["share"])
    assert {tuple(r) for r in later.collect() if r[0] == "a"} == {("a", 14.0, 0.5, 4)}
    assert merge.add_tiles(target.limit(0), taken.limit(0), first.limit(0), "park_id", ["built"], ["share"])[0].collect() == []
