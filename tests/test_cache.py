"""Cache operators on small worked cases."""

from gradeloom.operators import cache

ENTRY = "entry_key long, size long, created_at long, last_access_at long, kind string"


def keys(df):
    return sorted(r["entry_key"] for r in df.collect())


def test_put_lookups_and_tiers(spark):
    stored = spark.createDataFrame([(1, 5, 0, 0, "a")], ENTRY)
    offered = spark.createDataFrame([(1, 9, 1, 1, "a"), (2, 7, 3, 3, "a"), (2, 6, 2, 2, "b")], ENTRY)
    assert [(r["entry_key"], r["size"]) for r in cache.put(stored, offered).collect()] == [(2, 6)]
    asked = spark.createDataFrame([(1, 10), (1, 12), (3, 11)], "entry_key long, ts long")
    assert sorted(map(tuple, cache.lookups(asked, stored).collect())) == [(1, 2, 0, 12), (3, 0, 1, None)]
    assert keys(cache.layered(stored, offered.where("size <> 6"))) == [1, 2]


def test_prune(spark):
    entries = spark.createDataFrame([(1, 10, 0, 1, "a"), (2, 10, 0, 2, "b"), (3, 10, 0, 3, "a"), (4, 10, 0, 4, None)], ENTRY)
    assert keys(cache.to_prune(entries)) == []
    assert keys(cache.to_prune(entries, accessed_before=3)) == [1, 2]
    assert keys(cache.to_prune(entries, accessed_before=3, kinds=("a",))) == [1]
    assert keys(cache.to_prune(entries, accessed_before=2, target=15)) == [1, 2, 3]
