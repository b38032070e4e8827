"""Versions of row sets: guarded replacement, restoring, dense ids, and two writers of one table."""

import random

import pytest
from pyspark.sql import functions as F

from larkspan.operators import versions as V

ITEMS = "id long, owner long, position int, name string, price double"
SNAPSHOTS = "owner long, version int, action string, snapshot string"


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, 10, 1, "pipe", 2.5), (2, 10, 2, None, None), (3, 20, 1, "tap", 1.0), (4, 30, 1, "pump", 9.0)], ITEMS)


def rows(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=str)


def test_only_unchanged_owners_are_replaced(spark, items):
    base = V.digests(items).unionByName(spark.createDataFrame([(40, None)], "owner long, digest string"))
    changed = items.withColumn("price", F.when(F.col("owner") == 20, 7.0).otherwise(F.col("price")))
    new = spark.createDataFrame([(10, 1, "pipe 2", 3.0), (20, 1, "lost", 0.0), (40, 2, "b", 1.0), (40, 1, "a", 1.0), (99, 1, "unasked", 1.0)], "owner long, position int, name string, price double")
    after, snapshots, conflicts = V.replaced(changed, spark.createDataFrame([(10, 4, "old", "[]")], SNAPSHOTS), base, new)
    assert rows(conflicts) == [(20,)]
    # The replacement of 30 is empty; 40 had no items and takes them.
    assert rows(after, "id", "owner", "name") == [(3, 20, "tap"), (5, 10, "pipe 2"), (6, 40, "a"), (7, 40, "b")]
    assert rows(snapshots, "owner", "version", "action") == [(10, 4, "old"), (10, 5, "before_reparse"), (30, 1, "before_reparse")]


def test_restoring(spark, items):
    base = V.digests(items.where("owner = 10"))
    new = spark.createDataFrame([(10, 1, "pipe 2", 3.0)], "owner long, position int, name string, price double")
    after, snapshots, _ = V.replaced(items, spark.createDataFrame([], SNAPSHOTS), base, new)
    chosen = spark.createDataFrame([(10, 1), (10, 1), (20, 8)], "owner long, version int")
    back, taken = V.restored(after, snapshots, chosen)
    assert rows(back.where("owner = 10")) == [(6, 10, 1, "pipe", 2.5), (7, 10, 2, None, None)] and back.count() == 4
    assert rows(taken, "owner", "version", "action") == [(10, 1, "before_reparse"), (10, 2, "before_rollback")]
    own, _ = V.restored(after, snapshots, chosen, new_ids=False)
    assert rows(own) == rows(items)
    assert V.restored(after, snapshots.where("false"), chosen)[0].count() == after.count()


def test_dense_ids(spark):
    r = random.Random(2)
    values = [(r.randint(0, 5), i) for i in range(500)]
    got = V.dense_ids(spark.createDataFrame(values, "a int, b int").repartition(7), "a", "b", after=100).collect()
    assert [(x["a"], x["b"]) for x in sorted(got, key=lambda x: x["id"])] == sorted(values) and sorted(x["id"] for x in got) == list(range(101, 601))
    assert V.dense_ids(spark.createDataFrame([], "a int, b int"), "a").count() == 0


def test_two_writers(spark, items, tmp_path):
    folder = str(tmp_path / "table")
    assert V.newest(spark, folder) == 0 and V.commit(spark, folder, 0, items=items) == 1
    mine = V.version(spark, folder, 1, "items").where("owner = 10")
    theirs = V.version(spark, folder, 1, "items").where("owner = 20")
    assert V.commit(spark, folder, 1, items=theirs, snapshots=items.limit(1)) == 2
    with pytest.raises(V.Conflict):
        V.commit(spark, folder, 1, items=mine)
    assert V.newest(spark, folder) == 2 and rows(V.version(spark, folder, 2, "items"), "owner") == [(20,)] and V.version(spark, folder, 1, "items").count() == 4
    # A writer that has looked before the other one committed meets its file.
    seen = V.newest
    V.newest = lambda *_: 1
    try:
        with pytest.raises(V.Conflict):
            V.commit(spark, folder, 1, items=mine)
    finally:
        V.newest = seen
    assert len(list((tmp_path / "table" / "data").iterdir())) == 2
