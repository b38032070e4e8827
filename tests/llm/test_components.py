"""Connected components: tasks of few edges, rounds over many partitions."""

import uuid

import numpy as np

from larkspan.llm import components as module


def _roots(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        u, v = find(a), find(b)
        root[max(u, v)] = min(u, v)
    return {x: find(x) for e in edges if e[0] != e[1] for x in e}


def _edges():
    r = np.random.default_rng(7)
    chain = [(i, i + 1) for i in range(1, 60)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    loose = [(int(a), int(b)) for a, b in r.integers(2000, 2200, (120, 2))]
    return [*chain, *star, *loose, (5, 4), (7, 7), (30, 31), (1079, 60)]


def test_few_edges_are_not_dealt_over_all_partitions(spark):
    context, edges, before = spark.sparkContext, _edges(), spark.conf.get("spark.sql.shuffle.partitions")
    settings = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    group = uuid.uuid4().hex
    for k, v in settings.items():
        spark.conf.set(k, v)
    context.setJobGroup(group, "components")
    try:
        got = {r["node"]: r["root"] for r in module.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == _roots(edges)
    status = context.statusTracker()
    tasks = sum(status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup(group) for s in status.getJobInfo(j).stageIds if status.getStageInfo(s))
    assert 0 < tasks < 600, tasks


def test_rounds_over_several_partitions_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(module, "EDGES", 40)
    edges = _edges()
    rows = [tuple(r) for r in module.components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert len(rows) == len(set(rows)) and dict(rows) == _roots(edges)
