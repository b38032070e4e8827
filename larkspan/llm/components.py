"""Connected components on DataFrames by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.llm.common import discard, written


#: Edges (16 bytes each) for which a round takes one partition more.
EDGES = 100_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a long, b long): root is the smallest node it reaches.

    Each round rewires every node to the smallest neighbour it knows; the edge
    set is written to the shared folder, so plans stay short.  Minima are
    aggregated map-side, so a node with very many neighbours costs one row a
    partition there.  A round reads its edges in as many partitions as their
    number asks for: few thousand edges are not dealt over hundreds of tasks in
    every step.  Repeated edges, loops and empty tables are allowed.
    """
    table = written(edges.where("a <> b").selectExpr("greatest(a, b) AS a", "least(a, b) AS b").distinct(), "edges")
    parts = 1 + table.count() // EDGES  # rounds add no edges
    while True:
        now = table.coalesce(parts)
        ends = now.selectExpr("inline(array(struct(a AS node, 1 AS up, 0 AS down), struct(b AS node, 0 AS up, 1 AS down)))")
        if ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up = 1 AND down = 1").isEmpty():  # stars, all of them
            return now.selectExpr("inline(array(struct(a AS node, b AS root), struct(b AS node, b AS root)))").distinct()
        both = now.selectExpr("inline(array(struct(a, b), struct(b AS a, a AS b)))")
        least = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a", "least(a, m) AS m")
        large = both.where("b > a").join(least, "a").selectExpr("b AS a", "m AS b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").selectExpr("b AS a", "m AS b").unionByName(least.selectExpr("a", "m AS b"))
        old, table = table, written(small.where("a <> b").coalesce(parts).distinct(), "edges")
        discard(old)
