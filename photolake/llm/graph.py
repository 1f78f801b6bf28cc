"""Connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from photolake.llm.base import written


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) -> (node, root): the least node of each node's component; nodes without edges do not appear.

    Alternating stars: neighbours above a node are tied to the least neighbour, then neighbours below it, until nothing
    changes; about log(nodes) rounds whatever the shape. A hub's edges are joined with its least neighbour, never
    gathered, and every round is written in the shared folder.
    """
    now = written(edges.where("u <> v").selectExpr("greatest(u, v) AS u", "least(u, v) AS v").distinct())
    state = _state(now)
    while True:
        both = now.unionByName(now.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").selectExpr("v AS u", "m AS v").unionByName(
            least.selectExpr("u", "m AS v"))
        now = written(small.where("u <> v").distinct())
        before, state = state, _state(now)
        if state == before:
            roots = now.select("v").distinct().selectExpr("v AS node", "v AS root")
            return now.selectExpr("u AS node", "v AS root").unionByName(roots)
