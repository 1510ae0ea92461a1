"""Connected components over an edge table, as a loop of DataFrame joins.

Alternating large-star and small-star steps: each node hands its larger
neighbours (then its smaller ones) to the smallest node it knows. Labels only
ever fall, the number of edges never grows, and a component ends as a star
around its smallest node. Nothing is collected: each step is one aggregation
by node (combined before the shuffle) and one join, and lineage is cut by a
checkpoint in the shared folder.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelab.llm.common import checkpointed


def _smallest(pairs: DataFrame, tasks: int) -> DataFrame:
    """Per node u the smallest of u and its neighbours v."""
    return (pairs.groupBy("u").agg(F.min("v").alias("m")).coalesce(tasks)
            .select(F.col("u").alias("k"), F.least("u", "m").alias("m")))


def _large_star(edges: DataFrame, tasks: int) -> DataFrame:
    both = edges.select(F.explode(F.array(F.struct("u", "v"),
                                          F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    step = both.join(_smallest(both, tasks), F.col("u") == F.col("k")).where(F.col("v") > F.col("u"))
    return step.select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)


def _small_star(edges: DataFrame, tasks: int) -> DataFrame:
    step = edges.join(_smallest(edges, tasks), F.col("u") == F.col("k"))
    # every smaller neighbour, and the node itself, points at the smallest
    return (step.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
            .where(F.col("u") != F.col("v")).coalesce(tasks))


def _settled(edges: DataFrame, tasks: int) -> bool:
    """Whether every node either points at one centre or is a centre."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out")),
                                          F.struct(F.col("v").alias("node"), F.lit(0).alias("out")))).alias("e")).select("e.*")
    per = ends.groupBy("node").agg(F.sum("out").alias("n"), F.min("out").alias("least")).coalesce(tasks)
    return per.where((F.col("n") > 1) | ((F.col("n") > 0) & (F.col("least") == 0))).isEmpty()


def components(edges: DataFrame, u: str = "u", v: str = "v", max_steps: int = 60,
               rows_per_task: int = 50_000) -> DataFrame:
    """(node, component): each node of an edge with the smallest node reachable.

    Self-loops alone give a component of one; null ends are dropped. An empty
    table gives an empty table. Raises if ``max_steps`` do not suffice. Frames
    are read by one task per ``rows_per_task`` edges (or per shuffle partition,
    if those are fewer), so the many small late steps stay cheap."""
    raw = (edges.select(F.col(f"`{u}`").alias("u"), F.col(f"`{v}`").alias("v"))
           .where(F.col("u").isNotNull() & F.col("v").isNotNull()))
    now = checkpointed(raw.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    tasks = max(1, math.ceil(now.count() / rows_per_task))
    now = now.coalesce(tasks)
    loops = now.where(F.col("u") == F.col("v")).select(F.col("u").alias("node"))
    links = now.where(F.col("u") != F.col("v"))
    for _ in range(max_steps):
        if _settled(links, tasks):
            break
        links = checkpointed(_small_star(_large_star(links, tasks), tasks).distinct().coalesce(tasks))
    else:
        raise RuntimeError(f"components did not settle in {max_steps} steps")
    ends = links.select(F.explode(F.array("u", "v")).alias("node"), F.col("v").alias("component"))
    alone = loops.select("node", F.col("node").alias("component"))
    return (ends.union(alone).groupBy("node").agg(F.min("component").alias("component")).coalesce(tasks))
