"""Distributed union-find over DataFrames: alternating large-star and small-star rounds, one aggregation and one join each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import persist

FEW_EDGES = 100_000  # two numbers an edge: a task holds them all


def together(rows: DataFrame) -> DataFrame:
    """``rows`` in one partition, whose groupings and joins need no shuffle."""
    return rows.coalesce(1)


def dealt_by(count: int) -> Callable[[DataFrame], DataFrame]:
    """How to deal out so many rows: up to ``FEW_EDGES`` in one partition, more as they are."""
    return together if count <= FEW_EDGES else lambda rows: rows


def _unsettled(edges: DataFrame, deal: Callable[[DataFrame], DataFrame]) -> bool:
    """Whether some node has two parents, or a parent has one itself."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    by_node = deal(ends).groupBy("n").agg(F.sum("up").alias("ups"), F.max("down").alias("down"))
    return not by_node.where((F.col("ups") > 1) | (F.col("ups") + F.col("down") > 1)).isEmpty()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); the component is its least node. Loops and repeats are
    ignored, nulls too; no edge gives no row.

    Nodes are only ever compared with the least of their neighbours, an aggregation that sums up before it shuffles, so a
    node that a third of all edges meet is never collected. Each round is written to the shared folder; the rounds end when
    every node hangs on the root of its component, which is checked exactly. A round of up to ``FEW_EDGES`` edges is one task: dealt
    out, it is seven shuffles, whose tasks cost the driver more memory than the edges take.
    """
    now = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = persist(now, "components")
    deal = dealt_by(now.count())
    for _ in range(rounds):
        if not _unsettled(now, deal):
            break
        both = deal(now.select(F.col("u").alias("n"), F.col("v").alias("m")).unionAll(now.select(F.col("v").alias("n"), F.col("u").alias("m"))))
        least = both.groupBy("n").agg(F.min("m").alias("lo")).select("n", F.least("lo", "n").alias("lo"))
        large = both.join(least, "n").where(F.col("m") > F.col("n")).select(F.col("m").alias("u"), F.col("lo").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("lo"))
        rest = large.join(least, "u").where(F.col("v") != F.col("lo")).select(F.col("v").alias("u"), F.col("lo").alias("v"))
        now = persist(deal(least.select("u", F.col("lo").alias("v")).unionAll(rest)).distinct(), "components")
    else:
        raise RuntimeError(f"components have not settled in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
