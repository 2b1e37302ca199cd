"""Connected components of a table of links, with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nightdesk.llm.store import written


def _jumped(hook: DataFrame, folder: str) -> DataFrame:
    """``comp, low`` with every chain of hooks followed to its end; each jump halves the chains."""
    turn = 0
    while True:
        turn += 1
        on = hook.select(F.col("comp").alias("via"), F.col("low").alias("further")).where("via != further")
        hook = written(
            hook.join(on, F.col("low") == F.col("via"), "left").select(
                "comp", F.coalesce("further", "low").alias("low"), F.col("further").isNotNull().alias("moved")
            ),
            f"{folder}/jump-{turn}",
        )
        if hook.where("moved").isEmpty():
            return hook.select("comp", "low")
        hook = hook.select("comp", "low")


def components(links: DataFrame, folder: str) -> DataFrame:
    """``node, comp`` for every node of a link ``a, b``: each component takes its smallest node.

    Every round hooks each component to its smallest neighbour, follows the hooks to their ends and
    relabels the links.  Hooks lead to smaller numbers, so they end, and a path of n components is
    done in one round of log n jumps.  All tables are written, so a lost executor costs one step.
    Links of a node with itself and repeated links change nothing; no links give no rows.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(both.where("a != b").distinct(), f"{folder}/edges-0")
    labels = written(edges.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct(), f"{folder}/labels-0")
    turn = 0
    while not edges.isEmpty():
        turn += 1
        hook = edges.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("comp"), F.least("a", "low").alias("low"))
        hook = _jumped(written(hook, f"{folder}/hook-{turn}"), f"{folder}/hook-{turn}-jumps")
        labels = written(
            labels.join(hook, "comp", "left").select("node", F.coalesce("low", "comp").alias("comp")), f"{folder}/labels-{turn}"
        )
        one = hook.select(F.col("comp").alias("a"), F.col("low").alias("x"))
        two = hook.select(F.col("comp").alias("b"), F.col("low").alias("y"))
        moved = edges.join(one, "a").join(two, "b").where("x != y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = written(moved.distinct(), f"{folder}/edges-{turn}")
    return labels
