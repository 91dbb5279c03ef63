"""Connected components over an edge table, by label spreading with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, label): the smallest node that each node of ``edges`` (a, b, both long) reaches.

    Every round takes the smallest label among the neighbours (a grouped minimum, combined before the
    shuffle; the join that brings labels to edges deals by node, and adaptive execution splits it where
    a node has very many neighbours) and then jumps to that label's own label, so paths halve. Tables of
    earlier rounds are deleted. Ends when nothing changes; raises if it has not ended after ``max_rounds``,
    which a path of over 2**max_rounds nodes would need. An empty edge table gives an empty result; loops
    and repeated edges do no harm; rows with a null end are ignored.
    """
    edges = edges.where("a is not null and b is not null and a <> b")
    both = saved(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = saved(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.select("node", "label").join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        step = saved(step, "step")
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = step.join(jump, "label", "left").select("node", F.least(F.coalesce("next", "label"), "label").alias("label"), "old")
        before, after = labels, saved(after, "labels")
        settled = after.where("label <> old").isEmpty()
        discard(step, before)
        labels = after
        if settled:
            discard(both)
            return labels.select("node", "label")
    raise RuntimeError("components did not settle")
