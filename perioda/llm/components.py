"""Connected components by hooking and contraction, a written table a round."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from perioda.session import written


def component_labels(links: DataFrame) -> DataFrame:
    """(node, label) for every node of the links (a, b); equal labels in a component.

    Each round every node takes its smallest neighbour, or itself, as parent,
    and its parent's parent as label; then links run between labels, those
    inside one go, and what is left goes to the next round.  At least one of
    the two ends of every link gets a smaller label, so the rounds end, and
    rounds are few, as trees are contracted at once.  Every table is written
    to the shared folder, so lost executors cost one round at most.
    """
    links = written(links.filter("a <> b").select("a", "b"), "links")
    labels = None
    while not links.isEmpty():
        ends = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        parents = written(parents.select("node", F.least("node", "low").alias("label")), "parents")
        above = parents.select(F.col("node").alias("label"), F.col("label").alias("top"))
        jumped = written(parents.join(above, "label").select("node", F.col("top").alias("label")), "jumped")
        if labels is None:
            labels = jumped
        else:
            step = jumped.select(F.col("node").alias("label"), F.col("label").alias("top"))
            labels = labels.join(step, "label", "left")
            labels = written(labels.select("node", F.coalesce("top", "label").alias("label")), "labels")
        for end in ("a", "b"):
            other = "b" if end == "a" else "a"
            step = jumped.select(F.col("node").alias(end), "label")
            links = links.join(step, end).select(F.col("label").alias(end), other)
        links = written(links.filter("a <> b").select("a", "b").distinct(), "links")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels
