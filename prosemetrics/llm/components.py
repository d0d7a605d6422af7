"""Connected components of large, sparse graphs by labels that hook and jump."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosemetrics.llm.shared import stored


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``edges`` (columns ``a`` and ``b``, whole numbers).

    The label is the smallest node that can be reached.  In a round each node takes the least label
    among its neighbours', so does the node that its label names, and then labels are replaced by
    their own labels; the number of rounds grows with the logarithm of the longest path.  Every
    round is stored.  A node with very many edges is summed up before the shuffle, and its joins
    are sort-merge joins of stored tables, whose large partitions adaptive execution splits.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both.filter("a <> b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        of_a = labels.select(F.col("node").alias("a"), F.col("label").alias("la"))
        of_b = labels.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        ends = both.join(of_a, "a").join(of_b, "b").filter("la <> lb")
        open_edges = stored(ends.select("a", "la", "lb"), "open")
        if open_edges.isEmpty():
            return labels
        offers = open_edges.select(F.explode(F.array("a", "la")).alias("node"), F.col("lb").alias("label"))
        offers = offers.unionByName(labels)
        hooked = stored(offers.groupBy("node").agg(F.min("label").alias("label")), "hooked")
        targets = hooked.select(F.col("node").alias("label"), F.col("label").alias("next"))
        labels = stored(hooked.join(targets, "label").select("node", F.least("label", "next").alias("label")), "labels")
