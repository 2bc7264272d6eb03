"""Connected components of a distributed edge list by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fairlead.llm.common import materialize, release


def least_labels(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of the edges (a, b); root is the least node of its component.

    Each round gives a node the least label among its own and its neighbours', then follows that label once to the
    label it has itself. Labels only fall, so the loop ends; each round's labels are a table in the shared folder.
    """
    both = materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct(), f"{name}-edges")
    labels = materialize(both.groupBy("node").agg(F.min("other").alias("near")).select("node", F.least("node", "near").alias("root")), f"{name}-labels")
    table = labels
    while True:
        of = labels.select(F.col("node").alias("other"), F.col("root").alias("seen"))
        near = both.join(of, "other").groupBy("node").agg(F.min("seen").alias("seen"))
        fell = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("root"))
        jump = labels.select(F.col("node").alias("root"), F.col("root").alias("further"))
        after = materialize(fell.join(jump, "root", "left").select("node", "old", F.least("root", "further").alias("root")), f"{name}-labels")
        moved = after.filter("root <> old").limit(1).count()
        release(table)
        labels, table = after.select("node", "root"), after
        if not moved:
            release(both)
            return labels
