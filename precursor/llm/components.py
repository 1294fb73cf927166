"""Connected components of an edge table by label propagation with shortcuts, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from precursor.llm.common import written

MAX_ROUNDS = 64


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge; the root is the smallest node of its component.

    Each round gives every node the smallest label among its own and its neighbours', then the label
    of that label (a shortcut), so long chains shrink by more than a step.  Labels and edges are
    written tables: a hub's join partition can be split, and its minimum is combined before the
    shuffle.  Only a count per round reaches the driver.  Self edges and repeated edges are allowed;
    an empty table gives no rows.
    """
    both = F.array(F.struct(F.col(a).alias("u"), F.col(b).alias("v")), F.struct(F.col(b).alias("u"), F.col(a).alias("v")))
    e = written(edges.select(F.explode(both).alias("e")).select("e.u", "e.v").distinct(), "cc-edges")
    labels = written(e.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("label")), "cc-labels")
    for _ in range(MAX_ROUNDS):
        seen = e.join(labels.select(F.col("u").alias("v"), "label"), "v").select("u", "label", F.lit(None).alias("own"))
        labels = written(seen.unionByName(labels.select("u", "label", F.col("label").alias("own"))).groupBy("u").agg(
            F.min("label").alias("label"), F.min("own").alias("own")), "cc-labels")
        if labels.where("label < own").agg(F.count("*")).first()[0] == 0:
            return labels.select(F.col("u").alias("node"), F.col("label").alias("root"))
        target = labels.select(F.col("u").alias("label"), F.col("label").alias("next"))
        labels = written(labels.select("u", "label").join(target, "label").select("u", F.col("next").alias("label")), "cc-labels")
    raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
