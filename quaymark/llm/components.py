"""Connected components of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quaymark.llm.text import dropped, stored


def components(links: DataFrame) -> DataFrame:
    """node and component (the smallest node reachable) of every node in links (a, b).

    Every round takes the smallest label among neighbours (combined before the shuffle) and
    then the label's own label, so a chain of n nodes takes about log n rounds.  Each round is
    written to the shared folder and replaces the last one; the driver sees one count a round,
    observed as it is written (a task that runs twice may add to it, but never makes it zero).
    """
    pairs = links.select(F.col("a").alias("node"), F.col("b").alias("other")).filter("node <> other")
    both = stored(pairs.union(pairs.select("other", "node")).distinct(), "links")
    labels = stored(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), "component"), "other").groupBy("node").agg(F.min("component").alias("near"))
        better = labels.join(near, "node").select("node", F.least("component", "near").alias("label"), F.col("component").alias("old"))
        jumped = better.join(labels.select(F.col("node").alias("label"), F.col("component").alias("next")), "label", "left")
        new = jumped.select("node", F.least("label", F.coalesce("next", "label")).alias("component"), "old")
        seen = Observation()
        new = stored(new.observe(seen, F.count(F.when(F.col("component") != F.col("old"), 1)).alias("moved")), "labels")
        dropped(labels)
        labels = new.select("node", "component")
        if not seen.get["moved"]:
            dropped(both)
            return labels
