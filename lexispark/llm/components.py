"""Connected components of a table of links, by label hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label) for each vertex of links (a, b); label is the smallest vertex of its component.

    In each round a vertex, and the label it has, take the smallest label of the vertex's neighbours;
    then labels are replaced by their own labels. Rounds are written to the shared folder
    and go on until none changes a label. A vertex with very many links meets them in
    sums that combine before the shuffle and in joins that Spark splits when skewed.
    """
    both = scratch.table(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).where("a <> b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("label"))
    labels = scratch.table(labels, "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"v": "b", "label": "lb"}), "b").join(labels.withColumnsRenamed({"v": "a", "label": "la"}), "a").where("lb < la")
        offers = near.select(F.explode(F.array("a", "la")).alias("v"), "lb").groupBy("v").agg(F.min("lb").alias("offer"))
        hooked = labels.join(offers, "v", "left").select("v", F.least("label", "offer").alias("label"), F.col("label").alias("was"))
        up = hooked.select(F.col("v").alias("label"), F.col("label").alias("top"))
        jumped = scratch.table(hooked.join(up, "label", "left").select("v", F.least("label", "top").alias("label"), "was"), "labels")
        labels = jumped.select("v", "label")
        if not jumped.where("label <> was").limit(1).count():
            return labels
