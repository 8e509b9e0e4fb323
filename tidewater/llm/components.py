"""Connected components of a link table by repeated joins; nothing is gathered on the driver or in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewater.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links(a, b); label is the smallest node reachable.

    Each round takes the smallest label among neighbours, gives it to the node's current label too, so that whole trees
    are hooked at once, and then takes the label of that label, so that chains shorten by doubling. Labels only fall, and
    rounds go on until none does: then the labels of linked nodes are equal. A path of 1,000 nodes in any order takes
    some 13 rounds. Self links and repeated links do no harm, links with a null end are ignored, and no links give no rows.
    """
    links = links.where("a is not null and b is not null")
    both = materialize(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = (
            both.join(labels.withColumnRenamed("node", "b"), "b")
            .groupBy(F.col("a").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        met = labels.join(near, "node").select("node", "label", "near")  # every node has a neighbour
        hooks = met.where("near < label").select(F.col("label").alias("node"), F.lit(None).alias("was"), F.col("near").alias("label"))
        stepped = met.select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")).unionByName(hooks)
        stepped = stepped.groupBy("node").agg(F.max("was").alias("was"), F.min("label").alias("label"))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("up"))
        seen = Observation()
        stepped = stepped.join(up, "label", "left").select("node", F.least("label", "up").alias("label"), "was")
        stepped = stepped.observe(seen, F.sum((F.col("label") < F.col("was")).cast("long")).alias("moved"))
        labels = materialize(stepped, "labels").select("node", "label")
        if not seen.get["moved"]:
            return labels


def extended(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels(node, label) of some links, made those of links(a, b) too.

    Only the links between different labels are followed, with labels for nodes, so a few more links are little work. A
    node without a label is its own.
    """
    of = lambda end: labels.select(F.col("node").alias(end), F.col("label").alias(f"label_{end}"))
    met = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    met = met.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b"))
    seen = Observation()
    across = materialize(met.where("a <> b").distinct().observe(seen, F.count(F.lit(1)).alias("links")), "across")
    if not seen.get["links"]:
        return labels
    roots = connected_components(across)
    moved = labels.join(roots.select(F.col("node").alias("label"), F.col("label").alias("root")), "label", "left")
    every = moved.select("node", F.coalesce("root", "label").alias("label")).unionByName(roots)
    return materialize(every.groupBy("node").agg(F.min("label").alias("label")), "labels")
