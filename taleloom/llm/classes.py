"""Classes of linked nodes: connected components, labels, and labels after more links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) of the nodes in written edges (a, b): comp is the least node that is connected. Labels go over the edges and then jump to their labels'
    labels, so long chains settle in few rounds; each round is written."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")))
    while True:
        heard = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("comp").alias("heard"))
        nearer = labels.join(heard, labels["node"] == heard["a"]).select("node", "comp", F.least("comp", "heard").alias("next"))
        onward = labels.select(F.col("node").alias("_n"), F.col("comp").alias("_c"))
        jumped = stored(nearer.join(onward, nearer["next"] == onward["_n"], "left").select("node", F.coalesce(F.least("next", "_c"), "next").alias("comp"), F.col("comp").alias("was")))
        labels = jumped.select("node", "comp")
        if jumped.where("comp <> was").isEmpty():
            return labels


def _labelled(df: DataFrame, comps: DataFrame, name: str, label: str) -> DataFrame:
    known = comps.select(F.col("node").alias("_node"), F.col("comp").alias("_comp"))
    return df.join(known, F.col(name) == F.col("_node"), "left").withColumn(label, F.coalesce("_comp", name)).drop("_node", "_comp")


def _merged(comps: DataFrame | None, found: DataFrame) -> DataFrame:
    """Labels after more links, found as rows of a written table: only the classes that the links connect are labelled anew."""
    if comps is None:
        return components(found)
    between = _labelled(_labelled(found, comps, "a", "ca"), comps, "b", "cb").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    between = stored(between.distinct())
    if between.isEmpty():
        return comps
    anew = components(between)
    nodes = comps.union(anew.join(comps, "node", "left_anti").select("node", F.col("node").alias("comp")))
    target = anew.select(F.col("node").alias("_from"), F.col("comp").alias("_to"))
    return stored(nodes.join(target, nodes["comp"] == target["_from"], "left").select("node", F.coalesce("_to", "comp").alias("comp")))


def _chosen(step: int):
    """Some 2 ** step members of each bucket of n members, or all; those of a smaller step are among them."""
    return F.expr(f"pmod(xxhash64(id), shiftleft(1L, greatest(length(bin(n)) - {step}, 0))) = 0")
