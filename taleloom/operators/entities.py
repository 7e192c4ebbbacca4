"""Entity resolution: claims that share a normalized name or alias are one entity."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import cut_lineage
from .archive import ARC

KEY = [ARC, "kind"]


def connected_labels(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest node of each connected component: (keys, node, label), from undirected edges (keys, a, b).

    Every round takes the smallest label among a node and its neighbours and then follows labels of labels, so a chain
    of n nodes settles in about log n rounds. Each round is checkpointed.
    """
    both = edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = cut_lineage(both)
    labels = cut_lineage(both.groupBy(*keys, F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(labels.select(*keys, F.col("node").alias("b"), "label"), [*keys, "b"])
        near = near.groupBy(*keys, F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, [*keys, "node"]).withColumn("low", F.least("label", "near"))
        jump = labels.select(*keys, F.col("node").alias("low"), F.col("label").alias("far"))
        step = step.join(jump, [*keys, "low"], "left")
        new = cut_lineage(step.select(*keys, "node", F.least("low", F.coalesce("far", "low")).alias("label"), (F.least("low", F.coalesce("far", "low")) != F.col("label")).alias("moved")))
        labels = new.drop("moved")
        if new.where("moved").isEmpty():
            return labels


def resolve_entities(claims: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Claims (archive_id, kind, claim_id, name, relation, aliases) to (entities, aliases, claim → entity).

    The result does not depend on the order in which claims arrive, except that ties on names go to the lowest claim_id.
    """
    c = claims.withColumn("norm", X.normalize("name")).where(F.col("norm") != "")
    alias = c.select(*KEY, "claim_id", "norm", F.explode("aliases").alias("alias")).withColumn("alias_norm", X.normalize("alias"))
    edges = c.select(*KEY, F.col("norm").alias("a"), F.col("norm").alias("b")).unionByName(
        alias.where(F.col("alias_norm") != "").select(*KEY, F.col("norm").alias("a"), F.col("alias_norm").alias("b"))
    ).distinct()
    labels = connected_labels(edges, KEY).withColumnRenamed("label", "norm_root")
    linked = c.join(labels.withColumnRenamed("node", "norm"), [*KEY, "norm"])
    entity_id = F.xxhash64(ARC, "kind", "norm_root")
    linked = linked.withColumn("entity_id", entity_id)
    shouted = F.col("name") == F.upper("name")
    entities = linked.groupBy(*KEY, "entity_id").agg(
        F.min_by("name", F.struct(shouted, F.col("claim_id"))).alias("name"), F.min_by("norm", "claim_id").alias("norm"),
        F.min_by("relation", F.when(F.col("relation").isNotNull(), F.col("claim_id"))).alias("relation"),
    )
    named = alias.join(labels.withColumnRenamed("node", "norm"), [*KEY, "norm"]).withColumn("entity_id", entity_id)
    aliases = named.select(*KEY, "entity_id", "alias").distinct()
    return entities, aliases, linked.select(*KEY, "claim_id", "entity_id")


def with_aliases(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entities with their distinct spellings as an array, for consumers that need the nested form."""
    a = aliases.groupBy(*KEY, "entity_id").agg(F.array_sort(F.collect_set("alias")).alias("aliases"))
    return entities.join(a, [*KEY, "entity_id"], "left").withColumn("aliases", F.coalesce("aliases", F.array().cast("array<string>")))
