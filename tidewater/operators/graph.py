"""Knowledge graph: entities ``(id, type, ...)`` and relationships ``(id, src, dst, type, weight, bidirectional)``."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.operators.store import NotFound, RecordError, unique
from tidewater.plans.ranks import running_total
from tidewater.plans.scratch import durable


@dataclass(frozen=True)
class Traversal:
    """How far and along what a traversal goes."""

    depth: int = 3
    #: Nodes shown at most; 0 means the default, None no limit.
    max_nodes: int | None = 100
    direction: str = "both"
    relation_types: tuple[str, ...] = ()
    entity_types: tuple[str, ...] = ()
    min_weight: float = 0.0


def steps(edges: DataFrame, t: Traversal) -> DataFrame:
    """Rows ``(edge, here, there, kind)`` along which a traversal moves; bidirectional edges go both ways in any direction."""
    e = edges.where(F.col("weight") >= t.min_weight)
    if t.relation_types:
        e = e.where(F.col("type").isin(*t.relation_types))
    way = lambda a, b, rank: e.select(F.col("id").alias("edge"), F.col(a).alias("here"), F.col(b).alias("there"), F.lit(rank).alias("rank"), "bidirectional")
    forth, back = way("src", "dst", 0), way("dst", "src", 1)
    if t.direction == "outgoing":
        back = back.where("bidirectional")
    elif t.direction == "incoming":
        forth = forth.where("bidirectional")
    return forth.unionAll(back).drop("bidirectional")


def traverse(entities: DataFrame, edges: DataFrame, start: Sequence, t: Traversal = Traversal()) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of a breadth-first traversal: nodes with depth, edges met on the way, visited ends included.

    An entity-type filter hides nodes from the result but not from the walk.
    ``max_nodes`` counts shown nodes in queue order: depth, then the parent's
    place, then the edge.  Each level is a join of the frontier with the edges
    and an anti-join with what was seen.
    """
    spark = entities.sparkSession
    most = 100 if t.max_nodes == 0 else t.max_nodes
    along, known = steps(edges, t), entities.select("id", "type")
    first = spark.createDataFrame([(s, i) for i, s in enumerate(start)], f"id {entities.schema['id'].dataType.simpleString()}, place long").join(known, "id", "left_semi")
    frontier = durable(first.groupBy("id").agg(F.min("place").alias("place")).withColumn("depth", F.lit(0)), "frontier")
    seen, met = frontier, None
    for depth in range(1, t.depth + 1):
        out = frontier.select(F.col("id").alias("here"), "place").join(along, "here")
        met = out.select("edge") if met is None else met.unionAll(out.select("edge"))
        new = out.groupBy(F.col("there").alias("id")).agg(F.min(F.struct("place", "edge", "rank")).alias("by"))
        new = new.join(seen.select("id"), "id", "left_anti").join(known, "id", "left_semi")
        # Places only order a level; ties inside one parent go by edge.
        order = [F.col("by.place"), F.col("by.edge"), F.col("by.rank"), F.col("id")]
        placed = running_total(new, order, name="place") if most is not None else new.withColumn("place", F.lit(0).cast("long"))
        frontier = durable(placed.select("id", "place", F.lit(depth).alias("depth")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionAll(frontier)
    shown = seen.join(known, "id")
    if t.entity_types:
        shown = shown.where(F.col("type").isin(*t.entity_types))
    nodes = shown.orderBy("depth", "place", "id")
    if most is not None:
        nodes = nodes.limit(most)
    nodes = nodes.select("id", "type", "depth")
    met = edges.limit(0) if met is None else edges.join(met.distinct().withColumnRenamed("edge", "id"), "id", "left_semi")
    return nodes, met


def neighbours(edges: DataFrame, node: object, direction: str = "both") -> DataFrame:
    """Relationships of a node; a bidirectional one is in either list; each once."""
    out, into = F.col("src") == F.lit(node), F.col("dst") == F.lit(node)
    either = F.col("bidirectional") & (out | into)
    where = {"outgoing": out | either, "incoming": into | either}.get(direction, out | into)
    return edges.where(where).dropDuplicates(["id"])


def expand_search(hits: DataFrame, edges: DataFrame, t: Traversal = Traversal()) -> DataFrame:
    """Search hits ``(id, score)`` with their direct neighbours; always one hop, none at depth 0."""
    top = F.broadcast(hits.select("id", "score"))
    if t.depth <= 0:
        return top.withColumn("neighbours", F.array().cast("array<bigint>"))
    near = steps(edges, t).join(top, F.col("here") == F.col("id")).select("id", "there")
    lists = near.groupBy("id").agg(F.array_sort(F.collect_set("there")).alias("neighbours"))
    return hits.select("id", "score").join(lists, "id", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast(lists.schema["neighbours"].dataType)))


def stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts of entities and relationships by type."""
    count = lambda df, kind: df.groupBy("type").agg(F.count(F.lit(1)).alias("count")).select(F.lit(kind).alias("kind"), "type", "count")
    return count(entities, "entity").unionAll(count(edges, "relationship"))


def list_entities(entities: DataFrame, kind: str | None = None) -> DataFrame:
    return (entities.where(F.col("type") == kind) if kind else entities).orderBy("id")


def delete_entity(entities: DataFrame, edges: DataFrame, node: object) -> tuple[DataFrame, DataFrame]:
    """Both tables without the entity; its relationships go too."""
    gone = F.lit(node)
    return entities.where(F.col("id") != gone), edges.where((F.col("src") != gone) & (F.col("dst") != gone))


def add_entities(entities: DataFrame, new: DataFrame) -> DataFrame:
    """``entities`` with those of ``new``; raises if one is there already or comes twice."""
    if not unique(new, "id").join(entities.select("id"), "id", "left_semi").isEmpty():
        raise RecordError("an entity with this id exists")
    return entities.unionByName(new, allowMissingColumns=True)


def update_entity(entities: DataFrame, node: object, values: dict[str, Column]) -> DataFrame:
    """Values of one entity are replaced; raises NotFound without it."""
    get_entity(entities, node)
    which = F.col("id") == F.lit(node)
    return entities.withColumns({c: F.when(which, v).otherwise(F.col(c)) for c, v in values.items()})


def get_entity(entities: DataFrame, node: object) -> DataFrame:
    found = entities.where(F.col("id") == F.lit(node))
    if found.isEmpty():
        raise NotFound(f"entity {node}")
    return found


def get_relationship(edges: DataFrame, edge: object) -> DataFrame:
    found = edges.where(F.col("id") == F.lit(edge))
    if found.isEmpty():
        raise NotFound(f"relationship {edge}")
    return found


def delete_relationship(edges: DataFrame, edge: object) -> DataFrame:
    """``edges`` without one; raises NotFound if it is not there."""
    get_relationship(edges, edge)
    return edges.where(F.col("id") != F.lit(edge))


def add_relationships(entities: DataFrame, edges: DataFrame, new: DataFrame) -> DataFrame:
    """``edges`` with those of ``new`` whose ends exist and whose id is free; raises if an id comes twice."""
    new, ids = unique(new, "id"), entities.select("id")
    fit = new.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return edges.unionByName(fit.join(edges.select("id"), "id", "left_anti"))
