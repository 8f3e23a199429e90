"""Controlled corruptions of graphs, all graphs at once, sampled by a seeded hash so that every engine samples alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.graphs import EMISSION, all_nodes, degrees

SEED = "42"


def _draw(keys: list[str]) -> list[Column]:
    text = F.concat_ws("|", F.lit(SEED), *[F.col(k).cast("string") for k in keys], "source", "target")
    return [F.md5(text), F.col("source"), F.col("target")]


def drop_nodes(node_rows: DataFrame, edge_rows: DataFrame, share: float = 0.2, keys: list[str] = EMISSION) -> DataFrame:
    """(keys, id) of the nodes to remove: max(1, int(share * n)) of the highest degree, ties in order of appearance. Nodes
    that only edges name come last among ties."""
    order = all_nodes(node_rows, edge_rows, keys).join(node_rows.select(*keys, "id", "first_ord"), [*keys, "id"], "left")
    ranked = order.join(degrees(node_rows, edge_rows, keys), [*keys, "id"])
    w = Window.partitionBy(*keys)
    k = F.row_number().over(w.orderBy(F.desc("degree"), F.asc_nulls_last("first_ord"), "id"))
    count = F.greatest(F.lit(1), F.floor(F.lit(share) * F.count("*").over(w)))
    return ranked.withColumn("k", k).withColumn("c", count).where("k <= c").select(*keys, "id")


def without_nodes(edge_rows: DataFrame, dropped: DataFrame, keys: list[str] = EMISSION) -> DataFrame:
    """Edges of which neither end was dropped."""
    out = edge_rows.join(dropped.withColumnRenamed("id", "source"), [*keys, "source"], "left_anti")
    return out.join(dropped.withColumnRenamed("id", "target"), [*keys, "target"], "left_anti")


def sampled_edges(edge_rows: DataFrame, share: float = 0.3, keys: list[str] = EMISSION) -> DataFrame:
    """The edges with their rank and whether they are among the max(1, int(share * m)) drawn. A graph without edges has none."""
    w = Window.partitionBy(*keys)
    ranked = edge_rows.withColumn("rank", F.row_number().over(w.orderBy(*_draw(keys))))
    return ranked.withColumn("drawn", F.col("rank") <= F.greatest(F.lit(1), F.floor(F.lit(share) * F.count("*").over(w))))


def flip_edges(edge_rows: DataFrame, share: float = 0.3, keys: list[str] = EMISSION) -> DataFrame:
    """Edges after the drawn ones are reversed. Of an unordered pair: none drawn, as it was; one drawn, one edge, reversed,
    with the drawn one's attributes; both drawn, one edge in the first drawn one's original direction."""
    e = sampled_edges(edge_rows, share, keys)
    pair = [*keys, F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")]
    first = F.min_by(F.struct("source", "target", "relation_type"), F.when(F.col("drawn"), F.col("rank"))).alias("f")
    hit = e.groupBy(*pair).agg(F.sum(F.col("drawn").cast("int")).alias("n"), first)
    flipped = hit.where("n = 1").select(*keys, F.col("f.target").alias("source"), F.col("f.source").alias("target"), "f.relation_type")
    double = hit.where("n = 2").select(*keys, "f.source", "f.target", "f.relation_type")
    touched = hit.where("n > 0").select(*keys, "a", "b")
    rest = e.withColumn("a", F.least("source", "target")).withColumn("b", F.greatest("source", "target")).join(touched, [*keys, "a", "b"], "left_anti")
    return rest.select(*keys, "source", "target", "relation_type").unionByName(flipped).unionByName(double)


def fragment(edge_rows: DataFrame, share: float = 0.3, keys: list[str] = EMISSION) -> DataFrame:
    """Edges left when the drawn ones are removed."""
    return sampled_edges(edge_rows, share, keys).where("not drawn").drop("rank", "drawn")
