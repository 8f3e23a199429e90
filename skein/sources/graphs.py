"""Graph files: reading model answers and knowledge graphs, writing answers, graphs and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KGGEN = (
    "entities array<string>, edges array<string>, relations array<struct<subject:string,relation:string,object:string>>, "
    "entity_clusters map<string,array<string>>, edge_clusters map<string,array<string>>"
)


def read_graph_texts(spark: SparkSession, path: str) -> DataFrame:
    """(file, text): whole files of model answers. A missing path gives no rows."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    if not found:
        return spark.createDataFrame([], "file string, text string")
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def read_kggen(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Graphs of subject-relation-object triples with alias clusters, one file each or, without ``multi_line``, one line
    each. Endpoints need not be entities."""
    return spark.read.schema(KGGEN).json(path, multiLine=multi_line)


def triples(kggen: DataFrame) -> DataFrame:
    return kggen.select(F.explode("relations").alias("r")).select("r.subject", "r.relation", "r.object")


def aliases(kggen: DataFrame) -> DataFrame:
    """(canonical, alias) of the entity clusters."""
    return kggen.select(F.explode("entity_clusters").alias("canonical", "a")).select("canonical", F.explode("a").alias("alias"))


def export_rows(triple_rows: DataFrame) -> DataFrame:
    """(cluster_id, kind, item): the distinct entities, edge labels and triples of (cluster_id, source, relation, target),
    one row each, whatever the size of a cluster. Sorted order is a matter of writing: sort within range partitions."""
    part = lambda kind, c: triple_rows.select("cluster_id", F.lit(kind).alias("kind"), c.alias("item"))
    triple = F.to_json(F.struct(F.col("source").alias("subject"), "relation", F.col("target").alias("object")))
    every = part("entity", F.col("source")).unionByName(part("entity", F.col("target"))).unionByName(part("edge", F.col("relation"))).unionByName(part("relation", triple))
    return every.distinct()


def export_graph(triple_rows: DataFrame) -> DataFrame:
    """(cluster_id, entities, edges, relations): per cluster the sorted sets of names, labels and triples, of
    (cluster_id, source, relation, target). A cluster becomes one record, so this is for graphs of bounded size, such as
    those of a cluster's first documents; ``export_rows`` is for all others."""
    return triple_rows.groupBy("cluster_id").agg(
        F.array_sort(F.array_union(F.collect_set("source"), F.collect_set("target"))).alias("entities"),
        F.array_sort(F.collect_set("relation")).alias("edges"),
        F.array_sort(F.collect_set(F.struct(F.col("source").alias("subject"), "relation", F.col("target").alias("object")))).alias("relations"),
    )


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    """Records as JSON lines (responses, pipeline results, exported graphs)."""
    df.write.mode(mode).json(path)


def write_texts(df: DataFrame, column: str, path: str, mode: str = "error") -> None:
    """One column of raw model answers as text files."""
    df.select(column).write.mode(mode).text(path)


def write_graph(node_rows: DataFrame, edge_rows: DataFrame, path: str, mode: str = "error") -> None:
    """A graph as two parquet tables."""
    node_rows.write.mode(mode).parquet(f"{path}/nodes")
    edge_rows.write.mode(mode).parquet(f"{path}/edges")
