"""Document clusters: reading them, and sinks for what is made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.text import members, strip_ws


def cluster_documents(clusters: DataFrame) -> DataFrame:
    """(row_id, cluster_id, document_index, text): the members of every delivery, stripped, blank ones dropped before
    numbering. Null documents have none."""
    return clusters.select("row_id", "cluster_id", F.posexplode(members(F.col("document"))).alias("document_index", "text"))


def clean_documents(documents: DataFrame, limit: int | None = 5) -> DataFrame:
    """(cluster_id, document_index, text): stripped, blank ones dropped, numbered anew, the first ``limit`` of each cluster."""
    text = strip_ws(F.col("text"))
    k = F.row_number().over(Window.partitionBy("cluster_id").orderBy("document_index"))
    rows = documents.select("cluster_id", "document_index", text.alias("text")).where("text <> ''").withColumn("k", k)
    if limit is not None:
        rows = rows.where(F.col("k") <= limit)
    return rows.select("cluster_id", (F.col("k") - 1).alias("document_index"), "text")


def join_documents(documents: DataFrame) -> DataFrame:
    """(cluster_id, document): the inverse of reading, for clusters small enough to be one text."""
    parts = F.array_sort(F.collect_list(F.struct("document_index", "text")))
    return documents.groupBy("cluster_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), "|||||").alias("document"))


def read_clusters(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Clusters (document, summary) in any format that Spark reads; row_id is made where there is none."""
    df = spark.read.format(fmt).load(path)
    if "row_id" not in df.columns:
        df = df.withColumn("row_id", F.monotonically_increasing_id())
    return df if "cluster_id" in df.columns else df.withColumn("cluster_id", F.format_string("c%08d", F.col("row_id")))
