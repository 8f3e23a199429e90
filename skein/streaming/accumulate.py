"""Accumulating extractions as they arrive: the merge's aggregates are maxima, minima and first occurrences, so a batch
of new entities merges into the state table by the same grouped aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def partial_entities(entities: DataFrame) -> DataFrame:
    """(cluster_id, key, first, document_frequency, confidence): mergeable state of new entity rows."""
    first = F.min(F.struct("emission", "ord", "entity_pk", "id", "name", "type")).alias("first")
    rows = entities.where("name is not null").withColumn("key", F.lower("name"))
    return rows.groupBy("cluster_id", "key").agg(first, F.max(F.coalesce("document_frequency", F.lit(1))).alias("document_frequency"), F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence"))


def merge_state(state: DataFrame, new: DataFrame) -> DataFrame:
    return state.unionByName(new).groupBy("cluster_id", "key").agg(F.min("first").alias("first"), F.max("document_frequency").alias("document_frequency"), F.max("confidence").alias("confidence"))


def accumulate_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str) -> StreamingQuery:
    """Merges entity files arriving in ``source`` into versions of a state table below ``target``. Each batch writes its
    own version from the one before, so a batch that is run again after a failure gives the same version."""

    def merge(batch: DataFrame, n: int) -> None:
        new = partial_entities(batch)
        path = f"{target}/v={{}}"
        if n > 0:
            new = merge_state(batch.sparkSession.read.parquet(path.format(n - 1)), new)
        new.write.mode("overwrite").parquet(path.format(n))

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_arrivals(stream: DataFrame, width: str = "1 day", late: str = "3 days") -> DataFrame:
    """(window, cluster_id, rows) of arrivals by event time; rows later than the watermark are dropped by the engine."""
    seen = stream.withWatermark("arrived_at", late)
    return seen.groupBy(F.window("arrived_at", width), "cluster_id").agg(F.count("*").alias("rows"))
