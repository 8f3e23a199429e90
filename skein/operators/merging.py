"""Merging extractions of a cluster's documents, never discarding evidence.

The merge is a left fold over emissions in order; here it is one grouped aggregation, in which order shows only in
first-wins columns and in which spans are new. Emission order is (emission, ord).

* entities merge by lower-case name: the first id, name and type stay, frequency and confidence are maxima;
* relations merge by source|type|target; ``id_mode='raw'`` compares the ids as emitted (ids of different documents then
  collide), ``'resolved'`` first replaces them by the merged entities' keys;
* a span is kept if no earlier emission of its key brought the same quote: repeats inside one emission stay;
* source documents: the first emission's list as it is, later ones' new members once each, in order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.graphs import EMISSION, entity_rows, nodes, relation_rows, span_rows



def _named(entities: DataFrame) -> DataFrame:
    return entity_rows(entities).where("name is not null").withColumn("key", F.lower("name"))


def merge_entities(entities: DataFrame) -> DataFrame:
    """(cluster_id, key, id, name, type, document_frequency, confidence, observed_documents). Rows without a name are left
    out; null frequencies and confidences count as their defaults of 1."""
    rows = _named(entities)
    first = F.min_by(F.struct("id", "name", "type"), F.struct("emission", "ord", "entity_pk")).alias("f")
    return rows.groupBy("cluster_id", "key").agg(
        first, F.max(F.coalesce("document_frequency", F.lit(1))).alias("document_frequency"), F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence"),
        F.countDistinct("emission").alias("observed_documents"),
    ).select("cluster_id", "key", "f.*", "document_frequency", "confidence", "observed_documents")


def keyed_relations(entities: DataFrame, relations: DataFrame, id_mode: str = "raw") -> DataFrame:
    """Relations once each with the merge key parts s, relation_type, t."""
    rows = relation_rows(relations).where("source is not null and target is not null and relation_type is not null")
    if id_mode == "raw":
        return rows.withColumn("s", F.col("source")).withColumn("t", F.col("target"))
    if id_mode != "resolved":
        raise ValueError(f"unknown id_mode: {id_mode}")
    name = nodes(entities).where("name is not null").select(*EMISSION, "id", F.lower("name").alias("key"))
    s, t = name.withColumnsRenamed({"id": "source", "key": "s"}), name.withColumnsRenamed({"id": "target", "key": "t"})
    return rows.join(s, [*EMISSION, "source"]).join(t, [*EMISSION, "target"])


def merge_relations(entities: DataFrame, relations: DataFrame, id_mode: str = "raw") -> DataFrame:
    """(cluster_id, s, relation_type, t, support_count, confidence, observed_documents)."""
    return keyed_relations(entities, relations, id_mode).groupBy("cluster_id", "s", "relation_type", "t").agg(
        F.max(F.coalesce("support_count", F.lit(1))).alias("support_count"), F.max(F.coalesce("confidence", F.lit(1.0))).alias("confidence"),
        F.countDistinct("emission").alias("observed_documents"),
    )


def merge_source_documents(entities: DataFrame, relations: DataFrame, id_mode: str = "raw") -> DataFrame:
    """(cluster_id, s, relation_type, t, at, document): the merged lists, one row a member, ``at`` its 0-based place."""
    keys = ["cluster_id", "s", "relation_type", "t"]
    rows = keyed_relations(entities, relations, id_mode)
    flat = rows.select(*keys, "emission", "ord", "relation_pk", F.posexplode("source_documents").alias("i", "document"))
    begin = F.min(F.struct("emission", "ord", "relation_pk"))
    first = rows.groupBy(*keys).agg(begin.alias("b"))
    flat = flat.join(first, keys).withColumn("is_first", F.struct("emission", "ord", "relation_pk") == F.col("b"))
    per = Window.partitionBy(*keys, "document").orderBy("emission", "ord", "relation_pk", "i")
    kept = flat.withColumn("k", F.row_number().over(per)).where("is_first or k = 1")
    place = Window.partitionBy(*keys).orderBy("emission", "ord", "relation_pk", "i")
    return kept.select(*keys, (F.row_number().over(place) - 1).alias("at"), "document")


def merge_evidence(entities: DataFrame, spans: DataFrame) -> DataFrame:
    """(cluster_id, key, span_id, document_index, quote): spans that the merged entities keep. A null quote is a quote like
    any other, as in the set that the fold compares with."""
    rows = _named(entities).select("cluster_id", "key", "entity_pk", "emission", "ord")
    own = span_rows(spans).where("owner_kind = 'entity'").select(F.col("owner_pk").alias("entity_pk"), "span_id", "span_ord", "document_index", "quote")
    joined = own.join(rows, "entity_pk")
    first = F.min(F.struct("emission", "ord")).over(Window.partitionBy("cluster_id", "key", "quote"))
    return joined.withColumn("first", first).where(F.struct("emission", "ord") == F.col("first")).select("cluster_id", "key", "span_id", "document_index", "quote")


def merge_relation_evidence(entities: DataFrame, relations: DataFrame, spans: DataFrame, id_mode: str = "raw") -> DataFrame:
    """(cluster_id, s, relation_type, t, span_id, document_index, quote): spans that the merged relations keep."""
    keys = ["cluster_id", "s", "relation_type", "t"]
    rows = keyed_relations(entities, relations, id_mode).select(*keys, "relation_pk", "emission", "ord")
    own = span_rows(spans).where("owner_kind = 'relation'").select(F.col("owner_pk").alias("relation_pk"), "span_id", "document_index", "quote")
    joined = own.join(rows, "relation_pk")
    first = F.min(F.struct("emission", "ord")).over(Window.partitionBy(*keys, "quote"))
    return joined.withColumn("first", first).where(F.struct("emission", "ord") == F.col("first")).select(*keys, "span_id", "document_index", "quote")


def merge_paths(*path_tables: DataFrame) -> DataFrame:
    """Paths are a bag: repeats stay."""
    out = path_tables[0]
    for t in path_tables[1:]:
        out = out.unionByName(t)
    return out
