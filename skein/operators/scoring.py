"""Evaluation: n-gram overlap of summaries, extractive summaries, loss under noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import strip_ws
from skein.operators.finding import MENTION, found_entities
from skein.operators.graphs import EMISSION, graph_sizes
from skein.sources.clusters import clean_documents


def _grams(text: Column, n: int) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^a-z0-9]+"), lambda w: w != "")
    if n == 1:
        return words
    last = F.greatest(F.size(words) - n + 1, F.lit(0))
    starts = F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, n), " "))


def rouge(results: DataFrame, n: int) -> DataFrame:
    """(result_id, f1): overlap of the n-grams of generated and reference summaries, as F1 over their multisets. Rows
    with a null summary are left out; summaries without n-grams score 0."""
    rows = results.where("generated_summary is not null and reference_summary is not null")
    flat = rows.select("result_id", F.explode(F.array(F.struct(F.lit(1).alias("g"), F.lit(0).alias("r"), _grams(F.col("generated_summary"), n).alias("w")), F.struct(F.lit(0).alias("g"), F.lit(1).alias("r"), _grams(F.col("reference_summary"), n).alias("w")))).alias("x"))
    grams = flat.select("result_id", "x.g", "x.r", F.explode_outer("x.w").alias("w"))
    counted = grams.groupBy("result_id", "w").agg(F.sum(F.when(F.col("w").isNotNull(), F.col("g")).otherwise(0)).alias("g"), F.sum(F.when(F.col("w").isNotNull(), F.col("r")).otherwise(0)).alias("r"))
    f1 = F.try_divide(2.0 * F.sum(F.least("g", "r")), F.sum(F.col("g") + F.col("r")).cast("double"))
    return counted.groupBy("result_id").agg(F.round(F.coalesce(f1, F.lit(0.0)), 6).alias("f1"))


SENTENCE = r"[^.!?\n]+[.!?]?"


def ranked_summaries(documents: DataFrame, sentences: int = 3, read: int = 3) -> DataFrame:
    """(cluster_id, summary): of the sentences of each cluster's first ``read`` documents those that name most of what two or
    more documents of the cluster name, in their order; ties go to the earlier. A default where no model writes.

    What the cluster's documents share is counted over all of them."""
    shared = found_entities(documents).where("documents >= 2").select("cluster_id", "entity")
    first = clean_documents(documents, read)
    said = first.select("cluster_id", "document_index", F.posexplode(F.regexp_extract_all("text", F.lit(SENTENCE), 0)).alias("pos", "s"))
    said = said.withColumn("s", strip_ws(F.col("s"))).where("s <> ''")
    names = said.select("cluster_id", "document_index", "pos", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("s", F.lit(MENTION), 1), F.lower))).alias("entity"))
    hits = names.join(shared, ["cluster_id", "entity"]).groupBy("cluster_id", "document_index", "pos").agg(F.count("*").alias("hits"))
    scored = said.join(hits, ["cluster_id", "document_index", "pos"], "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    best = F.row_number().over(Window.partitionBy("cluster_id").orderBy(F.desc("hits"), "document_index", "pos"))
    chosen = scored.withColumn("k", best).where(F.col("k") <= sentences)
    parts = F.array_sort(F.collect_list(F.struct("document_index", "pos", "s")))
    return chosen.groupBy("cluster_id").agg(F.array_join(F.transform(parts, lambda x: x["s"]), " ").alias("summary"))


def degree_loss(node_rows: DataFrame, edge_rows: DataFrame, left: DataFrame, keys: list[str] = EMISSION) -> DataFrame:
    """(keys, degree_before, degree_after): the mean degree of graphs with edges, and that under the edges left."""
    size = graph_sizes(node_rows, edge_rows, keys).where("edges > 0")
    kept = left.groupBy(*keys).agg(F.count("*").alias("kept"))
    rows = size.join(kept, keys, "left")
    ratio = lambda c: F.round(2.0 * c / F.col("nodes"), 6)
    return rows.select(*keys, ratio(F.col("edges")).alias("degree_before"), ratio(F.coalesce("kept", F.lit(0))).alias("degree_after"))
