"""Rule-based extraction: mentions, entities and relations of texts, chunks, unions and alias clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import alias_key
from skein.operators.graphs import components

#: What is written like a name. ASCII only, so that every engine reads it alike.
MENTION = r"([A-Z][a-z]{3,})"


def mentions(documents: DataFrame) -> DataFrame:
    """(cluster_id, document_index, at, mention) of all words written like names, in order."""
    found = F.regexp_extract_all("text", F.lit(MENTION), 1)
    return documents.select("cluster_id", "document_index", F.posexplode(found).alias("at", "mention"))


def found_entities(documents: DataFrame) -> DataFrame:
    """(cluster_id, entity, documents, mentions), entity the lower-case mention."""
    return mentions(documents).groupBy("cluster_id", F.lower("mention").alias("entity")).agg(F.countDistinct("document_index").alias("documents"), F.count("*").alias("mentions"))


def found_relations(documents: DataFrame) -> DataFrame:
    """(cluster_id, source, target, support): consecutive different mentions of a document; support counts documents.

    The pairs come from the document's own array, so no window or self-join is needed."""
    m = F.transform(F.regexp_extract_all("text", F.lit(MENTION), 1), F.lower)
    pairs = F.array_distinct(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.size("m") - 1, F.lit(1))), lambda i: F.struct(F.try_element_at("m", i).alias("s"), F.try_element_at("m", i + 1).alias("t"))), lambda p: p["s"] != p["t"]))
    flat = documents.select("cluster_id", m.alias("m")).select("cluster_id", F.explode(pairs).alias("p"))
    return flat.groupBy("cluster_id", F.col("p.s").alias("source"), F.col("p.t").alias("target")).agg(F.count("*").alias("support"))


def mention_triples(texts: DataFrame) -> DataFrame:
    """(cluster_id, source, relation, target) of consecutive different mentions as written, repeats kept: what a model
    would give for each text. The relation is a constant label."""
    m = F.regexp_extract_all("text", F.lit(MENTION), 1)
    pairs = F.filter(F.transform(F.col("m"), lambda x, i: F.struct(x.alias("s"), F.get(F.col("m"), i + 1).alias("t"))), lambda p: p["t"].isNotNull() & (p["s"] != p["t"]))
    flat = texts.select("cluster_id", m.alias("m")).select("cluster_id", F.explode(pairs).alias("p"))
    return flat.select("cluster_id", F.col("p.s").alias("source"), F.lit("next_to").alias("relation"), F.col("p.t").alias("target"))


def clustered_graph(texts: DataFrame) -> DataFrame:
    """(cluster_id, source, relation, target): triples of all texts (chunks, documents), their ends rewritten to the
    canonical spelling of their alias cluster, repeats merged."""
    triples = mention_triples(texts)
    names = triples.select("cluster_id", F.explode(F.array("source", "target")).alias("name"))
    return canonical_triples(triples.distinct(), alias_clusters(names))


def chunks(documents: DataFrame, size: int = 3000) -> DataFrame:
    """(cluster_id, document_index, chunk, text): consecutive pieces of ``size`` characters; empty texts give none."""
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(size))
    rows = documents.where("length(text) > 0").select("cluster_id", "document_index", "text", F.posexplode(starts).alias("chunk", "start"))
    return rows.select("cluster_id", "document_index", "chunk", F.substring("text", F.col("start") + 1, F.lit(size)).alias("text"))


def first_documents(documents: DataFrame, limit: int = 5) -> DataFrame:
    """The first documents of each cluster by index; blank ones count towards the limit and are then dropped."""
    k = F.row_number().over(Window.partitionBy("cluster_id").orderBy("document_index"))
    return documents.withColumn("__k", k).where(F.col("__k") <= limit).drop("__k").where("trim(text) <> ''")


def triple_union(*graphs: DataFrame) -> DataFrame:
    """The set union of triple tables (cluster_id, source, target)."""
    out = graphs[0].select("cluster_id", "source", "target")
    for g in graphs[1:]:
        out = out.unionByName(g.select("cluster_id", "source", "target"))
    return out.distinct()


def alias_clusters(names: DataFrame) -> DataFrame:
    """(cluster_id, alias, canonical): spellings with one key (letters and digits, case aside) share the most frequent
    spelling, ties to the least. names: (cluster_id, name), one row a mention; null names and those without a letter or
    digit stand for themselves or not at all."""
    counted = names.where("name is not null").groupBy("cluster_id", "name").agg(F.count("*").alias("n")).withColumn("key", alias_key(F.col("name")))
    counted = counted.where("key <> ''")
    best = counted.groupBy("cluster_id", "key").agg(F.min(F.struct(-F.col("n"), "name")).alias("b"))
    return counted.join(best.select("cluster_id", "key", F.col("b.name").alias("canonical")), ["cluster_id", "key"]).select("cluster_id", F.col("name").alias("alias"), "canonical")


def similar_aliases(names: DataFrame, least: int = 6) -> DataFrame:
    """(cluster_id, alias, canonical): as ``alias_clusters``, but keys of ``least`` letters or more that are one edit apart
    (a letter more, less or other) are one as well, and so on along such keys.

    Keys meet under the forms with one letter left out, so no pairs of a cluster's names are compared that don't meet."""
    counted = names.where("name is not null").groupBy("cluster_id", "name").agg(F.count("*").alias("n")).withColumn("key", alias_key(F.col("name"))).where("key <> ''")
    keys = counted.select("cluster_id", "key").distinct()
    left_out = F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.concat(F.substring("key", F.lit(1), i - 1), F.substring("key", i + 1, F.length("key"))))
    forms = keys.where(F.length("key") >= least).select("cluster_id", "key", F.explode(F.array_distinct(F.concat(F.array("key"), left_out))).alias("form"))
    met = forms.join(forms.select("cluster_id", "form", F.col("key").alias("other")), ["cluster_id", "form"]).where("key < other").select("cluster_id", "key", "other").distinct()
    met = met.where(F.levenshtein("key", "other") <= 1)
    mark = lambda c: F.concat_ws("\x1f", "cluster_id", c)
    settled = components(keys.select(mark("key").alias("v")), met.select(mark("key").alias("a"), mark("other").alias("b")))
    joined = counted.withColumn("v", mark("key")).join(settled, "v")
    best = joined.groupBy("component").agg(F.min(F.struct(-F.col("n"), "name")).alias("b")).select("component", F.col("b.name").alias("canonical"))
    return joined.join(best, "component").select("cluster_id", F.col("name").alias("alias"), "canonical")


def multi_alias(aliases: DataFrame) -> DataFrame:
    """(cluster_id, canonical, aliases) of clusters of more than one spelling."""
    return aliases.groupBy("cluster_id", "canonical").agg(F.count("*").alias("aliases")).where("aliases > 1")


def canonical_triples(triples: DataFrame, aliases: DataFrame) -> DataFrame:
    """Triples (cluster_id, source, relation, target) rewritten to canonical names, repeats merged; endpoints outside the
    aliases stay as they are."""
    s = aliases.select("cluster_id", F.col("alias").alias("source"), F.col("canonical").alias("cs"))
    t = aliases.select("cluster_id", F.col("alias").alias("target"), F.col("canonical").alias("ct"))
    out = triples.join(s, ["cluster_id", "source"], "left").join(t, ["cluster_id", "target"], "left")
    return out.select("cluster_id", F.coalesce("cs", "source").alias("source"), "relation", F.coalesce("ct", "target").alias("target")).distinct()
