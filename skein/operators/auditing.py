"""The grader's checks as set operations: what a model would be asked to find, computed.

Every check gives rows (keys of the element, issue_type, element); ``penalty_score`` turns issues to a score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.finding import mentions
from skein.operators.graphs import EMISSION, edges, entity_rows, nodes, relation_rows, span_rows

#: What an issue of each severity costs.
PENALTY = {"low": 0.05, "medium": 0.1, "high": 0.2}
SHORT_QUOTE = 20


def folded(text: Column) -> Column:
    """Lower case with single spaces."""
    return F.lower(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def unsupported_quotes(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """HALLUCINATION: (span_id, reason) of quotes that do not stand in the cited document, or whose document is missing."""
    docs = documents.select("cluster_id", "document_index", "text")
    joined = span_rows(spans).where("quote is not null").join(docs, ["cluster_id", "document_index"], "left")
    reason = F.when(F.col("text").isNull(), "no_document").when(~F.contains("text", F.col("quote")), "not_verbatim")
    return joined.select("span_id", reason.alias("reason")).where("reason is not null")


def weak_evidence(entities: DataFrame, relations: DataFrame, spans: DataFrame, short: int = SHORT_QUOTE) -> DataFrame:
    """WEAK_EVIDENCE: (owner_kind, owner_pk, reason) of entities and relations without spans (none) or whose longest quote
    is shorter than ``short`` characters."""
    longest = span_rows(spans).groupBy("owner_kind", "owner_pk").agg(F.max(F.length("quote")).alias("longest"))
    rows = entity_rows(entities).select(F.lit("entity").alias("owner_kind"), F.col("entity_pk").alias("owner_pk"))
    rows = rows.unionByName(relation_rows(relations).select(F.lit("relation").alias("owner_kind"), F.col("relation_pk").alias("owner_pk")))
    reason = F.when(F.col("longest").isNull(), "none").when(F.col("longest") < short, "short")
    return rows.join(longest, ["owner_kind", "owner_pk"], "left").select("owner_kind", "owner_pk", reason.alias("reason")).where("reason is not null")


def loose_quotes(spans: DataFrame, documents: DataFrame) -> DataFrame:
    """WEAK_EVIDENCE: (span_id) of quotes that stand in the cited document only when case and white space are folded."""
    docs = documents.select("cluster_id", "document_index", "text")
    joined = span_rows(spans).where("quote is not null").join(docs, ["cluster_id", "document_index"])
    return joined.where(~F.contains("text", F.col("quote"))).where(F.contains(folded(F.col("text")), folded(F.col("quote")))).select("span_id")


def missing_entities(documents: DataFrame, entities: DataFrame, least_documents: int = 3) -> DataFrame:
    """MISSING_ENTITY: (cluster_id, mention, documents) of words written like names in ``least_documents`` documents of a
    cluster that are no word of any extracted name of it."""
    found = mentions(documents).groupBy("cluster_id", F.lower("mention").alias("mention")).agg(F.countDistinct("document_index").alias("documents"))
    words = entity_rows(entities).where("name is not null").select("cluster_id", F.explode(F.split(F.lower("name"), r"[^a-z]+")).alias("mention")).distinct()
    return found.where(F.col("documents") >= least_documents).join(words, ["cluster_id", "mention"], "left_anti")


def missing_relations(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """MISSING_RELATION: (keys, a, b): entities named one after the other in an extraction that no relation joins."""
    rows = nodes(entities)
    following = F.lead("id").over(Window.partitionBy(*EMISSION).orderBy("first_ord", "id"))
    pairs = rows.select(*EMISSION, F.col("id").alias("x"), following.alias("y")).where("y is not null")
    pairs = pairs.select(*EMISSION, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    known = edges(relations).select(*EMISSION, F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return pairs.join(known, [*EMISSION, "a", "b"], "left_anti")


def unrelated_together(entities: DataFrame, relations: DataFrame, spans: DataFrame) -> DataFrame:
    """MISSING_RELATION: (keys, a, b): entities of an extraction whose evidence is one quote of one document, which no
    relation joins. An extraction's entities with one quote are few, so the pairs of a quote are."""
    own = entity_rows(entities).where("id <> ''").select(*EMISSION, "entity_pk", "id")
    cited = span_rows(spans).where("owner_kind = 'entity' and quote is not null").select(F.col("owner_pk").alias("entity_pk"), "document_index", "quote")
    met = own.join(cited, "entity_pk").select(*EMISSION, "document_index", F.xxhash64("quote").alias("q"), "quote", "id").distinct()
    other = met.select(*EMISSION, "document_index", "q", F.col("quote").alias("quote_b"), F.col("id").alias("b"))
    pairs = met.withColumnRenamed("id", "a").join(other, [*EMISSION, "document_index", "q"]).where("a < b and quote = quote_b").select(*EMISSION, "a", "b").distinct()
    known = edges(relations).select(*EMISSION, F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct()
    return pairs.join(known, [*EMISSION, "a", "b"], "left_anti")


#: Relation types that cannot hold both ways.
ASYMMETRIC = ["CAUSES", "TREATS", "LOCATED_IN", "ACQUIRED", "RESULTED_IN", "MEASURED_BY", "FOUNDED_BY", "EMPLOYED_BY", "SUCCEEDED_BY", "BORN_IN", "PUBLISHED_BY"]


def contradictions(relations: DataFrame) -> DataFrame:
    """CONTRADICTION: (keys, a, b, reason): pairs of which support and contradiction are both stated, or one asymmetric
    type in both directions. One aggregation over unordered pairs, no self-join."""
    rows = relation_rows(relations).where("source <> '' and target <> '' and source <> target")
    pair = [*EMISSION, F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")]
    clash = rows.where("relation_type in ('SUPPORTS', 'CONTRADICTS')").groupBy(*pair).agg(F.countDistinct("relation_type").alias("n")).where("n = 2")
    both = rows.where(F.col("relation_type").isin(ASYMMETRIC)).groupBy(*pair, "relation_type").agg(F.countDistinct("source").alias("n")).where("n = 2")
    out = clash.select(*EMISSION, "a", "b", F.lit("support_and_contradict").alias("reason"))
    return out.unionByName(both.select(*EMISSION, "a", "b", F.concat(F.lit("both_ways:"), "relation_type").alias("reason")))


def wrong_types(entities: DataFrame, terms: DataFrame) -> DataFrame:
    """WRONG_TYPE: (entity_pk, type) of entities whose type is null or no term of the ontology table."""
    allowed = terms.where("field = 'entity_type'").select(F.col("term").alias("type"))
    return entity_rows(entities).select("entity_pk", "type").join(allowed, "type", "left_anti")


def dangling(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(relation_pk, endpoint, id): endpoints that no entity of the same extraction declares, whatever the time."""
    rows = relation_rows(relations)
    ends = rows.select("relation_pk", *EMISSION, F.explode(F.array(F.struct(F.lit("source").alias("endpoint"), F.col("source").alias("id")), F.struct(F.lit("target").alias("endpoint"), F.col("target").alias("id")))).alias("x"))
    ends = ends.select("relation_pk", *EMISSION, "x.endpoint", "x.id").where("id <> ''")
    return ends.join(nodes(entities).select(*EMISSION, "id"), [*EMISSION, "id"], "left_anti").select("relation_pk", "endpoint", "id")


def id_conflicts(entities: DataFrame, keys: list[str] = EMISSION) -> DataFrame:
    """(keys, id, names): ids that stand for several names (case aside)."""
    rows = entity_rows(entities).where("id <> ''")
    return rows.groupBy(*keys, "id").agg(F.countDistinct(F.lower("name")).alias("names")).where("names > 1")


def violations(entities: DataFrame, relations: DataFrame, accumulated: DataFrame) -> DataFrame:
    """(table_name, pk, rule) of rows outside the model's constraints: confidence outside [0, 1], required fields null, and of
    responses with a report whose score is outside [0, 1]."""
    e, r = entity_rows(entities), relation_rows(relations)

    def rules(df: DataFrame, table: str, pk: str, required: list[str]) -> DataFrame:
        checks = [F.when(F.col(c).isNull(), F.lit(f"{c}_is_null")) for c in required]
        checks.append(F.when((F.col("confidence") < 0) | (F.col("confidence") > 1), F.lit("confidence_out_of_range")))
        return df.select(F.lit(table).alias("table_name"), F.col(pk).alias("pk"), F.explode(F.array_compact(F.array(*checks))).alias("rule"))

    odd = F.exists("grader_reports", lambda x: (x["overall_score"] < 0) | (x["overall_score"] > 1))
    responses = accumulated.where(odd).select(F.lit("accumulated").alias("table_name"), F.col("response_id").alias("pk"), F.lit("overall_score_out_of_range").alias("rule")).distinct()
    rows = rules(e, "entities", "entity_pk", ["id", "name", "type"]).unionByName(rules(r, "relations", "relation_pk", ["source", "target", "relation_type"]))
    return rows.unionByName(responses)


def penalty_score(reports: DataFrame, threshold: float = 0.7) -> DataFrame:
    """(response_id, pos, issues, score, passes) of grader reports: 1 less the penalties, not below 0. An unknown or null
    severity costs as medium. reports: (response_id, pos, issues array)."""
    cost = lambda i: F.when(i["severity"] == "low", PENALTY["low"]).when(i["severity"] == "high", PENALTY["high"]).otherwise(PENALTY["medium"])
    listed = F.filter(F.coalesce("issues", F.array()), lambda i: i.isNotNull())
    score = F.greatest(F.lit(0.0), F.lit(1.0) - F.aggregate(listed, F.lit(0.0), lambda a, i: a + cost(i)))
    return reports.select("response_id", "pos", F.size(listed).alias("issues"), F.round(score, 6).alias("score"), (F.round(score, 6) >= threshold).alias("passes"))
