"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import canonical, leakage, mixing, names, spam, splitting, truncation
from skein.sources import read_table

# ---- 1: free-entered values -----------------------------------------------------------------------------------------


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    terms = read_table(spark, d, "ontology_terms")
    entities = canonical.map_to_list(read_table(spark, d, "entities"), "entity_pk", "type", terms, "entity_type")
    relations = canonical.map_to_list(read_table(spark, d, "relations"), "relation_pk", "relation_type", terms, "relation_type")
    return entities.unionByName(relations)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("field", "row_pk", "term")


def p1_unmatched(spark: SparkSession, d: str) -> DataFrame:
    return canonical.unmatched_report(_mapped(spark, d))


def p1_candidates(spark: SparkSession, d: str) -> DataFrame:
    """All entries within the distance of every typed value, not only the closest."""
    terms, out = read_table(spark, d, "ontology_terms"), None
    for table, pk, column, field in (("entities", "entity_pk", "type", "entity_type"), ("relations", "relation_pk", "relation_type", "relation_type")):
        values = canonical.typed_values(read_table(spark, d, table), pk, column, terms, field).select("value").distinct()
        found = canonical.value_candidates(values, canonical.reference_paths(terms, field)).select(F.lit(field).alias("field"), "*")
        out = found if out is None else out.unionByName(found)
    return out


# ---- 2: names -------------------------------------------------------------------------------------------------------


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_rows(read_table(spark, d, "entities"))


def p2_variants(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_report(read_table(spark, d, "entities"))


def p2_classes(spark: SparkSession, d: str) -> DataFrame:
    return names.variant_classes(read_table(spark, d, "entities"))


# ---- 3: cut texts ---------------------------------------------------------------------------------------------------


def _cut(spark: SparkSession, d: str) -> DataFrame:
    return truncation.cut_records(read_table(spark, d, "evidence_spans"), read_table(spark, d, "pipeline_results"), read_table(spark, d, "documents"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _cut(spark, d).where("is_cut").select("table_name", "record_id")


def p3_providers(spark: SparkSession, d: str) -> DataFrame:
    return truncation.provider_report(_cut(spark, d))


# ---- 6: oversized members -------------------------------------------------------------------------------------------


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Members of which the splitter makes more than one piece."""
    pieces = splitting.member_pieces(read_table(spark, d, "clusters"), only_split=True)
    return pieces.where(F.col("piece") == 1).select("row_id", "document_index")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.member_pieces(read_table(spark, d, "clusters"), only_split=True)


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Of every member that is cut: whether its pieces keep the limits, and what they give when put together again."""
    pieces = splitting.member_pieces(read_table(spark, d, "clusters"), only_split=True)
    fresh = F.expr("substring(text, repeated + 1)")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", fresh.alias("t")))), lambda x: x["t"]), "")
    kept = F.bool_and((F.length("text") <= 3000) & (F.col("repeated") <= 200))
    return pieces.groupBy("row_id", "document_index").agg(kept.alias("within_limits"), F.md5(whole).alias("text_md5"))


# ---- 7: leaked items ------------------------------------------------------------------------------------------------


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_items(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("item_id", "doc_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    return leakage.item_report(_leaks(spark, d))


# ---- 8: the mix -----------------------------------------------------------------------------------------------------


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    sizes = mixing.document_sizes(read_table(spark, d, "documents"))
    return mixing.balanced_mix(sizes, mixing.mix_plan(sizes, read_table(spark, d, "mix_targets")))


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    sizes = mixing.document_sizes(read_table(spark, d, "documents"))
    plan = mixing.mix_plan(sizes, read_table(spark, d, "mix_targets"))
    return mixing.share_report(mixing.balanced_mix(sizes, plan), plan)


# ---- 9: junk pages --------------------------------------------------------------------------------------------------


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spam.spam_pages(read_table(spark, d, "documents"))


def p9_hosts(spark: SparkSession, d: str) -> DataFrame:
    return spam.host_report(read_table(spark, d, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (p1_found, p1_unmatched, p1_candidates, p2_found, p2_variants, p2_classes, p3_found, p3_providers, p6_found, p6_pieces, p6_round_trip, p7_found, p7_items, p8_mix, p8_shares, p9_found, p9_hosts)
}

_BLANK = r"[\s\x1c-\x1f\x85\xa0  -     　]"

_MEMBERS = rf"""
        WITH members AS (
          SELECT row_id, unnest(list_filter(list_transform(string_split(document, '|||||'),
                   lambda x: regexp_replace(regexp_replace(x, '^{_BLANK}+', ''), '{_BLANK}+$', '')), lambda x: x <> '')) AS text,
                 generate_subscripts(list_filter(list_transform(string_split(document, '|||||'),
                   lambda x: regexp_replace(regexp_replace(x, '^{_BLANK}+', ''), '{_BLANK}+$', '')), lambda x: x <> ''), 1) - 1 AS document_index
          FROM clusters WHERE document IS NOT NULL)"""

SQL: dict[str, str] = {
    "p6_found": _MEMBERS + " SELECT row_id, CAST(document_index AS INTEGER) AS document_index FROM members WHERE length(text) > 3000",
    "p6_round_trip": _MEMBERS + " SELECT row_id, CAST(document_index AS INTEGER) AS document_index, true AS within_limits, md5(text) AS text_md5 FROM members WHERE length(text) > 3000",
}
