"""Queries over nested and referring records: flattening (4) and orphan references (5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.operators import flatten, orphans
from skein.sources import read_table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return flatten.child_links(read_table(spark, d, "accumulated"))


def p4_responses(spark: SparkSession, d: str) -> DataFrame:
    return flatten.parent_table(read_table(spark, d, "accumulated"))


def _child(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: flatten.child_table(read_table(spark, d, "accumulated"), kind)


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return orphans.relation_orphans(read_table(spark, d, "relations"), read_table(spark, d, "entities"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("relation_pk", "endpoint", "reason")


def p5_months(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_report(_orphans(spark, d))


def p5_partial(spark: SparkSession, d: str) -> DataFrame:
    return orphans.source_orphans(read_table(spark, d, "relations"), read_table(spark, d, "entities"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": p4_found, "p4_responses": p4_responses,
    "p4_entities": _child("entity"), "p4_relations": _child("relation"), "p4_paths": _child("reasoning_path"),
    "p4_entity_spans": _child("entity_evidence"), "p4_relation_spans": _child("relation_evidence"),
    "p4_reports": _child("grader_report"), "p4_issues": _child("grader_issue"),
    "p5_found": p5_found, "p5_months": p5_months, "p5_partial": p5_partial,
}

_ORPHANS = """
    WITH rel AS (
      SELECT relation_pk, any_value(cluster_id) AS cluster_id, any_value(emission) AS emission, any_value(source) AS source,
             any_value(target) AS target, any_value(emitted_at) AS emitted_at,
             coalesce(min(arrived_at), TIMESTAMP '9999-12-31 00:00:00') AS t
      FROM relations GROUP BY relation_pk),
    refs AS (
      SELECT relation_pk, 'source' AS endpoint, source AS ref, cluster_id, emission, emitted_at, t FROM rel WHERE source <> ''
      UNION ALL
      SELECT relation_pk, 'target', target, cluster_id, emission, emitted_at, t FROM rel WHERE target <> ''),
    seen AS (
      SELECT r.relation_pk, r.endpoint, any_value(r.emitted_at) AS emitted_at, any_value(r.t) AS t, count(e.id) AS n,
             min(e.arrived_at) AS first_seen,
             coalesce(bool_or(e.arrived_at <= r.t AND (e.deleted_at IS NULL OR e.deleted_at > r.t)), false) AS visible
      FROM refs r LEFT JOIN entities e ON e.cluster_id = r.cluster_id AND e.emission = r.emission AND e.id = r.ref
      GROUP BY r.relation_pk, r.endpoint),
    orphan AS (
      SELECT relation_pk, endpoint, emitted_at,
             CASE WHEN n = 0 THEN 'missing' WHEN first_seen <= t THEN 'deleted' ELSE 'late' END AS reason
      FROM seen WHERE NOT visible)"""



def _json_list(x: str) -> str:
    """A JSON value as a list: a list, one object, or either kept as JSON text."""
    y = f"CASE WHEN json_type({x}) = 'VARCHAR' AND regexp_matches({x} ->> '$', '^\\s*[\\[{{]') AND json_valid({x} ->> '$') THEN CAST({x} ->> '$' AS JSON) ELSE {x} END"
    return f"CASE json_type({y}) WHEN 'ARRAY' THEN CAST({y} AS JSON[]) WHEN 'OBJECT' THEN [{y}] ELSE CAST([] AS JSON[]) END"


def _items(name: str, source: str, parent: str, key: str) -> str:
    """The objects of one list with their positions: name(response_id, parent_pos, pos, e)."""
    return f"""{name}_l AS (SELECT response_id, {parent} AS parent_pos, {_json_list(f"json_extract({'g' if source == 'graph' else 'e'}, '$.{key}')")} AS l FROM {source}),
      {name}_x AS (SELECT response_id, parent_pos, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS pos FROM {name}_l),
      {name} AS (SELECT response_id, parent_pos, pos, e FROM {name}_x WHERE json_type(e) = 'OBJECT')"""


_GRAPHS = """
    WITH text AS (SELECT DISTINCT response_id, regexp_extract(knowledge_graph, '(?s)\\{.*\\}') AS t FROM accumulated),
      graph AS (SELECT response_id, CAST(t AS JSON) AS g FROM text WHERE t <> '' AND json_valid(t)),
      """ + ",\n      ".join([
    _items("entity", "graph", "-1", "entities"), _items("relation", "graph", "-1", "relations"), _items("reasoning_path", "graph", "-1", "reasoning_paths"),
    _items("entity_evidence", "entity", "pos", "evidence"), _items("relation_evidence", "relation", "pos", "evidence"),
])
_LINKS = "response_id, CAST(parent_pos AS INTEGER) AS parent_pos, CAST(pos AS INTEGER) AS pos"


def _whole(x: str) -> str:
    return f"CASE WHEN TRY_CAST({x} AS DOUBLE) = floor(TRY_CAST({x} AS DOUBLE)) THEN CAST(TRY_CAST({x} AS DOUBLE) AS BIGINT) END"


def _read(kind: str, texts: list[str], wholes: list[str] = (), numbers: list[str] = (), more: str = "") -> str:
    fields = [f"e ->> '$.{c}' AS {c}" for c in texts] + [f"{_whole(f"(e ->> '$.{c}')")} AS {c}" for c in wholes] + [f"TRY_CAST(e ->> '$.{c}' AS DOUBLE) AS {c}" for c in numbers]
    return f"{_GRAPHS} SELECT {_LINKS}, {', '.join(fields)}{more} FROM {kind}"


_DOCUMENTS = f""", CASE WHEN json_type(json_extract(e, '$.source_documents')) = 'ARRAY' THEN list_transform(CAST(json_extract(e, '$.source_documents') AS JSON[]),
    lambda x: {_whole("(x ->> '$')")}) END AS source_documents"""
_PATH = ", CASE WHEN json_type(json_extract(e, '$.path')) = 'ARRAY' THEN list_transform(CAST(json_extract(e, '$.path') AS JSON[]), lambda x: x ->> '$') END AS path"

SQL: dict[str, str] = {
    "p4_entities": _read("entity", ["id", "name", "type"], ["document_frequency"], ["confidence"]),
    "p4_relations": _read("relation", ["source", "target", "relation_type"], ["support_count"], ["confidence"], _DOCUMENTS),
    "p4_paths": _read("reasoning_path", ["description"], [], ["confidence"], _PATH),
    "p4_entity_spans": _read("entity_evidence", ["quote", "section"], ["document_index"]),
    "p4_relation_spans": _read("relation_evidence", ["quote", "section"], ["document_index"]),
    "p4_responses": """
        SELECT response_id, method, cluster_index, num_documents, iterations_used, final_score
        FROM (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY arrived_at NULLS LAST) AS k FROM accumulated) WHERE k = 1""",
    "p4_found": _GRAPHS + """, reports AS (SELECT response_id, any_value(grader_reports) AS l FROM accumulated GROUP BY 1),
      report AS (SELECT response_id, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS pos FROM reports),
      issue AS (SELECT response_id, pos AS parent_pos, unnest(e.issues) AS i, generate_subscripts(e.issues, 1) - 1 AS pos FROM report)
      """ + " UNION ALL ".join(f"SELECT response_id, '{k}' AS kind, CAST(parent_pos AS INTEGER) AS parent_pos, CAST(pos AS INTEGER) AS pos FROM {k}" for k in flatten.GRAPH_TABLES) + """
      UNION ALL SELECT response_id, 'grader_report', -1, CAST(pos AS INTEGER) FROM report WHERE e IS NOT NULL
      UNION ALL SELECT response_id, 'grader_issue', CAST(parent_pos AS INTEGER), CAST(pos AS INTEGER) FROM issue WHERE i IS NOT NULL""",
    "p5_found": _ORPHANS + " SELECT relation_pk, endpoint, reason FROM orphan",
    "p5_months": _ORPHANS + """
        SELECT 'relations' AS table_name, CAST(date_trunc('month', emitted_at) AS TIMESTAMP) AS period, endpoint, reason, count(*) AS orphans
        FROM orphan GROUP BY 2, 3, 4""",
    "p5_partial": """
        WITH r AS (SELECT DISTINCT relation_pk, cluster_id, emission, source FROM relations)
        SELECT relation_pk, CAST((cluster_id IS NULL)::INT + 2 * (emission IS NULL)::INT + 4 * (source IS NULL)::INT AS INTEGER) AS null_mask FROM r
        WHERE NOT (cluster_id IS NULL AND emission IS NULL AND source IS NULL) AND NOT EXISTS (SELECT 1 FROM entities e WHERE e.id <> ''
              AND (r.cluster_id IS NULL OR e.cluster_id = r.cluster_id) AND (r.emission IS NULL OR e.emission = r.emission) AND (r.source IS NULL OR e.id = r.source))""",
    "p4_reports": """
        WITH r AS (SELECT response_id, grader_reports AS l FROM (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY arrived_at NULLS LAST) AS k FROM accumulated)
                   WHERE k = 1 AND grader_reports IS NOT NULL),
             x AS (SELECT response_id, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS pos FROM r)
        SELECT response_id, CAST(-1 AS INTEGER) AS parent_pos, CAST(pos AS INTEGER) AS pos, e.overall_score AS overall_score,
               e.passes_threshold AS passes_threshold, e.feedback_summary AS feedback_summary FROM x WHERE e IS NOT NULL""",
    "p4_issues": """
        WITH r AS (SELECT response_id, grader_reports AS l FROM (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY arrived_at NULLS LAST) AS k FROM accumulated)
                   WHERE k = 1 AND grader_reports IS NOT NULL),
             x AS (SELECT response_id, unnest(l) AS e, generate_subscripts(l, 1) - 1 AS pos FROM r),
             y AS (SELECT response_id, pos AS parent_pos, unnest(e.issues) AS i, generate_subscripts(e.issues, 1) - 1 AS pos FROM x WHERE e.issues IS NOT NULL)
        SELECT response_id, CAST(parent_pos AS INTEGER) AS parent_pos, CAST(pos AS INTEGER) AS pos, i.issue_type AS issue_type,
               i.element_id AS element_id, i.description AS description, i.severity AS severity FROM y WHERE i IS NOT NULL""",
}
