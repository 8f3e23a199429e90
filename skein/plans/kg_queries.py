"""Queries of the knowledge-graph operators over the project's tables, each with its SQL where SQL can express it.

Graphs are the single extractions (cluster_id, emission) unless the query speaks of clusters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import fenced_block, strip_fences
from skein.operators import auditing, corruption, features, finding, graphs, merging, parsing, scoring
from skein.plans import prompts
from skein.plans.engine import refine_loop
from skein.schemas import Ontology
from skein.sources import read_table
from skein.sources.clusters import clean_documents, cluster_documents, join_documents
from skein.sources.graphs import export_rows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of (table reader) as the query of its name."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = lambda spark, d: f(lambda name: read_table(spark, d, name))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _nodes_edges(t: Callable) -> tuple[DataFrame, DataFrame]:
    return graphs.nodes(t("entities")), graphs.edges(t("relations"))


_BLANK = r"[\s\x1c-\x1f\x85\xa0  -     　]"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_BLANK}+', ''), '{_BLANK}+$', '')"


_ENT = "ent AS (SELECT DISTINCT entity_pk, cluster_id, emission, ord, id, name, type, document_frequency, confidence FROM entities)"
_REL = "rel AS (SELECT DISTINCT relation_pk, cluster_id, emission, ord, source, target, relation_type, support_count, source_documents, confidence FROM relations)"
_SPAN = "span AS (SELECT DISTINCT span_id, cluster_id, owner_kind, owner_pk, span_ord, document_index, quote, section FROM evidence_spans)"
_GRAPH = f"""{_ENT}, {_REL},
    nodes AS (SELECT cluster_id, emission, id, min(ord) AS first_ord, arg_max({{'name': name, 'type': type, 'df': document_frequency, 'conf': confidence}}, ord) AS a
              FROM ent WHERE id <> '' GROUP BY 1, 2, 3),
    edges AS (SELECT cluster_id, emission, source, target, min(ord) AS first_ord, arg_max({{'type': relation_type, 'sup': support_count, 'conf': confidence}}, ord) AS a
              FROM rel WHERE source <> '' AND target <> '' GROUP BY 1, 2, 3, 4),
    ends AS (SELECT cluster_id, emission, source AS id FROM edges UNION ALL SELECT cluster_id, emission, target FROM edges),
    every AS (SELECT cluster_id, emission, id FROM nodes UNION SELECT cluster_id, emission, id FROM ends),
    deg AS (SELECT v.cluster_id, v.emission, v.id, count(e.id) AS degree FROM every v LEFT JOIN ends e USING (cluster_id, emission, id) GROUP BY 1, 2, 3)"""
_SCORES = """CASE WHEN n = 0 THEN 0.0 ELSE round(greatest(0.0, least(1.0, least(1.0, 2.0 * e / n / 3.0) * (1.0 - 0.2 * (c - 1)))), 6) END AS consistency,
    CASE WHEN n = 0 THEN 1.0 ELSE round(1.0 - least(1.0, 2.0 * e / n / 2.0), 6) END AS missing_entities,
    CASE WHEN n = 0 THEN 0.0 ELSE 0.1 END AS contradictions,
    CASE WHEN n = 0 THEN 1.0 ELSE round(least(1.0, 0.3 * (c - 1)), 6) END AS fragmentation"""
_SCORES = _SCORES.replace("0.0", "CAST(0 AS DOUBLE)").replace("1.0", "CAST(1 AS DOUBLE)").replace("2.0", "CAST(2 AS DOUBLE)").replace("3.0", "CAST(3 AS DOUBLE)").replace("0.1 ", "CAST(0.1 AS DOUBLE) ").replace("0.2", "CAST(0.2 AS DOUBLE)").replace("0.3", "CAST(0.3 AS DOUBLE)")

# ---- A: sources and sinks -------------------------------------------------------------------------------------------


@query(f"""
    WITH parts AS (SELECT row_id, cluster_id, list_filter(list_transform(string_split(document, '|||||'), lambda x: {_strip('x')}), lambda x: x <> '') AS l
                   FROM clusters WHERE document IS NOT NULL)
    SELECT row_id, cluster_id, CAST(unnest(range(len(l))) AS INTEGER) AS document_index, md5(unnest(l)) AS text_md5 FROM parts""")
def docs_split(t: Callable) -> DataFrame:
    return cluster_documents(t("clusters")).select("row_id", "cluster_id", "document_index", F.md5("text").alias("text_md5"))


@query(f"""
    WITH c AS (SELECT cluster_id, document_index, {_strip('text')} AS text FROM documents),
         k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY document_index) AS k FROM c WHERE text <> '')
    SELECT cluster_id, CAST(k - 1 AS INTEGER) AS document_index, md5(text) AS text_md5 FROM k WHERE k <= 5""")
def docs_clean_top5(t: Callable) -> DataFrame:
    return clean_documents(t("documents")).select("cluster_id", "document_index", F.md5("text").alias("text_md5"))


@query(f"""
    WITH c AS (SELECT cluster_id, document_index, {_strip('text')} AS text FROM documents),
         k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY document_index) AS k FROM c WHERE text <> '')
    SELECT cluster_id, CAST(k - 1 AS INTEGER) AS document_index, md5(text) AS text_md5 FROM k WHERE k <= 5""")
def docs_join_split(t: Callable) -> DataFrame:
    joined = join_documents(clean_documents(t("documents"))).withColumn("row_id", F.lit(0))
    return cluster_documents(joined).select("cluster_id", "document_index", F.md5("text").alias("text_md5"))


@query(f"""
    WITH {_GRAPH}
    SELECT cluster_id, emission, id, a.name AS name, a.type AS type,
           CASE coalesce(a.type, 'CONCEPT') WHEN 'PERSON' THEN '#ff6b6b' WHEN 'ORGANIZATION' THEN '#4ecdc4' WHEN 'LOCATION' THEN '#45b7d1'
                WHEN 'EVENT' THEN '#ffa07a' WHEN 'CONCEPT' THEN '#98d8c8' ELSE '#cccccc' END AS color, substr(a.name, 1, 15) AS label
    FROM nodes""")
def viz_nodes(t: Callable) -> DataFrame:
    return graphs.viz_nodes(graphs.nodes(t("entities"))).select("cluster_id", "emission", "id", "name", "type", "color", "label")


_EXPORT = """
    WITH m AS (SELECT cluster_id, document_index, list_transform(regexp_extract_all(text, '([A-Z][a-z]{3,})', 1), lambda x: lower(x)) AS m FROM %s),
         p AS (SELECT DISTINCT cluster_id, document_index, unnest(list_zip(m[1:len(m)-1], m[2:len(m)])) AS p FROM m WHERE len(m) > 1),
         x AS (SELECT DISTINCT cluster_id, p[1] AS s, p[2] AS t FROM p WHERE p[1] <> p[2])"""
_FIRST_FIVE = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY document_index) AS k FROM documents) WHERE k <= 5 AND trim(text) <> '')"


@query(_EXPORT % "documents" + """, n AS (SELECT cluster_id, s AS name FROM x UNION SELECT cluster_id, t FROM x)
    SELECT x.cluster_id, (SELECT count(*) FROM n WHERE n.cluster_id = x.cluster_id) AS n_entities, count(*) AS n_relations FROM x GROUP BY x.cluster_id""")
def kg_export(t: Callable) -> DataFrame:
    """The sizes of every cluster's exported graph."""
    rows = export_rows(finding.found_relations(t("documents")).withColumn("relation", F.lit("next_to")))
    n = lambda kind: F.sum((F.col("kind") == kind).cast("bigint"))
    return rows.groupBy("cluster_id").agg(n("entity").alias("n_entities"), n("relation").alias("n_relations"))


@query(_EXPORT % "documents" + """
    SELECT cluster_id, 'entity' AS kind, s AS item FROM x UNION SELECT cluster_id, 'entity', t FROM x UNION SELECT DISTINCT cluster_id, 'edge', 'next_to' FROM x
    UNION SELECT cluster_id, 'relation', '{"subject":"' || s || '","relation":"next_to","object":"' || t || '"}' FROM x""")
def kg_export_rows(t: Callable) -> DataFrame:
    return export_rows(finding.found_relations(t("documents")).withColumn("relation", F.lit("next_to")))


# ---- B: parsing -----------------------------------------------------------------------------------------------------


def _stripped_sql(c: str) -> str:
    head = f"regexp_replace({_strip(c)}, '^```(json)?', '')"
    return _strip(f"regexp_replace({head}, '```$', '')")


@query(f"SELECT response_id, md5({_stripped_sql('knowledge_graph')}) AS text_md5 FROM (SELECT DISTINCT response_id, knowledge_graph FROM accumulated) WHERE knowledge_graph IS NOT NULL")
def json_fence_strip(t: Callable) -> DataFrame:
    rows = t("accumulated").select("response_id", "knowledge_graph").distinct().where("knowledge_graph is not null")
    return rows.select("response_id", F.md5(strip_fences(F.col("knowledge_graph"))).alias("text_md5"))


@query(f"""
    WITH a AS (SELECT DISTINCT response_id, knowledge_graph AS k FROM accumulated WHERE knowledge_graph IS NOT NULL),
         i AS (SELECT response_id, CASE WHEN contains(k, '```json') THEN string_split(substr(k, strpos(k, '```json') + 7), '```')[1]
                                        WHEN contains(k, '```') THEN string_split(substr(k, strpos(k, '```') + 3), '```')[1] ELSE k END AS b FROM a)
    SELECT response_id, md5({_strip('b')}) AS text_md5 FROM i""")
def json_fence_block(t: Callable) -> DataFrame:
    rows = t("accumulated").select("response_id", "knowledge_graph").distinct().where("knowledge_graph is not null")
    return rows.select("response_id", F.md5(fenced_block(F.col("knowledge_graph"))).alias("text_md5"))


def _parsed(t: Callable, strict: bool = False) -> DataFrame:
    return parsing.parse_graphs(t("accumulated").select("response_id", "knowledge_graph").distinct(), strict=strict)


@query(f"""
    WITH {_ENT}, {_REL},
    x AS (
      SELECT 'entities' AS table_name, entity_pk AS pk, unnest(list_filter([CASE WHEN id IS NULL THEN 'id_is_null' END, CASE WHEN name IS NULL THEN 'name_is_null' END,
             CASE WHEN type IS NULL THEN 'type_is_null' END, CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence_out_of_range' END], lambda y: y IS NOT NULL)) AS rule FROM ent
      UNION ALL
      SELECT 'relations', relation_pk, unnest(list_filter([CASE WHEN source IS NULL THEN 'source_is_null' END, CASE WHEN target IS NULL THEN 'target_is_null' END,
             CASE WHEN relation_type IS NULL THEN 'relation_type_is_null' END, CASE WHEN confidence < 0 OR confidence > 1 THEN 'confidence_out_of_range' END], lambda y: y IS NOT NULL)) FROM rel
      UNION ALL
      SELECT DISTINCT 'accumulated', response_id, 'overall_score_out_of_range' FROM accumulated WHERE len(list_filter(grader_reports, lambda r: r.overall_score < 0 OR r.overall_score > 1)) > 0)
    SELECT * FROM x""")
def kg_violations(t: Callable) -> DataFrame:
    return auditing.violations(t("entities"), t("relations"), t("accumulated"))


# ---- C: prompts -----------------------------------------------------------------------------------------------------

_CONTEXT = f"""
    WITH k AS (SELECT cluster_id, text, row_number() OVER (PARTITION BY cluster_id ORDER BY document_index) AS k FROM documents),
         c AS (SELECT cluster_id, count(*) AS n_documents,
                      string_agg('[DOCUMENT ' || (k - 1) || ']' || chr(10) || {_strip('text')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY k) AS context
               FROM k WHERE k <= 5 GROUP BY cluster_id)"""


@query(_CONTEXT + " SELECT cluster_id, n_documents, md5(context) AS context_md5 FROM c")
def prompt_context(t: Callable) -> DataFrame:
    return prompts.context(t("documents")).select("cluster_id", "n_documents", F.md5("context").alias("context_md5"))


def _literal(head: str) -> str:
    return "'" + head.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _head(build: Callable) -> str:
    """The constant opening of a prompt, for its SQL."""
    from skein.plans import prompts as p

    shape = p._SHAPE
    if build is p.ontology_prompt:
        o = Ontology()
        return f"TASK: ontology\nExtract a knowledge graph from {o.domain_context}. Use no other types than these.\n{p._types(o)}\n{shape % ('', '')}\n\nDOCUMENTS:\n"
    o = Ontology()
    rule = "Every entity and relation needs evidence: the number of a document and a sentence copied from it word for word."
    return f"TASK: evidence\nExtract a knowledge graph from {o.domain_context}.\n{p._types(o)}\n{rule}\n{shape % (p._EVIDENCE, p._EVIDENCE)}\n\nDOCUMENTS:\n"


@query(_CONTEXT + f" SELECT cluster_id, md5({_literal(_head(prompts.ontology_prompt))} || context) AS prompt_md5 FROM c")
def prompt_ontology(t: Callable) -> DataFrame:
    return prompts.context(t("documents")).select("cluster_id", F.md5(prompts.ontology_prompt(F.col("context"), Ontology())).alias("prompt_md5"))


@query(_CONTEXT + f" SELECT cluster_id, md5({_literal(_head(prompts.evidence_prompt))} || context) AS prompt_md5 FROM c")
def prompt_evidence(t: Callable) -> DataFrame:
    return prompts.context(t("documents")).select("cluster_id", F.md5(prompts.evidence_prompt(F.col("context"), Ontology())).alias("prompt_md5"))


@query("""
    SELECT span_id, CASE lower(section)
      WHEN 'abstract' THEN 'Take what the text is about and what it claims, in broad entities.' WHEN 'introduction' THEN 'Take the setting, the question asked and why it is asked.'
      WHEN 'methods' THEN 'Take what was done: procedures, instruments, data and tools.' WHEN 'results' THEN 'Take what was found: figures, comparisons and outcomes.'
      WHEN 'discussion' THEN 'Take what the findings mean, what limits them and what remains to do.' WHEN 'conclusion' THEN 'Take the last word on each claim.'
      ELSE 'Take every entity and relation that matters here.' END AS guidance
    FROM (SELECT DISTINCT span_id, section FROM evidence_spans)""")
def section_guidance(t: Callable) -> DataFrame:
    return t("evidence_spans").select("span_id", "section").distinct().select("span_id", prompts.section_guidance(F.col("section")).alias("guidance"))


@query("""
    WITH k AS (SELECT cluster_id, text, row_number() OVER (PARTITION BY cluster_id ORDER BY document_index) AS k FROM documents)
    SELECT cluster_id, md5(substr(string_agg(text, chr(10) || chr(10) ORDER BY k), 1, 2000)) AS context_md5 FROM k WHERE k <= 3 GROUP BY cluster_id""")
def summary_context(t: Callable) -> DataFrame:
    return prompts.summary_context(t("documents")).select("cluster_id", F.md5("context").alias("context_md5"))


# ---- D: rule-based extraction, chunks, unions, aliases --------------------------------------------------------------


@query("""
    WITH m AS (SELECT cluster_id, document_index, unnest(regexp_extract_all(text, '([A-Z][a-z]{3,})', 1)) AS mention FROM documents)
    SELECT cluster_id, lower(mention) AS entity, count(DISTINCT document_index) AS documents, count(*) AS mentions FROM m GROUP BY 1, 2""")
def kg_entities(t: Callable) -> DataFrame:
    return finding.found_entities(t("documents"))


_PAIRS = """
    WITH m AS (SELECT cluster_id, document_index, list_transform(regexp_extract_all(text, '([A-Z][a-z]{3,})', 1), lambda x: lower(x)) AS m FROM %s),
         p AS (SELECT DISTINCT cluster_id, document_index, unnest(list_zip(m[1:len(m)-1], m[2:len(m)])) AS p FROM m WHERE len(m) > 1)"""


@query(_PAIRS % "documents" + " SELECT cluster_id, p[1] AS source, p[2] AS target, count(*) AS support FROM p WHERE p[1] <> p[2] GROUP BY 1, 2, 3")
def kg_relations(t: Callable) -> DataFrame:
    return finding.found_relations(t("documents"))


@query("""
    WITH d AS (SELECT cluster_id, document_index, text FROM documents WHERE length(text) > 0),
         s AS (SELECT *, unnest(range(0, length(text), 3000)) AS start FROM d)
    SELECT cluster_id, document_index, CAST(start / 3000 AS INTEGER) AS chunk, md5(substr(text, CAST(start + 1 AS BIGINT), 3000)) AS text_md5 FROM s""")
def chunks_3000(t: Callable) -> DataFrame:
    return finding.chunks(t("documents")).select("cluster_id", "document_index", "chunk", F.md5("text").alias("text_md5"))


@query(_PAIRS % _FIRST_FIVE
       + " SELECT DISTINCT cluster_id, p[1] AS source, p[2] AS target FROM p WHERE p[1] <> p[2]")
def kg_aggregate_union(t: Callable) -> DataFrame:
    return finding.triple_union(finding.found_relations(finding.first_documents(t("documents"))))


@query("""
    WITH d AS (SELECT cluster_id, document_index, text FROM documents WHERE length(text) > 0), s AS (SELECT *, unnest(range(0, length(text), 3000)) AS start FROM d),
    m AS (SELECT cluster_id, regexp_extract_all(substr(text, CAST(start + 1 AS BIGINT), 3000), '([A-Z][a-z]{3,})', 1) AS m FROM s),
    p AS (SELECT cluster_id, unnest(list_zip(m[1:len(m)-1], m[2:len(m)])) AS p FROM m WHERE len(m) > 1), t AS (SELECT cluster_id, p[1] AS s, p[2] AS t FROM p WHERE p[1] <> p[2]),
    n AS (SELECT cluster_id, name, lower(name) AS key, count(*) AS n FROM (SELECT cluster_id, s AS name FROM t UNION ALL SELECT cluster_id, t FROM t) GROUP BY 1, 2),
    c AS (SELECT *, first_value(name) OVER (PARTITION BY cluster_id, key ORDER BY n DESC, name) AS canonical FROM n)
    SELECT DISTINCT t.cluster_id, a.canonical AS source, 'next_to' AS relation, b.canonical AS target FROM t
    JOIN c a ON a.cluster_id = t.cluster_id AND a.name = t.s JOIN c b ON b.cluster_id = t.cluster_id AND b.name = t.t""")
def kg_chunked(t: Callable) -> DataFrame:
    return finding.clustered_graph(finding.chunks(t("documents")))


_ALIASES = f"""
    WITH {_ENT}, n AS (SELECT cluster_id, name, count(*) AS n, regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS key FROM ent WHERE name IS NOT NULL GROUP BY 1, 2),
         b AS (SELECT *, first_value(name) OVER (PARTITION BY cluster_id, key ORDER BY n DESC, name) AS canonical FROM n WHERE key <> '')"""


@query(_ALIASES + " SELECT cluster_id, name AS alias, canonical FROM b")
def kg_alias_canonical(t: Callable) -> DataFrame:
    return finding.alias_clusters(graphs.entity_rows(t("entities")))


@query(_ALIASES + " SELECT cluster_id, canonical, count(*) AS aliases FROM b GROUP BY 1, 2 HAVING count(*) > 1")
def kg_alias_multi(t: Callable) -> DataFrame:
    return finding.multi_alias(finding.alias_clusters(graphs.entity_rows(t("entities"))))


# ---- E: the audit ---------------------------------------------------------------------------------------------------


@query(f"""
    WITH {_SPAN}, x AS (SELECT s.span_id, CASE WHEN d.text IS NULL THEN 'no_document' WHEN NOT contains(d.text, s.quote) THEN 'not_verbatim' END AS reason
      FROM span s LEFT JOIN documents d ON d.cluster_id = s.cluster_id AND d.document_index = s.document_index WHERE s.quote IS NOT NULL)
    SELECT span_id, reason FROM x WHERE reason IS NOT NULL""")
def evidence_verbatim(t: Callable) -> DataFrame:
    return auditing.unsupported_quotes(t("evidence_spans"), t("documents"))


@query(f"""
    WITH {_ENT}, m AS (SELECT cluster_id, document_index, lower(unnest(regexp_extract_all(text, '([A-Z][a-z]{{3,}})', 1))) AS mention FROM documents),
    f AS (SELECT cluster_id, mention, count(DISTINCT document_index) AS documents FROM m GROUP BY 1, 2 HAVING count(DISTINCT document_index) >= 3),
    w AS (SELECT DISTINCT cluster_id, unnest(regexp_split_to_array(lower(name), '[^a-z]+')) AS mention FROM ent WHERE name IS NOT NULL)
    SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.cluster_id = f.cluster_id AND w.mention = f.mention)""")
def missing_entity(t: Callable) -> DataFrame:
    return auditing.missing_entities(t("documents"), t("entities"))


@query(f"""
    WITH {_GRAPH}, n AS (SELECT cluster_id, emission, id AS x, lead(id) OVER (PARTITION BY cluster_id, emission ORDER BY first_ord, id) AS y FROM nodes),
    p AS (SELECT DISTINCT cluster_id, emission, least(x, y) AS a, greatest(x, y) AS b FROM n WHERE y IS NOT NULL)
    SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.cluster_id = p.cluster_id AND e.emission = p.emission AND least(e.source, e.target) = p.a AND greatest(e.source, e.target) = p.b)""")
def missing_relation(t: Callable) -> DataFrame:
    return auditing.missing_relations(t("entities"), t("relations"))


@query(f"""
    WITH {_REL}, r AS (SELECT cluster_id, emission, least(source, target) AS a, greatest(source, target) AS b, source, relation_type FROM rel WHERE source <> '' AND target <> '' AND source <> target)
    SELECT cluster_id, emission, a, b, 'support_and_contradict' AS reason FROM r WHERE relation_type IN ('SUPPORTS', 'CONTRADICTS') GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT relation_type) = 2
    UNION ALL
    SELECT cluster_id, emission, a, b, 'both_ways:' || relation_type FROM r
    WHERE relation_type IN ({', '.join(f"'{x}'" for x in auditing.ASYMMETRIC)}) GROUP BY cluster_id, emission, a, b, relation_type HAVING count(DISTINCT source) = 2""")
def contradiction(t: Callable) -> DataFrame:
    return auditing.contradictions(t("relations"))


@query(f"""
    WITH {_ENT} SELECT e.entity_pk, e.type FROM ent e WHERE NOT EXISTS (SELECT 1 FROM ontology_terms o WHERE o.field = 'entity_type' AND o.term = e.type)""")
def wrong_type(t: Callable) -> DataFrame:
    return auditing.wrong_types(t("entities"), t("ontology_terms")).select("entity_pk", "type")


@query(f"""
    WITH {_GRAPH}, e AS (SELECT relation_pk, cluster_id, emission, 'source' AS endpoint, source AS id FROM rel UNION ALL SELECT relation_pk, cluster_id, emission, 'target', target FROM rel)
    SELECT relation_pk, endpoint, id FROM e WHERE id <> '' AND NOT EXISTS (SELECT 1 FROM nodes n WHERE n.cluster_id = e.cluster_id AND n.emission = e.emission AND n.id = e.id)""")
def dangling(t: Callable) -> DataFrame:
    return auditing.dangling(t("entities"), t("relations"))


@query(f"WITH {_ENT} SELECT cluster_id, emission, id, count(DISTINCT lower(name)) AS names FROM ent WHERE id <> '' GROUP BY 1, 2, 3 HAVING count(DISTINCT lower(name)) > 1")
def id_conflict(t: Callable) -> DataFrame:
    return auditing.id_conflicts(t("entities"))


def _reports(t: Callable) -> DataFrame:
    rows = t("accumulated").select("response_id", "grader_reports").dropDuplicates(["response_id"])
    return rows.select("response_id", F.posexplode("grader_reports").alias("pos", "r")).where("r is not null")


_REPORTS = """
    WITH r AS (SELECT response_id, grader_reports AS l FROM (SELECT *, row_number() OVER (PARTITION BY response_id ORDER BY arrived_at) AS k FROM accumulated) WHERE k = 1 AND grader_reports IS NOT NULL),
         x AS (SELECT response_id, unnest(l) AS r, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos FROM r),
         y AS (SELECT response_id, pos, r FROM x WHERE r IS NOT NULL)"""


@query(_REPORTS + """,
         z AS (SELECT response_id, pos, list_filter(coalesce(r.issues, []), lambda i: i IS NOT NULL) AS i FROM y),
         s AS (SELECT response_id, pos, CAST(len(i) AS INTEGER) AS issues, round(greatest(0, 1 - coalesce(list_sum(list_transform(i, lambda v:
               CASE v.severity WHEN 'low' THEN CAST(0.05 AS DOUBLE) WHEN 'high' THEN CAST(0.2 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END)), 0)), 6) AS score FROM z)
    SELECT *, score >= 0.7 AS passes FROM s""")
def grader_report(t: Callable) -> DataFrame:
    return auditing.penalty_score(_reports(t).select("response_id", "pos", "r.issues"))


@query(_REPORTS + """
    SELECT response_id, count(*) AS reports, min(CASE WHEN r.overall_score >= 0.7 THEN pos END) AS passed_at, arg_max(r.overall_score, pos) AS last_score FROM y GROUP BY 1""")
def grader_gate(t: Callable) -> DataFrame:
    score = F.col("r.overall_score")
    return _reports(t).groupBy("response_id").agg(F.count("*").alias("reports"), F.min(F.when(score >= 0.7, F.col("pos"))).alias("passed_at"), F.max_by(score, F.when(score.isNotNull(), F.col("pos"))).alias("last_score"))


@query(_REPORTS + """,
         l AS (SELECT response_id, arg_max(r.overall_score, pos) AS last_score, count(*) AS n FROM y GROUP BY 1),
         a AS (SELECT DISTINCT response_id, final_score, iterations_used FROM accumulated)
    SELECT a.response_id, a.final_score AS stated, l.last_score AS computed, CAST(coalesce(l.n, 0) AS BIGINT) AS reports FROM a LEFT JOIN l USING (response_id)""")
def grader_final_score(t: Callable) -> DataFrame:
    gate = grader_gate(t).select("response_id", F.col("last_score").alias("computed"), "reports")
    rows = t("accumulated").select("response_id", F.col("final_score").alias("stated")).dropDuplicates(["response_id"])
    return rows.join(gate, "response_id", "left").withColumn("reports", F.coalesce("reports", F.lit(0)))


# ---- F: graph and set algebra ---------------------------------------------------------------------------------------


@query(f"""
    WITH {_ENT}, k AS (SELECT *, lower(name) AS key, row_number() OVER (PARTITION BY cluster_id, lower(name) ORDER BY emission, ord, entity_pk) AS k FROM ent WHERE name IS NOT NULL)
    SELECT cluster_id, key, max(CASE WHEN k = 1 THEN id END) AS id, max(CASE WHEN k = 1 THEN name END) AS name, max(CASE WHEN k = 1 THEN type END) AS type,
           max(coalesce(document_frequency, 1)) AS document_frequency, max(coalesce(confidence, 1.0)) AS confidence, count(DISTINCT emission) AS observed_documents FROM k GROUP BY 1, 2""")
def kg_merge_entities(t: Callable) -> DataFrame:
    return merging.merge_entities(t("entities"))


@query(f"""
    WITH {_REL} SELECT cluster_id, source AS s, relation_type, target AS t, max(coalesce(support_count, 1)) AS support_count, max(coalesce(confidence, 1.0)) AS confidence,
           count(DISTINCT emission) AS observed_documents FROM rel WHERE source IS NOT NULL AND target IS NOT NULL AND relation_type IS NOT NULL GROUP BY 1, 2, 3, 4""")
def kg_merge_relations(t: Callable) -> DataFrame:
    return merging.merge_relations(t("entities"), t("relations"), "raw")


_RESOLVED = f"""{_GRAPH}, k AS (SELECT cluster_id, emission, id, lower(a.name) AS key FROM nodes WHERE a.name IS NOT NULL),
    rr AS (SELECT r.*, s.key AS s, g.key AS t FROM rel r JOIN k s ON s.cluster_id = r.cluster_id AND s.emission = r.emission AND s.id = r.source
           JOIN k g ON g.cluster_id = r.cluster_id AND g.emission = r.emission AND g.id = r.target WHERE relation_type IS NOT NULL)"""


@query(f"""
    WITH {_RESOLVED} SELECT cluster_id, s, relation_type, t, max(coalesce(support_count, 1)) AS support_count, max(coalesce(confidence, 1.0)) AS confidence,
           count(DISTINCT emission) AS observed_documents FROM rr GROUP BY 1, 2, 3, 4""")
def kg_merge_relations_resolved(t: Callable) -> DataFrame:
    return merging.merge_relations(t("entities"), t("relations"), "resolved")


@query(f"""
    WITH {_REL}, r AS (SELECT * FROM rel WHERE source IS NOT NULL AND target IS NOT NULL AND relation_type IS NOT NULL),
    f AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, source, relation_type, target ORDER BY emission, ord, relation_pk) = 1 AS is_first FROM r),
    x AS (SELECT *, unnest(source_documents) AS document, generate_subscripts(source_documents, 1) AS i FROM f),
    y AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, source, relation_type, target, document ORDER BY emission, ord, relation_pk, i) AS k FROM x),
    z AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, source, relation_type, target ORDER BY emission, ord, relation_pk, i) - 1 AS "at" FROM y WHERE is_first OR k = 1)
    SELECT cluster_id, source AS s, relation_type, target AS t, CAST("at" AS INTEGER) AS "at", document FROM z""")
def kg_merge_source_documents(t: Callable) -> DataFrame:
    return merging.merge_source_documents(t("entities"), t("relations"), "raw")


@query(f"""
    WITH {_ENT}, {_SPAN}, j AS (SELECT e.cluster_id, lower(e.name) AS key, e.emission, e.ord, s.span_id, s.document_index, s.quote
      FROM span s JOIN ent e ON s.owner_kind = 'entity' AND s.owner_pk = e.entity_pk WHERE e.name IS NOT NULL),
    f AS (SELECT *, rank() OVER (PARTITION BY cluster_id, key, quote ORDER BY emission, ord) AS k FROM j)
    SELECT cluster_id, key, span_id, document_index, quote FROM f WHERE k = 1""")
def kg_merge_evidence(t: Callable) -> DataFrame:
    return merging.merge_evidence(t("entities"), t("evidence_spans"))


@query(f"WITH {_GRAPH} SELECT cluster_id, emission, source, target, a.type AS relation_type, a.sup AS support_count FROM edges")
def kg_edge_collapse(t: Callable) -> DataFrame:
    return graphs.edges(t("relations")).select("cluster_id", "emission", "source", "target", "relation_type", "support_count")


@query(f"WITH {_GRAPH} SELECT * FROM deg")
def kg_degree(t: Callable) -> DataFrame:
    return graphs.degrees(*_nodes_edges(t))


@query(f"""
    WITH {_GRAPH}, n AS (SELECT cluster_id, emission, count(*) AS nodes FROM every GROUP BY 1, 2), e AS (SELECT cluster_id, emission, count(*) AS edges FROM edges GROUP BY 1, 2)
    SELECT n.cluster_id, n.emission, n.nodes, coalesce(e.edges, 0) AS edges FROM n LEFT JOIN e USING (cluster_id, emission)""")
def kg_size(t: Callable) -> DataFrame:
    return graphs.graph_sizes(*_nodes_edges(t))


_COMPONENTS = _GRAPH.replace("ent AS (", "ent AS MATERIALIZED (", 1).replace("edges AS (", "edges AS MATERIALIZED (", 1) + """,
    und AS MATERIALIZED (SELECT cluster_id, emission, source AS a, target AS b FROM edges UNION SELECT cluster_id, emission, target, source FROM edges),
    reach AS (SELECT cluster_id, emission, a AS v, a AS l FROM und
              UNION SELECT u.cluster_id, u.emission, u.b, r.l FROM reach r JOIN und u ON u.cluster_id = r.cluster_id AND u.emission = r.emission AND u.a = r.v WHERE r.l < u.b),
    lab AS (SELECT cluster_id, emission, v, min(l) AS l FROM reach GROUP BY 1, 2, 3),
    comp AS (SELECT e.cluster_id, e.emission, count(DISTINCT coalesce(lab.l, e.id)) AS components FROM every e
             LEFT JOIN lab ON lab.cluster_id = e.cluster_id AND lab.emission = e.emission AND lab.v = e.id GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_COMPONENTS} SELECT cluster_id, emission, components FROM comp")
def kg_components(t: Callable) -> DataFrame:
    return graphs.component_counts(*_nodes_edges(t))


@query(f"""
    WITH RECURSIVE {_COMPONENTS},
    s AS (SELECT n.cluster_id, n.emission, n.n, coalesce(e.e, 0) AS e, comp.components AS c FROM (SELECT cluster_id, emission, count(*) AS n FROM every GROUP BY 1, 2) n
          LEFT JOIN (SELECT cluster_id, emission, count(*) AS e FROM edges GROUP BY 1, 2) e USING (cluster_id, emission) JOIN comp USING (cluster_id, emission))
    SELECT cluster_id, emission, n AS nodes, e AS edges, c AS components, {_SCORES} FROM s""")
def kg_emission_score(t: Callable) -> DataFrame:
    return graphs.graph_scores(*_nodes_edges(t))


_CLUSTER = f"""{_RESOLVED.replace("ent AS (", "ent AS MATERIALIZED (", 1)},
    cn AS MATERIALIZED (SELECT DISTINCT cluster_id, lower(name) AS id FROM ent WHERE trim(name) <> ''),
    ce AS MATERIALIZED (SELECT DISTINCT r.cluster_id, s.key AS source, g.key AS target FROM rel r
        JOIN k s ON s.cluster_id = r.cluster_id AND s.emission = r.emission AND s.id = r.source JOIN k g ON g.cluster_id = r.cluster_id AND g.emission = r.emission AND g.id = r.target
        WHERE trim(s.key) <> '' AND trim(g.key) <> ''),
    und AS MATERIALIZED (SELECT cluster_id, source AS a, target AS b FROM ce UNION SELECT cluster_id, target, source FROM ce),
    reach AS (SELECT cluster_id, a AS v, a AS l FROM und UNION SELECT u.cluster_id, u.b, r.l FROM reach r JOIN und u ON u.cluster_id = r.cluster_id AND u.a = r.v WHERE r.l < u.b),
    lab AS (SELECT cluster_id, v, min(l) AS l FROM reach GROUP BY 1, 2),
    cv AS (SELECT cluster_id, id FROM cn UNION SELECT cluster_id, a FROM und),
    comp AS (SELECT cv.cluster_id, count(*) AS n, count(DISTINCT coalesce(lab.l, cv.id)) AS c FROM cv LEFT JOIN lab ON lab.cluster_id = cv.cluster_id AND lab.v = cv.id GROUP BY 1),
    s AS (SELECT comp.cluster_id, n, c, coalesce(e.e, 0) AS e FROM comp LEFT JOIN (SELECT cluster_id, count(*) AS e FROM ce GROUP BY 1) e USING (cluster_id))"""


@query(f"WITH RECURSIVE {_CLUSTER} SELECT cluster_id, n AS nodes, e AS edges, c AS components, {_SCORES} FROM s")
def kg_score(t: Callable) -> DataFrame:
    """The flagship: consistency scores of every cluster's merged graph."""
    n, e = graphs.merged_nodes(t("entities")), graphs.merged_edges(t("entities"), t("relations"))
    return graphs.graph_scores(n, e, ["cluster_id"])


@query(f"""
    WITH s0 AS (SELECT result_id, kg_stats.nodes AS n, kg_stats.edges AS e, kg_stats.components AS c FROM pipeline_results WHERE kg_stats IS NOT NULL)
    SELECT result_id, {_SCORES} FROM s0""")
def kg_score_stats(t: Callable) -> DataFrame:
    rows = t("pipeline_results").where("kg_stats is not null")
    scores = graphs.score_columns(F.col("kg_stats.nodes"), F.col("kg_stats.edges"), F.col("kg_stats.components"))
    return rows.select("result_id", *[F.round(v, 6).alias(k) for k, v in scores.items()])


_ACTIONS = """CASE WHEN NOT (missing_entities > 0.5) AND NOT (contradictions > 0.5) AND NOT (fragmentation > 0.5) THEN 'generic_reextraction'
    ELSE concat_ws(',', CASE WHEN missing_entities > 0.5 THEN 'expand_retrieval' END, CASE WHEN contradictions > 0.5 THEN 'corroborate' END,
                   CASE WHEN fragmentation > 0.5 THEN 'rerank_documents' END) END AS actions"""


@query(f"""
    WITH s AS (SELECT result_id, scores.consistency AS consistency, coalesce(scores.missing_entities, 0) AS missing_entities, coalesce(scores.contradictions, 0) AS contradictions,
                      coalesce(scores.fragmentation, 0) AS fragmentation FROM pipeline_results WHERE scores.consistency IS NOT NULL)
    SELECT result_id, consistency < 0.7 AS needs_refinement, {_ACTIONS}, CAST(CASE WHEN consistency < 0.7 THEN 3 ELSE 0 END AS INTEGER) AS iterations FROM s""")
def kg_refine_actions(t: Callable) -> DataFrame:
    rows = t("pipeline_results").select("result_id", "scores.*").where("consistency is not null").fillna(0.0, ["missing_entities", "contradictions", "fragmentation"])
    return refine_loop(graphs.refine_actions(rows)).select("result_id", "needs_refinement", "actions", "iterations")


_DROPPED = """, o AS (SELECT d.*, n.first_ord FROM deg d LEFT JOIN nodes n USING (cluster_id, emission, id)),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, emission ORDER BY degree DESC, first_ord NULLS LAST, id) AS k, count(*) OVER (PARTITION BY cluster_id, emission) AS n FROM o),
    dropped AS (SELECT cluster_id, emission, id FROM ranked WHERE k <= greatest(1, floor(CAST(0.2 AS DOUBLE) * n)))"""


@query(f"WITH {_GRAPH}{_DROPPED} SELECT * FROM dropped")
def corrupt_missing(t: Callable) -> DataFrame:
    return corruption.drop_nodes(*_nodes_edges(t))


@query(f"""
    WITH {_GRAPH}{_DROPPED} SELECT e.cluster_id, e.emission, e.source, e.target FROM edges e
    WHERE NOT EXISTS (SELECT 1 FROM dropped d WHERE d.cluster_id = e.cluster_id AND d.emission = e.emission AND d.id IN (e.source, e.target))""")
def corrupt_missing_edges(t: Callable) -> DataFrame:
    n, e = _nodes_edges(t)
    return corruption.without_nodes(e, corruption.drop_nodes(n, e)).select("cluster_id", "emission", "source", "target")


_DRAWN = """, rk AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, emission ORDER BY md5(concat_ws('|', '42', cluster_id, CAST(emission AS VARCHAR), source, target)), source, target) AS rank,
        count(*) OVER (PARTITION BY cluster_id, emission) AS m FROM edges),
    drawn AS (SELECT *, rank <= greatest(1, floor(CAST(0.3 AS DOUBLE) * m)) AS drawn FROM rk)"""


@query(f"""
    WITH {_GRAPH}{_DRAWN}, g AS (SELECT *, sum(drawn::INT) OVER w AS n, min(CASE WHEN drawn THEN rank END) OVER w AS r FROM drawn
        WINDOW w AS (PARTITION BY cluster_id, emission, least(source, target), greatest(source, target)))
    SELECT cluster_id, emission, source, target, a.type AS relation_type FROM g WHERE n = 0 OR (n = 2 AND rank = r)
    UNION ALL SELECT cluster_id, emission, target, source, a.type FROM g WHERE n = 1 AND drawn""")
def corrupt_flip(t: Callable) -> DataFrame:
    return corruption.flip_edges(graphs.edges(t("relations")))


@query(f"WITH {_GRAPH}{_DRAWN} SELECT cluster_id, emission, source, target FROM drawn WHERE NOT drawn")
def corrupt_fragment(t: Callable) -> DataFrame:
    return corruption.fragment(graphs.edges(t("relations"))).select("cluster_id", "emission", "source", "target")


_FEATURES = """, f AS (SELECT d.cluster_id, d.emission, d.id, CASE WHEN n.id IS NULL THEN 'CONCEPT' ELSE n.a.type END AS type, coalesce(n.a.df, 1) AS df,
        coalesce(n.a.conf, 1.0) AS conf, d.degree FROM deg d LEFT JOIN nodes n USING (cluster_id, emission, id)),
    feat AS (SELECT cluster_id, emission, id,
        CASE WHEN type = 'PERSON' THEN 1.0::DOUBLE ELSE 0 END AS is_person, CASE WHEN type = 'ORGANIZATION' THEN 1.0::DOUBLE ELSE 0 END AS is_organization,
        CASE WHEN type = 'LOCATION' THEN 1.0::DOUBLE ELSE 0 END AS is_location, CASE WHEN type = 'EVENT' THEN 1.0::DOUBLE ELSE 0 END AS is_event,
        CASE WHEN type = 'CONCEPT' THEN 1.0::DOUBLE ELSE 0 END AS is_concept, coalesce(df::DOUBLE / nullif(max(df) OVER w, 0), 0) AS df_norm, conf AS confidence,
        coalesce(degree::DOUBLE / nullif(max(degree) OVER w, 0), 0) AS degree_norm FROM f WINDOW w AS (PARTITION BY cluster_id, emission))"""


def _features(t: Callable) -> tuple[DataFrame, DataFrame]:
    n, e = _nodes_edges(t)
    return features.node_features(n, e), e


def _rounded(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


_R = ", ".join(f"round({c}, 6) AS {c}" for c in features.FEATURES)


@query(f"WITH {_GRAPH}{_FEATURES} SELECT cluster_id, emission, id, {_R} FROM feat")
def node_features(t: Callable) -> DataFrame:
    return _rounded(_features(t)[0], features.FEATURES)


@query(f"""
    WITH {_GRAPH}, o AS (SELECT v.*, row_number() OVER (PARTITION BY v.cluster_id, v.emission ORDER BY n.first_ord NULLS LAST, v.id) - 1 AS k FROM every v LEFT JOIN nodes n USING (cluster_id, emission, id))
    SELECT e.cluster_id, e.emission, CAST(s.k AS INTEGER) AS source_index, CAST(g.k AS INTEGER) AS target_index FROM edges e
    JOIN o s ON s.cluster_id = e.cluster_id AND s.emission = e.emission AND s.id = e.source JOIN o g ON g.cluster_id = e.cluster_id AND g.emission = e.emission AND g.id = e.target""")
def edge_index(t: Callable) -> DataFrame:
    return features.edge_index(*_nodes_edges(t))


_LAYER = """, ind AS (SELECT cluster_id, emission, target AS id, count(*) AS d FROM edges GROUP BY 1, 2, 3),
    x AS (SELECT f.*, coalesce(i.d, 0) + 1 AS d FROM feat f LEFT JOIN ind i USING (cluster_id, emission, id)),
    sent AS (SELECT cluster_id, emission, id, {own} FROM x UNION ALL
             SELECT e.cluster_id, e.emission, e.target, {msg} FROM edges e JOIN x s ON s.cluster_id = e.cluster_id AND s.emission = e.emission AND s.id = e.source
             JOIN x g ON g.cluster_id = e.cluster_id AND g.emission = e.emission AND g.id = e.target)""".format(
    own=", ".join(f"{c} / d AS {c}" for c in features.FEATURES), msg=", ".join(f"s.{c} / sqrt(s.d * g.d)" for c in features.FEATURES)
)


@query(f"WITH {_GRAPH}{_FEATURES}{_LAYER} SELECT cluster_id, emission, id, {', '.join(f'round(sum({c}), 6) AS {c}' for c in features.FEATURES)} FROM sent GROUP BY 1, 2, 3")
def gcn_layer(t: Callable) -> DataFrame:
    f, e = _features(t)
    return _rounded(features.propagate(f, e, features.FEATURES), features.FEATURES)


@query(f"WITH {_GRAPH}{_FEATURES} SELECT cluster_id, emission, {', '.join(f'round(avg({c}), 6) AS {c}' for c in features.FEATURES)} FROM feat GROUP BY 1, 2")
def graph_pool(t: Callable) -> DataFrame:
    f, _ = _features(t)
    return f.groupBy("cluster_id", "emission").agg(*[F.round(F.avg(c), 6).alias(c) for c in features.FEATURES])


@query(f"""
    WITH {_GRAPH}, s AS (SELECT * FROM edges WHERE source <> target)
    SELECT x.cluster_id, x.emission, x.source AS a, x.target AS b, y.target AS c FROM s x JOIN s y ON y.cluster_id = x.cluster_id AND y.emission = x.emission AND y.source = x.target
    WHERE y.target <> x.source""")
def paths_2hop(t: Callable) -> DataFrame:
    p = graphs.paths(graphs.edges(t("relations")), 2)
    return p.select("cluster_id", "emission", *[F.col("path")[i].alias(c) for i, c in enumerate("abc")])


@query(f"""
    WITH {_GRAPH}, s AS (SELECT * FROM edges WHERE source <> target)
    SELECT x.cluster_id, x.emission, x.source AS a, x.target AS b, y.target AS c, z.target AS d FROM s x JOIN s y ON y.cluster_id = x.cluster_id AND y.emission = x.emission AND y.source = x.target
    JOIN s z ON z.cluster_id = x.cluster_id AND z.emission = x.emission AND z.source = y.target WHERE y.target <> x.source AND z.target NOT IN (x.source, x.target)""")
def paths_3hop(t: Callable) -> DataFrame:
    p = graphs.paths(graphs.edges(t("relations")), 3)
    return p.select("cluster_id", "emission", *[F.col("path")[i].alias(c) for i, c in enumerate("abcd")])


@query(f"""
    WITH {_GRAPH}, el AS (SELECT cluster_id, emission, string_agg('  • ' || coalesce(a.name, '?') || ' (' || coalesce(a.type, '?') || ')', chr(10) ORDER BY first_ord, id) AS e FROM nodes GROUP BY 1, 2),
    rl AS (SELECT e.cluster_id, e.emission, string_agg('  • ' || coalesce(s.a.name, '?') || ' ' || coalesce(e.a.type, '?') || ' ' || coalesce(g.a.name, '?'), chr(10) ORDER BY e.first_ord, e.source, e.target) AS r
           FROM edges e LEFT JOIN nodes s ON s.cluster_id = e.cluster_id AND s.emission = e.emission AND s.id = e.source
           LEFT JOIN nodes g ON g.cluster_id = e.cluster_id AND g.emission = e.emission AND g.id = e.target GROUP BY 1, 2)
    SELECT el.cluster_id, el.emission, md5('Entities:' || chr(10) || e || chr(10) || chr(10) || 'Relations:' || chr(10) || coalesce(r, '')) AS description_md5 FROM el LEFT JOIN rl USING (cluster_id, emission)""")
def kg_description(t: Callable) -> DataFrame:
    return graphs.descriptions(*_nodes_edges(t)).select("cluster_id", "emission", F.md5("description").alias("description_md5"))


@query("""
    WITH a AS (SELECT DISTINCT response_id, method, num_documents, iterations_used, final_score FROM accumulated)
    SELECT method, count(*) AS responses, sum(num_documents) AS documents, max(iterations_used) AS most_iterations, round(avg(final_score), 6) AS mean_score FROM a GROUP BY 1""")
def method_compare(t: Callable) -> DataFrame:
    rows = t("accumulated").select("response_id", "method", "num_documents", "iterations_used", "final_score").distinct()
    return rows.groupBy("method").agg(F.count("*").alias("responses"), F.sum("num_documents").alias("documents"), F.max("iterations_used").alias("most_iterations"), F.round(F.avg("final_score"), 6).alias("mean_score"))


_ROUGE = """
    WITH r AS (SELECT result_id, generated_summary AS g, reference_summary AS f FROM pipeline_results WHERE generated_summary IS NOT NULL AND reference_summary IS NOT NULL),
    tg AS (SELECT result_id, list_filter(regexp_split_to_array(lower(g), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM r), tf AS (SELECT result_id, list_filter(regexp_split_to_array(lower(f), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM r),
    cg AS (SELECT result_id, w, count(*) AS n FROM (SELECT result_id, unnest({g}) AS w FROM tg) GROUP BY 1, 2), cf AS (SELECT result_id, w, count(*) AS n FROM (SELECT result_id, unnest({f}) AS w FROM tf) GROUP BY 1, 2),
    o AS (SELECT result_id, sum(least(cg.n, cf.n)) AS hit FROM cg JOIN cf USING (result_id, w) GROUP BY 1),
    sg AS (SELECT result_id, sum(n) AS n FROM cg GROUP BY 1), sf AS (SELECT result_id, sum(n) AS n FROM cf GROUP BY 1)
    SELECT r.result_id, round(coalesce(2.0::DOUBLE * coalesce(o.hit, 0) / nullif(coalesce(sg.n, 0) + coalesce(sf.n, 0), 0), 0), 6) AS f1 FROM r LEFT JOIN o USING (result_id) LEFT JOIN sg USING (result_id) LEFT JOIN sf USING (result_id)"""


def _grams(n: int) -> dict[str, str]:
    return dict.fromkeys(("g", "f"), "w" if n == 1 else "list_transform(list_zip(w[1:len(w)-1], w[2:len(w)]), lambda p: p[1] || ' ' || p[2])")


@query(_ROUGE.format(**_grams(1)))
def rouge1(t: Callable) -> DataFrame:
    return scoring.rouge(t("pipeline_results"), 1)


@query(_ROUGE.format(**{k: f"CASE WHEN len(w) > 1 THEN {v} ELSE [] END" for k, v in _grams(2).items()}))
def rouge2(t: Callable) -> DataFrame:
    return scoring.rouge(t("pipeline_results"), 2)


@query(f"""
    WITH {_GRAPH}{_DRAWN}, b AS (SELECT cluster_id, emission, count(*) AS edges FROM edges GROUP BY 1, 2), a AS (SELECT cluster_id, emission, count(*) AS kept FROM drawn WHERE NOT drawn GROUP BY 1, 2),
    n AS (SELECT cluster_id, emission, count(*) AS nodes FROM every GROUP BY 1, 2)
    SELECT b.cluster_id, b.emission, round(2.0::DOUBLE * b.edges / n.nodes, 6) AS degree_before, round(2.0::DOUBLE * coalesce(a.kept, 0) / n.nodes, 6) AS degree_after
    FROM b JOIN n USING (cluster_id, emission) LEFT JOIN a USING (cluster_id, emission)""")
def noise_robustness(t: Callable) -> DataFrame:
    n, e = _nodes_edges(t)
    return scoring.degree_loss(n, e, corruption.fragment(e))
