"""Queries of parsing, prompts, sinks, merging and the extraction methods, each with the SQL that it is compared with.

The methods run with the rule-based models, so that SQL can count what they find: words written like names, and names that
follow one another in a sentence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import fenced_block
from skein.operators import auditing, features, finding, flatten, graphs, merging, parsing, scoring
from skein.plans import pipelines, prompts
from skein.plans.engine import KGEngine, Response
from skein.plans.kg_queries import _CONTEXT, _ENT, _GRAPH, _REL, _SCORES, _SPAN, _literal, _nodes_edges, _parsed, _strip, _stripped_sql, query
from skein.plans.models import MisquotingModel, ReplayModel, RuleModel, with_repairs
from skein.plans.record_queries import _GRAPHS
from skein.schemas import METHODS, Ontology
from skein.session import shared_path
from skein.sources.graphs import export_graph, read_kggen, triples, write_graph, write_json, write_texts
from skein.streaming import accumulate

# ---- A: files -------------------------------------------------------------------------------------------------------


@query(f"WITH {_GRAPH} SELECT cluster_id, emission, 'node' AS kind, id AS a, NULL AS b FROM nodes UNION ALL SELECT cluster_id, emission, 'edge', source, target FROM edges")
def graph_sink(t: Callable) -> DataFrame:
    """Graphs written as two tables and read again."""
    n, e = _nodes_edges(t)
    path = shared_path(n.sparkSession)
    write_graph(n, e, path)
    read = n.sparkSession.read.parquet
    back = read(f"{path}/nodes").select("cluster_id", "emission", F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit(None).cast("string").alias("b"))
    return back.unionByName(read(f"{path}/edges").select("cluster_id", "emission", F.lit("edge").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b")))


@query("SELECT result_id, num_documents, kg_stats.nodes AS nodes, kg_stats.edges AS edges, scores.consistency AS consistency, md5(generated_summary) AS summary_md5 FROM pipeline_results")
def results_sink(t: Callable) -> DataFrame:
    """Pipeline results written as JSON and read again."""
    rows = t("pipeline_results").select("result_id", "num_documents", "kg_stats", "scores", "generated_summary")
    path = shared_path(rows.sparkSession)
    write_json(rows, path)
    back = rows.sparkSession.read.schema(rows.schema).json(path)
    return back.select("result_id", "num_documents", "kg_stats.nodes", "kg_stats.edges", "scores.consistency", F.md5("generated_summary").alias("summary_md5"))


@query(f"SELECT md5({_strip('s')}) AS line_md5, count(*) AS lines FROM (SELECT unnest(string_split(regexp_replace(knowledge_graph, '\\r\\n?', chr(10), 'g'), chr(10))) AS s FROM accumulated WHERE knowledge_graph IS NOT NULL) GROUP BY 1")
def answers_sink(t: Callable) -> DataFrame:
    """Raw answers written as text files and read again, line by line."""
    rows = t("accumulated").where("knowledge_graph is not null").select(F.regexp_replace("knowledge_graph", "\r\n?", "\n").alias("text"))
    path = shared_path(rows.sparkSession)
    write_texts(rows, "text", path)
    back = rows.sparkSession.read.option("lineSep", "\n").text(path)
    return back.groupBy(F.md5(prompts.strip_ws(F.col("value"))).alias("line_md5")).agg(F.count("*").alias("lines"))


@query("""
    WITH m AS (SELECT cluster_id, list_transform(regexp_extract_all(text, '([A-Z][a-z]{3,})', 1), lambda x: lower(x)) AS m FROM
           (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY document_index) AS k FROM documents) WHERE k <= 5 AND trim(text) <> ''),
         p AS (SELECT cluster_id, unnest(list_zip(m[1:len(m)-1], m[2:len(m)])) AS p FROM m WHERE len(m) > 1)
    SELECT p[1] AS subject, 'next_to' AS relation, p[2] AS object, count(DISTINCT cluster_id) AS graphs FROM p WHERE p[1] <> p[2] GROUP BY 1, 2, 3""")
def kggen_sink(t: Callable) -> DataFrame:
    """Graphs of triples of each cluster's first documents written as JSON files and read again."""
    found = finding.found_relations(finding.first_documents(t("documents"))).withColumn("relation", F.lit("next_to"))
    path = shared_path(found.sparkSession)
    write_json(export_graph(found), path)
    return triples(read_kggen(found.sparkSession, path, multi_line=False)).groupBy("subject", "relation", "object").agg(F.count("*").alias("graphs"))


# ---- B: parsing -----------------------------------------------------------------------------------------------------


@query("""
    SELECT response_id FROM (SELECT DISTINCT response_id, knowledge_graph FROM accumulated)
    WHERE knowledge_graph IS NOT NULL AND NOT json_valid(knowledge_graph)""")
def json_bad_rows(t: Callable) -> DataFrame:
    """What a strict parser refuses before fences are stripped."""
    rows = t("accumulated").select("response_id", "knowledge_graph").distinct()
    return parsing.rejected(parsing.parse_graphs(rows, fences=False)).where("error = 'json_error'").select("response_id")


def _is(x: str, *kinds: str) -> str:
    return f"json_type({x}) IN ({', '.join(repr(k) for k in kinds)})"


def _number(x: str) -> str:
    return f"({_is(x, 'UBIGINT', 'BIGINT', 'DOUBLE', 'VARCHAR')} AND TRY_CAST({x} ->> '$' AS DOUBLE) IS NOT NULL)"


def _optional(e: str, key: str, rule: Callable[[str], str]) -> str:
    x = f"json_extract({e}, '$.{key}')"
    return f"({x} IS NULL OR {rule(x)})"


def _whole(x: str) -> str:
    return f"({_number(x)} AND TRY_CAST({x} ->> '$' AS DOUBLE) = floor(TRY_CAST({x} ->> '$' AS DOUBLE)))"


def _unit(x: str) -> str:
    return f"({_number(x)} AND TRY_CAST({x} ->> '$' AS DOUBLE) BETWEEN 0 AND 1)"


def _text(e: str, key: str) -> str:
    return f"coalesce({_is(f"json_extract({e}, '$.{key}')", 'VARCHAR')}, false)"


def _every(v: str, rule: Callable[[str], str]) -> Callable[[str], str]:
    """A list of which every member passes."""
    return lambda x: f"CASE WHEN {_is(x, 'ARRAY')} THEN len(list_filter(CAST({x} AS JSON[]), lambda {v}: NOT coalesce({rule(v)}, false))) = 0 ELSE false END"


def _object(v: str, *rules: str) -> str:
    return f"CASE WHEN {_is(v, 'OBJECT')} THEN {' AND '.join(rules)} ELSE false END"


_SPANS_OK = _every("s", lambda s: _object(s, _optional(s, "document_index", _whole), _optional(s, "quote", lambda x: _is(x, "VARCHAR")), _optional(s, "section", lambda x: _is(x, "VARCHAR", "NULL"))))
_ENTITIES_OK = _every("e", lambda e: _object(e, *[_text(e, k) for k in ("id", "name", "type")], _optional(e, "document_frequency", _whole), _optional(e, "confidence", _unit), _optional(e, "evidence", _SPANS_OK)))
_RELATIONS_OK = _every("r", lambda e: _object(
    e, *[_text(e, k) for k in ("source", "target", "relation_type")], _optional(e, "support_count", _whole), _optional(e, "source_documents", _every("d", _whole)),
    _optional(e, "confidence", _unit), _optional(e, "evidence", _SPANS_OK)))
_PATHS_OK = _every("p", lambda e: _object(e, f"coalesce({_every('n', lambda n: _is(n, 'VARCHAR'))(f"json_extract({e}, '$.path')")}, false)", _text(e, "description"), _optional(e, "confidence", _unit)))
_CHECKED = f"""
    WITH a AS (SELECT DISTINCT response_id, knowledge_graph FROM accumulated), b AS (SELECT response_id, {_stripped_sql('knowledge_graph')} AS t, knowledge_graph IS NULL AS gone FROM a),
      c AS (SELECT *, NOT gone AND json_valid(t) AS good FROM b), j AS (SELECT *, CASE WHEN good THEN CAST(t AS JSON) END AS g FROM c),
      v AS (SELECT response_id, g, CASE WHEN gone THEN 'no_text' WHEN NOT good THEN 'json_error'
              WHEN json_type(g) <> 'OBJECT' OR NOT coalesce({_optional('g', 'entities', _ENTITIES_OK)} AND {_optional('g', 'relations', _RELATIONS_OK)}
                   AND {_optional('g', 'reasoning_paths', _PATHS_OK)}, false) THEN 'schema_error' END AS error FROM j)"""
_SIZE = "coalesce(json_array_length(g, '$.{}'), 0)"


@query(_CHECKED + " SELECT response_id, error FROM v WHERE error IS NOT NULL")
def kg_rejected(t: Callable) -> DataFrame:
    return parsing.rejected(_parsed(t)).select("response_id", "error")


@query(_CHECKED + """, ids AS (SELECT response_id, list_transform(coalesce(CAST(json_extract(g, '$.entities') AS JSON[]), []), lambda e: e ->> '$.id') AS ids,
             coalesce(CAST(json_extract(g, '$.relations') AS JSON[]), []) AS rels FROM v WHERE error IS NULL)
    SELECT response_id, error FROM v WHERE error IS NOT NULL
    UNION ALL SELECT response_id, 'schema_error' FROM ids WHERE len(list_filter(rels, lambda r: NOT list_contains(ids, r ->> '$.source') OR NOT list_contains(ids, r ->> '$.target'))) > 0""")
def kg_rejected_strict(t: Callable) -> DataFrame:
    return parsing.rejected(_parsed(t, strict=True)).select("response_id", "error")


@query(_CHECKED + f""" SELECT response_id, CAST({_SIZE.format('entities')} AS INTEGER) AS entities, CAST({_SIZE.format('relations')} AS INTEGER) AS relations,
    CAST({_SIZE.format('reasoning_paths')} AS INTEGER) AS reasoning_paths FROM v WHERE error IS NULL""")
def kg_parsed_sizes(t: Callable) -> DataFrame:
    ok = _parsed(t).where("error is null")
    return ok.select("response_id", *[F.size(f"parsed.{c}").alias(c) for c in ("entities", "relations", "reasoning_paths")])


@query(_CHECKED + """, e AS (SELECT response_id, unnest(coalesce(CAST(json_extract(g, '$.entities') AS JSON[]), [])) AS e, generate_subscripts(coalesce(CAST(json_extract(g, '$.entities') AS JSON[]), []), 1) - 1 AS pos FROM v WHERE error IS NULL)
    SELECT response_id, CAST(pos AS INTEGER) AS pos, e ->> '$.name' AS name, CAST(coalesce(TRY_CAST(e ->> '$.document_frequency' AS DOUBLE), 1) AS BIGINT) AS document_frequency,
           coalesce(TRY_CAST(e ->> '$.confidence' AS DOUBLE), 1) AS confidence, CAST(coalesce(json_array_length(e, '$.evidence'), 0) AS INTEGER) AS spans FROM e""")
def kg_json(t: Callable) -> DataFrame:
    """Validated graphs written as JSON and read again: the entities with the defaults of what was left out."""
    kg = parsing.to_json(_parsed(t)).select("response_id", F.from_json("kg_json", parsing.GRAPH_SCHEMA).alias("kg"))
    e = kg.select("response_id", F.posexplode("kg.entities").alias("pos", "e"))
    return e.select("response_id", "pos", "e.name", "e.document_frequency", "e.confidence", F.size("e.evidence").alias("spans"))


_REPORT_ROWS = """
    WITH r AS (SELECT response_id, any_value(grader_reports) AS l FROM accumulated GROUP BY 1), x AS (SELECT response_id, unnest(l) AS r, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS pos FROM r),
      y AS (SELECT *, r.overall_score IS NOT NULL AND NOT r.overall_score BETWEEN 0 AND 1 OR len(list_filter(coalesce(r.issues, []), lambda i: i IS NULL)) > 0 AS bad FROM x WHERE r IS NOT NULL)"""


def _report_texts(t: Callable) -> DataFrame:
    rows = t("accumulated").select("response_id", "grader_reports").dropDuplicates(["response_id"])
    texts = rows.select("response_id", F.posexplode("grader_reports").alias("pos", "r")).where("r is not null").select(F.struct("response_id", "pos").alias("at"), F.to_json("r").alias("report"))
    return parsing.parse_reports(texts, "at", "report").select("at.*", "parsed", "error")


@query(_REPORT_ROWS + """
    SELECT response_id, pos, coalesce(r.overall_score, 0) AS overall_score, coalesce(r.passes_threshold, false) AS passes_threshold, coalesce(r.feedback_summary, '') AS feedback_summary,
           CAST(len(coalesce(r.issues, [])) AS INTEGER) AS issues, CAST(len(list_filter(coalesce(r.issues, []), lambda i: coalesce(i.severity, 'medium') = 'medium')) AS INTEGER) AS medium FROM y WHERE NOT bad""")
def grader_parsed(t: Callable) -> DataFrame:
    """Grader reports as a model would write them, parsed with the defaults of what is missing."""
    ok = _report_texts(t).where("error is null")
    medium = F.size(F.filter("parsed.issues", lambda i: i["severity"] == "medium")).alias("medium")
    return ok.select("response_id", "pos", *[f"parsed.{c}" for c in ("overall_score", "passes_threshold", "feedback_summary")], F.size("parsed.issues").alias("issues"), medium)


@query(f"""
    WITH a AS (SELECT DISTINCT response_id, 'So here it is: ' || regexp_extract(knowledge_graph, '(?s)\\{{.*\\}}') || ' (end)' AS t FROM accumulated WHERE knowledge_graph IS NOT NULL)
    SELECT response_id, json_valid(regexp_extract(t, '(?s)\\{{.*\\}}')) AS repaired FROM a""")
def kg_repaired(t: Callable) -> DataFrame:
    """Answers with prose around the graph, none of which is JSON as it stands, sent back to the model for repair."""
    body = F.regexp_extract("knowledge_graph", r"(?s)\{.*\}", 0)
    rows = t("accumulated").where("knowledge_graph is not null").select("response_id", F.concat(F.lit("So here it is: "), body, F.lit(" (end)")).alias("answer")).distinct()
    good, bad = with_repairs(rows, RuleModel(), parsing.parse_graphs, "response_id")
    return good.select("response_id", F.lit(True).alias("repaired")).unionByName(bad.select("response_id", (F.col("error") != "json_error").alias("repaired")))


@query("""
    WITH i AS (SELECT response_id, CASE WHEN contains(k, '```') THEN string_split(substr(k, strpos(k, '```') + 3), '```')[1] ELSE k END AS b FROM (SELECT DISTINCT response_id, knowledge_graph AS k FROM accumulated WHERE knowledge_graph IS NOT NULL)),
      g AS (SELECT response_id, CAST(regexp_replace(b, '^json', '') AS JSON) AS g FROM i WHERE json_valid(regexp_replace(b, '^json', '')))
    SELECT response_id, count(*) AS entities FROM (SELECT response_id, unnest(CASE WHEN json_type(json_extract(g, '$.entities')) = 'ARRAY' THEN CAST(json_extract(g, '$.entities') AS JSON[]) ELSE [] END) AS e FROM g) WHERE json_type(e) = 'OBJECT' GROUP BY 1""")
def kg_permissive(t: Callable) -> DataFrame:
    """The permissive reading: the first fenced block, whatever its elements are like."""
    rows = t("accumulated").where("knowledge_graph is not null").select("response_id", "knowledge_graph").distinct()
    v = rows.select("response_id", F.try_variant_get(F.try_parse_json(fenced_block(F.col("knowledge_graph"))), "$.entities", "array<struct<id:string>>").alias("e"))
    return v.select("response_id", F.explode("e").alias("e")).where("e is not null").groupBy("response_id").agg(F.count("*").alias("entities"))


# ---- C: prompts -----------------------------------------------------------------------------------------------------

# The texts of the contract, written out: fields, order, lists and separators as the model is shown them.
_TYPES = (
    "Entity types allowed: PERSON, ORGANIZATION, LOCATION, EVENT, CONCEPT, DISEASE, TREATMENT, SYMPTOM, METRIC, DATE\n"
    "Relation types allowed: CAUSES, TREATS, LOCATED_IN, AFFILIATED_WITH, ANNOUNCED, ACQUIRED, PARTICIPATED_IN, RESULTED_IN, CONTRADICTS, SUPPORTS, MEASURED_BY, RELATED_TO\n"
)
_PLAIN = (
    'Answer with one JSON object and nothing else: {"entities": [{"id": "entity_1", "name": "...", "type": "...", "document_frequency": 1, "confidence": 0.9}], '
    '"relations": [{"source": "entity_1", "target": "entity_2", "relation_type": "...", "support_count": 1, "source_documents": [0], "confidence": 0.9}]}'
)
_QUOTED = _PLAIN.replace('"confidence": 0.9}', '"confidence": 0.9, "evidence": [{"document_index": 0, "quote": "...", "section": null}]}')
_KG = '{"entities": [], "relations": []}'
_CLUSTERS = _CONTEXT + " SELECT cluster_id, md5({}) AS prompt_md5 FROM c"


def _prompted(t: Callable, build: Callable) -> DataFrame:
    return prompts.context(t("documents")).select("cluster_id", F.md5(build(F.col("context"))).alias("prompt_md5"))


_GRADE = (
    "TASK: grade\nGrade the graph against the documents. Check for: HALLUCINATION, MISSING_ENTITY, MISSING_RELATION, CONTRADICTION, WEAK_EVIDENCE, WRONG_TYPE.\n" + _TYPES
    + 'Answer with one JSON object: {"overall_score": 0.0, "issues": [{"issue_type": "...", "element_id": null, "description": "...", "severity": "low|medium|high"}], "passes_threshold": false, "feedback_summary": "..."}'
    + "\n\nGRAPH:\n" + _KG + "\n\nDOCUMENTS:\n"
)


@query(_CLUSTERS.format(f"{_literal(_GRADE)} || context"))
def prompt_grader(t: Callable) -> DataFrame:
    return _prompted(t, lambda c: prompts.grader_prompt(c, F.lit(_KG), Ontology()))


_REFINE = "TASK: refine\nMend the graph by the feedback; keep what it does not name.\n" + _TYPES + _QUOTED + "\n\nFEEDBACK:\nnone\n\nGRAPH:\n" + _KG + "\n\nDOCUMENTS:\n"


@query(_CLUSTERS.format(f"{_literal(_REFINE)} || context"))
def prompt_refinement(t: Callable) -> DataFrame:
    return _prompted(t, lambda c: prompts.refinement_prompt(c, F.lit(_KG), F.lit("none"), Ontology()))


_SECTION_TAIL = "\n" + _TYPES + "Document number: 0\n" + _QUOTED + "\n\nTEXT:\n"


@query(f"""
    SELECT span_id, md5('TASK: evidence' || chr(10) || 'Extract facts from the section ' || section || '. ' || CASE lower(section)
      WHEN 'abstract' THEN 'Take what the text is about and what it claims, in broad entities.' WHEN 'introduction' THEN 'Take the setting, the question asked and why it is asked.'
      WHEN 'methods' THEN 'Take what was done: procedures, instruments, data and tools.' WHEN 'results' THEN 'Take what was found: figures, comparisons and outcomes.'
      WHEN 'discussion' THEN 'Take what the findings mean, what limits them and what remains to do.' WHEN 'conclusion' THEN 'Take the last word on each claim.'
      ELSE 'Take every entity and relation that matters here.' END || {_literal(_SECTION_TAIL)} || quote) AS prompt_md5
    FROM (SELECT DISTINCT span_id, section, quote FROM evidence_spans)""")
def prompt_section(t: Callable) -> DataFrame:
    rows = t("evidence_spans").select("span_id", "section", "quote").distinct()
    return rows.select("span_id", F.md5(prompts.section_prompt(F.col("quote"), F.col("section"), Ontology())).alias("prompt_md5"))


_PATHS = (
    "TASK: paths\nFind chains of three entities or more, each joined to the next by a relation of the graph; three chains if there are as many.\n"
    'Answer with one JSON object: {"reasoning_paths": [{"path": ["entity_1", "entity_2", "entity_3"], "description": "...", "confidence": 0.9}]}\n\nGRAPH:\n'
)


@query(f"SELECT response_id, md5({_literal(_PATHS)} || knowledge_graph) AS prompt_md5 FROM (SELECT DISTINCT response_id, knowledge_graph FROM accumulated)")
def prompt_paths(t: Callable) -> DataFrame:
    rows = t("accumulated").select("response_id", "knowledge_graph").distinct()
    return rows.select("response_id", F.md5(prompts.paths_prompt(F.col("knowledge_graph"))).alias("prompt_md5"))


_LEGACY = "TASK: ontology\nExtract entities (PERSON, ORGANIZATION, LOCATION, EVENT, CONCEPT) and their relations as short verb phrases.\n" + _PLAIN + "\n\nDOCUMENTS:\n"


@query(f"""
    WITH k AS (SELECT cluster_id, text, row_number() OVER (PARTITION BY cluster_id ORDER BY document_index) AS k FROM documents)
    SELECT cluster_id, md5({_literal(_LEGACY)} || string_agg(text, chr(10) || chr(10) || '---DOCUMENT---' || chr(10) || chr(10) ORDER BY k)) AS prompt_md5 FROM k WHERE k <= 5 GROUP BY 1""")
def prompt_legacy(t: Callable) -> DataFrame:
    ctx = prompts.context(t("documents"), separator=prompts.LEGACY_BREAK, headers=False)
    return ctx.select("cluster_id", F.md5(prompts.legacy_prompt(F.col("context"))).alias("prompt_md5"))


_SHORT = (
    'TASK: ontology\nExtract a graph as JSON: {"entities": [{"id", "name", "type", "document_frequency", "confidence"}], '
    '"relations": [{"source", "target", "relation_type", "support_count", "confidence"}]}\n\nDOCUMENTS:\n'
)


@query(_CLUSTERS.format(f"{_literal(_SHORT)} || context"))
def prompt_pipeline(t: Callable) -> DataFrame:
    return _prompted(t, prompts.pipeline_prompt)


# ---- D, E, F --------------------------------------------------------------------------------------------------------


@query(f"""
    WITH RECURSIVE {_ENT}, n AS (SELECT cluster_id, name, count(*) AS n, regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS key FROM ent WHERE name IS NOT NULL GROUP BY 1, 2),
      b AS (SELECT * FROM n WHERE key <> ''), k AS MATERIALIZED (SELECT DISTINCT cluster_id, key FROM b),
      near AS MATERIALIZED (SELECT x.cluster_id, x.key AS a, y.key AS b FROM k x JOIN k y ON y.cluster_id = x.cluster_id AND x.key <> y.key AND length(x.key) >= 6 AND length(y.key) >= 6
               AND abs(length(x.key) - length(y.key)) <= 1 AND levenshtein(regexp_replace(x.key, '[^\x00-\x7F]', '?', 'g'), regexp_replace(y.key, '[^\x00-\x7F]', '?', 'g')) <= 1),
      reach AS (SELECT cluster_id, key AS v, key AS l FROM k UNION SELECT e.cluster_id, e.b, r.l FROM reach r JOIN near e ON e.cluster_id = r.cluster_id AND e.a = r.v WHERE r.l < e.b),
      lab AS (SELECT cluster_id, v, min(l) AS l FROM reach GROUP BY 1, 2)
    SELECT b.cluster_id, b.name AS alias, first_value(b.name) OVER (PARTITION BY b.cluster_id, lab.l ORDER BY b.n DESC, b.name) AS canonical
    FROM b JOIN lab ON lab.cluster_id = b.cluster_id AND lab.v = b.key""")
def kg_alias_similar(t: Callable) -> DataFrame:
    return finding.similar_aliases(graphs.entity_rows(t("entities")))


@query(f"""
    WITH {_ENT}, {_REL}, {_SPAN}, l AS (SELECT owner_kind, owner_pk, max(length(quote)) AS longest FROM span GROUP BY 1, 2),
      o AS (SELECT DISTINCT 'entity' AS owner_kind, entity_pk AS owner_pk FROM ent UNION ALL SELECT DISTINCT 'relation', relation_pk FROM rel),
      x AS (SELECT o.*, CASE WHEN l.longest IS NULL THEN 'none' WHEN l.longest < 60 THEN 'short' END AS reason FROM o LEFT JOIN l USING (owner_kind, owner_pk))
    SELECT * FROM x WHERE reason IS NOT NULL""")
def evidence_weak(t: Callable) -> DataFrame:
    return auditing.weak_evidence(t("entities"), t("relations"), t("evidence_spans"), 60)


_FOLD = "lower(regexp_replace({}, '[ \\t\\r\\n\\f]+', ' ', 'g'))"


@query(f"""
    WITH {_SPAN} SELECT s.span_id FROM span s JOIN documents d ON d.cluster_id = s.cluster_id AND d.document_index = s.document_index
    WHERE s.quote IS NOT NULL AND NOT contains(d.text, s.quote) AND contains({_FOLD.format('d.text')}, {_FOLD.format('s.quote')})""")
def evidence_loose(t: Callable) -> DataFrame:
    return auditing.loose_quotes(t("evidence_spans"), t("documents"))


@query(f"""
    WITH {_GRAPH}, {_SPAN}, m AS (SELECT DISTINCT e.cluster_id, e.emission, s.document_index, s.quote, e.id FROM ent e JOIN span s ON s.owner_kind = 'entity' AND s.owner_pk = e.entity_pk WHERE e.id <> '' AND s.quote IS NOT NULL),
      p AS (SELECT DISTINCT x.cluster_id, x.emission, x.id AS a, y.id AS b FROM m x JOIN m y ON y.cluster_id = x.cluster_id AND y.emission = x.emission AND y.document_index = x.document_index AND y.quote = x.quote AND x.id < y.id)
    SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.cluster_id = p.cluster_id AND e.emission = p.emission AND least(e.source, e.target) = p.a AND greatest(e.source, e.target) = p.b)""")
def missing_relation_quoted(t: Callable) -> DataFrame:
    return auditing.unrelated_together(t("entities"), t("relations"), t("evidence_spans"))


@query(_GRAPHS + """, paths AS (SELECT response_id, pos, CASE WHEN json_type(json_extract(e, '$.path')) = 'ARRAY' THEN list_transform(CAST(json_extract(e, '$.path') AS JSON[]), lambda x: x ->> '$') ELSE [] END AS path FROM reasoning_path),
      known AS (SELECT DISTINCT response_id, least(e ->> '$.source', e ->> '$.target') AS a, greatest(e ->> '$.source', e ->> '$.target') AS b FROM relation),
      steps AS (SELECT response_id, pos, unnest(list_zip(path[1:len(path)-1], path[2:len(path)])) AS p FROM paths WHERE len(path) > 1),
      hit AS (SELECT s.response_id, s.pos, bool_and(k.a IS NOT NULL) AS joined FROM steps s LEFT JOIN known k ON k.response_id = s.response_id AND k.a = least(s.p[1], s.p[2]) AND k.b = greatest(s.p[1], s.p[2]) GROUP BY 1, 2)
    SELECT p.response_id, CAST(p.pos AS INTEGER) AS pos, CAST(len(p.path) AS INTEGER) AS nodes, len(p.path) >= 3 AND coalesce(h.joined, false) AS is_valid FROM paths p LEFT JOIN hit h USING (response_id, pos)""")
def path_valid(t: Callable) -> DataFrame:
    acc = t("accumulated")
    p, r = flatten.child_table(acc, "reasoning_path"), flatten.child_table(acc, "relation")
    return graphs.path_validity(p.select("response_id", "pos", "path"), r.select("response_id", "source", "target"), ["response_id"])


@query(_GRAPHS + """, n AS (SELECT 'entity' AS kind, response_id FROM entity UNION ALL SELECT 'relation', response_id FROM relation UNION ALL SELECT 'reasoning_path', response_id FROM reasoning_path),
      m AS (SELECT DISTINCT response_id, method FROM accumulated)
    SELECT m.method, count(*) FILTER (n.kind = 'entity') AS entity, count(*) FILTER (n.kind = 'relation') AS relation, count(*) FILTER (n.kind = 'reasoning_path') AS reasoning_path FROM m LEFT JOIN n USING (response_id) GROUP BY 1""")
def method_sizes(t: Callable) -> DataFrame:
    acc = t("accumulated")
    kinds = flatten.child_links(acc).groupBy("response_id").pivot("kind", ["entity", "relation", "reasoning_path"]).count()
    rows = acc.select("response_id", "method").distinct().join(kinds, "response_id", "left")
    return rows.groupBy("method").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("entity", "relation", "reasoning_path")])


@query(f"""
    WITH {_GRAPH} SELECT cluster_id, emission, 'entity' AS kind, first_ord AS pos, coalesce(a.name, 'null') || ' (' || coalesce(a.type, 'null') || ') df=' || coalesce(CAST(a.df AS VARCHAR), 'null')
      || ' confidence=' || coalesce(printf('%.2f', a.conf), 'null') AS line FROM nodes
    UNION ALL SELECT e.cluster_id, e.emission, 'relation', e.first_ord, coalesce(s.a.name, 'null') || ' -> ' || coalesce(g.a.name, 'null') || ' type=' || coalesce(e.a.type, 'null') || ' support='
      || coalesce(CAST(e.a.sup AS VARCHAR), 'null') || ' confidence=' || coalesce(printf('%.2f', e.a.conf), 'null') FROM edges e
    LEFT JOIN nodes s ON s.cluster_id = e.cluster_id AND s.emission = e.emission AND s.id = e.source LEFT JOIN nodes g ON g.cluster_id = e.cluster_id AND g.emission = e.emission AND g.id = e.target""")
def graph_details(t: Callable) -> DataFrame:
    return graphs.details(*_nodes_edges(t))


@query(f"""
    WITH {_REL}, {_SPAN}, j AS (SELECT r.cluster_id, r.source AS s, r.relation_type, r.target AS t, r.emission, r.ord, p.span_id, p.document_index, p.quote
      FROM span p JOIN rel r ON p.owner_kind = 'relation' AND p.owner_pk = r.relation_pk WHERE r.source IS NOT NULL AND r.target IS NOT NULL AND r.relation_type IS NOT NULL),
    f AS (SELECT *, rank() OVER (PARTITION BY cluster_id, s, relation_type, t, quote ORDER BY emission, ord) AS k FROM j)
    SELECT cluster_id, s, relation_type, t, span_id, document_index, quote FROM f WHERE k = 1""")
def kg_merge_relation_evidence(t: Callable) -> DataFrame:
    return merging.merge_relation_evidence(t("entities"), t("relations"), t("evidence_spans"))


@query(_GRAPHS + """, a AS (SELECT DISTINCT response_id, cluster_index FROM accumulated)
    SELECT a.cluster_index, array_to_string(list_transform(CAST(json_extract(e, '$.path') AS JSON[]), lambda x: x ->> '$'), '>') AS path, count(*) AS times
    FROM reasoning_path p JOIN a USING (response_id) WHERE json_type(json_extract(e, '$.path')) = 'ARRAY' GROUP BY 1, 2""")
def kg_merge_paths(t: Callable) -> DataFrame:
    """The paths of a cluster's graphs by all methods, as a bag: how often each occurs."""
    acc = t("accumulated").select("response_id", "cluster_index", "method", "knowledge_graph")
    parts = [acc.where(F.col("method").eqNullSafe(m) if m else ~F.coalesce(F.col("method").isin(METHODS), F.lit(False))) for m in (*METHODS, None)]
    where = acc.select("response_id", "cluster_index").distinct()
    paths = merging.merge_paths(*[flatten.child_table(part, "reasoning_path").select("response_id", "path") for part in parts])
    return paths.where("path is not null").join(where, "response_id").groupBy("cluster_index", F.concat_ws(">", "path").alias("path")).agg(F.count("*").alias("times"))


_SENTENCES = f"""
    c AS (SELECT cluster_id, document_index, {_strip('text')} AS text FROM documents),
    d AS (SELECT cluster_id, text, row_number() OVER (PARTITION BY cluster_id ORDER BY document_index) AS i FROM c WHERE text <> ''),
    s AS (SELECT cluster_id, i, unnest(regexp_extract_all(text, '[^.!?\\n]+[.!?]?')) AS s, generate_subscripts(regexp_extract_all(text, '[^.!?\\n]+[.!?]?'), 1) AS pos FROM d WHERE i <= {{}})"""


@query(f"""
    WITH {_SENTENCES.format(3)},
      shared AS (SELECT cluster_id, e FROM (SELECT cluster_id, document_index, lower(unnest(regexp_extract_all(text, '[A-Z][a-z]{{3,}}'))) AS e FROM documents) GROUP BY 1, 2 HAVING count(DISTINCT document_index) >= 2),
      t AS (SELECT cluster_id, i, pos, {_strip('s')} AS s FROM s), u AS (SELECT * FROM t WHERE s <> ''),
      n AS (SELECT DISTINCT cluster_id, i, pos, lower(unnest(regexp_extract_all(s, '[A-Z][a-z]{{3,}}'))) AS e FROM u),
      h AS (SELECT n.cluster_id, n.i, n.pos, count(*) AS hits FROM n JOIN shared USING (cluster_id, e) GROUP BY 1, 2, 3),
      r AS (SELECT u.*, row_number() OVER (PARTITION BY u.cluster_id ORDER BY coalesce(h.hits, 0) DESC, u.i, u.pos) AS k FROM u LEFT JOIN h USING (cluster_id, i, pos))
    SELECT cluster_id, md5(string_agg(s, ' ' ORDER BY i, pos)) AS summary_md5 FROM r WHERE k <= 3 GROUP BY 1""")
def summaries(t: Callable) -> DataFrame:
    return scoring.ranked_summaries(t("documents")).select("cluster_id", F.md5("summary").alias("summary_md5"))


@query("SELECT date_trunc('day', arrived_at)::TIMESTAMP AS day, cluster_id, count(*) AS rows FROM entities WHERE arrived_at IS NOT NULL GROUP BY 1, 2")
def arrivals_daily(t: Callable) -> DataFrame:
    """The stream's windows of arrivals, over the table as a whole."""
    seen = accumulate.windowed_arrivals(t("entities").select("cluster_id", "arrived_at"))
    return seen.select(F.col("window.start").alias("day"), "cluster_id", "rows")


@query()
def gcn_scores(t: Callable) -> DataFrame:
    n, e = _nodes_edges(t)
    return features.forward(features.node_features(n, e), e, features.default_weights())


# ---- G: the methods -------------------------------------------------------------------------------------------------

_NAMES = f"""
    {_SENTENCES.format(5)},
    m AS (SELECT cluster_id, list_transform(regexp_extract_all(s, '[A-Z][a-z]{{3,}}'), lambda x: lower(x)) AS m FROM s),
    docs AS (SELECT cluster_id, count(*) AS n_documents FROM d WHERE i <= 5 GROUP BY 1),
    ne AS (SELECT cluster_id, count(DISTINCT e) AS n FROM (SELECT cluster_id, unnest(m) AS e FROM m) GROUP BY 1),
    pairs AS (SELECT DISTINCT cluster_id, p[1] AS a, p[2] AS b FROM (SELECT cluster_id, unnest(list_zip(m[1:len(m)-1], m[2:len(m)])) AS p FROM m WHERE len(m) > 1) WHERE p[1] <> p[2]),
    nr AS (SELECT cluster_id, count(*) AS n FROM pairs GROUP BY 1),
    found AS (SELECT docs.*, coalesce(ne.n, 0) AS n_entities, coalesce(nr.n, 0) AS n_relations FROM docs LEFT JOIN ne USING (cluster_id) LEFT JOIN nr USING (cluster_id))"""


def _run_sql(method: str, iterations: str, score: str) -> str:
    return f"WITH{_NAMES} SELECT cluster_id, '{method}' AS method, n_documents, CAST({iterations} AS BIGINT) AS iterations_used, CAST({score} AS DOUBLE) AS final_score, n_entities, n_relations FROM found"


def _run(response: Response) -> DataFrame:
    """One row a cluster, with the sizes of its graph."""
    kg = F.from_json("kg_json", parsing.GRAPH_SCHEMA)
    sizes = response.graphs.select("cluster_id", kg.alias("kg")).select("cluster_id", F.size("kg.entities").cast("bigint").alias("n_entities"), F.size("kg.relations").cast("bigint").alias("n_relations"))
    return response.runs.join(sizes, "cluster_id").select("cluster_id", "method", "n_documents", "iterations_used", "final_score", "n_entities", "n_relations")


@query(_run_sql("ontology_constrained", "0", "NULL"))
def extract_ontology(t: Callable) -> DataFrame:
    return _run(KGEngine(t("documents")).ontology_extraction())


@query(_run_sql("evidence_traced", "0", "NULL"))
def extract_evidence(t: Callable) -> DataFrame:
    return _run(KGEngine(t("documents")).evidence_extraction())


@query(_run_sql("two_agent", "1", "1"))
def extract_two_agent(t: Callable) -> DataFrame:
    return _run(KGEngine(t("documents")).two_agent_extraction())


@query(_run_sql("two_agent", "CASE WHEN n_entities > 3 THEN 2 ELSE 1 END", "CASE WHEN n_entities > 3 THEN 1 ELSE CAST(1 AS DOUBLE) - CAST(0.1 AS DOUBLE) * n_entities END"))
def extract_refined(t: Callable) -> DataFrame:
    """Two agents over a model that misquotes every entity at first: a graph of four or more is sent back with the grader's
    feedback, mended, and passes the second time."""
    return _run(KGEngine(t("documents"), MisquotingModel()).two_agent_extraction())


@query(_run_sql("evidence_accumulation", "0", "NULL"))
def extract_accumulate(t: Callable) -> DataFrame:
    return _run(KGEngine(t("documents")).accumulate_extraction())


@query("WITH" + _NAMES + """, hops AS (SELECT x.cluster_id, count(*) AS n FROM pairs x JOIN pairs y ON y.cluster_id = x.cluster_id AND y.a = x.b AND y.b <> x.a GROUP BY 1)
    SELECT cluster_id, 'full_pipeline' AS method, n_documents, CAST(1 AS BIGINT) AS iterations_used, CAST(1 AS DOUBLE) AS final_score, n_entities, n_relations, coalesce(hops.n, 0) AS n_paths, false AS score_is_stale
    FROM found LEFT JOIN hops USING (cluster_id)""")
def extract_full_pipeline(t: Callable) -> DataFrame:
    response = KGEngine(t("documents")).full_pipeline()
    paths = response.graphs.select("cluster_id", F.size(F.from_json("kg_json", parsing.GRAPH_SCHEMA)["reasoning_paths"]).cast("bigint").alias("n_paths"))
    return _run(response).join(paths, "cluster_id").join(response.runs.select("cluster_id", "score_is_stale"), "cluster_id")


@query(f"""
    WITH k AS (SELECT cluster_index, knowledge_graph AS t, row_number() OVER (PARTITION BY cluster_index ORDER BY response_id, arrived_at) AS k FROM accumulated),
      a AS (SELECT cluster_index, CAST({_stripped_sql('t')} AS JSON) AS g FROM k WHERE k = 1 AND t IS NOT NULL AND json_valid({_stripped_sql('t')})),
      v AS (SELECT cluster_index, g FROM a WHERE json_type(g) = 'OBJECT' AND coalesce({_optional('g', 'entities', _ENTITIES_OK)} AND {_optional('g', 'relations', _RELATIONS_OK)} AND {_optional('g', 'reasoning_paths', _PATHS_OK)}, false))
    SELECT printf('c%08d', cluster_index) AS cluster_id, 'ontology_constrained' AS method, CAST({_SIZE.format('entities')} AS BIGINT) AS n_entities, CAST({_SIZE.format('relations')} AS BIGINT) AS n_relations
    FROM v JOIN (SELECT DISTINCT cluster_id FROM documents WHERE {_strip('text')} <> '') d ON d.cluster_id = printf('c%08d', cluster_index)""")
def extract_replayed(t: Callable) -> DataFrame:
    """The ontology method over recorded answers: each cluster's first response stands for what its prompt was answered."""
    engine = KGEngine(t("documents"))
    asked = engine.context.select("cluster_id", F.sha2(prompts.ontology_prompt(F.col("context"), Ontology()), 256).alias("prompt_hash"))
    first = t("accumulated").groupBy(F.format_string("c%08d", "cluster_index").alias("cluster_id")).agg(F.min_by("knowledge_graph", F.struct("response_id", "arrived_at")).alias("answer"))
    engine.model = ReplayModel(asked.join(first, "cluster_id").select("prompt_hash", "answer"))
    return _run(engine.ontology_extraction()).select("cluster_id", "method", "n_entities", "n_relations")


@query(f"""
    WITH RECURSIVE {_NAMES},
      und AS MATERIALIZED (SELECT cluster_id, a, b FROM pairs UNION SELECT cluster_id, b, a FROM pairs), vs AS (SELECT DISTINCT cluster_id, unnest(m) AS v FROM m),
      reach AS (SELECT cluster_id, a AS v, a AS l FROM und UNION SELECT u.cluster_id, u.b, r.l FROM reach r JOIN und u ON u.cluster_id = r.cluster_id AND u.a = r.v WHERE r.l < u.b),
      lab AS (SELECT cluster_id, v, min(l) AS l FROM reach GROUP BY 1, 2),
      comp AS (SELECT vs.cluster_id, count(DISTINCT coalesce(lab.l, vs.v)) AS c FROM vs LEFT JOIN lab ON lab.cluster_id = vs.cluster_id AND lab.v = vs.v GROUP BY 1),
      st AS (SELECT f.cluster_id, n_documents, n_entities AS n, n_relations AS e, comp.c FROM found f JOIN comp USING (cluster_id)),
      sc AS (SELECT *, {_SCORES} FROM st),
      ctx AS (SELECT cluster_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY i), 1, 2000) AS t FROM d WHERE i <= 3 GROUP BY 1),
      sm AS (SELECT cluster_id, trim(array_to_string(list_transform(regexp_extract_all(t, '[^.!?\\n]+[.!?]?')[1:3], lambda x: {_strip('x')}), ' ')) AS summary FROM ctx)
    SELECT cluster_id, n_documents AS num_documents, n AS nodes, e AS edges, c AS components, consistency, missing_entities, contradictions, fragmentation,
      CASE WHEN NOT (missing_entities > 0.5) AND NOT (fragmentation > 0.5) THEN 'generic_reextraction'
           ELSE concat_ws(',', CASE WHEN missing_entities > 0.5 THEN 'expand_retrieval' END, CASE WHEN fragmentation > 0.5 THEN 'rerank_documents' END) END AS actions,
      CAST(CASE WHEN consistency < 0.7 THEN 3 ELSE 0 END AS INTEGER) AS iterations, md5(summary) AS summary_md5
    FROM sc JOIN sm USING (cluster_id)""")
def pipeline_run(t: Callable) -> DataFrame:
    out = pipelines.run_pipeline(t("documents"))
    return out.select("cluster_id", "num_documents", "kg_stats.*", "scores.*", "actions", "iterations", F.md5("generated_summary").alias("summary_md5"))


@query()
def validator_run(t: Callable) -> DataFrame:
    return pipelines.run_validator(*_nodes_edges(t))
