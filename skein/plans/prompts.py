"""Prompt texts as column expressions: fields, order, limits and separators are the contract with the model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import strip_ws
from skein.schemas import ISSUE_TYPES, MAX_DOCUMENTS, Ontology

DOCUMENT_BREAK = "\n\n---\n\n"
LEGACY_BREAK = "\n\n---DOCUMENT---\n\n"

#: What to look for in each section.
SECTION_GUIDANCE = {
    "abstract": "Take what the text is about and what it claims, in broad entities.",
    "introduction": "Take the setting, the question asked and why it is asked.",
    "methods": "Take what was done: procedures, instruments, data and tools.",
    "results": "Take what was found: figures, comparisons and outcomes.",
    "discussion": "Take what the findings mean, what limits them and what remains to do.",
    "conclusion": "Take the last word on each claim.",
}
OTHER_SECTION = "Take every entity and relation that matters here."

_ENTITY = '{"id": "entity_1", "name": "...", "type": "...", "document_frequency": 1, "confidence": 0.9%s}'
_RELATION = '{"source": "entity_1", "target": "entity_2", "relation_type": "...", "support_count": 1, "source_documents": [0], "confidence": 0.9%s}'
_EVIDENCE = ', "evidence": [{"document_index": 0, "quote": "...", "section": null}]'
_SHAPE = 'Answer with one JSON object and nothing else: {"entities": [' + _ENTITY + '], "relations": [' + _RELATION + "]}"


def context(documents: DataFrame, limit: int = MAX_DOCUMENTS, separator: str = DOCUMENT_BREAK, headers: bool = True) -> DataFrame:
    """(cluster_id, n_documents, context): the first ``limit`` documents of each cluster under their numbers.

    The limit is applied by a ranked window before anything is gathered, so a group holds ``limit`` texts at most."""
    k = F.row_number().over(Window.partitionBy("cluster_id").orderBy("document_index"))
    first = documents.withColumn("k", k).where(F.col("k") <= limit)
    part = F.concat(F.lit("[DOCUMENT "), (F.col("k") - 1).cast("string"), F.lit("]\n"), strip_ws(F.col("text"))) if headers else F.col("text")
    parts = F.array_sort(F.collect_list(F.struct("k", part.alias("p"))))
    return first.groupBy("cluster_id").agg(F.count("*").alias("n_documents"), F.array_join(F.transform(parts, lambda x: x["p"]), separator).alias("context"))


def summary_context(documents: DataFrame, limit: int = 3, size: int = 2000) -> DataFrame:
    """(cluster_id, context): the first texts joined by blank lines and cut to ``size`` characters."""
    return context(documents, limit, "\n\n", headers=False).select("cluster_id", F.substring("context", 1, size).alias("context"))


def _types(ontology: Ontology) -> str:
    return f"Entity types allowed: {', '.join(ontology.entity_types)}\nRelation types allowed: {', '.join(ontology.relation_types)}"


def ontology_prompt(ctx: Column, o: Ontology) -> Column:
    head = f"TASK: ontology\nExtract a knowledge graph from {o.domain_context}. Use no other types than these.\n{_types(o)}\n{_SHAPE % ('', '')}\n\nDOCUMENTS:\n"
    return F.concat(F.lit(head), ctx)


def evidence_prompt(ctx: Column, o: Ontology) -> Column:
    rule = "Every entity and relation needs evidence: the number of a document and a sentence copied from it word for word."
    head = f"TASK: evidence\nExtract a knowledge graph from {o.domain_context}.\n{_types(o)}\n{rule}\n{_SHAPE % (_EVIDENCE, _EVIDENCE)}\n\nDOCUMENTS:\n"
    return F.concat(F.lit(head), ctx)


def grader_prompt(ctx: Column, kg_json: Column, o: Ontology) -> Column:
    shape = '{"overall_score": 0.0, "issues": [{"issue_type": "...", "element_id": null, "description": "...", "severity": "low|medium|high"}], "passes_threshold": false, "feedback_summary": "..."}'
    head = f"TASK: grade\nGrade the graph against the documents. Check for: {', '.join(ISSUE_TYPES)}.\n{_types(o)}\nAnswer with one JSON object: {shape}\n\nGRAPH:\n"
    return F.concat(F.lit(head), kg_json, F.lit("\n\nDOCUMENTS:\n"), ctx)


def refinement_prompt(ctx: Column, kg_json: Column, feedback: Column, o: Ontology) -> Column:
    head = f"TASK: refine\nMend the graph by the feedback; keep what it does not name.\n{_types(o)}\n{_SHAPE % (_EVIDENCE, _EVIDENCE)}\n\nFEEDBACK:\n"
    return F.concat(F.lit(head), feedback, F.lit("\n\nGRAPH:\n"), kg_json, F.lit("\n\nDOCUMENTS:\n"), ctx)


def section_guidance(section: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SECTION_GUIDANCE.items() for x in kv])
    return F.coalesce(table[F.lower(section)], F.lit(OTHER_SECTION))


def section_prompt(text: Column, section: Column, o: Ontology, document_index: int = 0) -> Column:
    tail = f"\n{_types(o)}\nDocument number: {document_index}\n{_SHAPE % (_EVIDENCE, _EVIDENCE)}\n\nTEXT:\n"
    return F.concat(F.lit("TASK: evidence\nExtract facts from the section "), section, F.lit(". "), section_guidance(section), F.lit(tail), text)


def paths_prompt(kg_json: Column) -> Column:
    shape = '{"reasoning_paths": [{"path": ["entity_1", "entity_2", "entity_3"], "description": "...", "confidence": 0.9}]}'
    head = f"TASK: paths\nFind chains of three entities or more, each joined to the next by a relation of the graph; three chains if there are as many.\nAnswer with one JSON object: {shape}\n\nGRAPH:\n"
    return F.concat(F.lit(head), kg_json)


def legacy_prompt(ctx: Column) -> Column:
    return F.concat(F.lit("TASK: ontology\nExtract entities (PERSON, ORGANIZATION, LOCATION, EVENT, CONCEPT) and their relations as short verb phrases.\n" + _SHAPE % ("", "") + "\n\nDOCUMENTS:\n"), ctx)


def pipeline_prompt(ctx: Column) -> Column:
    """The shorter form: no ontology, no source documents."""
    return F.concat(F.lit('TASK: ontology\nExtract a graph as JSON: {"entities": [{"id", "name", "type", "document_frequency", "confidence"}], "relations": [{"source", "target", "relation_type", "support_count", "confidence"}]}\n\nDOCUMENTS:\n'), ctx)


def summary_prompt(description: Column, ctx: Column) -> Column:
    return F.concat(F.lit("TASK: summary\nSummarise in three or four sentences, grounded in graph and documents.\n\n"), description, F.lit("\n\nDOCUMENTS:\n"), ctx)


def repair_prompt(answer: Column, error: Column) -> Column:
    return F.concat(F.lit("TASK: repair\nThe text below is no valid JSON answer. Error: "), error, F.lit("\nAnswer with the mended JSON only.\n\nTEXT:\n"), answer)
