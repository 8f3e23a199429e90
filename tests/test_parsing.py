"""Fences, strict JSON, lax coercion, repairs, methods."""

import json

import pytest
from pyspark.sql import functions as F

from skein.functions.text import fenced_block, strip_fences, strip_ws
from skein.operators import parsing
from skein.plans import engine, models, prompts
from skein.plans.engine import KGEngine
from skein.schemas import METHODS, ExtractionRequest, Ontology
from skein.sources.clusters import clean_documents, cluster_documents, join_documents, read_clusters
from skein.sources.graphs import aliases, read_graph_texts, read_kggen, triples, write_json, write_texts
from skein.streaming import accumulate

E = {"id": "a", "name": "A", "type": "T"}


def service_strip(text):
    text = text.strip()
    for head in ("```json", "```"):
        if text.startswith(head):
            text = text[len(head) :]
            break
    return (text[:-3] if text.endswith("```") else text).strip()


TEXTS = ["```json\n{}\n```", "```\n{}\n```", "  {} ", "say\n```json\n{}\n```", "```json {}", "{}```", "", " {} ", "``` ```", "\x1c{}\x1f\n"]


def test_fences(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select(strip_fences(F.col("t")), strip_ws(F.col("t"))).collect()
    assert [r[0] for r in got] == [service_strip(t) for t in TEXTS]
    assert [r[1] for r in got] == [t.strip() for t in TEXTS]
    blocks = [r[0] for r in df.select(fenced_block(F.col("t"))).collect()]
    assert blocks[0] == blocks[3] == "{}" and blocks[2] == "{}"


@pytest.mark.parametrize(
    ("text", "error"),
    [
        (json.dumps({"entities": [E]}), None), ("{}", None), ("[]", "schema_error"), ('{"a":1} x', "json_error"), ('{"entities": [', "json_error"), ('{"a": NaN}', "json_error"),
        (json.dumps({"entities": None}), "schema_error"), (json.dumps({"entities": [{"id": "a"}]}), "schema_error"), (json.dumps({"entities": [{**E, "document_frequency": "3"}]}), None),
        (json.dumps({"entities": [{**E, "document_frequency": 2.0}]}), None), (json.dumps({"entities": [{**E, "document_frequency": 2.5}]}), "schema_error"),
        (json.dumps({"entities": [{**E, "confidence": 1.2}]}), "schema_error"), (json.dumps({"entities": [{**E, "confidence": None}]}), "schema_error"),
        (json.dumps({"entities": [{**E, "evidence": [{"section": None}]}]}), None), (None, "no_text"), ('{"entities": [], "entities": [1]}', "schema_error"),
    ],
)
def test_rules(text, error):
    assert parsing.parse_text(text, parsing.graph_record)[1] == error


def test_parse_defaults_and_dead_letters(spark):
    good = {"entities": [{**E, "evidence": [{}]}], "relations": [{"source": "a", "target": "z", "relation_type": "T"}]}
    df = spark.createDataFrame([(1, json.dumps(good)), (2, "broken"), (3, None)], "response_id bigint, knowledge_graph string")
    p = parsing.parse_graphs(df).where("response_id = 1").first().parsed
    assert (p.entities[0].document_frequency, p.entities[0].confidence, p.entities[0].evidence[0].quote, p.relations[0].support_count) == (1, 1.0, "", 1)
    assert {r.response_id for r in parsing.rejected(parsing.parse_graphs(df)).collect()} == {2, 3}
    assert {r.response_id for r in parsing.rejected(parsing.parse_graphs(df, strict=True)).collect()} == {1, 2, 3}
    report = parsing.report_record({"issues": [{}]})
    assert report["issues"][0] == {"issue_type": "UNKNOWN", "element_id": None, "description": "", "severity": "medium"} and report["overall_score"] == 0.0


class Stubborn:
    """Broken at first; repairs on the second request."""

    def complete(self, asked):
        return ["{" if "PLEASE" in p else '{"entities": []}' if "Error" in p else "x" for p in asked]


def test_repairs(spark):
    ask = spark.createDataFrame([("a", "hello"), ("b", "PLEASE")], "cluster_id string, prompt string")
    good, bad = models.with_repairs(models.run_model(ask, Stubborn()), Stubborn(), parsing.parse_graphs, "cluster_id")
    assert {r.cluster_id for r in good.collect()} == {"a", "b"} and bad.count() == 0

    class Never:
        def complete(self, asked):
            return ["{" for _ in asked]

    good, bad = models.with_repairs(models.run_model(ask, Never()), Never(), parsing.parse_graphs, "cluster_id")
    assert good.count() == 0 and {r.error for r in bad.collect()} == {"json_error"}


def test_replay(spark):
    ask = spark.createDataFrame([("a", "p1"), ("b", "p2")], "cluster_id string, prompt string")
    rec = ask.where("cluster_id = 'a'").select(F.sha2("prompt", 256).alias("prompt_hash"), F.lit("r1").alias("answer"))
    assert {tuple(r) for r in models.replay(ask, rec).collect()} == {("a", "r1"), ("b", None)}


DOCS = [("c", 0, "  Anna met Boris. Boris left.  "), ("c", 1, ""), ("c", 2, "Anna wrote to Carla."), ("d", 0, "nothing here"), ("e", 0, None)]


def documents(spark):
    return spark.createDataFrame(DOCS, "cluster_id string, document_index int, text string")


def test_documents(spark):
    docs = clean_documents(documents(spark))
    assert {(r.cluster_id, r.document_index) for r in docs.collect()} == {("c", 0), ("c", 1), ("d", 0)}
    ctx = {r.cluster_id: r for r in prompts.context(docs).collect()}
    assert ctx["c"].context == "[DOCUMENT 0]\nAnna met Boris. Boris left.\n\n---\n\n[DOCUMENT 1]\nAnna wrote to Carla."
    clusters = spark.createDataFrame([(1, "c", " a |||||  ||||| b|||||"), (2, "d", None), (3, "e", "")], "row_id bigint, cluster_id string, document string")
    assert [(r.row_id, r.document_index, r.text) for r in cluster_documents(clusters).orderBy("document_index").collect()] == [(1, 0, "a"), (1, 1, "b")]
    assert join_documents(docs).where("cluster_id = 'c'").first().document.count("|||||") == 1


def test_methods(spark):
    engine = KGEngine(documents(spark))
    assert KGEngine.methods() == METHODS and KGEngine.health()["status"] == "ok"
    for method in (engine.ontology_extraction, engine.evidence_extraction, engine.accumulate_extraction):
        out = method()
        assert {r.cluster_id for r in out.graphs.collect()} == {"c", "d"}
        assert out.runs.where("final_score is not null").count() == 0
    two = engine.two_agent_extraction()
    assert two.runs.where("iterations_used >= 1 and final_score >= 0.7").count() == 2
    full = engine.full_pipeline()
    kg = json.loads(full.graphs.where("cluster_id = 'c'").first().kg_json)
    assert {e["name"] for e in kg["entities"]} == {"Anna", "Boris", "Carla"}
    assert {e["name"]: len(e.get("evidence", [])) for e in kg["entities"]}["Anna"] == 2
    none = KGEngine(documents(spark), request=ExtractionRequest(max_grader_iterations=0, cluster_ids=("c",))).two_agent_extraction()
    assert [r.iterations_used for r in none.runs.collect()] == [1]
    with pytest.raises(ValueError):
        ExtractionRequest(grader_threshold=2)


def test_low_grades_exhaust_the_loop(spark):
    class Harsh(models.RuleModel):
        def grade(self, kg_json, docs):
            return {"overall_score": 0.1, "feedback_summary": "bad"}

    out = KGEngine(documents(spark), Harsh(), ExtractionRequest(max_grader_iterations=2)).two_agent_extraction()
    assert {r.iterations_used for r in out.runs.collect()} == {3}
    full = KGEngine(documents(spark), Harsh(), ExtractionRequest(max_grader_iterations=1)).full_pipeline()
    assert {r.score_is_stale for r in full.runs.collect()} == {True}


def test_prompt_texts(spark):
    o = Ontology()
    df = spark.createDataFrame([("ctx", "{}", "fb", "Methods")], "c string, k string, f string, s string")
    row = df.select(
        prompts.grader_prompt(F.col("c"), F.col("k"), o), prompts.refinement_prompt(F.col("c"), F.col("k"), F.col("f"), o), prompts.section_prompt(F.col("c"), F.col("s"), o),
        prompts.paths_prompt(F.col("k")), prompts.legacy_prompt(F.col("c")), prompts.summary_prompt(F.col("k"), F.col("c")), prompts.repair_prompt(F.col("c"), F.col("f")),
    ).first()
    assert all(t.startswith("TASK: ") for t in row)
    assert prompts.SECTION_GUIDANCE["methods"] in row[2] and "HALLUCINATION" in row[0]


def test_files(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"entities": ["A"], "edges": ["r"], "relations": [{"subject": "A", "relation": "r", "object": "B"}], "entity_clusters": {"A": ["A", "a"]}}))
    g = read_kggen(spark, str(tmp_path / "g.json"))
    assert triples(g).first().object == "B" and aliases(g).count() == 2
    assert read_graph_texts(spark, str(tmp_path / "*.json")).count() == 1
    assert read_graph_texts(spark, str(tmp_path / "no*.json")).count() == 0
    write_json(spark.range(2), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    write_texts(documents(spark).where("cluster_id = 'd'"), "text", str(tmp_path / "txt"))
    spark.createDataFrame([("a|||||b", "s")], "document string, summary string").write.parquet(str(tmp_path / "cl"))
    assert cluster_documents(read_clusters(spark, str(tmp_path / "cl"))).count() == 2


def test_stream(spark, tmp_path):
    schema = "entity_pk bigint, cluster_id string, emission int, ord int, id string, name string, type string, document_frequency int, confidence double"
    src, out, cp = (str(tmp_path / x) for x in ("src", "out", "cp"))
    rows = [(1, "c", 0, 0, "a", "Ann", "P", 1, 0.2), (2, "c", 1, 0, "b", "ann", "P", 3, None), (3, "c", 0, 1, "c", None, "P", 1, 0.1)]
    for k, row in enumerate(rows):
        df = spark.createDataFrame([row], schema)
        df.write.mode("append").parquet(src)
        accumulate.accumulate_stream(spark, src, df.schema, out, cp).awaitTermination()
    got = spark.read.parquet(f"{out}/v=2").first()
    assert (got.first.name, got.document_frequency, got.confidence) == ("Ann", 3, 1.0)


def test_strict_one_shot_repair(spark):
    """Relations to undeclared entities go back to the model once."""

    class Mender:
        def complete(self, asked):
            return ['{"entities": []}' if "unknown entity" in p else '{"relations": [{"source": "a", "target": "b", "relation_type": "T"}]}' for p in asked]

    ask = spark.createDataFrame([("a", "hello")], "cluster_id string, prompt string")
    strict = lambda df, key, text: parsing.parse_graphs(df, key, text, strict=True)
    answers = models.run_model(ask, Mender())
    good, bad = models.with_repairs(answers, Mender(), strict, max_repairs=1, mend=("json_error", "schema_error"))
    assert good.count() == 1 and bad.count() == 0
    good, bad = models.with_repairs(answers, Mender(), strict)
    assert good.count() == 0 and bad.first().error == "schema_error"
    with pytest.raises(ValueError):
        models.model_named("other")
    assert isinstance(models.model_named("rules"), models.RuleModel)


def parsed_rows(spark, graphs):
    rows = [(c, e, json.dumps(g)) for c, e, g in graphs]
    df = spark.createDataFrame(rows, "cluster_id string, emission int, text string")
    parsed = parsing.parse_graphs(df.select(F.struct("cluster_id", "emission").alias("k"), "text"), "k", "text").where("error is null")
    return parsed.select("k.cluster_id", "k.emission", "parsed")


def test_merge_keeps_relations_and_lists(spark):
    """Relations without their ends stay and are listed; the first list of documents keeps its repeats; raw ids may meet."""
    e = lambda i, n: {"id": i, "name": n, "type": "X"}
    r = lambda s, t, d: {"source": s, "target": t, "relation_type": "R", "source_documents": d}
    rows = parsed_rows(spark, [("c", 0, {"entities": [e("a", "Ann"), e("b", "Bo")], "relations": [r("a", "b", [0, 0]), r("a", "ghost", [0])]}), ("c", 1, {"entities": [e("a", "Bo"), e("b", "ann")], "relations": [r("b", "a", [0, 2, 2]), r("a", "b", [3])]})])
    kg = json.loads(engine.merge_parsed(rows).first().kg_json)
    assert [(x["id"], x["name"]) for x in kg["entities"]] == [("entity_1", "Ann"), ("entity_2", "Bo")]
    assert [(x["source"], x["target"], x["source_documents"]) for x in kg["relations"]] == [("entity_1", "entity_2", [0, 0, 2]), ("entity_1", "ghost", [0]), ("entity_2", "entity_1", [3])]
    raw = json.loads(engine.merge_parsed(rows, "raw").first().kg_json)
    assert [(x["source"], x["target"], x["source_documents"]) for x in raw["relations"]] == [("a", "b", [0, 0, 3]), ("a", "ghost", [0]), ("b", "a", [0, 2, 2])]
    assert [tuple(x) for x in engine.unresolved_endpoints(rows).select("emission", "ord", "endpoint", "id").collect()] == [(0, 1, "target", "ghost")]


def test_refinement_reads_feedback(spark):
    """What the grader names is mended; what it does not name stays, an element without evidence anywhere goes."""
    docs = [(0, "Anna met Boris in Tavo. Boris left.")]
    kg = models.RuleModel.extract(docs)
    kg["entities"][0]["evidence"][0]["quote"] = "ANNA MET"
    kg["entities"].append({"id": "entity_9", "name": "Ghost", "type": "X", "document_frequency": 1, "confidence": 1.0, "evidence": [{"document_index": 0, "quote": "no such words", "section": None}]})
    report = models.RuleModel.grade(json.dumps(kg), docs)
    assert [i["element_id"] for i in report["issues"]] == ["entity_1", "entity_9"]
    mended = models.RuleModel.refine(json.dumps(kg), report["feedback_summary"], docs)
    assert [x["name"] for x in mended["entities"]] == ["Anna", "Boris", "Tavo"] and mended["relations"] == kg["relations"]
    assert models.RuleModel.grade(json.dumps(mended), docs)["issues"] == []
    text = "Anna met Boris. Carla met Dora in Tavo."
    d = spark.createDataFrame([("c", 0, text)], "cluster_id string, document_index int, text string")
    out = engine.KGEngine(d, models.model_named("misquoting")).two_agent_extraction()
    assert [(r.iterations_used, r.final_score) for r in out.runs.collect()] == [(2, 1.0)]
    assert "ANNA MET" not in out.graphs.first().kg_json


def test_replay_model(spark):
    """Recorded answers run any method; a prompt without one is rejected."""
    d = spark.createDataFrame([("c", 0, "Anna met Boris."), ("d", 0, "Carla left.")], "cluster_id string, document_index int, text string")
    live = engine.KGEngine(d)
    asked = live.context.select("cluster_id", prompts.ontology_prompt(F.col("context"), live.request.ontology).alias("prompt")).where("cluster_id = 'c'")
    recorded = models.run_model(asked, models.RuleModel()).join(asked, "cluster_id").select(F.sha2("prompt", 256).alias("prompt_hash"), "answer")
    out = engine.KGEngine(d, models.ReplayModel(recorded)).ontology_extraction()
    assert [r.cluster_id for r in out.graphs.collect()] == ["c"] and [(r.cluster_id, r.error) for r in out.rejected.collect()] == [("d", "no_text")]
    assert len(models.RuleModel.find_paths({"relations": [{"source": a, "target": b} for a, b in ("ab", "bc", "cd", "de", "ef")]})["reasoning_paths"]) == 4
