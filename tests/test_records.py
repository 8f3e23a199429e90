"""Flattening nested records and orphan references on small, odd inputs."""

import datetime as dt
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.operators import flatten, orphans

DAY = [dt.datetime(2024, 1, d) for d in range(1, 29)]
ACC = (
    "response_id bigint, method string, cluster_index int, num_documents int, knowledge_graph string, grader_reports array<struct<overall_score:double,"
    "issues:array<struct<issue_type:string,element_id:string,description:string,severity:string>>,passes_threshold:boolean,feedback_summary:string>>, "
    "iterations_used int, final_score double, metadata string, arrived_at timestamp, pos int"
)


def response(i, kg, reports=None, day=0):
    return (i, "m", 1, 1, kg if kg is None or isinstance(kg, str) else json.dumps(kg), reports, 0, None, None, DAY[day], 7)


def links(spark, rows):
    df = spark.createDataFrame(rows, ACC)
    return {tuple(r) for r in flatten.child_links(df).select("response_id", "kind", "parent_pos", "pos").collect()}


def test_shapes(spark):
    e, ev = {"id": "a", "name": "A", "type": "X"}, {"document_index": 0, "quote": "q"}
    rows = [
        response(1, {"entities": [e, None, {**e, "evidence": [ev, None, ev]}], "relations": None}),
        response(2, {"entities": {**e, "evidence": ev}}),
        response(3, {"entities": json.dumps([e, {**e, "evidence": json.dumps([ev])}])}),
        response(4, "```json\n" + json.dumps({"reasoning_paths": [{"path": ["a", "b"]}]}) + "\n```"),
        response(5, "Here it is: " + json.dumps({"relations": [{"source": "a", "evidence": [ev]}]}) + " done"),
        response(6, '{"entities": [{"id": "a"}'),
        response(7, None), response(8, ""), response(9, "no graph"), response(10, {"entities": []}), response(11, {"entities": "none"}),
        response(12, {"entities": [1, "x", [e], e]}),
    ]
    assert links(spark, rows) == {
        (1, "entity", -1, 0), (1, "entity", -1, 2), (1, "entity_evidence", 2, 0), (1, "entity_evidence", 2, 2),
        (2, "entity", -1, 0), (2, "entity_evidence", 0, 0),
        (3, "entity", -1, 0), (3, "entity", -1, 1), (3, "entity_evidence", 1, 0),
        (4, "reasoning_path", -1, 0), (5, "relation", -1, 0), (5, "relation_evidence", 0, 0), (12, "entity", -1, 3),
    }


def test_reports_and_repeats(spark):
    issue = ("HALLUCINATION", None, "d", None)
    reports = [(0.5, [issue, None, issue], True, ""), None, (0.1, None, None, None)]
    got = links(spark, [response(1, None, reports), response(1, None, reports, 5)])
    assert got == {(1, "grader_report", -1, 0), (1, "grader_report", -1, 2), (1, "grader_issue", 0, 0), (1, "grader_issue", 0, 2)}
    df = spark.createDataFrame([response(1, None, reports), response(1, None, reports, 5)], ACC)
    assert flatten.child_table(df, "grader_issue").count() == 2
    assert flatten.parent_table(df).count() == 1


def test_fields_and_coercion(spark):
    kg = {"entities": [{"id": 3, "name": "é\ud800", "document_frequency": "4", "confidence": "x", "extra": 1, "pos": 9}]}
    row = flatten.child_table(spark.createDataFrame([response(1, kg)], ACC), "entity").first()
    assert (row.id, row.document_frequency, row.confidence, row.pos) == ("3", 4, None, 0)


def test_braces_before_the_graph_and_texts_for_python(spark):
    rows = [
        response(1, 'Here is {the graph}: {"entities": [{"id": "a"}]}'), response(2, '{"entities": [{"id": "a"}], "entities": [{"id": "b"}, {"id": "c"}]}'),
        response(3, '{"entities": [{"id": "a"} {"id": "b"}]}'), response(4, '{"entities": [{"id": "a", "evidence": [{"quote": "q"}]'), response(5, '{"relations": {"source": "a", "x": NaN}}'),
    ]
    assert links(spark, rows) == {(1, "entity", -1, 0), (2, "entity", -1, 0), (2, "entity", -1, 1), (5, "relation", -1, 0)}


def test_jvm_and_python_read_alike(spark):
    """The same graphs, once as the JVM reads them and once, behind a brace that it refuses, as Python does."""
    rng = random.Random(9)
    odd = lambda: rng.choice([None, "x", "4", 4, 2.0, 2.5, True, [1, "2", None], {"k": 1}, "", "[1]"])
    span = lambda: rng.choice([odd(), {"document_index": odd(), "quote": "q", "section": rng.choice([None, "s"])}])
    item = lambda keys: rng.choice([odd(), {k: odd() for k in keys if rng.random() < 0.8} | {"evidence": rng.choice([odd(), span(), [span(), span()], json.dumps([{"quote": "z"}])])}])
    graphs = []
    for _ in range(150):
        g = {
            "entities": [item(["name", "document_frequency", "confidence"]) for _ in range(3)], "relations": rng.choice([odd(), [item(["support_count", "source_documents"]) for _ in range(3)]]),
            "reasoning_paths": [{"path": odd(), "confidence": odd()}],
        }
        graphs.append(json.dumps({k: v if rng.random() < 0.8 else json.dumps(v) for k, v in g.items()}, separators=(",", ":")))
    text = lambda v: str(v).replace(" ", "")  # noqa: E731  (spaces inside objects kept as text differ)
    for kind in flatten.GRAPH_TABLES:
        tables = [flatten.child_table(spark.createDataFrame([response(i, head + g) for i, g in enumerate(graphs)], ACC), kind).collect() for head in ("", "{- ")]
        assert {text(r) for r in tables[0]} == {text(r) for r in tables[1]}
        assert tables[0]


def test_empty(spark):
    df = spark.createDataFrame([], ACC)
    assert flatten.child_links(df).count() == 0
    for kind in [*flatten.GRAPH_TABLES, *flatten.REPORT_TABLES]:
        assert flatten.child_table(df, kind).count() == 0


def test_long_document(spark):
    kg = {"entities": [{"id": str(i), "name": "n" * 50, "evidence": [{"quote": "q"}] * (i % 3)} for i in range(20_000)]}
    assert len(links(spark, [response(1, kg)])) == 20_000 + sum(i % 3 for i in range(20_000))


def test_arrow_kernels_against_loops():
    rng = random.Random(3)
    lists = [None if rng.random() < 0.2 else [None if rng.random() < 0.2 else rng.randrange(9) for _ in range(rng.randrange(5))] for _ in range(200)]
    parent, pos, item = flatten.explode_list(pa.array(lists, pa.list_(pa.int64())))
    want = [(i, k, x) for i, row in enumerate(lists) for k, x in enumerate(row or []) if x is not None]
    assert list(zip(parent.to_pylist(), pos.to_pylist(), item.to_pylist(), strict=True)) == want


# ---- orphans

REL = "relation_pk bigint, cluster_id string, emission int, source string, target string, emitted_at timestamp, arrived_at timestamp, id string"
ENT = "entity_pk bigint, cluster_id string, emission int, id string, arrived_at timestamp, deleted_at timestamp, source string"


def reasons(spark, rel, ent):
    out = orphans.relation_orphans(spark.createDataFrame(rel, REL), spark.createDataFrame(ent, ENT))
    return {(r.relation_pk, r.endpoint): r.reason for r in out.collect()}


def test_reasons(spark):
    rel = [
        (1, "c", 0, "a", "b", DAY[0], DAY[10], "z"), (1, "c", 0, "a", "b", DAY[0], DAY[20], "z"),
        (2, "c", 0, "late", "gone", DAY[0], DAY[10], "z"), (3, "c", 0, None, "", DAY[0], DAY[10], "z"),
        (4, None, 0, "a", "a", DAY[0], DAY[10], "z"), (5, "c", 1, "a", "edge", None, DAY[10], "z"), (6, "c", 0, "a", "a", DAY[0], None, None),
    ]
    ent = [
        (1, "c", 0, "a", DAY[5], None, "s"), (2, "c", 0, "late", DAY[15], None, "s"), (3, "c", 0, "gone", DAY[2], DAY[10], "s"),
        (4, "c", 1, "edge", DAY[10], DAY[11], "s"), (5, "c", 0, "gone", DAY[3], DAY[4], "s"), (6, None, 0, "a", DAY[1], None, "s"), (7, "c", 0, None, DAY[1], None, "s"),
    ]
    assert reasons(spark, rel, ent) == {
        (1, "target"): "missing", (2, "source"): "late", (2, "target"): "deleted", (4, "source"): "missing", (4, "target"): "missing", (5, "source"): "missing",
    }


def test_orphans_brute_force(spark):
    rng = random.Random(5)
    ids = ["a", "b", "c", None, ""]
    rel = [(k, rng.choice("xy"), rng.randrange(2), rng.choice(ids), rng.choice(ids), DAY[0], DAY[rng.randrange(20)], "") for k in range(60)]
    ent = [(k, rng.choice("xy"), rng.randrange(2), rng.choice(ids), DAY[rng.randrange(20)], rng.choice([None, DAY[rng.randrange(20)]]), "") for k in range(25)]
    want = {}
    for pk, c, em, s, t, _, at, _ in rel:
        for end, ref in (("source", s), ("target", t)):
            rows = [e for e in ent if e[1:4] == (c, em, ref)]
            if ref and not any(e[4] <= at and (e[5] is None or e[5] > at) for e in rows):
                want[pk, end] = "missing" if not rows else "deleted" if any(e[4] <= at for e in rows) else "late"
    assert reasons(spark, rel, ent) == want


def test_match_semantics(spark):
    refs = spark.createDataFrame([(1, "a", "x"), (2, "a", None), (3, "q", None), (4, None, None), (5, "a", "z")], "n int, p string, q string")
    parents = spark.createDataFrame([("a", "x", 5)], "k string, l string, n int")
    find = lambda match: sorted(r.n for r in orphans.find_orphans(refs, parents, {"p": "k", "q": "l"}, match).collect())
    assert find("simple") == [5]
    assert find("partial") == [3, 5]
    assert find("full") == [2, 3, 5]
    with pytest.raises(ValueError):
        find("other")


def test_partial_sources(spark):
    rel = [(1, "c", 0, "a", None, None, None, None), (1, "c", 0, "a", None, None, None, None), (2, "c", 0, None, None, None, None, None), (3, "q", 0, None, None, None, None, None),
           (4, None, None, None, None, None, None, None), (5, None, 0, "a", None, None, None, None), (6, "c", 1, "a", None, None, None, None)]
    ent = [(1, "c", 0, "a", None, None, "s"), (2, "c", 1, None, None, None, "s")]
    got = orphans.source_orphans(spark.createDataFrame(rel, REL), spark.createDataFrame(ent, ENT)).collect()
    assert {(r.relation_pk, r.null_mask) for r in got} == {(3, 4), (6, 0)}


def test_empty_tables(spark):
    one = [(1, "c", 0, "a", "a", DAY[0], DAY[1], None)]
    assert reasons(spark, [], []) == {}
    assert set(reasons(spark, one, []).values()) == {"missing"}
    report = orphans.orphan_report(orphans.relation_orphans(spark.createDataFrame(one, REL), spark.createDataFrame([], ENT)))
    assert report.agg(F.sum("orphans")).first()[0] == 2
