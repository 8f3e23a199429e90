"""Model output to validated graphs and reports, with the reasons of what fails.

JSON is parsed strictly in an Arrow stage (what a strict parser accepts decides on repairs); values are coerced as a
lax validator does: numeric text and whole floats pass as integers, a missing key takes its default, an explicit null
does not. One bad element fails its whole graph, which goes to the rejected rows with its reason.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.text import strip_fences

_EV = "array<struct<document_index:bigint,quote:string,section:string>>"
GRAPH_SCHEMA = (
    f"struct<entities:array<struct<id:string,name:string,type:string,document_frequency:bigint,confidence:double,evidence:{_EV}>>,"
    f"relations:array<struct<source:string,target:string,relation_type:string,support_count:bigint,source_documents:array<bigint>,confidence:double,evidence:{_EV}>>,"
    "reasoning_paths:array<struct<path:array<string>,description:string,confidence:double>>>"
)
REPORT_SCHEMA = (
    "struct<overall_score:double,issues:array<struct<issue_type:string,element_id:string,description:string,severity:string>>,"
    "passes_threshold:boolean,feedback_summary:string>"
)


class Rejected(ValueError):
    """A value that the model does not allow."""


# ---- scalars ------------------------------------------------------------------------------------------------------


def _text(v: object, what: str) -> str:
    if not isinstance(v, str):
        raise Rejected(f"{what} is no text")
    return v


def _float(v: object, what: str, unit: bool = False) -> float:
    if isinstance(v, bool) or v is None or not isinstance(v, (int, float, str)):
        raise Rejected(f"{what} is no number")
    try:
        x = float(v)
    except ValueError:
        raise Rejected(f"{what} is no number") from None
    if unit and not 0 <= x <= 1:
        raise Rejected(f"{what} is outside 0 and 1")
    return x


def _int(v: object, what: str) -> int:
    x = _float(v, what)
    if x != x or x in (float("inf"), float("-inf")) or x != int(x):
        raise Rejected(f"{what} is not whole")
    return int(x)


def _bool(v: object, what: str) -> bool:
    if isinstance(v, bool):
        return v
    if v in (0, 1):
        return bool(v)
    if isinstance(v, str) and v.lower() in ("true", "false", "yes", "no", "on", "off", "1", "0", "t", "f", "y", "n"):
        return v.lower() in ("true", "yes", "on", "1", "t", "y")
    raise Rejected(f"{what} is no truth value")


def _list(v: object, what: str) -> list:
    if not isinstance(v, list):
        raise Rejected(f"{what} is no list")
    return v


def _need(d: dict, key: str, what: str) -> object:
    if key not in d:
        raise Rejected(f"{what} lacks {key}")
    return d[key]


def _object(v: object, what: str) -> dict:
    if not isinstance(v, dict):
        raise Rejected(f"{what} is no object")
    return v


def _section(v: object) -> str | None:
    return None if v is None else _text(v, "section")


def _evidence(owner: dict, what: str) -> list[dict]:
    spans = [_object(x, "evidence") for x in _list(owner.get("evidence", []), f"{what} evidence")]
    return [{"document_index": _int(x.get("document_index", 0), "document_index"), "quote": _text(x.get("quote", ""), "quote"), "section": _section(x.get("section"))} for x in spans]


# ---- records ------------------------------------------------------------------------------------------------------


def graph_record(raw: object) -> dict:
    """A validated graph of a decoded object; raises Rejected."""
    g = _object(raw, "graph")
    entities = []
    for x in map(lambda v: _object(v, "entity"), _list(g.get("entities", []), "entities")):
        entities.append({
            **{k: _text(_need(x, k, "entity"), f"entity {k}") for k in ("id", "name", "type")},
            "document_frequency": _int(x.get("document_frequency", 1), "document_frequency"), "confidence": _float(x.get("confidence", 1.0), "confidence", True),
            "evidence": _evidence(x, "entity"),
        })
    relations = []
    for x in map(lambda v: _object(v, "relation"), _list(g.get("relations", []), "relations")):
        relations.append({
            **{k: _text(_need(x, k, "relation"), f"relation {k}") for k in ("source", "target", "relation_type")},
            "support_count": _int(x.get("support_count", 1), "support_count"),
            "source_documents": [_int(d, "source document") for d in _list(x.get("source_documents", []), "source_documents")],
            "confidence": _float(x.get("confidence", 1.0), "confidence", True), "evidence": _evidence(x, "relation"),
        })
    paths = []
    for x in map(lambda v: _object(v, "reasoning path"), _list(g.get("reasoning_paths", []), "reasoning_paths")):
        steps = [_text(s, "path step") for s in _list(_need(x, "path", "reasoning path"), "path")]
        paths.append({"path": steps, "description": _text(_need(x, "description", "reasoning path"), "description"), "confidence": _float(x.get("confidence", 1.0), "confidence", True)})
    return {"entities": entities, "relations": relations, "reasoning_paths": paths}


def report_record(raw: object) -> dict:
    """A validated grader report; raises Rejected."""
    r = _object(raw, "report")
    issues = []
    for x in map(lambda v: _object(v, "issue"), _list(r.get("issues", []), "issues")):
        element = x.get("element_id")
        issues.append({
            "issue_type": _text(x.get("issue_type", "UNKNOWN"), "issue_type"), "element_id": None if element is None else _text(element, "element_id"),
            "description": _text(x.get("description", ""), "description"), "severity": _text(x.get("severity", "medium"), "severity"),
        })
    return {
        "overall_score": _float(r.get("overall_score", 0.0), "overall_score", True), "issues": issues,
        "passes_threshold": _bool(r.get("passes_threshold", False), "passes_threshold"), "feedback_summary": _text(r.get("feedback_summary", ""), "feedback_summary"),
    }


def checked_endpoints(graph: dict) -> dict:
    """``graph`` if all endpoints are declared entities; raises Rejected otherwise."""
    ids = {e["id"] for e in graph["entities"]}
    for r in graph["relations"]:
        for end in (r["source"], r["target"]):
            if end not in ids:
                raise Rejected(f"relation cites unknown entity {end}")
    return graph


def parse_text(text: str | None, record) -> tuple[dict | None, str | None, str | None]:  # noqa: ANN001
    """(record, kind of error, reason) of a text whose fences are already stripped."""
    if text is None:
        return None, "no_text", "null"
    try:
        raw = json.loads(text, parse_constant=lambda c: (_ for _ in ()).throw(Rejected(f"{c} is no JSON")))
    except Rejected as e:
        return None, "json_error", str(e)
    except (ValueError, RecursionError) as e:
        return None, "json_error", str(e)[:200]
    try:
        return record(raw), None, None
    except Rejected as e:
        return None, "schema_error", str(e)


def parse_graphs(df: DataFrame, key: str = "response_id", text: str = "knowledge_graph", strict: bool = False, fences: bool = True) -> DataFrame:
    """(key, parsed, error, reason): graphs of model answers. ``strict`` also rejects relations to undeclared entities;
    without ``fences`` a text in a code fence is no JSON."""
    record = (lambda raw: checked_endpoints(graph_record(raw))) if strict else graph_record
    return _parsed(df, key, text, GRAPH_SCHEMA, record, fences)


def parse_reports(df: DataFrame, key: str = "response_id", text: str = "report") -> DataFrame:
    """(key, parsed, error, reason): grader reports of model answers."""
    return _parsed(df, key, text, REPORT_SCHEMA, report_record)


def _parsed(df: DataFrame, key: str, text: str, schema: str, record, fences: bool = True) -> DataFrame:  # noqa: ANN001
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [parse_text(t, record) for t in part.column(1).to_pylist()]
                canon = [None if r[0] is None else json.dumps(r[0], ensure_ascii=True) for r in rows]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(canon, pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=[key, "canonical", "error", "reason"])

    kind = df.schema[key].dataType.simpleString()
    staged = df.select(key, (strip_fences(F.col(text)) if fences else F.col(text)).alias("t")).mapInArrow(run, f"{key} {kind}, canonical string, error string, reason string")
    return staged.select(key, F.from_json("canonical", schema).alias("parsed"), "error", "reason")


def rejected(parsed: DataFrame, key: str = "response_id") -> DataFrame:
    """The dead letters: (key, error, reason)."""
    return parsed.where("error is not null").select(key, "error", "reason")


def to_json(parsed: DataFrame, key: str = "response_id") -> DataFrame:
    """(key, kg_json): validated graphs as canonical JSON text, lists in their order."""
    return parsed.where("error is null").select(key, F.to_json("parsed").alias("kg_json"))
