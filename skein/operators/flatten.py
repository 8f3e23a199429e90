"""Deeply nested records to related flat tables, by Arrow kernels.

The nested column's list offsets give every child its parent: ``list_parent_indices`` names the parent row of each
element, ``list_flatten`` lays the elements out, and the keys of the parents are propagated by one vectorised take.
JSON text is decoded inside the JVM to a variant and cast to the declared nested type, whatever its shape (one object in
place of a list, a list kept as JSON text, code fences); the nested columns go to Arrow as they are, so no child row is
visited in Python. Only texts that the JVM's parser refuses (repeated keys, prose with braces, broken text) are decoded in
Python, one document at a time.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_EVIDENCE = pa.list_(pa.struct([("document_index", pa.int64()), ("quote", pa.string()), ("section", pa.string())]))
GRAPH_TYPE = pa.struct([
    ("entities", pa.list_(pa.struct([("id", pa.string()), ("name", pa.string()), ("type", pa.string()), ("document_frequency", pa.int64()), ("confidence", pa.float64()), ("evidence", _EVIDENCE)]))),
    ("relations", pa.list_(pa.struct([("source", pa.string()), ("target", pa.string()), ("relation_type", pa.string()), ("support_count", pa.int64()), ("source_documents", pa.list_(pa.int64())), ("confidence", pa.float64()), ("evidence", _EVIDENCE)]))),
    ("reasoning_paths", pa.list_(pa.struct([("path", pa.list_(pa.string())), ("description", pa.string()), ("confidence", pa.float64())]))),
])

#: Child tables: kind -> (list column, nested list inside each element or None, Spark columns of the child).
GRAPH_TABLES = {
    "entity": ("entities", None, "id string, name string, type string, document_frequency bigint, confidence double"),
    "relation": ("relations", None, "source string, target string, relation_type string, support_count bigint, source_documents array<bigint>, confidence double"),
    "reasoning_path": ("reasoning_paths", None, "path array<string>, description string, confidence double"),
    "entity_evidence": ("entities", "evidence", "document_index bigint, quote string, section string"),
    "relation_evidence": ("relations", "evidence", "document_index bigint, quote string, section string"),
}
REPORT_TABLES = {
    "grader_report": ("grader_reports", None, "overall_score double, passes_threshold boolean, feedback_summary string"),
    "grader_issue": ("grader_reports", "issues", "issue_type string, element_id string, description string, severity string"),
}
_KEYS = "response_id bigint, parent_pos int, pos int"


# ---- JSON text to Arrow -------------------------------------------------------------------------------------------

_decoder = json.JSONDecoder()


def decode_object(text: str | None) -> dict | None:
    """The first complete JSON object of a text, whatever stands around it; None if there is none.

    A brace that opens no object is passed over up to where reading failed, so of a text cut off inside its object
    nothing counts."""
    at = (text or "").find("{")
    while at >= 0:
        try:
            return _decoder.raw_decode(text, at)[0]
        except json.JSONDecodeError as e:
            at = text.find("{", max(at + 1, e.pos))
        except (ValueError, RecursionError):
            return None
    return None


def _as_list(value: object) -> list | None:
    if isinstance(value, str) and value.strip()[:1] in ("[", "{"):
        try:
            value = json.loads(value)
        except (ValueError, RecursionError):
            return None
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else None


def _number(value: object, whole: bool) -> int | float | None:
    """A number given as number or text; null for what is no number, or not whole where a whole one is wanted."""
    if isinstance(value, bool) or value is None:
        return None
    try:
        n = float(value)  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return None
    if not whole:
        return n
    return int(n) if n == n and abs(n) < 2**63 and n == int(n) else None


def _fit(value: object, kind: pa.DataType) -> object:
    """``value`` in the shape of the Arrow type; null where it has another."""
    if pa.types.is_struct(kind):
        return {f.name: _fit(value.get(f.name), f.type) for f in kind} if isinstance(value, dict) else None
    if pa.types.is_list(kind):
        if pa.types.is_struct(kind.value_type):
            items = _as_list(value)
            return None if items is None else [_fit(x, kind.value_type) for x in items]
        return [_fit(x, kind.value_type) for x in value] if isinstance(value, list) else None
    if pa.types.is_string(kind):
        if isinstance(value, float) and value.is_integer() and abs(value) < 1e15:
            value = int(value)  # written without its zeros, as the JVM does
        return value if isinstance(value, str) or value is None else json.dumps(value)
    return _number(value, pa.types.is_integer(kind))



_surrogate = re.compile("[\ud800-\udfff]")


def graphs_to_arrow(texts: list[str | None]) -> pa.StructArray:
    """Graph texts as nested Arrow; a null struct for a text without a complete object."""
    rows = []
    for text in texts:
        value = decode_object(text)
        if value is not None and "\\ud" in text.lower():  # lone surrogates have no UTF-8 form
            value = json.loads(_surrogate.sub("�", json.dumps(value, ensure_ascii=False)))
        rows.append(None if value is None else _fit(value, GRAPH_TYPE))
    return pa.array(rows, type=GRAPH_TYPE)


# ---- JSON text to nested columns ----------------------------------------------------------------------------------

#: How an element of each list is read from a variant: texts, and what is fitted afterwards.
_ELEMENTS = {
    "entities": "struct<id:string,name:string,type:string,document_frequency:string,confidence:string,evidence:variant>",
    "relations": "struct<source:string,target:string,relation_type:string,support_count:string,source_documents:variant,confidence:string,evidence:variant>",
    "reasoning_paths": "struct<path:variant,description:string,confidence:string>",
    "evidence": "struct<document_index:string,quote:string,section:string>",
}


def _listed(value: Column, element: str) -> Column:
    """A variant as array<element>: a list, one object, or either kept as JSON text; null for anything else. Members that
    are no objects are null."""

    def lists(v: Column) -> list[Column]:
        one = F.try_variant_get(v, "$", element)
        return [F.try_variant_get(v, "$", f"array<{element}>"), F.when(one.isNotNull(), F.array(one))]

    text = F.try_variant_get(value, "$", "string")
    inner = F.try_parse_json(F.when(text.rlike(r"^\s*[\[{]"), text))
    return F.coalesce(*lists(value), *lists(inner))


def _fitted(column: str, links: bool) -> Callable[[Column], Column]:
    """An element in its declared shape; with ``links`` only what the links need."""
    return lambda e: F.when(e.isNotNull(), F.struct(*_fields(column, e, links)))


def _fields(column: str, e: Column, links: bool) -> list[Column]:
    whole = lambda x: F.when(F.abs(x.try_cast("double")) < 2.0**63, F.when(x.try_cast("double") == F.floor(x.try_cast("double")), x.try_cast("double").cast("bigint")))
    span = (lambda x: F.struct(F.lit(True).alias("span"))) if links else (lambda x: F.struct(whole(x["document_index"]).alias("document_index"), x["quote"].alias("quote"), x["section"].alias("section")))
    spans = lambda: F.transform(_listed(e["evidence"], _ELEMENTS["evidence"]), lambda x: F.when(x.isNotNull(), span(x))).alias("evidence")
    number = lambda c: e[c].try_cast("double").alias(c)
    if links:
        return [F.lit(True).alias("is"), *([spans()] if column != "reasoning_paths" else [])]
    if column == "entities":
        return [e["id"].alias("id"), e["name"].alias("name"), e["type"].alias("type"), whole(e["document_frequency"]).alias("document_frequency"), number("confidence"), spans()]
    if column == "relations":
        documents = F.transform(F.try_variant_get(e["source_documents"], "$", "array<string>"), whole).alias("source_documents")
        return [*[e[c].alias(c) for c in ("source", "target", "relation_type")], whole(e["support_count"]).alias("support_count"), documents, number("confidence"), spans()]
    return [F.try_variant_get(e["path"], "$", "array<string>").alias("path"), e["description"].alias("description"), number("confidence")]


def graph_columns(accumulated: DataFrame, columns: list[str], links: bool) -> DataFrame:
    """(response_id, nested, rest): the lists of each graph text as nested columns, and the text where the JVM's parser
    finds no object though a brace is there."""
    text = F.col("knowledge_graph")
    rows = accumulated.where(F.contains(text, F.lit("{"))).select("response_id", text, F.try_parse_json(F.expr("substring(knowledge_graph, instr(knowledge_graph, '{'))")).alias("v"))
    lists = [F.transform(_listed(F.try_variant_get("v", f"$.{c}", "variant"), _ELEMENTS[c]), _fitted(c, links)).alias(c) for c in columns]
    return rows.select("response_id", F.when(F.col("v").isNotNull(), F.struct(*lists)).alias("nested"), F.when(F.col("v").isNull(), text).alias("rest"))


# ---- flattening ---------------------------------------------------------------------------------------------------


def _field(struct: pa.StructArray, name: str) -> pa.Array:
    return pc.struct_field(struct, name)


def explode_list(lists: pa.ListArray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(parent row, position in the list, element) of every element that is not null, from the offsets alone."""
    flat, parents = pc.list_flatten(lists), pc.cast(pc.list_parent_indices(lists), pa.int64())
    lengths = pc.fill_null(pc.list_value_length(lists), 0)
    starts = pc.subtract(pc.cumulative_sum(pc.cast(lengths, pa.int64())), pc.cast(lengths, pa.int64()))
    pos = pc.subtract(pa.array(np.arange(len(flat))), pc.take(starts, parents))
    keep = pc.is_valid(flat)
    return pc.filter(parents, keep), pc.filter(pos, keep), flat.filter(keep)


def flatten(keys: pa.Array, lists: pa.ListArray, inner: str | None) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """(key, parent_pos, pos, element) of the children in ``lists``, or of the lists ``inner`` inside them."""
    parent, pos, items = explode_list(lists)
    key = pc.take(keys, parent)
    if inner is None:
        return key, pa.repeat(pa.scalar(-1, pa.int64()), len(pos)), pos, items
    up, inner_pos, inner_items = explode_list(_field(items, inner))
    return pc.take(key, up), pc.take(pos, up), inner_pos, inner_items


#: Documents decoded in Python at a time: bounds the objects that are alive besides the Arrow batch.
DECODE_ROWS = 200


def _nested(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.StructArray | pa.ListArray]]:
    """(keys, nested column) of a batch, and of the texts in it that are left to decode."""
    yield batch.column(0), batch.column(1)
    if batch.num_columns > 2:
        rest = batch.filter(pc.is_valid(batch.column(2)))
        for at in range(0, rest.num_rows, DECODE_ROWS):
            part = rest.slice(at, DECODE_ROWS)
            yield part.column(0), graphs_to_arrow(part.column(2).to_pylist())


def _children(batches: Iterator[pa.RecordBatch], tables: dict, kind: str | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, column in _nested(batch):
            for name, (outer, inner, spec) in tables.items():
                if kind not in (None, name):
                    continue
                key, parent_pos, pos, items = flatten(keys, _field(column, outer) if pa.types.is_struct(column.type) else column, inner)
                links = [key, pc.cast(parent_pos, pa.int32()), pc.cast(pos, pa.int32())]
                names = ["response_id", "parent_pos", "pos"]
                if kind is None:
                    yield pa.RecordBatch.from_arrays([key, pa.repeat(name, len(key)), *links[1:]], names=["response_id", "kind", "parent_pos", "pos"])
                else:
                    fields = [part.strip().split(" ")[0] for part in spec.split(", ")]
                    yield pa.RecordBatch.from_arrays([*links, *[_field(items, f) for f in fields]], names=[*names, *fields])


def _source(accumulated: DataFrame, tables: dict, kind: str | None) -> DataFrame:
    """Key and nested column, of graphs with what is left to decode. Only the lists that are asked for are read."""
    if tables is REPORT_TABLES:
        return accumulated.where("grader_reports is not null").select("response_id", "grader_reports")
    columns = sorted({outer for name, (outer, _, _) in tables.items() if kind in (None, name)})
    return graph_columns(accumulated, columns, kind is None)


def child_table(accumulated: DataFrame, kind: str) -> DataFrame:
    """The flat table of one kind of child with its links (response_id, parent_pos, pos) and its own fields.

    parent_pos is -1 for direct children of the response. A response delivered twice counts once: its copies are
    equal but for the arrival, so one row for each link is kept. Null elements keep their position but give no row;
    null, missing and empty lists give none; a null response_id is a key like any other."""
    tables = GRAPH_TABLES if kind in GRAPH_TABLES else REPORT_TABLES
    out = _source(accumulated, tables, kind).mapInArrow(lambda it: _children(it, tables, kind), f"{_KEYS}, {tables[kind][2]}")
    return out.dropDuplicates(["response_id", "parent_pos", "pos"])


def child_links(accumulated: DataFrame) -> DataFrame:
    """(response_id, kind, parent_pos, pos) of all children of all kinds: one pass over each nested column."""
    links = "response_id bigint, kind string, parent_pos int, pos int"
    parts = [_source(accumulated, tables, None).mapInArrow(lambda it, tables=tables: _children(it, tables, None), links) for tables in (GRAPH_TABLES, REPORT_TABLES)]
    return parts[0].unionByName(parts[1]).distinct()


def parent_table(accumulated: DataFrame) -> DataFrame:
    """One row for each response: its scalar fields, at its first arrival."""
    cols = ["method", "cluster_index", "num_documents", "iterations_used", "final_score"]
    first = F.min_by(F.struct(*cols), F.coalesce("arrived_at", F.lit("9999-12-31").cast("timestamp"))).alias("x")
    return accumulated.groupBy("response_id").agg(first).select("response_id", "x.*")
