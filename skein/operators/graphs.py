"""Graph algebra over rows: nodes, edges, degrees, components, scores, paths, descriptions.

A graph is named by its key columns (one extraction: cluster_id, emission; a whole cluster: cluster_id). All graphs of
a table are processed at once. Directed graphs keep one edge for each ordered pair: position of the first, attributes
of the last.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.text import clamp01
from skein.schemas import OTHER_COLOR, TYPE_COLORS
from skein.session import checkpointed, forget

EMISSION = ["cluster_id", "emission"]
_ENTITY = ["entity_pk", "cluster_id", "emission", "ord", "id", "name", "type", "document_frequency", "confidence"]
_RELATION = ["relation_pk", "cluster_id", "emission", "ord", "source", "target", "relation_type", "support_count", "source_documents", "confidence"]
_SPAN = ["span_id", "cluster_id", "owner_kind", "owner_pk", "span_ord", "document_index", "quote", "section"]


def entity_rows(entities: DataFrame) -> DataFrame:
    """Entities once each, however often delivered."""
    return entities.select(*_ENTITY).dropDuplicates(["entity_pk"])


def relation_rows(relations: DataFrame) -> DataFrame:
    return relations.select(*_RELATION).dropDuplicates(["relation_pk"])


def span_rows(spans: DataFrame) -> DataFrame:
    return spans.select(*_SPAN).dropDuplicates(["span_id"])


def nodes(entities: DataFrame, keys: list[str] = EMISSION) -> DataFrame:
    """(keys, id, first_ord, name, type, document_frequency, confidence): one row an id; rows without an id are no nodes."""
    last = F.max_by(F.struct("name", "type", "document_frequency", "confidence"), F.struct("ord", "entity_pk")).alias("a")
    return entity_rows(entities).where("id <> ''").groupBy(*keys, "id").agg(F.min("ord").alias("first_ord"), last).select(*keys, "id", "first_ord", "a.*")


def edges(relations: DataFrame, keys: list[str] = EMISSION) -> DataFrame:
    """(keys, source, target, first_ord, relation_type, support_count, confidence): one edge an ordered pair. Relations
    with a null or empty endpoint are no edges."""
    last = F.max_by(F.struct("relation_type", "support_count", "confidence"), F.struct("ord", "relation_pk")).alias("a")
    rows = relation_rows(relations).where("source <> '' and target <> ''")
    return rows.groupBy(*keys, "source", "target").agg(F.min("ord").alias("first_ord"), last).select(*keys, "source", "target", "first_ord", "a.*")


def all_nodes(node_rows: DataFrame, edge_rows: DataFrame, keys: list[str] = EMISSION) -> DataFrame:
    """(keys, id) of the declared nodes and of those that edges bring in."""
    ends = edge_rows.select(*keys, F.explode(F.array("source", "target")).alias("id"))
    return node_rows.select(*keys, "id").unionByName(ends).distinct()


def degrees(node_rows: DataFrame, edge_rows: DataFrame, keys: list[str] = EMISSION) -> DataFrame:
    """(keys, id, degree): edges in and out; a self-loop counts two, an isolated node has 0."""
    ends = edge_rows.select(*keys, F.explode(F.array("source", "target")).alias("id"), F.lit(1).alias("one"))
    both = node_rows.select(*keys, "id").distinct().withColumn("one", F.lit(0)).unionByName(ends)
    return both.groupBy(*keys, "id").agg(F.sum("one").alias("degree"))


# ---- components ---------------------------------------------------------------------------------------------------


def components(vertices: DataFrame, links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(v, component): the least vertex of each vertex's weak component, isolated vertices included.

    vertices: (v); links: (a, b), direction meaningless, self-loops and repeats allowed. Alternating large-star and
    small-star (Kiveris et al. 2014): O(log^2 n) rounds, each two aggregations and joins on vertex keys; a star's centre is
    an aggregate with map-side combination, never a collected group. Each round is kept as a table until the next is, so a
    lost executor costs no earlier round, and only two numbers a round come to the driver."""
    pairs = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("w")).distinct()
    pairs = checkpointed(pairs)
    before = None
    for _ in range(max_rounds):
        # large star: neighbours above a vertex move to its least neighbour
        both = pairs.unionByName(pairs.select(F.col("w").alias("u"), F.col("u").alias("w")))
        least = both.groupBy("u").agg(F.least(F.min("w"), F.col("u")).alias("m"))
        large = both.where("w > u").join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("w")).where("u <> w").distinct()
        # small star: a vertex and its lesser neighbours move to the least of them
        down = large.select(F.greatest("u", "w").alias("u"), F.least("u", "w").alias("w"))
        least = down.groupBy("u").agg(F.min("w").alias("m"))
        moved = down.join(least, "u").select(F.col("w").alias("u"), F.col("m").alias("w")).where("u <> w")
        last, pairs = pairs, checkpointed(moved.unionByName(least.select("u", F.col("m").alias("w"))).distinct())
        forget(last)
        now = pairs.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "w").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = pairs.select(F.col("u").alias("v"), F.col("w").alias("root"))
    return vertices.select("v").distinct().join(roots, "v", "left").select("v", F.coalesce("root", "v").alias("component"))


#: Rows of a graph up to which one task settles it; larger graphs are contracted across tasks.
TASK_ROWS = 200_000


def component_counts(node_rows: DataFrame, edge_rows: DataFrame, keys: list[str] = EMISSION, task_rows: int = TASK_ROWS) -> DataFrame:
    """(keys, components) of every graph with nodes.

    Graphs of up to ``task_rows`` nodes and edges are settled by union-find, each in one task after one shuffle; the
    others, if there are any, by star contraction. Both count the same."""
    rows = node_rows.select(*keys, F.col("id").alias("a"), F.col("id").alias("b")).unionByName(edge_rows.select(*keys, F.col("source").alias("a"), F.col("target").alias("b")))
    large = large_graphs(node_rows, edge_rows, keys, task_rows)
    if large is None:
        return _settled(rows, keys)
    same = same_graph(keys)
    node_large, edge_large = node_rows.join(large, same, "left_semi"), edge_rows.join(large, same, "left_semi")
    return _settled(rows.join(large, same, "left_anti"), keys).unionByName(_contracted(node_large, edge_large, keys))


def large_graphs(node_rows: DataFrame, edge_rows: DataFrame, keys: list[str], task_rows: int = TASK_ROWS) -> DataFrame | None:
    """(__keys) of the graphs of more than ``task_rows`` nodes and edges, or None if there are none."""
    sizes = node_rows.select(*keys).unionByName(edge_rows.select(*keys)).groupBy(*keys).agg(F.count("*").alias("n"))
    large = checkpointed(sizes.where(F.col("n") > task_rows).select(*[F.col(k).alias(f"__{k}") for k in keys]))
    return None if large.isEmpty() else large


def same_graph(keys: list[str]) -> list[Column]:
    return [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]


def _settled(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Each graph becomes one row of bounded size, and a batch of them one call."""

    @F.pandas_udf("bigint")
    def count(a: pd.Series, b: pd.Series) -> pd.Series:
        out = []
        for xs, ys in zip(a, b, strict=True):
            root: dict[str, str] = {}

            def find(x: str, root: dict[str, str] = root) -> str:
                root.setdefault(x, x)
                while root[x] != x:
                    root[x] = root[root[x]]
                    x = root[x]
                return x

            joined = 0
            for x, y in zip(xs, ys, strict=True):
                x, y = find(x), find(y)
                if x != y:
                    root[x] = y
                    joined += 1
            out.append(len(root) - joined)
        return pd.Series(out, dtype="int64")

    lists = rows.groupBy(*keys).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    return lists.select(*keys, count("a", "b").alias("components"))


def _contracted(node_rows: DataFrame, edge_rows: DataFrame, keys: list[str]) -> DataFrame:
    mark = lambda c: F.concat_ws("\x1f", *[F.col(k).cast("string") for k in keys], F.col(c))
    every = all_nodes(node_rows, edge_rows, keys).withColumn("v", mark("id"))
    found = components(every, edge_rows.select(mark("source").alias("a"), mark("target").alias("b")))
    # one vertex of each component is its own least
    return every.join(found, "v").groupBy(*keys).agg(F.sum((F.col("v") == F.col("component")).cast("int")).alias("components"))


# ---- the cluster graph --------------------------------------------------------------------------------------------


def merged_nodes(entities: DataFrame) -> DataFrame:
    """(cluster_id, id, first_ord) of a cluster's graph: entities of all its documents under their lower-case names."""
    rows = entity_rows(entities).where("trim(name) <> ''")
    return rows.groupBy("cluster_id", F.lower("name").alias("id")).agg(F.min("entity_pk").alias("first_ord"))


def merged_edges(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(cluster_id, source, target, support): relations between merged nodes, endpoints resolved within their emission;
    relations with an endpoint that resolves to no name are left out (the audit reports them)."""
    name = nodes(entities).where("trim(name) <> ''").select(*EMISSION, "id", F.lower("name").alias("key"))
    rows = relation_rows(relations).where("source <> '' and target <> ''").select(*EMISSION, "source", "target", "support_count")
    s = name.withColumnsRenamed({"id": "source", "key": "s"})
    t = name.withColumnsRenamed({"id": "target", "key": "t"})
    ends = rows.join(s, [*EMISSION, "source"]).join(t, [*EMISSION, "target"])
    return ends.groupBy("cluster_id", F.col("s").alias("source"), F.col("t").alias("target")).agg(F.max("support_count").alias("support"))


# ---- scores -------------------------------------------------------------------------------------------------------


def score_columns(n: Column, e: Column, c: Column) -> dict[str, Column]:
    """The four heuristic scores of a graph with n nodes, e edges and c components; an empty graph scores 0, 1, 0, 1."""
    degree = 2.0 * e / n
    empty = n == 0
    return {
        "consistency": F.when(empty, 0.0).otherwise(clamp01(F.least(F.lit(1.0), degree / 3.0) * (1.0 - 0.2 * (c - 1)))),
        "missing_entities": F.when(empty, 1.0).otherwise(1.0 - F.least(F.lit(1.0), degree / 2.0)),
        "contradictions": F.when(empty, 0.0).otherwise(F.lit(0.1)),
        "fragmentation": F.when(empty, 1.0).otherwise(F.least(F.lit(1.0), 0.3 * (c - 1))),
    }


def graph_sizes(node_rows: DataFrame, edge_rows: DataFrame, keys: list[str] = EMISSION) -> DataFrame:
    """(keys, nodes, edges) of every graph; nodes that only edges name are counted."""
    n = all_nodes(node_rows, edge_rows, keys).groupBy(*keys).agg(F.count("*").alias("nodes"))
    e = edge_rows.groupBy(*keys).agg(F.count("*").alias("edges"))
    return n.join(e, keys, "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


def graph_scores(node_rows: DataFrame, edge_rows: DataFrame, keys: list[str] = EMISSION) -> DataFrame:
    """(keys, nodes, edges, components, four scores rounded to six places)."""
    sizes = graph_sizes(node_rows, edge_rows, keys).join(component_counts(node_rows, edge_rows, keys), keys)
    scores = score_columns(F.col("nodes"), F.col("edges"), F.col("components"))
    return sizes.select(*keys, "nodes", "edges", "components", *[F.round(v, 6).alias(k) for k, v in scores.items()])


def refine_actions(scores: DataFrame, threshold: float = 0.7) -> DataFrame:
    """``scores`` with needs_refinement (strictly below the threshold) and the actions that refinement would take."""
    def above(c: str, action: str) -> Column:
        return F.when(F.col(c) > 0.5, F.lit(action))

    listed = F.array_compact(F.array(above("missing_entities", "expand_retrieval"), above("contradictions", "corroborate"), above("fragmentation", "rerank_documents")))
    return scores.withColumn("needs_refinement", F.col("consistency") < threshold).withColumn(
        "actions", F.when(F.size(listed) == 0, "generic_reextraction").otherwise(F.concat_ws(",", listed))
    )


# ---- paths, views -------------------------------------------------------------------------------------------------


def paths(edge_rows: DataFrame, hops: int, keys: list[str] = EMISSION) -> DataFrame:
    """(keys, path): all directed paths of exactly ``hops`` edges without a repeated node. Graphs are joined on their key
    and the meeting node, so the output is as large as the paths there are."""
    step = edge_rows.where("source <> target").select(*keys, F.col("source").alias("end"), F.col("target").alias("next"))
    out = step.select(*keys, F.array("end", "next").alias("path"), F.col("next").alias("end"))
    for _ in range(hops - 1):
        out = out.join(step, [*keys, "end"]).where(~F.array_contains("path", F.col("next")))
        out = out.select(*keys, F.concat("path", F.array("next")).alias("path"), F.col("next").alias("end"))
    return out.drop("end")


def path_validity(path_rows: DataFrame, edge_rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, pos, nodes, is_valid): a path is valid with three nodes or more, each consecutive pair joined by an edge in
    either direction. path_rows: (keys, pos, path)."""
    pairs = path_rows.where("size(path) >= 2").select(*keys, "pos", F.posexplode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("s"), F.slice("path", 2, F.size("path") - 1).alias("t"))).alias("i", "p"))
    known = edge_rows.select(*keys, F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).distinct().withColumn("hit", F.lit(1))
    pairs = pairs.select(*keys, "pos", F.least("p.s", "p.t").alias("a"), F.greatest("p.s", "p.t").alias("b")).join(known, [*keys, "a", "b"], "left")
    joined = pairs.groupBy(*keys, "pos").agg(F.bool_and(F.col("hit").isNotNull()).alias("joined"))
    sized = path_rows.select(*keys, "pos", F.greatest(F.size("path"), F.lit(0)).alias("nodes"))
    return sized.join(joined, [*keys, "pos"], "left").select(*keys, "pos", "nodes", (F.col("nodes").__ge__(3) & F.coalesce("joined", F.lit(False))).alias("is_valid"))


def viz_nodes(node_rows: DataFrame) -> DataFrame:
    """Nodes with the colour of their type and a label of 15 characters, for any plotting tool."""
    color = F.coalesce(F.create_map(*[F.lit(x) for kv in TYPE_COLORS.items() for x in kv])[F.coalesce("type", F.lit("CONCEPT"))], F.lit(OTHER_COLOR))
    return node_rows.withColumn("color", color).withColumn("label", F.substring("name", 1, 15))


def relation_lines(node_rows: DataFrame, edge_rows: DataFrame, keys: list[str] = EMISSION) -> DataFrame:
    """Edges with the names of both ends (null where an end is no declared node)."""
    names = node_rows.select(*keys, F.col("id"), F.col("name"))
    s = names.withColumnsRenamed({"id": "source", "name": "source_name"})
    t = names.withColumnsRenamed({"id": "target", "name": "target_name"})
    return edge_rows.join(s, [*keys, "source"], "left").join(t, [*keys, "target"], "left")


def descriptions(node_rows: DataFrame, edge_rows: DataFrame, keys: list[str] = EMISSION) -> DataFrame:
    """(keys, description): a graph as text, entities and relations in order of appearance. One extraction is a bounded
    group. Unknown names and types are written as ?."""
    known = lambda c: F.coalesce(c, F.lit("?"))
    line = F.format_string("  • %s (%s)", known("name"), known("type"))
    ents = node_rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first_ord", "id", line.alias("line")))).alias("e"))
    line = F.format_string("  • %s %s %s", known("source_name"), known("relation_type"), known("target_name"))
    rels = relation_lines(node_rows, edge_rows, keys).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first_ord", "source", "target", line.alias("line")))).alias("r"))
    text = F.concat(F.lit("Entities:\n"), F.array_join(F.col("e.line"), "\n"), F.lit("\n\nRelations:\n"), F.coalesce(F.array_join(F.col("r.line"), "\n"), F.lit("")))
    return ents.join(rels, keys, "left").select(*keys, text.alias("description"))


def details(node_rows: DataFrame, edge_rows: DataFrame, keys: list[str] = EMISSION) -> DataFrame:
    """(keys, kind, pos, line): the printed report of a graph, one line an entity or relation."""
    sure = F.when(F.col("confidence").isNull(), "null").otherwise(F.format_string("%.2f", "confidence"))
    ents = node_rows.select(*keys, F.lit("entity").alias("kind"), F.col("first_ord").alias("pos"), F.format_string("%s (%s) df=%d confidence=%s", F.col("name"), F.col("type"), F.col("document_frequency"), sure).alias("line"))
    rel = relation_lines(node_rows, edge_rows, keys)
    rels = rel.select(*keys, F.lit("relation").alias("kind"), F.col("first_ord").alias("pos"), F.format_string("%s -> %s type=%s support=%d confidence=%s", F.col("source_name"), F.col("target_name"), F.col("relation_type"), F.col("support_count"), sure).alias("line"))
    return ents.unionByName(rels)
