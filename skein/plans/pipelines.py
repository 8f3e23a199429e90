"""The end-to-end runs: documents to scored, refined and summarised graphs, and a validator's clean-against-corrupted run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import corruption, features, graphs, parsing
from skein.plans import prompts
from skein.plans.engine import KGEngine, refine_loop
from skein.plans.models import TextModel, run_model
from skein.session import checkpointed

CLUSTER = ["cluster_id"]


def graph_tables(kg_json: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges (cluster_id, …) of validated graphs (cluster_id, kg_json): one node an id, one edge an ordered pair,
    attributes of the last."""
    kg = kg_json.select("cluster_id", F.from_json("kg_json", parsing.GRAPH_SCHEMA).alias("kg"))
    e = kg.select("cluster_id", F.posexplode("kg.entities").alias("ord", "e")).select("cluster_id", "ord", "e.*")
    last = F.max_by(F.struct("name", "type", "document_frequency", "confidence"), "ord").alias("a")
    nodes = e.groupBy("cluster_id", "id").agg(F.min("ord").alias("first_ord"), last).select("cluster_id", "id", "first_ord", "a.*")
    r = kg.select("cluster_id", F.posexplode("kg.relations").alias("ord", "r")).select("cluster_id", "ord", "r.*")
    last = F.max_by(F.struct("relation_type", "support_count", "confidence"), "ord").alias("a")
    edges = r.groupBy("cluster_id", "source", "target").agg(F.min("ord").alias("first_ord"), last).select("cluster_id", "source", "target", "first_ord", "a.*")
    return nodes, edges


def run_pipeline(documents: DataFrame, model: TextModel | None = None, threshold: float = 0.7) -> DataFrame:
    """(cluster_id, num_documents, kg_stats, scores, actions, iterations, generated_summary) of every cluster whose answer
    holds a valid graph with nodes: extraction, scoring, the refinement decision, and a summary of graph and documents."""
    engine = KGEngine(documents, model)
    out = engine.ontology_extraction()
    nodes, edges = graph_tables(out.graphs)
    nodes, edges = checkpointed(nodes), checkpointed(edges)
    scored = refine_loop(graphs.refine_actions(graphs.graph_scores(nodes, edges, CLUSTER), threshold), threshold)
    text = graphs.descriptions(nodes, edges, CLUSTER).join(prompts.summary_context(engine.documents), "cluster_id")
    asked = text.select("cluster_id", prompts.summary_prompt(F.col("description"), F.col("context")).alias("prompt"))
    summary = run_model(asked, engine.model).select("cluster_id", F.trim("answer").alias("generated_summary"))
    stats = F.struct("nodes", "edges", "components").alias("kg_stats")
    scores = F.struct("consistency", "missing_entities", "contradictions", "fragmentation").alias("scores")
    rows = scored.join(engine.context.select("cluster_id", F.col("n_documents").alias("num_documents")), "cluster_id").join(summary, "cluster_id", "left")
    return rows.select("cluster_id", "num_documents", stats, scores, "actions", "iterations", "generated_summary")


def run_validator(nodes: DataFrame, edges: DataFrame, weights: dict | None = None, keys: list[str] = graphs.EMISSION) -> DataFrame:
    """(corruption, keys, four scores): the network's scores of every graph, clean and under each corruption."""
    weights = weights or features.default_weights()
    nodes, edges = checkpointed(nodes), checkpointed(edges)
    dropped = checkpointed(corruption.drop_nodes(nodes, edges, keys=keys))
    variants = {
        "clean": (nodes, edges),
        "missing_entities": (nodes.join(dropped, [*keys, "id"], "left_anti"), corruption.without_nodes(edges, dropped, keys)),
        "contradictions": (nodes, corruption.flip_edges(edges, keys=keys)),
        "fragmentation": (nodes, corruption.fragment(edges, keys=keys)),
    }
    kept = [nodes.columns, [*keys, "source", "target"]]
    tagged = [reduce(DataFrame.unionByName, [v[i].select(F.lit(name).alias("corruption"), *kept[i]) for name, v in variants.items()]) for i in (0, 1)]
    n, e = map(checkpointed, tagged)
    graph = ["corruption", *keys]
    return features.forward(features.node_features(n, e, graph), e, weights, graph).select(*graph, *features.HEADS)
