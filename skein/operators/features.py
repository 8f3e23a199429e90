"""Node features, dense edge indices and the forward pass of a two-layer graph convolution network.

A layer is neighbours' features summed over edges with the weights 1/sqrt(d(u) d(v)), then a dense product. A graph that one
task can hold passes the network there; larger ones pass it as relational algebra. Trained weights are passed in.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.graphs import EMISSION, TASK_ROWS, all_nodes, degrees, large_graphs, same_graph
from skein.schemas import FEATURE_TYPES
from skein.session import checkpointed

FEATURES = [*[f"is_{t.lower()}" for t in FEATURE_TYPES], "df_norm", "confidence", "degree_norm"]
HEADS = ["consistency", "missing_entities", "contradictions", "fragmentation"]


def node_features(node_rows: DataFrame, edge_rows: DataFrame, keys: list[str] = EMISSION) -> DataFrame:
    """(keys, id, eight features): one-hot type, frequency and degree over their maxima in the graph, confidence.

    Nodes that only edges name count as CONCEPT, frequency 1, confidence 1; a type outside the five sets no flag; a graph
    without edges has degree 0 throughout."""
    rows = all_nodes(node_rows, edge_rows, keys).join(node_rows.select(*keys, "id", "type", "document_frequency", "confidence", F.lit(True).alias("declared")), [*keys, "id"], "left")
    rows = rows.join(degrees(node_rows, edge_rows, keys), [*keys, "id"])
    w = Window.partitionBy(*keys)
    kind = F.when(F.col("declared").isNull(), "CONCEPT").otherwise(F.col("type"))
    df = F.coalesce("document_frequency", F.lit(1))
    flags = [F.coalesce((kind == t).cast("double"), F.lit(0.0)).alias(f) for t, f in zip(FEATURE_TYPES, FEATURES, strict=False)]
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return rows.select(*keys, "id", *flags, ratio(df, F.max(df).over(w)).alias("df_norm"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), ratio(F.col("degree"), F.max("degree").over(w)).alias("degree_norm"))


def edge_index(node_rows: DataFrame, edge_rows: DataFrame, keys: list[str] = EMISSION) -> DataFrame:
    """(keys, source_index, target_index): edges between dense 0-based node numbers in order of appearance."""
    order = all_nodes(node_rows, edge_rows, keys).join(node_rows.select(*keys, "id", "first_ord"), [*keys, "id"], "left")
    n = (F.row_number().over(Window.partitionBy(*keys).orderBy(F.asc_nulls_last("first_ord"), "id")) - 1).alias("n")
    num = order.select(*keys, "id", n)
    s, t = num.withColumnsRenamed({"id": "source", "n": "source_index"}), num.withColumnsRenamed({"id": "target", "n": "target_index"})
    return edge_rows.join(s, [*keys, "source"]).join(t, [*keys, "target"]).select(*keys, "source_index", "target_index")


def propagate(features: DataFrame, edge_rows: DataFrame, cols: list[str], keys: list[str] = EMISSION) -> DataFrame:
    """One step of messages source -> target with self-loops, normalised by in-degree plus one."""
    edge = edge_rows.select(*keys, "source", "target").distinct()
    indeg = edge.groupBy(*keys, F.col("target").alias("id")).agg(F.count("*").alias("d"))
    x = features.select(*keys, "id", *cols).join(indeg, [*keys, "id"], "left").withColumn("d", F.coalesce("d", F.lit(0)) + 1)
    own = x.select(*keys, "id", *[(F.col(c) / F.col("d")).alias(c) for c in cols])
    src = x.select(*keys, F.col("id").alias("source"), F.col("d").alias("ds"), *cols)
    dst = x.select(*keys, F.col("id").alias("target"), F.col("d").alias("dt"))
    sent = edge.join(src, [*keys, "source"]).join(dst, [*keys, "target"])
    sent = sent.select(*keys, F.col("target").alias("id"), *[(F.col(c) / F.sqrt(F.col("ds") * F.col("dt"))).alias(c) for c in cols])
    return own.unionByName(sent).groupBy(*keys, "id").agg(*[F.sum(c).alias(c) for c in cols])


def dense(cols: list[str], weight: np.ndarray, bias: np.ndarray, relu: bool = True) -> Column:
    """relu(x W + b) of the columns as array<double>, one matrix product a batch."""

    @F.pandas_udf("array<double>")
    def product(*x: pd.Series) -> pd.Series:
        out = np.column_stack([c.to_numpy("float64") for c in x]) @ weight + bias
        return pd.Series(list(np.maximum(out, 0) if relu else out))

    return product(*cols)


def default_weights(hidden: int = 64, seed: int = 42) -> dict[str, np.ndarray]:
    """Untrained weights from a seed, in the shapes that ``forward`` takes."""
    rng = np.random.default_rng(seed)
    shapes = {"w1": (len(FEATURES), hidden), "b1": (hidden,), "w2": (hidden, hidden), "b2": (hidden,), "w3": (hidden, len(HEADS)), "b3": (len(HEADS),)}
    return {k: rng.normal(0, 0.2, s) for k, s in shapes.items()}


def forward(features: DataFrame, edge_rows: DataFrame, weights: dict[str, np.ndarray], keys: list[str] = EMISSION, task_rows: int = TASK_ROWS) -> DataFrame:
    """(keys, four scores in (0, 1)) of every graph: two convolutions with ReLU, mean pooling, four sigmoid heads.

    Graphs of up to ``task_rows`` nodes and edges pass in one task each, after one shuffle; the others, if there are any,
    layer by layer as joins. Both give the same."""
    large = large_graphs(features, edge_rows, keys, task_rows)
    if large is None:
        return _forward_in_task(features, edge_rows, weights, keys)
    same = same_graph(keys)
    small = _forward_in_task(features.join(large, same, "left_anti"), edge_rows.join(large, same, "left_anti"), weights, keys)
    return small.unionByName(_forward_by_joins(features.join(large, same, "left_semi"), edge_rows.join(large, same, "left_semi"), weights, keys))


def _forward_in_task(features: DataFrame, edge_rows: DataFrame, weights: dict[str, np.ndarray], keys: list[str]) -> DataFrame:
    """Each graph becomes one row of bounded size, and a batch of them one call."""

    @F.pandas_udf(", ".join(f"{h} double" for h in HEADS))
    def scores(ids: pd.Series, x: pd.Series, source: pd.Series, target: pd.Series) -> pd.DataFrame:
        out = []
        for names, rows, ss, ts in zip(ids, x, source, target, strict=True):
            at = {n: i for i, n in enumerate(names)}
            edges = {(at.get(s), at.get(t)) for s, t in zip(ss, ts, strict=True)} if ss is not None else set()
            d = 1.0 + np.bincount([t for _, t in edges if t is not None], minlength=len(names))
            pairs = np.array([e for e in edges if None not in e], dtype="int64").reshape(-1, 2)
            src, dst = pairs[:, 0], pairs[:, 1]
            norm = (1 / np.sqrt(d[src] * d[dst]))[:, None]
            h = np.stack(rows).astype("float64")
            for w, b in (("w1", "b1"), ("w2", "b2")):
                mixed = h / d[:, None]
                np.add.at(mixed, dst, h[src] * norm)
                h = np.maximum(mixed @ weights[w] + weights[b], 0)
            out.append(1 / (1 + np.exp(-(h.mean(axis=0) @ weights["w3"] + weights["b3"]))))
        return pd.DataFrame(np.array(out).reshape(-1, len(HEADS)), columns=HEADS)

    nodes = features.groupBy(*keys).agg(F.collect_list(F.struct("id", F.array(*FEATURES).alias("x"))).alias("n"))
    links = edge_rows.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(F.collect_list(F.struct("source", "target")).alias("e"))
    both = nodes.join(links, same_graph(keys), "left")
    return both.select(*keys, scores("n.id", "n.x", "e.source", "e.target").alias("s")).select(*keys, "s.*")


def _forward_by_joins(features: DataFrame, edge_rows: DataFrame, weights: dict[str, np.ndarray], keys: list[str]) -> DataFrame:
    hidden = [f"h{i}" for i in range(weights["w1"].shape[1])]

    def layer(df: DataFrame, cols: list[str], w: str, b: str) -> DataFrame:
        out = propagate(df, edge_rows, cols, keys).withColumn("h", dense(cols, weights[w], weights[b]))
        return out.select(*keys, "id", *[F.col("h")[i].alias(c) for i, c in enumerate(hidden)])

    # each layer reads its input and the edges several times, so the lineage is cut between layers
    features, edge_rows = checkpointed(features), checkpointed(edge_rows)
    h = layer(checkpointed(layer(features, FEATURES, "w1", "b1")), hidden, "w2", "b2")
    pooled = h.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in hidden])
    z = pooled.withColumn("z", dense(hidden, weights["w3"], weights["b3"], relu=False))
    return z.select(*keys, *[(1 / (1 + F.exp(-F.col("z")[i]))).alias(c) for i, c in enumerate(HEADS)])
