"""The end-to-end runs on small documents."""

from skein.operators import features, graphs
from skein.plans import pipelines

DOCS = [("c", 0, "Anna met Boris. Boris knows Carla."), ("c", 1, "Carla wrote."), ("d", 0, "Only Dora."), ("e", 0, "nothing")]


def test_pipeline(spark):
    docs = spark.createDataFrame(DOCS, "cluster_id string, document_index int, text string")
    got = {r.cluster_id: r for r in pipelines.run_pipeline(docs).collect()}
    assert set(got) == {"c", "d"}  # a graph without nodes has no scores here
    c = got["c"]
    assert (c.num_documents, c.kg_stats.nodes, c.kg_stats.edges, c.kg_stats.components) == (2, 3, 2, 1)
    assert c.scores.consistency == round(min(1, 2 * 2 / 3 / 3), 6) and c.generated_summary.startswith("Anna met Boris.")
    # "Only" and "Dora" are one edge: mean degree 1, nothing above a half, consistency a third
    assert (got["d"].kg_stats.nodes, got["d"].scores.missing_entities, got["d"].actions, got["d"].iterations) == (2, 0.5, "generic_reextraction", 3)


def test_validator(spark):
    e = spark.createDataFrame([(k, "c", 0, k, f"n{k}", f"N{k}", "PERSON", 1, 0.5) for k in range(6)], "entity_pk bigint, cluster_id string, emission int, ord int, id string, name string, type string, document_frequency int, confidence double")
    r = spark.createDataFrame([(k, "c", 0, k, f"n{k}", f"n{k + 1}", "CAUSES", 1, [0], 0.5) for k in range(5)], "relation_pk bigint, cluster_id string, emission int, ord int, source string, target string, relation_type string, support_count int, source_documents array<int>, confidence double")
    got = {x.corruption: x for x in pipelines.run_validator(graphs.nodes(e), graphs.edges(r), features.default_weights(hidden=4)).collect()}
    assert set(got) == {"clean", "missing_entities", "contradictions", "fragmentation"}
    assert all(0 < x.consistency < 1 for x in got.values()) and len({round(x.consistency, 9) for x in got.values()}) > 1
