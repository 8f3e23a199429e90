"""The extraction methods as one engine over many clusters at once.

Every method turns documents to prompts, runs a model on the workers, parses, and goes on with DataFrames. Loops are
driver loops over the clusters still active: a cluster that reaches the threshold leaves the loop, and one count a turn
comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import parsing
from skein.plans import prompts
from skein.plans.models import RuleModel, TextModel, run_model, with_repairs
from skein.schemas import MAX_DOCUMENTS, METHODS, ExtractionRequest
from skein.session import checkpointed
from skein.sources.clusters import clean_documents


@dataclass
class Response:
    """What a method gives: graphs (cluster_id, kg_json), reports (cluster_id, iteration, parsed), rejected rows, and one
    row a cluster with method, iterations and the last report's score (null without reports)."""

    method: str
    graphs: DataFrame
    reports: DataFrame | None
    rejected: DataFrame
    runs: DataFrame


class KGEngine:
    """documents: (cluster_id, document_index, text). id_mode: how the graphs of single documents are merged, see
    ``merge_parsed``."""

    def __init__(self, documents: DataFrame, model: TextModel | None = None, request: ExtractionRequest | None = None, id_mode: str = "resolved"):
        self.id_mode = id_mode
        self.model, self.request = model or RuleModel(), request or ExtractionRequest()
        if self.request.cluster_ids is not None:
            documents = documents.where(F.col("cluster_id").isin(list(self.request.cluster_ids)))
        self.documents = clean_documents(documents, MAX_DOCUMENTS)
        self.context = prompts.context(self.documents)

    # -- parts

    def _graphs(self, asked: DataFrame, key: str = "cluster_id") -> tuple[DataFrame, DataFrame]:
        good, bad = with_repairs(run_model(asked, self.model, key), self.model, parsing.parse_graphs, key)
        return parsing.to_json(good, key), bad

    def _grade(self, graphs: DataFrame, iteration: int) -> DataFrame:
        asked = graphs.join(self.context, "cluster_id")
        asked = asked.select("cluster_id", prompts.grader_prompt(F.col("context"), F.col("kg_json"), self.request.ontology).alias("prompt"))
        good, _ = with_repairs(run_model(asked, self.model), self.model, parsing.parse_reports)
        return good.select("cluster_id", F.lit(iteration).alias("iteration"), "parsed")

    def _refine(self, graphs: DataFrame, reports: DataFrame) -> DataFrame:
        asked = graphs.join(reports.select("cluster_id", F.col("parsed.feedback_summary").alias("feedback")), "cluster_id").join(self.context, "cluster_id")
        text = prompts.refinement_prompt(F.col("context"), F.col("kg_json"), F.col("feedback"), self.request.ontology)
        return self._graphs(asked.select("cluster_id", text.alias("prompt")))[0]

    def _loop(self, graphs: DataFrame, final_grade: bool) -> tuple[DataFrame, DataFrame | None]:
        """Grade and refine until the threshold or the last iteration. A cluster whose answer is rejected keeps its graph."""
        done, active, reports = None, graphs, None
        for i in range(self.request.max_grader_iterations):
            graded = checkpointed(self._grade(active, i))
            reports = graded if reports is None else reports.unionByName(graded)
            low = graded.where(F.col("parsed.overall_score") < self.request.grader_threshold)
            passed = active.join(low.select("cluster_id"), "cluster_id", "left_anti")
            done = passed if done is None else done.unionByName(passed)
            active = active.join(low.select("cluster_id"), "cluster_id", "left_semi")
            if active.limit(1).count() == 0:
                return done, reports
            refined = self._refine(active, low)
            active = checkpointed(refined.unionByName(active.join(refined.select("cluster_id"), "cluster_id", "left_anti")))
        if final_grade:
            graded = self._grade(active, self.request.max_grader_iterations)
            reports = graded if reports is None else reports.unionByName(graded)
        return active if done is None else done.unionByName(active), reports

    def _response(self, method: str, graphs: DataFrame, reports: DataFrame | None, rejected: DataFrame) -> Response:
        runs = graphs.select("cluster_id").join(self.context.select("cluster_id", "n_documents"), "cluster_id").withColumn("method", F.lit(method))
        if reports is None:
            runs = runs.withColumn("iterations_used", F.lit(0).cast("bigint")).withColumn("final_score", F.lit(None).cast("double"))
        else:
            last = reports.groupBy("cluster_id").agg(F.count("*").alias("iterations_used"), F.max_by(F.col("parsed.overall_score"), "iteration").alias("final_score"))
            runs = runs.join(last, "cluster_id", "left").withColumn("iterations_used", F.coalesce("iterations_used", F.lit(0)))
        return Response(method, graphs, reports, rejected, runs)

    # -- the five methods

    def ontology_extraction(self) -> Response:
        asked = self.context.select("cluster_id", prompts.ontology_prompt(F.col("context"), self.request.ontology).alias("prompt"))
        graphs, bad = self._graphs(asked)
        return self._response(METHODS[0], graphs, None, bad)

    def evidence_extraction(self) -> Response:
        asked = self.context.select("cluster_id", prompts.evidence_prompt(F.col("context"), self.request.ontology).alias("prompt"))
        graphs, bad = self._graphs(asked)
        return self._response(METHODS[1], graphs, None, bad)

    def two_agent_extraction(self) -> Response:
        """Evidence extraction, then the loop; what the loop exhausts is graded once more (also with 0 iterations)."""
        first = self.evidence_extraction()
        graphs, reports = self._loop(first.graphs, final_grade=True)
        return self._response(METHODS[2], graphs, reports, first.rejected)

    def accumulate_extraction(self) -> Response:
        """One evidence extraction a document, merged without discarding evidence."""
        graphs, bad = self._accumulate()
        return self._response(METHODS[3], graphs, None, bad)

    def full_pipeline(self) -> Response:
        """Accumulation, the loop without a final grade, and reasoning paths. ``runs.score_is_stale`` tells where the
        last score is of the graph before its last refinement."""
        graphs, bad = self._accumulate()
        graphs, reports = self._loop(graphs, final_grade=False)
        graphs = self._with_paths(graphs)
        out = self._response(METHODS[4], graphs, reports, bad)
        stale = (F.col("iterations_used") == self.request.max_grader_iterations) & (F.col("final_score") < self.request.grader_threshold)
        out.runs = out.runs.withColumn("score_is_stale", F.coalesce(stale, F.lit(False)))
        return out

    def _accumulate(self) -> tuple[DataFrame, DataFrame]:
        one = self.documents.withColumn("doc_key", F.concat_ws("\x1f", "cluster_id", F.col("document_index").cast("string")))
        part = F.concat(F.lit("[DOCUMENT "), F.col("document_index").cast("string"), F.lit("]\n"), F.col("text"))
        asked = one.select("doc_key", prompts.evidence_prompt(part, self.request.ontology).alias("prompt"))
        good, bad = with_repairs(run_model(asked, self.model, "doc_key"), self.model, parsing.parse_graphs, "doc_key")
        key = F.split("doc_key", "\x1f")
        rows = good.select(key[0].alias("cluster_id"), key[1].cast("int").alias("emission"), "parsed")
        return merge_parsed(rows, self.id_mode), bad.select(key[0].alias("cluster_id"), "error", "reason")

    def _with_paths(self, graphs: DataFrame) -> DataFrame:
        asked = graphs.select("cluster_id", prompts.paths_prompt(F.col("kg_json")).alias("prompt"))
        good, _ = with_repairs(run_model(asked, self.model), self.model, parsing.parse_graphs)
        found = good.select("cluster_id", F.col("parsed.reasoning_paths").alias("more"))
        kg = F.from_json("kg_json", parsing.GRAPH_SCHEMA)
        both = graphs.withColumn("kg", kg).join(found, "cluster_id", "left")
        paths = F.concat(F.coalesce("kg.reasoning_paths", F.array()), F.coalesce("more", F.array()))
        return both.select("cluster_id", F.to_json(F.col("kg").withField("reasoning_paths", paths)).alias("kg_json"))

    # -- service information

    @staticmethod
    def methods() -> list[str]:
        return list(METHODS)

    @staticmethod
    def health() -> dict[str, str]:
        return {"status": "ok"}


def unresolved_endpoints(rows: DataFrame) -> DataFrame:
    """(cluster_id, emission, ord, endpoint, id): endpoints of parsed relations that no entity of their extraction has."""
    ids = rows.select("cluster_id", "emission", F.explode("parsed.entities.id").alias("id")).distinct()
    rel = rows.select("cluster_id", "emission", F.posexplode("parsed.relations").alias("ord", "r"))
    ends = rel.select("cluster_id", "emission", "ord", F.explode(F.array(*[F.struct(F.lit(e).alias("endpoint"), F.col(f"r.{e}").alias("id")) for e in ("source", "target")])).alias("x"))
    return ends.select("cluster_id", "emission", "ord", "x.*").join(ids, ["cluster_id", "emission", "id"], "left_anti")


def merge_parsed(rows: DataFrame, id_mode: str = "resolved") -> DataFrame:
    """(cluster_id, kg_json) of parsed graphs (cluster_id, emission, parsed) merged in emission order: entities by
    lower-case name, relations by source, type and target, evidence by quote, paths as a bag.

    id_mode ``resolved``: entities are numbered anew and endpoints follow the entities that they resolve to, one that
    resolves to none stays as emitted (``unresolved_endpoints`` lists them); ``raw``: entities keep their first id and
    endpoints are compared as emitted, so ids of different documents may meet. Source documents are the first list as it is
    and later members once each.

    A cluster passes MAX_DOCUMENTS bounded extractions at most, so its merged graph is a bounded record."""
    if id_mode not in ("resolved", "raw"):
        raise ValueError(f"unknown id_mode: {id_mode}")
    raw = id_mode == "raw"
    ent = rows.select("cluster_id", "emission", F.posexplode("parsed.entities").alias("ord", "e"))
    ent = ent.select("cluster_id", "emission", "ord", F.lower("e.name").alias("key"), "e")
    spans = ent.select("cluster_id", "key", "emission", "ord", F.posexplode("e.evidence").alias("i", "s"))
    kept = _kept_spans(spans, ["cluster_id", "key"])
    first = F.min_by(F.struct("e.id", "e.name", "e.type"), F.struct("emission", "ord")).alias("f")
    top = ent.groupBy("cluster_id", "key").agg(F.min(F.struct("emission", "ord")).alias("at"), first, F.max("e.document_frequency").alias("df"), F.max("e.confidence").alias("conf"))
    ents = top.join(kept, ["cluster_id", "key"], "left").withColumn("id", F.col("f.id") if raw else F.concat(F.lit("entity_"), F.row_number().over(_by_cluster("at")).cast("string")))
    record = F.struct("id", F.col("f.name").alias("name"), F.col("f.type").alias("type"), F.col("df").alias("document_frequency"), F.col("conf").alias("confidence"), F.coalesce("evidence", F.array()).alias("evidence"))
    entity_lists = ents.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", record.alias("r")))), lambda x: x["r"]).alias("entities"))
    # endpoints: emitted id -> merged id
    names = ent.select("cluster_id", "emission", F.col("e.id").alias("emitted"), "key").dropDuplicates(["cluster_id", "emission", "emitted"]).join(ents.select("cluster_id", "key", "id"), ["cluster_id", "key"])
    rel = rows.select("cluster_id", "emission", F.posexplode("parsed.relations").alias("ord", "r"))
    rel = rel.select("cluster_id", "emission", "ord", "r", F.col("r.source").alias("rs"), F.col("r.target").alias("rt"))
    s = names.select("cluster_id", "emission", F.col("emitted").alias("rs"), F.col("id").alias("source"))
    t = names.select("cluster_id", "emission", F.col("emitted").alias("rt"), F.col("id").alias("target"))
    if raw:
        rel = rel.withColumns({"source": F.col("rs"), "target": F.col("rt")})
    else:
        rel = rel.join(s, ["cluster_id", "emission", "rs"], "left").join(t, ["cluster_id", "emission", "rt"], "left")
        rel = rel.withColumns({"source": F.coalesce("source", "rs"), "target": F.coalesce("target", "rt")})
    rel = rel.withColumn("relation_type", F.col("r.relation_type"))
    keys = ["cluster_id", "source", "relation_type", "target"]
    rspans = _kept_spans(rel.select(*keys, "emission", "ord", F.posexplode("r.evidence").alias("i", "s")), keys)
    lists = F.transform(F.array_sort(F.collect_list(F.struct("emission", "ord", F.col("r.source_documents").alias("d")))), lambda x: F.coalesce(x["d"], F.array().cast("array<bigint>")))
    docs = F.aggregate(F.slice(lists, 2, F.size(lists)), F.element_at(lists, 1), lambda seen, d: F.concat(seen, F.array_except(d, seen)))
    rels = rel.groupBy(*keys).agg(F.min(F.struct("emission", "ord")).alias("at"), F.max("r.support_count").alias("support_count"), F.max("r.confidence").alias("confidence"), docs.alias("source_documents"))
    rels = rels.join(rspans, keys, "left")
    record = F.struct("source", "target", "relation_type", "support_count", "source_documents", "confidence", F.coalesce("evidence", F.array()).alias("evidence"))
    relation_lists = rels.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", record.alias("r")))), lambda x: x["r"]).alias("relations"))
    paths = rows.groupBy("cluster_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("emission", F.col("parsed.reasoning_paths").alias("p")))), lambda x: x["p"])).alias("reasoning_paths"))
    whole = paths.join(entity_lists, "cluster_id", "left").join(relation_lists, "cluster_id", "left")
    graph = F.struct(F.coalesce("entities", F.array()).alias("entities"), F.coalesce("relations", F.array()).alias("relations"), "reasoning_paths")
    return checkpointed(whole.select("cluster_id", F.to_json(graph).alias("kg_json")))


def _by_cluster(order: str):  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("cluster_id").orderBy(order)


def _kept_spans(spans: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, evidence): spans (keys, emission, ord, i, s) of which no earlier emission has the quote, in order."""
    first = spans.groupBy(*keys, F.col("s.quote").alias("q")).agg(F.min(F.struct("emission", "ord")).alias("first"))
    joined = spans.withColumn("q", F.col("s.quote")).join(first, [*keys, "q"]).where(F.struct("emission", "ord") == F.col("first"))
    return joined.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("emission", "ord", "i", "s"))), lambda x: x["s"]).alias("evidence"))


def refine_loop(scores: DataFrame, threshold: float = 0.7, limit: int = 3) -> DataFrame:
    """(…, iterations): how many of at most ``limit`` refinement turns each graph takes. A turn does not change the graph
    by itself, so a graph below the threshold takes all of them."""
    return scores.withColumn("iterations", F.when(F.col("consistency") < threshold, F.lit(limit)).otherwise(F.lit(0)))
