"""The boundary to text models: batches of prompts in, answers out.

A model is any object with ``complete(prompts) -> answers``; it is pickled to the workers. Built in are rules (a
deterministic extractor that reads the prompt's documents, grades and mends), the same misquoting at first (so that there is
something to mend), and replay (a table of recorded answers, joined by the prompt's hash).
Answers are expensive and need not repeat, so they are checkpointed before anything reads them twice.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.plans.prompts import repair_prompt
from skein.session import checkpointed

MAX_REPAIRS = 3


class TextModel(Protocol):
    def complete(self, prompts: list[str]) -> list[str]: ...


_DOC = re.compile(r"\[DOCUMENT (\d+)\]\n(.*?)(?=\n\n---\n\n\[DOCUMENT|\Z)", re.S)
_NAME = re.compile(r"[A-Z][a-z]{3,}")
_SENTENCE = re.compile(r"[^.!?\n]+[.!?]?")


class RuleModel:
    """Reads names and their neighbourhood from the prompt's documents; grades by checking quotes and endpoints."""

    def complete(self, prompts: list[str]) -> list[str]:
        return [self._answer(p) for p in prompts]

    def _answer(self, prompt: str) -> str:
        task = prompt[6:].split("\n", 1)[0] if prompt.startswith("TASK: ") else ""
        docs = [(int(i), t) for i, t in _DOC.findall(prompt.split("\n\nDOCUMENTS:\n", 1)[-1])]
        if task in ("ontology", "evidence"):
            return json.dumps(self.extract(docs))
        if task == "refine":
            feedback, rest = prompt.split("\n\nFEEDBACK:\n", 1)[1].split("\n\nGRAPH:\n", 1)
            return json.dumps(self.refine(rest.split("\n\nDOCUMENTS:\n", 1)[0], feedback, docs))
        if task == "grade":
            return json.dumps(self.grade(prompt.split("\n\nGRAPH:\n", 1)[1].split("\n\nDOCUMENTS:\n", 1)[0], docs))
        if task == "paths":
            return json.dumps(self.find_paths(json.loads(prompt.split("\n\nGRAPH:\n", 1)[1])))
        if task == "summary":
            text = prompt.split("\n\nDOCUMENTS:\n", 1)[-1]
            return " ".join(s.strip() for s in _SENTENCE.findall(text)[:3])
        if task == "repair":
            text = prompt.split("\n\nTEXT:\n", 1)[1]
            return text[text.find("{") : text.rfind("}") + 1]
        return "{}"

    @staticmethod
    def extract(docs: list[tuple[int, str]]) -> dict:
        ids: dict[str, str] = {}
        ents: dict[str, dict] = {}
        rels: dict[tuple[str, str], dict] = {}
        for i, text in docs:
            for sentence in _SENTENCE.findall(text):
                last = None
                for word in _NAME.findall(sentence):
                    key = word.lower()
                    own = ids.setdefault(key, f"entity_{len(ids) + 1}")
                    e = ents.setdefault(own, {"id": own, "name": word, "type": "CONCEPT", "document_frequency": 0, "confidence": 0.9, "evidence": []})
                    if not e["evidence"] or e["evidence"][-1]["document_index"] != i:
                        e["document_frequency"] += 1
                        e["evidence"].append({"document_index": i, "quote": sentence.strip(), "section": None})
                    if last and last != own:
                        r = rels.setdefault((last, own), {"source": last, "target": own, "relation_type": "RELATED_TO", "support_count": 0, "source_documents": [], "confidence": 0.8, "evidence": []})
                        if i not in r["source_documents"]:
                            r["source_documents"].append(i)
                            r["support_count"] += 1
                            r["evidence"].append({"document_index": i, "quote": sentence.strip(), "section": None})
                    last = own
        return {"entities": list(ents.values()), "relations": list(rels.values())}

    @staticmethod
    def grade(kg_json: str, docs: list[tuple[int, str]]) -> dict:
        kg, texts = json.loads(kg_json), dict(docs)
        issues = []
        ids = {e["id"] for e in kg.get("entities", [])}
        checked = [(e["id"], e) for e in kg.get("entities", [])] + [(f"{r['source']}->{r['target']}", r) for r in kg.get("relations", [])]
        for element, x in checked:
            spans = x.get("evidence") or []
            if not spans:
                issues.append({"issue_type": "WEAK_EVIDENCE", "element_id": element, "description": "no evidence", "severity": "low"})
            elif any(s["quote"] not in texts.get(s["document_index"], "") for s in spans):
                issues.append({"issue_type": "HALLUCINATION", "element_id": element, "description": "quote not in document", "severity": "high"})
            elif "source" in x and not {x["source"], x["target"]} <= ids:
                issues.append({"issue_type": "HALLUCINATION", "element_id": element, "description": "unknown endpoint", "severity": "high"})
        score = max(0.0, 1 - 0.1 * len(issues))
        named = "; ".join(f"{i['issue_type']} {i['element_id']}" for i in issues)
        return {"overall_score": score, "issues": issues, "passes_threshold": score >= 0.7, "feedback_summary": f"{len(issues)} issues" + (": " + named if named else "")}

    @staticmethod
    def refine(kg_json: str, feedback: str, docs: list[tuple[int, str]]) -> dict:
        """The graph with what the feedback names mended: its evidence read anew from the documents, or the element left
        out where they hold none. All else stays as it is."""
        kg, fresh = json.loads(kg_json), RuleModel.extract(docs)
        named = {part.split(" ", 1)[1] for part in feedback.split(": ", 1)[-1].split("; ") if " " in part}
        name = {e["id"]: e["name"].lower() for e in kg.get("entities", [])}
        new_name = {e["id"]: e["name"].lower() for e in fresh["entities"]}
        seen = {new_name[e["id"]]: e["evidence"] for e in fresh["entities"]}
        joined = {(new_name[r["source"]], new_name[r["target"]]): r["evidence"] for r in fresh["relations"]}
        out = {"entities": [], "relations": []}
        for e in kg.get("entities", []):
            if e["id"] not in named:
                out["entities"].append(e)
            elif spans := seen.get(e["name"].lower()):
                out["entities"].append(e | {"evidence": spans})
        kept = {e["id"] for e in out["entities"]}
        for r in kg.get("relations", []):
            if f"{r['source']}->{r['target']}" not in named:
                out["relations"].append(r)
            elif {r["source"], r["target"]} <= kept and (spans := joined.get((name[r["source"]], name[r["target"]]))):
                out["relations"].append(r | {"evidence": spans})
        return out

    @staticmethod
    def find_paths(kg: dict) -> dict:
        """All chains of three entities. There are as many as the graph has pairs of edges that meet."""
        out: dict[str, list[str]] = {}
        for r in kg.get("relations", []):
            out.setdefault(r["source"], []).append(r["target"])
        found = [[a, b, c] for a in out for b in out[a] for c in out.get(b, []) if len({a, b, c}) == 3]
        return {"reasoning_paths": [{"path": p, "description": " -> ".join(p), "confidence": 0.8} for p in found]}


class MisquotingModel(RuleModel):
    """Reads like the rules, but its first extraction quotes entities in capitals; what it mends is right."""

    def _answer(self, prompt: str) -> str:
        answer = super()._answer(prompt)
        if not prompt.startswith(("TASK: ontology\n", "TASK: evidence\n")):
            return answer
        kg = json.loads(answer)
        for e in kg["entities"]:
            e["evidence"] = [s | {"quote": s["quote"].upper()} for s in e["evidence"]]
        return json.dumps(kg)


class ReplayModel:
    """Answers from a table (prompt_hash, answer) of recorded ones: the sha-256 of a prompt finds its answer. A prompt
    without one gets a null answer, which is rejected as ``no_text``."""

    def __init__(self, recorded: DataFrame):
        self.recorded = recorded

    def complete(self, prompts: list[str]) -> list[str]:
        raise RuntimeError("recorded answers are joined, not asked for")


#: Models that can be had by name; others are passed as objects.
MODELS = {"rules": RuleModel, "misquoting": MisquotingModel}


def model_named(name: str) -> TextModel:
    if name not in MODELS:
        raise ValueError(f"unknown model: {name}")
    return MODELS[name]()


def run_model(prompts: DataFrame, model: TextModel, key: str = "cluster_id") -> DataFrame:
    """(key, answer) of prompts (key, prompt), batch by batch on the workers, checkpointed. Recorded answers are joined."""
    if isinstance(model, ReplayModel):
        return checkpointed(replay(prompts, model.recorded, key))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "answer": model.complete(pdf["prompt"].tolist())})

    kind = prompts.schema[key].dataType.simpleString()
    return checkpointed(prompts.select(key, "prompt").mapInPandas(run, f"{key} {kind}, answer string"))


def replay(prompts: DataFrame, recorded: DataFrame, key: str = "cluster_id") -> DataFrame:
    """(key, answer) from a table of recorded answers (prompt_hash, answer); null where none is recorded."""
    return prompts.select(key, F.sha2("prompt", 256).alias("prompt_hash")).join(recorded, "prompt_hash", "left").select(key, "answer")


def with_repairs(answers: DataFrame, model: TextModel, parse, key: str = "cluster_id", max_repairs: int = MAX_REPAIRS, mend: tuple[str, ...] = ("json_error",)) -> tuple[DataFrame, DataFrame]:  # noqa: ANN001
    """(parsed, rejected): answers parsed by ``parse`` (df, key, text column), those that fail by a kind of error in
    ``mend`` sent back to the model up to ``max_repairs`` times; what still fails is rejected with its reason. The strict
    one-shot mode is max_repairs=1 and mend=("json_error", "schema_error").

    Each turn handles only the rows that failed; one number a turn comes to the driver."""
    good, current = None, answers
    for turn in range(max_repairs + 1):
        parsed = checkpointed(parse(current, key, "answer"))
        ok = parsed.where("error is null")
        good = ok if good is None else good.unionByName(ok)
        bad = parsed.where("error is not null")
        broken = bad.where(F.col("error").isin(*mend))
        if turn == max_repairs or broken.limit(1).count() == 0:
            return good, bad.select(key, "error", "reason")
        prompts = current.join(broken.select(key, "reason"), key).select(key, repair_prompt(F.col("answer"), F.col("reason")).alias("prompt"))
        fixed = run_model(prompts, model, key)
        still = current.join(bad.where(~F.col("error").isin(*mend)).select(key), key, "left_semi")
        current = fixed.unionByName(still)
    raise AssertionError("unreachable")
