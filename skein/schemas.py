"""Fixed lists and types of the knowledge-graph model."""

from __future__ import annotations

from dataclasses import dataclass, field

# The default types of the model.
ENTITY_TYPES = ["PERSON", "ORGANIZATION", "LOCATION", "EVENT", "CONCEPT", "DISEASE", "TREATMENT", "SYMPTOM", "METRIC", "DATE"]
FEATURE_TYPES = ["PERSON", "ORGANIZATION", "LOCATION", "EVENT", "CONCEPT"]
RELATION_TYPES = [
    "CAUSES", "TREATS", "LOCATED_IN", "AFFILIATED_WITH", "ANNOUNCED", "ACQUIRED", "PARTICIPATED_IN", "RESULTED_IN", "CONTRADICTS", "SUPPORTS", "MEASURED_BY",
    "RELATED_TO",
]
ISSUE_TYPES = ["HALLUCINATION", "MISSING_ENTITY", "MISSING_RELATION", "CONTRADICTION", "WEAK_EVIDENCE", "WRONG_TYPE"]
METHODS = ["ontology_constrained", "evidence_traced", "two_agent", "evidence_accumulation", "full_pipeline"]
TYPE_COLORS = {"PERSON": "#ff6b6b", "ORGANIZATION": "#4ecdc4", "LOCATION": "#45b7d1", "EVENT": "#ffa07a", "CONCEPT": "#98d8c8"}
OTHER_COLOR = "#cccccc"
DOMAIN = "general news articles"
MAX_DOCUMENTS = 5

EVIDENCE = "array<struct<document_index:int,quote:string,section:string>>"


@dataclass(frozen=True)
class Ontology:
    entity_types: tuple[str, ...] = tuple(ENTITY_TYPES)
    relation_types: tuple[str, ...] = tuple(RELATION_TYPES)
    domain_context: str = DOMAIN


@dataclass(frozen=True)
class ExtractionRequest:
    """What an extraction is asked for. cluster_ids None: all clusters at once."""

    dataset: str = "multi_news"
    cluster_ids: tuple[str, ...] | None = None
    ontology: Ontology = field(default_factory=Ontology)
    max_grader_iterations: int = 2
    grader_threshold: float = 0.7

    def __post_init__(self) -> None:
        if not 0 <= self.max_grader_iterations <= 5:
            raise ValueError("max_grader_iterations must be within 0 and 5")
        if not 0 <= self.grader_threshold <= 1:
            raise ValueError("grader_threshold must be within 0 and 1")
