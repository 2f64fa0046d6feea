"""Settings; every default is part of the semantics."""

from __future__ import annotations

from dataclasses import dataclass, field

MODES = ("lexical_only", "vector_only", "hybrid", "hybrid_entity")
ENTITY_TYPES = ("PERSON", "ORGANIZATION", "PROJECT", "TECHNOLOGY", "LOCATION", "EVENT", "DATE")
SOURCE_TYPES = {".txt": "txt", ".text": "txt", ".md": "markdown", ".markdown": "markdown", ".pdf": "pdf", ".json": "json"}


@dataclass(frozen=True)
class Chunking:
    max_tokens: int = 180
    min_tokens: int = 40
    overlap_sentences: int = 1


@dataclass(frozen=True)
class Weights:
    vector: float = 0.0
    lexical: float = 0.0
    entity: float = 0.0

    def __post_init__(self):
        if min(self.vector, self.lexical, self.entity) < 0 or self.total <= 0:
            raise ValueError("weights must not be negative, and one at least must be positive")

    @property
    def total(self) -> float:
        return self.vector + self.lexical + self.entity

    def normalized(self) -> Weights:
        return Weights(self.vector / self.total, self.lexical / self.total, self.entity / self.total)

    def for_mode(self, mode: str) -> Weights:
        """Without the signals that ``mode`` does not use; an error if none is left."""
        used = {"lexical_only": ("lexical",), "vector_only": ("vector",), "hybrid": ("vector", "lexical"), "hybrid_entity": ("vector", "lexical", "entity")}
        if mode not in used:
            raise ValueError(f"unknown mode {mode!r}; there are {MODES}")
        left = {name: getattr(self, name) for name in used[mode]}
        if sum(left.values()) <= 0:
            raise ValueError(f"no signal of mode {mode!r} has a weight")
        return Weights(**left)


@dataclass(frozen=True)
class Retrieval:
    candidate_pool: int = 30
    top_k: int = 5
    fusion: str = "weighted"
    normalization: str = "minmax"
    rrf_k: int = 60
    hybrid: Weights = Weights(0.5, 0.5)
    hybrid_entity: Weights = Weights(0.4, 0.4, 0.2)
    lexical_scorer: str = "bm25"
    k1: float = 1.2
    b: float = 0.75

    def weights(self, mode: str) -> Weights:
        return {"lexical_only": Weights(lexical=1.0), "vector_only": Weights(vector=1.0), "hybrid": self.hybrid}.get(mode, self.hybrid_entity).for_mode(mode)


@dataclass(frozen=True)
class EntityRetrieval:
    hop_decay: float = 0.6
    hinted_hop_decay: float = 1.0
    header_context: bool = True
    max_hops: int = 1
    min_link_confidence: float = 0.2
    max_neighbors: int = 15
    partial_name_confidence: float = 0.7
    fuzzy_link_threshold: float = 92.0


@dataclass(frozen=True)
class Confidence:
    threshold: float = 0.45
    w_relevance: float = 0.45
    w_margin: float = 0.10
    w_agreement: float = 0.20
    w_support: float = 0.10
    w_entity: float = 0.15
    vector_floor: float = 0.20
    vector_ceiling: float = 0.60
    min_vector_similarity: float = 0.25
    min_lexical_coverage: float = 0.34
    support_window: int = 5
    abstain_on_unknown_entities: bool = True


@dataclass(frozen=True)
class Resolution:
    auto_merge: float = 0.85
    candidate: float = 0.55
    bias: float = -4.0
    compact_equal: float = 6.0
    known_alias: float = 6.0
    string: float = 3.5
    surname_match: float = 3.0
    token_subset: float = 1.5
    context: float = 2.0
    doc_cooccur: float = 1.5
    unique_completion: float = 1.5
    ambiguous_completion: float = -2.5
    conflict: float = -6.0
    string_floor: float = 0.70
    context_floor: float = 0.20
    context_ceiling: float = 0.80
    max_block: int = 200


@dataclass(frozen=True)
class Generation:
    max_evidence: int = 5
    min_similarity: float = 0.2
    max_sentences: int = 3
    min_words: int = 4


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = Chunking()
    retrieval: Retrieval = Retrieval()
    entity_retrieval: EntityRetrieval = EntityRetrieval()
    confidence: Confidence = Confidence()
    resolution: Resolution = Resolution()
    generation: Generation = Generation()
    embedding_dim: int = 384
    max_upload_bytes: int = 20 << 20
    use_stems: bool = True
    extra: dict = field(default_factory=dict)
