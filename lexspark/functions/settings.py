"""Settings with their bounds."""

from __future__ import annotations

from dataclasses import dataclass

from lexspark.operators.evaluation import config_hash


@dataclass(frozen=True)
class Settings:
    embedding_model: str = "hashing"
    embedding_revision: str = ""
    retrieval_top_k: int = 10
    bm25_candidates: int = 25
    vector_candidates: int = 25
    vector_probes: int = 0
    lexical_ranking: str = "bm25"
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    fusion: str = "weighted"
    hybrid_alpha: float = 0.8
    model_cheap: str = ""
    model_strong: str = ""
    eval_max_cost_usd: float = 5.0

    def __post_init__(self):
        if self.bm25_k1 < 0 or not 0 <= self.bm25_b <= 1 or not 0 <= self.hybrid_alpha <= 1:
            raise ValueError("k1 must not be negative, b and alpha must be from 0 to 1")
        if self.lexical_ranking not in ("bm25", "tf") or self.fusion not in ("weighted", "rrf"):
            raise ValueError("unknown ranking or fusion")

    def retrieval_config_hash(self) -> str:
        """Digest of what can move a retrieval metric; the cost limit is not in it."""
        known = {k: v for k, v in vars(self).items() if k != "eval_max_cost_usd"}
        if not self.vector_probes:  # the exact leg, which all runs had before there were cells
            del known["vector_probes"]
        return config_hash(known)
