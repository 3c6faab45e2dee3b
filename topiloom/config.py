"""Model configuration; invalid values raise ``ValueError`` at construction."""

from __future__ import annotations

from dataclasses import dataclass, field

from .functions.wordlists import GRAPH_RELATIONS

DIVERGENCES = ("kl", "frobenius")
VECTOR_BACKENDS = ("skipgram", "ppmi_svd", "none")
GRAPH_MODES = ("none", "no_syntax", "full_dep", "filtered")


@dataclass(frozen=True)
class TopicConfig:
    """Settings of one topic model.

    ``max_features`` is what bounds the vocabulary, and with it every table that
    the operators broadcast; ``None`` lifts the bound and the joins then shuffle.
    """

    num_topics: int = 10
    min_df: int = 5
    max_features: int | None = 15_000
    apply_chunking: bool = False
    max_chunk_chars: int = 800
    relations: frozenset[str] = field(default=GRAPH_RELATIONS)
    max_iter: int = 200
    tol: float = 1e-4
    divergence: str = "kl"
    seed: int = 42
    graph_top_k: int = 15
    lambda_syntax: float = 0.1
    lambda_embed: float = 0.1
    vector_backend: str = "skipgram"
    vector_dim: int = 100
    vector_epochs: int = 10
    vector_window: int = 5
    topic_stopwords: tuple[str, ...] | None = None

    def __post_init__(self) -> None:
        floors = {
            "num_topics": 2, "max_chunk_chars": 50, "min_df": 1, "graph_top_k": 1,
            "lambda_syntax": 0, "lambda_embed": 0, "max_iter": 1,
        }
        for name, floor in floors.items():
            value = getattr(self, name)
            if value < floor:
                raise ValueError(f"{name} must be >= {floor}, got {value}")
        if self.max_features is not None and self.max_features < 1:
            raise ValueError(f"max_features must be >= 1, got {self.max_features}")
        if self.divergence not in DIVERGENCES:
            raise ValueError(f"divergence must be one of {DIVERGENCES}, got {self.divergence!r}")
        if self.vector_backend not in VECTOR_BACKENDS:
            raise ValueError(
                f"vector_backend must be one of {VECTOR_BACKENDS}, got {self.vector_backend!r}")
