"""What each kind of vector store allows, as data."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Profile:
    """Metrics (the first is the default), largest k, reverse order, what no k means, and when views filter."""

    name: str
    metrics: tuple[str, ...]
    max_k: int | None = None
    reverse: bool = False
    k_none: str = "all"  # all, capped or error
    view_filter: str = "pre"  # pre or post
    write_batch: int = 1000

    def check(self, metric: str | None, k: int | None, reverse: bool, size: Callable[[], int]) -> tuple[str, int | None]:
        """The metric and k to use (None: all rows); raises ``ValueError`` for what the store refuses."""
        metric = metric or self.metrics[0]
        if metric not in self.metrics:
            raise ValueError(f"{self.name} supports {', '.join(self.metrics)}, not {metric}")
        if reverse and not self.reverse:
            raise ValueError(f"{self.name} can't return the least similar")
        if k is None:
            if self.k_none == "error":
                raise ValueError(f"{self.name} needs k")
            return metric, min(size(), self.max_k) if self.k_none == "capped" and self.max_k else None
        if self.max_k and k > self.max_k:
            raise ValueError(f"{self.name} returns {self.max_k} rows at most")
        return metric, k


_CDE = ("cosine", "dotproduct", "euclidean")
PROFILES = {
    p.name: p
    for p in (
        Profile("exact", ("cosine", "euclidean", "dotproduct", "innerproduct", "l1", "jaccard", "hamming"), reverse=True),
        Profile("mongodb", _CDE, 10_000, k_none="capped"),
        Profile("qdrant", _CDE),
        Profile("pinecone", _CDE, 10_000, k_none="error", write_batch=100),
        Profile("milvus", ("dotproduct", "cosine", "euclidean"), 16_384, k_none="error", write_batch=100),
        Profile("lancedb", ("cosine", "euclidean")),
        Profile("redis", _CDE),
        Profile("elasticsearch", (*_CDE, "innerproduct"), 10_000, k_none="error", write_batch=500),
        Profile("pgvector", ("cosine", "dotproduct", "euclidean", "l1", "jaccard", "hamming"), 10_000, reverse=True, write_batch=5000),
        Profile("mosaic", ("cosine",), view_filter="post", write_batch=200),
    )
}


def register(name: str, base: str = "exact", **changes) -> Profile:
    """Add a profile, or replace one, starting from another."""
    PROFILES[name] = replace(PROFILES[base], name=name, **changes)
    return PROFILES[name]
