"""All knobs of the engine in one frozen value."""

from __future__ import annotations

from dataclasses import dataclass

#: Weights and scores within this of zero count as zero.
EPSILON = 1e-6
#: "Positive" in clustering means above this.
CLUSTER_EPSILON = 2.220446049250313e-16


@dataclass(frozen=True)
class Settings:
    alpha: float = 0.85
    num_walks: int = 10_000
    seed: int = 1
    zero_opinion_factor: float = 0.2
    omit_neg_edges_scores: bool = False
    force_read_graph_conn: bool = False
    num_score_quantiles: int = 100
    vsids_bump: float = 1.03
    deletion_ratio: float = 1e-3
    rescale_threshold: float = 1e15
    #: "full": reverse scores of all owners are computed; "none": they are 0.
    reverse: str = "full"
    #: True: the bounds gt/lt include and gte/lte exclude their value, as older clients expect.
    compat_bounds: bool = False
    #: Egos whose walks stay cached; 0 keeps all.
    walks_cache_size: int = 0
    #: Largest adjacency, in bytes, that is sent to every executor; beyond it walks are joined step by step.
    broadcast_bytes: int = 256 << 20

    def __post_init__(self) -> None:
        if not 0.0 <= self.zero_opinion_factor <= 1.0:
            raise ValueError("zero_opinion_factor must lie in [0, 1]")
        if not 0.0 < self.alpha < 1.0:
            raise ValueError("alpha must lie in (0, 1)")
        if self.reverse not in ("full", "none"):
            raise ValueError('reverse must be "full" or "none"')
