"""Parameters of the linkage pipeline.  Operators take them as arguments and read no environment."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Channel:
    """A retrieval view: which column, how it is cut into terms, and the search's bounds."""

    column: str
    analyzer: str  # word, char or char_wb
    k: int
    threshold: float
    max_df: float


@dataclass(frozen=True)
class LinkageConfig:
    channels: dict[str, Channel] = field(
        default_factory=lambda: {
            "name_sq": Channel("name_sq", "char_wb", 14, 0.32, 0.20),
            "addr": Channel("addr_c", "char_wb", 12, 0.30, 0.02),
            "name_tok": Channel("name_c", "word", 8, 0.42, 0.05),
            "addr_core": Channel("addr_core", "word", 8, 0.40, 0.02),
        }
    )
    fast: bool = False
    ngram: tuple[int, int] = (3, 4)
    min_df: int = 2
    max_nnz: int = 28
    joint_k: int = 20
    joint_threshold: float = 0.25
    exact_bucket: int = 40
    score_mode: str = "sum"
    min_score: float = 0.20
    stage1_p: float = 0.002
    stage1_m: int = 30
    stage2_p: float = 0.01
    stage2_m: int = 12
    links_top: int = 3
    folds: int = 10
    rounds: int = 40
    prune_rounds: int = 20
    depth: int = 5
    miss_priors: tuple[float, ...] = (0.0, 0.1, 0.2, 0.35, 0.5)
    penalties: tuple[float, ...] = (0.0, 0.002, 0.005)
    self_p: float = 0.99
    self_min_pairs: int = 20_000

    def views(self) -> dict[str, Channel]:
        """The channels searched; the fast mode keeps the two that are also rescored."""
        return {k: v for k, v in self.channels.items() if not self.fast or k in ("name_sq", "addr")}

    def nnz(self) -> int:
        return 16 if self.fast else self.max_nnz
