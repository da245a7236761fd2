"""Options of an extraction, checked when they are made."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from . import constants as K


@dataclass(frozen=True)
class ExtractOptions:
    threshold: float = 0.55
    top_k: int = 10
    dedupe: bool = True
    rerank: bool = True
    lexical_weight: float = 0.30
    rerank_margin: float = 0.04
    clinical_rerank: bool = True
    relation_rerank: bool = False
    relation_weight: float = 0.05
    relation_max_degree: int = 2000
    include_candidates: bool = False
    use_model_labels: bool = False
    extract_all: bool = True
    group_bias: Mapping[str, float] = field(default_factory=dict)
    tui_bias: Mapping[str, float] = field(default_factory=dict)
    groups: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        for name, least, most in (("threshold", 0, 1), ("top_k", 1, 50), ("lexical_weight", 0, 5), ("rerank_margin", -1, 1), ("relation_weight", 0, 5), ("relation_max_degree", 1, float("inf"))):
            if not least <= getattr(self, name) <= most:
                raise ValueError(f"{name} must be in {least}..{most}")

    @property
    def lexical(self) -> bool:
        """Whether the lexical overlap of candidates is looked at."""
        return self.top_k > 1 and (self.rerank or self.relation_rerank or self.include_candidates)

    def biases(self) -> tuple[dict[str, float], dict[str, float]]:
        """Of groups and of semantic types: under clinical_rerank the defaults, overridden by the options' own, whose keys are then
        put in order; else the options' own alone, as they stand."""
        if not self.clinical_rerank:
            return dict(self.group_bias), dict(self.tui_bias)
        return K.GROUP_BIAS | dict(self.group_bias), K.TUI_BIAS | {tui_key(k): v for k, v in self.tui_bias.items()}


def tui_key(key: str) -> str:
    """`184`, `T184` and `t7` as `T184`, `T184` and `T007`."""
    k = key.strip().upper()
    digits = k.removeprefix("T")
    return f"T{int(digits):03d}" if digits.isdigit() else k


def bias_map(spec: str | None) -> dict[str, float]:
    """`KEY=0.1,OTHER=-0.2` as a map; keys in upper case."""
    out = {}
    for part in filter(None, (p.strip() for p in (spec or "").split(","))):
        key, eq, value = part.partition("=")
        if not eq:
            raise ValueError(f"expected KEY=FLOAT, got {part!r}")
        out[key.strip().upper()] = float(value)
    return out
