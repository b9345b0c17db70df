"""Run settings, checked when they are built. Defaults are the published study's (fixed values)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Config:
    run_date: str = "2026-10-09"
    #: engine name -> suffix of its columns and prefix of its answers' ids
    engines: dict[str, str] = field(default_factory=lambda: {"ChatGPT": "gpt", "Gemini": "gem"})
    authority_values: dict[str, float] = field(default_factory=lambda: {"High": 1.0, "Medium": 0.7, "Low": 0.4})
    low_n_answers: int = 3
    readable_min_words: int = 50
    pdf_max_pages: int = 300
    recency_bins: tuple[int, int, int] = (30, 180, 365)
    vis_weights: dict[str, float] = field(default_factory=lambda: {"pawc": 1, "authority": 1, "sentiment": 1, "diversity": 1})
    expected_counts: dict[str, int] = field(default_factory=dict)
    near_crawl_days: int = 3

    def __post_init__(self):
        b = self.recency_bins
        if len(b) != 3 or not 0 <= b[0] < b[1] < b[2]:
            raise ValueError(f"recency_bins must rise: {b}")
        if set(self.vis_weights) != {"pawc", "authority", "sentiment", "diversity"} or sum(self.vis_weights.values()) <= 0:
            raise ValueError(f"vis_weights: {self.vis_weights}")
        if len(set(self.engines.values())) != len(self.engines):
            raise ValueError(f"engines share a suffix: {self.engines}")

    @classmethod
    def of(cls, settings: dict) -> Config:
        """From a plain mapping, as a YAML file gives it; unknown keys are an error."""
        unknown = set(settings) - set(cls.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(cls(), **{k: tuple(v) if k == "recency_bins" else v for k, v in settings.items()})
