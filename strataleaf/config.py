"""Options that change results."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class StructureConfig:
    heading_threshold: float = 0.65
    unnumbered_heading_threshold: float = 0.80
    max_heading_words: int = 20
    min_heading_word_count: int = 1
    metadata_zone_page: int = 1
    metadata_zone_fraction: float = 0.25
    fast_path_min_headings: int = 2
    page_model_available: bool = False
