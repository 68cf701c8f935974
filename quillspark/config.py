"""Settings from a YAML file, checked when they are read."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """The settings of the pipelines, with their defaults. Paths are relative to the file they come from."""

    chunk_size: int = 800
    chunk_overlap: int = 120
    table_chunk_size: int = 800
    image_chunk_size: int = 800
    use_section_titles: bool = True
    use_table_headline: bool = False
    top_k: int = 5
    search_method: str = "hybrid"
    profile: str = "baseline"
    use_rerank: bool = False
    final_top_k: int | None = 5
    alpha: float = 0.8
    candidate_count: int = 50
    fetch_k: int = 100
    lambda_mult: float = 0.7
    max_turns: int = 3
    paths: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        from .operators.retrieval import method

        method(self.profile, self.search_method, self.use_rerank)
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must lie between 0 and chunk_size")
        if self.use_rerank and self.final_top_k is None:
            raise ValueError("use_rerank needs final_top_k")


def load(path: str) -> Settings:
    """The settings of a YAML file, whose keys may stand in sections; unknown keys raise ValueError."""
    import yaml

    at = Path(path)
    raw = yaml.safe_load(at.read_text(encoding="utf-8")) or {}
    known = {f.name for f in fields(Settings)}
    flat: dict = {}
    for k, v in raw.items():
        flat.update({k: v} if k in known else v if isinstance(v, dict) else {k: v})
    if unknown := set(flat) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    if "paths" in flat:
        flat["paths"] = {k: str((at.parent / v).resolve()) for k, v in flat["paths"].items()}
    return Settings(**flat)
