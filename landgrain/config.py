"""Settings of the appraisal engine; precedence: defaults, then a file, then explicit values."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    seed: int = 42
    sigma_spatial_m: float = 700.0
    radii_m: tuple[int, ...] = (300, 500, 1000, 1500, 2000)
    min_comparables: int = 5
    top_k: int = 5
    band_top_k: int = 12
    spectral_dim: int = 6
    folds: int = 5
    min_cluster_size: int = 30
    max_clusters: int = 12
    evidence_buffer_m: float = 1000.0
    max_clipped_road_m: float = 3000.0
    map_inputs: int = 10
    alpha: dict[str, float] = field(default_factory=lambda: {"feature": 0.35, "access": 0.15, "location": 0.20, "spatial": 0.30})
    model_iterations: int = 350
    model_depth: int = 6
    model_rate: float = 0.05
    model_min_leaf: int = 12

    @property
    def max_radius_m(self) -> int:
        return max(self.radii_m)


def load_config(path: str | None = None, **explicit) -> Config:
    """A JSON or YAML file's values over the defaults, and explicit values over both; unknown keys are an error."""
    values: dict = {}
    if path:
        text = Path(path).read_text(encoding="utf-8")
        if path.endswith((".yaml", ".yml")):
            import yaml

            values = yaml.safe_load(text) or {}
        else:
            values = json.loads(text)
    values |= {k: v for k, v in explicit.items() if v is not None}
    known = {f.name for f in fields(Config)}
    if unknown := sorted(set(values) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    if "radii_m" in values:
        values["radii_m"] = tuple(values["radii_m"])
    return replace(Config(), **values)
