"""Durations and thresholds used by the operators, in one place."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Params:
    """Defaults are the live-service values; every ``*_s`` field is in seconds."""

    # fixed values
    window_s: float = 60.0
    tick_s: float = 2.0
    bucket_s: float = 1.0
    warmup_s: float = 25.0
    correlation_gap_s: float = 25.0
    correlation_s: float = 3.0  # how often a stream tells the correlation
    resolve_s: float = 18.0
    close_s: float = 45.0
    drop_s: float = 345.0
    retention_s: float = 240.0
    recent_problems_s: float = 120.0
    anomaly_recent_s: float = 60.0
    buckets: int = 60
    z_threshold: float = 3.0
    z_samples: int = 60
    z_min_samples: int = 8
    contamination: float = 0.06
    trees: int = 80
    forest_seed: int = 42
    forest_min_rows: int = 6
    forest_subsample: int = 256  # rows per tree, from the paper
    edge_decay: float = 0.92
    edge_floor: float = 0.3
    blast_edge_floor: float = 0.1
    blast_depth: int = 4
    root_depth: int = 5
    ewma_alpha: float = 0.35
    template_depth: int = 4
    template_similarity: float = 0.55
    template_children: int = 100

    def scaled(self, factor: float) -> "Params":
        """The same settings with every duration multiplied by ``factor``."""
        stretched = {f.name: getattr(self, f.name) * factor for f in fields(self) if f.name.endswith("_s")}
        return replace(self, **stretched)

    @property
    def ticks_per_window(self) -> int:
        span = self.window_s / self.tick_s
        if span != int(span):
            raise ValueError("window_s must be a whole number of ticks")
        return int(span)
