"""Engine settings."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Defaults of all knobs; ``treekin.<name>`` of a session's configuration overrides them."""

    winnow_k: int = 5
    winnow_window: int = 4
    weight_ted: float = 0.50
    weight_winnow: float = 0.35
    weight_callgraph: float = 0.15
    match_threshold: float = 0.60
    cluster_threshold: float = 0.75
    cohort_limit: int = 500
    reference_default: int = 5
    reference_max: int = 15

    def __post_init__(self):
        if self.winnow_k < 1 or self.winnow_window < 1:
            raise ValueError("winnow_k and winnow_window must be at least 1")

    @property
    def weights(self) -> tuple[float, float, float]:
        """Tree, fingerprint and call-graph weights with sum 1; thirds if all are 0."""
        w = (self.weight_ted, self.weight_winnow, self.weight_callgraph)
        total = sum(w)
        return tuple(x / total for x in w) if total > 0 else (1 / 3, 1 / 3, 1 / 3)

    @property
    def ted_share(self) -> float:
        ted, winnow, _ = self.weights
        return ted / (ted + winnow) if ted + winnow else 0.5

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        found = {}
        for f in fields(cls):
            value = spark.conf.get(f"treekin.{f.name}", None)
            if value is not None:
                found[f.name] = type(f.default)(value)
        return cls(**found)

    def key(self) -> str:
        """Names the settings in caches of results."""
        return ":".join(f"{f.name}={getattr(self, f.name)}" for f in fields(self))
