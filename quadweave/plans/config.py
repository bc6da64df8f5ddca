"""Settings of a bake."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class BakeConfig:
    """include wins over exclude; max_features_per_tile is off unless set; clamp limits latitudes to the square world."""

    layer: str = "default"
    min_zoom: int = 0
    max_zoom: int = 14
    compression: str = "gzip"
    tolerance: float = 1.0
    attribution: str | None = None
    include: list[str] | None = None
    exclude: list[str] = field(default_factory=list)
    max_features_per_tile: int | None = None
    clamp: bool = False

    def __post_init__(self) -> None:
        if not 0 <= self.min_zoom <= self.max_zoom <= 30:
            raise ValueError(f"zooms {self.min_zoom} to {self.max_zoom} are not within 0 to 30 in this order")
        if self.tolerance < 0:
            raise ValueError("the tolerance is negative")
