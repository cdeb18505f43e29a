"""Parameters of the operators. Invalid values fail before planning."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# The experimental default configuration and sequence limits.
STATIONARY_TOLERANCE_ARCSEC = 1.5
MAX_RATE_ARCSEC_PER_MIN = 1.0
SEARCH_RADIUS_ARCSEC = 2.0
MAX_RESIDUAL_ARCSEC = 0.5
MATCH_RADIUS_ARCSEC = 2.0
MIN_DETECTIONS = 3
MIN_SEQUENCE_FRAMES = 3
MAX_SEQUENCE_FRAMES = 10


@dataclass(frozen=True)
class BuildConfig:
    """The five thresholds of a build and the smallest tracklet."""

    stationary_tolerance_arcsec: float = STATIONARY_TOLERANCE_ARCSEC
    max_rate_arcsec_per_min: float = MAX_RATE_ARCSEC_PER_MIN
    search_radius_arcsec: float = SEARCH_RADIUS_ARCSEC
    max_residual_arcsec: float = MAX_RESIDUAL_ARCSEC
    match_radius_arcsec: float = MATCH_RADIUS_ARCSEC
    min_detections: int = MIN_DETECTIONS

    def __post_init__(self) -> None:
        for f in fields(self):
            value = getattr(self, f.name)
            if f.name == "min_detections":
                if value < 3:
                    raise ValueError("min_detections must be at least 3")
            elif not value > 0:
                raise ValueError(f"{f.name} must be positive")

    def with_value(self, name: str, value: float) -> "BuildConfig":
        return replace(self, **{name: value})


DEFAULT = BuildConfig()
