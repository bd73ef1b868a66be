"""Settings of experiments, with the values of the reference's experiments as defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from lodecast.functions.text import literal


@dataclass(frozen=True)
class Settings:
    """What an experiment of one period and domain, or of many, is run with."""

    rotated: bool = True
    neighbours: int = 9
    least_neighbours: int = 2
    covariance: str = "matern"
    smoothness: float = 1.5
    training_points: int = 3000
    max_lag: float = 1000.0
    lags: int = 80
    nugget: bool = True
    margin: float = 3000.0
    scored: bool = False
    least_scored: int = 30
    simulations: int = 128
    restarts: int = 3
    analysis_max_lag: float = 250.0
    analysis_lags: int = 45
    required_samples: int = 30
    slack: float = 0.05

    def __post_init__(self) -> None:
        if self.covariance not in ("exponential", "gaussian", "spherical", "matern"):
            raise ValueError(f"no covariance model {self.covariance!r}")
        # Between 4 and 256 simulations are drawn.
        object.__setattr__(self, "simulations", min(max(int(self.simulations), 4), 256))


def changed(settings: Settings, overrides: dict[str, str]) -> Settings:
    """Settings with overrides as texts, such as ``{"max_lag": "500"}``; names that settings do not have are an error."""
    known = {f.name for f in fields(settings)}
    if unknown := set(overrides) - known:
        raise ValueError(f"no such settings: {sorted(unknown)}")
    return replace(settings, **{k: literal(v) if isinstance(v, str) else v for k, v in overrides.items()})
