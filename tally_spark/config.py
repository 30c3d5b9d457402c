"""Settings of a run."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass


class InputError(ValueError):
    """The input can't be read as transactions."""


class HistoryError(RuntimeError):
    """The run history can't be read or written."""


@dataclass(frozen=True)
class Settings:
    tolerance_cents: int = 1
    timing_window_days: int = 1
    max_split_legs: int = 5
    max_split_candidates: int = 12
    explain: bool = True
    provider: str = "offline"
    model: str | None = None
    max_steps: int = 6
    max_clusters: int = 40

    def __post_init__(self) -> None:
        for name in ("tolerance_cents", "timing_window_days", "max_split_legs", "max_split_candidates", "max_steps", "max_clusters"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} can't be negative")

    def digest(self) -> str:
        """Sixteen hexadecimal digits of what can change the deterministic result."""
        own = {k: v for k, v in asdict(self).items() if k in ("tolerance_cents", "timing_window_days", "max_split_legs", "max_split_candidates")}
        return hashlib.sha256(json.dumps(own, sort_keys=True).encode()).hexdigest()[:16]
