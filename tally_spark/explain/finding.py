"""What the explanation layer says of a cluster, and what it cost."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

CLASSES = ["TIMING_DIFFERENCE", "ROUNDING", "DUPLICATE_IN_TARGET", "MISSING_IN_TARGET", "SCHEMA_DRIFT", "GENUINE_DISCREPANCY", "UNKNOWN"]


@dataclass(frozen=True)
class Usage:
    calls: int = 0
    input_tokens: int = 0
    output_tokens: int = 0
    thinking_tokens: int = 0
    latency_ms: int = 0
    wait_ms: int = 0

    @property
    def total_tokens(self) -> int:
        return self.input_tokens + self.output_tokens + self.thinking_tokens

    def __add__(self, other: Usage) -> Usage:
        return Usage(*(getattr(self, f.name) + getattr(other, f.name) for f in fields(Usage)))

    def __sub__(self, other: Usage) -> Usage:
        return Usage(*(getattr(self, f.name) - getattr(other, f.name) for f in fields(Usage)))


@dataclass(frozen=True)
class Finding:
    cluster_id: str
    classification: str
    confidence: float
    explanation: str
    suggested_action: str
    evidence: tuple[str, ...] = ()
    provider: str = "offline"
    model: str | None = None
    model_backed: bool = False
    degraded: bool = False
    steps: int = 0
    tool_calls: int = 0
    usage: Usage = Usage()

    def to_dict(self) -> dict:
        return asdict(self) | {"evidence": list(self.evidence)}


def degraded(cluster_id: str, reason: str, provider: str = "offline", model: str | None = None, **more) -> Finding:
    return Finding(cluster_id, "UNKNOWN", 0.0, f"Not explained: {reason}", "Investigate manually.", provider=provider, model=model, degraded=True, **more)
