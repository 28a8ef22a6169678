"""Settings of a collection."""

from __future__ import annotations

import struct
from dataclasses import asdict, dataclass

COSINE, DOT, L2 = "cosine", "dot", "l2"
# Fixed value: the default seed, 0x9E3779B97F4A7C15 as a signed 64-bit integer.
DEFAULT_SEED = -7046029254386353131


def parse_metric(name: str) -> str:
    """``cosine``, ``dot``, ``l2`` (also ``euclidean``), in any case."""
    known = {"cosine": COSINE, "dot": DOT, "l2": L2, "euclidean": L2}
    got = known.get(name.lower()) if isinstance(name, str) else None
    if got is None:
        raise ValueError(f'unknown metric "{name}" (expected cosine, dot, or l2)')
    return got


def seed_from_number(x: float) -> int:
    """The IEEE-754 bits of a floating-point seed, as a signed 64-bit integer."""
    return struct.unpack(">q", struct.pack(">d", float(x)))[0]


@dataclass(frozen=True)
class Config:
    """``ef_search`` budgets approximate search and ``seed`` its clustering; the exact plan needs only the metric.

    ``max_connections`` and ``ef_construction`` are kept with the collection for its users; no plan here reads them.
    """

    max_connections: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    metric: str = COSINE
    seed: int = DEFAULT_SEED

    def __post_init__(self) -> None:
        object.__setattr__(self, "metric", parse_metric(self.metric))
        for name in ("max_connections", "ef_construction", "ef_search"):
            if int(getattr(self, name)) < 0:
                raise ValueError(f"{name} must not be negative")

    def to_dict(self) -> dict:
        return asdict(self)
