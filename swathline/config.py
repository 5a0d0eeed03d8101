"""Typed settings with their defaults, read from nested mappings (YAML)."""

from __future__ import annotations

from dataclasses import dataclass, field, fields
from typing import Any

MERGE_PRESETS = ("all", "vux_only", "puck_on_existing")


def _of(cls, d: dict | None) -> Any:
    """A settings object from a mapping; unknown keys are an error, so that none is ignored silently."""
    d = dict(d or {})
    known = {f.name for f in fields(cls)}
    if unknown := set(d) - known:
        raise ValueError(f"unknown settings {sorted(unknown)} of {cls.__name__}")
    return cls(**d)


@dataclass
class Window:
    enable: bool = False
    margin_s: float = 30.0


@dataclass
class Distance:
    enable: bool = False
    max_distance_m: float | None = None


@dataclass
class Scanner:
    name: str = ""
    path: str = ""
    r_mount: list = field(default_factory=lambda: [[1, 0, 0], [0, 1, 0], [0, 0, 1]])
    boresight: list = field(default_factory=lambda: [0.0, 0.0, 0.0])
    lever_arm: list = field(default_factory=lambda: [0.0, 0.0, 0.0])
    leapsec: float | None = 18.0
    body_vector: bool = False
    source: int = 2


@dataclass
class Merge:
    preset: str = "all"
    vux: list = field(default_factory=list)
    puck: str | None = None
    scanner_src_vux: int = 2
    scanner_src_puck: int = 1

    def __post_init__(self):
        if self.preset not in MERGE_PRESETS:
            raise ValueError(f"merge preset {self.preset!r} is none of {MERGE_PRESETS}")


@dataclass
class Match:
    neighbor_k: int = 0
    do_cross_scan: bool = False
    do_spatial_crossings: bool = False
    crossing_min_separation: int = 10
    crossing_overlap_margin_m: float = 3.0
    uncertainty_r: float | None = None
    uncertainty_r_min: float | None = None
    uncertainty_r_max: float | None = None


@dataclass
class Chunk:
    length_m: float = 15.0
    min_last_m: float | None = None
    min_points: int = 0
    match: Match = field(default_factory=Match)


@dataclass
class Spatial:
    length_m: float = 20.0
    min_last_m: float | None = None
    min_time_sep: float = 0.0
    min_points: int = 0
    uncertainty_r: float | None = None


@dataclass
class Pipeline:
    outage: list | None = None
    steps: dict = field(default_factory=lambda: {"georef": False, "merge": False, "chunk": False, "s2s": False})
    window: Window = field(default_factory=Window)
    distance: Distance = field(default_factory=Distance)
    scanners: list = field(default_factory=list)
    merge: Merge = field(default_factory=Merge)
    chunk: Chunk = field(default_factory=Chunk)
    s2s: Spatial = field(default_factory=Spatial)
    frame: str = "swiss"
    origin: list | None = None


def load(d: dict) -> Pipeline:
    """A pipeline's settings from a mapping of the same shape."""
    d = dict(d)
    parts = {"window": Window, "distance": Distance, "merge": Merge, "s2s": Spatial}
    built = {k: _of(c, d.pop(k, None)) for k, c in parts.items()}
    chunk = dict(d.pop("chunk", None) or {})
    match = _of(Match, chunk.pop("match", None))
    built["chunk"] = _of(Chunk, chunk | {"match": match})
    built["scanners"] = [_of(Scanner, s) for s in d.pop("scanners", [])]
    steps = {"georef": False, "merge": False, "chunk": False, "s2s": False} | (d.pop("steps", None) or {})
    return _of(Pipeline, d | built | {"steps": steps})
