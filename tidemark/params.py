"""Typed parameters of the operators, checked when they are made."""

from __future__ import annotations

import hashlib
import json
import os
from dataclasses import asdict, dataclass, field, fields, is_dataclass


def _need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


#: The enumerations of states, policies and choices.
CHOICES = {
    "point_policy": ("bottom_center",),
    "tracker": ("bytetrack", "botsort"),
    "device": ("auto", "cpu", "mps"),
    "ambiguity_policy": ("closest_with_flag",),
    "group_policy": ("attach_all_with_group_flag",),
    "formats": ("csv", "xlsx", "parquet"),
    "run_status": ("created", "running", "finished", "failed"),
    "end_status": ("unavailable", "valid", "calibrated", "mismatch"),
    "anchor_source": ("ocr", "manual", "manual_required"),
    "sync_status": ("create", "update", "unchanged", "delete"),
    "pose": ("frontal", "left", "right", "unknown"),
}


@dataclass(frozen=True)
class Detection:
    """What counts as a detected person, and how zones and tracks are chosen."""

    confidence: float = 0.4
    overlap: float = 0.5
    person_class: int = 0
    device: str = "auto"
    tracker: str = "bytetrack"
    point_policy: str = "bottom_center"

    def __post_init__(self) -> None:
        _need(0 <= self.confidence <= 1 and 0 <= self.overlap <= 1, "detection: confidence and overlap lie in 0..1")
        _need(self.person_class >= 0, "detection: a class is not negative")
        for name in ("device", "tracker", "point_policy"):
            _need(getattr(self, name) in CHOICES[name], f"detection: {name} is one of {CHOICES[name]}")


@dataclass(frozen=True)
class Faces:
    """Largest angles, in degrees, and least size and confidence of a face that identifies a person."""

    max_yaw: float = 40.0
    max_pitch: float = 30.0
    max_roll: float = 30.0
    frontal_yaw: float = 15.0
    min_size: int = 40
    min_confidence: float = 0.6
    frame_margin: int = 3

    def __post_init__(self) -> None:
        _need(all(0 <= x <= 90 for x in (self.max_yaw, self.max_pitch, self.max_roll, self.frontal_yaw)), "faces: angles lie in 0..90")
        _need(self.min_size >= 1 and self.frame_margin >= 0 and 0 <= self.min_confidence <= 1, "faces: size, margin or confidence out of range")


@dataclass(frozen=True)
class Sampling:
    """Seconds between processed frames while someone is seen (active) or not (idle)."""

    active_s: float = 0.12
    idle_s: float = 1.2
    idle_after_s: float = 30.0
    rewind_s: float = 2.0
    #: Active frames from one search for faces to the next.
    face_every: int = 10

    def __post_init__(self) -> None:
        _need(self.face_every >= 1, "sampling: face_every must be at least 1")
        _need(min(self.active_s, self.idle_s, self.idle_after_s) > 0 and self.rewind_s >= 0, "sampling: intervals must be positive")
        _need(self.idle_s > self.active_s, "sampling: the idle interval must exceed the active one")
        _need(self.rewind_s < self.idle_after_s, "sampling: rewinding must be shorter than the wait for idle")

    def strides(self, fps: float) -> tuple[int, int]:
        """Frames from one processed frame to the next, active and idle; rounded half to even, at least one."""
        active = max(1, round(self.active_s * fps))
        return active, max(active + 1, round(self.idle_s * fps))


@dataclass(frozen=True)
class Sessions:
    max_missing_s: float = 90.0
    merge_gap_s: float = 90.0
    min_visit_s: float = 15.0

    def __post_init__(self) -> None:
        _need(self.max_missing_s > 0 and self.merge_gap_s > 0 and self.min_visit_s >= 0, "sessions: times must be positive")


@dataclass(frozen=True)
class Matching:
    before_s: float = 0.0
    after_s: float = 60.0
    ambiguity_policy: str = "closest_with_flag"
    group_policy: str = "attach_all_with_group_flag"

    def __post_init__(self) -> None:
        for name in ("ambiguity_policy", "group_policy"):
            _need(getattr(self, name) in CHOICES[name], f"matching: {name} is one of {CHOICES[name]}")
        _need(self.before_s >= 0 and self.after_s >= 0, "matching: a window reaches outward")


@dataclass(frozen=True)
class Identity:
    threshold: float = 0.35
    margin: float = 0.05
    candidates: int = 5
    references: int = 5
    per_pose: int = 2
    staff_threshold: float = 0.5

    def __post_init__(self) -> None:
        _need(all(0 <= x <= 1 for x in (self.threshold, self.margin, self.staff_threshold)), "identity: thresholds lie in 0..1")
        _need(min(self.candidates, self.references, self.per_pose) >= 1, "identity: caps are at least 1")


@dataclass(frozen=True)
class Timeline:
    start_offsets_s: tuple[float, ...] = (0, 2, 5, 10, 20, 30)
    end_offsets_s: tuple[float, ...] = (30, 10, 2)
    min_start: int = 2
    min_end: int = 2
    tolerance_s: float = 2.0
    valid_s: float = 2.0
    calibrated_s: float = 10.0

    def __post_init__(self) -> None:
        s, e = self.start_offsets_s, self.end_offsets_s
        _need(bool(s) and s[0] == 0 and all(a < b for a, b in zip(s, s[1:])), "timeline: start offsets ascend from 0")
        _need(bool(e) and all(a > b for a, b in zip(e, e[1:])), "timeline: end offsets descend")
        _need(1 <= self.min_start <= len(s) and 1 <= self.min_end <= len(e), "timeline: more consistent readings asked than offsets given")
        _need(0 <= self.valid_s <= self.calibrated_s, "timeline: valid within calibrated")


@dataclass(frozen=True)
class Params:
    time_zone: str = "Europe/Moscow"
    database_url: str = ""
    sampling: Sampling = field(default_factory=Sampling)
    sessions: Sessions = field(default_factory=Sessions)
    matching: Matching = field(default_factory=Matching)
    identity: Identity = field(default_factory=Identity)
    timeline: Timeline = field(default_factory=Timeline)
    detection: Detection = field(default_factory=Detection)
    faces: Faces = field(default_factory=Faces)

    def snapshot(self) -> dict:
        """All parameters, with a password in the database address masked."""
        out = asdict(self)
        head, at, tail = self.database_url.rpartition("@")
        if at and ":" in head.partition("//")[2]:
            out["database_url"] = head[: head.rindex(":")] + ":***@" + tail
        return out

    def digest(self) -> str:
        """SHA-256 of the parameters that bear on results, as compact JSON with sorted keys."""
        bearing = {k: v for k, v in self.snapshot().items() if k != "database_url"}
        return hashlib.sha256(json.dumps(bearing, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _made(kind: type, values: dict, where: str):
    known = {f.name: f for f in fields(kind)}
    unknown = sorted(set(values) - set(known))
    _need(not unknown, f"{where or 'parameters'}: unknown {unknown}")
    out = {}
    for name, value in values.items():
        now = getattr(kind(), name)
        if is_dataclass(now):
            _need(isinstance(value, dict), f"{name}: a section of values")
            out[name] = _made(type(now), value, name)
        else:
            _need(isinstance(value, list) if isinstance(now, tuple) else isinstance(value, (int, float)) and not isinstance(value, bool) if isinstance(now, (int, float)) else isinstance(value, type(now)), f"{where}.{name}: {value!r} is of another type")
            out[name] = tuple(value) if isinstance(now, tuple) else value
    return kind(**out)


def load(path: str) -> Params:
    """Parameters from a JSON file, or a YAML file where a YAML reader is installed; what it leaves out keeps its default.

    Raises ``ValueError`` for an unknown name, another type and a value out of range.
    """
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if os.path.splitext(path)[1].lower() in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise ValueError(f"{path}: no YAML reader is installed, give JSON") from e
        values = yaml.safe_load(text)
    else:
        values = json.loads(text)
    _need(isinstance(values, dict), f"{path}: a mapping of sections")
    return _made(Params, values, "")
