"""Hooks for models: detectors, recognisers and encoders plug in as Arrow-batched functions.

No model ships here. A hook is built once per Python worker task from a factory, then
called with whole batches; filters on cheap columns belong before it, so that they reach the scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

Model = Callable[[pd.DataFrame], pd.DataFrame]


def apply_model(rows: DataFrame, factory: Callable[[], Model], schema: str) -> DataFrame:
    """Runs a model over batches of rows; it may return any number of rows (a detector does)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for batch in batches:
            yield model(batch)

    return rows.mapInPandas(run, schema)


DETECTION = "label string, confidence double, x1 double, y1 double, x2 double, y2 double"


def detect(
    frames: DataFrame, factory: Callable[[], Callable[..., Iterator[tuple]]], payload: list[str], *, labels: list[str] | None = None, least: float = 0.0,
    size: tuple[float, float] | None = None,
) -> DataFrame:
    """Every frame with its detections: a detector as a table function, joined laterally, so one frame gives any number of rows.

    ``factory()`` is called once a task and gives a function of the ``payload`` columns that yields rows of ``DETECTION``. The filters by label and confidence and the clip to
    the frame's ``size`` are expressions of the plan; a box with no area left goes.
    """

    @udtf(returnType=DETECTION)
    class Detector:
        def __init__(self):
            self.model = factory()

        def eval(self, *values):
            yield from self.model(*values)

    rows = frames.lateralJoin(Detector(*[F.col(c).outer() for c in payload]))
    rows = rows.where(F.col("confidence") >= least)
    rows = rows.where(F.col("label").isin(labels)) if labels else rows
    if size:
        rows = rows.withColumns({c: F.greatest(F.lit(0.0), F.least(F.lit(float(size[k % 2])), F.col(c))) for k, c in enumerate(("x1", "y1", "x2", "y2"))})
    return rows.where("x2 > x1 and y2 > y1")


def points_in_frame(points: Column, box: tuple[Column, Column], scale: tuple[Column, Column]) -> Column:
    """Key points of a crop (array of x, y, confidence) in the frame's coordinates: times the crop's scale, plus the corner of its box."""
    at = lambda p, c, k: (box[k] + p[c] * scale[k]).alias(c)
    return F.transform(points, lambda p: F.struct(at(p, "x", 0), at(p, "y", 1), p["confidence"].alias("confidence")))


@dataclass(frozen=True)
class TrackerOptions:
    backend: str = "simple_iou"
    max_age_frames: int = 12
    min_iou: float = 0.05
    max_center_distance: float = 120.0
    iou_weight: float = 0.65
    center_weight: float = 0.35


@dataclass(frozen=True)
class TeamOptions:
    temperature: float = 0.16
    unfit_confidence_cap: float = 0.62
    unknown_color_distance: float = 0.48


@dataclass(frozen=True)
class FusionOptions:
    temperature: float = 1.0
    weights: dict = field(default_factory=lambda: {"team": 2.0, "jersey": 3.2, "headshot": 1.0, "body": 0.6, "position": 0.35, "track": 0.25})

    def named(self) -> dict[str, float]:
        """The weights by the names that ``fusion.fuse`` takes; those that a configuration leaves out keep their default."""
        full = FusionOptions().weights | self.weights
        return {"label" if k == "jersey" else "head" if k == "headshot" else k: float(v) for k, v in full.items()}


@dataclass(frozen=True)
class AssignmentOptions:
    identity_confidence_threshold: float = 0.4
    window_sec: float = 1.0
    step_sec: float = 0.5


@dataclass(frozen=True)
class PositionOptions:
    enabled: bool = True
    default_prior: float = 0.5
    strength: float = 0.12


@dataclass(frozen=True)
class MemoryOptions:
    enabled: bool = True


@dataclass(frozen=True)
class DisplayOptions:
    likely_threshold: float = 0.25
    max_seconds: float | None = None
    min_player_likelihood: float = 0.25
    min_track_duration_sec: float = 0.25
    min_jersey_display_confidence: float = 0.30
    peak_lock_threshold: float = 0.80
    peak_lock_min_count: int = 2


SECTIONS = {
    "tracker": TrackerOptions, "team_classifier": TeamOptions, "fusion": FusionOptions, "assignment": AssignmentOptions,
    "position_prior": PositionOptions, "body_reid": MemoryOptions, "visualization": DisplayOptions,
}


@dataclass(frozen=True)
class Options:
    """All thresholds of a run: a dataclass for each section of a configuration, with defaults; unknown keys are left out."""

    tracker: TrackerOptions = field(default_factory=TrackerOptions)
    team_classifier: TeamOptions = field(default_factory=TeamOptions)
    fusion: FusionOptions = field(default_factory=FusionOptions)
    assignment: AssignmentOptions = field(default_factory=AssignmentOptions)
    position_prior: PositionOptions = field(default_factory=PositionOptions)
    body_reid: MemoryOptions = field(default_factory=MemoryOptions)
    visualization: DisplayOptions = field(default_factory=DisplayOptions)

    @classmethod
    def of(cls, config: dict) -> "Options":
        made = {}
        for name, kind in SECTIONS.items():
            known = {f.name for f in fields(kind)}
            made[name] = kind(**{k: v for k, v in (config.get(name) or {}).items() if k in known})
        return cls(**made)


#: The tracker names that a configuration may give, by what they stand for.
TRACKERS = {
    "own": "simple_iou strongsort deepsort".split(),
    "detector": "detector detector_ids bytetrack botsort".split(),
    "external": "sportsmot mixsort sportsmot_mixsort boxmot_botsort".split(),
}


def build_tracker(config: dict) -> Callable[[DataFrame], DataFrame]:
    """The tracker that a configuration names, over a table of detections.

    ``own`` names run the simple tracker; ``detector`` names let the detector's ids stand if it tracks, and run the simple tracker on
    frames without them; ``external`` ones need programs and weights that do not ship here, and raise, as unknown ones do.
    """
    from tracklake.streaming import tracker

    own = Options.of(config)
    name = str(own.tracker.backend).lower()
    kind = next((k for k, names in TRACKERS.items() if name in names), None)
    if kind is None:
        raise ValueError(f"unknown tracker: {name}")
    if kind == "external":
        raise NotImplementedError(f"the tracker {name} is an external program; choose one of {', '.join(TRACKERS['own'] + TRACKERS['detector'])}")
    how = {"max_age": own.tracker.max_age_frames, "min_iou": own.tracker.min_iou, "reach": own.tracker.max_center_distance}
    how |= {"iou_weight": own.tracker.iou_weight, "center_weight": own.tracker.center_weight}
    keeps_ids = kind == "detector" and bool((config.get("detector") or {}).get("use_tracking", False))
    return lambda detections: tracker.track_batch(detections if keeps_ids else detections.drop("detector_id"), **how)
