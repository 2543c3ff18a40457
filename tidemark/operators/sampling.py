"""Choosing frames: fixed strides, ranges, and the active/idle state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.geometry import overlap
from tidemark.params import Sampling


def every(frames: DataFrame, index: str, step: int, start: int = 0, limit: int | None = None) -> DataFrame:
    """Frames ``start``, ``start + step`` and so on, the first ``limit`` of them that exist; without a limit a filter on the index alone."""
    out = frames.where((F.col(index) >= start) & (F.pmod(F.col(index) - start, F.lit(step)) == 0))
    return out if limit is None else out.orderBy(index).limit(limit)


def detections(boxes: DataFrame, frame: str, box: str, confidence: float, max_overlap: float, person_class: int | None = None) -> DataFrame:
    """Boxes (frame, box, x1, y1, x2, y2, confidence, class) of a class that reach a confidence, without those that overlap a stronger one that stays.

    Stronger is more confident, then the smaller id. Whether a box stays depends on those before it in its frame only, so a frame's boxes
    are folded in that order, inside the JVM; a frame holds few of them. Null coordinates, confidence and frames are left out.
    """
    kept = boxes.where((F.col("confidence") >= confidence) & F.col(frame).isNotNull() & F.expr("x2 > x1 and y2 > y1"))
    if person_class is not None:
        kept = kept.where(F.col("class") == person_class)
    item = F.struct((-F.col("confidence")).alias("c"), F.col(box).alias("i"), *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")])
    sides = lambda r: [r[c] for c in ("x1", "y1", "x2", "y2")]
    rows = kept.groupBy(frame).agg(F.array_sort(F.collect_list(item)).alias("_r"))
    fold = F.aggregate("_r", F.slice("_r", 1, 0), lambda out, r: F.when(F.exists(out, lambda o: overlap(sides(o), sides(r)) > max_overlap), out).otherwise(F.concat(out, F.array(r))))
    return rows.select(frame, F.explode(fold).alias("_k")).select(frame, F.col("_k.i").alias(box), *[F.col(f"_k.{c}").alias(c) for c in ("x1", "y1", "x2", "y2")], (-F.col("_k.c")).alias("confidence"))


def adaptive(frames: DataFrame, fps: float, params: Sampling) -> DataFrame:
    """(video_id, proc_seq, frame_index, mode, epoch, active_seq, face_search): the frames processed of (video_id, frame_index, seen).

    While active every short stride is processed; when nobody was seen for ``idle_after_s`` the recording goes
    idle, its long stride looks for somebody, and when there is one it rewinds a little and is active anew. A
    new epoch starts with each wake-up, so going idle ends what was going on. Frames are taken in order, so a recording is one task; recordings
    are independent. Rewinding goes back to the recording's start at most, so frames looked at before may come again.
    ``active_seq`` numbers an epoch's active frames from 0; faces are searched on every ``face_every``-th of them that shows somebody, in the
    zone where a column ``in_zone`` says so.
    """
    active, idle = params.strides(fps)
    after, back = params.idle_after_s * fps, int(round(params.rewind_s * fps))

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        seen = dict(zip(f["frame_index"], f["seen"], strict=True))
        zone = dict(zip(f["frame_index"], f["in_zone"], strict=True)) if "in_zone" in f else seen
        at, end = int(f["frame_index"].min()), int(f["frame_index"].max())
        start, mode, epoch, last, nth, out = at, "active", 0, at, 0, []
        while at <= end:
            if at in seen:
                on = mode == "active"
                out.append((key[0], len(out), at, mode, epoch, nth if on else None, on and nth % params.face_every == 0 and bool(zone[at])))
                nth += on
                hit = bool(seen[at])
                if mode == "idle" and hit:
                    mode, epoch, last, nth = "active", epoch + 1, at, 0
                    at = max(start, at - back)
                    continue
                if hit:
                    last = at
                if mode == "active" and at - last >= after:
                    mode = "idle"
            at += active if mode == "active" else idle
        out = pd.DataFrame(out, columns=["video_id", "proc_seq", "frame_index", "mode", "epoch", "active_seq", "face_search"])
        return out.astype({"active_seq": "Int64"})

    return frames.groupBy("video_id").applyInPandas(run, "video_id bigint, proc_seq bigint, frame_index bigint, mode string, epoch bigint, active_seq bigint, face_search boolean")


def with_model(frames: DataFrame, load, infer, schema: str) -> DataFrame:
    """Hook for a model outside this library: ``load()`` once a task, then ``infer(model, frame)`` per batch of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for b in batches:
            yield infer(model, b)

    return frames.mapInPandas(run, schema)
