"""Structured Streaming jobs over frames, annotations and detections."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .late_frames import chosen
from .upserts import SaveLog

#: State of a video that sends nothing for so long is dropped.
IDLE_MS = 60 * 60 * 1000


def stateful(frames: DataFrame, step, schema: str, state: str, idle_ms: int | None) -> DataFrame:
    """step(video, its frames of the batch in order, state or None) -> (rows, new state), for every video. The state of a
    video without frames for ``idle_ms`` is dropped, so that ended videos cost nothing; one that comes back starts anew. None
    keeps all state, for a finite source: with a timeout a query goes on for as long as there is state to drop."""
    columns = [part.split()[0] for part in schema.split(", ")]

    def run(key: tuple, parts: Iterator[pd.DataFrame], own: GroupState) -> Iterator[pd.DataFrame]:
        if own.hasTimedOut:
            own.remove()
            return
        rows, new = step(key[0], pd.concat(parts).sort_values("frame_idx"), own.get[0] if own.exists else None)
        own.update((new,))
        if idle_ms is not None:
            own.setTimeoutDuration(idle_ms)
        yield pd.DataFrame(dict(zip(columns, rows)))

    return frames.groupBy("video_id").applyInPandasWithState(run, schema, state, "append", GroupStateTimeout.NoTimeout if idle_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def stream_keyframes(frames: DataFrame, fps: float = 10.0, threshold: float = 5.0, keep_first: bool = True, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Key frames of an unbounded frame stream: video_id, frame_idx, reason. State: the last gray thumbnail of a video.

    Within a micro-batch frames are put in order of frame_idx; a video's frames must not arrive in a later batch than
    their successors. Where they do, ``late_frames.stream_late_keyframes`` waits for them."""
    every = max(int(fps), 1)

    def step(video, rows: pd.DataFrame, last):
        gray, index = np.stack(rows["gray"].to_numpy()).astype(np.int64), rows["frame_idx"].to_numpy()
        index, reason = chosen(index, gray, None if last is None else np.array(last, dtype=np.int64), every, threshold, keep_first)
        return (np.full(len(index), video), index, reason), gray[-1].tolist()

    return stateful(frames, step, "video_id long, frame_idx long, reason string", "gray array<long>", idle_ms)


def stream_rolling_latency(frames: DataFrame, last: int = 30, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """avg_ms, min_ms, max_ms, fps of each camera's last so many inference times. State: those times."""

    def step(video, rows: pd.DataFrame, times):
        times = [] if times is None else list(times)
        every = pd.Series([*times, *rows["infer_ms"].astype(float)])
        window = every.rolling(last, min_periods=1)
        mean, least, most = (x.to_numpy()[len(times) :] for x in (window.mean(), window.min(), window.max()))
        fps = np.divide(1000.0, mean, out=np.full(len(mean), np.nan), where=mean > 0)
        return (np.full(len(mean), video), rows["frame_idx"].to_numpy(), mean, least, most, fps), every.iloc[-last:].tolist()

    schema = "video_id long, frame_idx long, avg_ms double, min_ms double, max_ms double, fps double"
    return stateful(frames, step, schema, "times array<double>", idle_ms)


def stream_batches(frames: DataFrame, size: int = 4, idle_ms: int | None = IDLE_MS) -> DataFrame:
    """Frames in groups of so many, across micro-batches: video_id, batch, frame_idx. Each row comes out at once, with the number of its
    group; state is the number of frames seen, so the last group of a video may hold fewer."""

    def step(video, rows: pd.DataFrame, seen):
        n = (0 if seen is None else int(seen)) + np.arange(len(rows))
        return (np.full(len(n), video), n // size, rows["frame_idx"].to_numpy()), int(n[-1]) + 1

    return stateful(frames, step, "video_id long, batch long, frame_idx long", "seen long", idle_ms)


def stream_detection_counts(detections: DataFrame, time: str = "ts", label: str = "label", window: str = "10 minutes", delay: str = "10 minutes") -> DataFrame:
    """Detections by label in tumbling windows; the watermark bounds the state. Also runs on a batch table."""
    timed = detections.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    counts = timed.groupBy(F.window(time, window), label).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").cast("timestamp_ntz").alias("start"), label, "n")


def stream_upsert_annotations(saves: DataFrame, target: str, checkpoint: str, key: str = "image_id", order: str = "ts", share: float | None = 0.5):
    """A query whose micro-batches go to a table in which the last save of each image, by ``order``, wins, even over one
    that arrives later. Each batch adds its own rows to the table's log; when the log takes ``share`` of the table it is
    folded (None: never; fold it by another job). ``upserts.SaveLog(...).current()`` reads the table with its log."""
    kind, source = saves.schema, hashlib.md5(checkpoint.encode()).hexdigest()[:12]  # batches are numbered by checkpoint

    def write(batch: DataFrame, number: int) -> None:
        log = SaveLog(batch.sparkSession, target, kind, key, order)
        log.append(batch, source, number)
        if share is not None and log.due(share):
            log.fold()

    return saves.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
