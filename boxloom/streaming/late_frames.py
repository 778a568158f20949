"""Key frames of frames that arrive out of order: an event-time buffer for each video, in the state store.

A frame waits until the watermark has passed its time, when no earlier one can come any more; then the waiting frames go
through the rules of the ordered stream. The state store must be able to hold maps and timers, which is what
``spark.sql.streaming.stateStore.providerClass`` of RocksDB is for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

#: Session setting that ``stream_late_keyframes`` needs.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Frames of a video that wait in one value of the state.
RUN = 256
COLUMNS = ("video_id", "frame_idx", "reason")


def chosen(index: np.ndarray, gray: np.ndarray, last: np.ndarray | None, every: int, threshold: float, keep_first: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of frames in order, after the frame ``last`` of the video, if any: the indexes of the key frames and their reasons."""
    before = gray[:-1] if last is None else np.concatenate(([last], gray[:-1]))
    scene = np.abs(gray[len(gray) - len(before) :] - before).mean(axis=1) > threshold if gray.size else np.zeros(len(before), dtype=bool)
    if last is None:
        scene = np.concatenate(([keep_first], scene))
    timed = index % every == 0
    at = np.flatnonzero(timed | scene)
    return index[at], np.where(timed[at], "interval", "scene_change").astype(object)


class LateKeyframes(StatefulProcessor):
    """State of a video: the frames that wait, in runs by time and index; the last frame that has gone through, and its time.

    One timer a video stands at the earliest waiting frame; without any, at the time when the video counts as ended and
    its state goes (``idle_ms`` after its last frame). One that comes back after that starts anew."""

    def __init__(self, every: int, threshold: float, keep_first: bool, idle_ms: int):
        self.rule, self.idle_ms = (every, threshold, keep_first), idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long, frame_idx long", "ms array<long>, frame_idx array<long>, gray array<array<long>>")
        self.last = handle.getValueState("last", "ms long, gray array<long>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs()
        for part in rows:
            part = part[part["frame_idx"].notna() & (part["ms"] >= passed)]  # a row without a frame only moves the watermark
            if len(part):
                ms, index = part["ms"].to_numpy(dtype=np.int64), part["frame_idx"].to_numpy(dtype=np.int64)
                self.put(ms, index, [[int(x) for x in g] for g in part["gray"]])
        self.wait(passed)
        return iter([])

    def put(self, ms: np.ndarray, index: np.ndarray, gray: list) -> None:
        """Frames wait in runs of consecutive ones, a state's value each, under the first one's time and index."""
        order = np.lexsort((index, ms))
        for at in range(0, len(order), RUN):
            own = order[at : at + RUN]
            key = (int(ms[own[0]]), int(index[own[0]]))
            old = self.waiting.getValue(key) if self.waiting.containsKey(key) else ([], [], [])
            self.waiting.updateValue(key, ([*old[0], *ms[own].tolist()], [*old[1], *index[own].tolist()], [*old[2], *(gray[i] for i in own)]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed = timerValues.getCurrentWatermarkInMs()
        frames: dict[tuple[int, int], list] = {}
        for first in [k for k in self.waiting.keys() if k[0] < passed]:
            run = self.waiting.getValue(first)
            self.waiting.removeKey(first)
            late = [i for i, ms in enumerate(run[0]) if ms >= passed]
            if late:
                self.put(np.array([run[0][i] for i in late]), np.array([run[1][i] for i in late]), [run[2][i] for i in late])
            # a frame that came twice is one
            frames.update({(i, ms): gray for ms, i, gray in zip(*run) if ms < passed})
        if frames:
            ready = sorted(frames)
            gray = np.array([frames[k] for k in ready], dtype=np.int64)
            last = np.array(self.last.get()[1], dtype=np.int64) if self.last.exists() else None
            index, reason = chosen(np.array([k[0] for k in ready]), gray, last, *self.rule)
            self.last.update((max(k[1] for k in ready), gray[-1].tolist()))
            if len(index):
                yield pd.DataFrame(dict(zip(COLUMNS, (np.full(len(index), key[0]), index, reason))))
        self.wait(passed)

    def wait(self, passed: int) -> None:
        """Set the timer for what comes next, or drop the state of a video that has ended."""
        first = min((k[0] for k in self.waiting.keys()), default=None)
        if first is None and self.last.exists():
            first = self.last.get()[0] + self.idle_ms
            if first < passed:
                self.last.clear()
                return
        if first is not None:
            self.handle.registerTimer(first + 1)

    def close(self) -> None:
        pass


def stream_late_keyframes(frames: DataFrame, time: str = "ts", delay: str = "10 minutes", fps: float = 10.0, threshold: float = 5.0, keep_first: bool = True, idle_ms: int = 24 * 60 * 60 * 1000) -> DataFrame:
    """video_id, frame_idx, reason of the key frames of an unbounded stream whose frames may come up to ``delay`` late.

    The time must not fall as frame_idx rises. Frames that come later than that are dropped, as if the camera had not
    taken them. A frame comes out when the watermark has passed it; rows with a null frame_idx move the watermark and do
    nothing else, so that a source can end a video. ``idle_ms`` is event time."""
    timed = frames.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    rows = timed.select("video_id", "frame_idx", "gray", time, F.unix_millis(time).alias("ms"))
    return rows.groupBy("video_id").transformWithStateInPandas(
        LateKeyframes(max(int(fps), 1), threshold, keep_first, idle_ms), "video_id long, frame_idx long, reason string", "Append", "EventTime"
    )
