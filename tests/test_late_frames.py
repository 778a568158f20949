"""Key frames of frames that come batches late."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from boxloom.operators import frames as fr
from boxloom.streaming.late_frames import STATE_STORE, stream_late_keyframes

KIND = "video_id long, frame_idx long, ts timestamp, gray array<long>"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def session(spark):
    own = spark.newSession()
    own.conf.set(*STATE_STORE)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    return own


def frames_of(n, videos=3, seed=1):
    rng = random.Random(seed)
    return [(v, i, START + timedelta(seconds=i), [rng.choice([0, 0, 0, 40]) for _ in range(4)]) for v in range(videos) for i in range(n)]


def run(session, folder, batches, delay="20 seconds", **more):
    """Stream the batches one after another, each in a run of its own; the rows that come out."""
    for rows in batches:
        session.createDataFrame(rows, KIND).coalesce(1).write.mode("append").parquet(str(folder / "in"))
        out = stream_late_keyframes(session.readStream.schema(KIND).parquet(str(folder / "in")), delay=delay, **more)
        out.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(folder / "cp")).format("parquet").start(str(folder / "out")).awaitTermination()
    return sorted(tuple(r) for r in session.read.schema(out.schema).parquet(str(folder / "out")).collect())


def batch_result(session, rows):
    f = session.createDataFrame(rows, KIND)
    return sorted(tuple(r) for r in fr.keyframes_both(f, least_seconds=0.0).select("video_id", "frame_idx", "reason").collect())


def end(video, seconds):
    return (video, None, START + timedelta(seconds=seconds), None)


def test_frames_that_come_batches_late_count_in_order(session, tmp_path):
    rows = frames_of(45)
    rng = random.Random(2)
    batches = [[], [], [], [], []]
    for r in rows:
        batches[r[1] // 15 + rng.choice([0, 0, 1])].append(r)  # up to a batch, 15 seconds, late
    batches[4].append(end(0, 500))
    for b in batches:
        rng.shuffle(b)
    assert run(session, tmp_path, batches) == batch_result(session, rows)


def test_too_late_frames_are_dropped_and_waiting_ones_outlive_a_restart(session, tmp_path):
    rows = [r for r in frames_of(40, videos=1)]
    lost = rows[3]
    batches = [[r for r in rows[:20] if r is not lost], rows[20:], [lost, end(0, 500)]]
    assert run(session, tmp_path, batches, delay="5 seconds") == batch_result(session, [r for r in rows if r is not lost])


def test_ended_videos_leave_no_state(session, tmp_path):
    """A video that comes back after the idle time starts anew: its first frame is a key frame again."""
    still = [(1, i, START + timedelta(seconds=s), [5, 5]) for i, s in ((1, 0), (2, 1), (3, 1000), (4, 1001))]
    got = run(session, tmp_path, [still[:2], [end(2, 600)], [end(2, 601)], still[2:], [end(2, 2000)]], delay="1 second", idle_ms=60_000)
    assert got == [(1, 1, "scene_change"), (1, 3, "scene_change")]
    again = tmp_path / "kept"
    again.mkdir()
    got = run(session, again, [still[:2], [end(2, 600)], [end(2, 601)], still[2:], [end(2, 2000)]], delay="1 second", idle_ms=3_600_000)
    assert got == [(1, 1, "scene_change")]


def test_equal_times_and_no_first_frame(session, tmp_path):
    rows = [(1, i, START, [i * 50]) for i in (3, 1, 2)]
    assert run(session, tmp_path, [rows, [end(1, 99)]], delay="1 second", keep_first=False) == [(1, 2, "scene_change"), (1, 3, "scene_change")]
