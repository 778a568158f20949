"""The stream of listings: changed sizes, restarts, late and repeated listings."""

from datetime import datetime, timedelta, timezone

import pytest

from boxloom.streaming.ingest import stream_ingest
from boxloom.streaming.late_frames import STATE_STORE

KIND = "name string, size long, listed timestamp"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


@pytest.fixture
def session(spark):
    own = spark.newSession()
    own.conf.set(*STATE_STORE)
    own.conf.set("spark.sql.shuffle.partitions", "2")
    return own


def listing(day, **sizes):
    return [(n, s, START + timedelta(days=day)) for n, s in sizes.items()]


def run(session, folder, rows=()):
    """A run over what is there, after adding the rows; what it gives."""
    if rows:
        session.createDataFrame(list(rows), KIND).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    before = set(session.read.schema(KIND).parquet(str(folder / "out")).collect()) if (folder / "out").exists() else set()
    out = stream_ingest(session.readStream.schema(KIND).parquet(str(folder / "in")), buckets=4)
    out.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(folder / "cp")).format("parquet").start(str(folder / "out")).awaitTermination()
    return sorted((r["name"], r["size"]) for r in set(session.read.schema(KIND).parquet(str(folder / "out")).collect()) - before)


def test_listings(session, tmp_path):
    assert run(session, tmp_path, listing(0, a=1, b=2)) == [("a", 1), ("b", 2)]
    assert run(session, tmp_path) == []  # a restart takes nothing twice
    assert run(session, tmp_path, listing(1, a=1, b=3, c=4)) == [("b", 3), ("c", 4)]  # a changed size is taken again
    assert run(session, tmp_path, listing(0, a=9, b=2)) == []  # an old listing that comes late
    assert run(session, tmp_path, listing(2, b=2)) == [("b", 2)]  # a size that comes back is another size
    both = listing(3, a=5, d=1) + listing(4, a=1, d=1) + [(None, 1, START), ("e", None, START), ("f", 1, None)]
    assert run(session, tmp_path, both) == [("d", 1)]  # the last listing of a batch counts
