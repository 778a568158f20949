"""Which objects of a remote store have to be fetched, from a stream of its listings.

State is what has been fetched: the size of each object, in buckets of names, in the state store (RocksDB, see
``late_frames.STATE_STORE``). Work and writes of a batch follow its listing, not what is there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


class Fetched(StatefulProcessor):
    """Passes on what isn't there with the same size, and takes it as there from then on."""

    def init(self, handle) -> None:
        self.there = handle.getMapState("there", "name string", "size long, listed timestamp")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        every = pd.concat(list(rows)).sort_values(["listed", "size"]).drop_duplicates("name", keep="last")
        taken = []
        for name, size, listed in zip(every["name"], every["size"], every["listed"]):
            known = self.there.getValue((name,)) if self.there.containsKey((name,)) else None
            if known is not None and pd.Timestamp(known[1]) > listed:
                continue  # an older listing that comes late
            if known is None or known[0] != size:
                taken.append((name, size, listed))
            self.there.updateValue((name,), (int(size), listed.to_pydatetime()))
        if taken:
            yield pd.DataFrame(taken, columns=["name", "size", "listed"])

    def close(self) -> None:
        pass


def stream_ingest(listings: DataFrame, buckets: int = 4096) -> DataFrame:
    """name, size, listed of the objects to fetch, from a stream of listings with these columns (``listed``: the listing's
    time). An object comes again when its size has changed. Of several listings in a batch the last counts, and listings
    older than what is known count for nothing. Rows without a name, a size or a time are passed over."""
    rows = listings.dropna(subset=["name", "size", "listed"]).select("name", F.col("size").cast("long").alias("size"), F.col("listed").cast("timestamp").alias("listed"))
    return rows.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(buckets))).groupBy("bucket").transformWithStateInPandas(Fetched(), "name string, size long, listed timestamp", "Append", "None")
