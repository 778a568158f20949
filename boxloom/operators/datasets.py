"""Mixing, sampling and splitting of datasets. Samples depend on a hash of the id, so they are the same on every run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored


def mix_datasets(parts: Sequence[DataFrame], id_col: str = "image_id") -> DataFrame:
    """All datasets, with unique_id "{number}_{id}"; rows of class -1 go."""
    out = None
    for k, p in enumerate(parts):
        own = p.where("category_id <> -1").withColumns({"dataset": F.lit(k), "unique_id": F.concat(F.lit(f"{k}_"), F.col(id_col).cast("string"))})
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def share(key: Column, seed: int = 0, digits: int = 8) -> Column:
    """A number in [0, 1) from the md5 of the key and the seed, of so many hexadecimal digits (13 at most: a double's)."""
    head = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, digits)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(16**digits))


def weighted_sample(df: DataFrame, weights: Mapping, draws: int, dataset: str = "dataset", id_col: str = "unique_id", seed: int = 0) -> DataFrame:
    """So many draws with replacement: draw (from 0) and the row that it took.

    Each draw picks a data set by the weights, whatever the sizes, and then one of its rows, all alike. Two hashes of the
    draw's number decide, so that a sample is the same on every run; rows count by id. The draws are a table that meets the
    numbered rows on data set and number: no row is drawn on the driver, which sees the sizes of the data sets. A data set
    with a weight needs rows; rows of data sets without one are never drawn."""
    total = float(sum(weights.values()))
    if total <= 0 or min(weights.values()) < 0:
        raise ValueError("weights must not be negative, and one must be positive")
    names = [n for n, w in weights.items() if w > 0]
    mine = df.where(F.col(dataset).isin(names))
    rows = numbered(mine, [dataset, id_col], column="__number")
    spans = {r[dataset]: (r["first"], r["n"]) for r in rows.groupBy(dataset).agg(F.min("__number").alias("first"), F.count(F.lit(1)).alias("n")).collect()}  # a row a data set
    if missing := [n for n in names if n not in spans]:
        raise ValueError(f"no rows to draw from: {missing}")
    at, span, up_to = share(F.col("draw"), seed, 13), None, 0.0
    for n in names:
        up_to += weights[n] / total
        own = F.struct(F.lit(spans[n][0]).alias("first"), F.lit(spans[n][1]).alias("n"))
        span = F.when(at <= up_to, own) if span is None else span.when(at <= up_to, own)
    span = span.otherwise(own)  # the sum of the shares may fall short of 1 by rounding
    place = share(F.concat(F.col("draw").cast("string"), F.lit(":row")), seed, 13)
    wanted = df.sparkSession.range(draws).withColumnRenamed("id", "draw").withColumn("s", span)
    wanted = wanted.select("draw", (F.col("s.first") + F.floor(place * F.col("s.n")).cast("long")).alias("__number"))
    return wanted.join(rows, "__number").drop("__number")


def train_val_split(df: DataFrame, id_col: str, train: float = 0.8, seed: int = 0) -> DataFrame:
    """Column split: train or val by the id's hash."""
    return df.withColumn("split", F.when(share(F.col(id_col), seed) < train, "train").otherwise("val"))


def kitti_split(images: DataFrame, name: str = "name", val: float = 0.2, disjoint: bool = False) -> DataFrame:
    """The last part of the images by name is val; train is every image, or with ``disjoint`` the others.

    Fewer than five images: all are val. Positions come from per-range counts, so no sort runs in one task."""
    ranked = numbered(images.select(name), [name])
    n = images.count()
    take = int(val * n) or n
    v = ranked.where(F.col("number") >= n - take).select(name, F.lit("val").alias("split"))
    t = ranked.where(F.col("number") < n - take) if disjoint else ranked
    return v.union(t.select(name, F.lit("train").alias("split")))


def numbered(df: DataFrame, order: Sequence[str], start: int = 0, column: str = "number") -> DataFrame:
    """Consecutive numbers in the given order: ranges are sorted apart, and each starts after the rows before it.

    The ranges are stored once, since a second sort could draw other bounds. The driver sees one count for each range."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # the upper bits of this id are the partition's number, the lower 33 the row's place in it
    rows = stored(ranged.withColumn("__id", F.monotonically_increasing_id()))
    part, place = F.shiftright("__id", 33), F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    before, offsets = start, []
    for r in rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["n"]
    starts = spark.createDataFrame(offsets, "__part long, __start long")
    numbers = rows.withColumn("__part", part).join(F.broadcast(starts), "__part")  # one row for each range
    return numbers.withColumn(column, place + F.col("__start")).drop("__id", "__part", "__start")


def dedup_detections(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The first row, by the order, of equal keys."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
