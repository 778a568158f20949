"""Running sums and maxima of large groups, by ranges: no group is sorted, or scanned, in one task.

Rows are range-sorted by group and order and stored once. A range's rows are scanned on their own; what a group has in the
ranges before (or after) is one row a group and range, summed up over the ranges and carried in.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import stored

RANGE, PLACE = "__range", "__place"


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The rows, stored, with the number of their range and their place in the whole order. ``keys`` and ``order`` together
    should tell rows apart, so that equal rows can lie in different ranges."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    # the upper bits of this id are the partition's number, the lower 33 the row's place in it
    return stored(ranged.withColumn(PLACE, F.monotonically_increasing_id())).withColumn(RANGE, F.shiftright(PLACE, 33))


def running(rows: DataFrame, keys: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """The rows of ``in_ranges`` with running sums, by name, over each group's rows up to and with the row."""
    w = Window.partitionBy(*keys, RANGE).orderBy(PLACE).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, RANGE).agg(*[F.sum(c).alias(f"__before_{n}") for n, c in sums.items()])  # a row for each group and range
    totals = totals.select(*keys, RANGE, *[F.coalesce(F.sum(f"__before_{n}").over(before), F.lit(0)).alias(f"__before_{n}") for n in sums])
    both = joined(rows, totals, keys)
    return both.select(*rows.columns, *[(F.sum(c).over(w) + F.col(f"__before_{n}")).alias(n) for n, c in sums.items()])


def best_from_here(rows: DataFrame, keys: Sequence[str], name: str, value: Column) -> DataFrame:
    """The rows with the greatest value, as column ``name``, of each group's rows from the row on."""
    w = Window.partitionBy(*keys, RANGE).orderBy(F.desc(PLACE)).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(*keys).orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
    most = rows.groupBy(*keys, RANGE).agg(F.max(value).alias("__most"))
    most = most.select(*keys, RANGE, F.max("__most").over(after).alias("__most"))
    # greatest() passes over nulls
    return joined(rows, most, keys).select(*rows.columns, F.greatest(F.max(value).over(w), F.col("__most")).alias(name))


def with_halo(rows: DataFrame, keys: Sequence[str], n: int, columns: Sequence[str]) -> DataFrame:
    """The rows of ``in_ranges`` (keys, columns) and, for each group and range, copies of the group's last n rows before it,
    with ``halo`` true: windows of that many rows over keys and range then see what they would see over the keys alone.

    Every range of a group has a row of it, so the n ranges before hold the n rows."""
    item = F.struct(PLACE, *[F.col(c).alias(c) for c in columns])
    back = Window.partitionBy(*keys, RANGE).orderBy(F.desc(PLACE))
    tails = rows.withColumn("__back", F.row_number().over(back)).where(F.col("__back") <= n).groupBy(*keys, RANGE).agg(F.array_sort(F.collect_list(item)).alias("tail"))
    before = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(-n, -1)
    seen = F.flatten(F.collect_list("tail").over(before))
    last = F.slice(seen, F.greatest(F.size(seen) - n + 1, F.lit(1)), F.lit(n))
    halo = tails.select(*keys, RANGE, last.alias("last")).select(*keys, RANGE, F.explode("last").alias("x")).select(*keys, RANGE, "x.*", F.lit(True).alias("halo"))
    return rows.select(*keys, RANGE, PLACE, *columns, F.lit(False).alias("halo")).unionByName(halo)


def joined(rows: DataFrame, totals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each row with its group's and range's row of totals; null keys meet too."""
    names = [*keys, RANGE]
    other = totals.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(names)], *[c for c in totals.columns if c not in names])
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(names)]
    return rows.join(other, on).drop(*[f"__k{i}" for i in range(len(names))])


def unranged(df: DataFrame) -> DataFrame:
    return df.drop(RANGE, PLACE)
