"""Counts and summaries of runs, batches, backends and datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def id_stats(df: DataFrame, original: Column, mapped: Column) -> DataFrame:
    """kind, id, n with each kind's min_id, max_id and n_ids."""
    both = df.select(F.explode(F.array(F.struct(F.lit("original").alias("kind"), original.cast("int").alias("id")), F.struct(F.lit("mapped").alias("kind"), mapped.cast("int").alias("id")))).alias("x"))
    w = Window.partitionBy("kind")
    n = both.groupBy("x.kind", "x.id").agg(F.count(F.lit(1)).alias("n"))
    return n.select("kind", "id", "n", F.min("id").over(w).alias("min_id"), F.max("id").over(w).alias("max_id"), F.count(F.lit(1)).over(w).alias("n_ids"))


def coverage(gt: DataFrame, det: DataFrame) -> DataFrame:
    """Numbers of images in both, in the ground truth and in the results."""
    s = gt.select("image_id", F.lit(True).alias("a"), F.lit(False).alias("b")).union(det.select("image_id", F.lit(False), F.lit(True)))
    i = s.groupBy("image_id").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return i.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if("a").alias("n_gt"), F.count_if("b").alias("n_det"))


def batch_summary(results: DataFrame) -> DataFrame:
    """images, ok, failed, objects of a table with success and n_objects."""
    return results.agg(F.count(F.lit(1)).alias("images"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.coalesce(F.sum(F.when(F.col("success"), F.col("n_objects"))), F.lit(0)).alias("objects"))


def performance_summary(runs: DataFrame) -> DataFrame:
    """Success rate, backends, durations and tokens a second of the successful runs."""
    ok = F.when(F.col("success"), F.col("seconds"))
    tps = F.when(F.col("success") & (F.col("tokens_per_second") > 0), F.col("tokens_per_second"))
    return runs.agg(
        F.avg(F.col("success").cast("int")).alias("success_rate"), F.array_join(F.array_sort(F.collect_set("backend")), ",").alias("backends"),
        F.avg(ok).alias("avg_s"), F.min(ok).alias("min_s"), F.max(ok).alias("max_s"), F.median(ok).alias("median_s"), F.avg(tps).alias("avg_tps"), F.median(tps).alias("median_tps"),
    )


def batch_statistics(runs: DataFrame) -> DataFrame:
    """Tokens a second: mean, median, min, max, sample deviation; images a minute; tokens over all time."""
    tps = F.col("tokens_per_second")
    return runs.where("success").agg(
        F.avg(tps).alias("mean_tps"), F.median(tps).alias("median_tps"), F.min(tps).alias("min_tps"), F.max(tps).alias("max_tps"), F.coalesce(F.stddev_samp(tps), F.lit(0.0)).alias("stdev_tps"),
        (F.count(F.lit(1)) / F.sum("seconds") * 60).alias("images_per_minute"), (F.sum("tokens") / F.sum("seconds")).alias("throughput"),
    )


def method_benchmark(runs: DataFrame, method: str = "backend") -> DataFrame:
    return runs.groupBy(method).agg(F.avg("seconds").alias("avg_s"), F.min("seconds").alias("min_s"), F.max("seconds").alias("max_s"), F.count(F.lit(1)).alias("n"))


def compare_backends(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Both backends' labels of each object, and whether they agree (null labels don't)."""
    j = a.select(key, F.col("label").alias("label_a")).join(b.select(key, F.col("label").alias("label_b")), key, "full")
    return j.withColumn("agree", F.coalesce(F.col("label_a") == F.col("label_b"), F.lit(False)))


def region_groups(regions: DataFrame) -> DataFrame:
    """Regions with an id within their image and kind (face_0 ...) and the number of the kind in the image."""
    w = Window.partitionBy("image_id", "kind")
    return regions.select("image_id", "kind", "det_id", F.concat(F.col("kind"), F.lit("_"), (F.row_number().over(w.orderBy("det_id")) - 1).cast("string")).alias("region_id"), F.count(F.lit(1)).over(w).alias("n_kind"))


def active_classes(rows: DataFrame) -> DataFrame:
    """The sorted classes in use, without -1, and an 80-slot mask of them."""
    ids = F.array_sort(F.collect_set(F.when(F.col("category_id") >= 0, F.col("category_id"))))
    return rows.agg(ids.alias("ids")).select(F.array_join("ids", ",").alias("classes"), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(79)), lambda i: F.array_contains("ids", i).cast("int")), "").alias("mask"))
