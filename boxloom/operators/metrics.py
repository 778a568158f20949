"""Detection metrics. Everything is an aggregate or a window over predictions, ground truth and their matches."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import geometry as g
from ..tables import stored
from . import folds
from .scans import PLACE, RANGE, best_from_here, in_ranges, running


CORNERS = ("x1", "y1", "x2", "y2")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def f1(p: Column, r: Column) -> Column:
    return ratio(2 * p * r, p + r)


def marked_predictions(det: DataFrame, matches: DataFrame) -> DataFrame:
    """The predictions with ``tp`` (1 or 0)."""
    hit = matches.select("det_id", F.lit(1).alias("tp"))
    return det.join(hit, "det_id", "left").withColumn("tp", F.coalesce("tp", F.lit(0)))


def marked_truth(gt: DataFrame, matches: DataFrame) -> DataFrame:
    """The ground truth with ``found`` (1 or 0)."""
    hit = matches.select("gt_id", F.lit(1).alias("found"))
    return gt.join(hit, "gt_id", "left").withColumn("found", F.coalesce("found", F.lit(0)))


def counts_by(det: DataFrame, gt: DataFrame, matches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n_pred, n_gt, tp over all keys of either side; one aggregate on the union of the three."""
    part = lambda df, name: df.select(*keys, *[F.lit(1 if n == name else 0).cast("long").alias(n) for n in ("n_pred", "n_gt", "tp")])
    every = part(det, "n_pred").unionByName(part(gt, "n_gt")).unionByName(part(matches, "tp"))
    return every.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in ("n_pred", "n_gt", "tp")])


def with_rates(counts: DataFrame) -> DataFrame:
    """fp, fn, precision, recall, f1 from n_pred, n_gt, tp."""
    c = counts.withColumns({"fp": F.col("n_pred") - F.col("tp"), "fn": F.col("n_gt") - F.col("tp"), "precision": ratio(F.col("tp"), F.col("n_pred")), "recall": ratio(F.col("tp"), F.col("n_gt"))})
    return c.withColumn("f1", f1(F.col("precision"), F.col("recall")))


def image_metrics(det, gt, matches) -> DataFrame:
    return with_rates(counts_by(det, gt, matches, ["image_id"]))


def category_metrics(det, gt, matches) -> DataFrame:
    return with_rates(counts_by(det, gt, matches, ["category_id"]))


def overall_metrics(det, gt, matches) -> DataFrame:
    return with_rates(category_metrics(det, gt, matches).agg(*[F.sum(n).alias(n) for n in ("n_pred", "n_gt", "tp")]))


def macro_micro(det, gt, matches) -> DataFrame:
    """Means over images of precision, recall, F1 and precision times recall, and the totals' rates."""
    i = image_metrics(det, gt, matches)
    t = i.agg(
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), F.avg(F.col("precision") * F.col("recall")).alias("macro_ap"),
        *[F.sum(n).alias(n) for n in ("n_pred", "n_gt", "tp")],
    )
    keep = ["macro_precision", "macro_recall", "macro_f1", "macro_ap"]
    return with_rates(t).select(*keep, F.col("precision").alias("micro_precision"), F.col("recall").alias("micro_recall"), F.col("f1").alias("micro_f1"))


def pr_curve(det: DataFrame, gt: DataFrame, matches: DataFrame) -> DataFrame:
    """Per category, by falling score: cumulative tp and fp, precision, recall (of the category's ground truth).

    A category may hold most rows: ranks and hits are running sums over ranges of its detections."""
    n = gt.groupBy("category_id").agg(F.count(F.lit(1)).alias("n_gt"))
    p = marked_predictions(det, matches).select("category_id", "det_id", "score", "tp")
    c = running(in_ranges(p, ["category_id"], [F.desc("score"), "det_id"]), ["category_id"], {"ctp": F.col("tp"), "rank": F.lit(1)})
    c = c.join(F.broadcast(n), "category_id", "left")  # one row a category
    c = c.select("category_id", "det_id", "score", "n_gt", "ctp", "rank", RANGE, PLACE)
    return c.withColumns({"precision": F.col("ctp") / F.col("rank"), "recall": F.coalesce(F.col("ctp") / F.col("n_gt"), F.lit(0.0))})


def precision_envelope(curve: DataFrame) -> DataFrame:
    """Column envelope: the best precision at this rank or later, from the other end of the curve's ranges."""
    return best_from_here(curve, ["category_id"], "envelope", F.col("precision"))


def interpolated_ap(curve: DataFrame, gt: DataFrame, det: DataFrame, points: Sequence[float] = tuple(i * 0.1 for i in range(11))) -> DataFrame:
    """category_id, ap: the mean over the recall points of the best precision at that recall or more.

    Categories of either side appear; those without predictions have 0. One aggregate with a column for each point."""
    best = curve.groupBy("category_id").agg(*[F.coalesce(F.max(F.when(F.col("recall") >= F.lit(p), F.col("precision"))), F.lit(0.0)).alias(f"p{i}") for i, p in enumerate(points)])
    total = sum((F.col(f"p{i}") for i in range(1, len(points))), F.col("p0"))
    ids = gt.select("category_id").union(det.select("category_id")).distinct()
    return ids.join(best.select("category_id", (total / len(points)).alias("ap")), "category_id", "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))


#: Confidence bins of false positives: least and below, highest first.
BINS = ((0.9, 1.01), (0.8, 0.9), (0.7, 0.8), (0.6, 0.7), (0.5, 0.6), (0.4, 0.5), (0.3, 0.4), (0.25, 0.3))
#: Thresholds of the sweep.
SWEEP = (0.25, 0.3, 0.35, 0.39999999999999997, 0.44999999999999996, 0.49999999999999994, 0.5499999999999999, 0.5999999999999999, 0.6499999999999999, 0.7, 0.7499999999999998, 0.7999999999999998, 0.8499999999999999, 0.8999999999999999, 0.9499999999999997)


def fp_confidence_hist(marked: DataFrame) -> DataFrame:
    """bin, n for every bin, empty ones too."""
    fp = marked.where("tp = 0")
    one = fp.agg(*[F.count_if((F.col("score") >= lo) & (F.col("score") < hi)).alias(f"b{i}") for i, (lo, hi) in enumerate(BINS)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(lo).alias("low"), F.col(f"b{i}").alias("n")) for i, (lo, _) in enumerate(BINS)])).alias("r")).select("r.*")


def fn_size_dist(truth: DataFrame) -> DataFrame:
    """bucket, n of the ground truth not found, empty buckets too."""
    bucket = g.area_bucket(g.area(g.box()))
    one = truth.where("found = 0").agg(*[F.count_if(bucket == b).alias(b) for b in ("small", "medium", "large")])
    return one.select(F.explode(F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(b).alias("n")) for b in ("small", "medium", "large")])).alias("r")).select("r.*")


def threshold_sweep(marked: DataFrame, thresholds: Sequence[float] = SWEEP) -> DataFrame:
    """threshold, tp, fp, precision, best (the first of the most precise). One pass for all thresholds."""
    aggs = [x for i, th in enumerate(thresholds) for x in (F.sum(F.when(F.col("score") >= F.lit(th), F.col("tp")).otherwise(0)).alias(f"t{i}"), F.count_if(F.col("score") >= F.lit(th)).alias(f"n{i}"))]
    items = F.array(*[F.struct(F.lit(th).alias("threshold"), F.coalesce(F.col(f"t{i}"), F.lit(0)).alias("tp"), (F.col(f"n{i}") - F.coalesce(F.col(f"t{i}"), F.lit(0))).alias("fp")) for i, th in enumerate(thresholds)])
    rates = F.transform(items, lambda r: F.struct(r["threshold"].alias("threshold"), r["tp"].alias("tp"), r["fp"].alias("fp"), ratio(r["tp"], r["tp"] + r["fp"]).alias("precision")))
    d = marked.agg(*aggs).select(rates.alias("r"))
    best = F.array_min(F.transform("r", lambda r: F.struct((-r["precision"]).alias("p"), r["threshold"].alias("t"))))
    return d.select("r", best.alias("best")).select("r", F.col("best.t").alias("b")).select(F.explode("r").alias("x"), "b").select("x.*", (F.col("x.threshold") == F.col("b")).alias("best"))


def top_by(df: DataFrame, column: str, n: int, ties: str, descending: bool = True) -> DataFrame:
    order = F.desc(column) if descending else F.asc(column)
    return df.orderBy(order, ties).limit(n)


#: The settings of the COCO protocol: IoU thresholds, area ranges (least and most square pixels), detections an image.
COCO_IOU = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
COCO_AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
COCO_MAX = (1, 10, 100)
#: The summary figures: name, whether AP (else AR), IoU threshold (None: all), area, detections an image.
COCO_SUMMARY = (
    ("AP", True, None, "all", 100), ("AP50", True, 0.5, "all", 100), ("AP75", True, 0.75, "all", 100),
    ("AP_small", True, None, "small", 100), ("AP_medium", True, None, "medium", 100), ("AP_large", True, None, "large", 100),
    ("AR1", False, None, "all", 1), ("AR10", False, None, "all", 10), ("AR100", False, None, "all", 100),
    ("AR_small", False, None, "small", 100), ("AR_medium", False, None, "medium", 100), ("AR_large", False, None, "large", 100),
)


def coco_marks(det: DataFrame, gt: DataFrame, thresholds: Sequence[float] = COCO_IOU, areas: Mapping[str, tuple[float, float]] = COCO_AREAS, most: int = max(COCO_MAX)) -> DataFrame:
    """What each detection is by the COCO protocol: category_id, det_id, score, rank (in its image and class), and as bits,
    one for each area range and, within it, threshold: hit, ignored.

    Detections of an image and class, the best ``most`` by score, take in turn the free ground truth that they overlap most,
    one that counts before an ignored one: a crowd (column iscrowd, default 0), which several may take and whose overlap is
    of the detection's own area, or a box outside the area range (column area, default the box's). What takes an ignored
    one, or takes nothing and lies outside the range itself, is ignored. Both sides meet sorted by image and class, and the
    overlaps are computed once for all settings.
    """
    keys = ["image_id", "category_id"]
    own = lambda df: F.coalesce("area", g.area(g.box())) if "area" in df.columns else g.area(g.box())
    corners = [F.col(c).cast("double").alias(c) for c in CORNERS]
    crowd = F.coalesce("iscrowd", F.lit(0)) == 1 if "iscrowd" in gt.columns else F.lit(False)
    truth = gt.dropna(subset=keys).select(*keys, F.lit(0).alias("kind"), F.col("gt_id").alias("id"), F.lit(None).cast("double").alias("score"), *corners, own(gt).cast("double").alias("area"), crowd.alias("crowd"))
    found = det.select(*keys, F.lit(1).alias("kind"), F.col("det_id").alias("id"), F.col("score").cast("double").alias("score"), *corners, g.area(g.box()).cast("double").alias("area"), F.lit(False).alias("crowd"))
    w = Window.partitionBy(*keys, "kind").orderBy(F.desc("score"), "id")
    both = folds.dealt(truth.unionByName(found), *keys).withColumn("rank", F.row_number().over(w)).where((F.col("kind") == 0) | (F.col("rank") <= most))
    levels, ranges = np.array([float(t) for t in thresholds]), [(float(lo), float(hi)) for lo, hi in areas.values()]

    def fold(table, starts):
        _, group, _ = folds.numbered(starts, table.num_rows)
        kind, rank = table["kind"].to_numpy(), table["rank"].to_numpy()
        box, lack = folds.doubles(table, CORNERS)
        (size,), _ = folds.doubles(table, ["area"])
        is_crowd = table["crowd"].to_numpy()
        gts, dets = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
        n = np.bincount(group[gts], minlength=len(starts))
        each = n[group[dets]]  # ground truth that a detection meets
        d = np.repeat(dets, each)
        t = gts[np.arange(len(d)) + np.repeat((np.cumsum(n) - n)[group[dets]] - (np.cumsum(each) - each), each)]
        inter, apart = folds.intersection(box[:, d], box[:, t]), lack[d] | lack[t]
        over = folds.ratio(inter, np.where(is_crowd[t], folds.area(box[:, d]), folds.area(box[:, d]) + folds.area(box[:, t]) - inter), apart)
        near = over >= levels.min()
        d, t, over = d[near], t[near], over[near]
        hit, ignored = (np.zeros((len(kind), len(ranges), len(levels)), dtype=bool) for _ in range(2))
        for a, (lo, hi) in enumerate(ranges):
            out = ~((size >= lo) & (size <= hi))
            ignored[:, a] = out[:, None]
            out |= is_crowd
            # each detection's choices, best first: what counts, then by overlap; of equal overlaps the last
            order = np.lexsort((-t, -over, out[t], d, rank[d]))
            do, to, fits = d[order], t[order], over[order, None] >= levels
            taken = np.zeros((len(kind), len(levels)), dtype=bool)
            cuts = np.append(np.flatnonzero(np.diff(rank[do], prepend=-1)), len(do))
            for i, j in zip(cuts, cuts[1:]):  # the detections of a rank, in all images and classes
                dr, tr = do[i:j], to[i:j]
                free = fits[i:j] & (is_crowd[tr, None] | ~taken[tr])
                heads = np.flatnonzero(np.diff(dr, prepend=-1))
                first = np.minimum.reduceat(np.where(free, np.arange(j - i)[:, None], j - i), heads, axis=0)
                row, level = np.nonzero(first < j - i)
                got, taker = tr[first[row, level]], dr[heads][row]
                taken[got, level] = True
                hit[taker, a, level], ignored[taker, a, level] = ~out[got], out[got]
        flat = lambda x: folds.binary(x[dets].reshape(len(dets), -1))
        some = table.take(pa.array(dets))
        return pa.table([some["category_id"], some["id"], some["score"], some["rank"], flat(hit), flat(ignored)], names=["category_id", "det_id", "score", "rank", "hit", "ignored"])

    kinds = {f.name: f.dataType.simpleString() for f in both.schema}
    return folds.folded(both, keys, ["kind", F.desc("score"), "id"], fold, f"category_id {kinds['category_id']}, det_id {kinds['id']}, score double, rank int, hit binary, ignored binary")


def coco_evaluation(det: DataFrame, gt: DataFrame, thresholds: Sequence[float] = COCO_IOU, areas: Mapping[str, tuple[float, float]] = COCO_AREAS, most: Sequence[int] = COCO_MAX) -> DataFrame:
    """area, max_dets, iou_threshold, category_id, ap, ar by the COCO protocol: AP over 101 recall points and the recall
    reached, of each category that has ground truth in the area range; without detections both are 0.

    Detections are sorted once for all settings, a row each, by ranges of the category and score. The driver gets the hits
    and the number of detections of each category and range, by setting, and the tasks what lies before their range."""
    size = F.coalesce("area", g.area(g.box())) if "area" in gt.columns else g.area(g.box())
    crowd = F.coalesce("iscrowd", F.lit(0)) == 1 if "iscrowd" in gt.columns else F.lit(False)
    counts = gt.where(~crowd).groupBy("category_id").agg(*[F.count_if((size >= float(lo)) & (size <= float(hi))).alias(n) for n, (lo, hi) in areas.items()])
    counts = stored(counts)
    truth = {r["category_id"]: [r[n] for n in areas] for r in counts.collect()}  # a row a category
    counts = counts.select("category_id", F.explode(F.array(*[F.struct(F.lit(n).alias("area"), F.col(n).alias("n_gt")) for n in areas])).alias("c")).select("category_id", "c.*").where("n_gt > 0")
    settings = counts.select("*", F.explode(F.array(*[F.lit(m) for m in most])).alias("max_dets")).select("*", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])).alias("iou_threshold"))
    marks = coco_marks(det, gt, thresholds, areas, max(most)).where("category_id is not null")
    rows = in_ranges(marks, ["category_id"], [F.desc("score"), "det_id"]).select("category_id", RANGE, PLACE, "rank", "hit", "ignored")
    names, levels = list(areas), [float(t) for t in thresholds]
    shape = (len(most), len(names) * len(levels))

    def parts(batches):
        """(category, range), and of each row and setting whether it is a hit and whether it counts."""
        for batch in batches:
            if batch.num_rows:
                table = pa.Table.from_batches([batch])
                starts = folds.group_starts(table, ["category_id", RANGE])
                hit, counts_ = folds.bits(batch.column("hit"), shape[1]), ~folds.bits(batch.column("ignored"), shape[1])
                rank, ids, ranges = batch.column("rank").to_numpy(), batch.column("category_id"), batch.column(RANGE)
                for i, j in zip(starts, np.append(starts[1:], batch.num_rows)):
                    yield (ids[int(i)].as_py(), ranges[int(i)].as_py()), rank[i:j], hit[i:j], counts_[i:j]

    def sums(batches):
        total: dict[tuple, np.ndarray] = {}
        for key, rank, hit, counted in parts(batches):
            own = total.setdefault(key, np.zeros((2, *shape), dtype=np.int64))
            for m, limit in enumerate(most):
                own[0, m] += hit[rank <= limit].sum(axis=0)
                own[1, m] += counted[rank <= limit].sum(axis=0)
        columns = ([c for c, _ in total], category), ([at for _, at in total], pa.int64()), ([v.ravel() for v in total.values()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(*x) for x in columns], names=["category_id", "range", "sums"])

    category, kind = to_arrow_type(rows.schema["category_id"].dataType), rows.schema["category_id"].dataType.simpleString()
    totals: dict[tuple, np.ndarray] = {}
    for r in rows.mapInArrow(sums, f"category_id {kind}, range long, sums array<long>").collect():
        key = (r["category_id"], r["range"])
        totals[key] = totals.get(key, 0) + np.array(r["sums"], dtype=np.int64).reshape(2, *shape)
    before, running_sum = {}, {}
    for c, at in sorted(totals, key=lambda k: k[1]):
        before[c, at] = running_sum.get(c, np.zeros((2, *shape), dtype=np.int64))
        running_sum[c] = before[c, at] + totals[c, at]
    carried = rows.sparkSession.sparkContext.broadcast(before)

    def best_precisions(batches):
        """Of each category and range: the best precision from each recall point on, and the recall reached."""
        now, base, best, reached, points = None, None, None, None, None

        def given():
            out = [(now[0], names[s // len(levels)], most[m], levels[s % len(levels)], best[m, s], reached[m, s]) for m in range(shape[0]) for s in range(shape[1]) if points[s // len(levels)] is not None]
            columns = list(zip(*out)) or [[]] * 6
            types = (category, pa.string(), pa.int32(), pa.float64(), pa.list_(pa.float64()), pa.float64())
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types)], names=["category_id", "area", "max_dets", "iou_threshold", "p", "ar"])

        for key, rank, hit, counted in parts(batches):
            if key != now:
                if now:
                    yield given()
                now, base = key, carried.value[key].copy()
                best, reached = np.zeros((*shape, 101)), np.zeros(shape)
                points = [hits_needed(n) if n else None for n in truth.get(key[0], [0] * len(names))]
            for m, limit in enumerate(most):
                some = rank <= limit
                if not some.any():
                    continue
                hits, places = (base[k, m] + np.cumsum(x[some], axis=0) for k, x in enumerate((hit, counted)))
                base[0, m], base[1, m] = hits[-1], places[-1]
                precision = hits / np.maximum(places, 1)
                later = np.maximum.accumulate(precision[::-1], axis=0)[::-1]
                for s in range(shape[1]):
                    if (needed := points[s // len(levels)]) is not None:
                        at = np.searchsorted(hits[:, s], needed)
                        ok = at < len(hits)
                        best[m, s, ok] = np.maximum(best[m, s, ok], later[at[ok], s])
                        reached[m, s] = hits[-1, s] / truth[now[0]][s // len(levels)]
        if now:
            yield given()

    keys = ["area", "max_dets", "iou_threshold", "category_id"]
    ordered = folds.dealt(rows, RANGE).sortWithinPartitions(RANGE, PLACE)
    best = ordered.mapInArrow(best_precisions, f"category_id {kind}, area string, max_dets int, iou_threshold double, p array<double>, ar double")
    best = best.groupBy(*keys).agg(F.max("ar").alias("ar"), *[F.max(F.get("p", F.lit(i))).alias(f"p{i}") for i in range(101)])
    total = F.aggregate(F.array(*[F.col(f"p{i}") for i in range(101)]), F.lit(0.0), lambda s, p: s + p)
    out = settings.join(best.select(*keys, (total / 101).alias("ap"), "ar"), keys, "left")
    return out.select("area", "max_dets", "iou_threshold", "category_id", F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("ar", F.lit(0.0)).alias("ar"))


def hits_needed(n: int) -> np.ndarray:
    """For each recall point the least number of hits, of n, that reaches it in doubles."""
    points = np.arange(101) / 100
    least = np.maximum(np.floor(points * n).astype(np.int64) - 1, 0)
    for _ in range(3):
        least = np.where(least / n >= points, least, least + 1)
    return least


def coco_summary(evaluation: DataFrame) -> DataFrame:
    """metric, value: the twelve figures; null where no category has ground truth of the area."""
    one = evaluation.agg(*[
        F.avg(F.when((F.col("area") == area) & (F.col("max_dets") == most) & (F.lit(True) if at is None else F.col("iou_threshold") == at), F.col("ap" if ap else "ar"))).alias(name)
        for name, ap, at, area, most in COCO_SUMMARY
    ])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n, *_ in COCO_SUMMARY])).alias("m")).select("m.*")
