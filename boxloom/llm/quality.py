"""Quality classifier: Naive Bayes support vectors (Wang and Manning, 2012).

n-gram indicators are scaled by the classes' log-count ratios; a linear hinge-loss model on the scaled indicators is
fitted by dual coordinate descent (Hsieh et al., 2008), with a cost per class that evens out their sizes. The margin
becomes a probability by a logistic curve fitted on out-of-fold margins (Platt).

n-grams: words; and 1- to 3-grams of word shapes, where letters collapse to x or X, digits to 0, other characters stay
and a word equal to its predecessor reads "=". The shapes carry over to words never seen.

The model is fitted on at most ``max_rows`` labelled rows, those least by a hash of the id; a row's features are a set,
so long texts add each n-gram once. Scores cover every row and whole texts.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, released, shuffle_partitions

RUNS = ((re.compile(r"[^\W\d_]+"), lambda m: ("X" if m[0].isupper() and len(m[0]) > 1 else "x")), (re.compile(r"\d+"), lambda m: "0"), (re.compile(r"(.)\1+"), lambda m: m[1] * 2))


class Shapes(dict):
    """The shape of a word; a bounded cache."""

    def __missing__(self, word: str) -> str:
        if len(self) > 300_000:
            self.clear()
        shape = word
        for pattern, by in RUNS:
            shape = pattern.sub(by, shape)
        self[word] = shape
        return shape


def ngrams(text: str, shapes: Shapes) -> tuple[set[str], set[tuple[str, ...]]]:
    """The words and the shape n-grams of a text."""
    words = text.split()
    s = ["=" if a == b else shapes[a] for a, b in zip(words, [None, *words])]
    return set(words), {*zip(s), *zip(s, s[1:]), *zip(s, s[1:], s[2:])}


@dataclass
class QualityModel:
    words: dict[str, float] = field(default_factory=dict)
    shapes: dict[tuple[str, ...], float] = field(default_factory=dict)
    bias: float = 0.0
    slope: float = 0.0
    shift: float = 0.0

    def margin(self, words: set, shapes: set) -> float:
        w, s = self.words, self.shapes
        total = sum([w[x] for x in words if x in w]) + sum([s[x] for x in shapes if x in s])
        return total / math.sqrt(max(1, len(words) + len(shapes))) + self.bias

    def score(self, words: set, shapes: set) -> float:
        z = self.slope * self.margin(words, shapes) + self.shift
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, epochs: int = 12, seed: int = 7) -> np.ndarray:
    """Weights of the linear hinge-loss model over sparse rows of (columns, values); L1 loss, per-row cost."""
    w, alpha = np.zeros(size), np.zeros(len(rows))
    norm = [float(v @ v) for _, v in rows]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            cols, vals = rows[i]
            if norm[i] == 0:
                continue
            g = y[i] * float(w[cols] @ vals) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            if new != alpha[i]:
                w[cols] += (new - alpha[i]) * y[i] * vals
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4:
            break
    return w


def platt(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve through the margins, by Newton steps on smoothed targets."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = np.abs(margins).max() or 1.0
    x = np.stack([margins / scale, np.ones(len(margins))], axis=1)
    a = np.array([0.0, math.log((pos + 1) / (neg + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -60, 60)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2), x.T @ (p - t) + 1e-6 * a)
        a = a - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return max(a[0], 0.0) / scale, a[1]


def fit(samples: list[tuple[set, set, int]], min_rows: int = 2, smooth: float = 1.0, cost: float = 1.0, folds: int = 4) -> QualityModel:
    """The model of (words, shape n-grams, label 0 or 1) samples. n-grams in fewer than min_rows samples are left out."""
    labels = np.array([s[2] for s in samples])
    if len(set(labels.tolist())) < 2:  # nothing to tell apart: the only label, or an even chance
        return QualityModel(shift=0.0 if not len(labels) else math.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1)))
    seen = Counter(x for s in samples for part in s[:2] for x in part)
    names = sorted((x for x, n in seen.items() if n >= min_rows), key=repr)
    at = {x: i for i, x in enumerate(names)}
    cols = [np.array(sorted(at[x] for part in s[:2] for x in part if x in at), dtype=np.int64) for s in samples]
    norm = [1 / math.sqrt(max(1, len(s[0]) + len(s[1]))) for s in samples]
    y = np.where(labels == 1, 1.0, -1.0)

    def train(own: np.ndarray) -> tuple[np.ndarray, float]:
        p, q = np.full(len(names), smooth), np.full(len(names), smooth)
        for i in own:
            (p if y[i] > 0 else q)[cols[i]] += 1
        ratio = np.log((p / p.sum()) / (q / q.sum()))
        size = {1.0: max(1, (y[own] > 0).sum()), -1.0: max(1, (y[own] < 0).sum())}
        rows = [(np.append(cols[i], len(names)), np.append(ratio[cols[i]] * norm[i], 1.0)) for i in own]
        w = dual_coordinate_descent(rows, y[own], len(names) + 1, np.array([cost * len(own) / (2 * size[v]) for v in y[own]]))
        return w[:-1] * ratio, w[-1]

    index = np.arange(len(samples))
    out = np.zeros(len(samples))
    for k in range(folds):
        w, b = train(index[index % folds != k])
        for i in index[index % folds == k]:
            out[i] = w[cols[i]].sum() * norm[i] + b
    slope, shift = platt(out, y)
    w, b = train(index)
    weights = dict(zip(names, w.tolist()))
    return QualityModel({x: v for x, v in weights.items() if isinstance(x, str)}, {x: v for x, v in weights.items() if not isinstance(x, str)}, float(b), float(slope), float(shift))


def labelled_rows(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, label, text): one row for each chosen id. Of different texts under one id, that of the least hash counts."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")
    one = rows.groupBy("id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("least"))
    # few bytes, but much work for each row: not to be coalesced
    return one.select("id", "label", F.col("least.text").alias("text")).repartition(shuffle_partitions(docs.sparkSession))


def train_quality(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 3000) -> QualityModel:
    """Fit on at most ``max_rows`` labelled rows. ``usable`` says, by the labels' columns, which may be learnt from.

    Ids with contradictory labels, null ids and labels other than 0 and 1 are left out; repeated ids count once.
    """
    chosen = (
        labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & usable)
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.min(label_col).alias("label"), F.max(label_col).alias("high"))
        .where("label = high")
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_rows)
        .select("id", "label")
    )
    rows = labelled_rows(docs, chosen, id_col, text_col)

    def features(batches):
        shapes = Shapes()
        for batch in batches:
            found = [ngrams(t.as_py() or "", shapes) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").cast(pa.int64()), batch.column("label").cast(pa.int32()), pa.array([sorted(f[0]) for f in found], pa.list_(pa.string())), pa.array([["\0".join(x) for x in sorted(f[1])] for f in found], pa.list_(pa.string()))],
                names=["id", "label", "words", "shapes"],
            )

    table = rows.mapInArrow(released(features), "id long, label int, words array<string>, shapes array<string>").toArrow().sort_by([("id", "ascending")])
    return fit([(set(r["words"]), {tuple(x.split("\0")) for x in r["shapes"]}, r["label"]) for r in table.to_pylist()])  # max_rows sets of n-grams


def quality_score(spark: SparkSession, model: QualityModel, text: Column) -> Column:
    """The score (0 to 1) of a text. A null text is empty: no n-grams, the bias alone."""
    shared = spark.sparkContext.broadcast(vars(model))  # bounded by max_rows sets of n-grams

    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        shapes, own = Shapes(), QualityModel(**shared.value)
        for texts in batches:
            yield pd.Series([own.score(*ngrams(t or "", shapes)) for t in texts], dtype=float)

    return F.pandas_udf(score, "double")(text)


def quality_query(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, max_rows: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``; learns from rows that aren't held out."""
    model = train_quality(docs, labels, ~held_out("doc_id", 0), max_rows=max_rows)
    scored = docs.select("doc_id", held_out("doc_id", 0).alias("held_out"), quality_score(docs.sparkSession, model, F.col("text")).alias("score"))
    return scored.select("*", (F.col("score") >= threshold).cast("int").alias("predicted"))
