"""User models over tables. A model is a function of a list of inputs that returns a list of outputs; it is made once
in each Python worker, by a factory."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Model = Callable[[list[str]], list[str]]


def infer_batches(df: DataFrame, make_model: Callable[[], Model], key: str, prompt: str, batch_size: int = 16) -> DataFrame:
    """key, response, success, error, duration_seconds. A batch that fails is tried row by row, so that bad rows become
    error rows and no others do; a row's time is its batch's time by its size. Nulls are error rows."""

    def run(batches):
        model = make_model()
        for batch in batches:
            keys, prompts = batch.column(0), batch.column(1).to_pylist()
            out: dict[str, list] = {"response": [], "error": [], "duration_seconds": []}
            for at in range(0, len(prompts), batch_size):
                some = prompts[at : at + batch_size]
                began = time.perf_counter()
                try:
                    if None in some:
                        raise ValueError("no prompt")
                    got = [(r, None) for r in model(some)]
                except Exception:
                    got = []
                    for p in some:
                        try:
                            got.append((model([p])[0], None) if p is not None else (None, "no prompt"))
                        except Exception as e:  # noqa: BLE001 - the model is foreign code; its failures are data here
                            got.append((None, f"{type(e).__name__}: {e}"))
                each = (time.perf_counter() - began) / len(some)
                for response, error in got:
                    for name, x in zip(out, (response, error, each)):
                        out[name].append(x)
            yield pa.RecordBatch.from_arrays([keys, pa.array(out["response"], pa.string()), pa.array([e is None for e in out["error"]]), pa.array(out["error"], pa.string()), pa.array(out["duration_seconds"], pa.float64())], names=[key, "response", "success", "error", "duration_seconds"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(prompt).alias("prompt")).mapInArrow(run, f"{key} {kind}, response string, success boolean, error string, duration_seconds double")


FAILED = object()


def answered(model: Model, prompts: list) -> list:
    """The model's answers to all prompts at once. If it fails, each half is asked alone, down to the prompts that fail."""
    if not prompts:
        return []
    try:
        return list(model(prompts))
    except Exception:  # noqa: BLE001 - a failed prompt is the next backend's
        half = len(prompts) // 2
        return [*answered(model, prompts[:half]), *answered(model, prompts[half:])] if half else [FAILED]


def infer_with_fallback(df: DataFrame, backends: Sequence[tuple[str, Callable[[], Model]]], key: str, prompt: str) -> DataFrame:
    """key, response, success, backend: the first backend, in order, that answers a row; none if all fail.
    A backend gets all rows of a batch that are left at once, and only what failed goes to the next."""

    def run(batches):
        models = [(name, make()) for name, make in backends]
        for batch in batches:
            prompts = batch.column(1).to_pylist()
            rows, left = [(None, "none")] * len(prompts), list(range(len(prompts)))
            for name, model in models:
                answers = answered(model, [prompts[i] for i in left])
                for i, a in zip(left, answers):
                    if a is not FAILED:
                        rows[i] = (a, name)
                left = [i for i, a in zip(left, answers) if a is FAILED]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r for r, _ in rows], pa.string()), pa.array([b != "none" for _, b in rows]), pa.array([b for _, b in rows], pa.string())], names=[key, "response", "success", "backend"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, F.col(prompt).alias("prompt")).mapInArrow(run, f"{key} {kind}, response string, success boolean, backend string")


def map_labels_zero_shot(df: DataFrame, label: str, candidates: Sequence[str], score, threshold: float = 0.5, placeholder: str = "other") -> DataFrame:
    """The input with ``mapped``: the best candidate if its score is above the threshold, else the placeholder.

    ``score`` is a pandas UDF of two text columns, called for distinct labels only; blank labels get the placeholder."""
    names = df.select(F.col(label).alias("__l")).where("trim(coalesce(__l, '')) <> ''").distinct()
    pairs = names.select("__l", F.explode(F.array(*[F.lit(c) for c in candidates])).alias("__c")).withColumn("__s", score("__l", "__c"))
    best = pairs.groupBy("__l").agg(F.min(F.struct((-F.col("__s")).alias("s"), F.col("__c").alias("c"))).alias("b"))
    mapped = best.select("__l", F.when(-F.col("b.s") > threshold, F.col("b.c")).otherwise(placeholder).alias("mapped"))
    return df.join(mapped, df[label] == mapped["__l"], "left").drop("__l").withColumn("mapped", F.coalesce("mapped", F.lit(placeholder)))
