"""The store of answers: nothing answered is asked again, by a later run or by a task that is tried again."""

import os
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest

from boxloom.operators import answers as an


def counting(log, fail=lambda p: False, name="m"):
    """A model that writes down what it is asked."""

    def make():
        def model(prompts):
            for p in prompts:
                if fail(p):
                    raise ValueError(p)
            with open(log, "a") as f:
                f.writelines(f"{name} {p}\n" for p in prompts)
            return [f"{name}:{p}" for p in prompts]

        return model

    return make


def asked(log):
    return Counter(Path(log).read_text().splitlines()) if os.path.exists(log) else Counter()


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(i, None if i == 7 else f"p{i % 30}") for i in range(60)], "image_id long, prompt string").repartition(3)


def test_every_prompt_is_asked_once(spark, tmp_path, rows):
    store, log = an.AnswerStore(spark, str(tmp_path / "s")), tmp_path / "log"
    first = store.infer(rows.where("image_id < 20"), [("m", counting(log))], "image_id", "prompt", batch_size=4)
    assert {(r["image_id"], r["response"], r["success"], r["backend"]) for r in first.collect()} == {(i, f"m:p{i}", True, "m") for i in range(20) if i != 7} | {(7, None, False, "none")}
    every = store.infer(rows, [("m", counting(log))], "image_id", "prompt", batch_size=4)
    assert {(r["image_id"], r["response"]) for r in every.collect()} == {(i, None if i == 7 else f"m:p{i % 30}") for i in range(60)}
    assert asked(log) == Counter({f"m p{i}": 1 for i in range(30)})
    assert store.names("open") == []


def test_backends_and_failures(spark, tmp_path, rows):
    store, log = an.AnswerStore(spark, f"file://{tmp_path}/s"), tmp_path / "log"
    one, two = ("one", counting(log, lambda p: p.endswith("5"), "one")), ("two", counting(log, lambda p: p == "p15", "two"))
    got = {r["image_id"]: (r["response"], r["backend"]) for r in store.infer(rows, [one, two], "image_id", "prompt").collect()}
    assert got[4] == ("one:p4", "one") and got[5] == got[35] == ("two:p5", "two") and got[15] == (None, "none")
    before = asked(log)
    got = {r["image_id"]: r["backend"] for r in store.infer(rows, [one, ("two", counting(log, name="two"))], "image_id", "prompt").collect()}
    assert got[15] == "two" and asked(log) - before == Counter({"two p15": 1})  # only what had failed
    got = store.infer(rows, [("new", counting(log, name="new"))], "image_id", "prompt").collect()  # another model has answered nothing
    assert {r["backend"] for r in got if r["image_id"] != 7} == {"new"}


def test_an_attempt_reads_what_the_one_before_wrote(tmp_path):
    log, folder = tmp_path / "log", str(tmp_path / "open")
    batches = lambda: [pa.RecordBatch.from_arrays([pa.array([f"h{i}" for i in range(k, k + 10)]), pa.array([f"p{i}" for i in range(k, k + 10)])], names=["prompt_hash", "prompt"]) for k in (0, 10)]
    half = an.asking(folder, [("m", counting(log))], 3)(iter(batches()))
    next(half)  # the first batch is answered, then the task dies
    half.close()
    assert sum(asked(log).values()) == 10
    Path(folder, "0", "_half.parquet").write_bytes(b"cut off")
    assert [b.num_rows for b in an.asking(folder, [("m", counting(log))], 3)(iter(batches()))] == [0, 0]
    assert asked(log) == Counter({f"m p{i}": 1 for i in range(20)})


def test_a_run_that_dies_is_settled_by_the_next(spark, tmp_path, rows):
    store, log = an.AnswerStore(spark, str(tmp_path / "s")), tmp_path / "log"
    an.OpenFiles(f"{store.path}/open/dead/3").add([(__import__("hashlib").sha256(b"p1").hexdigest(), "m", "m:p1")])
    store.infer(rows, [("m", counting(log))], "image_id", "prompt").collect()
    assert asked(log)["m p1"] == 0 and asked(log)["m p2"] == 1


RETRY = """
import os, sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
from boxloom.operators.answers import AnswerStore
spark = SparkSession.builder.master("local[2,4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
def make():
    n = [0]
    def model(prompts):
        n[0] += 1
        if n[0] == 4 and not os.path.exists({mark!r}):
            open({mark!r}, "w").close()
            os._exit(1)  # the worker dies in its fourth batch
        with open({log!r}, "a") as f:
            f.writelines(p + "\\n" for p in prompts)
        return [p.upper() for p in prompts]
    return model
df = spark.range(60).selectExpr("id", "concat('p', id) AS prompt")
rows = AnswerStore(spark, {store!r}).infer(df, [("m", make)], "id", "prompt", batch_size=5).collect()
assert sorted(r["response"] for r in rows) == sorted(f"P{{i}}" for i in range(60))
"""


def test_a_retried_task_asks_for_no_answered_row(tmp_path):
    code = RETRY.format(repo=str(Path(__file__).resolve().parent.parent), mark=str(tmp_path / "mark"), log=str(tmp_path / "log"), store=str(tmp_path / "store"))
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, timeout=300)
    assert (tmp_path / "mark").exists() and asked(tmp_path / "log") == Counter({f"p{i}": 1 for i in range(60)})


def test_fast_answers_share_files(tmp_path):
    """A file for each batch of a fast model would be as many files as batches."""
    import pyarrow as pa

    from boxloom.operators import answers as an

    rows = pa.RecordBatch.from_pydict({"prompt_hash": [str(i) for i in range(640)], "prompt": ["p"] * 640})
    run = an.asking(str(tmp_path), [("m", lambda: lambda prompts: list(prompts))], 16)
    assert sum(b.num_rows for b in run(iter([rows]))) == 0
    assert len(an.OpenFiles(f"{tmp_path}/0").known()) == 640
    assert len(list((tmp_path / "0").iterdir())) <= 10  # 40 before
