"""What the quality classifier's training collects."""

from pyspark.sql import functions as F

from boxloom.llm import quality as ql

from . import fixtures as fx


def test_repeated_ids_are_one_row_before_the_collect(spark, monkeypatch):
    data = [(7, f"text number {i} of one id") for i in range(40)] + [(i, f"other words {i}") for i in range(100, 110)]
    labels = spark.createDataFrame([(7, 1)] + [(i, i % 2) for i in range(100, 110)], "doc_id long, quality int")
    chosen = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("label"))
    assert ql.labelled_rows(fx.table(spark, data), chosen, "doc_id", "text").count() == 11
    learnt = []
    monkeypatch.setattr(ql, "fit", learnt.append)
    for rows in (data, data[::-1]):
        ql.train_quality(fx.table(spark, rows), labels, F.lit(True))
    assert len(learnt[0]) == 11 and learnt[0] == learnt[1]
