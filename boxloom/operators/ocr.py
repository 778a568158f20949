"""Recognised text: lines to blocks, pages to documents, structured answers to rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.taxonomy import stripped

KIND_ORDER = ("header", "text", "table", "formula", "list")


def line_kind(text: Column) -> Column:
    """header, table, formula, list or text of a stripped line that isn't blank."""
    bars = F.length(text) - F.length(F.replace(text, F.lit("|"), F.lit("")))
    return (
        F.when(text.startswith("#"), "header").when(bars >= 2, "table").when(text.contains("$") | text.rlike("[∑∫√±≤≥]"), "formula")
        .when(text.rlike(r"^[-*+]") | text.rlike(r"^[0-9]\.."), "list").otherwise("text")
    )


def ocr_blocks(lines: DataFrame) -> DataFrame:
    """Lines (doc, line_no, text) to blocks: doc, kind, position (first line), content, level (of headers).

    Runs of text, table and list lines are one block; each header and formula is its own. Blank lines part nothing."""
    rows = lines.withColumn("text", stripped(F.col("text"))).where("text <> ''").withColumn("kind", line_kind(F.col("text")))
    w = Window.partitionBy("doc").orderBy("line_no")
    fresh = ~F.col("kind").eqNullSafe(F.lag("kind").over(w)) | F.col("kind").isin("header", "formula")
    runs = rows.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(w))
    text = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda x: x["text"])
    b = runs.groupBy("doc", "run", "kind").agg(F.min("line_no").alias("position"), F.array_join(text, "\n").alias("content"))
    level = F.length("content") - F.length(F.ltrim("content", F.lit("#")))
    return b.select("doc", "kind", "position", "content", F.when(F.col("kind") == "header", level).alias("level"))


def _ordered(blocks: DataFrame, content: Column) -> Column:
    rank = F.array_position(F.array(*[F.lit(k) for k in KIND_ORDER]), F.col("kind"))
    items = F.array_sort(F.collect_list(F.struct("page", rank.alias("rank"), "position", content.alias("content"))))
    return F.array_join(F.transform(items, lambda x: x["content"]), "\n\n")


def combine_pages(blocks: DataFrame) -> DataFrame:
    """doc, n_blocks, text: by page, headers, text, tables, formulas, lists."""
    return blocks.groupBy("doc").agg(F.count(F.lit(1)).alias("n_blocks"), _ordered(blocks, F.col("content")).alias("text"))


def render(blocks: DataFrame) -> DataFrame:
    """doc, markdown, html."""
    c, k = F.col("content"), F.col("kind")
    title = F.ltrim(c, F.lit("# "))
    markdown = F.when(k == "header", F.concat(F.repeat(F.lit("#"), F.coalesce("level", F.lit(1))), F.lit(" "), title)).when(k == "formula", F.concat(F.lit("$$\n"), c, F.lit("\n$$"))).otherwise(c)
    level = F.coalesce("level", F.lit(1)).cast("string")
    wrap = lambda tag: F.concat(F.lit(f"<{tag}>"), c, F.lit(f"</{tag}>"))
    html = (
        F.when(k == "header", F.concat(F.lit("<h"), level, F.lit(">"), title, F.lit("</h"), level, F.lit(">")))
        .when(k == "table", wrap("pre")).when(k == "formula", wrap("code")).when(k == "list", wrap("ul")).otherwise(wrap("p"))
    )
    return blocks.groupBy("doc").agg(_ordered(blocks, markdown).alias("markdown"), _ordered(blocks, html).alias("html"))


def summary(blocks: DataFrame) -> DataFrame:
    d = blocks.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("content")).alias("len"), F.count_if(F.col("kind") == "table").alias("tables"))
    return d.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("n") > 0).alias("ok"), F.count_if(F.col("n") == 0).alias("failed"),
        F.sum("len").alias("total_chars"), F.round(F.avg("len"), 6).alias("avg_chars"), F.max(F.col("tables") > 0).alias("has_tables"),
    )


def worksheet_questions(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row for each question of a worksheet's JSON (column doc); percent texts become numbers."""
    kind = "struct<questions:array<struct<question_number:string,problem_text:string,mathematical_expressions:array<string>,answer_format:string,spatial_info:struct<x:string,y:string,width:string,height:string>>>>"
    q = docs.select(*keys, F.explode(F.from_json("doc", kind)["questions"]).alias("q"))
    number = lambda c: F.replace(F.col(f"q.spatial_info.{c}"), F.lit("%"), F.lit("")).try_cast("double").alias(f"{c}_percent")
    return q.select(*keys, "q.question_number", "q.problem_text", "q.mathematical_expressions", "q.answer_format", *[number(c) for c in ("x", "y", "width", "height")])


def layout_elements(pages: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Elements of a page's JSON list (response; width, height, error): keys, idx, category, text, x1..y2.

    What isn't such a list is one text element over the page; a page with an error has none."""
    kind = "array<struct<bbox:array<double>,category:string,text:string>>"
    whole = F.array(F.struct(F.array(F.lit(0.0), F.lit(0.0), F.col("width").cast("double"), F.col("height").cast("double")).alias("bbox"), F.lit("text").alias("category"), F.col("response").alias("text")))
    is_list = F.try_parse_json("response").isNotNull() & stripped(F.col("response")).startswith("[")
    items = F.when(is_list, F.from_json("response", kind)).otherwise(whole)
    e = pages.where("error is null").select(*keys, F.posexplode(items).alias("idx", "e"))
    return e.select(*keys, "idx", "e.category", "e.text", *[F.get("e.bbox", F.lit(i)).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])
