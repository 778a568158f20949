"""Prompts for models, built per image."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.taxonomy import STEP1_PHRASES


def box_prompts(boxes: DataFrame, head: str) -> DataFrame:
    """image_id, prompt: the head and a line for each numbered box (idx)."""
    corners = F.concat_ws(",", *[F.col(c).cast("long").cast("string") for c in ("x1", "y1", "x2", "y2")])
    line = F.concat(F.lit("\nBOX_INDEX_"), F.col("idx").cast("string"), F.lit(": ("), corners, F.lit(")"))
    items = F.array_sort(F.collect_list(F.struct("idx", line.alias("t"))))
    return boxes.groupBy("image_id").agg(F.concat(F.lit(head), F.array_join(F.transform(items, lambda x: x["t"]), "")).alias("prompt"))


def _items(prompts: Column) -> Column:
    return F.transform(F.split(prompts, ",", -1), lambda p: F.trim(p))


def simple_names(prompts: Column) -> Column:
    """Plain singular names: articles go (as substrings), one final s goes, the first letter is a capital."""

    def one(p: Column) -> Column:
        bare = F.replace(F.replace(F.replace(F.lower(p), F.lit("a "), F.lit("")), F.lit("an "), F.lit("")), F.lit("the "), F.lit(""))
        single = F.when(bare.endswith("s") & ~bare.endswith("ss"), F.substr(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)
        return F.concat(F.upper(F.substring(single, 1, 1)), F.lower(F.substring(single, 2, 100000)))

    return F.array_join(F.transform(_items(prompts), one), ",")


def one_phrase(prompts: Column) -> Column:
    return F.when(prompts.contains(","), F.lower(F.array_join(_items(prompts), " and "))).otherwise(F.lower(prompts))


def category_phrases(chosen: DataFrame, table: Mapping[str, str] = STEP1_PHRASES) -> DataFrame:
    """The rows (with category), one for each of the category's phrases: n, phrase."""
    rows = [(c, i, p.strip()) for c, text in table.items() for i, p in enumerate(text.split(","))]
    phrases = chosen.sparkSession.createDataFrame(rows, "category string, n int, phrase string")
    return chosen.join(F.broadcast(phrases), "category")  # a fixed table


def text_prompts(chosen: DataFrame, keys: Sequence[str], table: Mapping[str, str] = STEP1_PHRASES) -> DataFrame:
    """keys, prompt (joined by commas) and detector_prompt (joined and ended by full stops)."""
    items = F.array_sort(F.collect_list(F.struct("category", "n", "phrase")))
    p = category_phrases(chosen, table).groupBy(*keys).agg(F.transform(items, lambda x: x["phrase"]).alias("p"))
    return p.select(*keys, F.array_join("p", ", ").alias("prompt"), F.concat(F.array_join("p", ". "), F.lit(".")).alias("detector_prompt"))
