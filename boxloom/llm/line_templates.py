"""Line dedup with a log-template tree.

Lines are parsed by a tree of fixed depth: the first level is the token count, the next ``depth`` levels are the leading
tokens, in which tokens with digits are already the variable ``<*>``. Lines of one leaf are generalised position by
position: a token that fewer than ``min_docs`` documents of the leaf have there becomes ``<*>`` too, since no template
that it belongs to could recur often enough. What results is the line's template. As values of a field may recur
themselves, a line has such a template for each level of support, ``min_docs`` times a power of two: its constants are the
tokens that so many documents have at their place, so that rare and frequent values of a field fall into one template.

A template is recurring if at least ``min_docs`` documents have it and at least the share ``similarity`` of its positions
is constant. All lines of recurring templates are dropped. With ``keep_first``, the first of each template stays (by
document id, then line number). Rows of one text are one document, so copies of a whole document are no recurrence.

The result doesn't depend on the order of the rows. Leaves are counted on hashes first; only lines in leaves that at
least ``min_docs`` documents share go on, each distinct line once, so a line that fills a third of the corpus is one row.
"""

from __future__ import annotations

import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, released, row_key

DIGIT = re.compile(r"\d")
WILD = "<*>"


def _hash(text: str) -> int:
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"))
    return h - (1 << 64) if h >> 63 else h


def masked(line: str) -> list[str]:
    """The tokens of a line; those with digits are variable."""
    return [WILD if DIGIT.search(t) else t for t in line.split()]


def leaf_of(tokens: list[str], depth: int) -> int:
    return _hash("\0".join([str(len(tokens)), *tokens[:depth]]))


def recurring_lines(docs: DataFrame, text_col: str, min_docs: int, depth: int, similarity: float, keep_first: bool) -> DataFrame:
    """(key, lines): the numbers of each document's lines to drop. Needs the columns key (long) and id."""

    def parse(batches):
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for key, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                for n, line in enumerate((text.as_py() or "").split("\n")):
                    tokens = masked(line)
                    if tokens:
                        for out, x in zip(rows, (key, doc, n, leaf_of(tokens, depth), _hash("\0".join(tokens)))):
                            out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["key", "id", "n", "leaf", "line"])

    text = docs.select("key", "id", F.col(text_col).alias("text"))
    lines = checkpointed(text.mapInArrow(released(parse), "key long, id long, n int, leaf long, line long"))
    once = lines.groupBy("leaf", "key").agg(F.lit(1).alias("x")).groupBy("leaf").agg(F.count(F.lit(1)).alias("docs"))
    common = checkpointed(once.where(F.col("docs") >= min_docs).select("leaf"))  # apart from its aggregate, so that the join can split a hot leaf
    # each distinct line of a common leaf: its documents, and where it stands first
    ours = checkpointed(lines.join(common, "leaf", "left_semi"))
    distinct = (
        ours.groupBy("leaf", "line", "key")
        .agg(F.min(F.struct(F.col("id").isNull().alias("late"), F.col("id"), F.col("key"), F.col("n"))).alias("place"))
        .groupBy("leaf", "line")
        .agg(F.count(F.lit(1)).alias("docs"), F.min("place").alias("place"))
    )
    # the text of each, from the document where it stands first
    wanted = distinct.select(F.col("place.key").alias("at"), F.col("place.id").alias("own"), F.struct(F.col("place.n").alias("n"), "leaf", "line", "docs").alias("w"))
    wanted = checkpointed(wanted.groupBy("at", "own").agg(F.collect_list("w").alias("wanted")))  # one document's own lines

    def fetch(batches):
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for text, wanted in zip(batch.column(0), batch.column(1).to_pylist()):
                split = (text.as_py() or "").split("\n")
                for w in wanted:
                    tokens = masked(split[w["n"]])
                    for k, t in enumerate(tokens):
                        for out, x in zip(rows, (w["leaf"], w["line"], w["docs"], len(tokens), k, 0 if t == WILD else _hash(t))):
                            out.append(x)
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, t) for r, t in zip(rows, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))],
                names=["leaf", "line", "docs", "size", "k", "token"],
            )

    tokens = checkpointed(
        text.join(wanted, (F.col("key") == F.col("at")) & F.col("id").eqNullSafe(F.col("own"))).select("text", "wanted").mapInArrow(released(fetch), "leaf long, line long, docs long, size int, k int, token long").distinct()
    )
    # stored, so that the join can split a hot leaf, all of whose lines share their leading tokens
    support = checkpointed(tokens.where("token <> 0").groupBy("leaf", "k", "token").agg(F.sum("docs").alias("s")).where(F.col("s") >= min_docs))
    known = _templates(ours, distinct, tokens, support, min_docs, similarity)
    marked = ours.join(known.select("leaf", "line", "template"), ["leaf", "line"])
    if keep_first:
        first = checkpointed(known.groupBy("leaf", "template").agg(F.min("place").alias("first")))
        marked = marked.join(first, ["leaf", "template"]).where((F.col("first.key") != F.col("key")) | (F.col("first.n") != F.col("n")))
    return checkpointed(marked.groupBy("key").agg(F.collect_set("n").alias("lines")))  # one document's own lines


def _templates(ours: DataFrame, distinct: DataFrame, tokens: DataFrame, support: DataFrame, min_docs: int, similarity: float) -> DataFrame:
    """(leaf, line, template, docs, place): the most specific recurring template of each line that has one."""
    level = (F.length(F.bin(F.floor(F.col("s") / min_docs))) - 1).alias("level")  # of the power of two
    placed = tokens.join(support.select("leaf", "k", "token", level), ["leaf", "k", "token"])
    steps = placed.groupBy("leaf", "line", "size", "level").agg(F.bit_xor(F.xxhash64("k", "token")).alias("t"), F.count(F.lit(1)).alias("n"))
    upwards = Window.partitionBy("leaf", "line").orderBy(F.desc("level")).rowsBetween(Window.unboundedPreceding, 0)  # a line's own levels
    nested = steps.select("leaf", "line", "size", F.bit_xor("t").over(upwards).alias("t"), F.sum("n").over(upwards).alias("constants"))
    nested = checkpointed(nested.where(F.col("constants") >= similarity * F.col("size")).select("leaf", "line", "constants", F.xxhash64("t", "size", "constants").alias("template")))
    per_doc = ours.join(nested, ["leaf", "line"]).groupBy("leaf", "template", "key").agg(F.lit(1).alias("x"))
    recurring = checkpointed(per_doc.groupBy("leaf", "template").agg(F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs).select("leaf", "template"))
    best = nested.join(recurring, ["leaf", "template"]).groupBy("leaf", "line").agg(F.max_by("template", "constants").alias("template"))
    return checkpointed(best.join(distinct, ["leaf", "line"]))


def drop_recurring_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 4, depth: int = 3, similarity: float = 0.5, keep_first: bool = False, count_col: str | None = None) -> DataFrame:
    """The input with the lines of recurring templates dropped from its texts; all rows and columns stay.

    With ``count_col`` a column of that name gives the number of lines dropped. Lines without tokens stay. Null texts
    stay null and have no lines; an empty text is one line without tokens. Rows of one text are one document, whatever
    their ids; rows with a null id take part. Very long texts are parsed whole, a line at a time. An empty table gives
    an empty result; columns of any name are carried along.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])  # whatever its columns are called
    keyed = docs.select(row_key(text_col).alias("key"), F.col(id_col).cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"), row.alias("row"))
    lost = recurring_lines(keyed.drop("row"), "text", min_docs, depth, similarity, keep_first)
    joined = keyed.drop("id", "text").join(lost, "key", "left")
    text = F.col("row").getField(text_col)
    numbered = F.transform(F.split(text, "\n", -1), lambda line, n: F.struct(line.alias("line"), n.alias("n")))
    kept = F.filter(numbered, lambda x: ~F.array_contains(F.col("lines"), x["n"]))
    clean = F.when(F.col("lines").isNull(), text).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
    count = [F.coalesce(F.size("lines"), F.lit(0)).alias(count_col)] if count_col else []
    return joined.select(*[(clean if c == text_col else F.col("row").getField(c)).alias(c) for c in docs.columns], *count)


def line_query(docs: DataFrame) -> DataFrame:
    """Each document's lines, how many go, and a digest of what stays."""
    n_lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n_lines")
    out = drop_recurring_lines(docs.select("doc_id", "text", n_lines), count_col="n_dropped")
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
