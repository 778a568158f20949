"""The elements of a JSON document's arrays, read by many tasks: for COCO files of real size.

Spark's text reader cuts a file into byte ranges (blocks) and deals out the records between closing braces, from any file
system. What a block's bytes mean depends on what stands before it, so there are two passes. The first gives a summary of
each block: whether it flips being in a string, by how much it changes the depth, which keys opened arrays. The summaries
of a file, one small row a block, are put in order and tell the state in which each block begins. The second pass starts
from these states and gives the elements. An element that lies in several blocks comes in parts, which are joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import stored

ESCAPED = re.compile(rb"\\.", re.DOTALL)
#: The key before an opening bracket.
KEY = re.compile(rb'"((?:[^"\\]|\\.)*)"\s*:\s*\Z', re.DOTALL)
FEED = 8_000_000  # bytes that are looked at together


class Brackets:
    """The depth of nesting along a text that is fed piece by piece, from a known state. Pieces end at a closing brace."""

    def __init__(self, in_string: bool, depth: int):
        self.in_string, self.depth = int(in_string), depth

    def feed(self, piece: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of brackets outside strings, 1 or -1 for each, and the depth after it."""
        plain = ESCAPED.sub(b"__", piece) if b"\\" in piece else piece
        text = np.frombuffer(plain, np.uint8)
        quotes = np.cumsum(text == 0x22, dtype=np.int64)
        at = np.flatnonzero((text == 0x7B) | (text == 0x7D) | (text == 0x5B) | (text == 0x5D))
        at = at[(quotes[at] + self.in_string) % 2 == 0]
        change = np.where((text[at] == 0x7B) | (text[at] == 0x5B), 1, -1)
        after = self.depth + np.cumsum(change)
        self.in_string = (self.in_string + int(quotes[-1]) if len(quotes) else self.in_string) % 2
        self.depth = int(after[-1]) if len(after) else self.depth
        return at, change, after


def key_before(piece: bytes, at: int) -> str:
    found = KEY.search(piece, max(0, at - 1000), at)
    return found[1].decode("utf-8", "replace") if found else ""


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bytes]]:
    """(file, block, bytes) in order, the braces put back."""
    now, own, size = None, [], 0
    for b in batches:
        values, blocks = b.column(2).cast(pa.binary()).to_pylist(), b.column(1)
        new = pc.or_(pc.not_equal(b.column(0).slice(1), b.column(0).slice(0, max(len(values) - 1, 0))), pc.not_equal(blocks.slice(1), blocks.slice(0, max(len(values) - 1, 0))))
        cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist(), len(values)]
        for i, j in zip(cuts, cuts[1:]):  # the records of a block
            if i == j:
                continue
            at = (b.column(0)[i].as_py(), blocks[i].as_py())
            if at != now or size > FEED:
                if own:
                    yield (*now, b"}".join([*own, b""]))
                now, own, size = at, [], 0
            own += values[i:j]
            size += sum(map(len, values[i:j])) + j - i
    if own:
        yield (*now, b"}".join([*own, b""]))


SUMMARY = "path string, block long, guess int, flips int, change int, least int, depths array<int>, keys array<string>"


def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each block and guess of whether it begins in a string. Depths count from the block's start; keys are those
    that last opened an array or object, by the depth within it."""
    found: dict[tuple, list] = {}
    for path, block, piece in pieces(batches):
        for guess in (0, 1):
            own = found.setdefault((path, block, guess), [Brackets(bool(guess), 0), 0, {}])
            at, change, after = own[0].feed(piece)
            own[1] = min(own[1], int(after.min()) if len(after) else 0)
            opening = np.flatnonzero(change == 1)
            depths, last = np.unique(after[opening][::-1], return_index=True)
            own[2].update((int(d), key_before(piece, int(at[opening[::-1][i]]))) for d, i in zip(depths, last))
    rows = [(*k, b.in_string ^ k[2], b.depth, least, list(keys), list(keys.values())) for k, (b, least, keys) in found.items()]
    kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()))
    names = [x.split()[0] for x in SUMMARY.split(", ")]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def starting_states(rows: Sequence) -> dict[tuple[str, int], tuple[int, int, str, int]]:
    """For each block of each file the state in which it begins: in a string, depth, the key of the array at the top level
    ('' outside), the block in which the element began that is open."""
    by = {(r["path"], r["block"], r["guess"]): r for r in rows}
    out, file, state = {}, None, (0, 0, "", -1)
    for path, block in sorted({k[:2] for k in by}):
        if path != file:
            file, state = path, (0, 0, "", -1)
        out[path, block] = state
        in_string, depth, section, began = state
        r = by[path, block, in_string]
        section = dict(zip(r["depths"], r["keys"])).get(2 - depth, section)
        began = block if depth + r["least"] <= 2 else began
        depth += r["change"]
        state = (in_string ^ r["flips"], depth, section if depth >= 2 else "", began if depth > 2 else -1)
    return out


def elements_of(states: dict, wanted: frozenset):
    """The task that gives elements: path, section, began (block), place (there, of the start), block, whole, value."""
    names = ("path", "section", "began", "place", "block", "whole", "value")
    kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())

    def run(batches):
        rows: list[tuple] = []
        now, brackets, section, began, rest = None, None, "", -1, b""
        offset, first = 0, None  # of the piece, and of the element that is open, in the block

        def give(value: bytes, whole: bool) -> None:
            if section in wanted:
                rows.append((now[0], section, began, first, now[1], whole, value.decode("utf-8", "replace")))

        for path, block, piece in pieces(batches):
            if (path, block) != now:
                if rest:
                    give(rest, False)
                now = (path, block)
                in_string, depth, section, began = states[now]
                brackets, rest, offset, first = Brackets(bool(in_string), depth), b"", 0, None
            inside = brackets.depth > 2  # an element is open
            at, change, after = brackets.feed(piece)
            start = 0
            for k in np.flatnonzero(((change == 1) & (after <= 3)) | ((change == -1) & (after == 2))).tolist():
                place = int(at[k])
                if change[k] == 1 and after[k] == 2:
                    section = key_before(piece, place)
                elif change[k] == 1 and after[k] == 3:
                    inside, start, began, first = True, place, block, offset + place
                elif change[k] == -1 and inside:
                    give(rest + piece[start : place + 1], began == block)
                    inside, rest = False, b""
            rest = rest + piece[start:] if inside else b""
            offset += len(piece)
            if len(rows) >= 5000:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
                rows.clear()
        if rest:
            give(rest, False)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return run


def read_sections(spark: SparkSession, path: str, sections: Sequence[str]) -> DataFrame:
    """path, section, place (orders a document's elements), value (JSON text) of every element of the arrays with these keys
    at the top level of the documents.

    Blocks have ``spark.sql.files.maxPartitionBytes``; compressed files can't be cut. What the driver collects, and the second
    pass gets, is a row of some 100 bytes for each block, a millionth of the input at Spark's block size."""
    text = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), "value")
    states = starting_states(text.mapInArrow(summaries, SUMMARY).collect())
    rows = stored(text.mapInArrow(elements_of(states, frozenset(sections)), "path string, section string, began long, place long, block long, whole boolean, value string"))  # for each section
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda x: x["value"]), "")
    parts = rows.where("not whole").groupBy("path", "section", "began").agg(F.max("place").alias("place"), joined.alias("value"))  # of one element
    return rows.where("whole").select("path", "section", "began", "place", "value").unionByName(parts).select("path", "section", F.struct("began", "place").alias("place"), "value")
