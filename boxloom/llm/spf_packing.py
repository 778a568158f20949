"""Shortest-pack-first packing of tokenised documents over the histogram of their lengths (Krell et al., 2021).

Documents are cut into pieces of the capacity; what is left of each is a shorter piece, which shares a sequence. The
driver gets the histogram of these lengths (fewer than ``capacity`` counts) and places them longest first: all packs that
hold the same lengths are one pattern with a count, a length goes to the patterns with the most room, and where even these
have too little it opens new packs. The patterns are runs, "the pieces of ranks a..b of length L go to the sequences
s..s+(b-a) at offset o", which join the pieces by length and rank. Pieces get their ranks from a range sort whose ranges
are counted; no piece, document or sequence passes through the driver.

Sequences whose length is a power of two need no padding. Where whole rests pad too much (all of them a little over half
the capacity, say), the rests are cut into powers of two down to ``least`` and what remains, and those are placed instead:
``token_pieces`` gives both forms, the histogram decides.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.datasets import numbered
from .common import released, written

#: A space before a byte that can't begin white space always begins a new word of the byte-level splitter.
WORD = re.compile(rb" (?=[\x21-\x7e\xc3-\xe0\xe4-\xf4])")
#: What may count as white space, but for the line feed.
BLANK = re.compile(r"[\s\x1c-\x1f\x85\u180e\u200b]")


class ByteIds:
    """Ids, as little-endian unsigned 32-bit bytes, of whole texts by a byte-level BPE tokenizer.

    Such a tokenizer splits a text before its merges, always at a space and around a single line feed that other
    characters surround, so a text's ids are those of its words in order. Each distinct word is encoded once, by the same
    vocabulary in the faster of two libraries; the cache starts anew beyond ``most`` words. Texts with other white space
    are split at fewer places. Texts that hold an added token are encoded whole by the tokenizer itself, and so is every
    text where the file is no such tokenizer or fails the probes.
    """

    PROBES = tuple(t.encode() for t in ("The quick  brown\tfox\n\njumps", "\n x\n", " a\nb \n c", "É\u00a0ü \u3000 ß\u2003naïve.\n12.5% a.b.c", "don't 'S it's\r\n ok", " lead trail ", "x", "", "...!!! ?a b", "a\u0085 b\nend\n", "日本 語。\n한국어 и русский 🙂 e\u0301", "a\x00b \x1c c"))

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known, self.odd = Tokenizer.from_file(path), most, {}, {}
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.feed, self.whole = self.raw(b"\n"), True
        self.quick = self.ranks_of(path)
        if self.quick is not None and len(self.feed) == 4:
            self.line = int(np.frombuffer(self.feed, "<u4")[0])
            self.whole = False
            probes = [*self.PROBES, *(b" ".join(p.split()) for p in self.PROBES)]
            self.whole = self.encode(probes) != [self.raw(p) for p in probes]

    @staticmethod
    def ranks_of(path: str):
        """An encoder of ordinary text by the file's vocabulary, whose ids are the ranks of its merges; None for other files."""
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        first = kind.get("pre_tokenizer") or {}
        if first.get("type") != "ByteLevel" or first.get("add_prefix_space") or kind.get("normalizer") or kind["model"].get("type") != "BPE":
            return None
        # the printable stand-ins of bytes: those of Latin-1 that show stand for themselves, the others follow from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        stands = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(shown))}
        added = {t["content"] for t in kind.get("added_tokens", ())}
        ranks = {bytes(stands[c] for c in token): k for token, k in kind["model"]["vocab"].items() if token not in added}
        pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def raw(self, text: bytes) -> bytes:
        return np.array(self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def learn(self, parts: list[bytes], block: int = 4000) -> None:
        """Encode new words, many at a time as lines of one text. A word is what follows a space, or a line feed, which it then
        has before it; those that hold white space stay unknown."""
        good = [w for w in parts if w and w != b"\n" and not BLANK.search(w.decode().removeprefix("\n"))]
        for i in range(0, len(good), block):
            some = good[i : i + block]
            text = b"\n".join([w[1:] if w[0] == 10 else b" " + w for w in some]).decode()
            ids = np.array(self.quick.encode_ordinary(text), dtype="<u4")
            body, cuts = ids.tobytes(), np.flatnonzero(ids == self.line)
            at = [-4, *(cuts * 4).tolist(), len(body)]
            self.known.update((w, self.feed + body[x + 4 : y] if w[0] == 10 else body[x + 4 : y]) for w, x, y in zip(some, at[:-1], at[1:], strict=True))

    def joined(self, text: bytes, parts: list[bytes]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, parts))[len(self.feed) :]
        except KeyError:  # other white space
            first, *rest = WORD.split(text)
            words = [first, *(b" " + w for w in rest)]
            if len(self.odd) > self.most:
                self.odd = {}
            for w in set(words).difference(self.odd):
                self.odd[w] = np.array(self.quick.encode_ordinary(w.decode()), dtype="<u4").tobytes()
            return b"".join(map(self.odd.__getitem__, words))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; texts that repeat are encoded once."""
        found: dict[bytes, bytes] = {}
        split: dict[bytes, list[bytes]] = {}
        for t in dict.fromkeys(texts):
            if self.whole or any(a in t for a in self.added):
                found[t] = self.raw(t)
            else:
                split[t] = (b"\n" + t).replace(b"\n", b" \n").split(b" ")[1:]
        if len(self.known) > self.most:
            self.known = {}
        self.learn(list(set().union(*split.values()).difference(self.known)))
        for t, parts in split.items():
            found[t] = self.joined(t, parts)
        return [found[t] for t in texts]


def groups(texts: list[bytes], most: int = 4_000_000) -> Iterator[list[bytes]]:
    """The texts in order, some megabytes at a time."""
    own, size = [], 0
    for t in texts:
        own.append(t)
        size += len(t)
        if size >= most:
            yield own
            own, size = [], 0
    if own:
        yield own


def powers(length: int, least: int) -> list[int]:
    """The length as falling powers of two, none below ``least``, and what remains."""
    out, bit = [], 1 << max(length.bit_length() - 1, 0)
    while bit >= least and length:
        if length & bit:
            out.append(bit)
            length -= bit
        bit >>= 1
    return out + ([length] if length else [])


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0, least: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, form: the pieces of each document's ids,
    with the end id last.

    Pieces of the capacity have form 0. What remains is there twice: whole (form 1), and as powers of two (form 2);
    take one. A null text is the empty text, which is the end id alone; a null doc_id stays null.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("form", pa.int32())])

    def cut(batches):
        ids_of, end = ByteIds(tokenizer_path), np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            at = 0
            for some in groups(texts):
                rows: list[tuple] = []
                for doc_id, body in zip(doc_ids[at : at + len(some)], ids_of.encode(some)):
                    ids = body + end
                    n = len(ids) // 4
                    whole = n // capacity * capacity
                    spans = [(x, capacity, 0) for x in range(0, whole, capacity)]
                    if n > whole:
                        spans.append((whole, n - whole, 1))
                        x = whole
                        for part in powers(n - whole, least):
                            spans.append((x, part, 2))
                            x += part
                    rows += [(doc_id, x, k, ids[4 * x : 4 * (x + k)], n, form) for x, k, form in spans]
                at += len(some)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        released(cut), "doc_id long, start long, length long, ids binary, doc_tokens long, form int"
    )


def shortest_pack_first(counts: Mapping[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], dict[int, int]]:
    """Runs by length, (first rank, first sequence, offset) by rising rank, and the number of packs by their filling.

    Lengths go longest first to the patterns with the most room. A pattern is held as its filling and the ranges of
    sequences that have it; patterns of one filling are alike to every length that follows."""
    ranges: dict[int, list[tuple[int, int]]] = defaultdict(list)
    order: list[int] = []  # fillings, a heap
    opened = 0
    runs: dict[int, list[tuple[int, int, int]]] = {}

    def give(used: int, first: int, n: int) -> None:
        if not ranges[used]:
            heapq.heappush(order, used)
        ranges[used].append((first, n))

    for length in sorted(counts, reverse=True):
        left, rank, own = counts[length], 0, []
        while left:
            if order and order[0] + length <= capacity:
                used = order[0]
                first, n = ranges[used].pop()
                take = min(n, left)
                if take < n:
                    ranges[used].append((first + take, n - take))
                elif not ranges[used]:
                    heapq.heappop(order)
            else:
                used, first, take = 0, opened, -(-left // (capacity // length))  # the next rounds fill these up
                opened += take
            own.append((rank, first, used))
            give(used + length, first, take)
            rank, left = rank + take, left - take
        runs[length] = own
    return runs, {used: sum(n for _, n in r) for used, r in ranges.items() if r}


def padding(fillings: Mapping[int, int], capacity: int) -> int:
    """Tokens of padding: sequences are filled up to the capacity, but those of a power of two."""
    return sum((capacity - used) * n for used, n in fillings.items() if used & (used - 1))


def spf_pack(pieces: DataFrame, capacity: int = 1024, most_padding: float = 0.01) -> DataFrame:
    """The pieces of one form (0 and either 1 or 2; any further columns) with sequence_id and offset, without form.

    Sequences are filled from 0 without gaps and hold at most the capacity. Whole rests (form 1) are packed unless their
    padding exceeds ``most_padding`` of all their tokens and powers of two pad less. Rows that repeat are packed one by
    one; an empty table gives an empty result.

    The pieces are read several times, so give a stored table. The plan that the driver broadcasts has a row for each
    length, fewer than ``capacity``, with the runs of its length: each run ends a length or a range of alike packs.
    """
    spark = pieces.sparkSession
    keep = [c for c in pieces.columns if c != "form"]
    counts: dict[int, dict[int, int]] = {1: {}, 2: {}}
    for r in pieces.where("form > 0").groupBy("form", "length").agg(F.count(F.lit(1)).alias("n")).collect():  # under 2 * capacity rows
        counts[r["form"]][r["length"]] = r["n"]
    plans = {form: shortest_pack_first(c, capacity) for form, c in counts.items()}
    tokens = sum(k * n for k, n in counts[1].items())
    pads = {form: padding(p[1], capacity) for form, p in plans.items()}
    form = 2 if pads[1] > most_padding * tokens and pads[2] < pads[1] else 1
    runs, fillings = plans[form]
    before, rows = 0, []
    for length in sorted(runs, reverse=True):
        rows.append((length, before, [tuple(map(int, r)) for r in runs[length]]))
        before += counts[form][length]
    plan = spark.createDataFrame(rows, "length long, __before long, __runs array<struct<rank:long,first:long,used:long>>")
    ranked = numbered(pieces.where(F.col("form") == form).select(*keep), [F.desc("length"), *[F.col(c) for c in keep if c != "length"]], column="__number")
    placed = ranked.join(F.broadcast(plan), "length").withColumn("__rank", F.col("__number") - F.col("__before"))
    run = F.element_at(F.filter("__runs", lambda r: r["rank"] <= F.col("__rank")), -1)
    placed = placed.withColumn("__run", run).select(*keep, (F.col("__run.first") + F.col("__rank") - F.col("__run.rank")).alias("sequence_id"), F.col("__run.used").alias("offset"))
    shared = sum(fillings.values())  # the numbers of the shared sequences end here
    full = pieces.where("form = 0").select(*keep, (F.lit(shared) + F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.union(full)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 0) -> DataFrame:
    """Tokenise whole documents and pack them: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null text is the empty text. A null doc_id stays null. Documents that repeat are packed each for itself. Further
    columns are ignored."""
    pieces = token_pieces(docs, tokenizer_path, capacity, end_id)
    return spf_pack(written(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "form")), capacity)
