"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Best-fit decreasing by a plan of the driver, in place of distributed successor sweeps in bulk-synchronous rounds, which
were tried on histograms and can't give as good a result in few rounds (figures in the README): gaps are never a Spark
table. Pieces are range-sorted by length in Spark, which gives each its rank among the pieces of its
length, and the driver gets a histogram of at most ``capacity`` (4096) lengths. One sequential loop takes the lengths
from the longest on and fills, for each, the gaps from its successor (the smallest gap that holds it) upwards; what finds
no gap opens new sequences. The plan is a table of runs: "ranks a..b of length L go to sequences s..s+(b-a) at offset o".
Pieces look up their run by rank inside
Spark tasks. No piece, document or sequence passes through the driver: it gets at most ``capacity`` counts and one more for
each partition bound, and the runs that it sends back level off with growing counts (10 to 53 thousand for 10,000 to
10,000,000 pieces).

Words are encoded by the tokenizer of the given file. The short cuts for plain words and for punctuation at a word's end
are taken only where the file gives the same ids with and without them on a set of probes; other files encode whole texts.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, released, shuffle_partitions

#: ASCII punctuation that the tokenizer's splitter always parts from a letter or digit before it.
TRAIL = b".,!*&#$%;:?)|"


#: Stands between words when many are encoded as one text; the tokenizer makes one token of it.
MARK = b"\x01"


#: Words that the normaliser leaves alone and the splitter keeps whole, once A-Z are lower-cased.
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")  # a-z, and U+00DF to U+00FF without the division sign
ALNUM = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz")


#: Texts on which the short cuts must agree with the tokenizer: case, white space, accents, digits, punctuation in and after words.
PROBES = tuple(
    t.encode()
    for t in ("The quick  brown\tfox\n\njumps", "Éa über ß naïve", "end. (end), end! 12.5% a.b.c #1# x|", "don't 'S it's'll", " lead", "a\x01b", "x", "", "ALLCAPS mixedCase snake_case", "...!!! ?a &b *c* $9 :;")
)


class WordIds:
    """Ids, as little-endian unsigned 32-bit bytes, of whole texts.

    The tokenizer drops white space before its merges and no token spans it, so a text's ids are those of its words in
    order. Each distinct word is encoded once; the cache is bounded and starts anew beyond ``most`` entries. Plain words,
    which the tokenizer's normaliser and pattern would leave as they are, are encoded by the file's vocabulary in
    ``tiktoken``, the faster of two libraries, if the file allows it.
    """

    def __init__(self, path: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.quick = self.ranks_of(path)
        self.known: dict[bytes, bytes] = {b"": b""}
        mark = self.raw(MARK)
        self.whole = False
        self.mark = int(np.frombuffer(mark, "<u4")[0]) if len(mark) == 4 else None

    @classmethod
    def checked(cls, path: str) -> "WordIds":
        """With the short cuts if the file's tokenizer allows them."""
        own = cls(path)
        own.whole = own.encode(list(PROBES)) != [own.raw(p) for p in PROBES]
        return own

    @staticmethod
    def ranks_of(path: str):
        """An encoder of plain words, each with a zero byte for the end-of-word suffix, and which of its ids end a word; None for
        files whose ids are not the ranks of the merges, or which have no such suffix. The suffix then joins the last byte
        before all other merges, as in the file's own model."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        suffix, vocab = model.get("end_of_word_suffix"), model.get("vocab")
        if model.get("type") != "BPE" or not suffix or model.get("continuing_subword_prefix") or model.get("dropout"):
            return None
        merges = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if merges != list(range(512, 512 + len(merges))) or len(vocab) != 512 + len(merges):
            return None
        # the printable stand-ins of bytes: those of Latin-1 that show stand for themselves, the others follow from 256 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        stands = {chr(b): chr(b) for b in shown} | {chr(256 + k): chr(b) for k, b in enumerate(x for x in range(256) if x not in set(shown))}
        table = str.maketrans(stands)
        ranks = {(t.removesuffix(suffix).translate(table) + "\0" * t.endswith(suffix)).encode("latin-1"): k for t, k in vocab.items()}
        if len(ranks) != len(vocab):
            return None
        ends = np.zeros(len(vocab), dtype=bool)
        ends[[k for t, k in vocab.items() if t.endswith(suffix)]] = True
        return tiktoken.Encoding("own", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={}), ends

    def learn_plain(self, words: list[bytes], block: int = 20_000) -> None:
        """Encode plain words that aren't known, many at a time as one text."""
        encoder, ends = self.quick or (None, None)
        for i in range(0, len(words), block):
            some = words[i : i + block]
            ids = np.array(encoder.encode_ordinary((b"\0".join(some) + b"\0").decode()), dtype="<u4")
            body, at = ids.tobytes(), [0, *((np.flatnonzero(ends[ids]) + 1) * 4).tolist()]
            self.known.update((w, body[x:y]) for w, x, y in zip(some, at[:-1], at[1:], strict=True))

    def raw(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def learn(self, words: list[bytes], block: int = 2000) -> None:
        """Encode words that aren't known, many at a time as one text with marks between them."""
        for i in range(0, len(words), block):
            some = words[i : i + block]
            text = (b" " + MARK + b" ").join(some).decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark) if self.mark is not None else np.zeros(0, dtype=int)
            if len(cuts) != len(some) - 1:  # a word holds the mark
                self.known.update((w, self.raw(w)) for w in some)
                continue
            body = ids.tobytes()
            at = [-4, *(cuts * 4).tolist(), len(body)]
            self.known.update((w, body[x + 4 : y]) for w, x, y in zip(some, at, at[1:]))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text; texts that repeat are encoded once."""
        distinct = dict.fromkeys(texts)
        if self.whole:
            found = {t: self.raw(t) for t in distinct}
            return [found[t] for t in texts]
        split = [t.split() for t in distinct]
        words = list(set().union(*split))
        special = any(b"<|" in t for t in distinct)  # lower-casing could make a special token of a word
        lower = [w if b"<|" in w else w.lower() for w in words] if special else list(map(bytes.lower, words))
        tails: dict[int, bytes] = {}
        for i, w in enumerate(lower):
            core = w.rstrip(TRAIL)
            if len(core) < len(w) and core and core[-1] in ALNUM:
                lower[i], tails[i] = core, w[len(core) :]
        if len(self.known) > self.most:
            self.known = {b"": b""}
        new = {*lower, *tails.values()}.difference(self.known)
        plain = [c for c in new if PLAIN.fullmatch(c)] if self.quick else []
        self.learn_plain(plain)
        self.learn(list(new.difference(plain)))
        known = self.known
        of = dict(zip(words, map(known.__getitem__, lower)))
        for i, tail in tails.items():
            of[words[i]] += known[tail]
        for t, own in zip(distinct, split):
            distinct[t] = b"".join(map(of.__getitem__, own))
        return [distinct[t] for t in texts]


def groups(texts: list[bytes], most: int = 6_000_000) -> Iterator[list[bytes]]:
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


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of each document's ids: doc_id, piece, start, length, ids_crc32. Only documents over the capacity are cut."""

    def cut(batches):
        ids_of = WordIds.checked(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows: dict[str, list] = defaultdict(list)
            texts = [t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()]
            every = (ids + end for some in groups(texts) for ids in ids_of.encode(some))
            for doc_id, ids in zip(batch.column(0), every):
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows["doc_id"].append(doc_id.as_py())
                    rows["piece"].append(k)
                    rows["start"].append(at // 4)
                    rows["length"].append(len(part) // 4)
                    rows["ids_crc32"].append(zlib.crc32(part))
            yield pa.RecordBatch.from_pydict({k: rows[k] for k in schema.names}, schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        released(cut), "doc_id long, piece int, start long, length long, ids_crc32 long"
    )


def plan_runs(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """Best-fit supersteps over the counts by length: per length, rows of (first rank, first sequence, offset)."""
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []  # the gap sizes there are, ascending
    opened = 0
    runs: dict[int, list[tuple[int, int, int]]] = {}

    def give(gap: int, first: int, n: int) -> None:
        if gap and n:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first, n))

    def fill(length: int, rank: int, first: int, n: int, gap: int, each: int) -> int:
        """n sequences from the first on take ``each`` pieces; the next free rank."""
        for k in range(each):
            runs[length].append((rank, first, capacity - gap + k * length))
            rank += n
        give(gap - each * length, first, n)
        return rank

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        runs[length] = []
        while left:
            i = bisect_left(order, length)
            if i == len(order):  # no gap holds it: open sequences
                gap, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            else:
                gap = order[i]
                first, n = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(i)
            each = gap // length
            full = min(n, left // each)
            rank = fill(length, rank, first, full, gap, each) if full else rank
            left -= full * each
            if full < n:
                if left:  # fewer than one sequence takes
                    rank = fill(length, rank, first + full, 1, gap, left)
                    full, left = full + 1, 0
                give(gap, first + full, n - full)
    return {k: np.array(v, dtype=np.int64).reshape(-1, 3) for k, v in runs.items()}


def best_fit_pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Give each piece (any columns, with length from 1 to the capacity) a sequence_id and an offset there.

    Sequences are filled from 0 without gaps. Rows that repeat are packed one by one. An empty table gives an empty
    result.
    """
    spark = pieces.sparkSession
    keys = [F.col(c) for c in pieces.columns if c != "length"]
    ranged = pieces.repartitionByRange(shuffle_partitions(spark), F.col("length").desc(), *keys).sortWithinPartitions(F.col("length").desc(), *keys)
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)

    def number(batches):
        """Each row's rank among its partition's rows of the same length."""
        pid, before, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = np.empty(len(length), dtype=np.int64)
            at = 0
            for end in [*(np.flatnonzero(np.diff(length)) + 1), len(length)]:
                if end == at:
                    continue
                if length[at] != last:
                    before, last = 0, length[at]
                rank[at:end] = np.arange(before, before + end - at)
                before, at = before + end - at, end
            yield batch.append_column("pid", pa.array(np.full(len(length), pid), pa.int32())).append_column("rank", pa.array(rank))

    # Written once: a second run of the range sort could draw other bounds and so other ranks.
    ranked = checkpointed(ranged.mapInArrow(number, f"{out}, pid int, rank long"))
    # One row for each length and, where a length spans partitions, one more for each: capacity + partitions at most.
    tally = ranked.groupBy("length", "pid").agg(F.count(F.lit(1)).alias("n")).collect()
    total: dict[int, int] = defaultdict(int)
    base: dict[tuple[int, int], int] = {}
    for row in sorted(tally, key=lambda r: (r["length"], r["pid"])):
        base[row["length"], row["pid"]] = total[row["length"]]
        total[row["length"]] += row["n"]
    shared = spark.sparkContext.broadcast((base, plan_runs(dict(total), capacity)))

    def place(batches):
        base, runs = shared.value
        for batch in batches:
            length, pid, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "pid", "rank"))
            seq, off = np.empty(len(length), dtype=np.int64), np.empty(len(length), dtype=np.int64)
            for n in np.unique(length):
                own = np.flatnonzero(length == n)
                r = rank[own] + np.array([base[int(n), int(p)] for p in pid[own]], dtype=np.int64)
                run = runs[int(n)]
                at = np.searchsorted(run[:, 0], r, side="right") - 1
                seq[own], off[own] = run[at, 1] + r - run[at, 0], run[at, 2]
            keep = batch.select([c for c in batch.schema.names if c not in ("pid", "rank")])
            yield keep.append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    return ranked.mapInArrow(place, f"{out}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """Tokenise whole documents and pack them: a row per piece with doc_id, piece, start, length, ids_crc32,
    sequence_id, offset.

    A null text is the empty text, which is the end id alone. A null doc_id stays null. Documents that repeat are
    packed each for itself. Further columns are ignored.
    """
    return best_fit_pack(checkpointed(token_pieces(docs, tokenizer_path, capacity, end_id)), capacity)
