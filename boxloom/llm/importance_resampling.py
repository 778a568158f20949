"""Importance resampling towards a target distribution on hashed n-gram features (Xie et al., 2023).

A text's features are its runs of one to three words; a feature's bucket is the CRC-32 of its bytes modulo the number of
buckets. Each block of texts gets an Aho-Corasick dictionary of its distinct words, each between two delimiters and with
its CRC and length as payload, so that a scan of the block emits the payloads of the words in order. CRC-32 is linear:
the CRC of "a b" is the CRC of "a", carried over as many zero bytes as " b" has, xor the CRC of " b". Payloads of
neighbours compose to those of runs that way, on arrays, and no run's text is ever built.

The documents are scanned once. Their buckets, two bytes a feature, are stored, counted, and read again to be weighed by
the gains, one number a bucket. The counts, at most ``buckets`` of them, are all that meets at the driver.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.datasets import numbered
from .common import released, written

#: A-Z become a-z, what is in no word a space: of ASCII all but digits and letters.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
#: Parts texts in a block; no word holds it.
END = "\x01"


def bit_steps(c: np.ndarray, n: int) -> np.ndarray:
    """CRC registers after n zero bits."""
    for _ in range(n):
        c = (c >> 1) ^ np.where(c & 1, np.uint32(0xEDB88320), np.uint32(0))
    return c


def carried_by(table: np.ndarray, c: np.ndarray) -> np.ndarray:
    """CRCs carried by a table of shape (4, 256): what each byte of a register becomes."""
    return table[0, c & 255] ^ table[1, (c >> 8) & 255] ^ table[2, (c >> 16) & 255] ^ table[3, c >> 24]


class Carry:
    """CRC-32 values carried over zero bytes: tables for each number of bytes below ``short`` and for powers of two."""

    def __init__(self, short: int = 64):
        byte = np.arange(256, dtype=np.uint32)
        now = np.stack([byte << np.uint32(8 * k) for k in range(4)])
        own = [now]
        for _ in range(short - 1):
            now = bit_steps(now, 8)
            own.append(now)
        self.short, self.tables = short, np.stack(own)
        self.powers = [self.tables[1]]  # over 1, 2, 4 ... bytes
        while len(self.powers) < 40:
            self.powers.append(carried_by(self.powers[-1], self.powers[-1]))

    def over(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        low = np.where(n < self.short, n, 0)
        t = self.tables
        out = t[low, 0, crc & 255] ^ t[low, 1, (crc >> 8) & 255] ^ t[low, 2, (crc >> 16) & 255] ^ t[low, 3, crc >> 24]
        long = np.flatnonzero(n >= self.short)
        for k in range(int(n.max()).bit_length() if len(long) else 0):
            own = long[(n[long] >> k) & 1 == 1]
            out[own] = carried_by(self.powers[k], out[own])
        return out


def payloads(block: bytes) -> np.ndarray:
    """The payloads, length << 32 | CRC, of the words of a folded block in order; -1 where a text ends.

    The automaton is built for the block, so that its size follows the block's."""
    import ahocorasick

    own = ahocorasick.Automaton(ahocorasick.STORE_ANY)
    end = END.encode()
    for word in set(block.split()):
        own.add_word(f" {word.decode('latin-1')} ", -1 if word == end else len(word) << 32 | zlib.crc32(word))
    if not len(own):
        return np.zeros(0, dtype=np.int64)
    own.make_automaton()
    return np.fromiter(map(itemgetter(1), own.iter(f" {block.decode('latin-1')} ")), dtype=np.int64)


def parts_of(text: bytes, most: int) -> Iterator[bytes]:
    """A folded text in parts of at most ``most`` bytes, or of one word if that is longer."""
    at = 0
    while len(text) - at > most:
        cut = text.rfind(b" ", at, at + most)
        cut = text.find(b" ", at + most) if cut <= at else cut
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


class Features:
    """Buckets of the features of texts."""

    def __init__(self, buckets: int = 10_000, longest: int = 3, block: int = 1_000_000):
        if buckets > 65_536:
            raise ValueError("a bucket takes two bytes: 65536 buckets at most")
        self.buckets, self.longest, self.block, self.carry = buckets, longest, block, Carry()
        self.space = np.uint32(zlib.crc32(b" "))

    def runs(self, words: np.ndarray) -> list[np.ndarray]:
        """For runs of 1, 2 ... words, the bucket of the run that ends at each word; it may reach into the text before."""
        crc, n = (words & 0xFFFFFFFF).astype(np.uint32), words >> 32
        after = self.carry.over(np.full(len(crc), self.space), n) ^ crc  # of a space and the word
        out = [crc]
        for _ in range(self.longest - 1):
            run = out[-1].copy()
            run[1:] = self.carry.over(out[-1][:-1], n[1:] + 1) ^ after[1:]
            out.append(run)
        return [(x % np.uint32(self.buckets)).astype("<u2") for x in out]

    def of_texts(self, texts: list[bytes]) -> list[tuple[int, bytes]]:
        """For each text the number of its words and its features' buckets, as little-endian unsigned 16-bit numbers."""
        found: list[tuple[int, list[bytes]]] = [(0, []) for _ in texts]
        block: list[tuple[int, bytes]] = []
        size, before = 0, (-1, np.zeros(0, dtype=np.int64))
        for i, text in enumerate(texts):
            for part in parts_of(text.translate(FOLD), self.block):
                if size and size + len(part) > self.block:
                    before = self.add(block, before, found)
                    block, size = [], 0
                block.append((i, part))
                size += len(part) + 3
        if block:
            self.add(block, before, found)
        return [(n, b"".join(own)) for n, own in found]

    def add(self, block: list[tuple[int, bytes]], before: tuple[int, np.ndarray], found: list) -> tuple[int, np.ndarray]:
        """Add a block's features; its first part may go on with a text, whose last words ``before`` has. The last text and its
        last words."""
        own = payloads(f" {END} ".encode().join(part for _, part in block))
        ends = np.flatnonzero(own < 0)
        sizes = np.diff([-1, *ends.tolist(), len(own)]) - 1
        again = before[1] if before[0] == block[0][0] else before[1][:0]
        words = np.concatenate([again, np.delete(own, ends)])
        grams = self.runs(words) if len(words) else []
        at = len(again)
        for k, ((i, _), size) in enumerate(zip(block, sizes.tolist())):
            first = 0 if k == 0 else at  # runs don't reach before it
            n, features = found[i]
            features += [g[max(at, first + j) : at + size].tobytes() for j, g in enumerate(grams)]
            found[i] = (n + size, features)
            at += size
        rest = self.longest - 1
        last = sizes[-1] + (len(again) if len(block) == 1 else 0)
        return block[-1][0], words[len(words) - min(rest, last) :]


def hashed_features(rows: DataFrame, buckets: int = 10_000, longest: int = 3, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The kept columns, n_words, n_features and buckets (binary, two bytes a feature) of each text; a null text has none."""
    spec = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep]

    def scan(batches):
        own = Features(buckets, longest)
        for batch in batches:
            texts = batch.column(0).cast(pa.binary())
            step = max(1, min(len(texts), int(len(texts) * 8_000_000 / max(texts.nbytes, 1))))
            for at in range(0, len(texts), step):  # some megabytes of text at a time
                found = own.of_texts([t or b"" for t in texts.slice(at, step).to_pylist()])
                n, body = [x for x, _ in found], [x for _, x in found]
                out = [*[batch.column(k + 1).slice(at, step) for k in range(len(keep))], pa.array(n, pa.int64()), pa.array([len(x) // 2 for x in body], pa.int64()), pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays(out, names=[*keep, "n_words", "n_features", "buckets"])

    return rows.select(F.col(text_col).cast("string").alias("__text"), *keep).mapInArrow(released(scan), ", ".join([*spec, "n_words long", "n_features long", "buckets binary"]))


def bucket_counts(features: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How often each bucket occurs; every task sends its own sums."""

    def count(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            column = batch.column(0)
            for k in range(0, len(column), 256):
                body = b"".join(column.slice(k, 256).to_pylist())
                total += np.bincount(np.frombuffer(body, "<u2"), minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in features.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the smoothed target share of each bucket over its source share."""
    s, t, k = int(source.sum()), int(target.sum()), len(source)
    return np.array([math.floor(1000 * math.log((b + 1.0) * (s + k) / ((a + 1.0) * (t + k)))) for a, b in zip(source.tolist(), target.tolist())], dtype=np.int64)


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = 10_000, longest: int = 3, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs: rank is null for what isn't drawn.

    Of the rows with ``least_words`` words, the draw takes ``percent`` in a hundred, by score: the weight (sum of the
    gains of the features) plus Gumbel noise from a hash of the seed and the id, which makes it a draw without replacement.
    Ties go to the smaller id, a null id last; rows that repeat take ranks one after another. Null and empty texts have no
    features and weigh 0. Without target rows the gains come from the source alone; an empty table gives an empty result.
    """
    own = written(hashed_features(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), buckets, longest, keep=("doc_id",)))
    goal = hashed_features(target.select(F.col(text_col).alias("text")), buckets, longest)
    gains = gains_of(bucket_counts(own, buckets), bucket_counts(goal, buckets))

    def weigh(batches):
        for batch in batches:
            body = batch.column(batch.schema.get_field_index("buckets"))
            weight = [int(gains[np.frombuffer(x.as_buffer(), "<u2")].sum()) if len(x.as_buffer()) else 0 for x in body]
            out = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n_words", "n_features")]
            yield pa.RecordBatch.from_arrays([*out, pa.array(weight, pa.int64())], names=["doc_id", "n_words", "n_features", "weight"])

    weighed = own.mapInArrow(released(weigh), "doc_id long, n_words long, n_features long, weight long")
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = written(weighed.select("doc_id", "n_features", "weight", (F.col("weight") + noise).cast("long").alias("score"), (F.col("n_words") >= least_words).alias("fit")))
    take = percent * scored.where("fit").count() // 100
    placed = numbered(scored, [F.desc("fit"), F.desc("score"), F.asc_nulls_last("doc_id"), F.monotonically_increasing_id()], start=1, column="rank")
    drawn = F.col("fit") & (F.col("rank") <= take)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("rank")).alias("rank"))
