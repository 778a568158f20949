"""LM scoring with an interpolated modified Kneser-Ney bigram model (Chen and Goodman, 1998).

Counting runs in Spark in two grouped steps, on arrays of 64-bit hashes rather than on rows of strings:

1. Input partitions count their bigrams, slice by slice, and send each hash range its part of the sorted bigrams. A
   bigram's range depends on both words, so no word, however common, fills one task. A range has a task of its own, which
   merges the counts run by run and writes the bigrams as a sorted hash array with a parallel array of counts. There is a
   range for every ``RANGE_BYTES`` of text, so a range's task holds as much of a large corpus as of a small one.
2. The ranges send what they know of each word (occurrences, distinct predecessors, followers seen once, twice and
   more) to the word's own range, which sums it and writes sorted arrays for the words.

The arrays lie in the cluster's shared folder (``spark.checkpoint.dir``), one set of files for each hash range; their
size follows the corpus and nothing of it is broadcast or held by the driver, which only adds up a few totals for each
range. Scoring tasks memory-map the files and look up the sorted distinct hashes of a slice of tokens at a time. The
folder must be a path that executors can open, such as a network mount.

Files are written under another name and renamed, so a task that runs twice leaves the same file.
"""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint_dir, released, shuffle_partitions

#: Hashes of the start and the end, apart from any word's.
START, END = np.uint64(xxhash.xxh64_intdigest(b"\0start")), np.uint64(xxhash.xxh64_intdigest(b"\0end"))
SLICE = 800_000
#: Text for one hash range, and entries that a range's task merges at once.
RANGE_BYTES, RUN = 16 << 20, 2_000_000
WORD_FIELDS = ("c", "cont", "n1", "n2", "n3")
#: Files that a scoring task keeps mapped; systems allow some 65,000 maps a process.
MAPS = 4096


class Hashes(dict):
    """XXH64 of a word; a bounded cache."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The hash of a bigram of word hashes; their order matters."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x7F4A7C15F39CC060) + (a >> np.uint64(7)))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


def of_range(h: np.ndarray, ranges: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(ranges) >> np.uint64(32)).astype(np.int64)


def slices(texts: pa.Array, hashes: Hashes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word hashes of whole documents, each with its end, in a row; lengths), some SLICE tokens at a time."""
    words: list[np.ndarray] = []
    total = 0
    for text in texts:
        own = (text.as_py() or "").encode("utf-8", "replace").lower().split()
        words.append(np.append(np.array([hashes[w] for w in own], dtype=np.uint64), END))
        total += len(own) + 1
        if total >= SLICE:
            yield np.concatenate(words), np.array([len(w) for w in words])
            words, total = [], 0
    if words:
        yield np.concatenate(words), np.array([len(w) for w in words])


def before(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each token's predecessor."""
    out = np.empty_like(tokens)
    out[1:] = tokens[:-1]
    out[np.concatenate(([0], np.cumsum(lengths)[:-1]))] = START
    return out


def sum_by(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sums of their values, and where each key stood first."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, dtype=bool)
    at = np.flatnonzero(first)
    return keys[at], np.add.reduceat(values[order], at, axis=0) if len(at) else values[:0], order[at]


def put(folder: str, name: str, array: np.ndarray) -> None:
    own = f"{folder}/{name}.{uuid.uuid4().hex}"
    with open(own, "wb") as f:
        np.save(f, array)
    os.replace(own, f"{folder}/{name}.npy")


def packed(h: np.ndarray) -> bytes:
    """Sorted hashes as compressed differences, byte planes apart."""
    planes = np.diff(h, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    return len(h).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    planes = np.frombuffer(pa.decompress(b[8:], 8 * n, codec="zstd", asbytes=True), np.uint8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def narrow(counts: np.ndarray) -> np.ndarray:
    most = counts.max(initial=0)
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint64)


def local_path(uri: str) -> str:
    parts = urlparse(uri)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"workers memory-map the model, so model_dir must be a folder that they can open, not {uri}")
    return parts.path


def discounts(t: list[int]) -> tuple[float, float, float]:
    """The modified Kneser-Ney discounts from the numbers of items seen once to four times."""
    t1, t2, t3, t4 = (float(x) for x in t)
    if not (t1 and t2):
        return 0.5, 0.75, 0.75
    y = t1 / (t1 + 2 * t2)
    d = (1 - 2 * y * t2 / t1, 2 - 3 * y * t3 / t2, 3 - 4 * y * t4 / t3 if t3 else 1.5)
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


class KneserNey:
    """A trained model: its folder, the number of hash ranges, and the corpus totals."""

    def __init__(self, folder: str, ranges: int, totals: dict[str, int]):
        self.folder, self.ranges, self.totals = folder, ranges, totals
        self.high = discounts([totals[f"t{k}"] for k in range(1, 5)])
        self.low = discounts([totals[f"u{k}"] for k in range(1, 5)])

    def open(self, most: int = MAPS) -> "KneserNey":
        """For a worker: map the files on first use, and keep at most so many mapped, those used last."""
        self.maps: OrderedDict[str, np.ndarray] = OrderedDict()
        self.most = most
        return self

    def array(self, name: str) -> np.ndarray:
        if name in self.maps:
            self.maps.move_to_end(name)
            return self.maps[name]
        own = self.maps[name] = np.load(f"{self.folder}/{name}.npy", mmap_mode="r")
        if len(self.maps) > self.most:
            self.maps.popitem(last=False)  # unmapped once no array refers to it
        return own

    def look(self, kind: str, fields: tuple[str, ...], h: np.ndarray) -> list[np.ndarray]:
        """The fields' values for the sorted hashes; 0 where a hash isn't there."""
        out = [np.zeros(len(h), dtype=np.int64) for _ in fields]
        cuts = np.searchsorted(of_range(h, self.ranges), np.arange(self.ranges + 1))
        for r in np.flatnonzero(np.diff(cuts)):
            keys, own = self.array(f"{kind}-{r}-keys"), h[cuts[r] : cuts[r + 1]]
            if len(keys):
                at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                there = keys[at] == own
                for o, f in zip(out, fields):
                    o[cuts[r] : cuts[r + 1]] = np.where(there, self.array(f"{kind}-{r}-{f}")[at], 0)
        return out

    def log10(self, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each token: is it known, its smoothed unigram log10, and its Kneser-Ney log10 after its predecessor."""
        t, prev = self.totals, before(tokens, lengths)
        words, at = np.unique(np.concatenate((tokens, prev)), return_inverse=True)
        c, cont, n1, n2, n3 = self.look("word", WORD_FIELDS, words)
        w, v = at[: len(tokens)], at[len(tokens) :]
        pairs, pair_at = np.unique(mix(prev, tokens), return_inverse=True)
        (pair_n,) = self.look("bigram", ("n",), pairs)
        size, types = t["words"], t["types"]
        d = np.array([0.0, *self.low])
        rest = (self.low[0] * t["u1"] + self.low[1] * t["u2"] + self.low[2] * (size - t["u1"] - t["u2"])) / types if types else 1.0
        p1 = (np.maximum(cont - d[np.minimum(cont, 3)], 0) / types if types else 0.0) + rest / (size + 1)
        d = np.array([0.0, *self.high])
        seen = np.where(words == START, t["docs"], c)
        free = self.high[0] * n1 + self.high[1] * n2 + self.high[2] * n3
        n = pair_n[pair_at]
        total = np.maximum(seen[v], 1)
        p = np.where(seen[v] > 0, np.maximum(n - d[np.minimum(n, 3)], 0) / total + free[v] / total * p1[w], p1[w])
        base = np.log10((c[w] + 0.5) / (t["tokens"] + 0.5 * (size + 1)))
        return c[w] > 0, base, np.log10(p)


def train(docs: DataFrame, text_col: str = "text", model_dir: str | None = None) -> KneserNey:
    """Count whole texts (null is empty) and write the model to a new folder below model_dir (default: the shared one)."""
    spark = docs.sparkSession
    folder = f"{local_path(model_dir or checkpoint_dir(spark))}/kneser-ney-{uuid.uuid4().hex}"
    os.makedirs(folder)
    atexit.register(shutil.rmtree, folder, True)
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    ranges = max(shuffle_partitions(spark), -(-size // RANGE_BYTES))
    blobs = pa.schema([("range", pa.int32())] + [(f"b{k}", pa.binary()) for k in range(4)])
    kinds = "range int, b0 binary, b1 binary, b2 binary, b3 binary"

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({n: [x[i] for x in rows] for i, n in enumerate(blobs.names)}, schema=blobs)

    def count(batches):
        hashes = Hashes()
        for part in batches:
            for tokens, lengths in slices(part.column(0), hashes):
                prev = before(tokens, lengths)
                keys, n, first = sum_by(mix(prev, tokens), np.ones(len(tokens), dtype=np.int64))
                v, w = prev[first], tokens[first]
                cuts = np.searchsorted(of_range(keys, ranges), np.arange(ranges + 1))
                rows = []
                for r in np.flatnonzero(np.diff(cuts)):
                    own = slice(cuts[r], cuts[r + 1])
                    uv, iv = np.unique(v[own], return_inverse=True)  # each hash once; the bigrams refer to it
                    uw, iw = np.unique(w[own], return_inverse=True)
                    index = [narrow(x) for x in (iv, iw, n[own])]
                    sizes = np.array([len(iv), *[x.itemsize for x in index]], dtype=np.int64)
                    rows.append((int(r), packed(uv), packed(uw), pa.compress(b"".join([x.tobytes() for x in index]), codec="zstd", asbytes=True), sizes.tobytes()))
                yield batch(rows)

    def blobs_of(batches) -> Iterator[tuple[bytes, ...]]:
        for part in batches:
            yield from zip(*[part.column(f"b{k}").to_pylist() for k in range(4)])

    def bigrams(batches):
        r, run, size = TaskContext.get().partitionId(), [], 0
        empty = np.zeros(0, dtype=np.uint64)
        v, w, n = empty, empty, np.zeros(0, dtype=np.int64)

        def merged():
            v, w, n = (np.concatenate(x) for x in zip(*run))
            keys, n, first = sum_by(mix(v, w), n)
            return keys, v[first], w[first], n

        for b0, b1, b2, b3 in blobs_of(batches):
            count, *sizes = np.frombuffer(b3, np.int64).tolist()
            raw, at = pa.decompress(b2, count * sum(sizes), codec="zstd", asbytes=True), count * np.cumsum([0, *sizes])
            iv, iw, c = (np.frombuffer(raw[a:b], f"u{s}") for a, b, s in zip(at, at[1:], sizes))
            run.append((unpacked(b0)[iv], unpacked(b1)[iw], c.astype(np.int64)))
            size += len(c)
            if size >= RUN:  # what is merged so far is the next run's first part
                run, size = [merged()[1:]], 0
        if not run:
            return
        keys, v, w, n = merged()
        run.clear()
        put(folder, f"bigram-{r}-keys", keys)
        put(folder, f"bigram-{r}-n", narrow(n))
        # by word: occurrences, predecessors; by predecessor: followers seen once, twice, more often
        zero = np.zeros(len(n), dtype=np.int64)
        words, sums, _ = sum_by(
            np.concatenate((w, v)),
            np.concatenate((np.stack((n, zero + 1, zero, zero, zero), 1), np.stack((zero, zero, n == 1, n == 2, n >= 3), 1))),
        )
        totals = np.array([(n == k).sum() for k in range(1, 5)], dtype=np.int64)
        cuts = np.searchsorted(of_range(words, ranges), np.arange(ranges + 1))
        rows = []
        for q in range(ranges):
            own = slice(cuts[q], cuts[q + 1])
            if cuts[q] < cuts[q + 1] or q == r:
                raw = sums[own].T.astype(np.uint64).tobytes()
                rows.append((q, packed(words[own]), pa.compress(raw, codec="zstd", asbytes=True), str(len(raw)).encode(), totals.tobytes() if q == r else b""))
        yield batch(rows)

    names = ["range", "words", "tokens", "types", "docs", *[f"u{k}" for k in range(1, 5)], *[f"t{k}" for k in range(1, 5)]]

    def words(batches):
        r = TaskContext.get().partitionId()
        keys, values, totals = [], [], np.zeros(4, dtype=np.int64)
        for b0, b1, b2, b3 in blobs_of(batches):
            raw = pa.decompress(b1, int(b2), codec="zstd", asbytes=True) if int(b2) else b""
            keys.append(unpacked(b0))
            values.append(np.frombuffer(raw, np.uint64).reshape(5, -1).T.astype(np.int64))
            totals += np.frombuffer(b3, np.int64) if b3 else 0
            if sum(map(len, keys)) >= RUN:
                h, sums, _ = sum_by(np.concatenate(keys), np.concatenate(values))
                keys, values = [h], [sums]
        if not keys:
            return
        h, sums, _ = sum_by(np.concatenate(keys), np.concatenate(values))
        put(folder, f"word-{r}-keys", h)
        for k, f in enumerate(WORD_FIELDS):
            put(folder, f"word-{r}-{f}", narrow(sums[:, k]))
        c, cont = sums[:, 0], sums[:, 1]
        out = [r, (c > 0).sum(), c.sum(), cont.sum(), c[h == END].sum(), *[(cont == k).sum() for k in range(1, 5)], *totals]
        yield pa.RecordBatch.from_pydict({n: pa.array([int(x)], pa.int64()) for n, x in zip(names, out)})

    for r in range(ranges):  # ranges that no word or bigram falls into have empty arrays
        for kind, fields in (("bigram", ("n",)), ("word", WORD_FIELDS)):
            put(folder, f"{kind}-{r}-keys", np.zeros(0, dtype=np.uint64))
            for f in fields:
                put(folder, f"{kind}-{r}-{f}", np.zeros(0, dtype=np.uint8))
    rows = (
        docs.select(F.col(text_col).alias("text"))
        .mapInArrow(released(count), kinds)
        .repartitionById(ranges, "range")
        .mapInArrow(released(bigrams), kinds)
        .repartitionById(ranges, "range")
        .mapInArrow(released(words), ", ".join(f"{n} long" for n in names))
        .collect()  # a few totals for each hash range
    )
    return KneserNey(folder, ranges, {n: sum(x[n] for x in rows) for n in names[1:]})


def score(docs: DataFrame, model: KneserNey, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row.

    A null text is empty: its end is its one token. Null ids stay null; repeated rows are scored each; an empty table
    gives an empty result. A model of no documents gives every token the same chance.
    """

    def run(batches):
        own, hashes = model.open(), Hashes()
        for part in batches:
            at = 0
            for tokens, lengths in slices(part.column(1), hashes):
                known, base, high = own.log10(tokens, lengths)
                start = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                n = len(lengths)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).slice(at, n),
                        pa.array(lengths.astype(np.int64)),
                        pa.array(np.add.reduceat(known.astype(np.int64), start)),
                        pa.array(np.full(n, own.totals["tokens"], dtype=np.int64)),
                        pa.array(np.add.reduceat(base, start)),
                        pa.array(np.add.reduceat(high, start)),
                    ],
                    names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )
                at += n

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        released(run), "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    )


def lm_query(docs: DataFrame, held_out: Column) -> DataFrame:
    """Score all documents with a model of those that aren't held out."""
    model = train(docs.where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
