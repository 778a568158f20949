"""Prefix trie of conversations: what of the turns a training run could share, node by node.

A turn's identity is the SHA-256 (128 bits of it) of its role and text; a conversation is the string of its turns' digests.
Conversations are range-sorted by it, so that the members of every node lie side by side. Each range (a shard) encodes its
own trie as balanced parentheses. The excess of the parentheses is cut into blocks with a tree of their least values; a
search in it finds the parenthesis that closes a node and so delimits its subtree. Leaves are counted by the rank of
the pairs "()", members and savings are differences of cumulative arrays in the order of the parentheses.

A node whose members lie in several shards is a prefix of the last conversation of one and of the first of the next: the
shards' spines. Each shard gives its part of the nodes on its two spines, each pair of neighbours gives what they count
twice on the prefix that they share, and one aggregate by node adds all up. Everything else leaves its shard final.

Python holds one shard at a time. A shard has some ``turns`` turns, and one conversation is never split: the digests of its
turns (16 bytes each) must fit a task, its texts need not, they are hashed before the first shuffle. The driver gets the
numbers of the shards only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import released, shuffle_partitions, written

WIDTH = 16  # bytes of a turn's digest
EMPTY = hashlib.sha256(b"").hexdigest()
COUNTS = ("n_convs", "n_children", "n_leaves", "saved_tokens")
OUT = ("conv_id", "depth", "parent_conv_id", *COUNTS, "ends_sha256")
#: One row of a shard's result. kind: node, open (a part of a node on a spine), first and last (conversation), ends (ids, joined).
SCHEMA = pa.schema(
    [("kind", pa.string()), ("shard", pa.int32()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64())]
    + [(c, pa.int64()) for c in COUNTS]
    + [("ends_sha256", pa.string()), ("key", pa.string()), ("parent_key", pa.string()), ("path", pa.binary()), ("words", pa.list_(pa.int32())), ("ids", pa.binary())]
)
DDL = "kind string, shard int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key string, parent_key string, path binary, words array<int>, ids binary"


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the turns of each conversation in order, as structs of digest d (32 hex digits) and words w.

    Order: turn, null first; turns of one number by role and digest. A null role or text is empty. Rows without a conv_id
    belong to no conversation and go."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    turn = F.col("turn").cast("long")
    one = F.struct(turn.isNotNull().alias("numbered"), turn.alias("turn"), role.alias("role"), digest.alias("d"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("w"))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("t"))
    turns = F.transform(F.array_sort(F.collect_list("t")), lambda x: F.struct(x["d"].alias("d"), x["w"].alias("w")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def with_shared_starts(own: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """conv_id, turns: the first ``heads`` turns of conversation ``base`` (all if fewer, none if it is absent), then the
    conversation's own turns after its first ``heads``. ``most`` is the most that heads can be."""
    starts = own.select(F.col("conv_id").alias("__base"), F.slice("turns", 1, most).alias("__start"))
    both = own.withColumn("__base", base).join(starts, "__base", "left")
    start = F.coalesce("__start", F.slice("turns", 1, 0))
    return both.select("conv_id", F.concat(F.slice(start, F.lit(1), heads), F.slice("turns", heads + 1, F.size("turns"))).alias("turns"))


class ExcessBlocks:
    """The excess of a sequence of parentheses (1 opens, -1 closes), with the least value of each block and a binary tree
    of these values over the blocks."""

    def __init__(self, bits: np.ndarray, block: int = 64):
        self.block, self.excess = block, np.cumsum(bits, dtype=np.int64)
        far = np.iinfo(np.int64).max
        padded = np.full(-(-len(bits) // block) * block, far)
        padded[: len(bits)] = self.excess
        self.levels = [padded.reshape(-1, block).min(axis=1)]
        while len(self.levels[-1]) > 1:
            low = self.levels[-1]
            low = np.append(low, far) if len(low) % 2 else low
            self.levels[-1] = low
            self.levels.append(np.minimum(low[::2], low[1::2]))

    def scan(self, start: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first place at or after each start, in its block, whose excess is the target or less, or else the end of the
        block; and whether there is one."""
        at, end = start.copy(), np.minimum((start // self.block + 1) * self.block, len(self.excess))
        found, going = np.zeros(len(at), dtype=bool), np.arange(len(at))
        while len(going):
            hit = self.excess[at[going]] <= target[going]
            found[going[hit]] = True
            going = going[~hit]
            at[going] += 1
            going = going[at[going] < end[going]]
        return at, found

    def findclose(self, opens: np.ndarray) -> np.ndarray:
        """The place of the parenthesis that closes each of the given ones."""
        target = self.excess[opens] - 1
        at, found = self.scan(opens, target)
        later = np.flatnonzero(~found)  # closed in a later block
        node, level, aim = at[later] // self.block, np.zeros(len(later), dtype=np.int64), target[later]
        going = np.arange(len(later))
        for k, low in enumerate(self.levels):  # up: each node and, of a left child, the sibling
            hit = low[node[going]] <= aim[going]
            level[going[hit]] = k
            going = going[~hit]
            is_left = node[going] % 2 == 0
            sibling = going[is_left]
            node[sibling] += 1
            hit = low[node[sibling]] <= aim[sibling]
            level[sibling[hit]] = k
            going = np.concatenate([going[~is_left], sibling[~hit]])
            node[going] = (node[going] + 1) // 2
            if not len(going):
                break
        for k in range(len(self.levels) - 1, 0, -1):  # down to the first block
            own = np.flatnonzero(level == k)
            node[own] *= 2
            node[own] += self.levels[k - 1][node[own]] > aim[own]
            level[own] = k - 1
        at[later] = self.scan(node * self.block, aim)[0]
        return at


class Shard:
    """The trie of conversations that are sorted by their paths, as balanced parentheses in the order of a walk from the root.

    Nodes are numbered as they open; the root is 0. ``paths`` holds digests of WIDTH bytes, ``words`` a number for each."""

    def __init__(self, ids: np.ndarray, paths: pa.Array, words: pa.Array):
        self.ids = ids
        at = np.frombuffer(paths.buffers()[1], np.int32)[paths.offset : paths.offset + len(paths) + 1].astype(np.int64)
        self.digests = np.frombuffer(paths.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
        symbols = self.digests.view(np.uint64).reshape(-1, WIDTH // 8)
        self.start, self.length = (at[:-1] - at[0]) // WIDTH, np.diff(at) // WIDTH
        self.words = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        shared = np.concatenate([[0], self.shared_turns(symbols)])
        new = self.length - shared
        first = 1 + np.cumsum(new) - new  # the number of each conversation's first new node
        closed = np.concatenate([[0], self.length[:-1] - shared[1:]])
        runs = np.concatenate([[1], np.column_stack([closed, new]).ravel(), [self.length[-1] + 1]])
        bits = np.repeat(np.concatenate([[1], np.tile([-1, 1], len(ids)), [-1]]), runs)
        opens = np.flatnonzero(bits == 1)
        n = len(opens)
        owner = np.repeat(np.arange(len(ids)), new)
        place = np.arange(n - 1) - np.repeat(first - 1, new) + shared[owner]  # of each node's turn in its conversation
        self.depth = np.concatenate([[0], place + 1])
        self.word = np.concatenate([[0], self.words[self.start[owner] + place]])
        # a conversation's last node: its last new one, or that of the equal conversation before it
        self.end = np.maximum.accumulate(np.where(new > 0, first + new - 1, 0))
        close = ExcessBlocks(bits).findclose(opens)
        self.size = (close - opens + 1) // 2
        leaf = np.cumsum((bits[:-1] == 1) & (bits[1:] == -1))
        self.n_leaves = leaf[close - 1] - np.where(opens > 0, leaf[opens - 1], 0)
        here = np.arange(n)
        members = np.concatenate([[0], np.cumsum(np.bincount(self.end, minlength=n))])
        self.member = members[:-1]  # the first member's place among the conversations
        self.n_convs = members[here + self.size] - members[here]
        saved = np.concatenate([[0], np.cumsum((self.n_convs - 1) * self.word)])
        self.saved = saved[here + self.size] - saved[here]
        spans = np.column_stack([self.member, self.member + self.n_convs]).ravel()
        self.conv_id = np.minimum.reduceat(np.append(ids, np.iinfo(np.int64).max), spans)[::2]
        by_depth = np.lexsort((here, self.depth))  # the parent is the last node one level up that opened before
        keys = self.depth[by_depth] * n + by_depth
        self.parent = by_depth[np.maximum(np.searchsorted(keys, (self.depth - 1) * n + here) - 1, 0)]
        self.n_children = np.bincount(self.parent[1:], minlength=n)

    def shared_turns(self, symbols: np.ndarray) -> np.ndarray:
        """How many turns each conversation shares with the one before it, from the second on."""
        least = np.minimum(self.length[1:], self.length[:-1])
        owner = np.repeat(np.arange(len(least)), least)
        j = np.arange(len(owner)) - np.repeat(np.cumsum(least) - least, least)
        differs = np.flatnonzero((symbols[self.start[1:][owner] + j] != symbols[self.start[:-1][owner] + j]).any(axis=1))
        out = least.copy()
        who, where = np.unique(owner[differs], return_index=True)
        out[who] = j[differs[where]]
        return out

    def path(self, conversation: int) -> bytes:
        at = self.start[conversation] * WIDTH
        return self.digests[at : at + self.length[conversation] * WIDTH].tobytes()


def prefix_keys(path: bytes) -> list[str]:
    """A key for each prefix of a path, the empty one first."""
    own, out = hashlib.sha256(), []
    for at in range(0, len(path) + 1, WIDTH):
        out.append(own.hexdigest())
        own.update(path[at : at + WIDTH])
    return out


def shard_rows(shard: int, trie: Shard, most_ids: int) -> Iterator[pa.RecordBatch]:
    """The rows of SCHEMA that a shard gives."""
    n, last = len(trie.depth), len(trie.ids) - 1
    here = np.arange(n)
    keys = np.full(n, None, dtype=object)
    for c in (0, last):  # the spines: the nodes that hold the first, and the last, conversation
        spine = np.flatnonzero((here <= trie.end[c]) & (here + trie.size > trie.end[c]))
        keys[spine] = prefix_keys(trie.path(c))
    opened = keys.astype(bool)
    at = np.flatnonzero(np.diff(trie.end, prepend=-1))  # equal conversations lie side by side
    text = [b"%d" % x for x in trie.ids.tolist()]
    ends = np.full(n, EMPTY, dtype=object)
    pending = []
    for lo, hi in zip(at.tolist(), [*at[1:].tolist(), last + 1]):
        if lo == 0 or hi > last:  # the same conversation may go on in the next shard
            ends[trie.end[lo]] = None
            pending += [(keys[trie.end[lo]], int(trie.ids[k]), b",".join(text[k : min(k + most_ids, hi)])) for k in range(lo, hi, most_ids)]
        else:
            ends[trie.end[lo]] = hashlib.sha256(b",".join(text[lo:hi])).hexdigest()
    parent_known = ~opened[trie.parent]
    root = here == 0

    def batch(kind: list, size: int, **columns) -> pa.RecordBatch:
        whole = {"kind": kind, "shard": [shard] * size} | columns
        return pa.RecordBatch.from_arrays([pa.array(whole[f.name], f.type, from_pandas=True) if f.name in whole else pa.nulls(size, f.type) for f in SCHEMA], schema=SCHEMA)

    yield batch(
        np.where(opened, "open", "node"), n, conv_id=trie.conv_id, depth=trie.depth, parent_conv_id=pa.array(trie.conv_id[trie.parent], mask=~parent_known | root), n_convs=trie.n_convs, n_children=trie.n_children,
        n_leaves=trie.n_leaves, saved_tokens=trie.saved, ends_sha256=ends, key=keys, parent_key=np.where(root, None, keys[trie.parent]),
    )
    yield batch(["first", "last"], 2, path=[trie.path(0), trie.path(last)], words=[trie.words[trie.start[c] : trie.start[c] + trie.length[c]] for c in (0, last)])
    if pending:
        k, i, t = zip(*pending)
        yield batch(["ends"] * len(k), len(k), key=k, conv_id=i, ids=t)


def counted_twice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For neighbouring shards, what the nodes on the prefix shared by the last and the first conversation count twice.

    Savings take one member off each node in each shard, so that a node's words on the shared prefix are missing once, for
    itself and for all above it. A shared child counts twice. The end of the shared prefix counts as a leaf too much where
    the first shard has nothing below it."""
    for b in batches:
        rows: list[tuple] = []
        for left, right, words in zip(b.column("path").to_pylist(), b.column("next").to_pylist(), b.column("words").to_pylist()):
            most = min(len(left), len(right)) // WIDTH
            d = next((k for k in range(most) if left[WIDTH * k : WIDTH * (k + 1)] != right[WIDTH * k : WIDTH * (k + 1)]), most)
            below = np.append(np.cumsum(np.array(words[:d], dtype=np.int64)[::-1])[::-1], 0)  # words at each depth after, down to d
            leaf = -1 if len(left) == WIDTH * d else 0
            rows += [(key, k, -1 if k < d else 0, leaf, int(below[max(k - 1, 0)] if d else 0)) for k, key in enumerate(prefix_keys(left[: WIDTH * d]))]
        names = ("key", "depth", "n_children", "n_leaves", "saved_tokens")
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)


def hashed_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's ids, which come in order, part by part; one digest is open at a time."""
    now, own, out = None, None, []
    for b in batches:
        for key, ids in zip(b.column("key").to_pylist(), b.column("ids").to_pylist()):
            if key != now:
                out += [(now, own.hexdigest())] if own else []
                now, own = key, hashlib.sha256(ids)
            else:
                own.update(b",")
                own.update(ids)
    out += [(now, own.hexdigest())] if own else []
    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["key", "whole"])


def prefix_trie(paths: DataFrame, turns: int = 200_000, most_ids: int = 50_000) -> DataFrame:
    """The nodes of the trie of all conversations: the columns of OUT.

    ``paths``: conv_id (long, each once), path (binary, WIDTH bytes a turn), words (array<int>, a number a turn). An
    empty table has no nodes; a conversation without turns is a member of the root."""
    spark = paths.sparkSession
    paths = written(paths.select("conv_id", "path", "words"))
    total = paths.agg(F.sum(F.size("words") + 1)).first()[0] or 0
    shards = max(shuffle_partitions(spark), -(-total // turns))

    def encode(batches):
        own = [b for b in batches if b.num_rows]
        if own:
            whole = pa.Table.from_batches(own)
            one = [c.combine_chunks() for c in (whole.column("conv_id"), whole.column("path"), whole.column("words"))]
            one = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in one]
            yield from shard_rows(TaskContext.get().partitionId(), Shard(one[0].to_numpy(), one[1], one[2]), most_ids)

    # Equal conversations are split over shards too, by their ids.
    ranged = paths.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    rows = written(ranged.mapInArrow(released(encode), DDL))
    kind = lambda *names: rows.where(F.col("kind").isin(*names))

    there = sorted(r["shard"] for r in kind("last").select("shard").collect())  # a number for each shard
    after = spark.createDataFrame(list(zip(there, there[1:])), "shard int, after int")
    pairs = kind("last").select("shard", "path", "words").join(F.broadcast(after), "shard")
    pairs = pairs.join(kind("first").select(F.col("shard").alias("after"), F.col("path").alias("next")), "after").select("path", "words", "next")
    twice = pairs.mapInArrow(counted_twice, "key string, depth long, n_children long, n_leaves long, saved_tokens long")

    parts = kind("open").unionByName(twice, allowMissingColumns=True)
    ends = kind("ends").select("key", "conv_id", "ids").repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(hashed_ends, "key string, whole string")
    sums = parts.groupBy("key", "depth").agg(
        F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in COUNTS],
        F.max(F.when(F.col("ends_sha256") != EMPTY, F.col("ends_sha256"))).alias("__own"), F.max("parent_key").alias("parent_key"),
    )
    spines = written(sums.join(ends, "key", "left").withColumn("ends_sha256", F.coalesce("whole", "__own", F.lit(EMPTY))))
    found = spines.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    of_spines = spines.join(found, "parent_key", "left").select(*OUT)
    # The children of a spine's nodes meet their parent's smallest member shard by shard, so that the root's don't all meet in one task.
    local = kind("open").select("shard", F.col("key").alias("parent_key")).join(found, "parent_key")
    beside = kind("node").where("parent_key IS NOT NULL").drop("parent_conv_id").join(local, ["shard", "parent_key"]).select(*OUT)
    return kind("node").where("parent_key IS NULL").select(*OUT).union(beside).union(of_spines)


def trie_query(conversations: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Nodes of the trie of the conversations, each rebuilt to start with turns of another: of conversation c those of
    c - c % every (the sign of c's), as many as the CRC-32 of c's digits modulo ``heads`` says."""
    own = written(turn_digests(conversations))
    n = F.crc32(F.col("conv_id").cast("string")) % heads
    rebuilt = with_shared_starts(own, F.col("conv_id") - F.col("conv_id") % every, n.cast("int"), heads - 1)
    path = F.unhex(F.array_join(F.transform("turns", lambda t: t["d"]), ""))
    return prefix_trie(rebuilt.select("conv_id", path.alias("path"), F.transform("turns", lambda t: t["w"]).alias("words")))
