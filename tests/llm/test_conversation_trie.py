"""The prefix trie against a trie of nested dictionaries."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from boxloom.llm import conversation_trie as ct
from boxloom.llm.queries import QUERIES

from . import fixtures as fx

KIND = "conv_id long, turn long, role string, text string, key string, path string, shard int, depth long"


def nodes_of(sequences):
    """Brute force: {conversation: tuple of (turn, words)} -> a multiset of OUT rows."""
    members = {}
    for c, seq in sequences.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = Counter(k[:-1] for k in members if k)
    leaves, saved = Counter(), Counter()
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not children[k]
            saved[k[:d]] += (len(m) - 1) * (k[-1][1] if k else 0)
    out = Counter()
    for k, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(sequences[c]) == len(k))))
        out[min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def rebuilt(rows):
    """Brute force of the query's rule over (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own.setdefault(c, []).append(((turn is not None, turn or 0, role, digest), (digest, len(re.findall(r"[^\x20\x09-\x0D]+", text)))))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    out = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = tuple(own.get(c - int(np.fmod(c, 20)), [])[:h] + seq[h:])
    return out


def got(df):
    return Counter(tuple(r[c] for c in ct.OUT) for r in df.collect())


def random_sequences(seed, n=120, letters=3, most=6):
    rng = random.Random(seed)
    out = {c: tuple((rng.randrange(letters), 0) for _ in range(rng.randint(0, most))) for c in rng.sample(range(-50, 1000), n)}
    return {c: tuple((t, t + 1) for t, _ in s) for c, s in out.items()}


def encoded(seq):
    return b"".join(hashlib.md5(b"%d" % t).digest() for t, _ in seq)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1), max_size=400), st.sampled_from([1, 2, 4, 64]))
def test_findclose(walk, block):
    bits, depth = [1], 1
    for up in walk:  # a walk that never closes the root
        if up or depth == 1:
            bits.append(1)
            depth += 1
        else:
            bits.append(-1)
            depth -= 1
    bits += [-1] * depth
    want, stack = {}, []
    for i, b in enumerate(bits):
        if b == 1:
            stack.append(i)
        else:
            want[stack.pop()] = i
    opens = np.array(sorted(want))
    assert ct.ExcessBlocks(np.array(bits), block).findclose(opens).tolist() == [want[i] for i in opens.tolist()]


@pytest.mark.parametrize("seed", range(8))
def test_one_shard(seed):
    seqs = random_sequences(seed)
    order = sorted(seqs, key=lambda c: (encoded(seqs[c]), c))
    trie = ct.Shard(np.array(order), pa.array([encoded(seqs[c]) for c in order], pa.binary()), pa.array([[w for _, w in seqs[c]] for c in order], pa.list_(pa.int32())))
    mine = Counter(zip(trie.conv_id.tolist(), trie.depth.tolist(), trie.n_convs.tolist(), trie.n_children.tolist(), trie.n_leaves.tolist(), trie.saved.tolist()))
    want = Counter()
    for (c, d, _, n, ch, lf, sv, _), k in nodes_of(seqs).items():
        want[c, d, n, ch, lf, sv] += k
    assert mine == want


@pytest.mark.parametrize("seed", range(3))
def test_spines_of_many_shards_merge(spark, seed):
    """Few turns, many equal conversations, shards of a few rows, parts of two ids."""
    seqs = random_sequences(seed, n=200, letters=2, most=4 + 3 * seed)
    seqs |= {2000 + i: seqs[next(iter(seqs))] for i in range(90)}  # a large group of copies
    df = spark.createDataFrame([(c, bytearray(encoded(s)), [w for _, w in s]) for c, s in seqs.items()], "conv_id long, path binary, words array<int>")
    assert got(ct.prefix_trie(df, turns=40, most_ids=2)) == nodes_of(seqs)


def test_query_on_odd_rows(spark):
    rng = random.Random(5)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice([None, "", "hello there", "yes", "no \n no", "long " * 5000])) for c in range(130) for t in range(rng.randint(0, 5))]
    rows += [(c, None, "system", "be kind") for c in range(0, 130, 3)]
    rows += [(7, 2, "user", "again"), (7, 2, "user", "again"), (7, 2, "tool", "a"), (None, 1, "user", "x"), (-41, 0, "user", "hello there"), (-41, None, None, None)]  # repeated turns, null and negative ids
    rows += [(500, t, "user", f"turn {t % 3}") for t in range(300)] + [(501, t, "user", f"turn {t % 3}") for t in range(290)]  # long ones
    rows += [(1000 + c, 0, "user", "the same") for c in range(200)]  # copies
    df = spark.createDataFrame([(*r, "k", "p", 1, 2) for r in rows], KIND)
    assert got(ct.trie_query(df)) == nodes_of(rebuilt(rows))
    assert ct.trie_query(df.where(F.lit(False))).count() == 0
    only_null = spark.createDataFrame([(None, 1, "user", "x", "k", "p", 1, 2)], KIND)
    assert ct.trie_query(only_null).count() == 0


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{fx.SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(QUERIES["op11_conversation_trie"](spark, fx.SF)) == nodes_of(rebuilt(rows))
