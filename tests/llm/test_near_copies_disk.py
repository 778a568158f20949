"""What the near-dedup stage leaves on disk, and what it verifies on texts."""

import random

from boxloom.llm import near_copies as nc
from boxloom.tables import shuffles_removed

from .test_near_copies import near_copies

CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_mb(spark):
    """MB of shuffle files that this session has on disk."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (files.apply(i) for i in range(files.size())) if f.getName().startswith("shuffle_")) / 1e6


def families(spark):
    texts = near_copies(5, 5, 20)
    return spark.createDataFrame(list(zip(range(len(texts)), range(len(texts)), texts)), "key long, id long, text string").coalesce(1)


def test_groups_leave_no_shuffle_files(spark):
    rows = families(spark)
    before, conf = shuffle_mb(spark), spark.conf.get(CONF)
    nc.near_copy_groups(rows)
    assert shuffle_mb(spark) - before < 0.005
    assert spark.conf.get(CONF) == conf


def test_the_setting_is_restored_after_an_error(spark):
    before = spark.conf.get(CONF)
    try:
        with shuffles_removed(spark):
            assert spark.conf.get(CONF) == "true"
            raise KeyError
    except KeyError:
        pass
    assert spark.conf.get(CONF) == before


def test_texts_are_not_joined_to_pairs_that_fine_sketches_tell_apart(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    base = [word() for _ in range(4000)]

    def edited(n):
        own = base[:]
        for i in rng.sample(range(4000), n):
            own[i] = word()
        return nc.shingles(" ".join(own))

    sets = [nc.shingles(" ".join(base)), edited(30), edited(40), edited(400), edited(500)]
    texts = spark.createDataFrame([(i, len(s), nc.sketch(s, nc.FINE).tobytes()) for i, s in enumerate(sets)], "node long, n long, fine binary")
    pairs = [(a, b) for a in range(5) for b in range(a + 1, 5)]
    near = {(a, b) for a, b in pairs if nc.is_near(sets[a], sets[b])}
    got = {(r["a"], r["b"]) for r in nc.unlike(spark.createDataFrame(pairs, "a long, b long"), texts).collect()}
    assert near <= got < set(pairs) and len(near) >= 3
    # the short sketch keeps pairs of such long texts
    coarse = [nc.sketch(s) for s in sets]
    apart = sum(int(x).bit_count() for x in (coarse[3] ^ coarse[4]).view("uint64"))
    assert (3, 4) not in got and apart * 9 <= len(sets[3]) + len(sets[4])
