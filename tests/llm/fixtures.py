"""A small documents table with nulls, empty and long texts, ties, repeated rows and columns with clashing names."""

import random
import re
import zlib

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
KIND = "doc_id long, text string, lang string, source string, n_chars long, key string, fp string, score string, __key string"


def rows(n=60, seed=3):
    rng = random.Random(seed)
    words = "the of and river stone light window Over under seldom often green thing maker's 12 x7 é über".split()
    out = []
    for i in range(n):
        text = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(1, 5)))
        if i % 7 == 0:
            text += "\nShared closing line number 5 of all"
        if i % 11 == 0:
            text += f'\npassword: "abc{i}defg" AKIA{"Q7" * 9} 0123456789abcdef0123456789'
        out.append((i, text))
    out += [(100 + i, out[i][1]) for i in range(8)]  # exact copies
    out += [(200, ""), (201, None), (202, "   \t\n "), (203, "word"), (204, "a b"), (205, "long " * 9000 + "end"), (206, "long  " * 9000 + "end")]
    out += [(None, "no id here"), (None, None), (5, out[5][1]), (203, "word")]  # null ids, repeated rows
    return out


def table(spark, data=None):
    data = rows() if data is None else data
    return spark.createDataFrame([(i, t, "en", "s", None, "k", "f", "s", "z") for i, t in data], KIND)


def empty(spark):
    return table(spark, []).where(F.lit(False))


def remainder(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
