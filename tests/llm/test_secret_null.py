"""The battery of the secret scan on small corpora and in every encoding."""

import random

import pytest

from boxloom.llm import secret_scan as ss

from . import fixtures as fx

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ALPHABETS = {"base32": LETTERS + "234567", "alnum36": LETTERS.lower() + "0123456789", "base62": LETTERS + LETTERS.lower() + "0123456789", "hex": "0123456789ABCDEF"}
NAMES = ["ImageButtonControllerFactory2Builder", "com/example/service2/handler/library", "SECONDARYWINDOWPACKAGEMANAGER22", "simplemessagehandlerversion1234release"]


@pytest.mark.parametrize("enc", sorted(ALPHABETS))
def test_few_documents_without_long_words(spark, enc):
    rng = random.Random(enc)
    data = [(i, "see " + "".join(rng.choice(ALPHABETS[enc]) for _ in range(48)) + " here") for i in range(20)]
    data += [(100 + i, f"the {n} of it") for i, n in enumerate(NAMES)]
    found = {r["doc_id"] for r in ss.secret_query(fx.table(spark, data)).where("spans like '%random%'").collect()}
    assert len(found & set(range(20))) >= 16 and not found & set(range(100, 104))


def test_one_document(spark):
    data = [(1, "key K7QZ2MXA5RT3VBN6WY4HLC2JD7PE3UGS5FOI2QXK6ZTA end")]
    assert ss.secret_query(fx.table(spark, data)).where("spans like '%random%'").count() == 1


def test_injected_tokens_are_found_in_a_real_corpus(spark):
    rng = random.Random(40)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{fx.SF}/documents.parquet").collect()]
    encodings = sorted(ALPHABETS)
    made = [(10**6 + i, f"{t} key {''.join(rng.choice(ALPHABETS[encodings[i % 4]]) for _ in range(40))} end") for i, (_, t) in enumerate(docs[:120])]
    found = {r["doc_id"] for r in ss.secret_query(fx.table(spark, docs + made)).where("spans like '%random%'").collect()}
    assert len(found & {i for i, _ in made}) >= 108 and not found & {i for i, _ in docs}


def test_statistics_against_plain_versions():
    """The four statistics, written out, for random tokens; and few random tokens look unlike their encoding."""
    import math
    from statistics import median_high

    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    rng = random.Random(7)
    low = 0
    for _ in range(300):
        token = "".join(rng.choice(ALPHABETS["base62"]) for _ in range(40))
        s, n, k = [ss.ORDERED[c] for c in token], 40, 62
        chi = sum((s.count(x) - n / k) ** 2 / (n / k) for x in range(k))
        p_chi = tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))
        up = [x >= median_high(s) for x in s]
        a, b, runs = sum(up), n - sum(up), 1 + sum(x != y for x, y in zip(up, up[1:]))
        mean, var = 2 * a * b / n + 1, 2 * a * b * (2 * a * b - n) / (n * n * (n - 1))
        p_runs = 2 * tail(abs(runs - mean) / math.sqrt(var))
        m = sum(s) / n
        r = sum((x - m) * (y - m) for x, y in zip(s, s[1:])) / sum((x - m) ** 2 for x in s)
        p_serial = 2 * tail(abs(r + 1 / n) * math.sqrt(n))
        digit = [c.isdigit() for c in token]
        q = 2 * 10 * 52 / 62**2
        p_change = tail(((n - 1) * q - sum(x != y for x, y in zip(digit, digit[1:]))) / math.sqrt((n - 1) * q * (1 - q)))
        want = min(1.0, 4 * min(p_chi, p_runs, p_serial, p_change))
        assert ss.battery(token, "base62") == pytest.approx(want)
        low += want < 0.05
    assert low <= 60  # the normal tails are approximate; the decoys, not these values, control the rate
