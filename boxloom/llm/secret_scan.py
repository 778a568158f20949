"""Secret scan: fixed patterns, and a randomness test battery with length-aware false-discovery control.

Candidates are tokens of at least 20 characters of ``[A-Za-z0-9+/_-]`` that are not plain words. Each is read in its
inferred encoding (hex, base32, one-case alphanumeric, base62, base64) and tested for

* uniform use of the alphabet (chi-squared, mean and variance of the multinomial),
* runs above and below its median symbol (Wald-Wolfowitz),
* serial correlation of neighbouring symbols, and
* changes between digits and other symbols, of which words and numbers have few.

The least of the four p-values, Bonferroni-corrected, says how random the token looks. Ordinary words, written as a name
of each encoding and length is (case, digits, signs), go through the same battery as decoys: neighbouring words of the
documents, the words of 20 or more letters, and, so that there is a null for every corpus, joined words of a fixed list.
Within a class of encoding and length a candidate's p-value is the share of decoys that look at least as random, and
Benjamini-Hochberg picks the candidates to report. Short tokens, for which the tests have little power, meet decoys that pass often, and so need
more; that is what makes the control length-aware. Counts of candidates and decoys cover all rows; only a histogram
of classes and bins, of fixed size, reaches the driver.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, released

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(rb"[0-9a-f]{24}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
KINDS = ("assign", "access", "hex", "random")
TRIGGERS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
#: Sizes of the alphabets, by encoding.
ALPHABETS = {"hex": 16, "base32": 32, "alnum36": 36, "base62": 62, "base64": 64}
ENCODINGS = tuple(ALPHABETS)
ORDERED = {c: i for i, c in enumerate("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")} | {c: 36 + i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")} | {"+": 62, "-": 62, "/": 63, "_": 63}
LENGTHS = (20, 24, 32, 48, 96)
BINS = 64


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping within a kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def encoding(token: str) -> str:
    body = token.rstrip("=")
    if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", body):
        return "hex"
    if re.fullmatch(r"[A-Z2-7]+", body):
        return "base32"
    if re.fullmatch(r"[0-9a-z]+|[0-9A-Z]+", body):
        return "alnum36"
    return "base62" if body.isalnum() else "base64"


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(token: str, enc: str) -> float:
    """The corrected p-value of "this token is random in its encoding"."""
    symbols = [int(c, 16) for c in token] if enc == "hex" else [ORDERED[c] for c in token]
    n, k = len(symbols), ALPHABETS[enc]
    change = 1 - (10**2 + (k - 10) ** 2) / k**2 if enc != "base32" else 1 - (6**2 + 26**2) / 32**2  # the chance at two neighbours
    digit = [c.isdigit() for c in token]
    changes = sum(a != b for a, b in zip(digit, digit[1:]))
    p_change = _tail(((n - 1) * change - changes) / math.sqrt((n - 1) * change * (1 - change)))
    squares = sum(c * c for c in Counter(symbols).values())
    middle = sorted(symbols)[n // 2]
    high = [s >= middle for s in symbols]
    up = sum(high)
    if 0 < up < n:
        runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
        mean = 2 * up * (n - up) / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p_runs = 2 * _tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 0.0
    else:
        p_runs = 0.0
    mean = sum(symbols) / n
    centred = [s - mean for s in symbols]
    power = sum(c * c for c in centred)
    p_serial = 2 * _tail(abs(sum(a * b for a, b in zip(centred, centred[1:])) / power + 1 / n) * math.sqrt(n)) if power else 0.0
    z = (k * squares / n - n - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n)
    return min(1.0, 4 * min(_tail(z), p_runs, p_serial, p_change))


def _code(enc: int, length: int, p: float) -> int:
    """Class and bin as one number; bin 0 looks most random."""
    bucket = sum(length >= x for x in LENGTHS) - 1
    return (enc * len(LENGTHS) + bucket) * BINS + min(BINS - 1, int(-4 * math.log10(max(p, 1e-17))))


def plain_word(token: str) -> bool:
    return token.isalpha() and (token[1:].islower() or token.isupper())


def name_of(words: list[str], enc: str, length: int, digits: str) -> str | None:
    """Ordinary words written as a name of the encoding, with a number after the first word, cut at the length."""
    if enc == "hex":
        fold = ["".join("abcdef"[(ord(c) - 97) % 6] for c in w.lower()) for w in words]
        token = "".join([fold[0], digits, *fold[1:]])
    elif enc == "base32":
        token = "".join([words[0], "".join("234567"[int(d) % 6] for d in digits), *words[1:]]).upper()
    elif enc == "alnum36":
        token = "".join([words[0], digits, *words[1:]]).lower()
    elif enc == "base62":
        token = "".join(x.capitalize() for x in [words[0], digits, *words[1:]])
    else:
        token = "-_/"[len(words[0]) % 3].join([words[0], digits, *words[1:]])
    return token[:length] if len(token) >= length else None


def _decoys(words: list[str], first: int, step: int) -> list[int]:
    """Codes of names made of neighbouring words, one for every ``step`` words, by turns of encoding and length."""
    out = []
    for i, at in enumerate(range(0, len(words), step)):
        turn = first + i
        e, b = turn % len(ENCODINGS), turn // len(ENCODINGS) % len(LENGTHS)
        name = name_of(words[at : at + LENGTHS[b]], ENCODINGS[e], LENGTHS[b], str(turn * 7919 % 10000))
        if name:
            out.append(_code(e, len(name), battery(name, ENCODINGS[e])))
    return out


COMMON = """the of and to in that it is was for on with as at by this had not but from have are which you were all her she there
would their we him been has when who will more no if out so said what up its about into than them can only other new some could
time these two may then do first any my now such like our over man me even most made after also did many before must through back
years where much your way well down should because each just those people mister how too little state good very make world still
own see men work long get here between both life being under never day same another know while last might us great old year off
come since against go came right used take three states himself few house use during without again place around however home small
found thought went say part once general high upon school every does got united left number course war until always away something
fact though water less public put thing almost hand enough far took head yet government system better set told nothing night end
why called eyes find going look asked later knew point next program city business give group toward young days let room president
side social given present several order national possible rather second face per among form important often things looked early
white case large big need four within felt along children saw best church ever least power development light family interest
information document password account service manager configuration application database session message request response
controller handler builder factory image button window background version release package module library function value""".split()


@lru_cache(1)
def fixed_decoys(each: int = 2000) -> Counter:
    """Counts by code of ``each`` names of common words for each class: a null for a corpus of any size."""
    rng = random.Random(0)
    out: Counter = Counter()
    for e, enc in enumerate(ENCODINGS):
        for length in LENGTHS:
            made = 0
            while made < each:
                name = name_of(rng.choices(COMMON, k=length), enc, length, str(rng.randrange(1, 10000)))
                if name:
                    out[_code(e, length, battery(name, enc))] += 1
                    made += 1
    return out


def scan_text(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int]], list[int]]:
    """Base spans, candidates (start, end, code) apart from them, and the codes of decoys."""
    raw = text.encode("utf-8", "replace")
    long = [w for w in raw.split() if len(w) >= 20]
    low = raw.lower()
    spans: list[tuple[int, int, str]] = []
    if any(t in low for t in TRIGGERS) or b"AKIA" in raw or any(LONG_HEX.search(w) for w in long):
        spans = base_spans(text)
    candidates: list[tuple[int, int, int]] = []
    decoys: list[int] = []
    words = [w.decode("ascii") for w in raw.split() if 1 < len(w) < 20 and w.isalpha()]
    decoys += _decoys([w for w in words if plain_word(w)], zlib.crc32(raw) % (len(ENCODINGS) * len(LENGTHS)), 32)
    if long:
        odd = False
        for w in long:
            if w.isalpha() and plain_word(word := w.decode("ascii")):
                for e, enc in enumerate(ENCODINGS):
                    name = name_of([word], enc, len(word), str(len(word)))
                    decoys.append(_code(e, len(name), battery(name, enc)))
            else:
                odd = True
        for m in CANDIDATE.finditer(text) if odd else ():
            token = m[0].rstrip("=")
            if plain_word(token) or token.isdigit() or not any(c.isalpha() for c in token) or any(a < m.end() and m.start() < b for a, b, _ in spans):
                continue
            enc = encoding(token)
            candidates.append((m.start(), m.end(), _code(ENCODINGS.index(enc), len(token), battery(token, enc))))
    return spans, candidates, decoys


def discoveries(candidates: dict[int, int], decoys: dict[int, int], rate: float, enough: int = 200) -> set[int]:
    """The codes to report: Benjamini-Hochberg within each class of encoding and length.

    A length with fewer than ``enough`` decoys borrows those of shorter lengths, which look random more often.
    """
    out: set[int] = set()
    for cls in {c // BINS for c in candidates}:
        enc, bucket = divmod(cls, len(LENGTHS))
        null = [0] * BINS
        for b in range(bucket, -1, -1):
            if sum(null) >= enough:
                break
            at = (enc * len(LENGTHS) + b) * BINS
            null = [x + decoys.get(at + i, 0) for i, x in enumerate(null)]
        own = [candidates.get(cls * BINS + i, 0) for i in range(BINS)]
        last, seen, passed = -1, 0, 0
        for i in range(BINS):
            seen, passed = seen + own[i], passed + null[i]
            if own[i] and (1 + passed) / (1 + sum(null)) <= rate * seen / sum(own):
                last = i
        out |= {cls * BINS + i for i in range(last + 1)}
    return out


SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])
CAND = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("code", pa.int32())])


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.01, key=None) -> DataFrame:
    """One row per document: doc_id, key, spans (array of start, end, kind, in order; code points, end exclusive).

    A null text is empty; a null doc_id stays null; repeated rows are scanned each. ``key`` (a column, default null)
    is carried through. The decoys of the fixed list count beside those of the corpus, so that there is a null at every size. An empty table gives an empty result.
    """

    def scan(batches):
        for batch in batches:
            found = [scan_text(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array([[dict(zip(("start", "end", "kind"), s)) for s in f[0]] for f in found], pa.list_(SPAN)),
                    pa.array([[dict(zip(("start", "end", "code"), c)) for c in f[1]] for f in found], pa.list_(CAND)),
                    pa.array([f[2] for f in found], pa.list_(pa.int32())),
                ],
                names=["doc_id", "key", "base", "candidates", "decoys"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), (F.lit(None) if key is None else key).cast("long").alias("key"))
    scanned = checkpointed(
        rows.mapInArrow(
            released(scan),
            "doc_id long, key long, base array<struct<start:int,end:int,kind:string>>, candidates array<struct<start:int,end:int,code:int>>, decoys array<int>",
        )
    )
    tally = (
        scanned.select(F.explode(F.transform("candidates", lambda c: c["code"])).alias("code"), F.lit(True).alias("own"))
        .union(scanned.select(F.explode("decoys"), F.lit(False)))
        .groupBy("code", "own")
        .count()
        .collect()  # at most 2 x 5 encodings x 5 lengths x 64 bins
    )
    decoys = fixed_decoys() + Counter({r["code"]: r["count"] for r in tally if not r["own"]})
    report = discoveries({r["code"]: r["count"] for r in tally if r["own"]}, decoys, rate)
    allowed = F.array(*[F.lit(c) for c in sorted(report)]) if report else F.array().cast("array<int>")
    added = F.transform(
        F.filter("candidates", lambda c: F.array_contains(allowed, c["code"])),
        lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit("random").alias("kind")),
    )
    order = F.array(*[F.lit(k) for k in KINDS])
    ranked = F.array_sort(
        F.transform(
            F.concat("base", added),
            lambda s: F.struct(s["start"].alias("start"), F.array_position(order, s["kind"]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")),
        )
    )
    spans = F.transform(ranked, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return scanned.select("doc_id", "key", spans.alias("spans"))


def joined(spans) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_query(docs: DataFrame) -> DataFrame:
    found = scan_secrets(docs)
    base = F.filter("spans", lambda s: s["kind"] != "random")
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with the spans, overlapping ones as one, replaced by the mark."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


