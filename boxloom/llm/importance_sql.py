"""SQL of the importance resampling query: CRC-32 as folds over lists, of words byte by byte, of runs by carrying."""

from __future__ import annotations


def crc_entry(byte: int) -> int:
    """What a byte adds to a CRC-32 register."""
    for _ in range(8):
        byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
    return byte


TABLE = "([" + ", ".join(f"{crc_entry(b)}::BIGINT" for b in range(256)) + "])"
ONES = "4294967295::BIGINT"
UPPER, LOWER = ("".join(chr(first + k) for k in range(26)) for first in (65, 97))


def folded(start: str, values: str) -> str:
    """The register after a list of bytes."""
    return f"list_reduce(list_prepend({start}, {values}), lambda s, x: xor(s >> 8, {TABLE}[(xor(s, x) & 255) + 1]))"


def carried(crc: str) -> str:
    """A CRC over the zero bytes of a space and the next word."""
    return folded(crc, "list_transform(range(len + 1), lambda i: 0::BIGINT)")


ORACLE = rf"""
WITH lo AS MATERIALIZED (
  SELECT kind, id, rid, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 's' AS kind, doc_id AS id, row_number() OVER () AS rid, text FROM documents UNION ALL SELECT 't', NULL, -row_number() OVER (), text FROM benchmark)),
p AS MATERIALIZED (SELECT kind, rid, unnest(w) AS word, generate_subscripts(w, 1) AS n FROM lo),
b AS (SELECT word, strlen(word) AS len, list_transform(range(strlen(word)), lambda i: CAST('0x' || substr(hex(encode(word)), CAST(2 * i + 1 AS INT), 2) AS BIGINT)) AS bytes FROM (SELECT DISTINCT word FROM p)),
-- of each word its CRC, and that of a space and the word
v AS MATERIALIZED (SELECT word, len, xor(4294967295, {folded(ONES, 'bytes')}) AS crc, xor(4294967295, {folded(ONES, 'list_prepend(32::BIGINT, bytes)')}) AS after FROM b),
q AS MATERIALIZED (SELECT kind, rid, n, crc, len, after, lag(crc) OVER w AS before FROM p JOIN v USING (word) WINDOW w AS (PARTITION BY rid ORDER BY n)),
q2 AS MATERIALIZED (SELECT *, CASE WHEN before IS NOT NULL THEN xor({carried('before')}, after) END AS two FROM q),
q3 AS (SELECT *, lag(two) OVER (PARTITION BY rid ORDER BY n) AS two_before FROM q2),
f AS MATERIALIZED (
  SELECT kind, rid, crc % 10000 AS b FROM q3 UNION ALL SELECT kind, rid, two % 10000 FROM q3 WHERE two IS NOT NULL
  UNION ALL SELECT kind, rid, xor({carried('two_before')}, after) % 10000 FROM q3 WHERE two_before IS NOT NULL),
g AS (
  SELECT b, CAST(floor(1000 * ln((t + 1)::DOUBLE * (st + 10000) / ((s + 1)::DOUBLE * (tt + 10000)))) AS BIGINT) AS gain
  FROM (SELECT b, count(*) FILTER (WHERE kind = 's') AS s, count(*) FILTER (WHERE kind = 't') AS t FROM f GROUP BY 1), (SELECT count(*) FILTER (WHERE kind = 's') AS st, count(*) FILTER (WHERE kind = 't') AS tt FROM f)),
w AS (SELECT rid, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM f JOIN g USING (b) WHERE kind = 's' GROUP BY 1),
r AS (
  SELECT id AS doc_id, rid, len(lo.w) >= 20 AS fit, coalesce(w.n, 0) AS n_features, coalesce(w.weight, 0) AS weight,
    coalesce(w.weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM lo LEFT JOIN w USING (rid) WHERE kind = 's'),
k AS (SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id, rid) AS place FROM r)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 5 * (SELECT count(*) FILTER (WHERE fit) FROM r) // 100 THEN place END AS rank FROM k"""
