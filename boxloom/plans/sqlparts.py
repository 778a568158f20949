"""SQL text shared by the oracles."""

from __future__ import annotations


def iou(a: str, b: str) -> str:
    i = inter(a, b)
    u = f"(({a}.x2-{a}.x1)*({a}.y2-{a}.y1) + ({b}.x2-{b}.x1)*({b}.y2-{b}.y1) - {i})"
    return f"(CASE WHEN {u} > 0 THEN {i} / {u} ELSE 0.0 END)"


def inter(a: str, b: str) -> str:
    return f"(greatest(0.0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0.0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)))"


def overlap(a: str, b: str) -> str:
    m = f"least(({a}.x2-{a}.x1)*({a}.y2-{a}.y1), ({b}.x2-{b}.x1)*({b}.y2-{b}.y1))"
    return f"(CASE WHEN {m} > 0 THEN {inter(a, b)} / {m} ELSE 0.0 END)"


def distance(a: str, b: str) -> str:
    dx, dy = (f"(({a}.{p}1+{a}.{p}2)/2 - ({b}.{p}1+{b}.{p}2)/2)" for p in "xy")
    return f"sqrt({dx}*{dx} + {dy}*{dy})"


def valid(t: str, w: str, h: str) -> str:
    bw, bh = f"({t}.x2-{t}.x1)", f"({t}.y2-{t}.y1)"
    return (
        f"({t}.x1 >= 0 AND {t}.y1 >= 0 AND {t}.x2 < {w} AND {t}.y2 < {h} AND {t}.x1 < {t}.x2 AND {t}.y1 < {t}.y2 AND {bw} >= 5 AND {bh} >= 5 "
        f"AND {bw}*{bh} <= {w}*{h}*0.8 AND {bw} <= {w}*0.9 AND {bh} <= {h}*0.9 AND {bw}/nullif({bh}, 0) >= 0.1 AND {bw}/nullif({bh}, 0) <= 10)"
    )


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join("(" + ", ".join(text(v) if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


#: Pairs of one image's boxes that a pairwise query looks at: neighbours in the order of det_id.
PAIRS = """pairs AS (
  SELECT a.det_id AS a_id, b.det_id AS b_id, a, b FROM det a JOIN det b ON a.image_id = b.image_id AND a.category_id = b.category_id AND a.det_id < b.det_id)"""
