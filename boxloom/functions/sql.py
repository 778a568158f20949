"""The box functions, and the mapping of free labels, as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .taxonomy import ALLOWED, FREE_LABELS


def text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Name, parameters, result type and body. Boxes are structs of x1, y1, x2, y2.
BOX = "STRUCT<x1: DOUBLE, y1: DOUBLE, x2: DOUBLE, y2: DOUBLE>"
INTER = "greatest(0.0D, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0.0D, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
AREA = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
FUNCTIONS = (
    ("box_area", f"a {BOX}", "DOUBLE", AREA.format("a")),
    ("box_intersection", f"a {BOX}, b {BOX}", "DOUBLE", INTER),
    ("box_iou", f"a {BOX}, b {BOX}", "DOUBLE", "CASE WHEN box_area(a) + box_area(b) - box_intersection(a, b) > 0 THEN box_intersection(a, b) / (box_area(a) + box_area(b) - box_intersection(a, b)) ELSE 0.0D END"),
    ("box_overlap", f"a {BOX}, b {BOX}", "DOUBLE", "CASE WHEN least(box_area(a), box_area(b)) > 0 THEN box_intersection(a, b) / least(box_area(a), box_area(b)) ELSE 0.0D END"),
    (
        "box_valid", f"a {BOX}, width DOUBLE, height DOUBLE", "BOOLEAN",
        "a.x1 >= 0 AND a.y1 >= 0 AND a.x2 < width AND a.y2 < height AND a.x1 < a.x2 AND a.y1 < a.y2 AND a.x2 - a.x1 >= 5 AND a.y2 - a.y1 >= 5 AND box_area(a) <= width * height * 0.8D"
        " AND a.x2 - a.x1 <= width * 0.9D AND a.y2 - a.y1 <= height * 0.9D AND (a.x2 - a.x1) / nullif(a.y2 - a.y1, 0.0D) BETWEEN 0.1D AND 10D",
    ),
)

#: An allowed class of the label's name in any case, else the first key that it contains, else Other.
LOW = r"lower(regexp_replace(label, '^\\s+|\\s+$', ''))"
NAMES = ", ".join(f"{text(a.lower())}, {text(a)}" for a in ALLOWED)
KEYS = ", ".join(f"named_struct('key', {text(k)}, 'value', {text(v)})" for k, v in FREE_LABELS)
FUNCTIONS += (
    ("free_label", "label STRING", "STRING", f"coalesce(try_element_at(map({NAMES}), {LOW}), get(filter(array({KEYS}), p -> contains({LOW}, p.key)), 0).value, 'Other')"),
)


def register(spark: SparkSession) -> list[str]:
    """Create the functions for the session; their names."""
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
