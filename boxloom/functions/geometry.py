"""Box geometry as Column functions. A box is four columns x1, y1, x2, y2 in pixels unless a name says otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = Sequence[Column]


def box(prefix: str = "", names: Sequence[str] = ("x1", "y1", "x2", "y2")) -> list[Column]:
    return [F.col(f"{prefix}{n}") for n in names]


def fields(item: Column) -> list[Column]:
    """The box of a struct column, as in a lambda over an array of boxes."""
    return [item["x1"], item["y1"], item["x2"], item["y2"]]


def area(b: Box) -> Column:
    return (b[2] - b[0]) * (b[3] - b[1])


def intersection(a: Box, b: Box) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    return w * h


def iou(a: Box, b: Box) -> Column:
    """Intersection over union; 0 for boxes apart or without area."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def overlap_ratio(a: Box, b: Box) -> Column:
    """Intersection over the smaller area; 0 if that is 0."""
    least = F.least(area(a), area(b))
    return F.when(least > 0, intersection(a, b) / least).otherwise(0.0)


def centre_distance(a: Box, b: Box) -> Column:
    dx = (a[0] + a[2]) / 2 - (b[0] + b[2]) / 2
    dy = (a[1] + a[3]) / 2 - (b[1] + b[3]) / 2
    return F.sqrt(dx * dx + dy * dy)


def gap(a: Box, b: Box) -> Column:
    """Distance between rectangles, 0 where they touch."""
    dx = F.greatest(F.lit(0.0), a[0] - b[2], b[0] - a[2])
    dy = F.greatest(F.lit(0.0), a[1] - b[3], b[1] - a[3])
    return F.sqrt(dx * dx + dy * dy)


def to_xywh(b: Box) -> list[Column]:
    return [b[0], b[1], b[2] - b[0], b[3] - b[1]]


def from_xywh(b: Box) -> list[Column]:
    return [b[0], b[1], b[0] + b[2], b[1] + b[3]]


def from_centre(b: Box, width: Column | float = 1.0, height: Column | float = 1.0) -> list[Column]:
    """cx, cy, w, h, normalised if an image size is given, to corners."""
    return [(b[0] - b[2] / 2) * width, (b[1] - b[3] / 2) * height, (b[0] + b[2] / 2) * width, (b[1] + b[3] / 2) * height]


def to_percent(b: Box, width: Column, height: Column) -> list[Column]:
    """Percent x, y, w, h of the image."""
    return [b[0] / width * 100, b[1] / height * 100, (b[2] - b[0]) / width * 100, (b[3] - b[1]) / height * 100]


def from_percent(b: Box, width: Column, height: Column) -> list[Column]:
    """Percent x, y, w, h to whole pixels: each of x, y, w, h truncated, then added."""
    x, y = (b[0] / 100 * width).cast("int"), (b[1] / 100 * height).cast("int")
    return [x, y, (x + b[2] / 100 * width).cast("int"), (y + b[3] / 100 * height).cast("int")]


def to_yolo(b: Box, width: Column, height: Column) -> list[Column]:
    """Normalised centre and size."""
    w, h = b[2] - b[0], b[3] - b[1]
    return [(b[0] + w / 2) / width, (b[1] + h / 2) / height, w / width, h / height]


def area_bucket(a: Column) -> Column:
    return F.when(a < 32 * 32, "small").when(a < 96 * 96, "medium").otherwise("large")


def valid(b: Box, width: Column, height: Column) -> Column:
    """In the image, ordered, at least 5 pixels a side, at most 80 % of the area and 90 % of a side, aspect 0.1 to 10."""
    w, h = b[2] - b[0], b[3] - b[1]
    inside = (b[0] >= 0) & (b[1] >= 0) & (b[2] < width) & (b[3] < height) & (b[0] < b[2]) & (b[1] < b[3])
    sized = (w >= 5) & (h >= 5) & (w * h <= width * height * 0.8) & (w <= width * 0.9) & (h <= height * 0.9)
    return inside & sized & (w / F.nullif(h, F.lit(0.0)) >= 0.1) & (w / F.nullif(h, F.lit(0.0)) <= 10)


def fixed(b: Box) -> list[Column]:
    """Corners in order."""
    return [F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3])]


def finite(b: Box) -> Column:
    ok = F.lit(True)
    for c in b:
        ok = ok & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return ok


def clipped(b: Box, width: Column, height: Column) -> list[Column]:
    lim = lambda c, top: F.greatest(F.lit(0.0), F.least(c, top))
    return [lim(b[0], width), lim(b[1], height), lim(b[2], width), lim(b[3], height)]


def rescaled(b: Box, width: Column, height: Column, to_width: Column | float, to_height: Column | float) -> list[Column]:
    return [b[0] * (to_width / width), b[1] * (to_height / height), b[2] * (to_width / width), b[3] * (to_height / height)]


def aspect_fit(width: Column, height: Column, to_width: int, to_height: int) -> tuple[Column, Column]:
    """The largest size of the same aspect in the target, sides truncated."""
    wide = width / height > to_width / to_height
    return (
        F.when(wide, F.lit(to_width)).otherwise((F.lit(to_height) * (width / height)).cast("int")),
        F.when(wide, (F.lit(to_width) / (width / height)).cast("int")).otherwise(F.lit(to_height)),
    )


def position(b: Box, width: Column, height: Column) -> Column:
    """top, middle or bottom and left, center or right, by thirds of the box's centre."""
    cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    across = F.when(cx < width / 3, "left").when(cx < 2 * width / 3, "center").otherwise("right")
    down = F.when(cy < height / 3, "top").when(cy < 2 * height / 3, "middle").otherwise("bottom")
    return F.concat(down, F.lit("-"), across)


def crop_window(b: Box, width: Column, height: Column, padding: float) -> list[Column]:
    return clipped([b[0] - padding, b[1] - padding, b[2] + padding, b[3] + padding], width, height)


def guessed_format(b: Box) -> Column:
    """xyxy if the last two are larger than the first two and below 2000, else xywh."""
    return F.when((b[2] > b[0]) & (b[3] > b[1]) & (b[2] < 2000) & (b[3] < 2000), "xyxy").otherwise("xywh")


def flipped(b: Box, width: Column) -> list[Column]:
    return [width - b[2], b[1], width - b[0], b[3]]


def moved(b: Box, dx: Column, dy: Column) -> list[Column]:
    return [b[0] + dx, b[1] + dy, b[2] + dx, b[3] + dy]


def scaled(b: Box, by: Column) -> list[Column]:
    return [c * by for c in b]


def turned(b: Box, width: Column, height: Column, degrees: Column) -> list[Column]:
    """The bounding box of the corners after a turn about the image's centre."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    corners = [(x - width / 2, y - height / 2) for x in (b[0], b[2]) for y in (b[1], b[3])]
    xs = [c * x - s * y + width / 2 for x, y in corners]
    ys = [s * x + c * y + height / 2 for x, y in corners]
    return [F.least(*xs), F.least(*ys), F.greatest(*xs), F.greatest(*ys)]


def degenerate(b: Box) -> Column:
    return (b[2] <= b[0]) | (b[3] <= b[1])


def named(b: Box, names: Sequence[str] = ("x1", "y1", "x2", "y2")) -> list[Column]:
    return [c.alias(n) for c, n in zip(b, names)]
