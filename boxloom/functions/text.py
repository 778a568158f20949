"""Text helpers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stem(path: Column) -> Column:
    """The file name without folders and without its last extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")


def image_ref(ref: Column) -> Column:
    """A label tool's image reference as a path: its local-files prefix goes, a doubled "blurred" folder becomes one;
    any other reference becomes its folder and file name."""
    local = F.regexp_replace(F.regexp_replace(ref, r"^.*/data/local-files/\?d=", ""), "/blurred/blurred/", "/blurred/")
    name = F.substring_index(ref, "/", -1)
    return F.when(ref.contains("/data/local-files/?d="), local).otherwise(F.concat(F.lit("images/"), name))


def human_size(size: Column) -> Column:
    """Bytes as text with two decimals and a unit up to TB."""
    n, out = size.cast("double"), None
    for k, unit in reversed(list(enumerate(("B", "KB", "MB", "GB", "TB")))):
        own = F.concat(F.format_string("%.2f", n / float(1024**k)), F.lit(f" {unit}"))
        out = own if out is None else F.when(n < float(1024 ** (k + 1)), own).otherwise(out)
    return out


def elapsed(seconds: Column, hours: bool = True) -> Column:
    """H:MM:SS.mmm or MM:SS.mmm; milliseconds are truncated."""
    whole = F.floor(seconds)
    ms = F.lpad(F.floor((seconds - whole) * 1000).cast("string"), 3, "0")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    tail = F.concat(F.lit(":"), two(whole % 60), F.lit("."), ms)
    if hours:
        return F.concat(F.floor(whole / 3600).cast("string"), F.lit(":"), two(F.floor(whole / 60) % 60), tail)
    return F.concat(two(F.floor(whole / 60)), tail)
