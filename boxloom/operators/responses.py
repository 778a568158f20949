"""Free-text model responses to tables of boxes. Everything is built from string and array functions, one row a line."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..functions import taxonomy as tx
from ..functions.taxonomy import stripped
from ..tables import computed, stored

# The markers and patterns of the answers, which the results depend on.
START, END = "RESULT_START", "RESULT_END"
NOTHING = "no objects detected"
BOX = r"\((\d+),\s*(\d+),\s*(\d+),\s*(\d+)\)"
LINE = r"^([^:]+):\s*" + BOX + r"\s*([\d.]+)?\s*(.*)$"
SECTION = r"\n(?=\d+\.\s*\*\*)"
SECTION_LABEL = r"\d+\.\s*\*\*([^*]+)\*\*"
SECTION_HEADS = (r"\*\*Bounding Box Coordinates\*\*:\s*", r"\*\*Bounding Box:\*\*\s*", r"Bounding Box:\s*")
SECTION_TEXT = r"(?s)Description:\s*(.+?)(?=\n\n|\n\d+\.|$)"
LABELS = (r"\*\*([^*]+)\*\*", r"(\d+\.\s*\*\*[^*]+\*\*)", r"(\d+\.\s*[^:]+):", r"(?m)^([^:]+):", r"(?U)(\w+(?:\s+\w+)*?)(?:\s*\(|\s*:)")
DESCRIPTIONS = (r"\*\*Description:\*\*\s*(.+?)(?=\n|$)", r"Description:\s*(.+?)(?=\n|$)")
NO_DESCRIPTION = r"^(\d+\.|\*\*|Bounding Box:)"
ANY_BOX = r"\(\d+,\s*\d+,\s*\d+,\s*\d+\)"
BOX_INDEX = r"^BOX_INDEX_(\d+):"
DIRECT = r"(?U)^(\w+):\s*" + BOX + r"\s+([\d.]+)\s*(.*)"
LEGACY = r"^Box\s*\(([^)]+)\):\s*(.+)"
BULLETED = r"([^\n]+?)\s*" + BOX
OBJECT = r"(?s)(\{.*\})"
RESULTS = r"(?s)(\{.*\"results\".*\})"
# End of the fixed values.
CORNERS = ("x1", "y1", "x2", "y2")


def json_box(doc: Column) -> list[Column]:
    """A box from JSON, a list of four or an object x1..y2; what isn't a number becomes null."""
    v = F.try_parse_json(doc)
    return [F.coalesce(F.try_variant_get(v, f"$[{i}]", "double"), F.try_variant_get(v, f"$.{k}", "double")) for i, k in enumerate(CORNERS)]


def some(c: Column) -> Column:
    """Null for the empty text, which is what a regex group that took no part gives."""
    return F.nullif(c, F.lit(""))


def result_block(response: Column, need_end: bool = False) -> Column:
    """The text between the markers; without an end marker the rest (or null if one is needed); null if they are out of order."""
    start, end = F.instr(response, START), F.instr(response, END)
    inner = F.substr(response, start + len(START), F.greatest(end - start - len(START), F.lit(0)))
    tail = F.lit(None).cast("string") if need_end else F.substr(response, start + len(START))
    return F.when(start > 0, F.when(end == 0, stripped(tail)).when(end > start, stripped(inner)))


def lines(df: DataFrame, text: Column, keys: Sequence[str]) -> DataFrame:
    """A row for each line that isn't blank: keys, line_no (in the text), line (stripped)."""
    return df.select(*keys, F.posexplode(F.split(text, "\n", -1)).alias("line_no", "line")).withColumn("line", stripped(F.col("line"))).where("line <> ''")


def line_boxes(rows: DataFrame, default: float, found: str) -> DataFrame:
    """Lines "Label: (x1,y1,x2,y2) confidence description" as raw_label, x1..y2, confidence, description."""
    part = lambda i: F.regexp_extract("line", LINE, i)
    parts = computed(rows.where(F.col("line").rlike(LINE)), rows.columns, {"raw_label": stripped(part(1)), **{c: part(i + 2).try_cast("int") for i, c in enumerate(CORNERS)}, "number": part(6), "said": part(7)})
    return parts.withColumns({"number": some(F.col("number")), "said": stripped(F.col("said"))}).withColumns(
        {
            "confidence": F.coalesce(F.col("number").try_cast("double"), F.when(F.col("number").isNull(), F.lit(default))),
            "description": F.coalesce(some(F.col("said")), F.format_string(found, F.lower("raw_label"))),
        }
    )


def validated(rows: DataFrame) -> DataFrame:
    """Boxes that are valid in their image (width, height), with the allowed class as label."""
    # the corners are bound, as a pushed filter would otherwise repeat the patterns they come from at every mention
    ok = tx.bound(F.array(*[F.col(c).cast("double") for c in CORNERS]), lambda b: g.valid([b[i] for i in range(4)], F.col("width"), F.col("height")))
    return rows.where(ok).withColumn("label", tx.free_label(F.col("raw_label")))


OUT = ("label", *CORNERS, "confidence", "description", "raw_label")


def parse_structured(responses: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Boxes of responses (keys, response, width, height) with markers; the first of equal (label, box) lines counts."""
    block = responses.withColumn("block", result_block(F.col("response"))).where("block is not null")
    block = block.where(~F.lower("block").contains(NOTHING))
    rows = line_boxes(lines(block, F.col("block"), [*keys, "width", "height"]), 0.8, "Detected %s")
    first = Window.partitionBy(*keys, "raw_label", *CORNERS).orderBy("line_no")
    # a bad number loses its line, but its label and box count as seen
    unique = rows.withColumn("__r", F.row_number().over(first)).where("__r = 1 and confidence is not null")
    return validated(unique).select(*keys, "line_no", *OUT)


def parse_simple(responses: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Boxes of plain lines; the default confidence is 1.0 and repeated lines all count."""
    r = responses.where(~F.lower("response").contains(NOTHING))
    rows = line_boxes(lines(r, F.col("response"), [*keys, "width", "height"]), 1.0, "A %s detected")
    return validated(rows.where("confidence is not null")).select(*keys, "line_no", *OUT)


def parse_numbered(responses: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Sections "1. **Label**" with a bounding box in one of three spellings."""
    s = responses.select(*keys, "width", "height", F.posexplode(F.split("response", SECTION, -1)).alias("line_no", "section"))
    raw = stripped(F.regexp_extract("section", SECTION_LABEL, 1))
    boxes = [F.when(F.col("section").rlike(h + BOX), F.array(*[F.regexp_extract("section", h + BOX, i).try_cast("int") for i in range(1, 5)])) for h in SECTION_HEADS]
    b = F.coalesce(*boxes)
    said = some(stripped(F.regexp_extract("section", SECTION_TEXT, 1)))
    rows = s.withColumns({"raw_label": raw, "b": b}).where("raw_label <> '' and b is not null").withColumns(
        {**{c: F.col("b")[i] for i, c in enumerate(CORNERS)}, "confidence": F.lit(1.0), "description": F.coalesce(said, F.format_string("A %s detected in the image", F.lower("raw_label")))}
    )
    return validated(rows).select(*keys, "line_no", *OUT)


def object_label(line: Column) -> Column:
    """A label from a line of prose: bold text, a numbered or plain head before a colon, words before a bracket or a
    colon, else the first three words."""
    tidy = lambda c: stripped(F.regexp_replace(F.regexp_replace(stripped(c), r"^\d+\.\s*", ""), r"\*\*", ""))
    words = F.array_join(F.slice(F.split(stripped(line), r"\s+"), 1, 3), " ")
    return F.coalesce(*[some(tidy(F.regexp_extract(line, p, 1))) for p in LABELS], some(words), F.lit("Unknown Object"))


def object_description(line: Column) -> Column:
    said = [some(stripped(F.regexp_extract(line, p, 1))) for p in DESCRIPTIONS]
    plain = F.when(~line.rlike(NO_DESCRIPTION), some(stripped(line)))
    return F.coalesce(*said, plain, F.lit("Object detected in image"))


def parse_general(responses: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Every "(a, b, c, d)" of a response; label and description come from the first line that holds the same text."""
    found = F.regexp_extract_all("response", F.lit(ANY_BOX), F.lit(0))
    rows = responses.select(*keys, "width", "height", "response", F.posexplode(found).alias("line_no", "box"))
    first = F.element_at(F.filter(F.split("response", "\n", -1), lambda line: line.contains(F.col("box"))), 1)
    rows = computed(rows, [*keys, "width", "height", "line_no"], {"line": first, **{c: F.regexp_extract("box", BOX, i + 1).try_cast("int") for i, c in enumerate(CORNERS)}})
    rows = rows.where("line is not null").withColumns({"raw_label": object_label(F.col("line")), "description": object_description(stripped(F.col("line"))), "confidence": F.lit(1.0)})
    return validated(rows).select(*keys, "line_no", *OUT)


def is_verbose(response: Column) -> Column:
    """Any of the phrases of a rambling answer and no coordinates; an explicit "no objects detected" is not one."""
    low, hit = F.lower(response), F.lit(False)
    for phrase in tx.VERBOSE:
        hit = hit | low.contains(phrase)
    return hit & ~low.contains(NOTHING) & ~response.rlike(ANY_BOX)


def parse_cascade(responses: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """The boxes of the first strategy that yields any (column strategy); with markers in order the structured answer is
    final, even without boxes. Each later strategy sees the responses that are left: the boxes of each are stored, so
    no response is parsed twice by one strategy."""
    final = F.lower(F.coalesce(result_block(F.col("response")), F.lit(""))).contains(NOTHING)
    left = stored(responses.select(*keys, "response", "width", "height", final.alias("final")))
    out = None
    for name, parse in (("structured", parse_structured), ("simple", parse_simple), ("numbered", parse_numbered), ("general", parse_general)):
        own = parse(left, keys).withColumn("strategy", F.lit(name))
        own = own if name == "general" else stored(own)
        left = left.where("not final").join(own.select(*keys).distinct(), list(keys), "left_anti")
        out = own if out is None else out.unionByName(own)
    return out


def split_answer(text: Column, default: float = 0.8) -> tuple[Column, Column, Column]:
    """"Label confidence description": label, confidence (a bad one is the default), description; null with fewer than two parts."""
    return answer_parts(F.split(text, " ", 3), default)


def answer_parts(p: Column, default: float = 0.8) -> tuple[Column, Column, Column]:
    ok = F.size(p) >= 2
    label = F.when(ok, F.get(p, F.lit(0)))
    return label, F.when(ok, F.coalesce(F.get(p, F.lit(1)).try_cast("double"), F.lit(default))), F.when(ok, F.coalesce(F.get(p, F.lit(2)), F.concat(F.lit("Detected by VLM: "), F.get(p, F.lit(0)))))


def parse_box_indexed(responses: DataFrame, boxes: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """"BOX_INDEX_i: label confidence description" lines joined to the i-th box (column idx); Empty is skipped, and of
    several lines for a box the first counts. Boxes without a line have no row."""
    block = responses.withColumn("block", result_block(F.col("response"), need_end=True)).where("block is not null")
    rows = lines(block, F.col("block"), list(keys)).withColumn("idx", F.regexp_extract("line", BOX_INDEX, 1).try_cast("int")).where("idx is not null")
    first = rows.groupBy(*keys, "idx").agg(F.min_by("line", "line_no").alias("line"))
    label, conf, text = split_answer(stripped(F.regexp_replace("line", r"^[^:]*:", "")))
    parsed = first.select(*keys, "idx", label.alias("raw_label"), conf.alias("confidence"), text.alias("description")).where("raw_label is not null and lower(raw_label) <> 'empty'")
    return boxes.join(parsed, [*keys, "idx"]).withColumn("label", tx.free_label(F.col("raw_label")))


def direct_boxes(responses: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """"word: (…) confidence description" lines, in or without markers: keys, det_id (the line's number), raw_label, x1..y2, confidence, description."""
    text = F.coalesce(result_block(F.col("response")), F.when(~F.col("response").contains(START), F.col("response")))
    pattern = DIRECT
    rows = lines(responses.withColumn("__t", text).where("__t is not null"), F.col("__t"), list(keys)).where(F.col("line").rlike(pattern))
    part = lambda i: F.regexp_extract("line", pattern, i)
    parts = computed(rows, [*keys, "line_no"], {"raw_label": part(1), **{c: part(i + 2).try_cast("double") for i, c in enumerate(CORNERS)}, "confidence": part(6).try_cast("double"), "said": stripped(part(7))})
    return parts.select(*keys, F.col("line_no").alias("det_id"), "raw_label", *CORNERS, "confidence", F.coalesce(some(F.col("said")), F.concat(F.lit("Detected by VLM: "), "raw_label")).alias("description"))


def parse_direct_coordinates(responses: DataFrame, boxes: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """The original boxes that a parsed line matches by overlap or distance: keys, det_id, label, confidence, description."""
    from .matching import match_iou_or_distance

    parsed = stored(direct_boxes(responses, keys))  # read by the match and for its fields
    hit = match_iou_or_distance(boxes, parsed, keys=keys)
    of = parsed.select(*keys, F.col("det_id").alias("parsed_id"), "raw_label", "confidence", "description")
    return hit.join(of, [*keys, "parsed_id"]).select(*keys, "det_id", tx.free_label(F.col("raw_label")).alias("label"), "confidence", "description")


def parse_legacy_boxes(responses: DataFrame, boxes: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """"Box (…): label confidence description" lines, matched to the nearest centre: keys, det_id, label, confidence, description."""
    from .matching import match_nearest_center

    pattern = LEGACY
    rows = lines(responses, F.col("response"), list(keys)).where(F.col("line").rlike(pattern))
    nums = F.transform(F.split(F.regexp_extract("line", pattern, 1), ","), lambda x: stripped(x).try_cast("double"))
    label, conf, text = answer_parts(F.col("p"))
    rows = computed(rows, [*keys, "line_no"], {"n": nums, "p": F.split(stripped(F.regexp_extract("line", pattern, 2)), " ", 3)})
    parsed = rows.where("size(n) = 4 and forall(n, x -> x is not null)").select(*keys, F.col("line_no").alias("det_id"), *[F.col("n")[i].alias(c) for i, c in enumerate(CORNERS)], label.alias("raw_label"), conf.alias("confidence"), text.alias("description"))
    parsed = stored(parsed)  # read by the match and for its fields
    hit = match_nearest_center(boxes, parsed, keys=keys)
    of = parsed.select(*keys, F.col("det_id").alias("parsed_id"), "raw_label", "confidence", "description")
    out = hit.join(of, [*keys, "parsed_id"]).where("raw_label is not null and lower(raw_label) <> 'empty'")
    return out.select(*keys, "det_id", tx.free_label(F.col("raw_label")).alias("label"), "confidence", "description")


def parse_box_cascade(responses: DataFrame, boxes: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """Indexed lines, else direct coordinates, else legacy lines, with the strategy. ``boxes`` has idx and det_id."""
    cols = [*keys, "det_id", "label", "confidence", "description"]
    a = parse_box_indexed(responses, boxes, keys).select(*cols).withColumn("strategy", F.lit("indexed"))
    rest = responses.join(a.select(*keys).distinct(), list(keys), "left_anti")
    b = parse_direct_coordinates(rest, boxes, keys).select(*cols).withColumn("strategy", F.lit("direct"))
    rest = rest.join(b.select(*keys).distinct(), list(keys), "left_anti")
    c = parse_legacy_boxes(rest, boxes, keys).select(*cols).withColumn("strategy", F.lit("legacy"))
    return a.unionByName(b).unionByName(c)


def parse_crop_class(responses: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The first "Object: class confidence description" in the markers with two parts or more, else nulls."""
    block = F.coalesce(result_block(F.col("response"), need_end=True), F.lit(""))
    objects = F.filter(F.transform(F.split("block", "\n", -1), stripped), lambda s: s.startswith("Object:"))
    said = F.filter(F.transform(objects, lambda s: stripped(F.substr(s, F.lit(8)))), lambda s: s.contains(" "))
    # step by step, each computed once
    rows = computed(computed(responses, keys, {"response": F.col("response")}), keys, {"block": block})
    rows = computed(rows, keys, {"p": F.split(F.get(said, F.lit(0)), " ", 3)})
    label, conf, text = answer_parts(F.col("p"))
    rows = computed(rows, keys, {"said_label": label, "confidence": conf, "description": text})
    label, conf, text = (F.col(c) for c in ("said_label", "confidence", "description"))
    return rows.select(*keys, F.when(label.isNotNull(), tx.free_label(label)).alias("label"), conf.alias("confidence"), text.alias("description"))


def parse_bulleted(responses: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """"- **Name:**", "**Bounding Box:** (…)", "**Description:** …" lines; an object is complete with its description.
    Responses without one fall back to "text (a, b, c, d)". Columns: keys, pos, name, description, x1..y2."""
    rows = lines(responses, F.col("response"), list(keys))
    head = F.col("line").startswith("- **") & F.col("line").endswith(":**")
    box = ~head & F.col("line").contains("**Bounding Box:**")
    done = ~head & ~box & F.col("line").contains("**Description:**")
    order = Window.partitionBy(*keys).orderBy("line_no")
    # an object spans the lines after its head; a description closes it
    marked = rows.withColumns({"head": head, "done": done}).withColumn("part", F.sum(F.when(F.col("head") | F.coalesce(F.lag("done").over(order), F.lit(False)), 1).otherwise(0)).over(order))
    item = Window.partitionBy(*keys, "part").orderBy("line_no")
    named = marked.withColumns(
        {
            "name": F.last(F.when(head, F.expr("substring(line, 5, length(line) - 7)")), ignorenulls=True).over(item),
            "b": F.last(F.when(box & F.col("line").rlike(BOX), F.regexp_extract("line", BOX, 0)), ignorenulls=True).over(item),
        }
    )
    objects = named.where(F.col("done") & F.col("name").isNotNull()).select(*keys, F.col("line_no").alias("pos"), "name", stripped(F.element_at(F.split("line", r"\*\*Description:\*\*"), -1)).alias("description"), "b")
    rest = responses.join(objects.select(*keys).distinct(), list(keys), "left_anti")
    pattern = BULLETED
    found = rest.select(*keys, F.posexplode(F.regexp_extract_all("response", F.lit(pattern), F.lit(0))).alias("pos", "m"))
    text = stripped(F.regexp_extract("m", pattern, 1))
    plain = found.select(*keys, "pos", F.substring_index(text, ":", 1).alias("name"), text.alias("description"), F.regexp_extract("m", BOX, 0).alias("b"))
    both = objects.unionByName(plain)
    return both.select(*keys, "pos", "name", "description", *[F.regexp_extract("b", BOX, i + 1).try_cast("int").alias(c) for i, c in enumerate(CORNERS)])


def repaired_json(text: Column) -> Column:
    """The text as JSON, else its part from the first "{" to the last "}" as JSON, else null."""
    inner = F.regexp_extract(text, OBJECT, 1)
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(some(inner)))


ANSWER = ("class", "confidence", "reasoning")


def classification(text: Column, allowed: Sequence[str] = tx.ALLOWED) -> dict[str, Column]:
    """class, confidence, reasoning of a JSON answer; Other, 0.5 and a reason where a key is missing."""
    v = repaired_json(text)
    return classes_of(*[F.try_variant_get(v, f"$.{k}", "string") for k in ANSWER], allowed)


def classified(df: DataFrame, text: Column, keep: Sequence[str], allowed: Sequence[str] = tx.ALLOWED) -> DataFrame:
    """The columns ``keep`` and those of ``classification``, with each answer parsed once."""
    rows = computed(computed(df, keep, {"__text": text}), keep, {"__v": repaired_json(F.col("__text"))})
    rows = computed(rows, keep, {f"__{k}": F.try_variant_get("__v", f"$.{k}", "string") for k in ANSWER})
    return rows.select(*keep, *[c.alias(n) for n, c in classes_of(*[F.col(f"__{k}") for k in ANSWER], allowed).items()])


def classes_of(cls: Column, conf: Column, why: Column, allowed: Sequence[str]) -> dict[str, Column]:
    whole = cls.isNotNull() & conf.isNotNull() & why.isNotNull()
    return {
        "class": F.when(whole, coerced_class(cls, allowed)).otherwise("Other"),
        "confidence": F.when(whole, coerced_confidence(conf)).otherwise(0.5),
        "reasoning": F.when(whole, why).otherwise("Failed to parse response"),
    }


def coerced_class(label: Column, allowed: Sequence[str] = tx.ALLOWED) -> Column:
    """An allowed class, else the allowed class closest in length, the first of equals."""
    near = F.array_min(F.array(*[F.struct(F.abs(F.length(label) - len(a)).alias("d"), F.lit(i).alias("i"), F.lit(a).alias("a")) for i, a in enumerate(allowed)]))
    return F.when(label.isin(*allowed), label).otherwise(near["a"])


def coerced_confidence(value: Column) -> Column:
    """0 to 1; 0.7 for what isn't a number."""
    n = value.try_cast("double")
    return F.when(n.isNull(), 0.7).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), n)))


def object_json(text: Column) -> Column:
    """Struct (class, description) if the stripped text is one JSON object, else nulls."""
    t = stripped(text)
    v = F.when(t.startswith("{") & t.endswith("}"), F.try_parse_json(t))
    return F.struct(F.try_variant_get(v, "$.class", "string").alias("class"), F.try_variant_get(v, "$.description", "string").alias("description"))


def parse_results_array(responses: DataFrame, keys: Sequence[str] = ("image_id",)) -> DataFrame:
    """{"results": [{object_index, class, confidence, reasoning}]} within a text: keys, idx (from 0), label, confidence, reasoning."""
    doc = F.regexp_extract("response", RESULTS, 1)
    kind = "struct<results:array<struct<object_index:int,class:string,confidence:double,reasoning:string>>>"
    rows = responses.select(*keys, F.explode(F.from_json(some(doc), kind)["results"]).alias("r"))
    return rows.select(*keys, (F.col("r.object_index") - 1).alias("idx"), F.col("r.class").alias("label"), F.col("r.confidence").alias("confidence"), F.col("r.reasoning").alias("reasoning"))


def keyword_labels(text: Column, table: Mapping[str, Sequence[str]] = tx.LABEL_KEYWORDS) -> Column:
    """The labels, in the table's order, any of whose keywords the text holds."""
    low = F.lower(text)
    hits = []
    for label, words in table.items():
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        hits.append(F.when(hit, F.lit(label)))
    return F.filter(F.array(*hits), lambda x: x.isNotNull())


def label_list(text: Column, allowed: Sequence[str]) -> Column:
    """The quoted items of a list literal that are allowed, in order; an empty array for anything else."""
    t = stripped(text)
    items = F.transform(F.regexp_extract_all(t, F.lit("[\"']([^\"']*)[\"']"), F.lit(1)), stripped)
    ok = F.filter(items, lambda x: x.isin(*allowed))
    return F.when(t.startswith("[") & t.endswith("]"), ok).otherwise(F.array().cast("array<string>"))
