"""Model responses to tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import taxonomy as tx
from ..operators import ocr
from ..operators import prompts as pr
from ..operators import responses as rs
from . import sqlparts as s
from .fixtures import oracle
from .registry import query


def sized(t):
    return t.responses.join(t.images, "image_id")


LABELS = "{'car': 'Car', 'person': 'Pedestrian', 'potted plant': 'Other', 'bottle': 'Other', 'stop sign': 'Street sign'}"
#: vlm boxes that a line parser accepts, with their class and place.
OKAY = f"""okay AS (SELECT d.*, r.n, CASE d.label WHEN 'car' THEN 'Car' WHEN 'person' THEN 'Pedestrian' WHEN 'stop sign' THEN 'Street sign' ELSE 'Other' END AS mapped
  FROM det d JOIN resp_lines r USING (det_id) WHERE {s.valid('d', '640', '480')})"""
FIRST = "first_line AS (SELECT min(det_id) AS det_id FROM resp_lines JOIN det USING (det_id) GROUP BY resp_lines.image_id, det.label, x1, y1, x2, y2)"
BOXES = "CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, CAST(x2 AS INTEGER) AS x2, CAST(y2 AS INTEGER) AS y2"


def shown(df, *more):
    return df.select("image_id", "label", "x1", "y1", "x2", "y2", "confidence", "description", *more)


@query("extract_result_block", oracle("""
SELECT image_id, CASE WHEN strpos(response, 'RESULT_START') = 0 THEN NULL WHEN strpos(response, 'RESULT_END') = 0 THEN trim(substr(response, strpos(response, 'RESULT_START') + 12), chr(10) || ' ')
  WHEN strpos(response, 'RESULT_END') > strpos(response, 'RESULT_START') THEN trim(substr(response, strpos(response, 'RESULT_START') + 12, strpos(response, 'RESULT_END') - strpos(response, 'RESULT_START') - 12), chr(10) || ' ') END AS block FROM responses"""))
def extract_result_block(t):
    return t.responses.select("image_id", rs.result_block(F.col("response")).alias("block"))


@query("parse_structured", oracle(f"SELECT image_id, mapped AS label, {BOXES}, score AS confidence, description FROM okay JOIN first_line USING (det_id) WHERE image_id % 6 IN (0, 1)", OKAY, FIRST))
def parse_structured(t):
    return shown(rs.parse_structured(sized(t)))


@query("parse_simple", oracle(f"SELECT image_id, mapped AS label, {BOXES}, score AS confidence, description FROM okay WHERE image_id % 6 IN (0, 1, 2)", OKAY))
def parse_simple(t):
    return shown(rs.parse_simple(sized(t)))


@query("parse_numbered", oracle(f"SELECT image_id, mapped AS label, {BOXES}, 1.0::DOUBLE AS confidence, description FROM okay WHERE image_id % 6 = 3", OKAY))
def parse_numbered(t):
    return shown(rs.parse_numbered(sized(t)))


@query("parse_general", oracle(f"""
SELECT image_id, CASE WHEN image_id % 6 = 3 THEN 'Other' ELSE first_value(mapped) OVER (PARTITION BY image_id, o.x1, o.y1, o.x2, o.y2 ORDER BY det_id) END AS label, {BOXES} FROM okay o WHERE image_id % 6 <> 5""", OKAY))
def parse_general(t):
    """All shapes: of equal boxes the first line counts, and a numbered section's box stands on a line of its own."""
    return rs.parse_general(sized(t)).select("image_id", "label", "x1", "y1", "x2", "y2")


@query("parse_cascade", oracle(f"""
SELECT image_id, det_label AS label, {BOXES}, CASE image_id % 6 WHEN 0 THEN 'structured' WHEN 1 THEN 'structured' WHEN 2 THEN 'simple' WHEN 3 THEN 'numbered' ELSE 'general' END AS strategy
FROM (SELECT o.*, mapped AS det_label FROM okay o LEFT JOIN first_line f USING (det_id) WHERE image_id % 6 IN (2, 3, 4) OR f.det_id IS NOT NULL) WHERE image_id % 6 <> 5""", OKAY, FIRST))
def parse_cascade(t):
    return rs.parse_cascade(sized(t)).select("image_id", "label", "x1", "y1", "x2", "y2", "strategy")


ODD = "CASE WHEN image_id % 5 = 0 THEN 'However, the scene is too blurry.' WHEN image_id % 5 = 1 THEN 'There are no cars. No objects detected' ELSE response END"


@query("classify_verbose", oracle(f"SELECT image_id, image_id % 5 = 0 AS verbose FROM (SELECT image_id, {ODD} AS r FROM responses)"))
def classify_verbose(t):
    return t.responses.select("image_id", rs.is_verbose(F.expr(ODD)).alias("verbose"))


def _indexed(t):
    from pyspark.sql import Window

    d = t.det.where("source = 'detr'")
    return d.withColumn("idx", F.row_number().over(Window.partitionBy("image_id").orderBy("det_id")) - 1)


INDEXED = "ix AS (SELECT *, CAST(row_number() OVER (PARTITION BY image_id ORDER BY det_id) - 1 AS INTEGER) AS idx FROM det WHERE source = 'detr')"
KIND = "CASE WHEN idx % 4 = 0 THEN 'Empty 0.9 nothing' WHEN idx % 4 = 1 THEN concat('person high item ', det_id) WHEN idx % 4 = 2 THEN 'Tree 0.75' ELSE concat('Car 0.5 item ', det_id) END"
KIND_ROW = "idx, CASE WHEN idx % 4 = 1 THEN 'Pedestrian' WHEN idx % 4 = 2 THEN 'Tree' ELSE 'Car' END AS label, CASE WHEN idx % 4 = 1 THEN 0.8 WHEN idx % 4 = 2 THEN 0.75 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN idx % 4 = 2 THEN 'Detected by VLM: Tree' ELSE 'item ' || det_id END AS description"


def _answers(t, head, wrap=True):
    text = F.expr(f"concat({head}, {KIND})")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("det_id", text.alias("t")))), lambda x: x["t"]), "\n")
    full = F.concat(F.lit("RESULT_START\n"), body, F.lit("\nRESULT_END")) if wrap else body
    return _indexed(t).groupBy("image_id").agg(full.alias("response"))


@query("parse_box_indexed", oracle(f"SELECT image_id, det_id, {KIND_ROW} FROM ix WHERE idx % 4 <> 0", INDEXED))
def parse_box_indexed(t):
    boxes = _indexed(t).select("image_id", "det_id", "idx")
    return rs.parse_box_indexed(_answers(t, "'BOX_INDEX_', idx, ': '"), boxes).select("image_id", "det_id", "idx", "label", "confidence", "description")


@query("parse_direct_coordinates", oracle(f"""
SELECT a.image_id, a.det_id, coalesce(max(b.det_id) FILTER (WHERE {s.iou('a', 'b')} > 0.3), min(b.det_id) FILTER (WHERE {s.distance('a', 'b')} < 100)) AS v_id
FROM det a JOIN (SELECT * FROM det WHERE source = 'vlm' AND x1 >= 0 AND y1 >= 0 AND x2 >= 0 AND y2 >= 0) b ON a.image_id = b.image_id WHERE a.source = 'detr' GROUP BY 1, 2 HAVING v_id IS NOT NULL"""))
def parse_direct_coordinates(t):
    """Lines of the vlm boxes against the detr boxes; the description names the line that was matched."""
    word = F.expr("concat(replace(label, ' ', '_'), ': (', concat_ws(', ', CAST(x1 AS INT), CAST(y1 AS INT), CAST(x2 AS INT), CAST(y2 AS INT)), ') 0.5 ', det_id)")
    text = t.det.where("source = 'vlm'").groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("det_id", word.alias("t")))), lambda x: x["t"]), "\n").alias("response"))
    out = rs.parse_direct_coordinates(text, t.det.where("source = 'detr'"))
    return out.select("image_id", "det_id", F.col("description").cast("long").alias("v_id"))


@query("parse_legacy_boxes", oracle(f"""
SELECT a.image_id, a.det_id, a.label, a.confidence, a.description FROM (
  SELECT a.image_id, a.det_id, b.*, row_number() OVER (PARTITION BY a.det_id ORDER BY {s.distance('a', 'b')}, b.from_id) AS r, {s.distance('a', 'b')} AS d
  FROM det a JOIN (SELECT image_id AS i, det_id AS from_id, x1, y1, x2, y2, idx % 4 AS k, {KIND_ROW} FROM ix) b ON a.image_id = b.i WHERE a.source = 'yolo') a WHERE r = 1 AND d < 50 AND k <> 0""", INDEXED))
def parse_legacy_boxes(t):
    said = _answers(t, "'Box (', concat_ws(', ', x1, y1, x2, y2), '): '", wrap=False)
    return rs.parse_legacy_boxes(said, t.det.where("source = 'yolo'"))


@query("parse_box_cascade", oracle(f"SELECT image_id, det_id, label, confidence, description, 'indexed' AS strategy FROM (SELECT image_id, det_id, {KIND_ROW} FROM ix WHERE idx % 4 <> 0 AND image_id % 2 = 0)", INDEXED))
def parse_box_cascade(t):
    """Indexed answers for even images; the others have no answer in any shape."""
    said = _answers(t, "'BOX_INDEX_', idx, ': '").withColumn("response", F.expr("CASE WHEN image_id % 2 = 0 THEN response ELSE 'nothing' END"))
    return rs.parse_box_cascade(said, _indexed(t).select("image_id", "det_id", "idx", "x1", "y1", "x2", "y2"))


@query("parse_crop_class", oracle("""
SELECT det_id, CASE WHEN det_id % 3 = 0 THEN NULL WHEN det_id % 3 = 1 THEN 'Tree' ELSE 'Truck' END AS label, CASE WHEN det_id % 3 = 0 THEN NULL WHEN det_id % 3 = 1 THEN 0.9::DOUBLE ELSE 0.8::DOUBLE END AS confidence,
  CASE WHEN det_id % 3 = 0 THEN NULL WHEN det_id % 3 = 1 THEN 'tall ' || det_id ELSE 'Detected by VLM: van' END AS description FROM det"""))
def parse_crop_class(t):
    said = t.det.selectExpr("det_id", "CASE WHEN det_id % 3 = 0 THEN 'no markers' WHEN det_id % 3 = 1 THEN concat('RESULT_START\\nObject: tree 0.9 tall ', det_id, '\\nRESULT_END') ELSE 'RESULT_START\\nObject: none\\nObject: van sure\\nRESULT_END' END AS response")
    return rs.parse_crop_class(said, ["det_id"])


@query("parse_bulleted", oracle(f"""
SELECT image_id, CASE WHEN image_id % 4 = 0 THEN label ELSE 'A ' || label || ' at' END AS name, CASE WHEN image_id % 4 = 0 THEN description ELSE 'A ' || label || ' at' END AS description, {BOXES}
FROM det WHERE source = 'vlm' AND x1 >= 0 AND y1 >= 0 AND x2 >= 0 AND y2 >= 0"""))
def parse_bulleted(t):
    d = t.det.where("source = 'vlm' AND x1 >= 0 AND y1 >= 0 AND x2 >= 0 AND y2 >= 0")
    b = "concat('(', concat_ws(', ', CAST(x1 AS INT), CAST(y1 AS INT), CAST(x2 AS INT), CAST(y2 AS INT)), ')')"
    text = F.expr(f"CASE WHEN image_id % 4 = 0 THEN concat('- **', label, ':**\\n  **Bounding Box:** ', {b}, '\\n  **Description:** ', description) ELSE concat('A ', label, ' at ', {b}) END")
    said = d.groupBy("image_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("det_id", text.alias("t")))), lambda x: x["t"]), "\n").alias("response"))
    return rs.parse_bulleted(said).select("image_id", "name", "description", "x1", "y1", "x2", "y2")


JSON = """CASE WHEN det_id % 5 = 0 THEN concat('{"class": "Car", "confidence": ', score, ', "reasoning": "r"}') WHEN det_id % 5 = 1 THEN concat('Sure: {"class": "Lorry", "confidence": "1.5", "reasoning": "r"} ok')
 WHEN det_id % 5 = 2 THEN '{"class": "Tree", "confidence": "high", "reasoning": "r"}' WHEN det_id % 5 = 3 THEN '{"class": "Tree"}' ELSE 'not json' END"""


@query("repair_json", oracle("""
SELECT det_id, CASE WHEN det_id % 5 = 0 THEN 'Car' WHEN det_id % 5 = 1 THEN 'Truck' WHEN det_id % 5 = 2 THEN 'Tree' ELSE 'Other' END AS class,
  CASE WHEN det_id % 5 = 0 THEN score WHEN det_id % 5 = 1 THEN 1.0 WHEN det_id % 5 = 2 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence, CASE WHEN det_id % 5 < 3 THEN 'r' ELSE 'Failed to parse response' END AS reasoning FROM det"""))
def repair_json(t):
    return rs.classified(t.det, F.expr(JSON), ["det_id"])


@query("coerce_class", oracle(f"""
SELECT d.det_id, CASE WHEN d.l IN (SELECT a FROM al) THEN d.l ELSE (SELECT arg_min(a, {{'d': abs(length(a) - length(d.l)), 'i': i}}) FROM al) END AS label
FROM (SELECT det_id, CASE WHEN det_id % 2 = 0 THEN label ELSE 'Tree' END AS l FROM det) d""", f"al(i, a) AS (VALUES {s.values(enumerate(tx.ALLOWED))})"))
def coerce_class(t):
    return t.det.select("det_id", rs.coerced_class(F.expr("CASE WHEN det_id % 2 = 0 THEN label ELSE 'Tree' END")).alias("label"))


@query("parse_object_json", oracle("SELECT det_id, CASE WHEN det_id % 2 = 0 THEN label END AS class, CASE WHEN det_id % 2 = 0 THEN description END AS description FROM det"))
def parse_object_json(t):
    text = F.expr("CASE WHEN det_id % 2 = 0 THEN concat(' {\"class\": \"', label, '\", \"description\": \"', description, '\"}\\n') ELSE concat('see {\"class\": \"', label, '\"}') END")
    return t.det.select("det_id", rs.object_json(text).alias("o")).select("det_id", "o.*")


@query("parse_results_array", oracle(f"SELECT image_id, idx, label, score AS confidence, 'item ' || det_id AS reasoning FROM ix WHERE image_id % 3 <> 0", INDEXED))
def parse_results_array(t):
    item = F.struct("idx", F.expr("concat('{\"object_index\": ', idx + 1, ', \"class\": \"', label, '\", \"confidence\": ', score, ', \"reasoning\": \"', description, '\"}')").alias("t"))
    items = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ", ")
    said = _indexed(t).groupBy("image_id").agg(F.when(F.col("image_id") % 3 == 0, "I cannot").otherwise(F.concat(F.lit("Here:\n{\"results\": ["), items, F.lit("]}\nDone"))).alias("response"))
    return rs.parse_results_array(said)


SAID = "['A pothole and sewage near a damaged sign', 'Graffiti; a car parked in bike lane', 'clear road', 'OVERHANGING BRANCH over an orange cone']"


@query("keyword_labels", oracle(f"""
SELECT image_id, coalesce((SELECT string_agg(label, '|' ORDER BY i) FROM (SELECT DISTINCT i, label FROM kw WHERE contains(lower({SAID}[image_id % 4 + 1]), word))), '') AS labels FROM images""",
    f"kw(i, label, word) AS (VALUES {s.values((i, k, w) for i, (k, ws) in enumerate(tx.LABEL_KEYWORDS.items()) for w in ws)})"))
def keyword_labels(t):
    text = F.expr("element_at(array" + SAID.replace("[", "(").replace("]", ")") + ", CAST(image_id % 4 + 1 AS INT))")
    return t.images.select("image_id", F.array_join(rs.keyword_labels(text), "|").alias("labels"))


@query("parse_label_list", oracle("SELECT image_id, CASE image_id % 3 WHEN 0 THEN 'graffiti|cone' WHEN 1 THEN '' ELSE 'cone' END AS labels FROM images"))
def parse_label_list(t):
    text = F.expr("""CASE image_id % 3 WHEN 0 THEN ' ["graffiti", "ghost", \\'cone\\'] ' WHEN 1 THEN 'graffiti' ELSE "['cone ']" END""")
    return t.images.select("image_id", F.array_join(rs.label_list(text, ("graffiti", "cone", "blocked road")), "|").alias("labels"))


@query("build_prompts", oracle("""
SELECT image_id, 'Classify the boxes:' || string_agg(chr(10) || 'BOX_INDEX_' || idx || ': (' || CAST(x1 AS BIGINT) || ',' || CAST(y1 AS BIGINT) || ',' || CAST(x2 AS BIGINT) || ',' || CAST(y2 AS BIGINT) || ')', '' ORDER BY idx) AS prompt FROM ix GROUP BY 1""", INDEXED))
def build_prompts(t):
    return pr.box_prompts(_indexed(t), "Classify the boxes:")


@query("optimize_prompts", oracle("""
SELECT image_id, p AS prompts, array_to_string(list_transform(list_transform(list_transform(string_split(p, ','), lambda x: replace(replace(replace(lower(trim(x)), 'a ', ''), 'an ', ''), 'the ', '')),
    lambda z: CASE WHEN z LIKE '%s' AND z NOT LIKE '%ss' THEN left(z, length(z) - 1) ELSE z END), lambda y: upper(y[1]) || y[2:]), ',') AS owl,
  CASE WHEN contains(p, ',') THEN lower(array_to_string(list_transform(string_split(p, ','), lambda x: trim(x)), ' and ')) ELSE lower(p) END AS dino
FROM (SELECT image_id, CASE image_id % 3 WHEN 0 THEN 'A car, the Trees' WHEN 1 THEN 'Glass' ELSE 'an apple, traffic lights , dogs' END AS p FROM images)"""))
def optimize_prompts(t):
    p = t.images.selectExpr("image_id", "CASE image_id % 3 WHEN 0 THEN 'A car, the Trees' WHEN 1 THEN 'Glass' ELSE 'an apple, traffic lights , dogs' END AS prompts")
    return p.select("image_id", "prompts", pr.simple_names(F.col("prompts")).alias("owl"), pr.one_phrase(F.col("prompts")).alias("dino"))


def _chosen(t):
    return t.images.selectExpr("image_id", "element_at(array('vehicle', 'tree', 'trash', 'other'), CAST(image_id % 4 + 1 AS INT)) AS category")


PHRASES = f"ph(category, i, phrase) AS (VALUES {s.values((c, i, p) for c, text in tx.STEP1_PHRASES.items() for i, p in enumerate(text.split(', ')))})"
CHOSEN = "chosen AS (SELECT image_id, ['vehicle', 'tree', 'trash', 'other'][image_id % 4 + 1] AS category FROM images)"


@query("category_prompt_table", oracle("SELECT image_id, category, phrase FROM chosen JOIN ph USING (category)", PHRASES, CHOSEN))
def category_prompt_table(t):
    return pr.category_phrases(_chosen(t)).select("image_id", "category", "phrase")


@query("build_text_prompt", oracle("SELECT image_id, string_agg(phrase, ', ' ORDER BY i) AS prompt, string_agg(phrase, '. ' ORDER BY i) || '.' AS detector_prompt FROM chosen JOIN ph USING (category) GROUP BY 1", PHRASES, CHOSEN))
def build_text_prompt(t):
    return pr.text_prompts(_chosen(t), ["image_id"])


@query("format_size", oracle("SELECT det_id, n, CASE WHEN n < 1024 THEN n || '.00 B' ELSE (n // 1024) || CASE n % 1024 WHEN 0 THEN '.00' ELSE '.50' END || ' KB' END AS size FROM (SELECT det_id, CASE WHEN det_id % 2 = 0 THEN det_id % 1000 ELSE (det_id % 500 + 1) * 1024 + 512 * (det_id % 3 // 2) END AS n FROM det)"))
def format_size(t):
    from ..functions.text import human_size

    d = t.det.selectExpr("det_id", "CASE WHEN det_id % 2 = 0 THEN det_id % 1000 ELSE (det_id % 500 + 1) * 1024 + 512 * (det_id % 3 div 2) END AS n")
    return d.select("det_id", "n", human_size(F.col("n")).alias("size"))


# ---- pages of recognised text


OCR = """ol AS (SELECT doc_id AS doc, i - 1 AS line_no, CASE (i - 1) % 11 WHEN 0 THEN '## ' || x WHEN 3 THEN '- ' || x WHEN 4 THEN '* ' || x WHEN 5 THEN '| a | b |' WHEN 7 THEN '$x$ ' || x ELSE replace(x, '|', '/') END AS text
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"""
OCR += """,
kinds AS (SELECT *, CASE WHEN trim(text) = '' THEN 'blank' WHEN text LIKE '#%' THEN 'header' WHEN length(text) - length(replace(text, '|', '')) >= 2 THEN 'table' WHEN contains(text, '$') OR regexp_matches(text, '[∑∫√±≤≥]') THEN 'formula'
  WHEN regexp_matches(text, '^[-*+]') OR regexp_matches(text, '^[0-9]\\..') THEN 'list' ELSE 'text' END AS kind FROM (SELECT doc, line_no, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS text FROM ol)),
isl AS (SELECT *, sum(CASE WHEN kind IS DISTINCT FROM prev OR kind IN ('header', 'formula') THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY line_no) AS run
  FROM (SELECT *, lag(kind) OVER (PARTITION BY doc ORDER BY line_no) AS prev FROM kinds WHERE kind <> 'blank')),
blocks AS (SELECT doc, kind, min(line_no) AS position, string_agg(text, chr(10) ORDER BY line_no) AS content FROM isl GROUP BY doc, run, kind)"""


def ocr_lines(t):
    d = t.table("documents").select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n", -1)).alias("line_no", "x"))
    text = F.expr("CASE line_no % 11 WHEN 0 THEN concat('## ', x) WHEN 3 THEN concat('- ', x) WHEN 4 THEN concat('* ', x) WHEN 5 THEN '| a | b |' WHEN 7 THEN concat('$x$ ', x) ELSE replace(x, '|', '/') END")
    return d.select("doc", "line_no", text.alias("text"))


@query("ocr_blocks", oracle("SELECT doc, kind, CAST(position AS INTEGER) AS position, md5(content) AS content_md5, CASE WHEN kind = 'header' THEN length(content) - length(ltrim(content, '#')) END AS level FROM blocks", OCR))
def ocr_blocks(t):
    return ocr.ocr_blocks(ocr_lines(t)).select("doc", "kind", "position", F.md5("content").alias("content_md5"), "level")


ORDER = "CASE kind WHEN 'header' THEN 0 WHEN 'text' THEN 1 WHEN 'table' THEN 2 WHEN 'formula' THEN 3 ELSE 4 END"


@query("ocr_combine_pages", oracle(f"SELECT doc, count(*) AS n_blocks, md5(string_agg(content, chr(10) || chr(10) ORDER BY position // 40, {ORDER}, position)) AS text_md5 FROM blocks GROUP BY 1", OCR))
def ocr_combine_pages(t):
    b = ocr.ocr_blocks(ocr_lines(t)).withColumn("page", F.expr("position div 40"))
    return ocr.combine_pages(b).select("doc", "n_blocks", F.md5("text").alias("text_md5"))


@query("ocr_render", oracle(f"""
SELECT doc, md5(string_agg(CASE kind WHEN 'header' THEN '## ' || ltrim(content, '# ') WHEN 'formula' THEN '$$' || chr(10) || content || chr(10) || '$$' ELSE content END, chr(10) || chr(10) ORDER BY position // 40, {ORDER}, position)) AS markdown_md5,
  md5(string_agg(CASE kind WHEN 'header' THEN '<h2>' || ltrim(content, '# ') || '</h2>' WHEN 'table' THEN '<pre>' || content || '</pre>' WHEN 'formula' THEN '<code>' || content || '</code>' WHEN 'list' THEN '<ul>' || content || '</ul>' ELSE '<p>' || content || '</p>' END, chr(10) || chr(10) ORDER BY position // 40, {ORDER}, position)) AS html_md5
FROM blocks GROUP BY 1""", OCR))
def ocr_render(t):
    b = ocr.ocr_blocks(ocr_lines(t)).withColumn("page", F.expr("position div 40"))
    return ocr.render(b).select("doc", F.md5("markdown").alias("markdown_md5"), F.md5("html").alias("html_md5"))


@query("ocr_summary", oracle("SELECT count(*) AS total, count(*) FILTER (WHERE n > 0) AS ok, count(*) FILTER (WHERE n = 0) AS failed, CAST(sum(len) AS BIGINT) AS total_chars, round(avg(len), 6) AS avg_chars, bool_or(tables > 0) AS has_tables FROM (SELECT doc, count(*) AS n, sum(length(content)) AS len, count(*) FILTER (WHERE kind = 'table') AS tables FROM blocks GROUP BY 1)", OCR))
def ocr_summary(t):
    return ocr.summary(ocr.ocr_blocks(ocr_lines(t)))


@query("worksheet_questions", oracle("SELECT image_id, CAST(i AS VARCHAR) AS question_number, 'What is ' || det_id || '?' AS problem_text, round(x1 / 640 * 100, 1) AS x_percent FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY det_id) AS i FROM det WHERE source = 'vlm')"))
def worksheet_questions(t):
    from pyspark.sql import Window

    d = t.det.where("source = 'vlm'").withColumn("i", F.row_number().over(Window.partitionBy("image_id").orderBy("det_id")))
    q = F.struct("i", F.expr("concat('{\"question_number\": \"', i, '\", \"problem_text\": \"What is ', det_id, '?\", \"spatial_info\": {\"x\": \"', round(x1 / 640 * 100, 1), '%\"}}')").alias("t"))
    docs = d.groupBy("image_id").agg(F.concat(F.lit('{"questions": ['), F.array_join(F.transform(F.array_sort(F.collect_list(q)), lambda x: x["t"]), ","), F.lit("]}")).alias("doc"))
    return ocr.worksheet_questions(docs, ["image_id"]).select("image_id", "question_number", "problem_text", "x_percent")


@query("ocr_layout_elements", oracle(f"""
SELECT image_id, idx, label AS category, 'item ' || det_id AS text, x1 FROM ix WHERE image_id % 4 <> 0
UNION ALL SELECT image_id, 0, 'text', 'plain page ' || image_id, 0.0 FROM images WHERE image_id % 8 = 0""", INDEXED))
def ocr_layout_elements(t):
    item = F.struct("idx", F.expr("concat('{\"bbox\": [', x1, ',', y1, ',', x2, ',', y2, '], \"category\": \"', label, '\", \"text\": \"', description, '\"}')").alias("t"))
    pages = _indexed(t).where("image_id % 4 <> 0").groupBy("image_id").agg(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), ","), F.lit("]")).alias("response"), F.lit(None).cast("string").alias("error"))
    plain = t.images.where("image_id % 4 = 0").selectExpr("image_id", "concat('plain page ', image_id) AS response", "CASE WHEN image_id % 8 = 4 THEN 'timeout' END AS error")
    out = ocr.layout_elements(pages.unionByName(plain).join(t.images, "image_id"), ["image_id"])
    return out.select("image_id", "idx", "category", "text", "x1")
