"""Queries over the expression library: geometry, text, dates and JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import geometry as g, text as t
from foliospark.operators import boxes as ob, prep
from foliospark.operators.scan import spread
from foliospark.plans.fixtures import Tables, sql
from foliospark.plans.registry import query

PAIR_KEYS = ["page", "i", "j"]


def sides():
    return g.box("a"), g.box("b")


def flag(c):
    return c.cast("int")


def near(c):
    """Rounded with exact halves pushed up, as the engines break such ties differently."""
    return F.round(c + 1e-9, 6)


# ---- geometry -------------------------------------------------------------------------------------------------

INTER_SQL = """
    SELECT *, least(ax2, bx2) - greatest(ax1, bx1) AS w, least(ay2, by2) - greatest(ay1, by1) AS h,
           (ax2 - ax1) * (ay2 - ay1) AS sa, (bx2 - bx1) * (by2 - by1) AS sb FROM box_pairs"""


@query("box_iou", sql("""
    SELECT page, i, j, CASE WHEN w > 0 AND h > 0 THEN w * h / (sa + sb - w * h) ELSE 0 END AS iou FROM m""",
    "box_pairs", m=INTER_SQL))
def box_iou(tb: Tables):
    return tb.box_pairs.select(*PAIR_KEYS, g.box_iou(*sides()).alias("iou"))


@query("box_overlap_ratio", sql("""
    SELECT page, i, j, CASE WHEN w > 0 AND h > 0 THEN w * h / sb ELSE 0 END AS ratio FROM m""",
    "box_pairs", m=INTER_SQL))
def box_overlap_ratio(tb: Tables):
    return tb.box_pairs.select(*PAIR_KEYS, g.box_overlap_ratio(*sides()).alias("ratio"))


@query("box_overlap_first", sql("""
    SELECT page, i, j, CASE WHEN w >= 0 AND h >= 0 THEN w * h / sa ELSE 0 END AS ratio FROM m""",
    "box_pairs", m=INTER_SQL))
def box_overlap_first(tb: Tables):
    return tb.box_pairs.select(*PAIR_KEYS, g.box_overlap_first(*sides()).alias("ratio"))


@query("is_contained", sql("""
    SELECT page, i, j, CAST(w > 0 AND h > 0 AND w * h / sb > 0.8 AS INTEGER) AS inside FROM m""",
    "box_pairs", m=INTER_SQL))
def is_contained(tb: Tables):
    return tb.box_pairs.select(*PAIR_KEYS, flag(g.is_contained(*sides())).alias("inside"))


@query("intersects_h", sql("""
    SELECT page, i, j, CAST(greatest(0, h) / least(ay2 - ay1, by2 - by1) >= 0.5 AS INTEGER) AS hit FROM m""",
    "box_pairs", m=INTER_SQL))
def intersects_h(tb: Tables):
    return tb.box_pairs.select(*PAIR_KEYS, flag(g.intersects_h(*sides())).alias("hit"))


@query("intersects_v", sql("SELECT page, i, j, CAST(w > 0 AS INTEGER) AS hit FROM m", "box_pairs", m=INTER_SQL))
def intersects_v(tb: Tables):
    return tb.box_pairs.select(*PAIR_KEYS, flag(g.intersects_v(*sides())).alias("hit"))


def quads(tb: Tables):
    """A slanted quad per word: the right side is shifted down by n mod 5."""
    shift = F.col("n") % 5
    b = g.box()
    quad = F.array(
        F.array(b.x1, b.y1), F.array(b.x2, b.y1 + shift), F.array(b.x2, b.y2 + shift), F.array(b.x1, b.y2)
    )
    return tb.words.select("page", "n", "x1", "y1", "x2", "y2", quad.alias("quad"))


@query("quad_to_box", sql("SELECT page, n, x1, y1, x2, y2 + n % 5 AS y2 FROM words", "words"))
def quad_to_box(tb: Tables):
    b = g.quad_to_box(F.col("quad"))
    return quads(tb).select("page", "n", *(v.alias(s) for v, s in zip(b, g.SIDES)))


@query("word_direction", sql("""
    SELECT page, n, CASE WHEN 24 > 2 * sqrt((x2 - x1) * (x2 - x1) + (n % 5) * (n % 5)) THEN 'vertical' ELSE 'horizontal' END
           AS direction FROM words""", "words"))
def word_direction(tb: Tables):
    return quads(tb).select("page", "n", g.word_direction(F.col("quad")).alias("direction"))


@query("is_noise_quad", sql("""
    SELECT page, n, CAST(sqrt((x2 - x1) * (x2 - x1) + (n % 5) * (n % 5)) < 15 AS INTEGER) AS noise FROM words""", "words"))
def is_noise_quad(tb: Tables):
    return quads(tb).select("page", "n", flag(g.is_noise_quad(F.col("quad"))).alias("noise"))


@query("box_convert", sql("""
    SELECT page, idx, x1 + x2 AS wx2, y1 + y2 AS wy2, round((x1 + x2) / 2.0 / 1000, 6) AS cx,
           round((y1 + y2) / 2.0 / 1400, 6) AS cy, round((x2 - x1) / 1000, 6) AS cw, round((y2 - y1) / 1400, 6) AS ch
    FROM boxes""", "boxes"))
def box_convert(tb: Tables):
    w, h = F.lit(1000), F.lit(1400)
    as_wh = g.box_convert(g.box(), "xywh", "xyxy")
    c = g.box_convert(g.box(), "xyxy", "cxcywh", w, h)
    return tb.boxes.select(
        "page", "idx", as_wh.x2.alias("wx2"), as_wh.y2.alias("wy2"),
        *(v.alias(n) for v, n in zip(c, ("cx", "cy", "cw", "ch"))),
    )


@query("letterbox_boxes", sql("""
    SELECT page, idx, class_id, round(least(greatest((x + w / 2) / 640, 0), 1) + 1e-9, 6) AS cx,
           round(least(greatest((y + h / 2) / 640, 0), 1) + 1e-9, 6) AS cy,
           round(least(greatest(w / 640, 1e-6), 1) + 1e-9, 6) AS bw,
           round(least(greatest(h / 640, 1e-6), 1) + 1e-9, 6) AS bh
    FROM (SELECT page, idx, c.class_id, x1 * s + (640 - CAST(floor(iw * s) AS BIGINT)) // 2 AS x,
                 y1 * s + (640 - CAST(floor(ih * s) AS BIGINT)) // 2 AS y, (x2 - x1) * s AS w, (y2 - y1) * s AS h
          FROM (SELECT b.*, 400 AS iw, 200 + page % 7 AS ih, least(640 / (200 + page % 7), 640 / 400) AS s FROM boxes b) q
          JOIN (SELECT 'A' AS label, 0 AS class_id UNION ALL SELECT 'R', 1) c ON q.label = c.label)""", "boxes"))
def letterbox_boxes(tb: Tables):
    images = tb.boxes.select("page").distinct().withColumn("w", F.lit(400)).withColumn("h", 200 + F.col("page") % 7)
    ann = tb.boxes.selectExpr("page", "idx", "label", "x1 as x", "y1 as y", "x2 - x1 as w", "y2 - y1 as h")
    out = ob.letterbox_boxes(ann, images, ["A", "R"], 640)
    return out.select("page", "idx", "class_id", *(near(F.col(c)).alias(c) for c in ("cx", "cy", "bw", "bh")))


@query("rescale_polygons", sql("""
    SELECT page, idx, nw, nh, round(x1 * nw / iw, 4) AS px, round(y1 * nh / ih, 4) AS py, round(x2 * nw / iw, 4) AS qx,
           round(y2 * nh / ih, 4) AS qy
    FROM (SELECT *, greatest(CAST(round_even(iw * s, 0) AS BIGINT) // 32 * 32, 32) AS nw,
                 greatest(CAST(round_even(ih * s, 0) AS BIGINT) // 32 * 32, 32) AS nh
          FROM (SELECT *, 400 AS iw, 200 + page % 7 AS ih, 1024 / least(400, 200 + page % 7) AS s FROM boxes))""", "boxes"))
def rescale_polygons(tb: Tables):
    images = tb.boxes.select("page").distinct().withColumn("w", F.lit(400)).withColumn("h", 200 + F.col("page") % 7)
    ann = tb.boxes.select(
        "page", "idx",
        F.when(F.col("idx") % 2 == 0, F.array(F.transform(F.flatten(g.quad_of_box(g.box())), lambda v: v.cast("double"))))
        .alias("segmentation"),
        F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).cast("array<double>").alias("bbox"),
    )
    out = ob.rescale_polygons(ann, images)
    p = F.col("polygon")
    return out.select(
        "page", "idx", "nw", "nh", F.round(p[0][0], 4).alias("px"), F.round(p[0][1], 4).alias("py"),
        F.round(p[2][0], 4).alias("qx"), F.round(p[2][1], 4).alias("qy"),
    )


@query("clamp_box", sql("""
    SELECT page, idx, cx1, cy1, greatest(least(greatest(x2, 0), 120), cx1 + 1) AS cx2,
           greatest(least(greatest(y2, 0), 60), cy1 + 1) AS cy2
    FROM (SELECT *, greatest(0, least(x1, 119)) AS cx1, greatest(0, least(y1, 59)) AS cy1 FROM boxes)""", "boxes"))
def clamp_box(tb: Tables):
    b = g.clamp_box(g.box(), F.lit(120), F.lit(60))
    return tb.boxes.select("page", "idx", *(v.alias("c" + s) for v, s in zip(b, g.SIDES)))


@query("flip_y", sql("SELECT page, idx, x1, 1400 - y2 AS y1, x2, 1400 - y1 AS y2 FROM boxes", "boxes"))
def flip_y(tb: Tables):
    b = g.flip_y(g.box(), F.lit(1400))
    return tb.boxes.select("page", "idx", *(v.alias(s) for v, s in zip(b, g.SIDES)))


# ---- text -----------------------------------------------------------------------------------------------------

LINE_SQL = """
    SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line_no,
           unnest(string_split(text, chr(10))) AS line FROM documents"""
# White space as the expressions see it, in RE2 syntax.
WS2 = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS2}+|{WS2}+$', '', 'g')"


def sql_collapse(c: str) -> str:
    return sql_strip(f"regexp_replace({c}, '{WS2}+', ' ', 'g')")


def doc_lines(tb: Tables):
    return tb.read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "line")).select(
        "doc_id", (F.col("k") + 1).cast("bigint").alias("line_no"), "line"
    )


# In these texts no character has a compatibility form, so that NFC gives what NFKC does.
@query("normalize_label", sql(f"SELECT doc_id, line_no, {sql_collapse('nfc_normalize(line)')} AS label FROM l", l=LINE_SQL))
def normalize_label(tb: Tables):
    return doc_lines(tb).select("doc_id", "line_no", t.normalize_label(F.col("line")).alias("label"))


@query("clean_ocr_text", sql(f"""
    SELECT doc_id, line_no, md5(translate(translate({sql_collapse('nfc_normalize(line)')}, '{t.CONFUSED_FROM}', '{t.CONFUSED_TO}'),
           '{t.PUNCT_FROM}', '{t.PUNCT_TO}')) AS cleaned FROM l""", l=LINE_SQL))
def clean_ocr_text(tb: Tables):
    text = t.clean_ocr_text(F.col("line"))
    return doc_lines(tb).select("doc_id", "line_no", F.md5(text).alias("cleaned"))


@query("normalize_answer", sql(f"""
    SELECT conv_id, turn, md5(translate(regexp_replace(lower(text), '[。、！？]|{WS2}', '', 'g'), '０１２３４５６７８９', '0123456789')) AS h
    FROM conversations"""))
def normalize_answer(tb: Tables):
    return tb.read("conversations").select("conv_id", "turn", F.md5(t.normalize_answer(F.col("text"))).alias("h"))


@query("normalize_qa", f"""
    SELECT conv_id, turn, md5(regexp_replace(lower({sql_strip('text')}), '{WS2}+', ' ', 'g')) AS h FROM conversations""")
def normalize_qa(tb: Tables):
    return tb.read("conversations").select("conv_id", "turn", F.md5(t.normalize_qa(F.col("text"))).alias("h"))


@query("normalize_value", f"""
    SELECT event_id, lower(regexp_replace({sql_collapse("props || '  \"X ' || event_type || '\"'")}, '^["'']+|["'']+$', '', 'g')) AS v
    FROM events""")
def normalize_value(tb: Tables):
    raw = F.concat("props", F.lit('  "X '), "event_type", F.lit('"'))
    return tb.read("events").select("event_id", t.normalize_value(raw).alias("v"))


DATE_TEXT_SQL = """
    SELECT o_orderkey, year(o_orderdate) || CASE WHEN o_orderkey % 3 = 0 THEN '/' WHEN o_orderkey % 3 = 1 THEN '年' ELSE '-' END
           || month(o_orderdate) || CASE WHEN o_orderkey % 3 = 0 THEN '/' WHEN o_orderkey % 3 = 1 THEN '月' ELSE '-' END
           || day(o_orderdate) AS s, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d FROM orders"""


def date_texts(tb: Tables):
    k = F.col("o_orderkey") % 3
    s1 = F.when(k == 0, "/").when(k == 1, "年").otherwise("-")
    s2 = F.when(k == 0, "/").when(k == 1, "月").otherwise("-")
    d = F.col("o_orderdate")
    return tb.read("orders").select(
        "o_orderkey",
        F.concat(F.year(d).cast("string"), s1, F.month(d).cast("string"), s2, F.dayofmonth(d).cast("string")).alias("s"),
        F.month(d).alias("m"), F.dayofmonth(d).alias("d"),
    )


@query("normalize_date", sql("""
    SELECT o_orderkey, 'due ' || s AS raw, y || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d AS VARCHAR), 2, '0') AS iso
    FROM q""", q=DATE_TEXT_SQL))
def normalize_date(tb: Tables):
    raw = F.concat(F.lit("due "), "s")
    return date_texts(tb).select("o_orderkey", raw.alias("raw"), t.normalize_date(raw).alias("iso"))


@query("is_iso_date", sql(
    "SELECT o_orderkey, CAST(regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AS INTEGER) AS iso FROM q", q=DATE_TEXT_SQL))
def is_iso_date(tb: Tables):
    return date_texts(tb).select("o_orderkey", flag(t.is_iso_date(F.col("s"))).alias("iso"))


@query("is_na_answer", f"""
    SELECT conv_id, turn, CAST(regexp_matches(lower(text), '{'|'.join(t.NA_PATTERNS)}') AS INTEGER) AS loose,
           CAST(regexp_matches(lower(text), '(^|[^a-z0-9])(n/a|na)([^a-z0-9]|$)') OR
                regexp_matches(lower(text), '{'|'.join(t.NA_PATTERNS[2:])}') AS INTEGER) AS strict
    FROM conversations""")
def is_na_answer(tb: Tables):
    c = F.col("text")
    return tb.read("conversations").select(
        "conv_id", "turn", flag(t.is_na_answer(c)).alias("loose"), flag(t.is_na_answer(c, strict=True)).alias("strict")
    )


@query("clean_answer", f"""
    SELECT conv_id, turn, md5({sql_strip("split_part(text, '。', 1)")}) AS h FROM conversations""")
def clean_answer(tb: Tables):
    raw = F.concat(F.lit("回答:"), F.lit("A: "), "text", F.lit("。end"))
    return tb.read("conversations").select("conv_id", "turn", F.md5(t.clean_answer(raw)).alias("h"))


@query("parse_date", sql("""
    SELECT o_orderkey, 'on ' || m || CASE WHEN o_orderkey % 2 = 0 THEN '/' ELSE '月' END || (d + 1)
           || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '日' END AS raw,
           CAST(TRY_CAST('2025-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(d + 1 AS VARCHAR), 2, '0') AS DATE) AS VARCHAR) AS day
    FROM q""", q=DATE_TEXT_SQL))
def parse_date(tb: Tables):
    even = F.col("o_orderkey") % 2 == 0
    raw = F.concat(
        F.lit("on "), F.col("m").cast("string"), F.when(even, "/").otherwise("月"), (F.col("d") + 1).cast("string"),
        F.when(even, "").otherwise("日"),
    )
    return date_texts(tb).select("o_orderkey", raw.alias("raw"), t.parse_date(raw, 2025).cast("string").alias("day"))


@query("parse_date_range", sql("""
    SELECT page, idx, CAST(strptime('2024/' || d1, '%Y/%-m/%-d') AS DATE)::VARCHAR AS s,
           CAST(strptime('2024/' || d2, '%Y/%-m/%-d') AS DATE)::VARCHAR AS e FROM gantt_texts""", "gantt_texts"))
def parse_date_range(tb: Tables):
    r = t.parse_date_range(F.concat("d1", F.lit(" 〜 "), "d2"), 2024)
    return tb.gantt_texts.select("page", "idx", r["start"].cast("string").alias("s"), r["end"].cast("string").alias("e"))


@query("strip_tags", f"""
    SELECT page_id, md5({sql_strip("regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '<(.|[\\n\\r])*$', ''), '>', ' ', 'g')")}) AS h
    FROM pages""")
def strip_tags(tb: Tables):
    return tb.read("pages").select("page_id", F.md5(t.strip_tags(F.col("html"))).alias("h"))


@query("table_signature", sql("""
    SELECT tbl, (SELECT string_agg(((length(p) - length(replace(p, '<th', ''))) // 3) || 'h' ||
                                   ((length(p) - length(replace(p, '<td', ''))) // 3) || 'd', '|' ORDER BY k)
                 FROM (SELECT unnest(string_split(gt, '<tr')[2:]) AS p, generate_subscripts(string_split(gt, '<tr')[2:], 1) AS k)) AS sig
    FROM html_pairs""", "html_pairs"))
def table_signature(tb: Tables):
    return tb.html_pairs.select("tbl", t.table_signature(F.col("gt")).alias("sig"))


@query("html_shape", sql(r"""
    SELECT tbl, len(regexp_extract_all(pred, '<tr\b')) AS rows, CASE WHEN len(regexp_extract_all(pred, '<tr\b')) > 0 THEN
           len(regexp_extract_all(pred, '<t[dh]\b')) // len(regexp_extract_all(pred, '<tr\b')) ELSE 0 END AS cols
    FROM html_pairs""", "html_pairs"))
def html_shape(tb: Tables):
    shape = t.html_shape(F.col("pred"))
    return tb.html_pairs.select("tbl", shape["rows"].alias("rows"), shape["cols"].alias("cols"))


ESC_MD_SQL = r"regexp_replace({c}, '([`*{{}}\[\]()#+!~|-])', '\\\1', 'g')"


def sql_escape_html(c: str) -> str:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        c = f"replace({c}, '{raw}', '{entity}')"
    return c


@query("escape_md", f"SELECT page_id, md5({ESC_MD_SQL.format(c='html')}) AS h FROM pages")
def escape_md(tb: Tables):
    return tb.read("pages").select("page_id", F.md5(t.escape_md(F.col("html"))).alias("h"))


@query("escape_html", f"SELECT page_id, md5({sql_escape_html('html')}) AS h FROM pages")
def escape_html(tb: Tables):
    return tb.read("pages").select("page_id", F.md5(t.escape_html(F.col("html"))).alias("h"))


_HALF = "".join(chr(i) for i in range(0x20, 0x7F))
_FULL = "　" + "".join(chr(i + 0xFEE0) for i in range(0x21, 0x7F))


@query("to_full_width", f"""
    SELECT doc_id, line_no, md5(translate(line, '{_HALF.replace("'", "''")}¥·', '{_FULL}￥・')) AS h FROM
    ({LINE_SQL}) l""")
def to_full_width(tb: Tables):
    return doc_lines(tb).select("doc_id", "line_no", F.md5(t.to_full_width(F.col("line"))).alias("h"))


@query("coerce_json", "SELECT event_id, CAST(json(props) AS VARCHAR) AS js FROM events")
def coerce_json(tb: Tables):
    raw = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Sure: "), "props", F.lit(" done."))).otherwise(F.col("props"))
    return tb.read("events").select("event_id", t.coerce_json(raw).alias("js"))


@query("validate_extraction", """
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Field kind should be number; Missing required field: day'
                          WHEN event_id % 3 = 1 THEN 'Field k should be string; Missing required field: day'
                          ELSE 'JSON parse error' END AS errors FROM events""")
def validate_extraction(tb: Tables):
    k = F.col("event_id") % 3
    number = F.get_json_object("props", "$.k")
    reply = (
        F.when(k == 0, F.concat(F.lit('note {"kind": "'), "event_type", F.lit('", "k": '), number, F.lit("} end")))
        .when(k == 1, F.concat(F.lit("note "), "props", F.lit(" end")))
        .otherwise(F.concat(F.lit("{broken"), "props"))
    )
    want = F.when(k == 0, F.create_map(*map(F.lit, ("kind", "number", "k", "number", "day", "date")))).otherwise(
        F.create_map(*map(F.lit, ("k", "string", "day", "date")))
    )
    bad = F.when(k == 2, F.lit("{broken ")).otherwise(reply)
    return tb.read("events").select("event_id", t.validate_extraction(bad, want).alias("errors"))


@query("pick_metric", """
    SELECT event_id, CASE event_id % 3 WHEN 0 THEN value WHEN 1 THEN CAST(props->>'$.k' AS DOUBLE) END AS metric FROM events""")
def pick_metric(tb: Tables):
    k = F.col("event_id") % 3
    js = (
        F.when(k == 0, F.to_json(F.struct(F.lit("x").alias("cer"), F.col("value").alias("CER"))))
        .when(k == 1, F.concat(F.lit('{"metrics": {"cer": '), F.get_json_object("props", "$.k"), F.lit("}}")))
        .otherwise(F.lit('{"cer": null}'))
    )
    picked = t.pick_metric(F.try_parse_json(js), ["cer", "CER"])
    return tb.read("events").select("event_id", picked.alias("metric"))


@query("truncate_context", """
    SELECT doc_id, length(text) AS whole, md5(left(text, 4000)) AS ctx, length(left(text, 4000)) AS n FROM
    (SELECT conv_id AS doc_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id)""")
def truncate_context(tb: Tables):
    blocks = tb.read("conversations").selectExpr("conv_id as doc_id", "turn as pos", "text")
    out = prep.truncate_context(blocks, ["doc_id"], ["pos"], 4000)
    return out.select("doc_id", "whole", F.md5("context").alias("ctx"), F.length("context").alias("n"))


@query("edit_distance", sql("""
    SELECT doc_id, line_no, levenshtein(eref, ehyp) AS dist FROM text_pairs""", "codes", "text_pairs"))
def edit_distance(tb: Tables):
    return spread(tb.text_pairs).select("doc_id", "line_no", t.edit_distance(F.col("ref"), F.col("hyp")).alias("dist"))


@query("edit_similarity", sql("""
    SELECT doc_id, line_no, 1 - levenshtein(eref, ehyp) / greatest(length(ref), length(hyp)) AS sim FROM text_pairs""",
    "codes", "text_pairs"))
def edit_similarity(tb: Tables):
    sim = t.edit_similarity(F.col("ref"), F.col("hyp"))
    return spread(tb.text_pairs).select("doc_id", "line_no", sim.alias("sim"))


CHARSET = "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZéèêçäöüñ.,"


@query("encode_label", f"""
    SELECT item_id, '1,' || coalesce((SELECT string_agg(CASE WHEN instr('{CHARSET}', ch) > 0 THEN instr('{CHARSET}', ch) + 3 ELSE 3 END, ',' ORDER BY k)
           FROM (SELECT unnest(cs) AS ch, generate_subscripts(cs, 1) AS k)) || ',', '') || '2' || repeat(',0', 78 - len(cs)) AS ids
    FROM (SELECT item_id, string_split(text, '')[:78] AS cs FROM benchmark)""")
def encode_label(tb: Tables):
    ids = t.encode_label(F.col("text"), CHARSET, 80)
    return tb.read("benchmark").select("item_id", F.array_join(ids.cast("array<string>"), ",").alias("ids"))


@query("decode_ids", f"""
    SELECT item_id, array_to_string(list_filter(string_split(text, '')[:78], lambda c: instr('{CHARSET}', c) > 0), '') AS label,
           CASE WHEN len(list_filter(string_split(text, '')[:78], lambda c: instr('{CHARSET}', c) > 0)) > 0 THEN 0.5 ELSE 0 END AS conf
    FROM benchmark""")
def decode_ids(tb: Tables):
    ids = t.encode_label(F.col("text"), CHARSET, 80)
    coded = tb.read("benchmark").select("item_id", ids.alias("ids"))
    confs = F.transform("ids", lambda i: F.when(i == t.UNK, 0.9).otherwise(0.5))
    return coded.select(
        "item_id", t.decode_ids(F.col("ids"), CHARSET).alias("label"),
        F.round(t.decode_confidence(F.col("ids"), confs), 6).alias("conf"),
    )


@query("greedy_decode", f"""
    SELECT item_id, array_to_string(cs[:e - 1], '') AS label,
           round(list_product(list_transform(range(1, least(e, len(cs)) + 1), lambda k: 1 - k / 1000.0)), 6) AS prob
    FROM (SELECT item_id, cs, coalesce(list_position(cs, '.'), len(cs) + 1) AS e
          FROM (SELECT item_id, list_filter(string_split(text, ''), lambda c: instr('{CHARSET}', c) > 0) AS cs FROM benchmark))""")
def greedy_decode(tb: Tables):
    """Each character is a step; '.' is end of text. A weaker rival token stands beside each best token."""
    kept = F.filter(t.chars(F.col("text")), lambda c: F.position(c, F.lit(CHARSET)) > 0)
    steps = tb.read("benchmark").select("item_id", F.posexplode(kept).alias("k", "token"))
    steps = steps.select("item_id", (F.col("k") + 1).alias("step"), "token", (1 - (F.col("k") + 1) / 1000.0).alias("prob"))
    rivals = steps.select("item_id", "step", F.lit("~").alias("token"), (F.col("prob") / 100).alias("prob"))
    out = prep.greedy_decode(steps.unionByName(rivals), ["item_id"], ".")
    return out.select("item_id", "label", F.round("prob", 6).alias("prob"))


@query("clean_list_block", sql(f"""
    SELECT doc_id, md5(array_to_string(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda x: {sql_strip('x')}),
           lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '^[0-9]+[.)]') THEN x
           WHEN regexp_matches(x, '^[•・◦▪▸]') THEN regexp_replace(x, '^[•・◦▪▸]{WS2}*', '- ') ELSE '- ' || x END), chr(10))) AS h
    FROM documents"""))
def clean_list_block(tb: Tables):
    return tb.read("documents").select("doc_id", F.md5(t.clean_list_block(F.col("text"))).alias("h"))
