"""Queries over reading order and page assembly."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import geometry as g
from foliospark.operators import boxes as ob, reading as rd
from foliospark.plans.fixtures import Tables, sql
from foliospark.plans.page_queries import CLUSTER_SQL
from foliospark.plans.registry import query

PAGE = ["page"]


def sized(tb: Tables):
    return tb.boxes.select("page", "idx", *g.SIDES).withColumn("w", F.lit(320)).withColumn("h", F.lit(320))


SIMPLE = {
    "blocks": "SELECT page, idx, x1, y1, x2, y2, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM gantt_blocks",
    **CLUSTER_SQL,
    "placed": "SELECT b.*, w.cluster FROM blocks b JOIN walk w ON b.page = w.page AND CAST(b.x1 + b.x2 AS DOUBLE) / 2 / 1000 = w.x",
    "means": "SELECT page, cluster, avg(cx) AS mx, avg(cy) AS my, count(*) OVER (PARTITION BY page) AS n FROM placed GROUP BY page, cluster",
}


@query("reading_order_simple", sql("""
    SELECT p.page, p.idx, row_number() OVER (PARTITION BY p.page ORDER BY CASE WHEN n >= 2 THEN mx ELSE my END, p.cluster, cy, cx, idx) - 1 AS pos
    FROM placed p JOIN means m ON p.page = m.page AND p.cluster = m.cluster""", "gantt_blocks", **SIMPLE))
def reading_order_simple(tb: Tables):
    blocks = tb.gantt_blocks.withColumn("w", F.lit(1000))
    return rd.reading_order_simple(blocks, PAGE, "w").select("page", "idx", "pos")


@query("reading_order_vertical", sql("""
    SELECT p.page, p.idx, row_number() OVER (PARTITION BY p.page ORDER BY -mx, p.cluster, -cx, cy, idx) - 1 AS pos
    FROM placed p JOIN means m ON p.page = m.page AND p.cluster = m.cluster""", "gantt_blocks", **SIMPLE))
def reading_order_vertical(tb: Tables):
    blocks = tb.gantt_blocks.withColumn("w", F.lit(1000))
    return rd.reading_order_simple(blocks, PAGE, "w", vertical=True).select("page", "idx", "pos")


COMPONENTS = {
    "pt": "SELECT page, idx, (x1 + x2) / 2 / 320 AS px, (y1 + y2) / 2 / 320 AS py FROM boxes",
    "dist": "SELECT a.page, a.idx AS i, b.idx AS j, sqrt((a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py)) AS d FROM pt a JOIN pt b ON a.page = b.page",
    "eps": "SELECT page, median(d) * 1.5 AS e FROM dist WHERE i < j GROUP BY page",
    "hop": "SELECT d.page, i, j FROM dist d LEFT JOIN eps USING (page) WHERE i = j OR d <= e",
    "reach": """-- recursive
      SELECT page, i, j FROM hop UNION SELECT r.page, r.i, h.j FROM reach r JOIN hop h ON r.page = h.page AND r.j = h.i""",
}


@query("region_components", sql("SELECT page, i AS idx, min(j) AS first_idx FROM reach GROUP BY page, i", "boxes", **COMPONENTS))
def region_components(tb: Tables):
    out = rd.region_components(sized(tb), PAGE, "w", "h")
    first = out.groupBy("page", "region").agg(F.min("idx").alias("first_idx"))
    return out.join(first, ["page", "region"]).select("page", "idx", "first_idx")


EDGES = {
    "chain": "SELECT page, lag(idx) OVER (PARTITION BY page, label ORDER BY (y1 + y2) / 2, (x1 + x2) / 2, idx) AS src, idx AS dst FROM boxes QUALIFY src IS NOT NULL",
    "props": """SELECT page, label, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, arg_max(idx, (y2, -idx)) AS l, arg_min(idx, (y1, idx)) AS f
                FROM boxes GROUP BY page, label""",
    "multi": """SELECT DISTINCT a.page FROM props a JOIN props b ON a.page = b.page AND a.label < b.label
                AND least(a.y2, b.y2) - greatest(a.y1, b.y1) > 0.5 * least(a.y2 - a.y1, b.y2 - b.y1)""",
    "link": """SELECT page, lag(l) OVER (PARTITION BY page ORDER BY CASE WHEN page IN (SELECT page FROM multi) THEN (x1 + x2) / 2 ELSE (y1 + y2) / 2 END, label) AS src,
               f AS dst FROM props QUALIFY src IS NOT NULL""",
}


def edges(tb: Tables):
    return rd.region_edges(tb.boxes, PAGE, "label")


@query("region_edges", sql("SELECT page, src, dst, 'chain' AS kind FROM chain UNION ALL SELECT page, src, dst, 'link' FROM link", "boxes", **EDGES))
def region_edges(tb: Tables):
    return edges(tb)


@query("reading_path")
def reading_path(tb: Tables):
    return rd.reading_path(sized(tb), edges(tb), PAGE, "w")


def precedence_sql(direction: str) -> str:
    if direction == "top2bottom":
        share = lambda a, b: f"least({a}.x2, {b}.x2) > greatest({a}.x1, {b}.x1)"
        lo, hi, first = "y1", "y2", "n.y1 < o.y1"
    else:
        share = lambda a, b: f"greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1)) / least({a}.y2 - {a}.y1, {b}.y2 - {b}.y1) >= 0.5"
        lo, hi = "x1", "x2"
        first = "NOT (n.x2 < o.x2)" if direction == "right2left" else "NOT (o.x2 < n.x2)"
    return sql(f"""
    SELECT DISTINCT n.page, CASE WHEN {first} THEN n.idx ELSE o.idx END AS src, CASE WHEN {first} THEN o.idx ELSE n.idx END AS dst, '{direction}' AS direction
    FROM boxes n JOIN boxes o ON n.page = o.page AND n.idx <> o.idx AND {share('n', 'o')}
    WHERE NOT EXISTS (SELECT 1 FROM boxes s WHERE s.page = n.page AND s.idx <> n.idx AND s.idx <> o.idx AND {share('s', 'n')}
      AND ((n.{hi} < s.{lo} AND s.{lo} < o.{lo} AND n.{hi} < s.{hi} AND s.{hi} < o.{lo})
        OR (o.{hi} < s.{lo} AND s.{lo} < n.{lo} AND o.{hi} < s.{hi} AND s.{hi} < n.{lo})))""", "boxes")


@query("precedence_edges", precedence_sql("top2bottom"))
def precedence_edges(tb: Tables):
    return rd.precedence_edges(tb.boxes, PAGE, "top2bottom").withColumn("direction", F.lit("top2bottom"))


@query("precedence_edges_left2right", precedence_sql("left2right"))
def precedence_edges_left2right(tb: Tables):
    return rd.precedence_edges(tb.boxes, PAGE, "left2right").withColumn("direction", F.lit("left2right"))


@query("precedence_edges_right2left", precedence_sql("right2left"))
def precedence_edges_right2left(tb: Tables):
    return rd.precedence_edges(tb.boxes, PAGE, "right2left").withColumn("direction", F.lit("right2left"))


@query("priority_dfs")
def priority_dfs(tb: Tables):
    return rd.priority_order(tb.boxes, PAGE, F.lit("top2bottom"))


def directed_words(tb: Tables):
    return tb.words.withColumn("direction", g.word_direction(g.quad_of_box(g.box())))


@query("assemble_text")
def assemble_text(tb: Tables):
    pairs = ob.words_in_elements(directed_words(tb), tb.elements, PAGE)
    return rd.assemble_text(pairs, PAGE).withColumnRenamed("o_idx", "idx")


def page_parts(tb: Tables):
    """Each page with more than 108 words carries one table over its fourth text band, with 3 x 4 cells."""
    tables = tb.elements.filter("idx = 3").select("page", F.lit(0).cast("bigint").alias("idx"), *g.SIDES)
    k = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(11).cast("bigint")))
    cells = tables.select("page", F.col("idx").alias("tbl"), "y1", k.alias("idx")).select(
        "page", "tbl", "idx", (135 * (F.col("idx") % 4)).alias("x1"), (F.col("y1") + F.expr("30 * (idx div 4)")).alias("y1"),
        (135 * (F.col("idx") % 4) + 135).alias("x2"), (F.col("y1") + F.expr("30 * (idx div 4) + 30")).alias("y2"))
    paragraphs = tb.elements.filter("idx <> 3")
    return paragraphs, cells, tables


@query("cell_texts")
def cell_texts(tb: Tables):
    _, cells, _ = page_parts(tb)
    return rd.cell_texts(cells, directed_words(tb), PAGE).select("page", "idx", "text")


def assembled(tb: Tables):
    paragraphs, cells, tables = page_parts(tb)
    return rd.assemble_page(directed_words(tb), paragraphs, cells, tables, tb.figures)


@query("assemble_page")
def assemble_page(tb: Tables):
    return assembled(tb)["elements"].select("page", "kind", "section", "order", "text", "role")


@query("ocr_zip", sql("""
    SELECT w.page, w.n AS pos, w.x1, b.score FROM words w JOIN boxes b ON w.page = b.page AND w.n = b.idx - 1""", "words", "boxes"))
def ocr_zip(tb: Tables):
    det = tb.words.select("page", F.col("n").alias("pos"), "x1")
    rec = tb.boxes.select("page", (F.col("idx") - 1).alias("pos"), "score")
    return rd.ocr_zip(det, rec, PAGE)


@query("ordered_text", """
    SELECT conv_id, md5(string_agg(text, chr(10) ORDER BY page, CASE WHEN n > 1 AND page % 2 = 0 THEN -k ELSE k END)) AS h FROM (
      SELECT conv_id, turn // 4 AS page, text, row_number() OVER (PARTITION BY conv_id, turn // 4 ORDER BY turn) AS k, count(*) OVER (PARTITION BY conv_id, turn // 4) AS n
      FROM conversations) GROUP BY conv_id""")
def ordered_text(tb: Tables):
    """Even pages are listed backwards, with one index that does not exist; odd pages have no order."""
    turns = tb.read("conversations").selectExpr("conv_id", "turn div 4 as page", "turn % 4 as idx", "text")
    n = turns.groupBy("conv_id", "page").agg(F.array_sort(F.collect_list("idx")).alias("ids"))
    order = F.when((F.col("page") % 2 == 0) & (F.size("ids") > 1), F.concat(F.reverse("ids"), F.array(F.lit(99).cast("bigint"))))
    orders = n.select("conv_id", "page", F.coalesce(order, F.array().cast("array<bigint>")).alias("reading_order"))
    return rd.ordered_text(turns, orders, ["conv_id"]).select("conv_id", F.md5("text_all").alias("h"))


@query("direct_text_blocks", f"""
    SELECT doc_id AS page, k AS idx, CAST(10 AS DOUBLE) AS x1, CAST(20 * k - 20 AS DOUBLE) AS y1, CAST(500 AS DOUBLE) AS x2,
           CAST(20 * k AS DOUBLE) AS y2, md5(line) AS h, 'paragraph' AS block_type FROM (
      SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS k, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE trim(regexp_replace(line, '[ \t\n\f\r]+', ' ', 'g')) <> ''""")
def direct_text_blocks(tb: Tables):
    lines = tb.read("documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("k", "text"))
    idx = (F.col("k") + 1).cast("bigint")
    lines = lines.select("page", idx.alias("idx"), "text", F.lit(10).alias("x1"), (100000 - 20 * idx).alias("y1"),
                         F.lit(500).alias("x2"), (100020 - 20 * idx).alias("y2"))
    pages = tb.read("documents").select(F.col("doc_id").alias("page"), F.lit(100000).alias("height"))
    return rd.direct_text_blocks(lines, pages, PAGE).select("page", "idx", *g.SIDES, F.md5("text").alias("h"), "block_type")
