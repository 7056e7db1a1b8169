"""Queries over exports and renderers."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import geometry as g
from foliospark.operators import render as rn
from foliospark.plans.expression_queries import ESC_MD_SQL, sql_escape_html, sql_strip
from foliospark.plans.fixtures import Tables, sql
from foliospark.plans.registry import query

# --- fixed values: block types in turn over the lines of a document
TYPES = ["title", "section_heading", "list", "caption", "footnote", "equation", "reference", "paragraph"]

DOC = {
    "blk": """
      SELECT doc_id, (k - 1) // 10 + 1 AS page_num, (k - 1) % 10 AS block_idx, line AS txt,
             ['title', 'section_heading', 'list', 'caption', 'footnote', 'equation', 'reference', 'paragraph'][CAST(length(line) % 8 AS INTEGER) + 1] AS block_type,
             (length(line) % 100) / 100.0 AS confidence, 10 AS x1, 30 * ((k - 1) % 10) AS y1, 10 + length(line) AS x2, 30 * ((k - 1) % 10) + 25 AS y2,
             9 - (k - 1) % 10 AS pos
      FROM (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS k, unnest(string_split(text, chr(10))) AS line FROM documents)""",
    "pg": "SELECT doc_id, page_num, 1000 AS width, 1400 AS height FROM blk GROUP BY doc_id, page_num",
    "cel": """SELECT tbl AS doc_id, 1 AS page_num, 0 AS table_idx, r - 1 AS "row", col - 1 AS col, txt, head = 1 AS is_header FROM cells
              WHERE tbl IN (SELECT doc_id FROM documents)""",
    "tb": "SELECT doc_id, page_num, table_idx, 0 AS x1, 0 AS y1, 300 AS x2, 100 AS y2, count(*) AS num_cells, max(\"row\") + 1 AS rows, max(col) + 1 AS cols FROM cel GROUP BY ALL",
}


def blocks(tb: Tables):
    rows = tb.read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    k = F.col("k").cast("bigint")
    kind = F.get(F.array(*map(F.lit, TYPES)), (F.length("text") % 8).cast("int"))
    return rows.select(
        "doc_id", (F.expr("k div 10") + 1).alias("page_num"), (k % 10).alias("block_idx"), "text", kind.alias("block_type"),
        ((F.length("text") % 100) / 100.0).alias("confidence"), F.lit(10).alias("x1"), (30 * (k % 10)).alias("y1"),
        (10 + F.length("text")).alias("x2"), (30 * (k % 10) + 25).alias("y2"), (9 - k % 10).alias("pos"))


def blocks_with_metadata(tb: Tables):
    return blocks(tb).withColumn("metadata", F.concat(F.lit('{"n":'), F.col("block_idx").cast("string"), F.lit("}")))


def pages(tb: Tables):
    k = F.size(F.split("text", "\n"))
    last = F.expr("(n - 1) div 10 + 1")
    docs = tb.read("documents").select("doc_id", k.cast("bigint").alias("n"))
    return docs.select("doc_id", F.explode(F.sequence(F.lit(1).cast("bigint"), last)).alias("page_num"), F.lit(1000).alias("width"), F.lit(1400).alias("height"))


def docs(tb: Tables):
    return tb.read("documents").select("doc_id", F.concat(F.lit("in/doc"), F.col("doc_id").cast("string"), F.lit(".v1.pdf")).alias("filename"))


def cells(tb: Tables):
    known = tb.read("documents").select(F.col("doc_id").alias("tbl"))
    return tb.cells.join(known, "tbl", "left_semi").select(
        F.col("tbl").alias("doc_id"), F.lit(1).cast("bigint").alias("page_num"), F.lit(0).cast("bigint").alias("table_idx"),
        (F.col("r") - 1).alias("row"), (F.col("col") - 1).alias("col"), "txt", (F.col("head") == 1).alias("is_header"))


def tables(tb: Tables):
    return cells(tb).select("doc_id", "page_num", "table_idx").distinct().select(
        "*", F.lit(0).alias("x1"), F.lit(0).alias("y1"), F.lit(300).alias("x2"), F.lit(100).alias("y2"))


BLOCK_JSON = """'"text":' || CAST(to_json(txt) AS VARCHAR) || ',"block_type":"' || block_type || '","bbox":[' || x1 || ',' || y1 || ',' || x2 || ',' || y2
    || '],"confidence":' || CAST(confidence AS DOUBLE) || ',"metadata":{"n":' || block_idx || '}'"""
TABLE_JSON = """
      SELECT t.*, '"cells":[' || js || '],"num_cells":' || num_cells || ',"bbox":[0,0,300,100],"dimensions":{"rows":' || rows || ',"cols":' || cols || '}' AS js
      FROM tb t JOIN (SELECT doc_id, string_agg('{"row":' || "row" || ',"col":' || col || ',"text":"' || txt || '"}', ',' ORDER BY "row", col) AS js FROM cel GROUP BY doc_id) c
        ON t.doc_id = c.doc_id"""


@query("export_nested", sql(f"""
    SELECT p.doc_id, p.page_num, coalesce(b.n, 0) AS n_blocks, coalesce(t.num_cells, 0) AS num_cells, coalesce(t.rows, 0) AS rows, b.ids AS reading_order,
           md5('{{"type":"page","page_num":' || p.page_num || ',"width":1000,"height":1400,"text_blocks":[' || coalesce(b.js, '') || '],"tables":['
               || coalesce('{{' || t.js || '}}', '') || '],"reading_order":[' || coalesce(b.ids, '') || '],"graphs":[' || p.page_num || '],"charts":[]}}') AS h
    FROM pg p LEFT JOIN (SELECT doc_id, page_num, count(*) AS n, string_agg(CAST(block_idx AS VARCHAR), ',' ORDER BY pos) AS ids,
                                string_agg('{{' || {BLOCK_JSON} || '}}', ',' ORDER BY block_idx) AS js FROM blk GROUP BY doc_id, page_num) b
      ON p.doc_id = b.doc_id AND p.page_num = b.page_num LEFT JOIN tj t ON t.doc_id = p.doc_id AND t.page_num = p.page_num
    UNION ALL SELECT doc_id, -1, count(*), 0, 0, NULL, md5('{{"type":"document","filename":"in/doc' || doc_id || '.v1.pdf","num_pages":' || count(*) || ',"metadata":{{"id":' || doc_id || '}}}}')
      FROM pg GROUP BY doc_id""", "cells", **DOC, tj=TABLE_JSON))
def export_nested(tb: Tables):
    """The lines, and what is read back from them: block and cell numbers per page, page numbers per document."""
    heads = docs(tb).withColumn("metadata", F.concat(F.lit('{"id":'), F.col("doc_id").cast("string"), F.lit("}")))
    graphs = pages(tb).withColumn("graphs", F.concat(F.lit("["), F.col("page_num").cast("string"), F.lit("]"))).withColumn("charts", F.lit(None).cast("string"))
    lines = rn.export_nested(heads, graphs, blocks_with_metadata(tb), tables(tb), cells(tb))
    schema = ("type string, num_pages bigint, text_blocks array<struct<text:string>>, reading_order array<bigint>, "
              "tables array<struct<num_cells:bigint,dimensions:struct<rows:bigint,cols:bigint>>>")
    j = lines.select("doc_id", "page_num", F.md5("line").alias("h"), F.from_json("line", schema).alias("j"))
    head = F.col("j.type") == "document"
    total = lambda f: F.coalesce(F.aggregate(F.col("j.tables"), F.lit(0).cast("bigint"), f), F.lit(0))
    return j.select(
        "doc_id", "page_num", F.when(head, F.col("j.num_pages")).otherwise(F.size("j.text_blocks")).alias("n_blocks"),
        total(lambda acc, x: acc + x["num_cells"]).alias("num_cells"), total(lambda acc, x: acc + x["dimensions"]["rows"]).alias("rows"),
        F.when(~head, F.array_join(F.col("j.reading_order").cast("array<string>"), ",")).alias("reading_order"), "h")


@query("export_flat", sql(f"""
    SELECT doc_id, page_num, 0 AS kind, 0 AS idx, md5('{{"type":"page","page_num":' || page_num || ',"width":1000,"height":1400}}') AS h FROM pg
    UNION ALL SELECT doc_id, page_num, 1, block_idx, md5('{{"type":"text_block","page_num":' || page_num || ',"block_idx":' || block_idx || ',' || {BLOCK_JSON} || '}}') FROM blk
    UNION ALL SELECT doc_id, page_num, 2, table_idx, md5('{{"type":"table","page_num":1,"table_idx":0,' || js || '}}') FROM tj""", "cells", **DOC, tj=TABLE_JSON))
def export_flat(tb: Tables):
    out = rn.export_flat(pages(tb), blocks_with_metadata(tb), tables(tb), cells(tb))
    return out.select("doc_id", "page_num", "kind", "idx", F.md5("line").alias("h"))


@query("export_elements_csv", sql("""
    SELECT doc_id, page_num, 'text' AS element_type, CAST(block_idx AS VARCHAR) AS element_idx, block_type, md5(txt) AS h, x2, confidence FROM blk
    UNION ALL SELECT doc_id, page_num, 'table', '0', 'table', md5('Table with ' || num_cells || ' cells'), x2, NULL FROM tb
    UNION ALL SELECT doc_id, page_num, 'table_cell', '0_' || "row" || '_' || col, CASE WHEN is_header THEN 'table_header' ELSE 'table_cell' END, md5(txt), NULL, NULL FROM cel""",
    "cells", **DOC))
def export_elements_csv(tb: Tables):
    out = rn.export_elements_csv(blocks(tb), tables(tb), cells(tb))
    return out.select("doc_id", "page_num", "element_type", "element_idx", "block_type", F.md5("text").alias("h"), "x2", "confidence")


TABLE_MD = """
      SELECT doc_id, string_agg('| ' || line || ' |' || CASE WHEN "row" = 0 THEN chr(10) || '|---|---|---|' ELSE '' END, chr(10) ORDER BY "row") AS md,
             '<table>' || string_agg('<tr>' || h || '</tr>', '' ORDER BY "row") || '</table>' AS html
      FROM (SELECT doc_id, "row", string_agg(txt, ' | ' ORDER BY col) AS line,
                   string_agg(CASE WHEN is_header THEN '<th>' || txt || '</th>' ELSE '<td>' || txt || '</td>' END, '' ORDER BY col) AS h FROM cel GROUP BY doc_id, "row")
      GROUP BY doc_id"""


def md_block_sql() -> str:
    s = sql_strip("txt")
    low = "CASE WHEN confidence < 0.8 THEN ' <!-- confidence: ' || printf('%.2f', CAST(confidence AS DOUBLE)) || ' -->' ELSE '' END"
    item = (f"CASE WHEN regexp_matches({s}, '^[0-9]+[.)]') THEN {s} WHEN regexp_matches({s}, '^[•・◦▪▸]') THEN regexp_replace({s}, '^[•・◦▪▸][ ]*', '- ') "
            f"ELSE '- ' || {s} END")
    return f"""
      SELECT doc_id, page_num, pos, CASE WHEN {s} = '' THEN NULL ELSE CASE block_type WHEN 'title' THEN '## ' || {s} WHEN 'section_heading' THEN '### ' || {s}
             WHEN 'list' THEN {item} WHEN 'caption' THEN '*' || {s} || '*' WHEN 'footnote' THEN '> ' || {s} WHEN 'equation' THEN '$' || {s} || '$'
             WHEN 'reference' THEN '[' || {s} || ']' ELSE {s} END || {low} END AS md FROM blk"""


@query("render_markdown", sql("""
    SELECT doc_id, md5(string_agg(piece, chr(10) ORDER BY page_num, section, pos)) AS h FROM (
      SELECT doc_id, -1 AS page_num, 0 AS section, 0 AS pos, '# doc' || doc_id || '.v1.pdf' || chr(10) AS piece FROM documents
      UNION ALL SELECT doc_id, page_num, 0, 0, '## Page ' || page_num || chr(10) FROM pn WHERE n > 1
      UNION ALL SELECT doc_id, page_num, 1, pos, md || chr(10) FROM mdb WHERE md IS NOT NULL
      UNION ALL SELECT doc_id, 1, 2, 0, md || chr(10) FROM tmd
      UNION ALL SELECT doc_id, page_num, 3, 0, '---' || chr(10) FROM pn WHERE page_num < n) GROUP BY doc_id""", "cells", **DOC,
    tmd=TABLE_MD, mdb=md_block_sql(), pn="SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM pg"))
def render_markdown(tb: Tables):
    from foliospark.operators.tables import table_markdown

    keys = ["doc_id", "page_num", "table_idx"]
    made = table_markdown(cells(tb).withColumn("low_confidence", F.lit(False)), keys, mark_low=True).withColumnRenamed("md", "markdown")
    out = rn.render_markdown(docs(tb), pages(tb), blocks(tb), made, show_confidence=True)
    return out.select("doc_id", F.md5("md").alias("h"))


@query("render_html", sql(f"""
    SELECT doc_id, md5(string_agg(piece, chr(10) ORDER BY page_num, section, pos)) AS h FROM (
      SELECT doc_id, -1 AS page_num, 0 AS section, 0 AS pos, '<!DOCTYPE html>' || chr(10) || '<html lang="ja">' || chr(10) || '<head>' || chr(10) || '<meta charset="UTF-8">' || chr(10)
             || '<meta name="viewport" content="width=device-width, initial-scale=1.0">' || chr(10) || '<title>doc' || doc_id || '.v1</title>' || chr(10) || '</head>' || chr(10) || '<body>' || chr(10)
             || '<div class="document-info">' || chr(10) || '<h1>doc' || doc_id || '.v1.pdf</h1>' || chr(10) || '<p>Pages: ' || count(*) || '</p>' || chr(10) || '</div>' AS piece FROM pg GROUP BY doc_id
      UNION ALL SELECT doc_id, -1, 1, 0, '<section class="llm-results">' || chr(10) || '<h2>LLM Results</h2>' || chr(10) || '<div class="llm-summary">' || chr(10) || '<h3>Summary</h3>' || chr(10)
             || '<p>' || lang || '&amp;</p>' || chr(10) || '</div>' || chr(10) || '<div class="llm-qa">' || chr(10) || '<h3>Q&A</h3>' || chr(10) || '<p><strong>Q:</strong> ' || source || '</p>' || chr(10)
             || '<p><strong>A:</strong> </p>' || chr(10) || '</div>' || chr(10) || '</section>' FROM documents WHERE doc_id % 3 = 0
      UNION ALL SELECT doc_id, page_num, 0, 0, '<div class="page" id="page-' || page_num || '">' || chr(10) || '<h2>Page ' || page_num || '</h2>' FROM pg
      UNION ALL SELECT doc_id, page_num, 1, pos, '<div class="text-block ' || block_type || CASE WHEN confidence < 0.8 THEN ' confidence-low' ELSE '' END || '">' ||
             CASE block_type WHEN 'title' THEN '<h3>' || {sql_escape_html('txt')} || '</h3>' WHEN 'section_heading' THEN '<h4>' || {sql_escape_html('txt')} || '</h4>'
             ELSE '<p>' || {sql_escape_html('txt')} || '</p>' END || '</div>' FROM blk
      UNION ALL SELECT doc_id, 1, 2, 0, html FROM tmd
      UNION ALL SELECT doc_id, page_num, 3, 0, '</div>' FROM pg
      UNION ALL SELECT doc_id, 1000000000, 0, 0, '</body>' || chr(10) || '</html>' FROM documents) GROUP BY doc_id""", "cells", **DOC, tmd=TABLE_MD))
def render_html(tb: Tables):
    keys = ["doc_id", "page_num", "table_idx"]
    made = rn.cells_html(cells(tb).withColumn("low_confidence", F.lit(False)), keys)
    none = F.lit(None).cast("string")
    known = tb.read("documents").filter("doc_id % 3 = 0").select("doc_id", rn.model_section_html(F.concat("lang", F.lit("&")), F.col("source"), none, none).alias("model_html"))
    heads = docs(tb).join(known, "doc_id", "left")
    return rn.render_html(heads, pages(tb), blocks(tb), made).select("doc_id", F.md5("html").alias("h"))


PAGES = {
    "par": """
      SELECT conv_id AS page, turn * 2 AS "order", text AS txt, CASE WHEN role = 'user' THEN 'section_headings' END AS role FROM conversations""",
    "cel": """SELECT tbl AS page, 0 AS idx, r AS "row", col, txt || ', "' || chr(10) || 'x' AS txt, CASE WHEN r = 1 AND col = 1 THEN 2 ELSE 1 END AS row_span FROM cells
              WHERE tbl IN (SELECT conv_id FROM conversations) AND NOT (r = 2 AND col = 1)""",
    "tbs": 'SELECT page, 1 AS "order", max("row") AS n FROM cel GROUP BY page',
    "grid": """SELECT t.page, t."order", r, c, coalesce(x.txt, '') AS txt FROM (SELECT *, unnest(range(1, n + 1)) AS r FROM tbs) t CROSS JOIN (SELECT unnest([1, 2, 3]) AS c) k
               LEFT JOIN cel x ON x.page = t.page AND x."row" = t.r AND x.col = k.c""",
}

#: One figure on each page, with the assistant's turns inside.
INSIDE = "SELECT conv_id AS page, 3 AS \"order\", turn + 1 AS sub, text AS txt FROM conversations WHERE role = 'assistant'"


def page_figures(tb: Tables):
    return tb.read("conversations").select(F.col("conv_id").alias("page")).distinct().select("page", F.lit(0).alias("idx"), F.lit(3).cast("bigint").alias("order"))


def figure_paragraphs(tb: Tables):
    return tb.read("conversations").filter("role = 'assistant'").select(
        F.col("conv_id").alias("page"), F.lit(0).alias("figure"), F.col("turn").alias("order"), "text", F.lit(None).cast("string").alias("role"))


def page_paragraphs(tb: Tables):
    return tb.read("conversations").select(
        F.col("conv_id").alias("page"), (F.col("turn") * 2).alias("order"), "text", F.when(F.col("role") == "user", "section_headings").alias("role"))


def page_cells(tb: Tables):
    known = tb.read("conversations").select(F.col("conv_id").alias("tbl")).distinct()
    rows = tb.cells.join(known, "tbl", "left_semi").filter(~((F.col("r") == 2) & (F.col("col") == 1)))
    return rows.select(
        F.col("tbl").alias("page"), F.lit(0).alias("idx"), F.col("r").alias("row"), "col", F.concat("txt", F.lit(', "\nx')).alias("txt"),
        F.when((F.col("r") == 1) & (F.col("col") == 1), 2).otherwise(1).alias("row_span"), F.lit(1).alias("col_span"))


def page_table_heads(tb: Tables):
    return page_cells(tb).groupBy("page", "idx").agg(F.max("row").alias("n_row")).withColumn("n_col", F.lit(3)).withColumn("order", F.lit(1).cast("bigint"))


@query("page_markdown", sql(f"""
    SELECT page, md5(string_agg(piece, chr(10) ORDER BY "order", sub)) AS h FROM (
      SELECT page, "order", 0 AS sub, CASE WHEN role IS NOT NULL THEN '# ' ELSE '' END || replace({ESC_MD_SQL.format(c='txt')}, chr(10), '<br>') || chr(10) AS piece FROM par
      UNION ALL SELECT DISTINCT conv_id, 3, 0, '<img src="figures/' || conv_id || '_figure_0.png" width="200px"><br>' FROM conversations
      UNION ALL SELECT page, "order", sub, replace({ESC_MD_SQL.format(c='txt')}, chr(10), '<br>') || chr(10) FROM ins
      UNION ALL SELECT page, "order", 0, string_agg('|' || line || '|' || chr(10) || CASE WHEN r = 1 THEN '|-|-|-|' || chr(10) ELSE '' END, '' ORDER BY r) FROM (
        SELECT page, "order", r, string_agg(replace({ESC_MD_SQL.format(c='txt')}, chr(10), '<br>'), '|' ORDER BY c) AS line FROM grid GROUP BY page, "order", r) GROUP BY page, "order")
    GROUP BY page""", "cells", **PAGES, ins=INSIDE))
def page_markdown(tb: Tables):
    out = rn.page_markdown(page_paragraphs(tb), page_table_heads(tb), page_cells(tb), figures=page_figures(tb), figure_paragraphs=figure_paragraphs(tb))
    return out.select("page", F.md5("md").alias("h"))


@query("page_html", sql(f"""
    SELECT page, md5(string_agg(piece, '' ORDER BY "order", sub)) AS h FROM (
      SELECT page, "order", 0 AS sub, '<p>' || CASE WHEN role IS NOT NULL THEN '<h1>' ELSE '' END || replace({sql_escape_html('txt')}, chr(10), '<br>')
             || CASE WHEN role IS NOT NULL THEN '</h1>' ELSE '' END || '</p>' AS piece FROM par
      UNION ALL SELECT DISTINCT conv_id, 3, 0, '<img src="figures/' || conv_id || '_figure_0.png" width="200"><br>' FROM conversations
      UNION ALL SELECT page, "order", sub, '<p>' || replace({sql_escape_html('txt')}, chr(10), '<br>') || '</p>' FROM ins
      UNION ALL SELECT page, 1, 0, '<table border="1" style="border-collapse: collapse">' || string_agg('<tr>' || line || '</tr>', '' ORDER BY "row") || '</table>' FROM (
        SELECT page, "row", string_agg('<td rowspan="' || row_span || '" colspan="1">' || replace({sql_escape_html('txt')}, chr(10), '<br>') || '</td>', '' ORDER BY col) AS line
        FROM cel GROUP BY page, "row") GROUP BY page)
    GROUP BY page""", "cells", **PAGES, ins=INSIDE))
def page_html(tb: Tables):
    out = rn.page_html(page_paragraphs(tb), page_table_heads(tb), page_cells(tb), figures=page_figures(tb), figure_paragraphs=figure_paragraphs(tb))
    return out.select("page", F.md5("html").alias("h"))


CSV_SQL = "CASE WHEN regexp_matches({c}, '[,\"\r\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"


@query("page_csv", sql(f"""
    SELECT page, md5(string_agg(piece || chr(13) || chr(10) || '""' || chr(13) || chr(10), '' ORDER BY "order", sub)) AS h FROM (
      SELECT page, "order", 0 AS sub, {CSV_SQL.format(c='txt')} AS piece FROM par
      UNION ALL SELECT page, "order", sub, {CSV_SQL.format(c='txt')} FROM ins
      UNION ALL SELECT page, "order", 0, string_agg(line, chr(13) || chr(10) ORDER BY r) FROM (
        SELECT page, "order", r, string_agg({CSV_SQL.format(c='txt')}, ',' ORDER BY c) AS line FROM grid GROUP BY page, "order", r) GROUP BY page, "order")
    GROUP BY page""", "cells", **PAGES, ins=INSIDE))
def page_csv(tb: Tables):
    out = rn.page_csv(page_paragraphs(tb), page_table_heads(tb), page_cells(tb), figures=page_figures(tb), figure_paragraphs=figure_paragraphs(tb))
    return out.select("page", F.md5("csv").alias("h"))


@query("page_json", """
    SELECT conv_id AS page, turn * 2 AS "order", 'box,contents,direction,order,role' AS keys, md5(replace(text, chr(10), '')) AS h FROM conversations""")
def page_json(tb: Tables):
    rows = page_paragraphs(tb).select("*", F.lit("horizontal").alias("direction"), *(F.lit(i).alias(s) for i, s in enumerate(g.SIDES)))
    out = rn.page_json(rows, drop_breaks=True)
    return out.select("page", "order", F.array_join(F.json_object_keys("json"), ",").alias("keys"), F.md5(F.get_json_object("json", "$.contents")).alias("h"))


BOX0 = '"box":[0,1,2,3]'


@query("page_document", sql(f"""
    SELECT c.page, md5('{{"figures":[{{{BOX0},"direction":"horizontal","order":3,"paragraphs":[' || coalesce(i.js, '') || ']}}],"paragraphs":[' || c.js || '],"tables":['
      || coalesce('{{{BOX0},"cells":[' || t.js || '],"n_col":3,"n_row":' || t.n || ',"order":1}}', '') || '],"words":[' || c.wjs || ']}}') AS h
    FROM (SELECT conv_id AS page, string_agg('{{{BOX0},"contents":' || CAST(to_json(replace(text, chr(10), '')) AS VARCHAR) || ',"direction":"horizontal","order":' || turn * 2 || ',"role":'
            || CASE WHEN role = 'user' THEN '"section_headings"' ELSE 'null' END || '}}', ',' ORDER BY turn) AS js,
            string_agg('{{"content":' || CAST(to_json(text) AS VARCHAR) || ',"det_score":0.25,"direction":"horizontal","points":[[0,0],[1,0],[1,1],[0,1]],"rec_score":0.5}}', ',' ORDER BY turn) AS wjs
          FROM conversations GROUP BY conv_id) c
    LEFT JOIN (SELECT page, string_agg('{{{BOX0},"contents":' || CAST(to_json(replace(txt, chr(10), '')) AS VARCHAR) || ',"direction":"horizontal","order":' || (sub - 1) || ',"role":null}}', ',' ORDER BY sub) AS js
               FROM ins GROUP BY page) i ON i.page = c.page
    LEFT JOIN (SELECT page, max("row") AS n, string_agg('{{{BOX0},"col":' || col || ',"col_span":1,"contents":' || CAST(to_json(replace(txt, chr(10), '')) AS VARCHAR) || ',"row":' || "row"
               || ',"row_span":' || row_span || '}}', ',' ORDER BY "row", col) AS js FROM cel GROUP BY page) t ON t.page = c.page""", "cells", **PAGES, ins=INSIDE))
def page_document(tb: Tables):
    boxed = lambda df: df.select("*", F.lit("horizontal").alias("direction"), *(F.lit(i).alias(s) for i, s in enumerate(g.SIDES)))
    points = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))))
    words = tb.read("conversations").select(F.col("conv_id").alias("page"), F.col("turn").alias("n"), F.col("text").alias("content"), F.lit("horizontal").alias("direction"),
                                            F.lit(0.5).alias("rec_score"), F.lit(0.25).alias("det_score"), points.alias("points"))
    out = rn.page_document(page_figures(tb), boxed(page_paragraphs(tb)), boxed(page_table_heads(tb)), boxed(page_cells(tb)), words, boxed(page_figures(tb)),
                           boxed(figure_paragraphs(tb)), drop_breaks=True)
    return out.select("page", F.md5("json").alias("h"))


@query("text_layer", sql("""
    SELECT doc_id, page_num, 'block' AS kind, pos AS idx, 0 AS line, 10 AS x, round(1400 - y2 + 25 - size * 1.1 + 1e-9, 4) AS y, round(size + 1e-9, 4) AS size, md5(txt) AS h FROM (
      SELECT *, CASE WHEN x2 - x1 <= 0 OR needed <= lines THEN base ELSE greatest(6, base * lines / needed) END AS size FROM (
        SELECT *, greatest(1, 25 / (base * 1.2)) AS lines, greatest(1, length(txt)) / greatest(1, (x2 - x1) / (base * 0.6)) AS needed FROM (
          SELECT *, CAST(CASE block_type WHEN 'title' THEN 16 WHEN 'section_heading' THEN 14 WHEN 'caption' THEN 9 WHEN 'footnote' THEN 8 ELSE 11 END AS DOUBLE) AS base FROM blk)))
    WHERE txt <> '' AND 1400 - y2 + 25 - size * 1.1 >= 0
    UNION ALL SELECT doc_id, page_num, 'cell', "row" * 10 + col, 0, 100 * col, round(1400 - (20 * "row" + 24) + (24 - 9.6 * 1.1) / 2 + 1e-9, 4), 9.6, md5(txt) FROM cel""", "cells", **DOC))
def text_layer(tb: Tables):
    c = cells(tb).select("doc_id", "page_num", (F.col("row") * 10 + F.col("col")).alias("idx"), "txt", (100 * F.col("col")).alias("x1"),
                         (20 * F.col("row")).alias("y1"), (100 * F.col("col") + 100).alias("x2"), (20 * F.col("row") + 24).alias("y2"))
    out = rn.text_layer(pages(tb), blocks(tb), c, ["doc_id", "page_num"])
    return out.select("doc_id", "page_num", "kind", "idx", "line", "x", F.round(F.col("y") + 1e-9, 4).alias("y"),
                      F.round(F.col("size") + 1e-9, 4).alias("size"), F.md5("text").alias("h"))


@query("silver_tables", sql("""
    SELECT doc, tbl AS table_idx, md5(pred) AS h, CASE WHEN tbl = min(tbl) OVER (PARTITION BY doc) THEN 1 ELSE 0 END AS is_first
    FROM (SELECT tbl // 8 AS doc, tbl, pred FROM html_pairs WHERE pred <> '<table></table>') WHERE doc NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""", "html_pairs"))
def silver_tables(tb: Tables):
    html = F.when(F.col("pred") == "<table></table>", " \n").otherwise(F.col("pred"))
    pred = tb.html_pairs.select(F.expr("tbl div 8").alias("doc"), F.col("tbl").alias("table_idx"), html.alias("html"))
    existing = tb.read("labels").filter("quality = 1").select(F.col("doc_id").alias("doc"))
    return rn.silver_tables(pred, existing, doc="doc").select("doc", "table_idx", F.md5("html").alias("h"), "is_first")
