"""Documents and pages as JSON lines, CSV rows, Markdown, HTML and text-layer placements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.functions import geometry as g, text as t
from foliospark.operators.scan import ordered_concat, tiles

CHUNK = 512


def _lit(s: str) -> Column:
    return F.lit(s)


# ---- nested and flat export -----------------------------------------------------------------------------------

def table_summaries(tables: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Tables with their number of cells and their dimensions (highest index + 1)."""
    sizes = cells.groupBy(*keys, "table_idx").agg(
        F.count(F.lit(1)).alias("num_cells"), (F.max("row") + 1).alias("rows"), (F.max("col") + 1).alias("cols"))
    return tables.join(sizes, [*keys, "table_idx"], "left").na.fill(0, ["num_cells"])


def _optional(df: DataFrame, *names: str) -> list[Column]:
    """Those of the columns (JSON texts such as metadata) that the table has, as JSON values; null ones are left out."""
    return [F.try_parse_json(F.col(n)).alias(n) for n in names if n in df.columns]


def _table_json(tables: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Tables with `_table`: cells, num_cells, bbox and, where there are cells, dimensions, as the inside of a JSON object."""
    cell = F.to_json(F.struct("row", "col", F.col("txt").alias("text")))
    cell_list = ordered_concat(cells.withColumn("_j", cell), [*keys, "table_idx"], ["row", "col"], "_j", ",", "_cells", tiles(F.col("row"), CHUNK))
    full = table_summaries(tables, cells, keys).join(cell_list, [*keys, "table_idx"], "left")
    box = F.to_json(F.array(*g.SIDES))
    return full.withColumn("_table", F.concat(
        _lit('"cells":['), F.coalesce("_cells", _lit("")), _lit('],"num_cells":'), F.col("num_cells").cast("string"), _lit(',"bbox":'), box,
        F.coalesce(F.concat(_lit(',"dimensions":{"rows":'), F.col("rows").cast("string"), _lit(',"cols":'), F.col("cols").cast("string"), _lit("}")), _lit(""))))


def export_nested(docs: DataFrame, pages: DataFrame, blocks: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """JSON lines: per document a header line, then a line per page with its blocks, tables and reading order.

    Keys are doc_id and page_num. A line holds one page; the elements of a page are joined in two steps. Optional JSON columns:
    metadata of docs and blocks, graphs and charts of pages.
    """
    keys = ["doc_id", "page_num"]
    n_pages = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("num_pages"))
    head = docs.join(n_pages, "doc_id", "left").select(
        "doc_id", F.lit(-1).cast("bigint").alias("page_num"),
        F.to_json(F.struct(_lit("document").alias("type"), "filename", F.coalesce("num_pages", F.lit(0)).alias("num_pages"), *_optional(docs, "metadata"))).alias("line"))
    block = F.to_json(F.struct("text", "block_type", F.array(*g.SIDES).alias("bbox"), "confidence", *_optional(blocks, "metadata")))
    block_list = ordered_concat(blocks.withColumn("_j", block), keys, ["block_idx"], "_j", ",", "_blocks", tiles(F.col("block_idx"), CHUNK))
    order = ordered_concat(blocks.withColumn("_j", F.col("block_idx").cast("string")), keys, ["pos"], "_j", ",", "_order", tiles(F.col("pos"), CHUNK))
    full = _table_json(tables, cells, keys)
    table_list = ordered_concat(full.withColumn("_j", F.concat(_lit("{"), "_table", _lit("}"))), keys, ["table_idx"], "_j", ",", "_tables", tiles(F.col("table_idx"), CHUNK))
    rows = pages.join(block_list, keys, "left").join(order, keys, "left").join(table_list, keys, "left")
    part = lambda name, c: F.concat(_lit(f',"{name}":['), F.coalesce(c, _lit("")), _lit("]"))
    base = F.to_json(F.struct(_lit("page").alias("type"), "page_num", "width", "height"))
    more = [F.concat(_lit(f',"{n}":'), F.coalesce(F.col(n), _lit("[]"))) for n in ("graphs", "charts") if n in pages.columns]
    line = F.concat(F.expr("substring(_base, 1, length(_base) - 1)"), part("text_blocks", F.col("_blocks")), part("tables", F.col("_tables")),
                    part("reading_order", F.col("_order")), *more, _lit("}"))
    body = rows.withColumn("_base", base).select(*keys, line.alias("line"))
    return head.unionByName(body)


def export_flat(pages: DataFrame, blocks: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """One row per page, text block and table, ordered by (doc_id, page_num, kind, idx), as typed JSON lines."""
    keys = ["doc_id", "page_num"]
    zero = F.lit(0).cast("bigint")
    page = pages.select(*keys, F.lit(0).alias("kind"), zero.alias("idx"), F.to_json(
        F.struct(_lit("page").alias("type"), "page_num", "width", "height")).alias("line"))
    block = blocks.select(*keys, F.lit(1).alias("kind"), F.col("block_idx").alias("idx"), F.to_json(F.struct(
        _lit("text_block").alias("type"), "page_num", "block_idx", "text", "block_type", F.array(*g.SIDES).alias("bbox"), "confidence",
        *_optional(blocks, "metadata"))).alias("line"))
    table = _table_json(tables, cells, keys).select(*keys, F.lit(2).alias("kind"), F.col("table_idx").alias("idx"), F.concat(
        _lit('{"type":"table","page_num":'), F.col("page_num").cast("string"), _lit(',"table_idx":'), F.col("table_idx").cast("string"), _lit(","), "_table", _lit("}")).alias("line"))
    return page.unionByName(block).unionByName(table)


def export_elements_csv(blocks: DataFrame, tables: DataFrame, cells: DataFrame) -> DataFrame:
    """Flat rows: text, a summary per table, then its cells. The columns are fixed, whatever comes first."""
    keys = ["doc_id", "page_num"]
    box = [F.col(s).cast("double").alias(s) for s in g.SIDES]
    none = F.lit(None).cast("double")
    text = blocks.select(*keys, _lit("text").alias("element_type"), F.col("block_idx").cast("string").alias("element_idx"), "block_type",
                         F.replace("text", _lit("\n"), _lit(" ")).alias("text"), *box, F.col("confidence").cast("double").alias("confidence"))
    label = F.concat(_lit("Table with "), F.col("num_cells").cast("string"), _lit(" cells"))
    table = table_summaries(tables, cells, keys).select(
        *keys, _lit("table").alias("element_type"), F.col("table_idx").cast("string").alias("element_idx"), _lit("table").alias("block_type"),
        label.alias("text"), *box, none.alias("confidence"))
    cell = cells.select(
        *keys, _lit("table_cell").alias("element_type"),
        F.concat_ws("_", *(F.col(c).cast("string") for c in ("table_idx", "row", "col"))).alias("element_idx"),
        F.when(F.col("is_header"), "table_header").otherwise("table_cell").alias("block_type"), F.col("txt").alias("text"),
        *(none.alias(s) for s in g.SIDES), none.alias("confidence"))
    return text.unionByName(table).unionByName(cell)


# ---- whole documents ------------------------------------------------------------------------------------------

def block_markdown(text: Column, block_type: Column, confidence: Column, show_confidence: bool = False) -> Column:
    """A block by its type; null for a blank one."""
    body = t.strip(text)
    low = F.when(confidence < 0.8, F.concat(_lit(" <!-- confidence: "), F.format_string("%.2f", confidence), _lit(" -->"))).otherwise("")
    end = low if show_confidence else _lit("")
    around = lambda a, z: F.concat(_lit(a), body, _lit(z), end)
    return F.when(body != "", (
        F.when(block_type == "title", around("## ", "")).when(block_type == "section_heading", around("### ", ""))
        .when(block_type == "list", F.concat(t.clean_list_block(body), end)).when(block_type == "caption", around("*", "*"))
        .when(block_type == "footnote", around("> ", ""))
        .when((block_type == "equation") & body.contains("\n"), around("$$\n", "\n$$")).when(block_type == "equation", around("$", "$"))
        .when(block_type == "reference", around("[", "]"))
        .otherwise(F.concat(F.replace(body, _lit("\n"), _lit("  \n")), end))))


def model_section_markdown(summary: Column, question: Column, answer: Column, extraction: Column) -> Column:
    """Model results of a document as Markdown; null without any."""
    parts = F.concat(
        F.when(summary != "", F.concat(_lit("### Summary\n"), summary, _lit("\n\n"))).otherwise(""),
        F.when(question.isNotNull(), F.concat(_lit("### Q&A\n- Q: "), question, _lit("\n- A: "), F.coalesce(answer, _lit("")), _lit("\n\n"))).otherwise(""),
        F.when(extraction.isNotNull(), F.concat(_lit("### JSON Extraction\n```\n"), extraction, _lit("\n```\n\n"))).otherwise(""))
    return F.when((F.coalesce(summary, _lit("")) != "") | question.isNotNull() | extraction.isNotNull(), F.concat(_lit("## LLM Results\n"), parts))


def model_section_html(summary: Column, question: Column, answer: Column, extraction: Column) -> Column:
    """Model results of a document as an HTML section; null without any. The markup is fixed."""
    safe = t.escape_html
    parts = F.concat_ws(
        "\n",
        F.when(summary != "", F.concat(_lit('<div class="llm-summary">\n<h3>Summary</h3>\n<p>'), safe(summary), _lit("</p>\n</div>"))),
        F.when(question.isNotNull(), F.concat(_lit('<div class="llm-qa">\n<h3>Q&A</h3>\n<p><strong>Q:</strong> '), safe(question), _lit("</p>\n<p><strong>A:</strong> "),
                                              safe(F.coalesce(answer, _lit(""))), _lit("</p>\n</div>"))),
        F.when(extraction.isNotNull(), F.concat(_lit('<div class="llm-json">\n<h3>JSON Extraction</h3>\n<pre><code>\n'), safe(extraction), _lit("\n</code></pre>\n</div>"))))
    return F.when(parts != "", F.concat(_lit('<section class="llm-results">\n<h2>LLM Results</h2>\n'), parts, _lit("\n</section>")))


def _joined_pieces(pieces: DataFrame, sep: str, name: str) -> DataFrame:
    """Pieces (doc_id, page_num, section, pos, piece) of a document in order, joined in two steps."""
    order = ["page_num", "section", "pos"]
    return ordered_concat(pieces, ["doc_id"], order, "piece", sep, name, bucket=F.struct("page_num", "section", tiles(F.col("pos"), CHUNK)))


def render_markdown(docs: DataFrame, pages: DataFrame, blocks: DataFrame, tables: DataFrame, show_confidence: bool = False,
                    show_metadata: bool = False) -> DataFrame:
    """(doc_id, md). docs: doc_id, filename (and model_md, metadata_md where used). pages: doc_id, page_num. blocks: doc_id,
    page_num, pos, text, block_type, confidence. tables: doc_id, page_num, table_idx, markdown."""
    zero = F.lit(0).cast("bigint")
    put = lambda df, page, section, pos, text: df.select("doc_id", page.alias("page_num"), F.lit(section).alias("section"), pos.alias("pos"), text.alias("piece"))
    first = F.lit(-1).cast("bigint")
    out = put(docs, first, 0, zero, F.concat(_lit("# "), F.element_at(F.split("filename", "/"), -1), _lit("\n")))
    n_pages = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"), F.max("page_num").alias("_last"))
    if "model_md" in docs.columns:
        out = out.unionByName(put(docs, first, 1, zero, F.regexp_replace("model_md", "\n$", "")))
    if show_metadata:
        info = F.concat(_lit("## Document Information\n- **File**: "), "filename", _lit("\n- **Pages**: "),
                        F.coalesce("_n", F.lit(0)).cast("string"), _lit("\n"))
        out = out.unionByName(put(docs.join(n_pages, "doc_id", "left"), first, 2, zero, info))
    numbered = pages.join(n_pages, "doc_id")
    page = F.col("page_num")
    head = F.concat(_lit("## Page "), page.cast("string"), _lit("\n"))
    out = out.unionByName(put(numbered.filter(F.col("_n") > 1), page, 0, zero, head))
    md = block_markdown(F.col("text"), F.col("block_type"), F.col("confidence"), show_confidence)
    out = out.unionByName(put(blocks, page, 1, F.col("pos"), F.concat(md, _lit("\n"))))
    out = out.unionByName(put(tables.filter("markdown <> ''"), page, 2, F.col("table_idx"), F.concat("markdown", _lit("\n"))))
    out = out.unionByName(put(numbered.filter(page < F.col("_last")), page, 3, zero, _lit("---\n")))
    return _joined_pieces(out, "\n", "md")


def block_html(text: Column, block_type: Column, confidence: Column, metadata: bool = False) -> Column:
    body = t.escape_html(text)
    cls = F.concat(_lit("text-block "), block_type, F.when(confidence < 0.8, " confidence-low").otherwise(""))
    inner = (
        F.when(block_type == "title", F.concat(_lit("<h3>"), body, _lit("</h3>")))
        .when(block_type == "section_heading", F.concat(_lit("<h4>"), body, _lit("</h4>")))
        .otherwise(F.concat(_lit("<p>"), F.replace(body, _lit("\n"), _lit("<br>")), _lit("</p>"))))
    extra = F.concat(_lit('<div class="metadata">Confidence: '), F.format_string("%.2f", confidence), _lit("</div>")) if metadata else _lit("")
    return F.concat(_lit('<div class="'), cls, _lit('">'), inner, extra, _lit("</div>"))


def cells_html(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Exporter table: th/td per cell in row order; a low-confidence text is wrapped."""
    text = t.escape_html(F.coalesce("txt", _lit("")))
    text = F.when(F.col("low_confidence"), F.concat(_lit('<span class="low-confidence" title="low confidence">'), text, _lit("</span>"))).otherwise(text)
    tag = F.when(F.col("is_header"), "th").otherwise("td")
    rows = cells.withColumn("_c", F.concat(_lit("<"), tag, _lit(">"), text, _lit("</"), tag, _lit(">")))
    lines = ordered_concat(rows, [*keys, "row"], ["col"], "_c", "", "_r", tiles(F.col("col"), CHUNK))
    lines = lines.withColumn("_r", F.concat(_lit("<tr>"), "_r", _lit("</tr>")))
    body = ordered_concat(lines, keys, ["row"], "_r", "", "_t", tiles(F.col("row"), CHUNK))
    return body.select(*keys, F.concat(_lit("<table>"), "_t", _lit("</table>")).alias("html"))


def render_html(docs: DataFrame, pages: DataFrame, blocks: DataFrame, tables: DataFrame, css: str = "") -> DataFrame:
    """(doc_id, html). As render_markdown, with tables: doc_id, page_num, table_idx, html, and model_html of docs where used."""
    zero = F.lit(0).cast("bigint")
    put = lambda df, page, section, pos, text: df.select("doc_id", page.alias("page_num"), F.lit(section).alias("section"), pos.alias("pos"), text.alias("piece"))
    page, first, last = F.col("page_num"), F.lit(-1).cast("bigint"), F.lit(2**62)
    n_pages = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n"))
    name = F.element_at(F.split("filename", "/"), -1)
    style = f"<style>\n{css}\n</style>\n" if css else ""
    head = F.concat(
        _lit('<!DOCTYPE html>\n<html lang="ja">\n<head>\n<meta charset="UTF-8">\n'
             '<meta name="viewport" content="width=device-width, initial-scale=1.0">\n<title>'),
        F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""), _lit(f'</title>\n{style}</head>\n<body>\n<div class="document-info">\n<h1>'), name,
        _lit("</h1>\n<p>Pages: "), F.coalesce("_n", F.lit(0)).cast("string"), _lit("</p>\n</div>"))
    out = put(docs.join(n_pages, "doc_id", "left"), first, 0, zero, head)
    if "model_html" in docs.columns:
        out = out.unionByName(put(docs, first, 1, zero, F.col("model_html")))
    p = page.cast("string")
    out = out.unionByName(put(pages, page, 0, zero, F.concat(_lit('<div class="page" id="page-'), p, _lit('">\n<h2>Page '), p, _lit("</h2>"))))
    out = out.unionByName(put(blocks, page, 1, F.col("pos"), block_html(F.col("text"), F.col("block_type"), F.col("confidence"))))
    out = out.unionByName(put(tables, page, 2, F.col("table_idx"), F.col("html")))
    out = out.unionByName(put(pages, page, 3, zero, _lit("</div>")))
    out = out.unionByName(put(docs, last, 0, zero, _lit("</body>\n</html>")))
    return _joined_pieces(out, "\n", "html")


# ---- page engine ----------------------------------------------------------------------------------------------

def _breaks(c: Column, drop: bool, mark: str) -> Column:
    return F.replace(c, _lit("\n"), _lit("" if drop else mark))


def paragraph_markdown(text: Column, role: Column, drop_breaks: bool = False) -> Column:
    body = _breaks(t.escape_md(text), drop_breaks, "<br>")
    return F.concat(F.when(role == "section_headings", "# ").otherwise(""), body, _lit("\n"))


def _span_grid(cells: DataFrame, tables: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Dense 1-based grid where only the top-left slot of a cell holds its text. `tables` has n_row and n_col."""
    one = F.lit(1).cast("bigint")
    full = tables.select(*keys, "n_row", "n_col").withColumn("r", F.explode(F.sequence(one, F.col("n_row").cast("bigint")))).withColumn(
        "c", F.explode(F.sequence(one, F.col("n_col").cast("bigint"))))
    here = cells.select(*keys, F.col("row").alias("r"), F.col("col").alias("c"), text.alias("_x"))
    return full.join(here, [*keys, "r", "c"], "left").withColumn("_x", F.coalesce("_x", _lit("")))


def page_tables(cells: DataFrame, tables: DataFrame, keys: list[str], style: str, drop_breaks: bool = False) -> DataFrame:
    """A text per table, as `md`, `csv` or `html`."""
    if style == "html":
        text = _breaks(t.escape_html(F.coalesce("txt", _lit(""))), drop_breaks, "<br>")
        span = lambda c: F.col(c).cast("string")
        td = F.concat(_lit('<td rowspan="'), span("row_span"), _lit('" colspan="'), span("col_span"), _lit('">'), text, _lit("</td>"))
        rows = ordered_concat(cells.withColumn("_x", td), [*keys, "row"], ["col"], "_x", "", "_r", tiles(F.col("col"), CHUNK))
        rows = rows.withColumn("_r", F.concat(_lit("<tr>"), "_r", _lit("</tr>")))
        body = ordered_concat(rows, keys, ["row"], "_r", "", "_t", tiles(F.col("row"), CHUNK))
        return body.select(*keys, F.concat(_lit('<table border="1" style="border-collapse: collapse">'), "_t", _lit("</table>")).alias("out"))
    text = F.coalesce("txt", _lit(""))
    if style == "md":
        text, sep = _breaks(t.escape_md(text), drop_breaks, "<br>"), "|"
    else:
        text, sep = csv_field(_breaks(text, drop_breaks, "\n")), ","
    grid = _span_grid(cells, tables, keys, text)
    rows = ordered_concat(grid, [*keys, "r", "n_col"], ["c"], "_x", sep, "_r", tiles(F.col("c"), CHUNK))
    if style == "md":
        rule = F.concat(_lit("|"), F.array_join(F.array_repeat(_lit("-"), F.col("n_col").cast("int")), "|"), _lit("|\n"))
        rows = rows.withColumn("_r", F.concat(_lit("|"), "_r", _lit("|\n"), F.when(F.col("r") == 1, rule).otherwise("")))
        return ordered_concat(rows, keys, ["r"], "_r", "", "out", tiles(F.col("r"), CHUNK))
    return ordered_concat(rows, keys, ["r"], "_r", "\r\n", "out", tiles(F.col("r"), CHUNK))


def csv_field(c: Column) -> Column:
    """Quoted only where the text holds a comma, a quote or a line break."""
    quoted = F.concat(_lit('"'), F.replace(c, _lit('"'), _lit('""')), _lit('"'))
    return F.when(c.rlike('[,"\r\n]'), quoted).otherwise(c)


def _page_join(paragraphs: DataFrame, tables: DataFrame, table_text: DataFrame, piece: Column, sep: str, name: str,
               wrap=lambda c: c, figures: DataFrame | None = None, link: Column | None = None, inside: DataFrame | None = None) -> DataFrame:
    """Pieces of a page in order. figures: page, idx, order; `link` is their piece, if any. inside: page, figure, order, text, role of the
    paragraphs in figures, which follow their figure's link; `piece` is made of text and role."""
    keys, first = ["page"], F.lit(0).cast("bigint").alias("_sub")
    rows = paragraphs.select(*keys, "order", first, piece.alias("_x"))
    made = tables.join(table_text, ["page", "idx"]).select(*keys, "order", first, wrap(F.col("out")).alias("_x"))
    rows = rows.unionByName(made)
    if figures is not None and link is not None:
        rows = rows.unionByName(figures.select(*keys, "order", first, link.alias("_x")))
    if figures is not None and inside is not None:
        own = inside.select(*keys, "figure", (F.col("order") + 1).cast("bigint").alias("_sub"), piece.alias("_x"))
        rows = rows.unionByName(own.join(figures.select(*keys, F.col("idx").alias("figure"), "order"), [*keys, "figure"]).drop("figure"))
    return ordered_concat(rows, keys, ["order", "_sub"], "_x", sep, name, tiles(F.col("order"), CHUNK))


def figure_link(width: str, folder: str = "figures") -> Column:
    """Image element of a figure whose file is named after its page and number."""
    name = F.concat(F.col("page").cast("string"), _lit("_figure_"), F.col("idx").cast("string"), _lit(".png"))
    return F.concat(_lit(f'<img src="{folder}/'), name, _lit(f'" width="{width}"><br>'))


def page_markdown(paragraphs: DataFrame, tables: DataFrame, cells: DataFrame, drop_breaks: bool = False, figures: DataFrame | None = None,
                  figure_paragraphs: DataFrame | None = None, width: int = 200, folder: str = "figures") -> DataFrame:
    """(page, md): elements in order. paragraphs: page, order, text, role. tables: page, idx, order, n_row, n_col.

    figures: page, idx, order. figure_paragraphs: page, figure, order, text, role; given, they follow their figure.
    """
    made = page_tables(cells, tables, ["page", "idx"], "md", drop_breaks)
    return _page_join(paragraphs, tables, made, paragraph_markdown(F.col("text"), F.col("role"), drop_breaks), "\n", "md",
                      figures=figures, link=figure_link(f"{width}px", folder), inside=figure_paragraphs)


def page_html(paragraphs: DataFrame, tables: DataFrame, cells: DataFrame, drop_breaks: bool = False, figures: DataFrame | None = None,
              figure_paragraphs: DataFrame | None = None, width: int = 200, folder: str = "figures") -> DataFrame:
    made = page_tables(cells, tables, ["page", "idx"], "html", drop_breaks)
    body = _breaks(t.escape_html(F.col("text")), drop_breaks, "<br>")
    body = F.when(F.col("role") == "section_headings", F.concat(_lit("<h1>"), body, _lit("</h1>"))).otherwise(body)
    return _page_join(paragraphs, tables, made, F.concat(_lit("<p>"), body, _lit("</p>")), "", "html",
                      figures=figures, link=figure_link(str(width), folder), inside=figure_paragraphs)


def page_csv(paragraphs: DataFrame, tables: DataFrame, cells: DataFrame, drop_breaks: bool = False, figures: DataFrame | None = None,
             figure_paragraphs: DataFrame | None = None) -> DataFrame:
    """(page, csv): paragraphs as one field, tables as rows, a row with one empty field after each element. Figures have no row of
    their own, their paragraphs have."""
    made = page_tables(cells, tables, ["page", "idx"], "csv", drop_breaks)
    end = lambda c: F.concat(c, _lit('\r\n""\r\n'))
    return _page_join(paragraphs, tables, made, end(csv_field(_breaks(F.col("text"), drop_breaks, "\n"))), "", "csv", end,
                      figures=figures, inside=figure_paragraphs)


def _json_of(*columns: Column | str) -> Column:
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def page_json(elements: DataFrame, drop_breaks: bool = False) -> DataFrame:
    """(page, order, json): one object per element with its keys in alphabetical order."""
    text = _breaks(F.col("text"), drop_breaks, "\n")
    return elements.select("page", "order", _json_of(F.array(*g.SIDES).alias("box"), text.alias("contents"), "direction", "order", "role").alias("json"))


def page_document(pages: DataFrame, paragraphs: DataFrame, tables: DataFrame, cells: DataFrame, words: DataFrame, figures: DataFrame,
                  figure_paragraphs: DataFrame, drop_breaks: bool = False) -> DataFrame:
    """(page, json): a whole page as one object, keys in alphabetical order: figures with their paragraphs, paragraphs, tables with
    their cells, words. With `drop_breaks` line breaks go from paragraphs and cells.

    paragraphs: page, order, box, text, direction, role. figures: page, idx, order, box, direction. figure_paragraphs: as
    paragraphs, with figure. tables: page, idx, order, box, n_row, n_col. cells: page, idx, box, row, col, row_span, col_span, txt.
    words: page, n, points, content, direction, rec_score, det_score.
    """
    box = F.array(*g.SIDES).alias("box")
    text = _breaks(F.col("text"), drop_breaks, "\n").alias("contents")
    put = lambda df, keys, order, json, name: ordered_concat(df.withColumn("_j", json), keys, order, "_j", ",", name, tiles(F.col(order[0]), CHUNK))
    listed = lambda name: F.concat(_lit("["), F.coalesce(name, _lit("")), _lit("]"))
    paragraph = _json_of(box, text, "direction", "order", "role")
    inside = put(figure_paragraphs, ["page", "figure"], ["order"], paragraph, "_p").withColumnRenamed("figure", "idx")
    whole = figures.join(inside, ["page", "idx"], "left")
    head = F.to_json(F.struct(box, "direction", "order"), {"ignoreNullFields": "false"})
    figure = F.concat(F.substring(head, 1, F.length(head) - 1), _lit(',"paragraphs":'), listed(F.col("_p")), _lit("}"))
    cell = _json_of(box, "col", "col_span", _breaks(F.col("txt"), drop_breaks, "\n").alias("contents"), "row", "row_span")
    full = tables.join(put(cells, ["page", "idx"], ["row", "col"], cell, "_c"), ["page", "idx"], "left")
    table = F.concat(_lit('{"box":'), F.to_json(box), _lit(',"cells":'), listed(F.col("_c")), _lit(","), F.substring(_json_of("n_col", "n_row", "order"), 2, 1 << 30))
    word = _json_of("content", "det_score", "direction", "points", "rec_score")
    out = pages.select("page").distinct()
    for df, order, json, name in ((whole, ["order"], figure, "figures"), (paragraphs, ["order"], paragraph, "paragraphs"),
                                  (full, ["order"], table, "tables"), (words, ["n"], word, "words")):
        out = out.join(put(df, ["page"], order, json, name), "page", "left")
    parts = [F.concat(_lit(f'"{n}":'), listed(F.col(n))) for n in ("figures", "paragraphs", "tables", "words")]
    return out.select("page", F.concat(_lit("{"), F.concat_ws(",", *parts), _lit("}")).alias("json"))


# --- fixed values: font sizes of a text layer
FONT_SIZES = {"title": 16, "section_heading": 14, "caption": 9, "footnote": 8, "text": 11, "paragraph": 11}
FONT_DEFAULT, FONT_MIN, LEADING = 11, 6, 1.1


def font_size(text: Column, block_type: Column, w: Column, h: Column) -> Column:
    base = F.lit(FONT_DEFAULT).cast("double")
    for name, size in FONT_SIZES.items():
        base = F.when(block_type == name, F.lit(float(size))).otherwise(base)
    lines = F.greatest(F.lit(1.0), h / (base * 1.2))
    needed = F.greatest(F.lit(1), F.length(text)) / F.greatest(F.lit(1.0), w / (base * 0.6))
    return F.when((w <= 0) | (h <= 0) | (needed <= lines), base).otherwise(F.greatest(F.lit(float(FONT_MIN)), base * lines / needed))


def text_layer(pages: DataFrame, blocks: DataFrame, cells: DataFrame, keys: list[str]) -> DataFrame:
    """Placed text lines (kind, idx, line, x, y, size, text), origin at the bottom left."""
    rows = blocks.join(pages.select(*keys, "height"), keys)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    rows = rows.withColumn("size", font_size(F.coalesce("text", _lit("")), F.col("block_type"), w, h)).filter(F.col("text") != "")
    rows = rows.withColumn("_py", (F.col("height") - F.col("y2")).cast("double")).withColumn("_h", h)
    rows = rows.select("*", F.posexplode(F.split("text", "\n")).alias("line", "_t"))
    y = F.col("_py") + F.col("_h") - F.col("size") * LEADING * (F.col("line") + 1)
    text = rows.select(*keys, _lit("block").alias("kind"), F.col("pos").alias("idx"), "line", F.col("x1").cast("double").alias("x"),
                       y.alias("y"), "size", F.col("_t").alias("text")).filter(F.col("y") >= 0)
    c = cells.join(pages.select(*keys, "height"), keys)
    size = F.greatest(F.lit(8.0), F.least(F.lit(12.0), h * 0.4))
    cy = F.col("height") - F.col("y2") + (h - size * LEADING) / 2.0
    cell = c.select(*keys, _lit("cell").alias("kind"), "idx", F.lit(0).alias("line"), F.col("x1").cast("double").alias("x"),
                    cy.alias("y"), size.alias("size"), F.col("txt").alias("text"))
    return text.unionByName(cell)


def silver_tables(pred_tables: DataFrame, existing: DataFrame, overwrite: bool = False, doc: str = "doc_id") -> DataFrame:
    """Predicted table HTML as ground truth for documents without one: a row per table, `is_first` marks the copy."""
    rows = pred_tables.filter(t.strip(F.col("html")) != "")
    if not overwrite:
        rows = rows.join(existing.select(doc).distinct(), doc, "left_anti")
    first = rows.groupBy(doc).agg(F.min("table_idx").alias("_first"))
    return rows.join(first, doc).select(doc, "table_idx", "html", (F.col("table_idx") == F.col("_first")).cast("int").alias("is_first"))
