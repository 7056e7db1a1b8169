"""Table structure: cells from lines, spans, grids and table texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliospark.functions import geometry as g
from foliospark.operators import boxes, spatial
from foliospark.operators.groups import join_placed, lacking
from foliospark.operators.scan import larger_than, ordered_concat, ranked, tiles
from foliospark.operators.windows import interval_span_count, row_boundaries
from foliospark.session import stored

CELL_BUCKET = 256
#: Lines or spans, and cells, of a table up to which its parts meet by table alone: lines are placed once, and cells made where they lie.
TABLE_LINES, TABLE_CELLS = 500, 100_000


def grid_cells(rows: DataFrame, cols: DataFrame, keys: list[str]) -> DataFrame:
    """1-based cells where a row line (by y1) and a column line (by x1) overlap; the cell box is the overlap."""
    r = ranked(rows.select(*keys, "idx", *g.SIDES), keys, ["y1", "idx"], tiles(F.col("y1"), 1024), "row")
    c = ranked(cols.select(*keys, "idx", *g.SIDES), keys, ["x1", "idx"], tiles(F.col("x1"), 1024), "col")
    if larger_than(rows, keys, TABLE_LINES) or larger_than(cols, keys, TABLE_LINES):
        pairs = spatial.overlap_pairs(r, c, keys)
    else:
        pairs = join_placed(r, spatial.listed(c, keys, "_cols"), keys).withColumn("_o", F.explode("_cols"))
        pairs = pairs.select(*keys, "row", *g.SIDES, *(F.col("_o." + s).alias("o_" + s) for s in ("col", *g.SIDES)))
    a, b = g.truncated(g.box()), g.truncated(g.box("o_"))
    box = g.Box(F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1), F.least(a.x2, b.x2), F.least(a.y2, b.y2))
    cells = pairs.select(*keys, "row", F.col("o_col").alias("col"), *(v.alias(s) for v, s in zip(box, g.SIDES)))
    return cells.filter(F.col("x2") > F.col("x1")).filter(F.col("y2") > F.col("y1"))


def merge_spans(cells: DataFrame, spans: DataFrame, keys: list[str], thr: float = 0.8) -> DataFrame:
    """Cells inside a span box become one cell; a span without cells vanishes."""
    spans = spans.select(*keys, "idx", *g.SIDES)
    small = not larger_than(spans, keys, TABLE_LINES)
    if small:
        near = join_placed(cells, spatial.listed(spans, keys, "_spans"), keys, "left").withColumn("_hits", spatial.containing("_spans", thr))
        hit = F.coalesce(F.size("_hits") > 0, F.lit(False))
        # cells that share a place go together; as in a join, one without a place has no like
        gone = F.max(hit).over(Window.partitionBy(*keys, "row", "col")) & ~lacking([*keys, "row", "col"])
        near = stored(near.withColumn("_gone", gone), "near")  # read for the free cells and for the merged ones
        free = near.filter(~F.col("_gone"))
        inside = near.withColumn("_o", F.explode("_hits"))
        inside = inside.select(*keys, "row", "col", *(F.col("_o." + c).alias("o_" + c) for c in ("idx", *g.SIDES)))
    else:
        inside = spatial.contained_pairs(cells, spans, keys, thr)
        free = cells.join(inside.select(*keys, "row", "col").distinct(), [*keys, "row", "col"], "left_anti")
    one = F.lit(1).cast("bigint")
    free = free.select(*keys, "row", "col", one.alias("row_span"), one.alias("col_span"), *(F.col(s).cast("int").alias(s) for s in g.SIDES))
    merged = inside.groupBy(*keys, "o_idx").agg(
        F.min("row").alias("row"), F.min("col").alias("col"),
        (F.max("row") - F.min("row") + 1).cast("bigint").alias("row_span"),
        (F.max("col") - F.min("col") + 1).cast("bigint").alias("col_span"),
        *(F.first("o_" + s).cast("int").alias(s) for s in g.SIDES),
    )
    if small:
        # placed otherwise than the free cells: a union of parts placed alike counts as placed, though adaptive execution merges their partitions apart
        merged = merged.repartition(F.xxhash64(*keys, "o_idx"))
    return free.unionByName(merged.drop("o_idx"))


def boundary_cells(rows: DataFrame, cols: DataFrame, headers: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """0-based cells between neighbouring line edges, with header kind, spans and a placeholder text."""
    r, c = row_boundaries(rows, keys, "y"), row_boundaries(cols, keys, "x")
    r2 = r.select(*keys, F.col("pos").alias("row"), F.col("lo").alias("y1"), F.col("hi").alias("y2"))
    c2 = c.select(*keys, F.col("pos").alias("col"), F.col("lo").alias("x1"), F.col("hi").alias("x2"))
    small = not any(larger_than(lines, keys, TABLE_LINES) for lines in (rows, cols, headers, spans))
    if small:
        out = _spanned(_headed(r2.join(c2, keys), headers, keys), spans, r, c, keys)
        return out.withColumn("txt", _cell_label())
    cells = boxes.header_overlap(r2.join(c2, keys), headers, keys, ["row", "col"])
    sized = interval_span_count(spans.select(*keys, "idx", *g.SIDES), r, keys, "y").withColumnRenamed("n_cover", "rs")
    sized = interval_span_count(sized, c, keys, "x").withColumnRenamed("n_cover", "cs")
    pairs = spatial.overlap_pairs(cells.select(*keys, "row", "col", *g.SIDES), sized, keys)
    over = pairs.filter(g.box_overlap_first(g.box(), g.box("o_")) > 0.5)
    most = over.groupBy(*keys, "row", "col").agg(F.max("o_rs").alias("row_span"), F.max("o_cs").alias("col_span"))
    out = cells.join(most, [*keys, "row", "col"], "left").na.fill(1, ["row_span", "col_span"])
    return out.withColumn("txt", _cell_label())


def _cell_label() -> Column:
    return F.concat(F.lit("Cell("), F.col("row").cast("string"), F.lit(","), F.col("col").cast("string"), F.lit(")"))


def _headed(cells: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """As `boxes.header_overlap`, for few headers a table: cells stay where they lie."""
    near = join_placed(cells, spatial.listed(headers.select(*keys, "idx", "kind", *g.SIDES), keys, "_heads"), keys, "left")
    first = F.array_min(F.transform(F.filter("_heads", lambda e: e["idx"].isNotNull() & _covers_half(e)), lambda e: F.struct(e["idx"].alias("idx"), e["kind"].alias("kind"))))
    return near.withColumn("header_type", first["kind"]).withColumn("is_header", F.col("header_type").isNotNull()).drop("_heads")


def _covers_half(e: Column) -> Column:
    """Whether a listed box covers more than half of the row's box."""
    o = g.Box(*(e[s] for s in g.SIDES))
    return spatial.meets(g.box(), o) & (g.box_overlap_first(g.box(), o) > 0.5)


def _spanned(cells: DataFrame, spans: DataFrame, r: DataFrame, c: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with the spans that cover more than half of them, for few spans and lines a table: all meet by table alone."""
    rows, zero, one = spans.select(*keys, "idx", *g.SIDES), F.lit(0), F.lit(1)
    for lines, axis, name in ((r, "y", "rs"), (c, "x", "cs")):
        rows = join_placed(rows, spatial.listed(lines.select(*keys, "lo", "hi"), keys, "_lines"), keys, "left")
        own = g.Box(F.col(f"{axis}1"), zero, F.col(f"{axis}2"), one)
        meets = lambda e: spatial.meets(own, g.Box(e["lo"], zero, e["hi"], one))  # noqa: E731, B023
        # spans of one idx count together; as in a join, one without an idx has no like
        n = F.sum(F.coalesce(F.size(F.filter("_lines", meets)), F.lit(0))).over(Window.partitionBy(*keys, "idx"))
        rows = rows.withColumn(name, F.when(F.col("idx").isNull() | (n <= 0), F.lit(1)).otherwise(n).cast("bigint")).drop("_lines")
    near = join_placed(cells, spatial.listed(rows, keys, "_spans"), keys, "left")
    near = near.withColumn("_spans", F.filter("_spans", _covers_half))
    most = lambda name: F.coalesce(F.array_max(F.transform("_spans", lambda e: e[name])), F.lit(1).cast("bigint"))
    return near.select(*keys, "row", "col", "y1", "y2", "x1", "x2", "header_type", "is_header", most("rs").alias("row_span"), most("cs").alias("col_span"))


def split_words_at_cells(
    words: DataFrame, tables: DataFrame, rows: DataFrame, cols: DataFrame, cells: DataFrame, page: str, table: str,
    word_id: str = "n",
) -> DataFrame:
    """Table words cut at the cell borders of their row (or column, when vertical); other words stay whole.

    `words` has a `quad`; line idx is the 1-based position in its table. Pieces under 15 px are dropped.
    """
    box = g.quad_to_box(F.col("quad"))
    placed = words.select(page, word_id, "quad", "score", *(v.alias(s) for v, s in zip(box, g.SIDES)))
    boxes_ = tables.select(page, table, *g.SIDES)
    small = not larger_than(boxes_, [page], TABLE_LINES)
    if small:
        found = join_placed(placed, spatial.listed(boxes_, [page], "_tables"), [page], "left").withColumn("_hits", spatial.containing("_tables", 0.5)).drop("_tables")
        hit = F.coalesce(F.size("_hits") > 0, F.lit(False))
        # words that share an id go together; as in a join, one without an id or a page has no like
        found = found.withColumn("_in", F.max(hit).over(Window.partitionBy(page, word_id)) & ~lacking([page, word_id]))
        found = stored(found, "words")  # read for both directions and for the words outside
        hits = found.withColumn("_o", F.explode("_hits")).withColumn("o_" + table, F.col("_o." + table))
    else:
        hits = spatial.contained_pairs(placed, boxes_, [page], 0.5)
    hits = hits.select(page, F.col("o_" + table).alias(table), word_id, "quad", "score", *g.SIDES,
                       g.word_direction(F.col("quad")).alias("direction"))
    keys = [page, table]
    pieces = []
    for direction, lines, at, span in (("horizontal", rows, "row", "row_span"), ("vertical", cols, "col", "col_span")):
        mine = boxes.best_line(hits.filter(F.col("direction") == direction), lines, keys, word_id)
        near = cells.withColumn("line", F.explode(F.sequence(F.col(at), F.col(at) + F.col(span) - 1)))
        near = near.select(*keys, "line", *(F.col(s).alias("c_" + s) for s in g.SIDES))
        cut = mine.join(near, [*keys, "line"])
        b, c = g.truncated(g.box()), g.truncated(g.box("c_"))
        lo_x, lo_y = F.greatest(b.x1, c.x1), F.greatest(b.y1, c.y1)
        hi_x, hi_y = F.least(b.x2, c.x2), F.least(b.y2, c.y2)
        cut = cut.filter((hi_x > lo_x) & (hi_y > lo_y))
        q = F.col("quad")
        if direction == "horizontal":
            quad = F.array(
                F.array(F.greatest(q[0][0], lo_x), q[0][1]), F.array(F.least(q[1][0], hi_x), q[1][1]),
                F.array(F.least(q[2][0], hi_x), q[2][1]), F.array(F.greatest(q[3][0], lo_x), q[3][1]))
        else:
            quad = F.array(
                F.array(q[0][0], F.greatest(q[0][1], lo_y)), F.array(q[1][0], F.greatest(q[1][1], lo_y)),
                F.array(q[2][0], F.least(q[2][1], hi_y)), F.array(q[3][0], F.least(q[3][1], hi_y)))
        cut = cut.select(page, word_id, quad.alias("quad"), "score")
        pieces.append(cut.filter(~g.is_noise_quad(F.col("quad"))))
    if small:
        rest = found.filter(~F.col("_in")).select(page, word_id, "quad", "score")
    else:
        rest = words.select(page, word_id, "quad", "score").join(hits.select(page, word_id).distinct(), [page, word_id], "left_anti")
    return pieces[0].unionByName(pieces[1]).unionByName(rest)


def table_grid(cells: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """Dense 1-based grid; a text is repeated over its span, a later cell overwrites. `tables` has n_row, n_col."""
    def upto(a: Column, n: Column) -> Column:
        return F.explode(F.sequence(a, a + n - 1))

    sizes = tables.filter(F.col("n_row").cast("bigint") * F.col("n_col").cast("bigint") > TABLE_CELLS)
    if sizes.isEmpty() and not larger_than(cells, keys, TABLE_CELLS):
        return _grid_in_place(cells, tables, keys)
    slots = cells.withColumn("_r", upto(F.col("row"), F.col("row_span"))).withColumn("_c", upto(F.col("col"), F.col("col_span")))
    filled = slots.groupBy(*keys, F.col("_r").alias("r"), F.col("_c").alias("c")).agg(
        F.max_by("txt", F.struct("row", "col")).alias("txt"))
    one = F.lit(1).cast("bigint")
    full = tables.withColumn("r", F.explode(F.sequence(one, F.col("n_row").cast("bigint")))).withColumn(
        "c", F.explode(F.sequence(one, F.col("n_col").cast("bigint"))))
    return full.select(*keys, "r", "c").join(filled, [*keys, "r", "c"], "left").withColumn("txt", F.coalesce("txt", F.lit("")))


def _grid_in_place(cells: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """The grids of tables that one task can hold: cells and sizes move once, by table, and slots are made where they lie."""
    here = ["row", "col", "row_span", "col_span"]
    sizes = tables.select(*keys, *(F.lit(1).cast("bigint").alias(c) for c in here[:2]), F.col("n_row").cast("bigint").alias("row_span"),
                          F.col("n_col").cast("bigint").alias("col_span"), F.lit(None).cast("string").alias("txt"), F.lit(True).alias("_size"))
    own = cells.select(*keys, *(F.col(c).cast("bigint").alias(c) for c in here), "txt", F.lit(False).alias("_size"))
    # as in a join, a table without a key has no cells
    both = own.filter(~lacking(keys)).unionByName(sizes).repartition(*keys)
    slots = both.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1))).withColumn(
        "c", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)))
    txt = F.max_by("txt", F.when(~F.col("_size"), F.struct("row", "col")))
    slots = slots.groupBy(*keys, "r", "c").agg(F.count_if("_size").alias("_n"), F.coalesce(txt, F.lit("")).alias("txt"))
    return slots.filter("_n > 0").withColumn("_n", F.explode(F.array_repeat(F.lit(1), F.col("_n").cast("int")))).select(*keys, "r", "c", "txt")


def table_records(grid: DataFrame, keys: list[str], header_rows: int = 1) -> DataFrame:
    """One map per data row; keys are the header texts of a column joined by `_`. A repeated name takes its last column."""
    head = F.collect_list(F.when(F.col("r") <= header_rows, F.struct("r", "txt"))).over(Window.partitionBy(*keys, "c"))
    # grids placed by table stay there; as in a join, a column without a header or a key has no records
    named = grid.filter(~lacking([*keys, "c"])).withColumn("_h", F.array_sort(head)).filter((F.col("r") > header_rows) & (F.size("_h") > 0))
    body = named.withColumn("name", F.array_join(F.transform("_h", lambda x: x["txt"]), "_")).drop("_h")
    values = body.groupBy(*keys, "r", "name").agg(F.max_by("txt", "c").alias("txt"), F.min("c").alias("c"))
    entry = F.array_sort(F.collect_list(F.struct("c", "name", "txt")))
    rows = values.groupBy(*keys, "r").agg(entry.alias("_e"))
    return rows.select(*keys, "r", F.map_from_entries(F.transform("_e", lambda e: F.struct(e["name"], e["txt"]))).alias("record"))


def _rows_joined(slots: DataFrame, keys: list[str], piece: Column, sep: str) -> DataFrame:
    rows = slots.withColumn("_p", piece)
    return ordered_concat(rows, [*keys, "r"], ["c"], "_p", sep, "line", bucket=tiles(F.col("c"), CELL_BUCKET))


def _zero_grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """All slots from 0 to the highest used row and column, with the cell that stands there."""
    size = cells.groupBy(*keys).agg(F.max("row").alias("_mr"), F.max("col").alias("_mc"))
    zero = F.lit(0).cast("bigint")
    full = size.withColumn("r", F.explode(F.sequence(zero, F.col("_mr")))).withColumn("c", F.explode(F.sequence(zero, F.col("_mc"))))
    here = cells.withColumnRenamed("row", "r").withColumnRenamed("col", "c").withColumn("_here", F.lit(1))
    return full.join(here, [*keys, "r", "c"], "left")


def _sized(cells: DataFrame, keys: list[str]) -> bool:
    """Whether all tables have up to TABLE_LINES rows and columns and TABLE_CELLS cells."""
    size = cells.groupBy(*keys).agg(F.max("row").alias("_mr"), F.max("col").alias("_mc"), F.count(F.lit(1)).alias("_n"))
    return size.filter((F.greatest("_mr", "_mc") >= TABLE_LINES) | (F.col("_n") > TABLE_CELLS)).isEmpty()


def _drawn(cells: DataFrame, keys: list[str], piece: Column, hole: str, sep: str) -> DataFrame:
    """Keys, _mc (highest column) and _lines: r, used and line of every row of 0-based cells, holes filled. Cells move once, by table."""
    zero, whole = F.lit(0).cast("bigint"), Window.partitionBy(*keys)
    at = cells.repartition(*keys).withColumn("_mr", F.max("row").over(whole)).withColumn("_mc", F.max("col").over(whole))
    # as in a join, a table without a key has no cells
    rows = at.groupBy(*keys, "_mr", "_mc", "row").agg(
        F.array_sort(F.collect_list(F.when(~lacking(keys), F.struct(F.col("col").alias("c"), piece.alias("p"))))).alias("_p"))
    slots = F.flatten(F.transform(F.sequence(zero, "_mc"), lambda c: F.when(
        F.exists("_p", lambda x: x["c"] == c), F.transform(F.filter("_p", lambda x: x["c"] == c), lambda x: x["p"])).otherwise(F.array(F.lit(hole)))))
    rows = rows.withColumn("_slots", slots).withColumn("line", F.when(F.exists("_slots", lambda x: x.isNotNull()), F.array_join("_slots", sep)))
    empty = F.array_join(F.transform(F.sequence(zero, "_mc"), lambda c: F.lit(hole)), sep)
    tables = rows.groupBy(*keys, "_mr", "_mc").agg(F.collect_list(F.struct(F.col("row").alias("r"), F.lit(True).alias("used"), "line")).alias("_l"))
    lines = F.transform(F.sequence(zero, "_mr"), lambda r: F.coalesce(
        F.get(F.filter("_l", lambda x: x["r"] == r), F.lit(0)), F.struct(r.alias("r"), F.lit(False).alias("used"), empty.alias("line"))))
    return tables.select(*keys, "_mc", F.filter(lines, lambda x: x["line"].isNotNull()).alias("_lines")).filter(
        F.col("_mc").isNotNull() & (F.size("_lines") > 0))


def table_html(cells: DataFrame, keys: list[str]) -> DataFrame:
    """0-based cells as HTML: th/td, spans, low confidence class, confidence with 2 decimals, empty td for holes."""
    def span(col: str, name: str) -> Column:
        return F.when(F.col(col) > 1, F.concat(F.lit(f' {name}="'), F.col(col).cast("string"), F.lit('"'))).otherwise("")

    tag = F.when(F.col("is_header"), "th").otherwise("td")
    cls = F.when(F.col("low_confidence"), ' class="low-confidence"').otherwise("")
    conf = F.when(F.col("confidence").isNotNull(), F.concat(F.lit(' data-confidence="'), F.format_string("%.2f", "confidence"), F.lit('"')))
    made = F.concat(F.lit("    <"), tag, span("row_span", "rowspan"), span("col_span", "colspan"), cls, F.coalesce(conf, F.lit("")),
                    F.lit(">"), "txt", F.lit("</"), tag, F.lit(">"))
    hole = "    <td></td>"
    if _sized(cells, keys):
        drawn = _drawn(cells, keys, made, hole, "\n")
        body = F.array_join(F.transform("_lines", lambda x: F.concat(F.lit("  <tr>\n"), x["line"], F.lit("\n  </tr>"))), "\n")
        return drawn.select(*keys, F.concat(F.lit("<table>\n"), body, F.lit("\n</table>")).alias("html"))
    piece = F.when(F.col("_here").isNull(), F.lit(hole)).otherwise(made)
    rows = _rows_joined(_zero_grid(cells, keys), keys, piece, "\n")
    rows = rows.withColumn("line", F.concat(F.lit("  <tr>\n"), "line", F.lit("\n  </tr>")))
    body = ordered_concat(rows, keys, ["r"], "line", "\n", "_b", bucket=tiles(F.col("r"), CELL_BUCKET))
    return body.select(*keys, F.concat(F.lit("<table>\n"), "_b", F.lit("\n</table>")).alias("html"))


def table_markdown(cells: DataFrame, keys: list[str], mark_low: bool = False) -> DataFrame:
    """0-based cells as a pipe table. `mark_low`: exporter form, which escapes pipes, marks low confidence and skips
    rows without cells."""
    text, rule = F.coalesce("txt", F.lit("")), "---" if mark_low else " --- "
    if mark_low:
        low = F.when(F.col("low_confidence"), F.concat(text, F.lit(" (low)"))).otherwise(text)
        text = F.replace(low, F.lit("|"), F.lit("\\|"))

    def below(n: Column) -> Column:
        return F.concat(F.lit("\n|"), F.array_join(F.array_repeat(F.lit(rule), n.cast("int")), "|"), F.lit("|"))

    if _sized(cells, keys):
        drawn = _drawn(cells.filter(~lacking(keys)), keys, text, "", " | ")
        lines = F.filter("_lines", lambda x: x["used"]) if mark_low else F.col("_lines")
        drawn = drawn.withColumn("_lines", lines).filter(F.size("_lines") > 0)
        line = lambda x: F.concat(F.lit("| "), x["line"], F.lit(" |"), F.when(x["r"] == 0, below(F.col("_mc") + 1)).otherwise(F.lit("")))
        return drawn.select(*keys, F.array_join(F.transform("_lines", line), "\n").alias("md"))
    grid = _zero_grid(cells, keys)
    if mark_low:
        used = cells.select(*keys, F.col("row").alias("r")).distinct()
        grid = grid.join(used, [*keys, "r"], "left_semi")
    rows = _rows_joined(grid, keys, text, " | ")
    width = cells.groupBy(*keys).agg((F.max("col") + 1).alias("_n"))
    rows = rows.join(width, keys)
    line = F.concat(F.lit("| "), "line", F.lit(" |"))
    rows = rows.withColumn("line", F.when(F.col("r") == 0, F.concat(line, below(F.col("_n")))).otherwise(line))
    return ordered_concat(rows, keys, ["r"], "line", "\n", "md", bucket=tiles(F.col("r"), CELL_BUCKET))


# --- fixed values: wording of a table as text
TABLE_HEADER, TABLE_ROW, TABLE_EMPTY = "ヘッダー: ", "行", "（表データなし）"


def table_to_text(grid: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """Header line and numbered rows; a fixed notice for a table without cells."""
    rows = _rows_joined(grid, keys, F.col("txt"), " | ")
    label = F.when(F.col("r") == 1, F.lit(TABLE_HEADER)).otherwise(F.concat(F.lit(TABLE_ROW), (F.col("r") - 1).cast("string"), F.lit(": ")))
    rows = rows.withColumn("line", F.concat(label, "line"))
    text = ordered_concat(rows, keys, ["r"], "line", "\n", "text", bucket=tiles(F.col("r"), CELL_BUCKET))
    return tables.select(*keys).join(text, keys, "left").withColumn("text", F.coalesce("text", F.lit(TABLE_EMPTY)))


def grid_html(n_rows: Column, n_cols: Column) -> Column:
    """Empty HTML grid."""
    cell = F.concat(F.array_join(F.array_repeat(F.lit("    <td></td>"), n_cols.cast("int")), "\n"), F.when(n_cols > 0, "\n").otherwise(""))
    row = F.concat(F.lit("  <tr>\n"), cell, F.lit("  </tr>"))
    rows = F.array_join(F.array_repeat(row, n_rows.cast("int")), "\n")
    return F.concat(F.lit("<table>\n"), rows, F.when(n_rows > 0, "\n").otherwise(""), F.lit("</table>"))


def place_cells(cells: DataFrame, rows: DataFrame, cols: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """Slot (1-based r, c) of every detected cell; of several in a slot the last stays, and a column header takes the first row."""
    def located(df: DataFrame, lines: DataFrame, axis: str, name: str) -> DataFrame:
        order = ranked(lines.select(*keys, "idx", *g.SIDES), keys, [f"{axis}1", "idx"], tiles(F.col(f"{axis}1"), 1024), "_k")
        mid = (F.col(f"{axis}1") + F.col(f"{axis}2")) / 2
        bands = order.select(*keys, F.col(f"{axis}1").alias("lo"), F.col(f"{axis}2").alias("hi"), "_k")
        hits = spatial.points_in_bands(df, bands, keys, mid, "lo", "hi", 256)
        return hits.groupBy(*keys, "idx").agg(F.min("o__k").alias(name))

    r, c = located(cells, rows, "y", "r"), located(cells, cols, "x", "c")
    body = r.join(c, [*keys, "idx"])
    slots = body.select(*keys, "r", "c", F.struct(F.lit(0).alias("h"), F.col("idx").alias("i")).alias("_v"))
    heads = located(headers, cols, "x", "c").select(*keys, F.lit(1).cast("bigint").alias("r"), "c",
                                                    F.struct(F.lit(1).alias("h"), F.col("idx").alias("i")).alias("_v"))
    last = slots.unionByName(heads).groupBy(*keys, "r", "c").agg(F.max("_v").alias("_v"))
    return last.select(*keys, "r", "c", F.col("_v.i").alias("idx"), F.col("_v.h").alias("from_header"))
