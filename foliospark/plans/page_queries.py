"""Queries over page joins and sequences: containment, nearest lines, islands, scales."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import geometry as g
from foliospark.operators import boxes as ob, prep, windows as w
from foliospark.plans.fixtures import Tables, sql
from foliospark.plans.metric_queries import KINDS, SIDECAR_SQL, sidecars
from foliospark.plans.registry import query

IN_ELEMENTS = """
    SELECT w.page, w.n, e.idx FROM words w JOIN elements e ON w.page = e.page AND least(w.x2, e.x2) > greatest(w.x1, e.x1)
      AND least(w.y2, e.y2) > greatest(w.y1, e.y1)
      AND (least(w.x2, e.x2) - greatest(w.x1, e.x1)) * (least(w.y2, e.y2) - greatest(w.y1, e.y1)) / ((w.x2 - w.x1) * (w.y2 - w.y1)) > 0.5"""


@query("words_in_elements", sql(IN_ELEMENTS, "words", "elements"))
def words_in_elements(tb: Tables):
    pairs = ob.words_in_elements(tb.words, tb.elements, ["page"])
    return pairs.select("page", "n", F.col("o_idx").alias("idx"))


@query("unassigned_words", sql("SELECT page, n, content FROM words WHERE (page, n) NOT IN (SELECT page, n FROM q)", "words", "elements",
                               q=IN_ELEMENTS))
def unassigned_words(tb: Tables):
    pairs = ob.words_in_elements(tb.words, tb.elements, ["page"])
    return ob.unassigned_words(tb.words, [pairs], ["page"]).select("page", "n", "content")


def overlap_sql(a: str, b: str, thr: float, base: str = "b") -> str:
    inter = (f"(least(a.x2, b.x2) - greatest(a.x1, b.x1)) * (least(a.y2, b.y2) - greatest(a.y1, b.y1))")
    return (f"least(a.x2, b.x2) > greatest(a.x1, b.x1) AND least(a.y2, b.y2) > greatest(a.y1, b.y1) "
            f"AND {inter} / (({base}.x2 - {base}.x1) * ({base}.y2 - {base}.y1)) > {thr}")


@query("paragraphs_in_figures", sql(f"""
    SELECT b.page, b.idx, CASE WHEN EXISTS (SELECT 1 FROM figures a WHERE a.page = b.page AND {overlap_sql('a', 'b', 0.7)}) THEN 1 ELSE 0 END AS inside
    FROM elements b""", "elements", "figures"))
def paragraphs_in_figures(tb: Tables):
    inside, left = ob.paragraphs_in_figures(tb.elements, tb.figures, ["page"])
    return inside.select("page", "idx", F.lit(1).alias("inside")).unionByName(left.select("page", "idx", F.lit(0).alias("inside")))


@query("drop_contained_same_class", sql(f"""
    SELECT page, label, idx FROM boxes x WHERE NOT EXISTS (
      SELECT 1 FROM (SELECT a.page, a.label, b.idx AS bi, a.idx AS ai, (a.x2 - a.x1) * (a.y2 - a.y1) AS sa, (b.x2 - b.x1) * (b.y2 - b.y1) AS sb,
                            {overlap_sql('a', 'b', 0.8, 'a')} AS mutual
                     FROM boxes a JOIN boxes b ON a.page = b.page AND a.label = b.label AND a.idx <> b.idx AND {overlap_sql('a', 'b', 0.8)}) p
      WHERE p.page = x.page AND p.label = x.label AND p.bi = x.idx AND (NOT mutual OR sb < sa OR (sb = sa AND bi < ai)))""", "boxes"))
def drop_contained_same_class(tb: Tables):
    return ob.drop_contained_same_class(tb.boxes, ["page", "label"]).select("page", "label", "idx")


@query("drop_contained_across", sql(f"""
    SELECT page, idx FROM boxes b WHERE label <> 'A' AND NOT EXISTS (
      SELECT 1 FROM boxes a WHERE a.page = b.page AND a.label = 'A' AND {overlap_sql('a', 'b', 0.8)})""", "boxes"))
def drop_contained_across(tb: Tables):
    return ob.drop_contained_across(tb.boxes.filter("label <> 'A'"), tb.boxes.filter("label = 'A'"), ["page"]).select("page", "idx")


@query("label_blocks", sql("""
    SELECT p.page, p.idx, coalesce(arg_min(b.label, b.idx), 'text') AS label FROM preds p
    LEFT JOIN boxes b ON b.page = p.page AND (p.x1 + p.x2) / 2 BETWEEN b.x1 AND b.x2 AND (p.y1 + p.y2) / 2 BETWEEN b.y1 AND b.y2
    GROUP BY p.page, p.idx""", "preds", "boxes"))
def label_blocks(tb: Tables):
    layout = tb.boxes.select("page", "idx", "label", *g.SIDES)
    b = g.box()
    out = ob.label_blocks(tb.preds.drop("label"), layout, ["page"], "idx", g.center_x(b), g.center_y(b))
    return out.select("page", "idx", "label")


TABLE_BOX = "SELECT tbl, 0 AS x1, 0 AS y1, 400 AS x2, max(y2) AS y2 FROM table_lines WHERE kind = 'row' GROUP BY tbl"


def table_boxes(tb: Tables):
    return tb.table_lines.filter("kind = 'row'").groupBy("tbl").agg(
        F.lit(0).cast("bigint").alias("x1"), F.lit(0).cast("bigint").alias("y1"), F.lit(400).cast("bigint").alias("x2"), F.max("y2").alias("y2"))


@query("words_in_tables", sql(f"""
    SELECT b.tbl, b.n, CASE WHEN b.y2 - b.y1 > 2 * (b.x2 - b.x1) THEN 'vertical' ELSE 'horizontal' END AS direction
    FROM table_words b JOIN t a ON a.tbl = b.tbl AND {overlap_sql('a', 'b', 0.5)}""", "table_words", "table_lines", t=TABLE_BOX))
def words_in_tables(tb: Tables):
    return ob.words_in_tables(tb.table_words, table_boxes(tb), ["tbl"]).select("tbl", "n", "direction")


@query("best_line", sql("""
    SELECT tbl, n, arg_min(idx, (-ratio, idx)) AS line, max(ratio) AS ratio FROM (
      SELECT w.tbl, w.n, l.idx, greatest(0, least(w.x2, l.x2) - greatest(w.x1, l.x1)) * greatest(0, least(w.y2, l.y2) - greatest(w.y1, l.y1))
             / ((w.x2 - w.x1) * (w.y2 - w.y1)) AS ratio
      FROM table_words w JOIN table_lines l ON w.tbl = l.tbl AND l.kind = 'row') GROUP BY tbl, n""", "table_words", "table_lines"))
def best_line(tb: Tables):
    rows = tb.table_lines.filter("kind = 'row'").drop("kind")
    return ob.best_line(tb.table_words, rows, ["tbl"]).select("tbl", "n", "line", "ratio")


@query("header_overlap", sql(f"""
    SELECT a.page, a.idx, arg_min(b.label, b.idx) AS header_type, CASE WHEN count(b.idx) > 0 THEN 1 ELSE 0 END AS is_header
    FROM boxes a LEFT JOIN preds b ON a.page = b.page AND {overlap_sql('a', 'b', 0.5, 'a')} GROUP BY a.page, a.idx""",
    "boxes", "preds"))
def header_overlap(tb: Tables):
    heads = tb.preds.select("page", "idx", F.col("label").alias("kind"), *g.SIDES)
    cells = tb.boxes.select("page", "idx", *g.SIDES)
    out = ob.header_overlap(cells, heads, ["page"], ["idx"])
    return out.select("page", "idx", "header_type", F.col("is_header").cast("int").alias("is_header"))


@query("join_eval_pairs", sql("""
    SELECT o_orderkey AS page, coalesce(p.n, 0) AS n_pred, coalesce(b.n, 0) AS n_gt FROM orders
    LEFT JOIN (SELECT page, count(*) AS n FROM preds GROUP BY page) p ON p.page = o_orderkey
    LEFT JOIN (SELECT page, count(*) AS n FROM boxes GROUP BY page) b ON b.page = o_orderkey""", "preds", "boxes"))
def join_eval_pairs(tb: Tables):
    images = tb.read("orders").select(F.col("o_orderkey").alias("page"))
    return ob.join_eval_pairs(images, tb.preds, tb.boxes, "page")


@query("pick_ground_truth", sql("""
    SELECT doc_id AS stem, arg_min(kind, CASE kind WHEN '.gt.html' THEN 1 WHEN '.html' THEN 2 ELSE 3 END) AS kind
    FROM documents LEFT JOIN s ON stem = doc_id GROUP BY doc_id""", s=SIDECAR_SQL))
def pick_ground_truth(tb: Tables):
    inputs = tb.read("documents").select(F.col("doc_id").alias("stem"))
    return prep.pick_ground_truth(inputs, sidecars(tb), KINDS)


@query("confidence_filter", sql("""
    SELECT tbl, n, CASE WHEN score < 0.03 THEN '' ELSE content END AS txt, CASE WHEN score < 0.03 THEN 1 ELSE 0 END AS low_confidence
    FROM table_words WHERE y2 - y1 < 60""", "table_words"))
def confidence_filter(tb: Tables):
    rows = tb.table_words.withColumn("conf", F.when(F.col("y2") - F.col("y1") < 60, 1.0).otherwise(0.0))
    rows = ob.confidence_filter(rows, 0.5, score="conf")
    out = ob.confidence_filter(rows.withColumnRenamed("content", "txt"), 0.03, blank=True)
    return out.select("tbl", "n", "txt", F.col("low_confidence").cast("int").alias("low_confidence"))


@query("top_queries", """
    SELECT vec_id, pos, pos % 8 AS label, pos // 8 AS query, score FROM (
      SELECT vec_id, pos, score, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, pos) AS rn FROM (
        SELECT vec_id, unnest(embedding) AS score, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings)) WHERE rn <= 30 AND score > 0.1""")
def top_queries(tb: Tables):
    scores = tb.read("embeddings").select("vec_id", F.col("embedding").alias("scores"))
    return ob.top_queries(scores, "vec_id", 8, 30, 0.1)


@query("vocab_lookup", """
    SELECT ch, count(*) AS n, coalesce(any_value(id), 3) AS id FROM (SELECT unnest(string_split(text, '')) AS ch FROM benchmark)
    LEFT JOIN (SELECT unnest(string_split('abcdefghijklmnopqrstuvwxyz', '')) AS c, unnest(range(4, 30)) AS id) ON c = ch WHERE ch <> '' GROUP BY ch""")
def vocab_lookup(tb: Tables):
    spark = tb.spark
    vocab = spark.createDataFrame([(c, i + 4) for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")], "ch string, id int")
    chars = tb.read("benchmark").select(F.explode(F.split("text", "")).alias("ch")).filter("ch <> ''")
    counts = chars.groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    return prep.vocab_lookup(counts, vocab)


# ---- sequences ------------------------------------------------------------------------------------------------

@query("sequential_edges", sql("""
    SELECT page, lag(n) OVER (PARTITION BY page ORDER BY n) AS src, n AS dst FROM words QUALIFY src IS NOT NULL""", "words"))
def sequential_edges(tb: Tables):
    return w.sequential_edges(tb.words, ["page"], "n", "n")


CLUSTER_SQL = {
    "spots": "SELECT page, CAST(x1 + x2 AS DOUBLE) / 2 / 1000 AS x, count(*) AS c FROM blocks GROUP BY ALL",
    "queue": "SELECT *, row_number() OVER (PARTITION BY page ORDER BY x) AS k FROM spots",
    "walk": """-- recursive
      SELECT page, k, x, x * c AS s, c AS n, CAST(0 AS BIGINT) AS cluster FROM queue WHERE k = 1
      UNION ALL
      SELECT q.page, q.k, q.x, CASE WHEN abs(q.x - w.s / w.n) > CAST(0.15 AS DOUBLE) THEN q.x * q.c ELSE w.s + q.x * q.c END,
             CASE WHEN abs(q.x - w.s / w.n) > CAST(0.15 AS DOUBLE) THEN q.c ELSE w.n + q.c END,
             w.cluster + CASE WHEN abs(q.x - w.s / w.n) > CAST(0.15 AS DOUBLE) THEN 1 ELSE 0 END
      FROM walk w JOIN queue q ON q.page = w.page AND q.k = w.k + 1""",
}
BLOCKS = "SELECT page, idx, x1, y1, x2, y2 FROM gantt_blocks"


@query("cluster_x", sql("""
    SELECT b.page, b.idx, w.cluster FROM blocks b JOIN walk w ON b.page = w.page AND CAST(b.x1 + b.x2 AS DOUBLE) / 2 / 1000 = w.x""",
    "gantt_blocks", blocks=BLOCKS, **CLUSTER_SQL))
def cluster_x(tb: Tables):
    return w.cluster_x(tb.gantt_blocks, ["page"], g.center_x(g.box()) / 1000).select("page", "idx", "cluster")


@query("cluster_gap", sql("""
    SELECT page, CAST(floor(avg(v)) AS BIGINT) AS pos FROM (
      SELECT page, v, sum(CASE WHEN v - p <= 3 THEN 0 ELSE 1 END) OVER (PARTITION BY page ORDER BY v) AS grp FROM (
        SELECT page, v, lag(v) OVER (PARTITION BY page ORDER BY v) AS p FROM (SELECT DISTINCT page, x AS v FROM gantt_texts)))
    GROUP BY page, grp""", "gantt_texts"))
def cluster_gap(tb: Tables):
    return w.cluster_gap(tb.gantt_texts, ["page"], "x", 3)


@query("cluster_gap_first", sql("SELECT page, v AS pos FROM walk WHERE keep = 1", "gantt_texts",
    queue="SELECT page, v, row_number() OVER (PARTITION BY page ORDER BY v) AS k FROM (SELECT DISTINCT page, x AS v FROM gantt_texts)",
    walk="""-- recursive
      SELECT page, k, v, v AS last, 1 AS keep FROM queue WHERE k = 1 UNION ALL
      SELECT q.page, q.k, q.v, CASE WHEN q.v - w.last > 8 THEN q.v ELSE w.last END, CASE WHEN q.v - w.last > 8 THEN 1 ELSE 0 END
      FROM walk w JOIN queue q ON q.page = w.page AND q.k = w.k + 1"""))
def cluster_gap_first(tb: Tables):
    return w.cluster_gap(tb.gantt_texts, ["page"], "x", 8, mode="first")


@query("merge_bars", sql("SELECT page, x1, y1, x2, y2 FROM walk QUALIFY row_number() OVER (PARTITION BY page, grp ORDER BY k DESC) = 1", "boxes",
    queue="SELECT *, row_number() OVER (PARTITION BY page ORDER BY (y1 + y2) // 2, x1, y1, x2, y2) AS k FROM boxes",
    walk="""-- recursive
      SELECT page, k, x1, y1, x2, y2, 0 AS grp FROM queue WHERE k = 1 UNION ALL
      SELECT page, k, CASE WHEN j THEN ax1 ELSE x1 END, CASE WHEN j THEN least(ay1, y1) ELSE y1 END, CASE WHEN j THEN greatest(ax2, x2) ELSE x2 END,
             CASE WHEN j THEN greatest(ay2, y2) ELSE y2 END, grp + CASE WHEN j THEN 0 ELSE 1 END FROM (
        SELECT q.page, q.k, q.x1, q.y1, q.x2, q.y2, w.x1 AS ax1, w.y1 AS ay1, w.x2 AS ax2, w.y2 AS ay2, w.grp,
               abs((q.y1 + q.y2) / 2 - (w.y1 + w.y2) / 2) <= 11 AND q.x1 - w.x2 <= 6 AS j
        FROM walk w JOIN queue q ON q.page = w.page AND q.k = w.k + 1)"""))
def merge_bars(tb: Tables):
    pages = tb.boxes.select("page").distinct().withColumn("w", F.lit(1000)).withColumn("h", F.lit(1400))
    return w.merge_bars(tb.boxes.select("page", *g.SIDES), pages, ["page"])


@query("merge_active_cells", """
    SELECT o_custkey AS r, min(c) AS start_col, max(c) AS end_col FROM (
      SELECT o_custkey, c, c - row_number() OVER (PARTITION BY o_custkey ORDER BY c) AS g FROM (
        SELECT DISTINCT o_custkey, dayofyear(o_orderdate) // 7 AS c FROM orders)) GROUP BY o_custkey, g""")
def merge_active_cells(tb: Tables):
    cells = tb.read("orders").selectExpr("o_custkey as r", "cast(dayofyear(o_orderdate) div 7 as bigint) as col")
    return w.merge_active_cells(cells, ["r"])


@query("row_boundaries", sql("""
    SELECT tbl, row_number() OVER (PARTITION BY tbl ORDER BY hi) - 2 AS pos, lag(hi) OVER (PARTITION BY tbl ORDER BY hi) AS lo, hi FROM (
      SELECT DISTINCT tbl, unnest([y1, y2]) AS hi FROM table_lines) QUALIFY lo IS NOT NULL""", "table_lines"))
def row_boundaries(tb: Tables):
    return w.row_boundaries(tb.table_lines, ["tbl"])


@query("axis_scale", """
    SELECT o_custkey, CASE WHEN n >= 2 AND days <> 0 THEN CAST(bx - ax AS DOUBLE) / days END AS px_per_day,
           CASE WHEN n >= 2 AND days <> 0 THEN CAST(ax AS DOUBLE) END AS x_origin FROM (
      SELECT o_custkey, min(x) AS ax, max(x) AS bx, count(*) AS n,
             date_diff('day', CAST(arg_min(d, (x, o_orderkey)) AS DATE), CAST(arg_max(d, (x, o_orderkey)) AS DATE)) AS days
      FROM (SELECT o_custkey, o_orderkey, (o_orderkey * 37) % 1000 AS x, o_orderdate AS d FROM orders) GROUP BY o_custkey)""")
def axis_scale(tb: Tables):
    ticks = tb.read("orders").selectExpr(
        "o_custkey", "o_orderkey as idx", "(o_orderkey * 37) % 1000 as x", "cast(o_orderdate as date) as date")
    return w.axis_scale(ticks, ["o_custkey"]).drop("base_date")


@query("grid_period", """
    WITH s AS (SELECT o_custkey, (o_orderkey * 37) % 1000 AS x, o_orderkey FROM orders),
    lab AS (SELECT o_custkey, x - lag(x) OVER (PARTITION BY o_custkey ORDER BY x, o_orderkey) AS d FROM s WHERE x < 300),
    en AS (SELECT o_custkey, x - lag(x) OVER (PARTITION BY o_custkey ORDER BY x, o_orderkey) AS d FROM s),
    l AS (SELECT o_custkey, median(d) AS p FROM lab GROUP BY 1), e AS (SELECT o_custkey, median(d) AS p FROM en WHERE d BETWEEN 15 AND 166 GROUP BY 1),
    n AS (SELECT o_custkey, count(*) AS n FROM s GROUP BY 1)
    SELECT o_custkey, CASE WHEN p IS NULL OR p < 3 THEN 62.5 ELSE p END AS period FROM (
      SELECT n.o_custkey, CASE WHEN (l.p IS NULL OR l.p < 15 OR l.p > 166) AND n >= 4 THEN coalesce(e.p, l.p) ELSE l.p END AS p
      FROM n LEFT JOIN l ON n.o_custkey = l.o_custkey LEFT JOIN e ON n.o_custkey = e.o_custkey)""")
def grid_period(tb: Tables):
    xs = tb.read("orders").selectExpr("o_custkey", "o_orderkey as idx", "(o_orderkey * 37) % 1000 as x")
    pages = xs.select("o_custkey").distinct().withColumn("w", F.lit(1000))
    return w.grid_period(xs.filter("x < 300"), xs, pages, ["o_custkey"])


@query("fill_columns", """
    WITH s AS (SELECT DISTINCT o_custkey, CAST((o_orderkey * 37) % 1000 AS DOUBLE) AS x FROM orders),
    d AS (SELECT o_custkey, median(d) AS step FROM (SELECT o_custkey, x - lag(x) OVER (PARTITION BY o_custkey ORDER BY x) AS d FROM s) GROUP BY 1),
    e AS (SELECT o_custkey, min(x) AS a, max(x) AS b, 14 - count(*) AS miss, count(*) AS n FROM s GROUP BY 1)
    SELECT o_custkey, x FROM s UNION ALL
    SELECT o_custkey, a - i * step FROM (SELECT e.*, step, unnest(range(1, (miss + 1) // 2 + 1)) AS i FROM e JOIN d USING (o_custkey) WHERE n >= 2 AND miss > 0)
    UNION ALL
    SELECT o_custkey, b + i * step FROM (SELECT e.*, step, unnest(range(1, miss // 2 + 1)) AS i FROM e JOIN d USING (o_custkey) WHERE n >= 2 AND miss > 0)""")
def fill_columns(tb: Tables):
    xs = tb.read("orders").selectExpr("o_custkey", "(o_orderkey * 37) % 1000 as x").distinct().withColumn("idx", F.lit(0))
    return w.fill_columns(xs, ["o_custkey"], 14)


@query("interval_span_count", sql("""
    SELECT s.tbl, s.idx, greatest(1, count(i.lo)) AS n_cover FROM (SELECT * FROM table_lines WHERE kind = 'span') s
    LEFT JOIN (SELECT tbl, y1 AS lo, y2 AS hi FROM table_lines WHERE kind = 'row') i ON s.tbl = i.tbl AND least(s.y2, i.hi) > greatest(s.y1, i.lo)
    GROUP BY s.tbl, s.idx""", "table_lines"))
def interval_span_count(tb: Tables):
    rows = w.row_boundaries(tb.table_lines.filter("kind = 'row'"), ["tbl"])
    return w.interval_span_count(tb.table_lines.filter("kind = 'span'"), rows, ["tbl"], "y").select("tbl", "idx", "n_cover")


@query("running_best", sql("""
    SELECT trial, step, cer, least(cer, b) AS best, CASE WHEN b IS NULL OR cer < b THEN 1 ELSE 0 END AS is_best FROM (
      SELECT *, min(cer) OVER (PARTITION BY trial ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM evals)""", "evals"))
def running_best(tb: Tables):
    return w.running_best(tb.evals, ["trial"])


RUN_LOG = """
    SELECT run_id, ts, row_number() OVER (PARTITION BY run_id ORDER BY ts, event_id) AS k FROM run_events"""


@query("run_progress", sql("""
    SELECT b.run_id, (b.k + 1) // 2 AS index, count(*) OVER (PARTITION BY b.run_id) AS total,
           (epoch_us(e.ts) - epoch_us(b.ts)) / 1e6 AS latency_s
    FROM (SELECT * FROM log WHERE k % 2 = 1) b LEFT JOIN log e ON e.run_id = b.run_id AND e.k = b.k + 1""", "run_events", log=RUN_LOG))
def run_progress(tb: Tables):
    return w.run_progress(w.run_log(tb.run_events))
