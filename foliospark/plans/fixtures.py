"""Detections, pairs, tables and logs derived from the driver's tables, in Spark and in SQL.

Everything is integer arithmetic over whole tables, so that both engines agree to the last digit.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

SPACES = "[ \t\n\r\f]+"
LINE_ORDER = (
    "l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax, "
    "l_returnflag, l_linestatus"
)

CTE: dict[str, str] = {
    "words": f"""
        SELECT page, n, content, 60 * (n % 12) AS x1, 30 * (n // 12) AS y1,
               60 * (n % 12) + CASE WHEN length(content) > 2 THEN 50 ELSE 10 END AS x2, 30 * (n // 12) + 24 AS y2
        FROM (SELECT doc_id AS page, unnest(toks) AS content, CAST(generate_subscripts(toks, 1) - 1 AS BIGINT) AS n
              FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '{SPACES}'), lambda x: x <> '') AS toks
                    FROM documents))""",
    "elements": """
        SELECT page, j AS idx, 0 AS x1, 90 * j AS y1, 540 AS x2, 90 * j + 90 AS y2,
               CASE WHEN j = 0 THEN 'section_headings' WHEN j = 1 THEN 'page_header'
                    WHEN j = last_j AND j > 4 THEN 'page_footer' END AS role
        FROM (SELECT page, unnest(range(0, max(n) // 36 + 1)) AS j, max(n) // 36 AS last_j FROM words GROUP BY page)""",
    "figures": "SELECT page, 0 AS idx, 0 AS x1, 180 AS y1, 720 AS x2, 270 AS y2 FROM words GROUP BY page HAVING max(n) >= 72",
    "lines": f"""
        SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {LINE_ORDER}) AS idx FROM lineitem""",
    "boxes": """
        SELECT l_orderkey AS page, idx, l_returnflag AS label, round(10 * l_discount, 2) AS score,
               (7 * l_partkey) % 120 AS x1, 30 * ((idx - 1) // 2) + 3 * (l_suppkey % 5) AS y1,
               (7 * l_partkey) % 120 + 60 + 4 * CAST(l_quantity AS BIGINT) AS x2,
               30 * ((idx - 1) // 2) + 3 * (l_suppkey % 5) + 24 + 8 * (l_partkey % 4) AS y2
        FROM lines""",
    "preds": """
        SELECT page, idx, label, score, x1 + 6 * (idx % 5) AS x1, y1 + 4 * (idx % 3) AS y1,
               x2 + 6 * (idx % 5) AS x2, y2 + 4 * (idx % 3) AS y2
        FROM boxes WHERE score > 0""",
    "box_pairs": """
        SELECT a.page, a.idx AS i, b.idx AS j, a.label AS label_a, b.label AS label_b, a.score AS score_a,
               a.x1 AS ax1, a.y1 AS ay1, a.x2 AS ax2, a.y2 AS ay2, b.x1 AS bx1, b.y1 AS by1, b.x2 AS bx2, b.y2 AS by2
        FROM boxes a JOIN preds b ON a.page = b.page AND b.idx BETWEEN a.idx AND a.idx + 1""",
    # each character beyond ASCII gets an unused single byte: DuckDB's edit distance counts bytes
    "codes": """
        SELECT coalesce(string_agg(c, '' ORDER BY c), '') AS chars, coalesce(string_agg(chr(CAST(k AS INTEGER)), '' ORDER BY c), '') AS bytes
        FROM (SELECT c, row_number() OVER (ORDER BY c) AS k FROM (
            SELECT DISTINCT unnest(string_split(text, '')) AS c FROM (SELECT text FROM documents UNION ALL SELECT text FROM conversations))
            WHERE length(c) = 1 AND strlen(c) > 1)""",
    "text_pairs": """
        SELECT *, translate(ref, chars, bytes) AS eref, translate(hyp, chars, bytes) AS ehyp
        FROM (SELECT doc_id, source, line_no, ref, translate(ref, 'eo', 'co') AS hyp
              FROM (SELECT doc_id, source, CAST(k AS BIGINT) AS line_no, line AS ref
                    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                                 generate_subscripts(string_split(text, chr(10)), 1) AS k
                          FROM documents))
              WHERE ref <> ''), codes""",
    "qa": f"""
        SELECT q.conv_id, q.turn, q.text AS question, a.text AS answer,
               lower(array_to_string(toks[:len(toks) - 1], ' ')) AS prediction
        FROM conversations q
        JOIN (SELECT *, list_filter(regexp_split_to_array(text, '{SPACES}'), lambda x: x <> '') AS toks
              FROM conversations WHERE role = 'assistant') a
          ON q.conv_id = a.conv_id AND a.turn = q.turn + 1
        WHERE q.role = 'user'""",
    "tab_rows": """
        SELECT l_orderkey AS tbl, idx + 1 AS r, l_quantity AS a, l_discount AS b, l_tax AS c, l_returnflag AS flag FROM lines""",
    "cells": """
        SELECT tbl, 1 AS r, c AS col, ['quantity', 'discount', 'tax'][c] AS txt, 1 AS head
        FROM (SELECT DISTINCT tbl FROM tab_rows), (SELECT unnest([1, 2, 3]) AS c)
        UNION ALL
        SELECT tbl, r, col, [CAST(CAST(a AS BIGINT) AS VARCHAR), CAST(CAST(round(b * 100) AS BIGINT) AS VARCHAR),
               CAST(CAST(round(c * 100) AS BIGINT) AS VARCHAR) || flag][col] AS txt, 0 AS head
        FROM tab_rows, (SELECT unnest([1, 2, 3]) AS col)""",
    "html_rows": """
        SELECT tbl, r, '<tr>' || string_agg(CASE WHEN head = 1 THEN '<th>' || txt || '</th>'
               ELSE '<td>' || txt || '</td>' END, '' ORDER BY col) || '</tr>' AS h, max(r) OVER (PARTITION BY tbl) AS last_r
        FROM cells GROUP BY tbl, r""",
    "html_pairs": """
        SELECT tbl, '<table>' || string_agg(h, '' ORDER BY r) || '</table>' AS gt,
               '<table>' || coalesce(string_agg(h, '' ORDER BY r) FILTER (WHERE NOT (tbl % 2 = 1 AND r = last_r)), '')
               || '</table>' AS pred
        FROM html_rows GROUP BY tbl""",
    "run_events": """
        SELECT user_id AS run_id, event_type AS stage, CAST(floor(value * 10) AS BIGINT) AS ms, ts, event_id FROM events""",
    "evals": """
        SELECT o_custkey % 10 AS trial, o_orderkey AS step, round(o_totalprice / 1e6, 6) AS cer FROM orders""",
    "samples": """
        SELECT d.doc_id AS id, d.text AS document, ['qa', 'json_extraction', 'summary', 'table_qa', 'layout_understanding']
               [CAST(d.doc_id % 5 AS INTEGER) + 1] AS task_type, 'What does the page say?' AS question,
               split_part(d.text, '.', 1) AS answer, coalesce(l.quality, 0) AS quality
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "table_lines": """
        SELECT l_orderkey AS tbl, 'row' AS kind, idx, 0 AS x1, 40 * (idx - 1) AS y1, 400 AS x2, 40 * idx AS y2 FROM lines
        UNION ALL
        SELECT tbl, 'col' AS kind, k AS idx, 100 * (k - 1) AS x1, 0 AS y1, 100 * k AS x2, 40 * n AS y2
        FROM (SELECT l_orderkey AS tbl, count(*) AS n FROM lineitem GROUP BY l_orderkey), (SELECT unnest([1, 2, 3, 4]) AS k)
        UNION ALL
        SELECT l_orderkey AS tbl, 'span' AS kind, idx, 100 * (l_suppkey % 2) AS x1, 40 * (idx - 1) AS y1,
               100 * (l_suppkey % 2) + 100 * (1 + l_partkey % 3) AS x2, 40 * (idx - 1) + 40 * (1 + l_suppkey % 2) AS y2
        FROM lines WHERE l_returnflag = 'A'""",
    "table_words": """
        SELECT l_orderkey AS tbl, idx AS n, (7 * l_partkey) % 300 AS x1, 40 * (idx - 1) + 5 AS y1,
               (7 * l_partkey) % 300 + CASE WHEN l_linestatus = 'O' THEN 20 ELSE 60 + CAST(l_quantity AS BIGINT) END AS x2,
               40 * (idx - 1) + CASE WHEN l_linestatus = 'O' THEN 60 ELSE 33 END AS y2,
               CAST(CAST(round(l_extendedprice) AS BIGINT) AS VARCHAR) AS content, l_discount AS score
        FROM lines""",
    "gantt_texts": """
        SELECT o_custkey % 50 AS page, o_orderkey AS idx, o_orderpriority AS priority,
               month(o_orderdate) || '/' || day(o_orderdate) AS d1,
               month(o_orderdate + INTERVAL 7 DAY) || '/' || day(o_orderdate + INTERVAL 7 DAY) AS d2,
               (o_orderkey * 37) % 1000 AS x, (o_orderkey * 53) % 1400 AS y
        FROM orders""",
    "gantt_blocks": """
        SELECT page, idx * 3 AS idx, d1 AS txt, x AS x1, y % 180 AS y1, x + 40 AS x2, y % 180 + 20 AS y2 FROM gantt_texts
        UNION ALL
        SELECT page, idx * 3 + 1 AS idx, priority AS txt, x % 100 AS x1, y AS y1, x % 100 + 100 AS x2, y + 20 AS y2 FROM gantt_texts
        UNION ALL
        SELECT page, idx * 3 + 2 AS idx, d1 || '~' || d2 AS txt, 300 + x % 400 AS x1, y AS y1, 300 + x % 400 + 80 AS x2,
               y + 20 AS y2 FROM gantt_texts""",
}

NEEDS: dict[str, tuple[str, ...]] = {
    "elements": ("words",),
    "figures": ("words",),
    "boxes": ("lines",),
    "preds": ("boxes",),
    "box_pairs": ("boxes", "preds"),
    "tab_rows": ("lines",),
    "cells": ("tab_rows",),
    "html_rows": ("cells",),
    "html_pairs": ("html_rows",),
    "table_lines": ("lines",),
    "table_words": ("lines",),
    "gantt_blocks": ("gantt_texts",),
}


def sql(body: str, *names: str, **extra: str) -> str:
    """`body` with the named fixtures, what they need, and extra CTEs in front; those with the comment `stored` run once."""
    order: list[str] = []

    def add(name: str) -> None:
        for need in NEEDS.get(name, ()):
            add(need)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({CTE[n]})" for n in order] + [f"{n} AS {'MATERIALIZED ' * ('/* stored */' in q)}({q})" for n, q in extra.items()]
    recursive = "RECURSIVE " if any("-- recursive" in q for q in extra.values()) else ""
    return f"WITH {recursive}{', '.join(parts)} {body}" if parts else body


class Tables:
    """The driver's tables and the fixtures derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def words(self) -> DataFrame:
        toks = F.filter(F.split("text", SPACES), lambda x: x != "")
        n = F.col("n")
        wide = F.when(F.length("content") > 2, 50).otherwise(10)
        return (
            self.read("documents")
            .select(F.col("doc_id").alias("page"), F.posexplode(toks).alias("n", "content"))
            .withColumn("n", n.cast("bigint"))
            .select(
                "page", "n", "content",
                (60 * (n % 12)).alias("x1"), F.expr("30 * (n div 12)").alias("y1"),
                (60 * (n % 12) + wide).alias("x2"), F.expr("30 * (n div 12) + 24").alias("y2"),
            )
        )

    @cached_property
    def elements(self) -> DataFrame:
        toks = F.size(F.filter(F.split("text", SPACES), lambda x: x != ""))
        docs = self.read("documents").select(F.col("doc_id").alias("page"), (toks - 1).alias("last_n"))
        docs = docs.filter("last_n >= 0").withColumn("last_j", F.expr("cast(last_n div 36 as bigint)"))
        j = F.col("idx")
        role = (
            F.when(j == 0, "section_headings").when(j == 1, "page_header")
            .when((j == F.col("last_j")) & (j > 4), "page_footer")
        )
        return docs.withColumn("idx", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last_j")))).select(
            "page", "idx", F.lit(0).cast("bigint").alias("x1"), (90 * j).alias("y1"),
            F.lit(540).cast("bigint").alias("x2"), (90 * j + 90).alias("y2"), role.alias("role"),
        )

    @cached_property
    def figures(self) -> DataFrame:
        toks = F.size(F.filter(F.split("text", SPACES), lambda x: x != ""))
        return self.read("documents").filter(toks - 1 >= 72).selectExpr(
            "doc_id as page", "0L as idx", "0L as x1", "180L as y1", "720L as x2", "270L as y2"
        )

    @cached_property
    def lines(self) -> DataFrame:
        order = [F.col(c.strip()) for c in LINE_ORDER.split(",")]
        return self.read("lineitem").withColumn(
            "idx", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order)).cast("bigint")
        )

    @cached_property
    def boxes(self) -> DataFrame:
        return self.lines.selectExpr(
            "l_orderkey as page", "idx", "l_returnflag as label", "round(10 * l_discount, 2) as score",
            "(7 * l_partkey) % 120 as x1", "30 * ((idx - 1) div 2) + 3 * (l_suppkey % 5) as y1",
            "(7 * l_partkey) % 120 + 60 + 4 * cast(l_quantity as bigint) as x2",
            "30 * ((idx - 1) div 2) + 3 * (l_suppkey % 5) + 24 + 8 * (l_partkey % 4) as y2",
        )

    @cached_property
    def preds(self) -> DataFrame:
        return self.boxes.filter("score > 0").selectExpr(
            "page", "idx", "label", "score", "x1 + 6 * (idx % 5) as x1", "y1 + 4 * (idx % 3) as y1",
            "x2 + 6 * (idx % 5) as x2", "y2 + 4 * (idx % 3) as y2",
        )

    @cached_property
    def box_pairs(self) -> DataFrame:
        a = self.boxes.withColumn("j", F.explode(F.array("idx", F.col("idx") + 1)))
        a = a.selectExpr(
            "page", "idx as i", "j", "label as label_a", "score as score_a", "x1 as ax1", "y1 as ay1", "x2 as ax2", "y2 as ay2"
        )
        b = self.preds.selectExpr("page", "idx as j", "label as label_b", "x1 as bx1", "y1 as by1", "x2 as bx2", "y2 as by2")
        return a.join(b, ["page", "j"])

    @cached_property
    def text_pairs(self) -> DataFrame:
        return (
            self.read("documents")
            .select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("k", "ref"))
            .select("doc_id", "source", (F.col("k") + 1).cast("bigint").alias("line_no"), "ref")
            .filter("ref <> ''")
            .withColumn("hyp", F.translate("ref", "eo", "co"))
        )

    @cached_property
    def qa(self) -> DataFrame:
        turns = self.read("conversations")
        toks = F.filter(F.split("text", SPACES), lambda x: x != "")
        kept = F.slice(toks, F.lit(1), F.greatest(F.size(toks) - 1, F.lit(0)))
        q = turns.filter("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
        a = turns.filter("role = 'assistant'").select(
            "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"),
            F.lower(F.array_join(kept, " ")).alias("prediction"),
        )
        return q.join(a, ["conv_id", "turn"])

    @cached_property
    def tab_rows(self) -> DataFrame:
        return self.lines.selectExpr(
            "l_orderkey as tbl", "idx + 1 as r", "l_quantity as a", "l_discount as b", "l_tax as c", "l_returnflag as flag"
        )

    @cached_property
    def cells(self) -> DataFrame:
        head = (
            self.read("lineitem").select(F.col("l_orderkey").alias("tbl")).distinct()
            .select("tbl", F.lit(1).cast("bigint").alias("r"), F.posexplode(F.array(*map(F.lit, ("quantity", "discount", "tax")))))
            .selectExpr("tbl", "r", "cast(pos + 1 as bigint) as col", "col as txt", "1 as head")
        )
        body = self.tab_rows.selectExpr(
            "tbl", "r",
            "posexplode(array(cast(cast(a as bigint) as string), cast(cast(round(b * 100) as bigint) as string), "
            "cast(cast(round(c * 100) as bigint) as string) || flag))",
        ).selectExpr("tbl", "r", "cast(pos + 1 as bigint) as col", "col as txt", "0 as head")
        return head.unionByName(body)

    @cached_property
    def html_pairs(self) -> DataFrame:
        tag = F.when(F.col("head") == 1, F.concat(F.lit("<th>"), "txt", F.lit("</th>"))).otherwise(
            F.concat(F.lit("<td>"), "txt", F.lit("</td>"))
        )
        rows = self.cells.groupBy("tbl", "r").agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", tag.alias("h")))), lambda c: c["h"]), "").alias("h")
        ).withColumn("h", F.concat(F.lit("<tr>"), "h", F.lit("</tr>")))
        whole = rows.groupBy("tbl").agg(F.array_sort(F.collect_list(F.struct("r", "h"))).alias("rows"))
        n = F.size("rows")
        cut = F.when(F.col("tbl") % 2 == 1, F.slice("rows", F.lit(1), n - 1)).otherwise(F.col("rows"))
        html = lambda rows: F.concat(F.lit("<table>"), F.array_join(F.transform(rows, lambda x: x["h"]), ""), F.lit("</table>"))
        return whole.select("tbl", html(F.col("rows")).alias("gt"), html(cut).alias("pred"))

    @cached_property
    def run_events(self) -> DataFrame:
        return self.read("events").select(
            F.col("user_id").alias("run_id"), F.col("event_type").alias("stage"),
            F.floor(F.col("value") * 10).cast("bigint").alias("ms"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
        )

    @cached_property
    def evals(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "o_custkey % 10 as trial", "o_orderkey as step", "round(o_totalprice / 1e6D, 6) as cer"
        )

    @cached_property
    def samples(self) -> DataFrame:
        tasks = F.array(*map(F.lit, ("qa", "json_extraction", "summary", "table_qa", "layout_understanding")))
        labels = self.read("labels").select("doc_id", "quality")
        return self.read("documents").join(labels, "doc_id", "left").select(
            F.col("doc_id").alias("id"), F.col("text").alias("document"),
            F.get(tasks, (F.col("doc_id") % 5).cast("int")).alias("task_type"),
            F.lit("What does the page say?").alias("question"),
            F.substring_index("text", ".", 1).alias("answer"), F.coalesce("quality", F.lit(0)).alias("quality"),
        )

    @cached_property
    def table_lines(self) -> DataFrame:
        row = self.lines.selectExpr("l_orderkey as tbl", "'row' as kind", "idx", "0L as x1", "40 * (idx - 1) as y1", "400L as x2", "40 * idx as y2")
        col = (
            self.read("lineitem").groupBy(F.col("l_orderkey").alias("tbl")).agg(F.count(F.lit(1)).alias("n"))
            .withColumn("idx", F.expr("explode(array(1L, 2L, 3L, 4L))"))
            .selectExpr("tbl", "'col' as kind", "idx", "100 * (idx - 1) as x1", "0L as y1", "100 * idx as x2", "40 * n as y2")
        )
        span = self.lines.filter("l_returnflag = 'A'").selectExpr(
            "l_orderkey as tbl", "'span' as kind", "idx", "100 * (l_suppkey % 2) as x1", "40 * (idx - 1) as y1",
            "100 * (l_suppkey % 2) + 100 * (1 + l_partkey % 3) as x2", "40 * (idx - 1) + 40 * (1 + l_suppkey % 2) as y2",
        )
        return row.unionByName(col).unionByName(span)

    @cached_property
    def table_words(self) -> DataFrame:
        return self.lines.selectExpr(
            "l_orderkey as tbl", "idx as n", "(7 * l_partkey) % 300 as x1", "40 * (idx - 1) + 5 as y1",
            "(7 * l_partkey) % 300 + case when l_linestatus = 'O' then 20 else 60 + cast(l_quantity as bigint) end as x2",
            "40 * (idx - 1) + case when l_linestatus = 'O' then 60 else 33 end as y2",
            "cast(cast(round(l_extendedprice) as bigint) as string) as content", "l_discount as score",
        )

    @cached_property
    def gantt_texts(self) -> DataFrame:
        return self.read("orders").selectExpr(
            "o_custkey % 50 as page", "o_orderkey as idx", "o_orderpriority as priority",
            "month(o_orderdate) || '/' || day(o_orderdate) as d1",
            "month(date_add(o_orderdate, 7)) || '/' || day(date_add(o_orderdate, 7)) as d2",
            "(o_orderkey * 37) % 1000 as x", "(o_orderkey * 53) % 1400 as y",
        )

    @cached_property
    def gantt_blocks(self) -> DataFrame:
        t = self.gantt_texts
        top = t.selectExpr("page", "idx * 3 as idx", "d1 as txt", "x as x1", "y % 180 as y1", "x + 40 as x2", "y % 180 + 20 as y2")
        left = t.selectExpr("page", "idx * 3 + 1 as idx", "priority as txt", "x % 100 as x1", "y as y1", "x % 100 + 100 as x2", "y + 20 as y2")
        mid = t.selectExpr(
            "page", "idx * 3 + 2 as idx", "d1 || '~' || d2 as txt", "300 + x % 400 as x1", "y as y1",
            "300 + x % 400 + 80 as x2", "y + 20 as y2",
        )
        return top.unionByName(left).unionByName(mid)
