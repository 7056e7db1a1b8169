"""Queries over readers, writers and model stages. Files are written from the tables first and read back."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from foliospark.functions import geometry as g
from foliospark.operators import metrics as m, providers as pv, render as rn, sampling as sp
from foliospark.plans import render_queries as rq
from foliospark.plans.fixtures import Tables, sql
from foliospark.plans.registry import query
from foliospark.session import scratch_path
from foliospark.sources import readers as rd, writers as wr


@query("read_doc_jsonl", sql("""
    SELECT b.doc_id, b.page_num, b.n_blocks, md5(b.txt) AS h, coalesce(t.num_cells, 0) AS num_cells FROM (
      SELECT doc_id, page_num, count(*) AS n_blocks, string_agg(txt, '|' ORDER BY block_idx) AS txt FROM blk GROUP BY doc_id, page_num) b
    LEFT JOIN tb t ON t.doc_id = b.doc_id AND t.page_num = b.page_num""", "cells", **rq.DOC))
def read_doc_jsonl(tb: Tables):
    """The document number goes into each line as its file name."""
    lines = rn.export_flat(rq.pages(tb), rq.blocks(tb), rq.tables(tb), rq.cells(tb))
    path = scratch_path(tb.spark, "doc")
    named = F.concat(F.expr("substring(line, 1, length(line) - 1)"), F.lit(',"filename":"'), F.col("doc_id").cast("string"), F.lit('"}'))
    lines.select(named.alias("value"), (F.col("doc_id") % 16).alias("part")).write.partitionBy("part").text(path)
    frames = rd.read_doc_jsonl(tb.spark, path)
    doc = F.col("filename").cast("bigint").alias("doc_id")
    block = frames["text_block"].select(doc, "page_num", "block_idx", "text")
    texts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_idx", "text"))), lambda x: x["text"]), "|")
    per_page = block.groupBy("doc_id", "page_num").agg(F.count(F.lit(1)).alias("n_blocks"), F.md5(texts).alias("h"))
    tables = frames["table"].select(doc, "page_num", "num_cells")
    return per_page.join(tables, ["doc_id", "page_num"], "left").na.fill(0, ["num_cells"])


@query("read_instructions", f"""
    SELECT CASE WHEN doc_id % 2 = 0 THEN 'Read it.' ELSE '{rd.DEFAULT_INSTRUCTION}' END AS instruction, md5(text) AS h, lang AS response FROM documents""")
def read_instructions(tb: Tables):
    path = scratch_path(tb.spark, "instructions") + ".jsonl"
    tb.read("documents").select(F.when(F.col("doc_id") % 2 == 0, "Read it.").alias("instruction"), F.col("text").alias("document"),
                                F.col("lang").alias("response")).write.json(path)
    return rd.read_instructions(tb.spark, path).select("instruction", F.md5("document").alias("h"), "response")


@query("read_label_map", "SELECT 'img' || item_id || '.png' AS name, md5(text) AS h FROM benchmark")
def read_label_map(tb: Tables):
    path = scratch_path(tb.spark, "labels")
    pair = F.struct(F.concat(F.lit("img"), F.col("item_id").cast("string"), F.lit(".png")), "text")
    maps = tb.read("benchmark").groupBy(F.expr("item_id div 64").alias("k")).agg(F.map_from_entries(F.collect_list(pair)).alias("m"))
    maps.repartition("k").select(F.to_json("m").alias("value"), "k").write.partitionBy("k").text(path)
    return rd.read_label_map(tb.spark, path).select("name", F.md5("text").alias("h"))


@query("read_coco", sql("""
    SELECT page * 1000 + idx AS id, page AS image_id, label, x1, y1, x2, y2 FROM boxes""", "boxes"))
def read_coco(tb: Tables):
    """A file per group of pages; annotations of a page that has no image are in it too."""
    path = scratch_path(tb.spark, "coco")
    classes = F.create_map(*[F.lit(x) for i, c in enumerate("ANR") for x in (c, i)])
    rows = tb.boxes.select("page", F.expr("page div 2048").alias("k"), F.struct(
        (F.col("page") * 1000 + F.col("idx")).alias("id"), F.col("page").alias("image_id"), F.element_at(classes, F.col("label")).alias("category_id"),
        F.array("x1", "y1", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")).alias("bbox")).alias("a"))
    stray = F.struct(F.lit(-1).cast("bigint").alias("id"), F.lit(-1).cast("bigint").alias("image_id"), F.lit(0).alias("category_id"),
                     F.array(*[F.lit(1).cast("bigint")] * 4).alias("bbox"))
    image = F.struct(F.col("page").alias("id"), F.concat(F.lit("p"), F.col("page").cast("string")).alias("file_name"), F.lit(320).alias("width"), F.lit(320).alias("height"))
    cats = F.array(*(F.struct(F.lit(i).alias("id"), F.lit(c).alias("name")) for i, c in enumerate("ANR")))
    doc = rows.groupBy("k").agg(F.to_json(F.struct(F.collect_set(image).alias("images"), F.concat(F.collect_list("a"), F.array(stray)).alias("annotations"),
                                                   cats.alias("categories"))).alias("value"))
    doc.repartition("k").write.partitionBy("k").text(path)
    return rd.read_coco(tb.spark, path)["annotations"].select("id", "image_id", "label", *g.SIDES)


@query("read_table_annotations", sql("""
    SELECT 't' || tbl || '.png' AS image, n - 1 AS idx, n % 6 AS label, x1 / 400.0 AS cx, y1 / 400.0 AS cy, 1 AS w, 0.1 AS h FROM table_words""",
    "table_words"))
def read_table_annotations(tb: Tables):
    path = scratch_path(tb.spark, "tables")
    box = F.array(F.col("x1") / 400.0, F.col("y1") / 400.0, F.lit(1.0), F.lit(0.1))
    items = tb.table_words.groupBy("tbl").agg(F.array_sort(F.collect_list(F.struct("n", box.alias("b"), (F.col("n") % 6).alias("l")))).alias("x"))
    name = F.concat(F.lit("t"), F.col("tbl").cast("string"), F.lit(".png"))
    item = F.struct(F.when(F.col("tbl") % 2 == 0, name).alias("image"), F.when(F.col("tbl") % 2 == 1, name).alias("image_path"),
                    F.transform("x", lambda r: r["b"]).alias("boxes"), F.transform("x", lambda r: r["l"]).alias("labels"))
    docs = items.groupBy(F.expr("tbl div 2048").alias("k")).agg(F.collect_list(item).alias("annotations"))
    bare = F.when(F.col("k") % 2 == 0, F.to_json("annotations")).otherwise(F.to_json(F.struct("annotations")))
    docs.repartition("k").select(bare.alias("value"), "k").write.partitionBy("k").text(path)
    return rd.read_table_annotations(tb.spark, path)


@query("read_corpus_lines", """
    SELECT md5(s) AS h, count(*) AS n FROM (SELECT trim(unnest(string_split(text, chr(10)))) AS s FROM (SELECT nfc_normalize(text) AS text FROM documents))
    WHERE s <> '' GROUP BY 1""")
def read_corpus_lines(tb: Tables):
    """Every other line is written as a JSON object. In these texts NFC gives what NFKC does."""
    path = scratch_path(tb.spark, "corpus")
    lines = tb.read("documents").select(F.posexplode(F.split("text", "\n")).alias("k", "s"))
    json_line = F.to_json(F.struct(F.lit(1).alias("id"), F.col("s").alias("text")))
    lines.select(F.when(F.col("k") % 2 == 0, json_line).otherwise(F.concat(F.lit(" "), "s")).alias("value"), (F.col("k") % 3).alias("part")).write.partitionBy("part").text(path)
    return rd.read_corpus_lines(tb.spark, path).groupBy(F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("n"))


@query("discover_inputs", "SELECT sha256(text || chr(10)) AS sha256, strlen(text) + 1 AS size FROM benchmark")
def discover_inputs(tb: Tables):
    path = scratch_path(tb.spark, "inputs")
    tb.read("benchmark").repartition("item_id").select(F.col("text").alias("value"), F.col("item_id").alias("k")).write.partitionBy("k").text(path)
    return rd.discover_inputs(tb.spark, path, [".txt"]).select("sha256", "size")


@query("read_baselines", """
    SELECT 'layout' AS section, p_name AS method, CAST(p_retailprice AS VARCHAR) AS score, p_brand AS source FROM part
    UNION ALL SELECT 'tables', c_name, CAST(c_acctbal AS VARCHAR), c_mktsegment FROM customer""")
def read_baselines(tb: Tables):
    root = scratch_path(tb.spark, "baselines")
    tb.read("part").selectExpr("p_name as method", "p_type as split", "cast(p_retailprice as string) as map", "p_brand as source").write.option("header", True).csv(f"{root}/layout.csv")
    tb.read("customer").selectExpr("c_name as method", "'x' as dataset", "'y' as metric", "cast(c_acctbal as string) as score", "c_mktsegment as source").write.option(
        "header", True).csv(f"{root}/tables.csv")
    got = rd.read_baselines(tb.spark, root)
    pick = lambda s, a, b: got[s].select(F.lit(s).alias("section"), F.col(a).alias("method"), F.col(b).alias("score"), "source")
    return pick("layout", "method", "map").unionByName(pick("tables", "method", "score")).unionByName(pick("docqa", "model", "docvqa"))


@query("read_eval_logs", sql("SELECT 'trial=' || trial AS trial, count(*) AS n, min(cer) AS cer FROM evals GROUP BY 1", "evals"))
def read_eval_logs(tb: Tables):
    path = scratch_path(tb.spark, "evals")
    lines = tb.evals.select(F.to_json(F.struct("step", "cer")).alias("value"), "trial")
    broken = tb.evals.select(F.lit('{"step": 1, "ce').alias("value"), "trial").distinct()
    lines.unionByName(broken).write.partitionBy("trial").text(path)
    return rd.read_eval_logs(tb.spark, path).groupBy("trial").agg(F.count(F.lit(1)).alias("n"), F.min("cer").alias("cer"))


@query("consolidated_report", """
    SELECT count(*) AS n, round(sum(o_totalprice) + 1e-9, 2) AS total, metric FROM (SELECT o_totalprice, 'price' AS metric FROM orders UNION ALL SELECT o_custkey, 'cust' FROM orders) GROUP BY metric""")
def consolidated_report(tb: Tables):
    """Each result file holds the metrics of many orders under their keys."""
    path = scratch_path(tb.spark, "results")
    pair = lambda name, v: F.struct(F.concat(F.lit(name + "_"), F.col("o_orderkey").cast("string")).alias("key"), F.to_json(F.struct(v.alias("v"))).alias("value"))
    rows = tb.read("orders").select(F.expr("o_orderkey div 4096").alias("k"), F.explode(F.array(
        pair("price", F.col("o_totalprice").cast("string")), pair("cust", F.col("o_custkey").cast("string")), pair("name", F.col("o_orderpriority")))).alias("p"))
    raw = F.regexp_extract("p.value", r'^\{"v":"(.*)"\}$', 1)
    text = F.when(F.col("p.key").startswith("name"), F.concat(F.lit('"'), raw, F.lit('"'))).otherwise(raw)
    docs = rows.select("k", F.concat(F.lit('"'), F.col("p.key"), F.lit('": '), text).alias("e")).groupBy("k").agg(
        F.concat(F.lit("{"), F.array_join(F.collect_list("e"), ", "), F.lit("}")).alias("value"))
    docs.repartition("k").write.partitionBy("k").text(path)
    out = rd.consolidated_report(tb.spark, path)
    return out.groupBy(F.regexp_extract("metric", "^([a-z]+)", 1).alias("metric")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value") + 1e-9, 2).alias("total"))


@query("write_split", """
    SELECT split, count(*) AS n FROM (SELECT CASE WHEN row_number() OVER (ORDER BY md5(o_orderkey || ':42'), o_orderkey) <= floor(count(*) OVER () * 0.1) THEN 'val' ELSE 'train' END AS split FROM orders)
    GROUP BY split""")
def write_split(tb: Tables):
    path = scratch_path(tb.spark, "split")
    wr.write_split(sp.train_val_split(tb.read("orders").select("o_orderkey", "o_orderpriority"), 0.1, 42, "o_orderkey"), path)
    return tb.spark.read.schema("o_orderkey bigint, o_orderpriority string, split string").json(path).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("write_run_summary", """
    SELECT count(*) AS files, (SELECT count(*) FROM events) AS count, round(sum(value) + 1e-9, 4) AS total FROM events""")
def write_run_summary(tb: Tables):
    path = scratch_path(tb.spark, "summary")
    rows = tb.read("events").selectExpr("event_id as file", "value as latency_s", "user_id as vram_mb")
    wr.write_run_summary(rows, m.latency_summary(rows), path)
    metrics = tb.spark.read.schema("file bigint, latency_s double, vram_mb bigint").option("header", True).csv(f"{path}/metrics")
    summary = tb.spark.read.schema("count bigint").json(f"{path}/summary")
    return metrics.agg(F.count(F.lit(1)).alias("files"), F.round(F.sum("latency_s") + 1e-9, 4).alias("total")).withColumn("k", F.lit(1)).join(
        summary.withColumn("k", F.lit(1)), "k").drop("k")


# ---- model stages ---------------------------------------------------------------------------------------------

def line_detector():
    """Stand-in for a detector: a box per text line."""
    def detect(batch: pd.DataFrame) -> pd.DataFrame:
        rows = [(page, i, len(line), 20 * i) for page, text in zip(batch["page"], batch["text"]) for i, line in enumerate(text.split("\n"))]
        return pd.DataFrame(rows, columns=["page", "idx", "width", "y1"])

    return detect


@query("infer_pages", """
    SELECT doc_id AS page, k - 1 AS idx, length(s) AS width, 20 * (k - 1) AS y1 FROM (
      SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS k, unnest(string_split(text, chr(10))) AS s FROM documents)""")
def infer_pages(tb: Tables):
    pages = tb.read("documents").select(F.col("doc_id").alias("page"), "text")
    return pv.infer_pages(pages, line_detector, "page bigint, idx bigint, width bigint, y1 bigint")


def picky():
    def count(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["lang"] != "en").any():
            raise ValueError("only English")
        return batch.assign(n=batch["n_chars"])

    return count


def lenient():
    def count(batch: pd.DataFrame) -> pd.DataFrame:
        if (batch["lang"] == "es").any():
            raise ValueError("no Spanish")
        return batch.assign(n=-batch["n_chars"])

    return count


@query("infer_with_fallback", """
    SELECT doc_id, CASE lang WHEN 'en' THEN n_chars WHEN 'es' THEN NULL ELSE -n_chars END AS n, CASE lang WHEN 'en' THEN 'first' WHEN 'es' THEN NULL ELSE 'second' END AS provider,
           CASE lang WHEN 'es' THEN 'second: no Spanish' END AS error FROM documents""")
def infer_with_fallback(tb: Tables):
    rows = tb.read("documents").select("doc_id", "lang", "n_chars")
    out = pv.infer_with_fallback(rows, ("first", picky), ("second", lenient), "doc_id bigint, lang string, n_chars bigint, n bigint")
    return out.select("doc_id", "n", "provider", "error")


def echo_client():
    """Stand-in for a model: the length of the prompt and its first word; fails on very short prompts."""
    def ask(prompt: str):
        if len(prompt) % 7 == 0:
            raise RuntimeError("no answer")
        return f"\n {len(prompt)}\nmore"

    return ask


@query("llm_tasks", """
    SELECT conv_id, turn, CASE WHEN n % 7 = 0 THEN NULL ELSE CAST(n AS VARCHAR) END AS result FROM (
      SELECT conv_id, turn, length('[文書] ' || text || ' [質問] who? ' || chr(10) || chr(10) || 'Answer concisely in English only. Output just the answer without explanation.') - 1 AS n FROM conversations)""")
def model_tasks(tb: Tables):
    rows = tb.read("conversations").select("conv_id", "turn", "text")
    return pv.model_tasks(rows, "qa", echo_client, "en", question=F.lit("who?")).select("conv_id", "turn", "result")
