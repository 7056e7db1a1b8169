"""Queries over sampling, mixing and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import text as t
from foliospark.operators import prompts as pr, sampling as sp
from foliospark.plans.expression_queries import sql_strip
from foliospark.plans.fixtures import Tables, sql
from foliospark.plans.registry import query


def h(c: str, seed) -> str:
    return f"md5({c} || ':{seed}')"


def num(c: str, seed) -> str:
    return f"CAST('0x' || left({h(c, seed)}, 8) AS BIGINT)"


@query("limit_pages", "SELECT conv_id, turn FROM conversations WHERE turn <= 3")
def limit_pages(tb: Tables):
    return sp.limit_pages(tb.read("conversations"), 3, "turn").select("conv_id", "turn")


@query("first_n_inputs", """
    SELECT url, page_id AS stem, doc_id IS NOT NULL AS has_side FROM (SELECT * FROM pages ORDER BY url, page_id LIMIT 40) LEFT JOIN (SELECT DISTINCT doc_id FROM labels) ON doc_id = page_id""")
def first_n_inputs(tb: Tables):
    inputs = tb.read("pages").select(F.struct("url", "page_id").alias("name"), F.col("page_id").alias("stem"), "url")
    side = tb.read("labels").select(F.col("doc_id").alias("stem")).distinct()
    first, kept = sp.first_n_inputs(inputs, side, 40)
    return first.join(kept.withColumn("k", F.lit(True)), "stem", "left").select("url", "stem", F.coalesce("k", F.lit(False)).alias("has_side"))


@query("sample_exact", f"""
    SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY {h('o_orderkey', 42)}, o_orderkey) AS r FROM orders) WHERE r <= 500""")
def sample_exact(tb: Tables):
    return sp.sample_exact(tb.read("orders"), 500, 42, "o_orderkey").select("o_orderkey")


@query("oversample", f"""
    SELECT item_id, unnest(range(0, (500 - r) // n + 1)) AS copy FROM (
      SELECT item_id, row_number() OVER (ORDER BY {h('item_id', 7)}, item_id) AS r, count(*) OVER () AS n FROM benchmark)""")
def oversample(tb: Tables):
    return sp.oversample(tb.read("benchmark"), 500, 7, "item_id").select("item_id", "copy")


@query("shuffle_rows", f"SELECT c_custkey, row_number() OVER (ORDER BY {h('c_custkey', 3)}, c_custkey) AS pos FROM customer")
def shuffle_rows(tb: Tables):
    return sp.shuffle_rows(tb.read("customer"), 3, "c_custkey").select("c_custkey", "pos")


@query("line_fragments", f"""
    WITH l AS (SELECT CAST(doc_id * 100000 + generate_subscripts(string_split(text, chr(10)), 1) - 1 AS BIGINT) AS id, unnest(string_split(text, chr(10))) AS s FROM documents),
    f AS (SELECT id, CASE WHEN length(s) > 25 THEN substr(s, {num('id', 'w5')} % greatest(length(s) - 24, 1) + 1, 25) ELSE s END AS fragment FROM l)
    SELECT id, md5(fragment) AS h, unnest(range(0, (3000 - r) // n + 1)) AS copy FROM (
      SELECT id, fragment, row_number() OVER (ORDER BY {h('id', 5)}, id) AS r, count(*) OVER () AS n FROM f WHERE trim(fragment, ' ') <> '') WHERE r <= 3000""")
def line_fragments(tb: Tables):
    lines = tb.read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    lines = lines.select((F.col("doc_id") * 100000 + F.col("k")).alias("id"), "text")
    return sp.line_fragments(lines, 3000, 25, 5, "id").select("id", F.md5("fragment").alias("h"), "copy")


@query("train_val_split", f"""
    SELECT o_orderkey, CASE WHEN r <= CAST(floor(n * 0.1) AS BIGINT) THEN 'val' ELSE 'train' END AS split FROM (
      SELECT o_orderkey, row_number() OVER (ORDER BY {h('o_orderkey', 42)}, o_orderkey) AS r, count(*) OVER () AS n FROM orders)""")
def train_val_split(tb: Tables):
    return sp.train_val_split(tb.read("orders"), 0.1, 42, "o_orderkey").select("o_orderkey", "split")


@query("split_complement", f"""
    SELECT c_custkey FROM (SELECT c_custkey, row_number() OVER (ORDER BY {h('c_custkey', 42)}, c_custkey) AS r FROM customer) WHERE r > 100""")
def split_complement(tb: Tables):
    rows = tb.read("customer")
    return sp.split_complement(rows, sp.sample_exact(rows, 100, 42, "c_custkey"), "c_custkey").select("c_custkey")


@query("mix_union", sql("""SELECT item_id AS id, NULL AS task_type, md5(text) AS h FROM benchmark UNION ALL SELECT id, task_type, md5(document) FROM samples""", "samples"))
def mix_union(tb: Tables):
    general = tb.read("benchmark").select(F.col("item_id").alias("id"), F.md5("text").alias("h"))
    return sp.mix_union(general, tb.samples.select("id", "task_type", F.md5("document").alias("h"))).select("id", "task_type", "h")


MIX = {
    "sz": "SELECT (SELECT count(*) FROM benchmark) AS ng, (SELECT count(*) FROM documents) AS nd",
    "q": "SELECT ng, CAST(floor((ng + nd) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS gen, ng + nd - CAST(floor((ng + nd) * CAST(0.7 AS DOUBLE)) AS BIGINT) AS doc FROM sz",
    "w": "SELECT unnest(['qa', 'json_extraction', 'summary', 'table_qa', 'layout_understanding']) AS task_type, unnest([0.35::DOUBLE, 0.25, 0.2, 0.1, 0.1]) AS w",
    "rk": f"SELECT id, task_type, row_number() OVER (PARTITION BY task_type ORDER BY {h('id', 42)}, id) AS r, count(*) OVER (PARTITION BY task_type) AS n FROM samples",
    "quota": "SELECT task_type, CAST(floor(doc * w) AS BIGINT) AS k FROM w, q",
}


@query("mix_datasets", sql(f"""
    SELECT 'general' AS source, id, NULL AS task_type, unnest(range(0, (gen - r) // ng + 1)) AS copy FROM (
      SELECT item_id AS id, row_number() OVER (ORDER BY {h('item_id', 42)}, item_id) AS r FROM benchmark), q WHERE r <= gen
    UNION ALL SELECT 'doc', id, rk.task_type, unnest(range(0, (k - r) // n + 1)) FROM rk JOIN quota ON rk.task_type = quota.task_type WHERE r <= k
    UNION ALL SELECT 'fill', rk.id, 'qa', -1 - i FROM (SELECT i, {num('i', 'fill42')} % (SELECT count(*) FROM rk WHERE task_type = 'qa') + 1 AS r
      FROM (SELECT unnest(range(0, (SELECT doc FROM q) - (SELECT sum(k)::BIGINT FROM quota))) AS i)) f JOIN rk ON rk.r = f.r AND rk.task_type = 'qa'""", "samples", **MIX))
def mix_datasets(tb: Tables):
    general = tb.read("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("prompt"))
    return sp.mix_datasets(general, tb.samples).select("source", "id", "task_type", "copy")


LEVEL = "CASE WHEN length(answer) > 100 THEN 'high' WHEN length(answer) > 50 THEN 'medium' ELSE 'low' END"
HINT = f"CASE level WHEN 'high' THEN ' {pr.HINTS['high']}' WHEN 'medium' THEN ' {pr.HINTS['medium']}' ELSE '' END"
LEVELS = {"lv": f"SELECT *, {LEVEL} AS level FROM samples"}


def leveled(tb: Tables):
    return tb.samples.withColumn("level", pr.reasoning_level(F.col("answer")))


PROMPT_SQL = f"'{pr.CONTEXT} ' || left(task_type, 2) || ' {pr.DOCUMENT} ' || document || ' {pr.QUESTION} ' || question || {HINT}"


@query("format_prompt", sql(f"SELECT id, md5({PROMPT_SQL}) AS h FROM lv", "samples", **LEVELS))
def format_prompt(tb: Tables):
    p = pr.format_prompt(F.col("document"), F.col("question"), F.col("level"), F.substring("task_type", 1, 2))
    return leveled(tb).select("id", F.md5(p).alias("h"))


@query("format_response", sql(f"""
    SELECT id, md5(CASE level WHEN 'high' THEN answer || chr(10) || '(確信度: ' || printf('%.2f', id % 100 / 100.0::DOUBLE) || ')'
           WHEN 'medium' THEN answer || CASE WHEN regexp_matches(answer, '{pr.REASON_WORDS}') THEN '' ELSE '。' END ELSE {sql_strip('answer')} END) AS h FROM lv""", "samples", **LEVELS))
def format_response(tb: Tables):
    r = pr.format_response(F.col("answer"), F.col("level"), F.col("id") % 100 / 100.0)
    return leveled(tb).select("id", F.md5(r).alias("h"))


@query("parse_prompt", sql(f"""
    SELECT id, md5({sql_strip('document')}) AS document, question || {HINT} AS question, left(task_type, 2) AS context, level FROM lv""", "samples", **LEVELS))
def parse_prompt(tb: Tables):
    p = pr.parse_prompt(pr.format_prompt(F.col("document"), F.col("question"), F.col("level"), F.substring("task_type", 1, 2)))
    return leveled(tb).withColumn("p", p).select("id", F.md5("p.document").alias("document"), "p.question", "p.context", "p.level")


@query("reasoning_level", sql(f"SELECT id, {LEVEL} AS level, 'low' AS by_question FROM samples", "samples"))
def reasoning_level(tb: Tables):
    return leveled(tb).select("id", "level", pr.question_level(F.col("question")).alias("by_question"))


@query("inject_na", sql(f"""
    SELECT id, is_na, md5(CASE WHEN is_na = 1 THEN document || ' ' || ['{"', '".join(pr.NA_NOTICES)}'][{num('id', 'nb42')} % 3 + 1] ELSE document END) AS h,
           CASE WHEN is_na = 1 THEN 'N/A' ELSE answer END AS answer FROM (SELECT *, CASE WHEN {num('id', 'na42')} < 1073741824 THEN 1 ELSE 0 END AS is_na FROM samples)""", "samples"))
def inject_na(tb: Tables):
    return pr.inject_na(tb.samples, 0.25, 42, "id").select("id", "is_na", F.md5("document").alias("h"), "answer")


@query("task_prompts", sql(f"""
    SELECT id, md5(CASE task_type WHEN 'json_extraction' THEN '{pr.DOCUMENT} ' || document || ' {pr.QUESTION} {pr.EXTRACT}' || '{{' || chr(10) || '  "name": "string",' || chr(10) || '  "total": "number"' || chr(10) || '}}'
      WHEN 'summary' THEN '{pr.DOCUMENT} ' || document || ' {pr.QUESTION} {pr.SUMMARISE}（' || (50 + id % 50) || '{pr.CHAR_LIMIT}{pr.FOCUS_A}a、b{pr.FOCUS_B} {pr.HINTS['medium']}'
      WHEN 'table_qa' THEN '{pr.DOCUMENT} x | y {pr.QUESTION} ' || question
      WHEN 'layout_understanding' THEN '{pr.DOCUMENT} {pr.LAYOUT_TITLE}T' || id || chr(10) || '{pr.LAYOUT_SECTION}1: one' || chr(10) || '{pr.LAYOUT_SECTION}2: {pr.LAYOUT_UNTITLED}' || chr(10) || '{pr.LAYOUT_TABLES}' || (id % 4) || ' {pr.QUESTION} ' || question || ' {pr.HINTS['medium']}'
      ELSE '{pr.DOCUMENT} ' || document || ' {pr.QUESTION} ' || question || {HINT} END) AS prompt,
      md5(CASE task_type WHEN 'json_extraction' THEN '{{}}' WHEN 'summary' THEN answer || CASE WHEN regexp_matches(answer, '{pr.REASON_WORDS}') THEN '' ELSE '。' END
      WHEN 'table_qa' THEN answer WHEN 'layout_understanding' THEN answer ELSE CASE level WHEN 'high' THEN answer
      WHEN 'medium' THEN answer || CASE WHEN regexp_matches(answer, '{pr.REASON_WORDS}') THEN '' ELSE '。' END ELSE {sql_strip('answer')} END END) AS response FROM lv""", "samples", **LEVELS))
def task_prompts(tb: Tables):
    rows = tb.samples.select(
        "*", F.create_map(*map(F.lit, ("name", "string", "total", "number"))).alias("schema"), F.lit("{}").alias("extracted"),
        F.col("answer").alias("summary"), (50 + F.col("id") % 50).alias("max_length"), F.array(F.lit("a"), F.lit("b")).alias("focus"),
        F.lit("x | y").alias("table_text"),
        F.struct(F.concat(F.lit("T"), F.col("id").cast("string")).alias("title"), F.array(F.lit("one"), F.lit(None).cast("string")).alias("sections"),
                 (F.col("id") % 4).alias("tables"), F.lit(None).cast("int").alias("figures")).alias("layout"))
    return pr.task_prompts(rows).select("id", F.md5("prompt").alias("prompt"), F.md5("response").alias("response"))


@query("choice_prompt", f"""
    SELECT conv_id, turn, md5('{pr.DOCUMENT} ' || text || ' {pr.QUESTION} ' || role || '{pr.CHOICES}1. ' || role || chr(10) || '2. none') AS h,
           md5('{pr.DOCUMENT} ' || text || ' {pr.QUESTION} {pr.FIELDS}role: string') AS f FROM conversations""")
def choice_prompt(tb: Tables):
    c = pr.choice_prompt(F.col("text"), F.col("role"), F.array("role", F.lit("none")))
    f = pr.fields_prompt(F.col("text"), F.create_map(F.lit("role"), F.lit("string")))
    return tb.read("conversations").select("conv_id", "turn", F.md5(c).alias("h"), F.md5(f).alias("f"))


@query("layout_to_text", f"""
    SELECT page_id, CASE page_id % 3 WHEN 0 THEN '{pr.LAYOUT_EMPTY}' WHEN 1 THEN '{pr.LAYOUT_TITLE}' || url ELSE '{pr.LAYOUT_SECTION}1: ' || url || chr(10) || '{pr.LAYOUT_FIGURES}' || page_id END AS s FROM pages""")
def layout_to_text(tb: Tables):
    k = F.col("page_id") % 3
    none = F.lit(None).cast("string")
    layout = F.struct(F.when(k == 1, F.col("url")).otherwise(none).alias("title"), F.when(k == 2, F.array("url")).alias("sections"),
                      none.alias("tables"), F.when(k == 2, F.col("page_id")).alias("figures"))
    return tb.read("pages").withColumn("layout", layout).select("page_id", pr.layout_to_text(F.col("layout")).alias("s"))


@query("sft_text", sql(f"""
    SELECT id, md5(document || chr(10) || answer) AS plain, md5('<|im_start|>system' || chr(10) || '{pr.CHAT_SYSTEM}' || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>user' || chr(10) || question || chr(10) || chr(10)
           || 'Document:' || chr(10) || document || chr(10) || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || answer || '<|im_end|>') AS chat FROM samples""", "samples"))
def sft_text(tb: Tables):
    c = F.col
    return tb.samples.select("id", F.md5(pr.sft_text(c("document"), c("answer"))).alias("plain"),
                             F.md5(pr.sft_chat(c("question"), c("document"), c("answer"))).alias("chat"))


@query("chat_prompt", """
    SELECT c.conv_id, md5(coalesce('[System]' || chr(10) || s.sys || chr(10) || chr(10), '') || coalesce(string_agg(upper(role[1]) || lower(role[2:]) || ': ' || text, chr(10) ORDER BY turn)
           FILTER (WHERE role <> 'system'), '') || chr(10) || 'Assistant:') AS h
    FROM conversations c LEFT JOIN (SELECT conv_id, arg_max(text, turn) AS sys FROM conversations WHERE role = 'system' GROUP BY conv_id HAVING arg_max(text, turn) <> '') s ON s.conv_id = c.conv_id
    GROUP BY c.conv_id, s.sys""")
def chat_prompt(tb: Tables):
    return pr.chat_prompt(tb.read("conversations"), "conv_id", "turn").select("conv_id", F.md5("prompt").alias("h"))


@query("language_suffix", f"""
    SELECT doc_id, md5(text || CASE WHEN lang = 'en' THEN chr(10) || chr(10) || CASE doc_id % 3 WHEN 0 THEN '{pr.SUFFIXES['en', 'summary']}' WHEN 1 THEN '{pr.SUFFIXES['en', 'qa']}' ELSE '{pr.SUFFIXES['en', 'json']}' END ELSE '' END) AS h
    FROM documents""")
def language_suffix(tb: Tables):
    task = F.get(F.array(*map(F.lit, ("summary", "qa", "json"))), (F.col("doc_id") % 3).cast("int"))
    return tb.read("documents").select("doc_id", F.md5(pr.language_suffix(F.col("text"), task, F.col("lang"))).alias("h"))


@query("char_tokens", """
    SELECT item_id, array_to_string(list_transform(string_split(left(text, 512), ''), lambda c: unicode(c)), ',') || repeat(',0', 512 - length(left(text, 512))) AS ids,
           length(left(text, 512)) AS n FROM benchmark""")
def char_tokens(tb: Tables):
    ids = t.char_tokens(F.col("text"), 512)
    return tb.read("benchmark").select("item_id", F.array_join(ids.cast("array<string>"), ",").alias("ids"), F.size(F.filter(ids, lambda i: i > 0)).alias("n"))


@query("flatten_boxes", sql("""
    SELECT page // 16 AS doc, string_agg(label, ',' ORDER BY page, idx) AS labels, md5(string_agg(x1 || '-' || y2, ',' ORDER BY page, idx)) AS boxes, count(*) AS n
    FROM boxes GROUP BY page // 16""", "boxes"))
def flatten_boxes(tb: Tables):
    rows = tb.boxes.withColumn("doc", F.expr("page div 16")).withColumn("text", F.col("label"))
    out = pr.flatten_boxes(rows, "doc", "page", "idx")
    both = F.transform("boxes", lambda b: F.concat(b[0].cast("string"), F.lit("-"), b[3].cast("string")))
    return out.select("doc", F.array_join("labels", ",").alias("labels"), F.md5(F.array_join(both, ",")).alias("boxes"), F.size("texts").alias("n"))
