"""Prompt and response texts of instruction samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.functions import text as t
from foliospark.operators.sampling import hash_number, hash_of
from foliospark.operators.scan import ordered_concat, tiles

# --- fixed values: markers, hints and notices of the prompt format
DOCUMENT, QUESTION, CONTEXT = "[文書]", "[質問]", "[文脈]"
HINTS = {"high": "(詳細な分析と説明を含めて回答してください)", "medium": "(理由も含めて回答してください)"}
HIGH_WORDS, MEDIUM_WORDS = "詳細な分析|説明を含めて", "理由も含めて|なぜ"
REASON_WORDS = "なぜなら|理由は"
WHY_WORDS = "なぜ|理由|説明"
NA_NOTICES = ("（該当する情報は文書に含まれていません）", "（この部分は判読不能です）", "（データが欠損しています）")
EXTRACT = "次のスキーマに従ってJSONで情報を抽出してください:\n"
EXAMPLES = "以下の形式で抽出してください:\n"
CHOICES = "\n選択肢:\n"
SUMMARISE, CHAR_LIMIT, FOCUS_A, FOCUS_B = "この文書を要約してください", "文字以内）", "。特に", "に注目してください"
FIELDS = "次の情報を抽出してください: "
LAYOUT_QUESTION = "このドキュメントのレイアウトを説明してください"
LAYOUT_TITLE, LAYOUT_SECTION, LAYOUT_UNTITLED = "タイトル: ", "セクション", "無題"
LAYOUT_TABLES, LAYOUT_FIGURES, LAYOUT_EMPTY = "表の数: ", "図の数: ", "（レイアウト情報なし）"
SUFFIXES = {
    ("en", "summary"): "Respond in English only. Keep it to one line.",
    ("en", "qa"): "Answer concisely in English only. Output just the answer without explanation.",
    ("en", "json"): "Return only valid JSON. No extra text.",
    ("ja", "summary"): "日本語で一行に要約してください。",
    ("ja", "qa"): "日本語で簡潔に、答えのみを出力してください。",
    ("ja", "json"): "有効なJSONのみを返してください。説明は不要です。",
}
CHAT_SYSTEM = "You are a helpful AI assistant specialized in Japanese document analysis and information extraction."


def _s(text: str) -> Column:
    return F.lit(text)


def format_prompt(document: Column, question: Column, level: Column, context: Column | None = None) -> Column:
    hint = F.when(level == "high", _s(" " + HINTS["high"])).when(level == "medium", _s(" " + HINTS["medium"])).otherwise(_s(""))
    parts = [F.concat(_s(DOCUMENT + " "), document), F.concat(_s(QUESTION + " "), question, hint)]
    if context is not None:
        parts.insert(0, F.when(context != "", F.concat(_s(CONTEXT + " "), context)))
    return F.concat_ws(" ", *parts)


def format_response(answer: Column, level: Column, confidence: Column | None = None) -> Column:
    sure = answer
    if confidence is not None:
        sure = F.when(confidence.isNotNull(), F.concat(answer, _s("\n(確信度: "), F.format_string("%.2f", confidence), _s(")"))).otherwise(answer)
    full = F.when(answer.rlike(REASON_WORDS), answer).otherwise(F.concat(answer, _s("。")))
    return F.when(level == "high", sure).when(level == "medium", full).otherwise(t.strip(answer))


def parse_prompt(prompt: Column) -> Column:
    """struct(document, question, context, level), the inverse of format_prompt."""
    mark = lambda m: m.replace("[", r"\[").replace("]", r"\]")
    part = lambda a, b: t.strip(F.regexp_extract(prompt, rf"(?s){mark(a)}\s*(.+?)\s*{b}", 1))
    question = part(QUESTION, "$")
    level = F.when(question.rlike(HIGH_WORDS), "high").when(question.rlike(MEDIUM_WORDS), "medium").otherwise("low")
    return F.struct(part(DOCUMENT, mark(QUESTION)).alias("document"), question.alias("question"),
                    part(CONTEXT, mark(DOCUMENT)).alias("context"), level.alias("level"))


def reasoning_level(answer: Column) -> Column:
    size = F.length(answer)
    return F.when(size > 100, "high").when(size > 50, "medium").otherwise("low")


def question_level(question: Column) -> Column:
    return F.when(question.rlike(WHY_WORDS), "medium").otherwise("low")


def inject_na(df: DataFrame, rate: float, seed: int, id_col: str) -> DataFrame:
    """With probability `rate` by hash, a notice is put behind the document and the answer becomes N/A (`is_na`)."""
    hit = hash_number(hash_of(F.col(id_col), f"na{seed}")) < int(rate * 2**32)
    notice = F.get(F.array(*map(F.lit, NA_NOTICES)), (hash_number(hash_of(F.col(id_col), f"nb{seed}")) % len(NA_NOTICES)).cast("int"))
    return df.withColumn("is_na", hit.cast("int")).withColumn(
        "document", F.when(hit, F.concat("document", _s(" "), notice)).otherwise(F.col("document"))).withColumn(
        "answer", F.when(hit, _s("N/A")).otherwise(F.col("answer")))


def pretty_object(schema: Column) -> Column:
    """A map(name -> type) as JSON text with an indent of two."""
    def quoted(c: Column) -> Column:
        return F.concat(_s('"'), F.replace(F.replace(c, _s("\\"), _s("\\\\")), _s('"'), _s('\\"')), _s('"'))

    lines = F.transform(F.map_entries(schema), lambda e: F.concat(_s("  "), quoted(e["key"]), _s(": "), quoted(e["value"])))
    return F.when(F.size(lines) == 0, _s("{}")).otherwise(F.concat(_s("{\n"), F.array_join(lines, ",\n"), _s("\n}")))


def extraction_prompt(document: Column, schema: Column, examples: Column | None = None) -> Column:
    parts = [F.concat(_s(DOCUMENT + " "), document)]
    if examples is not None:
        shown = F.array_join(F.transform(F.slice(examples, 1, 3), lambda x, i: F.concat(_s("例"), (i + 1).cast("string"), _s(": "), x)), "\n")
        parts.append(F.when(F.size(examples) > 0, F.concat(_s(CONTEXT + " " + EXAMPLES), shown)))
    parts.append(F.concat(_s(QUESTION + " " + EXTRACT), pretty_object(schema)))
    return F.concat_ws(" ", *parts)


def choice_prompt(document: Column, question: Column, options: Column) -> Column:
    listed = F.array_join(F.transform(options, lambda x, i: F.concat((i + 1).cast("string"), _s(". "), x)), "\n")
    asked = F.when(F.size(options) > 0, F.concat(question, _s(CHOICES), listed)).otherwise(question)
    return format_prompt(document, asked, _s("low"))


def summary_prompt(document: Column, max_length: Column, focus: Column) -> Column:
    limit = F.when(max_length > 0, F.concat(_s("（"), max_length.cast("string"), _s(CHAR_LIMIT))).otherwise(_s(""))
    points = F.when(F.size(focus) > 0, F.concat(_s(FOCUS_A), F.array_join(focus, "、"), _s(FOCUS_B))).otherwise(_s(""))
    asked = F.concat(_s(SUMMARISE), F.coalesce(limit, _s("")), F.coalesce(points, _s("")))
    return format_prompt(document, asked, _s("medium"))


def fields_prompt(document: Column, fields: Column) -> Column:
    listed = F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(e["key"], _s(": "), e["value"])), ", ")
    return format_prompt(document, F.concat(_s(FIELDS), listed), _s("low"))


def layout_to_text(layout: Column) -> Column:
    """struct(title, sections array, tables, figures) in words; missing parts are left out."""
    section = F.array_join(F.transform(layout["sections"], lambda h, i: F.concat(
        _s(LAYOUT_SECTION), (i + 1).cast("string"), _s(": "), F.coalesce(h, _s(LAYOUT_UNTITLED)))), "\n")
    text = F.concat_ws(
        "\n", F.concat(_s(LAYOUT_TITLE), layout["title"]), F.when(F.size(layout["sections"]) > 0, section),
        F.concat(_s(LAYOUT_TABLES), layout["tables"].cast("string")), F.concat(_s(LAYOUT_FIGURES), layout["figures"].cast("string")))
    return F.when(text == "", _s(LAYOUT_EMPTY)).otherwise(text)


def task_prompts(df: DataFrame) -> DataFrame:
    """Prompt and response by task_type. Columns: document, question, answer, schema, extracted, summary, max_length,
    focus, table_text, layout."""
    task, c = F.col("task_type"), F.col
    level = reasoning_level(c("answer"))
    layout = layout_to_text(c("layout"))
    prompt = (
        F.when(task == "json_extraction", extraction_prompt(c("document"), c("schema")))
        .when(task == "summary", summary_prompt(c("document"), c("max_length"), c("focus")))
        .when(task == "table_qa", format_prompt(c("table_text"), c("question"), _s("low")))
        .when(task == "layout_understanding", format_prompt(layout, F.coalesce(c("question"), _s(LAYOUT_QUESTION)), _s("medium")))
        .otherwise(format_prompt(c("document"), c("question"), level)))
    response = (
        F.when(task == "json_extraction", c("extracted")).when(task == "summary", format_response(c("summary"), _s("medium")))
        .when(task == "table_qa", c("answer")).when(task == "layout_understanding", F.coalesce(c("answer"), layout))
        .otherwise(format_response(c("answer"), level)))
    return df.withColumn("prompt", prompt).withColumn("response", response)


def sft_text(prompt: Column, response: Column) -> Column:
    return F.concat(prompt, _s("\n"), response)


def sft_chat(instruction: Column, document: Column, response: Column) -> Column:
    return F.concat(
        _s(f"<|im_start|>system\n{CHAT_SYSTEM}\n<|im_end|>\n<|im_start|>user\n"), instruction, _s("\n\nDocument:\n"), document,
        _s("\n<|im_end|>\n<|im_start|>assistant\n"), response, _s("<|im_end|>"))


def chat_prompt(turns: DataFrame, conv: str, turn: str) -> DataFrame:
    """(conv, prompt): the last system message, then `Role: text` lines, then `Assistant:`."""
    talk = turns.filter("role <> 'system'").withColumn("_line", F.concat(
        F.upper(F.substring("role", 1, 1)), F.lower(F.expr("substring(role, 2)")), _s(": "), "text"))
    lines = ordered_concat(talk, [conv], [turn], "_line", "\n", "_talk", bucket=tiles(F.col(turn), 512))
    system = turns.filter("role = 'system'").groupBy(conv).agg(F.max_by("text", turn).alias("_sys"))
    out = turns.select(conv).distinct().join(lines, conv, "left").join(system, conv, "left")
    head = F.when(F.coalesce("_sys", _s("")) != "", F.concat(_s("[System]\n"), "_sys", _s("\n\n"))).otherwise(_s(""))
    return out.select(conv, F.concat(head, F.coalesce("_talk", _s("")), _s("\nAssistant:")).alias("prompt"))


def language_suffix(prompt: Column, task: Column, lang: Column) -> Column:
    """Prompt with the closing instruction for its task and language, where there is one."""
    pairs = [F.lit(x) for (lg, tk), text in SUFFIXES.items() for x in (f"{lg}/{tk}", text)]
    extra = F.try_element_at(F.create_map(*pairs), F.concat(lang, _s("/"), task))
    return F.when(extra.isNotNull(), F.concat(prompt, _s("\n\n"), extra)).otherwise(prompt)


def flatten_boxes(blocks: DataFrame, doc: str, page: str, pos: str) -> DataFrame:
    """Parallel arrays texts, boxes, labels of a document, in page and block order, gathered in two steps."""
    item = F.struct(page, pos, "text", F.array("x1", "y1", "x2", "y2").alias("box"), "label")
    part = blocks.groupBy(doc, page, tiles(F.col(pos), 512).alias("_b")).agg(F.array_sort(F.collect_list(item)).alias("_i"))
    whole = part.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(page, "_b", "_i"))).alias("_p"))
    items = F.flatten(F.transform("_p", lambda p: p["_i"]))
    field = lambda name: F.transform(items, lambda x: x[name])
    return whole.select(doc, field("text").alias("texts"), field("box").alias("boxes"), field("label").alias("labels"))
