"""Text, date and JSON expressions. Only NFKC needs Python; all else stays in the JVM."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from foliospark.functions.sequences import text_distance

# White space as Python's str.split() sees it.
WS = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}]"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def collapse(c: Column) -> Column:
    return strip(F.regexp_replace(c, f"{WS}+", " "))


def chars(c: Column) -> Column:
    """Array of characters; empty for the empty string."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def words(c: Column) -> Column:
    return F.filter(F.split(c, f"{WS}+"), lambda x: x != "")


def normalize_label(c: Column, max_len: int = 0) -> Column:
    text = collapse(nfkc(c))
    return F.substring(text, 1, max_len) if max_len > 0 else text


# --- fixed values: confusable characters and half-width punctuation of OCR output
CONFUSED_FROM = "０１２３４５６７８９ｌОо"
CONFUSED_TO = "0123456789100"
PUNCT_FROM = "､｡｢｣･ｰ"
PUNCT_TO = "、。「」・ー"


def fix_confusables(c: Column) -> Column:
    return F.translate(F.translate(c, CONFUSED_FROM, CONFUSED_TO), PUNCT_FROM, PUNCT_TO)


def squeeze_repeats(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)(.)\1+", "$1")


def clean_ocr_text(c: Column, dedup: bool = False, normalize: bool = True) -> Column:
    text = fix_confusables(collapse(nfkc(c) if normalize else c))
    return strip(squeeze_repeats(text) if dedup else text)


def normalize_answer(c: Column) -> Column:
    text = F.regexp_replace(F.lower(c), f"[。、！？]|{WS}", "")
    return F.translate(text, "０１２３４５６７８９", "0123456789")


def normalize_qa(c: Column) -> Column:
    return F.regexp_replace(F.lower(strip(F.coalesce(c, F.lit("")))), f"{WS}+", " ")


def normalize_value(c: Column) -> Column:
    return F.lower(F.regexp_replace(collapse(c), "^[\"']+|[\"']+$", ""))


def normalize_date(c: Column) -> Column:
    pattern = r"(\d{4})[-/年](\d{1,2})[-/月](\d{1,2})"
    parts = [F.regexp_extract(c, pattern, i) for i in (1, 2, 3)]
    iso = F.concat_ws("-", parts[0], F.lpad(parts[1], 2, "0"), F.lpad(parts[2], 2, "0"))
    return F.when(c.rlike(pattern), iso).otherwise(c)


def is_iso_date(c: Column) -> Column:
    return c.rlike(r"^\d{4}-\d{2}-\d{2}$")


# --- fixed values: answers that mean "not available"
NA_PATTERNS = ("n/a", "na", "該当なし", "なし", "不明", "記載なし", "情報がありません", "見つかりません", "確認できません")
NA_ANSWERS = ("n/a", "na", "該当なし", "なし")


def is_na_answer(c: Column, strict: bool = False) -> Column:
    """A predicted answer means N/A. `strict` wants the two Latin forms as whole words."""
    text = F.lower(c)
    if strict:
        latin, rest = NA_PATTERNS[:2], NA_PATTERNS[2:]
        return text.rlike(r"(^|[^a-z0-9])(" + "|".join(latin) + r")([^a-z0-9]|$)") | text.rlike("|".join(rest))
    return text.rlike("|".join(NA_PATTERNS))


def is_na_reference(c: Column) -> Column:
    return F.lower(c).isin(*NA_ANSWERS)


# --- fixed values: prefixes of a generated answer
ANSWER_PREFIXES = ("答え:", "回答:", "A:", "Answer:")


def clean_answer(c: Column) -> Column:
    text = c
    for prefix in ANSWER_PREFIXES:
        text = F.when(text.startswith(prefix), strip(F.substring(text, len(prefix) + 1, 2**31 - 1))).otherwise(text)
    return strip(F.substring_index(text, "。", 1))


# --- fixed values: date spellings and range separators of schedule charts
DATE_YMD = r"(\d{4})[./-](\d{1,2})[./-](\d{1,2})"
DATE_MD = r"(\d{1,2})[./-](\d{1,2})"
DATE_JA = r"(\d{1,2})月(\d{1,2})日"
RANGE_SEPARATORS = ("~", "〜", "―", "ｰ", "-", "–", "to", "→")


def _day(year: Column, month: Column, day: Column) -> Column:
    iso = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(year.cast("int") >= 1, F.try_to_date(iso, "yyyy-MM-dd"))


def parse_date(c: Column, default_year: int) -> Column:
    """First spelling that matches decides; an impossible day gives null."""
    year = F.lit(str(default_year))

    def part(pattern: str, i: int) -> Column:
        return F.regexp_extract(c, pattern, i)

    return (
        F.when(c.rlike(DATE_YMD), _day(part(DATE_YMD, 1), part(DATE_YMD, 2), part(DATE_YMD, 3)))
        .when(c.rlike(DATE_MD), _day(year, part(DATE_MD, 1), part(DATE_MD, 2)))
        .when(c.rlike(DATE_JA), _day(year, part(DATE_JA, 1), part(DATE_JA, 2)))
    )


def _range_pattern() -> str:
    plain = [p.replace("(", "").replace(")", "") for p in (DATE_YMD, DATE_MD, DATE_JA)]
    one = "(" + "|".join(plain) + ")"
    return f"(?s){one}.*?(?:{'|'.join(RANGE_SEPARATORS)}).*?{one}"


RANGE_PATTERN = _range_pattern()


def parse_date_range(c: Column, default_year: int) -> Column:
    """struct(start, end), null unless two dates stand around a separator. Dates are matched before separators."""
    start = parse_date(F.regexp_extract(c, RANGE_PATTERN, 1), default_year)
    end = parse_date(F.regexp_extract(c, RANGE_PATTERN, 2), default_year)
    return F.when(start.isNotNull() & end.isNotNull(), F.struct(start.alias("start"), end.alias("end")))


def strip_tags(c: Column) -> Column:
    text = F.regexp_replace(c, r"<[^>]*>", " ")
    return strip(F.regexp_replace(F.regexp_replace(text, r"(?s)<.*$", ""), ">", " "))


def count_of(c: Column, piece: str) -> Column:
    """Non-overlapping occurrences of a fixed piece."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(piece), F.lit("")))) / len(piece)).cast("int")


def table_signature(c: Column) -> Column:
    rows = F.split(F.lower(c), "<tr")
    rows = F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0)))

    def row_code(part: Column) -> Column:
        row = F.substring_index(part, "</tr>", 1)
        return F.concat(count_of(row, "<th").cast("string"), F.lit("h"), count_of(row, "<td").cast("string"), F.lit("d"))

    return F.array_join(F.transform(rows, row_code), "|")


def html_shape(c: Column) -> Column:
    text = F.coalesce(c, F.lit(""))
    rows = F.regexp_count(text, F.lit(r"(?i)<tr\b"))
    cells = F.regexp_count(text, F.lit(r"(?i)<t[dh]\b"))
    cols = F.when(rows > 0, (cells / rows).cast("int")).otherwise(F.lit(0))
    return F.struct(rows.alias("rows"), cols.alias("cols"))


def escape_md(c: Column) -> Column:
    return F.regexp_replace(c, r"([`*{}\[\]()#+!~|-])", r"\\$1")


def escape_html(c: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(entity))
    return c


def to_full_width(c: Column) -> Column:
    """Half-width ASCII and kana to full width; kana with sound marks are joined first."""
    kana = [chr(i) for i in range(0xFF61, 0xFFA0)]
    for base in kana:
        for mark in ("ﾞ", "ﾟ"):
            joined = unicodedata.normalize("NFKC", base + mark)
            if len(joined) == 1:
                c = F.replace(c, F.lit(base + mark), F.lit(joined))
    ascii_from = "".join(chr(i) for i in range(0x21, 0x7F))
    ascii_to = "".join(chr(i + 0xFEE0) for i in range(0x21, 0x7F))
    marks = {"ﾞ": "゛", "ﾟ": "゜"}
    kana_to = "".join(marks.get(k, unicodedata.normalize("NFKC", k)) for k in kana)
    return F.translate(c, ascii_from + "".join(kana) + " ¥·", ascii_to + kana_to + "　￥・")


def coerce_json(c: Column) -> Column:
    """Canonical text of the JSON in a reply: the whole reply, else from the first { to the last }."""
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.coalesce(F.to_json(F.try_parse_json(c)), F.to_json(F.try_parse_json(F.when(inner != "", inner))))


NUMERIC_KINDS = r"^(BIGINT|INT|DOUBLE|FLOAT|DECIMAL.*)$"


def variant_kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def pick_metric(variant: Column, aliases: list[str], depth: int = 2) -> Column:
    """First alias key that holds a number, then the same one level down under `metrics`."""
    tries = []
    for level in range(depth):
        for alias in aliases:
            path = "$" + ".metrics" * level + f"['{alias}']"
            found = F.try_variant_get(variant, path, "variant")
            tries.append(F.when(variant_kind(found).rlike(NUMERIC_KINDS), F.try_variant_get(variant, path, "double")))
    return F.coalesce(*tries)


LONG_TEXT = 64


def edit_distance(a: Column, b: Column, threshold: int | None = None) -> Column:
    """Exact edit distance. With a threshold, -1 beyond it.

    Up to LONG_TEXT characters it stays in the JVM. Two longer texts go through Arrow to a bit-parallel form, which works on the pairs of
    a batch side by side.
    """
    if threshold is not None:
        return F.levenshtein(a, b, threshold)
    is_long = F.least(F.length(a), F.length(b)) > LONG_TEXT
    return F.when(is_long, text_distance(F.when(is_long, a), F.when(is_long, b))).otherwise(F.levenshtein(a, b))


def edit_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - edit_distance(a, b) / longest)


def clean_list_block(c: Column) -> Column:
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")

    def item(line: Column) -> Column:
        return (
            F.when(line.rlike(r"^\d+[\.\)]"), line)
            .when(line.rlike(r"^[•・◦▪▸]"), F.regexp_replace(line, f"^[•・◦▪▸]{WS}*", "- "))
            .otherwise(F.concat(F.lit("- "), line))
        )

    return F.array_join(F.transform(lines, item), "\n")


# Character ids: the four special ids come first, then the charset in order.
PAD, SOS, EOS, UNK, FIRST_CHAR = 0, 1, 2, 3, 4
_PRIVATE = 0xF0000


def encode_label(c: Column, charset: str, max_len: int) -> Column:
    """Fixed-length id array. `translate` hashes the charset once, so a character costs one lookup."""
    private = "".join(chr(_PRIVATE + i) for i in range(len(charset)))
    mapped = F.translate(c, charset, private)

    def to_id(ch: Column) -> Column:
        code = F.ascii(ch)
        return F.when(code >= _PRIVATE, code - _PRIVATE + FIRST_CHAR).otherwise(F.lit(UNK))

    body = F.slice(F.transform(chars(mapped), to_id), 1, max(max_len - 2, 0))
    ids = F.concat(F.array(F.lit(SOS)), body, F.array(F.lit(EOS)))
    return F.concat(ids, F.array_repeat(F.lit(PAD), F.greatest(F.lit(max_len) - F.size(ids), F.lit(0))))


def _until_eos(ids: Column) -> Column:
    at = F.array_position(ids, F.lit(EOS)).cast("int")
    return F.when(at > 0, F.slice(ids, F.lit(1), at - 1)).otherwise(ids)


def decode_ids(ids: Column, charset: str, keep_unknown: bool = False, placeholder: str = "?") -> Column:
    table = F.array(*(F.lit(ch) for ch in charset))
    skipped = [PAD, SOS] + ([] if keep_unknown else [UNK])
    kept = F.filter(_until_eos(ids), lambda i: ~i.isin(skipped))

    def to_char(i: Column) -> Column:
        return F.when(i == UNK, F.lit(placeholder)).otherwise(F.coalesce(F.get(table, i - FIRST_CHAR), F.lit("")))

    return F.array_join(F.transform(kept, to_char), "")


def decode_confidence(ids: Column, confs: Column, keep_unknown: bool = False) -> Column:
    skipped = [PAD, SOS] + ([] if keep_unknown else [UNK])
    pairs = F.arrays_zip(_until_eos(ids).alias("i"), F.slice(confs, F.lit(1), F.size(_until_eos(ids))).alias("c"))
    kept = F.transform(F.filter(pairs, lambda p: ~p["i"].isin(skipped)), lambda p: p["c"])
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x)
    return F.when(F.size(kept) > 0, total / F.size(kept)).otherwise(F.lit(0.0))


def char_tokens(c: Column, width: int) -> Column:
    ids = F.transform(F.slice(chars(c), 1, width), F.ascii)
    return F.concat(ids, F.array_repeat(F.lit(0), width - F.size(ids)))


def validate_extraction(response: Column, schema: Column, mode: str = "flat") -> Column:
    """Errors of a JSON reply against a map(key -> type), joined by '; '; empty when valid.

    `flat` judges the first innermost object (else the whole reply); `whole` the text from the first { to the last }.
    """
    parsed = parsed_reply(response, mode)

    def check(entry: Column) -> Column:
        key, kind = entry["key"], entry["value"]
        value = F.element_at(parsed, key)
        found = variant_kind(value)
        text = F.try_variant_get(value, "$", "string")
        field = lambda tail: F.concat(F.lit("Field "), key, F.lit(tail))
        return (
            F.when(~F.map_contains_key(parsed, key), F.concat(F.lit("Missing required field: "), key))
            .when((kind == "string") & (found != "STRING"), field(" should be string"))
            .when((kind == "number") & ~found.rlike(NUMERIC_KINDS) & (found != "BOOLEAN"), field(" should be number"))
            .when(
                (kind == "date") & ~((found == "STRING") & is_iso_date(text)),
                field(" should be date format (YYYY-MM-DD)"),
            )
        )

    errors = F.filter(F.transform(F.map_entries(schema), check), lambda e: e.isNotNull())
    return F.when(parsed.isNull(), F.lit("JSON parse error")).otherwise(F.array_join(errors, "; "))


def parsed_reply(response: Column, mode: str = "flat") -> Column:
    pattern = r"(\{[^{}]*\})" if mode == "flat" else r"(?s)(\{.*\})"
    inner = F.regexp_extract(response, pattern, 1)
    body = F.when(inner != "", inner).otherwise(response)
    body = F.when(F.try_parse_json(body).isNotNull(), body)
    return F.from_json(body, "map<string,variant>")
