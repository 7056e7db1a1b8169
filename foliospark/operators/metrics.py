"""Evaluation: text, tables, question answering, extraction, summaries, runs and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.functions import text as t
from foliospark.functions.sequences import lcs_length, shared_tokens, token_distance
from foliospark.operators.scan import ranked, spread, tiles, value_at_ranks


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0.0 where b is zero."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def f_score(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))


# ---- recognised text ------------------------------------------------------------------------------------------

def cer_of(ref: Column, hyp: Column) -> Column:
    size = F.length(ref)
    return F.when(size == 0, F.when(F.length(hyp) == 0, 0.0).otherwise(1.0)).otherwise(t.edit_distance(ref, hyp) / size)


def cer(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean character error rate over pairs, and the same weighted by length."""
    scored = pairs.withColumn("_d", t.edit_distance(F.col("ref"), F.col("hyp"))).withColumn("_n", F.length("ref"))
    empty = F.when(F.length("hyp") == 0, 0.0).otherwise(1.0)
    one = F.when(F.col("_n") == 0, empty).otherwise(F.col("_d") / F.col("_n"))
    return scored.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("pairs"), F.avg(one).alias("cer"), ratio(F.sum("_d"), F.sum("_n")).alias("cer_micro")
    )


def wer(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean word error rate after punctuation is removed."""
    def tokens(c: str) -> Column:
        return t.words(F.regexp_replace(F.lower(c), r"[\p{P}\p{S}]", ""))

    scored = pairs.withColumn("_r", tokens("ref")).withColumn("_h", tokens("hyp"))
    scored = scored.withColumn("_d", token_distance("_r", "_h")).withColumn("_n", F.size("_r"))
    empty = F.when(F.size("_h") == 0, 0.0).otherwise(1.0)
    one = F.when(F.col("_n") == 0, empty).otherwise(F.col("_d") / F.col("_n"))
    return scored.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("pairs"), F.avg(one).alias("wer"))


def prediction_stats(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    return pairs.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.length("hyp")).alias("avg_len"),
        F.avg((F.length("hyp") == 0).cast("int")).alias("empty_ratio"),
        F.avg(cer_of(F.col("ref"), F.col("hyp"))).alias("cer"),
    )


def charset(labels: DataFrame, max_chars: int, text: str = "text") -> DataFrame:
    """Characters by frequency (ties by code point), cut at `max_chars`, then white space seen but cut off.

    Counts are combined within each input partition before the shuffle; the ranked table is the alphabet, at most the
    Unicode code points.
    """
    from pyspark.sql import Window

    each = labels.select(F.explode(F.split(F.col(text), "")).alias("ch")).filter("ch <> ''")
    counts = each.groupBy("ch").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), F.ascii("ch")))
    placed = counts.withColumn("rank", rank)
    space = F.col("ch").isin(" ", "​", "　")
    return placed.filter((F.col("rank") <= max_chars) | space)


def charset_audit(lines: DataFrame, text: str = "line") -> DataFrame:
    """Totals over the lines of a charset file; blank and # lines do not count."""
    kept = lines.filter((F.col(text) != "") & ~F.col(text).startswith("#"))
    counts = kept.groupBy(text).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(
        F.sum("n").alias("total"), F.sum((F.col("n") > 1).cast("int")).alias("duplicates"),
        F.sum(F.when(F.length(text) != 1, F.col("n")).otherwise(0)).alias("multi"),
    )


# ---- tables ---------------------------------------------------------------------------------------------------

def teds_like(gt: Column, pred: Column, w: float = 0.5) -> Column:
    w = max(0.0, min(1.0, w))
    structure = t.edit_similarity(t.table_signature(gt), t.table_signature(pred))
    content = t.edit_similarity(t.strip_tags(gt), t.strip_tags(pred))
    return w * structure + (1 - w) * content


def table_shape_score(pred: DataFrame, gt: DataFrame, key: str, pos: str) -> DataFrame:
    """Mean row ratio times column ratio over the tables of a document, paired by position."""
    def shaped(df: DataFrame, side: str) -> DataFrame:
        shape = t.html_shape(F.col("html"))
        df = ranked(df, [key], [pos], tiles(F.col(pos), 1024), "_k")
        return df.select(key, "_k", shape["rows"].alias(f"{side}r"), shape["cols"].alias(f"{side}c"))

    pairs = shaped(pred, "p").join(shaped(gt, "g"), [key, "_k"])

    def side(a: str, b: str) -> Column:
        return F.least(a, b) / F.greatest(a, b)

    none = (F.greatest("pr", "gr") == 0) | (F.greatest("pc", "gc") == 0)
    score = F.when(none, 0.0).otherwise(side("pr", "gr") * side("pc", "gc"))
    return pairs.groupBy(key).agg(F.round(F.avg(score) + 1e-9, 4).alias("score"))


# ---- question answering ---------------------------------------------------------------------------------------

def char_f1(pred: Column, ref: Column) -> Column:
    """F1 over character multisets of normalised answers; characters are counted inside the row."""
    def count(s: Column, ch: Column) -> Column:
        return F.length(s) - F.length(F.replace(s, ch, F.lit("")))

    def score(pair: Column) -> Column:
        p, r = pair["p"], pair["r"]
        common = F.aggregate(
            F.array_distinct(t.chars(p)), F.lit(0), lambda acc, ch: acc + F.least(count(p, ch), count(r, ch))
        )
        none = (F.length(p) == 0) | (F.length(r) == 0)
        return F.when(none, 0.0).otherwise(2 * common / (F.length(p) + F.length(r)))

    # A one-element array binds the normalised texts, which the inner steps would compute anew for every character.
    pair = F.struct(t.normalize_answer(pred).alias("p"), t.normalize_answer(ref).alias("r"))
    return F.get(F.transform(F.array(pair), score), F.lit(0))


def exact_match(pred: Column, ref: Column) -> Column:
    return (t.normalize_answer(pred) == t.normalize_answer(ref)).cast("double")


def squad_scores(pairs: DataFrame, ids: list[str], by: list[str] | None = None) -> DataFrame:
    """Exact match and character F1 in percent, best reference per prediction."""
    em, f1 = exact_match(F.col("pred"), F.col("ref")), char_f1(F.col("pred"), F.col("ref"))
    best = pairs.groupBy(*(by or []), *ids).agg(F.max(em).alias("em"), F.max(f1).alias("f1"))
    return best.groupBy(*(by or [])).agg(
        (F.avg("em") * 100).alias("exact_match"), (F.avg("f1") * 100).alias("f1"), F.count(F.lit(1)).alias("total")
    )


def multiset_f1(pairs: DataFrame, ids: list[str], pred: Column, ref: Column, both_empty: float = 1.0) -> DataFrame:
    """F1 over two token arrays per row; rows that share their ids share their tokens."""
    sums = multiset_sums(pairs, ids, pred, ref).drop("_rows")
    return pairs.join(sums, ids, "left").withColumn("f1", _f1_of_sums(both_empty)).drop("_c", "_np", "_nr")


def _f1_of_sums(both_empty: float) -> Column:
    c, n_p, n_r = F.col("_c"), F.col("_np"), F.col("_nr")
    return F.when(c.isNull(), both_empty).when(c == 0, 0.0).otherwise(f_score(c / n_p, c / n_r))


def multiset_sums(pairs: DataFrame, ids: list[str], pred: Column, ref: Column, **more: Column) -> DataFrame:
    """One row per ids: its number of rows, shared tokens (_c) and tokens of each side (_np, _nr), null without tokens; `more` are further aggregates.

    Tokens are counted inside their row, and only counts move. Where several rows share their ids, their tokens are exploded and counted
    together, with map-side combining.
    """
    rows = spread(pairs)
    each = rows.withColumn("_s", shared_tokens(pred, ref))
    known = F.first("_s", ignorenulls=True)
    found = each.groupBy(*ids).agg(F.count(F.lit(1)).alias("_rows"), *(known[c].alias(c) for c in ("_c", "_np", "_nr")), *(v.alias(k) for k, v in more.items()))

    def counted(tokens: Column, p: int, r: int) -> Column:
        return F.transform(tokens, lambda x: F.struct(x.alias("_tok"), F.lit(p).alias("_p"), F.lit(r).alias("_r")))

    shared = found.filter("_rows > 1").drop("_c", "_np", "_nr")
    tokens = rows.join(shared.select(*ids), ids, "left_semi").select(*ids, F.explode(F.concat(counted(pred, 1, 0), counted(ref, 0, 1))).alias("_x"))
    counts = tokens.select(*ids, "_x.*").groupBy(*ids, "_tok").agg(F.sum("_p").alias("_p"), F.sum("_r").alias("_r"))
    sums = counts.groupBy(*ids).agg(
        F.sum(F.least("_p", "_r")).alias("_c"), F.sum("_p").alias("_np"), F.sum("_r").alias("_nr")
    )
    return found.filter("_rows = 1").unionByName(shared.join(sums, ids, "left"))


def token_f1(pairs: DataFrame, ids: list[str]) -> DataFrame:
    def tokens(c: str) -> Column:
        return t.words(t.normalize_qa(F.col(c)))

    return multiset_f1(pairs, ids, tokens("pred"), tokens("ref"))


def anls_of(pred: Column, ref: Column) -> Column:
    p, r = t.normalize_qa(pred), t.normalize_qa(ref)
    score = 1.0 - F.least(t.edit_distance(p, r) / F.greatest(F.length(p), F.length(r)), F.lit(1.0))
    none_p, none_r = F.length(p) == 0, F.length(r) == 0
    return F.when(none_p & none_r, 1.0).when(none_p | none_r, 0.0).otherwise(score)


def qa_rollup(answers: DataFrame, ids: list[str], file: str) -> DataFrame:
    """Per file: number of answered questions and mean EM, F1, ANLS (4 decimals); best over several references."""
    rows = answers.filter(F.col("pred").isNotNull() & F.col("ref").isNotNull())
    em = (t.normalize_qa(F.col("pred")) == t.normalize_qa(F.col("ref"))).cast("double")
    tokens = [t.words(t.normalize_qa(F.col(c))) for c in ("pred", "ref")]
    scored = multiset_sums(rows, [*ids, "ref"], *tokens, em=F.max(em), anls=F.max(anls_of(F.col("pred"), F.col("ref"))))
    # as in a join, rows without an id have no tokens
    lost = F.greatest(*(F.col(c).isNull() for c in [*ids, "ref"]))
    scored = scored.withColumn("f1", F.when(lost, 1.0).otherwise(_f1_of_sums(1.0)))
    best = scored.groupBy(*ids).agg(F.max("em").alias("em"), F.max("f1").alias("f1"), F.max("anls").alias("anls"))
    mean = lambda c: F.round(F.avg(c) + 1e-9, 4)
    return best.groupBy(file).agg(
        F.count(F.lit(1)).alias("qa_count"), mean("em").alias("qa_em"), mean("f1").alias("qa_f1"), mean("anls").alias("qa_anls")
    )


def na_detection(preds: DataFrame, strict: bool = False) -> DataFrame:
    p, r = t.is_na_answer(F.col("pred"), strict), t.is_na_reference(F.col("ref"))
    counts = preds.agg(
        F.count_if(p & r).alias("tp"), F.count_if(p & ~r).alias("fp"), F.count_if(~p & ~r).alias("tn"),
        F.count_if(~p & r).alias("fn"),
    )
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.select(
        "tp", "fp", "tn", "fn", (precision * 100).alias("precision"), (recall * 100).alias("recall"),
        (f_score(precision, recall) * 100).alias("f1"), (ratio(tp + tn, tp + fp + tn + fn) * 100).alias("accuracy"),
    )


def scores_by_task(preds: DataFrame, task: str) -> DataFrame:
    """EM and F1 in percent overall (task null) and per task."""
    scored = preds.withColumn("em", exact_match(F.col("pred"), F.col("ref"))).withColumn(
        "f1", char_f1(F.col("pred"), F.col("ref"))
    )
    return scored.rollup(task).agg(
        F.count(F.lit(1)).alias("n"), (F.avg("em") * 100).alias("exact_match"), (F.avg("f1") * 100).alias("f1")
    )


# ---- extraction -----------------------------------------------------------------------------------------------

def key_overlap(expected: Column, extracted: Column) -> Column:
    """struct(precision, recall) over the key sets of two maps."""
    a, b = F.map_keys(expected), F.map_keys(extracted)
    both = F.size(F.array_intersect(a, b))
    return F.struct(ratio(both, F.size(b)).alias("precision"), ratio(both, F.size(a)).alias("recall"))


def _values_match(a: Column, b: Column, kind: Column) -> Column:
    """Two variants mean the same value under a field type."""
    sa, sb = F.try_variant_get(a, "$", "string"), F.try_variant_get(b, "$", "string")
    na, nb = sa.try_cast("double"), sb.try_cast("double")
    return (
        F.when(sa.isNull() | sb.isNull(), sa.isNull() & sb.isNull())
        .when(kind == "number", F.coalesce(F.abs(na - nb) < 0.01, F.lit(False)))
        .when(kind == "date", t.normalize_date(sa) == t.normalize_date(sb))
        .otherwise(t.normalize_value(sa) == t.normalize_value(sb))
    )


def extraction_scores(preds: DataFrame, mode: str = "flat") -> DataFrame:
    """Rates over all rows and qualities over valid rows, overall (schema_type null) and per schema type, in percent.

    Columns: schema_type, response, schema map(key -> type), expected (JSON text).
    """
    got = t.parsed_reply(F.col("response"), mode)
    want = F.from_json("expected", "map<string,variant>")
    rows = preds.withColumn("_got", got).withColumn("_want", want).withColumn(
        "_valid", t.validate_extraction(F.col("response"), F.col("schema"), mode) == ""
    )
    rows = rows.withColumn("_over", key_overlap(F.col("_want"), F.col("_got")))
    common = F.array_intersect(F.map_keys("_want"), F.map_keys("_got"))
    right = F.size(
        F.filter(common, lambda k: _values_match(
            F.element_at("_got", k), F.element_at("_want", k), F.element_at("schema", k)))
    )
    p, r = F.col("_over.precision"), F.col("_over.recall")
    same_maps = F.to_json(F.map_from_entries(F.array_sort(F.transform(F.map_entries("_got"), lambda e: F.struct(
        e["key"].alias("key"), F.to_json(e["value"]).alias("value")))))) == F.to_json(
        F.map_from_entries(F.array_sort(F.transform(F.map_entries("_want"), lambda e: F.struct(
            e["key"].alias("key"), F.to_json(e["value"]).alias("value"))))))
    valid = F.col("_valid")
    scored = rows.select(
        "schema_type", valid.cast("int").alias("valid"), F.when(valid, same_maps.cast("int")).otherwise(0).alias("exact"),
        F.when(valid, p).alias("p"), F.when(valid, r).alias("r"), F.when(valid, f_score(p, r)).alias("f"),
        F.when(valid, ratio(right, F.size(common))).alias("v"),
    )
    pct = lambda c: F.coalesce(F.avg(c) * 100, F.lit(0.0))
    return scored.rollup("schema_type").agg(
        F.count(F.lit(1)).alias("total"), pct("valid").alias("valid_rate"), pct("exact").alias("exact_match_rate"),
        pct("p").alias("field_precision"), pct("r").alias("field_recall"), pct("f").alias("field_f1"),
        pct("v").alias("value_accuracy"),
    )


# ---- summaries ------------------------------------------------------------------------------------------------

def summary_tokens(c: Column, tokenizer: str) -> Column:
    if tokenizer == "ascii":
        return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda x: x != "")
    if tokenizer == "char":
        return t.chars(F.regexp_replace(F.lower(c), f"{t.WS}+", ""))
    raise ValueError(f"unknown tokenizer {tokenizer}")


def ngrams(tokens: Column, n: int) -> Column:
    if n == 1:
        return tokens
    last = F.size(tokens) - n + 1
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, F.lit(n)), "\u0001"))


def rouge_n(pairs: DataFrame, ids: list[str], n: int, tokenizer: str = "ascii") -> DataFrame:
    """ROUGE-n F per row as column f1 (pred against ref)."""
    grams = lambda c: ngrams(summary_tokens(F.col(c), tokenizer), n)
    return multiset_f1(pairs, ids, grams("pred"), grams("ref"), both_empty=0.0)


def rouge_l(pairs: DataFrame, tokenizer: str = "ascii") -> DataFrame:
    """ROUGE-L F per row as column f1."""
    rows = spread(pairs).withColumn("_p", summary_tokens(F.col("pred"), tokenizer)).withColumn(
        "_r", summary_tokens(F.col("ref"), tokenizer)
    )
    rows = rows.withColumn("_lcs", lcs_length("_r", "_p"))
    return rows.withColumn(
        "f1", f_score(ratio(F.col("_lcs"), F.size("_p")), ratio(F.col("_lcs"), F.size("_r")))
    ).drop("_p", "_r", "_lcs")


def length_compliance(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share of summaries within their limit, in percent; null where no row has a limit."""
    ok = F.when(F.col("max_length") > 0, (F.length("pred") <= F.col("max_length")).cast("int"))
    return pairs.groupBy(*(by or [])).agg((F.avg(ok) * 100).alias("compliance"))


def score_distribution(scores: DataFrame, idx: str, kind: str, score: str = "score") -> DataFrame:
    """Best and worst row, range, population deviation and linear percentiles, in percent."""
    picks = {}
    for q in (25, 50, 75):
        at = (F.col("n") - 1) * (q / 100.0)
        picks[f"lo{q}"], picks[f"hi{q}"] = F.floor(at), F.ceil(at)
    ranks = value_at_ranks(scores, [], score, picks, 0.01)
    first_best = F.struct(F.col(score), -F.col(idx))
    ends = scores.agg(
        F.max_by(kind, first_best).alias("best_type"), F.min_by(kind, F.struct(score, idx)).alias("worst_type"),
        (F.min(score) * 100).alias("min"), (F.max(score) * 100).alias("max"), (F.stddev_pop(score) * 100).alias("std"),
    )
    both = ends.withColumn("_k", F.lit(1)).join(ranks.withColumn("_k", F.lit(1)), "_k")

    def percentile(q: int) -> Column:
        at = (F.col("n") - 1) * (q / 100.0)
        lo, hi = F.col(f"lo{q}"), F.col(f"hi{q}")
        return ((lo + (hi - lo) * (at - F.floor(at))) * 100).alias(f"p{q}")

    return both.select("best_type", "worst_type", "min", "max", "std", percentile(25), percentile(50), percentile(75))


# ---- runs -----------------------------------------------------------------------------------------------------

def latency_summary(rows: DataFrame, latency: str = "latency_s", vram: str = "vram_mb") -> DataFrame:
    """Count, median, p95 (0-based index int(0.95 n) - 1) and highest memory, 3 decimals."""
    n = F.col("n")
    picks = {
        "lo": F.floor((n - 1) / 2), "hi": F.ceil((n - 1) / 2),
        "p95": F.greatest(F.lit(0), F.floor(n * 0.95) - 1),
    }
    ranks = value_at_ranks(rows, [], latency, picks, 1.0).withColumn("_k", F.lit(1))
    top = rows.agg(F.max(vram).alias("vram")).withColumn("_k", F.lit(1))
    r3 = lambda c: F.round(c + 1e-9, 3)
    return ranks.join(top, "_k").select(
        n.alias("count"), r3((F.col("lo") + F.col("hi")) / 2).alias("latency_median"), r3(F.col("p95")).alias("latency_p95"),
        r3(F.col("vram")).alias("vram_max"),
    )


def stage_percentiles(timings: DataFrame, keys: list[str], value: str = "ms") -> DataFrame:
    """Nearest-rank p50 and p95 per key; the index rounds half to even."""
    n = F.col("n")
    picks = {f"p{q}": F.bround((n - 1) * (q / 100.0)) for q in (50, 95)}
    return value_at_ranks(timings, keys, value, picks, 64).select(*keys, "n", "p50", "p95")


# --- fixed values: default gates; "max" metrics must not exceed, "min" metrics must reach the threshold
GATES = {
    "cer": ("recognition", "max", 0.90),
    "detection_hmean": ("detection", "min", 0.86),
    "layout_map_50_95": ("layout", "min", 0.72),
    "table_teds": ("table", "min", 0.88),
}


def gate(metrics: DataFrame, run: str, gates: dict[str, tuple[str, str, float]] = GATES) -> DataFrame:
    """Per run pass, fail or skip for each gate, the overall verdict and the reasons. Input: run, metric, value."""
    values = metrics.groupBy(run).agg(
        *(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(f"_{m}") for m in gates)
    )
    results, reasons = [], []
    for m, (name, way, limit) in gates.items():
        v = F.col(f"_{m}")
        bad = (v > limit) if way == "max" else (v < limit)
        results.append(F.when(v.isNull(), "skip").when(bad, "fail").otherwise("pass").alias(name))
        sign = ">" if way == "max" else "<"
        reasons.append(F.when(bad, F.concat(F.lit(f"{m} "), F.format_string("%.4f", v), F.lit(f" {sign} {limit}"))))
    out = values.select(run, *results, F.concat_ws("; ", *reasons).alias("reasons"))
    return out.withColumn("passed", (F.col("reasons") == "").cast("int"))


def gt_coverage(inputs: DataFrame, sidecars: DataFrame, precedence: list[str]) -> DataFrame:
    """How many inputs have ground truth, and of which kind (first kind of the list wins)."""
    rank = F.array_position(F.array(*map(F.lit, precedence)), F.col("kind"))
    first = sidecars.filter(rank > 0).groupBy("stem").agg(F.min_by("kind", rank).alias("kind"))
    rows = inputs.select("stem").join(first, "stem", "left")
    counts = [F.count_if(F.col("kind") == k).alias("n_" + k.strip(".").replace(".", "_")) for k in precedence]
    return rows.agg(
        F.count(F.lit(1)).alias("total"), F.count("kind").alias("with_gt"),
        F.round(ratio(F.count("kind"), F.count(F.lit(1))) + 1e-9, 4).alias("coverage"), *counts,
    )


def best_run(evals: DataFrame, trials: DataFrame) -> DataFrame:
    """The trial with the lowest error over its log (1.0 without a log), with its parameters."""
    lowest = evals.groupBy("trial").agg(F.min("cer").alias("cer"))
    rows = trials.join(lowest, "trial", "left").withColumn("cer", F.coalesce("cer", F.lit(1.0)))
    best = rows.agg(F.min_by(F.struct(*rows.columns), F.struct("cer", "trial")).alias("b"))
    return best.select("b.*")


def batch_cost(prices: DataFrame, pages: DataFrame, in_tokens: int, out_tokens: int, fx: float) -> DataFrame:
    """Cost of all pages per model: tokens at their prices per million plus a fee per page image, in two currencies.

    `pages` is one row with the column `pages`.
    """
    rows = prices.withColumn("_k", F.lit(1)).join(pages.withColumn("_k", F.lit(1)), "_k")
    usd = F.col("pages") * ((in_tokens * F.col("in_price") + out_tokens * F.col("out_price")) / 1e6 + F.col("image_fee"))
    return rows.select("model", usd.alias("usd"), (usd * fx).alias("local"))


def perplexity(losses: DataFrame, order: str, n: int | None = None) -> DataFrame:
    """exp of the token-weighted mean loss; `n` keeps the first rows as an evaluation budget."""
    rows = losses.orderBy(order).limit(n) if n else losses
    mean = F.sum(F.col("loss") * F.col("tokens")) / F.sum("tokens")
    return rows.agg(mean.alias("eval_loss"), F.exp(mean).alias("eval_perplexity"))


def doc_counts(pages: DataFrame, blocks: DataFrame, tables: DataFrame, doc: str = "doc_id") -> DataFrame:
    def number(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(doc).agg(F.count(F.lit(1)).alias(name))

    out = number(pages, "pages").join(number(blocks, "blocks"), doc, "left").join(number(tables, "tables"), doc, "left")
    return out.na.fill(0, ["blocks", "tables"])


def baseline_report(baselines: DataFrame, metrics: DataFrame, sections: dict[str, str]) -> DataFrame:
    """Published rows per section, plus one own row: the mean of the section's metric, or `tbf` without one."""
    own = [F.avg(F.col(c).try_cast("double")).alias(s) for s, c in sections.items()]
    wide = metrics.agg(*own)
    rows = F.explode(F.array(*(F.struct(F.lit(s).alias("section"), F.col(s).alias("v")) for s in sections)))
    mean = wide.select(rows.alias("r")).select(
        "r.section", F.lit("ours").alias("method"),
        F.when(F.col("r.v").isNull(), "tbf").otherwise(F.format_string("%.3f", F.col("r.v") + 1e-9)).alias("score"),
        F.lit("This work").alias("source"),
        F.when(F.col("r.v").isNull(), "no values").otherwise("").alias("reason"),
    )
    return baselines.select("section", "method", "score", "source", F.lit("").alias("reason")).unionByName(mean)


def reading_edge_f1(pred: DataFrame, gt: DataFrame, keys: list[str]) -> DataFrame:
    """Precision, recall and F1 over directed reading-order edges (src, dst)."""
    cols = [*keys, "src", "dst"]
    both = pred.select(*cols).distinct().withColumn("p", F.lit(1)).join(
        gt.select(*cols).distinct().withColumn("g", F.lit(1)), cols, "full"
    )
    n = both.agg(
        F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("tp"), F.count("p").alias("np"), F.count("g").alias("ng")
    )
    p, r = ratio(F.col("tp"), F.col("np")), ratio(F.col("tp"), F.col("ng"))
    return n.select("tp", p.alias("precision"), r.alias("recall"), f_score(p, r).alias("f1"))


def page_direction(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """Vertical when the area of vertical paragraphs is larger; an unknown direction counts as vertical."""
    size = (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))
    flat = F.coalesce(F.col("direction") == "horizontal", F.lit(False))
    h, v = F.sum(F.when(flat, size).otherwise(0)), F.sum(F.when(flat, 0).otherwise(size))
    return paragraphs.groupBy(*keys).agg(F.when(v > h, "vertical").otherwise("horizontal").alias("page_direction"))


def element_direction(matches: DataFrame, keys: list[str]) -> DataFrame:
    flat = F.col("direction") == "horizontal"
    return matches.groupBy(*keys).agg(
        F.when(F.count_if(flat) > F.count_if(~flat), "horizontal").otherwise("vertical").alias("element_direction")
    )
