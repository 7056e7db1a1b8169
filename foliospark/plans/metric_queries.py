"""Queries over the metrics: recognition, detection, tables, answers, summaries, runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions import text as t
from foliospark.operators import detection as det, metrics as m
from foliospark.operators.scan import spread
from foliospark.plans.expression_queries import WS2, near
from foliospark.plans.fixtures import Tables, sql
from foliospark.plans.registry import query


def rounded(df, *names):
    """Named columns rounded alike in both engines."""
    return df.select(*(near(F.col(c)).alias(c) if c in names else F.col(c) for c in df.columns))


# ---- recognition ----------------------------------------------------------------------------------------------

@query("cer", sql("""
    SELECT source, count(*) AS pairs, round(avg(levenshtein(eref, ehyp) / length(ref)) + 1e-9, 6) AS cer,
           round(sum(levenshtein(eref, ehyp)) / sum(length(ref)) + 1e-9, 6) AS cer_micro FROM text_pairs GROUP BY source""",
    "codes", "text_pairs"))
def cer(tb: Tables):
    return rounded(m.cer(spread(tb.text_pairs), ["source"]), "cer", "cer_micro")


@query("wer")
def wer(tb: Tables):
    return rounded(m.wer(spread(tb.text_pairs), ["source"]), "wer")


@query("prediction_stats", sql("""
    SELECT source, count(*) AS n, round(avg(length(hyp)) + 1e-9, 6) AS avg_len, 0 AS empty_ratio,
           round(avg(levenshtein(eref, ehyp) / length(ref)) + 1e-9, 6) AS cer FROM text_pairs GROUP BY source""", "codes", "text_pairs"))
def prediction_stats(tb: Tables):
    return rounded(m.prediction_stats(spread(tb.text_pairs), ["source"]), "avg_len", "cer")


@query("charset", sql("""
    SELECT ch, n, row_number() OVER (ORDER BY n DESC, unicode(ch)) AS rank
    FROM (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ch)
    QUALIFY rank <= 8000 OR ch IN (' ', chr(8203), chr(12288))"""))
def charset(tb: Tables):
    return m.charset(tb.read("documents"), 8000)


@query("charset_audit", sql("""
    SELECT sum(n) AS total, sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS duplicates, sum(CASE WHEN length(line) <> 1 THEN n ELSE 0 END) AS multi
    FROM (SELECT line, count(*) AS n FROM (SELECT unnest(string_split(text, ' ')) AS line FROM benchmark)
          WHERE line <> '' AND NOT starts_with(line, '#') GROUP BY line)"""))
def charset_audit(tb: Tables):
    return m.charset_audit(tb.read("benchmark").select(F.explode(F.split("text", " ")).alias("line")))


# ---- detection ------------------------------------------------------------------------------------------------

IOU_PAIRS = """
    SELECT *, w * h / ((px2 - px1) * (py2 - py1) + (x2 - x1) * (y2 - y1) - w * h) AS iou FROM (
      SELECT p.page, p.idx AS p, b.idx AS g, p.label AS plabel, b.label AS glabel, p.score, p.x1 AS px1, p.y1 AS py1, p.x2 AS px2,
             p.y2 AS py2, b.x1, b.y1, b.x2, b.y2, least(p.x2, b.x2) - greatest(p.x1, b.x1) AS w,
             least(p.y2, b.y2) - greatest(p.y1, b.y1) AS h
      FROM preds p JOIN boxes b ON p.page = b.page) WHERE w > 0 AND h > 0"""

GREEDY = {
    "iou_pairs": IOU_PAIRS,
    "choices": """SELECT page, p, list(g ORDER BY iou DESC, g) AS gs FROM iou_pairs WHERE iou >= 0.5 GROUP BY page, p""",
    "queue": "SELECT *, row_number() OVER (PARTITION BY page ORDER BY p) AS k FROM choices",
    "walk": """-- recursive
      SELECT DISTINCT page, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS p, CAST(NULL AS BIGINT) AS g, CAST([] AS BIGINT[]) AS used FROM queue
      UNION ALL
      SELECT page, k, p, g, CASE WHEN g IS NULL THEN used ELSE list_append(used, g) END FROM (
        SELECT q.page, q.k, q.p, w.used, list_filter(q.gs, lambda c: NOT list_contains(w.used, c))[1] AS g
        FROM walk w JOIN queue q ON q.page = w.page AND q.k = w.k + 1)""",
    "matches": "SELECT page, p, g FROM walk WHERE g IS NOT NULL",
}


@query("match_detections", sql("""
    SELECT m.page, m.p, m.g, round(i.iou + 1e-9, 6) AS iou FROM matches m JOIN iou_pairs i ON m.page = i.page AND m.p = i.p AND m.g = i.g""",
    "preds", **GREEDY))
def match_detections(tb: Tables):
    return rounded(det.match_detections(tb.preds, tb.boxes, ["page"]), "iou")


COUNTS = """
    SELECT b.page, coalesce(m.tp, 0) AS tp, coalesce(p.n, 0) - coalesce(m.tp, 0) AS fp, b.n - coalesce(m.tp, 0) AS fn
    FROM (SELECT page, count(*) AS n FROM boxes GROUP BY page) b
    LEFT JOIN (SELECT page, count(*) AS n FROM preds GROUP BY page) p ON b.page = p.page
    LEFT JOIN (SELECT page, count(*) AS tp FROM matches GROUP BY page) m ON b.page = m.page"""


def counts(tb: Tables):
    matches = det.match_detections(tb.preds, tb.boxes, ["page"])
    return det.detection_counts(tb.preds, tb.boxes, tb.boxes, ["page"], matches)


@query("detection_scores", sql("""
    SELECT 'micro' AS level, tp, fp, fn, round(tp / (tp + fp) + 1e-9, 6) AS precision, round(tp / (tp + fn) + 1e-9, 6) AS recall,
           round(2.0 * tp / (2 * tp + fp + fn) + 1e-9, 6) AS f1, round(2.0 * tp / (2 * tp + fp + fn) + 1e-9, 6) AS hmean
    FROM (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM counts)
    UNION ALL SELECT 'page ' || page, tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp) + 1e-9, 6) ELSE 0 END,
           round(tp / (tp + fn) + 1e-9, 6), round(2.0 * tp / (2 * tp + fp + fn) + 1e-9, 6), round(2.0 * tp / (2 * tp + fp + fn) + 1e-9, 6)
    FROM counts""", "preds", **GREEDY, counts=COUNTS))
def detection_scores(tb: Tables):
    c = counts(tb)
    micro = det.detection_scores(c).withColumn("level", F.lit("micro"))
    page = det.detection_scores(c, ["page"]).withColumn("level", F.concat(F.lit("page "), "page")).drop("page")
    return rounded(micro.unionByName(page), "precision", "recall", "f1", "hmean")


AP_SQL = {
    "iou_pairs": IOU_PAIRS,
    "choices": """
      SELECT page, plabel AS label, thr, p, any_value(score) AS score, list(g ORDER BY iou DESC, g) AS gs
      FROM iou_pairs, (SELECT unnest([{thr}]) AS thr) WHERE plabel = glabel AND iou >= thr GROUP BY page, plabel, thr, p""",
    "queue": "SELECT *, row_number() OVER (PARTITION BY page, label, thr ORDER BY score DESC, p) AS k FROM choices",
    "walk": """-- recursive
      SELECT DISTINCT page, label, thr, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS p, CAST(NULL AS BIGINT) AS g, CAST([] AS BIGINT[]) AS used
      FROM queue
      UNION ALL
      SELECT page, label, thr, k, p, g, CASE WHEN g IS NULL THEN used ELSE list_append(used, g) END FROM (
        SELECT q.page, q.label, q.thr, q.k, q.p, w.used, list_filter(q.gs, lambda c: NOT list_contains(w.used, c))[1] AS g
        FROM walk w JOIN queue q ON q.page = w.page AND q.label = w.label AND q.thr = w.thr AND q.k = w.k + 1)""",
    "flags": """
      SELECT p.page, p.label, th.thr, p.idx AS p, p.score, CASE WHEN w.g IS NULL THEN 0 ELSE 1 END AS tp
      FROM preds p CROSS JOIN (SELECT unnest([{thr}]) AS thr) th
      LEFT JOIN walk w ON w.page = p.page AND w.label = p.label AND w.thr = th.thr AND w.p = p.idx""",
    "curve": """
      SELECT f.*, coalesce(n.n_gt, 0) AS n_gt, sum(tp) OVER o AS cum_tp, row_number() OVER o AS rank
      FROM flags f LEFT JOIN (SELECT page, label, count(*) AS n_gt FROM boxes GROUP BY page, label) n
        ON f.page = n.page AND f.label = n.label
      WINDOW o AS (PARTITION BY f.page, f.label, f.thr ORDER BY f.score DESC, f.p ROWS UNBOUNDED PRECEDING)""",
    "pr": """
      SELECT page, label, thr, p, rank, cum_tp, rank - cum_tp AS cum_fp, cum_tp / rank AS precision,
             cum_tp / greatest(n_gt, 1) AS recall FROM curve""",
    "ap": """
      SELECT c.page, c.label, c.thr, coalesce(v.ap, 0) AS ap
      FROM (SELECT page, label, thr FROM (SELECT page, label FROM preds UNION SELECT page, label FROM boxes),
                   (SELECT unnest([{thr}]) AS thr)) c
      LEFT JOIN (SELECT page, label, thr, sum(best) / 11 AS ap FROM (
                   SELECT page, label, thr, t.k, coalesce(max(precision) FILTER (WHERE recall >= t.k * CAST(0.1 AS DOUBLE)), 0) AS best
                   FROM pr, (SELECT unnest(range(0, 11)) AS k) t GROUP BY page, label, thr, t.k) GROUP BY page, label, thr) v
        ON c.page = v.page AND c.label = v.label AND c.thr = v.thr""",
}


def ap_sql(thresholds: list[float], keep: str) -> dict[str, str]:
    listed = ", ".join(f"CAST({x} AS DOUBLE)" for x in thresholds)
    out = {}
    for name, body in AP_SQL.items():
        out[name] = body.replace("{thr}", listed)
        if name == keep:
            break
    return out


THRESHOLDS = [round(0.5 + 0.05 * i, 2) for i in range(10)]


@query("cumulative_pr", sql("""
    SELECT page, label, p, rank, cum_tp, cum_fp, round(precision + 1e-9, 6) AS precision, round(recall + 1e-9, 6) AS recall FROM pr""",
    "preds", **ap_sql([0.5], "pr")))
def cumulative_pr(tb: Tables):
    keys = ["page", "label"]
    matches = det.match_detections(tb.preds, tb.boxes, keys, 0.5, -F.col("score"))
    n_gt = tb.boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_gt"))
    out = det.cumulative_pr(det.match_flags(tb.preds, matches, keys), n_gt, keys)
    return rounded(out.select(*keys, "p", "rank", "cum_tp", "cum_fp", "precision", "recall"), "precision", "recall")


@query("average_precision", sql("""
    SELECT page, label, thr, round(ap + 1e-9, 6) AS ap FROM ap""", "preds", **ap_sql([0.5], "ap")))
def average_precision(tb: Tables):
    return rounded(det.average_precision(tb.preds, tb.boxes, [0.5]), "ap")


@query("map_50_95", sql("""
    SELECT round(avg(m) + 1e-9, 6) AS map_50_95, round(avg(m50) + 1e-9, 6) AS map_50, count(*) AS images FROM (
      SELECT b.page, coalesce(x.m, 0) AS m, coalesce(x.m50, 0) AS m50 FROM (SELECT DISTINCT page FROM boxes) b LEFT JOIN (
        SELECT page, avg(a) AS m, max(a) FILTER (WHERE thr = 0.5) AS m50 FROM (SELECT page, thr, avg(ap) AS a FROM ap
          WHERE page IN (SELECT page FROM preds) GROUP BY page, thr) GROUP BY page) x ON b.page = x.page)""",
    "preds", **ap_sql(THRESHOLDS, "ap")))
def map_50_95(tb: Tables):
    ap = det.average_precision(tb.preds, tb.boxes, THRESHOLDS)
    return rounded(det.map_50_95(ap, tb.preds, tb.boxes), "map_50_95", "map_50")


@query("class_union", sql("SELECT page, label FROM preds UNION SELECT page, label FROM boxes", "preds"))
def class_union(tb: Tables):
    return det.class_union(tb.preds, tb.boxes, ["page", "label"])


NMS_SQL = {
    "queue": "SELECT *, row_number() OVER (PARTITION BY page, label ORDER BY score DESC, idx) AS k FROM boxes",
    "walk": """-- recursive
      SELECT page, label, CAST(1 AS BIGINT) AS k, idx, 1 AS kept, [{'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}] AS acc FROM queue WHERE k = 1
      UNION ALL
      SELECT page, label, k, idx, CASE WHEN hit THEN 0 ELSE 1 END, CASE WHEN hit THEN acc ELSE list_append(acc, me) END FROM (
        SELECT q.page, q.label, q.k, q.idx, w.acc, {'x1': q.x1, 'y1': q.y1, 'x2': q.x2, 'y2': q.y2} AS me,
               len(list_filter(w.acc, lambda b: least(b.x2, q.x2) > greatest(b.x1, q.x1) AND least(b.y2, q.y2) > greatest(b.y1, q.y1)
                 AND (least(b.x2, q.x2) - greatest(b.x1, q.x1)) * (least(b.y2, q.y2) - greatest(b.y1, q.y1)) /
                     ((b.x2 - b.x1) * (b.y2 - b.y1) + (q.x2 - q.x1) * (q.y2 - q.y1)
                      - (least(b.x2, q.x2) - greatest(b.x1, q.x1)) * (least(b.y2, q.y2) - greatest(b.y1, q.y1))) > CAST(0.45 AS DOUBLE))) > 0 AS hit
        FROM walk w JOIN queue q ON q.page = w.page AND q.label = w.label AND q.k = w.k + 1)""",
}


@query("nms", sql("SELECT page, label, idx FROM walk WHERE kept = 1", "boxes", **NMS_SQL))
def nms(tb: Tables):
    return det.nms(tb.boxes, ["page", "label"]).select("page", "label", "idx")


# ---- tables ---------------------------------------------------------------------------------------------------

SIG = """
    SELECT tbl, gt, pred,
      coalesce(array_to_string(list_transform(string_split(gt, '<tr')[2:], lambda p: ((length(p) - length(replace(p, '<th', ''))) // 3) || 'h'
        || ((length(p) - length(replace(p, '<td', ''))) // 3) || 'd'), '|'), '') AS sg,
      coalesce(array_to_string(list_transform(string_split(pred, '<tr')[2:], lambda p: ((length(p) - length(replace(p, '<th', ''))) // 3) || 'h'
        || ((length(p) - length(replace(p, '<td', ''))) // 3) || 'd'), '|'), '') AS sp,
      trim(regexp_replace(gt, '<[^>]*>', ' ', 'g')) AS tg, trim(regexp_replace(pred, '<[^>]*>', ' ', 'g')) AS tp
    FROM html_pairs"""


@query("teds_like", sql("""
    SELECT tbl, round(0.5 * (1 - levenshtein(sg, sp) / greatest(length(sg), length(sp)))
                    + 0.5 * (1 - levenshtein(tg, tp) / greatest(length(tg), length(tp))) + 1e-9, 6) AS teds FROM sig""",
    "html_pairs", sig=SIG))
def teds_like(tb: Tables):
    return tb.html_pairs.select("tbl", near(m.teds_like(F.col("gt"), F.col("pred"))).alias("teds"))


@query("table_shape_score", sql("""
    SELECT doc, round(avg(CASE WHEN greatest(pr, gr) = 0 OR greatest(pc, gc) = 0 THEN 0
           ELSE least(pr, gr) / greatest(pr, gr) * (least(pc, gc) / greatest(pc, gc)) END) + 1e-9, 4) AS score
    FROM (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY tbl) AS k, gr, gc FROM s) a
    JOIN (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY tbl) AS k, pr, pc FROM s WHERE pr > 0) b USING (doc, k)
    GROUP BY doc""", "html_pairs", s=r"""
      SELECT tbl // 8 AS doc, tbl, len(regexp_extract_all(gt, '<tr\b')) AS gr, len(regexp_extract_all(pred, '<tr\b')) AS pr,
             len(regexp_extract_all(gt, '<t[dh]\b')) // len(regexp_extract_all(gt, '<tr\b')) AS gc,
             CASE WHEN len(regexp_extract_all(pred, '<tr\b')) > 0 THEN
               len(regexp_extract_all(pred, '<t[dh]\b')) // len(regexp_extract_all(pred, '<tr\b')) ELSE 0 END AS pc
      FROM html_pairs"""))
def table_shape_score(tb: Tables):
    pairs = tb.html_pairs.withColumn("doc", F.expr("tbl div 8"))
    pred = pairs.filter(F.col("pred").contains("<tr")).select("doc", "tbl", F.col("pred").alias("html"))
    return m.table_shape_score(pred, pairs.select("doc", "tbl", F.col("gt").alias("html")), "doc", "tbl")


# ---- answers --------------------------------------------------------------------------------------------------

def answer_rows(tb: Tables):
    """Two references per prediction: the answer and the question."""
    qa = tb.qa
    refs = F.explode(F.array("answer", "question"))
    return qa.select("conv_id", "turn", F.col("prediction").alias("pred"), refs.alias("ref"))


def norm(c):
    return f"translate(regexp_replace(lower({c}), '[。、！？]|{WS2}', '', 'g'), '０１２３４５６７８９', '0123456789')"


SQUAD = {
    "refs": "SELECT conv_id, turn, prediction AS pred, unnest([answer, question]) AS ref FROM qa",
    "normed": f"SELECT row_number() OVER () AS id, conv_id, turn, {norm('pred')} AS p, {norm('ref')} AS r FROM refs",
    "common": """
      SELECT id, sum(least(a, b)) AS c FROM (
        SELECT id, ch, sum(a) AS a, sum(b) AS b FROM (
          SELECT id, unnest(string_split(p, '')) AS ch, 1 AS a, 0 AS b FROM normed WHERE p <> ''
          UNION ALL SELECT id, unnest(string_split(r, '')) AS ch, 0, 1 FROM normed WHERE r <> '') GROUP BY id, ch) GROUP BY id""",
    "scored": """
      SELECT n.conv_id, n.turn, CASE WHEN p = r THEN 1.0 ELSE 0.0 END AS em,
             CASE WHEN p = '' OR r = '' OR c = 0 THEN 0.0 ELSE 2 * (c / length(p)) * (c / length(r)) / (c / length(p) + c / length(r)) END AS f1
      FROM normed n LEFT JOIN common USING (id)""",
    "best": "SELECT conv_id, turn, max(em) AS em, max(f1) AS f1 FROM scored GROUP BY conv_id, turn",
}


@query("squad_scores", sql("""
    SELECT turn, round(avg(em) * 100 + 1e-9, 6) AS exact_match, round(avg(f1) * 100 + 1e-9, 6) AS f1, count(*) AS total
    FROM best GROUP BY turn""", "qa", **SQUAD))
def squad_scores(tb: Tables):
    return rounded(m.squad_scores(answer_rows(tb), ["conv_id"], ["turn"]), "exact_match", "f1")


@query("scores_by_task", sql("""
    SELECT turn, count(*) AS n, round(avg(em) * 100 + 1e-9, 6) AS exact_match, round(avg(f1) * 100 + 1e-9, 6) AS f1
    FROM scored GROUP BY GROUPING SETS ((turn), ())""", "qa", **SQUAD))
def scores_by_task(tb: Tables):
    return rounded(m.scores_by_task(answer_rows(tb), "turn"), "exact_match", "f1")


def norm_qa(c):
    return f"regexp_replace(lower(regexp_replace({c}, '^{WS2}+|{WS2}+$', '', 'g')), '{WS2}+', ' ', 'g')"


TOKEN_F1 = {
    "pairs": f"""SELECT conv_id, turn, {norm_qa('prediction')} AS p, {norm_qa('answer')} AS r FROM qa""",
    "toks": """
      SELECT conv_id, turn, sum(least(a, b)) AS c, sum(a) AS np, sum(b) AS nr FROM (
        SELECT conv_id, turn, tok, sum(a) AS a, sum(b) AS b FROM (
          SELECT conv_id, turn, unnest(string_split(p, ' ')) AS tok, 1 AS a, 0 AS b FROM pairs
          UNION ALL SELECT conv_id, turn, unnest(string_split(r, ' ')), 0, 1 FROM pairs) WHERE tok <> '' GROUP BY ALL) GROUP BY ALL""",
    "f": """SELECT p.*, CASE WHEN c IS NULL THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 2.0 * (c / np) * (c / nr) / (c / np + c / nr) END AS f1
            FROM pairs p LEFT JOIN toks USING (conv_id, turn)""",
}


@query("token_f1", sql("SELECT conv_id, turn, round(f1 + 1e-9, 6) AS f1 FROM f", "qa", **TOKEN_F1))
def token_f1(tb: Tables):
    rows = tb.qa.select("conv_id", "turn", F.col("prediction").alias("pred"), F.col("answer").alias("ref"))
    return rounded(m.token_f1(rows, ["conv_id", "turn"]).select("conv_id", "turn", "f1"), "f1")


ANLS = {**TOKEN_F1, "pairs": f"SELECT *, translate(p, chars, bytes) AS ep, translate(r, chars, bytes) AS er FROM ({TOKEN_F1['pairs']}), codes"}
ANLS_CASE = """CASE WHEN p = '' AND r = '' THEN 1.0 WHEN p = '' OR r = '' THEN 0.0
    ELSE 1 - least(levenshtein(ep, er) / greatest(length(p), length(r)), 1.0) END"""


def answers(tb: Tables):
    return tb.qa.select("conv_id", "turn", F.col("prediction").alias("pred"), F.col("answer").alias("ref"))


@query("anls", sql(f"SELECT conv_id, turn, round({ANLS_CASE} + 1e-9, 6) AS anls FROM pairs", "qa", "codes",
                   pairs=ANLS["pairs"]))
def anls(tb: Tables):
    return answers(tb).select("conv_id", "turn", near(m.anls_of(F.col("pred"), F.col("ref"))).alias("anls"))


@query("qa_rollup", sql(f"""
    SELECT conv_id, count(*) AS qa_count, round(avg(CASE WHEN p = r THEN 1.0 ELSE 0.0 END) + 1e-9, 4) AS qa_em,
           round(avg(f1) + 1e-9, 4) AS qa_f1, round(avg({ANLS_CASE}) + 1e-9, 4) AS qa_anls FROM f GROUP BY conv_id""",
    "qa", "codes", **ANLS))
def qa_rollup(tb: Tables):
    return m.qa_rollup(answers(tb), ["conv_id", "turn"], "conv_id")


@query("na_detection", sql(f"""
    SELECT tp, fp, tn, fn, round(CASE WHEN tp + fp > 0 THEN 100.0 * tp / (tp + fp) ELSE 0 END + 1e-9, 6) AS precision,
           round(CASE WHEN tp + fn > 0 THEN 100.0 * tp / (tp + fn) ELSE 0 END + 1e-9, 6) AS recall,
           round(CASE WHEN 2 * tp + fp + fn > 0 THEN 200.0 * tp / (2 * tp + fp + fn) ELSE 0 END + 1e-9, 6) AS f1,
           round(100.0 * (tp + tn) / (tp + fp + tn + fn) + 1e-9, 6) AS accuracy
    FROM (SELECT count(*) FILTER (WHERE p AND r) AS tp, count(*) FILTER (WHERE p AND NOT r) AS fp,
                 count(*) FILTER (WHERE NOT p AND NOT r) AS tn, count(*) FILTER (WHERE NOT p AND r) AS fn
          FROM (SELECT regexp_matches(lower(prediction), '{'|'.join(t.NA_PATTERNS)}') AS p, length(answer) < 200 AS r FROM qa))""", "qa"))
def na_detection(tb: Tables):
    ref = F.when(F.length("answer") < 200, "N/A").otherwise(F.col("answer"))
    out = m.na_detection(tb.qa.select(F.col("prediction").alias("pred"), ref.alias("ref")))
    return rounded(out, "precision", "recall", "f1", "accuracy")


# ---- extraction -----------------------------------------------------------------------------------------------

@query("extraction_scores", """
    SELECT event_type AS schema_type, count(*) AS total, round(100 * avg(v) + 1e-9, 6) AS valid_rate,
           round(100 * avg(e) + 1e-9, 6) AS exact_match_rate,
           round(100 * avg(CASE WHEN v = 1 THEN pr END) + 1e-9, 6) AS field_precision, 100 AS field_recall,
           round(100 * avg(CASE WHEN v = 1 THEN 2 * pr / (1 + pr) END) + 1e-9, 6) AS field_f1,
           round(100 * avg(CASE WHEN v = 1 THEN va END) + 1e-9, 6) AS value_accuracy
    FROM (SELECT event_type, CASE event_id % 4 WHEN 3 THEN 0 ELSE 1 END AS v, CASE event_id % 4 WHEN 0 THEN 1 ELSE 0 END AS e,
                 CASE event_id % 4 WHEN 1 THEN 0.75 ELSE 1.0 END AS pr, CASE event_id % 4 WHEN 2 THEN CAST(2 AS DOUBLE) / 3 ELSE 1.0 END AS va
          FROM events) GROUP BY GROUPING SETS ((event_type), ())""")
def extraction_scores(tb: Tables):
    """By event id: exact, one extra key, a wrong number with a differently cased string, a missing key."""
    k = F.get_json_object("props", "$.k").cast("int")
    case = F.col("event_id") % 4
    kind = F.when(case == 2, F.upper("event_type")).otherwise(F.col("event_type"))
    number = F.when(case == 2, k + 1).otherwise(k)
    body = F.concat(F.lit('{"type": "'), kind, F.lit('", "k": '), number.cast("string"))
    day = F.lit(', "day": "2024-01-05"')
    reply = (
        F.when(case == 1, F.concat(body, day, F.lit(', "note": "x"}'))).when(case == 3, F.concat(body, F.lit("}")))
        .otherwise(F.concat(body, day, F.lit("}")))
    )
    expected = F.concat(F.lit('{"k": '), k.cast("string"), F.lit(', "day": "2024-01-05", "type": "'), "event_type", F.lit('"}'))
    schema = F.create_map(*map(F.lit, ("k", "number", "type", "string", "day", "date")))
    rows = tb.read("events").select(
        F.col("event_type").alias("schema_type"), F.concat(F.lit("Result: "), reply).alias("response"),
        schema.alias("schema"), expected.alias("expected"),
    )
    out = m.extraction_scores(rows)
    return rounded(out, *(c for c in out.columns if c not in ("schema_type", "total")))


@query("key_overlap", """
    SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 0 END AS precision, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 0 END AS recall
    FROM events""")
def key_overlap(tb: Tables):
    got = F.from_json("props", "map<string,string>")
    want = F.when(F.col("event_id") % 2 == 0, got).otherwise(F.create_map(F.col("event_type"), F.lit("x")))
    over = m.key_overlap(want, F.map_concat(got, F.create_map(F.lit("extra"), F.lit("x"))))
    return tb.read("events").select("event_id", over["precision"].alias("precision"), over["recall"].alias("recall"))


# ---- summaries ------------------------------------------------------------------------------------------------

def rouge_sql(n: int) -> dict[str, str]:
    gram = " || chr(1) || ".join(f"w[k + {i}]" for i in range(n))
    return {
        "sides": """
          SELECT conv_id, turn, 1 AS a, 0 AS b, list_filter(regexp_split_to_array(lower(prediction), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM qa
          UNION ALL
          SELECT conv_id, turn, 0, 1, list_filter(regexp_split_to_array(lower(answer), '[^a-z0-9]+'), lambda x: x <> '') FROM qa""",
        "grams": f"SELECT conv_id, turn, a, b, {gram} AS tok FROM (SELECT *, unnest(range(1, len(w) - {n - 2})) AS k FROM sides)",
        "toks": """
          SELECT conv_id, turn, sum(least(a, b)) AS c, sum(a) AS np, sum(b) AS nr FROM (
            SELECT conv_id, turn, tok, sum(a) AS a, sum(b) AS b FROM grams GROUP BY ALL) GROUP BY ALL""",
    }


ROUGE_SELECT = """
    SELECT turn, count(*) AS n, round(100 * avg(CASE WHEN coalesce(c, 0) = 0 THEN 0.0 ELSE 2.0 * (c / np) * (c / nr) / (c / np + c / nr) END)
           + 1e-9, 6) AS f FROM qa LEFT JOIN toks USING (conv_id, turn) GROUP BY turn"""


def summaries(tb: Tables):
    return tb.qa.select("conv_id", "turn", F.col("prediction").alias("pred"), F.col("answer").alias("ref"))


def by_turn(scored):
    return rounded(scored.groupBy("turn").agg(F.count(F.lit(1)).alias("n"), (F.avg("f1") * 100).alias("f")), "f")


@query("rouge_n", sql(ROUGE_SELECT, "qa", **rouge_sql(2)))
def rouge_n(tb: Tables):
    return by_turn(m.rouge_n(summaries(tb), ["conv_id", "turn"], 2))


@query("rouge_1", sql(ROUGE_SELECT, "qa", **rouge_sql(1)))
def rouge_1(tb: Tables):
    return by_turn(m.rouge_n(summaries(tb), ["conv_id", "turn"], 1))


@query("rouge_l")
def rouge_l(tb: Tables):
    return by_turn(m.rouge_l(summaries(tb)))


@query("length_compliance", """
    SELECT role, round(100 * avg(CASE WHEN conv_id % 3 > 0 THEN CASE WHEN length(text) <= 200 * (conv_id % 3) THEN 1.0 ELSE 0.0 END END)
           + 1e-9, 6) AS compliance FROM conversations GROUP BY role""")
def length_compliance(tb: Tables):
    limit = F.when(F.col("conv_id") % 3 > 0, 200 * (F.col("conv_id") % 3))
    rows = tb.read("conversations").select("role", F.col("text").alias("pred"), limit.alias("max_length"))
    return rounded(m.length_compliance(rows, ["role"]), "compliance")


@query("score_distribution", """
    SELECT arg_max(event_type, (value, -event_id)) AS best_type, arg_min(event_type, (value, event_id)) AS worst_type,
           min(value) * 100 AS min, max(value) * 100 AS max, round(stddev_pop(value) * 100 + 1e-9, 6) AS std,
           round(quantile_cont(value, 0.25) * 100 + 1e-9, 6) AS p25, round(quantile_cont(value, 0.5) * 100 + 1e-9, 6) AS p50,
           round(quantile_cont(value, 0.75) * 100 + 1e-9, 6) AS p75 FROM events""")
def score_distribution(tb: Tables):
    out = m.score_distribution(tb.read("events"), "event_id", "event_type", "value")
    return rounded(out, "std", "p25", "p50", "p75")


# ---- runs -----------------------------------------------------------------------------------------------------

@query("latency_summary", """
    SELECT count(*) AS count, round(median(value) + 1e-9, 3) AS latency_median,
           round(list(value ORDER BY value)[greatest(0, CAST(floor(count(*) * 0.95) AS BIGINT) - 1) + 1] + 1e-9, 3) AS latency_p95,
           max(user_id) AS vram_max FROM events""")
def latency_summary(tb: Tables):
    return m.latency_summary(tb.read("events"), "value", "user_id")


@query("stage_percentiles", sql("""
    SELECT run_id, stage, count(*) AS n, list(ms ORDER BY ms)[CAST(round_even(0.5 * (count(*) - 1), 0) AS BIGINT) + 1] AS p50,
           list(ms ORDER BY ms)[CAST(round_even(0.95 * (count(*) - 1), 0) AS BIGINT) + 1] AS p95
    FROM run_events GROUP BY run_id, stage""", "run_events"))
def stage_percentiles(tb: Tables):
    return m.stage_percentiles(tb.run_events, ["run_id", "stage"])


METRIC_SQL = """
    SELECT o_custkey AS run, min(o_totalprice) / 400000 AS cer, max(o_totalprice) / 500000 AS hm,
           CASE WHEN count(*) > 10 THEN avg(o_totalprice) / 300000 END AS ly FROM orders GROUP BY o_custkey"""


@query("gate", sql("""
    SELECT run, CASE WHEN cer > 0.9 THEN 'fail' ELSE 'pass' END AS recognition, CASE WHEN hm < 0.86 THEN 'fail' ELSE 'pass' END AS detection,
           CASE WHEN ly IS NULL THEN 'skip' WHEN ly < 0.72 THEN 'fail' ELSE 'pass' END AS layout, 'skip' AS "table",
           concat_ws('; ', CASE WHEN cer > 0.9 THEN printf('cer %.4f > 0.9', cer) END,
             CASE WHEN hm < 0.86 THEN printf('detection_hmean %.4f < 0.86', hm) END,
             CASE WHEN ly < 0.72 THEN printf('layout_map_50_95 %.4f < 0.72', ly) END) AS reasons,
           CASE WHEN cer > 0.9 OR hm < 0.86 OR ly < 0.72 THEN 0 ELSE 1 END AS passed FROM q""", q=METRIC_SQL))
def gate(tb: Tables):
    q = tb.read("orders").groupBy(F.col("o_custkey").alias("run")).agg(
        (F.min("o_totalprice") / 400000).alias("cer"), (F.max("o_totalprice") / 500000).alias("detection_hmean"),
        F.when(F.count(F.lit(1)) > 10, F.avg("o_totalprice") / 300000).alias("layout_map_50_95"),
    )
    long = q.unpivot(["run"], ["cer", "detection_hmean", "layout_map_50_95"], "metric", "value").filter("value is not null")
    return m.gate(long, "run")


SIDECAR_SQL = """
    SELECT doc_id AS stem, CASE WHEN toxic = 1 THEN '.gt.html' ELSE '.html' END AS kind FROM labels WHERE quality = 1
    UNION ALL SELECT doc_id, '.tables.json' FROM labels"""


def sidecars(tb: Tables):
    lab = tb.read("labels")
    a = lab.filter("quality = 1").select(F.col("doc_id").alias("stem"), F.when(F.col("toxic") == 1, ".gt.html").otherwise(".html").alias("kind"))
    return a.unionByName(lab.select(F.col("doc_id").alias("stem"), F.lit(".tables.json").alias("kind")))


KINDS = [".gt.html", ".html", ".tables.json"]


@query("gt_coverage", sql("""
    SELECT count(*) AS total, count(k) AS with_gt, round(count(k) / count(*) + 1e-9, 4) AS coverage,
           count(*) FILTER (WHERE k = 1) AS n_gt_html, count(*) FILTER (WHERE k = 2) AS n_html, count(*) FILTER (WHERE k = 3) AS n_tables_json
    FROM documents d LEFT JOIN (SELECT stem, min(CASE kind WHEN '.gt.html' THEN 1 WHEN '.html' THEN 2 ELSE 3 END) AS k FROM s GROUP BY stem) x
      ON d.doc_id = x.stem""", s=SIDECAR_SQL))
def gt_coverage(tb: Tables):
    return m.gt_coverage(tb.read("documents").select(F.col("doc_id").alias("stem")), sidecars(tb), KINDS)


@query("best_run", sql("""
    SELECT c_custkey AS trial, c_mktsegment AS params, coalesce(cer, 1.0) AS cer FROM customer
    LEFT JOIN (SELECT o_custkey AS t, min(round(o_totalprice / 1e6, 6)) AS cer FROM orders GROUP BY o_custkey) e ON e.t = c_custkey
    ORDER BY cer, c_custkey LIMIT 1"""))
def best_run(tb: Tables):
    evals = tb.read("orders").selectExpr("o_custkey as trial", "round(o_totalprice / 1e6D, 6) as cer")
    return m.best_run(evals, tb.read("customer").selectExpr("c_custkey as trial", "c_mktsegment as params"))


@query("batch_cost", """
    SELECT p_partkey AS model, round(pages * ((1800 * p_size + 900 * p_retailprice) / 1e6 + 0.005) + 1e-9, 6) AS usd,
           round(pages * ((1800 * p_size + 900 * p_retailprice) / 1e6 + 0.005) * 150.8 + 1e-9, 6) AS local
    FROM part, (SELECT count(*) AS pages FROM pages)""")
def batch_cost(tb: Tables):
    prices = tb.read("part").selectExpr("p_partkey as model", "p_size as in_price", "p_retailprice as out_price", "0.005D as image_fee")
    pages = tb.read("pages").agg(F.count(F.lit(1)).alias("pages"))
    return rounded(m.batch_cost(prices, pages, 1800, 900, 150.8), "usd", "local")


@query("perplexity", """
    SELECT round(sum(l_discount * l_quantity) / sum(l_quantity) + 1e-9, 6) AS eval_loss,
           round(exp(sum(l_discount * l_quantity) / sum(l_quantity)) + 1e-9, 6) AS eval_perplexity FROM lineitem""")
def perplexity(tb: Tables):
    rows = tb.read("lineitem").selectExpr("l_orderkey as id", "l_discount as loss", "l_quantity as tokens")
    return rounded(m.perplexity(rows, "id"), "eval_loss", "eval_perplexity")


@query("doc_counts", """
    SELECT o_custkey AS doc_id, count(*) AS pages, sum(coalesce(n, 0)) AS blocks, sum(coalesce(t, 0)) AS tables FROM orders
    LEFT JOIN (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'A') AS t FROM lineitem GROUP BY 1) x
      ON o_orderkey = l_orderkey GROUP BY o_custkey""")
def doc_counts(tb: Tables):
    pages = tb.read("orders").selectExpr("o_custkey as doc_id", "o_orderkey as page")
    blocks = tb.read("lineitem").select(F.col("l_orderkey").alias("page"), "l_returnflag").join(pages, "page")
    return m.doc_counts(pages, blocks, blocks.filter("l_returnflag = 'A'"))


@query("baseline_report", """
    SELECT 'layout' AS section, p_name AS method, printf('%.3f', p_retailprice / 1000 + 1e-9) AS score, p_brand AS source, '' AS reason FROM part
    UNION ALL SELECT 'docqa', 'ours', printf('%.3f', avg(value) / 100 + 1e-9), 'This work', '' FROM events
    UNION ALL SELECT 'layout', 'ours', printf('%.3f', max(value) / 100 * 0 + avg(user_id) / 1000 + 1e-9), 'This work', '' FROM events
    UNION ALL SELECT 'tables', 'ours', 'tbf', 'This work', 'no values'""")
def baseline_report(tb: Tables):
    base = tb.read("part").select(
        F.lit("layout").alias("section"), F.col("p_name").alias("method"),
        F.format_string("%.3f", F.col("p_retailprice") / 1000 + 1e-9).alias("score"), F.col("p_brand").alias("source"),
    )
    rows = tb.read("events").select(
        (F.col("value") / 100).cast("string").alias("qa_anls"), (F.col("user_id") / 1000).cast("string").alias("map"),
        F.lit("").alias("teds"),
    )
    return m.baseline_report(base, rows, {"docqa": "qa_anls", "layout": "map", "tables": "teds"})


@query("reading_edge_f1", sql("""
    SELECT tp, round(tp / np + 1e-9, 6) AS precision, round(tp / ng + 1e-9, 6) AS recall, round(2.0 * tp / (np + ng) + 1e-9, 6) AS f1
    FROM (SELECT (SELECT count(*) FROM (SELECT * FROM pe INTERSECT SELECT * FROM ge)) AS tp, (SELECT count(*) FROM pe) AS np,
                 (SELECT count(*) FROM ge) AS ng)""", "boxes", "preds", pe="""
      SELECT page, lag(idx) OVER (PARTITION BY page ORDER BY idx) AS src, idx AS dst FROM preds QUALIFY src IS NOT NULL""", ge="""
      SELECT page, lag(idx) OVER (PARTITION BY page ORDER BY idx) AS src, idx AS dst FROM boxes QUALIFY src IS NOT NULL"""))
def reading_edge_f1(tb: Tables):
    from foliospark.operators.windows import sequential_edges

    p = sequential_edges(tb.preds, ["page"], "idx", "idx")
    g = sequential_edges(tb.boxes, ["page"], "idx", "idx")
    return rounded(m.reading_edge_f1(p, g, ["page"]), "precision", "recall", "f1")


@query("page_direction", sql("""
    SELECT page, CASE WHEN sum(CASE WHEN d = 'horizontal' THEN 0 ELSE (x2 - x1) * (y2 - y1) END) >
                           sum(CASE WHEN d = 'horizontal' THEN (x2 - x1) * (y2 - y1) ELSE 0 END) THEN 'vertical' ELSE 'horizontal' END
           AS page_direction FROM q GROUP BY page""", "boxes", q="""
      SELECT *, CASE label WHEN 'A' THEN 'horizontal' WHEN 'N' THEN 'vertical' END AS d FROM boxes"""))
def page_direction(tb: Tables):
    d = F.when(F.col("label") == "A", "horizontal").when(F.col("label") == "N", "vertical")
    return m.page_direction(tb.boxes.withColumn("direction", d), ["page"])


@query("element_direction", sql("""
    SELECT w.page, e.idx, CASE WHEN count(*) FILTER (WHERE x2 - x1 = 50) > count(*) FILTER (WHERE x2 - x1 <> 50) THEN 'horizontal'
           ELSE 'vertical' END AS element_direction
    FROM words w JOIN (SELECT page, idx, y1 AS ey1 FROM elements) e ON w.page = e.page AND w.y1 >= ey1 AND w.y1 < ey1 + 90 AND w.x1 < 540
    GROUP BY w.page, e.idx""", "words", "elements"))
def element_direction(tb: Tables):
    from foliospark.operators.boxes import words_in_elements
    from foliospark.functions import geometry as g

    words = tb.words.withColumn("direction", g.word_direction(g.quad_of_box(g.box())))
    pairs = words_in_elements(words, tb.elements, ["page"])
    return m.element_direction(pairs, ["page", "o_idx"]).withColumnRenamed("o_idx", "idx")
