"""Values worked by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.functions import sequences as sq, text as t
from foliospark.operators import detection, metrics, prompts, reading, sampling


def one(spark, column, **values):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return row.select(column.alias("v")).first()["v"]


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_bit_parallel_forms():
    rng = np.random.RandomState(0)
    for _ in range(200):
        a, b = ("".join(rng.choice(list("abc"), rng.randint(0, 90))) for _ in range(2))
        assert sq._distance(a, b) == plain_distance(a, b)
        grid = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                grid[i, j] = grid[i - 1, j - 1] + 1 if x == y else max(grid[i - 1, j], grid[i, j - 1])
        assert sq._lcs(a, b) == grid[-1, -1]


@pytest.mark.parametrize("a,b,d", [("請求書", "請求者", 1), ("", "", 0), ("", "ab", 2), ("a" * 300, "a" * 200 + "b" * 90, 100), ("x" * 40, "y" * 40, 40)])
def test_edit_distance(spark, a, b, d):
    assert one(spark, t.edit_distance(F.col("a"), F.col("b")), a=a, b=b) == d


@pytest.mark.parametrize("text,day", [("2025-07-01", "2025-07-01"), ("7/1 start", "2024-07-01"), ("2月30日", None), ("3月5日", "2024-03-05"), ("none", None)])
def test_parse_date(spark, text, day):
    assert one(spark, t.parse_date(F.col("s"), 2024).cast("string"), s=text) == day


@pytest.mark.parametrize("text,span", [("7/1-7/15", ("2024-07-01", "2024-07-15")), ("2025-07-01 ~ 2025-07-15", ("2025-07-01", "2025-07-15")),
                                       ("7月1日〜7月15日", ("2024-07-01", "2024-07-15")), ("7/1 7/15", None)])
def test_parse_date_range(spark, text, span):
    r = t.parse_date_range(F.col("s"), 2024)
    got = one(spark, F.array(r["start"].cast("string"), r["end"].cast("string")), s=text)
    assert (tuple(got) if got[0] else None) == span


@pytest.mark.parametrize("text,loose,strict", [("banana", True, False), ("N/A", True, True), ("記載なし", True, True), ("yes", False, False)])
def test_is_na(spark, text, loose, strict):
    assert one(spark, t.is_na_answer(F.col("s")), s=text) is loose
    assert one(spark, t.is_na_answer(F.col("s"), strict=True), s=text) is strict


def test_text_forms(spark):
    assert one(spark, t.normalize_label(F.col("s")), s=" ＡＢ　 ①x\n") == "AB 1x"
    assert one(spark, t.clean_ocr_text(F.col("s"), dedup=True), s="ｌ100　О") == "l10 0"
    assert one(spark, t.to_full_width(F.col("s")), s="A ｶﾞ·¥") == "Ａ　ガ・￥"
    assert one(spark, t.clean_answer(F.col("s")), s="回答: A: 東京。大阪") == "東京"
    assert one(spark, t.clean_list_block(F.col("s")), s="1) a\n\n• b\nc") == "1) a\n- b\n- c"
    assert one(spark, t.strip_tags(F.col("s")), s="a>b<i>c</i> <x") == "a b c"
    assert one(spark, t.coerce_json(F.col("s")), s='ok {"a": {"b": 1}} done') == '{"a":{"b":1}}'
    assert one(spark, t.coerce_json(F.col("s")), s="none") is None
    assert one(spark, t.table_signature(F.col("s")), s="<table><TR><th>a</th></TR><tr><td></td><td></td></tr>") == "1h0d|0h2d"


def test_metric_edges(spark):
    assert one(spark, metrics.anls_of(F.col("a"), F.col("b")), a="", b=" ") == 1.0
    assert one(spark, metrics.anls_of(F.col("a"), F.col("b")), a="x", b="") == 0.0
    assert one(spark, metrics.char_f1(F.col("a"), F.col("b")), a="", b="") == 0.0
    assert one(spark, metrics.cer_of(F.col("a"), F.col("b")), a="", b="x") == 1.0
    assert one(spark, metrics.teds_like(F.col("a"), F.col("b")), a="<tr><td>a</td></tr>", b="<tr><td>b</td></tr>") == 0.5


def test_wer_and_rouge_l(spark):
    df = spark.createDataFrame([("the cat sat.", "the cat sit", 1)], "ref string, hyp string, i int").withColumn("pred", F.col("hyp"))
    assert metrics.wer(df).first()["wer"] == pytest.approx(1 / 3)
    assert metrics.rouge_l(df).first()["f1"] == pytest.approx(2 / 3)


def test_average_precision_by_hand(spark):
    schema = "page bigint, idx bigint, label string, score double, x1 int, y1 int, x2 int, y2 int"
    gt = spark.createDataFrame([(1, 1, "a", 1.0, 0, 0, 10, 10), (1, 2, "a", 1.0, 20, 0, 30, 10)], schema)
    pred = spark.createDataFrame([(1, 1, "a", 0.9, 0, 0, 10, 10), (1, 2, "a", 0.8, 50, 0, 60, 10), (1, 3, "a", 0.7, 20, 0, 30, 10)], schema)
    ap = detection.average_precision(pred, gt, [0.5]).first()["ap"]
    assert ap == pytest.approx((6 * 1.0 + 5 * 2 / 3) / 11)


def test_threshold_is_inclusive_for_matches(spark):
    schema = "page bigint, idx bigint, x1 int, y1 int, x2 int, y2 int"
    gt = spark.createDataFrame([(1, 1, 0, 0, 10, 10)], schema)
    pred = spark.createDataFrame([(1, 5, 0, 0, 5, 10)], schema)
    assert detection.match_detections(pred, gt, ["page"], 0.5).count() == 1


@pytest.mark.parametrize("boxes,direction,order", [
    ([[0, 0, 40, 10], [50, 0, 90, 10], [0, 20, 40, 30], [50, 20, 90, 30]], "top2bottom", [0, 2, 1, 3]),
    ([[0, 0, 40, 10], [50, 0, 90, 10], [0, 20, 40, 30], [50, 20, 90, 30]], "left2right", [0, 1, 2, 3]),
    ([[0, 0, 10, 40], [20, 0, 30, 40], [40, 0, 50, 40]], "right2left", [2, 1, 0]),
    ([[0, 0, 90, 10], [0, 20, 40, 90], [50, 20, 90, 90], [0, 95, 90, 99]], "top2bottom", [0, 1, 2, 3]),
])
def test_walk_on_small_pages(boxes, direction, order):
    assert reading._ordered(np.array(boxes, float), direction) == order


def test_prompt_round_trip(spark):
    p = prompts.format_prompt(F.col("d"), F.col("q"), F.lit("high"), F.lit("背景"))
    parts = one(spark, F.to_json(prompts.parse_prompt(p)), d="本文 です", q="何ですか")
    assert '"document":"本文 です"' in parts and '"level":"high"' in parts and '"context":"背景"' in parts


def test_exact_sizes(spark):
    df = spark.range(1003)
    assert sampling.sample_exact(df, 100, 1, "id").count() == 100
    assert sampling.oversample(df, 2500, 1, "id").count() == 2500
    split = sampling.train_val_split(df, 0.1, 1, "id").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in split} == {"val": 100, "train": 903}
    with pytest.raises(ValueError):
        sampling.oversample(df.filter("id < 0"), 5, 1, "id")


def test_mix_fills_missing_tasks(spark):
    general = spark.range(10).withColumn("prompt", F.lit("p"))
    doc = spark.range(30).withColumn("task_type", F.when(F.col("id") % 2 == 0, "qa").otherwise("summary"))
    out = sampling.mix_datasets(general, doc, size=100).groupBy("source", "task_type").count().collect()
    assert {(r["source"], r["task_type"]): r["count"] for r in out} == {("general", None): 70, ("doc", "qa"): 10, ("doc", "summary"): 6, ("fill", "qa"): 14}


def test_same_result_for_any_partitioning(spark):
    import __spark_entry__ as entry
    from test_scale_paths import rows_of

    sf = "/root/testdata/sf0.001"
    results = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append([rows_of(entry.queries()[q](spark, sf)) for q in ("nms", "priority_dfs", "cluster_gap")])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]
