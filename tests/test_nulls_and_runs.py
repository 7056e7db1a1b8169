"""Null keys and values lose no row, and a second run of a stream adds to the first."""

from pyspark.sql import functions as F

from foliospark.operators import detection, reading, sampling, windows
from foliospark.operators.scan import islands, ranked, tiles, value_at_ranks
from foliospark.session import scratch_path
from foliospark.streaming import streams


def test_ranked_with_nulls(spark):
    df = spark.createDataFrame([(1, "a", 0.5), (2, None, 0.4), (3, "a", None), (4, None, None), (5, None, 0.1)], "idx long, label string, score double")
    got = {r.idx: r["rank"] for r in ranked(df, ["label"], ["score", "idx"], tiles(F.col("score"), 0.05)).collect()}
    assert got == {1: 2, 3: 1, 4: 1, 5: 2, 2: 3}


def test_islands_with_null_key(spark):
    df = spark.createDataFrame([(None, 1, 0, 2), (None, 2, 1, 3), (None, 3, 9, 10), ("a", 4, 0, 1)], "k string, i int, a int, b int")
    got = {r.i: r.isle.i for r in islands(df, ["k"], ["a", "i"], tiles(F.col("a"), 5), F.col("a"), F.col("b"), F.lit(1), "isle").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4}


def test_sampling_keeps_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c"), (4, "d")], "id long, v string")
    assert sampling.shuffle_rows(df, 1, "id").count() == 4
    parts = sampling.train_val_split(df, 0.5, 1, "id")
    counts = [p.count() for p in parts] if isinstance(parts, tuple) else [parts.count()]
    assert sum(counts) == 4


def test_nms_keeps_boxes_without_class(spark):
    rows = [(1, None, 1, 0.9, 0, 0, 10, 10), (1, None, 2, 0.8, 1, 1, 10, 10), (1, "a", 3, 0.7, 0, 0, 10, 10), (1, None, 4, 0.1, 50, 50, 60, 60)]
    df = spark.createDataFrame(rows, "page long, label string, idx long, score double, x1 long, y1 long, x2 long, y2 long")
    assert sorted(r.idx for r in detection.nms(df, ["page", "label"], 0.5).collect()) == [1, 3, 4]


def test_ground_truth_of_two_runs(spark, tmp_path):
    def source(name, rows, files=1):
        path = str(tmp_path / name)
        for row in rows if files > 1 else [rows]:
            part = [row] if files > 1 else row
            spark.createDataFrame(part, "doc_id long, table_idx long, html string").coalesce(1).write.mode("append").parquet(path)
        return spark.readStream.schema("doc_id long, table_idx long, html string").option("maxFilesPerTrigger", 1).parquet(path)

    target = scratch_path(spark, "truth")
    first = source("a", [(1, 0, "<table>x</table>"), (1, 1, "<table>y</table>"), (2, 0, "<table>z</table>")], files=3)
    streams.incremental_ground_truth(first, target, str(tmp_path / "c1")).awaitTermination()
    second = source("b", [(1, 0, "<table>new</table>"), (3, 0, "<table>w</table>")])
    streams.incremental_ground_truth(second, target, str(tmp_path / "c2")).awaitTermination()
    got = sorted((r.doc_id, r.table_idx, r.html) for r in spark.read.parquet(target).collect())
    assert got == [(1, 0, "<table>x</table>"), (1, 1, "<table>y</table>"), (2, 0, "<table>z</table>"), (3, 0, "<table>w</table>")]


BLOCKS = [(None, 1, 0, 0), (None, None, 0, 10), (None, None, 900, 900), (None, 2, 900, 890), (1, 1, 0, 0), (1, None, 500, 500), (1, None, 0, 10)]


def blocks(spark):
    rows = [(p, i, x, y, x + 10, y + 10, 1000, 1000) for p, i, x, y in BLOCKS]
    return spark.createDataFrame(rows, "page long, idx long, x1 long, y1 long, x2 long, y2 long, w long, h long")


def test_regions_with_null_keys(spark):
    got = reading.region_components(blocks(spark), ["page"], "w", "h").collect()
    assert sorted((r.page or 0, r.idx or 0, r.x1, r.y1) for r in got) == sorted((p or 0, i or 0, x, y) for p, i, x, y in BLOCKS)


def test_scores_with_null_keys(spark):
    """A null page or class is scored like the same boxes on a page with a number."""
    schema = "page long, label string, idx long, score double, x1 long, y1 long, x2 long, y2 long"
    at = [(0, 0.9, 0), (1, 0.8, 3), (2, 0.7, 500), (3, 0.2, 104)]
    page = lambda p, c: [(p, c, i, s, x, 0, x + 50, 50) for i, s, x in at]
    pred = spark.createDataFrame([*page(1, "a"), *page(None, "a"), *page(2, None)], schema)
    gt = spark.createDataFrame([(p, c, i, 1.0, x, 0, x + 50, 50) for p, c in ((1, "a"), (None, "a"), (2, None)) for i, x in enumerate((0, 100))], schema)
    keys = ["page", "label"]
    ap = detection.average_precision(pred, gt, [0.5, 0.9])
    by_page = {(r.page, r.label): set() for r in ap.collect()}
    for r in ap.collect():
        by_page[r.page, r.label].add((r.thr, r.ap))
    assert by_page[1, "a"] == by_page[None, "a"] == by_page[2, None] and max(a for _, a in by_page[1, "a"]) > 0
    matches = detection.match_detections(pred, gt, keys)
    counts = detection.detection_counts(pred, gt, pred.select(*keys).distinct(), keys, matches).collect()
    assert sorted((r.tp, r.fp, r.fn) for r in counts) == [(2, 2, 0)] * 3
    score = detection.map_50_95(ap, pred, pred).first()
    assert score.images == 3 and score.map_50 == max(a for _, a in by_page[1, "a"])
    n_gt = gt.groupBy(*keys).agg(F.count("*").alias("n_gt"))
    curve = detection.cumulative_pr(detection.match_flags(pred, matches, keys), n_gt, keys).collect()
    assert len(curve) == 12 and {r.cum_tp for r in curve if r["rank"] == 4} == {2}
    middle = value_at_ranks(pred, ["page"], "score", {"v": F.lit(1)}, 0.1).collect()
    assert sorted((r.page or 0, r.v, r.n) for r in middle) == [(0, 0.7, 4), (1, 0.7, 4), (2, 0.7, 4)]


def test_clusters_with_null_keys(spark):
    x = F.when(~((F.col("page") == 1) & (F.col("x1") == 500)) | F.col("page").isNull(), F.col("x1") / 1000)
    for limit in (2000, 1):
        got = windows.cluster_x(blocks(spark), ["page"], x, limit=limit).collect()
        assert sorted((r.page or 0, r.x1, -1 if r.cluster is None else r.cluster) for r in got) == [(0, 0, 0), (0, 0, 0), (0, 900, 1), (0, 900, 1), (1, 0, 0), (1, 0, 0), (1, 500, -1)]
    assert reading.reading_order_simple(blocks(spark), ["page"], "w").count() == len(BLOCKS)


def test_selection_by_digits_equals_ranking(spark, monkeypatch):
    ids = [*range(3000), *[7] * 40, *[None] * 25]
    df = spark.createDataFrame([(i, "x" * 20) for i in ids], "id long, text string").repartition(6)
    monkeypatch.setattr(sampling, "CUT_ROWS", 4)  # several rounds of digits
    at = sampling.hash_ranked(df.where("id = 7"), [], "id", 3).count()
    first = {r.id: r._rank for r in sampling.hash_ranked(df.where("id IS NOT NULL").distinct(), [], "id", 3).collect()}
    place = 25 + first[7]  # of the first row with id 7, nulls first
    for n in (0, 1, 10, 25, 26, 1500, place - 1, place + 5, place + at - 1, 3064, 3065, 9999):
        got = sorted((r.id is not None, r.id) if r.id is not None else (False, 0) for r in sampling.sample_exact(df, n, 3, "id").collect())
        want = sorted((r.id is not None, r.id) if r.id is not None else (False, 0) for r in sampling.hash_ranked(df, [], "id", 3).where(F.col("_rank") <= n).collect())
        assert got == want
    assert sampling.oversample(df, 7000, 3, "id").count() == 7000
    split = sampling.train_val_split(df, 0.3, 3, "id")
    assert split.where("split = 'val'").count() == int(3065 * 0.3) and split.count() == 3065


def test_sampling_moves_no_rows(spark):
    df = spark.range(5000).withColumn("text", F.lit("x"))
    for out in (sampling.sample_exact(df, 100, 1, "id"), sampling.train_val_split(df, 0.1, 1, "id"), sampling.oversample(df, 12_000, 1, "id")):
        assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_improvements_come_once_and_state_survives(spark):
    schema = "trial string, step long, cer double"
    parts = [[("a", 1, 0.9), ("a", 2, 0.5), ("b", 1, None), (None, 1, 0.4)], [("a", 3, 0.6), ("b", 2, 0.8), (None, 2, 0.4)], [("a", 4, 0.5), ("a", 5, 0.2), (None, 3, 0.1)]]
    source, state, out = (scratch_path(spark, n) for n in ("source", "state", "out"))
    for rows in parts:  # a run for each file, all from one checkpoint
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        streams.to_parquet(streams.stream_improvements(stream), out, state).awaitTermination()
    got = sorted((r.trial or "", r.step, r.cer) for r in spark.read.parquet(out).collect())
    assert got == [("", 1, 0.4), ("", 3, 0.1), ("a", 1, 0.9), ("a", 2, 0.5), ("a", 5, 0.2), ("b", 2, 0.8)]
    batch = streams.stream_improvements(spark.createDataFrame([r for rows in parts for r in rows], schema))
    assert sorted((r.trial or "", r.step, r.cer) for r in batch.collect()) == got


def test_ground_truth_looks_for_its_own_documents(spark, tmp_path):
    """A batch of few documents reads keys in their buckets only, and adds what neither run has."""
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    schema = "doc_id bigint, table_idx bigint, html string"
    filler = spark.range(20_000).selectExpr("id AS doc_id", "0L AS table_idx", "concat('<table>', id, '</table>') AS html")
    filler.coalesce(1).write.parquet(str(tmp_path / "first"))
    streams.incremental_ground_truth(spark.readStream.schema(schema).parquet(str(tmp_path / "first")), target, str(tmp_path / "c1")).awaitTermination()
    whole = spark.read.parquet(target)
    assert whole.count() == 20_000 and len(whole.inputFiles()) >= streams.BUCKETS
    for k in range(2):
        # an old document, a new one with one more table in each file, one table again, one without a text
        rows = [(7, 9, "x"), (50_000, k, f"t{k}"), (50_000, 0, "t0") if k else (50_001, 0, "u"), (60_000 + k, 1, " ")]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    batch = spark.read.schema(schema).parquet(source)
    keys = streams.added_keys(batch, target, "doc_id", "table_idx")
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert keys.count() == 1 and "PartitionFilters: [bucket" in plan and "PushedFilters: [In(doc_id" in plan and "html" not in plan
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    streams.incremental_ground_truth(read, target, state).awaitTermination()
    got = spark.read.parquet(target).where(F.col("run") == streams.run_name(state)).collect()
    assert sorted((r.doc_id, r.table_idx, r.html) for r in got) == [(50_000, 0, "t0"), (50_000, 1, "t1"), (50_001, 0, "u")]
