"""The ways large groups go must give what the small ways give."""

import random

import pytest
from pyspark.sql import Window, functions as F

from foliospark.functions import geometry as g
from foliospark.operators import boxes as ob, detection, diagrams, groups, reading, scan, spatial, tables, windows
from foliospark.operators.scan import islands, ordered_concat, running, tiles, value_at_ranks


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def boxes(spark):
    rnd = random.Random(1)
    rows = []
    for page in (1, 2):
        for i in range(150 if page == 1 else 12):
            x, y = rnd.randrange(1500), rnd.randrange(1500)
            rows.append((page, rnd.choice("ab"), i, rnd.randrange(10) / 10, x, y, x + rnd.randrange(20, 400), y + rnd.randrange(20, 400)))
    schema = "page bigint, label string, idx bigint, score double, x1 bigint, y1 bigint, x2 bigint, y2 bigint"
    return spark.createDataFrame(rows, schema).cache()


def test_running_equals_window(spark):
    rnd = random.Random(2)
    df = spark.createDataFrame([(i % 2, rnd.randrange(100), i, float(rnd.randrange(50))) for i in range(200)], "k int, o int, i int, v double")
    specs = {"rn": ("row_number", None), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "p": ("lag", F.col("v")),
             "l": ("last", F.when(F.col("v") > 40, F.col("v"))), "n": ("next", F.when(F.col("v") > 40, F.col("v"))), "b": ("min_before", F.col("v"))}
    got = running(df, ["k"], ["o", "i"], tiles(F.col("o"), 7), specs)
    w = Window.partitionBy("k").orderBy("o", "i")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    big = F.when(F.col("v") > 40, F.col("v"))
    want = df.select("*", F.row_number().over(w), F.sum("v").over(upto), F.min("v").over(upto), F.max("v").over(upto), F.lag("v").over(w),
                     F.last(big, True).over(upto), F.first(big, True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.min("v").over(before))
    assert rows_of(got) == rows_of(want)


def test_islands_over_bucket_ends(spark):
    rnd = random.Random(3)
    spans = sorted((a, a + rnd.randrange(30)) for a in (rnd.randrange(2000) for _ in range(80)))
    df = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(spans)], "k int, i int, a int, b int")
    got = {r["i"]: r["isle"]["i"] for r in islands(df, ["k"], ["a", "i"], tiles(F.col("a"), 50), F.col("a"), F.col("b"), F.lit(3), "isle").collect()}
    reach, start = None, None
    for i, (a, b) in enumerate(spans):
        if reach is None or a - reach > 3:
            start = i
        reach = b if reach is None else max(reach, b)
        assert got[i] == start


def test_quantile_tiles(spark, monkeypatch):
    """Scores in a narrow range, ties, nulls, NaN and infinities: buckets stay small and grow with the order."""
    monkeypatch.setattr(scan, "TILE_ROWS", 100)
    rnd = random.Random(6)
    values = [0.999 + rnd.random() / 1e4 for _ in range(4000)] + [0.5] * 300 + [None] * 5 + [float("nan"), float("inf"), float("-inf"), 7.0]
    df = spark.createDataFrame([(1, v, i) for i, v in enumerate(values)], "k long, v double, i long")
    rows = scan.with_quantile_tiles(df, "v")
    got = [r["_tile"] for r in rows.orderBy("v", "i").collect()]
    assert got == sorted(got) and len(set(got)) > 30
    sizes = {r["_tile"]: r["n"] for r in rows.filter("v <> 0.5 AND NOT isnan(v)").groupBy("_tile").agg(F.count("*").alias("n")).collect()}
    assert max(sizes.values()) < 200
    ranks = running(rows, ["k"], ["v", "i"], F.col("_tile"), {"n": ("row_number", None)})
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("k").orderBy("v", "i")))
    assert rows_of(ranks.select("i", "n")) == rows_of(want.select("i", "n"))
    for few in (df.filter("false"), df.filter("v IS NULL"), df.limit(20)):
        assert scan.with_quantile_tiles(few, "v").select("_tile").distinct().count() <= 1


def test_value_at_ranks(spark):
    values = [5, 1, 1, 7, 3, 3, 3]
    df = spark.createDataFrame([(v,) for v in values], "v int")
    out = value_at_ranks(df, [], "v", {"a": F.lit(0), "m": F.floor((F.col("n") - 1) / 2), "z": F.col("n") - 1}, 2).first()
    assert (out["n"], out["a"], out["m"], out["z"]) == (7, 1, 3, 7)


def test_ordered_concat(spark):
    df = spark.createDataFrame([(1, i, str(i)) for i in range(40)], "k int, i int, s string")
    out = ordered_concat(df, ["k"], ["i"], "s", ",", "t", bucket=tiles(F.col("i"), 7)).first()["t"]
    assert out == ",".join(map(str, range(40)))


def test_overlap_pairs_are_all_pairs_once(spark, boxes):
    got = rows_of(spatial.overlap_pairs(boxes, boxes, ["page"]).select("page", "idx", "o_idx"))
    a = boxes.collect()
    want = sorted(((p["page"], p["idx"], q["idx"]) for p in a for q in a if p["page"] == q["page"] and min(p["x2"], q["x2"]) > max(p["x1"], q["x1"])
                   and min(p["y2"], q["y2"]) > max(p["y1"], q["y1"])), key=repr)
    assert got == want


@pytest.mark.parametrize("thr", [0.3, 0.5, 0.8])
def test_contained_pairs(spark, boxes, thr):
    got = rows_of(spatial.contained_pairs(boxes, boxes, ["page"], thr).select("page", "idx", "o_idx"))
    b = boxes.alias("b").join(spatial.prefixed(boxes, ["page"], "o_"), "page")
    want = b.filter(g.is_contained(g.box("o_"), g.box(), thr)).select("page", "idx", "o_idx")
    assert got == rows_of(want) and got


def test_nms_rounds(spark, boxes):
    keys = ["page", "label"]
    small = rows_of(detection.nms(boxes, keys, 0.2).select(*keys, "idx"))
    assert small == rows_of(detection.nms(boxes, keys, 0.2, limit=5).select(*keys, "idx"))
    again = detection.nms(detection.nms(boxes, keys, 0.2), keys, 0.2).select(*keys, "idx")
    assert small == rows_of(again)


def test_match_rounds(spark, boxes):
    pred = boxes.select("page", "idx", (F.col("x1") + 9).alias("x1"), "y1", (F.col("x2") + 9).alias("x2"), "y2")
    cand = detection.candidates(pred, boxes, ["page"], 0.1)
    order = pred.select("page", F.col("idx").alias("p"), F.col("idx").alias("ord"))
    small = rows_of(detection.match_candidates(cand, order, ["page"]).select("page", "p", "g"))
    assert small == rows_of(detection.match_candidates(cand, order, ["page"], limit=3).select("page", "p", "g"))


@pytest.mark.parametrize("limit", [40, 3])
def test_conflicts_by_component_and_in_rounds(spark, boxes, monkeypatch, limit):
    """Keys cut into components, and components too large for a task."""
    null_page = boxes.withColumn("page", F.when(F.col("page") != 1, F.col("page")))
    kept = rows_of(detection.nms(null_page, ["page", "label"], 0.2).select("page", "label", "idx"))
    cand = detection.candidates(boxes, boxes.withColumn("x1", F.col("x1") + 3), ["page"], 0.05)
    order = boxes.select("page", F.col("idx").alias("p"), F.col("idx").alias("ord"))
    found = rows_of(detection.match_candidates(cand, order, ["page"]).select("page", "p", "g", "iou"))
    monkeypatch.setattr(groups, "SETTLE_LIMIT", limit)
    assert kept == rows_of(detection.nms(null_page, ["page", "label"], 0.2, limit=5).select("page", "label", "idx"))
    assert found == rows_of(detection.match_candidates(cand, order, ["page"], limit=3).select("page", "p", "g", "iou"))


def test_a_chain_of_boxes_takes_few_checkpoints(spark, monkeypatch):
    """Each box overlaps the next one, by falling score: every second one goes."""
    chain = spark.range(2500).selectExpr("1 AS page", "id AS idx", "1 - id / 5000.0 AS score", "id * 10 AS x1", "0 AS y1", "id * 10 + 19 AS x2", "10 AS y2")
    chain = chain.withColumn("score", F.col("score").cast("double"))
    taken, real = [], groups.cut_lineage
    monkeypatch.setattr(groups, "cut_lineage", lambda df: taken.append(1) or real(df))
    kept = sorted(r.idx for r in detection.nms(chain, ["page"], 0.3).collect())
    assert kept == list(range(0, 2500, 2)) and len(taken) < 5


def test_cluster_rounds(spark, boxes):
    x = g.center_x(g.box()) / 1900
    small = rows_of(windows.cluster_x(boxes, ["page"], x).select("page", "idx", "cluster"))
    assert small == rows_of(windows.cluster_x(boxes, ["page"], x, limit=4).select("page", "idx", "cluster"))


def test_sorted_scans(spark, boxes, monkeypatch):
    pages = boxes.select("page").distinct().withColumn("w", F.lit(1900)).withColumn("h", F.lit(1900))
    bars = boxes.select("page", *g.SIDES)
    merged, kept = rows_of(windows.merge_bars(bars, pages, ["page"])), rows_of(windows.cluster_gap(boxes, ["page"], "x1", 20, "first"))
    monkeypatch.setattr(groups, "FOLD_LIMIT", 0)
    assert merged == rows_of(windows.merge_bars(bars, pages, ["page"]))
    assert kept == rows_of(windows.cluster_gap(boxes, ["page"], "x1", 20, "first"))


@pytest.mark.parametrize("gap", [1, 7, 40.5])
def test_first_values_by_doubling(spark, monkeypatch, gap):
    """A long chain, short ones, a null page and null values, against the walk."""
    rnd = random.Random(4)
    values = {1: sorted(rnd.sample(range(4000), 2500)), 2: [0, 1, 2, 90, 91], None: [rnd.randrange(600) for _ in range(300)], 3: [5]}
    rows = [(p, v) for p, vs in values.items() for v in vs] + [(1, None), (4, None)]
    monkeypatch.setattr(groups, "FOLD_LIMIT", 2)
    got = windows.cluster_gap(spark.createDataFrame(rows, "page long, x long"), ["page"], "x", gap, "first")
    want = []
    for page, vs in values.items():
        last = None
        for v in sorted(vs):
            if last is None or v - last > gap:
                want.append((page, float(v)))
                last = v
    assert rows_of(got) == sorted(want, key=repr)


def test_nearest_ties_take_first(spark):
    points = spark.createDataFrame([(1, float(v)) for v in (0, 5, 10, 200, -70)], "k int, x double")
    targets = spark.createDataFrame([(1, 3, 0.0), (1, 1, 10.0), (1, 2, 10.0), (1, 9, 90.0)], "k int, idx bigint, x double")
    got = {r["x"]: r["near_idx"] for r in spatial.nearest(points, targets, ["k"], "x", "x", "idx", 8).collect()}
    assert got == {0.0: 3, 5.0: 1, 10.0: 1, 200.0: 9, -70.0: 3}


def test_nearest_point_far_away(spark):
    points = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 5000.0, 9000.0)], "k int, pid int, x double, y double")
    targets = spark.createDataFrame([(1, 7, 40.0, 0.0), (1, 8, 0.0, 39.0), (1, 9, 900.0, 900.0)], "k int, tid int, x double, y double")
    got = {r["pid"]: r["tid"] for r in diagrams.nearest_point(points, targets, ["k"], "pid", "tid").collect()}
    assert got == {1: 8, 2: 9}


@pytest.mark.parametrize("direction,limit", [("top2bottom", 1000), ("left2right", 1000), ("right2left", 1000), ("top2bottom", 20), ("left2right", 20)])
def test_edges_equal_page_graph(spark, boxes, direction, limit, monkeypatch):
    import numpy as np

    monkeypatch.setattr(reading, "EDGE_LIMIT", limit)
    got = set(rows_of(reading.precedence_edges(boxes, ["page"], direction)))
    want = set()
    for page in (1, 2):
        rows = sorted((r for r in boxes.collect() if r["page"] == page), key=lambda r: r["idx"])
        children, _ = reading._page_graph(np.array([[r[s] for s in g.SIDES] for r in rows], float), direction)
        want |= {(page, rows[i]["idx"], rows[j]["idx"]) for i, c in enumerate(children) for j in c}
    assert got == want


def plain_walk(children, distance):
    """The rule of reading.walk, with no other state than lists."""
    n = len(children)
    parents = [{i for i in range(n) if j in children[i]} for j in range(n)]
    order, waiting, path, places, met = [], [], [], [0] * n, set()

    def meet(i):
        met.add(i)
        if parents[i] <= set(order):
            order.append(i)
            path.append(i)
        else:
            waiting.append(i)

    while len(order) < n:
        ready = [i for i in waiting if parents[i] <= set(order)]
        if ready:
            waiting.remove(ready[0])
            meet(ready[0])
            continue
        while path and places[path[-1]] == len(children[path[-1]]):
            path.pop()
        if path:
            i = path[-1]
            child = children[i][places[i]]
            places[i] += 1
            if child not in met:
                meet(child)
            continue
        fresh = [i for i in sorted(range(n), key=lambda k: distance[k]) if i not in met]
        if fresh:
            meet(fresh[0])
        else:
            order.append(waiting[0])
            path.append(waiting.pop(0))
    return order


def test_walk_follows_its_rule():
    rnd = random.Random(6)
    for _ in range(300):
        n = rnd.randrange(1, 14)
        children = [sorted({j for j in range(n) if j != i and rnd.random() < 0.25}) for i in range(n)]
        distance = [rnd.random() for _ in range(n)]
        assert reading.walk(children, distance) == plain_walk(children, distance)
    chain = [[i + 1] for i in range(50_000)] + [[]]
    assert reading.walk(chain, list(range(50_001))) == list(range(50_001))


@pytest.mark.parametrize("chunk", [7, 256])
@pytest.mark.parametrize("direction", ["top2bottom", "left2right", "right2left"])
def test_one_order_for_large_pages(spark, monkeypatch, direction, chunk):
    """3,000 boxes on one page are ordered by the rule for small ones, however they are cut."""
    import numpy as np

    rnd = random.Random(7)
    rows = [(1, i, *(lambda x, y: (x, y, x + rnd.randrange(20, 90), y + rnd.randrange(8, 30)))(rnd.randrange(3000), rnd.randrange(3000))) for i in range(3000 if chunk > 100 else 200)]
    df = spark.createDataFrame(rows, "page bigint, idx bigint, x1 bigint, y1 bigint, x2 bigint, y2 bigint")
    monkeypatch.setattr(reading, "CHUNK", chunk)
    got = [r["idx"] for r in sorted(reading.priority_order(df, ["page"], F.lit(direction)).collect(), key=lambda r: r["pos"])]
    monkeypatch.setattr(reading, "CHUNK", 1 << 20)
    children, distance = reading._page_graph(np.array([r[2:] for r in rows], float), direction)
    assert got == (plain_walk(children, distance.tolist()) if len(rows) < 1000 else reading.walk(children, distance.tolist()))


def test_median_distance(monkeypatch):
    import numpy as np

    monkeypatch.setattr(reading, "CHUNK", 2)
    rng = np.random.default_rng(1)
    for n in (2, 3, 10, 57, 300):
        for x, y in ((rng.random(n), rng.random(n)), (rng.integers(0, 3, n) * 1.0, np.zeros(n)), (np.ones(n), np.ones(n))):
            d = np.sqrt((x[:, None] - x) ** 2 + (y[:, None] - y) ** 2)[np.triu_indices(n, 1)]
            assert reading.median_distance(x, y) == np.median(d)


def test_groups_across_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    df = spark.createDataFrame([(i % 5, i) for i in range(100)], "k bigint, i bigint")
    import pandas as pd

    out = groups.map_groups(df, ["k"], ["i"], lambda key, rows: pd.DataFrame([(key[0], len(rows), rows["i"].is_monotonic_increasing)], columns=["k", "n", "up"]),
                            "k bigint, n bigint, up boolean")
    assert rows_of(out) == [(k, 20, True) for k in range(5)]
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_places_meet_once(spark, monkeypatch):
    """Blocks of one place and rows, lanes or patches of one extent are joined once, not each with each."""
    blocks = spark.range(600).selectExpr("1 AS page", "id AS idx", "id % 40 AS x1", "id % 3 * 30 AS y1", "id % 40 + 10 AS x2", "id % 3 * 30 + 20 AS y2", "'t' || id AS txt")
    rows = spark.range(200).selectExpr("1 AS page", "id AS row", "id % 4 * 20 AS y")
    met = []
    for name in ("points_in_bands", "points_in_boxes"):
        def joined(*args, plain=getattr(spatial, name), **kw):
            out = plain(*args, **kw)
            met.append(out.count())
            return out
        monkeypatch.setattr(spatial, name, joined)
    pairs = diagrams.band_texts(rows, blocks, ["page"], F.lit(1000)).groupBy("page", "o_row").agg(
        F.count("*").alias("o_n"), F.sum("idx").alias("o_s"), F.min("idx").alias("o_m"))
    total = {"n": ("count", F.lit(1)), "s": ("sum", F.col("idx")), "m": ("min", F.col("idx"))}
    found = diagrams.band_texts(rows, blocks, ["page"], F.lit(1000), totals=total)
    want = {(r.o_row, r.o_n, r.o_s, r.o_m) for r in pairs.collect()}
    assert {(r.o_row, r.n, r.s, r.m) for r in found.collect()} == want and len(want) == 200
    lanes = blocks.filter("idx < 300").select("page", "idx", "y1", "y2")
    lane = {r.idx: r.lane for r in diagrams.assign_lane(blocks, lanes, ["page"]).collect()}
    assert lane == {i: i % 3 for i in range(600)}
    label = {r.idx: r.label for r in diagrams.legend_labels(blocks.drop("txt"), blocks, ["page"]).collect()}
    assert label == {i: f"t{i % 3}" for i in range(600)}
    assert met[0] > 20_000 and max(met[1:]) <= 120 * 120
    assert met[1] <= 12 and met[2] <= 9


def test_small_keys_take_one_window(spark):
    """Rows of small keys move once; larger ones are cut into buckets, with the same values."""
    df = spark.range(300).selectExpr("if(id % 7 = 0, null, id % 7) AS k", "id AS v", "if(id % 3 = 0, null, id) AS w")
    kinds = {"n": ("row_number", None), "s": ("sum", F.col("v")), "lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "was": ("lag", F.col("v")),
             "seen": ("last", F.col("w")), "to": ("next", F.col("w")), "least": ("min_before", F.col("v"))}
    one = running(df, ["k"], ["v"], tiles(F.col("v"), 32), kinds)
    assert one._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    limit, scan.WINDOW_ROWS = scan.WINDOW_ROWS, 10
    try:
        cut = running(df, ["k"], ["v"], tiles(F.col("v"), 32), kinds)
        assert cut.schema == one.schema and sorted(map(str, cut.collect())) == sorted(map(str, one.collect()))
    finally:
        scan.WINDOW_ROWS = limit


def test_cells_of_small_tables_stay_where_their_lines_are(spark, monkeypatch):
    """Cells of small tables are made and merged by table alone, with the rows of the way by tiles; null keys and repeated places included."""
    lines = [(t, i, 40 * i, 40 * i + 40) for t in (1, 2, None) for i in range(5)]
    rows = spark.createDataFrame([(t, i, 0, a, 200, b) for t, i, a, b in lines], "tbl long, idx long, x1 long, y1 long, x2 long, y2 long")
    cols = spark.createDataFrame([(t, i, a, 0, b, 200) for t, i, a, b in lines], rows.schema)
    spans = spark.createDataFrame([(1, 1, 0, 0, 80, 80), (1, 2, 0, 160, 80, 200), (2, 3, 900, 0, 999, 9), (None, 2, 0, 0, 80, 40)], rows.schema)

    def made():
        cells = tables.grid_cells(rows, cols, ["tbl"])
        # a place that comes twice, once outside the span, and cells without a row
        more = cells.filter("tbl = 1 AND row = 1 AND col = 1").selectExpr("tbl", "row", "col", "x1 + 100 AS x1", "y1", "x2 + 100 AS x2", "y2")
        none = cells.filter("tbl = 1 AND row < 3").selectExpr("tbl", "CAST(null AS bigint) AS row", "col", "x1", "y1", "x2", "y2")
        return cells, tables.merge_spans(cells.unionByName(more).unionByName(none), spans, ["tbl"])

    cells, merged = made()
    plan = merged._jdf.queryExecution().executedPlan().toString()
    assert "_tx" not in plan
    small = [sorted(map(str, df.collect())) for df in (cells, merged)]
    monkeypatch.setattr(tables, "TABLE_LINES", 0)
    assert small == [sorted(map(str, df.collect())) for df in made()]
    assert len(small[0]) == 75


def test_small_tables_are_drawn_in_one_move(spark, monkeypatch):
    """HTML and pipe tables of small tables have holes, repeated places and missing texts as those of large ones, without a join by slots."""
    rows = [(1, 0, 0, "a|b"), (1, 0, 2, "c"), (1, 2, 1, None), (1, 2, 0, "d"), (2, 0, 0, "x"), (2, 0, 0, "w"), (3, None, 1, "y"), (3, 1, None, "z"),
            (None, 0, 1, "n"), (4, 1, 1, "e"), (5, 0, 0, None)]
    cells = spark.createDataFrame(rows, "tbl long, row long, col long, txt string").selectExpr(
        "*", "1L AS row_span", "col + 1 AS col_span", "row = 0 AS is_header", "txt = 'c' AS low_confidence", "CAST(null AS double) AS confidence")
    ways = [lambda: tables.table_html(cells, ["tbl"]), lambda: tables.table_markdown(cells, ["tbl"]), lambda: tables.table_markdown(cells, ["tbl"], mark_low=True)]
    assert all("Join" not in way()._jdf.queryExecution().executedPlan().toString() for way in ways)
    small = [sorted(map(str, way().collect())) for way in ways]
    monkeypatch.setattr(tables, "TABLE_LINES", 0)
    assert small == [sorted(map(str, way().collect())) for way in ways]


def test_neighbours_of_many_rows_are_found_in_tasks_of_bounded_size(spark, monkeypatch):
    from foliospark.operators import scan, windows

    monkeypatch.setattr(scan, "TASK_ROWS", 20)
    rows = [(k if k else None, n) for k in range(40) for n in range(0, 10, 2)]
    out = windows.sequential_edges(spark.createDataFrame(rows, "page int, n int"), ["page"], "n", "n")
    assert out.rdd.getNumPartitions() == 10
    assert sorted(map(tuple, out.na.fill(0).collect())) == sorted((k or 0, n, n + 2) for k in range(40) for n in range(0, 8, 2))


def test_nearest_points_of_listed_targets_equal_those_of_cells(spark, monkeypatch):
    rows = [(k, i, (37.0 * i * i + k) % 900, (53.0 * i + 7 * k) % 700) for k in range(5) for i in range(30)]
    targets = spark.createDataFrame([*rows, (5, 1, None, 1.0)], "k int, tid int, x double, y double")
    points = [(k if k < 6 else None, i, 11.0 * i, 13.0 * k) for k in range(7) for i in range(25)] + [(1, 99, None, 0.0)]
    points = spark.createDataFrame(points, "k int, pid int, x double, y double")
    listed = set(rows_of(diagrams.nearest_point(points, targets, ["k"], "pid", "tid")))
    assert len(listed) == 5 * 25  # a point without a place used to be looked for without end
    monkeypatch.setattr(diagrams, "KEY_TARGETS", 1)
    assert set(rows_of(diagrams.nearest_point(points, targets, ["k"], "pid", "tid"))) == listed


def test_small_keys_are_matched_where_their_boxes_lie(spark, boxes, monkeypatch):
    """Matches, curves' hits and average precision of small keys, null ones and repeated ids too, equal those by tiles and candidates, which they don't go through."""
    page = F.when(F.col("page") != 1, F.col("page")).alias("page")
    gt = boxes.select(page, "label", (F.col("idx") % 40).alias("idx"), *g.SIDES)
    pred = boxes.select(page, F.when(F.col("idx") % 9 != 0, F.col("label")).alias("label"), (F.col("idx") % 45).alias("idx"), (F.col("x1") + 4).alias("x1"), "y1",
                        (F.col("x2") + 4).alias("x2"), (F.col("y2") + F.col("idx") % 5).alias("y2"), (F.col("idx") * 7 % 11 / 10.0).cast("double").alias("score"))
    pred = pred.unionByName(pred.filter("idx % 4 = 0"))
    for n, side in enumerate(g.SIDES):  # boxes without a start or an end
        pred, gt = (df.withColumn(side, F.when((F.col("x1") + F.col("y1")) % 13 != k + n, F.col(side))) for df, k in ((pred, 0), (gt, 3)))
    keys = ["page", "label"]
    ap = lambda **how: sorted(((r.page or -1, r.label or "", r.thr), round(r.ap, 9)) for r in detection.average_precision(pred, gt, [0.3, 0.5, 0.75], **how).collect())
    match = lambda **how: rows_of(detection.match_detections(pred, gt, keys, 0.3, -F.col("score"), **how).select(*keys, "p", "g", F.round("iou", 9).alias("iou")))
    by_tiles, found = ap(limit=0), match(limit=0)
    monkeypatch.setattr(detection, "candidates", None)
    assert ap() == by_tiles and len({v for _, v in by_tiles}) > 3
    assert match() == found and found


def test_bars_of_small_pages_are_merged_where_they_lie(spark, boxes, monkeypatch):
    """Equal bars and all; the rows are those of a page cut into bands, which is not done."""
    pages = boxes.select("page").distinct().withColumn("w", F.lit(1900)).withColumn("h", F.lit(1900))
    bars = boxes.select("page", *g.SIDES)
    bars = bars.unionByName(bars.filter("x1 % 3 = 0"))
    whole, real = rows_of(windows.merge_bars(bars, pages, ["page"])), windows.islands
    monkeypatch.setattr(windows, "islands", None)
    assert whole == rows_of(windows.merge_bars(bars, pages, ["page"]))
    monkeypatch.setattr(windows, "islands", real)
    monkeypatch.setattr(groups, "FOLD_LIMIT", 0)
    assert whole == rows_of(windows.merge_bars(bars, pages, ["page"]))


def test_parts_of_small_tables_meet_by_table_alone(spark, monkeypatch):
    """Boundary cells, cut words and dense grids of small tables, ids and keys that repeat or lack too, equal those by tiles and slots, which they don't go through."""
    rnd, keys = random.Random(9), ["tbl"]
    lines = {kind: [] for kind in ("row", "col", "span")}
    for t in (1, 2, None):
        for k in range(1, 7):
            lines["row"].append((t, k, 0, 40 * k - 40, 400, 40 * k, "h"))
            lines["col"].append((t, k, 70 * k - 70, 0, 70 * k, 240, "h"))
            a, b = rnd.randrange(5), rnd.randrange(5)
            lines["span"].append((t, rnd.choice([1, 2, 3, None]), 70 * a, 40 * b, 70 * a + rnd.choice([70, 140]), 40 * b + rnd.choice([40, 85]), "s"))
            lines["span"].append((t, 7 + k, *((None if side == k - 1 else v) for side, v in enumerate((70 * a, 40 * b, 70 * a + 140, 40 * b + 80))), "s"))
    frame = {k: spark.createDataFrame(v, "tbl long, idx long, x1 long, y1 long, x2 long, y2 long, kind string") for k, v in lines.items()}
    words = spark.createDataFrame([(t, rnd.choice([*range(30), None]), x := rnd.randrange(400), y := rnd.randrange(230), x + rnd.choice([10, 60]), y + rnd.choice([20, 45]), 0.5)
                                   for t in (1, 2, 2, 3, None) for _ in range(30)], "page long, n long, x1 long, y1 long, x2 long, y2 long, score double")
    words = words.select("page", "n", g.quad_of_box(g.box()).alias("quad"), "score")
    tables_ = spark.createDataFrame([(t, t, 0, 0, 390, 240) for t in (1, 2, 2, None)], "page long, tbl long, x1 long, y1 long, x2 long, y2 long")
    paged = lambda df: df.withColumn("page", F.col("tbl"))
    cells = spark.createDataFrame([(t, r, c, rs, 1, 70 * c - 70, 40 * r - 40, 70 * c, 40 * (r + rs - 1), f"{r}.{c}") for t in (1, 2, None) for r in range(1, 6) for c in range(1, 6)
                                   for rs in (1, 2) if rnd.random() < 0.7], "tbl long, row long, col long, row_span long, col_span long, x1 int, y1 int, x2 int, y2 int, txt string")
    size = spark.createDataFrame([(1, 6, 5), (2, 3, 7), (2, 2, 2), (None, 2, 2), (4, 1, 1)], "tbl long, n_row long, n_col long")

    def all_of():
        heads = frame["row"].filter("idx = 1 OR idx = 4")
        grid = tables.table_grid(cells, size, keys)
        return (rows_of(tables.boundary_cells(frame["row"], frame["col"], heads, frame["span"], keys).select("tbl", "row", "col", *g.SIDES, "header_type", "is_header", "row_span", "col_span", "txt")),
                rows_of(tables.split_words_at_cells(words, tables_, paged(frame["row"]), paged(frame["col"]), paged(cells), "page", "tbl")),
                rows_of(grid.select("tbl", "r", "c", "txt")), sorted((r.tbl, r.r, sorted(r.record.items())) for r in tables.table_records(grid.distinct(), keys).collect()))

    monkeypatch.setattr(tables, "TABLE_LINES", 0)
    monkeypatch.setattr(tables, "TABLE_CELLS", 0)
    monkeypatch.setattr(ob, "KEY_LINES", 0)
    by_tiles = all_of()
    monkeypatch.undo()
    for name in ("overlap_pairs", "contained_pairs"):
        monkeypatch.setattr(spatial, name, None)
    got = all_of()
    assert all(a == b for a, b in zip(got, by_tiles)) and all(got)
