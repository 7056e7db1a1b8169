"""Reading graphs: the sweep against all pairs, components, walks by component against whole walks, null pages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import graph, groups, reading

WAYS = ("top2bottom", "right2left", "left2right")


def random_boxes(rng, n, size=400, wide=60):
    x, y = rng.integers(0, size, n), rng.integers(0, size, n)
    return np.stack([x, y, x + rng.integers(1, wide, n), y + rng.integers(1, wide // 2, n)], axis=1).astype(float)


@pytest.mark.parametrize("way", WAYS)
def test_sweep_sees_what_all_pairs_see(way):
    rng = np.random.default_rng(7)
    for n, size, wide in ((0, 9, 9), (1, 9, 9), (60, 30, 12), (300, 400, 60), (500, 40, 9), (400, 4000, 900)):
        box = random_boxes(rng, n, size, wide)
        want = set(zip(*(x.tolist() for x in graph._seen_dense(box, way)), strict=True))
        keep, graph.DENSE = graph.DENSE, -1
        try:
            got = set(zip(*(x.tolist() for x in graph.seen(box, way)), strict=True)) if n else set()
        finally:
            graph.DENSE = keep
        assert got == want


def random_graph(rng, n, cyclic):
    children = [[] for _ in range(n)]
    for _ in range(int(n * rng.choice([0.4, 0.8, 1.3]))):
        a, b = rng.randrange(n), rng.randrange(n)
        if a != b and (cyclic or a < b) and b not in children[a]:
            children[a].append(b)
    return children


def parts_of(children):
    root = list(range(len(children)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for s, ends in enumerate(children):
        for d in ends:
            root[max(find(s), find(d))] = min(find(s), find(d))
    out = {}
    for i in range(len(children)):
        out.setdefault(find(i), []).append(i)
    return list(out.values())


def test_bursts_of_components_merge_to_one_walk():
    rng = random.Random(11)
    for trial in range(1500):
        n = rng.randint(1, 24)
        children = random_graph(rng, n, trial % 2)
        distance = [rng.randint(0, 6) for _ in range(n)]
        merged = []
        for part in parts_of(children):
            at = {x: k for k, x in enumerate(part)}
            starts = sorted(range(len(part)), key=lambda k: distance[part[k]])
            for generation, start, places, order in graph.bursts([[at[d] for d in children[x]] for x in part], starts):
                merged.append(((generation, distance[part[start]], part[start], places), [part[k] for k in order]))
        got = [i for _, order in sorted(merged) for i in order]
        assert got == reading.walk(children, distance)


def test_components_equal_plain_ones(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(n, n + 1) for n in range(1000, 1080)] + [(None, 3), (4, None), (9, 9)]
    want = {}
    children = [[] for _ in range(1300)]
    for a, b in edges:
        if a is not None and b is not None and a != b:
            children[a].append(b)
    for part in parts_of(children):
        if len(part) > 1:
            want |= dict.fromkeys(part, min(part))
    found = graph.components(spark.createDataFrame(edges, "a long, b long"))
    assert {r.node: r.component for r in found.collect()} == want
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def pages(spark, sizes, seed=3):
    rng, rows = np.random.default_rng(seed), []
    for page, (n, way, size) in sizes.items():
        rows += [(page, i, *map(float, b), way) for i, b in enumerate(random_boxes(rng, n, size, 40))]
    return spark.createDataFrame(rows, "page string, idx long, x1 double, y1 double, x2 double, y2 double, way string").repartition(5)


def test_pages_walk_alike_whole_and_by_component(spark):
    boxes = pages(spark, {"a": (60, "top2bottom", 900), "b": (50, "right2left", 600), None: (40, "left2right", 700), "one": (1, "top2bottom", 9)})
    order = lambda **how: sorted((r.page or "", r.idx, r.pos) for r in reading.priority_order(boxes, ["page"], F.col("way"), **how).collect())
    whole = order()
    assert order(limit=3) == whole
    assert [r[2] for r in whole if r[0] == ""] != [0] * 40 and sorted(r[2] for r in whole if r[0] == "") == list(range(40))


@pytest.mark.parametrize("way", WAYS)
def test_edges_of_null_pages_swept_and_in_zones(spark, monkeypatch, way):
    boxes = pages(spark, {"a": (50, way, 300), None: (50, way, 300)}).drop("way")
    edges = lambda: sorted((r.page or "", r.src, r.dst) for r in reading.precedence_edges(boxes, ["page"], way).collect())
    swept = edges()
    assert {r[0] for r in swept} == {"", "a"}
    monkeypatch.setattr(reading, "EDGE_LIMIT", 2)
    assert edges() == swept


def test_null_pages_in_cells_regions_and_paths(spark):
    words = spark.createDataFrame([(p, n, 10.0 * n, 0.0, 10.0 * n + 8, 8.0, f"w{n}", "horizontal") for p in (None, "a") for n in range(3)],
                                  "page string, n long, x1 double, y1 double, x2 double, y2 double, content string, direction string")
    cells = spark.createDataFrame([(None, 0, -1.0, -1.0, 50.0, 9.0), ("a", 0, -1.0, -1.0, 50.0, 9.0)], "page string, idx long, x1 double, y1 double, x2 double, y2 double")
    assert [r.text for r in reading.cell_texts(cells, words, ["page"]).collect()] == ["w0\nw1\nw2"] * 2
    blocks = words.select("page", F.col("n").alias("idx"), "x1", "y1", "x2", "y2", F.lit(0).alias("region"), F.lit(100.0).alias("w"))
    edges = reading.region_edges(blocks, ["page"])
    assert edges.where("page IS NULL").count() == edges.where("page = 'a'").count() == 2
    more = edges.select("page", "src", "dst").union(spark.createDataFrame([(None, 0, 77), ("b", 1, 2)], "page string, src long, dst long"))
    path = reading.reading_path(blocks, more, ["page"], "w").collect()
    assert sorted((r.page or "", r.pos) for r in path) == [("", 0), ("", 1), ("", 2), ("a", 0), ("a", 1), ("a", 2)]


def test_sorted_scans_keep_null_keys_together(spark):
    df = spark.createDataFrame([(None, float(n)) for n in range(5)] + [("a", 1.0)], "k string, v double")
    count = groups.scan_sorted(df, ["k"], ["v"], lambda s: (0, [] if s is None else [(s,)]), lambda s, row: (s + 1, []), "n long")
    assert sorted(r.n for r in count.collect()) == [1, 5]


@pytest.mark.parametrize("direction", ["top2bottom", "right2left", "left2right"])
def test_many_groups_equal_one_by_one(direction):
    """Groups taken together give the edges, walks and regions of each alone."""
    rnd = random.Random(3)
    pages = [[[x := rnd.randrange(60), y := rnd.randrange(60), x + rnd.randrange(1, 30), y + rnd.randrange(1, 30)] for _ in range(n)]
             for n in [1, 2, 4, 0, 9, 80, 3, 64, 65, 1] + [rnd.randrange(1, 12) for _ in range(60)]]
    pages = [p for p in pages if p]
    box = np.array([b for p in pages for b in p], float)
    cuts = np.concatenate([[0], np.cumsum([len(p) for p in pages])])
    found = set(zip(*(x.tolist() for x in graph.group_edges(box, cuts, direction))))
    orders = reading._orders(box, cuts, np.array([direction] * len(pages))).tolist()
    small = np.array([len(p) <= graph.SMALL for p in pages])
    keep = np.repeat(small, np.diff(cuts))
    regions = reading._small_regions(box[keep, 0], box[keep, 1], np.diff(cuts)[small])
    single = [reading._regions(box[a:b, 0], box[a:b, 1]) for a, b, s in zip(cuts, cuts[1:], small) if s]
    assert regions.tolist() == np.concatenate(single).tolist()
    for a, b in zip(cuts, cuts[1:]):
        src, dst = graph.edges(box[a:b], direction)
        assert {(s - a, d - a) for s, d in found if a <= s < b} == set(zip(src.tolist(), dst.tolist()))
        children, distance = reading._page_graph(box[a:b], direction)
        assert [i - a for i in orders[a:b]] == reading.walk(children, distance.tolist())


def test_groups_are_handed_over_together(spark):
    """Very many small groups must not each cost a frame: one call sees all whole groups of an Arrow batch."""
    df = spark.range(2000).selectExpr("if(id < 4, null, id div 4) AS k", "id AS i").coalesce(1)

    def sizes(batch, cuts):
        return batch[["k"]].iloc[cuts[:-1]].assign(n=np.diff(cuts), calls=[1.0] + [0.0] * (len(cuts) - 2))

    out = groups.map_batches(df, ["k"], ["i"], sizes, "k bigint, n bigint, calls double").collect()
    assert len(out) == 500 and {r.n for r in out} == {4} and sum(r.k is None for r in out) == 1
    assert sum(r.calls for r in out) < 100


def test_unions_are_placed_again(spark):
    """A union of parts that are each placed by key isn't taken as placed: its parts may have been merged in other ways."""
    from pyspark.sql import Window

    by_key = Window.partitionBy("k").orderBy("i")
    part = lambda n: spark.range(n).selectExpr("id % 50 AS k", "id AS i").withColumn("n", F.row_number().over(by_key))
    out = groups.map_batches(part(100).unionByName(part(5000)), ["k"], ["i"], lambda b, cuts: b[["k"]].iloc[cuts[:-1]], "k bigint")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan[: plan.index("Union")]
    assert sorted(r.k for r in out.collect()) == list(range(50))


def test_pages_of_some_thousand_boxes_are_walked_in_a_task(spark, monkeypatch):
    """Such a page is walked whole, beside others; the rounds of jobs by component are for pages that no task should hold."""
    def refuse(*_):
        raise AssertionError("searched for components")

    rows = [(page, k, 60 * (k % 12), 30 * (k // 12), 60 * (k % 12) + 50, 30 * (k // 12) + 24) for page, n in ((1, 3000), (2, 30)) for k in range(n)]
    boxes = spark.createDataFrame(rows, "page long, idx long, x1 long, y1 long, x2 long, y2 long")
    monkeypatch.setattr(graph, "components", refuse)
    got = reading.priority_order(boxes, ["page"], F.lit("left2right")).collect()
    # lines one after another, each from its left end
    assert sorted((r.page, r.idx) for r in got) == [r[:2] for r in rows] and all(r.pos == r.idx for r in got)
