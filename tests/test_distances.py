"""Regions of large pages: tiles against the distances of all pairs."""

import random

import numpy as np
import pytest

from foliospark.operators import distances, reading


def blocks_of(spark, pages):
    rows = [(p, i, *xy, xy[0] + 2, xy[1] + 2, 1000, 1000) if xy else (p, i, None, None, None, None, 1000, 1000)
            for p, places in pages.items() for i, xy in enumerate(places)]
    return spark.createDataFrame(rows, "page long, idx long, x1 long, y1 long, x2 long, y2 long, w long, h long")


def regions(blocks, limit):
    rows = reading.region_components(blocks, ["page"], "w", "h", limit).collect()
    return sorted((-1 if r.page is None else r.page, r.idx, r.region) for r in rows)


def pages():
    rng = random.Random(5)
    spot = lambda x, y, r, n: [(x + rng.randrange(r), y + rng.randrange(r)) for _ in range(n)]
    return {
        1: spot(0, 0, 1000, 300),
        2: spot(0, 0, 8, 200) + spot(900, 0, 30, 60) + spot(0, 940, 5, 40),  # a dense spot with two thirds of all blocks
        3: spot(0, 0, 1, 150) + spot(100, 100, 800, 50),  # the median is 0
        4: spot(7, 7, 1, 90),  # one place only
        5: [(20 * i, 500) for i in range(50)] + [None] * 10,  # a line, and blocks without a place
        6: spot(0, 0, 1000, 20) + [None] * 60,  # the median falls on blocks without a place
        7: [None] * 12,
        None: spot(0, 0, 20, 120) + spot(500, 500, 20, 20) + spot(980, 0, 20, 9),
    }


def test_tiles_equal_all_pairs(spark, monkeypatch):
    """Also when tiles are halved to the end, and when cells are."""
    blocks = blocks_of(spark, pages())
    whole = regions(blocks, 10**6)
    assert len({r[2] for r in whole if r[0] == -1}) > 1 and len({r[2] for r in whole if r[0] == 3}) > 1
    assert regions(blocks, 10) == whole
    monkeypatch.setattr(distances, "PAIRS", 500)
    assert regions(blocks, 10) == whole


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_median(spark, monkeypatch, seed):
    monkeypatch.setattr(distances, "PAIRS", 2000)
    rng = np.random.default_rng(seed)
    xy = np.unique(np.concatenate([rng.random((900, 2)), rng.normal(0.3, 0.001, (600, 2))]), axis=0)
    n = rng.integers(1, 4, len(xy))
    places = spark.createDataFrame([("p", float(x), float(y), int(c)) for (x, y), c in zip(xy, n)], "of string, x double, y double, c long")
    sizes = spark.createDataFrame([("p", int(n.sum()))], "of string, blocks long")
    every = np.repeat(xy, n, axis=0)
    assert distances.median_distances(places, sizes).first().median == reading.median_distance(every[:, 0], every[:, 1])


def test_three_thousand_blocks(spark):
    rng = random.Random(9)
    blocks = blocks_of(spark, {1: [(rng.randrange(300) + 650 * (i % 2), rng.randrange(1000)) for i in range(3000)]})
    assert regions(blocks, 10) == regions(blocks, 10**6)


def test_no_task_sees_a_whole_page(spark):
    blocks = blocks_of(spark, {1: [(i, i) for i in range(30)]})
    plan = distances.regions(blocks.selectExpr("cast(page AS string) AS of", "idx", "x1 / w AS x", "y1 / h AS y"))._jdf.queryExecution().toString()
    assert "MapInPandas" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
