"""Box joins on a tile grid.

Boxes of one page are only compared when they share a grid tile, so a page with very many boxes is spread over its
tiles instead of being compared pair by pair in one task. A box enters every tile it touches; page sides are pixel
counts, which bounds the tiles of a box (the largest sheet at 600 dpi has about 2,000).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from foliospark.functions.geometry import SIDES, Box, box, is_contained
from foliospark.operators.groups import join_null_safe

TILE = 512
TILE_KEYS = ["_tx", "_ty"]


def _cell(c: Column) -> Column:
    return F.floor(c / F.lit(float(TILE)))


def _span(lo: Column, hi: Column) -> Column:
    return F.sequence(lo, F.greatest(hi, lo))


def _in_tiles(df: DataFrame, b: Box, slack: int = 0) -> DataFrame:
    """One row per tile that the closed box touches."""
    df = df.withColumn("_tx", F.explode(_span(_cell(b.x1 - slack), _cell(b.x2 + slack))))
    return df.withColumn("_ty", F.explode(_span(_cell(b.y1 - slack), _cell(b.y2 + slack))))


def prefixed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.select(*keys, *(F.col(c).alias(prefix + c) for c in df.columns if c not in keys))


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], x: Column, y: Column) -> DataFrame:
    """All (point row, box row) pairs with the point in the closed box, give or take a pixel; box columns get the
    prefix `o_`. A point lies in one tile, so no pair comes twice."""
    left = points.withColumn("_px", x).withColumn("_py", y)
    left = left.withColumn("_tx", _cell(F.col("_px"))).withColumn("_ty", _cell(F.col("_py")))
    right = prefixed(_in_tiles(boxes, box(), 1), keys + TILE_KEYS, "o_")
    o = box("o_")
    inside = F.col("_px").between(o.x1 - 1, o.x2 + 1) & F.col("_py").between(o.y1 - 1, o.y2 + 1)
    return join_null_safe(left, right, keys + TILE_KEYS).filter(inside).drop(*TILE_KEYS)


def contained_pairs(inner: DataFrame, outer: DataFrame, keys: list[str], thr: float) -> DataFrame:
    """Pairs where more than `thr` of the inner box lies in the outer box; outer columns get the prefix `o_`.

    Covering more than half of a box in area means covering more than half of each side, hence its centre: from a
    threshold of one half on an inner box is placed by its centre only.
    """
    hit = is_contained(box("o_"), box(), thr)
    if thr < 0.5:
        return overlap_pairs(inner, outer, keys).filter(hit)
    b = box()
    pairs = points_in_boxes(inner, outer, keys, (b.x1 + b.x2) / 2.0, (b.y1 + b.y2) / 2.0)
    return pairs.filter(hit).drop("_px", "_py")


def listed(boxes: DataFrame, keys: list[str], name: str) -> DataFrame:
    """The boxes of each key as one list. For few boxes a key."""
    return boxes.groupBy(*keys).agg(F.collect_list(F.struct(*(c for c in boxes.columns if c not in keys))).alias(name))


def containing(boxes: str, thr: float) -> Column:
    """Those of a list of boxes that contain the row's box, as `contained_pairs` finds them."""
    b = box()
    x, y = (b.x1 + b.x2) / 2.0, (b.y1 + b.y2) / 2.0

    def hit(e: Column) -> Column:
        o = Box(*(e[s] for s in SIDES))
        near = x.between(o.x1 - 1, o.x2 + 1) & y.between(o.y1 - 1, o.y2 + 1)
        return (near if thr >= 0.5 else F.lit(True)) & is_contained(o, b, thr)

    return F.filter(boxes, hit)


def meets(a: Box, b: Box) -> Column:
    """Whether `overlap_pairs` would pair two boxes: a box without a start meets nothing; one without an end goes as far as the other
    one, but stands only in the tile of its start."""
    left, top = F.greatest(a.x1, b.x1), F.greatest(a.y1, b.y1)
    out = (F.least(a.x2, b.x2) > left) & (F.least(a.y2, b.y2) > top)
    for o in (a, b):
        out = out & o.x1.isNotNull() & o.y1.isNotNull()
        out = out & (o.x2.isNotNull() | (_cell(left) == _cell(o.x1))) & (o.y2.isNotNull() | (_cell(top) == _cell(o.y1)))
    return F.coalesce(out, F.lit(False))


def overlap_pairs(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs with a positive overlap; columns of `b` get the prefix `o_`.

    Each pair comes once: from the tile that holds the top-left corner of the overlap.
    """
    me, o = box(), box("o_")
    right = prefixed(_in_tiles(b, me), keys + TILE_KEYS, "o_")
    left_x, top_y = F.greatest(me.x1, o.x1), F.greatest(me.y1, o.y1)
    here = (
        (F.least(me.x2, o.x2) > left_x) & (F.least(me.y2, o.y2) > top_y)
        & (_cell(left_x) == F.col("_tx")) & (_cell(top_y) == F.col("_ty"))
    )
    return join_null_safe(_in_tiles(a, me), right, keys + TILE_KEYS).filter(here).drop(*TILE_KEYS)


def points_in_bands(
    points: DataFrame, bands: DataFrame, keys: list[str], at: Column, lo: str, hi: str, width: float
) -> DataFrame:
    """1-D version: pairs with lo <= at <= hi. Band columns get the prefix `o_`."""
    left = points.withColumn("_at", at).withColumn("_cell", F.floor(at / F.lit(float(width))))
    cell = lambda c: F.floor(F.col(c) / F.lit(float(width)))
    spans = _span(cell(lo), cell(hi))
    right = prefixed(bands.withColumn("_cell", F.explode(spans)), keys + ["_cell"], "o_")
    hit = (F.col("_at") >= F.col("o_" + lo)) & (F.col("_at") <= F.col("o_" + hi))
    return left.join(right, keys + ["_cell"]).filter(hit).drop("_cell")


def nearest(
    points: DataFrame, targets: DataFrame, keys: list[str], at: str, value: str, idx: str, width: float
) -> DataFrame:
    """Nearest target on a line for every point row: adds near_value, near_idx. Ties take the lower index.

    Both sides are merged into one sorted line per key; the nearest target is the last one before or the first
    one after the point. No pair of a point and a target is formed.
    """
    from foliospark.operators.scan import running, tiles

    marks = targets.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.min(idx).alias("_idx"))
    spots = points.select(*keys, F.col(at).cast("double").alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    line = spots.select(*keys, "_v", F.lit(None).cast("struct<v:double,i:bigint>").alias("_mark"), F.lit(1).alias("_side"))
    marked = marks.select(
        *keys, "_v", F.struct(F.col("_v").alias("v"), F.col("_idx").cast("bigint").alias("i")).alias("_mark"),
        F.lit(0).alias("_side"),
    )
    both = line.unionByName(marked)
    up = running(both, keys, ["_v", "_side"], tiles(F.col("_v"), width), {
        "_low": ("last", F.col("_mark")), "_high": ("next", F.col("_mark"))})
    dl, dh = F.col("_v") - F.col("_low.v"), F.col("_high.v") - F.col("_v")
    take_low = F.col("_high").isNull() | (dl < dh) | ((dl == dh) & (F.col("_low.i") <= F.col("_high.i")))
    best = F.when(F.col("_low").isNotNull() & take_low, F.col("_low")).otherwise(F.col("_high"))
    found = up.filter(F.col("_side") == 1).select(*keys, "_v", best.alias("_best"))
    out = points.withColumn("_v", F.col(at).cast("double")).join(found, keys + ["_v"], "left")
    return (
        out.withColumn("near_value", F.col("_best.v")).withColumn("near_idx", F.col("_best.i")).drop("_v", "_best")
    )
