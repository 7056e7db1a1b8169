"""Distances between all points of a page, without forming all pairs: tiles stand for the points in them.

Of two tiles only the least and the greatest distance of their points are known; both come from the points' own extents by
steps that never turn an order round, so they hold for the rounded distances as well. Tile pairs are halved along both axes
as long as they are undecided.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliospark.operators import graph
from foliospark.operators.scan import ranked, running, tiles
from foliospark.session import cut_lineage, stored

#: Finest halving of a page or cell.
DEPTH = 20
#: Point pairs that are formed at once without halving their tiles further.
PAIRS = 4_000_000
#: Bins of a histogram of distances.
BINS = 4096


def _distance(dx: Column, dy: Column) -> Column:
    return F.sqrt(dx * dx + dy * dy)


def _tiles(points: DataFrame, level: int, halves: bool) -> DataFrame:
    """tile (area, tx, ty), its extents, n (blocks) and m (places); with `halves` also the tile of the level before as `up`."""
    at = lambda c: F.shiftright(c, DEPTH - level)
    out = points.groupBy(F.struct("area", at("fx").alias("tx"), at("fy").alias("ty")).alias("tile")).agg(
        F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"),
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("m"))
    up = F.struct(F.col("tile.area").alias("area"), F.shiftright("tile.tx", 1).alias("tx"), F.shiftright("tile.ty", 1).alias("ty"))
    return out.withColumn("up", up) if halves else out


def _bounded(pairs: DataFrame) -> DataFrame:
    """Pairs of tiles (columns l, r) with the least and greatest distance of their points and their numbers of pairs."""
    gap = lambda a, b: F.greatest(F.lit(0.0), F.col(f"l.{a}") - F.col(f"r.{b}"), F.col(f"r.{a}") - F.col(f"l.{b}"))
    far = lambda a, b: F.greatest(F.col(f"l.{b}") - F.col(f"r.{a}"), F.col(f"r.{b}") - F.col(f"l.{a}"))
    same = F.col("l.tile") == F.col("r.tile")
    n = F.when(same, F.expr("l.n * (l.n - 1) div 2")).otherwise(F.col("l.n") * F.col("r.n"))
    return pairs.select(
        "of", F.col("l.tile").alias("a"), F.col("r.tile").alias("b"), _distance(gap("x1", "x2"), gap("y1", "y2")).alias("least"),
        _distance(far("x1", "x2"), far("y1", "y2")).alias("most"), n.alias("n"), (F.col("l.m") * F.col("r.m")).alias("m"))


def _halved(pairs: DataFrame, points: DataFrame, level: int) -> DataFrame:
    """The pairs of tiles of `level` that make up the given pairs of the level before."""
    cut = stored(_tiles(points, level, True), "tiles")
    side = lambda up, name: cut.select(F.col("up").alias(up), F.struct("tile", "x1", "x2", "y1", "y2", "n", "m").alias(name))
    found = pairs.select("of", "a", "b").join(side("a", "l"), "a").join(side("b", "r"), "b")
    return _bounded(found.filter((F.col("a") != F.col("b")) | (F.col("l.tile") <= F.col("r.tile"))))


def _point_pairs(pairs: DataFrame, points: DataFrame, level: int) -> DataFrame:
    """of, d, n: distances of the points of two tiles. Points of one place have the distance 0."""
    at = lambda c: F.shiftright(c, DEPTH - level)
    tile = F.struct("area", at("fx").alias("tx"), at("fy").alias("ty"))
    side = lambda t, name: points.select(tile.alias(t), F.struct("x", "y", "c").alias(name))
    found = pairs.select("of", "a", "b").join(side("a", "l"), "a").join(side("b", "r"), "b")
    found = found.filter((F.col("a") != F.col("b")) | (F.col("l") <= F.col("r")))
    same = (F.col("a") == F.col("b")) & (F.col("l") == F.col("r"))
    n = F.when(same, F.expr("l.c * (l.c - 1) div 2")).otherwise(F.col("l.c") * F.col("r.c"))
    d = _distance(F.col("l.x") - F.col("r.x"), F.col("l.y") - F.col("r.y"))
    return found.select("of", d.alias("d"), n.alias("n")).filter("n > 0")


def _few(pairs: DataFrame, level: int) -> bool:
    """Whether to form point pairs now: they are few, or halved tiles would be as many."""
    size = pairs.agg(F.count(F.lit(1)), F.coalesce(F.sum("m"), F.lit(0))).first()
    return level >= DEPTH or size[1] <= max(PAIRS, 16 * size[0])


def _fine(c: Column) -> Column:
    """Place within an area, 0 to 1, as a tile of the finest level."""
    whole = 1 << DEPTH
    return F.least(F.greatest(F.coalesce(F.floor(c * whole), F.lit(0)), F.lit(0)), F.lit(whole - 1)).cast("int")


def _cut(found: DataFrame, value: str, pick: str, name: str, best) -> DataFrame:
    """Per page, a bound of the distance at rank `pick`: the bin where the counts pass the rank, and its extreme value."""
    bins = found.groupBy("of", pick, "below", F.floor(F.col(value) / F.col("span") * BINS).alias("bin")).agg(
        F.sum("n").alias("n"), best(value).alias("v"))
    upto = F.sum("n").over(Window.partitionBy("of").orderBy("bin"))
    return bins.withColumn("upto", upto + F.col("below")).filter(F.col("upto") > F.col(pick)).groupBy("of").agg(F.min("v").alias(name))


def median_distances(places: DataFrame, sizes: DataFrame) -> DataFrame:
    """of, median: exact median distance of all pairs of a page's points.

    `places` holds (of, x, y, c) with every place once, `sizes` (of, blocks): pairs with a block without a place count as the
    longest, and a median that falls among them is null. In each round the counts of tile pairs by their least and by
    their greatest distance bound the median, and only pairs of tiles that reach between the bounds are halved.
    """
    ends = places.groupBy("of").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.sum("c").alias("with_place"), F.greatest(
        F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("span"))
    pages = sizes.join(ends, "of", "left").withColumn("pairs", F.expr("blocks * (blocks - 1) div 2"))
    pages = pages.withColumn("k1", F.expr("(pairs - 1) div 2")).withColumn("k2", F.expr("pairs div 2"))
    pages = stored(pages.withColumn("known", F.expr("k2 < with_place * (with_place - 1) div 2")), "pages")
    flat = pages.filter("known AND span = 0").select("of", F.lit(0.0).alias("median"))
    state = pages.filter("known AND span > 0").select(
        "of", "x0", "y0", "span", "k1", "k2", F.lit(0).cast("bigint").alias("below"), F.lit(0.0).alias("lo"), F.lit(float("inf")).alias("hi"))
    points = stored(places.join(state.select("of", "x0", "y0", "span"), "of").select(
        F.col("of").alias("area"), _fine((F.col("x") - F.col("x0")) / F.col("span")).alias("fx"),
        _fine((F.col("y") - F.col("y0")) / F.col("span")).alias("fy"), "x", "y", "c"), "points")
    level = 3
    first = stored(_tiles(points, level, False), "tiles").select(F.col("tile.area").alias("of"), F.struct("*").alias("l"))
    pairs = _bounded(first.join(first.withColumnRenamed("l", "r"), "of").filter("l.tile <= r.tile"))  # of at most 64 tiles a page
    while True:
        pairs = cut_lineage(pairs)
        found = pairs.join(state.drop("x0", "y0"), "of")
        low, high = _cut(found, "least", "k1", "l_", F.min), _cut(found, "most", "k2", "h_", F.max)
        state = state.join(low, "of").join(high, "of").withColumn("lo", F.greatest("lo", "l_")).withColumn("hi", F.least("hi", "h_")).drop("l_", "h_")
        state = cut_lineage(state)
        found = pairs.join(state.select("of", "lo", "hi"), "of")
        passed = found.filter("most < lo").groupBy("of").agg(F.sum("n").alias("p_"))
        state = state.join(passed, "of", "left").withColumn("below", F.col("below") + F.coalesce("p_", F.lit(0))).drop("p_")
        state = cut_lineage(state)
        pairs = cut_lineage(found.filter("most >= lo AND least <= hi").drop("lo", "hi"))
        if _few(pairs, level):
            break
        level += 1
        pairs = _halved(pairs, points, level)
    values = _point_pairs(pairs, points, level).groupBy("of", "d").agg(F.sum("n").alias("n"))
    values = cut_lineage(values.join(state.select("of", "k1", "k2", "below", "span"), "of"))
    upto = running(values, ["of"], ["d"], F.floor(F.col("d") / F.col("span") * BINS), {"upto": ("sum", F.col("n"))})
    upto = upto.withColumn("upto", F.col("upto") + F.col("below"))
    at = lambda k: F.min(F.when(F.col("upto") > F.col(k), F.col("d")))
    exact = upto.groupBy("of").agg(((at("k1") + at("k2")) / 2).alias("median"))
    none = pages.filter("NOT coalesce(known, false)").select("of", F.lit(None).cast("double").alias("median"))
    return exact.unionByName(flat).unionByName(none)


def linked_places(places: DataFrame, reach: DataFrame) -> DataFrame:
    """of, x, y, region_of: places of a page joined by steps of at most `eps`; `region_of` names the component.

    `places` holds (of, x, y), `reach` (of, eps). Points of one cell, half of eps wide, are always joined, so cells are the nodes of the
    graph. Two cells up to three apart are joined as soon as a pair of their tiles lies wholly within eps; undecided
    tiles are halved, and point pairs are formed only for what is left. Without eps every place stands alone.
    """
    half = F.col("eps") / 2
    wide = F.coalesce(F.col("eps") > 0, F.lit(False))
    rows = places.join(reach, "of")
    cell = lambda c: F.when(wide, F.floor(F.col(c) / half).cast("double")).otherwise(F.col(c))
    rows = stored(rows.withColumn("area", F.struct("of", cell("x").alias("cx"), cell("y").alias("cy"))), "cells")
    inside = lambda c: _fine(F.col(c) / half - F.col(f"area.c{c}"))
    points = stored(rows.filter(wide).select("area", inside("x").alias("fx"), inside("y").alias("fy"), "x", "y", F.lit(1).alias("c")), "points")
    cells = stored(_tiles(points, 0, False), "tiles").select(F.col("tile.area").alias("area"), F.struct("*").alias("l"))
    steps = F.array(*(F.struct(F.lit(float(i)).alias("i"), F.lit(float(j)).alias("j")) for i in range(4) for j in range(-3, 4) if (i, j) > (0, 0)))
    moved = F.struct(F.col("area.of").alias("of"), (F.col("area.cx") + F.col("s.i")).alias("cx"), (F.col("area.cy") + F.col("s.j")).alias("cy"))
    near = cells.withColumn("s", F.explode(steps)).select(F.col("area").alias("of_a"), moved.alias("area"), "l")
    near = near.join(cells.withColumnRenamed("l", "r"), "area").select(F.struct(F.col("of_a").alias("a"), F.col("area").alias("b")).alias("of"), "l", "r")
    pairs, level, links = _bounded(near), 0, None
    while True:
        pairs = cut_lineage(pairs.withColumn("page", F.col("of.a.of")).join(reach.withColumnRenamed("of", "page"), "page").filter("least <= eps"))
        done = cut_lineage(pairs.filter("most <= eps").select("of").distinct())
        links = done if links is None else links.unionByName(done)
        pairs = cut_lineage(pairs.join(done, "of", "left_anti"))
        if _few(pairs, level):
            break
        level += 1
        pairs = _halved(pairs, points, level)
    close = _point_pairs(pairs, points, level).withColumn("page", F.col("of.a.of"))
    close = close.join(reach.withColumnRenamed("of", "page"), "page").filter("d <= eps").select("of").distinct()
    joined = graph.components(links.unionByName(close).select("of.a", "of.b")).select(F.col("node").alias("area"), "component")
    return rows.join(joined, "area", "left").select("of", "x", "y", F.coalesce("component", "area").alias("region_of"))


def regions(blocks: DataFrame) -> DataFrame:
    """Adds `region` to blocks (of, idx, x, y): components of links up to 1.5 times the page's median distance, numbered by
    their first block in the order of (idx, x, y), nulls first. A block without a place stands alone."""
    blocks = stored(blocks, "blocks")
    placed = blocks.filter("x IS NOT NULL AND y IS NOT NULL")
    places = stored(placed.groupBy("of", "x", "y").agg(F.count(F.lit(1)).alias("c")), "places")
    sizes = blocks.groupBy("of").agg(F.count(F.lit(1)).alias("blocks"))
    reach = cut_lineage(median_distances(places, sizes).select("of", (F.col("median") * 1.5).alias("eps")))
    joined = linked_places(places.select("of", "x", "y"), reach).join(reach, "of")
    # without a reach not even blocks of one place are joined
    alone = F.struct("idx", "x", "y")
    named = placed.join(joined, ["of", "x", "y"]).select(
        "of", "idx", "x", "y", "region_of", F.when(F.col("eps").isNull(), alone).alias("alone"))
    single = blocks.filter("x IS NULL OR y IS NULL").select(
        "of", "idx", "x", "y", F.lit(None).cast(named.schema["region_of"].dataType).alias("region_of"), alone.alias("alone"))
    named = stored(named.unionByName(single).withColumn("group", F.struct("of", "region_of", "alone")), "named")
    first = named.groupBy("group").agg(F.first("of").alias("of"), F.min(F.struct("idx", "x", "y")).alias("first"))
    numbered = ranked(first.withColumn("at", F.col("first.idx")), ["of"], ["first"], tiles(F.col("at"), 1024), "region")
    return named.join(numbered.select("group", (F.col("region") - 1).alias("region")), "group").select("of", "idx", "x", "y", "region")
