"""Box tables: annotation rescaling, containment filters, labels and assignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliospark.functions import geometry as g
from foliospark.operators import groups, scan, spatial

#: Lines of a key up to which its words meet them by key alone.
KEY_LINES = 500


def letterbox_boxes(ann: DataFrame, images: DataFrame, classes: list[str], size: int) -> DataFrame:
    """xywh boxes on a square canvas with kept aspect ratio, as normalised cx, cy, bw, bh; unknown labels drop out."""
    class_id = F.element_at(F.create_map(*[F.lit(v) for i, c in enumerate(classes) for v in (c, i)]), F.col("label"))
    image = images.select("page", F.col("w").alias("_iw"), F.col("h").alias("_ih"))
    joined = ann.filter(F.col("label").isin(*classes)).join(image, "page")
    scale = F.least(F.lit(size) / F.col("_ih"), F.lit(size) / F.col("_iw"))
    left = F.floor((size - F.floor(F.col("_iw") * scale)) / 2)
    top = F.floor((size - F.floor(F.col("_ih") * scale)) / 2)

    def clip(c: Column, lo: float) -> Column:
        return F.least(F.greatest(c, F.lit(lo)), F.lit(1.0))

    w, h = F.col("w") * scale, F.col("h") * scale
    x, y = F.col("x") * scale + left, F.col("y") * scale + top
    return joined.select(
        "page", "idx", class_id.alias("class_id"),
        clip((x + w / 2) / size, 0.0).alias("cx"), clip((y + h / 2) / size, 0.0).alias("cy"),
        clip(w / size, 1e-6).alias("bw"), clip(h / size, 1e-6).alias("bh"),
    )


def rescale_polygons(ann: DataFrame, images: DataFrame, short_side: int = 1024) -> DataFrame:
    """Polygons for an image whose short side is `short_side` and whose sides are multiples of 32 (at least 32)."""
    image = images.select("page", F.col("w").alias("_iw"), F.col("h").alias("_ih"))
    scale = F.lit(short_side) / F.least("_iw", "_ih")

    def side(c: str) -> Column:
        return F.greatest(F.floor(F.bround(F.col(c) * scale) / 32) * 32, F.lit(32)).cast("bigint")

    out = ann.join(image, "page").withColumn("nw", side("_iw")).withColumn("nh", side("_ih"))
    fx, fy = F.col("nw") / F.col("_iw"), F.col("nh") / F.col("_ih")
    b = F.col("bbox")
    point = F.array
    rect = F.array(
        F.array(b[0], b[1], b[0] + b[2], b[1], b[0] + b[2], b[1] + b[3], b[0], b[1] + b[3])
    )
    segments = F.when(F.size(F.col("segmentation")) > 0, F.col("segmentation")).otherwise(rect)

    def points(seg: Column) -> Column:
        pairs = F.sequence(F.lit(0), F.size(seg) - 2, F.lit(2))
        return F.transform(pairs, lambda i: point(F.get(seg, i) * fx, F.get(seg, i + 1) * fy))

    return out.withColumn("polygon", F.explode(F.transform(segments, points))).drop("_iw", "_ih")


def words_in_elements(words: DataFrame, elements: DataFrame, keys: list[str], thr: float = 0.5) -> DataFrame:
    """Words of an element (a word may match several); element columns get the prefix `o_`."""
    return spatial.contained_pairs(words, elements, keys, thr)


def unassigned_words(words: DataFrame, assigned: list[DataFrame], keys: list[str], word_id: str = "n") -> DataFrame:
    """Words that no frame of matches holds."""
    for matches in assigned:
        words = groups.join_null_safe(words, matches.select(*keys, word_id).distinct(), [*keys, word_id], "left_anti").select(*words.columns)
    return words


def paragraphs_in_figures(paragraphs: DataFrame, figures: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(paragraph, figure) matches, and the paragraphs left in the page flow."""
    inside = spatial.contained_pairs(paragraphs, figures, keys, 0.7)
    left = paragraphs.join(inside.select(*keys, "idx").distinct(), [*keys, "idx"], "left_anti")
    return inside, left


def drop_contained_same_class(elements: DataFrame, keys: list[str], idx: str = "idx", thr: float = 0.8) -> DataFrame:
    """Drops a box contained in another one of its class; of two that contain each other the larger stays."""
    pairs = spatial.contained_pairs(elements, elements, keys, thr)
    pairs = pairs.filter(F.col(idx) != F.col("o_" + idx))
    mine, other = g.area(g.box()), g.area(g.box("o_"))
    mutual = g.is_contained(g.box(), g.box("o_"), thr)
    loses = ~mutual | (mine < other) | ((mine == other) & (F.col(idx) < F.col("o_" + idx)))
    gone = pairs.filter(loses).select(*keys, idx).distinct()
    return elements.join(gone, [*keys, idx], "left_anti")


def drop_contained_across(target: DataFrame, source: DataFrame, keys: list[str], idx: str = "idx") -> DataFrame:
    """Target boxes that no source box contains."""
    gone = spatial.contained_pairs(target, source, keys, 0.8).select(*keys, idx).distinct()
    return target.join(gone, [*keys, idx], "left_anti")


def label_blocks(blocks: DataFrame, layout: DataFrame, keys: list[str], block_id: str, x: Column, y: Column) -> DataFrame:
    """Label of the first layout box, in list order, that holds the point; `text` where none does."""
    hits = spatial.points_in_boxes(blocks.select(*keys, block_id, x.alias("_cx"), y.alias("_cy")), layout, keys,
                                   F.col("_cx"), F.col("_cy"))
    o = g.box("o_")
    closed = F.col("_cx").between(o.x1, o.x2) & F.col("_cy").between(o.y1, o.y2)
    first = hits.filter(closed).groupBy(*keys, block_id).agg(F.min_by("o_label", "o_idx").alias("label"))
    return blocks.join(first, [*keys, block_id], "left").withColumn("label", F.coalesce("label", F.lit("text")))


def words_in_tables(words: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """Words of a table with their writing direction."""
    return spatial.contained_pairs(words, tables, keys, 0.5).withColumn(
        "direction", g.word_direction(g.quad_of_box(g.box()))
    )


def best_line(words: DataFrame, lines: DataFrame, keys: list[str], word_id: str = "n") -> DataFrame:
    """The line with the highest overlap per word; ties, and no overlap at all, take the first line. Words of keys with up to KEY_LINES lines
    meet them by key alone."""
    if not scan.larger_than(lines, keys, KEY_LINES):
        return _best_of_listed(words, lines, keys, word_id)
    pairs = spatial.overlap_pairs(words, lines, keys)
    ratio = g.box_overlap_ratio(g.box("o_"), g.box())
    best = pairs.filter(ratio > 0).groupBy(*keys, word_id).agg(
        F.min_by("o_idx", F.struct(-ratio, F.col("o_idx"))).alias("line"), F.max(ratio).alias("ratio")
    )
    first = lines.groupBy(*keys).agg(F.min("idx").alias("_first"))
    out = words.join(best, [*keys, word_id], "left").join(first, keys)
    return out.withColumn("line", F.coalesce("line", "_first")).withColumn("ratio", F.coalesce("ratio", F.lit(0.0))).drop("_first")


def _best_of_listed(words: DataFrame, lines: DataFrame, keys: list[str], word_id: str) -> DataFrame:
    # as in a join, words and lines without a key have no like
    own = words.filter(~groups.lacking(keys))
    near = own.join(spatial.listed(lines.filter(~groups.lacking(keys)).select(*keys, "idx", *g.SIDES), keys, "_lines"), keys)
    me = g.box()

    def over(e: Column) -> Column:
        o = g.Box(*(e[s] for s in g.SIDES))
        ratio = g.box_overlap_ratio(o, me)
        return F.when(spatial.meets(me, o) & (ratio > 0), F.struct((-ratio).alias("neg"), e["idx"].alias("idx")))

    # words of one id share the best; as in a join, one without an id has none
    best = F.min(F.array_min(F.transform("_lines", over))).over(Window.partitionBy(*keys, word_id))
    first = F.array_min(F.transform("_lines", lambda e: e["idx"]))
    near = near.withColumn("_best", F.when(F.col(word_id).isNotNull(), best))
    rest = [c for c in words.columns if c not in (*keys, word_id)]
    return near.select(*keys, word_id, *rest, F.coalesce(F.col("_best.idx"), first).alias("line"), F.coalesce(-F.col("_best.neg"), F.lit(0.0)).alias("ratio"))


def header_overlap(cells: DataFrame, headers: DataFrame, keys: list[str], cell_id: list[str]) -> DataFrame:
    """Header kind of a cell: that of the first header box covering more than half of it."""
    pairs = spatial.overlap_pairs(cells, headers, keys)
    over = g.box_overlap_first(g.box(), g.box("o_")) > 0.5
    first = pairs.filter(over).groupBy(*keys, *cell_id).agg(F.min_by("o_kind", "o_idx").alias("header_type"))
    return cells.join(first, [*keys, *cell_id], "left").withColumn("is_header", F.col("header_type").isNotNull())


def join_eval_pairs(images: DataFrame, pred: DataFrame, gt: DataFrame, key: str) -> DataFrame:
    """Numbers of predicted and true boxes per image; images without either count with zero."""
    p = pred.groupBy(key).agg(F.count(F.lit(1)).alias("n_pred"))
    t = gt.groupBy(key).agg(F.count(F.lit(1)).alias("n_gt"))
    return images.join(p, key, "left").join(t, key, "left").na.fill(0, ["n_pred", "n_gt"])


def confidence_filter(df: DataFrame, thr: float, blank: bool = False, score: str = "score", text: str = "txt") -> DataFrame:
    """Rows at or above the threshold, or with `blank` all rows, the text emptied below it and flagged."""
    if not blank:
        return df.filter(F.col(score) >= thr)
    low = F.col(score) < thr
    return df.withColumn(text, F.when(low, F.lit("")).otherwise(F.col(text))).withColumn("low_confidence", low)


def top_queries(scores: DataFrame, key: str, n_classes: int, k: int, thr: float) -> DataFrame:
    """Best k (query, class) scores per image from a flat score list, then those above `thr`."""
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), F.col("pos"))
    flat = scores.select(key, F.posexplode("scores").alias("pos", "score"))
    top = flat.withColumn("_rn", F.row_number().over(order)).filter(F.col("_rn") <= k).drop("_rn")
    return top.filter(F.col("score") > thr).select(
        key, "pos", (F.col("pos") % n_classes).alias("label"), F.expr(f"pos div {n_classes}").alias("query"), "score"
    )
