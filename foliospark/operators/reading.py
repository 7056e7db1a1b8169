"""Reading order and assembly of pages from words and layout boxes."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from foliospark.functions import geometry as g
from foliospark.operators import boxes, distances, graph, groups, spatial
from foliospark.operators.metrics import page_direction
from foliospark.operators.scan import ordered_concat, ranked, running, tiles
from foliospark.operators.windows import cluster_x
from foliospark.session import cut_lineage

#: Pages above this size search their nearest boxes in zones on Spark instead of being swept in one task; the edges are the same.
EDGE_LIMIT = 20_000
#: Pages above this size are walked by connected component instead of whole; the order is the same.
WALK_LIMIT = 20_000
#: Pages above this size whose numbers repeat go by component in any case.
REPEAT_LIMIT = 2000
#: Pages above this size are measured by tiles for their regions; the regions are the same.
REGION_LIMIT = 4000
#: Distances or overlaps of so many boxes with all others of their page are held at once.
CHUNK = 256


# ---- simple order ---------------------------------------------------------------------------------------------

def reading_order_simple(blocks: DataFrame, keys: list[str], width: str, vertical: bool = False) -> DataFrame:
    """Adds `pos` (0-based): columns by mean x, inside a column by (y, x); vertical text right to left, by (-x, y)."""
    b = g.box()
    rows = cluster_x(blocks, keys, g.center_x(b) / F.col(width))
    return order_by_region(rows, keys, "cluster", vertical)


def order_by_region(blocks: DataFrame, keys: list[str], region: str, vertical: bool = False) -> DataFrame:
    b = g.box()
    rows = blocks.withColumn("_cx", g.center_x(b)).withColumn("_cy", g.center_y(b))
    means = rows.groupBy(*keys, region).agg(F.avg("_cx").alias("_mx"), F.avg("_cy").alias("_my"))
    n = means.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    means = groups.join_null_safe(means, n, keys)
    at = -F.col("_mx") if vertical else F.when(F.col("_n") >= 2, F.col("_mx")).otherwise(F.col("_my"))
    rows = groups.join_null_safe(rows, means.select(*keys, region, at.alias("_at")), [*keys, region])
    first, second = (-F.col("_cx"), F.col("_cy")) if vertical else (F.col("_cy"), F.col("_cx"))
    rows = rows.withColumn("_o1", first).withColumn("_o2", second)
    order = ["_at", region, "_o1", "_o2", "idx"]
    rows = ranked(rows, keys, order, F.struct("_at", region, tiles(F.col("_o1"), 256)), "pos")
    return rows.withColumn("pos", F.col("pos") - 1).drop("_cx", "_cy", "_at", "_o1", "_o2")


# ---- regions as a graph ---------------------------------------------------------------------------------------

def region_components(blocks: DataFrame, keys: list[str], width: str, height: str, limit: int | None = None) -> DataFrame:
    """Adds `region`: blocks linked by centre distances up to 1.5 times the median distance of all pairs of their page.

    Regions are numbered by their first block in the order of (idx, place). Pages up to `limit` blocks (REGION_LIMIT) are measured in one
    task, CHUNK blocks at a time; larger ones by tiles on Spark (`distances`), with the same rows. Null keys are one page,
    blocks without an idx stay, and a block without a place is a region of its own.
    """
    b = g.box()
    rows = blocks.withColumn("_px", g.center_x(b) / F.col(width)).withColumn("_py", g.center_y(b) / F.col(height))
    # as text, keys and idx keep their nulls in pandas; blocks of one idx and place share a region
    rows = rows.withColumn("_page", F.to_json(F.array(*(F.col(k).cast("string") for k in keys)))).withColumn("_idx", F.col("idx").cast("string"))
    schema = "_page string, _idx string, _px double, _py double, region bigint"

    def label(batch: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        x, y = batch["_px"].to_numpy(), batch["_py"].to_numpy()
        region, sizes = np.zeros(len(x), np.int64), np.diff(cuts)
        for i in np.flatnonzero(sizes > graph.SMALL).tolist():
            region[cuts[i] : cuts[i + 1]] = _regions(x[cuts[i] : cuts[i + 1]], y[cuts[i] : cuts[i + 1]])
        small = np.repeat(sizes <= graph.SMALL, sizes)
        region[small] = _small_regions(x[small], y[small], sizes[sizes <= graph.SMALL])
        return batch[["_page", "_idx", "_px", "_py"]].assign(region=region)

    slim = rows.select("_page", "idx", "_idx", "_px", "_py")
    small, large = groups.split_by_size(slim, ["_page"], REGION_LIMIT if limit is None else limit)
    found = groups.map_batches(small, ["_page"], ["idx", "_px", "_py"], label, schema)
    if large is not None:
        spread = distances.regions(large.select(F.col("_page").alias("of"), "idx", F.col("_px").alias("x"), F.col("_py").alias("y")))
        found = found.unionByName(spread.select(
            F.col("of").alias("_page"), F.col("idx").cast("string").alias("_idx"), F.col("x").alias("_px"), F.col("y").alias("_py"), F.col("region").cast("bigint")))
    place = ["_page", "_idx", "_px", "_py"]
    found = found.groupBy(*place).agg(F.min("region").alias("region"))
    first = [*keys, "idx"]
    return groups.join_null_safe(rows, found, place).select(*first, *(c for c in blocks.columns if c not in first), "region")


def _regions(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Region of each block of one page."""
    eps = median_distance(x, y) * 1.5 if len(x) > 1 else 0.1
    region, count = np.full(len(x), -1), 0
    for i in range(len(x)):
        if region[i] >= 0:
            continue
        region[i], todo = count, [i]
        while todo:
            at = todo.pop()
            near = np.flatnonzero((region < 0) & (_distances(x, y, at, at + 1)[0] <= eps))
            region[near] = count
            todo.extend(near.tolist())
        count += 1
    return region


def _small_regions(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Regions of the blocks of many small pages at once; `sizes` are the pages' numbers of blocks, in order."""
    i, j, _ = graph.pairs_in_groups(sizes)
    i, j = i[i < j], j[i < j]
    d = np.sqrt((x[i] - x[j]) ** 2 + (y[i] - y[j]) ** 2)
    page, pairs = np.repeat(np.arange(len(sizes)), sizes), sizes * (sizes - 1) // 2
    some = pairs > 0
    ordered, first = d[np.lexsort((d, page[i]))], (np.cumsum(pairs) - pairs)[some]
    eps = np.zeros(len(sizes))
    eps[some] = (ordered[first + (pairs[some] - 1) // 2] + ordered[first + pairs[some] // 2]) / 2 * 1.5
    near = d <= eps[page[i]]
    i, j, least = i[near], j[near], np.arange(len(x))
    while (least[i] != least[j]).any():
        np.minimum.at(least, i, least[j])
        np.minimum.at(least, j, least[i])
        least = least[least]
    # numbered by first block within the page
    before = np.cumsum(least == np.arange(len(x))) - 1
    return before[least] - np.repeat(before[np.cumsum(sizes) - sizes], sizes) if len(x) else least


def _distances(x: np.ndarray, y: np.ndarray, lo: int, hi: int) -> np.ndarray:
    return np.sqrt((x[lo:hi, None] - x[None, :]) ** 2 + (y[lo:hi, None] - y[None, :]) ** 2)


def median_distance(x: np.ndarray, y: np.ndarray) -> float:
    """Exact median of the distances of all pairs, found 16 bits at a time: as bit patterns, distances sort like numbers."""
    n = len(x)
    total = n * (n - 1) // 2

    def patterns():
        for lo in range(0, n, CHUNK):
            hi = min(n, lo + CHUNK)
            yield _distances(x, y, lo, hi)[np.arange(n)[None, :] > np.arange(lo, hi)[:, None]].view(np.int64)

    def at_rank(rank: int) -> float:
        known = 0
        for shift in (48, 32, 16, 0):
            counts = np.zeros(1 << 16, np.int64)
            for d in patterns():
                same = d if shift == 48 else d[(d >> (shift + 16)) == known]
                counts += np.bincount((same >> shift) & 0xFFFF, minlength=1 << 16)
            upto = np.cumsum(counts)
            digit = int(np.searchsorted(upto, rank, "right"))
            rank -= int(upto[digit] - counts[digit])
            known = (known << 16) | digit
        return float(np.array([known], np.int64).view(np.float64)[0])

    return (at_rank((total - 1) // 2) + at_rank(total // 2)) / 2


def region_edges(blocks: DataFrame, keys: list[str], region: str = "region", vertical: bool = False) -> DataFrame:
    """(keys, src, dst, kind): a chain inside each region, and a link from the lowest block of a region to the highest
    of the next. Regions go by x when any two stand side by side, else by y; vertical text right to left."""
    b = g.box()
    rows = blocks.withColumn("_cx", g.center_x(b)).withColumn("_cy", g.center_y(b))
    o1, o2 = (-F.col("_cx"), F.col("_cy")) if vertical else (F.col("_cy"), F.col("_cx"))
    rows = rows.withColumn("_o1", o1).withColumn("_o2", o2)
    part = [*keys, region]
    chain = running(rows.select(*part, "idx", "_o1", "_o2"), part, ["_o1", "_o2", "idx"], tiles(F.col("_o1"), 256),
                    {"src": ("lag", F.col("idx"))})
    chain = chain.filter(F.col("src").isNotNull()).select(*keys, "src", F.col("idx").alias("dst"), F.lit("chain").alias("kind"))
    props = rows.groupBy(*part).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.max_by("idx", F.struct("y2", -F.col("idx"))).alias("_last"), F.min_by("idx", F.struct("y1", "idx")).alias("_first"))
    slim = props.select(*part, F.lit(0).alias("x1"), "y1", F.lit(1).alias("x2"), "y2")
    beside = spatial.overlap_pairs(slim, slim, keys).filter(F.col(region) < F.col("o_" + region))
    over = F.least("y2", "o_y2") - F.greatest("y1", "o_y1")
    low = F.least(F.col("y2") - F.col("y1"), F.col("o_y2") - F.col("o_y1"))
    multi = beside.filter(over > 0.5 * low).select(*keys).distinct().withColumn("_multi", F.lit(True))
    props = groups.join_null_safe(props, multi, keys, "left")
    mx, my = (F.col("x1") + F.col("x2")) / 2.0, (F.col("y1") + F.col("y2")) / 2.0
    at = -mx if vertical else F.when(F.col("_multi"), mx).otherwise(my)
    props = props.withColumn("_at", at)
    links = running(props.select(*part, "_at", "_last", "_first"), keys, ["_at", region], tiles(F.col("_at"), 256),
                    {"src": ("lag", F.col("_last"))})
    links = links.filter(F.col("src").isNotNull()).select(*keys, "src", F.col("_first").alias("dst"), F.lit("link").alias("kind"))
    return chain.unionByName(links)


def reading_path(blocks: DataFrame, edges: DataFrame, keys: list[str], width: str, vertical: bool = False) -> DataFrame:
    """Position per block along one topological order that begins at the top-left (top-right) block where one can;
    a cyclic page is walked depth first. Edges from or to blocks that aren't listed are left out; null keys are one page."""
    b = g.box()
    nodes = blocks.withColumn("_cx", g.center_x(b)).withColumn("_cy", g.center_y(b))
    none = F.lit(None)
    both = nodes.select(*keys, F.lit(0).alias("_kind"), "idx", F.col("_cx"), F.col("_cy"), none.cast("bigint").alias("dst"))
    both = both.unionByName(edges.select(
        *keys, F.lit(1).alias("_kind"), F.col("src").alias("idx"), none.cast("double").alias("_cx"),
        none.cast("double").alias("_cy"), "dst"))
    types = dict(nodes.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", idx bigint, pos bigint"

    def order(batch: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        columns = [batch[c].to_numpy().tolist() for c in ("_kind", "idx", "_cx", "_cy", "dst")]
        found: list = []
        number = [0] * (len(cuts) - 1)
        for page, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            own = _path(*(c[a:b] for c in columns), vertical)
            found += own
            number[page] = len(own)
        first = np.repeat(np.array(cuts[:-1]), number)
        pos = np.arange(len(found)) - np.repeat(np.cumsum(number) - number, number)
        return pd.DataFrame({**{k: batch[k].to_numpy()[first] for k in keys}, "idx": found, "pos": pos})

    return groups.map_batches(both, keys, ["_kind", "idx", "dst"], order, schema)


def _path(kinds: list, idx: list, cx: list, cy: list, dst: list, vertical: bool) -> list:
    """One page's blocks in order; its rows are blocks (kind 0), then edges."""
    n = kinds.index(1) if 1 in kinds else len(kinds)
    ids = idx[:n]
    if not ids:
        return []
    below = {i: (y, x) for i, x, y in zip(ids, cx, cy)}
    place = {i: (-x, y) for i, x, y in zip(ids, cx, cy)} if vertical else below
    outs: dict = {i: {} for i in ids}
    left = dict.fromkeys(ids, 0)
    for s, d in zip(idx[n:], dst[n:]):
        if s in outs and d in outs and int(d) not in outs[s]:
            outs[s][int(d)] = True
            left[int(d)] += 1
    start = min(ids, key=lambda i: place[i])
    ready = [(i != start, below[i], i) for i in ids if left[i] == 0]
    heapq.heapify(ready)
    found: list = []
    while ready:
        i = heapq.heappop(ready)[2]
        found.append(i)
        for d in outs[i]:
            left[d] -= 1
            if left[d] == 0:
                heapq.heappush(ready, (True, below[d], d))
    if len(found) < len(ids):
        found, seen, todo = [], set(), [start]
        while todo:
            i = todo.pop()
            if i not in seen:
                seen.add(i)
                found.append(i)
                todo.extend(sorted(outs[i], key=lambda d: below[d], reverse=True))
        found.extend(i for i in ids if i not in seen)
    return found


# ---- precedence graph -----------------------------------------------------------------------------------------

def precedence_edges(elements: DataFrame, keys: list[str], direction: str) -> DataFrame:
    """(keys, src, dst) of the reading graph of a page.

    Two boxes are linked when they share a column (top2bottom) or a line (right2left, left2right) and no third box
    of that column or line stands wholly between them. Seen from a box, what lies beyond the nearest end of a box
    ahead is hidden, so one bound per side replaces the search for blockers. A page is swept along the reading axis (`graph.seen`).
    On pages above EDGE_LIMIT boxes the bound is searched in zones that widen until it is certain, and only boxes within both bounds are
    paired. Null keys are one page.
    """
    if direction not in ("top2bottom", "right2left", "left2right"):
        raise ValueError(f"unknown direction {direction}")
    slim = elements.select(*keys, "idx", *g.SIDES)
    small, large = groups.split_by_size(slim, keys, EDGE_LIMIT)
    types = dict(slim.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", src bigint, dst bigint"

    def sweep(batch: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        ids = batch["idx"].to_numpy()
        src, dst = graph.group_edges(batch[list(g.SIDES)].to_numpy(np.float64), np.array(cuts), direction)
        return pd.DataFrame({**{k: batch[k].to_numpy()[src] for k in keys}, "src": ids[src], "dst": ids[dst]})

    out = groups.map_batches(small, keys, ["idx"], sweep, schema)
    if large is not None:
        out = out.unionByName(_large_edges(cut_lineage(large), keys, direction))
    return out


def _sharing(zones: DataFrame, boxes_: DataFrame, keys: list[str], direction: str, whole: bool = False) -> DataFrame:
    """Pairs of different boxes of one column or line: idx, o_idx and their extents a..b and oa..ob along the reading axis.

    A zone is a box with the extent to look at in za..zb; `whole` looks at all of the page.
    """
    down = direction == "top2bottom"
    lo, hi = ("y1", "y2") if down else ("x1", "x2")
    rows = zones.withColumn("a", F.col(lo)).withColumn("b", F.col(hi))
    others = boxes_.withColumn("a", F.col(lo)).withColumn("b", F.col(hi))
    cross = ["y1", "y2"] if not down else ["x1", "x2"]
    for side in cross:  # the cross extent as it is, for the overlap rule
        rows, others = rows.withColumn("_" + side, F.col(side)), others.withColumn("_" + side, F.col(side))
    if whole:
        rows, others = (d.withColumn(lo, F.lit(0)).withColumn(hi, F.lit(1)) for d in (rows, others))
    else:
        rows = rows.withColumn(lo, F.col("za") - 1).withColumn(hi, F.col("zb") + 1)
    pairs = spatial.overlap_pairs(rows, others, keys).filter(F.col("idx") != F.col("o_idx"))
    if not down:
        zero, one_ = F.lit(0), F.lit(1)
        mine, other = (g.Box(zero, F.col(p + "_y1"), one_, F.col(p + "_y2")) for p in ("", "o_"))
        pairs = pairs.filter(g.intersects_h(mine, other))
    return pairs.select(*keys, "idx", "o_idx", "a", "b", F.col("o_a").alias("oa"), F.col("o_b").alias("ob"))


def _linked(seen: DataFrame, keys: list[str], direction: str) -> DataFrame:
    a, b, oa, ob = (F.col(c) for c in ("a", "b", "oa", "ob"))
    seen = seen.filter((F.col("_ahead").isNull() | (oa <= F.col("_ahead"))) & (F.col("_behind").isNull() | (ob >= F.col("_behind"))))
    first = {"top2bottom": a < oa, "right2left": ~(b < ob), "left2right": ~(ob < b)}[direction]
    src, dst = F.when(first, F.col("idx")).otherwise(F.col("o_idx")), F.when(first, F.col("o_idx")).otherwise(F.col("idx"))
    return seen.select(*keys, src.alias("src"), dst.alias("dst")).distinct()


def _large_edges(rows: DataFrame, keys: list[str], direction: str) -> DataFrame:
    lo, hi = ("y1", "y2") if direction == "top2bottom" else ("x1", "x2")
    extent = rows.groupBy(*keys).agg(F.min(lo).alias("_lo"), F.max(hi).alias("_hi"))
    found = rows
    for name, forward in (("_ahead", True), ("_behind", False)):
        left, done, width = groups.join_null_safe(rows, extent, keys), None, spatial.TILE
        while True:
            za, zb = (F.col(lo), F.col(hi) + width) if forward else (F.col(lo) - width, F.col(hi))
            pairs = _sharing(left.withColumn("za", za).withColumn("zb", zb).drop("_lo", "_hi"), rows, keys, direction)
            bound = (F.min(F.when(F.col("oa") > F.col("b"), F.col("ob"))) if forward
                     else F.max(F.when(F.col("ob") < F.col("a"), F.col("oa"))))
            best = groups.join_null_safe(left, pairs.groupBy(*keys, "idx").agg(bound.alias(name)), [*keys, "idx"], "left")
            certain = F.col(name) <= F.col(hi) + width if forward else F.col(name) >= F.col(lo) - width
            at_end = F.col(hi) + width >= F.col("_hi") if forward else F.col(lo) - width <= F.col("_lo")
            best = cut_lineage(best.withColumn("_sure", F.coalesce(certain, F.lit(False)) | at_end))
            settled = best.filter("_sure").select(*keys, "idx", name)
            done = settled if done is None else done.unionByName(settled)
            left = best.filter("not _sure").drop(name, "_sure")
            if left.isEmpty():
                break
            width *= 8
        found = groups.join_null_safe(found, done, [*keys, "idx"])
    zones = found.withColumn("za", F.least(F.col(lo), F.coalesce("_behind", lo))).withColumn("zb", F.greatest(F.col(hi), F.coalesce("_ahead", hi)))
    pairs = _sharing(zones.drop("_ahead", "_behind"), rows, keys, direction)
    return _linked(groups.join_null_safe(pairs, found.select(*keys, "idx", "_ahead", "_behind"), [*keys, "idx"]), keys, direction)


def _distance(x1, y1, x2, right, direction: str):
    """Where a box stands in the order of starts; `right` is the page's right end."""
    return {"top2bottom": lambda: x1 + y1, "right2left": lambda: (right - x2) + y1, "left2right": lambda: x1 + 5 * y1}[direction]()


def _children(n: int, src: np.ndarray, dst: np.ndarray, box: np.ndarray, direction: str) -> list[list[int]]:
    """Children of each box, nearest side first, then by number."""
    key = box[:, 0 if direction == "top2bottom" else 1]
    order = np.lexsort((dst, key[dst], src))
    cuts = np.searchsorted(src[order], np.arange(n + 1))
    every = dst[order].tolist()
    return [every[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def walk(children: list[list[int]], distance: list[float]) -> list[int]:
    """Depth-first order in which every box comes after all its parents, where no cycle stands against it.

    The rule, for pages of any size: a box met before its last parent is read waits. A waiting box is read as soon as its last
    parent is, the longest waiting one first; else the next child of the box read last that has any left is met; else the box
    nearest to the start. If all that is left waits (a cycle), the longest waiting box is read. Takes time by boxes and edges.
    """
    need = [0] * len(children)
    for c in children:
        for d in c:
            need[d] += 1
    turn: dict[int, int] = {}  # waiting boxes and when they began to wait
    free: list[tuple[int, int]] = []  # waiting boxes whose last parent is read
    met, order = [False] * len(children), []
    path: list[tuple[int, int]] = []  # boxes read, with the place of their next child
    starts = sorted(range(len(children)), key=lambda i: distance[i])
    at_start, oldest = 0, 0
    waiting: list[int] = []  # in order of waiting, also such as are read already

    def read(i: int) -> None:
        met[i] = True
        turn.pop(i, None)
        order.append(i)
        for d in children[i]:
            need[d] -= 1
            if need[d] == 0 and d in turn:
                heapq.heappush(free, (turn[d], d))
        path.append((i, 0))

    def meet(i: int) -> None:
        met[i] = True
        if need[i]:
            turn[i] = len(waiting)
            waiting.append(i)
        else:
            read(i)

    while len(order) < len(children):
        if free:
            _, i = heapq.heappop(free)
            if i in turn:
                read(i)
        elif path:
            i, place = path.pop()
            if place < len(children[i]):
                path.append((i, place + 1))
                if not met[children[i][place]]:
                    meet(children[i][place])
        elif at_start < len(starts):
            if not met[starts[at_start]]:
                meet(starts[at_start])
            at_start += 1
        else:
            while waiting[oldest] not in turn:
                oldest += 1
            read(waiting[oldest])
    return order


def _orders(box: np.ndarray, cuts: np.ndarray, ways: np.ndarray) -> np.ndarray:
    """Row numbers of many groups of boxes, one group after another, each by the walk in its own direction."""
    sizes = np.diff(cuts)
    way = np.repeat(ways, sizes)
    links = [np.zeros((2, 0), np.int64)]
    for direction in pd.unique(ways):
        rows = np.flatnonzero(way == direction)
        src, dst = graph.group_edges(box[rows], np.concatenate([[0], np.cumsum(sizes[ways == direction])]), direction)
        links.append(rows[np.stack([src, dst])])
    src, dst = np.concatenate(links, axis=1)
    x1, y1, x2, _ = box.T
    down, right = way == "top2bottom", np.repeat(np.maximum(np.maximum.reduceat(x2, cuts[:-1]), 0.0), sizes) if len(box) else x2
    far = np.where(down, _distance(x1, y1, x2, right, "top2bottom"), np.where(
        way == "right2left", _distance(x1, y1, x2, right, "right2left"), _distance(x1, y1, x2, right, "left2right"))).tolist()
    order = np.lexsort((dst, np.where(down, x1, y1)[dst], src))  # children by their nearest side, then by number
    begin = np.repeat(cuts[:-1], sizes)
    every, at = (dst - begin[dst])[order].tolist(), np.searchsorted(src[order], np.arange(len(box) + 1)).tolist()
    out: list[int] = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        if at[a] == at[b]:
            out += sorted(range(a, b), key=lambda i: far[i])
        else:
            out += [a + i for i in walk([every[at[i] : at[i + 1]] for i in range(a, b)], far[a:b])]
    return np.array(out, np.int64)


def _page_graph(box: np.ndarray, direction: str) -> tuple[list[list[int]], np.ndarray]:
    """Children (nearest side first) and start distance of the boxes of one page."""
    x1, y1, x2, _ = box.T
    return _children(len(box), *graph.edges(box, direction), box, direction), _distance(x1, y1, x2, x2.max(initial=0), direction)


def _ordered(box: np.ndarray, direction: str) -> list[int]:
    """The walk of one group of boxes."""
    return _orders(box, np.array([0, len(box)]), np.array([direction])).tolist()


def priority_order(elements: DataFrame, keys: list[str], direction: Column, limit: int = WALK_LIMIT) -> DataFrame:
    """Position (0-based `pos`) per (keys, idx) by the waiting walk; `direction` must be one value per key.

    Pages up to `limit` boxes are walked in one task each. Of larger ones, and of pages above REPEAT_LIMIT where an idx repeats, the edges are formed first; their connected components are
    walked apart, whatever task each falls to, and the bursts of all are put in the order of one walk (`graph.bursts`). Only a component
    is walked in one task, and only its boxes and edges are held. Null keys are one page.
    """
    rows = elements.select(*keys, "idx", *(F.col(s).cast("double").alias(s) for s in g.SIDES), direction.alias("_dir"))
    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", idx bigint, pos bigint"

    def place(batch: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        at = np.array(cuts)
        order = _orders(batch[list(g.SIDES)].to_numpy(), at, batch["_dir"].to_numpy()[at[:-1]])
        pos = np.arange(len(batch)) - np.repeat(at[:-1], np.diff(at))
        return pd.DataFrame({**{k: batch[k].to_numpy() for k in keys}, "idx": batch["idx"].to_numpy()[order], "pos": pos})

    small, large = groups.split_by_size(rows, keys, min(limit, REPEAT_LIMIT))
    if large is not None:
        large = cut_lineage(large)
    if large is not None and limit > REPEAT_LIMIT:
        sizes = large.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.countDistinct("idx").alias("_d"))
        parts = cut_lineage(sizes.filter((F.col("_n") > limit) | (F.col("_d") < F.col("_n"))).select(*keys))
        small = small.unionByName(groups.join_null_safe(large, parts, keys, "left_anti").select(*rows.columns))
        large = None if parts.isEmpty() else groups.join_null_safe(large, parts, keys, "left_semi").select(*rows.columns)
    out = groups.map_batches(small, keys, ["idx"], place, schema)
    return out if large is None else out.unionByName(_order_by_component(large, keys))


def _order_by_component(rows: DataFrame, keys: list[str]) -> DataFrame:
    ways = [r["_dir"] for r in rows.select("_dir").distinct().collect()]  # at most three
    links = None
    for way in ways:
        own = precedence_edges(rows.where(F.col("_dir") == way).drop("_dir"), keys, way)
        links = own if links is None else links.unionByName(own)
    links = cut_lineage(links)
    at = lambda c: F.struct(*keys, F.col(c).cast("bigint").alias("idx"))
    found = graph.components(links.select(at("src").alias("a"), at("dst").alias("b")))
    found = found.select(*(F.col(f"node.{k}").alias(k) for k in keys), F.col("node.idx").alias("idx"), F.col("component.idx").alias("part"))
    right = rows.groupBy(*keys).agg(F.greatest(F.max("x2"), F.lit(0.0)).alias("_right"))
    nodes = groups.join_null_safe(groups.join_null_safe(rows, right, keys), found, [*keys, "idx"], "left")
    nodes = cut_lineage(nodes.withColumn("part", F.coalesce("part", F.col("idx").cast("bigint"))))
    none = F.lit(None).cast("double")
    ends = groups.join_null_safe(links, found.withColumnRenamed("idx", "src"), [*keys, "src"])
    both = nodes.select(*keys, "part", F.lit(0).alias("_kind"), F.col("idx").cast("bigint").alias("idx"), *g.SIDES, "_right", "_dir", F.lit(None).cast("bigint").alias("dst"))
    both = both.unionByName(ends.select(*keys, "part", F.lit(1).alias("_kind"), F.col("src").alias("idx"), *(none.alias(s) for s in g.SIDES),
                                        none.alias("_right"), F.lit(None).cast("string").alias("_dir"), "dst"))
    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", _generation bigint, _distance double, _start bigint, _places array<bigint>, _in bigint, idx bigint"

    def walk_part(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        is_box = part["_kind"].to_numpy() == 0
        own, links_ = part[is_box], part[~is_box]
        ids, box, way = own["idx"].to_numpy(np.int64), own[list(g.SIDES)].to_numpy(np.float64), own["_dir"].iloc[0]
        far = _distance(box[:, 0], box[:, 1], box[:, 2], own["_right"].to_numpy()[0], way)
        src = np.searchsorted(ids, links_["idx"].to_numpy(np.int64))
        dst = np.searchsorted(ids, links_["dst"].to_numpy(np.int64))
        out = []
        for generation, start, places, order in graph.bursts(_children(len(ids), src, dst, box, way), np.argsort(far, kind="stable").tolist()):
            out += [(generation, float(far[start]), int(ids[start]), places, n, int(ids[i])) for n, i in enumerate(order)]
        found = pd.DataFrame(out, columns=["_generation", "_distance", "_start", "_places", "_in", "idx"])
        return found.assign(**{k: [v] * len(found) for k, v in zip(keys, key)})[[*keys, *found.columns[:6]]]

    walked = cut_lineage(groups.map_groups(both, [*keys, "part"], ["_kind", "idx", "dst"], walk_part, schema))
    order = ["_generation", "_distance", "_start", "_places", "_in"]
    # buckets follow the order: first walks by their distance, then what cycles left over
    placed = ranked(walked, keys, order, F.struct("_generation", tiles(F.col("_distance"), 64)), "pos")
    return placed.select(*keys, "idx", (F.col("pos") - 1).alias("pos"))


def assemble_text(matches: DataFrame, keys: list[str], element: str = "o_idx") -> DataFrame:
    """Text and direction per element: its words in reading order, one per line.

    `matches` holds (keys, element, n, box, content, direction) rows, one per word of an element.
    """
    part = [*keys, element]
    rows = matches.select(*part, F.col("n").alias("idx"), *(F.col(s).cast("double").alias(s) for s in g.SIDES), "content", "direction")
    types = dict(rows.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in part) + ", text string, direction string"

    def join(batch: pd.DataFrame, cuts: list[int]) -> pd.DataFrame:
        at, way = np.array(cuts), batch["direction"].to_numpy()
        flat = np.add.reduceat((way == "horizontal").astype(int) - (way == "vertical"), at[:-1]) > 0
        order = _orders(batch[list(g.SIDES)].to_numpy(), at, np.where(flat, "left2right", "right2left"))
        content = batch["content"].to_numpy()[order].tolist()
        return pd.DataFrame({
            **{k: batch[k].to_numpy()[at[:-1]] for k in part}, "text": ["\n".join(content[a:b]) for a, b in zip(cuts[:-1], cuts[1:])],
            "direction": np.where(flat, "horizontal", "vertical")})

    return groups.map_batches(rows, part, ["idx"], join, schema)


def cell_texts(cells: DataFrame, words: DataFrame, keys: list[str], cell: str = "idx") -> DataFrame:
    """Cells with the text of their words; empty where there are none."""
    pairs = boxes.words_in_elements(words, cells.select(*keys, cell, *g.SIDES), keys)
    text = assemble_text(pairs, keys, "o_" + cell).withColumnRenamed("o_" + cell, cell)
    return groups.join_null_safe(cells, text, [*keys, cell], "left").withColumn("text", F.coalesce("text", F.lit("")))


def ocr_zip(det: DataFrame, rec: DataFrame, keys: list[str]) -> DataFrame:
    """Detections and recognitions of a page paired by position; the shorter list decides."""
    return groups.join_null_safe(det, rec, [*keys, "pos"])


def direct_text_blocks(lines: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Embedded text lines (bottom-left origin) as paragraph blocks with full confidence; blank lines drop out."""
    rows = lines.filter(F.trim(F.regexp_replace("text", r"\s+", " ")) != "").join(pages, keys)
    b = g.flip_y(g.box(), F.col("height"))
    return rows.select(*keys, "idx", *(v.cast("double").alias(s) for v, s in zip(b, g.SIDES)),
                       F.regexp_replace("text", "\n+$", "").alias("text"), F.lit(1.0).alias("confidence"), F.lit("paragraph").alias("block_type"))


def ordered_text(blocks: DataFrame, orders: DataFrame, keys: list[str], page: str = "page") -> DataFrame:
    """Document text: blocks in reading order joined by newline.

    `orders` has (keys, page, reading_order array); an empty order means block order, unknown indexes are left out.
    """
    listed = orders.select(*keys, page, F.posexplode("reading_order").alias("pos", "idx"))
    named = blocks.join(orders.filter(F.size("reading_order") > 0).select(*keys, page), [*keys, page], "left_anti")
    plain = named.withColumn("pos", F.col("idx")).select(*keys, page, "pos", "text")
    put = listed.withColumn("idx", F.col("idx").cast("bigint")).join(blocks, [*keys, page, "idx"]).select(*keys, page, "pos", "text")
    rows = plain.unionByName(put.withColumn("pos", F.col("pos").cast("bigint")))
    bucket = F.struct(F.col(page), tiles(F.col("pos"), 512))
    return ordered_concat(rows, keys, [page, "pos"], "text", "\n", "text_all", bucket=bucket)


def assemble_page(
    words: DataFrame, paragraphs: DataFrame, cells: DataFrame, tables: DataFrame, figures: DataFrame, page: str = "page",
    reading_order: str = "auto", ignore_meta: bool = False,
) -> dict[str, DataFrame]:
    """Whole pages: {"elements": ordered paragraphs, tables and figures, "cells": cell texts,
    "figure_paragraphs": paragraphs inside figures}.

    words: page, n, box, content, direction. paragraphs: page, idx, box, role. cells: page, tbl, idx, box.
    tables, figures: page, idx, box. Order: page headers, then body with tables and figures, then page footers.
    The word matches and the page elements are used several times, so they are stored once.
    """
    keys = [page]
    cell_pairs = boxes.words_in_elements(words, cells.select(page, F.col("idx").alias("cell"), "tbl", *g.SIDES), keys)
    cell_pairs = cut_lineage(cell_pairs.select(page, "n", *g.SIDES, "content", "direction", "o_tbl", "o_cell"))
    in_cells = assemble_text(cell_pairs.select(page, "n", *g.SIDES, "content", "direction",
                                               F.struct("o_tbl", "o_cell").alias("_cell")).withColumn(
        "o_idx", F.col("_cell.o_tbl") * 2**32 + F.col("_cell.o_cell")).drop("_cell"), keys)
    cell_rows = groups.join_null_safe(cells.withColumn("o_idx", F.col("tbl") * 2**32 + F.col("idx")), in_cells, [page, "o_idx"], "left")
    cell_rows = cell_rows.withColumn("text", F.coalesce("text", F.lit(""))).drop("o_idx", "direction")

    pairs = boxes.words_in_elements(words, paragraphs.select(page, "idx", *g.SIDES), keys)
    pairs = cut_lineage(pairs.select(page, "n", *g.SIDES, "content", "direction", "o_idx"))
    text = assemble_text(pairs, keys).withColumnRenamed("o_idx", "idx")
    sides = [F.col(s).cast("double").alias(s) for s in g.SIDES]
    found = groups.join_null_safe(paragraphs, text, [page, "idx"]).select(page, F.lit(0).alias("src"), "idx", *sides, "text", "direction", "role")
    left = boxes.unassigned_words(words, [cell_pairs, pairs], keys)
    single = left.select(page, F.lit(1).alias("src"), F.col("n").alias("idx"), *sides, F.col("content").alias("text"),
                         "direction", F.lit(None).cast("string").alias("role"))
    all_paragraphs = cut_lineage(found.unionByName(single))

    boxed = figures.select(page, "idx", *g.SIDES)
    inside = spatial.contained_pairs(all_paragraphs, boxed, keys, 0.7)
    inside = cut_lineage(inside.select(page, F.col("o_idx").alias("figure"), "src", "idx", *g.SIDES, "text", "direction", "role"))
    in_figure = inside.select(page, "src", "idx").distinct().withColumn("_in", F.lit(True))
    flow = groups.join_null_safe(all_paragraphs, in_figure, [page, "src", "idx"], "left").where("_in IS NULL").drop("_in")
    part = [page, "figure"]
    numbered = inside.withColumn("seq", F.col("idx") * 2 + F.col("src"))
    way = page_direction(inside, part).withColumnRenamed("page_direction", "figure_direction")
    fig_order = priority_order(
        groups.join_null_safe(numbered, way, part).select(*part, F.col("seq").alias("idx"), *g.SIDES, "figure_direction"), part,
        F.when(F.col("figure_direction") == "horizontal", "left2right").otherwise("right2left"))
    figure_paragraphs = groups.join_null_safe(numbered, fig_order.withColumnRenamed("idx", "seq"), [*part, "seq"]).drop("seq", "src")

    meta = F.lit(not ignore_meta)
    section = (
        F.when((F.col("role") == "page_header") & meta, "header").when((F.col("role") == "page_footer") & meta, "footer")
        .when(F.col("role").isNull() | (F.col("role") == "section_headings"), "body")
    )
    kept = flow.withColumn("section", section).filter(F.col("section").isNotNull()).withColumn("kind", F.lit("paragraph"))
    null_text = F.lit(None).cast("string")
    extra = None
    for frame, kind, src in ((tables, "table", 2), (figures, "figure", 3)):
        one = frame.select(page, F.lit(src).alias("src"), "idx", *sides, null_text.alias("text"), null_text.alias("direction"),
                           null_text.alias("role"), F.lit("body").alias("section"), F.lit(kind).alias("kind"))
        extra = one if extra is None else extra.unionByName(one)
    elements = cut_lineage(kept.unionByName(extra).withColumn("seq", F.col("src") * 2**40 + F.col("idx")))
    page_way = page_direction(flow, keys)
    elements = groups.join_null_safe(elements, page_way, keys, "left")
    body_way = (F.when(F.col("page_direction") == "vertical", "right2left").otherwise("top2bottom")
                if reading_order == "auto" else F.lit(reading_order))
    walk = F.when(F.col("section") == "body", body_way).otherwise("left2right")
    placed = priority_order(elements.select(page, "section", F.col("seq").alias("idx"), *g.SIDES, walk.alias("_w")),
                            [page, "section"], F.col("_w"))
    counts = elements.groupBy(page).agg(
        F.count_if(F.col("section") == "header").alias("_h"), F.count_if(F.col("section") == "body").alias("_b"))
    out = groups.join_null_safe(elements, placed.withColumnRenamed("idx", "seq"), [page, "section", "seq"])
    out = groups.join_null_safe(out, counts, [page])
    shift = F.when(F.col("section") == "header", 0).when(F.col("section") == "body", F.col("_h")).otherwise(F.col("_h") + F.col("_b"))
    out = out.withColumn("order", F.col("pos") + shift).drop("pos", "_h", "_b", "seq", "src")
    return {"elements": out, "cells": cell_rows, "figure_paragraphs": figure_paragraphs}
