"""Sequence operators: edges, islands, steps, clusters and scales along a line."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from foliospark.operators import groups, spatial
from foliospark.operators.scan import islands, ranked, running, tiles, value_at_ranks
from foliospark.session import cut_lineage


def sequential_edges(nodes: DataFrame, keys: list[str], order: str, node: str) -> DataFrame:
    """(keys, src, dst) between neighbours in reading order."""
    rows = running(nodes, keys, [order], tiles(F.col(order), 1024), {"src": ("lag", F.col(node))}, deal=True)
    return rows.filter(F.col("src").isNotNull()).select(*keys, "src", F.col(node).alias("dst"))


def cluster_x(blocks: DataFrame, keys: list[str], x: Column, thr: float = 0.15, limit: int = groups.FOLD_LIMIT) -> DataFrame:
    """Adds `cluster`: sorted along x, a block opens a new cluster when it lies more than `thr` from the running mean.

    Equal positions always share a cluster, so the fold runs over distinct positions with their counts. A key with
    more than `limit` positions is cut by searching one break per round over prefix sums; starts lie more than
    `thr` apart, which bounds the rounds. Null keys are one key; a block without a position stays, its cluster is null.
    """
    rows = blocks.withColumn("_x", x.cast("double"))
    spots = rows.filter(F.col("_x").isNotNull()).groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c"))
    small, large = groups.split_by_size(spots, keys, limit)
    state = "struct<s:double,n:bigint,k:bigint,out:array<struct<_x:double,cluster:bigint>>>"

    def step(acc: Column, row: Column) -> Column:
        v, c = row["_x"], row["_c"]
        fresh = (acc["n"] > 0) & (F.abs(v - acc["s"] / acc["n"]) > thr)
        k = acc["k"] + fresh.cast("bigint")
        return F.struct(
            F.when(fresh, v * c).otherwise(acc["s"] + v * c).alias("s"), F.when(fresh, c).otherwise(acc["n"] + c).alias("n"),
            k.alias("k"), F.concat(acc["out"], F.array(F.struct(v.alias("_x"), k.alias("cluster")))).alias("out"),
        ).cast(state)

    init = F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n"), F.lit(0).alias("k"), F.array().alias("out")).cast(state)
    folded = groups.fold(small, keys, [F.col("_x")], init, step, lambda acc: acc["out"])
    found = folded.select(*keys, F.explode("folded").alias("f")).select(*keys, "f.*")
    if large is not None:
        found = found.unionByName(_cluster_by_rounds(large, keys, thr))
    return groups.join_null_safe(rows, found, [*keys, "_x"], "left").drop("_x")


def _cluster_by_rounds(spots: DataFrame, keys: list[str], thr: float) -> DataFrame:
    sums = running(spots, keys, ["_x"], tiles(F.col("_x"), 0.01), {
        "_s": ("sum", F.col("_x") * F.col("_c")), "_n": ("sum", F.col("_c"))})
    sums = cut_lineage(sums.withColumn("_s0", F.col("_s") - F.col("_x") * F.col("_c")).withColumn("_n0", F.col("_n") - F.col("_c")))
    first = F.min_by(F.struct("_x", "_s0", "_n0"), "_x").alias("_b")
    begin = lambda df: df.groupBy(*keys).agg(first).select(
        *keys, F.col("_b._x").alias("_bx"), F.col("_b._s0").alias("_bs"), F.col("_b._n0").alias("_bn"))
    current = cut_lineage(begin(sums))
    starts = current
    while True:
        ahead = groups.join_null_safe(sums, current, keys).filter(F.col("_x") > F.col("_bx"))
        mean = (F.col("_s0") - F.col("_bs")) / (F.col("_n0") - F.col("_bn"))
        current = cut_lineage(begin(ahead.filter(F.abs(F.col("_x") - mean) > thr).select(*keys, "_x", "_s0", "_n0")))
        if current.isEmpty():
            break
        starts = starts.unionByName(current)
    marks = starts.groupBy(*keys).agg(F.array_sort(F.collect_list("_bx")).alias("_starts"))
    number = F.size(F.filter("_starts", lambda b: b <= F.col("_x"))) - 1
    return groups.join_null_safe(sums, marks, keys).select(*keys, "_x", number.cast("bigint").alias("cluster"))


def cluster_gap(df: DataFrame, keys: list[str], value: str, gap: float, mode: str = "mean") -> DataFrame:
    """Merged line positions. `mean`: whole-number mean of values chained by steps up to `gap`; `first`: a value
    stays when it lies beyond the last one that stayed plus `gap`. Null values are left out; null keys are one key."""
    values = df.select(*keys, F.col(value).alias("v")).filter("v IS NOT NULL").distinct()
    v = F.col("v")
    chained = islands(values, keys, ["v"], tiles(v, 256), v, v, F.lit(gap), "_grp")
    if mode == "mean":
        return chained.groupBy(*keys, "_grp").agg(F.floor(F.avg("v")).alias("pos")).select(*keys, "pos")
    if mode != "first":
        raise ValueError(f"unknown mode {mode}")
    part = chained.select(*keys, "_grp", F.col("v").cast("double").alias("v"))
    small, large = groups.split_by_size(part, [*keys, "_grp"], groups.FOLD_LIMIT)

    def step(acc: Column, row: Column) -> Column:
        far = F.coalesce(row["v"] > F.get(acc, F.size(acc) - 1) + gap, F.lit(True))
        return F.when(far, F.concat(acc, F.array(row["v"]))).otherwise(acc)

    folded = groups.fold(small, [*keys, "_grp"], [F.col("v")], F.array().cast("array<double>"), step)
    out = folded.select(*keys, F.explode("folded").alias("pos"))
    return out if large is None else out.unionByName(_first_by_doubling(large, keys, gap))


def _first_by_doubling(part: DataFrame, keys: list[str], gap: float) -> DataFrame:
    """The values of long chains (keys, _grp, v) that stay, by pointer doubling.

    A value points to the first one beyond it plus `gap`, found on one sorted line. Each round follows the pointers of all that are
    known to stay and makes the pointers twice as long, so a chain of a million values takes 20 rounds.
    """
    rows = part.select(F.struct(*keys, "_grp").alias("of"), "v")
    marks = rows.select("of", F.col("v").alias("at"), F.lit(0).alias("side"), F.col("v").alias("mark"), "v")
    ends = rows.select("of", (F.col("v") + gap).alias("at"), F.lit(1).alias("side"), F.lit(None).cast("double").alias("mark"), "v")
    line = running(marks.unionByName(ends), ["of"], ["at", "side"], tiles(F.col("at"), 256), {"to": ("next", F.col("mark"))})
    jump = cut_lineage(line.filter("side = 1 AND to IS NOT NULL").select("of", "v", "to"))
    kept = cut_lineage(rows.groupBy("of").agg(F.min("v").alias("v")))
    while True:
        fresh = cut_lineage(kept.join(jump, ["of", "v"]).select("of", F.col("to").alias("v")))
        if fresh.isEmpty():
            return kept.select(*(F.col(f"of.{k}").alias(k) for k in keys), F.col("v").alias("pos"))
        kept = kept.unionByName(fresh)
        longer = jump.select("of", F.col("v").alias("to"), F.col("to").alias("next"))
        jump = cut_lineage(jump.join(longer, ["of", "to"]).select("of", "v", F.col("next").alias("to")))


def merge_bars(bars: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Bars of one row merged over small gaps; `pages` gives w and h per key.

    A bar whose centre lies below everything seen so far by more than the tolerance always starts anew. A page of up to FOLD_LIMIT bars is
    merged whole where its bars lie; a larger one is cut into such bands first and each band is merged on its own.
    """
    tol_y = F.greatest(F.lit(6), (0.008 * F.col("h")).cast("int"))
    tol_x = F.greatest(F.lit(6), (0.004 * F.col("w")).cast("int"))
    order = ["_cy", "x1", "y1", "x2", "y2"]
    whole, cut = groups.split_by_size(bars, keys, groups.FOLD_LIMIT)

    def sized(df: DataFrame) -> DataFrame:
        rows = df.join(pages.select(*keys, "w", "h"), keys).withColumn("_ty", tol_y).withColumn("_tx", tol_x)
        return rows.withColumn("_cy", F.floor((F.col("y1") + F.col("y2")) / 2)).drop("w", "h")

    along = Window.partitionBy(*keys).orderBy(*order)
    above = F.max("y2").over(along.rowsBetween(Window.unboundedPreceding, -1))
    rows = sized(whole).withColumn("_open", F.coalesce(above.isNull() | (F.col("_cy") - above > F.col("_ty")), F.lit(False)))
    rows = rows.select(*keys, "_open", "_cy", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "_ty", "_tx")))
    bar = "struct<x1:double,y1:double,x2:double,y2:double>"

    def step(acc: Column, row: Column, opens: bool) -> Column:
        cur = F.get(acc, F.size(acc) - 1)
        join = F.coalesce(
            (F.abs((row["y1"] + row["y2"]) / 2 - (cur["y1"] + cur["y2"]) / 2) <= row["_ty"]) & (row["x1"] - cur["x2"] <= row["_tx"]),
            F.lit(False),
        )
        if opens:
            join = join & ~row["_open"]
        grown = F.struct(cur["x1"].alias("x1"), F.least(cur["y1"], row["y1"]).alias("y1"),
                         F.greatest(cur["x2"], row["x2"]).alias("x2"), F.greatest(cur["y2"], row["y2"]).alias("y2")).cast(bar)
        own = F.struct(*(row[s].alias(s) for s in ("x1", "y1", "x2", "y2"))).cast(bar)
        return F.when(join, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(own)))

    def merged(df: DataFrame, of: list[str], fold_step: Callable, *ties: Column) -> DataFrame:
        folded = groups.fold(df, of, [*(F.col(c) for c in order), *ties], F.array().cast(f"array<{bar}>"), fold_step)
        return folded.select(*keys, F.explode("folded").alias("b")).select(*keys, "b.*")

    found = merged(rows, keys, lambda acc, row: step(acc, row, True), ~F.col("_open"))  # of equal bars the one that opens comes first
    if cut is None:
        return found
    rows = islands(sized(cut), keys, order, tiles(F.col("_cy"), 256), F.col("_cy"), F.col("y2"), F.col("_ty"), "_band")
    rows = rows.select(*keys, "_band", "_cy", *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "_ty", "_tx")))
    band = [*keys, "_band"]
    small, large = groups.split_by_size(rows, band, groups.FOLD_LIMIT)
    out = found.unionByName(merged(small, band, lambda acc, row: step(acc, row, False)))
    if large is None:
        return out
    n, types = len(keys), dict(large.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", x1 double, y1 double, x2 double, y2 double"

    def start(state):
        return None, [] if state is None else [state]

    def keep(state, row):
        x1, y1, x2, y2, ty, tx = row[n + 2:]
        if state is None:
            return (*row[:n], x1, y1, x2, y2), []
        a1, b1, a2, b2 = state[n:]
        if abs((y1 + y2) / 2 - (b1 + b2) / 2) <= ty and x1 - a2 <= tx:
            return (*row[:n], a1, min(b1, y1), max(a2, x2), max(b2, y2)), []
        return (*row[:n], x1, y1, x2, y2), [state]

    return out.unionByName(groups.scan_sorted(large, band, ["_cy", "x1", "y1", "x2", "y2"], start, keep, schema))


def merge_active_cells(cells: DataFrame, keys: list[str], col: str = "col") -> DataFrame:
    """Runs of neighbouring active columns: keys, start_col, end_col."""
    rows = cells.select(*keys, col).distinct()
    rows = islands(rows, keys, [col], tiles(F.col(col), 1024), F.col(col), F.col(col), F.lit(1), "_run")
    return rows.groupBy(*keys, "_run").agg(F.min(col).alias("start_col"), F.max(col).alias("end_col")).drop("_run")


def row_boundaries(lines: DataFrame, keys: list[str], axis: str = "y") -> DataFrame:
    """Intervals between neighbouring distinct edges: keys, pos (0-based), lo, hi."""
    edges = lines.select(*keys, F.explode(F.array(f"{axis}1", f"{axis}2")).alias("hi")).distinct()
    rows = running(edges, keys, ["hi"], tiles(F.col("hi"), 1024), {"lo": ("lag", F.col("hi")), "_k": ("row_number", None)})
    return rows.filter(F.col("lo").isNotNull()).select(*keys, (F.col("_k") - 2).alias("pos"), "lo", "hi")


def axis_scale(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """Pixels per day and origin from the first and last tick (x, date); null with one tick or zero days."""
    at = lambda f: f(F.struct("x", "date"), F.struct("x", "idx"))
    ends = ticks.groupBy(*keys).agg(at(F.min_by).alias("a"), at(F.max_by).alias("b"), F.count(F.lit(1)).alias("n"))
    days = F.datediff(F.col("b.date"), F.col("a.date"))
    good = (F.col("n") >= 2) & (days != 0)
    return ends.select(
        *keys, F.when(good, (F.col("b.x") - F.col("a.x")) / days).alias("px_per_day"),
        F.when(good, F.col("a.x").cast("double")).alias("x_origin"), F.col("a.date").alias("base_date"),
    )


def _steps(xs: DataFrame, keys: list[str], name: str) -> DataFrame:
    rows = xs.select(*keys, F.col("x").cast("double").alias("x"), "idx")
    rows = running(rows, keys, ["x", "idx"], tiles(F.col("x"), 256), {"_prev": ("lag", F.col("x"))})
    return rows.filter(F.col("_prev").isNotNull()).select(*keys, (F.col("x") - F.col("_prev")).alias(name))


def _median(df: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    n = F.col("n")
    out = value_at_ranks(df, keys, value, {"_lo": F.floor((n - 1) / 2), "_hi": F.ceil((n - 1) / 2)}, 16)
    return out.select(*keys, ((F.col("_lo") + F.col("_hi")) / 2).alias(name))


def grid_period(labels: DataFrame, ends: DataFrame, pages: DataFrame, keys: list[str], min_cols: int = 0) -> DataFrame:
    """Column spacing per page: median label step, else median of plausible steps between bar ends, else a default."""
    w = F.col("w")
    least = F.greatest(F.lit(6), (w / 64).cast("int"))
    most = F.greatest(least + 1, (w / max(6, min_cols or 12)).cast("int"))
    limits = pages.select(*keys, "w", least.alias("_least"), most.alias("_most"))
    by_label = _median(_steps(labels, keys, "d"), keys, "d", "_label")
    d = _steps(ends, keys, "d").join(limits, keys)
    plausible = F.col("d").between(F.col("_least"), F.greatest(2 * F.col("_most"), F.col("_least") + 1))
    by_end = _median(d.filter(plausible), keys, "d", "_end")
    n_ends = ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n_ends"))
    rows = limits.join(by_label, keys, "left").join(by_end, keys, "left").join(n_ends, keys, "left")
    label = F.col("_label")
    poor = label.isNull() | (label < F.col("_least")) | (label > 2 * F.col("_most"))
    period = F.when(poor & (F.coalesce("_n_ends", F.lit(0)) >= 4), F.coalesce("_end", label)).otherwise(label)
    default = F.greatest(F.lit(8.0), w / float(max(min_cols, 14) if min_cols > 0 else 16))
    return rows.select(*keys, F.when(period.isNull() | (period < 3), default).otherwise(period).alias("period"))


def fill_columns(columns: DataFrame, keys: list[str], min_cols: int) -> DataFrame:
    """Grid positions extended left and right in turn by the median step up to `min_cols` columns."""
    step = _median(_steps(columns, keys, "d"), keys, "d", "_step")
    ends = columns.groupBy(*keys).agg(F.min("x").alias("_a"), F.max("x").alias("_b"), F.count(F.lit(1)).alias("_n"))
    missing = F.greatest(F.lit(min_cols) - F.col("_n"), F.lit(0)).cast("int")
    rows = ends.join(step, keys).filter((F.col("_n") >= 2) & (missing > 0))
    left = F.transform(F.sequence(F.lit(1), F.ceil(missing / 2).cast("int")), lambda i: F.col("_a") - i * F.col("_step"))
    right = F.transform(
        F.filter(F.sequence(F.lit(0), F.floor(missing / 2).cast("int")), lambda i: i > 0), lambda i: F.col("_b") + i * F.col("_step"))
    extra = rows.select(*keys, F.explode(F.concat(left, right)).alias("x"))
    return columns.select(*keys, F.col("x").cast("double").alias("x")).unionByName(extra)


def interval_span_count(spans: DataFrame, intervals: DataFrame, keys: list[str], axis: str, idx: str = "idx") -> DataFrame:
    """How many intervals (lo, hi) each span box covers along an axis, at least 1."""
    flat = lambda df, lo, hi: df.withColumn("x1", F.col(lo)).withColumn("x2", F.col(hi)).withColumn(
        "y1", F.lit(0)).withColumn("y2", F.lit(1))
    a = flat(spans.select(*keys, idx, F.col(f"{axis}1").alias("_a"), F.col(f"{axis}2").alias("_b")), "_a", "_b")
    b = flat(intervals.select(*keys, "pos", "lo", "hi"), "lo", "hi")
    hits = spatial.overlap_pairs(a, b, keys).groupBy(*keys, idx).agg(F.count(F.lit(1)).alias("n_cover"))
    return spans.join(hits, [*keys, idx], "left").withColumn("n_cover", F.coalesce("n_cover", F.lit(1)))


def running_best(evals: DataFrame, keys: list[str], step: str = "step", value: str = "cer") -> DataFrame:
    """Best value so far and whether the step improved on all earlier ones."""
    rows = running(evals, keys, [step], tiles(F.col(step), 4096), {"_before": ("min_before", F.col(value))})
    return rows.withColumn("best", F.least(value, "_before")).withColumn(
        "is_best", (F.col("_before").isNull() | (F.col(value) < F.col("_before"))).cast("int")).drop("_before")


def run_progress(events: DataFrame) -> DataFrame:
    """Begin and end of each unit paired: run_id, index, total, latency_s (null while unfinished)."""
    begin = events.filter("event = 'begin'").select("run_id", "index", F.col("ts").alias("_b"))
    end = events.filter("event = 'end'").select("run_id", "index", F.col("ts").alias("_e"))
    total = begin.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"))
    micros = F.unix_micros("_e") - F.unix_micros("_b")
    return begin.join(end, ["run_id", "index"], "left").join(total, "run_id").select(
        "run_id", "index", "total", (micros / 1e6).alias("latency_s"))


def run_log(events: DataFrame) -> DataFrame:
    """Event rows of a run, in time order, as begin and end of numbered units."""
    rows = ranked(events, ["run_id"], ["ts", "event_id"], F.date_trunc("day", "ts"), "_k")
    return rows.select(
        "run_id", F.when(F.col("_k") % 2 == 1, "begin").otherwise("end").alias("event"),
        F.expr("(_k + 1) div 2").alias("index"), "ts",
    )
