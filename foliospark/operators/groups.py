"""Work whose result depends on the order inside a group.

Groups up to a checked size are folded in one task; larger ones go a distributed way given by the operator.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from foliospark.operators import graph
from foliospark.session import cut_lineage

FOLD_LIMIT = 2000
#: Conflicts or candidates of one key or component that one task goes through, holding their ids.
SETTLE_LIMIT = 200_000


def split_by_size(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of groups up to `limit`, rows of larger groups or None). Counts once, moving only counts."""
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select(*keys)
    if large.isEmpty():
        return df, None
    large = cut_lineage(large)
    same = [F.col("d." + k).eqNullSafe(F.col("k." + k)) for k in keys]
    return df.alias("d").join(large.alias("k"), same, "left_anti"), df.alias("d").join(large.alias("k"), same, "left_semi")


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on `keys` where null meets null; columns as of a join by names."""
    rest = [c for c in right.columns if c not in keys]
    other = right.select(*(F.col(k).alias("_r_" + k) for k in keys), *rest)
    same = [F.col(k).eqNullSafe(F.col("_r_" + k)) for k in keys]
    return left.join(other, same, how).select(*keys, *(c for c in left.columns if c not in keys), *rest)


def join_placed(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Null-safe join, inner or left, that moves no side already placed by `keys`: rows without a key meet apart, if `right` has any."""
    lacks = lacking(keys)
    alone = right.filter(lacks)
    if alone.isEmpty():
        return left.join(right, keys, how)
    return left.filter(~lacks).join(right, keys, how).unionByName(join_null_safe(left.filter(lacks), alone, keys, how))


def lacking(columns: list[str]) -> Column:
    """Whether any of the columns is null."""
    return functools.reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))


def fold(
    df: DataFrame, keys: list[str], order: list[Column], init: Column, step: Callable, finish: Callable | None = None,
    name: str = "folded",
) -> DataFrame:
    """`aggregate` over the ordered rows of a group of bounded size; `step(acc, row)` sees a struct of all columns."""
    rest = [c for c in df.columns if c not in keys]
    entry = F.struct(F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order))).alias("_o"), *(F.col(c) for c in rest))
    rows = F.array_sort(F.collect_list(entry))
    folded = F.aggregate(F.col("_rows"), init, step, finish) if finish else F.aggregate(F.col("_rows"), init, step)
    return df.groupBy(*keys).agg(rows.alias("_rows")).select(*keys, folded.alias(name))


def map_groups(
    df: DataFrame, keys: list[str], order: list[str | Column], fn: Callable[[tuple, pd.DataFrame], pd.DataFrame | None], schema: str,
    columns: list[str] | None = None,
) -> DataFrame:
    """Calls `fn(key, rows)` for every group of bounded size, many groups per Arrow batch.

    Rows are placed by key and sorted by (key, order), then cut to `columns`; a group that runs over a batch end is carried on.
    """
    def each(batch: pd.DataFrame, cuts: list[int]) -> pd.DataFrame | None:
        out = [fn(k, batch.iloc[a:b]) for k, a, b in _slices(batch, keys, cuts[:-1], cuts[-1])]
        out = [o for o in out if o is not None and len(o)]
        return pd.concat(out, ignore_index=True) if out else None

    return map_batches(df, keys, order, each, schema, columns)


def map_batches(
    df: DataFrame, keys: list[str], order: list[str | Column], fn: Callable[[pd.DataFrame, list[int]], pd.DataFrame | None], schema: str,
    columns: list[str] | None = None,
) -> DataFrame:
    """Calls `fn(rows, cuts)` for many whole groups of bounded size at once; group i is rows cuts[i] to cuts[i + 1].

    For work on very many small groups, where a frame for each would cost more than the work. Placed and sorted as by `map_groups`.
    """
    # by a hash of the keys: a union whose parts are each placed by key counts as placed, though adaptive execution merges their partitions apart
    placed = df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys, *order).select(*(columns or df.columns))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail: list[pd.DataFrame] = []
        for batch in batches:
            if len(batch) == 0:
                continue
            if tail:
                batch = pd.concat([*tail, batch], ignore_index=True)
            starts = _starts(batch, keys)
            done = fn(batch.iloc[:starts[-1]], starts) if len(starts) > 1 else None
            tail = [batch.iloc[starts[-1]:]]
            if done is not None and len(done):
                yield done
        if tail:
            last = tail[0].reset_index(drop=True)
            done = fn(last, [0, len(last)])
            if done is not None and len(done):
                yield done

    return placed.mapInPandas(run, schema)


def _starts(batch: pd.DataFrame, keys: list[str]) -> list[int]:
    """First rows of the groups; null (and NaN) is a key like any other."""
    before = batch[keys].shift()
    changed = ((batch[keys] != before) & ~(batch[keys].isna() & before.isna())).any(axis=1).to_numpy()
    changed[:1] = True
    return changed.nonzero()[0].tolist()


def same_key(a: tuple | None, b: tuple) -> bool:
    """Whether two keys are equal, null with null and NaN with NaN."""
    return a is not None and all(x == y or (pd.isna(x) and pd.isna(y)) for x, y in zip(a, b))


def _slices(batch: pd.DataFrame, keys: list[str], starts: list[int], end: int):
    columns = [batch[k].to_numpy() for k in keys]
    for a, b in zip(starts, [*starts[1:], end]):
        yield tuple(c[a] for c in columns), a, b


def by_component(edges: DataFrame, of: str, a: str, b: str) -> tuple[DataFrame, DataFrame | None]:
    """(edges with `_part`, each part one task's work; edges of parts too large for one task or None).

    A part is a key `of` with up to SETTLE_LIMIT edges, else a connected component of its edges between `a` and `b`.
    """
    small, large = split_by_size(edges, [of], SETTLE_LIMIT)
    small = small.withColumn("_part", F.col(of))
    if large is None:
        return small, None
    parts = graph.components(large, a, b).select(F.col("node").alias(a), F.concat(F.lit("of "), "component").alias("_part"))
    large = cut_lineage(large.join(parts, a).select(*edges.columns, "_part"))
    middle, large = split_by_size(large, ["_part"], SETTLE_LIMIT)
    return small.unionByName(middle), large


def settle_conflicts(edges: DataFrame, of: str, order: list[str], winner: str, loser: str) -> DataFrame:
    """Ids dropped when nodes are taken in rank order and a taken node drops its losers.

    `edges` holds (of, order, winner, loser): ids are strings, the winner is ranked higher, at `order`. Along the winners, each
    is decided when its turn comes, so a part is one pass over its sorted edges. A part too large for a task settles in rounds: every
    round takes all nodes that nobody undecided can drop any more, and its state is checkpointed.
    """
    edges = cut_lineage(edges.select(of, *order, winner, loser).distinct())
    parts, large = by_component(edges, of, winner, loser)

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        gone: set[str] = set()
        for first, second in zip(rows[winner], rows[loser]):
            if first not in gone:
                gone.add(second)
        return pd.DataFrame({loser: sorted(gone)})

    dropped = map_groups(parts, ["_part"], order, walk, f"{loser} string", ["_part", winner, loser])
    if large is None:
        return dropped
    edges = cut_lineage(large.select(winner, loser))
    while not edges.isEmpty():
        top = edges.select(winner).distinct().join(
            edges.select(F.col(loser).alias(winner)).distinct(), winner, "left_anti"
        )
        gone = cut_lineage(edges.join(top, winner, "left_semi").select(loser).distinct())
        edges = edges.join(gone, loser, "left_anti").join(gone.select(F.col(loser).alias(winner)), winner, "left_anti")
        edges = cut_lineage(edges)
        dropped = dropped.unionByName(gone)
    return dropped


def settle_matches(candidates: DataFrame, of: str, left: str, order: str, right: str, score: str) -> DataFrame:
    """One-to-one pairs (left, right) when left ids, in `order`, each take the best free right id.

    `left` and `right` are strings; `order` and `score` must break their own ties. A part is one pass over its candidates, sorted by order
    and falling score. In a part too large for a task, a left id whose best free right id has no earlier left
    candidate is final; rounds settle all of these at once.
    """
    open_pairs = cut_lineage(candidates.select(of, left, order, right, score))
    parts, large = by_component(open_pairs, of, left, right)

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        done: dict[str, str] = {}
        taken: set[str] = set()
        for a, b in zip(rows[left], rows[right]):
            if a not in done and b not in taken:
                done[a] = b
                taken.add(b)
        return pd.DataFrame({left: list(done), right: list(done.values())})

    found = map_groups(parts, ["_part"], [order, F.col(score).desc()], walk, f"{left} string, {right} string", ["_part", left, right])
    if large is None:
        return found
    open_pairs = cut_lineage(large.select(left, order, right, score))
    while not open_pairs.isEmpty():
        best = open_pairs.groupBy(left, order).agg(
            F.max_by(F.struct(right, score), score).alias("_b")
        )
        first = open_pairs.groupBy(right).agg(F.min_by(left, order).alias("_first"))
        done = best.select(left, f"_b.{right}").join(first, right).filter(F.col("_first") == F.col(left)).select(left, right)
        done = cut_lineage(done)
        open_pairs = open_pairs.join(done.select(left), left, "left_anti").join(done.select(right), right, "left_anti")
        open_pairs = cut_lineage(open_pairs)
        found = found.unionByName(done)
    return found


def scan_sorted(df: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, schema: str) -> DataFrame:
    """Sequential state over the sorted rows of a key, holding one Arrow batch and one state at a time.

    `step(state, row)` returns (state, finished rows); `start(None)` gives the first state and, called with the
    last state of a key, its remaining rows. `row` is a tuple in the order of the columns.
    """
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [c.split()[0].split(":")[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out: list = []
            key_rows = list(zip(*(batch[k] for k in keys)))
            for k, row in zip(key_rows, batch.itertuples(index=False, name=None)):
                if not same_key(key, k):
                    if key is not None:
                        out.extend(start(state)[1])
                    key, state = k, start(None)[0]
                state, done = step(state, row)
                out.extend(done)
            if out:
                yield pd.DataFrame(out, columns=names)
        if key is not None:
            rest = start(state)[1]
            if rest:
                yield pd.DataFrame(rest, columns=names)

    return placed.mapInPandas(run, schema)
