"""Exact top-k search by inner product: term by term, sparse query rows scatter weighted postings into dense score arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import bound_batches, partitions, stored

#: Results of a query; what a component is multiplied by before it is rounded down.
K, SCALE = 10, 1024
#: Queries that a task holds at most, with their best candidates so far.
QUERY_PACK = 1 << 14
#: Below this, sums of whole numbers are exact in doubles.
EXACT = 2.0**53
LONG = 2**63 - 1


def top_k(vectors: DataFrame, is_query: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the `k` rows of `vectors` with the highest integer inner product for each query row.

    A component x counts as floor(scale * x). Every query row (`is_query`) meets every other row; equal scores go by the smaller
    vec_id, null ids last. A vector that is null or has a null, NaN or infinite component takes no part; an empty vector scores 0
    with all; of vectors of unequal lengths the shorter counts as filled up with zeros. Repeated rows and ids are rows of their own, and
    a row is never its own candidate. A score beyond a long counts as its end. Queries: at most `k` rows each, fewer if the table has fewer.

    The queries are dealt to packs of about QUERY_PACK, the rows to slices; a task has one pack and one slice. It reads the slice
    batch by batch, turns a batch into postings (term: rows and weights), scores it for one query at a time and keeps each
    query's best k. Those are merged by query: k rows for each slice. The number of slices falls as that of packs grows.
    """
    spark = vectors.sparkSession
    bound_batches(spark)
    value = F.col(embedding)
    whole = value.isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(whole).select(
        F.monotonically_increasing_id().alias("row"), F.col(vec_id).cast("long").alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"),
        value.cast("array<double>").alias("vector"))
    rows = stored(rows, "vectors")
    packs = max(1, math.ceil(rows.where("asks").count() / QUERY_PACK))
    slices = max(1, math.ceil(2 * partitions(rows) / packs))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n, seed: F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(n)).cast("int")
    asked = rows.where("asks").select("row", "id", "vector", F.lit(True).alias("asks"), dealt(packs, 1).alias("pack"), every(slices).alias("slice"))
    found = rows.select("row", "id", "vector", F.lit(False).alias("asks"), every(packs).alias("pack"), dealt(slices, 2).alias("slice"))
    # one pair of pack and slice is one partition, its queries first
    placed = asked.union(found).repartitionById(packs * slices, F.col("pack") * slices + F.col("slice")).sortWithinPartitions(F.desc("asks"), "row")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: list[Query] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, row = batch.column("id"), batch.column("row").to_numpy()
            none = ids.is_null().to_numpy(zero_copy_only=False)
            ids = ids.fill_null(0).to_numpy()
            asks = int(np.count_nonzero(batch.column("asks").to_numpy(zero_copy_only=False)))
            term, of, weight = terms(batch.column("vector"), scale)
            edges = np.searchsorted(of, np.arange(asks + 1))
            for i in range(asks):
                own = slice(edges[i], edges[i + 1])
                queries.append(Query(int(row[i]), None if none[i] else int(ids[i]), term[own], weight[own], k))
            if asks < batch.num_rows and queries:
                block = Block(row[asks:], ids[asks:], none[asks:], term[edges[asks] :], of[edges[asks] :] - asks, weight[edges[asks] :])
                for q in queries:
                    q.take(block)
        for lo in range(0, len(queries), 1024):
            best = [(q.row, q.id, None if none else i, int(s)) for q in queries[lo : lo + 1024] for s, none, i in q.best]
            columns = zip(*best, strict=True) if best else ([],) * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query", "query_id", "vec_id", "score"])

    near = placed.select("row", "id", "vector", "asks").mapInArrow(search, "query long, query_id long, vec_id long, score long")
    place = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return near.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def terms(vectors: pa.ListArray, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all components that aren't zero after rounding: their place in the vector, the vector's number, the rounded value.

    Values are doubles, or Python's whole numbers where a double can't hold scale * x exactly.
    """
    lengths = np.diff(vectors.offsets.to_numpy())
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    of = np.repeat(np.arange(len(lengths)), lengths)
    term = np.arange(len(x)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    if len(x) and np.abs(x).max() * scale >= EXACT:
        value = np.array([int(v) * scale if abs(v) >= EXACT else math.floor(v * scale) for v in x.tolist()], dtype=object)
    else:
        value = np.floor(x * scale)
    at = np.flatnonzero(value != 0)
    return term[at], of[at], value[at]


class Block:
    """Candidates with their postings: for each term the rows that have it (all: a slice) and their weights."""

    def __init__(self, row: np.ndarray, ids: np.ndarray, none: np.ndarray, term: np.ndarray, of: np.ndarray, weight: np.ndarray):
        self.row, self.ids, self.none = row, ids, none
        order = np.argsort(term, kind="stable")
        term, of, weight = term[order], of[order], weight[order]
        self.most = max(abs(weight.min()), abs(weight.max())) if len(weight) else 0
        if self.most < EXACT:
            weight = weight.astype(np.float64)
        edges = np.flatnonzero(np.diff(term, prepend=-1, append=-1))
        self.postings = {
            int(term[lo]): (slice(None) if hi - lo == len(row) else of[lo:hi], np.ascontiguousarray(weight[lo:hi]))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True)}


class Query:
    """A query's terms and weights, and its best candidates so far as (score, id is null, id), best first."""

    def __init__(self, row: int, vec_id: int | None, term: np.ndarray, weight: np.ndarray, k: int):
        self.row, self.id, self.k, self.best = row, vec_id, k, []
        self.terms = list(zip(term.tolist(), weight.tolist(), strict=True))
        self.total = sum(abs(int(w)) for _, w in self.terms)

    def scores(self, block: Block) -> np.ndarray:
        """Inner products with all rows of the block, gathered one term at a time."""
        exact = self.total * int(block.most) < EXACT
        out = np.zeros(len(block.row), np.float64 if exact else object)
        for t, w in self.terms:
            if t in block.postings:
                rows, weights = block.postings[t]
                out[rows] += (w * weights) if exact else (int(w) * np.array([int(v) for v in weights], dtype=object))
        return out if exact else np.clip(out, -LONG - 1, LONG)

    def take(self, block: Block) -> None:
        score = self.scores(block)
        at = np.arange(len(score))
        if len(self.best) == self.k:
            at = np.flatnonzero(score >= self.best[-1][0])
        at = at[block.row[at] != self.row]
        if len(at) > self.k:  # the k-th highest score; below it nothing is needed
            own = score[at]
            least = np.partition(own, len(own) - self.k)[len(own) - self.k] if own.dtype != object else sorted(own)[-self.k]
            sure, ties = at[own > least], at[own == least]
            at = np.concatenate([sure, ties[np.lexsort((block.ids[ties], block.none[ties]))[: self.k - len(sure)]]])
        if len(at):
            new = zip(score[at].tolist(), block.none[at].tolist(), block.ids[at].tolist(), strict=True)
            self.best = sorted([*self.best, *new], key=lambda b: (-b[0], b[1], b[2]))[: self.k]


ORACLE_SQL = f"""
WITH parts AS (
  SELECT vec_id, row_number() OVER () AS n, list_transform(embedding, lambda x: floor({SCALE} * x::double)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
)
SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.n ORDER BY list_inner_product(q.v, p.v) DESC, p.vec_id)::int AS rank, p.vec_id, list_inner_product(q.v, p.v)::bigint AS score
FROM parts q JOIN parts p ON q.n <> p.n WHERE q.vec_id % 100 = 0 QUALIFY rank <= {K}
"""
