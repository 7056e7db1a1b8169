"""Toxicity by two class-conditional Kneser-Ney models with shared backoff counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import WordHash, bound_batches, mix, slices, stored, sums_by_row, symbol_table, utf8, word_spans

#: Labelled documents of each class that the models are fitted on at most; further ones are left out by a hash of the id.
SAMPLE_DOCS = 3000
#: One labelled document in so many sets the calibration instead of the counts.
CALIBRATION_STEP = 4
#: Code points of a word's stem, the level between a word and the counts that both classes share.
STEM = 4
#: Discount of a class's count: an absolute part, and so many times one more than what the other class has, brought to this class's
#: size. Only what a class has clearly more of stays its own; all else, such as a topic or language a little more common in
#: it, or words that the smaller sample lacks by chance, is backoff.
DISCOUNT, TIMES = 2.0, 4.0
THRESHOLD = 0.3


def tokens(data: np.ndarray, offsets: np.ndarray, hasher: WordHash) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words (letters, digits, non-ASCII; A-Z lower-cased), of the words before them, of their stems, and each row's first word."""
    b = data[offsets[0] : offsets[-1]]
    starts, ends, first = word_spans(data, offsets, symbol_table())
    if not len(starts):
        none = np.zeros(0, np.uint64)
        return none, none, none, first
    word = hasher(b, starts, ends)
    begins = np.flatnonzero((b & 0xC0) != 0x80)
    cut = np.append(begins, len(b))[np.minimum(np.searchsorted(begins, starts) + STEM, len(begins))]
    stem = hasher(b, starts, np.minimum(ends, cut))
    before = np.concatenate([np.zeros(1, np.uint64), word[:-1]])
    before[first[:-1][first[:-1] < len(word)]] = 0  # 0: the text's start
    return word, before, stem, first


def pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return mix(before * np.uint64(0xD6E8FEB86659FD93) + word)


def look_up(keys: np.ndarray, table: np.ndarray, values: np.ndarray, default: float = 0.0) -> np.ndarray:
    """Rows of `values` (2-D) for `keys` in the sorted `table`; `default` where missing."""
    out = np.full((len(keys), values.shape[1]), default)
    if len(table):
        at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
        there = table[at] == keys
        out[there] = values[at[there]]
    return out


class Models:
    """Ordinary (0) and toxic (1) model: word given the word before, then the word, then its stem, then shared counts."""

    def __init__(self, **parts: np.ndarray):
        self.__dict__ |= parts

    def ratio(self, word: np.ndarray, before: np.ndarray, stem: np.ndarray) -> np.ndarray:
        """log P_toxic - log P_ordinary of each word."""
        stems = look_up(stem, self.stem_key, self.stem_value)  # class parts 0 and 1, pooled count
        words = look_up(word, self.word_key, self.word_value)
        shared_stem = (stems[:, 2] + 0.5) / (self.stem_total + 1)
        shared_word = (words[:, 2] + 0.5) / (stems[:, 2] + 1)
        rest = look_up(before, self.before_key, self.before_value, 1.0)
        seen = look_up(pair(before, word), self.pair_key, self.pair_value)
        log = []
        for c in (0, 1):
            p = stems[:, c] + self.stem_rest[c] * shared_stem
            p = words[:, c] + self.word_rest[c] * p * shared_word
            log.append(np.log(seen[:, c] + rest[:, c] * p))
        return log[1] - log[0]


def _with_parts(counts: DataFrame, keys: list[str]) -> DataFrame:
    """Counts n of both classes by `keys`, with what the discount leaves."""
    sums = {r["toxic"]: r["n"] for r in counts.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    size = [max(sums.get(c, 0), 1) for c in (0, 1)]
    scale = F.when(F.col("toxic") == 1, F.lit(size[1] / size[0])).otherwise(F.lit(size[0] / size[1]))
    both = counts.groupBy(*keys).agg(F.sum("n").alias("pool"))
    other = F.col("pool") - F.col("n") + 1
    return counts.join(both, keys).withColumn("part", F.greatest(F.lit(0.0), F.col("n") - DISCOUNT - TIMES * scale * other))


def _fit(rows: DataFrame) -> Models:
    """rows: toxic, earlier, before, word, stem. Only counts that keep something after the discount leave Spark.

    As in Kneser-Ney a pair counts once for each word in front of it, and a word once for each word in front of it:
    what copies repeat in the same place counts once.
    """
    pairs = stored(rows.distinct().groupBy("toxic", "before", "word", "stem").agg(F.count("*").alias("n")), "counts")
    pairs = stored(_with_parts(pairs, ["before", "word", "stem"]), "pairs")
    of = pairs.groupBy("toxic", "before").agg(F.sum("n").alias("total"), F.sum("part").alias("kept")).where("kept > 0")
    kept = pairs.where("part > 0").select("toxic", "before", "word", "part").toPandas()
    contexts = of.toPandas()
    words = stored(_with_parts(pairs.groupBy("toxic", "word", "stem").agg(F.count("*").alias("n")), ["word", "stem"]), "words").drop("pool")
    stems = _with_parts(words.groupBy("toxic", "stem").agg(F.sum("n").alias("n")), ["stem"])

    def wide(df: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        sums = {r["toxic"]: (r["n"], r["kept"]) for r in df.groupBy("toxic").agg(F.sum("n").alias("n"), F.sum("part").alias("kept")).collect()}
        pool = df.groupBy(key).agg(*[F.sum(F.when(F.col("toxic") == c, F.col("part")).otherwise(0.0)).alias(f"p{c}") for c in (0, 1)], F.sum("n").alias("n"))
        pdf = pool.where("n > 1").toPandas()
        keys = pdf[key].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(keys)
        total = [max(sums.get(c, (0, 0))[0], 1) for c in (0, 1)]
        value = np.column_stack([pdf["p0"] / total[0], pdf["p1"] / total[1], pdf["n"]]).astype(float)[order].reshape(-1, 3)
        rest = np.array([1 - sums.get(c, (0, 0.0))[1] / total[c] for c in (0, 1)])
        return keys[order], value, rest, float(sum(x[0] for x in sums.values()))

    def classes(pdf: pd.DataFrame, keys: np.ndarray, value: np.ndarray, default: float) -> tuple[np.ndarray, np.ndarray]:
        unique, at = np.unique(keys, return_inverse=True)
        out = np.full((len(unique), 2), default)
        out[at, pdf["toxic"].to_numpy(np.int64)] = value
        return unique, out

    u = contexts["before"].to_numpy(np.int64).view(np.uint64)
    before_key, before_value = classes(contexts, u, 1 - (contexts["kept"] / contexts["total"]).to_numpy(float), 1.0)
    total = kept.merge(contexts[["toxic", "before", "total"]], on=["toxic", "before"])
    pair_key, pair_value = classes(
        total, pair(total["before"].to_numpy(np.int64).view(np.uint64), total["word"].to_numpy(np.int64).view(np.uint64)), (total["part"] / total["total"]).to_numpy(float), 0.0)
    word_key, word_value, word_rest, _ = wide(words, "word")
    stem_key, stem_value, stem_rest, stem_total = wide(stems, "stem")
    return Models(before_key=before_key, before_value=before_value, pair_key=pair_key, pair_value=pair_value, word_key=word_key, word_value=word_value,
                  word_rest=word_rest, stem_key=stem_key, stem_value=stem_value, stem_rest=stem_rest, stem_total=stem_total, weights=np.array([0.0, 0.0, -3.0]))


def features(models: Models, data: np.ndarray, offsets: np.ndarray, hasher: WordHash) -> np.ndarray:
    """Of each row the log ratio for each word and for each root of the word number; the second loses less in long texts."""
    word, before, stem, first = tokens(data, offsets, hasher)
    total, n = sums_by_row(models.ratio(word, before, stem), first), np.maximum(np.diff(first), 1)
    return np.column_stack([total / n, total / np.sqrt(n), np.ones(len(n))])


def _calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logistic regression with a small ridge, by Newton steps."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3, 1e-3, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += step * min(1.0, 5.0 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, trusted: Column, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE_DOCS) -> Models:
    """Models from labelled documents where `trusted` holds (a condition on doc_id); at most about `sample` of either class.

    Null ids or labels are left out; a document labelled twice is toxic if one label says so. Without labels every text scores alike.
    """
    bound_batches(docs.sparkSession)
    marks = labels.where(trusted & F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["n"] for r in marks.groupBy("toxic").agg(F.count("*").alias("n")).collect() if r["toxic"] in (0, 1)}
    h = F.pmod(F.xxhash64("_id"), F.lit(1_000_003))
    share = F.coalesce(*[F.when(F.col("toxic") == c, F.lit(min(1.0, sample / n))) for c, n in counts.items()], F.lit(0.0))
    chosen = marks.where(h < share * 1_000_003).withColumn("held", F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(CALIBRATION_STEP)) == 0)
    # about 2 * sample rows
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text"))
    own = texts.join(F.broadcast(chosen), "_id").select("toxic", "held", "text")
    own = own.groupBy(F.sha2("text", 256)).agg(F.max("toxic").alias("toxic"), F.max("held").alias("held"), F.first("text").alias("text"))  # copies count once

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash()
        for batch in batches:
            data, offs = utf8(batch.column(1))
            toxic = batch.column(0).to_numpy(zero_copy_only=False)
            for lo, hi in slices(offs):
                word, before, stem, first = tokens(data, offs[lo : hi + 1], hasher)
                own = np.repeat(toxic[lo:hi].astype(np.int32), np.diff(first))
                earlier = np.where(before == 0, np.uint64(0), np.concatenate([np.zeros(1, np.uint64), before[:-1]])[: len(before)])
                yield pa.RecordBatch.from_arrays([pa.array(own), *[pa.array(v.view(np.int64)) for v in (earlier, before, word, stem)]], ["toxic", "earlier", "before", "word", "stem"])

    models = _fit(own.where("NOT held").select("toxic", "text").mapInArrow(pairs, "toxic int, earlier bigint, before bigint, word bigint, stem bigint"))
    sent = docs.sparkSession.sparkContext.broadcast(dict(vars(models)))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, m = WordHash(), Models(**sent.value)
        for batch in batches:
            data, offs = utf8(batch.column(1))
            x = np.concatenate([np.zeros((0, 3))] + [features(m, data, offs[lo : hi + 1], hasher) for lo, hi in slices(offs)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x[:, 0]), pa.array(x[:, 1])], ["toxic", "a", "b"])

    held = own.where("held").select("toxic", "text").mapInArrow(rate, "toxic int, a double, b double").toPandas()
    if held["toxic"].nunique() == 2:
        x = np.column_stack([held["a"], held["b"], np.ones(len(held))])
        y = held["toxic"].to_numpy(float)
        # classes weigh as among all labels
        weight = np.array([counts[int(c)] / max((y == c).sum(), 1) for c in y])
        models.weights = _calibrate(x, y, weight / weight.sum() * len(y))
    return models


def score(docs: DataFrame, models: Models, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, score (0 to 1) and predicted (1 from `threshold` on). A null text is an empty one; repeated
    rows and null ids stay; other columns are not read."""
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(dict(vars(models)))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, m = WordHash(), Models(**sent.value)
        for batch in batches:
            data, offs = utf8(batch.column(1))
            x = np.concatenate([np.zeros((0, 3))] + [features(m, data, offs[lo : hi + 1], hasher) for lo, hi in slices(offs)])
            p = 1 / (1 + np.exp(-np.clip(x @ m.weights, -700, 700)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    out = rows.mapInArrow(rate, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
