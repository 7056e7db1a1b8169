"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.common import bound_batches, dropped, mix, slices, stored, utf8
from foliospark.session import scratch_path

#: Lengths of the subwords, rows of the embedding table (a power of two), length of an embedding.
SIZES, ROWS, WIDTH = (2, 3, 4), 1 << 15, 16
RATE, SEED = 0.5, 7
#: Passes over the documents: as many as make PASS_DOCS of them, EPOCHS at most and one at least.
EPOCHS, PASS_DOCS = 6, 18_000
#: Documents that one task learns from in a pass. Where there are several tasks, a pass has ROUNDS parts, and models are averaged after each.
TASK_DOCS, ROUNDS = 8000, 3
#: Rows of the embedding table that are averaged together.
CHUNK = 1 << 10
#: One of so many labelled documents (by a hash of id and text) isn't learnt from but sets temperature, commonness and limits.
CALIBRATION_STEP = 4
#: Temperatures that are tried.
TEMPERATURES = np.geomspace(0.2, 5, 40)
#: Share of rightly predicted calibration documents that the rejection may lose, half of it for each of its two measures.
LOSS = 0.001
#: Labelled documents are of a few domains: standard deviation of mean commonness (in natural logarithms) that is granted to texts of others,
#: and deviations that are granted to every text. A score of EVEN or more is never too low: the language is likelier than all others together.
DOMAIN, GRANTED, EVEN = 0.2, 9.0, 0.5
#: Code points handled at once; a longer text is taken in parts that overlap by one subword.
PART = 1 << 18


def letter_table() -> np.ndarray:
    """For each code point: 2 for letters, 1 for marks (which go on with a word), 0 for all else."""
    return np.array([{"L": 2, "M": 1}.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def subwords(points: np.ndarray, kind: np.ndarray, sizes: tuple[int, ...] = SIZES, rows: int = ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Position of the first code point, and row of the table, of every subword of the words in lower-cased code points.

    A word is a run of letters and marks with a border on either side; other code points only separate.
    """
    inside = kind > 0
    # borders: the code points before and after a word stand for themselves as a blank
    value = np.where(inside, points, 32).astype(np.uint64)
    ok = inside.copy()
    ok[1:] |= inside[:-1]
    ok[:-1] |= inside[1:]
    at, row = [], []
    for n in sizes:
        if len(points) < n:
            continue
        m = len(points) - n + 1
        h = np.full(m, n, np.uint64)
        whole = ok[:m].copy()
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + value[i : i + m]
            whole &= ok[i : i + m]
            if 0 < i < n - 1:
                whole &= inside[i : i + m]
        if n == 2:
            whole &= inside[:-1] | inside[1:]
        first = np.flatnonzero(whole)
        at.append(first)
        row.append((mix(h[first]) & np.uint64(rows - 1)).astype(np.int64))
    return (np.concatenate(at), np.concatenate(row)) if at else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Reader:
    """Subwords of texts."""

    def __init__(self, kinds: np.ndarray | None = None, sizes: tuple[int, ...] = SIZES, rows: int = ROWS):
        self.sizes, self.rows, self.kinds = sizes, rows, letter_table() if kinds is None else kinds

    def parts(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Document number and row of every subword, and which documents have letters, part by part."""
        lengths = np.array([len(t) for t in texts], np.int64)
        # a line feed before, between and after texts gives every word its borders; the one before a text belongs to it
        points = np.frombuffer(("\n" + "\n".join(texts) + "\n").encode("utf-32-le", "surrogatepass"), np.uint32)
        begins = np.concatenate([[0], np.cumsum(lengths + 1)])
        for lo in range(0, len(points), PART):
            # one more code point before and after, as borders
            a, b = max(0, lo - 1), min(len(points), lo + PART + max(self.sizes))
            own = points[a:b]
            kind = self.kinds[own]
            at, row = subwords(own, kind, self.sizes, self.rows)
            keep = (at + a < lo + PART) & (at + a >= lo)
            doc = np.searchsorted(begins, at[keep] + a, "right") - 1
            letters = np.unique(np.searchsorted(begins, np.flatnonzero(kind == 2) + a, "right") - 1)
            yield np.minimum(doc, len(texts) - 1), row[keep], letters

    def bags(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text its distinct rows and how often each occurs."""
        data, offs = utf8(column)
        for lo, hi in slices(offs, PART):
            texts = [data[s:e].tobytes().decode("utf-8", "replace").lower() for s, e in zip(offs[lo:hi], offs[lo + 1 : hi + 1], strict=True)]
            if hi - lo == 1:
                number = np.zeros(self.rows, np.int64)
                for _, row, _ in self.parts(texts):
                    number += np.bincount(row, minlength=self.rows)
                found = np.flatnonzero(number)
                yield found, number[found]
                continue
            found = [*self.parts(texts)]
            doc, row = (np.concatenate([f[i] for f in found]) for i in (0, 1))
            row = row[np.argsort(doc, kind="stable")]
            ends = np.cumsum(np.bincount(doc, minlength=hi - lo))
            for s, e in zip([0, *ends[:-1]], ends, strict=True):
                number = np.bincount(row[s:e], minlength=self.rows)
                found = np.flatnonzero(number)
                yield found, number[found]


@dataclass
class Model:
    """labels in code point order; table: for each subword its scores, then its commonness; bias; temperature.

    Commonness is the logarithm of a subword's share in the language that has most of it. A text's mean commonness doesn't depend on the
    languages among which the softmax chooses: texts of unlearned languages or of random letters fall short of `centre`, the mean
    of their predicted language. The shortfall is measured in deviations, from the variance `within` texts (over the number of
    subwords) and that `between` them. Rejected are texts that score under `least` or fall short by more than `farthest`.
    """

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    centre: np.ndarray | None = None
    within: np.ndarray | None = None
    between: np.ndarray | None = None
    least: float = EVEN
    farthest: float = GRANTED

    def probabilities(self, means: np.ndarray) -> np.ndarray:
        z = (means[:, : len(self.labels)] + self.bias) / self.temperature
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def accept(self, least: float, farthest: float) -> None:
        """Limits from what calibration documents need, never narrower than those set before."""
        self.least, self.farthest = min(self.least, least), max(self.farthest, farthest)

    def shortfall(self, means: np.ndarray, number: np.ndarray, best: np.ndarray) -> np.ndarray:
        if self.centre is None:
            return np.zeros(len(means))
        spread = self.between[best] + self.within[best] / np.maximum(number, 1)
        return (self.centre[best] - means[:, -1]) / np.sqrt(spread)


class Learner:
    """Stochastic gradient descent on the cross entropy; a text's features are the mean of its subwords' embeddings."""

    def __init__(self, e: np.ndarray, w: np.ndarray, bias: np.ndarray, weight: np.ndarray):
        self.e, self.w, self.bias, self.weight = e.astype(np.float64), w.astype(np.float64), bias.astype(np.float64), weight
        self.touched = np.zeros(len(e), bool)

    @classmethod
    def start(cls, numbers: np.ndarray, rows: int = ROWS, width: int = WIDTH, seed: int = SEED) -> Learner:
        """numbers: documents of each language."""
        rng = np.random.default_rng(seed)
        weight = (numbers.sum() / np.maximum(numbers, 1) / len(numbers)) ** 0.5
        return cls(rng.normal(0, 0.1, (rows, width)), rng.normal(0, 0.1, (width, len(numbers))), np.zeros(len(numbers)), weight)

    def step(self, idx: np.ndarray, n: np.ndarray, y: int, rate: float) -> None:
        if not len(idx):
            return
        share = (n / n.sum())[:, None]
        rows = self.e[idx]
        x = (share * rows).sum(0)
        z = x @ self.w + self.bias
        p = np.exp(z - z.max())
        p /= p.sum()
        p[y] -= 1
        p *= self.weight[y] * rate
        back = self.w @ p
        self.w -= np.outer(x, p)
        self.bias -= p * 0.1
        # the mean's gradient is shared out by occurrence; scaled so that common lengths move enough
        self.e[idx] = rows - share * back * min(len(idx), 200)
        self.touched[idx] = True


def commonness(seen: np.ndarray) -> np.ndarray:
    """Logarithm of each subword's share in the language that has most of it. seen: occurrences by subword and language."""
    seen = seen + 0.5
    return np.log((seen / seen.sum(0)).max(1))


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[str], epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """A model of bags at hand, in one process and not calibrated; `train` takes tables."""
    names = sorted(set(labels))
    if not names:
        return Model(["und"], np.zeros((ROWS, 2), np.float32), np.zeros(1))
    y = np.array([names.index(x) for x in labels])
    learner, seen = Learner.start(np.bincount(y, minlength=len(names))), np.zeros((ROWS, len(names)))
    rng = np.random.default_rng(SEED)
    order = np.concatenate([rng.permutation(len(y)) for _ in range(epochs)])
    for done, i in enumerate(order):
        learner.step(*bags[i], y[i], rate * (1 - done / len(order)))
    for i, (idx, n) in enumerate(bags):
        seen[idx, y[i]] += n
    return Model(names, np.column_stack([learner.e @ learner.w, commonness(seen)]).astype(np.float32), learner.bias)


def train(docs: DataFrame, trusted: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int | None = None) -> Model:
    """A model from all rows where `trusted` holds and lang isn't null; with `sample`, from about so many, as many of each language.

    One of CALIBRATION_STEP rows is kept out (by a hash of id and text; repeated rows go together): these set temperature, usual
    commonness and the limits of what is rejected. From all the others the model is learnt, and subwords are counted.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    own = docs.where(trusted & F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).cast("string").alias("text"), F.xxhash64(F.col(doc_id), F.col(text)).alias("h"))
    if sample is not None:
        counts = {r["lang"]: r["n"] for r in own.groupBy("lang").agg(F.count("*").alias("n")).collect()}
        share = F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, sample / len(counts) / n)))])[F.col("lang")] if counts else F.lit(1.0)
        own = own.where(F.pmod("h", F.lit(1_000_003)) < share * 1_000_003)
    held = F.pmod(F.xxhash64("h"), F.lit(CALIBRATION_STEP)) == 0
    counts = {r["lang"]: (r["n"], r["learnt"]) for r in own.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(~held).alias("learnt")).collect()}
    names = sorted(counts)
    if not names:
        return fit([], [])
    # a language of which all rows would be kept out is learnt from them
    held = held & ~F.col("lang").isin([k for k in names if not counts[k][1]])
    path = scratch_path(spark, "learn")
    numbers = np.array([counts[k][1] or counts[k][0] for k in names])
    tasks = max(1, int(numbers.sum()) // TASK_DOCS)
    # in the order of the hash, so that every task meets all languages, wherever the rows were
    own.where(~held).repartition(tasks, "h").sortWithinPartitions("h", "lang").write.parquet(path)
    table, bias = _learnt(spark.read.schema(own.schema).parquet(path), names, numbers)
    dropped(spark, path)
    model = Model(names, table, bias)
    _calibrate(own.where(held).select("text", "lang"), model)
    return model


def _learnt(rows: DataFrame, names: list[str], numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Table and bias of a model learnt from stored rows of lang, text and h.

    Every task goes on from the same model with its own documents. An embedding becomes the mean of those of the tasks that
    met its subword, all else the mean of all tasks; only these means reach the driver.
    """
    spark = rows.sparkSession
    learner, seen = Learner.start(numbers), np.zeros((ROWS, len(names)))
    epochs = min(EPOCHS, max(1, -(-PASS_DOCS // int(numbers.sum()))))
    tasks = rows.rdd.getNumPartitions()
    rounds = ROUNDS if tasks > 1 else 1
    expected, kinds = numbers.sum() / tasks / rounds, letter_table()
    for turn in range(epochs * rounds):
        sent = spark.sparkContext.broadcast((learner.e.astype(np.float32), learner.w, learner.bias, learner.weight, kinds))
        first = turn < rounds

        def learn(batches: Iterator[pa.RecordBatch], turn: int = turn, first: bool = first, sent: Broadcast = sent) -> Iterator[pa.RecordBatch]:
            e, w, bias, weight, kinds = sent.value
            own, reader, done = Learner(e, w, bias, weight), Reader(kinds), 0
            number = {k: i for i, k in enumerate(names)}
            seen = np.zeros((ROWS, len(names) if first else 0), np.float64)
            for batch in batches:
                for (idx, n), lang in zip(reader.bags(batch.column(1)), batch.column(0).to_pylist(), strict=True):
                    own.step(idx, n, number[lang], RATE * (1 - (turn + min(done / expected, 1.0)) / (epochs * rounds)))
                    done += 1
                    if first:
                        seen[idx, number[lang]] += n
            if done:
                parts = [np.vstack([own.w, own.bias]) * done, np.array([done])]
                blobs = [b"".join(x.astype(np.float64).tobytes() for x in parts)]
                move = ((own.e - e) * own.touched[:, None]).astype(np.float32)
                for at in range(0, ROWS, CHUNK):
                    to = slice(at, at + CHUNK)
                    blobs.append(move[to].tobytes() + own.touched[to].astype(np.float32).tobytes() + seen[to].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(blobs)), pa.int32()), pa.array([TaskContext.get().partitionId()] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["chunk", "part", "blob"])

        def add(batches: Iterator[pa.RecordBatch], first: bool = first) -> Iterator[pa.RecordBatch]:
            """Sums of a chunk's numbers; rows come by chunk and part."""
            total: dict[int, list[np.ndarray]] = {}
            cut = CHUNK * (WIDTH + 1) * 4
            for batch in batches:
                for chunk, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    got = [np.frombuffer(blob, np.float64)] if not chunk else [np.frombuffer(blob[:cut], np.float32).astype(np.float64), np.frombuffer(blob[cut:], np.float64)]
                    total[chunk] = [x + y for x, y in zip(total[chunk], got, strict=True)] if chunk in total else got
            if total:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(total.keys(), pa.int32()), pa.array([b"".join(x.tobytes() for x in v) for v in total.values()], pa.binary())], ["chunk", "blob"])

        own = rows.where(F.pmod(F.xxhash64("h", F.lit(1)), F.lit(rounds)) == turn % rounds)
        moves = own.mapInArrow(learn, "chunk int, part int, blob binary").repartition(min(tasks, ROWS // CHUNK), "chunk").sortWithinPartitions("chunk", "part")
        for r in moves.mapInArrow(add, "chunk int, blob binary").collect():
            got = np.frombuffer(bytes(r["blob"]), np.float64)
            if not r["chunk"]:
                mean = got[:-1].reshape(WIDTH + 1, len(names)) / got[-1]
                learner.w, learner.bias = mean[:-1], mean[-1]
                continue
            to, cut = slice((r["chunk"] - 1) * CHUNK, r["chunk"] * CHUNK), CHUNK * WIDTH
            learner.e[to] += got[:cut].reshape(CHUNK, WIDTH) / np.maximum(got[cut : cut + CHUNK], 1)[:, None]
            if first:
                seen[to] += got[cut + CHUNK :].reshape(CHUNK, len(names))
        sent.unpersist()
    return np.column_stack([learner.e @ learner.w, commonness(seen)]).astype(np.float32), learner.bias


def _calibrate(rows: DataFrame, model: Model) -> None:
    """Sets temperature, usual commonness of each language and limits from all rows (text, lang). Texts are read once."""
    spark, names = rows.sparkSession, model.labels
    sent = spark.sparkContext.broadcast((model.table, letter_table()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, kinds = sent.value
        reader, number, common = Reader(kinds), {k: i for i, k in enumerate(names)}, table[:, -1].astype(np.float64)
        for batch in batches:
            means, sizes, inside = [], [], []
            for idx, n in reader.bags(batch.column(0)):
                size = max(int(n.sum()), 1)
                means.append((n @ table[idx]) / size)
                sizes.append(int(n.sum()))
                inside.append(float(n @ common[idx] ** 2) / size - means[-1][-1] ** 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number[k] for k in batch.column(1).to_pylist()], pa.int32()), pa.array([m.tolist() for m in means], pa.list_(pa.float64())),
                 pa.array(sizes, pa.float64()), pa.array(inside, pa.float64())], ["y", "means", "size", "inside"])

    measured = stored(rows.mapInArrow(measure, "y int, means array<double>, size double, inside double"), "calibration")

    def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        means = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, len(names) + 1)
        return batch.column(0).to_numpy(), means, batch.column(2).to_numpy(), batch.column(3).to_numpy()

    head = {"labels": names, "table": np.zeros((0, len(names) + 1), np.float32), "bias": model.bias}

    def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = np.zeros(len(TEMPERATURES)), Model(**head)
        for batch in batches:
            y, means, _, _ = arrays(batch)
            for i, own.temperature in enumerate(TEMPERATURES):
                total[i] -= np.log(np.maximum(own.probabilities(means)[np.arange(len(y)), y], 1e-12)).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["at", "loss"])

    if measured.isEmpty():
        return
    sums = measured.mapInArrow(losses, "at int, loss double").groupBy("at").agg(F.sum("loss").alias("loss")).collect()
    model.temperature = head["temperature"] = float(TEMPERATURES[min(sums, key=lambda r: (r["loss"], r["at"]))["at"]])

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, own = np.zeros((len(names), 8)), Model(**head)
        for batch in batches:
            y, means, size, inside = arrays(batch)
            good = (own.probabilities(means).argmax(1) == y) & (size > 0)
            m, n = means[good, -1], size[good]
            of = np.column_stack([np.ones(len(n)), n**0.5, m * n**0.5, n, inside[good] * n, m, m * m, 1 / n])
            np.add.at(total, y[good], of)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], ["y", "sums"])

    each = np.zeros((len(names), 8))
    for r in measured.mapInArrow(moments, "y int, sums array<double>").select("y", F.posexplode("sums")).groupBy("y", "pos").agg(F.sum("col").alias("s")).collect():
        each[r["y"], r["pos"]] = r["s"]
    if not each[:, 0].any():
        return
    right = int(each[:, 0].sum())
    # a language with one text or none rightly predicted takes the numbers of all
    own = np.where(each[:, :1] > 1, each, each.sum(0))
    n, root, weighted, size, inside, m, squares, inverse = own.T
    model.centre, model.within = weighted / root, inside / size
    # what the mean of independent subwords doesn't explain
    model.between = DOMAIN**2 + np.maximum(0.0, (squares - 2 * model.centre * m - model.within * inverse) / n + model.centre**2)
    head |= {"centre": model.centre, "within": model.within, "between": model.between}

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(**head)
        for batch in batches:
            y, means, size, _ = arrays(batch)
            p = own.probabilities(means)
            good = (p.argmax(1) == y) & (size > 0)
            yield pa.RecordBatch.from_arrays([pa.array(p.max(1)[good]), pa.array(own.shortfall(means, size, y)[good])], ["score", "short"])

    # of all rightly predicted texts, so many may be lost by each measure: the limit is that of the next one
    judged, rank = measured.mapInArrow(judge, "score double, short double"), int(right * LOSS / 2) + 1
    least = judged.select("score").orderBy("score").limit(rank).agg(F.max("score")).first()[0]
    farthest = judged.select("short").orderBy(F.desc("short")).limit(rank).agg(F.min("short")).first()[0]
    model.accept(least, farthest)


#: Columns that `identify` adds.
ADDED = ("lang_pred", "score", "rejected")


def identify(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All columns of `docs`, then lang_pred, score (0 to 1) and rejected.

    lang_pred is `und` and score 0 if the text is null or has no letter; such texts are rejected, and those that the model's limits
    reject. Every row stays, repeated ones too. Columns of docs with the added names, in whatever case, are replaced.
    """
    names, rows = _scored(docs, model, text)
    keep = [i for i, c in enumerate(docs.columns) if c.lower() not in ADDED]
    return rows.select(*[names[i] for i in keep], *names[-4:-1]).toDF(*[docs.columns[i] for i in keep], *ADDED)


def accepted(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows that aren't rejected, with the columns of docs, whatever their names."""
    names, rows = _scored(docs, model, text)
    return rows.where(~F.col(names[-2])).select(*names[:-4]).toDF(*docs.columns)


def _scored(docs: DataFrame, model: Model, text: str) -> tuple[list[str], DataFrame]:
    """The columns of docs under names by position, then predicted language, score, rejected and shortfall; and all these names."""
    bound_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast((dict(vars(model)), letter_table()))  # ROWS x (languages + 1) numbers, and a byte a code point
    names = [f"c{i}" for i in range(len(docs.columns) + 4)]
    n = len(docs.columns)
    # the text comes last once more as a string
    rows = docs.toDF(*names[:n]).withColumn("t", F.col(names[docs.columns.index(text)]).cast("string"))
    types = (T.StringType(), T.DoubleType(), T.BooleanType(), T.DoubleType())
    schema = T.StructType([*rows.schema.fields[:-1], *(T.StructField(c, t) for c, t in zip(names[n:], types, strict=True))])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kinds = sent.value
        m, reader = Model(**known), Reader(kinds)
        for batch in batches:
            data, offs = utf8(batch.column(batch.num_columns - 1))
            labels, scores, shorts = [], [], []
            for lo, hi in slices(offs, PART):
                whole = data[offs[lo] : offs[hi]].tobytes()
                cuts = (offs[lo : hi + 1] - offs[lo]).tolist()
                texts = [whole[s:e].decode("utf-8", "replace").lower() for s, e in zip(cuts[:-1], cuts[1:], strict=True)]
                total, number, letters = np.zeros((hi - lo, m.table.shape[1])), np.zeros(hi - lo), np.zeros(hi - lo, bool)
                for doc, row, with_letters in reader.parts(texts):
                    values = m.table[row]
                    for c in range(m.table.shape[1]):
                        total[:, c] += np.bincount(doc, values[:, c], hi - lo)
                    number += np.bincount(doc, minlength=hi - lo)
                    letters[with_letters] = True
                means = total / np.maximum(number, 1)[:, None]
                p = m.probabilities(means)
                best = p.argmax(1)
                labels += [m.labels[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
                scores += np.where(letters, p.max(1), 0.0).tolist()
                shorts += np.where(letters, m.shortfall(means, number, best), 0.0).tolist()
            rejected = [label == "und" or score < m.least or short > m.farthest for label, score, short in zip(labels, scores, shorts, strict=True)]
            added = [pa.array(labels, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_()), pa.array(shorts, pa.float64())]
            yield pa.RecordBatch.from_arrays(batch.columns[:-1] + added, names=names)

    return names, rows.mapInArrow(predict, schema)
