"""Alignment of two tokenizers: how often their ids overlap in a corpus, counted from compressed runs of pair and document records.

Tasks tokenize documents and, every FLUSH_DOCS documents, sort their records (id pair, document, links) and cut them by the side B id
into buckets: zstd runs in order of (B id, A id). The runs' pairs are merged by a heap, a few runs at a time, until each bucket has one
table of counts, in which the A ids of a B id stand together, so its highest count is known as it ends. The tables then meet the runs
again, and what each run adds to its documents streams back.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import bound_batches, stored

#: Folder of public tokenizer files, and the two that are aligned.
TOKENIZERS, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Buckets of B ids; documents and bytes of text of one flush (a longer text is a flush of its own).
BUCKETS, FLUSH_DOCS, FLUSH_BYTES = 32, 1 << 13, 8 << 20
#: Runs that one merge reads, pairs of a compressed block, compressed bytes of runs that one task joins with their bucket's counts.
FAN_IN, BLOCK_PAIRS, SPLIT_BYTES = 64, 1 << 14, 32 << 20
#: Bits of an id, of a document's number in its flush.
ID_BITS, DOC_BITS = 20, 13


class Side:
    """A tokenizer as needed here: ids of texts, and the bytes of each id."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.length = np.array([len(p) for p in pieces], np.int64)


class ByteSide(Side):
    """Byte-level BPE from its JSON file. Encoded by ranks, which the file's order of merges must equal; what that can't take goes to the
    slower library, with the same ids."""

    #: Fixed: the pattern that byte-level BPE of this kind cuts texts with.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, data: bytes):
        import tiktoken

        spec = json.loads(data)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        special = {t["id"] for t in spec.get("added_tokens", [])}
        vocab = {token: i for token, i in spec["model"]["vocab"].items() if i not in special}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
        pairs = (m.split(" ", 1) if isinstance(m, str) else m for m in spec["model"]["merges"])
        merged = [vocab["".join(pair)] for pair in pairs]
        self.data, self.slow = data, None
        self.fast = tiktoken.Encoding("pairs", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={}) if merged == sorted(merged) else None
        pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            pieces[i] = piece
        super().__init__(pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._one(t) for t in texts]

    def _one(self, text: str) -> list[int]:
        if self.fast is not None and len(text) < 1_000_000:
            try:
                return self.fast.encode_ordinary(text)
            except Exception:  # its regular expressions give up on some very long runs
                pass
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_str(self.data.decode())
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids


class PieceSide(Side):
    """A piece model, which puts a space before the text itself."""

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        ids = range(self.model.get_piece_size())
        super().__init__([bytes([int(self.model.id_to_piece(i)[3:5], 16)]) if self.model.is_byte(i) else self.model.id_to_piece(i).replace("▁", " ").encode() for i in ids])

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


def load(folder: str = TOKENIZERS, file: str = FILE_A) -> bytes:
    """A tokenizer file's bytes, read by the driver and sent with the tasks."""
    with open(f"{folder.rstrip('/')}/{file}", "rb") as f:
        return f.read()


class Digits:
    """Decimal ids of both sides, each with the separator that may follow it, for groups_sha256."""

    def __init__(self, a: int, b: int):
        words = [f"{i}{end}".encode() for ids, ends in ((a, ",|"), (b, ",;")) for i in range(ids) for end in ends]
        self.width = np.array([len(w) for w in words], np.int64)
        self.bytes = np.zeros((len(words), self.width.max()), np.uint8)
        for w, row in zip(words, self.bytes, strict=True):
            row[: len(w)] = np.frombuffer(w, np.uint8)
        self.keep = np.arange(self.bytes.shape[1]) < self.width[:, None]
        self.b = 2 * a

    def digest(self, words: np.ndarray) -> str:
        return hashlib.sha256(self.bytes[words][self.keep[words]][:-1].tobytes()).hexdigest()


def align(ids_a: np.ndarray, ids_b: np.ndarray, a: Side, b: Side, digits: Digits) -> tuple[np.ndarray, np.ndarray, int, str]:
    """A and B ids of the links of one text, its number of groups and their digest, from ids that cover the same bytes.

    A link is a pair of tokens with overlapping bytes: what lies between two neighbouring token ends of either side belongs to one
    token of each, and each link has one such piece.
    """
    end_a, end_b = np.cumsum(a.length[ids_a]), np.cumsum(b.length[ids_b])
    ends = np.union1d(end_a, end_b)
    link_a, link_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
    cuts = np.intersect1d(end_a, end_b, assume_unique=True)
    last_a, last_b = np.searchsorted(end_a, cuts), np.searchsorted(end_b, cuts)
    words_a = 2 * ids_a
    words_a[last_a] += 1
    words_b = digits.b + 2 * ids_b
    words_b[last_b] += 1
    # a group's A ids, then its B ids
    out = np.empty(len(words_a) + len(words_b), np.int64)
    out[np.arange(len(words_a)) + np.concatenate([[0], last_b[:-1] + 1])[np.searchsorted(cuts, end_a)]] = words_a
    out[np.arange(len(words_b)) + (last_a + 1)[np.searchsorted(cuts, end_b)]] = words_b
    return ids_a[link_a], ids_b[link_b], len(cuts), digits.digest(out)


def squeezed(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers as one zstd frame, each in the narrowest type that holds it."""
    parts = []
    for x in arrays:
        kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(x) or x.max() <= np.iinfo(k).max)
        x = x.astype(kind)
        parts.append(len(x).to_bytes(6, "little") + bytes([x.itemsize]) + x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())
    return zstandard.compress(b"".join(parts), 3)


def spread_out(data: bytes) -> list[np.ndarray]:
    raw, out, at = zstandard.decompress(data), [], 0
    while at < len(raw):
        n, size = int.from_bytes(raw[at : at + 6], "little"), raw[at + 6]
        own = np.frombuffer(raw, np.uint8, n * size, at + 7).reshape(size, n).T
        out.append(np.ascontiguousarray(own).view(f"<u{size}").ravel().astype(np.int64))
        at += 7 + n * size
    return out


def blocks_of(pairs: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Ascending pairs with their counts as compressed blocks."""
    cuts = range(0, len(pairs), BLOCK_PAIRS)
    return [squeezed(pairs[i : i + 1], np.diff(pairs[i : i + BLOCK_PAIRS]), counts[i : i + BLOCK_PAIRS]) for i in cuts]


def read_block(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    first, steps, counts = spread_out(data)
    return np.concatenate([first, first[0] + np.cumsum(steps)]), counts


def merge_runs(runs: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct pairs of all runs in order, with the sums of their counts, part by part.

    A heap holds one block of each run by its last pair. All that is not beyond the smallest of these is complete: it is taken from
    every open block and summed, and the run whose block ended gives its next one.
    """
    heap: list[tuple[int, int]] = []
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    rest = [iter(run) for run in runs]

    def read(i: int) -> None:
        data = next(rest[i], None)
        if data is not None:
            held[i] = read_block(data)
            heapq.heappush(heap, (int(held[i][0][-1]), i))

    for i in range(len(runs)):
        read(i)
    while heap:
        last, ended = heapq.heappop(heap)
        keys, sums = [], []
        for i, (pairs, counts) in held.items():
            n = int(np.searchsorted(pairs, last, "right"))
            if n:
                keys.append(pairs[:n])
                sums.append(counts[:n])
                held[i] = (pairs[n:], counts[n:])
        del held[ended]
        read(ended)
        for i in [i for i, (pairs, _) in held.items() if not len(pairs)]:  # ended at the same pair
            heap.remove((last, i))
            heapq.heapify(heap)
            del held[i]
            read(i)
        every, at = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.zeros(len(every), np.int64)
        np.add.at(total, at, np.concatenate(sums))
        yield every, total


RUN = "flush long, bucket int, pairs array<binary>, links binary, docs array<struct<doc_id:long,n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>"
DOC = pa.struct([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups_sha256", pa.string())])


def tokenized(docs: DataFrame, file_a: bytes, file_b: bytes) -> DataFrame:
    """doc_id, text -> runs: flush, bucket, pairs (compressed blocks of pairs and link counts), links (for each of these pairs the documents
    and their link counts). A flush's documents are one row with bucket -1, without pairs, its documents in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = ByteSide(file_a), PieceSide(file_b)
        digits = Digits(len(a.pieces), len(b.pieces))
        flush = TaskContext.get().partitionId() << 32
        found: list[dict] = []
        keys: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal flush, held
            rows = [(flush, -1, [], b"", list(found))]
            # by bucket, B id, A id and document: all runs of the flush at once
            key = np.sort(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
            first = np.flatnonzero(np.diff(key, prepend=-1))
            links = np.diff(first, append=len(key))
            key = key[first]
            pair, doc = key >> DOC_BITS, key & ((1 << DOC_BITS) - 1)
            starts = np.flatnonzero(np.diff(pair, prepend=-1))
            edges = np.searchsorted(pair[starts] >> 2 * ID_BITS, np.arange(BUCKETS + 1))
            pair &= (1 << 2 * ID_BITS) - 1
            for bucket in range(BUCKETS):
                own = starts[edges[bucket] : edges[bucket + 1]]
                if not len(own):
                    continue
                lo, hi = int(own[0]), int(starts[edges[bucket + 1]]) if edges[bucket + 1] < len(starts) else len(key)
                total = np.add.reduceat(links[lo:hi], own - lo)
                docs_of = np.diff(own, append=hi)
                rows.append((flush, bucket, blocks_of(pair[own], total), squeezed(docs_of, doc[lo:hi], links[lo:hi]), None))
            flush, held = flush + 1, 0
            found.clear()
            keys.clear()
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.binary(), pa.list_(DOC))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["flush", "bucket", "pairs", "links", "docs"])

        for rows in batches:
            texts = [t or "" for t in rows.column("text").to_pylist()]
            for lo in range(0, len(texts), 256):
                part = texts[lo : lo + 256]
                spaced = [" " + t for t in part]
                for doc_id, text, ids_a, ids_b in zip(rows.column("doc_id")[lo : lo + 256].to_pylist(), spaced, a.encode(spaced), b.encode(part), strict=True):
                    data = text.encode()
                    whole = len(data) > 1 and b"".join(map(a.pieces.__getitem__, ids_a)) == data == b"".join(map(b.pieces.__getitem__, ids_b))
                    if not whole:
                        found.append({"doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "groups_sha256": ""})
                    else:
                        at_a, at_b, groups, digest = align(np.array(ids_a, np.int64), np.array(ids_b, np.int64), a, b, digits)
                        keys.append(((at_b % BUCKETS) << 2 * ID_BITS + DOC_BITS) | (at_b << ID_BITS + DOC_BITS) | (at_a << DOC_BITS) | len(found))
                        found.append({"doc_id": doc_id, "n_a": len(ids_a), "n_b": len(ids_b), "n_groups": groups, "n_links": len(at_a), "groups_sha256": digest})
                        held += len(data)
                    if len(found) == FLUSH_DOCS or held >= FLUSH_BYTES:
                        yield close()
        if found:
            yield close()

    return docs.mapInArrow(run, RUN)


def counted(runs: DataFrame, flushes: int) -> DataFrame:
    """bucket, pairs: the counts of each bucket's pairs over all its runs, as compressed blocks. `flushes`: how many runs a bucket may have."""

    def merge(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        out: list[bytes] = []

        def close() -> None:
            pairs, counts = (np.concatenate(x) for x in zip(*held, strict=True))
            out.extend(blocks_of(pairs, counts))
            held.clear()

        for part in merge_runs(rows.column("pairs").to_pylist()):
            held.append(part)
            if sum(len(p) for p, _ in held) >= BLOCK_PAIRS:
                close()
        if held:
            close()
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int64()), pa.array([out], pa.list_(pa.binary()))], ["bucket", "flush", "pairs"])

    now = runs.where("bucket >= 0").select("bucket", "flush", "pairs")
    while True:
        flushes = -(-flushes // FAN_IN)
        group = F.pmod(F.xxhash64("flush", F.lit(flushes)), F.lit(flushes)).alias("flush")
        now = now.select("bucket", group, "pairs").groupBy("bucket", "flush").applyInArrow(merge, "bucket int, flush long, pairs array<binary>")
        if flushes <= 1:
            return stored(now.select("bucket", "pairs"), "pairs")


def contributions(runs: DataFrame, tables: DataFrame) -> DataFrame:
    """flush, added (documents with what a run adds to their n_best and count_sum): each run meets its bucket's counts.

    A bucket's runs are dealt to as many tasks as their size asks for; each of these reads the bucket's counts first, then one run at a time.
    """
    sizes = {r["bucket"]: r["size"] for r in runs.where("bucket >= 0").groupBy("bucket").agg(F.sum(F.octet_length("links")).alias("size")).collect()}
    splits = [-(-sizes.get(b, 1) // SPLIT_BYTES) for b in range(BUCKETS)]
    first = [sum(splits[:b]) for b in range(BUCKETS)]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("bucket") + 1)
    place = (of(first) + F.pmod(F.xxhash64("flush"), of(splits))).cast("int").alias("place")
    own = runs.where("bucket >= 0").select(place, "flush", "pairs", "links")
    every = F.explode(F.sequence(of(first), of(first) + of(splits) - 1)).alias("place")
    known = tables.select(every, F.lit(None).cast("long").alias("flush"), "pairs", F.lit(None).cast("binary").alias("links"))
    placed = known.union(own).repartitionById(sum(splits), "place").sortWithinPartitions(F.asc_nulls_first("flush"))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = (np.zeros(0, np.int64),) * 3
        for rows in batches:
            out = []
            for r in rows.to_pylist():
                pairs, links = (np.concatenate(x) for x in zip(*map(read_block, r["pairs"]), strict=True))
                if r["flush"] is None:
                    known, count = pairs, links
                    b = known >> ID_BITS
                    starts = np.flatnonzero(np.diff(b, prepend=-1))
                    best = count == np.repeat(np.maximum.reduceat(count, starts), np.diff(starts, append=len(b)))
                    continue
                docs_of, doc, n = spread_out(r["links"])
                at = np.repeat(np.searchsorted(known, pairs), docs_of)
                n_best, count_sum = np.zeros((2, int(doc.max()) + 1), np.int64)
                np.add.at(n_best, doc, n * best[at])
                np.add.at(count_sum, doc, n * count[at])
                some = np.flatnonzero(count_sum)
                out.append((r["flush"], squeezed(some, n_best[some], count_sum[some])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int64(), pa.binary()), strict=True)], ["flush", "added"])

    return placed.select("flush", "pairs", "links").mapInArrow(add, "flush long, added binary")


ALIGNED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def alignment(docs: DataFrame, file_a: bytes | None = None, file_b: bytes | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A text is encoded with a space before it by byte-level BPE (`file_a`: a JSON file's bytes) and by a piece model (`file_b`), without special
    tokens. Groups are what lies between two places where tokens of both end; links are all pairs of an A and a B token that
    share a byte. The count of an id pair is the number of its links in all documents. n_best: links whose count is the highest of their B
    id, ties included; count_sum: the counts of all links, added. A text that is null or empty or whose tokens don't
    give back its bytes has zeros and ''. Ids may be null or repeated: rows are told apart by their place in the stored runs.

    Texts don't move. What moves is a run for each flush and bucket: its pairs once to be counted, the whole of it once to meet the counts.
    A bucket's counts, at most one for each of its id pairs, are held by a task; its runs, however many, are dealt to tasks by size.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    file_a, file_b = load(file=FILE_A) if file_a is None else file_a, load(file=FILE_B) if file_b is None else file_b
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    runs = stored(tokenized(texts, file_a, file_b), "runs")
    flushes = runs.where("bucket < 0").count()
    added = contributions(runs, counted(runs, flushes))
    listed = runs.where("bucket < 0").select("flush", "docs", F.lit(None).cast("binary").alias("added"))
    both = listed.union(added.select("flush", F.lit(None).cast(listed.schema["docs"].dataType), "added"))

    def total(rows: pa.Table) -> pa.Table:
        docs = rows.column("docs").combine_chunks().drop_null().flatten()
        n_best, count_sum = np.zeros((2, len(docs)), np.int64)
        for data in rows.column("added").drop_null().to_pylist():
            doc, best, sums = spread_out(data)
            n_best[doc] += best
            count_sum[doc] += sums
        names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        columns = [*(docs.field(n) for n in names), pa.array(n_best), pa.array(count_sum), docs.field("groups_sha256")]
        return pa.table(columns, [*names, "n_best", "count_sum", "groups_sha256"])

    return both.groupBy("flush").applyInArrow(total, ALIGNED)
