"""Token counts by the best unigram segmentation, worked out once for every shared prefix of the distinct words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import WordHash, bound_batches, slices, sums_by_row, utf8, word_spans

#: Folder of public tokenizer files, and the file whose pieces are used.
TOKENIZERS, PIECE_FILE = "/opt/tokenizers", "piece_bpe_32k.model"
#: Marks the beginning of a word in the pieces.
MARK = "▁"
#: A character that no piece covers costs one token for each UTF-8 byte, each so much worse than the worst piece.
BYTE_PENALTY = 10.0
#: Bytes of text whose distinct words share one trie.
GROUP_BYTES = 16 << 20


def load_pieces(folder: str = TOKENIZERS, file: str = PIECE_FILE) -> dict[str, float]:
    """Pieces and their log scores. The file ranks pieces by frequency; a piece of rank r scores -log(r + 1) (Zipf's law)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{folder.rstrip('/')}/{file}")
    ids = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)))
    return {model.id_to_piece(i): -math.log(rank + 1) for rank, i in enumerate(ids, 1)}


def count_tokens(words: list[str], pieces: dict[str, float]) -> list[int]:
    """Number of tokens of each word (marked at its beginning), in the segmentation of the highest score; of those with equal
    scores the one of fewest tokens.

    The words are inserted into a trie, which is walked depth first: sorted words visit its nodes in that order, so the path
    from the root is all that is held. A node has the forward score and token count of the prefix that ends there; they are
    computed once for all words below it. The count at a word's last node is its result.
    """
    longest = max(map(len, pieces), default=1)
    bad = min(pieces.values(), default=0.0) - BYTE_PENALTY
    out = [0] * len(words)
    path, score, count = "", [0.0], [0]
    for at in sorted(range(len(words)), key=words.__getitem__):
        word = MARK + words[at]
        shared, most = 0, min(len(path), len(word))
        while shared < most and path[shared] == word[shared]:
            shared += 1
        del score[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(word) + 1):
            char = word[end - 1]
            size = len(char.encode("utf-8", "surrogatepass"))
            best, least = (score[end - 1] + pieces[char], count[end - 1] + 1) if char in pieces else (score[end - 1] + size * bad, count[end - 1] + size)
            for begin in range(max(0, end - longest), end - 1):
                found = pieces.get(word[begin:end])
                if found is not None:
                    value = score[begin] + found
                    if value > best or (value == best and count[begin] + 1 < least):
                        best, least = value, count[begin] + 1
            score.append(best)
            count.append(least)
        path = word
        out[at] = count[len(word)]
    return out


def token_counts(docs: DataFrame, pieces: dict[str, float], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens. A null or empty text has none of either; null ids and repeated rows stay.

    Words end at ASCII white space. Each task counts the tokens of its distinct words once; nothing is shuffled.
    """
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(pieces)  # as many as the vocabulary has

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHash(lower=False)
        for batch in batches:
            data, offs = utf8(batch.column(1))
            n_words, n_tokens = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in slices(offs, GROUP_BYTES):
                own = offs[lo : hi + 1]
                b = data[own[0] : own[-1]]
                starts, ends, first = word_spans(data, own)
                _, once, which = np.unique(hasher(b, starts, ends), return_index=True, return_inverse=True)
                whole = b.tobytes()
                distinct = [whole[s:e].decode("utf-8", "replace") for s, e in zip(starts[once].tolist(), ends[once].tolist(), strict=True)]
                counts = np.array(count_tokens(distinct, sent.value), np.float64)
                n_words.append(np.diff(first))
                n_tokens.append(sums_by_row(counts[which] if len(which) else np.zeros(0), first).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(n_words)), pa.array(np.concatenate(n_tokens))], ["doc_id", "n_words", "n_tokens"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_tokens bigint")
