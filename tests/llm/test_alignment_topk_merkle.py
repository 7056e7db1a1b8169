"""Tokenizer alignment, top-k search and the manifest against plain Python, with nulls, repeats, ties, empty tables and clashing columns."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import alignment, merkle, topk


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is not None, x) for x in r))


# ---- alignment


@pytest.fixture(scope="module")
def tokenizers():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(f"{alignment.TOKENIZERS}/{alignment.FILE_A}")
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=f"{alignment.TOKENIZERS}/{alignment.FILE_B}")


def plain_alignment(rows, tokenizers):
    a, b = tokenizers
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in shown)}
    counts, per = collections.Counter(), []
    for doc_id, text in rows:
        ids = [a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")]
        pieces = [[bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids[0]],
                  [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]]
        whole = (" " + (text or "")).encode()
        if not text or any(b"".join(p) != whole for p in pieces):
            per.append((doc_id, None))
            continue
        owner = [[n for n, p in enumerate(side) for _ in p] for side in pieces]  # by byte, which token has it
        links = [(ids[0][x], ids[1][y]) for x, y in sorted(set(zip(*owner, strict=True)))]
        ends = [{sum(map(len, side[: n + 1])) for n in range(len(side))} for side in pieces]
        groups, start = [], [0, 0]
        for cut in sorted(ends[0] & ends[1]):
            stop = [owner[s][cut - 1] + 1 for s in (0, 1)]
            groups.append("|".join(",".join(map(str, ids[s][start[s] : stop[s]])) for s in (0, 1)))
            start = stop
        counts.update(links)
        per.append((doc_id, (len(ids[0]), len(ids[1]), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest())))
    most = collections.Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    for doc_id, found in per:
        if found is None:
            yield doc_id, 0, 0, 0, 0, 0, 0, ""
        else:
            n_a, n_b, groups, links, digest = found
            yield doc_id, n_a, n_b, groups, len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest


TEXTS = [None, "", " ", "a", "<|endoftext|> <s> hi </s>", "▁x", "ﬁ ① ｆｕｌｌ", "日本語テキスト 🎉 \x00\x01", "  two  spaces\n\n\ttab  ", "a" * 500, "the cat sat " * 50, "x" * 40_000]


def test_alignment_equals_counting_every_link(spark, tokenizers, monkeypatch):
    for name, value in (("FLUSH_DOCS", 3), ("FAN_IN", 2), ("BLOCK_PAIRS", 8), ("SPLIT_BYTES", 2000)):  # many runs, blocks, merges and splits
        monkeypatch.setattr(alignment, name, value)
    rng = random.Random(2)
    rows = [(rng.choice([None, *range(40)]), rng.choice(TEXTS[:-1])) for _ in range(120)] + [(9, TEXTS[-1])]
    docs = spark.createDataFrame([(*r, 1, "b", 2) for r in rows], "doc_id long, text string, flush int, bucket string, n_a int")
    assert ordered(alignment.alignment(docs).collect()) == ordered(plain_alignment(rows, tokenizers))


def test_alignment_of_given_documents_and_of_none(spark, tokenizers):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text[:2000]) for r in docs.collect()]
    got = alignment.alignment(spark.createDataFrame(rows, "doc_id long, text string"))
    assert ordered(got.collect()) == ordered(plain_alignment(rows, tokenizers))
    assert alignment.alignment(docs.limit(0)).collect() == []


def test_heap_merge_of_runs():
    rng = np.random.default_rng(1)
    runs = [np.unique(rng.integers(0, 5000, n)) for n in (0, 1, 700, 4000, 300)] + [np.array([4999, 70_000])]
    blocks = [[alignment.squeezed(r[i : i + 1], np.diff(r[i : i + 64]), r[i : i + 64] % 7 + 1) for i in range(0, len(r), 64)] for r in runs]
    want = collections.Counter()
    for r in runs:
        want.update({int(x): int(x) % 7 + 1 for x in r})
    got = [(int(p), int(c)) for pairs, counts in alignment.merge_runs(blocks) for p, c in zip(pairs, counts, strict=True)]
    assert got == sorted(want.items())


def test_byte_side_takes_long_runs(tokenizers):
    side = alignment.ByteSide(alignment.load())
    for text in (" " * 1_100_000, "\n" * 300_000, "ab" * 100_000):
        assert side.encode([text])[0] == tokenizers[0].encode(text, add_special_tokens=False).ids


# ---- top-k


def plain_top_k(rows, k=10):
    """Whole numbers throughout."""
    ok = [(n, i, [int(np.floor(x * 1024)) if abs(x) < 2**52 else int(x) * 1024 for x in v]) for n, (i, v) in enumerate(rows)
          if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for n, i, q in ok:
        if i is not None and i % 100 == 0:
            score = {m: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(q, v, strict=False)))) for m, _, v in ok}
            found = sorted((-score[m], j is None, j or 0) for m, j, _ in ok if m != n)
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(found[:k], 1)]
    return out


@pytest.mark.parametrize("pack", [1 << 14, 3])
def test_top_k_equals_all_products(spark, monkeypatch, pack):
    monkeypatch.setattr(topk, "QUERY_PACK", pack)
    rng = random.Random(4)
    rows = [(rng.choice([None, 0, 100, 200, *range(-300, 300)]), [rng.choice([0.0, 0.25, -1.5, 0.1, rng.gauss(0, 1)]) for _ in range(rng.choice([3, 3, 3, 0, 5]))]) for _ in range(400)]
    rows += [(7, None), (8, [1.0, None]), (9, [float("nan")]), (100, [float("inf"), 0.0]), (300, [1e300, 1.0]), (5, [1e20]), (400, []), *[(11, [2.0, 2.0, 2.0])] * 15]
    df = spark.createDataFrame([(*r, 1, 2.0, True) for r in rows], "vec_id long, embedding array<double>, row int, score double, asks boolean")
    assert ordered(topk.top_k(df, F.col("vec_id") % 100 == 0).collect()) == ordered(plain_top_k(rows))


def test_top_k_small_tables(spark):
    schema = "vec_id int, embedding array<float>"
    asks = F.col("vec_id") % 100 == 0
    assert topk.top_k(spark.createDataFrame([], schema), asks).collect() == []
    assert topk.top_k(spark.createDataFrame([(100, [1.0])], schema), asks).collect() == []
    assert topk.top_k(spark.createDataFrame([(1, [1.0]), (2, [1.0])], schema), asks).collect() == []
    two = topk.top_k(spark.createDataFrame([(0, [1.0]), (0, [0.5])], schema), asks).collect()
    assert ordered(two) == [(0, 1, 0, 524_288), (0, 1, 0, 524_288)]


# ---- manifest


def plain_manifest(rows):
    def digest(*parts):
        return hashlib.sha256("".join(parts).encode()).hexdigest()

    def framed(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    def climb(h, at, levels, path):
        for level in levels[:-1]:
            other = level[at ^ 1] if at ^ 1 < len(level) else None
            path += [other] if other else []
            h = digest(h) if other is None else digest(other, h) if at & 1 else digest(h, other)
            at //= 2
        return h

    groups = collections.defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        own = digest(*map(framed, (doc_id, source, lang, n_chars, text)))
        hit = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        altered = digest(*map(framed, (doc_id, source, lang, n_chars + 1, text))) if hit else own
        groups[lang].append((doc_id is not None, doc_id or 0, own, altered))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {x: tree([g[2] for g in sorted(groups[x])]) for x in names}
    top = tree([trees[x][-1][0] for x in names]) if names else []
    for place, x in enumerate(names):
        for at, (some, doc_id, own, altered) in enumerate(sorted(groups[x])):
            path = []
            h = climb(climb(altered, at, trees[x], path), place, top, path)
            yield doc_id if some else None, own, trees[x][-1][0], top[-1][0], digest(*path), h, h == top[-1][0]


DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, `at` int, `group` string"


def test_manifest_equals_plain_trees(spark, monkeypatch):
    rng = random.Random(3)
    ids = [None, -70_001, -3, 7, *range(-1000, 1000, 9), 2**40, 2**62]
    rows = [(rng.choice(ids), rng.choice([None, "", "ä" * 5, "t" * rng.randint(1, 20)]), rng.choice([None, "", "de", "en", "ü"]), rng.choice([None, "a"]), rng.choice([None, 4, 2**63 - 1])) for _ in range(1500)]
    rows += rows[:20] * 3
    docs = spark.createDataFrame([(*r, "z", 1, "g") for r in rows], DOCS)
    monkeypatch.setattr(merkle, "LEVELS", 3)  # several rounds of slot arrays
    monkeypatch.setattr(merkle, "GATHERED", 100)  # several bitmaps of a chunk to merge
    got = merkle.manifest(docs).collect()
    assert ordered(got) == ordered(plain_manifest(rows))
    assert any(r.verified for r in got) and any(not r.verified for r in got)


def test_manifest_of_one_row_and_of_none(spark):
    rows = [(5, "x", "en", "s", 3)]
    assert ordered(merkle.manifest(spark.createDataFrame([(*r, "z", 1, "g") for r in rows], DOCS)).collect()) == ordered(plain_manifest(rows))
    assert merkle.manifest(spark.createDataFrame([], DOCS)).collect() == []


def test_places_come_from_bitmaps(spark):
    ids = [3, 64, 65, 70_000, 70_000, -1, -65_537]
    docs = spark.createDataFrame([(i, str(n), "en", "s", 1, "", 0, "") for n, i in enumerate(ids)], DOCS)
    found = merkle.id_bitmaps(merkle.leaves(docs)).collect()
    assert sorted((r["chunk"], r["n"]) for r in found) == [(-2, 1), (-1, 1), (0, 3), (1, 2)]
    placed = merkle.coordinates(merkle.stored(merkle.leaves(docs), "leaves")).collect()
    assert sorted((r["at"], r["doc_id"]) for r in placed) == list(enumerate(sorted(ids)))
