"""Exact duplicates, secrets and mixing against plain Python on small tables with nulls, repeats and clashing columns."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import exact, mixing, secret_scan

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, _row string, score string, word string, `group` int"
ROWS = [
    (1, "same text", "en", "a"), (2, "same text", "en", "b"), (2, "same text", "en", "b"), (3, None, None, None), (4, "", "en", "a"), (None, "same text", None, "a"),
    (None, None, None, None), (5, "other " * 3000, "de", "b"), (6, "Same text", "en", "c"), (7, "password=abcdef token: 'xyz'", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 1, True, "x", "y", "z", 3) for r in ROWS], SCHEMA)


def test_exact_marks(docs):
    got = exact.mark_duplicates(docs).collect()
    assert len(got) == len(ROWS)
    by_text = {}
    for i, t, *_ in ROWS:
        by_text.setdefault(t or "", []).append(i)
    for r in got:
        ids = next(v for k, v in by_text.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(by_text)


def test_exact_drop_keeps_columns(docs):
    got = exact.drop_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted((r.text or "", r.doc_id) for r in got.collect()) == [("", 4), ("Same text", 6), ("other " * 3000, 5), ("password=abcdef token: 'xyz'", 7), ("same text", 2)]


def test_exact_with_a_filter_full_of_collisions(spark, monkeypatch):
    monkeypatch.setattr(exact, "MAX_CELLS", 1)  # one bitmap for 20,000 distinct texts: nearly all rows are possible repeats
    df = spark.range(60_000).select(F.col("id").alias("doc_id"), (F.col("id") % 20_000).cast("string").alias("text"))
    assert exact.mark_duplicates(df).where("kept AND group_size = 3 AND keep_id = doc_id AND doc_id >= 40000").count() == 20_000
    assert exact.drop_duplicates(df).count() == 20_000


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact.mark_duplicates(none).count() == exact.drop_duplicates(none).count() == 0
    assert secret_scan.secret_report(secret_scan.find_secrets(none)).count() == 0
    assert mixing.mix(none).count() == 0


BASE = (
    ("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[1]) >= 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 24),
)


def plain_spans(text):
    return sorted((m.start(), k, m.end()) for k, (_, rule, ok) in enumerate(BASE) for m in rule.finditer(text) if ok(m))


def test_secrets_equal_regular_expressions(spark):
    rng = random.Random(5)
    parts = ["password", "PassWd", "secret", "token", "api_key", "apiKEY", "=", ":", " ", "  ", '"', "'", "abc", "é", "世", "AKIA", "ABCDEF0123456789", "0123456789abcdef", "deadbeef", "\n", ".", "a=b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [None, "", "x" * 300_000 + " token=abcdef" + "f" * 100_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.secret_report(secret_scan.find_secrets(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = plain_spans(t or "")
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(s[1] == k for s in want) for k in range(3)]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{BASE[k][0]}:{s}:{e}" for s, k, e in want).encode()).hexdigest()


def test_added_kinds(spark):
    texts = ["-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "aZ" * 18, "xoxb-123456789012-abc", "ghp_short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: [s["kind"] for s in r.spans] for r in secret_scan.find_secrets(df).collect()}
    assert got == {0: ["pem"], 1: ["forge"], 2: ["chat"], 3: []}


def test_targets():
    assert mixing.targets([100, 100, 100]) == pytest.approx([200, 250 / 3, 500 / 3])
    got = mixing.targets([10, 1000, 0, 50])
    assert sum(got) == pytest.approx(1590) and all(t <= 2 * s + 1e-9 for t, s in zip(got, [10, 1000, 0, 50], strict=True))
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]


def test_permutation_is_one_to_one():
    for n in (1, 2, 3, 7, 64, 1000):
        got = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, 12345))
        assert sorted(got.tolist()) == list(range(n))


def test_mix(spark, docs):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 400), "hot" if i % 3 == 0 else f"s{i % 7}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = {r.doc_id: r for r in mixing.mix(df).collect()}
    again = {r.doc_id: r.taken for r in mixing.mix(df.repartition(7)).collect()}
    by = {}
    for i, t, s in rows:
        n = len(t.split())
        assert out[i].size == n and out[i].taken <= 2 * n and again[i] == out[i].taken
        by.setdefault(s, []).append(out[i])
    for group in by.values():
        assert sum(r.size for r in group) == group[0].source_size
        assert sum(r.taken for r in group) == pytest.approx(group[0].target, rel=0.01)


def test_pieces_are_whole_blocks(spark):
    df = spark.createDataFrame([(i, "w " * 50, "a" if i % 2 else "b") for i in range(400)], "doc_id long, text string, source string")
    _, pieces = mixing.mix_blocks(df)
    sums = pieces.groupBy("shard", "source_no", "block", "time").agg(F.sum("words").alias("n"))
    assert {r.n for r in sums.collect()} <= {mixing.BLOCK_WORDS, 10_000 % mixing.BLOCK_WORDS}


def test_shards_have_the_words_of_their_pieces(spark):
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, i]), " \n".join(f"w{i}_{k}é" for k in range(rng.randint(0, 150))), rng.choice(["a", "b", None])) for i in range(600)]
    df = spark.createDataFrame(rows + [(None, None, "a"), (1, " ", "a")], "doc_id long, text string, source string")
    marked, shards = mixing.mix_shards(df)
    docs, got = {(r.source_no, r.first_word): r for r in marked.where("size > 0").collect()}, shards.withColumn("pieces", mixing.pieces(mixing.BLOCK_WORDS)).collect()
    assert len(docs) == sum(bool(t.split()) for _, t, _ in rows) and marked.count() == 602
    texts = {}
    for r in got:
        words = r.text.split(" ")
        assert len(words) == sum(p.words for p in r.pieces) and texts.setdefault((r.source_no, r.block), r.text) == r.text
        for p in r.pieces:
            part, words = words[: p.words], words[p.words :]
            i = int(part[0][1:].split("_")[0])
            assert part == rows[i][1].split()[p.from_word : p.from_word + p.words]
            assert docs[r.source_no, p.first_word].doc_id == rows[i][0] and docs[r.source_no, p.first_word].source == rows[i][2]
    for shard in {r.shard for r in got}:
        slots = sorted(r.slot for r in got if r.shard == shard)
        assert slots == list(range(len(slots)))
    assert sum(r.taken for r in mixing.mix(df).collect()) == sum(len(r.text.split()) for r in got)


def test_large_sources_are_packed_over_buckets(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 7)
    df = spark.createDataFrame([(i, f"x{i} " * (i % 90), "a") for i in range(500)], "doc_id long, text string, source string")
    _, shards = mixing.mix_shards(df, path=str(tmp_path / "out"))
    total = sum(i % 90 for i in range(500))
    lengths = {r.block: len(r.text.split()) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert set(lengths.values()) <= {mixing.BLOCK_WORDS, total % mixing.BLOCK_WORDS} and shards.count() == round(1.5 * -(-total // mixing.BLOCK_WORDS))
