"""Registered queries against their SQL, and the pipeline's stages against plain Python."""

import collections

import compare
import corpus_pipeline
import pytest

import __spark_entry__ as entry
from foliospark.llm import queries
from foliospark.llm.common import stored
from test_near_contamination import plain_contamination, plain_fingerprint, plain_groups

SF = "/root/testdata/sf0.001"


def test_all_numbers_are_registered():
    assert [n for n in range(1, 11) if not any(q.startswith(f"op{n}_") for q in entry.queries())] == []
    assert "pipeline" in entry.queries() and set(queries.ORACLES) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    assert compare.difference(spark, compare.duck(SF), SF, name, entry.queries(), entry.oracle_sql()) is None


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = docs.union(spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "?!", "en", "src0", 2), (9003, docs.first().text, "en", None, 1)], docs.schema))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "exact_dedup", "near_dedup", "decontaminate", "mix"]
    kept = stored(stages["language"](spark, docs, SF), "t")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    assert kept.columns == docs.columns and not {9001, 9002} & set(ids(kept)) and len(ids(kept)) >= len(ids(docs)) - 4
    exact = stored(stages["exact_dedup"](spark, kept, SF), "t")
    best = {}
    for r in kept.collect():
        best[r.text] = max(best.get(r.text, -1), r.doc_id)
    assert ids(exact) == sorted(best.values())
    near = stored(stages["near_dedup"](spark, exact, SF), "t")
    rows = sorted((r.doc_id, plain_fingerprint(r.text)) for r in exact.collect())
    groups = plain_groups([f for _, f in rows])
    assert ids(near) == [r[0] for k, r in enumerate(rows) if groups[k] == k]
    clean = stored(stages["decontaminate"](spark, near, SF), "t")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    want = [r.doc_id for r in near.collect() if not (lambda n, h, _: h > 0 and 20 * h >= n)(*plain_contamination(r.text, items))]
    assert ids(clean) == sorted(want)
    mixed = stages["mix"](spark, clean, SF).collect()
    assert sorted(r.doc_id for r in mixed) == ids(clean)
    taken = collections.Counter()
    for r in mixed:
        taken[r.source_size, r.target] += r.taken
    assert sum(taken.values()) == pytest.approx(1.5 * sum(r.size for r in mixed), rel=0.02)


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100


def test_stages_with_null_and_repeated_ids(spark):
    bad = max((r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()), key=len)
    near = [" ".join(f"{k}w{i}" for i in range(400)) for k in "abc"]
    rows = [(None, near[0]), (None, near[0] + " end"), (7, near[1]), (7, near[1] + " end"), (7, "quite another text"), (8, near[2]), (None, near[2] + " end"), (None, bad), (7, bad + " more")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _row string")
    stages = dict(corpus_pipeline.STAGES)
    kept = stored(stages["near_dedup"](spark, docs, SF), "t")
    ends = lambda df: sorted((r.doc_id or 0, r.text.split()[0]) for r in df.collect())
    assert kept.columns == docs.columns
    assert ends(kept) == sorted([(0, near[0].split()[0]), (7, near[1].split()[0]), (7, "quite"), (8, near[2].split()[0]), (7, bad.split()[0])])
    clean = stages["decontaminate"](spark, docs, SF)
    assert ends(clean) == sorted((i or 0, t.split()[0]) for i, t in rows[:7])
