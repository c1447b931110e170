"""Exact duplicates against a dictionary."""

import hashlib
import random
from collections import defaultdict

import pytest

from skein.llm import exact_dedup


def brute(rows, keep):
    by = defaultdict(list)
    for i, t in rows:
        by[t or ""].append(i)
    best = {t: (max if keep == "largest" else min)([i for i in ids if i is not None], default=None) for t, ids in by.items()}
    return sorted(((i, best[t or ""], len(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str), len(by)


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("fan", [2, 4, 16])
def test_groups_equal_brute_force(spark, monkeypatch, keep, fan):
    monkeypatch.setattr(exact_dedup, "FAN", fan)
    rng = random.Random(fan)
    texts = ["hot"] * 6 + [None, "", " ", "é", "é", "x" * 300_000] + [f"t{k}" for k in range(150)]
    rows = [(rng.choice([None, *range(-50, 400)]), rng.choice(texts)) for _ in range(700)] + [(5, "same"), (5, "same"), (None, "no id"), (-2 ** 63, "e"), (2 ** 63 - 1, "e")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id bigint, text string, sha string, n int").repartition(11)
    got = exact_dedup.groups(df, keep=keep).collect()
    expected, distinct = brute(rows, keep)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == expected
    assert sum(r.kept for r in got) == distinct
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    kept = exact_dedup.keep_one(df, keep=keep)
    assert kept.columns == df.columns and kept.count() == distinct
    assert {((r.text or ""), r.doc_id) for r in kept.collect()} == {
        (t or "", next(e[1] for e in expected if e[3] == hashlib.sha256((t or "").encode()).hexdigest())) for _, t in rows}


def test_equal_run_digests_do_not_merge_different_texts(spark, monkeypatch):
    real = exact_dedup._digested
    monkeypatch.setattr(exact_dedup, "_digested", lambda *a: real(*a).selectExpr(
        "slot", "CAST(7 AS BIGINT) AS digest", "sha", "bytes", "id", "row"))
    df = spark.createDataFrame([(i, f"t{i % 5}") for i in range(40)], "doc_id bigint, text string").repartition(6)
    assert {(r.doc_id % 5, r.keep_id, r.group_size) for r in exact_dedup.groups(df).collect()} == {(k, 35 + k, 8) for k in range(5)}


def test_empty_and_odd_documents(spark, odd_docs, no_docs):
    assert exact_dedup.groups(no_docs).count() == 0 and exact_dedup.keep_one(no_docs).count() == 0
    rows = exact_dedup.groups(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert sum(r.kept for r in rows if r.doc_id == 6) == 1
    assert {r.group_size for r in rows if r.doc_id in (2, 3)} == {3}


def test_runs_that_go_on_in_the_next_batch(spark, monkeypatch):
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    spark.conf.set(size, "3")
    try:
        df = spark.createDataFrame([(i, f"t{i % 9}") for i in range(300)], "doc_id bigint, text string").repartition(9)
        assert {(r.doc_id % 9, r.group_size) for r in exact_dedup.groups(df).collect()} == {(k, 34 if k < 3 else 33) for k in range(9)}
    finally:
        spark.conf.set(size, before)
