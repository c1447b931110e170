"""Registered queries against their SQL, and the pipeline against its stages."""

import duckdb
import pytest

import corpus_pipeline
import __spark_entry__ as entry
from skein.llm import ngram_join, queries
from skein.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, con, name):
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.ORACLES[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(map(tuple, cur.fetchall()), key=key) == sorted((tuple(r) for r in df.select(*cols).collect()), key=key)


def test_all_queries_are_registered():
    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names


def test_stages_keep_columns_and_take_effect(spark, odd_docs):
    docs = table(spark, SF, "documents")
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        before, after = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in out.select("doc_id").collect()}
        assert after < before
        gone = before - after
        if name == "quality":
            assert sum(labels[d].quality == 0 for d in gone if d in labels) >= 0.95 * sum(d in labels for d in gone)
        if name == "toxicity":
            assert all(labels[d].toxic for d in gone if d in labels)
        docs = spark.createDataFrame(out.collect(), docs.schema)
        counts.append(len(after))
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert mixed.count() == counts[-1]
    run = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, run.collect())) == sorted(map(str, mixed.collect()))


@pytest.mark.parametrize("number", range(5))
def test_stages_on_odd_rows(spark, odd_docs, no_docs, number):
    name, stage = corpus_pipeline.STAGES[number]
    out = stage(spark, odd_docs, SF)
    if name != "mixing":
        assert out.columns == odd_docs.columns
    assert out.count() <= odd_docs.count() and stage(spark, no_docs, SF).count() == 0


def test_near_duplicates_of_unlike_documents_meet_in_no_tree(spark, monkeypatch):
    """A row of documents of which each shares one shingle with the next is no cluster."""
    sketch, dealt, met = ngram_join.sketch_of, ngram_join._dealt, []
    monkeypatch.setattr(ngram_join, "sketch_of", lambda scanned: sketch(scanned).max() - sketch(scanned))  # the common ones come first
    monkeypatch.setattr(ngram_join, "_dealt", lambda members, *parts: (met.append(members.count()), dealt(members, *parts))[1])
    bridge = lambda k: " ".join(f"b{k}x{j}" for j in range(5))
    rows = [(k, f"{bridge(k)} {' '.join(f'u{k}y{j}' for j in range(120))} {bridge(k + 1)}") for k in range(30)]
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame([*rows, (99, rows[4][1] + " end")], "doc_id bigint, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == list(range(30))
    assert met[0] == 2
