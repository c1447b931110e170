"""Letter rows: classes of whole texts, read once by a query."""

import pytest
from pyspark.sql import functions as F

from skein.plans import queries, tables

ODD = [(1, None), (2, ""), (3, "İKKk İ"), (4, "zzz Äß Zz"), (5, "Σς ſt"), (6, "a" * 3000 + "é" * 10 + "b" * 60 + "\n\0"), (7, "B" * 15 + "x" * 985)]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("letters"))
    spark.createDataFrame(ODD, "doc_id bigint, text string").write.parquet(f"{folder}/documents.parquet")
    return folder


def test_letter_rows_equal_plain_counts(spark, odd):
    def plain(text):
        if text is None:
            return "-" * 26
        shares = [1000 * text.lower().count(chr(97 + c)) // max(len(text), 1) for c in range(26)]
        return "".join("a" if x == 0 else "c" if x < 15 else "g" if x < 40 else "t" if x < 80 else "-" for x in shares)
    assert {r.row_id: r.symbols for r in tables.letter_rows(spark, odd).collect()} == {k: plain(t) for k, t in ODD}


@pytest.mark.parametrize("name", ["signatures", "thin_columns_masked", "containment_chains"])
def test_documents_are_read_once(spark, name, monkeypatch):
    """Texts pass through the tasks once; everything else works on the kept rows."""
    seen, plain = spark.sparkContext.accumulator(0), tables.letter_rows

    def watched(s, d):
        def count(batches):
            for batch in batches:
                seen.add(batch.num_rows)
                yield batch
        return plain(s, d).mapInArrow(count, "row_id bigint, symbols string")
    monkeypatch.setattr(tables, "letter_rows", watched)
    folder = "/root/testdata/sf0.001"
    queries.QUERIES[name](spark, folder).agg(F.count("*")).collect()
    assert 0 < seen.value <= spark.read.parquet(f"{folder}/documents.parquet").count()
