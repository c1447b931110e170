import pytest
from frames import collected
from pyspark.sql import functions as F

from skein.operators import correlate, matrix, pairs, realign
from skein.schema import symbol_code

LINES = ["-ac-gt--", "acc gt-a", " -ag--t ", "ac--gt a"]


def test_symbols(spark):
    df = spark.createDataFrame([(c,) for c in "aCgT-_ x"], "c STRING")
    assert [r[0] for r in df.select(symbol_code(F.col("c"))).collect()] == [0, 1, 2, 3, 4, 4, None, None]


def test_wide_and_long_are_inverse(rows_of):
    rows = rows_of(LINES)
    assert collected(matrix.to_rows(matrix.to_cells(rows), 8)) == list(enumerate(LINES))


def test_outer_gaps_become_blank(rows_of):
    fixed = [r[1] for r in collected(matrix.blank_outer_gaps(rows_of(LINES)))]
    assert fixed == [" ac-gt  ", "acc gt-a", "  ag--t ", "ac--gt a"]
    again = [r[1] for r in collected(matrix.blank_outer_gaps(rows_of(fixed)))]
    assert again == fixed


def test_window_keeps_rows_with_both_ends(rows_of):
    assert collected(matrix.window_rows(rows_of(LINES), 1, 3)) == [(0, "ac-"), (2, "-ag"), (3, "c--")]
    assert collected(matrix.rows_outside_window(rows_of(LINES), 1, 3)) == [(1,)]


def test_score_is_the_sum_of_row_scores(rows_of):
    cells = matrix.to_cells(rows_of(LINES))
    total = matrix.row_scores(cells).agg(F.sum("score")).first()[0]
    brute = sum(a[c] != b[c] and " " not in (a[c], b[c]) for a in LINES for b in LINES for c in range(8))
    assert matrix.sum_of_pairs_score(cells).first()["score"] == total == brute


def test_empty_columns_vanish(rows_of):
    cells = matrix.to_cells(rows_of(["a-c", "a-g"]))
    assert collected(matrix.drop_empty_columns(cells)) == [(0, 0, 0), (0, 1, 1), (1, 0, 0), (1, 1, 2)]


def random_rows(n, w, seed):
    import numpy as np
    rng = np.random.default_rng(seed)
    return ["".join(rng.choice(list("acgt- "), w)) for _ in range(n)]


def brute_pairs(lines, gap):
    w, out = len(lines[0]), []
    for i in range(w):
        for j in range(i + gap, w):
            cov = [r for r in lines if r[i] != " " and r[j] != " "]
            for a, ca in enumerate("acgt-"):
                for b, cb in enumerate("acgt-"):
                    k = sum(r[i] == ca and r[j] == cb for r in cov)
                    if k:
                        out.append((i, a, j, b, k, sum(r[i] == ca for r in cov), sum(r[j] == cb for r in cov), len(cov)))
    return sorted(out)


def test_pair_counts_all_layouts(rows_of):
    lines = random_rows(60, 23, 5)
    rows = rows_of(lines)
    expected = brute_pairs(lines, 4)
    assert collected(pairs.group_pairs(pairs.column_pairs(rows, 23, 4))) == expected
    blocked = pairs.column_pairs(rows, 23, 4, block_cols=5, block_rows=7)
    assert collected(pairs.group_pairs(blocked)) == expected


def test_pair_counts_per_label_with_a_dominating_label(rows_of):
    lines = random_rows(60, 9, 6)
    rows = rows_of(lines).withColumn("label", F.when(F.col("row_id") < 45, 1).otherwise(2).cast("bigint"))
    found = pairs.group_pairs(pairs.column_pairs(rows, 9, 2, by=("label",), block_cols=4, block_rows=10), by=("label",))
    for label, part in ((1, lines[:45]), (2, lines[45:])):
        assert collected(found.where(F.col("label") == label).drop("label")) == brute_pairs(part, 2)


def test_scan_stops_at_first_weak_column(spark):
    shared = {(0, 2): 9, (0, 3): 9, (0, 4): 1, (0, 5): 9, (1, 4): 9, (2, 4): 9, (2, 5): 9}
    df = spark.createDataFrame([(a, b, n) for (a, b), n in shared.items()], "ci INT, cj INT, n55 INT")
    assert collected(pairs.contiguous_overlap(df, 5, 2), "ci", "cj") == [(0, 2), (0, 3), (2, 4), (2, 5)]


def test_linked_columns_and_gap(rows_of):
    lines = ["a" + "c" * 19 + "g" + "t"] * 20 + ["c" + "c" * 19 + "t" + "t"] * 20
    rows = rows_of(lines)
    tested = correlate.tested_pairs(rows, 22, 40, min_cov=30, min_gap=20)
    z = {r["g"]: r["z"] for r in correlate.max_correlation(tested, 22).collect()}
    from math import comb, log10
    assert abs(z[0] - log10(comb(40, 20))) < 1e-9 and z[0] == z[20 * 5 + 2]
    near = correlate.tested_pairs(rows, 22, 40, min_cov=30, min_gap=21)
    assert near.where(F.col("z") > 1).count() == 0


def test_sequential_realignment_improves(rows_of):
    lines = ["acg-tacgt", "acgt-acgt", "acg-tacgt", "acgta-cgt", "acg-tacgt"]
    best, width, history = realign.realign(rows_of(lines), 9, rows_per_step=1, max_rounds=2)
    assert history[1][1] < history[0][1]
    assert len({r["symbols"].replace("-", "") for r in best.collect()}) == 1
    assert realign.score_of(best) == min(h[1] for h in history)


def test_parallel_realignment_keeps_bases(rows_of):
    lines = random_rows(12, 20, 9)
    best, width, history = realign.realign(rows_of(lines), 20, rows_per_step=5, max_rounds=2)
    strip = lambda s: "".join(c for c in s if c in "acgt")
    assert [strip(s) for _, s in collected(best, "row_id", "symbols")] == [strip(s) for s in lines]
    assert all(len(s) == width for _, s in collected(best, "row_id", "symbols"))


def test_nothing_is_cut_to_the_width(spark, rows_of):
    from skein.operators import pairs
    cells = spark.createDataFrame([(0, 0, 1), (0, 7, 2)], "row_id BIGINT, col INT, sym INT")
    with pytest.raises(Exception, match="beyond the matrix width"):
        matrix.to_rows(cells, 7).collect()
    assert collected(matrix.to_rows(cells, 8)) == [(0, "c      g")]
    with pytest.raises(Exception, match="longer than the matrix width"):
        pairs.column_pairs(rows_of(["acgt", "acgta"]), 4, 1).collect()


def test_scores_beyond_64_bits(spark):
    cells = spark.createDataFrame([(0, 0, 1)], "row_id BIGINT, col INT, sym INT")
    big = 4 * 10**9
    from unittest import mock
    counts = matrix.column_counts(cells).selectExpr("col", *[f"CAST({v} AS BIGINT) AS {n}" for n, v in zip(
        ("n0", "n1", "n2", "n3", "n4", "cov"), (0, big, 0, 0, big, 2 * big))])
    with mock.patch.object(matrix, "column_counts", lambda c: counts):
        assert int(matrix.sum_of_pairs_score(cells).first()["score"]) == 2 * big * big
