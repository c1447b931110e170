"""Strongest pairs found in the products against all pairs at hand."""

import numpy as np
import pytest

from frames import collected
from skein.functions import stats
from skein.operators import cliques, correlate, matrix, pairs, partners


def random_rows(seed, n, width, cover):
    """Rows in a few families, which agree in some columns, over a part of the columns each."""
    rng = np.random.default_rng(seed)
    family = rng.integers(0, 3, n)
    codes = np.where(rng.random((n, width)) < 0.75, (family[:, None] * np.arange(1, width + 1)) % 5, rng.integers(0, 5, (n, width)))
    lines = []
    for c in codes:
        line = np.frombuffer(b"acgt-", np.uint8)[c].copy()
        start, length = rng.integers(0, width), rng.integers(width // 4, width + 1) if rng.random() > cover else width
        line[:start if length < width else 0] = ord(" ")
        line[start + length:] = ord(" ")
        lines.append(line.tobytes().decode())
    return lines


CASES = [(1, 90, 12, 0.7, 256, 128 << 20), (2, 150, 40, 0.2, 7, 128 << 20), (3, 120, 33, 0.3, 8, 0), (4, 80, 25, 0.0, 4, 0)]


@pytest.mark.parametrize("seed,n,width,cover,block,memory", CASES)
def test_strongest_equals_all_pairs(spark, rows_of, monkeypatch, seed, n, width, cover, block, memory):
    monkeypatch.setattr(partners, "MAP_SIDE_BYTES", memory)
    rows = rows_of(random_rows(seed, n, width, cover)).repartition(4)
    for stop, dominated, gap in ((True, False, 1), (False, True, 3), (True, True, 5)):
        tested = correlate.tested_pairs(rows, width, n, 12, gap, base_dominated=dominated, stop_at_first_gap=stop)
        best = partners.strongest(rows, width, n, 12, gap, dominated, stop, cutoff=1.5, apart=9, block_cols=block)
        assert collected(correlate.of_all_groups(best, width)) == collected(correlate.max_correlation(tested, width))
        assert collected(best.where("partners > 0"), "g", "partners") == collected(correlate.significant_partners(correlate.distant_pairs(tested, 9), 1.5))


@pytest.mark.parametrize("seed,n,width,cover,block,memory", CASES)
def test_best_partners_equal_all_pairs(spark, rows_of, monkeypatch, seed, n, width, cover, block, memory):
    monkeypatch.setattr(partners, "MAP_SIDE_BYTES", memory)
    rows = rows_of(random_rows(seed, n, width, cover)).repartition(3)
    sizes = matrix.group_sizes(matrix.to_cells(rows))
    seeds = spark.range(0, width * 5, 3).toDF("g").join(sizes.selectExpr("CAST(col * 5 + sym AS BIGINT) AS g"), "g", "left_semi")
    scored = pairs.pair_significance(pairs.with_sizes(pairs.group_pairs(pairs.column_pairs(rows, width, 1), min_shared=4), sizes), base=stats.CLIQUE_BASE)
    by_seed = {}
    for g, partner, z in collected(pairs.both_directions(scored.where("z > 0.8"), "z"), "g", "partner", "z"):
        by_seed.setdefault(g, []).append((-round(z, 9), partner, z))
    wanted = {r.g for r in seeds.collect()}
    expected = sorted((g, p, z, k) for g, found in by_seed.items() if g in wanted for k, (_, p, z) in enumerate(sorted(found)[:5], 1))
    got = partners.best_partners(rows, width, sizes, seeds, 0.8, 4, 5, block_cols=block)
    assert expected and collected(got, "seed", "g", "z", "rank") == expected


def test_bound_is_never_below_the_significance():
    rng = np.random.default_rng(5)
    tile = object.__new__(partners.Tile)
    n = rng.integers(2, 4000, 5000)
    g1, g2 = (1 + (rng.random(5000) * (n - 1)).astype(int) for _ in range(2))
    k = np.maximum(1, np.maximum(0, g1 + g2 - n) + (rng.random(5000) ** rng.choice([0.3, 1, 3], 5000) * (np.minimum(g1, g2) - np.maximum(0, g1 + g2 - n))).astype(int))
    tile.k, tile.g1, tile.g2, tile.cov, tile.size_a, tile.size_b = k, g1, g2, n, g1, g2
    assert (tile.bound() >= tile.z(np.arange(5000), stats.PAIR_BASE)).all()


def test_wide_matrix_sends_a_bounded_number_of_rows(spark, rows_of):
    """No table of column pairs: what leaves the tiles is bounded by groups, not by pairs of them."""
    width = 2000
    rng = np.random.default_rng(8)
    lines = ["".join(rng.choice(list("acgt-"), width)) for _ in range(60)]
    rows = rows_of(lines).repartition(4)
    best = partners.strongest(rows, width, 60, 8, 20, base_dominated=False)
    plan = best._jdf.queryExecution().executedPlan().toString()
    assert "ci#" not in plan and best.count() <= width * 5
    sizes = matrix.group_sizes(matrix.to_cells(rows))
    seeds = spark.range(0, 50).toDF("g")
    found = cliques.top_partners(rows, width, sizes, seeds.join(sizes.selectExpr("CAST(col * 5 + sym AS BIGINT) AS g"), "g", "left_semi"), 0.5, 8)
    assert found.groupBy("seed").count().agg({"count": "max"}).first()[0] <= 30


def test_empty_matrix(spark):
    rows = spark.createDataFrame([], "row_id BIGINT, symbols STRING")
    assert partners.strongest(rows, 10, 0, 3, 1, stop_at_first_gap=True).count() == 0
