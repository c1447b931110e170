from frames import collected

from skein.functions import stats
from skein.operators import explore, matrix, pairs
from test_partition import planted


def test_greedy_cliques_stay_in_one_copy(rows_of):
    rows = rows_of(planted(30))
    cells = matrix.to_cells(rows)
    seed = 0 * 5 + 0  # the first planted column, symbol of copy 0
    grown = explore.greedy_group_clique(cells, seed, 4, 3.0, 60, 20)
    assert len(grown) == 4 and all(g % 5 == 0 and (g // 5) % 25 == 0 for g in grown)
    tested = pairs.pair_significance(pairs.with_sizes(
        pairs.group_pairs(pairs.column_pairs(rows, 200, 20), min_shared=6), matrix.group_sizes(cells)), stats.CLIQUE_BASE)
    both = pairs.both_directions(tested, "z").cache()
    grown = explore.greedy_mean_clique(both, seed, 4, 3.0)
    assert len(grown) == 4 and all(g % 5 == 0 and (g // 5) % 25 == 0 for g in grown)


def test_assignment_takes_largest_share_first(spark):
    shares = spark.createDataFrame([(0, 0, .9), (0, 1, .1), (1, 0, .8), (1, 1, .2)], "i INT, j INT, p DOUBLE")
    assert collected(explore.best_assignment(shares)) == [(0, 0, .9), (1, 1, .2)]


def test_narrowing_keeps_enough_rows(spark):
    sets = {1: range(0, 40), 2: range(10, 60), 3: range(15, 20), 4: range(50, 60)}
    members = spark.createDataFrame([(s, r) for s, v in sets.items() for r in v], "seed BIGINT, row_id BIGINT")
    assert [r for r, in collected(explore.narrowed_groups(members, 16))] == list(range(10, 40))

