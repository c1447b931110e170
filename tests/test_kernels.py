"""Kernels against brute force."""

from fractions import Fraction
from math import comb, log10

import numpy as np
import pytest

from skein.functions import stats
from skein.operators import align, realign
from skein.operators.pairs import encode
import pandas as pd


def test_hypergeometric_tails_match_exact_fractions():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(1, 300))
        g1, g2 = (int(v) for v in rng.integers(0, n + 1, 2))
        lo, hi = max(0, g1 + g2 - n), min(g1, g2)
        k = int(rng.integers(lo, hi + 1))
        weight = [comb(g2, t) * comb(n - g2, g1 - t) for t in range(lo, hi + 1)]
        up, down = (Fraction(sum(w), comb(n, g1)) for w in (weight[k - lo:], weight[:k - lo + 1]))
        exact = [log10(f.denominator) - log10(f.numerator) for f in (up, down)]
        assert stats.upper_tail_log10([k], [g1], [g2], [n])[0] == pytest.approx(exact[0], abs=1e-9)
        assert stats.lower_tail_log10([k], [g1], [g2], [n])[0] == pytest.approx(exact[1], abs=1e-9)


def test_perfectly_linked_groups():
    z = stats.upper_tail_log10([20], [20], [20], [40])[0]
    assert z == pytest.approx(log10(comb(40, 20)), abs=1e-9)
    assert stats.upper_tail_log10([500_000], [1_000_000], [1_000_000], [2_000_000])[0] == pytest.approx(0.3, abs=0.01)


def test_binomial_upper():
    exact = sum(comb(10, t) * 0.3 ** t * 0.7 ** (10 - t) for t in range(4, 11))
    assert stats.binomial_upper(np.array([3]), 10, 0.3)[0] == pytest.approx(exact)


def full_table(seq, template):
    n, m = len(seq), len(template)
    d = np.zeros((n + 1, m + 1), dtype=int)
    d[:, 0] = np.arange(n + 1)
    for x in range(1, n + 1):
        for y in range(1, m + 1):
            d[x, y] = min(d[x - 1, y - 1] + (seq[x - 1] != template[y - 1]), d[x, y - 1] + 1, d[x - 1, y] + 1)
    return d


def walk(seq, template):
    """Alignment by the stated preferences on the full table."""
    d = full_table(seq, template)
    n, m = d.shape[0] - 1, d.shape[1] - 1
    y = max(c for c in range(2, m + 1) if d[n, c] == d[n, 2:].min())
    x, best, out = n, int(d[n, y]), [-1] * n
    while x > 0 and y > 0:
        if d[x, y] == d[x - 1, y - 1] + (seq[x - 1] != template[y - 1]):
            x, y = x - 1, y - 1
            out[x] = y
        elif d[x, y] == d[x, y - 1] + 1:
            y -= 1
        else:
            x -= 1
    return out, best


def test_alignment_matches_full_table():
    rng = np.random.default_rng(1)
    for _ in range(60):
        t = "".join(rng.choice(list("acgt"), int(rng.integers(5, 60))))
        s = "".join(rng.choice(list("acgt"), int(rng.integers(1, 40))))
        position, best = align.align_one(s, t)
        assert (list(position), best) == walk(s, t)


def test_equal_ends_take_the_rightmost():
    position, best = align.align_one("acg", "ttacgttacgtt")
    assert best == 0 and list(position) == [7, 8, 9]


def slow_occurrences(part, read, cutoff):
    """Scan from the right, run by run, keeping the memory of the last run for one position only."""
    score = full_table(part, read)[len(part), 1:]
    hits, run, before, gap = [], [], None, 0
    for i in range(len(read) - 1, 0, -1):
        if score[i] < cutoff:
            run.append(i)
            continue
        if run:
            low = min(score[j] for j in run)
            at = next(j for j in run if score[j] == low)
            if not hits or hits[-1] - at > len(part) // 2:
                hits.append(at)
            elif gap != 1 or before > low:
                hits[-1] = at
            before, run, gap = low, [], 0
        gap += 1
    return hits


def test_occurrences():
    rng = np.random.default_rng(2)
    for _ in range(200):
        part = "".join(rng.choice(list("ac"), int(rng.integers(4, 9))))
        read = "".join(rng.choice(list("ac"), int(rng.integers(5, 60))))
        cutoff = int(rng.integers(1, 4))
        assert align.occurrences(part, read, cutoff) == slow_occurrences(part, read, cutoff)


@pytest.mark.parametrize("hits, expected", [
    ({0: [], 3: []}, []),                 # no border
    ({0: [], 3: [300]}, [300]),           # right border only
    ({0: [325], 3: []}, [300]),           # left border only
    ({0: [325], 3: [400]}, [400]),        # both: the right border is taken first
    ({0: [], 3: [300, 400, 500, 900]}, [300, 500, 900]),
])
def test_cut_choice(hits, expected):
    assert align.choose_cuts(hits, 4, 25, 1000, 300) == expected


def slow_place(codes, profile):
    """Cost of the best placement over the whole table without a band."""
    others = profile.copy()
    for c, s in enumerate(codes):
        if s < 5:
            others[c, s] -= 1
            others[c, 5] -= 1
    bases = [s for s in codes if s < 4]
    w, cov = len(codes), others[:, 5]
    prev = [0] * (w + 1)  # index 0 is the column before the matrix
    for b in bases:
        row = [10 ** 12] * (w + 1)
        for y in range(w):
            best = min(prev[y] + cov[y] - others[y, b], row[y] + cov[y] - others[y, 4])
            if 0 < y < w - 1:
                best = min(best, prev[y + 1] + max(cov[y], cov[y - 1]))
            row[y + 1] = best
        prev = row
    return min(prev[1:])


def random_matrix(rng, n, w):
    lines = ["".join(rng.choice(list("acgt-"), w, p=[.35, .2, .15, .1, .2])) for _ in range(n)]
    return [line.replace("-", " ", 1) if line[0] == "-" else line for line in lines]


def test_row_placement_is_optimal_and_consistent():
    rng = np.random.default_rng(3)
    for _ in range(40):
        w = int(rng.integers(3, 14))
        codes = encode(pd.Series(random_matrix(rng, 6, w)), w)
        profile = np.stack([(codes == s).sum(0) for s in range(5)] + [(codes < 5).sum(0)], axis=1).astype(np.int64)
        cols, opened, best = realign.place_row(codes[0], profile)
        if (codes[0] < 4).sum() == 0:
            continue
        # the band is wider than the matrix, but the first column is no end for bases beyond half a band
        assert best == slow_place(codes[0], profile)
        assert all(a <= b for a, b in zip(cols, cols[1:]))
        assert len(set(zip(cols[~opened]))) == (~opened).sum()


def test_cuts_go_on_over_many_copies():
    hits = {59: [1000 * k for k in range(1, 200)]}
    cuts = align.choose_cuts(hits, 60, 16, 200_500, 1000)
    assert cuts == hits[59]
