"""Iterative realignment of the rows of a matrix against its own column profile.

The profile (six counts per column, sized by the matrix width) is aggregated by Spark and shipped to
the tasks; each row is taken out of the profile and placed anew by banded dynamic programming. Rows of
one step see the same profile and their inserted columns are merged slot by slot, so rows run in
parallel. The default ``rows_per_step=1`` gives strictly sequential updates; larger steps have to be asked for,
because their result may differ from sequential updates. A round is only kept if the score improves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import matrix
from skein.operators.pairs import encode
from skein.schema import BASES, GAP, N_SYMBOLS, SYMBOLS, check_width
from skein.session import cut_lineage, spread

# --- fixed values -----------------------------------------------------------
BAND = 1000
MAX_ROUNDS = 10_000
# ----------------------------------------------------------------------------
_FAR = np.int64(2 ** 60)
_CHARS = np.frombuffer((SYMBOLS + " ").encode(), dtype=np.uint8)


def column_profile(rows: DataFrame, width: int) -> np.ndarray:
    """Counts (column, symbol 0..4 and coverage); one short record per column reaches the driver."""
    check_width(width)
    out = np.zeros((width, N_SYMBOLS + 1), dtype=np.int64)
    counts = matrix.column_counts(matrix.to_cells(rows)).toPandas()
    out[counts["col"]] = counts[["n0", "n1", "n2", "n3", "n4", "cov"]]
    return out


def place_row(codes: np.ndarray, profile: np.ndarray, band: int = BAND) -> tuple[np.ndarray, np.ndarray, int]:
    """Best columns for the bases of one row given all other rows.

    Returns the column of each base, whether it opens a new column right of it, and the cost. Costs are
    disagreements with the other rows; ends are free, a new column costs the larger neighbouring
    coverage. Walking back prefers a gap, then the diagonal, then a new column.
    """
    width = len(codes)
    way = np.flatnonzero(codes < BASES)
    bases = codes[way]
    n = len(bases)
    if n == 0:
        return np.empty(0, int), np.empty(0, bool), 0
    others = profile.copy()
    used = np.flatnonzero(codes < N_SYMBOLS)
    others[used, codes[used]] -= 1
    others[used, N_SYMBOLS] -= 1
    cov = others[:, N_SYMBOLS]
    miss = cov[:, None] - others[:, :N_SYMBOLS]  # cost of putting a symbol into a column
    gap_sum = np.cumsum(miss[:, GAP])
    new_col = np.full(width, _FAR)
    if width > 2:
        new_col[1:-1] = np.maximum(cov[1:-1], cov[:-2])
    half = band // 2
    lo = np.maximum(0, way - half)
    hi = np.minimum(width, lo + band)
    table: list[np.ndarray] = []

    def value(x: int, a: int, b: int) -> np.ndarray:
        """Costs of base x ending in columns a..b-1, also outside its band."""
        if x < 0:
            return np.zeros(b - a, dtype=np.int64)
        out = np.full(b - a, _FAR)
        s, e = max(a, lo[x]), min(b, hi[x])
        if s < e:
            out[s - a:e - a] = table[x][s - lo[x]:e - lo[x]]
        if b > hi[x]:
            right = max(a, hi[x])
            out[right - a:] = table[x][-1] + gap_sum[right:b] - gap_sum[hi[x] - 1]
        return out

    for x in range(n):
        a, b = lo[x], hi[x]
        prev = value(x - 1, a - 1, b)
        if a == 0 and x > 0:
            prev[0] = _FAR
        cost = np.minimum(prev[:-1] + miss[a:b, bases[x]], prev[1:] + new_col[a:b])
        table.append(np.minimum.accumulate(cost - gap_sum[a:b]) + gap_sum[a:b])

    last = n - 1
    first_end = lo[last] + 1 if way[last] - half >= 0 else 0
    first_end = min(first_end, hi[last] - 1)
    ends = table[last][first_end - lo[last]:]
    y = hi[last] - 1 - int(np.argmin(ends[::-1]))
    best = int(ends.min())
    columns, opened = np.empty(n, dtype=np.int64), np.zeros(n, dtype=bool)
    x = last

    def at(x: int, y: int) -> int:
        if x < 0:
            return 0
        if y < lo[x]:
            return _FAR
        if y >= hi[x]:
            return table[x][-1] + gap_sum[y] - gap_sum[hi[x] - 1]
        return table[x][y - lo[x]]

    while x >= 0:
        here, left = at(x, y), at(x, y - 1)
        if here == left + miss[y, GAP] or (x == last and here == left):
            y -= 1
        elif here == at(x - 1, y - 1) + miss[y, bases[x]]:
            columns[x] = y
            x -= 1
            y -= 1
        else:
            columns[x], opened[x] = y, True
            x -= 1
    return columns, opened, best


def _placements(rows: DataFrame, profile: np.ndarray, band: int, first: int | None, last: int | None) -> DataFrame:
    """New columns of the rows ``first <= row_id < last``; the other rows pass through without any."""
    width = len(profile)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = encode(batch["symbols"], width)
            ids = batch["row_id"].to_numpy()
            chosen = np.ones(len(ids), bool) if first is None else (ids >= first) & (ids < last)
            placed = [place_row(c, profile, band) if take else None for c, take in zip(codes, chosen)]
            yield batch.assign(cols=[p and p[0].astype(np.int32) for p in placed], opened=[p and p[1] for p in placed])

    return spread(rows.select("row_id", "symbols")).mapInPandas(
        run, "row_id BIGINT, symbols STRING, cols ARRAY<INT>, opened ARRAY<BOOLEAN>")


def _new_columns(placed: DataFrame, width: int) -> np.ndarray:
    """Columns to open right of each column: the longest run any row inserts there."""
    opened = (placed.select("row_id", F.explode(F.arrays_zip("cols", "opened")).alias("b")).where("b.opened")
              .groupBy("row_id", F.col("b.cols").alias("col")).agg(F.count("*").alias("n"))
              .groupBy("col").agg(F.max("n").alias("n")))
    out = np.zeros(width, dtype=np.int64)
    counts = opened.toPandas()
    out[counts["col"]] = counts["n"]
    return out


def _write(placed: DataFrame, extra: np.ndarray) -> tuple[DataFrame, int]:
    """Rows in the widened matrix; a new column is blank for a row that is blank on either side of it."""
    width = len(extra)
    start = np.arange(width) + np.concatenate([[0], np.cumsum(extra)[:-1]])  # new index of old columns
    total = check_width(int(width + extra.sum()))
    owner = np.repeat(np.arange(width), extra + 1)  # old column at or left of each new column
    is_old = np.zeros(total, dtype=bool)
    is_old[start] = True
    right = np.minimum(owner + 1, width - 1)

    def widened(codes: np.ndarray) -> np.ndarray:
        blank = (codes[owner] == N_SYMBOLS) | (codes[right] == N_SYMBOLS) | (owner == width - 1)
        return np.where(is_old, codes[owner], np.where(blank, N_SYMBOLS, GAP))

    def moved(codes: np.ndarray, cols: np.ndarray, opened: np.ndarray) -> np.ndarray:
        line = np.full(total, N_SYMBOLS)
        if len(cols):
            key = cols * 2 + opened
            rank = np.arange(len(cols)) - np.searchsorted(key, key)
            pos = start[cols] + np.where(opened, rank + 1, 0)
            line[pos[0]:pos[-1]] = GAP
            line[pos] = codes[codes < BASES]
        return line

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = encode(batch["symbols"], width)
            lines = [widened(c) if cols is None else moved(c, np.asarray(cols, dtype=np.int64), np.asarray(opened, dtype=bool))
                     for c, cols, opened in zip(codes, batch["cols"], batch["opened"])]
            yield pd.DataFrame({"row_id": batch["row_id"], "symbols": [bytes(_CHARS[x]).decode() for x in lines]})

    return placed.mapInPandas(run, "row_id BIGINT, symbols STRING"), total


def select_columns(rows: DataFrame, width: int, keep: np.ndarray) -> DataFrame:
    def run(batches):
        for batch in batches:
            codes = encode(batch["symbols"], width)[:, keep]
            yield pd.DataFrame({"row_id": batch["row_id"], "symbols": [bytes(_CHARS[c]).decode() for c in codes]})
    return rows.select("row_id", "symbols").mapInPandas(run, "row_id BIGINT, symbols STRING")


def tidy(rows: DataFrame, width: int) -> tuple[DataFrame, int]:
    """Drop columns without bases, then blank the gap runs at row ends and around blanks."""
    keep = column_profile(rows, width)[:, :BASES].sum(axis=1) > 0
    kept = rows.select("row_id", "symbols") if keep.all() else select_columns(rows, width, keep)
    return matrix.blank_outer_gaps(kept), int(keep.sum())


def realign_step(rows: DataFrame, width: int, first: int | None = None, last: int | None = None,
                 band: int = BAND) -> tuple[DataFrame, int]:
    """Place rows ``first <= row_id < last`` (default all) anew against the current profile."""
    profile = column_profile(rows, width)
    placed = cut_lineage(_placements(rows, profile, band, first, last))
    new_rows, new_width = _write(placed, _new_columns(placed, width))
    return cut_lineage(new_rows), new_width


def realign_round(rows: DataFrame, width: int, rows_per_step: int = 1, band: int = BAND) -> tuple[DataFrame, int]:
    """Every row once, in row order, ``rows_per_step`` at a time.

    Rows placed together open columns of their own that later steps empty again, so after a parallel
    step columns without bases are dropped; they do not count in the score.
    """
    n = rows.agg(F.coalesce(F.max("row_id") + 1, F.lit(0))).first()[0]
    for first in range(0, n, rows_per_step):
        rows, width = realign_step(rows, width, first, first + rows_per_step, band)
        if rows_per_step > 1:
            keep = column_profile(rows, width)[:, :BASES].sum(axis=1) > 0
            rows, width = select_columns(rows, width, keep), int(keep.sum())
    return cut_lineage(rows), width


def score_of(rows: DataFrame) -> int:
    return matrix.sum_of_pairs_score(matrix.to_cells(rows)).first()["score"]


def realign(rows: DataFrame, width: int, rows_per_step: int = 1, band: int = BAND,
            max_rounds: int = MAX_ROUNDS) -> tuple[DataFrame, int, list[tuple[int, int, int]]]:
    """Rounds until the sum-of-pairs score stops improving; also the (round, score, width) history."""
    current, width = tidy(rows, width)
    current = cut_lineage(current)
    best, best_width, best_score = current, width, score_of(current)
    history = [(0, best_score, width)]
    for number in range(1, max_rounds + 1):
        current, width = realign_round(current, width, rows_per_step, band)
        score = score_of(current)
        history.append((number, score, width))
        if score >= best_score:
            break
        best, best_width, best_score = current, width, score
    final, final_width = tidy(current, width)
    final = cut_lineage(final)
    if score_of(final) < best_score:
        best, best_width = final, final_width
    return best, best_width, history
