"""Co-occurrence counts of all column pairs by blocked matrix products.

Wide rows are cut into column blocks; a task gets one pair of blocks for a bounded number of
rows and multiplies their one-hot matrices. Row pairs or cell pairs are never formed. The
partial products are dense per column pair, so Spark's ordinary partial/final sum merges
them, and a heavy row range or label only means more tasks of the same size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import stats
from skein.operators import matrix
from skein.schema import N_SYMBOLS, group_id
from skein.session import cut_lineage

BLOCK_COLS = 256
BLOCK_ROWS = 8192
COVERED = N_SYMBOLS  # indicator of "any symbol", next to the five symbol indicators
_INDICATORS = N_SYMBOLS + 1
_COUNT_NAMES = [f"n{a}{b}" for a in range(_INDICATORS) for b in range(_INDICATORS)]
_CODE_OF = np.full(256, COVERED, dtype=np.int8)
for _i, _pair in enumerate(("aA", "cC", "gG", "tT", "-_")):
    for _ch in _pair:
        _CODE_OF[ord(_ch)] = _i


def encode(symbols: pd.Series, width: int | None = None) -> np.ndarray:
    """Symbol strings to an int8 matrix, 5 marks a blank; short rows end in blanks, longer ones than ``width`` are an error."""
    if width is None:
        width = len(symbols.iloc[0]) if len(symbols) else 0
    if any(len(s) > width for s in symbols):
        raise ValueError(f"a row is longer than the matrix width {width}")
    raw = "".join(s.ljust(width) for s in symbols).encode("ascii", "replace")
    return _CODE_OF[np.frombuffer(raw, dtype=np.uint8)].reshape(len(symbols), width)


def _indicators(codes: np.ndarray) -> np.ndarray:
    """One-hot symbols plus coverage, as float32 columns ordered (indicator, column)."""
    planes = [codes == s for s in range(N_SYMBOLS)] + [codes < N_SYMBOLS]
    return np.concatenate(planes, axis=1).astype(np.float32)


def _product(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Counts[a, i, b, j] of rows with indicator a in left column i and b in right column j."""
    # float32 sums of 0/1 are exact below 2**24 rows; blocks stay far under that
    out = _indicators(left).T @ _indicators(right)
    return out.reshape(_INDICATORS, left.shape[1], _INDICATORS, right.shape[1])


def _count_frame(counts: np.ndarray, left0: int, right0: int, min_gap: int, disjoint: bool) -> pd.DataFrame:
    shared = counts[COVERED, :, COVERED, :]
    i, j = np.nonzero(shared > (-1 if disjoint else 0))
    keep = (j + right0) - (i + left0) >= min_gap
    i, j = i[keep], j[keep]
    frame = {"ci": (i + left0).astype(np.int32), "cj": (j + right0).astype(np.int32)}
    for a in range(_INDICATORS):
        for b in range(_INDICATORS):
            frame[f"n{a}{b}"] = counts[a, i, b, j].astype(np.int64)
    return pd.DataFrame(frame)


_COUNT_SCHEMA = "ci INT, cj INT, " + ", ".join(f"{c} BIGINT" for c in _COUNT_NAMES)


def column_pairs(rows: DataFrame, width: int, min_gap: int, by: tuple[str, ...] = (),
                 disjoint: bool = False, block_cols: int = BLOCK_COLS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All 36 indicator counts of every column pair at least ``min_gap`` apart.

    Output: ``by``, ``ci``, ``cj``, ``n<a><b>``; a and b are 0..4 or 5 for "covered".
    Column pairs without a shared row are left out unless ``disjoint`` is set.
    """
    min_gap = max(1, min_gap)
    if width <= block_cols and not by:
        partial = _map_side(rows, width, min_gap, disjoint)
    else:
        partial = _blocked(rows, width, min_gap, by, disjoint, block_cols, block_rows)
    return partial.groupBy(*by, "ci", "cj").agg(*[F.sum(c).alias(c) for c in _COUNT_NAMES])


def _map_side(rows: DataFrame, width: int, min_gap: int, disjoint: bool) -> DataFrame:
    """Few columns: every task sums its own rows, only counts are shuffled."""
    def multiply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((_INDICATORS, width, _INDICATORS, width))
        for batch in batches:
            for start in range(0, len(batch), BLOCK_ROWS):
                codes = encode(batch["symbols"].iloc[start:start + BLOCK_ROWS], width)
                total += _product(codes, codes)
        yield _count_frame(total, 0, 0, min_gap, disjoint)

    return rows.select("symbols").mapInPandas(multiply, _COUNT_SCHEMA)


def _blocked(rows, width, min_gap, by, disjoint, block_cols, block_rows) -> DataFrame:
    """Many columns or several keys: one group per (key, block pair, row range)."""
    last = -(-width // block_cols) - 1
    piece = "substring(symbols, {b} * %d + 1, %d)" % (block_cols, block_cols)
    # a group holds at most block_rows rows of one key and one block pair
    ranged = (rows.select(*by, F.col("symbols"), F.expr(f"row_id div {block_rows}").alias("rb"),
                          F.explode(F.sequence(F.lit(0), F.lit(last))).alias("bi"))
              .select("*", F.explode(F.sequence(F.col("bi"), F.lit(last))).alias("bj"))
              .where((F.col("bj") + 1 - F.col("bi")) * block_cols > min_gap))
    left_used, right_used = F.trim("left_part") != "", F.trim("right_part") != ""
    sliced = (ranged.select(*by, "rb", "bi", "bj", F.expr(piece.format(b="bi")).alias("left_part"),
                            F.expr(piece.format(b="bj")).alias("right_part"))
              .where((left_used | right_used) if disjoint else (left_used & right_used)))
    keys = [*by, "bi", "bj", "rb"]

    def multiply(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bi, bj = int(key[-3]), int(key[-2])
        wl = min(block_cols, width - bi * block_cols)
        wr = min(block_cols, width - bj * block_cols)
        counts = _product(encode(pdf["left_part"], wl), encode(pdf["right_part"], wr))
        out = _count_frame(counts, bi * block_cols, bj * block_cols, min_gap, disjoint)
        for pos, name in enumerate(by):
            out.insert(pos, name, key[pos])
        return out

    by_schema = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in rows.select(*by).schema)
    return sliced.groupBy(*keys).applyInPandas(multiply, by_schema + _COUNT_SCHEMA)


def contiguous_overlap(pairs: DataFrame, min_cov: int, min_gap: int) -> DataFrame:
    """Scan to the right of every column and stop for good at the first weakly shared column."""
    shared = F.col(f"n{COVERED}{COVERED}")
    order = Window.partitionBy("ci").orderBy("cj")
    return (pairs.where(shared >= min_cov)
            .withColumn("step", F.row_number().over(order) - 1)
            .where(F.col("cj") - F.col("ci") - min_gap == F.col("step")).drop("step"))


def group_pairs(pairs: DataFrame, by: tuple[str, ...] = (), min_shared: int = 1) -> DataFrame:
    """Column-pair counts to one row per pair of groups.

    ``k`` rows carry both symbols, ``g1``/``g2`` rows of either group lie under the other column,
    ``cov`` rows cover both columns.
    """
    entries = [F.struct(F.lit(a).alias("si"), F.lit(b).alias("sj"), F.col(f"n{a}{b}").alias("k"),
                        F.col(f"n{a}{COVERED}").alias("g1"), F.col(f"n{COVERED}{b}").alias("g2"))
               for a in range(N_SYMBOLS) for b in range(N_SYMBOLS)]
    wanted = F.filter(F.array(*entries), lambda e: (e["k"] >= min_shared) & (e["g1"] > 0) & (e["g2"] > 0))
    return (pairs.select(*by, "ci", "cj", F.col(f"n{COVERED}{COVERED}").alias("cov"), F.explode(wanted).alias("e"))
            .select(*by, "ci", "e.si", "cj", "e.sj", "e.k", "e.g1", "e.g2", "cov"))


def _sized(sizes: DataFrame, col: str, sym: str, name: str) -> DataFrame:
    return sizes.select(F.col("col").alias(col), F.col("sym").alias(sym), F.col("size").alias(name))


def with_sizes(group_pair_rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Attach the full group sizes of both sides."""
    return (group_pair_rows.join(_sized(sizes, "ci", "si", "size_i"), ["ci", "si"])
            .join(_sized(sizes, "cj", "sj", "size_j"), ["cj", "sj"]))


def pair_significance(sized_pairs: DataFrame, base: float = stats.PAIR_BASE) -> DataFrame:
    """Add ``z``; expects the output of :func:`with_sizes`."""
    c = F.col
    return sized_pairs.withColumn(
        "z", stats.significance(c("k"), c("g1"), c("g2"), c("cov"), c("size_i"), c("size_j"), base))


def relative_significance(rows: DataFrame, width: int, universe: DataFrame) -> DataFrame:
    """Two-sided significance ``z`` of two groups counted within the rows of ``universe`` only; 0 if one is empty there."""
    inside = cut_lineage(rows.join(universe.select("row_id"), "row_id", "left_semi"))
    found = group_pairs(column_pairs(inside, width, 1), min_shared=0)
    c = F.col
    return with_sizes(found, matrix.group_sizes(matrix.to_cells(inside))).withColumn(
        "z", stats.two_sided(c("k"), c("size_i"), c("size_j"), F.lit(inside.count())))


def both_directions(pairs: DataFrame, *carry: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Each unordered pair as (g, partner) and (partner, g)."""
    gi, gj = group_id(F.col("ci"), F.col("si")), group_id(F.col("cj"), F.col("sj"))
    sides = F.array(F.struct(gi.alias("g"), gj.alias("partner")), F.struct(gj.alias("g"), gi.alias("partner")))
    return (pairs.select(*by, *carry, F.explode(sides).alias("side"))
            .select(*by, "side.g", "side.partner", *carry))
