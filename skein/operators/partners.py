"""Strongest co-occurrences of every group, found inside the matrix products.

Columns are cut into blocks; a tile is a pair of blocks. The product of the two blocks' indicator matrices (one column for each group that
can take part and one for "covered") holds all counts of the tile. Counts of a tile are summed as one packed matrix: by the scan tasks
themselves if all tiles fit a task, else by tasks that get the non-empty slices of a share of the rows. The summed tile is judged
where it lies, and only what is asked for leaves the task: the best significance of a group, how many of its partners
are significant, or its best few partners. Tables of column pairs or of their counters are never written.

*Pruning.* A tail is at least as large as one of its terms, so group sizes, overlap and shared coverage bound the significance of a
pair without the sum. Pairs are judged in the order of their bounds, until none that is left can change the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import stats
from skein.operators import matrix, pairs
from skein.schema import N_SYMBOLS, check_width, group_id
from skein.session import cut_lineage

MAP_SIDE_BYTES = 128 << 20  # all tiles together, up to which scan tasks sum them
CHUNK = 1 << 15  # pairs judged at once


@dataclass
class Layout:
    """Which groups take part, by block; of the size of the matrix width."""

    width: int
    block_cols: int
    groups: np.ndarray  # ascending ids of the groups that take part
    sizes: np.ndarray  # rows of each
    left: np.ndarray  # may it stand on the left of a pair
    asked: np.ndarray  # is it asked for
    every: bool = False  # also tiles without groups, whose coverage matters

    @property
    def blocks(self) -> int:
        return max(-(-self.width // self.block_cols), 1)

    def of(self, block: int) -> slice:
        step = self.block_cols * N_SYMBOLS
        return slice(*np.searchsorted(self.groups, [block * step, (block + 1) * step]))

    def columns(self, block: int) -> int:
        return min(self.block_cols, self.width - block * self.block_cols)

    def tiles(self) -> list[tuple[int, int]]:
        """Block pairs in which both sides have groups and one of them is asked for."""
        own = [self.of(b) for b in range(self.blocks)]
        n, wanted = [s.stop - s.start for s in own], [bool(self.asked[s].any()) for s in own]
        return [(i, j) for i in range(self.blocks) for j in range(i, self.blocks) if self.every or n[i] and n[j] and (wanted[i] or wanted[j])]

    def side(self, block: int) -> int:
        own = self.of(block)
        return own.stop - own.start + self.columns(block)

    def bytes(self) -> int:
        return sum(8 * self.side(i) * self.side(j) for i, j in self.tiles())

    def indicators(self, codes: np.ndarray, block: int) -> np.ndarray:
        """Groups of the block, then its columns as covered or not."""
        local = self.groups[self.of(block)] - block * self.block_cols * N_SYMBOLS
        return np.concatenate([codes[:, local // N_SYMBOLS] == local % N_SYMBOLS, codes < N_SYMBOLS], axis=1).astype(np.float32)


def layout(sizes: DataFrame, width: int, least: int, left_columns: DataFrame | None = None, asked: DataFrame | None = None,
           every: bool = False, block_cols: int = pairs.BLOCK_COLS) -> Layout:
    """Groups of ``sizes(col, sym, size)`` with at least ``least`` rows; the tables grow with the matrix width only."""
    check_width(width)
    g = sizes.where(F.col("size") >= least).select(group_id(F.col("col"), F.col("sym")).alias("g"), "size").toPandas().sort_values("g")
    groups = g["g"].to_numpy(np.int64)
    ids = lambda df, c: df.select(c).toPandas()[c].to_numpy(np.int64)
    left = np.ones(len(g), bool) if left_columns is None else np.isin(groups // N_SYMBOLS, ids(left_columns, "col"))
    wanted = np.ones(len(g), bool) if asked is None else np.isin(groups, ids(asked, "g"))
    return Layout(width, block_cols, groups, g["size"].to_numpy(np.int64), left, wanted, every)


_TILE = "bi INT, bj INT, counts BINARY"


def _packed(found: dict[tuple[int, int], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for (i, j), total in found.items():
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([total.astype(np.int64).tobytes()], pa.binary())],
                                         ["bi", "bj", "counts"])


def _encoded(column, width: int) -> Iterator[np.ndarray]:
    """Symbol codes of rows, at most as many at once as fit a few MB."""
    step = max(1, min(pairs.BLOCK_ROWS, (16 << 20) // max(width, 1)))
    for lo in range(0, len(column), step):
        yield pairs.encode(column.slice(lo, step).to_pandas(), width)


def _by_scan(plan):
    """Every task sums its own rows for all tiles."""
    def run(batches):
        layout = plan.value
        tiles, found = layout.tiles(), {}
        for batch in batches:
            for codes in _encoded(batch.column(0), layout.width):
                sides = {b: layout.indicators(codes[:, b * layout.block_cols:(b + 1) * layout.block_cols], b) for b in {x for t in tiles for x in t}}
                for t in tiles:
                    product = sides[t[0]].T @ sides[t[1]]  # sums of 0/1 in float32 are exact below 2**24 rows
                    found[t] = found[t] + product if t in found else product.astype(np.float64)
        yield from _packed(found)
    return run


def _by_tile(plan):
    """Sums of slices that are sorted by tile and share."""
    def run(batches):
        layout, key, total = plan.value, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = np.stack([batch.column(c).to_numpy() for c in ("bi", "bj", "share")])
            cuts = [0, *(np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                own = tuple(marks[:, lo].tolist())
                if own != key:
                    if key:
                        yield from _packed({key[:2]: total})
                    key, total = own, 0.0
                i, j = key[:2]
                left, right = (batch.column(c).slice(lo, hi - lo) for c in ("left", "right"))
                for a, b in zip(_encoded(left, layout.block_cols), _encoded(right, layout.block_cols)):
                    a, b = a[:, :layout.columns(i)], b[:, :layout.columns(j)]
                    total = total + (layout.indicators(a, i).T @ layout.indicators(b, j)).astype(np.float64)
        if key:
            yield from _packed({key[:2]: total})
    return run


def _summed(batches):
    """Sum of the packed matrices of a tile, sorted by tile."""
    key, total = None, None
    for batch in batches:
        for i, j, counts in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "counts"))):
            own = np.frombuffer(counts, np.int64)
            if (i, j) != key:
                if key:
                    yield from _packed({key: total})
                key, total = (i, j), own.copy()
            else:
                total += own
    if key:
        yield from _packed({key: total})


def tile_counts(rows: DataFrame, layout: Layout) -> DataFrame:
    """(bi, bj, counts) of every tile with a row. Rows are not moved if the tiles fit a task, else only their non-empty slices are."""
    spark = rows.sparkSession
    plan = spark.sparkContext.broadcast(layout)
    tiles = layout.tiles()
    if not tiles:
        return spark.createDataFrame([], _TILE)
    cores = spark.sparkContext.defaultParallelism
    if layout.bytes() <= MAP_SIDE_BYTES:
        parts = rows.select("symbols").mapInArrow(_by_scan(plan), _TILE).withColumn("share", F.pmod(F.spark_partition_id(), F.lit(cores)))
    else:
        size, shares = layout.block_cols, max(1, -(-4 * cores // len(tiles)))
        piece = F.transform(F.sequence(F.lit(0), F.lit(layout.blocks - 1)), lambda b: F.struct(
            b.alias("b"), F.substring("symbols", b * size + 1, F.lit(size)).alias("part")))
        used = F.filter(piece, lambda p: F.trim(p["part"]) != "")
        pairs_of = F.transform(F.col("_used"), lambda x, i: F.transform(
            F.slice(F.col("_used"), i + 1, F.size("_used")), lambda y: F.struct(x["b"].alias("bi"), y["b"].alias("bj"), x["part"].alias("left"), y["part"].alias("right"))))
        known = spark.createDataFrame(tiles, "bi INT, bj INT")
        slices = (rows.select(F.pmod(F.xxhash64("row_id"), F.lit(shares)).cast("int").alias("share"), used.alias("_used"))
                  .select("share", F.inline(F.flatten(pairs_of))))
        if len(tiles) < layout.blocks * (layout.blocks + 1) // 2:
            slices = slices.join(F.broadcast(known), ["bi", "bj"], "left_semi")  # at most a row a tile
        keys = ["bi", "bj", "share"]
        parts = (slices.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_by_tile(plan), _TILE)
                 .withColumn("share", F.pmod(F.spark_partition_id(), F.lit(cores))))
    for keys in (["bi", "bj", "share"], ["bi", "bj"]):  # in two steps: a tile can have as many parts as there are tasks
        parts = parts.repartition(*keys).sortWithinPartitions(*keys).select("bi", "bj", "counts").mapInArrow(_summed, _TILE)
        parts = parts.withColumn("share", F.lit(0)) if len(keys) == 3 else parts
    return cut_lineage(parts)


# --- judging a tile ------------------------------------------------------------

class Tile:
    """Pairs of a tile that fulfil the conditions on gap, coverage and overlap."""

    def __init__(self, layout: Layout, i: int, j: int, counts: bytes, min_gap: int, min_cov: int, least_shared: int, stops: np.ndarray | None):
        own, other = layout.of(i), layout.of(j)
        a, b = layout.groups[own], layout.groups[other]
        na, nb = len(a), len(b)
        m = np.frombuffer(counts, np.int64).reshape(layout.side(i), layout.side(j))
        ca, cb = a // N_SYMBOLS - i * layout.block_cols, b // N_SYMBOLS - j * layout.block_cols
        cov = m[na:, nb:]
        cols = np.arange(layout.columns(i))[:, None] + i * layout.block_cols, np.arange(layout.columns(j))[None, :] + j * layout.block_cols
        ok = (cols[1] - cols[0] >= max(1, min_gap)) & (cov >= min_cov)
        if stops is not None:
            ok &= cols[1] < stops[cols[0]]
        wanted = (m[:na, :nb] >= max(least_shared, 1)) & ok[ca[:, None], cb[None, :]] & layout.left[own][:, None]
        wanted &= layout.asked[own][:, None] | layout.asked[other][None, :]
        p, q = np.nonzero(wanted)
        self.a, self.b = a[p], b[q]
        self.size_a, self.size_b = layout.sizes[own][p], layout.sizes[other][q]
        self.k, self.g1, self.g2, self.cov = m[p, q], m[p, nb + cb[q]], m[na + ca[p], q], cov[ca[p], cb[q]]
        self.asked = layout.asked[own][p], layout.asked[other][q]

    def bound(self) -> np.ndarray:
        """At least the significance of every pair, with room for rounding.

        A tail is at least its largest term, and below the mean by t at least t^2 / (variance + t^2) (Cantelli).
        """
        k, g1, g2, n = (np.asarray(x, np.float64) for x in (self.k, self.g1, self.g2, self.cov))
        top = np.clip(np.maximum(k, np.floor((g1 + 1) * (g2 + 1) / (n + 2))), np.maximum(0, g1 + g2 - n), np.minimum(g1, g2))
        z = -(stats._log_choose(g2, top) + stats._log_choose(n - g2, g1 - top) - stats._log_choose(n, g1)) / np.log(10.0)
        below = np.maximum(g1 * g2 / n - k, 0.0)
        var = g1 * g2 * (n - g1) * (n - g2) / (n * n * np.maximum(n - 1, 1))
        with np.errstate(divide="ignore", invalid="ignore"):
            z = np.minimum(z, np.where(below > 0, -np.log10(below ** 2 / (var + below ** 2)), np.inf))
        z = np.maximum(z, 0.0) * (1 + 1e-9) + 1e-6
        return np.where(z >= stats.SATURATED - 1e-3, stats.Z_CAP + 1.0, z)

    def z(self, at: np.ndarray, base: float) -> np.ndarray:
        k, size_a, size_b = self.k[at], self.size_a[at], self.size_b[at]
        z = stats._capped(stats.upper_tail_log10(k, self.g1[at], self.g2[at], self.cov[at]))
        return np.where(z > stats.SATURATED, base + 2.0 * k / (2.0 * k + (size_a - k) + (size_b - k)), z)


def _stops(plan, min_gap: int, min_cov: int):
    """First column of every tile that shares too few rows with a column on its left."""
    def run(batches):
        layout = plan.value
        for batch in batches:
            for i, j, counts in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "counts"))):
                cov = np.frombuffer(counts, np.int64).reshape(layout.side(i), layout.side(j))[-layout.columns(i):, -layout.columns(j):]
                left, right = np.arange(cov.shape[0]) + i * layout.block_cols, np.arange(cov.shape[1]) + j * layout.block_cols
                weak = (cov < min_cov) & (right[None, :] - left[:, None] >= min_gap)
                hit = weak.any(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(left[hit].astype(np.int32)), pa.array(right[weak.argmax(axis=1)[hit]].astype(np.int32))], ["ci", "cj"])
    return run


def first_gaps(tiles: DataFrame, layout: Layout, min_gap: int, min_cov: int) -> np.ndarray:
    """By column the first one on its right that shares fewer than ``min_cov`` rows with it, else the width."""
    plan = tiles.sparkSession.sparkContext.broadcast(layout)
    found = tiles.mapInArrow(_stops(plan, min_gap, min_cov), "ci INT, cj INT").groupBy("ci").agg(F.min("cj").alias("cj")).toPandas()  # a row a column
    out = np.full(layout.width, layout.width, np.int64)
    out[found["ci"].to_numpy()] = found["cj"].to_numpy()
    present = {(r.bi, r.bj) for r in tiles.select("bi", "bj").collect()}
    for i, j in set(layout.tiles()) - present:  # no row lies in both blocks
        cols = np.arange(i * layout.block_cols, i * layout.block_cols + layout.columns(i))
        first = np.maximum(j * layout.block_cols, cols + min_gap)
        out[cols] = np.where(first < j * layout.block_cols + layout.columns(j), np.minimum(out[cols], first), out[cols])
    return out


def _judged(plan, terms: dict, judge):
    def run(batches):
        for batch in batches:
            for i, j, counts in zip(*(batch.column(c).to_pylist() for c in ("bi", "bj", "counts"))):
                yield judge(Tile(plan.value, i, j, counts, **terms))
    return run


def _strongest(base: float, cutoff: float | None, apart: int):
    """Best significance and number of significant partners of the groups of a tile."""
    def judge(tile: Tile) -> pa.RecordBatch:
        ids, at = np.unique(np.concatenate([tile.a, tile.b]), return_inverse=True)
        ia, ib = at[:len(tile.a)], at[len(tile.a):]
        best, partners = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        bound = tile.bound()
        counts = (bound > cutoff) & (np.abs(tile.b - tile.a) > apart) if cutoff is not None else np.zeros(len(bound), bool)
        left = np.argsort(-bound, kind="stable")
        while len(left):
            now, left = left[:CHUNK], left[CHUNK:]
            z = tile.z(now, base)
            for side in (ia, ib):
                np.maximum.at(best, side[now], z)
                if cutoff is not None:
                    np.add.at(partners, side[now], counts[now] & (z > cutoff))
            left = left[(bound[left] > np.minimum(best[ia[left]], best[ib[left]])) | counts[left]]
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(best), pa.array(partners)], ["g", "z", "partners"])
    return judge


def strongest(rows: DataFrame, width: int, n_rows: int, min_cov: int = 30, min_gap: int = 20, base_dominated: bool = True,
              stop_at_first_gap: bool = False, cutoff: float | None = None, apart: int = 0, block_cols: int = pairs.BLOCK_COLS) -> DataFrame:
    """(g, z, partners) of the groups with a tested partner, tested as by :func:`correlate.tested_pairs`.

    ``z`` is the best significance; ``partners`` counts those above ``cutoff`` whose ids are more than ``apart`` away.
    """
    cells = matrix.to_cells(rows)
    sizes = matrix.eligible_groups(matrix.group_sizes(cells), n_rows, min_cov)
    left = matrix.base_dominated_columns(matrix.column_counts(cells)).select("col") if base_dominated else None
    plan = layout(sizes, width, 1, left, every=stop_at_first_gap, block_cols=block_cols)
    tiles = tile_counts(rows, plan)
    stops = first_gaps(tiles, plan, max(1, min_gap), min_cov) if stop_at_first_gap else None
    terms = {"min_gap": min_gap, "min_cov": min_cov, "least_shared": 1, "stops": stops}
    sent = rows.sparkSession.sparkContext.broadcast(plan)
    return (tiles.mapInArrow(_judged(sent, terms, _strongest(stats.PAIR_BASE, cutoff, apart)), "g BIGINT, z DOUBLE, partners BIGINT")
            .groupBy("g").agg(F.max("z").alias("z"), F.sum("partners").alias("partners")))


def _best_partners(base: float, cutoff: float, most: int):
    """The best partners of the groups of a tile that are asked for: by significance to nine digits, then by id."""
    def judge(tile: Tile) -> pa.RecordBatch:
        bound = tile.bound()
        seed, partner, pair = (np.concatenate([x[tile.asked[0]], y[tile.asked[1]]]) for x, y in (
            (tile.a, tile.b), (tile.b, tile.a), (np.arange(len(bound)), np.arange(len(bound)))))
        ids, at = np.unique(seed, return_inverse=True)
        least = np.full(len(ids), cutoff)  # what a partner must exceed
        kept = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        left = np.argsort(-bound[pair], kind="stable")
        while len(left):
            left = left[bound[pair[left]] > least[at[left]] - 2e-9]
            now, left = left[:CHUNK], left[CHUNK:]
            z = tile.z(pair[now], base)
            ok = z > cutoff
            s, g, z = (np.concatenate([x, y[ok]]) for x, y in zip(kept, (at[now], partner[now], z)))
            order = np.lexsort((g, -np.round(z, 9), s))
            s, g, z = s[order], g[order], z[order]
            rank = np.arange(len(s)) - np.searchsorted(s, s)
            full = rank == most - 1
            least[s[full]] = np.maximum(least[s[full]], z[full])
            kept = tuple(x[rank < most] for x in (s, g, z))
        return pa.RecordBatch.from_arrays([pa.array(ids[kept[0]]), pa.array(kept[1]), pa.array(kept[2])], ["seed", "g", "z"])
    return judge


def best_partners(rows: DataFrame, width: int, sizes: DataFrame, seeds: DataFrame, cutoff: float, least_shared: int, most: int,
                  base: float = stats.CLIQUE_BASE, block_cols: int = pairs.BLOCK_COLS) -> DataFrame:
    """(seed, g, z, rank): up to ``most`` partners of every seed above ``cutoff``, at any distance; a tile sends no more than that of a seed."""
    plan = layout(sizes, width, least_shared, asked=seeds, block_cols=block_cols)
    sent = rows.sparkSession.sparkContext.broadcast(plan)
    terms = {"min_gap": 1, "min_cov": 0, "least_shared": least_shared, "stops": None}
    found = tile_counts(rows, plan).mapInArrow(_judged(sent, terms, _best_partners(base, cutoff, most)), "seed BIGINT, g BIGINT, z DOUBLE")
    best = Window.partitionBy("seed").orderBy(F.round("z", 9).desc(), "g")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most)
