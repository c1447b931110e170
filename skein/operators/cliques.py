"""Cliques of co-occurring groups and the row sets refined from them.

A clique is at most 30 group ids, so a clique table is proportional to the number of columns. It is
shipped to the tasks in slices of a fixed size and every row is scored where it lies: rows are
never joined with groups, only small histograms per seed are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import stats
from skein.operators import pairs, partners
from skein.schema import N_SYMBOLS

# --- fixed values -----------------------------------------------------------
MAX_CLIQUE = 30         # members including the seed
MIN_CLIQUE = 6          # smaller cliques are dropped
NO_DROP = 1_000_000.0   # drop-off of a seed without a usable cutoff
# target share of a group kept by its core, by group size
CORE_SHARES = ((100, 0.77), (1000, 0.83), (2000, 0.90), (None, 0.93))
# ----------------------------------------------------------------------------
SLICE = 100_000  # cliques shipped to the tasks at a time


def top_partners(rows: DataFrame, width: int, sizes: DataFrame, seeds: DataFrame, cutoff: float,
                 min_cov: int, max_clique: int = MAX_CLIQUE) -> DataFrame:
    """Seed first (rank 0), then its best partners by significance, lower id on ties.

    Partners may lie at any distance. Every tile of the matrix product keeps the best ``max_clique - 1`` of a seed.
    """
    ranked = partners.best_partners(rows, width, sizes, seeds, cutoff, min_cov // 4 + 1, max_clique - 1)
    own = seeds.select(F.col("g").alias("seed"), "g", F.lit(None).cast("double").alias("z"), F.lit(0).alias("rank"))
    return own.unionByName(ranked)


def clique_sizes(cliques: DataFrame, min_size: int = MIN_CLIQUE) -> DataFrame:
    return cliques.groupBy("seed").agg(F.count("*").alias("size")).where(F.col("size") >= min_size)


def large_cliques(cliques: DataFrame, min_size: int = MIN_CLIQUE) -> DataFrame:
    return cliques.join(clique_sizes(cliques, min_size), "seed", "left_semi")


class _Clique:
    """Members of one seed as numpy columns, seed first."""

    def __init__(self, seed: int, members: list[int]):
        self.seed = seed
        ids = np.asarray(members)
        self.cols, self.syms = ids // N_SYMBOLS, (ids % N_SYMBOLS).astype(np.int8)

    def hits(self, codes: np.ndarray) -> np.ndarray:
        return (codes[:, self.cols] == self.syms).sum(axis=1)

    def covered(self, codes: np.ndarray) -> np.ndarray:
        return (codes[:, self.cols] < N_SYMBOLS).sum(axis=1)


def _slices(cliques: DataFrame) -> Iterator[list[_Clique]]:
    """Clique table in bounded slices of seeds, each small enough to ship."""
    packed = cliques.groupBy("seed").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "g"))), lambda x: x["g"]).alias("members"))
    after = -1
    while True:
        part = packed.where(F.col("seed") > after).orderBy("seed").limit(SLICE).collect()
        if not part:
            return
        yield [_Clique(r["seed"], r["members"]) for r in part]
        if len(part) < SLICE:
            return
        after = part[-1]["seed"]


def _over_slices(cliques: DataFrame, run, empty_schema: str) -> DataFrame:
    parts = [run(chunk) for chunk in _slices(cliques)]
    if not parts:
        return cliques.sparkSession.createDataFrame([], empty_schema)
    return reduce(DataFrame.unionByName, parts)


def hit_histogram(rows: DataFrame, width: int, cliques: DataFrame, by: str | None = None) -> DataFrame:
    """Rows by number of clique members they carry.

    Per seed (and ``by`` key) and number of ``hits``: rows ``n``, those covering the seed's column
    ``n_cov``, those in the seed group ``n_seed``.
    """
    keys = [by] if by else []
    schema = "".join(f"{k} BIGINT, " for k in keys) + "seed BIGINT, hits INT, n BIGINT, n_cov BIGINT, n_seed BIGINT"

    def run(chunk: list[_Clique]) -> DataFrame:
        def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                codes = pairs.encode(batch["symbols"], width)
                label, names = (pd.factorize(batch[by]) if by else (np.zeros(len(batch), int), [0]))
                rows_out = []
                for clique in chunk:
                    h = clique.hits(codes)
                    key = label * (MAX_CLIQUE + 1) + h
                    seed_col = codes[:, clique.cols[0]]
                    length = len(names) * (MAX_CLIQUE + 1)
                    n = np.bincount(key, minlength=length)
                    n_cov = np.bincount(key[seed_col < N_SYMBOLS], minlength=length)
                    n_seed = np.bincount(key[seed_col == clique.syms[0]], minlength=length)
                    at = np.flatnonzero(n)
                    frame = {by: np.asarray(names)[at // (MAX_CLIQUE + 1)]} if by else {}
                    frame |= {"seed": clique.seed, "hits": at % (MAX_CLIQUE + 1), "n": n[at],
                              "n_cov": n_cov[at], "n_seed": n_seed[at]}
                    rows_out.append(pd.DataFrame(frame))
                if rows_out:
                    yield pd.concat(rows_out)

        return rows.select(*keys, "symbols").mapInPandas(count, schema)

    partial = _over_slices(cliques, run, schema)
    return partial.groupBy(*keys, "seed", "hits").agg(*[F.sum(c).alias(c) for c in ("n", "n_cov", "n_seed")])


def rows_above(histogram: DataFrame, cliques: DataFrame, by: str | None = None, min_size: int = MIN_CLIQUE) -> DataFrame:
    """Arrays indexed by cutoff c = 0..size-1 with the rows having more than c hits."""
    keys = [by] if by else []
    packed = histogram.groupBy(*keys, "seed").agg(F.collect_list(F.struct("hits", "n", "n_cov", "n_seed")).alias("h"))
    cumulated = [F.expr(f"transform(sequence(0, cast(size - 1 as int)), c -> "
                        f"aggregate(h, 0L, (s, x) -> s + IF(x.hits > c, x.{v}, 0L)))").alias(name)
                 for v, name in (("n", "above"), ("n_cov", "above_cov"), ("n_seed", "above_seed"))]
    return packed.join(clique_sizes(cliques, min_size), "seed").select(*keys, "seed", "size", *cumulated)


def clique_histogram(above: DataFrame) -> DataFrame:
    """Long form of :func:`rows_above`."""
    return above.select("seed", F.posexplode("above").alias("cutoff", "n_rows"))


def dropoff(above: DataFrame, n_rows: int) -> DataFrame:
    """Cutoff where the number of selected rows changes least around it, lowest cutoff on ties.

    The change is taken relative to the smaller side of the split of all ``n_rows`` rows.
    """
    smaller = f"nullif(least({n_rows} - above[c], above[c]), 0)"
    candidates = F.expr(
        "IF(size < 3, array(), filter(transform(sequence(1, cast(size - 2 as int)), c -> named_struct("
        f"'drop_off', (above[c - 1] - above[c + 1]) / {smaller}, 'cutoff', c)), x -> x.drop_off IS NOT NULL))")
    best = F.array_min("candidates")
    return (above.withColumn("candidates", candidates)
            .withColumn("drop_off", F.coalesce(best["drop_off"], F.lit(NO_DROP)))
            .withColumn("cutoff", F.coalesce(best["cutoff"], F.lit(1))).drop("candidates"))


def prefix_dropoff(rows: DataFrame, width: int, cliques: DataFrame, n_rows: int, min_cutoff: int = 1,
                   min_size: int = 5) -> DataFrame:
    """Drop-off over clique prefixes and cutoffs together; later (prefix, cutoff) wins ties."""
    schema = "seed BIGINT, prefix INT, hits INT, n BIGINT"

    def run(chunk: list[_Clique]) -> DataFrame:
        def count(batches):
            for batch in batches:
                codes = pairs.encode(batch["symbols"], width)
                out = []
                for clique in chunk:
                    seen = np.cumsum(codes[:, clique.cols] == clique.syms, axis=1)
                    for k in range(min_size, seen.shape[1] + 1):
                        hits, n = np.unique(seen[:, k - 1], return_counts=True)
                        out.append(pd.DataFrame({"seed": clique.seed, "prefix": k, "hits": hits, "n": n}))
                if out:
                    yield pd.concat(out)
        return rows.select("symbols").mapInPandas(count, schema)

    histogram = (_over_slices(large_cliques(cliques), run, schema)
                 .groupBy("seed", "prefix", "hits").agg(F.sum("n").alias("n")))
    smaller = f"nullif(least({n_rows} - above[c], above[c]), 0)"
    above = (histogram.groupBy("seed", "prefix").agg(F.collect_list(F.struct("hits", "n")).alias("h"))
             .withColumn("above", F.expr("transform(sequence(0, prefix), c -> "
                                         "aggregate(h, 0L, (s, x) -> s + IF(x.hits > c, x.n, 0L)))")))
    options = F.expr(
        f"filter(transform(sequence({max(1, min_cutoff)}, prefix - 1), c -> named_struct('drop_off', "
        f"(above[c - 1] - above[c + 1]) / {smaller}, 'prefix', -prefix, 'cutoff', -c)), x -> x.drop_off IS NOT NULL)")
    best = above.groupBy("seed").agg(F.min(F.array_min(options)).alias("b"))
    return best.select("seed", F.coalesce("b.drop_off", F.lit(NO_DROP)).alias("drop_off"),
                       F.coalesce(-F.col("b.prefix"), F.lit(0)).alias("size"),
                       F.coalesce(-F.col("b.cutoff"), F.lit(max(1, min_cutoff))).alias("cutoff"))


def chance_cutoff(above: DataFrame, n_rows: int, n_true: int = 30) -> DataFrame:
    """Cutoff from the binomial model of true and chance hits."""
    return above.withColumn("best_cutoff", stats.best_cutoff(n_true, F.lit(n_rows), F.col("size")))


def correlation_cutoff(above: DataFrame, coverage: DataFrame, sizes: DataFrame, start: str = "best_cutoff") -> DataFrame:
    """Cutoff whose row set is most significant against the seed group, not below ``start``."""
    seed_size = sizes.select((F.col("col") * N_SYMBOLS + F.col("sym")).alias("seed"), F.col("size").alias("seed_rows"), "col")
    with_cov = seed_size.join(coverage, "col").select("seed", "seed_rows", "cov")
    per_cut = (above.join(with_cov, "seed")
               .select("seed", "seed_rows", "cov", start,
                       F.posexplode(F.arrays_zip("above", "above_cov", "above_seed")).alias("cutoff", "v"))
               .where(F.col("cutoff") >= F.col(start)))
    c = F.col
    z = stats.significance(c("v.above_seed"), c("v.above_cov"), c("seed_rows"), c("cov"), c("v.above"), c("seed_rows"),
                           base=stats.CLIQUE_BASE)
    best = per_cut.select("seed", "cutoff", z.alias("z")).groupBy("seed").agg(
        F.max("z").alias("z"), F.max_by("cutoff", F.struct("z", -F.col("cutoff"))).alias("cutoff"))
    return best.select("seed", F.when(F.col("z") > 0, F.col("cutoff")).otherwise(F.lit(0)).alias("cutoff"), "z")


def core_cutoff(above: DataFrame, sizes: DataFrame) -> DataFrame:
    """Lowest cutoff leaving at most a size-dependent share of the seed group's row count."""
    share = F.lit(CORE_SHARES[-1][1])
    for limit, p in reversed(CORE_SHARES[:-1]):
        share = F.when(F.col("seed_rows") < limit, p).otherwise(share)
    seed_size = sizes.select((F.col("col") * N_SYMBOLS + F.col("sym")).alias("seed"), F.col("size").alias("seed_rows"))
    return (above.join(seed_size, "seed").withColumn("target", F.floor(share * F.col("seed_rows")))
            .withColumn("cutoff", F.expr("coalesce(array_min(filter(transform(above, (n, c) -> IF(n <= target, c, NULL)), "
                                         "x -> x IS NOT NULL)), cast(size as int))"))
            .select("seed", "target", "cutoff", F.expr("coalesce(get(above, cutoff), 0L)").alias("n_rows")))


def clique_rows(rows: DataFrame, width: int, cliques: DataFrame, cutoffs: DataFrame, coverage: bool = False) -> DataFrame:
    """Row sets ``(seed, row_id)``: rows in (or covering, with ``coverage``) more than ``cutoff`` members."""
    limits = cliques.join(cutoffs.select("seed", "cutoff"), "seed")
    schema = "seed BIGINT, row_id BIGINT"
    cut = {r["seed"]: r["cutoff"] for r in limits.select("seed", "cutoff").distinct().collect()}

    def run(chunk: list[_Clique]) -> DataFrame:
        def select(batches):
            for batch in batches:
                codes = pairs.encode(batch["symbols"], width)
                ids = batch["row_id"].to_numpy()
                for clique in chunk:
                    count = clique.covered(codes) if coverage else clique.hits(codes)
                    yield pd.DataFrame({"row_id": ids[count > cut[clique.seed]]}).assign(seed=clique.seed)
        return rows.select("row_id", "symbols").mapInPandas(select, schema)

    return _over_slices(limits, run, schema)


def membership_bits(rows: DataFrame, width: int, cliques: DataFrame, ordered: DataFrame) -> DataFrame:
    """Row membership in refined groups as a string of 0/1 in the order of ``ordered.position``.

    ``ordered(seed, cutoff, position)`` is one row per refined group.
    """
    order = [(r["seed"], r["cutoff"]) for r in ordered.orderBy("position").collect()]
    members = {q.seed: q for chunk in _slices(cliques.join(ordered.select("seed"), "seed", "left_semi")) for q in chunk}

    def mark(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = pairs.encode(batch["symbols"], width)
            bits = np.empty((len(batch), len(order)), dtype=np.uint8)
            for pos, (seed, cutoff) in enumerate(order):
                bits[:, pos] = members[seed].hits(codes) > cutoff
            text = (bits + ord("0")).astype(np.uint8)
            yield batch[["row_id"]].assign(bits=[bytes(r).decode("ascii") for r in text])

    return rows.select("row_id", "symbols").mapInPandas(mark, "row_id BIGINT, bits STRING")


def refine(rows: DataFrame, width: int, n_rows: int, cliques: DataFrame) -> DataFrame:
    """Refined groups: drop-off cutoff per clique and the number of rows it selects."""
    kept = large_cliques(cliques)
    found = dropoff(rows_above(hit_histogram(rows, width, kept), kept), n_rows)
    return found.select("seed", "size", "cutoff", "drop_off",
                        F.expr("coalesce(get(above, cutoff), 0L)").alias("n_rows"))


def group_precision(members: DataFrame, n_rows: int, block: int = 30) -> DataFrame:
    """Majority and minority rows over consecutive blocks that should be all in or all out."""
    full = n_rows // block
    inside = (members.where(F.col("row_id") < full * block)
              .groupBy("seed", F.expr(f"row_id div {block}").alias("b")).agg(F.count("*").alias("n")))
    untouched = F.lit(full) - F.count("*")
    return (inside.groupBy("seed").agg(
        (F.sum(F.greatest(F.col("n"), block - F.col("n"))) + untouched * block).alias("majority"),
        F.sum(F.least(F.col("n"), block - F.col("n"))).alias("minority")))
