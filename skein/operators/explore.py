"""Exploratory operators on groups: containment, intersections, conflicts, greedy cliques.

All of them start from the blocked pair counts; loops run over groups, each step one small job on a
table sized by the number of groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import stats
from skein.functions.ordinal import with_ordinal
from skein.operators import matrix, pairs
from skein.schema import N_SYMBOLS, group_id
from skein.session import cut_lineage


def directed_pairs(group_pair_rows: DataFrame) -> DataFrame:
    """Both directions with the counts turned round: ``a, b, k, a_in_b, b_in_a, cov``.

    ``a_in_b`` are the rows of group a that cover the column of b.
    """
    gi, gj = group_id(F.col("ci"), F.col("si")), group_id(F.col("cj"), F.col("sj"))
    sides = F.array(
        F.struct(gi.alias("a"), gj.alias("b"), F.col("g1").alias("a_in_b"), F.col("g2").alias("b_in_a")),
        F.struct(gj.alias("a"), gi.alias("b"), F.col("g2").alias("a_in_b"), F.col("g1").alias("b_in_a")))
    return group_pair_rows.select("k", "cov", F.explode(sides).alias("s")).select("s.*", "k", "cov")


def approximate_containment(directed: DataFrame, tolerance: int) -> DataFrame:
    """Pairs where the smaller group a lies in b up to ``tolerance`` rows."""
    return directed.where((F.col("a_in_b") < F.col("b_in_a")) & (F.col("k") + tolerance > F.col("a_in_b")))


def containment_chains(directed: DataFrame, contained: DataFrame, sizes: DataFrame, coverage: DataFrame,
                       max_inner: int, max_outer: int) -> DataFrame:
    """Chains a < b < c of contained groups where a is not contained in c but shares a third with it.

    Coverage of a must lie inside that of b, of c inside that of a, and of b inside that of c.
    """
    size = sizes.select(group_id(F.col("col"), F.col("sym")).alias("g"), "col", F.col("size"))
    known = size.join(coverage, "col").select("g", "size", F.col("cov").alias("col_cov"))
    inner = known.where(F.col("size") < max_inner)
    outer = known.where(F.col("size") < max_outer)
    ab = (contained.join(inner.withColumnsRenamed({"g": "a", "size": "size_a", "col_cov": "cov_a"}), "a")
          .where(F.col("cov") == F.col("cov_a")).select("a", "b", "size_a", "cov_a"))
    bc = (contained.select(F.col("a").alias("b"), F.col("b").alias("c"), "cov")
          .join(inner.withColumnsRenamed({"g": "b", "size": "size_b", "col_cov": "cov_b"}), "b")
          .join(outer.select(F.col("g").alias("c"), F.col("size").alias("size_c"), F.col("col_cov").alias("cov_c")), "c")
          .where(F.col("cov") == F.col("cov_b")).select("b", "c", "size_b", "size_c", "cov_c"))
    ac = directed.select("a", F.col("b").alias("c"), F.col("k").alias("k_ac"), F.col("cov").alias("cov_ac"))
    direct = contained.select("a", F.col("b").alias("c"))
    return (ab.join(bc, "b").join(ac, ["a", "c"])
            .where((F.col("cov_ac") == F.col("cov_c")) & (F.col("k_ac") * 3 > F.col("size_a")))
            .join(direct, ["a", "c"], "left_anti").select("a", "b", "c", "size_a", "size_b", "size_c"))


def intersect_pairs(group_pair_rows: DataFrame, sizes: DataFrame, significant: DataFrame, min_cov: int) -> DataFrame:
    """Significant groups at least a column apart whose intersection is large but under half of either."""
    sized = pairs.with_sizes(group_pair_rows, sizes)
    keep = significant.select("g")
    return (sized.select(group_id(F.col("ci"), F.col("si")).alias("a"), group_id(F.col("cj"), F.col("sj")).alias("b"),
                         "k", "size_i", "size_j")
            .where((F.col("k") > min_cov // 2) & (F.col("size_i") > 2 * F.col("k")) & (F.col("size_j") > 2 * F.col("k")))
            .join(keep.withColumnRenamed("g", "a"), "a", "left_semi")
            .join(keep.withColumnRenamed("g", "b"), "b", "left_semi").select("a", "b", "k"))


def set_comparison(sized_pairs: DataFrame, n_rows: int) -> DataFrame:
    """Set algebra of two groups from counts: intersection, differences, union and agreeing rows."""
    k, a, b = F.col("k"), F.col("size_i"), F.col("size_j")
    return sized_pairs.select(
        group_id(F.col("ci"), F.col("si")).alias("a"), group_id(F.col("cj"), F.col("sj")).alias("b"),
        k.alias("shared"), (a - k).alias("only_a"), (b - k).alias("only_b"), (a + b - k).alias("either"),
        (F.lit(n_rows) - a - b + 2 * k).alias("agreeing"))


MOST_AT_ONCE = 2048  # groups whose pairs a task counts in one matrix


def overlaps(members: DataFrame, groups: int) -> DataFrame:
    """(ci, cj, shared) of the groups ``members(row_id, col)`` that meet in a row, by inverted lists.

    Only groups in a row's list can meet there. Lists are cut into stretches of ``MOST_AT_ONCE`` groups, and a task sums the products of a pair
    of stretches before it sends them.
    """
    lists = (members.groupBy("row_id", F.expr(f"col div {MOST_AT_ONCE}").alias("b")).agg(F.collect_set("col").alias("cols"))
             .groupBy("row_id").agg(F.collect_list(F.struct("b", "cols")).alias("parts")))

    def run(batches):
        held: dict = {}
        for batch in batches:
            stretches: dict = {}
            for k, parts in enumerate(batch.column(0).to_pylist()):
                for p in parts:
                    stretches.setdefault(p["b"], []).append((k, p["cols"]))
            marks = {}
            for b, found in stretches.items():
                m = np.zeros((batch.num_rows, min(MOST_AT_ONCE, groups - b * MOST_AT_ONCE)), np.float32)
                for k, cols in found:
                    m[k, np.asarray(cols) - b * MOST_AT_ONCE] = 1
                marks[b] = m
            for i in marks:
                for j in marks:
                    if i <= j:
                        held[i, j] = held.get((i, j), 0) + (marks[i].T @ marks[j]).astype(np.int64)
            if len(held) > 8:
                yield from counted(held)
                held = {}
        yield from counted(held)

    def counted(held):
        for (i, j), n in held.items():
            a, b = np.nonzero(n)
            ci, cj = a + i * MOST_AT_ONCE, b + j * MOST_AT_ONCE
            keep = ci < cj
            yield pa.RecordBatch.from_arrays([pa.array(ci[keep].astype(np.int32)), pa.array(cj[keep].astype(np.int32)), pa.array(n[a, b][keep])],
                                             ["ci", "cj", "shared"])

    return (lists.select("parts").mapInArrow(run, "ci INT, cj INT, shared BIGINT")
            .groupBy("ci", "cj").agg(F.sum("shared").alias("shared")))


def conflicts(members: DataFrame, min_shared: int) -> DataFrame:
    """Pairs of refined groups sharing fewer than ``min_shared`` rows; pairs that never meet are such pairs too."""
    seeds = members.select("seed").distinct()
    index = cut_lineage(with_ordinal(seeds, F.col("seed"), name="col").select("seed", F.col("col").cast("int").alias("col")))
    m = index.count()
    met = overlaps(members.join(matrix.sent(index), "seed").select("row_id", "col"), m)
    every = members.sparkSession.range(m).select(F.col("id").cast("int").alias("ci")).select(
        "ci", F.explode(F.sequence(F.col("ci") + 1, F.greatest(F.lit(m - 1), F.col("ci") + 1))).alias("cj")).where(F.col("cj") < m)
    shared = F.coalesce("shared", F.lit(0)).alias("shared")
    first, second = index.withColumnsRenamed({"col": "ci", "seed": "a"}), index.withColumnsRenamed({"col": "cj", "seed": "b"})
    return (every.join(met, ["ci", "cj"], "left").select("ci", "cj", shared).where(F.col("shared") < min_shared)
            .join(matrix.sent(first), "ci").join(matrix.sent(second), "cj").select("a", "b", "shared"))


def intersections(members: DataFrame, with_seeds: DataFrame) -> DataFrame:
    """Rows of every refined group that also lie in a group of ``with_seeds``."""
    inside = members.join(matrix.sent(with_seeds), "seed", "left_semi").select("row_id").distinct()
    return members.join(inside, "row_id", "left_semi")


def compatible_groups(members: DataFrame, conflict_pairs: DataFrame) -> DataFrame:
    """Groups left after removing the one with most conflicts until all have equally many.

    Of equally bad groups the lowest id goes first.
    """
    edges = cut_lineage(conflict_pairs.select(F.explode(F.array(
        F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b"))
    left = cut_lineage(members.select("seed").distinct())
    while True:
        counted = cut_lineage(left.join(
            edges.join(left.select(F.col("seed").alias("b")), "b", "left_semi").groupBy("a").agg(F.count("*").alias("n"))
            .withColumnRenamed("a", "seed"), "seed", "left").select("seed", F.coalesce("n", F.lit(0)).alias("n")))
        worst = counted.agg(F.min("n").alias("least"), F.max(F.struct(F.col("n"), -F.col("seed"))).alias("w")).first()
        if worst["w"] is None or worst["least"] == worst["w"]["n"]:
            return counted.select("seed", F.col("n").alias("conflicts"))
        left = cut_lineage(left.where(F.col("seed") != -worst["w"][1]))


def narrowed_groups(members: DataFrame, row_id: int, rounds: int = 5, min_rows: int = 10) -> DataFrame:
    """Refined groups holding one row, intersected one after the other while enough rows stay.

    Groups are taken by size, largest first; a group that would leave ``min_rows`` or fewer is skipped.
    """
    mine = members.where(F.col("row_id") == row_id).select("seed")
    held = cut_lineage(members.join(mine, "seed", "left_semi"))
    order = held.groupBy("seed").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "seed").limit(rounds).collect()
    current = None
    for r in order:
        rows = held.where(F.col("seed") == r["seed"]).select("row_id")
        narrowed = rows if current is None else current.join(rows, "row_id", "left_semi")
        if narrowed.count() > min_rows:
            current = cut_lineage(narrowed)
    return current if current is not None else held.select("row_id").limit(0)


def greedy_mean_clique(both_ways: DataFrame, seed: int, max_clique: int, cutoff: float) -> list[int]:
    """Grow a clique by the group with the best mean significance to all members so far."""
    members = [seed]
    while len(members) < max_clique:
        best = (both_ways.where(F.col("g").isin(members) & ~F.col("partner").isin(members))
                .groupBy("partner").agg((F.sum("z") / len(members)).alias("mean"))
                .where(F.col("mean") > cutoff).orderBy(F.desc("mean"), "partner").first())
        if best is None:
            break
        members.append(best["partner"])
    return members


def greedy_group_clique(cells: DataFrame, seed: int, max_clique: int, cutoff: float, n_rows: int, min_cov: int,
                        max_rows: int | None = None) -> list[int]:
    """Grow a clique by the group most significant against the rows currently selected by it.

    Selected are the rows in more than c members, c from the binomial cutoff model; their universe are
    the rows covering more than c member columns.
    """
    ids = cells.select("row_id", "col", group_id(F.col("col"), F.col("sym")).alias("g"))
    sizes = ids.groupBy("g").agg(F.count("*").alias("size"))
    members = [seed]
    while len(members) < max_clique:
        v = len(members)
        gain = stats.binomial_upper(range(v), v, 0.70) / [max(n_rows * p, 1.0) for p in stats.binomial_upper(range(v), v, 0.05)]
        c = int(gain.argmax()) if v > 1 else 0
        columns = [g // N_SYMBOLS for g in members]
        hits = F.count_if(F.col("g").isin(members))
        weight = sum((F.when(F.col("col") == col, 1).otherwise(0) for col in columns), F.lit(0))
        held = cut_lineage(ids.groupBy("row_id").agg(hits.alias("hits"), F.sum(weight).alias("covers"))
                           .where(F.col("covers") > c).select("row_id", (F.col("hits") > c).alias("held")))
        inside = ids.where(~F.col("g").isin(members)).join(held, "row_id")
        by_column = inside.groupBy("col").agg(F.count("*").alias("cov"), F.count_if("held").alias("g2"))
        by_group = inside.groupBy("g", "col").agg(F.count("*").alias("g1"), F.count_if("held").alias("k"))
        total = held.where("held").count()
        z = stats.significance(F.col("k"), F.col("g1"), F.col("g2"), F.col("cov"), F.col("size"), F.lit(total),
                               base=stats.CLIQUE_BASE)
        small = F.lit(True) if max_rows is None else F.col("g1") < max_rows
        best = (by_group.where((F.col("k") > min_cov // 4) & small).join(by_column, "col").join(sizes, "g")
                .select("g", z.alias("z")).where(F.col("z") > cutoff).orderBy(F.desc("z"), "g").first())
        if best is None:
            break
        members.append(best["g"])
    return members


def best_assignment(shares: DataFrame) -> DataFrame:
    """Greedy one-to-one assignment ``(i, j, p)`` of clusters by the largest remaining share, lower ids on ties.

    Taking the largest share again and again takes, sooner or later, every pair that is the largest of both its
    sides; so all such pairs are taken at once, and rounds go on with the clusters that are left.
    """
    left = cut_lineage(shares.select("i", "j", "p"))
    out = left.limit(0)
    best = F.max(F.struct("p", -F.col("i"), -F.col("j")))
    while not left.isEmpty():
        of_i, of_j = left.groupBy("i").agg(best.alias("b")), left.groupBy("j").agg(best.alias("b"))
        taken = cut_lineage(of_i.join(of_j.select("j", F.col("b").alias("c")), F.col("b") == F.col("c"))
                            .select("i", "j", F.col("b")["p"].alias("p")))
        out = out.unionByName(taken)
        left = cut_lineage(left.join(taken.select("i"), "i", "left_anti").join(taken.select("j"), "j", "left_anti").select("i", "j", "p"))
    return out


def best_two_column_moves(rows: DataFrame) -> DataFrame:
    """For neighbouring columns c and c+1, on which side lone bases of each kind should stand.

    Rows with one base and one gap are free to move; all other rows are the background. Per column
    pair the best of the 16 assignments: ``left_a .. left_t`` is 1 where the base belongs left.
    """
    neighbours = F.expr("transform(sequence(0, length(symbols) - 2), i -> named_struct('col', i, "
                        "'l', get(chars, i), 'r', get(chars, i + 1)))")
    two = (rows.select(F.split("symbols", "").alias("chars"), "symbols").where(F.length("symbols") > 1)
           .select(F.explode(neighbours).alias("p")).select("p.*"))
    l, r = F.col("l"), F.col("r")
    lone = [((l == b) & (r == "-")) | ((l == "-") & (r == b)) for b in "acgt"]
    free = lone[0] | lone[1] | lone[2] | lone[3]
    counts = [F.count_if(x).alias(f"free{i}") for i, x in enumerate(lone)]
    for side, ch in (("l", l), ("r", r)):
        counts += [F.count_if(~free & (ch != b) & (ch != " ")).alias(f"{side}{i}") for i, b in enumerate("acgt-")]
    c = two.groupBy("col").agg(*counts)
    options = []
    for choice in range(16):
        left = [choice >> (3 - i) & 1 for i in range(4)]
        score = F.lit(0).cast("bigint")
        for i in range(4):
            here, there = ("l", "r") if left[i] else ("r", "l")
            score = score + (F.col(f"{here}{i}") + F.col(f"{there}4")) * F.col(f"free{i}")
            for j in range(i + 1, 4):
                score = score + F.col(f"free{i}") * F.col(f"free{j}") * (2 if left[i] != left[j] else 1)
        options.append(F.struct(score.alias("score"), F.lit(choice).alias("choice")))
    best = c.select("col", F.least(*options).alias("m"))
    return best.select("col", "m.score", *[F.expr(f"shiftright(m.choice, {3 - i}) & 1").alias(f"left_{b}") for i, b in enumerate("acgt")])
