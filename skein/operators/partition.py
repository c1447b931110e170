"""Recursive partitioning of rows by refined groups.

Labels are ``label BIGINT`` per row, NULL outside the window. Steps that split a cluster depend on
that cluster alone, so all clusters advance together, one Spark job per depth of the recursion.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import stats
from skein.functions.ordinal import with_ordinal
from skein.operators import cliques as clique_ops
from skein.operators import matrix, neighbours, pairs
from skein.schema import N_SYMBOLS, SYMBOLS, group_id
from skein.session import cut_lineage

MAX_DROP = 1e-4        # fixed: a refined group splits only below this drop-off
MIN_ID_DISTANCE = 100  # fixed: variables must correlate this many group ids apart
SENT_CLUSTERS = 100_000  # tables with a row per cluster are sent to the tasks up to this size


# --- label vectors ----------------------------------------------------------

def per_cluster(table: DataFrame) -> DataFrame:
    """A table with one row per cluster, sent to the tasks if small: joined by label, a few large clusters would be as few tasks."""
    return matrix.sent(table, SENT_CLUSTERS)


def compress_labels(labelled: DataFrame) -> DataFrame:
    """Rename labels to 0, 1, ... by first appearance in row order; NULL stays NULL."""
    labelled = cut_lineage(labelled)  # read twice
    first = labelled.where(F.col("label").isNotNull()).groupBy("label").agg(F.min("row_id").alias("first_row"))
    names = per_cluster(with_ordinal(first, F.col("first_row"), name="new_label").select("label", "new_label"))
    return (labelled.join(names, "label", "left")
            .select(*[c for c in labelled.columns if c != "label"], F.col("new_label").alias("label")))


def complete_labels(all_rows: DataFrame, labelled: DataFrame) -> DataFrame:
    """Labels of window rows back onto all rows; the others get NULL."""
    return all_rows.select("row_id").join(labelled.select("row_id", "label"), "row_id", "left")


def cluster_sizes(labelled: DataFrame) -> DataFrame:
    return labelled.where(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("size"))


def split_counts(labelled: DataFrame, members: DataFrame) -> DataFrame:
    """Rows of every cluster inside and outside every refined group."""
    sizes = cluster_sizes(labelled)
    inside = (labelled.where(F.col("label").isNotNull()).join(members, "row_id")
              .groupBy("label", "seed").agg(F.count("*").alias("inside")))
    return inside.join(sizes, "label").select("label", "seed", "inside", (F.col("size") - F.col("inside")).alias("outside"))


def splittable(counts: DataFrame, min_group: int) -> DataFrame:
    return counts.where((F.col("inside") > min_group) & (F.col("outside") > min_group))


# --- drop-off subdivision ---------------------------------------------------

def split_order(refined: DataFrame, max_z: DataFrame, max_drop: float | None = MAX_DROP) -> DataFrame:
    """Refined groups in splitting order: drop-off, then larger cliques, then stronger seeds."""
    kept = refined if max_drop is None else refined.where(F.col("drop_off") < max_drop)
    w = Window.orderBy("drop_off", F.desc("size"), F.desc("z"), "seed")  # one row per group, not per matrix row
    return (kept.join(max_z.withColumnRenamed("g", "seed"), "seed")
            .withColumn("position", F.row_number().over(w) - 1).select("position", "seed", "cutoff"))


AT_ONCE = 1 << 25  # bits of a cluster that one task splits to the end


def _rows_inside(n: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Rows with a bit set, by position; a few thousand lines are widened at once."""
    return sum((n[k:k + 4096] @ bits[k:k + 4096].astype(np.float64) for k in range(0, len(n), 4096)), np.zeros(bits.shape[1]))


def _split_up(bits: np.ndarray, n: np.ndarray, path: str, start: int, min_group: int) -> list[str]:
    """Final paths of the rows of one cluster."""
    out, left = [path] * len(n), [(np.arange(len(n)), bits[:, start:], path, start)]
    while left:
        at, own, path, start = left.pop()
        inside = _rows_inside(n[at], own)
        splits = np.flatnonzero((inside > min_group) & (n[at].sum() - inside > min_group))
        if len(splits):
            p = int(splits[0])
            for side in (0, 1):
                here = own[:, p] == side
                left.append((at[here], own[here, p + 1:], path + str(side), start + p + 1))
        else:
            for k in at:
                out[k] = path
    return out


def _in_task(min_group: int):
    """Clusters sorted by path, each split to the end."""
    def run(batches):
        key, held = None, []

        def settled():
            rows = [r for part in held for r in part]
            bits = np.frombuffer("".join(r[0] for r in rows).encode(), np.uint8).reshape(len(rows), -1) - ord("0")
            paths = _split_up(bits, np.array([r[1] for r in rows], np.float64), *key, min_group)
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array(paths, pa.string())], ["bits", "path"])
        for batch in batches:
            bits, n, path, start = (batch.column(c).to_pylist() for c in ("bits", "n", "path", "start"))
            cuts = [0, *(k for k in range(1, len(path)) if path[k] != path[k - 1]), len(path)] if path else []
            for lo, hi in zip(cuts, cuts[1:]):
                if held and (path[lo], start[lo]) != key:
                    yield settled()
                    held = []
                key = path[lo], start[lo]
                held.append(list(zip(bits[lo:hi], n[lo:hi])))
        if held:
            yield settled()
    return run


def _counted(batches):
    """Rows of a task by path and position, in all and with the bit set."""
    found: dict = {}
    for batch in batches:
        paths, at = np.unique(batch.column("path").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
        bits = np.frombuffer("".join(batch.column("bits").to_pylist()).encode(), np.uint8).reshape(batch.num_rows, -1) == ord("1")
        n, start = batch.column("n").to_numpy(), batch.column("start").to_numpy()
        for k, path in enumerate(paths.tolist()):
            here = at == k
            total, inside, _ = found.get(path, (0, 0, 0))
            found[path] = total + int(n[here].sum()), inside + n[here].astype(np.float64) @ bits[here], int(start[here][0])
    for path, (total, inside, start) in found.items():
        pos = np.arange(start, len(inside))
        yield pa.RecordBatch.from_arrays([pa.array([path] * len(pos), pa.string()), pa.array(pos, pa.int32()), pa.array(np.full(len(pos), total, np.int64)),
                                          pa.array(inside[start:].astype(np.int64))], ["path", "pos", "total", "inside"])


def subdivide_by_bits(bits: DataFrame, min_group: int, at_once: int = AT_ONCE) -> DataFrame:
    """Split clusters by membership bits, bit by bit in order, where both sides exceed ``min_group``.

    Rows with equal bits stay together, so they are counted once. A cluster of at most ``at_once`` bits is split to the end in
    a task, because its splits depend on it alone. For larger ones every round takes the first later bit that splits them.
    """
    state = cut_lineage(bits.groupBy("bits").agg(F.count("*").alias("n")).select("bits", "n", F.lit("r").alias("path"), F.lit(0).alias("start")))
    width = state.agg(F.max(F.length("bits"))).first()[0]
    if not width:
        return bits.select("row_id", F.lit("r").alias("label"))
    done = None
    while True:
        sizes = state.groupBy("path").agg((F.count("*") * width).alias("_bits"))
        small = sizes.where(F.col("_bits") <= at_once).select("path")
        ended = (state.join(small, "path", "left_semi").repartition("path").sortWithinPartitions("path")
                 .mapInArrow(_in_task(min_group), "bits string, path string"))
        large = state.join(small, "path", "left_anti")
        chosen = cut_lineage(
            large.mapInArrow(_counted, "path string, pos int, total bigint, inside bigint")
            .groupBy("path", "pos").agg(F.sum("total").alias("total"), F.sum("inside").alias("inside"))
            .where((F.col("inside") > min_group) & (F.col("total") - F.col("inside") > min_group))
            .groupBy("path").agg(F.min("pos").alias("pos")))
        ended = ended.unionByName(large.join(chosen, "path", "left_anti").select("bits", "path"))
        ended = cut_lineage(ended)
        done = ended if done is None else done.unionByName(ended)
        if chosen.isEmpty():
            break
        state = cut_lineage(large.join(chosen, "path").select(
            "bits", "n", F.concat("path", F.expr("substring(bits, pos + 1, 1)")).alias("path"), (F.col("pos") + 1).alias("start")))
    return bits.join(done, "bits").select("row_id", F.col("path").alias("label"))


def dropoff_subdivision(rows: DataFrame, width: int, cliques: DataFrame, refined: DataFrame, max_z: DataFrame,
                        min_group: int, max_drop: float | None = MAX_DROP) -> DataFrame:
    """Successive splits by refined groups; ``max_drop=None`` uses all of them."""
    order = split_order(refined, max_z, max_drop)
    bits = cut_lineage(clique_ops.membership_bits(rows, width, cliques, order))
    return compress_labels(subdivide_by_bits(bits, min_group))


# --- relative subdivision ---------------------------------------------------

def hits_of(members: str = "members") -> Column:
    """Number of clique members a wide row carries, in the JVM."""
    return F.expr(f"size(filter({members}, m -> substring(symbols, cast(m div {N_SYMBOLS} as int) + 1, 1) = "
                  f"substring('{SYMBOLS}', cast(m % {N_SYMBOLS} as int) + 1, 1)))")


def large_clusters(labelled: DataFrame, min_group: int) -> DataFrame:
    """(label, size) of the clusters larger than twice ``min_group``."""
    return per_cluster(cluster_sizes(labelled).where(F.col("size") > 2 * min_group))


def dropoff_inside(inside: DataFrame, width: int, cliques: DataFrame, sizes: DataFrame, n_rows: int) -> DataFrame:
    """Drop-off cutoffs of all cliques inside every cluster of ``sizes(label, size)``; ``inside(label, symbols)`` are its rows."""
    kept = clique_ops.large_cliques(cliques)
    above = clique_ops.rows_above(clique_ops.hit_histogram(inside, width, kept, by="label"), kept, by="label")
    return (clique_ops.dropoff(above, n_rows).join(sizes.select("label", F.col("size").alias("label_size")), "label")
            .withColumn("inside", F.expr("coalesce(get(above, cutoff), 0L)"))
            .select("label", "seed", "size", "cutoff", "drop_off", "inside", (F.col("label_size") - F.col("inside")).alias("outside")))


def relative_dropoff(rows: DataFrame, width: int, cliques: DataFrame, labelled: DataFrame, n_rows: int,
                     min_group: int) -> DataFrame:
    """Drop-off cutoffs of all cliques inside every cluster larger than twice ``min_group``."""
    sizes = large_clusters(labelled, min_group)
    inside = rows.join(labelled.join(sizes, "label", "left_semi"), "row_id")
    return dropoff_inside(inside, width, cliques, sizes, n_rows)


def relative_subdivision(rows: DataFrame, width: int, cliques: DataFrame, labelled: DataFrame, n_rows: int,
                         min_group: int, max_drop: float = MAX_DROP) -> DataFrame:
    """Split each large cluster by the first clique (in id order) with a sharp cutoff inside it.

    Rows meet their labels once; after that they stay where they are, and only tables with a row per cluster move.
    """
    own = cut_lineage(labelled.select("row_id", "label").join(rows.select("row_id", "symbols"), "row_id", "left"))
    sizes = large_clusters(own, min_group)
    inside = own.where(F.col("symbols").isNotNull()).join(sizes, "label", "left_semi")
    usable = splittable(dropoff_inside(inside, width, cliques, sizes, n_rows), min_group)
    chosen = (usable.where(F.col("drop_off") < max_drop).groupBy("label")
              .agg(F.min(F.struct("seed", "cutoff")).alias("c")).select("label", "c.seed", "c.cutoff"))
    members = cliques.groupBy("seed").agg(F.collect_list("g").alias("members"))
    plan = per_cluster(chosen.join(members, "seed").select("label", "cutoff", "members"))
    side = F.when(F.col("members").isNull(), F.lit("-")).when(hits_of() > F.col("cutoff"), F.lit("1")).otherwise(F.lit("0"))
    split = F.when(F.col("label").isNotNull() & F.col("symbols").isNotNull(), F.concat_ws("/", F.col("label").cast("string"), side))
    return compress_labels(own.join(plan, "label", "left").select("row_id", split.alias("label")))


# --- variables and majority clustering inside clusters ----------------------

def relative_variables(rows: DataFrame, width: int, seeds: DataFrame, labelled: DataFrame, cutoff: float,
                       min_group: int) -> DataFrame:
    """Seed groups that correlate with a distant seed group inside a large cluster."""
    sizes = cluster_sizes(labelled).where(F.col("size") > 2 * min_group)
    inside = rows.join(labelled.join(sizes, "label", "left_semi"), "row_id").select("row_id", "label", "symbols")
    local = (matrix.to_cells(inside).groupBy("label", group_id(F.col("col"), F.col("sym")).alias("g"))
             .agg(F.count("*").alias("rows_in")).where(F.col("rows_in") >= min_group)
             .join(seeds.select("g"), "g", "left_semi"))
    min_gap = max(1, (MIN_ID_DISTANCE - N_SYMBOLS + 1) // N_SYMBOLS)
    counted = pairs.column_pairs(inside, width, min_gap, by=("label",), disjoint=True)
    entries = F.array(*[F.struct(F.lit(a).alias("si"), F.lit(b).alias("sj"), F.col(f"n{a}{b}").alias("k"))
                        for a in range(N_SYMBOLS) for b in range(N_SYMBOLS)])
    both = (counted.select("label", "ci", "cj", F.explode(entries).alias("e"))
            .select("label", group_id(F.col("ci"), F.col("e.si")).alias("gi"), group_id(F.col("cj"), F.col("e.sj")).alias("gj"), "e.k")
            .where(F.col("gj") - F.col("gi") >= MIN_ID_DISTANCE)
            .join(local.select("label", F.col("g").alias("gi"), F.col("rows_in").alias("ni")), ["label", "gi"])
            .join(local.select("label", F.col("g").alias("gj"), F.col("rows_in").alias("nj")), ["label", "gj"])
            .join(sizes, "label"))
    z = stats.two_sided(F.col("k"), F.col("ni"), F.col("nj"), F.col("size"))
    return (both.withColumn("z", z).where(F.col("z") > cutoff)
            .select("label", F.explode(F.array("gi", "gj")).alias("g")).distinct())


def variable_bits(rows: DataFrame, labelled: DataFrame, variables: DataFrame, min_group: int) -> DataFrame:
    """Rows of large clusters as 0/1 strings over the cluster's selected groups."""
    large = cluster_sizes(labelled).where(F.col("size") > 2 * min_group).select("label")
    chosen = large.join(variables.groupBy("label").agg(F.array_sort(F.collect_list("g")).alias("vars")), "label", "left")
    bit = (f"IF(get(chars, cast(m div {N_SYMBOLS} as int)) = substring('{SYMBOLS}', cast(m % {N_SYMBOLS} as int) + 1, 1), '1', '0')")
    return (rows.select("row_id", F.split("symbols", "").alias("chars")).join(labelled, "row_id").join(chosen, "label")
            .select("label", "row_id", F.expr(f"coalesce(array_join(transform(vars, m -> {bit}), ''), '')").alias("bits")))


def majority_subdivision(rows: DataFrame, width: int, seeds: DataFrame, labelled: DataFrame, cutoff: float,
                         min_group: int) -> DataFrame:
    """Cluster the rows of each large cluster by the majority of their nearest rows."""
    labelled = cut_lineage(labelled)
    variables = relative_variables(rows, width, seeds, labelled, cutoff, min_group)
    clusters = neighbours.majority_clusters(variable_bits(rows, labelled, variables, min_group), min_group)
    merged = (labelled.join(clusters.select("row_id", "cluster"), "row_id", "left")
              .select("row_id", F.when(F.col("label").isNotNull(), F.concat_ws(
                  "/", F.col("label").cast("string"), F.coalesce(F.col("cluster").cast("string"), F.lit("-")))).alias("label")))
    return compress_labels(merged)


def repeated_subdivision(rows: DataFrame, width: int, cliques: DataFrame, seeds: DataFrame, labelled: DataFrame,
                         n_rows: int, cutoff: float, min_group: int) -> DataFrame:
    """Relative subdivision until nothing splits any more, then one majority subdivision."""
    current, n_labels = cut_lineage(labelled), cluster_sizes(labelled).count()
    while True:
        finer = cut_lineage(relative_subdivision(rows, width, cliques, current, n_rows, min_group))
        finer_labels = cluster_sizes(finer).count()
        if finer_labels == n_labels:
            return majority_subdivision(rows, width, seeds, current, cutoff, min_group)
        current, n_labels = finer, finer_labels


def block_accuracy(labelled: DataFrame, n_rows: int, block: int = 30) -> DataFrame:
    """Mean share of a label held by the block of consecutive rows it is most frequent in.

    Only full blocks count; the earliest appearing of equally frequent labels is taken.
    """
    totals = cluster_sizes(labelled)
    in_block = (labelled.where((F.col("row_id") < n_rows // block * block) & F.col("label").isNotNull())
                .groupBy(F.expr(f"row_id div {block}").alias("b"), "label")
                .agg(F.count("*").alias("n"), F.min("row_id").alias("first_row")))
    modal = in_block.groupBy("b").agg(F.max_by(F.struct("label", "n"), F.struct(F.col("n"), -F.col("first_row"))).alias("m"))
    return (modal.select("m.label", "m.n").join(totals, "label")
            .agg(F.avg(F.col("n") / F.col("size")).alias("accuracy")))
