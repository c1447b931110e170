"""Best co-occurrence significance of every (column, symbol) group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.stats import significance_cutoff
from skein.operators import matrix, pairs
from skein.schema import N_SYMBOLS, group_id


def tested_pairs(rows: DataFrame, width: int, n_rows: int, min_cov: int = 30, min_gap: int = 20,
                 base_dominated: bool = True, stop_at_first_gap: bool = False) -> DataFrame:
    """Significance of all eligible group pairs.

    Both groups must be eligible by size, the left column must be dominated by bases unless
    ``base_dominated`` is off. With ``stop_at_first_gap`` nothing right of the first column
    sharing fewer than ``min_cov`` rows is tested, otherwise only such columns are skipped.
    """
    cells = matrix.to_cells(rows)
    sizes = matrix.eligible_groups(matrix.group_sizes(cells), n_rows, min_cov)
    by_column = pairs.column_pairs(rows, width, min_gap)
    if stop_at_first_gap:
        by_column = pairs.contiguous_overlap(by_column, min_cov, min_gap)
    else:
        by_column = by_column.where(F.col("n55") >= min_cov)
    if base_dominated:
        left = matrix.base_dominated_columns(matrix.column_counts(cells)).select(F.col("col").alias("ci"))
        by_column = by_column.join(left, "ci", "left_semi")
    return pairs.pair_significance(pairs.with_sizes(pairs.group_pairs(by_column), sizes))


def all_groups(spark, width: int) -> DataFrame:
    """Every group id of a matrix."""
    return spark.range(width * N_SYMBOLS).select(F.col("id").alias("g"))


def of_all_groups(best: DataFrame, width: int) -> DataFrame:
    """(g, z) of every group, 0 for those not in ``best``."""
    return (all_groups(best.sparkSession, width).join(best.select("g", "z"), "g", "left")
            .select("g", F.coalesce("z", F.lit(0.0)).alias("z")))


def max_correlation(tested: DataFrame, width: int) -> DataFrame:
    """Maximum significance per group over both pair sides of pairs at hand; :func:`partners.strongest` finds it without them."""
    return of_all_groups(pairs.both_directions(tested, "z").groupBy("g").agg(F.max("z").alias("z")), width)


def distant_pairs(tested: DataFrame, distance: int = 100) -> DataFrame:
    """Pairs whose group ids lie more than ``distance`` apart."""
    return tested.where(F.abs(group_id(F.col("cj"), F.col("sj")) - group_id(F.col("ci"), F.col("si"))) > distance)


def significant_partners(tested: DataFrame, cutoff: float) -> DataFrame:
    """Number of partners above the cutoff per group having any."""
    return (pairs.both_directions(tested.where(F.col("z") > cutoff), "z")
            .groupBy("g").agg(F.count("*").alias("partners")))


def drop_lonely_groups(max_z: DataFrame, partners: DataFrame, min_partners: int = 5) -> DataFrame:
    """Zero the significance of groups with fewer than ``min_partners`` significant partners."""
    return (max_z.join(partners, "g", "left")
            .select("g", F.when(F.coalesce("partners", F.lit(0)) >= min_partners, F.col("z"))
                    .otherwise(F.lit(0.0)).alias("z")))


def partner_histogram(counted: DataFrame, width: int, buckets: int = 50) -> DataFrame:
    """How many groups have 0, 1, ... significant partners ``counted(g, partners)``, the last bucket open."""
    n = F.least(F.coalesce("partners", F.lit(0)), F.lit(buckets - 1)).alias("partners")
    return (all_groups(counted.sparkSession, width).join(counted.select("g", "partners"), "g", "left")
            .groupBy(n).agg(F.count("*").alias("groups")))


def window_correlations(max_z: DataFrame, first: int, last: int) -> DataFrame:
    """Slice a max-correlation vector to a column window and rebase the ids."""
    return (max_z.where(F.col("g").between(first * N_SYMBOLS, last * N_SYMBOLS + N_SYMBOLS - 1))
            .select((F.col("g") - first * N_SYMBOLS).alias("g"), "z"))


def mask_thin_columns(max_z: DataFrame, cells: DataFrame) -> DataFrame:
    """Zero groups whose column has under 90 percent of the best coverage."""
    kept = matrix.well_covered_columns(matrix.column_coverage(cells)).select("col", F.lit(True).alias("ok"))
    return (max_z.withColumn("col", (F.col("g") / N_SYMBOLS).cast("int")).join(kept, "col", "left")
            .select("g", F.when(F.col("ok"), F.col("z")).otherwise(F.lit(0.0)).alias("z")))


def column_max(max_z: DataFrame) -> DataFrame:
    """Best significance per column."""
    return max_z.groupBy((F.col("g") / N_SYMBOLS).cast("int").alias("col")).agg(F.max("z").alias("z"))


def seed_groups(max_z: DataFrame, cutoff: float | None = None, width: int | None = None) -> DataFrame:
    """Groups above the significance cutoff (default: one expected chance hit)."""
    limit = significance_cutoff(width) if cutoff is None or cutoff < 0.1 else cutoff
    return max_z.where(F.col("z") > limit)


def snowball(tested: DataFrame, sizes: DataFrame, n_rows: int, width: int, cutoff: float, fraction: int = 4) -> DataFrame:
    """Max correlations found by walking from large groups along significant pairs.

    A frontier of newly reached groups is joined with the significant pairs until no new group
    turns up, so every group connected to a starting group gets its exact maximum.
    """
    from skein.session import cut_lineage

    edges = cut_lineage(pairs.both_directions(tested.where(F.col("z") > cutoff), "z"))
    start = (sizes.where((F.col("size") > n_rows // fraction) & (F.col("size") < n_rows - n_rows // fraction))
             .select(group_id(F.col("col"), F.col("sym")).alias("g")))
    reached = frontier = cut_lineage(start)
    while not frontier.isEmpty():
        found = edges.join(frontier, "g", "left_semi").select(F.col("partner").alias("g")).distinct()
        frontier = cut_lineage(found.join(reached, "g", "left_anti"))
        reached = reached.unionByName(frontier)
    best = edges.join(reached, "g", "left_semi").groupBy("g").agg(F.max("z").alias("z"))
    return (all_groups(tested.sparkSession, width).join(best, "g", "left")
            .select("g", F.coalesce("z", F.lit(0.0)).alias("z")))
