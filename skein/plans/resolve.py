"""The stages from a matrix to scored clusterings, put together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.stats import significance_cutoff
from skein.operators import cliques, correlate, linkage, matrix, partition, partners
from skein.session import cut_lineage


@dataclass(frozen=True)
class Config:
    """Parameters of correlation and resolution."""

    min_cov: int = 30
    min_gap: int = 20
    threshold: float = 0.0   # significance cutoff, used from 0.1 on; otherwise one expected chance hit
    max_drop: float = partition.MAX_DROP

    @property
    def min_group(self) -> int:
        return self.min_cov // 2

    def cutoff(self, width: int) -> float:
        return self.threshold if self.threshold >= 0.1 else significance_cutoff(width)


def correlate_matrix(rows: DataFrame, config: Config = Config()) -> DataFrame:
    """Maximum significance per group of the whole matrix."""
    width, n_rows = matrix.matrix_width(rows), rows.count()
    best = partners.strongest(rows, width, n_rows, config.min_cov, config.min_gap)
    return cut_lineage(correlate.of_all_groups(best, width))


def resolve_window(rows: DataFrame, max_z: DataFrame | None, first: int, last: int,
                   config: Config = Config()) -> dict[str, DataFrame]:
    """The three successive clusterings of a column window, completed to all rows.

    Without stored correlations they are computed first.
    """
    last = min(last, matrix.matrix_width(rows) - 1)
    if max_z is None:
        max_z = correlate_matrix(rows, config)
    inside = cut_lineage(matrix.window_rows(rows.select("row_id", "symbols"), first, last))
    width, n_rows = last - first + 1, inside.count()
    cutoff = config.cutoff(width)
    cells = matrix.to_cells(inside)
    z = cut_lineage(correlate.mask_thin_columns(correlate.window_correlations(max_z, first, last), cells))
    seeds = correlate.seed_groups(z, cutoff)
    found = cut_lineage(cliques.large_cliques(
        cliques.top_partners(inside, width, matrix.group_sizes(cells), seeds, cutoff, config.min_cov)))
    refined = cut_lineage(cliques.refine(inside, width, n_rows, found))
    kept_seeds = cut_lineage(seeds.join(refined.select(F.col("seed").alias("g")), "g", "left_semi"))
    dropoff = cut_lineage(partition.dropoff_subdivision(inside, width, found, refined, z, config.min_group, config.max_drop))
    relative = cut_lineage(partition.relative_subdivision(inside, width, found, dropoff, n_rows, config.min_group, config.max_drop))
    majority = partition.majority_subdivision(inside, width, kept_seeds, relative, cutoff, config.min_group)
    return {name: partition.complete_labels(rows, labelled)
            for name, labelled in (("Dropoff", dropoff), ("RelDrop", relative), ("Kmeans", majority))}


def assess(truth: DataFrame, clusterings: list[DataFrame], left: DataFrame, right: DataFrame) -> dict[str, DataFrame]:
    """Resolution of every single clustering and of all of them chained between the flanks."""
    out = {f"window_{i}": linkage.mutual_best(linkage.copy_connection(truth, c)) for i, c in enumerate(clusterings)}
    out["chain"] = linkage.mutual_best(linkage.connection([left, *clusterings, right]))
    return out
