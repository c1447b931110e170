"""The categorical matrix: wide and long forms, groups, coverage, consensus, scores, windows.

Wide rows ``(row_id, symbols)`` keep one matrix row per record: everything that looks at one
row at a time needs no shuffle. Long cells ``(row_id, col, sym)`` exist where a column is
aggregated; those aggregates combine on the map side down to a few values per column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.schema import BASES, BLANK, GAP, N_SYMBOLS, check_width, symbol_char, symbol_code
from skein.session import cut_lineage


SENT_COLUMNS = 1_000_000  # tables with a row per column are sent to the tasks up to this size


def sent(per_column: DataFrame, most: int = SENT_COLUMNS) -> DataFrame:
    """A table with one row per column, marked for broadcast if its size allows."""
    small = cut_lineage(per_column)
    return F.broadcast(small) if small.count() <= most else small


# --- shape ------------------------------------------------------------------

def matrix_width(rows: DataFrame) -> int:
    """Number of columns (one scalar from a map-side combined aggregate)."""
    return check_width(rows.agg(F.coalesce(F.max(F.length("symbols")), F.lit(0))).first()[0])


def to_cells(rows: DataFrame) -> DataFrame:
    """Wide to long; blanks vanish, other columns of ``rows`` are carried along."""
    kept = [c for c in rows.columns if c != "symbols"]
    return (rows.select(*kept, F.posexplode(F.split("symbols", "")).alias("col", "ch"))
            .select(*kept, "col", symbol_code(F.col("ch")).alias("sym"))
            .where(F.col("sym").isNotNull()))


def to_rows(cells: DataFrame, width: int, upper: bool = False) -> DataFrame:
    """Long to wide: one shuffle on ``row_id``, the string is put together in the JVM. A cell beyond ``width`` is an error."""
    gap_before = F.expr("transform(cells, (x, i) -> x.col - IF(i = 0, -1, get(cells, i - 1).col) - 1)")
    packed = (cells.groupBy("row_id")
              .agg(F.array_sort(F.collect_list(F.struct("col", "sym"))).alias("cells"))
              .withColumn("gaps", gap_before))
    text = F.array_join(F.zip_with(
        "cells", "gaps", lambda x, g: F.concat(F.repeat(F.lit(BLANK), g), symbol_char(x["sym"], upper))), "")
    beyond = F.element_at("cells", -1)["col"] >= width
    checked = F.when(beyond, F.raise_error(F.lit(f"a cell lies beyond the matrix width {width}"))).otherwise(F.rpad(text, width, BLANK))
    return packed.select("row_id", checked.alias("symbols"))


def same_width_rows(rows: DataFrame, width: int) -> DataFrame:
    """Drop rows that deviate from the matrix width."""
    return rows.where(F.length("symbols") == width)


# --- column slices ----------------------------------------------------------

def _char_at(col: int) -> Column:
    return F.substring("symbols", col + 1, 1)


def window_rows(rows: DataFrame, first: int, last: int) -> DataFrame:
    """Rows with data at both ends of ``[first, last]``, sliced and rebased to column 0."""
    return (rows.where((_char_at(first) != BLANK) & (_char_at(last) != BLANK))
            .withColumn("symbols", F.substring("symbols", first + 1, last - first + 1)))


def rows_outside_window(rows: DataFrame, first: int, last: int) -> DataFrame:
    """The rows :func:`window_rows` leaves out."""
    return rows.where((_char_at(first) == BLANK) | (_char_at(last) == BLANK)).select("row_id")


def slice_columns(cells: DataFrame, first: int, last: int) -> DataFrame:
    """Long-form column slice, rebased."""
    return cells.where(F.col("col").between(first, last)).withColumn("col", F.col("col") - first)


# --- column aggregates ------------------------------------------------------

def group_sizes(cells: DataFrame) -> DataFrame:
    """Rows per (column, symbol)."""
    return cells.groupBy("col", "sym").agg(F.count("*").alias("size"))


def column_counts(cells: DataFrame) -> DataFrame:
    """One row per column: counts ``n0..n4`` of the symbols and coverage ``cov``."""
    per_symbol = [F.count_if(F.col("sym") == s).alias(f"n{s}") for s in range(N_SYMBOLS)]
    return cells.groupBy("col").agg(*per_symbol, F.count("*").alias("cov"))


def column_coverage(cells: DataFrame) -> DataFrame:
    return cells.groupBy("col").agg(F.count("*").alias("cov"))


def weighted_consensus(cells: DataFrame) -> DataFrame:
    """Per column, how many covering rows disagree with each symbol; ``w5`` is the coverage."""
    n = column_counts(cells)
    return n.select("col", *[(F.col("cov") - F.col(f"n{s}")).alias(f"w{s}") for s in range(N_SYMBOLS)],
                    F.col("cov").alias("w5"))


def column_consensus(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Majority symbol per column (and key), lowest code on ties."""
    counts = cells.groupBy(*keys, "col", "sym").agg(F.count("*").alias("n"))
    return (counts.groupBy(*keys, "col")
            .agg(F.max_by("sym", F.struct(F.col("n"), -F.col("sym"))).alias("sym"), F.max("n").alias("n")))


def eligible_groups(sizes: DataFrame, n_rows: int, min_cov: int) -> DataFrame:
    """Groups large enough to be significant and not shared by all rows."""
    return sizes.where((F.col("size") > min_cov // 4) & (F.col("size") < n_rows))


def base_dominated_columns(counts: DataFrame) -> DataFrame:
    """Columns where bases hold more than half of the coverage."""
    bases = sum((F.col(f"n{s}") for s in range(1, BASES)), F.col("n0"))
    return counts.where(bases > F.expr("cov div 2"))


def well_covered_columns(coverage: DataFrame) -> DataFrame:
    """Columns with at least 90 percent of the best coverage."""
    best = F.max("cov").over(Window.partitionBy())  # one row per column meets here, never the matrix
    return coverage.withColumn("best", best).where(F.col("cov") * 10 >= F.col("best") * 9).select("col", "cov")


# --- scores -----------------------------------------------------------------

def row_scores(cells: DataFrame) -> DataFrame:
    """Disagreements of every row with all rows covering its columns."""
    n = column_counts(cells)
    own = F.expr("CASE sym WHEN 0 THEN n0 WHEN 1 THEN n1 WHEN 2 THEN n2 WHEN 3 THEN n3 ELSE n4 END")
    return cells.join(sent(n), "col").groupBy("row_id").agg(F.sum(F.col("cov") - own).alias("score"))


def _product(a, b) -> Column:
    """Products of row counts pass 64 bits from 3 * 10^9 rows on."""
    wide = [F.col(x) if isinstance(x, str) else x for x in (a, b)]
    return wide[0].cast("decimal(19,0)") * wide[1].cast("decimal(19,0)")


def sum_of_pairs_score(cells: DataFrame) -> DataFrame:
    """Disagreeing ordered row pairs over all columns, in closed form per column."""
    n = column_counts(cells)
    agree = sum((_product(f"n{s}", f"n{s}") for s in range(1, N_SYMBOLS)), _product("n0", "n0"))
    return n.agg(F.coalesce(F.sum(_product("cov", "cov") - agree), F.lit(0)).alias("score"), F.count("*").alias("width"))


def alignment_quality(cells: DataFrame) -> DataFrame:
    """Share of (base, symbol) comparisons that disagree."""
    n = column_counts(cells)
    errors = sum((_product(f"n{s}", F.col("cov") - F.col(f"n{s}")) for s in range(1, BASES)), _product("n0", F.col("cov") - F.col("n0")))
    all_pairs = F.sum(_product(F.col("cov") - F.col(f"n{GAP}"), "cov"))
    return n.agg((F.sum(errors).cast("double") / all_pairs.cast("double")).alias("quality"))


def error_rates(cells: DataFrame, max_z: DataFrame, cutoff: float) -> DataFrame:
    """Error shares in columns without significant variation.

    ``max_z(g, z)`` holds the best significance per group. A base column has one base larger than
    every other symbol, a gap column has more gaps than any base.
    """
    quiet = (max_z.groupBy((F.col("g") / N_SYMBOLS).cast("int").alias("col"))
             .agg(F.max("z").alias("z")).where(F.col("z") < cutoff).select("col"))
    n = column_counts(cells).join(quiet, "col", "left_semi")
    names = [f"n{s}" for s in range(N_SYMBOLS)]
    top_base = F.greatest(*names[:BASES])
    all_bases = sum((F.col(c) for c in names[1:BASES]), F.col(names[0]))
    top_holders = sum(((F.col(c) == top_base).cast("int") for c in names[1:BASES]), (F.col(names[0]) == top_base).cast("int"))
    base_col = (top_base > F.col("n4")) & (top_holders == 1)
    gap_col = F.col("n4") > top_base
    cov = F.col("cov")
    return n.agg(
        (F.sum(F.when(base_col, (all_bases - top_base) / cov)) / F.nullif(3 * F.count_if(base_col), F.lit(0))).alias("base_to_base"),
        (F.sum(F.when(base_col, F.col("n4") / cov)) / F.nullif(F.count_if(base_col), F.lit(0))).alias("base_to_gap"),
        (F.sum(F.when(gap_col, all_bases / cov)) / F.nullif(4 * F.count_if(gap_col), F.lit(0))).alias("gap_to_base"))


# --- windows over the column axis -------------------------------------------

def coverage_window(cells: DataFrame, width: int, share: float = 0.90, step: int = 100) -> DataFrame:
    """First and last sampled column with at least ``share`` of the average sampled coverage."""
    sampled = (cells.sparkSession.range(0, width, step).select(F.col("id").cast("int").alias("col"))
               .join(column_coverage(cells.where(F.col("col") % step == 0)), "col", "left")
               .select("col", F.coalesce("cov", F.lit(0)).alias("cov")))
    all_samples = Window.partitionBy()  # one row per sampled column
    return (sampled.withColumn("average", F.expr("sum(cov) over () div count(*) over ()"))
            .withColumn("best", F.max("cov").over(all_samples))
            .where(F.col("cov") >= share * F.col("average"))
            .agg(F.min("col").alias("first_col"), F.max("col").alias("last_col"),
                 F.max("average").alias("average"), F.max("best").alias("best")))


def window_bounds(window: DataFrame, parts: int = 6) -> DataFrame:
    """Equally spaced section borders of a coverage window."""
    return (window.select("first_col", "last_col", F.explode(F.sequence(F.lit(0), F.lit(parts))).alias("part"))
            .select("part", F.expr("cast(first_col + (part * (last_col - first_col)) div %d as int)" % parts)
                    .alias("bound")))


def window_pairs(bounds: DataFrame) -> DataFrame:
    """Successive borders as (from, to) sections; the border list has ``parts + 1`` entries."""
    w = Window.orderBy("part")
    return (bounds.select(F.col("part").alias("window_id"), F.col("bound").alias("from_col"),
                          F.lead("bound").over(w).alias("to_col"))
            .where(F.col("to_col").isNotNull()))


# --- gaps along a row -------------------------------------------------------

def blank_outer_gaps(rows: DataFrame) -> DataFrame:
    """Gap runs that reach a row end or a blank are no alignment gaps: make them blank."""
    # A run of gaps and blanks is blanked when it holds a blank or touches an end. Runs of pure
    # gaps between two bases are the only ones kept; everything else is padded back in place.
    marked = F.translate("symbols", "_", "-")
    pieces = F.regexp_extract_all(marked, F.lit(r"([^ -]+|[ -]+)"), F.lit(1))
    last = F.size("pieces") - 1
    fixed = F.transform("pieces", lambda p, i: F.when(
        p.rlike("^[ -]") & ((i == 0) | (i == last) | p.contains(BLANK)),
        F.repeat(F.lit(BLANK), F.length(p))).otherwise(p))
    return (rows.withColumn("pieces", pieces).withColumn("symbols", F.array_join(fixed, ""))
            .drop("pieces"))


def based_columns(cells: DataFrame) -> DataFrame:
    """Columns holding at least one base, with their new consecutive index.

    The window runs over column indices only, never over rows of the matrix.
    """
    kept = cells.where(F.col("sym") < GAP).select("col").distinct()
    return kept.select("col", (F.dense_rank().over(Window.orderBy("col")) - 1).alias("new_col"))


def drop_empty_columns(cells: DataFrame) -> DataFrame:
    """Remove columns without bases and renumber the rest."""
    return (cells.join(sent(based_columns(cells)), "col")
            .select("row_id", F.col("new_col").alias("col"), "sym"))


def base_positions(rows: DataFrame) -> DataFrame:
    """Column of every base of a row, in order, without leaving the row."""
    bases = F.expr("filter(transform(split(symbols, ''), (ch, i) -> named_struct('ch', ch, 'col', i)), "
                   "x -> length(x.ch) = 1 and instr('acgt', lower(x.ch)) > 0)")
    return (rows.select("row_id", F.posexplode(bases).alias("pos", "base"))
            .select("row_id", "pos", F.col("base.col").alias("col"),
                    F.expr("instr('acgt', lower(base.ch)) - 1").alias("sym")))
