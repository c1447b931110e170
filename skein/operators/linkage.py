"""Linking several clusterings of the same rows and scoring them against known copies.

Matrices are sparse (i, j, p) tables. A contingency table is one map-side combined aggregate of the
rows, everything after it works on labels only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ordinal import with_ordinal
from skein.operators import matrix, pairs
from skein.schema import BLANK, N_SYMBOLS, check_width, symbol_char
from skein.session import cut_lineage

# --- fixed values -----------------------------------------------------------
CONFIDENCES = tuple(c / 10 for c in range(10))  # thresholds 0.0, 0.1, ... 0.9
MAX_DIFFERENCES = 10                            # uniqueness is reported for > 0 ... > 10 differences
HALF_DIFFERENCES = 5
# ----------------------------------------------------------------------------
DIGITS = 12  # probabilities are compared after rounding, so equal values tie on every platform


def contingency(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows per pair of labels of two clusterings, both present."""
    a = first.where(F.col("label").isNotNull()).select("row_id", F.col("label").alias("i"))
    b = second.where(F.col("label").isNotNull()).select("row_id", F.col("label").alias("j"))
    return a.join(b, "row_id").groupBy("i", "j").agg(F.count("*").alias("n"))


def transition(counts: DataFrame) -> DataFrame:
    """Row-stochastic form of a contingency table."""
    return counts.select("i", "j", (F.col("n") / F.sum("n").over(Window.partitionBy("i"))).alias("p"))


def transposed(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), *[c for c in m.columns if c not in ("i", "j")])


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product of sparse matrices."""
    left = a.select("i", F.col("j").alias("m"), F.col("p").alias("pa"))
    right = b.select(F.col("i").alias("m"), "j", F.col("p").alias("pb"))
    return left.join(right, "m").groupBy("i", "j").agg(F.sum(F.col("pa") * F.col("pb")).alias("p"))


def elementwise(a: DataFrame, b: DataFrame) -> DataFrame:
    """Element-wise product; absent entries are 0."""
    return (a.withColumnRenamed("p", "pa").join(b.withColumnRenamed("p", "pb"), ["i", "j"])
            .select("i", "j", (F.col("pa") * F.col("pb")).alias("p")))


def normalised(m: DataFrame) -> DataFrame:
    total = F.sum("p").over(Window.partitionBy("i"))
    return (m.withColumn("t", total).where(F.col("t") > 0)
            .select("i", "j", F.round(F.col("p") / F.col("t"), DIGITS).alias("p")))


def contingencies(layers: DataFrame, n: int) -> list[DataFrame]:
    """Rows per pair of labels of each two neighbouring clusterings, in one pass over ``layers``.

    ``layers`` holds for every row the array ``labels`` of its ``n`` labels, null where it has none.
    """
    k = F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("k")
    met = (layers.select("labels", k).select("k", F.get("labels", F.col("k") - 1).alias("i"), F.get("labels", F.col("k")).alias("j"))
           .where(F.col("i").isNotNull() & F.col("j").isNotNull()).groupBy("k", "i", "j").agg(F.count("*").alias("n")))
    met = cut_lineage(met)  # of the size of the labels
    return [met.where(F.col("k") == step).drop("k") for step in range(1, n)]


def chain(counts: list[DataFrame]) -> DataFrame:
    """Transition from the first to the last clustering through all in between, from their contingency tables."""
    return reduce(product, [transition(c) for c in counts])


def connection(counts: list[DataFrame]) -> DataFrame:
    """Forward chain times the transposed backward chain, rows normalised."""
    back = [transposed(c) for c in counts[::-1]]
    return normalised(elementwise(chain(counts), transposed(chain(back))))


def conditional_shares(truth: DataFrame, labelled: DataFrame, masked: bool = True) -> DataFrame:
    """P(label | copy) and P(copy | label) for every co-occurring pair.

    With ``masked`` only rows that carry a label count towards a copy's size.
    """
    both = contingency(truth, labelled)
    known = truth.where(F.col("label").isNotNull())
    if masked:
        known = known.join(labelled.where(F.col("label").isNotNull()).select("row_id"), "row_id", "left_semi")
    copies = known.groupBy(F.col("label").alias("i")).agg(F.count("*").alias("copy_size"))
    labels = labelled.where(F.col("label").isNotNull()).groupBy(F.col("label").alias("j")).agg(F.count("*").alias("label_size"))
    return (both.join(copies, "i").join(labels, "j")
            .select("i", "j", (F.col("n") / F.col("copy_size")).alias("p_label"), (F.col("n") / F.col("label_size")).alias("p_copy")))


def copy_connection(truth: DataFrame, labelled: DataFrame, masked: bool = True) -> DataFrame:
    """Copy-to-copy connection of one clustering."""
    s = conditional_shares(truth, labelled, masked)
    there = s.select("i", "j", F.col("p_label").alias("p"))
    back = transposed(s.select("i", "j", F.col("p_copy").alias("p")))
    return normalised(product(there, back))


def mutual_best(connection_matrix: DataFrame) -> DataFrame:
    """Resolution state of every copy.

    ``best`` is the strongest partner (lowest label on ties). It counts when the partner's own
    strongest value is the same: 1 = the copy itself, -1 = another copy, 0 = not mutual.
    """
    top = connection_matrix.groupBy("i").agg(
        F.max("p").alias("confidence"), F.max_by("j", F.struct(F.col("p"), -F.col("j"))).alias("best"))
    partner = top.select(F.col("i").alias("best"), F.col("confidence").alias("partner_confidence"))
    state = (F.when(F.col("confidence") != F.coalesce("partner_confidence", F.lit(-1.0)), F.lit(0))
             .when(F.col("best") == F.col("i"), F.lit(1)).otherwise(F.lit(-1)))
    return top.join(partner, "best", "left").select("i", "best", "confidence", state.alias("state"))


def confidence_histogram(states: DataFrame) -> DataFrame:
    """Correctly resolved copies with a confidence above 0.0, 0.1, ... 0.9."""
    passed = F.explode(F.array(*[F.struct(F.lit(c).alias("threshold"), (F.col("confidence") > c).alias("ok")) for c in CONFIDENCES]))
    return (states.select("state", passed.alias("t")).groupBy(F.col("t.threshold").alias("threshold"))
            .agg(F.count_if((F.col("state") == 1) & F.col("t.ok")).alias("resolved")))


def resolution_summary(states: DataFrame) -> DataFrame:
    return states.agg(F.count_if(F.col("state") == 1).alias("true_positives"),
                      F.count_if(F.col("state") == -1).alias("false_positives"),
                      F.count_if(F.col("state") == 0).alias("unresolved"))


def groups(labelled: DataFrame) -> DataFrame:
    """Dense index of non-empty labels in ascending order."""
    sizes = labelled.where(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("size"))
    return with_ordinal(sizes, F.col("label"), name="idx").select("label", "idx", "size")


# --- how different are the copies -------------------------------------------

def signatures(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Rows reduced to the given columns, in column order."""
    check_width(columns.count())
    chosen = [r["col"] for r in columns.select("col").orderBy("col").collect()]  # bounded by the width
    chars = rows.select("row_id", F.split("symbols", "").alias("chars"))
    picked = F.transform(F.lit(chosen), lambda c: F.coalesce(F.get("chars", c), F.lit(BLANK)))
    return chars.select("row_id", F.array_join(picked, "").alias("symbols"))


def copy_consensus(cells: DataFrame, truth: DataFrame) -> DataFrame:
    """Majority symbol per copy and column."""
    labelled = cells.join(truth.where(F.col("label").isNotNull()).select("row_id", "label"), "row_id")
    return matrix.column_consensus(labelled, ("label",))


def consensus_differences(consensus: DataFrame, columns: DataFrame, copies: DataFrame, halves: bool = False) -> DataFrame:
    """Columns in which the consensus of two copies differs, for every ordered pair of copies.

    The consensus table is turned round (row = column, column = copy), so agreement of copies is a
    pair count like any other. A copy without data in a column has symbol 0 there.
    """
    m = copies.count()
    placed = columns.select("col", (F.row_number().over(Window.orderBy("col")) - 1).alias("pos"))
    n = check_width(columns.count())
    placed = placed.withColumn("half", (F.col("pos") >= (n // 2 if halves else n)).cast("bigint"))
    chars = (consensus.join(copies, "label").groupBy("col")
             .agg(F.map_from_entries(F.collect_list(F.struct("idx", symbol_char(F.col("sym"))))).alias("by_copy")))
    turned = (placed.join(chars, "col", "left").select(
        F.col("pos").cast("bigint").alias("row_id"), "half",
        F.array_join(F.expr(f"transform(sequence(0, {m - 1}), c -> coalesce(by_copy[c], 'a'))"), "").alias("symbols")))
    counted = pairs.column_pairs(turned, m, 1, by=("half",))
    same = sum((F.col(f"n{s}{s}") for s in range(1, N_SYMBOLS)), F.col("n00"))
    diff = counted.select("half", F.col("ci").alias("a"), F.col("cj").alias("b"), (F.col("n55") - same).alias("diff"))
    both = diff.select("half", F.explode(F.array(F.struct(F.col("a").alias("i"), F.col("b").alias("j")),
                                                 F.struct(F.col("b").alias("i"), F.col("a").alias("j")))).alias("s"), "diff")
    named = copies.select("label", "idx")
    return (both.select("half", "s.i", "s.j", "diff")
            .join(named.select(F.col("idx").alias("i"), F.col("label").alias("copy")), "i")
            .join(named.select(F.col("idx").alias("j"), F.col("label").alias("other")), "j")
            .select(*(["half"] if halves else []), "copy", "other", "diff"))


def resolvability(differences: DataFrame) -> DataFrame:
    """Copies whose closest other copy differs in more than t = 0..10 columns."""
    closest = differences.groupBy("copy").agg(F.min("diff").alias("min_diff"))
    t = F.explode(F.sequence(F.lit(0), F.lit(MAX_DIFFERENCES))).alias("threshold")
    return (closest.select("min_diff", t).groupBy("threshold")
            .agg(F.count_if(F.col("min_diff") > F.col("threshold")).alias("unique_copies"), F.count("*").alias("copies")))


def half_resolvability(differences: DataFrame) -> DataFrame:
    """Copies with more than five differences in either half of the columns, as a 2 x 2 table."""
    per_half = (differences.groupBy("copy").agg(
        F.min(F.when(F.col("half") == 0, F.col("diff"))).alias("first"),
        F.min(F.when(F.col("half") == 1, F.col("diff"))).alias("second")))
    a, b = F.coalesce("first", F.lit(0)) > HALF_DIFFERENCES, F.coalesce("second", F.lit(0)) > HALF_DIFFERENCES
    return per_half.agg(F.count_if(a & b).alias("both_halves"), F.count_if(a & ~b).alias("first_only"),
                        F.count_if(~a & b).alias("second_only"), F.count_if(~a & ~b).alias("neither"))
