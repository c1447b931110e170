"""Registered queries: every operator on matrices and sequences derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions import sequence, stats
from skein.functions.ordinal import with_ordinal
from skein.operators import align, cliques, correlate, explore, families, linkage, matrix, merge, neighbours, pairs, partition, partners
from skein.plans import tables
from skein.plans.tables import EVENT_WIDTH, LETTER_WIDTH, order_width, table
from skein.schema import group_id
from skein.session import cut_lineage, spread

MIN_COV = 30
MIN_GROUP = MIN_COV // 2
LETTER_CUTOFF = stats.significance_cutoff(LETTER_WIDTH)
EVENT_GAP = 5
EVENT_CUTOFF = 0.5
LINE_STEP = 10
MAX_DROP = partition.MAX_DROP
RELATIVE_DROP = 0.5  # letters have blunter cutoffs than alignments
ITEM_PARTS = 3  # parts of a benchmark item
TEXT_ERROR = 0.5  # error limit for prose read as sequence, which aligns worse than real reads


def plain(df: DataFrame, digits: int = 6) -> DataFrame:
    """Integers as BIGINT and doubles rounded, the form in which results are compared."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType, T.LongType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, digits) + F.lit(0.0)
        out.append(c.alias(f.name))
    return df.select(*out)


QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = lambda spark, sf_dir: plain(fn(spark, sf_dir))
    return fn


# --- shared building blocks -------------------------------------------------

def letters(s, d):
    rows = cut_lineage(tables.letter_rows(s, d))  # 26 characters per text, read several times
    return rows, rows.count()


def letter_sizes(rows):
    return matrix.group_sizes(matrix.to_cells(rows))


def letter_tested(rows, n):
    return correlate.tested_pairs(rows, LETTER_WIDTH, n, MIN_COV, 1, base_dominated=False, stop_at_first_gap=True)


def letter_best(rows, n, **terms):
    return partners.strongest(rows, LETTER_WIDTH, n, MIN_COV, 1, base_dominated=False, stop_at_first_gap=True, **terms)


def letter_max(s, d):
    rows, n = letters(s, d)
    return rows, n, cut_lineage(correlate.of_all_groups(letter_best(rows, n), LETTER_WIDTH))


def letter_cliques(s, d):
    """Rows, row count, correlations and cliques of the letter matrix; the small tables are cut off."""
    rows, n, max_z = letter_max(s, d)
    seeds = correlate.seed_groups(max_z, LETTER_CUTOFF)
    found = cliques.top_partners(rows, LETTER_WIDTH, letter_sizes(rows), seeds, LETTER_CUTOFF, MIN_COV)
    return rows, n, max_z, cut_lineage(found)


def letter_above(s, d):
    rows, n, max_z, found = letter_cliques(s, d)
    kept = cliques.large_cliques(found)
    return rows, n, kept, cut_lineage(cliques.rows_above(cliques.hit_histogram(rows, LETTER_WIDTH, kept), kept))


def letter_refined(s, d):
    rows, n, max_z, found = letter_cliques(s, d)
    return rows, n, max_z, found, cut_lineage(cliques.refine(rows, LETTER_WIDTH, n, found))


def language(s, d) -> DataFrame:
    """Known copies: documents of one language, numbered alphabetically."""
    return table(s, d, "documents").select(F.col("doc_id").alias("row_id"), F.expr(
        "array_position(array('de', 'en', 'es', 'fr'), lang) - 1").cast("bigint").alias("label"))


def line_label(s, d, number: int) -> DataFrame:
    """Clustering of orders by the return flag on one line; orders without that line have none."""
    flags = tables.order_cells(s, d).where(F.col("col") == number - 1).select("row_id", F.col("sym").cast("bigint").alias("label"))
    return partition.complete_labels(table(s, d, "orders").select(F.col("o_orderkey").alias("row_id")), flags)


def status_label(s, d) -> DataFrame:
    return table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.expr(
        "instr('FOP', o_orderstatus) - 1").cast("bigint").alias("label"))


def lines_matrix(s, d):
    rows = tables.line_rows(s, d)
    width = matrix.matrix_width(rows)
    return tables.padded(rows, width), width


# --- matrix -----------------------------------------------------------------

@query
def base_group_size(s, d):
    return matrix.group_sizes(tables.order_cells(s, d))


@query
def column_coverage(s, d):
    return matrix.column_coverage(matrix.to_cells(tables.line_rows(s, d)))


@query
def weighted_consensus(s, d):
    return matrix.weighted_consensus(tables.order_cells(s, d))


@query
def column_consensus(s, d):
    return matrix.column_consensus(matrix.to_cells(tables.letter_rows(s, d)))


@query
def copy_consensus(s, d):
    return linkage.copy_consensus(matrix.to_cells(tables.letter_rows(s, d)), language(s, d))


@query
def eligible_groups(s, d):
    cells = tables.event_cells(s, d)
    return matrix.eligible_groups(matrix.group_sizes(cells), cells.select("row_id").distinct().count(), MIN_COV)


@query
def base_dominated_columns(s, d):
    return matrix.base_dominated_columns(matrix.column_counts(matrix.to_cells(tables.letter_rows(s, d))))


@query
def well_covered_columns(s, d):
    return matrix.well_covered_columns(matrix.column_coverage(tables.event_cells(s, d)))


@query
def row_score(s, d):
    return matrix.row_scores(tables.order_cells(s, d))


@query
def sum_of_pairs_score(s, d):
    return matrix.sum_of_pairs_score(matrix.to_cells(tables.line_rows(s, d)))


@query
def alignment_quality(s, d):
    return matrix.alignment_quality(tables.event_cells(s, d))


@query
def full_coverage_rows(s, d):
    return matrix.to_cells(matrix.window_rows(tables.event_rows(s, d), 3, 20))


@query
def excluded_rows(s, d):
    return matrix.rows_outside_window(tables.event_rows(s, d), 3, 20)


@query
def sliced_columns(s, d):
    return matrix.slice_columns(tables.order_cells(s, d), 2, 5)


@query
def coverage_window(s, d):
    rows, width = lines_matrix(s, d)
    return matrix.coverage_window(matrix.to_cells(rows), width, step=LINE_STEP)


@query
def window_pairs(s, d):
    rows, width = lines_matrix(s, d)
    return matrix.window_pairs(matrix.window_bounds(matrix.coverage_window(matrix.to_cells(rows), width, step=LINE_STEP), 3))


@query
def gap_runs_to_blank(s, d):
    return matrix.to_cells(matrix.blank_outer_gaps(tables.line_rows(s, d)))


@query
def drop_empty_columns(s, d):
    """Columns of the line matrix that only ever hold gaps disappear."""
    return matrix.drop_empty_columns(matrix.to_cells(tables.line_rows(s, d)))


@query
def base_positions(s, d):
    return matrix.base_positions(tables.event_rows(s, d))


# --- co-occurrence ----------------------------------------------------------

@query
def pair_counts(s, d):
    return pairs.group_pairs(pairs.column_pairs(*tables.order_matrix(s, d), 1))


@query
def pair_significance(s, d):
    rows, n = letters(s, d)
    return letter_tested(rows, n).select("ci", "si", "cj", "sj", "k", "z")


def event_best(s, d, stop_at_first_gap: bool):
    rows = cut_lineage(tables.event_rows(s, d))
    best = partners.strongest(rows, EVENT_WIDTH, rows.count(), MIN_COV, EVENT_GAP, stop_at_first_gap=stop_at_first_gap)
    return correlate.of_all_groups(best, EVENT_WIDTH)


@query
def max_correlation(s, d):
    return event_best(s, d, stop_at_first_gap=True)


@query
def max_correlation_any_gap(s, d):
    """Columns that share few rows are left out; those on their right are tested."""
    return event_best(s, d, stop_at_first_gap=False)


@query
def max_correlation_letters(s, d):
    return letter_max(s, d)[2]


@query
def column_max_correlation(s, d):
    return correlate.column_max(letter_max(s, d)[2])


@query
def window_correlations(s, d):
    return correlate.window_correlations(letter_max(s, d)[2], 5, 17)


@query
def thin_columns_masked(s, d):
    rows, _, max_z = letter_max(s, d)
    return correlate.mask_thin_columns(max_z, matrix.to_cells(rows).where("sym < 4"))


@query
def significant_partner_count(s, d):
    return letter_best(*letters(s, d), cutoff=LETTER_CUTOFF).where("partners > 0").select("g", "partners")


@query
def lonely_groups_dropped(s, d):
    best = cut_lineage(letter_best(*letters(s, d), cutoff=LETTER_CUTOFF))
    return correlate.drop_lonely_groups(correlate.of_all_groups(best, LETTER_WIDTH), best.select("g", "partners"), 40)


@query
def partner_histogram(s, d):
    return correlate.partner_histogram(letter_best(*letters(s, d), cutoff=LETTER_CUTOFF), LETTER_WIDTH)


@query
def distant_partner_histogram(s, d):
    """Partners counted only if more than 100 group ids away."""
    return correlate.partner_histogram(letter_best(*letters(s, d), cutoff=LETTER_CUTOFF, apart=100), LETTER_WIDTH)


@query
def relative_significance(s, d):
    """Two-sided significance of letter groups within the documents of one language."""
    universe = language(s, d).where("label = 1")
    return pairs.relative_significance(tables.letter_rows(s, d), LETTER_WIDTH, universe).select("ci", "si", "cj", "sj", "z")


@query
def snowball(s, d):
    rows, n = letters(s, d)
    return correlate.snowball(letter_tested(rows, n), letter_sizes(rows), n, LETTER_WIDTH, LETTER_CUTOFF)


@query
def error_estimate(s, d):
    return matrix.error_rates(tables.event_cells(s, d), event_best(s, d, stop_at_first_gap=True), 2.0)


@query
def two_sided_significance(s, d):
    c = F.col
    found = pairs.group_pairs(pairs.column_pairs(*tables.order_matrix(s, d), 1), min_shared=0)
    return found.select("ci", "si", "cj", "sj", stats.two_sided(c("k"), c("g1"), c("g2"), c("cov")).alias("z"))


@query
def relative_variables(s, d):
    rows, n, max_z = letter_max(s, d)
    return partition.relative_variables(rows, LETTER_WIDTH, correlate.seed_groups(max_z, LETTER_CUTOFF), language(s, d),
                                        LETTER_CUTOFF, MIN_GROUP)


@query
def f_beta(s, d):
    found = pairs.with_sizes(pairs.group_pairs(pairs.column_pairs(*tables.order_matrix(s, d), 1)),
                             matrix.group_sizes(tables.order_cells(s, d)))
    k, a, b = F.col("k"), F.col("size_i"), F.col("size_j")
    return found.select("ci", "si", "cj", "sj", stats.f_beta(k, a - k, b - k).alias("f1"), stats.f_beta(k, a - k, b - k, 2.0).alias("f2"))


@query
def group_setops(s, d):
    rows, width = tables.order_matrix(s, d)
    found = pairs.group_pairs(pairs.column_pairs(rows, width, 1))
    return explore.set_comparison(pairs.with_sizes(found, matrix.group_sizes(tables.order_cells(s, d))), rows.count())


@query
def approx_containment(s, d):
    directed = explore.directed_pairs(pairs.group_pairs(pairs.column_pairs(tables.letter_rows(s, d), LETTER_WIDTH, 1)))
    return explore.approximate_containment(directed, 3)


@query
def containment_chains(s, d):
    rows, _ = letters(s, d)
    cells = matrix.to_cells(rows)
    directed = cut_lineage(explore.directed_pairs(pairs.group_pairs(pairs.column_pairs(rows, LETTER_WIDTH, 1))))
    contained = explore.approximate_containment(directed, 3)
    return explore.containment_chains(directed, contained, matrix.group_sizes(cells), matrix.column_coverage(cells), 400, 900)


@query
def intersect_pairs(s, d):
    rows, n, max_z = letter_max(s, d)
    return explore.intersect_pairs(pairs.group_pairs(pairs.column_pairs(rows, LETTER_WIDTH, 1)), letter_sizes(rows),
                                   correlate.seed_groups(max_z, LETTER_CUTOFF), MIN_COV)


@query
def two_column_moves(s, d):
    return explore.best_two_column_moves(tables.event_rows(s, d))


# --- cliques ----------------------------------------------------------------

@query
def clique_topk(s, d):
    return letter_cliques(s, d)[3].where("rank > 0").select("seed", "rank", "g", "z")


@query
def clique_histogram(s, d):
    return cliques.clique_histogram(letter_above(s, d)[3])


@query
def dropoff_cutoff(s, d):
    rows, n, _, above = letter_above(s, d)
    return cliques.dropoff(above, n).select("seed", "size", "cutoff", "drop_off")


@query
def prefix_dropoff(s, d):
    rows, n, _, found = letter_cliques(s, d)
    return cliques.prefix_dropoff(rows, LETTER_WIDTH, found, n)


@query
def binomial_best_cutoff(s, d):
    rows, n, _, above = letter_above(s, d)
    return cliques.chance_cutoff(above, n).select("seed", "size", "best_cutoff")


@query
def expected_chance_rows(s, d):
    rows, n, _, above = letter_above(s, d)
    cuts = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("c")
    return (above.select("seed", "size", cuts)
            .select("seed", "c", stats.expected_rows_above(F.lit(n), F.col("c"), F.col("size"), 0.05).alias("expected")))


@query
def korr_max_cutoff(s, d):
    rows, n, _, above = letter_above(s, d)
    cells = matrix.to_cells(rows)
    return cliques.correlation_cutoff(cliques.chance_cutoff(above, n), matrix.column_coverage(cells), matrix.group_sizes(cells))


@query
def core_group(s, d):
    rows, n, _, above = letter_above(s, d)
    return cliques.core_cutoff(above, letter_sizes(rows))


@query
def refined_groups(s, d):
    return letter_refined(s, d)[4]


@query
def refined_members(s, d):
    rows, n, _, found, refined = letter_refined(s, d)
    return cliques.clique_rows(rows, LETTER_WIDTH, cliques.large_cliques(found), refined)


@query
def clique_coverage(s, d):
    rows, n, _, found, refined = letter_refined(s, d)
    return (cliques.clique_rows(rows, LETTER_WIDTH, cliques.large_cliques(found), refined, coverage=True)
            .groupBy("seed").agg(F.count("*").alias("n_rows")))


@query
def clique_intersections(s, d):
    """Rows that two refined groups of the strongest seed's partners share."""
    rows, n, _, found, refined = letter_refined(s, d)
    members = cut_lineage(cliques.clique_rows(rows, LETTER_WIDTH, cliques.large_cliques(found), refined))
    best = refined.orderBy("drop_off", "seed").limit(1).select("seed")  # one seed
    return explore.intersections(members, best).select("seed", "row_id")


@query
def group_precision(s, d):
    rows, n, _, found, refined = letter_refined(s, d)
    return cliques.group_precision(cliques.clique_rows(rows, LETTER_WIDTH, cliques.large_cliques(found), refined), n)


@query
def clique_conflicts(s, d):
    rows, n, _, found, refined = letter_refined(s, d)
    return explore.conflicts(cliques.clique_rows(rows, LETTER_WIDTH, cliques.large_cliques(found), refined), 20)


# --- labels and partitions --------------------------------------------------

@query
def label_compression(s, d):
    raw = table(s, d, "orders").select(F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderstatus") != "P", F.col("o_custkey")).alias("label"))
    return partition.compress_labels(raw)


@query
def completed_labels(s, d):
    return line_label(s, d, 1)


@query
def cluster_sizes(s, d):
    return partition.cluster_sizes(line_label(s, d, 1))


@query
def split_counts(s, d):
    members = tables.order_cells(s, d).select("row_id", group_id(F.col("col"), F.col("sym")).alias("seed"))
    return partition.split_counts(status_label(s, d), members)


@query
def splittable_clusters(s, d):
    members = tables.order_cells(s, d).select("row_id", group_id(F.col("col"), F.col("sym")).alias("seed"))
    return partition.splittable(partition.split_counts(status_label(s, d), members), MIN_GROUP)


@query
def block_accuracy(s, d):
    return partition.block_accuracy(status_label(s, d), table(s, d, "orders").count())


@query
def relative_dropoff(s, d):
    rows, n, _, found = letter_cliques(s, d)
    return partition.relative_dropoff(rows, LETTER_WIDTH, found, language(s, d), n, MIN_GROUP)


@query
def dropoff_subdivision(s, d):
    rows, n, max_z, found, refined = letter_refined(s, d)
    return partition.dropoff_subdivision(rows, LETTER_WIDTH, found, refined, max_z, MIN_GROUP)


@query
def plain_subdivision(s, d):
    """Subdivision by all refined groups, however blunt their cutoff."""
    rows, n, max_z, found, refined = letter_refined(s, d)
    return partition.dropoff_subdivision(rows, LETTER_WIDTH, found, refined, max_z, MIN_GROUP, max_drop=None)


@query
def relative_subdivision(s, d):
    """The languages subdivided."""
    rows, n, _, found = letter_cliques(s, d)
    return partition.relative_subdivision(rows, LETTER_WIDTH, found, language(s, d), n, MIN_GROUP, RELATIVE_DROP)


@query
def repeated_subdivision(s, d):
    rows, n, max_z, found = letter_cliques(s, d)
    return partition.repeated_subdivision(rows, LETTER_WIDTH, found, correlate.seed_groups(max_z, LETTER_CUTOFF), language(s, d),
                                          n, LETTER_CUTOFF, MIN_GROUP)


@query
def kmeans_subdivision(s, d):
    rows, n, max_z, found, refined = letter_refined(s, d)
    first = cut_lineage(partition.dropoff_subdivision(rows, LETTER_WIDTH, found, refined, max_z, MIN_GROUP))
    second = cut_lineage(partition.relative_subdivision(rows, LETTER_WIDTH, found, first, n, MIN_GROUP))
    return partition.majority_subdivision(rows, LETTER_WIDTH, correlate.seed_groups(max_z, LETTER_CUTOFF), second, LETTER_CUTOFF, MIN_GROUP)


def sign_bits(s, d) -> DataFrame:
    """Embeddings as bit strings of their signs, one label per known class."""
    return table(s, d, "embeddings").select(
        F.col("label").cast("bigint").alias("label"), F.col("vec_id").alias("row_id"),
        F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "").alias("bits"))


@query
def knn_majority(s, d):
    points = sign_bits(s, d)
    return points.join(neighbours.centroids(points).select("label", "bits", "centroid"), ["label", "bits"]).select("row_id", "centroid")


@query
def nearest_centroid(s, d):
    points = cut_lineage(sign_bits(s, d))
    return neighbours.nearest_centroid(points, cut_lineage(neighbours.centroids(points))).select("row_id", "cluster")


@query
def nearest_row(s, d):
    return neighbours.nearest_row_clusters(cut_lineage(sign_bits(s, d))).select("row_id", "cluster")


# --- linkage ----------------------------------------------------------------

def line_layers(s, d) -> tuple[DataFrame, int]:
    """Labels of an order: its status, the return flags of all its lines, its status again."""
    width = order_width(s, d)
    flags = tables.order_rows(s, d).select("row_id", F.expr(
        f"transform(sequence(1, {width}), k -> nullif(instr('acgt-', substring(symbols, k, 1)), 0) - 1)").alias("flags"))
    own = F.array(F.col("label").cast("int"))
    blank = F.array_repeat(F.lit(None).cast("int"), width)
    return (status_label(s, d).join(flags, "row_id", "left")
            .select(F.concat(own, F.coalesce("flags", blank), own).cast("array<bigint>").alias("labels"))), width + 2


@query
def contingency(s, d):
    return linkage.contingency(line_label(s, d, 1), line_label(s, d, 2))


@query
def transition_matrix(s, d):
    return linkage.transition(linkage.contingency(line_label(s, d, 1), line_label(s, d, 2)))


@query
def chain_product(s, d):
    layers, n = line_layers(s, d)
    return linkage.chain(linkage.contingencies(layers, n)[1:-1])


@query
def connection(s, d):
    return linkage.connection(linkage.contingencies(*line_layers(s, d)))


@query
def multi_step_resolution(s, d):
    layers = [language(s, d), source_label(s, d), language(s, d)]
    return linkage.mutual_best(linkage.connection([linkage.contingency(a, b) for a, b in zip(layers, layers[1:])]))


def source_label(s, d) -> DataFrame:
    """Clustering of documents by source, only for documents with a quality label."""
    known = table(s, d, "labels").select("doc_id").distinct()
    return (table(s, d, "documents").join(known.withColumn("k", F.lit(True)), "doc_id", "left")
            .select(F.col("doc_id").alias("row_id"), F.when(F.col("k"), F.expr("substring(source, 4)").cast("bigint")).alias("label")))


def sign_cluster(s, d) -> DataFrame:
    """Clustering of embeddings by their largest dimension."""
    return table(s, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.expr(
        "array_position(embedding, array_max(embedding))").cast("bigint").alias("label"))


def vector_truth(s, d) -> DataFrame:
    return table(s, d, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").cast("bigint").alias("label"))


@query
def conditional_shares(s, d):
    return linkage.conditional_shares(language(s, d), source_label(s, d), masked=False)


@query
def greedy_assignment(s, d):
    """Classes of vectors and clusters by largest dimension, one to one."""
    shares = linkage.conditional_shares(vector_truth(s, d), sign_cluster(s, d))
    return explore.best_assignment(shares.select("i", "j", F.round("p_label", linkage.DIGITS).alias("p")))


@query
def resolution_quality(s, d):
    return linkage.mutual_best(linkage.copy_connection(vector_truth(s, d), sign_cluster(s, d)))


@query
def resolution_summary(s, d):
    return linkage.resolution_summary(linkage.mutual_best(linkage.copy_connection(vector_truth(s, d), sign_cluster(s, d))))


@query
def confidence_histogram(s, d):
    return linkage.confidence_histogram(linkage.mutual_best(linkage.copy_connection(vector_truth(s, d), sign_cluster(s, d))))


@query
def ordered_groups(s, d):
    return linkage.groups(source_label(s, d))


def source_copies(s, d) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("row_id"), F.expr("substring(source, 4)").cast("bigint").alias("label"))


def differences(s, d, halves: bool):
    cells = matrix.to_cells(tables.letter_rows(s, d))
    truth = source_copies(s, d)
    columns = s.range(LETTER_WIDTH).select(F.col("id").cast("int").alias("col"))
    return linkage.consensus_differences(linkage.copy_consensus(cells, truth), columns, cut_lineage(linkage.groups(truth)), halves)


@query
def pairwise_consensus_diff(s, d):
    return differences(s, d, False)


@query
def resolvability(s, d):
    return linkage.resolvability(differences(s, d, False))


@query
def half_resolvability(s, d):
    return linkage.half_resolvability(differences(s, d, True))


@query
def signatures(s, d):
    rows, _, max_z = letter_max(s, d)
    return linkage.signatures(rows, correlate.column_max(max_z).where(F.col("z") > 50.0))


# --- sequences --------------------------------------------------------------

def document_reads(s, d) -> DataFrame:
    return table(s, d, "documents").select(F.col("doc_id").alias("read_id"), sequence.clean(F.col("text")).alias("seq"))


def turn_pieces(s, d) -> DataFrame:
    """Conversation turns as numbered pieces; a conversation is the read they were cut from."""
    turns = table(s, d, "conversations").select(F.col("conv_id").alias("read_id"), F.col("turn").cast("int").alias("piece"),
                                                "role", sequence.clean(F.col("text")).alias("seq"))
    return sequence.number_pieces(turns)


def benchmark_template(s, d) -> str:
    return align.template_of(table(s, d, "benchmark").select("item_id", sequence.clean(F.col("text")).alias("seq")), "item_id")


@query
def clean_sequences(s, d):
    return document_reads(s, d)


@query
def reverse_complement(s, d):
    return document_reads(s, d).select("read_id", sequence.reverse_complement(F.col("seq")).alias("rc"))


@query
def line_wrap(s, d):
    return document_reads(s, d).select("read_id", sequence.wrap(F.col("seq")).alias("wrapped"))


@query
def template_concat(s, d):
    reads = table(s, d, "benchmark").select("item_id", sequence.clean(F.col("text")).alias("seq"))
    packed = reads.agg(F.array_sort(F.collect_list(F.struct("item_id", "seq"))).alias("r"))
    return packed.select(F.array_join(F.transform("r", lambda x: x["seq"]), "").alias("template"))


@query
def template_parts(s, d):
    items = table(s, d, "benchmark").select("item_id", sequence.clean(F.col("text")).alias("seq"))
    return sequence.template_parts(items, "item_id", 60, 5)


def pieces_of(reads: DataFrame) -> DataFrame:
    cuts = F.expr("filter(transform(sequence(1, 1 + length(seq) div 500), i -> i * 500), x -> x < length(seq))")
    return sequence.split_at_cuts(reads.withColumn("cuts", cuts))


@query
def read_split(s, d):
    return pieces_of(document_reads(s, d))


@query
def read_piece_lists(s, d):
    return sequence.read_piece_lists(turn_pieces(s, d)).select("read_id", F.array_join(F.col("seq_ids").cast("array<string>"), " ").alias("seq_ids"))


@query
def piece_read_merge(s, d):
    """Pieces of the documents find their documents again by their text."""
    reads = cut_lineage(spread(document_reads(s, d)))  # cleaned once, read several times
    return merge.piece_reads(sequence.number_pieces(pieces_of(reads)).select("seq_id", "seq"), reads)


@query
def prefix_containment(s, d):
    """Whether a conversation contains the first 100 characters of a turn behind that turn's own text."""
    turns = table(s, d, "conversations").select(F.col("conv_id").alias("family"), F.col("turn").alias("place"), F.col("text").alias("seq"))
    return merge.contained_later(turns).select(F.col("family").alias("conv_id"), F.col("place").alias("turn"), "contained")


@query
def flanks(s, d):
    pieces = turn_pieces(s, d).select("seq_id", "read_id", F.when(F.col("role") == "user", "l").otherwise("r").alias("cls"))
    return sequence.flanks(pieces)


@query
def flank_labels(s, d):
    pieces = turn_pieces(s, d).select("seq_id", "read_id", F.when(F.col("role") == "user", "l").otherwise("r").alias("cls"))
    return sequence.flank_labels(pieces, pieces.select("read_id", F.expr("read_id % 7").alias("copy")).distinct())


@query
def flank_sums(s, d):
    """Sums of the flank labels, -1 where a piece has none, and the pieces."""
    pieces = turn_pieces(s, d).select("seq_id", "read_id", F.when(F.col("role") == "user", "l").otherwise("r").alias("cls"))
    labels = sequence.flank_labels(pieces, pieces.select("read_id", F.expr("read_id % 7").alias("copy")).distinct())
    total = lambda c: F.sum(F.coalesce(c, F.lit(-1))).alias(c)
    return labels.agg(total("left_copy"), total("right_copy"), F.count("*").alias("pieces"))


@query
def row_copies(s, d):
    """Order line to customer nation over order and customer."""
    pieces = table(s, d, "orders").select(F.col("o_orderkey").alias("seq_id"), F.col("o_custkey").alias("read_id"))
    copies = table(s, d, "customer").select(F.col("c_custkey").alias("read_id"), F.col("c_nationkey").alias("copy"))
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("row_id"), F.col("l_orderkey").alias("seq_id")).distinct()
    return sequence.row_copies(rows, pieces, copies)


@query
def repeat_rows(s, d):
    pieces = turn_pieces(s, d).select("seq_id", F.when(F.col("role") == "user", "l").otherwise("r").alias("cls"))
    return sequence.repeat_rows(pieces)


@query
def point_edits(s, d):
    parts = table(s, d, "part").withColumn("kind", F.expr("element_at(array('sub', 'del', 'ins'), cast(p_partkey % 3 as int) + 1)"))
    at = F.expr("cast(p_partkey % length(p_name) as int)")
    return parts.select("p_partkey", sequence.point_edit(F.col("p_name"), at, F.col("kind"), F.lit("x")).alias("edited"))


@query
def string_difference(s, d):
    width = F.greatest(F.length("p_name"), F.length("p_type"))
    parts = table(s, d, "part").select("p_partkey", F.rpad("p_name", width, F.lit(" ")).alias("a"), F.rpad(F.lower("p_type"), width, F.lit(" ")).alias("b"))
    return parts.select("p_partkey", sequence.difference(F.col("a"), F.col("b")).alias("diff"))


@query
def edit_distance(s, d):
    return table(s, d, "part").select("p_partkey", F.levenshtein("p_name", F.lower("p_type")).alias("distance"))


def event_hits(s, d) -> DataFrame:
    """Events of a user as parts along a read: part = event type, position = seconds since the epoch."""
    part = F.expr("array_position(array('click', 'error', 'purchase', 'signup', 'view'), event_type) - 1")
    return table(s, d, "events").select(F.col("user_id").alias("read_id"), part.cast("int").alias("part"),
                                        F.expr("unix_timestamp(ts)").alias("pos"))


@query
def order_matrix(s, d):
    return align.order_matrix(align.adjacent_parts(event_hits(s, d), 3600), 20_000)


@query
def distance_histogram(s, d):
    return align.distance_histogram(align.adjacent_parts(event_hits(s, d), 3600))


@query
def relevant_distances(s, d):
    return align.relevant_pairs(align.distance_histogram(align.adjacent_parts(event_hits(s, d), 3600)), 400)


# --- alignment kernels ------------------------------------------------------

def turn_families(s, d):
    """Turns by conversation, and the first turn of each as the template of the others."""
    pieces = turn_pieces(s, d).select(F.col("read_id").alias("family"), "seq_id", F.coalesce("seq", F.lit("")).alias("seq"))
    return pieces, pieces.groupBy("family").agg(F.min_by("seq", "seq_id").alias("template"))


def document_families(s, d):
    """Documents by benchmark item, the numbers of the items taken in turn; the items are the templates."""
    items = with_ordinal(table(s, d, "benchmark").select("item_id", sequence.clean(F.col("text")).alias("template")), F.col("item_id"), name="family")
    family = F.pmod("read_id", F.greatest(F.lit(items.count()), F.lit(1))).alias("family")
    return document_reads(s, d).select(family, "read_id", F.coalesce("seq", F.lit("")).alias("seq")), items.select("family", F.coalesce("template", F.lit("")).alias("template"))


def aligned_turns(s, d):
    pieces, templates = turn_families(s, d)
    return cut_lineage(families.align_to_templates(pieces, templates, TEXT_ERROR)), templates


@query
def semi_global_align(s, d):
    return aligned_turns(s, d)[0].select("seq_id", "error", "cls", F.array_join(F.col("tpos").cast("array<string>"), ",").alias("tpos"))


@query
def gap_slot_layout(s, d):
    aligned, templates = aligned_turns(s, d)
    return families.slot_layout(families.gap_slots(aligned), templates)


@query
def matrix_layout(s, d):
    aligned, templates = aligned_turns(s, d)
    return families.build_matrices(aligned, families.slot_layout(families.gap_slots(aligned), templates))


@query
def approx_occurrences(s, d):
    return families.map_parts(*document_families(s, d), parts=ITEM_PARTS, max_error=0.45)


@query
def read_cuts(s, d):
    cut = families.cut_reads(*document_families(s, d), parts=ITEM_PARTS, max_error=0.45)
    return cut.select("read_id", F.posexplode("cuts").alias("piece", "cut"))


@query
def realign_round(s, d):
    """One round over the matrices of all conversations, row by row, with the default band."""
    return families.realign(matrix_layout(s, d), max_rounds=1)


@query
def realign_converged(s, d):
    """Rounds until no matrix of a conversation improves."""
    return families.realign(matrix_layout(s, d))
