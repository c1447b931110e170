"""Registered queries through stored text stages: written as several part files, then read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators import matrix
from skein.plans import queries as q
from skein.plans import tables
from skein.plans.tables import table
from skein.session import shared_folder
from skein.sources import text

PARTS = 5  # part files at least, so that numbering over files is exercised


def many_files(df: DataFrame, key: str) -> DataFrame:
    return df.repartitionByRange(PARTS, key)


@q.query
def fasta_round_trip(s, d):
    """Documents as wrapped FASTA records."""
    folder = shared_folder(s, "fasta")
    text.write_fasta(many_files(q.document_reads(s, d), "read_id"), "read_id", "seq", folder, wrap_at=100)
    return text.read_fasta(s, folder)


@q.query
def fasta_record_count(s, d):
    """Records of the benchmark as FASTA file."""
    folder = shared_folder(s, "fasta")
    text.write_fasta(table(s, d, "benchmark").select("item_id", F.lower("text").alias("seq")), "item_id", "seq", folder)
    return text.read_fasta(s, folder).agg(F.count("*").alias("records"))


@q.query
def matrix_round_trip(s, d):
    """Order lines as an alignment file; rows of the first row's width."""
    folder = shared_folder(s, "matrix")
    text.write_matrix(tables.order_rows(s, d), folder)
    rows = text.read_matrix(s, folder)
    return matrix.to_cells(matrix.same_width_rows(rows, matrix.matrix_width(rows)))


@q.query
def labels_round_trip(s, d):
    folder = shared_folder(s, "labels")
    text.write_labels(q.source_label(s, d), folder)
    return text.read_labels(s, folder)


@q.query
def correlations_round_trip(s, d):
    folder = shared_folder(s, "correlations")
    text.write_correlations(q.letter_max(s, d)[2], folder)
    return text.read_correlations(s, folder)


@q.query
def piece_map_round_trip(s, d):
    folder = shared_folder(s, "pieces")
    text.write_piece_map(q.sequence.read_piece_lists(q.turn_pieces(s, d)), folder)
    return text.read_piece_map(s, folder)


@q.query
def classes_round_trip(s, d):
    pieces = q.turn_pieces(s, d).select("seq_id", F.when(F.col("role") == "user", "l").otherwise("r").alias("cls"))
    folder = shared_folder(s, "classes")
    text.write_classes(pieces, folder)
    return text.read_classes(s, folder)


@q.query
def copies_round_trip(s, d):
    """Copy numbers per read, one integer per line."""
    folder = shared_folder(s, "copies")
    text.write_integers(q.source_copies(s, d), "row_id", "label", folder)
    return text.read_integers(s, folder, "copy")
