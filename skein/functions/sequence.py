"""String operators on sequences, all built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.ordinal import running_sum, with_ordinal

LINE_WIDTH = 100   # fixed: FASTA line length


def clean(seq: Column) -> Column:
    """Lower case, everything outside the alphabet dropped."""
    return F.regexp_replace(F.lower(seq), "[^acgt]", "")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "acgtACGT", "tgcaTGCA"))


def wrap(seq: Column, width: int = LINE_WIDTH) -> Column:
    """Line breaks after every ``width`` characters; none after the last."""
    return F.regexp_replace(seq, "(.{%d})(?=.)" % width, "$1\n")


def prefix_in(piece: Column, read: Column, length: int | None = None) -> Column:
    """Whether a read contains a piece, or only its first ``length`` characters."""
    return F.contains(read, piece if length is None else F.substring(piece, 1, length))


def difference(a: Column, b: Column) -> Column:
    """Positions where two equal-width strings differ and neither is blank."""
    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""),
                                  lambda x, y: ((x != y) & (x != " ") & (y != " ")).cast("int")),
                       F.lit(0), lambda s, v: s + F.coalesce(v, F.lit(0)))


def template_parts(records: DataFrame, order: str, parts: int, overlap: int) -> DataFrame:
    """(part, seq): sections of the text that the records make in their order, each with the overlap into the next.

    The text is never put together: running sums say where a record stands, and a record gives each part what lies in it.
    """
    placed = with_ordinal(records.select(order, F.coalesce("seq", F.lit("")).alias("seq")), F.col(order), name="_n").withColumn("_len", F.length("seq").cast("bigint"))
    placed = running_sum(placed, "_n", "_len", "_end").withColumn("_start", F.col("_end") - F.col("_len"))
    step = F.lit((records.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0))).first()[0]) // parts)
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    low, high = F.greatest("_start", F.col("part") * step), F.least(F.col("_end"), F.col("part") * step + step + overlap)
    pieces = placed.select("*", part).where(high > low).select("part", "_start", F.substring(
        "seq", (low - F.col("_start") + 1).cast("int"), (high - low).cast("int")).alias("seq"))
    whole = pieces.groupBy("part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_start", "seq"))), lambda p: p["seq"]), "").alias("seq"))
    every = records.sparkSession.range(parts).select(F.col("id").cast("int").alias("part"))
    return every.join(whole, "part", "left").select("part", F.coalesce("seq", F.lit("")).alias("seq"))


def point_edit(seq: Column, position: Column, kind: Column, base: Column) -> Column:
    """Substitute (``sub``), delete (``del``) or insert before (``ins``) at a 0-based position."""
    head, tail = F.substring(seq, F.lit(1), position), F.substring(seq, position + 1, F.length(seq))
    return (F.when(kind == "sub", F.concat(head, base, F.substring(tail, F.lit(2), F.length(seq))))
            .when(kind == "del", F.concat(head, F.substring(tail, F.lit(2), F.length(seq))))
            .when(kind == "ins", F.concat(head, base, tail)).otherwise(seq))


def split_at_cuts(reads: DataFrame) -> DataFrame:
    """Reads with ``cuts ARRAY<INT>`` (ascending) into their pieces ``(read_id, piece, seq)``."""
    starts = F.concat(F.array(F.lit(0)), F.col("cuts"))
    ends = F.concat(F.col("cuts"), F.array(F.length("seq")))
    pieces = F.expr("transform(arrays_zip(starts, ends), x -> substring(seq, x.starts + 1, x.ends - x.starts))")
    return (reads.select("read_id", "seq", starts.alias("starts"), ends.alias("ends"))
            .select("read_id", F.posexplode(pieces).alias("piece", "seq")))


def number_pieces(pieces: DataFrame) -> DataFrame:
    """Running piece id over reads in order."""
    return with_ordinal(pieces, F.col("read_id"), F.col("piece"), name="seq_id")


def read_piece_lists(numbered: DataFrame) -> DataFrame:
    """Per read its piece ids in order: the numbers of a read are consecutive."""
    return (numbered.groupBy("read_id").agg(F.min("seq_id").alias("a"), F.max("seq_id").alias("b"))
            .select("read_id", F.sequence("a", "b").alias("seq_ids")))


def flanks(pieces: DataFrame) -> DataFrame:
    """Repeat pieces next to a non-repeat piece of the same read.

    ``pieces(seq_id, read_id, cls)``; joined on the neighbouring id, so a read of any length is
    spread over the cluster.
    """
    unique = pieces.where(F.col("cls") == "l")
    left = unique.select((F.col("seq_id") + 1).alias("seq_id"), "read_id", F.lit(True).alias("has_left"))
    right = unique.select((F.col("seq_id") - 1).alias("seq_id"), "read_id", F.lit(True).alias("has_right"))
    return (pieces.where(F.col("cls") == "r").select("seq_id", "read_id")
            .join(left, ["seq_id", "read_id"], "left").join(right, ["seq_id", "read_id"], "left")
            .select("seq_id", "read_id", F.coalesce("has_left", F.lit(False)).alias("has_left"),
                    F.coalesce("has_right", F.lit(False)).alias("has_right")))


def flank_labels(pieces: DataFrame, copies: DataFrame) -> DataFrame:
    """Copy of the read on either flank, NULL without that flank."""
    return (flanks(pieces).join(copies.select("read_id", "copy"), "read_id", "left")
            .select("seq_id", F.when(F.col("has_left"), F.col("copy")).alias("left_copy"),
                    F.when(F.col("has_right"), F.col("copy")).alias("right_copy")))


def row_copies(row_seq: DataFrame, pieces: DataFrame, copies: DataFrame) -> DataFrame:
    """Matrix row to its copy through piece and read."""
    return (row_seq.join(pieces.select("seq_id", "read_id"), "seq_id").join(copies, "read_id")
            .select("row_id", F.col("copy").alias("label")))


def repeat_rows(seq_class: DataFrame) -> DataFrame:
    """Pieces of class ``r`` in order are the rows of the matrix."""
    return with_ordinal(seq_class.where(F.col("cls") == "r").select("seq_id"), F.col("seq_id"), name="row_id")
