"""Readers for the headerless text files the stages exchange.

Line order is the identity of a record. Lines are numbered from the split they were read in, so files
of any size are read in parallel: only one (path, split, count) record per split is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ordinal import shifted
from skein.functions.sequence import clean


def numbered_lines(spark: SparkSession, path: str, line_sep: str | None = None, keep: Column | None = None,
                   headed: bool = False) -> DataFrame:
    """``(line_no, value)`` over the files of ``path`` in name and file order.

    Lines that fail ``keep`` use no number. With ``headed`` the first line of every file is none.
    """
    reader = spark.read if line_sep is None else spark.read.option("lineSep", line_sep)
    read = reader.text(path).select("value", "_metadata")
    lines = (read if keep is None else read.where(keep)).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_seq"))
    return shifted(lines, ["_file", "_start"], "_seq", "line_no", read.rdd.getNumPartitions(),
                   (F.col("_start") == 0).cast("int") if headed else None).select("line_no", "value")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """FASTA records ``(read_id, seq)``; headers and line breaks vanish, only acgt are kept.

    Splitting at ``>`` yields one record per row; what precedes the first ``>`` of a file is not a record.
    """
    body = F.regexp_replace("value", r"^[^\n]*(\n|$)", "")
    return numbered_lines(spark, path, ">", headed=True).select(F.col("line_no").alias("read_id"), clean(body).alias("seq"))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """Aligned rows ``(row_id, symbols)`` over ``acgt-`` and blank.

    The first line sets the width; lines of another width are skipped but keep the numbering of the
    kept rows consecutive.
    """
    lines = numbered_lines(spark, path)
    width = lines.where("line_no = 0").select(F.length("value")).first()
    if width is None:
        return spark.createDataFrame([], "row_id BIGINT, symbols STRING")
    decoded = F.regexp_replace(F.translate(F.lower("value"), "_", "-"), "[^acgt-]", " ")
    same = lines.where(F.length("value") == width[0]).select("line_no", decoded.alias("symbols"))
    if same.count() == lines.count():
        return same.withColumnRenamed("line_no", "row_id")
    from skein.functions.ordinal import with_ordinal
    return with_ordinal(same, F.col("line_no"), name="row_id").select("row_id", "symbols")


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """Label per row; blank lines and negative labels are NULL."""
    value = F.expr("try_cast(trim(value) as bigint)")
    return numbered_lines(spark, path).select(F.col("line_no").alias("row_id"), F.when(value >= 0, value).alias("label"))


def read_integers(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One integer per read, as written for placements and copy numbers."""
    return numbered_lines(spark, path).select(F.col("line_no").alias("read_id"), F.expr("try_cast(trim(value) as bigint)").alias(name))


def read_correlations(spark: SparkSession, path: str) -> DataFrame:
    """Maximum significance per group, one number per line, blank lines skipped."""
    lines = numbered_lines(spark, path, keep=F.trim("value") != "")
    return lines.select(F.col("line_no").alias("g"), F.expr("try_cast(trim(value) as double)").alias("z"))


def read_piece_map(spark: SparkSession, path: str) -> DataFrame:
    """Piece to read from lines of space-separated piece ids."""
    ids = F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "")
    return (numbered_lines(spark, path).select(F.col("line_no").alias("read_id"), F.explode(ids).alias("id"))
            .select(F.col("id").cast("bigint").alias("seq_id"), "read_id"))


def read_classes(spark: SparkSession, path: str) -> DataFrame:
    """Class per piece, one per line."""
    return numbered_lines(spark, path).select(F.col("line_no").alias("seq_id"), F.trim("value").alias("cls"))


# --- writers ----------------------------------------------------------------

def write_lines(df: DataFrame, order: str, value: str, path: str) -> None:
    """Text files whose name order is the row order (range-partitioned, not a single file)."""
    df.orderBy(order).select(F.col(value).cast("string").alias("value")).write.mode("errorifexists").text(path)


def write_fasta(df: DataFrame, order: str, seq: str, path: str, wrap_at: int | None = None) -> None:
    from skein.functions.sequence import wrap
    body = wrap(F.col(seq), wrap_at) if wrap_at else F.col(seq)
    write_lines(df.select(order, F.concat(F.lit(">\n"), body).alias("record")), order, "record", path)


def write_matrix(rows: DataFrame, path: str) -> None:
    """Matrix rows in upper case."""
    write_lines(rows.select("row_id", F.upper("symbols").alias("symbols")), "row_id", "symbols", path)


def write_correlations(max_z: DataFrame, path: str) -> None:
    """Six decimals per line, in group order."""
    write_lines(max_z.select("g", F.format_string("%f", "z").alias("text")), "g", "text", path)


def write_labels(labelled: DataFrame, path: str) -> None:
    """Label per row, -1 for rows without one."""
    write_lines(labelled.select("row_id", F.coalesce("label", F.lit(-1)).alias("label")), "row_id", "label", path)


def write_classes(pieces: DataFrame, path: str) -> None:
    """Class per piece, in the order of the pieces."""
    write_lines(pieces.select("seq_id", "cls"), "seq_id", "cls", path)


def write_integers(df: DataFrame, order: str, value: str, path: str) -> None:
    """One integer per row, such as a start or a copy number per read."""
    write_lines(df.select(order, value), order, value, path)


def write_piece_map(lists: DataFrame, path: str) -> None:
    """Space-separated piece ids per read."""
    text = F.array_join(F.transform("seq_ids", lambda x: x.cast("string")), " ")
    write_lines(lists.select("read_id", text.alias("ids")), "read_id", "ids", path)


def append_scores(spark: SparkSession, history: list[tuple[int, int, int]], path: str) -> None:
    """Append ``round score width`` records to a score table."""
    spark.createDataFrame(history, "round INT, score BIGINT, width INT").write.mode("append").parquet(path)
