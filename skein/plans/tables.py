"""Categorical matrices and sequences derived from the star-schema and text tables.

Every builder reads its whole table and whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import matrix
from skein.schema import SYMBOLS
from skein.session import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_cells(spark, sf_dir) -> DataFrame:
    """Row = order, column = line number, symbol = return flag (smallest if a line repeats)."""
    return (table(spark, sf_dir, "lineitem")
            .groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
            .select(F.col("l_orderkey").alias("row_id"), (F.col("l_linenumber") - 1).cast("int").alias("col"),
                    F.expr("instr('ANR', flag) - 1").alias("sym")))


def order_matrix(spark, sf_dir) -> tuple[DataFrame, int]:
    """Order rows and their width, the most lines an order has."""
    width = order_width(spark, sf_dir)
    return matrix.to_rows(order_cells(spark, sf_dir), width), width


def order_rows(spark, sf_dir) -> DataFrame:
    return order_matrix(spark, sf_dir)[0]


def order_width(spark, sf_dir) -> int:
    return table(spark, sf_dir, "lineitem").agg(F.max("l_linenumber")).first()[0] or 0


def _letter_classes(batches):
    """Symbols by the share of a..z in each text; one pass over its bytes."""
    for batch in batches:
        out = np.empty((batch.num_rows, LETTER_WIDTH), np.uint8)
        lengths = pc.utf8_length(batch.column("text")).to_pylist()
        for k, (n, text) in enumerate(zip(lengths, batch.column("text"))):
            if n is None:
                out[k] = len(SYMBOLS) - 1
                continue
            raw = text.as_buffer()
            data = np.frombuffer(raw, np.uint8)
            if any(x in raw.to_pybytes() for x in _FOLDED):
                data = np.frombuffer(text.as_py().lower().encode(), np.uint8)
            count = np.bincount(data, minlength=128)
            share = 1000 * (count[97:123] + count[65:91]) // max(n, 1)
            out[k] = np.where(share == 0, 0, 1 + np.searchsorted(_CLASSES, share, side="right"))
        symbols = np.frombuffer(SYMBOLS.encode(), np.uint8)[out]
        lines = [r.tobytes().decode() for r in symbols]
        yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(lines, pa.string())], ["row_id", "symbols"])


def letter_rows(spark, sf_dir) -> DataFrame:
    """Row = document, column = letter a..z, symbol = frequency class over the whole text."""
    docs = spread(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("bigint").alias("row_id"), "text"))
    return docs.mapInArrow(_letter_classes, "row_id bigint, symbols string")


LETTER_WIDTH = 26
_CLASSES = (15, 40, 80)  # thousandths of the text at which the next class begins
_FOLDED = ("\u0130".encode(), "\u212a".encode())  # beyond ASCII, only these become a..z in lower case


def line_rows(spark, sf_dir) -> DataFrame:
    """Row = document, column = line number, symbol = line length modulo 5; empty lines are blank.

    Rows keep their own length; use :func:`padded` where equal widths matter.
    """
    symbols = F.expr("transform(split(text, '\\n'), x -> IF(x = '', ' ', substring('%s', length(x) %% 5 + 1, 1)))" % SYMBOLS)
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("row_id"), F.array_join(symbols, "").alias("symbols"))


def padded(rows: DataFrame, width: int) -> DataFrame:
    return rows.withColumn("symbols", F.rpad("symbols", width, " "))


def event_cells(spark, sf_dir) -> DataFrame:
    """Row = user, column = day of the month, symbol = smallest event type of the day."""
    kinds = "'click     error     purchase  signup    view      '"
    return (table(spark, sf_dir, "events")
            .groupBy("user_id", F.dayofmonth("ts").alias("day")).agg(F.min("event_type").alias("kind"))
            .select(F.col("user_id").alias("row_id"), (F.col("day") - 1).cast("int").alias("col"),
                    F.expr(f"(instr({kinds}, kind) - 1) div 10").cast("int").alias("sym")))


def event_rows(spark, sf_dir) -> DataFrame:
    return matrix.to_rows(event_cells(spark, sf_dir), EVENT_WIDTH)


EVENT_WIDTH = 31  # days of a month
