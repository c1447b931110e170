"""Symbols, sentinels and table schemas shared by all operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
SYMBOLS = "acgt-"  # codes 0..4; a blank cell (code 5) is a missing long-format row
BLANK = " "
GAP = 4
BASES = 4
N_SYMBOLS = 5
UNLABELLED = -1  # label of a row outside a window, only written at sinks
# ----------------------------------------------------------------------------

# Anything shipped to executors whole (profiles, column masks, clique tables) is
# proportional to the number of matrix columns, never to the number of rows.
MAX_WIDTH = 2_000_000

READS = "read_id BIGINT, seq STRING"
MSA = "row_id BIGINT, symbols STRING"
CELLS = "row_id BIGINT, col INT, sym INT"


def check_width(width: int) -> int:
    """Guard for data sized by matrix width that is about to be shipped to executors."""
    if width > MAX_WIDTH:
        raise ValueError(f"matrix has {width} columns, more than the supported {MAX_WIDTH}")
    return width


def symbol_code(ch: Column) -> Column:
    """Symbol character to 0..4, NULL for a blank (case-insensitive, ``_`` equals ``-``)."""
    pos = F.instr(F.lit(SYMBOLS), F.translate(F.lower(ch), "_", "-"))
    return F.when((F.length(ch) == 1) & (pos > 0), pos - 1)


def symbol_char(code: Column, upper: bool = False) -> Column:
    """Code 0..4 to its character; NULL becomes a blank."""
    symbols = SYMBOLS.upper() if upper else SYMBOLS
    return F.when(code.isNull(), F.lit(BLANK)).otherwise(F.substring(F.lit(symbols), code.cast("int") + 1, F.lit(1)))


def group_id(col: Column, sym: Column) -> Column:
    """Identifier of the row group carrying ``sym`` in ``col``."""
    return (col * N_SYMBOLS + sym).cast("bigint")
