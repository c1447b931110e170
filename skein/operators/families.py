"""Alignment, layout and cutting by family: every sequence against the template of its own family key.

Sequences of a family meet its template in tasks of a bounded number of rows; a large family takes several, each with a copy of the
template, so the work grows with the table and no key decides how long a task is. A task aligns many sequences at once: one step of the
dynamic programme is one operation on all of them and all template positions, and so is a step of the walk back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ordinal import with_ordinal
from skein.operators import align
from skein.operators import realign as realign_one
from skein.operators.align import MAX_ERROR
from skein.operators.pairs import encode
from skein.schema import BASES, GAP, N_SYMBOLS, SYMBOLS
from skein.session import cut_lineage, many_tasks

ROWS_PER_TASK = 2_000
BATCH_CELLS = 1 << 23  # cells of a batch that are held at once


# --- one batch ---------------------------------------------------------------

def _padded(seqs: list[str]) -> np.ndarray:
    """Character codes of the sequences as rows, 0 behind their ends."""
    out = np.zeros((len(seqs), max(map(len, seqs))), np.uint8)
    for k, s in enumerate(seqs):
        out[k, :len(s)] = align._codes(s)
    return out


def _next_rows(prev: np.ndarray, bases: np.ndarray, target: np.ndarray, ramp: np.ndarray) -> np.ndarray:
    """:func:`align._next_row` for many sequences."""
    row = np.empty_like(prev)
    row[:, 0] = prev[:, 0] + 1
    np.minimum(prev[:, :-1] + (target[None, :] != bases[:, None]), prev[:, 1:] + 1, out=row[:, 1:])
    row -= ramp
    np.minimum.accumulate(row, axis=1, out=row)
    row += ramp
    return row


def align_batch(seqs: list[str], template: str) -> list[tuple[np.ndarray, int]]:
    """What :func:`align.align_one` finds for every sequence."""
    lengths, m = np.array([len(s) for s in seqs]), len(template)
    out = [(np.full(n, -1, np.int32), int(n)) for n in lengths]
    live = np.flatnonzero(lengths)
    if not m or not len(live):
        return out
    s, n, t = _padded([seqs[k] for k in live]), lengths[live], align._codes(template)
    ramp = np.arange(m + 1, dtype=np.int32)
    stride = int(np.ceil(np.sqrt(n.max())))
    kept, row = [], np.zeros((len(live), m + 1), np.int32)
    y, best = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
    for x in range(int(n.max())):
        if x % stride == 0:
            kept.append(row)
        row = _next_rows(row, s[:, x], t, ramp)
        ends = np.flatnonzero(n == x + 1)
        if len(ends):
            tail = row[ends, min(2, m):]
            best[ends] = tail.min(axis=1)
            y[ends] = m - np.argmin(tail[:, ::-1], axis=1)
    position = np.full(s.shape, -1, np.int32)
    x, every = n.copy(), np.arange(len(live))
    for first in range((int(n.max()) - 1) // stride * stride, -1, -stride):
        block = [kept[first // stride]]
        for i in range(first, min(first + stride, s.shape[1])):
            block.append(_next_rows(block[-1], s[:, i], t, ramp))
        block = np.stack(block)
        while len(at := every[(x > first) & (y > 0)]):
            px, py = x[at], y[at]
            here = block[px - first, at, py]
            diagonal = here == block[px - first - 1, at, py - 1] + (s[at, px - 1] != t[py - 1])
            skip = ~diagonal & (here == block[px - first, at, py - 1] + 1)
            position[at[diagonal], px[diagonal] - 1] = py[diagonal] - 1
            x[at[~skip]] -= 1
            y[at[diagonal | skip]] -= 1
    for k, to in enumerate(live):
        out[to] = position[k, :n[k]], int(best[k])
    return out


def last_scores_batch(part: str, reads: list[str]) -> list[np.ndarray]:
    """What :func:`align.last_scores` finds for every read."""
    r = _padded(reads) if reads else np.zeros((0, 0), np.uint8)
    ramp = np.arange(r.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(reads), r.shape[1] + 1), np.int32)
    for base in align._codes(part):
        nxt = np.empty_like(row)
        nxt[:, 0] = row[:, 0] + 1
        np.minimum(row[:, :-1] + (r != base), row[:, 1:] + 1, out=nxt[:, 1:])
        nxt -= ramp
        np.minimum.accumulate(nxt, axis=1, out=nxt)
        row = nxt + ramp
    return [row[k, 1:len(s) + 1] for k, s in enumerate(reads)]


# --- families as streams -------------------------------------------------------

def _streamed(rows: DataFrame, heads: DataFrame, work: Callable, schema: str, rows_per_task: int, cells: Callable) -> DataFrame:
    """``work(head, rows)`` for the rows of a family, some at a time; ``head`` is None for a family without one.

    ``rows(family, id, seq, tpos)`` and ``heads(family, head ARRAY<INT>, seq)``. ``cells(head, n, row)`` says
    how much n rows up to this one would take at once; rows come by length.
    """
    shares = rows.groupBy("family").agg(F.ceil(F.count("*") / rows_per_task).cast("int").alias("_shares"))
    columns = ["family", "share", "order", "id", "seq", "tpos", "head"]
    body = (rows.join(shares, "family").withColumn("share", F.pmod(F.xxhash64("id"), F.col("_shares")).cast("int"))
            .withColumns({"order": F.lit(1), "head": F.lit(None).cast("array<int>")}).select(*columns))
    first = (heads.join(shares, "family").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("_shares") - 1)))
             .withColumns({"order": F.lit(0), "id": F.lit(None).cast("bigint"), "tpos": F.lit(None).cast("array<int>")}).select(*columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, head, held = None, None, []
        for batch in batches:
            for row in batch.to_pylist():
                if (row["family"], row["share"]) != key or held and cells(head, len(held) + 1, row) > BATCH_CELLS:
                    if held:
                        yield work(key[0], head, held)
                    held = []
                if (row["family"], row["share"]) != key:
                    key, head = (row["family"], row["share"]), None
                if row["order"] == 0:
                    head = row
                else:
                    held.append(row)
        if held:
            yield work(key[0], head, held)

    keys = ["family", "share"]
    return first.union(body).repartition(many_tasks(rows.sparkSession), *keys).sortWithinPartitions(*keys, "order", F.length("seq")).mapInArrow(run, schema)


def _without(df: DataFrame, *names: str) -> DataFrame:
    kinds = {"tpos": "array<int>", "head": "array<int>"}
    return df.withColumns({n: F.lit(None).cast(kinds[n]) for n in names})


_ALIGNED = "family BIGINT, seq_id BIGINT, seq STRING, tpos ARRAY<INT>, error DOUBLE"


def align_to_templates(seqs: DataFrame, templates: DataFrame, max_error: float = MAX_ERROR, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """``seqs(family, seq_id, seq)`` against ``templates(family, template)``: also tpos, error and cls (r = repeat instance, l = other).

    A family without a template has an empty one; a null sequence counts as empty.
    """
    def work(family, head, rows):
        seqs = [r["seq"] for r in rows]
        found = align_batch(seqs, head["seq"] if head else "")
        error = [score / len(s) if s else 1.0 for (_, score), s in zip(found, seqs)]
        return pa.RecordBatch.from_arrays(
            [pa.array([family] * len(rows), pa.int64()), pa.array([r["id"] for r in rows], pa.int64()), pa.array(seqs, pa.string()),
             pa.array([p.tolist() for p, _ in found], pa.list_(pa.int32())), pa.array(error, pa.float64())], ["family", "seq_id", "seq", "tpos", "error"])

    def cells(head, n, row):
        return 2 * n * (int(np.sqrt(len(row["seq"]))) + 2) * (len(head["seq"]) + 1 if head else 1)

    rows = _without(seqs.select("family", F.col("seq_id").alias("id"), F.coalesce("seq", F.lit("")).alias("seq")), "tpos")
    heads = _without(templates.select("family", F.col("template").alias("seq")), "head")
    return (_streamed(rows, heads, work, _ALIGNED, rows_per_task, cells)
            .withColumn("cls", F.when(F.col("error") < max_error, F.lit("r")).otherwise(F.lit("l"))))


def gap_slots(aligned: DataFrame) -> DataFrame:
    """Longest inserted run per family and slot."""
    def run(batches):
        for batch in batches:
            found = [(f, *align._inserted(np.asarray(t, np.int64))) for f, t in zip(batch.column("family").to_pylist(), batch.column("tpos").to_pylist())]
            size = [len(s) for _, s, _ in found]
            join = lambda k, t: np.concatenate([np.zeros(0, t), *(f[k] for f in found)]).astype(t)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array([f for f, _, _ in found], np.int64), size)), pa.array(join(1, np.int32)),
                                              pa.array(join(2, np.int32) + 1, pa.int32())], ["family", "slot", "width"])

    return (aligned.select("family", "tpos").mapInArrow(run, "family BIGINT, slot INT, width INT")
            .groupBy("family", "slot").agg(F.max("width").alias("width")))


def slot_layout(slots: DataFrame, templates: DataFrame) -> DataFrame:
    """First output column of each slot 0..T of every family; a slot is its gap columns and one template column."""
    every = templates.select("family", F.explode(F.sequence(F.lit(0), F.length("template"))).alias("slot"))
    before = Window.partitionBy("family").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # one row per template position
    return (every.join(slots, ["family", "slot"], "left").select("family", "slot", F.coalesce("width", F.lit(0)).alias("width"))
            .select("family", "slot", "width", F.coalesce(F.sum(F.col("width") + 1).over(before), F.lit(0)).cast("int").alias("first_col")))


def build_matrices(aligned: DataFrame, layout: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Repeat instances as rows ``(family, seq_id, symbols)``, equally wide within a family.

    Inserted bases are left-justified in their slot, everything without a base is a gap.
    """
    def work(family, head, rows):
        first, widths = np.array(head["head"], np.int64).reshape(2, -1)
        lines = []
        for r in rows:
            line = np.full(int(first[-1] + widths[-1] + 1), ord("-"), np.uint8)
            tpos, chars = np.asarray(r["tpos"], np.int64), align._codes(r["seq"])
            on = tpos >= 0
            line[first[tpos[on]] + widths[tpos[on]]] = chars[on]
            slot, rank = align._inserted(tpos)
            line[first[slot] + rank] = chars[~on]
            lines.append(line.tobytes().decode("ascii"))
        return pa.RecordBatch.from_arrays([pa.array([family] * len(rows), pa.int64()), pa.array([r["id"] for r in rows], pa.int64()), pa.array(lines)],
                                          ["family", "seq_id", "symbols"])

    packed = layout.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("slot", "first_col", "width"))).alias("_l"))  # template sized
    heads = packed.select("family", F.concat(F.col("_l.first_col"), F.col("_l.width")).alias("head"), F.lit("").alias("seq"))
    rows = aligned.where(F.col("cls") == "r").select("family", F.col("seq_id").alias("id"), "seq", "tpos")
    return _streamed(rows, heads, work, "family BIGINT, seq_id BIGINT, symbols STRING", rows_per_task, lambda head, n, row: n * len(head["head"]))


# --- occurrences and cutting -----------------------------------------------------

def _hits(template: str, reads: list[str], parts: int, overlap: int, max_error: float) -> list[dict[int, list[int]]]:
    step = len(template) // parts
    length = step + overlap
    found: list[dict[int, list[int]]] = [{} for _ in reads]
    for p in sorted({0, parts - 1}):
        part = template[p * step:p * step + length]
        for k, score in enumerate(last_scores_batch(part, reads)):
            found[k][p] = align.hits_of(score, len(part), int(length * max_error)) if reads[k] else []
    return found


def _scan_cells(head, n, row):
    return 4 * n * len(row["seq"])


def map_parts(reads: DataFrame, templates: DataFrame, parts: int = 60, overlap: int = 0, max_error: float = MAX_ERROR,
              rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Occurrences ``(family, read_id, part, pos)`` of the first and last part of its family's template in every read."""
    def work(family, head, rows):
        found = _hits(head["seq"] if head else "", [r["seq"] for r in rows], parts, overlap, max_error)
        out = [(family, r["id"], p, pos) for r, hits in zip(rows, found) for p, at in hits.items() for pos in at]
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.int32()))],
                                          ["family", "read_id", "part", "pos"])

    rows = _without(reads.select("family", F.col("read_id").alias("id"), F.coalesce("seq", F.lit("")).alias("seq")), "tpos")
    heads = _without(templates.select("family", F.col("template").alias("seq")), "head")
    return _streamed(rows, heads, work, "family BIGINT, read_id BIGINT, part INT, pos INT", rows_per_task, _scan_cells)


def cut_reads(reads: DataFrame, templates: DataFrame, parts: int = 60, overlap: int = 0, max_error: float = MAX_ERROR,
              rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Reads ``(family, read_id, seq)`` with their ascending ``cuts``."""
    def work(family, head, rows):
        template = head["seq"] if head else ""
        length = len(template) // parts + overlap
        found = _hits(template, [r["seq"] for r in rows], parts, overlap, max_error)
        cuts = [align.choose_cuts(hits, parts, length, len(r["seq"]), len(template)) for r, hits in zip(rows, found)]
        return pa.RecordBatch.from_arrays([pa.array([family] * len(rows), pa.int64()), pa.array([r["id"] for r in rows], pa.int64()),
                                           pa.array([r["seq"] for r in rows]), pa.array(cuts, pa.list_(pa.int32()))], ["family", "read_id", "seq", "cuts"])

    rows = _without(reads.select("family", F.col("read_id").alias("id"), F.coalesce("seq", F.lit("")).alias("seq")), "tpos")
    heads = _without(templates.select("family", F.col("template").alias("seq")), "head")
    return _streamed(rows, heads, work, "family BIGINT, read_id BIGINT, seq STRING, cuts ARRAY<INT>", rows_per_task, _scan_cells)


# --- realignment -----------------------------------------------------------------

MOST_CELLS = 20_000_000  # of a matrix that one task realigns; larger ones are realigned by Spark, with the same result


def _profile(codes: np.ndarray) -> np.ndarray:
    """Counts by column of symbols 0..4, and of all."""
    n = np.stack([(codes == s).sum(axis=0) for s in range(N_SYMBOLS)], axis=1)
    return np.concatenate([n, n.sum(axis=1, keepdims=True)], axis=1).astype(np.int64)


def _tidied(codes: np.ndarray) -> np.ndarray:
    """Without columns that hold no base, and blank where a run of gaps meets a blank or the end of its row."""
    codes = codes[:, (codes < BASES).any(axis=0)].copy()
    for line in codes:
        at = np.flatnonzero(line < BASES)
        if not len(at):
            line[:] = N_SYMBOLS
            continue
        line[:at[0]] = line[at[-1] + 1:] = N_SYMBOLS
        for a, b in zip(at[:-1], at[1:]):
            if b > a + 1 and (line[a + 1:b] == N_SYMBOLS).any():
                line[a + 1:b] = N_SYMBOLS
    return codes


def _score(codes: np.ndarray) -> int:
    n = _profile(codes)
    return int((n[:, -1] ** 2).sum() - (n[:, :-1] ** 2).sum())


def realign_rows(codes: np.ndarray, band: int) -> np.ndarray:
    """Every row once, in order, against the profile of all others as they stand then."""
    codes = codes.copy()
    profile = _profile(codes)
    for k in range(len(codes)):
        width = codes.shape[1]
        columns, opened, _ = realign_one.place_row(codes[k], profile, band)
        bases = codes[k][codes[k] < BASES]
        extra = np.bincount(columns[opened], minlength=width)
        if extra.any():  # the others are blank in a new column if they are on either side of it
            owner = np.repeat(np.arange(width), extra + 1)
            old = np.append(True, owner[1:] != owner[:-1])
            right = np.minimum(owner + 1, width - 1)
            blank = (codes[:, owner] == N_SYMBOLS) | (codes[:, right] == N_SYMBOLS) | (owner == width - 1)
            codes = np.where(old, codes[:, owner], np.where(blank, N_SYMBOLS, GAP)).astype(codes.dtype)
        line = np.full(codes.shape[1], N_SYMBOLS, codes.dtype)
        if len(columns):
            key = columns * 2 + opened
            start = np.arange(width) + np.append(0, np.cumsum(extra)[:-1])
            at = start[columns] + np.where(opened, np.arange(len(key)) - np.searchsorted(key, key) + 1, 0)
            line[at[0]:at[-1]] = GAP
            line[at] = bases
        before = codes[k].copy()
        codes[k] = line
        if extra.any():
            profile = _profile(codes)
        else:
            for values, sign in ((before, -1), (line, 1)):
                at = np.flatnonzero(values < N_SYMBOLS)
                profile[at, values[at]] += sign
                profile[at, N_SYMBOLS] += sign
    return codes


def realign_matrix(codes: np.ndarray, band: int = realign_one.BAND, max_rounds: int = realign_one.MAX_ROUNDS) -> np.ndarray:
    """Rounds until the sum-of-pairs score stops improving, as :func:`realign.realign` does with single rows."""
    current = _tidied(codes)
    best, best_score = current, _score(current)
    for _ in range(max_rounds):
        current = realign_rows(current, band)
        score = _score(current)
        if score >= best_score:
            break
        best, best_score = current, score
    final = _tidied(current)
    return final if _score(final) < best_score else best


_CHARS = np.frombuffer((SYMBOLS + " ").encode(), np.uint8)


def realign(matrices: DataFrame, band: int = realign_one.BAND, max_rounds: int = realign_one.MAX_ROUNDS, most_cells: int = MOST_CELLS) -> DataFrame:
    """``matrices(family, seq_id, symbols)`` realigned, every family for itself and its rows in the order of their ids.

    A task takes a family as long as it has at most ``most_cells`` cells. Larger ones are realigned one after the other by Spark.
    """
    rows = cut_lineage(matrices.select("family", "seq_id", "symbols"))
    sizes = rows.groupBy("family").agg((F.count("*") * F.max(F.length("symbols"))).alias("_cells"))
    large = sizes.where(F.col("_cells") > most_cells).select("family")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(family, ids, lines):
            found = realign_matrix(encode(pd.Series(lines), max(map(len, lines))), band, max_rounds)
            return pa.RecordBatch.from_arrays([pa.array([family] * len(ids), pa.int64()), pa.array(ids, pa.int64()),
                                               pa.array([_CHARS[c].tobytes().decode() for c in found])], ["family", "seq_id", "symbols"])
        family, ids, lines = None, [], []
        for batch in batches:
            for f, i, line in zip(*(batch.column(c).to_pylist() for c in ("family", "seq_id", "symbols"))):
                if ids and f != family:
                    yield settled(family, ids, lines)
                    ids, lines = [], []
                family = f
                ids.append(i)
                lines.append(line)
        if ids:
            yield settled(family, ids, lines)

    out = (rows.join(large, "family", "left_anti").repartition(many_tasks(rows.sparkSession), "family").sortWithinPartitions("family", "seq_id")
           .mapInArrow(run, "family BIGINT, seq_id BIGINT, symbols STRING"))
    for family in [r.family for r in large.collect()]:
        own = cut_lineage(with_ordinal(rows.where(F.col("family") == family), F.col("seq_id"), name="row_id"))
        width = own.agg(F.max(F.length("symbols"))).first()[0]
        found, _, _ = realign_one.realign(own.select("row_id", "symbols"), width, 1, band, max_rounds)
        out = out.union(found.join(own.select("row_id", "family", "seq_id"), "row_id").select("family", "seq_id", "symbols"))
    return out
