"""Noisy sequences against one template: alignment, occurrences, read cutting, matrix layout.

The dynamic programmes run one sequence per step inside Arrow batches, vectorised over the other
axis; Spark spreads the sequences. The template is one sequence of bounded length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ordinal import with_ordinal
from skein.schema import check_width
from skein.session import spread

MAX_ERROR = 0.30  # fixed: alignment error from which a piece is no repeat instance


def template_of(records: DataFrame, order: str, seq: str = "seq") -> str:
    """All records concatenated in order; its length is checked before it is fetched."""
    total = records.agg(F.coalesce(F.sum(F.length(seq)), F.lit(0))).first()[0]
    check_width(total)
    return "".join(r[0] for r in records.orderBy(order).select(seq).collect())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("ascii", "replace"), dtype=np.uint8)


# --- semi-global alignment --------------------------------------------------

def _next_row(prev: np.ndarray, base: int, target: np.ndarray, ramp: np.ndarray) -> np.ndarray:
    """One row of unit edit costs; entry 0 is the column before the template."""
    row = np.empty_like(prev)
    row[0] = prev[0] + 1
    np.minimum(prev[:-1] + (target != base), prev[1:] + 1, out=row[1:])
    row -= ramp
    np.minimum.accumulate(row, out=row)
    row += ramp
    return row


def align_one(seq: str, template: str) -> tuple[np.ndarray, int]:
    """Template position per base (-1 = between two positions) and the edit distance.

    Template ends are free; of equally good ends the rightmost is taken. Walking back prefers the
    diagonal, then skipping a template position, then an inserted base. Only every sqrt(n)-th row is
    kept and the rows in between are computed again, so memory stays near sqrt(n) rows.
    """
    s, t = _codes(seq), _codes(template)
    n, m = len(s), len(t)
    position = np.full(n, -1, dtype=np.int32)
    if n == 0 or m == 0:
        return position, n
    ramp = np.arange(m + 1, dtype=np.int32)
    stride = int(np.ceil(np.sqrt(n)))
    kept = []
    row = np.zeros(m + 1, dtype=np.int32)
    for x in range(n):
        if x % stride == 0:
            kept.append(row)
        row = _next_row(row, s[x], t, ramp)
    tail = row[2:] if m > 1 else row[1:]
    best = int(tail.min())
    if m > 1 and row[m] == best:
        y = m
    else:
        y = m - int(np.argmin(tail[::-1])) if m > 1 else 1
    x = n
    while x > 0 and y > 0:
        first = (x - 1) // stride * stride
        block = [kept[first // stride][:y + 1]]
        short, short_ramp = t[:y], ramp[:y + 1]
        for i in range(first, x):
            block.append(_next_row(block[-1], s[i], short, short_ramp))
        while x > first and y > 0:
            here, above = block[x - first], block[x - first - 1]
            if here[y] == above[y - 1] + (s[x - 1] != t[y - 1]):
                x -= 1
                y -= 1
                position[x] = y
            elif here[y] == here[y - 1] + 1:
                y -= 1
            else:
                x -= 1
    return position, best


def align_to_template(seqs: DataFrame, template: str, max_error: float = MAX_ERROR) -> DataFrame:
    """``(seq_id, seq)`` to ``(seq_id, seq, tpos, error, cls)``; class r = repeat instance, l = other."""
    check_width(len(template))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [align_one(s, template) for s in batch["seq"]]
            error = [score / len(s) if s else 1.0 for (_, score), s in zip(found, batch["seq"])]
            yield batch.assign(tpos=[p for p, _ in found], error=error)

    return (spread(seqs.select("seq_id", "seq"))
            .mapInPandas(run, "seq_id BIGINT, seq STRING, tpos ARRAY<INT>, error DOUBLE")
            .withColumn("cls", F.when(F.col("error") < max_error, F.lit("r")).otherwise(F.lit("l"))))


# --- matrix layout ----------------------------------------------------------

def _inserted(tpos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slot and rank within the slot of every inserted base; slot s lies before template position s."""
    at = np.flatnonzero(tpos < 0)
    aligned = np.flatnonzero(tpos >= 0)
    if not len(at):
        return at, at
    if not len(aligned):
        return np.zeros(len(at), int), at
    before = np.searchsorted(aligned, at) - 1
    slot = np.where(before >= 0, tpos[aligned[np.maximum(before, 0)]] + 1, tpos[aligned[0]])
    run_start = np.where(before >= 0, aligned[np.maximum(before, 0)] + 1, 0)
    return slot, at - run_start


def gap_slots(aligned: DataFrame) -> DataFrame:
    """Longest inserted run per slot over all sequences."""
    def run(batches):
        for batch in batches:
            found = [_inserted(np.asarray(tpos)) for tpos in batch["tpos"]]
            slots, at = np.unique(np.concatenate([np.zeros(0, int), *(s for s, _ in found)]), return_inverse=True)
            longest = np.zeros(len(slots), dtype=np.int32)
            np.maximum.at(longest, at, np.concatenate([np.zeros(0, int), *(r for _, r in found)]).astype(np.int32) + 1)
            yield pd.DataFrame({"slot": slots.astype(np.int32), "width": longest})

    return (aligned.select("tpos").mapInPandas(run, "slot INT, width INT")
            .groupBy("slot").agg(F.max("width").alias("width")))


def slot_layout(slots: DataFrame, template_length: int) -> DataFrame:
    """First output column of each slot 0..T; a slot is its gap columns and one template column."""
    every = slots.sparkSession.range(0, template_length + 1).select(F.col("id").cast("int").alias("slot"))
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # one row per template position
    return (every.join(slots, "slot", "left").select("slot", F.coalesce("width", F.lit(0)).alias("width"))
            .select("slot", "width", F.coalesce(F.sum(F.col("width") + 1).over(before), F.lit(0)).alias("first_col")))


def build_matrix(aligned: DataFrame, template_length: int) -> tuple[DataFrame, int]:
    """Repeat instances as equally wide matrix rows ``(row_id, seq_id, symbols)``, and the width.

    Inserted bases are left-justified in their slot, everything without a base is a gap.
    """
    layout = slot_layout(gap_slots(aligned), template_length).orderBy("slot").collect()  # template sized
    first = np.array([r["first_col"] for r in layout], dtype=np.int64)
    widths = np.array([r["width"] for r in layout], dtype=np.int64)
    total = check_width(int(first[-1] + widths[-1] + 1))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines = []
            for seq, tpos in zip(batch["seq"], batch["tpos"]):
                tpos = np.asarray(tpos)
                line = np.full(total, ord("-"), dtype=np.uint8)
                chars = _codes(seq)
                on = tpos >= 0
                line[first[tpos[on]] + widths[tpos[on]]] = chars[on]
                slot, rank = _inserted(tpos)
                line[first[slot] + rank] = chars[~on]
                lines.append(line.tobytes().decode("ascii"))
            yield pd.DataFrame({"seq_id": batch["seq_id"], "symbols": lines})

    written = (aligned.where(F.col("cls") == "r").select("seq_id", "seq", "tpos")
               .mapInPandas(write, "seq_id BIGINT, symbols STRING"))
    return with_ordinal(written, F.col("seq_id"), name="row_id").select("row_id", "seq_id", "symbols"), total


# --- occurrences and cutting ------------------------------------------------

def last_scores(part: str, read: str) -> np.ndarray:
    """Edit distance of the part to the best stretch of the read ending at each position."""
    p, r = _codes(part), _codes(read)
    ramp = np.arange(len(r) + 1, dtype=np.int32)
    row = np.zeros(len(r) + 1, dtype=np.int32)
    for base in p:
        row = _next_row(row, base, r, ramp)
    return row[1:]


def occurrences(part: str, read: str, cutoff: int) -> list[int]:
    """End positions of approximate occurrences, rightmost first."""
    return hits_of(last_scores(part, read), len(part), cutoff) if read else []


def hits_of(score: np.ndarray, part_length: int, cutoff: int) -> list[int]:
    """End positions of the occurrences that the scores of all positions show, rightmost first.

    Each run of scores below the cutoff is one hit at its rightmost minimum; a run reaching the second
    position is open and dropped. A hit within half a part of the one before replaces it, unless a
    single position separates the runs and the new one is not better.
    """
    below = np.zeros(len(score) + 2, dtype=np.int8)
    below[2:-1] = score[1:] < cutoff
    edges = np.diff(below)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) - 1
    hits: list[int] = []
    prev_start, prev_min = None, None
    for a, b in zip(starts[::-1], ends[::-1]):
        if a <= 1:
            break
        run = score[a:b + 1]
        low = int(run.min())
        at = int(b - np.argmin(run[::-1]))
        if not hits or hits[-1] - at > part_length // 2:
            hits.append(at)
        elif prev_start - b > 2 or low < prev_min:
            hits[-1] = at
        prev_start, prev_min = a, low
    return hits


def choose_cuts(hits: dict[int, list[int]], parts: int, length: int, read_length: int, template_length: int) -> list[int]:
    """Cut positions of a read from the occurrences of template parts.

    Every mapped border part proposes a cut, kept when more than a part length away from both read
    ends. The first proposal within 1.5 template lengths is taken, then, as long as there is one, the first
    proposal between 0.5 and 1.5 template lengths later.
    """
    # fixed: proposing part, shift of its end to the border in part lengths
    borders = ((parts - 1, 0), (0, -1), (parts - 2, 1), (1, -2))
    proposals = [pos + shift * length for part, shift in borders for pos in sorted(hits.get(part, []))
                 if pos + shift * length > length and read_length - (pos + shift * length) > length]
    half, far = template_length // 2, template_length + template_length // 2
    cuts: list[int] = []
    following = next((c for c in proposals if c < far), None)
    while following is not None:
        cuts.append(following)
        following = next((c for c in proposals if cuts[-1] + half < c < cuts[-1] + far), None)
    return cuts


def map_parts(reads: DataFrame, template: str, parts: int = 60, overlap: int = 0, max_error: float = MAX_ERROR,
              which: tuple[int, ...] | None = None) -> DataFrame:
    """Occurrences ``(read_id, part, pos)`` of the first and last template part in every read."""
    step = len(template) // parts
    length = step + overlap
    cutoff = int(length * max_error)
    chosen = sorted({0, parts - 1}) if which is None else sorted(set(which))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [(rid, part, pos) for rid, seq in zip(batch["read_id"], batch["seq"]) for part in chosen
                   for pos in occurrences(template[part * step:part * step + length], seq, cutoff)]
            yield pd.DataFrame(out, columns=["read_id", "part", "pos"])

    return spread(reads.select("read_id", "seq")).mapInPandas(run, "read_id BIGINT, part INT, pos INT")


def cut_reads(reads: DataFrame, template: str, parts: int = 60, overlap: int = 0, max_error: float = MAX_ERROR) -> DataFrame:
    """Reads with their ascending ``cuts``."""
    step = len(template) // parts
    length = step + overlap
    cutoff = int(length * max_error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cuts = []
            for seq in batch["seq"]:
                hits = {p: occurrences(template[p * step:p * step + length], seq, cutoff) for p in {0, parts - 1}}
                cuts.append(choose_cuts(hits, parts, length, len(seq), len(template)))
            yield batch.assign(cuts=cuts)

    return spread(reads.select("read_id", "seq")).mapInPandas(run, "read_id BIGINT, seq STRING, cuts ARRAY<INT>")


def adjacent_parts(hits: DataFrame, length: int) -> DataFrame:
    """Neighbouring occurrences along each read with the gap between them."""
    w = Window.partitionBy("read_id").orderBy("pos", "part")
    return (hits.withColumns({"next_part": F.lead("part").over(w), "next_pos": F.lead("pos").over(w)})
            .where(F.col("next_part").isNotNull())
            .select("read_id", "part", "next_part", F.abs(F.col("pos") + length - F.col("next_pos")).alias("distance")))


def order_matrix(adjacent: DataFrame, wiggle: int = 150) -> DataFrame:
    """How often one part directly follows another."""
    return adjacent.where(F.col("distance") < wiggle).groupBy("part", "next_part").agg(F.count("*").alias("n"))


def distance_histogram(adjacent: DataFrame) -> DataFrame:
    """Gaps between neighbouring parts in buckets growing by half."""
    bucket = F.floor(F.ln(1 + F.col("distance")) / F.ln(F.lit(1.5))).alias("bucket")
    return adjacent.groupBy("part", "next_part", bucket).agg(F.count("*").alias("n"))


def relevant_pairs(histogram: DataFrame, min_count: int) -> DataFrame:
    """Histogram rows of part pairs seen more than ``min_count`` times."""
    total = F.sum("n").over(Window.partitionBy("part", "next_part"))
    return histogram.withColumn("total", total).where(F.col("total") > min_count)
