"""Exact duplicates by a tree merge of sorted digest runs.

A text is digested once where it is read; from then on only digests, ids and counts travel. Every task's rows form a
sorted run in one of ``slots``, a power of ``FAN``. Runs are exchanged in rounds: in round r a run moves to the slot whose r-th
digit (base ``FAN``) is that of its digests, so ``FAN`` slots exchange with each other as in two rounds of a binomial tree. The
receiver merges the sorted runs that reach it and keeps, of equal digests, one entry with the best id and the number of rows.
Texts that are equal have shrunk to one entry a slot before they meet, so a text in a third of all rows is as
cheap as any other: at most one entry of a slot leaves it in any round. After the last round a digest lives in one slot only. The result
goes back the same way: first to the runs it came from, one entry a slot, then to the rows of the slot.

Runs are ordered by a 64-bit digest; entries with equal ones are only merged if SHA-256 and length of the texts agree as
well, at every level, so colliding digests stay apart.

Defined results: a null text equals an empty one; texts are compared as they are, in UTF-8; of rows with equal texts the largest
(or smallest) doc_id stays, null last; of rows with equal text and id exactly one stays; a group of null ids has a null keep_id; an empty table gives
an empty result. Other columns are ignored by ``groups`` and kept by ``keep_one``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.session import cut_lineage

FAN = 4
MOST_SLOTS = 4096  # more parallel tasks than this share slots; no entry is dropped
RUN = "slot int, digest bigint, sha binary, bytes bigint, id bigint, row bigint, n bigint"
_KEYS = ("digest", "sha", "bytes")
_NAMES = ["slot", *_KEYS, "id", "row", "n"]


def slot_count(df: DataFrame) -> int:
    spark = df.sparkSession
    wanted = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return min(FAN ** max(1, math.ceil(math.log(wanted, FAN) - 1e-9)), MOST_SLOTS)


def _merged(largest: bool):
    """Streams runs that are sorted by slot and digest: neighbours with equal digest, SHA-256 and length become one entry."""
    def merge(batch: pa.RecordBatch) -> pa.RecordBatch:
        slot, digest, sha = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("slot", "digest", "sha"))
        size, n = batch.column("bytes").to_numpy(), batch.column("n").to_numpy()
        new = np.ones(batch.num_rows, bool)
        new[1:] = (slot[1:] != slot[:-1]) | (digest[1:] != digest[:-1]) | (sha[1:] != sha[:-1]) | (size[1:] != size[:-1])
        first = np.flatnonzero(new)
        total = np.add.reduceat(n, first)
        known = np.asarray(batch.column("id").is_valid())
        ids, rows = batch.column("id").fill_null(0).to_numpy(), batch.column("row").to_numpy()
        # best id of a stretch, null last, then the first row: the last of a stretch after sorting by (stretch, id, row)
        order = np.lexsort((-rows, ids if largest else ~ids, known, np.cumsum(new)))
        best = order[np.append(first[1:], batch.num_rows) - 1]
        out = batch.take(pa.array(best))
        return pa.RecordBatch.from_arrays([out.column(c) for c in _NAMES[:-1]] + [pa.array(total)], _NAMES)

    def run(batches):
        held = None  # the last entry: it may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            batch = pa.RecordBatch.from_arrays([batch.column(c) for c in _NAMES], _NAMES)  # nullable, as merged ones are
            merged = merge(batch if held is None else pa.concat_batches([held, batch]))
            if merged.num_rows > 1:
                yield merged.slice(0, merged.num_rows - 1)
            held = merged.slice(merged.num_rows - 1)
        if held is not None:
            yield held
    return run


def _exchange(runs: DataFrame, slots: int, largest: bool, slot: Column | None = None) -> DataFrame:
    """Move runs to ``slot`` and merge what meets there."""
    moved = runs if slot is None else runs.withColumn("slot", slot.cast("int"))
    return cut_lineage(moved.repartitionById(slots, F.col("slot")).sortWithinPartitions("slot", *_KEYS)
                       .mapInArrow(_merged(largest), RUN))


def _digested(docs: DataFrame, text: str, id: str, slots: int) -> DataFrame:
    """(slot, digest, sha, bytes, id, row) of every row; slot and row are those of the task that read it."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(id).cast("bigint").alias("id"), whole.alias("_text")).select(
        F.pmod(F.spark_partition_id(), F.lit(slots)).alias("slot"), F.xxhash64("_text").alias("digest"),
        F.unhex(F.sha2(F.col("_text"), 256)).alias("sha"), F.octet_length("_text").cast("bigint").alias("bytes"), "id",
        F.monotonically_increasing_id().alias("row"))


def groups(docs: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "largest") -> DataFrame:
    """One row per row of ``docs``: id, keep_id, group_size, kept, text_sha256."""
    largest = {"largest": True, "smallest": False}[keep]
    slots = slot_count(docs)
    rows = cut_lineage(_digested(docs, text, id, slots))
    best = F.struct(F.col("id").isNotNull().alias("known"), (F.col("id") if largest else F.bitwise_not("id")).alias("by"),
                    (-F.col("row")).alias("row"))
    # the tasks that wrote the rows pre-aggregate them, so a run has one entry of each text
    runs = cut_lineage(rows.groupBy("slot", *_KEYS).agg(F.max(best).alias("best"), F.count("*").alias("n"))
                       .select("slot", *_KEYS, (F.col("best.by") if largest else F.bitwise_not("best.by")).alias("id"),
                               (-F.col("best.row")).alias("row"), "n"))
    merged = runs
    for r in range(round(math.log(slots, FAN))):
        unit = FAN ** r
        own, wanted = (F.pmod(F.floor(x / unit), F.lit(FAN)) for x in (F.col("slot"), F.pmod(F.col("digest"), F.lit(slots))))
        merged = _exchange(merged, slots, largest, F.col("slot") + (wanted - own) * unit)
    repeated = merged.where("n > 1").select(*_KEYS, F.col("id").alias("keep_id"), F.col("row").alias("_keep"), F.col("n").alias("group_size"))
    answered = runs.select("slot", *_KEYS).join(repeated, list(_KEYS))
    out = rows.join(answered, ["slot", *_KEYS], "left")
    single = F.col("group_size").isNull()
    return out.select(F.col("id").alias(id), F.when(single, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
                      F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
                      (single | (F.col("row") == F.col("_keep"))).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def keep_one(docs: DataFrame, text: str = "text", id: str = "doc_id", keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; of rows with equal text and id the one whose columns are first as JSON."""
    stay = groups(docs, text, id, keep).where("kept").select(F.col(id).alias("_id"), F.col("text_sha256").alias("_sha"))
    keyed = docs.withColumn("_sha256", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))
    found = keyed.join(stay, (F.col("_sha256") == F.col("_sha")) & F.col(id).eqNullSafe(F.col("_id")), "left_semi")
    others = [c for c in docs.columns if c != text]
    whole = F.struct(*[F.col(c) for c in docs.columns])
    return (found.groupBy("_sha256").agg(F.min_by(whole, F.to_json(F.struct(*others))).alias("_row")).select("_row.*"))
