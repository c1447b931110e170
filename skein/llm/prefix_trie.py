"""The trie of conversation prefixes, from sorted conversations, their longest common prefixes and a sparse table.

A turn is a digest of role and text. Conversations are cut into segments of ``SEGMENT`` turns, each known by the digest of
all turns before it, and the segments are range-sorted by (that digest, their turns, conversation); a conversation of any
length and a first turn that all share are thus spread over tasks. Sorted rows are worked on in blocks. In a block the
longest common prefixes (LCP) of neighbours are taken, and a sparse table answers their range minima. Every prefix that is new at a row
is a candidate, and the two ends of the rows that share it are found apart from each other by binary search over the table; there
is no stack and no order among candidates. A node whose members reach over several blocks is the sum of its parts, joined by the digest
of the prefix, of which a block has as many as its first and its last row have turns.

Sums over subtrees are sums over members as well: what a node saves is charged to its smallest member, which is the smallest member
of all nodes below it on its path too. So a second run over the same blocks adds up the charges of the rows between the two ends.

Defined results: rows with a null conv_id belong to no conversation; null role or text counts as empty; of equal turn
numbers the smaller role comes first, then the smaller digest; rows that repeat are turns of their own; a conversation may be
left without a turn and is then a member of the root only; an empty table has no node. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import small_batches
from skein.llm.mixing import word_count
from skein.session import cut_lineage

SEGMENT = 1024
DIGEST = 16  # bytes
SENT = 10_000  # carried counts of more partitions than this are joined by a shuffle


# --- conversations as numbered turns -------------------------------------------

def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv, turn, role, digest, words) of every turn."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    whole = F.concat_ws(":", F.octet_length(role), role, text)  # the length keeps role and text apart
    return conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"),
        F.substring(F.sha2(whole, 256), 1, 2 * DIGEST).alias("digest"), word_count(text).alias("words"))


def shared_turns(conv, most: int):
    """How many turns of its group's conversation a conversation begins with."""
    return F.crc32(conv.cast("string").cast("binary")) % most if most else F.lit(0).cast("bigint")


def _numbered(batches):
    """Running numbers of a sorted partition: heads (source up to 0) and own turns (source 1) of a conversation so far."""
    last, heads, own = None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        conv, source = batch.column("conv").to_numpy(), batch.column("source").to_numpy()
        new = np.ones(n, bool)
        new[1:] = conv[1:] != conv[:-1]
        start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        out = []
        for mark, before in ((source <= 0, heads), (source == 1, own)):
            total = np.append(0, np.cumsum(mark))
            out.append(total[1:] - total[start] + np.where((start == 0) & (conv == last), before, 0))
        last, heads, own = conv[-1], out[0][-1], out[1][-1]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv", "source", "digest", "words")] + [pa.array(x) for x in out],
                                         ["conv", "source", "digest", "words", "heads", "own"])


def sequences(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """(conv, depth, digest, words) of the turns of rebuilt conversations, from depth 1.

    Conversation c takes the first h = crc32(c) % ``most`` turns of c - c % ``every`` and goes on with its own turns after its
    first h; with ``most`` 0 it stays as it is. Depth 0 is the start of each, and an empty digest stands behind its last turn.
    """
    turns = cut_lineage(turns_of(conversations))
    order = [F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]
    convs = turns.select("conv").distinct()
    nothing = [F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role")]
    rows = [turns.withColumn("source", F.lit(1)),
            *(convs.select("conv", *nothing, F.lit(d).alias("digest"), F.lit(0).cast("bigint").alias("words"), F.lit(s).alias("source"))
              for s, d in ((-1, "00" * DIGEST), (2, "")))]
    if most:
        first = (turns.withColumn("_at", F.row_number().over(Window.partitionBy("conv").orderBy(*order))).where(F.col("_at") < most)
                 .select(F.col("conv").alias("_base"), "_at", "digest", "words"))
        wanted = convs.select("conv", (F.col("conv") - F.col("conv") % every).alias("_base"), shared_turns(F.col("conv"), most).alias("_h"))
        rows.append(wanted.join(first, "_base").where(F.col("_at") <= F.col("_h")).select(
            "conv", F.col("_at").cast("bigint").alias("turn"), F.lit("").alias("role"), "digest", "words", F.lit(0).alias("source")))
    rows = [r.select("conv", "source", "turn", "role", "digest", "words") for r in rows]
    given = rows[0]
    for r in rows[1:]:
        given = given.union(r)
    keys = ["conv", "source", *order]
    placed = cut_lineage(given.repartitionByRange(*keys).sortWithinPartitions(*keys).select("conv", "source", "digest", "words")
                         .mapInArrow(_numbered, "conv bigint, source int, digest string, words bigint, heads bigint, own bigint")
                         .withColumn("part", F.spark_partition_id()))
    # a conversation that goes on in further partitions carries its counts there: a row a partition at most
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = (placed.groupBy("conv", "part").agg(F.max("heads").alias("heads"), F.max("own").alias("own"))
               .select("conv", "part", F.sum("heads").over(earlier).alias("_heads"), F.sum("own").over(earlier).alias("_own"))
               .where(F.col("_heads").isNotNull()))
    small = placed.rdd.getNumPartitions() <= SENT
    counted = placed.join(F.broadcast(carried) if small else carried, ["conv", "part"], "left")
    heads = F.col("heads") + F.coalesce("_heads", F.lit(0)) - 1  # without the start
    own = F.col("own") + F.coalesce("_own", F.lit(0)) - shared_turns(F.col("conv"), most)
    depth = (F.when(F.col("source") <= 0, heads).when(F.col("source") == 1, heads + own)
             .otherwise(heads + F.greatest(own, F.lit(0)) + 1))
    return counted.where((F.col("source") != 1) | (own > 0)).select("conv", depth.alias("depth"), "digest", "words")


# --- segments ----------------------------------------------------------------

def _chained(batches):
    """Digest of all turns before the segment that follows each full segment of a conversation."""
    last, prefix = None, b""
    for batch in batches:
        out = []
        for conv, segment, own in zip(*(batch.column(c).to_pylist() for c in ("conv", "segment", "own"))):
            prefix = hashlib.sha256((prefix if conv == last else b"") + own).digest()[:DIGEST]
            last = conv
            out.append((conv, segment + 1, prefix))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.binary()))],
                                         ["conv", "segment", "prefix"])


def segments_of(sequence: DataFrame, size: int = SEGMENT) -> DataFrame:
    """(segment, prefix, path, conv, ends, words), sorted: turns of a conversation, ``size`` at a time."""
    item = F.struct("depth", "digest", "words")
    cut = cut_lineage(
        sequence.groupBy("conv", F.expr(f"depth div {size}").alias("segment")).agg(F.array_sort(F.collect_list(item)).alias("_turns"))
        .select("conv", "segment", F.unhex(F.array_join(F.transform("_turns", lambda t: t["digest"]), "")).alias("path"),
                F.exists("_turns", lambda t: t["digest"] == "").alias("ends"),
                F.transform(F.filter("_turns", lambda t: t["digest"] != ""), lambda t: t["words"]).alias("words")))
    full = cut.where(F.octet_length("path") == size * DIGEST).select("conv", "segment", F.unhex(F.sha2("path", 256)).alias("own"))
    chain = (full.repartition("conv").sortWithinPartitions("conv", "segment")
             .mapInArrow(_chained, "conv bigint, segment bigint, prefix binary"))
    columns = ["segment", "prefix", "path", "conv", "ends", "words"]
    rows = cut.where("segment = 0").withColumn("prefix", F.lit(b"")).select(*columns).union(
        cut.where("segment > 0").join(chain, ["conv", "segment"]).select(*columns))
    return cut_lineage(rows.repartitionByRange("segment", "prefix", "path", "conv"))


SORTED = ["segment", "prefix", "path", "conv"]


# --- blocks --------------------------------------------------------------------

def sparse_table(values: np.ndarray) -> list[np.ndarray]:
    """Row p holds the minima of the 2**p values from each place on."""
    out = [values]
    while 2 ** len(out) <= len(values):
        half = 2 ** (len(out) - 1)
        out.append(np.minimum(out[-1][:-half], out[-1][half:]))
    return out


class Block:
    """Sorted rows: LCPs of neighbours, and the prefixes that are new at a row with the rows that share them."""

    def __init__(self, batch: pa.RecordBatch):
        self.segment = batch.column("segment").to_numpy()
        self.prefix, self.paths = (batch.column(c).to_pylist() for c in ("prefix", "path"))
        self.conv = batch.column("conv").to_numpy()
        n = len(self.conv)
        self.size = np.array([len(p) // DIGEST for p in self.paths], np.int64)
        self.start = np.append(0, np.cumsum(self.size))
        flat = np.frombuffer(b"".join(self.paths), np.uint64).reshape(-1, DIGEST // 8)
        # how many turns a row shares with the one before
        alike = np.zeros(n, np.int64)
        for i in range(1, n):
            if self.segment[i] == self.segment[i - 1] and self.prefix[i] == self.prefix[i - 1]:
                alike[i] = min(self.size[i], self.size[i - 1])
        row = np.repeat(np.arange(n), alike)
        at = np.arange(len(row)) - np.repeat(np.cumsum(alike) - alike, alike)
        differ = (flat[self.start[row] + at] != flat[self.start[row - 1] + at]).any(axis=1)
        self.lcp = alike
        np.minimum.at(self.lcp, row[differ], at[differ])
        self.table = sparse_table(self.lcp)
        fresh = self.size - self.lcp
        self.first = np.append(0, np.cumsum(fresh))  # candidates by row
        self.row = np.repeat(np.arange(n), fresh)
        self.at = np.arange(len(self.row)) - self.first[self.row] + self.lcp[self.row]
        self.left, self.right = self.leftmost(self.row, self.at), self.rightmost(self.row, self.at)

    def leftmost(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        """First row that shares the first ``at`` + 1 turns with ``row``."""
        x = row.copy()
        for p in reversed(range(len(self.table))):
            to = x - 2 ** p
            ok = to >= 0
            ok[ok] = self.table[p][to[ok] + 1] > at[ok]
            x[ok] = to[ok]
        return x

    def rightmost(self, row: np.ndarray, at: np.ndarray) -> np.ndarray:
        x = row.copy()
        for p in reversed(range(len(self.table))):
            to = x + 2 ** p
            ok = to < len(self.conv)
            ok[ok] = self.table[p][x[ok] + 1] > at[ok]
            x[ok] = to[ok]
        return x

    def least(self, values: np.ndarray) -> np.ndarray:
        """Smallest value between the ends of every candidate."""
        table = sparse_table(values)
        level = np.log2(self.right - self.left + 1).astype(np.int64)
        out = np.empty(len(level), values.dtype)
        for p in np.unique(level):
            own = level == p
            out[own] = np.minimum(table[p][self.left[own]], table[p][self.right[own] - 2 ** p + 1])
        return out

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sum of the values between the ends of every candidate."""
        sums = np.append(0, np.cumsum(values))
        return sums[self.right + 1] - sums[self.left]

    def keys(self) -> tuple[list[bytes], list[bytes | None], list[bytes]]:
        """Digests of the candidates and of their parents, and of the whole prefix at the end of every row."""
        own, parents, ends = [], [], []
        for i, (prefix, path) in enumerate(zip(self.prefix, self.paths)):
            running, begin = hashlib.sha256(), int(self.lcp[i])
            running.update(path[:max(begin - 1, 0) * DIGEST])
            key = prefix or None
            for j in range(max(begin - 1, 0), int(self.size[i])):
                running.update(path[j * DIGEST:(j + 1) * DIGEST])
                parent, key = key, hashlib.sha256(prefix + running.digest()).digest()[:DIGEST]
                if j >= begin:
                    own.append(key)
                    parents.append(parent)
            ends.append(key)
        return own, parents, ends


_PARTS = pa.schema([("key", pa.binary()), ("parent", pa.binary()), ("depth", pa.int64()), ("n", pa.int64()), ("conv", pa.int64()),
                    ("words", pa.int64()), ("piece", pa.string())])


def _counted(size: int):
    """Parts of nodes: how many rows of a block share a prefix. Rows with a ``piece`` list conversations that end in a node."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            block = Block(batch)
            own, parents, ends = block.keys()
            words = batch.column("words").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            columns = [pa.array(own, pa.binary()), pa.array(parents, pa.binary()), pa.array(block.segment[block.row] * size + block.at),
                       pa.array(block.right - block.left + 1), pa.array(block.least(block.conv)),
                       pa.array(words[block.start[block.row] + block.at] if len(own) else np.zeros(0, np.int64)), pa.nulls(len(own), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, schema=_PARTS)
            pieces: list[list] = []
            for key, conv, last in zip(ends, block.conv.tolist(), batch.column("ends").to_pylist()):
                if not last:
                    continue
                if not pieces or pieces[-1][0] != key:
                    pieces.append([key, conv, []])
                pieces[-1][2].append(str(conv))
            yield pa.RecordBatch.from_pylist([{"key": k, "conv": c, "piece": ",".join(p)} for k, c, p in pieces], schema=_PARTS)
    return run


def _summed(batches):
    """Parts of the sums over subtrees. ``at`` and ``value`` are what a row is charged with, ``later`` in later segments."""
    for batch in batches:
        if not batch.num_rows:
            continue
        block = Block(batch)
        n = len(block.conv)
        later, leaf = (batch.column(c).to_numpy() for c in ("later", "leaf"))
        counts = np.diff(np.asarray(batch.column("at").offsets))
        row = np.repeat(np.arange(n), counts)
        at, value = (batch.column(c).flatten().to_numpy() for c in ("at", "value"))
        charge = np.zeros(n, np.int64)
        np.add.at(charge, row, value)
        saved = block.total(later + charge)
        # what its members are charged with above a candidate is not its own; only the smallest member has such charges
        charged = np.flatnonzero(counts)
        sizes = block.size[charged]
        begin = np.zeros(n, np.int64)
        begin[charged] = np.cumsum(sizes) - sizes
        rows = np.repeat(charged, sizes)
        depth = np.arange(len(rows)) - begin[rows]
        above = np.zeros(len(rows), np.int64)
        inner = at + 1 < block.size[row]
        np.add.at(above, (begin[row] + at + 1)[inner], value[inner])  # counts from the turn below on
        above = np.cumsum(above)
        above -= above[begin[rows]]
        left = block.leftmost(rows, depth)
        np.subtract.at(saved, block.first[left] + depth - block.lcp[left], above)
        yield pa.RecordBatch.from_arrays([pa.array(block.keys()[0], pa.binary()), pa.array(saved), pa.array(block.total(leaf))],
                                         ["key", "saved", "leaves"])


def _hashed(batches):
    """SHA-256 of the pieces of every key, one after the other."""
    last, running = None, None
    for batch in batches:
        out = []
        for key, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist()):
            if key != last:
                if running:
                    out.append((last, running.hexdigest()))
                last, running = key, hashlib.sha256(piece.encode())
            else:
                running.update(b"," + piece.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.binary()), pa.array([r[1] for r in out], pa.string())], ["key", "ends_sha256"])
    if running:
        yield pa.RecordBatch.from_arrays([pa.array([last], pa.binary()), pa.array([running.hexdigest()])], ["key", "ends_sha256"])


def trie(conversations: DataFrame, every: int = 20, most: int = 4, size: int = SEGMENT) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    small_batches(conversations.sparkSession)
    rows = segments_of(sequences(conversations, every, most), size)
    parts = cut_lineage(rows.sortWithinPartitions(*SORTED).mapInArrow(
        _counted(size), "key binary, parent binary, depth bigint, n bigint, conv bigint, words bigint, piece string"))
    merged = cut_lineage(parts.where(F.col("piece").isNull()).groupBy("key").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.sum("n").alias("n"), F.min("conv").alias("conv"),
        F.first("words").alias("words")))
    children = merged.where(F.col("parent").isNotNull()).groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("children"))
    nodes = cut_lineage(merged.join(children, "key", "left"))
    value = (F.col("n") - 1) * F.col("words")
    charges = (nodes.where(value > 0).groupBy("conv", F.expr(f"depth div {size}").alias("segment"))
               .agg(F.collect_list(F.struct((F.col("depth") % size).alias("at"), value.alias("value"))).alias("_charges"), F.sum(value).alias("_own")))
    leaves = nodes.where(F.col("children").isNull()).select("conv", F.lit(1).cast("bigint").alias("leaf"))
    below = Window.partitionBy("conv").orderBy(F.desc("segment")).rowsBetween(Window.unboundedPreceding, -1)
    extras = (rows.select("conv", "segment").join(charges, ["conv", "segment"], "left").join(leaves, "conv", "left")
              .withColumn("later", F.coalesce(F.sum("_own").over(below), F.lit(0)))
              .select("conv", "segment", "later", F.coalesce("leaf", F.lit(0)).alias("leaf"),
                      *[F.coalesce(F.col(f"_charges.{k}"), F.array().cast("array<bigint>")).alias(k) for k in ("at", "value")]))
    charged = cut_lineage(rows.drop("words", "ends").join(extras, ["conv", "segment"]).repartitionByRange(*SORTED))
    sums = (charged.sortWithinPartitions(*SORTED).mapInArrow(_summed, "key binary, saved bigint, leaves bigint")
            .groupBy("key").agg(F.sum("saved").alias("saved_tokens"), F.sum("leaves").alias("n_leaves")))
    ends = (parts.where(F.col("piece").isNotNull()).select("key", "conv", "piece").repartition("key").sortWithinPartitions("key", "conv")
            .mapInArrow(_hashed, "key binary, ends_sha256 string"))
    above = nodes.select(F.col("key").alias("_key"), F.col("conv").alias("parent_conv_id"))
    whole = cut_lineage(nodes.join(sums, "key").join(ends, "key", "left"))
    return whole.join(above, F.col("parent") == F.col("_key"), "left").select(
        F.col("conv").alias("conv_id"), "depth", "parent_conv_id", F.col("n").alias("n_convs"),
        F.coalesce("children", F.lit(0)).cast("bigint").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))
