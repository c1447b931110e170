"""Helpers shared by the operators: tables, folds, word hashes, streamed groups, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import cut_lineage, merged

CHUNK_BYTES = 1 << 19  # text that is hashed at once; a longer text makes a chunk of its own
BATCH_ROWS = 1000

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
_ALNUM = [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]
NOT_WORD = ~np.isin(np.arange(256), _ALNUM)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts may be long: hand them to Python in batches of few rows."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def bounded_sample(df: DataFrame, key: Column, most: int) -> DataFrame:
    """About ``most`` rows at most, chosen by a hash of ``key``: the same rows in every run."""
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(key), F.lit(1 << 20)) < int((1 << 20) * most / n))


# --- words as hashes ---------------------------------------------------------

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int):
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_BASE, _INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row starts within the bytes and their end) of slices of a string column; null as empty."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    n = len(column)
    if not n:
        return
    at = np.frombuffer(offsets, np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(int(np.searchsorted(at, at[first] + CHUNK_BYTES, "right")) - 1, first + 1)
        yield first, raw[at[first]:at[last]], at[first:last + 1] - at[first]
        first = last


def hashed_words(raw: np.ndarray, starts: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of a chunk, A-Z lower-cased, and for every row the index of its first word.

    ``gap`` marks the byte values that part words. Words with equal bytes have equal hashes.
    """
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    raw = np.frombuffer(raw.tobytes().translate(LOWER), np.uint8)
    inside = ~gap[raw]
    before = np.zeros(len(raw), bool)
    before[1:] = inside[:-1]
    edges = starts[starts < len(raw)]
    before[edges] = False  # a row starts
    begin = np.flatnonzero(inside & ~before)
    after = np.zeros(len(raw), bool)
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    end = np.flatnonzero(inside & ~after) + 1
    power, inverse = _power_tables(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:len(raw)], out=total[1:])
    words = mix((total[end] - total[begin]) * inverse[begin] ^ (end - begin).astype(np.uint64))
    return words, np.searchsorted(begin, starts)


# --- groups as streams -------------------------------------------------------

def grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables of equal keys out of batches that are sorted by ``keys``; one group is in memory at a time."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
        cuts = [*np.flatnonzero(change), batch.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(batch.column(k)[int(lo)].as_py() for k in keys)
            if held and key != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(int(lo), int(hi - lo)))
            held_key = key
    if held:
        yield pa.Table.from_batches(held)


class Union:
    """Disjoint sets over 0..n-1; the root is the smallest member."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.up))], np.int64)


def _contracted(batches):
    """Spanning stars of the edges a task holds."""
    found: dict[int, int] = {}

    def root(x):
        path = []
        while (up := found.setdefault(x, x)) != x:
            path.append(x)
            x = up
        for p in path:
            found[p] = x
        return x

    def stars():
        nodes = np.fromiter(found, np.int64, len(found))
        roots = np.fromiter((root(int(x)) for x in nodes), np.int64, len(nodes))
        keep = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            if a != b:
                found[max(a, b)] = min(a, b)
        if len(found) > 500_000:  # bounds the memory, not the edges
            yield stars()
            found.clear()
    yield stars()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the BIGINT edges (a, b); the root is the smallest node reachable.

    Tasks first contract the edges they hold. Then large-star and small-star rounds link neighbours to the
    smallest neighbour until every node hangs on its root. Hubs are split: minima combine on the map side and
    the join with them can be split by adaptive execution. Every round is checkpointed.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b")
    stars = cut_lineage(edges.mapInArrow(_contracted, "a bigint, b bigint").distinct())
    state = None
    for _ in range(most_rounds):
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
                stars.select("b", "b").distinct())
        state = tuple(now)
        both = stars.union(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = cut_lineage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(merged(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = cut_lineage(large)
        least = cut_lineage(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(merged(least), "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(
            least.select("a", "m"))
        stars = cut_lineage(small.where("a > b").distinct())
    raise RuntimeError("components did not settle")


_ORDER = np.array([pow(_BASE, 2 * k + 3, 1 << 64) for k in range(64)], np.uint64)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of every run of ``size`` words; of all words if there are fewer."""
    if not len(words):
        return words
    k = min(size, len(words))
    total = np.full(len(words) - k + 1, k, np.uint64)
    for i in range(k):
        total += words[i:len(words) - k + 1 + i] * _ORDER[i]
    return mix(total)


def words_of(text: str | None, gap: np.ndarray = BLANK) -> np.ndarray:
    """Word hashes of one text."""
    raw = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
    return hashed_words(raw, np.array([0, len(raw)]), gap)[0]
