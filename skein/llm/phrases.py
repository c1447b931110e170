"""Phrase collocations by dynamic itemset counting.

Documents are dealt into shards, and shards are scanned in a cycle. Words are counted from the first scan on. A longer phrase is
counted from the scan after both its subphrases (all but the last, all but the first word) have reached the threshold, for one full
cycle, so every shard counts once for it; phrases of two, three and four words are thus counted side by side. The scans end when no
phrase is left that is open.

Which phrases are active is told by a clock: a byte for each of ``CELLS`` hash cells, or of more if the texts have many words (``MOST_CELLS`` at
most, which tasks and driver can hold), that holds the scan in which a phrase of the
cell reached the threshold, 0 before, and is never changed then. The scan of a phrase is the latest one of its two cells and of its subphrases, that
of an activation the later one of both subphrases; none of them changes once it is known, so every task knows in which scans to count a
phrase. Phrases that share cells can only be activated too early, which costs work and changes no count.
The clock is all that tasks get from the driver; running counts stay distributed.

Phrases are counted under hashes: 64 bits and, with the number of words, a check of 32 bits. Words enter both by hashes of their own.
The words of frequent phrases are read back from a sixteenth of the documents, those of the few others from the rest.

Cuts, scores and inclusions are joins of the frequent phrases; products are taken in DECIMAL(38,0). Ranks are taken per language after every task has kept its best.

Defined results: a null or empty text has no word; a null lang is ``und`` and joins a lang of that name; a lang without phrases has no row;
tied phrases are ordered by their bytes; a repeated row counts each time; an empty table gives an empty result. Other columns are ignored, doc_id too.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.llm.common import LOWER, mix, small_batches, text_chunks
from skein.session import cut_lineage, shared_folder

LONGEST = 4
SHARDS = 2
CELLS, MOST_CELLS = 1 << 22, 1 << 25
WORDS_A_CELL, CELLS_A_PHRASE = 32, 8  # beyond ``CELLS``; a phrase sets two, and a fuller clock lets more pass that are rare
HELD = 1 << 19  # counts a task holds before it emits them; bounds its memory, not the counts
SENT_ROWS = 1 << 15
COUNTS = "h bigint, mark bigint, n bigint"  # mark: scan of activation, words and check, packed

_SPLIT = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\n\x0b\x0c\r"])
_WORD = ~(_SPLIT | np.isin(np.arange(256), [0x20, 0x09]))
_A, _B = (np.array([pow(b, 2 * k + 3, 1 << 64) for k in range(LONGEST)], np.uint64) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Words:
    """Words of a chunk of texts: hash, second hash, byte span, row and piece."""

    def __init__(self, raw: np.ndarray, starts: np.ndarray, langs: np.ndarray):
        apart = np.insert(raw, starts[1:-1], 10)  # rows end pieces
        starts = starts[:-1] + np.arange(len(starts) - 1)
        padded = apart.tobytes().translate(LOWER) + b"\n" + bytes(8)
        self.raw = np.frombuffer(padded, np.uint8)
        inside = np.zeros(len(apart) + 2, np.int8)
        inside[1:-1] = _WORD[self.raw[:len(apart)]]
        edge = np.diff(inside)
        self.begin, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = self.end - self.begin
        self.row = np.searchsorted(starts, self.begin, "right") - 1
        # words are read eight bytes at a time
        eight = np.ndarray(len(padded) - 7, np.dtype("<u8"), padded, strides=(1,))
        self.lang = langs[self.row]
        word = self.lang ^ size.astype(np.uint64) * _A[0]
        second = word ^ _B[0]
        at, left = np.arange(len(size)), size
        step = 0
        while len(at):
            x = eight[self.begin[at] + 8 * step] & _MASKS[np.minimum(left, 8)]
            word[at] = mix(word[at] ^ x * _A[1])
            second[at] = (second[at] ^ x) * _B[1] ^ (second[at] >> np.uint64(29))
            longer = left > 8
            at, left, step = at[longer], left[longer] - 8, step + 1
        self.word, self.outer = word, mix(second)
        marks = np.flatnonzero(_SPLIT[self.raw[:len(apart)]])
        self.piece = np.searchsorted(marks, self.begin)

    def places(self, n: int) -> np.ndarray:
        """Where phrases of ``n`` words start."""
        return np.flatnonzero(self.piece[n - 1:] == self.piece[:max(len(self.piece) - n + 1, 0)])

    def hashes(self, n: int, at: np.ndarray) -> np.ndarray:
        return self._folded(self.word, _A, n, at)

    def checks(self, n: int, at: np.ndarray) -> np.ndarray:
        return (self._folded(self.outer, _B, n, at) >> np.uint64(32)).astype(np.uint32)

    @staticmethod
    def _folded(values: np.ndarray, by: np.ndarray, n: int, at: np.ndarray) -> np.ndarray:
        out = np.full(len(at), n, np.uint64)
        for k in range(n):
            out += values.take(at + k) * by[k]
        return mix(out)


class Clock:
    """When a phrase of a cell reached the threshold; travels packed, as most cells are empty or alike."""

    def __init__(self, cells: np.ndarray):
        self.cells = cells

    def __getstate__(self):
        return zlib.compress(self.cells.tobytes(), 1)

    def __setstate__(self, packed):
        self.cells = np.frombuffer(zlib.decompress(packed), np.uint8)


def _cells(h: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(cells - 1)).astype(np.int64), (h >> np.uint64(65 - cells.bit_length())).astype(np.int64)


def cells_for(wanted: int) -> int:
    """Cells of a clock that should have ``wanted``: a power of two."""
    return min(max(CELLS, 1 << max(int(wanted) - 1, 0).bit_length()), max(CELLS, MOST_CELLS))


def since(clock: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The scan in which the phrases reached the threshold, 0 if they have not."""
    a, b = _cells(h, len(clock))
    out = clock.take(a)
    both = np.flatnonzero(out)
    other = clock.take(b.take(both))
    out[both] = np.where(other > 0, np.maximum(out[both], other), 0)
    return out


def _chunks(batches):
    """Words of the texts, and their batch with the first row of the chunk."""
    for batch in batches:
        langs = batch.column("lang_hash").to_numpy().view(np.uint64)
        for first, raw, starts in text_chunks(batch.column("text")):
            yield Words(raw, starts, langs[first:first + len(starts) - 1]), batch, first


def _summed(h: np.ndarray, check: np.ndarray, n: np.ndarray | None):
    """Counts of equal (hash, check). Equal pairs apart from each other stay apart, which sums put right later."""
    order = np.argsort(h)
    h, check = h[order], check[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(h))) if n is None else np.add.reduceat(n[order], first)
    return h[first], check[first], count.astype(np.int64)


_LENGTH, _AT = 32, 40  # bits of a mark below the number of words and the scan of activation


def _batches(n: int, at: int, h: np.ndarray, check: np.ndarray, count: np.ndarray):
    """Counts of one length and activation as rows, some at a time."""
    for lo in range(0, len(h), SENT_ROWS):
        part = slice(lo, lo + SENT_ROWS)
        mark = check[part].astype(np.int64) | n << _LENGTH | at << _AT
        yield pa.RecordBatch.from_arrays([pa.array(h[part].view(np.int64)), pa.array(mark), pa.array(count[part])], ["h", "mark", "n"])


def _scan(clock, scan: int, shards: int, most: int):
    """Counts of a shard's phrases that are active in this scan, and as phrases of no word the words of a language.
    """
    def run(batches):
        known = clock.value.cells
        known_any = bool(known.any())
        held: dict[tuple[int, int], list] = {}
        sizes: dict[tuple[int, int], int] = {}
        totals: dict[int, int] = {}

        def emit(key):
            parts = held.pop(key)
            sizes[key] = 0
            return _summed(*(np.concatenate([p[k] for p in parts]) for k in range(3)))

        for words, _, _ in _chunks(batches):
            if not len(words.word):
                continue
            if scan <= shards:
                for lang, count in zip(*(x.tolist() for x in np.unique(words.lang, return_counts=True))):
                    totals[lang] = totals.get(lang, 0) + count
            shorter = np.zeros(0, np.uint8)  # when the phrases one word shorter reached the threshold, by their place
            for n in range(1, LONGEST + 1):
                if n == 1:
                    at, when = np.arange(len(words.word)), np.zeros(len(words.word), np.uint8)
                    take = at if scan <= shards else at[:0]
                else:
                    at = np.flatnonzero((shorter[:-1] > 0) & (shorter[1:] > 0))
                    at = at[words.piece[np.minimum(at + n - 1, len(words.piece) - 1)] == words.piece[at]]
                    when = np.maximum(shorter[at], shorter[at + 1])
                    take = np.flatnonzero((when < scan) & (when >= scan - shards))
                h = words.hashes(n, at)
                if len(take):
                    check, began = words.checks(n, at[take]), when[take]
                    for b in np.unique(began).tolist():
                        own, key = began == b, (n, int(b))
                        x, y = h[take][own], check[own]
                        held.setdefault(key, []).append(_summed(x, y, None) if n == 1 else (x, y, np.ones(len(x), np.int64)))
                        sizes[key] = sizes.get(key, 0) + len(held[key][-1][0])
                        if sizes[key] > most:
                            counts = emit(key)
                            if len(counts[0]) > most // 2:
                                yield from _batches(*key, *counts)
                            else:
                                held[key], sizes[key] = [counts], len(counts[0])
                if n == LONGEST or not known_any:
                    break
                reached = since(known, h)
                shorter = np.zeros(len(words.word), np.uint8)
                shorter[at] = np.where(reached > 0, np.maximum(reached, when), 0)
        for key in list(held):
            yield from _batches(*key, *emit(key))
        if totals:
            yield from _batches(0, 0, np.array(list(totals), np.uint64), np.zeros(len(totals), np.uint32), np.array(list(totals.values()), np.int64))
    return run


def _unset(clock):
    """Cells of frequent phrases that the clock does not hold yet."""
    def run(batches):
        known = clock.value.cells
        for batch in batches:
            cells = np.concatenate(_cells(batch.column("h").to_numpy().view(np.uint64), len(known)))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(cells[known[cells] == 0]).astype(np.int32))], ["cell"])
    return run


KEY = ["h", "mark"]


def _discard(spark, path: str) -> None:
    """Delete a table that this module has written and nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def count_phrases(docs: DataFrame, least: int, shards: int = SHARDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent phrases (h, mark, f), words per language (lang_hash, n) and the sharded texts; a mark is then words and check.

    Rare phrases leave the table of running counts as soon as their cycle is complete.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = shared_folder(spark, "phrases")
    (docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"),
                 F.monotonically_increasing_id().alias("_row"))
     .select("lang", F.xxhash64("lang").alias("lang_hash"), "text", F.expr(f"CAST(_row div {shards} % 16 AS INT)").alias("part"),
             (F.col("_row") % shards).cast("int").alias("shard"))
     .write.partitionBy("shard").parquet(f"{folder}/texts"))
    texts = spark.read.schema("lang string, lang_hash bigint, text string, part int, shard int").parquet(f"{folder}/texts")
    clock = np.zeros(CELLS, np.uint8)
    at, length = F.shiftright("mark", _AT), F.shiftright("mark", _LENGTH).bitwiseAND(255)
    table = None
    scan, last = 0, 0  # the last scan in which the clock was set
    while scan < (last + shards if last else shards):
        scan += 1
        if scan > 255:
            raise RuntimeError("a byte holds 255 scans; take fewer shards")
        sent = spark.sparkContext.broadcast(Clock(clock.copy()))
        found = texts.where(F.col("shard") == (scan - 1) % shards).select("lang_hash", "text").mapInArrow(_scan(sent, scan, shards, HELD), COUNTS)
        merged = (found if table is None else table.union(found)).groupBy("h", "mark").agg(F.sum("n").alias("n"))
        merged.where((F.col("n") >= least) | (at + shards > scan) | (length == 0)).write.parquet(f"{folder}/{scan}")
        table = spark.read.schema(COUNTS).parquet(f"{folder}/{scan}")
        if scan > 1:
            _discard(spark, f"{folder}/{scan - 1}")
        else:  # nothing is set yet
            words = table.where(length == 0).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * shards
            clock = np.zeros(cells_for(words // WORDS_A_CELL), np.uint8)
            sent.destroy()
            sent = spark.sparkContext.broadcast(Clock(clock.copy()))
        cells = table.where((F.col("n") >= least) & length.between(1, LONGEST - 1)).select("h").mapInArrow(_unset(sent), "cell int")
        cells = cells.distinct().toArrow()["cell"].to_numpy()  # at most the cells of the clock
        clock[cells] = scan
        last = scan if len(cells) else last
        sent.destroy()
    frequent = table.where((F.col("n") >= least) & (length > 0)).select("h", F.col("mark").bitwiseAND((1 << _AT) - 1).alias("mark"), F.col("n").alias("f"))
    frequent, words = cut_lineage(frequent), cut_lineage(table.where(length == 0).select(F.col("h").alias("lang_hash"), "n"))
    _discard(spark, f"{folder}/{scan}")
    return frequent, words, texts


def _named(clock):
    """Phrases of two words and more that may be frequent, with their words and the keys of their parts; a task emits one once or nearly."""
    def run(batches):
        known = clock.value.cells
        emitted = {n: np.zeros(0, np.uint64) for n in range(2, LONGEST + 1)}
        for words, batch, first in _chunks(batches):
            for n in range(2, LONGEST + 1):
                at = words.places(n)
                h = words.hashes(n, at)
                named = since(known, h) > 0
                at, h = at[named], h[named]
                h, once = np.unique(h, return_index=True)
                new = ~np.isin(h, emitted[n], assume_unique=True)
                at, h = at[once][new], h[new]
                if not len(at):
                    continue
                emitted[n] = np.union1d(emitted[n], h) if len(emitted[n]) < HELD else h  # bounds the memory
                spans = zip(*(x[at[:, None] + np.arange(n)].tolist() for x in (words.begin, words.end)))
                raw = words.raw
                text = [b" ".join([raw[a:b].tobytes() for a, b in zip(*x)]).decode("utf-8", "replace") for x in spans]
                places = [(k, m) for m in range(1, n) for k in range(n - m + 1)]
                parts = [np.concatenate(x) for x in zip(*((np.full(len(at), k, np.int32), words.hashes(m, at + k).view(np.int64),
                                                           words.checks(m, at + k).astype(np.int64) | m << _LENGTH) for k, m in places))]
                by_row = np.arange(len(at) * len(places)).reshape(len(places), -1).T.ravel()
                inner = pa.StructArray.from_arrays([pa.array(x[by_row]) for x in parts], ["at", "h", "mark"])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * len(places)), inner)
                lang = batch.column("lang").take(pa.array(first + words.row[at]))
                yield pa.RecordBatch.from_arrays([lang, pa.array(words.lang[at].view(np.int64)), pa.array(text), pa.array(h.view(np.int64)),
                                                  pa.array(words.checks(n, at).astype(np.int64) | n << _LENGTH), lists], ["lang", "lang_hash", "phrase", *KEY, "parts"])
    return run


_NAMED = "lang string, lang_hash bigint, phrase string, h bigint, mark bigint, parts array<struct<at int, h bigint, mark bigint>>"


def named_phrases(texts: DataFrame, frequent: DataFrame) -> DataFrame:
    """``frequent`` phrases of two words and more with lang, phrase and parts.

    Most are found in the first sixteenth of the texts; only for what is missing then the others are read.
    """
    spark = texts.sparkSession
    wanted, out = frequent.where(F.shiftright("mark", _LENGTH) > 1), None
    for share in (F.col("part") == 0, F.col("part") > 0):
        size = cells_for(CELLS_A_PHRASE * wanted.count())
        cells = wanted.select("h").mapInArrow(_unset(spark.sparkContext.broadcast(Clock(np.zeros(size, np.uint8)))), "cell int").distinct()
        clock = np.zeros(size, np.uint8)
        clock[cells.toArrow()["cell"].to_numpy()] = 1  # at most ``size``
        if not clock.any():
            break
        found = texts.where(share).select("lang", "lang_hash", "text").mapInArrow(_named(spark.sparkContext.broadcast(Clock(clock))), _NAMED)
        found = cut_lineage(found.join(wanted, KEY).dropDuplicates([*KEY, "phrase"]))  # the exact count decides
        wanted = cut_lineage(wanted.join(found.select(*KEY), KEY, "left_anti"))
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], _NAMED + ", f bigint") if out is None else out.select("lang", "lang_hash", "phrase", *KEY, "parts", "f")


def collocations(docs: DataFrame, least: int = 30, most: int | None = 2000, inside: float = 0.80, scale: int = 2_000_000,
                 shards: int = SHARDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best ``most`` phrases of every language of ``docs`` (lang, text); None: of all.

    A phrase goes if it lies in a longer one that has at least ``inside`` (in whole hundredths) of its occurrences.
    """
    frequent, words, texts = count_phrases(docs, least, shards)
    found = named_phrases(texts, frequent)
    words_of = lambda c: F.shiftright(c, _LENGTH)
    parts = found.select(F.col("h").alias("of"), F.col("mark").alias("of_mark"), F.col("f").alias("a"), F.inline("parts"))
    # the most occurrences of a longer phrase that a phrase lies in
    covered = parts.where(words_of("mark") > 1).groupBy(*KEY).agg(F.max("a").alias("_longer"))
    ends = parts.where((F.col("at") == 0) | (F.col("at") + words_of("mark") == words_of("of_mark"))).join(frequent, KEY)
    cut = F.when(F.col("at") == 0, words_of("mark")).otherwise(F.col("at"))  # a part is the first or the rest of the cut behind this word
    cuts = (ends.withColumn("cut", cut).groupBy("of", "of_mark", "cut")
            .agg(F.max(F.when(F.col("at") == 0, F.col("f"))).alias("l"), F.max(F.when(F.col("at") > 0, F.col("f"))).alias("r"), F.first("a").alias("a")))
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    scored = cuts.withColumn("score", F.expr(f"(CAST(a AS DECIMAL(18,0)) * CAST({scale} AS DECIMAL(19,0))) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))"))
    lowest = scored.groupBy(F.col("of").alias("h"), F.col("of_mark").alias("mark")).agg(
        F.min(F.struct("score", "cut", "l", "r")).alias("_cut"))
    gone = F.coalesce(exact("_longer") * 100 >= exact("f") * round(inside * 100), F.lit(False))
    best = (found.select(*KEY, "lang", "lang_hash", "phrase", "f").join(covered, KEY, "left").where(~gone).join(lowest, KEY)
            .select("lang", "lang_hash", "phrase", F.col("f").alias("a"), "_cut.l", "_cut.r", "_cut.score"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = best.withColumn("rank", F.row_number().over(order))
    ranked = ranked if most is None else ranked.where(F.col("rank") <= most)
    known = words if words.count() > 10_000 else F.broadcast(words)
    return ranked.join(known, "lang_hash").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n",
                                             F.col("score").cast("bigint").alias("score"))
