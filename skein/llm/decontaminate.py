"""Find passages of benchmark items in documents by spaced-seed hashing.

A mask says which of a few consecutive words are hashed and which may differ. Every masked window of the benchmark
is a seed; every masked window of a document is looked up among the seeds. A hit fixes how item and document lie
beside each other, and that alignment is verified word by word: of all stretches of which ``LEAST_SHARE`` of the words
match, the one with most matches is a finding if these are enough. The masks miss none: between substitutions such a
stretch holds four equal words in a row, or three and then two or three, parted by one substitution.

Benchmarks of any size are cut into slices of about ``SLICE_WORDS`` words; every slice is one broadcast index and one pass over the
documents, which are not shuffled. Words are runs of letters and digits, lower-cased.

Defined results: a null or empty text has no findings; items of fewer than ``LEAST_ITEM`` words are no evidence and
are never found; a null item_id or doc_id is reported as null; repeated rows are found again; a document may hold several
items, and an item is reported once per document, where most of its words match; empty tables give empty results.
Columns other than those named are ignored by ``find`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import _ORDER, NOT_WORD, hashed_words, mix, small_batches, text_chunks
from skein.session import cut_lineage

#: 1: the word is hashed, 0: it may differ.
MASKS = ("1111", "111011")
LEAST_ITEM = 6
LEAST_MATCHED = 13  # words, or LEAST_SHARE of the item if that is less
LEAST_SHARE = 0.8
SUBSTITUTION = -4  # beside 1 for a match, stretches of LEAST_SHARE are those with a sum of 0 or more
VERIFIED_WORDS = 4_000_000  # pairs of words that are compared at once
SLICE_WORDS = 400_000


def least_matched(size: int) -> int:
    """Words of an item that must match."""
    return min(LEAST_MATCHED, max(int(np.ceil(LEAST_SHARE * size)), LEAST_ITEM))


def masked(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked window at every position where it fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, int(mask, 2), np.uint64)
    for k, c in enumerate(mask):
        if c == "1":
            total += words[k:k + n] * _ORDER[k]
    return mix(total)


@dataclass
class Index:
    """Seeds of a slice of items, sorted by hash."""

    ids: list
    words: list[np.ndarray]
    seeds: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # per mask: hashes, items, positions
    filters: list[np.ndarray]

    @staticmethod
    def of(items: list[tuple]) -> Index:
        ids, texts = [i for i, _ in items], pa.array([t or "" for _, t in items], pa.string())
        words = []
        for _, raw, starts in text_chunks(pc.utf8_lower(texts)):
            every, at = hashed_words(raw, starts, NOT_WORD)
            words += [every[a:b] for a, b in zip(at, at[1:])]
        seeds, filters = [], []
        for mask in MASKS:
            found = [(k, masked(w, mask)) for k, w in enumerate(words) if len(w) >= LEAST_ITEM]
            h = np.concatenate([np.zeros(0, np.uint64), *(s for _, s in found)])
            item = np.concatenate([np.zeros(0, np.int64), *(np.full(len(s), k) for k, s in found)])
            place = np.concatenate([np.zeros(0, np.int64), *(np.arange(len(s)) for _, s in found)])
            order = np.argsort(h, kind="stable")
            seeds.append((h[order], item[order], place[order]))
            bits = np.zeros(1 << max(18, int(len(h) * 16).bit_length()), bool)
            bits[(h & np.uint64(len(bits) - 1)).astype(np.int64)] = True
            filters.append(bits)
        return Index(ids, words, seeds, filters)

    def findings(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(row, item, first word, word after the last, matches, substitutions) of a column of texts."""
        for first, raw, starts in text_chunks(pc.utf8_lower(column)):
            words, at = hashed_words(raw, starts, NOT_WORD)
            aligned = self._enough(words, at, self._alignments(words, at))
            best: dict[tuple[int, int], tuple] = {}
            for row, item, shift in aligned.tolist():
                found = self._verified(words[at[row]:at[row + 1]], self.words[item], shift)
                if found and (found[2], -found[0]) > (best.get((row, item), (0, 0, 0))[2], -best.get((row, item), (0, 0, 0))[0]):
                    best[row, item] = found
            for (row, item), found in best.items():
                yield (first + row, item, *found)

    def _alignments(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct (row, item, document position of the item's first word) that a seed proposes."""
        out = [np.zeros((0, 3), np.int64)]
        for mask, (hashes, items, places), bits in zip(MASKS, self.seeds, self.filters):
            if not len(hashes):
                continue
            own = masked(words, mask)
            here = np.flatnonzero(bits[(own & np.uint64(len(bits) - 1)).astype(np.int64)])
            lo, hi = np.searchsorted(hashes, own[here], "left"), np.searchsorted(hashes, own[here], "right")
            here, lo, n = here[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            if not len(here):
                continue
            row = np.searchsorted(at, here, "right") - 1
            inside = here + len(mask) <= at[row + 1]  # the window stays in one text
            here, lo, n, row = here[inside], lo[inside], n[inside], row[inside]
            seed = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else n
            out.append(np.unique(np.stack([np.repeat(row, n), items[seed], np.repeat(here - at[row], n) - places[seed]], axis=1), axis=0))
        return np.unique(np.concatenate(out), axis=0)

    def _enough(self, words: np.ndarray, at: np.ndarray, aligned: np.ndarray) -> np.ndarray:
        """Alignments in which enough words match, in one stretch or not."""
        size = np.array([len(w) for w in self.words], np.int64)
        starts, every = np.concatenate([[0], np.cumsum(size)]), np.concatenate([np.zeros(0, np.uint64), *self.words])
        row, item, shift = aligned.T
        first, n = np.maximum(shift, 0), np.minimum(shift + size[item], (at[1:] - at[:-1])[row]) - np.maximum(shift, 0)
        least = np.array([least_matched(k) for k in size.tolist()], np.int64)[item]
        own, other, keep = at[row] + first, starts[item] + first - shift, np.zeros(len(aligned), bool)
        sums, lo = np.concatenate([[0], np.cumsum(n)]), 0
        while lo < len(aligned):
            hi = max(int(np.searchsorted(sums, sums[lo] + VERIFIED_WORDS, "right")) - 1, lo + 1)
            inside = np.arange(sums[hi] - sums[lo]) - np.repeat(sums[lo:hi] - sums[lo], n[lo:hi])
            equal = words[np.repeat(own[lo:hi], n[lo:hi]) + inside] == every[np.repeat(other[lo:hi], n[lo:hi]) + inside]
            keep[lo:hi] = np.add.reduceat(equal, sums[lo:hi] - sums[lo], dtype=np.int64) >= least[lo:hi]
            lo = hi
        return aligned[keep]

    @staticmethod
    def _verified(doc: np.ndarray, item: np.ndarray, shift: int):
        """Stretch of an alignment with most matches: (first word, end, matches, substitutions) or None."""
        a, b = max(shift, 0), min(shift + len(item), len(doc))
        if b - a < LEAST_ITEM:
            return None
        equal = doc[a:b] == item[a - shift:b - shift]
        total = np.concatenate([[0], np.cumsum(np.where(equal, 1, SUBSTITUTION))])
        count = np.concatenate([[0], np.cumsum(equal)])
        start = np.searchsorted(-np.minimum.accumulate(total), -total)  # the first from which the sum is not negative
        end = int(np.argmax(count - count[start]))
        at = np.flatnonzero(equal[start[end]:end]) + start[end]
        if len(at) < least_matched(len(item)):
            return None
        start, end = int(at[0]), int(at[-1]) + 1
        return a + start, a + end, len(at), end - start - len(at)


def slices(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of bounded size that cover the benchmark; a longer item makes a larger slice."""
    items = cut_lineage(benchmark.select("item_id", "text").withColumn(
        "_words", F.coalesce(F.regexp_count("text", F.lit(r"[0-9A-Za-z\x{80}-\x{10FFFF}]+")), F.lit(0))))
    total = items.agg(F.sum("_words")).first()[0] or 0
    n = -(-total // SLICE_WORDS)
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield Index.of([tuple(r) for r in part.select("item_id", "text").orderBy("item_id", "text").toLocalIterator()])


FINDINGS = "doc_id bigint, item_id bigint, start_word int, end_word int, matched int, substituted int, coverage double"


def _found(shared):
    def run(batches):
        index = shared.value
        for batch in batches:
            cols = list(zip(*index.findings(batch.column(1)))) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array([index.ids[k] for k in cols[1]], pa.int64()),
                 *(pa.array(c, pa.int32()) for c in cols[2:6]),
                 pa.array([m / len(index.words[k]) for k, m in zip(cols[1], cols[4])], pa.float64())],
                [c.split()[0] for c in FINDINGS.split(", ")])
    return run


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item found in it. ``docs``: doc_id, text; ``benchmark``: item_id, text."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    out = spark.createDataFrame([], FINDINGS)
    for index in slices(benchmark):
        out = out.union(texts.mapInArrow(_found(spark.sparkContext.broadcast(index)), FINDINGS))
    return out


def _hit(shared):
    @F.pandas_udf("boolean")
    def hit(texts: pd.Series) -> pd.Series:
        out = np.zeros(len(texts), bool)
        out[list({f[0] for f in shared.value.findings(pa.array(texts, pa.string(), from_pandas=True))})] = True
        return pd.Series(out)
    return hit


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without those in which an item is found."""
    spark = docs.sparkSession
    small_batches(spark)
    for index in slices(benchmark):
        docs = docs.where(~_hit(spark.sparkContext.broadcast(index))(F.col(text)))
    return docs
