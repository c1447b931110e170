"""Collocations against plain counting."""

import random
import re
from collections import Counter

import pytest

from skein.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, most=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, *words[i:i + m]) for m in range(1, 5) for i in range(len(words) - m + 1))
    found = {p: a for p, a in f.items() if a >= least and len(p) > 2}
    inner = {}
    for p, a in found.items():
        for m in range(2, len(p) - 1):
            for i in range(1, len(p) - m + 1):
                inner[p[0], *p[i:i + m]] = max(a, inner.get((p[0], *p[i:i + m]), 0))
    out = {}
    for p, a in found.items():
        if 100 * inner.get(p, 0) >= 80 * a:
            continue
        score, _, left, right = min((2000000 * a // (f[p[:k + 1]] + f[p[0], *p[k + 1:]]), k, f[p[:k + 1]], f[p[0], *p[k + 1:]]) for k in range(1, len(p) - 1))
        out.setdefault(p[0], []).append((-score, -a, " ".join(p[1:]).encode(), left, right))
    return sorted((lang, k, r[2].decode(), -r[1], r[3], r[4], n[lang], -r[0]) for lang, rows in out.items() for k, r in enumerate(sorted(rows)[:most], 1))


def sentences(rng, n):
    vocabulary = ["a", "b", "c", "Dé", "e", "日本"]
    fixed = ["new york city", "per se", "a a a a a", "x y z w v"]
    out = []
    for _ in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.2 else rng.choice(vocabulary) for _ in range(rng.randrange(60))]
        out.append((rng.choice(["en", "en", "en", "de", None, "und", ""]), "".join(w + rng.choice([" ", "\t", " \t ", ". ", ",", "\n", "\x0b"]) for w in words)))
    return out


@pytest.mark.parametrize("shards,cells", [(1, 1 << 24), (2, 1 << 22), (4, 1 << 6)])
def test_collocations_equal_brute_force(spark, monkeypatch, shards, cells):
    """Also with a clock so small that most phrases share cells."""
    monkeypatch.setattr(phrases, "CELLS", cells)
    rng = random.Random(shards)
    docs = sentences(rng, 250) + [("en", None), (None, ""), ("xx", "one two"), ("en", " . "), ("en", "new york city " * 40), ("de", "r" * 70_000)]
    df = spark.createDataFrame([(*d, "n", 1) for d in docs], "lang string, text string, phrase string, n int").repartition(5)
    for least, most in ((30, 2000),) if shards < 4 else ((5, 7),):
        got = phrases.collocations(df, least=least, most=most, shards=shards)
        assert sorted(map(tuple, got.collect())) == brute(docs, least, most)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_counts_are_bounded_in_a_task_and_pieces_reach_over_chunks(spark, monkeypatch):
    monkeypatch.setattr(phrases, "HELD", 8)
    rng = random.Random(9)
    docs = sentences(rng, 120)
    df = spark.createDataFrame(docs, "lang string, text string").repartition(2)
    assert sorted(map(tuple, phrases.collocations(df, least=10).collect())) == brute(docs, 10)


def test_odd_documents(spark, odd_docs, no_docs):
    assert phrases.collocations(no_docs).count() == 0
    assert phrases.collocations(odd_docs, least=10 ** 6).count() == 0
    docs = [(r.lang, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, phrases.collocations(odd_docs, least=2, most=50).collect())) == brute(docs, 2, 50)


def test_scores_do_not_overflow(spark):
    """Occurrences times the scale pass 64 bits."""
    docs = spark.createDataFrame([("en", "a b")] * 3, "lang string, text string")
    row = phrases.collocations(docs, least=1, scale=9_000_000_000_000_000_000).first()
    assert (row.a, row.l, row.r, row.score) == (3, 3, 3, 4_500_000_000_000_000_000)


def test_the_clock_grows_with_the_words(spark, monkeypatch):
    """At most about a quarter of it is set, so few phrases are counted that share cells with frequent ones only."""
    monkeypatch.setattr(phrases, "CELLS", 1 << 6)
    seen, packed = [], phrases.Clock.__getstate__
    monkeypatch.setattr(phrases.Clock, "__getstate__", lambda self: (seen.append((len(self.cells), int((self.cells > 0).sum()))), packed(self))[1])
    rng = random.Random(9)
    docs = [("en", " ".join(f"w{rng.randrange(300)}" for _ in range(100))) for _ in range(400)]
    got = phrases.collocations(spark.createDataFrame(docs, "lang string, text string"), least=30)
    assert got.count() == len(brute(docs, 30))
    assert max(filled / cells for cells, filled in seen) < 0.5
    assert phrases.cells_for(65) == 128 and phrases.cells_for(0) == 64 and phrases.cells_for(10**12) == phrases.MOST_CELLS
