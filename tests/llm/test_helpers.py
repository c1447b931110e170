import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.llm import common as c


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\nÉ日", max_size=30)), max_size=8))
def test_words_have_equal_hashes_where_their_letters_are_equal(texts):
    seen = {}
    for first, raw, starts in c.text_chunks(pa.array(texts, pa.string())):
        words, at = c.hashed_words(raw, starts, c.BLANK)
        for r, t in enumerate(texts[first:first + len(starts) - 1]):
            expected = [w.translate(str.maketrans("AB", "ab")) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
            got = words[at[r]:at[r + 1]].tolist()
            assert len(got) == len(expected)
            for w, h in zip(expected, got):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_chunks_cover_a_long_text_and_sliced_arrays():
    texts = pa.array(["x", "a b " * (c.CHUNK_BYTES // 2), None, "c"]).slice(1)
    counts = [n for _, raw, starts in c.text_chunks(texts) for n in np.diff(c.hashed_words(raw, starts, c.BLANK)[1])]
    assert counts == [c.CHUNK_BYTES, 0, 1]


def test_shingles_of_few_words_are_one():
    words = c.words_of("a b c")
    assert len(c.shingle_hashes(words, 5)) == 1 and len(c.shingle_hashes(c.words_of("a b c d e f"), 5)) == 2
    assert len(c.shingle_hashes(c.words_of(""), 5)) == 0


def test_components_of_chains_stars_and_cycles(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + k) for k in range(1, 80)] + [(5, 5)]
    edges += [(rng.randrange(2000, 2200), rng.randrange(2000, 2200)) for _ in range(120)]
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in c.components(spark.createDataFrame(edges, "a bigint, b bigint").repartition(7)).collect()}
    assert got == {x: root(x) for x in up if any(x in e and e[0] != e[1] for e in edges)}


def test_components_without_edges(spark):
    assert c.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_groups_come_whole(spark):
    batches = [pa.RecordBatch.from_pydict({"k": k, "v": v}) for k, v in (([1, 1, 2], [1, 2, 3]), ([2], [4]), ([3, 4, 4], [5, 6, 7]))]
    assert [(g.column("k")[0].as_py(), g.column("v").to_pylist()) for g in c.grouped(iter(batches), "k")] == [
        (1, [1, 2]), (2, [3, 4]), (3, [5]), (4, [6, 7])]


def test_bounded_sample_is_steady(spark):
    df = spark.range(5000).toDF("id")
    once, twice = ({r.id for r in c.bounded_sample(df.repartition(n), df["id"], 500).collect()} for n in (3, 5))
    assert once == twice and 300 < len(once) < 700
