"""Near duplicates and joins against brute force."""

import itertools
import random
import re

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from skein.llm import common, decontaminate, embedding_dedup, ngram_join, queries

SF = "/root/testdata/sf0.01"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} - {()}


def linked(keys, links):
    up = {k: k for k in keys}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {k: root(k) for k in keys}


def brute_join(rows):
    sets = {i: shingles(t) for i, t in rows}
    near = [(a, b) for a, b in itertools.combinations(sorted(sets), 2)
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in linked(sets, near).items()}


def edited(rng, words, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in words)


def family(seed=0):
    """Copies with few to many edits, chains, and a passage that many documents share."""
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(3000)}" for _ in range(n)] for n in (12, 40, 90, 200, 400)]
    passage = " ".join(f"p{k}" for k in range(60))
    rows = []
    for b in base:
        rows += [edited(rng, b, s) for s in (0, 0, 0.005, 0.01, 0.02, 0.03, 0.04, 0.05, 0.1) for _ in range(5)]
    chain = [f"c{k}" for k in range(300)]
    rows += [" ".join(chain[10 * k:10 * k + 150]) for k in range(12)]
    rows += [passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.choice((3, 10, 30)))) for _ in range(60)]
    rows += ["a b", "A  b", "b a", "one two three four", "one two three four five", None, "", " \n"]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize("blocks", [None, (300, 20, 2000)])
def test_join_equals_brute_force(spark, monkeypatch, blocks):
    if blocks:  # clusters of several blocks
        monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", blocks[0])
        monkeypatch.setattr(ngram_join, "BLOCK_DOCS", blocks[1])
        monkeypatch.setattr(ngram_join, "BLOCK_POINTS", blocks[2])
    rows = family()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs).collect()}
    assert got == brute_join(rows)


def test_join_of_given_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' WHERE doc_id < 400").fetchall()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs).collect()} == brute_join(rows)


def test_join_of_odd_rows(spark, odd_docs, no_docs):
    rows = ngram_join.link(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert [by_id[i].component_id for i in (1, 7, 2, 3, 4, 6)] == [1, 1, 2, 3, 4, 6]
    assert all(r.component_id is None for r in rows if r.doc_id is None)
    assert ngram_join.link(no_docs).count() == 0
    kept = [r.doc_id for r in ngram_join.keep_one(odd_docs).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, 4, 5, 6, 8, -9, None, None], key=str)


def test_tree_join_keeps_every_pair_the_bound_allows():
    rng = np.random.default_rng(4)
    sizes = rng.integers(5, 60, 700)
    points = np.stack([np.bincount(rng.integers(0, 16, n), minlength=16) for n in sizes]).astype(np.int32)
    sizes = points.sum(axis=1).astype(np.int64)
    tree, half = ngram_join.CountTree(points, sizes), ngram_join.CountTree(points[:90], sizes[:90])

    def allowed(n, m, below):
        low = np.minimum(points[:n, None], points[None, :m]).sum(axis=2)
        ok = (low * 180 >= 80 * (sizes[:n, None] + sizes[None, :m])) & (sizes[:n, None] * 100 >= 80 * sizes[None, :m]) & (
            sizes[None, :m] * 100 >= 80 * sizes[:n, None])
        return {(int(i), int(j)) for i, j in zip(*np.nonzero(ok)) if not below or i < j}
    own = [tuple(sorted(p)) for i, j in tree.join(tree, 80) for p in zip(i.tolist(), j.tolist())]
    assert set(own) == allowed(700, 700, True) and len(own) == len(set(own))
    for one, two, n, m in ((tree, half, 700, 90), (half, tree, 90, 700)):
        got = [p for i, j in one.join(two, 80) for p in zip(i.tolist(), j.tolist())]
        assert set(got) == allowed(n, m, False) and len(got) == len(set(got))


def brute_vectors(rows, threshold=0.93):
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v, label in rows if label is not None}
    label = {i: c for i, _, c in rows}
    near = [(a, b) for a, b in itertools.combinations(sorted(unit), 2) if label[a] == label[b] and unit[a] @ unit[b] >= threshold]
    count = {i: 0 for i, _, _ in rows}
    for a, b in near:
        count[a] += 1
        count[b] += 1
    roots = linked([i for i, _, _ in rows], near)
    return {i: (count[i], roots[i], roots[i] == i) for i in count}


@pytest.mark.parametrize("tile", [1024, 13])
def test_vectors_equal_brute_force(spark, tile):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(6, 24))
    rows = [(i, (centre[i % 6] + rng.normal(scale=rng.choice([0.0, 0.1, 0.25, 0.3]), size=24)).astype(np.float32).tolist(),
             None if i % 41 == 0 else i % 3) for i in range(220)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df, tile=tile).collect()}
    assert got == brute_vectors(rows)


def test_given_vectors_equal_brute_force(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding, label FROM '{SF}/embeddings.parquet'").fetchall()
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.QUERIES["op6_embedding_near_dedup"](spark, SF).collect()}
    assert got == brute_vectors(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1, "x"), (2, [2.0, 0.0], 1, "x"), (3, [1.0, 0.0], None, "x"), (4, None, 1, "x"), (5, [0.0, 0.0], 1, "x"),
            (6, [nan, 1.0], 1, "x"), (7, [inf, 1.0], 1, "x"), (8, [1.0, None], 1, "x"), (9, [], 1, "x"), (None, [1.0, 0.0], 1, "x"),
            (10, [1.0, 0.0, 0.0], 1, "x"), (11, [3e38, 1e30], 1, "x"), (2, [2.0, 0.0], 1, "x"), (12, [-1.0, -0.0], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int, n_links string")
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {(1, 2, 1, True), (2, 2, 1, False), (11, 2, 1, False), (None, 0, None, False),
                   *((i, 0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 10, 12))}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("tile", [1024, 7])
def test_ids_with_several_vectors_are_one_node(spark, tile):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [1.0, 0.01])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<float>, label int")
    assert {(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, tile=tile).collect()} == {(1, 2, 1), (2, 1, 1), (3, 1, 1)}
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(5, 8))
    rows = [(int(rng.integers(40)), (centre[i % 5] + rng.choice([0.0, 0.0, 0.05, 0.2]) * rng.normal(size=8)).astype(np.float32).tolist(), i % 2) for i in range(130)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3)
    unit = [np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64)) for _, v, _ in rows]
    links = {(a[0], b[0]) for a, x in zip(rows, unit) for b, y in zip(rows, unit) if a[2] == b[2] and a[0] != b[0] and x @ y >= 0.93}
    root = {v: v for v, _, _ in rows}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {(r.vec_id, r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, tile=tile).collect()}
    assert got == {(v, sum(a == v for a, _ in links), root[v]) for v in root}


def test_quantisation_bound_holds():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(200, 64)) * rng.choice([1e-3, 1, 1e3], (200, 1)) ** rng.random((200, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for t in (0.0, 0.3, 0.93):
        i, j = embedding_dedup.pairs_above(x, x, t)
        assert set(zip(i, j)) == set(zip(*np.nonzero(np.einsum("ik,jk->ij", x, x) >= t)))


def brute_findings(items, text):
    """Items of which some stretch of some alignment has enough equal words, 80% of the stretch."""
    split = lambda t: re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())
    own, out = split(text), set()
    for k, item in items:
        words = split(item)
        enough = min(13, max(-(-8 * len(words) // 10), 6))
        for shift in range(-len(words), len(own)):
            a, b = max(shift, 0), min(shift + len(words), len(own))
            equal = [own[p] == words[p - shift] for p in range(a, b)]
            if len(words) >= 6 and sum(equal) >= enough and any(
                    sum(equal[i:j]) >= enough and 5 * sum(equal[i:j]) >= 4 * (j - i)
                    for i in range(len(equal)) for j in range(i + enough, len(equal) + 1)):
                out.add(k)
                break
    return out


def test_findings_tolerate_substitutions(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(800)]
    items = [(k, " ".join(rng.choice(words) for _ in range(n))) for k, n in enumerate((30, 45, 20, 14, 8, 6, 3))]
    docs = []
    for d in range(60):
        k, item = rng.choice(items)
        own = item.split()
        for p in rng.sample(range(len(own)), rng.choice((0, 0, 1, 2, 3, 6))) if len(own) > 6 else ():
            own[p] = "changed"
        docs.append((d, " ".join([*(rng.choice(words) for _ in range(rng.randrange(30))), *own, "end."]).upper()))
    docs += [(60, None), (61, ""), (62, items[0][1] + "! " + items[1][1])]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame([*items, (50, None), (51, "")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(df, bench).collect()}
    exact = {(d, k) for d, t in docs for k in brute_findings(items, t)}
    assert got == exact and len(exact) > 30
    assert {(62, 0), (62, 1)} <= got
    kept = {r.doc_id for r in decontaminate.clean(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}


def test_findings_of_odd_rows(spark, odd_docs, no_docs, monkeypatch):
    bench = spark.createDataFrame([(1, "The quick brown fox jumps over the lazy dog", "x"), (None, "over the quick brown fox jumps over it", "x"),
                                   (1, "The quick brown fox jumps over the lazy dog", "x"), (2, None, "x")], "item_id bigint, text string, coverage string")
    for most in (400_000, 4):
        monkeypatch.setattr(decontaminate, "SLICE_WORDS", most)
        got = {(r.doc_id, r.item_id, r.start_word, r.end_word) for r in decontaminate.find(odd_docs, bench).collect()}
        assert {(1, 1, 0, 9), (7, 1, 0, 9), (None, 1, 0, 9)} == got
        assert decontaminate.find(no_docs, bench).count() == 0 and decontaminate.find(odd_docs, bench.limit(0)).count() == 0
        assert {r.doc_id for r in decontaminate.clean(odd_docs, bench).collect()} == {2, 3, 4, 5, 6, 8, -9, None}
        assert decontaminate.clean(odd_docs, bench.limit(0)).count() == odd_docs.count()


def test_given_documents_hold_the_items_a_search_finds(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SF}/benchmark.parquet'").fetchall()
    plain = lambda t: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " "
    whole = {(d, k) for d, t in rows for k, i in items if plain(i) in plain(t)}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op1_decontamination"](spark, SF).collect()}
    assert whole and whole <= got


def test_every_stretch_that_fulfils_the_rule_is_found():
    """All substitution positions of short items, random ones of long items, against all stretches."""
    rng = random.Random(3)

    def qualifies(equal, n):
        enough = min(13, max(-(-8 * n // 10), 6))
        return any(sum(equal[i:j]) >= enough and 5 * sum(equal[i:j]) >= 4 * (j - i) for i in range(n) for j in range(i + enough, n + 1))
    sizes = [*range(6, 18), 30, 59]
    items = [[f"i{n}x{k}" for k in range(n)] for n in sizes]
    cases = [(s, set(c)) for s, n in enumerate(sizes) if n <= 17 for m in range(4) for c in itertools.combinations(range(n), m)]
    cases += [(s, {k for k in range(sizes[s]) if rng.random() < p}) for s in (12, 13) for p in (0.15, 0.2, 0.25, 0.3) for _ in range(150)]
    texts = [" ".join(["before", *("changed" if k in c else w for k, w in enumerate(items[s])), "after"]) for s, c in cases]
    index = decontaminate.Index.of([(s, " ".join(w)) for s, w in enumerate(items)])
    got = {(row, item): (matched, substituted) for row, item, _, _, matched, substituted in index.findings(pa.array(texts))}
    assert set(got) == {(d, s) for d, (s, c) in enumerate(cases) if qualifies([k not in c for k in range(sizes[s])], sizes[s])}
    assert all(m >= 4 * x for m, x in got.values())


def test_documents_with_a_few_common_shingles_meet_in_no_tree(spark, monkeypatch):
    """Each shares one shingle with the one before it and one with the one behind it, so they would be one cluster."""
    rng = random.Random(3)
    bridges = [" ".join(f"b{k}x{j}" for j in range(5)) for k in range(61)]
    words = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n))
    rows = [(k, f"{bridges[k]} {words(120)} {bridges[k + 1]}") for k in range(60)]
    rows += [(100 + k, rows[0][1] + f" end{k}") for k in range(20)]
    sketch = ngram_join.sketch_of
    monkeypatch.setattr(ngram_join, "sketch_of", lambda scanned: sketch(scanned).max() - sketch(scanned))  # the common ones come first
    met, dealt = [], ngram_join._dealt
    monkeypatch.setattr(ngram_join, "_dealt", lambda members, *parts: (met.append({r.id for r in members.select("id").collect()}), dealt(members, *parts))[1])
    got = {r.doc_id: r.component_id for r in ngram_join.link(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7)).collect()}
    assert got == {k: 0 if k >= 100 else k for k, _ in rows}
    assert met[0] == {0, *range(100, 120)}


@pytest.mark.parametrize("few", [1, 3, 1000])
def test_candidates_of_shingles_that_few_or_many_share(spark, monkeypatch, few):
    monkeypatch.setattr(ngram_join, "FEW", few)
    monkeypatch.setattr(ngram_join, "RUN_ROWS", 50)
    monkeypatch.setattr(ngram_join, "COMBINE_KEYS", 2000)
    rows = family(7)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.link(docs).collect()} == brute_join(rows)


def test_tables_that_grow_with_the_input_are_not_broadcast(spark, monkeypatch):
    """Spark would do so here at run time, as all of them are small."""
    plans = []

    def watched(df, cut=common.cut_lineage):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out
    monkeypatch.setattr(common, "cut_lineage", watched)
    monkeypatch.setattr(ngram_join, "cut_lineage", watched)
    docs = spark.createDataFrame(family(2), "doc_id bigint, text string")
    linked = ngram_join.link(docs)
    linked.collect()
    plans.append(linked._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)
