"""Quality, toxicity and language: held-out accuracy on the given tables and odd rows."""

import numpy as np
import pytest

from skein.llm import language, queries, quality, toxicity
from skein.llm.common import table

SF = "/root/testdata/sf0.01"


def held_out(spark, name, label):
    rows = queries.QUERIES[name](spark, SF).collect()
    assert len(rows) == table(spark, SF, "documents").count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    known = {r["doc_id"]: r[label] for r in table(spark, SF, "labels").collect()}
    return [(r["predicted"], known[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in known]


def test_quality_of_held_out_documents(spark):
    pairs = held_out(spark, "op8_quality", "quality")
    assert sum(a == b for a, b in pairs) >= 0.96 * len(pairs)


def test_toxicity_of_held_out_documents(spark):
    pairs = held_out(spark, "op5_toxicity", "toxic")
    assert sum(a == b for a, b in pairs) >= 0.94 * len(pairs)
    assert all(b for a, b in pairs if a)


def test_language_of_held_out_documents(spark):
    rows = queries.QUERIES["op10_language_id"](spark, SF).collect()
    known = {r["doc_id"]: r["lang"] for r in table(spark, SF, "documents").collect()}
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == known[r["doc_id"]] for r in held) >= 0.97 * len(held)


@pytest.mark.parametrize("operator", [quality, toxicity])
def test_odd_rows(spark, odd_docs, no_docs, odd_labels, operator):
    rows = operator.classify(odd_docs, odd_labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert all(r["held_out"] for r in rows if r["doc_id"] is None)
    assert len({r["score"] for r in rows if r["doc_id"] == 6}) == 1
    assert operator.classify(no_docs, odd_labels).count() == 0
    assert all(0 <= r["score"] <= 1 for r in operator.classify(odd_docs, odd_labels.limit(0)).collect())


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    rows = {r["doc_id"]: r for r in language.identify(odd_docs).collect() if r["doc_id"] is not None}
    assert all(rows[i]["lang_pred"] == "und" and rows[i]["score"] == 0 and rows[i]["rejected"] for i in (2, 3, 4, 8))
    assert rows[5]["lang_pred"] in ("en", "de", "es") and rows[-9]["lang_pred"] != "und"
    assert language.identify(no_docs).count() == 0
    unknown = odd_docs.withColumn("lang", odd_docs["lang"].substr(1, 0)).where("false").unionByName(odd_docs.selectExpr(
        *[("CAST(null AS string) AS lang" if c == "lang" else c) for c in odd_docs.columns]))
    assert {r["lang_pred"] for r in language.identify(unknown).collect()} == {"und"}


def test_fourier_features_approximate_the_kernel():
    rng = np.random.default_rng(1)
    size = quality.STATISTICS
    model = quality.Model(np.zeros(size), np.ones(size), rng.normal(0, 1 / np.sqrt(size), (size, 20_000)), rng.uniform(0, 2 * np.pi, 20_000))
    x = rng.normal(size=(2, size))
    a, b = model.map(x)[:, 1:]
    assert abs(a @ b - np.exp(-((x[0] - x[1]) ** 2).sum() / size / 2)) < 0.03


def test_isotonic_means_rise_and_keep_the_total():
    x = np.array([3.0, 1, 2, 2, 5, 4])
    y = np.array([1.0, 0, 1, 0, 1, 0])
    at, value = quality.isotonic(x, y)
    assert (np.diff(at) > 0).all() and (np.diff(value) > 0).all()
    assert np.interp(2, at, value) <= np.interp(5, at, value)


def grammar():
    return toxicity.Grammar({("lowei", False): 2.0})


@pytest.mark.parametrize("text, kind", [
    ("He met an idiot.", "targeted"), ("What an idiot.", "plain"), ("It was not an idiot.", "denied"), ("You are stupid!", "targeted"),
    ("They said: what a moron", "quoted"), ("I will kill you", "threatened"), ("kill the process", "threat"), ("loweiß da", "plain"),
    ("A slowei day", None), ("idiotic", None), ("a stupidly long day", None), ("not so. Idiot", "plain"), ("", None), (None, None),
    ("not that it was raining idiot", "plain")])
def test_clauses(text, kind):
    found = [toxicity.KINDS[k] for k, *_ in grammar().clauses(text or "")]
    assert found == ([kind] if kind else [])


def test_composition_equals_running_the_parts():
    rng = np.random.default_rng(2)
    for _ in range(200):
        word = rng.integers(0, 6, rng.integers(0, 9)).tolist()
        state, parts = 0, [p.start for p in toxicity.PARTS]
        for symbol in word:
            state = toxicity.NEXT[state][symbol]
            parts = [p.step(s, symbol)[0] for p, s in zip(toxicity.PARTS, parts)]
        assert toxicity._STATES[state] == tuple(parts)


def test_matched_clauses_are_reported(spark):
    docs = spark.createDataFrame([(1, "Fine day. You idiot!"), (2, None)], "doc_id bigint, text string")
    rows = {r.doc_id: r.clauses for r in toxicity.matches(docs, toxicity.Model({}, toxicity.PRIOR)).collect()}
    assert [(c.kind, "Fine day. You idiot!"[c.start:c.end]) for c in rows[1]] == [("targeted", " You idiot")] and rows[2] == []


def test_copies_are_learned_from_once(spark):
    """A clean word of one much-copied toxic document does not become an insult."""
    rows, labels = [], []
    for i in range(600):
        rows.append((i, f"plain words number w{i % 97} and w{i % 89} go here with many others x{i % 13}"))
        labels.append((i, 0))
    for i in range(600, 900):
        rows.append((i, f"a copied text about gardening tools and flowers every spring in the town of sunhill, number {i % 3}"))
        labels.append((i, 1))
    for i in range(900, 1000):
        rows.append((i, f"w{i % 97} zorgblat w{i % 89} goes x{i % 13} and y{i % 31} here z{i % 7}"))
        labels.append((i, 1))
    model = toxicity.fit(spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int"))
    assert any(c.startswith("zorg") for c, _ in model.stems) and not any("garden".startswith(c) or c.startswith("garden") for c, _ in model.stems)


@pytest.mark.parametrize("text, kinds", [
    ("You are not stupid, you are a disgusting idiot", {"denied": 1.0, "targeted": 2.0}), ("They said no, but I will kill you", {"threatened": 1.0}),
    ("He said you are an idiot", {"quoted": 1.0}), ("They said, you are a moron", {"quoted": 1.0}), ("You are not a stupid idiot", {"denied": 2.0}),
    ("He is not stupid but a moron", {"denied": 1.0, "targeted": 1.0}), ("They wrote what a fool, and you are scum", {"quoted": 1.0, "targeted": 1.0}),
    ("She reported trash, clown and vermin", {"quoted": 3.0}), ("I will not hurt you, but he will kill you", {"denied": 1.0, "threatened": 1.0})])
def test_matches_inside_and_outside_a_scope_count_apart(text, kinds):
    assert {toxicity.KINDS[k]: w for k, w, *_ in grammar().clauses(text)} == kinds


def test_recall_of_held_out_documents(spark):
    pairs = held_out(spark, "op5_toxicity", "toxic")
    assert sum(a for a, b in pairs if b) >= 0.6 * sum(b for _, b in pairs)
    print("recall", sum(a for a, b in pairs if b), sum(b for _, b in pairs))


def test_a_long_clause_of_words_that_begin_like_cues_is_walked_once():
    import time
    grammar = toxicity.Grammar({})
    text = "killer burning hurts smashed dumbbell " * 28_000
    start = time.process_time()
    assert not grammar.describe(text).any() and len(text) > 1_000_000
    assert time.process_time() - start < 3
    assert [k for k, *_ in grammar.clauses(text + "you idiot. " + text + "you are a fool")] == [toxicity.KINDS.index("targeted")] * 2


def test_normal_equations_equal_plain_sums(spark):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{rng.integers(50)}" for _ in range(int(rng.integers(1, 40)))) for _ in range(200)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(60)
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    import zlib
    known = [i for i in range(200) if zlib.crc32(str(i).encode()) % 3 != 1]
    part = {r.doc_id: r.p for r in docs.selectExpr("doc_id", f"pmod(xxhash64(7, doc_id), {quality.CALIBRATION_PARTS}) AS p").collect()}
    stats = {i: quality.statistics(texts[i]) for i in known}
    x = np.array([stats[i] for i in known])
    assert np.allclose(model.mean, x.mean(axis=0))
    train = [i for i in known if part[i] != 0]
    z, y = model.map(np.array([stats[i] for i in train])), np.array([i % 2 for i in train], float)
    weights = np.linalg.solve(z.T @ z / len(train) + quality.RIDGE * np.eye(z.shape[1]), z.T @ y / len(train))
    assert np.allclose(model.weights, weights, atol=1e-6)
