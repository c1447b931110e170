"""The prefix trie against nested dictionaries."""

import hashlib
import random
import re
import zlib

import pytest

from skein.llm import prefix_trie


def brute(rows, every=20, most=4):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}:{text}".encode()).hexdigest()
            own.setdefault(conv, []).append(((turn is not None, turn or 0, role, digest), (role, text)))
    own = {c: [t for _, t in sorted(x)] for c, x in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most if most else 0
        base = c - int(c / every) * every  # remainder that has the sign of c
        whole = own.get(c - base, [])[:h] + turns[h:]
        for d in range(len(whole) + 1):
            members.setdefault(tuple(whole[:d]), []).append((c, d == len(whole)))
    n = {p: len(m) for p, m in members.items()}
    first = {p: min(c for c, _ in m) for p, m in members.items()}
    children = {p: sum(len(q) == len(p) + 1 and q[:len(p)] == p for q in members) for p in members}
    out = []
    for p, m in members.items():
        under = [q for q in members if q[:len(p)] == p]
        ends = ",".join(map(str, sorted(c for c, last in m if last)))
        saved = sum((n[q] - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in under if q)
        out.append((first[p], len(p), first[p[:-1]] if p else None, n[p], children[p], sum(not children[q] for q in under), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(rng, convs):
    rows = []
    for c in convs:
        for t in range(rng.choice([0, 1, 2, 3, 4, 5, 9])):
            rows.append((c, rng.choice([t, t, t, 0, None]), rng.choice(["user", "user", None, "a:b"]), rng.choice(["hi", "hi there", "hi there", "", None, "x\ty z"])))
        if rng.random() < 0.3:
            rows += [(c, t, "user", "same start " * t) for t in range(6)]
    return rows


@pytest.mark.parametrize("size,batch", [(1024, 1000), (2, 3), (3, 1), (4, 50)])
def test_nodes_equal_brute_force(spark, monkeypatch, size, batch):
    """Also with segments and blocks of a few turns, so that most nodes lie in several."""
    monkeypatch.setattr(prefix_trie, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch)))
    rng = random.Random(size)
    rows = rows_of(rng, [*range(-45, 90), 10 ** 15]) + [(None, 0, "user", "x"), (7, 0, "user", "hi"), (7, 0, "user", "hi"), (3, 1, "u", "long " * 50_000)]
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "conv_id bigint, turn bigint, role string, text string, depth int, key string").repartition(7)
    for most in (4, 0):
        got = prefix_trie.trie(df, most=most, size=size)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, most=most)


def test_one_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "small_batches", lambda s: s.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16"))
    rows = [(1, t, "user", f"t{t % 7}") for t in range(3000)] + [(c, t, "user", f"t{t}") for c in range(1000, 1300) for t in range(3)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(6)
    got = {(r.depth, r.conv_id): r for r in prefix_trie.trie(df, most=0, size=256).collect()}
    assert len(got) == 3001 and got[3000, 1].n_leaves == 1 and got[3, 1].n_convs == 301
    assert got[0, 1].saved_tokens == 900 and got[2, 1].saved_tokens == 600 and got[4, 1].saved_tokens == 0
    assert got[3, 1].ends_sha256 == hashlib.sha256(",".join(map(str, range(1000, 1300))).encode()).hexdigest()
    assert got[3, 1].n_children == 1 and got[4, 1].parent_conv_id == 1


def test_empty_table_and_turnless_conversations(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert prefix_trie.trie(empty).count() == 0
    odd = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(odd, 0, "user", "goes with its base"), (None, None, None, None)]
    got = prefix_trie.trie(spark.createDataFrame(rows, empty.schema)).collect()
    assert [(r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_leaves, r.saved_tokens) for r in got] == [(odd, 0, None, 1, 1, 0)]
    assert got[0].ends_sha256 == hashlib.sha256(str(odd).encode()).hexdigest()


def test_sparse_table_holds_range_minima():
    import numpy as np
    x = np.random.default_rng(1).integers(0, 9, 37)
    table = prefix_trie.sparse_table(x)
    assert all(table[p][i] == x[i:i + 2 ** p].min() for p in range(len(table)) for i in range(37 - 2 ** p + 1))
