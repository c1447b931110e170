"""WARC round trips, URL rules, licences."""

import hashlib
import base64
import itertools
import math
import re

import pytest
from pyspark.sql import functions as F

from skein.llm import licenses, url_filter, warc


@pytest.fixture()
def pages(spark):
    rows = [(1, "http://a/x", "<p>é</p>", "z"), (2, None, "<p>é</p>", "z"), (3, "u\r\nInjected: yes", None, "z"), (4, "u", "", "z"),
            (5, "w", "WARC/1.1\r\nWARC-Type: response\r\n\r\n" + "x" * 200_000, "z"), (None, "n", "<p>é</p>", "z"),
            (None, "m", "only", "z"), (6, "same", "twice", "z"), (6, "same", "twice", "z")]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, payload string")


def test_round_trip(spark, pages, tmp_path):
    folder = f"file:{tmp_path}/w"
    warc.write(warc.records(pages.repartition(3)), folder, split_bytes=300)
    rows = warc.read(spark, folder).collect()
    assert len(rows) == 9
    by = {(r.record_id, r.target_uri): r for r in rows}
    digest = lambda b: "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()
    two = by["<urn:page:2>", None]
    assert (two.record_type, bytes(two.payload), two.payload_digest) == ("response", "<p>é</p>".encode(), digest("<p>é</p>".encode()))
    one = by["<urn:page:1>", "http://a/x"]
    assert (one.record_type, one.refers_to, one.payload, one.payload_bytes) == ("revisit", "<urn:page:2>", None, 9)
    assert by["<urn:page:>", "n"].record_type == "revisit" and by["<urn:page:>", "m"].record_type == "response"
    assert by["<urn:page:3>", "u%0D%0AInjected: yes"].refers_to == "<urn:page:4>" and by["<urn:page:4>", "u"].payload == b""
    assert len(by["<urn:page:5>", "w"].payload) == 200_000 + len("WARC/1.1\r\nWARC-Type: response\r\n\r\n")
    assert sum(r.record_type == "response" for r in rows if r.record_id == "<urn:page:6>") == 2
    reader = warc.WarcReader(folder, ["record_id"])
    splits = [s for p in reader.partitions() for s in p.parts]
    assert len(splits) > 3 and len({name for name, _, _ in splits}) <= 3
    apart = [r for s in splits for r in reader.read(warc.Splits([s]))]
    assert sorted(apart) == sorted((r.record_id,) for r in rows)


def test_small_payloads_are_responses(spark, pages):
    kinds = {r.record_id: r.record_type for r in warc.records(pages, least_bytes=100).collect()}
    assert set(kinds.values()) == {"response"}


def test_filters_are_taken_over(spark, pages, tmp_path):
    folder = f"{tmp_path}/w"
    warc.write(warc.records(pages), folder)
    df = warc.read(spark, folder, "record_id string, record_type string, refers_to string").where(
        (F.col("record_type") == "revisit") & F.col("record_id").isin("<urn:page:1>", "<urn:page:3>") & F.col("refers_to").isNotNull())
    assert {r.record_id for r in df.collect()} == {"<urn:page:1>", "<urn:page:3>"}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"^\W*(\(\d+\) )?Filter ", plan, re.M)
    reader = warc.WarcReader(folder, ["record_id"])
    from pyspark.sql.datasource import EqualTo, GreaterThan
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_bytes",), 3)]))
    assert [type(f) for f in left] == [GreaterThan]
    assert len([r for p in reader.partitions() for r in reader.read(p)]) == 3


def test_appending_empty_tables_and_lost_attempts(spark, pages, tmp_path):
    folder = f"{tmp_path}/w"
    warc.write(warc.records(pages.limit(0)), folder)
    assert warc.read(spark, folder).count() == 0
    warc.write(warc.records(pages), folder, mode="append")
    (tmp_path / "w" / "left-over.warc").write_bytes(b"WARC/1.1\r\nbroken")  # of an attempt that never was committed
    assert warc.read(spark, folder, "record_id string").count() == 9


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group() if rest[len(host):].startswith("/") else ""
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fit = [(len(h + p), len(h), h + p) for h, p, _ in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit)[2] if fit else None
    return host, path, best


@pytest.mark.parametrize("most", [1_000_000, 3])
def test_urls_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(url_filter, "SLICE_RULES", most)
    hosts = ["com", "example.com", "www.example.com", "Ex.COM", "notexample.com", "é.net", "net", ""]
    paths = ["", "/", "/en/", "/en/a?x=/fr/", "/en#", "?q", "/é/x", "//"]
    urls = [f"{s}{h}{p}" for s in ("http://", "x://y://", "no") for h in hosts for p in paths] + [None, "", "http://", "a://b\nc/d"]
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("example.com", "", "block"), ("www.example.com", "/en/a", "allow"),
             ("net", "/é", "block"), ("é.net", "/", "allow"), ("com", "/en", "block"), ("m", "/", "block")]
    df = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id int, url string, verdict string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    verdict = {h + p: v for h, p, v in rules} | {None: "allow"}
    assert got == {i: (*(b := brute_rule(u, rules)), verdict[b[2]]) for i, u in enumerate(urls)}


def test_odd_rules(spark):
    df = spark.createDataFrame([(1, "http://a.b/c"), (1, "http://a.b/c")], "page_id int, url string")
    rules = spark.createDataFrame([(None, "/", "block"), ("b", None, "block"), ("b", "/", "allow"), ("b", "/", "block"), ("b", "/", None)],
                                  "host string, path string, verdict string")
    assert [r.verdict for r in url_filter.judge(df, rules).collect()] == ["block", "block"]
    assert [(r.rule, r.verdict) for r in url_filter.judge(df, rules.limit(0), default="block").collect()] == [(None, "block")] * 2
    assert url_filter.judge(df.limit(0), rules).count() == 0


def test_digest_array_confirms_strings(tmp_path, monkeypatch):
    monkeypatch.setattr(url_filter, "keys_of", lambda s: __import__("numpy").array([len(x) for x in s], "uint64"))  # all collide
    path = str(tmp_path / "r.bin")
    url_filter.DigestArray.write(path, [("ab", "/", True), ("cd", "/", False), ("é", "/x", True)])
    index = url_filter.DigestArray(path)
    assert [int(i) >= 0 and index.string(int(i)).decode() for i in index.find(["cd/", "ab/", "xx/", "é/x", ""], [2, 2, 2, 2, 0])] == ["cd/", "ab/", False, "é/x", False]


def brute_cosines(text, templates):
    words = lambda t: re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower())
    distinct = sorted(set(templates))
    df = {w: sum(w in words(t) for _, t in distinct) for _, t in distinct for w in words(t)}
    idf = lambda w: math.log((len(distinct) + 1) / (df.get(w, 0) + 1)) + 1

    def vector(t):
        v = {w: words(t).count(w) * idf(w) for w in words(t)}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / n for w, x in v.items()}
    found = [(round(sum(x * vector(t).get(w, 0) for w, x in vector(line).items()), 9), name)
             for line, (name, t) in itertools.product(text.split("\n"), distinct) if words(line)]
    found = [f for f in found if f[0] >= 0.6]
    return min(found, key=lambda f: (-f[0], f[1]), default=None)


def test_notices_equal_brute_force(spark, odd_docs):
    lines = ["Released under the MIT License.", "(c) x, licensed under the apache license version 2.0", "All rights reserved", "no notice here",
             "this license is no notice, it only names the word license", "Permission is hereby granted, free of charge, to any person",
             "Licensed under CC BY 4.0, or released under the MIT License."]
    texts = lines + ["prose\n" * 3 + line + "\nmore" for line in lines] + ["\n".join(lines), "", None]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    got = {r.path: (round(r.score, 9), r.license) if r.license else None
           for r in licenses.scan(df, spark.createDataFrame(licenses.TEMPLATES, "license string, text string")).collect()}
    assert got == {str(i): brute_cosines(t or "", licenses.TEMPLATES) for i, t in enumerate(texts)}


def test_nearest_licence_file_is_inherited(spark):
    mit, gpl = "Released under the MIT License.", "This work is licensed under the GNU General Public License, version 3."
    rows = [("a/LICENSE", mit), ("a/x.py", "code"), ("a/b/c/y.py", "code"), ("a/b/COPYING.txt", gpl), ("a/b/z.py", None), ("a/b/own.py", mit),
            ("licence", gpl), ("top.py", "x"), ("ab/q.py", "x"), (None, "x"), ("a/e/LICENSE", "nothing"), ("a/e/f", ""), ("a/x.py", "code")]
    df = spark.createDataFrame([(*r, "k") for r in rows], "path string, text string, origin string")
    templates = spark.createDataFrame(licenses.TEMPLATES, "license string, text string")
    got = [(r.path, r.license, r.origin, r.licensed_by) for r in licenses.scan(df, templates).collect()]
    assert sorted(got, key=str) == sorted([
        ("a/LICENSE", "MIT", "own", None), ("a/x.py", "MIT", "inherited", "a"), ("a/x.py", "MIT", "inherited", "a"),
        ("a/b/c/y.py", "GPL-3.0", "inherited", "a/b"), ("a/b/COPYING.txt", "GPL-3.0", "own", None), ("a/b/z.py", "GPL-3.0", "inherited", "a/b"),
        ("a/b/own.py", "MIT", "own", None), ("licence", "GPL-3.0", "own", None), ("top.py", None, None, None), ("ab/q.py", None, None, None),
        (None, None, None, None), ("a/e/LICENSE", "MIT", "inherited", "a"), ("a/e/f", "MIT", "inherited", "a")], key=str)
    assert licenses.scan(df.limit(0), templates).count() == 0
    assert {r.license for r in licenses.scan(df, templates.limit(0)).collect()} == {None}


def test_notices_beside_other_words_and_across_lines(spark):
    mit = "Released under the MIT License."
    words = " ".join(f"prose{k}" for k in range(400))
    texts = {"Copyright (c) 2020 Jane Doe and contributors. " + mit: "MIT", "Copyright (c) 2021 Example Corp. All rights reserved.": "Proprietary",
             "eight words of prose stand before this notice " + mit: "MIT", f"{words} {mit} {words}": "MIT",
             "# This work is licensed under a\n# Creative Commons\n# Attribution 4.0\n# International License.": "CC-BY-4.0",
             "x is y. Licensed under the Apache\nLicense,\nVersion\n2.0. " + words: "Apache-2.0",
             "of all rights and duties that people have in a town": None, "as far as we know this was licensed under the MIT License " + words: "MIT", "the license of a driver is " + words: None}
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] * 2, "path string, text string")
    rows = licenses.scan(df, spark.createDataFrame(licenses.TEMPLATES, "license string, text string")).collect()
    assert len(rows) == 2 * len(texts) and {int(r.path): r.license for r in rows} == dict(enumerate(texts.values()))


def brute_windows(text, templates, least):
    """Like ``brute_cosines`` over all windows of as many words as a template has."""
    split = lambda t: re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower())
    known = [(name, split(t)) for name, t in sorted(set(templates))]
    idf = {w: math.log((len(known) + 1) / (sum(w in t for _, t in known) + 1)) + 1 for w in {*split(text), *(w for _, t in known for w in t)}}

    def vector(words):
        v = {w: words.count(w) * idf[w] for w in words}
        n = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / n for w, x in v.items()}
    vectors, own = [(name, vector(t)) for name, t in known], split(text)
    places = [(n, vector(own[k:k + n])) for n in {len(t) for _, t in known} for k in range(max(len(own) - n, 0) + 1)]
    found = [(round(sum(x * v.get(w, 0) for w, x in place.items()), 9), name, n) for n, place in places for name, v in vectors]
    return min((f[:2] for f in found if f[0] >= (least if f[2] >= 5 else 0.95)), key=lambda f: (-f[0], f[1]), default=None)


def test_windows_equal_brute_force(spark):
    rng = __import__("random").Random(4)
    vocabulary = [w for _, t in licenses.TEMPLATES[:6] for w in t.split()]
    texts = []
    for _, t in licenses.TEMPLATES * 2:
        own = [rng.choice(vocabulary) if rng.random() < 0.15 else w for w in t.split()]
        texts.append(" ".join([*(f"p{k}" for k in range(25)), *own, *(f"q{k}" for k in range(rng.randrange(25)))]))
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    got = {r.path: (round(r.score, 9), r.license) if r.license else None
           for r in licenses.scan(df, spark.createDataFrame(licenses.TEMPLATES, "license string, text string")).collect()}
    assert got == {str(i): brute_cosines(t, licenses.TEMPLATES) or brute_windows(t, licenses.TEMPLATES, licenses.LEAST_WINDOW) for i, t in enumerate(texts)}


def test_root_licenses_what_lies_below(spark):
    rows = [("/LICENSE", "Released under the MIT License."), ("/a/x.py", "code"), ("/y.py", "code"), ("b/z.py", "code")]
    got = licenses.scan(spark.createDataFrame(rows, "path string, text string"), spark.createDataFrame(licenses.TEMPLATES, "license string, text string"))
    assert {(r.path, r.license, r.licensed_by) for r in got.collect()} == {
        ("/LICENSE", "MIT", None), ("/a/x.py", "MIT", "/"), ("/y.py", "MIT", "/"), ("b/z.py", None, None)}


def test_texts_are_cut_into_words_where_they_lie_and_only_lines_in_reach_leave(spark):
    prose = "The cat and the dog that live by the river are not with us, and this is all that you can see in the town of old.\n" * 30
    texts = [prose, prose + "All rights reserved.\n" + prose, prose + "Licensed under\nCC BY 4.0.", None, ""]
    files = spark.createDataFrame(list(enumerate(texts)), "_file bigint, text string")
    templates = spark.createDataFrame(licenses.TEMPLATES, "license string, text string")
    known = licenses.template_vectors(templates).collect()
    lengths = sorted({len(re.findall(r"[a-z0-9]+(?:[.-][a-z0-9]+)*", t.lower())) for _, t in licenses.TEMPLATES})
    found = licenses.candidates(files, known, len(licenses.TEMPLATES), lengths, licenses.LEAST_COSINE, licenses.LEAST_WINDOW)
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    assert {(r._file, r._window) for r in rows} >= {(1, False), (2, True)} and 0 not in {r._file for r in rows}
    assert [r._tokens for r in rows if r._file == 1 and not r._window] == [["all", "rights", "reserved"]]
