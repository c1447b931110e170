"""Registered queries of the operators, and the SQL counterparts of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import (decontaminate, embedding_dedup, exact_dedup, language, licenses, mixing, ngram_join, phrases, prefix_trie,
                       quality, toxicity, url_filter, warc)
from skein.llm.common import table
from skein.session import shared_folder

#: Fixed rules of the URL query.
URL_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.withColumn("coverage", F.round("coverage", 6))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With words and position of both passes; no document has more."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    each = [F.get("passes", F.lit(k)) for k in range(2)]
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "repeats",
                        *[F.coalesce(p["words"], F.lit(0)).alias(f"{name}_words") for name, p in zip(("first", "second"), each)],
                        F.round("position", 6).alias("position"), F.round(each[1]["position"], 6).alias("second_position"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents stand in directories by source and id; every hundredth is the licence file of a directory."""
    docs = table(spark, sf_dir, "documents")
    folder = F.when(F.col("doc_id") % 10000 == 0, F.col("source")).when(
        F.col("doc_id") % 1000 == 0, F.concat_ws("/", "source", F.expr("doc_id div 10000"))).otherwise(
        F.concat_ws("/", "source", F.expr("doc_id div 10000"), F.expr("doc_id div 1000"), F.expr("doc_id div 100")))
    name = F.when(F.col("doc_id") % 100 == 0, F.concat_ws("-", F.lit("LICENSE"), "doc_id")).otherwise(F.concat("doc_id", F.lit(".txt")))
    scanned = licenses.scan(docs.select("doc_id", F.concat(folder, F.lit("/"), name).alias("path"), "text"),
                            spark.createDataFrame(licenses.TEMPLATES, "license string, text string"))
    return scanned.select("doc_id", "path", "license", "origin", "licensed_by", F.round("score", 6).alias("score"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    warc.write(warc.records(table(spark, sf_dir, "pages")), folder)
    back = warc.read(spark, folder, "record_id string, record_type string, refers_to string, payload_digest string, payload_bytes bigint")
    number = lambda c: F.regexp_extract(c, "page:(-?[0-9]+)", 1).try_cast("bigint")
    return back.select(number("record_id").alias("page_id"), "payload_bytes",
                       F.substring("payload_digest", 6, 32).alias("payload_digest"), "record_type",
                       number("refers_to").alias("refers_to"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents").select("lang", "text"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_mix_sources, op3_ngram_jaccard_join, op4_license_scan, op5_toxicity, op6_embedding_near_dedup,
                                   op7_warc, op8_quality, op9_url_filter, op10_language_id, op11_phrase_collocations,
                                   op12_prefix_trie, op13_exact_dedup)}

ORACLES: dict[str, str] = {
    "op2_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END AS size FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank
  FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 7.5 WHEN 1 THEN 1.0 ELSE 0.5 END::DOUBLE AS w0,
         CASE rank % 3 WHEN 0 THEN 2.5 WHEN 1 THEN 3.0 ELSE 1.5 END::DOUBLE AS w1 FROM sources),
ranked AS (
  SELECT *, (w0 + w1) / 2 AS weight, (source_size * 2)::DOUBLE AS most, (source_size * 2)::DOUBLE / ((w0 + w1) / 2) AS full_at FROM weighed),
poured AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5
            - coalesce(sum(most) OVER (ORDER BY full_at, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(weight) OVER (ORDER BY full_at, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sharing FROM ranked),
level AS (SELECT arg_min(rest / sharing, {'f': full_at, 'r': rank}) AS level FROM poured WHERE rest / sharing <= full_at),
targets AS (SELECT source, source_size, w0, w1, weight, least(most, weight * coalesce(level, 1e300)) AS target FROM poured, level),
queued AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.w0, t.w1, t.weight,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(d.doc_id::VARCHAR), d.doc_id, d.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
passes AS (
  SELECT *, greatest(least(floor(target)::BIGINT - before, size), 0) AS first,
         greatest(least(floor(target)::BIGINT - before - source_size, size), 0) AS second FROM queued),
timed AS (SELECT *, first + second AS taken, before / target * weight AS due, (before + source_size) / target * weight AS due2, w1 - w0 AS slope FROM passes)
SELECT doc_id, size::BIGINT AS size, source_size, target, taken::BIGINT AS taken, (second > 0)::INT AS repeats,
       first::BIGINT AS first_words, second::BIGINT AS second_words,
       round(CASE WHEN taken > 0 THEN CASE WHEN due <= 0 THEN 0.0 ELSE due * 2 / (w0 + sqrt(greatest(w0 * w0 + slope * due * 2, 0.0))) END END, 6) AS position,
       round(CASE WHEN second > 0 THEN due2 * 2 / (w0 + sqrt(greatest(w0 * w0 + slope * due2 * 2, 0.0))) END, 6) AS second_position
FROM timed""",
    "op4_license_scan": r"""
WITH templates(license, tpl) AS (SELECT DISTINCT * FROM (VALUES TEMPLATE_ROWS)),
tokens AS (SELECT license, tpl, unnest(regexp_extract_all(lower(tpl), '[a-z0-9]+(?:[.-][a-z0-9]+)*')) AS token FROM templates),
counted AS (SELECT license, tpl, token, count(*) AS tf FROM tokens GROUP BY ALL),
total AS (SELECT count(*) AS n FROM templates),
idf AS (SELECT token, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM counted, total GROUP BY token, n),
vectors AS (SELECT license, tpl, token, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY license, tpl)) AS weight FROM counted JOIN idf USING (token)),
lines AS (SELECT doc_id, line, unnest(regexp_extract_all(lower(parts[line]), '[a-z0-9]+(?:[.-][a-z0-9]+)*')) AS token
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))),
words AS (SELECT doc_id, line, token, count(*) AS tf FROM lines GROUP BY ALL),
raw AS (SELECT doc_id, line, token, tf * coalesce(idf, ln(n + 1.0) + 1) AS raw FROM words LEFT JOIN idf USING (token), total),
norms AS (SELECT doc_id, line, sqrt(sum(raw * raw)) AS norm FROM raw GROUP BY ALL),
scored AS (SELECT r.doc_id, r.line, v.license, v.tpl, sum(raw * weight) / any_value(norm) AS score FROM raw r JOIN vectors v USING (token)
  JOIN norms o ON o.doc_id = r.doc_id AND o.line = r.line GROUP BY ALL HAVING sum(raw * weight) / any_value(norm) >= 0.6),
found AS (SELECT doc_id, license, score FROM scored QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, license, score) = 1),
placed AS (SELECT doc_id, CASE WHEN doc_id % 10000 = 0 THEN source WHEN doc_id % 1000 = 0 THEN concat_ws('/', source, doc_id // 10000)
    ELSE concat_ws('/', source, doc_id // 10000, doc_id // 1000, doc_id // 100) END AS dir,
  CASE WHEN doc_id % 100 = 0 THEN concat('LICENSE-', doc_id) ELSE concat(doc_id, '.txt') END AS name FROM documents),
files AS (SELECT p.*, f.license, f.score FROM placed p LEFT JOIN found f USING (doc_id)),
grants AS (SELECT dir AS above, license, score FROM files WHERE doc_id % 100 = 0 AND license IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY round(score, 9) DESC, license, score) = 1),
nearest AS (SELECT d.dir, arg_max(struct_pack(above := g.above, license := g.license, score := g.score), length(g.above)) AS g
  FROM (SELECT DISTINCT dir FROM placed) d JOIN grants g ON d.dir = g.above OR starts_with(d.dir, g.above || '/') GROUP BY d.dir)
SELECT doc_id, f.dir || '/' || name AS path, coalesce(f.license, g.license) AS license,
  CASE WHEN f.license IS NOT NULL THEN 'own' WHEN g IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN f.license IS NULL THEN g.above END AS licensed_by, round(coalesce(f.score, g.score), 6) AS score
FROM files f LEFT JOIN nearest n ON n.dir = f.dir""".replace("TEMPLATE_ROWS", ", ".join("('%s', '%s')" % t for t in licenses.TEMPLATES)),
    "op7_warc": r"""
WITH bodies AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
digests AS (SELECT page_id, octet_length(body)::BIGINT AS payload_bytes, sha1(body) AS hex FROM bodies),
bits AS (
  SELECT *, array_to_string([lpad(bin(instr('0123456789abcdef', hex[i + 1]) - 1), 4, '0') for i in range(40)], '') AS b,
         max(page_id) OVER (PARTITION BY hex) AS last FROM digests)
SELECT page_id, payload_bytes,
       array_to_string(['ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
         16 * b[5 * i + 1]::INT + 8 * b[5 * i + 2]::INT + 4 * b[5 * i + 3]::INT + 2 * b[5 * i + 4]::INT + b[5 * i + 5]::INT + 1]
         for i in range(32)], '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last THEN last END AS refers_to
FROM bits""",
    "op11_phrase_collocations": r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM documents),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, m, w[i:i + m - 1] AS p FROM (
  SELECT lang, m, w, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, w, unnest([1, 2, 3, 4]) AS m FROM pieces) WHERE len(w) >= m)),
f AS (SELECT lang, p, m, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
cut AS (
  SELECT c.lang, c.p, c.m, c.a, k, l.a AS l, r.a AS r, (2000000::HUGEINT * c.a // (l.a + r.a))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c
  JOIN f l ON l.lang = c.lang AND l.p = c.p[1:k] JOIN f r ON r.lang = c.lang AND r.p = c.p[k + 1:]),
lowest AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
inner_parts AS (SELECT lang, p[i:i + s - 1] AS p, max(a) AS longer FROM (
  SELECT *, unnest(range(1, m - s + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS s FROM f WHERE m > 2)) GROUP BY ALL),
best AS (
  SELECT c.lang, array_to_string(c.p, ' ') AS phrase, a, l, r, score FROM lowest c LEFT JOIN inner_parts i ON i.lang = c.lang AND i.p = c.p
  WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase, a, l, r, n, score
FROM best JOIN totals USING (lang) QUALIFY rank <= 2000""",
    "op12_prefix_trie": r"""
WITH turns AS (
  SELECT conv_id AS c, role, text, whole, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, encode(role), whole) - 1 AS p
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
               sha256(concat(octet_length(encode(coalesce(role, ''))), ':', coalesce(role, ''), ':', coalesce(text, ''))) AS whole
        FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
  SELECT c, c - c % 20 AS base,
         (xor(list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
                          lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295)) % 4 AS h
  FROM (SELECT DISTINCT c FROM turns)),
rebuilt AS (
  SELECT v.c, 0 AS own, t.p, whole, text FROM convs v JOIN turns t ON t.c = v.base AND t.p < v.h
  UNION ALL SELECT v.c, 1, t.p, whole, text FROM convs v JOIN turns t ON t.c = v.c AND t.p >= v.h),
placed AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY own, p) AS d, whole, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM rebuilt
  UNION ALL SELECT c, 0, '', 0 FROM convs),
keyed AS (SELECT c, d, words, sha256(string_agg(whole, ',') OVER (PARTITION BY c ORDER BY d)) AS key, d = max(d) OVER (PARTITION BY c) AS last FROM placed),
paths AS (SELECT *, lag(key) OVER (PARTITION BY c ORDER BY d) AS parent FROM keyed),
nodes AS (
  SELECT key, any_value(d) AS depth, any_value(parent) AS parent, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (last), '')) AS ends_sha256 FROM paths GROUP BY key),
children AS (SELECT parent AS key, count(*) AS n FROM nodes GROUP BY parent),
counted AS (SELECT nodes.*, coalesce(n, 0) AS n_children FROM nodes LEFT JOIN children USING (key)),
below AS (
  SELECT p.key, sum((x.n_children = 0)::INT)::BIGINT AS n_leaves, sum((x.n_convs - 1) * x.words)::BIGINT AS saved_tokens
  FROM counted x JOIN paths p ON p.c = x.conv_id AND p.d <= x.depth GROUP BY p.key)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM counted n JOIN below USING (key) LEFT JOIN nodes u ON u.key = n.parent""",
    "op13_exact_dedup": """
WITH texts AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS text FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY text ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM texts WINDOW same AS (PARTITION BY text)""",
    "op9_url_filter": r"""
WITH rest AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(r, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '(?s)^[^/?#]*(/[^?#]*)?', 1) AS path FROM rest),
rules(rhost, rpath, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                                 ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
best AS (
  SELECT s.page_id, s.host, s.path, max_by(struct_pack(rule := rhost || rpath, verdict := r.verdict), length(rhost || rpath)) AS b
  FROM split s LEFT JOIN rules r ON (s.host = rhost OR ends_with(s.host, '.' || rhost)) AND starts_with(s.path, rpath)
  GROUP BY ALL)
SELECT page_id, host, path, b.rule AS rule, coalesce(b.verdict, 'allow') AS verdict FROM best""",
}
