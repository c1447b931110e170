"""The same results in plain SQL, for the queries SQL can express.

Pair counts are self-joins of the cells here, tails are summed with lgamma.
"""

from __future__ import annotations

from skein.plans.queries import EVENT_GAP, LETTER_CUTOFF, MAX_DROP, MIN_COV, MIN_GROUP, RELATIVE_DROP

ORDER_CELLS = """SELECT l_orderkey AS row_id, l_linenumber - 1 AS col, strpos('ANR', min(l_returnflag)) - 1 AS sym
FROM lineitem GROUP BY l_orderkey, l_linenumber"""

LETTER_CELLS = """SELECT row_id, col, CASE WHEN share = 0 THEN 0 WHEN share < 15 THEN 1 WHEN share < 40 THEN 2
WHEN share < 80 THEN 3 ELSE 4 END AS sym FROM (SELECT doc_id AS row_id, c AS col,
(1000 * (length(t) - length(replace(t, chr(CAST(97 + c AS INTEGER)), '')))) // greatest(len, 1) AS share
FROM (SELECT doc_id, lower(text) AS t, length(text) AS len FROM documents), (SELECT unnest(range(26)) AS c))"""

LINE_CELLS = """SELECT row_id, i - 1 AS col, length(lines[i]) % 5 AS sym FROM
(SELECT doc_id AS row_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM
(SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)) WHERE lines[i] <> ''"""

EVENT_CELLS = """SELECT user_id AS row_id, day(ts) - 1 AS col,
list_position(['click', 'error', 'purchase', 'signup', 'view'], min(event_type)) - 1 AS sym
FROM events GROUP BY user_id, day(ts)"""

LANGUAGE = "SELECT doc_id AS row_id, list_position(['de', 'en', 'es', 'fr'], lang) - 1 AS label FROM documents"
STATUS = "SELECT o_orderkey AS row_id, strpos('FOP', o_orderstatus) - 1 AS label FROM orders"
SOURCE = """SELECT doc_id AS row_id, CASE WHEN doc_id IN (SELECT doc_id FROM labels)
THEN CAST(substr(source, 4) AS BIGINT) END AS label FROM documents"""
SOURCE_COPY = "SELECT doc_id AS row_id, CAST(substr(source, 4) AS BIGINT) AS label FROM documents"
CLEAN = "regexp_replace(lower(text), '[^acgt]', '', 'g')"
SIGNS = """SELECT vec_id AS row_id, label, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS bits
FROM embeddings"""


def line_label(number: int) -> str:
    return f"""SELECT o_orderkey AS row_id, sym AS label FROM orders LEFT JOIN
(SELECT row_id, sym FROM cells WHERE col = {number - 1}) ON row_id = o_orderkey"""


def shown(body: str, ints: str = "", doubles: str = "", texts: str = "", ctes: str = "") -> str:
    out = [f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()]
    out += [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in doubles.split()]
    out += texts.split()
    head = f"WITH {ctes} " if ctes else ""
    return f"{head}SELECT {', '.join(out)} FROM ({body}) AS result"


def choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1.0) - lgamma({k} + 1.0) - lgamma({n} - {k} + 1.0))"


def tail(first: str, last: str, g1: str = "g1", g2: str = "g2", n: str = "cov") -> str:
    """Capped -log10 of the hypergeometric probability of first..last."""
    pmf = f"exp({choose(g2, 't')} + {choose(f'({n} - {g2})', f'({g1} - t)')} - {choose(n, g1)})"
    total = f"list_sum(list_transform(generate_series(CAST({first} AS BIGINT), CAST({last} AS BIGINT)), lambda t: {pmf}))"
    return f"least(99.0, greatest(0.0, -log10(greatest({total}, 1e-300))))"


UPPER = tail("k", "least(g1, g2)")
LOWER = tail("greatest(0, g1 + g2 - cov)", "k")


def significance(base: float) -> str:
    return f"""CASE WHEN k < 1 THEN 0.0 WHEN raw > 98 THEN {base} + 2.0 * k / (size_i + size_j) ELSE raw END"""


def counts(gap: int, cells: str = "cells", by: str = "") -> str:
    """CTEs sizes, colcov, pairs: all group pairs of ``cells`` at least ``gap`` columns apart."""
    return f"""sizes AS (SELECT col, sym, count(*) AS size FROM {cells} GROUP BY col, sym),
colcov AS (SELECT col, count(*) AS cov, count(*) FILTER (sym < 4) AS bases FROM {cells} GROUP BY col),
raw_pairs AS (SELECT x.col AS ci, x.sym AS si, y.col AS cj, y.sym AS sj, count(*) AS k FROM {cells} x JOIN {cells} y
ON x.row_id = y.row_id AND y.col >= x.col + {gap} GROUP BY ALL),
pairs AS (SELECT ci, si, cj, sj, k, sum(k) OVER (PARTITION BY ci, cj) AS cov,
sum(k) OVER (PARTITION BY ci, cj, si) AS g1, sum(k) OVER (PARTITION BY ci, cj, sj) AS g2 FROM raw_pairs),
sized AS (SELECT p.*, a.size AS size_i, b.size AS size_j FROM pairs p JOIN sizes a ON a.col = ci AND a.sym = si
JOIN sizes b ON b.col = cj AND b.sym = sj)"""


def all_counts(gap: int) -> str:
    """Like :func:`counts`, plus ``zero_pairs`` with the pairs of groups that never meet."""
    return counts(gap) + """,
every AS (SELECT DISTINCT x.ci, x.si, x.cj, y.sj, x.cov, x.g1, y.g2 FROM pairs x JOIN pairs y ON x.ci = y.ci AND x.cj = y.cj),
zero_pairs AS (SELECT e.ci, e.si, e.cj, e.sj, e.cov, e.g1, e.g2, coalesce(p.k, 0) AS k FROM every e LEFT JOIN pairs p
ON p.ci = e.ci AND p.si = e.si AND p.cj = e.cj AND p.sj = e.sj)"""


LETTERS = f"cells AS MATERIALIZED ({LETTER_CELLS}), n_rows AS (SELECT count(*) AS n FROM documents), " + counts(1)

# tested pairs of the letter matrix: both groups eligible, scan to the right unbroken
LETTER_TESTED = LETTERS + f""",
tested AS MATERIALIZED (SELECT ci, si, cj, sj, k, {significance(98.0)} AS z FROM
(SELECT *, {UPPER} AS raw FROM sized WHERE cov >= {MIN_COV} AND size_i > {MIN_COV // 4} AND size_j > {MIN_COV // 4}
AND size_i < (SELECT n FROM n_rows) AND size_j < (SELECT n FROM n_rows))),
both_ways AS (SELECT ci * 5 + si AS g, cj * 5 + sj AS partner, z FROM tested
UNION ALL SELECT cj * 5 + sj, ci * 5 + si, z FROM tested),
max_z AS MATERIALIZED (SELECT r.g, coalesce(max(z), 0.0) AS z FROM (SELECT unnest(range(130)) AS g) r LEFT JOIN both_ways b ON b.g = r.g GROUP BY r.g)"""

CLIQUES = LETTER_TESTED + f""",
seeds AS (SELECT g AS seed FROM max_z WHERE z > {LETTER_CUTOFF}),
links AS (SELECT ci * 5 + si AS a, cj * 5 + sj AS b, {significance(97.9)} AS z FROM
(SELECT *, {UPPER} AS raw FROM sized WHERE k > {MIN_COV // 4})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY round(z, 9) DESC, g) AS rank FROM
(SELECT seed, b AS g, z FROM seeds JOIN links ON a = seed UNION ALL SELECT seed, a, z FROM seeds JOIN links ON b = seed) WHERE z > {LETTER_CUTOFF}),
members AS MATERIALIZED (SELECT seed, g, z, rank FROM ranked WHERE rank < 30 UNION ALL SELECT seed, seed, NULL, 0 FROM seeds),
clique_size AS (SELECT seed, count(*) AS size FROM members GROUP BY seed HAVING count(*) > 5),
hit_rows AS MATERIALIZED (SELECT m.seed, c.row_id, count(*) AS hits, count(*) FILTER (m.g = m.seed) AS in_seed FROM members m
JOIN clique_size USING (seed) JOIN cells c ON c.col * 5 + c.sym = m.g GROUP BY m.seed, c.row_id),
cuts AS (SELECT seed, size, unnest(range(size)) AS c FROM clique_size),
above AS MATERIALIZED (SELECT seed, size, c, count(row_id) AS n_rows, count(row_id) FILTER (in_seed > 0) AS n_seed
FROM cuts LEFT JOIN hit_rows USING (seed) WHERE hits > c OR hits IS NULL GROUP BY seed, size, c),
filled AS MATERIALIZED (SELECT cuts.seed, cuts.size, cuts.c, coalesce(n_rows, 0) AS n_rows, coalesce(n_seed, 0) AS n_seed
FROM cuts LEFT JOIN above USING (seed, c)),
drops AS (SELECT seed, size, c, (before - after) / least((SELECT n FROM n_rows) - n_rows, n_rows) AS d FROM
(SELECT *, lag(n_rows) OVER w AS before, lead(n_rows) OVER w AS after FROM filled WINDOW w AS (PARTITION BY seed ORDER BY c))
WHERE c >= 1 AND c <= size - 2 AND least((SELECT n FROM n_rows) - n_rows, n_rows) > 0),
dropoff AS MATERIALIZED (SELECT seed, size, coalesce(min(d), 1000000.0) AS drop_off, coalesce(arg_min(c, (d, c)), 1) AS cutoff
FROM clique_size LEFT JOIN (SELECT seed, c, d FROM drops) USING (seed) GROUP BY seed, size),
refined AS (SELECT d.seed, d.size, d.cutoff, d.drop_off, f.n_rows FROM dropoff d JOIN filled f ON f.seed = d.seed AND f.c = d.cutoff),
refined_rows AS MATERIALIZED (SELECT h.seed, h.row_id FROM hit_rows h JOIN dropoff d USING (seed) WHERE hits > cutoff)"""

BINOMIAL = "exp({choose} + t * ln({p}) + ({v} - t) * ln(1 - {p}))"


def binomial_above(c: str, v: str, p: float) -> str:
    pmf = BINOMIAL.format(choose=choose(v, "t"), p=p, v=v)
    return f"list_sum(list_transform(generate_series({c} + 1, {v}), lambda t: {pmf}))"


ORDER_LINES = 7  # most lines of an order in the given tables


def line_labels() -> str:
    """Clusterings of the orders by each of their lines, and by their status."""
    return ", ".join([f"cells AS MATERIALIZED ({ORDER_CELLS})", *(f"l{k} AS ({line_label(k)})" for k in range(1, ORDER_LINES + 1)), f"st AS ({STATUS})"])


def step(name: str, a: str, b: str) -> str:
    return f"""{name} AS (SELECT i, j, n / sum(n) OVER (PARTITION BY i) AS p FROM (SELECT x.label AS i, y.label AS j, count(*) AS n
FROM {a} x JOIN {b} y USING (row_id) WHERE x.label IS NOT NULL AND y.label IS NOT NULL GROUP BY x.label, y.label))"""


def product(name: str, a: str, b: str) -> str:
    return f"{name} AS (SELECT {a}.i, {b}.j, sum({a}.p * {b}.p) AS p FROM {a} JOIN {b} ON {a}.j = {b}.i GROUP BY {a}.i, {b}.j)"


def linked(forward: str, backward: str) -> str:
    return f"""linked AS (SELECT i, j, round(p / sum(p) OVER (PARTITION BY i), 12) AS p FROM
(SELECT f.i, f.j, f.p * b.p AS p FROM {forward} f JOIN {backward} b ON f.i = b.j AND f.j = b.i))"""


MUTUAL = """top AS (SELECT i, max(p) AS confidence, arg_max(j, (p, -j)) AS best FROM linked GROUP BY i),
states AS (SELECT t.i, t.best, t.confidence, CASE WHEN t.confidence <> coalesce(o.confidence, -1) THEN 0 WHEN t.best = t.i THEN 1 ELSE -1 END AS state
FROM top t LEFT JOIN top o ON o.i = t.best)"""

VECTORS = """truth AS (SELECT vec_id AS row_id, label FROM embeddings),
found AS (SELECT vec_id AS row_id, list_position(embedding, list_max(embedding)) AS label FROM embeddings),
met AS (SELECT t.label AS i, f.label AS j, count(*) AS n FROM truth t JOIN found f USING (row_id) GROUP BY t.label, f.label),
there AS (SELECT i, j, n / sum(n) OVER (PARTITION BY i) AS p FROM met), back AS (SELECT j AS i, i AS j, n / sum(n) OVER (PARTITION BY j) AS p FROM met),
""" + product("joint", "there", "back") + """,
linked AS (SELECT i, j, round(p / sum(p) OVER (PARTITION BY i), 12) AS p FROM joint), """ + MUTUAL

CONSENSUS = f"""cells AS MATERIALIZED ({LETTER_CELLS}), truth AS ({SOURCE_COPY}),
votes AS (SELECT label, col, sym, count(*) AS n FROM cells JOIN truth USING (row_id) GROUP BY ALL),
consensus AS MATERIALIZED (SELECT label, col, arg_max(sym, (n, -sym)) AS sym FROM votes GROUP BY label, col),
differ AS (SELECT a.label AS copy, b.label AS other, a.col >= 13 AS half, count(*) FILTER (a.sym <> b.sym) AS diff
FROM consensus a JOIN consensus b ON a.col = b.col AND a.label <> b.label GROUP BY ALL)"""

TURNS = f"""turns AS MATERIALIZED (SELECT conv_id AS read_id, turn AS piece, role, {CLEAN} AS seq,
row_number() OVER (ORDER BY conv_id, turn) - 1 AS seq_id, CASE WHEN role = 'user' THEN 'l' ELSE 'r' END AS cls FROM conversations)"""

HITS = """hits AS (SELECT user_id AS read_id, list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1 AS part,
CAST(floor(epoch(ts)) AS BIGINT) AS pos FROM events),
adjacent AS (SELECT read_id, part, next_part, abs(pos + 3600 - next_pos) AS distance FROM (SELECT *, lead(part) OVER w AS next_part,
lead(pos) OVER w AS next_pos FROM hits WINDOW w AS (PARTITION BY read_id ORDER BY pos, part)) WHERE next_part IS NOT NULL),
histogram AS (SELECT part, next_part, CAST(floor(ln(1 + distance) / ln(1.5)) AS BIGINT) AS bucket, count(*) AS n FROM adjacent GROUP BY ALL)"""

NEAR = f"""points AS MATERIALIZED ({SIGNS}),
near AS (SELECT x.label, x.row_id, y.row_id AS other, y.bits AS obits,
list_sum(list_transform(list_zip(x.bits, y.bits), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)) AS dist
FROM points x JOIN points y ON x.label = y.label),
top5 AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY dist, other) <= 5),
centers AS MATERIALIZED (SELECT label, row_id, list(bit ORDER BY pos) AS center FROM (SELECT label, row_id, pos, CASE WHEN sum(b) > 2 THEN 1 ELSE 0 END AS bit
FROM (SELECT label, row_id, unnest(obits) AS b, generate_subscripts(obits, 1) AS pos FROM top5) GROUP BY label, row_id, pos) GROUP BY label, row_id)"""

def event_tested(stop: bool = True) -> str:
    within = "cj < coalesce(stop, 99)" if stop else f"cov >= {MIN_COV}"
    return f"""cells AS MATERIALIZED ({EVENT_CELLS}), n_rows AS (SELECT count(DISTINCT row_id) AS n FROM cells), {counts(EVENT_GAP)},
days AS (SELECT unnest(range(31)) AS col),
shared AS (SELECT ci, cj, max(cov) AS cov FROM pairs GROUP BY ci, cj),
stops AS (SELECT a.col AS ci, min(b.col) FILTER (coalesce(s.cov, 0) < {MIN_COV}) AS stop FROM days a JOIN days b ON b.col >= a.col + {EVENT_GAP}
LEFT JOIN shared s ON s.ci = a.col AND s.cj = b.col GROUP BY a.col),
tested AS (SELECT ci, si, cj, sj, {significance(98.0)} AS z FROM (SELECT *, {UPPER} AS raw FROM sized JOIN stops USING (ci)
JOIN (SELECT col FROM colcov WHERE bases > cov // 2) ON col = ci WHERE {within}
AND size_i > {MIN_COV // 4} AND size_j > {MIN_COV // 4} AND size_i < (SELECT n FROM n_rows) AND size_j < (SELECT n FROM n_rows))),
max_z AS (SELECT r.g, coalesce(max(z), 0.0) AS z FROM (SELECT unnest(range(155)) AS g) r LEFT JOIN
(SELECT ci * 5 + si AS g, z FROM tested UNION ALL SELECT cj * 5 + sj, z FROM tested) b ON b.g = r.g GROUP BY r.g)"""


def oracles() -> dict[str, str]:
    cells = {"o": f"cells AS ({ORDER_CELLS})", "l": f"cells AS ({LETTER_CELLS})", "d": f"cells AS ({LINE_CELLS})",
             "e": f"cells AS ({EVENT_CELLS})"}
    n_sym = ", ".join(f"count(*) FILTER (sym = {i}) AS n{i}" for i in range(5))
    by_col = f"SELECT col, {n_sym}, count(*) AS cov FROM cells GROUP BY col"
    q: dict[str, str] = {}

    # --- matrix
    q["base_group_size"] = shown("SELECT col, sym, count(*) AS size FROM cells GROUP BY col, sym", "col sym size", ctes=cells["o"])
    q["column_coverage"] = shown("SELECT col, count(*) AS cov FROM cells GROUP BY col", "col cov", ctes=cells["d"])
    q["weighted_consensus"] = shown("SELECT col, " + ", ".join(f"cov - n{i} AS w{i}" for i in range(5)) + f", cov AS w5 FROM ({by_col})",
                                    "col w0 w1 w2 w3 w4 w5", ctes=cells["o"])
    q["column_consensus"] = shown("SELECT col, arg_max(sym, (n, -sym)) AS sym, max(n) AS n FROM (SELECT col, sym, count(*) AS n FROM cells GROUP BY ALL) GROUP BY col",
                                  "col sym n", ctes=cells["l"])
    q["copy_consensus"] = shown("SELECT label, col, arg_max(sym, (n, -sym)) AS sym, max(n) AS n FROM (SELECT label, col, sym, count(*) AS n FROM cells JOIN lang USING (row_id) GROUP BY ALL) GROUP BY label, col",
                                "label col sym n", ctes=cells["l"] + f", lang AS ({LANGUAGE})")
    q["eligible_groups"] = shown(f"SELECT col, sym, count(*) AS size FROM cells GROUP BY col, sym HAVING count(*) > {MIN_COV // 4} AND count(*) < (SELECT count(DISTINCT row_id) FROM cells)",
                                 "col sym size", ctes=cells["e"])
    q["base_dominated_columns"] = shown(f"SELECT * FROM ({by_col}) WHERE n0 + n1 + n2 + n3 > cov // 2", "col n0 n1 n2 n3 n4 cov", ctes=cells["l"])
    q["well_covered_columns"] = shown("SELECT col, cov FROM (SELECT col, count(*) AS cov, max(count(*)) OVER () AS best FROM cells GROUP BY col) WHERE cov * 10 >= best * 9",
                                      "col cov", ctes=cells["e"])
    q["row_score"] = shown("SELECT x.row_id, sum(c.cov - g.size) AS score FROM cells x JOIN (SELECT col, count(*) AS cov FROM cells GROUP BY col) c USING (col) JOIN (SELECT col, sym, count(*) AS size FROM cells GROUP BY ALL) g USING (col, sym) GROUP BY x.row_id",
                           "row_id score", ctes=cells["o"])
    q["sum_of_pairs_score"] = shown(f"SELECT sum(cov * cov - n0 * n0 - n1 * n1 - n2 * n2 - n3 * n3 - n4 * n4) AS score, count(*) AS width FROM ({by_col})", "score width", ctes=cells["d"])
    q["alignment_quality"] = shown(f"SELECT sum(n0 * (cov - n0) + n1 * (cov - n1) + n2 * (cov - n2) + n3 * (cov - n3)) / sum((cov - n4) * cov) AS quality FROM ({by_col})",
                                   "", "quality", ctes=cells["e"])
    ends = "SELECT row_id FROM cells WHERE col IN (3, 20) GROUP BY row_id HAVING count(*) = 2"
    q["full_coverage_rows"] = shown(f"SELECT row_id, col - 3 AS col, sym FROM cells WHERE col BETWEEN 3 AND 20 AND row_id IN ({ends})", "row_id col sym", ctes=cells["e"])
    q["excluded_rows"] = shown(f"SELECT DISTINCT row_id FROM cells WHERE row_id NOT IN ({ends})", "row_id", ctes=cells["e"])
    q["sliced_columns"] = shown("SELECT row_id, col - 2 AS col, sym FROM cells WHERE col BETWEEN 2 AND 5", "row_id col sym", ctes=cells["o"])
    window = f"""cells AS ({LINE_CELLS}), width AS (SELECT max(len(string_split(text, chr(10)))) AS w FROM documents),
sampled AS (SELECT s.col, coalesce(c.cov, 0) AS cov FROM (SELECT unnest(range(0, (SELECT w FROM width), 10)) AS col) s
LEFT JOIN (SELECT col, count(*) AS cov FROM cells GROUP BY col) c USING (col)),
stats AS (SELECT CAST(sum(cov) AS BIGINT) // count(*) AS average, max(cov) AS best FROM sampled),
win AS (SELECT min(col) AS first_col, max(col) AS last_col, max(average) AS average, max(best) AS best FROM sampled, stats WHERE cov >= 0.9 * average)"""
    q["coverage_window"] = shown("SELECT * FROM win", "first_col last_col average best", ctes=window)
    q["window_pairs"] = shown("SELECT p AS window_id, first_col + (p * (last_col - first_col)) // 3 AS from_col, first_col + ((p + 1) * (last_col - first_col)) // 3 AS to_col FROM win, (SELECT unnest(range(3)) AS p)",
                              "window_id from_col to_col", ctes=window)
    # a gap stays when its run of gaps lies between two bases and holds no blank
    q["gap_runs_to_blank"] = shown("""SELECT row_id, col, sym FROM (SELECT *, max(CASE WHEN sym < 4 THEN col END) OVER (PARTITION BY row_id ORDER BY col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
min(CASE WHEN sym < 4 THEN col END) OVER (PARTITION BY row_id ORDER BY col ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after,
row_number() OVER (PARTITION BY row_id ORDER BY col) AS nth FROM cells) x
WHERE sym < 4 OR (before IS NOT NULL AND after IS NOT NULL AND (SELECT count(*) FROM cells y WHERE y.row_id = x.row_id AND y.col > x.before AND y.col < x.after) = after - before - 1)""",
                                   "row_id col sym", ctes=cells["d"])
    q["drop_empty_columns"] = shown("SELECT row_id, n.new_col AS col, sym FROM cells JOIN (SELECT col, row_number() OVER (ORDER BY col) - 1 AS new_col FROM (SELECT DISTINCT col FROM cells WHERE sym < 4)) n USING (col)",
                                    "row_id col sym", ctes=cells["d"])
    q["base_positions"] = shown("SELECT row_id, row_number() OVER (PARTITION BY row_id ORDER BY col) - 1 AS pos, col, sym FROM cells WHERE sym < 4", "row_id pos col sym", ctes=cells["e"])

    # --- co-occurrence
    orders = f"cells AS MATERIALIZED ({ORDER_CELLS}), " + counts(1)
    q["pair_counts"] = shown("SELECT * FROM pairs", "ci si cj sj k g1 g2 cov", ctes=orders)
    q["pair_significance"] = shown("SELECT * FROM tested", "ci si cj sj k", "z", ctes=LETTER_TESTED)
    q["max_correlation"] = shown("SELECT * FROM max_z", "g", "z", ctes=event_tested())
    q["max_correlation_any_gap"] = shown("SELECT * FROM max_z", "g", "z", ctes=event_tested(stop=False))
    q["max_correlation_letters"] = shown("SELECT * FROM max_z", "g", "z", ctes=LETTER_TESTED)
    q["column_max_correlation"] = shown("SELECT g // 5 AS col, max(z) AS z FROM max_z GROUP BY g // 5", "col", "z", ctes=LETTER_TESTED)
    q["window_correlations"] = shown("SELECT g - 25 AS g, z FROM max_z WHERE g // 5 BETWEEN 5 AND 17", "g", "z", ctes=LETTER_TESTED)
    q["thin_columns_masked"] = shown("SELECT g, CASE WHEN bases * 10 >= (SELECT max(bases) FROM colcov) * 9 THEN z ELSE 0.0 END AS z FROM max_z JOIN colcov ON col = g // 5", "g", "z", ctes=LETTER_TESTED)
    partners = f"SELECT g, count(*) AS partners FROM both_ways WHERE z > {LETTER_CUTOFF} GROUP BY g"
    q["significant_partner_count"] = shown(partners, "g partners", ctes=LETTER_TESTED)
    q["lonely_groups_dropped"] = shown(f"SELECT m.g, CASE WHEN coalesce(partners, 0) >= 40 THEN z ELSE 0.0 END AS z FROM max_z m LEFT JOIN ({partners}) p ON p.g = m.g", "g", "z", ctes=LETTER_TESTED)
    q["partner_histogram"] = shown(f"SELECT least(coalesce(partners, 0), 49) AS partners, count(*) AS groups FROM max_z m LEFT JOIN ({partners}) p ON p.g = m.g GROUP BY 1", "partners groups", ctes=LETTER_TESTED)
    q["snowball"] = shown("SELECT m.g, CASE WHEN m.g IN (SELECT g FROM reached) AND z > %r THEN z ELSE 0.0 END AS z FROM max_z m" % LETTER_CUTOFF, "g", "z",
                          ctes="RECURSIVE " + LETTER_TESTED + f""", links AS MATERIALIZED (SELECT g, partner FROM both_ways WHERE z > {LETTER_CUTOFF}),
reached AS (SELECT col * 5 + sym AS g FROM sizes, n_rows WHERE size > n // 4 AND size < n - n // 4 UNION SELECT partner FROM reached JOIN links USING (g))""")
    err = "sum(CASE WHEN {c} THEN {v} END)"
    base_col = "(top > n4 AND holders = 1)"
    q["error_estimate"] = shown(f"""SELECT {err.format(c=base_col, v='(bases - top) / cov')} / nullif(3 * count(*) FILTER {('(WHERE ' + base_col + ')')}, 0) AS base_to_base,
{err.format(c=base_col, v='n4 / cov')} / nullif(count(*) FILTER (WHERE {base_col}), 0) AS base_to_gap,
{err.format(c='n4 > top', v='bases / cov')} / nullif(4 * count(*) FILTER (WHERE n4 > top), 0) AS gap_to_base
FROM (SELECT *, greatest(n0, n1, n2, n3) AS top, n0 + n1 + n2 + n3 AS bases, (n0 = greatest(n0, n1, n2, n3))::INT + (n1 = greatest(n0, n1, n2, n3))::INT
+ (n2 = greatest(n0, n1, n2, n3))::INT + (n3 = greatest(n0, n1, n2, n3))::INT AS holders FROM ({by_col}) WHERE col IN (SELECT g // 5 FROM max_z GROUP BY g // 5 HAVING max(z) < 2.0))""",
                                "", "base_to_base base_to_gap gap_to_base", ctes=event_tested())
    q["two_sided_significance"] = shown(f"SELECT ci, si, cj, sj, greatest({UPPER}, {LOWER}) AS z FROM zero_pairs", "ci si cj sj", "z",
                                        ctes=f"cells AS MATERIALIZED ({ORDER_CELLS}), " + all_counts(1))
    local = LETTER_TESTED + f""", lang AS ({LANGUAGE}), universe AS (SELECT label, count(*) AS n FROM lang GROUP BY label HAVING count(*) > {2 * MIN_GROUP}),
chosen AS MATERIALIZED (SELECT label, col * 5 + sym AS g, count(*) AS size FROM cells JOIN lang USING (row_id) JOIN universe USING (label)
WHERE col * 5 + sym IN (SELECT g FROM max_z WHERE z > {LETTER_CUTOFF}) GROUP BY ALL HAVING count(*) >= {MIN_GROUP}),
met AS MATERIALIZED (SELECT label, x.col * 5 + x.sym AS a, y.col * 5 + y.sym AS b, count(*) AS k FROM cells x JOIN cells y ON x.row_id = y.row_id
AND y.col > x.col JOIN lang ON lang.row_id = x.row_id GROUP BY ALL),
rel AS (SELECT x.label, x.g AS a, y.g AS b, x.size AS g1, y.size AS g2, u.n AS cov, coalesce(m.k, 0) AS k FROM chosen x JOIN chosen y ON y.label = x.label AND y.g >= x.g + 100
JOIN universe u ON u.label = x.label LEFT JOIN met m ON m.label = x.label AND m.a = x.g AND m.b = y.g),
good AS (SELECT label, a, b FROM rel WHERE greatest({UPPER}, {LOWER}) > {LETTER_CUTOFF})"""
    q["relative_variables"] = shown("SELECT label, a AS g FROM good UNION SELECT label, b FROM good", "label g", ctes=local)
    q["f_beta"] = shown("SELECT ci, si, cj, sj, 2.0 * k / (2 * k + size_i - k + size_j - k) AS f1, 3.0 * k / (5 * k + 4 * (size_i - k) + size_j - k) AS f2 FROM sized",
                        "ci si cj sj", "f1 f2", ctes=orders)
    q["group_setops"] = shown("SELECT ci * 5 + si AS a, cj * 5 + sj AS b, k AS shared, size_i - k AS only_a, size_j - k AS only_b, size_i + size_j - k AS either, (SELECT count(DISTINCT row_id) FROM cells) - size_i - size_j + 2 * k AS agreeing FROM sized",
                              "a b shared only_a only_b either agreeing", ctes=orders)
    directed = LETTERS + """, directed AS (SELECT ci * 5 + si AS a, cj * 5 + sj AS b, g1 AS a_in_b, g2 AS b_in_a, k, cov FROM pairs UNION ALL SELECT cj * 5 + sj, ci * 5 + si, g2, g1, k, cov FROM pairs),
contained AS MATERIALIZED (SELECT * FROM directed WHERE a_in_b < b_in_a AND k + 3 > a_in_b)"""
    q["approx_containment"] = shown("SELECT * FROM contained", "a b a_in_b b_in_a k cov", ctes=directed)
    q["containment_chains"] = shown("""SELECT ab.a, ab.b, bc.b AS c, sa.size AS size_a, sb.size AS size_b, sc.size AS size_c FROM contained ab JOIN contained bc ON bc.a = ab.b
JOIN directed ac ON ac.a = ab.a AND ac.b = bc.b JOIN known sa ON sa.g = ab.a JOIN known sb ON sb.g = ab.b JOIN known sc ON sc.g = bc.b
WHERE sa.size < 400 AND sb.size < 400 AND sc.size < 900 AND ab.cov = sa.cov AND bc.cov = sb.cov AND ac.cov = sc.cov AND ac.k * 3 > sa.size
AND NOT EXISTS (SELECT 1 FROM contained x WHERE x.a = ab.a AND x.b = bc.b)""", "a b c size_a size_b size_c",
                                    ctes=directed + ", known AS (SELECT col * 5 + sym AS g, size, cov FROM sizes JOIN colcov USING (col))")
    q["intersect_pairs"] = shown(f"SELECT ci * 5 + si AS a, cj * 5 + sj AS b, k FROM sized WHERE k > {MIN_COV // 2} AND size_i > 2 * k AND size_j > 2 * k AND ci * 5 + si IN (SELECT g FROM max_z WHERE z > {LETTER_CUTOFF}) AND cj * 5 + sj IN (SELECT g FROM max_z WHERE z > {LETTER_CUTOFF})",
                                 "a b k", ctes=LETTER_TESTED)

    # --- cliques
    q["clique_topk"] = shown("SELECT seed, rank, g, z FROM members WHERE rank > 0", "seed rank g", "z", ctes=CLIQUES)
    q["clique_histogram"] = shown("SELECT seed, c AS cutoff, n_rows FROM filled", "seed cutoff n_rows", ctes=CLIQUES)
    q["dropoff_cutoff"] = shown("SELECT * FROM dropoff", "seed size cutoff", "drop_off", ctes=CLIQUES)
    q["refined_groups"] = shown("SELECT * FROM refined", "seed size cutoff n_rows", "drop_off", ctes=CLIQUES)
    q["refined_members"] = shown("SELECT seed, row_id FROM refined_rows", "seed row_id", ctes=CLIQUES)
    q["clique_coverage"] = shown("SELECT seed, count(*) AS n_rows FROM (SELECT m.seed, c.row_id, count(*) AS covered FROM members m JOIN clique_size USING (seed) JOIN cells c ON c.col = m.g // 5 GROUP BY m.seed, c.row_id) JOIN dropoff USING (seed) WHERE covered > cutoff GROUP BY seed",
                                 "seed n_rows", ctes=CLIQUES)
    q["group_precision"] = shown("""SELECT seed, sum(greatest(n, 30 - n)) + ((SELECT n FROM n_rows) // 30 - count(*)) * 30 AS majority, sum(least(n, 30 - n)) AS minority FROM
(SELECT seed, row_id // 30 AS b, count(*) AS n FROM refined_rows WHERE row_id < (SELECT n FROM n_rows) // 30 * 30 GROUP BY ALL) GROUP BY seed""", "seed majority minority", ctes=CLIQUES)
    q["clique_conflicts"] = shown("SELECT a.seed AS a, b.seed AS b, coalesce(s.n, 0) AS shared FROM (SELECT DISTINCT seed FROM refined_rows) a JOIN (SELECT DISTINCT seed FROM refined_rows) b ON a.seed < b.seed LEFT JOIN (SELECT x.seed AS a, y.seed AS b, count(*) AS n FROM refined_rows x JOIN refined_rows y ON x.row_id = y.row_id AND x.seed < y.seed GROUP BY ALL) s ON s.a = a.seed AND s.b = b.seed WHERE coalesce(s.n, 0) < 20",
                                  "a b shared", ctes=CLIQUES)
    q["core_group"] = shown("""SELECT seed, target, cutoff, coalesce(f.n_rows, 0) AS n_rows FROM (SELECT f.seed, target, coalesce(min(f.c) FILTER (f.n_rows <= target), max(f.size)) AS cutoff FROM filled f
JOIN (SELECT col * 5 + sym AS seed, CAST(floor(size * CASE WHEN size < 100 THEN 0.77::DOUBLE WHEN size < 1000 THEN 0.83::DOUBLE WHEN size < 2000 THEN 0.9::DOUBLE ELSE 0.93::DOUBLE END) AS BIGINT) AS target FROM sizes) t USING (seed) GROUP BY f.seed, target) x
LEFT JOIN (SELECT seed AS s, c, n_rows FROM filled) f ON f.s = seed AND f.c = cutoff""", "seed target cutoff n_rows", ctes=CLIQUES)
    gain = f"30 * {binomial_above('c', 'size', 0.7)} / greatest((SELECT n FROM n_rows) * {binomial_above('c', 'size', 0.05)}, 1.0)"
    best_cut = f"best_cut AS MATERIALIZED (SELECT seed, size, arg_max(c, (round(gain, 12), -c)) AS best_cutoff FROM (SELECT seed, size, c, {gain} AS gain FROM cuts) GROUP BY seed, size)"
    q["binomial_best_cutoff"] = shown("SELECT * FROM best_cut", "seed size best_cutoff", ctes=CLIQUES + ", " + best_cut)
    q["expected_chance_rows"] = shown(f"SELECT seed, c, (SELECT n FROM n_rows) * coalesce({binomial_above('c', 'size', 0.05)}, 0.0) AS expected FROM clique_size, (SELECT unnest(range(6)) AS c)", "seed c", "expected", ctes=CLIQUES)
    korr = f"""trials AS (SELECT f.seed, f.c, f.n_seed AS k, f.n_rows AS g1, s.size AS g2, v.cov, f.n_rows AS size_i, s.size AS size_j FROM filled f JOIN best_cut b USING (seed)
JOIN sizes s ON s.col * 5 + s.sym = f.seed JOIN colcov v ON v.col = f.seed // 5 WHERE f.c >= b.best_cutoff),
scored AS (SELECT seed, c, {significance(97.9)} AS z FROM (SELECT *, CASE WHEN k < 1 THEN 0.0 ELSE {UPPER} END AS raw FROM trials))"""
    q["korr_max_cutoff"] = shown("SELECT seed, max(z) AS z, CASE WHEN max(z) > 0 THEN arg_max(c, (z, -c)) ELSE 0 END AS cutoff FROM scored GROUP BY seed", "seed cutoff", "z", ctes=CLIQUES + ", " + best_cut + ", " + korr)
    q["prefix_dropoff"] = shown("""SELECT s.seed, coalesce(x.d, 1000000.0) AS drop_off, coalesce(x.prefix, 0) AS size, coalesce(x.c, 1) AS cutoff FROM clique_size s LEFT JOIN (
SELECT seed, prefix, c, d FROM (SELECT seed, prefix, c, (lag(n) OVER w - lead(n) OVER w) / nullif(least((SELECT n FROM n_rows) - n, n), 0) AS d FROM counted WINDOW w AS (PARTITION BY seed, prefix ORDER BY c))
WHERE d IS NOT NULL AND c >= 1 AND c < prefix QUALIFY row_number() OVER (PARTITION BY seed ORDER BY d, prefix DESC, c DESC) = 1) x ON x.seed = s.seed""",
                                "seed size cutoff", "drop_off", ctes=CLIQUES + """,
prefixes AS (SELECT seed, unnest(range(5, size + 1)) AS prefix FROM clique_size),
prefix_hits AS MATERIALIZED (SELECT p.seed, p.prefix, c.row_id, count(*) AS hits FROM prefixes p JOIN members m ON m.seed = p.seed AND m.rank < p.prefix JOIN cells c ON c.col * 5 + c.sym = m.g GROUP BY ALL),
prefix_counts AS (SELECT seed, prefix, hits, count(*) AS n FROM prefix_hits GROUP BY ALL),
counted AS MATERIALIZED (SELECT p.seed, p.prefix, p.c, coalesce(sum(h.n), 0) AS n FROM (SELECT seed, prefix, unnest(range(prefix + 1)) AS c FROM prefixes) p LEFT JOIN prefix_counts h ON h.seed = p.seed AND h.prefix = p.prefix AND h.hits > p.c GROUP BY ALL)""")
    relative = CLIQUES + f""", lang AS ({LANGUAGE}),
universe AS (SELECT label, count(*) AS n FROM lang GROUP BY label HAVING count(*) > {2 * MIN_GROUP}), pairs_ls AS (SELECT label, seed, size FROM universe, clique_size),
rel_counts AS (SELECT label, seed, hits, count(*) AS n FROM hit_rows JOIN lang USING (row_id) GROUP BY ALL),
rel_filled AS MATERIALIZED (SELECT p.label, p.seed, p.size, p.c, coalesce(sum(h.n), 0) AS n FROM (SELECT label, seed, size, unnest(range(size)) AS c FROM pairs_ls) p
LEFT JOIN rel_counts h ON h.label = p.label AND h.seed = p.seed AND h.hits > p.c GROUP BY ALL),
rel_drops AS (SELECT label, seed, c, d FROM (SELECT *, (lag(n) OVER w - lead(n) OVER w) / nullif(least((SELECT n FROM n_rows) - n, n), 0) AS d FROM rel_filled WINDOW w AS (PARTITION BY label, seed ORDER BY c))
WHERE d IS NOT NULL AND c BETWEEN 1 AND size - 2)"""
    numbered = "SELECT row_id, dense_rank() OVER (ORDER BY first_row) - 1 AS label FROM (SELECT row_id, min(row_id) OVER (PARTITION BY path) AS first_row FROM ended)"
    for name, sharp in (("dropoff_subdivision", f"WHERE drop_off < {MAX_DROP}"), ("plain_subdivision", "")):
        q[name] = shown(numbered, "row_id label", ctes="RECURSIVE " + CLIQUES + f""",
placed AS MATERIALIZED (SELECT row_number() OVER (ORDER BY drop_off, size DESC, z DESC, seed) AS pos, seed FROM refined JOIN max_z ON g = seed {sharp}),
walk AS (SELECT CAST(0 AS BIGINT) AS pos, doc_id AS row_id, 'r' AS path FROM documents UNION ALL
SELECT pos, row_id, CASE WHEN inside > {MIN_GROUP} AND total - inside > {MIN_GROUP} THEN path || hit ELSE path END FROM (
SELECT o.pos, w.row_id, w.path, CAST(m.row_id IS NOT NULL AS INTEGER) AS hit, sum(CAST(m.row_id IS NOT NULL AS INTEGER)) OVER (PARTITION BY w.path) AS inside,
count(*) OVER (PARTITION BY w.path) AS total FROM walk w JOIN placed o ON o.pos = w.pos + 1 LEFT JOIN refined_rows m ON m.seed = o.seed AND m.row_id = w.row_id)),
ended AS (SELECT row_id, path FROM walk WHERE pos = (SELECT count(*) FROM placed))""")
    q["relative_subdivision"] = shown(numbered, "row_id label", ctes=relative + f""",
sharpest AS (SELECT x.label, x.seed, coalesce(d.c, 1) AS cutoff, coalesce(d.d, 1000000.0) AS drop_off FROM pairs_ls x
LEFT JOIN (SELECT * FROM rel_drops QUALIFY row_number() OVER (PARTITION BY label, seed ORDER BY d, c) = 1) d USING (label, seed)),
chosen AS (SELECT s.label, arg_min(s.seed, s.seed) AS seed, arg_min(s.cutoff, s.seed) AS cutoff FROM sharpest s JOIN rel_filled f ON f.label = s.label AND f.seed = s.seed AND f.c = s.cutoff
JOIN universe u ON u.label = s.label WHERE f.n > {MIN_GROUP} AND u.n - f.n > {MIN_GROUP} AND s.drop_off < {RELATIVE_DROP} GROUP BY s.label),
ended AS (SELECT l.row_id, concat_ws('/', l.label, CASE WHEN c.seed IS NULL THEN '-' WHEN coalesce(h.hits, 0) > c.cutoff THEN '1' ELSE '0' END) AS path
FROM lang l LEFT JOIN chosen c ON c.label = l.label LEFT JOIN hit_rows h ON h.seed = c.seed AND h.row_id = l.row_id)""")
    q["distant_partner_histogram"] = shown("SELECT least(coalesce(partners, 0), 49) AS partners, count(*) AS groups FROM max_z m LEFT JOIN (SELECT g, count(*) AS partners FROM both_ways WHERE z > " + str(LETTER_CUTOFF) + " AND abs(g - partner) > 100 GROUP BY g) p ON p.g = m.g GROUP BY 1", "partners groups", ctes=LETTER_TESTED)
    q["relative_significance"] = shown(f"SELECT ci, si, cj, sj, greatest({UPPER}, {LOWER}) AS z FROM (SELECT p.ci, p.si, p.cj, p.sj, p.k, a.size AS g1, b.size AS g2, (SELECT count(*) FROM documents WHERE lang = 'en') AS cov FROM zero_pairs p JOIN sizes a ON a.col = ci AND a.sym = si JOIN sizes b ON b.col = cj AND b.sym = sj)",
                                       "ci si cj sj", "z", ctes=f"cells AS MATERIALIZED (SELECT * FROM ({LETTER_CELLS}) WHERE row_id IN (SELECT doc_id FROM documents WHERE lang = 'en')), " + all_counts(1))
    q["clique_intersections"] = shown("SELECT seed, row_id FROM refined_rows JOIN inside USING (row_id)", "seed row_id", ctes=CLIQUES + """,
strongest AS MATERIALIZED (SELECT seed FROM refined ORDER BY drop_off, seed LIMIT 1),
inside AS MATERIALIZED (SELECT DISTINCT row_id FROM refined_rows JOIN strongest USING (seed))""")
    q["relative_dropoff"] = shown("""SELECT x.label, x.seed, x.size, coalesce(d.c, 1) AS cutoff, coalesce(d.d, 1000000.0) AS drop_off, f.n AS inside, u.n - f.n AS outside FROM pairs_ls x
LEFT JOIN (SELECT * FROM rel_drops QUALIFY row_number() OVER (PARTITION BY label, seed ORDER BY d, c) = 1) d USING (label, seed)
JOIN rel_filled f ON f.label = x.label AND f.seed = x.seed AND f.c = coalesce(d.c, 1) JOIN universe u ON u.label = x.label""",
                                  "label seed size cutoff inside outside", "drop_off", ctes=relative)
    q["two_column_moves"] = two_column_moves()

    # --- labels
    q["label_compression"] = shown("SELECT row_id, CASE WHEN label IS NOT NULL THEN new_label END AS label FROM raw LEFT JOIN (SELECT label, row_number() OVER (ORDER BY min(row_id)) - 1 AS new_label FROM raw WHERE label IS NOT NULL GROUP BY label) USING (label)",
                                   "row_id label", ctes="raw AS (SELECT o_orderkey AS row_id, CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS label FROM orders)")
    q["completed_labels"] = shown("SELECT * FROM l1", "row_id label", ctes=line_labels())
    q["cluster_sizes"] = shown("SELECT label, count(*) AS size FROM l1 WHERE label IS NOT NULL GROUP BY label", "label size", ctes=line_labels())
    split = """SELECT st.label, c.col * 5 + c.sym AS seed, count(*) AS inside, max(t.n) - count(*) AS outside FROM st JOIN cells c USING (row_id) JOIN (SELECT label, count(*) AS n FROM st GROUP BY label) t USING (label) GROUP BY ALL"""
    q["split_counts"] = shown(split, "label seed inside outside", ctes=line_labels())
    q["splittable_clusters"] = shown(f"SELECT * FROM ({split}) WHERE inside > {MIN_GROUP} AND outside > {MIN_GROUP}", "label seed inside outside", ctes=line_labels())
    q["block_accuracy"] = shown("""SELECT avg(m.n / t.n) AS accuracy FROM (SELECT b, arg_max(label, (n, -f)) AS label, max(n) AS n FROM (SELECT row_id // 30 AS b, label, count(*) AS n, min(row_id) AS f FROM st WHERE row_id < (SELECT count(*) FROM st) // 30 * 30 GROUP BY ALL) GROUP BY b) m JOIN (SELECT label, count(*) AS n FROM st GROUP BY label) t USING (label)""",
                                "", "accuracy", ctes=f"st AS ({STATUS})")
    q["knn_majority"] = shown("SELECT row_id, array_to_string(center, '') AS centroid FROM centers", "row_id", "", "centroid", ctes=NEAR)
    q["nearest_centroid"] = shown("""SELECT x.row_id, c.row_id AS cluster FROM points x JOIN centers c ON c.label = x.label AND c.row_id <> x.row_id QUALIFY row_number() OVER (PARTITION BY x.row_id
ORDER BY list_sum(list_transform(list_zip(x.bits, c.center), lambda p: CASE WHEN p[1] <> p[2] THEN 1 ELSE 0 END)), c.row_id) = 1""", "row_id cluster", ctes=NEAR)
    q["nearest_row"] = shown("SELECT row_id, other AS cluster FROM near WHERE row_id <> other QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY dist, other) = 1", "row_id cluster", ctes=NEAR)

    # --- linkage
    q["contingency"] = shown("SELECT l1.label AS i, l2.label AS j, count(*) AS n FROM l1 JOIN l2 USING (row_id) WHERE l1.label IS NOT NULL AND l2.label IS NOT NULL GROUP BY ALL", "i j n", ctes=line_labels())
    q["transition_matrix"] = shown("SELECT * FROM t12", "i j", "p", ctes=line_labels() + ", " + step("t12", "l1", "l2"))
    lines = [f"l{k}" for k in range(1, ORDER_LINES + 1)]
    steps = lambda t, names: [step(f"{t}{i}", x, y) for i, (x, y) in enumerate(zip(names, names[1:]))]
    products = lambda t, n: [product(f"{t}{t}1", f"{t}0", f"{t}1"), *(product(f"{t}{t}{i}", f"{t}{t}{i - 1}", f"{t}{i}") for i in range(2, n))]
    q["chain_product"] = shown(f"SELECT * FROM ff{ORDER_LINES - 2}", "i j", "p", ctes=", ".join([line_labels(), *steps("f", lines), *products("f", ORDER_LINES - 1)]))
    layers = ["st", *lines, "st"]
    q["connection"] = shown("SELECT * FROM linked", "i j", "p", ctes=", ".join([
        line_labels(), *steps("f", layers), *products("f", ORDER_LINES + 1), *steps("b", layers[::-1]), *products("b", ORDER_LINES + 1),
        linked(f"ff{ORDER_LINES}", f"bb{ORDER_LINES}")]))
    q["multi_step_resolution"] = shown("SELECT * FROM states", "i best state", "confidence", ctes=", ".join([
        f"la AS ({LANGUAGE})", f"so AS ({SOURCE})", step("f0", "la", "so"), step("f1", "so", "la"), product("ff", "f0", "f1"), linked("ff", "ff"), MUTUAL]))
    q["conditional_shares"] = shown("SELECT i, j, m.n / ci.n AS p_label, m.n / cj.n AS p_copy FROM (SELECT la.label AS i, so.label AS j, count(*) AS n FROM la JOIN so USING (row_id) WHERE so.label IS NOT NULL GROUP BY ALL) m JOIN (SELECT label AS i, count(*) AS n FROM la GROUP BY label) ci USING (i) JOIN (SELECT label AS j, count(*) AS n FROM so WHERE label IS NOT NULL GROUP BY label) cj USING (j)",
                                    "i j", "p_label p_copy", ctes=f"la AS ({LANGUAGE}), so AS ({SOURCE})")
    q["greedy_assignment"] = shown("SELECT i, j, p FROM g WHERE i IS NOT NULL", "i j", "p", ctes="RECURSIVE " + VECTORS + """,
shares AS MATERIALIZED (SELECT i, j, round(n / sum(n) OVER (PARTITION BY i), 12) AS p FROM met),
g AS (SELECT CAST(NULL AS BIGINT) AS i, CAST(NULL AS BIGINT) AS j, CAST(NULL AS DOUBLE) AS p, CAST([] AS BIGINT[]) AS used_i, CAST([] AS BIGINT[]) AS used_j UNION ALL
SELECT i, j, p, list_append(used_i, i), list_append(used_j, j) FROM (SELECT s.i, s.j, s.p, g.used_i, g.used_j FROM g JOIN shares s
ON NOT list_contains(g.used_i, s.i) AND NOT list_contains(g.used_j, s.j) ORDER BY s.p DESC, s.i, s.j LIMIT 1))""")
    q["resolution_quality"] = shown("SELECT * FROM states", "i best state", "confidence", ctes=VECTORS)
    q["resolution_summary"] = shown("SELECT count(*) FILTER (state = 1) AS true_positives, count(*) FILTER (state = -1) AS false_positives, count(*) FILTER (state = 0) AS unresolved FROM states",
                                    "true_positives false_positives unresolved", ctes=VECTORS)
    q["confidence_histogram"] = shown("SELECT threshold, count(*) FILTER (state = 1 AND confidence > threshold) AS resolved FROM states, (SELECT unnest(range(10)) / 10.0 AS threshold) GROUP BY threshold", "resolved", "threshold", ctes=VECTORS)
    q["ordered_groups"] = shown("SELECT label, row_number() OVER (ORDER BY label) - 1 AS idx, count(*) AS size FROM so WHERE label IS NOT NULL GROUP BY label", "label idx size", ctes=f"so AS ({SOURCE})")
    q["pairwise_consensus_diff"] = shown("SELECT copy, other, sum(diff) AS diff FROM differ GROUP BY copy, other", "copy other diff", ctes=CONSENSUS)
    q["resolvability"] = shown("SELECT threshold, count(*) FILTER (d > threshold) AS unique_copies, count(*) AS copies FROM (SELECT copy, min(diff) AS d FROM (SELECT copy, other, sum(diff) AS diff FROM differ GROUP BY ALL) GROUP BY copy), (SELECT unnest(range(11)) AS threshold) GROUP BY threshold",
                               "threshold unique_copies copies", ctes=CONSENSUS)
    q["half_resolvability"] = shown("""SELECT count(*) FILTER (a > 5 AND b > 5) AS both_halves, count(*) FILTER (a > 5 AND b <= 5) AS first_only, count(*) FILTER (a <= 5 AND b > 5) AS second_only, count(*) FILTER (a <= 5 AND b <= 5) AS neither
FROM (SELECT copy, min(diff) FILTER (NOT half) AS a, min(diff) FILTER (half) AS b FROM differ GROUP BY copy)""", "both_halves first_only second_only neither", ctes=CONSENSUS)
    q["signatures"] = shown("SELECT row_id, string_agg(substr('acgt-', CAST(sym + 1 AS INTEGER), 1), '' ORDER BY col) AS symbols FROM cells WHERE col IN (SELECT g // 5 FROM max_z GROUP BY g // 5 HAVING max(z) > 50.0) GROUP BY row_id", "row_id", "", "symbols", ctes=LETTER_TESTED)

    # --- sequences
    docs = f"reads AS (SELECT doc_id AS read_id, {CLEAN} AS seq FROM documents)"
    q["clean_sequences"] = shown("SELECT * FROM reads", "read_id", "", "seq", ctes=docs)
    q["reverse_complement"] = shown("SELECT read_id, reverse(translate(seq, 'acgt', 'tgca')) AS rc FROM reads", "read_id", "", "rc", ctes=docs)
    q["line_wrap"] = shown("SELECT read_id, coalesce(array_to_string(list_transform(range(0, length(seq), 100), lambda i: substr(seq, i + 1, 100)), chr(10)), '') AS wrapped FROM reads", "read_id", "", "wrapped", ctes=docs)
    template = f"t AS (SELECT string_agg({CLEAN}, '' ORDER BY item_id) AS template FROM benchmark)"
    q["template_concat"] = shown("SELECT * FROM t", "", "", "template", ctes=template)
    q["template_parts"] = shown("SELECT part, substr(template, part * (length(template) // 60) + 1, length(template) // 60 + 5) AS seq FROM t, (SELECT unnest(range(60)) AS part)", "part", "", "seq", ctes=template)
    q["read_split"] = shown("SELECT read_id, piece, substr(seq, piece * 500 + 1, 500) AS seq FROM (SELECT *, unnest(range(greatest(1, (length(seq) + 499) // 500))) AS piece FROM reads)", "read_id piece", "", "seq", ctes=docs)
    cut = ("cut AS (SELECT row_number() OVER (ORDER BY read_id, piece) - 1 AS seq_id, substr(seq, piece * 500 + 1, 500) AS seq FROM "
           "(SELECT *, unnest(range(greatest(1, (coalesce(length(seq), 0) + 499) // 500))) AS piece FROM reads)), "
           "held AS (SELECT c.seq_id, list(r.read_id) AS hits FROM cut c JOIN reads r ON c.seq <> '' AND contains(r.seq, substr(c.seq, 1, 100)) GROUP BY c.seq_id), "
           "known AS MATERIALIZED (SELECT c.seq_id, coalesce(c.seq, '') = '' AS free, coalesce(h.hits, []) AS hits FROM cut c LEFT JOIN held h USING (seq_id))")
    q["piece_read_merge"] = shown("SELECT * FROM walk WHERE seq_id >= 0", "seq_id read_id", ctes=f"RECURSIVE {docs}, {cut}, "
                                  "walk AS (SELECT CAST(-1 AS BIGINT) AS seq_id, (SELECT min(read_id) FROM reads) AS read_id UNION ALL "
                                  "SELECT k.seq_id, CASE WHEN free THEN w.read_id ELSE list_min(list_filter(hits, lambda x: x >= w.read_id)) END FROM walk w JOIN known k ON k.seq_id = w.seq_id + 1)")
    q["read_piece_lists"] = shown("SELECT read_id, string_agg(CAST(seq_id AS VARCHAR), ' ' ORDER BY seq_id) AS seq_ids FROM turns GROUP BY read_id", "read_id", "", "seq_ids", ctes=TURNS)
    q["prefix_containment"] = shown("SELECT conv_id, turn, contains(coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), ''), substr(text, 1, 100)) AS contained FROM conversations", "conv_id turn", "", "contained")
    flank = "SELECT r.seq_id, r.read_id, EXISTS (SELECT 1 FROM turns l WHERE l.cls = 'l' AND l.read_id = r.read_id AND l.seq_id = r.seq_id - 1) AS has_left, EXISTS (SELECT 1 FROM turns l WHERE l.cls = 'l' AND l.read_id = r.read_id AND l.seq_id = r.seq_id + 1) AS has_right FROM turns r WHERE r.cls = 'r'"
    q["flanks"] = shown(flank, "seq_id read_id", "", "has_left has_right", ctes=TURNS)
    q["flank_labels"] = shown(f"SELECT seq_id, CASE WHEN has_left THEN read_id % 7 END AS left_copy, CASE WHEN has_right THEN read_id % 7 END AS right_copy FROM ({flank})", "seq_id left_copy right_copy", ctes=TURNS)
    q["flank_sums"] = shown(f"SELECT sum(CASE WHEN has_left THEN read_id % 7 ELSE -1 END) AS left_copy, sum(CASE WHEN has_right THEN read_id % 7 ELSE -1 END) AS right_copy, count(*) AS pieces FROM ({flank})", "left_copy right_copy pieces", ctes=TURNS)
    number = "row_number() OVER (ORDER BY {}) - 1"
    q["fasta_round_trip"] = shown(f"SELECT {number.format('read_id')} AS read_id, seq FROM reads", "read_id", "", "seq", ctes=docs)
    q["fasta_record_count"] = shown("SELECT count(*) AS records FROM benchmark", "records")
    q["matrix_round_trip"] = shown("SELECT dense_rank() OVER (ORDER BY row_id) - 1 AS row_id, col, sym FROM cells", "row_id col sym", ctes=f"cells AS ({ORDER_CELLS})")
    q["labels_round_trip"] = shown(f"SELECT {number.format('row_id')} AS row_id, label FROM so", "row_id label", ctes=f"so AS ({SOURCE})")
    q["correlations_round_trip"] = shown("SELECT * FROM max_z", "g", "z", ctes=LETTER_TESTED)
    q["piece_map_round_trip"] = shown("SELECT seq_id, dense_rank() OVER (ORDER BY read_id) - 1 AS read_id FROM turns", "seq_id read_id", ctes=TURNS)
    q["classes_round_trip"] = shown("SELECT seq_id, cls FROM turns", "seq_id", "", "cls", ctes=TURNS)
    q["copies_round_trip"] = shown(f"SELECT {number.format('row_id')} AS read_id, label AS copy FROM co", "read_id copy", ctes=f"co AS ({SOURCE_COPY})")
    q["row_copies"] = shown("SELECT DISTINCT l_orderkey AS row_id, c_nationkey AS label FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey", "row_id label")
    q["repeat_rows"] = shown("SELECT seq_id, row_number() OVER (ORDER BY seq_id) - 1 AS row_id FROM turns WHERE cls = 'r'", "seq_id row_id", ctes=TURNS)
    q["point_edits"] = shown("""SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN substr(p_name, 1, pos) || 'x' || substr(p_name, pos + 2) WHEN 1 THEN substr(p_name, 1, pos) || substr(p_name, pos + 2) ELSE substr(p_name, 1, pos) || 'x' || substr(p_name, pos + 1) END AS edited
FROM (SELECT *, p_partkey % length(p_name) AS pos FROM part)""", "p_partkey", "", "edited")
    q["string_difference"] = shown("SELECT p_partkey, len(list_filter(range(1, w + 1), lambda i: substr(a, i, 1) <> substr(b, i, 1) AND substr(a, i, 1) <> ' ' AND substr(b, i, 1) <> ' ')) AS diff FROM (SELECT p_partkey, w, rpad(p_name, w, ' ') AS a, rpad(lower(p_type), w, ' ') AS b FROM (SELECT *, CAST(greatest(length(p_name), length(p_type)) AS INTEGER) AS w FROM part))", "p_partkey diff")
    q["edit_distance"] = shown("SELECT p_partkey, levenshtein(p_name, lower(p_type)) AS distance FROM part", "p_partkey distance")
    q["order_matrix"] = shown("SELECT part, next_part, count(*) AS n FROM adjacent WHERE distance < 20000 GROUP BY ALL", "part next_part n", ctes=HITS)
    q["distance_histogram"] = shown("SELECT * FROM histogram", "part next_part bucket n", ctes=HITS)
    q["relevant_distances"] = shown("SELECT * FROM (SELECT *, sum(n) OVER (PARTITION BY part, next_part) AS total FROM histogram) WHERE total > 400", "part next_part bucket n total", ctes=HITS)
    return q


def two_column_moves() -> str:
    """Score of all 16 assignments per neighbouring column pair, the smallest (then lowest) kept."""
    bases = "acgt"
    free = [f"((l = {i} AND r = 4) OR (l = 4 AND r = {i}))" for i in range(4)]
    any_free = "(" + " OR ".join(free) + ")"
    cols = [f"count(*) FILTER ({f}) AS f{i}" for i, f in enumerate(free)]
    for side in "lr":
        cols += [f"count(*) FILTER (NOT {any_free} AND {side} <> {i} AND {side} < 5) AS {side}{i}" for i in range(5)]
    options = []
    for choice in range(16):
        left = [choice >> (3 - i) & 1 for i in range(4)]
        terms = [f"({'l' if left[i] else 'r'}{i} + {'r' if left[i] else 'l'}4) * f{i}" for i in range(4)]
        terms += [f"f{i} * f{j} * {2 if left[i] != left[j] else 1}" for i in range(4) for j in range(i + 1, 4)]
        options.append(f"SELECT col, {choice} AS choice, {' + '.join(terms)} AS score FROM counted")
    ctes = f"""cells AS ({EVENT_CELLS}), grid AS (SELECT row_id, col, coalesce(sym, 5) AS s FROM (SELECT DISTINCT row_id FROM cells) r
JOIN (SELECT unnest(range(31)) AS col) ON true LEFT JOIN cells USING (row_id, col)),
two AS (SELECT x.col, x.s AS l, y.s AS r FROM grid x JOIN grid y ON x.row_id = y.row_id AND y.col = x.col + 1),
counted AS (SELECT col, {', '.join(cols)} FROM two GROUP BY col), options AS ({' UNION ALL '.join(options)})"""
    body = ("SELECT col, min(score) AS score, " + ", ".join(
        f"(arg_min(choice, (score, choice)) >> {3 - i}) & 1 AS left_{b}" for i, b in enumerate(bases)) + " FROM options GROUP BY col")
    return shown(body, "col score left_a left_c left_g left_t", ctes=ctes)
