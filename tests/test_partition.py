import numpy as np
import pytest
from frames import collected
from pyspark.sql import functions as F

from skein.operators import cliques, explore, linkage, neighbours, partition
from skein.functions.ordinal import running_sum, with_ordinal


def labels(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "row_id BIGINT, label BIGINT")


def test_label_compression(spark):
    assert collected(partition.compress_labels(labels(spark, [5, None, 2, 5, 9]))) == [(0, 0), (1, None), (2, 1), (3, 0), (4, 2)]


def test_ordinals_and_running_sums(spark):
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("k"))
    assert all(k == n for k, n in collected(with_ordinal(df, F.col("k"), name="n"), "k", "n"))
    summed = running_sum(df, "k", "k", "s", block=64)
    assert all(s == k * (k + 1) // 2 for k, s in collected(summed, "k", "s"))


def slow_subdivision(bits, min_group):
    label, fresh = [0] * len(bits), 1
    for pos in range(len(bits[0])):
        for k in sorted(set(label)):
            mine = [i for i, v in enumerate(label) if v == k]
            inside = [i for i in mine if bits[i][pos] == "1"]
            if len(inside) > min_group and len(mine) - len(inside) > min_group:
                for i in mine:
                    label[i] = fresh if i in inside else fresh + 1
                fresh += 2
    names = {v: n for n, v in enumerate(dict.fromkeys(label))}
    return [names[v] for v in label]


def test_subdivision_matches_one_group_at_a_time(spark):
    rng = np.random.default_rng(4)
    bits = ["".join(rng.choice(["0", "1"], 7, p=[.6, .4])) for _ in range(80)]
    df = spark.createDataFrame(list(enumerate(bits)), "row_id BIGINT, bits STRING")
    found = partition.compress_labels(partition.subdivide_by_bits(df, 6))
    assert [v for _, v in collected(found, "row_id", "label")] == slow_subdivision(bits, 6)


@pytest.mark.parametrize("at_once", [0, 150, 10 ** 6])
def test_clusters_split_in_tasks_or_by_rounds(spark, at_once):
    rng = np.random.default_rng(5)
    bits = ["".join(rng.choice(["0", "1"], 9, p=[.6, .4])) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(bits)), "row_id BIGINT, bits STRING")
    found = partition.compress_labels(partition.subdivide_by_bits(df, 6, at_once))
    assert [v for _, v in collected(found, "row_id", "label")] == slow_subdivision(bits, 6)
    empty = spark.createDataFrame([(1, ""), (2, "")], "row_id BIGINT, bits STRING")
    assert {r.label for r in partition.subdivide_by_bits(empty, 6, at_once).collect()} == {"r"}


def test_a_long_chain_of_splits_takes_few_jobs(spark):
    """Every group peels a few rows off: as many rounds as groups, if each split is a round."""
    bits = ["0" * k + "1" + "0" * (39 - k) for k in range(40) for _ in range(8)]
    df = spark.createDataFrame(list(enumerate(bits)), "row_id BIGINT, bits STRING")
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        found = partition.compress_labels(partition.subdivide_by_bits(df, 6)).collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len({r.label for r in found}) == 40 and len(jobs) < 40


def test_dropoff_takes_lowest_cutoff(spark):
    above = spark.createDataFrame([(1, 6, [90, 50, 50, 50, 20, 0])], "seed BIGINT, size BIGINT, above ARRAY<BIGINT>")
    r = cliques.dropoff(above, 100).first()
    assert (r["cutoff"], r["drop_off"]) == (2, 0.0)
    full = spark.createDataFrame([(1, 6, [100, 100, 100, 100, 100, 100])], "seed BIGINT, size BIGINT, above ARRAY<BIGINT>")
    assert cliques.dropoff(full, 100).first()["drop_off"] == cliques.NO_DROP


def planted(n_per, seed=1):
    """Two copies differing in eight columns that are at least 20 apart, with noise."""
    rng = np.random.default_rng(seed)
    lines = []
    for copy in (0, 1):
        for _ in range(n_per):
            line = np.array(list("acgt" * 50))
            line[::25] = "a" if copy == 0 else "g"
            hit = rng.random(200) < 0.05
            line[hit] = rng.choice(list("acgt-"), hit.sum())
            lines.append("".join(line))
    return lines


def test_planted_copies_are_separated(rows_of):
    from skein.plans.resolve import Config, resolve_window, correlate_matrix
    rows = rows_of(planted(40))
    cfg = Config(min_cov=20)
    max_z = correlate_matrix(rows, cfg)
    out = resolve_window(rows, max_z, 0, 199, cfg)
    for name in ("Dropoff", "RelDrop", "Kmeans"):
        found = dict(collected(out[name], "row_id", "label"))
        first, second = {found[i] for i in range(40)}, {found[i] for i in range(40, 80)}
        assert not first & second, name


def slow_relative(lines, label, groups, n_rows, min_group, max_drop):
    side = ["-"] * len(lines)
    for k in {v for v in label if v is not None and label.count(v) > 2 * min_group}:
        mine = [i for i, v in enumerate(label) if v == k]
        for seed, members in sorted(groups.items()):
            hits = {i: sum(lines[i][g // 5] == "acgt-"[g % 5] for g in members) for i in mine}
            above = [sum(h > c for h in hits.values()) for c in range(len(members))]
            drops = [((above[c - 1] - above[c + 1]) / least, c) for c in range(1, len(members) - 1) if (least := min(n_rows - above[c], above[c]))]
            drop, cutoff = min(drops, default=(cliques.NO_DROP, 1))
            if drop < max_drop and above[cutoff] > min_group and len(mine) - above[cutoff] > min_group:
                for i in mine:
                    side[i] = "1" if hits[i] > cutoff else "0"
                break
    names: dict = {}
    return [None if v is None else names.setdefault((v, s), len(names)) for v, s in zip(label, side)]


def test_relative_subdivision_is_done_once_and_leaves_rows_where_they_are(spark, rows_of):
    """A label is no key of a shuffle of rows: a large cluster would be one task."""
    rng = np.random.default_rng(3)
    lines = ["".join(rng.choice(list("acgt-"), 12, p=p)) for p in [(.8, .05, .05, .05, .05), (.05, .05, .8, .05, .05)] * 70]
    label = [None if i % 9 == 8 else 0 if i % 9 < 6 else 1 if i % 9 < 7 else 2 if i < 70 else 3 for i in range(140)]
    found = {g: [g, *(x for x in range(g % 5, 60, 5) if x != g)][:size] for g, size in ((0, 9), (2, 8), (12, 7), (21, 5))}
    table = spark.createDataFrame([(s, g, None, k) for s, m in found.items() for k, g in enumerate(m)], "seed BIGINT, g BIGINT, z DOUBLE, rank INT")
    large = {s: m for s, m in found.items() if len(m) >= cliques.MIN_CLIQUE}
    expected = slow_relative(lines, label, large, 140, 6, .5)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = partition.relative_subdivision(rows_of(lines), 12, table, labels(spark, label), 140, 6, .5)
        assert [v for _, v in collected(out, "row_id", "label")] == expected and len(set(expected)) > 5
        plan = out._jdf.queryExecution().toString()
        assert "MapInPandas" not in plan and "hashpartitioning(label" not in plan, plan
        assert [v for _, v in collected(partition.relative_subdivision(rows_of(lines[:100]), 12, table, labels(spark, label), 100, 6, .5))][100:] == [None] * 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def slow_majority(bits, min_group):
    n = len(bits)
    dist = lambda a, b: sum(x != y for x, y in zip(a, b))
    near = [sorted(range(n), key=lambda j: (dist(bits[i], bits[j]), j))[:5] for i in range(n)]
    center = ["".join("1" if sum(bits[j][p] == "1" for j in near[i]) > 2 else "0" for p in range(len(bits[0]))) for i in range(n)]
    place = [min((j for j in range(n) if j != i), key=lambda j: (dist(bits[i], center[j]), j)) for i in range(n)]
    for minimum in range(2, min_group):
        size = [place.count(j) for j in range(n)]
        new = list(place)
        for i in range(n):
            if size[place[i]] <= minimum:
                options = [j for j in range(n) if size[j] >= minimum and j not in (i, place[i])]
                new[i] = min(options, key=lambda j: (dist(bits[i], center[j]), j)) if options else 0
        place = new
    return place


def test_majority_clusters(spark):
    rng = np.random.default_rng(8)
    base = ["".join(rng.choice(["0", "1"], 12)) for _ in range(3)]
    bits = ["".join(c if rng.random() > .15 else "10"[int(c)] for c in base[i % 3]) for i in range(36)]
    points = spark.createDataFrame([(1, i, b) for i, b in enumerate(bits)], "label BIGINT, row_id BIGINT, bits STRING")
    found = neighbours.majority_clusters(points, 5)
    assert [c for _, c in collected(found, "row_id", "cluster")] == slow_majority(bits, 5)


def test_nearest_is_exact_over_many_blocks(spark):
    rng = np.random.default_rng(9)
    bits = sorted({"".join(rng.choice(["0", "1"], 10)) for _ in range(150)})
    points = spark.createDataFrame([(1, i, b) for i, b in enumerate(bits)], "label BIGINT, row_id BIGINT, bits STRING")
    cand = neighbours.lowest_ids(points, ["label", "bits"], 3)
    found = neighbours.nearest(points.select("label", "bits"), cand, 3, block=16)
    got = {}
    for r in found.collect():
        got.setdefault(r["bits"], {})[r["rank"]] = r["id"]
    for b in bits:
        order = sorted(range(len(bits)), key=lambda j: (sum(x != y for x, y in zip(b, bits[j])), j))[:3]
        assert [got[b][k] for k in (1, 2, 3)] == order


def test_split_and_merged_copies(spark):
    truth = labels(spark, [0] * 4 + [1] * 4 + [2] * 4 + [3] * 4)
    found = labels(spark, [0, 0, 1, 1] + [2] * 4 + [3] * 8)
    states = {r["i"]: (r["state"], r["best"]) for r in linkage.mutual_best(linkage.copy_connection(truth, found)).collect()}
    assert states[0] == (1, 0) and states[1] == (1, 1)
    assert states[2] == (1, 2) and states[3] == (-1, 2)


def test_transitions_are_stochastic(spark):
    a, b = labels(spark, [0, 0, 1, 1, None]), labels(spark, [1, 1, 0, None, 1])
    rows = linkage.transition(linkage.contingency(a, b)).groupBy("i").agg(F.sum("p").alias("p"))
    assert collected(rows) == [(0, 1.0), (1, 1.0)]


def test_conflicts_and_elimination(spark):
    sets = {1: range(0, 20), 2: range(5, 25), 3: range(15, 40), 4: range(60, 70)}
    members = spark.createDataFrame([(s, r) for s, v in sets.items() for r in v], "seed BIGINT, row_id BIGINT")
    found = explore.conflicts(members, 8)
    expected = sorted((a, b, len(set(sets[a]) & set(sets[b]))) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) < 8)
    assert collected(found) == expected
    left = collected(explore.compatible_groups(members, found), "seed", "conflicts")
    assert len({c for _, c in left}) == 1


def test_products_of_nearest_rows_are_many_tasks(spark):
    """Blocks of few bytes are not joined to a few tasks; each side is dealt once."""
    rng = np.random.default_rng(6)
    points = spark.createDataFrame([(i % 40, i, "".join(rng.choice(["0", "1"], 12))) for i in range(400)], "label BIGINT, row_id BIGINT, bits STRING")
    found = neighbours.nearest(points.select("label", "bits").distinct(), neighbours.lowest_ids(points, ["label", "bits"], 2), 2)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    own = [line for line in plan.split("== Initial Plan ==")[0].splitlines() if "Exchange" in line and "qb" in line]
    assert len(own) == 2 and all("REPARTITION_BY_NUM" in line for line in own), own
