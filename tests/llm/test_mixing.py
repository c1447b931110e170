from pyspark.sql import functions as F

from skein.llm import mixing


def test_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.mix(odd_docs).collect()
    assert len(rows) == odd_docs.count()
    assert all(r["taken"] == 0 and r["position"] is None for r in rows if r["size"] == 0)
    assert {r["size"] for r in rows if r["doc_id"] == 2} == {0}
    assert mixing.mix(no_docs).count() == 0


def test_targets_pour_over(spark):
    docs = spark.createDataFrame([(i, "w " * 10, s) for i, s in enumerate("a" * 2 + "b" * 30 + "c" * 68)], "doc_id bigint, text string, source string")
    rows = mixing.mix(docs).collect()
    target = {r["source"]: r["target"] for r in rows}
    assert target["a"] == 40.0  # two times its words
    assert target["b"] == 600.0  # full as well
    assert abs(target["c"] - (1500 - 640)) < 1e-9
    for s in "abc":
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - target[s]) < 1
        assert all(r["taken"] <= 2 * r["size"] for r in own)


def test_positions_invert_the_integrated_schedule(spark):
    docs = spark.createDataFrame([(i, "w " * 5, "s") for i in range(400)], "doc_id bigint, text string, source string")
    knots = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in ((0.0, 0.0), (0.5, 2.0), (1.0, 1.0))])
    rows = mixing.mix(docs, share=1.0, schedule=lambda rank: knots).collect()
    times = [r["position"] for r in rows]
    assert times == sorted(times) and 0 <= times[0] and times[-1] <= 1
    total = 0.5 + 0.75
    for t in (0.25, 0.5, 0.8):
        share = (2 * t * t if t <= 0.5 else 0.5 + 2 * (t - 0.5) - (t - 0.5) ** 2) / total
        assert abs(sum(x < t for x in times) / 400 - share) < 0.01


def test_runs_agree_on_any_partitioning(spark, odd_docs):
    one, two = (sorted(map(str, mixing.mix(odd_docs.repartition(n)).collect())) for n in (1, 6))
    assert one == two


def test_every_pass_has_its_position(spark):
    """The words of all passes before a time are the demand of the schedule up to it."""
    docs = spark.createDataFrame([(i, "w " * 5, s) for i, s in enumerate("a" * 200 + "b" * 200)], "doc_id bigint, text string, source string")
    knots = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(w).alias("w")) for t, w in ((0.0, 0.0), (0.5, 2.0), (1.0, 1.0))])
    rows = mixing.mix(docs, schedule=lambda rank: knots).collect()
    assert all(sum(p.words for p in r.passes) == r.taken and len(r.passes) == 1 + r.repeats for r in rows if r.taken)
    assert all(r.passes[0].position == r.position for r in rows if r.taken)
    given = [(p.position, p.words) for r in rows if r.source == "a" for p in r.passes]
    assert sum(r.repeats for r in rows) == 200
    for t in (0.25, 0.5, 0.8):
        share = (2 * t * t if t <= 0.5 else 0.5 + 2 * (t - 0.5) - (t - 0.5) ** 2) / 1.25
        assert abs(sum(w for x, w in given if x < t) / 1500 - share) < 0.01
