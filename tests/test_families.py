"""Batch kernels against those of one sequence, families against each other."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frames import collected
from skein.operators import align, families


def random_text(rng, low, high):
    return "".join(rng.choice(list("acgt"), int(rng.integers(low, high))))


def test_batches_align_like_single_sequences():
    rng = np.random.default_rng(2)
    for _ in range(40):
        template = random_text(rng, 0 if rng.random() < 0.1 else 1, 50)
        seqs = [random_text(rng, 0, 45) for _ in range(int(rng.integers(1, 12)))]
        for (position, best), s in zip(families.align_batch(seqs, template), seqs):
            expected, distance = align.align_one(s, template)
            assert best == distance and list(position) == list(expected)


def test_batches_scan_like_single_reads():
    rng = np.random.default_rng(3)
    part = random_text(rng, 8, 9)
    reads = [random_text(rng, 0, 60) for _ in range(20)]
    for score, read in zip(families.last_scores_batch(part, reads), reads):
        assert list(score) == list(align.last_scores(part, read))


@pytest.mark.parametrize("rows_per_task", [2000, 3])
def test_families_keep_apart(spark, rows_per_task):
    rng = np.random.default_rng(4)
    templates = [(f, random_text(rng, 30, 60)) for f in range(4)]
    seqs = [(int(rng.integers(0, 5)), i, random_text(rng, 0, 40) if i % 3 else templates[i % 4][1][5:30]) for i in range(80)] + [(1, 99, None)]
    t = spark.createDataFrame(templates, "family bigint, template string")
    aligned = families.align_to_templates(spark.createDataFrame(seqs, "family bigint, seq_id bigint, seq string"), t, 0.5, rows_per_task)
    known = dict(templates)
    rows = aligned.collect()
    assert len(rows) == len(seqs)
    for r in rows:
        position, best = align.align_one(r.seq, known.get(r.family, ""))
        assert (r.tpos, r.error) == (list(position), best / len(r.seq) if r.seq else 1.0) and r.cls == ("r" if r.error < 0.5 else "l")
    whole = families.build_matrices(aligned, families.slot_layout(families.gap_slots(aligned), t), rows_per_task)
    for f, template in templates:
        own = aligned.where(f"family = {f}").select("seq_id", "seq", "tpos", "error", "cls")
        if own.where("cls = 'r'").count():
            single, _ = align.build_matrix(own, len(template))
            assert collected(whole.where(f"family = {f}"), "seq_id", "symbols") == collected(single, "seq_id", "symbols")
    reads = spark.createDataFrame([(f, i, (s or "") * 3) for f, i, s in seqs], "family bigint, read_id bigint, seq string")
    hits = families.map_parts(reads, t, 4, 1, 0.4, rows_per_task)
    cuts = families.cut_reads(reads, t, 4, 1, 0.4, rows_per_task)
    for f, template in templates:
        own = reads.where(f"family = {f}").select("read_id", "seq")
        assert collected(hits.where(f"family = {f}"), "read_id", "part", "pos") == collected(align.map_parts(own, template, 4, 1, 0.4))
        assert collected(cuts.where(f"family = {f}"), "read_id", "seq", "cuts") == collected(align.cut_reads(own, template, 4, 1, 0.4))


FIXTURES = [["acgt-acg ", "acg-tacg ", " cgttacga", "acgt-a-g ", "acg-tac  "],
            ["ac--gt", "a-c-gt", "acg--t", "      ", "a---gt"],
            ["acgtacgtac", "--acgtacgt", "acgt---acg", " cgtacgt  "]]


def test_matrices_realign_alike_in_a_task_and_by_spark(spark):
    rows = [(f, 10 * k, line) for f, lines in enumerate(FIXTURES) for k, line in enumerate(lines)]
    df = spark.createDataFrame(rows, "family bigint, seq_id bigint, symbols string").repartition(3)
    one = collected(families.realign(df))
    assert one == collected(families.realign(df, most_cells=0)) and len(one) == len(rows)
    assert [s.replace("-", "").replace(" ", "") for _, _, s in one] == [s.replace("-", "").replace(" ", "") for _, _, s in sorted(rows)]


def test_empty_tables(spark):
    seqs = spark.createDataFrame([], "family bigint, seq_id bigint, seq string")
    t = spark.createDataFrame([], "family bigint, template string")
    aligned = families.align_to_templates(seqs, t)
    assert aligned.count() == 0 and families.build_matrices(aligned, families.slot_layout(families.gap_slots(aligned), t)).count() == 0
    assert families.realign(spark.createDataFrame([], "family bigint, seq_id bigint, symbols string")).count() == 0


def test_small_tables_are_worked_on_by_many_tasks(spark):
    """Few bytes can be much work: tasks are not joined because their input is small."""
    aim = spark.sparkContext.defaultParallelism
    rows = [(f, 10 * f + k, "acgtacgg"[k:] * 3) for f in range(64) for k in range(3)]
    seqs = spark.createDataFrame(rows, "family bigint, seq_id bigint, seq string")
    heads = spark.createDataFrame([(f, "acgtacgg") for f in range(64)], "family bigint, template string")
    tasks = lambda df: df.select(F.spark_partition_id()).distinct().count()
    assert tasks(families.align_to_templates(seqs, heads)) >= aim
    lines = spark.createDataFrame([(f, 10 * f + k, "acg-t"[k:] + "acg-t"[:k]) for f in range(64) for k in range(3)], "family bigint, seq_id bigint, symbols string")
    assert tasks(families.realign(lines, max_rounds=1)) >= aim
