import glob
import os
import random

from frames import collected
from pyspark.sql import functions as F

from skein.functions import sequence
from skein.operators import align
from skein.sources import catalog, text


def test_fasta_keeps_every_record(spark, tmp_path):
    path = str(tmp_path / "r.fasta")
    with open(path, "w") as f:
        f.write(">\nACgt\nnnac\n>x\ntt\n>\ng\n")
    assert collected(text.read_fasta(spark, path)) == [(0, "acgtac"), (1, "tt"), (2, "g")]


def test_line_numbers_over_many_splits(spark, tmp_path):
    path = str(tmp_path / "n.txt")
    with open(path, "w") as f:
        f.write("\n".join(f"{i:07d}" for i in range(20_000)) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = text.numbered_lines(spark, path)
        assert rows.rdd.getNumPartitions() > 4
        assert rows.where(F.col("line_no") != F.col("value").cast("bigint")).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def lines_of(path):
    return [line for p in sorted(glob.glob(os.path.join(path, "part-*"))) for line in open(p).read().splitlines()]


def test_matrix_and_label_files(spark, tmp_path, rows_of):
    rows = rows_of(["ac-t", " cgt"])
    text.write_matrix(rows, str(tmp_path / "msa"))
    assert lines_of(tmp_path / "msa") == ["AC-T", " CGT"]
    assert collected(text.read_matrix(spark, str(tmp_path / "msa"))) == collected(rows)
    labelled = spark.createDataFrame([(0, 3), (1, None), (2, 1)], "row_id BIGINT, label BIGINT")
    text.write_labels(labelled, str(tmp_path / "labels"))
    assert lines_of(tmp_path / "labels") == ["3", "-1", "1"]
    assert collected(text.read_labels(spark, str(tmp_path / "labels"))) == [(0, 3), (1, None), (2, 1)]


def test_correlations_have_six_decimals(spark, tmp_path):
    z = spark.createDataFrame([(0, 0.0), (1, 12.3456789)], "g BIGINT, z DOUBLE")
    text.write_correlations(z, str(tmp_path / "z"))
    assert lines_of(tmp_path / "z") == ["0.000000", "12.345679"]
    assert collected(text.read_correlations(spark, str(tmp_path / "z"))) == [(0, 0.0), (1, 12.345679)]


def test_file_names():
    data = catalog.DataSet("/d/Tree_1perc_30000kbTemplate.fasta")
    assert data.matrix == "/d/Tree_1perc_30000kbMSA"
    name = data.clustering("Kmeans", 0, 4999)
    assert catalog.parse_clustering(name)[:3] == ("Kmeans", 0, 4999)
    assert catalog.clusterings_in_order([data.clustering("Kmeans", 9, 10), name], "Kmeans")[0] == name
    assert catalog.data_set_name("Tree", 1.0, 30000) == "Tree_1perc_30000kb"


def test_pieces_join_to_the_read(spark):
    reads = spark.createDataFrame([(0, "aaccggtt", [3, 5]), (1, "acgt", [])], "read_id BIGINT, seq STRING, cuts ARRAY<INT>")
    pieces = sequence.number_pieces(sequence.split_at_cuts(reads))
    assert collected(pieces, "seq_id", "read_id", "seq") == [(0, 0, "aac"), (1, 0, "cg"), (2, 0, "gtt"), (3, 1, "acgt")]
    assert collected(sequence.read_piece_lists(pieces)) == [(0, [0, 1, 2]), (1, [3])]


def test_reads_to_matrix(spark):
    rng = random.Random(7)
    bases = lambda n: "".join(rng.choice("acgt") for _ in range(n))
    t, lines = bases(400), []
    for _ in range(24):  # noisy stretches of the template between other sequences
        noisy = "".join(rng.choice(["", c, c + rng.choice("acgt")]) if rng.random() < 0.12 else c for c in t)
        lines.append(bases(rng.randrange(150, 300)) + noisy + bases(rng.randrange(150, 300)))
    reads = spark.createDataFrame(list(enumerate(lines)), "read_id BIGINT, seq STRING")
    pieces = sequence.number_pieces(sequence.split_at_cuts(align.cut_reads(reads, t, parts=5)))
    aligned = align.align_to_template(pieces, t).cache()
    rows, width = align.build_matrix(aligned, len(t))
    bases = {r["seq_id"]: r["seq"] for r in aligned.where("cls = 'r'").collect()}
    got = {r["seq_id"]: r["symbols"] for r in rows.collect()}
    assert got and all(len(s) == width for s in got.values())
    assert {k: s.replace("-", "") for k, s in got.items()} == bases


def test_fasta_records_over_files(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "part-0").write_text(">\naa\n>\ncc\n")
    (folder / "part-1").write_text(">\ngg\n")
    (folder / "part-2").write_text("no record\n>x\ntt\n>\n\n")
    assert collected(text.read_fasta(spark, str(folder))) == [(0, "aa"), (1, "cc"), (2, "gg"), (3, "tt"), (4, "")]


def test_blank_lines_use_no_group_id(spark, tmp_path):
    path = tmp_path / "z"
    path.write_text("1.0\n\n2.0\n  \n3.0\n")
    assert collected(text.read_correlations(spark, str(path))) == [(0, 1.0), (1, 2.0), (2, 3.0)]


def test_fasta_round_trip_over_many_files(spark, tmp_path):
    reads = spark.createDataFrame([(i, "acgt" * (i % 90)) for i in range(300)], "read_id BIGINT, seq STRING")
    text.write_fasta(reads.repartitionByRange(7, "read_id"), "read_id", "seq", str(tmp_path / "f"), wrap_at=100)
    assert len(glob.glob(str(tmp_path / "f" / "part-*"))) > 3
    assert collected(text.read_fasta(spark, str(tmp_path / "f"))) == collected(reads)


def test_classes_and_integers(spark, tmp_path):
    pieces = spark.createDataFrame([(0, "l"), (1, "r"), (2, "l")], "seq_id BIGINT, cls STRING")
    text.write_classes(pieces, str(tmp_path / "c"))
    assert collected(text.read_classes(spark, str(tmp_path / "c"))) == collected(pieces)
    copies = spark.createDataFrame([(0, 5), (1, 7)], "read_id BIGINT, copy BIGINT")
    text.write_integers(copies, "read_id", "copy", str(tmp_path / "i"))
    assert collected(text.read_integers(spark, str(tmp_path / "i"), "copy")) == collected(copies)


def test_clusterings_of_a_folder(spark, tmp_path):
    data = catalog.DataSet(f"{tmp_path}/Tree_1perc_30000kbTemplate.fasta")
    for method, first in (("Kmeans", 100), ("Kmeans", 9), ("Dropoff", 0)):
        os.makedirs(data.clustering(method, first, first + 50))
    found = catalog.list_clusterings(spark, str(tmp_path), "Kmeans")
    assert [catalog.parse_clustering(f)[1] for f in found] == [9, 100]
