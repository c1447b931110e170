"""File names of a data set and of its results."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values: file name parts ------------------------------------------
TEMPLATE_SUFFIX = "Template.fasta"
PIECES_SUFFIX = "Seq.fasta"
PIECE_MAP_SUFFIX = "ReadSeqInfo"
MATRIX_SUFFIX = "MSA"
CLASS_SUFFIX = "SeqClass"
CORRELATIONS_PREFIX = "MaxCorrsOf_"
CLUSTERINGS = ("Dropoff", "RelDrop", "Kmeans")
CLUSTERING_NAME = "{method}SubdivisionOf_{first}_{last}_{matrix}"
CLUSTERING_PATTERN = r"(Dropoff|RelDrop|Kmeans)SubdivisionOf_(\d+)_(\d+)_(.+)$"
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class DataSet:
    """Paths next to a template file, all sharing its prefix."""

    template: str

    @property
    def prefix(self) -> str:
        if not self.template.endswith(TEMPLATE_SUFFIX):
            raise ValueError(f"template name must end in {TEMPLATE_SUFFIX}")
        return self.template[:-len(TEMPLATE_SUFFIX)]

    @property
    def pieces(self) -> str:
        return self.prefix + PIECES_SUFFIX

    @property
    def piece_map(self) -> str:
        return self.prefix + PIECE_MAP_SUFFIX

    @property
    def matrix(self) -> str:
        return self.prefix + MATRIX_SUFFIX

    @property
    def classes(self) -> str:
        return self.prefix + CLASS_SUFFIX

    @property
    def correlations(self) -> str:
        folder, name = os.path.split(self.matrix)
        return os.path.join(folder, CORRELATIONS_PREFIX + name)

    def clustering(self, method: str, first: int, last: int) -> str:
        folder, name = os.path.split(self.matrix)
        return os.path.join(folder, CLUSTERING_NAME.format(method=method, first=first, last=last, matrix=name))


def parse_clustering(path: str) -> tuple[str, int, int, str]:
    """Method, first and last column, matrix name."""
    found = re.search(CLUSTERING_PATTERN, os.path.basename(path.rstrip("/")))
    if not found:
        raise ValueError(f"not a clustering: {path}")
    return found[1], int(found[2]), int(found[3]), found[4]


def clusterings_in_order(paths: list[str], method: str) -> list[str]:
    """Clusterings of one method by window start."""
    mine = [p for p in paths if re.search(CLUSTERING_PATTERN, os.path.basename(p)) and parse_clustering(p)[0] == method]
    return sorted(mine, key=lambda p: parse_clustering(p)[1])


def list_clusterings(spark: SparkSession, folder: str, method: str) -> list[str]:
    """Clusterings of one method in a folder of any file system Spark reads, by window start."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)
    return clusterings_in_order([f.getPath().toString() for f in files], method)


def data_set_name(kind: str, percent: float, length: int) -> str:
    """``<type>_<percent>perc_<length>kb`` with the percentage stripped of dots and trailing zeros."""
    text = f"{percent:f}".rstrip("0").rstrip(".").replace(".", "")
    return f"{kind}_{text}perc_{length}kb"


def write_result(df: DataFrame, root: str, **partition) -> None:
    """Append a result table under fixed partition columns (window, method)."""
    for name, value in partition.items():
        df = df.withColumn(name, F.lit(value))
    df.write.mode("append").partitionBy(*partition).parquet(root)


def read_results(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(root)
