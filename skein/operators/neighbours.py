"""Nearest bit strings inside labelled clusters, and majority clustering built on them.

Equal bit strings are searched once. Query and candidate strings are cut into blocks of bounded
size; a task multiplies one query block with one candidate block and keeps only the best few per
query, so a label of any size spreads over many equal tasks and pairs are never written out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut_lineage, many_tasks

NEIGHBOURS = 5  # fixed: a row is smoothed by the majority of its five nearest rows, itself included
BLOCK = 1024


def _matrix(bits: pd.Series) -> np.ndarray:
    n, width = len(bits), len(bits.iloc[0])
    return (np.frombuffer("".join(bits).encode(), np.uint8).reshape(n, width) - ord("0")).astype(np.float32)


def lowest_ids(df: DataFrame, keys: list[str], k: int, id_col: str = "row_id") -> DataFrame:
    """The ``k`` lowest ids per key as an array; Spark trims each key before it is shuffled."""
    w = Window.partitionBy(*keys).orderBy(id_col)
    return (df.select(*keys, id_col).withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
            .groupBy(*keys).agg(F.array_sort(F.collect_list(id_col)).alias("ids")))


def nearest(queries: DataFrame, candidates: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """Best ``k`` candidates per query of the same label by Hamming distance, lower id on ties.

    ``queries(label, bits)`` are distinct; ``candidates(label, bits, ids)`` hold up to ``k`` ids each.
    Result: ``label, bits, rank, dist, id, found`` with ``found`` the candidate's bits.
    """
    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("label").agg(F.ceil(F.count("*") / block).cast("int").alias(name))

    nq, nc = blocks(queries, "nq"), blocks(candidates, "nc")
    q = (queries.join(nq, "label").join(nc, "label")
         .select(F.col("label").alias("q_label"), F.col("bits").alias("q"), F.expr("cast(pmod(xxhash64(bits), nq) as int)").alias("qb"),
                 F.explode(F.sequence(F.lit(0), F.col("nc") - 1)).alias("cb")))
    c = (candidates.join(nq, "label").join(nc, "label")
         .select(F.col("label").alias("c_label"), F.col("bits").alias("c"), "ids", F.expr("cast(pmod(xxhash64(bits), nc) as int)").alias("cb"),
                 F.explode(F.sequence(F.lit(0), F.col("nq") - 1)).alias("qb")))

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"label": [], "bits": [], "dist": [], "id": [], "found": []})
        spread = right[["c", "ids"]].explode("ids").sort_values("ids", ignore_index=True)
        ids = spread["ids"].to_numpy(dtype=np.int64)
        a, b = _matrix(left["q"]), _matrix(spread["c"])
        dist = (a.sum(1)[:, None] + b.sum(1)[None, :] - 2 * a @ b.T).astype(np.int64)
        order = dist * len(ids) + np.arange(len(ids))  # distance first, then id
        take = min(k, len(ids))
        pick = np.argpartition(order, take - 1, axis=1)[:, :take]
        rows = np.repeat(np.arange(len(left)), take)
        pick = pick.ravel()
        return pd.DataFrame({"label": left["q_label"].iloc[0], "bits": left["q"].to_numpy()[rows],
                             "dist": dist[rows, pick], "id": ids[pick], "found": spread["c"].to_numpy()[pick]})

    n = many_tasks(queries.sparkSession)  # products of few bytes
    partial = q.repartition(n, "q_label", "qb", "cb").groupBy("q_label", "qb", "cb").cogroup(
        c.repartition(n, "c_label", "qb", "cb").groupBy("c_label", "qb", "cb")).applyInPandas(
        best, "label BIGINT, bits STRING, dist BIGINT, id BIGINT, found STRING")
    w = Window.partitionBy("label", "bits").orderBy("dist", "id")
    return partial.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _majority(bit_strings: str) -> Column:
    """Per position the bit that most of the nearest strings carry."""
    return F.when(F.length(F.get(bit_strings, F.lit(0))) == 0, F.lit("")).otherwise(F.array_join(F.transform(
        F.sequence(F.lit(1), F.length(F.get(bit_strings, F.lit(0)))),
        lambda i: F.when(F.size(F.filter(bit_strings, lambda s: F.substr(s, i, F.lit(1)) == "1")) > NEIGHBOURS // 2, "1").otherwise("0")), ""))


def centroids(points: DataFrame) -> DataFrame:
    """Majority string of the five nearest rows for every distinct bit string of a label."""
    candidates = lowest_ids(points, ["label", "bits"], NEIGHBOURS)
    found = nearest(candidates.select("label", "bits"), candidates, NEIGHBOURS)
    voted = (found.groupBy("label", "bits").agg(F.collect_list("found").alias("near"))
             .select("label", "bits", _majority("near").alias("centroid")))
    return voted.join(candidates, ["label", "bits"])


def nearest_centroid(points: DataFrame, centers: DataFrame) -> DataFrame:
    """Row whose centroid is closest to each row, the row itself excluded, lower id on ties."""
    offered = lowest_ids(centers.select("label", F.col("centroid").alias("bits"), F.explode("ids").alias("row_id")),
                         ["label", "bits"], 2)
    best = (nearest(centers.select("label", "bits"), offered, 2)
            .groupBy("label", "bits").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("best")))
    other = F.filter("best", lambda b: b["id"] != F.col("row_id"))
    return (points.join(best, ["label", "bits"])
            .select("label", "row_id", "bits", F.coalesce(F.get(other, F.lit(0))["id"], F.col("row_id")).alias("cluster")))


def majority_clusters(points: DataFrame, min_group: int) -> DataFrame:
    """Cluster the rows of every label by their smoothed bit strings.

    ``points(label, row_id, bits)`` to ``label, row_id, cluster``; a cluster is named by the row
    giving its centroid. Then, for a growing minimum, all rows of clusters not larger than it move
    together to the best centroid of a cluster at least that large (sizes as of the start of the
    pass); rows without such a centroid join the cluster of the label's first row.
    """
    points = cut_lineage(points)
    centers = cut_lineage(centroids(points))
    placed = cut_lineage(nearest_centroid(points, centers))
    first_rows = points.groupBy("label").agg(F.min("row_id").alias("first_row"))
    center_of = points.join(centers.select("label", "bits", "centroid"), ["label", "bits"]).select(
        "label", F.col("row_id").alias("cluster"), "centroid")
    for minimum in range(2, min_group):
        sizes = placed.groupBy("label", "cluster").agg(F.count("*").alias("size"))
        moving = placed.join(sizes.where(F.col("size") <= minimum), ["label", "cluster"], "left_semi")
        if moving.isEmpty():
            continue
        targets = sizes.where(F.col("size") >= minimum).join(center_of, ["label", "cluster"])
        offered = lowest_ids(targets.select("label", F.col("centroid").alias("bits"), F.col("cluster").alias("row_id")),
                             ["label", "bits"], 3)
        best = (nearest(moving.select("label", "bits").distinct(), offered, 3)
                .groupBy("label", "bits").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("best")))
        other = F.filter("best", lambda b: (b["id"] != F.col("row_id")) & (b["id"] != F.col("cluster")))
        moved = (moving.join(best, ["label", "bits"], "left").join(first_rows, "label")
                 .select("label", "row_id", "bits",
                         F.coalesce(F.get(other, F.lit(0))["id"], F.col("first_row")).alias("cluster")))
        stay = placed.join(sizes.where(F.col("size") > minimum), ["label", "cluster"], "left_semi")
        placed = cut_lineage(stay.select(*moved.columns).unionByName(moved))
    return placed.select("label", "row_id", "cluster")


def nearest_row_clusters(points: DataFrame) -> DataFrame:
    """Simpler variant without centroids: every row joins its nearest other row."""
    candidates = lowest_ids(points, ["label", "bits"], 2)
    best = (nearest(candidates.select("label", "bits"), candidates, 2)
            .groupBy("label", "bits").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("best")))
    other = F.filter("best", lambda b: b["id"] != F.col("row_id"))
    return (points.join(best, ["label", "bits"])
            .select("label", "row_id", F.coalesce(F.get(other, F.lit(0))["id"], F.col("row_id")).alias("cluster")))
