"""Near-duplicate vectors of equal label by cosine, with int8 products and rigorous error bounds.

Equal vectors of a label are one class. The classes of a label are dealt into tiles of about ``TILE`` rows by a hash,
and every pair of tiles is one task's work. Vectors are normalised in double precision and rounded to multiples of a
step of their own (int8); the product of two tiles of codes is exact, and the norms of what rounding left bound the
error of every pair. Pairs certainly below or above the threshold are settled by the bound, the others are computed
in double precision. A task counts the links of every class and keeps a spanning forest of them, so what
leaves it grows with its rows, not with its pairs.

Defined results: a null label, a null, empty or zero vector, and null or non-finite components link with nothing; rows that repeat
a vec_id are one node, also if their vectors differ, and what such a node links with counts once; vectors of different lengths do not link; a null vec_id takes part in no link; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import Union, components, grouped, small_batches
from skein.session import cut_lineage

TILE = 1024


def codes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes of unit rows, their steps, and upper bounds of the norm that rounding has left."""
    step = np.maximum(np.abs(x).max(axis=1), 1e-300) / 127
    code = np.rint(x / step[:, None])
    rest = np.linalg.norm(x - code * step[:, None], axis=1)
    return code.astype(np.int8), step, rest * (1 + 1e-12) + 1e-14


def pairs_above(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows i of ``a`` and j of ``b`` (both of unit rows) with cosine >= threshold."""
    (qa, sa, ra), (qb, sb, rb) = codes(a), codes(b)
    # |x.y - x'.y'| <= |x'||ry| + |rx||y'| + |rx||ry| with |x'| <= 1 + |rx|
    product = qa.astype(np.float32) @ qb.astype(np.float32).T if a.shape[1] < 1024 else qa.astype(np.float64) @ qb.astype(np.float64).T
    about = product.astype(np.float64) * sa[:, None] * sb[None, :]
    error = (1 + ra)[:, None] * rb[None, :] + ra[:, None] * (1 + rb)[None, :] + (ra[:, None] * rb[None, :]) + 1e-12
    i, j = np.nonzero(about + error >= threshold)
    sure = about[i, j] - error[i, j] >= threshold
    for lo in range(0, len(i), 1 << 16):
        part = slice(lo, lo + (1 << 16))
        open_ = np.flatnonzero(~sure[part]) + lo
        sure[open_] = np.einsum("ij,ij->i", a[i[open_]], b[j[open_]]) >= threshold
    return i[sure], j[sure]


def _unit(column: pa.ChunkedArray, size: int) -> np.ndarray:
    flat = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in column.chunks])
    x = flat.reshape(-1, size)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


_FOUND = pa.schema([("_class", pa.string()), ("_with", pa.string()), ("links", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])


def _tiles(threshold: float):
    def run(batches):
        for group in grouped(batches, "label", "size", "tile", "other"):
            size, tile, other = (group.column(c)[0].as_py() for c in ("size", "tile", "other"))
            side = group.column("side").to_numpy()
            ids, copies = group.column("id").to_numpy(), group.column("copies").to_numpy()
            x = _unit(group.column("embedding"), size)
            left, right = np.flatnonzero(side == tile), np.flatnonzero(side == other)
            links, union = np.zeros(len(ids), np.int64), Union(len(ids))
            cls, shared = group.column("_class").to_pylist(), group.column("shared").to_numpy(zero_copy_only=False)
            edges, named = [], []
            if len(left) and len(right):
                i, j = pairs_above(x[left], x[right], threshold)
                i, j = left[i], right[j]
                if tile == other:
                    i, j = i[i < j], j[i < j]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                listed = shared[i] | shared[j]  # an id with several vectors must not count twice
                named = [(cls[p], cls[q]) for p, q in zip(i[listed].tolist(), j[listed].tolist())]
                edges = [(int(ids[p]), int(ids[q])) for p, q in zip(i.tolist(), j.tolist()) if union.join(p, q)]
            rows = [{"_class": cls[k], "links": int(links[k])} for k in np.flatnonzero(links).tolist()]
            rows += [{"a": a, "b": b} for a, b in edges]
            rows += [{"_class": a, "_with": b} for p, q in named for a, b in ((p, q), (q, p))]
            yield pa.RecordBatch.from_pylist(rows, _FOUND)
    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    small_batches(vectors.sparkSession)
    given = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("embedding"))
    finite = F.coalesce(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))), F.lit(False))
    usable = (F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & finite
              & F.exists("embedding", lambda v: v != 0))
    zero = F.transform("embedding", lambda v: v + F.lit(0.0))  # -0.0 equals 0.0
    rows = (given.withColumn("_usable", F.coalesce(usable, F.lit(False)))
            .withColumn("_class", F.when(F.col("_usable"), F.sha2(F.concat_ws(
                "|", F.col("label").cast("string"), F.array_join(zero.cast("array<string>"), ",")), 256))))
    # ids with several vectors: their classes are marked
    places = rows.where("_usable").select("vec_id", "_class").distinct()
    several = places.groupBy("vec_id").agg(F.count("*").alias("_n")).where("_n > 1").select("vec_id")
    several = cut_lineage(places.join(several, "vec_id", "left_semi"))
    marked = several.select("_class").distinct().withColumn("shared", F.lit(True))
    classes = cut_lineage(rows.where("_usable").groupBy("_class").agg(
        F.min("vec_id").alias("id"), F.count_distinct("vec_id").alias("copies"), F.first("label").alias("label"),
        F.first("embedding").alias("embedding")).withColumn("size", F.size("embedding"))
        .join(marked, "_class", "left").withColumn("shared", F.coalesce("shared", F.lit(False))))
    tiles = cut_lineage(classes.groupBy("label", "size").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles")))
    dealt = (classes.join(tiles, ["label", "size"])
             .withColumn("side", F.pmod(F.xxhash64("_class"), F.col("tiles")).cast("int"))
             .withColumn("_partner", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
             .select("label", "size", F.least("side", "_partner").alias("tile"), F.greatest("side", "_partner").alias("other"),
                     "side", "_class", "id", "copies", "shared", "embedding"))
    keys = ["label", "size", "tile", "other"]
    found = cut_lineage(dealt.repartition(*keys).sortWithinPartitions(*keys)
                        .mapInArrow(_tiles(threshold), "_class string, _with string, links bigint, a bigint, b bigint"))
    links = found.where("links IS NOT NULL").groupBy("_class").agg(F.sum("links").alias("links"))
    # an id is one node: its vectors belong together
    roots = components(found.where("b IS NOT NULL").select("a", "b").union(
        several.join(classes.select("_class", "id"), "_class").select("vec_id", "id")))
    # how often ids with several vectors were counted too much: only they and the links of their classes are listed
    around = found.where("_with IS NOT NULL").select("_class", "_with").union(marked.select("_class", F.col("_class").alias("_with"))).distinct()
    twice = several.select(F.col("vec_id").alias("_id"), F.col("_class").alias("_with"))

    def surplus(near: DataFrame, key: str) -> DataFrame:
        return (near.join(twice, "_with").groupBy(key, "_id").agg((F.count("*") - 1).alias("_over"))
                .groupBy(key).agg(F.sum("_over").alias("_over")))
    per_class = cut_lineage(
        classes.select("_class", "id", "copies").join(links, "_class", "left").join(surplus(around, "_class"), "_class", "left")
        .join(roots.withColumnRenamed("node", "id"), "id", "left")
        .select("_class", (F.col("copies") - 1 + F.coalesce("links", F.lit(0)) - F.coalesce("_over", F.lit(0))).alias("n_links"),
                F.coalesce("root", "id").alias("component_id")))
    near = several.join(around, "_class").select("vec_id", "_with").distinct()
    sizes = classes.select(F.col("_class").alias("_with"), "copies")
    per_id = (near.join(sizes, "_with").groupBy("vec_id").agg((F.sum("copies") - 1).alias("_all")).join(surplus(near, "vec_id"), "vec_id", "left")
              .select("vec_id", (F.col("_all") - F.coalesce("_over", F.lit(0))).alias("_of_id")))
    return (rows.select("vec_id", "_class").join(per_class, "_class", "left").join(per_id, "vec_id", "left")
            .select("vec_id", F.when(F.col("_class").isNull(), 0).otherwise(F.coalesce("_of_id", "n_links")).cast("bigint").alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))
