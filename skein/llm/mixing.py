"""Mix sources to target weights along a time-varying curriculum, with DataFrame functions only.

Every source has a schedule of weights over training time 0..1, given as knots (time, weight) with straight lines
between them. The integral of a schedule is the source's overall weight. Targets share ``share`` of all words by
these weights; no source gives more than ``most_repeats`` times its words, and what is cut off is shared anew by
weight until nothing is above. Inside a source, documents stand in the order of a hash of their id; the words before
a document are the demand that must have arisen before it is due, so inverting the integrated schedule at that
demand gives its position in training. The result is range-sorted by position.

Defined results: a null or empty text has size 0 and takes nothing; a null source is a source of its own and comes
last; a source without words or weight has target 0; a null id is ordered by its empty text; rows that repeat id and
size follow each other in any order, which leaves equal rows; an empty table gives an empty result. Columns of
``docs`` other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 10_000  # more sources than this are joined by a shuffle
BUCKET_ROWS = 100
MOST_BUCKETS = 4096  # of a source; bounds the table of bucket sums, not the documents in a bucket

#: Schedules of the ranks 0, 1, 2, 0, 1, 2 ...; their integrals are 5, 2 and 1.
RANK_SCHEDULES = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 1.0), (1.0, 3.0)), ((0.0, 0.5), (1.0, 1.5)))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def rank_schedule(rank: Column, schedules=RANK_SCHEDULES) -> Column:
    """Knots by rank modulo the number of schedules."""
    knots = [F.array(*[F.struct(F.lit(float(t)).alias("t"), F.lit(float(w)).alias("w")) for t, w in s]) for s in schedules]
    return F.element_at(F.array(*knots), (F.pmod(rank, F.lit(len(schedules))) + 1).cast("int"))


def demand(knots: str) -> Column:
    """The integral of the schedule in column ``knots`` up to each of its knots."""
    return F.aggregate(
        F.slice(knots, F.lit(2), F.size(knots)),
        F.struct(F.element_at(knots, 1).alias("last"), F.array(F.lit(0.0)).alias("sums")),
        lambda acc, x: F.struct(x.alias("last"), F.concat(acc["sums"], F.array(
            F.element_at(acc["sums"], -1) + (acc["last"]["w"] + x["w"]) / 2 * (x["t"] - acc["last"]["t"]))).alias("sums")),
        lambda acc: acc["sums"])


def source_targets(sized: DataFrame, share: float = 1.5, most_repeats: int = 2, schedule=rank_schedule) -> DataFrame:
    """(source, source_size, source_docs, knots, sums, target) of documents with ``source`` and ``size``.

    One row per source meets in a window; documents do not.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    ranked = sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1)
    ranked = (ranked.withColumn("knots", schedule(F.col("rank"))).withColumn("sums", demand("knots"))
              .withColumn("weight", F.element_at("sums", -1))
              .withColumn("most", (F.col("source_size") * most_repeats).cast("double"))
              .withColumn("full_at", F.when(F.col("weight") > 0, F.col("most") / F.col("weight")).otherwise(F.lit(float("inf")))))
    # pour: in the order in which sources fill up, the level at which the rest could share what is left
    order = Window.orderBy("full_at", "rank")
    everything = Window.partitionBy()
    poured = ranked.withColumns({
        "left": F.sum("source_size").over(everything) * F.lit(float(share))
        - F.coalesce(F.sum("most").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "sharing": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))})
    level = F.when(F.col("sharing") > 0, F.col("left") / F.col("sharing"))
    first = F.min(F.when(level <= F.col("full_at"), F.struct("full_at", "rank", level.alias("level"))))
    poured = poured.withColumn("level", first.over(everything)["level"])  # null: all are full
    target = F.when(F.col("weight") > 0, F.coalesce(F.least(F.col("most"), F.col("weight") * F.col("level")), F.col("most")))
    return poured.select("source", "source_size", "source_docs", "knots", "sums",
                         F.coalesce(target, F.lit(0.0)).alias("target"))


def due(words_before: Column) -> Column:
    """The training time at which the demand arises that so many words meet."""
    at = words_before / F.col("target") * F.element_at("sums", -1)
    inner = F.slice("sums", F.lit(1), F.size("sums") - 1)
    segment = F.greatest(F.size(F.filter(inner, lambda s: s <= at)), F.lit(1))
    local = at - F.element_at("sums", segment)
    from_, to = F.element_at("knots", segment), F.element_at("knots", segment + 1)
    slope = (to["w"] - from_["w"]) / (to["t"] - from_["t"])
    root = F.sqrt(F.greatest(from_["w"] * from_["w"] + slope * local * 2, F.lit(0.0)))
    inside = F.when(local <= 0, F.lit(0.0)).otherwise(local * 2 / (from_["w"] + root))
    return from_["t"] + inside


def mix(docs: DataFrame, share: float = 1.5, most_repeats: int = 2, schedule=rank_schedule) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, position, repeats, passes; sorted by position.

    ``taken`` counts the words of all passes over the document; the document at the edge of a target gives its first
    words only. ``position`` is the training time of the first pass, null if nothing is taken. ``passes`` holds
    the position and the words of every pass that takes some, so its rows, sorted by position, are the curriculum.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    groups = cut_lineage(sized.groupBy("source", "doc_id", "size").agg(F.count("*").alias("copies")))
    weighed = groups.select("source", (F.col("size") * F.col("copies")).alias("size"), "copies")
    sources = cut_lineage(source_targets(weighed, share, most_repeats, schedule))
    known = F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources
    known = known.withColumnRenamed("source", "_source")
    buckets = F.least(F.ceil(F.col("source_docs") / BUCKET_ROWS), F.lit(MOST_BUCKETS))
    placed = (groups.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
              .withColumn("order", F.coalesce(F.md5(F.col("doc_id").cast("string").cast("binary")), F.lit("")))
              .withColumn("bucket", F.floor(F.coalesce(F.conv(F.substring("order", 1, 8), 16, 10).cast("bigint"), F.lit(0))
                                            * buckets / F.lit(1 << 32))))
    words = F.col("size") * F.col("copies")
    sums = placed.groupBy("source", "bucket").agg(F.sum(words).alias("_words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.coalesce("source", F.lit("")).alias("_source"), F.col("source").isNull().alias("_none"),
                       F.col("bucket").alias("_bucket"), F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_earlier"))
    inside = Window.partitionBy("source", "bucket").orderBy("order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    queued = (placed.withColumn("_inside", F.coalesce(F.sum(words).over(inside), F.lit(0)))
              .join(sums, (F.coalesce("source", F.lit("")) == F.col("_source")) & (F.col("source").isNull() == F.col("_none"))
                    & (F.col("bucket") == F.col("_bucket")))
              .withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
              .withColumn("before", F.col("_earlier") + F.col("_inside") + F.col("_copy") * F.col("size")))
    whole = F.floor("target").cast("bigint")
    passes = [F.greatest(F.least(whole - F.col("before") - F.col("source_size") * k, F.col("size")), F.lit(0))
              for k in range(most_repeats)]
    taken = sum(passes[1:], passes[0])
    timed = F.array(*[F.struct(F.when(p > 0, due(F.col("before") + F.col("source_size") * k)).alias("position"), p.alias("words"))
                      for k, p in enumerate(passes)])
    return (queued.withColumn("taken", taken).withColumn("passes", F.filter(timed, lambda p: p["words"] > 0))
            .withColumn("position", F.get("passes", F.lit(0))["position"])
            .withColumn("repeats", sum([(p > 0).cast("int") for p in passes[1:]], F.lit(0)))
            .select("doc_id", "source", "size", "source_size", "target", "taken", "position", "repeats", "passes")
            .orderBy(F.col("position").asc_nulls_last(), "doc_id", "size", "source"))
