"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

Statistics of the whole text are standardised and mapped to random Fourier features, whose products approximate a
Gaussian kernel. Tasks sum the normal equations of the labelled documents they hold; the sums are added up by row of
the matrix, and the driver solves a system of fixed size. A part of the labelled documents that took no part in the fit calibrates
the scores by isotonic regression, read between its steps by straight lines.

Labels are learned from a sample of at most about ``MOST_LABELS`` rows, chosen by a hash of doc_id (every row is used
if there are fewer). Every document is scored.

Defined results: a null text counts as empty; labels of a doc_id that differ are averaged; null labels and labels
without a document are ignored; documents with a null id are scored and counted as held out; repeated rows get equal
scores; without any label every score is 0.5. An empty table gives an empty result. Extra columns are kept by ``score``.
"""

from __future__ import annotations

import operator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_sample, fold, small_batches

MOST_LABELS = 24_000
FEATURES = 200
RIDGE = 1e-3
CALIBRATION_PARTS = 4  # one of so many labelled documents calibrates

_MARKS = [ord(c) for c in "!?.,;:|*$&%#@<>{}[]()\"'=_/\\-"]
STATISTICS = 12 + 8


def _byte_groups() -> np.ndarray:
    """Indicator of byte values: upper, lower, digits, blanks, line ends, non-ASCII, and groups of marks."""
    out = np.zeros((256, 12))
    for k, wanted in enumerate((range(65, 91), range(97, 123), range(48, 58), (9, 11, 12, 13, 32), (10,), range(128, 256),
                                (33,), (124,), [ord(c) for c in "*$&%#"], [ord(c) for c in ".,"], [ord(c) for c in "@/\\<>{}[]=_"],
                                [ord(c) for c in "?;:()\"'-"])):
        out[list(wanted), k] = 1
    return out


_GROUPS = _byte_groups()


def statistics(text: str | None) -> np.ndarray:
    """Shares of character groups and of repeated words and lines, and lengths on a log scale."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    out = np.zeros(STATISTICS)
    if not len(raw):
        return out
    out[:12] = np.sqrt(np.bincount(raw, minlength=256) @ _GROUPS / len(raw))
    words = text.split()
    if words:
        n, distinct = len(words), len(set(words))
        lines = text.split("\n")
        out[12:] = (np.log1p(n), distinct / n, sum(map(operator.eq, words, words[1:])) / n,
                    np.log1p(sum(map(len, words)) / n), np.log1p(max(map(len, words))), len(set(lines)) / len(lines),
                    np.log1p(n / len(lines)), np.log(n / distinct))
    return out


@dataclass
class Model:
    """Everything that scoring needs; of fixed size."""

    mean: np.ndarray
    scale: np.ndarray
    frequency: np.ndarray
    phase: np.ndarray
    weights: np.ndarray | None = None
    knots: np.ndarray = field(default_factory=lambda: np.zeros(0))
    values: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def map(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.ones((len(z), 1)), np.sqrt(2 / len(self.phase)) * np.cos(z @ self.frequency + self.phase)])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.map(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(stats), 0.5)
        raw = self.raw(stats)
        if not len(self.knots):
            return np.clip(raw, 0, 1)
        # the small slope keeps apart what one step of the calibration would tie
        return np.clip(0.998 * np.interp(raw, self.knots, self.values) + 0.002 / (1 + np.exp(-np.clip(raw, -30, 30))), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: mean x and mean y of every block, in order."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []  # sum of y, count, sum of x
    for k in order:
        blocks.append([float(y[k]), 1.0, float(x[k])])
        while len(blocks) > 1 and (blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1] or blocks[-2][2] == blocks[-1][2]):
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def _rows(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["stats"].tolist(), np.float64).reshape(-1, STATISTICS)


def _statistics_of(batches):
    for pdf in batches:
        yield pd.DataFrame({"label": pdf["label"], "part": pdf["part"], "stats": [statistics(t) for t in pdf["text"]]})


def _moments(batches):
    n, total, square = 0, np.zeros(STATISTICS), np.zeros(STATISTICS)
    for pdf in batches:
        x = _rows(pdf)
        n, total, square = n + len(x), total + x.sum(axis=0), square + (x * x).sum(axis=0)
    if n:
        yield pd.DataFrame({"row": range(STATISTICS), "n": n, "total": total, "square": square})


def _normal_equations(model: Model):
    """Partial sums of a task that has rows: one row per row of the matrix, its right side last."""
    def run(batches):
        size = len(model.phase) + 1
        left, right, n = np.zeros((size, size)), np.zeros(size), 0
        for pdf in batches:
            x, y = model.map(_rows(pdf)), pdf["label"].to_numpy(np.float64)
            left += x.T @ x
            right += x.T @ y
            n += len(x)
        if n:
            yield pd.DataFrame({"row": range(size), "sums": list(np.hstack([left, right[:, None]]))})
    return run


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"row": [pdf["row"].iloc[0]], "sums": [np.sum(np.stack(pdf["sums"].to_list()), axis=0)]})


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 3, held_out: int = 1,
        most_labels: int = MOST_LABELS, seed: int = 7) -> Model:
    """Model of ``label`` from the documents whose fold is not ``held_out``."""
    small_batches(docs.sparkSession)
    known = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
             .groupBy(F.col("doc_id").alias("_id")).agg(F.avg(F.col(label).cast("double")).alias("label")))
    known = bounded_sample(known, F.col("_id"), most_labels)
    # the sample has a fixed bound, so it can be broadcast; the texts stay where they are
    sample = (docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
              .select("label", F.pmod(F.xxhash64(F.lit(seed), "_id"), F.lit(CALIBRATION_PARTS)).alias("part"), "text")
              .mapInPandas(_statistics_of, "label double, part bigint, stats array<double>").persist())
    moments = (sample.mapInPandas(_moments, "row int, n bigint, total double, square double")
               .groupBy("row").agg(F.sum("n").alias("n"), F.sum("total").alias("t"), F.sum("square").alias("s")).orderBy("row").collect())
    rng = np.random.default_rng(seed)
    n = moments[0]["n"] if moments else 0
    mean = np.array([m["t"] for m in moments]) / n if n else np.zeros(STATISTICS)
    spread = np.array([m["s"] for m in moments]) / n - mean ** 2 if n else np.ones(STATISTICS)
    model = Model(mean, np.sqrt(np.maximum(spread, 1e-6)), rng.normal(0, 1 / np.sqrt(STATISTICS), (STATISTICS, FEATURES)),
                  rng.uniform(0, 2 * np.pi, FEATURES))
    if not n:
        sample.unpersist()
        return model
    rows = (sample.where("part != 0").mapInPandas(_normal_equations(model), "row int, sums array<double>")
            .groupBy("row").applyInPandas(_added, "row int, sums array<double>").collect())
    size = len(model.phase) + 1
    sums = np.array([r["sums"] for r in sorted(rows, key=lambda r: r["row"])]).reshape(-1, size + 1) if rows else np.zeros((size, size + 1))
    count = max(sums[0, 0], 1.0)
    model.weights = np.linalg.solve(sums[:, :-1] / count + RIDGE * np.eye(len(sums)), sums[:, -1] / count)
    held = sample.where("part = 0").select("label", "stats").toPandas()  # of bounded size
    sample.unpersist()
    if held["label"].nunique() > 1:
        model.knots, model.values = isotonic(model.raw(_rows(held)), held["label"].to_numpy(np.float64))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score of every text. A column called ``name`` is replaced."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.array([statistics(t) for t in texts]).reshape(-1, STATISTICS)))

    return docs.withColumn(name, scored(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    scored = score(docs, fit(docs, labels, **options))
    held = fold(F.col("doc_id"), options.get("folds", 3)) == options.get("held_out", 1)
    return (scored.withColumn("held_out", F.coalesce(held, F.lit(True)))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
