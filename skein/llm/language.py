"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is its runs of letters, lower-cased and parted by single blanks; its subwords are the 1 to 4 byte pieces of
that string, hashed into ``BUCKETS`` rows of an embedding table. The mean of their rows goes through a linear
softmax; table and softmax are trained together by stochastic gradient descent in numpy on a sample of at most about
``MOST_DOCS`` labelled documents, chosen by a hash of doc_id. Documents of the sample that took no part in training set
the temperature of the probabilities and the probability below which a prediction is rejected.

Defined results: a null text or one without a letter is ``und`` with score 0 and rejected; with nothing to learn from,
every text is ``und``; null languages are not learned; documents with a null id are held out; repeated rows are predicted alike;
an empty table gives an empty result. Extra columns are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_sample, fold, small_batches

BUCKETS = 1 << 14
DIMENSION = 16
MOST_DOCS = 2_000
EPOCHS = 5
RATE = 0.5
UND = "und"

_NO_LETTER = re.compile(r"[\W\d_]+")
_STEPS = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint32)


def subwords(text: str | None) -> np.ndarray | None:
    """Bucket of every piece of a text; None without a letter."""
    letters = _NO_LETTER.sub(" ", text.lower()) if text else ""
    if not any(map(str.isalpha, letters)):
        return None
    raw = np.frombuffer(f" {letters.strip()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32) + np.uint32(1)
    out, h = [], np.zeros(len(raw), np.uint32)
    for k in range(min(4, len(raw))):
        h = h[:len(raw) - k] * np.uint32(0x01000193) + raw[k:] * _STEPS[k]
        out.append((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(18))
    return np.concatenate(out)


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # embedding table times softmax weights: one row per bucket
    bias: np.ndarray
    temperature: float = 1.0
    least: float = 0.0
    embedding: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def probabilities(self, pieces: np.ndarray) -> np.ndarray:
        counts = np.bincount(pieces, minlength=BUCKETS)
        z = (counts @ self.logits / len(pieces) + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        pieces = subwords(text) if self.languages else None
        if pieces is None:
            return UND, 0.0, True
        p = self.probabilities(pieces)
        k = int(np.argmax(p))
        return self.languages[k], float(p[k]), bool(p[k] < self.least)


def train(texts: list[np.ndarray], wanted: np.ndarray, languages: list[str], seed: int = 11) -> Model:
    """Stochastic gradient descent over documents in random order, every language weighted alike."""
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
    weights, bias = np.zeros((DIMENSION, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    weights[:] = rng.normal(0, 0.1, weights.shape)
    share = np.maximum(np.bincount(wanted, minlength=len(languages)), 1)
    gain = (len(wanted) / len(languages) / share).clip(0.2, 5)
    steps, done = EPOCHS * len(texts), 0
    for _ in range(EPOCHS):
        for k in rng.permutation(len(texts)):
            rate = RATE * (1 - done / steps) * gain[wanted[k]]
            done += 1
            at, n = texts[k]
            share_of = (n / n.sum()).astype(np.float32)
            mean = share_of @ table[at]
            z = mean @ weights + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[wanted[k]] -= 1
            back = weights @ p
            weights -= rate * np.outer(mean, p)
            bias -= rate * 0.1 * p
            table[at] -= (rate * 4) * share_of[:, None] * back  # a bucket sees a small share of a document only
    return Model(languages, (table @ weights).astype(np.float64), bias.astype(np.float64), embedding=table)


def calibrate(model: Model, texts: list[np.ndarray], wanted: np.ndarray, precision: float) -> None:
    """Temperature by likelihood; the lowest probability from which on predictions reach ``precision``."""
    if not len(texts):
        return
    z = np.array([n @ model.logits[at] / n.sum() + model.bias for at, n in texts])

    def loss(t):
        s = z / t
        s = s - s.max(axis=1, keepdims=True)
        return -(s[np.arange(len(s)), wanted] - np.log(np.exp(s).sum(axis=1))).mean()

    model.temperature = float(min(np.geomspace(0.02, 20, 120), key=loss))
    s = z / model.temperature
    p = np.exp(s - s.max(axis=1, keepdims=True))
    top = p.max(axis=1) / p.sum(axis=1)
    order = np.argsort(-top, kind="stable")
    right = np.cumsum((z.argmax(axis=1) == wanted)[order]) / np.arange(1, len(z) + 1)
    good = np.flatnonzero(right >= precision)
    model.least = float(top[order[good[-1]]]) if len(good) else 1.0
    if len(good) == len(z):
        model.least = 1.0 / len(model.languages)


def fit(docs: DataFrame, folds: int = 5, held_out: int = 0, most_docs: int = MOST_DOCS, precision: float = 0.99) -> Model:
    """Model from documents whose language is known and whose fold is not ``held_out``."""
    small_batches(docs.sparkSession)
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull()
                       & (fold(F.col("doc_id"), folds) != held_out)).select("doc_id", "lang", "text")
    sample = bounded_sample(known, F.col("doc_id"), most_docs)

    @F.pandas_udf("array<int>")
    def pieces(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            p = subwords(t)
            if p is not None:  # bucket and count in turn
                at, n = np.unique(p, return_counts=True)
                p = np.stack([at, n], axis=1).ravel().astype(np.int32)
            out.append(p)
        return pd.Series(out, dtype=object)

    rows = sample.select("doc_id", "lang", pieces("text").alias("pieces")).where("pieces IS NOT NULL").toPandas()
    rows = rows.sort_values(["doc_id", "lang"], kind="stable")
    languages = sorted(rows["lang"].unique())
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0))
    texts = [(p[::2], p[1::2]) for p in (np.asarray(p, np.int64) for p in rows["pieces"])]
    wanted = np.array([languages.index(x) for x in rows["lang"]])
    held = np.arange(len(texts)) % 5 == 4
    model = train([t for t, h in zip(texts, held) if not h], wanted[~held], languages)
    calibrate(model, [t for t, h in zip(texts, held) if h], wanted[held], precision)
    return model


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns with these names are replaced."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predicted(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    out = docs.withColumn("_lang", predicted(F.col(text)))
    return out.withColumns({c: F.col(f"_lang.{c}") for c in ("lang_pred", "score", "rejected")}).drop("_lang")


def identify(docs: DataFrame, folds: int = 5, held_out: int = 0, **options) -> DataFrame:
    """``docs`` with held_out, lang_pred, score and rejected, after fitting on the same table."""
    out = predict(docs, fit(docs, folds, held_out, **options))
    return out.withColumn("held_out", F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(True)))
