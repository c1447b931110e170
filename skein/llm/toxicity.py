"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon transducer reads words and writes symbols: insult and threat (with a weight), target, negation, report, other;
a comma before a new subject or a "but" is a break. Five small transducers read the symbols of a clause: which insults and
threats occur, whether somebody is targeted, which insults stand in the short scope of a negation, and which are reported
speech. A scope ends after the insults that meet it first (negation) or at a break (both). They are composed into one
automaton, whose outputs tell insults inside a scope from those outside; a clause with both has weights of
several kinds. A document is described by the weights of its clauses by kind, and a logistic model turns them into a score, so a word counts by the clause it is in.

The insult lexicon has built-in words and stems learned from labelled documents: words and word beginnings that occur
in toxic documents far more often than chance allows. Copies of a document are learned from once. Labels are learned from at most about
``MOST_LABELS`` documents, chosen by a hash of doc_id. Every document is scored as a whole.

Defined results: a null or empty text has no clause and gets the score of texts without any; null labels and labels without a document are ignored;
differing labels of a doc_id are averaged and count as toxic from one half; documents with a null id are scored and
held out; repeated rows get equal scores; without labels the built-in weights hold; an empty table gives an empty
result. Extra columns are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import bounded_sample, fold, shingle_hashes, small_batches, words_of

MOST_LABELS = 12_000
STEMS = range(3, 8)  # lengths of word beginnings that can be learned
LEAST_PRECISION = 0.9
NEGATION_SCOPE = 2

INSULTS = ("idiot moron stupid pathetic worthless disgusting loser scum trash clown imbecile dumb fool vermin "
           "filth coward degenerate retard bastard").split()
THREATS = "kill hurt destroy murder stab shoot strangle smash burn".split()
TARGETS = ("you your yours he she him her they them their these those people everyone du dich dir ihr euch sie tu toi "
           "vous ils elles eux usted ustedes ellos ellas").split()
NEGATIONS = "not no never isn aren wasn don without nicht kein keine nie pas jamais non nunca ni".split()
REPORTS = ("said says say called calls wrote writes quoted quotes claimed claims reported sagte sagt nannte schrieb dit "
           "disait appelle dijo dice llamó escribió").split()

SUBJECTS = frozenset((*TARGETS, *"i we it this that ich wir es je j nous on il elle yo nosotros él tú".split()))
TURNS = frozenset("but yet however aber doch sondern mais pero sino".split())
LINKS = frozenset("and or so und oder et ou y o".split())  # part clauses only before a new subject

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, BREAK = range(7)
KINDS = ("plain", "targeted", "denied", "quoted", "threat", "threatened")
PRIOR = np.array([-3.0, 3.0, 4.0, 0.5, 0.5, 2.0, 4.0])  # bias and kinds
_CLAUSE = re.compile(r"[.!?;\n]")
_WORD = re.compile(r"\w+")


@dataclass(frozen=True)
class Transducer:
    """Deterministic and weighted; a symbol without an arc stays in its state at no weight.

    ``arcs``: (state, symbol) to (state, weight); ``after`` holds, by state, where any symbol without an arc leads.
    """

    start: str
    arcs: dict
    after: dict = field(default_factory=dict)

    def step(self, state, symbol):
        return self.arcs.get((state, symbol)) or (self.after.get(state, state), 0.0)


def scope(name: str, opener: int, length: int | None) -> Transducer:
    """Marks, by weight 1, insults and threats that follow an ``opener`` within ``length`` words (None: up to a break).

    A scope with a length ends after the first that it marks and those right behind.
    """
    states = ["free", *(f"open{k}" for k in range(length, 0, -1)), "hit"] if length else ["free", "open"]
    arcs = {(s, opener): (states[1], 0.0) for s in states} | {(s, BREAK): ("free", 0.0) for s in states}
    for s in states[1:]:
        arcs[s, INSULT] = arcs[s, THREAT] = (states[-1], 1.0)
    after = dict(zip(states[1:], [*states[2:-1], "free", "free"])) if length else {}
    return Transducer("free", arcs, after)


def seen(symbol: int) -> Transducer:
    return Transducer("no", {("no", symbol): ("yes", 1.0)})


PARTS = (seen(INSULT), seen(THREAT), seen(TARGET), scope("negation", NEGATION, NEGATION_SCOPE), scope("report", REPORT, None))


def compose(parts: Iterable[Transducer]) -> tuple[np.ndarray, list[tuple], list[list[tuple]]]:
    """Product of transducers that read the same symbols: next states by state and symbol, the states, and the
    weights that the parts give, by state and symbol; 0 starts."""
    states, rows, todo = {tuple(p.start for p in parts): 0}, {}, [tuple(p.start for p in parts)]
    while todo:
        state = todo.pop()
        row = []
        for symbol in range(7):
            steps = [p.step(s, symbol) for p, s in zip(parts, state)]
            to = tuple(s for s, _ in steps)
            if to not in states:
                states[to] = len(states)
                todo.append(to)
            row.append((states[to], tuple(w for _, w in steps)))
        rows[states[state]] = row
    ordered = [rows[k] for k in range(len(rows))]
    return np.array([[to for to, _ in row] for row in ordered]), list(states), [[w for _, w in row] for row in ordered]


_NEXT, _STATES, _WEIGHTS = compose(PARTS)
NEXT = _NEXT.tolist()
#: Where a word of a symbol stands that is read in a state.
OUTSIDE, DENIED, QUOTED = range(3)
PLACE = [[DENIED if w[3] else QUOTED if w[4] else OUTSIDE for w in row] for row in _WEIGHTS]
_SYMBOLS = {w: s for s, words in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)) for w in words}


class Grammar:
    """Lexicon and composed automaton. ``stems``: learned (text, is a whole word) to weight."""

    def __init__(self, stems: dict[tuple[str, bool], float]):
        self.cues = {(w, True): (INSULT, 1.0) for w in INSULTS} | {(w, True): (THREAT, 1.0) for w in THREATS}
        self.cues |= {k: (INSULT, w) for k, w in stems.items()}
        self.finder = ahocorasick.Automaton()
        for text in {t for t, _ in self.cues}:
            self.finder.add_word(text, text)
        self.finder.make_automaton()

    def cue(self, word: str) -> tuple[int, float] | None:
        """Symbol and weight of a word: whole words first, then its longest known beginning."""
        found = self.cues.get((word, True))
        for k in reversed(STEMS):
            if found:
                break
            if len(word) > k:
                found = self.cues.get((word[:k], False))
        return found

    def clauses(self, text: str):
        """(kind, weight, start, end) of the clauses with an insult or threat; a clause can have several kinds."""
        low = text.lower()
        done = 0
        for last, cue in self.finder.iter(low):
            first = last - len(cue) + 1
            if first < done or first and (low[first - 1].isalnum() or low[first - 1] == "_"):
                continue
            start = max((low.rfind(c, done, first) for c in ".!?;\n")) + 1 or done
            stop = _CLAUSE.search(low, last)
            stop = stop.start() if stop else len(low)
            state, weights, places, threat = 0, [0.0, 0.0, 0.0], set(), False
            before, symbol, linked = start, OTHER, False
            for m in _WORD.finditer(low, start, stop):
                word = m.group()
                comma = "," in low[before:m.start()] and symbol != REPORT  # "he said, you are" goes on
                if (comma or linked) and word in SUBJECTS or comma and word in TURNS:
                    state = NEXT[state][BREAK]
                linked, before = comma and word in LINKS, m.end()
                found = self.cue(word)
                symbol = found[0] if found else _SYMBOLS.get(word, OTHER)
                if found:
                    place = PLACE[state][symbol]
                    places.add(place)
                    weights[place] += found[1]
                    threat |= symbol == THREAT and place == OUTSIDE
                state = NEXT[state][symbol]
            target = _STATES[state][2] == "yes"
            outside = ("threatened" if target else "threat") if threat else "targeted" if target else "plain"
            for place in sorted(places):
                yield KINDS.index((outside, "denied", "quoted")[place]), weights[place], start, stop
            done = max(stop, last + 1)  # also without a cue: a clause is walked once, whatever words begin like cues

    def describe(self, text: str | None) -> np.ndarray:
        out = np.zeros(len(KINDS))
        for kind, weight, _, _ in self.clauses(text or ""):
            out[kind] += weight
        return np.log1p(out)


@dataclass
class Model:
    stems: dict
    weights: np.ndarray

    def grammar(self) -> Grammar:
        if not hasattr(self, "_grammar"):
            self._grammar = Grammar(self.stems)
        return self._grammar

    def __getstate__(self):
        return {"stems": self.stems, "weights": self.weights}

    def score(self, text: str | None) -> float:
        z = self.weights[0] + self.grammar().describe(text) @ self.weights[1:]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def copy_keys(text: str | None, n: int = 4) -> list[int]:
    """Smallest hashes of the five-word shingles under ``n`` orders; near copies share most of them."""
    x = shingle_hashes(words_of(text), 5)
    if not len(x):
        return [0] * n
    return [int((x * np.uint64(0x9E3779B97F4A7C15 + 2 * 7919 * k)).min() >> np.uint64(1)) for k in range(n)]


def patterns(text: str | None) -> set[tuple[str, bool]]:
    words = set(_WORD.findall((text or "").lower()))
    return {(w, True) for w in words if len(w) >= STEMS[0]} | {(w[:k], False) for w in words for k in STEMS if len(w) > k}


def _counted(batches):
    toxic, clean = Counter(), Counter()

    def emit():
        keys = list(toxic.keys() | clean.keys())
        return pd.DataFrame({"cue": [k[0] for k in keys], "word": [k[1] for k in keys],
                             "toxic": [toxic[k] for k in keys], "clean": [clean[k] for k in keys]})

    for pdf in batches:
        for text, label in zip(pdf["text"], pdf["label"]):
            (toxic if label else clean).update(patterns(text))
        if len(toxic) + len(clean) > 400_000:
            yield emit()
            toxic.clear()
            clean.clear()
    if toxic or clean:
        yield emit()


def chosen_stems(found: pd.DataFrame) -> dict[tuple[str, bool], float]:
    """Of cues that contain each other, those that tell most, and of equally telling ones the longest."""
    out: dict[tuple[str, bool], tuple[float, int]] = {}
    order = sorted(found.itertuples(index=False), key=lambda r: (-round(r.gain, 6), -len(r.cue), r.cue, not r.word))
    for r in order:
        if any((not w and r.cue.startswith(c)) or (c.startswith(r.cue) and not r.word and n >= 0.98 * r.toxic)
               or (c == r.cue and w) for (c, w), (_, n) in out.items()):
            continue
        out[r.cue, bool(r.word)] = (min(4.0, float(np.log((r.toxic + 0.5) / (r.clean + 0.5)))), r.toxic)
    return {k: max(w, 0.5) for k, (w, _) in out.items()}


def logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray = PRIOR, ridge: float = 0.3) -> np.ndarray:
    """Newton steps for a logistic model that is held to ``prior`` where the data say nothing."""
    x = np.hstack([np.ones((len(x), 1)), x])
    w = prior.copy()
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * (w - prior))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 3, held_out: int = 1,
        most_labels: int = MOST_LABELS) -> Model:
    small_batches(docs.sparkSession)
    known = (labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id"), folds) != held_out))
             .groupBy(F.col("doc_id").alias("_id")).agg((F.avg(F.col(label).cast("double")) >= 0.5).cast("int").alias("label")))
    known = bounded_sample(known, F.col("_id"), most_labels)

    @F.pandas_udf("array<bigint>")
    def keys(texts: pd.Series) -> pd.Series:
        return texts.map(copy_keys, na_action=None)

    # the sample has a fixed bound, so it can be broadcast and its keys brought to the driver
    sample = (docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("_id"))
              .select("_id", "label", "text").persist())
    spread = sample.select("_id", "label", keys("text").alias("keys")).toPandas().sort_values("_id", kind="stable")
    for k in range(4):
        spread = spread[~pd.Series([x[k] for x in spread["keys"]], index=spread.index, dtype="object").duplicated()]
    n, toxic = len(spread), int(spread["label"].sum())
    if not n or toxic in (0, n):
        sample.unpersist()
        return Model({}, PRIOR.copy())
    once = docs.sparkSession.createDataFrame(spread[["_id"]].drop_duplicates(), "_id bigint")
    learned = sample.join(F.broadcast(once), "_id").dropDuplicates(["_id"]).select("label", "text").persist()
    counts = learned.mapInPandas(_counted, "cue string, word boolean, toxic bigint, clean bigint").groupBy("cue", "word").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where("toxic > 1").persist()
    # how far beyond chance: n * KL(share of toxic || base rate), against the number of cues that were tried
    base = toxic / n
    share = F.least(F.col("toxic") / (F.col("toxic") + F.col("clean")), F.lit(1 - 1e-9))
    gain = (F.col("toxic") + F.col("clean")) * (share * F.log(share / base) + (1 - share) * F.log((1 - share) / (1 - base)))
    found = counts.where((share >= LEAST_PRECISION) & (gain >= float(np.log(max(counts.count(), 2)) + np.log(10)))).withColumn(
        "gain", gain).toPandas()
    counts.unpersist()
    model = Model(chosen_stems(found), PRIOR.copy())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<double>")
    def described(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.grammar().describe(t) for t in texts], dtype=object)

    rows = learned.select("label", described("text").alias("x")).toPandas()
    learned.unpersist()
    sample.unpersist()
    model.weights = logistic(np.array(rows["x"].tolist(), np.float64).reshape(-1, len(KINDS)), rows["label"].to_numpy(np.float64))
    return model


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with a score of every text. A column called ``name`` is replaced."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype=float)

    return docs.withColumn(name, scored(F.col(text)))


def matches(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with the matched clauses: kind, weight, start and end in characters."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("array<struct<kind: string, weight: double, start: int, end: int>>")
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": KINDS[k], "weight": w, "start": a, "end": b}
                           for k, w, a, b in shared.value.grammar().clauses(t or "")] for t in texts], dtype=object)

    return docs.withColumn("clauses", found(F.col(text)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **options) -> DataFrame:
    """``docs`` with held_out, score and predicted."""
    scored = score(docs, fit(docs, labels, **options))
    held = fold(F.col("doc_id"), options.get("folds", 3)) == options.get("held_out", 1)
    return (scored.withColumn("held_out", F.coalesce(held, F.lit(True)))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
