"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols: insult, threat, target, negation, reported speech, other.  Transducers for negation, reported
speech and targets (before or after) are composed into machines that run over each clause and rewrite its insults and
threats into events: plain or aimed at somebody, negated, reported.  A text's score is a logistic function of its
clauses' events.  What a stem weighs counts in plain events only; a negated or quoted insult lowers the score, one aimed
at somebody raises it more than the bare word, and so does an aimed threat, whether or not labels tell: weights start
from hand-set ones, are drawn towards them and stay on their side of zero, and an aimed threat weighs as the heaviest
stem.

Learned from labelled rows: the insult stems (word beginnings that are far more frequent in toxic texts, whatever the
language) and the events' weights.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that are learned from: those with the smallest hashes of their doc_id.
SAMPLE_ROWS = 20_000
#: A stem occurs in so many different toxic texts at least, and its log odds are so large at least.
STEM_TEXTS, STEM_ODDS = 6, 2.5
#: Letters of a stem, from and to; a longer beginning shares its first twelve letters with a stem.
STEM_LETTERS = 3, 12

INSULTS = frozenset("idiot moron scum loser trash pathetic stupid disgusting worthless clown".split())
THREATS = frozenset("kill hurt destroy beat smash burn shoot stab hunt strangle umbringen töten tuer frapper matar golpear".split())
TARGETS = frozenset("you your yours yourself u he she they them these those everyone du dich dein ihr euch tu toi vous votre ton tú usted ustedes tus".split())
NEGATIONS = frozenset("not no never nobody isn't aren't don't doesn't didn't won't wasn't nicht kein keine nie pas jamais aucun nunca jamás ningún".split())
REPORTS = frozenset("said says say wrote writes called calls quoted quote reported claims claimed sagte schrieb nannte dit écrit appelle dijo escribió llamó".split())
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, END = range(7)
QUOTES = "\"“”«»„"
_PIECE = re.compile(r"[\w']+")


class Transducer:
    """A deterministic transducer over symbols: ``step(state, symbol) -> (state, mark)``; a mark is put on the insult
    or threat that is read."""

    def step(self, state: int, symbol: int) -> tuple[int, bool]:
        raise NotImplementedError


class Negated(Transducer):
    """A negation reaches the three words after it."""

    def step(self, state, symbol):
        return (3, False) if symbol == NEGATION else (max(state - 1, 0), state > 0)


class Reported(Transducer):
    """A verb of saying makes what follows in the clause somebody else's words."""

    def step(self, state, symbol):
        return (1 if symbol == REPORT else state, state > 0)


class Aimed(Transducer):
    """A target reaches the five words after it; read backwards, those before it."""

    def step(self, state, symbol):
        return (5, False) if symbol == TARGET else (max(state - 1, 0), state > 0)


class Composed:
    """The product of transducers, whose arcs are built when first taken."""

    def __init__(self, *parts: Transducer):
        self.parts, self.arcs, self.start = parts, {}, (0,) * len(parts)

    def run(self, clause):
        """For each symbol of a clause its event: (insult or threat, marks); None for others."""
        state = self.start
        for symbol in clause:
            if (arc := self.arcs.get((state, symbol))) is None:
                steps = [p.step(s, symbol) for p, s in zip(self.parts, state)]
                event = (symbol, *(m for _, m in steps)) if symbol in (INSULT, THREAT) else None
                arc = self.arcs[state, symbol] = tuple(s for s, _ in steps), event
            state, event = arc
            yield event


#: Every event, in order: (insult or threat, negated, reported, aimed).  Plain events, those neither negated nor
#: reported, count as not aimed in any case, and again as aimed if they are.
EVENTS = [(c, n, r, a) for c in (INSULT, THREAT) for n in (False, True) for r in (False, True) for a in (False, True)]
_AT = {e: i for i, e in enumerate(EVENTS)}
WIDTH = len(EVENTS) + 4


def _prior(event) -> tuple[float, float, float]:
    """An event's hand-set weight, and the bounds between which labels may move it."""
    kind, negated, reported, aimed = event
    if negated or reported:
        return -0.5, -math.inf, -0.1
    return {(INSULT, False): (0.5, 0.0, math.inf), (INSULT, True): (0.5, 0.1, math.inf), (THREAT, False): (0.5, 0.1, math.inf), (THREAT, True): (2.0, 1.0, math.inf)}[kind, aimed]


#: Weights of the events, and then of: clauses with a plain event, their share, the largest weight of a stem in a plain
#: event, and the sum of these.
PRIOR, LOWEST, HIGHEST = (np.array([*x, *y]) for x, y in zip(zip(*map(_prior, EVENTS)), ((0.0,) * 4, (0.0,) * 4, (math.inf,) * 4)))


@dataclass
class Grammar:
    """Symbols for words, and the composed machine; ``stems`` has each insult stem's weight."""

    stems: dict[str, float] = field(default_factory=dict)
    limit: int = 100_000

    def __post_init__(self):
        self.known: dict[str, tuple[tuple[int, float], ...]] = {}
        self.gate = None
        self.lengths = sorted({len(s) for s in self.stems})
        #: An aimed threat weighs as much as the heaviest stem.
        self.threat = max(self.stems.values(), default=1.0)
        self.machine, self.backwards = Composed(Negated(), Reported(), Aimed()), Composed(Aimed())

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "gate": None}

    def may_hold(self, text: str) -> bool:
        """Whether a text holds the letters of an insult or threat anywhere; without them it has no event."""
        if self.gate is None:
            import ahocorasick

            self.gate = ahocorasick.Automaton()
            for word in (*self.stems, *INSULTS, *THREATS):
                self.gate.add_word(word, 0)
            self.gate.make_automaton()
        return next(self.gate.iter(text.lower()), None) is not None

    def _symbol(self, piece: str) -> tuple[int, float]:
        weight = max([self.stems.get(piece[:n], 0.0) for n in self.lengths if n <= len(piece)], default=0.0)
        if weight > 0:
            return INSULT, weight
        for symbol, members in ((INSULT, INSULTS), (THREAT, THREATS), (NEGATION, NEGATIONS), (TARGET, TARGETS), (REPORT, REPORTS)):
            if piece in members:
                return symbol, 1.0 * (symbol == INSULT)
        return OTHER, 0.0

    def word(self, word: str) -> tuple[tuple[int, float], ...]:
        """The symbols of a word between white space (its quotes and clause ends among them), with their weights."""
        if len(self.known) > self.limit:
            self.known.clear()
        symbols = [self._symbol(p) for p in _PIECE.findall(word.lower())] or [(OTHER, 0.0)]
        if word[0] in QUOTES:
            symbols.insert(0, (REPORT, 0.0))
        if word[-1] in ".!?;:" + QUOTES:
            symbols.append((END, 0.0))
        entry = self.known[word] = tuple(symbols)
        return entry

    def events(self, clause: list[int]):
        """Place and event of each insult and threat of a clause."""
        ahead = list(self.backwards.run(reversed(clause)))[::-1]
        for k, (event, other) in enumerate(zip(self.machine.run(clause), ahead)):
            if event:
                kind, negated, reported, aimed = event
                yield k, (kind, negated, reported, aimed or other[1])

    def features(self, text: str) -> np.ndarray | None:
        """Counts of a text's events and what stems weigh in plain ones; None if there is no event."""
        if not self.may_hold(text):
            return None
        known, look = self.known, self.word
        entries = [known.get(w) or look(w) for w in text.split()]
        if not any(s in (INSULT, THREAT) for e in set(entries) for s, _ in e):
            return None
        out, weights = np.zeros(WIDTH), []
        clause: list[tuple[int, float]] = []
        hit = clauses = 0

        def close():
            nonlocal hit, clauses
            clauses += 1
            symbols = [s for s, _ in clause]
            if INSULT in symbols or THREAT in symbols:
                plain = False
                for k, (kind, negated, reported, aimed) in self.events(symbols):
                    out[_AT[kind, negated, reported, aimed]] += 1
                    if not (negated or reported):
                        plain = True
                        weights.append(self.threat * aimed if kind == THREAT else clause[k][1])
                        out[_AT[kind, False, False, False]] += aimed
                hit += plain
            clause.clear()

        for entry in entries:
            for s in entry:
                if s[0] == END:
                    close()
                else:
                    clause.append(s)
        if clause:
            close()
        out[: len(EVENTS)] = np.log1p(out[: len(EVENTS)])
        out[len(EVENTS) :] = math.log1p(hit), hit / clauses, max(weights, default=0.0), math.log1p(sum(weights))
        return out


@dataclass
class Model:
    grammar: Grammar
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        x = self.grammar.features(text or "")
        z = self.bias + (float(x @ self.weights) if x is not None else 0.0)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def held_out(doc_id: str = "doc_id"):
    """Whether a row may not be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def _one_of_copies(sample: DataFrame) -> DataFrame:
    """``text, toxic``: of the texts of one label that share the least hash of their word triples (copies do, near ones
    mostly), the one of least text hash; texts without words go."""

    def run(batches):
        for b in batches:
            keys = []
            for text in b.column(0):
                words = (text.as_py() or "").lower().split()
                keys.append(min((zlib.crc32(" ".join(words[i : i + 3]).encode()) for i in range(max(1, len(words) - 2))), default=None) if words else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64())], names=["text", "toxic", "key"])

    rows = sample.select("text", "toxic").mapInArrow(run, "text string, toxic int, key long").where("key IS NOT NULL")
    return rows.groupBy("toxic", "key").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).select("text", "toxic")


def _stem_counts(texts: DataFrame) -> DataFrame:
    """``stem, toxic, clean``: in how many texts of either label each beginning of a word occurs."""

    def run(batches):
        for b in batches:
            counts: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(b.column(0), b.column(1)):
                pieces = {p for w in set(text.as_py().lower().split()) for p in _PIECE.findall(w) if not p.isdigit()}
                counts[toxic.as_py()].update({p[:n] for p in pieces for n in range(STEM_LETTERS[0], min(len(p), STEM_LETTERS[1]) + 1)})
            stems = list(counts[0].keys() | counts[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(stems, pa.string()), pa.array([counts[1][s] for s in stems], pa.int64()), pa.array([counts[0][s] for s in stems], pa.int64())],
                names=["stem", "toxic", "clean"],
            )

    rows = texts.select("text", "toxic").mapInArrow(run, "stem string, toxic long, clean long")
    return rows.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def learn_stems(sample: DataFrame) -> dict[str, float]:
    """Beginnings of words with their log odds, all that pass STEM_TEXTS and STEM_ODDS; of nested ones the longest
    that keeps nine tenths of the toxic texts, else the shortest."""
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    odds = F.log((F.col("toxic") + 0.5) / F.lit(n.get(1, 0) + 1.0)) - F.log((F.col("clean") + 0.5) / F.lit(n.get(0, 0) + 1.0))
    # beginnings of words of at most SAMPLE_ROWS texts, in STEM_TEXTS of them at least
    rows = _stem_counts(_one_of_copies(sample)).where(F.col("toxic") >= STEM_TEXTS).withColumn("odds", odds).where(F.col("odds") >= STEM_ODDS).collect()
    found = {r["stem"]: (r["toxic"], r["odds"]) for r in rows}
    longer = defaultdict(list)
    for stem in sorted(found):
        longer[stem[:-1]].append(stem)
    kept: dict[str, float] = {}
    for stem in sorted(found, key=lambda s: (len(s), s)):
        if any(stem[:k] in kept for k in range(STEM_LETTERS[0], len(stem))):
            continue
        while more := [s for s in longer[stem] if found[s][0] >= 0.9 * found[stem][0]]:
            stem = more[0]
        kept[stem] = float(found[stem][1])
    return dict(sorted(kept.items(), key=lambda x: (-x[1], x[0])))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 100) -> tuple[np.ndarray, float]:
    """Logistic regression between the weights' bounds, with a ridge towards PRIOR, by Newton steps over the weights that
    are not held by a bound; weights and bias."""
    a = np.hstack([x, np.ones((len(x), 1))])
    start, low, high = np.r_[PRIOR, -2.0], np.r_[LOWEST, -np.inf], np.r_[HIGHEST, np.inf]
    keep = np.r_[np.full(x.shape[1], ridge), 1e-6]

    def cost(w):
        z = a @ w
        return np.logaddexp(0, z).sum() - y @ z + keep @ (w - start) ** 2 / 2

    w, now = start, cost(start)
    for _ in range(steps if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        g = a.T @ (p - y) + keep * (w - start)
        free = ~(((w <= low) & (g > 0)) | ((w >= high) & (g < 0)))
        b = a[:, free]
        move = np.zeros(len(w))
        move[free] = np.linalg.solve((b * (p * (1 - p))[:, None]).T @ b + np.diag(keep[free]), g[free])
        for k in range(40):
            new = np.clip(w - move / 2**k, low, high)
            if (then := cost(new)) < now:
                break
        else:
            break
        w, now = new, then
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Model:
    """Learn stems and weights from at most ``rows`` labelled documents that are not held out.

    Where a doc_id has several labels the largest counts; labels or documents without a doc_id are not learned from,
    rows that repeat a doc_id all are.  The same rows give the same model however they are partitioned.  Without a
    labelled row, or with one label only, the built-in words score by hand-set weights.
    """
    usable = labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    chosen = usable.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).orderBy(F.xxhash64("_id"), "_id").limit(rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("text").cast("string").alias("text"))
    # at most ``rows`` pairs of integers
    sample = texts.join(F.broadcast(chosen), texts["_doc"] == F.col("_id")).select("text", "toxic").persist()
    try:
        grammar = Grammar(learn_stems(sample))

        def run(batches):
            for b in batches:
                found = [grammar.features(t.as_py() or "") for t in b.column(0)]
                x = [(np.zeros(WIDTH) if f is None else f).tolist() for f in found]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

        got = sample.mapInArrow(run, "x array<double>, y int").toArrow()
    finally:
        sample.unpersist()
    y = got.column("y").to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return Model(grammar, 2 * PRIOR, -2.0)  # nothing else speaks, so the hand-set weights count double
    x = np.array(got.column("x").to_pylist())
    order = np.lexsort((y, *x.T))  # sums in one order, whatever order the rows came in
    return Model(grammar, *fit(x[order], y[order]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of documents.

    Null and empty texts have no event and get the score that goes with none; repeated rows get equal rows; an empty
    table gives none; a null doc_id stays null and is not held out; other columns are not read.
    """

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t.as_py()) for t in b.column(1)], pa.float64())], names=["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted to be toxic; same columns.

    Rows are judged one by one by their texts alone: null and empty texts stay, repeats and null doc_ids are judged
    like any other, an empty table gives no rows.
    """
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array([model.score(t.as_py()) < 0.5 for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
