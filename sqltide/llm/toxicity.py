"""Toxicity by a weighted finite-state pattern grammar over clauses.

Words become symbols: insult, threat, target, negation, report, or other.  Insults are learned: in
labelled documents, the words and word beginnings whose documents are toxic far more often than
chance, weighted by their smoothed log odds, beside short fixed lists.  Four transducers, composed
into one machine, rewrite a clause's symbols: reported speech marks what is only quoted, negation
what is denied, the target transducer what is aimed at someone, the threat transducer threats that
have a target.  Each clause gives the weight of its best match of each kind; a logistic regression
over these sums scores the document, so what negation or quotation is worth follows from labels.

Fitting takes at most ``sample`` labelled rows of each label, those with the smallest hashes of
their ids, spread over all rows; near copies among them count once.  Of words and beginnings
far more often toxic, the 20,000 (``most`` of :func:`learn_terms`) with the largest likelihood ratio are
learned, which bounds the model that goes to every task.  In the regression a row weighs
as many rows of its label as it stands for, so scores follow the mix of all labels, whatever the
size of the table.  Scoring is over whole texts.

A null or empty text has no clause and the score of a text without any match.  Labels of documents
that aren't there, null labels and rows with a null id are left out of fitting; of repeated ids
all rows are used, of contradictory labels the larger.  Without labels of both kinds the fixed
lists score alone.  An empty table gives no rows.  Other columns are kept by :func:`scored`.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sqltide.llm.words import U, mix, window_hashes, word_hashes

SAMPLE = 6000
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
#: What the machine makes of insults and threats.
BARE, AIMED, DENIED, QUOTED, MENACE = range(10, 15)
KINDS = (BARE, AIMED, DENIED, QUOTED, MENACE)

# Word lists of the grammar.
INSULTS = ("idiot moron stupid loser scum trash clown pathetic worthless disgusting dumb fool "
           "imbecile garbage filth vermin creep jerk freak parasite").split()
THREATS = ("kill hurt destroy beat punch stab shoot burn crush smash töten umbringen schlagen tuer "
           "frapper brûler matar golpear quemar").split()
TARGETS = ("you your yourself he she they them him her these those people everyone du dich dir "
           "ihr euch sie er tu toi vous ils elles lui leur usted ustedes ellos ellas vosotros").split()
NEGATIONS = ("not never no nobody neither nor isn't aren't wasn't don't doesn't nicht nie kein "
             "keine niemals pas jamais aucun ni nunca jamás tampoco").split()
REPORTS = ("said says say told tells called calls wrote writes quoted reported claimed sagte sagt "
           "schrieb nannte dit disait écrit appelle dijo dice escribió llamó").split()
EDGE = ".,;:!?\"'()[]{}<>|*%&#$-_/\\«»„“”‚‘’¡¿…"
ENDS = frozenset(".;:!?|")
#: Lengths of word beginnings that can be learned.
STEMS = range(3, 9)
PRIOR = 5.0
#: Terms in a batch of counts.
TERMS = 50_000


class Transducer:
    """A deterministic transducer: ``step(state, symbol)`` gives the next state and symbol.
    States can be any values, so composing needs no tables."""

    def __init__(self, start, step: Callable):
        self.start, self.step = start, step

    def __matmul__(self, then: Transducer) -> Transducer:
        """Both in turn: what this one puts out, ``then`` reads."""

        def step(state, symbol):
            mine, out = self.step(state[0], symbol)
            other, out = then.step(state[1], out)
            return (mine, other), out

        return Transducer((self.start, then.start), step)

    def run(self, symbols: list[int]) -> list[int]:
        state, out = self.start, []
        for symbol in symbols:
            state, symbol = self.step(state, symbol)
            out.append(symbol)
        return out


def _report(state, symbol):
    """After a verb of saying, up to the end of the clause, insults and threats are quoted."""
    if symbol == REPORT:
        return 1, OTHER
    return state, QUOTED if state and symbol in (INSULT, THREAT) else symbol


def _negation(state, symbol):
    """A negation reaches over three words."""
    if symbol == NEGATION:
        return 3, OTHER
    return max(0, state - 1), DENIED if state and symbol in (INSULT, THREAT) else symbol


def _target(state, symbol):
    """An insult after a target is aimed at it."""
    if symbol == TARGET:
        return 1, TARGET
    return state, (AIMED if state else BARE) if symbol == INSULT else symbol


def _threat(state, symbol):
    """A threat holds once a target has followed; before that it is a plain word."""
    if symbol == THREAT:
        return 1, OTHER
    if state and symbol == TARGET:
        return 0, MENACE
    return state, OTHER if symbol == TARGET else symbol


GRAMMAR = (Transducer(0, _report) @ Transducer(0, _negation) @ Transducer(0, _target)
           @ Transducer(0, _threat))


@dataclass
class Model:
    """Weights of words and beginnings, and the regression over a document's features."""

    words: dict[str, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)
    bias: float = -3.0
    weights: tuple[float, ...] = (2.5, 0.5, 0.5, 0.5, 1.0, 0.0)


class Reader:
    """Finds the matches of a text; remembers the symbol of each word seen, up to a number."""

    def __init__(self, model: Model, room: int = 300_000):
        self.model, self.room = model, room
        self.fixed = {w: (s, 1.0) for s, ws in (
            (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS))
            for w in ws}
        self.fixed |= {w: (INSULT, PRIOR) for w in INSULTS}
        self.seen: dict[str, tuple] = {}

    def symbol(self, token: str) -> tuple[int, float, bool]:
        """Symbol, weight, and whether a clause ends with the token."""
        word = token.strip(EDGE)
        found = self.fixed.get(word)
        weight = self.model.words.get(word, 0.0)
        if word and (found is None or found[0] == INSULT):
            for n in STEMS:
                if n > len(word):
                    break
                weight = max(weight, self.model.stems.get(word[:n], 0.0))
            if weight:
                found = (INSULT, max(weight, found[1] if found else 0.0))
        return (*(found or (OTHER, 0.0)), token[-1] in ENDS)

    def features(self, text: str) -> list[float]:
        """Logs of the summed clause weights: of all that hold, and of each kind that counts
        for more or less; and of the words, where anything matches."""
        tokens = text.lower().split()
        seen = self.seen
        if len(seen) > self.room:
            seen.clear()
        for token in set(tokens).difference(seen):
            seen[token] = self.symbol(token)
        marked = [seen[t] for t in tokens]
        hits = [k for k, m in enumerate(marked) if m[0] == INSULT or m[0] == THREAT]
        sums = dict.fromkeys(KINDS, 0.0)
        done = -1
        for k in hits:
            if k < done:
                continue
            begin = k
            while begin > done and begin > 0 and not marked[begin - 1][2]:
                begin -= 1
            done = k
            while done < len(marked) and not marked[done][2]:
                done += 1
            done = min(done + 1, len(marked))
            best = dict.fromkeys(KINDS, 0.0)
            clause = marked[begin:done]
            for kind, m in zip(GRAMMAR.run([m[0] for m in clause]), clause, strict=True):
                if kind in best:
                    best[kind] = max(best[kind], m[1] if m[1] else 1.0)
            for kind, weight in best.items():
                sums[kind] += weight
        return [math.log1p(sums[BARE] + sums[AIMED] + sums[MENACE]),
                *(math.log1p(sums[k]) for k in (AIMED, DENIED, QUOTED, MENACE)),
                math.log1p(len(tokens)) if hits else 0.0]

    def score(self, text: str) -> float:
        total = self.model.bias + sum(
            w * x for w, x in zip(self.model.weights, self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def score(text: Column, model: Model) -> Column:
    """The toxicity of a text, from 0 to 1."""

    @F.arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(model)
        for batch in batches:
            yield pa.array([reader.score(t.as_py() or "") for t in batch], pa.float64())

    return scores(text)


def training_rows(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int,
                  id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, label, stands, text) of at most ``sample`` rows of each label, chosen by hash of the
    id; ``stands`` is the number of usable labels for each chosen one.

    The chosen ids are few by construction, so they are sent to the documents, not these to them.
    """
    usable = (labels.select(F.col(id_col).cast("long").alias("id"),
                            F.col(label_col).cast("int").alias("label"))
              .where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).where(allowed)
              .groupBy("id").agg(F.max("label").alias("label")))
    chosen = [usable.where(F.col("label") == label).orderBy(F.xxhash64("id"), "id").limit(sample)
              for label in (0, 1)]
    sizes = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    stands = [max(1.0, sizes.get(label, 0) / sample) for label in (0, 1)]
    ids = chosen[0].unionByName(chosen[1]).withColumn(
        "stands", F.when(F.col("label") == 1, stands[1]).otherwise(stands[0]))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.where(F.col("text").isNotNull()).join(F.broadcast(ids), "id")


def sketched(rows: DataFrame) -> DataFrame:
    """With two minimum hashes of five-word shingles, by which near copies tell themselves."""

    @F.arrow_udf("a long, b long")
    def sketch(texts: pa.Array) -> pa.Array:
        hashes, bounds = word_hashes([t.as_py() or "" for t in texts], lower=True)
        out = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            part = window_hashes(hashes[a:b], min(5, max(1, b - a)))
            out.append([int(mix(part ^ U(k)).min().view(np.int64)) if len(part) else 0
                        for k in (1, 2)])
        return pa.StructArray.from_arrays(
            [pa.array([o[k] for o in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.withColumn("sketch", sketch(F.col("text"))).select("*", "sketch.a", "sketch.b")


def learn_terms(rows: DataFrame, strength: float = 20.0, most: int = 20_000) -> Model:
    """Words and beginnings by their log-likelihood ratio with the label, over (label, text).

    Each task gives all its terms with both counts, as only their sums tell which are rare among
    clean rows; the rows are a bounded sample, so the terms are too."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())
        for batch in batches:
            for label, text in zip(batch.column(0), batch.column(1), strict=True):
                words = {t.strip(EDGE) for t in text.as_py().lower().split()}
                terms = {w[:n] + "*" for w in words for n in STEMS if n <= len(w)}
                counts[label.as_py()].update(terms | words)
        terms = list(counts[0] | counts[1])
        for first in range(0, len(terms), TERMS):
            part = terms[first:first + TERMS]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part), *(pa.array([counts[label][t] for t in part], pa.int64())
                                   for label in (1, 0))], ["term", "bad", "good"])

    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    bad_docs, good_docs = sizes.get(1, 0), sizes.get(0, 0)
    if not bad_docs or not good_docs:
        return Model()
    seen = F.col("bad") + F.col("good")
    rate = F.lit(bad_docs / (bad_docs + good_docs))
    part = lambda n, p: F.when(n > 0, n * F.log(n / (seen * p))).otherwise(0.0)
    ratio = 2 * (part(F.col("bad"), rate) + part(F.col("good"), 1 - rate))
    found = (rows.select("label", "text").mapInArrow(counted, "term string, bad long, good long")
             .groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
             .where((F.length("term") > 1) & (F.col("bad") > seen * rate)).withColumn("ratio", ratio)
             .where(F.col("ratio") > strength).orderBy(F.desc("ratio"), "term").limit(most)).collect()
    stems = {r.term[:-1]: r.bad for r in found if r.term[-1] == "*"}
    model = Model()
    alone = {r.term[:n] for r in found if r.term[-1] != "*" for n in STEMS
             for s in (stems.get(r.term[:n]),) if s and r.bad >= 0.7 * s}
    longer = {s[:-1] for s, n in stems.items() if n >= 0.9 * stems.get(s[:-1], math.inf)}
    dull = alone | longer
    for r in found:
        if r.term[-1] == "*" and r.term[:-1] in dull:
            continue  # a beginning that is little more than one word or one longer beginning
        odds = math.log((r.bad + 0.5) / (bad_docs + 1)) - math.log((r.good + 0.5) / (good_docs + 1))
        if odds > 2:
            place, term = (model.stems, r.term[:-1]) if r.term[-1] == "*" else (model.words, r.term)
            place[term] = min(odds, 8.0)
    return model


def fit(docs: DataFrame, labels: DataFrame, allowed: Column, sample: int = SAMPLE,
        id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labels for which ``allowed``, a condition on the column ``id``, holds.

    Terms come from two thirds of the sample and the regression from the rest, so that terms
    that fit their own documents by chance don't count for more than they are worth."""
    rows = sketched(training_rows(docs, labels, allowed, sample, id_col, text_col, label_col)) \
        .dropDuplicates(["a"]).dropDuplicates(["b"]).persist()
    half = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(3)) < 2
    model = learn_terms(rows.where(half))

    @F.arrow_udf("array<double>")
    def featured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = Reader(model)
        for batch in batches:
            yield pa.array([reader.features(t.as_py()) for t in batch], pa.list_(pa.float64()))

    points = rows.where(~half).select(
        "label", "stands", featured(F.col("text")).alias("x")).orderBy("id").collect()
    rows.unpersist()
    if len({p.label for p in points}) == 2:
        x = np.array([p.x for p in points])
        model.bias, model.weights = logistic(x, np.array([p.label for p in points]),
                                             np.array([p.stands for p in points]))
    return model


def logistic(x: np.ndarray, y: np.ndarray, stands: np.ndarray, penalty: float = 0.3,
             rounds: int = 50) -> tuple[float, tuple[float, ...]]:
    """Logistic regression by Newton's method with a quadratic penalty; rows weigh in proportion
    to ``stands`` and as much as their number together, kinds of match can't lower a score."""
    stands = stands / stands.mean()
    x = np.column_stack([np.ones(len(x)), x])
    free, w = np.ones(x.shape[1], dtype=bool), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (stands * (y - p)) - penalty * w * (np.arange(len(w)) > 0)
        curve = (x * (stands * p * (1 - p))[:, None]).T @ x + np.eye(len(w)) * penalty
        step = np.zeros(len(w))
        step[free] = np.linalg.solve(curve[np.ix_(free, free)], slope[free])
        w = w + step
        low = np.zeros(len(w), dtype=bool)
        low[1:-1] = w[1:-1] < 0
        w[low] = 0.0
        free &= ~low
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), tuple(map(float, w[1:]))


def scored(docs: DataFrame, model: Model, text_col: str = "text",
           score_col: str = "toxicity") -> DataFrame:
    """``docs`` with a score beside all their columns."""
    return docs.withColumn(score_col, score(F.col(text_col), model))
