"""Toxicity by a weighted finite-state pattern grammar.

A clause is read as a sequence of tokens, each with its class (insult, threat,
intent, intensifier, target, negation, reporting, quote).  Five small transducers
with weighted arcs over classes and words each mark what they recognise: insults
(alone, intensified, in rows, and phrases of several words), threats (a verb of
harm with an intent before it or a target behind it, and phrases), an insult or
threat aimed at a target, one near a negation, one inside reported speech or a
quotation.  ``compose`` runs them as one machine over product states, so a clause
is read once, and what gets a score is the matched clause, not a word by itself.

The insult class' words and stems carry weights that are learned from a bounded
sample of labelled rows (``max_rows``): a stem covers every word that starts with
it, a longer match overrides a shorter one.  Among the candidates those are kept
that go on explaining toxic rows after the stronger ones have been counted, so
words that merely occur in copies of one toxic text drop out.  A logistic model
on the clause features, fitted on the same sample, gives the probability.

Scale: labels are cut to the sample before they meet the documents; the sample's
ids (``max_rows`` of 8 bytes) are the only broadcast; scoring is one narrow pass
over the documents without a shuffle.

Nulls and odd rows: a null or empty text scores as a text without clauses; rows
without a label or id are not learned from; of repeated labels the larger
counts, of texts that repeat an id the least; with labels of one kind only, the score is that kind's share.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagloom.llm import common as C

# Closed word classes of four languages.
NEGATION = frozenset("not never no nor without isn't aren't wasn't don't doesn't nicht kein keine nie ohne pas jamais sans aucun nunca jamás sin ningún".split())
REPORTING = frozenset("said says say wrote writes called calls quoted claimed reported sagte sagt schrieb nannte berichtete dit disait écrit cita dijo dice escribió llamó citó".split())
TARGET = frozenset("you your yours yourself they them their he she him her dich dir du euch ihr vous tu toi votre ton usted ustedes tú tu ellos".split())
THREAT = frozenset("kill hurt destroy beat burn shoot stab hang die töten umbringen schlagen tuer frapper brûler matar golpear quemar".split())
INTENT = frozenset("will gonna shall going ll must should werde werden wirst soll vais vas va allons voy vamos debo".split())
INTENSIFIER = frozenset("total complete utter absolute fucking bloody damn such real völliger totaler verdammter sale gros espèce maldito puto".split())
QUOTES = frozenset('"“”«»')
INSULT_PHRASES = {"shut up": 2.0, "go to hell": 3.0, "piece of trash": 3.0, "waste of space": 3.0, "halt die klappe": 3.0, "fahr zur hölle": 3.0, "ferme ta gueule": 3.0, "va te faire voir": 3.0, "vete al infierno": 3.0, "cállate la boca": 3.0}
THREAT_PHRASES = {"drop dead": 2.0, "watch your back": 3.0, "i know where you live": 4.0, "you will regret this": 3.0, "das wirst du bereuen": 3.0, "tu vas le regretter": 3.0, "te vas a arrepentir": 3.0}
INSULT_, THREAT_, INTENT_, INTENSIFIER_, TARGET_, NEGATION_, REPORTING_, QUOTE_, OTHER_ = "insult", "threat", "intent", "intensifier", "target", "negation", "reporting", "quote", "other"

_CLAUSE = re.compile(r"[.!?;:\n]+")
_TOKEN = re.compile(r"[^\W_]+(?:'[^\W_]+)?|[\"“”«»]")
STEM_LENGTHS = (4, 5, 6, 7, 8)
FEATURES = ("clauses", "insult", "negated", "reported", "aimed", "threat", "best")


@dataclass(frozen=True)
class Transducer:
    """``step[state, symbol] = (state, mark, weight)``; a symbol is a word or else its class; a missing arc keeps the state (or takes its default) and marks nothing."""

    start: object
    step: dict[tuple, tuple[object, str, float]]
    default: dict = field(default_factory=dict)

    def read(self, state, kind: str, word: str = "") -> tuple[object, str, float]:
        return self.step.get((state, word)) or self.step.get((state, kind)) or (self.default.get(state, state), "", 0.0)


def phrases(weights: dict[str, float], mark: str) -> Transducer:
    """Marks the last word of each phrase: a trie whose states are the words read so far, with a way back to the longest end that is a beginning."""
    known = {tuple(p.split()): w for p, w in weights.items()}
    heads = {p[:n] for p in known for n in range(len(p) + 1)}
    words = {w for p in known for w in p}
    step = {}
    for h in heads:
        for w in words:
            read = (*h, w)
            ends = [read[k:] for k in range(len(read) + 1)]
            hit = max((known[e] for e in ends if e in known), default=0.0)
            step[h, w] = (next(e for e in ends if e in heads), mark if hit else "", hit)
    return Transducer((), step, dict.fromkeys(heads, ()))


def insult() -> Transducer:
    """Marks insults; one behind an intensifier or behind another insult weighs more. States: none, intensifier, insult."""
    step = {(s, INTENSIFIER_): (1, "", 0.0) for s in range(3)} | {(s, INSULT_): (2, "insult", w) for s, w in ((0, 1.0), (1, 1.5), (2, 1.25))}
    return Transducer(0, step, {1: 0, 2: 0})


def threat(reach: int = 3) -> Transducer:
    """Marks a verb of harm behind an intent, and a target at most ``reach`` tokens behind such a verb. States: none, intent, and tokens left behind a verb."""
    verb = [f"verb {k}" for k in range(reach)]
    step = {(s, INTENT_): ("intent", "", 0.0) for s in ("none", "intent", *verb)} | {(s, THREAT_): (verb[0], "", 0.0) for s in ("none", *verb)}
    step["intent", THREAT_] = (verb[0], "threat", 1.0)
    step |= {(v, TARGET_): ("none", "threat", 1.0) for v in verb}
    return Transducer("none", step, dict(zip(verb, [*verb[1:], "none"], strict=True)))


def negation(reach: int = 3) -> Transducer:
    """Marks an insult or threat at most ``reach`` tokens after a negation."""
    step = {(s, NEGATION_): (reach, "", 0.0) for s in range(reach + 1)}
    step |= {(s, k): (s - 1, "negated", 1.0) for s in range(1, reach + 1) for k in (INSULT_, THREAT_)}
    return Transducer(0, step, {s: s - 1 for s in range(1, reach + 1)})


def reported_speech() -> Transducer:
    """Marks what follows a reporting verb in its clause, or stands in quotes. States: plain, reported, quoted."""
    step = {(0, REPORTING_): (1, "", 0.0), (0, QUOTE_): (2, "", 0.0), (1, QUOTE_): (2, "", 0.0), (2, QUOTE_): (0, "", 0.0)}
    step |= {(s, k): (s, "reported", 1.0) for s in (1, 2) for k in (INSULT_, THREAT_)}
    return Transducer(0, step)


def target() -> Transducer:
    """Marks an insult or threat after a target, and a target right after an insult. States: none, seen, insult seen."""
    step = {(0, TARGET_): (1, "", 0.0), (0, INSULT_): (2, "", 0.0), (2, TARGET_): (1, "aimed", 1.0), (2, INSULT_): (2, "", 0.0)}
    step |= {(1, k): (1, "aimed", 1.0) for k in (INSULT_, THREAT_)}
    return Transducer(0, step)


def compose(*parts: Transducer):
    """The product machine, built state by state as it is needed: (state, class, word) -> (state, marks with their weights)."""
    start = tuple(p.start for p in parts)
    words = {x for p in parts for _, x in p.step}
    table: dict[tuple, tuple] = {}

    def read(state: tuple, kind: str, word: str = "") -> tuple:
        key = (state, kind, word if word in words else "")
        if (out := table.get(key)) is None:
            each = [p.read(s, kind, key[2]) for p, s in zip(parts, state, strict=True)]
            marks: dict[str, float] = {}
            for _, mark, weight in each:
                if mark:
                    marks[mark] = marks.get(mark, 0.0) + weight
            out = table[key] = (tuple(e[0] for e in each), marks)
        return out

    return start, read


def parts() -> tuple[Transducer, ...]:
    """The grammar's transducers: insults, threats, targets, negations, reported speech, and the phrases of the first two."""
    return insult(), threat(), target(), negation(), reported_speech(), phrases(INSULT_PHRASES, "insult phrase"), phrases(THREAT_PHRASES, "threat phrase")


CLASSES = ((THREAT_, THREAT), (NEGATION_, NEGATION), (REPORTING_, REPORTING), (TARGET_, TARGET), (INTENT_, INTENT), (INTENSIFIER_, INTENSIFIER), (QUOTE_, QUOTES))
#: words that can end a phrase start a match by themselves
_HOT = frozenset(p.split()[-1] for p in (*INSULT_PHRASES, *THREAT_PHRASES))


class Grammar:
    """Token classes with weights, and the composed machine over them."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.start, self.read = compose(*parts())
        self.known: dict[str, tuple[str, float, str]] = {}

    def classify(self, word: str) -> tuple[str, float, str]:
        weight = self.lexicon.get(f"{word}$")
        for n in reversed(STEM_LENGTHS):  # the longest known stem
            if weight is None and len(word) >= n:
                weight = self.lexicon.get(word[:n])
        if weight is not None:
            return (INSULT_, weight, word)
        for kind, words in CLASSES:
            if word in words:
                return (kind, 1.0, word)
        return (OTHER_, 0.0, word)

    def clause(self, tokens: list[tuple[str, float, str]]) -> dict[str, float]:
        """What a clause holds: insults and threats by where they stand, and how much of that is aimed at someone."""
        state, out, place = self.start, dict.fromkeys(FEATURES[1:6], 0.0), ""
        for kind, weight, word in tokens:
            state, marks = self.read(state, kind, word)
            if kind in (INSULT_, THREAT_):
                place = "negated" if "negated" in marks else "reported" if "reported" in marks else ""
            amount = weight * marks["insult"] if "insult" in marks else 0.0
            amount, harm = amount + marks.get("insult phrase", 0.0), marks.get("threat", 0.0) + marks.get("threat phrase", 0.0)
            out[place or "insult"] += amount
            out[place or "threat"] += harm
            if "aimed" in marks:
                out["aimed"] += amount or (weight if kind == INSULT_ else 1.0)
        return out

    def features(self, text: str | None) -> list[float]:
        """Of a whole text: how many clauses match, the sums of what they hold, and the best clause."""
        known, total, clauses, best = self.known, np.zeros(5), 0, 0.0
        if len(known) > 1_000_000:
            known.clear()
        for part in _CLAUSE.split((text or "").lower()):
            tokens, hot = [], False
            for w in _TOKEN.findall(part):
                try:
                    k = known[w]
                except KeyError:
                    k = known[w] = self.classify(w)
                tokens.append(k)
                hot = hot or k[0] == INSULT_ or k[0] == THREAT_ or w in _HOT
            if hot:
                row = self.clause(tokens)
                if any(row.values()):
                    clauses += 1
                    total += list(row.values())
                    best = max(best, row["insult"] + 0.5 * row["aimed"] + row["threat"])
        return [np.log1p(clauses), *np.log1p(total).tolist(), np.log1p(best)]


def units(text: str | None) -> set[str]:
    """The words (closed by ``$``) and stems of a text, each once."""
    out = set()
    for w in set(_TOKEN.findall((text or "").lower())):
        out.add(f"{w}$")
        out.update(w[:n] for n in STEM_LENGTHS if len(w) >= n)
    return out


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(C.text_crc(id_col), F.lit(5)) == 0, F.lit(False))


def sample_of(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """At most ``max_rows`` labelled ids, the same at every run."""
    ids = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
    ids = ids.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).cast("int").alias("label"))
    return ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def candidates(rows: DataFrame, min_rows: int, min_log_odds: float) -> dict[str, float]:
    """Words and stems of the sampled rows with the log odds of toxic against other rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, label in zip(b.column("text").to_pylist(), b.column("label").to_pylist(), strict=True):
                seen[label > 0].update(units(text))
                seen[label > 0][""] += 1
        names = list(seen[0].keys() | seen[1].keys())
        for lo in range(0, len(names), 50_000):
            part = names[lo : lo + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *(pa.array([s[n] for n in part], pa.int64()) for s in seen[::-1])], ["unit", "pos", "neg"])

    counted = rows.mapInArrow(count, "unit string, pos long, neg long").groupBy("unit").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    # units of at most max_rows rows
    got = counted.where((F.col("pos") >= min_rows) & ((F.col("unit") == "") | (F.col("pos") > 5 * F.col("neg")))).collect()
    total = next(((r.pos, r.neg) for r in got if r.unit == ""), (0, 0))
    odds = {r.unit: float(np.log((r.pos + 0.5) / (total[0] + 1)) - np.log((r.neg + 0.5) / (total[1] + 1))) for r in got if r.unit}
    return {u: w for u, w in odds.items() if w >= min_log_odds}


def lasting(rows: list[tuple[int, list[str]]], odds: dict[str, float], min_gain: float) -> dict[str, float]:
    """Greedy cover: a unit's gain is the toxic rows that hold it, each halved for every chosen unit that it holds already."""
    holders: dict[str, list[int]] = {}
    for i, (label, found) in enumerate(rows):
        if label > 0:
            for u in found:
                holders.setdefault(u, []).append(i)
    share, chosen = np.ones(len(rows)), {}
    left = {u: np.array(r) for u, r in holders.items()}
    # gains only shrink, so a stale one is an upper bound
    heap = [(-float(len(r)), u) for u, r in left.items()]
    heapq.heapify(heap)
    while heap and -heap[0][0] >= min_gain:
        _, unit = heapq.heappop(heap)
        gain = float(share[left[unit]].sum())
        if heap and (-gain, unit) > heap[0]:
            heapq.heappush(heap, (-gain, unit))
        elif gain >= min_gain:
            chosen[unit] = odds[unit]
            share[left[unit]] *= 0.5
    return chosen


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 40) -> np.ndarray:
    """Newton's method; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w, keep = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-6])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + keep, x.T @ (p - y) + keep @ w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class Model:
    lexicon: dict[str, float]
    weights: list[float]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 20_000, min_rows: int = 4, min_log_odds: float = 3.0, min_gain: float = 3.0) -> Model:
    """``max_rows`` bounds the labelled rows that are learned from, and so all that is collected."""
    C.importable(docs)
    ids = sample_of(labels, id_col, label_col, max_rows)
    # proven bound: max_rows ids of 12 bytes; texts that repeat an id are learned from once for each id
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(ids), "doc_id")
    rows = C.checkpoint(known.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("text", "label"))
    odds = candidates(rows, min_rows, min_log_odds)

    def matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(units(t) & odds.keys()) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(found, pa.list_(pa.string()))], ["label", "found"])

    # at most max_rows rows of short strings
    got = [(r.label, r.found) for r in rows.where("label > 0").mapInArrow(matched, "label int, found array<string>").collect()]
    lexicon = lasting(got, odds, min_gain)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = Grammar(lexicon)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([grammar.features(t) for t in b.column("text").to_pylist()], pa.list_(pa.float64()))], ["label", "x"])

    points = rows.mapInArrow(measure, "label int, x array<double>").collect()
    y = np.array([r.label > 0 for r in points], float)
    x = np.array([r.x for r in points]).reshape(len(points), len(FEATURES))
    weights = logistic(x, y) if len(set(y.tolist())) == 2 else np.append(np.zeros(len(FEATURES)), 30.0 * (2 * (y.mean() if len(y) else 0) - 1))
    return Model(lexicon, weights.tolist())


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, matched clauses' features`` of every text."""
    C.importable(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, w = Grammar(model.lexicon), np.array(model.weights)
        for b in batches:
            x = np.array([grammar.features(t) for t in b.column(1).to_pylist()]).reshape(-1, len(FEATURES))
            p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array(list(x), pa.list_(pa.float64()))], [id_col, "score", "features"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, score double, features array<double>")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.read(spark, sf_dir, "documents")
    model = fit(docs, C.read(spark, sf_dir, "labels"))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op1_toxicity": op1_toxicity}
ORACLES: dict[str, str] = {}
