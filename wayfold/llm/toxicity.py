"""Toxicity: a weighted finite-state grammar over clauses.

Words become labels: learned insult entries (I), threats (T), targets (G), negations (N), verbs of
reported speech (R), intentions (F), quotation marks (Q), anything else (W).  Four small deterministic
transducers rewrite a clause's labels, each with the words that came before as its state: negation
turns an insult after a negation into ``i``, reported speech turns it into ``r``, a target beside it
turns it into ``J``, and intention + threat + target gives ``H``.  ``compose`` joins them into one
machine.  A document's score is a logistic sum over the weights its matched clauses gather by label.

The insult transducer's entries, whole words or word beginnings, and their weights are learned: from a
sample of at most ``SAMPLE_ROWS`` labelled training rows of either class, by the likelihood ratio of how
many toxic and clean texts hold them.  So are the weights of the output labels.  Scoring reads only
text, whole, clause by clause around matches of one automaton.

Null and empty texts, and texts without a match, get the score of no match.  Without any labelled
row the fixed entries below are used with weight ``PRIOR_WEIGHT``.  Rows are judged one by one, so
repeated rows have equal results; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, cut, remainder

SAMPLE_ROWS = 3000
MAX_ENTRIES = 2000
PREFIXES = range(4, 10)
PRIOR_WEIGHT = 3.0

#: Closed word classes, small and general; what insults is learned.
INSULT = ["idiot", "moron", "stupid", "scum", "pathetic", "worthless"]
THREAT = ["kill", "hurt", "destroy", "beat", "töten", "schlagen", "tuer", "frapper", "matar", "golpear"]
TARGET = ["you", "your", "he", "she", "they", "him", "her", "them", "du", "dich", "ihr", "euch", "tu", "toi", "vous", "te", "usted", "ellos"]
NEGATION = ["not", "no", "never", "isn't", "aren't", "nicht", "kein", "nie", "pas", "jamais", "nunca", "ni"]
REPORT = ["said", "says", "called", "calls", "wrote", "quoted", "sagte", "nannte", "dit", "appelé", "dijo", "llamó"]
INTENT = ["will", "gonna", "shall", "going", "werde", "vais", "voy"]
LABELS = {w: k for k, words in (("T", THREAT), ("G", TARGET), ("N", NEGATION), ("R", REPORT), ("F", INTENT)) for w in words}
#: Output labels that score, and their weights before fitting.
SCORED = ["I", "J", "i", "r", "H"]
PRIOR = np.array([1.0, 1.2, 0.4, 0.5, 1.0])

_clause_end = regex.compile(r"[.!?;:\n]")
_token = regex.compile(r"[\p{L}\p{M}\p{N}'’]+|[\"“”«»]")
_word = regex.compile(r"[\p{L}\p{M}\p{N}'’]+")


class Transducer:
    """A deterministic label transducer: step(state, label) -> (state, label)."""

    def __init__(self, start, step):
        self.start, self.step = start, step

    def compose(self, other: Transducer) -> Transducer:
        """The machine that feeds this one's output to ``other``."""

        def step(state, label):
            a, mid = self.step(state[0], label)
            b, out = other.step(state[1], mid)
            return (a, b), out

        return Transducer((self.start, other.start), step)

    def compiled(self, alphabet: str) -> dict:
        """All reachable (state, label) -> (state, label) arcs."""
        arcs, todo = {}, [self.start]
        while todo:
            state = todo.pop()
            for label in alphabet:
                if (state, label) not in arcs:
                    arcs[state, label] = nxt = self.step(state, label)
                    todo.append(nxt[0])
        return arcs


def _negate(s, x):
    return (3, x) if x == "N" else (s, "i") if x == "I" and s else (max(0, s - 1), x)


def _report(s, x):
    if x == "Q":
        return 1 - s, x
    return (1, x) if x == "R" else (s, "r") if x == "I" and s else (s, x)


def _target(s, x):
    return (3, x) if x == "G" else (s, "J") if x == "I" and s else (max(0, s - 1), x)


def _threat(s, x):
    """Intention, then a threat, then a target, with a word or two between."""
    if x == "F":
        return 3, x
    if x == "T" and 0 < s <= 3:
        return 13, x
    if x == "G" and s > 10:
        return 0, "H"
    return (0 if s in (0, 10) else s - 1), x


GRAMMAR = Transducer(0, _negate).compose(Transducer(0, _report)).compose(Transducer(0, _target)).compose(Transducer(0, _threat))
ARCS = GRAMMAR.compiled("ITGNRFQW")


class Matcher:
    """The grammar with a lexicon: entry -> weight; an entry that ends in ``*`` is a word beginning."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self.auto = ahocorasick.Automaton()
        for entry in [*lexicon, *THREAT]:
            self.auto.add_word(entry.removesuffix("*"), entry.removesuffix("*"))
        self.auto.make_automaton()

    def weight(self, word: str) -> float:
        best = self.lexicon.get(word, 0.0)
        for k in PREFIXES:
            if k > len(word):
                break
            best = max(best, self.lexicon.get(word[:k] + "*", 0.0))
        return best

    def features(self, text: str | None) -> np.ndarray:
        """Per scored label log(1 + the weights gathered over the text's clauses)."""
        total = np.zeros(len(SCORED))
        if not text:
            return total
        low, done = text.lower(), -1
        for end, entry in self.auto.iter(low):
            at = end - len(entry) + 1
            if at < done or at and low[at - 1].isalnum():
                continue
            # The clause around the match; a clause is read once, however many matches it holds.
            lo = at
            lo = max(done, max((low.rfind(c, 0 if done < 0 else done, at) for c in ".!?;:\n"), default=-1) + 1, 0)
            stop = _clause_end.search(low, at)
            done = stop.end() if stop else len(low)
            state = GRAMMAR.start
            for m in _token.finditer(low, lo, done):
                token = m.group()
                w = self.weight(token)
                label = "I" if w else LABELS.get(token) or ("Q" if token in "\"“”«»" else "W")
                state, out = ARCS[state, label]
                if out in SCORED:
                    total[SCORED.index(out)] += w or PRIOR_WEIGHT
        return np.log1p(total)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every word and word beginning the toxic and the clean texts of a batch that hold it."""
    for batch in batches:
        got = {0: Counter(), 1: Counter()}
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(_word.findall((text or "").lower()))
            got[label].update(words | {w[:k] + "*" for w in words for k in PREFIXES if k <= len(w)})
        terms = list(got[0].keys() | got[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array([got[1][t] for t in terms], pa.int64()), pa.array([got[0][t] for t in terms], pa.int64())], ["term", "pos", "neg"])


def learn_lexicon(sample: DataFrame) -> dict[str, float]:
    """Entries from a bounded labelled sample (text, label): those whose likelihood ratio a corpus
    of so many terms would not show by chance, the longest of equal ones, none inside another."""
    n = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    p, q = n.get(1, 0), n.get(0, 0)
    if not p or not q:
        return {}
    terms = sample.mapInArrow(_terms, "term string, pos bigint, neg bigint").groupBy("term").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    xlogx = lambda o, e: f"CASE WHEN {o} > 0 THEN {o} * ln({o} / ({e})) ELSE 0 END"
    all_ = f"(pos + neg) / {p + q}D"
    ratio = " + ".join([xlogx("pos", f"{p}D * {all_}"), xlogx("neg", f"{q}D * {all_}"), xlogx(f"({p} - pos)", f"{p}D * (1 - {all_})"), xlogx(f"({q} - neg)", f"{q}D * (1 - {all_})")])
    rows = terms.where(f"pos >= 3 AND pos * {q}D > 3 * neg * {p}D").withColumn("g", F.round(2 * F.expr(ratio), 9)).orderBy(F.desc("g"), F.desc(F.length(F.rtrim(F.col("term"), F.lit("*")))), F.col("term").endswith("*"), "term").limit(20 * MAX_ENTRIES).collect()
    least = 2 * math.log(max(2, 2000 * (p + q)))
    chosen: dict[str, float] = {}
    for r in rows:
        term = r["term"]
        stem = term.removesuffix("*")
        if r["g"] < least or len(chosen) >= MAX_ENTRIES:
            break
        if any(stem[:k] + "*" in chosen for k in PREFIXES) or (term.endswith("*") and any(c.startswith(stem) for c in chosen)):
            continue
        chosen[term] = math.log((r["pos"] + 0.1) / (p + 0.2)) - math.log((r["neg"] + 0.1) / (q + 0.2))
    return chosen


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Lexicon and label weights from labelled rows: ``docs`` (doc_id, text), ``labels`` (doc_id, toxic)."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    picked = None
    for label in (0, 1):
        own = bounded_sample(marked.where(F.col("label") == label), "doc_id", sample_rows)
        picked = own if picked is None else picked.unionByName(own)
    picked = picked.limit(2 * sample_rows)  # the bound the broadcast relies on
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "label")
    sample = cut(sample, "toxicity-sample")
    lexicon = learn_lexicon(sample) or dict.fromkeys(INSULT, PRIOR_WEIGHT)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(lexicon)
        for batch in batches:
            x = np.array([matcher.features(t) for t in batch.column(0).to_pylist()]).reshape(-1, len(SCORED))
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(x[:, k]) for k in range(len(SCORED))]], ["label", *[f"f{k}" for k in range(len(SCORED))]])

    rows = sample.mapInArrow(features, "label int, " + ", ".join(f"f{k} double" for k in range(len(SCORED)))).collect()
    weights, bias = PRIOR.copy(), -1.5
    if rows:
        data = np.array(sorted(tuple(r) for r in rows))
        x, y = data[:, 1:], data[:, 0]
        # Logistic regression by gradient descent, held near the prior weights and never negative:
        # a match must not speak for a clean text.
        for _ in range(400):
            p = 1 / (1 + np.exp(-(x @ weights + bias)))
            weights = np.maximum(0.05, weights - 0.5 * (x.T @ (p - y) / len(y) + 0.002 * (weights - PRIOR)))
            bias -= 0.5 * (p - y).mean()
    return {"lexicon": lexicon, "weights": weights.tolist(), "bias": float(bias)}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, score, and the matched weight per output label, for every row of ``docs`` (doc_id, text)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["plain", "targeted", "negated", "reported", "threats"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, weights = Matcher(model["lexicon"]), np.array(model["weights"])
        for batch in batches:
            x = np.array([matcher.features(t.as_py()) for t in batch.column(1)]).reshape(-1, len(SCORED))
            s = 1 / (1 + np.exp(-(x @ weights + model["bias"])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s), *[pa.array(x[:, k]) for k in range(len(SCORED))]], ["doc_id", "score", *names])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, " + ", ".join(f"{n} double" for n in names))


def training_labels(labels: DataFrame) -> DataFrame:
    """The contract's training labels: crc32 of the id modulo 5 is not 0."""
    return labels.where(remainder("doc_id", 5) != 0)
