"""Toxicity by a weighted finite-state pattern grammar.

Words are read as symbols - insult, threat, target, negation, reported speech, other - and small
transducers, each with a finite memory, give each symbol a factor: an insult counts as it stands, a
threat only where a target is before or after it, a target nearby makes an insult heavier, a negation
just before or reported speech before or after it in the clause make both lighter. Their composition
runs over a clause from the left and from the right, and scores it; a document's score is a logistic
function of its clause scores. The insult stems, their weights and the logistic function are learned
from labelled rows; the function words of the grammar are fixed.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize

#: Labelled documents that the lexicon and the logistic function are fitted on, taken in the order of a hash of their ids.
TRAIN_DOCS = 16_384
#: Stems that a task counts at once.
COUNTED = 100_000
#: Log likelihood ratio that a stem must reach: that of the best of a million, and one more.
SURPRISE = math.log(1e6) + 1
#: Folds of crc32(doc_id as text); fold HELD_OUT is never learned from.
FOLDS, HELD_OUT = 5, 0
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)

#: Function words of the grammar, in English, German, French and Spanish.
WORDS = {
    THREAT: "kill hurt destroy attack beat burn shoot stab töten verletzen zerstören schlagen tuer blesser détruire frapper matar herir destruir golpear",
    TARGET: "you your yours yourself they them their he him she her du dich dir dein ihr euch sie tu toi te vous votre ton ils elles tú ti usted ustedes vosotros ellos ellas",
    NEGATION: "not no never neither nor isn't aren't wasn't don't nicht kein keine nie niemals ne pas jamais aucun nunca jamás ningún",
    REPORT: "said says say told called claimed wrote quote quoted sagte sagt sagen nannte behauptete dit disait appelé écrit dijo dice llamó escribió",
}
SYMBOL = {w: kind for kind, words in WORDS.items() for w in words.split()}
#: Endings that a threat's base form may have, after a doubled last letter or not.
ENDINGS = "s es ed d ing er ers t st e en est et ez é ée és n an a as".split()
THREATS = frozenset(WORDS[THREAT].split())
THREAT_WEIGHT = 2.0
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
CLAUSE_END = re.compile(r"[.!?;:\n]")


@dataclass(frozen=True)
class Transducer:
    """Reads symbols; `step` maps (state, symbol) to (next state, factor of the symbol's weight)."""

    start: object
    step: Callable

    def __matmul__(self, other: Transducer) -> Transducer:
        """Composition: both read the same symbols, and their factors multiply."""

        @lru_cache(maxsize=65536)
        def step(state, symbol):
            (a, x), (b, y) = self.step(state[0], symbol), other.step(state[1], symbol)
            return (a, b), x * y

        return Transducer((self.start, other.start), step)


def near(trigger: int, span: int, affected: tuple[int, ...], factor: float, otherwise: float = 1.0) -> Transducer:
    """Multiplies the affected symbols by `factor` within `span` symbols after a trigger, else by `otherwise`."""

    def step(left: int, symbol: int):
        if symbol == trigger:
            return span, 1.0
        return max(0, left - 1), (factor if left else otherwise) if symbol in affected else 1.0

    return Transducer(0, step)


#: To the clause's end (no clause is that long without losing it).
FAR = 1 << 20
#: Weighs what it reads: insults and threats count, all else does not.
INSULTS = Transducer(0, lambda state, symbol: (state, 1.0 if symbol in (INSULT, THREAT) else 0.0))
AIMED, DENIED, REPORTED = near(TARGET, 4, (INSULT,), 1.5), near(NEGATION, 2, (INSULT, THREAT), 0.3), near(REPORT, FAR, (INSULT, THREAT), 0.5)
#: Read from the left and from the right; their factors multiply.
GRAMMAR, BACKWARD = INSULTS @ AIMED @ DENIED @ REPORTED, AIMED @ REPORTED
#: A threat needs a target on either side: the larger of both readings counts.
THREATENED = near(TARGET, FAR, (THREAT,), 1.0, 0.0)


def run(machine: Transducer, symbols: list[int]) -> list[float]:
    """The factor of each symbol."""
    state, out = machine.start, []
    for symbol in symbols:
        state, factor = machine.step(state, symbol)
        out.append(factor)
    return out


@lru_cache(maxsize=65536)
def is_threat(word: str) -> bool:
    """Whether a word is a threat's base form, with an ending or without."""
    if word in THREATS:
        return True
    for end in ENDINGS:
        if word.endswith(end):
            base = word[: len(word) - len(end)]
            if base in THREATS or len(base) > 3 and base[-1] == base[-2] and base[:-1] in THREATS:
                return True
    return False


@dataclass
class Model:
    """Stems (a trailing $ marks a whole word) with weights; the logistic function of a document."""

    stems: dict[str, float] = field(default_factory=dict)
    bias: float = -6.0
    slope: float = 2.0

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for stem, weight in self.stems.items():
            found.add_word(stem.rstrip("$"), (stem, weight))
        for word, kind in SYMBOL.items():
            if kind == THREAT and word not in found:
                found.add_word(word, (word + "$", 0.0))
        found.make_automaton()
        return found


class Scorer:
    def __init__(self, model: Model):
        self.model, self.found = model, model.automaton()
        self.stems = model.stems
        self.sizes = sorted({len(s.rstrip("$")) for s in model.stems}, reverse=True)

    def weight(self, word: str) -> float:
        """The weight of the longest stem that begins the word, 0 if none does."""
        whole = self.stems.get(word + "$")
        if whole is not None:
            return whole
        return next((self.stems[word[:n]] for n in self.sizes if n <= len(word) and word[:n] in self.stems), 0.0)

    def clause(self, text: str) -> float:
        """Total weight of a clause's symbols after the grammar's factors."""
        words = WORD.findall(text)
        weights = [self.weight(w) for w in words]
        symbols = [INSULT if x else SYMBOL.get(w, THREAT if is_threat(w) else OTHER) for w, x in zip(words, weights)]
        if INSULT not in symbols and not (THREAT in symbols and TARGET in symbols):
            return 0.0
        forward, backward = run(GRAMMAR, symbols), run(BACKWARD, symbols[::-1])[::-1]
        aimed = list(map(max, run(THREATENED, symbols), run(THREATENED, symbols[::-1])[::-1]))
        return sum((x or THREAT_WEIGHT) * f * b * t for x, f, b, t in zip(weights, forward, backward, aimed) if f)

    def raw(self, text: str) -> float:
        """Sum of a text's clause scores. Only clauses where the automaton finds something are read, each once."""
        text, end, total = text.lower(), -1, 0.0
        for at, (stem, _) in self.found.iter(text):
            if at <= end:
                continue
            begin = at - len(stem.rstrip("$"))
            if begin >= 0 and text[begin].isalnum():
                continue
            start = max(end, *(text.rfind(c, end + 1, at) for c in ".!?;:\n")) + 1
            stop = CLAUSE_END.search(text, at)
            end = stop.start() if stop else len(text)
            total += self.clause(text[start:end])
        return total

    def score(self, text: str | None) -> float:
        x = self.model.bias + self.model.slope * math.log1p(self.raw(text or ""))
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def surprise(toxic: int, other: int, base: float) -> float:
    """Log likelihood ratio of a stem's counts against the share `base` of toxic documents."""
    n = toxic + other
    return sum(k * math.log(k / (n * p)) for k, p in ((toxic, base), (other, 1 - base)) if k) if 0 < base < 1 else 0.0


def held_out(doc_id: str | object):
    """The fold test as a column."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _stem_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(stem, toxic documents, other documents): words and prefixes of 4 to 7 letters, once a document.
    Counts are partial: they are given away whenever COUNTED stems are held."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def give() -> pa.RecordBatch:
        names = list(counts[0].keys() | counts[1].keys())
        columns = [pa.array(names, pa.string()), *(pa.array([c[s] for s in names], pa.int64()) for c in (counts[1], counts[0]))]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(columns, ["stem", "toxic", "other"])

    for batch in batches:
        for row in range(batch.num_rows):
            words = set(WORD.findall((batch.column(0)[row].as_py() or "").lower()))
            stems = {w + "$" for w in words}
            for n in (4, 5, 6, 7):
                stems.update(w[:n] for w in words if len(w) >= n)
            counts[1 if batch.column(1)[row].as_py() else 0].update(stems)
            if sum(map(len, counts)) >= COUNTED:
                yield give()
    yield give()


def _contexts(stems: frozenset[str]):
    sizes = sorted({len(s) for s in stems if not s.endswith("$")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = set()
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = WORD.findall((text or "").lower())
                for i, w in enumerate(words):
                    around = None
                    for s in (w + "$", *(w[:n] for n in sizes if n <= len(w))):
                        if s in stems:
                            around = around or " ".join([*words[max(0, i - 2) : i], "_", *words[i + 1 : i + 3]])
                            rows.add((s, bool(toxic), around))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], ["stem", "toxic", "around"])

    return run


def _raw_scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([scorer.raw(t or "") for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], ["raw", "toxic"])

    return run


def train(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits the lexicon and the logistic function on at most `train_docs` labelled documents that are
    not held out. Null labels and ids are left out; of contradicting labels the larger holds.

    A stem enters if it is at least 20 times as frequent among toxic documents as among others and if
    its count there would surprise even as the best of a million stems. It counts at most once for
    each context it is seen in: words that copies of one text share are seen in one context only.
    Without labels the lexicon is empty and scores say nothing but the prior.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null")
    known = known.where(F.crc32(F.col("id").cast("string")) % FOLDS != HELD_OUT).groupBy("id").agg(F.max("toxic").alias("toxic"))
    chosen = materialize(known.orderBy(F.xxhash64("id"), "id").limit(train_docs), "labels")  # at most train_docs rows: small enough to broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    sample = materialize(texts.join(F.broadcast(chosen), texts["doc"] == chosen["id"]).select("text", "toxic"), "sample")
    size = {bool(r["toxic"]): r["count"] for r in sample.groupBy((F.col("toxic") > 0).alias("toxic")).count().collect()}
    n1, n0 = size.get(True, 0), size.get(False, 0)
    if not n1:
        return Model()
    counts = sample.mapInArrow(_stem_counts, "stem string, toxic long, other long").groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1)) - F.log((F.col("other") + 0.5) / (n0 + 1))
    base, n = n1 / (n1 + n0), F.col("toxic") + F.col("other")
    part = lambda k, p: F.when(k > 0, k * F.log(k / (n * p))).otherwise(0.0)
    surprising = part(F.col("toxic"), base) + part(F.col("other"), 1 - base) >= SURPRISE if n0 else F.lit(False)
    # what passes is bounded by the words of train_docs documents
    top = counts.withColumn("odds", odds).where("toxic >= 3 and odds >= ln(20)").where(surprising).collect()
    seen = sample.mapInArrow(_contexts(frozenset(r["stem"] for r in top)), "stem string, toxic boolean, around string").where("toxic").distinct().groupBy("stem").count()
    contexts = {r["stem"]: r["count"] for r in seen.where(F.col("count") > 1).collect()}  # no more rows than top
    stems = {r["stem"]: r["odds"] for r in top if surprise(min(r["toxic"], contexts.get(r["stem"], 0)), r["other"], base) >= SURPRISE}
    model = Model(stems)
    rows = sample.mapInArrow(_raw_scores(model), "raw double, toxic int").collect()  # at most train_docs pairs of numbers
    x, y = np.log1p([r["raw"] for r in rows]), np.array([r["toxic"] > 0 for r in rows], float)
    model.bias, model.slope = logistic(x, y)
    return model


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, float]:
    """Bias and slope by Newton's method with a small ridge, which keeps separable data finite."""
    a, w = np.stack([np.ones_like(x), x], axis=1), np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + ridge * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), grad)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0]), float(max(w[1], 0.0))


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([scorer.score(t) for t in batch.column(2).to_pylist()], pa.float64())], ["doc_id", "held_out", "score"])

    return run


def score_documents(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score in 0 to 1, predicted.

    The score depends on the text alone; null texts score as empty ones (nothing found). held_out is
    false for a null id. Repeated rows are scored each; an empty table gives an empty result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", held_out("doc_id").alias("held_out"), "text")
    out = rows.mapInArrow(_scores(model), "doc_id long, held_out boolean, score double")
    return out.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def _clean(model: Model, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t) < 0.5 for t in batch.column(at).to_pylist()], pa.bool_()))

    return run


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs without the rows that score 0.5 or more, all columns as they are, whatever their names and
    types. Null and empty texts score as texts in which nothing is found; rows with a null or repeated
    id are judged each by its text; an empty table stays empty."""
    return docs.mapInArrow(_clean(model, docs.columns.index(text_col)), docs.schema)
