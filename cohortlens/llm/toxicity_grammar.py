"""Toxicity by a weighted finite-state grammar over clauses.

Words become labels (insult, threat, target, negation, reporting verb, quote
mark, other); a clause is a string of labels. Transducers rewrite it in turn:

    negation   an insult or threat up to NEGATION_SPAN words after a negation
    reported   one after a reporting verb of the clause or between quote marks
    target     one with a target before or after it in the clause is aimed

They are composed into one table (``GRAMMAR``); running it on a clause gives how
often each kind (``KINDS``) occurs. A document's score is logistic in these
counts, each saturating: one weight for each kind, around prior weights in
which negated and reported matches count for little.

Insults are a seed list and what the labelled rows add: words and word
beginnings far more frequent among toxic documents (``learn_lexicon``). Both
fits use at most MAX_LABELLED labelled rows (smallest hash of doc_id), never held
out ones, and yield at most MAX_LEXICON entries and one weight for each kind.

Nulls and edges: a null, empty or wordless text has no clause and scores as
such a text does; null doc_ids are scored and never labelled; repeated rows are
scored one by one; a doc_id with several labels is toxic if any says so; with
no labels the priors and seeds stand; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from .common import arrow_map, held_out, materialize, smallest, texts

# word classes, in English, German, French and Spanish
INSULTS = """idiot moron loser scum trash clown fool dumb stupid pathetic worthless disgusting imbecile
dummkopf abschaum trottel imbécile crétin ordure idiota imbécil estúpido escoria""".split()
THREATS = """kill hurt destroy burn beat shoot stab strangle murder töten umbringen verprügeln
tuer frapper détruire matar golpear destruir""".split()
TARGETS = """you your yours yourself u ur they them du dich dir euch tu toi te vous tú ti usted ustedes vosotros""".split()
NEGATIONS = """not no never neither nor isn't aren't wasn't weren't don't doesn't didn't cannot can't won't
nicht kein keine keinen nie niemals ne pas jamais nunca jamás""".split()
REPORTS = """said says say called calls call wrote writes quoted reported claims claimed
sagte nannte schrieb behauptete dit disait appelé écrit dijo llamó escribió""".split()

NEGATION_SPAN = 3
KINDS = ("plain", "aimed", "threat", "negated", "reported")
PRIOR = np.array([-3.0, 7.0, 9.0, 8.0, 1.0, 1.0])  # bias, then KINDS
PRIOR_PRECISION = 0.5
SATURATION = 6
MAX_LABELLED = 50_000
MAX_LEXICON = 8_192
PREFIXES = (4, 5, 6)
LEAST_GAIN = 30.0  # log-likelihood ratio of a learnt entry
LEAST_ODDS = 2.0  # its log odds
SEED_ROWS = 3.0  # toxic rows that a seed word counts for
MEMO = 200_000
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|[.!?;:\n\"“”«»]")
_END = ".!?;:\n"
_QUOTE = '"“”«»'


@dataclass(frozen=True)
class Transducer:
    """Deterministic: ``arcs[state, label]`` is (next state, output label); the outputs may be several, or none."""

    start: object
    arcs: dict

    def __call__(self, labels: str) -> str:
        state, out = self.start, []
        for x in labels:
            state, y = self.arcs[state, x]
            out.append(y)
        return "".join(out)


def compose(first: Transducer, second: Transducer, alphabet: str) -> Transducer:
    """The transducer that writes what ``second`` writes on reading what ``first`` writes."""
    start = (first.start, second.start)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        a, b = state = todo.pop()
        for x in alphabet:
            to, middle = first.arcs[a, x]
            after, out = b, []
            for y in middle:
                after, z = second.arcs[after, y]
                out.append(z)
            arcs[state, x] = ((to, after), "".join(out))
            if (to, after) not in seen:
                seen.add((to, after))
                todo.append((to, after))
    return Transducer(start, arcs)


ALPHABET = "IHTNRQo"  # insult, threat, target, negation, reporting verb, quote mark, other


def _negation() -> Transducer:
    arcs = {}
    for left in range(NEGATION_SPAN + 1):
        for x in ALPHABET:
            if x == "N":
                arcs[left, x] = (NEGATION_SPAN, "")
            else:
                arcs[left, x] = (max(0, left - 1), "n" if left and x in "IH" else "" if x == "o" else x)
    return Transducer(0, arcs)


def _reported() -> Transducer:
    arcs = {}
    for said in (0, 1):
        for quoted in (0, 1):
            for x in "IHTRQn":
                arcs[(said, quoted), x] = {"R": ((1, quoted), ""), "Q": ((said, 1 - quoted), "")}.get(
                    x, ((said, quoted), "r" if x in "IH" and (said or quoted) else x))
    return Transducer((0, 0), arcs)


def _target() -> Transducer:
    """State: a target was seen; what waits for one. Outputs: p plain, a aimed, t threat, n, r."""
    arcs = {}
    for seen in (0, 1):
        for waits in ("", "I", "H", "IH"):
            for x in "IHTnr":
                if x == "T":
                    arcs[(seen, waits), x] = ((1, ""), waits.replace("I", "a").replace("H", "t"))
                elif x in "nr":
                    arcs[(seen, waits), x] = ((seen, waits), x)
                elif seen:
                    arcs[(seen, waits), x] = ((seen, waits), "a" if x == "I" else "t")
                else:
                    arcs[(seen, waits), x] = ((seen, "".join(k for k in "IH" if k in waits + x)), "p" if x == "I" else "")
    return Transducer((0, ""), arcs)


GRAMMAR = compose(compose(_negation(), _reported(), ALPHABET), _target(), ALPHABET)
_KIND = "patnr"


class Matcher:
    """Labels words by a lexicon of insults (words, and beginnings marked ^) and counts the kinds of a text."""

    def __init__(self, insults: frozenset[str]):
        self.insults = insults
        self.fixed = {w: x for words, x in ((THREATS, "H"), (TARGETS, "T"), (NEGATIONS, "N"), (REPORTS, "R")) for w in words}
        self.fixed |= dict.fromkeys(_END, ".") | dict.fromkeys(_QUOTE, "Q")
        self.words: dict[str, str] = {}
        self.clauses: dict[str, tuple[int, ...]] = {}

    def label(self, word: str) -> str:
        if word in self.insults or any("^" + word[:n] in self.insults for n in PREFIXES if len(word) > n):
            return "I"
        return self.fixed.get(word) or self.fixed.get(word.replace("’", "'"), "o")

    def labels(self, words: list[str]) -> str:
        if len(self.words) > MEMO:
            self.words = {}
        memo = self.words
        for w in set(words):
            if w not in memo:
                memo[w] = self.label(w)
        return "".join(map(memo.__getitem__, words))

    def clause(self, labels: str) -> tuple[int, ...]:
        if (found := self.clauses.get(labels)) is None:
            out = GRAMMAR(labels)
            found = tuple(map(out.count, _KIND))
            if len(self.clauses) < MEMO:
                self.clauses[labels] = found
        return found

    def counts(self, text: str) -> tuple[int, ...]:
        total = [0] * len(KINDS)
        for clause in self.labels(_TOKEN.findall(text.lower())).split("."):
            if "I" in clause or "H" in clause:
                for k, n in enumerate(self.clause(clause)):
                    total[k] += n
        return tuple(total)

    def spans(self, text: str) -> list[dict]:
        """The matched clauses: start and end (code points) and their kinds."""
        out, words, places = [], [], []
        for m in [*_TOKEN.finditer(text), None]:
            if m is not None and m[0] not in _END:
                words.append(m[0].lower())
                places.append(m.span())
                continue
            if words and any(found := self.clause(self.labels(words))):
                out.append({"start": places[0][0], "end": places[-1][1], "kinds": [k for k, n in zip(KINDS, found) if n]})
            words, places = [], []
        return out


def labelled(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """text and toxic of at most ``most`` labelled doc_ids outside the held-out part; the sample has that bound, so it is broadcast."""
    rows = (labels.filter("doc_id is not null and toxic is not null").filter(~held_out())
            .groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("toxic")).withColumn("_h", F.xxhash64("_id")))
    sample = smallest(rows, "_h", most, "_id").drop("_h")
    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "_id").select("text", "toxic")


def _entries(text: str) -> set[str]:
    words = {w for w in _TOKEN.findall(text.lower()) if w[0].isalpha()}
    return words | {"^" + w[:n] for w in words for n in PREFIXES if len(w) > n}


def _tally(found: dict[int, Counter]) -> pa.RecordBatch:
    rows = [(w, found[1][w], found[0][w]) for w in found[0].keys() | found[1].keys()]
    cols = list(zip(*rows)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["entry", "toxic", "clean"])


def _vocabulary(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Documents with each word and each beginning, by label; the empty entry counts the documents."""
    found = {0: Counter(), 1: Counter()}
    for text, toxic in zip(texts(batch.column("text")), batch.column("toxic").to_pylist()):
        found[toxic].update(_entries(text))
        found[toxic][""] += 1
    return _tally(found)


def _strongest(ranked: list[str]):
    """For each document the entry of the best rank."""

    def make():
        rank = {e: k for k, e in enumerate(ranked)}

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = {0: Counter(), 1: Counter()}
            for text, toxic in zip(texts(batch.column("text")), batch.column("toxic").to_pylist()):
                if best := min(((rank[e], e) for e in _entries(text) if e in rank), default=None):
                    found[toxic][best[1]] += 1
            return _tally(found)

        return step

    return make


def _telling(counts: DataFrame, all_toxic: int, all_clean: int) -> DataFrame:
    """Entries that toxic documents have far more often, with the log-likelihood ratio as ``gain``."""
    rate = all_toxic / (all_toxic + all_clean)
    t, c = F.col("toxic"), F.col("clean")
    part = lambda k, share: F.when(k > 0, k * F.log(k / ((t + c) * share))).otherwise(F.lit(0.0))
    odds = F.log((t + 0.5) / (all_toxic + 1)) - F.log((c + 0.5) / (all_clean + 1))
    return counts.withColumn("gain", 2 * (part(t, rate) + part(c, 1 - rate))).filter((F.col("gain") >= LEAST_GAIN) & (odds >= LEAST_ODDS))


def learn_lexicon(train: DataFrame, most: int = MAX_LEXICON) -> frozenset[str]:
    """Seed words, less those that labelled rows acquit, and learnt entries."""
    counts = arrow_map(train.select("text", "toxic"), lambda: _vocabulary, "entry string, toxic long, clean long").groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    counts = materialize(counts, "toxic-vocabulary")
    rows = counts.filter("entry = ''").first()
    if rows is None:
        return frozenset(INSULTS)
    all_toxic, all_clean = rows["toxic"], rows["clean"]
    if not all_toxic or not all_clean:
        return frozenset(INSULTS)
    telling = counts.filter("entry <> ''").transform(_telling, all_toxic, all_clean)
    ranked = [r["entry"] for r in telling.orderBy(F.desc("gain"), F.col("entry").startswith("^"), F.desc(F.length("entry")), "entry").limit(most).select("entry").collect()]
    # copies of a toxic document make all its words telling: an entry must be the most telling one of enough documents
    strongest = arrow_map(train.select("text", "toxic"), _strongest(ranked), "entry string, toxic long, clean long").groupBy("entry").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    learnt = strongest.transform(_telling, all_toxic, all_clean).select("entry").collect()
    seen = {r["entry"]: r for r in counts.filter(F.col("entry").isin(INSULTS)).collect()}

    def guilty(word: str) -> bool:
        toxic, clean = (seen[word]["toxic"], seen[word]["clean"]) if word in seen else (0, 0)
        return math.log((toxic + SEED_ROWS) / (all_toxic + 1)) - math.log((clean + 0.5) / (all_clean + 1)) >= LEAST_ODDS or not clean

    return frozenset(r["entry"] for r in learnt) | frozenset(w for w in INSULTS if guilty(w))


def _counted(insults: frozenset[str], carry: str, spans: bool):
    def make():
        matcher = Matcher(insults)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [matcher.counts(t) for t in texts(batch.column("text"))]
            out = [batch.column(carry), pa.array(found, pa.list_(pa.int32()))]
            if spans:
                out.append(pa.array([matcher.spans(t) if any(n) else [] for t, n in zip(texts(batch.column("text")), found)],
                                    pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kinds", pa.list_(pa.string()))]))))
            return pa.RecordBatch.from_arrays(out, names=[carry, "counts", "spans"][:len(out)])

        return step

    return make


def _inputs(counts: np.ndarray) -> np.ndarray:
    """1 and, for each kind, 1 - 2 ** -count."""
    return np.column_stack([np.ones(len(counts)), 1 - 0.5 ** np.minimum(counts, SATURATION)])


def fit_weights(signatures: list[tuple[list[int], int, int]]) -> np.ndarray:
    """Logistic weights by Newton steps, drawn towards PRIOR; ``signatures``: counts, toxic rows, clean rows."""
    w = PRIOR.copy()
    if not signatures:
        return w
    x = _inputs(np.array([s[0] for s in signatures], "f8").reshape(len(signatures), -1))
    toxic, clean = (np.array([s[k] for s in signatures], "f8") for k in (1, 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (toxic - (toxic + clean) * p) - PRIOR_PRECISION * (w - PRIOR)
        curve = (x * ((toxic + clean) * p * (1 - p))[:, None]).T @ x + PRIOR_PRECISION * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w + step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass(frozen=True)
class Model:
    insults: frozenset[str]
    weights: tuple[float, ...]

    def score_column(self, counts: str = "counts"):
        z = F.lit(self.weights[0])
        for k, w in enumerate(self.weights[1:]):
            z = z + F.lit(w) * (1 - F.pow(F.lit(0.5), F.least(F.col(counts)[k], F.lit(SATURATION)).cast("double")))
        return 1 / (1 + F.exp(-z))


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Model:
    train = labelled(docs, labels, most)
    insults = learn_lexicon(train)
    counted = arrow_map(train.select("toxic", "text"), _counted(insults, "toxic", False), "toxic int, counts array<int>")
    level = F.transform("counts", lambda n: F.least(n, F.lit(SATURATION)))
    table = counted.groupBy(level.alias("counts")).agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).collect()
    return Model(insults, tuple(map(float, fit_weights([(list(r["counts"]), r["t"], r["c"]) for r in table]))))


def score(docs: DataFrame, model: Model, spans: bool = True) -> DataFrame:
    """doc_id, score, predicted, the number of matches of each kind, and the matched clauses' spans."""
    schema = "doc_id long, counts array<int>" + ", spans array<struct<start:int,end:int,kinds:array<string>>>" * spans
    rows = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")),
                     _counted(model.insults, "doc_id", spans), schema)
    scored = rows.withColumn("score", model.score_column()).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
    return scored.select("doc_id", "score", "predicted", *(F.col("counts")[k].alias(f"n_{name}") for k, name in enumerate(KINDS)), *["spans"] * spans)


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """Rows of ``docs`` that the model does not call toxic, with their columns as they are."""
    insults, names = model.insults, docs.columns
    texts_only = docs.withColumn("__text", F.col("text").cast("string"))

    def make():
        matcher = Matcher(insults)

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = pa.array([matcher.counts(t) for t in texts(batch.column("__text"))], pa.list_(pa.int32()))
            return pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), found], names=[*names, "__counts"])

        return step

    schema = StructType([*docs.schema.fields, StructField("__counts", ArrayType(IntegerType()))])
    return arrow_map(texts_only, make, schema).filter(model.score_column("__counts") < 0.5).drop("__counts")
