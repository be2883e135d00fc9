"""Toxicity by a weighted finite-state pattern grammar.

A lexicon transducer reads words as symbols: insult (with a weight), threat, target, negation, report, other,
and clause end. It is followed by three small transducers, composed into one machine before use:

* negation: an insult or threat soon after a negation is marked as negated;
* reported speech: one after a verb of saying in the same clause is marked as reported;
* target: one after (or before) a word for the addressee or a person is marked as directed; a threat counts only
  when directed.

The machine scores clauses, not words: a clause's score is the sum of its insults' weights times the factors of the
path. Insult arcs, for words and for word beginnings, are learned from labelled rows of at most ``TRAIN`` per class;
half of those rows give the arcs, the other half a logistic calibration of the clause scores.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import map_texts, small_batches, texts

#: Labelled rows used at most: toxic and other ones.
TRAIN = (4000, 8000)
#: Arcs kept at most; the broadcast lexicon's size is bounded by it.
ARCS = 4000
TOKEN = re.compile(r"\w+|[.!?;:\n]")
INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, END = "ivtnro."

# Seed words of the grammar, in four languages.
SEED_INSULTS = ["idiot", "stupid", "moron", "scum", "worthless", "pathetic", "loser", "trash", "disgusting", "imbecile",
                "imbécile", "crétin", "connard", "débile", "ordure", "dumm", "blöd", "abschaum", "wertlos", "trottel",
                "estúpido", "imbécil", "basura", "inútil", "asqueroso"]
SEED_THREATS = ["kill", "hurt", "destroy", "stab", "shoot", "tuer", "frapper", "détruire", "töten", "schlagen",
                "vernichten", "matar", "golpear", "destruir"]
TARGETS = ["you", "your", "yours", "he", "him", "she", "her", "they", "them", "tu", "toi", "vous", "il", "ils", "elles",
           "du", "dich", "dir", "ihr", "euch", "sie", "tú", "usted", "ustedes", "él", "ella", "ellos"]
NEGATIONS = ["not", "no", "never", "isn", "aren", "wasn", "don", "pas", "jamais", "aucun", "nicht", "kein", "keine", "nie",
             "nunca", "jamás"]
REPORTS = ["said", "says", "wrote", "called", "claimed", "quoted", "according", "dit", "écrit", "appelé", "selon", "sagte",
           "schrieb", "nannte", "laut", "dijo", "escribió", "llamó", "según"]

Machine = dict[tuple[str, str], tuple[str, str, float]]


def negation_machine(reach: int = 3, factor: float = 0.3) -> Machine:
    """States 0 .. reach: how many more symbols a negation covers."""
    out: Machine = {}
    for left in range(reach + 1):
        for x in (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, END):
            after = 0 if x == END else reach if x == NEGATION else max(left - 1, 0)
            negated = left > 0 and x in (INSULT, THREAT)
            out[str(left), x] = (str(after), x, math.log(factor) if negated else 0.0)
    return out


def report_machine(factor: float = 0.4) -> Machine:
    out: Machine = {}
    for state in ("plain", "said"):
        for x in (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, END):
            after = "plain" if x == END else "said" if x == REPORT else state
            out[state, x] = (after, x, math.log(factor) if state == "said" and x in (INSULT, THREAT) else 0.0)
    return out


def target_machine(factor: float = 1.5) -> Machine:
    """A threat without a target is turned into an ordinary word."""
    out: Machine = {}
    for state in ("alone", "aimed"):
        for x in (INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, END):
            after = "alone" if x == END else "aimed" if x == TARGET else state
            aimed = state == "aimed"
            symbol = OTHER if x == THREAT and not aimed else x
            out[state, x] = (after, symbol, math.log(factor) if aimed and x in (INSULT, THREAT) else 0.0)
    return out


def compose(first: Machine, second: Machine) -> Machine:
    """The machine that feeds the output of ``first`` to ``second``; weights add."""
    out: Machine = {}
    for (p, x), (p2, y, w) in first.items():
        for (q, y2), (q2, z, v) in second.items():
            if y == y2:
                out[f"{p}|{q}", x] = (f"{p2}|{q2}", z, w + v)
    return out


GRAMMAR = compose(compose(negation_machine(), report_machine()), target_machine())
START = "0|plain|alone"


def clause_factors(symbols: str, machine: Machine = GRAMMAR, start: str = START) -> list[tuple[int, float]]:
    """(position, factor) of the insults and threats of one clause that the machine lets through. A target that
    follows is read too: the clause is run once more from the state that has seen it."""
    if TARGET in symbols:
        start = start.replace("alone", "aimed")
    state, out = start, []
    for i, x in enumerate(symbols):
        state, y, w = machine[state, x]
        if y in (INSULT, THREAT):
            out.append((i, math.exp(w)))
    return out


class Grammar:
    """Scores texts with a lexicon of insult arcs: word or (ending in *) word beginning -> weight."""

    FEATURES = 5

    def __init__(self, arcs: dict[str, float], limit: int = 400_000):
        self.words = {a: w for a, w in arcs.items() if not a.endswith("*")}
        self.stems = {a[:-1]: w for a, w in arcs.items() if a.endswith("*")}
        self.lengths = sorted({len(a) for a in self.stems}, reverse=True)
        self.limit = limit
        self.symbol: dict[str, str] = {}
        self.weight: dict[str, float] = {}
        self.paths: dict[str, list] = {}
        self.fixed = {**{w: TARGET for w in TARGETS}, **{w: NEGATION for w in NEGATIONS}, **{w: REPORT for w in REPORTS},
                      **{w: THREAT for w in SEED_THREATS}, **{x: END for x in ".!?;:\n"}}

    def read(self, word: str) -> str:
        low = word.lower()
        found = [self.words[low]] if low in self.words else []
        found += [self.stems[low[:n]] for n in self.lengths if len(low) >= n and low[:n] in self.stems]
        if found:
            self.weight[word] = max(found)
            return INSULT
        x = self.fixed.get(low, OTHER)
        if x == THREAT:
            self.weight[word] = 1.0
        return x

    def features(self, text: str) -> list[float]:
        tokens = TOKEN.findall(text)
        try:
            symbols = "".join(map(self.symbol.__getitem__, tokens))
        except KeyError:
            if len(self.symbol) > self.limit:
                self.symbol.clear()
                self.weight.clear()
            for t in set(tokens).difference(self.symbol):
                self.symbol[t] = self.read(t)
            symbols = "".join(map(self.symbol.__getitem__, tokens))
        n_words = len(symbols) - symbols.count(END)
        total = top = 0.0
        clauses = 0
        if INSULT in symbols or THREAT in symbols:
            at = 0
            for clause in symbols.split(END):
                if INSULT in clause or THREAT in clause:
                    path = self.paths.get(clause)
                    if path is None:
                        path = clause_factors(clause)
                        if len(self.paths) < self.limit and len(clause) < 60:
                            self.paths[clause] = path
                    score = sum(self.weight[tokens[at + i]] * f for i, f in path)
                    total, top, clauses = total + score, max(top, score), clauses + (score > 0)
                at += len(clause) + 1
        return [math.log1p(total), math.log1p(top), math.log1p(clauses), math.log1p(100 * total / max(n_words, 20)),
                math.log1p(n_words)]


def word_and_stems(word: str) -> list[str]:
    return [word] + [word[:n] + "*" for n in range(3, 8) if len(word) > n]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 40) -> np.ndarray:
    """Weights (bias last) by Newton steps; the classes count as they occur."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    damp = ridge * np.eye(len(w))
    damp[-1, -1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + damp, x.T @ (y - p) - damp @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


#: Used when the labelled rows lack a class.
PLAIN_WEIGHTS = [1.0, 1.0, 0.5, 1.0, -0.5, -2.0]


def labelled_sample(labels: DataFrame, id_col: str, label_col: str, rows: tuple[int, int]) -> DataFrame:
    """At most ``rows`` toxic and other training ids, by the order of a hash. A row whose id's CRC-32 is 1 modulo 3 is held
    out; of several labels of an id the highest counts; null ids and labels are left out."""
    known = (labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("toxic"))
             .filter("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 3 <> 1")
             .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
             .withColumn("h", F.xxhash64("doc_id")))
    pick = lambda t, n: known.filter(f"toxic {'=' if t else '<>'} 1").orderBy("h", "doc_id").limit(n)
    return pick(1, rows[0]).unionByName(pick(0, rows[1])).select(
        "doc_id", F.col("toxic").eqNullSafe(1).cast("int").alias("toxic"), (F.shiftright("h", 7) % 2 == 0).alias("arcs"))


def learn(source: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic",
          rows: tuple[int, int] = TRAIN, arcs: int = ARCS) -> tuple[dict[str, float], list[float]]:
    """Insult arcs and calibration weights."""
    sample = F.broadcast(labelled_sample(labels, id_col, label_col, rows))
    train = source.join(sample, "doc_id").select("doc_id", "text", "toxic", "arcs")

    def count(blocks) -> Iterator[dict]:
        seen: dict[str, list[int]] = {}
        sizes = [0, 0]
        docs = [0, 0]
        for _, block, toxic, _ in blocks:
            for t, y in zip(block, toxic):
                tokens = [w.lower() for w in TOKEN.findall(t) if len(w) > 1]
                sizes[y] += len(tokens)
                docs[y] += 1
                own: dict[str, int] = {}
                for w in tokens:
                    for a in word_and_stems(w):
                        own[a] = own.get(a, 0) + 1
                for a, n in own.items():
                    s = seen.setdefault(a, [0, 0, 0])
                    s[y] += n
                    s[2] += y
        seen[""] = [*sizes, docs[1]]
        yield {"arc": list(seen), "plain": [s[0] for s in seen.values()], "toxic": [s[1] for s in seen.values()],
               "docs": [s[2] for s in seen.values()]}

    counts = map_texts(train.filter("arcs"), count, "arc string, plain long, toxic long, docs long").groupBy("arc").agg(
        *[F.sum(c).alias(c) for c in ("plain", "toxic", "docs")])
    size = counts.filter("arc = ''").first()
    found = {w: 2.0 for w in SEED_INSULTS}
    if size and size["plain"] and size["toxic"]:
        share = size["toxic"] / (size["plain"] + size["toxic"])
        both = F.col("toxic") + F.col("plain")
        part = lambda c, s: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * s))).otherwise(0.0)
        ratio = F.log((F.col("toxic") + 0.5) / (F.col("plain") + 0.5) * (1 - share) / share)
        # w: log ratio of the rates; z: signed root of the likelihood-ratio statistic of equal rates
        kept = (counts.filter("arc <> '' and docs >= 4").withColumn("w", ratio)
                .withColumn("z", F.sqrt(F.greatest(F.lit(0.0), 2 * (part("toxic", share) + part("plain", 1 - share)))))
                .filter("w > 1.5 and z > 4.5").orderBy(F.col("z").desc(), "arc").limit(arcs))
        found |= {r["arc"]: float(r["w"]) for r in kept.collect()}
    shared = source.sparkSession.sparkContext.broadcast(found)

    def measure(blocks) -> Iterator[dict]:
        grammar = Grammar(shared.value)
        for _, block, toxic, _ in blocks:
            yield {"x": [grammar.features(t) for t in block], "y": toxic}

    rows_out = map_texts(train.filter("not arcs"), measure, "x array<double>, y int").collect()
    y = np.array([r["y"] for r in rows_out], float)
    if len(set(y.tolist())) < 2:
        return found, PLAIN_WEIGHTS
    return found, fit_logistic(np.array([r["x"] for r in rows_out]), y).tolist()


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   label_id_col: str = "doc_id", label_col: str = "toxic", threshold: float = 0.7) -> DataFrame:
    """One row per input row: doc_id, held_out (its label is never used), score (0 to 1), predicted (1 if score >=
    ``threshold``), clauses (matched ones).

    Scores depend on the text alone. Null and empty texts score as texts without matches; a null id is scored, held_out
    false; repeated rows get a row each; other columns are ignored. Without labels of both classes the seed words
    and fixed calibration weights are used. An empty table gives an empty result.
    """
    source = texts(docs, id_col, text_col)
    arcs, weights = learn(source, labels, label_id_col, label_col)
    shared = docs.sparkSession.sparkContext.broadcast((arcs, np.array(weights)))

    def score(blocks) -> Iterator[dict]:
        arcs, w = shared.value
        grammar = Grammar(arcs)
        for ids, block in blocks:
            x = np.array([grammar.features(t) for t in block])
            s = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            yield {"doc_id": ids, "score": s.tolist(), "clauses": np.rint(np.expm1(x[:, 2])).astype(int).tolist()}

    kind = source.schema["doc_id"].dataType.simpleString()
    scored = map_texts(source, score, f"doc_id {kind}, score double, clauses int")
    return scored.select("doc_id", F.expr("coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)").alias("held_out"),
                         "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "clauses")


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose score stays under ``threshold``; see ``score_toxicity``."""
    arcs, weights = learn(texts(docs, id_col, text_col), labels)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((arcs, np.array(weights)))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arcs, w = shared.value
        grammar = Grammar(arcs)
        limit = math.log(threshold / (1 - threshold)) if threshold < 1 else math.inf
        for b in batches:
            column = b.column(b.schema.names.index(text_col))
            clean = [float(np.dot(grammar.features(t.as_py() or ""), w[:-1]) + w[-1]) < limit for t in column]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(select, docs.schema)
