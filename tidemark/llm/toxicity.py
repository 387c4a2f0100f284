"""Toxicity scoring by a weighted finite-state pattern grammar (operator 2).

Words of a clause become labels (insult, threat, target, negation, reported, copula, break, other). Small
transducers read the labels in order and mark the matches of the clause: who is meant, whether a
negation covers the match, whether it is somebody else's speech. Their composition is one machine.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.session import cut_lineage, ship_package

#: Closed word classes of the grammar, for the four languages of the corpus.
TARGET = set("you your yours yourself u he she they him her them his their we us du dich dir dein deine ihr euch sie er tu te toi ton ta vous votre il elle ils ti tú usted ustedes tus él ella ellos".split())
NEGATION = set("not no never none nobody isn't aren't wasn't don't doesn't didn't won't can't without nicht kein keine nie niemals ohne pas jamais aucun aucune sans nunca jamás ninguno ninguna sin".split())
REPORTED = set("said says say told wrote writes called calls quoted reported claimed alleged according sagte sagt schrieb nannte laut dit disait écrit appelé selon dijo dice escribió llamó según".split())
THREAT = set("kill killing murder hurt beat burn shoot stab die destroy töten umbringen verletzen sterben tuer frapper mourir brûler matar herir morir quemar".split())

COPULA = set("am is are was were be been being bin bist ist sind seid war waren sei suis es est sommes êtes sont était soy eres somos son era eran estás está están".split())
BREAK = set("but however though although while aber sondern doch obwohl mais pourtant quoique pero sino aunque".split())

WORD = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
CLAUSE = re.compile(r"[.!?;:\n,]")
SHORTEST, LONGEST = 4, 8
#: Labelled rows that the model is fitted on, at most; the rows of smallest id hash are taken.
FIT_ROWS = 12_000
LEAST_GAIN = 28.0
#: A beginning that passes by its gain but not by its odds leads to the words under it; those are few, so less gain is asked of them.
CHILD_GAIN, FAMILY_ODDS, LEAST_ODDS = 11.0, 0.7, 2.5
#: A threat word in over this share of the clean labelled rows is an ordinary word of the corpus and says nothing.
ORDINARY = 0.002
#: Words that a negation covers, that may stand between a target and a match, and between a match and its target.
NEGATED_WORDS, AIMED_WORDS, OBJECT_WORDS = 4, 6, 3
#: The share of its weight that a negated or reported match keeps where the labelled rows do not say.
KEEPS = 0.5


LABELS = ("insult", "threat", "target", "negation", "reported", "copula", "break", "other")
MATCHES = ("insult", "threat")
#: What a match may be marked as, and the weights kept of a text: each match kind's sum, and the sums of its marked matches.
MARKS = ("aimed", "negated", "reported")
PARTS = tuple(f"{m}:{x}" for m in MATCHES for x in ("all", *MARKS))


@dataclass(frozen=True)
class Transducer:
    """Arcs (state, label) -> (state, marks). Marks belong to the match just read; "aimed back" to the one before."""

    arcs: dict
    start: object = 0

    def step(self, state: object, label: str) -> tuple[object, frozenset]:
        return self.arcs.get((state, label), (state, frozenset()))


def negation() -> Transducer:
    """A negation covers the next words; a conjunction that turns the clause ends its scope."""
    arcs: dict = {}
    for k in range(NEGATED_WORDS + 1):
        arcs[k, "negation"] = (NEGATED_WORDS, frozenset())
        arcs[k, "other"] = (max(0, k - 1), frozenset())
        arcs[k, "break"] = (0, frozenset())
        for m in MATCHES:
            arcs[k, m] = (k, frozenset({"negated"} if k else ()))
    return Transducer(arcs)


def reported_speech() -> Transducer:
    """What follows a reporting word in its clause is told, what stands before it is not."""
    arcs: dict = {(0, "reported"): (1, frozenset())}
    arcs |= {(1, m): (1, frozenset({"reported"})) for m in MATCHES}
    return Transducer(arcs)


def target() -> Transducer:
    """A match is aimed if a target stands shortly before it (you are an idiot) or just after it (kill them)."""
    arcs: dict = {}
    for a in range(AIMED_WORDS + 1):
        for b in range(OBJECT_WORDS + 1):
            arcs[(a, b), "target"] = ((AIMED_WORDS, 0), frozenset({"aimed back"} if b else ()))
            for label in ("other", "negation", "reported"):
                arcs[(a, b), label] = ((max(0, a - 1), max(0, b - 1)), frozenset())
            arcs[(a, b), "break"] = ((0, 0), frozenset())
            for m in MATCHES:
                arcs[(a, b), m] = ((a, 0 if a else OBJECT_WORDS), frozenset({"aimed"} if a else ()))
    return Transducer(arcs, (0, 0))


def match() -> Transducer:
    """Insults and threats of the lexicon."""
    return Transducer({(0, m): (0, frozenset({m})) for m in MATCHES})


def compose(*machines: Transducer) -> Transducer:
    """The machine that runs all of them at once; its states are tuples of theirs, its marks the union."""
    start = tuple(m.start for m in machines)
    arcs, todo, seen = {}, [start], {start}
    while todo:
        state = todo.pop()
        for label in LABELS:
            steps = [m.step(s, label) for m, s in zip(machines, state, strict=True)]
            to, marks = tuple(x for x, _ in steps), frozenset().union(*[y for _, y in steps])
            if to != state or marks:
                arcs[state, label] = (to, marks)
            if to not in seen:
                seen.add(to)
                todo.append(to)
    return Transducer(arcs, start)


GRAMMAR = compose(match(), target(), negation(), reported_speech())


@dataclass
class Model:
    """Lexical weights of insult stems (a trailing $ ends the word) and of threat words, weights of the parts and of their presence, and a bias."""

    stems: dict[str, float]
    threats: dict[str, float] = field(default_factory=dict)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    def key(self) -> tuple:
        return tuple(sorted(self.stems.items()))

    def threat_key(self) -> tuple:
        return tuple(sorted(self.threats.items()))


#: All threat words alike, for a grammar without a model.
PLAIN_THREATS = tuple((w, 1.0) for w in sorted(THREAT))


@lru_cache(maxsize=8)
def _automaton(key: tuple, threats: tuple) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for stem, weight in key:
        a.add_word(stem.rstrip("$"), (stem, weight))
    for w, _ in threats:
        if w not in a:
            a.add_word(w, (w + "$", 0.0))
    a.make_automaton()
    return a


def _labels(clause: str, stems: dict[str, float], threats: dict[str, float]) -> Iterator[tuple[str, float]]:
    for m in WORD.finditer(clause):
        w = m[0]
        own = max([stems.get(w + "$", 0.0), *(stems.get(w[:k], 0.0) for k in range(SHORTEST, min(LONGEST, len(w)) + 1))])
        if own:
            yield "insult", own
        else:
            kinds = (("threat", threats), ("negation", NEGATION), ("reported", REPORTED), ("copula", COPULA), ("target", TARGET), ("break", BREAK))
            label = next((k for k, words in kinds if w in words), "other")
            yield label, threats.get(w, 0.0) if label == "threat" else 0.0


def parse_clause(labels: Iterator[tuple[str, float]]) -> list[tuple[str, float, set]]:
    """The matches of a clause: (insult or threat, weight, marks)."""
    state, out = GRAMMAR.start, []
    for label, weight in labels:
        state, marks = GRAMMAR.step(state, label)
        if label in MATCHES:
            out.append((label, weight, set(marks & set(MARKS))))
        elif "aimed back" in marks:
            out[-1][2].add("aimed")
    return out


def clause_weights(text: str, key: tuple, threats: tuple = PLAIN_THREATS) -> np.ndarray:
    """The weights of a text's matched clauses by ``PARTS``; only clauses with an insult or a threat are parsed."""
    out = np.zeros(len(PARTS))
    low, stems, words = text.lower(), dict(key), dict(threats)
    done = -1  # where the last clause parsed ends; none begins before
    for end, (word, _) in _automaton(key, threats).iter(low):
        if end <= done:
            continue
        at = end - len(word.rstrip("$")) + 1
        if at and low[at - 1].isalpha():
            continue
        left = max(done, *(low.rfind(c, max(done, 0), at) for c in ".!?;:\n,")) + 1
        stop = CLAUSE.search(low, end + 1)
        done = stop.start() if stop else len(low)
        for kind, weight, marks in parse_clause(_labels(low[left:done], stems, words)):
            for part in ("all", *marks):
                out[PARTS.index(f"{kind}:{part}")] += weight
    return out


def _features(x: np.ndarray) -> np.ndarray:
    return np.concatenate([np.log1p(x), (x > 0).astype(float)], axis=-1)


def learn_stems(rows: DataFrame) -> tuple[dict[str, float], dict[str, float]]:
    """Words and word beginnings that mark toxic texts, with smoothed log-odds, from (__text, __toxic) rows; and threat words with their weight.

    A unit must have more gain in likelihood than chance brings to a million of them. Words of a small
    language are too rare for that, but their common beginning is not: under such a beginning, words and
    longer beginnings are few, and a smaller gain will do. Threat words that many clean rows have are
    ordinary words and left out; the others weigh as much as the stronger insults (their upper quartile), as labelled threats are rare.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: list[Counter] = [Counter(), Counter()]
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = {m[0] for m in WORD.finditer(text.lower())}
                seen[toxic].update({w[:k] for w in words for k in range(SHORTEST, min(LONGEST, len(w)) + 1)} | {w + "$" for w in words})
            for toxic in (0, 1):
                yield pa.RecordBatch.from_arrays([pa.array(list(seen[toxic]), pa.string()), pa.array([toxic] * len(seen[toxic]), pa.int32()), pa.array(list(seen[toxic].values()), pa.int64())], names=["unit", "toxic", "n"])

    sizes = {r["__toxic"]: r["count"] for r in rows.groupBy("__toxic").count().collect()}
    p, n = sizes.get(1, 0), sizes.get(0, 0)
    units = rows.select("__text", "__toxic").mapInArrow(run, "unit string, toxic int, n long").groupBy("unit")
    units = units.agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg"))
    odds = F.log((F.col("pos") + 0.5) / (p + 1.0)) - F.log((F.col("neg") + 0.5) / (n + 1.0))
    # Twice the gain in likelihood over one common rate: chance alone hardly brings a unit of a million to 28.
    rate = F.lit((p + 0.5) / (p + n + 1.0))
    both = F.col("pos") + F.col("neg")
    term = lambda k, share: F.when(k > 0, k * F.log(k / (both * share))).otherwise(0.0)
    gain = 2 * (term(F.col("pos"), rate) + term(F.col("neg"), 1 - rate))
    units = cut_lineage(units.withColumns({"odds": odds, "gain": gain}).where((F.col("gain") > CHILD_GAIN) | F.col("unit").isin([w + "$" for w in THREAT])))
    common = {r["unit"][:-1] for r in units.where(F.col("unit").isin([w + "$" for w in THREAT]) & (F.col("neg") > ORDINARY * n)).collect()}
    # All units that pass; a fit sample of bounded rows has few.
    passed = units.where((F.col("gain") > CHILD_GAIN) & (F.col("odds") > FAMILY_ODDS)).collect()
    families = {r["unit"] for r in passed if r["gain"] > LEAST_GAIN and r["odds"] <= LEAST_ODDS}
    under = lambda u: any(u[:k] in families for k in range(SHORTEST, len(u)))
    found = {r["unit"]: (r["pos"], r["odds"]) for r in passed if r["odds"] > LEAST_ODDS and (r["gain"] > LEAST_GAIN or under(r["unit"].rstrip("$")))}
    # Units by what they start with, one letter short, and whole words by the beginning that they equal.
    after: dict[str, list[str]] = defaultdict(list)
    for v in found:
        body = v.rstrip("$")
        after[body[:-1]].append(v)
        if v != body:
            after[body].append(v)
    out: dict[str, float] = {}
    for u in sorted(found, key=lambda u: (len(u.rstrip("$")), u)):
        body = u.rstrip("$")
        if any(body[:k] in out for k in range(SHORTEST, len(body) + 1)):
            continue
        # A beginning is followed while one continuation has nearly all of its texts.
        while not u.endswith("$"):
            longer = [v for v in after[u] if v != u and found[v][0] >= 0.95 * found[u][0]]
            if not longer:
                break
            u = max(longer, key=lambda v: (v.endswith("$"), found[v][0], v))
        out[u] = float(found[u][1])
    weight = float(np.quantile(list(out.values()), 0.75)) if out else 1.0
    return out, {w: weight for w in THREAT - common}


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 50, prior: np.ndarray | None = None) -> np.ndarray:
    """Logistic regression by Newton steps, pulled towards ``prior``; the last weight is the bias, which is hardly penalised."""
    x = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    prior = np.zeros(x.shape[1]) if prior is None else prior
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (y - p) - penalty * (w - prior))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_parts(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Weights of the parts, of their presence, and the bias.

    All kinds of matches share the weights of their marks, so a combination that no labelled row has is
    the sum of what is known. First the matches are weighed regardless of negation and report; from there
    a mark's own weight is fitted, starting at the loss of all but ``KEEPS`` of the match's weight. A threat
    starts without weight by itself and, where it is aimed, with that of an aimed insult.
    """
    n, bare, at = len(PARTS), x.copy(), PARTS.index
    for i, part in enumerate(PARTS):
        if part.startswith("threat") or part.endswith((":negated", ":reported")):
            bare[:, i] = 0
    prior = _fit(_features(bare), y)
    for k in (0, n):
        aimed = prior[k + at("insult:all")] + prior[k + at("insult:aimed")]
        prior[k + at("threat:all")], prior[k + at("threat:aimed")] = 0.0, aimed
        for kind, whole in (("insult", prior[k + at("insult:all")]), ("threat", aimed)):
            for mark in ("negated", "reported"):
                prior[k + at(f"{kind}:{mark}")] = -(1 - KEEPS) * whole
    return _fit(_features(x), y, prior=prior)


def is_held_out(name: str):
    return F.pmod(F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """A model from at most ``fit_rows`` labelled rows outside the held-out part; the rest of the table is not read for it."""
    ship_package(docs.sparkSession)
    picked = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~is_held_out(id_col)).groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__toxic"))
    picked = picked.where("__toxic in (0, 1)").orderBy(F.xxhash64("__id"), "__id").limit(fit_rows)
    rows = docs.select(F.col(id_col).alias("__doc"), text_of(text_col).alias("__text")).join(F.broadcast(picked), F.col("__doc") == F.col("__id"))
    # One row for each id, however many the table has: the text with the smallest hash.
    rows = rows.groupBy("__id", "__toxic").agg(F.min(F.struct(F.xxhash64("__text").alias("h"), "__text")).alias("__least")).select("__least.__text", "__toxic")
    model = Model(*learn_stems(rows))
    key, threats = model.key(), model.threat_key()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"x": [clause_weights(t, key, threats).tolist() for t in f["__text"]], "y": f["__toxic"].astype("int32")})

    sample = rows.mapInPandas(run, "x array<double>, y int").toPandas()
    if sample["y"].nunique() < 2:
        rate = (sample["y"].sum() + 0.5) / (len(sample) + 1.0) if len(sample) else 0.05
        model.weights, model.bias = [0.0] * 2 * len(PARTS), math.log(rate / (1 - rate))
        return model
    w = fit_parts(np.array(sample["x"].tolist()), sample["y"].to_numpy(float))
    model.weights, model.bias = w[:-1].tolist(), float(w[-1])
    return model


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """Every whole text's score: a logistic function of the weights of its matched clauses.

    Null and empty texts have no clauses and get the bias alone. Repeated rows are scored each; other
    columns are ignored; an empty table gives no rows. Returns id, held_out, score, predicted, and clauses (weights by ``PARTS``).
    """
    ship_package(docs.sparkSession)
    key, threats, weights, bias = model.key(), model.threat_key(), np.array(model.weights), model.bias
    rows = docs.select(F.col(id_col).alias("__id"), is_held_out(id_col).alias("__out"), text_of(text_col).alias("__text"))
    kind = rows.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array([clause_weights(t.as_py(), key, threats) for t in b.column(2)]).reshape(-1, len(PARTS))
            score = 1 / (1 + np.exp(-(_features(x) @ weights + bias)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(x.tolist(), pa.list_(pa.float64()))],
                names=[id_col, "held_out", "score", "predicted", "clauses"],
            )

    return rows.mapInArrow(run, f"{id_col} {kind}, held_out boolean, score double, predicted int, clauses array<double>")
