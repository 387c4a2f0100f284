"""Scores against a plain scorer that reads a text clause by clause, threats in four languages, and held-out rows of the given documents."""

import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.test_brute_force import plain_clause
from tidemark.llm import toxicity as tx

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return tx.fit_toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))


def plain_score(text, model):
    """Every clause of the text, word by word, without an automaton or a transducer."""
    sums = Counter()
    for clause in re.split(r"[.!?;:\n,]", (text or "").lower()):
        words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause)
        labels, weights = [], []
        for w in words:
            odds = max([o for s, o in model.stems.items() if (w == s[:-1] if s.endswith("$") else w.startswith(s)) and len(s.rstrip("$")) <= tx.LONGEST or s == w + "$"], default=0)
            kind = "insult" if odds else "threat" if w in model.threats else next((k for k, c in (("negation", tx.NEGATION), ("reported", tx.REPORTED), ("copula", tx.COPULA), ("target", tx.TARGET), ("break", tx.BREAK)) if w in c), "other")
            labels.append(kind)
            if kind in ("insult", "threat"):
                weights.append(odds or model.threats[w])
        for (kind, marks), weight in zip(plain_clause(labels), weights, strict=True):
            for part in ("all", *marks):
                sums[f"{kind}:{part}"] += weight
    x = [math.log1p(sums[p]) for p in tx.PARTS] + [float(sums[p] > 0) for p in tx.PARTS]
    return 1 / (1 + math.exp(-(sum(a * b for a, b in zip(x, model.weights, strict=True)) + model.bias)))


CASES = {
    "I will kill you.": True,
    "du Arsch, ich werde dich töten": True,
    "je vais te tuer": True,
    "te voy a matar": True,
    "You are an idiot": True,
    "you are a moron and a clown": True,
    "They will not kill you": False,
    "he said he will kill you": False,
    "kill the process": False,
    "die Sonne scheint, die Leute lachen, und die Zeit vergeht": False,
    "": False,
    None: False,
}


def score(spark, texts, model):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.score for r in tx.score_toxicity(df, model).orderBy("doc_id").collect()]


def test_threats_and_insults_in_four_languages(spark, model):
    got = score(spark, list(CASES), model)
    assert {t: s > 0.3 for t, s in zip(CASES, got, strict=True)} == CASES
    assert "die" not in model.threats and "kill" in model.threats


def test_scores_follow_a_plain_scorer(spark, model):
    rnd = random.Random(5)
    vocabulary = [*list(model.stems)[:30], *model.threats, "you", "dich", "te", "not", "nicht", "no", "said", "dijo", "but", "are", "die", "x", "Haus", "réeux", "bomente", "idiots"]
    texts = [" ".join(rnd.choice(vocabulary).rstrip("$") + rnd.choice(["", "", "", ",", ".", "\n", "'s", "1"]) for _ in range(rnd.randint(0, 25))) for _ in range(300)]
    texts += [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(150).collect()] + list(CASES)
    for text, got in zip(texts, score(spark, texts, model), strict=True):
        assert got == pytest.approx(plain_score(text, model), abs=1e-9), text


def test_held_out_rows(spark, model):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet").where("toxic IS NOT NULL")
    rows = tx.score_toxicity(docs, model).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").join(docs.select("doc_id", "lang"), "doc_id")
    n = {(r.lang, r.toxic, r.predicted): r.n for r in rows.groupBy("lang", "toxic", "predicted").agg(F.count(F.lit(1)).alias("n")).collect()}
    found = {lang: (n.get((lang, 1, 1), 0), n.get((lang, 1, 0), 0)) for lang in ("en", "de", "fr", "es")}
    assert sum(a for a, _ in found.values()) >= 106 and found["es"][0] >= 8, found
    assert sum(k for (_, toxic, said), k in n.items() if not toxic and said) <= 6, n


def test_long_texts_take_linear_time(model):
    def took(n):
        text = "an idiot stands here and " * n
        began = time.perf_counter()
        tx.clause_weights(text, model.key(), model.threat_key())
        return time.perf_counter() - began

    took(2000)
    assert took(40_000) < 8 * took(10_000) + 0.2
