"""The fit of op2 takes one row for each labelled id."""

import random

from tidemark.llm import toxicity


def test_an_id_with_many_rows_counts_once(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 7))) for _ in range(100)]
    rows = [(i, " ".join([*rnd.choices(words, k=30), *(["moron", "scumbag"] if i % 4 == 0 else [])])) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id long, toxic int")
    fit = lambda r: toxicity.fit_toxicity(spark.createDataFrame(r, "doc_id long, text string").repartition(3), labels)
    once, often = fit(rows), fit([*rows, *[(i, rows[i][1]) for i in (1, 2, 3, 5) for _ in range(100)]])
    assert often.key() == once.key() and max(abs(a - b) for a, b in zip([*once.weights, once.bias], [*often.weights, often.bias], strict=True)) < 1e-6
