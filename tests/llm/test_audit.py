"""Source divergence, repeated word windows and group-bounded k-means against brute force, with odd inputs."""

import hashlib
import re
from collections import Counter, defaultdict
from functools import reduce

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm.divergence import radix_rank, radix_select, source_divergence
from tidemark.llm.fm_index import FMIndex, WaveletMatrix, remove_repeated_words, sort_suffixes
from tidemark.llm.yinyang import first_bounds, group_centroids, next_bounds, squared, yinyang_clusters

DOCS = "doc_id long, text string, lang string, source string, n_chars long, value string, rank int, idx string, p string, v string, kept string, spans int, __id long"


def table(spark, rows, partitions=3):
    return spark.createDataFrame([(*r, None, "x", 1, "y", "z", "w", "k", 5, 7) for r in rows], DOCS).repartition(partitions)


# Operator 11


def divergence(rows, least, top):
    terms = lambda t: re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    count, docs = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source in rows:
        count[lang or "", source or ""].update(terms(text))
        docs[lang or ""].update(set(terms(text)))
    kept = {lang: sorted(t for t, n in c.items() if n >= least) for lang, c in docs.items()}
    gap = lambda p, q: (p - q) * (p - q) // (p + q)
    share = lambda c, v: {t: 1 + 10**9 * (c[t] + 2) // (sum(c[x] for x in v) + 2 * len(v)) for t in v}
    of = {g: share(count[g], kept[g[0]]) for g in count}
    whole = {lang: share(reduce(lambda a, b: a + b, (c for g, c in count.items() if g[0] == lang), Counter()), kept[lang]) for lang in kept}
    out = []
    for lang, source in count:
        mine = of[lang, source]
        pairs = [(sum(gap(mine[t], p[t]) for t in mine), s) for (l, s), p in of.items() if l == lang and s != source]
        marks = [(gap(p, whole[lang][t]), t) for t, p in mine.items() if count[lang, source][t] and p > whole[lang][t]]
        for part, found, n in (("pair", pairs, None), ("term", marks, top)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:n]
            out += [(lang, source, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def word_rows(n, sources, seed):
    r = np.random.default_rng(seed)
    words = ["der", "Die", "ÄB", "äb", "naïve", "x", "zz", "日本", "don't", "a1b", "É", "\x00q"] + [f"w{chr(97 + k)}" for k in range(20)]
    return [(k, " ".join(r.choice(words, r.integers(0, 30))), ["en", "de"][k % 2], f"s{r.integers(0, sources)}") for k in range(n)]


@pytest.mark.parametrize("block,chunk,leaf", [(256, 1 << 16, 64), (3, 7, 0)])
def test_divergence(spark, block, chunk, leaf):
    rows = word_rows(120, 8, 1) + [(None, None, None, None), (1, "", "en", "empty"), (2, "alone", "xx", "one"), (3, "alone", "xx", "two"), (3, "alone", "xx", "two"), (4, "der " * 5000, "en", "hot")]
    out = source_divergence(table(spark, rows), 3, 4, block=block, chunk=chunk, leaf=leaf)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, out.collect())) == divergence(rows, 3, 4)


def test_divergence_empty(spark):
    assert source_divergence(table(spark, [])).collect() == []


@pytest.mark.parametrize("leaf", [0, 64])
def test_radix_select(spark, leaf):
    r = np.random.default_rng(3)
    rows = [("hot", 7, f"tie{k % 400:04d}{'x' * (k % 3)}") for k in range(900)] + [("a", int(v), f"t{k}é") for k, v in enumerate(r.integers(0, 2**40, 300))] + [("b", 0, ""), ("b", 0, "\x00"), ("b", 2**62, "q"), ("c", 5, "same"), ("c", 5, "same")]
    df = spark.createDataFrame(rows, "g string, n long, t string")
    want = sorted((g, n, t, k) for g in "hot a b c".split() for k, (n, t) in enumerate(sorted(((n, t) for x, n, t in rows if x == g), key=lambda x: (-x[0], x[1].encode())), 1))
    assert sorted(map(tuple, radix_rank(df, ["g"], "n", "t").collect())) == want
    assert sorted(map(tuple, radix_select(df, ["g"], "n", "t", 10, leaf).collect())) == [x for x in want if x[3] <= 10]


# Operator 12


def repeats(rows, length):
    texts = [((i is None, i or 0), (t or "").encode().split()) for i, t in rows]
    first = {}
    for order, w in texts:
        for k in range(len(w) - length + 1):
            win = tuple(w[k : k + length])
            first[win] = min(first.get(win, (order, k)), (order, k))
    out = []
    for (i, _), (order, w) in zip(rows, texts):
        gone = {j for k in range(len(w) - length + 1) if first[tuple(w[k : k + length])] < (order, k) for j in range(k, k + length)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return sorted(out, key=repr)


def passages(seed):
    r = np.random.default_rng(seed)
    words = ["ä", "b", "c c", "d", "日", "f"]
    some = lambda n: list(r.choice(words, n))
    shared = [some(k) for k in (5, 6, 12, 40)]
    rows = [(k, " \n\t\x0b"[k % 4].join(some(r.integers(0, 12)) + shared[k % 4] + some(r.integers(0, 6)) + shared[(k * 7) % 4])) for k in range(150)]
    return rows + [(1000 + k, "copy " * 30 + "of all of it") for k in range(60)] + [(None, "x y z " * 4), (2000, None), (2001, ""), (2002, " \n "), (2003, "b " * 4000), (3000, "x y z " * 4), (5, rows[5][1])]


@pytest.mark.parametrize("how", [{}, {"large": 2}, {"shard_words": 50, "bits": 18}, {"bits": 8, "large": 5}])
def test_repeated_words(spark, how):
    rows = passages(2)
    docs = table(spark, [(i, t, "en", "s") for i, t in rows])
    out = remove_repeated_words(docs, length=6, gram=3, **how)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    got = out.select("doc_id", "n_words", removed, F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got), key=repr) == repeats(rows, 6)
    # Spans do not touch.
    assert all(a.end < b.start for r in out.select("spans").collect() for a, b in zip(r.spans, r.spans[1:]))


def test_repeated_words_empty(spark):
    assert remove_repeated_words(table(spark, [])).collect() == []
    assert [tuple(r) for r in remove_repeated_words(table(spark, [(1, "one", "", "")])).collect()] == [(1, 1, [], "one")]


def test_equal_ids_with_other_texts(spark):
    text = " ".join(map(str, range(30)))
    out = remove_repeated_words(table(spark, [(7, text, "", ""), (7, text + " more", "", ""), (None, text + " last", "", "")])).orderBy("n_words", "doc_id").collect()
    assert sorted(len(r.kept.split()) for r in out) in ([1, 1, 30], [0, 1, 31]) and [r.n_words for r in out] == [30, 31, 31]


texts_ = st.lists(st.lists(st.integers(1, 4), min_size=3, max_size=12), min_size=1, max_size=8)


@settings(max_examples=60, deadline=None)
@given(texts_, texts_)
def test_backward_search(texts, streamed):
    """Matching statistics of texts of the index and of others, some with a symbol that the index has not."""
    arrays = [np.array(t) for t in texts]
    index = FMIndex(arrays, 6, 3)
    other = [np.array([*t, 5]) for t in streamed] + arrays
    inside = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1)}
    got = {(int(t), int(p)): int(d) for ts, ps, ds, _ in index.matching_statistics(other) for t, p, d in zip(ts, ps, ds)}
    for k, t in enumerate(other):
        for i in range(len(t)):
            assert got[k, i] == max((n for n in range(1, 4) if tuple(t[i : i + n].tolist()) in inside and i + n <= len(t)), default=0)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 37), min_size=1, max_size=300))
def test_wavelet_and_suffixes(s):
    a = np.array(s)
    m = WaveletMatrix(a, 38)
    at = np.arange(len(s) + 1)
    for c in set(s):
        assert m.rank(np.full(len(at), c), at).tolist() == [s[:i].count(c) for i in at]
    order, new = sort_suffixes(a, 5)
    assert order.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
    assert new.tolist() == [k == 0 or s[order[k] : order[k] + 5] != s[order[k - 1] : order[k - 1] + 5] for k in range(len(s))]


# Operator 13


def lloyd(rows, k, rounds, dims):
    rows = [(i, v) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    x = np.array([[int(np.floor(256 * c)) for c in v] for _, v in rows], np.int64)
    seeds = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest() if i is not None else "~", tuple(v)) for (i, _), v in zip(rows, x.tolist()))[:k]
    c = np.array([s[1] for s in seeds], np.int64)
    for r in range(rounds + 1):
        d = ((x[:, None] - c[None]) ** 2).sum(2)
        a = d.argmin(1)
        if r < rounds:
            c = np.array([[sum(col) // (a == j).sum() for col in x[a == j].T.tolist()] if (a == j).any() else c[j] for j in range(len(c))], np.int64)
    d = d.min(1)
    sha = [hashlib.sha256(",".join(map(str, y)).encode()).hexdigest() for y in c.tolist()]
    return sorted(((i, int(a[n]), int(d[n]), int(d[a == a[n]].sum()), int(d.sum()), sha[a[n]]) for n, (i, _) in enumerate(rows)), key=repr)


def test_clusters(spark):
    r = np.random.default_rng(5)
    heads = r.normal(size=(6, 4))
    rows = [(k, (heads[k % 6] + 0.2 * r.normal(size=4)).tolist()) for k in range(500)] + [(k, [0.5, 0.5, 0.5, 0.5]) for k in range(500, 700)]
    rows += [(None, [0.1] * 4), (7, [0.2] * 4), (7, [0.2] * 4), (800, None), (801, [1.0]), (802, [1.0, None, 0.0, 0.0]), (803, [float("nan")] * 4), (804, [float("inf")] * 4), (805, [])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, cluster string, v int").repartition(5)
    out = yinyang_clusters(df, k=12, rounds=5, dims=4, group_size=3)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, out.collect()), key=repr) == lloyd(rows, 12, 5, 4)


def test_few_or_no_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert yinyang_clusters(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [0.5] * 64), (2, [0.5] * 64), (3, [-0.25] * 64)]
    assert sorted(map(tuple, yinyang_clusters(spark.createDataFrame(rows, schema)).collect())) == lloyd(rows, 40, 5, 64)
    huge = yinyang_clusters(spark.createDataFrame([(1, [3e38] * 64), (2, [-3e38] * 64)], schema), k=1).collect()
    assert all(r.distance >= 0 for r in huge)


def test_bounds_save_distances():
    """Filters never change the assignment, ties included, and leave out most distances once centroids settle."""
    r = np.random.default_rng(6)
    heads = r.integers(-200, 200, (20, 8))
    x = np.concatenate([heads[k % 20] + r.integers(-20, 20, 8) for k in range(4000)]).reshape(-1, 8)
    c = x[:20].copy()
    group = group_centroids(c, 5)
    a, upper, lower = first_bounds(x, c, group)
    took = []
    for _ in range(6):
        moved = np.array([x[a == j].sum(0) // max(1, (a == j).sum()) if (a == j).any() else c[j] for j in range(20)])
        drift, c = np.sqrt(squared(moved, c).astype(float)), moved
        a, upper, lower, n = next_bounds(x, a, upper, lower, c, group, drift)
        took.append(n)
        assert (a == ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)).all()
    assert took[-1] < 0.1 * len(x) * len(c)
