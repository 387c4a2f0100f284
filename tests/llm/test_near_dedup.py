"""The pipeline's near-dedup stage against all pairs, with near copies planted at similarities of 0.8 to 0.95."""

import collections
import hashlib
import random

import corpus_pipeline
import numpy as np

from tidemark.llm import near_dedup, simhash


def grams(t):
    w = (t or "").lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def corpus():
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n", "one two", "One  TWO", "one two three"]
    for k in range(60):
        base = [word() for _ in range(rnd.randint(30, 160))]
        if k % 3 == 0:
            base[10:10] = passage
        texts.append(" ".join(base))
        for edits in (1, 2, 3, 4)[: k % 5]:
            copy = list(base)
            for at in rnd.sample(range(len(copy)), edits):
                copy[at] = word()
            texts.append(" ".join(copy))
    # A chain: each is a near copy of the next only.
    chain = [word() for _ in range(100)]
    for step in range(8):
        texts.append(" ".join(chain[4 * step :] + [word() for _ in range(4 * step)]))
    rnd.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (3, texts[9])]


def exact_groups(rows):
    """The pairs of similarity 0.8 or more, those of them from 0.8 to 0.95, and each row's component."""
    sets = [grams(t) for _, t in rows]
    root, pairs, planted = list(range(len(rows))), [], 0

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            like = jaccard(sets[i], sets[j])
            planted += 0.8 <= like <= 0.95
            if like >= 0.8:
                pairs.append((i, j))
                root[find(i)] = find(j)
    return pairs, planted, [find(i) for i in range(len(rows))]


def check(spark, rows, least):
    """Recall of pairs of at least ``least``, precision 1; one row of each group stays."""
    pairs, planted, exact = exact_groups(rows)
    assert planted > 40
    docs = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "doc_id long, text string, row int").repartition(5).cache()
    of = {(r["__id"], bytes(r["__t"])): r["__root"] for r in near_dedup.similar_groups(docs).collect()}
    key = [(d, hashlib.md5((t or "").encode()).digest()) for d, t in rows]
    mine = [of[k] for k in key]
    assert sum(mine[i] == mine[j] for i, j in pairs) >= least * len(pairs)
    whole = collections.defaultdict(set)
    for m, e in zip(mine, exact, strict=True):
        whole[m].add(e)
    assert all(len(x) == 1 for x in whole.values())
    best = {}
    for m, (d, t) in zip(mine, key, strict=True):
        best[m] = min(best.get(m, (True, 0, b"")), (d is None, d or 0, t)) if m in best else (d is None, d or 0, t)
    left = corpus_pipeline.near(spark, docs, "")
    assert left.columns == docs.columns
    got = collections.Counter((r.doc_id is None, r.doc_id or 0, hashlib.md5((r.text or "").encode()).digest()) for r in left.collect())
    assert got == collections.Counter(best.values())
    return docs


def test_pairs_of_the_similarity(spark, monkeypatch):
    """Also: repeated rows, an id with texts of two groups, null ids, and all bounds at nothing."""
    rows = corpus()
    rows += [rows[20], rows[20], (5000, rows[21][1]), (5000, rows[30][1]), (5000, "a text of its own " * 3)]
    docs = check(spark, rows, 0.97)
    assert near_dedup.drop_similar(docs.limit(0)).count() == 0
    monkeypatch.setattr(near_dedup, "BROADCAST_TEXTS", 0)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(near_dedup, "PER_BUCKET", 3)
    check(spark, rows, 0.97)


def test_large_group_of_near_copies(spark):
    """Copies of one text that are near copies of it, hardly of one another."""
    rnd = random.Random(3)
    base = [f"w{rnd.randrange(10**6)}" for _ in range(120)]
    rows = [(0, " ".join(base))]
    for k in range(1, 500):
        copy = list(base)
        for at in rnd.sample(range(len(copy)), 2):
            copy[at] = f"x{rnd.randrange(10**6)}"
        rows.append((k, " ".join(copy)))
    check(spark, rows, 0.97)


def test_middle_of_a_block_is_compared():
    """A block with a large family gives pairs in proportion to its rows, and the middle row has a pair with every other."""
    rnd = np.random.default_rng(1)
    check = np.full((1000, 1), rnd.integers(2**63), np.uint64)
    for i in range(1, 1000):
        for b in rnd.choice(64, 8, replace=False):
            check[i, 0] ^= np.uint64(1) << np.uint64(b)
    bucket = simhash._Bucket(20, False)
    bucket.add((7, 0), np.arange(1000), check)
    bucket.close()
    a, b = (x.to_pylist() for x in bucket.given()[:2])
    pairs = set(zip(a, b, strict=True))
    assert (None, None) in pairs  # pairs were left out here
    pairs.discard((None, None))
    assert {(i, 0) for i in range(1, 1000)} <= pairs and len(pairs) < 1000 * (simhash.MIDDLE + simhash.NEAREST)


def test_pairs_left_out_of_large_groups_are_found_after_all(spark):
    """Groups count as large from two near rows on and give next to no pairs; the second pass makes up for it."""
    rows = corpus()
    pairs, _, exact = exact_groups(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).cache()
    roots = lambda family: {bytes(r["__t"]): r["__root"] for r in near_dedup.similar_groups(docs, family=family).collect()}
    usual, cut = roots((10**6, 3, 3)), roots((0, 0, 1))
    assert usual == cut


def test_apart_pairs(spark):
    """Profiles leave out only pairs that are under the share; without a share all near pairs are given."""
    rnd = np.random.default_rng(4)
    base = rnd.integers(0, 2**62, 8)
    rows, sets = [], {}
    for k in range(350):
        node = k if k < 300 else 1000 + k
        sets[node] = set(rnd.choice(300, rnd.integers(5, 40), replace=False).tolist()) if k % 3 else set(range(k % 7, 30 + k % 5))
        held = np.zeros(128, bool)
        held[[x % 128 for x in sets[node]]] = True
        near = (int(k % 3), node, int(rnd.integers(0, 4)), int(base[k % 8] ^ (1 << int(rnd.integers(0, 60)))), int(base[k % 5])) if k < 300 else (9, node, 7, 1, 1)
        rows.append((*near, len(sets[node]), bytearray(np.packbits(held).tobytes())))
    df = spark.createDataFrame(rows, "__bucket long, __node long, __root long, __x long, __y long, __n long, __map binary")
    want = {(max(a[1], b[1]), min(a[1], b[1])) for a in rows for b in rows if a[1] < b[1] and a[0] == b[0] and a[2] != b[2] and (a[3] ^ b[3]).bit_count() + (a[4] ^ b[4]).bit_count() <= 20}
    similar = {(a, b) for a, b in want if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    assert similar and len(similar) < len(want) / 2
    for block in (7, 4096):
        pairs = lambda share, block=block: [(r.a, r.b) for r in simhash.apart_pairs(df, 20, ("__x", "__y"), share, block).collect()]
        every, some = pairs((0, 1)), pairs((4, 5))
        assert set(every) == want and len(every) == len(want)
        assert similar <= set(some) <= want and len(some) < len(want) / 2
    assert simhash.apart_pairs(df.limit(0), 20, ("__x", "__y")).collect() == []
    assert {r["__bucket"] for r in simhash.in_several_groups(df).collect()} == {0, 1, 2}


def test_recall_on_the_given_documents(spark):
    """All pairs of five-word shingles with a Jaccard similarity of 0.8 or more, by an inverted index over the shingles."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = sorted({r.text or "" for r in docs.collect()})
    sets = [grams(t) for t in texts]
    where, shared = collections.defaultdict(list), collections.Counter()
    for k, s in enumerate(sets):
        for g in s:
            where[g].append(k)
    for ks in where.values():
        shared.update((i, j) for n, i in enumerate(ks) for j in ks[n + 1 :])
    pairs = [(i, j) for (i, j), n in shared.items() if n >= 0.8 * (len(sets[i]) + len(sets[j]) - n)]
    root = {bytes(r["__t"]): r["__root"] for r in near_dedup.similar_groups(docs).collect()}
    mine = [root[hashlib.md5(t.encode()).digest()] for t in texts]
    assert len(pairs) > 4 and sum(mine[i] == mine[j] for i, j in pairs) >= 0.9 * len(pairs)
