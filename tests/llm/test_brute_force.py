"""Every operator against a plain Python version on a small corpus with copies, nulls, ties and repeated rows."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup, line_dedup, mixing, packing, quality, sharding, simhash, suffix_dedup, toxicity, url_filter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKENS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Output columns of some operator, as extra input columns.
CLASH = "kept boolean, size long, shard int, target double, host string, component_id long"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def corpus():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 8))) for _ in range(90)]
    line = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = line(60)
    texts = [None, "", " \n\t", "One", "one", "a b", "x\ny\nx\n x", "Ü ü É", "# $ % & x y z w v u t"]
    for k in range(70):
        t = "\n".join(line(rnd.randint(3, 40)) for _ in range(rnd.randint(1, 6)))
        texts.append(t)
        if k % 5 == 0:
            texts += [t, t.upper(), t.replace(" ", "  ", 1), t + " end"]
        if k % 6 == 0:
            texts.append(line(5) + passage + "\n" + line(9))
    texts.append(" ".join(rnd.choice(words) for _ in range(30_000)))
    texts.append("spam " * 3000)
    rows = [(i, t, f"s{i % 4}" if i % 7 else None) for i, t in enumerate(texts)]
    return rows + [rows[12], rows[12], rows[0], (None, "no id", "s1"), (None, "no id", "s1"), (None, "one", None), (3, "second text of this id", "s2")]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    df = df.withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in CLASH.split(", ")})
    return df.repartition(5).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def test_url_filter(spark, empty):
    rules = [("com", "/", "allow"), ("Example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es", "block"), ("a.net", "/", "block"), ("a.net", "", "allow")]
    urls = ["http://example.com/en/x?q", "https://WWW.Example.com/en/", "http://example.com", "http://example.com/en", "x", None, "", "://", "http://b.net/esx#f", "http://a.net", "http://a.net/", "http://xcom/", "http://com/", "ftp://u@c.a.net:80/es", "http://a.net?/", "http://x.net/" + "d/" * 3000, "http://example.com/en/x?q"]
    pages = spark.createDataFrame([(i % 15, u, "h") for i, u in enumerate(urls)], "page_id long, url string, host string")
    df = spark.createDataFrame(rules, "host string, path string, verdict string")
    want = []
    for i, u in enumerate(urls):
        h = p = ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1], re.S)
            h, p = low(m[1]), m[2]
        fit = [(len(a + b), len(a), v == "block", low(a) + b, v) for a, b, v in rules if h and (h == low(a) or h.endswith("." + low(a))) and p.startswith(b)]
        want.append((i % 15, h, p, max(fit)[3], max(fit)[4]) if fit else (i % 15, h, p, None, "allow"))
    assert sorted(map(tuple, url_filter.url_filter(pages, df).collect()), key=repr) == sorted(want, key=repr)
    none = url_filter.url_filter(pages.limit(0), df)
    assert none.count() == 0 and none.columns == ["page_id", "host", "path", "rule", "verdict"]
    assert {r.verdict for r in url_filter.url_filter(pages, df.limit(0)).collect()} == {"allow"}


def measures(t):
    t = t or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = collections.Counter(grams)
    again = {j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


def test_quality(docs, empty):
    out = quality.quality_rules(docs)
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out.collect())
    want = []
    for d, t, _ in ROWS:
        m = measures(t)
        want.append((d is None, d or 0, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    assert got == sorted(want)
    table = {r.name: r for r in quality.ablations(quality.ledger(docs), quality.POLICIES["v1"]).collect()}
    assert table["few_words"].documents == len(ROWS) and table["few_words"].failed == sum(m[0] < 10 for m in (measures(t) for _, t, _ in ROWS))
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and good.count() == out.where("kept").count()
    assert quality.quality_rules(empty).count() == 0 and quality.keep_good(empty).count() == 0


def test_exact_dedup(docs, empty):
    groups = collections.defaultdict(list)
    for d, t, _ in ROWS:
        groups[low(t)].append(d)
    best = {k: max((x for x in v if x is not None), default=None) for k, v in groups.items()}
    out = exact_dedup.exact_dedup(docs, digests=True).collect()
    want = collections.Counter((d, best[low(t)], len(groups[low(t)]), hashlib.sha256(low(t).encode()).hexdigest()) for d, t, _ in ROWS)
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in out) == want
    kept = collections.Counter(r.text_sha256 for r in out if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in out if r.kept)
    plain = exact_dedup.exact_dedup(docs).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in plain) == collections.Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in out)
    left = exact_dedup.drop_exact_copies(docs)
    assert left.columns == docs.columns
    assert collections.Counter((r.doc_id, low(r.text)) for r in left.collect()) == collections.Counter((best[k], k) for k in groups)
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0


def test_exact_dedup_beyond_the_broadcast_bound(docs, monkeypatch):
    want = sorted(map(repr, exact_dedup.exact_dedup(docs).collect()))
    monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", 0)
    assert sorted(map(repr, exact_dedup.exact_dedup(docs).collect())) == want
    assert exact_dedup.drop_exact_copies(docs).count() == len({low(t) for _, t, _ in ROWS})


def fingerprint(t):
    w = WORD.findall(low(t))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) > 2 else [" ".join(w)] if w else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            votes[b] += h >> b & 1
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles))


def test_simhash(docs, empty):
    prints = [fingerprint(t) for _, t, _ in ROWS]
    root = list(range(len(ROWS)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ROWS)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    lowest = {}
    for i, (d, _, _) in enumerate(ROWS):
        if d is not None:
            lowest[find(i)] = min(lowest.get(find(i), d), d)
    want = collections.Counter((d, f"{prints[i]:016x}", lowest.get(find(i))) for i, (d, _, _) in enumerate(ROWS))
    assert collections.Counter(map(tuple, simhash.simhash_groups(docs).collect())) == want
    assert simhash.simhash_groups(empty).count() == 0


@pytest.mark.parametrize("n", [10, 300_000, 10**11])
def test_pigeonhole_finds_every_pair(n):
    """Whatever thresholds the costs lead to, a pair within the distance meets in some probe."""
    rnd = random.Random(n)
    both = np.full((64, 64), n / 4)
    np.fill_diagonal(both, n / 2)
    plan = simhash.allocate(both, n, 2)
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a
        for bit in rnd.sample(range(64), rnd.randint(0, 2)):
            b ^= 1 << bit
        assert any(all(sum((a ^ b) >> x & 1 for x in bits) <= t for bits, t in probe) for probe in plan)


def test_components(spark):
    from tidemark.llm.graph import components

    rnd = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(200, x) for x in range(201, 260)] + [(rnd.randint(300, 400), rnd.randint(300, 400)) for _ in range(60)] + [(5, 5)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    out = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    alone = {a for a, b in edges if a == b}
    assert out == {x: find(x) for x in root if x in out} and set(root) - set(out) <= alone


def test_suffix_dedup_beyond_the_broadcast_bounds(docs, monkeypatch):
    rows = lambda: sorted((repr(r.doc_id), repr(r.spans), bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, length=100).collect())
    want = rows()
    monkeypatch.setattr(suffix_dedup, "BROADCAST_GRAMS", 0)
    monkeypatch.setattr(suffix_dedup, "BROADCAST_SPANS", 0)
    assert rows() == want and any("Row" in x for _, x, _ in want)


def test_suffix_dedup(docs, empty):
    texts = [(d, (t or "").encode()) for d, t, _ in ROWS]
    for length, family in ((200, 50_000), (200, 2), (70, 50_000)):
        seen = collections.Counter(b[i : i + length] for _, b in texts for i in range(len(b) - length + 1))
        want = collections.Counter()
        for d, b in texts:
            gone = np.zeros(len(b) + 1, bool)
            for i in range(len(b) - length + 1):
                if seen[b[i : i + length]] > 1:
                    gone[i : i + length] = True
            gone = gone[: len(b)]
            starts = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0
            want[d, len(b), starts, np.frombuffer(b, np.uint8)[~gone].tobytes()] += 1
        out = suffix_dedup.remove_repeats(docs, length=length, gram=min(64, length // 2), largest_family=family).collect()
        assert collections.Counter((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in out) == want
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_repeated_windows():
    rnd = random.Random(6)
    middle = bytes(rnd.randrange(97, 123) for _ in range(10))
    wholes = [bytes(rnd.choice(b"ab") for _ in range(9)) + middle + bytes(rnd.choice(b"ab") for _ in range(9)) for _ in range(60)]
    family = []
    for k, whole in enumerate(wholes + wholes[:5]):
        low, high = sorted((rnd.randint(0, 9), rnd.randint(0, 9)))
        family.append((k, low, high, whole[9 - high : 9], whole[9 : 9 + 20 - low]))
    windows = lambda m: {o: (m[3] + m[4])[len(m[3]) - o : len(m[3]) - o + 20] for o in range(m[1], m[2] + 1)}
    seen = collections.Counter((o, w) for m in family for o, w in windows(m).items())
    want = {(m[0], o) for m in family for o, w in windows(m).items() if seen[o, w] > 1}
    spans = list(suffix_dedup.repeated_windows([m for m in family], 20))
    assert {(k, o) for k, a, b in spans for o in range(a, b + 1)} == want and 0 < len(want) < sum(m[2] - m[1] + 1 for m in family)
    assert len(spans) == sum((k, o - 1) not in want for k, o in want)


def test_loser_tree_and_front_coding():
    rnd = random.Random(2)
    words = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(0, 12))) for _ in range(400)]
    runs = [sorted(words[i::7]) for i in range(7)] + [[]]

    def read(run):
        shared, rest = suffix_dedup.front_code(run)
        last = b""
        for n, r in zip(shared, rest, strict=True):
            last = last[:n] + r
            yield n, last, None

    merged = [(n, s) for n, s, _ in suffix_dedup.LoserTree([read(r) for r in runs])]
    assert [s for _, s in merged] == sorted(words)
    for (_, a), (n, b) in zip(merged, merged[1:], strict=False):
        assert n == suffix_dedup.common(a, b, 0)
    assert list(suffix_dedup.LoserTree([iter([])])) == []


def test_least_in_window():
    rnd = np.random.default_rng(3)
    for n, w in ((1, 1), (7, 7), (50, 7), (64, 8), (200, 137)):
        h = rnd.integers(0, 9, n).astype(np.uint64)
        assert suffix_dedup.least_in_window(h, w).tolist() == [i + int(np.argmin(h[i : i + w])) for i in range(n - w + 1)]


def test_packing(spark, docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENS[0])
    for window, rows in ((2048, docs), (64, docs), (2048, docs.withColumn("source", F.concat(F.lit("own"), F.monotonically_increasing_id())))):
        out = [r.asDict() for r in packing.pack_documents(rows, *TOKENS, window=window).collect()]
        ids = collections.Counter()
        for d, t, _ in ROWS:
            ids[d, tuple([*tok.encode(t or "", add_special_tokens=False).ids, 1])] += 1
        total = sum(len(s) * n for (_, s), n in ids.items())
        by_seq = collections.defaultdict(list)
        for r in out:
            by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
            assert r["length"] > 0
        assert sorted(by_seq) == list(range(-(-total // window)))
        for k, parts in by_seq.items():
            at = 0
            for off, n in sorted(parts):
                assert off == at
                at += n
            assert at == (window if k < len(by_seq) - 1 else total - window * (len(by_seq) - 1))
        pieces = collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out)
        lengths = collections.Counter()
        for (d, start, n, crc, size), k in pieces.items():
            assert any(dd == d and len(s) == size and zlib.crc32(np.array(s[start : start + n], "<u4").tobytes()) == crc for dd, s in ids)
            lengths[d] += n * k
        assert lengths == collections.Counter({d: sum(len(s) * n for (dd, s), n in ids.items() if dd == d) for d, _ in ids})
    assert packing.pack_documents(empty, *TOKENS).count() == 0


def test_packing_keeps_the_mix(docs):
    rows = docs.where("doc_id is not null")
    shares, mix = collections.Counter(), collections.defaultdict(collections.Counter)
    source = {r.doc_id: r.source for r in rows.collect()}
    for r in packing.pack_documents(rows.where("doc_id <> 12 and doc_id <> 3"), *TOKENS, window=512).collect():
        shares[source[r.doc_id]] += r.length
        mix[r.sequence_id][source[r.doc_id]] += r.length
    total = sum(shares.values())
    for k in range(len(mix) - 1):
        for s, n in shares.items():
            assert abs(mix[k][s] - 512 * n / total) <= 2


def test_encode_matches_the_tokenizers_library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(TOKENS[0])
    for t in ("", " ", "a  b\n\n c\t", "it's we'll", "<|endoftext|> x", "é 你好 🎉", " x y", "x" * 5000, "12345 $$$"):
        assert packing.encode(t, *TOKENS).tolist() == [*tok.encode(t, add_special_tokens=False).ids, 1]


def fits(w, v):
    if w == v:
        return True
    if abs(len(w) - len(v)) > 1 or max(len(w), len(v)) < 5:
        return False
    if len(w) == len(v):
        return sum(a != b for a, b in zip(w, v, strict=True)) <= 1
    a, b = sorted((w, v), key=len)
    return any(a == b[:i] + b[i + 1 :] for i in range(len(b)))


def test_line_dedup(spark, empty):
    rnd = random.Random(8)
    words = "a b c d e f".split()
    base = [[rnd.choice(words) for _ in range(rnd.randint(1, 9))] for _ in range(25)]
    texts = []
    for k in range(40):
        lines = []
        for w in rnd.sample(base, 3):
            w = list(w)
            if w and rnd.random() < 0.6:
                i = rnd.randrange(len(w))
                w[i : i + 1] = rnd.choice([[], ["new"], [w[i], "x"]])
            lines.append(("  " if rnd.random() < 0.2 else " ").join(w) if rnd.random() < 0.9 else " ".join(w).upper())
        texts.append((k, "\n".join(lines)))
    texts += [(100, None), (101, ""), (102, "\n \n"), (103, " ".join(words * 3000)), (104, " ".join(words * 3000) + " tail"), (None, "a b c d e f"), (5, texts[5][1])]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    order, want = [], collections.Counter()
    for d, t in {(d, t): 0 for d, t in texts}:
        order += [((d is None, d or 0, i), d, x.split()) for i, x in enumerate((t or "").lower().split("\n")) if x.split()]
    order.sort(key=lambda x: x[0])
    for k, (key, d, w) in enumerate(order):
        hit = next((order[j] for j in range(k) if fits(w, order[j][2])), None)
        want[d, key[2], hit is None, hit and hit[1], hit and hit[0][2]] += 2 if d == 5 else 1
    assert collections.Counter(map(tuple, line_dedup.near_lines(df).collect())) == want
    assert line_dedup.near_lines(empty).count() == 0


def test_mixing(docs, empty):
    size = lambda t: len(WORD.findall(t or ""))
    sizes = collections.Counter()
    for _, t, s in ROWS:
        sizes[s] += size(t)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] > 2 * sizes[s]}
        if not full:
            target |= {s: unit * weight[s] for s in open_}
            break
        target |= {s: 2 * sizes[s] for s in full}
        left -= sum(target[s] for s in full)
        open_ -= full
    out = mixing.mix_sources(docs.withColumn("s", F.col("source")))
    rows = out.collect()
    assert collections.Counter((r.doc_id, r.size) for r in rows) == collections.Counter((d, size(t)) for d, t, _ in ROWS)
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    by_target = {round(t, 6): s for s, t in target.items()}
    taken = collections.Counter()
    for r in rows:
        s = by_target[round(r.target, 6)]
        taken[s] += r.taken
        assert r.source_size == sizes[s]
    assert all(abs(taken[s] - target[s]) < 1 for s in order)
    assert sorted(map(repr, rows)) == sorted(map(repr, mixing.mix_sources(docs.repartition(3)).collect()))
    whole = mixing.mix_documents(docs)
    assert whole.columns == docs.columns
    most = max(size(t) for _, t, _ in ROWS)
    got = collections.Counter()
    for r in whole.collect():
        got[r.source] += size(r.text)
    assert all(abs(got[s] - target[s]) <= most for s in order)
    assert mixing.mix_sources(empty).count() == 0 and mixing.mix_documents(empty).count() == 0


def test_flow_prefers_fresh_words_and_reroutes():
    """Words of a source that another pattern shares go where nothing else can."""
    flow = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 20}, {"a": 150, "b": 70}, 2)
    assert flow[("a",)]["a"] == 100 and flow[("a", "b")] == {"a": 50, "b": 50} and flow[("b",)]["b"] == 20
    flow = mixing.route({("a",): 10, ("a", "b"): 100}, {"a": 60, "b": 100}, 2)
    assert sum(sum(f.values()) for f in flow.values()) == 160 and flow[("a",)]["a"] <= 20


def test_sharding(docs, empty):
    out = sharding.shard_documents(docs, 40, 41).collect()
    assert collections.Counter((r.doc_id, r.size, r.text_crc32) for r in out) == collections.Counter((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in ROWS)
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert len({(r.doc_id, r.shard) for r in out}) == len({r.doc_id for r in out})
    assert sharding.shard_documents(empty, 40).count() == 0


def test_shards_only_grow_into_the_new_one(spark):
    ids = spark.range(40_000).withColumn("k", F.col("id").cast("string"))
    for n in (40, 43):
        df = sharding.assign(sharding.assign(ids, "k", sharding.tree(n, 40), "a"), "k", sharding.tree(n + 1, 40), "b")
        moved = df.where("a <> b").agg(F.count("id"), F.min("b"), F.max("b")).head()
        assert moved[1] == moved[2] == n and 0.5 < moved[0] * (n + 1) / 40_000 < 1.5
    counts = [r["count"] for r in sharding.assign(ids, "k", sharding.tree(40), "a").groupBy("a").count().collect()]
    assert len(counts) == 40 and max(counts) < 1.3 * min(counts)


def test_toxicity(spark, empty):
    rnd = random.Random(4)
    words = ["".join(rnd.choice("aeinorst") for _ in range(rnd.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(900):
        w = [rnd.choice(words) for _ in range(rnd.randint(20, 200))]
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            w.insert(rnd.randrange(len(w)), rnd.choice(["moron", "scumbag", "vequ" + rnd.choice(words)]))
        rows.append((i, " ".join(w), "x"))
        labels.append((i, int(toxic)))
    rows += [(2000, None, "x"), (2001, "", "x"), (2002, "moron " * 30_000, "x"), (None, "moron", "x"), (0, rows[0][1], "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    model = toxicity.fit_toxicity(docs, spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int"))
    out = toxicity.score_toxicity(docs, model).collect()
    assert len(out) == len(rows)
    truth = dict(labels)
    for r in out:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.98
    by = {r.doc_id: r for r in out}
    assert by[2000].score == by[2001].score < 0.3 < by[2002].score
    blank = toxicity.fit_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.predicted for r in toxicity.score_toxicity(docs, blank).collect()} == {0}
    assert toxicity.score_toxicity(empty.select("doc_id", "text"), model).count() == 0


def test_grammar_tells_clause_kinds_apart():
    key = (("idiot$", 2.0),)
    kinds = lambda t: {toxicity.PARTS[i]: w for i, w in enumerate(toxicity.clause_weights(t, key)) if w}
    assert kinds("You are an idiot!") == {"insult:all": 2.0, "insult:aimed": 2.0}
    assert kinds("Such idiots. An idiot.") == {"insult:all": 2.0}
    assert kinds("You are not an idiot") == {"insult:all": 2.0, "insult:aimed": 2.0, "insult:negated": 2.0}
    assert kinds("You are an idiot and not nice") == {"insult:all": 2.0, "insult:aimed": 2.0}
    assert kinds("He is not nice but an idiot") == {"insult:all": 2.0}
    assert kinds("not one of all those long and many words idiot") == {"insult:all": 2.0}
    assert kinds("the paper said idiot") == {"insult:all": 2.0, "insult:reported": 2.0}
    assert kinds("idiot said the paper") == {"insult:all": 2.0}
    assert kinds("I will kill you, idiot") == {"threat:all": 1.0, "threat:aimed": 1.0, "insult:all": 2.0}
    assert kinds("A calm day.") == {}


def plain_clause(words):
    """Each match with its marks, by looking back and ahead from it."""
    out = []
    for i, w in enumerate(words):
        if w not in ("insult", "threat"):
            continue
        marks = set()
        aim = next((j for j in range(i - 1, -1, -1) if words[j] in ("target", "break")), -1)
        if aim >= 0 and words[aim] == "target" and sum(x in ("other", "negation", "reported") for x in words[aim + 1 : i]) < 6:
            marks.add("aimed")
        if not marks:
            for j in range(i + 1, len(words)):
                if words[j] in ("insult", "threat", "break") or sum(x in ("other", "negation", "reported") for x in words[i + 1 : j]) >= 3:
                    break
                if words[j] == "target":
                    marks.add("aimed")
                    break
        no = next((j for j in range(i - 1, -1, -1) if words[j] in ("negation", "break")), -1)
        if no >= 0 and words[no] == "negation" and words[no + 1 : i].count("other") < 4:
            marks.add("negated")
        if "reported" in words[:i]:
            marks.add("reported")
        out.append((w, marks))
    return out


def test_grammar_against_a_plain_clause_reader():
    rnd = random.Random(12)
    weights = dict(zip(toxicity.LABELS, (2, 2, 3, 2, 1, 1, 1, 8), strict=True))
    for _ in range(4000):
        words = rnd.choices(list(weights), weights.values(), k=rnd.randint(1, 16))
        got = [(label, marks) for label, _, marks in toxicity.parse_clause((w, 1.0) for w in words)]
        assert got == plain_clause(words), words


def test_reported_and_negated_matches_lose_weight_without_examples():
    """No labelled row has a negated or reported insult: such a text scores below a plain one and above none."""
    rnd = random.Random(2)
    x, y = [], []
    for i in range(400):
        bad = i % 4 == 0
        row = np.zeros(len(toxicity.PARTS))
        row[0] = row[1] = rnd.uniform(2, 4) * bad
        x.append(row)
        y.append(float(bad))
    w = toxicity.fit_parts(np.array(x), np.array(y))
    score = lambda **parts: float(toxicity._features(np.array([[parts.get(p.replace(":", "_"), 0.0) for p in toxicity.PARTS]]))[0] @ w[:-1] + w[-1])
    plain, none = score(insult_all=3, insult_aimed=3), score()
    for mark in ("insult_negated", "insult_reported"):
        assert none < score(insult_all=3, insult_aimed=3, **{mark: 3}) < plain
