"""Repeated word windows by backward search in compressed indexes (operator 12)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import text_of
from tidemark.llm.suffix_dedup import least_in_window
from tidemark.session import cut_lineage, ship_package

#: Words of the grams whose least hash picks the stretch that a window belongs to.
GRAM = 6
#: Words of an index, about; more occurrences of one gram are dealt out window by window.
SHARD_WORDS, LARGE = 400_000, 20_000
#: Bits of each of the two filters, in segments; 32 MB each, at every size of the input.
FILTER_BITS, SEGMENT_BITS = 28, 18
#: Bytes and words hashed at once; stretches that wait to be combined in a task.
BYTES, WORDS, WAITING = 1 << 22, 1 << 20, 100_000
#: Null ids count as the largest.
NO_ID = 2**63 - 1
BASE = 0x9E3779B97F4A7C15
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


class WaveletMatrix:
    """A sequence of small integers as one bit vector per binary digit, with counts of ones before every 64 bits."""

    def __init__(self, s: np.ndarray, sigma: int):
        self.levels = []
        for bit in reversed(range(max(1, (sigma - 1).bit_length()))):
            ones = ((s >> bit) & 1).astype(bool)
            words = np.packbits(np.append(ones, np.zeros(-len(ones) % 64 + 64, bool)), bitorder="little").view(np.uint64)
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.levels.append((bit, words, before, len(ones) - int(ones.sum())))
            s = np.concatenate([s[~ones], s[ones]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often each symbol of ``c`` stands before the place in ``i``, for all pairs at once."""
        start = np.zeros(len(i), np.int64)
        for bit, words, before, zeros in self.levels:
            up = ((c >> bit) & 1).astype(bool)
            places = np.concatenate([start, i])
            at = places >> 6
            ones = before[at] + np.bitwise_count(words[at] & ((np.uint64(1) << (places & 63).astype(np.uint64)) - np.uint64(1)))
            s, e = ones[: len(i)], ones[len(i) :]
            start, i = np.where(up, zeros + s, start - s), np.where(up, zeros + e, i - e)
        return i - start


def sort_suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order, by doubling, and for every place of that order whether its first ``depth`` symbols differ from those of the place before."""
    n, h = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    deep, done = np.zeros(n, np.int64), 0
    while True:
        if depth & h:  # the wanted depth is put together from powers of two
            at = np.arange(n) + done
            key = deep * (n + 1) + np.where(at < n, rank[np.minimum(at, n - 1)] + 1, 0)
            deep, done = np.unique(key, return_inverse=True)[1].astype(np.int64), done + h
        if h > depth and rank.max() == n - 1:
            break
        ahead = np.zeros(n, np.int64)
        ahead[: max(0, n - h)] = rank[h:] + 1
        key = rank * (n + 1) + ahead
        order = np.argsort(key)
        key = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], key[1:] != key[:-1]]))
        h *= 2
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    return order, np.concatenate([[True], deep[order][1:] != deep[order][:-1]])


class FMIndex:
    """Backward search in a collection of texts: symbols from 1, every text followed by 0.

    A place of suffix order also knows its block: the places that share their first ``length`` symbols.
    So a match that has grown past ``length`` falls back to exactly that many, which keeps the
    matching statistics of a long text at one step a symbol.
    """

    def __init__(self, texts: list[np.ndarray], sigma: int, length: int):
        text = np.concatenate([np.append(t, 0) for t in texts])
        self.length = length
        self.order, new = sort_suffixes(text, length)
        self.starts = np.flatnonzero(new)
        self.block = np.cumsum(new) - 1
        self.ends = np.append(self.starts[1:], len(text))
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.bwt = WaveletMatrix(text[self.order - 1], sigma)

    def matching_statistics(self, texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text, place, symbols matched there, block or -1) for all places, from the last to the first of all texts at once.

        Matched is the length of the longest string that starts at the place and is in the index, but
        at most ``length``; the block is given where it is ``length``.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        flat, offset = np.concatenate([*texts, np.zeros(0, np.int64)]), np.concatenate([[0], np.cumsum(sizes)])
        n = len(self.block)
        lo, hi, depth = np.zeros(len(texts), np.int64), np.full(len(texts), n), np.zeros(len(texts), np.int64)
        for step in range(1, int(sizes.max(initial=0)) + 1):
            live = np.flatnonzero(sizes >= step)
            at = sizes[live] - step
            c = flat[offset[live] + at]
            l, h = self._extend(c, lo[live], hi[live])
            depth[live] += 1
            for j in np.flatnonzero(l >= h):  # a symbol that the index has not after this one: shorten the match from its end
                d, base = int(depth[live[j]]), offset[live[j]] + at[j]
                while l[j] >= h[j] and d:
                    d -= 1
                    l[j], h[j] = self._find(flat[base : base + d])
                depth[live[j]] = d
            full = depth[live] >= self.length
            whole = self.block[np.minimum(l, n - 1)]
            lo[live], hi[live] = np.where(full, self.starts[whole], l), np.where(full, self.ends[whole], h)
            depth[live] = np.minimum(depth[live], self.length)
            yield live, at, depth[live].copy(), np.where(full, whole, -1)

    def _extend(self, c: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        known = c < len(self.before) - 1
        c = np.where(known, c, 0)
        both = self.bwt.rank(np.concatenate([c, c]), np.concatenate([lo, hi])) + np.concatenate([self.before[c]] * 2)
        return both[: len(c)], np.where(known, both[len(c) :], 0)

    def _find(self, pattern: np.ndarray) -> tuple[int, int]:
        lo, hi = np.zeros(1, np.int64), np.full(1, len(self.block))
        for c in pattern[::-1]:
            lo, hi = self._extend(np.array([c]), lo, hi)
        return int(lo[0]), int(hi[0])


def words_at(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of UTF-8 bytes start and end."""
    inside = np.concatenate([[False], ~SPACE[data], [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every word, from prefix sums of a polynomial over some MB of bytes at a time."""
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        base = int(starts[k])
        to = max(k + 1, int(np.searchsorted(ends, base + BYTES, "right")))
        part = data[base : int(ends[to - 1])].astype(np.uint64)
        up, down = powers(max(BYTES, len(part)) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * up[: len(part)], out=sums[1:])
        s, e = starts[k:to] - base, ends[k:to] - base
        h = (sums[e] - sums[s]) * down[s]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        out[k:to] = h ^ (h >> np.uint64(29))
        k = to
    return out


_POWERS: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        run = lambda x: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x, np.uint64))])
        _POWERS[:] = [run(BASE), run(pow(BASE, -1, 1 << 64))]
    return _POWERS[0], _POWERS[1]


def stretches(data: np.ndarray, text_ends: np.ndarray, length: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first window, windows, gram hash, first byte, last byte) of runs of windows that share their gram of least hash.

    Texts are laid end to end; places are words of the text. The choice depends on the window's words
    only, so equal windows have the same gram at the same distance.
    """
    starts, ends = words_at(data)
    cut = np.searchsorted(ends, text_ends, "right")  # words before the end of each text; a word that crosses a text's end is told apart below
    if len(starts) and len(text_ends):
        inner = text_ends[:-1]
        k = np.searchsorted(starts, inner, "left") - 1
        k = np.unique(k[(k >= 0) & (ends[np.maximum(k, 0)] > inner)])
        if len(k):  # the last word of a text runs into the first of the next
            lo, hi = np.searchsorted(inner, starts[k], "right"), np.searchsorted(inner, ends[k], "left")
            extra = np.unique(np.concatenate([inner[a:b] for a, b in zip(lo, hi)]))
            starts, ends = np.sort(np.concatenate([starts, extra])), np.sort(np.concatenate([ends, extra]))
            cut = np.searchsorted(ends, text_ends, "right")
    base = np.concatenate([[0], cut[:-1]])
    h = word_hashes(data, starts, ends)
    factors = [np.uint64(pow(BASE, 2 * j + 3, 1 << 64)) for j in range(gram)]
    last = len(h) - length + 1
    for at in range(0, max(last, 0), WORDS):
        w = h[at : min(at + WORDS, last) + length - 1]
        g = np.zeros(len(w) - gram + 1, np.uint64)
        for j, f in enumerate(factors):
            g += w[j : len(w) - gram + 1 + j] * f
        g ^= g >> np.uint64(31)
        g *= np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(32)
        owner = least_in_window(g, length - gram + 1)
        first = np.arange(at, at + len(owner))
        text = np.searchsorted(cut, first, "right")
        fits = first + length <= cut[np.minimum(text, len(cut) - 1)]
        owner, first, text = owner[fits], first[fits], text[fits]
        if not len(owner):
            continue
        begin = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])]))
        stop = np.append(begin[1:], len(owner)) - 1
        yield text[begin], first[begin] - base[text[begin]], stop - begin + 1, g[owner[begin]], starts[first[begin]], ends[first[stop] + length - 1]


def laid_out(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end, and where each text ends."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def _gram_counts(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """(__gram, __n): how many stretches every gram has, counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [g for *_, g, _, _ in stretches(*laid_out(b.column(0)), length, gram)]
            g, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *got]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n.astype(np.int32))], names=["__gram", "__n"])

    counts = docs.select("__text").mapInArrow(run, "__gram long, __n int")
    return counts.groupBy("__gram").agg(F.sum("__n").alias("__n")).where("__n > 1")


def _filters(grams: DataFrame, bits: int, large: int) -> tuple[np.ndarray, np.ndarray]:
    """Two bit sets of fixed size over the grams' leading bits: seen twice or more, and seen over ``large`` times.

    A gram that only shares its bits passes too: that costs a row, or more rows, never a result.
    """
    segment = min(SEGMENT_BITS, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            place = b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            many = b.column(1).to_numpy() > large
            for s in np.unique(place >> np.uint64(segment)):
                mine = place >> np.uint64(segment) == s
                set_ = made.setdefault(int(s), np.zeros((2, 1 << segment), bool))
                low = (place[mine] & np.uint64((1 << segment) - 1)).astype(np.int64)
                set_[0, low] = True
                set_[1, low[many[mine]]] = True
        for s, x in made.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(x[0]).tobytes()]), pa.array([np.packbits(x[1]).tobytes() if x[1].any() else None], pa.binary())], names=["__s", "__seen", "__many"])

    of = F.shiftrightunsigned("__gram", 64 - bits + segment).cast("int") if bits > segment else F.lit(0)
    parts = max(1, min(1 << (bits - segment), int(grams.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    out = np.zeros((2, 1 << (bits - 3)), np.uint8)
    step = 1 << (segment - 3)
    for r in grams.repartition(parts, of).mapInArrow(run, "__s int, __seen binary, __many binary").collect():
        at = slice(r["__s"] * step, (r["__s"] + 1) * step)
        out[0, at] |= np.frombuffer(bytes(r["__seen"]), np.uint8)
        if r["__many"]:
            out[1, at] |= np.frombuffer(bytes(r["__many"]), np.uint8)
    return out[0], out[1]


_STRETCH = "__shard int, __id long, __x long, __at int, __k int, __words binary"


def _routed(docs: DataFrame, seen, many, shards: int, length: int, gram: int, bits: int) -> DataFrame:
    """Stretches on their way to the shard of their gram, or of each window where the gram is very frequent.

    Equal stretches of a task are combined: the earliest goes with its words, the others are known to
    be repeated and go without, to any shard, which hands them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[bytes, tuple[int, int, int, int, int]] = {}

        def out(rows: list[tuple]) -> pa.RecordBatch:
            shard, id_, x, at, k, words = zip(*rows)
            return pa.RecordBatch.from_arrays(
                [pa.array(shard, pa.int32()), pa.array(id_, pa.int64()), pa.array(x, pa.int64()), pa.array(at, pa.int32()), pa.array(k, pa.int32()), pa.array(words, pa.binary())], names=["__shard", "__id", "__x", "__at", "__k", "__words"]
            )

        flush = lambda: out([(s, i, x, at, k, words) for words, (i, x, at, s, k) in waiting.items()])
        for b in batches:
            data, text_ends = laid_out(b.column(2))
            raw, ids, xs, again = data.tobytes(), b.column(0).to_numpy(), b.column(1).to_numpy(), []

            def add(shard: int, id_: int, x: int, at: int, k: int, words: bytes) -> None:
                old = waiting.get(words)
                new = (id_, x, at, shard, k)
                if old is None:
                    waiting[words] = new
                elif old[:3] != new[:3]:
                    late = max(old, new)
                    waiting[words] = min(old, new)
                    again.append((late[0] % shards, late[0], late[1], late[2], k, None))

            for text, at, k, g, lo, hi in stretches(data, text_ends, length, gram):
                place = (g >> np.uint64(64 - bits)).astype(np.int64)
                bit = (128 >> (place & 7)).astype(np.uint8)
                live = np.flatnonzero(seen.value[place >> 3] & bit)
                split = (many.value[place >> 3] & bit) > 0
                shard = (g * np.uint64(BASE) % np.uint64(shards)).astype(np.int64)
                for j, t, a, n, s, l, h, apart in zip(live, *(v[live].tolist() for v in (text, at, k, shard, lo, hi, split))):
                    words = raw[l:h].split()
                    if apart:
                        for w in range(n):
                            one = b" ".join(words[w : w + length])
                            add(xxhash.xxh64_intdigest(one) % shards, int(ids[t]), int(xs[t]), a + w, 1, one)
                    else:
                        add(s, int(ids[t]), int(xs[t]), a, n, b" ".join(words))
            if again:
                yield out(again)
            if len(waiting) > WAITING:
                yield flush()
                waiting.clear()
        if waiting:
            yield flush()

    return docs.mapInArrow(run, _STRETCH)


def repeated_runs(ids: np.ndarray, xs: np.ndarray, ats: np.ndarray, ks: np.ndarray, words: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, word after the last) of the repeated words of each stretch: one index over them, searched with each.

    A window is repeated if the index has it at an earlier place. Equal stretches are in the index once,
    with their earliest place, and are searched once.
    """
    by_place = np.lexsort((ats, xs, ids))
    number: dict[bytes, int] = {}
    content, heads = np.empty(len(words), np.int64), []
    for row in by_place.tolist():
        content[row] = number.setdefault(words[row], len(number))
        if content[row] == len(heads):
            heads.append(row)
    symbols: dict[bytes, int] = {}
    texts = [np.array([symbols.setdefault(w, len(symbols) + 1) for w in words[row].split(b" ")], np.int64) for row in heads]
    index = FMIndex(texts, len(symbols) + 1, length)
    heads_ = np.array(heads)
    # Every window of the index in order of its place in the documents.
    sizes = np.array([len(t) for t in texts])
    start = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    n_windows = sizes - length + 1
    owner = np.repeat(np.arange(len(texts)), n_windows)
    ahead = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    spot = np.lexsort((ats[heads_][owner] + ahead, xs[heads_][owner], ids[heads_][owner]))
    tuples = np.stack([ids[heads_][owner], xs[heads_][owner], ats[heads_][owner] + ahead], axis=1)[spot]
    rank = np.empty(len(owner), np.int64)
    rank[spot] = np.cumsum(np.concatenate([[0], (tuples[1:] != tuples[:-1]).any(1)]))
    by_text = np.full(int(start[-1] + sizes[-1] + 1), len(owner), np.int64)
    by_text[start[owner] + ahead] = rank
    earliest = np.minimum.reduceat(by_text[index.order], index.starts)
    late = np.zeros(len(owner), bool)
    window = np.cumsum(n_windows) - n_windows
    for text, at, depth, block in index.matching_statistics(texts):
        hit = depth == length
        mine = window[text[hit]] + at[hit]
        late[mine] = earliest[block[hit]] < rank[mine]
    # A row after the first of its content repeats all of it; the first one what the search has found.
    first = np.zeros(len(words), bool)
    first[heads_] = True
    place = np.stack([ids, xs, ats], axis=1)
    same = (place == place[heads_][content]).all(1)
    whole = np.flatnonzero(~first & ~same)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], late.view(np.int8), [0]])))
    a, b = edge[::2], edge[1::2] - 1
    while (over := owner[a] != owner[b]).any():  # runs that go from one stretch into the next
        j = np.flatnonzero(over)
        stop = window[owner[a[j]]] + n_windows[owner[a[j]]] - 1
        a, b = np.concatenate([a, stop + 1]), np.concatenate([np.where(over, 0, b), b[j]])
        b[j] = stop
    row = heads_[owner[a]]
    return np.concatenate([row, whole]), np.concatenate([ats[row] + ahead[a], ats[whole]]), np.concatenate([ats[row] + ahead[b] + length, ats[whole] + ks[whole] + length - 1])


def _searched(routed: DataFrame, length: int) -> DataFrame:
    """(__id, __x, __lo, __hi): repeated words found in each shard, and those known before."""

    def run(table: pa.Table) -> pa.Table:
        ids, xs, ats, ks = (table.column(c).to_numpy().astype(np.int64) for c in ("__id", "__x", "__at", "__k"))
        words = table.column("__words").to_pylist()
        open_ = np.array([w is not None for w in words], bool)
        known = np.flatnonzero(~open_)
        rows, lo, hi = known, ats[known], ats[known] + ks[known] + length - 1
        if open_.any():
            at = np.flatnonzero(open_)
            r, l, h = repeated_runs(ids[at], xs[at], ats[at], ks[at], [words[j] for j in at], length)
            rows, lo, hi = np.concatenate([rows, at[r]]), np.concatenate([lo, l]), np.concatenate([hi, h])
        return pa.table({"__id": ids[rows], "__x": xs[rows], "__lo": lo, "__hi": hi})

    return routed.groupBy("__shard").applyInArrow(run, "__id long, __x long, __lo long, __hi long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, text hash, text. The hash is 0 for ids that stand alone and tells rows of equal or null id apart."""
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("__id"), text_of(text_col).alias("__text"))
    twice = cut_lineage(rows.groupBy("__id").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(F.col("__id").alias("__i")))
    if twice.isEmpty():
        return rows.select("__id", F.lit(0).cast("long").alias("__x"), "__text")
    x = F.when(F.col("__i").isNotNull(), F.xxhash64("__text")).otherwise(F.lit(0).cast("long"))
    return rows.join(twice, rows["__id"] == twice["__i"], "left").select("__id", x.alias("__x"), "__text")


def repeated_word_spans(docs: DataFrame, length: int = 20, gram: int = GRAM, shard_words: int = SHARD_WORDS, large: int = LARGE, bits: int = FILTER_BITS) -> DataFrame:
    """(__id, __x, __spans) of the texts of (__id, __x, __text) that repeat earlier windows: word spans, unmerged."""
    spark = docs.sparkSession
    ship_package(spark)
    grams = cut_lineage(_gram_counts(docs, length, gram))
    n = grams.agg(F.sum("__n")).head()[0] or 0
    seen, many = (spark.sparkContext.broadcast(f) for f in _filters(grams, bits, large))
    shards = max(1, math.ceil(n * (length + (length - gram) // 2) / shard_words))
    found = _searched(_routed(docs.select("__id", "__x", "__text"), seen, many, shards, length, gram, bits), length)
    return cut_lineage(found.groupBy("__id", "__x").agg(F.collect_set(F.struct("__lo", "__hi")).alias("__spans")))


def remove_repeated_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20, **how) -> DataFrame:
    """Every text without the words covered by a ``length``-word window that also starts earlier.

    Earlier means a smaller id, or the same text further ahead; windows are judged on the input. Windows
    are given to their word gram of least hash, and runs of windows with the same gram make a stretch of
    the text. A filter of fixed size over the grams' hashes leaves out stretches whose gram occurs once.
    The others travel with their words to the shard of their gram, so equal windows meet there. A shard
    holds a compressed index over its stretches (Burrows-Wheeler transform under a wavelet matrix);
    streaming the stretches through it backwards gives at every word the length matched and the place in
    suffix order, hence the earliest start of that window, and the words of late windows are reported.
    Everything is compared by words, hashes only route. Grams that are very frequent are dealt out window
    by window, and equal stretches are combined in the map tasks, so that no shard outgrows its size.

    Null texts count as empty. Rows equal in id and text are one document; rows that share an id but not
    the text, and null ids, come in the order of the texts' hashes, null ids last. Ids are integers;
    other columns are ignored; an empty table gives no rows. Returns id, n_words, spans (removed word
    ranges, maximal), kept (the other words, one space between).
    """
    rows = _keyed(docs, id_col, text_col)
    spans = repeated_word_spans(rows, length, **how)
    both = rows.join(spans, ["__id", "__x"], "left").select("__id", "__text", "__spans")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, spans_, kept = [], [], []
            for text, cuts in zip(b.column(1).cast(pa.binary()), b.column(2)):
                words = text.as_py().split()
                merged: list[list[int]] = []
                for c in sorted((c["__lo"], c["__hi"]) for c in cuts.as_py() or []):
                    if merged and c[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], c[1])
                    else:
                        merged.append(list(c))
                left, at = [], 0
                for lo, hi in merged:
                    left += words[at:lo]
                    at = hi
                n.append(len(words))
                spans_.append([{"start": lo, "end": hi} for lo, hi in merged])
                kept.append(b" ".join(left + words[at:]).decode() if merged else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(spans_, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.string())], names=["__id", "n_words", "spans", "kept"])

    out = both.mapInArrow(run, "__id long, n_words long, spans array<struct<start:bigint,end:bigint>>, kept string")
    return out.select(F.when(F.col("__id") != NO_ID, F.col("__id")).cast(kind).alias(id_col), "n_words", "spans", "kept")
