"""Repeated passages by a distributed merge sort of suffixes (operator 5)."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_groups, text_of
from tidemark.session import checkpoint_path, cut_lineage, drop_table, ship_package

#: Length of the grams whose least hash picks the suffix that stands for a window.
GRAM = 64
#: Bytes hashed at once.
CHUNK = 1 << 18
#: Suffixes merged in one task, about; and suffixes that may start with the same gram there (at most
#: 350 bytes each). Larger families go another way, window by window, which no task has to hold.
PER_TASK, LARGEST_FAMILY = 60_000, 50_000
#: Suffixes of a run that travel in one row.
BLOCK = 256
#: Hashes of repeated grams, and spans, are broadcast up to these many rows; beyond, they meet places and texts in shuffles.
BROADCAST_GRAMS, BROADCAST_SPANS = 4_000_000, 1_000_000
BASE = np.uint64(0x9E3779B97F4A7C15)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    run = lambda x: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, x, np.uint64))])
    return run(BASE), run(inverse)


def gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every run of k bytes, from prefix sums of a polynomial."""
    up, down = _powers(CHUNK + 1024)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(data) - k + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def least_in_window(h: np.ndarray, w: int) -> np.ndarray:
    """The place of the leftmost smallest of every w consecutive values, in linear time by blocks."""
    m, n = len(h) - w + 1, -(-len(h) // w) * w
    x = np.full(n, np.iinfo(np.uint64).max)
    x[: len(h)] = h
    x = x.reshape(-1, w)
    place = np.arange(w, dtype=np.int32)

    def scan(y: np.ndarray, ties: bool) -> tuple[np.ndarray, np.ndarray]:
        low = np.minimum.accumulate(y, axis=1)
        new = np.ones(y.shape, bool)
        new[:, 1:] = y[:, 1:] <= low[:, :-1] if ties else y[:, 1:] < low[:, :-1]
        return low, np.maximum.accumulate(np.where(new, place, 0), axis=1)

    row = (np.arange(len(x)) * w)[:, None]
    left, at_left = scan(x, False)
    right, at_right = scan(x[:, ::-1], True)
    right, at_right = right[:, ::-1].ravel(), (row + w - 1 - at_right[:, ::-1]).ravel()
    left, at_left = left.ravel(), (row + at_left).ravel()
    return np.where(right[:m] <= left[w - 1 : w - 1 + m], at_right[:m], at_left[w - 1 : w - 1 + m])


def picked(data: np.ndarray, ends: np.ndarray, length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The suffixes that stand for windows: (place, first window, last window, gram hash) of texts laid end to end.

    Every window of ``length`` bytes is given to its gram of least hash, the leftmost such. That choice
    depends on the window's bytes only, so equal windows are given to equal suffixes at the same distance.
    """
    last = len(data) - length + 1
    for at in range(0, max(last, 0), CHUNK):
        part = data[at : min(at + CHUNK, last) + length - 1]
        h = gram_hashes(part, k)
        owner = least_in_window(h, length - k + 1)
        first = np.arange(at, at + len(owner))
        text = np.searchsorted(ends, first, "right")
        fits = first + length <= ends[np.minimum(text, len(ends) - 1)]
        owner, first, text = owner[fits], first[fits], text[fits]
        if not len(owner):
            continue
        starts = np.flatnonzero(np.concatenate([[True], (owner[1:] != owner[:-1]) | (text[1:] != text[:-1])]))
        stops = np.append(starts[1:], len(owner)) - 1
        yield owner[starts] + at, first[starts], first[stops], h[owner[starts]]


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end, and where each text ends."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets[1:] - offsets[0]


def common(a: bytes, b: bytes, at: int) -> int:
    """The length of the common prefix of two strings that agree up to ``at``."""
    n, step = min(len(a), len(b)), 8
    while at < n and a[at : at + step] == b[at : at + step]:
        at += step
        step *= 2
    if at >= n:
        return n
    hi = min(n, at + step)
    for i in range(at, hi):
        if a[i] != b[i]:
            return i
    return hi


def front_code(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Sorted strings as (bytes shared with the one before, the rest)."""
    shared, rest, last = [], [], b""
    for s in suffixes:
        n = common(last, s, 0)
        shared.append(n)
        rest.append(s[n:])
        last = s
    return shared, rest


class LoserTree:
    """Merges sorted runs of (common prefix with the run's last string, string, payload).

    Every waiting string carries its common prefix with the last winner of its comparison. Of two, the
    one that shares more with the last output is smaller; only at a tie are bytes read, from that
    prefix on. So no byte of a known prefix is looked at twice.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, object]]]):
        self.runs = runs
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.heads: list = [next(r, None) for r in runs] + [None] * (self.size - len(runs))
        self.shared = [0] * self.size
        self.tree = [0] * self.size
        self.winner = self._build(1)

    def _play(self, i: int, j: int) -> tuple[int, int]:
        a, b = self.heads[i], self.heads[j]
        if a is None or b is None:
            return (j, i) if a is None else (i, j)
        x, y = self.shared[i], self.shared[j]
        if x != y:
            return (i, j) if x > y else (j, i)
        n = common(a[1], b[1], x)
        if a[1][n : n + 1] <= b[1][n : n + 1]:
            self.shared[j] = n
            return i, j
        self.shared[i] = n
        return j, i

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        win, lose = self._play(self._build(2 * node), self._build(2 * node + 1))
        self.tree[node] = lose
        return win

    def __iter__(self) -> Iterator[tuple[int, bytes, object]]:
        while (head := self.heads[self.winner]) is not None:
            yield self.shared[self.winner], head[1], head[2]
            w = self.winner
            self.heads[w] = after = next(self.runs[w], None)
            if after is not None:
                self.shared[w] = after[0]
            node = (w + self.size) // 2
            while node:
                win, lose = self._play(w, self.tree[node])
                self.tree[node] = lose
                w = win
                node //= 2
            self.winner = w


def repeated_windows(family: list[tuple], length: int) -> Iterator[tuple[object, int, int]]:
    """(payload, first, last window before the suffix) for the windows of a family that occur twice or more in it.

    A member is (payload, window range low, high, left context, suffix): window o starts o bytes before
    the suffix. Members with the same bytes and range are looked at once.
    """
    kinds: dict[tuple, list] = defaultdict(list)
    for payload, low, high, left, suffix in family:
        kinds[low, high, left, suffix].append(payload)
    if len(kinds) == 1:
        (low, high, _, _), who = kinds.popitem()
        if len(who) > 1:
            for p in who:
                yield p, low, high
        return
    members = [(low, high, left + suffix, len(left), who) for (low, high, left, suffix), who in kinds.items()]
    opened: dict[int, int] = {}
    # One distance at a time, so a family holds one window of each member and not all of them.
    for o in range(min(m[0] for m in members), max(m[1] for m in members) + 2):
        live = [(i, whole[at - o : at - o + length], len(who)) for i, (low, high, whole, at, who) in enumerate(members) if low <= o <= high]
        counts: dict[bytes, int] = {}
        for _, window, n in live:
            counts[window] = counts.get(window, 0) + n
        hits = {i for i, window, _ in live if counts[window] > 1}
        for i in [i for i in opened if i not in hits]:
            start = opened.pop(i)
            for p in members[i][4]:
                yield p, start, o - 1
        for i in hits:
            opened.setdefault(i, o)


def _suffixes(docs: DataFrame, length: int, k: int) -> DataFrame:
    """The picked suffixes of every text with the bytes of all their windows.

    With a column __wanted of (place, number) only those places, next to their numbers.
    """
    wanted = "__wanted" in docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = _bytes_of(b.column(2))
            raw, starts = data.tobytes(), np.concatenate([[0], ends])
            if wanted:
                lists = b.column(3).to_pylist()
                numbers = dict(sorted((int(starts[i]) + w["__at"], w["__n"]) for i, ws in enumerate(lists) for w in ws))
                places = np.fromiter(numbers, np.int64, len(numbers))
            for at, first, last, h in picked(data, ends, length, k):
                if wanted:
                    keep = np.isin(at, places)
                    at, first, last, h = at[keep], first[keep], last[keep], h[keep]
                text = np.searchsorted(ends, at, "right")
                rows = pa.array(text)
                left = pa.array([raw[x:y] for x, y in zip(first.tolist(), at.tolist(), strict=True)], pa.binary())
                right = pa.array([raw[x:y] for x, y in zip(at.tolist(), (last + length).tolist(), strict=True)], pa.binary())
                n = [pa.array([numbers[x] for x in at.tolist()], pa.int64())] if wanted else []
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(rows), b.column(1).take(rows), pa.array(at - starts[text]), pa.array((at - last).astype(np.int32)), pa.array((at - first).astype(np.int32)), pa.array(h.view(np.int64)), left, right, *n],
                    names=["__id", "__x", "__at", "__low", "__high", "__gram", "__left", "__right", *["__n"] * wanted],
                )

    kind = docs.schema["__id"].dataType.simpleString()
    return docs.mapInArrow(run, f"__id {kind}, __x long, __at long, __low int, __high int, __gram long, __left binary, __right binary" + ", __n long" * wanted)


def _places(docs: DataFrame, length: int, k: int) -> DataFrame:
    """The places and grams of the picked suffixes, without their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = _bytes_of(b.column(2))
            starts = np.concatenate([[0], ends])
            for at, _, _, h in picked(data, ends, length, k):
                text = np.searchsorted(ends, at, "right")
                rows = pa.array(text)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(at - starts[text]), pa.array(h.view(np.int64))], names=["__id", "__x", "__at", "__gram"])

    return docs.mapInArrow(run, f"__id {docs.schema['__id'].dataType.simpleString()}, __x long, __at long, __gram long")


def _gram_counts(docs: DataFrame, length: int, k: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, ends = _bytes_of(b.column(0))
            for _, _, _, h in picked(data, ends, length, k):
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], names=["__gram", "__n"])

    return docs.select("__text").mapInArrow(run, "__gram long, __n long").groupBy("__gram").agg(F.sum("__n").alias("__n")).where("__n > 1")


def _merged(suffixes: DataFrame, n: int, length: int, k: int) -> DataFrame:
    """Spans of repeated windows: sorted front-coded runs are exchanged, then merged by loser trees.

    A run is all that one task has for one goal, however many batches that takes; it travels in blocks
    of at most ``BLOCK`` suffixes, one row each.
    """
    tasks = max(1, -(-n // PER_TASK))
    kind = suffixes.schema["__id"].dataType.simpleString()
    names = ["__id", "__x", "__at", "__low", "__high", "__left"]
    goal = F.pmod(F.xxhash64("__gram"), F.lit(tasks)).cast("int")
    kinds = [kind, "long", "long", "int", "int", "binary"]
    lists = ["__shared array<int>", "__rest array<binary>", *[f"{c} array<{t}>" for c, t in zip(names, kinds, strict=True)]]

    def make_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run, head, last, block = TaskContext.get().partitionId(), None, b"", 0
        for b in batches:
            goals, right = b.column("__goal").to_numpy(), b.column("__right").to_pylist()
            shared, rest = [], []
            for g, suffix in zip(goals.tolist(), right, strict=True):
                if g != head:
                    head, last = g, b""
                shared.append(common(last, suffix, 0))
                rest.append(suffix[shared[-1] :])
                last = suffix
            turns = np.flatnonzero(np.diff(goals)) + 1
            cuts = np.unique(np.concatenate([turns, np.arange(0, len(goals), BLOCK), [len(goals)]])).astype(np.int32)
            if len(cuts) < 2:
                continue
            offsets = pa.array(cuts)
            cols = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in ((shared, pa.int32()), (rest, pa.binary()))]
            # Blocks are numbered through the task; a goal's blocks come in their order.
            numbers = pa.array(np.arange(block, block + len(cuts) - 1))
            block += len(cuts) - 1
            cols += [pa.ListArray.from_arrays(offsets, b.column(c)) for c in names]
            yield pa.RecordBatch.from_arrays([pa.array(goals[cuts[:-1]]), pa.array([run] * (len(cuts) - 1), pa.int32()), numbers, *cols], names=["__goal", "__run", "__block", "__shared", "__rest", *names])

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("__run", "ascending"), ("__block", "ascending")])
        sizes = pc.list_value_length(table.column("__rest")).to_numpy()
        run_ids = np.repeat(table.column("__run").to_numpy(), sizes)
        flat = {c: pc.list_flatten(table.column(c)) for c in ("__shared", "__rest", *names)}
        shared, rest, lows, highs, lefts = (flat[c].to_pylist() for c in ("__shared", "__rest", "__low", "__high", "__left"))
        cuts_ = [0, *(np.flatnonzero(np.diff(run_ids)) + 1).tolist(), len(run_ids)]

        def read(a: int, b: int) -> Iterator[tuple[int, bytes, int]]:
            last = b""
            for i in range(a, b):
                last = last[: shared[i]] + rest[i]
                yield shared[i], last, i

        rows, lo, hi = [], [], []

        def close(family: list) -> None:
            if len(family) > 1:
                for i, first, last in repeated_windows(family, length):
                    rows.append(i)
                    lo.append(last)
                    hi.append(length - first)

        family: list = []
        for same, suffix, i in LoserTree([read(a, b) for a, b in zip(cuts_, cuts_[1:], strict=False)]):
            if same < k:
                close(family)
                family = []
            family.append((i, lows[i], highs[i], lefts[i], suffix))
        close(family)
        ids, xs, at = (flat[c].take(pa.array(rows, pa.int64())) for c in ("__id", "__x", "__at"))
        at = at.to_numpy()
        return pa.table({"__id": ids, "__x": xs, "__lo": pa.array(at - np.array(lo, np.int64)), "__hi": pa.array(at + np.array(hi, np.int64))})

    # Spark sorts what a task holds, on disk where need be.
    rows = suffixes.select(goal.alias("__goal"), "__right", *names).sortWithinPartitions("__goal", "__right")
    runs = rows.mapInArrow(make_runs, ", ".join(["__goal int", "__run int", "__block long", *lists]))
    return runs.groupBy("__goal").applyInArrow(merge, f"__id {kind}, __x long, __lo long, __hi long")


def _by_window(suffixes: DataFrame, length: int) -> DataFrame:
    """Spans of repeated windows of the largest families: every distinct context's windows are counted by 128-bit hashes."""
    who = [F.xxhash64(F.lit(i), "__low", "__high", F.length("__left"), "__left", "__right").alias(f"__c{i}") for i in (0, 1)]
    placed = suffixes.select("*", *who)
    kinds = placed.groupBy("__c0", "__c1").agg(F.count(F.lit(1)).alias("__times"), *[F.first(c).alias(c) for c in ("__low", "__high", "__left", "__right")])
    kinds = cut_lineage(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, offs, keys = [], [], []
            for i, (low, high, left, right) in enumerate(zip(*[b.column(c).to_pylist() for c in ("__low", "__high", "__left", "__right")], strict=True)):
                whole, at = left + right, len(left)
                for o in range(low, high + 1):
                    rows.append(i)
                    offs.append(o)
                    keys.append(xxhash.xxh3_128_digest(whole[at - o : at - o + length], o))
            take = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("__c0").take(take), b.column("__c1").take(take), b.column("__times").take(take), pa.array(offs, pa.int32()), pa.array(keys, pa.binary())], names=["__c0", "__c1", "__times", "__o", "__w"])

    windows = kinds.mapInArrow(run, "__c0 long, __c1 long, __times long, __o int, __w binary")
    counts = windows.groupBy("__w").agg(F.sum("__times").alias("__size"), F.count(F.lit(1)).alias("__kinds")).where("__size > 1")
    hits = join_groups(windows, counts.select("__w", F.col("__kinds").alias("__size")), ["__w"], "__size", windows.count(), F.col("__c0")).where("__size is not null")
    # At most length - k + 1 windows a context, as runs of neighbours.
    spans = hits.groupBy("__c0", "__c1").agg(F.max("__times").alias("__times"), F.array_sort(F.collect_list("__o")).alias("__o"))
    o = F.col("__o")
    runs = F.arrays_zip(
        F.filter(o, lambda x, i: (i == 0) | (x - F.get(o, F.greatest(i - 1, F.lit(0))) > 1)).alias("a"),
        F.filter(o, lambda x, i: (i == F.size(o) - 1) | (F.get(o, i + 1) - x > 1)).alias("b"),
    )
    spans = spans.select("__c0", "__c1", "__times", runs.alias("__runs"))
    out = join_groups(placed.select("__id", "__x", "__at", "__c0", "__c1"), spans, ["__c0", "__c1"], "__times", placed.count(), F.col("__at"))
    out = out.select("__id", "__x", "__at", F.explode("__runs").alias("__r"))
    return out.select("__id", "__x", (F.col("__at") - F.col("__r.b")).alias("__lo"), (F.col("__at") - F.col("__r.a") + length).alias("__hi"))


def _join_spans(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list = []
    for lo, hi in sorted(parts):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Id, a hash of the text, text: rows equal in both have the same spans, so no row number is needed."""
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("__id"), F.xxhash64(text).alias("__x"), text.alias("__text"))


def repeated_spans(docs: DataFrame, length: int = 200, gram: int = GRAM, largest_family: int = LARGEST_FAMILY) -> DataFrame:
    """(__id, __x, __spans) of the texts of (__id, __x, __text) that have a repeated window: maximal byte spans."""
    ship_package(docs.sparkSession)
    spark = docs.sparkSession
    grams = cut_lineage(_gram_counts(docs, length, gram))
    size = grams.agg(F.count(F.lit(1)), F.sum("__n")).head()
    table = f"{checkpoint_path(spark)}/suffixes-{uuid4().hex}"
    if size[0] <= BROADCAST_GRAMS:
        found = _suffixes(docs, length, gram).join(F.broadcast(grams), "__gram")
    else:
        # Grams and places meet without the bytes; then the places are taken to their texts.
        places = join_groups(_places(docs, length, gram), grams, ["__gram"], "__n", size[1] * 4, F.col("__at")).where("__n is not null")
        wanted = places.groupBy(F.col("__id").alias("__i"), F.col("__x").alias("__y")).agg(F.collect_set(F.struct("__at", "__n")).alias("__wanted"))
        texts = docs.join(wanted, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__x") == F.col("__y"))).select("__id", "__x", "__text", "__wanted")
        found = _suffixes(texts, length, gram)
    found.write.option("compression", "zstd").parquet(table)
    suffixes = spark.read.parquet(table)
    found = _merged(suffixes.where(F.col("__n") <= largest_family), size[1] or 0, length, gram)
    if not grams.where(F.col("__n") > largest_family).isEmpty():
        found = found.unionByName(_by_window(suffixes.where(F.col("__n") > largest_family), length))
    spans = found.groupBy("__id", "__x").agg(F.collect_set(F.struct("__lo", "__hi")).alias("__parts"))
    kind = docs.schema["__id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            joined = [[{"start": lo, "end": hi} for lo, hi in _join_spans([(p["__lo"], p["__hi"]) for p in parts])] for parts in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(joined, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["__id", "__x", "__spans"])

    out = cut_lineage(spans.mapInArrow(run, f"__id {kind}, __x long, __spans array<struct<start:bigint,end:bigint>>"))
    drop_table(spark, table)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = GRAM, largest_family: int = LARGEST_FAMILY) -> DataFrame:
    """Every text without the bytes covered by a ``length``-byte string that also starts anywhere else.

    Of all suffixes only those are sorted that stand for a window: each window is given to the gram of
    least hash in it, a choice that equal windows share, about one suffix in 70 bytes. Suffixes whose
    gram occurs once drop out. The others are sorted in runs where they are found, front-coded, exchanged
    by gram and merged by loser trees that never compare a known prefix again; neighbours that share
    the gram form a family, and windows equal byte by byte within a family are repeated. Families over
    ``largest_family`` (a passage in very many texts) are counted window by window instead.

    Matches never cross texts. Null texts count as empty. Rows equal in id and text repeat each other;
    null ids are told apart by their texts; other columns are ignored; an empty table gives no rows.
    Returns id, n_bytes, spans (maximal removed byte ranges), kept (the remaining bytes).
    """
    rows = _keyed(docs, id_col, text_col)
    spans = repeated_spans(rows, length, gram, largest_family)
    n = spans.agg(F.sum(F.size("__spans"))).head()[0] or 0
    spans = spans.select(F.col("__id").alias("__i"), F.col("__x").alias("__y"), "__spans")
    spans = F.broadcast(spans) if n <= BROADCAST_SPANS else spans
    on = F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__x") == F.col("__y"))
    both = rows.join(spans, on, "left").select("__id", F.col("__text").cast("binary").alias("__text"), F.coalesce("__spans", F.array().cast("array<struct<start:bigint,end:bigint>>")).alias("__spans"))
    # The bytes before each span and after the last.
    text, cut_ = F.col("__text"), F.col("__spans")
    size_ = F.octet_length(text).cast("long")
    part = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
    before = F.transform(cut_, lambda s, i: part(F.when(i == 0, F.lit(0)).otherwise(F.get(cut_, i - 1)["end"]), s["start"]))
    after = part(F.coalesce(F.get(cut_, F.size(cut_) - 1)["end"], F.lit(0)), size_)
    # Joined as hexadecimal text in one go; a fold would copy what it has for every span.
    kept: Column = F.unhex(F.array_join(F.transform(before, F.hex), ""))
    return both.select(F.col("__id").alias(id_col), size_.alias("n_bytes"), cut_.alias("spans"), F.concat(kept, after).alias("kept"))
