"""SimHash near-duplicates by generalised pigeonhole search (operator 3)."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice, repeat
from math import comb, prod

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_groups, text_of
from tidemark.llm.graph import components
from tidemark.session import cut_lineage, ship_package

BITS = 64
SEED = 42
#: Shingles whose bits are unpacked at once.
CHUNK = 1 << 15


def fingerprint(text: bytes, width: int = 3) -> int:
    """64 bits, each set if it is set in over half of the hashes of the text's word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    shingles = map(b" ".join, zip(*[islice(words, k, None) for k in range(width)], strict=False)) if len(words) >= width else iter([b" ".join(words)])
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    votes = np.zeros(BITS, np.int64)
    for at in range(0, n, CHUNK):
        part = np.fromiter(islice(hashes, CHUNK), np.uint64, min(CHUNK, n - at))
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(__id, __fp) of every row; the fingerprint as a signed long."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_buffer().to_pybytes(), width) for t in b.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["__id", "__fp"])

    return rows.mapInArrow(run, f"__id {rows.schema['__id'].dataType.simpleString()}, __fp long")


def bit_counts(prints: DataFrame, bits: int = BITS) -> np.ndarray:
    """How many fingerprints have both bits i and j, over all rows of a column of longs or of binary.

    Partitions are taken together until they have more rows than there are pairs of bits, so the counts
    that are shuffled never outnumber the fingerprints; the driver gets one number per pair of bits.
    """
    pairs = bits * (bits + 1) // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((bits, bits), np.float64)
        for b in batches:
            x = unpacked(b.column(0), bits).astype(np.float32)
            for at in range(0, len(x), 4096):
                total += x[at : at + 4096].T @ x[at : at + 4096]
        i, j = np.nonzero(np.triu(total))
        yield pa.RecordBatch.from_arrays([pa.array((i * bits + j).astype(np.int32)), pa.array(total[i, j].astype(np.int64))], names=["pair", "n"])

    n = prints.count()
    few = max(1, n // pairs)
    prints = prints.coalesce(few) if few < 1000 and bits > BITS else prints
    out = np.zeros(bits * bits, np.int64)
    found = prints.mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    out[found["pair"].to_numpy()] = found["n"].to_numpy()
    out = out.reshape(bits, bits)
    return out + np.triu(out, 1).T


def unpacked(column: pa.Array, bits: int) -> np.ndarray:
    """Fingerprints as rows of 0 and 1, bit by bit."""
    if bits == BITS:
        raw = column.to_numpy(zero_copy_only=False).view(np.uint8)
    else:
        raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8)
    return np.unpackbits(raw.reshape(-1, bits // 8), axis=1, bitorder="little")


def partition_bits(both: np.ndarray, n: int, parts: int, within: list[int]) -> list[list[int]]:
    """The bits ``within`` dealt to parts of near equal width, each bit to the part it is most correlated with."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    near = np.abs(cov / np.outer(sd, sd))
    left, out = list(within), []
    for k in range(parts):
        part = [left.pop(0)]
        while len(part) < (len(within) - sum(map(len, out))) // (parts - k):
            part.append(left.pop(int(np.argmax(near[np.ix_(left, part)].mean(axis=1)))))
        out.append(sorted(part))
    return out


#: Costs in units of one shuffled signature row: a comparison of two signatures inside a bucket.
COMPARISON = 0.005
#: Steps of -log(1 - recall) that the thresholds are dealt in where no distance is guaranteed.
STEP = 0.02


def _alike(both: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For two random rows: the chance that they agree in bit i, and in both bits i and j, from the joint counts."""
    p = np.diag(both) / max(n, 1)
    one = p * p + (1 - p) * (1 - p)
    p11 = both / max(n, 1)
    p10, p01 = p[:, None] - p11, p[None, :] - p11
    p00 = 1 - p11 - p10 - p01
    return one, p11**2 + np.abs(p10) ** 2 + np.abs(p01) ** 2 + np.abs(p00) ** 2


def _within(alike: tuple[np.ndarray, np.ndarray], bits: list[int], most: int) -> float:
    """The chance that two random rows differ in at most ``most`` of the bits.

    Bits are taken as a chain in which each depends on the one before by their joint counts, so that
    bits of one part that go together are not counted as independent.
    """
    one, two = alike
    # The chances by the number of bits that differ, where the last bit agrees and where it does not.
    same, other = [float(one[bits[0]]), *[0.0] * most], [0.0, float(1 - one[bits[0]]), *[0.0] * most][: most + 1]
    for i, j in zip(bits, bits[1:], strict=False):
        p, q, both = float(one[i]), float(one[j]), float(two[i, j])
        agree = min(1.0, max(0.0, both / max(p, 1e-12)))
        after = min(1.0, max(0.0, (q - both) / max(1 - p, 1e-12)))
        differ = [x * (1 - agree) + y * (1 - after) for x, y in zip(same, other, strict=True)]
        same, other = [x * agree + y * after for x, y in zip(same, other, strict=True)], [0.0, *differ[:most]]
    return sum(same) + sum(other)


def _flips(width: int, most: int) -> int:
    return sum(comb(width, d) for d in range(most + 1))


def _deal(options: list[list[tuple[float, int, object]]], goal: int) -> tuple[float, list]:
    """One option of each list, the cheapest whose shares add up to ``goal`` or more: (cost, chosen). Dynamic programming over the shares."""
    table: list = [(0.0, ())] + [None] * goal
    for own in options:
        new: list = [None] * (goal + 1)
        for used, at in enumerate(table):
            if at is None:
                continue
            for cost, share, what in own:
                to = min(goal, used + share)
                if new[to] is None or at[0] + cost < new[to][0]:
                    new[to] = (at[0] + cost, (*at[1], what))
        table = new
    return (table[goal][0], [x for x in table[goal][1] if x]) if table[goal] else (float("inf"), [])


def allocate(both: np.ndarray, n: int, distance: int, most: int = 4) -> list[list[tuple[list[int], int]]]:
    """The probes that cost least and miss no pair within ``distance``; each is one or two (bits, threshold) parts that must both be met.

    If the (threshold + 1) of all parts add up to distance + 1, two fingerprints within the distance are
    within the threshold of at least one part (a part without a share is never probed). A part that is
    expected to give too many candidates is probed together with parts of the remaining bits, dealt by
    the same rule, so buckets do not outgrow the table. Costs are the signatures emitted plus the
    comparisons expected from the joint counts of bits over the whole table.
    """
    alike = _alike(both, n)

    def options(within: list[int], parts: int, emitted: int, chance: float) -> list:
        out = []
        for bits in partition_bits(both, n, parts, within):
            own: list = [(0.0, 0, None)]
            for t in range(distance + 1):
                flips = _flips(len(bits), t)
                own.append((emitted * flips * n + COMPARISON * flips * chance * _within(alike, bits, t) * n * n / 2, t + 1, (bits, t)))
            out.append(own)
        return out

    best: tuple[float, list] = (float("inf"), [])
    for parts in range(1, most + 1):
        total, probes = 0.0, []
        for cost, _, (bits, t) in [next(o for o in own if o[2] == x) for own, x in _chosen(options(list(range(len(both))), parts, 1, 1.0), distance + 1)]:
            inner: tuple[float, list] = (cost, [[(bits, t)]])
            rest = [b for b in range(len(both)) if b not in bits]
            for k in range(1, most + 1 if rest else 1):
                price, deal = _deal(options(rest, k, _flips(len(bits), t), _within(alike, bits, t)), distance + 1)
                inner = min(inner, (price, [[(bits, t), x] for x in deal]), key=lambda x: x[0])
            total += inner[0]
            probes += inner[1]
        best = min(best, (total, probes), key=lambda x: x[0])
    return best[1]


def _chosen(options: list, goal: int) -> list[tuple[list, object]]:
    """The options that ``_deal`` takes, each with the list it comes from."""
    taken = _deal(options, goal)[1]
    return [(own, x) for own in options for x in taken if any(o[2] is x for o in own)]


def allocate_recall(both: np.ndarray, n: int, rate: float, recall: float, widths: tuple[int, ...] = (10, 12, 14, 16, 18, 20, 24)) -> list[list[tuple[list[int], int]]]:
    """The probes that cost least and meet a pair whose bits differ at ``rate`` with the chance ``recall``, for wide fingerprints.

    Of parts with shares t + 1, pairs within the sum of the shares less one always meet; pairs further
    apart meet by chance, and thresholds are dealt to the parts until that chance is reached. Where
    single parts of the widths on offer would make buckets grow with the table, two parts are probed together.
    """
    alike, every = _alike(both, n), list(range(len(both)))
    best: tuple[float, list] = (float("inf"), [])
    # A pair of parts adds little, so its steps are finer.
    for together, step in ((1, STEP), (2, STEP / 10)):
        for width in widths:
            parts = partition_bits(both, n, len(every) // width, every)
            chance = [[_within(alike, p, t) for t in (0, 1)] for p in parts]
            order = range(len(parts))
            probes = [(a, a + gap) for gap in order[1:] for a in order[: len(parts) - gap]][: 8 * len(parts)] if together > 1 else [(k,) for k in order]
            options = []
            for at in probes:
                own: list = [(0.0, 0, None)]
                for t in (0, 1) if together == 1 else (0,):
                    met = prod(sum(comb(len(parts[k]), d) * rate**d * (1 - rate) ** (len(parts[k]) - d) for d in range(t + 1)) for k in at)
                    # Probes that share a part go together: a pair of parts counts for half of its chance.
                    share = int(-np.log(1 - met) / together / step)
                    flips = _flips(len(parts[at[0]]), t)
                    own.append((flips * n + COMPARISON * flips * prod(chance[k][t] for k in at) * n * n / 2, share, [(parts[k], t) for k in at]))
                options.append(own)
            best = min(best, _deal(options, int(np.ceil(-np.log(1 - recall) / step))), key=lambda x: x[0])
        if best[0] <= 2 * n * sum(_flips(len(probe[0][0]), probe[0][1]) for probe in best[1]):
            break
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _ball(bits: list[int], radius: int) -> list[int]:
    """Masks that flip up to ``radius`` of the bits; the first flips none."""
    return [_signed(sum(1 << b for b in c)) for r in range(radius + 1) for c in combinations(bits, r)]


#: In a block a row with over so many near rows is in a large group; pairs it gets: with the nearest rows, with the group's middle rows.
FAMILY, NEAREST, MIDDLE = 16, 3, 3


def near_pairs(rows: DataFrame, most: int, exact: bool, checks: tuple[str, ...] = ("__check",), family: tuple[int, int, int] = (FAMILY, NEAREST, MIDDLE)) -> DataFrame:
    """(a, b) of the rows (__bucket, __spread, __node, and bits to compare in ``checks``) of one bucket whose bits differ in ``most`` places or fewer.

    Rows are shuffled by bucket and sorted; each task streams them and keeps those of the bucket it is in.
    With ``exact`` every pair of a bucket is given. Otherwise a block in which many rows are near one another
    (a large group of near copies) gives for each of its rows the pairs with its nearest rows and with the
    rows in the middle of the group, and hands the middle rows on to the next blocks, so pairs grow with
    the rows and not with their square; such a bucket also gives a row with a and b null, and
    ``apart_pairs`` settles what the links found so far leave apart in it. A bucket dealt over spread
    numbers from 1 on gives its rows with b null, to be compared once more.
    """
    names = ["a", "b", "__bucket", *checks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Bucket(most, exact, len(checks), family)
        for batch in batches:
            bucket, spread, node, *check = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3 + len(checks)))
            check = np.stack(check, axis=1).view(np.uint64)
            if len(bucket):
                cut = np.flatnonzero((bucket[1:] != bucket[:-1]) | (spread[1:] != spread[:-1])) + 1
                starts, stops = np.append(0, cut), np.append(cut, len(bucket))
                # Buckets of one row have no pairs; the first and the last may go on in another batch.
                several = np.flatnonzero((stops - starts > 1) | (starts == 0) | (stops == len(bucket)))
                for lo, hi in zip(starts[several].tolist(), stops[several].tolist(), strict=True):
                    held.add((int(bucket[lo]), int(spread[lo])), node[lo:hi], check[lo:hi])
            yield pa.RecordBatch.from_arrays(held.given(), names=names)
        held.close()
        yield pa.RecordBatch.from_arrays(held.given(), names=names)

    rows = rows.select("__bucket", "__spread", "__node", *checks).repartition("__bucket", "__spread").sortWithinPartitions("__bucket", "__spread")
    return rows.mapInArrow(run, ", ".join(f"{c} long" for c in names))


class _Bucket:
    """The bucket that a task is reading: rows not compared yet, and rows that later ones are still compared with."""

    BLOCK = 2048

    def __init__(self, most: int, exact: bool, checks: int = 1, family: tuple[int, int, int] = (FAMILY, NEAREST, MIDDLE)):
        self.most, self.exact, self.checks = most, exact, checks
        self.family, self.nearest, self.middle = family
        self.cut: set[int] = set()
        self.key: tuple[int, int] = (0, 0)
        self.new: list = []
        self.old: list = []
        self.out: list = []
        self.kept: list = []

    def add(self, key: tuple[int, int], node: np.ndarray, check: np.ndarray) -> None:
        if key != self.key:
            self.close()
            self.key = key
        for at in range(0, len(node), self.BLOCK):
            self.new.append((node[at : at + self.BLOCK], check[at : at + self.BLOCK]))
            if sum(len(n) for n, _ in self.new) >= self.BLOCK:
                self._compare()

    def close(self) -> None:
        if sum(len(n) for n, _ in self.new) > 1 or (self.new and self.old) or (self.new and self.key[1]):
            self._compare()
        if self.key[1]:
            self.kept += [(node, check, self.key[0]) for node, check in self.old]
        self.new, self.old = [], []

    def given(self) -> list[pa.Array]:
        """The pairs found since the last call, after them the rows to be compared once more, and buckets in which pairs were left out."""
        one = np.concatenate([np.zeros(0, np.int64), *[a for a, _ in self.out], *[n for n, _, _ in self.kept]])
        two = np.concatenate([np.zeros(0, np.int64), *[b for _, b in self.out]])
        cut = np.array(sorted(self.cut), np.int64)
        bucket = np.concatenate([np.zeros(len(two), np.int64), *[np.full(len(n), k) for n, _, k in self.kept], cut])
        check = np.concatenate([np.zeros((len(two), self.checks), np.uint64), *[c for _, c, _ in self.kept], np.zeros((len(cut), self.checks), np.uint64)]).view(np.int64)
        at, pad = np.arange(len(bucket)), lambda x: np.append(x, np.zeros(len(bucket) - len(x), np.int64))
        self.out, self.kept, self.cut = [], [], set()
        return [pa.array(pad(one), mask=at >= len(one)), pa.array(pad(two), mask=at >= len(two)), pa.array(bucket), *[pa.array(c) for c in check.T.copy()]]

    def _compare(self) -> None:
        node, check = (np.concatenate(x) for x in zip(*self.new, strict=True))
        self.new = []
        for was, then in self.old:
            self._give(node, was, self._differ(check, then) <= self.most)
        near = self._differ(check, check)
        hit = near <= self.most
        degree = hit.sum(axis=1)
        large = (degree > self.family) & (not self.exact)
        if not large.any():
            self._give(node, node, np.triu(hit, 1))
            self.old.append((node, check))
            return
        self.cut.add(self.key[0])
        self._give(node, node, np.triu(hit & ~(large[:, None] & large[None, :]), 1))
        left, keep = np.flatnonzero(large), [np.flatnonzero(~large)]
        while len(left):
            # The family of the row that has most others near it.
            seed = left[np.argmax(degree[left])]
            mine = hit[seed, left]
            family, left = left[mine], left[~mine]
            inner = near[np.ix_(family, family)].astype(np.int16)
            middle = family[np.argsort(inner.mean(axis=1), kind="stable")[: self.middle]]
            np.fill_diagonal(inner, 255)
            nearest = min(self.nearest, len(family) - 1)
            close = family[np.argpartition(inner, nearest, axis=1)[:, :nearest]] if nearest else np.zeros((1, 0), np.int64)
            self.out.append(_ordered(np.repeat(node[family], nearest), node[close.ravel()]))
            for rows in (family, left):
                self._give(node[rows], node[middle], hit[np.ix_(rows, middle)])
            keep.append(middle)
        kept = np.concatenate(keep)
        self.old.append((node[kept], check[kept]))

    def _differ(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The number of different bits of every row of one with every row of the other, at most 255."""
        out = np.bitwise_count(x[:, None, 0] ^ y[None, :, 0])
        for k in range(1, self.checks):
            out = np.minimum(out.astype(np.uint16) + np.bitwise_count(x[:, None, k] ^ y[None, :, k]), 255).astype(np.uint8)
        return out

    def _give(self, a: np.ndarray, b: np.ndarray, hit: np.ndarray) -> None:
        i, j = np.nonzero(hit)
        if len(i):
            self.out.append(_ordered(a[i], b[j]))


def in_several_groups(rows: DataFrame) -> DataFrame:
    """The rows (__bucket, __root, ...) of buckets with more than one root."""
    sizes = rows.groupBy("__bucket").agg(F.min("__root").alias("__low"), F.max("__root").alias("__high")).where("__low < __high")
    return rows.join(sizes.select("__bucket"), "__bucket", "left_semi")


def apart_pairs(rows: DataFrame, most: int, checks: tuple[str, ...], share: tuple[int, int] = (0, 1), block: int = 4096) -> DataFrame:
    """(a, b) of all rows (__bucket, __node, __root, ``checks``, __n, __map) of one bucket that have different roots and may be similar.

    They may be if their ``checks`` differ in ``most`` bits or fewer and their profiles (size of the set, and
    which of some places its members hash to) do not prove a Jaccard similarity under ``share``: a place that
    only one of two sets holds is at least one member that the other lacks.

    A bucket is cut into blocks of about ``block`` rows by a hash, and each pair of its blocks is a task's
    work of its own: no task holds more than two blocks, however large the bucket.
    """
    sizes = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__size"))
    dealt = rows.join(sizes.select("__bucket", F.ceil(F.col("__size") / block).cast("int").alias("__blocks")), "__bucket")
    dealt = dealt.withColumn("__own", F.pmod(F.xxhash64("__node"), F.col("__blocks")).cast("int"))
    dealt = dealt.withColumn("__other", F.explode(F.sequence(F.lit(0), F.col("__blocks") - 1)))
    dealt = dealt.select("__bucket", F.least("__own", "__other").alias("__i"), F.greatest("__own", "__other").alias("__j"), "__own", "__node", "__root", *checks, "__n", "__map")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def found() -> pa.RecordBatch:
            own, node, root, check, size, places = (np.concatenate(x) for x in zip(*held))
            left, right = (np.flatnonzero(own == now[1]), np.flatnonzero(own == now[2]))
            out = []
            for at in range(0, len(left), 256):
                part = left[at : at + 256]
                bits = np.zeros((len(part), len(right)), np.uint16)
                for k in range(check.shape[1]):
                    bits += np.bitwise_count(check[part, None, k] ^ check[None, right, k])
                i, j = np.nonzero((bits <= most) & (root[part][:, None] != root[right][None]))
                for k in range(0, len(i), 1 << 15):
                    x, y = part[i[k : k + (1 << 15)]], right[j[k : k + (1 << 15)]]
                    shared = np.minimum(size[x] - np.bitwise_count(places[x] & ~places[y]).sum(1), size[y] - np.bitwise_count(places[y] & ~places[x]).sum(1))
                    may = shared * (share[0] + share[1]) >= (size[x] + size[y]) * share[0]
                    out.append(_ordered(node[x[may]], node[y[may]]))
            a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*out) if out else ([], [])))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_numpy() for c in ("__bucket", "__i", "__j", "__own", "__node", "__root")]
            check = np.stack([batch.column(c).to_numpy() for c in checks], axis=1).view(np.uint64)
            size = batch.column("__n").to_numpy().astype(np.int64)
            places = np.frombuffer(b"".join(batch.column("__map").to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            change = np.zeros(max(0, batch.num_rows - 1), bool)
            for c in columns[:3]:
                change |= c[1:] != c[:-1]
            cuts = [0, *(np.flatnonzero(change) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                key = tuple(int(c[lo]) for c in columns[:3])
                if held and key != now:
                    yield found()
                    held = []
                now = key
                held.append((columns[3][lo:hi], columns[4][lo:hi], columns[5][lo:hi], check[lo:hi], size[lo:hi], places[lo:hi]))
        if held:
            yield found()

    return dealt.repartition("__bucket", "__i", "__j").sortWithinPartitions("__bucket", "__i", "__j").mapInArrow(run, "a long, b long").distinct()


def _ordered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    other = a != b
    return np.maximum(a, b)[other], np.minimum(a, b)[other]


def _probe(number: int, probe: list[tuple[list[int], int]], own: Column) -> Column:
    """The signatures of one probe as an array of (bucket): the own one and those with flipped bits."""
    masks = [x ^ y for x in _ball(*probe[0]) for y in (_ball(*probe[1]) if len(probe) > 1 else [0])]
    return F.transform(F.array(*[F.lit(m) for m in masks]), lambda m: F.xxhash64(F.lit(number), own.bitwiseXOR(m)))


def links(prints: DataFrame, n: int, distance: int = 2) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, all those within ``distance`` bits.

    Probe: a fingerprint has a signature for each part and each flip within the part's threshold. Verify:
    the fingerprints of a bucket are compared inside it by the bits of their XOR. The plan keeps buckets
    small (its costs count the comparisons), and a fingerprint has at most some thousand others within
    two bits, so pairs do not grow with the square of a group.
    """
    plan = allocate(bit_counts(prints.select("__fp")), n, distance)
    fp = F.col("__fp")
    own = lambda probe: fp.bitwiseAND(F.lit(_signed(sum(1 << b for bits, _ in probe for b in bits))))
    probes = prints.select("__fp", F.explode(F.concat(*[_probe(k, probe, own(probe)) for k, probe in enumerate(plan)])).alias("__bucket"))
    rows = probes.select("__bucket", F.lit(0).alias("__spread"), F.col("__fp").alias("__node"), F.col("__fp").alias("__check"))
    return near_pairs(rows, distance, True).select("a", "b").distinct()


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, distance: int = 2) -> DataFrame:
    """Every document's fingerprint and the smallest id reachable over links of at most ``distance`` bits.

    Words are runs of non-white characters after lower-casing A-Z; shingles have ``width`` words (shorter
    texts are one shingle). Null and empty texts have fingerprint zero and link like any other. Repeated
    rows come out as often as they come in; rows that share an id count as one document; null ids are
    only reported where a group has no other. Other columns are ignored. An empty table gives no rows.
    Returns id, fingerprint (16 hex digits), component_id.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, width))
    prints = cut_lineage(rows.groupBy("__fp").agg(F.min("__id").alias("__low"), F.count(F.lit(1)).alias("__size")))
    n, total = prints.count(), rows.count()
    roots = components(links(prints, n, distance), "a", "b").select(F.col("node").alias("__fp"), F.col("root").alias("__root"))
    known = prints.join(roots, "__fp", "left").withColumn("__root", F.coalesce("__root", "__fp"))
    known = cut_lineage(known)
    lowest = known.groupBy("__root").agg(F.min("__low").alias("__component"), F.count(F.lit(1)).alias("__prints"), F.sum("__size").alias("__rows"))
    # A fingerprint of one row and no links needs no join.
    named = join_groups(known, lowest.where("__rows > 1"), ["__root"], "__prints", n, F.col("__fp")).where("__rows is not null").select("__fp", "__component", "__size")
    out = join_groups(rows, named, ["__fp"], "__size", total, F.col("__id"))
    return out.select(
        F.col("__id").alias(id_col),
        F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__component")).alias("component_id"),
    )
