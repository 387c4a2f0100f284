"""How the sources of a language differ in their words, exactly (operator 11)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import UPPER, join_groups, text_of
from tidemark.session import checkpoint_path, cut_lineage, drop_table, ship_package

#: ASCII letters become lower case, other ASCII characters separate terms, bytes of other characters stay.
TERM_BYTES = bytes(c if c >= 128 else c | 32 if chr(c).upper() in UPPER else 32 for c in range(256))
#: Terms that a task counts before it hands them on; bytes of a text counted at once.
WAITING, PIECE = 300_000, 1 << 20
#: Sources of a block; rows of a block counted at once; cells of a matrix.
BLOCK, CHUNK, CELLS = 256, 1 << 16, 1 << 22
#: A bucket of the ranking that holds no more rows is sorted instead of being split further.
LEAF = 64
SCALE = 1_000_000_000


def term_counts(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    """(lang, source, term, tf, df): occurrences and documents; every group also has a row of the empty term."""
    rows = docs.select(text_of(lang_col).alias("lang"), text_of(source_col).alias("source"), text_of(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[str, str], tuple[Counter, Counter]] = {}

        def flush() -> pa.RecordBatch:
            lang, source, term, tf, df = [], [], [b""] * len(waiting), [0] * len(waiting), [0] * len(waiting)
            for k in waiting:
                lang.append(k[0])
                source.append(k[1])
            for k, (t, d) in waiting.items():
                lang += [k[0]] * len(t)
                source += [k[1]] * len(t)
                term += t
                tf += t.values()
                df += [d[x] for x in t]
            waiting.clear()
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(tf, pa.int64()), pa.array(df, pa.int64())], names=["lang", "source", "term", "tf", "df"])

        for b in batches:
            for lang, source, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).cast(pa.binary())):
                t, d = waiting.setdefault((lang, source), (Counter(), Counter()))
                plain, at, seen = text.as_py().translate(TERM_BYTES), 0, set()
                while at < len(plain):
                    to = plain.find(b" ", at + PIECE) if len(plain) - at > PIECE else -1
                    terms = plain[at : to if to >= 0 else len(plain)].split()
                    t.update(terms)
                    seen.update(terms)
                    at = to if to >= 0 else len(plain)
                d.update(seen)
            if sum(len(t) for t, _ in waiting.values()) > WAITING:
                yield flush()
        if waiting:
            yield flush()

    counted = rows.mapInArrow(run, "lang string, source string, term string, tf long, df long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def smoothed(count: str, n: str, v: str) -> Column:
    """1 + floor(10^9 * (count + 2) / (n + 2 * v)), whole numbers throughout; 1 where there are no terms."""
    share = f"(CAST({SCALE} AS DECIMAL(19,0)) * CAST({count} + 2 AS DECIMAL(19,0))) div nullif(CAST({n} + 2 * {v} AS DECIMAL(19,0)), 0)"
    return F.expr(f"1 + coalesce({share}, 0)")


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def leading_digit(v: Column) -> Column:
    """A number that grows with ``v`` (0 or more): the length of v in bits, then its first six bits."""
    n = F.length(F.bin(v))
    return (n * 64).cast("long") + F.expr("shiftright(__v, greatest(length(bin(__v)) - 6, 0))")


def _digit(step: int) -> Column:
    """What rows of one bucket are told apart by in this step: bits of the value from the top, then its ties' bytes, two at a time, larger first."""
    if step == 0:
        return F.lpad(F.hex(leading_digit(F.col("__v"))), 16, "0")
    if step <= 6:
        return F.lpad(F.hex(F.expr(f"shiftright(__v, greatest(length(bin(__v)) - {6 + 10 * step}, 0))")), 16, "0")
    at = 2 * (step - 7)
    # Bytes come in ascending order: their complement is larger where they are smaller; a tie that ends here comes first.
    pair = F.hex(F.substring("__t", at + 1, 2))
    return F.translate(F.rpad(pair, 4, "/"), "/0123456789ABCDEF", "zyxwvutsrqponmlkj")


def radix_select(rows: DataFrame, keys: list[str], value: str, tie: str, k: int, leaf: int = LEAF) -> DataFrame:
    """The first ``k`` rows of every group by value (0 or more), largest first, then by the tie's UTF-8 bytes, with their rank.

    No group is sorted. A histogram over the leading bits of the values, summed in the tasks first, tells
    in which bucket a group's k-th row lies; rows above it are in, rows below are out, and only the rows
    of that bucket go on to the next bits, at equal values to the bytes of the tie. A bucket of at most
    ``leaf`` rows is left to the final sort, which sees at most k + leaf rows a group.
    """
    open_ = rows.select("*", F.col(value).alias("__v"), F.col(tie).cast("binary").alias("__t"), F.lit(True).alias("__open"))
    left = None
    step = 0
    while True:
        tagged = open_.withColumn("__d", _digit(step))
        hist = tagged.where("__open").groupBy(*keys, "__d").agg(F.count(F.lit(1)).alias("__n"))
        if left is not None:
            hist = hist.join(left, keys)
        else:
            hist = hist.withColumn("__left", F.lit(k))
        down = W.partitionBy(*keys).orderBy(F.col("__d").desc())
        hist = hist.withColumn("__above", F.coalesce(F.sum("__n").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        hist = hist.where(F.col("__above") < F.col("__left")).groupBy(*keys).agg(F.min(F.struct("__d", "__n", "__above", "__left")).alias("__m"))
        edge = hist.select(*keys, F.col("__m.__d").alias("__edge"), F.col("__m.__n").alias("__n"), (F.col("__m.__left") - F.col("__m.__above")).alias("__left"))
        edge = cut_lineage(edge.withColumn("__more", (F.col("__n") > F.col("__left")) & (F.col("__n") > leaf)))
        total = edge.agg(F.sum("__n")).head()[0] or 0
        met = join_groups(tagged, edge, keys, "__n", total, F.col(tie))
        met = met.where(~F.col("__open") | F.col("__edge").isNull() | (F.col("__d") >= F.col("__edge")))
        again = F.col("__open") & F.coalesce(F.col("__more") & (F.col("__d") == F.col("__edge")), F.lit(False))
        open_ = cut_lineage(met.withColumn("__open", again).select(*open_.columns))
        left = edge.where("__more").select(*keys, "__left")
        step += 1
        if left.isEmpty() or (step > 6 and open_.where(F.col("__open") & (F.octet_length("__t") > 2 * (step - 7))).isEmpty()):
            break
    order = W.partitionBy(*keys).orderBy(F.col("__v").desc(), F.col("__t"))
    return open_.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("__v", "__t", "__open")


def radix_rank(rows: DataFrame, keys: list[str], value: str, tie: str) -> DataFrame:
    """All rows with their rank in their group, in the order of ``radix_select``: a histogram over leading bits gives every bucket's first rank, and a bucket is sorted on its own."""
    tagged = rows.withColumn("__v", F.col(value)).withColumn("__d", leading_digit(F.col("__v"))).drop("__v")
    down = W.partitionBy(*keys).orderBy(F.col("__d").desc()).rowsBetween(W.unboundedPreceding, -1)
    hist = tagged.groupBy(*keys, "__d").agg(F.count(F.lit(1)).alias("__n")).withColumn("__above", F.coalesce(F.sum("__n").over(down), F.lit(0)))
    inner = W.partitionBy(*keys, "__d").orderBy(F.col(value).desc(), F.col(tie).cast("binary"))
    return tagged.withColumn("rank", F.row_number().over(inner)).join(hist, [*keys, "__d"]).withColumn("rank", (F.col("rank") + F.col("__above")).cast("int")).select(*rows.columns, "rank")


class _Pairs:
    """Sums of gaps between the sources of two blocks, over the terms of one bucket.

    A source without a term has the baseline of all its missing terms there, so the sum over all terms is
    that of the baselines, corrected for terms that one source has, and again for terms that both have.
    """

    def __init__(self, index: np.ndarray, base: np.ndarray, across: int, terms: int):
        self.index, self.base = index, base
        self.zero = gap(base[:, None], base[None])
        # Between two blocks (``across`` is their size) the pairs inside each belong to another task.
        self.wanted = index[:, None] // across != index[None] // across if across else np.ones(self.zero.shape, bool)
        self.sums = self.zero * terms

    def add(self, term: np.ndarray, index: np.ndarray, p: np.ndarray) -> None:
        a = np.searchsorted(self.index, index)
        m = len(self.index)
        alike, times = np.unique(a * (SCALE * 4) + p, return_counts=True)
        own, step = np.zeros((m, m), np.int64), max(1, CELLS // m)
        for k in range(0, len(alike), step):
            x, n = alike[k : k + step], times[k : k + step]
            s, q = x // (SCALE * 4), x % (SCALE * 4)
            np.add.at(own, s, (gap(q[:, None], self.base[None]) - self.zero[s]) * n[:, None])
        self.sums += own + own.T
        lag = 1
        while lag < len(term):
            same = np.flatnonzero(term[lag:] == term[:-lag])
            if not len(same):
                break
            i, j = a[same], a[same + lag]
            x, y = p[same], p[same + lag]
            more = gap(x, y) - gap(x, self.base[j]) - gap(self.base[i], y) + self.zero[i, j]
            np.add.at(self.sums, (i, j), more)
            np.add.at(self.sums, (j, i), more)
            lag += 1

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        i, j = np.nonzero(np.triu(self.wanted, 1))
        return self.index[i], self.index[j], self.sums[i, j]


def _pair_sums(block: int, chunk: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come by language, block pair and bucket, in each first the sources (empty term), then the terms in order."""

    class Bucket:
        def __init__(self, key: tuple[str, int, int, int]):
            self.key, self.head, self.kept, self.pairs = key, [], [], None

        def feed(self, last: bool) -> None:
            if self.pairs is None:
                index, base, terms = (np.array(x, np.int64) for x in zip(*sorted(self.head)))
                lang, i, j, bucket = self.key
                self.pairs = _Pairs(index, base, block if i != j else 0, int(terms[0]) if bucket == 0 else 0)
            if self.kept and (last or sum(len(x[0]) for x in self.kept) >= chunk):
                term, index, p = (np.concatenate(x) for x in zip(*self.kept))
                # The last term may go on.
                number = np.cumsum(np.concatenate([[0], term[1:] != term[:-1]]))
                n = len(term) if last else int(np.searchsorted(number, number[-1]))
                self.pairs.add(number[:n], index[:n], p[:n])
                self.kept = [(term[n:], index[n:], p[n:])] if n < len(term) else []

        def sums(self) -> pa.RecordBatch:
            self.feed(True)
            i, j, s = self.pairs.rows()
            return pa.RecordBatch.from_arrays([pa.array([self.key[0]] * len(i), pa.string()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(s)], names=["lang", "__a", "__b", "__part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for b in batches:
            if not b.num_rows:
                continue
            lang, i, j, bucket = b.column("lang").to_pylist(), *(b.column(c).to_numpy().tolist() for c in ("__i", "__j", "__bucket"))
            term, index, p, v = np.array(b.column("term").to_pylist(), object), b.column("idx").to_numpy().astype(np.int64), b.column("p").to_numpy(), b.column("v").to_numpy()
            keys = list(zip(lang, i, j, bucket))
            changes = [0, *(r for r in range(1, len(keys)) if keys[r] != keys[r - 1]), len(keys)]
            for lo, hi in zip(changes, changes[1:]):
                if now is None or keys[lo] != now.key:
                    if now:
                        yield now.sums()
                    now = Bucket(keys[lo])
                first = np.flatnonzero(term[lo:hi] == "") + lo
                now.head += zip(index[first].tolist(), p[first].tolist(), v[first].tolist())
                lo += len(first)
                if lo < hi:
                    now.kept.append((term[lo:hi], index[lo:hi], p[lo:hi]))
                    now.feed(False)
        if now:
            yield now.sums()

    return run


def source_divergence(docs: DataFrame, least_docs: int = 10, top: int = 10, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", block: int = BLOCK, chunk: int = CHUNK, leaf: int = LEAF) -> DataFrame:
    """How far the sources of a language are apart (part ``pair``), and the terms that mark each source (part ``term``).

    Terms are runs of letters and non-ASCII characters, A-Z lower-cased; a language keeps the terms of at
    least ``least_docs`` of its documents. Shares are smoothed whole numbers of 10^-9; the gap of two
    shares is floor((p-q)^2 / (p+q)), summed over all kept terms of two sources, or of a source and its
    language. Counts are summed in tasks first, then by (language, source, term). A pair's sum starts from
    the baseline that all missing terms share, and only terms that occur correct it, in blocks of sources.
    Ranks come from histograms over the bits of the values, see ``radix_select``.

    Null language, source and text count as empty. Every (language, source) takes part, also without
    terms (all values 0 where a language keeps none); repeated rows count as often as they occur; other
    columns are ignored; an empty table gives no rows. Returns lang, source, part, item, value, rank.
    """
    spark = docs.sparkSession
    ship_package(spark)
    table = f"{checkpoint_path(spark)}/terms-{uuid4().hex}"
    same = W.partitionBy("lang", "term")
    counts = term_counts(docs, lang_col, source_col, text_col)
    counts = counts.withColumns({"__docs": F.sum("df").over(same), "total": F.sum("tf").over(same), "__lead": (F.row_number().over(same.orderBy("source")) == 1).cast("int")})
    counts = counts.where((F.col("term") == "") | (F.col("__docs") >= least_docs)).select("lang", "source", "term", "tf", "total", "__lead")
    counts.write.option("compression", "zstd").parquet(table)
    counts = spark.read.parquet(table)
    real = F.col("term") != ""
    groups = counts.groupBy("lang", "source").agg(F.sum("tf").alias("n"), F.sum(F.when(real, F.col("__lead")).otherwise(0)).alias("v"), F.count(F.when(real, 1)).alias("size"))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum("v").alias("v"))
    groups = groups.drop("v").join(langs, "lang").withColumn("idx", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    groups = cut_lineage(groups.withColumn("__sources", F.max("idx").over(W.partitionBy("lang")) + 1))
    rows = join_groups(counts.where(real).select("lang", "source", "term", "tf", "total"), groups, ["lang", "source"], "size", counts.count(), F.col("term"))
    rows = rows.withColumn("p", smoothed("tf", "n", "v"))

    terms = rows.withColumn("q", smoothed("total", "n_lang", "v")).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("((p - q) * (p - q)) div (p + q)").alias("value"))
    terms = radix_select(terms, ["lang", "source"], "value", "item", top, leaf)

    heads = groups.select("lang", F.lit("").alias("term"), "idx", smoothed("0", "n", "v").alias("p"), "v", "__sources")
    blocks = groups.groupBy("lang").agg(F.max("__sources").alias("s")).agg(F.sum(F.expr(f"ceil(s / {block}) * (ceil(s / {block}) + 1) div 2"))).head()[0] or 1
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(1, -(-parts // int(blocks)))
    mine, others = F.expr(f"idx div {block}"), F.explode(F.expr(f"sequence(0, (__sources - 1) div {block})"))
    both = rows.select("lang", "term", "idx", "p", "v", "__sources", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("__bucket"))
    both = both.unionByName(heads.withColumn("__bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))))
    both = both.withColumn("__o", others).withColumn("__i", F.least(mine, "__o").cast("int")).withColumn("__j", F.greatest(mine, "__o").cast("int")).drop("__o", "__sources")
    sorted_ = both.repartition(parts, "lang", "__i", "__j", "__bucket").sortWithinPartitions("lang", "__i", "__j", "__bucket", "term")
    sums = sorted_.mapInArrow(_pair_sums(block, chunk), "lang string, __a int, __b int, __part long").groupBy("lang", "__a", "__b").agg(F.sum("__part").alias("value"))
    way = F.explode(F.array(F.struct(F.col("__a").alias("x"), F.col("__b").alias("y")), F.struct(F.col("__b").alias("x"), F.col("__a").alias("y"))))
    sums = sums.select("lang", "value", way.alias("w")).select("lang", "value", F.col("w.x").alias("x"), F.col("w.y").alias("y"))
    sums = sums.join(groups.select("lang", F.col("idx").alias("x"), "source"), ["lang", "x"]).join(groups.select("lang", F.col("idx").alias("y"), F.col("source").alias("item")), ["lang", "y"])
    pairs = radix_rank(cut_lineage(sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value")), ["lang", "source"], "value", "item")
    terms = cut_lineage(terms)
    drop_table(spark, table)
    return pairs.unionByName(terms)
