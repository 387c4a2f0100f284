"""Near-duplicate documents by wide SimHash fingerprints and an exact check of Jaccard similarity (operator 3 in the pipeline)."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import islice, repeat
from math import acos, pi
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import join_groups, text_of
from tidemark.llm.graph import components
from tidemark.llm.simhash import FAMILY, MIDDLE, NEAREST, allocate_recall, apart_pairs, bit_counts, in_several_groups, near_pairs, unpacked
from tidemark.session import checkpoint_path, cut_lineage, drop_table, ship_package

SEED = 42
#: Bits of a fingerprint. All of them go with every signature, so a bucket's pairs are settled inside it and no pair is joined to its fingerprints.
BITS = 512
#: The chance with which a pair at the similarity bound must meet in a probe.
RECALL = 0.98
#: Bits' rate of difference above the one expected at the bound up to which pairs are compared exactly.
SLACK = 0.04
#: Distinct fingerprints of a bucket that one task streams; larger buckets are dealt over several.
PER_BUCKET = 200_000
#: Texts that are in a pair are fetched by broadcast of their 16-byte hashes up to this many, beyond by a shuffle.
BROADCAST_TEXTS = 1_000_000
#: Rows to drop are broadcast up to this many; beyond, documents and rows meet in a shuffle.
BROADCAST_ROWS = 1_000_000


def shingles(text: bytes, width: int) -> np.ndarray:
    """The distinct hashes of the text's word shingles; a shorter text is one shingle, a text without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    parts = map(b" ".join, zip(*[islice(words, k, None) for k in range(width)], strict=False)) if len(words) >= width else iter([b" ".join(words)])
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, max(1, len(words) - width + 1)))


_LANES = np.random.default_rng(SEED).integers(1, 2**63, BITS // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_fingerprint(grams: np.ndarray) -> np.ndarray:
    """``BITS`` bits, each set if it is set in over half of the hashes; eight hashes are drawn from one."""
    votes = np.zeros(BITS, np.int64)
    for at in range(0, len(grams), 255):
        x = grams[at : at + 255, None] * _LANES
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        votes += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(grams), bitorder="little")


def _text_key(text: Column) -> Column:
    """128 bits that tell texts apart."""
    return F.unhex(F.md5(text.cast("binary")))


def wide_prints(docs: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(__id, __t, __fp) of every row: the text's 128-bit hash and its fingerprint."""
    ship_package(docs.sparkSession)
    t = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("__id"), _text_key(t).alias("__t"), t.alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [wide_fingerprint(shingles(t.as_buffer().to_pybytes(), width)).tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(prints, pa.binary())], names=["__id", "__t", "__fp"])

    return rows.mapInArrow(run, f"__id {rows.schema['__id'].dataType.simpleString()}, __t binary, __fp binary")


CHECKS = tuple(f"__check{k}" for k in range(BITS // 64))


def signatures(prints: DataFrame, plan: list[list[tuple[list[int], int]]]) -> DataFrame:
    """(__bucket, __node, and the fingerprint as CHECKS): the probes of every (__s, __fp), with flipped bits up to each part's threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = unpacked(b.column(1), BITS).astype(np.int64)
            check = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64).reshape(-1, len(CHECKS)).T
            out = []
            for k, probe in enumerate(plan):
                places = [x for part, _ in probe for x in part]
                own = np.int64(k) << 50 | bits[:, places] @ (np.int64(1) << np.arange(len(places), dtype=np.int64))
                out += [own, *([own ^ (np.int64(1) << i) for i in range(len(places))] if probe[0][1] else [])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(out) if out else np.zeros(0, np.int64)), pa.array(np.tile(b.column(0).to_numpy(), len(out))), *[pa.array(np.tile(c, len(out))) for c in check]], names=["__bucket", "__node", *CHECKS]
            )

    return prints.select("__s", "__fp").mapInArrow(run, ", ".join(f"{c} long" for c in ("__bucket", "__node", *CHECKS)))


def shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(s, grams) of every row of a node and its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [shingles(t.as_buffer().to_pybytes(), width) for t in b.column(1)]
            at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
            grams = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), grams], names=["s", "grams"])

    return texts.mapInArrow(run, "s long, grams array<long>")


#: Places that a set's hashes fall on in its profile.
PLACES = 2048


def profiles(texts: DataFrame, width: int) -> DataFrame:
    """(s, __n, __map) of every row of a node and its text: how many shingles it has, and which places they hash to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [shingles(t.as_buffer().to_pybytes(), width) for t in b.column(1)]
            maps = []
            for grams in parts:
                held = np.zeros(PLACES, bool)
                held[(grams % np.uint64(PLACES)).astype(np.int64)] = True
                maps.append(np.packbits(held).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(p) for p in parts], pa.int64()), pa.array(maps, pa.binary())], names=["s", "__n", "__map"])

    return texts.mapInArrow(run, "s long, __n long, __map binary")


def both_sides(pairs: DataFrame, known: DataFrame, value: str) -> DataFrame:
    """Pairs (a, b) with ``value`` of both nodes; nodes that are in many pairs are broadcast."""
    # Both counts are of the bare pairs: taken of the joined ones, they would run the first join twice.
    bare, total = pairs, pairs.count()
    for side, other in (("b", "a"), ("a", "b")):
        own = known.select(F.col("s").alias(side), F.col(value).alias(f"{side}_{value}"))
        own = own.join(bare.groupBy(side).agg(F.count(F.lit(1)).alias(f"{side}_pairs")), side)
        pairs = join_groups(pairs, own, [side], f"{side}_pairs", total, F.col(other)).drop(f"{side}_pairs")
    return pairs


def candidates(prints: DataFrame, n: int, similarity: float, table: str, family: tuple[int, int, int] = (FAMILY, NEAREST, MIDDLE)) -> tuple[DataFrame, DataFrame, int]:
    """Pairs (a, b) of nodes that meet in a probe and whose fingerprints differ little enough; the signatures of buckets in which pairs of large groups were left out, and the number of bits."""
    # Sets of one size and Jaccard similarity J have cosine 2J / (1 + J); a bit differs at the rate of their angle.
    rate = acos(2 * similarity / (1 + similarity)) / pi
    plan = allocate_recall(bit_counts(prints.select("__fp"), BITS), n, rate, RECALL)
    # A fingerprint comes once for each probe: compressed columns hold it nearly once. The table is removed by node_groups.
    signatures(prints, plan).write.option("compression", "zstd").parquet(table)
    rows = prints.sparkSession.read.parquet(table)
    most = round(BITS * (rate + SLACK))
    hot = rows.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") > PER_BUCKET)
    spread = 1 + F.pmod(F.xxhash64("__node"), F.ceil(F.col("__size") / PER_BUCKET)).cast("int")
    # At most rows / PER_BUCKET buckets are hot.
    rows = rows.join(F.broadcast(hot), "__bucket", "left").withColumn("__spread", F.coalesce(spread, F.lit(0)))
    # Pairs have no fingerprint: compressed columns hold next to nothing for it.
    near_pairs(rows, most, False, CHECKS, family).write.option("compression", "zstd").parquet(f"{table}-found")
    found = prints.sparkSession.read.parquet(f"{table}-found")
    again = found.where("a is not null and b is null").select("__bucket", F.lit(0).alias("__spread"), F.col("a").alias("__node"), *CHECKS)
    pairs = found.where("b is not null").select("a", "b")
    more = cut_lineage(near_pairs(again, most, False, CHECKS, family))
    pairs = cut_lineage(pairs.unionByName(more.where("b is not null").select("a", "b")).distinct())
    cut = found.where("a is null").select("__bucket").union(more.where("a is null").select("__bucket")).distinct()
    cut = cut_lineage(rows.join(cut, "__bucket", "left_semi").select("__bucket", "__node", *CHECKS))
    return pairs, cut, most


def texts_of(docs: DataFrame, prints: DataFrame, nodes: DataFrame, text_col: str) -> DataFrame:
    """(__s, __text) of the nodes (__s); a text that several rows have comes as often."""
    near = cut_lineage(nodes.join(prints.select("__s", "__t"), "__s"))
    near = F.broadcast(near) if near.count() <= BROADCAST_TEXTS else near
    t = text_of(text_col)
    return docs.select(t.alias("__text"), _text_key(t).alias("__t")).join(near, "__t").select("__s", "__text")


def undecided(pairs: DataFrame, similarity: Fraction) -> DataFrame:
    """(a, b) of pairs with profiles (a_p, b_p) that these do not prove to be under the similarity (see ``apart_pairs``)."""
    num, den = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = b.column("a_p"), b.column("b_p")
            size = [c.field("__n").to_numpy() for c in (x, y)]
            held = [np.frombuffer(b"".join(c.field("__map").to_pylist()), np.uint64).reshape(b.num_rows, -1) for c in (x, y)]
            shared = np.minimum(size[0] - np.bitwise_count(held[0] & ~held[1]).sum(1), size[1] - np.bitwise_count(held[1] & ~held[0]).sum(1))
            may = pa.array(shared * (num + den) >= (size[0] + size[1]) * num)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(may), b.column("b").filter(may)], names=["a", "b"])

    return pairs.select("a", "b", "a_p", "b_p").mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, prints: DataFrame, pairs: DataFrame, text_col: str, width: int, similarity: Fraction, sketched: bool = False) -> DataFrame:
    """Those of the pairs (a, b) of nodes whose sets of shingles have the similarity; with ``sketched`` profiles tell most others apart before sets are fetched."""
    nodes = pairs.select(F.col("a").alias("__s")).union(pairs.select("b")).distinct()
    if sketched:
        known = profiles(texts_of(docs, prints, nodes, text_col), width).groupBy("s").agg(F.first(F.struct("__n", "__map")).alias("p"))
        pairs = cut_lineage(undecided(both_sides(pairs, cut_lineage(known), "p"), similarity))
        nodes = pairs.select(F.col("a").alias("__s")).union(pairs.select("b")).distinct()
    sets = cut_lineage(shingle_sets(texts_of(docs, prints, nodes, text_col), width).groupBy("s").agg(F.first("grams").alias("grams")))
    both = both_sides(pairs, sets, "grams")
    shared = F.size(F.array_intersect("a_grams", "b_grams"))
    every = F.size("a_grams") + F.size("b_grams")
    return both.where(shared * (similarity.numerator + similarity.denominator) >= every * similarity.numerator).select("a", "b")


def node_groups(docs: DataFrame, prints: DataFrame, n: int, text_col: str, width: int, similarity: Fraction, family: tuple[int, int, int]) -> DataFrame:
    """(node, root) of the distinct fingerprints that are linked to others.

    In buckets with large groups the first pass leaves pairs out. Where its links do not already hold all
    rows of such a bucket together, every pair of rows with different roots is compared; pairs of one root
    would change nothing. So no link between two groups that meet in a bucket is lost. Texts made of one
    template can be near one another without being similar enough, in numbers that grow with the square
    of the group, so the comparison is by profiles that prove most of them apart where they meet; only
    the others are pairs that go on.
    """
    spark = docs.sparkSession
    table = f"{checkpoint_path(spark)}/signatures-{uuid4().hex}"
    pairs, cut, most = candidates(prints, n, float(similarity), table, family)
    drop_table(spark, table)
    drop_table(spark, f"{table}-found")
    edges = cut_lineage(verified(docs, prints, pairs, text_col, width, similarity, True))
    roots = components(edges, "a", "b")
    if cut.isEmpty():
        return roots
    named = cut.join(roots.select(F.col("node").alias("__node"), F.col("root").alias("__root")), "__node", "left").withColumn("__root", F.coalesce("__root", "__node"))
    named = cut_lineage(in_several_groups(named))
    if named.isEmpty():
        return roots
    texts = texts_of(docs, prints, named.select(F.col("__node").alias("__s")).distinct(), text_col)
    own = profiles(texts, width).groupBy(F.col("s").alias("__node")).agg(F.first("__n").alias("__n"), F.first("__map").alias("__map"))
    rest = apart_pairs(named.join(own, "__node"), most, CHECKS, (similarity.numerator, similarity.denominator))
    rest = cut_lineage(rest.join(pairs, ["a", "b"], "left_anti"))
    if rest.isEmpty():
        return roots
    more = verified(docs, prints, rest, text_col, width, similarity)
    # Groups that the new links bring together, as links between their roots.
    root = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
    joined = more.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    again = components(joined, "a", "b").select(F.col("node").alias("__was"), F.col("root").alias("__now"))
    nodes = roots.unionByName(again.select(F.col("__was").alias("node"), F.col("__was").alias("root")).join(roots.select("node"), "node", "left_anti"))
    return nodes.join(again, nodes["root"] == again["__was"], "left").select("node", F.coalesce("__now", "root").alias("root"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, family: tuple[int, int, int] = (FAMILY, NEAREST, MIDDLE)) -> DataFrame:
    """(__id, __t, __root, __rows): every row with its group over pairs of at least the Jaccard ``similarity`` of their word shingles, and the group's rows.

    Words are runs of non-white characters after lower-casing A-Z; a text's shingles are a set, compared by
    64-bit hashes; texts shorter than ``width`` words are one shingle, texts without words are alike.
    Sets with equal fingerprints of 512 bits are one node, whose sets are not compared. Others are compared
    where a probe brings them together, which a pair at the bound does with a chance of ``RECALL``. An empty
    table gives no rows; other columns are ignored.
    """
    share = Fraction(str(similarity))
    rows = cut_lineage(wide_prints(docs, id_col, text_col, width)).withColumn("__s", F.xxhash64("__fp"))
    prints = cut_lineage(rows.groupBy("__s", "__fp").agg(F.min("__t").alias("__t"), F.count(F.lit(1)).alias("__size")))
    n, total = prints.count(), rows.count()
    roots = node_groups(docs, prints, n, text_col, width, share, family).select(F.col("node").alias("__s"), F.col("root").alias("__root"))
    known = cut_lineage(prints.select("__s", "__size").join(roots, "__s", "left").withColumn("__root", F.coalesce("__root", "__s")))
    groups = known.groupBy("__root").agg(F.count(F.lit(1)).alias("__prints"), F.sum("__size").alias("__rows"))
    # A set of one row and no links needs no join.
    named = join_groups(known, groups.where("__rows > 1"), ["__root"], "__prints", n, F.col("__s")).where("__rows is not null").select("__s", "__root", "__rows", "__size")
    return join_groups(rows.select("__id", "__t", "__s"), named, ["__s"], "__size", total, F.col("__t")).select(
        "__id", "__t", F.coalesce("__root", "__s").alias("__root"), F.coalesce("__rows", F.lit(1)).cast("long").alias("__rows")
    )


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Of each group of near copies the row with the smallest id, with all its columns; the others go.

    Null ids come after all others; of equal ids the text with the smallest hash stays, and of rows equal
    in both exactly one. Null texts count as empty. Rows are told apart by id and text, so a document
    whose id another group's loser has too is not touched.
    """
    found = cut_lineage(similar_groups(docs, id_col, text_col, width, similarity).where("__rows > 1"))
    order = F.struct(F.col("__id").isNull().alias("late"), F.col("__id").alias("id"), F.col("__t").alias("t"))
    best = found.groupBy("__root").agg(F.min(order).alias("__best"), F.max("__rows").alias("__rows"))
    total = docs.count()
    marks = join_groups(found.select("__id", "__t", "__root"), best, ["__root"], "__rows", total, F.col("__t"))
    marks = cut_lineage(marks.groupBy("__id", "__t").agg((F.first("__best") == F.first(order)).alias("__stays"), F.count(F.lit(1)).alias("__times")))
    t = _text_key(text_of(text_col))
    small = lambda x: F.broadcast(x) if x.count() <= BROADCAST_ROWS else x
    on = lambda right: docs[id_col].eqNullSafe(right["__id"]) & (t == right["__t"])
    losers = small(marks.where("not __stays"))
    out = docs.join(losers, on(losers), "left_anti")
    again = marks.where("__stays and __times > 1")
    if again.isEmpty():
        return out
    again = small(again)
    once = out.join(again, on(again), "left_semi").withColumn("__t", t).dropDuplicates([id_col, "__t"]).drop("__t")
    return out.join(again, on(again), "left_anti").unionByName(once)
