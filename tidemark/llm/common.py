"""Shared column expressions and skew-safe building blocks of the training-data operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The six ASCII white-space characters x20 and x09-x0D that separate words.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A group is hot if it holds over a thousandth of all rows; so there are fewer than a thousand hot groups.
HOT_SHARE = 1000


def text_of(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def lower_az(c: Column) -> Column:
    """A-Z lower-cased, every other character untouched; pure ASCII texts take the faster built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def words_of(c: Column) -> Column:
    """The runs of other characters between white space."""
    t = F.btrim(c, F.lit(WHITE))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, "[ \\x09-\\x0D]+"))


def expand_copies(df: DataFrame, n: str, index: str, chunk: int = 4096) -> DataFrame:
    """Each row ``n`` times, numbered from 0 in ``index``; two explodes keep every array at most ``chunk`` long for n up to chunk squared."""
    high = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / chunk).cast("long")))
    out = df.withColumn("__high", high)
    last = F.least(F.lit(chunk).cast("long"), F.col(n) - F.col("__high") * chunk) - 1
    out = out.withColumn("__low", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return out.withColumn(index, F.col("__high") * chunk + F.col("__low")).drop("__high", "__low")


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, spread: Column) -> DataFrame:
    """Left join of ``rows`` to one row per key of ``groups``, safe when one key holds a large share of ``rows``.

    Hot groups (more than total / HOT_SHARE rows, so under HOT_SHARE of them) are broadcast. Their rows
    go through the shuffle under a spread number that matches nothing; all other keys join as usual.
    """
    values = [c for c in groups.columns if c not in keys]
    hot = groups.where(F.col(size) * HOT_SHARE > total).select(*keys, *[F.col(v).alias(f"__hot_{v}") for v in values])
    # Always 0, but not a literal: Spark would take that out of the join keys and deal rows by the rest.
    zero = F.pmod(F.xxhash64(*keys), F.lit(1)).cast("int")
    cold = groups.where(F.col(size) * HOT_SHARE <= total).withColumn("__spread", zero)
    out = rows.join(F.broadcast(hot), keys, "left")
    is_hot = F.col(f"__hot_{size}").isNotNull()
    out = out.withColumn("__spread", F.when(is_hot, 1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int")).otherwise(0))
    out = out.join(cold, [*keys, "__spread"], "left")
    return out.select(*rows.columns, *[F.coalesce(f"__hot_{v}", v).alias(v) for v in values])


def block_bits(n: int, per_block: int = 4096) -> int:
    """Bits of block numbers that keep about ``per_block`` of ``n`` rows in a block."""
    return max(0, min(16, math.ceil(math.log2(max(1, n) / per_block))))


def block_of(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0)


def running_start(rows: DataFrame, group: str, h: str, ties: list[str], amount: str, n: int, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over the rows of the same group that come before, in order of hash ``h`` as an unsigned number.

    A group may hold most of the rows: it is cut into blocks of the hash, each block is numbered on its
    own and the blocks' sums (at most 65,536 a group) are added up before.
    """
    bits = block_bits(n)
    rows = rows.withColumn("__block", block_of(F.col(h), bits))
    sums = rows.groupBy(group, "__block").agg(F.sum(amount).alias("__sum"))
    before = W.partitionBy(group).orderBy("__block").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col(group).alias("__g"), F.col("__block").alias("__b"), F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    inner = W.partitionBy(group, "__block").orderBy(F.col(h).bitwiseXOR(F.lit(-(2**63))), *ties).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__inner", F.coalesce(F.sum(amount).over(inner), F.lit(0)))
    joined = rows.join(sums, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__block") == F.col("__b")))
    return joined.withColumn(out, F.col("__base") + F.col("__inner")).drop("__g", "__b", "__base", "__inner", "__block")
