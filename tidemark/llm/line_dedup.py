"""Near-duplicate lines by a deletion-neighbourhood join (operator 7, DataFrame functions only)."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import WHITE, join_groups, text_of, words_of
from tidemark.session import checkpoint_path, cut_lineage, drop_table

#: Lines that may have a near copy are fetched by broadcast of their 16-byte hashes up to this many, beyond by a shuffle.
BROADCAST_LINES = 2_000_000


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __no, __line, __l): the lines with a word, in lower case, and 128 bits that tell different lines apart."""
    rows = docs.select(F.col(id_col).alias("__id"), F.posexplode(F.split(F.lower(text_of(text_col)), "\n")).alias("__no", "__line"))
    return rows.where(F.btrim("__line", F.lit(WHITE)) != "").withColumn("__l", F.unhex(F.md5(F.col("__line").cast("binary"))))


def _order(id_name: str = "__id", no: str = "__no") -> Column:
    """Earlier documents first, null ids last, then earlier lines."""
    return F.struct(F.col(id_name).isNull().alias("late"), F.col(id_name).alias("id"), F.col(no).alias("no"))


def _half_keys(words: Column, min_words: int) -> Column:
    """Hashes of the first and last halves. Lines one word edit apart share at least one of them.

    A line of n words is halved at n div 2 and at (n - 1) div 2, so lines of n and n - 1 words meet.
    Lines too short for an edit only meet lines of the same words.
    """
    n = F.size(words)
    half = lambda h, first: F.xxhash64(F.lit(first), h, F.slice(words, F.lit(1) if first else n - h + 1, h))
    a, b = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")
    # For odd n both halves are the same.
    keys = F.when(a == b, F.array(half(a, True), half(a, False))).otherwise(F.array(half(a, True), half(b, True), half(a, False), half(b, False)))
    return F.when(n >= min_words - 1, keys).otherwise(F.array(F.xxhash64(words)))


def _one_edit(a: str, b: str) -> Column:
    """True if at most one word is inserted, deleted or replaced between two word arrays."""
    x, y = F.col(a), F.col(b)
    short, long_ = F.when(F.size(x) <= F.size(y), x).otherwise(y), F.when(F.size(x) <= F.size(y), y).otherwise(x)
    differ = F.zip_with(short, F.slice(long_, F.lit(1), F.greatest(F.size(short), F.lit(1))), lambda p, q: ~p.eqNullSafe(q))
    at = F.array_position(differ, True).cast("int")
    at = F.when(at == 0, F.size(short) + 1).otherwise(at)
    rest = F.size(long_) - at
    inserted = F.slice(short, at, F.greatest(rest, F.lit(0))) == F.slice(long_, at + 1, F.greatest(rest, F.lit(0)))
    replaced = F.slice(short, at + 1, F.greatest(rest, F.lit(0))) == F.slice(long_, at + 1, F.greatest(rest, F.lit(0)))
    return (x == y) | F.when(F.size(x) == F.size(y), replaced).otherwise((F.size(long_) - F.size(short) == 1) & inserted)


def near_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 5) -> DataFrame:
    """Every line with a word, whether it stays, and the earliest line that it repeats.

    Lines are compared in lower case, word by word. A line goes if an earlier one (by document id, then line
    number) is equal to it, or differs by one inserted, deleted or replaced word where the longer has at
    least ``min_words``. Each distinct line that shares a half with another emits the hashes of all its
    one-word deletions; equal variants meet, the earliest line of each meeting is verified word by word.

    Variant hashes are XORs of (word, place) hashes taken from running sums, so a line of n words costs n
    rows however long it is. Groups are reduced to their earliest member before anything is joined; hot
    ones are spread. Null and empty texts have no lines; lines without a word are not listed and are
    never touched; rows that share an id count as one document; other columns are ignored.
    Returns id, line_no (from 0), kept, first_id, first_line_no (null where the line stays).
    """
    lines = _lines(docs, id_col, text_col).withColumn("__words", words_of(F.col("__line")))
    lines = cut_lineage(lines.select("__id", "__no", "__l", _half_keys(F.col("__words"), min_words).alias("__keys")))
    n = lines.count()
    firsts = cut_lineage(lines.groupBy("__l").agg(F.min(_order()).alias("__first"), F.count(F.lit(1)).alias("__times")))

    # Distinct lines that share a half with another distinct line.
    halves = cut_lineage(lines.select("__l", F.explode("__keys").alias("__key")).distinct())
    shared = halves.groupBy("__key").agg(F.count(F.lit(1)).alias("__size")).where("__size > 1")
    near = join_groups(halves, shared, ["__key"], "__size", 4 * n, F.col("__l")).where("__size is not null").select("__l").distinct()
    near = cut_lineage(near)
    near = F.broadcast(near) if near.count() <= BROADCAST_LINES else near
    texts = _lines(docs, id_col, text_col).join(near, "__l", "left_semi").groupBy("__l").agg(F.first("__line").alias("__line"))
    texts = cut_lineage(texts.select("__l", words_of(F.col("__line")).alias("__words")))

    # One row per word: the hash of the line without it, from what stands before and, moved up by one, after it.
    words = texts.repartition("__l").select("__l", F.size("__words").alias("__n"), F.posexplode("__words").alias("__i", "__word"))
    words = words.select("__l", "__n", "__i", F.xxhash64("__word", "__i").alias("__here"), F.xxhash64("__word", F.col("__i") - 1).alias("__up"))
    line = W.partitionBy("__l")
    upto = line.orderBy("__i").rowsBetween(W.unboundedPreceding, 0)
    words = words.withColumns(
        {"__h": F.bit_xor("__here").over(upto), "__u": F.bit_xor("__up").over(upto), "__uall": F.bit_xor("__up").over(line)}
    )
    without = F.col("__h").bitwiseXOR(F.col("__here")).bitwiseXOR(F.col("__uall")).bitwiseXOR(F.col("__u"))
    row = lambda m, i, v: F.struct(m.alias("__m"), i.alias("__i"), v.alias("__v"))
    less = F.when(F.col("__n") >= min_words, row(F.col("__n") - 1, F.col("__i"), without))
    full = F.when(F.col("__i") == F.col("__n") - 1, row(F.col("__n"), F.lit(-1), F.col("__h")))
    table = f"{checkpoint_path(docs.sparkSession)}/variants-{uuid4().hex}"
    words.select("__l", F.inline(F.array_compact(F.array(less, full)))).write.parquet(table)
    variants = docs.sparkSession.read.parquet(table)

    # Most variants meet no other line's; the rest take their line's first place along.
    other = F.xxhash64("__l")
    met = variants.groupBy("__v", "__m").agg(F.count(F.lit(1)).alias("__size"), F.min(other).alias("__lo"), F.max(other).alias("__hi")).where("__lo <> __hi").select("__v", "__m", "__size")
    alive = join_groups(variants, met, ["__v", "__m"], "__size", variants.count(), F.col("__l")).where("__size is not null").drop("__size")
    alive = cut_lineage(alive.join(firsts.select("__l", "__first"), "__l"))
    drop_table(docs.sparkSession, table)
    m = alive.count()
    who = F.struct("__first", "__l")

    # Replaced: the same deletion at the same place. Inserted: a deletion equal to a whole line. Equal words: two whole lines.
    same = alive.groupBy("__v", "__m", "__i").agg(F.min(who).alias("__who"), F.count(F.lit(1)).alias("__size")).where("__size > 1")
    replaced = join_groups(alive, same, ["__v", "__m", "__i"], "__size", m, F.col("__l")).where("__size is not null").select("__l", "__who")
    whole = F.col("__i") < 0
    both = alive.groupBy("__v", "__m").agg(
        F.min(F.when(whole, who)).alias("__whole"), F.min(F.when(~whole, who)).alias("__less"), F.count(F.lit(1)).alias("__size")
    ).where("__whole is not null and __less is not null")
    inserted = join_groups(alive, both, ["__v", "__m"], "__size", m, F.col("__l")).where("__size is not null")
    inserted = inserted.select("__l", F.when(whole, F.col("__less")).otherwise(F.col("__whole")).alias("__who"))
    pairs = replaced.unionByName(inserted).select("__l", F.col("__who.__l").alias("__other"), F.col("__who.__first").alias("__before")).where("__l <> __other").distinct()
    one = texts.select("__l", "__words").join(firsts.select("__l", "__first"), "__l")
    two = texts.select(F.col("__l").alias("__other"), F.col("__words").alias("__theirs"))
    pairs = pairs.join(one, "__l").where(F.col("__before") < F.col("__first")).join(two, "__other").where(_one_edit("__words", "__theirs"))
    before = pairs.groupBy("__l").agg(F.min("__before").alias("__near"))

    verdict = firsts.join(before, "__l", "left").select("__l", "__times", "__first", "__near").where("__times > 1 or __near is not null")
    out = join_groups(lines.select("__id", "__no", "__l"), verdict, ["__l"], "__times", n, F.col("__id"))
    first = F.coalesce("__near", F.when(F.col("__first") < _order(), F.col("__first")))
    out = out.withColumn("__gone", first)
    return out.select(
        F.col("__id").alias(id_col),
        F.col("__no").alias("line_no"),
        F.col("__gone").isNull().alias("kept"),
        F.col("__gone.id").alias("first_id"),
        F.col("__gone.no").alias("first_line_no"),
    )
