"""Exact deduplication by progressive refinement (operator 9, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import expand_copies, join_groups, lower_az, text_of
from tidemark.session import cut_lineage

#: A refinement level is broadcast while it has at most this many groups (16 bytes each); beyond, rows and groups meet in a shuffle.
BROADCAST_GROUPS = 2_000_000
#: Characters whose hash stands for a text's beginning.
PREFIX = 64


def _meet(rows: DataFrame, groups: DataFrame, keys: list[str], n: int) -> DataFrame:
    """``rows`` with the __size of their group, null where ``groups`` has none."""
    groups = cut_lineage(groups)
    if groups.count() <= BROADCAST_GROUPS:
        return rows.join(F.broadcast(groups), keys, "left")
    return join_groups(rows, groups, keys, "__size", n, F.col("__id"))


def _lengths(id_col: str, text_col: str, prefix_chars: int) -> list[Column]:
    text = text_of(text_col)
    return [F.col(id_col).alias("__id"), F.octet_length(text).alias("__len"), F.xxhash64(lower_az(F.substring(text, 1, prefix_chars))).alias("__head")]


def _digest(text_col: str) -> Column:
    return F.sha2(lower_az(text_of(text_col)), 256)


def _grouped(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int, digests: bool) -> DataFrame:
    """Every row with its group: __id, __len, __head, __key (the digest, if the row has company or with ``digests``), __keep, __size, __copy."""
    base = docs.select(*_lengths(id_col, text_col, prefix_chars), *([_digest(text_col).alias("__sha")] if digests else [text_of(text_col).alias("__text")]))
    rows = cut_lineage(base.select("__id", "__len", "__head", *(["__sha"] if digests else [])))
    n = rows.count()
    sizes = lambda df, *keys: df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")).where("__size > 1")
    live = _meet(rows, sizes(rows, "__len"), ["__len"], n).where("__size is not null").drop("__size")
    # Without digests the texts of the groups that are left are read once more, to be hashed in full.
    found = _meet(rows if digests else base, sizes(live, "__len", "__head"), ["__len", "__head"], n)
    alone = F.concat(F.lit("~"), F.coalesce(F.col("__id").cast("string"), F.lit("")), F.lit("~"), F.col("__len").cast("string"), F.lit("~"), F.col("__head").cast("string"))
    key = F.when(F.col("__size").isNotNull(), F.col("__sha") if digests else _digest("__text")).otherwise(alone)
    rows = found.select("__id", "__len", "__head", key.alias("__key"), *(["__sha"] if digests else []))
    rows = cut_lineage(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("__times")))
    groups = rows.groupBy("__key").agg(F.max("__id").alias("__keep"), F.sum("__times").alias("__size")).where("__size > 1")
    out = join_groups(rows, groups, ["__key"], "__size", n, F.col("__id"))
    out = out.withColumns({"__keep": F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__keep")), "__size": F.coalesce("__size", F.lit(1).cast("long"))})
    return expand_copies(out, "__times", "__copy").withColumn("__kept", F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("__copy") == 0))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX, digests: bool = False) -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z; the row with the largest id stays.

    Rows are grouped by byte length, the rows of shared lengths by a hash of their first characters, and
    only rows of groups that still have company are grouped by their full hash (SHA-256). The levels work
    on narrow rows (id, length, prefix hash), written once. Hot groups (copies that make up a third of
    all rows) are counted before any shuffle and joined by broadcast.

    Null texts count as empty. Rows equal in id and text are one document met several times: exactly one
    of them is kept. A null id loses to any other; in a group of null ids one row stays. Other columns
    are ignored; an empty table gives no rows. Returns one row per input row: id, keep_id, group_size,
    kept, and with ``digests`` text_sha256 of every normalised text, which then is taken in the one pass
    over the texts.
    """
    out = _grouped(docs, id_col, text_col, prefix_chars, digests)
    return out.select(
        F.col("__id").alias(id_col), F.col("__keep").alias("keep_id"), F.col("__size").alias("group_size"), F.col("__kept").alias("kept"), *([F.col("__sha").alias("text_sha256")] if digests else [])
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX) -> DataFrame:
    """The documents that ``exact_dedup`` keeps, with all their columns.

    Only the losers meet the documents again, by id, length and prefix hash; the full hash of a document is
    taken where all three agree. Where rows repeat both id and text, one of them is kept.
    """
    found = _grouped(docs, id_col, text_col, prefix_chars, False)
    marks = cut_lineage(found.where("not __kept").select("__id", "__len", "__head", "__key", "__keep").distinct())
    repeated = marks.where(F.col("__id").eqNullSafe(F.col("__keep")))
    losers = marks.where(~F.col("__id").eqNullSafe(F.col("__keep")))
    _, length, head = _lengths(id_col, text_col, prefix_chars)

    def on(right: DataFrame) -> Column:
        # Not an equality to Spark, so that it is asked only where the others hold.
        same = F.coalesce(_digest(text_col) == right["__key"], F.lit(False))
        return F.col(id_col).eqNullSafe(right["__id"]) & (length == right["__len"]) & (head == right["__head"]) & same

    small = lambda x: F.broadcast(x) if x.count() <= BROADCAST_GROUPS // 4 else x
    out = docs.join(small(losers), on(losers), "left_anti")
    if repeated.isEmpty():
        return out
    once = out.join(small(repeated), on(repeated), "left_semi").withColumn("__sha", _digest(text_col)).dropDuplicates([id_col, "__sha"]).drop("__sha")
    return out.join(small(repeated), on(repeated), "left_anti").unionByName(once)
