"""Sharding by a hierarchical weighted hash tree (operator 10, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import expand_copies, running_start, text_of


def tree(shards: int, base: int | None = None, racks: int = 2, per_rack: int = 4) -> list:
    """Regions of racks of (shard number, weight).

    The first ``base`` shards fill regions of ``racks`` racks with ``per_rack`` shards; what does not
    fill a region, and every shard added later, forms a region of its own, so no older weight changes.
    """
    base = shards if base is None else min(base, shards)
    each = racks * per_rack
    out = [[[(r * each + k * per_rack + s, 1.0) for s in range(per_rack)] for k in range(racks)] for r in range(base // each)]
    return out + [[[(s, 1.0)]] for s in range(base // each * each, shards)]


def _level(key: str, nodes: Column, seed: int) -> Column:
    """The node that wins a weighted draw: each draws an exponential variate of its weight's rate, the smallest wins."""
    u = lambda x: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(key), x["name"]), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return F.array_min(F.transform(nodes, lambda x: F.struct((-F.log(u(x)) / x["weight"]).alias("draw"), x["at"].alias("at"))))["at"]


def assign(df: DataFrame, key: str, topology: list, out: str, seed: int = 0) -> DataFrame:
    """Adds the shard of ``key``: a weighted draw among regions, then among its racks, then among their shards.

    A node is named by its level and the smallest shard number below it. A change of weights only moves
    keys into or out of nodes on the path to the changed shard; a new shard in a region of its own takes
    keys only into itself.
    """
    node = lambda name, weight, at: F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight"), F.lit(at).alias("at"))
    racks_weight = lambda rack: sum(w for _, w in rack)
    regions = F.array(*[node(f"region {r[0][0][0]}", sum(map(racks_weight, r)), i) for i, r in enumerate(topology)])
    racks = F.array(*[F.array(*[node(f"rack {k[0][0]}", racks_weight(k), i) for i, k in enumerate(r)]) for r in topology])
    leaves = F.array(*[F.array(*[F.array(*[node(f"shard {s}", w, s) for s, w in k]) for k in r]) for r in topology])
    df = df.withColumn("__region", _level(key, regions, seed))
    df = df.withColumn("__rack", _level(key, F.get(racks, F.col("__region")), seed))
    return df.withColumn(out, _level(key, F.get(F.get(leaves, F.col("__region")), F.col("__rack")), seed)).drop("__region", "__rack")


def shard_documents(docs: DataFrame, shards: int = 40, grown: int | None = None, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """Every document's shard and its slot there, under the law ``key``: id and shard count decide.

    ``grown`` also gives the shard each document would have among so many. Slots number the rows of a
    shard from 0 without gaps, in an order given by a hash of the row, so no task has to hold a shard.
    Null texts count as empty, null ids share one shard; repeated rows get slots of their own; other
    columns are ignored. Returns id, size (UTF-8 bytes plus 16), text_crc32, law, shard, slot, grown_shard.
    """
    text = text_of(text_col)
    rows = docs.select(F.col(id_col).alias("__id"), (F.octet_length(text) + 16).cast("long").alias("__size"), F.crc32(text.cast("binary")).alias("__crc"))
    rows = rows.groupBy("__id", "__size", "__crc").agg(F.count(F.lit(1)).alias("__times"))
    rows = rows.withColumns({"__key": F.coalesce(F.col("__id").cast("string"), F.lit("null")), "__h": F.xxhash64("__id", "__size", "__crc")})
    rows = assign(rows, "__key", tree(shards), "__shard", seed)
    rows = assign(rows, "__key", tree(grown, shards), "__grown", seed) if grown else rows.withColumn("__grown", F.lit(None).cast("int"))
    rows = running_start(rows, "__shard", "__h", ["__id", "__size", "__crc"], "__times", docs.count(), "__start")
    rows = expand_copies(rows, "__times", "__copy")
    return rows.select(
        F.col("__id").alias(id_col),
        F.col("__size").alias("size"),
        F.col("__crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("__shard").alias("shard"),
        (F.col("__start") + F.col("__copy")).alias("slot"),
        F.col("__grown").alias("grown_shard"),
    )
