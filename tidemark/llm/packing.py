"""Mixture-controlled packing of token sequences (operator 6)."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.common import text_of
from tidemark.session import checkpoint_path, ship_package

END = 1
#: The vocabulary's one special token; texts with it are left to the tokenizers library, which knows it.
SPECIAL = "<|endoftext|>"
#: The split pattern of the vocabulary, in the possessive form that does not back-track.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Bases of (partition, queue) pairs are broadcast up to this many.
BROADCAST_BASES = 500_000


@lru_cache(maxsize=4)
def _ranks(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(text: str, path: str, ranks_path: str) -> np.ndarray:
    """The ids of a text by the vocabulary at ``path``, then the end id; ``ranks_path`` has the same vocabulary as ranks."""
    if SPECIAL in text:
        ids = np.array(_tokenizer(path).encode(text, add_special_tokens=False).ids, np.uint32)
    else:
        ids = _ranks(ranks_path).encode_to_numpy(text, disallowed_special=())
    return np.append(ids, END).astype("<u4")


@lru_cache(maxsize=4)
def id_type(path: str) -> str:
    """Two bytes hold the ids of a vocabulary of up to 65,536 entries; larger ones take four."""
    return "<u2" if _tokenizer(path).get_vocab_size() <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, id_col: str, text_col: str, source_col: str, path: str, ranks_path: str) -> DataFrame:
    """Documents as token ids, with their place in their source's queue within the task's partition."""
    ship_package(docs.sparkSession)
    kept_as = id_type(path)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(source_col).cast("string").alias("__source"), text_of(text_col).alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, ends = TaskContext.get().partitionId(), {}
        for b in batches:
            starts, counts, data = [], [], []
            for source, text in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                ids = encode(text.as_py(), path, ranks_path)
                starts.append(ends.get(source, 0))
                counts.append(len(ids))
                data.append(ids.astype(kept_as).tobytes())
                ends[source] = starts[-1] + len(ids)
            arrays = [b.column(0), b.column(1), pa.array([part] * len(data), pa.int32()), pa.array(starts, pa.int64()), pa.array(counts, pa.int64()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["__id", "__source", "__part", "__local", "__n", "__ids"])

    kind = rows.schema["__id"].dataType.simpleString()
    return rows.mapInArrow(run, f"__id {kind}, __source string, __part int, __local long, __n long, __ids binary")


def cuts(start: int, n: int, below: int, upto: int, total: int, window: int) -> Iterator[tuple[int, int, int, int]]:
    """Pieces (offset in the document, length, sequence, offset there) of ``n`` tokens at ``start`` of a queue.

    After k windows the queues up to and including this one have together given floor(G * upto / total)
    tokens, G = min(k * window, total), and those before it floor(G * below / total): each queue's own
    share is what lies between. That is deficit round-robin with the deficits of all windows before
    carried along, in closed form, so no task needs another's state.
    """
    given = lambda k, c: min(k * window, total) * c // total
    own = lambda k: given(k, upto) - given(k, below)
    k = max(0, start * total // ((upto - below) * window) - 2)
    while own(k + 1) <= start:
        k += 1
    done = 0
    first = own(k)
    while done < n:
        last = own(k + 1)
        take = min(n - done, last - start - done)
        if take > 0:
            yield done, take, k, given(k + 1, below) - given(k, below) + start + done - first
        done += take
        first, k = last, k + 1


def pack_documents(
    docs: DataFrame, path: str, ranks_path: str, window: int = 2048, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """All documents as pieces of sequences of ``window`` tokens, each sequence mixed like the whole corpus.

    Every source is a queue, in table order; its target proportion is its share of all tokens, so all
    queues run out together and only the last sequence is short. Sources too small to give a token to
    every window share one queue (at most ``window`` sources are larger, so the driver's list is
    bounded). A queue's place in a window follows from its totals alone; partitions carry on where the
    one before ended. Token ids are written once to the shared checkpoint folder and not shuffled.

    Null texts are empty: they give the end id alone. Null sources are a source of their own; repeated
    rows are packed each; other columns are ignored; an empty table gives no rows. Returns per piece:
    id, start, length, ids_crc32, doc_tokens, sequence_id, offset.
    """
    spark = docs.sparkSession
    table = f"{checkpoint_path(spark)}/tokens-{uuid4().hex}"
    tokenize(docs, id_col, text_col, source_col, path, ranks_path).write.option("compression", "zstd").parquet(table)
    tokens = spark.read.parquet(table)

    ends = tokens.groupBy("__part", "__source").agg(F.sum("__n").alias("__sum"))
    total = ends.agg(F.coalesce(F.sum("__sum"), F.lit(0))).head()[0]
    kind = tokens.schema["__id"].dataType.simpleString()
    schema = f"{id_col} {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    if not total:
        return spark.createDataFrame([], schema)
    large = ends.groupBy("__source").agg(F.sum("__sum").alias("t")).where(F.col("t") * window >= total).collect()
    order = sorted(large, key=lambda r: (r["__source"] is None, r["__source"] or ""))
    bounds, at = [(0, total - sum(r["t"] for r in order))], total - sum(r["t"] for r in order)
    for r in order:
        bounds.append((at, at + r["t"]))
        at += r["t"]
    if order and 0 < bounds[0][1] * window < total:
        # The small sources together are still too small: they join the first large one.
        bounds[0] = bounds[1] = (0, bounds[1][1])
        shared = True
    else:
        shared = False
    queues = spark.createDataFrame([(r["__source"], i + 1) for i, r in enumerate(order)], "__s string, __large int")
    ends = ends.join(F.broadcast(queues), F.col("__source").eqNullSafe(F.col("__s")), "left").withColumn("__queue", F.coalesce("__large", F.lit(0)))
    ends = ends.withColumn("__line", F.when((F.col("__queue") == 1) & F.lit(shared), 0).otherwise(F.col("__queue")))
    # A queue of many small sources is summed by partition first, then by source within each.
    sums = ends.groupBy("__line", "__part").agg(F.sum("__sum").alias("__all"))
    earlier = W.partitionBy("__line").orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("__line", "__part", F.coalesce(F.sum("__all").over(earlier), F.lit(0)).alias("__first"))
    before = W.partitionBy("__line", "__part").orderBy("__source").rowsBetween(W.unboundedPreceding, -1)
    ends = ends.withColumn("__inner", F.coalesce(F.sum("__sum").over(before), F.lit(0))).join(sums, ["__line", "__part"])
    bases = ends.select(F.col("__part").alias("__p"), F.col("__source").alias("__s"), "__queue", (F.col("__first") + F.col("__inner")).alias("__base"))
    n_bases = bases.count()
    bases = F.broadcast(bases) if n_bases <= BROADCAST_BASES else bases
    placed = tokens.join(bases, (F.col("__part") == F.col("__p")) & F.col("__source").eqNullSafe(F.col("__s")))
    placed = placed.select("__id", "__queue", (F.col("__base") + F.col("__local")).alias("__start"), "__ids")

    kept_as = id_type(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, out = [], []
            for i, (q, start, data) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True)):
                ids = np.frombuffer(data.as_buffer(), kept_as).astype("<u4")
                view = memoryview(ids)
                for d, n, seq, off in cuts(start, len(ids), *bounds[q], total, window):
                    rows.append(i)
                    out.append((d, n, zlib.crc32(view[d : d + n]), len(ids), seq, off))
            cols = [pa.array(np.array(c, np.int64)) for c in (zip(*out, strict=True) if out else [[]] * 6)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), *cols], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return placed.mapInArrow(run, schema)
