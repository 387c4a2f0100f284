"""Mixing sources to target weights by a min-cost flow over membership patterns (operator 8)."""

from __future__ import annotations

import json
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import expand_copies, join_groups, running_start, text_of, words_of
from tidemark.session import cut_lineage

#: The plan is broadcast up to this many membership patterns; beyond, it meets the rows in a shuffle.
BROADCAST_PATTERNS = 100_000


def water_fill(sizes: dict, weights: dict, total: Fraction, stop: Fraction) -> dict:
    """Shares of ``total`` by weight; none above ``stop`` times its size, the excess reshared by weight."""
    out, open_ = {}, {s for s in sizes if sizes[s] > 0}
    out.update({s: Fraction(0) for s in sizes if s not in open_})
    left = min(Fraction(total), sum((Fraction(sizes[s]) * stop for s in open_), Fraction(0)))
    while open_:
        unit = left / sum(Fraction(weights[s]) for s in open_)
        full = {s for s in open_ if unit * weights[s] > sizes[s] * stop}
        if not full:
            return out | {s: unit * weights[s] for s in open_}
        for s in full:
            out[s] = sizes[s] * stop
            left -= out[s]
        open_ -= full
    return out


def route(patterns: dict[tuple, int], targets: dict, epochs: int) -> dict[tuple, dict]:
    """Words each pattern gives each of its sources: a min-cost flow, successive shortest paths.

    Nodes are patterns (sets of sources, with their words) and sources (with their targets). A pattern's
    words can be used ``epochs`` times; the k-th use of a word costs k, so repetition starts only when
    no unrepeated words can reach a source. Sizes are aggregates, so the graph has one node per pattern.
    """
    flow = {p: dict.fromkeys(p, Fraction(0)) for p in patterns}
    need = {s: Fraction(t) for s, t in targets.items()}
    # A source that shares no pattern takes what it needs from its own words; only the others need a network.
    shared = {s for p in patterns if len(p) > 1 for s in p}
    for p in [p for p in patterns if len(p) == 1 and p[0] not in shared]:
        flow[p][p[0]] = min(need.get(p[0], Fraction(0)), Fraction(patterns[p]) * epochs)
        need.pop(p[0], None)
    patterns = {p: n for p, n in patterns.items() if p[0] in shared}
    need = {s: t for s, t in need.items() if s in shared}
    for k in range(1, epochs + 1):
        room = {p: Fraction(n) * k - sum(flow[p].values(), Fraction(0)) for p, n in patterns.items()}
        while True:
            # Breadth first from sources in need, through patterns that could hand over flow, to one with room.
            came: dict = {("s", s): None for s in sorted(need, key=repr) if need[s] > 0}
            queue, end = list(came), None
            while queue and end is None:
                kind, x = queue.pop(0)
                if kind == "s":
                    steps = [("p", p) for p in patterns if x in flow[p]]
                else:
                    if room[x] > 0:
                        end = (kind, x)
                        break
                    steps = [("s", s) for s in x if flow[x][s] > 0]
                for y in steps:
                    if y not in came:
                        came[y] = (kind, x)
                        queue.append(y)
            if end is None:
                break
            path = [end]
            while came[path[-1]] is not None:
                path.append(came[path[-1]])
            amount = min([room[end[1]], need[path[-1][1]], *[flow[path[i + 1][1]][path[i][1]] for i in range(1, len(path) - 1, 2)]])
            room[end[1]] -= amount
            need[path[-1][1]] -= amount
            for i in range(0, len(path) - 1):
                a, b = path[i], path[i + 1]
                if a[0] == "p":
                    flow[a[1]][b[1]] += amount
                else:
                    flow[b[1]][a[1]] -= amount
    return flow


def _source_order(s: str | None) -> tuple:
    return (s is None, s or "")


def cycle_weights(sources: list, cycle: tuple = (3, 1, 2)) -> dict:
    """Weights repeating ``cycle`` over the sources by code point, null last."""
    return {s: cycle[i % len(cycle)] for i, s in enumerate(sorted(sources, key=_source_order))}


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    size: Column | None = None,
    source_col: str = "source",
    text_col: str = "text",
    membership: Column | None = None,
    share: Fraction = Fraction(3, 2),
    stop: int = 2,
    cycle: tuple = (3, 1, 2),
    seed: int = 0,
) -> DataFrame:
    """How many words of each document a mix takes that meets every source's target.

    ``membership`` is an array of the sources a document belongs to (its own source by default).
    Documents are aggregated by membership pattern; the totals, one row per pattern, are routed to the
    sources' targets by ``route``. A pattern that gives f words takes each of its documents
    floor(f / words) times and the rest from the documents that come first in a seeded order; the last of
    these is cut to the word.

    The driver holds one number per pattern. Null texts have size 0, a null source is a source of its
    own, null or empty memberships are the pattern of the null source. Equal rows (id, pattern, size)
    each get their part. Empty tables give no rows. Returns id, size, source_size, target (of the row's
    first source), taken.
    """
    rows, _ = _planned(docs, id_col, size, source_col, text_col, membership, share, stop, cycle, seed)
    rows = expand_copies(rows, "__times", "__copy")
    left = F.col("__rest") - F.col("__start") - F.col("__copy") * F.col("__size")
    extra = F.greatest(F.lit(0), F.least(left, F.col("__size")))
    return rows.select(
        F.col("__id").alias(id_col), F.col("__size").alias("size"), "source_size", "target", (F.col("__size") * F.col("__full") + extra).cast("long").alias("taken")
    )


def _keys(id_col: str, size: Column | None, source_col: str, text_col: str, membership: Column | None, seed: int) -> dict[str, Column]:
    """Id, pattern (as JSON text), size and place in the seeded order of a document."""
    size = F.size(words_of(text_of(text_col))).cast("long") if size is None else size
    member = F.array(F.col(source_col).cast("string")) if membership is None else membership
    member = F.when(F.size(member) > 0, member).otherwise(F.array(F.lit(None).cast("string")))
    size = F.coalesce(size, F.lit(0)).cast("long")
    # The place in the order needs no count of words, so that documents are marked without one.
    return {
        "__id": F.col(id_col),
        "__m": F.to_json(F.array_sort(F.array_distinct(member))),
        "__size": size,
        "__h": F.xxhash64(F.lit(seed), F.col(id_col), F.octet_length(text_of(text_col))),
    }


def _with_plan(rows: DataFrame, plan: DataFrame, patterns: int) -> DataFrame:
    """Rows next to their pattern's plan (__m, __words and other columns)."""
    if patterns <= BROADCAST_PATTERNS:
        return rows.join(F.broadcast(plan), "__m")
    total = plan.agg(F.sum("__words")).head()[0] or 0
    return join_groups(rows, plan, ["__m"], "__words", total, F.col("__h")).where("__words is not null")


def _planned(docs, id_col, size, source_col, text_col, membership, share, stop, cycle, seed) -> tuple[DataFrame, int]:
    """Distinct narrow rows with their place in their pattern's seeded order and their pattern's plan; the number of patterns."""
    keys = _keys(id_col, size, source_col, text_col, membership, seed)
    rows = docs.select(*[c.alias(k) for k, c in keys.items()]).groupBy(*keys).agg(F.count(F.lit(1)).alias("__times"))
    rows = cut_lineage(rows.withColumn("__all", F.col("__size") * F.col("__times")))
    totals = {r["__m"]: r["w"] for r in rows.groupBy("__m").agg(F.sum("__all").alias("w")).collect()}
    members = {p: tuple(json.loads(p)) for p in totals}
    sizes: dict = {}
    for p, n in totals.items():
        for s in members[p]:
            sizes[s] = sizes.get(s, 0) + n
    targets = water_fill(sizes, cycle_weights(list(sizes), cycle), share * sum(totals.values()), Fraction(stop))
    flow = route({members[p]: n for p, n in totals.items()}, targets, stop)
    plan = []
    for p, n in totals.items():
        f = sum(flow[members[p]].values(), Fraction(0))
        times = int(f // n) if n else 0
        first = members[p][0]
        plan.append((p, n, times, round(f - times * n), sizes[first], float(targets[first])))
    frame = docs.sparkSession.createDataFrame(plan, "__m string, __words long, __full long, __rest long, source_size long, target double")
    return _with_plan(running_start(rows, "__m", "__h", ["__id", "__size"], "__all", docs.count(), "__start"), frame, len(plan)), len(plan)


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    size: Column | None = None,
    source_col: str = "source",
    text_col: str = "text",
    membership: Column | None = None,
    share: Fraction = Fraction(3, 2),
    stop: int = 2,
    cycle: tuple = (3, 1, 2),
    seed: int = 0,
) -> DataFrame:
    """The documents of the mix, whole, with all their columns; one taken twice comes out twice.

    The documents taken once more are a prefix of their pattern's seeded order, so one hash per pattern
    marks them, and texts are never shuffled. The last document of the prefix is taken if at least half
    of it fits. Rows equal in id, pattern and size are treated alike. Nulls as in ``mix_sources``.
    """
    rows, patterns = _planned(docs, id_col, size, source_col, text_col, membership, share, stop, cycle, seed)
    more = (F.col("__rest") - F.col("__start")) * 2 >= F.col("__size")
    taken = F.when(more & (F.col("__rest") > 0), F.col("__h").bitwiseXOR(F.lit(-(2**63))))
    marks = cut_lineage(rows.groupBy("__m", "__full").agg(F.max(taken).alias("__last"), F.max("__words").alias("__words")))
    keys = _keys(id_col, size, source_col, text_col, membership, seed)
    # Blocks order hashes as unsigned numbers; a flipped sign bit gives the same order among signed ones.
    unsigned = F.col("__h").bitwiseXOR(F.lit(-(2**63)))
    out = _with_plan(docs.withColumns({"__m": keys["__m"], "__h": keys["__h"]}), marks, patterns)
    times = F.col("__full") + F.coalesce((unsigned <= F.col("__last")).cast("long"), F.lit(0))
    out = out.withColumn("__times", times).where("__times > 0")
    return expand_copies(out, "__times", "__copy").select(*[docs[c] for c in docs.columns])
