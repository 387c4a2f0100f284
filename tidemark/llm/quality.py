"""Quality rules with a bitmask ledger (operator 4, DataFrame functions only)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import WHITE, text_of, words_of

WINDOW = 5



def _rules() -> dict[int, tuple[str, Column]]:
    n = F.col("n_words")
    return {
        0: ("few_words", n < 10),
        1: ("repeated_windows", F.col("n_repeat_words") * 100 > n * 20),
        2: ("symbols", F.col("n_symbols") * 10 > n),
        3: ("duplicate_lines", (F.col("n_dup_lines") * 2 > F.col("n_lines")) & (F.col("n_dup_lines") > 2)),
        4: ("short_words", (F.col("word_chars") < n * 2) & (n > 0)),
        5: ("long_words", F.col("word_chars") > n * 25),
        6: ("any_duplicate_line", F.col("n_dup_lines") > 0),
    }


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject a document under it."""

    version: str
    rules: tuple[int, ...]

    @property
    def mask(self) -> int:
        return reduce(lambda m, r: m | 1 << r, self.rules, 0)


BASE = Policy("base", (0, 1))
POLICIES = {p.version: p for p in (BASE, Policy("v1", (0, 1, 2, 3, 4, 5)), Policy("v2-strict", (0, 1, 2, 3, 4, 5, 6)))}


def _repeat_words(words: str) -> Column:
    """Words in windows of five that occur twice or more.

    Windows are compared by 64-bit hashes. Texts whose windows are all distinct stop there; for others the
    sorted (hash, place) pairs give the places of repeated windows, and overlapping windows count once.
    """
    at = lambda i: F.get(F.col(words), i)
    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - WINDOW), lambda i: F.xxhash64(*[at(i + k) for k in range(WINDOW)]))
    return F.when(F.size(words) >= WINDOW, hashes).otherwise(F.array().cast("array<bigint>"))


def _computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns by an explode of one row: what stands above, pushed-down filters too, cannot inline them.

    Lambda functions read them once per word; inlined there, a text would be split once per word.
    """
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _measured(docs: DataFrame, carry: Column, text_col: str) -> DataFrame:
    """The measurements and bits of every row, next to ``carry``."""
    rows = docs.select(carry.alias("__carry"), text_of(text_col).alias("__text"))
    rows = _computed(rows, __words=words_of(F.col("__text")), __lines=F.filter(F.split("__text", "\n"), lambda s: F.btrim(s, F.lit(WHITE)) != ""))
    rows = _computed(
        rows,
        n_words=F.size("__words").cast("long"),
        word_chars=F.length(F.array_join("__words", "")).cast("long"),
        n_symbols=F.length(F.regexp_replace("__text", "[^#*$%&|<>]+", "")).cast("long"),
        n_lines=F.size("__lines").cast("long"),
        n_dup_lines=(F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        __hashes=_repeat_words("__words"),
    )
    pairs = F.array_sort(F.transform("__hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = _computed(rows, __pairs=F.when(F.size(F.array_distinct("__hashes")) < F.size("__hashes"), pairs).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")))
    same = lambda i, j: F.get(F.col("__pairs"), j)["h"] == F.get(F.col("__pairs"), i)["h"]
    last = F.size("__pairs") - 1
    again = F.filter("__pairs", lambda p, i: ((i > 0) & same(i, F.greatest(i - 1, F.lit(0)))) | ((i < last) & same(i, i + 1)))
    rows = _computed(rows, __again=F.array_sort(F.transform(again, lambda p: p["i"])))
    # Each repeated window covers the words up to the next repeated one, five at most.
    span = F.transform("__again", lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__again"), i + 1) - p, F.lit(WINDOW))))
    rows = _computed(rows, n_repeat_words=F.aggregate(span, F.lit(0).cast("long"), lambda a, x: a + x))
    bits = reduce(lambda a, b: a.bitwiseOR(b), [F.when(test, F.lit(1 << k)).otherwise(F.lit(0)).cast("long") for k, (_, test) in _rules().items()])
    return rows.select(
        "__carry", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", bits.alias("failed")
    )


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its measurements and ``failed``, a bitmask with a bit for every rule that fails.

    Every rule is evaluated once, here; policies and ablations only look at the bits. Null and empty texts
    have no words and fail rule 0. Repeated rows are measured each; other columns are ignored.
    """
    return _measured(docs, F.col(id_col), text_col).withColumnRenamed("__carry", id_col)


def fails(policy: Policy, failed: str = "failed") -> Column:
    return F.col(failed).bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def ablations(led: DataFrame, policy: Policy) -> DataFrame:
    """What each rule of a policy does: documents it fails, fails alone, and that pass without it.

    One pass over the ledger: the bits are counted by mask first (at most 2 ** rules masks).
    """
    masks = led.select(F.col("failed").bitwiseAND(F.lit(policy.mask).cast("long")).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n"))
    names = _rules()
    rules = F.array(*[F.struct(F.lit(k).alias("rule"), F.lit(names[k][0]).alias("name"), F.lit(1 << k).cast("long").alias("bit")) for k in policy.rules])
    each = masks.select("m", "n", F.inline(rules))
    hit = F.col("m").bitwiseAND(F.col("bit")) != 0
    alone = F.col("m") == F.col("bit")
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).alias
    return each.groupBy("rule", "name").agg(
        F.sum("n").alias("documents"), count(hit)("failed"), count(alone)("failed_alone"), count((F.col("m") == 0) | alone)("kept_without")
    ).withColumn("policy", F.lit(policy.version))


def quality_rules(docs: DataFrame, policy: str = "v1", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ledger with the verdicts of the base rules and of a versioned policy."""
    led = ledger(docs, id_col, text_col)
    return led.withColumns({"base_failed": fails(BASE), "kept": ~fails(BASE) & ~fails(POLICIES[policy])})


def keep_good(docs: DataFrame, policy: str = "v1", text_col: str = "text") -> DataFrame:
    """The documents that pass the base rules and the policy, with all their columns; nothing is shuffled."""
    rows = _measured(docs, F.struct(*[docs[c] for c in docs.columns]), text_col)
    return rows.where(~fails(BASE) & ~fails(POLICIES[policy])).select("__carry.*")
