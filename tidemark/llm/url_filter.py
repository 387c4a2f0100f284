"""URL rules by host suffix and path prefix (operator 1, DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import LOWER, UPPER, expand_copies

#: Rule tables up to this many rows are broadcast; larger ones are joined by a shuffle.
BROADCAST_RULES = 100_000


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path as columns; both empty without ``://``."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"\A[^/?#]*", 0)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)\A(.*/)?", 0)


def _cut(name: str, mark: str, count: Column) -> Column:
    return F.call_function("substring_index", F.col(name), F.lit(mark), count)


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", prefix: int = 8) -> DataFrame:
    """The longest rule that fits each URL, and its verdict.

    ``rules`` has string columns host, path, verdict. A rule fits its host and all subdomains when the
    URL's path starts with the rule's path. Each URL is expanded into (host suffix, leading directories)
    expressions, no deeper than the deepest rule; they meet the rules by an equi-join on the first
    ``prefix`` hex digits of a SHA-256, then the full digest and the rest of the rule's path confirm.
    The longest rule (host and path together) wins, then the longer host, then block before allow.

    Null URLs and URLs without ``://`` have an empty host and path and get ``default``, like every URL
    that no rule fits. Repeated rows come out as often as they come in; other columns are ignored.
    Returns id, host, path, rule (null if none), verdict.
    """
    rules = rules.select(
        F.translate("host", UPPER, LOWER).alias("__rhost"), F.coalesce("path", F.lit("")).alias("__rpath"), F.col("verdict").alias("__verdict")
    ).withColumn("__dir", _directory(F.col("__rpath")))
    depth = rules.agg(
        F.count(F.lit(1)), F.max(F.size(F.split("__rhost", "\\."))), F.max(F.length("__dir") - F.length(F.replace("__dir", F.lit("/"), F.lit(""))))
    ).head()
    n_rules, labels, slashes = depth[0], depth[1] or 0, depth[2] or 0
    digest = F.sha2(F.concat_ws("\n", "__rhost", "__dir"), 256)
    rules = rules.withColumn("__digest", digest).withColumn("__short", F.substring("__digest", 1, prefix))
    rules = F.broadcast(rules) if n_rules <= BROADCAST_RULES else rules

    # Equal rows count once and are repeated at the end.
    rows = pages.select(F.col(id_col).alias("__id"), F.col(url_col).cast("string").alias("__url")).groupBy("__id", "__url").agg(F.count(F.lit(1)).alias("__n"))
    host, path = url_parts(F.col("__url"))
    rows = rows.withColumns({"__host": host, "__path": path})
    parts = F.split("__host", "\\.")
    suffix = F.transform(F.sequence(F.lit(1), F.least(F.lit(max(labels, 1)), F.size(parts))), lambda k: _cut("__host", ".", -k))
    level = F.length("__path") - F.length(F.replace("__path", F.lit("/"), F.lit("")))
    heads = F.transform(
        F.sequence(F.lit(0), F.least(F.lit(slashes), level)),
        lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(_cut("__path", "/", k), F.lit("/"))),
    )
    expr = rows.withColumn("__suffix", F.explode(suffix)).withColumn("__head", F.explode(heads))
    expr = expr.withColumn("__full", F.sha2(F.concat_ws("\n", "__suffix", "__head"), 256))
    fits = (F.substring("__full", 1, prefix) == F.col("__short")) & (F.col("__full") == F.col("__digest")) & F.startswith("__path", "__rpath") & (F.col("__host") != "")
    hits = expr.join(rules, fits, "left")
    rank = F.when(
        F.col("__digest").isNotNull(),
        F.struct(
            (F.length("__rhost") + F.length("__rpath")).alias("length"),
            F.length("__rhost").alias("host_length"),
            (F.col("__verdict") == "block").cast("int").alias("block"),
            F.concat("__rhost", "__rpath").alias("rule"),
            F.col("__verdict").alias("verdict"),
        ),
    )
    best = hits.groupBy("__id", "__url", "__host", "__path", "__n").agg(F.max(rank).alias("__best"))
    out = expand_copies(best, "__n", "__copy")
    return out.select(
        F.col("__id").alias(id_col),
        F.col("__host").alias("host"),
        F.col("__path").alias("path"),
        F.col("__best.rule").alias("rule"),
        F.coalesce("__best.verdict", F.lit(default)).alias("verdict"),
    )
