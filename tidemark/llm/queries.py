"""The queries of this subpackage, each over its whole table with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.divergence import source_divergence
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.fm_index import remove_repeated_words
from tidemark.llm.line_dedup import near_lines
from tidemark.llm.mixing import mix_sources
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality import quality_rules
from tidemark.llm.sharding import shard_documents
from tidemark.llm.simhash import simhash_groups
from tidemark.llm.suffix_dedup import remove_repeats
from tidemark.llm.toxicity import fit_toxicity, score_toxicity
from tidemark.llm.url_filter import url_filter
from tidemark.llm.yinyang import yinyang_clusters
from tidemark.session import load, ship_package

URL_RULES = "VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block') AS rules(host, path, verdict)"


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(load(spark, sf_dir, "pages"), spark.sql(f"SELECT * FROM {URL_RULES}"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    return score_toxicity(docs, fit_toxicity(docs, load(spark, sf_dir, "labels"))).drop("clauses")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(load(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_lines(load(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(load(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(load(spark, sf_dir, "documents"), digests=True)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(load(spark, sf_dir, "documents"), 40, 41)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(load(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeated_words(load(spark, sf_dir, "documents")).select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return yinyang_clusters(load(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k.startswith("op") and k[2].isdigit()}


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL = {
    "op1_url_filter": f"""
WITH rules(rhost, rpath, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
u AS (SELECT row_number() OVER () AS n, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), {_AZ}) AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
b AS (SELECT n, page_id, host, path, rhost || rpath AS rule, v FROM p LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(rhost) + length(rpath) DESC NULLS LAST, length(rhost) DESC) = 1)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM b""",
    "op4_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT n, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT n, i, array_to_string(words[i:i + 4], ' ') AS win FROM (SELECT n, words, unnest(range(1, len(words) - 3)) AS i FROM w)),
r AS (SELECT n, i FROM g QUALIFY count(*) OVER (PARTITION BY n, win) > 1),
c AS (SELECT n, count(DISTINCT k) AS reps FROM (SELECT n, unnest(range(i, i + 5)) AS k FROM r) GROUP BY n),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(lines) AS BIGINT) AS n_lines, coalesce(reps, 0) AS n_repeat_words FROM w LEFT JOIN c USING (n)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols * 10 > n_words OR (n_dup_lines * 2 > n_lines AND n_dup_lines > 2) OR (word_chars < n_words * 2 AND n_words > 0) OR word_chars > n_words * 25) AS kept FROM b""",
    "op9_exact_dedup": f"""
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), {_AZ})) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, text_sha256 FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op11_source_divergence": rf"""
WITH d AS (SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
o AS MATERIALIZED (SELECT n, lang, source, unnest(w) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM o GROUP BY ALL HAVING count(DISTINCT n) >= 10),
v AS (SELECT lang, count(*) AS v, sum(total) AS n FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS cnt FROM o JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(cnt), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(cnt, 0) AS cnt, 1 + (1000000000 * CAST(coalesce(cnt, 0) + 2 AS HUGEINT)) // (g.n + 2 * v.v) AS p, 1 + (1000000000 * CAST(k.total + 2 AS HUGEINT)) // (v.n + 2 * v.v) AS q
  FROM g JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
a AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS f FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(f, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE cnt > 0 AND p > q),
t AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS INTEGER) AS rank FROM r)
SELECT * FROM t WHERE part = 'pair' OR rank <= 10""",
    "op12_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
g AS (SELECT n, doc_id, i, array_to_string(words[i:i + 19], ' ') AS win FROM (SELECT n, doc_id, words, unnest(range(1, len(words) - 18)) AS i FROM d)),
f AS (SELECT n, i FROM g QUALIFY {'d': doc_id, 'i': i} > min({'d': doc_id, 'i': i}) OVER (PARTITION BY win)),
p AS (SELECT n, unnest(range(1, len(words) + 1)) AS i, unnest(words) AS word FROM d),
r AS (SELECT p.n, p.i, word, coalesce(max(f.i) OVER (PARTITION BY p.n ORDER BY p.i ROWS UNBOUNDED PRECEDING) >= p.i - 19, false) AS removed FROM p LEFT JOIN f ON p.n = f.n AND p.i = f.i),
k AS (SELECT n, count(*) FILTER (removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT removed) AS kept FROM r GROUP BY n)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (n)""",
}


def _rounds_sql() -> str:
    """Operator 13 round by round: v has a row per vector and component, c0 to c5 one per centroid and component."""
    nearest = lambda c: f"SELECT n, c AS cluster, d FROM (SELECT n, c, sum((v.x - {c}.x) * (v.x - {c}.x)) AS d FROM v JOIN {c} USING (i) GROUP BY n, c) QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, c) = 1"
    steps = [
        "k AS MATERIALIZED (SELECT row_number() OVER () AS n, vec_id, embedding AS e FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "v AS MATERIALIZED (SELECT n, unnest(range(1, 65)) AS i, CAST(floor(256 * CAST(unnest(e) AS DOUBLE)) AS BIGINT) AS x FROM k)",
        "s AS (SELECT n, row_number() OVER (ORDER BY sha256('2:' || vec_id), n) - 1 AS c FROM k QUALIFY c < 40)",
        "c0 AS MATERIALIZED (SELECT c, i, x FROM s JOIN v USING (n))",
    ]
    for r in range(5):
        steps.append(f"a{r} AS MATERIALIZED ({nearest(f'c{r}')})")
        steps.append(f"m{r} AS (SELECT cluster AS c, i, sum(x) AS s, count(*) AS m FROM a{r} JOIN v USING (n) GROUP BY ALL)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c, i, CASE WHEN s IS NULL THEN x ELSE (s - ((s % m) + m) % m) // m END AS x FROM c{r} LEFT JOIN m{r} USING (c, i))")
    steps.append(f"a5 AS MATERIALIZED ({nearest('c5')})")
    steps.append("h AS (SELECT c AS cluster, sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY i)) AS centroid_sha256 FROM c5 GROUP BY c)")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM a5 JOIN k USING (n) JOIN h USING (cluster)"


SQL["op13_centroid_clustering"] = _rounds_sql()


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
