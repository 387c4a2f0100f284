"""Queries of the catalogue that are jobs of several runs over stores and versions, and of rules over several sources."""

from __future__ import annotations

from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.operators import anchored, board, compare, payloads, proxy, snapshots, windows
from tidemark.operators import quarters as qt
from tidemark.plans import build, stores
from tidemark.plans.catalog import FRAME, QUERIES, RANK, REGIME, SQL, A, P, Q, S, anchored as month_ends, daily, points, quarters, query, r6, rnd
from tidemark.session import checkpoint_path, load, ship_package
from tidemark.sources import facts, providers, scripts, tiers, versions

__all__ = ["QUERIES", "SQL"]

# Stores over several runs

#: Series of one market segment in one nation, with the share of values up to each.
FINE = """b AS (SELECT c_mktsegment || '-' || c_nationkey AS entity, CAST(o_orderdate AS DATE) AS d, floor(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) + 0.5) / 100 AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
USERS = [("u0", 55.0, 45.0, 3), ("u1", 70.0, 30.0, 0), ("u2", 90.0, 10.0, 40)]
_USERS_SQL = "rules(user_id, upper, lower, cooldown) AS (VALUES " + ", ".join(f"('{u}', {a}::DOUBLE, {b}::DOUBLE, {c})" for u, a, b, c in USERS) + ")"
#: Rows that a series has lost at its end in each run, and entities whose state points to a date it has not.
RUNS = [6, 2, 0]


def fine(spark, sf) -> DataFrame:
    orders = load(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.concat_ws("-", "c_mktsegment", F.col("c_nationkey").cast("string")).alias("entity"))
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = orders.join(customers, "o_custkey").groupBy("entity", F.to_date("o_orderdate").alias("d"))
    return rows.agg((F.floor(F.sum(cents).cast("double") / F.count(F.lit(1)) + 0.5) / 100).alias("v"))


def _run_sql(k: int, cut: int, before: str | None) -> str:
    """One run: p has the ranks of the series without its last ``cut`` rows, w what each user's rule sees, f what fires, t the state after."""
    last = f"LEFT JOIN {before} o ON o.user_id = r.user_id AND o.entity = l.entity LEFT JOIN p{k} h ON h.entity = l.entity AND h.d = o.last_triggered" if before else ""
    # Before the second run, the state of entities in nation 7 is moved to a date that no series has.
    held = "o.last_triggered IS NOT NULL AND h.n IS NOT NULL AND l.n - h.n BETWEEN 0 AND r.cooldown - 1" if before else "false"
    side = lambda x: f"CASE WHEN {x} >= upper / 100 THEN 'high' WHEN {x} <= lower / 100 THEN 'low' ELSE 'neutral' END"
    return f"""p{k} AS MATERIALIZED (SELECT entity, d, {RANK.format('v', FRAME.format('UNBOUNDED'))} AS p, row_number() OVER (PARTITION BY entity ORDER BY d) AS n FROM q WHERE back > {cut}),
l{k} AS (SELECT a.entity, a.d, a.p, a.n, b.p AS was FROM p{k} a JOIN p{k} b ON a.entity = b.entity AND b.n = a.n - 1 QUALIFY row_number() OVER (PARTITION BY a.entity ORDER BY a.n DESC) = 1),
w{k} AS (SELECT r.user_id, l.*, {side('l.p')} AS now, {side('l.was')} AS then_, {held} AS held, {'o.last_triggered' if before else 'NULL::DATE'} AS old FROM rules r CROSS JOIN l{k} l {last}),
f{k} AS (SELECT *, now <> 'neutral' AND now <> then_ AND NOT held AS fires FROM w{k}),
t{k} AS (SELECT user_id, entity, CASE WHEN fires THEN d ELSE old END AS last_triggered, now AS last_direction FROM f{k}{f" UNION ALL SELECT * FROM {before} o WHERE NOT EXISTS (SELECT 1 FROM l{k} WHERE l{k}.entity = o.entity)" if before else ""}),
n{k} AS (SELECT user_id, entity, d, now AS direction, CASE WHEN p >= 0.95 OR p <= 0.05 THEN 'P1' ELSE 'P2' END AS severity, round(p, 4) AS percentile, {k} AS run FROM f{k} WHERE fires)"""


RUNS_SQL = f"""WITH {FINE}, {_USERS_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d DESC) AS back FROM b),
{_run_sql(1, RUNS[0], None)},
s1 AS (SELECT user_id, entity, CASE WHEN entity LIKE '%-7' THEN DATE '1901-01-01' ELSE last_triggered END AS last_triggered, last_direction FROM t1),
{_run_sql(2, RUNS[1], 's1')},
{_run_sql(3, RUNS[2], 't2')},
a AS (SELECT *, user_id = 'u1' AS read FROM (SELECT * FROM n1 UNION ALL SELECT * FROM n2) UNION ALL SELECT *, false FROM n3)"""


def three_runs(spark, sf) -> str:
    """Two daily runs, all alerts of one user acknowledged, a third run; every step is asked for twice. Returns the stores' folder."""
    root = f"{checkpoint_path(spark)}/stores-{uuid4().hex}"
    series = fine(spark, sf)
    users = F.array(*[F.struct(F.lit(u).alias("user_id"), F.lit(a).alias("upper"), F.lit(b).alias("lower"), F.lit(c).alias("cooldown")) for u, a, b, c in USERS])
    lists = series.select("entity").distinct().select("entity", F.inline(users))
    stores.put_watchlists(spark, root, lists.groupBy("user_id", "upper", "lower", "cooldown").agg(F.array_sort(F.collect_list("entity")).alias("watch_ids")), "lists")
    back = F.row_number().over(W.partitionBy("entity").orderBy(F.desc("d")))
    series = series.withColumn("back", back)
    for k, cut in enumerate(RUNS, 1):
        ranked = windows.framed_ranks(series.where(F.col("back") > cut).drop("back"), "entity", "d", "v", {"percentile": None})
        for _ in range(2):
            stores.run_update(spark, root, ranked, f"day {k}")
        if k == 1:
            stores.put_state(spark, root, stores.load(spark, root)["alert_state"].withColumn("last_triggered", F.when(F.col("entity").like("%-7"), F.to_date(F.lit("1901-01-01"))).otherwise(F.col("last_triggered"))), "moved")
        if k == 2:
            for _ in range(2):
                stores.acknowledge(spark, root, "u1", "read")
    return root


@query(RUNS_SQL + " SELECT user_id, entity, d, direction, severity, percentile, read FROM a QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY d DESC, entity) <= 500")
def alert_store_runs(spark, sf):
    return stores.load(spark, three_runs(spark, sf))["alerts"].drop("alert_id")


@query(RUNS_SQL + " SELECT * FROM t3")
def alert_state_runs(spark, sf):
    return stores.load(spark, three_runs(spark, sf))["alert_state"]


# The dataset build over several versions

END = "2001-06-30"
#: What each build gets of the live series: entities whose series is cut to a few points, has a gap in a metric, has dates
#: out of order, or lacks the forward ratio; by the segment's first letter (A, B, F, H, M).
BUILDS = {1: {}, 2: {"H": "low"}, 3: {"A": "short", "B": "holes", "H": "backwards"}, 4: {"A": "short", "M": "no forward", "F": "short"}}


def broken(df: DataFrame, build_no: int) -> DataFrame:
    """The live points of a build (entity, d, seq, pe_ttm, pe_forward, pb), broken as listed; every build ends 100 days later."""
    end = F.date_sub(F.to_date(F.lit(END)), 100 * (4 - build_no))
    df = df.where(F.col("d") <= end).withColumn("seq", F.row_number().over(W.partitionBy("entity").orderBy("d")))
    for letter, how in BUILDS[build_no].items():
        mine = F.col("entity").startswith(letter)
        if how == "short":
            df = df.where(~mine | (F.col("seq") <= 5))
        elif how == "holes":
            df = df.withColumn("pb", F.when(mine & (F.col("seq") % 50 == 0), None).otherwise(F.col("pb")))
        elif how == "backwards":
            df = df.withColumn("seq", F.when(mine, -F.col("seq")).otherwise(F.col("seq")))
        elif how == "no forward":
            df = df.withColumn("pe_forward", F.when(mine, None).otherwise(F.col("pe_forward")))
        else:
            df = df.withColumn("pe_ttm", F.when(mine, F.least("pe_ttm", F.lit(-1.0))).otherwise(F.col("pe_ttm")))
    return df


def build_rules(spark, least: int = 20) -> build.Rules:
    peaks = spark.createDataFrame([("HOUSEHOLD", "1992-01-01", "2001-12-31", 0.0)], "entity string, first string, last string, floor double")
    peaks = peaks.select("entity", F.to_date("first").alias("first"), F.to_date("last").alias("last"), "floor")
    return build.Rules(("pe_ttm", "pe_forward", "pb"), "pe_forward", "pe_ttm", peaks, least)


def four_builds(spark, sf) -> tuple[str, list[tuple[str, str]]]:
    """Three builds that publish and one that does not; the folder, and the reasons of the last."""
    root, reasons = f"{checkpoint_path(spark)}/dataset-{uuid4().hex}", []
    df = points(spark, sf).select("entity", "d", "pe_ttm", "pe_forward", "pb")
    catalogue = df.select("entity").distinct()
    for k in BUILDS:
        try:
            build.build_dataset(spark, root, broken(df, k), catalogue, END, build_rules(spark), ("check",))
        except build.BuildFailed as e:
            reasons = e.reasons
    return root, reasons


@query(f"""WITH {P}, a AS (SELECT entity, d, pe_ttm, pb, row_number() OVER (PARTITION BY entity ORDER BY d) AS seq FROM p WHERE d <= DATE '{END}' - 100),
  b AS (SELECT entity, 3 AS from_version, d, pe_ttm FROM a WHERE left(entity, 1) NOT IN ('A', 'H', 'B') OR (left(entity, 1) = 'B' AND (SELECT count(*) FROM a x WHERE x.entity = a.entity) < 50)
    UNION ALL SELECT entity, CASE WHEN left(entity, 1) = 'H' THEN 1 ELSE 2 END, d, pe_ttm FROM p WHERE (left(entity, 1) IN ('A', 'B') AND (left(entity, 1) = 'A' OR (SELECT count(*) FROM a x WHERE x.entity = p.entity) >= 50) AND d <= DATE '{END}' - 200) OR (left(entity, 1) = 'H' AND d <= DATE '{END}' - 300))
  SELECT entity, any_value(from_version) AS from_version, CASE WHEN any_value(from_version) = 3 THEN 'live' ELSE 'history' END AS origin, count(*) AS n_points, max(d) AS last_date, {rnd('sum(pe_ttm)', 4)} AS total FROM b GROUP BY 1""")
def staged_build(spark, sf):
    """The third build: one series is cut, one has holes, one goes backwards. The last falls back past the second
    version, where its history has no peak; the others to the second."""
    root, _ = four_builds(spark, sf)
    total = build.read_version(spark, root).groupBy("entity").agg(r6(F.sum("pe_ttm"), 4).alias("total"))
    return build.read_entities(spark, root).select("entity", "from_version", "origin", "n_points", "last_date").join(total, "entity")


@query(f"""WITH {P} SELECT DISTINCT entity, 'missing pe_forward' AS reason, 3 AS published, '3 versions, last free-live-proxy-v6+history-fallback-' || (SELECT CASE WHEN count(*) >= 50 THEN 3 ELSE 2 END FROM p WHERE left(entity, 1) = 'B' AND d <= DATE '{END}' - 100) || '+check' AS about FROM p WHERE left(entity, 1) = 'M'""")
def refused_build(spark, sf):
    """The fourth build: one series has no forward ratio at all, so nothing is published, though two others could fall back."""
    root, reasons = four_builds(spark, sf)
    manifest = versions.read_manifest(spark, root)
    about = f"{len(manifest['versions'])} versions, last {build.versions_of(manifest)[0]['source']}"
    rows = spark.createDataFrame(reasons, "entity string, reason string")
    return rows.withColumns({"published": F.lit(manifest["version"]), "about": F.lit(about)})


# Snapshots that say something new

#: Each day's ratios as a provider might give them: the trailing ratio in coarse steps, the forward one moved with the price
#: from the month's first day and now and then of the other sign, the book ratio the same for a week, a growth ratio with gaps.
SHOTS = f"""m AS (SELECT *, first_value(v) OVER (PARTITION BY entity, date_trunc('month', d) ORDER BY d) AS v0 FROM p),
  h AS (SELECT entity, d, v AS close, {rnd('pe_ttm', 0)} AS pe_ttm, v / v0 * (1 + month(d)) * CASE WHEN day(d) = 20 THEN -1 ELSE 1 END AS pe_forward, 0.5 + floor(day(d) / 7) AS pb, CASE WHEN day(d) % 3 = 0 THEN 1.0::DOUBLE + dayofyear(d) % 11 END AS peg,
  CASE WHEN length(entity) % 2 = 0 THEN 'Yahoo-Quote-API-latest+sec' ELSE 'yahoo-trailing-pe-timeseries+yahoo-forward-pe-timeseries+yahoo-trailing-peg-timeseries' END AS source FROM m)"""
TAKEN = f"""WITH RECURSIVE {P}, {SHOTS}, u AS (UNPIVOT (SELECT entity, d, close, source LIKE 'Yahoo%' AS explicit, pe_ttm, pe_forward, CASE WHEN source LIKE 'Yahoo%' THEN pb END AS pb, peg FROM h) ON pe_ttm, pe_forward, pb, peg INTO NAME metric VALUE value),
  n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY entity, metric ORDER BY d) AS no FROM u WHERE abs(value) >= 1e-8),
  f AS (SELECT entity, metric, no, d, value AS last, close AS base, true AS taken FROM n WHERE no = 1 UNION ALL
    SELECT entity, metric, no, d, CASE WHEN ok THEN value ELSE last END, CASE WHEN ok THEN close ELSE base END, ok FROM (
      SELECT n.*, f.last, f.base, CASE WHEN explicit THEN NOT (CASE WHEN f.last * value <= 0 THEN 1e300 ELSE greatest(abs(value / f.last), abs(f.last / value)) END <= 1.01 AND greatest(close / f.base, f.base / close) > 1.01)
        ELSE CASE WHEN f.last * value <= 0 THEN 1e300 ELSE greatest(abs(value / (f.last * (close / f.base))), abs(f.last * (close / f.base) / value)) END > 1.01 END AS ok
      FROM f JOIN n ON n.entity = f.entity AND n.metric = f.metric AND n.no = f.no + 1)),
  k AS (SELECT f.entity, f.d, f.metric, last AS value FROM f WHERE taken)"""


def shots(spark, sf) -> DataFrame:
    df = points(spark, sf)
    v0 = F.first("v").over(W.partitionBy("entity", F.trunc("d", "month")).orderBy("d"))
    sign = F.when(F.dayofmonth("d") == 20, -1).otherwise(1)
    return df.select(
        "entity", "d", F.col("v").alias("close"), r6("pe_ttm", 0).alias("pe_ttm"), (F.col("v") / v0 * (1 + F.month("d")) * sign).alias("pe_forward"), (0.5 + F.floor(F.dayofmonth("d") / 7)).alias("pb"),
        F.when(F.dayofmonth("d") % 3 == 0, 1.0 + F.dayofyear("d") % 11).alias("peg"), F.when(F.length("entity") % 2 == 0, "Yahoo-Quote-API-latest+sec").otherwise("yahoo-trailing-pe-timeseries+yahoo-forward-pe-timeseries+yahoo-trailing-peg-timeseries").alias("source"),
    )


@query(TAKEN + f" SELECT entity, d, {', '.join(rnd(f'max(value) FILTER (metric = {m!r})') + f' AS {m}' for m in snapshots.METRICS)} FROM k GROUP BY 1, 2")
def effective_snapshots(spark, sf):
    df = shots(spark, sf)
    out = snapshots.effective_snapshots(df.drop("close"), df.select("entity", "d", "close"))
    return out.select("entity", "d", *[r6(m).alias(m) for m in snapshots.METRICS])


@query(TAKEN + f" SELECT entity, d, metric, {rnd('value')} AS value FROM k")
def effective_snapshots_stream(spark, sf):
    """The same as a stream of three files in the order of their dates, a batch each, with state between them."""
    folder = f"{checkpoint_path(spark)}/stream-snapshots-{uuid4().hex}"
    df = shots(spark, sf)
    rows = snapshots.with_close(snapshots.long_snapshots(df, "entity", "d", "source"), df.select("entity", "d", "close"), "entity", "d", "close")
    for years in ("< 1995", "BETWEEN 1995 AND 1997", "> 1997"):
        rows.where(f"year(d) {years}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    source = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    taken = snapshots.stream_snapshots(source)
    with rocksdb(spark):
        q = taken.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.schema(taken.schema).parquet(f"{folder}/out").withColumn("value", r6("value"))


@contextmanager
def rocksdb(spark):
    """The state store that ``transformWithState`` needs, for the queries started inside; the session's own comes back after."""
    ship_package(spark)
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, old)


# Ratios made up from prices and a rate

_C = lambda x, low, high: f"least(greatest({x}, {low}), {high})"


@query(f"""WITH RECURSIVE {P}, y AS (SELECT DISTINCT d, CAST(us10y_yield AS DOUBLE) AS rate FROM p WHERE day(d) IN (10, 25) AND d >= DATE '1992-03-01'), y0 AS (SELECT coalesce(arg_min(rate, d), 0.035::DOUBLE) AS rate_0 FROM y),
  n AS MATERIALIZED (SELECT p.entity, p.d, v AS close, coalesce(rate, rate_0) AS rate, rate_0, row_number() OVER (PARTITION BY p.entity ORDER BY p.d) AS no, 15.0::DOUBLE + length(entity) AS ap, 14.0::DOUBLE + length(entity) AS af, 2.0::DOUBLE + length(entity) / 10 AS ab,
    CASE WHEN length(entity) % 2 = 0 THEN 0.115 ELSE 0.11 END::DOUBLE AS a1 FROM p ASOF LEFT JOIN y ON p.d >= y.d, y0),
  f AS (SELECT entity, CAST(0 AS BIGINT) AS no, CAST(NULL AS DATE) AS d, greatest(close, 0.01) AS c, close AS e1, close AS e2, close AS e3, rate_0 AS yf, rate_0 AS ys, 0.0::DOUBLE AS mf, 0.0::DOUBLE AS ms, ap AS pe, af AS fw, ab AS pb, rate_0 AS rate FROM n WHERE no = 1 UNION ALL
    SELECT entity, no, d, c, e1, e2, e3, yf, ys, mf, ms, pe + a1 * (tp - pe), fw + 0.13 * (tp * (1 - spread) - fw), pb + 0.08 * (ab * exp(book) - pb), rate FROM (
    SELECT *, ap * exp(signal) AS tp, {_C("signal * 0.62 + far * 0.28 - gap * 1.8 - unrest * 2.2", -0.9, 0.9)} AS book, {_C("0.085 + far * 0.22 + mid * 0.12 - gap * 0.42 - momentum * 0.2", -0.08, 0.24)} AS spread,
      {_C(f"pe0 * (1 + {_C('change * 1.2', -0.1, 0.1)})", 0.1, 500)} AS pe, {_C(f"fw0 * (1 + {_C('change * 1.05', -0.09, 0.09)})", 0.1, 500)} AS fw, {_C(f"pb0 * (1 + {_C('change * 0.9', -0.08, 0.08)})", 0.05, 120)} AS pb FROM (
    SELECT *, {_C("near * 1.25 + mid * 0.72 + far * 0.46 - gap * 4.8 - momentum * 1.4 - unrest * 6.2", -0.92, 0.92)} AS signal FROM (
    SELECT *, ln(c / greatest(e1, 0.01)) AS near, ln(c / greatest(e2, 0.01)) AS mid, ln(greatest(e2, 0.01) / greatest(e3, 0.01)) AS far, rate - ys AS gap, rate - yf AS momentum, mf - ms AS unrest FROM (
    SELECT n.*, greatest(n.close, 0.01) AS c, greatest(n.close, 0.01) / f.c - 1 AS change, e1 + 2.0::DOUBLE / 64 * (greatest(n.close, 0.01) - e1) AS e1, e2 + 2.0::DOUBLE / 253 * (greatest(n.close, 0.01) - e2) AS e2, e3 + 2.0::DOUBLE / 757 * (greatest(n.close, 0.01) - e3) AS e3,
      yf + 2.0::DOUBLE / 64 * (n.rate - yf) AS yf, ys + 2.0::DOUBLE / 757 * (n.rate - ys) AS ys, mf + 2.0::DOUBLE / 64 * (abs(greatest(n.close, 0.01) / f.c - 1) - mf) AS mf, ms + 2.0::DOUBLE / 253 * (abs(greatest(n.close, 0.01) / f.c - 1) - ms) AS ms, f.pe AS pe0, f.fw AS fw0, f.pb AS pb0
    FROM f JOIN n ON n.entity = f.entity AND n.no = f.no + 1))))),
  l AS (SELECT entity, arg_max(pe, no) AS lp, arg_max(fw, no) AS lf, arg_max(pb, no) AS lb FROM f GROUP BY 1)
  SELECT f.entity, f.d, {rnd(_C("pe * (ap / greatest(lp, 0.0001))", 2.4, 240), 4)} AS pe_ttm, {rnd(_C("fw * (af / greatest(lf, 0.0001))", 2, 120), 4)} AS pe_forward, {rnd(_C("pb * (ab / greatest(lb, 0.0001))", 0.2, 28), 4)} AS pb, {rnd(_C("f.rate", 0.001, 0.12), 5)} AS us10y_yield
  FROM f JOIN l USING (entity) JOIN n ON n.entity = f.entity AND n.no = f.no""")
def proxy_ratios(spark, sf):
    df = points(spark, sf)
    rates = df.where(F.dayofmonth("d").isin(10, 25) & (F.col("d") >= "1992-03-01")).select("d", F.col("us10y_yield").alias("rate"))
    df = proxy.rate_on(df.select("entity", "d", F.col("v").alias("close")), rates)
    n = F.length("entity")
    df = df.withColumns({"anchor_pe_ttm": 15 + n, "anchor_pe_forward": 14 + n, "anchor_pb": 2 + n / 10, "alpha_pe_ttm": F.when(n % 2 == 0, 0.115)})
    return proxy.proxy_ratios(df)


# Ratio payloads of several providers

#: Month-end rows of each fine series as a provider's anchors, daily rows as long series: k is the nation, j the segment's length.
NATION = "CAST(split_part(entity, '-', 2) AS INTEGER)"
ANCHORS = f"""t AS (SELECT *, {NATION} AS k, month(d) AS mo FROM b), an AS (SELECT entity, d, k, v / 200000 * CASE WHEN k % 6 = 1 THEN 4 ELSE 1 END AS pe_ttm, v / 250000 AS pe_forward, v / 300000 AS pb, CASE WHEN mo % 2 = 1 THEN 1.1::DOUBLE END AS peg
  FROM t QUALIFY row_number() OVER (PARTITION BY entity, date_trunc('month', d) ORDER BY d DESC) = 1)"""
LONG = """lo AS (SELECT entity, 'pe_ttm' AS metric, d, v / 200000 * 1.1::DOUBLE AS value FROM t WHERE (k % 3 = 0 AND day(d) % 2 = 0) OR (k % 3 = 1 AND mo = 6)
  UNION ALL SELECT entity, 'pb', d, v / 300000 * 1.1 FROM t WHERE (k % 3 = 1 AND day(d) % 2 = 0) OR (k % 3 = 2 AND mo = 6) UNION ALL SELECT entity, 'pe_forward', d, v / 250000 * 1.1 FROM t WHERE (k % 3 = 2 AND day(d) % 2 = 0) OR (k % 3 = 0 AND mo = 6))"""
LATEST = """la AS (SELECT entity, CASE WHEN k % 5 > 0 THEN arg_max(pe_ttm, d) * CASE WHEN k % 6 = 1 THEN 0.25 WHEN k % 4 = 0 THEN 5 WHEN k % 4 = 1 THEN -1 ELSE 1 END END AS pe_ttm, arg_max(pe_forward, d) * (1 + k % 2 * 3) AS pe_forward, CASE WHEN k % 2 = 0 THEN arg_max(pb, d) END AS pb, arg_max(peg, d) AS peg, 'stock' AS source FROM an WHERE k % 11 > 0 GROUP BY entity, k)"""
TODAY, DIVIDED = "2001-09-01", {"AUTOMOBILE-3": 5.0}
_SIDE = lambda m, c, k: f"max(value) FILTER (metric = '{m}' AND {'NOT ' * (not c)}coarse) AS {m}_{k}"
MERGED = f"""WITH {FINE}, {ANCHORS}, {LONG}, {LATEST}, g AS (SELECT *, d - lag(d) OVER (PARTITION BY entity, metric ORDER BY d) AS gap FROM lo),
  sh AS (SELECT entity, metric, count(*) AS n, count(*) < 3 OR coalesce(median(gap) FILTER (gap > 0) >= 120, true) AS coarse, max(d) AS ld, arg_max(value, d) AS lv FROM g GROUP BY 1, 2),
  md AS (SELECT entity, median(pe_ttm) AS md FROM (SELECT * FROM an WHERE abs(pe_ttm) >= 1e-8 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY d DESC) <= 8) GROUP BY 1),
  wr AS (SELECT entity FROM md JOIN la USING (entity) JOIN sh USING (entity) WHERE metric = 'pe_ttm' AND n >= 16 AND greatest(pe_ttm / md, md / pe_ttm) >= 3.5),
  wi AS (SELECT entity, d, {', '.join(_SIDE(m, c, k) for m in payloads.HINTS for k, c in (('o', False), ('u', True)))} FROM lo JOIN sh USING (entity, metric) GROUP BY 1, 2),
  me AS (SELECT entity, d, coalesce(pe_ttm_o, CASE WHEN entity NOT IN (SELECT entity FROM wr) THEN pe_ttm END, pe_ttm_u) AS pe_ttm, coalesce(pe_forward_o, pe_forward, pe_forward_u) AS pe_forward, coalesce(pb_o, pb, pb_u) AS pb, peg FROM an FULL JOIN wi USING (entity, d))"""


def _near_sql(m: str) -> str:
    own = "pe_ttm / " + f"CASE WHEN entity = 'AUTOMOBILE-3' THEN {DIVIDED['AUTOMOBILE-3']}::DOUBLE ELSE 1 END" if m == "pe_ttm" else m
    return f"CASE WHEN DATE '{TODAY}' - {m}_d BETWEEN 0 AND 120 AND (({own}) IS NULL OR greatest(({own}) / {m}_v, {m}_v / ({own})) < 3.2) THEN {m}_v ELSE coalesce({own}, {m}_v) END"


def _payload(spark, sf):
    t = fine(spark, sf).withColumns({"k": F.split("entity", "-")[1].cast("int"), "mo": F.month("d")})
    k = F.col("k")
    last = F.row_number().over(W.partitionBy("entity", F.trunc("d", "month")).orderBy(F.desc("d"))) == 1
    anchors = t.withColumn("last", last).where("last").select("entity", "d", "k", (F.col("v") / 200000 * F.when(k % 6 == 1, 4).otherwise(1)).alias("pe_ttm"), (F.col("v") / 250000).alias("pe_forward"), (F.col("v") / 300000).alias("pb"), F.when(F.col("mo") % 2 == 1, 1.1).alias("peg"))
    often, seldom = F.dayofmonth("d") % 2 == 0, F.col("mo") == 6
    long = None
    for m, by, often_k, seldom_k in (("pe_ttm", 200000, 0, 1), ("pb", 300000, 1, 2), ("pe_forward", 250000, 2, 0)):
        one = t.where(((k % 3 == often_k) & often) | ((k % 3 == seldom_k) & seldom)).select("entity", F.lit(m).alias("metric"), "d", (F.col("v") / by * 1.1).alias("value"))
        long = one if long is None else long.unionByName(one)
    end = lambda m: F.max_by(m, F.when(F.col(m).isNotNull(), F.col("d")))
    times = F.when(k % 6 == 1, 0.25).when(k % 4 == 0, 5).when(k % 4 == 1, -1).otherwise(1)
    latest = anchors.where(k % 11 > 0).groupBy("entity", "k").agg(*[end(m).alias(m) for m in payloads.METRICS])
    latest = latest.select("entity", F.when(k % 5 > 0, F.col("pe_ttm") * times).alias("pe_ttm"), (F.col("pe_forward") * (1 + k % 2 * 3)).alias("pe_forward"), F.when(k % 2 == 0, F.col("pb")).alias("pb"), "peg", F.lit("stock").alias("source"))
    return payloads.merge_payloads(anchors, latest, long, F.to_date(F.lit(TODAY)), DIVIDED)


@query(MERGED + f" SELECT entity, d, {', '.join(f'{rnd(m)} AS {m}' for m in payloads.METRICS)} FROM me WHERE coalesce(pe_ttm, pe_forward, pb, peg) IS NOT NULL")
def merged_payloads(spark, sf):
    """A provider's anchors and three long series: each is coarse for a third of the series and fills, dense for a third and goes first."""
    return _payload(spark, sf)[0].select("entity", "d", *[r6(m).alias(m) for m in payloads.METRICS])


@query(MERGED + f""", en AS (SELECT entity, {', '.join(f"max(ld) FILTER (metric = '{m}') AS {m}_d, max(lv) FILTER (metric = '{m}') AS {m}_v" for m in payloads.HINTS)} FROM sh GROUP BY 1)
  SELECT entity, {', '.join(f'{rnd(_near_sql(m))} AS {m}' for m in payloads.HINTS)}, {rnd('peg')} AS peg, concat_ws('+', source, {', '.join(f"CASE WHEN {m}_d IS NOT NULL THEN '{h}' END" for m, h in payloads.HINTS.items())}) AS source FROM la FULL JOIN en USING (entity)""")
def merged_latest(spark, sf):
    """Latest values: from the long series while fresh and near, from the provider where stale or 3.2 times off."""
    return _payload(spark, sf)[1].select("entity", *[r6(m).alias(m) for m in payloads.METRICS], "source")


#: The same anchors as rows of four sources by month, December's as annual ones; every series has a primary source by its nation.
SOURCES = f"""WITH {FINE}, {ANCHORS}, so AS (SELECT *, ['nasdaq', 'fmp', 'fai', 'zeta'][month(d) % 4 + 1] AS source, CASE WHEN month(d) = 12 THEN 'annual' ELSE 'quarterly' END AS period, ['nasdaq', 'fmp', 'fai'][k % 3 + 1] AS own FROM an),
  sr AS (SELECT entity, d, source, period, own, pe_ttm, CASE WHEN source <> 'nasdaq' OR k % 2 = 0 THEN pe_forward END AS pe_forward, pb, CASE WHEN k % 7 > 2 THEN coalesce(peg, 0.9) ELSE peg END AS peg FROM so),
  nw AS (SELECT entity, source, period, own, arg_max(pe_ttm, d) AS pe_ttm, arg_max(pe_forward, d) AS pe_forward, arg_max(pb, d) AS pb, arg_max(peg, d) AS peg FROM sr GROUP BY 1, 2, 3, 4),
  ra AS (SELECT *, CASE WHEN source = own THEN CASE WHEN period = 'quarterly' THEN 0 ELSE 1 END ELSE 2 + CASE source WHEN 'fai' THEN 0 WHEN 'nasdaq' THEN 1 WHEN 'fmp' THEN 2 ELSE 99 END END AS rk FROM sr),
  rn AS (SELECT *, CASE WHEN source = own THEN CASE WHEN period = 'quarterly' THEN 0 ELSE 1 END ELSE 2 + CASE source WHEN 'fai' THEN 0 WHEN 'nasdaq' THEN 1 WHEN 'fmp' THEN 2 ELSE 99 END END AS rk FROM nw),
  ow AS (SELECT e.entity FROM (SELECT DISTINCT entity FROM sr) e LEFT JOIN (SELECT entity, arg_min(pe_forward, rk) AS f, arg_min(peg, rk) AS g FROM rn WHERE rk < 2 GROUP BY 1) l USING (entity)
    LEFT JOIN (SELECT entity, count(pe_forward) AS nf, count(peg) AS ng FROM ra WHERE rk < 2 GROUP BY 1) c USING (entity) WHERE f IS NULL OR g IS NULL OR coalesce(nf, 0) < 4 OR coalesce(ng, 0) < 4),
  ua AS (SELECT * FROM ra WHERE rk < 2 OR (period = 'quarterly' AND entity IN (SELECT entity FROM ow))), un AS (SELECT * FROM rn WHERE rk < 2 OR (period = 'quarterly' AND entity IN (SELECT entity FROM ow)))"""


def _by_source(spark, sf) -> tuple[DataFrame, DataFrame]:
    t = fine(spark, sf).withColumns({"k": F.split("entity", "-")[1].cast("int"), "mo": F.month("d")})
    last = F.row_number().over(W.partitionBy("entity", F.trunc("d", "month")).orderBy(F.desc("d"))) == 1
    k, names = F.col("k"), F.array(*[F.lit(s) for s in ("nasdaq", "fmp", "fai", "zeta")])
    rows = t.withColumn("last", last).where("last").withColumns({"source": F.get(names, F.col("mo") % 4), "period": F.when(F.col("mo") == 12, "annual").otherwise("quarterly"), "own": F.get(names, k % 3)})
    peg = F.when(F.col("mo") % 2 == 1, 1.1)
    rows = rows.select(
        "entity", "d", "source", "period", "own", (F.col("v") / 200000 * F.when(k % 6 == 1, 4).otherwise(1)).alias("pe_ttm"), F.when((F.col("source") != "nasdaq") | (k % 2 == 0), F.col("v") / 250000).alias("pe_forward"),
        (F.col("v") / 300000).alias("pb"), F.when(k % 7 > 2, F.coalesce(peg, F.lit(0.9))).otherwise(peg).alias("peg"),
    )
    end = lambda m: F.max_by(m, F.when(F.col(m).isNotNull(), F.col("d")))
    return rows, rows.groupBy("entity", "source", "period", "own").agg(*[end(m).alias(m) for m in payloads.METRICS])


def _collected(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Sources lie in folders of their own, so that a source's rows are read when it is asked."""
    folder = f"{checkpoint_path(spark)}/sources-{uuid4().hex}"
    for name, df in zip(("anchors", "latest"), _by_source(spark, sf)):
        df.write.partitionBy("source").parquet(f"{folder}/{name}")
    both = [spark.read.parquet(f"{folder}/{name}") for name in ("anchors", "latest")]
    own = [df.where("source = own") for df in both]
    others = lambda open_: tuple(df.where("source <> own").join(open_, "entity", "left_semi") for df in both)
    return payloads.collect_ratios(both[0].select("entity"), others, tuple(own))


@query(SOURCES + f" SELECT entity, d, {', '.join(f'{rnd(f"arg_min({m}, rk)")} AS {m}' for m in payloads.METRICS)} FROM ua GROUP BY 1, 2")
def source_cascade(spark, sf):
    """Primary rows of every series; rows of alternative sources only for series that lack forward or growth ratios."""
    return _collected(spark, sf)[0].select("entity", "d", *[r6(m).alias(m) for m in payloads.METRICS])


@query(SOURCES + f""", tg AS (SELECT entity, string_agg(source || ':' || period, '+' ORDER BY rk, source) AS source FROM (SELECT DISTINCT entity, rk, source, period FROM ua) GROUP BY 1)
  SELECT entity, {', '.join(f'{rnd(f"arg_min({m}, rk)")} AS {m}' for m in payloads.METRICS)}, any_value(tg.source) AS source FROM un JOIN tg USING (entity) GROUP BY 1""")
def source_cascade_latest(spark, sf):
    return _collected(spark, sf)[1].select("entity", *[r6(m).alias(m) for m in payloads.METRICS], "source")


#: Quarters with rows of each kind as a supplier's candidate series: three ways to ask, then a source of its own.
STAGED = """q AS (SELECT l_suppkey AS k, ['AIR', 'RAIL', 'SHIP', 'MAIL'][l_linenumber % 4 + 1] AS way, CAST(count(DISTINCT date_trunc('quarter', l_shipdate)) FILTER (l_returnflag = 'R') AS BIGINT) AS eps, CAST(count(DISTINCT date_trunc('quarter', l_shipdate)) FILTER (l_returnflag = 'A') AS BIGINT) AS income,
    max(l_shipdate)::DATE AS last FROM lineitem WHERE l_quantity > 35 AND l_suppkey % 13 > 0 GROUP BY 1, 2)"""


@query(f"""WITH {STAGED}, o AS (SELECT *, CASE way WHEN 'AIR' THEN 0 WHEN 'RAIL' THEN 1 WHEN 'SHIP' THEN 2 ELSE 3 END AS st FROM q)
  SELECT k, eps, income, last, way AS stage FROM o WHERE eps + income > 0 QUALIFY row_number() OVER (PARTITION BY k ORDER BY CASE WHEN eps >= 13 AND income >= 13 THEN 0 ELSE 1 END, CASE WHEN eps >= 13 AND income >= 13 THEN st ELSE -(eps + income) END, st) = 1""")
def staged_candidates(spark, sf):
    """A supplier's first candidate with 13 quarters of both kinds, else the one with most; later ones are read for open suppliers only."""
    lines = load(spark, sf, "lineitem").where((F.col("l_quantity") > 35) & (F.col("l_suppkey") % 13 > 0)).select(F.col("l_suppkey").alias("k"), "l_linenumber", "l_returnflag", "l_shipdate")
    quarter = F.trunc("l_shipdate", "quarter")

    def stage(no: int, way: str):
        def read(open_: DataFrame) -> DataFrame:
            mine = lines.where(F.col("l_linenumber") % 4 == no).join(open_, "k", "left_semi")
            n = lambda flag: F.count_distinct(F.when(F.col("l_returnflag") == flag, quarter))
            return mine.groupBy("k").agg(n("R").alias("eps"), n("A").alias("income"), F.to_date(F.max("l_shipdate")).alias("last"))

        return way, read

    enough = (F.col("eps") >= 13) & (F.col("income") >= 13)
    return payloads.read_in_stages(lines, [stage(*w) for w in enumerate(("AIR", "RAIL", "SHIP", "MAIL"))], "k", enough, F.col("eps") + F.col("income"))


# Company facts

#: Quarterly entries of each supplier: measures by return flag, filings by line status (the open ones later, over two quarters, and not in every
#: quarter by a frame), a figure per share and an income. Units differ by supplier.
ENTRIES = """en AS (SELECT l_suppkey AS k, l_returnflag AS flag, l_linestatus AS status, last_day(CAST(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE)) AS e, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n
    FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_suppkey % 17 > 0 GROUP BY ALL),
  fa AS (SELECT k, flag, status, e + 1826 AS e, CASE WHEN n % 5 = 0 THEN NULL ELSE e + 1826 + CASE status WHEN 'F' THEN 30 ELSE 60 END END AS filed, e + 1826 - CASE WHEN status = 'O' AND k % 2 = 0 THEN 180 ELSE 89 END AS st, q / 8.0::DOUBLE AS v, n % 7 > 0 AS framed FROM en)"""


def _entries(spark, sf) -> DataFrame:
    lines = load(spark, sf, "lineitem").where((F.col("l_shipdate") >= "1996-01-01") & (F.col("l_suppkey") % 17 > 0))
    end = F.date_add(F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2)), 1826)
    rows = lines.groupBy(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), end.alias("e"))
    rows = rows.agg(F.sum("l_quantity").alias("q"), F.count(F.lit(1)).alias("n"))
    late, wide = F.when(F.col("status") == "F", 30).otherwise(60), (F.col("status") == "O") & (F.col("k") % 2 == 0)
    return rows.select("k", "flag", "status", "e", F.when(F.col("n") % 5 > 0, F.date_add("e", late)).alias("filed"), F.date_sub("e", F.when(wide, 180).otherwise(89)).alias("st"), (F.col("q") / 8).alias("v"), (F.col("n") % 7 > 0).alias("framed"))


def fact_documents(spark, sf) -> DataFrame:
    """A document of each supplier, as the provider writes it."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    frame = F.concat(F.lit("CY"), F.year("e").cast("string"), F.lit("Q"), F.quarter("e").cast("string"))
    entry = lambda v: F.struct(day("st").alias("start"), day("e").alias("end"), v.alias("val"), day("filed").alias("filed"), F.when(F.col("framed"), frame).alias("frame"), F.when(F.col("framed"), "FY").otherwise(F.lit("Q4")).alias("fp"))
    rows = _entries(spark, sf).groupBy("k", "flag").agg(F.sort_array(F.collect_list(entry(F.col("v")))).alias("eps"), F.sort_array(F.collect_list(entry(F.col("v") * 1000))).alias("income"))
    odd = F.col("k") % 2 == 1
    none = F.array().cast(rows.schema["eps"].dataType)
    share = F.when(odd, F.create_map(F.lit("EUR/shares"), F.col("eps"))).otherwise(F.create_map(F.lit("EUR/shares"), none, F.lit("USD/shares"), F.col("eps")))
    whole = F.when(odd, F.create_map(F.lit("ZAR/share"), none, F.lit("ZAR"), F.col("income"))).otherwise(F.create_map(F.lit("TWD"), none, F.lit("USD"), F.col("income")))
    name = {"A": ("us-gaap", "EarningsPerShareDiluted", "ProfitLoss"), "N": ("us-gaap", "EarningsPerShareBasic", "NetIncomeLoss"), "R": ("ifrs-full", "BasicEarningsLossPerShare", "ProfitLossAttributableToOwnersOfParent")}
    pick = lambda j: F.when(F.col("flag") == "A", name["A"][j]).when(F.col("flag") == "N", name["N"][j]).otherwise(name["R"][j])
    both = F.array(F.struct(pick(1).alias("key"), F.struct(share.alias("units")).alias("value")), F.struct(pick(2).alias("key"), F.struct(whole.alias("units")).alias("value")))
    rows = rows.select("k", pick(0).alias("tax"), both.alias("m")).groupBy("k", "tax").agg(F.map_from_entries(F.flatten(F.collect_list("m"))).alias("m"))
    docs = rows.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("tax", "m"))).alias("facts"))
    return docs.select("k", F.to_json(F.struct("facts")).alias("text"))


def _facts_sql(order: dict[str, int], names: dict[str, str], times: str) -> str:
    place = "CASE flag " + " ".join(f"WHEN '{f}' THEN {n}" for f, n in order.items()) + " END"
    label = "CASE flag " + " ".join(f"WHEN '{f}' THEN '{n}'" for f, n in names.items()) + " END"
    return f"""WITH {ENTRIES}, o AS (SELECT * FROM fa WHERE e >= DATE '2000-01-01' QUALIFY row_number() OVER (PARTITION BY k, flag, e ORDER BY (e - st BETWEEN 40 AND 140) DESC, filed DESC NULLS LAST, abs(v), st) = 1),
  c AS (SELECT k, flag, count(*) AS n, {place} AS p FROM o GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC, p) = 1)
  SELECT o.k, e AS date, v * {times} AS value, greatest(e, coalesce(filed, e)) AS available, {label.replace('flag', 'o.flag')} AS measure FROM o JOIN c ON o.k = c.k AND o.flag = c.flag"""


@query(_facts_sql({"A": 0, "N": 3, "R": 5}, {"A": "us-gaap:EarningsPerShareDiluted", "N": "us-gaap:EarningsPerShareBasic", "R": "ifrs-full:BasicEarningsLossPerShare"}, "1"))
def company_facts_eps(spark, sf):
    return facts.quarterly_facts(fact_documents(spark, sf), "k", "text", "eps")


@query(_facts_sql({"N": 0, "A": 1, "R": 4}, {"A": "us-gaap:ProfitLoss", "N": "us-gaap:NetIncomeLoss", "R": "ifrs-full:ProfitLossAttributableToOwnersOfParent"}, "1000"))
def company_facts_income(spark, sf):
    return facts.quarterly_facts(fact_documents(spark, sf), "k", "text", "net_income")


@query(f"WITH {ENTRIES} SELECT k, year(e) || '-Q' || quarter(e) AS quarter, min(greatest(e, coalesce(filed, e))) AS available FROM fa WHERE e >= DATE '2000-01-01' GROUP BY 1, 2")
def company_facts_available(spark, sf):
    return facts.first_available(fact_documents(spark, sf), "k", "text")


# Columnar payloads of pages and data files

#: Quarterly figures of each supplier, newest first, the first of each as the current column.
COLUMNS = """qu AS (SELECT l_suppkey AS k, last_day(CAST(date_trunc('quarter', l_shipdate) + INTERVAL 2 MONTH AS DATE)) AS e, CAST(sum(l_quantity) AS BIGINT) AS q, count(*) AS n FROM lineitem GROUP BY 1, 2),
  co AS (SELECT k, e, q / 64.0::DOUBLE AS pe, CASE WHEN n % 3 > 0 THEN q / 32.0::DOUBLE END AS fw, CASE WHEN n % 4 > 0 THEN -q / 128.0::DOUBLE END AS pb, q % 5 / 4.0::DOUBLE AS peg, n, row_number() OVER (PARTITION BY k ORDER BY e DESC) - 1 AS i FROM qu)"""


def _columns(spark, sf) -> DataFrame:
    """(k, rows): a supplier's quarters as an array, newest first."""
    end = F.last_day(F.add_months(F.trunc("l_shipdate", "quarter"), 2))
    rows = load(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("k"), end.alias("e")).agg(F.sum("l_quantity").cast("long").alias("q"), F.count(F.lit(1)).alias("n"))
    q, n = F.col("q"), F.col("n")
    one = F.struct("e", (q / 64).alias("pe"), F.when(n % 3 > 0, q / 32).alias("fw"), F.when(n % 4 > 0, -q / 128).alias("pb"), (q % 5 / 4).alias("peg"), "n")
    return rows.groupBy("k").agg(F.sort_array(F.collect_list(one), asc=False).alias("rows"))


def _json(f) -> F.Column:
    """One field of all rows as a JSON array; nulls stay."""
    return F.concat(F.lit("["), F.array_join(F.transform("rows", lambda r: F.coalesce(f(r).cast("string"), F.lit("null"))), ","), F.lit("]"))


def _quoted(f) -> F.Column:
    return _json(lambda r: F.concat(F.lit('"'), f(r), F.lit('"')))


def scripts_of(spark, sf) -> DataFrame:
    """A page of each supplier: the literal among others, with brackets in strings and nested arrays; every fifth has broken arrays."""
    day = lambda r: F.when(r["n"] % 5 == 0, F.date_format(r["e"], "yyyy")).otherwise(F.date_format(r["e"], "yyyy-MM-dd"))
    keys = _quoted(day)
    ttm = F.when(F.col("k") % 2 == 0, keys).otherwise(F.regexp_replace(keys, '^\\["[^"]*"', '["TTM"'))
    fw = F.when(F.col("k") % 5 == 0, F.lit("[1,void 0,2]")).otherwise(_json(lambda r: r["fw"]))
    text = F.concat(
        F.lit('<p>[{</p><script>x={a:"]}\\"[",financialData:\'no\'};\nself.q={meta:{pe:[9,9,9],t:"financialData:{"},financialData:{map:[["a],pe:[7]",{pb:[1]}]],note:"pb:[3],",'), F.lit("datekey:"), ttm, F.lit(",fiscalYear:[],"),
        F.lit("pe:"), _json(lambda r: r["pe"]), F.lit(",peForward:"), fw, F.lit(",ps:[\n1],'pb':"), _json(lambda r: r["pb"]), F.lit(",ptbvRatio:[5],pegRatio:[],peg:"), _json(lambda r: r["peg"]), F.lit(",ttmRevenueGrowth:[0]}};</script>"),
    )
    return _columns(spark, sf).select("k", text.alias("text"))


@query(f"WITH {COLUMNS}, w AS (SELECT *, CASE WHEN k % 5 > 0 THEN fw END AS f FROM co) SELECT k, CASE WHEN n % 5 = 0 THEN make_date(year(e), 12, 31) ELSE e END AS date, nullif(pe, 0) AS pe_ttm, f AS pe_forward, pb, nullif(peg, 0) AS peg FROM w WHERE i > 0")
def script_ratio_rows(spark, sf):
    return scripts.script_ratios(scripts_of(spark, sf), "k", "text")[0]


@query(f"WITH {COLUMNS} SELECT k, pe AS pe_ttm, CASE WHEN k % 5 > 0 THEN fw END AS pe_forward, pb, nullif(peg, 0) AS peg FROM co WHERE i = 0")
def script_ratio_latest(spark, sf):
    return scripts.script_ratios(scripts_of(spark, sf), "k", "text")[1]


def _table(*cells: F.Column) -> F.Column:
    """A data file whose third node is a table of places."""
    return F.concat(F.lit('{"type":"data","nodes":[null,{},{"data":['), F.concat_ws(",", *cells), F.lit("]}]}"))


@query(f"""WITH {COLUMNS} SELECT k, CASE WHEN k % 7 > 0 THEN nullif(round(pe, 2), 0) END AS pe_ttm, CASE WHEN k % 7 > 0 THEN 12.5::DOUBLE END AS pe_forward, CASE WHEN k % 7 > 0 THEN 1234.5::DOUBLE END AS pb, CAST(NULL AS DOUBLE) AS peg, CASE WHEN k % 7 = 0 THEN '/stocks/' || k END AS redirect FROM co WHERE i = 0""")
def statistics_page(spark, sf):
    """Entries that name a ratio more than once, words for none, numbers with signs; some documents redirect."""
    pe = F.round(F.get("rows", F.lit(0))["pe"], 2).cast("string")
    table = _table(
        F.lit('{"ratios":1}'), F.lit('{"data":2}'), F.lit("[3,6,8,10,13,15]"), F.lit('{"id":4,"hover":5}'), F.lit('"PE"'), F.concat(F.lit('"'), pe, F.lit('x"')), F.lit('{"id":7,"value":12}'), F.lit('"peForward"'),
        F.lit('{"id":9,"hover":14,"value":5}'), F.lit('"forwardpe"'), F.lit('{"id":11,"value":16}'), F.lit('" pbRatio "'), F.lit('"n/a"'), F.lit('{"id":17,"value":5}'), F.lit('"12.50"'), F.lit('{"id":4,"hover":14}'), F.lit('"1,234.5%"'), F.lit("null"),
    )
    moved = F.concat(F.lit('{"type":"Redirect","location":" /stocks/'), F.col("k").cast("string"), F.lit(' "}'))
    docs = _columns(spark, sf).select("k", F.when(F.col("k") % 7 == 0, moved).otherwise(table).alias("text"))
    return scripts.statistics_ratios(docs, "k", "text")


@query(f"""WITH {COLUMNS}, r AS (SELECT k, CASE WHEN i = 1 THEN first_value(e) OVER (PARTITION BY k ORDER BY i) ELSE e END AS e, i, pe, fw, n FROM co)
  SELECT k, figure, e AS date, arg_max(value, i) AS value FROM (SELECT k, 'eps' AS figure, e, i, {rnd('pe')} AS value FROM r UNION ALL SELECT k, 'net_income', e, i, {rnd('fw', 3)} FROM r WHERE fw IS NOT NULL UNION ALL SELECT k, 'shares', e, i, n FROM r WHERE n % 4 > 0) GROUP BY 1, 2, 3""")
def income_statement(spark, sf):
    """Parallel arrays of places; the first two columns have one date, the later of them counts; share counts of zero go."""
    # A column's items are places of their own: each array is followed by its items.
    df = _columns(spark, sf).withColumn("m", F.size("rows"))
    days = F.transform("rows", lambda r: F.concat(F.lit('"'), F.date_format(r["e"], "yyyy-MM-dd"), F.lit('"')))
    days = F.concat(F.slice(days, 1, 1), F.slice(days, 1, 1), F.slice(days, 3, 100000))
    days = F.slice(days, 1, F.col("m"))
    items = {
        "datekey": days,
        "epsBasic": F.transform("rows", lambda r: F.coalesce(r["pe"].cast("string"), F.lit("null"))),
        "netinc": F.transform("rows", lambda r: F.coalesce(r["fw"].cast("string"), F.lit('"none"'))),
        "shares": F.transform("rows", lambda r: F.when(r["n"] % 4 > 0, r["n"]).otherwise(0).cast("string")),
    }
    places = lambda no: F.sequence(7 + no * F.col("m"), 6 + (no + 1) * F.col("m")).cast("array<string>")
    arrays = [F.concat(F.lit("["), F.array_join(places(no), ","), F.lit("]")) for no in range(len(items))]
    cells = [F.array_join(values, ",") for values in items.values()]
    head = [F.lit('{"financialData":1}'), F.lit('{"datekey":2,"epsdil":6,"epsBasic":3,"netinc":4,"shares":5}'), *arrays, F.lit('"text"')]
    docs = df.select("k", _table(*head, *cells).alias("text"))
    return scripts.income_rows(docs, "k", "text")


# Pages read in passes


def _joined(f, sep: str = "\n") -> F.Column:
    return F.array_join(F.transform("rows", f), sep)


def monthly_pages(spark, sf) -> DataFrame:
    """A page of each supplier: a table of months, or lines, or both with one usable cell. Some values are out of range, and the newest month comes twice."""
    value = lambda r: F.round(r["pe"] * 64 / 3, 3).cast("string")
    month = lambda r, f: F.date_format(r["e"], f)
    cell = lambda r: F.concat(F.lit('<tr><td class="m"> '), month(r, "MMM yyyy"), F.lit(" </td>\n<td>"), value(r), F.lit("</td></tr>"))
    line = lambda r: F.concat(F.lit("<p>in <b>"), month(r, "MMMM yyyy"), F.lit("</b> | "), value(r), F.lit("</p>"))
    newest = F.get("rows", F.lit(0))
    again = F.concat(F.lit("<td>"), month(newest, "MMMM yyyy"), F.lit("</td><td>1.5</td><style>May 1999 3</style>"))
    one = F.concat(F.lit("<td>Foo 1999</td><td>7</td>"), cell(F.get("rows", F.lit(1))))
    page = F.when(F.col("k") % 3 == 0, F.concat(_joined(cell), again)).when(F.col("k") % 3 == 1, F.concat(_joined(line), F.lit("<script>April 1990 77</script>"))).otherwise(F.concat(one, _joined(line)))
    return _columns(spark, sf).select("k", page.alias("text"))


@query(f"""WITH {COLUMNS}, m AS (SELECT k, e, i, round(pe * 64 / 3, 3) AS v FROM co), g AS (SELECT k, i, e, v FROM m WHERE v <= 250 AND (k % 3 < 2 OR i = 1) UNION ALL SELECT k, 1000, e, 1.5 FROM m WHERE i = 0 AND k % 3 = 0
    UNION ALL SELECT k, i, e, v FROM m WHERE k % 3 = 2 AND v <= 250 AND (SELECT v FROM m x WHERE x.k = m.k AND x.i = 1) > 250)
  SELECT k, e AS date, arg_min(v, i) AS value FROM g GROUP BY 1, 2""")
def monthly_cells_or_lines(spark, sf):
    return tiers.monthly_table_or_lines(monthly_pages(spark, sf), "k", "text")


def record_pages(spark, sf) -> DataFrame:
    """A page of each supplier: keyed records of all months; pairs by epoch and, over some of them, by month, ten years later, as epochs have 13 digits only from 2001 on; or few records and a table."""
    pe = lambda r: r["pe"].cast("string")
    more = lambda r: (r["pe"] + 1).cast("string")
    keyed = lambda r: F.concat(F.lit('{"Date":"'), F.date_format(r["e"], "yyyy-MM-dd"), F.lit('","x":1,\n"Value":"'), pe(r), F.lit('"}'))
    later = lambda r: F.last_day(F.add_months(r["e"], 120))
    epoch = lambda r: F.concat(F.lit("["), (F.unix_date(later(r)).cast("long") * 86400000).cast("string"), F.lit(", "), pe(r), F.lit("]"))
    iso = lambda r: F.concat(F.lit('["'), F.date_format(later(r), "yyyy-MM"), F.lit('",'), more(r), F.lit("]"))
    cell = lambda r: F.concat(F.lit("<td>"), F.date_format(r["e"], "MMMM yyyy"), F.lit("</td> <td>"), more(r), F.lit("</td>"))
    few = lambda f, a, n: F.array_join(F.transform(F.slice("rows", a, n), f), ",")
    page = F.when(F.col("k") % 3 == 0, F.concat(_joined(keyed), _joined(cell))).when(F.col("k") % 3 == 1, F.concat(few(iso, 1, 4), _joined(epoch), few(iso, 3, 5))).otherwise(F.concat(few(cell, 4, 1000), few(keyed, 1, 5)))
    return _columns(spark, sf).select("k", page.alias("text"))


@query(f"WITH {COLUMNS} SELECT k, CASE WHEN k % 3 = 1 THEN last_day(e + INTERVAL 10 YEAR) ELSE e END AS date, CASE WHEN (k % 3 = 1 AND i < 7) OR (k % 3 = 2 AND i >= 3) THEN pe + 1 ELSE pe END AS value FROM co")
def monthly_records(spark, sf):
    return tiers.monthly_page(record_pages(spark, sf), "k", "text")


@query(f"""WITH {COLUMNS}, o AS (SELECT *, k % 5 AS f, round(pe, 2) AS p FROM co WHERE i = 0)
  SELECT k, CASE f WHEN 3 THEN 7.5::DOUBLE WHEN 0 THEN p ELSE CASE WHEN p >= 2 THEN p END END AS pe_ttm, CASE f WHEN 1 THEN round(p + 2, 2) WHEN 2 THEN CASE WHEN round(p + 1, 2) >= 2 THEN round(p + 1, 2) END END AS pe_forward, CASE f WHEN 2 THEN 3.25::DOUBLE END AS pb, CASE f WHEN 1 THEN -0.5::DOUBLE END AS peg,
    CASE f WHEN 0 THEN 'yahoo-key-statistics-latest-raw' WHEN 3 THEN 'yahoo-key-statistics-valuation-measures+yahoo-key-statistics-latest-raw' ELSE 'yahoo-key-statistics-valuation-measures' END AS source FROM o WHERE f < 4""")
def statistics_labels(spark, sf):
    """Pages with the raw ratio only; with labelled cells, the last in range counting; as escaped text; with both; with nothing."""
    p = F.round(F.get("rows", F.lit(0))["pe"], 2)
    x, y, z = (c.cast("string") for c in (p, F.round(p + 1, 2), F.round(p + 2, 2)))
    raw = lambda v: F.concat(F.lit('{"trailingPE":{"fmt":"1","raw":'), v, F.lit("}}"))
    cells = F.concat(F.lit("<tr><td>Trailing P/E</td><td> "), x, F.lit(" </td></tr><tr><td>Forward P/E</td><td>"), y, F.lit("</td></tr><tr><td>PEG Ratio (5 yr expected)</td><td>-0.5</td></tr><p>Forward P/E: "), z, F.lit("</p><p>Forward P/E 900</p>"))
    escaped = F.concat(F.lit('\\"label\\":\\"Trailing P\\/E\\",\\"v\\":{\\"raw\\":'), x, F.lit('},\\"label\\":\\"Forward P\\/E\\",\\"raw\\":'), y, F.lit(',\\"label\\":\\"Price\\/Book\\",\\"raw\\": 3.25'))
    f = F.col("k") % 5
    page = F.when(f == 0, raw(x)).when(f == 1, cells).when(f == 2, escaped).when(f == 3, F.concat(raw(x), F.lit("<b>Trailing P/E</b> 7.5"))).otherwise(F.lit("<p>Trailing P/E 1.5</p>"))
    return tiers.statistics_text(_columns(spark, sf).select("k", page.alias("text")), "k", "text")


# Series drawn to anchors

#: Anchors of both ratios on the 15th of some months, none for a year, none at the start; some out of range, one day twice; MACHINERY has none.
MONTHLY = f"""{P}, mo AS (SELECT DISTINCT entity, CAST(date_trunc('month', d) + INTERVAL 14 DAY AS DATE) AS d FROM p WHERE entity <> 'MACHINERY' AND month(d) % 3 > 0 AND d BETWEEN DATE '1995-04-01' AND DATE '2001-03-31' AND year(d) <> 1998),
  tr AS (SELECT entity, d, 8 + month(d) * CASE WHEN year(d) = 1997 THEN 0.1 ELSE 1 END::DOUBLE + CASE WHEN month(d) = 5 THEN 400 ELSE 0 END AS value FROM mo), fo AS (SELECT entity, d + CAST(month(d) * 4 AS INTEGER) AS d, 7 + month(d)::DOUBLE AS value FROM mo WHERE month(d) % 4 <> 2)"""


def _draw(name: str, anchors: str, metric: str, x: anchored.Limits) -> str:
    """(entity, d, value) of one ratio by as-of joins: k0, k1 the series around an anchor, n the scales, b the anchor before a day."""
    good = f"g{name} AS (SELECT * FROM {anchors} WHERE value BETWEEN {x.low} AND {x.high})"
    pos = f"o{name} AS (SELECT entity, d, {metric} AS v FROM p WHERE {metric} > 0)"
    near = f"k{name} AS (SELECT g.entity, g.d, g.value, a.d AS d0, a.v AS v0, z.d AS d1, z.v AS v1 FROM g{name} g ASOF LEFT JOIN o{name} a ON g.entity = a.entity AND g.d >= a.d ASOF LEFT JOIN o{name} z ON g.entity = z.entity AND g.d <= z.d)"
    scale = f"n{name} AS (SELECT *, lead(d) OVER w AS nd, lead(s) OVER w AS ns, row_number() OVER w AS no FROM (SELECT entity, d, least(greatest(value / CASE WHEN d0 IS NULL THEN v1 WHEN d1 IS NULL OR d1 = d0 THEN v0 ELSE v0 + (v1 - v0) * (d - d0) / (d1 - d0) END, {x.least}), {x.most}) AS s FROM k{name}) WINDOW w AS (PARTITION BY entity ORDER BY d))"
    at = f"b{name} AS (SELECT p.entity, p.d, {metric} AS base, coalesce(n.d, f.d) AS a, coalesce(n.s, f.s) AS s, CASE WHEN n.d IS NULL THEN f.nd ELSE n.nd END AS nd, CASE WHEN n.d IS NULL THEN f.ns ELSE n.ns END AS ns FROM p ASOF LEFT JOIN n{name} n ON p.entity = n.entity AND p.d > n.d LEFT JOIN n{name} f ON f.entity = p.entity AND f.no = 1)"
    mult = f"CASE WHEN d < a THEN CASE WHEN a - d <= {x.back} THEN s END WHEN nd IS NULL THEN CASE WHEN d - a <= {x.forward} THEN s END WHEN nd - a <= {x.span} THEN s + (ns - s) * (d - a) / (nd - a) END"
    done = f"r{name} AS (SELECT entity, d, CASE WHEN a IS NULL OR base <= 0 THEN base ELSE least(greatest(base * coalesce({mult}, 1), {x.low}), {x.high}) END AS value FROM b{name})"
    return ", ".join([good, pos, near, scale, at, done])


@query(f"""WITH {MONTHLY}, {_draw('t', 'tr', 'pe_ttm', anchored.TRAILING)}, {_draw('f', 'fo', 'pe_forward', anchored.FORWARD)}
  SELECT entity, d, {rnd('t.value', 4)} AS pe_ttm, {rnd('f.value', 4)} AS pe_forward FROM rt t JOIN rf f USING (entity, d)""")
def anchored_ratios(spark, sf):
    df = points(spark, sf).select("entity", "d", "pe_ttm", "pe_forward")
    month = F.date_add(F.trunc("d", "month"), 14)
    mo = df.where((F.col("entity") != "MACHINERY") & (F.month("d") % 3 > 0) & F.col("d").between("1995-04-01", "2001-03-31") & (F.year("d") != 1998)).select("entity", month.alias("d")).distinct()
    m = F.month("d")
    trailing = mo.select("entity", "d", (8 + m * F.when(F.year("d") == 1997, 0.1).otherwise(1.0) + F.when(m == 5, 400).otherwise(0)).alias("value"))
    forward = mo.where(m % 4 != 2).select("entity", F.date_add("d", m * 4).alias("d"), (7 + m).cast("double").alias("value"))
    out = anchored.monthly_overrides(df, trailing, forward)
    return out.select("entity", "d", r6("pe_ttm", 4).alias("pe_ttm"), r6("pe_forward", 4).alias("pe_forward"))


# Series side by side

#: Fine series of five segments and nations, with a forward start; one is short, one ends early.
CHOSEN = ["AUTOMOBILE-1", "BUILDING-2", "FURNITURE-3", "HOUSEHOLD-4", "MACHINERY-5", "NOWHERE-0"]
_IDS = ", ".join(f"'{x}'" for x in CHOSEN)
SIDE = f"""WITH {FINE}, m AS (SELECT entity, d, v AS value FROM b WHERE entity IN ({_IDS}) AND NOT (entity = 'MACHINERY-5' AND d > DATE '2000-06-30') AND NOT (entity = 'HOUSEHOLD-4' AND d < DATE '1999-01-01')),
  f AS (SELECT entity, d, value FROM m JOIN (SELECT entity, CASE WHEN entity <> 'BUILDING-2' THEN min(d) + 400 ELSE max(d) END AS fs FROM m GROUP BY 1) USING (entity) WHERE d >= fs)"""
_IN = "i AS (SELECT {0}.* FROM {0} JOIN (SELECT entity, CASE WHEN n >= 60 THEN day END AS day FROM (SELECT entity, any_value(day) AS day, count(*) FILTER ({0}.d >= day) AS n FROM {0} JOIN (SELECT entity, CAST(max(d) - INTERVAL 5 YEAR AS DATE) AS day FROM {0} GROUP BY 1) USING (entity) GROUP BY 1)) USING (entity) WHERE (day IS NULL OR d >= day))"


def _side(spark, sf) -> tuple[DataFrame, DataFrame]:
    df = fine(spark, sf).where(F.col("entity").isin(CHOSEN)).where(~((F.col("entity") == "MACHINERY-5") & (F.col("d") > "2000-06-30")) & ~((F.col("entity") == "HOUSEHOLD-4") & (F.col("d") < "1999-01-01")))
    df = df.select("entity", "d", F.col("v").alias("pe_forward"))
    starts = df.groupBy("entity").agg(F.when(F.col("entity") != "BUILDING-2", F.date_add(F.min("d"), 400)).alias("forward_start"))
    return df, starts


_Z = f"coalesce((value - avg(value) {FRAME.format(755)}) / nullif(stddev_samp(value) {FRAME.format(755)}, 0), 0)"


@query(SIDE + f""", {_IN.format('f')}, c AS (SELECT * FROM i WHERE d BETWEEN DATE '1997-01-01' AND DATE '2001-05-31'), z AS (SELECT * FROM c WHERE (SELECT count(*) FROM c x WHERE x.entity = c.entity) >= 2),
  s AS (SELECT max(a) AS a FROM (SELECT entity, min(d) AS a FROM z GROUP BY 1)), k AS (SELECT entity, d, value, {RANK.format('value', FRAME.format(1259))} AS p5, {RANK.format('value', FRAME.format(2519))} AS p10, {RANK.format('value', FRAME.format('UNBOUNDED'))} AS pf, {_Z} AS z FROM z),
  r AS (SELECT * FROM k, s WHERE d >= a), t AS (SELECT entity FROM r GROUP BY 1 HAVING count(*) >= 2)
  SELECT entity, d, value, {rnd('p5')} AS percentile_5y, {rnd('p10')} AS percentile_10y, {rnd('pf')} AS percentile_full, {rnd('z')} AS z_score_3y, {REGIME.format('pf')} AS regime FROM r WHERE entity IN (SELECT entity FROM t)""")
def compare_ranked(spark, sf):
    """Forward ratios from each series' start, five years of each, a range given the wrong way round, then ranks and the common start."""
    df, starts = _side(spark, sf)
    rows = compare.metric_rows(df, "pe_forward", starts)
    out = compare.compare_rows(rows, compare.chosen([], CHOSEN + ["x"]) + CHOSEN[4:], 5, "2001-05-31", "1997-01-01")
    cols = ["percentile_5y", "percentile_10y", "percentile_full", "z_score_3y"]
    return out.select("entity", "d", "value", *[r6(c).alias(c) for c in cols], "regime")


@query(SIDE + f", {_IN.format('m')} SELECT min(d) AS min_date, max(d) AS max_date FROM i")
def compare_bounds(spark, sf):
    df, _ = _side(spark, sf)
    return compare.date_bounds(df.select("entity", "d", F.col("pe_forward").alias("value")), 5)


# Pages of single providers

#: Five years on, so that some dates lie before the first day of history; ends of years stand for themselves.
LATER = f"{COLUMNS}, la AS (SELECT k, i, last_day(e + INTERVAL 4 YEAR) AS e, pe FROM co)"


def ratio_pages(spark, sf) -> DataFrame:
    """A page of each supplier: dated values among shorter arrays; objects of years; or dated values all too old and objects of years."""
    day = lambda r: F.last_day(F.add_months(r["e"], 48))
    at = lambda r, back: (F.unix_date(day(r)).cast("long") * 86400 - back).cast("string")
    point = lambda r, back: F.concat(F.lit('{"d":'), at(r, back), F.lit(',"v":'), r["pe"].cast("string"), F.lit("}"))
    dated = lambda back: F.concat(F.lit("data = ["), _joined(lambda r: point(r, back), ","), F.lit("];"))
    ends = F.filter("rows", lambda r: F.month(r["e"]) == 12)
    years = F.concat(F.lit("data={"), F.array_join(F.transform(ends, lambda r: F.concat(F.lit('"'), F.date_format(day(r), "yyyy"), F.lit('":'), r["pe"].cast("string"))), ","), F.lit(',"x":3,"1850":2,"1999":0};'))
    page = F.when(F.col("k") % 3 == 0, F.concat(F.lit('data = [{"d":1e9,"v":5}];'), dated(0), years)).when(F.col("k") % 3 == 1, F.concat(F.lit("data = [{bad}];data = {};"), years)).otherwise(F.concat(dated(600000000), F.lit(' data={"2001":9};'), years))
    return _columns(spark, sf).select("k", page.alias("text"))


@query(f"WITH {LATER} SELECT k, e AS date, pe AS value FROM la WHERE e >= DATE '2000-01-01' AND (k % 3 = 0 OR month(e) = 12)")
def ratio_page_series(spark, sf):
    return providers.ratio_series(ratio_pages(spark, sf), "k", "text")


@query("""WITH s AS (SELECT s_nationkey AS page, s_suppkey AS rank, 'T' || s_suppkey % 3 || '.A' AS symbol, 'co-' || s_suppkey AS slug, s_name || ' & Co' AS display_name, greatest(floor(s_acctbal), 0) * 1000 AS market_cap FROM supplier)
  SELECT page, rank, symbol, slug, display_name, CAST(market_cap AS DOUBLE) AS market_cap FROM s WHERE market_cap > 0 AND rank > 0 QUALIFY row_number() OVER (PARTITION BY page, symbol ORDER BY rank) = 1""")
def top_company_pages(spark, sf):
    """A page of each nation's suppliers; several share a symbol, some have no market value."""
    s = load(spark, sf, "supplier")
    n, cap = F.col("s_suppkey").cast("string"), F.greatest(F.floor("s_acctbal"), F.lit(0)) * 1000
    row = F.concat(
        F.lit('<tr><td class="fav"><i>x</i></td><td class="rank-td td-right" data-x="1" data-sort="'), n, F.lit('">1</td><td class="name-td"><div><a href="/CO-'), n, F.lit('/marketcap/" title="y"><div class="company-name"><b>'), F.col("s_name"),
        F.lit('</b>\n &amp; Co</div><div class="company-code"><span class="rank"></span> t'), (F.col("s_suppkey") % 3).cast("string"), F.lit('.a </div></a></td><td class="td-right" data-sort="'), cap.cast("string"), F.lit('">$1</td></tr>'),
    )
    docs = s.groupBy(F.col("s_nationkey").alias("page")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("s_suppkey", row.alias("r")))), lambda x: x["r"]), "\n").alias("text"))
    return providers.top_companies(docs, "page", "text")


def _timeseries(spark, sf) -> tuple[DataFrame, DataFrame]:
    entry = lambda r, v: F.concat(F.lit('{"asOfDate":"'), F.date_format(r["e"], "yyyy-MM-dd"), F.lit('","reportedValue":{"raw":'), v.cast("string"), F.lit("}}"))
    newest = F.get("rows", F.lit(0))
    entries = F.concat(entry(newest, F.lit(1.5)), F.lit(',null,{"asOfDate":"soon","reportedValue":{"raw":2}},{"asOfDate":"2030-01-01","reportedValue":{"raw":0}},'), _joined(lambda r: entry(r, r["pe"]), ","), F.lit(","), entry(newest, newest["pe"] + 1))
    text = F.concat(F.lit('{"timeseries":{"result":[{"x":1},{"trailingPeRatio":[]},{"trailingPeRatio":['), entries, F.lit(']},{"trailingPeRatio":[{"asOfDate":"2031-01-01","reportedValue":{"raw":7}}]}]}}'))
    return providers.ratio_timeseries(_columns(spark, sf).select("k", text.alias("text")), "k", "text", "trailingPeRatio")


@query(f"WITH {COLUMNS} SELECT k, e AS date, CASE WHEN i = 0 THEN pe + 1 ELSE pe END AS value FROM co WHERE pe <> 0")
def timeseries_payload(spark, sf):
    return _timeseries(spark, sf)[0]


@query(f"WITH {COLUMNS} SELECT k, e AS date, pe + 1 AS value FROM co WHERE i = 0")
def timeseries_latest(spark, sf):
    return _timeseries(spark, sf)[1]


@query(f"""WITH {COLUMNS} SELECT k, CASE k % 5 WHEN 0 THEN pe WHEN 1 THEN 12.25 WHEN 2 THEN 3.5 WHEN 3 THEN NULL ELSE NULL END::DOUBLE AS ratio FROM co WHERE i = 0""")
def fund_page_ratio(spark, sf):
    pe = F.get("rows", F.lit(0))["pe"].cast("string")
    k = F.col("k") % 5
    page = F.when(k == 0, F.concat(F.lit('<b>PE Ratio</b> 9 {"peRatio":1,"x":0,"PERATIO":"'), pe, F.lit('"}'))).when(k == 1, F.lit('{"peratio":12.25,"y":1}')).when(k == 2, F.lit("<script>PE Ratio 7</script><td>PE&nbsp;Ratio</td>\n<td> 3.5x")).when(k == 3, F.lit('"peRatio":"0.0"')).otherwise(F.lit("<p>no ratio"))
    return _columns(spark, sf).select("k", providers.page_ratio(page).alias("ratio"))


# A latest value against its baseline, and expected figures from two ways

@query(f"""WITH {S}, {A}, m AS (SELECT entity, d, anchor / 2 AS value FROM a WHERE anchor IS NOT NULL AND NOT (year(d) = 1997 AND month(d) BETWEEN 2 AND 11) AND entity <> 'BUILDING'),
  c AS (SELECT entity, d, CASE day(d) % 4 WHEN 0 THEN 100 ELSE 12 + day(d) % 9 END::DOUBLE AS candidate FROM s WHERE day(d) IN (3, 11, 17, 24)),
  b AS (SELECT c.*, l.d AS d0, l.value AS v0, r.d AS d1, r.value AS v1 FROM c ASOF LEFT JOIN m l ON c.entity = l.entity AND c.d >= l.d ASOF LEFT JOIN m r ON c.entity = r.entity AND c.d <= r.d),
  e AS (SELECT *, CASE WHEN d0 IS NULL THEN NULL WHEN d1 IS NULL THEN CASE WHEN d - d0 <= 60 THEN v0 END WHEN d0 = d1 THEN v0 WHEN d1 - d0 <= 240 THEN v0 + (v1 - v0) * (d - d0) / (d1 - d0) END AS baseline FROM b)
  SELECT entity, d, candidate, {rnd('baseline')} AS baseline, candidate > 4 AND candidate < 80 AND (baseline IS NULL OR NOT (baseline > 4 AND baseline < 80) OR abs(candidate - baseline) / greatest(baseline, 1e-6) <= 0.05) AS accepted FROM e""")
def accepted_latest(spark, sf):
    """Candidates on four days of each month against the month ends; a year is missing, one entity has no series."""
    df = month_ends(spark, sf)
    series = df.where(F.col("anchor").isNotNull() & ~((F.year("d") == 1997) & F.month("d").between(2, 11)) & (F.col("entity") != "BUILDING")).select("entity", "d", (F.col("anchor") / 2).alias("value"))
    day = F.dayofmonth("d")
    candidates = df.where(day.isin(3, 11, 17, 24)).select("entity", "d", F.when(day % 4 == 0, 100).otherwise(12 + day % 9).cast("double").alias("candidate"))
    return board.accept_latest(series, candidates).withColumn("baseline", r6("baseline"))


@query(f"""WITH {Q}, f AS (SELECT entity, d - 20 AS d, qty / 7.0::DOUBLE AS v, 0 AS rk FROM q WHERE year(d) >= 1999 AND quarter(d) < 4 UNION ALL SELECT entity, d - 30, qty / 3.0::DOUBLE, 0 FROM q WHERE year(d) >= 1999 AND quarter(d) = 2
    UNION ALL SELECT entity, d - 50, qty / 11.0::DOUBLE, 1 FROM q WHERE year(d) >= 1998)
  SELECT entity, year(d) || '-Q' || quarter(d) AS quarter, d, {rnd('v', 3)} AS net_income, rk = 0 AS direct FROM f QUALIFY row_number() OVER (PARTITION BY entity, year(d), quarter(d) ORDER BY rk, d) = 1""")
def expected_income_merged(spark, sf):
    df = quarters(spark, sf)
    late = df.where(F.year("d") >= 1999)
    forecast = late.where(F.quarter("d") < 4).select("entity", F.date_sub("d", 20).alias("d"), (F.col("qty") / 7).alias("net_income"))
    forecast = forecast.unionByName(late.where(F.quarter("d") == 2).select("entity", F.date_sub("d", 30).alias("d"), (F.col("qty") / 3).alias("net_income")))
    estimated = df.where(F.year("d") >= 1998).select("entity", F.date_sub("d", 50).alias("d"), (F.col("qty") / 11).alias("net_income"))
    return qt.merge_expected(forecast, estimated)
