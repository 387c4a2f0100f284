"""The query catalogue: every query with the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import dates as fd
from tidemark.functions import numbers as fn
from tidemark.functions import text as ft
from tidemark.operators import alerts as al
from tidemark.operators import board as bd
from tidemark.operators import merge, quality, stats, timeseries, valuation, windows
from tidemark.operators import quarters as qt
from tidemark.operators.asof import asof_join
from tidemark.plans import api
from tidemark.session import checkpoint_path, load, ship_package
from tidemark.sources import parse, readers, sinks
from tidemark.streaming.alerts import open_counts, stream_alerts, stream_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

S = """s AS (SELECT c_mktsegment AS entity, CAST(o_orderdate AS DATE) AS d,
  floor(CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(*) + 0.5) / 100 AS v
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
P = S + """, p AS (SELECT entity, d, v, v / 10000 - 12 AS pe_ttm, (v / 10000 - 12) * 0.9 AS pe_forward, v / 50000 AS pb,
  0.03 + (dayofyear(d) % 100) * 0.0001 AS us10y_yield FROM s)"""
KEY = "CASE WHEN {0} >= 0 THEN {0} ELSE 1000000.0 + 1 / greatest(abs({0}), 0.000001) END"
DIM = """dim AS (SELECT c_mktsegment AS entity, CASE WHEN length(c_mktsegment) % 2 = 0 THEN 'core' ELSE 'sector' END AS "group",
  upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) AS display_name,
  row_number() OVER (ORDER BY c_mktsegment) AS position FROM (SELECT DISTINCT c_mktsegment FROM customer))"""
A = """a AS (SELECT entity, d, v AS price, CASE WHEN d = max(d) OVER (PARTITION BY entity, date_trunc('month', d)) THEN v * 0.0002 + 1 END AS anchor FROM s)"""
Q = """q AS (SELECT l_returnflag AS entity, last_day(max(CAST(l_shipdate AS DATE))) AS d, sum(CAST(l_quantity AS BIGINT))::BIGINT AS qty
  FROM lineitem GROUP BY 1, year(l_shipdate), quarter(l_shipdate))"""


def rnd(x: str, digits: int = 6) -> str:
    return f"floor(({x}) * 1e{digits} + 0.5) / 1e{digits}"


def r6(c, digits: int = 6):
    return fn.round_half_up(F.col(c) if isinstance(c, str) else c, digits)


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def daily(spark: SparkSession, sf: str) -> DataFrame:
    """Mean order value by market segment and day, from exact sums of cents."""
    orders = load(spark, sf, "orders").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = load(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    rows = orders.join(customers, "o_custkey").groupBy(F.col("c_mktsegment").alias("entity"), F.to_date("o_orderdate").alias("d"))
    return rows.agg((F.floor(F.sum(cents).cast("double") / F.count(F.lit(1)) + 0.5) / 100).alias("v"))


def points(spark: SparkSession, sf: str) -> DataFrame:
    pe = F.col("v") / 10000 - 12
    return daily(spark, sf).withColumns({"pe_ttm": pe, "pe_forward": pe * 0.9, "pb": F.col("v") / 50000, "us10y_yield": 0.03 + (F.dayofyear("d") % 100) * 0.0001})


def dim(spark: SparkSession, sf: str) -> DataFrame:
    seg = load(spark, sf, "customer").select(F.col("c_mktsegment").alias("entity")).distinct()
    group = F.when(F.length("entity") % 2 == 0, "core").otherwise("sector")
    name = F.concat(F.upper(F.substring("entity", 1, 1)), F.lower(F.expr("substring(entity, 2)")))
    # The catalogue has one row per segment.
    return seg.select("entity", group.alias("group"), name.alias("display_name"), F.row_number().over(W.orderBy("entity")).cast("long").alias("position"))


def anchored(spark: SparkSession, sf: str) -> DataFrame:
    """Daily prices with an anchor value on the last day of each month."""
    last = F.max("d").over(W.partitionBy("entity", F.trunc("d", "month")))
    return daily(spark, sf).select("entity", "d", F.col("v").alias("price"), F.when(F.col("d") == last, F.col("v") * 0.0002 + 1).alias("anchor"))


def quarters(spark: SparkSession, sf: str) -> DataFrame:
    ship = F.to_date("l_shipdate")
    rows = load(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("entity"), F.year(ship).alias("y"), F.quarter(ship).alias("q"))
    return rows.agg(F.last_day(F.max(ship)).alias("d"), F.sum(F.col("l_quantity").cast("long")).alias("qty")).drop("y", "q")


@query(f"WITH {S} SELECT * FROM s")
def daily_series(spark, sf):
    return daily(spark, sf)


FRAME = "OVER (PARTITION BY entity ORDER BY d ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
RANK = "len(list_filter(list({0}) {1}, lambda x: x <= {0})) / CAST(len(list({0}) {1}) AS DOUBLE)"


@query(f"WITH {S} SELECT entity, d, {rnd(RANK.format('v', FRAME.format(251)))} AS percentile FROM s")
def pct_rank_rows(spark, sf):
    df = windows.framed_ranks(daily(spark, sf), "entity", "d", "v", {"percentile": 252})
    return df.select("entity", "d", r6("percentile").alias("percentile"))


@query(f"WITH {S} SELECT entity, d, {rnd(RANK.format('v', FRAME.format('UNBOUNDED')))} AS percentile FROM s")
def pct_rank_full(spark, sf):
    out = windows.expanding_percentile(daily(spark, sf), "entity", "d", "v")
    return out.select("entity", "d", r6("percentile").alias("percentile"))


YEARS = "OVER (PARTITION BY entity ORDER BY d RANGE BETWEEN INTERVAL 1 YEAR PRECEDING AND CURRENT ROW)"


@query(f"WITH {S} SELECT entity, d, {rnd(RANK.format('v', YEARS))} AS percentile FROM s")
def pct_rank_years(spark, sf):
    df = windows.framed_ranks(daily(spark, sf), "entity", "d", "v", {}, {"percentile": 1})
    return df.select("entity", "d", r6("percentile").alias("percentile"))


Z = f"coalesce((pe_ttm - avg(pe_ttm) {FRAME.format(755)}) / nullif(stddev_samp(pe_ttm) {FRAME.format(755)}, 0), 0)"


@query(f"WITH {P} SELECT entity, d, {rnd(Z)} AS z FROM p")
def zscore_frame(spark, sf):
    return points(spark, sf).select("entity", "d", r6(windows.z_score("pe_ttm", windows.row_frame("entity", "d", 756))).alias("z"))


EY = "CASE WHEN pe_ttm > 0 THEN least(greatest(1 / pe_ttm, -1), 1) ELSE 0 END"
RAW_EY = "CASE WHEN pe_ttm > 0 THEN least(greatest(1 / pe_ttm, -1), 1) ELSE 0.0 END"
K = f"k AS (SELECT *, {KEY.format('pe_ttm')} AS key FROM p)"
E_ = f"""e AS (SELECT *, {RAW_EY} AS ey, {RANK.format('key', FRAME.format(1259))} AS p5, {RANK.format('key', FRAME.format(2519))} AS p10,
  {RANK.format('key', FRAME.format('UNBOUNDED'))} AS pf, {Z} AS z FROM k)"""
REGIME = "CASE WHEN {0} <= 0.15 THEN 'low' WHEN {0} >= 0.85 THEN 'high' ELSE 'neutral' END"


@query(f"""WITH {P}, {K}, {E_} SELECT entity, d, {rnd('pe_ttm')} AS pe_ttm, {rnd('ey')} AS earnings_yield,
  {rnd('least(greatest(ey - us10y_yield, -1), 1)')} AS erp_proxy, {rnd('p5')} AS percentile_5y, {rnd('p10')} AS percentile_10y,
  {rnd('pf')} AS percentile_full, {rnd('z')} AS z_score_3y, {REGIME.format('pf')} AS regime FROM e""")
def enrich_series(spark, sf):
    df = stats.enrich_series(points(spark, sf))
    cols = ["pe_ttm", "earnings_yield", "erp_proxy", "percentile_5y", "percentile_10y", "percentile_full", "z_score_3y"]
    return df.select("entity", "d", *[r6(c).alias(c) for c in cols], "regime")


@query(f"""WITH {P}, f AS (SELECT entity, d, pb AS value FROM p WHERE d BETWEEN DATE '1996-01-01' AND DATE '1998-12-31'), k AS (SELECT *, {KEY.format('value')} AS key FROM f)
  SELECT entity, d, {rnd('value')} AS value, {rnd(RANK.format('key', FRAME.format(1259)))} AS percentile_5y, {rnd(RANK.format('key', FRAME.format('UNBOUNDED')))} AS percentile_full FROM k""")
def metric_series_filtered(spark, sf):
    df = stats.metric_series(points(spark, sf), "pb", "1996-01-01", "1998-12-31")
    return df.select("entity", "d", r6("value").alias("value"), r6("percentile_5y").alias("percentile_5y"), r6("percentile_full").alias("percentile_full"))


@query(f"""WITH {P} SELECT d, {rnd('pe_forward')} AS value, {rnd(RANK.format('key', YEARS.replace('1 YEAR', '5 YEAR').replace('PARTITION BY entity ', '')))} AS percentile_5y
  FROM (SELECT *, {KEY.format('pe_forward')} AS key FROM p WHERE entity = 'BUILDING')""")
def series_calendar_frame(spark, sf):
    return api.series(points(spark, sf), "BUILDING", "pe_forward", frame="years").select("d", r6("value").alias("value"), r6("percentile_5y").alias("percentile_5y"))


@query(f"SELECT c_custkey, {rnd(KEY.format('c_acctbal'))} AS rank_key, {rnd('cume_dist() OVER (PARTITION BY c_nationkey ORDER BY ' + KEY.format('c_acctbal') + ')')} AS share FROM customer")
def signed_rank_key(spark, sf):
    df = load(spark, sf, "customer").withColumn("k", fn.valuation_rank_key(F.col("c_acctbal")))
    return df.select("c_custkey", r6("k").alias("rank_key"), r6(F.cume_dist().over(W.partitionBy("c_nationkey").orderBy("k"))).alias("share"))


LATEST = f"WITH {P}, {K}, {E_}, {DIM}, l AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY entity ORDER BY d DESC) = 1)"


@query(f"""{LATEST} SELECT entity, "group", display_name, d, {rnd('pe_ttm')} AS pe_ttm, {rnd('p5')} AS percentile_5y, {rnd('pf')} AS percentile_full, {rnd('z')} AS z_score_3y,
  {REGIME.format('pf')} AS regime FROM l JOIN dim USING (entity)""")
def snapshot_latest(spark, sf):
    df = api.snapshot(points(spark, sf), dim(spark, sf))
    return df.select("entity", "group", "display_name", "d", r6("pe_ttm").alias("pe_ttm"), r6("percentile_5y").alias("percentile_5y"), r6("percentile_full").alias("percentile_full"), r6("z_score_3y").alias("z_score_3y"), "regime")


@query(f"""{LATEST} SELECT entity, "group", display_name, {rnd('pe_ttm')} AS pe_ttm, {rnd('pf')} AS percentile_full, {REGIME.format('pf')} AS regime, position FROM l JOIN dim USING (entity) WHERE "group" = 'core'""")
def heatmap_core(spark, sf):
    df = api.heatmap(points(spark, sf), dim(spark, sf), "core")
    return df.select("entity", "group", "display_name", r6("pe_ttm").alias("pe_ttm"), r6("percentile_full").alias("percentile_full"), "regime", "position")


@query(f"WITH {P}, {K}, {E_} SELECT entity, {REGIME.format('pf')} AS regime, count(*) AS n FROM e GROUP BY 1, 2")
def regime_counts(spark, sf):
    return stats.enrich_series(points(spark, sf)).groupBy("entity", "regime").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {P}, {DIM} SELECT entity, \"group\", display_name, position, min(d) AS start_date, max(d) AS end_date, count(*) AS n_points FROM p JOIN dim USING (entity) GROUP BY ALL")
def meta(spark, sf):
    return api.meta(points(spark, sf), dim(spark, sf))


def _latest_sql(key: str) -> str:
    share = lambda y: f"count(*) FILTER (d >= CAST(ld - INTERVAL {y} YEAR AS DATE) AND key <= lk) / CAST(count(*) FILTER (d >= CAST(ld - INTERVAL {y} YEAR AS DATE)) AS DOUBLE)"
    year = "CAST(ld - INTERVAL 1 YEAR AS DATE)"
    return f"""WITH {P}, k AS (SELECT *, {key} AS key FROM p), l AS (SELECT entity, max(d) AS ld, arg_max(pe_ttm, d) AS lv, arg_max(key, d) AS lk FROM k GROUP BY 1),
  g AS (SELECT entity, any_value(ld) AS last_date, any_value(lv) AS lv, count(*) AS n_points, count(*) FILTER (key <= lk) / CAST(count(*) AS DOUBLE) AS pf, {share(10)} AS p10, {share(5)} AS p5, {share(3)} AS p3,
    avg(pe_ttm) FILTER (d >= CAST(ld - INTERVAL 3 YEAR AS DATE)) AS m, coalesce(stddev_samp(pe_ttm) FILTER (d >= CAST(ld - INTERVAL 3 YEAR AS DATE)), 0) AS sd,
    coalesce(arg_max(pe_ttm, d) FILTER (d <= {year}), arg_min(pe_ttm, d) FILTER (d >= {year})) AS ref FROM k JOIN l USING (entity) GROUP BY 1)
  SELECT entity, last_date, {rnd('lv')} AS last_value, n_points, {rnd('pf')} AS percentile_full, {rnd('p10')} AS percentile_10y, {rnd('p5')} AS percentile_5y, {rnd('p3')} AS percentile_3y,
    {rnd('CASE WHEN sd > 1e-12 THEN (lv - m) / sd ELSE 0 END')} AS z_score_3y, {rnd('CASE WHEN abs(ref) > 1e-12 THEN (lv - ref) / abs(ref) ELSE 0 END', 4)} AS change_1y, {REGIME.format('p10')} AS regime FROM g"""


def _latest(spark, sf, signed: bool) -> DataFrame:
    df = stats.latest_stats(points(spark, sf), signed=signed)
    ranks = ["last_value", "percentile_full", "percentile_10y", "percentile_5y", "percentile_3y", "z_score_3y"]
    return df.select("entity", "last_date", "n_points", *[r6(c).alias(c) for c in ranks], r6("change_1y", 4).alias("change_1y"), "regime")


@query(_latest_sql(KEY.format("pe_ttm")))
def latest_stats_signed(spark, sf):
    return _latest(spark, sf, True)


@query(_latest_sql("pe_ttm"))
def latest_stats_raw(spark, sf):
    return _latest(spark, sf, False)


MONTHS = "m AS (SELECT DISTINCT entity, last_day(d) AS m FROM s)"


def _months(df: DataFrame) -> DataFrame:
    return df.select("entity", F.last_day("d").alias("m")).distinct()


@query(f"WITH {S}, {MONTHS} SELECT m.entity, m, s.d AS asof_date, s.v FROM m ASOF LEFT JOIN s ON m.entity = s.entity AND m.m >= s.d")
def asof_back(spark, sf):
    df = daily(spark, sf)
    return asof_join(_months(df), df, "entity", "m", "d", ["v"])


@query(f"WITH {S}, {MONTHS} SELECT m.entity, m, s.d AS asof_date, s.v FROM m ASOF LEFT JOIN s ON m.entity = s.entity AND m.m <= s.d")
def asof_forward(spark, sf):
    df = daily(spark, sf)
    return asof_join(_months(df), df, "entity", "m", "d", ["v"], direction="forward")


@query(f"""WITH {S}, {MONTHS}, sun AS (SELECT * FROM s WHERE dayofweek(d) = 0), j AS (SELECT m.entity, m, d, v, row_number() OVER (PARTITION BY m.entity, m ORDER BY abs(d - m), d) AS n
  FROM m LEFT JOIN sun ON m.entity = sun.entity AND abs(d - m) <= 7) SELECT entity, m, d AS asof_date, v FROM j WHERE n = 1""")
def nearest_7d(spark, sf):
    df = daily(spark, sf)
    return asof_join(_months(df), df.where(F.dayofweek("d") == 1), "entity", "m", "d", ["v"], direction="nearest", tolerance_days=7)


@query(f"""WITH {S}, t AS (SELECT DISTINCT entity, CAST(date_trunc('month', d) - INTERVAL 1 DAY AS DATE) AS t FROM s), b AS (SELECT t.entity, t, s.d, s.v FROM t ASOF LEFT JOIN s ON t.entity = s.entity AND t.t >= s.d),
  f AS (SELECT entity, min(d) AS d0, arg_min(v, d) AS v0 FROM s GROUP BY 1) SELECT b.entity, t, coalesce(d, d0) AS asof_date, coalesce(v, v0) AS v FROM b JOIN f USING (entity)""")
def asof_first_fallback(spark, sf):
    df = daily(spark, sf)
    return asof_join(df.select("entity", F.date_sub(F.trunc("d", "month"), 1).alias("t")).distinct(), df, "entity", "t", "d", ["v"], before_first="first")


BACK, AHEAD = "OVER (PARTITION BY entity ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", "OVER (PARTITION BY entity ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


def _bracket_sql(value: str) -> str:
    known = f"CASE WHEN {value} IS NOT NULL THEN d END"
    return f"last_value({known} IGNORE NULLS) {BACK} AS d0, last_value({value} IGNORE NULLS) {BACK} AS v0, first_value({known} IGNORE NULLS) {AHEAD} AS d1, first_value({value} IGNORE NULLS) {AHEAD} AS v1"


LINE = "CASE WHEN d0 IS NULL THEN v1 WHEN d1 IS NULL OR d1 = d0 THEN v0 ELSE v0 + (v1 - v0) * (d - d0) / (d1 - d0) END"


@query(f"WITH {S}, {A}, b AS (SELECT *, {_bracket_sql('anchor')} FROM a) SELECT entity, d, {rnd(LINE)} AS value FROM b")
def interp_linear(spark, sf):
    return timeseries.interpolate(anchored(spark, sf), "entity", "d", "anchor", "x").select("entity", "d", r6("x").alias("value"))


@query(f"WITH {S}, {A} SELECT entity, d, {rnd('last_value(anchor IGNORE NULLS) ' + BACK)} AS value FROM a")
def locf(spark, sf):
    return timeseries.carry_last(anchored(spark, sf), "entity", "d", "anchor", "x").select("entity", "d", r6("x").alias("value"))


@query(f"WITH {S}, {A}, b AS (SELECT *, coalesce(last_value(anchor / price IGNORE NULLS) {BACK}, first_value(anchor / price IGNORE NULLS) {AHEAD}) AS r FROM a) SELECT entity, d, {rnd('coalesce(anchor, r * price)')} AS value FROM b")
def price_carry(spark, sf):
    return timeseries.price_carry(anchored(spark, sf), "entity", "d", "anchor", "price", "x").select("entity", "d", r6("x").alias("value"))


@query(f"WITH {S}, {A}, g AS (SELECT *, ln(anchor / price) AS lg FROM a), b AS (SELECT *, {_bracket_sql('lg')} FROM g) SELECT entity, d, {rnd('exp(' + LINE + ') * price', 5)} AS value FROM b")
def log_bridge(spark, sf):
    return timeseries.log_bridge(anchored(spark, sf), "entity", "d", "anchor", "price", "x").select("entity", "d", r6("x", 5).alias("value"))


@query(f"""WITH RECURSIVE {S}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d) AS i FROM s),
  r AS (SELECT entity, d, i, v AS e FROM n WHERE i = 1 UNION ALL SELECT n.entity, n.d, n.i, r.e + (2.0 / 64) * (n.v - r.e) FROM r JOIN n ON n.entity = r.entity AND n.i = r.i + 1) SELECT entity, d, {rnd('e', 4)} AS ema FROM r""")
def ema63(spark, sf):
    return windows.ema(daily(spark, sf), "entity", "d", "v", 63, "e").select("entity", "d", r6("e", 4).alias("ema"))


@query(f"""WITH {Q}, g AS (SELECT *, CASE WHEN d - lag(d) OVER w BETWEEN 40 AND 140 THEN 1 ELSE 0 END AS ok FROM q WINDOW w AS (PARTITION BY entity ORDER BY d))
  SELECT entity, d, CASE WHEN count(qty) OVER f = 4 AND sum(ok) OVER h = 3 THEN CAST(sum(qty) OVER f AS DOUBLE) END AS trailing FROM g
  WINDOW f AS (PARTITION BY entity ORDER BY d ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), h AS (PARTITION BY entity ORDER BY d ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""")
def ttm_rolling4(spark, sf):
    return timeseries.trailing_sum(quarters(spark, sf), "entity", "d", "qty", "trailing").select("entity", "d", F.col("trailing").cast("double").alias("trailing"))


@query(f"WITH {Q}, g AS (SELECT *, CAST(lag(qty, 4) OVER (PARTITION BY entity ORDER BY d) AS DOUBLE) AS b FROM q) SELECT entity, d, CASE WHEN b > 0 AND abs(qty / b - 1) <= 20 THEN {rnd('qty / b - 1')} END AS growth FROM g")
def growth_lag4(spark, sf):
    return timeseries.yearly_growth(quarters(spark, sf), "entity", "d", "qty", "g").select("entity", "d", r6("g").alias("growth"))


@query(f"WITH {Q}, g AS (SELECT *, d - lag(d) OVER (PARTITION BY entity ORDER BY d) AS gap FROM q) SELECT entity, count(*) AS n_rows, CAST(median(gap) AS DOUBLE) AS median_gap, count(*) < 3 OR median(gap) >= 120 AS coarse FROM g GROUP BY 1")
def coarse_gap(spark, sf):
    return timeseries.median_gap(quarters(spark, sf), "entity", "d")


@query(f"WITH {S}, m AS (SELECT entity, median(v) AS med FROM s GROUP BY 1) SELECT entity, {rnd('any_value(med)')} AS median_ratio, {rnd('median(abs(ln(v) - ln(med)))')} AS log_mad FROM s JOIN m USING (entity) GROUP BY 1")
def median_mad(spark, sf):
    return timeseries.median_and_spread(daily(spark, sf), "entity", "v").select("entity", r6("median_ratio").alias("median_ratio"), r6("log_mad").alias("log_mad"))


TWO = "x AS (SELECT entity, d, v AS a FROM s WHERE day(d) % 2 = 0 AND d < DATE '2001-04-01'), y AS (SELECT entity, d, v * 2 AS a FROM s WHERE month(d) <> 5)"


def _two(spark, sf):
    df = daily(spark, sf)
    early = (F.dayofmonth("d") % 2 == 0) & (F.col("d") < "2001-04-01")
    return df.where(early).withColumnRenamed("v", "a"), df.where(F.month("d") != 5).select("entity", "d", (F.col("v") * 2).alias("a"))


@query(f"WITH {S}, {TWO} SELECT entity, d, a FROM x UNION ALL SELECT entity, d, a FROM y ANTI JOIN x USING (entity, d)")
def priority_union(spark, sf):
    return merge.priority_union(list(_two(spark, sf)), ["entity", "d"])


@query(f"WITH {S}, {TWO}, l AS (SELECT entity, max(d) AS m FROM y GROUP BY 1), o AS (SELECT x.* FROM x JOIN l USING (entity) WHERE d >= m - 365) SELECT entity, d, a FROM o UNION ALL SELECT entity, d, a FROM y ANTI JOIN o USING (entity, d)")
def recent_override(spark, sf):
    x, y = _two(spark, sf)
    return merge.recent_override(y, x, "entity", "d", 365)


@query(f"WITH {S}, {TWO} SELECT entity, d, coalesce(x.a, y.a) AS a FROM x FULL JOIN y USING (entity, d)")
def upsert_latest(spark, sf):
    x, y = _two(spark, sf)
    return merge.upsert(y, x, ["entity", "d"], ["a"])


@query(f"WITH {S}, {TWO} SELECT entity, d, a FROM x UNION ALL SELECT entity, d, a FROM y ANTI JOIN x USING (entity, d) WHERE (entity, d) IN (SELECT entity, d FROM s WHERE year(d) = 1997)")
def preserve_recorded(spark, sf):
    x, y = _two(spark, sf)
    return merge.preserve_recorded(x, y, daily(spark, sf).where(F.year("d") == 1997), ["entity", "d"])


@query(f"WITH {S}, {TWO} SELECT x.entity, x.d, coalesce(floor(y.a * 1e1 + 0.5) / 1e1, x.a) AS a FROM x LEFT JOIN y USING (entity, d)")
def override_on_date(spark, sf):
    x, y = _two(spark, sf)
    return merge.override_on_date(x, y, ["entity", "d"], {"a": 1})


@query("SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi_watchlist(spark, sf):
    urgent = load(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf, "customer").join(urgent, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def anti_missing(spark, sf):
    seen = load(spark, sf, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return load(spark, sf, "customer").join(seen, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("SELECT n_nationkey, n_name, n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal < -900) AS checked FROM nation")
def mark_join(spark, sf):
    low = load(spark, sf, "customer").where("c_acctbal < -900").select(F.col("c_nationkey").alias("n_nationkey"), F.lit(True).alias("hit")).distinct()
    return load(spark, sf, "nation").join(low, "n_nationkey", "left").select("n_nationkey", "n_name", F.coalesce("hit", F.lit(False)).alias("checked"))


@query("SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 100")
def topk_companies(spark, sf):
    return load(spark, sf, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(100).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_name, s_suppkey) AS place FROM supplier")
def multi_sort(spark, sf):
    w = W.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_name", "s_suppkey")
    return load(spark, sf, "supplier").select("s_suppkey", F.row_number().over(w).cast("long").alias("place"))


@query(f"WITH {DIM} SELECT entity, CAST(CASE entity WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 999 END AS BIGINT) AS attention FROM dim")
def attention_order(spark, sf):
    return stats.attention_order(dim(spark, sf).select("entity"), ["MACHINERY", "BUILDING"])


@query(f"""WITH {S}, t AS (SELECT max(f) AS t FROM (SELECT min(d) AS f FROM s GROUP BY entity)), c AS (SELECT s.* FROM s, t WHERE d >= t)
  SELECT entity, d, v, {rnd("v / first_value(v) OVER (PARTITION BY entity ORDER BY d) * 100")} AS rebased FROM c""")
def compare_aligned(spark, sf):
    return stats.compare_aligned(daily(spark, sf), "v").withColumn("rebased", r6("rebased"))


@query(f"WITH {S} SELECT entity, coalesce(max(d) FILTER (d <= DATE '1998-03-15'), min(d)) AS at, coalesce(arg_max(v, d) FILTER (d <= DATE '1998-03-15'), arg_min(v, d)) AS value FROM s GROUP BY 1")
def compare_cross_section(spark, sf):
    return stats.cross_section(daily(spark, sf), "v", "1998-03-15")


@query(f"""WITH {S}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM s), g AS (SELECT entity, min(v) AS lo, max(v) AS hi FROM n
  WHERE i BETWEEN floor((n - 1) * 20 / 100.0) AND floor((n - 1) * 80 / 100.0) GROUP BY 1) SELECT entity, {rnd('lo - (hi - lo) * 0.08')} AS y_min, {rnd('hi + (hi - lo) * 0.08')} AS y_max FROM g""")
def y_range(spark, sf):
    return stats.y_range(daily(spark, sf), "v", 20, 80).select("entity", r6("y_min").alias("y_min"), r6("y_max").alias("y_max"))


@query(f"""WITH {S}, n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d) - 1 AS i, count(*) OVER (PARTITION BY entity) AS n FROM s)
  SELECT entity, d, v FROM n WHERE n <= 120 OR i = 0 OR (i * 119) // (n - 1) > ((i - 1) * 119) // (n - 1)""")
def downsample(spark, sf):
    return stats.downsample(daily(spark, sf), 120)


@query(f"WITH {S}, m AS (SELECT *, d >= CAST(max(d) OVER (PARTITION BY entity) - INTERVAL 2 YEAR AS DATE) AS k FROM s), c AS (SELECT *, count(*) FILTER (k) OVER (PARTITION BY entity) AS n FROM m) SELECT entity, d, v FROM c WHERE n < 60 OR k")
def range_two_years(spark, sf):
    return stats.range_filter(daily(spark, sf), 2)


DIR = "CASE WHEN {0} >= 0.85 THEN 'high' WHEN {0} <= 0.15 THEN 'low' ELSE 'neutral' END"
CROSS = f"""r AS (SELECT entity, d, {RANK.format('v', FRAME.format(251))} AS p FROM s), x AS (SELECT *, lag(p) OVER (PARTITION BY entity ORDER BY d) AS prev FROM r),
  c AS (SELECT entity, d, p, {DIR.format('p')} AS direction, CASE WHEN p >= 0.95 OR p <= 0.05 THEN 'P1' ELSE 'P2' END AS severity FROM x WHERE prev IS NOT NULL AND {DIR.format('p')} <> 'neutral' AND {DIR.format('p')} <> {DIR.format('prev')})"""


def _crossed(spark, sf) -> DataFrame:
    df = daily(spark, sf)
    ranked = windows.framed_ranks(df, "entity", "d", "v", {"p": 252}).select("entity", "d", "p")
    return al.crossings(ranked, "p").select("entity", "d", "p", "direction", "severity")


@query(f"WITH {S}, {CROSS} SELECT entity, d, {rnd('p')} AS p, direction, severity FROM c")
def crossings(spark, sf):
    return _crossed(spark, sf).withColumn("p", r6("p"))


@query(f"""WITH RECURSIVE {S}, {CROSS}, n AS (SELECT d, row_number() OVER (ORDER BY d) AS no FROM (SELECT DISTINCT d FROM s)), k AS (SELECT c.*, no FROM c JOIN n USING (d)),
  f AS (SELECT entity, min(no) AS no FROM k GROUP BY 1 UNION ALL SELECT f.entity, (SELECT min(k.no) FROM k WHERE k.entity = f.entity AND k.no >= f.no + 20) AS no FROM f WHERE f.no IS NOT NULL)
  SELECT k.entity, k.d, k.direction, k.severity FROM k JOIN f ON k.entity = f.entity AND k.no = f.no""")
def cooldown_alerts(spark, sf):
    crossed = _crossed(spark, sf).join(al.trading_days(daily(spark, sf)), "d")
    return al.with_cooldown(crossed, 20).select("entity", "d", "direction", "severity")


def _watchers(spark, sf) -> DataFrame:
    return dim(spark, sf).select(F.concat(F.lit("u"), (F.col("position") % 3).cast("string")).alias("user_id"), "entity")


@query(f"WITH {S}, {CROSS} SELECT 'u' || (i % 3) AS user_id, least(count(*), 500) AS n_alerts, least(count(*), 500) AS n_unread FROM c JOIN (SELECT c_mktsegment AS entity, row_number() OVER (ORDER BY c_mktsegment) AS i FROM (SELECT DISTINCT c_mktsegment FROM customer)) USING (entity) GROUP BY 1")
def alert_counts(spark, sf):
    return al.alert_counts(al.alert_rows(_crossed(spark, sf), _watchers(spark, sf), "p"))


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(concat_ws(' ', p_name, p_brand, p_type)), 'widget')")
def keyword_search(spark, sf):
    return load(spark, sf, "part").where(ft.keyword_matches("WIDGET", F.col("p_name"), F.col("p_brand"), F.col("p_type"))).select("p_partkey", "p_name")


@query("""SELECT s_suppkey, regexp_replace(replace(lower(s_name), '&amp;', '&'), '[^a-z0-9&]+', '', 'g') AS lookup, regexp_replace(upper(trim(s_name)), '[^A-Z0-9]', '', 'g') AS ticker,
  'company_' || regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS company, regexp_matches(s_name, '^[A-Z][A-Z0-9-]{0,9}$') AS us, CAST(length(s_name) AS BIGINT) AS width FROM supplier""")
def name_keys(spark, sf):
    c = F.col("s_name")
    return load(spark, sf, "supplier").select("s_suppkey", ft.lookup_key(c).alias("lookup"), ft.ticker_key(c).alias("ticker"), ft.company_id(c).alias("company"), ft.is_us_symbol(c).alias("us"), ft.visual_length(c).alias("width"))


@query(r"""SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '<[^>]*>', ' ', 'g'),
  '&amp;', '&'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&#x2F;', '/'), '&nbsp;', ' '), '[ \t\r\n]+', ' ', 'g')) AS body FROM pages""")
def html_strip(spark, sf):
    return load(spark, sf, "pages").select("page_id", ft.strip_html(F.col("html")).alias("body"))


@query(r"""SELECT page_id, CAST(len(l) AS BIGINT) AS n_links, CAST(len(list_distinct(l)) AS BIGINT) AS n_distinct FROM (SELECT page_id, regexp_extract_all(html, '(?i)href="([^"]*)"', 1) AS l FROM pages)""")
def html_links(spark, sf):
    df = load(spark, sf, "pages").select("page_id", parse.links(F.col("html")).alias("l"))
    return df.select("page_id", F.size("l").cast("long").alias("n_links"), F.size(F.array_distinct("l")).cast("long").alias("n_distinct"))


PAYLOADS = """g AS (SELECT page_id, CASE page_id % 8 WHEN 0 THEN '  ' WHEN 1 THEN NULL WHEN 2 THEN 'You exceeded the DAILY hits limit' WHEN 3 THEN html || 'Just a moment' WHEN 4 THEN html || 'Just a moment <cf-chl>'
  WHEN 5 THEN '<title>Just a moment...' WHEN 6 THEN 'captcha, forbidden' ELSE html END AS body FROM pages)"""


@query(f"""WITH {PAYLOADS}, t AS (SELECT page_id, lower(trim(coalesce(body, ''))) AS t FROM g) SELECT page_id, t = '' OR contains(t, 'exceeded the daily hits limit') OR contains(t, 'too many requests')
  OR contains(t, 'sad-panda-201402200631.png') OR contains(t, 'no longer be accessible from mainland china') OR contains(t, 'enable javascript and cookies to continue') OR contains(t, '<title>just a moment')
  OR (contains(t, 'just a moment') AND contains(t, 'cf-chl')) AS rejected FROM t""")
def reject_payload(spark, sf):
    html, k = F.col("html"), F.col("page_id") % 8
    # Every kind of page that is told apart, made from the pages at hand.
    body = F.when(k == 0, "  ").when(k == 1, F.lit(None)).when(k == 2, "You exceeded the DAILY hits limit").when(k == 3, F.concat(html, F.lit("Just a moment")))
    body = body.when(k == 4, F.concat(html, F.lit("Just a moment <cf-chl>"))).when(k == 5, "<title>Just a moment...").when(k == 6, "captcha, forbidden").otherwise(html)
    return load(spark, sf, "pages").select("page_id", ft.is_rejected_payload(body).alias("rejected"))


@query("SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM events GROUP BY 1")
def json_pick(spark, sf):
    k = parse.first_path(F.col("props"), "$.missing", "$.k").cast("long")
    return load(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("total"), F.count(F.lit(1)).alias("n"))


@query("""SELECT o_orderkey, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter_key, last_day(CAST(o_orderdate AS DATE)) AS month_end,
  CASE WHEN month(o_orderdate) = 2 AND day(o_orderdate) = 29 THEN make_date(year(o_orderdate) - 3, 3, 1) ELSE CAST(CAST(o_orderdate AS DATE) - INTERVAL 3 YEAR AS DATE) END AS three_years,
  CAST(len(list_filter(generate_series(CAST(o_orderdate AS DATE) + 1, CAST(o_orderdate AS DATE) + 9, INTERVAL 1 DAY), lambda x: dayofweek(x) NOT IN (0, 6))) AS BIGINT) AS weekdays FROM orders""")
def date_functions(spark, sf):
    d = F.to_date("o_orderdate")
    return load(spark, sf, "orders").select(
        "o_orderkey", fd.quarter_key(d).alias("quarter_key"), fd.month_end(d).alias("month_end"), fd.subtract_years(d, 3).alias("three_years"), F.size(fd.weekdays_between(d, F.date_add(d, 10))).cast("long").alias("weekdays")
    )


@query("SELECT o_orderkey, try_strptime(t, '%m/%d/%Y')::DATE AS d FROM (SELECT o_orderkey, strftime(o_orderdate, '%m/%d/%Y') AS t FROM orders)")
def date_parse(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", fd.text_date(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("d"))


@query("""SELECT l_orderkey, l_linenumber, floor(l_extendedprice * -0.01 * 1e2 + 0.5) / 1e2 AS half_up, least(greatest(l_discount, 0.02), 0.06) AS clamped,
  CASE WHEN abs(l_extendedprice / 1000) BETWEEN 2 AND 50 THEN floor(l_extendedprice / 1000 * 1e4 + 0.5) / 1e4 END AS ratio FROM lineitem""")
def number_hygiene(spark, sf):
    price = F.col("l_extendedprice")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", fn.round_half_up(price * -0.01, 2).alias("half_up"), fn.clamp(F.col("l_discount"), 0.02, 0.06).alias("clamped"), fn.sanitize_ratio(price / 1000, 2, 50).alias("ratio"))


FAULTS = """f AS (SELECT CASE WHEN v < 20000 THEN 'GHOST' ELSE entity END AS entity, CASE WHEN day(d) = 13 THEN NULL ELSE d END AS d, CASE WHEN month(d) = 7 AND day(d) = 4 THEN NULL ELSE v END AS v, printf('%04d-%02d-%02d-%s', year(d), day(d), month(d), entity) AS seq FROM s)"""


@query(f"""WITH {S}, {FAULTS}, b AS (SELECT *, d < lag(d) OVER (PARTITION BY entity ORDER BY seq) AS back FROM f), c AS (SELECT entity, 'unknown_id' AS rule, count(*) FILTER (entity = 'GHOST') AS n FROM b GROUP BY 1
  UNION ALL SELECT entity, 'missing_date', count(*) FILTER (d IS NULL) FROM b GROUP BY 1 UNION ALL SELECT entity, 'descending_date', count(*) FILTER (back) FROM b GROUP BY 1
  UNION ALL SELECT entity, 'not_finite_v', count(*) FILTER (v IS NULL) FROM b GROUP BY 1) SELECT * FROM c WHERE n > 0""")
def dq_validate(spark, sf):
    df = daily(spark, sf)
    # The faults are a fixture, rows that arrive by day of the month within a year among them.
    seq = F.format_string("%04d-%02d-%02d-%s", F.year("d"), F.dayofmonth("d"), F.month("d"), "entity")
    bad = df.select(
        F.when(F.col("v") < 20000, "GHOST").otherwise(F.col("entity")).alias("entity"),
        F.when(F.dayofmonth("d") != 13, F.col("d")).alias("d"),
        F.when(~((F.month("d") == 7) & (F.dayofmonth("d") == 4)), F.col("v")).alias("v"),
        seq.alias("seq"),
    )
    return quality.violations(bad, dim(spark, sf), ["v"])


@query(f"WITH {S}, r AS (SELECT *, lag(d) OVER w AS pd, lag(v) OVER w AS pv FROM s WINDOW w AS (PARTITION BY entity ORDER BY d)) SELECT entity, d, CASE WHEN d - pd <= 4 THEN {rnd('v / pv - 1')} END AS r FROM r")
def daily_returns(spark, sf):
    return daily(spark, sf).select("entity", "d", r6(windows.daily_return("v", "entity", "d")).alias("r"))


@query(f"WITH {S} SELECT entity, CAST(len(list(v)) AS BIGINT) AS n_rows, min(d) AS first_date, max(d) AS last_date FROM s GROUP BY 1")
def nested_store(spark, sf):
    rows = sinks.nested_store(daily(spark, sf), "entity", "d")
    return rows.select("entity", F.size("rows").cast("long").alias("n_rows"), F.get("rows", F.lit(0))["d"].alias("first_date"), F.element_at("rows", -1)["d"].alias("last_date"))


@query(f"WITH {S} SELECT entity, count(*) AS n FROM s WHERE entity <> 'BUILDING' GROUP BY 1")
def series_sink_roundtrip(spark, sf):
    path = f"{checkpoint_path(spark)}/series-{uuid4().hex}"
    sinks.write_series(daily(spark, sf).where("entity <> 'BUILDING'"), path)
    return spark.read.parquet(path).groupBy("entity").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {S}, w AS (SELECT *, lead(d) OVER (PARTITION BY entity ORDER BY d) AS nd, lead(v) OVER (PARTITION BY entity ORDER BY d) AS nv FROM s), g AS (SELECT entity, v, nv, list_filter(list_transform(generate_series(d + 1, nd - 1, INTERVAL 1 DAY), lambda x: CAST(x AS DATE)), lambda x: dayofweek(x) NOT IN (0, 6)) AS days FROM w WHERE nd - d > 4),
  e AS (SELECT entity, v, nv, len(days) AS n, unnest(days) AS d, generate_subscripts(days, 1) AS i FROM g)
  SELECT entity, d, v, false AS filled FROM (SELECT entity, d, {rnd('v', 3)} AS v FROM s) UNION ALL SELECT entity, d, {rnd('v * pow(nv / v, i / (n + 1.0::DOUBLE))', 3)}, true FROM e""")
def densify(spark, sf):
    return timeseries.fill_weekdays(daily(spark, sf), "entity", "d", "v").withColumn("v", r6("v", 3))


@query(f"""WITH {S}, w AS (SELECT *, lead(d) OVER o AS nd, lead(v) OVER o AS nv, row_number() OVER (PARTITION BY entity ORDER BY d) AS no FROM s WINDOW o AS (PARTITION BY entity ORDER BY d)), r AS (SELECT *, nd - d AS gap FROM w),
  t AS (SELECT entity, ln(1 + least(greatest(nv / v - 1, -0.35), 0.35)) AS lg, row_number() OVER (PARTITION BY entity ORDER BY d DESC) AS back, count(*) OVER (PARTITION BY entity) AS every FROM r WHERE gap <= 4 AND v > 0 AND nv > 0 AND nv / v - 1 > -0.95 AND nv / v - 1 < 2.5),
  m AS (SELECT entity, lg, least(every, 252) - back AS place, least(every, 252) AS size FROM t WHERE back <= 252),
  g AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d) - 1 AS k FROM (SELECT entity, d, v, nd, nv, list_filter(list_transform(generate_series(d + 1, nd - 1, INTERVAL 1 DAY), lambda x: CAST(x AS DATE)), lambda x: dayofweek(x) NOT IN (0, 6)) AS days FROM r WHERE gap > 4) WHERE len(days) > 0),
  p AS (SELECT entity, k, v, nv, len(days) AS n, unnest(list_append(days, nd)) AS day, generate_subscripts(list_append(days, nd), 1) - 1 AS i FROM g), q AS (SELECT p.*, lg FROM p JOIN (SELECT DISTINCT entity, size FROM m) z USING (entity) JOIN m ON m.entity = p.entity AND m.place = (k * 17 + i) % z.size),
  x AS (SELECT *, ln(greatest(nv / v, 1e-9)) AS target, (ln(greatest(nv / v, 1e-9)) - sum(lg) OVER (PARTITION BY entity, k)) / (n + 1) AS drift FROM q), y AS (SELECT *, CASE WHEN abs(drift) < 1.6 THEN least(greatest(lg + drift, -1.5), 1.5) ELSE target / (n + 1) END AS step FROM x)
  SELECT entity, d, {rnd('v', 3)} AS v, false AS filled FROM s UNION ALL SELECT entity, day, {rnd('path', 3)}, true FROM (SELECT entity, day, i, n, greatest(v * exp(sum(step) OVER (PARTITION BY entity, k ORDER BY i)), 1e-8) AS path FROM y) WHERE i < n""")
def densify_recent(spark, sf):
    return timeseries.fill_like_recent(daily(spark, sf), "entity", "d", "v").withColumn("v", r6("v", 3))


def _spikes_sql(passes: int = 4) -> str:
    """Pass by pass, row by row: each row is held against the last one kept and the next one of the list."""
    apart = lambda a, b: f"greatest(abs({a} / {b}), abs({b} / {a}))"
    steps = [f"{S}, l0 AS MATERIALIZED (SELECT entity, d, v, row_number() OVER (PARTITION BY entity ORDER BY d) AS no FROM s WHERE abs(v) >= 1e-8)"]
    for k in range(passes):
        jump = f"least({apart('n.v', 'f.kv')}, {apart('n.v', 'n.nv')})"
        wide = "greatest(n.d - f.kd, n.nd - n.d)"
        calm = f"{wide} <= 40 AND least(abs(f.kv), abs(n.v), abs(n.nv)) >= 4 AND f.kv * n.nv > 0 AND {apart('f.kv', 'n.nv')} <= 1.35"
        spike = f"n.nd IS NOT NULL AND {calm} AND ({jump} >= 1.9 OR ({jump} >= 1.34 AND {wide} <= 5 AND (n.v > greatest(f.kv, n.nv) OR n.v < least(f.kv, n.nv))))"
        steps.append(f"n{k} AS MATERIALIZED (SELECT *, lead(d) OVER o AS nd, lead(v) OVER o AS nv FROM l{k} WINDOW o AS (PARTITION BY entity ORDER BY no))")
        steps.append(f"f{k} AS (SELECT entity, no, d, v, d AS kd, v AS kv, false AS spike FROM n{k} WHERE no = 1 UNION ALL SELECT entity, no, d, v, CASE WHEN x THEN kd ELSE d END, CASE WHEN x THEN kv ELSE v END, x FROM (SELECT n.entity, n.no, n.d, n.v, f.kd, f.kv, coalesce({spike}, false) AS x FROM f{k} f JOIN n{k} n ON n.entity = f.entity AND n.no = f.no + 1))")
        steps.append(f"l{k + 1} AS MATERIALIZED (SELECT entity, d, v, row_number() OVER (PARTITION BY entity ORDER BY d) AS no FROM f{k} WHERE NOT spike)")
    return f"WITH RECURSIVE {', '.join(steps)} SELECT s.entity, s.d, l{passes}.v FROM s LEFT JOIN l{passes} ON l{passes}.entity = s.entity AND l{passes}.d = s.d"


@query(_spikes_sql())
def spike_clean(spark, sf):
    return timeseries.drop_spikes(daily(spark, sf), "entity", "d", "v")


@query(f"""WITH RECURSIVE {S}, n AS MATERIALIZED (SELECT *, round(v / 1000) * 1000 AS price, row_number() OVER (PARTITION BY entity ORDER BY d) AS no FROM s),
  f AS (SELECT entity, no, d, v, price, v AS lv, price AS lp, price > 0 AS ok FROM n WHERE no = 1 UNION ALL SELECT entity, no, d, v, price, CASE WHEN x THEN v ELSE lv END, CASE WHEN x THEN price ELSE lp END, x FROM (SELECT n.*, f.lv, f.lp, n.price > 0 AND abs(n.v / (f.lv * n.price / f.lp) - 1) > 0.01 AS x FROM f JOIN n ON n.entity = f.entity AND n.no = f.no + 1))
  SELECT entity, d, v, price FROM f WHERE ok""")
def accept_reject(spark, sf):
    df = daily(spark, sf).withColumn("price", F.round(F.col("v") / 1000) * 1000)
    return timeseries.accept_snapshots(df, "entity", "d", "v", "price")


@query(f"""WITH RECURSIVE {P}, n AS MATERIALIZED (SELECT entity, d, v, CAST(us10y_yield AS DOUBLE) AS r, row_number() OVER (PARTITION BY entity ORDER BY d) AS no FROM p),
  f AS (SELECT entity, no, d, v, r, v AS mean, r AS base, 1.0::DOUBLE AS lev FROM n WHERE no = 1 UNION ALL SELECT entity, no, d, v, r, mean, base, lev + 0.1 * (least(greatest(exp(ln(v / mean) - 4 * (r - base)), 0.35), 3) - lev)
    FROM (SELECT n.*, f.mean + 2.0::DOUBLE / 253 * (n.v - f.mean) AS mean, f.base + 2.0::DOUBLE / 253 * (n.r - f.base) AS base, f.lev FROM f JOIN n ON n.entity = f.entity AND n.no = f.no + 1)),
  l AS (SELECT entity, arg_max(lev, no) AS last FROM f GROUP BY 1) SELECT entity, d, v, {rnd('r', 4)} AS us10y_yield, {rnd('lev * 21.5 / last', 4)} AS pe_proxy FROM f JOIN l USING (entity)""")
def proxy_series(spark, sf):
    df = points(spark, sf).select("entity", "d", "v", r6("us10y_yield", 4).alias("us10y_yield"))
    return timeseries.proxy_series(df, "entity", "d", "v", "us10y_yield", 21.5, "pe_proxy").withColumn("pe_proxy", r6("pe_proxy", 4))


@query(f"WITH {S} SELECT entity, count(v) AS n, {rnd('avg(v)', 4)} AS mean, {rnd('coalesce(stddev_samp(v), 0)', 4)} AS deviation, {rnd('median(v)', 4)} AS median, min(v) AS lowest, max(v) AS highest FROM s GROUP BY 1")
def basic_stats(spark, sf):
    df = qt.basic_stats(daily(spark, sf), "entity", "v")
    return df.select("entity", "n", *[r6(c, 4).alias(c) for c in ("mean", "deviation", "median")], "lowest", "highest")


KINDS = "r AS (SELECT entity, d, v, CASE WHEN day(d) % 3 = 0 THEN 'actual' ELSE 'expected' END AS kind FROM s)"


def _kinds(spark, sf) -> DataFrame:
    return daily(spark, sf).withColumn("kind", F.when(F.dayofmonth("d") % 3 == 0, "actual").otherwise("expected"))


@query(f"""WITH {S}, {KINDS} SELECT entity, year(d) || '-Q' || quarter(d) AS quarter, d, v, kind FROM r
  QUALIFY row_number() OVER (PARTITION BY entity, year(d), quarter(d) ORDER BY CASE WHEN kind = 'actual' THEN 0 ELSE 1 END, d) = 1""")
def quarter_dedup(spark, sf):
    return qt.one_per_quarter(_kinds(spark, sf))


@query(f"""WITH {Q}, a AS (SELECT * FROM q WHERE year(d) >= 1997), b AS (SELECT entity, d, qty * 4.1 AS qty FROM q WHERE year(d) <= 1999),
  f AS (SELECT entity, CASE WHEN abs(median(b.qty / a.qty) / 4 - 1) <= 0.22 THEN 4.0::DOUBLE ELSE median(b.qty / a.qty)::DOUBLE END AS factor FROM a JOIN b USING (entity, d) GROUP BY 1)
  SELECT entity, year(d) || '-Q' || quarter(d) AS quarter, d, {rnd('coalesce(a.qty::DOUBLE, b.qty / factor)', 4)} AS qty, factor FROM a FULL JOIN b USING (entity, d) JOIN f USING (entity)""")
def quarterly_merge(spark, sf):
    df = quarters(spark, sf)
    a, b = df.where(F.year("d") >= 1997), df.where(F.year("d") <= 1999).withColumn("qty", F.col("qty") * 4.1)
    return qt.merge_rescaled(a, b, "qty", [0.25, 0.5, 1.0, 2.0, 4.0]).withColumn("qty", r6("qty", 4))


@query(f"""WITH {Q}, a AS (SELECT * FROM q WHERE d < DATE '1999-01-15'), x AS (SELECT * FROM q WHERE d >= DATE '1998-06-01'), l AS (SELECT entity, max(d) AS last FROM a GROUP BY 1),
  n AS (SELECT x.* FROM x JOIN l USING (entity) WHERE d - last >= 45 AND d - DATE '1999-01-15' <= 125 QUALIFY row_number() OVER (PARTITION BY entity ORDER BY d) = 1)
  SELECT *, 'actual' AS kind FROM a UNION ALL SELECT *, 'expected' FROM n""")
def expected_quarter(spark, sf):
    df = quarters(spark, sf)
    return qt.with_expected(df.where("d < DATE '1999-01-15'"), df.where("d >= DATE '1998-06-01'"), F.lit("1999-01-15").cast("date"))


@query("""WITH r AS (SELECT o_custkey, CAST(substr(o_orderpriority, 1, 1) AS INT) AS p, max(CASE WHEN o_totalprice > 200000 THEN o_totalprice END) AS a, max(CASE WHEN o_totalprice < 100000 THEN o_totalprice END) AS b FROM orders GROUP BY 1, 2),
  x AS (SELECT o_custkey, arg_min(a, p) AS a, min(p) FILTER (a IS NOT NULL) AS pa, arg_min(b, p) AS b, min(p) FILTER (b IS NOT NULL) AS pb FROM r GROUP BY 1)
  SELECT o_custkey, a, b, concat_ws('+', 'a:' || pa, 'b:' || pb) AS provenance FROM x""")
def metric_priority(spark, sf):
    price = F.col("o_totalprice")
    rows = load(spark, sf, "orders").groupBy("o_custkey", F.substring("o_orderpriority", 1, 1).cast("int").alias("p"))
    rows = rows.agg(F.max(F.when(price > 200000, price)).alias("a"), F.max(F.when(price < 100000, price)).alias("b"))
    return qt.first_by_priority(rows, ["o_custkey"], ["a", "b"], "p")


@query(f"""WITH {S}, r AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d DESC) AS n FROM s), m AS (SELECT entity, median(v) FILTER (n <= 8) AS m, max(v) FILTER (n = 1) AS l FROM r GROUP BY 1)
  SELECT entity, {rnd('greatest(m / l, l / m)')} AS mismatch FROM m""")
def basis_mismatch(spark, sf):
    df = daily(spark, sf)
    latest = stats.latest_row(df).select("entity", F.col("v").alias("latest"))
    return qt.basis_mismatch(df, latest, "v").withColumn("mismatch", r6("mismatch"))


@query("""WITH k(name, word) AS (VALUES ('ring', 'ring'), ('bolt', 'BOLT'), ('none', 'zzz')) SELECT name, p_partkey, p_name FROM part JOIN k ON contains(lower(p_name), lower(word)) QUALIFY row_number() OVER (PARTITION BY name ORDER BY p_partkey) = 1""")
def keyword_first_row(spark, sf):
    rows = load(spark, sf, "part").select("p_partkey", "p_name")
    return qt.keyword_rows(rows, "p_name", {"ring": "ring", "bolt": "BOLT", "none": "zzz"}, "p_partkey")


@query(f"""WITH {S}, {CROSS}, u AS (SELECT 'u' || (i % 3) AS user_id, c.* FROM c JOIN (SELECT c_mktsegment AS entity, row_number() OVER (ORDER BY c_mktsegment) AS i FROM (SELECT DISTINCT c_mktsegment FROM customer)) USING (entity)),
  n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d DESC, sha256(user_id || '|' || entity || '|' || d || '|' || direction)) AS n FROM u) SELECT user_id, entity, d, direction, severity FROM n WHERE n <= 20""")
def newest_alerts(spark, sf):
    """The newest 20 of each user."""
    return al.alert_rows(_crossed(spark, sf), _watchers(spark, sf), "p", most=20).select("user_id", "entity", "d", "direction", "severity")


@query(f"WITH {S}, m AS (SELECT entity, d, v, count(*) OVER (PARTITION BY entity) AS n FROM s) SELECT entity, CAST(count(DISTINCT d) AS BIGINT) AS n_points FROM m GROUP BY 1 HAVING count(DISTINCT d) >= 24")
def usable_history(spark, sf):
    return quality.usable_history(daily(spark, sf), 24)


@query(f"""WITH {S}, c AS (SELECT entity, max(d) - 365 AS cut FROM s GROUP BY 1), j AS (SELECT entity, d, v, cut, CASE WHEN day(d) = 10 THEN 2.5 WHEN day(d) = 11 THEN -3 WHEN d >= cut AND d < cut + 5 THEN 1 ELSE v / 5000 * CASE WHEN d < cut THEN 0.2 + length(entity) / 20.0::DOUBLE ELSE 1 END END::DOUBLE AS pe FROM s JOIN c USING (entity)),
  a AS (SELECT entity, min(d) AS ad, arg_min(pe, d) AS av, arg_min(v, d) AS ac FROM j WHERE pe >= 4 AND v > 0 AND d >= cut GROUP BY 1), o AS (SELECT entity, any_value(ad) AS ad, any_value(av) / (arg_max(pe, d) * (any_value(ac) / arg_max(v, d))) AS f FROM j JOIN a USING (entity) WHERE pe >= 4 AND v > 0 AND d < ad GROUP BY 1)
  SELECT entity, d, {rnd(f"CASE WHEN d < ad AND greatest(f, 1 / f) BETWEEN 1.15 AND 4 THEN {rnd('pe * f', 4)} ELSE pe END")} AS pe FROM j LEFT JOIN o USING (entity)""")
def rebase_cutover(spark, sf):
    """History before a change of basis, with values under 4 and below zero, is brought onto the level after it; the first days after it are unusable."""
    df = daily(spark, sf)
    cuts = df.groupBy("entity").agg(F.date_sub(F.max("d"), 365).alias("cut"))
    df = df.join(cuts, "entity")
    early = F.when(F.col("d") < F.col("cut"), 0.2 + F.length("entity") / 20).otherwise(1.0)
    pe = F.when(F.dayofmonth("d") == 10, 2.5).when(F.dayofmonth("d") == 11, -3.0).when(F.datediff("d", "cut").between(0, 4), 1.0).otherwise(F.col("v") / 5000 * early)
    df = df.select("entity", "d", "v", pe.alias("pe"))
    return timeseries.rebase_history(df, cuts, "entity", "d", "pe", "v").select("entity", "d", r6("pe").alias("pe"))


@query(f"WITH {S} SELECT max(d)::VARCHAR AS last_date, count(*) AS n_points FROM s")
def build_summary(spark, sf):
    return sinks.build_summary(daily(spark, sf))


ROWS = """b AS (SELECT c_custkey AS entity, c_name AS name, CASE WHEN c_nationkey < 13 THEN 'core' ELSE 'sector' END AS "group", cume_dist() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal) AS percentile, c_acctbal AS value FROM customer)"""


def _board(spark, sf) -> DataFrame:
    share = F.cume_dist().over(W.partitionBy("c_nationkey").orderBy("c_acctbal"))
    group = F.when(F.col("c_nationkey") < 13, "core").otherwise("sector")
    return load(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_name").alias("name"), group.alias("group"), share.alias("percentile"), F.col("c_acctbal").alias("value"))


@query(f"WITH {ROWS} SELECT entity, name, \"group\", {rnd('percentile')} AS percentile, value FROM b WHERE \"group\" = 'core' ORDER BY value DESC NULLS LAST, entity LIMIT 40")
def board_top(spark, sf):
    return bd.board(_board(spark, sf), group="core", mode="value_desc", top=40).withColumn("percentile", r6("percentile"))


@query(f"WITH {ROWS} SELECT entity, name, \"group\", {rnd('percentile')} AS percentile, value FROM b WHERE contains(lower(concat_ws(' ', name, entity)), '77')")
def board_search(spark, sf):
    return bd.board(_board(spark, sf), keyword="77", mode="percentile_asc", top=20).withColumn("percentile", r6("percentile"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity > 4 AND l_quantity < 80 AND l_extendedprice / 1000 > 2 AND l_extendedprice / 1000 < 120 AND l_extendedprice / 1000 / l_quantity BETWEEN 0.45 AND 0.95
  AND l_quantity - l_extendedprice / 1000 >= 0.8 AS plausible, l_quantity > 4 AND l_quantity < 80 AND (NOT (l_extendedprice / 1000 > 4 AND l_extendedprice / 1000 < 80) OR abs(l_quantity - l_extendedprice / 1000) / (l_extendedprice / 1000) <= 0.05) AS accepted,
  greatest(l_extendedprice / 30000, 30000 / l_extendedprice) BETWEEN 1 AND 3.2 AS near FROM lineitem""")
def plausibility(spark, sf):
    price = F.col("l_extendedprice")
    return load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", bd.plausible_pair(F.col("l_quantity"), price / 1000).alias("plausible"), bd.acceptable_deviation(F.col("l_quantity"), price / 1000).alias("accepted"), bd.compatible(price, F.lit(30000.0)).alias("near"))


@query(f"WITH {S} SELECT entity, max(d) AS d, arg_max(v, d) AS v FROM s WHERE d <= DATE '1999-06-15' AND DATE '1999-06-15' - d <= 90 GROUP BY 1")
def recent_reference(spark, sf):
    return bd.recent_reference(daily(spark, sf), F.lit("1999-06-15").cast("date"))


@query(f"WITH {S} SELECT entity, CAST(DATE '2001-09-15' - max(d) AS BIGINT) AS lag_days, DATE '2001-09-15' - max(d) > 50 AS stale FROM s GROUP BY 1")
def stale_series(spark, sf):
    return bd.stale_entities(daily(spark, sf), F.lit("2001-09-15").cast("date"))


LAST_ROWS = """n AS (SELECT entity, d, pe_ttm AS v, {key} AS k, row_number() OVER (PARTITION BY entity ORDER BY d DESC) AS n FROM p), l AS (SELECT entity, k AS lk, d AS ld, v AS lv FROM n WHERE n = 1)"""


def _last_rows_sql(key: str, old: str) -> str:
    share = lambda rows: f"count(*) FILTER (n <= {rows} AND k <= lk) / CAST(count(*) FILTER (n <= {rows}) AS DOUBLE)"
    return f"""WITH {P}, {LAST_ROWS.format(key=key)}, g AS (SELECT entity, any_value(ld) AS ld, any_value(lv) AS lv, count(*) AS c, {share(1260)} AS p5, {share(2520)} AS p10, {share(10**9)} AS pf,
    avg(v) FILTER (n <= 756) AS m, stddev_samp(v) FILTER (n <= 756) AS s, coalesce(arg_max(v, d) FILTER ({old}), arg_min(v, d)) AS ref FROM n JOIN l USING (entity) GROUP BY 1)
  SELECT entity, ld AS last_date, {rnd('lv')} AS last_value, c AS n_points, {rnd('p5')} AS percentile_5y, {rnd('p10')} AS percentile_10y, {rnd('pf')} AS percentile_full,
    {rnd('CASE WHEN s > 0 THEN (lv - m) / s ELSE 0 END')} AS z_score_3y, {rnd('CASE WHEN abs(ref) > 1e-12 THEN (lv - ref) / abs(ref) ELSE 0 END', 4)} AS change_1y, {REGIME.format('pf')} AS regime FROM g"""


def _last_rows(df: DataFrame) -> DataFrame:
    cols = ["last_value", "percentile_5y", "percentile_10y", "percentile_full", "z_score_3y"]
    return df.select("entity", "last_date", "n_points", *[r6(c).alias(c) for c in cols], r6("change_1y", 4).alias("change_1y"), "regime")


@query(_last_rows_sql("pe_ttm", "d <= CAST(ld - INTERVAL 1 YEAR AS DATE)"))
def row_window_stats(spark, sf):
    return _last_rows(stats.latest_row_stats(points(spark, sf)))


@query(_last_rows_sql(KEY.format("pe_ttm"), "n >= 252"))
def row_window_stats_offset(spark, sf):
    return _last_rows(stats.latest_row_stats(points(spark, sf), signed=True, reference="rows"))


COMPANY = """caps AS (SELECT c_mktsegment AS entity, count(*) // 20 AS market_cap, CASE WHEN c_mktsegment = 'BUILDING' THEN NULL ELSE length(c_mktsegment) END AS rank FROM customer GROUP BY 1)"""


@query(f"""WITH {P}, k AS (SELECT *, {KEY.format('pe_ttm')} AS key FROM p), {DIM}, {COMPANY}, l AS (SELECT entity, max(d) AS ld, arg_max(pe_ttm, d) AS lv, arg_max(key, d) AS lk, arg_max(pe_forward, d) AS fwd, arg_max(pb, d) AS pb FROM k GROUP BY 1),
  g AS (SELECT entity, count(*) FILTER (key <= any_lk) / CAST(count(*) AS DOUBLE) AS pf, count(*) FILTER (in10 AND key <= any_lk) / CAST(count(*) FILTER (in10) AS DOUBLE) AS p10
    FROM (SELECT k.*, lk AS any_lk, d >= CAST(ld - INTERVAL 10 YEAR AS DATE) AS in10 FROM k JOIN l USING (entity)) GROUP BY 1)
  SELECT row_number() OVER (ORDER BY market_cap DESC, coalesce(rank, 9999), display_name) AS place, entity, display_name, market_cap, CAST(coalesce(rank, 9999) AS BIGINT) AS rank, ld AS date, {rnd('lv')} AS pe_ttm, {rnd('fwd')} AS pe_forward, {rnd('l.pb')} AS pb,
    {rnd('CASE WHEN abs(lv) > 1e-12 THEN 1 / lv ELSE 0 END', 8)} AS earnings_yield, {rnd('pf')} AS percentile_full, {rnd('p10')} AS percentile_10y, {REGIME.format('p10')} AS regime FROM l JOIN g USING (entity) JOIN dim USING (entity) JOIN caps USING (entity)""")
def company_snapshot(spark, sf):
    seg = load(spark, sf, "customer").groupBy(F.col("c_mktsegment").alias("entity")).agg(F.floor(F.count(F.lit(1)) / 20).alias("market_cap"))
    caps = seg.withColumn("rank", F.when(F.col("entity") != "BUILDING", F.length("entity")))
    df = api.company_snapshot(points(spark, sf), dim(spark, sf).join(caps, "entity"))
    cols = ["pe_ttm", "pe_forward", "pb", "percentile_full", "percentile_10y"]
    return df.select("place", "entity", "display_name", "market_cap", "rank", "date", *[r6(c).alias(c) for c in cols], r6("earnings_yield", 8).alias("earnings_yield"), "regime")


def _rules(spark, sf) -> DataFrame:
    """Three users with rules of their own over all series."""
    rules = F.array(*[F.struct(F.lit(u).alias("user_id"), F.lit(a).alias("upper"), F.lit(b).alias("lower"), F.lit(c).alias("cooldown")) for u, a, b, c in (("u0", 50.0, 40.0, 5), ("u1", 60.0, 30.0, 2), ("u2", 99.0, 1.0, 0))])
    return dim(spark, sf).select("entity", F.inline(rules))


def _old_state(spark, sf) -> DataFrame:
    """The last run's state: one user's alerts on the fourth last day of each series, and one of a series that is gone."""
    w = W.partitionBy("entity").orderBy(F.desc("d"))
    fourth = daily(spark, sf).withColumn("n", F.row_number().over(w)).where("n = 4").select(F.lit("u0").alias("user_id"), "entity", F.col("d").alias("last_triggered"), F.lit("high").alias("last_direction"))
    gone = spark.createDataFrame([("u1", "GONE", None, "neutral")], "user_id string, entity string, last_triggered date, last_direction string")
    return fourth.unionByName(gone)


def _updated(spark, sf) -> tuple[DataFrame, DataFrame]:
    ranked = windows.framed_ranks(daily(spark, sf), "entity", "d", "v", {"percentile": None})
    return api.daily_update(ranked, _rules(spark, sf), _old_state(spark, sf))


UPDATE = f"""rules(user_id, upper, lower, cooldown) AS (VALUES ('u0', 50.0::DOUBLE, 40.0::DOUBLE, 5), ('u1', 60.0, 30.0, 2), ('u2', 99.0, 1.0, 0)),
  n AS (SELECT entity, d, {RANK.format('v', FRAME.format('UNBOUNDED'))} AS p, row_number() OVER (PARTITION BY entity ORDER BY d DESC) AS back FROM s), l AS (SELECT a.entity, a.d, a.p, b.p AS q FROM n a JOIN n b USING (entity) WHERE a.back = 1 AND b.back = 2),
  o AS (SELECT 'u0' AS user_id, entity, d AS last_triggered, 'high' AS last_direction FROM n WHERE back = 4 UNION ALL SELECT 'u1', 'GONE', NULL, 'neutral'),
  w AS (SELECT r.*, l.*, last_triggered, CASE WHEN p >= upper / 100 THEN 'high' WHEN p <= lower / 100 THEN 'low' ELSE 'neutral' END AS now, CASE WHEN q >= upper / 100 THEN 'high' WHEN q <= lower / 100 THEN 'low' ELSE 'neutral' END AS was,
    last_triggered IS NULL OR 3 >= cooldown AS ready FROM rules r CROSS JOIN l LEFT JOIN o ON o.user_id = r.user_id AND o.entity = l.entity),
  f AS (SELECT *, ready AND now <> 'neutral' AND now <> was AS fires FROM w)"""


@query(f"WITH {S}, {UPDATE} SELECT user_id, entity, d, now AS direction, CASE WHEN p >= 0.95 OR p <= 0.05 THEN 'P1' ELSE 'P2' END AS severity, {rnd('p', 4)} AS percentile FROM f WHERE fires")
def daily_update(spark, sf):
    return _updated(spark, sf)[0].select("user_id", "entity", "d", "direction", "severity", r6("percentile", 4).alias("percentile"))


@query(f"WITH {S}, {UPDATE} SELECT user_id, entity, CASE WHEN fires THEN d ELSE last_triggered END AS last_triggered, now AS last_direction FROM f UNION ALL SELECT * FROM o WHERE entity = 'GONE'")
def daily_update_state(spark, sf):
    """The state after the run, stored and read again as the next run will."""
    path = f"{checkpoint_path(spark)}/stores-{uuid4().hex}"
    alerts, state = _updated(spark, sf)
    sinks.save_stores({"alerts": alerts, "alert_state": state}, path)
    return readers.load_stores(spark, path)["alert_state"]


@query("""WITH u AS (SELECT c_custkey, list_distinct(list_filter([CASE WHEN c_custkey % 5 = 0 THEN 'nation' || c_nationkey ELSE 'segment' || (c_custkey % 7) END, 'segment1', 'nope'], lambda x: x IN ('segment0', 'segment1', 'segment2', 'segment3'))) AS ids FROM customer)
  SELECT c_custkey, list_contains(ids, 'segment2') AS has_two, CAST(len(ids) AS BIGINT) AS n_ids, least(greatest(c_custkey % 120::DOUBLE, 50), 99) AS upper, 15.0::DOUBLE AS lower, CAST(least(c_custkey % 90, 60) AS INT) AS cooldown FROM u JOIN customer USING (c_custkey)""")
def watchlists(spark, sf):
    k = F.col("c_custkey")
    first = F.when(k % 5 == 0, F.concat(F.lit("nation"), F.col("c_nationkey").cast("string"))).otherwise(F.concat(F.lit("segment"), (k % 7).cast("string")))
    raw = load(spark, sf, "customer").select(k.alias("user_id"), F.array(first, F.lit("segment1"), F.lit("nope")).alias("watch_ids"), (k % 120).cast("double").alias("upper"), F.lit(None).cast("double").alias("lower"), (k % 90).cast("int").alias("cooldown"))
    out = api.watchlists(raw, ["segment0", "segment1", "segment2", "segment3"])
    return out.select(F.col("user_id").alias("c_custkey"), F.array_contains("watch_ids", "segment2").alias("has_two"), F.size("watch_ids").cast("long").alias("n_ids"), "upper", "lower", "cooldown")


@query(f"WITH {S}, {CROSS} SELECT 'u1' AS user_id, entity, d, direction, severity = 'P1' AS read FROM c")
def acknowledge(spark, sf):
    """One user's alerts, newest first, those of the higher severity marked as read."""
    store = al.alert_rows(_crossed(spark, sf), dim(spark, sf).select(F.lit("u1").alias("user_id"), "entity"), "p", most=100_000)
    marked = api.acknowledge(store.where("severity = 'P1'"), "u1").unionByName(api.acknowledge(store.where("severity <> 'P1'"), "u2"))
    return api.alerts(marked, "u1").select("user_id", "entity", "d", "direction", "read")


@query(f"""WITH {S}, a AS (SELECT entity, min(d) AS c0, count(*) AS c FROM s GROUP BY 1), w AS (SELECT entity, min(d) AS f0, count(*) AS f FROM s WHERE day(d) = 9 AND length(entity) <> 9 GROUP BY 1), n AS (SELECT entity, d, row_number() OVER (PARTITION BY entity ORDER BY d DESC) AS n FROM s),
  m AS (SELECT entity, min(d) AS mc FROM n WHERE n <= 126 GROUP BY 1)
  SELECT entity, CASE WHEN coalesce(f, 0) >= 4 THEN greatest(f0, c0) WHEN h <= mc THEN greatest(h, c0) ELSE c0 END AS forward_start, greatest(DATE '1997-01-01', CASE WHEN coalesce(f, 0) >= 4 THEN greatest(f0, c0) WHEN h <= mc THEN greatest(h, c0) ELSE c0 END) AS from_date
  FROM (SELECT *, CASE WHEN entity = 'MACHINERY' THEN DATE '1996-05-05' WHEN entity = 'HOUSEHOLD' THEN DATE '2031-01-01' END AS h FROM a LEFT JOIN w USING (entity) JOIN m USING (entity))""")
def forward_start(spark, sf):
    """From when on forward values are shown, and the start of a request clamped to it."""
    df = daily(spark, sf)
    history = dim(spark, sf).select("entity", F.when(F.col("entity") == "MACHINERY", F.lit("1996-05-05")).when(F.col("entity") == "HOUSEHOLD", F.lit("2031-01-01")).cast("date").alias("history_start"))
    out = timeseries.forward_start(df, df.where((F.dayofmonth("d") == 9) & (F.length("entity") != 9)), history, "entity", "d")
    return out.withColumn("from_date", F.greatest(F.lit("1997-01-01").cast("date"), F.col("forward_start")))


@query("""SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE)) AS by_name, CAST(o_orderdate AS DATE) AS by_day, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) ELSE CAST(o_orderdate AS DATE) END AS by_slash,
  last_day(CAST(o_orderdate AS DATE)) AS month_end, make_date(CAST(year(o_orderdate) AS BIGINT), 3, 3) - CASE WHEN year(o_orderdate) % 4 = 0 THEN 1 ELSE 0 END AS rolled FROM orders""")
def text_dates(spark, sf):
    d = F.col("o_orderdate").cast("timestamp")
    k = F.col("o_orderkey") % 4
    slash = F.date_format(d, "M/d/yyyy")
    short = F.concat(F.date_format(d, "M/d/"), F.lpad((F.year(d) % 100).cast("string"), 2, "0"))
    kinds = F.when(k == 0, F.lpad((F.unix_millis(d)).cast("string"), 13, "0")).when(k == 1, F.date_format(d, "yyyy-MM-dd HH")).when(k == 2, F.date_format(d, "yyyy/MM")).otherwise(slash)
    return load(spark, sf, "orders").select(
        "o_orderkey",
        fd.month_year_date(F.date_format(d, "MMMM"), F.date_format(d, "yyyy")).alias("by_name"),
        fd.month_day_year_date(F.date_format(d, "MMM"), F.date_format(d, "d"), F.date_format(d, "yyyy")).alias("by_day"),
        fd.slash_date(F.when(F.col("o_orderkey") % 2 == 0, slash).otherwise(short)).alias("by_slash"),
        fd.month_end_of(kinds).alias("month_end"),
        fd.month_day_year_date(F.lit("February"), F.lit("31"), F.date_format(d, "yyyy")).alias("rolled"),
    )


@query("""SELECT c_custkey, floor(c_acctbal / 7 * 1e6 + 0.5) / 1e6 AS eps, CASE WHEN c_acctbal > 0 THEN floor(c_acctbal / 7 * 1e3 + 0.5) / 1e3 END AS shares, c_acctbal > 4 AND c_acctbal < 80 AS reasonable, c_acctbal > 2 AND c_acctbal < 120 AS reasonable_forward,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(to_timestamp(CASE WHEN c_custkey % 3 = 1 THEN c_custkey * 1000000 ELSE (1000000000 + c_custkey) END) AS DATE) END AS day FROM customer""")
def scalar_rules(spark, sf):
    bal, k = F.col("c_acctbal"), F.col("c_custkey")
    stamp = F.when(k % 3 == 0, -k).when(k % 3 == 1, k * 1000000).otherwise((1000000000 + k) * 1000)
    return load(spark, sf, "customer").select(
        "c_custkey", fn.rounded(bal / 7).alias("eps"), fn.share_count(bal / 7).alias("shares"), bd.reasonable_pe(bal).alias("reasonable"), bd.reasonable_forward_pe(bal).alias("reasonable_forward"), fd.epoch_date(stamp).alias("day")
    )


SOURCES = """c AS (SELECT entity, d, v, CAST(1 AS BIGINT) AS source FROM s WHERE day(d) = 1 AND month(d) < length(entity) UNION ALL SELECT entity, d, v * 2, 2 FROM s WHERE day(d) < 3 AND entity <> 'HOUSEHOLD' UNION ALL SELECT entity, d, v * 3, 3 FROM s WHERE day(d) = 30)"""


def _sources(spark, sf) -> DataFrame:
    df, day = daily(spark, sf), F.dayofmonth("d")
    one = df.where((day == 1) & (F.month("d") < F.length("entity"))).withColumn("source", F.lit(1).cast("long"))
    two = df.where((day < 3) & (F.col("entity") != "HOUSEHOLD")).withColumns({"v": F.col("v") * 2, "source": F.lit(2).cast("long")})
    return one.unionByName(two).unionByName(df.where(day == 30).withColumns({"v": F.col("v") * 3, "source": F.lit(3).cast("long")}))


@query(f"WITH {S}, {SOURCES}, n AS (SELECT entity, source, count(*) AS n FROM c GROUP BY 1, 2), p AS (SELECT entity, coalesce(min(source) FILTER (n >= 55), arg_max(source, n * 10 - source)) AS source FROM n GROUP BY 1) SELECT entity, d, v, source FROM c JOIN p USING (entity, source)")
def accepted_source(spark, sf):
    """Each series from the first source with rows enough, or else from the one with most rows."""
    return merge.first_sufficient(_sources(spark, sf), "entity", "source", 55)


@query(f"WITH {S}, {SOURCES} SELECT entity, count(*) FILTER (source = 1) AS n_one, count(*) FILTER (source = 2) AS n_two, min(d) FILTER (source = 1) AS first_one, arg_max(source, d) AS last_source FROM (SELECT *  FROM c QUALIFY row_number() OVER (PARTITION BY entity, d ORDER BY source) = 1) GROUP BY 1")
def anchor_counts(spark, sf):
    df = merge.keep_best(_sources(spark, sf), ["entity", "d"], "source")
    one, two = F.when(F.col("source") == 1, F.col("d")), F.when(F.col("source") == 2, F.col("d"))
    return df.groupBy("entity").agg(F.count(one).alias("n_one"), F.count(two).alias("n_two"), F.min(one).alias("first_one"), F.max_by("source", "d").alias("last_source"))


@query(f"WITH {S} SELECT entity, min(d) AS from_date, max(d) AS to_date, min(v) AS lowest, max(v) AS highest, arg_max(v, d) AS last_value, {rnd('CASE WHEN count(*) > 1 THEN (arg_max(v, d) - arg_min(v, d)) / abs(arg_min(v, d)) * 100 ELSE 0 END')} AS change_percent FROM s WHERE d >= DATE '1998-01-01' GROUP BY 1")
def view_summary(spark, sf):
    return stats.view_summary(daily(spark, sf).where(F.col("d") >= "1998-01-01"), "v").withColumn("change_percent", r6("change_percent"))


@query(f"WITH {S}, e AS (SELECT entity, min(d) AS a, max(d) AS b, arg_max(v, d) AS p FROM s GROUP BY 1) SELECT count(*) AS n_series, max(a) AS from_date, min(b) AS to_date, {rnd('median(p)')} AS median_percentile FROM e")
def compare_summary(spark, sf):
    return stats.compare_summary(daily(spark, sf), "v").withColumn("median_percentile", r6("median_percentile"))


@query(f"WITH {S}, {A}, b AS (SELECT *, {_bracket_sql('anchor')} FROM (SELECT entity, d, CASE WHEN month(d) % 5 = 1 THEN anchor END AS anchor FROM a)) SELECT entity, d, {rnd('CASE WHEN d0 IS NULL THEN NULL WHEN d1 IS NULL THEN CASE WHEN d - d0 <= 60 THEN v0 END WHEN d1 = d0 THEN v0 WHEN d1 - d0 <= 240 THEN v0 + (v1 - v0) * (d - d0) / (d1 - d0) END')} AS value FROM b")
def interp_monthly(spark, sf):
    """Nothing before the first anchor, 60 days after the last, nothing in gaps over 240 days."""
    df = anchored(spark, sf).withColumn("anchor", F.when(F.month("d") % 5 == 1, F.col("anchor")))
    return timeseries.interpolate(df, "entity", "d", "anchor", "x", widest=240, before_first="null", fill=60).select("entity", "d", r6("x").alias("value"))


@query(f"""WITH {S}, y AS (SELECT a.entity, a.d, a.v, a.t, s.v AS w FROM (SELECT *, CASE WHEN month(d) = 2 AND day(d) = 29 THEN make_date(year(d) - 1, 3, 1) ELSE CAST(d - INTERVAL 1 YEAR AS DATE) END AS t FROM s) a ASOF LEFT JOIN s ON a.entity = s.entity AND a.t >= s.d)
  SELECT entity, d, {rnd('CASE WHEN abs(w) > 1e-8 AND abs(v / w - 1) > 1e-8 THEN v / w - 1 END')} AS growth FROM y""")
def growth_on_year(spark, sf):
    return timeseries.growth_on_year(daily(spark, sf), "entity", "d", "v").select("entity", "d", r6("growth").alias("growth"))


LARGE = "CASE length(entity) WHEN 9 THEN 60 WHEN 8 THEN 70000 ELSE 1 END"


@query(f"""WITH {P}, g AS (SELECT entity, d, pe_ttm * {LARGE} AS pe_ttm, pe_forward * {LARGE} AS pe_forward FROM p), l AS (SELECT entity, max(d) AS ld, arg_max(pe_ttm, d) AS lt, arg_max(pe_forward, d) * (1 + length(entity) % 4) AS lf FROM g GROUP BY 1)
  SELECT entity, d, {rnd('least(greatest(pe_ttm * (lf / lt), -1000000), 1000000)', 4)} AS value FROM g JOIN l USING (entity) WHERE abs(lf / lt) BETWEEN 0.35 AND 3.5 AND d >= CAST(ld - INTERVAL 3 YEAR AS DATE)""")
def forward_proxy(spark, sf):
    """Values far above 200, and some at the bound."""
    large = F.when(F.length("entity") == 9, 60).when(F.length("entity") == 8, 70000).otherwise(1)
    df = points(spark, sf).withColumns({"pe_ttm": F.col("pe_ttm") * large, "pe_forward": F.col("pe_forward") * large})
    last = df.groupBy("entity").agg(F.max_by("pe_ttm", "d").alias("latest"), (F.max_by("pe_forward", "d") * (1 + F.length("entity") % 4)).alias("latest_forward"))
    return timeseries.forward_from_trailing(df, last, "entity", "d", "pe_ttm", 3).select("entity", "d", r6("value", 4).alias("value"))


#: Each series' earnings per share and ratio: usual ones, some with ratios above 500, some around the bound.
EPS, OWN = "CASE entity WHEN 'HOUSEHOLD' THEN 100 WHEN 'AUTOMOBILE' THEN 0.15 ELSE 5000 + length(entity) END::DOUBLE", "CASE entity WHEN 'HOUSEHOLD' THEN v / 120 WHEN 'AUTOMOBILE' THEN v / 0.18 ELSE abs(pe_ttm) + 3 END::DOUBLE"


@query(f"""WITH {P}, g AS (SELECT entity, d, v, {OWN} AS pe FROM p), e AS (SELECT entity, max(d) - CAST(40 * (1 + length(entity) % 3) AS INTEGER) AS start, {EPS} AS eps, CASE entity WHEN 'MACHINERY' THEN max(d) - 20 WHEN 'BUILDING' THEN max(d) - 400 END AS cutoff FROM p GROUP BY 1),
  l AS (SELECT entity, max(d) AS ld, arg_max(v, d) / any_value(eps) AS based, arg_max(pe, d) AS lp FROM g JOIN e USING (entity) GROUP BY 1), u AS (SELECT *, ld - start BETWEEN 0 AND 190 AND (cutoff IS NULL OR cutoff > start) AND greatest(lp / based, based / lp) < 3.5 AS use FROM l JOIN e USING (entity))
  SELECT g.entity, d, {rnd('CASE WHEN use AND d >= start AND (cutoff IS NULL OR d < cutoff) AND abs(v / eps) <= 1000000 THEN v / eps ELSE pe END')} AS pe_ttm FROM g JOIN u USING (entity)""")
def recent_actual_ratio(spark, sf):
    own = F.when(F.col("entity") == "HOUSEHOLD", F.col("v") / 120).when(F.col("entity") == "AUTOMOBILE", F.col("v") / 0.18).otherwise(F.abs("pe_ttm") + 3)
    df = points(spark, sf).select("entity", "d", F.col("v").alias("close"), own.alias("pe_ttm"))
    end = F.max("d")
    eps = df.groupBy("entity").agg(F.date_sub(end, 40 * (1 + F.length("entity") % 3)).alias("start"), F.when(F.col("entity") == "MACHINERY", F.date_sub(end, 20)).when(F.col("entity") == "BUILDING", F.date_sub(end, 400)).alias("cutoff"))
    eps = eps.withColumn("eps", F.when(F.col("entity") == "HOUSEHOLD", 100.0).when(F.col("entity") == "AUTOMOBILE", 0.15).otherwise((5000 + F.length("entity")).cast("double")))
    return timeseries.override_with_actual(df, eps, "entity", "d", "pe_ttm", "close").select("entity", "d", r6("pe_ttm").alias("pe_ttm"))


@query(f"""WITH {S}, r AS (SELECT entity, last_day(d) AS a, avg(length(entity)) * CASE WHEN month(last_day(d)) = 6 THEN 0 ELSE 1 END AS ratio FROM s WHERE entity <> 'BUILDING' GROUP BY 1, 2), f AS (SELECT entity, min(d) AS d0, arg_min(v, d) AS v0 FROM s GROUP BY 1),
  j AS (SELECT r.entity, r.a, r.ratio, s.v FROM r ASOF LEFT JOIN s ON r.entity = s.entity AND r.a >= s.d WHERE abs(ratio) > 1e-8)
  SELECT entity, a AS d, {rnd('ratio')} AS ratio, {rnd('v / ratio')} AS denominator, false AS fallback FROM j UNION ALL SELECT entity, d0, 20, {rnd('v0 / 20')}, true FROM f WHERE entity NOT IN (SELECT entity FROM j)""")
def anchor_denominators(spark, sf):
    df = daily(spark, sf)
    months = df.where("entity <> 'BUILDING'").select("entity", F.last_day("d").alias("d")).distinct()
    anchors = months.withColumn("ratio", F.when(F.month("d") == 6, 0.0).otherwise(F.length("entity").cast("double")))
    out = timeseries.anchor_denominators(df, anchors, "entity", "d", "v", 20.0)
    return out.select("entity", "d", r6("ratio").alias("ratio"), r6("denominator").alias("denominator"), "fallback")


@query(f"""WITH {Q}, e AS (SELECT entity, d, qty / 1000000.0::DOUBLE AS eps, year(d) || '-Q' || quarter(d) AS k FROM q WHERE year(d) >= 1998), h AS (SELECT entity, d, qty::DOUBLE AS shares, year(d) || '-Q' || quarter(d) AS k FROM q WHERE year(d) BETWEEN 1997 AND 1999 AND quarter(d) <> 2),
  b AS (SELECT e.entity, e.d, e.eps, e.k, h.shares FROM e ASOF LEFT JOIN h ON e.entity = h.entity AND e.d >= h.d), l AS (SELECT entity, arg_max(shares, d) AS last FROM h GROUP BY 1)
  SELECT b.entity, b.k AS quarter, b.d, {rnd('eps * coalesce(h.shares, b.shares, last)', 3)} AS net_income FROM b LEFT JOIN h ON h.entity = b.entity AND h.k = b.k LEFT JOIN l ON l.entity = b.entity""")
def expected_income(spark, sf):
    df = quarters(spark, sf)
    eps = df.where(F.year("d") >= 1998).select("entity", "d", (F.col("qty") / 1000000).alias("eps"))
    shares = df.where(F.year("d").between(1997, 1999) & (F.quarter("d") != 2)).select("entity", "d", F.col("qty").cast("double").alias("shares"))
    return qt.income_from_shares(eps, shares).withColumn("net_income", r6("net_income", 3))


@query("""WITH t AS (SELECT s_suppkey, s_name AS ticker FROM supplier WHERE s_suppkey % 2 = 0), k AS (SELECT s_suppkey, lower(replace(s_name, '#', '-')) AS symbol FROM supplier)
  SELECT k.s_suppkey, t.s_suppkey AS cik FROM k LEFT JOIN t ON regexp_replace(upper(t.ticker), '[^A-Z0-9]', '', 'g') = regexp_replace(upper(k.symbol), '[^A-Z0-9]', '', 'g')""")
def ticker_lookup(spark, sf):
    df = load(spark, sf, "supplier")
    table = df.where("s_suppkey % 2 = 0").select(F.col("s_name").alias("ticker"), F.col("s_suppkey").alias("cik"))
    return merge.lookup(df.select("s_suppkey", F.lower(F.replace("s_name", F.lit("#"), F.lit("-"))).alias("symbol")), table, "symbol", "ticker", "cik").drop("symbol")


@query(f"""WITH {S}, {TWO}, c AS (SELECT entity, min(d) AS cut FROM x WHERE year(d) >= 1999 GROUP BY 1), b AS (SELECT y.* FROM y LEFT JOIN c USING (entity) WHERE cut IS NULL OR d < cut), t AS (SELECT entity, d, a FROM x WHERE year(d) >= 1999)
  SELECT entity, d, coalesce(t.a, b.a) AS a FROM b FULL JOIN t USING (entity, d)""")
def cutover_merge(spark, sf):
    x, y = _two(spark, sf)
    return merge.cutover_merge(y, x.where(F.year("d") >= 1999), "entity", "d", "a")


@query(f"""WITH {P} SELECT entity, {rnd('least(greatest(arg_max(pb, d) * pow(arg_max(v, d) / arg_min(v, d), 0.72), 0.5), 16)')} AS pb, {rnd('min(v) FILTER (pe_ttm > 0)')} AS lowest_close, count(*) FILTER (pe_ttm > 0) AS n_positive FROM p GROUP BY 1""")
def book_anchor(spark, sf):
    df = points(spark, sf)
    last = df.groupBy("entity").agg(F.max_by("pb", "d").alias("pb"), F.max_by("v", "d").alias("pe"), F.min_by("v", "d").alias("base"))
    last = last.select("entity", r6(timeseries.book_anchor(F.col("pb"), F.col("pe"), F.col("base"))).alias("pb"))
    closes = timeseries.positive_points(df.withColumn("close", F.col("pe_ttm")), "close").groupBy("entity").agg(F.min(r6("v")).alias("lowest_close"), F.count(F.lit(1)).alias("n_positive"))
    return last.join(closes, "entity")


@query("""WITH j AS (SELECT conv_id, turn, regexp_extract_all(text, '[0-9]{1,3}(?:,[0-9]{3})*(?:\\.[0-9]+)?') AS raw FROM conversations), v AS (SELECT conv_id, turn, list_filter(list_transform(raw, lambda x: CAST(replace(x, ',', '') AS DOUBLE)), lambda x: x BETWEEN 4 AND 120) AS v FROM j)
  SELECT conv_id, turn, CASE WHEN len(v) >= 2 THEN v[1] END AS trailing, CASE WHEN len(v) >= 2 THEN coalesce(list_min(list_filter(v[2:], lambda x: x < v[1])), list_min(v[2:])) END AS forward FROM v""")
def pair_from_cells(spark, sf):
    pair = parse.ratio_pair(F.array(F.col("text")))
    return load(spark, sf, "conversations").select("conv_id", "turn", pair["trailing"].alias("trailing"), pair["forward"].alias("forward"))


@query("""SELECT c_custkey, list_contains(ids, 'x' || (c_custkey % 5)) AS has_own, CAST(len(ids) AS BIGINT) AS n, CAST(least(len(ids), 2) AS BIGINT) AS n_capped, (c_custkey % 4 <> 1) AS included FROM (SELECT c_custkey, list_filter(list_distinct(['x' || (c_custkey % 5), 'x' || (c_custkey % 3), 'x1']), lambda x: x <> 'x4') AS ids FROM customer)""")
def selections(spark, sf):
    """Known ids of stored lists, as JSON text or array, distinct in order and capped; symbols allowed by an include and an exclude list."""
    k = F.col("c_custkey")
    name = lambda n: F.concat(F.lit("x"), (k % n).cast("string"))
    stored = F.to_json(F.array(name(5), name(3)))
    ids = ft.known_ids(["x0", "x1", "x2", "x3"], 8, ft.id_list(stored), F.array(F.lit("x1")))
    symbol = F.concat(F.lit("S"), (k % 4).cast("string"))
    return load(spark, sf, "customer").select(
        "c_custkey", F.array_contains(ids, name(5)).alias("has_own"), F.size(ids).cast("long").alias("n"), F.size(F.slice(ids, 1, 2)).cast("long").alias("n_capped"), ft.included(symbol, ["*"], ["S1"]).alias("included")
    )


@query("""SELECT o_custkey, min(CAST(greatest(o_orderdate, o_orderdate + INTERVAL (o_orderkey % 9) DAY) AS DATE)) AS available, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter FROM orders GROUP BY ALL""")
def availability(spark, sf):
    """When a quarter's figures could first be known: the earliest of filing dates, none before the period's end."""
    df = load(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("end"), F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 9).cast("int")).alias("filed"))
    return qt.first_available(df, "o_custkey", "end", "filed")


@query("""WITH t AS (SELECT o_orderkey, o_custkey % 50 AS slug, o_totalprice FROM orders) SELECT slug, min(o_orderkey) AS rank, count(*) AS n FROM t GROUP BY 1 ORDER BY rank LIMIT 30""")
def seed_list(spark, sf):
    """Pages of ranked seeds: the best rank of each symbol, the first 30."""
    df = load(spark, sf, "orders").select((F.col("o_custkey") % 50).alias("slug"), F.col("o_orderkey").alias("rank"))
    return merge.best_ranked(df, "slug", "rank", 30)


@query(r"""WITH l AS (SELECT item_id, unnest(string_split(replace(text, ' ', chr(10)), chr(10))) AS w, generate_subscripts(string_split(replace(text, ' ', chr(10)), chr(10)), 1) - 1 AS line_no FROM benchmark WHERE item_id % 2 = 0) SELECT item_id, CAST(line_no AS INT) AS line_no, trim(w) AS cell FROM l WHERE trim(w) <> ''""")
def csv_lines(spark, sf):
    df = load(spark, sf, "benchmark").where("item_id % 2 = 0").select("item_id", F.replace("text", F.lit(" "), F.lit("\n")).alias("text"))
    return parse.csv_rows(df.withColumn("text", F.replace("text", F.lit(","), F.lit(";"))), "text", ["item_id"]).select("item_id", "line_no", F.replace(F.get("cells", F.lit(0)), F.lit(";"), F.lit(",")).alias("cell"))


TABLE = "SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, CAST(o_custkey % 260 + 1 AS DOUBLE) AS value FROM orders"


@query(f"WITH t AS ({TABLE}) SELECT o_custkey, date, any_value(value) AS value FROM t WHERE value <= 250 GROUP BY 1, 2")
def table_values(spark, sf):
    """Dated values out of HTML tables made from the orders of each customer."""
    cells = F.concat(F.lit("<tr class='x'><td>"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("</td><td><b>$"), (F.col("o_custkey") % 260 + 1).cast("string"), F.lit("</b></td></tr>"))
    pages = load(spark, sf, "orders").groupBy("o_custkey").agg(F.concat_ws("", F.lit("<table><tr><th>Date</th><th>Value</th></tr>"), F.concat_ws("", F.collect_list(cells)), F.lit("</table>")).alias("html"))
    return parse.dated_values(pages, "html", ["o_custkey"])


@query("SELECT user_id, CAST(ts AS DATE) AS date, count(*) AS n, floor(sum(value) * 1e2 + 0.5) / 1e2 AS total FROM events GROUP BY 1, 2")
def chart_documents(spark, sf):
    """Pairs of [epoch, value] of each user's events, read back from JSON."""
    pair = F.array(F.unix_seconds(F.col("ts").cast("timestamp")).cast("double"), F.col("value"))
    docs = load(spark, sf, "events").groupBy("user_id").agg(F.to_json(F.collect_list(pair)).alias("body"))
    rows = docs.select("user_id", F.inline(parse.epoch_pairs(F.col("body"))))
    return rows.groupBy("user_id", "date").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value"), 2).alias("total"))


@query("SELECT n_nationkey, n_name AS first, CAST(3 AS BIGINT) AS n FROM nation")
def script_arrays(spark, sf):
    """An array literal out of a page's script."""
    text = F.concat(F.lit("var a = {other: [1], names: [\""), F.col("n_name"), F.lit("\", \"x\", null]};"))
    found = parse.array_literal(text, "names")
    return load(spark, sf, "nation").select("n_nationkey", F.get(found, F.lit(0)).alias("first"), F.size(found).cast("long").alias("n"))


X = """x AS (SELECT entity, last_day(d) AS d, floor(max(v) / 100 + 0.5) / 100 AS top, floor(min(v) / 100 + 0.5) / 100 AS low FROM s GROUP BY 1, 2),
  r AS (SELECT entity, d, CASE WHEN month(d) = 9 THEN -top ELSE top END AS pe_ttm, CASE WHEN year(d) >= 1995 THEN low + 3 END AS pe_forward,
    CASE WHEN entity <> 'BUILDING' THEN low / 5 END AS pb, CASE WHEN month(d) = 6 AND year(d) = 1997 THEN 1.5 END AS peg FROM x WHERE month(d) % 3 = 0)"""


def _ratio_rows(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Closes, quarterly ratio rows on calendar days, and one row of latest ratios each."""
    df = daily(spark, sf)
    x = df.groupBy("entity", F.last_day("d").alias("d")).agg(F.max("v").alias("top"), F.min("v").alias("low")).where(F.month("d") % 3 == 0)
    top, low = F.floor(F.col("top") / 100 + 0.5) / 100, F.floor(F.col("low") / 100 + 0.5) / 100
    rows = x.select(
        "entity",
        "d",
        F.when(F.month("d") == 9, -top).otherwise(top).alias("pe_ttm"),
        F.when(F.year("d") >= 1995, low + 3).alias("pe_forward"),
        F.when(F.col("entity") != "BUILDING", low / 5).alias("pb"),
        F.when((F.month("d") == 6) & (F.year("d") == 1997), 1.5).alias("peg"),
    )
    latest = df.select("entity").distinct().select("entity", F.lit(21.5).alias("pe_ttm"), F.lit(18.0).alias("pe_forward"), F.lit(0.0).alias("pb"), F.lit(None).cast("double").alias("peg"))
    return df.select("entity", "d", F.col("v").alias("close")), rows, latest


@query(f"""WITH {S}, {X}, span AS (SELECT entity, min(d) AS lo, max(d) AS hi FROM s GROUP BY 1), i AS (SELECT r.* FROM r JOIN span USING (entity) WHERE d BETWEEN lo AND hi),
  m AS (SELECT i.entity, s.d AS d, i.d AS raw, pe_ttm, pe_forward, pb, peg FROM i ASOF JOIN s ON i.entity = s.entity AND i.d <= s.d),
  g AS (SELECT entity, d, {", ".join(f"arg_min({c}, raw) FILTER ({c} IS NOT NULL) AS {c}" for c in ("pe_ttm", "pe_forward", "pb", "peg"))} FROM m GROUP BY 1, 2)
  SELECT entity, d, coalesce(g.pe_ttm, l.pe_ttm) AS pe_ttm, coalesce(g.pe_forward, l.pe_forward) AS pe_forward, g.pb AS pb, g.peg AS peg
  FROM g FULL JOIN (SELECT entity, hi AS d, 21.5 AS pe_ttm, 18.0 AS pe_forward FROM span) l USING (entity, d)""")
def unified_anchors(spark, sf):
    return valuation.unify_anchors(*_ratio_rows(spark, sf))


@query(f"""WITH {S}, a AS (SELECT entity, d, v AS close, CASE WHEN month(d) % 3 = 0 AND d = max(d) OVER (PARTITION BY entity, date_trunc('month', d)) THEN floor(v / 100 + 0.5) / 100 * CASE WHEN month(d) = 9 THEN -1 ELSE 1 END END AS anchor FROM s),
  n AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY d) AS i FROM a), k AS (SELECT *, CASE WHEN anchor IS NOT NULL THEN {{'i': i, 'c': close, 'v': anchor}} END AS known FROM n),
  b AS (SELECT *, last_value(known IGNORE NULLS) {BACK} AS l, first_value(known IGNORE NULLS) {AHEAD.replace('CURRENT ROW', '1 FOLLOWING')} AS r FROM k)
  SELECT entity, d, {rnd("CASE WHEN l.i = i AND l.v * r.v > 0 THEN l.v WHEN l.v * r.v > 0 THEN l.v * close / l.c * exp((ln(r.v / l.v) - ln(r.c / l.c)) / (r.i - l.i) * (i - l.i)) ELSE close / (l.c / l.v) END", 4)} AS value FROM b""")
def project_ratio(spark, sf):
    """Ratios between anchors of either sign."""
    last = F.max("d").over(W.partitionBy("entity", F.trunc("d", "month")))
    value = (F.floor(F.col("v") / 100 + 0.5) / 100) * F.when(F.month("d") == 9, -1).otherwise(1)
    df = daily(spark, sf).select("entity", "d", F.col("v").alias("close"), F.when((F.month("d") % 3 == 0) & (F.col("d") == last), value).alias("anchor"))
    return valuation.project_ratio(df, "anchor", "value").select("entity", "d", "value")


@query()
def valuation_series(spark, sf):
    """The whole reconstruction: anchors, three projected ratios, the growth ratio, spikes; held against a loop in the tests."""
    return valuation.valuation_series(*_ratio_rows(spark, sf))


@query(f"""WITH {S}, {X}, t(src, entity, d, pe_ttm, pe_forward, pb, peg) AS (SELECT 1, entity, d, pe_ttm, NULL, NULL, NULL FROM r WHERE year(d) >= 1996 UNION ALL SELECT 2, entity, d, NULL, pe_forward, NULL, NULL FROM r WHERE d >= DATE '1996-09-01'
    UNION ALL SELECT 3, entity, d, pe_ttm + 1, pe_forward + 1, pb + 1, peg FROM r WHERE year(d) >= 1997),
  c AS (SELECT entity, min(d) FILTER (pe_ttm IS NOT NULL AND src <> 2) AS c1, min(d) FILTER (pe_forward IS NOT NULL AND src <> 1) AS c2, min(d) FILTER (pb IS NOT NULL AND src = 3) AS c3, min(d) FILTER (peg IS NOT NULL AND src = 3) AS c4 FROM t GROUP BY 1),
  b AS (SELECT 0 AS src, entity, d, CASE WHEN d >= c1 THEN NULL ELSE pe_ttm END AS pe_ttm, CASE WHEN d >= c2 THEN NULL ELSE pe_forward END AS pe_forward, CASE WHEN d >= c3 THEN NULL ELSE pb END AS pb, CASE WHEN d >= c4 THEN NULL ELSE peg END AS peg FROM r LEFT JOIN c USING (entity)),
  u AS (SELECT * FROM b UNION ALL SELECT * FROM t)
  SELECT entity, d, {", ".join(f"arg_min({c}, src) FILTER ({c} IS NOT NULL) AS {c}" for c in ("pe_ttm", "pe_forward", "pb", "peg"))} FROM u GROUP BY 1, 2 HAVING coalesce(max(pe_ttm), max(pe_forward), max(pb), max(peg)) IS NOT NULL""")
def ratio_cutover(spark, sf):
    _, rows, _ = _ratio_rows(spark, sf)
    none, y = F.lit(None).cast("double"), F.year("d")
    trailing = rows.where(y >= 1996).withColumns({"pe_forward": none, "pb": none, "peg": none})
    forward = rows.where("d >= DATE '1996-09-01'").withColumns({"pe_ttm": none, "pb": none, "peg": none})
    snapshots = rows.where(y >= 1997).withColumns({m: F.col(m) + 1 for m in ("pe_ttm", "pe_forward", "pb")})
    return valuation.merge_at_cutover(rows, trailing, forward, snapshots)


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of files."""
    schema = load(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf}/events*.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


#: Zones of each type's events in the order of time, the first of a moment; days are those on which a type has events.
ZONES = """z AS (SELECT event_type AS entity, ts AS "at", least(value / 100, 1.0) AS p, CASE WHEN least(value / 100, 1.0) >= 0.85 THEN 'high' WHEN least(value / 100, 1.0) <= 0.15 THEN 'low' ELSE 'neutral' END AS zone FROM events QUALIFY row_number() OVER (PARTITION BY event_type, ts ORDER BY least(value / 100, 1.0)) = 1),
  n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY "at") AS no, dense_rank() OVER (PARTITION BY entity ORDER BY CAST("at" AS DATE)) AS day FROM z)"""


@query(f"""WITH RECURSIVE {ZONES}, f AS (SELECT entity, no, "at", p, zone, false AS fires, CAST(NULL AS BIGINT) AS fired FROM n WHERE no = 1 UNION ALL
    SELECT entity, no, "at", p, zone, ok, CASE WHEN ok THEN day ELSE fired END FROM (SELECT n.*, f.fired, n.zone <> 'neutral' AND n.zone <> f.zone AND (f.fired IS NULL OR n.day - f.fired >= 5) AS ok FROM f JOIN n ON n.entity = f.entity AND n.no = f.no + 1))
  SELECT entity, "at", {rnd('p')} AS percentile, zone AS direction, CASE WHEN p >= 0.95 OR p <= 0.05 THEN 'P1' ELSE 'P2' END AS severity FROM f WHERE fires""")
def streaming_alerts(spark, sf):
    ship_package(spark)
    values = _events(spark, sf).select(F.col("event_type").alias("entity"), F.col("ts").alias("at"), F.least(F.col("value") / 100, F.lit(1.0)).alias("percentile"))
    folder = f"{checkpoint_path(spark)}/stream-alerts-{uuid4().hex}"
    q = stream_alerts(values).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    out = spark.read.schema("entity string, at timestamp, percentile double, direction string, severity string").parquet(f"{folder}/out")
    return out.withColumns({"at": F.col("at").cast("timestamp_ntz"), "percentile": r6("percentile")})


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, floor(sum(value) * 1e2 + 0.5) / 1e2 AS total FROM events GROUP BY 1, 2")
def streaming_counts(spark, sf):
    """All windows: those that the watermark has closed, those that are open when the stream ends, and events without a time."""
    folder = f"{checkpoint_path(spark)}/stream-counts-{uuid4().hex}"
    q = stream_counts(_events(spark, sf)).writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    closed = spark.read.schema("start timestamp, event_type string, n long, total double").parquet(f"{folder}/out")
    # Spark's windows leave rows without a time out.
    untimed = load(spark, sf, "events").where("ts IS NULL").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).withColumn("start", F.lit(None).cast("timestamp"))
    out = closed.unionByName(open_counts(spark, f"{folder}/state")).unionByName(untimed)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", r6("total", 2).alias("total"))
