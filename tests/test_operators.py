"""Literal cases of the series operators."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, numbers, text
from tidemark.operators import alerts, merge, quality, stats, timeseries, windows
from tidemark.operators.asof import asof_join
from tidemark.sources import parse, readers, sinks


def points(spark, rows):
    rows = [("x", date.fromisoformat(d), *v) for d, *v in rows]
    return spark.createDataFrame(rows, "entity string, d date, pe_ttm double, pe_forward double, pb double, us10y_yield double")


BASIC = [("2026-01-02", 18.0, 16.0, 3.0, 0.035), ("2026-01-05", 19.0, 16.8, 3.1, 0.0355), ("2026-01-06", 20.0, 17.6, 3.2, 0.036), ("2026-01-07", 21.0, 18.2, 3.3, 0.0365)]


def test_enriched_series(spark):
    rows = stats.enrich_series(points(spark, BASIC)).orderBy("d").collect()
    assert [r.percentile_full for r in rows] == [1, 1, 1, 1]
    assert rows[0].z_score_3y == 0 and rows[3].z_score_3y > 1
    assert rows[3].earnings_yield == pytest.approx(1 / 21)
    assert rows[3].regime == "high"


@pytest.mark.parametrize(("values", "metric", "last"), [((12, -8), "pe_ttm", 1), ((-2, -12), "pe_ttm", 0.5), ((3.5, -0.8), "pb", 1)])
def test_losses_rank_above_profits(spark, values, metric, last):
    rows = [(f"2026-01-0{i + 2}", *[float(v)] * 3, 0.03) for i, v in enumerate(values)]
    out = stats.metric_series(points(spark, rows), metric).orderBy("d").collect()
    assert out[-1].percentile_full == last


def test_range_is_cut_before_ranking(spark):
    rows = [(f"2026-01-0{i + 2}", v, v, v, 0.03) for i, v in enumerate((50.0, 10.0, 20.0))]
    out = stats.metric_series(points(spark, rows), "pe_ttm", "2026-01-03").orderBy("d").collect()
    assert [r.percentile_full for r in out] == [1, 1]


def test_percentile_of_arrays(spark):
    row = spark.range(1).select(
        windows.share_at_most(F.array(*map(F.lit, (10, 20, 30, 40, 50))), F.lit(40)).alias("a"),
        windows.share_at_most(F.array(*map(F.lit, (10, 20, 30, 40, 50))), F.lit(5)).alias("b"),
        windows.share_at_most(F.array().cast("array<int>"), F.lit(1)).alias("c"),
    ).head()
    assert (row.a, row.b, row.c) == (0.8, 0, 0.5)


def test_numbers(spark):
    row = spark.range(1).select(
        numbers.round_half_up(F.lit(-2.5), 0).alias("half"),
        numbers.clamp(F.lit(None).cast("double"), 0, 1).alias("none"),
        numbers.to_number(F.lit("x"), 7.0).alias("fallback"),
        numbers.to_number(F.lit(None)).alias("zero"),
        numbers.parse_number_text(F.lit("$1,234.5 %")).alias("text"),
        numbers.crossing(F.lit(0.83), F.lit(0.86)).alias("high"),
        numbers.crossing(F.lit(0.9), F.lit(0.88)).alias("stay"),
        numbers.crossing(F.lit(0.2), F.lit(0.1)).alias("low"),
        numbers.severity(F.lit(0.97)).alias("p1"),
        numbers.severity(F.lit(0.9)).alias("p2"),
        numbers.snap_to_anchor(F.lit(3.9), [1.0, 2.0, 4.0], 0.22).alias("snap"),
        numbers.snap_to_anchor(F.lit(3.0), [1.0, 2.0, 4.0], 0.22).alias("raw"),
        numbers.compact_number(F.lit(2.5e9)).alias("compact"),
        numbers.finite(F.lit(float("nan"))).alias("nan"),
    ).head()
    assert row.asDict() == {"half": -2.0, "none": None, "fallback": 7.0, "zero": 0.0, "text": 1234.5, "high": "high", "stay": None, "low": "low", "p1": "P1", "p2": "P2", "snap": 4.0, "raw": 3.0, "compact": "2.50B", "nan": None}


def test_dates(spark):
    d = lambda s: F.lit(s).cast("date")
    row = spark.range(1).select(
        dates.subtract_years(d("2024-02-29"), 1).alias("trap"),
        dates.subtract_years(d("2024-02-29"), 4).alias("leap"),
        dates.text_date(F.lit("02/30/2024")).alias("none"),
        dates.ratio_date_key(F.lit("2020")).alias("year"),
        dates.epoch_date(F.lit(1_700_000_000_000)).alias("ms"),
        dates.weekdays_between(d("2026-01-02"), d("2026-01-07")).alias("days"),
        dates.last_market_date(F.lit(datetime(2026, 1, 5, 12)).cast("timestamp")).alias("market"),
        dates.quarter_key(d("2026-05-01")).alias("q"),
    ).head()
    assert row.trap == date(2023, 3, 1) and row.leap == date(2020, 2, 29) and row.none is None and row.year == date(2020, 12, 31)
    assert row.ms == date(2023, 11, 14) and row.days == [date(2026, 1, 5), date(2026, 1, 6)] and row.market == date(2026, 1, 2) and row.q == "2026-Q2"


def test_texts(spark):
    row = spark.range(1).select(
        text.strip_html(F.lit("<p>a&nbsp;b<script>x</script></p> &amp; c")).alias("html"),
        text.company_id(F.lit("BRK.B")).alias("id"),
        text.symbol_list(F.lit(" aapl, msft aapl")).alias("symbols"),
        text.user_of_token(F.lit("Bearer dev-token:ann")).alias("user"),
        text.user_of_token(F.lit(None)).alias("nobody"),
        text.user_slug(F.lit(" "), F.lit("Ann Lee")).alias("slug"),
        text.visual_length(F.lit("a估值")).alias("width"),
        text.symbol_spellings(F.lit("BRK.B")).alias("spellings"),
        text.has_source_tag(F.lit("Yahoo+sec"), ["yahoo"]).alias("tag"),
    ).head()
    assert row.html == "a b & c" and row.id == "company_brk_b" and row.symbols == ["AAPL", "MSFT"] and row.user == "ann" and row.nobody == "demo-user"
    assert row.slug == "ann-lee" and row.width == 5 and row.spellings[0] == "brk.b.us" and row.tag


def test_cooldown_counts_trading_days(spark):
    days = [date(2026, 1, d) for d in (2, 5, 6, 7, 8, 9, 12)]
    rows = [("x", d, i + 1, "high") for i, d in enumerate(days)]
    df = spark.createDataFrame(rows, "entity string, d date, day_no int, direction string")
    assert [r.d.day for r in alerts.with_cooldown(df.where("day_no in (2, 4, 7)"), 5).orderBy("d").collect()] == [5, 12]


def test_watchlist(spark):
    df = spark.createDataFrame([("u", ["sp500", "invalid", "nasdaq100"], 88.0, 12.0, 4), ("v", None, None, None, None)], "user_id string, watch_ids array<string>, upper double, lower double, cooldown int")
    a, b = alerts.normalize_watchlist(df, ["nasdaq100", "sp500", "dow"], 2).orderBy("user_id").collect()
    assert a.watch_ids == ["sp500", "nasdaq100"] and (a.upper, a.lower, a.cooldown) == (88, 12, 4)
    assert b.watch_ids == ["nasdaq100", "sp500"] and (b.upper, b.lower, b.cooldown) == (85, 15, 5)


def test_alert_store(spark):
    fired = spark.createDataFrame([("x", date(2026, 1, d), "high", "P2", 0.9) for d in range(1, 6)], "entity string, d date, direction string, severity string, p double")
    watchers = spark.createDataFrame([("u", "x")], "user_id string, entity string")
    store = alerts.alert_rows(fired, watchers, "p", most=3)
    assert store.count() == 3
    one = store.head().alert_id
    n = alerts.alert_counts(alerts.acknowledge(store, "u", [one])).head()
    assert (n.n_alerts, n.n_unread) == (3, 2)


def test_asof_edges(spark):
    left = spark.createDataFrame([("x", date(2026, 1, 1)), ("x", date(2026, 1, 10)), ("y", date(2026, 1, 1)), (None, date(2026, 1, 1))], "k string, t date")
    right = spark.createDataFrame([("x", date(2026, 1, 2), 1.0), ("x", date(2026, 1, 2), 2.0), ("x", None, 9.0)], "k string, d date, v double")
    back = {(r.k, r.t.day): r.v for r in asof_join(left, right, "k", "t", "d", ["v"]).collect()}
    assert back == {("x", 1): None, ("x", 10): 2.0, ("y", 1): None, (None, 1): None}
    first = {(r.k, r.t.day): r.v for r in asof_join(left, right, "k", "t", "d", ["v"], before_first="first", tolerance_days=3).collect()}
    assert first[("x", 1)] == 1.0 and first[("y", 1)] is None


def test_interpolation_and_spikes(spark):
    rows = [("x", date(2026, 1, d), v) for d, v in ((1, 10.0), (2, None), (5, 18.0), (6, None))]
    df = spark.createDataFrame(rows, "entity string, d date, v double")
    assert [r.o for r in timeseries.interpolate(df, "entity", "d", "v", "o").orderBy("d").collect()] == [10, 12, 18, 18]
    assert [r.o for r in timeseries.interpolate(df, "entity", "d", "v", "o", widest=3).orderBy("d").collect()] == [10, None, 18, 18]
    spiky = spark.createDataFrame([("x", date(2026, 1, d), v) for d, v in ((1, 10.0), (2, 40.0), (3, 11.0), (4, 12.0))], "entity string, d date, v double")
    assert [r.v for r in timeseries.drop_spikes(spiky, "entity", "d", "v").orderBy("d").collect()] == [10, None, 11, 12]


def test_merges(spark):
    a = spark.createDataFrame([("x", 1, 1.0)], "k string, d int, v double")
    b = spark.createDataFrame([("x", 1, 2.0), ("x", 2, 3.0)], "k string, d int, v double")
    assert sorted((r.d, r.v) for r in merge.priority_union([a, b], ["k", "d"]).collect()) == [(1, 1.0), (2, 3.0)]
    row = spark.range(1).select(merge.toggle(F.array(F.lit("a"), F.lit("b")), F.lit("a")).alias("x"), merge.toggle(F.array(F.lit("a")), F.lit("c")).alias("y")).head()
    assert row.x == ["b"] and row.y == ["a", "c"]


def test_validation_raises(spark):
    df = spark.createDataFrame([("x", date(2026, 1, 2), 1.0, 1), ("x", date(2026, 1, 1), float("inf"), 2)], "entity string, d date, v double, seq int")
    found = quality.violations(df, spark.createDataFrame([("x",)], "entity string"), ["v"])
    assert {r.rule: r.n for r in found.collect()} == {"descending_date": 1, "not_finite_v": 1}
    with pytest.raises(ValueError, match="descending_date"):
        quality.require_clean(found)


def test_parsers(spark):
    html = "<table><tr><td>01/05/2026</td><td>$21.5</td></tr><tr><td>01/05/2026</td><td>9</td></tr><tr><td>x</td><td>1</td></tr></table>"
    df = spark.createDataFrame([("p", html)], "id string, html string")
    assert [(r.date, r.value) for r in parse.dated_values(df, "html", ["id"]).collect()] == [(date(2026, 1, 5), 21.5)]
    chart = '{"chart":{"result":[{"timestamp":[1767225600,1767312000],"indicators":{"quote":[{"close":[10.5,null]}]}}]}}'
    row = spark.createDataFrame([(chart, '[0, {"pe": 1, "bad": 2}]', '[{"a": 1, "b": 2}, 7, [1, 3], "x"]', "x = {dates: [\"a\",\"b\"], y: []}")], "c string, e string, t string, s string").select(
        parse.chart_closes(F.col("c")).alias("c"), parse.dereference(F.col("t")).alias("t"), parse.array_literal(F.col("s"), "dates").alias("s")
    ).head()
    assert [(x.date, x.close) for x in row.c] == [(date(2026, 1, 1), 10.5)] and row.t == '{"a": 7, "b": [7, "x"]}' and row.s == ["a", "b"]
    lines = spark.createDataFrame([(1, "As of 2026-01-02\na\nas of 2026-01-05 b")], "id int, t string")
    assert [r.as_of.day for r in parse.running_date(lines, "t", ["id"]).orderBy("line_no").collect()] == [2, 2, 5]


def test_files(spark, tmp_path):
    assert readers.read_json(spark, str(tmp_path / "none.json"), readers.STORE).count() == 0
    doc = tmp_path / "d.json"
    doc.write_text('{"generatedAt":"t","source":"s","indices":[{"id":"a","symbol":"s","points":[{"date":"2026-01-02","pe_ttm":1}]},{"id":null,"points":[]}]}')
    names, pts = readers.entities_and_points(readers.read_json(spark, str(doc), readers.DATASET))
    assert names.head().rank == 9999 and pts.head().pe_ttm == 1
    csv = tmp_path / "c.csv"
    csv.write_text("date,open,high,low,close\n2026-01-02,1,1,1,5\n2026-01-03,1,1,1,-1\n2027-01-01,1,1,1,7\n")
    assert [r.close for r in readers.close_csv(spark, str(csv), "2026-01-01", "2026-12-31").collect()] == [5]
    rates = tmp_path / "y.csv"
    rates.write_text("date,rate\n2026-01-02,4.2\n2026-01-03,.\n")
    assert [round(r.us10y_yield, 4) for r in readers.yield_csv(spark, str(rates)).collect()] == [0.042]
    df = spark.createDataFrame([("a", date(2026, 1, 1), 1.0), ("b", date(2026, 1, 1), 1.0)], "entity string, d date, v double")
    sinks.write_series(df, str(tmp_path / "s"))
    sinks.write_series(df.where("entity = 'a'"), str(tmp_path / "s"))
    assert [r.entity for r in spark.read.parquet(str(tmp_path / "s")).collect()] == ["a"]
    sinks.refresh_series(df.where("entity = 'b'"), str(tmp_path / "s"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 2


def test_rest_works_without_llm():
    """The library proper imports nothing of the optional subpackage."""
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "tidemark"
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "tidemark.llm" not in f.read_text()
