"""Literal cases for rules that are easy to read wrongly."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions import dates, text
from tidemark.operators import alerts, board, merge, stats, windows

D = dt.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).head()["x"]


def test_change_is_by_the_size_of_the_value_before(spark):
    rows = [("a", D(2024, 1, 2), -10.0), ("a", D(2025, 1, 2), 5.0), ("b", D(2025, 1, 2), 3.0), ("c", D(2024, 1, 2), 0.0), ("c", D(2025, 1, 2), 3.0)]
    df = spark.createDataFrame(rows, "entity string, d date, pe_ttm double")
    for out in (stats.latest_stats(df), stats.latest_row_stats(df)):
        assert {r.entity: r.change_1y for r in out.collect()} == {"a": 1.5, "b": 0.0, "c": 0.0}


def test_recent_override_counts_from_the_last_day_of_the_base(spark):
    base = spark.createDataFrame([("a", D(2025, 1, 10), 1.0), ("a", D(2025, 1, 1), 1.0)], "entity string, d date, v double")
    over = spark.createDataFrame([("a", D(2025, 1, 1), 2.0), ("a", D(2025, 1, 6), 2.0), ("a", D(2025, 3, 1), 2.0), ("b", D(2020, 1, 1), 2.0)], "entity string, d date, v double")
    got = {(r.entity, r.d): r.v for r in merge.recent_override(base, over, "entity", "d", 5).collect()}
    assert got == {("a", D(2025, 1, 10)): 1.0, ("a", D(2025, 1, 1)): 1.0, ("a", D(2025, 1, 6)): 2.0, ("a", D(2025, 3, 1)): 2.0, ("b", D(2020, 1, 1)): 2.0}


@pytest.mark.parametrize(("trailing", "forward", "want"), [(20, 18, True), (20, 20, False), (20, 8.9, False), (20, 19.1, False), (5, 4.3, False), (90, 70, False), (20, None, False), (4, 3, False)])
def test_plausible_pair(spark, trailing, forward, want):
    assert one(spark, board.plausible_pair(F.lit(trailing).cast("double"), F.lit(forward).cast("double"))) is want


def test_epochs(spark):
    day = lambda x: one(spark, dates.epoch_date(F.lit(x).cast("double")))
    assert day(1_700_000_000) == D(2023, 11, 14) == day(1_700_000_000_000)
    assert day(0) is None and day(-5) is None and day(2e11) == D(1970, 1, 1) + dt.timedelta(days=2e11 // 86400)


def test_rejected_pages_and_entities(spark):
    bad = lambda x: one(spark, text.is_rejected_payload(F.lit(x)))
    assert bad(None) and bad(" ") and bad("<TITLE>Just a moment") and bad("Too Many Requests") and bad("just a moment ... cf-chl")
    assert not bad("captcha") and not bad("just a moment") and not bad("forbidden")
    assert one(spark, text.decode_entities(F.lit("a&amp;quot;b&#x27;c&#x2F;d&nbsp;e&#39;"))) == "a\"b'c/d e'"


def test_framed_ranks_by_definition(spark):
    rows = [("a", i, float((i * 7919) % 23)) for i in range(700)] + [("b", 0, 1.0), ("b", 1, None), ("b", 2, 1.0)]
    df = spark.createDataFrame(rows, "entity string, d int, v double")
    got = {(r.entity, r.d): (r.some, r.full) for r in windows.framed_ranks(df, "entity", "d", "v", {"some": 40, "full": None}).collect()}
    v = [x for e, _, x in rows if e == "a"]
    for i in range(700):
        frames = v[max(0, i - 39) : i + 1], v[: i + 1]
        assert got["a", i] == pytest.approx(tuple(sum(x <= v[i] for x in f) / len(f) for f in frames))
    assert got["b", 0] == (1.0, 1.0) and got["b", 2] == (1.0, 1.0)


def test_daily_update_keeps_its_state(spark):
    """An alert on a crossing, none within the cooldown, the direction kept up to date, other state untouched."""
    p = [0.5, 0.9, 0.5, 0.9]
    rows = [("x", D(2026, 1, 5 + i), v) for i, v in enumerate(p)] + [("y", D(2026, 1, 5), 0.99)]
    points = spark.createDataFrame(rows, "entity string, d date, p double")
    watch = spark.createDataFrame([("u", e, 85.0, 15.0, 3) for e in ("x", "y", "unknown")], "user_id string, entity string, upper double, lower double, cooldown int")
    state = spark.createDataFrame([("v", "x", None, "low")], "user_id string, entity string, last_triggered date, last_direction string")
    for days, fired, then in ((2, 1, D(2026, 1, 6)), (3, 0, D(2026, 1, 6)), (4, 0, D(2026, 1, 6))):
        new, state = alerts.latest_alerts(points.where(F.col("d") < D(2026, 1, 5 + days)), watch, state, "p")
        assert new.count() == fired
        state = spark.createDataFrame(state.collect(), state.schema)
        mine = {(r.user_id, r.entity): (r.last_triggered, r.last_direction) for r in state.collect()}
        assert mine == {("v", "x"): (None, "low"), ("u", "x"): (then, "neutral" if days == 3 else "high")}
