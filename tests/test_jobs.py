"""Stores, builds, payloads and parsers on small cases: reruns, ties, odd and malformed inputs."""

import datetime as dt
import json
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.operators import alerts, anchored, board, compare, payloads, snapshots
from tidemark.plans import build, catalog, stores
from tidemark.sources import facts, providers, scripts, tiers, versions
from tidemark.streaming.alerts import mark_turns, stream_alerts

D = dt.date


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns or df.columns) for r in df.collect()), key=repr)


# Versions and stores


def test_manifest_swap_keeps_the_old_one_until_it_is_replaced(spark, tmp_path):
    root = str(tmp_path)
    assert versions.read_manifest(spark, root) == {}
    versions.swap_manifest(spark, root, {"version": 1})
    versions.swap_manifest(spark, root, {"version": 2, "text": "a\nb"})
    assert versions.read_manifest(spark, root) == {"version": 2, "text": "a\nb"}
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["manifest.json"]


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    root, schema = str(tmp_path), "user_id string, n int"
    one = spark.createDataFrame([(f"u{k}", k) for k in range(40)], schema)
    parts = versions.stage_table(spark, root, {}, "t", one, "user_id", 1, 4)
    manifest = {"tables": {"t": parts}}
    bucket = one.where("n = 3").select(versions.bucket_of("user_id", 4).alias("b")).head().b
    new = one.where(versions.bucket_of("user_id", 4) == bucket).where("n <> 3").withColumn("n", F.col("n") + 100)
    parts = versions.stage_table(spark, root, manifest, "t", new, "user_id", 2, 4, [bucket])
    assert sorted(parts.values()) == [1, 1, 1, 2] and parts[str(bucket)] == 2
    got = {r.user_id: r.n for r in versions.read_table(spark, root, {"tables": {"t": parts}}, "t", schema).collect()}
    assert "u3" not in got and len(got) == 39 and all(n in (int(u[1:]), int(u[1:]) + 100) for u, n in got.items())
    # A bucket without rows any more is gone.
    parts = versions.stage_table(spark, root, {"tables": {"t": parts}}, "t", new.limit(0), "user_id", 3, 4, [bucket])
    assert str(bucket) not in parts and len(parts) == 3


def ranked(spark, values, entity="a"):
    return spark.createDataFrame([(entity, D(2024, 1, 1) + dt.timedelta(days=i), v, v) for i, v in enumerate(values)], "entity string, d date, v double, percentile double")


def watch(spark, root, cooldown=2):
    lists = spark.createDataFrame([("u", ["a", "unknown"], 85.0, 15.0, cooldown)], "user_id string, watch_ids array<string>, upper double, lower double, cooldown int")
    stores.put_watchlists(spark, root, lists, "lists")


def test_runs_merge_and_acknowledgements_stay(spark, tmp_path):
    root = str(tmp_path)
    assert all(df.isEmpty() for df in stores.load(spark, root).values())
    watch(spark, root)
    stores.run_update(spark, root, ranked(spark, [0.5, 0.9]), "1")
    stores.acknowledge(spark, root, "u", "read")
    v = stores.run_update(spark, root, ranked(spark, [0.5, 0.9, 0.5, 0.1]), "2")["version"]
    assert stores.run_update(spark, root, ranked(spark, [0.5, 0.9, 0.5, 0.1, 0.99]), "2")["version"] == v
    got = rows_of(stores.load(spark, root)["alerts"], "d", "direction", "read")
    assert got == [(D(2024, 1, 2), "high", True), (D(2024, 1, 4), "low", False)]
    # A run under another name over the same dates fires nothing again: the cooldown holds.
    stores.run_update(spark, root, ranked(spark, [0.5, 0.9, 0.5, 0.1]), "3")
    assert stores.load(spark, root)["alerts"].count() == 2


def test_a_run_that_fails_before_publication_is_repeated(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    watch(spark, root)
    publish = versions.swap_manifest
    monkeypatch.setattr(versions, "swap_manifest", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        stores.run_update(spark, root, ranked(spark, [0.5, 0.9]), "1")
    assert stores.load(spark, root)["alerts"].isEmpty()
    monkeypatch.setattr(versions, "swap_manifest", publish)
    stores.run_update(spark, root, ranked(spark, [0.5, 0.9]), "1")
    assert stores.load(spark, root)["alerts"].count() == 1


@pytest.mark.parametrize(("then", "fires"), [(D(2023, 12, 31), True), (D(2024, 1, 2), False), (D(2024, 1, 1), True), (D(2030, 1, 1), True), (None, True)])
def test_last_trigger_that_the_series_has_not_holds_nothing_back(spark, then, fires):
    """The series has three dates; the last crosses. With a cooldown of two only a trigger on the second holds it back."""
    state = spark.createDataFrame([("u", "a", then, "low")], "user_id string, entity string, last_triggered date, last_direction string")
    watchers = spark.createDataFrame([("u", "a", 85.0, 15.0, 2)], "user_id string, entity string, upper double, lower double, cooldown int")
    fired, after = alerts.latest_alerts(ranked(spark, [0.1, 0.5, 0.9]), watchers, state, "percentile")
    assert (fired.count() == 1) is fires
    assert after.head().last_triggered == (D(2024, 1, 3) if fires else then)


def test_newest_alerts_of_old_and_new(spark):
    schema = "alert_id string, user_id string, d date, read boolean"
    stored = spark.createDataFrame([("1", "u", D(2024, 1, 1), True), ("2", "u", D(2024, 1, 2), True), ("9", "w", D(2020, 1, 1), False)], schema)
    fired = spark.createDataFrame([("2", "u", D(2024, 1, 2), False), ("3", "u", D(2024, 1, 3), False)], schema)
    assert rows_of(alerts.merge_alerts(stored, fired, most=2), "alert_id", "read") == [("2", True), ("3", False), ("9", False)]


# Builds


def series(spark, lengths, needed=1.0):
    rows = [(e, D(2020, 1, 1) + dt.timedelta(days=i), i, 10.0 + i, needed if e != "none" else None) for e, n in lengths.items() for i in range(n)]
    return spark.createDataFrame(rows, "entity string, d date, seq int, pe double, fwd double")


def test_build_falls_back_by_entity_and_publishes_all_or_nothing(spark, tmp_path):
    root, rules = str(tmp_path), build.Rules(("pe", "fwd"), "fwd", "pe", None, 5)
    names = spark.createDataFrame([("a",), ("07",)], "entity string")
    with pytest.raises(build.BuildFailed) as e:
        build.build_dataset(spark, root, series(spark, {"a": 9, "07": 2}), names, "2030-01-01", rules)
    assert e.value.reasons == [("07", "insufficient closes")] and versions.read_manifest(spark, root) == {}
    build.build_dataset(spark, root, series(spark, {"a": 9, "07": 6}), names, "2030-01-01", rules)
    m = build.build_dataset(spark, root, series(spark, {"a": 7, "07": 1}), names, "2020-01-04", rules)
    assert m["versions"][-1]["source"] == "free-live-proxy-v6+history-fallback-1"
    # History ends with the build; ids that look like numbers stay texts.
    assert rows_of(build.read_entities(spark, root), "entity", "origin", "from_version", "n_points") == [("07", "history", 1, 4), ("a", "live", 2, 7)]
    assert sorted({r.entity for r in build.read_version(spark, root).collect()}) == ["07", "a"]
    with pytest.raises(build.BuildFailed):
        build.build_dataset(spark, root, series(spark, {"a": 7, "07": 9, "none": 9}), names.union(spark.createDataFrame([("none",)], "entity string")), "2030-01-01", rules)
    assert versions.read_manifest(spark, root)["version"] == 2
    m = build.build_dataset(spark, root, series(spark, {"a": 1}), names, "2030-01-01", rules)
    assert m["versions"][-1]["source"].endswith("+history-fallback-2+no-live-refresh")


def test_synthetic_versions_are_no_history(spark, tmp_path):
    root, rules = str(tmp_path), build.Rules(("pe", "fwd"), "fwd", "pe", None, 5)
    names = spark.createDataFrame([("a",)], "entity string")
    build.build_dataset(spark, root, series(spark, {"a": 9}), names, "2030-01-01", rules, ("Synthetic",))
    with pytest.raises(build.BuildFailed):
        build.build_dataset(spark, root, series(spark, {"a": 1}), names, "2030-01-01", rules)


# Snapshots


def test_accepted_values_follow_a_plain_loop(spark):
    rng = random.Random(8)
    days = [D(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]
    closes = [(e, d, 0.0 if e == "b" and i == 30 else 100 * 1.02 ** rng.randint(-3, 3)) for e in "ab" for i, d in enumerate(days) if i % 2 == 0]
    shots = [(e, d, rng.choice([10.0, 10.05, -10.0, None, float("nan"), 0.0]), rng.choice([5.0, 5.2]), 2.0, None, rng.choice(["yahoo-quote-api-latest", "Yahoo-Trailing-PE-timeseries+yahoo-forward-pe-timeseries", "other", None])) for e in "abc" for d in days]
    got = snapshots.effective_snapshots(spark.createDataFrame(shots, "entity string, d date, pe_ttm double, pe_forward double, pb double, peg double, source string"), spark.createDataFrame(closes, "entity string, d date, close double"))
    want = {}
    for e in "ab":
        mine = [(d, c) for x, d, c in closes if x == e]
        close = lambda d: next((c for x, c in reversed(mine) if x <= d), mine[0][1])  # noqa: E731, B023
        for k, m in enumerate(("pe_ttm", "pe_forward", "pb")):
            last = None
            for x, d, *v, source in shots:
                source, value = (source or "").lower(), v[k]
                explicit = "yahoo-quote-api-latest" in source
                if x != e or value is None or value != value or abs(value) < 1e-8 or not (explicit or (m != "pb" and "timeseries" in source)):
                    continue
                keep = last is None
                if last and close(last[0]) > 0 and close(d) > 0:
                    r = close(d) / close(last[0])
                    by = last[1] if explicit else last[1] * r
                    off = float("inf") if last[1] * value <= 0 else max(abs(value / by), abs(by / value))
                    keep = not (off <= 1.01 and max(r, 1 / r) > 1.01) if explicit else off > 1.01
                if keep:
                    last = (d, value)
                    want[e, d, m] = value
    assert {(r.entity, r.d, m): r[m] for r in got.collect() for m in snapshots.METRICS if r[m] is not None} == want


# Payloads


def test_spikes_go_after_the_merge_and_dense_series_go_first(spark):
    day = lambda i: D(2024, 1, 1) + dt.timedelta(days=i)
    metrics = "pe_ttm double, pe_forward double, pb double, peg double"
    anchors = spark.createDataFrame([("x", day(i), 50.0, 20.0 if i != 20 else 40.0, 1.0, None) for i in range(0, 40, 10)], f"entity string, d date, {metrics}")
    latest = spark.createDataFrame([("x", 10.0, 21.0, None, 2.0, "s"), ("lone", None, None, None, None, "t"), ("y", 0.0, 9.0, None, None, "")], f"entity string, {metrics}, source string")
    long = spark.createDataFrame([("x", "pe_ttm", day(i), 11.0) for i in range(30)] + [("x", "pb", day(5), 7.0), ("x", "pb", day(10), 7.0), ("z", "pb", day(1), 3.0)], "entity string, metric string, d date, value double")
    rows, now = payloads.merge_payloads(anchors, latest, long, F.to_date(F.lit("2024-03-01")), {"X": 2.0})
    got = {(r.entity, r.d): (r.pe_ttm, r.pe_forward, r.pb) for r in rows.collect()}
    # 50 lies five times off the latest value and a dense series stands in: those anchors go. The forward pulse goes as well.
    assert got["x", day(0)] == (11.0, 20.0, 1.0) and got["x", day(20)] == (11.0, None, 1.0) and got["x", day(30)] == (None, 20.0, 1.0)
    # A coarse series only fills.
    assert got["x", day(5)][2] == 7.0 and got["x", day(10)][2] == 1.0
    assert rows_of(now) == [("x", 11.0, 21.0, 7.0, 2.0, "s+companiesmarketcap-pe-ratio+companiesmarketcap-pb-ratio"), ("y", None, 9.0, None, None, ""), ("z", None, None, 3.0, None, "companiesmarketcap-pb-ratio")]


def test_later_stages_see_open_keys_only(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "k string")
    asked = []

    def stage(name, table):
        def read(open_):
            asked.append((name, sorted(r.k for r in open_.collect())))
            return spark.createDataFrame(table, "k string, n int").join(open_, "k", "left_semi")

        return name, read

    first, second, third = [("a", 5), ("b", 2), ("d", 0)], [("b", 2), ("c", 9)], [("b", 1), ("a", 99)]
    out = payloads.read_in_stages(keys, [stage("1", first), stage("2", second), stage("3", third)], "k", F.col("n") >= 4, F.col("n"))
    assert rows_of(out, "k", "n", "stage") == [("a", 5, "1"), ("b", 2, "1"), ("c", 9, "2")]
    assert asked == [("1", ["a", "b", "c", "d"]), ("2", ["b", "c", "d"]), ("3", ["b", "d"])]
    asked.clear()
    payloads.read_in_stages(keys.where("k = 'a'"), [stage("1", first), stage("2", second)], "k", F.col("n") >= 4, F.col("n"))
    assert asked == [("1", ["a"])]


# Parsers


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('x={data:{a:[1,[2,"]"],3],b:"a:[9]",c:{a:[7]},d:[1,2]}}', {"a": [1, [2, "]"], 3], "d": [1, 2]}),
        ("{data:{'q':['no json'],r:[null,1e3],r:[5],s:[\"\\\"[\\\\\"]}}", {"r": [None, 1000.0], "s": ['"[\\']}),
        ('t="data:{";u={data : {a:[1\n,2]}}', {"a": [1, 2]}),
        ("{metadata:{a:[1]}}", {}),
        ("{data:{a:[1,2}", {}),
        ("data:{a:f([1]),b:(1,[2]),`k`:[3]}", {}),
        ("", {}),
        (None, {}),
    ],
)
def test_literal_arrays(text, want):
    got = {k: json.loads(v) for k, v in scripts.literal_arrays(text, "data").items()}
    assert {k: v for k, v in got.items() if not k.startswith("`")} == want


def test_pages_that_are_no_payload_give_nothing(spark):
    docs = spark.createDataFrame([("a", None), ("b", ""), ("c", "{}"), ("d", '{"nodes":[1,2,{"data":[]}]}'), ("e", "financialData:{pe:[1]}")], "k string, text string")
    rows, latest = scripts.script_ratios(docs, "k", "text")
    assert rows.isEmpty() and latest.isEmpty() and scripts.income_rows(docs, "k", "text").isEmpty() and scripts.statistics_ratios(docs, "k", "text").isEmpty()
    assert facts.quarterly_facts(docs, "k", "text", "eps").isEmpty() and tiers.monthly_page(docs, "k", "text").isEmpty() and tiers.statistics_text(docs, "k", "text").isEmpty()


def test_fullest_measure_wins_however_late_the_other_was_filed(spark):
    entry = lambda end, val, **more: {"end": end, "val": val, "fp": "Q1", **more}
    unit = lambda *rows: {"units": {"USD/shares": list(rows)}}
    gaap = {
        "EarningsPerShareDiluted": unit(entry("2020-03-31", "1.5", filed="2020-05-01", start="2020-01-01"), entry("2020-03-31", 9, filed="2021-01-01", start="2019-04-01"), entry("2020-06-30", "x"), entry("2020-09-30", 2, fp="FY")),
        "EarningsPerShareBasic": unit(entry("2020-03-31", 7, filed="2029-01-01")),
    }
    two = {"EarningsPerShareBasic": unit(entry("2020-03-31", 3.0), entry("2020-06-30", -4, filed="2020-01-01"), entry("2020-06-30", 4, filed="2020-01-01"), entry("1999-12-31", 5)), "EarningsPerShareDiluted": {"units": {"EUR/shares": [entry("2020-03-31", 8)], "USD/shares": []}}}
    docs = spark.createDataFrame([("a", json.dumps({"facts": {"us-gaap": gaap}})), ("b", json.dumps({"facts": {"us-gaap": two, "other": {}}}))], "k string, text string")
    got = rows_of(facts.quarterly_facts(docs, "k", "text", "eps"), "k", "date", "value", "available", "measure")
    assert got == [
        ("a", D(2020, 3, 31), 1.5, D(2020, 5, 1), "us-gaap:EarningsPerShareDiluted"),
        ("b", D(2020, 3, 31), 3.0, D(2020, 3, 31), "us-gaap:EarningsPerShareBasic"),
        ("b", D(2020, 6, 30), -4.0, D(2020, 6, 30), "us-gaap:EarningsPerShareBasic"),
    ]


def test_each_tier(spark):
    page = lambda text: spark.createDataFrame([(1, text)], "k int, text string")
    table, line = "<td>Jan 2020</td><td>1,0.5</td><td>Feb 2020</td> <td>12</td><td>February 2020</td><td>13</td>", "<p>March 2020 | 14</p>"
    assert rows_of(tiers.monthly_table_or_lines(page(table + line), "k", "text")) == [(1, D(2020, 2, 29), 12.0)]
    assert rows_of(tiers.monthly_table_or_lines(page(line + "<li>Apr&nbsp;2020 251"), "k", "text")) == [(1, D(2020, 3, 31), 14.0)]
    records = "".join(f'{{"date":"2020-{m:02}-15","value":{m}}}' for m in range(1, 12))
    assert (1, D(2020, 12, 31), 5.0) in rows_of(tiers.monthly_page(page(records + "<td>Dec 2020</td><td>5</td>"), "k", "text"))
    assert (1, D(2020, 12, 31), 5.0) not in rows_of(tiers.monthly_page(page(records + '["2019-12", 3]<td>Dec 2020</td><td>5</td>'), "k", "text"))


# Anchored series and comparisons


def test_anchored_series_against_a_plain_loop(spark):
    rng = random.Random(2)
    start = D(2020, 1, 1)
    limits = anchored.Limits(2.0, 60.0, 30, 10, 12, 0.8, 1.3)
    points = [(e, start + dt.timedelta(days=i), rng.choice([-3.0, 10.0, 15.5, 20.0, None])) for e in "abcd" for i in range(0, 200, 2)]
    anchors = [(e, start + dt.timedelta(days=i), v, k) for e in "abx" for k, (i, v) in enumerate([(21, 12.0), (21, 18.0), (40, 90.0), (44, 25.0), (71, 11.0), (120, 14.0), (131, 9.0)])] + [("c", start, 12.0, 0)]
    got = anchored.anchored_override(spark.createDataFrame(points, "entity string, d date, v double"), spark.createDataFrame(anchors, "entity string, d date, value double, seq int"), "v", limits)
    clip = lambda x, lo, hi: max(lo, min(hi, x))
    want = {}
    for e in "abcd":
        mine = sorted({d: v for x, d, v, _ in anchors if x == e and 2 <= v <= 60}.items())
        good = [(d, v) for x, d, v in points if x == e and v and v > 0]

        def at(d):
            left, right = [p for p in good if p[0] <= d], [p for p in good if p[0] >= d]  # noqa: B023
            if not left or not right:
                return (left[-1] if left else right[0])[1]
            (a, x), (b, y) = left[-1], right[0]
            return x if a == b else x + (y - x) * (d - a).days / (b - a).days

        scales = [clip(v / at(d), 0.8, 1.3) for d, v in mine]
        for x, d, v in points:
            if x != e:
                continue
            if not mine or v is None or v <= 0:
                want[e, d] = v
                continue
            s, k = None, 0
            while k + 1 < len(mine) and d > mine[k + 1][0]:
                k += 1
            if d < mine[0][0]:
                s = scales[0] if (mine[0][0] - d).days <= 12 else None
            elif d > mine[-1][0]:
                s = scales[-1] if (d - mine[-1][0]).days <= 10 else None
            else:
                r = min(len(mine) - 1, k + 1)
                width = (mine[r][0] - mine[k][0]).days
                s = scales[k] if r == k else scales[k] + (scales[r] - scales[k]) * (d - mine[k][0]).days / width if width <= 30 else None
            want[e, d] = clip(v * (s or 1), 2.0, 60.0)
    for r in got.collect():
        assert r.v == want[r.entity, r.d] or abs(r.v - want[r.entity, r.d]) < 1e-9, (r, want[r.entity, r.d])
    assert got.count() == len(points)


def test_compared_series_keep_ranks_of_their_range(spark):
    day = lambda i: D(2020, 1, 1) + dt.timedelta(days=i)
    rows = [("a", day(i), float(i % 10)) for i in range(900)] + [("b", day(i), 1.0) for i in range(850, 900)] + [("one", day(880), 1.0)]
    df = spark.createDataFrame(rows, "entity string, d date, value double")
    out = compare.compare_rows(df, ["a", "b", "one", "gone"], 1)
    got = {(r.entity, r.d): r.percentile_full for r in out.collect()}
    assert {e for e, _ in got} == {"a", "b"} and min(d for _, d in got) == day(850)
    ranked_from = [i for i in range(900) if day(i) >= D(day(899).year - 1, day(899).month, day(899).day)]
    seen = [i % 10 for i in ranked_from if i <= 860]
    assert got["a", day(860)] == sum(x <= 0 for x in seen) / len(seen)
    assert compare.chosen([], list("abcdef")) == list("abcd") and len(compare.chosen(list("abcdefghij"), [])) == 8
    assert compare.compare_rows(df, ["one"], 1).collect() == []


def test_forward_values_start_where_they_are_known(spark):
    df = spark.createDataFrame([(e, D(2024, 1, i), 1.0 * i, 2.0) for e in "ab" for i in range(1, 6)], "entity string, d date, pe_forward double, pe_ttm double")
    starts = spark.createDataFrame([("a", D(2024, 1, 3))], "entity string, forward_start date")
    assert [(r.entity, r.d.day) for r in compare.metric_rows(df, "pe_forward", starts).orderBy("entity", "d").collect()] == [("a", 3), ("a", 4), ("a", 5), ("b", 5)]
    assert compare.metric_rows(df, "pe_ttm", starts).count() == 10


# Pages of single providers


def test_provider_pages_that_are_broken(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, 'data = [{"d":1,"v":}];data = {"2001":"x"};'), (4, '{"timeseries":{"result":[null,{"r":null},{"r":[null,{"asOfDate":null}]}]}}'), (5, '<tr><td class="fav">')], "k int, text string")
    assert providers.ratio_series(docs, "k", "text").isEmpty() and providers.top_companies(docs, "k", "text").isEmpty()
    assert all(df.isEmpty() for df in providers.ratio_timeseries(docs, "k", "text", "r"))
    assert [r.x for r in docs.select(providers.page_ratio(F.col("text")).alias("x")).collect()] == [None] * 5


def test_longest_array_and_fullest_years(spark):
    page = 'data = [{"d":1600000000,"v":1}]; data = [{"d":1600000000000,"v":2},{"d":1600000000,"v":3},{"d":-5,"v":4}];'
    years = 'data={"2001":1}; data={"2001":2,"2002":3,"20":9}; data={"2003":4,"2004":5};'
    docs = spark.createDataFrame([("array", page + years), ("years", years)], "k string, text string")
    assert rows_of(providers.ratio_series(docs, "k", "text")) == [("array", D(2020, 9, 13), 3.0), ("years", D(2001, 12, 31), 2.0), ("years", D(2002, 12, 31), 3.0)]


def test_market_date_may_lie_a_day_ahead(spark):
    at = lambda d: providers.market_date(spark.createDataFrame([(d,), (D(2024, 1, 1),)], "date date"), F.to_date(F.lit("2024-03-01"))).head()[0]
    assert at(D(2024, 3, 2)) == D(2024, 3, 2) and at(D(2024, 3, 3)) is None


def test_latest_value_without_a_usable_baseline_is_taken(spark):
    series = spark.createDataFrame([("a", D(2024, 1, 1), 20.0), ("a", D(2024, 2, 1), 22.0), ("low", D(2024, 1, 1), 3.0)], "entity string, d date, value double")
    c = [("a", D(2024, 1, 16), 21.5), ("a", D(2024, 3, 1), 24.0), ("a", D(2024, 6, 1), 60.0), ("a", D(2023, 12, 1), 60.0), ("low", D(2024, 1, 2), 30.0), ("none", D(2024, 1, 2), 30.0), ("none", D(2024, 1, 3), 90.0)]
    out = board.accept_latest(series, spark.createDataFrame(c, "entity string, d date, candidate double"))
    assert {(r.entity, r.d): r.accepted for r in out.collect()} == dict(zip([(e, d) for e, d, _ in c], [True, False, True, True, True, True, False], strict=True))


def test_stream_cooldown_counts_the_days_of_the_series(spark, tmp_path):
    """A crossing on the day after a long break is held back if few own days have passed."""
    days = [D(2024, 1, 1), D(2024, 1, 2), D(2024, 1, 3), D(2024, 3, 1), D(2024, 3, 4), D(2024, 3, 5), D(2024, 3, 6)]
    rows = [("a", dt.datetime.combine(d, dt.time(12)), p) for d, p in zip(days, [0.5, 0.9, 0.5, 0.9, 0.5, 0.9, 0.9], strict=True)]
    spark.createDataFrame(rows, "entity string, at timestamp, percentile double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("entity string, at timestamp, percentile double").parquet(str(tmp_path / "in"))
    q = stream_alerts(stream, cooldown=4).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = [r["at"].date() for r in spark.read.schema("at timestamp").parquet(str(tmp_path / "out")).orderBy("at").collect()]
    assert got == [D(2024, 1, 2), D(2024, 3, 5)]


def test_streaming_counts_has_open_windows_and_untimed_events(spark, tmp_path):
    """The last window before the watermark's delay, one within it, and rows without a time are all counted."""
    at = dt.datetime(2024, 1, 1, 10)
    rows = [(at, "a", 1.0), (at + dt.timedelta(minutes=59), "a", 2.0), (at + dt.timedelta(minutes=61), "a", 4.0), (at + dt.timedelta(minutes=62), "b", None), (None, "a", 8.0), (None, None, None)]
    spark.createDataFrame(rows, "ts timestamp_ntz, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    got = {(r["start"], r["event_type"], r["n"], r["total"]) for r in catalog.streaming_counts(spark, str(tmp_path)).collect()}
    later = at + dt.timedelta(hours=1)
    assert got == {(at, "a", 2, 3.0), (later, "a", 1, 4.0), (later, "b", 1, None), (None, "a", 1, 8.0), (None, None, 1, None)}


def test_streaming_counts_adds_up_to_the_table(spark):
    sf = "/root/testdata/sf0.001"
    assert catalog.streaming_counts(spark, sf).agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def _alerts_by_loop(batches, cooldown, upper=0.85, lower=0.15):
    """Every row of a batch in time order, one after the other."""
    states, out = {}, []
    for batch in batches:
        untimed = set()
        for e, at, p in sorted(batch, key=lambda r: (r[1] is None, r[1] or D(1, 1, 1), r[2], str(r[0]))):
            zone, fired, seen, day = states.get(e, (None, None, None, 0))
            if at is not None and seen is not None and at <= seen or at is None and e in untimed:
                continue
            now = "high" if p >= upper else "low" if p <= lower else "neutral"
            day += at is None or seen is None or at.date() != seen.date()
            if zone is not None and now not in ("neutral", zone) and (fired is None or day - fired >= cooldown):
                out.append((e, at, p, now, "P1" if p >= 0.95 or p <= 0.05 else "P2"))
                fired = day
            if at is None:
                untimed.add(e)
            else:
                states[e] = now, fired, at, day
    return sorted(out, key=repr)


@pytest.mark.parametrize("cooldown", [0, 1, 3])
def test_stream_alerts_against_a_loop(spark, tmp_path, cooldown):
    """Batches that overlap in time, days apart by the number of groups, equal moments, rows without a time."""
    rng, schema = random.Random(cooldown), "entity string, at timestamp, percentile double"
    batches = []
    for n, (lo, hi) in enumerate([(0, 150), (60, 150), (149, 152), (0, 220)]):
        batch = [(rng.choice(["a", "b", "c", None]), dt.datetime(2024, 1, 1) + dt.timedelta(days=rng.randrange(lo, hi), hours=rng.randrange(24)), rng.choice([0.01, 0.15, 0.5, 0.5, 0.85, 0.99])) for _ in range(900)]
        batches.append([*batch, ("a", None, 0.99), ("a", None, 0.01), ("b", None, 0.99), ("late", dt.datetime(2024, 1, 9 - n), 0.9)])
        spark.createDataFrame(batches[-1], schema).coalesce(3).write.parquet(str(tmp_path / f"all{n}"))
    for n in range(len(batches)):
        spark.read.parquet(str(tmp_path / f"all{n}")).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        stream_alerts(stream, cooldown=cooldown).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).select("entity", "at", "percentile", "direction", "severity").collect()]
    assert sorted(got, key=repr) == _alerts_by_loop(batches, cooldown)


def test_mark_turns_leaves_an_entity_to_no_task(spark):
    """Of 40000 rows of one series the fold keeps three an hour, and no task puts a tenth of them in order."""
    df = spark.range(40000).selectExpr("'a' entity", "timestamp_micros(id * 12960000) at", "pmod(id * 7919, 100) / 100 percentile")
    rows = mark_turns(df, 0.85, 0.15, 5)
    assert rows.count() == 40000
    assert {r["n"] for r in rows.where("turn").groupBy("hour").agg(F.count(F.lit(1)).alias("n")).collect()} == {3}
    assert rows.groupBy(F.spark_partition_id()).count().agg({"count": "max"}).first()[0] < 4000


def test_streaming_alerts_with_untimed_events_against_sql(spark, tmp_path):
    events = [("a", dt.datetime(2024, 1, 1 + i), 50.0) for i in range(6)] + [("a", None, 3.0), ("a", None, 90.0), ("b", dt.datetime(2024, 1, 1), 1.0), ("b", None, 99.0)]
    spark.createDataFrame(events, "event_type string, ts timestamp_ntz, value double").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    got = [tuple(r) for r in catalog.streaming_alerts(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(con.sql(catalog.SQL["streaming_alerts"]).fetchall(), key=repr) and len(got) == 2
