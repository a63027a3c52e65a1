"""Drift, instants and pay: edge cases and brute-force versions."""

import datetime as dt
import json
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from skein.operators import drift, instants, pay

LINES = "table_name string, row_id bigint, account_id string, file_no int, file_name string, line_number int, raw_line string, clash string"


def lines(spark, files):
    rows, n = [], 0
    for no, objects in files.items():
        for i, o in enumerate(objects):
            n += 1
            rows.append(("boss_jobs", n, "A", no, f"f{no}", i, o if isinstance(o, str) or o is None else json.dumps(o, ensure_ascii=False), "x"))
    return spark.createDataFrame(rows, LINES)


def changes(df):
    return drift.drift(drift.ingest(df, {"boss_jobs": {"id": ("posting_id", "text"), "title": ("title", "text")}}))


def titles(k):
    return ["数据工程师", "测试工程师", "运维专家", "前端开发", "后端开发"][k % 5]


def test_drift_reports_each_kind_of_change(spark):
    one = [{"id": k, "title": titles(k), "city": "北京", "pay": f"{k}K"} for k in range(10)]
    two = [{"id": k, "name": {"name": titles(k + 1)}, "city": ["北京"], "remote": True} for k in range(10)]
    bad = ['{"id": 1', None, "", "[1]", '{"id": 1} {"id": 2}', '{"id": 1} x']
    got = {(r.change_kind, r.old_field, r.new_field) for r in changes(lines(spark, {1: one, 3: two + bad})).collect()}
    assert got == {("renamed", "title", "name"), ("type_changed", "title", "name"), ("type_changed", "city", "city"), ("removed", "pay", ""), ("added", "", "remote")}


def test_drift_of_nothing(spark):
    assert changes(lines(spark, {1: [{"a": 1}]})).count() == 0
    assert changes(lines(spark, {1: [None, ""]})).count() == 0
    assert changes(lines(spark, {})).count() == 0


def test_rescued_values_are_replayed_and_nothing_is_lost(spark):
    targets = {"boss_jobs": {"title": ("title", "text"), "city": ("city", "text")}}
    files = {1: [{"title": titles(k), "city": "北京"} for k in range(6)], 2: [{"职位": titles(k), "city": ["上海"], "x": {"y": k}} for k in range(6)] + ["broken"]}
    held = drift.ingest(lines(spark, files), targets)
    found = drift.drift(held)
    out = drift.replay(held, drift.promotions(found, targets), targets).orderBy("row_id").collect()
    assert [r.title for r in out] == [titles(k) for k in range(6)] * 2 + [None]
    assert [r.city for r in out] == ["北京"] * 6 + ["上海"] * 6 + [None]
    assert json.loads(out[6].rescued) == {"x": {"y": 0}} and out[0].rescued is None and not out[12].readable
    # A rename that the register refuses stays rescued.
    register = spark.createDataFrame([("boss_jobs", "title", "职位", False)], "table_name string, old_field string, new_field string, approved boolean")
    out = drift.replay(held, drift.promotions(found, targets, register), targets).orderBy("row_id").collect()
    assert [r.title for r in out][6:] == [None] * 7 and json.loads(out[6].rescued) == {"x": {"y": 0}, "职位": titles(0)}


def test_kinds_are_enforced_and_uncastable_values_rescued(spark):
    targets = {"boss_jobs": {"n": ("n", "number"), "count": ("n", "number"), "at": ("at", "timestamp")}}
    rows = [{"n": 3}, {"n": "4.5"}, {"n": "many"}, {"n": 1, "count": 2}, {"count": "7", "at": "2025-11-08T06:07:43+09:00"}, {"at": "2025年11月06日下午4点57分"}, {"at": "soon", "n": None}, {"n": [5]}]
    held = drift.ingest(lines(spark, {1: rows}), targets)
    zones = held.select("table_name", "row_id", F.lit("Asia/Shanghai").alias("zone"))
    none = spark.createDataFrame([], "table_name string, account_id string, field string, target string")
    out = drift.replay(held, none, targets, zones).orderBy("row_id").collect()
    assert [r.n for r in out] == [3.0, 4.5, None, 2.0, 7.0, None, None, 5.0]
    assert [r["at"].isoformat() if r["at"] else None for r in out][4:7] == ["2025-11-07T21:07:43", "2025-11-06T08:57:00", None]
    assert [json.loads(r.rescued) if r.rescued else None for r in out] == [None, None, {"n": "many"}, {"n": 1}, None, None, {"at": "soon", "n": None}, None]


CASES = [
    ("2025-11-08T06:07:43+09:00", "Asia/Tokyo", "2025-11-07T21:07:43+00:00"), ("1762290811", None, "2025-11-04T21:13:31+00:00"), ("1710056892269", None, "2024-03-10T07:48:12.269+00:00"),
    ("1762518138000536", "x", "2025-11-07T12:22:18+00:00"), ("  2025-11-22 15:09:53,174 ", "Asia/Shanghai", "2025-11-22T07:09:53.174+00:00"), ("20251112174559", "America/New_York", "2025-11-12T22:45:59+00:00"),
    ("Wed, 12 Nov 2025 19:08:47 GMT", "Asia/Tokyo", "2025-11-12T19:08:47+00:00"), ("２０２５-１１-０９ １７：２３", "Asia/Shanghai", "2025-11-09T09:23:00+00:00"), ("2025-10-31T13:32:35[Europe/Berlin]", "Asia/Tokyo", "2025-10-31T12:32:35+00:00"),
    ("2025-11-02T01:45:47-05:00[America/New_York]", None, "2025-11-02T06:45:47+00:00"), ("2025年11月06日下午4点57分", "Asia/Shanghai", "2025-11-06T08:57:00+00:00"), ("2025年10月30日中午12点37分", "Asia/Shanghai", "2025-10-30T04:37:00+00:00"),
    ("2025年10月10日凌晨0点23分", "Asia/Shanghai", "2025-10-09T16:23:00+00:00"), ("30.03.2025 04:17", "Europe/Berlin", "2025-03-30T02:17:00+00:00"), ("8/20/2025 12:17 AM", "America/Los_Angeles", "2025-08-20T07:17:00+00:00"),
    ("2025.11.13", "Asia/Shanghai", "2025-11-12T16:00:00+00:00"), ("2025-10-12 17:31:56 CEST", "Europe/Berlin", "2025-10-12T15:31:56+00:00"), ("2025-10-31 23:40:09 (UTC+8)", None, "2025-10-31T15:40:09+00:00"),
    ("2025-10-13 02:58:44 北京时间", None, "2025-10-12T18:58:44+00:00"), ("2025-10-21 00:12:35 -04", None, "2025-10-21T04:12:35+00:00"), ("2024-09-08", "America/Santiago", "2024-09-08T04:00:00+00:00"),
    ("2025-03-30 02:10:01", "Europe/Berlin", None), ("2025-10-26 02:03", "Europe/Berlin", None), ("2025-13-04T08:00:00", "Asia/Tokyo", None), ("2025-02-30", "Asia/Tokyo", None), ("25:61", "Asia/Tokyo", None),
    ("yesterday", "Asia/Tokyo", None), ("", "Asia/Tokyo", None), (None, "Asia/Tokyo", None), ("2025-11-14 04:02", None, None), ("2025-11-14 04:02", "Not/AZone", None), ("2025-11-14 24:02", "Asia/Tokyo", None),
    ("2025-11-14 04:02 CST", "Asia/Shanghai", "2025-11-13T20:02:00+00:00"), ("2025-11-14 04:02 CST", "Europe/Berlin", None), ("x" * 20000, "Asia/Tokyo", None),
]


def test_instants(spark):
    df = spark.createDataFrame([(i, v, z, "clash") for i, (v, z, _) in enumerate(CASES)], "i int, v string, z string, epoch string")
    got = {r.i: r.epoch_ms for r in instants.to_instants(df, "v", "z").collect()}
    for i, (v, z, want) in enumerate(CASES):
        ms = None if want is None else round(dt.datetime.fromisoformat(want).timestamp() * 1000)
        assert got[i] == ms, (v, z)


def test_wall_times_against_brute_force(spark):
    """Every quarter of an hour around the changes of a zone: instants whose local time it is, tried one by one."""
    zones = ["Europe/London", "Australia/Lord_Howe", "America/New_York"]
    rows = [(f"{dt.datetime(y, m, d) + dt.timedelta(minutes=15 * k)}", z) for z in zones for y, m, d in [(2024, 3, 10), (2024, 3, 31), (2024, 4, 7), (2024, 10, 6), (2024, 10, 27), (2024, 11, 3)] for k in range(0, 24)]
    got = {(r.v, r.z): r.epoch_ms for r in instants.to_instants(spark.createDataFrame(rows, "v string, z string"), "v", "z").collect()}
    for v, z in rows:
        wall, zone = dt.datetime.fromisoformat(v), ZoneInfo(z)
        fits = {u for o in range(-14 * 4, 14 * 4 + 1) if (u := wall.replace(tzinfo=dt.UTC) - dt.timedelta(minutes=15 * o)).astimezone(zone).replace(tzinfo=None) == wall}
        assert got[v, z] == (round(fits.pop().timestamp() * 1000) if len(fits) == 1 else None), (v, z)


def test_zones_are_estimated_from_ingestion(spark):
    rows = []
    for clock, zone in [("a", "Asia/Tokyo"), ("b", "America/New_York")]:
        for k in range(40):
            u = dt.datetime(2025, 1, 1, tzinfo=dt.UTC) + dt.timedelta(hours=37 * k)
            rows.append((clock, u.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S"), int(u.timestamp()) + 60 * (k % 30)))
    df = spark.createDataFrame(rows, "clock string, v string, seen bigint")
    got = {r.clock: (r.zone, r.violations) for r in instants.estimate_zones(df, "v", "seen", "clock", ["Asia/Tokyo", "Asia/Shanghai", "Europe/Berlin", "America/New_York"]).collect()}
    assert got == {"a": ("Asia/Tokyo", 0), "b": ("America/New_York", 0)}


def test_stated_offsets_tell_zones_and_ties_stay_open(spark):
    rows = []
    for k in range(60):
        u = dt.datetime(2025, 1, 5, 12, tzinfo=dt.UTC) + dt.timedelta(days=6 * k)
        seen = int(u.timestamp()) + 86_400 * (5 + k % 9)
        local = lambda z: u.astimezone(ZoneInfo(z))
        # Collected days later: only rows that state an offset tell the zone, one in five, and some state another site's.
        rows.append(("stated", local("Europe/London").isoformat() if k % 5 == 0 else u.isoformat() if k % 7 == 0 else local("Europe/London").strftime("%Y-%m-%d %H:%M:%S"), seen))
        rows.append(("open", local("Asia/Tokyo").strftime("%Y-%m-%d %H:%M:%S"), seen))
        rows.append(("zulu", u.strftime("%Y-%m-%dT%H:%M:%SZ"), seen))
        rows.append((None, "2025-01-01 00:00:00", seen))
    df = spark.createDataFrame(rows + rows, "clock string, v string, seen bigint")
    got = {r.clock: r.zone for r in instants.estimate_zones(df, "v", "seen", "clock").collect()}
    assert got == {"stated": "Europe/London", "open": None}
    # The estimate serves rows without a zone, and only those.
    more = df.select("clock", "v", "seen", F.lit(None).cast("string").alias("z")).unionByName(spark.createDataFrame([("stated", "2025-07-01 12:00:00", None, "Asia/Tokyo"), ("open", "2025-07-01 12:00:00", None, None)], "clock string, v string, seen bigint, z string"))
    more = more.unionByName(spark.createDataFrame([("stated", "2025-07-01 12:00:00", None, "no/zone")], "clock string, v string, seen bigint, z string"))
    out = {(r.clock, r.z): r.epoch_ms for r in instants.instants_of(more, "v", "z", "clock", "seen").where("seen IS NULL").collect()}
    at = lambda h: int(dt.datetime(2025, 7, 1, h, tzinfo=dt.UTC).timestamp()) * 1000
    assert out == {("stated", "Asia/Tokyo"): at(3), ("stated", "no/zone"): at(11), ("open", None): None}
    assert instants.estimate_zones(df.limit(0), "v", "seen", "clock").count() == 0


PAY = [
    ("18.5-30.5K·14薪", 18500, 30500), ("９千-1.2万每月", 9000, 12000), ("两万七至三万六每月", 27000, 36000), ("四万至六万二", 40000, 62000), ("年薪47～77万", 39167, 64167), ("US$70k-US$107k/yr", 41417, 63308),
    ("HKD 3,300-4,700/month", 3036, 4324), ("260-300/日", 5655, 6525), ("时薪56元", 9744, 9744), ("不超过10000元", 10000, 10000), ("12.5K以上", 12500, 12500), ("46至27.5K", 27500, 46000), ("¥9500~16000", 9500, 16000),
    ("18-30万元（年薪）", 15000, 25000), ("24,500～37,500元/月", 24500, 37500), ("面议", None, None), ("", None, None), (None, None, None),
]


@pytest.fixture(scope="module")
def units(spark):
    rows = [("hour", "period", 174.0), ("day", "period", 21.75), ("month", "period", 1.0), ("year", "period", 1 / 12), ("CNY", "currency", 1.0), ("USD", "currency", 7.1), ("HKD", "currency", 0.92), ("EUR", "currency", 7.8)]
    return spark.createDataFrame(rows, "unit_code string, kind string, factor double")


RECORD = "table_name string, row_key string, value string, low double, high double, unit string, other array<string>"


def test_pay_is_read_and_converted(spark, units):
    rows = [("jobs", str(i), v, None, None, None, [None]) for i, (v, _, _) in enumerate(PAY)]
    rows += [("jobs", "bare", "38-55", None, None, None, ["上述待遇按万元/年填写"]), ("jobs", "day", "320", None, None, None, ["提供3天带薪年假", "薪资栏数字为日薪（元）"])]
    rows += [("jobs_list", "l1", None, 1.3, 2.75, None, ["双休", "薪资单位：万"]), ("jobs_list", "l2", None, 26.0, None, "年薪(万)", []), ("jobs_list", "l3", None, 400000.0, 500000.0, " 分/月 ", None)]
    got = {r.row_key: (r.low_yuan, r.high_yuan) for r in pay.to_monthly(spark.createDataFrame(rows, RECORD), units).collect()}
    for i, (v, a, b) in enumerate(PAY):
        assert got[str(i)] == (a, b), v
    assert got["bare"] == (31667, 45833) and got["day"] == (6960, 6960)
    assert got["l1"] == (13000, 27500) and got["l2"] == (21667, 21667) and got["l3"] == (4000, 5000)


def test_missing_units_are_predicted_or_reviewed(spark, units):
    """Held-out accuracy: units hidden from records of clearly different magnitudes come back."""
    rows = [("jobs", f"m{i}", f"{8000 + 100 * i}-{12000 + 100 * i}元/月", None, None, None, None) for i in range(150)]
    rows += [("jobs", f"h{i}", f"{30 + i % 40}-{50 + i % 40}元/时", None, None, None, None) for i in range(150)]
    rows += [("jobs", f"w{i}", f"{9000 + 130 * i}-{15000 + 130 * i}", None, None, None, None) for i in range(20)]
    got = [r for r in pay.to_monthly(spark.createDataFrame(rows, RECORD), units).collect() if r.row_key[0] == "w"]
    assert all(r.predicted == "1|month" and r.decision == "converted" for r in got)


def test_pay_of_nothing(spark, units):
    assert pay.to_monthly(spark.createDataFrame([], RECORD), units).count() == 0


def test_monotone():
    assert pay.monotone([(1, 0.2), (1, 0.6), (1, 0.4), (0, 0.9)]) == [0.2, 0.5, 0.5, 0.9]


def test_who_decides(spark, units):
    """The forest decides where it is sure and nothing contradicts it; words outrank it; the rest is for a person."""
    rows = [("jobs", f"m{i}", f"{8000 + 100 * i}-{12000 + 100 * i}元/月", None, None, None, None, "A") for i in range(150)]
    rows += [("jobs", f"h{i}", f"{30 + i % 40}-{50 + i % 40}元/时", None, None, None, None, "A") for i in range(150)]
    rows += [("jobs", "sure", "9100-13100", None, None, None, None, "A"), ("jobs", "words", "9100-13100", None, None, None, ["薪资单位：元/年"], "A"), ("jobs", "same", "9100-13100", None, None, None, ["薪资单位：元/月"], None)]
    got = {r.row_key: r for r in pay.to_monthly(spark.createDataFrame(rows, RECORD + ", category string"), units).collect()}
    assert got["sure"].decided_by == "forest" and got["same"].decided_by == "forest" and got["same"].low_yuan == 9100
    assert got["words"].low_yuan == 758 and got["words"].said == "1|year"
    held = {r.unit: (r.n, r.right) for r in pay.held_out(spark.createDataFrame(rows, RECORD + ", category string")).collect()}
    assert set(held) == {"1|month", "1|hour"} and all(right >= 0.9 * n for n, right in held.values())
    alone = pay.to_monthly(spark.createDataFrame([("jobs", "x", "38-55", None, None, None, None)], RECORD), units).first()
    assert alone.decision == "review" and alone.low_yuan is None
