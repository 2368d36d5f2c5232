"""Edge rows with hand-made expectations for both profiles."""

import pytest
from pyspark.sql import functions as F

from gatewise.functions import text
from gatewise.operators.clean import clean, observed_clean
from gatewise.schema import CLEAN_SCHEMA, RAW_COLUMNS, RAW_SCHEMA, same_columns
from gatewise.sources import files
from gatewise.sources.projection import AGENTS

# (shipped os, device, conflict), (documented os, device, conflict), browser family
EXPECTED = [
    (("iOS", "mobile", False), ("iOS", "mobile", False), "Mobile Safari"),
    (("Android", "mobile", False), ("Android", "mobile", False), "Chrome Mobile"),
    (("Windows", "desktop", False), ("Windows", "desktop", False), "Firefox"),
    (("macOS", "desktop", False), ("macOS", "desktop", False), "Safari"),
    (("Linux", "desktop", False), ("Linux", "desktop", False), "Opera"),
    (("ChromeOS", "desktop", False), ("ChromeOS", "desktop", False), "Chrome"),
    (("iOS", "mobile", True), ("Windows Phone", "mobile", False), "Edge Mobile"),
    (("iOS", "bot", False), ("unknown", "bot", False), "AwarioSmartBot"),
    (("iOS", "mobile", False), ("KaiOS", "mobile", False), "Firefox"),
    (("Linux", "mobile", False), ("Android", "mobile", True), "Android"),
    (("Android", "tablet", False), ("Android", "tablet", False), "Chrome"),
    (("iOS", "tablet", False), ("iOS", "tablet", False), "Mobile Safari"),
    (("unknown", "desktop", False), ("unknown", "desktop", False), "VLC"),
    (("unknown", "bot", False), ("unknown", "bot", False), "ZipppBot"),
    (("unknown", "desktop", False), ("Roku", "unknown", False), "Roku"),
    (("iOS", "unknown", True), ("Android", "mobile", False), "Unknown Mac OS X Browser"),
]


def raw_rows(spark, rows):
    full = [tuple(dict(zip(RAW_COLUMNS, [None] * 16), **r)[c] for c in RAW_COLUMNS) for r in rows]
    return spark.createDataFrame(full, RAW_SCHEMA)


@pytest.mark.parametrize("profile", ["shipped", "documented"])
def test_agents(spark, profile):
    rows = [dict(idx=str(i), ua=a, browser=b, os=o, device=d) for i, (a, b, o, d) in enumerate(AGENTS)]
    got = clean(raw_rows(spark, rows), profile).orderBy("row_id").collect()
    for row, (shipped, documented, family) in zip(got, EXPECTED):
        want = shipped if profile == "shipped" else documented
        assert (row.os_family, row.device_type, row.ua_os_conflict) == want, row.user_agent
        assert row.browser_family == family


def test_bot_flags(spark):
    rows = [dict(idx=str(i), ua=u) for i, u in enumerate(["AwarioSmartBot/1.0", "zipppbot das-GROUP", "vlc/3", None])]
    shipped = clean(raw_rows(spark, rows), "shipped").orderBy("row_id").collect()
    documented = clean(raw_rows(spark, rows)).orderBy("row_id").collect()
    assert [r.is_generator_bot for r in shipped] == [False, True, False, None]
    assert [r.is_generator_bot for r in documented] == [True, True, False, None]
    assert [r.is_vlc for r in shipped] == [False, False, True, None]


def one(spark, expression, value):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(expression(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize("value,want", [
    ("Chrome", "Chrome"), ("A  B", "A B"), ("85.0", ""), (None, None), ("134 Browser", "Browser"),
    ("A 85.0 86_1 B", "A B"), ("Chrome ", "Chrome"), ("x1 1x", "x1 1x"), ("VLC 3.0.0-GIT", "VLC"), ("1..2", "1..2"),
])
def test_strip_versions(spark, value, want):
    assert one(spark, text.strip_versions, value) == want


@pytest.mark.parametrize("value,rtt,outlier", [
    ("60000", 60000.0, False), ("60000.1", None, True), ("abc", None, None), (None, None, False), ("", None, None),
])
def test_rtt(spark, value, rtt, outlier):
    assert one(spark, text.rtt_value, value) == rtt
    assert one(spark, text.rtt_is_outlier, value) is outlier


@pytest.mark.parametrize("value,want", [
    ("12", 12), ("12.7", 13), ("-2.5", -3), ("1e3", 1000), ("abc", None), ("9223372036854775807", 9223372036854775807),
    ("9223372036854775808", None), (" 7 ", 7), ("", None), ("0.49999999999", 0),
])
def test_to_long(spark, value, want):
    assert one(spark, text.to_long, value) == want


@pytest.mark.parametrize("value,parses", [
    ("2020-02-03 12:43:30.772", True), ("2020-02-03 12:43:30", True), ("2020-02-03 12:43:30.1234567", False),
    ("2020-02-30 00:00:00", False), ("2020-02-03", False), ("2020-2-3 1:2:3", True), ("x", False),
])
def test_timestamp(spark, value, parses):
    assert (one(spark, text.to_timestamp_ntz, value) is not None) is parses


def test_private_ranges(spark):
    inside = ["10.0.0.1", "127.0.0.1", "192.168.1.1", "169.254.0.1", "172.16.0.1", "172.31.9.9"]
    outside = ["172.15.0.1", "172.32.0.1", "100.64.0.1", "11.0.0.1"]
    assert all(one(spark, text.is_private_ip, ip) is True for ip in inside)
    assert all(one(spark, text.is_private_ip, ip) is False for ip in outside)
    assert one(spark, text.is_private_ip, None) is None


def test_geo_and_flags(spark):
    raw = raw_rows(spark, [
        dict(idx="0", ip="84.2.1.1", region="-", city="Oslo", success="True"),
        dict(idx="1", ip="84.2.1.1", region="", city="Oslo", success="true"),
        dict(idx="2", ip="84.2.1.1", region="Oslo", city="Oslo"),
    ])
    shipped = clean(raw, "shipped").orderBy("row_id").collect()
    documented = clean(raw).orderBy("row_id").collect()
    assert [r.region for r in shipped] == [None, None, "Oslo"]
    assert [r.geo_unreliable for r in shipped] == [False, False, False]
    assert [r.geo_unreliable for r in documented] == [True, True, False]
    assert [r.login_success for r in shipped] == [True, False, None]


def test_schema_and_counts(spark, tmp_path):
    raw = raw_rows(spark, [dict(idx=str(i), ua="Linux") for i in range(50)])
    done, before, after = observed_clean(raw)
    assert same_columns(done.schema, CLEAN_SCHEMA) == []
    files.write_events(done, str(tmp_path / "c.parquet"))
    assert before.get["rows"] == after.get["rows"] == 50


CSV = '''a,b,c,d,e,f,g,h,i,j,k,l,m,n,o,p
0,2020-02-03 12:43:30.772,1,,10.0.0.1,NO,-,-,1,"say ""hi"", ok",B,O,mobile,True,False,False
1,t,2,"",ip, NO ,r,c,2,u\\,b,o,d,True,False,False
2,too,few
3,t,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1,1
'''


def test_csv_lines(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(CSV)
    rows = files.read_raw_csv(spark, str(path))
    got = {r.idx: r for r in rows.collect()}
    assert set(got) == {"0", "1"} and rows.count() == 2 and rows.select("idx").count() == 2
    assert got["0"].ua == 'say "hi", ok' and got["0"].rtt is None
    assert got["1"].rtt is None and got["1"].country == " NO " and got["1"].ua == "u\\"
    integrity = files.parse_integrity(spark, str(path)).first()
    assert (integrity.loose_rows, integrity.strict_rows, integrity.malformed_rows) == (4, 2, 2)


def test_csv_newline_in_field(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text("h" + ",h" * 15 + '\n0,t,u,r,i,c,r,c,a,"two\nlines",b,o,d,s,a,t\n')
    assert files.read_raw_csv(spark, str(path), multi_line=True).first().ua == "two\nlines"
