from datetime import datetime, timezone

import pytest

from docketflow.functions.instants import parse_instant
from docketflow.operators import instants

LA, ZURICH = "America/Los_Angeles", "Europe/Zurich"


def at(*parts):
    return int(datetime(*parts, tzinfo=timezone.utc).timestamp()) * 1_000_000


@pytest.mark.parametrize(
    ("text", "zone", "day_first", "expected"),
    [
        ("2011-03-12T21:35:52.731-0600", None, None, at(2011, 3, 13, 3, 35, 52) + 731_000),
        ("Sat Apr  6 19:52:46 CDT 2019", None, None, at(2019, 4, 7, 0, 52, 46)),
        ("Fri, 20 Aug 2021 16:04:04 -0500 (CDT)", LA, False, at(2021, 8, 20, 21, 4, 4)),
        ("10 January 2011, 08:46 (UTC+5:30)", LA, False, at(2011, 1, 10, 3, 16)),
        ("Mar 13, 2011 8:23 a.m. PDT", None, None, at(2011, 3, 13, 15, 23)),
        ("02/12/2013 12:00 am CST", None, False, at(2013, 2, 12, 6)),
        ("02/12/2013 12:00 am CET", None, True, at(2013, 12, 1, 23)),
        ("20110519T132050Z", LA, False, at(2011, 5, 19, 13, 20, 50)),
        ("1299783050", LA, False, 1299783050 * 1_000_000),
        ("1297878675426", LA, False, 1297878675426 * 1_000),
        ("1295210184047655", LA, False, 1295210184047655),
        ("24-Feb-2011", ZURICH, True, at(2011, 2, 23, 23)),
        ("January 12, 2011", LA, False, at(2011, 1, 12, 8)),
        ("01/06/11 22:50", ZURICH, True, at(2011, 6, 1, 20, 50)),
        ("3/4/2011", LA, None, None),
        ("2018-03-11 02:35:12", LA, False, None),  # skipped
        ("2018-11-04 01:39:16", LA, False, None),  # twice
        ("Nov 4, 2018 1:39 AM PDT", LA, False, at(2018, 11, 4, 8, 39)),
        ("2016-02-30", LA, False, None),
        ("0000-00-00", LA, False, None),
        ("31/31/2015", ZURICH, True, None),
        ("13/14/2015 13:00 PM", ZURICH, True, None),
        ("Mon, 5 Jan 2011 08:57:43 +1100", None, None, None),  # it was a Wednesday
        ("2011-01-21 09:38:00", "No/Zone", False, None),
        ("2011-01-21 09:38:00", None, None, None),
        ("ongoing", LA, False, None),
        ("", LA, False, None),
        (None, LA, False, None),
        ("9" * 5000, LA, False, None),
        ("2011-01-01" + " " * 200, LA, False, at(2011, 1, 1, 8)),
    ],
)
def test_parse(text, zone, day_first, expected):
    assert parse_instant(text, zone, day_first) == expected


ROWS = "tab string, row_id bigint, text string, feed string, zone_name string, k string"
FEEDS = "feed string, zone_name string, day_first boolean"


def test_rows_and_persisted_dictionary(spark, rows, tmp_path):
    feeds = spark.createDataFrame([("a", LA, False), ("b", ZURICH, True)], FEEDS)
    data = [("t", 1, "3/4/2011", "a"), ("t", 2, "3/4/2011", "b"), ("t", 3, None, "a"), ("t", 4, "", "b"), ("t", 5, "2011-01-01T00:00:00Z", None), ("t", 5, "2011-01-01T00:00:00Z", "zz"), ("u", 1, "2016-02-30", "a")]
    df = spark.createDataFrame([(*d, "clash", "clash") for d in data], ROWS)
    path = str(tmp_path / "dictionary")
    first = rows(instants.normalise(df, feeds, path).select("tab", "row_id", "utc_micros"))
    expected = [
        ("t", 1, at(2011, 3, 4, 8)), ("t", 2, at(2011, 4, 2, 22)), ("t", 3, None), ("t", 4, None), ("t", 5, at(2011, 1, 1)), ("t", 5, at(2011, 1, 1)), ("u", 1, None),
    ]
    assert first == sorted(expected, key=lambda r: tuple((x is None, str(x)) for x in r))
    known = spark.read.parquet(path).count()
    assert rows(instants.normalise(df, feeds, path).select("tab", "row_id", "utc_micros")) == first
    assert spark.read.parquet(path).count() == known


def test_hot_text_and_empty(spark):
    feeds = spark.createDataFrame([("a", LA, False)], FEEDS)
    df = spark.range(3000).selectExpr("'t' AS tab", "id AS row_id", "CASE WHEN id % 3 = 0 THEN '2011-01-01' ELSE cast(1299783050 + id AS string) END AS text", "'a' AS feed")
    done = instants.normalise(df, feeds)
    assert done.filter("utc_micros IS NOT NULL").count() == 3000
    assert instants.normalise(df.limit(0), feeds).count() == 0


@pytest.mark.parametrize(
    ("text", "zone", "micros"),
    [
        ("2015-07-01 12:00 IST", "Asia/Kolkata", "2015-07-01T06:30:00"), ("2015-07-01 12:00 IST", "Europe/Dublin", "2015-07-01T11:00:00"), ("2015-07-01 12:00 BST", "Europe/London", "2015-07-01T11:00:00"),
        ("2015-07-01 12:00 IST", "UTC", None), ("2015-01-01 12:00 BST", "Europe/London", None), ("2015-07-01 12:00 IST", None, None), ("x" * 100_000, "UTC", None), (" " * 500 + "1 July 2015" + " " * 500, "UTC", "2015-07-01T00:00:00"),
    ],
)
def test_zone_of_the_feed_decides_between_meanings(text, zone, micros):
    expected = None if micros is None else int(datetime.fromisoformat(micros).replace(tzinfo=timezone.utc).timestamp()) * 1_000_000
    assert parse_instant(text, zone, True) == expected
