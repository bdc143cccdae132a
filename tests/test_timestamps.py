import datetime as dt
from zoneinfo import ZoneInfo

from hypothesis import given, settings
from hypothesis import strategies as st

from feedloom.functions import dates
from feedloom.functions.timestamps import ZoneBook, mask_of, shape_of, to_micros, zone_book
from feedloom.operators.instants import normalized

ZONES = ["Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Sydney", "Asia/Tokyo", "UTC"]
WHEN = st.datetimes(dt.datetime(1975, 1, 1), dt.datetime(2037, 12, 31))


def micros(d):
    return (d - dt.datetime(1970, 1, 1, tzinfo=dt.timezone.utc)) // dt.timedelta(microseconds=1)


def one(text, zone=None):
    return to_micros([text], [zone])[0]


@settings(max_examples=200, deadline=None)
@given(WHEN, st.sampled_from(ZONES))
def test_wall_clock_against_zoneinfo(d, zone):
    d = d.replace(microsecond=0)
    z = ZoneInfo(zone)
    both = {micros(x) for f in (0, 1) if (x := d.replace(tzinfo=z, fold=f).astimezone(dt.timezone.utc)).astimezone(z).replace(tzinfo=None) == d}
    assert one(d.strftime("%Y-%m-%d %H:%M:%S"), zone) == (both.pop() if len(both) == 1 else None)


@settings(max_examples=200, deadline=None)
@given(WHEN, st.integers(-14 * 60, 14 * 60))
def test_offsets_round_trip(d, minutes):
    d = d.replace(tzinfo=dt.timezone(dt.timedelta(minutes=minutes)))
    want = micros(d)
    off = d.strftime("%z")
    assert one(d.isoformat(timespec="microseconds")) == want
    assert one(f"{d:%a, %d %b %Y %H:%M:%S} {off}") == want - want % 1_000_000
    assert one(f"{d:%Y/%m/%d %H:%M:%S} {off}") == want - want % 1_000_000


def test_shapes():
    ny = "America/New_York"
    at = micros(dt.datetime(2025, 3, 9, 17, 51, tzinfo=dt.timezone.utc))
    for text in ("March 9, 2025 1:51 PM", "09.03.2025 13:51", "2025-03-09T13:51", "9 Mar 25 13:51", "Sun, 9 Mar 2025 13:51:00", "2025-03-09 13:51:00 America/New_York", "Sun, 9 Mar 2025 13:51:00 EDT"):
        assert one(text, ny) == at, text
    assert one("20250309T175100Z") == at
    assert one("2025-03-09t17:51:00z") == at
    assert one(str(at // 1_000_000)) == at and one(str(at // 1000)) == at
    assert one("2025-03-09T17:51:00.123456789Z") == at + 123456
    assert one("2025-03-09T17:51:00,5Z") == at + 500000


def test_no_instant():
    for text in ("", " ", None, "yesterday", "n/a", "2025", "2025-03-09", "17 May 2024", "0000-00-00 00:00:00", "2024-02-30T10:00:00Z", "2024-13-01T10:00:00Z", "2024-01-01T25:00:00Z", "Mon, 9 Mar 2025 13:51:00 GMT", "x" * 100_000, "1:30 PM", "2024-01-01T10:00:00+25:00"):
        assert one(text, "UTC") is None, text
    assert one("2025-03-09 13:51:00", None) is None
    assert one("2025-03-09 02:30:00", "America/New_York") is None  # skipped
    assert one("2025-11-02 01:30:00", "America/New_York") is None  # twice
    assert one("Sun, 02 Nov 2025 01:30:00 EST", "America/New_York") is not None
    assert one("2025-03-09 13:51:00 Nowhere/Land", None) is None


def test_masks_map_to_parsers_once():
    assert mask_of("March 9, 2025 1:51 PM") == b"aaaaa 9, 9999 9:99 mm"
    assert shape_of(mask_of("2025-01-01T00:00:00Z")) is shape_of(mask_of("1999-12-31T23:59:59Z"))


def test_zone_data_travels_with_its_version():
    import pickle

    book = zone_book()
    assert book.table("../etc/passwd") is None and book.table(None) is None
    there = pickle.loads(pickle.dumps(book))
    assert there.version == book.version == there.table("Europe/Berlin").version
    assert ZoneBook({**book.files, "Europe/Berlin": book.files["Asia/Tokyo"]}).version != book.version
    # what decides is the book, not the machine
    other = ZoneBook({"Europe/Berlin": book.files["Asia/Tokyo"]})
    assert to_micros(["2025-03-09 13:51:00"], ["Europe/Berlin"], other) == to_micros(["2025-03-09 13:51:00"], ["Asia/Tokyo"])


def test_years_far_off_and_long_texts():
    for y in (1830, 2101, 2460, 2950, 9000):
        for m in (1, 7):
            for zone in ("Europe/Berlin", "Australia/Sydney", "America/New_York"):
                want = micros(dt.datetime(y, m, 1, 12, tzinfo=ZoneInfo(zone)).astimezone(dt.timezone.utc))
                assert one(f"{y}-{m:02d}-01 12:00:00", zone) == want
    assert one("2025-03-09T13:51:00." + "1" * 500 + "Z") == one("2025-03-09T13:51:00.111111Z")
    assert one(" " * 300 + "2025-03-09T13:51:00Z" + "\n" * 300) == one("2025-03-09T13:51:00Z")


def test_operator(spark):
    rows = spark.createDataFrame(
        [(1, 0, "2025-03-09 13:51:00", None, "x"), (2, 1, "2025-03-09 13:51:00", "", "x"), (3, None, None, "2025-01-01T00:00:00Z", "x"), (3, 9, "2025-01-01T00:00:00.5+01:00", "1735689600", "x")],
        "item_row bigint, feed_idx int, date_published string, date_modified string, time_zone string",
    )
    feeds = spark.createDataFrame([(0, "America/New_York"), (1, None)], "feed_idx int, time_zone string")
    got = {tuple(r) for r in normalized(rows, feeds, "item_row", ("date_published", "date_modified")).collect()}
    assert got == {(1, "date_published", 1741542660000000, False), (3, "date_modified", 1735689600000000, True), (3, "date_published", 1735685999500000 + 1_000_000, False), (3, "date_modified", 1735689600000000, False)}
    assert normalized(rows.limit(0), feeds.limit(0), "item_row", ("date_published",)).count() == 0


def test_feed_dates(spark):
    assert dates.normalize_text("2024-01-15T12:00:00.1230+00:00") == "2024-01-15T12:00:00.123Z"
    assert dates.normalize_text("2024-01-15T12:00:00+09:00") == "2024-01-15T12:00:00+09:00"
    assert dates.normalize_text("yesterday") == dates.normalize_text("2024-01-15") == dates.normalize_text("2024-02-30T00:00:00Z") == ""
    assert dates.feed_date("Mon, 15 Jan 2024 12:00:00 GMT") == "2024-01-15T12:00:00Z"
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("2024-01-15T12:00:00.123456789Z",), ("2024-01-15T12:00:00.500+00:00",), ("yesterday",), (None,)], "t string")
    got = df.select(dates.normalized(F.col("t")), dates.nanos(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [("2024-01-15T12:00:00.123456789Z", 789), ("2024-01-15T12:00:00.5Z", 0), (None, None), (None, None)]


def test_bounds():
    import pytest

    assert dates.parse_bound("2024-01-01", "Europe/Berlin").utcoffset() == dt.timedelta(hours=1)
    for bad in ("2024-01-01T00:00:00", "now", "2024-13-01"):
        with pytest.raises(ValueError):
            dates.parse_bound(bad)
