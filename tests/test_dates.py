from datetime import UTC, datetime, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postloom.functions import dates

NOW = datetime(2024, 6, 15, 12, 0, 0)
JUNE_1 = datetime(2024, 6, 1)


def as_of():
    return F.lit("2024-06-15 12:00:00").cast("timestamp")


def parsed(column, values):
    got = column(F.unix_micros(dates.normalize_date("v", as_of())), values)
    epoch = datetime(1970, 1, 1)
    return [None if v is None else epoch + timedelta(microseconds=v) for v in got]


def test_missing_texts(column):
    assert parsed(column, [None, "", "   ", "\t\n"]) == [None] * 4


def test_written_shapes(spark, column):
    shapes = ["2024-06-01", "2024-06-01T00:00:00", "2024-06-01T00:00:00Z", "2024-06-01 00:00:00", "Jun 1, 2024",
              "June 1, 2024", "01 Jun 2024", "01 June 2024", "June 1 2024", "Jun 1 2024", "01-06-2024", "1-6-2024",
              "jUN 01, 2024", "20240601T00", "2024-06-01T000000", "  2024-6-1 "]
    assert parsed(column, shapes) == [JUNE_1] * len(shapes)


def test_offsets(spark, column):
    assert parsed(column, ["2024-06-01T00:00:00+05:30", "2024-06-01T00:00:00-0530", "2024-06-01T10:00:00.5-05"]) == [
        datetime(2024, 5, 31, 18, 30), datetime(2024, 6, 1, 5, 30), datetime(2024, 6, 1, 15, 0, 0, 500000),
    ]


def test_epochs(spark, column):
    far = str(int(NOW.timestamp()) + 200 * 366 * 86400)
    assert parsed(column, ["1717200000", "1717200000000", "1717200000.25", "-1", far, "2024"]) == [
        JUNE_1, JUNE_1, JUNE_1 + timedelta(milliseconds=250), None, None, datetime(1970, 1, 1, 0, 33, 44),
    ]


def test_relative(spark, column):
    cases = {"just now": 0, "JustNow": 0, "today": 0, "Yesterday": 86400, "30 seconds ago": 30, "5 minutes ago": 300,
             "1 hour ago": 3600, "3 Days Ago": 3 * 86400, "2 weeks ago": 14 * 86400, "2 months ago": 60 * 86400}
    assert parsed(column, list(cases)) == [NOW - timedelta(seconds=s) for s in cases.values()]


def test_unreadable(spark, column):
    bad = ["06/01/2024", "a while back", "not-a-date-at-all", "2024-06", "abc123", "2024-02-30", "2024-06-01T25:00:00",
           "posted 3 days ago", "Foo 1, 2024", "99999999999999999999 days ago"]
    assert parsed(column, bad) == [None] * len(bad)


@settings(max_examples=1, deadline=None)
@given(st.lists(st.datetimes(datetime(1971, 1, 1), datetime(2030, 1, 1)), min_size=60, max_size=60))
def test_iso_against_python(spark, column, moments):
    texts = [m.replace(tzinfo=UTC).isoformat() if i % 2 else m.isoformat() for i, m in enumerate(moments)]
    assert parsed(column, texts) == moments


def test_scan_and_labels(spark, column):
    texts = ["Actively hiring 2 days ago near you", "posted Just now", "3 seconds ago", "yesterdays news", None]
    got = column(F.unix_micros(dates.scan_relative_date("v", as_of())), texts)
    base = int(NOW.replace(tzinfo=UTC).timestamp()) * 1_000_000
    assert got == [base - 2 * 86400 * 1_000_000, base, None, None, None]


def test_week_label_and_iso_text(spark, column):
    assert column(dates.week_label(F.col("v").cast("timestamp")), ["2024-06-15", "2024-12-30"]) == [
        "10 Jun–16 Jun 2024", "30 Dec–05 Jan 2025",
    ]
    assert column(dates.iso_text(F.col("v").cast("timestamp")), ["2024-06-15 01:02:03", "2024-06-15 01:02:03.5"]) == [
        "2024-06-15T01:02:03+00:00", "2024-06-15T01:02:03.500000+00:00",
    ]
