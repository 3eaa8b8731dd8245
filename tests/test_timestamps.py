from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import functions as F

from matchloom.operators.timestamps import normalise_times, time_dictionary

BERLIN, UTC = ZoneInfo("Europe/Berlin"), timezone.utc
CASES = [
    ("2024-03-05T06:07:08Z", "Europe/Berlin", datetime(2024, 3, 5, 6, 7, 8, tzinfo=UTC)),
    ("2024-03-05 06:07:08", "Europe/Berlin", datetime(2024, 3, 5, 6, 7, 8, tzinfo=BERLIN)),
    ("2024-03-05T06:07:08.123456+05:30", None, datetime(2024, 3, 5, 0, 37, 8, 123456, tzinfo=UTC)),
    ("2024-03-05T06:07:08.123-0400", None, datetime(2024, 3, 5, 10, 7, 8, 123000, tzinfo=UTC)),
    ("2024-03-05T06:07:08-04:00[America/New_York]", None, datetime(2024, 3, 5, 10, 7, 8, tzinfo=UTC)),
    ("20240305T060708Z", None, datetime(2024, 3, 5, 6, 7, 8, tzinfo=UTC)),
    ("1709618828", None, datetime(2024, 3, 5, 6, 7, 8, tzinfo=UTC)),
    ("1709618828123", None, datetime(2024, 3, 5, 6, 7, 8, 123000, tzinfo=UTC)),
    ("Tue, 05 Mar 2024 06:07:08 +0100", None, datetime(2024, 3, 5, 5, 7, 8, tzinfo=UTC)),
    ("Wed, 05 Mar 2024 06:07:08 GMT", None, datetime(2024, 3, 5, 6, 7, 8, tzinfo=UTC)),
    ("03/05/2024 06:07:08", "Asia/Tokyo", datetime(2024, 3, 4, 21, 7, 8, tzinfo=UTC)),
    ("05.03.2024 06:07:08", "Asia/Tokyo", datetime(2024, 3, 4, 21, 7, 8, tzinfo=UTC)),
    ("05.03.2024 06:07", "Asia/Tokyo", datetime(2024, 3, 4, 21, 7, tzinfo=UTC)),
    ("Mar 05, 2024 12:07:08 AM", "UTC", datetime(2024, 3, 5, 0, 7, 8, tzinfo=UTC)),
    ("Mar 05, 2024 12:07:08 PM", "UTC", datetime(2024, 3, 5, 12, 7, 8, tzinfo=UTC)),
    # clock set back: the first of both; set forward: the gap is skipped
    ("2024-10-27 02:30:00", "Europe/Berlin", datetime(2024, 10, 27, 0, 30, tzinfo=UTC)),
    ("10/27/2024 02:30:00", "Europe/Berlin", datetime(2024, 10, 27, 0, 30, tzinfo=UTC)),
    ("2024-03-31 02:30:00", "Europe/Berlin", datetime(2024, 3, 31, 1, 30, tzinfo=UTC)),
    ("2024-03-05 06:07:08", None, None),
    ("0000-00-00 00:00:00", "UTC", None),
    ("2024-02-30T00:00:00Z", None, None),
    ("13/40/2024 00:00:00", "UTC", None),
    ("unknown", "UTC", None),
    ("", "UTC", None),
    (None, "UTC", None),
    ("x" * 100_000 + "1", "UTC", None),
]


def test_notations(spark):
    df = spark.createDataFrame([(i, t, z) for i, (t, z, _) in enumerate(CASES)], "i int, text string, zone string")
    got = {r["i"]: r["us"] for r in normalise_times(df, "text", "zone").select("i", F.unix_micros("instant").alias("us")).collect()}
    epoch = datetime(1970, 1, 1, tzinfo=UTC)
    for i, (text, zone, want) in enumerate(CASES):
        assert got[i] == (None if want is None else (want - epoch) // timedelta(microseconds=1)), (text[:40] if text else text, zone)


def test_rows_columns_and_empty(spark):
    df = spark.createDataFrame([(1, "1709618828", "a"), (1, "1709618828", "a"), (2, None, "b")], "raw int, text string, instant string")
    out = normalise_times(df, "text")
    assert out.columns == ["raw", "text", "instant"] and out.count() == 3
    assert normalise_times(df.limit(0), "text").count() == 0


def test_store_grows_by_new_texts(spark, tmp_path):
    store = f"file://{tmp_path}/words"
    first = spark.createDataFrame([("1709618828",), ("junk1",)], "text string")
    assert time_dictionary(first, "text", store=store).count() == 2
    more = spark.createDataFrame([("1709618828",), ("1709618829",)], "text string")
    assert time_dictionary(more, "text", store=store).count() == 3
