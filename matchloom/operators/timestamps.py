"""Mixed timestamp notations and zones, brought to one instant.

Every distinct (text, zone) pair goes into a dictionary, is parsed there once, and the
instants are joined back to the rows. With a `store` the dictionary is kept between
runs: only texts that it doesn't hold are parsed and appended.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.session import path_exists

_OFFSET = r"(Z|[+-]\d{2}:?\d{2})"
_ISO = rf"^\d{{4}}-\d{{2}}-\d{{2}}[T ]\d{{2}}:\d{{2}}(:\d{{2}}(\.\d+)?)? ?{_OFFSET}?(\[[^\]]*\])?$"
_COMPACT = rf"^(\d{{4}})(\d{{2}})(\d{{2}})T(\d{{2}})(\d{{2}})(\d{{2}})(\.\d+)? ?{_OFFSET}?$"
_EPOCH = r"^-?\d{1,16}$"
_MAIL = r"^([A-Za-z]{3}, *)?\d{1,2} [A-Za-z]{3} \d{4} \d{1,2}:\d{2}(:\d{2})? ?([+-]\d{4}|GMT|UTC?|Z)$"
#: Notations of wall time: what they look like, and how the fields stand in them.
_WALL = [
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}(:\d{2})?$", "M/d/yyyy H:mm[:ss]"),
    (r"^\d{1,2}\.\d{1,2}\.\d{4} \d{1,2}:\d{2}(:\d{2})?$", "d.M.yyyy H:mm[:ss]"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4} \d{1,2}:\d{2}(:\d{2})? [AaPp][Mm]$", "MMM d, yyyy h:mm[:ss] a"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4} \d{1,2}:\d{2}(:\d{2})?$", "MMM d, yyyy H:mm[:ss]"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}(:\d{2})? [AaPp][Mm]$", "M/d/yyyy h:mm[:ss] a"),
]
_HAS_ZONE = rf"({_OFFSET}(\[[^\]]*\])?$)|(^-?\d{{1,16}}$)|( (GMT|UTC?)$)"


def has_zone(text: Column) -> Column:
    """Whether the text alone fixes the instant: it has an offset, or counts from 1970."""
    return (F.substring(text, -1, 1) == "Z") | text.rlike(_HAS_ZONE)


def parse_instant(text: Column, zone: Column) -> Column:
    """The instant that a text denotes, null if it can't be read.

    Understood: ISO dates with T or blank, with or without seconds, fractions, offset
    and bracketed region; the compact ISO form; mail dates; month/day/year;
    day.month.year; `Mon d, yyyy h:mm PM`; bare numbers counting seconds (up to 11
    digits) or milliseconds from 1970 in UTC. A text without a zone is wall time in
    `zone`; where the clock is set back the first occurrence holds, where it is set
    forward the gap is skipped. Without a zone at all, and for impossible dates
    (0000-00-00), the result is null. An offset beats a bracketed region."""
    t = F.trim(text)
    # a text with both date and zone in ISO order is cast; the zone is in the text, not in the session
    iso = F.when(t.rlike(_COMPACT), F.regexp_replace(t, _COMPACT, "$1-$2-$3T$4:$5:$6$7$8")).otherwise(F.regexp_replace(t, r"\[[^\]]*\]$", ""))
    iso = F.regexp_replace(iso, r"([+-]\d{2})(\d{2})$", "$1:$2")
    iso = F.when(iso.rlike(r"(Z|[+-]\d{2}:\d{2})$"), iso).otherwise(F.concat(iso, F.lit(" "), F.nullif(zone, F.lit("")))).try_cast("timestamp")
    number = t.try_cast("bigint")
    epoch = F.when(F.length(t) <= 11, F.timestamp_seconds(number)).otherwise(F.timestamp_millis(number))
    mail = F.regexp_replace(F.regexp_replace(t, "^[A-Za-z]{3}, *", ""), " ?(GMT|UTC?|Z)$", " +0000")
    mail = F.try_to_timestamp(mail, F.lit("d MMM yyyy H:mm[:ss] xx"))
    out = F.when(t.rlike(_ISO) | t.rlike(_COMPACT), iso).when(t.rlike(_EPOCH), epoch).when(t.rlike(_MAIL), mail)
    wall = F.lit(None).cast("timestamp")
    for shape, fields in reversed(_WALL):
        wall = F.when(t.rlike(shape), F.try_to_timestamp(t, F.lit(fields))).otherwise(wall)
    return out.otherwise(F.to_utc_timestamp(wall, F.nullif(zone, F.lit(""))))


def time_dictionary(rows: DataFrame, text: str, zone: str | None = None, store: str | None = None) -> DataFrame:
    """(raw, zone_key, instant) for every distinct text of `rows` that holds a digit.

    zone_key is the zone only where the text has none of its own, so that the same
    text under many zones is parsed once. With `store`, a Parquet folder, entries
    found there are reused and new ones are appended."""
    spark = rows.sparkSession
    keys = dictionary_keys(rows, text, zone).where(F.col("raw").isNotNull()).distinct()
    parse = lambda df: df.withColumn("instant", parse_instant(F.col("raw"), F.col("zone_key")))
    if store is None:
        return parse(keys)
    if path_exists(spark, store):
        known = spark.read.parquet(store)
        parse(keys.join(known.select("raw", "zone_key"), ["raw", "zone_key"], "left_anti")).write.mode("append").parquet(store)
    else:
        parse(keys).write.parquet(store)
    return spark.read.parquet(store)


def dictionary_keys(rows: DataFrame, text: str, zone: str | None, *keep: Column) -> DataFrame:
    """The dictionary's key columns; raw is null where the text can't be a time at all
    (no digit), which keeps stand-ins such as 'unknown' out of shuffle and join."""
    t = F.col(text)
    zone_col = F.lit("UTC") if zone is None else F.coalesce(F.col(zone), F.lit(""))
    return rows.select(*keep, F.when(t.rlike(r"\d"), t).alias("raw"), F.when(has_zone(F.trim(t)), F.lit("")).otherwise(zone_col).alias("zone_key"))


def normalise_times(rows: DataFrame, text: str, zone: str | None = None, out: str = "instant", store: str | None = None) -> DataFrame:
    """`rows` with the column `out`: one instant (timestamp) per row, or null.

    `zone` names a column with an IANA zone for texts without one; without it they are
    UTC. Null, empty and unreadable texts, and zoneless texts of rows without a zone,
    give null; repeated rows are kept. A column named like `out` is replaced; all other
    columns stay as they are."""
    words = time_dictionary(rows, text, zone, store)
    at = [F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("__row")]
    keyed = dictionary_keys(rows, text, zone, *at)
    joined = keyed.join(words, ["raw", "zone_key"], "left")
    return joined.select(*[F.col("__row").getField(c).alias(c) for c in rows.columns if c != out], F.col("instant").alias(out))
