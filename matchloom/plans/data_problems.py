"""Queries p2 to p6: data-processing problems of the general kind, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql import types as T

from matchloom.operators.bitemporal import as_known_at
from matchloom.operators.nested import UNREADABLE, entity_columns, flatten_records
from matchloom.operators.profile import column_profile, count_cells, coverage_drift, expression_coverage, induce_choices, ledger_errors
from matchloom.operators.timestamps import normalise_times
from matchloom.session import materialise, table
from matchloom.sources.drift import kept_files, registry, schema_changes, unify

UTC_SECONDS = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"


def rated_matches(spark: SparkSession, d: str, later: str | None = None) -> DataFrame:
    """Match rows with the rating that was valid when the match started, as it was known
    then, or `later` (an interval) on."""
    started = F.col("started_timestamp")
    m = table(spark, d, "matches_long_raw").where(started.rlike(UTC_SECONDS) & F.col("rating_pre_raw").isNotNull())
    m = m.select("match_id", "player_id", "rating_pre_raw", F.col("player_id").cast("bigint").alias("profile_id"), F.col("leaderboard_raw").cast("bigint").alias("leaderboard_id"), started.try_cast("timestamp").alias("at"))
    r = table(spark, d, "ratings_raw").where("rating is not null")
    day = F.regexp_extract("filename", r"(\d{4}-\d{2}-\d{2})[^/]*$", 1).try_cast("date")
    valid = F.col("date").cast("timestamp")
    known = F.when(day > F.to_date("date"), day.cast("timestamp")).otherwise(valid)
    tau = None if later is None else F.col("at") + F.expr(f"interval {later}")
    return as_known_at(m, r, ["profile_id", "leaderboard_id"], F.col("at"), valid, known, F.col("rating"), known_at=tau)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return rated_matches(spark, d).where(F.col("value").isNotNull() & (F.col("value") != F.col("rating_pre_raw"))).select("match_id", "player_id").distinct()


def p2_rated(spark: SparkSession, d: str) -> DataFrame:
    """Every qualifying match row with its rating as known at the start."""
    return rated_matches(spark, d).select("match_id", "player_id", "rating_pre_raw", F.col("value").cast("bigint").alias("rating_known")).distinct()


def p2_corrected(spark: SparkSession, d: str) -> DataFrame:
    """The rating at the start of each match as it was known 30 days later, corrections
    that came until then included."""
    r = rated_matches(spark, d, "30 days")
    return r.select("match_id", "player_id", "rating_pre_raw", F.col("value").cast("bigint").alias("rating_corrected")).distinct()


LOADED = ("matches_raw", "players_raw")


def load_counts(spark: SparkSession, d: str) -> DataFrame:
    """Value counts of both loaded tables, by load. A load's prefix is the part of the
    file name that the ledger names: feed and calendar month."""
    load = F.regexp_extract("filename", r"^([^/]*/[^/]*/\d{4}-\d{2})", 1)
    counts = count_cells(*[(table(spark, d, v), v, load, ["filename"]) for v in LOADED])
    return materialise(counts, "value-counts")  # read for the expressions, and again for the profile


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    ledger = table(spark, d, "missingness_ledger")
    profile = column_profile(load_counts(spark, d), ledger)
    return ledger_errors(profile, ledger).select("view_name", "load_prefix", "column_name").distinct()


def p3_profile(spark: SparkSession, d: str) -> DataFrame:
    p = column_profile(load_counts(spark, d), table(spark, d, "missingness_ledger"))
    return p.select("view_name", "load_prefix", "column_name", "n_total", "n_null", "n_distinct", "n_sentinel", F.round("pct_null", 6).alias("pct_null"))


def p3_nonconforming(spark: SparkSession, d: str) -> DataFrame:
    """How far the expressions of each column cover it in each load."""
    return column_profile(load_counts(spark, d)).select("view_name", "load_prefix", "column_name", "n_total", "n_expressions", "n_nonconforming")


def p3_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Value ranges and lengths of every column of every load."""
    p = column_profile(load_counts(spark, d))
    return p.select("view_name", "load_prefix", "column_name", "min_text", "max_text", F.round("min_number", 6).alias("min_number"), F.round("max_number", 6).alias("max_number"), "max_length", "n_top")


def p3_expressions(spark: SparkSession, d: str) -> DataFrame:
    """The expressions that describe each column."""
    return induce_choices(load_counts(spark, d))[0]


def p3_drift(spark: SparkSession, d: str) -> DataFrame:
    """Change of expression coverage and null share between successive loads of each feed."""
    counts = load_counts(spark, d)
    coverage = expression_coverage(counts, induce_choices(counts)[1])
    return coverage_drift(coverage, F.regexp_extract("load_prefix", r"^([^/]*/[^/]*)/", 1))


#: Lines that a delivered file repeats from the end of the one before it.
SHARED_LINES = 2


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    records = table(spark, d, "raw_records")
    return schema_changes(records, kept_files(records), SHARED_LINES).select("filename", "change", "field", "new_field").distinct()


def p4_versions(spark: SparkSession, d: str) -> DataFrame:
    """The registry: each directory's schema versions."""
    return registry(kept_files(table(spark, d, "raw_records"))).drop("fields")


def _unified(spark: SparkSession, d: str, source: str, target: str) -> DataFrame:
    records = table(spark, d, "raw_records").where(F.col("filename").startswith(source + "/"))
    schema = T.StructType([f for f in table(spark, d, target).schema if f.name != "filename"])
    files = materialise(kept_files(records), "files")
    return unify(records, files, schema_changes(records, files, SHARED_LINES), schema)


def p4_matches(spark: SparkSession, d: str) -> DataFrame:
    """All match records under the fields that matches_raw has, and those that files add
    beyond them as the map `extra` of JSON values."""
    return _unified(spark, d, "matches", "matches_raw")


def p4_players(spark: SparkSession, d: str) -> DataFrame:
    """The same of player records and players_raw."""
    return _unified(spark, d, "players", "players_raw")


def event_nodes(spark: SparkSession, d: str, unreadable: bool = False) -> DataFrame:
    """Every event and whatever repeats within it."""
    return flatten_records(
        table(spark, d, "tracker_events_raw"), "event_data", keep=["filename", "loop", "evtTypeName"], key="tag",
        entities=["unit", "units", "cargo"], embedded=["payload"], inherit=["controlPlayerId", "owner.playerID"], unreadable=unreadable,
    )


def unit_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every unit of every event, with the unit that holds it."""
    return event_nodes(spark, d).where(F.col("entity").isin("unit", "units", "cargo"))


def replay_players(spark: SparkSession, d: str) -> DataFrame:
    """The players of every replay, from any layout of the player map."""
    rows = flatten_records(table(spark, d, "replays_meta_raw"), "ToonPlayerDescMap", keep=["filename"], key="toon", entry=r"^\d+-S\d+-\d+-\d+$").where("node > 0")
    f = lambda name: F.coalesce(F.col("fields")[name], F.col("fields")["profile." + name]).alias(name)
    return rows.select("filename", F.col("key").alias("toon_id"), f("nickname"), f("playerID").try_cast("int").alias("playerID"), f("race"), f("result"), f("region"), f("highestLeague"), f("clanTag"), f("APM").try_cast("int").alias("APM"), f("MMR").try_cast("int").alias("MMR"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    held = unit_rows(spark, d).where("entity = 'cargo' and parent_entity in ('unit', 'units', 'cargo')")
    player = F.coalesce(F.col("root")["controlPlayerId"], F.col("root")["owner.playerID"]).try_cast("int")
    held = held.select("filename", player.alias("playerID"), F.col("parent_key").try_cast("bigint").alias("parent_tag"), F.col("key").try_cast("bigint").alias("child_tag"))
    held = held.where("parent_tag is not null and child_tag is not null")
    players = replay_players(spark, d).select("filename", "playerID", "toon_id").where("toon_id is not null").distinct()
    return held.join(players, ["filename", "playerID"]).select("filename", "toon_id", "parent_tag", "child_tag").distinct()


def p6_units(spark: SparkSession, d: str) -> DataFrame:
    """The units' table, with typed columns and the tag of the unit that holds each."""
    f = F.col("fields")
    return unit_rows(spark, d).select("filename", "loop", "evtTypeName", "entity", "depth", F.col("key").alias("tag"), F.col("parent_key").alias("parent_tag"), f["type"].alias("type"), f["pos.x"].try_cast("int").alias("x"), f["pos.y"].try_cast("int").alias("y"))


def p6_columns(spark: SparkSession, d: str) -> DataFrame:
    """The tables that the events fall into, with the type and the use of each column."""
    return entity_columns(event_nodes(spark, d))


def p6_unreadable(spark: SparkSession, d: str) -> DataFrame:
    """Events whose data isn't JSON."""
    return event_nodes(spark, d, unreadable=True).where(F.col("entity") == UNREADABLE).select("filename", "loop", "evtTypeName")


def p6_players(spark: SparkSession, d: str) -> DataFrame:
    return replay_players(spark, d)


def start_instants(spark: SparkSession, d: str) -> DataFrame:
    """(match_id, side of the comparison, instant) of every row of both match tables."""
    zones = table(spark, d, "server_zones").groupBy("server").agg(F.min("zone_name").alias("zone"))
    a = table(spark, d, "matches_raw").select(F.col("matchId").alias("match_id"), F.col("started").alias("text"), "server")
    a = a.join(zones, "server", "left").select("match_id", F.lit("matches_raw").alias("source"), "text", "zone")
    b = table(spark, d, "matches_long_raw").select("match_id", F.lit("matches_long_raw").alias("source"), F.col("started_timestamp").alias("text"), F.lit("UTC").alias("zone"))
    return normalise_times(a.unionByName(b), "text", "zone")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    t = F.unix_micros("instant")
    side = lambda f, s: f(F.when(F.col("source") == s, t))
    by = start_instants(spark, d).where("match_id is not null").groupBy("match_id").agg(
        side(F.min, "matches_raw").alias("a0"), side(F.max, "matches_raw").alias("a1"),
        side(F.min, "matches_long_raw").alias("b0"), side(F.max, "matches_long_raw").alias("b1"),
    )
    return by.where(F.greatest(F.col("a1") - F.col("b0"), F.col("b1") - F.col("a0")) >= 60_000_000).select("match_id")


def p5_instants(spark: SparkSession, d: str) -> DataFrame:
    return start_instants(spark, d).select("match_id", "source", "text", F.unix_micros("instant").alias("instant_us"))


QUERIES = {f.__name__: f for f in (p2_found, p2_rated, p2_corrected, p3_found, p3_profile, p3_nonconforming, p3_ranges, p3_expressions, p3_drift, p4_found, p4_versions, p4_matches, p4_players, p5_found, p5_instants, p6_found, p6_units, p6_columns, p6_unreadable, p6_players)}
