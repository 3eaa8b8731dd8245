"""Queries of the composite operators: audits, pairs, panels, statistics, features, events."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.functions import scalar as S
from matchloom.operators import relational as R
from matchloom.operators import audit as A
from matchloom.operators import event_log as E
from matchloom.operators import features as X
from matchloom.operators import pairs as P
from matchloom.operators import panel as N
from matchloom.operators import stats as T
from matchloom.plans.define import Group, Tables

query = Group()


def _r(*names: str, d: int = 6):
    return {n: F.round(n, d) for n in names}


# column census and missingness
@query("""select 'n_null' as k, count(*) - count(value) as v from events union all select 'n_distinct', count(distinct value) from events union all select 'n_zero', count(*) filter (where value = 0) from events""")
def audit_census_counts(t: Tables):
    c = A.column_census(t.events).where("column_name = 'value'")
    return c.unpivot([], ["n_null", "n_distinct", "n_zero"], "k", "v")


@query()
def audit_column_census(t: Tables):
    return A.column_census(t.matches_raw)


@query("""with u as (select unnest(['speed', 'server', 'privacy']) as column_name, unnest([speed, server, privacy]) as value from matches_raw),
g as (select column_name, value, count(*) as n from u group by 1, 2)
select * from (select column_name, row_number() over (partition by column_name order by n desc, value nulls last) as rank, value, n, round(100.0 * n / sum(n) over (partition by column_name), 4) as pct from g) where rank <= 5""")
def audit_frequent_values(t: Tables):
    return A.frequent_values(t.matches_raw, ["speed", "server", "privacy"]).withColumn("rank", F.col("rank").cast("bigint"))


@query("""with u as (select unnest(['speed', 'server']) as column_name, unnest([speed, server]) as value from matches_raw),
g as (select column_name, value, count(*) as n from u where value is not null group by 1, 2)
select * from (select column_name, row_number() over (partition by column_name order by n, value nulls last) as rank, value, n, round(100.0 * n / sum(n) over (partition by column_name), 4) as pct from g) where rank <= 3""")
def audit_rarest_values(t: Tables):
    return A.frequent_values(t.matches_raw, ["speed", "server"], 3, rarest=True).withColumn("rank", F.col("rank").cast("bigint"))


@query("""select 'initData.gameDescription.mapSizeX' as column_name, count(*) - count(initData.gameDescription.mapSizeX) as n_null, count(distinct initData.gameDescription.mapSizeX) as n_distinct from replays_meta_raw
union all select 'initData.gameDescription.gameOptions.fog', count(*) - count(initData.gameDescription.gameOptions.fog), count(distinct initData.gameDescription.gameOptions.fog) from replays_meta_raw
union all select 'metadata.mapName', count(*) - count(metadata.mapName), count(distinct metadata.mapName) from replays_meta_raw""")
def audit_leaf_census(t: Tables):
    return A.leaf_census(t.replays_meta_raw).where(F.col("column_name").isin("initData.gameDescription.mapSizeX", "initData.gameDescription.gameOptions.fog", "metadata.mapName"))


_SPEC = {
    "population": {"sentinel": [-1], "mechanism": "MAR", "primary": True},
    "map": {"sentinel": ["unknown"], "mechanism": "MCAR", "semantic": True},
    "speedFactor": {"sentinel": [-1.0], "mechanism": "MNAR"},
}


@query()
def audit_missingness_ledger(t: Tables):
    return A.missingness_ledger(t.matches_raw, "matches_raw", _SPEC, identity=["matchId", "filename"], target=["leaderboard"])


@query("""select 'population' as column_name, count(*) - count(population) as n_null, count(*) filter (where population = -1) as n_sentinel, round(100.0 * (count(*) - count(population)) / count(*), 4) as pct_null from matches_raw
union all select 'map', count(*) - count(map), count(*) filter (where map in ('unknown')), round(100.0 * (count(*) - count(map)) / count(*), 4) from matches_raw""")
def audit_sentinel_counts(t: Tables):
    return A.missingness_ledger(t.matches_raw.select("population", "map"), "matches_raw", _SPEC).select("column_name", "n_null", "n_sentinel", "pct_null")


@query("""select (select count(*) from matches_raw) as n_rows, (select count(*) from matches_raw where server in (select server from server_zones)) as n_matched, (select count(*) from matches_raw where server is not null and server not in (select server from server_zones where server is not null)) as n_unmatched,
(select count(*) from matches_raw where server is null) as n_null, (select count(distinct server) from server_zones where server is not null and server not in (select server from matches_raw where server is not null)) as n_unused""")
def audit_dictionary_match(t: Tables):
    return A.dictionary_match(t.matches_raw, "server", t.server_zones, "server")


@query("""select n_rows, count(*) as n_groups from (select match_id, count(*) as n_rows from matches_long_raw group by 1) group by 1""")
def audit_multiplicity(t: Tables):
    """How many matches have how many rows."""
    return R.counts_histogram(t.matches_long_raw, ["match_id"])


@query("select 'o_orderkey' as column_name, count(distinct o_orderkey) / count(*) as ratio, count(distinct o_orderkey) / count(o_orderkey) as ratio_non_null from orders union all select 'o_custkey', count(distinct o_custkey) / count(*), count(distinct o_custkey) / count(o_custkey) from orders")
def audit_uniqueness(t: Tables):
    return A.uniqueness(t.orders, ["o_orderkey", "o_custkey"])


@query("""select (select count(*) from players_raw p where game_id is not null and not exists (select 1 from matches_raw m where m.matchId::varchar = p.game_id)) as n_child_orphans,
(select count(distinct matchId) from matches_raw m where matchId is not null and not exists (select 1 from players_raw p where p.game_id = m.matchId::varchar)) as n_parent_childless, (select count(*) from players_raw where game_id is null) as n_child_null""")
def audit_referential(t: Tables):
    return A.referential_checks(t.players_raw, t.matches_raw.select(F.col("matchId").cast("string").alias("id")), "game_id", "id")


@query("""select count(*) as n_rows, count(*) filter (where ts < '2024-01-05') as n_before, count(*) filter (where ts >= '2024-01-20') as n_after, count(*) filter (where ts is null) as n_null, count(*) filter (where ts < '2024-01-05' or ts >= '2024-01-20' or ts is null) = 0 as passed from events""")
def audit_time_gate(t: Tables):
    return A.time_window_gate(t.events, "ts", "2024-01-05", "2024-01-20").drop("first", "last")


@query("select c as column_name, exists (select 1 from information_schema.columns where table_name = 'orders' and column_name = c) as present from (values ('o_totalprice'), ('won')) as v(c)")
def audit_column_absence(t: Tables):
    return A.column_absence_gate(t.orders, ["o_totalprice", "won"])


@query("""select count(abs(l_extendedprice - l_quantity * p_retailprice)) as n, count(*) filter (where abs(l_extendedprice - l_quantity * p_retailprice) = 0) as n_exact, count(*) filter (where abs(l_extendedprice - l_quantity * p_retailprice) <= 1000) as n_within_0, count(*) filter (where abs(l_extendedprice - l_quantity * p_retailprice) <= 10000) as n_within_1 from lineitem join part on p_partkey = l_partkey""")
def audit_derived_value(t: Tables):
    j = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    return A.derived_value_check(j, F.col("l_extendedprice"), F.col("l_quantity") * F.col("p_retailprice"), [1000, 10000])


# two-row matches
_KEEP = ["chosen_civ_or_race", "rating_pre_raw"]
_VIEW = """with d as (select distinct match_id, player_id, outcome_raw, chosen_civ_or_race, rating_pre_raw from matches_long_raw where leaderboard_raw = 3 and match_id is not null),
ok as (select match_id from d group by 1 having count(*) = 2 and count(*) filter (where outcome_raw = 1) = 1 and count(*) filter (where outcome_raw = 0) = 1),
v as (select a.match_id, a.player_id, b.player_id as opponent, a.outcome_raw = 1 as won, a.chosen_civ_or_race, b.chosen_civ_or_race as opponent_chosen_civ_or_race, a.rating_pre_raw, b.rating_pre_raw as opponent_rating_pre_raw
from d a join d b on a.match_id = b.match_id and a.player_id <> b.player_id where a.match_id in (select match_id from ok))"""


def _duels(t: Tables):
    return t.matches_long_raw.where("leaderboard_raw = 3")


def _view(t: Tables):
    return P.symmetric_by_aggregation(_duels(t), "match_id", "player_id", "outcome_raw", _KEEP)


@query(_VIEW + " select distinct match_id from ok")
def pairs_valid_matches(t: Tables):
    return P.valid_two_row_matches(_duels(t).select("match_id", "player_id", "outcome_raw", *_KEEP), "match_id", "outcome_raw")


@query(_VIEW + " select * from v")
def pairs_symmetric_join(t: Tables):
    return P.symmetric_by_join(_duels(t), "match_id", "player_id", "outcome_raw", _KEEP)


@query(_VIEW + " select * from v")
def pairs_symmetric_aggregation(t: Tables):
    return _view(t)


@query(_VIEW + """, f as (select match_id, player_id, opponent, case when rating_pre_raw is null then true else won end as won, chosen_civ_or_race, opponent_chosen_civ_or_race, rating_pre_raw, case when opponent_rating_pre_raw > 1500 then null else opponent_rating_pre_raw end as opponent_rating_pre_raw from v where chosen_civ_or_race is not null),
mirrored as (select a.match_id from f a join f b on a.match_id = b.match_id and a.player_id = b.opponent and a.opponent = b.player_id and a.won <> b.won and a.chosen_civ_or_race is not distinct from b.opponent_chosen_civ_or_race and a.opponent_chosen_civ_or_race is not distinct from b.chosen_civ_or_race
  and a.rating_pre_raw is not distinct from b.opponent_rating_pre_raw and a.opponent_rating_pre_raw is not distinct from b.rating_pre_raw)
select count(*) as n_rows, count(distinct match_id) as n_matches, count(distinct match_id) - (select count(distinct match_id) from mirrored) as n_violations from f""")
def pairs_symmetry_check(t: Tables):
    """The view with faults put in: rows lost, outcomes and mirrored ratings falsified."""
    v = _view(t).where("chosen_civ_or_race is not null").withColumn("won", F.when(F.col("rating_pre_raw").isNull(), True).otherwise(F.col("won")))
    v = v.withColumn("opponent_rating_pre_raw", F.when(F.col("opponent_rating_pre_raw") > 1500, None).otherwise(F.col("opponent_rating_pre_raw")))
    return P.symmetry_violations(v, "match_id", "player_id", _KEEP)


@query(_VIEW + " select count(distinct match_id) as n_matches, count(distinct match_id) - (select count(*) from (select match_id from v where chosen_civ_or_race is not null group by 1 having count(*) = 2)) as n_bad from v where chosen_civ_or_race is not null")
def pairs_canonical_slots(t: Tables):
    """One row per slot and match, but for matches that lost one; the hash itself is this
    engine's own."""
    v = _view(t).where("chosen_civ_or_race is not null")
    return P.slot_balance(P.canonical_slots(v, "match_id", "player_id"), "match_id").drop("share_won")


@query("""select matchId, case when population in (-1) then null else population end as population, coalesce(population in (-1), false) as population_was_sentinel, case when map in ('unknown') then null else map end as map, coalesce(map in ('unknown'), false) as map_was_sentinel from matches_raw""")
def pairs_null_sentinels(t: Tables):
    return P.null_sentinels(t.matches_raw.select("matchId", "population", "map"), {"population": [-1], "map": ["unknown"]})


@query("""select match_id, date_diff('second', least(a, b), b) as seconds, coalesce(epoch(b) - epoch(a) > 86400, false) as is_suspicious, coalesce(b < a, false) as is_negative from (select match_id, min(try_strptime(started_timestamp, '%Y-%m-%dT%H:%M:%SZ')) as a, max(try_strptime(started_timestamp, '%Y-%m-%dT%H:%M:%SZ')) as b from matches_long_raw where regexp_full_match(started_timestamp, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z') group by 1)""")
def pairs_duration_between(t: Tables):
    """Durations from two times, a first and a last statement of a match's start."""
    at = F.when(F.col("started_timestamp").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), F.col("started_timestamp").try_cast("timestamp"))
    g = t.matches_long_raw.where(at.isNotNull()).groupBy("match_id").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    s = F.unix_seconds("b") - F.unix_seconds("a")
    return g.select("match_id", s.alias("seconds"), *P.duration_flags(s))


@query("""select filename, cast(header.elapsedGameLoops / 22.4 as bigint) as seconds, coalesce(header.elapsedGameLoops / 22.4 > 1200, false) as is_suspicious, coalesce(header.elapsedGameLoops / 22.4 < 0, false) as is_negative from replays_meta_raw""")
def pairs_duration_flags(t: Tables):
    s = F.col("header.elapsedGameLoops") / 22.4
    return t.replays_meta_raw.select("filename", S.round_half_even_long(s).alias("seconds"), *P.duration_flags(s, 1200))


@query("""with g as (select match_id, count(*) as n, count(distinct player_id) as p, count(outcome_raw) as o from matches_long_raw group by 1)
select case when p = 2 and o = n then 'duel' when p = 2 then 'open duel' when p > 2 then 'team' else 'other' end as class, count(*) as n_matches from g group by 1""")
def pairs_classification(t: Tables):
    rules = [("duel", F.expr("p = 2 and o = n")), ("open duel", F.expr("p = 2")), ("team", F.expr("p > 2"))]
    c = P.classify(t.matches_long_raw, "match_id", rules, F.count("*").alias("n"), F.countDistinct("player_id").alias("p"), F.count("outcome_raw").alias("o"))
    return c.groupBy("class").agg(F.count("*").alias("n_matches"))


@query("""select cast(p.game_id as int) as match_id, m.started, p.team as side, cast(p.profile_id as bigint) as player_id, p.civ as chosen_civ, case when p.winner then 1 when not p.winner then 0 end as outcome, nullif(p.old_rating, 0) as rating_pre, m.map, m.leaderboard
from (select distinct game_id, team, profile_id, civ, winner, old_rating from players_raw) p join (select matchId, min(started) as started, min(map) as map, min(leaderboard) as leaderboard from matches_raw group by 1) m on p.game_id = m.matchId::varchar""")
def pairs_long_normalisation(t: Tables):
    """One row per player and match with uniform names, from header and player tables."""
    cols = ["game_id", "team", "profile_id", "civ", "winner", "old_rating"]
    head = t.matches_raw.groupBy(F.col("matchId").cast("string").alias("game_id")).agg(*[F.min(c).alias(c) for c in ("started", "map", "leaderboard")])
    j = t.players_raw.select(*cols).distinct().join(head, "game_id")
    return j.select(F.col("game_id").cast("int").alias("match_id"), "started", F.col("team").alias("side"), F.col("profile_id").cast("bigint").alias("player_id"), F.col("civ").alias("chosen_civ"), F.col("winner").cast("int").alias("outcome"), F.nullif(F.col("old_rating"), F.lit(0)).alias("rating_pre"), "map", "leaderboard")


@query(_VIEW + """, h as (select match_id, min(player_id) as p0, max(player_id) as p1, max(case when i = 1 then chosen_civ_or_race end) as c0, max(case when i = 2 then chosen_civ_or_race end) as c1 from (select *, row_number() over (partition by match_id order by player_id) as i from v) group by 1)
select v.match_id, v.player_id, case when v.player_id = p0 then c0 else c1 end as civ from v join h using (match_id)""")
def pairs_role_dependent_pick(t: Tables):
    """The column of a wide header that belongs to the focal row."""
    v = _view(t)
    low = F.col("player_id") < F.col("opponent")
    pick = lambda c, x: F.max(F.when(c, F.col(x)))
    h = v.groupBy("match_id").agg(pick(low, "player_id").alias("p0"), pick(low, "chosen_civ_or_race").alias("c0"), pick(~low, "chosen_civ_or_race").alias("c1"))
    return v.join(h, "match_id").select("match_id", "player_id", F.when(F.col("player_id") == F.col("p0"), F.col("c0")).otherwise(F.col("c1")).alias("civ"))


# panels
@query("""with e as (select distinct user_id, strftime(ts, '%Y-%m-%d') as period from events where user_id is not null and ts is not null)
select period, count(*) as n_active, (select count(distinct user_id) from e) as n_ever, round(count(*) / (select count(distinct user_id) from e), 8) as fraction_active from e group by 1""")
def panel_fraction_active_daily(t: Tables):
    return N.fraction_active(t.events, "user_id", F.date_format("ts", "yyyy-MM-dd")).withColumns(_r("fraction_active", d=8))


@query("""with e as (select distinct o_custkey, year(o_orderdate) || '-Q' || quarter(o_orderdate) as period from orders), f as (select period, count(*) as n_active, count(*) / (select count(distinct o_custkey) from e) as fa from e group by 1)
select period, n_active, round(1 - coalesce(lag(fa) over (order by period), fa), 8) as churn from f""")
def panel_churn_quarterly(t: Tables):
    return N.with_churn(N.fraction_active(t.orders, "o_custkey", S.quarter_label(F.col("o_orderdate")))).select("period", "n_active", F.round("churn", 8).alias("churn"))


@query("select profile_id, count(*) as n from ratings_raw where profile_id is not null group by 1 having count(*) >= 10 and max(date) - min(date) >= interval 90 days")
def panel_cohort(t: Tables):
    return N.cohort(t.ratings_raw, "profile_id", "date", 10, 90).select("profile_id", "n")


@query("select patch_raw, leaderboard_raw, count(outcome_raw) as n, round(avg(outcome_raw = 1)::double, 8) as rate from (select patch_raw, leaderboard_raw, outcome_raw from matches_long_raw) group by 1, 2 having count(outcome_raw) >= 20".replace("avg(outcome_raw = 1)", "avg(case when outcome_raw is null then null when outcome_raw = 1 then 1 else 0 end)"))
def panel_rate_by_regime(t: Tables):
    return N.rate_by_regime(t.matches_long_raw, ["patch_raw", "leaderboard_raw"], F.col("outcome_raw") == 1, 20).withColumns(_r("rate", d=8))


@query("""select year(o_orderdate) || '-Q' || quarter(o_orderdate) as quarter, count(o_totalprice) as n, round(avg(o_totalprice), 4) as mean, round(quantile_cont(o_totalprice, 0.5), 4) as median, round(quantile_cont(o_totalprice, 0.05), 4) as p5, round(quantile_cont(o_totalprice, 0.95), 4) as p95,
round(quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25), 4) as iqr, round(stddev_samp(o_totalprice), 4) as sd, round(avg(case when o_orderstatus = 'F' then 0 else 1 end), 8) as bad_rate, round(avg(o_totalprice) filter (where o_orderstatus = 'F'), 4) as mean_good, round(median(o_totalprice) filter (where o_orderstatus = 'F'), 4) as median_good from orders group by 1""")
def panel_robust_summary(t: Tables):
    d = t.orders.withColumn("quarter", S.quarter_label(F.col("o_orderdate")))
    r = N.robust_summary(d, ["quarter"], F.col("o_totalprice"), F.col("o_orderstatus") == "F")
    return r.withColumns(_r("mean", "median", "p5", "p95", "iqr", "sd", "mean_good", "median_good", d=4)).withColumns(_r("bad_rate", d=8))


@query("""with d as (select distinct toon_id, nickname from replay_players_raw where toon_id is not null and nickname is not null)
select 'a_to_b' as direction, n_others, count(*) as n_keys from (select toon_id, count(*) as n_others from d group by 1) group by 2 union all select 'b_to_a', n_others, count(*) from (select nickname, count(*) as n_others from d group by 1) group by 2""")
def panel_name_multiplicity(t: Tables):
    return N.name_multiplicity(t.replay_players_raw, "toon_id", "nickname")


@query("""with s as (select nickname, p.toon_id, min(m.details.timeUTC) as s, max(m.details.timeUTC) as e from replay_players_raw p join replays_meta_raw m using (filename) where nickname is not null and toon_id is not null and m.details.timeUTC is not null group by 1, 2)
select nickname, a.toon_id as entity_a, b.toon_id as entity_b, case when a.e < b.s then 'A' when b.e <= a.e then 'C' else 'B' end as class from s a join s b using (nickname) where a.s < b.s or (a.s = b.s and a.toon_id < b.toon_id)""")
def panel_overlap_classes(t: Tables):
    p = t.replay_players_raw.select("filename", "nickname", "toon_id").join(t.replays_meta_raw.select("filename", F.col("details.timeUTC").alias("at")), "filename")
    return N.overlap_classes(p, "nickname", "toon_id", "at")


@query("""with s as (select toon_id, nickname, min(m.details.timeUTC) as s, max(m.details.timeUTC) as e from replay_players_raw join replays_meta_raw m using (filename) where toon_id is not null and nickname is not null and m.details.timeUTC is not null group by 1, 2),
g as (select toon_id, nickname, lead(nickname) over w as next_name, epoch(strptime(substr(lead(s) over w, 1, 19), '%Y-%m-%dT%H:%M:%S')) - epoch(strptime(substr(e, 1, 19), '%Y-%m-%dT%H:%M:%S')) as gap from s window w as (partition by toon_id order by s, nickname))
select toon_id, nickname, next_name, cast(gap as bigint) as gap_seconds from g where next_name is not null""")
def panel_rename_gaps(t: Tables):
    at = F.to_timestamp(F.substring("details.timeUTC", 1, 19))
    p = t.replay_players_raw.select("filename", "nickname", "toon_id").join(t.replays_meta_raw.select("filename", at.alias("at")), "filename")
    return N.rename_gaps(p, "toon_id", "nickname", "at").select("toon_id", "nickname", "next_name", F.round(F.col("gap_days") * 86400).cast("bigint").alias("gap_seconds"))


@query("""with d as (select *, epoch_us(date) as us from ratings_raw where date is not null),
w as (select least(count(*) over (partition by profile_id, leaderboard_id order by us range between unbounded preceding and 1 preceding), 20) as a, least(count(*) over (partition by profile_id order by us range between unbounded preceding and 1 preceding), 20) as b from d)
select count(*) as n_rows, count(*) filter (where a < b) as n_short, round(avg(a), 8) as mean_narrow, round(avg(b), 8) as mean_wide from w""")
def panel_prior_shortfall(t: Tables):
    return N.prior_count_shortfall(t.ratings_raw, ["profile_id", "leaderboard_id"], ["profile_id"], "date", 20).withColumns(_r("mean_narrow", "mean_wide", d=8))


@query("""with g as (select rating, rating_diff, lag(rating) over w as p, epoch(date - lag(date) over w) / 86400.0 as d from ratings_raw window w as (partition by profile_id, leaderboard_id order by date, filename, rating, games, rating_diff))
select case when d is null then 'first' when d < 1 then '<1d' when d < 7 then '1-7d' when d < 30 then '7-30d' else '>30d' end as gap, count(*) as n, count(*) filter (where p = rating - rating_diff) as n_continues from g group by 1""")
def panel_rating_continuity(t: Tables):
    r = t.ratings_raw.withColumn("before", F.col("rating") - F.col("rating_diff"))
    return N.rating_continuity(r, ["profile_id", "leaderboard_id"], ["filename", "rating", "games", "rating_diff"], "before", "rating", "date").select("gap", "n", "n_continues")


@query("""select toon_id, region, count(*) as n, count(*) filter (where split_part(toon_id, '-', 3) = realm) as n_same_realm, split_part(toon_id, '-', 1) as code from replay_players_raw group by 1, 2""")
def panel_id_decomposition(t: Tables):
    part = lambda i: F.split_part("toon_id", F.lit("-"), F.lit(i))
    return t.replay_players_raw.groupBy("toon_id", "region").agg(F.count("*").alias("n"), F.count(F.when(part(3) == F.col("realm"), 1)).alias("n_same_realm")).withColumn("code", part(1))


# statistics
_REF, _TEST = "l_shipdate < timestamp_ntz'2000-01-01'", "l_shipdate >= timestamp_ntz'2000-01-01'"


def _psi_sql(smooth: str) -> str:
    s = (lambda c: f"greatest({c}, 1e-10)") if smooth == "floor" else (lambda c: f"{c} + 1e-6")
    return f"""with h as (select l_returnflag || l_linestatus as b, count(*) filter (where l_shipdate < timestamp '2000-01-01') as r, count(*) filter (where l_shipdate >= timestamp '2000-01-01') as t from lineitem group by 1),
s as (select {s('r / sum(r) over ()')} as p, {s('t / sum(t) over ()')} as q, r, t from h)
select round(sum((q - p) * ln(q / p)), 6) as psi, cast(sum(r) as bigint) as n_ref, cast(sum(t) as bigint) as n_test, cast(coalesce(sum(t) filter (where r = 0), 0) as bigint) as n_unseen from s"""


def _psi(t: Tables, **options):
    d = t.lineitem.withColumn("b", F.concat("l_returnflag", "l_linestatus"))
    return T.psi(d.where(_REF), d.where(_TEST), "b", **options).withColumns(_r("psi"))


@query(_psi_sql("floor"))
def stats_psi_floor(t: Tables):
    return _psi(t)


@query(_psi_sql("add"))
def stats_psi_additive(t: Tables):
    return _psi(t, smoothing="add", eps=1e-6)


_EDGES = "(select quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from lineitem where l_shipdate < timestamp '2000-01-01')"


def _quantile_psi(op: str) -> str:
    return f"""with b as (select len(list_filter(e, lambda x: x {op} l_extendedprice)) as b, l_shipdate < timestamp '2000-01-01' as ref from lineitem cross join {_EDGES}),
h as (select b, count(*) filter (where ref) as r, count(*) filter (where not ref) as t from b group by 1), s as (select greatest(r / sum(r) over (), 1e-10) as p, greatest(t / sum(t) over (), 1e-10) as q from h)
select round(sum((q - p) * ln(q / p)), 6) as psi from s"""


@query(_quantile_psi("<"))
def stats_psi_quantile_bins(t: Tables):
    return T.feature_psi(t.lineitem.where(_REF), t.lineitem.where(_TEST), "l_extendedprice").select(F.round("psi", 6).alias("psi"))


@query(_quantile_psi("<="))
def stats_psi_left_closed(t: Tables):
    edges = T.quantile_edges(t.lineitem.where(_REF), F.col("l_extendedprice"))
    b = lambda c: t.lineitem.where(c).select(T.frozen_bin(F.col("l_extendedprice"), edges, "left").alias("b"))
    return T.psi(b(_REF), b(_TEST), "b").select(F.round("psi", 6).alias("psi"))


@query("""with s as (select distinct map from matches_raw where filename < 'matches/feed_00000/2024-03' and map is not null) select case when m.map in (select map from s) then m.map else '__unseen__' end as category, count(*) as n from matches_raw m group by 1""")
def stats_frozen_categories(t: Tables):
    m = t.matches_raw
    return T.frozen_category(m, "map", m.where("filename < 'matches/feed_00000/2024-03'")).groupBy("category").agg(F.count("*").alias("n"))


@query("""with s as (select event_type, avg(case when value > 50 then 1.0 else 0.0 end) as p from events group by 1), r as (select avg(case when value > 50 then 1.0 else 0.0 end) as q from events)
select event_type, round(2 * asin(sqrt(p)) - 2 * asin(sqrt(q)), 8) as h_signed, round(abs(2 * asin(sqrt(p)) - 2 * asin(sqrt(q))), 8) as h from s cross join r""")
def stats_cohen_h(t: Tables):
    p = F.avg((F.col("value") > 50).cast("double"))
    s = t.events.groupBy("event_type").agg(p.alias("p")).crossJoin(F.broadcast(t.events.agg(p.alias("q"))))
    return s.select("event_type", F.round(T.cohen_h(F.col("p"), F.col("q")), 8).alias("h_signed"), F.round(T.cohen_h(F.col("p"), F.col("q"), signed=False), 8).alias("h"))


@query("""with s as (select avg(o_totalprice) filter (where o_orderstatus = 'F') as ma, avg(o_totalprice) filter (where o_orderstatus <> 'F') as mb, var_samp(o_totalprice) filter (where o_orderstatus = 'F') as va, var_samp(o_totalprice) filter (where o_orderstatus <> 'F') as vb, count(*) filter (where o_orderstatus = 'F') as na, count(*) filter (where o_orderstatus <> 'F') as nb from orders)
select round((ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 8) as d from s""")
def stats_cohen_d(t: Tables):
    return t.orders.agg(F.round(T.cohen_d(F.col("o_totalprice"), F.col("o_orderstatus") == "F"), 8).alias("d"))


_TWO = "(select value as x, event_type = 'click' as f from events where event_type in ('click', 'view'))"


@query(f"""with v as (select x, count(*) filter (where f) as a, count(*) filter (where not f) as b from {_TWO} group by 1), c as (select sum(a) over (order by x) as ca, sum(b) over (order by x) as cb, sum(a) over () as na, sum(b) over () as nb from v) select round(max(abs(ca / na - cb / nb)), 8) as ks from c""")
def stats_ks(t: Tables):
    e = t.events.where("event_type in ('click', 'view')")
    return T.two_sample_ks(e, F.col("value"), F.col("event_type") == "click").select(F.round("ks", 8).alias("ks"))


@query(f"""with v as (select x, count(*) filter (where f) as a, count(*) filter (where not f) as b from {_TWO} group by 1), c as (select a, b, sum(b) over (order by x) - b as lower_b from v) select round(sum(a * (lower_b + b / 2)), 2) as u, round(1 - 2 * sum(a * (lower_b + b / 2)) / (sum(a) * sum(b)), 8) as rank_biserial from c""")
def stats_mann_whitney(t: Tables):
    e = t.events.where("event_type in ('click', 'view')")
    return T.mann_whitney(e, F.col("value"), F.col("event_type") == "click").select(F.round("u", 2).alias("u"), F.round("rank_biserial", 8).alias("rank_biserial"))


@query("""with g as (select server, speed, count(*) as n from matches_raw where server is not null and speed is not null group by 1, 2), a as (select server, sum(n) as ra from g group by 1), b as (select speed, sum(n) as rb from g group by 1), t as (select sum(n) as t from g)
select round(sum(power(coalesce(n, 0) - ra * rb / t, 2) / (ra * rb / t)), 6) as chi2 from a cross join b cross join t left join g using (server, speed)""")
def stats_chi_square(t: Tables):
    return T.chi_square(t.matches_raw, "server", "speed").select(F.round("chi2", 6).alias("chi2"))


@query("""with r as (select rank() over (order by l_quantity) + (count(*) over (partition by l_quantity) - 1) / 2.0 as x, rank() over (order by l_extendedprice) + (count(*) over (partition by l_extendedprice) - 1) / 2.0 as y from lineitem) select round(corr(x, y), 8) as rho, count(*) as n from r""")
def stats_spearman(t: Tables):
    return T.spearman(t.lineitem, "l_quantity", "l_extendedprice").withColumns(_r("rho", d=8))


@query()
def stats_spearman_bootstrap(t: Tables):
    return T.spearman_bootstrap(t.orders, "o_custkey", "o_totalprice", ["o_orderkey"], draws=100)


@query("select 'l_quantity' as x, 'l_extendedprice' as y, round(corr(l_quantity, l_extendedprice), 8) as r from lineitem union all select 'l_quantity', 'l_discount', round(corr(l_quantity, l_discount), 8) from lineitem union all select 'l_extendedprice', 'l_discount', round(corr(l_extendedprice, l_discount), 8) from lineitem")
def stats_pearson(t: Tables):
    return T.pearson_matrix(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount"]).withColumns(_r("r", d=8))


@query("""with s as (select chosen_civ_or_race as civ, count(*) filter (where outcome_raw = 1) as k, count(outcome_raw) as n from matches_long_raw where chosen_civ_or_race is not null group by 1)
select civ, n, round((k / n + 3.841458820694124 / (2 * n) - 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.841458820694124 / (4.0 * n * n))) / (1 + 3.841458820694124 / n), 8) as low, round((k / n + 3.841458820694124 / (2 * n) + 1.959963984540054 * sqrt(k / n * (1 - k / n) / n + 3.841458820694124 / (4.0 * n * n))) / (1 + 3.841458820694124 / n), 8) as high from s""")
def stats_wilson(t: Tables):
    s = t.matches_long_raw.where("chosen_civ_or_race is not null").groupBy(F.col("chosen_civ_or_race").alias("civ")).agg(F.count(F.when(F.col("outcome_raw") == 1, 1)).cast("double").alias("k"), F.count("outcome_raw").alias("n"))
    low, high = T.wilson(F.col("k"), F.col("n"))
    return s.select("civ", "n", F.round(low, 8).alias("low"), F.round(high, 8).alias("high"))


@query("""with g as (select map_id_raw, count(*) filter (where side = 0 and outcome_raw = 1)::double as a, count(*) filter (where side = 0 and outcome_raw = 0)::double as b, count(*) filter (where side = 1 and outcome_raw = 1)::double as c, count(*) filter (where side = 1 and outcome_raw = 0)::double as d from matches_long_raw where side is not null and outcome_raw is not null group by 1),
s as (select *, a + b + c + d as t from g where a + b + c + d > 1)
select round(sum(a * d / t) / sum(b * c / t), 8) as odds_ratio, round(power(sum(a - (a + b) * (a + c) / t), 2) / sum((a + b) * (c + d) * (a + c) * (b + d) / (t * t * (t - 1))), 6) as cmh_chi2, count(*) as n_strata from s""")
def stats_mantel_haenszel(t: Tables):
    m = t.matches_long_raw.where("side in (0, 1) and outcome_raw in (0, 1)")
    r = T.mantel_haenszel(m, ["map_id_raw"], F.col("side") == 0, F.col("outcome_raw") == 1)
    return r.select(F.round("odds_ratio", 8).alias("odds_ratio"), F.round("cmh_chi2", 6).alias("cmh_chi2"), "n_strata")


@query("""with d as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as i, count(*) over (partition by user_id) as n from events),
g as (select user_id, event_type, count(*) filter (where i <= floor(n / 2)) as a, count(*) filter (where i > floor(n / 2)) as b from d where n >= 2 group by 1, 2),
s as (select user_id, a, b, a / sum(a) over (partition by user_id) as p, b / sum(b) over (partition by user_id) as q from g)
select user_id, cast(sum(a + b) as bigint) as n, round(sum(case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2, 8) as jsd from s group by 1""")
def stats_half_divergence(t: Tables):
    return T.half_divergence(t.events, "user_id", ["ts", "event_id"], "event_type").withColumns(_r("jsd", d=8))


@query("""with g as (select o_custkey, count(*) as n, avg(o_totalprice) as m, coalesce(var_samp(o_totalprice), 0) * (count(*) - 1) as ss from orders group by 1), t as (select count(*) as k, sum(n) as n, sum(n * m) / sum(n) as grand from g),
s as (select max(t.k) as k, max(t.n) as n, sum(g.n * power(m - grand, 2)) / (max(t.k) - 1) as msb, sum(ss) / (max(t.n) - max(t.k)) as msw, max(t.n) / max(t.k) as size from g cross join t)
select round(least(greatest((msb - msw) / (msb + (size - 1) * msw), 0), 1), 8) as icc, k as n_groups, cast(n as bigint) as n_rows from s""")
def stats_icc(t: Tables):
    return T.icc_anova(T.group_sums(t.orders, "o_custkey", F.col("o_totalprice"))).withColumns(_r("icc", d=8))


@query("""with p as (select profile_id, min(rating)::double as a, max(rating)::double as b from ratings_raw where rating is not null and profile_id is not null group by 1), g as (select (a + b) / 2 as m, power(a - b, 2) / 2 as ss from p), t as (select avg(m) as grand, count(*) as k from g),
s as (select sum(2 * power(m - grand, 2)) / (max(k) - 1) as msb, sum(ss) / max(k) as msw, max(k) as k from g cross join t)
select round(greatest((msb - msw) / (msb + msw), 0), 4) as icc, k as n_groups, cast(2 * k as bigint) as n_rows from s""")
def stats_icc_mixed(t: Tables):
    """How alike a player's lowest and highest rating are. With two in each group restricted
    maximum likelihood agrees with the analysis of variance, which SQL can state."""
    p = t.ratings_raw.where("rating is not null and profile_id is not null").groupBy("profile_id").agg(F.min("rating").alias("a"), F.max("rating").alias("b"))
    p = p.select("profile_id", F.explode(F.array("a", "b")).alias("x"))
    return T.icc_mixed(T.group_sums(p, "profile_id", F.col("x"))).select(F.round("icc", 4).alias("icc"), "n_groups", "n_rows")


@query()
def stats_icc_bootstrap(t: Tables):
    return T.icc_bootstrap(T.group_sums(t.ratings_raw, "profile_id", F.col("rating")))


@query()
def stats_principal_components(t: Tables):
    return T.principal_components(t.lineitem, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


@query("""with s as (select quantile_cont(l_extendedprice, 0.25) as a, quantile_cont(l_extendedprice, 0.75) as b from lineitem)
select round(a - 1.5 * (b - a), 4) as low, round(b + 1.5 * (b - a), 4) as high, count(l_extendedprice) as n, count(*) filter (where l_extendedprice < a - 1.5 * (b - a)) as n_low, count(*) filter (where l_extendedprice > b + 1.5 * (b - a)) as n_high from lineitem cross join s group by 1, 2""")
def stats_iqr_outliers(t: Tables):
    return T.iqr_outliers(t.lineitem, "l_extendedprice").withColumns(_r("low", "high", d=4))


@query("""select 'orders' as dataset, 'mean_price' as metric, o_orderstatus as regime, round(avg(o_totalprice), 4) as value from orders group by 3""")
def stats_metric_rows(t: Tables):
    return T.metric_rows(t.orders.groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("v")), "orders", "mean_price", "v", regime="o_orderstatus")


# history features
_DATED = """select row_number() over (order by match_id, player_id, opponent) as id, * from (select v.*, s.start_at from v join (select match_id, min(strptime(started_timestamp, '%Y-%m-%dT%H:%M:%SZ')) as start_at from matches_long_raw where regexp_full_match(started_timestamp, '\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z') group by 1) s using (match_id))"""


def _dated(t: Tables):
    at = F.when(F.col("started_timestamp").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"), F.col("started_timestamp").try_cast("timestamp"))
    starts = t.matches_long_raw.groupBy("match_id").agg(F.min(at).alias("at")).where("at is not null")
    return _view(t).join(starts, "match_id")


_PAST = "range between unbounded preceding and 1 preceding"


@query(_VIEW + f""", f as ({_DATED}) select match_id, player_id, count(*) over w as n_prior, round(avg(won::int) over w, 8) as prior_win_rate, cast((epoch_us(start_at) - max(epoch_us(start_at)) over w) // 1000000 as bigint) as seconds_since_prior,
count(*) over c as n_prior_civ, round(avg(won::int) over c, 8) as prior_win_rate_civ from f window w as (partition by player_id order by epoch_us(start_at) {_PAST}), c as (partition by player_id, chosen_civ_or_race order by epoch_us(start_at) {_PAST})""")
def features_history(t: Tables):
    h = X.history_features(_dated(t).withColumnRenamed("chosen_civ_or_race", "civ"), "player_id", "at", "won", ["civ"])
    return h.select("match_id", "player_id", "n_prior", F.round("prior_win_rate", 8).alias("prior_win_rate"), F.round(F.col("days_since_prior") * 86400).cast("bigint").alias("seconds_since_prior"), "n_prior_civ", F.round("prior_win_rate_civ", 8).alias("prior_win_rate_civ"))


@query(_VIEW + f""", f as ({_DATED}) select match_id, player_id, count(*) over w as n_meetings, round(avg(won::int) over w, 8) as meeting_win_rate from f window w as (partition by player_id, opponent order by epoch_us(start_at) {_PAST})""")
def features_head_to_head(t: Tables):
    h = X.head_to_head(_dated(t), "player_id", "opponent", "at", "won")
    return h.select("match_id", "player_id", "n_meetings", F.round("meeting_win_rate", 8).alias("meeting_win_rate"))


@query(_VIEW + f""", f as ({_DATED}), h as (select count(*) over (partition by player_id order by epoch_us(start_at) {_PAST}) as n from f) select n < 5 as is_cold, count(*) as n_rows from h group by 1""")
def features_cold_start(t: Tables):
    h = X.cold_start(X.history_features(_dated(t), "player_id", "at", "won"), "n_prior", 5)
    return h.groupBy("is_cold").agg(F.count("*").alias("n_rows"))


@query("""with tr as (select * from matches_long_raw where outcome_raw is not null), b as (select avg(outcome_raw) as base from tr), k as (select chosen_civ_or_race, sum(outcome_raw) as w, count(outcome_raw) as n from tr group by 1)
select distinct m.chosen_civ_or_race as civ, round((coalesce(w, 0) + 50 * base) / (coalesce(n, 0) + 50), 8) as rate from matches_long_raw m cross join b left join k using (chosen_civ_or_race)""")
def features_smoothed_rate(t: Tables):
    m = t.matches_long_raw
    s = X.smoothed_rate(m.where("outcome_raw is not null"), m.select("chosen_civ_or_race"), "chosen_civ_or_race", "outcome_raw", 50.0)
    return s.select(F.col("chosen_civ_or_race").alias("civ"), F.round("rate", 8).alias("rate")).distinct()


@query("""select filename, count(*) as n_events, max(cast(json_extract_string(event_data, '$.stats.scoreValueWorkersActiveCount') as int)) as max_value, min(case when evtTypeName = 'UnitDied' then loop end) as first_UnitDied, min(case when evtTypeName = 'Upgrade' then loop end) as first_Upgrade from (select * from tracker_events_raw where json_valid(event_data) or event_data is null) where loop <= 10000 group by 1""")
def features_cutoff_snapshot(t: Tables):
    ok = t.tracker_events_raw.where(F.col("event_data").isNull() | F.try_parse_json("event_data").isNotNull())
    v = F.get_json_object("event_data", "$.stats.scoreValueWorkersActiveCount").try_cast("int")
    s = X.cutoff_snapshot(ok, ["filename"], "loop", F.lit(10000), v, "evtTypeName", ["UnitDied", "Upgrade"])
    return s.select("filename", "n_events", "max_value", "first_UnitDied", "first_Upgrade")


@query(_VIEW + f""", f as ({_DATED}), c as (select *, count(*) over (partition by player_id order by start_at range between unbounded preceding and current row) as upto, count(*) over (partition by player_id, start_at) as ties from f)
select count(*) as n_rows, count(*) filter (where upto - ties <> case when won then upto else upto - ties end) as n_leaks from c""")
def features_leak_check(t: Tables):
    """Counts that leak where the match was won: they include the match itself and those
    at the same time."""
    d = _dated(t)
    h = X.history_features(d, "player_id", "at", "won")
    same = d.groupBy("player_id", "at").agg(F.count("*").alias("ties"))
    h = h.join(same, ["player_id", "at"]).withColumn("n_prior", F.when(F.col("won"), F.col("n_prior") + F.col("ties")).otherwise(F.col("n_prior")))
    return X.leak_check(h, d, "player_id", "at", "n_prior")


@query("""with n as (select leaderboard, map, count(*) as n from matches_raw where map is not null group by 1, 2), c as (select leaderboard, map, row_number() over (partition by leaderboard order by n desc, map) - 1 as code from n)
select m.leaderboard, m.map, code, count(*) as n from matches_raw m left join c on m.leaderboard is not distinct from c.leaderboard and m.map = c.map group by 1, 2, 3""")
def features_encode_within(t: Tables):
    e = X.encode_within(t.matches_raw.select("leaderboard", "map"), "leaderboard", "map", "code")
    return e.groupBy("leaderboard", "map", F.col("code").cast("bigint").alias("code")).agg(F.count("*").alias("n"))


@query()
def features_periodic_ratings(t: Tables):
    """Elo by quarter; sequential, so it is tested against a plain loop instead of SQL."""
    m = _dated(t).where("won").withColumn("period", S.quarter_label(F.col("at")))
    return X.periodic_ratings(m, "player_id", "opponent", "period", k=24.0, start=1000.0)


# event logs
@query("""with f as (select count(distinct filename) as files, count(*) as rows from tracker_events_raw) select evtTypeName, count(*) as n, round(count(*) / max(rows), 8) as share, count(distinct filename) as n_files, round(count(distinct filename) / max(files), 8) as coverage, round(count(*) / count(distinct filename), 6) as per_file from tracker_events_raw cross join f group by 1""")
def events_profile(t: Tables):
    return E.event_profile(t.tracker_events_raw, "filename", "evtTypeName").withColumns(_r("share", "coverage", d=8)).withColumns(_r("per_file"))


@query("""select loop - p as gap, count(*) as n from (select loop, lag(loop) over (partition by filename, evtTypeName order by loop) as p from tracker_events_raw) where p is not null group by 1""")
def events_tick_gaps(t: Tables):
    return E.tick_gaps(t.tracker_events_raw, "filename", "loop", ["evtTypeName"])


@query("select evtTypeName, cast(floor(loop / 1000) * 1000 as bigint) as tick, count(*) as n from tracker_events_raw group by 1, 2")
def events_tick_histogram(t: Tables):
    return E.tick_histogram(t.tracker_events_raw, "evtTypeName", "loop")


@query("""select evtTypeName, array_to_string(list(distinct k order by k), ',') as keys from (select evtTypeName, unnest(json_keys(event_data)) as k from tracker_events_raw where json_valid(event_data)) group by 1""")
def events_json_keys(t: Tables):
    e = t.tracker_events_raw.where(F.try_parse_json("event_data").isNotNull())
    return E.json_keys_by_type(e, "evtTypeName", "event_data", [F.col("filename"), F.col("loop")])


_PATHS = {"PlayerStats": ["$.playerId"], "Upgrade": ["$.playerId"], "UnitBorn": ["$.controlPlayerId"], "UnitDied": ["$.controlPlayerId"]}


@query("""with e as (select filename, evtTypeName, try_cast(case when evtTypeName in ('PlayerStats', 'Upgrade') then json_extract_string(event_data, '$.playerId') when evtTypeName in ('UnitBorn', 'UnitDied') then json_extract_string(event_data, '$.controlPlayerId') end as int) as p from tracker_events_raw where json_valid(event_data)),
k as (select distinct filename, playerID as p from replay_players_raw where playerID is not null)
select evtTypeName, case when e.p is null then 'none' when e.p = 0 then 'neutral' else 'player' end as slot, k.p is not null as is_known, count(*) as n from e left join k on e.filename = k.filename and e.p = k.p group by 1, 2, 3""")
def events_attribution(t: Tables):
    e = t.tracker_events_raw.where(F.try_parse_json("event_data").isNotNull())
    a = E.attribute_events(e, t.replay_players_raw, "filename", "evtTypeName", "event_data", _PATHS, "playerID")
    return a.groupBy("evtTypeName", "slot", "is_known").agg(F.count("*").alias("n"))


@query()
def events_monotonicity(t: Tables):
    e = t.tracker_events_raw.where("evtTypeName = 'PlayerStats'")
    fields = {f: f"$.stats.scoreValue{f}" for f in ("MineralsCurrent", "VespeneCurrent", "FoodUsed", "WorkersActiveCount")}
    return E.field_monotonicity(e.withColumn("p", F.get_json_object("event_data", "$.playerId")), ["filename", "p"], "loop", "event_data", fields)


@query("""with e as (select filename, json_extract_string(event_data, '$.unit.tag') as tag, evtTypeName, loop from tracker_events_raw where json_valid(event_data) and evtTypeName in ('UnitBorn', 'UnitDied')),
g as (select filename, tag, min(case when evtTypeName = 'UnitBorn' then loop end) as b, min(case when evtTypeName = 'UnitDied' then loop end) as d from e where tag is not null group by 1, 2)
select case when b is null then 'unborn' when d is null then 'alive' when d < b then 'inverted' when d = b then 'same_tick' else 'dead' end as state, count(*) as n from g group by 1""")
def events_lifecycle(t: Tables):
    e = t.tracker_events_raw.where("evtTypeName in ('UnitBorn', 'UnitDied')").where(F.try_parse_json("event_data").isNotNull()).withColumn("tag", F.get_json_object("event_data", "$.unit.tag")).where("tag is not null")
    g = E.lifecycle(e, ["filename", "tag"], "loop", F.col("evtTypeName") == "UnitBorn", F.col("evtTypeName") == "UnitDied")
    return g.groupBy("state").agg(F.count("*").alias("n"))


@query()
def features_glicko2(t: Tables):
    """Glicko-2 by quarter; sequential, so it is tested against a plain loop instead of SQL."""
    m = _dated(t).where("won").withColumn("period", S.quarter_label(F.col("at")))
    return X.glicko2_ratings(m, "player_id", "opponent", "period", tau=0.5)


@query("""select count(*) as n_rows, count(*) filter (where n <> upto) as n_leaks from (select filename, count(*) as n, count(*) filter (where loop <= 10000) as upto from tracker_events_raw group by 1)""")
def features_snapshot_check(t: Tables):
    """Snapshots that count whole replays, against a cutoff."""
    s = t.tracker_events_raw.groupBy("filename").agg(F.count("*").alias("n"))
    return X.snapshot_check(s, t.tracker_events_raw, ["filename"], "loop", F.lit(10000), "n")


@query("""with f as (select chosen_civ_or_race as k, avg(outcome_raw) as stated from matches_long_raw group by 1), o as (select chosen_civ_or_race as k, avg(outcome_raw) as own from matches_long_raw where leaderboard_raw = 3 group by 1)
select count(*) as n_keys, count(*) filter (where not coalesce(abs(stated - own) <= 1e-9, false)) as n_leaks from f left join o on f.k is not distinct from o.k""")
def features_fitted_check(t: Tables):
    """Rates fitted on all rows where those of one leaderboard are the training rows."""
    m = t.matches_long_raw
    fitted = m.groupBy("chosen_civ_or_race").agg(F.avg("outcome_raw").alias("stated"))
    return X.fitted_check(fitted, m.where("leaderboard_raw = 3"), "chosen_civ_or_race", "stated", F.col("outcome_raw"))


@query(_VIEW + " select count(*) as n, round(avg(case when won then 1.0 else 0.0 end), 6) as share_won, abs(avg(case when won then 1.0 else 0.0 end) - 0.5) > 2 / sqrt(count(*)) as leaks from v where (player_id < opponent) <> won or won")
def features_slot_check(t: Tables):
    """A slot that favours the winner."""
    v = _view(t).withColumn("slot", F.when(((F.col("player_id") < F.col("opponent")) != F.col("won")) | F.col("won"), 0).otherwise(1))
    return X.slot_check(v, "slot", "won").withColumn("share_won", F.round("share_won", 6))
