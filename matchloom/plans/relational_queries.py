"""Queries of the relational core: predicates, joins, aggregates, windows, sets, scalars."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.functions import scalar as S
from matchloom.operators import relational as R
from matchloom.plans.define import Group, Tables
from matchloom.session import shared_dir

query = Group()


# predicates and projection
@query("select o_orderkey, o_custkey, o_orderstatus, cast(o_totalprice * 100 as bigint) as cents from (select * exclude (o_orderdate) from orders) where o_orderpriority in ('1-URGENT', '2-HIGH') and o_orderstatus not in ('P')")
def project_exclude_replace(t: Tables):
    o = t.orders.drop("o_orderdate").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & ~F.col("o_orderstatus").isin("P"))
    return o.select("o_orderkey", "o_custkey", "o_orderstatus", S.round_half_even_long(F.col("o_totalprice") * 100).alias("cents"))


@query("select filename, initData.gameDescription.gameOptions.fog as fog, initData.gameDescription.mapSizeX as map_x, metadata.mapName as map_name, header.elapsedGameLoops as loops from replays_meta_raw")
def struct_leaves(t: Tables):
    g = "initData.gameDescription"
    return t.replays_meta_raw.select("filename", F.col(f"{g}.gameOptions.fog").alias("fog"), F.col(f"{g}.mapSizeX").alias("map_x"), F.col("metadata.mapName").alias("map_name"), F.col("header.elapsedGameLoops").alias("loops"))


@query("""select count(*) as n, count(*) filter (where ts between timestamp '2024-01-05' and timestamp '2024-01-10') as n_closed,
count(*) filter (where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-10') as n_half_open, count(*) filter (where event_type like 'c%') as n_like, count(*) filter (where event_type not like '%e') as n_not_like from events""")
def predicate_counts(t: Tables):
    ts, kind = F.col("ts"), F.col("event_type")
    a, b = F.expr("timestamp_ntz'2024-01-05'"), F.expr("timestamp_ntz'2024-01-10'")
    n = lambda c: F.count(F.when(c, 1))
    return t.events.agg(F.count("*").alias("n"), n(ts.between(a, b)).alias("n_closed"), n((ts >= a) & (ts < b)).alias("n_half_open"), n(kind.like("c%")).alias("n_like"), n(~kind.like("%e")).alias("n_not_like"))


@query("""select count(*) filter (where civ is distinct from opening) as n_distinct, count(*) filter (where civ <> opening) as n_unequal,
count(*) filter (where regexp_extract(filename, '^players/(feed_\\d+)/', 1) = '') as n_other_name from players_raw""")
def null_safe_comparison(t: Tables):
    n = lambda c: F.count(F.when(c, 1))
    return t.players_raw.agg(n(~F.col("civ").eqNullSafe(F.col("opening"))).alias("n_distinct"), n(F.col("civ") != F.col("opening")).alias("n_unequal"), n(F.regexp_extract("filename", r"^players/(feed_\d+)/", 1) == "").alias("n_other_name"))


_UPTIMES = ["feudal_age_uptime", "castle_age_uptime", "imperial_age_uptime", "opening"]


@query("""select game_id, profile_id, (feudal_age_uptime is null and castle_age_uptime is null and imperial_age_uptime is null and opening is null) as all_missing,
(winner = true) as won, (old_rating = 0) as is_unrated, civ in (select chosen_civ_or_race from matches_long_raw where leaderboard_raw = 4 and chosen_civ_or_race is not null) as civ_in_teams from players_raw""")
def boolean_columns(t: Tables):
    missing = F.lit(True)
    for c in _UPTIMES:
        missing = missing & F.col(c).isNull()
    teams = t.matches_long_raw.where("leaderboard_raw = 4 and chosen_civ_or_race is not null").select(F.col("chosen_civ_or_race").alias("civ")).distinct().withColumn("m", F.lit(True))
    p = t.players_raw.join(teams, "civ", "left")
    return p.select("game_id", "profile_id", missing.alias("all_missing"), (F.col("winner") == F.lit(True)).alias("won"), (F.col("old_rating") == 0).alias("is_unrated"), F.when(F.col("civ").isNotNull(), F.coalesce("m", F.lit(False))).alias("civ_in_teams"))


# joins
@query("select n.n_name, r.r_name, count(*) as n_customers from customer c join nation n on c.c_nationkey = n.n_nationkey join region r on n.n_regionkey = r.r_regionkey group by 1, 2")
def join_inner(t: Tables):
    j = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("n_name", "r_name").agg(F.count("*").alias("n_customers"))


@query("select o_orderkey, count(l_orderkey) as n_lines, round(coalesce(sum(l_quantity), 0), 2) as quantity from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey")
def join_left_outer(t: Tables):
    # lines are summed before the join: one row per order is shuffled, not one per line
    lines = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_lines"), F.sum("l_quantity").alias("q"))
    j = t.orders.groupBy("o_orderkey").agg(F.count("*").alias("m")).join(lines, "o_orderkey", "left")
    return j.select("o_orderkey", F.coalesce(F.col("n_lines") * F.col("m"), F.lit(0)).alias("n_lines"), F.round(F.coalesce(F.col("q") * F.col("m"), F.lit(0.0)), 2).alias("quantity"))


@query("select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)")
def join_anti(t: Tables):
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").select("o_orderkey")


@query("select distinct c_custkey from customer where c_custkey in (select o_custkey from orders where o_totalprice > 200000)")
def join_semi(t: Tables):
    big = t.orders.where("o_totalprice > 200000")
    return t.customer.join(big, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey").distinct()


@query("select count(*) as n from players_raw where civ not in (select chosen_civ_or_race from matches_long_raw)")
def join_null_aware_anti(t: Tables):
    seen = t.matches_long_raw.select("chosen_civ_or_race").distinct()
    seen.createOrReplaceTempView("__civs")
    t.players_raw.createOrReplaceTempView("__players")
    return t.spark.sql("select count(*) as n from __players where civ not in (select chosen_civ_or_race from __civs)")


@query("""with a as (select user_id, event_type, count(*) as n_early from events where ts < timestamp '2024-01-11' group by 1, 2),
b as (select user_id, event_type, count(*) as n_late from events where ts >= timestamp '2024-01-20' group by 1, 2)
select user_id, event_type, coalesce(n_early, 0) as n_early, coalesce(n_late, 0) as n_late from a full join b using (user_id, event_type)""")
def join_full_outer(t: Tables):
    part = lambda c, n: t.events.where(c).groupBy("user_id", "event_type").agg(F.count("*").alias(n))
    j = part("ts < timestamp_ntz'2024-01-11'", "n_early").join(part("ts >= timestamp_ntz'2024-01-20'", "n_late"), ["user_id", "event_type"], "full")
    return j.select("user_id", "event_type", F.coalesce("n_early", F.lit(0)).alias("n_early"), F.coalesce("n_late", F.lit(0)).alias("n_late"))


@query("select n, count(*) as n_customers from (values (1), (2), (3), (7)) as c(n) join (select o_custkey, count(*) as k from orders group by 1) on k >= n group by n")
def join_constants_theta(t: Tables):
    c = t.spark.sql("select * from values (1), (2), (3), (7) as c(n)")
    k = t.orders.groupBy("o_custkey").agg(F.count("*").alias("k")).groupBy("k").agg(F.count("*").alias("m"))
    return k.crossJoin(F.broadcast(c)).where("k >= n").groupBy("n").agg(F.sum("m").alias("n_customers"))


@query("""select server, leaderboard, coalesce(n, 0) as n from (select distinct server from matches_raw where server is not null and leaderboard is not null) cross join (select distinct leaderboard from matches_raw where server is not null and leaderboard is not null)
left join (select server, leaderboard, count(*) as n from matches_raw group by 1, 2) using (server, leaderboard)""")
def join_dense_grid(t: Tables):
    return R.dense_grid(t.matches_raw, "server", "leaderboard")


@query("""with s as (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from events)
select event_type, count(*) filter (where value < q1 - 1.5 * (q3 - q1) or value > q3 + 1.5 * (q3 - q1)) as n_out, count(*) as n from events cross join s group by 1""")
def join_scalar_broadcast(t: Tables):
    s = t.events.agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    low, high = F.expr("q[0] - 1.5 * (q[1] - q[0])"), F.expr("q[1] + 1.5 * (q[1] - q[0])")
    return t.events.crossJoin(F.broadcast(s)).groupBy("event_type").agg(F.count(F.when((F.col("value") < low) | (F.col("value") > high), 1)).alias("n_out"), F.count("*").alias("n"))


@query("""with d as (select distinct match_id, player_id from matches_long_raw where leaderboard_raw = 3)
select a.match_id, a.player_id as a, b.player_id as b from d a join d b on a.match_id = b.match_id and a.player_id < b.player_id""")
def join_self_unordered_pairs(t: Tables):
    return R.unordered_pairs(t.matches_long_raw.where("leaderboard_raw = 3"), "match_id", "player_id")


@query("""select l.event_id, count(r.event_id) as n_within_hour from events l left join events r on l.user_id = r.user_id and r.ts between l.ts and l.ts + interval 1 hour where l.event_type = 'purchase' group by 1""")
def join_interval(t: Tables):
    left = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = t.events.select("user_id", F.col("event_id").alias("other"), F.col("ts").alias("other_ts"))
    return R.interval_join(left, right, "user_id", "ts", "other_ts", 3600, "left").groupBy("event_id").agg(F.count("other").alias("n_within_hour"))


@query("select count(*) as n_pairs from events a join events b on a.user_id = b.user_id and a.event_id < b.event_id and abs(epoch(a.ts) - epoch(b.ts)) <= 60")
def join_tolerance(t: Tables):
    a = t.events.select("user_id", "event_id", "ts")
    b = t.events.select("user_id", F.col("event_id").alias("other"), F.col("ts").alias("other_ts"))
    return R.interval_join(a, b, "user_id", "ts", "other_ts", 60, before=True).where("event_id < other").agg(F.count("*").alias("n_pairs"))


_ASOF = """with r as (select profile_id, date, max(rating) as rating from ratings_raw where rating is not null and leaderboard_id = 3 and date is not null group by 1, 2),
m as (select row_number() over () as id, o.* from (select distinct player_id, strptime(started_timestamp, '%Y-%m-%dT%H:%M:%SZ') as at from matches_long_raw where regexp_full_match(started_timestamp, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}Z')) o)
select m.player_id, strftime(m.at, '%Y-%m-%d %H:%M:%S') as at, {pick}(rating, date) as rating from m left join r on r.profile_id = m.player_id and r.date {op} m.at group by 1, 2"""


def _asof(t: Tables, direction: str):
    m = t.matches_long_raw.where(F.col("started_timestamp").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")).select("player_id", F.col("started_timestamp").try_cast("timestamp").cast("timestamp_ntz").alias("at")).distinct()
    r = t.ratings_raw.where("leaderboard_id = 3").select(F.col("profile_id").cast("int").alias("player_id"), "date", "rating")
    j = R.asof_join(m, r, "player_id", "at", "date", "rating", direction, "rating")
    return j.select("player_id", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "rating")


@query(_ASOF.format(pick="max_by", op="<="))
def join_asof_backward(t: Tables):
    return _asof(t, "backward")


@query(_ASOF.format(pick="min_by", op=">"))
def join_asof_forward(t: Tables):
    return _asof(t, "forward")


@query("""select o.o_orderkey, a.n_a, b.n_b from orders o join (select l_orderkey, count(*) as n_a from lineitem where l_linestatus = 'O' group by 1) a on a.l_orderkey = o.o_orderkey
join (select l_orderkey, count(*) as n_b from lineitem where l_linestatus = 'F' group by 1) b on b.l_orderkey = o.o_orderkey""")
def join_conditional_slots(t: Tables):
    # both slots in one conditional aggregation: one scan of the lines, one shuffle
    slot = lambda s: F.count(F.when(F.col("l_linestatus") == s, 1))
    s = t.lineitem.groupBy("l_orderkey").agg(slot("O").alias("n_a"), slot("F").alias("n_b")).where("n_a > 0 and n_b > 0")
    return t.orders.join(s, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "n_a", "n_b")


@query("""select m.filename as filename, count(*) as n_players from replays_meta_raw m join replay_players_raw p on regexp_extract(m.filename, '([0-9a-f]{32})', 1) = regexp_extract(p.filename, '([0-9a-f]{32})', 1) group by 1""")
def join_computed_key(t: Tables):
    key = F.regexp_extract("filename", "([0-9a-f]{32})", 1)
    p = t.replay_players_raw.groupBy(key.alias("id")).agg(F.count("*").alias("n_players"))
    return t.replays_meta_raw.withColumn("id", key).join(p, "id").groupBy("filename").agg(F.sum("n_players").alias("n_players"))


@query("""with e as (select user_id, count(*) as n_ref from events where ts < timestamp '2024-01-16' group by 1 having count(*) >= 30)
select user_id, n_ref, count(*) as n_after from events join e using (user_id) where ts >= timestamp '2024-01-16' group by 1, 2""")
def join_cohort(t: Tables):
    cut = F.expr("timestamp_ntz'2024-01-16'")
    by = t.events.groupBy("user_id").agg(F.count(F.when(F.col("ts") < cut, 1)).alias("n_ref"), F.count(F.when(F.col("ts") >= cut, 1)).alias("n_after"))
    return by.where("n_ref >= 30 and n_after > 0")


# aggregation
@query("""select event_type, count(*) as n, count(*) - count(props) as n_null, round(sum(value), 4) as total, round(avg(value), 6) as mean, min(value) as low, max(value) as high,
count(distinct user_id) as n_users, count(distinct (user_id, cast(ts as date))) as n_user_days, round(stddev_samp(value), 6) as sd, round(median(value), 6) as med,
round(quantile_cont(value, 0.9), 6) as p90, round(skewness(value), 6) as skew, round(kurtosis(value), 6) as kurt from events group by 1""")
def aggregate_summary(t: Tables):
    v = F.col("value")
    return t.events.groupBy("event_type").agg(
        F.count("*").alias("n"), (F.count("*") - F.count("props")).alias("n_null"), F.round(F.sum(v), 4).alias("total"), F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.countDistinct("user_id").alias("n_users"), F.countDistinct(F.struct("user_id", F.to_date("ts"))).alias("n_user_days"), F.round(F.stddev_samp(v), 6).alias("sd"), F.round(F.median(v), 6).alias("med"),
        F.round(F.percentile(v, 0.9), 6).alias("p90"), F.round(S.skewness_adjusted(v), 6).alias("skew"), F.round(S.kurtosis_adjusted(v), 6).alias("kurt"),
    )


@query("""select leaderboard_raw, count(*) filter (where outcome_raw = 1) as n_won, cast(sum(case when rating_pre_raw is null then 1 else 0 end) as bigint) as n_unrated, round(avg(rating_pre_raw) filter (where outcome_raw = 1), 6) as mean_won,
median(rating_pre_raw) filter (where outcome_raw = 0) as med_lost, count(distinct player_id) filter (where outcome_raw is null) as n_open from matches_long_raw group by 1""")
def aggregate_filtered(t: Tables):
    won, r = F.col("outcome_raw") == 1, F.col("rating_pre_raw")
    return t.matches_long_raw.groupBy("leaderboard_raw").agg(F.count(F.when(won, 1)).alias("n_won"), F.sum(F.when(r.isNull(), 1).otherwise(0)).alias("n_unrated"), F.round(F.avg(F.when(won, r)), 6).alias("mean_won"), F.median(F.when(F.col("outcome_raw") == 0, r)).alias("med_lost"), F.countDistinct(F.when(F.col("outcome_raw").isNull(), F.col("player_id"))).alias("n_open"))


@query("select count(distinct coalesce(civ, '?') || '|' || coalesce(opening, '?')) as n_pairs, count(distinct (civ, opening)) as n_tuples from players_raw")
def aggregate_composite_distinct(t: Tables):
    return t.players_raw.agg(F.countDistinct(F.concat_ws("|", F.coalesce("civ", F.lit("?")), F.coalesce("opening", F.lit("?")))).alias("n_pairs"), F.countDistinct(F.struct("civ", "opening")).alias("n_tuples"))


@query("select o_custkey, count(*) as n, cast(date_diff('day', min(o_orderdate), max(o_orderdate)) as bigint) as span from orders group by 1 having count(*) >= 5 and max(o_orderdate) - min(o_orderdate) >= interval 365 days")
def aggregate_having_span(t: Tables):
    g = t.orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return g.where((F.col("n") >= 5) & (F.col("b") - F.col("a") >= F.expr("interval '365' day"))).select("o_custkey", "n", F.datediff("b", "a").cast("bigint").alias("span"))


@query("""select profile_id, max_by(rating, (date, rating)) as latest, min_by(rating, (date, rating)) as first, count(*) as n from ratings_raw where rating is not null and date is not null and leaderboard_id = 3 group by 1""")
def aggregate_min_max_by(t: Tables):
    o = F.struct("date", "rating")
    r = t.ratings_raw.where("rating is not null and date is not null and leaderboard_id = 3")
    return r.groupBy("profile_id").agg(F.max_by("rating", o).alias("latest"), F.min_by("rating", o).alias("first"), F.count("*").alias("n"))


@query("""select n_regionkey, string_agg(n_name, '; ' order by n_name) as names, array_to_string(list(n_name order by n_name)[:3], ',') as first3 from nation group by 1""")
def aggregate_strings_and_lists(t: Tables):
    return t.nation.groupBy("n_regionkey").agg(F.expr("listagg(n_name, '; ') within group (order by n_name)").alias("names"), F.array_join(F.slice(F.array_sort(F.collect_list("n_name")), 1, 3), ",").alias("first3"))


@query("select n_rows, count(*) as n_groups from (select match_id, count(*) as n_rows from matches_long_raw group by 1) group by 1")
def aggregate_of_aggregate(t: Tables):
    return R.counts_histogram(t.matches_long_raw, ["match_id"])


@query("""select leaderboard, count(*) filter (where speed = 'slow') as slow, count(*) filter (where speed = 'normal') as normal, count(*) filter (where speed = 'fast') as fast, count(*) filter (where speed = 'blitz') as blitz from matches_raw group by 1""")
def aggregate_pivot(t: Tables):
    return t.matches_raw.groupBy("leaderboard").pivot("speed", ["slow", "normal", "fast", "blitz"]).count().fillna(0, ["slow", "normal", "fast", "blitz"])


@query("""select col as column_name, count(*) as n_rows, count(v) as n_values, count(distinct v) as n_distinct from (select unnest(['leaderboard', 'server', 'map', 'speed', 'privacy']) as col, unnest([leaderboard, server, map, speed, privacy]) as v from matches_raw) group by 1""")
def aggregate_unpivot(t: Tables):
    cols = ["leaderboard", "server", "map", "speed", "privacy"]
    u = t.matches_raw.select(*cols).unpivot([], cols, "column_name", "v")
    return u.groupBy("column_name").agg(F.count("*").alias("n_rows"), F.count("v").alias("n_values"), F.countDistinct("v").alias("n_distinct"))


@query("""select '0 all' as stage, count(*) as n from matches_long_raw union all select '1 ranked', count(*) from matches_long_raw where leaderboard_raw > 0
union all select '2 decided', count(*) from matches_long_raw where leaderboard_raw > 0 and outcome_raw is not null union all select '3 rated', count(*) from matches_long_raw where leaderboard_raw > 0 and outcome_raw is not null and rating_pre_raw is not null""")
def aggregate_stage_funnel(t: Tables):
    # one scan: the stages are conditional counts, turned into rows afterwards
    ranked = F.coalesce(F.col("leaderboard_raw") > 0, F.lit(False))
    decided = ranked & F.col("outcome_raw").isNotNull()
    stages = {"0 all": F.lit(True), "1 ranked": ranked, "2 decided": decided, "3 rated": decided & F.col("rating_pre_raw").isNotNull()}
    one = t.matches_long_raw.agg(*[F.count(F.when(c, 1)).alias(k) for k, c in stages.items()])
    return one.unpivot([], list(stages), "stage", "n")


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as q from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())")
def aggregate_grouping_sets(t: Tables):
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("""select o_orderpriority, count(*) as n, cast(row_number() over (order by sum(case when o_orderstatus = 'F' then 1 else 0 end) desc, o_orderpriority) as int) as place from orders group by 1""")
def aggregate_as_sort_key(t: Tables):
    """Groups in the order of an aggregate of a condition."""
    g = t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum(F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("f"))
    return g.select("o_orderpriority", "n", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("f"), "o_orderpriority")).alias("place"))


@query("select distinct n_name from nation n join region r on n.n_regionkey = r.r_regionkey where r.r_name = 'EUROPE'")
def join_across_databases(t: Tables):
    """Tables of two databases by qualified names."""
    a, b = (f"loom_{uuid.uuid4().hex[:12]}" for _ in range(2))
    for name, table, df in ((a, "nation", t.nation), (b, "region", t.region)):
        t.spark.sql(f"create database {name} location '{shared_dir(t.spark)}/{name}'")
        df.write.saveAsTable(f"{name}.{table}")
    return t.spark.sql(f"select distinct n_name from {a}.nation n join {b}.region r on n.n_regionkey = r.r_regionkey where r.r_name = 'EUROPE'")


@query("select o_custkey, any_value(c_nationkey) as nation, count(*) as n from orders join customer on o_custkey = c_custkey group by 1")
def aggregate_any_value(t: Tables):
    """Any of a group's values, where they are all the same."""
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("o_custkey").agg(F.any_value("c_nationkey").alias("nation"), F.count("*").alias("n"))


@query("select 'o_orderkey' as name, lower(any_value(typeof(o_orderkey))) as type, count(*) as n from orders union all select 'o_totalprice', lower(any_value(typeof(o_totalprice))), count(*) from orders")
def scalar_typeof(t: Tables):
    one = lambda c: t.orders.agg(F.any_value(F.typeof(c)).alias("type"), F.count("*").alias("n")).select(F.lit(c).alias("name"), "type", "n")
    return one("o_orderkey").unionByName(one("o_totalprice"))


@query("select s.i as o_custkey, count(o_orderkey) as n from (select unnest(generate_series((select min(o_custkey) from orders), (select max(o_custkey) from orders), 3)) as i) s left join orders o on o.o_custkey = s.i group by 1")
def series_integers(t: Tables):
    """Every third key of the range, whether there are orders or not."""
    ends = t.orders.agg(F.min("o_custkey").alias("a"), F.max("o_custkey").alias("b"))
    series = ends.select(F.explode(F.expr("sequence(a, b, 3L)")).alias("o_custkey"))
    return series.join(t.orders, "o_custkey", "left").groupBy("o_custkey").agg(F.count("o_orderkey").alias("n"))


@query("""with e as (select quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from lineitem) select cast(len(list_filter(e, lambda x: x < l_extendedprice)) as int) as decile, count(*) as n from lineitem cross join e group by 1""")
def window_quantile_deciles(t: Tables):
    """Deciles by quantile edges, right-closed, ties together."""
    from matchloom.operators.stats import frozen_bin, quantile_edges

    x = F.col("l_extendedprice")
    return t.lineitem.groupBy(frozen_bin(x, quantile_edges(t.lineitem, x)).alias("decile")).agg(F.count("*").alias("n"))


@query()
def aggregate_approximate(t: Tables):
    """Approximate quantile and distinct count; engines differ, so there is no SQL."""
    return t.lineitem.groupBy("l_returnflag").agg(F.percentile_approx("l_extendedprice", 0.5).alias("median"), F.approx_count_distinct("l_partkey").alias("n_parts"))


@query()
def aggregate_table_fingerprint(t: Tables):
    return R.table_fingerprint(t.orders)


# windows
@query("""select match_id, player_id, started_timestamp, side, outcome_raw, rating_pre_raw from (select *, row_number() over (partition by match_id, player_id order by started_timestamp nulls last, side nulls last, outcome_raw nulls last, rating_pre_raw nulls last) as i from matches_long_raw) where i = 1""")
def window_keep_first(t: Tables):
    cols = ["started_timestamp", "side", "outcome_raw", "rating_pre_raw"]
    order = [x for c in cols for x in (F.col(c).isNull(), F.col(c))]
    return R.keep_first(t.matches_long_raw.select("match_id", "player_id", *cols), ["match_id", "player_id"], order)


@query("""select server, map, n from (select server, map, count(*) as n, row_number() over (partition by server order by count(*) desc, map) as i from matches_raw where map is not null group by 1, 2) where i = 1""")
def window_mode_per_group(t: Tables):
    return R.mode_per_group(t.matches_raw, ["server"], "map")


@query("select c_nationkey, c_custkey, c_acctbal from (select *, row_number() over (partition by c_nationkey order by c_acctbal desc, c_custkey) as i from customer) where i <= 3")
def window_top_per_group(t: Tables):
    return R.top_per_group(t.customer, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")], 3).select("c_nationkey", "c_custkey", "c_acctbal")


@query("select evtTypeName, count(*) as n, round(count(*) / sum(count(*)) over (), 8) as share from tracker_events_raw group by 1")
def window_share_of_total(t: Tables):
    return R.shares(t.tracker_events_raw, ["evtTypeName"]).withColumn("share", F.round("share", 8))


@query("select leaderboard, server, count(*) as n, round(count(*) / sum(count(*)) over (partition by leaderboard), 8) as share from matches_raw group by 1, 2")
def window_share_within_group(t: Tables):
    return R.shares(t.matches_raw, ["leaderboard", "server"], ["leaderboard"]).withColumn("share", F.round("share", 8))


_GAP = """case when d is null then 'first' when d < 1 then '<1d' when d < 7 then '1-7d' when d < 30 then '7-30d' else '>30d' end"""


@query(f"""with g as (select *, lag(o_orderpriority) over w as p, epoch(o_orderdate - lag(o_orderdate) over w) / 86400.0 as d from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey))
select {_GAP} as gap, count(*) as n, count(*) filter (where p = o_orderpriority) as n_same from g group by 1""")
def window_lag_gap_agreement(t: Tables):
    at = F.unix_micros(F.col("o_orderdate").cast("timestamp"))
    g = R.lag_in_cells(t.orders, ["o_custkey"], at, [F.col("o_orderkey")], {"p": F.col("o_orderpriority"), "before": F.col("o_orderdate")}, 365 * 86_400_000_000)
    g = g.withColumn("d", S.days_between(F.col("o_orderdate"), F.col("before")))
    return g.groupBy(S.gap_bucket(F.col("d")).alias("gap")).agg(F.count("*").alias("n"), F.count(F.when(F.col("p") == F.col("o_orderpriority"), 1)).alias("n_same"))


@query("""select event_id, count(*) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as n_prior, round(sum(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 4) as sum_prior from events""")
def window_strict_prior_rows(t: Tables):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return t.events.select("event_id", F.count("*").over(w).alias("n_prior"), F.round(F.sum("value").over(w), 4).alias("sum_prior"))


@query("""select event_id, rank() over w as r, dense_rank() over w as dr, ntile(4) over w as q, round(percent_rank() over w, 8) as pr, round(cume_dist() over w, 8) as cd, lead(value) over w as nxt, first_value(value) over w as fst from events window w as (partition by event_type order by value, event_id)""")
def window_ranking(t: Tables):
    w = Window.partitionBy("event_type").orderBy("value", "event_id")
    return t.events.select("event_id", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("dr"), F.ntile(4).over(w).alias("q"), F.round(F.percent_rank().over(w), 8).alias("pr"), F.round(F.cume_dist().over(w), 8).alias("cd"), F.lead("value").over(w).alias("nxt"), F.first("value").over(w).alias("fst"))


# sort, limit, sampling
@query("select p_partkey, p_retailprice from part order by p_retailprice desc nulls last, p_partkey limit 20")
def sort_top_n(t: Tables):
    return t.part.orderBy(F.desc_nulls_last("p_retailprice"), "p_partkey").limit(20).select("p_partkey", "p_retailprice")


@query()
def sample_bernoulli(t: Tables):
    return t.lineitem.sample(0.1, seed=42)


@query()
def sample_reservoir(t: Tables):
    return R.hash_sample(t.orders, ["o_orderkey"], 500)


@query()
def sample_entities(t: Tables):
    return R.entity_sample(t.events, "user_id", 0.2)


@query()
def sample_stratified_groups(t: Tables):
    return R.stratified_groups(t.matches_long_raw, "player_id", 100)


# sets and structure
@query("select distinct nation, kind from (select c_nationkey as nation, 'customer' as kind from customer union all select s_nationkey, 'supplier' from supplier)")
def set_union_distinct(t: Tables):
    a = t.customer.select(F.col("c_nationkey").alias("nation"), F.lit("customer").alias("kind"))
    return a.union(t.supplier.select("s_nationkey", F.lit("supplier"))).distinct()


@query("select filename, 'a' as side from (select distinct replace(filename, 'matches/', '') as filename from matches_raw except select distinct replace(filename, 'players/', '') from players_raw) union all select filename, 'b' from (select distinct replace(filename, 'players/', '') as filename from players_raw except select distinct replace(filename, 'matches/', '') from matches_raw)")
def set_one_sided_files(t: Tables):
    name = lambda df, p: df.select(F.regexp_replace("filename", f"^{p}/", "").alias("filename"))
    return R.one_sided(name(t.matches_raw, "matches"), name(t.players_raw, "players"), ["filename"])


@query("select player_id from (select player_id from matches_long_raw where leaderboard_raw = 3 intersect select player_id from matches_long_raw where leaderboard_raw = 4 except select player_id from matches_long_raw where leaderboard_raw = 0)")
def set_intersect_except(t: Tables):
    p = lambda n: t.matches_long_raw.where(f"leaderboard_raw = {n}").select("player_id")
    return p(3).intersect(p(4)).subtract(p(0))


@query("select strftime(day, '%Y-%m-%d') as missing from (select unnest(generate_series(min(cast(o_orderdate as date)), max(cast(o_orderdate as date)), interval 1 day))::date as day from orders) where day not in (select cast(o_orderdate as date) from orders)")
def series_calendar_gaps(t: Tables):
    return R.calendar_gaps(t.orders, "o_orderdate").select(F.col("missing").cast("string").alias("missing"))


# scalar functions
@query("""select filename, split_part(filename, '/', 2) as feed, split_part(filename, '/', -1) as last, regexp_extract(filename, '(\\d{4}-\\d{2}-\\d{2})_', 1) as day, replace(filename, 'matches', 'm') as short, left(filename, 7) as l7, length(filename) as n, lower(substr(filename, 3, 5)) as mid from (select distinct filename from matches_raw)""")
def scalar_strings(t: Tables):
    f = F.col("filename")
    return t.matches_raw.select("filename").distinct().select(f, F.split_part(f, F.lit("/"), F.lit(2)).alias("feed"), F.split_part(f, F.lit("/"), F.lit(-1)).alias("last"), F.regexp_extract(f, r"(\d{4}-\d{2}-\d{2})_", 1).alias("day"), F.replace(f, F.lit("matches"), F.lit("m")).alias("short"), F.left(f, F.lit(7)).alias("l7"), F.length(f).alias("n"), F.lower(F.substring(f, 3, 5)).alias("mid"))


@query("""select o_orderkey, year(o_orderdate) || '-Q' || quarter(o_orderdate) as q, strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') as month, strftime(date_trunc('week', o_orderdate), '%Y-%m-%d') as week, cast(epoch(o_orderdate) as bigint) as secs, cast(date_diff('month', timestamp '1992-01-31', o_orderdate) as bigint) as months, cast(date_diff('day', timestamp '1992-01-31', o_orderdate) as bigint) as days, strftime(o_orderdate + interval 36 hours, '%Y-%m-%d') as later from orders""")
def scalar_times(t: Tables):
    d, start = F.col("o_orderdate"), F.expr("timestamp_ntz'1992-01-31'")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    return t.orders.select("o_orderkey", S.quarter_label(d).alias("q"), day(F.date_trunc("month", d)).alias("month"), day(F.date_trunc("week", d)).alias("week"), S.epoch_seconds(d).cast("bigint").alias("secs"), S.month_boundaries(start, d).cast("bigint").alias("months"), F.datediff(d, start).cast("bigint").alias("days"), day(d + F.expr("interval '36' hour")).alias("later"))


@query("""select floor(value / 100) * 100 as bin, case when value > 0 then cast(floor(log10(value)) as int) end as magnitude, count(*) as n from events group by 1, 2""")
def scalar_binning(t: Tables):
    return t.events.groupBy(S.fixed_bin(F.col("value"), 100).cast("double").alias("bin"), S.log10_bin(F.col("value")).alias("magnitude")).agg(F.count("*").alias("n"))


@query("""select o_orderkey, cast(o_totalprice / 22.4 as bigint) as ticks, nullif(o_orderstatus, 'O') as status, greatest(least(o_totalprice, 200000), 10000) as clamped, least(o_custkey, o_orderkey) || '|' || greatest(o_custkey, o_orderkey) as pair, try_cast(o_orderpriority as int) as bad, abs(round(o_totalprice, -3)) as r3 from orders""")
def scalar_numbers(t: Tables):
    p = F.col("o_totalprice")
    return t.orders.select("o_orderkey", S.round_half_even_long(p / 22.4).alias("ticks"), F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("status"), S.clamp(p, 10000, 200000).alias("clamped"), S.pair_key(F.col("o_custkey"), F.col("o_orderkey")).alias("pair"), F.col("o_orderpriority").try_cast("int").alias("bad"), F.abs(F.round(p, -3)).alias("r3"))


@query("""select event_id, cast(json_extract_string(props, '$.k') as bigint) as k, array_to_string(json_keys(props), ',') as keys from events""")
def scalar_json(t: Tables):
    return t.events.select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.array_join(F.json_object_keys("props"), ",").alias("keys"))


@query("""select vec_id, len(embedding) as n, round(embedding[1]::double + embedding[2]::double + embedding[3]::double + embedding[4]::double, 4) + 0.0 as s4, i as pos from (select *, unnest(generate_series(1, 2)) as i from embeddings)""")
def scalar_arrays(t: Tables):
    e = t.embeddings.select("vec_id", F.size("embedding").alias("n"), (F.round(F.aggregate(F.slice("embedding", 1, 4), F.lit(0.0), lambda a, x: a + x), 4) + F.lit(0.0)).alias("s4"), F.posexplode(F.slice("embedding", 1, 2)).alias("p", "x"))
    return e.select("vec_id", "n", "s4", (F.col("p") + 1).cast("bigint").alias("pos"))


@query("select pattern, count(*) as n_files from (select regexp_replace(regexp_replace(regexp_replace(split_part(filename, '/', -1), '\\d{4}-\\d{2}-\\d{2}', '{date}', 'g'), '[0-9a-f]{16,}', '{hash}', 'g'), '\\d+\\.', '{N}.', 'g') as pattern from (select distinct filename from matches_raw union all select distinct filename from ratings_raw)) group by 1")
def scalar_file_patterns(t: Tables):
    names = t.matches_raw.select("filename").distinct().union(t.ratings_raw.select("filename").distinct())
    return names.groupBy(S.file_pattern(F.split_part("filename", F.lit("/"), F.lit(-1))).alias("pattern")).agg(F.count("*").alias("n_files"))
