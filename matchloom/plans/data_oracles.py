"""SQL that a plain SQL engine runs over the same tables, for the queries that it can express."""

from __future__ import annotations

_VERSIONS = """
select profile_id, leaderboard_id, rating, date as v,
  case when fd > date::date then fd::timestamp else date end as k
from (select *, try_cast(regexp_extract(filename, '(\\d{4}-\\d{2}-\\d{2})[^/]*$', 1) as date) as fd from ratings_raw where rating is not null and profile_id is not null and leaderboard_id is not null and date is not null)
"""


def _rated(known: str) -> str:
    return f"""
with r as ({_VERSIONS}),
m as (select distinct match_id, player_id, rating_pre_raw, leaderboard_raw, strptime(started_timestamp, '%Y-%m-%dT%H:%M:%SZ') as t
  from matches_long_raw where regexp_full_match(started_timestamp, '\\d{{4}}-\\d{{2}}-\\d{{2}}T\\d{{2}}:\\d{{2}}:\\d{{2}}Z') and rating_pre_raw is not null),
j as (select m.*, r.rating, row_number() over (partition by m.match_id, m.player_id, m.rating_pre_raw, m.leaderboard_raw, m.t order by r.v desc, r.k desc, r.rating desc) as i
  from m left join r on r.profile_id = m.player_id and r.leaderboard_id = m.leaderboard_raw and r.v < m.t and r.k <= {known})
select * from j where i = 1
"""


_RATED = _rated("m.t")

_MATCH_COLUMNS = ["matchId", "started", "leaderboard", "name", "server", "internalLeaderboardId", "map", "speed", "speedFactor", "mod", "privacy", "population"]
_PLAYER_COLUMNS = ["winner", "game_id", "team", "feudal_age_uptime", "castle_age_uptime", "imperial_age_uptime", "old_rating", "new_rating", "match_rating_diff", "profile_id", "civ", "opening"]


def _profile() -> str:
    cells = [f"select '{v}' as view_name, regexp_extract(filename, '^([^/]*/[^/]*/\\d{{4}}-\\d{{2}})', 1) as load_prefix, '{c}' as column_name, \"{c}\"::varchar as value from {v}" for v, cols in (("matches_raw", _MATCH_COLUMNS), ("players_raw", _PLAYER_COLUMNS)) for c in cols]
    return f"""
with c as ({' union all '.join(cells)}),
s as (select distinct view_name, load_prefix, column_name, sentinel_value as value from missingness_ledger where sentinel_value is not null),
p as (select c.view_name, c.load_prefix, c.column_name, count(*) as n_total, count(*) - count(c.value) as n_null, count(distinct c.value) as n_distinct, count(s.value) as n_sentinel
  from c left join s on s.view_name = c.view_name and s.load_prefix = c.load_prefix and s.column_name = c.column_name and s.value = c.value group by 1, 2, 3)
"""


def _instant(text: str, zone: str) -> str:
    """SQL for the microseconds since 1970 that a text in one of the tables' notations denotes."""
    t = text
    full = lambda p: f"regexp_full_match({t}, '{p}')"
    sign = f"(case when regexp_extract({t}, '([+-])\\d{{2}}:?\\d{{2}}(\\[.*)?$', 1) = '-' then -1 else 1 end)"
    shift = f"({sign} * (regexp_extract({t}, '[+-](\\d{{2}}):?\\d{{2}}(\\[.*)?$', 1)::bigint * 3600 + regexp_extract({t}, '[+-]\\d{{2}}:?(\\d{{2}})(\\[.*)?$', 1)::bigint * 60) * 1000000)"
    fraction = f"coalesce((rpad(nullif(regexp_extract({t}, ':\\d{{2}}\\.(\\d+)', 1), ''), 6, '0'))::bigint, 0)"
    at = lambda x: f"epoch_us({x})"
    iso = at(f"try_strptime(replace(substr({t}, 1, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S')")
    mail = at(f"try_strptime(substr({t}, 6, 20), '%d %b %Y %H:%M:%S')")
    # a wall time that occurs twice: an hour before the instant found, the clock shows the same
    twice = lambda x: f"timezone({zone}, timezone({zone}, {x}) - interval 1 hour) = {x}"
    wall = lambda x: f"(case when {zone} is not null then epoch_us(timezone({zone}, {x})) - case when {twice(x)} then 3600000000 else 0 end end)"
    date = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?"
    return f"""case
 when {full(date + 'Z')} then {iso} + {fraction}
 when {full(date + r'[+-]\d{2}:?\d{2}(\[.*\])?')} then {iso} + {fraction} - {shift}
 when {full(date)} then {wall(f"try_strptime(replace(substr({t}, 1, 19), 'T', ' '), '%Y-%m-%d %H:%M:%S')")} + {fraction}
 when {full(r'\d{8}T\d{6}Z')} then {at(f"try_strptime({t}, '%Y%m%dT%H%M%SZ')")}
 when {full(r'\d{10}')} then try_cast({t} as bigint) * 1000000
 when {full(r'\d{13}')} then try_cast({t} as bigint) * 1000
 when {full(r'[A-Z][a-z]{2}, \d{2} [A-Z][a-z]{2} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}')} then {mail} - {shift}
 when {full(r'\d{2}/\d{2}/\d{4} \d{2}:\d{2}:\d{2}')} then {wall(f"try_strptime({t}, '%m/%d/%Y %H:%M:%S')")}
 when {full(r'\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2}')} then {wall(f"try_strptime({t}, '%d.%m.%Y %H:%M:%S')")}
 when {full(r'\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}')} then {wall(f"try_strptime({t}, '%d.%m.%Y %H:%M')")}
 when {full(r'[A-Z][a-z]{2} \d{2}, \d{4} \d{1,2}:\d{2}:\d{2} [AP]M')} then {wall(f"try_strptime({t}, '%b %d, %Y %I:%M:%S %p')")}
end"""


_STARTS = f"""
with r as (select matchId as match_id, 'matches_raw' as source, started as text, {_instant('started', 'zone_name')} as us from matches_raw left join (select server, min(zone_name) as zone_name from server_zones group by 1) using (server)
union all select match_id, 'matches_long_raw', started_timestamp, {_instant('started_timestamp', "'UTC'")} from matches_long_raw)
"""


_FIELDS = r"""
with r as (select distinct filename, line_no, record from raw_records where json_valid(record) and json_type(record) = 'OBJECT'),
f as (select filename, regexp_extract(filename, '^(.*)/[^/]*$', 1) as dir, line_no, field, json_extract(record, '$."' || field || '"') as v from (select filename, line_no, record, unnest(json_keys(record)) as field from r)),
g as (select *, case json_type(v) when 'NULL' then null when 'UBIGINT' then 'integer' when 'BIGINT' then 'integer' when 'DOUBLE' then 'decimal' when 'VARCHAR' then 'string' when 'BOOLEAN' then 'boolean' when 'ARRAY' then 'array' else 'object' end as t from f)"""

_CHANGES = _FIELDS + r""",
files as (select dir, filename, min(line_no) as lo, max(line_no) as hi, lag(filename) over w as prev, lead(filename) over w as nxt from g group by dir, filename window w as (partition by dir order by filename)),
by_field as (select g.dir, g.filename, prev, nxt, field, string_agg(distinct t, '|' order by t) as t,
  coalesce(max(v::varchar) filter (where line_no = lo), '') || chr(1) || coalesce(max(v::varchar) filter (where line_no = lo + 1), '') as head,
  coalesce(max(v::varchar) filter (where line_no = hi - 1), '') || chr(1) || coalesce(max(v::varchar) filter (where line_no = hi), '') as tail
  from g join files using (filename) group by 1, 2, 3, 4, 5),
b as (select coalesce(o.file, n.file) as filename, o.field as f0, n.field as f1, o.t as t0, n.t as t1, o.tail as v0, n.head as v1 from (select nxt as file, * from by_field where nxt is not null) o full join (select filename as file, * from by_field where prev is not null) n on o.file = n.file and o.field = n.field),
fits as (select a.filename, a.f0 as old, c.f1 as new, dense_rank() over (partition by a.filename, a.v0 order by a.f0) as i, dense_rank() over (partition by a.filename, a.v0 order by c.f1) as j from b a join b c on a.filename = c.filename and a.f1 is null and c.f0 is null and a.v0 = c.v1 and a.v0 <> chr(1)),
renamed as (select filename, old, new from fits where i = j)
select filename, 'renamed' as change, old as field, new as new_field from renamed
union all select filename, 'removed', f0, '' from b where f1 is null and not exists (select 1 from renamed r where r.filename = b.filename and r.old = b.f0)
union all select filename, 'added', f1, '' from b where f0 is null and not exists (select 1 from renamed r where r.filename = b.filename and r.new = b.f1)
union all select filename, 'retyped', f0, '' from b where f0 = f1 and t0 <> t1
"""

_EVENTS = r"""
with recursive e as (select filename, loop, evtTypeName, case when json_valid(event_data ->> '$.payload') then (event_data ->> '$.payload')::json else event_data::json end as j from tracker_events_raw where json_valid(event_data)),
top as (select filename, loop, evtTypeName, try_cast(coalesce(j ->> '$.controlPlayerId', j ->> '$.owner.playerID') as int) as player, 'unit' as entity, unnest([j -> '$.unit', j -> '$.killer.unit']) as node from e
  union all select filename, loop, evtTypeName, try_cast(coalesce(j ->> '$.controlPlayerId', j ->> '$.owner.playerID') as int), 'units', unnest(case when json_type(j -> '$.units') = 'ARRAY' then (j -> '$.units')::json[] else [j -> '$.units'] end) from e),
held as (select filename, loop, evtTypeName, player, entity, 1 as depth, null::varchar as parent_tag, node from top where node is not null and json_type(node) <> 'NULL'
  union all select filename, loop, evtTypeName, player, 'cargo', depth + 1, node ->> '$.tag', unnest(case when json_type(node -> '$.cargo') = 'ARRAY' then (node -> '$.cargo')::json[] else [node -> '$.cargo'] end) from held where json_type(node) = 'OBJECT' and json_type(node -> '$.cargo') <> 'NULL'),
unit as (select *, case when json_type(node) = 'OBJECT' then node ->> '$.tag' else node ->> '$' end as tag from held),
m as (select filename, ToonPlayerDescMap::json as j from replays_meta_raw where json_valid(ToonPlayerDescMap)),
listed as (select filename, unnest(case when json_type(j) = 'ARRAY' then j::json[] else (j -> '$.players')::json[] end) as x from m where json_type(j) = 'ARRAY' or json_type(j -> '$.players') = 'ARRAY'),
players as (select filename, x ->> '$.toon' as toon_id, x from listed
  union all select m.filename, e.key, e.value from m, lateral (select * from json_each(m.j)) as e where json_type(m.j) = 'OBJECT' and (m.j -> '$.players') is null)
"""


def _player(field: str) -> str:
    return f"coalesce(x ->> '$.{field}', x ->> '$.profile.{field}')"


def oracles() -> dict[str, str]:
    return {
        "p4_found": _CHANGES,
        "p4_versions": f"""{_FIELDS},
by_field as (select dir, filename, field, coalesce(string_agg(distinct t, '|' order by t), '?') as t from g group by 1, 2, 3),
by_file as (select dir, filename, sha256(string_agg(field || ':' || t, ',' order by field, t)) as version, count(*) as n_fields from by_field group by 1, 2),
turn as (select *, case when lag(version) over (partition by dir order by filename) = version then 0 else 1 end as turned from by_file),
numbered as (select *, sum(turned) over (partition by dir order by filename) as version_no from turn)
select dir, version_no, version, n_fields, count(*) as n_files, min(filename) as first_file, max(filename) as last_file from numbered group by 1, 2, 3, 4""",
        "p6_found": f"""{_EVENTS}
select distinct h.filename, p.toon_id, try_cast(h.parent_tag as bigint) as parent_tag, try_cast(h.tag as bigint) as child_tag
from unit h join players p on p.filename = h.filename and try_cast({_player("playerID")} as int) = h.player where try_cast(h.parent_tag as bigint) is not null and p.toon_id is not null and try_cast(h.tag as bigint) is not null""",
        "p6_units": f"""{_EVENTS}
select filename, loop, evtTypeName, entity, depth, tag, parent_tag, node ->> '$.type' as "type", try_cast(node ->> '$.pos.x' as int) as x, try_cast(node ->> '$.pos.y' as int) as y from unit""",
        "p6_players": f"""{_EVENTS}
select filename, toon_id, {", ".join(f"{_player(c)} as {c}" for c in ("nickname", "race", "result", "region", "highestLeague", "clanTag"))}, {", ".join(f'try_cast({_player(c)} as int) as "{c}"' for c in ("playerID", "APM", "MMR"))} from players""",
        "p6_unreadable": "select filename, loop, evtTypeName from tracker_events_raw where event_data is not null and not json_valid(event_data)",
        "p2_found": f"select distinct match_id, player_id from ({_RATED}) where rating is not null and rating <> rating_pre_raw",
        "p2_rated": f"select distinct match_id, player_id, rating_pre_raw, rating as rating_known from ({_RATED})",
        "p2_corrected": f"select distinct match_id, player_id, rating_pre_raw, rating as rating_corrected from ({_rated('m.t + interval 30 days')})",
        "p5_instants": f"{_STARTS} select match_id, source, text, us as instant_us from r",
        "p5_found": f"""{_STARTS}, m as (select match_id, min(us) filter (where source = 'matches_raw') as a0, max(us) filter (where source = 'matches_raw') as a1, min(us) filter (where source <> 'matches_raw') as b0, max(us) filter (where source <> 'matches_raw') as b1 from r where match_id is not null group by 1)
select match_id from m where a0 is not null and b0 is not null and greatest(a1 - b0, b1 - a0) >= 60000000""",
        "p3_profile": f"""{_profile()} select view_name, load_prefix, column_name, n_total, n_null, n_distinct, n_sentinel, round(100.0 * n_null / n_total, 6) as pct_null from p""",
        "p3_ranges": f"""{_profile()}, v as (select view_name, load_prefix, column_name, value, count(*) as n from c group by 1, 2, 3, 4)
select view_name, load_prefix, column_name, min(value) as min_text, max(value) as max_text, round(min(try_cast(value as double)), 6) as min_number, round(max(try_cast(value as double)), 6) as max_number, max(length(value)) as max_length, max(case when value is not null then n end) as n_top from v group by 1, 2, 3""",
        "p3_found": f"""{_profile()}
select distinct l.view_name, l.load_prefix, l.column_name from missingness_ledger l left join p on p.view_name = l.view_name and p.load_prefix = l.load_prefix and p.column_name = l.column_name
where abs(coalesce(100.0 * p.n_null / p.n_total, 0) - l.pct_null) > 0.01 + 1e-9 or coalesce(p.n_distinct, 0) is distinct from l.n_distinct or coalesce(p.n_sentinel, 0) is distinct from l.n_sentinel or l.pct_null is null""",
    }
