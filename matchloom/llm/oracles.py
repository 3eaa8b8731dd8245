"""SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

#: The strengths at which each player's wins are what its opponents' strengths lead one to
#: expect, by plain iteration; half a win and half a loss against a player of strength 1.
_STRENGTHS = """
with recursive g as (select match_id, max(player_id) filter (where outcome_raw = 1) as winner, max(player_id) filter (where outcome_raw = 0) as loser
  from (select distinct * from matches_long_raw where leaderboard_raw = 3 and match_id is not null) group by 1
  having count(*) = 2 and count(*) filter (where outcome_raw = 1) = 1 and count(*) filter (where outcome_raw = 0) = 1),
s as (select winner as p, loser as o, 1.0 as won from g where winner <> loser union all select loser, winner, 0.0 from g where winner <> loser),
e as (select p, o, sum(won)::double as won, count(*)::double as n from s group by 1, 2),
t as (select p, sum(won) + 0.5 as won, sum(n) as n from e group by 1),
r as (select 0 as i, p, 1.0::double as x from t
  union all select a.i + 1, e.p, any_value(t.won) / (sum(e.n / (a.x + b.x)) + 1 / (any_value(a.x) + 1)) from e join r a on a.p = e.p join r b on b.p = e.o join t on t.p = e.p where a.i < 600 group by a.i, e.p)
"""


def oracles() -> dict[str, str]:
    return {
        "p1_found": _STRENGTHS + "select p as player_id from r join t using (p) where i = 600 and n >= 12 order by x desc, p limit 6",
        "p7_near_names": """with n as (select distinct translate(lower(nickname), ' áàâäéèêëíìîïóòôöúùûüýšž', '_aaaaeeeeiiiioooouuuuysz') as name from replay_players_raw where nickname <> '')
select a.name, b.name as other from n a join n b on a.name < b.name and abs(length(a.name) - length(b.name)) <= 1 where damerau_levenshtein(a.name, b.name) = 1 and greatest(length(a.name), length(b.name)) >= 5""",
    }
