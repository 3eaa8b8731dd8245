"""Leak-free history features: everything is from strictly earlier than the row's time.

Rows at the same time are not history of each other. Frames are therefore ranges over
microseconds that end one before the row's own, never row counts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.functions.scalar import pair_key
from matchloom.session import materialise


def micros(at: str) -> Column:
    return F.unix_micros(F.col(at).cast("timestamp"))


def _prior(df: DataFrame, keys: list[Column], at: str, hit: Column, tag: str, cell_days: float) -> DataFrame:
    """df with __n_<tag>, __w_<tag>, __m_<tag>, __t_<tag>: of the rows of the same keys
    strictly earlier, how many, how many hits, how many with a known outcome, and the
    latest time.

    Windows run within (keys, cell of time), so that a hot key is many tasks' work; what
    earlier cells hold comes from an aggregate with one row per cell. Window and join
    share one partitioning."""
    names = [f"__k{i}" for i in range(len(keys))]
    d = df.withColumns({n: F.coalesce(k.cast("string"), F.lit("\x00")) for n, k in zip(names, keys)} | {"__t": micros(at), "__h": hit.cast("int")})
    d = d.withColumn("__c", F.floor(F.col("__t") / int(cell_days * 86_400_000_000)))
    cells = d.where("__t is not null").groupBy(*names, "__c").agg(F.count("*").alias("n"), F.sum("__h").alias("w"), F.count("__h").alias("m"), F.max("__t").alias("l"))
    before = Window.partitionBy(*names).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1)
    carry = cells.select(*names, "__c", *[F.sum(x).over(before).alias(f"__{x}") for x in "nwm"], F.max("l").over(before).alias("__l"))
    w = Window.partitionBy(*names, "__c").orderBy("__t").rangeBetween(Window.unboundedPreceding, -1)
    d = d.withColumns({"__in": F.count("*").over(w), "__iw": F.sum("__h").over(w), "__im": F.count("__h").over(w), "__il": F.max("__t").over(w)})
    d = d.join(carry, [*names, "__c"], "left")
    plus = lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    out = {f"__n_{tag}": plus("__in", "__n"), f"__w_{tag}": plus("__iw", "__w"), f"__m_{tag}": plus("__im", "__m"), f"__t_{tag}": F.greatest("__il", "__l")}
    return d.withColumns(out).drop(*names, "__t", "__h", "__c", "__in", "__iw", "__im", "__il", "__n", "__w", "__m", "__l")


def _rate(tag: str) -> Column:
    return F.col(f"__w_{tag}") / F.nullif(F.col(f"__m_{tag}"), F.lit(0))


def history_features(df: DataFrame, entity: str, at: str, won: str, by: list[str] = (), cell_days: float = 28) -> DataFrame:
    """df with n_prior, prior_win_rate, days_since_prior, and for each column c of `by`
    n_prior_<c>, prior_win_rate_<c> (history with the same value of c, null being a
    value). A row without time or entity has null features, one without history count 0
    and null rates. Outcomes that are null count as rows, not in rates."""
    known = lambda c: F.when(F.col(at).isNotNull() & F.col(entity).isNotNull(), c)
    out = _prior(df, [F.col(entity)], at, F.col(won), "e", cell_days)
    new = {"n_prior": known(F.col("__n_e")), "prior_win_rate": known(_rate("e")), "days_since_prior": known((micros(at) - F.col("__t_e")) / 86_400e6)}
    for i, c in enumerate(by):
        out = _prior(out, [F.col(entity), F.col(c)], at, F.col(won), f"b{i}", cell_days)
        new |= {f"n_prior_{c}": known(F.col(f"__n_b{i}")), f"prior_win_rate_{c}": known(_rate(f"b{i}"))}
    return out.withColumns(new).drop(*[f"__{x}_{t}" for x in "nwmt" for t in ("e", *[f"b{i}" for i in range(len(by))])])


def head_to_head(df: DataFrame, side: str, opponent: str, at: str, won: str, cell_days: float = 28) -> DataFrame:
    """df with n_meetings and meeting_win_rate: earlier meetings of the same two, from
    the row's side. In a symmetric view a row's own side stands for the meeting, so a
    meeting counts once; null sides have null features."""
    low = F.col(side) < F.col(opponent)
    out = _prior(df, [pair_key(F.col(side), F.col(opponent)), low], at, F.col(won), "p", cell_days)
    known = lambda c: F.when(F.col(at).isNotNull() & low.isNotNull(), c)
    return out.withColumns({"n_meetings": known(F.col("__n_p")), "meeting_win_rate": known(_rate("p"))}).drop(*[f"__{x}_p" for x in "nwmt"])


def cold_start(df: DataFrame, n_prior: str, least: int) -> DataFrame:
    """df with is_cold: fewer than `least` earlier rows. There is no default for least."""
    return df.withColumn("is_cold", F.col(n_prior) < least)


def smoothed_rate(train: DataFrame, target: DataFrame, key: str, won: str, strength: float) -> DataFrame:
    """target with rate: the key's rate in the training rows drawn towards their overall
    rate by `strength` pseudo-rows; unseen keys have the overall rate. Fitted on `train`
    only."""
    hit = F.col(won).cast("int")
    base = train.agg(F.avg(hit).alias("__base"))
    by = train.groupBy(key).agg(F.sum(hit).alias("__w"), F.count(hit).alias("__n"))
    j = target.join(by, key, "left").crossJoin(F.broadcast(base))
    rate = (F.coalesce("__w", F.lit(0)) + strength * F.col("__base")) / (F.coalesce("__n", F.lit(0)) + strength)
    return j.withColumn("rate", rate).drop("__w", "__n", "__base")


def cutoff_snapshot(events: DataFrame, keys: list[str], loop: str, cutoff: Column, value: Column, kind: str, kinds: list[str]) -> DataFrame:
    """keys, n_events, last_value, max_value, mean_value and first_<kind>: what was seen
    up to the cutoff, which is a constant or a column."""
    e = events.where(F.col(loop) <= cutoff)
    return e.groupBy(*keys).agg(F.count("*").alias("n_events"), F.max(F.when(value.isNotNull(), F.struct(F.col(loop).alias("l"), value.alias("v"))))["v"].alias("last_value"), F.max(value).alias("max_value"), F.avg(value).alias("mean_value"), *[F.min(F.when(F.col(kind) == k, F.col(loop))).alias(f"first_{k}") for k in kinds])


def leak_check(featured: DataFrame, plain: DataFrame, entity: str, at: str, n_prior: str) -> DataFrame:
    """One row: n_rows, n_leaks: rows whose stated count of earlier rows isn't the number
    of the entity's rows strictly before it, counted afresh by ranking distinct times."""
    times = plain.where(F.col(at).isNotNull()).groupBy(F.col(entity).alias("__e"), F.col(at).alias("__t")).agg(F.count("*").alias("__n"))
    w = Window.partitionBy("__e").orderBy("__t").rowsBetween(Window.unboundedPreceding, -1)
    times = times.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0)))
    j = featured.join(times, (F.col(entity) == F.col("__e")) & (F.col(at) == F.col("__t")), "left")
    return j.agg(F.count("*").alias("n_rows"), F.count(F.when(F.col(n_prior) != F.col("__before"), 1)).alias("n_leaks"))


def encode_within(df: DataFrame, within: str, column: str, out: str) -> DataFrame:
    """df with a code per value, 0 for the most frequent, counted within `within`; null
    has none. Codes are ranks of counted values, not of rows."""
    n = df.where(F.col(column).isNotNull()).groupBy(within, column).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(within).orderBy(F.desc("__n"), F.col(column))
    codes = n.select(F.col(within).alias("__w"), F.col(column).alias("__c"), (F.row_number().over(w) - 1).alias(out))
    return df.join(codes, F.col(within).eqNullSafe(F.col("__w")) & (F.col(column) == F.col("__c")), "left").drop("__w", "__c")


def periodic_ratings(matches: DataFrame, winner: str, loser: str, period: str, k: float, start: float, scale: float = 400.0) -> DataFrame:
    """entity, period, rating, n: Elo ratings updated once per rating period.

    Within a period all ratings are those from its beginning, so a period is one join and
    one aggregation over all its matches; the periods, which are few, are gone through in
    order. Sequential updates match by match would need one task for everything. k and
    start have no defaults. Null players and periods don't count."""
    m = materialise(matches.select(F.col(winner).alias("w"), F.col(loser).alias("l"), F.col(period).alias("p")).where("w is not null and l is not null and p is not null and w <> l").groupBy("p", "w", "l").agg(F.count("*").alias("n")), "results")
    periods = sorted(r["p"] for r in m.select("p").distinct().collect())
    spark = matches.sparkSession
    state = None
    out = None
    for p in periods:
        now = m.where(F.col("p") == F.lit(p))
        sides = now.select(F.col("w").alias("a"), F.col("l").alias("b"), "n", F.lit(1.0).alias("s")).unionByName(now.select(F.col("l").alias("a"), F.col("w").alias("b"), "n", F.lit(0.0).alias("s")))
        if state is None:
            sides = sides.withColumn("ra", F.lit(start)).withColumn("rb", F.lit(start))
        else:
            r = state.select(F.col("entity").alias("a"), F.col("rating").alias("ra"))
            sides = sides.join(r, "a", "left").join(r.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b", "left").fillna(start, ["ra", "rb"])
        expected = 1 / (1 + F.pow(F.lit(10.0), (F.col("rb") - F.col("ra")) / scale))
        new = sides.groupBy(F.col("a").alias("entity")).agg((F.max("ra") + k * F.sum(F.col("n") * (F.col("s") - expected))).alias("rating"), F.sum("n").alias("n"))
        new = materialise(new, "ratings")
        part = new.withColumn("period", F.lit(p))
        out = part if out is None else out.unionByName(part)
        if state is not None:
            new = new.select("entity", "rating").unionByName(state.select("entity", "rating").join(new, "entity", "left_anti"))
            new = materialise(new, "ratings")
        state = new
    if out is None:
        return spark.createDataFrame([], f"entity {matches.schema[winner].dataType.simpleString()}, rating double, n bigint, period {matches.schema[period].dataType.simpleString()}")
    return out


def replay_ratings(results: pd.DataFrame, k: float, start: float, scale: float = 400.0) -> dict:
    """Plain reference of periodic_ratings for tests: results with p, w, l."""
    rating: dict = {}
    for _, part in results.sort_values("p").groupby("p", sort=True):
        change: dict = {}
        for w, l in zip(part["w"], part["l"]):
            rw, rl = rating.get(w, start), rating.get(l, start)
            e = 1 / (1 + np.power(10.0, (rl - rw) / scale))
            change[w] = change.get(w, 0.0) + k * (1 - e)
            change[l] = change.get(l, 0.0) - k * (1 - e)
        for p, c in change.items():
            rating[p] = rating.get(p, start) + c
    return rating


def _volatility(sigma: np.ndarray, phi: np.ndarray, v: np.ndarray, delta: np.ndarray, tau: float) -> np.ndarray:
    """Glicko-2's new volatilities: the root of its log-volatility condition, bracketed and
    then halved down to the last digit."""
    a = np.log(sigma**2)

    def f(x: np.ndarray) -> np.ndarray:
        e = np.exp(x)
        return e * (delta**2 - phi**2 - v - e) / (2 * (phi**2 + v + e) ** 2) - (x - a) / tau**2

    over = delta**2 - phi**2 - v
    high = np.where(over > 0, np.log(np.where(over > 0, over, 1.0)), a)
    low = np.minimum(a, high)
    high = np.maximum(a, high)
    step = 0
    while (f(low) < 0).any():
        low = np.where(f(low) < 0, low - tau * 2**step, low)
        step += 1
    for _ in range(80):
        middle = (low + high) / 2
        up = f(middle) > 0
        low, high = np.where(up, middle, low), np.where(up, high, middle)
    return np.exp((low + high) / 4)


def glicko2_ratings(matches: DataFrame, winner: str, loser: str, period: str, tau: float, start: tuple[float, float, float] = (1500.0, 350.0, 0.06), initial: DataFrame | None = None) -> DataFrame:
    """entity, period, rating, deviation, volatility, n: Glicko-2 ratings, updated once per
    rating period, of those who played in it.

    All results of a period count against the ratings from its beginning, so a period is
    two joins and one aggregation; the periods, which are few, are gone through in order.
    Who doesn't play keeps rating and volatility, and its deviation grows. initial:
    entity, rating, deviation, volatility of known players; others begin at `start`.
    Null players and periods, and players against themselves, don't count; repeated
    results count as often as they occur; no results give an empty table."""
    scale, centre = 173.7178, 1500.0  # fixed values of the method's internal scale
    spark = matches.sparkSession
    who, when = matches.schema[winner].dataType.simpleString(), matches.schema[period].dataType.simpleString()
    m = materialise(matches.select(F.col(winner).alias("w"), F.col(loser).alias("l"), F.col(period).alias("p")).where("w is not null and l is not null and p is not null and w <> l").groupBy("p", "w", "l").agg(F.count("*").alias("n")), "results")
    columns = ["rating", "deviation", "volatility"]
    state = initial.select("entity", *columns) if initial is not None else spark.createDataFrame([], f"entity {who}, rating double, deviation double, volatility double")
    state, out = materialise(state, "ratings"), None

    def update(batches):
        for b in batches:
            mu, phi, sigma = (b["rating"].to_numpy() - centre) / scale, b["deviation"].to_numpy() / scale, b["volatility"].to_numpy().copy()
            played = b["n"].to_numpy() > 0
            if played.any():
                v = 1 / b["information"].to_numpy()[played]
                gain = b["gain"].to_numpy()[played]
                sigma[played] = _volatility(sigma[played], phi[played], v, v * gain, tau)
            phi = np.sqrt(phi**2 + sigma**2)
            if played.any():
                phi[played] = 1 / np.sqrt(1 / phi[played] ** 2 + 1 / v)
                mu[played] = mu[played] + phi[played] ** 2 * gain
            yield b[["entity", "n"]].assign(rating=mu * scale + centre, deviation=phi * scale, volatility=sigma)[["entity", "rating", "deviation", "volatility", "n"]]

    for p in sorted(r["p"] for r in m.select("p").distinct().collect()):
        now = m.where(F.col("p") == F.lit(p))
        sides = now.select(F.col("w").alias("a"), F.col("l").alias("b"), "n", F.lit(1.0).alias("s")).unionByName(now.select(F.col("l").alias("a"), F.col("w").alias("b"), "n", F.lit(0.0).alias("s")))
        side = lambda k: state.select(F.col("entity").alias(k), F.col("rating").alias(f"r{k}"), F.col("deviation").alias(f"d{k}"))
        sides = sides.join(side("a"), "a", "left").join(side("b"), "b", "left").fillna({"ra": start[0], "rb": start[0], "da": start[1], "db": start[1]})
        g = 1 / F.sqrt(1 + 3 * F.pow(F.col("db") / scale, F.lit(2)) / math.pi**2)
        e = 1 / (1 + F.exp(-g * (F.col("ra") - F.col("rb")) / scale))
        sums = sides.groupBy(F.col("a").alias("entity")).agg(F.sum(F.col("n") * g * g * e * (1 - e)).alias("information"), F.sum(F.col("n") * g * (F.col("s") - e)).alias("gain"), F.sum("n").alias("n"))
        both = state.join(sums, "entity", "full").fillna(dict(zip(columns, start))).fillna(0, ["n", "information", "gain"])
        new = both.select("entity", *columns, "information", "gain", "n").mapInPandas(update, f"entity {who}, rating double, deviation double, volatility double, n bigint")
        new = materialise(new, "ratings")
        part = new.where("n > 0").withColumn("period", F.lit(p))
        out = part if out is None else out.unionByName(part)
        state = new.drop("n")
    if out is None:
        return spark.createDataFrame([], f"entity {who}, rating double, deviation double, volatility double, n bigint, period {when}")
    return out


def snapshot_check(snapshot: DataFrame, events: DataFrame, keys: list[str], loop: str, cutoff: Column, n_events: str) -> DataFrame:
    """One row: n_rows, n_leaks: snapshots whose stated number of events isn't that of the
    events at or before the cutoff, as when a whole replay was aggregated."""
    have = events.where(F.col(loop) <= cutoff).groupBy(*keys).agg(F.count("*").alias("__n"))
    j = snapshot.join(have, keys, "left")
    return j.agg(F.count("*").alias("n_rows"), F.count(F.when(F.col(n_events) != F.coalesce("__n", F.lit(0)), 1)).alias("n_leaks"))


def role_check(columns: list[str], roles: dict[str, str], allowed: list[str]) -> list[tuple[str, str]]:
    """(column, role) of the features that have a role which no feature may have: the
    target, what is known after the match only, a rating after it, a label of the source
    that isn't declared a control. A column without a role isn't allowed either."""
    return [(c, roles.get(c, "undeclared")) for c in columns if roles.get(c, "undeclared") not in allowed]


def fitted_check(fitted: DataFrame, train: DataFrame, key: str, stated: str, value: Column, tolerance: float = 1e-9) -> DataFrame:
    """One row: n_keys, n_leaks: keys whose stated statistic isn't the mean of `value` over
    the training rows alone, as when an encoder was fitted before the split."""
    own = train.groupBy(F.col(key).alias("__k")).agg(F.avg(value).alias("__v"))
    j = fitted.join(own, F.col(key).eqNullSafe(F.col("__k")), "left")
    same = (F.abs(F.col(stated) - F.col("__v")) <= tolerance) | (F.col(stated).isNull() & F.col("__v").isNull())
    return j.agg(F.count("*").alias("n_keys"), F.count(F.when(~F.coalesce(same, F.lit(False)), 1)).alias("n_leaks"))


def slot_check(view: DataFrame, slot: str, won: str, deviations: float = 4.0) -> DataFrame:
    """One row: n, share_won of slot 0, leaks: whether it is further from a half than so
    many standard deviations, as when the slot tells who won."""
    w = view.where(F.col(slot) == 0).agg(F.count(won).alias("n"), F.avg(F.col(won).cast("int")).alias("share_won"))
    return w.withColumn("leaks", F.coalesce(F.abs(F.col("share_won") - 0.5) > deviations * 0.5 / F.sqrt("n"), F.lit(False)))
