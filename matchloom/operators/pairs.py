"""Two-row matches: validity, the focal and opponent view, and its checks.

A match is a key with exactly two rows, each row one side. The symmetric view has two
rows per match, each with its own and the other side's attributes.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions.scalar import hash_parity


def valid_two_row_matches(df: DataFrame, match: str, outcome: str) -> DataFrame:
    """match: keys whose distinct rows are two, one with outcome 1 and one with 0. Null
    outcomes and null keys don't qualify; exact repeats of a row count once."""
    d = df.where(F.col(match).isNotNull()).distinct()
    o = F.col(outcome)
    g = d.groupBy(match).agg(F.count("*").alias("n"), F.count(F.when(o == 1, 1)).alias("w"), F.count(F.when(o == 0, 1)).alias("l"))
    return g.where("n = 2 and w = 1 and l = 1").select(match)


def _valid_rows(df: DataFrame, match: str, side: str, outcome: str, keep: list[str]) -> DataFrame:
    d = df.select(match, side, outcome, *keep).where(F.col(match).isNotNull()).distinct()
    return d.join(valid_two_row_matches(d, match, outcome), match, "left_semi")


def symmetric_by_join(df: DataFrame, match: str, side: str, outcome: str, keep: list[str]) -> DataFrame:
    """match, side, opponent, won, then for each of `keep` its value and opponent_<name>:
    a self join on the match with unequal sides."""
    a = _valid_rows(df, match, side, outcome, keep)
    b = a.select(F.col(match).alias("__m"), F.col(side).alias("opponent"), *[F.col(c).alias(f"opponent_{c}") for c in keep])
    j = a.join(b, (F.col(match) == F.col("__m")) & (F.col(side) != F.col("opponent")))
    return j.select(match, side, "opponent", (F.col(outcome) == 1).alias("won"), *[x for c in keep for x in (c, f"opponent_{c}")])


def symmetric_by_aggregation(df: DataFrame, match: str, side: str, outcome: str, keep: list[str]) -> DataFrame:
    """The same view by one aggregation per match and two output rows: half the shuffle
    of the self join, and no row is read twice."""
    cols = [side, outcome, *keep]
    d = df.select(match, *cols).where(F.col(match).isNotNull()).distinct()
    row, o = F.struct(*cols), F.col(outcome)
    g = d.groupBy(match).agg(F.count("*").alias("n"), F.count(F.when(o == 1, 1)).alias("w"), F.count(F.when(o == 0, 1)).alias("l"), F.max(F.when(o == 1, row)).alias("x"), F.max(F.when(o == 0, row)).alias("y"))
    g = g.where((F.col("n") == 2) & (F.col("w") == 1) & (F.col("l") == 1) & (F.col(f"x.{side}") != F.col(f"y.{side}")))
    two = g.select(match, F.inline(F.array(F.struct(F.col("x").alias("a"), F.col("y").alias("b")), F.struct(F.col("y").alias("a"), F.col("x").alias("b")))))
    return two.select(match, F.col(f"a.{side}").alias(side), F.col(f"b.{side}").alias("opponent"), (F.col(f"a.{outcome}") == 1).alias("won"), *[x for c in keep for x in (F.col(f"a.{c}").alias(c), F.col(f"b.{c}").alias(f"opponent_{c}"))])


def symmetry_violations(view: DataFrame, match: str, side: str, keep: list[str]) -> DataFrame:
    """One row: n_rows, n_matches, n_violations. A match violates symmetry unless it has
    two rows with mirrored sides, opposite outcomes and mirrored attributes (nulls are
    alike)."""
    mirrored = lambda a, b: F.struct(F.col(a).alias("x"), F.col(b).alias("y"))
    pairs = [(side, "opponent"), *[(c, f"opponent_{c}") for c in keep]]
    agg = [F.count("*").alias("n"), F.sum(F.col("won").cast("int")).alias("w")]
    for i, (a, b) in enumerate(pairs):
        agg += [F.min(mirrored(a, b)).alias(f"p{i}"), F.max(mirrored(a, b)).alias(f"q{i}")]
    g = view.groupBy(match).agg(*agg)
    ok = (F.col("n") == 2) & (F.col("w") == 1)
    for i in range(len(pairs)):
        ok &= F.col(f"p{i}.x").eqNullSafe(F.col(f"q{i}.y")) & F.col(f"p{i}.y").eqNullSafe(F.col(f"q{i}.x"))
    return g.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_matches"), F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias("n_violations"))


def canonical_slots(view: DataFrame, match: str, side: str, seed: int = 0) -> DataFrame:
    """`view` with slot 0 or 1: exactly one row of each per match, balanced and
    independent of the outcome, decided by a hash of the match."""
    lower = (F.col(side) < F.col("opponent")).cast("int")
    return view.withColumn("slot", F.pmod(hash_parity(F.col(match), seed) + lower, F.lit(2)).cast("int"))


def slot_balance(slotted: DataFrame, match: str) -> DataFrame:
    """One row: n_matches, n_bad (matches without exactly one row per slot), share_won
    (wins of slot 0)."""
    g = slotted.groupBy(match).agg(F.count("*").alias("n"), F.sum("slot").alias("s"), F.max(F.when(F.col("slot") == 0, F.col("won").cast("int"))).alias("w"))
    return g.agg(F.count("*").alias("n_matches"), F.count(F.when((F.col("n") != 2) | (F.col("s") != 1), 1)).alias("n_bad"), F.avg("w").alias("share_won"))


def null_sentinels(df: DataFrame, sentinels: dict[str, list]) -> DataFrame:
    """Stand-in values made null, each column with a flag `<name>_was_sentinel`. A value
    that was null before has flag false."""
    out = df
    for c, values in sentinels.items():
        hit = F.coalesce(F.col(c).isin(*values), F.lit(False))
        out = out.withColumn(f"{c}_was_sentinel", hit).withColumn(c, F.when(~hit, F.col(c)))
    return out


def duration_flags(seconds: Column, longest: int = 86_400) -> list[Column]:
    """is_suspicious (longer than `longest`) and is_negative; null durations are neither."""
    f = lambda c: F.coalesce(c, F.lit(False))
    return [f(seconds > longest).alias("is_suspicious"), f(seconds < 0).alias("is_negative")]


def classify(df: DataFrame, group: str, rules: list[tuple[str, Column]], *measures: Column, otherwise: str = "other") -> DataFrame:
    """group, class: the first rule that holds for the group's measures names its class."""
    g = df.groupBy(group).agg(*measures)
    label: Column | None = None
    for name, rule in rules:
        label = F.when(rule, name) if label is None else label.when(rule, name)
    return g.select(group, (F.lit(otherwise) if label is None else label.otherwise(otherwise)).alias("class"))


