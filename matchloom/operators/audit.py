"""Audits: column census, missingness ledger, referential and leakage checks.

Each audit is one wide aggregation, or one aggregation of the table in long form, over
one scan, however many columns there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

_NESTED = (T.StructType, T.MapType, T.ArrayType)


def leaf_columns(schema: T.StructType, prefix: str = "") -> list[tuple[str, T.DataType]]:
    """Dotted names and types of all leaves of nested structs."""
    out: list[tuple[str, T.DataType]] = []
    for f in schema.fields:
        name = f"{prefix}`{f.name}`"
        out += leaf_columns(f.dataType, name + ".") if isinstance(f.dataType, T.StructType) else [(name, f.dataType)]
    return out


def _rows(one: DataFrame, names: list[str], fields: list[str]) -> DataFrame:
    """One wide row of <i>_<field> as one row per name."""
    parts = [F.struct(F.lit(n.replace("`", "")).alias("column_name"), *[F.col(f"{i}_{f}").alias(f) for f in fields]) for i, n in enumerate(names)]
    return one.select(F.inline(F.array(*parts)))


def column_census(df: DataFrame, skip: list[str] = ()) -> DataFrame:
    """One row per column: dtype, n_rows, n_null, null_pct (4 digits), n_distinct, n_zero,
    zero_pct (of non-null rows), low and high as text (numbers, times and texts), and
    len_min, len_max, len_avg of lists. Nested columns and those of `skip` have no
    distinct count. An empty table has counts 0 and percentages null."""
    fields = ["dtype", "n_rows", "n_null", "n_distinct", "n_zero", "low", "high", "len_min", "len_max", "len_avg"]
    aggs: list[Column] = []
    for i, f in enumerate(df.schema.fields):
        c, t = F.col(f"`{f.name}`"), f.dataType
        nested, number, lists = isinstance(t, _NESTED), isinstance(t, T.NumericType), isinstance(t, T.ArrayType)
        n = F.size(c) if lists else F.lit(None)
        plain = not nested and not isinstance(t, T.BooleanType)
        values = [
            F.max(F.lit(t.simpleString()[:60])),
            F.count("*"),
            F.count("*") - F.count(c),
            F.countDistinct(c) if not nested and f.name not in skip else F.max(F.lit(None).cast("bigint")),
            F.count(F.when(c == 0, 1)) if number else F.max(F.lit(None).cast("bigint")),
            F.min(c).cast("string") if plain else F.max(F.lit(None).cast("string")),
            F.max(c).cast("string") if plain else F.max(F.lit(None).cast("string")),
            F.min(F.when(c.isNotNull(), n)).cast("int") if lists else F.max(F.lit(None).cast("int")),
            F.max(F.when(c.isNotNull(), n)).cast("int") if lists else F.max(F.lit(None).cast("int")),
            F.round(F.avg(F.when(c.isNotNull(), n)), 2) if lists else F.max(F.lit(None).cast("double")),
        ]
        aggs += [v.alias(f"{i}_{k}") for k, v in zip(fields, values)]
    out = _rows(df.agg(*aggs), [f.name for f in df.schema.fields], fields)
    pct = lambda a, b: F.round(100.0 * F.col(a) / F.nullif(b, F.lit(0)), 4)
    return out.withColumn("null_pct", pct("n_null", F.col("n_rows"))).withColumn("zero_pct", pct("n_zero", F.col("n_rows") - F.col("n_null")))


def leaf_census(df: DataFrame) -> DataFrame:
    """column_name (dotted), n_null, n_distinct of every leaf of nested structs."""
    leaves = [(n, t) for n, t in leaf_columns(df.schema) if not isinstance(t, (T.MapType, T.ArrayType))]
    aggs = [x for i, (n, _) in enumerate(leaves) for x in ((F.count("*") - F.count(F.col(n))).alias(f"{i}_n_null"), F.countDistinct(F.col(n)).alias(f"{i}_n_distinct"))]
    return _rows(df.agg(*aggs), [n for n, _ in leaves], ["n_null", "n_distinct"])


def frequent_values(df: DataFrame, columns: list[str], n: int = 5, rarest: bool = False) -> DataFrame:
    """column_name, rank, value, n, pct: the most frequent values of each column, in
    percent of all rows, null being a value; or the rarest, of non-null rows only. Ties
    go by value."""
    u = df.select(*[F.col(f"`{c}`").cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "value")
    g = (u.where("value is not null") if rarest else u).groupBy("column_name", "value").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("column_name"))
    order = Window.partitionBy("column_name").orderBy(F.col("n") if rarest else F.desc("n"), F.col("value").asc_nulls_last())
    g = g.withColumn("pct", F.round(100.0 * F.col("n") / total, 4)).withColumn("rank", F.row_number().over(order))
    return g.where(F.col("rank") <= n).select("column_name", "rank", "value", "n", "pct")


def uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, ratio (distinct by rows), ratio_non_null."""
    aggs = [x for i, c in enumerate(columns) for x in (F.count("*").alias(f"{i}_n"), F.count(c).alias(f"{i}_v"), F.countDistinct(c).alias(f"{i}_d"))]
    r = _rows(df.agg(*aggs), columns, ["n", "v", "d"])
    return r.select("column_name", (F.col("d") / F.nullif(F.col("n"), F.lit(0))).alias("ratio"), (F.col("d") / F.nullif(F.col("v"), F.lit(0))).alias("ratio_non_null"))


#: Percent missing up to which a column is kept as it is, imputed, and kept at all.
RARE, FREQUENT, HOPELESS = 5, 40, 80


def recommend(pct: float, n_null: int, n_sentinel: int, mechanism: str, primary: bool) -> str:
    """What to do about a column with pct percent missing."""
    return recommendation(pct, n_null, n_sentinel, mechanism, primary)[0]


def recommendation(pct: float, n_null: int, n_sentinel: int, mechanism: str, primary: bool) -> tuple[str, str]:
    """What to do about a column with pct percent missing, and why."""
    if n_sentinel and not n_null and pct < RARE:
        return "CONVERT_SENTINEL_TO_NULL", f"{pct:.2f} % stand-ins and no nulls, below {RARE} %: make them null, then treat as missing."
    if pct == 0:
        return "RETAIN_AS_IS", "Nothing is missing."
    if pct > FREQUENT:
        if pct <= HOPELESS and primary and mechanism != "MNAR":
            return "FLAG_FOR_IMPUTATION", f"{pct:.2f} % missing, above {FREQUENT} %, but a primary feature whose gaps don't depend on its value ({mechanism})."
        return "DROP_COLUMN", f"{pct:.2f} % missing, above {HOPELESS if pct > HOPELESS else FREQUENT} %."
    if pct > RARE:
        return "FLAG_FOR_IMPUTATION", f"{pct:.2f} % missing, between {RARE} and {FREQUENT} %: impute, by other columns if {mechanism} says so."
    return "RETAIN_AS_IS", f"{pct:.2f} % missing, at most {RARE} %: rows may be left out or filled simply."


def missingness_ledger(df: DataFrame, view: str, spec: dict[str, dict] | None = None, identity: list[str] = (), target: list[str] = ()) -> DataFrame:
    """One row per column: counts of nulls and stand-ins, distinct values, mechanism and
    recommendation, each with its justification.

    spec: per column sentinel (a list of values), mechanism (MCAR, MAR, MNAR),
    justification, semantic and primary; without it MAR is assumed. identity columns are kept as they are and
    not counted distinct; constants without gaps are dropped; a target with gaps is
    EXCLUDE_TARGET_NULL_ROWS. A sentinel of a column that isn't there counts nothing."""
    spec = spec or {}
    names = df.columns
    aggs: list[Column] = [F.count("*").alias("n_total")]
    for i, c in enumerate(names):
        col, marks = F.col(f"`{c}`"), (spec.get(c) or {}).get("sentinel") or []
        aggs += [(F.count("*") - F.count(col)).alias(f"{i}_null"), F.count(F.when(col.isin(*marks), 1)).alias(f"{i}_sent") if marks else F.lit(0).alias(f"{i}_sent")]
        aggs.append(F.lit(None).cast("bigint").alias(f"{i}_dist") if c in identity or isinstance(df.schema[c].dataType, _NESTED) else F.countDistinct(col).alias(f"{i}_dist"))
    one = df.agg(*aggs).first()
    total, rows = one["n_total"], []
    for i, c in enumerate(names):
        n_null, n_sent, n_dist, s = one[f"{i}_null"], one[f"{i}_sent"], one[f"{i}_dist"], spec.get(c) or {}
        share = lambda n: round(100.0 * n / total, 4) if total else 0.0
        pct = round(share(n_null) + share(n_sent), 4)
        missing = n_null + n_sent
        mechanism, semantic, primary = s.get("mechanism", "MAR"), bool(s.get("semantic")), bool(s.get("primary"))
        why = s.get("justification") or f"Nothing is stated about the column; MAR is assumed ({share(n_null):.2f} % null, {share(n_sent):.2f} % stand-ins)."
        if c in identity:
            mechanism, semantic, primary, advice = "N/A", False, False, "RETAIN_AS_IS"
            why, reason = "An identity column.", "Identity columns are kept as they are."
        elif n_dist == 1 and not missing:
            mechanism, semantic, primary, advice = "N/A", False, False, "DROP_COLUMN"
            why, reason = f"One value in all {total} rows.", "A constant says nothing about a row."
        elif not missing:
            mechanism, advice = "N/A", "RETAIN_AS_IS"
            why, reason = "Nothing is missing.", "Nothing is missing."
        else:
            advice, reason = recommendation(pct, n_null, n_sent, mechanism, primary)
        if c in target and missing:
            advice, reason = "EXCLUDE_TARGET_NULL_ROWS", "Rows without the target are left out of what is predicted, but stay in the history; a target is never filled."
        marks = s.get("sentinel")
        rows.append((view, c, df.schema[c].dataType.simpleString(), total, n_null, share(n_null), ",".join(map(str, marks)) if marks else None, n_sent, share(n_sent), pct, n_dist, mechanism, why, advice, reason, semantic, primary))
    ddl = "view_name string, column_name string, dtype string, n_total bigint, n_null bigint, pct_null double, sentinel_value string, n_sentinel bigint, pct_sentinel double, pct_missing_total double, n_distinct bigint, mechanism string, mechanism_justification string, recommendation string, recommendation_justification string, carries_semantic_content boolean, is_primary_feature boolean"
    return df.sparkSession.createDataFrame(rows, ddl)


def audit_block(ledgers: dict[str, DataFrame]) -> dict[str, dict]:
    """The ledgers of several tables as one document: {"views": {name: {"total_rows",
    "columns_audited", "ledger": [a record per column]}}}. Ledgers have a row per column."""
    views = {}
    for name, ledger in ledgers.items():
        rows = [r.asDict() for r in ledger.collect()]
        views[name] = {"total_rows": rows[0]["n_total"] if rows else 0, "columns_audited": len(rows), "ledger": rows}
    return {"views": views}


def dictionary_match(df: DataFrame, column: str, dictionary: DataFrame, key: str) -> DataFrame:
    """One row: n_rows, n_matched, n_unmatched (rows with a value that the dictionary lacks),
    n_null, n_unused (keys that no row has)."""
    have = df.groupBy(F.col(column).alias("k")).agg(F.count("*").alias("n"))
    known = dictionary.select(F.col(key).alias("k")).where("k is not null").distinct().withColumn("known", F.lit(True))
    j = have.join(known, "k", "full")
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return j.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), total(F.col("known")).alias("n_matched"), total(F.col("k").isNotNull() & F.col("known").isNull()).alias("n_unmatched"), total(F.col("k").isNull()).alias("n_null"), F.count(F.when(F.col("n").isNull(), 1)).alias("n_unused"))


def referential_checks(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """One row: n_child_orphans (rows whose key has no parent), n_parent_childless (keys
    without a child), n_child_null."""
    c = child.groupBy(F.col(child_key).alias("k")).agg(F.count("*").alias("n"))
    p = parent.select(F.col(parent_key).alias("k")).where("k is not null").distinct().withColumn("p", F.lit(1))
    j = c.join(p, "k", "full")
    zero = F.lit(0)
    return j.agg(F.coalesce(F.sum(F.when(F.col("p").isNull() & F.col("k").isNotNull(), F.col("n"))), zero).alias("n_child_orphans"), F.count(F.when(F.col("n").isNull(), 1)).alias("n_parent_childless"), F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("n"))), zero).alias("n_child_null"))


def time_window_gate(df: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """One row: n_rows, n_before, n_after (at or later than end), first, last, passed: a
    reference period holds nothing from outside of it. Null times are outside."""
    t = F.col(at).cast("timestamp")
    a, b = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    r = df.agg(F.count("*").alias("n_rows"), F.count(F.when(t < a, 1)).alias("n_before"), F.count(F.when(t >= b, 1)).alias("n_after"), F.count(F.when(t.isNull(), 1)).alias("n_null"), F.min(t).cast("string").alias("first"), F.max(t).cast("string").alias("last"))
    return r.withColumn("passed", (F.col("n_before") + F.col("n_after") + F.col("n_null")) == 0)


def column_absence_gate(df: DataFrame, banned: list[str]) -> DataFrame:
    """column_name, present: columns that must not be in a table, such as those that are
    known only after the event."""
    return df.sparkSession.createDataFrame([(c, c in df.columns) for c in banned], "column_name string, present boolean")


def derived_value_check(df: DataFrame, stored: Column, expected: Column, tolerances: list[float]) -> DataFrame:
    """One row: n, n_exact, and n_within_<i> per tolerance, of rows with both values."""
    gap = F.abs(stored - expected)
    return df.agg(F.count(gap).alias("n"), F.count(F.when(gap == 0, 1)).alias("n_exact"), *[F.count(F.when(gap <= x, 1)).alias(f"n_within_{i}") for i, x in enumerate(tolerances)])
