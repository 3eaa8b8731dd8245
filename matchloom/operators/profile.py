"""Column-level data quality profiles of loads of a table.

Everything comes from one pass that counts (load, column, value): standard aggregates,
stand-in values, and the regular expressions that describe a column. The expressions are
induced by minimum description length over all distinct values: values fall into
families of ever coarser shape, and going up from the finest shapes a family is kept as
one expression where that costs fewer bits than its parts, or fewer than spelling its
values out in every row (such rare values then conform to no expression).
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.session import materialise

KEY = ["view_name", "load_prefix", "column_name"]
_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bits: of a letter of an expression, of an expression as such, of a literal's character.
SYMBOL_BITS, ENTRY_BITS, LITERAL_BITS = 8.0, 16.0, 8.0
_D, _L, _W = math.log2(10), math.log2(26), math.log2(62)


def count_cells(*tables: tuple[DataFrame, str, Column, list[str]]) -> DataFrame:
    """(view_name, load_prefix, column_name, value, n) of the cells of all tables, each
    given as (table, its name, the load of a row, columns to skip): how often each load's
    column has each value, as text; null is a value too. Counting is partial before the
    one shuffle, and the key holds the value, so that a hot load is spread over tasks; a
    cell carries its column as a number."""
    names, parts = [], []
    for df, view, load, skip in tables:
        own = []
        for c in df.columns:
            if c not in skip:
                own.append(F.struct(F.lit(len(names)).alias("c"), F.col(f"`{c}`").cast("string").alias("value")))
                names.append((view, c))
        parts.append(df.select(load.alias("load_prefix"), F.inline(F.array(*own))))
    counts = reduce(DataFrame.unionByName, parts).groupBy("c", "load_prefix", "value").agg(F.count("*").alias("n"))
    name = lambda k: F.array(*[F.lit(n[k]) for n in names])[F.col("c")]
    return counts.select(name(0).alias("view_name"), "load_prefix", name(1).alias("column_name"), "value", "n")


def value_counts(df: DataFrame, view: str, load: Column, skip: list[str] = ()) -> DataFrame:
    """count_cells of one table."""
    return count_cells((df, view, load, skip))


def column_profile(counts: DataFrame, stand_ins: DataFrame | None = None, choices: DataFrame | None = None) -> DataFrame:
    """One row per load and column: n_total, n_null, pct_null (percent of all rows),
    n_distinct (non-null), value ranges as text and as number, lengths, the rows of the
    most frequent value, n_sentinel, the rows whose value equals the load's
    `sentinel_value` in `stand_ins` (view_name, load_prefix, column_name, sentinel_value),
    n_expressions and n_nonconforming, the rows that conform to none of the column's
    expressions (`choices`, by default induced from all of `counts`).

    All of it is read off the load's coverage by expressions: a line per load, column and
    expression, null being a class of its own. A column of nulls has n_distinct 0 and null
    ranges; an empty table gives no rows."""
    choices = induce_choices(counts)[1] if choices is None else choices
    c = expression_coverage(counts, choices, stand_ins)
    return (
        c.groupBy(*KEY)
        .agg(
            F.sum("n_rows").alias("n_total"),
            F.coalesce(F.sum(F.when(F.col("is_null"), F.col("n_rows"))), F.lit(0)).alias("n_null"),
            F.coalesce(F.sum(F.when(~F.col("is_null"), F.col("n_values"))), F.lit(0)).alias("n_distinct"),
            F.coalesce(F.sum("n_stand_in"), F.lit(0)).alias("n_sentinel"),
            F.count("shape").cast("int").alias("n_expressions"),
            F.coalesce(F.sum(F.when(~F.col("is_null") & F.col("shape").isNull(), F.col("n_rows"))), F.lit(0)).alias("n_nonconforming"),
            *[f(x).alias(x) for f, x in ((F.min, "min_text"), (F.max, "max_text"), (F.min, "min_number"), (F.max, "max_number"), (F.max, "max_length"))],
            F.max(F.when(~F.col("is_null"), F.col("n_top"))).alias("n_top"),
        )
        .withColumn("pct_null", 100.0 * F.col("n_null") / F.col("n_total"))
    )


def ledger_errors(profile: DataFrame, ledger: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Ledger rows that the profile contradicts: pct_null off by more than `tolerance`,
    or another n_distinct, or another n_sentinel. `profile` must have been made with the
    ledger's stand-ins. A figure that the ledger lacks counts as wrong; a load without
    any rows counts as 0 of everything."""
    p = profile.select(*KEY, F.col("pct_null").alias("p"), F.col("n_distinct").alias("d"), F.col("n_sentinel").alias("s"))
    j = ledger.join(p, KEY, "left")
    wrong = (F.abs(F.coalesce("p", F.lit(0.0)) - F.col("pct_null")) > tolerance + 1e-9) | ~F.col("n_distinct").eqNullSafe(F.coalesce("d", F.lit(0))) | ~F.col("n_sentinel").eqNullSafe(F.coalesce("s", F.lit(0)))
    return j.where(wrong | F.col("pct_null").isNull())


#: Marks in a shape: digit, upper case, lower case, either of them, one or more of the last.
DIGIT, UPPER, LOWER, WORD, RUN = "\u0001", "\u0002", "\u0003", "\u0004", "\u0005"


def _shapes(value: Column) -> list[Column]:
    """A value's shapes, finest first: one class mark per character (others stand for
    themselves); runs joined; letters and digits joined, words in a row too."""
    latin = F.regexp_replace(value, r"[\p{L}&&[^\x00-\x7F]]", "a")
    classes = F.translate(latin, _DIGITS + _UPPER + _LOWER, DIGIT * 10 + UPPER * 26 + LOWER * 26)
    runs = F.regexp_replace(classes, r"(.)\1+", "$1" + RUN)
    words = F.regexp_replace(F.translate(runs, DIGIT + UPPER + LOWER, WORD * 3), f"({WORD}{RUN}?)+", WORD + RUN)
    return [classes, runs, F.regexp_replace(words, f"({WORD}{RUN})( {WORD}{RUN})+", f"{WORD}{RUN}( {WORD}{RUN}){RUN}")]


def _expression(shape: Column) -> Column:
    """A shape as a regular expression."""
    group = f"( {WORD}{RUN}){RUN}"
    e = F.replace(shape, F.lit(group), F.lit("\u0006"))
    e = F.regexp_replace(e, r"([.\\^$?*+(){}\[\]|])", r"\\$1")
    for mark, text in (("\u0006", group), (DIGIT, "[0-9]"), (UPPER, "[A-Z]"), (LOWER, "[a-z]"), (WORD, "[0-9A-Za-z]"), (RUN, "+")):
        e = F.replace(e, F.lit(mark), F.lit(text))
    return e


def induce_choices(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(expressions, choices) by minimum description length.

    expressions: view_name, column_name, expression, shape, level (0 fine to 2 coarse),
    n_values, bits. choices: view_name, column_name, fine, shape: for the finest shape of
    a value the shape of its expression; null for values that are cheaper to spell out
    than to describe: they conform to nothing. Every distinct non-null value of all loads
    takes part."""
    col = ["view_name", "column_name"]
    fine, runs, words = _shapes(F.col("value"))
    v = counts.where("value is not null").groupBy(*col, "value").agg(F.sum("n").alias("n"))
    v = v.select(*col, "value", "n", fine.alias("s0"), runs.alias("s1"), words.alias("s2"))
    size = F.length("value").cast("double")
    digits = F.length(F.regexp_replace("s0", f"[^{DIGIT}]", ""))
    letters = F.length(F.regexp_replace("s0", f"[^{UPPER}{LOWER}]", ""))
    inside = digits * _D + letters * _L
    # the lengths of n runs that together have k characters: about n log2(1 + k / n) each twice
    n_runs = F.greatest(F.length(F.regexp_replace("s1", f"[^{RUN}]", "")), F.lit(1))
    lengths = 2 * n_runs * F.log2(1 + size / n_runs)
    bits = {"s0": inside, "s1": inside + lengths, "s2": (digits + letters) * _W + lengths, "lit": F.col("n") * size * LITERAL_BITS + 4}
    model = lambda s: ENTRY_BITS + SYMBOL_BITS * F.length(s)
    sums = [F.sum(b).alias(f"b_{k}") for k, b in bits.items()]
    t0 = v.groupBy(*col, "s2", "s1", "s0").agg(F.count("*").alias("n"), *sums)
    # at each family: its own expression, its parts' best, or its values spelt out
    # a line per shape; read three times below, so that the values are gone through once
    t0 = materialise(t0.withColumn("own", F.col("b_s0") + model("s0")).withColumn("best", F.least("own", "b_lit")), "shapes")
    add = [F.sum(x).alias(x) for x in ("n", "b_s1", "b_s2", "b_lit")]
    t1 = t0.groupBy(*col, "s2", "s1").agg(*add, F.sum("best").alias("parts"))
    t1 = t1.withColumn("own", F.col("b_s1") + model("s1")).withColumn("best", F.least("own", "parts"))
    t2 = t1.groupBy(*col, "s2").agg(F.sum("n").alias("n"), F.sum("b_s2").alias("b_s2"), F.sum("best").alias("parts"))
    t2 = t2.withColumn("own", F.col("b_s2") + model("s2"))
    pick = (
        t0.select(*col, "s2", "s1", "s0", F.col("n").alias("n0"), F.col("own").alias("own0"), F.col("b_lit").alias("lit0"))
        .join(t1.select(*col, "s2", "s1", F.col("n").alias("n1"), F.col("own").alias("own1"), F.col("parts").alias("parts1")), [*col, "s2", "s1"])
        .join(t2.select(*col, "s2", F.col("n").alias("n2"), F.col("own").alias("own2"), F.col("parts").alias("parts2")), [*col, "s2"])
    )
    level = F.when(F.col("own2") < F.col("parts2"), 2).when(F.col("own1") < F.col("parts1"), 1).when(F.col("own0") < F.col("lit0"), 0)
    at = lambda a, b, c: F.when(F.col("level") == 2, F.col(a)).when(F.col("level") == 1, F.col(b)).when(F.col("level") == 0, F.col(c))
    pick = pick.withColumn("level", level).select(*col, "s0", "level", at("s2", "s1", "s0").alias("shape"), at("n2", "n1", "n0").alias("n_values"), at("own2", "own1", "own0").alias("bits"))
    expressions = pick.where("shape is not null").groupBy(*col, "shape", "level").agg(F.max("n_values").alias("n_values"), F.max("bits").alias("bits")).withColumn("expression", _expression(F.col("shape")))
    # a line per shape, whose size is then known: the join with all counts is a broadcast where it is small
    return expressions, materialise(pick.select(*col, F.col("s0").alias("fine"), "shape"), "choices")


def induce_expressions(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(expressions, assignment): as induce_choices, but the assignment is of values:
    view_name, column_name, value, shape."""
    expressions, choices = induce_choices(counts)
    values = counts.where("value is not null").select("view_name", "column_name", "value").distinct()
    return expressions, _with_shapes(values, choices).select("view_name", "column_name", "value", "shape")


def _with_shapes(values: DataFrame, choices: DataFrame) -> DataFrame:
    """Rows of values with the shape of their expression; `choices` are few beside them."""
    fine = F.when(F.col("value").isNotNull(), _shapes(F.col("value"))[0])
    return values.withColumn("fine", fine).join(choices, ["view_name", "column_name", "fine"], "left").drop("fine")


def expression_coverage(counts: DataFrame, choices: DataFrame, stand_ins: DataFrame | None = None) -> DataFrame:
    """(view_name, load_prefix, column_name, is_null, shape, n_rows, n_values, n_stand_in,
    ranges, share): rows of each load under each expression; shape is null for rows that
    conform to none. Null values are a class of their own (is_null), so that every column
    of a load has a row. Shares are of all rows of the load. choices: what induce_choices
    or induce_expressions gives; stand_ins: as for column_profile."""
    j = _with_shapes(counts, choices) if "fine" in choices.columns else counts.join(choices, ["view_name", "column_name", "value"], "left")
    if stand_ins is not None:
        # one line per load and column that has stand-ins
        s = stand_ins.where("sentinel_value is not null").groupBy(*KEY).agg(F.collect_set("sentinel_value").alias("stand_ins"))
        j = j.join(materialise(s, "stand-ins"), KEY, "left").withColumn("stands_in", F.coalesce(F.array_contains("stand_ins", F.col("value")), F.lit(False)))
    else:
        j = j.withColumn("stands_in", F.lit(False))
    number, n = F.col("value").try_cast("double"), F.col("n")
    by = j.groupBy(*KEY, F.col("value").isNull().alias("is_null"), "shape").agg(
        F.sum("n").alias("n_rows"),
        F.count("value").alias("n_values"),
        F.coalesce(F.sum(F.when(F.col("stands_in"), n)), F.lit(0)).alias("n_stand_in"),
        F.min("value").alias("min_text"),
        F.max("value").alias("max_text"),
        F.min(number).alias("min_number"),
        F.max(number).alias("max_number"),
        F.max(F.length("value")).alias("max_length"),
        F.max("n").alias("n_top"),
    )
    return by.withColumn("share", F.col("n_rows") / F.sum("n_rows").over(Window.partitionBy(*KEY)))


def coverage_drift(coverage: DataFrame, feed: Column) -> DataFrame:
    """Change between each load and the one before it of the same feed, for every column
    of either; only the first load of a feed gives no rows. Per column: the total
    variation distance of the shares of expressions and of null (0 alike, 1 disjoint, or
    the column isn't in one of the loads), the rows that conform to nothing, the number
    of expressions that are new in the load, the share of null and its change."""
    loads = coverage.select("view_name", "load_prefix").distinct().withColumn("feed", feed)
    order = Window.partitionBy("view_name", "feed").orderBy("load_prefix")
    loads = loads.withColumn("later", F.lead("load_prefix").over(order)).withColumn("earlier", F.lag("load_prefix").over(order))
    shape = F.coalesce("shape", F.lit("\x00")).alias("shape")
    new = coverage.select(*KEY, "is_null", shape, F.col("share").alias("q"), "n_rows")
    old = coverage.join(loads, ["view_name", "load_prefix"]).where("later is not null").select("view_name", F.col("later").alias("load_prefix"), "column_name", "is_null", shape, F.col("share").alias("p"))
    pair = new.join(old, [*KEY, "is_null", "shape"], "full")
    q, p, null = F.coalesce("q", F.lit(0.0)), F.coalesce("p", F.lit(0.0)), F.col("is_null")
    d = pair.groupBy(*KEY).agg(
        F.greatest(F.sum(F.greatest(q - p, F.lit(0.0))), F.sum(F.greatest(p - q, F.lit(0.0)))).alias("distance"),
        F.coalesce(F.sum(F.when(~null & (F.col("shape") == "\x00"), F.col("n_rows"))), F.lit(0)).alias("n_nonconforming"),
        F.count(F.when(~null & F.col("p").isNull(), 1)).cast("int").alias("n_new_expressions"),
        F.sum(F.when(null, q).otherwise(0.0)).alias("null_share"),
        F.sum(F.when(null, q - p).otherwise(0.0)).alias("null_change"),
    )
    return d.join(loads.where("earlier is not null").select("view_name", "load_prefix"), ["view_name", "load_prefix"], "left_semi")
