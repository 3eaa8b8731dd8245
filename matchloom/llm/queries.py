"""Queries p1 and p7 to p10 over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.leaks import find_leaks
from matchloom.llm.names import account_pairs, link_accounts, trie_join
from matchloom.llm.packing import pack, token_counts
from matchloom.llm.reading import detect_languages, reading_levels
from matchloom.llm.ranking import luce_strengths
from matchloom.session import materialise, table


def duel_results(spark: SparkSession, d: str) -> DataFrame:
    """(winner, loser) of every one-against-one match that was decided between two rows."""
    # only exact repeats are taken out, whatever else a row holds; the match is the key of both steps
    m = table(spark, d, "matches_long_raw").where("leaderboard_raw = 3 and match_id is not null")
    m = m.repartition("match_id").distinct()
    won, lost = F.col("outcome_raw") == 1, F.col("outcome_raw") == 0
    m = m.groupBy("match_id").agg(F.count("*").alias("n"), F.count(F.when(won, 1)).alias("w"), F.count(F.when(lost, 1)).alias("l"), F.max(F.when(won, F.col("player_id"))).alias("winner"), F.max(F.when(lost, F.col("player_id"))).alias("loser"))
    return m.where("n = 2 and w = 1 and l = 1 and match_id is not null").select("winner", "loser")


def p1_strengths(spark: SparkSession, d: str) -> DataFrame:
    """Every player's strength. Half a win and half a loss against a virtual player are
    added for each: the plain maximum doesn't exist for players who never lost or won."""
    s = luce_strengths(duel_results(spark, d), prior=0.5)
    return s.select(F.col("player").alias("player_id"), "strength", "n_comparisons", "n_won")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    s = p1_strengths(spark, d).where("n_comparisons >= 12")
    return s.orderBy(F.desc("strength"), "player_id").limit(6).select("player_id")


def _forms(spark: SparkSession, d: str) -> dict[str, str]:
    """The helper list of given names; it has a fixed size."""
    rows = table(spark, d, "name_forms").where("short_form is not null and full_form is not null").collect()
    return {r["full_form"].lower(): r["full_form"].lower() for r in rows} | {r["short_form"].lower(): r["full_form"].lower() for r in rows}


def p7_people(spark: SparkSession, d: str) -> DataFrame:
    """Accounts with the person they belong to."""
    return link_accounts(table(spark, d, "replay_players_raw"), _forms(spark, d), "toon_id", "nickname").select(F.col("account").alias("toon_id"), "person")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = account_pairs(p7_people(spark, d).withColumnRenamed("toon_id", "account"))
    return pairs.select(F.col("a").alias("toon_id_a"), F.col("b").alias("toon_id_b"))


def p7_near_names(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of distinct nicknames, lower case and as one word, within one edit."""
    n = table(spark, d, "replay_players_raw").select(F.translate(F.lower("nickname"), " áàâäéèêëíìîïóòôöúùûüýšž", "_aaaaeeeeiiiioooouuuuysz").alias("name"))
    return trie_join(n).where("name < other").select("name", "other")


#: Tokens that a container holds.
CAPACITY = 2_048


def p8_pack(spark: SparkSession, d: str) -> DataFrame:
    """Every document's place: container, and the part of the document if it was cut."""
    return pack(token_counts(table(spark, d, "documents")), CAPACITY)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every container's load."""
    p = p8_pack(spark, d).where("container is not null")
    return p.groupBy("container").agg(F.count("*").alias("n_pieces"), F.sum("size").alias("n_tokens")).withColumn("unused", CAPACITY - F.col("n_tokens"))


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with passages of evaluation items, and how much of them."""
    return find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).select("doc_id", "item_id")


def p10_levels(spark: SparkSession, d: str) -> DataFrame:
    """Difficulty and reading level of every document. The scale is that of the English
    documents, where labels are; documents without a language are placed on it if their
    words are English. All others have level null, and `reason` says why."""
    docs = table(spark, d, "documents").select("doc_id", "text", "lang").where("doc_id is not null")
    unknown = materialise(docs.where("lang is null").join(detect_languages(docs), "doc_id", "left"), "detected")
    levels = reading_levels(docs.where("lang = 'en'"), table(spark, d, "reading_labels"), also=unknown.where("detected = 'en'"))
    levels = levels.select("*", F.lit("en").alias("language"))
    rest = docs.where("lang <> 'en'").select("doc_id", F.col("lang").alias("language"))
    rest = rest.unionByName(unknown.where("detected is null or detected <> 'en'").select("doc_id", F.col("detected").alias("language")))
    out = levels.unionByName(rest, allowMissingColumns=True)
    why = F.when(F.col("level").isNotNull(), None).when(F.col("language").isNull(), "language unknown").when(F.col("language") == "en", "no words to go by")
    return out.withColumn("reason", why.otherwise("no labels in this language"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("lang = 'en'")
    return reading_levels(docs, table(spark, d, "reading_labels")).where("level = 5").select("doc_id")


QUERIES = {f.__name__: f for f in (p1_found, p1_strengths, p7_found, p7_people, p7_near_names, p8_pack, p8_containers, p9_found, p9_leaks, p10_found, p10_levels)}
