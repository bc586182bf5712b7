"""Ground truth: match by normalised key, ambiguous target keys excluded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def jurisdiction_key(c: Column) -> Column:
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def number_key(number: Column, jurisdiction: Column) -> Column:
    """Comparable form of a company number.

    Letters and digits only, upper-cased; all-digit keys lose leading zeros (all zeros: '0'); German keys lose trailing letters; French
    keys of 14 digits keep the first 9.
    """
    base = F.upper(F.regexp_replace(F.trim(F.coalesce(number.cast("string"), F.lit(""))), "[^0-9A-Za-z]", ""))
    bare = F.regexp_replace(base, "^0+", "")
    numeric = F.when(base.rlike("^[0-9]+$"), F.when(bare == "", "0").otherwise(bare)).otherwise(base)
    place = jurisdiction_key(jurisdiction)
    return F.when(place == "de", F.regexp_replace(numeric, "[A-Za-z]+$", "")).when((place == "fr") & numeric.rlike("^[0-9]{14}$"), F.left(numeric, F.lit(9))).otherwise(numeric)


def keyed(df: DataFrame) -> DataFrame:
    """df (company_number, jurisdiction_code) with jurisdiction_key, number_key and valid (neither is empty)."""
    out = df.withColumn("jurisdiction_key", jurisdiction_key(F.col("jurisdiction_code"))).withColumn("number_key", number_key(F.col("company_number"), F.col("jurisdiction_code")))
    return out.withColumn("valid", (F.col("jurisdiction_key") != "") & (F.col("number_key") != ""))


def target_lookup(target: DataFrame) -> DataFrame:
    """jurisdiction_key, number_key, target_uri of keys with exactly one row (system_uri, match_uri optional)."""
    uri = F.coalesce(*(F.col(c) for c in ("system_uri", "match_uri") if c in target.columns))
    groups = keyed(target).where("valid").groupBy("jurisdiction_key", "number_key")
    return groups.agg(F.count("*").alias("n"), F.max(uri).alias("target_uri")).where("n = 1").drop("n")


def match(source: DataFrame, target: DataFrame) -> DataFrame:
    """All source rows with match_uri, the target's URI of the same key, or null."""
    rows = keyed(source.drop("match_uri"))
    found = rows.join(target_lookup(target), ["jurisdiction_key", "number_key"], "left")
    return found.withColumn("match_uri", F.when(F.col("valid"), F.col("target_uri"))).drop("target_uri")


def match_stats(matched: DataFrame) -> DataFrame:
    """One row by jurisdiction: rows, valid, matched, match_rate (null without rows)."""
    sums = matched.groupBy("jurisdiction_key").agg(F.count("*").alias("rows"), F.count_if("valid").alias("valid"), F.count("match_uri").alias("matched"))
    return sums.withColumn("match_rate", F.when(F.col("rows") > 0, F.col("matched") / F.col("rows")))


def duplicate_keys(source: DataFrame, target: DataFrame) -> DataFrame:
    """Valid keys with several rows, by side."""
    one = lambda df, side: keyed(df).where("valid").groupBy("jurisdiction_key", "number_key").agg(F.count("*").alias("rows")).where("rows > 1").withColumn("side", F.lit(side))
    return one(source, "source").unionByName(one(target, "target")).select("side", "jurisdiction_key", "number_key", "rows")
