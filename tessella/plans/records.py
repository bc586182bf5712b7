"""Queries over JSON records, perturbation, sub-word vocabularies and event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.operators import perturb, tokenstats, wordpiece
from tessella.registry import query, table

#: A battery of light damage, one scenario a record. Our own profile.
PROFILE = {
    "profile_id": "light",
    "default_seed": 42,
    "scenarios": [
        {"scenario_id": "typo", "weight": 2.0, "chain": [{"operator_id": "typo.keyboard_substitution", "probability": 0.5, "attempts": 2}]},
        {"scenario_id": "order", "chain": [{"operator_id": "word_order.word_shuffle", "probability": 1.0, "attempts": 1}]},
        {"scenario_id": "marks", "chain": [{"operator_id": "diacritic_punct.diacritic_substitution", "probability": 0.5, "attempts": 2}, {"operator_id": "typo.transposition", "probability": 0.5, "attempts": 1}]},
    ],
}


@query()
def perturbed_names(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.concat(F.lit("part://"), F.col("p_partkey")).alias("system_uri"), F.col("p_name").alias("name"), F.lit("gb").alias("jurisdiction_code"))
    return perturb.perturb(names, perturb.parse_profile(PROFILE))


@query()
def wordpiece_fertility(spark, sf_dir):
    """A vocabulary learnt from part names, and its figures over them by brand."""
    parts = table(spark, sf_dir, "part")
    counts = wordpiece.word_counts(parts, "p_name")
    vocabulary = wordpiece.train_pieces(counts, 60)
    return tokenstats.fertility(parts.withColumn("pieces", wordpiece.encode(F.col("p_name"), vocabulary)), "p_name", "pieces", by=["p_brand"])


@query("SELECT event_id, event_type, json_valid(props) AS valid, len(json_keys(props))::INTEGER AS n_keys FROM events")
def json_props(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.try_parse_json("props").isNotNull().alias("valid"), F.size(F.json_object_keys("props")).alias("n_keys"))


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def event_windows(spark, sf_dir):
    from tessella.streaming.windows import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events"), "ts", "event_type", "value").withColumn("value", F.round("value", 4))
