"""Pairs for classifiers: entity splits, positives, negatives, contract checks, models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def unit(key: Column, seed: int) -> Column:
    """A number in [0, 1) from seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string"))), 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def entity_split(key: Column, *, train: float = 0.8, validation: float = 0.1, seed: int = 42) -> Column:
    """train, validation or test, by hash: the same for a key in any order and number of rows."""
    u = unit(key, seed)
    return F.when(u < train, "train").when(u < train + validation, "validation").otherwise("test")


def fold(key: Column, folds: int, *, seed: int = 42) -> Column:
    return F.floor(unit(key, seed) * folds).cast("int")


def alias_pairs(names: DataFrame, priority: Sequence[str] = ()) -> DataFrame:
    """system_uri, left_name, right_name, label 1: each entity's best name (by type priority, then name) with its other distinct names, case apart."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("name_type")) if priority else F.lit(0)
    rank = F.when(rank > 0, rank).otherwise(len(priority) + 1)
    best = names.withColumn("n", F.row_number().over(W.partitionBy("source_uri").orderBy(rank, "name"))).where("n = 1").select("source_uri", F.col("name").alias("left_name"))
    others = names.groupBy("source_uri", F.lower("name").alias("folded")).agg(F.min("name").alias("right_name"))
    pairs = others.join(best, "source_uri").where(F.col("folded") != F.lower("left_name"))
    return pairs.select(F.col("source_uri").alias("system_uri"), "left_name", "right_name", F.lit(1).alias("label"))


def short_name_pairs(df: DataFrame) -> DataFrame:
    """Names with a short name that differs: (system_uri, name, short_name)."""
    return df.where(F.col("short_name").isNotNull() & (F.lower("short_name") != F.lower("name"))).select("system_uri", F.col("name").alias("left_name"), F.col("short_name").alias("right_name"), F.lit(1).alias("label"))


def folded_trigrams(c: Column) -> Column:
    """Character 3-grams of the lower-cased text with single spaces; a text of up to 3 characters is one gram."""
    text = F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")
    return F.when(F.length(text) <= 3, F.array(text)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substr(text, i, F.lit(3)))))


def negatives(positives: DataFrame, pool: DataFrame, *, random: int = 1, hard: int = 1, draws: int = 16, seed: int = 42) -> DataFrame:
    """Label-0 pairs: for each positive pair, `random` and `hard` names of other entities of the anchor's split.

    Candidates are drawn from hashed slots: a pool row has a slot in its split, a positive looks at `draws` slots hashed
    from its names, so it meets a bounded number of rows by an equi-join, and two positives of one anchor draw
    differently. Random ones are the first by draw, hard ones the most alike by character 3-grams (ties by name, uri).
    positives: system_uri, left_name and, if an anchor may have several, right_name (repeats count once); pool:
    system_uri, name.

    Returns system_uri, left_name, positive_name (the positive's other name), right_name, label, split, kind.
    """
    split = lambda c: entity_split(F.col(c), seed=seed)
    sized = pool.withColumn("split", split("system_uri"))
    slots = sized.groupBy("split").agg(F.greatest(F.count("*"), F.lit(1)).alias("slots"))
    dealt = sized.join(F.broadcast(slots), "split").select("split", F.floor(unit(F.concat_ws("|", "system_uri", "name"), seed) * F.col("slots")).alias("slot"), F.col("system_uri").alias("other_uri"), F.col("name").alias("right"))  # three rows
    own = ["system_uri", "left_name", "positive_name"]
    positive = F.col("right_name") if "right_name" in positives.columns else F.lit(None).cast("string")
    anchors = positives.select("system_uri", "left_name", positive.alias("positive_name")).distinct().withColumn("split", split("system_uri")).join(F.broadcast(slots), "split")
    look = lambda k: F.struct(k.alias("draw"), F.floor(unit(F.concat_ws("|", *own, k.cast("string")), seed) * F.col("slots")).alias("slot"))
    looks = anchors.select(*own, "split", F.explode(F.transform(F.sequence(F.lit(1), F.lit(draws)), look)).alias("l")).select(*own, "split", "l.draw", "l.slot")
    met = looks.join(dealt, ["split", "slot"]).where((F.col("other_uri") != F.col("system_uri")) & (F.lower("right") != F.lower("left_name")))
    a, b = folded_trigrams(F.col("left_name")), folded_trigrams(F.col("right"))
    met = met.groupBy(*own, "split", "other_uri", "right").agg(F.min("draw").alias("draw")).withColumn("similarity", F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))
    ranked = met.withColumn("h", F.row_number().over(W.partitionBy(*own).orderBy(F.desc("similarity"), "right", "other_uri"))).withColumn("kind", F.when(F.col("h") <= hard, "hard"))
    rest = ranked.withColumn("r", F.row_number().over(W.partitionBy(*own, F.col("kind").isNull()).orderBy("draw", "right", "other_uri")))
    chosen = rest.where((F.col("kind") == "hard") | (F.col("r") <= random))
    return chosen.select(*own, F.col("right").alias("right_name"), F.lit(0).alias("label"), "split", F.coalesce("kind", F.lit("random")).alias("kind"))


def contract_faults(pairs: DataFrame) -> DataFrame:
    """fault, rows: missing names, labels other than 0 and 1, equal names, entities in several splits, pairs with both labels."""
    f = lambda name, df: df.agg(F.lit(name).alias("fault"), F.count("*").alias("rows"))
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    parts = f("missing_name", pairs.where(blank("left_name") | blank("right_name")))
    parts = parts.union(f("bad_label", pairs.where("label IS NULL OR label NOT IN (0, 1)")))
    parts = parts.union(f("equal_names", pairs.where("left_name = right_name")))
    if "split" in pairs.columns:
        parts = parts.union(f("split_leakage", pairs.groupBy("system_uri").agg(F.countDistinct("split").alias("n")).where("n > 1")))
    return parts.union(f("ambiguous", pairs.groupBy(F.least("left_name", "right_name").alias("a"), F.greatest("left_name", "right_name").alias("b")).agg(F.countDistinct("label").alias("n")).where("n > 1")))


def text_classifier(kind: str = "logistic", *, n: int = 3, features: int = 1 << 14, layers: Sequence[int] = (32,), seed: int = 42):
    """An ML pipeline from a text column over character n-grams with tf-idf: logistic or mlp."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
    from pyspark.ml.feature import IDF, HashingTF, NGram, RegexTokenizer

    head = [
        RegexTokenizer(inputCol="text", outputCol="chars", pattern="", toLowercase=True, minTokenLength=1),
        NGram(n=n, inputCol="chars", outputCol="grams"),
        HashingTF(inputCol="grams", outputCol="tf", numFeatures=features),
        IDF(inputCol="tf", outputCol="features"),
    ]
    if kind == "logistic":
        return Pipeline(stages=[*head, LogisticRegression(maxIter=50, regParam=1e-3)])
    return Pipeline(stages=[*head, MultilayerPerceptronClassifier(layers=[features, *layers, 2], seed=seed, maxIter=50)])


def cross_train(models: dict, train: DataFrame, test: DataFrame, *, threshold: float = 0.5, k: int = 100) -> DataFrame:
    """model and binary metrics of each pipeline (name: pipeline), fitted on train and scored on test (id, text, label)."""
    from pyspark.ml.functions import vector_to_array

    from tessella.operators.evaluate import binary_metrics

    out = None
    for name, pipeline in models.items():
        scored = pipeline.fit(train).transform(test).select("id", F.col("label").cast("int").alias("label"), vector_to_array("probability")[1].alias("score"))
        one = binary_metrics(scored, threshold=threshold, k=k).select(F.lit(name).alias("model"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def training_repeats(build, train: DataFrame, test: DataFrame, *, tolerance: float = 1e-6) -> bool:
    """Whether two fits of build() score every test row alike within tolerance."""
    from pyspark.ml.functions import vector_to_array

    score = lambda name: build().fit(train).transform(test).select("id", vector_to_array("probability")[1].alias(name))
    return score("a").join(score("b"), "id").where(F.abs(F.col("a") - F.col("b")) > tolerance).isEmpty()
