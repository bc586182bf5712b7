"""Mixing sources to target weights by Poisson replication. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import fresh
from tessella.storage import materialize, small

_DIGITS = 13


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the MD5 of the parts, joined by '|'; a null part counts as empty."""
    text = F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, _DIGITS), 16, 10).cast("long") / F.lit(float(16**_DIGITS))


def poisson_quantile(u: Column, rate: Column) -> Column:
    """The least k with P(X <= k) > u for X ~ Poisson(rate); 0 for rates null or not positive.

    The terms are summed in logarithms, log p(k) = log p(k - 1) + log(rate / k), so that large rates do not underflow.
    The sum runs to rate + 12 * sqrt(rate) + 30, beyond which less than 2**-53 is left.
    """
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.lit(0).alias("k"), (-rate).alias("logp"), F.exp(-rate).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        logp = acc["logp"] + F.log(rate / k)
        more = acc["cdf"] <= u
        return F.struct(F.when(more, k).otherwise(acc["k"]).alias("k"), logp.alias("logp"), (acc["cdf"] + F.exp(logp)).alias("cdf"))

    return F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["k"])).otherwise(F.lit(0))


def mix_sources(docs: DataFrame, weights: dict[str | None, float] | None = None, *, epochs: float = 1.0, seed: int = 42, parts: int | None = None, broadcast_rows: int = 100_000) -> DataFrame:
    """Replicate documents so that sources reach target weights, in a global random order.

    A source's mean repetition rate is weight * epochs * (all characters) / (its own characters): the expected
    output has epochs times the input's characters, dealt among the sources by weight. Each document draws its count
    by inverting the Poisson distribution with that mean at a uniform number hashed from seed and doc_id, so a rerun
    draws the same. Each copy gets a shuffle key hashed from seed, doc_id and copy number; keys are uniform, so the
    output is dealt to `parts` slices of the unit interval (by default spark.sql.shuffle.partitions) without
    sampling, and sorted in each: the rows are in global random order.

    weights: target share by source, scaled to sum to 1; sources not named get 0 and vanish, named sources
    without characters get nothing. None: equal weights for all sources that have characters.

    Nulls and odd input: a null source is a source of its own, named None. Null and empty texts count 0 characters
    and are drawn with their source's rate. A null doc_id is hashed as an empty string; rows that repeat a doc_id draw
    the same count, each for itself. If the table has columns n_copies, copy or shuffle_key, those are replaced. An
    empty table gives an empty result.

    Returns the columns of docs, n_copies (the document's count), copy (from 0), shuffle_key.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_copies", "copy", "shuffle_key")
    name, rate = fresh(docs, "mix_source", "mix_rate")
    chars = F.coalesce(F.length("text"), F.lit(0)).cast("long")
    sizes = docs.groupBy("source").agg(F.sum(chars).alias("chars")).where("chars > 0")
    if weights is not None:
        shares = spark.createDataFrame([(None if s is None else str(s), float(w)) for s, w in weights.items()] or [("", 0.0)], "name string, weight double").where("weight > 0")
        sizes = sizes.join(F.broadcast(shares), sizes["source"].eqNullSafe(shares["name"])).select("source", "chars", "weight")
        total = docs.agg(F.sum(chars).alias("all_chars"))
    else:
        sizes = sizes.withColumn("weight", F.lit(1.0))
        total = sizes.agg(F.sum("chars").alias("all_chars"))
    sums = sizes.agg(F.sum("weight").alias("all_weights"))
    rates = sizes.join(F.broadcast(total.crossJoin(sums))).select(  # one row
        F.col("source").alias(name), (F.col("weight") / F.col("all_weights") * F.lit(float(epochs)) * F.col("all_chars") / F.col("chars")).alias(rate)
    )
    rates = small(materialize(rates, "rates"), broadcast_rows)
    count = poisson_quantile(hashed_uniform(F.lit(seed), F.col("doc_id")), F.col(rate))
    drawn = docs.join(rates, docs["source"].eqNullSafe(F.col(name))).withColumn("n_copies", count).where("n_copies > 0")
    copies = drawn.select(*docs.columns, "n_copies", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
    keyed = copies.withColumn("shuffle_key", hashed_uniform(F.lit(seed), F.col("doc_id"), F.col("copy")))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartitionById(parts, F.least(F.floor(F.col("shuffle_key") * parts), F.lit(parts - 1)).cast("int")).sortWithinPartitions("shuffle_key", "doc_id", "copy")


MIX_SQL = """
WITH sizes AS (SELECT source, sum(coalesce(length(text), 0)) AS chars FROM documents GROUP BY source HAVING sum(coalesce(length(text), 0)) > 0),
rates AS (SELECT source, (1.0::DOUBLE / (SELECT count(*) FROM sizes)::DOUBLE) * 1.0::DOUBLE * (SELECT sum(chars) FROM sizes)::DOUBLE / chars::DOUBLE AS rate FROM sizes),
drawn AS (
  SELECT d.*, r.rate, ('0x' || substr(md5('42|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source),
terms AS (SELECT source, rate, unnest(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT) + 1)) AS k FROM rates),
cdf AS (SELECT source, k, sum(exp(-rate + CASE WHEN k = 0 THEN 0 ELSE k * ln(rate) - lgamma(k + 1) END)) OVER (PARTITION BY source ORDER BY k) AS c FROM terms),
counted AS (SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u) AS n_copies FROM drawn d),
copies AS (SELECT doc_id, text, lang, source, n_chars, CAST(n_copies AS INTEGER) AS n_copies, CAST(unnest(range(0, n_copies)) AS INTEGER) AS copy FROM counted WHERE n_copies > 0)
SELECT *, ('0x' || substr(md5('42|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(copy AS VARCHAR)), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS shuffle_key FROM copies
"""
