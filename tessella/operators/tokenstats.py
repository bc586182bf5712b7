"""Token statistics: document frequencies, idf, pooling, noise words, Zipf and word probabilities."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import tokens


def idf(n: Column, df: Column, smooth: bool = True) -> Column:
    """ln((1 + n) / (1 + df)) + 1, or ln(n / df) + 1; df is clamped to 1..n, and without documents it is 0."""
    clamped = F.least(F.greatest(df, F.lit(1)), n)
    value = F.log((1 + n) / (1 + clamped)) + 1 if smooth else F.log(n / clamped) + 1
    return F.when(n > 0, value).otherwise(F.lit(0.0))


def df_from_idf(n: Column, value: Column, smooth: bool = True) -> Column:
    """The document frequency an idf came from."""
    raw = (1 + n) / F.exp(value - 1) - 1 if smooth else n / F.exp(value - 1)
    return F.greatest(F.lit(1), F.least(n, F.round(raw))).cast("long")


def token_stats(df: DataFrame, token_col: str, by: Sequence[str] = (), *, smooth: bool = True) -> DataFrame:
    """token, document_frequency, document_frequency_pct, idf over array column token_col, for each group of `by`.

    Distinct tokens of a row are counted before any shuffle; group sizes are a second small aggregate, broadcast only by
    the optimizer's own estimate.
    """
    by = list(by)
    counted = df.select(*by, F.explode(F.array_distinct(token_col)).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("document_frequency"))
    sizes = df.groupBy(*by).agg(F.count("*").alias("n_docs"))
    joined = counted.join(sizes, by) if by else counted.crossJoin(F.broadcast(sizes))  # one row
    return joined.select(*by, "token", "document_frequency", (F.col("document_frequency") / F.col("n_docs")).alias("document_frequency_pct"), idf(F.col("n_docs"), F.col("document_frequency"), smooth).alias("idf"), "n_docs")


def pool_stats(stats: DataFrame, system_col: str, *, pooling: str = "count", smooth: bool = True) -> DataFrame:
    """One table from statistics by system: sums ('count'), or the mean share with absent tokens as 0 ('equal')."""
    sizes = stats.groupBy(system_col).agg(F.max("n_docs").alias("n")).agg(F.count("*").alias("systems"), F.sum("n").alias("total"), F.avg("n").alias("mean"))
    sums = stats.groupBy("token").agg(F.sum("document_frequency").alias("df_sum"), F.sum("document_frequency_pct").alias("pct_sum")).crossJoin(F.broadcast(sizes))  # one row
    if pooling == "count":
        n, df = F.col("total"), F.col("df_sum")
        pct = df / n
    else:
        n = F.greatest(F.round("mean"), F.lit(1)).cast("long")
        pct = F.col("pct_sum") / F.col("systems")
        df = F.round(pct * n).cast("long")
    return sums.select("token", df.alias("document_frequency"), pct.alias("document_frequency_pct"), idf(n, df, smooth).alias("idf"))


def mass_cutoff(stats: DataFrame, limit: float) -> DataFrame:
    """The smallest rank (by share, then token) whose running share reaches limit: one row, cutoff; all tokens if none does, 0 for a limit of 0 or less.

    Ranks come from a window over all tokens, so this is for vocabularies, not corpora.
    """
    order = W.orderBy(F.desc("document_frequency_pct"), "token")
    ranked = stats.select(F.row_number().over(order).alias("rank"), F.sum("document_frequency_pct").over(order.rowsBetween(W.unboundedPreceding, 0)).alias("mass"))
    if limit <= 0:
        return ranked.agg(F.lit(0).cast("long").alias("cutoff"))
    return ranked.agg(F.coalesce(F.min(F.when(F.col("mass") >= limit, F.col("rank"))), F.count("*")).cast("long").alias("cutoff"))


def stopwords(stats: DataFrame, *, least_pct: float = 0.01, most_idf: float = 6.0, least_length: int = 2) -> DataFrame:
    return stats.where((F.col("document_frequency_pct") >= least_pct) & (F.col("idf") <= most_idf) & (F.length("token") >= least_length))


def rare_tokens(stats: DataFrame, *, most_df: int | None = 1, most_pct: float | None = None, least_length: int = 2) -> DataFrame:
    """Tokens at or below every given bound; by default those of one document."""
    out = stats.where(F.length("token") >= least_length)
    out = out if most_df is None else out.where(F.col("document_frequency") <= most_df)
    return out if most_pct is None else out.where(F.col("document_frequency_pct") <= most_pct)


def noise_candidates(stats: DataFrame, *, most: int = 200, least_length: int = 2) -> DataFrame:
    """The `most` tokens of least idf, ties by token."""
    return stats.where(F.length("token") >= least_length).orderBy("idf", "token").limit(most)


def noise_profiles(stats: DataFrame, *, masses=(0.2, 0.35, 0.5), counts=(10, 25, 50), least_pct=(0.02, 0.01, 0.005), most_idf=(5.0, 6.0, 7.0), least_length: int = 2, floor_pct: float = 0.001, ceiling_idf: float = 9.0) -> DataFrame:
    """token, profile (strict, balanced, aggressive), rank.

    Tokens within the global bounds are ranked by share, idf and token. For each profile in turn, tokens not yet taken that pass its bounds are
    taken while the running share is below its mass; if that gives fewer than its count, the best ranked rest fills
    up. The ranking is a vocabulary table of bounded noise size, so the three steps are windows over it.
    """
    ranked = stats.where((F.col("document_frequency_pct") >= floor_pct) & (F.col("idf") <= ceiling_idf) & (F.length("token") >= least_length))
    ranked = ranked.withColumn("rank", F.row_number().over(W.orderBy(F.desc("document_frequency_pct"), "idf", "token"))).withColumn("profile", F.lit(None).cast("string"))
    order = W.orderBy("rank")
    for name, mass, count, pct, high in zip(("strict", "balanced", "aggressive"), masses, counts, least_pct, most_idf, strict=True):
        fits = F.col("profile").isNull() & (F.col("document_frequency_pct") >= pct) & (F.col("idf") <= high)
        share = F.sum(F.when(fits, F.col("document_frequency_pct")).otherwise(0.0)).over(order.rowsBetween(W.unboundedPreceding, 0))
        ranked = ranked.withColumn("first", fits & (share - F.col("document_frequency_pct") < mass))
        ranked = ranked.withColumn("n_first", F.count_if("first").over(W.partitionBy()))
        free = F.col("profile").isNull() & ~F.col("first")
        ranked = ranked.withColumn("fill", free & (F.count_if(free).over(order.rowsBetween(W.unboundedPreceding, 0)) <= count - F.col("n_first")))
        ranked = ranked.withColumn("profile", F.when(F.col("first") | F.col("fill"), name).otherwise(F.col("profile"))).drop("first", "n_first", "fill")
    return ranked.where("profile IS NOT NULL").select("token", "profile", "rank")


def trim_noise(token_col: Column, noise: Sequence[str]) -> Column:
    """A token array without noise words, whatever their case."""
    words = F.array(*(F.lit(w.lower()) for w in noise)) if noise else F.array().cast("array<string>")
    return F.filter(token_col, lambda t: ~F.array_contains(words, F.lower(t)))


def term_metrics(df: DataFrame, system_col: str, token_col: str) -> DataFrame:
    """By system and upper-cased token: tf, df, their shares, ratio and lift to the whole, analyst tf-idf."""
    rows = df.select(system_col, F.transform(token_col, lambda t: F.upper(F.trim(t))).alias("t"))
    rows = rows.select(system_col, F.filter("t", lambda t: t != "").alias("t"))
    each = rows.select(system_col, F.explode("t").alias("token")).groupBy(system_col, "token").agg(F.count("*").alias("tf"))
    docs = rows.select(system_col, F.explode(F.array_distinct("t")).alias("token")).groupBy(system_col, "token").agg(F.count("*").alias("df"))
    own = each.join(docs, [system_col, "token"])
    totals = own.groupBy(system_col).agg(F.sum("tf").alias("tf_all")).join(rows.groupBy(system_col).agg(F.count("*").alias("n")), system_col)
    whole = own.groupBy("token").agg(F.sum("tf").alias("global_tf"), F.sum("df").alias("global_df"))
    sums = totals.agg(F.sum("tf_all").alias("global_tf_all"), F.sum("n").alias("global_n"))
    joined = own.join(totals, system_col).join(whole, "token").crossJoin(F.broadcast(sums))  # one row
    tf_pct, df_pct = F.col("tf") / F.col("tf_all"), F.col("df") / F.col("n")
    return joined.select(
        system_col, "token", "tf", "df", tf_pct.alias("tf_pct"), df_pct.alias("df_pct"),
        (F.col("df") / F.col("global_df")).alias("coverage_ratio"),
        (df_pct / (F.col("global_df") / F.col("global_n"))).alias("lift"),
        (F.col("tf") * (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1)).alias("tfidf"),
    )


def stoplist(metrics: DataFrame, *, legal_forms: Sequence[str] = (), noise: Sequence[str] = (), least_coverage: float = 0.5, least_df_pct: float = 0.05) -> DataFrame:
    """Frequent tokens of metrics with a type: legal_form, noise_word or other."""
    kind = F.when(F.col("token").isin([x.upper() for x in legal_forms]), "legal_form").when(F.col("token").isin([x.upper() for x in noise]), "noise_word").otherwise("other")
    return metrics.where((F.col("coverage_ratio") >= least_coverage) & (F.col("df_pct") >= least_df_pct)).withColumn("token_type", kind)


def zipf_slope(stats: DataFrame) -> DataFrame:
    """Least-squares slope of ln frequency on ln rank, ranks by frequency then token; one row."""
    ranked = stats.select("document_frequency", F.row_number().over(W.orderBy(F.desc("document_frequency"), "token")).alias("rank"))
    return ranked.agg(F.regr_slope(F.log("document_frequency"), F.log("rank")).alias("slope"), F.count("*").alias("tokens"))


def word_probabilities(df: DataFrame, token_col: str) -> DataFrame:
    """token, document_frequency, probability = df / (rows * mean tokens a row)."""
    sizes = df.agg(F.count("*").alias("n"), F.avg(F.size(token_col)).alias("mean"))
    counted = df.select(F.explode(F.array_distinct(token_col)).alias("token")).groupBy("token").agg(F.count("*").alias("document_frequency"))
    return counted.crossJoin(F.broadcast(sizes)).select("token", "document_frequency", F.when(F.col("n") * F.col("mean") > 0, F.col("document_frequency") / (F.col("n") * F.col("mean"))).alias("probability"))


def name_incidence(df: DataFrame, token_col: str, stats: DataFrame) -> DataFrame:
    """Share of rows with a hapax (a token of one document): one row."""
    hapax = stats.where("document_frequency = 1").select("token")
    marked = df.withColumn("row", F.monotonically_increasing_id()).select("row", F.explode_outer(F.array_distinct(token_col)).alias("token")).join(hapax.withColumn("hapax", F.lit(True)), "token", "left")
    return marked.groupBy("row").agg(F.coalesce(F.bool_or("hapax"), F.lit(False)).alias("touched")).agg(F.count("*").alias("rows"), F.avg(F.col("touched").cast("double")).alias("hapax_share"))


def language_frequency(stats: DataFrame, reference: DataFrame) -> DataFrame:
    """stats with zipf of a reference table (word, zipf); null for words it doesn't know."""
    return stats.join(reference.select(F.lower("word").alias("w"), "zipf"), F.lower("token") == F.col("w"), "left").drop("w")


def rarity_summary(joined: DataFrame) -> DataFrame:
    """Of tokens with language frequencies: their number, the share unseen, the mean zipf of the seen; one row."""
    return joined.agg(F.count("*").alias("tokens"), F.avg(F.col("zipf").isNull().cast("double")).alias("unseen_share"), F.avg("zipf").alias("mean_zipf"))


def last_token_ranks(df: DataFrame, by: str, text_col: str, top: int = 10) -> DataFrame:
    """by, last_token, rows, rank: last words of texts, dense-ranked by count within `by`."""
    counted = df.select(by, F.regexp_extract(F.trim(text_col), r"(\S+)$", 1).alias("last_token")).where("last_token <> ''").groupBy(by, "last_token").agg(F.count("*").alias("rows"))
    return counted.withColumn("rank", F.dense_rank().over(W.partitionBy(by).orderBy(F.desc("rows")))).where(F.col("rank") <= top)


def fertility(df: DataFrame, text_col: str, token_col: str, unknown: str = "[UNK]", by: Sequence[str] = ()) -> DataFrame:
    """Tokenizer figures over non-empty texts: mean tokens a word, unknown rate, one-character share, mean, median and p95 (ceiling rank) of token counts."""
    rows = df.where(F.trim(text_col) != "").select(*by, F.size(token_col).alias("n"), F.greatest(F.size(tokens(F.col(text_col))), F.lit(1)).alias("w"), F.size(F.filter(token_col, lambda t: t == unknown)).alias("u"), F.size(F.filter(token_col, lambda t: F.length(t) == 1)).alias("c"))
    return rows.groupBy(*by).agg(
        F.count("*").alias("rows"), F.avg(F.col("n") / F.col("w")).alias("fertility"), (F.sum("u") / F.sum("n")).alias("unk_rate"), (F.sum("c") / F.sum("n")).alias("single_char_share"),
        F.avg("n").alias("mean_tokens"), F.median("n").alias("median_tokens"), F.percentile_approx("n", 0.95, 1_000_000).alias("p95_tokens"),
    )


def power_law_fit(frequencies: Sequence[int], *, skip_top: int = 0, least: int | None = None) -> dict[str, float]:
    """A discrete power law fitted to document frequencies, and how it compares with a log-normal, on the driver over distinct values.

    xmin is the value (or `least`) whose fit above it has the smallest Kolmogorov-Smirnov distance, alpha = 1 + n / sum(ln(x / (xmin - 1/2))).
    The log-normal is fitted by likelihood to the same range, cut off below. loglikelihood_ratio is Vuong's normalised statistic, above 0 for the
    power law; p_value is its two-sided significance. Fewer than two distinct values: zeros, and a p_value of 1.
    """
    values = np.sort(np.asarray(frequencies, float))[::-1][skip_top:]
    x, n = np.unique(values[values > 0], return_counts=True)
    none = {"n_tokens": float(len(values)), "n_fitted": 0.0, "alpha": 0.0, "xmin": 0.0, "ks_statistic": 0.0, "loglikelihood_ratio": 0.0, "mean_loglikelihood_diff": 0.0, "p_value": 1.0}
    if len(x) < 2:
        return none

    def power(k: int) -> tuple[float, float]:
        above, count = x[k:], n[k:]
        cut = x[k] - 0.5
        alpha = 1 + count.sum() / (count * np.log(above / cut)).sum()
        fitted = 1 - ((above + 0.5) / cut) ** (1 - alpha)
        return float(np.abs(fitted - np.cumsum(count) / count.sum()).max()), float(alpha)

    if least is not None:
        k = min(int(np.searchsorted(x, least)), len(x) - 2)
    else:
        k = min(range(len(x) - 1), key=lambda k: power(k)[0])
    distance, alpha = power(k)
    above, count, cut = x[k:], n[k:], x[k] - 0.5
    logs, total = np.log(above), count.sum()
    law = math.log(alpha - 1) + (alpha - 1) * math.log(cut) - alpha * logs

    def normal(mean: float, sigma: float) -> np.ndarray:
        tail = max(0.5 * math.erfc((math.log(cut) - mean) / (sigma * math.sqrt(2))), 1e-300)
        return -logs - math.log(sigma * math.sqrt(2 * math.pi)) - (logs - mean) ** 2 / (2 * sigma**2) - math.log(tail)

    middle = float((count * logs).sum() / total)
    spread = max(float(np.sqrt((count * (logs - middle) ** 2).sum() / total)), 1e-3)
    best, reach = (middle, spread), (4 * spread, math.log(4))
    for _ in range(12):
        grid = [(m, s) for m in np.linspace(best[0] - reach[0], best[0] + reach[0], 9) for s in best[1] * np.exp(np.linspace(-reach[1], reach[1], 9))]
        best = max(grid, key=lambda g: float((count * normal(*g)).sum()))
        reach = (reach[0] / 2, reach[1] / 2)
    differ = law - normal(*best)
    mean = float((count * differ).sum() / total)
    deviation = math.sqrt(float((count * (differ - mean) ** 2).sum() / total))
    ratio = mean * math.sqrt(total) / deviation if deviation else 0.0
    return none | {"n_fitted": float(total), "alpha": alpha, "xmin": float(x[k]), "ks_statistic": distance, "loglikelihood_ratio": ratio, "mean_loglikelihood_diff": mean, "p_value": math.erfc(abs(ratio) / math.sqrt(2))}
