"""Comparison of runs: outcomes, agreement, repeatability, audits, layers and vocabularies."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.operators.evaluate import ratio


def strategy_comparison(runs: dict[str, DataFrame], population: str = "population_key") -> DataFrame:
    """One-row summaries by run; refuses runs over different populations."""
    keys = {str(r[0]) for df in runs.values() for r in df.select(population).distinct().limit(2).collect()}
    if len(keys) > 1:
        raise ValueError(f"runs over different populations: {sorted(keys)}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("run", F.lit(name)) for name, df in runs.items()))


def runtime_scaling(runs: DataFrame) -> DataFrame:
    """least, median and greatest seconds by power of ten of rows (rows, seconds)."""
    return runs.where("rows > 0").groupBy(F.floor(F.log10("rows")).cast("int").alias("decade")).agg(F.count("*").alias("runs"), F.min("seconds").alias("min_s"), F.median("seconds").alias("median_s"), F.max("seconds").alias("max_s"))


def repeatability(first: DataFrame, second: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows of a full join on null-safe keys that differ: side and the names of differing columns. Both null is equal."""
    a = first.select(*[F.col(c).alias(f"a_{c}") for c in (*key, *columns)], F.lit(True).alias("in_a"))
    b = second.select(*[F.col(c).alias(f"b_{c}") for c in (*key, *columns)], F.lit(True).alias("in_b"))
    on = reduce(lambda x, y: x & y, (F.col(f"a_{k}").eqNullSafe(F.col(f"b_{k}")) for k in key))
    side = F.when(F.col("in_b").isNull(), "first_only").when(F.col("in_a").isNull(), "second_only").otherwise("both")
    differ = F.filter(F.array(*(F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in columns)), lambda c: c.isNotNull())
    rows = a.join(b, on, "full").select(*(F.coalesce(f"a_{k}", f"b_{k}").alias(k) for k in key), side.alias("side"), F.array_join(differ, ",").alias("differs"))
    return rows.where("side <> 'both' OR differs <> ''")


def recovered_pairs(base: DataFrame, variant: DataFrame) -> DataFrame:
    """Truth pairs that the base detail misses and the variant finds."""
    truth = lambda df: df.where("is_truth_pair").select("source_id", "target_id", "found")
    return truth(base).where("NOT found").select("source_id", "target_id").join(truth(variant).where("found").select("source_id", "target_id"), ["source_id", "target_id"])


def level_transitions(base: DataFrame, variant: DataFrame) -> DataFrame:
    """from_level, to_level, pairs of pairs whose name_equality changed; null is a level."""
    pair = ["source_id", "target_id"]
    both = base.select(*pair, F.col("name_equality").alias("from_level")).join(variant.select(*pair, F.col("name_equality").alias("to_level")), pair)
    return both.where(~F.col("from_level").eqNullSafe(F.col("to_level"))).groupBy("from_level", "to_level").agg(F.count("*").alias("pairs"))


def outcome_matrix(detail: DataFrame, by: str) -> DataFrame:
    """by, then numbers of truth pairs found and missed and of wrong pairs."""
    kind = F.when(~F.col("is_truth_pair"), "false_positive").when(F.col("found"), "found").otherwise("missed")
    return detail.withColumn("kind", kind).groupBy(by).pivot("kind", ["found", "missed", "false_positive"]).agg(F.count(F.lit(1))).na.fill(0, ["found", "missed", "false_positive"])


def melt_metrics(row: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, metric, value of every other column as double."""
    rest = [c for c in row.columns if c not in keys]
    return row.select(*keys, *(F.col(c).cast("double").alias(c) for c in rest)).unpivot(list(keys), rest, "metric", "value")


def size_distribution(members: DataFrame) -> DataFrame:
    """size, clusters."""
    return members.groupBy("cluster_id").agg(F.countDistinct("node_id").alias("size")).groupBy("size").agg(F.count("*").alias("clusters"))


def pair_audit(truth: DataFrame, backend: DataFrame, exact: DataFrame) -> DataFrame:
    """source_id, target_id, verdict of truth pairs by what the backend and an exact scan kept: found, backend_only, lost_to_backend, not_kept_by_exact_scan."""
    pair = ["source_id", "target_id"]
    flag = lambda df, name: df.select(pair).distinct().withColumn(name, F.lit(True))
    rows = truth.select(pair).join(flag(backend, "b"), pair, "left").join(flag(exact, "e"), pair, "left")
    b, e = F.coalesce("b", F.lit(False)), F.coalesce("e", F.lit(False))
    return rows.select(*pair, F.when(b & e, "found").when(b, "backend_only").when(e, "lost_to_backend").otherwise("not_kept_by_exact_scan").alias("verdict"))


def found_matrix(outcomes: DataFrame, runs: Sequence[str], *, min_similarity: float = 0.0, max_rank: int | None = None) -> DataFrame:
    """source_id, target_id and one boolean column a run: found with at least min_similarity and at most max_rank."""
    ok = F.col("found") & (F.col("similarity") >= min_similarity)
    ok = ok if max_rank is None else ok & (F.col("rank") <= max_rank)
    found = outcomes.groupBy("source_id", "target_id").pivot("run", list(runs)).agg(F.max(F.coalesce(ok, F.lit(False)).cast("int")))
    return found.select("source_id", "target_id", *(F.coalesce(F.col(f"`{r}`") == 1, F.lit(False)).alias(r) for r in runs))


def found_by_k(matrix: DataFrame, runs: Sequence[str]) -> DataFrame:
    """k, pairs: how many pairs exactly k runs find."""
    return matrix.select(reduce(lambda a, b: a + b, (F.col(f"`{r}`").cast("int") for r in runs)).alias("k")).groupBy("k").agg(F.count("*").alias("pairs"))


def run_overlap(matrix: DataFrame, runs: Sequence[str]) -> DataFrame:
    """first, second, both, jaccard, containment (of the first in the second), for ordered pairs of runs; one pass."""
    pairs = [(a, b) for a in runs for b in runs if a != b]
    c = lambda r: F.col(f"`{r}`")
    sums = matrix.agg(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.count_if(c(a) & c(b)).alias("both"), F.count_if(c(a) | c(b)).alias("either"), F.count_if(c(a)).alias("n")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)))
    rows = sums.select(F.explode(F.array(*(F.col(f"p{k}") for k in range(len(pairs))))).alias("p")).select("p.*")
    return rows.select("first", "second", "both", ratio(F.col("both"), F.col("either")).alias("jaccard"), ratio(F.col("both"), F.col("n")).alias("containment"))


def budget_cutoff(edges: DataFrame, budget: int, steps: int = 1000) -> DataFrame:
    """The lowest similarity, in thousandths, at which no more than budget candidates remain: one row, null if none does."""
    cells = edges.groupBy((F.floor(F.col("similarity") * steps) / steps).alias("cutoff")).agg(F.count("*").alias("n"))
    upto = F.sum("n").over(W.orderBy(F.desc("cutoff")).rowsBetween(W.unboundedPreceding, 0))
    return cells.select("cutoff", upto.alias("candidates")).where(F.col("candidates") <= budget).agg(F.min("cutoff").alias("cutoff"), F.max("candidates").alias("candidates"))


def match_breakdown(matched: DataFrame, columns: Sequence[str]) -> DataFrame:
    """column, equal, rows, share: equality of source and target columns (s_x, t_x) over matched rows."""
    states = [F.struct(F.lit(c).alias("column"), (F.col(f"s_{c}") == F.col(f"t_{c}")).alias("equal")) for c in columns]
    rows = matched.select(F.explode(F.array(*states)).alias("s")).select("s.column", F.coalesce("s.equal", F.lit(False)).alias("equal")).groupBy("column", "equal").agg(F.count("*").alias("rows"))
    return rows.withColumn("share", F.col("rows") / F.sum("rows").over(W.partitionBy("column")))


def recoverability(unmatched: DataFrame, target: DataFrame, forms: Sequence[str]) -> DataFrame:
    """form, recoverable: unmatched sources whose name in that form a target has."""
    parts = [unmatched.join(target.select(f).distinct(), f, "left_semi").agg(F.lit(f).alias("form"), F.count("*").alias("recoverable")) for f in forms]
    return reduce(DataFrame.union, parts)


def examples(df: DataFrame, by: str, order: Sequence[str], most: int = 30) -> DataFrame:
    """At most `most` rows of each group."""
    return df.withColumn("n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("n") <= most).drop("n")


def layer_removals(tiers: DataFrame) -> DataFrame:
    """layer, system, removed, mass: tokens (system, tier number, tier, token, document_frequency) that a tier no longer has and the one before has."""
    now = tiers.select("system", "tier_no", "token").withColumn("kept", F.lit(True))
    before = tiers.select("system", (F.col("tier_no") + 1).alias("tier_no"), "token", "document_frequency")
    names = tiers.select("system", "tier_no", F.col("tier").alias("layer")).distinct()
    gone = before.join(now, ["system", "tier_no", "token"], "left_anti").join(names, ["system", "tier_no"])
    return gone.groupBy("system", "layer").agg(F.count("*").alias("removed"), F.sum("document_frequency").alias("mass"))


def layer_regions(membership: DataFrame) -> DataFrame:
    """region ('+'-joined systems), tokens, of distinct (system, token) rows."""
    sets = membership.groupBy("token").agg(F.array_join(F.sort_array(F.collect_set("system")), "+").alias("region"))
    return sets.groupBy("region").agg(F.count("*").alias("tokens"))


def pairwise_jaccard(membership: DataFrame) -> DataFrame:
    """left, right, both, jaccard for pairs of systems of distinct (system, token) rows."""
    rows = membership.select("system", "token").distinct()
    sizes = rows.groupBy("system").agg(F.count("*").alias("n"))
    pairs = sizes.select(F.col("system").alias("left"), F.col("n").alias("n1")).join(sizes.select(F.col("system").alias("right"), F.col("n").alias("n2")), F.col("left") < F.col("right"))
    both = rows.select(F.col("system").alias("left"), "token").join(rows.select(F.col("system").alias("right"), "token"), "token").where("left < right").groupBy("left", "right").agg(F.count("*").alias("both"))
    joined = pairs.join(both, ["left", "right"], "left").withColumn("both", F.coalesce("both", F.lit(0)))
    return joined.select("left", "right", "both", ratio(F.col("both"), F.col("n1") + F.col("n2") - F.col("both")).alias("jaccard"))


def dropped_mass(stats: DataFrame, budgets: Sequence[int], *, weight: str = "count") -> DataFrame:
    """system, budget, dropped_mass: the share of a system's own top-v document frequencies that the pooled top-v lacks.

    stats: system, token, document_frequency, document_frequency_pct. Vocabulary tables: the pooled ranking is one window.
    """
    pooled = stats.groupBy("token").agg((F.sum("document_frequency") if weight == "count" else F.sum("document_frequency_pct")).alias("w"))
    pooled = pooled.select("token", F.row_number().over(W.orderBy(F.desc("w"), "token")).alias("pooled_rank"))
    own = stats.withColumn("own_rank", F.row_number().over(W.partitionBy("system").orderBy(F.desc("document_frequency"), "token"))).join(pooled, "token")
    rows = own.withColumn("budget", F.explode(F.array(*map(F.lit, budgets)))).where("own_rank <= budget")
    lost = F.sum(F.when(F.col("pooled_rank") > F.col("budget"), F.col("document_frequency")).otherwise(0))
    return rows.groupBy("system", "budget").agg(ratio(lost, F.sum("document_frequency")).alias("dropped_mass"))


def residuals(pairs: DataFrame) -> DataFrame:
    """Pairs (source_name, target_name) with token Jaccard (null if both are empty), Levenshtein and length difference."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda t: t != ""))
    a, b = words(F.col("source_name")), words(F.col("target_name"))
    either = F.size(F.array_union(a, b))
    return pairs.withColumn("token_jaccard", F.when(either > 0, F.size(F.array_intersect(a, b)) / either)).withColumn("levenshtein", F.levenshtein("source_name", "target_name")).withColumn("length_difference", F.abs(F.length("source_name") - F.length("target_name")))


def promotion(metrics: DataFrame, metric: str, threshold: float, *, higher_is_better: bool = True) -> DataFrame:
    """metrics with verdict promote, keep or missing."""
    c = F.col(metric)
    good = c >= threshold if higher_is_better else c <= threshold
    return metrics.withColumn("verdict", F.when(c.isNull(), "missing").when(good, "promote").otherwise("keep"))


def missing_cells(expected: DataFrame, present: DataFrame, key: Sequence[str]) -> DataFrame:
    return expected.join(present.select(*key).distinct(), list(key), "left_anti")
