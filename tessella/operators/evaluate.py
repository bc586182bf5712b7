"""Evaluation of edges against truth: populations, details, recall curves, robustness, binary metrics.

truth: source_id, target_id (at most one target a source). edges: source_id, target_id, similarity, rank.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null for b = 0."""
    return F.when(b > 0, a / b)


def labelled(truth: DataFrame) -> DataFrame:
    """Rows with a non-blank target, the smallest target of each source."""
    return truth.where(F.trim(F.col("target_id").cast("string")) != "").groupBy("source_id").agg(F.min("target_id").alias("truth_id"))


def name_equality(source_prefix: str = "s_", target_prefix: str = "t_", forms: Sequence[str] = ("raw", "basic", "cleansed", "preprocessed")) -> Column:
    """The first form in which both names are equal: unknown if a cleansed form is missing (tested first), never if none is."""
    pair = lambda f: (F.col(f"{source_prefix}{f}"), F.col(f"{target_prefix}{f}"))
    s, t = pair("cleansed" if "cleansed" in forms else forms[-1])
    level = F.when(s.isNull() | t.isNull() | (F.trim(s) == "") | (F.trim(t) == ""), "unknown")
    for form in forms:
        a, b = pair(form)
        level = level.when((F.trim(a) != "") & (a == b), form)
    return level.otherwise("never")


def truth_detail(truth: DataFrame, edges: DataFrame) -> DataFrame:
    """One row for each truth pair and each wrong edge of a labelled source: is_truth_pair, found, similarity, rank."""
    known = labelled(truth)
    own = edges.join(known, "source_id")
    good = known.withColumnRenamed("truth_id", "target_id").join(edges, ["source_id", "target_id"], "left").select("source_id", "target_id", F.lit(True).alias("is_truth_pair"), F.col("similarity").isNotNull().alias("found"), "similarity", "rank")
    bad = own.where("target_id <> truth_id").select("source_id", "target_id", F.lit(False).alias("is_truth_pair"), F.lit(True).alias("found"), "similarity", "rank")
    return good.unionByName(bad)


def truth_eval(detail: DataFrame, *, target_rows: int | Column, source_rows: int | Column | None = None, k: int = 10, beta: float = 2.0, by: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn, precision, recall, f_beta, reduction_ratio, candidate_set_size_ratio and recall_at_k of a detail, by group or as one row."""
    pairs = lambda c: c if isinstance(c, Column) else F.lit(c)
    sums = detail.groupBy(*by).agg(
        F.count_if(F.col("is_truth_pair") & F.col("found")).alias("tp"),
        F.count_if(~F.col("is_truth_pair")).alias("fp"),
        F.count_if(F.col("is_truth_pair") & ~F.col("found")).alias("fn"),
        F.count_if(F.col("is_truth_pair") & F.col("found") & (F.col("rank") <= k)).alias("at_k"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    universe = (tp + fn) * pairs(target_rows)
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    out = sums.select(
        *by, "tp", "fp", "fn", p.alias("precision"), r.alias("recall"),
        ratio((1 + beta**2) * p * r, beta**2 * p + r).alias("f_beta"),
        (1 - ratio(tp + fp, universe)).alias("reduction_ratio"),
        ratio(tp + fp, universe).alias("candidate_set_size_ratio"),
        ratio(F.col("at_k"), tp + fn).alias("recall_at_k"),
    )
    return out if source_rows is None else out.withColumn("source_rows", pairs(source_rows))


def rollup(evals: DataFrame, by: str, name: str = "__all__") -> DataFrame:
    """evals (by, tp, fp, fn, target_rows) and one more row over all, with ratios from the sums."""
    sums = evals.groupBy().agg(F.lit(name).alias(by), *(F.sum(c).alias(c) for c in ("tp", "fp", "fn")), F.sum((F.col("tp") + F.col("fn")) * F.col("target_rows")).alias("universe"))
    both = evals.select(by, "tp", "fp", "fn", ((F.col("tp") + F.col("fn")) * F.col("target_rows")).alias("universe")).unionByName(sums)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return both.select(by, "tp", "fp", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), (1 - ratio(tp + fp, F.col("universe"))).alias("reduction_ratio"))


def robustness(truth: DataFrame, edges: DataFrame, groups: DataFrame, *, baseline_recall: float) -> DataFrame:
    """Recall by perturbation group (source_id, perturbation), and its share of the baseline."""
    detail = truth_detail(truth, edges).where("is_truth_pair").join(groups, "source_id")
    recall = detail.groupBy("perturbation").agg(F.count("*").alias("pairs"), F.avg(F.col("found").cast("double")).alias("recall"))
    return recall.withColumn("relative_recall", ratio(F.col("recall"), F.lit(baseline_recall)))


def robustness_rollup(rows: DataFrame) -> DataFrame:
    """Mean and sample deviation of relative recall: one row; the deviation of one group is null."""
    return rows.agg(F.count("*").alias("groups"), F.avg("relative_recall").alias("mean"), F.stddev_samp("relative_recall").alias("std"))


def run_metrics(edges: DataFrame, *, source_rows: int | None = None, seconds: float | None = None) -> DataFrame:
    """edges, distinct_targets, duplication_ratio = 1 - distinct / edges (null without edges), and seconds a 1000 sources."""
    out = edges.agg(F.count("*").alias("edges"), F.countDistinct("target_id").alias("distinct_targets")).withColumn("duplication_ratio", 1 - ratio(F.col("distinct_targets"), F.col("edges")))
    return out.withColumn("seconds_per_1000", F.lit(seconds / source_rows * 1000 if source_rows and seconds is not None else None).cast("double"))


def recall_curve(truth: DataFrame, edges: DataFrame) -> DataFrame:
    """rank, comparisons, found, recall: running sums by rank.

    Edges of similarity 1.0 cost nothing, and truth found by them stands at rank 0. The curve has one row a rank, so its
    window is small.
    """
    known = labelled(truth)
    total = known.agg(F.count("*").alias("total"))
    own = edges.join(known, "source_id").select(F.when(F.col("similarity") == 1.0, 0).otherwise(F.col("rank")).alias("rank"), (F.col("similarity") != 1.0).cast("long").alias("cost"), (F.col("target_id") == F.col("truth_id")).cast("long").alias("hit"))
    steps = own.groupBy("rank").agg(F.sum("cost").alias("cost"), F.sum("hit").alias("hit"))
    upto = W.orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return steps.crossJoin(F.broadcast(total)).select("rank", F.sum("cost").over(upto).alias("comparisons"), F.sum("hit").over(upto).alias("found"), ratio(F.sum("hit").over(upto), F.col("total")).alias("recall"))


def curve_area(curve: DataFrame, budget: int) -> DataFrame:
    """The area of the right-continuous step curve to `budget` comparisons over the budget: one row."""
    order = W.orderBy("comparisons", "rank")
    steps = curve.select("recall", F.least("comparisons", F.lit(budget)).alias("at"), F.least(F.coalesce(F.lead("comparisons").over(order), F.lit(budget)), F.lit(budget)).alias("to"))
    return steps.agg((F.sum(F.col("recall") * F.greatest(F.col("to") - F.col("at"), F.lit(0))) / budget).alias("area"))


def binary_metrics(scored: DataFrame, *, threshold: float = 0.5, k: int = 100) -> DataFrame:
    """precision, recall, f1, pr_auc, precision_at_k, recall_at_k, candidate_ratio of (label 0/1, score, id): one row; empty ratios are 0.

    The precision-recall area is the sum of precision times recall gained over distinct scores, so ties are one step.
    """
    zero = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    steps = scored.groupBy("score").agg(F.count("*").alias("n"), F.sum("label").alias("p"))
    upto = W.orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, 0)
    area = steps.select("p", F.sum("n").over(upto).alias("all_n"), F.sum("p").over(upto).alias("all_p"))
    total = F.sum("p")
    auc = area.agg(zero(F.sum(F.col("p") * F.col("all_p") / F.col("all_n")), total).alias("pr_auc"))
    top = scored.orderBy(F.desc("score"), "id").limit(k).agg(F.sum("label").alias("top_p"), F.count("*").alias("top_n"))
    said = F.col("score") >= threshold
    sums = scored.agg(F.count("*").alias("n"), F.sum("label").alias("pos"), F.count_if(said).alias("said"), F.count_if(said & (F.col("label") == 1)).alias("tp"))
    p, r = zero(F.col("tp"), F.col("said")), zero(F.col("tp"), F.col("pos"))
    return sums.crossJoin(auc).crossJoin(top).select(  # one row each
        p.alias("precision"), r.alias("recall"), zero(2 * p * r, p + r).alias("f1"), "pr_auc", zero(F.col("top_p"), F.col("top_n")).alias("precision_at_k"), zero(F.col("top_p"), F.col("pos")).alias("recall_at_k"), zero(F.col("said"), F.col("n")).alias("candidate_ratio"),
    )
