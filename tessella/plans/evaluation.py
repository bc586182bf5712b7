"""Queries over truth evaluation, recall curves, run comparison and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as t
from tessella.operators import analysis, compare, evaluate, pairs
from tessella.plans.candidates import CASCADE, DENSE, cascade, dense, dense_topk
from tessella.registry import query, table

# A vector's truth is the nearest other vector of its label, by squared distance of ids' order: the next greater id of the same label.
TRUTH = "tr AS (SELECT vec_id AS source_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS truth_id FROM embeddings QUALIFY truth_id IS NOT NULL)"
EDGES = f"{DENSE}, f AS (SELECT source_id, target_id, round(similarity, 6) AS similarity, rank::INTEGER AS rank FROM e WHERE rank <= 10), {TRUTH}"
DETAIL = f"""{EDGES}, dt AS (SELECT tr.source_id, truth_id AS target_id, true AS is_truth_pair, f.similarity IS NOT NULL AS found, f.similarity, f.rank FROM tr LEFT JOIN f ON f.source_id = tr.source_id AND f.target_id = truth_id
UNION ALL SELECT f.source_id, f.target_id, false, true, f.similarity, f.rank FROM f JOIN tr USING (source_id) WHERE f.target_id <> truth_id)"""


def truth(spark, sf_dir) -> DataFrame:
    from pyspark.sql import Window as W

    nxt = F.lead("vec_id").over(W.partitionBy("label").orderBy("vec_id"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_id"), nxt.alias("target_id")).where("target_id IS NOT NULL")


def detail(spark, sf_dir) -> DataFrame:
    return evaluate.truth_detail(truth(spark, sf_dir), dense_topk(spark, sf_dir))


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query(f"WITH {DETAIL} SELECT * FROM dt")
def truth_detail(spark, sf_dir):
    return detail(spark, sf_dir)


@query(f"""WITH {DETAIL}, s AS (SELECT count(*) FILTER (WHERE is_truth_pair AND found) AS tp, count(*) FILTER (WHERE NOT is_truth_pair) AS fp, count(*) FILTER (WHERE is_truth_pair AND NOT found) AS fn, count(*) FILTER (WHERE is_truth_pair AND found AND rank <= 5) AS k FROM dt),
z AS (SELECT count(*) AS n FROM embeddings), r AS (SELECT *, tp / (tp + fp) AS p, tp / (tp + fn) AS r FROM s, z)
SELECT tp, fp, fn, round(p, 6) AS "precision", round(r, 6) AS recall, round(5 * p * r / (4 * p + r), 6) AS f_beta, round(1 - (tp + fp) / ((tp + fn) * n), 6) AS reduction_ratio, round((tp + fp) / ((tp + fn) * n), 6) AS candidate_set_size_ratio, round(k / (tp + fn), 6) AS recall_at_k FROM r""")
def truth_eval(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").count()
    return r6(evaluate.truth_eval(detail(spark, sf_dir), target_rows=n, k=5), "precision", "recall", "f_beta", "reduction_ratio", "candidate_set_size_ratio", "recall_at_k")


@query(f"""WITH {DETAIL}, s AS (SELECT label::VARCHAR AS label, count(*) FILTER (WHERE is_truth_pair AND found) AS tp, count(*) FILTER (WHERE NOT is_truth_pair) AS fp, count(*) FILTER (WHERE is_truth_pair AND NOT found) AS fn FROM dt JOIN embeddings ON vec_id = source_id GROUP BY 1),
z AS (SELECT label::VARCHAR AS label, count(*) AS n FROM embeddings GROUP BY 1), u AS (SELECT label, tp, fp, fn, (tp + fn) * n AS un FROM s JOIN z USING (label)), a AS (SELECT * FROM u UNION ALL SELECT '__all__', sum(tp), sum(fp), sum(fn), sum(un) FROM u)
SELECT label, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, round(tp / (tp + fp), 6) AS "precision", round(tp / (tp + fn), 6) AS recall, round(1 - (tp + fp) / un, 6) AS reduction_ratio FROM a""")
def truth_rollup(spark, sf_dir):
    """Evaluation by label, each against its own vectors, and over all."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_id"), F.col("label").cast("string").alias("label"))
    by = detail(spark, sf_dir).join(e, "source_id").groupBy("label").agg(F.count_if(F.col("is_truth_pair") & F.col("found")).alias("tp"), F.count_if(~F.col("is_truth_pair")).alias("fp"), F.count_if(F.col("is_truth_pair") & ~F.col("found")).alias("fn"))
    sizes = e.groupBy("label").agg(F.count("*").alias("target_rows"))
    return r6(evaluate.rollup(by.join(sizes, "label"), "label"), "precision", "recall", "reduction_ratio")


CURVE = f"""{EDGES}, o AS (SELECT CASE WHEN similarity = 1.0 THEN 0 ELSE rank END AS rank, (similarity <> 1.0)::INTEGER AS cost, (target_id = truth_id)::INTEGER AS hit FROM f JOIN tr USING (source_id)),
g AS (SELECT rank, sum(cost) AS cost, sum(hit) AS hit FROM o GROUP BY 1),
c AS (SELECT rank, sum(cost) OVER (ORDER BY rank)::BIGINT AS comparisons, sum(hit) OVER (ORDER BY rank)::BIGINT AS found, sum(hit) OVER (ORDER BY rank) / (SELECT count(*) FROM tr) AS recall FROM g)"""


@query(f"WITH {CURVE} SELECT rank, comparisons, found, round(recall, 6) AS recall FROM c")
def recall_curve(spark, sf_dir):
    return r6(evaluate.recall_curve(truth(spark, sf_dir), dense_topk(spark, sf_dir)), "recall")


@query(f"""WITH {CURVE}, l AS (SELECT recall, least(comparisons, 3000) AS a, least(coalesce(lead(comparisons) OVER (ORDER BY comparisons, rank), 3000), 3000) AS b FROM c) SELECT round(sum(recall * greatest(b - a, 0)) / 3000, 6) AS area FROM l""")
def recall_curve_area(spark, sf_dir):
    return r6(evaluate.curve_area(evaluate.recall_curve(truth(spark, sf_dir), dense_topk(spark, sf_dir)), 3000), "area")


@query(f"""WITH {DETAIL}, g AS (SELECT 'label' || label AS perturbation, count(*) AS pairs, avg(found::INTEGER) AS recall FROM dt JOIN embeddings ON vec_id = source_id WHERE is_truth_pair GROUP BY 1) SELECT perturbation, pairs, round(recall, 6) AS recall, round(recall / 0.5, 6) AS relative_recall FROM g""")
def robustness(spark, sf_dir):
    groups = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_id"), F.concat(F.lit("label"), F.col("label")).alias("perturbation"))
    return r6(evaluate.robustness(truth(spark, sf_dir), dense_topk(spark, sf_dir), groups, baseline_recall=0.5), "recall", "relative_recall")


@query(f"WITH {EDGES} SELECT count(*) AS edges, count(DISTINCT target_id) AS distinct_targets, round(1 - count(DISTINCT target_id) / count(*), 6) AS duplication_ratio FROM f")
def run_metrics(spark, sf_dir):
    return r6(evaluate.run_metrics(dense_topk(spark, sf_dir)), "duplication_ratio").drop("seconds_per_1000")


@query("""WITH s AS (SELECT doc_id AS id, toxic AS label, round(1.0 / (1 + len(text)), 9) AS score FROM labels JOIN documents USING (doc_id)), g AS (SELECT score, count(*) AS n, sum(label) AS p FROM s GROUP BY 1),
a AS (SELECT p, sum(n) OVER (ORDER BY score DESC) AS an, sum(p) OVER (ORDER BY score DESC) AS ap FROM g), u AS (SELECT sum(p * ap / an) / sum(p) AS pr_auc FROM a), k AS (SELECT sum(label) AS tp, count(*) AS tn FROM (SELECT label FROM s ORDER BY score DESC, id LIMIT 100)),
z AS (SELECT count(*) AS n, sum(label) AS pos, count(*) FILTER (WHERE score >= 0.001) AS said, count(*) FILTER (WHERE score >= 0.001 AND label = 1) AS hit FROM s), r AS (SELECT *, hit / said AS p, hit / pos AS r FROM z, u, k)
SELECT round(p, 6) AS "precision", round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, round(pr_auc, 6) AS pr_auc, round(tp / tn, 6) AS precision_at_k, round(tp / pos, 6) AS recall_at_k, round(said / n, 6) AS candidate_ratio FROM r""")
def binary_metrics(spark, sf_dir):
    scored = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("doc_id").alias("id"), F.col("toxic").alias("label"), F.round(1.0 / (1 + F.length("text")), 9).alias("score"))
    out = evaluate.binary_metrics(scored, threshold=0.001)
    return r6(out, *out.columns)


RUNS = ("wide", "close", "capped")
OUTCOMES = f"""{EDGES}, o AS (SELECT source_id, truth_id AS target_id, 'wide' AS run, f.rank IS NOT NULL AS found, f.similarity, f.rank FROM tr LEFT JOIN f ON f.source_id = tr.source_id AND f.target_id = truth_id),
mx AS (SELECT source_id, target_id, bool_or(found) AS wide, bool_or(found AND rank <= 3) AS "close", bool_or(found AND similarity >= 0.3) AS capped FROM o GROUP BY 1, 2)""".replace("SELECT source_id, truth_id", "SELECT tr.source_id, truth_id")


def outcomes(spark, sf_dir):
    """Truth pairs in three runs: the top 10, the top 3, and those from a similarity of 0.3."""
    base = detail(spark, sf_dir).where("is_truth_pair")
    run = lambda name, cond: base.withColumn("run", F.lit(name)).withColumn("found", F.coalesce(F.col("found") & cond, F.lit(False)))
    return reduce(DataFrame.union, [run("wide", F.lit(True)), run("close", F.col("rank") <= 3), run("capped", F.col("similarity") >= 0.3)])


def matrix(spark, sf_dir):
    return compare.found_matrix(outcomes(spark, sf_dir), RUNS)


@query(f'WITH {OUTCOMES} SELECT source_id, target_id, coalesce(wide, false) AS wide, coalesce("close", false) AS "close", coalesce(capped, false) AS capped FROM mx')
def pair_found_matrix(spark, sf_dir):
    return matrix(spark, sf_dir)


@query(f'WITH {OUTCOMES} SELECT coalesce(wide::INTEGER, 0) + coalesce("close"::INTEGER, 0) + coalesce(capped::INTEGER, 0) AS k, count(*) AS pairs FROM mx GROUP BY 1')
def found_by_k(spark, sf_dir):
    return compare.found_by_k(matrix(spark, sf_dir), RUNS)


OVERLAP = " UNION ALL ".join(
    f"""SELECT '{a}' AS "first", '{b}' AS "second", count(*) FILTER (WHERE "{a}" AND "{b}") AS "both", round(count(*) FILTER (WHERE "{a}" AND "{b}") / nullif(count(*) FILTER (WHERE "{a}" OR "{b}"), 0), 6) AS jaccard, round(count(*) FILTER (WHERE "{a}" AND "{b}") / nullif(count(*) FILTER (WHERE "{a}"), 0), 6) AS containment FROM mx"""
    for a in RUNS for b in RUNS if a != b
)


@query(f"WITH {OUTCOMES} {OVERLAP}")
def run_overlap(spark, sf_dir):
    return r6(compare.run_overlap(matrix(spark, sf_dir), RUNS), "jaccard", "containment")


@query(f"""WITH {EDGES}, g AS (SELECT floor(similarity * 1000) / 1000 AS cutoff, count(*) AS n FROM f GROUP BY 1), c AS (SELECT cutoff, sum(n) OVER (ORDER BY cutoff DESC) AS candidates FROM g) SELECT round(min(cutoff), 6) AS cutoff, max(candidates)::BIGINT AS candidates FROM c WHERE candidates <= 500""")
def budget_cutoff(spark, sf_dir):
    return r6(compare.budget_cutoff(dense_topk(spark, sf_dir), 500), "cutoff")


@query(f"""WITH {EDGES} SELECT tr.source_id, truth_id AS target_id, CASE WHEN f.rank <= 3 THEN 'found' WHEN f.rank IS NOT NULL THEN 'lost_to_backend' ELSE 'not_kept_by_exact_scan' END AS verdict FROM tr LEFT JOIN f ON f.source_id = tr.source_id AND f.target_id = truth_id""")
def pair_audit(spark, sf_dir):
    """Against the top 10 as the exact scan, the top 3 as the backend."""
    exact = dense_topk(spark, sf_dir)
    return compare.pair_audit(truth(spark, sf_dir), exact.where("rank <= 3"), exact)


@query(f"""WITH {DETAIL} SELECT label, count(*) FILTER (WHERE is_truth_pair AND found) AS found, count(*) FILTER (WHERE is_truth_pair AND NOT found) AS missed, count(*) FILTER (WHERE NOT is_truth_pair) AS false_positive FROM dt JOIN embeddings ON vec_id = source_id GROUP BY 1""")
def outcome_matrix(spark, sf_dir):
    return compare.outcome_matrix(detail(spark, sf_dir).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("source_id"), "label"), "source_id"), "label")


@query(f"""WITH {EDGES}, s AS (SELECT source_id, target_id, similarity, rank FROM f WHERE rank <= 3) SELECT f.source_id, f.target_id, 'first_only' AS side, 'similarity,rank' AS differs FROM f ANTI JOIN s ON f.source_id = s.source_id AND f.target_id = s.target_id""")
def repeatability_diff(spark, sf_dir):
    edges = dense_topk(spark, sf_dir)
    return compare.repeatability(edges, edges.where("rank <= 3"), ["source_id", "target_id"], ["similarity", "rank"])


@query(f"""WITH {EDGES} SELECT tr.source_id, truth_id AS target_id FROM tr JOIN f ON f.source_id = tr.source_id AND f.target_id = truth_id WHERE f.rank > 3""")
def recovered_pairs(spark, sf_dir):
    """Truth pairs that the top 3 misses and the top 10 finds."""
    edges = dense_topk(spark, sf_dir)
    return compare.recovered_pairs(evaluate.truth_detail(truth(spark, sf_dir), edges.where("rank <= 3")), evaluate.truth_detail(truth(spark, sf_dir), edges))


@query(f"""WITH {CASCADE}, m AS (SELECT c.level, s.raw = t.raw AS raw, s.basic = t.basic AS basic, s.cleansed = t.cleansed AS cleansed FROM c JOIN s ON s.id = source_id JOIN t ON t.id = target_id),
u AS (SELECT 'raw' AS "column", raw AS equal FROM m UNION ALL SELECT 'basic', basic FROM m UNION ALL SELECT 'cleansed', cleansed FROM m), g AS (SELECT "column", equal, count(*) AS rows FROM u GROUP BY 1, 2)
SELECT "column", equal, rows, round(rows / sum(rows) OVER (PARTITION BY "column"), 6) AS share FROM g""")
def match_breakdown(spark, sf_dir):
    from tessella.plans.candidates import registries

    source, target = registries(spark, sf_dir)
    side = lambda df, p, key: df.select(F.col("id").alias(key), *(F.col(c).alias(f"{p}{c}") for c in ("raw", "basic", "cleansed")))
    matched = cascade(spark, sf_dir).join(side(source, "s_", "source_id"), "source_id").join(side(target, "t_", "target_id"), "target_id")
    return r6(compare.match_breakdown(matched, ["raw", "basic", "cleansed"]), "share")


@query(f"""WITH {CASCADE}, m AS (SELECT s.* FROM s ANTI JOIN c ON c.source_id = s.id) SELECT 'raw' AS form, count(*) FILTER (WHERE raw IN (SELECT raw FROM t)) AS recoverable FROM m UNION ALL SELECT 'basic', count(*) FILTER (WHERE basic IN (SELECT basic FROM t)) FROM m""")
def recoverability(spark, sf_dir):
    from tessella.plans.candidates import registries

    source, target = registries(spark, sf_dir)
    unmatched = source.join(cascade(spark, sf_dir).select(F.col("source_id").alias("id")), "id", "left_anti")
    return compare.recoverability(unmatched, target, ["raw", "basic"])


@query("""WITH p AS (SELECT a.p_partkey, a.p_name AS source_name, b.p_name || ' ' || b.p_brand AS target_name FROM part a JOIN part b USING (p_partkey)),
w AS (SELECT *, list_distinct(list_filter(string_split(lower(source_name), ' '), lambda x: x <> '')) AS a, list_distinct(list_filter(string_split(lower(target_name), ' '), lambda x: x <> '')) AS b FROM p)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS token_jaccard, levenshtein(source_name, target_name)::INTEGER AS levenshtein, abs(length(source_name) - length(target_name))::INTEGER AS length_difference FROM w""")
def residual_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("source_name"), F.concat_ws(" ", "p_name", "p_brand").alias("target_name"))
    return r6(compare.residuals(rows), "token_jaccard").select("p_partkey", "token_jaccard", "levenshtein", "length_difference")


@query("""WITH p AS (SELECT p_partkey, ' ' || p_name || ' ' AS a, ' ' || p_brand || ' ' || p_name || ' ' AS b FROM part), g AS (SELECT p_partkey, list_distinct(list_transform(range(1, length(a) - 1), lambda i: substr(a, i, 3))) AS a, list_distinct(list_transform(range(1, length(b) - 1), lambda i: substr(b, i, 3))) AS b FROM p)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM g""")
def char_ngram_jaccard(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.round(t.char_trigram_jaccard(F.col("p_name"), F.concat_ws(" ", "p_brand", "p_name")), 6).alias("jaccard"))


@query("""WITH u AS (SELECT c_custkey, ('0x' || substr(md5('42|' || c_custkey), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM customer) SELECT c_custkey, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.8 + 0.1 THEN 'validation' ELSE 'test' END AS split, floor(u * 5)::INTEGER AS fold FROM u""")
def entity_split(spark, sf_dir):
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select("c_custkey", pairs.entity_split(key).alias("split"), pairs.fold(key, 5).alias("fold"))


@query("""WITH n AS (SELECT p_brand AS source_uri, p_name AS name FROM part), b AS (SELECT source_uri, min(name) AS left_name FROM n GROUP BY 1), o AS (SELECT source_uri, lower(name) AS f, min(name) AS right_name FROM n GROUP BY 1, 2)
SELECT source_uri AS system_uri, left_name, right_name, 1 AS label FROM o JOIN b USING (source_uri) WHERE f <> lower(left_name)""")
def alias_pairs(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.col("p_brand").alias("source_uri"), F.lit("trade").alias("name_type"), F.col("p_name").alias("name"))
    return pairs.alias_pairs(names)


@query()
def sampled_negatives(spark, sf_dir):
    pool = table(spark, sf_dir, "part").select(F.concat(F.lit("brand://"), F.col("p_brand")).alias("system_uri"), F.col("p_name").alias("name"))
    return pairs.negatives(alias_pairs(spark, sf_dir).withColumn("system_uri", F.concat(F.lit("brand://"), F.col("system_uri"))), pool)


@query(f"""WITH {EDGES}, n AS (SELECT source_id, count(*) AS n FROM f GROUP BY 1), o AS (SELECT coalesce(n, 0) AS n, f.rank IS NOT NULL AS found FROM tr LEFT JOIN n USING (source_id) LEFT JOIN f ON f.source_id = tr.source_id AND f.target_id = truth_id),
c AS (SELECT * FROM (VALUES (0, 0, '0'), (1, 1, '1'), (2, 2, '2'), (3, 3, '3'), (4, 5, '4-5'), (6, 10, '6-10'), (11, 19, '11-19'), (20, 1000000000, '20+')) t(lo, hi, cluster_size))
SELECT cluster_size, outcome, count(o.n) AS pairs FROM c CROSS JOIN (VALUES ('found', true), ('findable', false)) k(outcome, flag) LEFT JOIN o ON o.n BETWEEN lo AND hi AND o.found = flag GROUP BY 1, 2""")
def cluster_sizes(spark, sf_dir):
    return analysis.cluster_sizes(detail(spark, sf_dir).where("is_truth_pair").select("source_id", "found"), dense_topk(spark, sf_dir), "found")


@query(f"""WITH {EDGES}, h AS (SELECT tr.source_id, f.rank IS NOT NULL AS hit, CASE WHEN label < 5 THEN 'never' ELSE 'raw' END AS level FROM tr JOIN embeddings ON vec_id = tr.source_id LEFT JOIN f ON f.source_id = tr.source_id AND f.target_id = truth_id),
o AS (SELECT * FROM h WHERE level = 'never'), s AS (SELECT DISTINCT source_id FROM o), g AS (SELECT count(*) AS candidates FROM f SEMI JOIN s USING (source_id)), t AS (SELECT count(*) FILTER (WHERE hit) AS truth_found FROM h SEMI JOIN s USING (source_id)),
a AS (SELECT (SELECT count(*) FROM s) AS sources, count(*) AS pairs, count(*) FILTER (WHERE hit) AS found FROM o), z AS (SELECT *, found / pairs AS r, truth_found / candidates AS p, (SELECT count(*) FROM embeddings) AS n FROM a, g, t)
SELECT sources, pairs, found, round(r, 6) AS recall, candidates, truth_found, round(p, 6) AS "precision", round(1 - candidates / (sources * n), 6) AS reduction_ratio, round(5 * p * r / (4 * p + r), 6) AS f2 FROM z""")
def level_metrics(spark, sf_dir):
    """Labels under 5 stand for the level 'never'."""
    e = table(spark, sf_dir, "embeddings")
    levels = e.select(F.col("vec_id").alias("source_id"), F.when(F.col("label") < 5, "never").otherwise("raw").alias("name_equality"))
    out = analysis.level_metrics(truth(spark, sf_dir).join(levels, "source_id"), dense_topk(spark, sf_dir), "never", target_rows=e.count())
    return r6(out, "recall", "precision", "reduction_ratio", "f2")


@query("""WITH a AS (SELECT p_partkey, p_brand AS entity, p_name AS name, lower(p_name) AS cleansed FROM part), p AS (SELECT entity, min(name) AS name FROM a GROUP BY 1),
j AS (SELECT a.*, p.name AS pn, list_has_any(string_split(lower(a.name), ' '), string_split(lower(p.name), ' ')) AS shared FROM a JOIN p USING (entity)), s AS (SELECT *, CASE WHEN NOT shared THEN 'no_shared_token' WHEN cleansed = lower(pn) THEN 'equal_after_cleansing' ELSE 'testable' END AS stratum FROM j)
SELECT stratum, count(*) AS pairs, count(*) FILTER (WHERE cleansed = lower(pn)) AS collapsed, round(count(*) FILTER (WHERE cleansed = lower(pn)) / count(*), 6) AS rate FROM s GROUP BY 1""")
def alias_collapse(spark, sf_dir):
    """A brand's part names as aliases of its first name."""
    aliases = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("entity"), F.col("p_name").alias("name"), F.lower("p_name").alias("cleansed"))
    primaries = aliases.groupBy("entity").agg(F.min("name").alias("name")).withColumn("cleansed", F.lower("name"))
    return r6(analysis.collapse_rate(analysis.variant_strata(aliases, primaries), "cleansed", "primary_cleansed"), "rate")
