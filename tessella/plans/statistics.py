"""Queries over token statistics, layers and vocabularies; a document's language or source stands for a system."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.functions.text import tokens
from tessella.operators import compare, tokenstats
from tessella.registry import query, table

WORDS = "w AS (SELECT doc_id, lang, source, text, list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS t FROM documents)"
STATS = f"""{WORDS}, n AS (SELECT count(*) AS n FROM documents), d AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS token FROM w) GROUP BY 1),
s AS (SELECT token, df AS document_frequency, df / n AS document_frequency_pct, ln((1 + n) / (1 + df)) + 1 AS idf FROM d, n)"""
BY_LANG = f"""{WORDS}, n AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), d AS (SELECT lang, token, count(*) AS df FROM (SELECT lang, unnest(list_distinct(t)) AS token FROM w) GROUP BY 1, 2),
s AS (SELECT lang, token, df AS document_frequency, df / n AS document_frequency_pct, ln((1 + n) / (1 + df)) + 1 AS idf, n AS n_docs FROM d JOIN n USING (lang))"""


def words(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text", tokens(F.lower("text")).alias("t"))


def r6(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 6))
    return df


ROUNDED = "round(document_frequency_pct, 6) AS document_frequency_pct, round(idf, 6) AS idf"


@query(f"WITH {BY_LANG} SELECT lang, token, document_frequency, {ROUNDED}, n_docs FROM s")
def token_df_idf(spark, sf_dir):
    return r6(tokenstats.token_stats(words(spark, sf_dir), "t", ["lang"]), "document_frequency_pct", "idf")


@query(f"""WITH {BY_LANG}, z AS (SELECT sum(n) AS total FROM n)
SELECT token, sum(document_frequency)::BIGINT AS document_frequency, round(sum(document_frequency) / any_value(total), 6) AS document_frequency_pct, round(ln((1 + any_value(total)) / (1 + sum(document_frequency))) + 1, 6) AS idf FROM s, z GROUP BY token""")
def token_pooling_count(spark, sf_dir):
    return r6(tokenstats.pool_stats(tokenstats.token_stats(words(spark, sf_dir), "t", ["lang"]), "lang"), "document_frequency_pct", "idf")


@query(f"""WITH {BY_LANG}, z AS (SELECT count(*) AS k, greatest(round(avg(n)), 1)::BIGINT AS n FROM n), p AS (SELECT token, sum(document_frequency_pct) / any_value(k) AS pct, any_value(z.n) AS n FROM s, z GROUP BY token)
SELECT token, round(pct, 6) AS document_frequency_pct, round(ln((1 + n) / (1 + least(greatest(round(pct * n), 1), n))) + 1, 6) AS idf FROM p""")
def token_pooling_equal(spark, sf_dir):
    return r6(tokenstats.pool_stats(tokenstats.token_stats(words(spark, sf_dir), "t", ["lang"]), "lang", pooling="equal"), "document_frequency_pct", "idf").drop("document_frequency")


@query(f"""WITH {STATS}, r AS (SELECT row_number() OVER (ORDER BY document_frequency_pct DESC, token) AS rank, sum(document_frequency_pct) OVER (ORDER BY document_frequency_pct DESC, token) AS mass FROM s)
SELECT coalesce(min(rank) FILTER (WHERE mass >= 5.5), count(*))::BIGINT AS cutoff FROM r""")
def noise_mass_cutoff(spark, sf_dir):
    return tokenstats.mass_cutoff(tokenstats.token_stats(words(spark, sf_dir), "t"), 5.5)


@query(f"WITH {STATS} SELECT token, document_frequency, {ROUNDED} FROM s WHERE document_frequency_pct >= 0.01 AND idf <= 6 AND length(token) >= 2")
def stopword_candidates(spark, sf_dir):
    return r6(tokenstats.stopwords(tokenstats.token_stats(words(spark, sf_dir), "t")), "document_frequency_pct", "idf").drop("n_docs")


@query(f"WITH {STATS} SELECT token, document_frequency FROM s WHERE document_frequency <= 1 AND length(token) >= 2")
def rare_tokens(spark, sf_dir):
    return tokenstats.rare_tokens(tokenstats.token_stats(words(spark, sf_dir), "t")).select("token", "document_frequency")


@query(f"WITH {STATS} SELECT token, document_frequency FROM s WHERE length(token) >= 2 ORDER BY document_frequency DESC, token LIMIT 200")
def noise_candidates(spark, sf_dir):
    return tokenstats.noise_candidates(tokenstats.token_stats(words(spark, sf_dir), "t")).select("token", "document_frequency")


@query()
def noise_profiles(spark, sf_dir):
    return tokenstats.noise_profiles(tokenstats.token_stats(words(spark, sf_dir), "t"))


METRICS = f"""{WORDS}, e AS (SELECT source, replace(upper(x), 'ẞ', 'SS') AS token FROM (SELECT source, unnest(t) AS x FROM w)), tf AS (SELECT source, token, count(*) AS tf FROM e GROUP BY 1, 2),
df AS (SELECT source, token, count(*) AS df FROM (SELECT source, unnest(list_distinct(list_transform(t, lambda x: replace(upper(x), 'ẞ', 'SS')))) AS token FROM w) GROUP BY 1, 2), n AS (SELECT source, count(*) AS n FROM documents GROUP BY 1),
a AS (SELECT source, sum(tf) AS tf_all FROM tf GROUP BY 1), g AS (SELECT token, sum(df) AS gdf FROM df GROUP BY 1), z AS (SELECT sum(n) AS gn FROM n),
m AS (SELECT source, token, tf, df, tf / tf_all AS tf_pct, df / n AS df_pct, df / gdf AS coverage_ratio, (df / n) / (gdf / gn) AS lift, tf * (ln((n + 1) / (df + 1)) + 1) AS tfidf FROM tf JOIN df USING (source, token) JOIN n USING (source) JOIN a USING (source) JOIN g USING (token), z)"""


@query(f"WITH {METRICS} SELECT source, token, tf, df, round(tf_pct, 6) AS tf_pct, round(df_pct, 6) AS df_pct, round(coverage_ratio, 6) AS coverage_ratio, round(lift, 6) AS lift, round(tfidf, 6) AS tfidf FROM m")
def token_metrics(spark, sf_dir):
    return r6(tokenstats.term_metrics(words(spark, sf_dir), "source", "t"), "tf_pct", "df_pct", "coverage_ratio", "lift", "tfidf")


@query(f"""WITH {METRICS} SELECT source, token, df, CASE WHEN token IN ('THE', 'DER', 'LA') THEN 'noise_word' ELSE 'other' END AS token_type FROM m WHERE coverage_ratio >= 0.05 AND df_pct >= 0.05""")
def stoplist_candidates(spark, sf_dir):
    metrics = tokenstats.term_metrics(words(spark, sf_dir), "source", "t")
    return tokenstats.stoplist(metrics, noise=["the", "der", "la"], least_coverage=0.05).select("source", "token", "df", "token_type")


@query(f"""WITH {STATS}, r AS (SELECT document_frequency AS f, row_number() OVER (ORDER BY document_frequency DESC, token) AS rank FROM s) SELECT round(regr_slope(ln(f), ln(rank)), 6) AS slope, count(*) AS tokens FROM r""")
def zipf_slope(spark, sf_dir):
    return r6(tokenstats.zipf_slope(tokenstats.token_stats(words(spark, sf_dir), "t")), "slope")


@query(f"""WITH {STATS}, m AS (SELECT avg(len(t)) AS mean FROM w) SELECT token, document_frequency, round(document_frequency / (n * mean), 9) AS probability FROM s, m, n""")
def sif_probability(spark, sf_dir):
    return tokenstats.word_probabilities(words(spark, sf_dir), "t").withColumn("probability", F.round("probability", 9))


@query(f"""WITH {STATS} SELECT count(*) AS rows, round(avg(CASE WHEN len(list_filter(t, lambda x: x IN (SELECT token FROM s WHERE document_frequency = 1))) > 0 THEN 1.0 ELSE 0.0 END), 6) AS hapax_share FROM w""".replace("len(list_filter(t, lambda x: x IN (SELECT token FROM s WHERE document_frequency = 1))) > 0", "list_has_any(t, (SELECT list(token) FROM s WHERE document_frequency = 1))"))
def hapax_incidence(spark, sf_dir):
    df = words(spark, sf_dir)
    return r6(tokenstats.name_incidence(df, "t", tokenstats.token_stats(df, "t")), "hapax_share")


@query(f"""WITH {STATS}, b AS (SELECT DISTINCT unnest(list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS word FROM benchmark)
SELECT count(*) AS tokens, round(avg(CASE WHEN word IS NULL THEN 1.0 ELSE 0.0 END), 6) AS unseen_share, round(avg(length(word)), 6) AS mean_zipf FROM s LEFT JOIN b ON s.token = b.word""")
def language_rarity(spark, sf_dir):
    """The benchmark's words stand for a reference vocabulary, their lengths for its frequencies."""
    reference = table(spark, sf_dir, "benchmark").select(F.explode(tokens(F.lower("text"))).alias("word")).distinct().withColumn("zipf", F.length("word").cast("double"))
    joined = tokenstats.language_frequency(tokenstats.token_stats(words(spark, sf_dir), "t"), reference)
    return r6(tokenstats.rarity_summary(joined), "unseen_share", "mean_zipf")


@query("""WITH l AS (SELECT lang, regexp_extract(rtrim(text), '([^ \\t\\n\\x0B\\f\\r]+)$', 1) AS last_token, count(*) AS rows FROM documents GROUP BY 1, 2 HAVING last_token <> ''), r AS (SELECT *, dense_rank() OVER (PARTITION BY lang ORDER BY rows DESC) AS rank FROM l) SELECT lang, last_token, rows, rank::INTEGER AS rank FROM r WHERE rank <= 10""")
def last_token_rank(spark, sf_dir):
    return tokenstats.last_token_ranks(table(spark, sf_dir, "documents"), "lang", "text")


@query(f"""WITH {WORDS}, x AS (SELECT lang, len(t) AS n, len(list_filter(t, lambda y: length(y) = 1)) AS c FROM w WHERE trim(text) <> '')
SELECT lang, count(*) AS rows, round(avg(n / greatest(n, 1)), 6) AS fertility, round(sum(c) / sum(n), 6) AS single_char_share, round(avg(n), 6) AS mean_tokens, median(n) AS median_tokens, quantile_disc(n, 0.95)::INTEGER AS p95_tokens FROM x GROUP BY 1""")
def word_fertility(spark, sf_dir):
    df = words(spark, sf_dir)
    out = tokenstats.fertility(df, "text", "t", by=["lang"]).drop("unk_rate")
    return r6(out, "fertility", "single_char_share", "mean_tokens")


LAYERS = f"""{BY_LANG}, tiers AS (SELECT lang AS system, 0 AS tier_no, 'all' AS tier, token, document_frequency FROM s UNION ALL SELECT lang, 1, 'no_short', token, document_frequency FROM s WHERE length(token) >= 3
  UNION ALL SELECT lang, 2, 'no_common', token, document_frequency FROM s WHERE length(token) >= 3 AND document_frequency_pct < 0.2)"""


def tiers(spark, sf_dir):
    """Three cleansing layers of each language's vocabulary: all tokens, without short ones, without common ones."""
    s = tokenstats.token_stats(words(spark, sf_dir), "t", ["lang"]).withColumnRenamed("lang", "system")
    tier = lambda k, name, cond: s.where(cond).select("system", F.lit(k).alias("tier_no"), F.lit(name).alias("tier"), "token", "document_frequency")
    return tier(0, "all", "true").union(tier(1, "no_short", "length(token) >= 3")).union(tier(2, "no_common", "length(token) >= 3 AND document_frequency_pct < 0.2"))


@query(f"""WITH {LAYERS} SELECT a.system, CASE a.tier_no WHEN 0 THEN 'no_short' ELSE 'no_common' END AS layer, count(*) AS removed, sum(a.document_frequency)::BIGINT AS mass FROM tiers a
WHERE a.tier_no < 2 AND NOT EXISTS (SELECT 1 FROM tiers b WHERE b.system = a.system AND b.tier_no = a.tier_no + 1 AND b.token = a.token) GROUP BY 1, 2""")
def layer_removals(spark, sf_dir):
    return compare.layer_removals(tiers(spark, sf_dir))


@query(f"""WITH {BY_LANG}, p AS (SELECT token, string_agg(lang, '+' ORDER BY lang) AS region FROM s GROUP BY 1) SELECT region, count(*) AS tokens FROM p GROUP BY 1""")
def layer_regions(spark, sf_dir):
    return compare.layer_regions(tokenstats.token_stats(words(spark, sf_dir), "t", ["lang"]).select(F.col("lang").alias("system"), "token"))


@query(f"""WITH {BY_LANG}, z AS (SELECT lang, count(*) AS n FROM s GROUP BY 1), b AS (SELECT a.lang AS l, c.lang AS r, count(*) AS k FROM s a JOIN s c ON a.token = c.token AND a.lang < c.lang GROUP BY 1, 2)
SELECT x.lang AS "left", y.lang AS "right", coalesce(k, 0) AS "both", round(coalesce(k, 0) / (x.n + y.n - coalesce(k, 0)), 6) AS jaccard FROM z x JOIN z y ON x.lang < y.lang LEFT JOIN b ON b.l = x.lang AND b.r = y.lang""")
def layer_jaccard(spark, sf_dir):
    return r6(compare.pairwise_jaccard(tokenstats.token_stats(words(spark, sf_dir), "t", ["lang"]).select(F.col("lang").alias("system"), "token")), "jaccard")


@query(f"""WITH {BY_LANG}, p AS (SELECT token, row_number() OVER (ORDER BY sum(document_frequency) DESC, token) AS pr FROM s GROUP BY 1), o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY document_frequency DESC, token) AS own FROM s JOIN p USING (token)),
b AS (SELECT unnest([100, 1000, 5000]) AS budget) SELECT lang AS system, budget, round(sum(CASE WHEN pr > budget THEN document_frequency ELSE 0 END) / sum(document_frequency), 6) AS dropped_mass FROM o JOIN b ON own <= budget GROUP BY 1, 2""")
def vocab_dropped_mass(spark, sf_dir):
    stats = tokenstats.token_stats(words(spark, sf_dir), "t", ["lang"]).withColumnRenamed("lang", "system")
    return r6(compare.dropped_mass(stats, [100, 1000, 5000]), "dropped_mass")
