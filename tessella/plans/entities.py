"""Queries over canonical columns, name forms, derived identities and pair contracts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions import text as t
from tessella.operators import blocking, canonical, cleanse, compare, pairs, similarity, tokenstats
from tessella.operators.cleanse import CleanseConfig
from tessella.registry import query, table


@query("""SELECT 'crm://' || c_custkey AS system_uri, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment END AS name,
  CASE WHEN length(c_custkey::VARCHAR) < 8 THEN lpad(c_custkey::VARCHAR, 8, '0') ELSE c_custkey::VARCHAR END AS company_number,
  CASE WHEN c_custkey % 3 <> 0 THEN n_name || '|' || c_mktsegment END AS scoped_number, NULL::VARCHAR AS absent
FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_7') AND NOT coalesce(c_acctbal < 0, false)""")
def canonical_rows(spark, sf_dir):
    """Customers of three countries in the contract's columns: first non-blank name, padded and scoped numbers, a column the source lacks."""
    customer = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    named = canonical.rename_aliases(customer.withColumn("trade_name", F.when(F.col("c_custkey") % 3 == 0, " ").otherwise(F.col("c_mktsegment"))), {"c_name": "legal_name", "unknown": "other"})
    kept = canonical.filter_countries(named, ["nation_1", "NATION_2", "Nation_7"], ["N_NAME", "country"])
    columns = {
        "system_uri": canonical.system_uri("crm", F.col("c_custkey")),
        "name": ["TRADE_NAME", "legal_name"],
        "company_number": canonical.pad_number(F.col("c_custkey")),
        "scoped_number": canonical.scoped_number(F.col("n_name"), F.col("trade_name")),
        "absent": ["nothing"],
    }
    return canonical.canonicalize(kept, columns, exclude=F.col("c_acctbal") < 0)


@query("""SELECT p_partkey, p_name || '; ' || p_brand || CASE WHEN lower(p_type) IN (lower(p_name), lower(p_brand)) THEN '' ELSE '; ' || p_type END AS names FROM part""")
def name_lists(spark, sf_dir):
    names = F.array("p_name", F.upper("p_name"), F.lit(" "), "p_brand", F.lit(None).cast("string"), F.concat(F.lit(" "), F.lower("p_brand")), "p_type")
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(canonical.name_list(names), "; ").alias("names"))


@query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 THEN 'HRB' END AS court, CASE WHEN c_custkey % 2 = 1 THEN c_custkey::VARCHAR END AS number,
  CASE WHEN c_custkey % 4 = 0 THEN c_name WHEN c_custkey % 4 = 1 THEN NULL WHEN c_custkey % 4 = 2 THEN 'Ann ' || c_mktsegment ELSE c_mktsegment END AS name, lower(c_mktsegment) AS partition FROM customer""")
def register_numbers(spark, sf_dir):
    """Court and number of joined register ids, names of persons and companies, partition values."""
    key = F.col("c_custkey")
    court, number = canonical.court_number(F.when(key % 2 == 1, F.concat_ws("_", "c_mktsegment", F.lit("HRB"), key)).otherwise(key.cast("string")))
    name = canonical.person_or_company(F.when(key % 4 == 0, F.col("c_name")), F.when(key % 4 == 2, "Ann").otherwise(" "), F.when(key % 4 != 1, F.col("c_mktsegment")))
    return table(spark, sf_dir, "customer").select("c_custkey", court.alias("court"), number.alias("number"), name.alias("name"), canonical.partition_key(F.concat("c_mktsegment", F.lit(" "))).alias("partition"))


@query("SELECT 'part://' || p_partkey AS source_uri, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS name FROM part")
def best_names(spark, sf_dir):
    """The preferred Latin name: the trade name, which is Greek for parts of odd size, and else the brand."""
    part = table(spark, sf_dir, "part").select(F.concat(F.lit("part://"), F.col("p_partkey")).alias("uri"), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise("Ωμέγα").alias("trade"), F.col("p_brand").alias("brand"), F.lit("Γάμμα").alias("greek"))
    return canonical.best_name(canonical.name_rows(part, "uri", {"greek": "greek", "brand": "brand", "trade": "trade"}), ["greek", "trade"])


@query("SELECT p_brand AS source_uri, p_type AS name_type, p_name AS name, count(*) AS rows FROM part GROUP BY 1, 2, 3 HAVING count(*) > 1")
def variant_duplicates(spark, sf_dir):
    return canonical.duplicate_variants(table(spark, sf_dir, "part").select(F.col("p_brand").alias("source_uri"), F.col("p_type").alias("name_type"), F.col("p_name").alias("name")))


@query("""WITH n AS (SELECT c_mktsegment AS segment, count(*) AS rows FROM customer GROUP BY 1),
x AS (SELECT *, 100 * rows / sum(rows) OVER () AS exact, 120 * sqrt(rows) / sum(sqrt(rows)) OVER () AS root FROM n),
r AS (SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, rows DESC, segment) AS place, 100 - sum(floor(exact)) OVER () AS rest FROM x)
SELECT segment, rows, greatest(1, least(rows, ceil(384.16 / (1 + 383.16 / rows))))::BIGINT AS cochran, (floor(exact) + (place <= rest)::INTEGER)::BIGINT AS quota, least(rows, floor(root))::BIGINT AS training FROM r""")
def sample_quotas(spark, sf_dir):
    """Sizes of a sample of each segment: Cochran's, shares of 100 by largest remainder, square-root shares of 120 to train on."""
    rows = {r[0]: r[1] for r in table(spark, sf_dir, "customer").groupBy("c_mktsegment").count().collect()}  # a handful of segments
    shares, training = canonical.quotas(rows, 100), canonical.corpus_quotas(rows, mode="sqrt", target=120)
    return spark.createDataFrame([(k, n, canonical.sample_size(n), shares[k], training[k]) for k, n in rows.items()], "segment string, rows long, cochran long, quota long, training long")


@query("""SELECT CASE c_custkey % 3 WHEN 0 THEN 'perturbed://name/customer/' || c_custkey || '/h/p' WHEN 1 THEN 'name://customer/' || c_custkey || '/h' ELSE 'customer://' || c_custkey END AS uri,
  'customer://' || c_custkey AS entity, CASE WHEN c_acctbal >= 0 THEN 'nation://' || c_nationkey END AS match_uri FROM customer""")
def derived_matches(spark, sf_dir):
    """Name variants and their damaged copies led back to the entity and its match."""
    customer = table(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    uri = F.when(key % 3 == 0, F.concat(F.lit("perturbed://name/customer/"), key, F.lit("/h/p"))).when(key % 3 == 1, F.concat(F.lit("name://customer/"), key, F.lit("/h"))).otherwise(F.concat(F.lit("customer://"), key))
    matched = customer.where("c_acctbal >= 0").select(F.concat(F.lit("customer://"), key).alias("system_uri"), F.concat(F.lit("nation://"), "c_nationkey").alias("match_uri"))
    return canonical.resolve_matches(customer.select(uri.alias("uri")), matched)


@query("""SELECT doc_id, trim(regexp_replace(regexp_replace(replace(text, '_', ' '), '[^\\p{L}\\p{M}\\p{Nd}\\s&!]', ' ', 'g'), '\\s+', ' ', 'g')) AS bang, replace(lower(text), 'ß', 'ss') AS folded, strip_accents(replace(text, 'ß', 'ss')) AS latin FROM documents""")
def normalize_variants(spark, sf_dir):
    """The operations outside the default chain: punctuation that keeps '!', case folding, transliteration."""
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.normalize(text, "punctuation_bang|singlespace").alias("bang"), t.normalize(text, "casefold").alias("folded"), t.normalize(text, "transliterate").alias("latin"))


@query("""SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'srl & p&q ' || p_name WHEN 1 THEN p_name || ' sa' WHEN 2 THEN p_name || ' & co' ELSE 'at & t ' || p_name END AS normalized FROM part""")
def normalize_single_chars(spark, sf_dir):
    k = F.col("p_size") % 4
    name = F.when(k == 0, F.concat(F.lit("S.R.L. and P & Q "), "p_name")).when(k == 1, F.concat("p_name", F.lit(", S. A."))).when(k == 2, F.concat("p_name", F.lit(" und Co."))).otherwise(F.concat(F.lit("A T & T "), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", t.normalize(name).alias("normalized"))


@query("SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' co' WHEN 2 THEN p_name || ' of ireland' WHEN 3 THEN p_name ELSE split_part(p_name, ' ', 1) || ' ireland' END AS normalized FROM part")
def normalize_geographic(spark, sf_dir):
    """Country and region names at the end or in brackets go, unless a connector or too short a name stands before them."""
    k = F.col("p_size") % 5
    tail = F.when(k == 0, " Northern  Ireland").when(k == 1, " (Ireland) Co").when(k == 2, " of Ireland").when(k == 3, " Bavaria").otherwise(" Ireland")
    name = F.concat(F.when(k == 4, F.substring_index("p_name", " ", 1)).otherwise(F.col("p_name")), tail)
    terms = {"country": ["ireland", "northern ireland"], "region": ["bavaria"]}
    return table(spark, sf_dir, "part").select("p_partkey", F.lower(t.normalize(name, "geographic_terms|+region", geographic=terms)).alias("normalized"))


@query("""WITH n AS (SELECT *, p_size % 6 AS k, left(p_name, 1) || left(split_part(p_name, ' ', 2), 1) AS first FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN 'zed trading ' || p_name || ' ltd' WHEN 1 THEN 'the ' || p_name WHEN 2 THEN p_name || ' plc' WHEN 5 THEN p_name || ' ltd' ELSE p_name END AS name_cleansed,
  CASE k WHEN 0 THEN 'ltd' WHEN 2 THEN 'plc' WHEN 4 THEN 'sa' WHEN 5 THEN 'ltd' ELSE 'private' END AS company_type, CASE WHEN k IN (0, 2, 5) THEN 'name_suffix' WHEN k = 4 THEN 'source_mapping' ELSE 'default_private' END AS company_type_source,
  p_name AS short_name, CASE k WHEN 0 THEN 'Zed Trading' END AS quoted_name, CASE WHEN k = 2 THEN first END AS acronym, CASE k WHEN 3 THEN 'Ann Lee' END AS personal_owner FROM n""")
def cleanse_forms(spark, sf_dir):
    """Names with a quoted lead, a trailing (THE), a bracketed acronym, an owner, a source's own type and a noise word before the legal form."""
    k, name = F.col("p_size") % 6, F.col("p_name")
    letters = F.concat(F.substring(name, 1, 1), F.substring(F.substring_index(name, " ", -1), 1, 1))
    full = F.when(k == 0, F.concat(F.lit('"Zed Trading" '), name, F.lit(" Ltd."))).when(k == 1, F.concat(name, F.lit(" (THE)"))).when(k == 2, F.concat(F.lit("("), F.upper(letters), F.lit(") "), name, F.lit(" PLC")))
    full = full.when(k == 3, F.concat(name, F.lit(" owner Ann Lee"))).when(k == 5, F.concat(name, F.lit(" limited"))).otherwise(name)
    names = table(spark, sf_dir, "part").select("p_partkey", full.alias("name"), F.when(k == 4, " Anonymous Society").alias("kind"))
    config = CleanseConfig(owner_markers=("owner",), source_type_col="kind", source_types={"anonymous society": "sa"})
    return cleanse.cleanse(names, config).select("p_partkey", "name_cleansed", "company_type", "company_type_source", "short_name", "quoted_name", "acronym", "personal_owner")


@query("""SELECT p_partkey, p_name || CASE p_size % 3 WHEN 0 THEN ' as' WHEN 1 THEN ' a/s' ELSE '' END AS shown,
  CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN 'a/s' WHEN p_size % 3 = 0 THEN 'private' ELSE 'private' END AS company_type, p_name || CASE WHEN p_size % 3 = 0 AND p_partkey % 2 = 0 THEN ' a/s' WHEN p_size % 3 = 0 THEN ' as' WHEN p_size % 3 = 1 THEN ' a s' ELSE '' END AS name_cleansed FROM part""")
def cleanse_by_country(spark, sf_dir):
    """Legal forms that one country has and another excludes: AS is a form in Denmark and a word in Britain."""
    tail = F.when(F.col("p_size") % 3 == 0, " as").when(F.col("p_size") % 3 == 1, " a/s").otherwise("")
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", tail).alias("name"), F.when(F.col("p_partkey") % 2 == 0, "DK").otherwise("gb").alias("country"))
    config = CleanseConfig(profile="default|-singlechar", country_col="country", country_forms={"dk": {"as": "a/s"}}, country_exclusions={"gb": ("as",)})
    return cleanse.cleanse(names, config).select("p_partkey", F.col("name").alias("shown"), "company_type", "name_cleansed")


@query("""WITH n AS (SELECT p_partkey, p_name, left(p_name, 1) AS a, left(split_part(p_name, ' ', 2), 1) AS b FROM part)
SELECT p_partkey, a || 'o' || b || 'l' AS exact, a || b AS subsequence, p_name AS truncated, 'xy ' || p_name AS acronym, a || b AS candidate FROM n""")
def short_name_layers(spark, sf_dir):
    a, b = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    words, numbered, hyphened = F.array(a, F.lit("of"), b, F.lit("ltd")), F.array(a, b, F.lit("12"), F.lit("ltd")), F.array(F.lit("x-y"), a, b, F.lit("gmbh"))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        cleanse.short_name_layer(words, "exact_initials").alias("exact"),
        cleanse.short_name_layer(words, "subsequence_initials").alias("subsequence"),
        cleanse.short_name_layer(numbered, "prefix_truncation").alias("truncated"),
        cleanse.short_name_layer(hyphened, "prefix_acronym").alias("acronym"),
        cleanse.short_name_candidate(words).alias("candidate"),
    )


@query("SELECT p_partkey, p_name || ' group' AS plain, p_name || ' group ltd' AS typed, p_name AS bare FROM part")
def preprocessed_names(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.lit(" Group, Ltd.")).alias("name"))
    for column, profile in (("plain", "default"), ("typed", "default|-company_type"), ("bare", "default|+noise_words:light")):
        names = cleanse.preprocess_names(names, profile, out_col=column)
    return names.drop("name")


@query("""SELECT split_part(p_name, ' ', 2) AS last_token, count(*) AS rows FROM part WHERE split_part(p_name, ' ', 2) <> 'ring' GROUP BY 1 HAVING count(*) >= 10""")
def proposed_forms(spark, sf_dir):
    """Frequent last tokens of names without a legal form."""
    typed = cleanse.cleanse(table(spark, sf_dir, "part").withColumnRenamed("p_name", "name")).withColumn("words", F.split("name_cleansed", " "))
    return cleanse.propose_forms(typed, "company_type", "words", known=["ring"])


@query("""WITH n AS (SELECT p_brand, count(*) AS df, sum(count(*)) OVER () AS n FROM part GROUP BY 1) SELECT p_brand, df AS smooth, df AS plain FROM n""")
def idf_inversion(spark, sf_dir):
    """Document frequencies found again from their idf."""
    part = table(spark, sf_dir, "part")
    n, df = F.col("n"), F.col("df")
    rows = part.groupBy("p_brand").agg(F.count("*").alias("df")).crossJoin(part.agg(F.count("*").alias("n")))  # one row
    return rows.select("p_brand", *(tokenstats.df_from_idf(n, tokenstats.idf(n, df, smooth), smooth).alias(name) for name, smooth in (("smooth", True), ("plain", False))))


@query("""WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\x0B]+'), lambda w: w <> '') AS w FROM documents)
SELECT doc_id, len(w) AS tokens, len(list_filter(w, lambda x: lower(x) NOT IN ('the', 'la', 'und', 'de'))) AS kept FROM t""")
def noise_trim(spark, sf_dir):
    words = t.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.size(words).alias("tokens"), F.size(tokenstats.trim_noise(words, ["The", "la", "und", "de"])).alias("kept"))


@query("""SELECT c_custkey AS id, c_name AS name FROM customer UNION ALL SELECT DISTINCT o_custkey, 'trading ' || o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey""")
def alias_expansion(spark, sf_dir):
    """Targets with one more row for each alias; an alias that is the name in other case adds none."""
    target = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.concat(F.lit("trading "), F.col("o_orderstatus")).alias("name"))
    return similarity.expand_aliases(target, orders.unionByName(target.select("id", F.upper("name").alias("name"))))


EDGES = "e AS (SELECT o_custkey AS source_id, o_orderkey % 100 AS target_id, max(o_totalprice) AS similarity FROM orders GROUP BY 1, 2)"


def order_edges(spark, sf_dir) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy(F.col("o_custkey").alias("source_id"), (F.col("o_orderkey") % 100).alias("target_id")).agg(F.max("o_totalprice").alias("similarity"))


@query(f"WITH {EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY similarity DESC, target_id) AS rank FROM e WHERE source_id <> target_id) SELECT * FROM r WHERE rank <= 3")
def target_neighbours(spark, sf_dir):
    return blocking.neighbours(order_edges(spark, sf_dir), 3)


@query("""SELECT CASE WHEN o_totalprice > 250000 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'raw' ELSE 'basic' END AS from_level, CASE WHEN o_orderkey % 3 = 0 THEN 'raw' ELSE 'cleansed' END AS to_level, count(*) AS pairs
FROM orders GROUP BY 1, 2 HAVING from_level IS DISTINCT FROM to_level""")
def level_changes(spark, sf_dir):
    key = F.col("o_orderkey")
    detail = table(spark, sf_dir, "orders").select(key.alias("source_id"), F.col("o_custkey").alias("target_id"), F.when(F.col("o_totalprice") > 250000, None).when(key % 2 == 0, "raw").otherwise("basic").alias("base"), F.when(key % 3 == 0, "raw").otherwise("cleansed").alias("variant"))
    of = lambda c: detail.select("source_id", "target_id", F.col(c).alias("name_equality"))
    return compare.level_transitions(of("base"), of("variant"))


@query("""SELECT floor(log10(o_custkey))::INTEGER AS decade, count(*) AS runs, min(o_totalprice) AS min_s, median(o_totalprice) AS median_s, max(o_totalprice) AS max_s FROM orders WHERE o_custkey > 0 GROUP BY 1""")
def runtime_scaling(spark, sf_dir):
    return compare.runtime_scaling(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rows"), F.col("o_totalprice").alias("seconds")))


@query("""WITH m AS (SELECT o_custkey, avg(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS score FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN score IS NULL THEN 'missing' WHEN score >= 200000 THEN 'promote' ELSE 'keep' END AS verdict FROM m""")
def promotion_report(spark, sf_dir):
    metrics = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))).alias("score"))
    return compare.promotion(metrics, "score", 200_000).select("o_custkey", "verdict")


@query("SELECT c_custkey, s.o_orderstatus FROM customer, (VALUES ('F'), ('O'), ('P')) s(o_orderstatus) WHERE (c_custkey, s.o_orderstatus) NOT IN (SELECT (o_custkey, o_orderstatus) FROM orders)")
def missing_cells(spark, sf_dir):
    """Customers and order states that have no order."""
    orders = table(spark, sf_dir, "orders")
    every = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array(*map(F.lit, "FOP"))).alias("o_orderstatus"))
    present = orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    return compare.missing_cells(every, present, ["c_custkey", "o_orderstatus"])


@query("""SELECT p_partkey, p_size % 3 = 0 AS initialism, CASE p_size % 3 WHEN 1 THEN 'prefix' WHEN 2 THEN CASE WHEN p_size % 2 = 0 THEN 'suffix' END END AS divergence FROM part""")
def name_divergence(spark, sf_dir):
    """Initials and two-sided growth of a name's tokens; three more tokens are too many."""
    words, k = F.split("p_name", " "), F.col("p_size") % 3
    other = F.when(k == 0, F.array(t.initials(words))).when(k == 1, F.concat(words, F.array(F.lit("x"), F.lit("y"))))
    other = other.when(F.col("p_size") % 2 == 0, F.concat(F.array(F.lit("x")), words)).otherwise(F.concat(F.array(F.lit("x"), F.lit("y"), F.lit("z")), words))
    return table(spark, sf_dir, "part").select("p_partkey", t.initialism(words, other).alias("initialism"), t.divergence(words, other).alias("divergence"))


@query("""WITH p AS (SELECT p_brand AS uri, p_name AS l, CASE WHEN p_size = 1 THEN ' ' WHEN p_size = 2 THEN p_name ELSE p_type END AS r, CASE WHEN p_size = 3 THEN 2 ELSE p_partkey % 2 END AS label, p_size % 2 AS split FROM part)
SELECT 'missing_name' AS fault, count(*) AS rows FROM p WHERE trim(r) = '' UNION ALL SELECT 'bad_label', count(*) FROM p WHERE label = 2 UNION ALL SELECT 'equal_names', count(*) FROM p WHERE l = r
UNION ALL SELECT 'split_leakage', count(*) FROM (SELECT uri FROM p GROUP BY 1 HAVING count(DISTINCT split) > 1) UNION ALL SELECT 'ambiguous', count(*) FROM (SELECT least(l, r), greatest(l, r) FROM p GROUP BY 1, 2 HAVING count(DISTINCT label) > 1)""")
def pair_contract(spark, sf_dir):
    """Faults planted among labelled pairs."""
    size = F.col("p_size")
    right = F.when(size == 1, " ").when(size == 2, F.col("p_name")).otherwise(F.col("p_type"))
    label = F.when(size == 3, 2).otherwise(F.col("p_partkey") % 2)
    return pairs.contract_faults(table(spark, sf_dir, "part").select(F.col("p_brand").alias("system_uri"), F.col("p_name").alias("left_name"), right.alias("right_name"), label.alias("label"), (size % 2).alias("split")))
