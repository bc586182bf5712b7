import math

import pytest
from pyspark.sql import functions as F

from tessella.operators import blocking, canonical, cleanse, compare, evaluate, match, pairs, perturb, similarity, tokenstats, wordpiece
from tessella.operators.graph import connected_components

EDGE = "source_id long, target_id long, similarity double, rank int"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


# match


@pytest.mark.parametrize("number, place, want", [("00123", "ie", "123"), ("000", "ie", "0"), ("HRB 123 B", "DE", "HRB123"), ("12345678901234", "fr", "123456789"), ("ab-1", "gb", "AB1"), (None, "gb", ""), ("0a", "gb", "0A")])
def test_number_keys(spark, number, place, want):
    df = spark.createDataFrame([(number, place)], "n string, j string")
    assert df.select(match.number_key(F.col("n"), F.col("j"))).first()[0] == want


def test_match_keeps_sources_and_leaves_ambiguous_targets_out(spark):
    source = spark.createDataFrame([("s1", "gb", "01", "old"), ("s2", "gb", "1", None), ("s3", "gb", "2", None), ("s4", "gb", None, None)], "system_uri string, jurisdiction_code string, company_number string, match_uri string")
    target = spark.createDataFrame([("t1", "GB", "1"), ("t2", "gb", "2"), ("t3", "gb", "002")], "system_uri string, jurisdiction_code string, company_number string")
    assert rows(match.match(source, target), "system_uri", "match_uri") == [("s1", "t1"), ("s2", "t1"), ("s3", None), ("s4", None)]
    assert rows(match.duplicate_keys(source, target)) == [("source", "gb", "1", 2), ("target", "gb", "2", 2)]
    assert rows(match.duplicate_keys(source.where("false"), target.where("false"))) == []


# graph


@pytest.mark.parametrize("edges, want", [([(k, k + 1) for k in range(40)], [(k, 0) for k in range(41)]), ([(5, k) for k in range(20) if k != 5], [(k, 0) for k in range(20)]), ([(1, 2), (2, 1), (3, 3), (7, None), (8, 9)], [(1, 1), (2, 1), (8, 8), (9, 8)]), ([], [])])
def test_components(spark, edges, want):
    df = spark.createDataFrame(edges, "src long, dst long")
    assert sorted(map(tuple, connected_components(df).collect())) == sorted(want)


def test_components_of_text_nodes(spark):
    assert rows(blocking.clusters(spark.createDataFrame([("b", "a10"), ("a10", "a9")], "source_id string, target_id string"))) == [("cc:a10", "a10"), ("cc:a10", "a9"), ("cc:a10", "b")]


# canonical


def test_dedupe_keeps_the_first_and_captures_the_rest(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 1), (None, 1), (" ", 2)], "k string, o int")
    kept, left = canonical.dedupe(df, "k", ["o"])
    assert rows(kept) == [("a", 1), ("b", 1)]
    assert rows(left) == sorted([("a", 2, "dropped", "duplicate_identity"), ("a", 1, "kept_counterpart", "duplicate_identity"), (None, 1, "dropped", "missing_identity"), (" ", 2, "dropped", "missing_identity")], key=str)


def test_successors_skip_cycles_forks_and_long_chains(spark):
    edges = [(1, 2), (2, 3), (4, 3), (5, 6), (6, 5), (7, 8), (7, 9), (10, 5)] + [(k, k + 1) for k in range(100, 140)]
    got = rows(canonical.terminal_successors(spark.createDataFrame(edges, "node long, successor long"), hop_cap=32))
    assert [r for r in got if r[0] < 100] == [(1, 3, 2), (2, 3, 1), (4, 3, 1)]
    assert len([r for r in got if r[0] >= 100]) == 32


def test_identity_and_names(spark):
    df = spark.createDataFrame([("gb://X1", ["A", "a ", "", None, "B"]), ("ab c/1", None), (" ", [" "])], "k string, names array<string>")
    uris = [r[0] for r in df.select(canonical.system_uri("gb", F.col("k"), F.col("k"))).collect()]
    assert uris[:2] == ["gb://X1", "gb://AB_C_1"] and uris[2].startswith("gb://fp/")
    assert [r[0] for r in df.select(canonical.name_list(F.col("names"))).collect()] == [["A", "B"], None, None]
    uri = canonical.variant_uri(F.lit("gb://1"), F.lit("alias"), F.lit("Acme"))
    assert df.select(canonical.source_uri_of(uri)).first()[0] == "gb://1"
    variants = canonical.name_rows(df, "k", {"alias": "names"}, sentinels=["b"])
    assert rows(variants) == [("gb://X1", "alias", "A"), ("gb://X1", "alias", "a")]
    assert rows(canonical.duplicate_variants(variants)) == []


def test_canonical_projection(spark):
    df = spark.createDataFrame([("x", None, "7"), (None, " y ", "12345678")], "Name string, OTHER string, num string")
    out = canonical.canonicalize(df, {"name": ["missing", "name", "other"], "number": canonical.pad_number(F.col("num"))})
    assert rows(out) == [("x", "00000007"), ("y", "12345678")]
    assert canonical.rename_aliases(df, {"num": "number", "Name": "OTHER"}).columns == ["Name", "OTHER", "number"]
    assert df.select(canonical.person_or_company(F.lit(None).cast("string"), F.lit("Jo"), F.lit("Doe"))).first()[0] == "Jo Doe"


def test_sizes_and_quotas(spark):
    assert canonical.sample_size(0) == 0 and canonical.sample_size(10) == 10 and canonical.sample_size(10**9) == 385
    assert canonical.quotas({"a": 5, "b": 3, "c": 2}, 5) == {"a": 3, "b": 1, "c": 1}
    assert sum(canonical.quotas({"a": 1, "b": 1}, 9).values()) == 2
    assert canonical.corpus_quotas({"a": 100, "b": 400}, mode="sqrt", target=30) == {"a": 10, "b": 20}
    assert canonical.corpus_quotas({"a": 5, "b": 400}, mode="equal", target=100, least=10, most=40) == {"a": 5, "b": 40}
    df = spark.range(100).withColumn("s", (F.col("id") % 2).cast("string"))
    assert rows(canonical.stratified_sample(df, "s", "id", {"0": 3, "1": 60}).groupBy("s").count()) == [("0", 3), ("1", 50)]


# cleansing


@pytest.mark.parametrize(
    "name, cleansed, kind, short, quoted, acronym",
    [
        ("Acme Holdings Limited", "acme holdings ltd", "ltd", "acme", None, None),
        ("The Big Fish Group PLC", "the big fish group plc", "plc", "big fish", None, None),
        ("Müller GmbH & Co. KG", "muller gmbh & co kg", "gmbh & co kg", "muller", None, None),
        ("(IBM) International Business Machines Inc.", "international business machines inc", "inc", "international business machines", None, "ibm"),
        ('"Varig" Viacao Aerea S.A.', "varig viacao aerea sa", "sa", "viacao aerea", "Varig", None),
        ("Limited", "limited", "private", "limited", None, None),
        ("Plain Name", "plain name", "private", "plain name", None, None),
        ("   ", None, None, None, None, None), (None, None, None, None, None, None),
    ],
)
def test_cleansing(spark, name, cleansed, kind, short, quoted, acronym):
    r = cleanse.cleanse(spark.createDataFrame([(name,)], "name string")).first()
    assert (r.name_cleansed, r.company_type, r.short_name, r.quoted_name, r.acronym) == (cleansed, kind, short, quoted, acronym)


def test_owners_and_source_types(spark):
    config = cleanse.CleanseConfig(owner_markers=["c/o"], source_type_col="t", source_types={"gesellschaft": "gmbh"})
    r = cleanse.cleanse(spark.createDataFrame([("Bakery c/o Jane Doe", "Gesellschaft")], "name string, t string"), config).first()
    assert (r.name_cleansed, r.personal_owner, r.company_type, r.company_type_source) == ("bakery", "Jane Doe", "gmbh", "source_mapping")


def test_compounds_and_short_candidates(spark):
    df = spark.createDataFrame([("dampfschifffahrt",)], "w string")
    assert df.select(cleanse.split_compound(F.col("w"), {"dampf": 90, "schiff": 80, "fahrt": 70, "schifffahrt": 10})).first()[0] == ["dampf", "schiff", "fahrt"]


@pytest.mark.parametrize(
    "words, layer, want",
    [
        ("international business machines", "exact_initials", "ibm"), ("solo", "exact_initials", None),
        ("bank of scotland plc", "subsequence_initials", "bs"), ("big machines", "subsequence_initials", None), ("bank of", "subsequence_initials", None),
        ("studio 54 ltd", "prefix_truncation", "studio"), ("studio", "prefix_truncation", None), ("54 ltd", "prefix_truncation", None),
        ("wasser-bau nord gmbh", "prefix_acronym", "wb nord"), ("wasser-bau gmbh", "prefix_acronym", "wb"), ("wasserbau nord", "prefix_acronym", None),
    ],
)
def test_short_name_layers(spark, words, layer, want):
    df = spark.createDataFrame([(words.split(),)], "w array<string>")
    assert df.select(cleanse.short_name_layer(F.col("w"), layer)).first()[0] == want


def test_short_name_layers_come_in_order(spark):
    df = spark.createDataFrame([(["bank", "of", "scotland", "plc"],), (["big", "machines"],), (["solo"],)], "w array<string>")
    assert [r[0] for r in df.select(cleanse.short_name_candidate(F.col("w"))).collect()] == ["bs", "bm", None]


@pytest.mark.parametrize(
    "profile, want",
    [("default", "big fish group"), ("default|-company_type", "big fish group ltd"), ("default|+noise_words:strict", "big fish"), ("default|-company_type|+noise_words:strict", "big fish group ltd")],
)
def test_preprocessing(spark, profile, want):
    df = spark.createDataFrame([("Big  Fish, Group Ltd.",), (None,), ("!!",)], "name string")
    assert [r.name_preprocessed for r in cleanse.preprocess_names(df, profile).collect()] == [want, None, None]
    for bad in ("x", "default|nope", "default|+noise_words"):
        with pytest.raises(ValueError):
            cleanse.parse_preprocessing(bad)


def test_power_law_against_log_normal():
    import numpy as np

    rng = np.random.default_rng(1)
    power = np.floor((1 - rng.random(20_000)) ** (-1 / 1.5) * 0.5 + 0.5).astype(int)
    got = tokenstats.power_law_fit(power)
    assert abs(got["alpha"] - 2.5) < 0.25 and got["ks_statistic"] < 0.05
    normal = np.round(rng.lognormal(3.0, 0.5, 20_000)).astype(int)
    assert tokenstats.power_law_fit(normal, least=1)["loglikelihood_ratio"] < -5
    assert tokenstats.power_law_fit([1, 1, 1])["p_value"] == 1.0


# token statistics and similarity


def test_idf_inverts_and_profiles_are_disjoint(spark):
    n, df = F.lit(100), F.col("df")
    got = spark.createDataFrame([(1,), (50,), (100,)], "df int").select("df", tokenstats.df_from_idf(n, tokenstats.idf(n, df)).alias("a"), tokenstats.df_from_idf(n, tokenstats.idf(n, df, False), False).alias("b")).collect()
    assert all(r.df == r.a == r.b for r in got)
    docs = spark.createDataFrame([(["the", "of", f"w{i % 7}", f"x{i % 40}"],) for i in range(200)], "t array<string>")
    got = tokenstats.noise_profiles(tokenstats.token_stats(docs, "t"), counts=(2, 4, 6), masses=(1.5, 1.0, 0.5)).collect()
    assert len({r.token for r in got}) == len(got)
    assert {r.token for r in got if r.profile == "strict"} == {"the", "of"}


def test_prefix_filter_equals_the_full_join(spark):
    import random

    rng = random.Random(1)
    docs = spark.createDataFrame([(i, [rng.choice("abcdefghijklmnopqrst") for _ in range(8)]) for i in range(120)], "id long, t array<string>")
    target, idf = similarity.sparse_vectors(docs, "id", "t")
    for least in (0.3, 0.6, 0.9):
        pairs_of = lambda df: {(r.source_id, r.target_id): round(r.similarity, 9) for r in df.collect()}
        full = pairs_of(similarity.cosine_top_k(target, target, top_k=1000, min_similarity=least))
        assert pairs_of(similarity.cosine_prefix_top_k(target, target, idf, top_k=1000, min_similarity=least)) == full
    with pytest.raises(ValueError):
        similarity.cosine_top_k(target, target, min_similarity=0)


def test_prefix_filter_over_lists_equals_the_full_join(spark, monkeypatch):
    import random

    rng = random.Random(3)
    rows_of = [(i, [rng.choice("abcdefghijklmnopqrst") + rng.choice("xy") for _ in range(9)] + [f"once{i}"]) for i in range(90)]
    # An id in two rows is one vector; no terms, null terms and null ids meet nothing.
    docs = spark.createDataFrame([*rows_of, (7, ["ax", "only"]), (200, []), (201, None), (202, ["ax", None]), (None, ["ax", "bx"])], "id long, t array<string>")
    lists = similarity.term_lists(docs, "id", "t")
    idf = similarity.fit_idf(lists, docs.count())
    target, order = similarity.sparse_vectors(docs, "id", "t")
    same = lambda df: sorted((r.term, r.df, round(r.idf, 12)) for r in df.where("term IS NOT NULL").collect())
    assert same(idf) == same(order)
    some = target.where("id % 3 = 0")
    pairs_of = lambda df, least: {(r.source_id, r.target_id): round(r.similarity, 9) for r in df.collect() if r.similarity >= least}
    full = similarity.cosine_prefix_top_k
    for least in (0.1, 0.5):
        want = pairs_of(full(some, target, order, top_k=1000, min_similarity=least), least)
        assert len(want) > 30
        # With few words in memory most terms are rare ones; with a very few the sources go the other way.
        for words in (1000, 400, 50):
            assert pairs_of(similarity.prefix_pairs_of_lists(some, lists, idf, min_similarity=least, words=words), least) == want
    # Vectors of lists are never joined as rows where the sources are few.
    def refused(*args, **kwargs):
        raise AssertionError("vectors as rows")

    monkeypatch.setattr(similarity, "prefix_pairs", refused)
    assert similarity.prefix_pairs_of_lists(some, lists, idf, min_similarity=0.5, words=400).count()
    with pytest.raises(ValueError):
        similarity.prefix_pairs_of_lists(some, lists, idf, min_similarity=0)


def test_dense_blocks_agree_and_svd_finds_most(spark):
    import random

    rng = random.Random(2)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(150)], "id long, vector array<double>")
    one = rows(similarity.dense_top_k(v, v, top_k=5, min_similarity=0.1), "source_id", "target_id", "rank")
    assert rows(similarity.dense_top_k(v, v, top_k=5, min_similarity=0.1, block=40), "source_id", "target_id", "rank") == one
    close = rows(similarity.svd_rerank_top_k(v, v, dims=4, shortlist=40, top_k=5, min_similarity=0.1), "source_id", "target_id", "rank")
    assert len(set(one) & set(close)) / len(one) > 0.8


def test_aliases_pools_and_gates(spark):
    target = spark.createDataFrame([(1, "Acme"), (2, "Bolt")], "id long, name string")
    alias = spark.createDataFrame([(1, "ACME"), (1, "Acme Trading"), (1, "Acme Trading"), (9, "Nobody"), (2, "Acme")], "id long, name string")
    assert rows(similarity.expand_aliases(target, alias)) == [(1, "Acme Trading"), (1, "Acme"), (2, "Acme"), (2, "Bolt")]
    words = spark.createDataFrame([(1, ["a", "b"]), (2, ["z"])], "id long, t array<string>")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [3.0, 2.0])], "token string, vector array<double>")
    assert rows(similarity.mean_pool(words, "id", "t", vectors)) == [(1, [2.0, 1.0])]
    with pytest.raises(ValueError):
        similarity.refuse_infeasible(10**9, 300, available_bytes=10**9)
    (v,) = similarity.hash_vectors(words.selectExpr("id", "t[0] AS x"), "id", "x", dims=10).where("id = 1").select("vector").first()
    assert abs(sum(x * x for x in v) - 1) < 1e-9 and len(v) == 10


# evaluation and comparison


def test_recall_at_similarity_one_is_free(spark):
    truth = spark.createDataFrame([(1, 10), (2, 20), (3, None)], "source_id long, target_id long")
    edges = spark.createDataFrame([(1, 10, 1.0, 1), (2, 21, 0.9, 1), (2, 20, 0.8, 2), (3, 30, 0.9, 1)], EDGE)
    assert rows(evaluate.recall_curve(truth, edges)) == [(0, 0, 1, 0.5), (1, 1, 1, 0.5), (2, 2, 2, 1.0)]
    (r,) = evaluate.truth_eval(evaluate.truth_detail(truth, edges), target_rows=3).collect()
    assert (r.tp, r.fp, r.fn, r.recall) == (2, 1, 0, 1.0) and abs(r.precision - 2 / 3) < 1e-9 and abs(r.reduction_ratio - 0.5) < 1e-9


def test_empty_evaluations_are_null(spark):
    none = spark.createDataFrame([], EDGE)
    (r,) = evaluate.truth_eval(evaluate.truth_detail(none.select("source_id", "target_id"), none), target_rows=3).collect()
    assert r.precision is None and r.recall is None
    (m,) = evaluate.run_metrics(none).collect()
    assert m.duplication_ratio is None
    assert evaluate.robustness_rollup(spark.createDataFrame([(0.5,)], "relative_recall double")).first().std is None


def test_name_equality_levels(spark):
    forms = ("raw", "basic", "cleansed")
    data = [("A", "A", "x", "y", None, "z"), ("A", "A", "a", "a", "a", "a"), ("A", "B", "a", "a", "a", "a"), ("A", "B", "a", "b", "c", "c"), ("A", "B", "a", "b", "c", "d")]
    df = spark.createDataFrame(data, "s_raw string, t_raw string, s_basic string, t_basic string, s_cleansed string, t_cleansed string")
    assert [r[0] for r in df.select(evaluate.name_equality(forms=forms)).collect()] == ["unknown", "raw", "basic", "cleansed", "never"]


def test_cascade_merge_and_prune(spark):
    s = spark.createDataFrame([(1, "A b", "a b"), (2, "C", "c"), (3, "", "")], "id long, raw string, basic string")
    t = spark.createDataFrame([(10, "A b", "a b"), (11, "a B", "a b"), (12, "c", "c"), (13, "", "")], "id long, raw string, basic string")
    exact = blocking.exact_cascade(s, t, ["raw", "basic"])
    assert rows(exact, "source_id", "target_id", "level", "rank") == [(1, 10, "raw", 1), (2, 12, "basic", 1)]
    scored = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.5, 2), (2, 11, 0.9, 1)], EDGE)
    merged = blocking.merge_edges(exact, scored)
    assert rows(merged, "source_id", "target_id", "similarity") == [(1, 10, 1.0), (1, 11, 0.5), (2, 11, 0.9), (2, 12, 1.0)]
    assert rows(blocking.ratio_prune(merged, 0.8), "source_id", "target_id") == [(1, 10), (2, 11), (2, 12)]
    assert rows(blocking.target_cap(merged, 1), "source_id", "target_id") == [(1, 10), (2, 11), (2, 12)]


def test_comparisons(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (None, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "y"), (2, None), (3, "w"), (None, "z")], "k int, v string")
    assert rows(compare.repeatability(a, b, ["k"], ["v"])) == [(1, "both", "v"), (3, "second_only", "v")]
    runs = {n: spark.createDataFrame([(p, 1)], "population_key string, m int") for n, p in (("a", "p"), ("b", "q"))}
    with pytest.raises(ValueError):
        compare.strategy_comparison(runs)
    assert rows(compare.runtime_scaling(spark.createDataFrame([(5, 1.0), (50, 2.0), (70, 4.0)], "rows long, seconds double"))) == [(0, 1, 1.0, 1.0, 1.0), (1, 2, 2.0, 3.0, 4.0)]
    level = lambda data: spark.createDataFrame(data, "source_id long, target_id long, name_equality string")
    assert rows(compare.level_transitions(level([(1, 1, "raw"), (2, 2, None)]), level([(1, 1, "never"), (2, 2, None)]))) == [("raw", "never", 1)]
    assert rows(compare.promotion(spark.createDataFrame([(0.9,), (0.1,), (None,)], "m double"), "m", 0.5), "verdict") == [("keep",), ("missing",), ("promote",)]
    assert rows(compare.melt_metrics(spark.createDataFrame([("r", 1, 0.5)], "run string, a int, b double"), ["run"])) == [("r", "a", 1.0), ("r", "b", 0.5)]
    assert rows(compare.missing_cells(a.select("k"), b.where("k = 1"), ["k"])) == [(2,), (None,)]


# pairs and perturbation


def test_pair_contract(spark):
    data = [("u1", "A", "B", 1, "train"), ("u1", "A", "B", 0, "test"), ("u2", "C", "C", 2, "train"), ("u3", "", "D", 1, "train")]
    got = dict(pairs.contract_faults(spark.createDataFrame(data, "system_uri string, left_name string, right_name string, label int, split string")).collect())
    assert got == {"missing_name": 1, "bad_label": 1, "equal_names": 1, "split_leakage": 1, "ambiguous": 1}


def test_negatives_stay_in_their_split(spark):
    pool = spark.createDataFrame([(f"u{i // 2}", f"name {i} corp") for i in range(300)], "system_uri string, name string")
    positives = spark.createDataFrame([(f"u{i}", f"name {2 * i} corp") for i in range(60)], "system_uri string, left_name string")
    out = pairs.negatives(positives, pool, random=2, hard=1)
    owner = {r.name: r.system_uri for r in pool.collect()}
    split = dict(pool.select("system_uri", pairs.entity_split(F.col("system_uri"))).distinct().collect())
    got = out.collect()
    assert got and all(split[owner[r.right_name]] == split[r.system_uri] == r.split and owner[r.right_name] != r.system_uri for r in got)
    assert rows(out) == rows(pairs.negatives(positives.repartition(3), pool.repartition(5), random=2, hard=1))


def test_every_positive_of_an_anchor_has_its_negatives(spark):
    pool = spark.createDataFrame([(f"u{i}", f"name {i} corp") for i in range(600)], "system_uri string, name string")
    positives = spark.createDataFrame([("u1", "name 1 corp", f"alias {k}") for k in range(40)], "system_uri string, left_name string, right_name string")
    got = pairs.negatives(positives, pool, random=2, hard=1).collect()
    kinds = {}
    for r in got:
        kinds.setdefault(r.positive_name, []).append(r.kind)
    assert {k: sorted(v) for k, v in kinds.items()} == {f"alias {k}": ["hard", "random", "random"] for k in range(40)}
    assert len({r.right_name for r in got}) > 40


def test_published_ids_parse():
    ids = "typo.keyboard_substitution typo.transposition typo.insertion typo.deletion typo.duplication word_order.word_shuffle low_salience.token_drop phonetic.soundex_swap transliteration.homoglyph_substitution diacritic_punct.diacritic_substitution diacritic_punct.separator_substitution legal_suffix.drop legal_suffix.variant_substitution".split()
    assert set(ids) == set(perturb.registry.operators)
    perturb.parse_profile({"profile_id": "p", "scenarios": [{"scenario_id": i, "chain": [{"operator_id": i, "probability": 0.5}]} for i in ids]})


def test_perturbation_repeats_and_keeps_lineage(spark):
    profile = perturb.parse_profile({"profile_id": "p", "scenarios": [{"scenario_id": "s", "chain": [{"operator_id": "typo.deletion", "probability": 1.0, "attempts": 1}]}], "exclusions": {"exclude_countries": ["fr"]}})
    df = spark.createDataFrame([(f"gb://{i}", "Acme Limited", "fr" if i == 3 else "gb") for i in range(8)], "system_uri string, name string, jurisdiction_code string")
    out = perturb.perturb(df, profile)
    assert rows(out) == rows(perturb.perturb(df.repartition(5), profile))
    got = {r.source_uri: r for r in out.collect()}
    assert not got["gb://3"].changed and got["gb://3"].scenario_id is None
    assert all(len(r.name) == 11 and r.changed for k, r in got.items() if k != "gb://3")
    assert {r[1] for r in perturb.quality_faults(out, df).collect()} == {0}
    with pytest.raises(KeyError):
        perturb.parse_profile({"profile_id": "p", "scenarios": [{"scenario_id": "s", "chain": [{"operator_id": "no.such", "probability": 1.0}]}]})


@pytest.mark.parametrize("name", sorted(perturb.registry.operators))
def test_every_operator_changes_a_name_it_has_sites_in(name):
    from random import Random

    text = "Acme Trading Holdings Limited"
    new, n = perturb.apply_operator(text, perturb.registry[name], Random(5), 1.0, 1)
    assert n == 1 and new != text
    assert perturb.apply_operator(text, perturb.registry[name], Random(5), 0.0, 9) == (text, 0)


def test_respelling_keeps_soundex(spark):
    from random import Random

    new, _ = perturb.apply_operator("Robert", perturb.registry["phonetic.soundex_swap"], Random(1), 1.0, 2)
    a, b = spark.range(1).select(F.soundex(F.lit("Robert")), F.soundex(F.lit(new))).first()
    assert a == b and new != "Robert"
    names = ["Wellington Partners", "Ashcroft", "Tymczak", "Pfister", "Jackson Tdmn"]
    changed = [(x, perturb.apply_operator(x, perturb.registry["phonetic.soundex_swap"], Random(k), 1.0, 3)[0]) for x in names for k in range(8)]
    out = spark.createDataFrame(changed, "a string, b string").select("a", "b", F.soundex("a").alias("x"), F.soundex("b").alias("y")).collect()
    assert all(r.x == r.y for r in out) and any(p.lower() != q.lower() and p.lower() not in "aeiouy" for r in out for p, q in zip(r.a, r.b, strict=True))


def test_wordpieces(spark):
    counts = {"low": 5, "lower": 2, "newest": 6, "widest": 3}
    assert "##est" in wordpiece.train_pieces(counts, 40, likelihood=False)
    vocabulary = wordpiece.train_pieces(counts, 60)
    got = spark.createDataFrame([("low newest",), ("zzz low",), (None,)], "x string").select(wordpiece.encode(F.col("x"), vocabulary)).collect()
    assert "".join(p.removeprefix("##") for p in got[0][0]) == "lownewest" and got[1][0][0] == "[UNK]" and got[2][0] == []
    assert wordpiece.rejection({"unk_rate": 0.5, "fertility": 2, "median_tokens": 3, "p95_tokens": 5}) == "unk_rate"
    runs = spark.createDataFrame([(100, 2, 0.10, 1.0, False), (100, 2, 0.2, 1.0, True), (200, 2, 0.08, 0.5, False), (300, 2, 0.01, 0.4, True)], "vocab_size int, min_frequency int, fertility_distance double, selection_score double, rejected boolean")
    assert wordpiece.best_pair(runs).first().vocab_size == 100
    assert math.isclose(wordpiece.selection_score({"fertility_distance": 0.1, "unk_rate": 0.01}, tolerance=0.1, unk_threshold=0.01), 2.0)


def test_text_classifier_learns(spark):
    data = [(f"good name {i}", 1.0) for i in range(30)] + [(f"bad thing {i}", 0.0) for i in range(30)]
    df = spark.createDataFrame(data, "text string, label double")
    scored = pairs.text_classifier(features=1 << 10).fit(df).transform(df)
    assert scored.where("prediction = label").count() == 60


def test_models_train_alike_and_are_compared(spark):
    data = [(i, f"good name {i}", 1.0) for i in range(30)] + [(30 + i, f"bad thing {i}", 0.0) for i in range(30)]
    df = spark.createDataFrame(data, "id long, text string, label double")
    build = lambda: pairs.text_classifier(features=1 << 8)
    got = {r.model: r for r in pairs.cross_train({"tri": build(), "bi": pairs.text_classifier(n=2, features=1 << 8)}, df, df, k=30).collect()}
    assert got["tri"].f1 == 1.0 and got["bi"].recall == 1.0 and got["tri"].recall_at_k == 1.0
    assert pairs.training_repeats(build, df, df)


def test_matches_of_derived_uris_and_folded_names(spark):
    derived = spark.range(1).select(F.explode(F.array(F.lit("gb://1"), canonical.variant_uri(F.lit("gb://1"), F.lit("a"), F.lit("b")), F.lit("gb://2"))).alias("uri"))
    matched = spark.createDataFrame([("gb://1", "ie://9")], "system_uri string, match_uri string")
    assert [r[1:] for r in rows(canonical.resolve_matches(derived, matched))] == [("gb://1", "ie://9"), ("gb://2", None), ("gb://1", "ie://9")]
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "node string, successor string")
    names = spark.createDataFrame([("a", "Alpha"), ("b", "Beta"), ("c", "Gamma")], "uri string, name string")
    assert rows(canonical.fold_successor_names(edges, names)) == [("b", "predecessor", "Alpha"), ("c", "chain_predecessor", "Alpha"), ("c", "predecessor", "Beta")]
