import math

import pytest
from pyspark.sql import functions as F

from tessella.operators import analysis, encoder, resolve, vocabsearch, wordpiece, workflow


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


FORMS = "id long, country string, raw string, basic string"


@pytest.fixture(scope="module")
def sides(spark):
    source = spark.createDataFrame([(1, "gb", "Acme Ltd", "acme ltd"), (2, "gb", "Bolt & Nut", "bolt nut works"), (3, "ie", "Acme Ltd", "acme ltd"), (4, "fr", "Rien", "rien"), (5, "gb", "", "")], FORMS)
    target = spark.createDataFrame([(10, "gb", "Acme Ltd", "acme ltd"), (11, "gb", "ACME LTD", "acme ltd"), (12, "gb", "Bolt Nut", "bolt nut"), (13, "ie", "Other", "other"), (14, "gb", "", "")], FORMS)
    return source, target


def test_a_run_cascades_scores_and_stays_in_its_country(sides):
    run = workflow.run_blocking(*sides, forms=["raw", "basic"], score=workflow.tfidf_score(lambda c: F.split(c, " "), min_similarity=0.1), text="basic", min_similarity=0.3)
    assert {(r.source_id, r.target_id) for r in run.edges.collect()} == {(1, 10), (2, 12)}
    assert rows(run.clusters) == [("cc:1", "1"), ("cc:1", "10"), ("cc:12", "12"), ("cc:12", "2")]
    assert run.distribution.agg(F.sum("edges")).first()[0] == 2
    assert run.coverage.first().sources == 4 and run.coverage.first().covered == 2
    assert run.shape.first().clusters == 2


def test_missed_pairs_are_scored_again(spark, sides):
    target = sides[1].where("basic <> ''").select("id", "country", F.col("basic").alias("text"))
    source = sides[0].select("id", "country", F.col("basic").alias("text"))
    truth = spark.createDataFrame([(1, 10), (2, 12), (4, 13)], "source_id long, target_id long")
    edges = spark.createDataFrame([(1, 10, 1.0)], "source_id long, target_id long, similarity double")
    got = rows(workflow.rescore_missed(truth, edges, source, target, score=workflow.tfidf_score(lambda c: F.split(c, " "), min_similarity=0.1)))
    assert [r[:2] for r in got] == [(2, 12), (4, 13)] and got[0][2] > 0.5 and got[1][2] is None


def test_variants_find_their_entity(spark, sides):
    variants = spark.createDataFrame([(100, 10, "gb", "acme limited ltd"), (101, 12, "gb", "nothing alike")], "id long, source_uri long, country string, text string")
    target = sides[1].where("basic <> ''").select("id", "country", F.col("basic").alias("text"))
    (r,) = workflow.variant_recovery(variants, target, score=workflow.tfidf_score(lambda c: F.split(c, " "), min_similarity=0.1), min_similarity=0.2).collect()
    assert (r.tp, r.fn, r.recall) == (1, 1, 0.5)
    truth, edges = variants.select(F.col("id").alias("source_id"), F.col("source_uri").alias("target_id")), spark.createDataFrame([(100, 10, 0.9, 1)], "source_id long, target_id long, similarity double, rank int")
    assert workflow.validation_matrix({("a", "b"): (truth, edges, 4), ("a", "c"): (truth, edges.where("false"), 4)}).count() == 2


def test_states_and_reasons(spark):
    states = spark.createDataFrame([(True, True, True), (False, True, True), (False, False, True), (None, None, None), (True, False, True)], "name_equal boolean, basic_equal boolean, cleansed_equal boolean")
    assert rows(analysis.overlap_states(states)) == [(s, 1, 20.0) for s in ("All equal", "All mismatch", "Name + basic mismatch", "Name mismatch only", "Other pattern")]
    data = spark.createDataFrame([(None, "", None), (None, "1", None), (None, None, "lei"), ("t", "1", None)], "match_uri string, company_number string, lei string")
    assert rows(analysis.unmatched_reasons(data, "company_number", ["lei"])) == [("MISSING_COMPANY_NUMBER", 2, 66.67), ("NO_MATCHING_COMPANY", 1, 33.33)]
    names = spark.createDataFrame([(None, ""), ("", "b"), ("a", None), ("a", "b"), ("a", "a")], "source_name string, target_name string")
    assert {r[0] for r in analysis.disagreement_reasons(names).collect()} == {"BOTH_NAMES_MISSING", "SOURCE_NAME_MISSING", "TARGET_NAME_MISSING", "BOTH_PRESENT_DIFFERENT"}


def test_random_level_is_low_and_repeats(spark):
    pairs = spark.createDataFrame([(i, f"{chr(97 + i % 26) * 5} name{i}", f"{chr(97 + i % 26) * 5} name{i}") for i in range(800)], "source_id long, source_name string, target_name string")
    level = analysis.random_level(pairs).first().level
    assert 0.1 < level < 0.9 and level == analysis.random_level(pairs.repartition(3)).first().level
    assert analysis.with_name_similarity(pairs, level).where("above_random").count() == 800


def test_vocabulary_search():
    points = {1000: 3.0, 2000: 2.0, 4000: 1.0}
    assert math.isclose(vocabsearch.interpolate(points, 2000), 2.0) and math.isclose(vocabsearch.interpolate(points, math.sqrt(1000 * 2000)), 2.5)
    assert math.isclose(vocabsearch.interpolate(points, 8000), 0.0, abs_tol=1e-9)
    assert math.isclose(vocabsearch.crossing(points, 1.5), math.sqrt(2000 * 4000)) and vocabsearch.crossing(points, 9) is None
    assert math.isclose(vocabsearch.slope_at(points, 1500), -1 / math.log(2) / 1500)
    assert math.isclose(vocabsearch.noise_unit(3.0, 2), 3.0) and vocabsearch.refine_step(1.0, -0.001) == 1000 and vocabsearch.refine_step(1.0, 0.0) == 100
    assert vocabsearch.refine_points(2500, 2000, 4000, 400) == [2100, 2500, 2900] and vocabsearch.refine_points(2100, 2000, 4000, 400) == [2100, 2500]
    assert vocabsearch.fit_check(points, 2.0, [(2000, 0.05), (4000, 3.0)], 0.1)[0][2] is True
    kept = vocabsearch.frontier({(2, 1000): 0.5, (2, 2000): 0.1, (2, 4000): 0.12, (2, 8000): 5.0}, top_k=1, tolerance=0.05)
    assert kept == {(2, 2000), (2, 4000)}
    assert vocabsearch.frontier({(2, 1000): 0.5, (2, 2000): 0.1}, top_k=2, tolerance=0.0, most=0.2) == {(2, 2000)}
    assert vocabsearch.bracket({(2, 1), (2, 2), (2, 3), (5, 9)}, 2, 2) == (1, 2, 3) and vocabsearch.bracket({(2, 1), (2, 2)}, 2, 2) is None
    assert vocabsearch.prune_reason(runs=4, passes=0, fertilities=[9.0] * 4, seeds=5, pass_rate=0.5, low=1, high=3) == "pass_rate_out_of_reach"
    assert vocabsearch.prune_reason(runs=2, passes=0, fertilities=[9.0, 8.0], seeds=9, pass_rate=0.5, low=1, high=3) == "fertility_out_of_range"
    for bad in (lambda: vocabsearch.noise_unit(1.0, 0), lambda: vocabsearch.refine_points(1, 3, 2, 1), lambda: vocabsearch.interpolate({1: 1.0}, 2)):
        with pytest.raises(ValueError):
            bad()


def test_encoder_pulls_pairs_together(spark):
    left = [f"alpha{i} corp" for i in range(20)]
    right = [f"omega{i} inc" for i in range(20)]
    start, end = (encoder.train_encoder(left + left, right + right[::-1], [1] * 20 + [0] * 20, epochs=e) for e in (0, 8))
    near = lambda m: sum(m.vector(a) @ m.vector(b) for a, b in zip(left, right, strict=True))
    assert near(end) > near(start) + 1
    (v,) = spark.createDataFrame([("alpha1 corp",)], "x string").select(end.embed(F.col("x"))).first()
    assert abs(sum(x * x for x in v) - 1) < 1e-9


def test_resolver(spark):
    edges = spark.createDataFrame([(1, 10, 0.95), (1, 11, 0.94), (2, 10, 0.97), (3, 10, 0.7), (4, 10, 0.1)], "source_id long, target_id long, score double")

    class Given:
        def retrieve(self, source):
            return edges.join(source, "source_id")

        def score(self, candidates):
            return candidates

    out = resolve.Resolver(Given(), Given(), resolve.ThresholdPolicy(lead=0.05)).resolve(spark.range(1, 9).withColumnRenamed("id", "source_id"))
    assert rows(out) == [(1, 10, 0.95, "review"), (2, 10, 0.97, "match"), (3, 10, 0.7, "review")]


def test_several_tokenizers_and_the_table_function(spark):
    df = spark.createDataFrame([("the low newest",)], "x string")
    got = wordpiece.tokenize_columns(df, "x", {"a": ["l", "##o", "##w", "low", "newest"], "b": ["l", "##ow"]}, noise=["THE"]).first()
    assert got.a == ["low", "newest"] and got.b == ["l", "##ow", "[UNK]"]
    wordpiece.register_ngram_table_function(spark, "grams_of")
    assert [tuple(r) for r in spark.sql("SELECT * FROM grams_of('abcd', 3)").collect()] == [(0, "abc"), (1, "bcd")]


def test_blocks_and_a_cut_for_the_ranks_keep_every_ranked_edge(spark):
    import random

    from tessella.operators.similarity import rank_edges

    rng = random.Random(6)
    rows = [(k, "ab"[k % 2], " ".join(rng.choices("one two three four five six seven eight nine ten".split(), k=6))) for k in range(120)]
    docs = spark.createDataFrame(rows, "id long, country string, text string")
    sides = docs.where("id < 60"), docs.where("id >= 60")
    ranked = lambda **more: sorted(map(tuple, rank_edges(workflow.tfidf_score(lambda c: F.split(c, " "), min_similarity=0.1, **more)(*sides).withColumn("similarity", F.round("similarity", 6)), 3, 0.1).collect()))
    assert ranked(top_k=3, slack=2e-6, block=8) == ranked()


def shuffled(df):
    """Records that the shuffles of a collected DataFrame wrote."""
    todo, total = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if node.metrics().contains("shuffleRecordsWritten"):
            total += node.metrics().apply("shuffleRecordsWritten").value()
        kind = node.getClass().getSimpleName()
        todo += [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind == "ShuffleQueryStageExec" else [node.children().apply(k) for k in range(node.children().size())]
    return total


def test_blocks_get_a_row_a_vector_and_every_way_to_the_terms_agrees(spark):
    import random

    rng = random.Random(7)
    docs = spark.createDataFrame([(k, "ab"[k % 2], " ".join(f"w{int(rng.paretovariate(0.6))}" for _ in range(200))) for k in range(200)], "id long, country string, text string")
    repeated = docs.union(docs.where("id % 10 = 0").selectExpr("id", "country", "'w1 w2 seldom' AS text"))
    for rows in (docs, repeated):
        sides = rows.where("id < 100"), rows.where("id >= 100")
        score = lambda **more: workflow.tfidf_score(lambda c: F.split(c, " "), min_similarity=0.1, **more)(*sides)  # noqa: B023, E731
        found = lambda df: {(r.source_id, r.target_id): round(r.similarity, 9) for r in df.collect()}
        whole = score(block=25)
        every = found(whole)
        assert shuffled(whole) <= 2 * 2 * 100
        assert every and found(score(broadcast_rows=0)) == every == found(score())
        assert found(score(floor=0.5)) == {k: v for k, v in every.items() if v >= 0.5}
