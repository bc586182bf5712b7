"""Operators do the whole job: no fixed cut that hot keys or more rows would pass."""

import random

import pytest

from tessella.operators import canonical, similarity
from tessella.operators.graph import connected_components
from tessella.plans import candidates

LARGE = "/root/testdata/sf0.1"


def found(edges):
    return {(r.source_id, r.target_id) for r in edges.collect()}


def test_svd_rerank_finds_the_exact_top_on_the_large_table(spark):
    exact = found(candidates.dense_topk(spark, LARGE))
    top = found(candidates.svd_rerank(spark, LARGE).where("source_id <> target_id"))
    # The query counts a vector among its own ten.
    nearest = {(r.source_id, r.target_id) for r in candidates.dense_topk(spark, LARGE).where("rank <= 9").collect()}
    assert top <= exact and len(top & nearest) / len(nearest) == 1.0


@pytest.mark.parametrize("dims,shortlist", [(2, 10), (4, 40), (5, 3)])
def test_svd_rerank_is_exact_whatever_its_shortlist(spark, dims, shortlist):
    rng = random.Random(3)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)], "id long, vector array<double>")
    exact = {(r.source_id, r.target_id, r.rank) for r in similarity.dense_top_k(v, v, top_k=5, min_similarity=0.1).collect()}
    got = similarity.svd_rerank_top_k(v, v, dims=dims, shortlist=shortlist, top_k=5, min_similarity=0.1)
    assert {(r.source_id, r.target_id, r.rank) for r in got.collect()} == exact


def test_components_join_groups_beyond_any_list_of_neighbours(spark, tmp_path):
    # Two groups of 1,010 equal vectors, at a cosine of 0.5: each member has over 1,000 neighbours of its own.
    rows = [(i, [1.0, 0.0] if i % 2 else [0.5, 0.75**0.5], 0) for i in range(2020)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = candidates.connected_components(spark, str(tmp_path)).groupBy("cluster_id").count().collect()
    assert [tuple(r) for r in got] == [("cc:0", 2020)]


def test_links_of_blocks_have_the_components_of_all_pairs(spark):
    rng = random.Random(4)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)], "id long, vector array<double>")
    part = lambda edges: sorted(map(tuple, connected_components(edges, "source_id", "target_id").collect()))
    every = part(similarity.dense_top_k(v, v, top_k=200, min_similarity=0.85))
    assert len({c for _, c in every}) > 2
    assert part(similarity.dense_links(v, min_similarity=0.85)) == part(similarity.dense_links(v, min_similarity=0.85, block=30)) == every


def test_successor_chains_reach_as_far_as_the_reference(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(55)], "node long, successor long")
    got = {r.start: (r.terminal, r.hops) for r in canonical.terminal_successors(edges).collect()}
    assert got == {k: (55, 55 - k) for k in range(6, 55)}
    names = spark.createDataFrame([(15, "Old")], "uri long, name string")
    folded = canonical.fold_successor_names(edges, names).collect()
    assert sorted((r.source_uri, r.name_type) for r in folded) == [(16, "predecessor"), (55, "chain_predecessor")]


def test_normalized_odd_letters_are_those_of_the_sql(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    import __spark_entry__ as e
    from oracle import DATA, TABLES, compare

    texts = ["&", " And ", "band et", "ΟΔΟΣ ΑΣ", "ｆｕｌｌ ª ſ µ", "が각각", "Ⅷ a‿b x‍y ²", "Ω Å İ", "x࢘ࡰ \U00010570", "a _ b", "", None]
    pq.write_table(pa.table({"doc_id": range(len(texts)), "text": texts}), tmp_path / "documents.parquet")
    for name in TABLES:
        if name != "documents":
            (tmp_path / f"{name}.parquet").symlink_to(f"{DATA}/{name}.parquet")
    compare(spark, e.queries()["normalize_default"], e.oracle_sql()["normalize_default"], str(tmp_path))


def test_lsh_lists_of_copies_need_no_pairs_of_copies(spark):
    # 900 million pairs of copies before.
    rows = spark.range(30_000).selectExpr("id", "transform(sequence(1, 64), x -> if(id % 2 = 0, x, if(x <= 4, x, 0L))) signature")
    got = similarity.lsh_top_k(rows, rows, top_k=3, min_similarity=0.05)
    assert got.count() == 90_000
    (even,), (odd,) = (got.where(f"source_id = {k}").groupBy().agg({"target_id": "collect_set"}).collect() for k in (29_998, 29_999))
    assert set(even[0]) == {0, 2, 4} and set(odd[0]) == {1, 3, 5}


def test_routed_search_in_blocks_finds_what_all_pairs_of_a_cluster_have(spark):
    rng = random.Random(5)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(6)], i % 3) for i in range(240)], "id long, vector array<double>, cluster int")
    got = found(similarity.routed_top_k(v, v, top_k=5, min_similarity=0.1, block=30))
    want = set()
    for k in range(3):
        part = v.where(f"cluster = {k}")
        want |= found(similarity.dense_top_k(part, part, top_k=5, min_similarity=0.1))
    assert got == want
