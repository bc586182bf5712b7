from edges import odd

import corpus_pipeline
from tessella.llm.minhash import near_duplicates
from tessella.storage import materialize

DATA = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = docs.count()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), "stage")
        kept[name] = docs
        if name != "pack":
            assert docs.columns == COLUMNS
    assert 0.8 * before < kept["toxicity"].count() < before
    assert kept["line_dedup"].count() == kept["toxicity"].count()
    assert kept["minhash_neardup"].count() < kept["line_dedup"].count()
    assert near_duplicates(kept["minhash_neardup"]).where("NOT kept").count() == 0
    # What is near a document in the untouched texts is gone, although line dedup left most of it in pieces, and no row is empty.
    copies = near_duplicates(spark.read.parquet(f"{DATA}/documents.parquet").join(kept["toxicity"].select("doc_id"), "doc_id", "left_semi")).where("NOT kept").select("doc_id")
    assert copies.count() > 60 and copies.join(kept["minhash_neardup"], "doc_id", "left_semi").count() == 0
    assert kept["minhash_neardup"].where("trim(text) = ''").count() == 0
    # No other document goes than copies, whole or as left by line dedup, and those of which nothing is left.
    gone = kept["line_dedup"].join(kept["minhash_neardup"].select("doc_id"), "doc_id", "left_anti").where("trim(text) <> ''")
    left = near_duplicates(kept["line_dedup"]).where("component_id <> doc_id OR NOT kept").select("doc_id")
    assert gone.join(copies, "doc_id", "left_anti").join(left, "doc_id", "left_anti").count() <= 2
    sizes = [r[1] for r in kept["mix_sources"].selectExpr("source", "length(text) AS n").groupBy("source").sum("n").collect()]
    assert max(sizes) < 4 * min(sizes)
    assert kept["pack"].count() == kept["mix_sources"].count()
    run = corpus_pipeline.run(spark, DATA)
    key = lambda df: sorted((r.doc_id, r.bucket, r.batch, r.slot) for r in df.select("doc_id", "bucket", "batch", "slot").collect())
    assert key(run) == key(kept["pack"])


def test_stages_take_odd_input(spark):
    docs = odd(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), "odd")
    assert docs.count() > 0


def test_stages_take_an_empty_table(spark):
    docs = odd(spark).where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, DATA), "none")
    assert docs.count() == 0
