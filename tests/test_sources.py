import bz2
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tessella.sources import readers, writers
from tessella.streaming.windows import dedupe_stream, score_stream, windowed_counts


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("sep", [",", ";", "\t", "|"])
def test_delimiters_are_found(spark, tmp_path, sep):
    (tmp_path / "x.csv").write_text(sep.join(("id", "name")) + "\n" + sep.join(("1", "Acme")) + "\n" + sep.join(("2", "Bolt")) + "\n")
    assert rows(readers.read_source(spark, str(tmp_path / "x.csv"), "csv")) == [("1", "Acme"), ("2", "Bolt")]


def test_json_lines_of_a_dump(spark, tmp_path):
    lines = "[\n" + ",\n".join(json.dumps({"id": f"Q{i}", "n": i}) for i in range(3)) + "\n]\n"
    (tmp_path / "d.json.bz2").write_bytes(bz2.compress(lines.encode()))
    assert rows(readers.read_json_lines(spark, str(tmp_path / "d.json.bz2"))) == [("Q0", 0), ("Q1", 1), ("Q2", 2)]


XML = """<?xml version="1.0"?><ns:Records xmlns:ns="urn:x"><ns:Rec><ns:Id>1</ns:Id><ns:Entity><ns:Name type="a">Acme</ns:Name></ns:Entity></ns:Rec><ns:Rec><ns:Id>2</ns:Id></ns:Rec></ns:Records>"""


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("data.csv", "id,name\n1,Acme\n2,Bolt\n")
        z.writestr("data.xml", XML)
        z.writestr("readme.txt", "no")
    path = str(tmp_path / "a.zip")
    assert rows(readers.read_source(spark, path, "zip", schema="id string, name string")) == [("1", "Acme"), ("2", "Bolt")]
    schema = "Id string, Entity struct<Name: string>"
    assert rows(readers.flatten(readers.read_zip_xml(spark, path, "Rec", schema, root="Records"))) == [("1", "Acme"), ("2", None)]
    with pytest.raises(Exception, match="root"):
        readers.read_zip_xml(spark, path, "Rec", schema, root="Other").collect()
    with pytest.raises(ValueError):
        readers.read_source(spark, path, "tar")


def test_xml_flatten_and_paired_rows(spark, tmp_path):
    (tmp_path / "x.xml").write_text("<R><Rec><Id>1</Id><N><v>a</v></N><N><v>b</v></N><Tag>t</Tag><Tag>t</Tag><Tag>u</Tag></Rec></R>")
    df = readers.read_xml(spark, str(tmp_path / "x.xml"), "Rec", "Id string, N array<struct<v: string>>, Tag array<string>")
    assert rows(readers.flatten(df)) == [("1", "a | b", "t | u")]
    assert rows(readers.paired_rows(df, "Id", "N", {"name": "v"})) == [("1", "a"), ("1", "b")]


def test_triples(spark, tmp_path):
    (tmp_path / "t.nt").write_text('# note\n<http://a> <http://p/name> "Acme \\"x\\""@en .\n<http://a> <http://p/sameAs> <http://b> .\nbroken\n')
    got = readers.read_triples(spark, str(tmp_path / "t.nt"))
    assert rows(got) == [("http://a", "http://p/name", 'Acme \\"x\\"', "en"), ("http://a", "http://p/sameAs", "http://b", None)]
    assert rows(readers.pivot_triples(got, {"http://p/name": "name", "http://p/none": "none"})) == [("http://a", 'Acme \\"x\\"', None)]


def test_claims(spark):
    entity = {"id": "Q1", "claims": {"P1": [{"rank": "normal", "mainsnak": {"datavalue": {"value": "x"}}}, {"rank": "deprecated", "mainsnak": {"datavalue": {"value": "y"}}}], "P2": [{"mainsnak": {"datavalue": {"value": {"time": "+2001-02-03T00:00:00Z"}}}}]}}
    df = spark.createDataFrame([(json.dumps(entity),), ('{"id": "Q2", "claims": {}}',)], "value string")
    assert rows(readers.project_json(df, {"id": "$.id"}, markers=['"P1"'])) == [("Q1",)]
    r = df.select(readers.claim_values(F.col("value"), "P1"), readers.claim_date(F.col("value"), "P2")).first()
    assert r[0] == ["x"] and r[1] == "2001-02-03"


def test_partitions_chunks_and_projection(spark, tmp_path):
    df = spark.createDataFrame([("GB", "a", 1), ("gb ", "b", 2), ("IE", " ", 3), (None, "d", 4), (" ", "e", 5)], "jurisdiction_code string, name string, n int")
    path = str(tmp_path / "layer")
    writers.write_partitioned(df, path)
    assert readers.partition_values(spark, path) == ["gb", "ie"]
    assert sorted(r.n for r in readers.read_country(spark, path, "GB").collect()) == [1, 2]
    got = readers.read_projected(spark, path, ["name", "absent"], non_empty="name")
    assert rows(got) == [("a", None), ("b", None), ("d", None), ("e", None)]
    writers.write_chunked(spark.range(10).coalesce(1), str(tmp_path / "flat"), rows_per_file=3)
    assert len(list((tmp_path / "flat").glob("*.parquet"))) == 4
    assert rows(readers.union_shards([df.select("n"), df.select("name").limit(1)]))[0] is not None


def test_benchmark_layout(spark, tmp_path):
    (tmp_path / "tableA.csv").write_text('id,title,brand\n1,"Big, red",x\n')
    (tmp_path / "tableB.csv").write_text("id,title,brand\n9,thing,\n")
    (tmp_path / "matches.csv").write_text("ltable_id,rtable_id\n1,9\n")
    a, b, m = readers.read_benchmark(spark, str(tmp_path))
    assert rows(a) == [("1", "Big, red x")] and rows(b) == [("9", "thing")] and rows(m) == [("1", "9")]


def test_vector_sql_runs_in_duckdb():
    import duckdb

    con = duckdb.connect()
    con.execute(writers.create_table_sql("v", {"embedding": 3}, store="duckdb"))
    insert = writers.upsert_sql("v", mark="?")
    con.execute(insert, ["a", "x", [1.0, 0.0, 0.0]])
    con.execute(insert, ["b", "y", [0.0, 1.0, 0.0]])
    con.execute(insert, ["b", "z", [0.0, 1.0, 0.0]])
    for kind in ("cosine", "l2", "ip"):
        q = writers.nearest_sql("v", limit=2, distance=kind, store="duckdb").replace("embedding, ?", "embedding::FLOAT[], ?::FLOAT[]")
        assert [r[:2] for r in con.execute(q, [[0.1, 0.9, 0.0]]).fetchall()] == [("b", "z"), ("a", "x")]
    assert "vector(3)" in writers.create_table_sql("v", {"e": 3}) and "<=>" in writers.nearest_sql("v", limit=1) and "vector_l2_ops" in writers.create_index_sql("v", distance="l2")
    with pytest.raises(ValueError):
        writers.create_table_sql("v; DROP", {"e": 3})


def test_streams(spark, tmp_path):
    from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

    schema = StructType([StructField("id", LongType()), StructField("ts", TimestampType()), StructField("kind", StringType())])
    spark.createDataFrame([(1, None, "a")], schema).where("false").write.parquet(str(tmp_path / "in"))
    spark.range(6).selectExpr("id % 3 AS id", "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id * 20 AS INT)) AS ts", "'a' AS kind").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = dedupe_stream(stream, "id", "ts").writeStream.format("memory").queryName("deduped").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).start()
    assert query.awaitTermination(120)
    assert sorted(r.id for r in spark.table("deduped").collect()) == [0, 1, 2]
    batch = windowed_counts(spark.read.parquet(str(tmp_path / "in")), "ts", "kind", "id")
    assert sorted(r.events for r in batch.collect()) == [3, 3]
    target = spark.createDataFrame([(1, "t1")], "id long, name string")
    query = score_stream(stream, lambda b: b.join(target, "id"), str(tmp_path / "out"), str(tmp_path / "c2"))
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
