"""Queries that write a table in a source format under the shared folder and read it back, and queries over nested records."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessella.registry import query, table
from tessella.sources import readers, writers
from tessella.storage import shared_path


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, replace(c_mktsegment, 'M', ';\"m\n') AS segment FROM customer")
def csv_round_trip(spark, sf_dir):
    """Delimited files whose separator is found in the text; values hold separators, quotes and line breaks."""
    path = shared_path(spark, "csv")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.replace("c_mktsegment", F.lit("M"), F.lit(';"m\n')).alias("segment"))
    rows.write.option("header", True).option("sep", ";").option("escape", '"').csv(path)
    return readers.read_source(spark, path, "csv")


@query("SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part")
def json_lines_round_trip(spark, sf_dir):
    """A bzip2 dump with array brackets and trailing commas."""
    path = shared_path(spark, "jsonl")
    item = F.concat(F.to_json(F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))), F.lit(","))
    lines = table(spark, sf_dir, "part").select(item.alias("value"))
    lines.union(spark.createDataFrame([("[",), ("]",), ("",)], "value string")).write.option("compression", "bzip2").text(path)
    return readers.read_source(spark, path, "jsonl", schema="id long, name string, size int")


@query("SELECT c_custkey, c_name, 'machinery' AS jurisdiction_code FROM customer WHERE c_mktsegment = 'MACHINERY'")
def partition_round_trip(spark, sf_dir):
    """One jurisdiction of a partitioned layer."""
    path = shared_path(spark, "layer")
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 50 == 0, F.concat(F.lit(" "), "c_mktsegment")).otherwise(F.col("c_mktsegment")).alias("jurisdiction_code"))
    writers.write_partitioned(rows, path, rows_per_file=100_000)
    return readers.read_country(spark, path, "MACHINERY")


@query("SELECT o_orderkey, o_orderpriority, NULL::VARCHAR AS missing FROM orders WHERE trim(o_orderpriority) <> ''")
def projected_round_trip(spark, sf_dir):
    """Row-bounded files read by wanted columns, one of them absent."""
    path = shared_path(spark, "chunks")
    writers.write_chunked(table(spark, sf_dir, "orders"), path, rows_per_file=100_000)
    return readers.read_projected(spark, path, ["o_orderkey", "o_orderpriority", "missing"], non_empty="o_orderpriority")


@query("SELECT p_partkey AS id, p_name AS name, p_brand AS brand FROM part WHERE p_size <> 7")
def xml_round_trip(spark, sf_dir):
    """Repeated elements of XML files."""
    path = shared_path(spark, "xml")
    rows = table(spark, sf_dir, "part").where("p_size <> 7").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("brand"))
    rows.write.format("xml").option("rootTag", "parts").option("rowTag", "part").save(path)
    return readers.read_source(spark, path, "xml", row_tag="part", schema="id long, name string, brand string")


@query("SELECT 'http://parts/' || p_partkey AS subject, p_name AS label, CASE WHEN p_size % 2 = 0 THEN 'http://brands/' || p_partkey END AS brand FROM part")
def triples_round_trip(spark, sf_dir):
    """N-Triples as one row a subject; comments and other predicates are passed over, the smallest of several objects stays."""
    path = shared_path(spark, "triples")
    subject = F.concat(F.lit("<http://parts/"), F.col("p_partkey"), F.lit("> "))
    label = lambda text, tag: F.concat(subject, F.lit('<http://p/label> "'), text, F.lit(f'"{tag} .'))
    lines = F.array(label(F.col("p_name"), "@en"), label(F.concat(F.lit("~"), "p_name"), ""), F.concat(subject, F.lit("<http://p/size> <http://sizes/1> .")), F.lit("# a comment"), F.when(F.col("p_size") % 2 == 0, F.concat(subject, F.lit("<http://p/brand> <http://brands/"), F.col("p_partkey"), F.lit("> ."))).otherwise(""))
    table(spark, sf_dir, "part").select(F.explode(lines).alias("value")).write.text(path)
    return readers.pivot_triples(readers.read_triples(spark, path), {"http://p/label": "label", "http://p/brand": "brand"})


@query("SELECT 'Q' || o_orderkey AS id, o_orderpriority AS priorities, strftime(o_orderdate, '%Y-%m-%d') AS founded FROM orders WHERE o_orderstatus = 'F'")
def entity_claims(spark, sf_dir):
    """Claims of JSON entities that hold a marker: values without deprecated ones, and a date."""
    value = lambda v: F.struct(F.struct(v.alias("value")).alias("datavalue"))
    claim = lambda v, rank: F.struct(value(v).alias("mainsnak"), F.lit(rank).alias("rank"))
    time = F.struct(F.concat(F.lit("+"), F.date_format("o_orderdate", "yyyy-MM-dd'T00:00:00Z'")).alias("time"))
    claims = F.struct(F.array(claim(F.lit("old"), "deprecated"), claim(F.col("o_orderpriority"), "normal")).alias("P1"), F.array(claim(time, "preferred")).alias("P2"))
    entity = F.to_json(F.struct(F.concat(F.lit("Q"), F.col("o_orderkey")).alias("id"), F.concat(F.lit("status "), F.col("o_orderstatus")).alias("state"), claims.alias("claims")))
    lines = readers.project_json(table(spark, sf_dir, "orders").select(entity.alias("value")), {"id": "$.id", "entity": "$"}, markers=['"status F"'])
    return lines.select("id", F.array_join(readers.claim_values(F.col("entity"), "P1"), ",").alias("priorities"), readers.claim_date(F.col("entity"), "P2").alias("founded"))


@query("SELECT p_partkey AS id, p_name AS entity_name, p_brand || ' | ' || p_type AS entity_tags, p_brand || ' | x' AS entity_other_kind FROM part")
def flat_records(spark, sf_dir):
    """Nested records as columns with joined names, arrays as text of their distinct values."""
    other = F.array(F.struct(F.col("p_brand").alias("kind")), F.struct(F.lit("x").alias("kind")), F.struct(F.lit("x").alias("kind")))
    nested = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.struct(F.col("p_name").alias("name"), F.array("p_brand", "p_type", "p_brand").alias("tags"), other.alias("other")).alias("entity"))
    return readers.flatten(nested)


@query("SELECT p_partkey, 'trade' AS kind, p_name AS name FROM part UNION ALL SELECT p_partkey, 'brand', p_brand FROM part")
def paired_records(spark, sf_dir):
    rows = F.array(F.struct(F.lit("trade").alias("type"), F.col("p_name").alias("text")), F.struct(F.lit("brand").alias("type"), F.col("p_brand").alias("text")))
    return readers.paired_rows(table(spark, sf_dir, "part").select("p_partkey", rows.alias("names")), "p_partkey", "names", {"kind": "type", "name": "text"})


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def united_shards(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return readers.union_shards([customer, table(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))])
