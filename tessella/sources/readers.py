"""Readers for the source formats: delimited, JSON lines, XML, zip members, triples, benchmark tables, partitions."""

from __future__ import annotations

import csv
from collections.abc import Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMBER_BYTES = 512 << 20


def detect_separator(sample: str, candidates: str = ",;\t|") -> str:
    """The delimiter of a sample of lines; a comma if none is clear."""
    try:
        return csv.Sniffer().sniff(sample, candidates).delimiter
    except csv.Error:
        counts = {c: sample.split("\n", 1)[0].count(c) for c in candidates}
        best = max(counts, key=counts.get)
        return best if counts[best] else ","


def read_csv(spark: SparkSession, path: str, *, sep: str | None = None) -> DataFrame:
    """A CSV with a header, all columns text; the delimiter is found in the first lines unless given."""
    if sep is None:
        sep = detect_separator("\n".join(r[0] for r in spark.read.text(path).limit(20).collect()))
    return spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    """JSON lines, plain or compressed; array brackets and trailing commas of a dump written one item a line are taken off."""
    lines = spark.read.text(path).select(F.regexp_replace(F.trim("value"), ",$", "").alias("value")).where("value NOT IN ('', '[', ']')")
    if schema is None:
        schema = spark.read.json(lines.rdd.map(lambda r: r[0])).schema if lines.limit(1).count() else T.StructType()
    return lines.select(F.from_json("value", schema).alias("j")).select("j.*")


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str | T.StructType | None = None) -> DataFrame:
    """The repeated elements of XML files."""
    reader = spark.read.format("xml").option("rowTag", row_tag)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def zip_members(spark: SparkSession, path: str, suffixes: Sequence[str]) -> DataFrame:
    """path, member, content of zip members with one of the suffixes.

    An archive is one row of a task, as its directory is at its end; members over 512 MB raise, as they wouldn't fit a row.
    """
    import io
    import zipfile

    import pandas as pd

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, data in zip(batch["path"], batch["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(data)) as archive:
                    for info in archive.infolist():
                        if info.filename.lower().endswith(tuple(suffixes)):
                            if info.file_size > MEMBER_BYTES:
                                raise ValueError(f"{name}: {info.filename} has {info.file_size} bytes; unpack it first")
                            yield pd.DataFrame({"path": [name], "member": [info.filename], "content": [archive.read(info)]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, member string, content binary")


def read_zip_csv(spark: SparkSession, path: str, schema: str, *, sep: str = ",") -> DataFrame:
    """Rows of the CSV members of zip files, with a header line, by a schema of text columns."""
    text = zip_members(spark, path, [".csv"]).select(F.decode("content", "utf-8").alias("text"))
    lines = text.select(F.posexplode(F.split("text", r"\r?\n")).alias("n", "line")).where("n > 0 AND line <> ''")
    return lines.select(F.from_csv("line", schema, {"sep": sep}).alias("r")).select("r.*")


def read_zip_xml(spark: SparkSession, path: str, element: str, schema: str, *, root: str | None = None) -> DataFrame:
    """Elements of the XML members of zip files, by a schema; root: the local name the root must have."""
    text = zip_members(spark, path, [".xml"]).select(F.decode("content", "utf-8").alias("text"))
    if root:
        local = F.regexp_extract("text", r"<(?![?!])(?:[\w.-]+:)?([\w.-]+)", 1)
        text = text.where(F.when(local == root, True).otherwise(F.raise_error(F.concat(F.lit(f"the root is not {root} but "), local)).cast("boolean")))
    tag = rf"(?:[\w.-]+:)?{element}"
    found = text.select(F.explode(F.regexp_extract_all("text", F.lit(rf"(?s)(<{tag}[ >].*?</{tag}>)"), 1)).alias("x"))
    plain = F.regexp_replace(F.regexp_replace("x", r"<(/?)[\w.-]+:", "<$1"), r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    return found.select(F.from_xml(plain, schema).alias("r")).select("r.*")


def read_source(spark: SparkSession, path: str, kind: str, **options) -> DataFrame:
    """parquet, csv, json or jsonl (also compressed), xml (row_tag) or zip of CSV (schema)."""
    readers = {"parquet": lambda: spark.read.parquet(path), "csv": lambda: read_csv(spark, path, **options), "json": lambda: spark.read.option("multiLine", True).json(path), "jsonl": lambda: read_json_lines(spark, path, **options), "xml": lambda: read_xml(spark, path, **options), "zip": lambda: read_zip_csv(spark, path, **options)}
    if kind not in readers:
        raise ValueError(f"unknown format {kind!r}; known: {', '.join(readers)}")
    return readers[kind]()


def flatten(df: DataFrame, *, joiner: str = "_", repeated: str = " | ") -> DataFrame:
    """Struct leaves as columns with joined names; arrays of plain values as text of their distinct values."""

    def leaves(kind: T.DataType, at: Column, name: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [leaf for f in kind.fields for leaf in leaves(f.dataType, at.getField(f.name), f"{name}{joiner}{f.name.lstrip('_')}" if name else f.name)]
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, T.StructType):
                return [leaf for f in kind.elementType.fields for leaf in leaves(T.ArrayType(f.dataType), at.getField(f.name), f"{name}{joiner}{f.name.lstrip('_')}")]
            return [F.array_join(F.array_distinct(at.cast("array<string>")), repeated).alias(name)]
        return [at.alias(name)]

    return df.select(*(leaf for f in df.schema.fields for leaf in leaves(f.dataType, F.col(f"`{f.name}`"), f.name)))


def paired_rows(df: DataFrame, id_col: str, array_col: str, fields: Mapping[str, str]) -> DataFrame:
    """One row for each struct of an array: id and the named fields (new name: field)."""
    return df.select(id_col, F.explode(array_col).alias("s")).select(id_col, *(F.col(f"s.{f}").alias(name) for name, f in fields.items()))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """subject, predicate, object, language of N-Triples lines; comments and other lines are passed over."""
    form = r'^<([^>]*)>\s+<([^>]*)>\s+(?:<([^>]*)>|"((?:[^"\\]|\\.)*)"(?:@([\w-]+)|\^\^<[^>]*>)?)\s*\.\s*$'
    part = lambda k: F.regexp_extract("value", form, k)
    return spark.read.text(path).where(F.col("value").rlike(form)).select(part(1).alias("subject"), part(2).alias("predicate"), F.when(part(3) != "", part(3)).otherwise(part(4)).alias("object"), F.nullif(part(5), F.lit("")).alias("language"))


def pivot_triples(triples: DataFrame, predicates: Mapping[str, str]) -> DataFrame:
    """subject and one column for each predicate (URI: name), the smallest object of several."""
    named = F.create_map(*(F.lit(x) for p in predicates.items() for x in p))
    return triples.where(F.col("predicate").isin(list(predicates))).withColumn("name", named[F.col("predicate")]).groupBy("subject").pivot("name", list(predicates.values())).agg(F.min("object"))


def project_json(lines: DataFrame, fields: Mapping[str, str], *, markers: Sequence[str] = (), column: str = "value") -> DataFrame:
    """JSON paths as columns of lines that contain every marker; the markers are tested before any parsing."""
    kept = lines
    for marker in markers:
        kept = kept.where(F.col(column).contains(marker))
    return kept.select(*(F.get_json_object(column, path).alias(name) for name, path in fields.items()))


def claim_values(entity: Column, property_id: str, path: str = "$.mainsnak.datavalue.value") -> Column:
    """Values of an entity's claims of a property, as JSON text; deprecated claims are left out."""
    claims = F.from_json(F.get_json_object(entity, f"$.claims.{property_id}"), "array<string>")
    kept = F.filter(claims, lambda c: F.coalesce(F.get_json_object(c, "$.rank"), F.lit("normal")) != "deprecated")
    return F.filter(F.transform(kept, lambda c: F.get_json_object(c, path)), lambda v: v.isNotNull())


def claim_date(entity: Column, property_id: str) -> Column:
    """The first time claim as yyyy-MM-dd."""
    return F.regexp_extract(F.get(claim_values(entity, property_id, "$.mainsnak.datavalue.value.time"), F.lit(0)), r"^\+?(\d{4}-\d{2}-\d{2})", 1)


def union_shards(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows with the union of columns, missing ones null."""
    first, *rest = frames
    for df in rest:
        first = first.unionByName(df, allowMissingColumns=True)
    return first


def read_projected(spark: SparkSession, path: str, columns: Sequence[str], *, non_empty: str | None = None) -> DataFrame:
    """Wanted columns of Parquet, absent ones as null; non_empty: a column that must not be blank. Both reach the scan."""
    df = spark.read.parquet(path)
    if non_empty:
        df = df.where(F.col(non_empty).isNotNull() & (F.trim(non_empty) != ""))
    return df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns))


def read_country(spark: SparkSession, path: str, country: str) -> DataFrame:
    """One jurisdiction's partition of a partitioned layer; the filter prunes the others."""
    return spark.read.parquet(path).where(F.col("jurisdiction_code") == country.lower())


def partition_values(spark: SparkSession, path: str, column: str = "jurisdiction_code") -> list[str]:
    """Partition values of a layer, from the directory listing only."""
    rows = spark.read.parquet(path).select(column).distinct().collect()
    return sorted(str(r[0]) for r in rows if r[0] is not None)


def read_benchmark(spark: SparkSession, root: str, *, id_col: str = "id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables A and B of a two-table benchmark (id, text: other columns joined by spaces) and its matches (left_id, right_id)."""

    def table(name: str) -> DataFrame:
        df = spark.read.option("header", True).option("escape", '"').csv(f"{root}/{name}.csv")
        return df.select(F.col(id_col).alias("id"), F.concat_ws(" ", *(F.nullif(F.trim(c), F.lit("")) for c in df.columns if c != id_col)).alias("text"))

    matches = spark.read.option("header", True).csv(f"{root}/matches.csv")
    return table("tableA"), table("tableB"), matches.select(F.col("ltable_id").alias("left_id"), F.col("rtable_id").alias("right_id"))
