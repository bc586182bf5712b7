"""Canonical entity rows: identity, derived columns, dedupe, successor chains, name variants, samples."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import clean_text
from tessella.storage import materialize


def find_column(df: DataFrame, candidates: Sequence[str]) -> list[str]:
    """The candidates that exist, whatever their case, in their order."""
    known = {c.lower(): c for c in df.columns}
    return [known[c.lower()] for c in candidates if c.lower() in known]


def first_text(df: DataFrame, candidates: Sequence[str]) -> Column:
    """The first non-blank of the candidates that exist; null if none does."""
    found = find_column(df, candidates)
    return F.coalesce(*(clean_text(F.col(c).cast("string")) for c in found)) if found else F.lit(None).cast("string")


def rename_aliases(df: DataFrame, aliases: Mapping[str, str]) -> DataFrame:
    """Renames what is present where the new name is absent."""
    return df.withColumnsRenamed({old: new for old, new in aliases.items() if old in df.columns and new not in df.columns})


def system_uri(system: str, key: Column, *row: Column, seed: int = 0) -> Column:
    """A key that is a URI of the system as it is; else system:// and the key upper-cased with other runs as '_'; without a key, a hash of the row."""
    text = clean_text(key.cast("string"))
    slug = F.regexp_replace(F.regexp_replace(F.upper(text), "[^A-Z0-9._~-]+", "_"), "^_+|_+$", "")
    base = F.lit(f"{system}://")
    return F.when(text.startswith(f"{system}://"), text).when(slug != "", F.concat(base, slug)).otherwise(F.concat(base, F.lit("fp/"), F.lower(F.hex(F.xxhash64(F.lit(seed), *row)))))


def split_columns(df: DataFrame, main: Sequence[str], key: str = "system_uri") -> tuple[DataFrame, DataFrame]:
    """Contract columns and the rest, both with the key."""
    kept = [c for c in df.columns if c in main and c != key]
    return df.select(key, *kept), df.select(key, *(c for c in df.columns if c not in kept and c != key))


def filter_countries(df: DataFrame, codes: Sequence[str], candidates: Sequence[str]) -> DataFrame:
    """Rows with a supported code in any candidate column; all rows if no candidate exists."""
    found = find_column(df, candidates)
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(F.upper(c).isin([x.upper() for x in codes]), F.lit(False)) for c in found))) if found else df


def name_list(c: Column) -> Column:
    """A text array without blanks and without repeats that differ in case only, first spelling kept; null without any."""
    clean = F.filter(F.transform(c, clean_text), lambda x: x.isNotNull())
    kept = F.filter(clean, lambda x, i: ~F.array_contains(F.transform(F.slice(clean, 1, i), F.lower), F.lower(x)))
    return F.when(F.size(kept) > 0, kept)


def pad_number(number: Column, width: int = 8) -> Column:
    """An all-digit number shorter than width with leading zeros."""
    text = clean_text(number.cast("string"))
    return F.when(text.rlike("^[0-9]+$") & (F.length(text) < width), F.lpad(text, width, "0")).otherwise(text)


def scoped_number(authority: Column, number: Column) -> Column:
    """authority|number, null if either is missing."""
    a, n = clean_text(authority), clean_text(number)
    return F.when(a.isNotNull() & n.isNotNull(), F.concat_ws("|", a, n))


def court_number(raw: Column) -> tuple[Column, Column]:
    """Court and id of a '_'-joined register number: the last two parts, null if there are fewer."""
    parts = F.split(raw, "_")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)), F.when(F.size(parts) >= 2, F.element_at(parts, -1))


def person_or_company(company: Column, given: Column, surname: Column) -> Column:
    """The company's name, else given name and surname, else the surname."""
    g, s = clean_text(given), clean_text(surname)
    return F.coalesce(clean_text(company), F.when(s.isNotNull(), F.concat_ws(" ", g, s)))


def crosswalk(df: DataFrame, table: DataFrame, on: str, to: str) -> DataFrame:
    """df with `to` from a lookup table (code, value); unknown codes have null."""
    return df.join(table.select(F.col("code").alias(on), F.col("value").alias(to)), on, "left")


def canonicalize(df: DataFrame, columns: Mapping[str, Column | Sequence[str]], *, exclude: Column | None = None) -> DataFrame:
    """One projection to the contract's columns, in its order: expressions, or candidate columns for the first non-blank."""
    rows = df if exclude is None else df.where(~F.coalesce(exclude, F.lit(False)))
    return rows.select(*((c if isinstance(c, Column) else first_text(df, c)).alias(name) for name, c in columns.items()))


def dedupe(df: DataFrame, key: str, order: Sequence[str | Column]) -> tuple[DataFrame, DataFrame]:
    """(first row of each non-blank key by order, rows left out with capture_role and dropped_reason).

    Rows without a key are left out as missing_identity; later rows of a key as duplicate_identity; the surviving row of such
    a key is also there, as kept_counterpart.
    """
    place = W.partitionBy(key)
    numbered = df.withColumn("_n", F.row_number().over(place.orderBy(*order))).withColumn("_of", F.count("*").over(place))
    blank = F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == "")
    kept = numbered.where(~blank & (F.col("_n") == 1)).drop("_n", "_of")
    role = F.when(blank | (F.col("_n") > 1), "dropped").otherwise("kept_counterpart")
    reason = F.when(blank, "missing_identity").otherwise("duplicate_identity")
    left = numbered.where(blank | (F.col("_of") > 1)).withColumn("capture_role", role).withColumn("dropped_reason", reason).drop("_n", "_of")
    return kept, left


def dedupe_report(df: DataFrame, key: str, most: int = 10_000) -> DataFrame:
    """key, rows of keys with several rows, the greatest first; a report of at most `most` rows."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("rows")).where("rows > 1").orderBy(F.desc("rows"), key).limit(most)


def partition_key(c: Column) -> Column:
    """Lower-cased partition value; Spark's null partition for blank."""
    return F.lower(clean_text(c))


def terminal_successors(edges: DataFrame, *, hop_cap: int = 49) -> DataFrame:
    """start, terminal, hops: the ends of successor chains (node, successor) through nodes with exactly one successor.

    Chains that run into a cycle or over hop_cap are left out; the default is the reference's, 49 hops. Pointer doubling: a round joins the table with itself, so
    a chain of n hops takes log2(n) rounds.
    """
    one = edges.where("node <> successor").distinct().groupBy("node").agg(F.count("*").alias("n"), F.min("successor").alias("next")).where("n = 1").select("node", "next")
    jumps = materialize(one.select("node", "next", F.lit(1).alias("hops")), "jumps")
    for _ in range(max(1, math.ceil(math.log2(hop_cap)) + 1)):
        step = jumps.select(F.col("node").alias("next"), F.col("next").alias("after"), F.col("hops").alias("more"))
        jumps = materialize(jumps.join(step, "next", "left").select("node", F.coalesce("after", "next").alias("next"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "jumps")
    ends = jumps.join(one.select(F.col("node").alias("next")), "next", "left_anti")
    return ends.where(F.col("hops") <= hop_cap).select(F.col("node").alias("start"), F.col("next").alias("terminal"), "hops")


def best_name(names: DataFrame, priority: Sequence[str]) -> DataFrame:
    """source_uri, name: of each entity's Latin-script variants (source_uri, name_type, name), the one of the first type, then name."""
    rank = reduce(lambda w, k: w.when(F.col("name_type") == priority[k], k), range(len(priority)), F.when(F.lit(False), -1)).otherwise(len(priority))
    order = W.partitionBy("source_uri").orderBy(rank, "name")
    return names.where(F.col("name").rlike(r"\p{IsLatin}")).withColumn("n", F.row_number().over(order)).where("n = 1").select("source_uri", "name")


def name_rows(df: DataFrame, uri: str, fields: Mapping[str, str], *, sentinels: Sequence[str] = ()) -> DataFrame:
    """source_uri, name_type, name: one row for each non-blank name field (text or array; field by type) that is no sentinel."""

    def named(kind: str, column: str) -> Column:
        values = F.col(column) if dict(df.dtypes)[column].startswith("array") else F.array(F.col(column))
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("name_type"), clean_text(v).alias("name")))

    lists = [named(kind, column) for kind, column in fields.items()]
    rows = df.select(F.col(uri).alias("source_uri"), F.explode(F.concat(*(F.coalesce(x, F.array().cast("array<struct<name_type:string,name:string>>")) for x in lists))).alias("v")).select("source_uri", "v.name_type", "v.name")
    return rows.where(F.col("name").isNotNull() & ~F.lower("name").isin([s.lower() for s in sentinels]) if sentinels else F.col("name").isNotNull())


def name_hash(kind: Column, value: Column) -> Column:
    """SHA-256 over length-prefixed type and value."""
    part = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    return F.sha2(F.concat(part(kind), part(value)), 256)


def variant_uri(source_uri: Column, kind: Column, value: Column) -> Column:
    """name://system/id/hash of an entity's name variant."""
    return F.concat(F.lit("name://"), F.regexp_replace(source_uri, "://", "/"), F.lit("/"), name_hash(kind, value))


def source_uri_of(uri: Column) -> Column:
    """The entity of a derived URI, one step back; other URIs as they are."""
    return F.when(uri.rlike("^(name|perturbed)://"), F.concat(F.regexp_extract(uri, r"^[a-z]+://([^/]+)/", 1), F.lit("://"), F.regexp_extract(uri, r"^[a-z]+://[^/]+/(.+)/[^/]+$", 1))).otherwise(uri)


def duplicate_variants(names: DataFrame) -> DataFrame:
    return names.groupBy("source_uri", "name_type", "name").agg(F.count("*").alias("rows")).where("rows > 1")


def sample_size(population: int, z: float = 1.96, margin: float = 0.05, proportion: float = 0.5) -> int:
    """Cochran's size with finite-population correction, within 1..population; 0 for no population."""
    if population <= 0:
        return 0
    n0 = z * z * proportion * (1 - proportion) / (margin * margin)
    return max(1, min(population, math.ceil(n0 / (1 + (n0 - 1) / population))))


def quotas(rows: Mapping[str, int], total: int) -> dict[str, int]:
    """Shares of total by rows: whole parts, then largest remainders (ties: more rows), no more than the rows."""
    everything = sum(rows.values())
    total = min(total, everything)
    if not everything:
        return dict.fromkeys(rows, 0)
    exact = {k: total * n / everything for k, n in rows.items()}
    out = {k: min(rows[k], int(v)) for k, v in exact.items()}
    for k in sorted(rows, key=lambda k: (-(exact[k] - int(exact[k])), -rows[k], k)):
        if sum(out.values()) >= total:
            break
        out[k] += out[k] < rows[k]
    return out


def stratified_sample(df: DataFrame, by: str, key: str, sizes: Mapping[str, int], *, seed: int = 42) -> DataFrame:
    """The given number of rows of each stratum, the first by a hash of seed and key."""
    wanted = df.sparkSession.createDataFrame([(str(k), int(v)) for k, v in sizes.items()] or [("", 0)], "stratum string, quota long")
    order = W.partitionBy(by).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key)
    return df.withColumn("n", F.row_number().over(order)).join(F.broadcast(wanted), F.col(by).cast("string") == F.col("stratum")).where("n <= quota").drop("n", "stratum", "quota")


def corpus_quotas(rows: Mapping[str, int], *, mode: str, target: int, least: int = 0, most: int | None = None) -> dict[str, int]:
    """Rows to take of each system: equal, sqrt or proportional shares of target, then clamped to least, most and what there is, in this order."""
    weight = {"equal": lambda n: 1.0, "sqrt": math.sqrt, "proportional": float}[mode]
    total = sum(weight(n) for n in rows.values()) or 1.0
    out = {k: int(target if mode == "constant" else target * weight(n) / total) for k, n in rows.items()}
    return {k: min(rows[k], min(max(v, least), most if most is not None else rows[k])) for k, v in out.items()}


def null_profile(df: DataFrame, contract: Sequence[str]) -> DataFrame:
    """column, dtype, present, nulls, rows of each contract column, in one aggregate."""
    kinds = dict(df.dtypes)
    cells = [F.struct(F.lit(c).alias("column"), F.lit(kinds.get(c)).cast("string").alias("dtype"), F.lit(c in kinds).alias("present"), (F.count_if(F.col(c).isNull()) if c in kinds else F.count("*")).alias("nulls"), F.count("*").alias("rows")).alias(f"c{k}") for k, c in enumerate(contract)]
    return df.agg(*cells).select(F.explode(F.array(*(F.col(f"c{k}") for k in range(len(contract))))).alias("p")).select("p.*")


def resolve_matches(uris: DataFrame, matched: DataFrame) -> DataFrame:
    """uri, entity, match_uri: derived URIs led back to their entities (two steps at most) and these entities' matches."""
    entity = source_uri_of(source_uri_of(F.col("uri")))
    return uris.select("uri", entity.alias("entity")).join(matched.select(F.col("system_uri").alias("entity"), "match_uri"), "entity", "left").select("uri", "entity", "match_uri")


def fold_successor_names(edges: DataFrame, names: DataFrame, *, hop_cap: int = 49) -> DataFrame:
    """source_uri, name_type, name: names (uri, name) of predecessors on their direct successors and on the terminals of their chains, without repeats.

    edges: node, successor. A terminal that is the direct successor has the name once, as predecessor.
    """
    direct = edges.where("node <> successor").select("node", F.col("successor").alias("source_uri"), F.lit("predecessor").alias("name_type"), F.lit(0).alias("k"))
    ends = terminal_successors(edges, hop_cap=hop_cap).select(F.col("start").alias("node"), F.col("terminal").alias("source_uri"), F.lit("chain_predecessor").alias("name_type"), F.lit(1).alias("k"))
    rows = direct.union(ends).join(names.select(F.col("uri").alias("node"), "name"), "node")
    return rows.groupBy("source_uri", "name").agg(F.min(F.struct("k", "name_type")).alias("m")).select("source_uri", "m.name_type", "name")
