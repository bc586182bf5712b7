"""Packing documents into token-budget batches of optimal length buckets."""

from __future__ import annotations

from array import array
from bisect import bisect_left

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessella.functions.columns import fresh
from tessella.llm.mixing import hashed_uniform
from tessella.storage import materialize, small


def word_count(text: Column) -> Column:
    """Maximal runs of characters other than space and 0x09-0x0D; 0 for null."""
    clean = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.coalesce(F.length(clean), F.lit(0)) == 0, F.lit(0)).otherwise(F.size(F.split(clean, r"[ \t-\r]+"))).cast("long")


def optimal_bounds(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """The upper bounds of at most `buckets` length buckets that minimise total padding; exact.

    histogram: (length, documents). A bucket pads its documents to its longest, so its cost is
    bound * documents - tokens. cost(k, j) = min over i of cost(k - 1, i) + bound(j) * (docs(j) - docs(i)) - (tokens(j) - tokens(i))
    is, for each j, the lowest of lines with falling slopes -docs(i) at rising points bound(j); a hull of lines gives
    each layer in linear time. Ties take the smaller i.
    """
    histogram = sorted((int(x), int(n)) for x, n in histogram if n > 0)
    size = len(histogram)
    if size <= buckets:
        return [x for x, _ in histogram]
    docs, tokens = [0], [0]
    for x, n in histogram:
        docs.append(docs[-1] + n)
        tokens.append(tokens[-1] + n * x)
    cost: list[int | None] = [0, *[None] * size]
    back: list[array] = []
    for _ in range(buckets):
        hull: list[tuple[int, int, int]] = []  # slope, offset, i
        head, now, chosen = 0, [None] * (size + 1), array("l", [0]) * (size + 1)
        for j in range(1, size + 1):
            i = j - 1
            if cost[i] is not None:
                slope, offset = -docs[i], cost[i] + tokens[i]
                while len(hull) - head >= 2 and (offset - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) < (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                    hull.pop()
                hull.append((slope, offset, i))
            if head < len(hull):
                x = histogram[j - 1][0]
                while head + 1 < len(hull) and hull[head + 1][0] * x + hull[head + 1][1] < hull[head][0] * x + hull[head][1]:
                    head += 1
                now[j] = hull[head][0] * x + hull[head][1] + x * docs[j] - tokens[j]
                chosen[j] = hull[head][2]
        cost = now
        back.append(chosen)
    out, j = [], size
    for chosen in reversed(back):
        out.append(histogram[j - 1][0])
        j = chosen[j]
        if j == 0:
            break
    return out[::-1]


def pack(docs: DataFrame, *, length: Column | None = None, buckets: int = 16, budget: int = 65_536, slice_rows: int | None = None, seed: int = 42, parts: int | None = None, broadcast_rows: int = 200_000) -> DataFrame:
    """Deal documents to batches of at most `budget` padded tokens within length buckets of least padding.

    1. Lengths are counted into a slim table. Their histogram, one row for each different length, goes to the driver,
       where dynamic programming over all of it finds the bucket bounds exactly.
    2. In bucket b, padded to L tokens, a batch holds max(1, floor(budget / L)) documents.
    3. Within a bucket, documents are numbered by a number hashed from seed and doc_id. A bucket is cut into slices of the
       number's range, as many as its share of the tokens and documents gives it of `parts` (by default
       spark.sql.shuffle.partitions), so there are at most parts + buckets + 1. The slim table's counts give each slice
       its start. A task gets one slice, sorts it, and numbers its rows as they pass; no window holds whole texts, and a
       slice's documents are of one bucket, so the pages of a file hold rows of like length. Every batch but a bucket's
       last is full. slice_rows cuts slices of about so many documents instead.

    length: tokens of a document; by default the words of text. Null and negative lengths count as 0; documents of
    length 0 are packed with the shortest bucket, at most `budget` in a batch.

    Nulls and odd input: a null or empty text has length 0. Null doc_ids and rows that repeat a doc_id are numbered
    like others; equal rows are interchangeable. If the table has columns n_tokens, bucket, padded_to, batch or slot,
    those are replaced. An empty table gives an empty result.

    Returns the columns of docs, n_tokens, bucket (from 0), padded_to, batch (from 0 in the bucket), slot (from 0 in
    the batch).
    """
    spark = docs.sparkSession
    docs = docs.drop("n_tokens", "bucket", "padded_to", "batch", "slot")
    draw, part, start, own = fresh(docs, "draw", "part", "start", "own_part")
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_tokens = F.greatest(F.coalesce((word_count(F.col("text")) if length is None else length).cast("long"), F.lit(0)), F.lit(0))
    number = hashed_uniform(F.lit(seed), F.col("doc_id"))
    slim = materialize(docs.select(n_tokens.alias("n_tokens"), number.alias(draw)), "lengths")
    histogram = [(r[0], r[1]) for r in slim.groupBy("n_tokens").agg(F.count("*").alias("n")).collect()]
    bounds = optimal_bounds(histogram, buckets) or [0]
    rows, weights = [0] * len(bounds), [0] * len(bounds)
    for x, n in histogram:
        k = bisect_left(bounds, x)
        rows[k] += n
        weights[k] += n * (x + 64)  # a short document costs more than its words
    total = max(1, sum(weights))
    slices = [max(1, -(-n // slice_rows) if slice_rows else -(-parts * w // total)) for n, w in zip(rows, weights, strict=True)]
    before = [sum(slices[:k]) for k in range(len(slices))]

    def placed(df: DataFrame) -> DataFrame:
        bucket = F.lit(len(bounds) - 1)
        for k in reversed(range(len(bounds) - 1)):
            bucket = F.when(F.col("n_tokens") <= bounds[k], k).otherwise(bucket)
        at = lambda values: F.get(F.array(*(F.lit(v) for v in values)), F.col("bucket"))
        return df.withColumn("bucket", bucket.cast("int")).withColumn(part, (at(before) + F.floor(F.col(draw) * at(slices))).cast("int"))

    sizes = placed(slim).groupBy("bucket", part).agg(F.count("*").alias("n"))
    starts = sizes.select(F.col(part).alias(own), F.coalesce(F.sum("n").over(W.partitionBy("bucket").orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(start))
    starts = small(materialize(starts, "starts"), broadcast_rows)
    # The explode of one element keeps the optimizer from counting words anew wherever n_tokens is used.
    wide = placed(docs.select("*", F.explode(F.array(n_tokens)).alias("n_tokens")).withColumn(draw, number))
    ties = [F.xxhash64("text")] if "text" in docs.columns else []
    dealt = wide.repartitionById(sum(slices), F.col(part)).sortWithinPartitions(part, draw, "doc_id", "n_tokens", *ties)
    # A partition is one slice, so the row's number in its partition is its number in the slice.
    ranked = dealt.withColumn("slot", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))).join(starts, F.col(part) == F.col(own))
    padded = F.get(F.array(*(F.lit(b).cast("long") for b in bounds)), F.col("bucket"))
    numbered = ranked.withColumn("padded_to", padded.cast("long")).withColumn("slot", F.col(start) + F.col("slot"))
    holds = F.greatest(F.floor(F.lit(budget) / F.greatest("padded_to", F.lit(1))), F.lit(1)).cast("long")
    return numbered.select(*docs.columns, "n_tokens", "bucket", "padded_to", F.floor(F.col("slot") / holds).cast("long").alias("batch"), (F.col("slot") % holds).cast("int").alias("slot"))


def pack_sql(buckets: int = 16, budget: int = 65_536, seed: int = 42) -> str:
    """DuckDB SQL for pack() over documents with the defaults; each layer of the dynamic program is one self-join of the histogram."""
    layers = ["c0 AS (SELECT 0 AS j, 0::HUGEINT AS cost)"]
    for k in range(1, buckets + 1):
        layers.append(
            f"c{k} AS (SELECT j, min(cost) AS cost, min_by(i, (cost, i)) AS i FROM (SELECT h.j, p.j AS i, p.cost + h.x::HUGEINT * (h.docs - coalesce(q.docs, 0)) - (h.tokens - coalesce(q.tokens, 0)) AS cost"
            f" FROM h JOIN c{k - 1} p ON p.j < h.j LEFT JOIN h q ON q.j = p.j) GROUP BY j)"
        )
    paths = [f"p{buckets} AS (SELECT max(j) AS j FROM h)"] + [f"p{k} AS (SELECT c.i AS j FROM c{k + 1} c JOIN p{k + 1} p ON p.j = c.j)" for k in range(buckets - 1, 0, -1)]
    bounds = " UNION ".join(f"SELECT j FROM p{k}" for k in range(1, buckets + 1))
    return f"""
WITH m AS (SELECT *, CASE WHEN length(t) = 0 THEN 0 ELSE len(string_split_regex(t, '[ \t-\r]+')) END::BIGINT AS n_tokens,
    ('0x' || substr(md5('{seed}|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM (SELECT *, coalesce(regexp_replace(text, '^[ \t-\r]+|[ \t-\r]+$', '', 'g'), '') AS t FROM documents)),
h AS (SELECT x, row_number() OVER (ORDER BY x) AS j, sum(n) OVER (ORDER BY x) AS docs, sum(n::HUGEINT * x) OVER (ORDER BY x) AS tokens FROM (SELECT n_tokens AS x, count(*) AS n FROM m GROUP BY 1)),
{", ".join(layers)}, {", ".join(paths)},
bounds AS (SELECT x AS bound, row_number() OVER (ORDER BY x) - 1 AS bucket FROM h WHERE j IN ({bounds}) OR (SELECT count(*) FROM h) <= {buckets}),
b AS (SELECT m.*, (SELECT min(bucket) FROM bounds WHERE bound >= m.n_tokens) AS bucket FROM m),
p AS (SELECT b.*, (SELECT bound FROM bounds WHERE bounds.bucket = b.bucket) AS padded_to, row_number() OVER (PARTITION BY bucket ORDER BY draw, doc_id, n_tokens) - 1 AS pos FROM b),
q AS (SELECT *, greatest({budget} // greatest(padded_to, 1), 1) AS holds FROM p)
SELECT doc_id, text, lang, source, n_chars, n_tokens, bucket::INTEGER AS bucket, padded_to::BIGINT AS padded_to, (pos // holds)::BIGINT AS batch, (pos % holds)::INTEGER AS slot FROM q
"""
