"""Exact top-k search by inner product over vectors sorted by length, pruned by Cauchy-Schwarz on rotated partial sums."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.storage import materialize, small

STRIP = 2048


def usable(vector: Column) -> Column:
    """Whether a vector is not null and has no null and no non-finite component."""
    x = vector.cast("array<double>")
    return F.coalesce(F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False))


def _gram(dim: int):
    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], names=["gram"])

    return run


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column as rows, short ones padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == dim).all():
        return flat.reshape(-1, dim)
    out = np.zeros((len(sizes), dim))
    rows = np.repeat(np.arange(len(sizes)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def rotation(gram: np.ndarray) -> np.ndarray:
    """Right singular vectors of the matrix with this Gram matrix, by falling singular value."""
    values, vectors = np.linalg.eigh(gram)
    return vectors[:, np.argsort(-values, kind="stable")]


def exact_scores(vectors: np.ndarray, query: np.ndarray, whole: bool) -> np.ndarray:
    """Inner products with a query: as doubles, or exact if the components are whole (Python's integers where 2**53 is not enough)."""
    if not whole or len(vectors) == 0 or np.sqrt((vectors**2).sum(1).max() * (query @ query)) < 2**52:  # by Cauchy-Schwarz no partial sum is greater
        return vectors @ query
    ask = [int(v) for v in query]
    return np.array([sum(int(v) * a for v, a in zip(row, ask, strict=True)) for row in vectors], object)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to the smaller id."""
    if scores.dtype != object:
        return np.lexsort((ids, -scores))[:k]
    return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)


def search_block(query_ids, queries, floors, ids, vectors, turn, k, whole=False) -> tuple[np.ndarray, np.ndarray, list]:
    """Best k candidates of each query in one block, as (query row, candidate row, score), each above or at the query's floor.

    Candidates come by falling length in strips. For a strip, the inner product over the first half of the rotated
    axes plus the product of the residual lengths bounds every score (Cauchy-Schwarz); only pairs whose bound
    reaches the query's k-th best score so far (or the floor, if greater) get the full product. A strip is not looked
    at by queries whose length times the strip's greatest length is below that. Bounds have a slack of 1e-9 of the
    lengths' product for rounding; scores are products of the vectors as given, exact if whole.
    """
    dim = vectors.shape[1]
    head = max(1, dim // 2)
    lengths = np.sqrt((vectors**2).sum(1))
    order = np.lexsort((ids, -lengths))
    ids, vectors, lengths = ids[order], vectors[order], lengths[order]
    qn = np.sqrt((queries**2).sum(1))
    rq, rv = queries @ turn, vectors @ turn
    q_rest, v_rest = np.sqrt((rq[:, head:] ** 2).sum(1)), np.sqrt((rv[:, head:] ** 2).sum(1))
    best = [(np.empty(0), np.empty(0, np.int64)) for _ in query_ids]
    least = floors.copy()
    for start in range(0, len(ids), STRIP):
        part = slice(start, start + STRIP)
        active = np.flatnonzero(qn * lengths[start] * (1 + 1e-9) >= least)
        if not len(active):
            continue
        bound = rq[active, :head] @ rv[part, :head].T + q_rest[active, None] * v_rest[part]
        bound += 1e-9 * qn[active, None] * lengths[part]
        for row, a in enumerate(active):
            hit = np.flatnonzero((bound[row] >= least[a]) & (ids[part] != query_ids[a]))
            if not len(hit):
                continue
            hit += start
            scores = np.concatenate((best[a][0], exact_scores(vectors[hit], queries[a], whole)))
            if scores.dtype == object:
                scores = np.array([int(v) for v in scores], object)
            rows = np.concatenate((best[a][1], hit))
            kept = _best(scores, ids[rows], k)
            best[a] = scores[kept], rows[kept]
            if len(kept) == k:
                least[a] = max(least[a], float(best[a][0][-1]))
    count = [len(s) for s, _ in best]
    rows = np.concatenate([order[r] for _, r in best]) if sum(count) else np.empty(0, np.int64)
    return np.repeat(np.arange(len(query_ids)), count), rows, [v for s, _ in best for v in s.tolist()]


#: Whole scores are Spark decimals of this many digits; greater ones are given as the greatest.
DIGITS = 38
_MOST = 10**DIGITS - 1


def _search(turn: np.ndarray, k: int, whole: bool):
    dim = len(turn)
    to_scores = (lambda x: pa.array([Decimal(max(-_MOST, min(_MOST, int(v)))) for v in x], pa.decimal128(DIGITS, 0))) if whole else lambda x: pa.array(x, pa.float64())

    def run(table: pa.Table) -> pa.Table:
        ids, asks, floors = table.column("vec_id").to_numpy(), table.column("ask").to_numpy().astype(bool), table.column("floor").to_numpy()
        x = _matrix(table.column("x").combine_chunks(), dim)
        q, c = np.flatnonzero(asks), np.flatnonzero(~asks)
        if len(q) and len(c):
            a, b, scores = search_block(ids[q], x[q], floors[q], ids[c], x[c], turn, k, whole)
        else:
            a, b, scores = np.empty(0, np.int64), np.empty(0, np.int64), []
        return pa.table({"query_id": pa.array(ids[q][a], pa.int64()), "vec_id": pa.array(ids[c][b], pa.int64()), "score": to_scores(scores)})

    return run


def _above(marks: list, strict: bool):
    """A function from numbers to how many of the ascending marks are greater (strict) or smaller than each."""
    ordered = np.array(marks)

    @F.pandas_udf("int")
    def count(values: pd.Series) -> pd.Series:
        at = np.searchsorted(ordered, values.to_numpy(), side="right" if strict else "left")
        return pd.Series((len(ordered) - at if strict else at).astype(np.int32))

    return count


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 20, block: int = 16_384, query_block: int = 4_096, whole: bool = False, broadcast_rows: int = 200_000) -> DataFrame:
    """The k greatest inner products of each query vector with all other vectors, exactly.

    vectors: vec_id, x array<double>. is_query: condition on these columns. whole: the components are whole numbers and
    scores are to be exact whatever their size; else they are computed as doubles.

    1. The Gram matrix (dimension squared numbers a partition) gives the rotation to singular axes over all vectors.
    2. Candidates are cut by length, then hashed vec_id, into blocks of about `block`, at approximate quantiles of
       both in one key, so equal lengths spread; queries into blocks of about `query_block`, at quantiles of vec_id.
       A task handles one pair of blocks, so its memory is bounded. A row finds its block by binary search.
    3. Every query meets the block of the longest vectors first; its k-th score there is its floor. It meets a later
       block only if its length times the block's greatest length reaches the floor, and a candidate block is sent only
       to query blocks with a query that needs it.

    The cuts and one length a block are on the driver: three numbers for each `block` vectors or `query_block` queries.

    Nulls and odd input: vectors that are null or hold a null or non-finite component, and rows with a null vec_id,
    take no part. Vectors shorter than the longest count as padded with zeros. Ties go to the smaller vec_id. A query
    never meets rows of its own vec_id. Rows that repeat a vec_id are candidates each for itself; of query rows
    that repeat a vec_id, the one with the smallest vector asks. Further columns are ignored. No vectors, no rows.

    Returns query_id, rank (from 1), vec_id, score (double; if whole, a decimal of 38 digits, greater ones as the greatest).
    """
    empty = f"query_id long, vec_id long, score {f'decimal({DIGITS},0)' if whole else 'double'}"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("x").cast("array<double>").alias("x"), is_query.alias("ask")).where(usable(F.col("x")) & F.col("vec_id").isNotNull())
    rows = materialize(rows.withColumn("norm", F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))).withColumn("tie", F.pmod(F.xxhash64("vec_id"), F.lit(1 << 20)) / (1 << 20)), "vectors")
    shape = rows.agg(F.max(F.size("x")).alias("dim"), F.count("*").alias("n"), F.count(F.when(F.col("ask"), 1)).alias("q"), F.max("norm").alias("top")).first()
    spark, dim = rows.sparkSession, shape["dim"] or 0
    ranked = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if not shape["q"] or not dim:
        return spark.createDataFrame([], empty).withColumn("rank", F.row_number().over(ranked)).select("query_id", "rank", "vec_id", "score")
    grams = rows.select("x").mapInArrow(_gram(dim), "gram array<double>")
    gram = grams.select(F.posexplode("gram")).groupBy("pos").agg(F.sum("col").alias("v")).collect()
    turn = rotation(np.array([v for _, v in sorted(map(tuple, gram))]).reshape(dim, dim))

    def cuts(values: Column, of: DataFrame, n: int, size: int) -> list:
        many = -(-n // size)
        found = of.agg(F.percentile_approx(values, [i / many for i in range(1, many)], 100_000).alias("c")).first()["c"] if many > 1 else []
        return sorted(set(found or []))

    # Lengths are scaled to whole steps of 2**-32 of the greatest; the hashed id cuts within a step.
    length_key = F.floor(F.col("norm") / (shape["top"] or 1.0) * 2.0**32).cast("double") + F.col("tie")
    bounds = cuts(length_key, rows, shape["n"], block)
    marks = cuts(F.col("vec_id"), rows.where("ask"), shape["q"], query_block)
    candidates = rows.withColumn("cb", _above(bounds, True)(length_key) if bounds else F.lit(0))
    queries = rows.where("ask").groupBy("vec_id").agg(F.min(F.struct("x", "norm")).alias("v")).select("vec_id", "v.x", "v.norm")
    asking = queries.withColumn("qb", _above(marks, False)(F.col("vec_id")) if marks else F.lit(0)).withColumn("floor", F.lit(float("-inf")))
    tops = sorted((r["cb"], float(r["norm"])) for r in candidates.groupBy("cb").agg(F.max("norm").alias("norm")).collect())
    numbers, heights = np.array([b for b, _ in tops], np.int32), np.array([h for _, h in tops])

    @F.pandas_udf("array<int>")
    def needed(norms: pd.Series, floors: pd.Series) -> pd.Series:
        # Blocks come by falling length, so those that can reach the floor are the first ones.
        return pd.Series([numbers[1 : 1 + int(np.count_nonzero(heights[1:] * n * (1 + 1e-9) >= f))] for n, f in zip(norms, floors, strict=True)])

    def answers(asking: DataFrame) -> DataFrame:
        """asking: the queries with a column cb, once for each block that they meet."""
        left = asking.select("qb", "cb", F.lit(True).alias("ask"), "vec_id", "x", "floor")
        pairs = small(materialize(asking.select("qb", "cb").distinct(), "pairs"), broadcast_rows)
        right = candidates.join(pairs, "cb").select("qb", "cb", F.lit(False).alias("ask"), "vec_id", "x", F.lit(0.0).alias("floor"))
        return left.union(right).groupBy("qb", "cb").applyInArrow(_search(turn, k, whole), empty)

    found = answers(asking.withColumn("cb", F.lit(int(numbers[0]))))
    if len(numbers) > 1:
        found = materialize(found, "answers")
        floors = found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("kth"))
        known = asking.drop("floor").join(floors, "vec_id", "left").withColumn("floor", F.coalesce("kth", F.lit(float("-inf"))))
        met = materialize(known.withColumn("cb", F.explode(needed("norm", "floor"))), "met")
        found = found.union(answers(met))
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def scaled(vector: Column) -> Column:
    """floor(64 * x) of each component x, as doubles; unusable vectors become null. Doubles of 2**53 and more are whole, and beyond the range of F.floor."""
    whole = lambda v: F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)
    return F.when(usable(vector), F.transform(vector.cast("array<double>"), lambda v: whole(v * 64.0)))


def as_long(score: Column) -> Column:
    """A whole score as a long, the nearest one if it is out of range."""
    return F.greatest(F.least(score, F.lit(2**63 - 1)), F.lit(-(2**63))).cast("long")


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(64 * x)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""
