"""Candidate generation: sparse and dense similarity joins that end in ranked edges.

Every strategy returns edges: source_id, target_id, similarity, rank (from 1, by falling similarity, ties to the smaller
target_id), with similarity >= min_similarity > 0 and at most k = top_k a source.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tessella.functions.text import bind
from tessella.storage import materialize, small

PRIME = 2147483647
#: Room for the rounding of a product of unit vectors.
SLACK = 1e-9
EDGES = "source_id long, target_id long, similarity double"


def rank_edges(edges: DataFrame, top_k: int, min_similarity: float, *by: str) -> DataFrame:
    """Edges at or above min_similarity, numbered within source_id (and by), the first top_k."""
    order = W.partitionBy(*by, "source_id").orderBy(F.desc("similarity"), "target_id")
    return edges.where(F.col("similarity") >= min_similarity).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)


def sparse_vectors(df: DataFrame, id_col: str, term_col: str, weights: DataFrame | None = None, *, log_tf: bool = False) -> tuple[DataFrame, DataFrame]:
    """Unit tf-idf vectors in long form (id, term, weight) and the idf table (term, df, idf).

    weights: an idf table fitted elsewhere, whose vocabulary limits the terms before normalising; without it, smooth idf is fitted on df.
    """
    counts = df.select(F.col(id_col).alias("id"), F.explode(term_col).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    if weights is None:
        n = df.agg(F.count("*").alias("n"))
        weights = counts.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # one row
    tf = 1 + F.log("tf") if log_tf else F.col("tf")
    raw = counts.join(weights.select("term", "idf"), "term").select("id", "term", (tf * F.col("idf")).alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy("id")))
    return raw.select("id", "term", (F.col("w") / norm).alias("weight")), weights


def cosine_top_k(source: DataFrame, target: DataFrame, *, top_k: int = 20, min_similarity: float = 0.5) -> DataFrame:
    """Exact cosine of long-form unit vectors by a join on terms; pairs that share no term have 0 and never appear."""
    if min_similarity <= 0:
        raise ValueError("a join on terms finds no pair of similarity 0; min_similarity must be above it")
    pairs = source.select(F.col("id").alias("source_id"), "term", F.col("weight").alias("a")).join(target.select(F.col("id").alias("target_id"), "term", F.col("weight").alias("b")), "term")
    return rank_edges(pairs.groupBy("source_id", "target_id").agg(F.sum(F.col("a") * F.col("b")).alias("similarity")), top_k, min_similarity)


def prefixes(vectors: DataFrame, order: DataFrame, min_similarity: float) -> DataFrame:
    """The leading terms of each vector, rarest first by order (term, df): a term stays while the length of it and the rest reaches min_similarity - 1e-6.

    Two vectors with a cosine of min_similarity share a term of both prefixes.
    """
    rest = W.partitionBy("id").orderBy("df", "term").rowsBetween(0, W.unboundedFollowing)
    floor = max(min_similarity - 1e-6, 0.0) ** 2
    return vectors.join(order.select("term", "df"), "term").withColumn("rest", F.sum(F.col("weight") * F.col("weight")).over(rest)).where(F.col("rest") >= floor).select("id", "term")


def cosine_prefix_top_k(source: DataFrame, target: DataFrame, order: DataFrame, *, top_k: int = 20, min_similarity: float = 0.5) -> DataFrame:
    """As cosine_top_k, but only pairs that share a prefix term are scored: frequent terms make no candidates."""
    if min_similarity <= 0:
        raise ValueError("min_similarity must be above 0")
    return rank_edges(prefix_pairs(source, target, order, min_similarity), top_k, min_similarity)


def prefix_pairs(source: DataFrame, target: DataFrame, order: DataFrame, min_similarity: float) -> DataFrame:
    """source_id, target_id, similarity of all pairs that share a prefix term."""
    left = prefixes(source, order, min_similarity).withColumnRenamed("id", "source_id")
    right = prefixes(target, order, min_similarity).withColumnRenamed("id", "target_id")
    candidates = left.join(right, "term").select("source_id", "target_id").distinct()
    scored = candidates.join(source.select(F.col("id").alias("source_id"), "term", F.col("weight").alias("a")), "source_id").join(target.select(F.col("id").alias("target_id"), "term", F.col("weight").alias("b")), ["target_id", "term"])
    return scored.groupBy("source_id", "target_id").agg(F.sum(F.col("a") * F.col("b")).alias("similarity"))


def term_lists(df: DataFrame, id_col: str, term_col: str) -> DataFrame:
    """id, terms: each id once, with the terms of all its rows. Lists are moved only if a count finds an id that repeats."""
    lists = df.select(F.col(id_col).alias("id"), F.col(term_col).alias("terms"))
    if lists.groupBy("id").count().where("count > 1").isEmpty():
        return lists
    return lists.groupBy("id").agg(F.flatten(F.collect_list("terms")).alias("terms"))


def fit_idf(lists: DataFrame, rows: int) -> DataFrame:
    """The smooth idf table (term, df, idf) of term_lists over so many rows; only counts by term are shuffled."""
    counts = lists.select(F.explode(F.array_distinct("terms")).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("df"))
    return materialize(counts.select("term", "df", (F.log((1 + F.lit(rows)) / (1 + F.col("df"))) + 1).alias("idf")), "idf")


def _prefix_scores(words: list, postings: dict[int, list[tuple[int, float]]], exact_from: int, min_similarity: float):
    """Scores lists of terms (id, terms, extra) against the sources.

    words: (term, df, idf) in the order of df and term, by whose places postings give a term's sources and weights.
    extra: the squared length of a list's terms that are not in words; all of these come before place exact_from.
    """
    place = {term: k for k, (term, _, _) in enumerate(words)}
    idf = np.array([x for _, _, x in words], dtype=float)
    ids = sorted({i for found in postings.values() for i, _ in found})
    number = {i: k for k, i in enumerate(ids)}
    floor = max(min_similarity - 1e-6, 0.0) ** 2
    length: dict[int, float] = {}
    leads: set[tuple[int, int]] = set()
    for k in sorted(postings, reverse=True):
        for i, w in postings[k]:
            length[i] = length.get(i, 0.0) + w * w
            if length[i] >= floor:
                leads.add((k, i))
    flat = [(number[i], w, (k, i) in leads) for k in sorted(postings) for i, w in postings[k]]
    who, weight, lead = (np.array(x, dtype=t) for x, t in zip(zip(*flat, strict=True) if flat else ((), (), ()), (np.int64, float, bool), strict=True))
    many = np.zeros(len(words), np.int64)
    for k, found in postings.items():
        many[k] = len(found)
    start = np.cumsum(many) - many
    asked = np.array(ids, np.int64)

    def run(batches):
        for batch in batches:
            lists = batch.column(1)
            begins = np.asarray(lists.offsets)
            coded = lists.values.dictionary_encode()
            known = np.array([place.get(term, -1) for term in coded.dictionary.to_pylist()], dtype=np.int64)
            at = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.empty(0, np.int64)
            targets, extra = batch.column(0).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
            for row, target in enumerate(targets):
                mine = at[begins[row] : begins[row + 1]]
                mine, tf = np.unique(mine[mine >= 0], return_counts=True)
                shared = np.flatnonzero(many[mine])
                if target is None or not len(shared):
                    continue
                w = tf * idf[mine]
                rest = (w * w)[::-1].cumsum()[::-1]
                total = rest[0] + extra[row]
                # Where some term between may be missing, the rest is an upper bound.
                kept = (rest + np.where(mine < exact_from, extra[row], 0.0) >= floor * total)[shared]
                n = many[mine[shared]]
                posts = np.repeat(start[mine[shared]] - np.cumsum(n) + n, n) + np.arange(n.sum())
                whom = who[posts]
                score = np.bincount(whom, weight[posts] * np.repeat(w[shared], n), len(asked)) / np.sqrt(total)
                met = np.zeros(len(asked), bool)
                met[whom[lead[posts] & np.repeat(kept, n)]] = True
                hit = np.flatnonzero(met & (score >= min_similarity - 1e-6))
                found.append((asked[hit], np.full(len(hit), target, np.int64), score[hit]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], names=["source_id", "target_id", "similarity"])

    return run


def prefix_pairs_of_lists(source: DataFrame, lists: DataFrame, weights: DataFrame, *, min_similarity: float = 0.5, words: int = 100_000, broadcast_rows: int = 1_000_000) -> DataFrame:
    """The pairs that prefix_pairs finds between source (unit vectors, long form) and the tf-idf vectors of term_lists, at or above min_similarity - 1e-6.

    The vectors of the lists never exist as rows. At most `words` of the most frequent terms, and those of the sources,
    go to every task, where a list is weighed, cut to its prefix and scored against the sources that it shares a prefix term with.
    Of its other terms only the sum of squared weights is needed: those alone are shuffled, by term. Sources of more
    than `words` terms in all go the way of prefix_pairs.
    """
    if min_similarity <= 0:
        raise ValueError("min_similarity must be above 0")
    source = materialize(source.where("id IS NOT NULL"), "sources")
    if source.count() > words:
        return prefix_pairs(source, sparse_vectors(lists, "id", "terms", weights)[0], weights, min_similarity)
    least, room = 0, words
    for r in sorted(weights.groupBy("df").count().collect(), reverse=True):
        room -= r["count"]
        if room < 0:
            least = r["df"]
            break
    asked = F.broadcast(source.select("term").distinct())  # at most `words` rows
    known = materialize(weights.where(F.col("df") > least).union(weights.where(F.col("df") <= least).join(asked, "term", "left_semi")), "words")
    table = sorted(((r["term"], r["df"], r["idf"]) for r in known.collect()), key=lambda x: (x[1], x[0]))
    place = {term: k for k, (term, _, _) in enumerate(table)}
    postings: dict[int, list[tuple[int, float]]] = {}
    for r in source.collect():
        if r["term"] in place:
            postings.setdefault(place[r["term"]], []).append((r["id"], r["weight"]))
    exact_from = sum(1 for _, df, _ in table if df <= least)
    others = lists.select("id", F.explode("terms").alias("term")).join(F.broadcast(known.select("term")), "term", "left_anti").repartition("term")
    squares = others.groupBy("id", "term").agg(F.count("*").alias("tf")).join(weights.where(F.col("df") <= least).select("term", "idf"), "term")
    extra = materialize(squares.groupBy("id").agg(F.sum(F.col("tf") * F.col("tf") * F.col("idf") * F.col("idf")).alias("extra")), "extra")
    weighed = lists.join(small(extra, broadcast_rows), "id", "left").select(F.col("id").cast("long").alias("id"), F.array_compact("terms").alias("terms"), F.coalesce("extra", F.lit(0.0)).alias("extra"))
    return weighed.mapInArrow(_prefix_scores(table, postings, exact_from, min_similarity), EDGES)


def minhash_coefficients(hashes: int = 64, seed: int = 42) -> tuple[list[int], list[int]]:
    """a in 1..p-1, then b in 0..p-1, from one seeded generator."""
    rng = np.random.default_rng(seed)
    return rng.integers(1, PRIME, hashes).tolist(), rng.integers(0, PRIME, hashes).tolist()


def minhash_signature(columns: Column, hashes: int = 64, seed: int = 42) -> Column:
    """Minima of (a * c + b) mod 2147483647 over an array of term numbers; an empty array has the prime everywhere."""
    a, b = minhash_coefficients(hashes, seed)
    pairs = F.array(*(F.struct(F.lit(x).cast("long").alias("a"), F.lit(y).cast("long").alias("b")) for x, y in zip(a, b, strict=True)))
    return F.transform(pairs, lambda p: F.coalesce(F.array_min(F.transform(columns, lambda c: (p["a"] * c + p["b"]) % PRIME)), F.lit(PRIME).cast("long")))


def lsh_top_k(source: DataFrame, target: DataFrame, *, bands: int = 16, top_k: int = 20, min_similarity: float = 0.5, broadcast_rows: int = 20_000) -> DataFrame:
    """Pairs (id, signature array) that share a band, scored by their share of agreeing hashes.

    Rows of one signature are a class: classes meet, not their members, and all members of a class have one list. A
    class is broadcast with its signature or list, some 500 bytes, if a count proves that there are few.
    """

    def banded(df: DataFrame, name: str) -> DataFrame:
        rows = F.floor(F.size("signature") / bands).cast("int")
        keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.struct(i.alias("band"), F.slice("signature", i * rows + 1, rows).alias("rows")))
        return df.select(F.col("id").alias(name), F.explode(keys).alias("key"))

    def classed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """id and class (the smallest id of its signature); class (as id) and signature."""
        classes = materialize(df.groupBy("signature").agg(F.min("id").alias("class")), "classes")
        return df.join(small(classes, broadcast_rows), "signature").select("id", "class"), classes.withColumnRenamed("class", "id")

    (left, left_classes), (right, right_classes) = classed(source), classed(target)
    candidates = banded(left_classes, "source_id").join(banded(right_classes, "target_id"), "key").select("source_id", "target_id").distinct()
    scored = candidates.join(left_classes.select(F.col("id").alias("source_id"), F.col("signature").alias("s")), "source_id").join(right_classes.select(F.col("id").alias("target_id"), F.col("signature").alias("t")), "target_id")
    agree = F.size(F.filter(F.arrays_zip("s", "t"), lambda p: p["s"] == p["t"])) / F.size("s")
    alike = scored.select("source_id", F.col("target_id").alias("class"), agree.alias("similarity")).where(F.col("similarity") >= min_similarity)
    # Of one class a list can take the first top_k members only.
    heads = right.withColumn("n", F.row_number().over(W.partitionBy("class").orderBy("id"))).where(F.col("n") <= top_k).select("class", F.col("id").alias("target_id"))
    ranked = materialize(rank_edges(alike.join(heads, "class").select("source_id", "target_id", "similarity"), top_k, min_similarity), "ranked")
    lists = ranked.groupBy(F.col("source_id").alias("class")).agg(F.collect_list(F.struct("target_id", "similarity", "rank")).alias("list"))
    lists = materialize(lists, "lists")
    return left.join(small(lists, broadcast_rows), "class").select(F.col("id").alias("source_id"), F.inline("list"))


def l2_normalize(vector: Column) -> Column:
    """Unit vector as doubles; a zero vector stays."""
    v = vector.cast("array<double>")
    # Bound: else the optimizer would sum the squares anew for each component.
    return bind(F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)), lambda norm: F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column, kind: str) -> Column:
    """cosine, l2 or ip distance of two vectors, smaller is nearer."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    if kind == "cosine":
        return 1 - dot(l2_normalize(a), l2_normalize(b))
    if kind == "l2":
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    if kind == "ip":
        return -dot(a, b)
    raise ValueError(f"unknown distance {kind!r}")


def _block_scores(top_k: int, min_similarity: float):
    """The best targets of each row that asks in a table of asks, id, v (unit vectors)."""

    def score(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asks, ids = table.column("asks").to_numpy(zero_copy_only=False), table.column("id").to_numpy()
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if asks.any() and not asks.all():
            vectors = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
            src, dst, left, right = ids[asks], ids[~asks], vectors[asks], vectors[~asks].T
            for at in range(0, len(src), 256):
                for i, row in enumerate(left[at : at + 256] @ right, at):
                    hit = np.flatnonzero(row >= min_similarity)
                    if len(hit) > top_k:
                        hit = hit[row[hit] >= np.partition(row[hit], len(hit) - top_k)[len(hit) - top_k]]
                    best = hit[np.lexsort((dst[hit], -row[hit]))[:top_k]]
                    found.append((np.full(len(best), src[i]), dst[best], row[best]))
        return pa.table(dict(zip(("source_id", "target_id", "similarity"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return score


def dense_top_k(source: DataFrame, target: DataFrame, *, top_k: int = 20, min_similarity: float = 0.5, block: int = 4096) -> DataFrame:
    """Exact cosine of dense vectors (id long, vector) in blocks: each pair of a source and a target block is one matrix product in numpy.

    Blocks are dealt by hashed id; the number of blocks follows the row counts, so a task holds two blocks at most and a
    source sends top_k rows from each target block to the final ranking.
    """
    n_source, n_target = source.count(), target.count()
    many_s, many_t = max(1, -(-n_source // block)), max(1, -(-n_target // block))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = source.select(F.pmod(F.xxhash64("id"), F.lit(many_s)).alias("s"), every(many_t).alias("t"), F.lit(True).alias("asks"), "id", l2_normalize(F.col("vector")).alias("v"))
    right = target.select(every(many_s).alias("s"), F.pmod(F.xxhash64("id"), F.lit(many_t)).alias("t"), F.lit(False).alias("asks"), "id", l2_normalize(F.col("vector")).alias("v"))
    return rank_edges(left.union(right).groupBy("s", "t").applyInArrow(_block_scores(top_k, min_similarity), EDGES), top_k, min_similarity)


def dense_links(vectors: DataFrame, *, min_similarity: float = 0.5, block: int = 4096) -> DataFrame:
    """source_id, target_id: links whose components are those of all pairs of vectors (id long, vector) with a cosine of min_similarity.

    Blocks meet as in dense_top_k, each pair of blocks once. A pair of blocks yields a spanning forest of its links, fewer than
    it has vectors, so neither dense groups nor the number of neighbours lose a link between components.
    """
    many = max(1, -(-vectors.count() // block))
    own, other = F.pmod(F.xxhash64("id"), F.lit(many)), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long")))
    dealt = vectors.select("id", l2_normalize(F.col("vector")).alias("v"), own.alias("own"), other.alias("other"))
    dealt = dealt.select(F.least("own", "other").alias("s"), F.greatest("own", "other").alias("t"), (F.col("own") <= F.col("other")).alias("first"), "id", "v")

    def forest(table: pa.Table) -> pa.Table:
        first = table.column("first").to_numpy(zero_copy_only=False)
        ids = table.column("id").to_numpy()
        vectors = np.array(table.column("v").to_pylist(), dtype=float)
        left = np.flatnonzero(first)
        right = np.flatnonzero(~first) if table.column("s")[0] != table.column("t")[0] else left
        label, links = np.arange(len(ids)), []
        for at in range(0, len(left) if len(right) else 0, 256):
            for i, row in zip(left[at : at + 256], vectors[left[at : at + 256]] @ vectors[right].T, strict=True):
                hit = right[row >= min_similarity]
                labels, where = np.unique(label[hit], return_index=True)
                new = labels != label[i]
                links += [(int(ids[i]), int(ids[j])) for j in hit[where[new]]]
                if new.any():
                    label[np.isin(label, labels[new])] = label[i]
        return pa.table({"source_id": pa.array([a for a, _ in links], pa.int64()), "target_id": pa.array([b for _, b in links], pa.int64())})

    return dealt.groupBy("s", "t").applyInArrow(forest, "source_id long, target_id long")


def kmeans_route(source: DataFrame, target: DataFrame, *, clusters: int = 8, seed: int = 42, iterations: int = 20) -> tuple[DataFrame, DataFrame]:
    """source and target (id, vector array) with cluster, the nearest of centroids fitted on the target."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    featured = lambda df: df.withColumn("features", array_to_vector(F.col("vector").cast("array<double>")))
    fitted = KMeans(k=clusters, seed=seed, maxIter=iterations, featuresCol="features", predictionCol="cluster").fit(featured(target))
    return fitted.transform(featured(source)).drop("features"), fitted.transform(featured(target)).drop("features")


def routed_top_k(source: DataFrame, target: DataFrame, *, top_k: int = 20, min_similarity: float = 0.5, block: int = 4096) -> DataFrame:
    """Cosine of dense vectors (id, vector, cluster) within equal clusters, in blocks as dense_top_k: a cluster has as many as its rows ask for."""
    sized = lambda df, name: df.groupBy("cluster").agg(F.ceil(F.count("*") / block).cast("long").alias(name))
    many = F.broadcast(materialize(sized(source, "many_s").join(sized(target, "many_t"), "cluster"), "clusters"))  # a row for each cluster
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = source.join(many, "cluster").select("cluster", own("many_s").alias("s"), every("many_t").alias("t"), F.lit(True).alias("asks"), "id", l2_normalize(F.col("vector")).alias("v"))
    right = target.join(many, "cluster").select("cluster", every("many_s").alias("s"), own("many_t").alias("t"), F.lit(False).alias("asks"), "id", l2_normalize(F.col("vector")).alias("v"))
    return rank_edges(left.union(right).groupBy("cluster", "s", "t").applyInArrow(_block_scores(top_k, min_similarity), EDGES), top_k, min_similarity)


def svd_rerank_top_k(source: DataFrame, target: DataFrame, *, dims: int = 128, shortlist: int = 200, top_k: int = 20, min_similarity: float = 0.5) -> DataFrame:
    """Dense cosine: a shortlist in the leading principal axes of the target, then exact scores of it; the same edges as dense_top_k.

    Each vector carries the length of what the axes leave out as one more component, so a pair's product on the shortlist
    is at least its exact one. A source whose list was cut where a pair beyond it could still reach its top_k is searched
    again over all targets. With as many axes as components nothing is left out, and the blocks alone are exact.
    """
    size = target.select(F.size("vector")).first()[0]
    if dims >= size:
        return dense_top_k(source, target, top_k=top_k, min_similarity=min_similarity)
    unit = lambda df: df.select("id", l2_normalize(F.col("vector")).alias("vector"))
    source, target = unit(source), unit(target)
    cells = [F.sum(F.col("vector")[i] * F.col("vector")[j]) for i in range(size) for j in range(i, size)]
    values = iter(target.agg(*[c.alias(f"c{k}") for k, c in enumerate(cells)]).first())
    gram = np.zeros((size, size))
    for i in range(size):
        for j in range(i, size):
            gram[i, j] = gram[j, i] = next(values) or 0.0
    axes = np.linalg.eigh(gram)[1][:, ::-1][:, :dims]
    inside = F.array(*(dot(F.col("vector"), F.array(*map(F.lit, axis.tolist()))) for axis in axes.T))
    beside = F.sqrt(F.greatest(dot(F.col("vector"), F.col("vector")) - dot(F.col("inside"), F.col("inside")), F.lit(0.0)))
    turned = lambda df: df.select("id", "vector", inside.alias("inside")).select("id", F.concat("inside", F.array(beside)).alias("vector"))
    short = dense_top_k(turned(source), turned(target), top_k=shortlist, min_similarity=min_similarity - SLACK)
    both = short.select("source_id", "target_id", F.col("similarity").alias("bound")).join(source.select(F.col("id").alias("source_id"), F.col("vector").alias("a")), "source_id").join(target.select(F.col("id").alias("target_id"), F.col("vector").alias("b")), "target_id")
    scored = materialize(both.select("source_id", "target_id", "bound", dot(F.col("a"), F.col("b")).alias("similarity")), "scored")
    ranked = rank_edges(scored.drop("bound"), top_k, min_similarity)
    worst = ranked.where(F.col("rank") == top_k).select("source_id", F.col("similarity").alias("worst"))
    cut = scored.groupBy("source_id").agg(F.count("*").alias("n"), F.min("bound").alias("last")).where(F.col("n") >= shortlist)
    unsure = materialize(cut.join(worst, "source_id", "left").where(F.col("last") >= F.coalesce("worst", F.lit(min_similarity)) - SLACK).select(F.col("source_id").alias("id")), "unsure")
    if unsure.isEmpty():
        return ranked
    again = dense_top_k(source.join(unsure, "id", "left_semi"), target, top_k=top_k, min_similarity=min_similarity)
    return ranked.join(unsure.withColumnRenamed("id", "source_id"), "source_id", "left_anti").unionByName(again)


def expand_aliases(target: DataFrame, aliases: DataFrame, *, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """target rows (id, name) and one more for each distinct alias of a known id that differs from the id's own name, whatever the case."""
    own = target.select(F.col(id_col), F.upper(name_col).alias("own"))
    more = aliases.select(id_col, name_col).join(own, id_col).where(F.upper(name_col) != F.col("own")).select(id_col, name_col).distinct()
    return target.select(id_col, name_col).unionByName(more)


def alias_hit_rate(vectors: DataFrame, *, entity_col: str = "entity", top_k: int = 10) -> DataFrame:
    """Share of vectors (id, vector, entity) with another of the same entity among their top_k nearest, itself excluded: one row."""
    base = vectors.select("id", "vector")
    edges = dense_top_k(base, base, top_k=top_k + 1, min_similarity=-1.0).where("source_id <> target_id")
    edges = edges.withColumn("rank", F.row_number().over(W.partitionBy("source_id").orderBy(F.desc("similarity"), "target_id"))).where(F.col("rank") <= top_k)
    owner = vectors.select("id", F.col(entity_col).alias("entity"))
    hits = edges.join(owner.select(F.col("id").alias("source_id"), F.col("entity").alias("e1")), "source_id").join(owner.select(F.col("id").alias("target_id"), F.col("entity").alias("e2")), "target_id").groupBy("source_id").agg(F.bool_or(F.col("e1") == F.col("e2")).alias("hit"))
    return hits.agg(F.count("*").alias("anchors"), F.count_if("hit").alias("hits"), F.avg(F.col("hit").cast("double")).alias("hit_rate"))


def mean_pool(df: DataFrame, id_col: str, token_col: str, vectors: DataFrame) -> DataFrame:
    """id, vector: the mean of the known tokens' vectors (token, vector); rows without a known token have none."""
    parts = df.select(F.col(id_col).alias("id"), F.explode(token_col).alias("token")).join(vectors, "token").select("id", F.posexplode("vector").alias("axis", "x"))
    means = parts.groupBy("id", "axis").agg(F.avg("x").alias("x"))
    return means.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("axis", "x"))), lambda s: s["x"]).alias("vector"))


def hash_vectors(df: DataFrame, id_col: str, text_col: str, dims: int = 64) -> DataFrame:
    """id, vector: unit vectors from a digest stream of the whole text, for tests."""
    @F.pandas_udf("array<double>")
    def vector(texts: pd.Series) -> pd.Series:
        def one(text):
            data = b"".join(hashlib.blake2b(f"{k}:{text or ''}".encode(), digest_size=64).digest() for k in range(-(-dims // 64)))
            v = np.frombuffer(data, np.uint8)[:dims] / 127.5 - 1
            return (v / np.linalg.norm(v)).tolist()

        return texts.map(one)

    return df.select(F.col(id_col).alias("id"), vector(text_col).alias("vector"))


def refuse_infeasible(rows: int, dims: int, *, available_bytes: int, item_bytes: int = 8) -> None:
    """Raise if a dense index of this size would not fit."""
    if rows * dims * item_bytes > available_bytes:
        raise ValueError(f"{rows} vectors of {dims} components need {rows * dims * item_bytes} bytes; {available_bytes} are available")


def blocking_text(columns: Sequence[str], separator: str = " ", lowercase: bool = False) -> Column:
    """Non-blank columns joined by a separator."""
    text = F.concat_ws(separator, *(F.nullif(F.trim(c), F.lit("")) for c in columns))
    return F.lower(text) if lowercase else text
