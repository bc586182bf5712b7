"""Whole blocking runs: exact cascade, scoring, pruning, clusters and evaluation for all jurisdictions in one plan."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.operators import blocking, evaluate
from tessella.operators.similarity import rank_edges
from tessella.storage import materialize, small

#: Scores what the cascade left: (source, target) with id, country and text, to edges source_id, target_id, similarity.
Score = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class BlockingRun:
    edges: DataFrame
    clusters: DataFrame
    distribution: DataFrame
    coverage: DataFrame
    shape: DataFrame


def _counted(values) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(np.asarray(values, np.int64), return_counts=True)


def _term_counts(batches):
    """A row for each different term (hash) of a row, with its count."""
    for batch in batches:
        found = [_counted(x.values) for x in batch.column(2)]
        at = pa.array(np.repeat(np.arange(len(found)), [len(t) for t, _ in found]))
        one = lambda k: pa.array(np.concatenate([np.empty(0, np.int64), *(f[k] for f in found)]))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), one(0), one(1)], names=["id", "country", "term", "tf"])


def _document_frequencies(batches):
    """Each term of a batch, with the number of its rows that have it."""
    for batch in batches:
        term, df = _counted(np.concatenate([np.empty(0, np.int64), *(np.unique(np.asarray(x.values, np.int64)) for x in batch.column(0))]))
        yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(df)], names=["term", "df"])


def _pack(*columns: np.ndarray) -> bytes:
    """Columns of integers by their bytes' places, deflated: most high bytes are 0."""
    return zlib.compress(np.stack(columns).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(packed: bytes, columns: int) -> np.ndarray:
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(8, -1).T.copy().view("<i8").reshape(columns, -1)


def _idf(df: np.ndarray, n: int) -> np.ndarray:
    return np.log((1 + n) / (1 + df)) + 1


def _raw_weights(tf: np.ndarray, log_tf: bool) -> np.ndarray:
    return 1 + np.log(tf) if log_tf else tf


def _vectors(rows: dict, log_tf: bool, with_df: bool, look_up: Callable):
    """id, country, norm and packed terms of each row; look_up: a row's value to codes, tf and df of its known terms."""

    def run(batches):
        for batch in batches:
            at, norms, packed = [], [], []
            for i, (country, values) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2), strict=True)):
                code, tf, df = look_up(values)
                if len(code):
                    order = np.argsort(code)
                    code, tf, df = code[order], tf[order], df[order]
                    weight = _raw_weights(tf, log_tf) * _idf(df, rows[country])
                    at.append(i)
                    norms.append(np.sqrt(weight @ weight))
                    packed.append(_pack(np.diff(code, prepend=0), tf, *[df] * with_df))
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(norms, pa.float64()), pa.array(packed, pa.binary())], names=["id", "country", "norm", "terms"])

    return run


def _of_broadcast(vocabulary):
    """Codes, the most frequent terms first, out of a broadcast of sorted terms, codes and df."""

    def look_up(values):
        terms, codes, dfs = vocabulary.value
        term, tf = _counted(values.values)
        at = np.minimum(np.searchsorted(terms, term), max(len(terms) - 1, 0))
        known = terms[at] == term if len(terms) else np.zeros(len(term), bool)
        return codes[at[known]].astype(np.int64), tf[known], dfs[at[known]].astype(np.int64)

    return look_up


def _of_structs(values):
    """Rows of term, tf and df; a term is its own code."""
    flat = values.values
    return tuple(flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))


def _block_cosines(rows: dict, min_similarity: float, log_tf: bool, top_k: int | None, slack: float, heavy_cells: int = 10_000_000):
    """Cosines of the vectors that ask with the others: terms of many vectors by a matrix product, the rest by their postings."""

    def postings(packed: pa.ChunkedArray, norms: np.ndarray, n: int):
        """Sorted codes, their df, where their postings start, and row and weight of each posting."""
        each = [_unpack(x.as_py(), 3) for x in packed]
        row = np.repeat(np.arange(len(each), dtype=np.int32), [x.shape[1] for x in each])
        code = np.concatenate([np.cumsum(x[0]) for x in each])
        order = np.argsort(code, kind="stable")
        code, row = code[order], row[order]
        start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        df = np.concatenate([x[2] for x in each])[order][start]
        tf = np.concatenate([x[1] for x in each])[order]
        start = np.r_[start, len(code)]
        return code[start[:-1]], df, start, row, _raw_weights(tf, log_tf) * np.repeat(_idf(df, n), np.diff(start)) / norms[row]

    def score(table: pa.Table) -> pa.Table:
        asks, out = table.column("asks").combine_chunks(), []
        src, dst = table.filter(asks), table.filter(pc.invert(asks))
        if src.num_rows and dst.num_rows:
            n, size = rows[table.column("country")[0].as_py()], dst.num_rows
            terms, known_df, start, row, weight = postings(dst.column("terms"), dst.column("norm").to_numpy(), n)
            idf, df = _idf(known_df, n), np.diff(start)
            heavy = np.argsort(-df, kind="stable")[: heavy_cells // size]
            heavy = heavy[df[heavy] >= size / 16]
            place = np.full(len(terms), -1)
            place[heavy] = np.arange(len(heavy))
            dense = np.zeros((len(heavy), size))
            for k, c in enumerate(heavy):
                dense[k, row[start[c] : start[c + 1]]] = weight[start[c] : start[c + 1]]
            norms, packed = src.column("norm").to_numpy(), src.column("terms")
            for at in range(0, src.num_rows, 128):
                m = min(128, src.num_rows - at)
                left, light = np.zeros((m, len(heavy))), []
                for i in range(m):
                    delta, tf = _unpack(packed[at + i].as_py(), 2)
                    code = np.cumsum(delta)
                    col = np.minimum(np.searchsorted(terms, code), len(terms) - 1)
                    known = terms[col] == code
                    col = col[known]
                    w = _raw_weights(tf[known], log_tf) * idf[col] / norms[at + i]
                    in_it = place[col] >= 0
                    left[i, place[col[in_it]]] = w[in_it]
                    light.append((col[~in_it], w[~in_it]))
                for i, (total, (col, w)) in enumerate(zip(left @ dense, light, strict=True), at):
                    if len(col):
                        ends = np.cumsum(df[col])
                        post = np.repeat(start[col] - ends + df[col], df[col]) + np.arange(ends[-1])
                        total = total + np.bincount(row[post], weight[post] * np.repeat(w, df[col]), size)
                    hit = np.flatnonzero(total >= min_similarity)
                    if top_k and len(hit) > top_k:
                        hit = hit[total[hit] >= np.partition(total[hit], len(hit) - top_k)[len(hit) - top_k] - slack]
                    out.append((np.full(len(hit), i), hit, total[hit]))
        i, j, x = map(np.concatenate, zip(*out, strict=True)) if out else (np.empty(0, int), np.empty(0, int), np.empty(0))
        return pa.table({"source_id": src.column("id").take(pa.array(i)), "target_id": dst.column("id").take(pa.array(j)), "similarity": x})

    return score


def tfidf_score(terms: Callable, *, min_similarity: float, log_tf: bool = False, top_k: int | None = None, floor: float = 0.0, slack: float = 0.0, block: int = 16_384, broadcast_rows: int = 4_000_000) -> Score:
    """Cosine of tf-idf vectors over terms(text), fitted on each country's own targets; vectors meet within a country, in blocks.

    Terms are compared by 64-bit hashes. A country has as many blocks of either side as its rows ask for, of `block` rows; a vector is one row of
    packed numbers. The targets' terms go to every task up to broadcast_rows; with more of them, the rows' terms are shuffled to theirs.
    top_k, floor: a caller that ranks to so many, and keeps nothing below floor, may have a block leave out what is more than slack below
    its source's top_k there, or below floor; slack has to cover what the caller rounds.
    """

    def score(source: DataFrame, target: DataFrame) -> DataFrame:
        kind = source.schema["id"].dataType.simpleString()

        def hashed(df: DataFrame) -> DataFrame:
            """id, country, term hashes; rows of one id are one."""
            each = df.where("id IS NOT NULL AND country IS NOT NULL AND text IS NOT NULL").select(F.col("id").cast(kind).alias("id"), "country", F.transform(terms(F.col("text")), lambda t: F.xxhash64("country", t)).alias("terms"))
            once = df.groupBy("id").count().where("count > 1").isEmpty()
            return each if once else each.groupBy("id", "country").agg(F.flatten(F.collect_list("terms")).alias("terms"))

        asking, asked = hashed(source), hashed(target)
        rows = {r.country: r.n for r in target.groupBy("country").agg(F.count("*").alias("n")).collect()}  # a row for each country
        vocabulary = materialize(asked.select("terms").mapInArrow(_document_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")), "vocabulary")
        if vocabulary.count() <= broadcast_rows:
            known = vocabulary.toArrow().sort_by("term")
            df = known.column("df").to_numpy()
            codes = np.empty(len(df), np.int32)
            codes[np.argsort(-df, kind="stable")] = np.arange(len(df), dtype=np.int32)
            look_up = _of_broadcast(source.sparkSession.sparkContext.broadcast((known.column("term").to_numpy(), codes, df.astype(np.int32))))
        else:
            look_up = _of_structs

        def vectors(lists: DataFrame, with_df: bool) -> DataFrame:
            if look_up is _of_structs:
                long = lists.mapInArrow(_term_counts, f"id {kind}, country string, term long, tf long")
                lists = long.join(vocabulary, "term").groupBy("id", "country").agg(F.collect_list(F.struct("term", "tf", "df")).alias("terms"))
            return materialize(lists.mapInArrow(_vectors(rows, log_tf, with_df, look_up), f"id {kind}, country string, norm double, terms binary"), "vectors")

        left, right = vectors(asking, False), vectors(asked, True)
        blocks = lambda df, name: df.groupBy("country").agg(F.ceil(F.count("*") / block).cast("long").alias(name))
        many = F.broadcast(materialize(blocks(left, "many_s").join(blocks(right, "many_t"), "country"), "blocks"))
        own = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        dealt = lambda df, s, t, asks: df.join(many, "country").select("country", s.alias("s"), t.alias("t"), F.lit(asks).alias("asks"), "id", "norm", "terms")
        both = dealt(left, own("many_s"), every("many_t"), True).union(dealt(right, every("many_s"), own("many_t"), False))
        return both.groupBy("country", "s", "t").applyInArrow(_block_cosines(rows, max(min_similarity, floor), log_tf, top_k, slack), f"source_id {kind}, target_id {kind}, similarity double")

    return score


def run_blocking(source: DataFrame, target: DataFrame, *, forms: Sequence[str], score: Score, text: str, top_k: int = 20, max_per_source: int | None = None, min_similarity: float = 0.5, ratio: float | None = None, max_per_target: int | None = None, bins: int = 10) -> BlockingRun:
    """source, target: id, country and the name forms; text: the form that is scored.

    Sources that an exact form matches are not scored. Scored edges are ranked to min(top_k, max_per_source), then cut by ratio to the
    source's best and by the target's cap; exact edges come first in the merge. Only countries of both sides take part.
    """
    both = F.broadcast(materialize(source.select("country").distinct().join(target.select("country").distinct(), "country", "left_semi"), "countries"))
    source, target = (df.join(both, "country", "left_semi") for df in (source, target))
    exact = materialize(blocking.exact_cascade(source, target, forms, within="country"), "exact")
    matched = materialize(exact.select(F.col("source_id").alias("id")).distinct(), "matched")
    rest = source.join(small(matched, 1_000_000), "id", "left_anti")  # else texts are shuffled
    wanted = lambda df: df.where(F.trim(text) != "").select("id", "country", F.col(text).alias("text"))
    k = min(top_k, max_per_source or top_k)
    scored = rank_edges(score(wanted(rest), wanted(target)), k, min_similarity)
    edges = blocking.merge_edges(exact, scored)
    edges = edges if ratio is None else blocking.ratio_prune(edges, ratio)
    edges = edges if max_per_target is None else blocking.target_cap(edges, max_per_target)
    edges = materialize(edges, "edges")  # else clusters and each later use would score anew
    members = blocking.clusters(edges)
    nodes = lambda df: df.select(F.col("id").cast("string").alias("node_id"))
    return BlockingRun(edges, members, blocking.similarity_histogram(edges, min_similarity=min_similarity, bins=bins), blocking.directional_coverage(nodes(source), nodes(target), members), blocking.cluster_shape(members))


def variant_recovery(variants: DataFrame, target: DataFrame, *, score: Score, top_k: int = 10, min_similarity: float = 0.5) -> DataFrame:
    """Name variants (id, source_uri, country, text) scored against targets (id, country, text); truth is the entity a variant came from: one evaluation row."""
    edges = rank_edges(score(variants.select("id", "country", "text"), target), top_k, min_similarity)
    truth = variants.select(F.col("id").alias("source_id"), F.col("source_uri").alias("target_id"))
    return evaluate.truth_eval(evaluate.truth_detail(truth, edges), target_rows=target.count(), k=top_k)


def validation_matrix(runs: dict[tuple[str, str], tuple[DataFrame, DataFrame, int]], *, k: int = 10) -> DataFrame:
    """source_system, target_system and evaluation of each (truth, edges, target rows), one row a pair of systems."""
    out = None
    for (a, b), (truth, edges, rows) in runs.items():
        one = evaluate.truth_eval(evaluate.truth_detail(truth, edges), target_rows=rows, k=k).select(F.lit(a).alias("source_system"), F.lit(b).alias("target_system"), "*")
        out = one if out is None else out.unionByName(one)
    return out


def rescore_missed(truth: DataFrame, edges: DataFrame, source: DataFrame, target: DataFrame, *, score: Score) -> DataFrame:
    """source_id, target_id, similarity (null where none) of truth pairs that edges miss, by scoring their sources only."""
    pair = ["source_id", "target_id"]
    missed = truth.join(edges.select(pair), pair, "left_anti").select(pair)
    scored = score(source.join(missed.select(F.col("source_id").alias("id")).distinct(), "id", "left_semi"), target)
    return missed.join(scored.select(*pair, "similarity"), pair, "left")
