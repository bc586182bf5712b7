"""Near-duplicate groups: banded MinHash candidates, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.functions.columns import fresh
from tessella.llm.batches import small_batches
from tessella.llm.shingles import WordHashes, shingle_set
from tessella.operators.graph import connected_components
from tessella.storage import materialize, small

ROWS, BANDS, BATCH = 6, 40, 48
HASHES = ROWS * BANDS
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
_SLICE = 1 << 16


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of HASHES minima for each non-empty set, worked off in slices that stay in the cache."""
    out = np.empty((len(sets), HASHES), np.uint32)
    start = 0
    while start < len(sets):
        stop, total = start, 0
        while stop < len(sets) and (stop == start or total + len(sets[stop]) <= _SLICE):
            total += len(sets[stop])
            stop += 1
        values = np.concatenate(sets[start:stop])
        values = (values >> np.uint64(32)).astype(np.uint32)
        offsets = np.cumsum([0, *(len(s) for s in sets[start : stop - 1])])
        work = np.empty_like(values)
        for j in range(HASHES):
            np.multiply(values, _A[j], out=work)
            np.add(work, _B[j], out=work)
            out[start:stop, j] = np.minimum.reduceat(work, offsets)
        start = stop
    return out


def band_keys(rows: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of each signature; equal keys mean equal bands (but for 2**-64)."""
    parts = rows.reshape(len(rows), BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407), (len(rows), BANDS)).copy()
    for i in range(ROWS):
        keys = (keys ^ parts[:, :, i]) * np.uint64(0x9FB21C651E98DF25)
        keys ^= keys >> np.uint64(29)
    return keys.view(np.int64)


@lru_cache
def least_matches(threshold: float, miss: float) -> tuple[int, ...]:
    """For each batch end n: the fewest matching hashes with which a pair may go on.

    With a uniform prior the similarity after m matches of n has the posterior Beta(m + 1, n - m + 1); a pair is
    pruned as soon as P(similarity >= threshold) falls below `miss`. For whole parameters that tail is the
    binomial sum P(X <= m), X ~ Binomial(n + 1, threshold).
    """
    out = []
    for n in range(BATCH, HASHES + 1, BATCH):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
        out.append(m)
    return tuple(out)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a & b| >= percent * |a | b| for sorted sets of distinct hashes."""
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    merged = np.concatenate((a, b))
    merged.sort(kind="stable")
    both = int(np.count_nonzero(merged[1:] == merged[:-1]))
    return 100 * both >= percent * (len(a) + len(b) - both)


def block_links(nodes: list[int], labels: list[int], sets: list[np.ndarray], percent: int, miss: float) -> list[tuple[int, int]]:
    """Links that join different labels within one block, as a spanning forest: pairs of one tree are not tried again."""
    parent = {x: x for x in labels}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    sigs, sizes, marks = signatures(sets), np.array([len(s) for s in sets]), np.array(labels)
    i, j = np.triu_indices(len(nodes), 1)
    keep = (marks[i] != marks[j]) & (np.minimum(sizes[i], sizes[j]) * 100 >= percent * np.maximum(sizes[i], sizes[j]))
    i, j = i[keep], j[keep]
    matches = np.zeros(len(i), np.int32)
    for k, least in enumerate(least_matches(percent / 100, miss)):
        part = sigs[:, k * BATCH : (k + 1) * BATCH]
        for s in range(0, len(i), 8192):
            matches[s : s + 8192] += np.count_nonzero(part[i[s : s + 8192]] == part[j[s : s + 8192]], axis=1).astype(np.int32)
        alive = matches >= least
        i, j, matches = i[alive], j[alive], matches[alive]
    found = []
    for p in np.argsort(-matches, kind="stable"):
        x, y = int(i[p]), int(j[p])
        rx, ry = root(labels[x]), root(labels[y])
        if rx != ry and linked(sets[x], sets[y], percent):
            parent[max(rx, ry)] = min(rx, ry)
            found.append((nodes[x], nodes[y]))
    return found


def _profile(width: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_hi", pa.int64()), ("set_lo", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(text.as_py(), width, hashes) for text in batch.column(1)]
            full = [k for k, s in enumerate(sets) if len(s)]
            keys = band_keys(signatures([sets[k] for k in full])) if full else np.empty((0, BANDS), np.int64)
            digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(sets[k].tobytes()) for k in full), ">i8").astype(np.int64).reshape(-1, 2)
            hi, lo, bands = ([None] * len(sets) for _ in range(3))
            for row, k in enumerate(full):
                hi[k], lo[k], bands[k] = int(digests[row, 0]), int(digests[row, 1]), keys[row]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(bands, pa.list_(pa.int64()))], schema=schema)

    return run


def _sets(width: int):
    def run(batches):
        hashes = WordHashes()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(text.as_py(), width, hashes).tobytes() for text in batch.column(1)], pa.binary())], names=["node", "shingles"])

    return run


def _verify(percent: int, miss: float):
    def run(table: pa.Table) -> pa.Table:
        nodes, labels = table.column("node").to_pylist(), table.column("label").to_pylist()
        sets = [np.frombuffer(x.as_py(), np.uint64) for x in table.column("shingles")]
        found = block_links(nodes, labels, sets, percent, miss)
        return pa.table({"src": pa.array([a for a, _ in found], pa.int64()), "dst": pa.array([b for _, b in found], pa.int64())})

    return run


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, miss: float = 1e-6, block: int = 256, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Groups of documents linked by a Jaccard similarity of word-shingle sets of at least `percent` hundredths.

    1. Each text becomes its shingle set, a MinHash signature of 240 hashes, 40 band keys of 6 rows and a digest of
       the set. Equal sets are one class, so copies never meet one by one.
    2. Documents that share a band with another are candidates. The smallest document of a bucket is its hub, and
       every other member joins the hub's group; a group is cut into blocks of at most about `block` members.
    3. Within a block all pairs of different components are compared by signature batches; a pair is pruned as soon
       as the posterior probability of reaching the threshold falls below `miss`, and survivors are verified on the
       full sets. A block yields a spanning forest of its links, never all pairs.
    4. Pairs of one group in different blocks are tried in a second pass if the first left them unconnected. Members
       connected with the hub are tried against the others only.

    A pair at exactly the threshold is no candidate with a probability of (1 - 0.8**6)**40 = 5e-6.

    Nulls and odd input: a null text, an empty text and a text of white space have no shingles and link with nothing.
    A row with a null doc_id links with nothing, has a null component and is kept. Rows that repeat a doc_id are one
    document with several texts, linked with whatever one of them is linked with. Further columns are ignored. An
    empty table gives an empty result.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable), kept (doc_id = component_id).
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = materialize(texts.mapInArrow(_profile(width), "doc_id long, n_shingles long, set_hi long, set_lo long, bands array<long>"), "profiles")
    known = profile.where("doc_id IS NOT NULL AND set_hi IS NOT NULL")
    classes = known.groupBy("set_hi", "set_lo").agg(F.min("doc_id").alias("rep"))
    member = materialize(known.select("doc_id", "set_hi", "set_lo").join(classes, ["set_hi", "set_lo"]).select("doc_id", "rep").distinct(), "members")

    keyed = known.select("doc_id", F.explode("bands").alias("key"))
    hubs = materialize(keyed.groupBy("key").agg(F.min("doc_id").alias("hub"), F.max("doc_id").alias("last")).where("hub <> last").select("key", "hub"), "hubs")
    mates = keyed.join(small(hubs, broadcast_rows), "key").where("doc_id <> hub").select("hub", "doc_id").distinct()
    groups = materialize(mates.join(member, "doc_id").select("hub", F.col("rep").alias("node")).where("hub <> node").distinct(), "groups")

    nodes = materialize(groups.select("node").union(groups.select("hub")).distinct(), "nodes")
    wanted = texts.join(small(nodes, broadcast_rows).select(F.col("node").alias("doc_id")), "doc_id", "left_semi")
    sets = materialize(wanted.mapInArrow(_sets(width), "node long, shingles binary").where(F.length("shingles") > 0), "sets")

    def verified(blocks: DataFrame) -> DataFrame:
        """blocks: g, i, j (a block's key), node, label."""
        return blocks.join(sets, "node").groupBy("g", "i", "j").applyInArrow(_verify(percent, miss), "src long, dst long")

    sizes = groups.groupBy("hub").agg(F.count("*").alias("n"))
    cut = materialize(groups.join(sizes.where(F.col("n") > block), "hub", "left").select("hub", "node", F.coalesce(F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / block)), F.lit(0)).alias("i"), (F.coalesce("n", F.lit(0)) > block).alias("large")), "blocks")
    first = cut.select("hub", "i", "node").union(cut.select("hub", "i", F.col("hub").alias("node")).distinct())
    repeated = member.groupBy("doc_id").agg(F.min("rep").alias("src"), F.max("rep").alias("last")).where("src <> last").select("doc_id", "src")
    same = member.join(repeated, "doc_id").where("src <> rep").select("src", F.col("rep").alias("dst"))
    links = materialize(verified(first.select(F.col("hub").alias("g"), "i", F.lit(0).alias("j"), "node", F.col("node").alias("label"))).union(same), "links")
    labels = materialize(connected_components(links), "components")

    def label(df: DataFrame, node: str, to: str) -> DataFrame:
        return df.join(labels.select(F.col("node").alias(node), F.col("component").alias(to)), node, "left").withColumn(to, F.coalesce(to, node))

    large = cut.where("large").select("hub", "node")
    split = label(label(large, "hub", "hub_label"), "node", "label").withColumn("apart", F.col("label") != F.col("hub_label"))
    parts = split.groupBy("hub").agg(F.ceil(F.sum(F.when(~F.col("apart"), 1).otherwise(0)) / (block / 2)).alias("near"), F.ceil(F.sum(F.when(F.col("apart"), 1).otherwise(0)) / (block / 2)).alias("far")).where("far > 0")
    split = split.join(parts, "hub").withColumn("own", F.when(F.col("apart"), F.pmod(F.xxhash64("node"), "far")).otherwise(F.pmod(F.xxhash64("node"), "near")))
    # A far part meets each near part (i = -1 - near part) and each far part; a near part meets far parts only.
    crossing = split.select(
        F.col("hub").alias("g"), "node", "label", "apart",
        F.explode(
            F.when(~F.col("apart"), F.transform(F.sequence(F.lit(0), F.col("far") - 1), lambda f: F.struct((-1 - F.col("own")).cast("long").alias("i"), f.cast("long").alias("j"))))
            .otherwise(
                F.concat(
                    F.when(F.col("near") > 0, F.transform(F.sequence(F.lit(0), F.col("near") - 1), lambda n: F.struct((-1 - n).cast("long").alias("i"), F.col("own").cast("long").alias("j")))).otherwise(F.array().cast("array<struct<i:bigint,j:bigint>>")),
                    F.transform(F.sequence(F.lit(0), F.col("far") - 1), lambda f: F.struct(F.least("own", f).cast("long").alias("i"), F.greatest("own", f).cast("long").alias("j"))),
                )
            )
        ).alias("b"),
    )
    more = materialize(verified(crossing.select("g", "b.i", "b.j", "node", "label")), "links")
    if not more.isEmpty():
        labels = materialize(connected_components(links.union(more)), "components")
    # A class keeps its texts' digest, so each row finds its class by its own text.
    found = label(member, "rep", "component_id").groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return profile.select("doc_id", "n_shingles").join(found, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept"))


def cut_texts(docs: DataFrame, whole: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """doc_id, text (the one in whole), blank (nothing is left in docs) of the documents whose text in docs is what is left of it.

    A text is left of another if it differs, and is blank or has no line that the other has not. Only hashes of texts
    meet by doc_id; texts do so where the hashes differ.
    """
    slim = lambda df: df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    now, was = slim(docs), slim(whole)
    hashed = lambda df, h: df.select("doc_id", F.xxhash64("text").alias(h))
    other = materialize(hashed(now, "now_h").join(hashed(was, "was_h"), "doc_id").where("now_h <> was_h").select("doc_id").distinct(), "cut")
    few = small(other, broadcast_rows)
    both = now.join(few, "doc_id", "left_semi").withColumnRenamed("text", "left").join(was.join(few, "doc_id", "left_semi"), "doc_id")
    blank = F.btrim(F.coalesce("left", F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == ""
    kind = both.withColumn("blank", blank).where("text IS NOT NULL").where(F.col("blank") | (F.size(F.array_except(F.split("left", "\n"), F.split("text", "\n"))) == 0))
    return kind.select("doc_id", "text", "blank")


def drop_near_duplicates(docs: DataFrame, *, whole: DataFrame | None = None, broadcast_rows: int = 1_000_000, **options) -> DataFrame:
    """docs without the documents of a near-duplicate group other than its smallest doc_id; options and odd input as in near_duplicates.

    whole: the same documents (doc_id, text) before lines were taken out of them. A document that lost lines then stands
    with both its texts, and is linked with whatever one of them is linked with, so that copies are known although most
    of their text is gone; a document of which nothing is left goes, as all its lines stand elsewhere. Rows of whole
    with other doc_ids, or of whose text docs has no remainder, count for nothing.
    """
    gone, only = fresh(docs, "dropped_id", "only_blank")
    texts, emptied = docs.select("doc_id", "text"), None
    if whole is not None:
        cut = materialize(cut_texts(docs, whole, broadcast_rows), "whole")
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).union(cut.select("doc_id", "text"))
        emptied = cut.where(F.col("blank") & (F.btrim("text", F.lit(" \t\n\x0b\x0c\r")) != "")).select("doc_id", F.lit(True))
    dropped = near_duplicates(texts, **options).where("NOT kept").select("doc_id", F.lit(False))
    ids = materialize((dropped.union(emptied) if emptied is not None else dropped).toDF(gone, only).distinct(), "dropped")
    blank = F.btrim(F.coalesce(docs["text"].cast("string"), F.lit("")), F.lit(" \t\n\x0b\x0c\r")) == ""
    return docs.join(small(ids, broadcast_rows), (docs["doc_id"].cast("long") == F.col(gone)) & (~F.col(only) | blank), "left_anti")
