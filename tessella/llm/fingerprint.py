"""Document fingerprints: one-permutation MinHash, optimal densification, packed low-order bits."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.batches import small_batches
from tessella.llm.shingles import WordHashes, mix, shingle_set
from tessella.storage import materialize

WIDTH, BINS, BITS = 5, 512, 4
_SHIFT = np.uint64(64 - BINS.bit_length() + 1)
_PROBES = np.argsort(mix(np.arange(BINS * BINS, dtype=np.uint64) + np.uint64(0x5851F42D4C957F2D)).reshape(BINS, BINS), axis=1).astype(np.int32)
_STEP = 32


def bin_values(hashes: np.ndarray) -> np.ndarray | None:
    """The low-order BITS of each bin's least hash, empty bins filled; None for an empty set.

    A hash is binned once by its highest bits. An empty bin takes the value of the first bin that is not empty in a
    probe order of its own that is the same for all documents, so that two documents fill alike with a probability
    equal to their similarity (optimal densification).
    """
    if not len(hashes):
        return None
    bins = (hashes >> _SHIFT).astype(np.int32)  # sorted hashes: bins ascend, and a bin's first hash is its least
    first = np.concatenate(([True], bins[1:] != bins[:-1]))
    filled = np.zeros(BINS, bool)
    filled[bins[first]] = True
    values = np.zeros(BINS, np.uint8)
    values[bins[first]] = (mix(hashes[first]) & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    empty = np.flatnonzero(~filled)
    for start in range(0, BINS, _STEP):
        if not len(empty):
            break
        probes = _PROBES[empty, start : start + _STEP]
        hit = filled[probes]
        found = hit.any(axis=1)
        values[empty[found]] = values[probes[found, hit[found].argmax(axis=1)]]
        empty = empty[~found]
    return values


def pack(values: np.ndarray | None) -> str:
    """Hexadecimal string of BINS * BITS bits; an empty set has the empty string."""
    if values is None:
        return ""
    return ((values[0::2] << 4) | values[1::2]).astype(np.uint8).tobytes().hex()


def likeness(a: np.ndarray | None, b: np.ndarray | None) -> float:
    """Estimated Jaccard similarity: the share of equal values with the chance matches of BITS bits taken out, clipped to 0 to 1.

    Two empty sets are alike (1.0), an empty and a full one are not (0.0).
    """
    if a is None or b is None:
        return float(a is None and b is None)
    chance = 2.0**-BITS
    share = np.count_nonzero(a == b) / BINS
    return float(min(1.0, max(0.0, (share - chance) / (1.0 - chance))))


def unpack(text: str) -> np.ndarray | None:
    """The values of a packed fingerprint."""
    if not text:
        return None
    raw = np.frombuffer(bytes.fromhex(text), np.uint8)
    return np.stack((raw >> 4, raw & 15), axis=1).reshape(-1)


def fingerprints(docs: DataFrame, *, text_col: str = "text", to: str = "fingerprint") -> DataFrame:
    """docs with the packed fingerprint of text_col's five-word shingles; null and empty texts have the empty string."""

    @F.pandas_udf("string")
    def packed(texts: pd.Series) -> pd.Series:
        hashes = WordHashes()
        return texts.map(lambda t: pack(bin_values(shingle_set(t, WIDTH, hashes))))

    return docs.withColumn(to, packed(F.col(text_col)))


def _slices(ids: DataFrame, parts: int) -> list[int]:
    """At most parts - 1 ascending ids that cut the id range into slices of about as many rows."""
    row = ids.agg(F.percentile_approx("doc_id", [k / parts for k in range(1, parts)], 10_000)).first() if parts > 1 else None
    return sorted(set(row[0])) if row and row[0] else []


def _slice_of(bounds: list[int]):
    """Expression: how many bounds are <= doc_id (a null doc_id: -1, before all), found in two steps over about the root of their number."""
    if not bounds:
        return F.when(F.col("doc_id").isNull(), -1).otherwise(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    nested = F.array(*(F.array(*(F.lit(b).cast("long") for b in g)) for g in groups))
    heads = F.array(*(F.lit(g[0]).cast("long") for g in groups))
    at = F.size(F.filter(heads, lambda b: b <= F.col("doc_id")))
    inside = F.size(F.filter(F.element_at(nested, F.greatest(at, F.lit(1))), lambda b: b <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), -1).when(at == 0, 0).otherwise((at - 1) * step + inside)


_COLUMNS = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _compare(batches):
    hashes = WordHashes()
    part = before = None
    for batch in batches:
        rows = []
        for slot, lent, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = text or ""
            now = (doc, text, bin_values(shingle_set(text, WIDTH, hashes)))
            if slot == part and before is not None:
                doc_before, own, values = before
                half = len(own) // 2
                edited = own[: len(own) - half] + text[:half]
                other = bin_values(shingle_set(edited, WIDTH, hashes))
                rows.append((doc_before, len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), pack(values), pack(other), likeness(values, other), likeness(values, now[2])))
            part, before = slot, None if lent else now
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(_COLUMNS)], schema=_COLUMNS)


def edit_likeness(docs: DataFrame, *, parts: int | None = None) -> DataFrame:
    """Fingerprints of each text, of its edited text and of the next document, with their likenesses.

    The next document has the next smaller doc_id; after the smallest comes the largest again. The edited text is
    the text with its last floor(n / 2) code points replaced by the first as many (or all) of the next text.

    Documents are dealt by slices of the doc_id range, cut at approximate quantiles, and sorted within a slice, so
    one pass over a sorted slice sees each document beside its next. The first document of the next slice is lent to
    each slice: as many rows as there are slices (`parts`, by default spark.sql.shuffle.partitions).

    Nulls and odd input: a null text counts as empty; an empty text or one of white space has the empty fingerprint.
    Null doc_ids come after all others. Rows that repeat a doc_id follow each other by their text, nulls as empty.
    Further columns are ignored. A single row is its own next; an empty table gives an empty result.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.
    """
    spark = docs.sparkSession
    small_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    bounds = _slices(texts.select("doc_id"), parts)
    count = len(bounds) + 2
    # Slice 0 holds the largest ids, the last one the null ids.
    slot = (F.lit(len(bounds)) - _slice_of(bounds)).cast("int")
    placed = texts.withColumn("slot", slot)
    firsts = placed.groupBy("slot").agg(F.max("doc_id").alias("doc_id")).collect()  # one row a slice
    if not firsts:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    firsts = sorted((r["slot"], r["doc_id"]) for r in firsts)
    before = {slot: firsts[k - 1][0] for k, (slot, _) in enumerate(firsts)}  # the slice that borrows this one's first row; -1 wraps
    heads = placed.where(F.col("doc_id").isin([d for _, d in firsts if d is not None]) | F.col("doc_id").isNull())
    heads = heads.where(F.col("slot").isin([s for s, _ in firsts])).groupBy("slot", "doc_id").agg(F.min("text").alias("text"))
    heads = materialize(heads, "heads")
    borrower = F.create_map(*(F.lit(int(x)) for pair in before.items() for x in pair))
    lent = heads.select(borrower[F.col("slot")].cast("int").alias("slot"), F.lit(True).alias("lent"), "doc_id", "text")
    rows = placed.select("slot", F.lit(False).alias("lent"), "doc_id", "text").union(lent)
    return (
        rows.repartitionById(count, "slot")
        .sortWithinPartitions("slot", "lent", F.desc_nulls_last("doc_id"), "text")
        .select("slot", "lent", "doc_id", "text")
        .mapInArrow(_compare, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    )
