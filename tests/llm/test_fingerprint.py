import hashlib
import random

import numpy as np
from edges import clashing, empty, odd, rows

from tessella.llm.fingerprint import BINS, bin_values, edit_likeness, fingerprints, likeness, pack, unpack
from tessella.llm.queries import op6_fingerprints
from tessella.llm.shingles import WordHashes, shingle_set

DATA = "/root/testdata/sf0.01"


def own(text):
    return bin_values(shingle_set(text, 5, WordHashes()))


def brute(docs):
    """docs: (doc_id, text) in order; each with its next."""
    out = {}
    for k, (doc, text) in enumerate(docs):
        text, after = text or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, b, c = own(text), own(edited), own(after)
        out[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), pack(a), pack(b), likeness(a, b), likeness(a, c))
    return out


def test_query_equals_brute_force(spark):
    docs = sorted(((r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()), key=lambda r: -r[0])
    assert {r[0]: tuple(r)[1:] for r in op6_fingerprints(spark, DATA).collect()} == brute(docs)


def test_slices_do_not_change_the_result(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    assert rows(edit_likeness(docs, parts=1)) == rows(edit_likeness(docs, parts=37))


def test_estimates_are_close_to_the_true_similarity():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.2, 0.5, 0.8, 0.95):
        errors = []
        for _ in range(20):
            n = int(rng.integers(30, 3000))
            both = rng.integers(0, 2**63, max(1, int(n * share)), dtype=np.uint64)
            a, b = (np.unique(np.concatenate((both * (share > 0), rng.integers(0, 2**63, n - len(both), dtype=np.uint64)))) for _ in range(2))
            true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            errors.append(likeness(bin_values(a), bin_values(b)) - true)
        assert abs(np.mean(errors)) < 0.05


def test_every_bin_is_filled_and_packing_is_reversible():
    for n in (1, 2, 100, 5000):
        values = bin_values(np.unique(np.random.default_rng(n).integers(0, 2**63, n, dtype=np.uint64) << np.uint64(1)))
        assert len(values) == BINS and values.max() < 16
        assert (unpack(pack(values)) == values).all()
    assert pack(None) == "" and unpack("") is None
    assert likeness(None, None) == 1.0 and likeness(None, values) == 0.0 and likeness(values, values) == 1.0


def test_half_edits_are_likelier_than_strangers(spark):
    got = [r for r in op6_fingerprints(spark, DATA).collect() if r.n_chars > 400]
    assert sum(r.near_edited > r.near_next for r in got) / len(got) > 0.95


def test_odd_input(spark):
    got = rows(edit_likeness(odd(spark)))
    assert len(got) == 13
    assert {r[3] for r in got if r[0] in (1, 2, 3)} == {""}
    assert len({r[3] for r in got if r[0] in (6, 7)}) == 1
    assert rows(edit_likeness(clashing(spark))) == got
    assert rows(edit_likeness(odd(spark), parts=9)) == got
    assert edit_likeness(empty(spark)).count() == 0
    one = odd(spark).where("doc_id = 6")
    (only,) = edit_likeness(one).collect()
    assert only.near_next == 1.0
    assert fingerprints(clashing(spark)).where("fingerprint IS NULL").count() == 0


def test_next_wraps_and_ids_may_be_negative(spark):
    rng = random.Random(4)
    docs = [(-5, " ".join(str(rng.random()) for _ in range(30))), (0, "zero"), (2**40, "far away"), (3, None)]
    df = spark.createDataFrame([(*d, "", "", 0) for d in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r[0]: tuple(r)[1:] for r in edit_likeness(df).collect()} == brute(sorted(docs, key=lambda d: -d[0]))
