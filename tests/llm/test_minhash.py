import itertools
import random

import numpy as np
import pytest
from edges import DOCS, clashing, empty, odd, rows

from tessella.llm.minhash import band_keys, block_links, drop_near_duplicates, least_matches, linked, near_duplicates, signatures
from tessella.llm.queries import op3_minhash_neardup

DATA = "/root/testdata/sf0.01"
SPACES = b" \t\n\x0b\x0c\r"


def shingles(text, width):
    words, word = [], bytearray()
    for b in (text or "").encode():
        if b in SPACES:
            if word:
                words.append(bytes(word).lower())
            word = bytearray()
        else:
            word.append(b)
    if word:
        words.append(bytes(word).lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(docs, width, percent):
    """Components of documents by all pairs that share a shingle, with exact sets."""
    sets, parent = {}, {}
    for doc, text in docs:
        parent[doc] = doc
        sets[doc] = shingles(text, width)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for doc, s in sets.items():
        for x in s:
            where.setdefault(x, []).append(doc)
    pairs = {p for v in where.values() for p in itertools.combinations(sorted(v), 2)}
    for a, b in pairs:
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {doc: (len(sets[doc]), root(doc)) for doc in parent}


def test_query_equals_brute_force(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = {r[0]: (r[1], r[2]) for r in op3_minhash_neardup(spark, DATA).collect()}
    want = brute(docs, 4, 80)
    assert got == want
    assert sum(doc != c for doc, (_, c) in want.items()) > 50


def family(seed, size, edits, length=120):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(length)]
    out = []
    for _ in range(size):
        words = list(base)
        for k in rng.sample(range(length), rng.randrange(edits)):
            words[k] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def test_large_group_over_many_blocks(spark):
    texts = family(1, 120, 6) + family(2, 80, 9) + ["a copy of it and more words than five"] * 40
    docs = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], DOCS)
    want = brute(docs, 5, 80)
    assert {r[0]: (r[1], r[2]) for r in near_duplicates(df, block=16).collect()} == want
    assert {r[0]: (r[1], r[2]) for r in near_duplicates(df, block=16, broadcast_rows=0).collect()} == want
    kept = {r[0] for r in drop_near_duplicates(df).select("doc_id").collect()}
    assert kept == {c for _, c in want.values()}


def test_block_links_form_a_spanning_forest():
    texts = family(3, 30, 5)
    from tessella.llm.shingles import WordHashes, shingle_set

    sets = [shingle_set(t, 5, WordHashes()) for t in texts]
    links = block_links(list(range(30)), list(range(30)), sets, 80, 1e-6)
    assert all(linked(sets[a], sets[b], 80) for a, b in links)
    assert len(links) <= 29
    want = brute(list(enumerate(texts)), 5, 80)
    assert 30 - len(links) == len({c for _, c in want.values()})


def test_pruning_bounds_follow_the_posterior():
    least = least_matches(0.8, 1e-6)
    assert list(least) == sorted(least)
    rng = np.random.default_rng(0)
    draws = rng.binomial(48, 0.8, 200_000)
    assert (draws < least[0]).mean() < 1e-4
    assert least[-1] / 240 > 0.6


def test_signatures_estimate_similarity_and_bands_agree():
    rng = np.random.default_rng(1)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (800, 100, 100))
    sets = [np.unique(np.concatenate((shared, a))), np.unique(np.concatenate((shared, b)))]
    sig = signatures(sets)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.1
    keys = band_keys(sig)
    same = (sig[0].reshape(-1, 6) == sig[1].reshape(-1, 6)).all(axis=1)
    assert ((keys[0] == keys[1]) == same).all()


def test_odd_input(spark):
    out = near_duplicates(odd(spark))
    got = rows(out)
    assert len(got) == 13
    by = {}
    for doc, n, component, kept in got:
        by.setdefault(doc, []).append((n, component, kept))
    assert by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)] and by[1] == [(0, 1, True)]
    assert by[4] == [(1, 4, True)] and by[5] == [(1, 5, True)]
    assert by[6] == [(3, 6, True)] and by[7] == [(3, 6, False)] * 2
    assert sorted(by[None]) == [(0, None, True), (3, None, True)]
    assert rows(near_duplicates(clashing(spark))) == got
    assert near_duplicates(empty(spark)).columns == out.columns and near_duplicates(empty(spark)).count() == 0


def test_rows_that_repeat_an_id_are_one_document(spark):
    a, b = "alpha beta gamma delta epsilon zeta", "one two three four five six"
    df = spark.createDataFrame([(1, a, "", "", 0), (2, a, "", "", 0), (2, b, "", "", 0), (3, b, "", "", 0)], DOCS)
    assert {r[0]: r[2] for r in near_duplicates(df).collect()} == {1: 1, 2: 1, 3: 1}


@pytest.mark.parametrize("both, want", [(80, True), (79, False)])
def test_link_at_the_threshold_is_exact(both, want):
    x = np.arange(100, dtype=np.uint64)
    a, b = x, np.concatenate((x[:both], np.arange(200, 200 + 0, dtype=np.uint64)))
    assert linked(a, np.sort(b), 80) is want


def test_copies_are_known_by_their_whole_texts(spark):
    body = lambda k: "\n".join(f"line {w} of text {k} with its own words" for w in ("one", "two", "three", "four", "five", "six"))
    whole = spark.createDataFrame([(1, body(1)), (2, body(1)), (3, body(1) + "\nand one line more"), (4, body(4)), (5, body(5)), (6, ""), (None, body(7)), (8, body(8))], "doc_id long, text string")
    cut = [(1, body(1)), (2, ""), (3, "and one line more"), (4, body(4).split("\n")[2]), (5, "other words than before"), (6, ""), (None, "x"), (8, " \n ")]
    docs = spark.createDataFrame(cut, "doc_id long, text string")
    left = lambda **o: sorted((r[0] or 0 for r in drop_near_duplicates(docs, whole=whole, **o).collect()))
    assert left() == left(broadcast_rows=0) == [0, 1, 4, 5, 6]
    assert sorted(r[0] or 0 for r in drop_near_duplicates(docs).collect()) == [0, 1, 2, 3, 4, 5, 6, 8]
    # 5 is no remainder of the whole text of that number, so that text counts for nothing
    swapped = whole.selectExpr("CASE WHEN doc_id = 5 THEN 5 ELSE doc_id + 100 END AS doc_id", "CASE WHEN doc_id = 5 THEN '" + body(1).replace("\n", "\\n") + "' ELSE text END AS text")
    assert sorted(r[0] or 0 for r in drop_near_duplicates(docs, whole=swapped).collect()) == [0, 1, 2, 3, 4, 5, 6, 8]
    assert drop_near_duplicates(docs.where("false"), whole=whole).count() == 0
