import random

from edges import clashing, empty, odd, rows

from tessella.llm.queries import op4_token_counts
from tessella.llm.tokens import MARK, VOCABULARY, PieceTrie, load_pieces, token_counts

DATA = "/root/testdata/sf0.001"


def brute(word, pieces):
    """Token count of the best segmentation, by a table over all cuts."""
    low = min(pieces.values()) - 10.0
    best = [(0.0, 0)]
    for end in range(1, len(word) + 1):
        size = len(word[end - 1].encode())
        options = [(best[k][0] + pieces[word[k:end]], best[k][1] - 1) for k in range(end) if word[k:end] in pieces]
        if word[end - 1] not in pieces:
            options.append((best[end - 1][0] + size * low, best[end - 1][1] - size))
        best.append(max(options))
    return -best[-1][1]


def test_trie_equals_a_table_for_each_word():
    pieces = load_pieces(VOCABULARY)
    rng = random.Random(3)
    words = {MARK + "".join(rng.choice("aehinorst") for _ in range(rng.randrange(12))) for _ in range(400)} | {MARK + w for w in ("日本語", "☃☃x", "naïve", "")}
    assert PieceTrie(pieces).counts(words) == {w: brute(w, pieces) for w in words}


def test_toy_model_takes_the_best_score_and_then_fewest_tokens():
    trie = PieceTrie({"a": -1.0, "b": -1.0, "ab": -1.5, "abc": -9.0, "c": -1.0})
    assert trie.counts(["", "ab", "abc", "abd"]) == {"": 0, "ab": 1, "abc": 2, "abd": 2}


def test_query_equals_brute_force(spark):
    pieces = load_pieces(VOCABULARY)
    known = {}

    def count(text):
        total = 0
        for w in text.split():
            if w not in known:
                known[w] = brute(MARK + w, pieces)
            total += known[w]
        return total

    texts = dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect())
    got = {r[0]: (r[1], r[2]) for r in op4_token_counts(spark, DATA).collect()}
    assert got == {d: (len((t or "").split()), count(t or "")) for d, t in texts.items()}


def test_other_vocabularies_are_read():
    ranks = load_pieces("/opt/tokenizers/byte_bpe_50k.tiktoken")
    assert len(ranks) > 40_000 and max(ranks.values()) < 0


def test_odd_input(spark):
    out = token_counts(odd(spark))
    got = rows(out)
    by = {r[0]: r[1:] for r in got}
    assert len(got) == 13 and by[1] == by[2] == by[3] == (0, 0) and by[5][0] == 30_000
    assert rows(token_counts(clashing(spark))) == got
    assert token_counts(empty(spark)).count() == 0
