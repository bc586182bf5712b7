"""Sub-word vocabularies: WordPiece and BPE training on word counts, greedy encoding."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.functions.text import tokens

UNKNOWN = "[UNK]"


def word_counts(df: DataFrame, text_col: str, *, least: int = 1, most_words: int = 1_000_000) -> dict[str, int]:
    """Counts of lower-cased words for training; a documented bound on what comes to the driver: the most_words most frequent."""
    counted = df.select(F.explode(tokens(F.lower(text_col))).alias("w")).groupBy("w").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return {r[0]: r[1] for r in counted.orderBy(F.desc("n"), "w").limit(most_words).collect()}


def vocabulary_size(unique_words: int, *, multiplier: float = 0.3, least: int = 1_000, most: int = 50_000) -> int:
    return int(min(max(unique_words * multiplier, least), most))


def train_pieces(counts: Mapping[str, int], size: int, *, least: int = 2, likelihood: bool = True) -> list[str]:
    """A vocabulary of single characters and merged pieces ('##' inside words).

    likelihood: merge the pair with the greatest count over the product of its parts' counts (WordPiece); else with the
    greatest count (BPE). Ties go to the smaller pair. Merging stops at `size` or when no pair has `least` counts.
    """
    words = [([w[0], *("##" + c for c in w[1:])], n) for w, n in sorted(counts.items()) if w]
    vocabulary = dict.fromkeys(sorted({p for parts, _ in words for p in parts}))
    while len(vocabulary) < size:
        single, pairs = Counter(), Counter()
        for parts, n in words:
            for p in parts:
                single[p] += n
            for a, b in zip(parts, parts[1:], strict=False):
                pairs[a, b] += n
        open_pairs = [(n / (single[p[0]] * single[p[1]]) if likelihood else n, p) for p, n in pairs.items() if n >= least]
        if not open_pairs:
            break
        a, b = min(open_pairs, key=lambda x: (-x[0], x[1]))[1]
        piece = a + b.removeprefix("##")
        vocabulary[piece] = None
        for parts, _ in words:
            k = 0
            while k + 1 < len(parts):
                if parts[k] == a and parts[k + 1] == b:
                    parts[k : k + 2] = [piece]
                k += 1
    return list(vocabulary)


def encode(c: Column, vocabulary: Sequence[str], *, longest: int = 100) -> Column:
    """Greedy longest-match pieces of each lower-cased word, [UNK] for words that can't be covered, in Arrow batches."""
    known, limit = frozenset(vocabulary), max(map(len, vocabulary), default=1)

    def word_pieces(word: str) -> list[str]:
        out, at = [], 0
        while at < len(word):
            lead = "##" if at else ""
            for end in range(min(len(word), at + limit), at, -1):
                if lead + word[at:end] in known:
                    out.append(lead + word[at:end])
                    at = end
                    break
            else:
                return [UNKNOWN]
        return out

    @F.pandas_udf("array<string>")
    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [p for w in (t or "").lower().split() for p in (word_pieces(w) if len(w) <= longest else [UNKNOWN])])

    return pieces(c)


def rejection(metrics: Mapping[str, float], *, unk_rate_most: float = 0.01, fertility_least: float = 1.0, fertility_most: float = 3.0, median_most: float = 12, p95_most: float = 24) -> str | None:
    """The first gate a candidate fails, or None."""
    gates = (("unk_rate", metrics["unk_rate"] > unk_rate_most), ("fertility", not fertility_least <= metrics["fertility"] <= fertility_most), ("median_tokens", metrics["median_tokens"] > median_most), ("p95_tokens", metrics["p95_tokens"] > p95_most))
    return next((name for name, failed in gates if failed), None)


def selection_score(c: Mapping[str, float], *, tolerance: float, unk_threshold: float) -> float:
    """Lower is better: distance to the fertility target, unknown rate, and both figures' change on validation text."""
    return abs(c["fertility_distance"]) / tolerance + c["unk_rate"] / unk_threshold + abs(c.get("fertility_delta", 0.0)) / tolerance + max(0.0, c.get("unk_rate_delta", 0.0)) / unk_threshold


def best_pair(runs: DataFrame, *, pass_rate: float = 0.5, tolerance: float = 0.05) -> DataFrame:
    """One row: the smallest vocabulary whose median distance over accepted runs is within tolerance of the best; pairs under pass_rate are out.

    runs: vocab_size, min_frequency, fertility_distance, selection_score, rejected.
    """
    ok = ~F.col("rejected")
    cells = runs.groupBy("vocab_size", "min_frequency").agg(F.avg(ok.cast("double")).alias("pass"), F.median(F.when(ok, F.abs("fertility_distance"))).alias("distance"), F.median(F.when(ok, F.col("selection_score"))).alias("score")).where(F.col("pass") >= pass_rate)
    least = cells.agg(F.min("distance").alias("least"))
    return cells.crossJoin(F.broadcast(least)).where(F.col("distance") <= F.col("least") + tolerance).orderBy("vocab_size", "score", "min_frequency").limit(1).drop("least")


def tokenize_columns(df: DataFrame, text_col: str, tokenizers: Mapping[str, Sequence[str]], *, noise: Sequence[str] = ()) -> DataFrame:
    """df with one piece-array column for each vocabulary (column: pieces), noise words taken off the text first."""
    kept = F.array_join(F.filter(tokens(F.col(text_col)), lambda t: ~F.lower(t).isin([w.lower() for w in noise])), " ") if noise else F.col(text_col)
    return df.select("*", *(encode(kept, vocabulary).alias(name) for name, vocabulary in tokenizers.items()))


def register_ngram_table_function(spark, name: str = "ngrams") -> None:
    """A table function (text, n) of character n-grams for SQL: SELECT * FROM ngrams('text', 3)."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="position int, gram string")
    class NGrams:
        def eval(self, text: str, n: int):
            for i in range(len(text or "") - n + 1):
                yield i, text[i : i + n]

    spark.udtf.register(name, NGrams)
