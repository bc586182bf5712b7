"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy."""

from __future__ import annotations

import math
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.batches import small_batches
from tessella.llm.mixing import hashed_uniform

BUCKETS = 1 << 17
GRAMS = (3, 4, 5, 6)
_WORDS_KEPT = 200_000
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "¡¿«»“”‘’…"


def tokens(text: str | None) -> Counter:
    """Lower-cased runs of characters that are no white space, with their counts."""
    return Counter((text or "").lower().split())


def features(token: str) -> list[int]:
    """Buckets of a token without outer punctuation: the whole word and its character n-grams with word ends."""
    word = f"<{token.strip(_EDGES)}>"
    if len(word) == 2:
        return []
    crc, mask, data = zlib.crc32, BUCKETS - 1, word.encode("utf-8", "surrogatepass")
    if len(data) == len(word):  # in ASCII the bytes are the characters
        return [crc(data) & mask, *(crc(data[i : i + n]) & mask for n in GRAMS for i in range(len(data) - n + 1))]
    return [crc(data) & mask, *(crc(word[i : i + n].encode("utf-8", "surrogatepass")) & mask for n in GRAMS for i in range(len(word) - n + 1))]


@dataclass
class Model:
    """weights: by bucket, the label-1 less the label-0 logit of its embedding; pull: zero tokens in each average."""

    weights: np.ndarray
    bias: float
    slope: float
    shift: float
    pull: float


@dataclass
class Bags:
    """Texts as bags of tokens and tokens as bags of buckets, flat: (doc, word, weight) and (of, gram).

    A text's vector is the sum of weight times its words' vectors, a word's vector the mean (by size) of its buckets' embeddings.
    """

    docs: int
    doc: np.ndarray
    word: np.ndarray
    weight: np.ndarray
    of: np.ndarray
    gram: np.ndarray
    size: np.ndarray
    buckets: int = BUCKETS

    def up(self, values: np.ndarray) -> np.ndarray:
        """From one number a bucket to one a text."""
        words = np.bincount(self.of, weights=values[self.gram], minlength=len(self.size)) / self.size
        return np.bincount(self.doc, weights=words[self.word] * self.weight, minlength=self.docs)

    def down(self, values: np.ndarray) -> np.ndarray:
        """The transpose of up: from one number a text to one a bucket."""
        words = np.bincount(self.word, weights=values[self.doc] * self.weight, minlength=len(self.size)) / self.size
        return np.bincount(self.gram, weights=words[self.of], minlength=self.buckets)

    def only(self, kept: np.ndarray, rows: np.ndarray) -> Bags:
        """The same with the kept buckets alone, numbered anew, and without words that have none; other rows' bags become empty."""
        number = np.cumsum(kept) - 1
        held = kept[self.gram]
        telling = np.zeros(len(self.size), bool)
        telling[self.of[held]] = True
        pairs = telling[self.word] & rows[self.doc]
        words = np.cumsum(telling) - 1
        return Bags(self.docs, self.doc[pairs], words[self.word[pairs]], self.weight[pairs], words[self.of[held]], number[self.gram[held]], self.size[telling], int(kept.sum()))

    def frequencies(self, group: np.ndarray, groups: int, step: int = 256) -> np.ndarray:
        """By group of texts and bucket, the texts that have the bucket; `step` texts at a time."""
        out = np.zeros((groups, BUCKETS))
        ends = np.searchsorted(self.of, np.arange(len(self.size) + 1))
        cuts = np.searchsorted(self.doc, np.arange(0, self.docs + step, step))
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            doc, word = self.doc[low:high].astype(np.int64), self.word[low:high]
            many = ends[word + 1] - ends[word]
            at = np.repeat(ends[word] - np.cumsum(many) + many, many) + np.arange(many.sum())
            pairs = np.sort(np.repeat(doc, many) * BUCKETS + self.gram[at])
            pairs = pairs[np.diff(pairs, prepend=-1) > 0]
            out += np.bincount(group[pairs // BUCKETS] * BUCKETS + pairs % BUCKETS, minlength=groups * BUCKETS).reshape(groups, BUCKETS)
        return out


def bags(texts: list[str | None], pull: float) -> Bags:
    """The bags of whole texts; a token counts 1 + ln(count) of the text's total and pull."""
    numbers: dict[str, int] = {}
    doc, word, weight = array("i"), array("i"), array("f")
    for row, text in enumerate(texts):
        counts = tokens(text)
        total = sum(1.0 + math.log(n) for n in counts.values()) + pull
        for token, n in counts.items():
            doc.append(row)
            word.append(numbers.setdefault(token, len(numbers)))
            weight.append((1.0 + math.log(n)) / total)
    gram, of = array("i"), array("i")
    size = np.ones(max(1, len(numbers)))
    for token, number in numbers.items():
        found = features(token)
        size[number] = max(1, len(found))
        gram.extend(found)
        of.extend([number] * len(found))
    flat = lambda a, kind: np.frombuffer(a, kind) if len(a) else np.empty(0, kind)
    return Bags(len(texts), flat(doc, np.int32), flat(word, np.int32), flat(weight, np.float32), flat(of, np.int32), flat(gram, np.int32), size)


def telling(ones: np.ndarray, zeros: np.ndarray, n1: int, n0: int, least_z: float, least_docs: int) -> np.ndarray:
    """The buckets whose share of label-1 texts differs from that of label-0 texts by least_z standard errors (two proportions) and that least_docs texts have."""
    share = (ones + zeros) / (n1 + n0)
    error = np.sqrt(share * (1 - share) * (1 / n1 + 1 / n0))
    return (np.abs(ones / n1 - zeros / n0) >= least_z * error) & (ones + zeros >= least_docs) & (error > 0)


def gradients(bag: Bags, y: np.ndarray, rows: np.ndarray, e: np.ndarray, w: np.ndarray, b: np.ndarray, decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the mean cross entropy over rows plus decay / 2 times the squared embeddings: by e, by w and by b.

    The network is linear up to the softmax, and a softmax of two depends on the difference of its logits alone, so one number a
    bucket stands for its embedding, and the gradients by the two logits are each other's opposites.
    """
    z = bag.up(e @ (w[:, 1] - w[:, 0])) + b[1] - b[0]
    slope = (1 / (1 + np.exp(-np.clip(z, -700, 700))) - y) * (rows / rows.sum())
    sides = np.array([-1.0, 1.0])
    back = np.outer(bag.down(slope), sides)
    return back @ w.T + decay * e, e.T @ back, slope.sum() * sides


def _fitted(whole: Bags, y: np.ndarray, rows: np.ndarray, kept: np.ndarray, dim: int, steps: int, rate: float, decay: float, seed: int) -> tuple[np.ndarray, float]:
    """Weights by bucket and bias, trained on rows over the kept buckets by Adam with a falling rate."""
    bag = whole.only(kept, rows)
    rng = np.random.default_rng(seed)
    e = rng.normal(0.0, 0.1, (bag.buckets, dim))
    w, b = rng.normal(0.0, 1.0, (dim, 2)), np.zeros(2)
    rows = rows.astype(float)
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in (e, w, b)]
    for step in range(1, steps + 1):
        now = rate * (0.5 + 0.5 * math.cos(math.pi * (step - 1) / steps))
        for p, g, (m, v) in zip((e, w, b), gradients(bag, y, rows, e, w, b, decay), moments, strict=True):
            m *= 0.9
            m += 0.1 * g
            v *= 0.999
            v += 0.001 * g * g
            p -= now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-10)
    weights = np.zeros(BUCKETS)
    weights[kept] = (e @ w) @ (-1.0, 1.0)
    return weights, float(b[1] - b[0])


def train(texts: list[str | None], labels: list[int], *, dim: int = 8, steps: int = 60, rate: float = 0.5, decay: float = 3e-7, pull: float = 20.0, least_docs: int = 3, least_z: float = 3.0, folds: int = 3, seed: int = 7) -> Model:
    """Fit the embeddings and the softmax together on whole texts.

    A token's vector is the mean of its features' embeddings; a text's vector is the mean of its distinct tokens'
    vectors, weighted by 1 + ln(count), with `pull` zero tokens more, so that a few words can't decide. Only features
    whose share of texts differs between the labels by least_z standard errors have an embedding, the others stay
    zero: with few labels, what a text says by chance would else be learnt by heart. The slope and shift that turn
    logits into probabilities come from cross-fitting: each of `folds` parts of the texts, chosen by their hash, gets
    the logits of a model trained on the others (features chosen on the others too).
    """
    y = np.array(labels, int)
    n1, n0 = int((y == 1).sum()), int((y == 0).sum())
    if not n1 or not n0:
        share = (n1 + 1) / (len(y) + 2)
        return Model(np.zeros(BUCKETS), 0.0, 1.0, math.log(share / (1 - share)), pull)
    whole = bags(texts, pull)
    fold = np.array([zlib.crc32((t or "").encode("utf-8", "surrogatepass")) % folds for t in texts])
    counts = whole.frequencies(fold * 2 + y, 2 * folds).reshape(folds, 2, BUCKETS)

    def fitted(rows: np.ndarray, without: int | None) -> tuple[np.ndarray, float] | None:
        some = counts.sum(axis=0) if without is None else counts.sum(axis=0) - counts[without]
        k1, k0 = int(y[rows].sum()), int((1 - y[rows]).sum())
        return _fitted(whole, y, rows, telling(some[1], some[0], k1, k0, least_z, least_docs), dim, steps, rate, decay, seed) if k1 and k0 else None

    logit, known = np.zeros(len(y)), np.zeros(len(y), bool)
    for part in range(folds):
        rows = fold != part
        if (~rows).any() and (found := fitted(rows, part)):
            logit[~rows] = whole.up(found[0])[~rows] + found[1]
            known |= ~rows
    weights, bias = fitted(np.ones(len(y), bool), None)
    slope, shift = calibration(logit[known], y[known])
    return Model(weights, bias, slope, shift, pull)


def calibration(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through logits x with labels y (Platt, with smoothed labels), both labels weighing the same; 1 and 0 without both."""
    n1, n0 = np.count_nonzero(y == 1), np.count_nonzero(y == 0)
    if not n1 or not n0:
        return 1.0, 0.0
    want = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, len(y) / (2 * n1), len(y) / (2 * n0))
    a = np.array([1.0, 0.0])

    def loss(a: np.ndarray) -> float:
        z = a[0] * x + a[1]
        return float((weight * (np.logaddexp(0, z) - want * z)).sum() + 0.5 * (a[0] - 1) ** 2)

    for _ in range(50):  # Newton's method; a step that does not help is halved
        q = 1 / (1 + np.exp(-np.clip(a[0] * x + a[1], -700, 700)))
        h, off = weight * q * (1 - q), weight * (q - want)
        grad = np.array([(off * x).sum() + a[0] - 1, off.sum()])
        step = np.linalg.solve(np.array([[(h * x * x).sum() + 1, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]]), grad)
        size, now = 1.0, loss(a)
        while size > 1e-6 and not loss(a - size * step) <= now:
            size /= 2
        if size <= 1e-6 or np.abs(size * step).max() < 1e-9:
            break
        a = a - size * step
    return (float(a[0]), float(a[1])) if a[0] > 0 else (1.0, 0.0)


class Scorer(dict):
    """A token's logit by token, kept for tokens met again; emptied when grown to its limit."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.weight = model.weights.tolist().__getitem__

    def __missing__(self, token: str) -> float:
        if len(self) >= _WORDS_KEPT:
            self.clear()
        found = features(token)
        value = self[token] = sum(map(self.weight, found)) / len(found) if found else 0.0
        return value

    def logit(self, text: str | None) -> float:
        total, weights = 0.0, self.model.pull
        for token, n in tokens(text).items():
            weight = 1.0 if n == 1 else 1.0 + math.log(n)
            weights += weight
            total += weight * self[token]
        return total / weights + self.model.bias

    def score(self, text: str | None) -> float:
        z = self.model.slope * self.logit(text) + self.model.shift
        return 1 / (1 + math.exp(-min(700.0, max(-700.0, z))))


def _held_out(doc_id: str):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, *, positives: int = 1_500, negatives: int = 5_000, seed: int = 42, **options) -> Model:
    """Train on at most `positives` and `negatives` labelled documents, the first by hashed doc_id of those not held out.

    Rows whose crc32(doc_id as text) mod 3 is 1 are held out and never looked at. Of several labels of a document the
    greatest counts; null labels and ids don't count. Only the sample's whole texts come to the driver.
    """
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(~_held_out("doc_id")).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").cast("int").alias("label"))
    drawn = known.withColumn("draw", hashed_uniform(F.lit(seed), F.col("label_id"))).orderBy("draw", "label_id")
    sample = drawn.where("label = 1").limit(positives).union(drawn.where("label = 0").limit(negatives)).select("label_id", "label")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("label_id", "label", "text").collect()
    rows.sort(key=lambda r: (r["label_id"], r["text"] or ""))
    return train([r["text"] for r in rows], [r["label"] for r in rows], **options)


def score_toxicity(docs: DataFrame, model: Model, *, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of each row, from its whole text alone.

    Nulls and odd input: null, empty and blank texts get the score of an empty average. A null doc_id isn't held out;
    rows that repeat a doc_id are scored each for itself. Further columns are ignored. An empty table gives an empty
    result.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([scorer.score(t.as_py()) for t in batch.column(2)], pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out("doc_id").alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, held_out boolean, score double")
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: Model, *, threshold: float = 0.7) -> DataFrame:
    """docs without the rows whose whole text scores threshold or more; all columns pass, null texts score as empty."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield texts.map(scorer.score)

    return docs.where(score(F.col("text").cast("string")) < threshold)
