"""Token counts under a unigram model, by dynamic programming shared along a trie of distinct pre-tokens."""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.batches import small_batches

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
_CHARS, _WORDS = 2_000_000, 300_000


def load_pieces(path: str) -> dict[str, float]:
    """Pieces of a vocabulary file and their log probabilities.

    A unigram SentencePiece model has them as scores. Models whose scores are whole numbers and rank files (.tiktoken)
    only order their pieces by merge; the r-th piece gets Zipf's -ln(r) less the logarithm of the harmonic sum. Control,
    unknown and byte pieces, and ranks that are no UTF-8, are left out.
    """
    if path.endswith(".tiktoken"):
        import base64

        pieces = []
        with open(path, "rb") as lines:
            for token in (base64.b64decode(line.split()[0]) for line in lines if line.strip()):
                try:
                    pieces.append(token.decode("utf-8").replace(" ", MARK))
                except UnicodeDecodeError:
                    continue
    else:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        pieces, scores = [model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids]
        if any(s != int(s) for s in scores):
            return dict(zip(pieces, scores, strict=True))
        pieces = [p for _, p in sorted(zip(scores, pieces, strict=True), key=lambda x: -x[0])]
    pieces = list(dict.fromkeys(p for p in pieces if p))
    total = math.log(sum(1.0 / r for r in range(1, len(pieces) + 1)))
    return {p: -math.log(r) - total for r, p in enumerate(pieces, 1)}


class PieceTrie:
    """Counts tokens of distinct pre-tokens along their trie.

    The trie is walked depth first: pre-tokens come sorted, and the path from the root to the last one is on a stack, so the
    node of a shared prefix is visited once. A node has the best segmentation of its prefix (the forward score): the
    greatest sum of piece scores and, of equal sums, the fewest tokens. It comes from the nodes above it on the
    path that are followed by a piece which ends here. The node of a pre-token's end gives its terminal count.

    A character that no piece covers counts as its UTF-8 bytes, each with a score of 10 below the least piece's.
    """

    def __init__(self, pieces: dict[str, float]):
        self.pieces = pieces
        self.byte_score = min(pieces.values(), default=0.0) - 10.0
        sizes: dict[str, set[int]] = {}
        for piece in pieces:
            if len(piece) > 2:
                sizes.setdefault(piece[-3:], set()).add(len(piece))
        self.sizes = {end: tuple(sorted(n)) for end, n in sizes.items()}

    def counts(self, words) -> dict[str, int]:
        """Token count of each of the distinct words."""
        pieces, sizes, byte_score = self.pieces.get, self.sizes.get, self.byte_score
        scores, tokens, last, out = [0.0], [0], "", {}
        for word in sorted(words):
            depth, shared = 0, min(len(word), len(last))
            while depth < shared and word[depth] == last[depth]:
                depth += 1
            del scores[depth + 1 :], tokens[depth + 1 :]
            for end in range(depth + 1, len(word) + 1):
                score = pieces(word[end - 1])
                if score is None:
                    size = len(word[end - 1].encode("utf-8", "surrogatepass"))
                    best, fewest = scores[end - 1] + size * byte_score, tokens[end - 1] + size
                else:
                    best, fewest = scores[end - 1] + score, tokens[end - 1] + 1
                if end > 1:
                    score = pieces(word[end - 2 : end])
                    if score is not None:
                        score += scores[end - 2]
                        if score > best or (score == best and tokens[end - 2] + 1 < fewest):
                            best, fewest = score, tokens[end - 2] + 1
                    if end > 2:
                        for size in sizes(word[end - 3 : end], ()):
                            if size > end:
                                break
                            score = pieces(word[end - size : end])
                            if score is not None:
                                score += scores[end - size]
                                if score > best or (score == best and tokens[end - size] + 1 < fewest):
                                    best, fewest = score, tokens[end - size] + 1
                scores.append(best)
                tokens.append(fewest)
            out[word] = tokens[len(word)]
            last = word
        return out


def _counts(pieces: dict[str, float]):
    def run(batches):
        trie = PieceTrie(pieces)
        known: dict[str, int] = {}
        for batch in batches:
            texts, start = batch.column(1), 0
            sizes = [len(t.as_py() or "") for t in texts]
            while start < len(texts):
                stop, chars = start, 0
                while stop < len(texts) and (stop == start or chars + sizes[stop] <= _CHARS):
                    chars += sizes[stop]
                    stop += 1
                parts = [[MARK + w for w in (texts[k].as_py() or "").split()] for k in range(start, stop)]
                new = set().union(*parts).difference(known)
                if len(known) + len(new) > _WORDS:
                    known = {}
                    new = set().union(*parts)
                known.update(trie.counts(new))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array([len(p) for p in parts], pa.int64()), pa.array([sum(map(known.__getitem__, p)) for p in parts], pa.int64())], names=["doc_id", "n_words", "n_tokens"])
                start = stop

    return run


def token_counts(docs: DataFrame, *, vocabulary: str = VOCABULARY) -> DataFrame:
    """Words and tokens of each whole text under a unigram model with the pieces of a vocabulary file.

    Pre-tokens are the text's runs of non-space characters, each led by the piece vocabulary's space mark. The pieces,
    at most the vocabulary, are read on the driver and go to the executors with the function; texts are not shuffled.

    Nulls and odd input: null, empty and blank texts have no words and no tokens. doc_id may be null or repeated; each
    row is counted for itself. Further columns are ignored. An empty table gives an empty result.

    Returns doc_id, n_words, n_tokens.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counts(load_pieces(vocabulary)), "doc_id long, n_words long, n_tokens long")
