"""Token counts of a unigram model, with forward scores shared along a trie.

The distinct pre-tokens of a batch are put into a trie; the forward pass over
a prefix (best score and token count up to each of its characters) is done
once, however many pre-tokens continue it, and a pre-token's count is stored
at its last node. Sorted pre-tokens are the trie's words in depth-first order,
so the trie is walked with one path of forward states held at a time.

The pieces come from a public vocabulary. It ranks its pieces without
probabilities, so a piece has the log probability of its rank under Zipf's
law. A character that no piece covers costs its UTF-8 bytes as tokens.

Defined results: null, empty and blank texts have no words and no tokens;
equal scores go to fewer tokens; repeated rows each keep a row; extra columns
are ignored. Texts are counted whole.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: What stands before each pre-token in the vocabulary.
MARK = "▁"
#: Log probability of each byte of a character outside the vocabulary.
BYTE_SCORE = -20.0
#: Pre-tokens whose counts a worker keeps, and characters of the longest such; results do not depend on them.
KEPT, LONG = 400_000, 64


def load_pieces(path: str) -> dict[str, float]:
    """Ordinary pieces of a sentencepiece model, with Zipf log probabilities by rank."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [
        model.id_to_piece(i) for i in range(model.get_piece_size())
        if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i))
    ]
    whole = math.log(sum(1 / (rank + 1) for rank in range(len(pieces))))
    return {piece: -math.log(rank + 1) - whole for rank, piece in enumerate(pieces)}


class Walk:
    """Depth-first walk of the trie of sorted words, with the forward states of one path."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)

    def counts(self, words: list[str]) -> dict[str, tuple[float, int]]:
        """Best score and token count of each of the sorted distinct words."""
        scores, longest = self.scores, self.longest
        path, best, number, found = "", [0.0], [0], {}
        for word in words:
            shared, most = 0, min(len(path), len(word))
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del best[shared + 1 :], number[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                size = len(word[end - 1].encode("utf-8", "replace"))
                top, few = best[end - 1] + BYTE_SCORE * size, number[end - 1] + size
                for start in range(max(0, end - longest), end):
                    score = scores.get(word[start:end])
                    if score is not None:
                        score += best[start]
                        if score > top or score == top and number[start] + 1 < few:
                            top, few = score, number[start] + 1
                best.append(top)
                number.append(few)
            found[word] = (best[-1], number[-1])
            path = word
        return found


def _count_batches(pieces):
    def run(batches):
        import pyarrow as pa

        walk, kept = Walk(pieces.value), {}
        for batch, found in common.slices(batches, 1):
            texts = [[MARK + w for w in b.decode("utf-8", "replace").split()] for b in found]
            new = {w for words in texts for w in words} - kept.keys()
            if len(kept) + len(new) > KEPT:
                kept.clear()
                new = {w for words in texts for w in words}
            found = walk.counts(sorted(new))
            kept |= {w: x for w, x in found.items() if len(w) <= LONG}
            pairs = [[kept.get(w) or found[w] for w in words] for words in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array(list(map(len, texts)), pa.int64()),
                    pa.array([sum(n for _, n in p) for p in pairs], pa.int64()),
                    pa.array([math.fsum(s for s, _ in p) for p in pairs], pa.float64()),
                ],
                names=["doc_id", "n_words", "n_tokens", "log_prob"],
            )

    return run


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens and log_prob (natural, of the best segmentations) of every text."""
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(path))  # as large as a vocabulary
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count_batches(pieces), "doc_id bigint, n_words bigint, n_tokens bigint, log_prob double")


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
