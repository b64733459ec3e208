"""Language identification, words first, with character n-grams as backoff.

A known word counts its log frequency in each language. An unknown word is
read character by character: at each place the longest known n-gram that ends
there counts (LONGEST characters, else one fewer, down to one), and the word
counts their mean. The frequencies are gathered from a bounded sample of
documents (FIT_ROWS, dealt evenly to the languages) that may be learned from,
all words and all n-grams that stand there LEAST times; a text is predicted
from all of its words.

Defined results: a null text or one without a letter is ``und`` with score 0;
equal sums go to the first language in order of name; repeated rows each keep
a row; where nothing can be learned every text is ``und``; extra columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Documents (about) that are learned from, and occurrences in them from which a word or n-gram is known.
FIT_ROWS, LEAST = 8000, 2
LONGEST = 4
#: Words after which further ones no longer raise the score.
SURE = 20
#: Bytes (about) that a worker spends on sums for unknown words; results do not depend on it.
KEPT_BYTES = 32_000_000

_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(word: str):
    """All n-grams of a word with its boundaries, up to LONGEST characters."""
    marked = f"^{word}$"
    for n in range(1, LONGEST + 1):
        for i in range(len(marked) - n + 1):
            yield marked[i : i + n]


def _count_batches(batches):
    import pyarrow as pa

    for batch, texts in common.slices(batches, 0):
        by_lang: dict[str, Counter] = {}
        for text, lang in zip(texts, batch.column(1).to_pylist()):
            by_lang.setdefault(lang, Counter()).update(words(text.decode("utf-8", "replace")))
        rows = []
        for lang, found in by_lang.items():
            parts: Counter = Counter()
            for word, n in found.items():
                for g in grams(word):
                    parts[g] += n
            rows += [(0, lang, w, n) for w, n in found.items()] + [(1, lang, g, n) for g, n in parts.items()]
        kind, lang, piece, n = (list(x) for x in zip(*rows)) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(kind, pa.int32()), pa.array(lang, pa.string()), pa.array(piece, pa.string()), pa.array(n, pa.int64())],
            names=["kind", "lang", "piece", "n"],
        )


class Model:
    """Log frequencies by language of known words and n-grams: rows of a table by piece."""

    def __init__(self, langs: list[str], word_counts: dict[str, dict[str, int]], gram_counts: dict[str, dict[str, int]]):
        self.langs = langs
        self.words, self.word_logs = self._logs(word_counts)
        self.grams, self.gram_logs = self._logs(gram_counts)

    def _logs(self, counts):
        import numpy as np

        table = np.array([[c.get(lang, 0) for lang in self.langs] for c in counts.values()], np.float64).reshape(len(counts), len(self.langs))
        return dict(zip(counts, range(len(counts)))), np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * (len(counts) + 1)))

    def unknown(self, word: str) -> tuple[float, ...]:
        """Mean of the longest known n-grams that end at each character."""
        marked, found = f"^{word}$", []
        for end in range(2, len(marked) + 1):
            for n in range(min(LONGEST, end), 0, -1):
                at = self.grams.get(marked[end - n : end])
                if at is not None:
                    found.append(at)
                    break
        return tuple(self.gram_logs[found].mean(axis=0)) if found else (0.0,) * len(self.langs)


def fit(docs: DataFrame) -> Model:
    """Learn from the rows of ``docs`` (doc_id, text, lang) that have a lang and are not held out."""
    rows = docs.where((common.remainder(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull())
    rows = rows.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    there = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a language
    if not there:
        return Model([], {}, {})
    shares = F.create_map(*chain.from_iterable((F.lit(lang), F.lit(min(1.0, FIT_ROWS / len(there) / n))) for lang, n in there.items()))
    sample = rows.where(F.abs(F.xxhash64("doc_id", "text", F.lit("langid")) % 1_000_000) < F.element_at(shares, F.col("lang")) * 1_000_000)
    counted = sample.select("text", "lang").mapInArrow(_count_batches, "kind int, lang string, piece string, n bigint")
    counted = common.materialize(counted.groupBy("kind", "piece", "lang").agg(F.sum("n").alias("n")), "langid")
    by_piece = counted.groupBy("kind", "piece").agg(
        F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by_lang")).where(F.col("total") >= LEAST)
    learned: list[dict] = [{}, {}]
    for r in by_piece.select("kind", "piece", "by_lang").toLocalIterator():  # pieces of a bounded sample
        learned[r["kind"]][r["piece"]] = {x["lang"]: x["n"] for x in r["by_lang"]}
    return Model(sorted(there), *(dict(sorted(found.items())) for found in learned))


class Scorer:
    """Sums of log frequencies over the words of a text; words are rows of one matrix."""

    def __init__(self, model: Model):
        import numpy as np

        self.model, width = model, max(1, len(model.langs))
        known = len(model.words)
        self.most = known + max(10_000, KEPT_BYTES // (250 + 8 * width))  # a word and its entry take some 250 bytes
        self.table = np.zeros((self.most, width))
        if known:
            self.table[:known] = model.word_logs
        self.first = known
        self.rows = Rows(self)

    def sums(self, found: list[str]):
        import numpy as np

        total = np.zeros(self.table.shape[1])
        for at in range(0, len(found), 10_000):  # fewer words than unknown rows fit
            part = found[at : at + 10_000]
            if len(self.rows) + len(part) > self.most or self.rows.size > KEPT_BYTES // 10:
                self.rows = Rows(self)
            total += self.table[np.fromiter(map(self.rows.__getitem__, part), np.int64, len(part))].sum(axis=0)
        return total

    def predict(self, text: str) -> tuple[str, float]:
        import numpy as np

        found = words(text)
        if not self.model.langs or not any(c.isalpha() for w in found for c in w):
            return "und", 0.0
        total = self.sums(found)
        best = int(total.argmax())
        spread = np.exp((total - total[best]) * min(1.0, SURE / len(found)))
        return self.model.langs[best], float(1 / spread.sum())


class Rows(dict):
    """Word to its row of the scorer's table; an unknown word gets a new one."""

    def __init__(self, scorer: Scorer):
        super().__init__(scorer.model.words)
        self.scorer, self.size = scorer, 0

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.scorer.table[at] = self.scorer.model.unknown(word)
        self.size += max(0, len(word) - 20)
        return at


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score of every row; the model, bounded by what is kept of it, goes to the executors."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        scorer = Scorer(sent.value)
        for batch, texts in common.slices(batches, 1):
            found = [scorer.predict(t.decode("utf-8", "replace")) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, lang_pred string, score double")


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held = F.coalesce(common.remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return predict(docs, fit(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score")
