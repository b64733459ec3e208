"""Quality rules combined by weak supervision, in built-in functions only.

Each rule looks at one feature of a text and votes good, votes bad or
abstains. The votes of all documents are counted by their pattern (at most 3
to the number of rules), expectation-maximisation over those counts estimates
how common good documents are and how often each rule is right when it votes,
and a document is judged by the posterior probability of its pattern. Only
features and pattern counts leave the rows they were computed from; features
are written out once and read back for the verdicts.

Defined results: null, empty and blank texts have no words and fail the base
rules; repeated rows each keep a row; with no rows the prior decides; extra
columns are ignored. Windows are compared by their words, not by hashes:
hashes only find the windows that need comparing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .native import let

BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 3
#: Fewest words, and most percent of words in repeated windows, that the base rules accept.
MIN_WORDS, MAX_REPEAT = 50, 50
#: Expectation-maximisation: rounds, first prior and accuracy on good and bad documents, and their bounds.
ROUNDS, PRIOR, ACCURACY = 50, 0.8, (0.99, 0.3)
PRIOR_BOUNDS, BOUNDS = (0.05, 0.99), ((0.97, 0.9999), (0.2, 0.99))
#: Rules that vote.
RULES = 7
#: Posterior of good quality from which a document is kept.
KEEP = 0.5


def _rule(value: Column, bad, good=None) -> Column:
    """-1 where ``bad`` holds of the value, 1 where ``good`` holds, else 0 (abstains)."""
    vote = F.when(bad(value), -1)
    return (vote if good is None else vote.when(good(value), 1)).otherwise(0).cast("int")


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def rules() -> dict[str, Column]:
    """The votes, by rule, over the columns of ``features``; what a rule is no evidence for, it abstains from."""
    return {
        "length": _rule(F.col("n_words"), lambda x: x < MIN_WORDS, lambda x: x >= 100),
        "word_length": _rule(_share("word_chars", "n_words"), lambda x: (x < 2.5) | (x > 12), lambda x: x.between(4, 9)),
        "dup_lines": _rule(_share("n_dup_lines", "n_lines"), lambda x: (x > 0.3) & (F.col("n_dup_lines") >= 3), lambda x: x == 0),
        "symbols": _rule(_share("n_symbols", "n_words"), lambda x: x > 0.1),
        "repeats": _rule(_share("n_repeat_words", "n_words"), lambda x: x > 0.4),
        "capitals": _rule(_share("n_capitals", "word_chars"), lambda x: x > 0.3),
        "exclamation": _rule(_share("n_exclaims", "n_words"), lambda x: x > 0.3),
    }


def repeat_words(words: Column) -> Column:
    """Words of a text that stand in a WINDOW-word window found twice or more in it."""
    n = F.size(words)
    bits = F.length(F.bin(n))

    def near(w: Column, hashed: Column, b: Column) -> Column:
        """Positions of windows whose hash another one shares, but for its last bits."""
        packed = F.sort_array(F.transform(hashed, lambda h, i: F.call_function(
            "shiftleft", F.call_function("shiftright", h, b), b).bitwiseOR(i.cast("bigint"))))
        top = lambda x: F.call_function("shiftright", x, b)
        return let(packed, lambda s: F.transform(
            F.filter(s, lambda x, i: F.coalesce(top(x) == top(F.get(s, i + 1)), F.lit(False))
                     | F.coalesce(top(x) == top(F.get(s, i - 1)), F.lit(False))),
            lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), b) - 1).cast("int"),
        ))

    def equal(w: Column, at: Column) -> Column:
        """Of these positions, those whose window's words are found at another one."""
        held = F.array_sort(F.transform(at, lambda p: F.struct(F.array_join(F.slice(w, p + 1, WINDOW), " ").alias("w"), p.alias("p"))))
        return let(held, lambda s: F.transform(
            F.filter(s, lambda x, i: F.coalesce(x["w"] == F.get(s, i + 1)["w"], F.lit(False))
                     | F.coalesce(x["w"] == F.get(s, i - 1)["w"], F.lit(False))),
            lambda x: x["p"],
        ))

    def count(w: Column) -> Column:
        hashed = F.transform(F.slice(w, 1, F.size(w) - WINDOW + 1), lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
        return let(near(w, hashed, F.length(F.bin(F.size(w)))), lambda at: F.when(F.size(at) == 0, 0).otherwise(
            F.size(F.array_distinct(F.flatten(F.transform(equal(w, at), lambda p: F.array(p, p + 1, p + 2)))))
        ))

    return F.when(n < 2 * WINDOW - 2, 0).otherwise(let(words, count)).cast("bigint")


def features(docs: DataFrame) -> DataFrame:
    """doc_id and the counts that the rules look at, of whole texts."""
    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    rows = rows.withColumn("words", F.array_remove(F.split("text", BLANK), ""))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = lambda pattern: F.regexp_count("text", F.lit(pattern)).cast("bigint")
    return rows.select(
        "doc_id", F.size("words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        counted("[#*$%&|<>]").alias("n_symbols"),
        let(lines, lambda x: F.struct(
            F.size(x).cast("bigint").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("dup"))).alias("lines"),
        repeat_words(F.col("words")).alias("n_repeat_words"),
        counted("[A-Z]").alias("n_capitals"), counted("!").alias("n_exclaims"),
    ).select("*", F.col("lines.n").alias("n_lines"), F.col("lines.dup").alias("n_dup_lines")).drop("lines")


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> tuple[float, list[tuple[float, float]]]:
    """Prior of good quality, and by rule how often its votes on good and on bad documents are right.

    ``patterns`` says how often each vote pattern was seen. Most bad documents
    are bad in one respect, which few rules see, so a rule may be wrong about
    most bad documents, but hardly about good ones (BOUNDS).
    """
    prior, accuracy = PRIOR, [ACCURACY] * RULES
    total = sum(n for _, n in patterns)
    for _ in range(ROUNDS if total else 0):
        right = [[0.0, 0.0] for _ in accuracy]
        voted = [[0.0, 0.0] for _ in accuracy]
        good = 0.0
        for votes, n in patterns:
            p = posterior(votes, prior, accuracy)
            good += p * n
            for j, v in enumerate(votes):
                if v:
                    voted[j][0] += n * p
                    voted[j][1] += n * (1 - p)
                    right[j][v < 0] += n * (p if v > 0 else 1 - p)
        prior = _clamp(good / total, PRIOR_BOUNDS)
        accuracy = [
            tuple(_clamp((r[k] + ACCURACY[k]) / (v[k] + 1), BOUNDS[k]) for k in (0, 1)) for r, v in zip(right, voted)
        ]
    return prior, accuracy


def _clamp(x: float, bounds: tuple[float, float]) -> float:
    return min(bounds[1], max(bounds[0], x))


def weights(accuracy: tuple[float, float]) -> tuple[float, float]:
    """What a good and what a bad vote add to the log odds of good quality."""
    a, b = accuracy
    return math.log(a / (1 - b)), math.log((1 - a) / b)


def posterior(votes, prior: float, accuracy: list[tuple[float, float]]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(weights(a)[v < 0] for v, a in zip(votes, accuracy) if v)
    return 1 / (1 + math.exp(-odds))


def judge(docs: DataFrame) -> DataFrame:
    """Features of every document with base_failed, quality (posterior of good) and kept."""
    seen = common.materialize(features(docs), "features")
    votes = rules()
    patterns = seen.select(*(v.alias(k) for k, v in votes.items())).groupBy(*votes).agg(F.count(F.lit(1)).alias("n"))
    # at most 3 to the number of rules: 2187 rows, however many documents
    prior, accuracy = fit([(tuple(r)[:-1], r["n"]) for r in patterns.collect()])
    odds = F.lit(math.log(prior / (1 - prior)))
    for vote, a in zip(votes.values(), accuracy):
        good, bad = weights(a)
        odds = odds + F.when(vote > 0, good).when(vote < 0, bad).otherwise(0.0)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    return seen.select("*", failed.alias("base_failed"), (1 / (1 + F.exp(-odds))).alias("quality")).withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= KEEP)
    )


def op7_quality(spark, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality"
    )
