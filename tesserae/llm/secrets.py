"""Secret scans in built-in functions: known patterns, and Markov models of random strings.

Base kinds are found by their patterns, leftmost and non-overlapping per kind.
Beyond them, long runs of identifier characters are scored by two first-order
character Markov models, one of random strings and one of ordinary
identifiers: a run whose log-likelihood ratio (random against ordinary) is at
least THRESHOLD is a ``markov`` span. The models learn from labelled samples:
random strings drawn by hashing row numbers and written in several alphabets,
and as ordinary ones the runs of a sample of about SAMPLE documents that no
base kind matches, besides a few common styles of identifier.

Places are code points. Matches of a pattern and the pieces between them
alternate, so running sums of their lengths give all places of a text.

Defined results: a null text is empty; an empty text has no spans; repeated
rows each keep a row; no documents leave the models to the drawn samples and
styles; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .native import let, running, running_sums

#: Kinds in their order: pattern, the group whose length counts, and its least length.
BASE = {
    "assign": (r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    "access": ("AKIA[A-Z0-9]{12,}", 0, 16),  # greedy runs: the same as of one or more, then 16 or more
    "hex": ("[0-9a-f]{32,}", 0, 32),
}
MODEL = "markov"
ORDER = {kind: i for i, kind in enumerate([*BASE, MODEL])}
#: Runs that the models score: their characters (each a state) and least length.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
LEAST = 20
RUN = r"[A-Za-z0-9+/_=-]{%d,}"
#: Natural log of how much likelier random is.
THRESHOLD = 12.0
#: Documents (about) whose runs teach ordinary identifiers, and random strings drawn per alphabet.
SAMPLE, DRAWN = 2000, 500
#: A run that a base kind matches in part, or that is a base kind's keyword, is left to the base kinds.
_TOUCHES = (
    r"""(?i:password|passwd|secret|token|api_?key)(?:["']?\x20*[:=]|$)|AKIA[A-Z0-9]{12}|[0-9a-f]{32}"""
)
#: Styles of ordinary identifiers that a corpus may lack.
STYLES = (
    "get_user_account_name", "MAX_CONNECTION_RETRIES", "application/json", "internationalization", "parseHttpResponse",
    "user-profile-settings-page", "/usr/local/share/documentation", "AbstractFactoryBuilder", "content-security-policy",
    "2024-01-15-release-notes", "test_integration_database_connection", "========================", "------------------------",
    "____________________", "IMPORTANT_CONFIGURATION_VALUE", "index_page_version_2", "images/photos/holiday/beach",
)


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Array of struct<at, end, held>: places of all matches and the group's text."""
    found = F.regexp_extract_all(text, F.lit(pattern), 0)

    def placed(m: Column) -> Column:
        lengths = F.transform(F.arrays_zip(F.slice(F.split(text, pattern), 1, F.size(m)).alias("between"), m.alias("m")),
                              lambda x: (F.char_length(x["between"]) + F.char_length(x["m"])).cast("bigint"))
        held = m if group == 0 else F.regexp_extract_all(text, F.lit(pattern), group)
        return let(held, lambda h: let(running_sums(lengths), lambda s: F.transform(m, lambda x, i: F.struct(
            (F.get(s, i + 1) - F.char_length(x)).alias("at"), F.get(s, i + 1).alias("end"),
            F.coalesce(F.get(h, i), F.lit("")).alias("held")))))

    none = F.array().cast("array<struct<at:bigint,end:bigint,held:string>>")
    return let(found, lambda m: F.when(F.size(m) == 0, none).otherwise(placed(m)))


def _runs(text: Column, least: int) -> Column:
    """Places of the runs that no base kind touches; an assignment is passed over as a whole."""
    both = f"(?:{BASE['assign'][0].replace('(password', '(?:password').replace('([A-Za', '(?:[A-Za')})|({RUN % least})"
    return F.filter(_matches(text, both, 1), lambda x: (x["held"] != "") & ~x["held"].rlike(_TOUCHES))


def _spans(found: Column, kind: str) -> Column:
    return F.transform(found, lambda x: F.struct(
        x["at"].alias("start"), F.lit(ORDER[kind]).alias("kind"), x["end"].alias("end")))


def _steps(run: Column) -> Column:
    """Numbers of the character pairs of a run."""
    at = F.transform(F.split(run, ""), lambda c: F.instr(F.lit(ALPHABET), c) - 1)
    at = F.filter(at, lambda x: x >= 0)
    n = len(ALPHABET)
    return let(at, lambda a: F.transform(F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0))), lambda x, i: x * n + F.get(a, i + 1)))


def train(docs: DataFrame) -> list[float]:
    """Log-likelihood ratio of each character pair, in the order of ALPHABET times ALPHABET."""
    spark, n = docs.sparkSession, len(ALPHABET)
    rows = docs.count()
    share = min(1.0, SAMPLE / rows) if rows else 1.0
    chosen = docs.where(F.abs(F.xxhash64("doc_id", "text", F.lit("sample")) % 1_000_000) < share * 1_000_000)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    ordinary = chosen.select(F.explode(F.transform(_runs(text, 8), lambda x: x["held"])).alias("run")).distinct()
    styles = spark.range(1).select(F.explode(F.array(*map(F.lit, STYLES))).alias("run"))
    drawn = spark.range(DRAWN).select(F.sha2(F.concat(F.lit("secret"), F.col("id")).cast("binary"), 256).alias("h"))
    as64 = F.rtrim(F.base64(F.unhex("h")), F.lit("="))
    random = drawn.select(F.explode(F.array(
        F.col("h"), F.upper("h"), as64, F.translate(as64, "+/", "-_"), F.regexp_replace(as64, "[+/]", ""),
        F.regexp_replace(F.upper(as64), "[+/]", ""), F.regexp_replace(F.lower(as64), "[+/]", ""))).alias("run"))
    labelled = ordinary.unionByName(styles).select("run", F.lit(0).alias("label")).unionByName(random.select("run", F.lit(1).alias("label")))
    steps = labelled.select("label", F.explode(_steps(F.col("run"))).alias("step")).groupBy("label", "step").agg(F.count(F.lit(1)).alias("n"))
    counts = {0: [0.0] * n * n, 1: [0.0] * n * n}
    for r in steps.collect():  # at most two for each pair of ALPHABET
        counts[r["label"]][r["step"]] = r["n"]

    def conditional(c: list[float]) -> list[float]:
        """Log probabilities of the next character, smoothed with how common it is and with all alike."""
        total = sum(c)
        common_ = [(sum(c[j::n]) + 1) / (total + n) for j in range(n)]
        return [math.log((c[i * n + j] + 10 * common_[j]) / (sum(c[i * n : i * n + n]) + 10)) for i in range(n) for j in range(n)]

    return [a - b for a, b in zip(conditional(counts[1]), conditional(counts[0]))]


def scan(docs: DataFrame, ratios: list[float] | None = None, name: str = "found") -> DataFrame:
    """All columns of ``docs`` and one of this name: array<struct<start, kind, end>>, by start and kind (numbers of ORDER).

    A column of ``docs`` that has the name gives way; ``common.unused`` finds one that none has.
    """
    ratios = train(docs) if ratios is None else ratios
    table = F.expr("array(" + ",".join(f"{x:.6f}D" for x in ratios) + ")")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    score = lambda run: F.aggregate(_steps(run), F.lit(0.0), lambda a, s: a + F.get(table, s))

    def long_enough(least: int):
        return lambda x: F.char_length(x["held"]) >= least

    parts = [
        _spans(F.filter(_matches(text, pattern, group), long_enough(least)), kind)
        for kind, (pattern, group, least) in BASE.items()
    ]
    random = F.filter(_runs(text, LEAST), lambda x: score(x["held"]) >= THRESHOLD)
    apart = lambda base: lambda x: ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["at"] < b["end"]))
    found = let(F.concat(*parts), lambda base: F.concat(base, _spans(F.filter(random, apart(base)), MODEL)))
    return docs.withColumn(name, F.array_sort(found))


def _written(found: Column) -> Column:
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redact(docs: DataFrame, mark: str = "[SECRET]", ratios: list[float] | None = None) -> DataFrame:
    """``docs`` with each run of overlapping spans in ``text`` replaced by ``mark``; other columns stay."""
    name = common.unused(docs, "found")
    text = F.col("text").cast("string")

    def replaced(ends: Column) -> Column:
        """``ends``: how far the spans before each span reach, and all spans."""
        between = lambda x, i: F.substring(text, (F.get(ends, i) + 1).cast("int"), (x["start"] - F.get(ends, i)).cast("int"))
        parts = F.transform(name, lambda x, i: F.when(x["start"] < F.get(ends, i), "").otherwise(F.concat(between(x, i), F.lit(mark))))
        return F.concat(F.array_join(parts, ""), F.substring(text, (F.element_at(ends, -1) + 1).cast("int"), F.lit(2**31 - 1)))

    done = let(running(F.transform(name, lambda x: x["end"]), F.greatest), replaced)
    return scan(docs, ratios, name).withColumn("text", F.when(F.size(name) > 0, done).otherwise(F.col("text"))).select(*common.columns(docs))


def op1_secrets(spark, sf_dir: str) -> DataFrame:
    scanned = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda kind: F.size(F.filter("found", lambda x: x["kind"] == ORDER[kind])).cast("bigint")
    base = _written(F.filter("found", lambda x: x["kind"] < ORDER[MODEL]))
    return scanned.select(
        "doc_id", *(number(kind).alias(f"n_{kind}") for kind in BASE),
        F.sha2(base.cast("binary"), 256).alias("base_sha256"), _written(F.col("found")).alias("spans"),
    )
