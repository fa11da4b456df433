"""Quality rules as a short-circuit cascade, in DataFrame functions only.

A rule is a Boolean column over the text. Its cost and the share of rows it rejects are measured on
a sample, and the cascade tries the rules in falling order of rejection per cost; a row that a rule
rejects is not shown to the rules after it. The order changes the time, never the verdict."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored

# Fixed values of the contract.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 8
FEW_WORDS, REPEATED_PERCENT = 20, 30

#: Rows of the sample on which rules are timed (chosen by a hash), and how often each is timed.
SAMPLE_ROWS, TIMES = 2000, 2


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, and only where body is: a column by name could be
    replaced by its whole expression at each place where it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.coalesce(F.array_remove(F.split(text, SPACE), ""), F.array().cast("array<string>"))


def char_count(words: Column) -> Column:
    return F.char_length(F.array_join(words, "")).cast("long")


def symbol_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(SYMBOLS)), F.lit(0)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))


def line_count(text: Column) -> Column:
    return F.coalesce(F.size(_lines(text)), F.lit(0)).cast("long")


def duplicate_lines(text: Column) -> Column:
    return F.coalesce(let(_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))), F.lit(0)).cast("long")


def window_hashes(words: Column, width: int = WINDOW) -> Column:
    """A hash of each `width` words in a row; null where there are fewer."""
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.xxhash64(F.slice(words, i, width))))


def repeated_words(hashes: Column, width: int = WINDOW) -> Column:
    """Words in windows found twice or more: only rows with fewer distinct windows than windows sort
    them, so that equal ones meet, and add up the words that each one covers beyond the one before."""
    places = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def meet(ordered: Column) -> Column:
        def same(k, other):
            return F.coalesce(F.get(ordered, k).h == F.get(ordered, other).h, F.lit(False))

        return F.sort_array(F.filter(F.transform(ordered, lambda x, k: F.when(same(k, k - 1) | same(k, k + 1), x.i)), lambda i: i.isNotNull()))

    repeated = let(F.sort_array(places), meet)
    start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(repeated, start, lambda a, i: F.struct((i + width).alias("end"), (a.n + i + width - F.greatest(a.end, i)).alias("n")), lambda a: a.n)
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), covered).otherwise(0).cast("long")


@dataclass(frozen=True)
class Rule:
    """rejects: from the columns text and _words to a Boolean; light: the same from the features."""

    name: str
    rejects: Callable[[Column, Column], Column]
    light: Callable[[], Column]


def _share(part: Column, whole: Column, percent: int) -> Column:
    return 100 * part > percent * whole


def _letterless(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: ~F.rlike(w, F.lit(r"\p{L}")))).cast("long")


def _shouted(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.rlike(w, F.lit(r"\p{Lu}")) & ~F.rlike(w, F.lit(r"\p{Ll}")))).cast("long")


def _number(words: Column) -> Column:
    return F.size(words).cast("long")


def _long_or_short(chars: Column, n: Column) -> Column:
    return (chars < 2 * n) | (chars > 12 * n)


#: What decides without the contract's own two rules; percentages of words or of lines.
RULES = (
    Rule("symbols", lambda t, w: _share(symbol_count(t), _number(w), 10), lambda: _share(F.col("n_symbols"), F.col("n_words"), 10)),
    Rule("word length", lambda t, w: _long_or_short(char_count(w), _number(w)), lambda: _long_or_short(F.col("word_chars"), F.col("n_words"))),
    Rule("equal lines", lambda t, w: _share(duplicate_lines(t), line_count(t), 50), lambda: _share(F.col("n_dup_lines"), line_count(F.col("text")), 50)),
    Rule("words without letters", lambda t, w: _share(_letterless(w), _number(w), 30), lambda: _share(_letterless(F.col("_words")), F.col("n_words"), 30)),
    Rule("shouted words", lambda t, w: _share(_shouted(w), _number(w), 30), lambda: _share(_shouted(F.col("_words")), F.col("n_words"), 30)),
)
BASE = (
    Rule("few words", lambda t, w: F.size(w) < FEW_WORDS, lambda: F.col("n_words") < FEW_WORDS),
    Rule("repeats", lambda t, w: _share(let(window_hashes(w), lambda h: repeated_words(h)), _number(w), REPEATED_PERCENT), lambda: _share(F.col("n_repeat_words"), F.col("n_words"), REPEATED_PERCENT)),
)


def ranked(docs: DataFrame, rules: tuple[Rule, ...], rows: int | None = None) -> list[tuple[Rule, float, float]]:
    """The rules with cost (seconds for the sample) and rejected share, in falling order of
    rejected share per cost; rules that the sample does not tell apart keep their order."""
    rows = docs.count() if rows is None else rows
    share = min(1.0, SAMPLE_ROWS / max(rows, 1))
    near = F.pmod(F.xxhash64("text", "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))
    sample = stored(docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(near).withColumn("_words", words_of(F.col("text"))), "quality-sample")
    n = sample.count()

    def run(rejects: Column) -> tuple[float, int]:
        began = time.perf_counter()
        hit = sample.agg(F.count_if(F.coalesce(rejects, F.lit(False)))).head()[0]
        return time.perf_counter() - began, hit

    idle = min(run(F.size("_words") < 0)[0] for _ in range(TIMES))
    measured = []
    for rule in rules:
        runs = [run(rule.rejects(F.col("text"), F.col("_words"))) for _ in range(TIMES)]
        measured.append((rule, max(1e-3, min(s for s, _ in runs) - idle), runs[0][1] / max(n, 1)))
    return sorted(measured, key=lambda m: -m[2] / m[1])


def cascade(order: list[Rule], rejects: Callable[[Rule], Column]) -> Column:
    """Whether a row passes: the first rule that rejects it ends the row's evaluation."""
    verdict = None
    for rule in order:
        hit = F.coalesce(rejects(rule), F.lit(False))
        verdict = F.when(hit, False) if verdict is None else verdict.when(hit, False)
    return F.lit(True) if verdict is None else verdict.otherwise(True)


def quality_features(docs: DataFrame) -> DataFrame:
    """doc_id, the contract's counts, base_failed and kept of each row of docs(doc_id, text).

    A null text has no words and fails; a null doc_id and repeated rows stay; an empty table gives an
    empty one; other columns are ignored. A window is compared by a 64-bit hash within its own text.
    All counts are of whole texts, row by row: nothing is shuffled."""
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("_words", words_of(F.col("text")))
    counted = (
        rows.withColumn("_hashes", window_hashes(F.col("_words")))
        .select(
            "doc_id", "text", "_words", _number(F.col("_words")).alias("n_words"), char_count(F.col("_words")).alias("word_chars"),
            symbol_count(F.col("text")).alias("n_symbols"), duplicate_lines(F.col("text")).alias("n_dup_lines"),
            F.coalesce(repeated_words(F.col("_hashes")), F.lit(0).cast("long")).alias("n_repeat_words"))
    )
    order = [m[0] for m in ranked(docs, RULES)]
    failed = F.lit(False)
    for rule in BASE:
        failed = failed | rule.light()
    return (
        counted.withColumn("base_failed", failed)
        .withColumn("kept", F.when(F.col("base_failed"), False).otherwise(cascade(order, lambda r: r.light())))
        .drop("text", "_words")
    )


def good_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that no rule rejects, all columns as they are: the contract's two rules and
    the others in one cascade, each computed only for rows that all before it let pass."""
    order = [m[0] for m in ranked(docs, (*BASE, *RULES))]
    text = F.col("text").cast("string")
    return docs.filter(let(words_of(text), lambda words: cascade(order, lambda r: r.rejects(text, words))))
