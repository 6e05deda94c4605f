"""Quality rules: a table of thresholds compiled into one projection over the texts.

Words are runs of anything but ASCII white space (20, 09-0D). Everything is built-in
expressions on one row, so there is no shuffle and no Python.

Defined results: a null or empty text has no words, every measure is 0 and the base rule
fails. Copies are judged alike. Columns of the input that are not asked for are not read,
so clashing names do no harm. Three-word windows are compared by their 64-bit xxHash.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The commonest function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which "
    "der die und das den von zu mit sich des auf für ist im dem nicht ein eine als auch es an er hat "
    "le la les de des du et un une en que qui dans pour par sur pas plus au avec ce il sont elle ou "
    "el los las y del se una por con no su para al lo como más o pero sus"
).split()


@dataclass(frozen=True)
class Rule:
    """A text passes if low <= measure / per <= high; an open end is None."""

    measure: str
    per: str | None
    low: float | None
    high: float | None


#: The base rule is part of the contract; the others may be replaced by the caller.
BASE = (Rule("n_words", None, 50, None), Rule("n_repeat_words", "n_words", None, 0.5))
RULES = (
    Rule("word_chars", "n_words", 2.0, 14.0),
    Rule("n_symbols", "n_words", None, 0.1),
    Rule("n_stop_words", "n_words", 0.02, None),
    Rule("n_dup_lines", "n_word_lines", None, 0.5),
    Rule("n_bang_words", "n_words", None, 0.3),
)

WHITE = "\t\n\x0b\x0c\r"


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated(words: Column) -> Column:
    """Number of words inside three-word windows that occur twice or more."""

    def marked(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def covered(s: Column) -> Column:
            same = lambda a, b: F.coalesce(F.get(s, a)["h"] == F.get(s, b)["h"], F.lit(False))
            hit = F.filter(s, lambda x, k: same(k, k - 1) | same(k, k + 1))
            return F.size(F.array_distinct(F.flatten(F.transform(
                hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(pairs, covered))

    windows = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 2, F.lit(0))),
                          lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))
    return _let(windows, marked)


def _measured(text: Column) -> Column:
    """The measures of a text as one struct.

    Words, lines and hashes are bound to lambda variables, never to columns: a filter on a
    verdict is pushed below the projection with its expressions written out, and a column
    named inside a lambda would then be computed again for every word.
    """

    def of_parts(t: Column, words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.char_length(F.translate(t, " " + WHITE, "")).cast("long").alias("word_chars"),
            (F.char_length(t) - F.char_length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
            F.size(lines).cast("long").alias("n_word_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(F.filter(words, lambda w: F.lower(w).isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
            F.size(F.filter(words, lambda w: w.endswith("!"))).cast("long").alias("n_bang_words"),
            _repeated(words).cast("long").alias("n_repeat_words"),
        )

    def words(t: Column) -> Column:
        return F.array_remove(F.split(F.translate(t, WHITE, " " * len(WHITE)), " "), "")

    def lines(t: Column) -> Column:
        return F.filter(F.split(t, "\n", -1), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))

    return _let(F.coalesce(text, F.lit("")),
                lambda t: _let(words(t), lambda w: _let(lines(t), lambda x: of_parts(t, w, x))))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_word_lines", "n_dup_lines", "n_stop_words", "n_bang_words", "n_repeat_words")


def measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measures of the rules as further columns."""
    return docs.withColumn("_m", _measured(F.col(text))).withColumns({n: F.col("_m")[n] for n in MEASURES}).drop("_m")


def passes(rules: tuple[Rule, ...], measure: Callable[[str], Column] = F.col) -> Column:
    """The table as one boolean expression; a rule per nothing (0 words, 0 lines) is compared as 0."""
    verdict = F.lit(True)
    for r in rules:
        # measure against bound * per: no division, so no special case at zero
        per = measure(r.per).cast("double") if r.per else F.lit(1.0)
        if r.low is not None:
            verdict = verdict & (measure(r.measure) >= F.lit(float(r.low)) * per)
        if r.high is not None:
            verdict = verdict & (measure(r.measure) <= F.lit(float(r.high)) * per)
    return verdict


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with measures, base_failed and kept, all from one expression: whoever filters on one pays once."""

    def verdicts(m: Column) -> Column:
        base = passes(BASE, lambda n: m[n])
        return F.struct(*[m[n].alias(n) for n in MEASURES], (~base).alias("base_failed"),
                        (base & passes(rules, lambda n: m[n])).alias("kept"))

    out = docs.withColumn("_m", _let(_measured(F.col(text)), verdicts))
    return out.withColumns({n: F.col("_m")[n] for n in (*MEASURES, "base_failed", "kept")}).drop("_m")
