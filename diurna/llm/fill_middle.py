"""Fill-in-middle: a text is cut into prefix, middle and suffix at unit borders and put in another order.

A unit is a line with its end. `regexp_count` gives the number n of units; two numbers from a
hash of the id choose borders a <= b, and one pattern per row, with possessive counted groups
`(unit{a}+)(unit{b-a}+)(rest)`, captures the three parts in a single match, whose replacement
is the output. Possessive groups are matched in a loop: no recursion over units, no way back.

Forms: `psm` is `<P>`prefix`<S>`suffix`<M>`middle, `spm` is `<S>`suffix`<P>`prefix`<M>`middle,
`plain` is the text. A text that holds a marker stays plain, so markers are found again
without doubt and `restored` rebuilds the text from output and form alone.

All steps are built-in expressions on one row: no shuffle, and a lost task is simply run again.

Defined results: a null text is empty, an empty text is plain; a null id takes part as an
empty decimal; copies of a row get the same result; other columns pass through, but those
named like the results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line with its end, or what stands after the last one.
LINE = r"[^\n]*+\n|[^\n]++"
MARKS = ("<P>", "<S>", "<M>")


def _draws(ident: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def _replaced(text: str, pattern: Column, by: Column) -> Column:
    return F.regexp_replace(F.col(text), pattern, by)


def transformed(docs: DataFrame, seed: int = 7, percent: int = 100, spm_percent: int = 50, unit: str = LINE,
                text: str = "text", ident: str = "doc_id") -> DataFrame:
    """docs with n, form, output, prefix_chars and middle_chars.

    percent: share of the texts that are transformed; spm_percent: share of those in the form spm.
    """
    p, s, m = MARKS
    h1, h2, h3, h4 = _draws(F.col(ident), seed)
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains(F.col("_text"), F.lit(mark))
    plain = (F.col("_text") == "") | marked | (h3 % 100 >= percent)
    first, second = (h % (F.col("n") + 1) for h in (h1, h2))
    pattern = F.format_string(f"\\A((?:{unit}){{%d}}+)((?:{unit}){{%d}}+)([\\s\\S]*+)",
                              F.col("_a").cast("int"), (F.col("_b") - F.col("_a")).cast("int"))
    order = F.when(F.col("form") == "spm", f"{s}$3{p}$1{m}$2").otherwise(f"{p}$1{s}$3{m}$2")
    at = lambda mark: F.instr(F.col("output"), mark)
    prefix = F.when(F.col("form") == "spm", at(m) - at(p) - 3).when(F.col("form") == "psm", at(s) - 4)
    middle = F.when(F.col("form") != "plain", F.char_length("output") - at(m) - 2)
    return (
        docs.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
        .withColumn("n", F.regexp_count(F.col("_text"), F.lit(unit)).cast("long"))
        .withColumns({"form": F.when(plain, "plain").when(h4 % 100 < spm_percent, "spm").otherwise("psm"),
                      "_a": F.least(first, second), "_b": F.greatest(first, second)})
        .withColumn("output", F.when(F.col("form") == "plain", F.col("_text")).otherwise(_replaced("_text", pattern, order)))
        .withColumns({"prefix_chars": prefix.cast("long"), "middle_chars": middle.cast("long")})
        .drop("_text", "_a", "_b")
    )


def restored(output: str = "output", form: str = "form") -> Column:
    """The text again, from an output and its form."""
    p, s, m = MARKS
    rest = r"([\s\S]*)"
    return (
        F.when(F.col(form) == "psm", _replaced(output, F.lit(rf"\A{p}{rest}{s}{rest}{m}{rest}\z"), F.lit("$1$3$2")))
        .when(F.col(form) == "spm", _replaced(output, F.lit(rf"\A{s}{rest}{p}{rest}{m}{rest}\z"), F.lit("$2$3$1")))
        .otherwise(F.col(output))
    )


def digests(docs: DataFrame) -> DataFrame:
    """The digest columns of every document; equal digests of text and restored text are the round trip."""
    out = transformed(docs.select("doc_id", "text"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(), 256).alias("restored_sha256"))
