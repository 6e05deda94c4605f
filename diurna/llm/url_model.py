"""URL filter: rules first, then a character language-model ratio, all in DataFrame operations.

Two smoothed variable-order Markov models, one of the URLs that the rules allow and one of
those they block, predict each character of host and path from up to ORDER characters before
it. A longer context is trusted by how often it was followed by how few different characters
(Witten-Bell), the rest comes from the context one shorter. A URL's score is the mean of
log p(allowed) - log p(blocked) over its characters; the cut-off is calibrated on a fifth of
the ruled URLs that the models have not seen, as the one with the best mean of both hit rates.

Counting combines before the shuffle: the models see one row per distinct string of ORDER + 1
characters. Scores are computed once per distinct URL.

Defined results: null or no `://` gives empty host and path, no rule, and the verdict of the
models for an empty string; repeated rows are judged alike; with no ruled URL of a class its
model is uniform. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from diurna.llm.common import small_or_not, staged

ORDER = 4
ALPHABET = 256
BIN = 0.01
START, END = "\x02", "\x03"

#: The rules, as (host/path, verdict).
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def parts(url: Column) -> tuple[Column, Column]:
    """Host with A-Z lower-cased, and path."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.char_length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def ruled(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; both null without one."""
    name = verdict = F.lit(None).cast("string")
    for rule, what in sorted(rules, key=lambda r: (len(r[0]), r)):
        own, slash, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(slash + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def _grams(rows: DataFrame, order: int) -> DataFrame:
    """rows with one string of order + 1 characters for each character of `s`."""
    padded = F.concat(F.lit(START * order), "s", F.lit(END))
    return rows.withColumn("_p", padded).withColumn("_i", F.explode(F.sequence(F.lit(1), F.char_length("s") + 1))) \
        .withColumn("gram", F.substr("_p", F.col("_i"), F.lit(order + 1))).drop("_p", "_i")


def ratios(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, ratio): log p(last character | those before) in the allowed model less the blocked one.

    counted: (gram, na, nr) with the counts of strings of order + 1 characters, zeros included.
    """
    level = None
    for k in range(order + 1):
        own = counted.groupBy(F.substr("gram", F.lit(order + 1 - k), F.lit(k + 1)).alias("g")).agg(
            F.sum("na").alias("na"), F.sum("nr").alias("nr"))
        context = own.groupBy(F.substr("g", F.lit(1), F.lit(k)).alias("c")).agg(
            *[f for x in ("a", "r") for f in (F.sum(f"n{x}").alias(f"t{x}"), F.sum((F.col(f"n{x}") > 0).cast("long")).alias(f"d{x}"))])
        rows = own.withColumn("c", F.substr("g", F.lit(1), F.lit(k))).join(context, "c")
        if level is None:
            shorter = rows.withColumns({"qa": F.lit(1 / ALPHABET), "qr": F.lit(1 / ALPHABET)})
        else:
            shorter = rows.withColumn("h", F.substr("g", F.lit(2), F.lit(k))).join(level, "h")
        p = {f"p{x}": (F.col(f"n{x}") + (F.col(f"d{x}") + 1) * F.col(f"q{x}")) / (F.col(f"t{x}") + F.col(f"d{x}") + 1)
             for x in ("a", "r")}
        level = shorter.select("g", *[v.alias(n) for n, v in p.items()])
        if k < order:
            level = level.select(F.col("g").alias("h"), F.col("pa").alias("qa"), F.col("pr").alias("qr"))
    return level.select(F.col("g").alias("gram"), (F.log("pa") - F.log("pr")).alias("ratio"))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, order: int = ORDER) -> DataFrame:
    """page_id, host, path, rule, verdict, score (null where a rule decides)."""
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    name, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": name, "given": verdict, "s": F.concat("host", "path")})
    # one row per distinct string, with how many pages have it
    urls = staged(rows.groupBy("s", "given").agg(F.count("*").alias("n"))
                  .withColumn("unseen", F.crc32(F.col("s").cast("binary")) % 5 == 0), "urls")
    learn = lambda what: F.sum(F.when((F.col("given") == what) & ~F.col("unseen"), F.col("n")).otherwise(0))
    counted = staged(_grams(urls, order).groupBy("gram").agg(learn("allow").alias("na"), learn("block").alias("nr")), "grams")
    model = staged(ratios(counted, order), "ratios")
    asked = urls.filter("given is null or unseen")
    scores = staged(_grams(asked, order).join(small_or_not(model), "gram").groupBy("s", "given", "n").agg(
        F.avg("ratio").alias("score")), "scores")
    least = cut_off(scores)
    own = scores.filter("given is null").select("s", "score")
    out = rows.join(own, "s", "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce(
        "given", F.when(F.col("score") >= least, "allow").otherwise("block")).alias("verdict"), "score")


def cut_off(scores: DataFrame) -> float:
    """The score from which a URL is allowed; scores are binned, so few rows come to the driver."""
    bins = scores.filter("given is not null").groupBy(F.floor(F.col("score") / BIN).alias("b")).agg(
        F.sum(F.when(F.col("given") == "allow", F.col("n")).otherwise(0)).alias("a"),
        F.sum(F.when(F.col("given") == "block", F.col("n")).otherwise(0)).alias("r")).orderBy("b").collect()
    good, bad = sum(x.a for x in bins), sum(x.r for x in bins)
    if not good or not bad:
        return 0.0
    best, at, kept, gone = -1.0, 0.0, good, 0
    for x in bins:  # allow from the lower edge of this bin on
        rate = kept / good + gone / bad
        if rate > best:
            best, at = rate, x.b * BIN
        kept, gone = kept - x.a, gone + x.r
    return at
