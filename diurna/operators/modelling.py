"""Evaluation, calibration, ensembling and Spark ML training over feature tables."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import Bucketizer, Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diurna import wording
from diurna.functions import exprs as E
from diurna.operators import ordering as O

RISKS = ["depression", "hypomanic", "manic"]


# ---- evaluation ------------------------------------------------------------------

def binary_metrics(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    y, p = F.col(truth) == 1, F.col(predicted) == 1
    g = rows.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"),
                 F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return g.select(
        "*", E.ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), E.ratio(tp, tp + fp).alias("precision"),
        E.ratio(tp, tp + fn).alias("recall"), E.ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        E.ratio(tn, tn + fp).alias("specificity"))


def auc(rows: DataFrame, truth: str, score: str, slots: int = 256) -> DataFrame:
    """Rank-sum area under the ROC curve with ties counted half.

    Rows collapse to distinct scores first. The running count of negatives is
    taken inside score slots and carried over the slot totals. Slots end at
    approximate quantiles of the distinct scores, so they are even for margins of
    any range and for crowded scores; the result does not depend on where they end.
    """
    s = rows.groupBy(F.col(score).cast("double").alias("s")).agg(
        F.sum((F.col(truth) == 1).cast("long")).alias("pos"), F.sum((F.col(truth) != 1).cast("long")).alias("neg"))
    s = s.withColumn("one", F.lit(1))
    ends = sorted(set(s.approxQuantile("s", [i / slots for i in range(1, slots)], 1 / (2 * slots))))
    s = Bucketizer(splits=[float("-inf"), *ends, float("inf")], inputCol="s", outputCol="slot", handleInvalid="keep").transform(s)
    s = O.ordered_scan(s, ["one"], F.col("slot").cast("long"), ["s"], below=O.running_sum(F.col("neg")))
    pairs = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2))
    return s.agg((pairs / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def time_splits(rows: DataFrame, folds: int = 3, test_share: float = 0.2) -> DataFrame:
    """Expanding training folds, each followed by a test block, over each user's dates."""
    order = W.partitionBy("user_id").orderBy("date")
    n = F.count(F.lit(1)).over(W.partitionBy("user_id"))
    # positions first: a generator in the same projection would multiply the windowed rows
    r = rows.select("*", (F.row_number().over(order) - 1).alias("_i"), n.alias("_n"))
    r = r.select("*", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    size = F.floor(F.col("_n") * test_share)
    start = F.col("_n") - (folds - F.col("fold")) * size
    part = E.ladder((F.col("_i") < start, "train"), (F.col("_i") < start + size, "test"), otherwise=F.lit(None))
    return r.withColumn("part", F.when((size > 0) & (start > 0), part)).filter("part IS NOT NULL").drop("_i", "_n")


# ---- calibration and ensembling ----------------------------------------------------

def calibration_factor(rows: DataFrame, prob: str, truth: str, keys: list[str]) -> DataFrame:
    """Accuracy among confident predictions plus 0.2, at most 1; none confident gives 1."""
    p = F.col(prob)
    sure = (p > 0.8) | (p < 0.2)
    right = ((p > 0.5).cast("int") == F.col(truth)).cast("int")
    return rows.groupBy(*keys).agg(
        F.coalesce(F.least(F.lit(1.0), F.avg(F.when(sure, right)) + 0.2), F.lit(1.0)).alias("factor"))


def calibrated(prob: Column, factor: Column) -> Column:
    """Shrink confident probabilities toward one half; without a factor leave them."""
    f = F.coalesce(factor, F.lit(1.0))
    return E.clamp(E.ladder((prob > 0.7, 0.5 + (prob - 0.5) * f), (prob < 0.3, 0.5 - (0.5 - prob) * f),
                            otherwise=prob), 0, 1)


def confidence(*probs: Column) -> Column:
    top = F.greatest(*probs) if len(probs) > 1 else probs[0]
    return F.abs(top - 0.5) * 2


def ensemble(statistical: DataFrame, sequence: DataFrame, weight: float = 0.6) -> DataFrame:
    """Weighted mean of two score tables; whichever exists alone counts whole; neither gives 0.5."""
    cols = [*RISKS, "confidence"]
    a = statistical.select("user_id", "date", *[F.col(c).alias(f"a_{c}") for c in cols])
    b = sequence.select("user_id", "date", *[F.col(c).alias(f"b_{c}") for c in cols])
    j = a.join(b, ["user_id", "date"], "full")

    def mixed(c: str, share: float, neither: float) -> Column:
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        return F.coalesce(x * share + y * (1 - share), x, y, F.lit(neither)).alias(c)

    return j.select("user_id", "date", *[mixed(c, weight, 0.5) for c in RISKS], mixed("confidence", 0.5, 0.0))


def enhanced_vector(statistical: Column, sequence: Column, head: int = 20, tail: int = 16) -> Column:
    """Leading statistical features, then sequence features, padded with zeros."""
    v = F.concat(F.slice(statistical, 1, head), F.slice(sequence, 1, tail))
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), head + tail - F.size(v))))


def highest_risk(*names: str) -> list[Column]:
    top = F.greatest(*[F.col(n) for n in names])
    return [E.ladder(*[(F.col(n) == top, n) for n in names], otherwise=F.lit(None)).alias("risk_type"),
            top.alias("risk_value")]


# ---- training and scoring ----------------------------------------------------------

def train(features: DataFrame, inputs: list[str], label: str, weight: str | None = None,
          rounds: int = 20, depth: int = 3) -> PipelineModel:
    """Boosted trees over the named inputs; all of them must be present.

    A missing input takes the mean of its column, in training and in scoring, so
    every row is used and gets a score. Rows without a label are not trained on.
    """
    missing = [c for c in [*inputs, label] if c not in features.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    filled = [f"_filled_{c}" for c in inputs]
    imputer = Imputer(inputCols=inputs, outputCols=filled, strategy="mean")
    assembler = VectorAssembler(inputCols=filled, outputCol="_features", handleInvalid="keep")
    trees = GBTClassifier(featuresCol="_features", labelCol=label, maxIter=rounds, maxDepth=depth, seed=7)
    trees = trees.setPredictionCol(f"{label}_predicted").setProbabilityCol(f"{label}_probability")
    trees = trees.setRawPredictionCol(f"{label}_raw")
    if weight:
        trees = trees.setWeightCol(weight)
    return Pipeline(stages=[imputer, assembler, trees]).fit(features.filter(F.col(label).isNotNull()))


def score(features: DataFrame, models: dict[str, PipelineModel], labels: dict[str, str]) -> DataFrame:
    """Probability per risk and the confidence of the largest."""
    out = features
    for risk, model in models.items():
        label = labels[risk]
        filled = model.stages[0].getOutputCols()
        out = model.transform(out).withColumn(risk, vector_to_array(f"{label}_probability")[1]).drop(
            *filled, "_features", f"{label}_probability", f"{label}_raw", f"{label}_predicted")
    return out.withColumn("confidence", confidence(*[F.col(r) for r in models]))


# ---- several risks from one fit, scored out of fold ------------------------------------

def _cuts(rows: DataFrame, inputs: list[str], bins: int) -> dict[str, list[float]]:
    """Inner borders of each input's bins, at quantiles; a few numbers per input."""
    levels = [i / bins for i in range(1, bins)]
    found = rows.approxQuantile(inputs, levels, 0.01)
    return {c: sorted(set(q)) for c, q in zip(inputs, found)}


def _bin(column: str, cuts: list[float]) -> Column:
    """1 for a missing input, then 2 and up."""
    above = reduce(lambda a, b: a + b, [(F.col(column) >= x).cast("int") for x in cuts], F.lit(0))
    return F.when(F.col(column).isNull() | F.isnan(F.col(column).cast("double")), 1).otherwise(2 + above)


@dataclass(frozen=True)
class RiskModels:
    """Additive log odds over shared bins: per fold and risk a start value and a value per input and bin."""

    cuts: dict[str, list[float]]
    start: dict[tuple[int, str], float]
    parts: dict[tuple[int, str], dict[str, list[float]]]

    def log_odds(self, fold: int, risk: str, bin_of: Callable[[str], Column]) -> Column:
        terms = [F.element_at(F.array(*[F.lit(v) for v in values]), bin_of(c)) for c, values in self.parts[fold, risk].items()]
        return reduce(lambda a, b: a + b, terms, F.lit(self.start[fold, risk]))


def chance(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


def split_flags(rows: DataFrame, folds: int = 3, test_share: float = 0.2) -> DataFrame:
    """Per (user, date): in which folds it trains (train_0, ...) and the one fold that tests it, if any."""
    parts = time_splits(rows.select("user_id", "date").distinct(), folds, test_share)
    is_ = lambda k, p: (F.col("fold") == k) & (F.col("part") == p)
    return parts.groupBy("user_id", "date").agg(
        *[F.max(is_(k, "train")).alias(f"train_{k}") for k in range(folds)],
        F.min(F.when(F.col("part") == "test", F.col("fold"))).alias("tested_in"))


def fit_risks(flagged: DataFrame, inputs: list[str], labels: dict[str, str], folder: str, folds: int = 3, bins: int = 8,
              cycles: int = 2, rate: float = 0.5, ridge: float = 5.0) -> RiskModels:
    """Boosted additive models of all risks and folds together, over one binned table.

    Rows are first reduced to distinct combinations of bins with counts and label sums per fold,
    written once to ``folder``: rounds run over that table, however many rows stood behind it. A
    round improves one input's values in every model by a Newton step, from one aggregate with a
    row per bin, which is all that the driver sees. Bins are cut on the rows that the first fold
    trains on. Rows without a label count for the other labels only.
    """
    cuts = _cuts(flagged.filter("train_0"), inputs, bins)
    binned = flagged.select(*[_bin(c, cuts[c]).alias(c) for c in inputs], *labels.values(), *[f"train_{k}" for k in range(folds)])
    sums = []
    for k in range(folds):
        for y in labels.values():
            known = F.col(f"train_{k}") & F.col(y).isNotNull()
            sums += [F.sum(F.when(known, 1.0).otherwise(0.0)).alias(f"n_{k}_{y}"),
                     F.sum(F.when(known, F.col(y).cast("double")).otherwise(0.0)).alias(f"y_{k}_{y}")]
    binned.groupBy(*inputs).agg(*sums).write.mode("overwrite").parquet(folder)
    cells = flagged.sparkSession.read.parquet(folder)
    models = [(k, risk) for k in range(folds) for risk in labels]
    name = lambda kind, m: f"{kind}_{m[0]}_{labels[m[1]]}"
    totals = cells.agg(*[F.sum(name(kind, m)).alias(name(kind, m)) for m in models for kind in "ny"]).first()
    start = {}
    for m in models:
        n, y = (totals[name(kind, m)] or 0.0 for kind in "ny")
        start[m] = math.log((y + 1) / (n - y + 1))
    fitted = RiskModels(cuts, start, {m: {c: [0.0] * (len(cuts[c]) + 2) for c in inputs} for m in models})
    for _ in range(cycles):
        for c in inputs:
            steps = []
            for m in models:
                p = chance(fitted.log_odds(*m, F.col))
                n = F.col(name("n", m))
                steps += [F.sum(F.col(name("y", m)) - n * p).alias(name("g", m)), F.sum(n * p * (1 - p)).alias(name("h", m))]
            for r in cells.groupBy(c).agg(*steps).collect():
                for m in models:
                    fitted.parts[m][c][r[c] - 1] += rate * r[name("g", m)] / (r[name("h", m)] + ridge)
    return fitted


def score_risks(flagged: DataFrame, models: RiskModels, risks: list[str], folds: int = 3) -> DataFrame:
    """(user_id, date), a probability per risk and the confidence, by the fold that tests the row.

    That fold's models trained on none of the user's nights from its block on, so no row is scored
    by a model that saw it. Rows that no fold tests, the first ones of each user, are not scored.
    """
    tested = flagged.filter("tested_in IS NOT NULL")
    bin_of = lambda c: _bin(c, models.cuts[c])
    out = [E.ladder(*[(F.col("tested_in") == k, chance(models.log_odds(k, r, bin_of))) for k in range(folds)], otherwise=F.lit(None)).alias(r)
           for r in risks]
    return tested.select("user_id", "date", *out).withColumn("confidence", confidence(*[F.col(r) for r in risks]))


def with_model(features: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: T.StructType) -> DataFrame:
    """Hook for an external scorer: one Arrow batch in, one frame out, within each partition."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return features.mapInPandas(run, schema)


# ---- summaries ---------------------------------------------------------------------

def risk_summary(scores: DataFrame, warned: Column) -> DataFrame:
    """Mean risks per user; any warning lowers the confidence by three tenths."""
    return scores.groupBy("user_id").agg(
        *[F.avg(r).alias(f"avg_{r}") for r in RISKS], F.count(F.lit(1)).alias("days"),
        (F.avg("confidence") * F.when(warned, 0.7).otherwise(1.0)).alias("confidence"))


def report(scores: DataFrame, warnings: dict[str, Column], days: int = 7) -> DataFrame:
    """One line of text per user: levels of the mean risks, advice, warnings and the first days."""
    def level(v: Column) -> Column:
        return E.ladder((v >= 0.7, "HIGH"), (v >= 0.4, "MODERATE"), otherwise="LOW")

    d, h, m = (F.avg(r) for r in RISKS)
    notes = F.concat_ws("; ", E.messages(*[(flag, text) for text, flag in warnings.items()]))
    head = scores.groupBy("user_id").agg(
        F.concat_ws(" | ", E.messages(
            (F.lit(True), F.format_string(wording.ANALYSIS_PERIOD_DAYS, F.count(F.lit(1)))),
            (F.lit(True), F.concat(F.lit(wording.DEPRESSION_RISK), level(d))),
            (F.lit(True), F.concat(F.lit(wording.HYPOMANIC_RISK), level(h))),
            (F.lit(True), F.concat(F.lit(wording.MANIC_RISK), level(m))),
            (F.lit(True), E.ladder((d > 0.7, wording.HIGH_DEPRESSION_RISK), (d > 0.4, wording.MODERATE_DEPRESSION_RISK),
                                   otherwise=wording.LOW_DEPRESSION_RISK)),
            ((h > 0.5) | (m > 0.3), wording.ELEVATED_MOOD_EPISODE),
            (F.length(notes) > 0, F.concat(F.lit("Warnings: "), notes)))).alias("head"))
    nth = F.row_number().over(W.partitionBy("user_id").orderBy("date"))
    first = scores.withColumn("_nth", nth).filter(F.col("_nth") <= days)
    line = F.struct("date", F.concat_ws(" ", F.col("date").cast("string"), level(F.col("depression"))).alias("t"))
    body = first.groupBy("user_id").agg(F.array_sort(F.collect_list(line)).alias("rows"))
    return head.join(body, "user_id").select("user_id", F.concat_ws(
        " | ", "head", F.concat_ws(", ", F.transform("rows", lambda x: x.t))).alias("report"))
