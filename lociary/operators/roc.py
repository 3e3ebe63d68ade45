"""ROC analysis where the event is failure (truth is False) and a high score predicts the event."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lociary.operators.keyed import attach
from lociary.operators.ordered import running_totals


def score_counts(df: DataFrame, group: list[str], truth: str, score: str, weight: str | None = None) -> DataFrame:
    """Events and non-events per distinct score."""
    one = F.col(weight) if weight else F.lit(1)
    return (
        df.filter(F.col(truth).isNotNull() & F.col(score).isNotNull())
        .groupBy(*group, F.col(score).alias("score"))
        .agg(
            F.sum(F.when(~F.col(truth), one).otherwise(0)).alias("events"),
            F.sum(F.when(F.col(truth), one).otherwise(0)).alias("others"),
        )
    )


def roc_auc(counts: DataFrame, group: list[str]) -> DataFrame:
    """Area under the curve per group, ties counting half; NULL when one class is empty."""
    ranked = running_totals(counts, group, [F.col("score")], {"upto": "others"})
    wins = F.col("events") * (F.col("upto") - F.col("others") / 2)
    return ranked.groupBy(*group).agg(
        F.try_divide(F.sum(wins), F.sum("events") * F.sum("others")).alias("roc_auc")
    )


def roc_curve(counts: DataFrame, group: list[str]) -> DataFrame:
    """Specificity (score below threshold) and sensitivity (score at or above it) at every distinct score
    and at both infinite ends."""
    ranked = running_totals(
        counts, group, [F.col("score")], {"others_upto": "others", "events_upto": "events"}
    )
    totals = counts.groupBy(*group).agg(F.sum("events").alias("all_events"), F.sum("others").alias("all_others"))
    share = lambda part, whole: F.try_divide(part.cast("double"), whole)
    inner = attach(ranked, totals, group, "inner", nulls_match=True).select(
        *group,
        F.col("score").cast("double").alias("threshold"),
        share(F.col("others_upto") - F.col("others"), F.col("all_others")).alias("specificity"),
        share(F.col("all_events") - F.col("events_upto") + F.col("events"), F.col("all_events")).alias("sensitivity"),
    )
    ends = totals.select(
        *group,
        F.explode(
            F.array(
                F.struct(F.lit(float("-inf")).alias("threshold"), F.lit(0.0).alias("specificity"), F.lit(1.0).alias("sensitivity")),
                F.struct(F.lit(float("inf")).alias("threshold"), F.lit(1.0).alias("specificity"), F.lit(0.0).alias("sensitivity")),
            )
        ).alias("end"),
    ).select(*group, "end.*")
    return inner.unionByName(ends)


def confusion_at(counts: DataFrame, group: list[str], threshold: float) -> DataFrame:
    """Sensitivity, specificity and precision of calling an event at score >= threshold."""
    called = F.col("score") >= threshold
    total = lambda c, cond: F.sum(F.when(cond, F.col(c)).otherwise(0)).cast("double")
    hit, false_call = total("events", called), total("others", called)
    return counts.groupBy(*group).agg(
        F.try_divide(hit, F.sum("events")).alias("sensitivity"),
        F.try_divide(total("others", ~called), F.sum("others")).alias("specificity"),
        F.try_divide(hit, hit + false_call).alias("precision"),
    )
