"""Report aggregates. Each reads only the columns it needs and ends in one small aggregate."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom import constants as K
from veriloom.operators import reviews as R

ACCEPTING = ["approve", "correct"]

corrections = R.corrections_report
latest_flag = R.latest_flag
history = R.history


def status_breakdown(documents: DataFrame) -> DataFrame:
    return documents.groupBy("status").agg(F.count(F.lit(1)).alias("count"))


def confidence_bands(documents: DataFrame, high: float = K.HIGH_BAND, medium: float = K.MEDIUM_BAND) -> DataFrame:
    """Documents per band, all three bands always present, documents without confidence left out."""
    c = F.col("overall_confidence")
    totals = documents.agg(
        F.count_if(c >= high).alias("high"),
        F.count_if((c < high) & (c >= medium)).alias("medium"),
        F.count_if(c < medium).alias("low"),
    )
    return totals.select(F.stack(
        F.lit(3), F.lit("high"), F.col("high"), F.lit("medium"), F.col("medium"), F.lit("low"), F.col("low")
    ).alias("band", "count"))


def throughput(reviews: DataFrame, documents: DataFrame) -> DataFrame:
    """Review speed and seeded-error catch rate, with cold-start constants where a number is zero or missing."""
    synthetic = F.col("is_synthetic")
    caught = synthetic & F.col("status").isin("flagged", "reviewed")
    rate = documents.agg((F.count_if(caught) / F.nullif(F.count_if(synthetic), F.lit(0))).alias("r")).scalar()
    seconds = reviews.filter(F.col("action").isin(ACCEPTING)).agg(
        F.bround(F.avg("duration_seconds"), 0).cast("bigint").alias("avg")
    )
    per_hour = F.bround(F.try_divide(F.lit(3600.0), F.col("avg")), 0).cast("bigint")
    usable = lambda value, cold: F.coalesce(F.nullif(value, F.lit(0).cast("bigint")), F.lit(cold).cast("bigint"))
    return seconds.select(
        F.when(F.col("avg") > 0, usable(per_hour, K.COLD_PER_HOUR)).otherwise(F.lit(K.COLD_PER_HOUR).cast("bigint"))
        .alias("documents_per_hour"),
        F.lit(K.MANUAL_PER_HOUR).alias("manual_baseline_per_hour"),
        F.coalesce(rate, F.lit(K.COLD_CATCH_RATE)).alias("seeded_error_catch_rate"),
        usable(F.col("avg"), K.COLD_REVIEW_SECONDS).alias("avg_review_seconds"),
    )


def approved_on(reviews: DataFrame, as_of: dt.date | str | Column) -> Column:
    """Number of accepting reviews on one day, as a scalar subquery."""
    day = as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")
    accepting = reviews.filter(F.col("action").isin(ACCEPTING))
    return accepting.agg(F.count_if(F.to_date("reviewed_at") == day)).scalar()


def dashboard(documents: DataFrame, reviews: DataFrame, as_of: dt.date | str | Column) -> DataFrame:
    return documents.agg(
        F.count_if(F.col("status").isin(K.QUEUE_STATUSES)).alias("pending_review"),
        F.count_if(F.col("status") == "flagged").alias("flagged"),
        F.avg("overall_confidence").alias("avg_confidence"),
    ).select("pending_review", approved_on(reviews, as_of).alias("approved_today"), "flagged", "avg_confidence")


def fail_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("document_id").agg(F.count_if(F.col("result") == "fail").alias("fail_count"))


def rule_outcome_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("rule_name", "result").agg(F.count(F.lit(1)).alias("n"))
