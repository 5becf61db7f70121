"""The review state machine: allowed transitions, guards and event types, as data and expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# States and allowed transitions.
INITIAL = "RAW_PENDING"
TERMINAL = ("ACCEPTED", "REJECTED")
ALLOWED = (
    ("RAW_PENDING", "SCREENED"), ("SCREENED", "BASE_RENDERED"), ("BASE_RENDERED", "EXPOSURE_ALIGNING"), ("EXPOSURE_ALIGNING", "COLOR_CORRECTING"), ("COLOR_CORRECTING", "STYLE_APPLIED"), ("STYLE_APPLIED", "FINAL_QC"),
    ("SCREENED", "MANUAL_REVIEW"), ("BASE_RENDERED", "MANUAL_REVIEW"), ("EXPOSURE_ALIGNING", "MANUAL_REVIEW"), ("COLOR_CORRECTING", "MANUAL_REVIEW"), ("STYLE_APPLIED", "MANUAL_REVIEW"),
    ("FINAL_QC", "ACCEPTED"), ("FINAL_QC", "REJECTED"), ("FINAL_QC", "MANUAL_REVIEW"), ("FINAL_QC", "COLOR_CORRECTING"), ("FINAL_QC", "EXPOSURE_ALIGNING"),
    ("MANUAL_REVIEW", "ACCEPTED"), ("MANUAL_REVIEW", "REJECTED"), ("MANUAL_REVIEW", "COLOR_CORRECTING"),
)
MAX_ROLLBACKS = 1


def is_rollback(before: Column, after: Column) -> Column:
    return (before == "FINAL_QC") & after.isin("COLOR_CORRECTING", "EXPOSURE_ALIGNING")


def violation(before: Column, after: Column, reason: Column, rollbacks: Column) -> Column:
    """The first guard that a transition breaks: illegal, reason (missing for manual review), rollback_limit; null if it is legal."""
    legal = F.concat_ws(">", before, after).isin([f"{a}>{b}" for a, b in ALLOWED])
    return F.when(~F.coalesce(legal, F.lit(False)), "illegal").when((after == "MANUAL_REVIEW") & (F.trim(F.coalesce(reason, F.lit(""))) == ""), "reason").when(is_rollback(before, after) & (rollbacks >= MAX_ROLLBACKS), "rollback_limit")


def event_type(before: Column, after: Column) -> Column:
    """The event that a transition emits."""
    return F.when(after == "MANUAL_REVIEW", "AGENT_ESCALATED").when((before == "FINAL_QC") & (after == "ACCEPTED"), "FINAL_QC_ACCEPT").when((before == "FINAL_QC") & (after == "REJECTED"), "FINAL_QC_REJECT").when(is_rollback(before, after), "QC_ROLLBACK").otherwise("STATE_CHANGE")


def allowed(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ALLOWED, "from_state string, to_state string")
