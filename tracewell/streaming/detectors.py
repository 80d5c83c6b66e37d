"""Streaming forms of counts and detectors, an extension: windows end with their watermark and later rows are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.conf import Anomaly

CONF = Anomaly()


def event_counts(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """start, end, kind, n, total of events ts, kind, value in tumbling or sliding windows."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w, "kind").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "kind", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """start, end, actor, n of events ts, actor without a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "actor").agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "actor", "n")


def structuring(tx: DataFrame, conf: Anomaly = CONF, threshold: int = 50_000, late: str = "1 day") -> DataFrame:
    """Accounts with enough cash amounts just below a threshold in a sliding window."""
    band = tx.where((F.col("amount") >= threshold * (1 - conf.band)) & (F.col("amount") < threshold) & F.col("channel").isin("CASH_DEPOSIT", "CASH_WITHDRAWAL"))
    w = F.window("ts", f"{conf.structuring_days} days", "1 day")
    return band.withWatermark("ts", late).groupBy(w, F.col("dst").alias("account")).agg(F.count("*").alias("n"), F.sum("amount").alias("total")).where(F.col("n") >= conf.structuring_count).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "account", "n", "total")


def fanout(tx: DataFrame, conf: Anomaly = CONF, late: str = "1 hour") -> DataFrame:
    """Accounts that pay many others in a sliding window of hours; targets are counted approximately, as streams must."""
    small = tx.where((F.col("amount") <= conf.fanout_amount) & F.col("channel").isin(*conf.fanout_channels))
    w = F.window("ts", f"{conf.fanout_hours} hours", "1 hour")
    return small.withWatermark("ts", late).groupBy(w, F.col("src").alias("hub")).agg(F.approx_count_distinct("dst").alias("targets"), F.sum("amount").alias("total")).where(F.col("targets") >= conf.fanout_targets).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "hub", "targets", "total")
