"""Batch forms of the stateful operators (X), and scans with rejects (S)."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkloom.plans.registry import query, table
from sparkloom.sources import files
from sparkloom.streaming import stateful


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e) SELECT user_id, count(DISTINCT k) AS sessions, count(*) AS n FROM s GROUP BY user_id")
def x5_idle_sessions(spark, sf):
    """Also x6: sessions end after ten idle minutes."""
    s = stateful.idle_sessions(table(spark, sf, "events"), "user_id", "ts")
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("n"))


@query("WITH e AS (SELECT user_id, value > 20 AS failed, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, value > 20 ORDER BY event_id) AS k FROM events) SELECT DISTINCT user_id FROM (SELECT user_id, k FROM e WHERE failed GROUP BY user_id, k HAVING count(*) >= 3)")
def x7_quarantine(spark, sf):
    e = table(spark, sf, "events").select("user_id", "event_id", (F.col("value") > 20).alias("failed"))
    return stateful.quarantined(e, "user_id", "event_id", "failed", 3)


@query("SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def x14_tumbling_extension(spark, sf):
    """An extension: daily counts."""
    out = stateful.tumbling(table(spark, sf, "events"), "ts", ["event_type"], "1 day", "1 hour")
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT doc_id, CASE WHEN n_chars < 100 THEN 'short' WHEN lang = 'fr' THEN 'language' END AS reason FROM documents WHERE n_chars < 100 OR lang = 'fr'")
def s11_rejects(spark, sf):
    """Also f2, f8, s9: rejected rows with the first reason that holds."""
    reason = files.reject_reason([("short", F.col("n_chars") < 100), ("language", F.col("lang") == "fr")])
    return table(spark, sf, "documents").select("doc_id", reason.alias("reason")).where("reason IS NOT NULL")
