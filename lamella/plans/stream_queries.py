"""Queries that run streams to their end."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamella.streaming import ledger

from .registry import query


def _events(v):
    # A pattern, as a stream reads folders or patterns, and the table may be a single file.
    return v.spark.readStream.schema(v.events.schema).parquet(f"{v.folder}/event[s].parquet")


@query("stream_circuit", "STATE-14", """
WITH c AS (SELECT worker, id, failed, failed AND tokens_in % 50 = 0 AS auth, row_number() OVER w AS n, failed AND coalesce(lag(failed) OVER w, false) AND coalesce(lag(failed, 2) OVER w, false) AS third FROM calls WINDOW w AS (PARTITION BY worker ORDER BY ts, id)), o AS (SELECT worker, min(n) FILTER (WHERE auth OR third) AS opened FROM c GROUP BY worker)
SELECT worker, id, CASE WHEN opened IS NOT NULL AND n > opened THEN 'rejected' WHEN failed THEN 'failed' ELSE 'ok' END AS state FROM c JOIN o USING (worker)""")
def stream_circuit(v):
    """The circuit breaker over all calls, as a stream with state."""
    failed = F.col("event_type") == "error"
    calls = _events(v).select(F.col("user_id").alias("worker"), F.col("event_id").alias("id"), "ts", failed.alias("failed"), (failed & (F.col("event_id") * 31 % 8000 % 50 == 0)).alias("auth"))
    return ledger.stored_stream(ledger.circuit_stream(calls), v.spark)
