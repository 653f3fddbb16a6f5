"""Ledgers of calls as streams: what has been decided is never decided anew.

An extension; the batch forms are in plans.ledger_queries.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAILURES = 3


def circuit_stream(calls: DataFrame, most: int = FAILURES) -> DataFrame:
    """(worker, id, state) for a stream of calls (worker, id, ts, failed, auth).

    A worker's calls of a micro-batch are taken in the order of (ts, id); the
    run of failures and whether the circuit is open pass on as state.
    """

    def step(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run, is_open = state.get if state.exists else (0, False)
        rows = pd.concat(list(frames)).sort_values(["ts", "id"])
        states = []
        for failed, auth in zip(rows["failed"], rows["auth"]):
            states.append("rejected" if is_open else "failed" if failed else "ok")
            if not is_open:
                run = run + 1 if failed else 0
                is_open = bool(auth) or run >= most
        state.update((int(run), bool(is_open)))
        yield pd.DataFrame({"worker": key[0], "id": rows["id"], "state": states})

    return calls.groupBy("worker").applyInPandasWithState(step, "worker long, id long, state string", "run int, is_open boolean", "append", "NoTimeout")


def hourly(events: DataFrame, late: str = "2 hours") -> DataFrame:
    """Events by hour and type; an hour is given out once the watermark has passed it."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def stored_stream(stream: DataFrame, spark: SparkSession) -> DataFrame:
    """Runs a stream over all that is there, into files; exactly once, by the sink's log."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lamella-")
    at = f"{folder.rstrip('/')}/stream-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/out")
