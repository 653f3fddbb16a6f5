"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of an Arrow batch between JVM and Python, and of texts that are worked on at a time.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is spark.checkpoint.dir; where that is unset (local tests, one machine)
    a temporary folder is made and set as the session's checkpoint folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="lamella-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's bound of an Arrow batch to BATCH_BYTES: rows of long texts are otherwise held by
    the JVM, by Arrow and by Python, 64 MB each. A lower bound of the session stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark._jsparkSession.sessionState().conf().getConfString(name)
    if not (now.rstrip("b").isdigit() and 0 < int(now.rstrip("b")) <= BATCH_BYTES):
        spark.conf.set(name, str(BATCH_BYTES))


def slices(batch: pa.RecordBatch, at: int, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about `most` bytes of its text column `at`; a longer text is a slice of its own."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(at)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = (np.cumsum(size) - size) // most
    cuts = np.flatnonzero(np.r_[True, group[1:] != group[:-1], True]).tolist()
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)


def packed(docs: DataFrame, apart: list[str]) -> DataFrame:
    """The columns `apart`, and all others in a struct lm_doc: so no name of theirs meets one of an operator's own."""
    others = [docs[f"`{c}`"].alias(c) for c in docs.columns if c not in apart]
    return docs.select(*apart, F.struct(*others or [F.lit(True).alias("none")]).alias("lm_doc"))


def column_of(name: str, apart: list[str]) -> Column:
    """A column of the frame that packed() was given."""
    return F.col(name) if name in apart else F.col("lm_doc").getField(name).alias(name)


def fresh(name: str, taken: list[str]) -> str:
    """name, with underscores behind it until no column has it."""
    while name.lower() in {t.lower() for t in taken}:
        name += "_"
    return name


def cut(df: DataFrame) -> DataFrame:
    """Computes df once and cuts its lineage, on storage that outlives executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like cut(), as compressed Parquet: for wide rows that are read more than once."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lamella-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold_remainder(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)
