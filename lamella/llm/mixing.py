"""Mixing sources to target weights by proportionate-fair (Pfair) scheduling.

Each source's documents, in a seeded order, are cut into blocks of equal size.
Block i of a source of weight w has release time floor(i / w) and deadline
ceil((i + 1) / w), in slots of one block. Earliest deadline first, among the
released, gives each slot one block and keeps every source within less than
one block of weight * slots at every slot.

Weights are exact fractions, as no rounding of them would stay within a block
over a long run. Each slot follows from those before, so the schedule is laid
out on the driver, a row for each block that there is (a 64th of the
documents); it is not held there, but written in chunks to the folder that all
share, and every document finds its slot by a join with that table.
Positions within a source come from per-bucket sums, so no source, however
large, meets in one task.
"""

from __future__ import annotations

import heapq
import uuid
from array import array
from collections.abc import Iterator
from fractions import Fraction
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import shared_folder

PARTS = 4096
MAX_SOURCES = 1 << 16
BLOCK = 64
#: Blocks of the schedule that are broadcast at most; beyond, rows and schedule meet by an exchange.
BROADCAST = 1 << 18
#: Blocks of the schedule that the driver holds.
CHUNK = 1 << 20
SEED = 20
#: Rows of a source are ordered by buckets of about so many rows; buckets of a source at most.
BUCKET_ROWS = 2_000
BUCKETS = 1 << 16


def whole_parts(weights: dict, parts: int = PARTS) -> dict:
    """Weights as positive whole numbers that sum to `parts` (more, if there are more sources)."""
    weights = {k: Fraction(w) for k, w in weights.items() if w > 0}
    if not weights:
        return {}
    while parts < 4 * len(weights):
        parts *= 2
    total = sum(weights.values())
    share = {k: max(Fraction(1), w * parts / total) for k, w in weights.items()}
    got = {k: int(s) for k, s in share.items()}
    order = sorted(share, key=lambda k: (got[k] - share[k], str(k)))
    short = parts - sum(got.values())
    for k in order[: max(0, short)]:
        got[k] += 1
    while sum(got.values()) > parts:
        got[max(got, key=lambda k: (got[k], str(k)))] -= 1
    return got


def pfair_slots(weights: dict, blocks: dict) -> Iterator[tuple]:
    """(source, block, release, deadline, slot) of all blocks, earliest deadline first. weights: of any sum, exact.

    A source has one block waiting at a time: the next is released in the last slot of this one at the earliest.
    """
    weights = {k: Fraction(w) for k, w in weights.items()}
    common = lcm(*(w.denominator for w in weights.values()))
    whole = {k: int(w * common) for k, w in weights.items()}
    total = sum(whole.values())
    names = sorted((k for k in whole if blocks[k]), key=lambda k: (k is not None, str(k)))
    waiting = [(0, n, 0) for n in range(len(names))]
    ready: list = []
    slot = 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, n, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(i + 1) * total // whole[names[n]]), n, i))
        deadline, n, i = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline was missed")
        name = names[n]
        yield name, i, i * total // whole[name], deadline, slot
        if i + 1 < blocks[name]:
            heapq.heappush(waiting, ((i + 1) * total // whole[name], n, i + 1))
        slot += 1


def pfair_period(parts: dict) -> list[tuple]:
    """[(source, block, release, deadline, slot)] of one period of whole parts, earliest deadline first."""
    return list(pfair_slots(parts, parts))


def tempered(sizes: dict, exponent: float = 0.5) -> dict:
    """Target weights that favour small sources: size ** exponent."""
    return {k: n**exponent for k, n in sizes.items() if n}


def source_sizes(docs: DataFrame, max_sources: int = MAX_SOURCES) -> dict:
    rows = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        raise ValueError(f"more than {max_sources} sources; give a coarser source column")
    return {r["source"]: r["n"] for r in rows}


def _schedule(spark: SparkSession, plan: list[array]) -> DataFrame:
    table = pa.table([pa.array(np.frombuffer(c, np.int64)) for c in plan], names=["mix_sid", "mix_block", "mix_r", "mix_d", "mix_t"])
    return spark.createDataFrame(table).withColumn("mix_sid", F.col("mix_sid").cast("int"))


def mix(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, parts: int | None = None, seed: int = SEED, max_sources: int = MAX_SOURCES) -> DataFrame:
    """docs with mix_block, mix_release, mix_deadline, mix_slot and mix_rank (all long).

    The mixed order is by (mix_slot, mix_rank). Every row is kept once. Up to
    the slot at which the first source is used up (mix_on_target is true),
    every prefix of slots holds each source's weight to less than one block;
    later slots of used-up sources stay empty and the others go on in
    proportion to their weights. weights: by source; None: tempered counts; a
    source without a positive weight follows after all others, off target (its
    mix_block is -1 and its slot null). A null source is a source as any other.
    Repeated rows keep a row each, in any order; null ids are ordered first;
    no rows give no rows. Columns named mix_* of docs are replaced. parts, if
    given, rounds the weights to whole parts of so many.
    """
    spark = docs.sparkSession
    docs = docs.drop(*[c for c in docs.columns if c.startswith("mix_")])
    sizes = source_sizes(docs, max_sources)
    shares = {k: Fraction(w) for k, w in (tempered(sizes) if weights is None else weights).items() if w > 0 and sizes.get(k)}
    if parts is not None:
        shares = whole_parts(shares, parts)
    blocks = {k: -(-sizes[k] // block) for k in shares}

    # Sources by number, so that all keys below are plain equalities and one exchange of the rows serves them all.
    numbers = {k: n for n, k in enumerate(sizes)}
    kind = docs.schema["source"].dataType.simpleString()
    named = spark.createDataFrame([(k, n, k in shares) for k, n in numbers.items()], f"mix_s {kind}, mix_sid int, mix_sched boolean")
    last = {k: sizes[k] // block - 1 for k in shares}
    # Slot at which the first source has given its last whole block.
    target_end = -1 if -1 in last.values() else None
    path, plan = None, [array("q") for _ in range(5)]
    for name, *row in pfair_slots(shares, blocks):
        for column, x in zip(plan, (numbers[name], *row)):
            column.append(x)
        if target_end is None and row[0] == last[name]:
            target_end = row[-1]
        if len(plan[0]) == CHUNK:
            path = path or f"{shared_folder(spark)}/mix-{uuid.uuid4().hex}"
            _schedule(spark, plan).write.mode("append").parquet(path)
            plan = [array("q") for _ in range(5)]
    slots = _schedule(spark, plan)
    if path:
        slots.write.mode("append").parquet(path)
        slots = spark.read.schema(slots.schema).parquet(path)
    elif len(plan[0]) <= BROADCAST:
        slots = F.broadcast(slots)
    buckets = min(BUCKETS, max(1, sum(sizes.values()) // BUCKET_ROWS))
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    rows = docs.withColumn("mix_key", key).withColumn("mix_bucket", F.pmod("mix_key", F.lit(buckets)))
    rows = rows.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("mix_s")))  # a row for each source, max_sources at most
    counts = rows.groupBy("mix_sid", "mix_bucket").agg(F.count(F.lit(1)).alias("mix_n"))
    before = Window.partitionBy("mix_sid").orderBy("mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("mix_sid", "mix_bucket", F.coalesce(F.sum("mix_n").over(before), F.lit(0)).alias("mix_before"))
    within = Window.partitionBy("mix_sid", "mix_bucket").orderBy("mix_key", "doc_id")
    rows = rows.withColumn("mix_i", F.row_number().over(within) - 1).join(starts, ["mix_sid", "mix_bucket"])
    at = F.col("mix_before") + F.col("mix_i")
    rows = rows.withColumn("mix_block", F.when(F.col("mix_sched"), F.floor(at / block)).otherwise(-1).cast("long"))
    rows = rows.withColumn("mix_rank", (at % block).cast("long")).join(slots, ["mix_sid", "mix_block"], "left")
    return rows.select(
        *docs.columns,
        "mix_block",
        F.col("mix_r").alias("mix_release"),
        F.col("mix_d").alias("mix_deadline"),
        F.col("mix_t").alias("mix_slot"),
        "mix_rank",
        F.coalesce(F.col("mix_t") <= (-1 if target_end is None else target_end), F.lit(False)).alias("mix_on_target"),
    )
