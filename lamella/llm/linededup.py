"""Substring dedup by line or paragraph hashing.

Units (lines, or paragraphs) are normalised and hashed; digests are grouped
over all documents, the occurrence of the smallest rank (document id, then
place in the document) is kept, and the others are removed from their texts.
What is removed is told by offsets in the original text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, stored

SEPARATORS = {"line": re.compile(r"\n"), "paragraph": re.compile(r"\n[ \t\r]*\n\s*")}
MIN_WORDS = 1


def units(text: str | None, unit: str = "line") -> list[tuple[int, int]]:
    """[start, end) of each unit, without its separator."""
    if not text:
        return []
    out, at = [], 0
    for m in SEPARATORS[unit].finditer(text):
        out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))]


def digest(piece: str, min_words: int = MIN_WORDS) -> bytes | None:
    """Hash of the unit in lower case with single blanks; None if it has too few words to count."""
    words = piece.lower().split()
    if len(words) < min_words:
        return None
    return xxhash.xxh3_128_digest(" ".join(words).encode("utf-8", "surrogatepass"))


def without(text: str, all_units: list[tuple[int, int]], gone: set[int]) -> str:
    """The text without the units in gone, each with the separator behind it (the last: before it)."""
    kept = [i for i in range(len(all_units)) if i not in gone]
    out = []
    for n, i in enumerate(kept):
        a, b = all_units[i]
        out.append(text[a:b])
        if n + 1 < len(kept):
            out.append(text[b : all_units[i + 1][0]])
    return "".join(out)


def line_dedup(docs: DataFrame, unit: str = "line", min_words: int = MIN_WORDS) -> DataFrame:
    """-> (doc_id, text, n_units int, n_removed int, removed array<struct<start, end>>), a row for each row of docs.

    Every unit with a word counts; units of fewer than min_words words, if more
    is asked, never count as copies. Offsets are in characters of the original
    text. Null texts stay null, with no unit. Rows with a null doc_id are left
    as they are and make no other row's unit a copy. Rows of one id are one
    document: a unit that they share is kept in each of them. No rows give no
    rows; other columns are not read. Texts go to Python in slices of
    BATCH_BYTES, a longer text as one slice.
    """
    small_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("lm_row"))

    def scan(batches):
        for batch in batches:
            for part in slices(batch, 1):
                counts, no, marks = [], [], []
                for t in part.column(1):
                    text, before = t.as_py(), len(no)
                    for k, (a, b) in enumerate(units(text, unit)):
                        if d := digest(text[a:b], min_words):
                            no.append(k)
                            marks.append(d)
                    counts.append(len(no) - before)
                own = pa.array(np.repeat(np.arange(part.num_rows), counts))
                two = np.frombuffer(b"".join(marks), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(2).take(own), pa.array(no, pa.int32()), pa.array(two[:, 0].copy()), pa.array(two[:, 1].copy())], names=["doc_id", "lm_row", "no", "d1", "d2"])

    found = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(scan, f"doc_id {id_type}, lm_row long, no int, d1 long, d2 long")
    first = found.groupBy("d1", "d2").agg(F.min(F.struct("doc_id", "no")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = stored(first)  # so that both sides of the join are exchanges, and a very common unit is split
    copies = found.join(first, ["d1", "d2"]).where("NOT (first.doc_id = doc_id AND first.no = no)")
    gone = copies.groupBy("doc_id", "lm_row").agg(F.collect_set("no").alias("lm_gone")).withColumnRenamed("doc_id", "lm_id").withColumnRenamed("lm_row", "lm_own")
    marked = rows.join(gone, (F.col("doc_id") == F.col("lm_id")) & (F.col("lm_row") == F.col("lm_own")), "left")
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def rebuild(batches):
        for batch in batches:
            for part in slices(batch, 1):
                text, size, n_gone, spans = [], [], [], []
                for t, g in zip(part.column(1), part.column(2)):
                    t = t.as_py()
                    cut, drop = units(t, unit), set(g.as_py() or ())
                    text.append(without(t, cut, drop) if drop else t)
                    size.append(len(cut))
                    n_gone.append(len(drop))
                    spans.append([{"start": cut[i][0], "end": cut[i][1]} for i in sorted(drop)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.string()), pa.array(size, pa.int32()), pa.array(n_gone, pa.int32()), pa.array(spans, span_type)], names=["doc_id", "text", "n_units", "n_removed", "removed"])

    return marked.select("doc_id", "text", "lm_gone").mapInArrow(rebuild, f"doc_id {id_type}, text string, n_units int, n_removed int, removed array<struct<start:int,end:int>>")
