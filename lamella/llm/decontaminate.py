"""Benchmark decontamination by a generalised suffix automaton.

The automaton holds the word sequences of all benchmark items. Training words
are streamed through it, with the length of the longest match that ends at
each word. Only runs of words that occur in the benchmark at all are streamed;
any other word takes the automaton back to its root.

The automaton goes to the workers as a broadcast of bounded size: items are
taken in blocks of at most BLOCK_WORDS words, with one pass over the documents
for each block, and the blocks' results are merged by document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import column_of, packed, small_batches, stored

#: Bytes to their lower case, and those in no word to a blank. Bytes over 0x7F, parts of other characters, are in words.
FOLD = bytes(i if 48 <= i < 58 or 97 <= i < 123 or i > 127 else i + 32 if 65 <= i < 91 else 32 for i in range(256))
BLOCK_WORDS = 2_000_000
WINDOW = 10


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text's UTF-8 bytes after lower-casing A-Z; a null text has none."""
    return text.translate(FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton over word numbers.

    step[s] maps a word to the next state, link[s] is the suffix link and
    depth[s] the longest length of state s. items[s] lists the items for which
    a whole window (of `window` words, or the whole of a shorter item) ends in
    s, with the window's length.
    """

    def __init__(self, items: list[tuple], window: int = WINDOW):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.depth = [-1], [0]
        sequences = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for i, words in items if words]
        for _, words in sequences:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.items: dict[int, dict[int, set]] = {}
        self.shortest = min([window, *(len(words) for _, words in sequences)])
        for i, words in sequences:
            n = min(window, len(words))
            state, length = 0, 0
            for w in words:
                state, length = self.follow(state, length, w)
                if length >= n:
                    self.items.setdefault(self._holding(state, n), {}).setdefault(n, set()).add(i)
        self.ending = self._endings()

    def _extend(self, last: int, w: int) -> int:
        step, link, depth = self.step, self.link, self.depth
        if w in step[last]:
            to = step[last][w]
            return to if depth[to] == depth[last] + 1 else self._split(last, w, to)
        new = len(step)
        step.append({})
        link.append(0)
        depth.append(depth[last] + 1)
        while last != -1 and w not in step[last]:
            step[last][w] = new
            last = link[last]
        if last != -1:
            to = step[last][w]
            link[new] = to if depth[to] == depth[last] + 1 else self._split(last, w, to)
        return new

    def _split(self, at: int, w: int, to: int) -> int:
        step, link, depth = self.step, self.link, self.depth
        copy = len(step)
        step.append(dict(step[to]))
        link.append(link[to])
        depth.append(depth[at] + 1)
        link[to] = copy
        while at != -1 and step[at].get(w) == to:
            step[at][w] = copy
            at = link[at]
        return copy

    def follow(self, state: int, length: int, w: int) -> tuple[int, int]:
        step, link, depth = self.step, self.link, self.depth
        while w not in step[state]:
            state = link[state]
            if state == -1:
                return 0, 0
            length = depth[state]
        return step[state][w], length + 1

    def _holding(self, state: int, n: int) -> int:
        """The state on the suffix path of `state` whose strings include length n."""
        while self.depth[self.link[state]] >= n:
            state = self.link[state]
        return state

    def _endings(self) -> list[tuple | None]:
        """For each state: (length, items) of the windows that are suffixes of its strings."""
        out: list[tuple | None] = [None] * len(self.step)
        for s in sorted(range(1, len(self.step)), key=self.depth.__getitem__):
            below = out[self.link[s]] or ()
            own = tuple((n, frozenset(x)) for n, x in sorted(self.items.get(s, {}).items()))
            out[s] = below + own or None
        return out

    def scan(self, numbers: np.ndarray) -> tuple[np.ndarray, set]:
        """Hit words and items of a document, given its word numbers (-1: in no item)."""
        hit = np.zeros(len(numbers), bool)
        found: set = set()
        known = np.flatnonzero(np.diff(np.r_[False, numbers >= 0, False]))
        step, link, depth, ending = self.step, self.link, self.depth, self.ending
        for a, b in zip(known[::2].tolist(), known[1::2].tolist()):
            if b - a < self.shortest:
                continue
            state, length = 0, 0
            for i, w in enumerate(numbers[a:b].tolist(), a):
                nxt = step[state].get(w)
                while nxt is None:
                    state = link[state]
                    if state == -1:
                        state, length, nxt = 0, -1, 0
                        break
                    length = depth[state]
                    nxt = step[state].get(w)
                state = nxt
                length += 1
                if length >= self.shortest and ending[state]:
                    longest = 0
                    for n, ids in ending[state]:
                        if n <= length:
                            longest = max(longest, n)
                            found |= ids
                    if longest:
                        hit[i + 1 - longest : i + 1] = True
        return hit, found


def _blocks(benchmark: DataFrame, block_words: int):
    block, size = [], 0
    for item, text in benchmark.select("item_id", F.col("text").cast("binary")).toLocalIterator():
        words = words_of(text)
        if block and size + len(words) > block_words:
            yield block
            block, size = [], 0
        block.append((item, words))
        size += len(words)
    yield block


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, keep: list[str] | None = None) -> DataFrame:
    """-> (doc_id, n_words, hits array<struct<start, end>>, items array<string>), a row for each row of docs.

    hits: runs of hit words [start, end) in order; items: the ids whose windows
    occur, sorted as strings. Words and windows: see words_of and Automaton. A
    null, empty or wordless text has no words and no hits; an item without
    words (or null) matches nothing; repeated items and rows count each. An
    empty benchmark leaves all documents clean, no documents give no rows. Of
    the documents doc_id and text are read, and the columns in `keep`, which
    are passed on as they are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kept = [x for x in keep or [] if x != "doc_id"]
    head = docs.select("doc_id", *kept)
    schema = T.StructType([*head.schema, *T._parse_datatype_string("lm_bytes binary, n_words long, hits array<struct<start:int,end:int>>, items array<string>")])
    hit_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    names = [*head.columns, "lm_bytes", "n_words", "hits", "items"]
    at = len(head.columns)

    def one_pass(rows: DataFrame, block: list, first: bool, last: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(Automaton(block, window))

        def scan(batches):
            automaton = shared.value
            number = automaton.vocabulary.get
            for batch in batches:
                n_words, hits, items = [], [], []
                before = None if first else (batch.column(at + 2), batch.column(at + 3))
                for k, x in enumerate(batch.column(at)):
                    words = words_of(x.as_py())
                    numbers = np.fromiter((number(w, -1) for w in words), np.int64, len(words))
                    hit, found = automaton.scan(numbers)
                    found = set(map(str, found))
                    if before:
                        for run in before[0][k].as_py():
                            hit[run["start"] : run["end"]] = True
                        found.update(before[1][k].as_py())
                    runs = np.flatnonzero(np.diff(np.r_[False, hit, False])).tolist()
                    n_words.append(len(words))
                    hits.append([{"start": a, "end": b} for a, b in zip(runs[::2], runs[1::2])])
                    items.append(sorted(found))
                text = pa.nulls(batch.num_rows, pa.binary()) if last else batch.column(at)
                columns = [*batch.columns[:at], text, pa.array(n_words, pa.int64()), pa.array(hits, hit_type), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

        return rows.mapInArrow(scan, schema)

    rows = docs.select("doc_id", *kept, F.col("text").cast("binary").alias("lm_bytes"))
    blocks = _blocks(benchmark, block_words)
    block, first = next(blocks), True
    while block is not None:
        following = next(blocks, None)
        rows = one_pass(rows, block, first, following is None)
        if following is not None:
            rows = stored(rows)  # one automaton in memory at a time
        block, first = following, False
    return rows.drop("lm_bytes")


def removed_spans(text: str, hits: list) -> str:
    """The text without the characters from the first to the last word of each run."""
    raw = text.encode()
    starts, ends = word_offsets(raw)
    out, at = [], 0
    for hit in hits:
        out.append(raw[at : starts[hit["start"]]])
        at = ends[hit["end"] - 1]
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "replace")


def word_offsets(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    inside = np.frombuffer(raw.translate(FOLD), np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.r_[False, inside, False]))
    return edges[::2], edges[1::2]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_coverage: float = 0.5) -> DataFrame:
    """docs, in their own columns, without benchmark passages.

    Hit runs are cut from the texts; a document of whose words more than
    max_coverage are hit is dropped. Others stay as they are, byte for byte.
    An n_chars column of a cut text is counted anew. Null texts stay.
    """
    names = docs.columns
    apart = ["doc_id", "text"]
    marked = benchmark_hits(packed(docs, apart), benchmark, window, keep=["text", "lm_doc"])
    n_hit = F.aggregate("hits", F.lit(0), lambda n, h: n + h["end"] - h["start"])
    left = marked.where(n_hit <= max_coverage * F.col("n_words"))

    @F.pandas_udf("string")
    def cut_text(text: pd.Series, hits: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not len(h) else removed_spans(t, h) for t, h in zip(text, hits)], dtype=object)

    hit = F.size("hits") > 0
    columns = {c: column_of(c, apart) for c in names}
    if "n_chars" in names:
        columns["n_chars"] = F.when(hit, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(columns["n_chars"])
    return left.withColumn("text", cut_text("text", "hits")).select(*[c.alias(n) for n, c in columns.items()])


def item_digest(items: Column) -> Column:
    """SHA-256 of the item ids, comma-joined."""
    return F.sha2(F.array_join(items, ","), 256)
