"""Exact removal of repeated byte strings, by suffix arrays of shards.

A byte goes if a string of LENGTH bytes that covers it also starts in a
document with a smaller id. To find such strings without comparing all shards
of the corpus with one another:

1. Each string has a minimizer: the smallest hash of the K-byte strings in it.
   Equal strings have equal minimizers, so a string whose minimizer no other
   document has is not repeated. Minimizers (one in about 14 bytes) are the
   only thing that is shuffled for the whole corpus, packed by task.
2. Runs of strings with a shared minimizer go, by minimizer, to shards.
   A hot minimizer, in very many documents, is split: its strings travel by
   their own hashes instead. Copies within a task are settled there.
3. A shard's suffix array is made by Larsson-Sadakane refinement, its common
   prefixes by Kasai's scan; strings with a common prefix of LENGTH bytes or
   more form a class with a smallest document. Classes are merged over the
   shards of a partition by binary search, with a comparison of the bytes.
4. The starts of repeated strings go back packed, a row for each task and
   bucket of documents; each document gets its own.

Whole copies of a text are settled before by their digests.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, small_batches

LENGTH = 50
K = 24
CHUNK = 8 << 20
SHARD = 1 << 20
PART_BYTES = 24 << 20
LOCAL_HOT = 16
#: A minimizer of more documents is hot; the bound rises with the corpus, so that MAX_HOT are hot at most.
HOT = 20_000
MAX_HOT = 1 << 22
MAX_RUN = 63
#: Minimizers are 64 bits less these; a chance agreement only costs a comparison.
BITS = np.uint64(16)


# ---------------------------------------------------------------- minimizers


def minimizers(data: np.ndarray, length: int = LENGTH, k: int = K) -> np.ndarray:
    """For each start of a string of `length` bytes: the smallest hash of the k-byte strings in it."""
    n = len(data) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray(len(data), "<u8", padded, strides=(1,))
    m = len(data) - k + 1
    h = np.zeros(m, np.uint64)
    for at, odd in zip(range(0, k, 8), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)):
        h ^= words[at : at + m]
        h *= np.uint64(odd)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    h >>= BITS
    w, size = length - k + 1, 1
    while size * 2 <= w:
        h = np.minimum(h[: len(h) - size], h[size:])
        size *= 2
    return np.minimum(h[:n], h[w - size : w - size + n])


class Chunk:
    """Several documents' bytes end to end, with the runs of equal minimizers."""

    def __init__(self, texts: list[bytes], length: int):
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        low = minimizers(self.data, length)
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)[: len(low)]
        inside = np.arange(len(low)) + length <= self.ends[owner] if len(low) else np.empty(0, bool)
        new = np.ones(len(low), bool)
        new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1]) | (inside[1:] != inside[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(low))[: len(first)]
        keep = inside[first] if len(first) else np.empty(0, bool)
        self.first, self.last = first[keep], last[keep]
        self.low, self.owner = low[self.first], owner[self.first]


def chunks(batches, length: int, id_at: int, text_at: int, others: tuple = ()):
    """(ids, other columns, Chunk) of about CHUNK bytes each; a longer text is a chunk of its own."""
    ids, texts, more, size = [], [], [], 0
    for batch in batches:
        for i in range(batch.num_rows):
            text = batch.column(text_at)[i].as_py() or b""
            if len(text) < length:
                continue
            ids.append(batch.column(id_at)[i].as_py())
            more.append([batch.column(o)[i].as_py() for o in others])
            texts.append(text)
            size += len(text)
            if size >= CHUNK:
                yield ids, more, texts
                ids, texts, more, size = [], [], [], 0
    if texts:
        yield ids, more, texts


def _packed(values: np.ndarray, width: int) -> bytes:
    """Whole numbers below 256 ** width, byte by byte, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())


def _unpacked(blob: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(width, -1)
    out = np.zeros((raw.shape[1], 8), np.uint8)
    out[:, :width] = raw.T
    return out.view("<u8").ravel()


def _bucket(ids: np.ndarray, parts: int) -> np.ndarray:
    h = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


#: What tasks tell one another: documents (ids, each pair's place in ids), minimizers and how many documents each stands for.
PACKED = "part int, direct boolean, ids binary, docs binary, hashes binary, weights binary"


def _packed_pairs(part: np.ndarray, direct: bool, ids: np.ndarray, low: np.ndarray, weights: np.ndarray | None) -> list[tuple]:
    """A row of PACKED for each part, of (document, minimizer) pairs sorted by minimizer."""
    order = np.argsort(part, kind="stable")
    part, ids, low = part[order], ids[order], low[order]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.array([0])
    rows = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        used, local = np.unique(ids[a:b], return_inverse=True)
        w = None if weights is None else _packed(weights[order][a:b].astype(np.uint64), 4)
        rows.append((int(part[a]), direct, _packed(used.view(np.uint64), 8), _packed(local.astype(np.uint64), 4), _packed(np.diff(low[a:b], prepend=np.uint64(0)), 6), w))
    return rows


def _packed_batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), pa.bool_(), *[pa.binary()] * 4))], names=["part", "direct", "ids", "docs", "hashes", "weights"])


def _pairs_of(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    ids, local, steps = (batch.column(k)[i].as_py() for k in (2, 3, 4))
    return _unpacked(ids, 8).view(np.int64)[_unpacked(local, 4).astype(np.int64)], np.cumsum(_unpacked(steps, 6), dtype=np.uint64)


def _minimizer_rows(parts: int, length: int):
    """Per chunk: its (document, minimizer) pairs, minimizers cut to 48 bits, packed by the minimizer's part.

    A minimizer that LOCAL_HOT documents of the chunk or more have is known to
    be shared: those pairs go straight to their documents' buckets (direct),
    and its part is told of two documents and of their number. So no minimizer
    sends more than LOCAL_HOT pairs of a chunk to one task.
    """

    def scan(batches):
        for ids, _, texts in chunks(batches, length, 0, 1):
            seen: dict[bytes, int] = {}
            for i in sorted(range(len(texts)), key=lambda i: ids[i]):
                seen.setdefault(texts[i], i)
            if len(seen) < len(texts):  # whole copies say nothing new
                own = sorted(seen.values())
                ids, texts = [ids[i] for i in own], [texts[i] for i in own]
            c = Chunk(texts, length)
            low, owner = _distinct_pairs(c.low, c.owner)
            start = np.flatnonzero(np.r_[True, low[1:] != low[:-1]]) if len(low) else np.empty(0, np.int64)
            count = np.diff(np.r_[start, len(low)])
            n_docs = np.repeat(count, count)
            place = np.arange(len(low)) - np.repeat(start, count)
            hot = n_docs >= LOCAL_HOT
            doc = np.array(ids, np.int64)[owner] if len(low) else np.empty(0, np.int64)
            told = ~hot | (place < 2)
            weight = np.where(hot & (place == 0), n_docs - 1, 1)
            rows = _packed_pairs((low[told] % np.uint64(parts)).astype(np.int64), False, doc[told], low[told], weight[told])
            rows += _packed_pairs(_bucket(doc[hot], parts), True, doc[hot], low[hot], None)
            if rows:
                yield _packed_batch(rows)

    return scan


def _distinct_pairs(low: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((owner, low))
    low, owner = low[order], owner[order]
    new = np.ones(len(low), bool)
    new[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
    return low[new], owner[new]


def _shared_rows(parts: int, hot_documents: int):
    """Of a part's pairs: those whose minimizer another document has too, packed by the
    document's bucket; and the minimizers of more than hot_documents documents (part -1)."""

    def scan(batches):
        docs, hashes, weights = [], [], []
        for batch in batches:
            direct = batch.column(1).to_numpy(zero_copy_only=False)
            if direct.any():
                yield batch.filter(batch.column(1))
            for i in np.flatnonzero(~direct).tolist():
                d, h = _pairs_of(batch, i)
                docs.append(d)
                hashes.append(h)
                weights.append(_unpacked(batch.column(5)[i].as_py(), 4).astype(np.int64))
        if not docs:
            return
        d, h, w = np.concatenate(docs), np.concatenate(hashes), np.concatenate(weights)
        docs, hashes, weights = [], [], []
        order = np.lexsort((d, h))
        d, h, w = d[order], h[order], w[order]
        start = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        size = np.diff(np.r_[start, len(h)])
        shared = np.repeat(d[start] != d[start + size - 1], size)
        rows = _packed_pairs(_bucket(d[shared], parts), False, d[shared], h[shared], None)
        hot = np.add.reduceat(w, start) > hot_documents
        if hot.any():
            rows.append((-1, False, None, None, _six(h[start[hot]]), None))
        if rows:
            yield _packed_batch(rows)

    return scan


def _merged_documents(batches):
    """Of a bucket: a row for each document, with its shared minimizers (6 bytes each)."""
    pairs = [_pairs_of(b, i) for b in batches for i in range(b.num_rows)]
    if not pairs:
        return
    docs, hashes = (np.concatenate(x) for x in zip(*pairs))
    order = np.argsort(docs, kind="stable")
    docs, hashes = docs[order], hashes[order]
    cuts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1], True])
    for at in range(0, len(cuts) - 1, 5000):
        own = cuts[at : at + 5001]
        blobs = [_six(hashes[a:b]) for a, b in zip(own[:-1].tolist(), own[1:].tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(docs[own[:-1]]), pa.array(blobs, pa.binary())], names=["doc", "shared"])


def _six(hashes: np.ndarray) -> bytes:
    return hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.view("<u8").ravel()


# ---------------------------------------------------------------- suffix arrays


def suffix_array(data: np.ndarray, row: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): suffixes by their first `depth` bytes or more, each ending with its row.

    Larsson-Sadakane: suffixes are ranked by few bytes, then only groups of
    equal rank are sorted again by the rank of the suffix behind what is known,
    which doubles what is known. row numbers must not decrease.
    """
    n = len(data)
    bits = max(1, int(n).bit_length())
    alphabet = np.zeros(256, np.uint64)
    used = np.flatnonzero(np.bincount(data, minlength=256))
    alphabet[used] = np.arange(1, len(used) + 1, dtype=np.uint64)
    width = int(len(used)).bit_length()
    known = max(1, min(n, (64 - bits) // max(1, width)))
    left = np.repeat(np.flatnonzero(np.r_[row[1:] != row[:-1], True]) + 1, np.bincount(row - row[0])[np.bincount(row - row[0]) > 0]) - np.arange(n) if n else np.empty(0, np.int64)
    code = alphabet[data]
    key = np.zeros(n, np.uint64)
    for j in range(known):
        key <<= np.uint64(width)
        key[: n - j] |= np.where(left[: n - j] > j, code[j:], np.uint64(0))
    packed = np.sort((key << np.uint64(bits)) | np.arange(n, dtype=np.uint64))
    order = (packed & np.uint64((1 << bits) - 1)).astype(np.int64)
    head = packed >> np.uint64(bits)
    new = np.ones(n, bool)
    new[1:] = head[1:] != head[:-1]
    rank = np.empty(n, np.int64)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = group
    while known < depth:
        size = np.diff(np.append(np.flatnonzero(new), n))
        at = np.flatnonzero(np.repeat(size, size) > 1)  # places of the order that are not settled
        if not len(at):
            break
        who = order[at]
        behind = who + known
        after = np.where(left[who] > known, rank[np.minimum(behind, n - 1)] + 1, 0)
        dense = np.cumsum(new[at]) - 1
        if 2 * bits + int(dense[-1]).bit_length() <= 64 and len(at) < 1 << bits:
            packed = (dense.astype(np.uint64) << np.uint64(2 * bits)) | (after.astype(np.uint64) << np.uint64(bits)) | np.arange(len(at), dtype=np.uint64)
            place = (np.sort(packed) & np.uint64((1 << bits) - 1)).astype(np.int64)
        else:
            place = np.lexsort((after, dense))
        who, after = who[place], after[place]
        order[at] = who
        split = np.zeros(len(at), bool)
        split[1:] = after[1:] != after[:-1]
        new[at] |= split
        group = np.maximum.accumulate(np.where(new[at], at, 0))
        rank[who] = group
        known *= 2
    return order, rank


def common_prefixes(data: np.ndarray, row_end: np.ndarray, order: np.ndarray, limit: int) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order, up to `limit`, within rows.

    Kasai's scan, in array steps: what is common at one start is, less one, a
    floor at the next, so runs of starts extend together from their floors.
    """
    n = len(order)
    lcp = np.zeros(n, np.int64)
    a, b = order[1:], order[:-1]
    most = np.minimum(np.minimum(row_end[a] - a, row_end[b] - b), limit)
    open_, step = np.arange(n - 1), 0
    while len(open_):
        x, y = a[open_] + step, b[open_] + step
        more = step < most[open_]
        open_, x, y = open_[more], x[more], y[more]
        same = data[x] == data[y]
        open_ = open_[same]
        step += 1
        lcp[open_ + 1] = step
    return lcp


def shard_classes(data: np.ndarray, row: np.ndarray, row_end: np.ndarray, doc: np.ndarray, length: int):
    """(starts, class number of each, a start of each class, smallest document of each class)."""
    order, _ = suffix_array(data, row, length)
    whole = order[row_end[order] - order >= length]
    lcp = common_prefixes(data, row_end, whole, length)
    number = np.cumsum(lcp < length) - 1
    first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]]) if len(number) else np.empty(0, np.int64)
    least = np.minimum.reduceat(doc[row[whole]], first) if len(first) else np.empty(0, np.int64)
    return whole, number, whole[first], least


#: Repeated strings found: the bucket of their documents, and, packed, document, row, start and mask of each.
HITS = "part int, packed binary"


def _hit_rows(parts: int, doc: np.ndarray, own: np.ndarray, start: np.ndarray, mask: np.ndarray) -> list[tuple[int, bytes]]:
    """Rows of HITS, one for each bucket with a document."""
    part = _bucket(doc.view(np.uint64), parts)
    order = np.lexsort((start, own, doc, part))
    part, columns = part[order], [x[order].astype(np.int64) for x in (doc, own, start, mask)]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(part) else np.array([0])
    return [(int(part[a]), _packed(np.concatenate([c[a:b] for c in columns]).view(np.uint64), 8)) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


def _hits_of_documents(batches):
    """Of a bucket: a row for each document, with starts and masks of its repeated strings by row."""
    blobs = [_unpacked(x.as_py(), 8).view(np.int64).reshape(4, -1) for b in batches for x in b.column(1)]
    if not blobs:
        return
    doc, own, start, mask = np.concatenate(blobs, axis=1)
    order = np.lexsort((own, doc))
    doc, own, start, mask = doc[order], own[order], start[order].astype("<i4"), mask[order].astype("<i8")
    cuts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (own[1:] != own[:-1]), True])
    of = doc[cuts[:-1]]
    docs = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
    for at in range(0, len(docs) - 1, 2000):
        ends = docs[at : at + 2001]
        c = cuts[ends[0] : ends[-1] + 1].tolist()
        starts, masks = ([x[a:b].tobytes() for a, b in zip(c[:-1], c[1:])] for x in (start, mask))
        hits = pa.StructArray.from_arrays([pa.array(own[c[:-1]]), pa.array(starts, pa.binary()), pa.array(masks, pa.binary())], names=["lm_row", "starts", "masks"])
        lists = pa.ListArray.from_arrays(pa.array((ends - ends[0]).astype(np.int32)), hits)
        yield pa.RecordBatch.from_arrays([pa.array(of[ends[:-1]]), lists], names=["lm_id", "hits"])


def _settle(length: int, parts: int):
    """Of the runs of a key: those that a smaller document has too, as HITS."""

    def scan(batches):
        columns: list[tuple] = []
        distinct: dict[bytes, int] = {}
        numbers: list[np.ndarray] = []
        for batch in batches:
            known = pc.is_valid(batch.column(1))
            if pc.any(known).as_py():  # settled in its task
                done = batch.filter(known)
                yield pa.RecordBatch.from_arrays([done.column(1), done.column(2)], names=["part", "packed"])
            for blob in batch.filter(pc.is_null(batch.column(1))).column(2):
                *run, pieces = _unpacked_runs(blob.as_py())
                numbers.append(np.fromiter((distinct.setdefault(p, len(distinct)) for p in pieces), np.int64, len(pieces)))
                columns.append(tuple(run))
        if not distinct:
            return
        key, doc, own, start = (np.concatenate([c[k] for c in columns]) for k in range(4))
        number = np.concatenate(numbers)
        texts = list(distinct)
        size = np.array(list(map(len, texts)), np.int64)
        first = np.full(len(texts), np.iinfo(np.int64).max)
        np.minimum.at(first, number, doc)
        keys = np.empty(len(texts), np.int64)
        keys[number] = key
        # A text that no other text shares a minimizer with is repeated as a whole or not at all.
        _, group, members = np.unique(keys, return_inverse=True, return_counts=True)
        mixed = np.flatnonzero(members[group] > 1)
        whole = (np.int64(1) << (size - length + 1)) - 1
        mask = np.where((members[group[number]] == 1) & (first[number] < doc), whole[number], 0)
        if len(mixed):
            least, offset = _least_documents([texts[i] for i in mixed.tolist()], first[mixed], length)
            place = np.full(len(texts), -1)
            place[mixed] = np.arange(len(mixed))
            place = place[number]
            rows = np.flatnonzero(place >= 0)
            bit = np.arange(MAX_RUN)
            for a in range(0, len(rows), 50_000):
                r = rows[a : a + 50_000]
                at = offset[place[r]][:, None] + bit
                inside = bit < (size[number[r]] - length + 1)[:, None]
                gone = inside & (least[np.where(inside, at, 0)] < doc[r][:, None])
                mask[r] = (gone.astype(np.int64) << bit).sum(axis=1)
        hit = np.flatnonzero(mask)
        rows = _hit_rows(parts, doc[hit], own[hit], start[hit], mask[hit])
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), pa.binary()))], names=["part", "packed"])

    return scan


def string_marks(data: np.ndarray, starts: np.ndarray, length: int, seed: int = 0) -> np.ndarray:
    """128 bits of each string of `length` bytes at the given starts, as two words."""
    words = np.ndarray(len(data), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    at = [*range(0, length - 7, 8), length - 8] if length >= 8 else [0]
    cut = np.uint64((1 << 8 * min(8, length)) - 1)
    out = np.zeros((len(starts), 2), np.uint64)
    for n in (0, 1):
        h = np.full(len(starts), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[n] ^ seed, np.uint64)
        odd = np.uint64((0xBF58476D1CE4E5B9, 0x94D049BB133111EB)[n])
        for k in at:
            h = (h ^ (words[starts + k] & cut)) * odd
            h ^= h >> np.uint64(31 - 2 * n)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x2545F4914F6CDD1D)
        out[:, n] = h ^ (h >> np.uint64(32))
    return out


def _least_documents(pieces: list[bytes], doc: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, offset): the smallest document of the string at each start, over all pieces;
    the starts of piece i are from offset[i] on.

    Pieces are cut into shards of about SHARD bytes, each with a suffix array;
    the shards' classes are then merged by binary search.
    """
    size = np.array(list(map(len, pieces)), np.int64)
    offset = np.r_[0, np.cumsum(size)]
    everything = np.frombuffer(b"".join(pieces), np.uint8)
    cuts = np.unique(np.r_[0, np.searchsorted(np.cumsum(size), np.arange(SHARD, size.sum() + SHARD, SHARD), side="right"), len(size)])
    shards = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        ends = offset[a + 1 : b + 1] - offset[a]
        row = np.repeat(np.arange(b - a), size[a:b])
        at, number, first, least = shard_classes(everything[offset[a] : offset[b]], row, np.repeat(ends, size[a:b]), doc[a:b], length)
        shards.append((offset[a] + at, number, offset[a] + first, least))
    out = np.full(int(offset[-1]), np.iinfo(np.int64).max)
    if len(shards) == 1:
        at, number, _, least = shards[0]
        out[at] = least[number]
        return out, offset
    own, leasts = np.concatenate([s[2] for s in shards]), np.concatenate([s[3] for s in shards])
    for seed in range(64):
        marks = string_marks(everything, own, length, seed)
        order = np.lexsort((marks[:, 1], marks[:, 0]))
        table = marks[order]
        head = np.flatnonzero(np.r_[True, (table[1:] != table[:-1]).any(axis=1)])
        known, best = table[head], np.minimum.reduceat(leasts[order], head)
        place = _search(known, marks)
        if _same_bytes(everything, own, own[order[head]][place], length):
            break
    else:
        raise RuntimeError("strings could not be told apart")
    done = 0
    for at, number, first, _ in shards:
        out[at] = best[place[done : done + len(first)]][number]
        done += len(first)
    return out, offset


def _same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> bool:
    """Whether the strings at a are those at b, byte by byte."""
    step = np.arange(length)
    return all((data[a[i : i + 50_000, None] + step] == data[b[i : i + 50_000, None] + step]).all() for i in range(0, len(a), 50_000))


def _search(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of two-word keys, all present, in a sorted table of them: binary search by the first word, then the second."""
    place = np.searchsorted(table[:, 0], wanted[:, 0])
    while True:
        off = np.flatnonzero((table[place] != wanted).any(axis=1))
        if not len(off):
            return place
        place[off] += 1


# ---------------------------------------------------------------- the operator


#: Runs for a part of the minimizers (bucket is null), or HITS for a bucket that are settled in their task.
RUNS = "part int, bucket int, packed binary"
#: Parts of runs for each part of minimizers.
RUN_PARTS = 3


def _packed_runs(key: np.ndarray, doc: np.ndarray, own: np.ndarray, start: np.ndarray, pieces: list[bytes]) -> bytes:
    """Runs of one part: their keys (6 bytes), documents, rows, starts and pieces of text (below 256 bytes each)."""
    planes = [x.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes() for x, width in ((key, 6), (doc, 8), (own, 8), (start, 4), (np.fromiter(map(len, pieces), np.int64, len(pieces)), 1))]
    return zstandard.ZstdCompressor(level=3).compress(np.int64(len(pieces)).tobytes() + b"".join(planes) + b"".join(pieces))


def _unpacked_runs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, "<i8", 1)[0]), 8, []
    for width in (6, 8, 8, 4, 1):
        x = np.zeros((n, 8), np.uint8)
        x[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        out.append(x.view("<i8").ravel())
        at += n * width
    ends = np.cumsum(out[4]) + at
    return *out[:4], [raw[a:b] for a, b in zip((ends - out[4]).tolist(), ends.tolist())]


def _run_rows(length: int, parts: int, runs: int, crowded):
    """Runs of strings with shared minimizers, as RUNS.

    A run that a smaller document of the same task has is settled already. A
    hot minimizer's strings (crowded) go one by one, by their hashes.
    """

    def scan(batches):
        hot_minimizers = crowded.value
        for ids, more, texts in chunks(batches, length, 0, 1, (2, 3)):
            c = Chunk(texts, length)
            starts = c.ends - c.sizes
            flagged = np.zeros(len(c.low), bool)
            edges = np.searchsorted(c.owner, np.arange(len(texts) + 1))
            for i, (_, shared) in enumerate(more):
                own = slice(edges[i], edges[i + 1])
                flagged[own] = np.isin(c.low[own], _from_six(shared))
            hot = flagged & np.isin(c.low, hot_minimizers) if len(hot_minimizers) else np.zeros(len(c.low), bool)
            raw = c.data.tobytes()
            at, first, last = _cut_runs(np.flatnonzero(flagged), c.first, c.last, hot)
            doc = np.array(ids, np.int64)[c.owner[at]]
            tail = length - 1
            pieces = [raw[a : b + tail] for a, b in zip(first.tolist(), last.tolist())]
            # By document, so that the first run with a piece is the one to keep.
            order = np.argsort(doc, kind="stable").tolist()
            best: dict[bytes, int] = {}
            for n in order:
                best.setdefault(pieces[n], n)
            chief = np.fromiter(map(best.__getitem__, pieces), np.int64, len(pieces))
            begin = (first - starts[c.owner[at]]).astype(np.int64)
            own = np.array([m[0] for m in more], np.int64)[c.owner[at]]
            done = np.flatnonzero(doc > doc[chief])
            rows = _hit_rows(parts, doc[done], own[done], begin[done], (np.int64(1) << (last - first)[done]) - 1)
            if rows:
                bucket, packed = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array([x % runs for x in bucket], pa.int32()), pa.array(bucket, pa.int32()), pa.array(packed, pa.binary())], names=["part", "bucket", "packed"])
            sent = np.flatnonzero(doc == doc[chief])
            key = c.low[at].view(np.int64).copy()
            for n in sent[hot[at[sent]]].tolist():
                key[n] = xxhash.xxh3_64_intdigest(pieces[n]) >> 16
            part = key[sent] % runs
            sent = sent[np.lexsort((begin[sent], doc[sent], part))]
            part = key[sent] % runs
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]).tolist() if len(sent) else [0]
            own_runs = [sent[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
            packed = [_packed_runs(key[r], doc[r], own[r], begin[r], [pieces[n] for n in r.tolist()]) for r in own_runs]
            yield pa.RecordBatch.from_arrays([pa.array(part[cuts[:-1]].astype(np.int32)), pa.nulls(len(packed), pa.int32()), pa.array(packed, pa.binary())], names=["part", "bucket", "packed"])

    return scan


def _cut_runs(chosen: np.ndarray, first: np.ndarray, last: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, end): the chosen runs in pieces of MAX_RUN starts at most, hot ones of a single start."""
    most = np.where(hot[chosen], 1, MAX_RUN)
    n = -(-(last[chosen] - first[chosen]) // most)
    run = np.repeat(chosen, n)
    step = (np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)) * np.repeat(most, n)
    begin = first[run] + step
    return run, begin, np.minimum(begin + np.repeat(most, n), last[run])


def removed_spans(n_bytes: int, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs [start, end) of bytes covered by strings at the given starts."""
    cover = np.zeros(n_bytes + 1, np.int32)
    np.add.at(cover, starts, 1)
    np.add.at(cover, np.minimum(starts + length, n_bytes), -1)
    gone = np.cumsum(cover[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.r_[False, gone, False]))
    return edges[::2], edges[1::2]


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """-> (doc_id, n_bytes long, spans array<struct<start, end>>, kept binary), a row for each row of docs.

    Spans are byte offsets in the UTF-8 text; kept is what is left. Texts are
    judged as they came, not by what is left of others. Null texts count as
    empty. Rows of the same id do not match one another; a row with a null id
    matches nothing. No rows give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    all_rows = docs.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("lm_text")).withColumn("lm_row", F.xxhash64("lm_text"))
    rows = all_rows.where("doc_id IS NOT NULL").withColumn("doc_id", F.col("doc_id").cast("long"))
    long_ = rows.where(F.octet_length("lm_text") >= length)

    # Whole copies: all but the smallest id go at once.
    named = long_.select("doc_id", "lm_row", F.sha2("lm_text", 256).alias("sha"))
    least = named.groupBy("sha").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    least = cut(least)  # both sides of the join are exchanges, so a large group of copies is split
    copies = cut(named.join(least, "sha").where("doc_id > least").select("doc_id", "lm_row").distinct())

    # A part of minimizers is held in memory by one task: about 8 bytes for 14 bytes of text.
    total = long_.agg(F.sum(F.octet_length("lm_text"))).first()[0] or 0
    parts = int(max(8, total // PART_BYTES))
    hot_documents = max(HOT, total // 7 // MAX_HOT)
    packed = long_.select("doc_id", "lm_text").mapInArrow(_minimizer_rows(parts, length), PACKED)
    shared = cut(packed.repartitionById(parts, F.col("part")).mapInArrow(_shared_rows(parts, hot_documents), PACKED))
    # A hot minimizer stands for more than hot_documents pairs, of at most a seventh of the bytes: there are MAX_HOT at most.
    crowded = [_from_six(r.hashes) for r in shared.where("part = -1").select("hashes").toLocalIterator()]
    crowded = spark.sparkContext.broadcast(np.sort(np.concatenate([np.empty(0, np.uint64), *crowded])))
    by_doc = shared.where("part >= 0").repartitionById(parts, F.col("part")).select("part", "direct", "ids", "docs", "hashes").mapInArrow(_merged_documents, "doc long, shared binary")
    whole = copies.groupBy("doc_id").agg(F.collect_set("lm_row").alias("whole")).withColumnRenamed("doc_id", "copy_of")
    by_doc = by_doc.join(whole, by_doc.doc == whole.copy_of, "left").select("doc", "shared", "whole")

    # One exchange of the texts, by document, serves the runs and the removal.
    placed = rows.repartition(int(max(parts, spark.sparkContext.defaultParallelism)), "doc_id")
    suspects = placed.join(by_doc, placed.doc_id == by_doc.doc).where(~F.coalesce(F.array_contains("whole", F.col("lm_row")), F.lit(False)))
    runs = suspects.select("doc_id", "lm_text", "lm_row", "shared").mapInArrow(_run_rows(length, parts, RUN_PARTS * parts, crowded), RUNS)
    settled = runs.repartitionById(RUN_PARTS * parts, F.col("part")).mapInArrow(_settle(length, parts), HITS)
    hits = settled.repartitionById(parts, F.col("part")).mapInArrow(_hits_of_documents, "lm_id long, hits array<struct<lm_row:bigint,starts:binary,masks:binary>>")
    marked = placed.join(whole, placed.doc_id == whole.copy_of, "left").join(hits, placed.doc_id == hits.lm_id, "left")
    marked = marked.select(F.col("doc_id").cast(id_type).alias("doc_id"), "lm_text", "lm_row", F.array_contains("whole", F.col("lm_row")).alias("whole"), "hits")
    nameless = all_rows.where("doc_id IS NULL").select("doc_id", "lm_text", "lm_row", F.lit(None).cast("boolean").alias("whole"), F.lit(None).cast("array<struct<lm_row:bigint,starts:binary,masks:binary>>").alias("hits"))
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches):
        for batch in batches:
            for b in slices(batch, 1):
                sizes, spans, kept = [], [], []
                for text, own, whole, hits in zip(*b.columns[1:]):
                    raw, starts = text.as_py(), [np.empty(0, np.int64)]
                    for hit in hits.as_py() or ():
                        if hit["lm_row"] == own.as_py():
                            first, mask = np.frombuffer(hit["starts"], "<i4").astype(np.int64), np.frombuffer(hit["masks"], "<i8")
                            starts.append((first[:, None] + np.arange(MAX_RUN))[((mask[:, None] >> np.arange(MAX_RUN)) & 1) == 1])
                    a, e = (np.array([0]), np.array([len(raw)])) if whole.as_py() else removed_spans(len(raw), np.concatenate(starts), length)
                    sizes.append(len(raw))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(a, e)])
                    kept.append(b"".join(raw[x:y] for x, y in zip([0, *e.tolist()], [*a.tolist(), len(raw)])))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(spans, span_type), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    return marked.union(nameless).mapInArrow(apply, f"doc_id {id_type}, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")
