"""SimHash near-duplicate groups.

1. Fingerprints: one pass over the texts, no shuffle.
2. Exact duplicates of a fingerprint are folded by a partial aggregation.
3. Distinct fingerprints meet when they agree on `radius + 2` choose 2 pairs of
   bit blocks (pigeonhole: with `radius` differing bits, two of radius + 2
   blocks are equal). Each meeting place is searched by a Gray-order hierarchy
   and yields a spanning forest of its links, never all pairs.
4. Components of the forest edges; one join back on the fingerprint.

A meeting place with more than HOT_PLACE fingerprints is split once more by
blocks of its remaining bits, by the same argument; one that is still as large
is cut into chunks, of which all pairs meet but those of codes that are linked
already by a common neighbour (_hot_cells). So no link is lost.

similar_groups takes steps 1 to 4 for candidates, on fingerprints of shingle
sets, and links by the similarity of the sets themselves.
"""

from __future__ import annotations

from fractions import Fraction
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, small_batches, stored
from .components import connected_components
from .gray_index import Labels, gray_rank, link_within

HOT_PLACE = 50_000
PIVOTS = 3
SLICE = 1 << 18
#: MinHash bands of similar_groups, which take the pairs beyond the radius of its SimHash.
BANDS, BAND_ROWS = 16, 4
#: A place of more members or bytes of shingles is searched by cells, after links to so many pivots.
CELL_ROWS, CELL_BYTES = 1024, 16 << 20
STARS = 8
FEW = 6
#: Bits of a filter of ids that is broadcast: 8 MB, about twice that as a table of bitmaps.
FILTER_BITS = 1 << 26
_FACTORS = np.random.default_rng(7).integers(0, 1 << 63, (BANDS * BAND_ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of the lower-cased text's word shingles, repeats included."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - shingle + 1)
    xx = xxhash.xxh64_intdigest
    set_bits = np.zeros(64, np.int64)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    for at in range(0, n, SLICE):
        s, e = starts[at : min(at + SLICE, n)].tolist(), last[at : at + SLICE].tolist()
        h = np.fromiter((xx(joined[i:j], 42) for i, j in zip(s, e)), np.uint64, len(s))
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        set_bits += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(set_bits * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """-> (doc_id, fp long). A null text has fingerprint 0, as an empty one."""
    kind = docs.schema[id_col].dataType

    def scan(batches):
        for batch in batches:
            text = batch.column(1)
            out = np.fromiter((fingerprint(x.as_py(), shingle) for x in text), np.uint64, len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(scan, f"doc_id {kind.simpleString()}, fp long")


def _blocks(radius: int, bits: range, parts: int) -> list[list[int]]:
    """The given bits in so many runs of nearly the same length."""
    cuts = np.linspace(0, len(bits), parts + 1).round().astype(int)
    return [list(bits)[a:b] for a, b in zip(cuts[:-1], cuts[1:])]


def _mask(bits: list[int]) -> int:
    m = sum(1 << b for b in bits)
    return m - (1 << 64) if m >> 63 else m


def _places(fp: Column, radius: int) -> list[tuple[int, list[int]]]:
    blocks = _blocks(radius, range(64), radius + 2)
    return [(i, a + b) for i, (a, b) in enumerate(combinations(blocks, 2))]


def hamming_links(codes: DataFrame, radius: int = 3) -> DataFrame:
    """(fp long, rep long), distinct fp -> forest edges (src, dst) between reps.

    Their components are those of all pairs with at most `radius` differing bits.
    """
    places = _places(F.col("fp"), radius)
    at = F.explode(F.array(*[F.struct(F.lit(i).alias("place"), F.col("fp").bitwiseAND(_mask(bits)).alias("key")) for i, bits in places]))
    met = codes.select("fp", "rep", at.alias("at")).select("fp", "rep", "at.place", "at.key")
    hot = cut(met.groupBy("place", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_PLACE).drop("n"))
    if not hot.isEmpty():
        met = _split_hot(met, hot, places, radius)
    return _forest(met, ["fp"], radius)


def _split_hot(met: DataFrame, hot: DataFrame, places: list, radius: int) -> DataFrame:
    """Places of too many codes: again by radius + 1 blocks of the bits not yet fixed."""
    marked = met.join(hot.withColumn("hot", F.lit(True)), ["place", "key"], "left")
    cases = F.when(F.col("hot").isNull(), F.array(F.struct("place", "key")))
    for i, fixed in places:
        rest = [b for b in range(64) if b not in fixed]
        cuts = np.linspace(0, len(rest), radius + 2).round().astype(int)
        subs = [rest[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        finer = F.array(*[F.struct(F.lit(1000 + 100 * i + j).alias("place"), F.col("fp").bitwiseAND(_mask(fixed + sub)).alias("key")) for j, sub in enumerate(subs)])
        cases = cases.when(F.col("place") == i, finer)
    return marked.select("fp", "rep", F.explode(cases).alias("to")).select("fp", "rep", "to.place", "to.key")


def links_of_places(place: np.ndarray, key: np.ndarray, codes: np.ndarray, rep: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges (larger rep, smallest rep of its local component) over all places given.

    codes: a row of 64-bit words for each code.
    """
    order = np.lexsort((gray_rank(codes[:, 0]), key, place))
    place, key, codes, rep = place[order], key[order], codes[order], rep[order]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (key[1:] != key[:-1])])
    size = np.diff(np.r_[first, len(codes)])
    nodes, node = np.unique(rep, return_inverse=True)
    labels = Labels(len(nodes))
    segment = np.repeat(np.arange(len(first)), size)
    for step in range(1, min(33, int(size.max(initial=0)))):  # small places: neighbours at each distance in the order
        i = np.flatnonzero((segment[step:] == segment[:-step]) & (size[segment[:-step]] <= 32))
        if len(i):
            i = i[np.bitwise_count(codes[i] ^ codes[i + step]).sum(axis=1) <= radius]
            labels.link(node[i], node[i + step])
    for s in np.flatnonzero(size > 32):
        a, b = first[s], first[s] + size[s]
        link_within(codes[a:b], radius, labels, node[a:b])
    linked = np.flatnonzero(labels.of != np.arange(len(nodes)))
    return nodes[linked].astype(np.int64), nodes[labels.of[linked]].astype(np.int64)


def _forest(met: DataFrame, words: list[str], radius: int) -> DataFrame:
    """Rows of codes at places -> forest edges. The rows of a place meet in one task, unless there are
    more than HOT_PLACE of them."""
    hot = cut(met.groupBy("place", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_PLACE).drop("n"))
    if hot.isEmpty():
        return _searched(met.select("place", "key", "rep", *words), radius).distinct()
    marked = met.join(hot.withColumn("hot", F.lit(True)), ["place", "key"], "left")
    cool = marked.where("hot IS NULL").select("place", "key", "rep", *words)
    found, cells = _hot_cells(cut(marked.where("hot").select("place", "key", "rep", *words)), words, radius)
    return _searched(cool, radius).unionByName(_searched(cells, radius)).unionByName(found).distinct()


def _hot_cells(rows: DataFrame, words: list[str], radius: int) -> tuple[DataFrame, DataFrame]:
    """(edges, cells): rows of hot places, dealt to cells of at most about two HOT_PLACE rows each.

    A code within the radius of its place's pivot is linked to it, and so to
    all others that are: pairs of one such class need no search. What is left
    is taken by a second pivot, and a third. All other pairs meet, by _cells.
    """
    at, rest = ["place", "key"], rows
    edges, classed = None, None
    for _ in range(PIVOTS):
        pivot = cut(rest.groupBy(*at).agg(F.min_by(F.struct("rep", *words), "rep").alias("p")))
        apart = sum((F.bit_count(F.col(w).bitwiseXOR(F.col(f"p.{w}"))) for w in words), F.lit(0))
        near = rest.join(pivot, at).withColumn("near", apart <= radius)
        own = near.where("near").select(*at, "rep", *words, F.col("p.rep").alias("class"), F.lit(False).alias("open"))
        linked = near.where("near AND rep != p.rep").select(F.col("rep").alias("src"), F.col("p.rep").alias("dst"))
        edges = linked if edges is None else edges.unionByName(linked)
        classed = own if classed is None else classed.unionByName(own)
        rest = cut(near.where("NOT near").select(*at, "rep", *words))
        if rest.isEmpty():
            break
    everything = cut(classed.unionByName(rest.select(*at, "rep", *words, F.lit(0).cast("long").alias("class"), F.lit(True).alias("open"))))
    return edges, _cells(everything, words, F.lit(1.0), HOT_PLACE)


def _cells(rows: DataFrame, words: list[str], weight: Column, most: int) -> DataFrame:
    """(place, key, class, open, rep, words...) -> (place, key, rep, words...), key being the cell's.

    Rows are cut into chunks of about `most` in weight, by class, and each two
    chunks of a place that are not of one class make a cell, as does a chunk
    of open rows with itself. A large group of near copies is one class, so
    its cells are as many as its chunks, not their square.
    """
    at = ["place", "key"]
    sizes = cut(rows.groupBy(*at, "open", "class").agg(F.ceil(F.sum(weight) / most).alias("chunks")))
    chunk = sizes.select(*at, "open", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("c"))
    chunk = cut(chunk.withColumn("c", F.xxhash64("open", "class", "c")))
    a, b = (chunk.select(*at, *[F.col(x).alias(f"{n}_{x}") for x in ("open", "class", "c")]) for n in "ab")
    unlike = F.col("a_open") | F.col("b_open") | (F.col("a_class") != F.col("b_class"))
    pair = a.join(b, at).where(((F.col("a_c") < F.col("b_c")) & unlike) | ((F.col("a_c") == F.col("b_c")) & F.col("a_open")))
    pair = pair.select(*at, F.explode(F.array_distinct(F.array("a_c", "b_c"))).alias("c"), F.xxhash64("key", "a_c", "b_c").alias("cell"))
    of_chunk = rows.join(sizes, [*at, "open", "class"]).withColumn("c", F.xxhash64("open", "class", F.pmod(F.xxhash64("rep"), F.col("chunks"))))
    return of_chunk.join(cut(pair), [*at, "c"]).select("place", F.col("cell").alias("key"), "rep", *words)


def _searched(met: DataFrame, radius: int) -> DataFrame:
    """(place, key, rep, words...) -> forest edges of each place, which meets in one task."""

    def search(batches):
        parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not parts:
            return
        place, key, rep, *code = (np.concatenate(x) for x in zip(*parts))
        codes = np.stack([c.astype(np.int64).view(np.uint64) for c in code], axis=1)
        src, dst = links_of_places(place, key, codes, rep, radius)
        yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], names=["src", "dst"])

    return met.repartition("place", "key").mapInArrow(search, "src long, dst long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3) -> DataFrame:
    """-> (doc_id, fp long, component_id): one row for each row of docs.

    component_id is the smallest id reachable over fingerprints with at most
    `radius` differing bits. Null and empty texts have fingerprint 0 and are
    linked as any other. Repeated rows keep a row each. A row with a null id
    takes the class of its fingerprint, null if no row with an id shares it.
    No rows give no rows. Only the two named columns are read.
    """
    small_batches(docs.sparkSession)
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    codes = cut(prints.groupBy("fp").agg(F.min(F.col("doc_id").cast("long")).alias("rep")))
    edges = hamming_links(codes.where("rep IS NOT NULL"), radius)
    classes = connected_components(edges)
    of_code = codes.join(classes, codes.rep == classes.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(of_code, "fp").select("doc_id", "fp", "component_id")


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """128-bit hashes (XXH3) of the lower-cased text's distinct word shingles, sorted; a row of two words each."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty((0, 2), np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: max(1, len(words) - shingle + 1)]
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    xx = xxhash.xxh3_128_digest
    found = np.frombuffer(b"".join({xx(joined[i:j]) for i, j in zip(starts.tolist(), last.tolist())}), "<u8").reshape(-1, 2)
    return found[np.lexsort((found[:, 1], found[:, 0]))]


def set_mark(hashes: np.ndarray) -> tuple[int, int]:
    """128 bits of a whole shingle set, as two signed words."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(hashes.tobytes()), "<i8").tolist())


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """MinHash of a shingle set: a key for each of BANDS bands of BAND_ROWS minima."""
    if not len(hashes):
        return np.zeros(BANDS, np.int64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        h = hashes[at : at + 4096]
        least = np.minimum(least, (_FACTORS * h[:, 0] + h[:, 1]).min(axis=1))
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh3_64_intdigest(r.tobytes()) for r in rows], np.uint64).view(np.int64)


def set_fingerprint(hashes: np.ndarray) -> int:
    """64-bit SimHash of a shingle set: a bit is 1 if over half of the members have it."""
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        h = np.ascontiguousarray(hashes[at : at + SLICE, 0])
        set_bits += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(set_bits * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def alike(one: int, two: int, both: int, least: Fraction) -> bool:
    """Whether sets of so many members, and so many in common, have the Jaccard similarity."""
    return both * least.denominator >= (one + two - both) * least.numerator


def links_of_sets(rep: np.ndarray, sets: list[np.ndarray], least: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Forest edges (src, dst) over all pairs of the sets that have the similarity, which is counted exactly.

    sets: the members as 64-bit words, without repeats. Beyond a few sets, all
    intersections come from products of the 0/1 matrix of the members that sets share.
    """
    m = len(sets)
    labels = Labels(m)
    size = np.fromiter(map(len, sets), np.int64, m)
    if m <= FEW:
        plain = [set(s.tolist()) for s in sets]
        for i, j in combinations(range(m), 2):
            if labels.of[i] != labels.of[j] and alike(size[i], size[j], min(size[i], size[j]), least) and alike(size[i], size[j], len(plain[i] & plain[j]), least):
                labels.link(np.array([i]), np.array([j]))
    else:
        _, word, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[word] > 1
        row, number = np.repeat(np.arange(m), size)[shared], (np.cumsum(count > 1) - 1)[word[shared]]
        order = np.argsort(number, kind="stable")
        row, number = row[order], number[order]
        both = np.zeros((m, m), np.float32)  # whole numbers below 2 ** 24 are exact
        width = max(256, (1 << 21) // m)
        for a in range(0, int(number[-1]) + 1 if len(number) else 0, width):
            x, y = np.searchsorted(number, (a, a + width))
            dense = np.zeros((m, width), np.float32)
            dense[row[x:y], number[x:y] - a] = 1
            both += dense @ dense.T
        both = both.astype(np.int64)
        union = size[:, None] + size[None, :] - both
        labels.link(*np.nonzero(np.triu(both * least.denominator >= union * least.numerator, 1)))
    linked = np.flatnonzero(labels.of != np.arange(m))
    return rep[linked], rep[labels.of[linked]]


def _linked_places(least: Fraction):
    """Rows (place, key, rep, words) sorted by place and key -> forest edges; one place is in memory at a time."""

    def search(batches):
        found, held, last = [], [], None

        def close():
            if len(held) > 1:
                found.append(links_of_sets(np.array([r for r, _ in held], np.int64), [np.frombuffer(w, np.uint64) for _, w in held], least))
            held.clear()

        for batch in batches:
            for place, key, rep, words in zip(*[c.to_pylist() for c in batch.columns]):
                if (place, key) != last:
                    close()
                    last = place, key
                held.append((rep, words))
            if sum(len(x) for x, _ in found) > 10_000:
                yield _edges(found)
        close()
        yield _edges(found)

    return search


def _edges(found: list) -> pa.RecordBatch:
    src, dst = (np.concatenate([np.empty(0, np.int64), *[f[k] for f in found]]) for k in (0, 1))
    found.clear()
    return pa.RecordBatch.from_arrays([pa.array(np.maximum(src, dst)), pa.array(np.minimum(src, dst))], names=["src", "dst"])


def _places_searched(members: DataFrame, least: Fraction) -> DataFrame:
    at = ["place", "key"]
    return members.select(*at, "rep", "words").repartition(*at).sortWithinPartitions(*at).mapInArrow(_linked_places(least), "src long, dst long").distinct()


def _members(rows: DataFrame, asked: DataFrame, shingle: int) -> DataFrame:
    """(place, key, rep, n, words): the shingle sets of the texts that places ask for. A set is
    computed once and sent to each of its places, as the first words of its 128-bit hashes."""

    def emit(batches):
        for batch in batches:
            for part in slices(batch, 0, 1 << 19):
                out = [[], [], [], [], []]
                for text, rep, wanted in zip(*part.columns):
                    hashes = shingle_set(text.as_py(), shingle)
                    mark, words = set_mark(hashes), hashes[:, 0].tobytes()
                    for w in wanted.as_py():
                        if (w["c1"], w["c2"]) == mark:
                            for column, x in zip(out, (w["place"], w["key"], rep.as_py(), len(hashes), words)):
                                column.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()))], names=["place", "key", "rep", "n", "words"])

    wanted = stored(asked.groupBy("rep").agg(F.collect_list(F.struct("c1", "c2", "place", "key")).alias("wanted")))
    return _perhaps(rows, "doc_id", wanted, "rep").join(wanted, rows.doc_id == wanted.rep).select("t", "rep", "wanted").mapInArrow(emit, "place int, key long, rep long, n int, words binary")


def _perhaps(rows: DataFrame, id_: str, wanted: DataFrame, wanted_id: str) -> DataFrame:
    """Of rows, those whose id is wanted and a few others: so a join that keeps few texts shuffles few.

    Ids are hashed to FILTER_BITS bits, in bitmaps of 32,768 bits each. If very
    many are wanted most rows pass, and the join alone decides.
    """
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_BITS))
    maps = wanted.select(bit(wanted_id).alias("b")).groupBy(F.floor(F.col("b") / 32768).cast("int").alias("lm_maps")).agg(F.bitmap_construct_agg(F.col("b") % 32768).alias("lm_bits"))
    held = rows.withColumn("lm_bit", bit(id_)).join(F.broadcast(maps), F.floor(F.col("lm_bit") / 32768).cast("int") == F.col("lm_maps"))
    byte = F.conv(F.hex(F.substring("lm_bits", F.floor(F.col("lm_bit") % 32768 / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return held.where(F.getbit(byte, (F.col("lm_bit") % 8).cast("int")) == 1).select(*rows.columns)


def _simhash_places(codes: DataFrame, radius: int) -> DataFrame:
    """(fp, rep, n, c1, c2) -> (place, key, rep, n, c1, c2): the sets of each SimHash group at a place.

    A group is a component of fingerprints with at most `radius` differing
    bits, found by the Gray-order index as in simhash_groups.
    """
    prints = cut(codes.groupBy("fp").agg(F.min("rep").alias("rep")))
    classes = connected_components(hamming_links(prints, radius))
    group = prints.join(classes, prints.rep == classes.node, "left").select("fp", F.coalesce("component", "rep").alias("key"))
    return codes.join(stored(group), "fp").select(F.lit(BANDS).alias("place"), "key", "rep", "n", "c1", "c2")


def _similar_links(met: DataFrame, rows: DataFrame, shingle: int, least: Fraction) -> DataFrame:
    """(place, key, rep, n, c1, c2) -> (node, component) over all pairs that meet and are alike.

    Places with the same members are searched once. The members of a place
    meet in one task, as sets; those of a hot place are first compared with
    STARS pivots, and then, by cells, with all that are not in one component
    with them yet. So no link is lost and pairs are never rows.
    """
    at = ["place", "key"]
    places = met.groupBy(*at).agg(F.count(F.lit(1)).alias("m"), F.bit_xor(F.xxhash64("rep", "c1")).alias("x"), F.min("rep").alias("a"), F.max("rep").alias("b"), F.sum(F.col("n") * 8).alias("bytes")).where("m > 1")
    once = places.groupBy("m", "x", "a", "b", "bytes").agg(F.min(F.struct(*at)).alias("p")).select("p.*", ((F.col("m") > CELL_ROWS) | (F.col("bytes") > CELL_BYTES)).alias("hot"))
    asked = cut(met.join(stored(once), at))
    edges = cut(_places_searched(_members(rows, asked.where("NOT hot"), shingle), least))
    if asked.where("hot").isEmpty():
        return connected_components(edges)
    members = stored(_members(rows, asked.where("hot"), shingle).distinct())
    edges = cut(edges.unionByName(_stars(members, least)))
    labels = connected_components(edges)
    own = stored(members.join(labels, members.rep == labels.node, "left").select(*at, "rep", "n", "words", F.coalesce("component", "rep").alias("class")))
    sizes = own.groupBy(*at, "class").agg(F.count(F.lit(1)).alias("rows_"))
    mixed = sizes.groupBy(*at).agg(F.count(F.lit(1)).alias("classes")).where("classes > 1").drop("classes")
    left = own.join(stored(sizes.join(mixed, at)), [*at, "class"])
    small = F.col("rows_") * STARS < CELL_ROWS  # small classes share chunks, as rows that stand alone do
    left = cut(left.select(*at, "rep", "n", "words", small.alias("open"), F.when(small, 0).otherwise(F.col("class")).alias("class")))
    cells = _cells(left, ["words"], 1 + F.col("n") / (CELL_BYTES / CELL_ROWS / 8), CELL_ROWS // 2)
    more = cut(_places_searched(cells, least))
    return labels if more.isEmpty() else connected_components(edges.unionByName(more))


def _stars(members: DataFrame, least: Fraction) -> DataFrame:
    """Edges between the members of each place and STARS pivots of it."""

    @F.pandas_udf("boolean")
    def near(one: pd.Series, two: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(one, two):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            fits = alike(len(a), len(b), min(len(a), len(b)), least)
            out.append(fits and alike(len(a), len(b), len(np.intersect1d(a, b, assume_unique=True)), least))
        return pd.Series(out, dtype=bool)

    at = ["place", "key"]
    pivots = F.array(*[F.min_by(F.struct("rep", "words"), F.xxhash64("rep", F.lit(k))) for k in range(STARS)])
    stars = stored(members.groupBy(*at).agg(pivots.alias("p")).select(*at, F.explode(F.array_distinct("p")).alias("p")).select(*at, F.col("p.rep").alias("to"), F.col("p.words").alias("other")))
    met = members.join(stars, at).where("rep != to")
    return met.where(near("words", "other")).select(F.greatest("rep", "to").alias("src"), F.least("rep", "to").alias("dst")).distinct()


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = 3) -> DataFrame:
    """-> (doc_id, component_id): documents whose sets of five-word shingles have
    at least `similarity` as Jaccard similarity are linked.

    Candidates are all pairs of a SimHash group, which are components of
    fingerprints with at most `radius` differing bits. A pair of similarity 0.8
    differs in ten of 64 bits or so, so candidates are also those that agree on
    all BAND_ROWS minima of one of BANDS MinHash bands: a pair of similarity s
    is missed by the bands with probability (1 - s**4)**16, which is 0.00022 at
    0.8 and less above, whatever the number of documents. A candidate pair is
    linked only if its sets, as 64-bit hashes of whole shingles, are that
    similar. Nulls, ids, repeated and empty rows are treated
    as in simhash_groups; very long texts are single slices and, with many
    alike, cells of CELL_BYTES.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType

    def scan(batches):
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                sets = [shingle_set(x.as_py(), shingle) for x in part.column(1)]
                c1, c2 = zip(*map(set_mark, sets))
                keys = pa.array([band_keys(s) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([set_fingerprint(s) for s in sets], pa.int64()), keys], names=["doc_id", "c1", "c2", "n", "fp", "bands"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("t"))
    found = stored(rows.mapInArrow(scan, f"doc_id {kind.simpleString()}, c1 long, c2 long, n int, fp long, bands array<long>"))
    prints = found.select("doc_id", "c1", "c2")
    codes = cut(found.groupBy("c1", "c2").agg(F.min(F.col("doc_id").cast("long")).alias("rep"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("bands").alias("bands")))
    sets = codes.where("rep IS NOT NULL AND n > 0")
    met = sets.select("rep", "n", "c1", "c2", F.posexplode("bands").alias("place", "key")).unionByName(_simhash_places(sets.drop("bands"), radius))
    classes = _similar_links(met, rows.withColumn("doc_id", F.col("doc_id").cast("long")), shingle, Fraction(str(similarity)))
    of_code = codes.join(classes, codes.rep == classes.node, "left").select("c1", "c2", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(stored(of_code), ["c1", "c2"]).select("doc_id", "component_id")


def hex_fingerprint(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
