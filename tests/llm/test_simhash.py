from collections import Counter
from fractions import Fraction
from itertools import combinations

import numpy as np
import pytest
import xxhash

from lamella.llm.gray_index import Labels, gray_rank, link_within
from lamella.llm.queries import op9_simhash
from lamella.llm.simhash import hamming_links, similar_groups, simhash_groups


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    votes = Counter()
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        votes.update(b for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if votes[b] * 2 > len(shingles))


def plain_classes(codes, radius=3):
    """By index: the smallest index reachable."""
    of = list(range(len(codes)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i, j in combinations(range(len(codes)), 2):
        if (codes[i] ^ codes[j]).bit_count() <= radius:
            a, b = root(i), root(j)
            of[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(codes))]


def test_query_against_brute_force(spark, sf_dir):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    codes = [plain_fingerprint(t) for _, t in docs]
    classes = plain_classes(codes)
    wanted = {(d, f"{c:016x}", docs[k][0]) for (d, _), c, k in zip(docs, codes, classes)}
    got = op9_simhash(spark, sf_dir)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert {tuple(r) for r in got.collect()} == wanted
    assert any(d != c for d, _, c in wanted)


def test_chains_of_links(spark):
    rng = np.random.default_rng(3)
    codes = [int(rng.integers(1 << 63))]
    for _ in range(40):  # each within 3 bits of the one before
        codes.append(codes[-1] ^ sum(1 << int(b) for b in rng.choice(64, 3, replace=False)))
    codes += [int(x) for x in rng.integers(1 << 63, size=300)]
    rows = [(int(np.uint64(c).view(np.int64)), i) for i, c in enumerate(codes)]
    edges = hamming_links(spark.createDataFrame(rows, "fp long, rep long")).collect()
    of = plain_classes(codes)
    labels = Labels(len(codes))
    labels.link(np.array([e.src for e in edges]), np.array([e.dst for e in edges]))
    assert labels.of.tolist() == of
    assert of[40] == 0


def test_hot_places_are_split(spark, monkeypatch):
    import lamella.llm.simhash as module

    monkeypatch.setattr(module, "HOT_PLACE", 50)
    rng = np.random.default_rng(4)
    base = int(rng.integers(1 << 63))
    codes = list({base ^ sum(1 << int(b) for b in rng.choice(64, int(k), replace=False)) for k in rng.integers(1, 9, 400)})
    rows = [(int(np.uint64(c).view(np.int64)), i) for i, c in enumerate(codes)]
    labels = Labels(len(codes))
    edges = hamming_links(spark.createDataFrame(rows, "fp long, rep long")).collect()
    labels.link(np.array([e.src for e in edges]), np.array([e.dst for e in edges]))
    assert labels.of.tolist() == plain_classes(codes)


def test_hierarchy_finds_every_pair():
    rng = np.random.default_rng(5)
    codes = np.unique(rng.integers(0, 1 << 63, 700, dtype=np.uint64) & np.uint64(0x7FFF))
    codes = codes[np.argsort(gray_rank(codes))]
    labels = Labels(len(codes))
    link_within(codes[:, None], 1, labels, np.arange(len(codes)))
    assert labels.of.tolist() == plain_classes(codes.tolist(), 1)


def test_odd_rows(frame, odd_rows):
    rows = simhash_groups(frame(odd_rows, clash=True)).collect()
    assert len(rows) == len(odd_rows)
    of = {r.doc_id: r.component_id for r in rows}
    assert of[1] == of[2] == of[3] == 1  # no words: fingerprint zero
    assert of[5] == 4 and of[7] == 6
    assert sorted(r.component_id for r in rows if r.doc_id is None) == [1, 6]


def test_no_rows(frame):
    assert simhash_groups(frame([])).count() == 0
    assert similar_groups(frame([])).count() == 0


def test_similar_groups(frame, prose):
    base = prose(400, 1).split()
    rows = [(1, " ".join(base))]
    for i in range(2, 12):  # a few words changed
        own = list(base)
        for k in range(3):
            own[(i * 37 + k * 131) % 400] = f"changed{i}"
        rows.append((i, " ".join(own)))
    rows += [(100 + i, prose(400, 100 + i)) for i in range(60)]
    got = {r.doc_id: r.component_id for r in similar_groups(frame(rows, clash=True)).collect()}
    assert {got[i] for i in range(1, 12)} == {1}
    assert all(got[i] == i for i in range(100, 160))


def test_similar_groups_odd_rows(frame, odd_rows):
    got = similar_groups(frame(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert {r.component_id for r in got if r.doc_id in (4, 5)} == {4}


@pytest.mark.parametrize("words, radius", [(1, 3), (2, 25)])
def test_hot_places_in_cells(spark, monkeypatch, words, radius):
    import lamella.llm.simhash as module

    monkeypatch.setattr(module, "HOT_PLACE", 40)
    rng = np.random.default_rng(6)
    bits = 64 * words

    def near(code, most):
        return code ^ sum(1 << int(b) for b in rng.choice(bits, int(rng.integers(1, most)), replace=False))

    first, second = (int.from_bytes(rng.bytes(bits // 8), "little") for _ in "ab")
    codes = {near(first, radius + 4) for _ in range(250)} | {near(second, radius + 2) for _ in range(120)} | {int.from_bytes(rng.bytes(bits // 8), "little") for _ in range(150)}
    last = first
    for _ in range(60):  # a chain that leaves the group
        last ^= sum(1 << int(b) for b in rng.choice(bits, radius, replace=False))
        codes.add(last)
    codes = sorted(codes)
    signed = lambda c, w: int(np.uint64(c >> 64 * w & (1 << 64) - 1).view(np.int64))
    names = [f"c{w}" for w in range(words)]
    rows = [(k % 7 // 6, 5, i, *[signed(c, w) for w in range(words)]) for i, c in enumerate(codes) for k in (0, 6)]  # all at two places
    met = spark.createDataFrame(rows, f"place int, key long, rep long, {', '.join(f'{n} long' for n in names)}")
    edges = module._forest(met, names, radius).collect()
    labels = Labels(len(codes))
    labels.link(np.array([e.src for e in edges]), np.array([e.dst for e in edges]))
    assert labels.of.tolist() == plain_classes(codes, radius)


def test_repeats_do_not_make_texts_similar(frame, prose):
    one, other = prose(60, 1), prose(60, 2)
    rows = [(1, one + " again and again it says" * 40), (2, other + " again and again it says" * 40), (3, one + " again and again it says" * 41)]
    got = {r.doc_id: r.component_id for r in similar_groups(frame(rows)).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def spoiled(text, runs):
    """text with `runs` single words changed, each ten words from the next: five shingles each."""
    own = text.split()
    for k in range(runs):
        own[5 + 10 * k] = f"changed{k}"
    return " ".join(own)


def test_real_near_copies_are_found(frame, prose):
    rows = []
    for i in range(150):
        one = prose(504, 1000 + i)
        rows += [(2 * i, one), (2 * i + 1, spoiled(one, 11))]
    assert all(0.8 <= jaccard(rows[k][1], rows[k + 1][1]) < 0.81 for k in range(0, 300, 2))
    got = {r.doc_id: r.component_id for r in similar_groups(frame(rows)).collect()}
    assert got == {i: i // 2 * 2 for i in range(300)}


def test_less_than_the_similarity_is_not_linked(frame, prose):
    rows = []
    for i in range(60):
        one = prose(504, 2000 + i)
        rows += [(2 * i, one), (2 * i + 1, spoiled(one, 12 + i % 4))]
    assert all(0.7 < jaccard(rows[k][1], rows[k + 1][1]) < 0.8 for k in range(0, 120, 2))
    got = {r.doc_id: r.component_id for r in similar_groups(frame(rows)).collect()}
    assert got == {i: i for i in range(120)}


def family(rng, size, changes, of=300):
    """Sets of words drawn from a common set, each with up to so many changed."""
    base = rng.integers(0, 1 << 63, of, dtype=np.uint64)
    out = []
    for _ in range(size):
        own = base.copy()
        at = rng.choice(of, int(rng.integers(0, changes + 1)), replace=False)
        own[at] = rng.integers(0, 1 << 63, len(at), dtype=np.uint64)
        out.append(np.unique(own))
    return out


def plain_set_classes(sets):
    label = list(range(len(sets)))
    plain = [set(s.tolist()) for s in sets]
    for i in range(len(sets)):
        for j in range(i):
            if 10 * len(plain[i] & plain[j]) >= 8 * len(plain[i] | plain[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    return label


@pytest.mark.parametrize("size", [2, 5, 40])
def test_links_of_sets(size):
    from lamella.llm.simhash import links_of_sets

    rng = np.random.default_rng(size)
    sets = family(rng, size, 60) + family(rng, size // 2, 2, 5) + [np.array([1], np.uint64), np.array([1, 2, 3, 4, 5], np.uint64)]
    src, dst = links_of_sets(np.arange(len(sets)), sets, Fraction("0.8"))
    labels = Labels(len(sets))
    labels.link(src, dst)
    assert labels.of.tolist() == plain_set_classes(sets)


@pytest.mark.parametrize("rows_, bytes_", [(24, 1 << 20), (1 << 20, 1 << 15)])
def test_hot_places_of_sets_in_cells(spark, frame, prose, monkeypatch, rows_, bytes_):
    import lamella.llm.simhash as module

    monkeypatch.setattr(module, "CELL_ROWS", rows_)
    monkeypatch.setattr(module, "CELL_BYTES", bytes_)
    monkeypatch.setattr(module, "STARS", 2)
    monkeypatch.setattr(module, "band_keys", lambda hashes: np.arange(16))  # all texts meet
    rng = np.random.default_rng(8)
    rows = []
    for base in (prose(120, 1), prose(120, 2)):
        for _ in range(45):
            own = base.split()
            for k in rng.choice(24, int(rng.integers(0, 4)), replace=False):
                own[5 * int(k)] = f"changed{rng.integers(1 << 40)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, prose(80, 50 + i)) for i in range(30)]
    sets = [module.shingle_set(t.encode())[:, 0] for _, t in rows]
    got = {r.doc_id: r.component_id for r in similar_groups(frame(rows)).collect()}
    wanted = plain_set_classes(sets)
    assert [got[i] for i in range(len(rows))] == wanted and 30 < len(set(wanted)) < 80


def test_filter_of_ids(spark):
    from lamella.llm.simhash import _perhaps

    rows = spark.range(0, 200_000, 1, 4).withColumnRenamed("id", "doc_id").selectExpr("doc_id", "'x' AS t")
    got = _perhaps(rows, "doc_id", spark.range(0, 200_000, 40).toDF("rep"), "rep")
    ids = {r.doc_id for r in got.collect()}
    assert got.columns == ["doc_id", "t"] and ids >= set(range(0, 200_000, 40)) and len(ids) < 5_050
    assert _perhaps(rows, "doc_id", spark.range(0).toDF("rep"), "rep").count() == 0


def test_sets_within_the_radius_meet_without_bands(frame, prose, monkeypatch):
    import lamella.llm.simhash as module

    monkeypatch.setattr(module, "band_keys", lambda hashes: np.full(16, int(hashes[:, 1].view(np.int64)[0])))  # only equal sets meet
    rows = []
    for i in range(40):
        one = prose(3000, 3000 + i)
        rows += [(2 * i, one), (2 * i + 1, one.rsplit(" ", 1)[0] + " changed")]
    codes = [module.set_fingerprint(module.shingle_set(t.encode())) for _, t in rows]
    of = plain_classes([c & (1 << 64) - 1 for c in codes])
    got = {r.doc_id: r.component_id for r in similar_groups(frame(rows)).collect()}
    assert [got[i] for i in range(80)] == of and sum(of[k + 1] == k for k in range(0, 80, 2)) > 30


def test_a_common_fingerprint_links_no_unlike_sets(frame, prose, monkeypatch):
    import lamella.llm.simhash as module

    monkeypatch.setattr(module, "set_fingerprint", lambda hashes: 5)
    rows = [(i, prose(60, 4000 + i)) for i in range(20)] + [(20, prose(60, 4000) + " end")]
    got = {r.doc_id: r.component_id for r in similar_groups(frame(rows)).collect()}
    assert got == {**{i: i for i in range(20)}, 20: 0}


def test_set_fingerprint(monkeypatch):
    import lamella.llm.simhash as module

    monkeypatch.setattr(module, "SLICE", 7)
    hashes = module.shingle_set(b"a b c d e f g h i j k l m n o p q r s t a b c d e f")
    votes = [sum(int(h) >> b & 1 for h in hashes[:, 0]) for b in range(64)]
    wanted = sum(1 << b for b in range(64) if 2 * votes[b] > len(hashes))
    assert module.set_fingerprint(hashes) & (1 << 64) - 1 == wanted and module.set_fingerprint(hashes[:0]) == 0
