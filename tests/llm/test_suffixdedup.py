import hashlib

import numpy as np

from lamella.llm.queries import op10_suffix_dedup
from lamella.llm.suffixdedup import common_prefixes, repeated_spans, shard_classes, suffix_array


def plain(docs, length=50):
    first = {}
    for doc, text in docs:
        raw = (text or "").encode()
        for i in range(len(raw) - length + 1):
            s = raw[i : i + length]
            first[s] = min(first.get(s, doc), doc)
    out = {}
    for n, (doc, text) in enumerate(docs):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - length + 1):
            if first[raw[i : i + length]] < doc:
                gone[i : i + length] = True
        runs = int((np.diff(np.r_[False, gone].astype(int)) == 1).sum())
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        out[n] = (doc, len(raw), int(gone.sum()), runs, kept)
    return list(out.values())


def digests(df):
    return sorted((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.spans), len(r.spans), bytes(r.kept)) for r in df.collect())


def test_query_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = op10_suffix_dedup(spark, sf_dir)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    wanted = sorted((*x[:4], hashlib.sha256(x[4]).hexdigest()) for x in plain(docs))
    assert sorted(map(tuple, got.collect())) == wanted
    assert sum(x[2] > 0 for x in wanted) > 5


def cases(prose):
    shared = prose(30, 50)
    return [
        (5, f"{prose(40, 1)} {shared} {prose(40, 2)}"),
        (3, f"{prose(40, 3)}{shared}{prose(10, 4)}{shared}"),
        (9, shared),
        (11, "ab" * 400),
        (12, "ab" * 300 + "c"),
        (13, "x" * 49),
        (14, "x" * 50),
        (15, "x" * 51 + "y" * 60),
        (16, "é" * 30),
        (17, "aé" * 30),
        (2, prose(40, 1)),
        (20, None),
        (21, ""),
    ]


def test_planted_strings(frame, prose):
    docs = cases(prose)
    assert digests(repeated_spans(frame(docs, clash=True))) == sorted(plain(docs))


def test_hot_minimizers(frame, prose, monkeypatch):
    import lamella.llm.suffixdedup as module

    monkeypatch.setattr(module, "HOT", 8)
    monkeypatch.setattr(module, "LOCAL_HOT", 3)
    shared = prose(20, 77)
    docs = [(i, f"{prose(12, 1000 + i)} {shared} {prose(12, 2000 + i)}") for i in range(60)] + cases(prose)
    assert digests(repeated_spans(frame([(i + 100, t) for i, t in docs]))) == sorted(plain([(i + 100, t) for i, t in docs]))


def test_odd_rows(frame, odd_rows):
    rows = repeated_spans(frame(odd_rows, clash=True)).collect()
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[5].kept == b"" and by[4].spans == []
    assert by[1].n_bytes == 0 and by[2].spans == []
    assert repeated_spans(frame([])).count() == 0


def test_repeated_id_does_not_match_itself(frame, prose):
    t = prose(40, 1)
    rows = repeated_spans(frame([(1, t), (1, t), (2, t)])).collect()
    assert sorted((r.doc_id, len(r.kept)) for r in rows) == [(1, len(t)), (1, len(t)), (2, 0)]


def test_suffix_array():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 600).astype(np.uint8)
    ends = np.array([100, 250, 251, 600])
    row = np.searchsorted(ends, np.arange(600), side="right")
    row_end = ends[row]
    raw = data.tobytes()
    order, _ = suffix_array(data, row, 600)
    key = [raw[i : row_end[i]] for i in range(600)]
    assert [key[i] for i in order] == sorted(key)
    lcp = common_prefixes(data, row_end, order, 1000)
    for k in range(1, 600):
        a, b = key[order[k - 1]], key[order[k]]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == n


def test_shard_classes():
    raw = b"abcabcabx" + b"zabcabd"
    row = np.repeat([0, 1], [9, 7])
    starts, number, first, least = shard_classes(np.frombuffer(raw, np.uint8), row, np.repeat([9, 16], [9, 7]), np.array([4, 2]), 4)
    found = {}
    for s, n in zip(starts.tolist(), number.tolist()):
        found.setdefault(raw[s : s + 4], set()).add(n)
    assert all(len(x) == 1 for x in found.values()) and len(found) == len(first)
    assert least[next(iter(found[b"abca"]))] == 2 and least[next(iter(found[b"cabx"]))] == 4


def least_of(pieces, doc, length):
    first = {}
    for p, d in zip(pieces, doc):
        for i in range(len(p) - length + 1):
            first[p[i : i + length]] = min(first.get(p[i : i + length], d), d)
    return [first[p[i : i + length]] for p in pieces for i in range(len(p) - length + 1)]


def test_shards_are_merged_by_bytes(monkeypatch):
    import lamella.llm.suffixdedup as module

    rng = np.random.default_rng(3)
    pieces = [bytes(rng.integers(97, 99, rng.integers(10, 40)).astype(np.uint8)) for _ in range(80)]
    doc = rng.integers(0, 50, 80)
    marks, seeds = module.string_marks, []

    def clashing(data, starts, length, seed=0):  # with the first two seeds unlike strings have one mark
        seeds.append(seed)
        return marks(data, starts, length, seed) % (1 if seed < 2 else 1 << 63)

    monkeypatch.setattr(module, "SHARD", 200)
    monkeypatch.setattr(module, "string_marks", clashing)
    least, offset = module._least_documents(pieces, doc, 10)
    got = [least[offset[i] + k] for i, p in enumerate(pieces) for k in range(len(p) - 9)]
    assert got == least_of(pieces, doc.tolist(), 10) and seeds == [0, 1, 2]


def test_bound_of_hot_minimizers(frame, prose, monkeypatch):
    import lamella.llm.suffixdedup as module

    shared = prose(20, 77)
    docs = [(i, f"{prose(12, 1000 + i)} {shared} {prose(12, 2000 + i)}") for i in range(40)]
    wanted = sorted(plain(docs))
    for hot, most in ((1, 1 << 22), (1, 1), (20_000, 1)):
        monkeypatch.setattr(module, "HOT", hot)
        monkeypatch.setattr(module, "MAX_HOT", most)
        assert digests(repeated_spans(frame(docs))) == wanted
