from collections import Counter
from fractions import Fraction

import pytest

from lamella.llm.mixing import mix, pfair_period, tempered, whole_parts
from lamella.llm.queries import op1_mixing


def test_period_meets_every_deadline():
    for weights in ({"a": 1}, {"a": 7, "b": 2, "c": 1}, {"a": 1000, **{f"s{i}": 1 for i in range(50)}}, {None: 3, "x": 1}):
        parts = whole_parts(weights, 512)
        plan = pfair_period(parts)
        period = sum(parts.values())
        assert sorted((str(k), i) for k, i, *_ in plan) == sorted((str(k), i) for k, n in parts.items() for i in range(n))
        so_far = Counter()
        for name, i, release, deadline, slot in plan:
            assert release <= slot < deadline and i == so_far[name]
            so_far[name] += 1
            for k, n in parts.items():  # less than one block off, at every slot
                assert abs(so_far[k] * period - n * (slot + 1)) < period


def test_whole_parts():
    assert whole_parts({"a": 1, "b": 1, "c": 0}, 8) == {"a": 4, "b": 4}
    assert sum(whole_parts({f"s{i}": 1e-9 if i else 1 for i in range(40)}, 16).values()) == 256
    assert whole_parts({}, 8) == {}


def check(rows, weights, block, parts):
    """Every prefix of slots on target is within one block of its weight."""
    shares = whole_parts({k: w for k, w in weights.items()}, parts)
    period = sum(shares.values())
    size, ends = Counter(), {}
    for r in rows:
        if r.mix_on_target:
            size[r.mix_slot, r.source] += 1
            assert r.mix_release <= r.mix_slot < r.mix_deadline
    slots = max((s for s, _ in size), default=-1) + 1
    assert {s for s, _ in size} == set(range(slots)) and len(size) == slots
    so_far = Counter()
    for (slot, source), n in sorted(size.items()):
        assert n == block
        so_far[source] += 1
        for k, p in shares.items():
            assert abs(so_far[k] - p * (slot + 1) / period) < 1
    return slots


def test_query_keeps_every_row_on_target(spark, sf_dir):
    got = op1_mixing(spark, sf_dir).collect()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source").collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs)
    check(got, tempered(Counter(r.source for r in docs)), 64, 4096)


def test_weights(frame):
    rows = [(i, "t", "en", "abc"[(i % 10 > 5) + (i % 10 > 8)]) for i in range(4000)]
    weights = {"a": 1, "b": 2, "c": 1}
    got = mix(frame(rows, clash=True), weights, block=10, parts=16).collect()
    assert len(got) == 4000 and len({(r.mix_slot, r.mix_rank) for r in got}) == 4000
    assert check(got, weights, 10, 16) >= 150
    again = mix(frame(list(reversed(rows))), weights, block=10, parts=16).collect()
    assert sorted((r.doc_id, r.mix_slot, r.mix_rank) for r in got) == sorted((r.doc_id, r.mix_slot, r.mix_rank) for r in again)


def test_no_weight_and_null_source(frame):
    rows = [(i, "t", "en", [None, "a", "b"][i % 3]) for i in range(300)]
    got = mix(frame(rows), {None: 1, "a": 1}, block=5, parts=8).collect()
    assert len(got) == 300
    assert {r.mix_block for r in got if r.source == "b"} == {-1} and all(r.mix_slot is None for r in got if r.source == "b")
    assert all(r.mix_slot is not None for r in got if r.source is None)


def test_odd_rows(frame, odd_rows):
    rows = [(*r, "en", None if k % 3 else "web") for k, r in enumerate(odd_rows)]
    df = frame(rows, clash=True)
    got = mix(df)
    assert got.count() == len(odd_rows)
    assert [c for c in got.columns if not c.startswith("mix_")] == [c for c in df.columns if not c.startswith("mix_")]
    assert mix(frame([])).count() == 0


def test_too_many_sources(frame):
    with pytest.raises(ValueError):
        mix(frame([(i, "t", "en", f"s{i}") for i in range(20)]), max_sources=10)


def test_exact_weights_over_a_long_run(frame):
    """More slots than a period of whole parts had, against the weights as they were given."""
    weights = {"a": Fraction(1, 3), **{f"s{i}": Fraction(2, 57) for i in range(19)}, "z": Fraction(1, 10**6)}
    names = sorted(weights)
    rows = [(i, "t", "en", "a" if i % 3 == 0 else f"s{i % 19}") for i in range(40_000)] + [(40_000 + i, "t", "en", "z") for i in range(5)]
    got = mix(frame(rows), weights, block=1).where("mix_on_target").collect()
    total, so_far = sum(weights.values()), Counter()
    assert len(got) > 30_000
    for slot, r in enumerate(sorted(got, key=lambda r: r.mix_slot)):
        so_far[r.source] += 1
        assert r.mix_slot == slot and r.mix_release <= slot < r.mix_deadline
        if slot % 50 == 0 or slot > len(got) - 100:
            assert all(abs(so_far[k] - weights[k] / total * (slot + 1)) < 1 for k in names)


def plain_mix(rows, weights, block):
    """(doc_id, block, release, deadline, slot, rank): at each slot the block of the earliest deadline among all that are released."""
    of = {}
    for key, doc, source in sorted(rows):
        of.setdefault(source, []).append(doc)
    total = sum(weights[s] for s in of)
    left = [(-(-(i + 1) * total // weights[s]), s is not None, str(s), i, i * total // weights[s], s) for s, ids in of.items() for i in range(-(-len(ids) // block))]
    done, out, slot = Counter(), [], 0
    while left:
        ready = [b for b in left if b[4] <= slot and b[3] == done[b[5]]]
        if ready:
            deadline, _, _, i, release, s = b = min(ready)
            left.remove(b)
            done[s] += 1
            out += [(doc, i, release, deadline, slot, k) for k, doc in enumerate(of[s][i * block : (i + 1) * block])]
        slot += 1
    return sorted(out)


@pytest.mark.parametrize("chunk", [1 << 20, 3])
def test_query_against_plain_schedule(spark, sf_dir, monkeypatch, chunk):
    from pyspark.sql import functions as F

    import lamella.llm.mixing as module

    monkeypatch.setattr(module, "CHUNK", chunk)
    buckets = max(1, spark.read.parquet(f"{sf_dir}/documents.parquet").count() // module.BUCKET_ROWS)
    key = F.xxhash64(F.lit(module.SEED), F.col("doc_id").cast("string"))
    rows = [((r.b, r.k), r.doc_id, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", key.alias("k"), F.pmod(key, F.lit(buckets)).alias("b")).collect()]
    weights = {s: Fraction(w) for s, w in tempered(Counter(s for _, _, s in rows)).items()}
    for block in (64, 7):
        got = op1_mixing(spark, sf_dir) if block == 64 else mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), block=block)
        assert sorted((r.doc_id, r.mix_block, r.mix_release, r.mix_deadline, r.mix_slot, r.mix_rank) for r in got.collect()) == plain_mix(rows, weights, block)
