"""The corpus pipeline against a plain version of its stages."""

from collections import Counter
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from lamella.llm import langid
from lamella.llm.decontaminate import Automaton, removed_spans, words_of

from .test_mixing import check
from .test_decontaminate import plain
from lamella.llm.mixing import tempered


def plain_language_id(spark, docs):
    from pyspark.sql import functions as F

    model = langid.train(docs.where(~langid.held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()))
    rows = docs.collect()
    found, _ = langid.Scorer(model)([r.text for r in rows])
    return [{**r.asDict(), "lang": r.lang or g} for r, g in zip(rows, found) if g != langid.NONE]


def plain_near_dedup(rows):
    """Jaccard similarity of 0.8 or more of the sets of five-word shingles, over all pairs."""
    codes = {}
    for r in rows:
        w = (r["text"] or "").encode().lower().split()
        codes.setdefault(frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)) if w), []).append(r["doc_id"])
    keys = list(codes)
    label = list(range(len(keys)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(keys)), 2):
        if 10 * len(keys[i] & keys[j]) >= 8 * len(keys[i] | keys[j]) > 0:
            a, b = root(i), root(j)
            label[max(a, b)] = min(a, b)
    least = {}
    for i, k in enumerate(keys):
        least[root(i)] = min([least.get(root(i), 1 << 60), *codes[k]])
    keep = set(least.values())
    return [r for r in rows if r["doc_id"] in keep]


def plain_decontamination(rows, items):
    hits = {d: n_hit / max(1, n) for d, n, n_hit, *_ in plain([(r["doc_id"], r["text"]) for r in rows], items)}
    automaton = Automaton([(i, words_of((t or "").encode())) for i, t in items])
    out = []
    for r in rows:
        if hits[r["doc_id"]] > 0.5:
            continue
        if hits[r["doc_id"]]:
            words = words_of(r["text"].encode())
            hit, _ = automaton.scan(np.array([automaton.vocabulary.get(w, -1) for w in words]))
            runs = np.flatnonzero(np.diff(np.r_[False, hit, False])).reshape(-1, 2).tolist()
            text = removed_spans(r["text"], [{"start": a, "end": b} for a, b in runs])
            r = {**r, "text": text, "n_chars": len(text)}
        out.append(r)
    return out


def by_stage(spark, docs, sf_dir):
    out = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        docs = docs.checkpoint()
        out.append(docs)
    return out


def test_stages_against_plain_versions(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = by_stage(spark, docs, sf_dir)
    rows = plain_language_id(spark, docs)
    for stage, make in zip(got[:3], (None, plain_near_dedup, lambda r: plain_decontamination(r, items))):
        rows = make(rows) if make else rows
        assert stage.columns == docs.columns
        assert sorted((r.asDict() for r in stage.collect()), key=lambda r: r["doc_id"]) == sorted(rows, key=lambda r: r["doc_id"])
    assert got[3].columns == docs.columns and got[3].count() == len(rows)
    last = got[4].collect()
    assert Counter(r.doc_id for r in last) == Counter(r["doc_id"] for r in rows)
    check(last, tempered(Counter(r.source for r in last)), 64, 4096)


def test_run(spark, sf_dir):
    assert corpus_pipeline.ORACLE_SQL is None
    got = corpus_pipeline.run(spark, sf_dir)
    names = spark.read.parquet(f"{sf_dir}/documents.parquet").columns
    assert [c for c in got.columns if not c.startswith("mix_")] == names and got.count() > 0


@pytest.mark.parametrize("empty", [False, True])
def test_odd_rows(spark, frame, sf_dir, odd_rows, empty):
    df = frame([] if empty else odd_rows, clash=True)
    df = df.selectExpr("*", "array('x') AS hits_", "'y' AS lm_doc")
    stages = by_stage(spark, df, sf_dir)
    for d in stages[:-1]:
        assert d.columns == df.columns
    assert (stages[-1].count() == 0) == empty
    if not empty:
        kept = {r.doc_id for r in stages[1].collect()}
        assert 1 not in kept and 2 not in kept and 5 not in kept and {4, 6, 8, 9} <= kept
        assert all(r.component_id == "x" and r.lm_doc == "y" for r in stages[3].collect())
