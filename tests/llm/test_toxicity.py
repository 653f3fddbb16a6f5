import math
import zlib

import pytest
from pyspark.sql import functions as F

from lamella.llm import toxicity
from lamella.llm.queries import op5_toxicity


def test_held_out_ranking(spark):
    folder = "/root/testdata/sf0.1"
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = op5_toxicity(spark, folder)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    judged = [(r.score, marks[r.doc_id]) for r in rows if r.held_out and r.doc_id in marks]
    bad, good = [s for s, t in judged if t == 1], [s for s, t in judged if t == 0]
    assert len(bad) > 5
    above = sum((b > g) + (b == g) / 2 for b in bad for g in good) / (len(bad) * len(good))
    assert above > 0.95
    assert sum((s >= 0.5) == (t == 1) for s, t in judged) / len(judged) > 0.95


def test_folding():
    assert toxicity.fold("You 1D10T!") == " you idiot "
    assert toxicity.fold("ІDІОТ") == " idiot "  # Cyrillic letters
    assert toxicity.fold("i.d.i.o.t and i-d-i-o-t") == " idiot and idiot "
    assert toxicity.fold("ＩＤＩＯＴ") == " idiot "
    assert toxicity.fold(None) == toxicity.fold("") == " "


def learned(spark, frame, prose):
    rows = [(i, f"{prose(30, i)} you filthy grobnak {prose(10, 500 + i)}", "en", "web") for i in range(80)]
    rows += [(1000 + i, prose(40, 1000 + i) + (" a grobnak lily in the pond" if i % 8 == 0 else ""), "en", "web") for i in range(400)]
    labels = spark.createDataFrame([(r[0], 0, int(r[0] < 1000)) for r in rows] + [(None, 0, 1), (3, None, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
    return toxicity.train(frame(rows), labels)


def test_learned_terms_disguises_and_excuses(spark, frame, prose):
    lexicon = learned(spark, frame, prose)
    assert lexicon.score(prose(30, 7) + " You GR0BNAK!") > 0.5
    assert lexicon.score(prose(30, 7) + " you g.r.o.b.n.a.k") > 0.5
    assert lexicon.score(prose(30, 7)) < 0.5
    assert lexicon.score(prose(30, 7) + " a grobnak lily") < 0.5  # an excused phrase
    assert lexicon.score(None) == lexicon.score("") < 0.5


def test_near_copies_teach_as_one(spark, frame, prose):
    copy = prose(60, 3) + " zorbwex zorbwex"
    rows = [(i, f"{copy} {i}", "en", "web") for i in range(60)] + [(1000 + i, prose(40, 1000 + i), "en", "web") for i in range(200)]
    labels = spark.createDataFrame([(r[0], 0, int(r[0] < 1000)) for r in rows], "doc_id long, quality int, toxic int")
    assert not any("zorb" in t for t in toxicity.train(frame(rows), labels).weights)


def plain_log_odds(a, b, n_bad, n_good):
    if a < 3:
        return 0.0
    odds = math.log((a + 0.5) / (n_bad + 1)) - math.log((b + 0.5) / (n_good + 1))
    p = (a + b) / (n_bad + n_good)
    ratio = 2 * sum(x * math.log(x / e) for x, e in ((a, n_bad * p), (b, n_good * p)) if x)
    return odds if odds > math.log(toxicity.LEAST_ODDS) and ratio > toxicity.EVIDENCE else 0.0


def test_weights_of_terms(spark):
    rows = [(f" {chr(97 + k)}x ", a1, a2, b1, b2) for k, (a1, a2, b1, b2) in enumerate([(60, 50, 100, 2), (60, 5, 100, 2), (3, 0, 0, 0), (40, 0, 0, 0), (90, 90, 1, 0), (2, 2, 0, 0)])]
    got = toxicity.choose(spark.createDataFrame(rows, "term string, bad1 long, bad2 long, good1 long, good2 long"), 100, 1000)
    wanted = {t: min(6.0, max(plain_log_odds(a1, b1, 100, 1000), plain_log_odds(a2, b2, 100, 1000) / 2)) for t, a1, a2, b1, b2 in rows}
    assert got == pytest.approx({t: w for t, w in wanted.items() if w}) and " ax " in got and " bx " not in got
    short = [(" grob", 50, 0, 0, 0), (" grobnak ", 50, 0, 0, 0), (" zork ", 40, 0, 0, 0)]
    frame = spark.createDataFrame(short, "term string, bad1 long, bad2 long, good1 long, good2 long")
    assert set(toxicity.choose(frame, 100, 1000)) == {" grob", " zork "} and set(toxicity.choose(frame, 100, 1000, 1)) <= {" grob", " grobnak "}


def plain_score(lexicon, text):
    """A search for each term and phrase, and the formula of the score."""
    folded = toxicity.fold(text)
    places = lambda t: [i for i in range(len(folded)) if folded.startswith(t, i)]
    best = {}
    for t, w in lexicon.weights.items():
        for i in places(t):
            best[i] = max(w, best.get(i, 0))
    off = [(i, i + len(p) + 1) for p in lexicon.excused for i in places(f" {p} ")]
    total = sum(w for i, w in best.items() if not any(a <= i <= b for a, b in off))
    words = max(1, len(folded.split()))
    z = sum(c * x for c, x in zip(lexicon.scale, (1, total, total / math.sqrt(words), 100 * total / words)))
    return 1 / (1 + math.exp(-max(-50, min(50, z))))


def test_query_against_plain_scores(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in op5_toxicity(spark, folder).collect()}
    assert lexicon.weights
    for r in docs.collect():
        want = plain_score(lexicon, r.text)
        assert abs(got[r.doc_id].score - want) < 1e-9 and got[r.doc_id].predicted == (got[r.doc_id].score >= 0.5)


def test_odd_rows(spark, frame, prose, odd_rows):
    lexicon = learned(spark, frame, prose)
    rows = toxicity.rate(frame(odd_rows, clash=True), lexicon).collect()
    assert len(rows) == len(odd_rows) and all(0 <= r.score <= 1 for r in rows)
    assert toxicity.rate(frame([]), lexicon).count() == 0


def test_no_labels(spark, frame, prose):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    lexicon = toxicity.train(frame([(1, prose(20), "en", "web")]), none)
    assert lexicon.score("anything") < 0.5
    ones = spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.train(frame([(1, prose(20), "en", "web")]), ones).score("anything") < 0.5


def test_long_runs_and_many_phrases():
    """Time grows with the text: runs of signs without a letter, and a great many hits and excused phrases."""
    from time import monotonic

    import numpy as np

    from lamella.llm.toxicity import Lexicon, fold

    lexicon = Lexicon({" vile": 2.0, " foul ": 1.0}, {"vile weather", "so foul"}, np.zeros(4))
    at = monotonic()
    assert fold("0" * 300_000 + " " + "!" * 300_000 + "a") == f" {'i' * 300_000}a "
    assert lexicon.features("0" * 500_000)[0] == 0
    total, _, share = lexicon.features("vile weather foul so foul vilest " * 20_000)
    assert total == 20_000 * (1.0 + 2.0) and share == 100 * total / 120_000
    assert monotonic() - at < 30
