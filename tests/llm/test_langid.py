import zlib

from pyspark.sql import functions as F

from lamella.llm.langid import Scorer, fit, held_out, identify, mark, predict, train
from lamella.llm.queries import op8_language_id


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = op8_language_id(spark, folder)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    judged = [r for r in rows if r.held_out and docs[r.doc_id].lang and any(c.isalpha() for c in docs[r.doc_id].text or "")]
    assert len(judged) > 100
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in judged) / len(judged) > 0.97


def languages(n):
    parts = {"xx": "sha lomi wento karu bel asti", "yy": "ščo žaby říkat pyv ďobe žlun", "zz": "οδος λεω μιαν τηνα κατω"}
    return [(2000 + 100 * k + i, " ".join(p.split()[(i + j) % len(p.split())] for j in range(12)), lang, "web") for k, (lang, p) in enumerate(parts.items()) for i in range(n)]


def test_odd_rows(frame, odd_rows):
    rows = languages(30) + [(*r, "en" if r[1] else None) for r in odd_rows] + [(900, "123 ... 456", "xx")]
    got = identify(frame(rows, clash=True)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[1].lang_pred == by[2].lang_pred == by[900].lang_pred == "und" and by[1].score == 0
    right = [by[i].lang_pred == lang for i, _, lang, _ in languages(30)]
    assert all(right)


def test_ids_and_labels_do_not_enter_a_prediction(frame):
    model = train(frame(languages(30)))
    one = {r.lm_key: tuple(r)[1:] for r in predict(frame(languages(30)).withColumn("lm_key", F.col("text")), model, ["lm_key"]).collect()}
    other = frame(languages(30)).withColumn("doc_id", F.col("doc_id") + 7777).withColumn("lang", F.lit(None).cast("string")).withColumn("lm_key", F.col("text"))
    assert one == {r.lm_key: tuple(r)[1:] for r in predict(other, model, ["lm_key"]).collect()}


def test_nothing_to_learn_from(frame):
    assert train(frame([])) is None
    assert identify(frame([])).count() == 0
    got = identify(frame([(1, "abc", None), (2, None, None)])).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_long_texts_count_by_length():
    import numpy as np

    rows = languages(30)
    bits = np.zeros((len(rows), 1 << 15), np.uint8)
    for k, r in enumerate(rows):
        mark(r[1], bits[k])
    score = Scorer(fit(bits, [r[2] for r in rows]))
    one, other = rows[0][1] + " ", rows[40][1] + " "
    langs, _ = score([one * 900 + other * 50, other * 900 + one * 50, None])
    assert langs == ["xx", "yy", "und"]


def plain_bits(piece):
    """Places of the n-grams of a piece, and whether it has a letter."""
    m = (1 << 32) - 1
    c = [ord(x) if x.isalpha() else 32 for x in piece.lower()]

    def mixed(h):
        h = (h ^ h >> 15) * 0x2C1B3C6D & m
        return ((h ^ h >> 13) * 0x297A2D39 & m) >> 17

    one = {x * 2654435761 % (1 << 32) >> 17 for x in c}
    two = {mixed((x * 0x85EBCA6B + y * 0xC2B2AE35 + 1) & m) for x, y in zip(c, c[1:])}
    three = {mixed((x * 0x27D4EB2F + y * 0x165667B1 + z * 0x9E3779B1 + 2) & m) for x, y, z in zip(c, c[1:], c[2:])}
    return one | two | three, any(x.isalpha() for x in piece.lower())


def test_query_against_plain_scores(spark, sf_dir):
    """The fitted model, applied text by text in plain Python."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    weights = model.weights.astype(float)
    got = {r.doc_id: r for r in op8_language_id(spark, sf_dir).collect()}
    for r in docs.collect():
        total, length = [0.0] * len(model.labels), 0
        for at in range(0, len(r.text or ""), 1024):
            piece = r.text[at : at + 1024]
            bits, letter = plain_bits(piece)
            if letter:
                length += len(piece)
                total = [t + len(piece) * sum(weights[b, k] for b in bits) / len(bits) ** 0.5 for k, t in enumerate(total)]
        if not length:
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        best = max(total)
        assert got[r.doc_id].lang_pred == model.labels[total.index(best)] or sorted(total)[-2] > best - 1e-3 * length
        assert abs(got[r.doc_id].score - min(1, max(0, (best / length + 1) / 2))) < 1e-4


def test_long_texts_teach_a_piece():
    from lamella.llm.langid import PIECE, chosen_piece

    text = "".join(chr(97 + k % 26) for k in range(10 * PIECE + 5))
    assert {chosen_piece(text, h) for h in range(-50, 50)} == {text[k * PIECE : (k + 1) * PIECE] for k in range(11)}
    assert chosen_piece("", 7) == ""


def test_more_labels_than_the_sample(frame):
    rows = [(i, f"wort {i}", f"l{i}", "web") for i in range(30)] + [(100 + i, "many of one", "l3", "web") for i in range(4)]
    model = train(frame(rows), sample=5)
    assert len(model.labels) == 5 and "l3" in model.labels
