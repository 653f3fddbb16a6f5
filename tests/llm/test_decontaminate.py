import hashlib
import re

from lamella.llm.decontaminate import benchmark_hits, decontaminate
from lamella.llm.queries import op4_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items, window=10):
    windows = {}
    for item, text in items:
        w = words_of(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows.setdefault(n, {}).setdefault(tuple(w[i : i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w = words_of(text)
        hit, found = set(), set()
        for n, known in windows.items():
            for i in range(len(w) - n + 1):
                if own := known.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= own
        ids = ",".join(sorted(map(str, found)))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return out


def test_query_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    got = op4_decontamination(spark, sf_dir)
    assert got.columns == ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert sorted(map(tuple, got.collect())) == sorted(plain(docs, items))
    assert any(r[5] for r in plain(docs, items))


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_blocks_of_items_agree(spark, frame, prose):
    items = [(i, prose(25, 200 + i)) for i in range(9)] + [(10, "two words"), (11, None), (12, " - "), (2, prose(25, 202))]
    docs = [(i, prose(30, i) + " " + " ".join(prose(25, 200 + i).split()[3 : 3 + i * 2]) + " and two WORDS.") for i in range(12)]
    one = benchmark_hits(frame(docs), bench(spark, items))
    many = benchmark_hits(frame(docs), bench(spark, items), block_words=30)
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))
    got = {r.doc_id: (sum(h.end - h.start for h in r.hits), len(r.items)) for r in one.collect()}
    assert got == {d: (h, n) for d, _, h, n, _, _ in plain(docs, items)}


def test_removal(spark, frame, prose):
    passage = prose(40, 300)
    clean = prose(100, 1)
    docs = [(1, f"{clean}\n{passage}\n{clean}"), (2, passage), (3, clean), (4, None), (5, ""), (6, "Ünïcode — text, kept!")]
    got = {r.doc_id: r for r in decontaminate(frame(docs, clash=True), bench(spark, [(1, passage)])).collect()}
    assert set(got) == {1, 3, 4, 5, 6}
    assert got[1].text == f"{clean}\n\n{clean}" and got[1].n_chars == len(got[1].text)
    assert got[3].text == clean and got[6].text == docs[5][1] and got[4].text is None
    assert decontaminate(frame(docs, clash=True), bench(spark, [])).columns == frame(docs, clash=True).columns


def test_odd_rows(spark, frame, odd_rows):
    df = frame(odd_rows, clash=True)
    items = [(1, None), (2, "a b"), (2, "a b"), (3, "")]
    rows = benchmark_hits(df, bench(spark, items)).collect()
    assert len(rows) == len(odd_rows)
    assert sum(bool(r["items"]) for r in rows) == 4
    assert benchmark_hits(df, bench(spark, [])).where("size(hits) > 0").count() == 0
    assert benchmark_hits(frame([]), bench(spark, items)).count() == 0
    assert decontaminate(df, bench(spark, items)).count() == len(odd_rows) - 4
