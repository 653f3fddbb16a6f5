import re

from lamella.llm.linededup import line_dedup
from lamella.llm.queries import op7_line_dedup


def plain(docs, min_words=1):
    """By (row number): (doc_id, text left, removed spans)."""
    lines = []
    for n, (doc, text) in enumerate(docs):
        if doc is None or text is None:
            continue
        at = 0
        for k, line in enumerate(text.split("\n") if text else []):
            words = line.lower().split()
            if len(words) >= min_words:
                lines.append((" ".join(words), doc, k, n, at, at + len(line)))
            at += len(line) + 1
    first = {}
    for form, doc, k, *_ in lines:
        first[form] = min(first.get(form, (doc, k)), (doc, k))
    out = {n: (doc, text, []) for n, (doc, text) in enumerate(docs)}
    gone = {}
    for form, doc, k, n, a, b in lines:
        if first[form] != (doc, k):
            gone.setdefault(n, []).append((k, a, b))
    for n, cut in gone.items():
        doc, text, _ = out[n]
        dropped = {k for k, _, _ in cut}
        out[n] = (doc, "\n".join(x for k, x in enumerate(text.split("\n")) if k not in dropped), [(a, b) for _, a, b in sorted(cut)])
    return list(out.values())


def results(df):
    return sorted(((r.doc_id, r.text, [(s.start, s.end) for s in r.removed]) for r in df.collect()), key=repr)


def test_query_against_brute_force(spark, sf_dir):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = [(d, t, ",".join(f"{a}-{b}" for a, b in cut)) for d, t, cut in plain(docs)]
    assert sorted(((r.doc_id, r.text, r.removed) for r in op7_line_dedup(spark, sf_dir).collect()), key=repr) == sorted(want, key=repr)


def test_ties_repeats_and_offsets(frame):
    docs = [(2, "One two three four five\nonly here in two, you know\n one TWO  three four five "), (1, "x\none two three four five"), (3, "one two three four five"), (4, "short line\nshort line")]
    got = results(line_dedup(frame(docs, clash=True)))
    assert got == sorted(plain(docs), key=repr)
    assert [r for r in got if r[0] == 3] == [(3, "", [(0, 23)])]


def test_paragraphs(frame):
    a, b = "first line of a paragraph\nand its second line", "another paragraph with enough words"
    got = {r.doc_id: r for r in line_dedup(frame([(1, f"{a}\n\n{b}"), (2, f"{b}\n\n \n{a}\n\nend of it, all of it")]), unit="paragraph").collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 2 and got[2].text == "end of it, all of it"


def test_odd_rows(frame, odd_rows):
    rows = line_dedup(frame(odd_rows, clash=True)).collect()
    assert len(rows) == len(odd_rows)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[1].text is None and by[5].text == "" and len(by[4].text) > 100_000
    assert line_dedup(frame([])).count() == 0


def test_newlines_within_words_are_kept(frame):
    text = "a\n\n\nb\r\nc" * 3
    assert line_dedup(frame([(1, text)]), min_words=5).first().text == text and re.search("\r", text)


def test_short_lines_and_scripts_without_blanks(frame):
    docs = [(1, "All rights reserved.\n这是一个重复的段落"), (2, "all  RIGHTS reserved.\n这是一个重复的段落\n\n\nown"), (3, "\n \n")]
    got = results(line_dedup(frame(docs)))
    assert got == sorted(plain(docs), key=repr) and got[1] == (2, "\n\nown", [(0, 21), (22, 31)]) and got[2][1] == "\n \n"
    assert all(r.n_removed == 0 for r in line_dedup(frame(docs), min_words=5).collect())
