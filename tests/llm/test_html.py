import random

import pytest

from lamella.llm.html import extract, extract_text
from lamella.llm.queries import op2_html_text

CASES = {
    "<p>one<p>two": "one\n\ntwo",
    "<div>a</div><div>b <b>c</b></div>": "a\nb c",
    "<ul><li>one<li>two<ol><li>in<li>out</ol></ul>": None,
    "x<script>var a = '<p>no</p>';</script>y<style>p{}</style>z": "xyz",
    "<p style='display:none'>gone</p><p hidden>gone</p><p>seen</p>": "seen",
    "a&amp;b &lt;c&gt; &eacute;": "a&b <c> é",
    "<!-- no --><title>t</title>text": "text",
    "<pre>  keep\n   this</pre>": "  keep\n   this",
    "a<br>b": "a\nb",
    "": "",
    "<": "<",
    "</p></div>stray": "stray",
    "<p aria-hidden=true>icon</p>": "icon",
    "<dialog>shut</dialog><dialog open>said</dialog>": "said",
    "pick <select><option>one<option selected>two<option>three</select> now": "pick two now",
    "<select multiple><optgroup label=g><option>a<option hidden>b<option>c</select>": "g\na\nc",
    "<svg><title>t</title><desc>d</desc><text>drawn</text></svg> <math><mi>x</mi><annotation>tex</annotation></math>": "drawn\nx",
    "<ul><li><ol><li>in<li>next</ol><li><pre>a\n b</pre><li><blockquote>said</blockquote></ul>": "- 1. in\n  2. next\n\n- a\n   b\n\n-   said",
    "<object data=a.swf>no</object><object>fallback</object>": "fallback",
}


@pytest.mark.parametrize("html", CASES)
def test_cases(html):
    got = extract(html)
    if CASES[html] is not None:
        assert got.strip("\n") == CASES[html]


def test_lists_are_marked_and_nested():
    lines = extract("<ul><li>one<li>two<ol><li>in<li>out</ol></ul>").split("\n")
    text = [x for x in lines if x.strip()]
    assert [x.strip().split(" ", 1)[1] for x in text] == ["one", "two", "in", "out"]
    assert text[2].strip().startswith("1.") and text[3].strip().startswith("2.")
    assert len(text[2]) - len(text[2].lstrip()) > len(text[0]) - len(text[0].lstrip())


def test_cells_are_aligned():
    lines = [x for x in extract("<table><tr><th>name<th>n<tr><td>long name<td>1<tr><td>b<td>22</table>").split("\n") if x]
    at = [x.rindex(y) for x, y in zip(lines, ("n", "1", "22"))]
    assert len(lines) == 3 and len(set(at)) == 1


def test_spans_and_missing_tags():
    lines = [x for x in extract("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide<tr><td>d<td>e").split("\n") if x]
    assert [x.split() for x in lines] == [["a", "b"], ["c"], ["wide"], ["d", "e"]]
    assert lines[0].index("b") == lines[1].index("c") == lines[3].index("e")


def test_depth_and_length():
    assert extract("<div>" * 5000 + "deep" + "</div>" * 5000).strip() == "deep"
    assert len(extract("<p>" + "word " * 200_000)) > 900_000
    assert extract("<b>" * 3000 + "x") .strip() == "x"
    for tags in ("<blockquote>", "<ul><li>", "<dl><dd>", "<table>", "<table><tr><td>", "<table><td>", "<table><caption>", "<ul><table>", "<blockquote><table>"):
        assert extract(tags * 2000 + "x").strip("- \n") == "x"
    deep = "<div>" * 400
    assert extract(f"{deep}seen <div hidden>no<div>no</div>no</div> <span style='display:none'>no</span>seen").split() == ["seen", "seen"]


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (3, "u", "<p>x"), (3, "u", "<p>x"), (None, None, "<td>y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'q' AS text", "'q' AS lm_html")
    got = extract_text(pages).collect()
    assert sorted(map(repr, ((r.page_id, r.url, r.text) for r in got))) == sorted(map(repr, [(1, None, None), (2, "u", ""), (3, "u", "x"), (3, "u", "x"), (None, None, "y")]))
    assert extract_text(pages.limit(0)).count() == 0


def test_query_against_the_function(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r.page_id: r.text for r in op2_html_text(spark, sf_dir).collect()}
    assert got == {k: extract(v) for k, v in pages.items()}
    assert all("<script" not in (t or "") for t in got.values())


# A plain version over made trees: (tag, hidden, children) or a text; end tags are left out where they are implied.


def made(rng, depth=0):
    kids = []
    for _ in range(rng.randint(1, 4)):
        tag = rng.choice(["text", "text", "b", "p", "div", "ul", "ol", "table"] if depth < 4 else ["text", "b", "p"])
        hidden = rng.random() < 0.15
        if tag == "text":
            kids.append(rng.choice(["", " "]) + " ".join(rng.choice(["oak", "elm & ash", "fir  tree", "<yew>"]) for _ in range(rng.randint(0, 3))) + rng.choice(["", "\n "]))
        elif tag in ("b", "p"):
            kids.append((tag, hidden, [rng.choice(["one", " two ", "drei vier", ""])]))
        elif tag in ("ul", "ol"):
            kids.append((tag, hidden, [("li", rng.random() < 0.2, made(rng, depth + 1)) for _ in range(rng.randint(1, 3))]))
        elif tag == "table":
            rows = [[("td", False, [rng.choice(["", "x", "long cell", "日本"])]) for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))]
            kids.append((tag, hidden, [("tr", False, r) for r in rows]))
        else:
            kids.append((tag, hidden, made(rng, depth + 1)))
    return kids


def written(rng, kids):
    out = ""
    for k, node in enumerate(kids):
        if isinstance(node, str):
            out += node.replace("&", "&amp;").replace("<", "&lt;")
            continue
        tag, hidden, inner = node
        out += f"<{tag}{rng.choice([' hidden', ' style=\"color:red; display: none\"']) if hidden else ''}>" + written(rng, inner)
        after = kids[k + 1] if k + 1 < len(kids) else None
        implied = tag in ("li", "tr", "td") or tag == "p" and not isinstance(after, str) and (after or ("div",))[0] in ("p", "div", "ul", "ol", "table")
        if not (implied and rng.random() < 0.5):
            out += f"</{tag}>"
    return out


def plain_lines(kids, nested=False):
    """(gap before, lines, gap behind) of a flow."""
    tokens = []

    def flow(kids, nested):
        for node in kids:
            if isinstance(node, str):
                tokens.append(("text", node))
                continue
            tag, hidden, inner = node
            if hidden:
                continue
            if tag == "b":
                flow(inner, nested)
            elif tag in ("p", "div"):
                edge = ("gap" if tag == "p" else "end", None)
                tokens.append(edge)
                flow(inner, nested)
                tokens.append(edge)
            elif tag == "table":
                cells = [["".join(x) for _, _, x in r] for _, _, r in inner]
                wide = lambda t: sum(2 if ord(c) > 0x2E80 else 1 for c in t)
                widths = [max(wide(r[c]) for r in cells if c < len(r)) for c in range(max(map(len, cells)))]
                tokens.append(("gap", None))
                tokens.extend(("line", "  ".join(t + " " * (w - wide(t)) for t, w in zip(r, widths)).rstrip()) for r in cells if any(r))
                tokens.append(("gap", None))
            else:
                edge = ("end" if nested else "gap", None)
                tokens.append(edge)
                number = 0
                for _, unseen, item in inner:
                    if unseen:
                        continue
                    number += 1
                    before, lines, behind = plain_lines(item, True)
                    mark = f"{number}. " if tag == "ol" else "- "
                    tokens.append(("gap" if before else "end", None))
                    tokens.extend(("line" if x else "empty", (" " * len(mark) if k else mark) + x if x else "") for k, x in enumerate(lines))
                    tokens.append(("gap" if behind else "end", None))
                tokens.append(edge)

    flow(kids, nested)
    lines, before, due, text = [], False, False, ""

    def put(line):
        nonlocal before, due
        before |= due and not lines
        lines.extend([""] * (due and bool(lines) and lines[-1] != "") + [line])
        due = False

    for kind, value in [*tokens, ("end", None)]:
        if kind == "text":
            text += value
            continue
        if text.strip():
            put(" ".join(text.split()))
        text = ""
        if kind == "line":
            put(value)
        elif kind == "empty":
            lines.append("")
        elif kind == "gap":
            due = True
    return before or due and not lines, lines, due


def test_against_plain_version():
    for seed in range(600):
        rng = random.Random(seed)
        tree = made(rng)
        html = written(rng, tree)
        assert extract(html) == "\n".join(plain_lines(tree)[1]).strip("\n"), (seed, html)


def test_wide_tables_stay_in_proportion():
    html = "<table>" + "<tr><td rowspan=1000 colspan=1000>x" * 1000
    assert len(extract(html)) < 1_100 * 1_000
    assert len(extract("<table><tr>" + "<td>x" * 50_000)) < 200_000
    lines = extract("<table><tr><td colspan=2>a<td>b<tr><td rowspan=2>c<td>d<td>e<tr><td>f<td>g").split("\n")
    assert [x.split() for x in lines] == [["a", "b"], ["c", "d", "e"], ["f", "g"]]
    assert lines[1].index("d") == lines[2].index("f") and lines[0].index("b") == lines[1].index("e") == lines[2].index("g")
