"""Page-local operators against brute-force versions."""

import time
from itertools import combinations

import numpy as np
import pandas as pd
import pytest

from lamella import catalog
from lamella.operators import pages as P

rng = np.random.default_rng(1)


def some_boxes(n, seed=0, size=40):
    r = np.random.default_rng(seed)
    at = r.integers(0, 200, (n, 2)).astype(float)
    return np.c_[at, at + r.integers(4, size, (n, 2))]


def common(a, b):
    return max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))


def size(a):
    return max(0.0, a[2] - a[0]) * max(0.0, a[3] - a[1])


def test_measures():
    a, b = some_boxes(30, 1), some_boxes(20, 2)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            assert P.intersections(a, b)[i, j] == common(x, y)
            assert P.shares(a, b)[i, j] == pytest.approx(common(x, y) / size(x))
            assert P.ious(a, b)[i, j] == pytest.approx(common(x, y) / (size(x) + size(y) - common(x, y)))


@pytest.mark.parametrize("seed", range(5))
def test_grow_free(seed):
    boxes, fixed = some_boxes(40, seed), some_boxes(5, seed + 50)
    kept, want = [tuple(f) for f in fixed], []
    for i, b in enumerate(boxes):
        if not any(common(b, k) / size(b) >= 0.4 or common(k, b) / size(k) >= 0.4 for k in kept):
            kept.append(tuple(b))
            want.append(i)
    assert P.grow_free(boxes, fixed, P.heavy_overlap(0.4, both=True)) == want
    assert P.grow_free(boxes[:0], fixed, P.heavy_overlap(0.4)) == []


@pytest.mark.parametrize("seed", range(4))
def test_components(seed):
    b = some_boxes(40, seed, 12)
    of = list(range(len(b)))
    for _ in of:
        for i, j in combinations(range(len(b)), 2):
            if b[i][0] - 5 <= b[j][2] and b[j][0] <= b[i][2] + 5 and b[i][1] - 5 <= b[j][3] and b[j][1] <= b[i][3] + 5:
                of[i] = of[j] = min(of[i], of[j])
    assert P.box_components(b, 5).tolist() == of
    assert P.box_components(b[:0], 5).tolist() == []


def test_greedy_pairs_prefer_larger_places_on_ties():
    assert P.greedy_pairs(np.array([[0.5, 0.5], [0.5, 0.4]]), 0.35) == [(1, 0), (0, 1)]
    assert P.greedy_pairs(np.array([[0.9, 0.1], [0.8, 0.5]]), 0.35) == [(0, 0), (1, 1)]
    assert P.greedy_pairs(np.zeros((0, 3)), 0.1) == []


def test_first_come_pairs():
    assert P.first_come_pairs(np.array([[0.3, 0.3], [0.9, 0.2], [0.1, 0.3]]), 0.25) == [(0, 0), (2, 1)]


def test_grouping_scores():
    wanted = np.array([[0, 0, 100, 10], [0, 10, 100, 20], [0, 40, 100, 60]], float)
    found = np.array([[0, 0, 100, 20], [0, 40, 100, 50], [0, 50, 100, 60]], float)
    s = P.grouping_scores(found, wanted, np.array([True, False, False]), np.array([True, True, False]))
    assert (s["merges"], s["splits"]) == (1, 1)
    assert (s["list_precision"], s["list_recall"]) == (1.0, 0.5)
    assert P.grouping_scores(found, wanted[:0], np.zeros(3, bool), np.zeros(0, bool))["ratio"] == -1.0


def test_line_groups():
    row = [[0, 0, 30, 10], [33, 1, 60, 11], [120, 0, 150, 10], [0, 20, 40, 30], [38, 20, 70, 30], [34, 4, 35, 5]]
    g = P.line_groups(np.array(row, float)).tolist()
    assert g[0] == g[1] == g[5] and g[2] != g[0] and g[3] == g[4] != g[0]
    assert P.line_groups(np.zeros((0, 4))).tolist() == []


def test_paragraphs_skip_what_is_between():
    b = np.array([[0, 0, 100, 10], [300, 4, 400, 14], [0, 12, 100, 22], [0, 24, 90, 34], [0, 200, 100, 210]], float)
    region, labels = P.paragraph_regions(b, ["text"] * 5, np.zeros(5, bool), 960.0)
    assert region.tolist() == [0, 1, 0, 0, 2] and labels == ["text"] * 3
    region, labels = P.paragraph_regions(b, ["title", "text", "text", "list", "text"], np.array([0, 0, 0, 1, 0], bool), 960.0)
    assert region.tolist() == [0, 1, 2, 2, 3] and labels[2] == "list"


def table_words(rows=5, skip=()):
    words, text = [], []
    for r in range(rows):
        for c, x in enumerate((50, 150, 260)):
            if (r, c) not in skip:
                words.append([x, 100 + 20 * r, x + 30 + 3 * r, 110 + 20 * r])
                text.append(f"r{r}c{c}")
    return np.array(words, float), text


def test_grid_of_a_table():
    b, text = table_words(skip={(2, 1)})
    grids = P.text_grids(b, text)
    assert len(grids) == 1
    g = grids[0]
    assert (g.low.shape, g.aligns) == ((5, 3), ["left"] * 3)
    assert g.texts[2] == ["r2c0", "", "r2c2"] and g.filled == 14
    assert g.box[:2].tolist() == [46.0, 98.0] and g.widths.sum() == pytest.approx(g.box[2] - g.box[0])


def test_no_grid_in_a_paragraph():
    b = np.array([[10 + 32 * i, 20 * r, 40 + 32 * i, 20 * r + 10] for r in range(6) for i in range(8)], float)
    assert P.text_grids(b, ["w"] * len(b)) == []
    assert P.text_grids(b[:0], []) == []


def test_title_row_is_trimmed_or_kept_out():
    b, text = table_words()
    b, text = np.r_[[[50.0, 70.0, 300.0, 82.0]], b], ["A title over it", *text]
    g = P.text_grids(b, text)[0]
    assert g.low.shape == (5, 3)


def test_nms_keeps_the_fuller_grid():
    b, text = table_words()
    full = P.text_grids(b, text)[0]
    b2, text2 = table_words(skip={(1, 1)})
    less = P.text_grids(b2, text2)[0]
    assert P.distinct_grids([less, full]) == [full]


def test_snapping_keeps_order_and_box():
    b, text = table_words()
    g = P.text_grids(b, text)[0]
    wide = P.snap_columns(g, np.array([20.0, 90.0, 400.0, 220.0]))
    assert wide.widths.sum() == pytest.approx(380.0) and (wide.widths >= 1).all()
    g.aligns[0] = "center"
    left = P.snap_columns(g, np.array([20.0, 90.0, 400.0, 220.0]))
    mid = np.median((g.low[:, 0] + g.high[:, 0]) / 2)
    assert 20 + left.widths[0] / 2 == pytest.approx(mid)


def test_zebra_and_inferred_tables():
    b, text = table_words()
    bands = np.array([[40, 95 + 20 * r, 320, 115 + 20 * r] for r in range(5)], float)
    fills = ["#FFFFFF", "#EEEEEE"] * 2 + ["#FFFFFF"]
    z = P.zebra_grids([(bands, fills)], b, text)
    assert len(z) == 1 and z[0].fills == fills and z[0].box.tolist() == [40.0, 95.0, 320.0, 195.0]
    found = P.inferred_tables(b, text, [(bands, fills)], np.empty((0, 4)))
    assert len(found) == 1 and found[0].fills
    assert P.inferred_tables(b, text, [(bands, fills)], np.array([[40.0, 95.0, 320.0, 195.0]])) == []


def test_unique_names():
    assert P.unique_names(["a/x.pdf", "a/X.PDF", "a/x__2.pdf", "a/x.pdf", "noext", "NOEXT"]) == ["a/x.pdf", "a/X__2.PDF", "a/x__2__2.pdf", "a/x__3.pdf", "noext", "NOEXT__2"]


def test_names_of_one_family_share_a_group(spark):
    rows = list(enumerate(["x.pdf", "X.pdf", "x__2.pdf", "y.pdf", "x.pdf"]))
    got = P.deck_names(spark.createDataFrame(rows, "id long, path string"))
    assert [r.output for r in sorted(got.collect())] == P.unique_names([p for _, p in rows])


def test_many_equal_names_take_a_pass():
    n = 20_000
    names = [f"a/x.{('pdf', 'PDF')[k % 2]}" for k in range(n)] + ["a/x__3.pdf"]
    began = time.perf_counter()
    got = P.unique_names(names)
    assert time.perf_counter() - began < 5  # by counting from 2 each time 200,000,000 names are tried
    assert got[:3] == ["a/x.pdf", "a/x__2.PDF", "a/x__3.pdf"] and got[n - 1] == f"a/x__{n}.PDF" and got[n] == "a/x__3__2.pdf"
    assert len({g.lower() for g in got}) == n + 1


def test_text_score():
    assert [P.text_score(a, b) for a, b in (("A b", "ab"), ("xaby", "AB"), ("", "ab"), ("q", "ab"), ("q", ""))] == [1.0, 0.85, 0.85, 0.0, 0.0]


def plain_line_groups(b):
    """Runs of text on lines, step by step."""
    n, height, width = len(b), [x[3] - x[1] for x in b], [x[2] - x[0] for x in b]
    if n < 2:
        return [0] * n
    mid = float(np.median([max(h, 1.0) for h in height]))
    small = [max(h, 1.0) < 0.25 * mid or (max(h, 1.0) < 0.4 * mid and max(w, 1.0) < 0.4 * mid) for h, w in zip(height, width)]
    if all(small):
        small = [False] * n
    over = lambda x, y: max(0.0, min(x[3], y[3]) - max(x[1], y[1]))

    def mates(x, y):
        least = min(x[3] - x[1], y[3] - y[1], 1.0)
        return over(x, y) > 0 and abs(x[1] + x[3] - y[1] - y[3]) / 2 <= 0.75 * mid and over(x, y) >= 0.3 * least

    lines = []
    for i in sorted((i for i in range(n) if not small[i]), key=lambda i: ((b[i][1] + b[i][3]) / 2, b[i][0], i)):
        home = [line for line in lines if any(mates(b[i], b[k]) for k in line)]
        (home[0] if home else lines.append([]) or lines[-1]).append(i)
    for i in range(n):
        if small[i]:
            best = max(lines, key=lambda line: max(over(b[i], b[k]) for k in line), default=None)
            if best is not None and max(over(b[i], b[k]) for k in best) > 0:
                best.append(i)
            else:
                lines.append([i])
    out, runs = [None] * n, -1
    for line in lines:
        run = None
        for i in sorted(line, key=lambda i: b[i][0]):
            x = b[i]
            gap = None if run is None else x[0] - run[2]
            if run is not None and gap <= 1.25 * mid and (gap <= max(0.0, 0.35 * mid) or (run[2] > x[0] and x[2] > run[0])) and mates(run, x):
                run = [min(run[0], x[0]), min(run[1], x[1]), max(run[2], x[2]), max(run[3], x[3])]
            else:
                runs, run = runs + 1, list(x)
            out[i] = runs
    return out


@pytest.mark.parametrize("seed", range(6))
def test_line_groups_against_plain_steps(seed):
    b = some_boxes(60, seed, 30)
    b[::7, 2:] = b[::7, :2] + 2
    assert P.line_groups(b).tolist() == plain_line_groups(b.tolist())


def test_ocr_lines_query_against_plain_version(spark, sf_dir):
    from lamella.plans.registry import QUERIES
    from lamella.sources.views import Views

    rows = [r for r in Views(spark, sf_dir).blocks.where("source = 'ocr'").orderBy("page", "id").collect()]
    wanted = {}
    for page in sorted({r.page for r in rows}):
        own = [r for r in rows if r.page == page]
        for r, g in zip(own, plain_line_groups([[r.x0, r.y0, r.x1, r.y1] for r in own])):
            wanted.setdefault((page, g), []).append(r)
    got = {(r.page, r.run): r for r in QUERIES["page_ocr_lines"](spark, sf_dir).collect()}
    assert set(got) == set(wanted)
    for k, of in wanted.items():
        weight = sum(len(r.text) for r in of)
        assert (got[k].x0, got[k].y0, got[k].x1, got[k].y1) == (min(r.x0 for r in of), min(r.y0 for r in of), max(r.x1 for r in of), max(r.y1 for r in of))
        assert got[k].confidence == pytest.approx(sum(r.confidence * len(r.text) for r in of) / max(1, weight), abs=1e-6)
        assert "".join(got[k].text.split()) == "".join("".join(r.text.split()) for r in sorted(of, key=lambda r: (r.x0, r.id)))


def test_texts_are_folded_once(monkeypatch):
    calls = []

    class Blank:
        def sub(self, to, text):
            calls.append(text)
            return text.replace(" ", to)

    monkeypatch.setattr(P, "_blank", Blank())
    found, wanted = (pd.DataFrame({"text": texts, "role": "body", "reading_order": 1, **dict(zip(P.BOX, (0.0, 0.0, 9.0, 9.0)))}) for texts in (["A b", "c", None], ["ab", "xabc", "", "q"]))
    assert P.acceptance(found, wanted)["n_pairs"] == 3
    assert len(calls) == len(found) + len(wanted)
    assert P.text_scores([], ["a"]).shape == (0, 1) and P.text_scores(["A b", None], ["ab", "xabc", ""]).tolist() == [[1.0, 0.85, 0.0], [0.85, 0.85, 0.0]]


def test_pairs_of_grouping_errors_are_joined_once(spark, sf_dir):
    plan = catalog.queries()["join_grouping_errors"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 1
