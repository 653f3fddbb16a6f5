"""Page-local operators whose decisions depend on earlier decisions.

Each is a function of the arrays of one page, run as a grouped map: a page is
a bounded unit, and no state passes from page to page. Boxes are rows of
(x0, y0, x1, y1).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOX = ["x0", "y0", "x1", "y1"]


def boxes(pdf: pd.DataFrame) -> np.ndarray:
    return pdf[BOX].to_numpy(float).reshape(-1, 4)


#: Pages that go to Python together, as a call for each page costs more than most pages' work.
PAGES = 32


def _together(frames: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat([f for f in frames if len(f)] or frames[:1], ignore_index=True)


def by_page(df: DataFrame, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """work(page's rows) for each page, with the page as a column of what it returns."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _together([work(g).assign(page=p) for p, g in pdf.groupby("page", dropna=False)])

    return by_block(df, run, schema)


def by_block(df: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """run(the rows of a block of pages), which gives the page as a column too."""
    return df.groupBy(F.floor(F.col("page") / PAGES)).applyInPandas(run, f"{schema}, page long")


def by_page_pair(left: DataFrame, right: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """The same with the page's rows of two frames, of which one may have none."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        of_a, of_b = (dict(list(x.groupby("page", dropna=False))) for x in (a, b))
        return _together([work(of_a.get(p, a.iloc[:0]), of_b.get(p, b.iloc[:0])).assign(page=p) for p in sorted({*of_a, *of_b})])

    right = right.toDF(*right.columns)  # new columns, as both sides may come from one frame
    block = F.floor(F.col("page") / PAGES)
    return left.groupBy(block).cogroup(right.groupBy(block)).applyInPandas(run, f"{schema}, page long")


# ------------------------------------------------------------------ boxes


def intersections(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common area of each box of a with each of b."""
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    return np.clip(high - low, 0, None).prod(axis=2)


def areas(a: np.ndarray) -> np.ndarray:
    return np.clip(a[:, 2:] - a[:, :2], 0, None).prod(axis=1)


def shares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of each box of a that each of b covers."""
    own = areas(a)[:, None]
    return np.where(own > 0, intersections(a, b) / np.where(own > 0, own, 1), 0.0)


def ious(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    common = intersections(a, b)
    joint = areas(a)[:, None] + areas(b)[None, :] - common
    return np.where(common > 0, common / np.where(joint > 0, joint, 1), 0.0)


def grow_free(candidates: np.ndarray, fixed: np.ndarray, conflict: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[int]:
    """Places of the candidates kept, in order: each meets no fixed box and none kept before it."""
    barred = conflict(candidates, fixed).any(axis=1) if len(fixed) else np.zeros(len(candidates), bool)
    among = conflict(candidates, candidates) if len(candidates) else np.zeros((0, 0), bool)
    kept: list[int] = []
    for i in range(len(candidates)):
        if not barred[i]:
            kept.append(i)
            barred |= among[:, i]
    return kept


def heavy_overlap(ratio: float, both: bool = False):
    """Conflict test: a box of the first covered by one of the second to `ratio` (or the other way round)."""

    def test(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (shares(a, b) >= ratio) | ((shares(b, a).T >= ratio) if both else False)

    return test


def box_components(b: np.ndarray, gap: float) -> np.ndarray:
    """For each box the smallest place in its component of boxes within `gap` of one another."""
    n = len(b)
    near = (b[:, None, 0] - gap <= b[None, :, 2]) & (b[None, :, 0] <= b[:, None, 2] + gap) & (b[:, None, 1] - gap <= b[None, :, 3]) & (b[None, :, 1] <= b[:, None, 3] + gap)
    label = np.arange(n)
    while n:
        least = np.where(near, label[None, :], n).min(axis=1)
        least = least[least]
        if (least == label).all():
            break
        label = least
    return label


# ------------------------------------------------------------------ matching


def greedy_pairs(score: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """One-to-one pairs, best score first; of equals the larger places first."""
    i, j = np.nonzero(score >= threshold)
    order = np.lexsort((-j, -i, -score[i, j]))
    pairs: list[tuple[int, int]] = []
    free_i, free_j = np.ones(score.shape[0], bool), np.ones(score.shape[1], bool)
    for k in order:
        if free_i[i[k]] and free_j[j[k]]:
            free_i[i[k]] = free_j[j[k]] = False
            pairs.append((int(i[k]), int(j[k])))
    return pairs


def first_come_pairs(score: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """Each row in turn takes its best free column, the first of equals, if that reaches the threshold."""
    left = score.astype(float).copy()
    pairs: list[tuple[int, int]] = []
    for i in range(left.shape[0]):
        if left.shape[1] and left[i].max() > 0 and left[i].max() >= threshold:
            j = int(left[i].argmax())
            pairs.append((i, j))
            left[:, j] = -1
    return pairs


def grouping_scores(found: np.ndarray, wanted: np.ndarray, found_list: np.ndarray, wanted_list: np.ndarray, threshold: float = 0.35) -> dict:
    """How well found boxes match wanted ones: pairs, merges, splits, list items."""
    n, m = len(found), len(wanted)
    score = ious(found, wanted)
    pairs = greedy_pairs(score, threshold)
    common = intersections(found, wanted)
    covers = common / np.maximum(areas(wanted), 1.0)[None, :] >= 0.5
    inside = common / np.maximum(areas(found), 1.0)[:, None] >= 0.5
    a, b = found[found_list], wanted[wanted_list]
    p = r = f = None
    if len(a) or len(b):
        hits = len(first_come_pairs(np.maximum(ious(a, b), 0.9 * intersections(a, b) / np.maximum(areas(b), 1.0)[None, :]), 0.25))
        p = hits / len(a) if len(a) else 0.0
        r = hits / len(b) if len(b) else 0.0
        f = 0.0 if p + r <= 0 else 2 * p * r / (p + r)
    return {
        "n_found": n, "n_wanted": m, "ratio": round(n / m, 6) if m else (0.0 if n == 0 else -1.0), "mean_iou": round(float(np.mean([score[x] for x in pairs])), 6) if pairs else 0.0,
        "merges": int((covers.sum(axis=1) >= 2).sum()), "splits": int((inside.sum(axis=0) >= 2).sum()), "unmatched_found": n - len(pairs), "unmatched_wanted": m - len(pairs),
        "list_precision": p, "list_recall": r, "list_f1": f,
    }


GROUPING_SCHEMA = "n_found int, n_wanted int, ratio double, mean_iou double, merges int, splits int, unmatched_found int, unmatched_wanted int, list_precision double, list_recall double, list_f1 double"
_blank = re.compile(r"\s+")


def text_score(found: str, wanted: str) -> float:
    return float(text_scores([found], [wanted])[0, 0])


def text_scores(found: list[str], wanted: list[str]) -> np.ndarray:
    """The score of each found text for each wanted one, which are folded once and not for each pair."""
    a, b = ([_blank.sub("", x or "").lower() for x in texts] for texts in (found, wanted))
    return np.array([[0.0 if not y else 1.0 if x == y else 0.85 if x in y or y in x else 0.0 for y in b] for x in a]).reshape(len(a), len(b))


def acceptance(found: pd.DataFrame, wanted: pd.DataFrame) -> dict:
    """Scores of a plan: titles, margin texts that are gone, and order of what was matched."""
    margin = wanted["role"].isin(["header", "footer", "page_number"]).to_numpy()
    a, b = boxes(found), boxes(wanted)
    text = text_scores(found["text"].tolist(), wanted["text"].tolist())
    place = ious(a, b)
    over = np.maximum(place, intersections(a, b) / np.maximum(areas(b), 1.0)[None, :])
    still = ((text >= 0.85) | ((text >= 0.5) & (over >= 0.15)) | (over >= 0.5)).any(axis=0) if len(found) else np.zeros(len(wanted), bool)
    body = np.flatnonzero(~margin)
    pairs = first_come_pairs(np.maximum(text, 0.9 * place)[:, body].T, 0.35)
    order = found["reading_order"].to_numpy()[[j for _, j in pairs]]
    left, right = np.triu_indices(len(pairs), 1)
    right_way = int((order[left] <= order[right]).sum())
    expected, seen = bool((wanted["role"] == "title").any()), bool((found["role"] == "title").any())
    return {
        "title_accuracy": float(seen == expected), "n_margin": int(margin.sum()), "n_filtered": int((margin & ~still).sum()), "filter_rate": round(float((~still[margin]).mean()), 6) if margin.any() else None,
        "n_pairs": len(left), "order_score": round(right_way / len(left), 6) if len(left) else None,
    }


ACCEPTANCE_SCHEMA = "title_accuracy double, n_margin int, n_filtered int, filter_rate double, n_pairs int, order_score double"


# ------------------------------------------------------------------ lines and regions


def _overlaps(b: np.ndarray) -> np.ndarray:
    """Common height of each two boxes."""
    return np.clip(np.minimum(b[:, None, 3], b[None, :, 3]) - np.maximum(b[:, None, 1], b[None, :, 1]), 0, None)


def _on_line(a: list, b: list, centre_gap: float) -> bool:
    """Whether two boxes stand on a line. The 1 in the divisor is as in functions.rules.same_line."""
    over = min(a[3], b[3]) - max(a[1], b[1])
    least = min(a[3] - a[1], b[3] - b[1], 1.0)
    return over > 0 and abs(a[1] + a[3] - b[1] - b[3]) / 2 <= centre_gap and over >= 0.3 * least


def line_groups(b: np.ndarray) -> np.ndarray:
    """Number of the text run of each box: boxes on a line without a wide gap are one run."""
    n = len(b)
    group = np.zeros(n, np.int64)
    if n <= 1:
        return group
    size = np.maximum(b[:, 2:] - b[:, :2], 1.0)
    mid = float(np.median(size[:, 1]))
    small = (size[:, 1] < 0.25 * mid) | ((size < 0.4 * mid).all(axis=1))
    if small.all():
        small[:] = False
    height, over, rows = b[:, 3] - b[:, 1], _overlaps(b), b.tolist()
    twice = b[:, 1] + b[:, 3]
    on = (over > 0) & (np.abs(twice[:, None] - twice[None, :]) / 2 <= 0.75 * mid) & (over >= 0.3 * np.minimum(np.minimum(height[:, None], height[None, :]), 1.0))
    mates = [sum(1 << int(j) for j in np.flatnonzero(r)) for r in on]  # a set of boxes is a whole number
    lines: list[list[int]] = []
    members: list[int] = []
    for i in sorted(np.flatnonzero(~small).tolist(), key=lambda i: (twice[i] / 2, rows[i][0])):
        home = next((k for k, m in enumerate(members) if m & mates[i]), None)
        if home is None:
            home = len(lines)
            lines.append([])
            members.append(0)
        lines[home].append(i)
        members[home] |= 1 << i
    for i in np.flatnonzero(small).tolist():
        most = [float(over[i, line].max()) for line in lines]
        best = int(np.argmax(most)) if most else -1
        lines[best].append(i) if most and most[best] > 0 else lines.append([i])
    at = -1
    for line in lines:
        extent = None
        for i in sorted(line, key=lambda i: rows[i][0]):
            box, joins = rows[i], False
            if extent is not None:
                free = box[0] - extent[2]
                close = free <= max(0.0, 0.35 * mid) or (extent[2] > box[0] and box[2] > extent[0])
                joins = free <= 1.25 * mid and close and _on_line(extent, box, 0.75 * mid)
            if joins:
                extent = [min(extent[0], box[0]), min(extent[1], box[1]), max(extent[2], box[2]), max(extent[3], box[3])]
            else:
                at, extent = at + 1, box
            group[i] = at
    return group


def paragraph_regions(b: np.ndarray, labels: list[str], is_list: np.ndarray, page_w: float) -> tuple[np.ndarray, list[str]]:
    """(region of each box, label of each region). Boxes come in reading order.

    A text, list or caption takes up each later box that goes on from its last
    member; boxes in between may belong elsewhere.
    """
    text_like = {"text", "list", "caption"}
    region, out, rows, is_list = [-1] * len(b), [], b.tolist(), is_list.tolist()
    for i in range(len(rows)):
        if region[i] >= 0:
            continue
        number, label, last = len(out), labels[i], i
        region[i] = number
        listed = is_list[i]
        for j in range(i + 1, len(rows)) if label in text_like else ():
            if region[j] >= 0 or labels[j] not in text_like or not _goes_on(rows[last], rows[j], is_list[j], page_w):
                continue
            if label == "list" and labels[j] != "list" and not is_list[j]:
                continue
            label = "list" if labels[j] == "list" else label
            region[j], last = number, j
            listed = listed or is_list[j]
        out.append("list" if listed else label)
    return np.array(region, np.int64), out


def _goes_on(a: list, b: list, is_list: bool, page_w: float) -> bool:
    """functions.rules.joins_paragraph for one pair."""
    ha, hb = a[3] - a[1], b[3] - b[1]
    over = max(0.0, min(a[3], b[3]) - max(a[1], b[1])) / max(1.0, min(ha, hb))
    if over >= 0.45:
        return b[0] - a[2] <= min(0.08 * page_w, 0.6 * (ha + hb) / 2)
    return -0.2 * hb <= b[1] - a[3] <= 1.35 * hb and abs(a[0] + a[2] - b[0] - b[2]) / 2 <= 0.18 * page_w and (abs(a[0] - b[0]) <= 0.12 * page_w or is_list)


# ------------------------------------------------------------------ grids


@dataclass
class Grid:
    """A table inferred from words: text extents and texts by row and column, and edges."""

    box: np.ndarray
    low: np.ndarray
    high: np.ndarray
    texts: list[list[str]]
    widths: np.ndarray
    heights: np.ndarray
    aligns: list[str]
    fills: list[str] = field(default_factory=list)

    @property
    def filled(self) -> int:
        return sum(bool(t.strip()) for row in self.texts for t in row)

    @property
    def occupancy(self) -> float:
        return self.filled / max(1, self.low.size)


def cluster_means(values: np.ndarray, tolerance: float) -> np.ndarray:
    v = np.sort(values)
    cuts = np.flatnonzero(np.diff(v) > tolerance) + 1
    return np.array([p.mean() for p in np.split(v, cuts)]) if len(v) else v


def word_rows(b: np.ndarray) -> list[np.ndarray]:
    """Words by row: rows are clusters of centres, each word goes to the nearest (the last of equals)."""
    centre = (b[:, 1] + b[:, 3]) / 2
    tolerance = max(8.0, 0.7 * float(np.median(b[:, 3] - b[:, 1])))
    means = cluster_means(centre, tolerance)
    off = np.abs(centre[:, None] - means[None, ::-1])
    row = len(means) - 1 - off.argmin(axis=1)
    row = np.where(off.min(axis=1) <= tolerance, row, -1)
    return [r for k in range(len(means)) if len(r := np.flatnonzero(row == k))]


def build_grid(rows: list[np.ndarray], b: np.ndarray, text: list[str]) -> Grid | None:
    """The grid of these rows, or None if they are not of 2 to 10 columns with two cells or more in each row."""
    if len(rows) < 3:
        return None
    rows = [r[np.argsort(b[r, 0], kind="stable")] for r in rows]
    used = np.concatenate(rows)
    wide = max(12.0, 1.2 * max(1.0, float(np.median(b[used, 2] - b[used, 0]))))
    votes = [np.r_[True, b[r[1:], 0] - b[r[:-1], 2] >= wide] for r in rows]
    centres = cluster_means(np.concatenate([b[r[v], 0] for r, v in zip(rows, votes)]), 12.0)
    k = len(centres)
    if not 2 <= k <= 10:
        return None
    low, high = np.full((len(rows), k), np.inf), np.full((len(rows), k), -np.inf)
    texts = [[""] * k for _ in rows]
    for y, r in enumerate(rows):
        column = np.maximum(np.searchsorted(centres, b[r, 0] + 12.0, side="right") - 1, 0)
        np.minimum.at(low[y], column, b[r, 0])
        np.maximum.at(high[y], column, b[r, 2])
        for c in set(column.tolist()):
            texts[y][c] = " ".join(text[i] for i in r[column == c].tolist())
    there = np.isfinite(low)
    if (there.sum(axis=1) < 2).any():
        return None
    pad = 4.0
    box = np.r_[b[used, 0].min() - pad, b[used, 1].min() - pad / 2, b[used, 2].max() + pad, b[used, 3].max() + pad / 2]
    empty = ~there.any(axis=0)
    left, right = low.min(axis=0), high.max(axis=0)
    left[empty] = centres[empty]
    right[empty] = np.r_[centres[1:], box[2]][empty]
    aligns = [_centred(low[there[:, c], c], high[there[:, c], c]) for c in range(k)]
    edges = [box[0]]
    for c in range(k - 1):
        inset = left[c + 1] - pad
        hug = "center" not in (aligns[c], aligns[c + 1]) and inset > right[c]
        edges.append(max(right[c], inset) if hug else (right[c] + left[c + 1]) / 2)
    last = there[:, -1]
    run = float((high[last, -1] - low[last, -1]).max()) if last.any() else max(0.0, right[-1] - left[-1])
    if aligns[-1] == "center":
        end = max(box[2], (left[-1] + right[-1]) / 2 + run / 2 + 8.0, right[-1] + 8.0)
    else:
        inset = max(pad, left[-1] - edges[-1])
        end = max(box[2], edges[-1] + run + inset + 8.0, right[-1] + inset + 8.0)
    edges = np.array([*edges, end])
    box[2] = max(box[2], end)
    for c in range(k):
        if aligns[c] != "center":
            aligns[c] = _leaning(low[there[:, c], c] - edges[c], edges[c + 1] - high[there[:, c], c], max(1.0, edges[c + 1] - edges[c]))
    tops, bottoms = np.array([b[r, 1].min() for r in rows]), np.array([b[r, 3].max() for r in rows])
    bounds = np.r_[box[1], (bottoms[:-1] + tops[1:]) / 2, box[3]]
    return Grid(box, low, high, texts, np.maximum(1.0, np.diff(edges)), np.maximum(1.0, np.diff(bounds)), aligns)


def _centred(low: np.ndarray, high: np.ndarray) -> str:
    return "center" if len(low) >= 2 and np.ptp((low + high) / 2) <= 1.5 and np.ptp(low) >= 2.0 else "left"


def _leaning(left_gap: np.ndarray, right_gap: np.ndarray, width: float) -> str:
    right = (right_gap < 0.45 * left_gap) & (right_gap < 0.12 * width)
    return "right" if right.sum() * 2 > len(right) else "left"


def text_grids(b: np.ndarray, text: list[str], most_rows: int = 48, window: int = 24) -> list[Grid]:
    """Grids of the longest windows of rows that make one, and of these with rows trimmed off; overlapping ones once.

    The bounds on rows are those of the operator's definition, for a page.
    """
    rows = word_rows(b)[:most_rows] if len(b) else []
    found: list[Grid] = []
    start = 0
    while start <= len(rows) - 3:
        best, end = None, start
        for stop in range(start + 3, min(len(rows), start + window) + 1):
            grid = build_grid(rows[start:stop], b, text)
            if grid is None and best is not None:
                break
            if grid is not None:
                best, end = grid, stop
        if best is None:
            start += 1
            continue
        trims = [(i, j) for i in range(3) for j in range(3) if end - start - i - j >= 3]
        found += [g for i, j in trims if (g := best if i + j == 0 else build_grid(rows[start + i : end - j], b, text))]
        start = max(start + 1, end - 1)
    return distinct_grids(found)


def distinct_grids(grids: list[Grid]) -> list[Grid]:
    """Non-maximum suppression: fuller grids first, none that a kept one covers to 0.6 or more."""
    grids = sorted(grids, key=lambda g: (-g.occupancy, -g.filled, g.box[1]))
    if not grids:
        return []
    return [grids[i] for i in grow_free(np.stack([g.box for g in grids]), np.empty((0, 4)), heavy_overlap(0.6))]


def snap_columns(grid: Grid, box: np.ndarray) -> Grid:
    """The grid widened to a box: centred columns stay symmetric about their texts, other edges lie between texts."""
    k = len(grid.widths)
    there = np.isfinite(grid.low)
    old = grid.box[0] + np.r_[0, np.cumsum(grid.widths)]
    mid, left, right = (old[:-1] + old[1:]) / 2, old[:-1].copy(), old[1:].copy()
    for c in range(k):
        if there[:, c].any():
            lo, hi = grid.low[there[:, c], c], grid.high[there[:, c], c]
            mid[c], left[c], right[c] = np.median((lo + hi) / 2), np.median(lo), np.median(hi)
    edge = np.full(k + 1, np.nan)
    edge[0], edge[k] = box[0], box[2]
    centred = [c for c in range(k) if grid.aligns[c] == "center"]
    for _ in range(k + 2):
        known = np.isfinite(edge).sum()
        for c in centred:
            if np.isfinite(edge[c]) and not np.isfinite(edge[c + 1]):
                edge[c + 1] = 2 * mid[c] - edge[c]
            elif np.isfinite(edge[c + 1]) and not np.isfinite(edge[c]):
                edge[c] = 2 * mid[c] - edge[c + 1]
        if np.isfinite(edge).sum() == known:
            break
    between = np.r_[np.nan, (right[:-1] + left[1:]) / 2, np.nan]
    edge = np.where(np.isfinite(edge), edge, between)
    edge[0], edge[k] = box[0], box[2]
    for c in range(1, k):
        edge[c] = min(max(edge[c], edge[c - 1] + 1.0), edge[k] - (k - c))
    for c in range(k - 1, 0, -1):
        edge[c] = min(edge[c], edge[c + 1] - 1.0)
        edge[c] = max(edge[c], edge[c - 1] + 1.0)
    return replace(grid, box=np.asarray(box, float), widths=np.maximum(1.0, np.diff(edge)))


def zebra_grids(stacks: list[tuple[np.ndarray, list[str]]], b: np.ndarray, text: list[str]) -> list[Grid]:
    """Grids of the words on stacks of bands (boxes from the top, and their fills)."""
    found: list[Grid] = []
    centre = (b[:, :2] + b[:, 2:]) / 2
    for bands, fills in stacks:
        box = np.r_[bands[:, 0].min(), bands[0, 1], bands[:, 2].max(), bands[-1, 3]]
        on = np.flatnonzero((centre >= box[:2]).all(axis=1) & (centre <= box[2:]).all(axis=1))
        if len(on) < 4:
            continue
        words, own = b[on], [text[i] for i in on.tolist()]
        grids = text_grids(words, own)
        if not grids:
            y = (words[:, 1] + words[:, 3]) / 2
            inside = (y[:, None] >= bands[None, :, 1]) & (y[:, None] <= bands[None, :, 3])
            band = np.where(inside.any(axis=1), inside.argmax(axis=1), -1)
            one = build_grid([r for k in range(len(bands)) if len(r := np.flatnonzero(band == k))], words, own)
            grids = [one] if one else []
            n = len(one.heights) if one else 0
        else:
            n = len(bands)
        for g in grids:
            if len(g.heights) == n:
                heights = np.maximum(1.0, bands[:n, 3] - bands[:n, 1])
                g = replace(snap_columns(g, box), heights=heights, fills=fills[:n], box=np.r_[box[:3], box[1] + heights.sum()])
            found.append(g)
    return distinct_grids(found)


def plausible(grid: Grid) -> bool:
    """Cells are short and mostly filled, and some column nearly is."""
    sizes = [len(t) for row in grid.texts for t in row if t]
    full = np.array([[bool(t.strip()) for t in row] for row in grid.texts])
    return grid.occupancy >= 0.45 and bool(sizes) and np.median(sizes) <= 28 and max(sizes) <= 72 and full.mean(axis=0).max() >= 0.7


def inferred_tables(b: np.ndarray, text: list[str], stacks: list, ruled: np.ndarray) -> list[Grid]:
    """Tables of a page without rules: those on zebra stacks first, then text grids, free of all before them."""
    grids = [g for g in [*zebra_grids(stacks, b, text), *text_grids(b, text)] if plausible(g)]
    if not grids:
        return []
    return [grids[i] for i in grow_free(np.stack([g.box for g in grids]), ruled, heavy_overlap(0.4, both=True))]


def unique_names(wanted: list[str]) -> list[str]:
    """Names made distinct, case apart, by __2, __3, ... before the suffix; names in use are passed over.

    Numbers of one stem and suffix are tried from the last one taken, as those below it stay in use.
    """
    used: set[str] = set()
    last: dict[str, int] = {}
    out = []
    for name in wanted:
        folder, _, leaf = name.rpartition("/")
        stem, dot, suffix = leaf.rpartition(".") if "." in leaf[1:] else (leaf, "", "")
        new = name
        if new.lower() in used:
            numbered = lambda n: f"{folder + '/' if folder else ''}{stem}__{n}{dot}{suffix}"
            n = last.get(key := numbered(0).lower(), 1)
            while new.lower() in used:
                n += 1
                new = numbered(n)
            last[key] = n
        used.add(new.lower())
        out.append(new)
    return out


def deck_names(files: DataFrame, key: str = "id", path: str = "path") -> DataFrame:
    """(key, path, output): collisions are only among names of one family, which is the group."""
    family = F.lower(F.regexp_replace(path, r"(__[0-9]+)*(\.[^./]*)?$", "$2"))

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        return pdf[[key, path]].assign(output=unique_names(pdf[path].tolist()))

    return files.select(key, path, family.alias("family")).groupBy("family").applyInPandas(work, f"{key} long, {path} string, output string")
