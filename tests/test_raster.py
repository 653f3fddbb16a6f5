"""Raster kernels against plain loops and known images."""

import time

import numpy as np
import pytest

from lamella.operators import raster as I

rng = np.random.default_rng(2)


def image(h=40, w=60, seed=1):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)


def test_blur_is_a_weighted_mean():
    a = rng.random((20, 30))
    k = I.gaussian(1.5, 5)
    y, x = 9, 14
    want = sum(k[i + 5] * k[j + 5] * a[y + i, x + j] for i in range(-5, 6) for j in range(-5, 6))
    assert I.blur(a, 1.5, 5)[y, x] == pytest.approx(want)
    assert I.blur(np.full((4, 4), 7.0), 3.0) == pytest.approx(np.full((4, 4), 7.0))


@pytest.mark.parametrize("px", [1, 3])
def test_morphology(px):
    m = rng.random((25, 31)) > 0.8
    want = np.zeros_like(m)
    for y, x in zip(*np.nonzero(m)):
        want[max(0, y - px) : y + px + 1, max(0, x - px) : x + px + 1] = True
    assert (I.dilated(m, px) == want).all()
    assert (I.eroded(m, px) == ~I.dilated(~m, px)).all()
    assert (I.closed(m, px) >= m).all()
    assert (I.opened(m, 1, 4) <= m).all()


def test_opening_keeps_runs_of_the_length():
    m = np.zeros((3, 20), bool)
    m[1, 2:8] = m[2, 10:13] = True
    assert np.argwhere(I.opened(m, 1, 4)).tolist() == [[1, x] for x in range(2, 8)]


def test_components():
    m = rng.random((30, 30)) > 0.65
    labels, n = I.components(m)
    of = {tuple(p): i for i, p in enumerate(np.argwhere(m).tolist())}
    done, count = {}, 0
    for p in of:
        if p in done:
            continue
        count += 1
        stack = [p]
        while stack:
            q = stack.pop()
            if q in done or q not in of:
                continue
            done[q] = count
            stack += [(q[0] + i, q[1] + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    assert n == count
    assert len({(labels[p], c) for p, c in done.items()}) == count and (labels > 0).sum() == m.sum()
    assert I.components(np.zeros((4, 4), bool))[1] == 0


def test_kernels_of_a_page_take_few_calls():
    """Windows are joined, not scanned, and boxes grown on their own ground: in proportion to the boxes, not to boxes times pixels."""
    big, boxes = (1_500, 2_000), [(20 * k, 15 * k, 20 * k + 12, 15 * k + 9) for k in range(90)]
    m = I.box_mask(boxes, big)
    began = time.perf_counter()
    grown = I.dilated_by_height(m, boxes, most=3, least=1)
    assert time.perf_counter() - began < 2  # 90 dilations of the whole image take far longer
    assert (grown == I.dilated(m, 2)).all()
    labels, n = I.components(m)
    assert n == 90 and I.extents(labels, n).tolist() == [[x0, y0, x1 + 1, y1 + 1] for x0, y0, x1, y1 in boxes]


@pytest.mark.parametrize("shape", [(7, 9), (1, 5), (6, 1)])
def test_windows_of_any_size(shape):
    m = rng.random(shape) > 0.5
    for n in (1, 2, 3, 4, 5, 8, 11):
        before = (n - 1) // 2
        for dilate in (True, False):
            p = np.pad(m, ((before, n - 1 - before), (0, 0)), constant_values=not dilate)
            want = np.stack([(p[y : y + n].any(axis=0) if dilate else p[y : y + n].all(axis=0)) for y in range(shape[0])])
            assert (I._extreme(m, n, 1, dilate) == want).all() and (I._extreme(m.T, 1, n, dilate) == want.T).all()
    for r in (1, 3, 5):
        p = np.pad(m.astype(float), ((r, r), (0, 0)), mode="reflect" if shape[0] > r else "edge")
        assert I.along(m.astype(float), np.arange(2.0 * r + 1), 0) == pytest.approx(np.stack([np.arange(2.0 * r + 1) @ p[y : y + 2 * r + 1] for y in range(shape[0])]))


def test_ssim():
    a = image()
    assert I.ssim(a, a) == 1.0
    assert I.ssim(a, 255 - a) < 0.1 < I.ssim(a, np.clip(a.astype(int) + 3, 0, 255).astype(np.uint8))
    assert I.region_ssim(a, a, (0, 0, 7, 20)) is None and I.region_mae(a, a, (0, 0, 3, 20)) is None
    assert I.region_mae(a, a, (0, 0, 5, 5)) == 0.0


def test_errors():
    a, b = image(seed=1), image(seed=2)
    d = np.abs(a.astype(int) - b.astype(int))
    e = I.pixel_error(a, b)
    assert e["mae"] == pytest.approx(d.mean(), abs=1e-4) and e["mse"] == pytest.approx((d * d).mean(), abs=1e-4)
    m = np.zeros((40, 60), bool)
    assert I.masked_mae(a, b, m) == I.seam_mae(a, b, m) == 0.0
    m[5:20, 5:30] = True
    assert I.masked_mae(a, b, m) == pytest.approx(d[5:20, 5:30].mean(), abs=1e-4)
    rim = m.copy()
    rim[7:18, 7:28] = False
    assert I.seam_mae(a, b, m, 2) == pytest.approx(d[rim].mean(), abs=1e-4)
    c = a.copy()
    c[10, 10] = c[0, 0] = 255 - c[0, 0]
    assert I.outside_changes(a, c, m)["changed"] == 1 and not I.unchanged_outside(a, c, m)


def test_edges():
    a = np.full((40, 60, 3), 255, np.uint8)
    a[:, 30:] = 0
    e = I.edges(I.gray(a))
    assert e.any() and set(np.nonzero(e)[1].tolist()) <= {29, 30}
    assert I.edge_scores(a, a)["edge_f1"] == 1.0
    blank = np.full_like(a, 255)
    assert I.edge_scores(a, blank) == {"edge_precision": 1.0, "edge_recall": 0.0, "edge_f1": 0.0}


def test_ink():
    a = np.full((60, 80, 3), 255, np.uint8)
    a[10:14, 10:50] = a[30:34, 10:40] = 0
    assert I.ink_rows(a, (0, 0, 80, 60)) == [11.5, 31.5]
    assert I.ink_rows(a, (0, 20, 80, 60)) == [31.5]
    assert I.ink_extent(a, (0, 0, 80, 60)) == (10, 10, 50, 34)
    assert I.ink_extent(a, (60, 40, 80, 60)) is None and I.ink_rows(a, (5, 5, 5, 9)) == []
    assert I.true_runs(np.array([1, 1, 0, 1], bool)).tolist() == [[0, 2], [3, 4]]


def test_foreground_colour_and_weight():
    a = np.full((30, 60, 3), 240, np.uint8)
    a[8:22, 5:20] = (200, 10, 10)
    m = I.foreground(I.gray(a))
    assert m.sum() == 14 * 15 and I.text_colour(a, m) == "#C80A0A" and I.text_colour(a, None)[0] == "#"
    assert I.foreground(np.full((9, 9), 5.0)) is None
    assert I.is_bold(m, "latin") and not I.is_bold(None, "latin")
    thin = np.zeros((40, 60), bool)
    thin[5:35, 10] = thin[5:35, 40] = thin[20, 10:40] = True
    assert not I.is_bold(thin, "latin")


def test_masks():
    m = I.box_mask([(2, 3, 5, 6), (-4, -4, 0, 0)], (10, 12))
    assert m.sum() == 16 + 1
    grown = I.dilated_by_height(m, [(2, 3, 5, 6)], ratio=0.5, least=1, most=3)
    assert (grown >= m).all() and grown.sum() > m.sum()
    assert not I.dilated_by_height(np.zeros((5, 5), bool), [(0, 0, 2, 2)]).any()


def ruled():
    a = np.full((120, 160, 3), 250, np.uint8)
    a[[20, 60, 100], 10:150] = 40
    a[20:101, [10, 80, 149]] = 40
    return a


def test_rules_and_grids():
    a = ruled()
    h, v = I.line_masks(a)
    assert h[60, 40] and v[40, 80] and not h[40, 40] and not v[62, 120]
    grid = I.grid_lines(h, v)
    assert grid[60, 80] and not I.grid_lines(h, np.zeros_like(h)).any()
    text = I.box_mask([(20, 55, 70, 65)], (120, 160))
    assert I.lines_off_text(h, text)[20, 60]
    short = np.zeros_like(h)
    short[60, 30:50] = True
    assert not I.lines_off_text(short, text).any()
    assert I.lines_off_text(short, text, border=short).any()
    assert not I.refined_text_mask(a, [(5, 55, 15, 65)], 0)[60, 10]


def test_grounds():
    y, x = np.indices((60, 80))
    plane = np.stack([100 + x, 50 + y, 90 + 0 * x], axis=2).astype(np.uint8)
    m = I.box_mask([(30, 20, 50, 40)], (60, 80))
    fit, residual = I.surface(plane, I.ring(m, 4))
    assert residual < 1e-6 and np.abs(fit - plane).max() < 1e-6
    assert I.surface(plane, np.zeros((60, 80), bool)) is None
    assert I.complexity(plane, m) < 0.3 < I.complexity(image(60, 80), m)
    flat = np.full((60, 80, 3), 77, np.uint8)
    assert I.flat_share(flat, m) == 1.0 and I.flat_share(image(60, 80), m) == 0.0 and I.flat_share(flat, ~np.ones_like(m)) == 0.0
    assert I.ring_texture(flat, m) == pytest.approx(0, abs=1e-9) and I.ring_texture(plane, m, "plane_residual") < 0.6 < I.ring_texture(image(60, 80), m)
    assert I.ring_median(flat, (10, 10, 20, 20)) == (77, 77, 77) and I.ring_median(flat, (0, 0, 80, 60)) is None
    assert I.corner_colour(plane) == (178, 108, 90) and I.corner_colour(plane[:1]) == (255, 255, 255)
    assert I.low_frequency_mae(plane, plane, m) == 0.0


def test_erasing_and_translucent_fills():
    a = np.full((54, 96, 3), 200, np.uint8)
    a[20:30, 20:40] = 10
    out = I.erased(a, [(200.0, 200.0, 400.0, 300.0)], (960.0, 540.0), (1, 2, 3))
    assert (out == 200).all()
    shapes = [((0.0, 0.0, 960.0, 540.0), (9, 9, 9), 1.0), ((0.0, 0.0, 900.0, 540.0), (8, 8, 8), 0.5)]
    assert (I.erased(a, [(0.0, 0.0, 960.0, 540.0)], (960.0, 540.0), (1, 2, 3), shapes) == 9).all()
    assert (I.erased(a, [(0.0, 0.0, 960.0, 540.0)], (960.0, 540.0), (1, 2, 3)) == (1, 2, 3)).all()
    ground = image(54, 96)
    mixed = np.round(0.75 * ground + 0.25 * np.array([255, 0, 0])).astype(np.uint8)
    back = I.uncomposited(mixed, [((0.0, 0.0, 960.0, 540.0), (255, 0, 0), 0.25)], (960.0, 540.0))
    assert np.abs(back.astype(int) - ground).max() <= 1


def test_inpainting():
    y, x = np.indices((60, 80))
    plane = np.stack([100 + x, 50 + y, 90 + 0 * x], axis=2).astype(np.uint8)
    m = I.box_mask([(30, 20, 50, 40)], (60, 80))
    hurt = np.where(m[..., None], np.uint8(0), plane)
    for engine in (I.inpainted, lambda a, k: I.inpainted_by_patches(a, k, I.inpainted), I.diffused):
        fixed = engine(hurt, m)
        assert I.unchanged_outside(hurt, fixed, m) and I.masked_mae(plane, fixed, m) < 12
    assert I.masked_mae(plane, I.inpainted(hurt, m), m) < 1
    assert (I.white_boxes(hurt, m)[m] == 255).all()
    assert I.seam_roughness(I.inpainted(hurt, m), m) < I.seam_roughness(hurt, m)
    mixed = I.composited(hurt, plane, m)
    assert I.unchanged_outside(hurt, mixed, m) and I.masked_mae(plane, mixed, m) < I.masked_mae(plane, hurt, m)
    alpha = I.feather(m)
    assert alpha[30, 40] == 1 and 0 < alpha[18, 40] < 1.0001 and alpha[0, 0] == 0 and I.feather(~np.ones_like(m)) is None


def test_rules_go_through_a_repair():
    a = ruled()
    m = I.box_mask([(40, 56, 60, 64)], (120, 160))
    hurt = np.where(m[..., None], np.uint8(250), a)
    fixed = I.inpainted(hurt, m)
    assert (fixed[60, 40:61] < 60).all() and (fixed[57, 40:61] > 200).all()


def test_patches_hold_the_mask():
    m = I.box_mask([(10, 10, 20, 20), (30, 10, 40, 20), (150, 100, 155, 110)], (120, 200))
    found = I.patches(m, gap=16, pad=4)
    assert len(found) == 2
    held = np.zeros_like(m)
    for x0, y0, x1, y1 in found:
        held[y0:y1, x0:x1] = True
    assert (held >= m).all() and I.patches(~np.ones_like(m)) == []


def test_fills_and_groups():
    px = np.array([[250, 0, 0]] * 70 + [[0, 0, 250]] * 30, np.uint8)
    assert I.modal_fill(px) == "#FA0000" and I.modal_fill(px[:0]) is None
    assert I.modal_fill(np.array([[0, 0, 0], [100, 100, 100], [200, 200, 200]], np.uint8)) == "#646464"
    a = np.full((30, 30, 3), 99, np.uint8)
    a[10:14, 10:20] = 0
    assert I.cell_fill(a, (5, 5, 25, 25), [(10, 10, 20, 14)]) == "#636363"
    b = np.array([[0, 0, 5, 5], [9, 0, 14, 5], [60, 0, 160, 90], [100, 0, 105, 5]], float)
    assert I.span_groups(b, small=40, gap=6).tolist() == [0, 0, 2, 3]


def test_cloning_takes_gradients_from_the_edit():
    y, x = np.indices((40, 50))
    source = np.stack([100 + x] * 3, axis=2).astype(np.uint8)
    edited = source + np.uint8(40)  # the same gradients, brighter
    m = I.box_mask([(15, 10, 35, 30)], (40, 50))
    fixed = I.cloned(source, edited, m)
    assert I.unchanged_outside(source, fixed, m) and I.masked_mae(source, fixed, m) < 12 < I.masked_mae(source, edited, m)
    assert (I.cloned(source, edited, ~np.ones_like(m)) == source).all()


def test_cut_out():
    a = image(54, 96)
    assert (I.cut_out(a, (100.0, 100.0, 200.0, 205.0), (960.0, 540.0)) == a[10:21, 10:20]).all()
    assert I.cut_out(a, (2000.0, 0.0, 2100.0, 9.0), (960.0, 540.0)) is None


def test_residual_checker():
    m = I.box_mask([(0, 0, 9, 9)], (20, 20))
    a = image(20, 20)
    assert I.residual_share(m, [(0, 0, 9, 4)]) == 0.5
    assert I.residual_checker(lambda i: [(0, 0, 9, 4)])(a, m) and not I.residual_checker(lambda i: [])(a, m)

    def broken(i):
        raise RuntimeError

    assert not I.residual_checker(broken)(a, m)


def test_overlay_engines():
    y, x = np.indices((54, 96))
    a = np.stack([200 + x // 8] * 3, axis=2).astype(np.uint8)
    a[20:24, 20:60:2] = 20
    made, engine = I.overlay_background(a, [(20, 20, 60, 24)])
    assert engine in ("fast", "patches") and I.gray(made).min() > 150
    assert I.overlay_background(a, [(20, 20, 60, 24)], "white")[0][22, 30].tolist() == [255] * 3
    assert set(I.region_metrics(a, a, [(1, 1, 5, 5)]).values()) == {0.0}
