"""Image operators on arrays: H x W x 3 (RGB, uint8) images, H x W boolean masks.

They run inside Arrow or pandas batches, an image at a time, so memory is
bounded by an image; nothing here shuffles. The Canny and blur kernels are
written here, as no image library is assumed.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

LUMA = np.array([0.299, 0.587, 0.114])


def gray(image: np.ndarray) -> np.ndarray:
    """Rounded luma, as floats."""
    return np.floor(image.astype(float) @ LUMA + 0.5)


# ------------------------------------------------------------------ filters


def along(a: np.ndarray, kernel: np.ndarray, axis: int) -> np.ndarray:
    """Correlation with a 1-D kernel; borders are mirrored without the edge row."""
    r = len(kernel) // 2
    last = a.shape[axis] - 1
    at = np.arange(-r, last + r + 1)
    at = last - np.abs(last - np.abs(at)) if last >= r else np.clip(at, 0, last)
    return sliding_window_view(np.take(a, at, axis=axis), len(kernel), axis=axis) @ kernel


def gaussian(sigma: float, radius: int | None = None) -> np.ndarray:
    r = max(1, int(3 * sigma + 0.5)) if radius is None else radius
    k = np.exp(-(np.arange(-r, r + 1) ** 2) / (2 * sigma * sigma))
    return k / k.sum()


def blur(a: np.ndarray, sigma: float, radius: int | None = None) -> np.ndarray:
    k = gaussian(sigma, radius)
    return along(along(a.astype(float), k, 0), k, 1)


def _extreme(mask: np.ndarray, height: int, width: int, dilate: bool) -> np.ndarray:
    """Whether any (all) of a window is set, by joining windows of twice the length at each step."""
    join = np.logical_or if dilate else np.logical_and
    out = mask.astype(bool)
    for n in (height, width):
        if n > 1:
            before, size = (n - 1) // 2, out.shape[0]
            wide = np.full((size + n - 1, out.shape[1]), not dilate)
            wide[before : before + size] = out
            done = 1
            while done < n:
                step = min(done, n - done)
                wide = join(wide[:-step], wide[step:])
                done += step
            out = wide
        out = out.T
    return np.ascontiguousarray(out)


def dilated(mask: np.ndarray, px: int, px_x: int | None = None) -> np.ndarray:
    return _extreme(mask, 2 * px + 1, 2 * (px if px_x is None else px_x) + 1, True)


def eroded(mask: np.ndarray, px: int) -> np.ndarray:
    """Outside the image counts as set, as at a border nothing shows."""
    return _extreme(mask, 2 * px + 1, 2 * px + 1, False)


def opened(mask: np.ndarray, height: int, width: int) -> np.ndarray:
    small = _extreme(mask, height, width, False)
    flipped = _extreme(small[::-1, ::-1], height, width, True)  # mirrored, so that even kernels come back in place
    return flipped[::-1, ::-1]


def closed(mask: np.ndarray, px: int) -> np.ndarray:
    return eroded(dilated(np.pad(mask, px), px), px)[px:-px, px:-px] if px else mask.astype(bool)


def gradients(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel derivatives along x and y."""
    smooth, slope = np.array([1.0, 2.0, 1.0]), np.array([-1.0, 0.0, 1.0])
    return along(along(g, slope, 1), smooth, 0), along(along(g, slope, 0), smooth, 1)


def edges(g: np.ndarray, low: float = 80, high: float = 160) -> np.ndarray:
    """Canny edges: local maxima of the gradient along its direction, above `low` and linked to one above `high`."""
    gx, gy = gradients(g)
    size = np.abs(gx) + np.abs(gy)
    p = np.pad(size, 1)
    slope = np.abs(gy) / np.maximum(np.abs(gx), 1e-9)
    flat, steep = slope < np.tan(np.pi / 8), slope > np.tan(3 * np.pi / 8)
    down = gx * gy > 0
    at = lambda dy, dx: p[1 + dy : 1 + dy + size.shape[0], 1 + dx : 1 + dx + size.shape[1]]
    before = np.where(flat, at(0, -1), np.where(steep, at(-1, 0), np.where(down, at(-1, -1), at(-1, 1))))
    after = np.where(flat, at(0, 1), np.where(steep, at(1, 0), np.where(down, at(1, 1), at(1, -1))))
    ridge = (size > before) & (size >= after)
    weak, strong = ridge & (size > low), ridge & (size > high)
    labels, n = components(weak)
    keep = np.zeros(n + 1, bool)
    keep[np.unique(labels[strong])] = True
    keep[0] = False
    return keep[labels]


def components(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """(labels from 1, number) of 8-connected components, by merging runs of rows."""
    mask = mask.astype(bool)
    step = np.diff(np.pad(mask, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    ry, start = np.nonzero(step == 1)
    _, end = np.nonzero(step == -1)
    n = len(ry)
    if not n:
        return np.zeros(mask.shape, np.int64), 0
    # Runs of the row above that a run touches follow one another, as runs are ordered by row and column.
    wide = mask.shape[1] + 2
    low = np.searchsorted(ry * wide + end, (ry - 1) * wide + start)
    high = np.searchsorted(ry * wide + start, (ry - 1) * wide + end, side="right")
    parent = list(range(n))
    for j, (i, stop) in enumerate(zip(low.tolist(), high.tolist())):
        for above in range(i, stop):
            a, b = j, above
            while parent[a] != a:
                parent[a] = a = parent[parent[a]]
            while parent[b] != b:
                parent[b] = b = parent[parent[b]]
            if a < b:
                parent[b] = a
            else:
                parent[a] = b
    for i in range(n):  # parents come first
        parent[i] = parent[parent[i]]
    roots, number = np.unique(parent, return_inverse=True)
    labels = np.zeros(mask.shape, np.int64)
    labels[mask] = np.repeat(number + 1, end - start)
    return labels, len(roots)


def extents(labels: np.ndarray, n: int) -> np.ndarray:
    """The box (x0, y0, x1, y1) of each component, ends excluded."""
    ys, xs = np.nonzero(labels)
    k = labels[ys, xs] - 1
    out = np.empty((n, 4), np.int64)
    out[:, :2], out[:, 2:] = max(labels.shape), -1
    for at, (join, values) in enumerate(((np.minimum, xs), (np.minimum, ys), (np.maximum, xs + 1), (np.maximum, ys + 1))):
        join.at(out[:, at], k, values)
    return out


def ring(mask: np.ndarray, px: int) -> np.ndarray:
    return dilated(mask, px) & ~mask.astype(bool)


# ------------------------------------------------------------------ fidelity


def ssim(a: np.ndarray, b: np.ndarray, data_range: float = 255.0) -> float:
    """Mean structural similarity of the lumas, with an 11 x 11 Gaussian window."""
    x, y = gray(a), gray(b)
    k = lambda z: blur(z, 1.5, 5)
    c1, c2 = (0.01 * data_range) ** 2, (0.03 * data_range) ** 2
    mx, my = k(x), k(y)
    vx, vy, xy = k(x * x) - mx * mx, k(y * y) - my * my, k(x * y) - mx * my
    return round(float(((2 * mx * my + c1) * (2 * xy + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))).mean()), 6)


def pixel_error(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    d = a.astype(float) - b.astype(float)
    mae = float(np.abs(d).mean())
    return {"mae": round(mae, 4), "mse": round(float((d * d).mean()), 4), "mae_share": round(mae / 255.0, 6)}


def masked_mae(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> float:
    return round(float(np.abs(a.astype(float) - b.astype(float))[mask].mean()), 4) if mask.any() else 0.0


def seam_mae(a: np.ndarray, b: np.ndarray, mask: np.ndarray, px: int = 4) -> float:
    """Error on the inner rim of the mask, or on all of it if the rim is empty."""
    if not mask.any() or px <= 0:
        return 0.0
    rim = mask & ~eroded(mask, px)
    return masked_mae(a, b, rim if rim.any() else mask)


def edge_scores(a: np.ndarray, b: np.ndarray) -> dict[str, float]:
    x, y = edges(gray(a)), edges(gray(b))
    both = int((x & y).sum())
    p, r = (both / int(z.sum()) if z.any() else 1.0 for z in (y, x))
    return {"edge_precision": round(p, 6), "edge_recall": round(r, 6), "edge_f1": round(2 * p * r / (p + r), 6) if p + r else 0.0}


def crop(image: np.ndarray, box: tuple[int, int, int, int]) -> np.ndarray:
    x0, y0, x1, y1 = box
    return image[max(0, y0) : max(0, y1), max(0, x0) : max(0, x1)]


def region_ssim(a: np.ndarray, b: np.ndarray, box: tuple) -> float | None:
    return None if box[2] - box[0] < 8 or box[3] - box[1] < 8 else ssim(crop(a, box), crop(b, box))


def region_mae(a: np.ndarray, b: np.ndarray, box: tuple) -> float | None:
    return None if box[2] - box[0] < 4 or box[3] - box[1] < 4 else pixel_error(crop(a, box), crop(b, box))["mae"]


def outside_changes(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> dict[str, float]:
    """Largest change of a channel, and pixels changed, outside the mask."""
    d = np.abs(a.astype(int) - b.astype(int)).max(axis=2)[~mask]
    return {"most": int(d.max(initial=0)), "changed": int((d > 0).sum()), "share": round(float((d > 0).mean()), 6) if d.size else 0.0}


def unchanged_outside(a: np.ndarray, b: np.ndarray, mask: np.ndarray) -> bool:
    return a.shape == b.shape and mask.shape == a.shape[:2] and bool((a[~mask] == b[~mask]).all())


def seam_roughness(image: np.ndarray, mask: np.ndarray, band: int = 3, context: int = 10) -> float:
    """Mean gradient on the mask's seam over that around it (1 at least)."""
    if not mask.any():
        return 0.0
    size = np.hypot(*gradients(gray(image)))
    wide = dilated(mask, band)
    seam = wide & ~eroded(mask, band)
    around = dilated(mask, context) & ~wide
    return round(float(size[seam if seam.any() else mask].mean()) / max(1.0, float(size[around if around.any() else ~mask].mean())), 4)


# ------------------------------------------------------------------ ink and text


def ink(g: np.ndarray, contrast: float = 24.0) -> np.ndarray:
    """Pixels that differ from the usual luma by more than the contrast."""
    return np.abs(g - np.median(g)) > contrast


def true_runs(flags: np.ndarray) -> np.ndarray:
    """[start, end) of the runs of set flags."""
    return np.flatnonzero(np.diff(np.r_[False, flags, False])).reshape(-1, 2)


def ink_rows(image: np.ndarray, box: tuple) -> list[float]:
    """Centres of the bands of rows with ink in the box."""
    c = crop(image, box)
    if not c.size:
        return []
    density = ink(gray(c)).mean(axis=1)
    if not density.any():
        return []
    runs = true_runs(density > max(0.02, 0.5 * float(density.mean())))
    return [box[1] + (a + b - 1) / 2.0 for a, b in runs.tolist()]


def ink_extent(image: np.ndarray, box: tuple) -> tuple[int, int, int, int] | None:
    c = crop(image, box)
    m = ink(gray(c)) if c.size else np.zeros((0, 0), bool)
    if not m.any():
        return None
    ys, xs = np.nonzero(m)
    return int(box[0] + xs.min()), int(box[1] + ys.min()), int(box[0] + xs.max() + 1), int(box[1] + ys.max() + 1)


def foreground(g: np.ndarray) -> np.ndarray | None:
    """The smaller of two clusters of luma; None if there is no contrast."""
    if not g.size or float(g.std()) < 6.0:
        return None
    low, high = float(g.min()), float(g.max())
    for _ in range(50):
        near_high = np.abs(g - high) < np.abs(g - low)
        new = float(g[~near_high].mean()), float(g[near_high].mean())
        if new == (low, high):
            break
        low, high = new
    small = near_high if near_high.sum() <= (~near_high).sum() else ~near_high
    if small.sum() < max(4, int(0.01 * g.size)):
        mean = float(g.mean())
        small = near_high if abs(high - mean) >= abs(low - mean) else ~near_high
    return small


def text_colour(image: np.ndarray, mask: np.ndarray | None) -> str:
    flat = image.reshape(-1, 3)
    if mask is None:
        value = flat.mean(axis=0)
    else:
        value = np.median(image[mask] if mask.any() else flat, axis=0)
    return "#%02X%02X%02X" % tuple(int(np.clip(round(float(v)), 0, 255)) for v in value)


def distance_inside(mask: np.ndarray, most: int = 64) -> np.ndarray:
    """Chamfer-free distance to the outside, by erosion steps of one pixel, up to `most`."""
    out = np.zeros(mask.shape)
    left = mask.astype(bool)
    for _ in range(most):
        if not left.any():
            break
        out[left] += 1
        left = ~dilated(~np.pad(left, 1), 1)[1:-1, 1:-1] & left
    return out


#: By script: least share of ink in its box, and least stroke over height, of bold text.
BOLD = {"latin": (0.3, 0.07), "numeric": (0.34, 0.075), "cjk": (0.38, 0.085), "mixed": (0.34, 0.078), "other": (0.34, 0.078)}


def is_bold(mask: np.ndarray | None, script: str) -> bool:
    if mask is None or mask.sum() < max(12, int(0.02 * mask.size)):
        return False
    ys, xs = np.nonzero(mask)
    h, w = int(np.ptp(ys)) + 1, int(np.ptp(xs)) + 1
    fill, stroke = BOLD.get(script, BOLD["other"])
    return mask.sum() / (h * w) >= fill and float(distance_inside(mask)[mask].mean()) / h >= stroke


# ------------------------------------------------------------------ masks


def box_mask(boxes: list[tuple], shape: tuple[int, int], pad: int = 0) -> np.ndarray:
    """Union of pixel boxes, both ends included, dilated by pad."""
    m = np.zeros(shape, bool)
    for x0, y0, x1, y1 in boxes:
        m[max(0, int(y0)) : max(0, int(y1) + 1), max(0, int(x0)) : max(0, int(x1) + 1)] = True
    return dilated(m, pad) if pad > 0 else m


def dilated_by_height(mask: np.ndarray, boxes: list[tuple], ratio: float = 0.25, least: int = 3, most: int = 9, floor: int = 0) -> np.ndarray:
    """Each box's part of the mask dilated by a share of its height; what no box has by the least; neighbours joined."""
    out, widest = np.zeros_like(mask, bool), 0
    h, w = mask.shape
    for b in boxes:
        x0, y0, x1, y1 = max(0, int(b[0])), max(0, int(b[1])), min(w, max(0, int(b[2]) + 1)), min(h, max(0, int(b[3]) + 1))
        if x0 >= x1 or y0 >= y1:
            continue
        if not mask[y0:y1, x0:x1].any():
            x0, y0, x1, y1 = max(0, x0 - 1), max(0, y0 - 1), min(w, x1 + 1), min(h, y1 + 1)
        if mask[y0:y1, x0:x1].any():
            px = max(floor, min(most, max(least, round((b[3] - b[1]) * ratio)))) if ratio > 0 else floor
            widest = max(widest, px)
            left, top = max(0, x0 - px), max(0, y0 - px)
            near = np.zeros_like(mask[top : y1 + px, left : x1 + px], bool)
            near[y0 - top : y1 - top, x0 - left : x1 - left] = mask[y0:y1, x0:x1]
            out[top : y1 + px, left : x1 + px] |= dilated(near, px)
    rest = mask & ~out
    if rest.any():
        out |= dilated(rest, max(floor, least if ratio > 0 else 0))
    return closed(out, max(widest, floor, 1)) if mask.any() else mask.astype(bool)


def line_masks(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(horizontal, vertical) rules: dark against their surroundings, long and thin."""
    g = gray(image)
    h, w = g.shape
    r = 15
    p = np.pad(g, r, mode="edge").cumsum(axis=0).cumsum(axis=1)
    p = np.pad(p, ((1, 0), (1, 0)))
    n = 2 * r + 1
    mean = (p[n:, n:] - p[:-n, n:] - p[n:, :-n] + p[:-n, :-n]) / (n * n)
    dark = g <= mean - 10
    long_x, long_y = max(12, w // 24), max(12, h // 24)
    return _spans(opened(dark, 1, long_x), long_x, 1), _spans(opened(dark, long_y, 1), long_y, 0)


def _spans(mask: np.ndarray, least: int, axis: int) -> np.ndarray:
    """Components of at least `least` pixels along the axis, and four times as long as thick."""
    labels, n = components(mask)
    if not n:
        return mask.astype(bool)
    x0, y0, x1, y1 = extents(labels, n).T
    size = (y1 - y0, x1 - x0)
    keep = (size[axis] >= least) & (size[axis] >= 4 * size[1 - axis])
    return np.r_[False, keep][labels]


def grid_lines(horizontal: np.ndarray, vertical: np.ndarray) -> np.ndarray:
    """Rules near a crossing."""
    cross = dilated(horizontal, 1, 4) & dilated(vertical, 4, 1)
    return (horizontal | vertical) & dilated(cross, 10)


def lines_off_text(lines: np.ndarray, text: np.ndarray, most_overlap: float = 0.6, least_outside: int = 24, outside_share: float = 0.2, border: np.ndarray | None = None) -> np.ndarray:
    """Line components that are not mostly text, or that run along the border band."""
    labels, n = components(lines)
    if not n or not text.any():
        return lines.astype(bool)
    area = np.bincount(labels.ravel(), minlength=n + 1)
    over = np.bincount(labels[text], minlength=n + 1)
    edge = np.bincount(labels[border], minlength=n + 1) if border is not None else np.zeros(n + 1)
    safe = edge >= np.maximum(3, np.ceil(area * 0.2))
    text_like = (over / np.maximum(area, 1) > most_overlap) & (area - over < np.maximum(least_outside, np.ceil(area * outside_share)))
    keep = safe | ~text_like
    keep[0] = False
    return keep[labels]


def refined_text_mask(image: np.ndarray, boxes: list[tuple], pad: int = 2) -> np.ndarray:
    """Text boxes without the table rules that run through them."""
    text = box_mask(boxes, image.shape[:2], pad)
    horizontal, vertical = line_masks(image)
    return text & ~dilated(lines_off_text(grid_lines(horizontal, vertical), text), 1)


# ------------------------------------------------------------------ backgrounds


def complexity(image: np.ndarray, mask: np.ndarray) -> float:
    """0 (flat) to 1 from the spread and the edges around the mask."""
    g = gray(image)
    around = ring(mask, 4)
    around = around if around.any() else ~mask
    if not around.any():
        return 0.0
    return round(0.65 * min(1.0, float(g[around].std()) / 64.0) + 0.35 * min(1.0, float(edges(g)[around].mean()) / 0.12), 4)


def flat_share(image: np.ndarray, mask: np.ndarray, most_std: float = 4.0, most_edges: float = 0.01, px: int = 6, least: int = 24) -> float:
    """Share of the mask, by area, whose components stand on flat ground."""
    labels, n = components(mask)
    g = gray(image)
    e = edges(g)
    flat = known = 0
    for k in range(1, n + 1):
        own = labels == k
        around = ring(own, px)
        if around.sum() < least:
            continue
        known += int(own.sum())
        if float(g[around].std()) <= most_std and float(e[around].mean()) <= most_edges:
            flat += int(own.sum())
    return round(flat / known, 4) if known else 0.0


def surface(image: np.ndarray, where: np.ndarray, quadratic: bool = False) -> tuple[np.ndarray, float] | None:
    """(fitted image, mean residual): a plane or quadratic of the pixels in `where`; None for fewer than 32."""
    ys, xs = np.nonzero(where)
    if len(xs) < 32:
        return None

    def design(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        cols = [np.ones_like(x), x, y] + ([x * x, x * y, y * y] if quadratic else [])
        return np.stack(cols, axis=-1)

    scale = float(max(image.shape[:2]))
    a = design(xs / scale, ys / scale)
    values = image[where].astype(float)
    c, *_ = np.linalg.lstsq(a, values, rcond=None)
    gy, gx = np.indices(image.shape[:2]) / scale
    return np.clip(design(gx, gy) @ c, 0, 255), float(np.abs(a @ c - values).mean())


def span_groups(boxes: np.ndarray, small: int = 40, gap: float = 6.0, scale: float = 0.5) -> np.ndarray:
    """Groups of components: small ones join within a gap that grows with their span."""
    from .pages import box_components

    span = (boxes[:, 2:] - boxes[:, :2]).max(axis=1) if len(boxes) else np.zeros(0)
    out = np.arange(len(boxes))
    tiny = np.flatnonzero(span <= small)
    if len(tiny):
        reach = max(gap, scale * float(np.median(span[tiny])))
        out[tiny] = tiny[box_components(boxes[tiny], reach)]
    return out


def diffused(image: np.ndarray, mask: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The masked pixels as a membrane over their rim: means of their neighbours, until they settle."""
    out = image.astype(float).copy()
    if not mask.any() or mask.all():
        return image.copy()
    around = ring(mask, 3)
    out[mask] = np.median(out[around] if around.any() else out[~mask], axis=0)
    h, w = mask.shape
    ys, xs = np.nonzero(mask)
    flat, here = out.reshape(h * w, -1), ys * w + xs
    above, below, left, right = np.maximum(ys - 1, 0) * w + xs, np.minimum(ys + 1, h - 1) * w + xs, ys * w + np.maximum(xs - 1, 0), ys * w + np.minimum(xs + 1, w - 1)
    now = flat[here]
    for _ in range(rounds):
        new = (flat.take(above, axis=0) + flat.take(below, axis=0) + flat.take(left, axis=0) + flat.take(right, axis=0)) / 4
        moved = float(np.abs(new - now).max())
        flat[here] = now = new
        if moved < 0.25:
            break
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def inpainted(image: np.ndarray, mask: np.ndarray, px: int = 6, most_residual: float = 6.0) -> np.ndarray:
    """Flat ground first: components on a smooth ring take its fitted surface, the rest a membrane; rules go on through."""
    labels, n = components(mask)
    out, rest = image.copy(), mask.copy()
    for k in range(1, n + 1):
        own = labels == k
        around = ring(own, px) & ~mask
        for quadratic in (False, True):
            fit = surface(image, around, quadratic)
            if fit is not None and fit[1] <= most_residual:
                out[own] = np.floor(fit[0][own] + 0.5).astype(np.uint8)
                rest &= ~own
                break
    out = diffused(out, rest)
    return bridged_lines(image, out, mask)


def bridged_lines(source: np.ndarray, repaired: np.ndarray, mask: np.ndarray, px: int = 3) -> np.ndarray:
    """Rules that reach a mask on both sides are drawn through it, in their own colour."""
    out = repaired.copy()
    for axis, lines in zip((1, 0), line_masks(source)):
        lines = lines & ~mask
        turn = (lambda a: a) if axis == 1 else (lambda a: a.swapaxes(0, 1))
        l_, m, s, o = turn(lines), turn(mask), turn(source), turn(out)
        for y in np.flatnonzero(l_.any(axis=1)):
            for a, b in true_runs(m[y]).tolist():
                left, right = l_[y, max(0, a - px) : a], l_[y, b : b + px]
                if left.any() and right.any():
                    colours = np.r_[s[y, max(0, a - px) : a][left], s[y, b : b + px][right]]
                    o[y, a:b] = np.median(colours, axis=0)
    return out


def white_boxes(image: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.where(mask[..., None], np.uint8(255), image)


def patches(mask: np.ndarray, gap: int = 16, pad: int = 32) -> list[tuple[int, int, int, int]]:
    """Crops that hold all of the mask: boxes of its components, joined within a gap, with room around them."""
    from .pages import box_components

    labels, n = components(mask)
    if not n:
        return []
    b = extents(labels, n).astype(float)
    group = box_components(b, gap)
    h, w = mask.shape
    return [(int(max(0, o[:, 0].min() - pad)), int(max(0, o[:, 1].min() - pad)), int(min(w, o[:, 2].max() + pad)), int(min(h, o[:, 3].max() + pad))) for g in np.unique(group) for o in [b[group == g]]]


def inpainted_by_patches(image: np.ndarray, mask: np.ndarray, engine) -> np.ndarray:
    """engine(crop, mask) on each patch; only masked pixels are taken from what it returns."""
    out = image.copy()
    for x0, y0, x1, y1 in patches(mask):
        cut = slice(y0, y1), slice(x0, x1)
        out[cut] = np.where(mask[cut][..., None], engine(out[cut], mask[cut]), out[cut])
    return out


def feather(mask: np.ndarray, sigma: float = 2.0, gain: float = 1.2, grow: int = 2, core: int = 1) -> np.ndarray | None:
    """Alpha of a mask with soft rims and a hard core."""
    if not mask.any():
        return None
    alpha = np.clip(blur(dilated(mask, grow).astype(float), sigma) * gain, 0, 1)
    alpha[eroded(mask, core) & mask] = 1.0
    return alpha


def composited(source: np.ndarray, edited: np.ndarray, mask: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """The edit within the mask, softened toward its rim; every other pixel as it was."""
    alpha = np.where(mask, blur(mask.astype(float), sigma), 0.0)[..., None]
    mixed = alpha * edited + (1 - alpha) * source
    return np.where(mask[..., None], np.clip(np.floor(mixed + 0.5), 0, 255).astype(np.uint8), source)


def cloned(source: np.ndarray, edited: np.ndarray, mask: np.ndarray, rounds: int = 400) -> np.ndarray:
    """The edit's gradients within the mask on the source's values around it (Poisson blending, by relaxation)."""
    inner = mask & ~(np.pad(np.ones_like(mask)[1:-1, 1:-1], 1, constant_values=False) == 0)
    if not inner.any():
        return source.copy()
    e, out = edited.astype(float), source.astype(float).copy()
    out[inner] = e[inner]

    def neighbours(a: np.ndarray) -> np.ndarray:
        p = np.pad(a, ((1, 1), (1, 1), (0, 0)), mode="edge")
        return p[:-2, 1:-1] + p[2:, 1:-1] + p[1:-1, :-2] + p[1:-1, 2:]

    curve = 4 * e - neighbours(e)
    for _ in range(rounds):
        new = (neighbours(out) + curve) / 4
        moved = float(np.abs(new[inner] - out[inner]).max())
        out[inner] = new[inner]
        if moved < 0.1:
            break
    return np.clip(np.floor(out + 0.5), 0, 255).astype(np.uint8)


def cut_out(image: np.ndarray, box: tuple, page: tuple[float, float]) -> np.ndarray | None:
    """The pixels that stand for an element: its part of the page image, None if it has none."""
    b = pixel_box(box, image.shape[1] / max(page[0], 1.0), image.shape[0] / max(page[1], 1.0), 0, image.shape[:2])
    return image[b[1] : b[3], b[0] : b[2]].copy() if b[2] > b[0] and b[3] > b[1] else None


def ring_median(image: np.ndarray, box: tuple[int, int, int, int], px: int = 3) -> tuple[int, int, int] | None:
    """Median colour just outside a box; None if nothing is outside."""
    x0, y0, x1, y1 = box
    if x1 <= x0 or y1 <= y0 or px <= 0:
        return None
    h, w = image.shape[:2]
    a, b, c, d = max(0, x0 - px), max(0, y0 - px), min(w, x1 + px), min(h, y1 + px)
    outside = np.ones((max(0, d - b), max(0, c - a)), bool)
    outside[max(0, y0 - b) : max(0, y1 - b), max(0, x0 - a) : max(0, x1 - a)] = False
    if not outside.any():
        return None
    return tuple(int(v) for v in np.median(image[b:d, a:c][outside].astype(float), axis=0))


def corner_colour(image: np.ndarray, default: tuple = (255, 255, 255)) -> tuple[int, int, int]:
    """By channel, the upper median of the four pixels next to the corners."""
    h, w = image.shape[:2]
    if h < 2 or w < 2:
        return default
    four = image[[1, 1, h - 2, h - 2], [1, w - 2, 1, w - 2]]
    return tuple(int(v) for v in np.sort(four, axis=0)[2])


def pixel_box(box: tuple, sx: float, sy: float, pad: int, shape: tuple[int, int]) -> tuple[int, int, int, int]:
    return max(0, int(box[0] * sx) - pad), max(0, int(box[1] * sy) - pad), min(shape[1], int(np.ceil(box[2] * sx)) + pad), min(shape[0], int(np.ceil(box[3] * sy)) + pad)


def erased(image: np.ndarray, regions: list[tuple], page: tuple[float, float], fill: tuple, shapes: list[tuple] = (), pad: int = 1, px: int = 3) -> np.ndarray:
    """Each region painted with the median around it, else the smallest opaque shape's fill under it, else `fill`.

    All colours are taken from the image as it came. shapes: (box, colour, opacity).
    """
    sx, sy = image.shape[1] / max(page[0], 1.0), image.shape[0] / max(page[1], 1.0)
    out = image.copy()
    for region in regions:
        b = pixel_box(region, sx, sy, pad, image.shape[:2])
        if b[2] > b[0] and b[3] > b[1]:
            out[b[1] : b[3] + 1, b[0] : b[2] + 1] = ring_median(image, b, px) or fill_under(region, shapes) or fill
    return out


def fill_under(region: tuple, shapes) -> tuple | None:
    cx, cy = (region[0] + region[2]) / 2, (region[1] + region[3]) / 2
    size = lambda b: max(0.0, b[2] - b[0]) * max(0.0, b[3] - b[1])
    fit = [(size(b), k, colour) for k, (b, colour, opacity) in enumerate(shapes) if opacity >= 0.99 and b[0] <= cx <= b[2] and b[1] <= cy <= b[3] and size(b) + 1e-6 >= size(region)]
    return min(fit)[2] if fit else None


def uncomposited(image: np.ndarray, shapes: list[tuple], page: tuple[float, float]) -> np.ndarray:
    """The image below translucent fills: the blend undone within each shape's box."""
    out = image.astype(float)
    sx, sy = image.shape[1] / max(page[0], 1.0), image.shape[0] / max(page[1], 1.0)
    for b, colour, alpha in shapes:
        if 0.02 <= alpha < 0.99:
            x0, y0, x1, y1 = pixel_box(b, sx, sy, 0, image.shape[:2])
            out[y0:y1, x0:x1] = np.clip((out[y0:y1, x0:x1] - alpha * np.array(colour)) / max(1e-6, 1 - alpha), 0, 255)
    return np.round(out).astype(np.uint8)


def ring_texture(image: np.ndarray, mask: np.ndarray, measure: str = "highpass", px: int = 12, sigma: float = 3.0) -> float:
    """Texture around the mask: spread of luma, of its high frequencies, or about a fitted plane."""
    around = ring(mask, px)
    if not around.any():
        return 0.0
    g = gray(image)
    if measure == "plane_residual":
        fit = surface(g[..., None], around)
        g = g - (fit[0][..., 0] if fit else float(g[around].mean()))
    elif measure == "highpass":
        g = g - blur(g, sigma)
    return float(g[around].std())


def low_frequency_mae(a: np.ndarray, b: np.ndarray, mask: np.ndarray, sigma: float = 8.0) -> float:
    if not mask.any():
        return 0.0
    x, y = (blur(z, sigma) if sigma > 0 else z.astype(float) for z in (a, b))
    return float(np.abs(x - y)[mask].mean())


def residual_share(mask: np.ndarray, detected: list[tuple]) -> float:
    """Share of the mask in which text is still read."""
    return float((box_mask(detected, mask.shape) & mask).sum() / mask.sum()) if mask.any() and detected else 0.0


def residual_checker(read, most: float = 0.02):
    """check(image, mask): whether read(image) still finds text in more of the mask than `most`; a failing reader finds none."""

    def check(image: np.ndarray, mask: np.ndarray) -> bool:
        try:
            return residual_share(mask, read(image)) > most
        except Exception:  # the check must not stop a conversion
            return False

    return check


def modal_fill(pixels: np.ndarray, bits: int = 4, least: float = 0.6) -> str | None:
    """Median colour of the most frequent quantised colour, if that has the share, else of all pixels."""
    if not len(pixels):
        return None
    q = (pixels >> bits).astype(np.int64) @ np.array([1 << 16, 1 << 8, 1])
    values, counts = np.unique(q, return_counts=True)
    best = int(counts.argmax())
    chosen = pixels[q == values[best]] if counts[best] >= least * len(q) else pixels
    return "#%02X%02X%02X" % tuple(int(v) for v in np.median(chosen.astype(float), axis=0))


def cell_fill(image: np.ndarray, cell: tuple, words: list[tuple]) -> str | None:
    """Fill of a cell from its pixels that no word box has."""
    m = box_mask([(cell[0], cell[1], cell[2] - 1, cell[3] - 1)], image.shape[:2]) & ~box_mask(words, image.shape[:2], 1)
    return modal_fill(image[m])


def overlay_background(image: np.ndarray, boxes: list[tuple], engine: str = "auto", most_share: float = 0.12) -> tuple[np.ndarray, str]:
    """(background without its text, engine used): white boxes, a membrane, or patches, by how much is masked and on what."""
    text = dilated_by_height(refined_text_mask(image, boxes), boxes)
    share = float(text.mean())
    if engine == "auto":
        engine = "fast" if share <= most_share or (share <= min(0.35, 2.5 * most_share) and flat_share(image, text) >= 0.75) else "patches"
    made = {"white": white_boxes, "fast": inpainted, "patches": lambda i, m: inpainted_by_patches(i, m, inpainted)}[engine](image, text)
    return made, engine


def region_metrics(background: np.ndarray, candidate: np.ndarray, boxes: list[tuple], pad: int = 8, rim: int = 4) -> dict[str, float]:
    """Errors of a repaired background against one without text, in the text regions and on their rims."""
    m = box_mask(boxes, background.shape[:2], pad)
    return {"region_mae": masked_mae(background, candidate, m), "rim_mae": seam_mae(background, candidate, m, rim)}
