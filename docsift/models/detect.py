"""Text boxes from a detector's probability map, and the strips they cut from a page; numpy only."""

from __future__ import annotations

import numpy as np

from docsift.functions.geometry import DET_LIMIT, DET_MAX_SIDE, DET_STEP, MIN_BOX


def det_size(h: int, w: int) -> tuple[int, int]:
    low, high = min(h, w), max(h, w)
    ratio = DET_LIMIT / low if low < DET_LIMIT else 1.0
    ratio = DET_MAX_SIDE / high if high * ratio > DET_MAX_SIDE else ratio
    return tuple(max(DET_STEP, int(np.rint(x * ratio / DET_STEP)) * DET_STEP) for x in (h, w))


def resize(image: np.ndarray, h: int, w: int) -> np.ndarray:
    """Bilinear, half-pixel centres; float32."""
    y, x = ((np.arange(n) + 0.5) * m / n - 0.5 for n, m in ((h, image.shape[0]), (w, image.shape[1])))
    y, x = np.clip(y, 0, image.shape[0] - 1), np.clip(x, 0, image.shape[1] - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, image.shape[0] - 1), np.minimum(x0 + 1, image.shape[1] - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    a = image.astype(np.float32)
    top, low = a[y0][:, x0] * (1 - fx) + a[y0][:, x1] * fx, a[y1][:, x0] * (1 - fx) + a[y1][:, x1] * fx
    return (top * (1 - fy) + low * fy).astype(np.float32)


def regions(mask: np.ndarray, diagonal: bool) -> list[np.ndarray]:
    """Connected sets of True as (x, y) points, by union of row runs; in order of their first row."""
    padded = np.zeros((mask.shape[0], mask.shape[1] + 2), np.int8)
    padded[:, 1:-1] = mask
    change = np.diff(padded, axis=1)
    rows, starts = np.nonzero(change == 1)
    ends = np.nonzero(change == -1)[1]
    parent = list(range(len(rows)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(rows, np.arange(mask.shape[0] + 1))
    reach = 1 if diagonal else 0
    for r in range(1, mask.shape[0]):
        a, b = int(first[r - 1]), int(first[r])
        for j in range(b, int(first[r + 1])):
            while a < b and ends[a] + reach <= starts[j]:
                a += 1
            k = a
            while k < b and starts[k] < ends[j] + reach:
                parent[max(find(j), find(k))] = min(find(j), find(k))
                k += 1
    groups: dict[int, list[int]] = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for runs in groups.values():
        edge = [(starts[i], rows[i]) for i in runs] + [(ends[i] - 1, rows[i]) for i in runs]
        out.append(np.array(edge, np.float64))
    return out


def hull(points: np.ndarray) -> np.ndarray:
    pts = np.unique(points, axis=0)
    if len(pts) < 3:
        return pts

    def half(order) -> list:
        out: list = []
        for p in order:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def min_box(points: np.ndarray) -> tuple[np.ndarray, float]:
    """Corners (top left, top right, bottom right, bottom left) of the least rectangle, and its short side."""
    h = hull(np.asarray(points, np.float64))
    if len(h) == 1:
        return np.repeat(h, 4, axis=0).astype(np.float32), 0.0
    edges = np.roll(h, -1, axis=0) - h
    angle = np.unique(np.round(np.mod(np.arctan2(edges[:, 1], edges[:, 0]), np.pi / 2), 12))
    c, s = np.cos(angle), np.sin(angle)
    u, v = h @ np.stack((c, s)), h @ np.stack((-s, c))
    low_u, high_u, low_v, high_v = u.min(0), u.max(0), v.min(0), v.max(0)
    k = int(np.argmin((high_u - low_u) * (high_v - low_v)))
    corners = np.array([[a * c[k] - b * s[k], a * s[k] + b * c[k]] for a, b in ((low_u[k], low_v[k]), (high_u[k], low_v[k]), (high_u[k], high_v[k]), (low_u[k], high_v[k]))])
    return ordered(corners), float(min(high_u[k] - low_u[k], high_v[k] - low_v[k]))


def ordered(corners: np.ndarray) -> np.ndarray:
    by_x = corners[np.argsort(corners[:, 0], kind="stable")]
    left, right = by_x[:2], by_x[2:]
    left = left if left[1, 1] > left[0, 1] else left[::-1]
    right = right if right[1, 1] > right[0, 1] else right[::-1]
    return np.array([left[0], right[0], right[1], left[1]], np.float32)


def inside(quad: np.ndarray, h: int, w: int) -> tuple[np.ndarray, int, int]:
    """Mask of a quad's pixels within its bounding box, and the box's corner."""
    q = np.asarray(quad, np.float64)
    x0, y0 = (int(np.clip(np.floor(q[:, i].min()), 0, n - 1)) for i, n in ((0, w), (1, h)))
    x1, y1 = (int(np.clip(np.ceil(q[:, i].max()), 0, n - 1)) for i, n in ((0, w), (1, h)))
    ys, xs = np.mgrid[y0 : y1 + 1, x0 : x1 + 1]
    p = np.trunc(q - [x0, y0]) + [x0, y0]
    side = np.stack([(p[(i + 1) % 4, 0] - p[i, 0]) * (ys - p[i, 1]) - (p[(i + 1) % 4, 1] - p[i, 1]) * (xs - p[i, 0]) for i in range(4)])
    return (side >= 0).all(0) | (side <= 0).all(0), x0, y0


def box_score(prob: np.ndarray, quad: np.ndarray) -> float:
    mask, x0, y0 = inside(quad, *prob.shape)
    part = prob[y0 : y0 + mask.shape[0], x0 : x0 + mask.shape[1]]
    return float(part[mask].mean()) if mask.any() else 0.0


def unclip(quad: np.ndarray, ratio: float) -> np.ndarray:
    q = quad.astype(np.float64)
    u, v = q[1] - q[0], q[3] - q[0]
    w, h = float(np.hypot(*u)), float(np.hypot(*v))
    if min(w, h) < 1e-6:
        return quad
    d = w * h * ratio / (2 * (w + h))
    a, b, c = u / w * (w / 2 + d), v / h * (h / 2 + d), q.mean(0)
    return np.array([c - a - b, c + a - b, c + a + b, c - a + b], np.float32)


def text_boxes(prob: np.ndarray, page_w: int, page_h: int, thresh: float, box_thresh: float, ratio: float, max_candidates: int = 1000, min_size: float = MIN_BOX) -> tuple[list[np.ndarray], list[float]]:
    """Quads in page pixels and their scores. Holes of a region are candidates of their own, as contours are."""
    mask = prob > thresh
    h, w = prob.shape
    outer = regions(mask, diagonal=True)
    holes = [r for r in regions(~mask, diagonal=False) if r[:, 0].min() > 0 and r[:, 1].min() > 0 and r[:, 0].max() < w - 1 and r[:, 1].max() < h - 1]
    found = sorted(outer + holes, key=lambda r: (-r[:, 1].min(), -r[:, 0].min()))[:max_candidates]
    boxes, scores = [], []
    for points in found:
        quad, short = min_box(points)
        if short < min_size or (score := box_score(prob, quad)) < box_thresh:
            continue
        quad, short = min_box(unclip(quad, ratio))
        if short < min_size + 2:
            continue
        quad = np.clip(np.round(quad / [w, h] * [page_w, page_h]), 0, [page_w, page_h]).astype(np.float32)
        if np.hypot(*(quad[0] - quad[1])) > 3 and np.hypot(*(quad[0] - quad[3])) > 3:
            boxes.append(quad)
            scores.append(score)
    return boxes, scores


def crop(image: np.ndarray, quad: np.ndarray) -> np.ndarray:
    """Upright strip of a quad by a projective map and bilinear sampling; tall ones are turned."""
    q = np.asarray(quad, np.float64)
    side = lambda i, j: float(np.hypot(*(q[i] - q[j])))
    w, h = max(1, int(max(side(0, 1), side(2, 3)))), max(1, int(max(side(0, 3), side(1, 2))))
    rows, target = [], []
    for (x, y), (u, v) in zip([(0, 0), (w, 0), (w, h), (0, h)], q, strict=True):  # strip to page
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        target += [u, v]
    m = np.append(np.linalg.lstsq(np.array(rows, float), np.array(target, float), rcond=None)[0], 1.0).reshape(3, 3)
    ys, xs = np.mgrid[0:h, 0:w]
    px, py, pz = m @ np.stack([xs.ravel(), ys.ravel(), np.ones(h * w)])
    px, py = np.clip(px / pz, 0, image.shape[1] - 1), np.clip(py / pz, 0, image.shape[0] - 1)
    x0, y0 = np.floor(px).astype(int), np.floor(py).astype(int)
    x1, y1 = np.minimum(x0 + 1, image.shape[1] - 1), np.minimum(y0 + 1, image.shape[0] - 1)
    fx, fy = (px - x0)[:, None], (py - y0)[:, None]
    a = image.astype(np.float32)
    out = (a[y0, x0] * (1 - fx) + a[y0, x1] * fx) * (1 - fy) + (a[y1, x0] * (1 - fx) + a[y1, x1] * fx) * fy
    strip = np.clip(np.rint(out), 0, 255).astype(np.uint8).reshape(h, w, -1)
    return np.rot90(strip) if h / w >= 1.5 else strip
