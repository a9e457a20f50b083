"""Pixel kernels in numpy: colour, resampling, morphology, labelling, distance, histograms, clusters, contours.

No Spark here. Images are ``uint8`` arrays of shape (h, w, 3) in RGB; masks are boolean (h, w).
"""

from __future__ import annotations

import math

import numpy as np

# --- colour ------------------------------------------------------------------------------------------------------------


def gray(rgb: np.ndarray) -> np.ndarray:
    """Luma in 16-bit fixed point: (19595 R + 38470 G + 7471 B + 32768) / 65536."""
    r, g, b = (rgb[..., i].astype(np.uint32) for i in range(3))
    return ((19595 * r + 38470 * g + 7471 * b + 32768) >> 16).astype(np.uint8)


def hsv_byte(rgb: np.ndarray) -> np.ndarray:
    """Hue, saturation and value, each 0..255."""
    x = rgb.astype(np.float64)
    hi, lo = x.max(-1), x.min(-1)
    span = hi - lo
    safe = np.where(span > 0, span, 1)
    r, g, b = ((hi - x[..., i]) / safe for i in range(3))
    h = np.where(x[..., 0] == hi, b - g, np.where(x[..., 1] == hi, 2 + r - b, 4 + g - r)) / 6.0
    h = np.where(span > 0, np.mod(h, 1.0), 0)
    s = np.where(hi > 0, span * 255.0 / np.where(hi > 0, hi, 1), 0)
    return np.stack([np.clip(h * 255, 0, 255), np.clip(s, 0, 255), hi], -1).astype(np.uint8)


def hsv_half(rgb: np.ndarray) -> np.ndarray:
    """Hue 0..180 in steps of two degrees, saturation and value 0..255, rounded."""
    x = rgb.astype(np.float64)
    hi, lo = x.max(-1), x.min(-1)
    span = hi - lo
    safe = np.where(span > 0, span, 1)
    r, g, b = (x[..., i] for i in range(3))
    h = np.where(hi == r, 60 * (g - b) / safe, np.where(hi == g, 120 + 60 * (b - r) / safe, 240 + 60 * (r - g) / safe))
    h = np.where(span > 0, np.where(h < 0, h + 360, h), 0) / 2
    s = np.where(hi > 0, span / np.where(hi > 0, hi, 1) * 255, 0)
    return np.stack([np.rint(h) % 180, np.rint(s), hi], -1).astype(np.uint8)


def lab_byte(rgb: np.ndarray) -> np.ndarray:
    """CIE Lab under D65, L scaled to 0..255, a and b shifted by 128."""
    x = rgb.astype(np.float64) / 255
    lin = np.where(x <= 0.04045, x / 12.92, ((x + 0.055) / 1.055) ** 2.4)
    # sRGB to XYZ, and the white point.
    xyz = lin @ np.array([[0.412453, 0.357580, 0.180423], [0.212671, 0.715160, 0.072169], [0.019334, 0.119193, 0.950227]]).T / np.array([0.950456, 1.0, 1.088754])
    f = np.where(xyz > 0.008856, np.cbrt(xyz), 7.787 * xyz + 16 / 116)
    lum = np.where(xyz[..., 1] > 0.008856, 116 * np.cbrt(xyz[..., 1]) - 16, 903.3 * xyz[..., 1])
    out = np.stack([lum * 255 / 100, 500 * (f[..., 0] - f[..., 1]) + 128, 200 * (f[..., 1] - f[..., 2]) + 128], -1)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


# --- resampling --------------------------------------------------------------------------------------------------------


def _weights(n: int, m: int, support: float, kernel) -> np.ndarray:
    """(m, n) antialiased weights of output pixels over input pixels."""
    scale = n / m
    stretch = max(scale, 1.0)
    centre = (np.arange(m) + 0.5) * scale
    d = (np.arange(n)[None, :] + 0.5 - centre[:, None]) / stretch
    w = np.where(np.abs(d) < support, kernel(d), 0.0)
    return w / w.sum(1, keepdims=True)


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(x), 0)


def _lanczos(x: np.ndarray) -> np.ndarray:
    return np.sinc(x) * np.sinc(x / 3)


def resize(image: np.ndarray, width: int, height: int, method: str = "bilinear") -> np.ndarray:
    """Antialiased ``bilinear`` or ``lanczos`` resampling rounded after each pass, or ``nearest`` by pixel centres."""
    h, w = image.shape[:2]
    if method == "nearest":
        ys = np.minimum((np.arange(height) + 0.5) * h / height, h - 1).astype(int)
        xs = np.minimum((np.arange(width) + 0.5) * w / width, w - 1).astype(int)
        return image[ys][:, xs]
    support, kernel = (1.0, _triangle) if method == "bilinear" else (3.0, _lanczos)
    x = image.astype(np.float64)
    if width != w:
        x = np.clip(np.rint(np.einsum("mw,hw...->hm...", _weights(w, width, support, kernel), x)), 0, 255)
    if height != h:
        x = np.clip(np.rint(np.einsum("mh,hw...->mw...", _weights(h, height, support, kernel), x)), 0, 255)
    return x.astype(np.uint8)


def working_size(width: int, height: int, cap: int) -> tuple[int, int]:
    """Longer side at most ``cap``; halves round to even."""
    scale = min(1.0, cap / max(width, height))
    return max(1, round(width * scale)), max(1, round(height * scale))


# --- morphology and labels ---------------------------------------------------------------------------------------------


def _windows(mask: np.ndarray, size: int, outside: bool) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.pad(mask, size // 2, constant_values=outside), (size, size))


def erode(mask: np.ndarray, size: int = 3, outside: bool = False) -> np.ndarray:
    """Erosion with a square; ``outside`` is what lies beyond the edge."""
    return _windows(mask, size, outside).all((-1, -2))


def dilate(mask: np.ndarray, size: int = 3) -> np.ndarray:
    return _windows(mask, size, False).any((-1, -2))


def opening(mask: np.ndarray, size: int = 3, outside: bool = False) -> np.ndarray:
    return dilate(erode(mask, size, outside), size)


def closing(mask: np.ndarray, size: int = 3, outside: bool = False) -> np.ndarray:
    return erode(dilate(mask, size), size, outside)


def label(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Components numbered from 1 in order of their first pixel. Runs are joined row by row with a union-find."""
    h, w = mask.shape
    padded = np.zeros((h, w + 2), np.int8)
    padded[:, 1:-1] = mask
    d = np.diff(padded, axis=1)
    ys, xs = np.nonzero(d == 1)
    ends = np.nonzero(d == -1)[1]
    parent = list(range(len(ys)))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first = np.searchsorted(ys, np.arange(h + 1))
    reach = int(diagonal)
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        a, b = first[y], first[y + 1]
        while i < a and j < b:
            if xs[i] < ends[j] + reach and xs[j] < ends[i] + reach:
                p, q = find(i), find(j)
                if p != q:
                    parent[max(p, q)] = min(p, q)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    out = np.zeros((h, w), np.int32)
    numbers: dict[int, int] = {}
    for i in range(len(ys)):
        root = find(i)
        out[ys[i], xs[i] : ends[i]] = numbers.setdefault(root, len(numbers) + 1)
    return out, len(numbers)


def boxes(labels: np.ndarray, n: int) -> list[tuple[slice, slice]]:
    """Rows and columns that enclose each of the labels 1 to ``n``."""
    ys, xs = np.nonzero(labels)
    at = labels[ys, xs] - 1
    low, high = np.full((2, n), np.iinfo(np.int64).max), np.full((2, n), -1)
    for axis, places in enumerate((ys, xs)):
        np.minimum.at(low[axis], at, places)
        np.maximum.at(high[axis], at, places)
    return [tuple(slice(int(low[axis, i]), int(high[axis, i]) + 1) for axis in (0, 1)) for i in range(n)]


def fill_holes(mask: np.ndarray, most: int | None = None) -> np.ndarray:
    """Background not joined (4 ways) to the edge becomes foreground; with ``most`` only holes of at most so many pixels."""
    lab, n = label(~mask, diagonal=False)
    size = np.bincount(lab.ravel(), minlength=n + 1)
    outer = np.unique(np.concatenate([lab[0], lab[-1], lab[:, 0], lab[:, -1]]))
    hole = np.ones(n + 1, bool)
    hole[outer] = False
    hole[0] = False
    if most is not None:
        hole &= size <= most
    return mask | hole[lab]


def drop_small(mask: np.ndarray, least: int) -> np.ndarray:
    """8-connected components below ``least`` pixels removed."""
    lab, n = label(mask)
    keep = np.bincount(lab.ravel(), minlength=n + 1) >= least
    keep[0] = False
    return keep[lab]


def least_area(h: int, w: int) -> int:
    """Fixed value: smallest component kept, 16 pixels or half a percent of the image."""
    return max(16, math.ceil(0.005 * h * w))


def clean(mask: np.ndarray) -> np.ndarray:
    """Edge-padded 3x3 opening and 5x5 closing, holes filled, small components dropped."""
    p = np.pad(mask, 5, mode="edge")
    p = closing(opening(p, 3), 5)[5:-5, 5:-5]
    return drop_small(fill_holes(p), least_area(*mask.shape))


def distance(mask: np.ndarray) -> np.ndarray:
    """Exact Euclidean distance of foreground pixels to the nearest background pixel; infinite without any."""
    h, w = mask.shape
    far = float(h + w) ** 2 * 4
    # distance along columns, then the lower envelope over rows by direct minimum
    g = np.where(mask, np.inf, 0.0)
    for y in range(1, h):
        g[y] = np.minimum(g[y], g[y - 1] + 1)
    for y in range(h - 2, -1, -1):
        g[y] = np.minimum(g[y], g[y + 1] + 1)
    g2 = np.where(np.isinf(g), far, g * g)
    x = np.arange(w)
    d2 = (x[:, None] - x[None, :]) ** 2
    out = np.empty((h, w))
    for y in range(h):
        out[y] = (g2[y][None, :] + d2).min(1)
    return np.where(out >= far, np.inf, np.sqrt(out))


# --- thresholds and clusters -------------------------------------------------------------------------------------------


def otsu_threshold(levels: np.ndarray) -> int | None:
    """The level, the first if several do as well, that parts the pixels into a dark and a bright class whose means differ most
    for their sizes (Otsu's between-class variance); None if all pixels have one level.

    Only occupied levels are tried, as an empty one parts the pixels like the occupied one below it.
    """
    level, count = np.unique(levels, return_counts=True)
    if len(level) < 2:
        return None
    light = level.astype(np.float64) * count
    dark_n, dark_sum = np.add.accumulate(count)[:-1].astype(np.float64), np.add.accumulate(light)[:-1]
    bright_n, bright_sum = count.sum() - dark_n, light.sum() - dark_sum
    gap = bright_sum * dark_n - dark_sum * bright_n
    return int(level[np.argmax(gap * gap / (dark_n * bright_n))])


def border_ring(h: int, w: int) -> np.ndarray:
    """Ring of five percent of the shorter side, at least one pixel."""
    r = max(1, round(0.05 * min(h, w)))
    ring = np.ones((h, w), bool)
    if h > 2 * r and w > 2 * r:
        ring[r:-r, r:-r] = False
    return ring


def otsu_mask(rgb: np.ndarray) -> tuple[np.ndarray, int | None]:
    """Foreground by Otsu: the side with fewer border pixels; on a tie the smaller one, then the bright one."""
    g = gray(rgb)
    t = otsu_threshold(g)
    if t is None:
        return np.zeros(g.shape, bool), None
    bright = g > t
    ring = border_ring(*g.shape)
    a, b = int((bright & ring).sum()), int((~bright & ring).sum())
    if a == b:
        a, b = int(bright.sum()), int((~bright).sum())
    return (bright if a <= b else ~bright), t


def kmeans_mask(rgb: np.ndarray, seed: int = 42) -> tuple[np.ndarray, int]:
    """Foreground by up to three colour clusters from a grid sample of at most 64 x 64 pixels; returns mask and cluster count.

    The background is the cluster with most border pixels, then most pixels, then the lowest number in order of colour.
    """
    h, w = rgb.shape[:2]
    ys, xs = (np.arange(m) * (n - 1) // max(m - 1, 1) for n, m in ((h, min(h, 64)), (w, min(w, 64))))
    sample = rgb[np.ix_(ys, xs)].reshape(-1, 3).astype(np.float64) / 255
    colours, counts = np.unique(sample, axis=0, return_counts=True)
    k = min(3, len(colours))
    if k < 2:
        return np.zeros((h, w), bool), k
    rng, best = np.random.default_rng(seed), None
    for _ in range(3):
        centres = [colours[rng.choice(len(colours), p=counts / counts.sum())]]
        while len(centres) < k:
            d = np.min([((colours - c) ** 2).sum(1) for c in centres], axis=0) * counts
            centres.append(colours[rng.choice(len(colours), p=d / d.sum())])
        c = np.array(centres)
        for _ in range(50):
            near = ((colours[:, None] - c[None]) ** 2).sum(2).argmin(1)
            new = np.array([np.average(colours[near == i], axis=0, weights=counts[near == i]) if (near == i).any() else c[i] for i in range(k)])
            moved = ((new - c) ** 2).sum()
            c = new
            if moved <= 1e-4 * colours.var(0).mean():
                break
        cost = (((colours[:, None] - c[None]) ** 2).sum(2).min(1) * counts).sum()
        if best is None or cost < best[0] - 1e-12:
            best = (cost, c)
    c = np.array(sorted(best[1].tolist()))
    flat, out = rgb.reshape(-1, 3), np.empty(h * w, np.int8)
    for i in range(0, len(flat), 16384):
        out[i : i + 16384] = ((flat[i : i + 16384, None].astype(np.float64) / 255 - c[None]) ** 2).sum(2).argmin(1)
    lab = out.reshape(h, w)
    at_border, everywhere = np.bincount(lab[border_ring(h, w)], minlength=k), np.bincount(lab.ravel(), minlength=k)
    ranked = np.lexsort((np.arange(k)[::-1], everywhere, at_border))
    return lab != ranked[-1], k


# --- contours and measures ---------------------------------------------------------------------------------------------

_STEPS = [(0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1)]


def outer_contours(mask: np.ndarray) -> list[np.ndarray]:
    """Outer border of every 8-connected component, traced from its first pixel: (n, 2) arrays of x, y."""
    lab, n = label(mask)
    numbers, firsts = np.unique(lab, return_index=True)
    firsts = firsts[numbers > 0]
    h, w = mask.shape
    out = []
    for number in range(1, n + 1):
        start = divmod(int(firsts[number - 1]), w)
        points, at, came = [start], start, 4
        while True:
            for turn in range(8):
                step = (came + 1 + turn) % 8
                y, x = at[0] + _STEPS[step][0], at[1] + _STEPS[step][1]
                if 0 <= y < h and 0 <= x < w and lab[y, x] == number:
                    break
            else:
                break
            if at == start and len(points) > 1 and (y, x) == points[1]:
                points.pop()
                break
            at, came = (y, x), (step + 4) % 8
            points.append(at)
        out.append(np.array([(x, y) for y, x in points]))
    return out


def polygon_area(points: np.ndarray) -> float:
    x, y = points[:, 0].astype(np.float64), points[:, 1].astype(np.float64)
    return float(abs((x * np.roll(y, -1) - y * np.roll(x, -1)).sum()) / 2)


def perimeter(points: np.ndarray) -> float:
    d = np.diff(np.vstack([points, points[:1]]).astype(np.float64), axis=0)
    return float(np.hypot(d[:, 0], d[:, 1]).sum())


def measure(mask: np.ndarray, pixels_per_unit: float | None = None) -> dict:
    """Area of all mask pixels; perimeter, box and aspect of the contour with the largest area; equivalent diameter.

    An empty mask and a scale of 0 or less are errors.
    """
    area = int(mask.sum())
    if not area:
        raise ValueError("the mask is empty")
    if pixels_per_unit is not None and pixels_per_unit <= 0:
        raise ValueError("pixels per unit must be positive")
    big = max(outer_contours(mask), key=polygon_area)
    (x1, y1), (x2, y2) = big.min(0), big.max(0)
    w, h = int(x2 - x1 + 1), int(y2 - y1 + 1)
    d = 2 * math.sqrt(area / math.pi)
    ppu = pixels_per_unit
    return {"area_px": area, "perimeter_px": perimeter(big), "bbox": [int(x1), int(y1), w, h], "aspect_ratio": w / h, "equivalent_diameter_px": d, "area": None if ppu is None else area / ppu**2, "diameter": None if ppu is None else d / ppu}


def objects(mask: np.ndarray) -> list[dict]:
    """Outer contours of at least the smallest area, by area from large to small: area, box and centre."""
    found = []
    for c in outer_contours(mask):
        a = polygon_area(c)
        if a < least_area(*mask.shape):
            continue
        x, y = c[:, 0].astype(np.float64), c[:, 1].astype(np.float64)
        cross = x * np.roll(y, -1) - y * np.roll(x, -1)
        s = cross.sum() / 2
        (x1, y1), (x2, y2) = c.min(0), c.max(0)
        cx = float(((x + np.roll(x, -1)) * cross).sum() / (6 * s)) if s else float(x1 + (x2 - x1 + 1) / 2)
        cy = float(((y + np.roll(y, -1)) * cross).sum() / (6 * s)) if s else float(y1 + (y2 - y1 + 1) / 2)
        found.append({"area": int(a), "bbox": [int(x1), int(y1), int(x2 - x1 + 1), int(y2 - y1 + 1)], "centroid": [cx, cy]})
    return sorted(found, key=lambda o: -o["area"])


# --- hashes, features and enhancement ----------------------------------------------------------------------------------


#: The eight lowest frequencies of a cosine transform of 32 samples, a row each.
_LOW_COSINES = np.cos(np.multiply.outer(range(8), range(1, 64, 2)) * (math.pi / 64))


def perceptual_hash(rgb: np.ndarray) -> int:
    """64 bits, first frequency highest: set where a low frequency of the 32 x 32 luma exceeds the median of all but the first."""
    small = resize(gray(rgb), 32, 32, "lanczos")
    strength = np.einsum("iy,yx,jx->ij", _LOW_COSINES, small.astype(np.float64), _LOW_COSINES, optimize=True).reshape(64)
    middle = np.median(np.delete(strength, 0))
    return sum(1 << (63 - place) for place in np.flatnonzero(strength > middle).tolist())


def features(rgb: np.ndarray) -> np.ndarray:
    """3072 values of the 32 x 32 image, channels interleaved, 0..1."""
    return resize(rgb, 32, 32).astype(np.float32).ravel() / np.float32(255)


def network_input(rgb: np.ndarray, side: int = 224) -> np.ndarray:
    """Letterboxed, normalised (3, side, side) input."""
    h, w = rgb.shape[:2]
    scale = side / max(w, h)
    nw, nh = max(1, round(w * scale)), max(1, round(h * scale))
    canvas = np.zeros((side, side, 3), np.uint8)
    left, top = (side - nw) // 2, (side - nh) // 2
    canvas[top : top + nh, left : left + nw] = resize(rgb, nw, nh)
    # Channel means and deviations of the pretrained backbone's training set.
    mean, std = np.array([0.485, 0.456, 0.406], np.float32), np.array([0.229, 0.224, 0.225], np.float32)
    return np.ascontiguousarray(((canvas.astype(np.float32) / np.float32(255) - mean) / std).transpose(2, 0, 1))


def median3(rgb: np.ndarray) -> np.ndarray:
    """3 x 3 median per channel, edges repeated."""
    p = np.pad(rgb, ((1, 1), (1, 1), (0, 0)), mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(p, (3, 3), axis=(0, 1)), axis=(-1, -2)).astype(np.uint8)


def gaussian(rgb: np.ndarray, size: int, sigma: float) -> np.ndarray:
    """Separable Gaussian blur, edges mirrored without repeating the edge pixel."""
    if size < 3 or size % 2 == 0 or sigma <= 0:
        raise ValueError("the size must be odd and at least 3, sigma positive")
    r = size // 2
    k = np.exp(-((np.arange(size) - r) ** 2) / (2 * sigma**2))
    k /= k.sum()
    p = np.pad(rgb.astype(np.float64), ((r, r), (r, r), (0, 0)), mode="reflect")
    p = np.lib.stride_tricks.sliding_window_view(p, size, axis=0) @ k
    p = np.lib.stride_tricks.sliding_window_view(p, size, axis=1) @ k
    return np.clip(np.rint(p), 0, 255).astype(np.uint8)


def contrast_stretch(rgb: np.ndarray, low: float = 2, high: float = 98) -> np.ndarray:
    """Each channel's percentiles to 0 and 255, cut and truncated; a flat channel stays as it is."""
    out = rgb.copy()
    for i in range(3):
        a, b = np.percentile(rgb[..., i], [low, high])
        if b > a:
            out[..., i] = np.clip((rgb[..., i].astype(np.float64) - a) * 255 / (b - a), 0, 255).astype(np.uint8)
    return out


def enhance(rgb: np.ndarray) -> dict:
    """Denoised and stretched image with the spread before and after and the mean change."""
    out = contrast_stretch(median3(rgb))
    return {"image": out, "std_before": float(rgb.std()), "std_after": float(out.std()), "mean_change": float(np.abs(out.astype(np.int16) - rgb.astype(np.int16)).mean())}
