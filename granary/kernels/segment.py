"""Eight deterministic image-to-mask methods and the surface-defect map (M0-M7, B1, B2, B4), numpy only.

Every function depends on pixels alone. Graph cuts and flooding are own implementations: they follow the described
behaviour, not the last bit of any library.
"""

from __future__ import annotations

import heapq
import math
import warnings

import numpy as np

from granary.kernels import pixels as P

# Method parameters that results depend on.
HSV = {"saturation": 0.20, "value": 0.10}
GRABCUT = {"cap": 160, "margin": 0.05, "iterations": 5, "least": 5}
WATERSHED = {"cap": 300, "least_side": 5, "core_share": 0.5, "frame": 0.02}
REFINED = {"cap": 200, "least_side": 7, "saturation": 0.30, "value": 0.10, "support": 0.03, "hole_share": 0.02, "least_core": 5}
BLEMISH = {
    "lightness": 3.0, "colour": 3.5, "mad_floor": 2.0, "min_share": 0.0003, "min_pixels": 12, "min_foreground": 200,
    "stem_area": 0.012, "stem_compactness": 0.70, "stem_centrality": 0.55, "stem_darkness": 8.0, "max_share": 0.18,
}


# --- graph cut ---------------------------------------------------------------------------------------------------------


def _gaussians(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights, means and covariances of ``k`` colour Gaussians fitted by a few k-means rounds."""
    k = max(1, min(k, len(np.unique(x[:: max(1, len(x) // 500)], axis=0))))
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(5):
        near = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[near == i].mean(0) if (near == i).any() else c[i] for i in range(k)])
    w, m, s = [], [], []
    for i in range(k):
        y = x[near == i]
        if len(y):
            w.append(len(y) / len(x))
            m.append(y.mean(0))
            s.append((np.cov(y.T, bias=True) if len(y) > 1 else np.zeros((3, 3))) + np.eye(3) * 0.5)
    return np.array(w), np.array(m), np.array(s)


def _cost(x: np.ndarray, model) -> np.ndarray:
    w, m, s = model
    total = np.zeros(len(x))
    for a, mean, cov in zip(w, m, s):
        d = x - mean
        q = np.einsum("ni,ij,nj->n", d, np.linalg.inv(cov), d)
        total += a * np.exp(-0.5 * q) / math.sqrt(np.linalg.det(cov))
    return -np.log(np.maximum(total, 1e-300))


def _min_cut(source: np.ndarray, sink: np.ndarray, right: np.ndarray, down: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Approximate minimum cut on a 4-connected grid by projected primal-dual steps; True where on the source's side.

    Minimises the total variation with edge weights ``right`` and ``down`` plus (sink - source) u over u in 0..1.
    """
    h, w = source.shape
    f = sink - source
    u = (f < 0).astype(np.float64)
    bar, px, py = u.copy(), np.zeros((h, w - 1)), np.zeros((h - 1, w))
    step = 1 / math.sqrt(8)
    scale = max(1.0, float(np.abs(f).max()) / 10)
    f, right, down = f / scale, right / scale, down / scale
    for _ in range(rounds):
        px = np.clip(px + step * (bar[:, 1:] - bar[:, :-1]), -right, right)
        py = np.clip(py + step * (bar[1:] - bar[:-1]), -down, down)
        div = np.zeros((h, w))
        div[:, :-1] += px
        div[:, 1:] -= px
        div[:-1] += py
        div[1:] -= py
        new = np.clip(u + step * (div - f), 0, 1)
        bar = 2 * new - u
        if np.abs(new - u).max() < 1e-4:
            u = new
            break
        u = new
    return u > 0.5


def graph_cut(rgb: np.ndarray, sure_bg: np.ndarray, sure_fg: np.ndarray, start: np.ndarray, iterations: int = 5, gamma: float = 50.0, seed: int = 42) -> np.ndarray:
    """Iterated colour models and minimum cuts, with pixels that are surely background or foreground held."""
    x = rgb.reshape(-1, 3).astype(np.float64)
    img = rgb.astype(np.float64)
    dr, dd = ((img[:, 1:] - img[:, :-1]) ** 2).sum(2), ((img[1:] - img[:-1]) ** 2).sum(2)
    mean = (dr.sum() + dd.sum()) / max(1, dr.size + dd.size)
    beta = 0 if mean == 0 else 1 / (2 * mean)
    right, down = gamma * np.exp(-beta * dr), gamma * np.exp(-beta * dd)
    fg, rng = start.copy(), np.random.default_rng(seed)
    for _ in range(iterations):
        if not fg.any() or fg.all():
            break
        a, b = _gaussians(x[fg.ravel()], 5, rng), _gaussians(x[~fg.ravel()], 5, rng)
        cost_fg, cost_bg = _cost(x, a).reshape(fg.shape), _cost(x, b).reshape(fg.shape)
        hard = 9 * gamma
        sink = np.where(sure_bg, hard, np.where(sure_fg, 0, cost_fg))
        source = np.where(sure_fg, hard, np.where(sure_bg, 0, cost_bg))
        new = _min_cut(source, sink, right, down)
        new = (new & ~sure_bg) | sure_fg
        if (new == fg).all():
            break
        fg = new
    return fg


def grabcut(rgb: np.ndarray) -> tuple[np.ndarray, str]:
    h, w = rgb.shape[:2]
    ww, wh = P.working_size(w, h, GRABCUT["cap"])
    small = P.resize(rgb, ww, wh) if (ww, wh) != (w, h) else rgb
    mx, my = max(1, round(ww * GRABCUT["margin"])), max(1, round(wh * GRABCUT["margin"]))
    inside = np.zeros((wh, ww), bool)
    inside[my : wh - my, mx : ww - mx] = True
    if inside.sum() < GRABCUT["least"] or (~inside).sum() < GRABCUT["least"]:
        return np.zeros((h, w), bool), "too_small"
    if (small == small[0, 0]).all():
        return np.zeros((h, w), bool), "constant"
    fg = graph_cut(small, ~inside, np.zeros_like(inside), inside, GRABCUT["iterations"])
    return P.clean(P.resize(fg, w, h, "nearest")), "ok"


def flood(rgb: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Watershed from positive ``markers`` by colour difference to the pixel flooded from; meeting pixels are -1."""
    h, w = markers.shape
    lab, img = markers.copy(), rgb.astype(np.int32)
    queue: list = []
    order = 0

    def push(y: int, x: int, fy: int, fx: int) -> None:
        nonlocal order
        heapq.heappush(queue, (int(np.abs(img[y, x] - img[fy, fx]).max()), order, y, x))
        order += 1

    queued = np.zeros((h, w), bool)
    for y, x in zip(*np.nonzero(markers > 0)):
        for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
            if 0 <= v < h and 0 <= u < w and lab[v, u] == 0 and not queued[v, u]:
                queued[v, u] = True
                push(v, u, y, x)
    while queue:
        _, _, y, x = heapq.heappop(queue)
        near = {int(lab[v, u]) for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)) if 0 <= v < h and 0 <= u < w and lab[v, u] > 0}
        lab[y, x] = near.pop() if len(near) == 1 else -1
        if lab[y, x] > 0:
            for v, u in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if 0 <= v < h and 0 <= u < w and lab[v, u] == 0 and not queued[v, u]:
                    queued[v, u] = True
                    push(v, u, y, x)
    return lab


def watershed(rgb: np.ndarray) -> tuple[np.ndarray, str]:
    h, w = rgb.shape[:2]
    ww, wh = P.working_size(w, h, WATERSHED["cap"])
    if min(ww, wh) < WATERSHED["least_side"]:
        return np.zeros((h, w), bool), "too_small"
    small = P.resize(rgb, ww, wh) if (ww, wh) != (w, h) else rgb
    coarse, t = P.otsu_mask(small)
    if t is None:
        return np.zeros((h, w), bool), "constant"
    coarse = P.opening(np.pad(coarse, 3, mode="edge"), 3)[3:-3, 3:-3]
    f = max(2, round(WATERSHED["frame"] * min(ww, wh)))
    coarse[:f] = coarse[-f:] = False
    coarse[:, :f] = coarse[:, -f:] = False
    coarse = P.drop_small(coarse, P.least_area(wh, ww))
    lab, n = P.label(coarse)
    if not n:
        return np.zeros((h, w), bool), "no_seeds"
    dist = P.distance(coarse)
    top = np.zeros(n + 1)
    np.maximum.at(top, lab.ravel(), np.where(coarse, dist, 0).ravel())
    cores, _ = P.label(coarse & (dist >= WATERSHED["core_share"] * top[lab]))
    grown = coarse
    for _ in range(3):
        grown = P.dilate(grown, 3)
    markers = np.where(cores > 0, cores + 1, 0)
    background = ~grown
    background[:f] = background[-f:] = True
    background[:, :f] = background[:, -f:] = True
    markers[background & (markers == 0)] = 1
    return P.clean(P.resize(flood(small, markers) > 1, w, h, "nearest")), "ok"


def hybrid_refined(rgb: np.ndarray) -> tuple[np.ndarray, str, float]:
    """Mask, state, and the share of the working picture that colour alone would take."""
    h, w = rgb.shape[:2]
    ww, wh = P.working_size(w, h, REFINED["cap"])
    if min(ww, wh) < REFINED["least_side"]:
        return np.zeros((h, w), bool), "too_small", 0.0
    small = P.resize(rgb, ww, wh) if (ww, wh) != (w, h) else rgb
    if (small == small[0, 0]).all():
        return np.zeros((h, w), bool), "constant", 0.0
    hsv = P.hsv_byte(small) / 255
    colour = P.opening((hsv[..., 1] >= REFINED["saturation"]) & (hsv[..., 2] >= REFINED["value"]), 5)
    least = P.least_area(wh, ww)
    colour = P.drop_small(colour, least)
    most = max(9, int(REFINED["hole_share"] * ww * wh))
    candidate = P.fill_holes(colour, most)
    core = P.erode(colour, 3)
    if not candidate.any() or core.sum() < REFINED["least_core"]:
        return np.zeros((h, w), bool), "no_colour_seeds", float(candidate.mean())
    support = P.distance(~candidate) <= max(3, round(REFINED["support"] * max(ww, wh)))
    support[0] = support[-1] = False
    support[:, 0] = support[:, -1] = False
    fg = graph_cut(small, ~support, core & support, candidate & support, GRABCUT["iterations"])
    fg = P.fill_holes(P.drop_small(P.closing(fg, 3), least), most) & support
    return P.resize(fg, w, h, "nearest"), "ok", float(candidate.mean())


def segment(rgb: np.ndarray, method: str, known: dict[str, dict] | None = None) -> dict:
    """``mask``, ``foreground_fraction``, ``mask_status`` and ``detail`` of one image under one method.

    ``known`` has the results of other methods on the same image, so that a hybrid doesn't compute its parts again.
    """
    h, w = rgb.shape[:2]
    detail: dict = {}
    if method == "baseline":
        return {"mask": np.ones((h, w), bool), "foreground_fraction": 1.0, "mask_status": "not_segmented", "detail": detail}
    if method == "hsv":
        hsv = P.hsv_byte(rgb) / 255
        mask = P.clean((hsv[..., 1] >= HSV["saturation"]) & (hsv[..., 2] >= HSV["value"]))
    elif method == "otsu":
        raw, detail["otsu_threshold"] = P.otsu_mask(rgb)
        mask = P.clean(raw) if raw.any() else raw
    elif method == "kmeans":
        raw, detail["clusters"] = P.kmeans_mask(rgb)
        mask = P.clean(raw) if raw.any() else raw
    elif method == "grabcut":
        mask, detail["state"] = grabcut(rgb)
    elif method == "watershed":
        mask, detail["state"] = watershed(rgb)
    elif method == "hybrid":
        a, b = ((known or {}).get(m, {}).get("mask") for m in ("hsv", "grabcut"))
        a, b = segment(rgb, "hsv")["mask"] if a is None else a, segment(rgb, "grabcut")["mask"] if b is None else b
        mask, either = a | b, int((a | b).sum())
        detail = {"hsv_fraction": float(a.mean()), "grabcut_fraction": float(b.mean()), "intersection": float((a & b).mean()), "disagreement": float((a ^ b).mean()), "jaccard": float((a & b).sum() / either) if either else 1.0}
    elif method == "hybrid_refined":
        mask, detail["state"], broad = hybrid_refined(rgb)
        detail["refined_review_flag"] = "inspect_mask" if broad <= 0.85 and mask.any() else "broad_colour_candidates" if mask.any() else "no_foreground"
    else:
        raise ValueError(f"unknown method {method!r}")
    share = float(mask.mean())
    return {"mask": mask, "foreground_fraction": share, "mask_status": "empty" if share == 0 else "near_full" if share > 0.98 else "nonempty", "detail": detail}


# --- surface defects ---------------------------------------------------------------------------------------------------


def robust_z(values: np.ndarray, floor: float = BLEMISH["mad_floor"]) -> np.ndarray:
    if not values.size:
        return values.astype(np.float64)
    m = np.median(values)
    return (values - m) / max(1.4826 * float(np.median(np.abs(values - m))), floor)


def blemishes(rgb: np.ndarray, fg: np.ndarray) -> dict:
    """Defect mask inside the foreground with counts and the kept components; ungraded below 200 foreground pixels."""
    n = int(fg.sum())
    none = {"mask": np.zeros(fg.shape, bool), "foreground_pixels": n, "blemish_pixels": 0, "blemish_fraction": None, "status": "too_small_foreground", "components": [], "removed_tiny": 0, "removed_large": 0, "removed_stem": 0}
    if n < BLEMISH["min_foreground"]:
        return none
    lab, hsv = P.lab_byte(rgb).astype(np.float64), P.hsv_half(rgb).astype(int)
    z = np.zeros((*fg.shape, 3))
    for i in range(3):
        z[..., i][fg] = robust_z(lab[..., i][fg])
    dark, colour = -z[..., 0], np.hypot(z[..., 1], z[..., 2])
    glare = (hsv[..., 2] > 210) & (hsv[..., 1] < 50)
    leaf = (hsv[..., 0] >= 35) & (hsv[..., 0] <= 85) & (hsv[..., 1] > 45)
    hit = fg & ((dark > BLEMISH["lightness"]) | (colour > BLEMISH["colour"])) & ~glare & ~leaf
    hit = P.closing(P.opening(hit, 3, outside=True), 3, outside=True) & fg
    labels, count = P.label(hit)
    h, w = fg.shape
    least = max(BLEMISH["min_pixels"], math.ceil(BLEMISH["min_share"] * n))
    keep, removed = np.zeros(count + 1, bool), {"tiny": 0, "large": 0, "stem": 0}
    components, boxes = [], P.boxes(labels, count)
    for i in range(1, count + 1):
        box = boxes[i - 1]
        part = labels[box] == i
        ys, xs = np.nonzero(part)
        area = len(ys)
        edge = P.perimeter(max(P.outer_contours(part), key=len))
        ys, xs = ys + box[0].start, xs + box[1].start
        compact = 4 * math.pi * area / edge**2 if edge else 0.0
        cx, cy = float(xs.mean()), float(ys.mean())
        central = 1 - min(math.hypot(cx - w / 2, cy - h / 2) / (min(w, h) / 2), 1)
        depth = float(dark[box][part].mean())
        if area < least:
            removed["tiny"] += 1
        elif area / n > BLEMISH["max_share"]:
            removed["large"] += 1
        elif area / n <= BLEMISH["stem_area"] and central >= BLEMISH["stem_centrality"] and compact >= BLEMISH["stem_compactness"] and depth <= BLEMISH["stem_darkness"]:
            removed["stem"] += 1
        else:
            keep[i] = True
            components.append({"area": area, "bbox": [int(xs.min()), int(ys.min()), int(xs.max() - xs.min() + 1), int(ys.max() - ys.min() + 1)], "centrality": central, "compactness": compact, "darkness": depth})
    mask = keep[labels]
    px = int(mask.sum())
    return {**none, "mask": mask, "blemish_pixels": px, "blemish_fraction": px / n, "status": "graded", "components": components, **{f"removed_{k}": v for k, v in removed.items()}}


def grade(fraction: float | None, status: str = "graded") -> str:
    if status != "graded" or fraction is None:
        return "Not graded"
    if not 0 <= fraction <= 1:
        raise ValueError("fraction outside 0..1")
    return "Good" if fraction <= 0.05 else "Acceptable" if fraction <= 0.15 else "Poor"


def surface(rgb: np.ndarray, method: str = "hybrid_refined") -> dict:
    """Denoise, segment, map defects on the denoised picture, detect and measure objects, grade."""
    calm = P.median3(rgb)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        seg = segment(calm, method)
        b = blemishes(calm, seg["mask"])
    found = P.objects(seg["mask"])
    m = P.measure(seg["mask"]) if seg["mask"].any() else None
    return {
        "foreground_pixels": b["foreground_pixels"], "blemish_pixels": b["blemish_pixels"], "blemish_fraction": b["blemish_fraction"], "blemish_status": b["status"],
        "blemish_components": len(b["components"]), "stem_cavity_removed": b["removed_stem"], "quality_grade": grade(b["blemish_fraction"], b["status"]), "mask_status": seg["mask_status"],
        "objects_detected": len(found), "largest_area_px": found[0]["area"] if found else None, "equivalent_diameter_px": m and m["equivalent_diameter_px"], "perimeter_px": m and m["perimeter_px"],
    }
