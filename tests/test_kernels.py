import struct
import zlib

import numpy as np
import pytest

from granary.kernels import decode as D
from granary.kernels import pixels as P
from granary.kernels import segment as G


def ellipse(h, w, x1, y1, x2, y2):
    y, x = np.mgrid[:h, :w]
    return ((x - (x1 + x2) / 2) / ((x2 - x1) / 2)) ** 2 + ((y - (y1 + y2) / 2) / ((y2 - y1) / 2)) ** 2 <= 1


def paint(h, w, back, *shapes):
    img = np.full((h, w, 3), back, np.uint8)
    for mask, colour in shapes:
        img[mask] = colour
    return img


def iou(a, b):
    return (a & b).sum() / (a | b).sum()


def png(rgb, level=6, filters=0):
    h, w = rgb.shape[:2]
    raw = b"".join(bytes([0]) + rgb[y].tobytes() for y in range(h))
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


APPLE = paint(100, 100, (255, 255, 255), (ellipse(100, 100, 20, 15, 80, 85), (205, 35, 20)))


def test_otsu_against_brute_force():
    v = np.random.default_rng(7).integers(0, 256, (19, 23)).astype(np.uint8)
    score = lambda t: (v <= t).mean() * (v > t).mean() * (v[v <= t].mean() - v[v > t].mean()) ** 2 if (v <= t).any() and (v > t).any() else -1
    assert P.otsu_threshold(v) == max(range(255), key=score)
    assert P.otsu_threshold(np.repeat([[30], [220]], 20, 1).astype(np.uint8)) == 30
    assert P.otsu_threshold(np.full((3, 3), 9, np.uint8)) is None


def test_labels_against_flood_fill():
    rng = np.random.default_rng(1)
    for diagonal in (True, False):
        m = rng.random((30, 40)) < 0.45
        lab, n = P.label(m, diagonal)
        seen, count = np.zeros_like(lab), 0
        steps = [(0, 1), (0, -1), (1, 0), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
        for y, x in zip(*np.nonzero(m)):
            if not seen[y, x]:
                count += 1
                todo = [(y, x)]
                seen[y, x] = count
                while todo:
                    a, b = todo.pop()
                    for dy, dx in steps:
                        c, d = a + dy, b + dx
                        if 0 <= c < 30 and 0 <= d < 40 and m[c, d] and not seen[c, d]:
                            seen[c, d] = count
                            todo.append((c, d))
        assert n == count and (lab == seen).all()
    assert P.label(np.zeros((0, 5), bool))[1] == 0


def test_distance_and_morphology_against_brute_force():
    rng = np.random.default_rng(2)
    m = rng.random((17, 23)) < 0.8
    ys, xs = np.nonzero(~m)
    want = np.array([[np.sqrt(((ys - y) ** 2 + (xs - x) ** 2).min()) for x in range(23)] for y in range(17)])
    assert np.allclose(P.distance(m), want)
    assert np.isinf(P.distance(np.ones((4, 4), bool))).all()
    pad = np.pad(m, 1)
    assert (P.erode(m, 3) == np.array([[pad[y : y + 3, x : x + 3].all() for x in range(23)] for y in range(17)])).all()
    assert (P.dilate(m, 3) == np.array([[pad[y : y + 3, x : x + 3].any() for x in range(23)] for y in range(17)])).all()


def test_holes_and_small_parts():
    m = np.zeros((100, 100), bool)
    m[5:95, 5:95] = True
    m[10:15, 10:15] = False
    m[30:80, 30:80] = False
    assert P.fill_holes(m).sum() == 8100 and P.fill_holes(m, 100).sum() == 8100 - 2500
    m[:] = False
    m[0:3, 0:5] = m[50:60, 50:60] = True
    assert P.drop_small(m, 16).sum() == 100


def test_colour_conversions():
    rgb = np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255], [255, 255, 255], [0, 0, 0], [128, 128, 128]]], np.uint8)
    assert P.hsv_half(rgb)[0].tolist() == [[0, 255, 255], [60, 255, 255], [120, 255, 255], [0, 0, 255], [0, 0, 0], [0, 0, 128]]
    assert P.hsv_byte(rgb)[0, :3, 1].tolist() == [255] * 3 and P.gray(rgb)[0].tolist() == [76, 150, 29, 255, 0, 128]
    lab = P.lab_byte(rgb)[0].tolist()
    assert lab[3] == [255, 128, 128] and lab[4] == [0, 128, 128] and np.abs(np.array(lab[0]) - [136, 208, 195]).max() <= 1


def test_resize():
    assert (P.resize(np.full((40, 30, 3), 77, np.uint8), 7, 9) == 77).all()
    assert P.resize(np.arange(16, dtype=np.uint8).reshape(4, 4), 2, 2, "nearest").shape == (2, 2)
    assert P.working_size(600, 400, 200) == (200, 133) and P.working_size(1, 1, 160) == (1, 1) and P.working_size(30, 1, 160) == (30, 1)


@pytest.mark.parametrize("method", ["hsv", "otsu", "kmeans", "grabcut", "watershed", "hybrid", "hybrid_refined"])
def test_methods_find_the_object(method):
    truth = ellipse(100, 100, 20, 15, 80, 85)
    s = G.segment(APPLE, method)
    assert iou(s["mask"], truth) > 0.9, iou(s["mask"], truth)
    assert s["mask_status"] == "nonempty" and abs(s["foreground_fraction"] - truth.mean()) < 0.05
    assert (G.segment(APPLE, method)["mask"] == s["mask"]).all()


@pytest.mark.parametrize("method", ["hsv", "otsu", "kmeans", "grabcut", "watershed", "hybrid", "hybrid_refined"])
@pytest.mark.parametrize("shape", [(1, 1), (4, 30), (30, 1), (40, 40)])
def test_flat_and_tiny_images(method, shape):
    s = G.segment(np.full((*shape, 3), 120, np.uint8), method)
    assert s["mask"].shape == shape and not s["mask"].any() and s["mask_status"] == "empty"


def test_tray():
    truth = ellipse(200, 200, 30, 40, 90, 110) | ellipse(200, 200, 110, 90, 170, 160)
    img = paint(200, 200, (170, 175, 178), (ellipse(200, 200, 30, 40, 90, 110), (210, 40, 30)), (ellipse(200, 200, 110, 90, 170, 160), (230, 180, 30)))
    assert iou(G.segment(img, "hybrid_refined")["mask"], truth) > 0.9
    with pytest.raises(ValueError):
        G.segment(img, "nope")


def test_measures():
    y, x = np.mgrid[:200, :200]
    m = P.measure((x - 100) ** 2 + (y - 100) ** 2 <= 2500, 2.0)
    assert abs(m["equivalent_diameter_px"] - 100) < 3 and abs(m["area_px"] - 7854) < 400 and m["area"] == m["area_px"] / 4 and abs(m["perimeter_px"] - 314) < 25
    two = np.zeros((100, 200), bool)
    two[20:60, 10:60] = two[30:70, 120:180] = True
    found = P.objects(two)
    assert [o["bbox"] for o in found] == [[120, 30, 60, 40], [10, 20, 50, 40]] and found[0]["centroid"] == [149.5, 49.5]
    with pytest.raises(ValueError):
        P.measure(np.zeros((3, 3), bool))
    with pytest.raises(ValueError):
        P.measure(two, 0)


def test_hash_features_and_enhancement():
    img = np.random.default_rng(4).integers(0, 256, (40, 40, 3)).astype(np.uint8)
    h = P.perceptual_hash(img)
    assert 0 <= h < 1 << 64 and bin(h).count("1") in (31, 32) and P.perceptual_hash(np.clip(img.astype(int) + 1, 0, 255).astype(np.uint8)) ^ h < 1 << 64
    assert P.features(img).shape == (3072,) and P.features(img).dtype == np.float32
    x = P.network_input(np.full((50, 100, 3), (255, 0, 0), np.uint8))
    assert x.shape == (3, 224, 224) and x[0, 112, 112] == pytest.approx((1 - 0.485) / 0.229) and x[0, 0, 0] == pytest.approx(-0.485 / 0.229)
    flat = np.full((9, 9, 3), 80, np.uint8)
    assert (P.contrast_stretch(flat) == flat).all()
    noisy = paint(40, 40, (100, 100, 100))
    noisy[::7, ::7] = 255
    assert (P.median3(noisy) == 100).mean() > 0.98 and P.enhance(noisy)["std_before"] > 0
    assert (P.gaussian(flat, 5, 1.0) == flat).all()


def test_blemishes_and_grade():
    def apple(*extra):
        return paint(120, 120, (180, 180, 180), (ellipse(120, 120, 15, 15, 105, 105), (205, 30, 25)), *extra)

    fg = ellipse(120, 120, 15, 15, 105, 105)
    assert G.blemishes(apple(), fg)["blemish_pixels"] == 0
    b = G.blemishes(apple((ellipse(120, 120, 60, 55, 85, 80), (60, 35, 20))), fg)
    assert b["status"] == "graded" and len(b["components"]) == 1 and 0.04 < b["blemish_fraction"] < 0.12
    assert G.blemishes(apple((ellipse(120, 120, 40, 40, 55, 55), (255, 255, 255))), fg)["blemish_pixels"] == 0
    leaf = ellipse(120, 120, 45, 20, 75, 40)
    assert not (G.blemishes(apple((leaf, (40, 180, 40))), fg)["mask"] & P.erode(leaf, 3)).any()
    small = np.zeros((120, 120), bool)
    small[:5, :5] = True
    assert G.blemishes(apple(), small)["blemish_fraction"] is None
    assert [G.grade(x) for x in (0, 0.05, 0.051, 0.15, 0.151, None)] == ["Good", "Good", "Acceptable", "Acceptable", "Poor", "Not graded"]
    with pytest.raises(ValueError):
        G.grade(1.01)


def test_decoding():
    img = np.random.default_rng(4).integers(0, 256, (40, 30, 3)).astype(np.uint8)
    rgb, mode, fmt = D.decode(png(img))
    assert (rgb == img).all() and (mode, fmt) == ("RGB", "PNG")
    bmp = b"BM" + struct.pack("<IHHIIiiHHIIiiII", 0, 0, 0, 54, 40, 30, -40, 1, 24, 0, 0, 0, 0, 0, 0) + b"".join(img[y, :, ::-1].tobytes() + b"\0" * ((-90) % 4) for y in range(40))
    assert (D.decode(bmp)[0] == img).all()
    for bad in (b"not an image", b"", png(img)[:60], b"\xff\xd8\xff\xe0", b"RIFF....WEBPVP8 "):
        with pytest.raises(ValueError):
            D.decode(bad)
    assert D.orient(img, 6).shape == (30, 40, 3) and (D.orient(img, 3) == img[::-1, ::-1]).all() and (D.orient(D.orient(img, 6), 8) == img).all()


def test_png_filters():
    lines = np.random.default_rng(5).integers(0, 256, (6, 12)).astype(np.uint8)
    for kind in range(5):
        up = np.zeros(12, np.uint8)
        for line in lines:
            enc = np.zeros(12, np.uint8)
            for i in range(12):
                a, b, c = (int(line[i - 3]) if i >= 3 else 0), int(up[i]), (int(up[i - 3]) if i >= 3 else 0)
                p = a + b - c
                paeth = min((a, b, c), key=lambda v: abs(p - v))
                enc[i] = (int(line[i]) - [0, a, b, (a + b) // 2, paeth][kind]) & 255
            assert (D._unfilter(kind, enc, up, 3) == line).all()
            up = line
