"""Resampling against a plain version, and JPEG files decoded by Spark's image source."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismata.functions import jpeg as J
from prismata.functions import pixels as P
from prismata.sources import images as IM


def plain_resampled(x, new_h, new_w, kind):
    def kernel(d):
        d = abs(d) if kind == "cubic" else d
        if kind == "box":
            return 1.0 if -1 < 2 * d <= 1 else 0.0
        return (3 * d**3 - 5 * d**2 + 2) / 2 if d < 1 else (-(d**3) + 5 * d**2 - 8 * d + 4) / 2 if d < 2 else 0.0

    def row(v, new):
        scale = Fraction(len(v), new)
        wide, half, out = max(Fraction(1), scale), Fraction(2) if kind == "cubic" else Fraction(1, 2), []
        for k in range(new):
            c = (k + Fraction(1, 2)) * scale
            at = range(max(0, math.floor(c - half * wide + Fraction(1, 2))), min(len(v), math.floor(c + half * wide + Fraction(1, 2))))
            w = [float(kernel((i + Fraction(1, 2) - c) / wide)) for i in at]
            out.append(min(255, math.floor(min(255, max(0, round(sum(a * v[i] for a, i in zip(w, at, strict=True)) / sum(w), 9))) + 0.5)))
        return out

    h, w, c = x.shape
    wide = np.array([[row(x[i, :, k].tolist(), new_w) for k in range(c)] for i in range(h)]).transpose(0, 2, 1)
    return np.array([[row(wide[:, j, k].tolist(), new_h) for k in range(c)] for j in range(new_w)]).transpose(2, 0, 1)


@pytest.mark.parametrize(("size", "new", "kind"), [((8, 8), (4, 4), "box"), ((9, 7), (4, 3), "box"), ((13, 25), (6, 12), "box"), ((20, 31), (6, 9), "cubic"), ((5, 6), (11, 13), "cubic"), ((7, 7), (7, 3), "cubic"), ((1, 5), (3, 1), "cubic")])
def test_resampled_is_the_plain_one(size, new, kind):
    x = np.random.default_rng(2).integers(0, 256, (*size, 3)).astype(np.uint8)
    got, want = P.resampled(x, *new, kind), plain_resampled(x, *new, kind)
    assert got.shape == (*new, 3) and (got == want).all()


def test_flat_images_stay_flat_and_shrinking_looks_at_every_pixel():
    assert (P.shrunk(np.full((100, 130, 1), 77, np.uint8), 9) == 77).all()
    x = np.zeros((64, 64, 1), np.uint8)
    x[::2] = 255  # stripes of one pixel
    small = P.resampled(x, 16, 16)
    assert np.abs(small[2:-2].astype(int) - 128).max() < 12
    assert P.shrunk(np.zeros((37, 90, 1), np.uint8), 9).shape[:2] == (9, 22)


def test_crops_of_rows(spark):
    g = np.random.default_rng(3)
    rows, want = [], {}
    for k, (h, w, t, top, left) in enumerate([(8, 8, 3, 0, 0), (24, 20, 5, 1, 0), (40, 17, 8, 5, 0), (9, 9, 9, 2, 3)]):
        x = g.integers(0, 256, (h, w, 3)).astype(np.uint8)
        rows.append((k, h, w, x.ravel().tolist(), t, top, left))
        want[k] = P.shrunk(x, t)[top : top + 3, left : left + 3].ravel().tolist()
    rows.append((9, 8, 8, None, 3, 0, 0))
    df = spark.createDataFrame(rows, "id int, h int, w int, v array<int>, t int, top int, left int")
    crop = P.shrunk_crop(F.col("h"), F.col("w"), F.col("v"), F.col("t"), F.col("top"), F.col("left"), 3)
    assert {r["id"]: r["c"] for r in df.select("id", crop.alias("c")).collect()} == {**want, 9: None}
    with pytest.raises(Exception, match="a crop of 3"):
        df.where("id = 0").withColumn("top", F.lit(1)).select(crop).collect()


def smooth(h, w):
    i, j = np.mgrid[:h, :w]
    return np.stack([128 + 100 * np.sin(i / 9) * np.cos(j / 7), 128 + 90 * np.cos((i + j) / 11), 255 * i / max(1, h - 1) / 2 + 60], 2).clip(0, 255).astype(np.uint8)


def test_files_decode_to_the_image(spark, tmp_path):
    g = np.random.default_rng(5)
    images = {
        "smooth": (smooth(67, 94), 95, True, 36), "whole": (smooth(64, 80), 95, False, 40), "rough": (smooth(40, 40), 30, True, 26), "one": (np.array([[[9, 200, 31]]], np.uint8), 95, True, 34),
        "line": (smooth(1, 50), 95, True, 30), "grey": (smooth(31, 45)[..., :1], 95, True, 38), "flat": (np.full((16, 16, 3), 128, np.uint8), 95, True, 60), "black": (np.zeros((9, 9, 3), np.uint8), 95, True, 50),
        "noise": (g.integers(0, 256, (48, 48, 3)).astype(np.uint8), 100, False, 40), "best": (smooth(33, 33), 100, False, 45), "worst": (smooth(33, 33), 1, True, 12),
    }
    for name, (x, quality, halved, _) in images.items():
        (tmp_path / f"{name}.jpg").write_bytes(J.encoded(x, quality, halved))
    got = {r["path"].rsplit("/", 1)[1][:-4]: np.array(r["pixels"]).reshape(r["height"], r["width"], 3) for r in IM.decoded(spark, f"file://{tmp_path}").collect()}
    assert set(got) == set(images)
    for name, (x, _, _, least) in images.items():
        assert got[name].shape[:2] == x.shape[:2]
        error = ((got[name].astype(float) - x) ** 2).mean()
        assert error == 0 or 10 * math.log10(255**2 / error) > least, name


def test_code_lengths_fit_and_leave_the_code_of_ones():
    fibonacci = [1, 1]
    while len(fibonacci) < 40:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    for counts in ({0: 5}, {k: n for k, n in enumerate(fibonacci)}, {k: 1 for k in range(256)}, {3: 1, 7: 10**9}):
        lengths = J.code_lengths(counts)
        assert set(lengths) == set(counts) and max(lengths.values()) <= 16
        assert sum(2.0**-n for n in lengths.values()) < 1
    skewed = J.code_lengths({0: 1000, 1: 10, 2: 1})
    assert skewed[0] < skewed[1] <= skewed[2]
    assert J.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24] and J.ZIGZAG[-1] == 63


def test_what_is_no_image_or_quality_is_an_error():
    for x, q in ((np.zeros((2, 2, 2), np.uint8), 95), (np.zeros((0, 2, 3), np.uint8), 95), (np.zeros((2, 2, 3), np.uint8), 0)):
        with pytest.raises(ValueError, match="of"):
            J.encoded(x, q)


def test_tasks_write_jpeg_files(spark, tmp_path):
    x = smooth(20, 30)
    rows = spark.createDataFrame([("a/x.jpg", 20, 30, x.ravel().tolist())], "path string, h int, w int, v array<int>")
    assert IM.write_files(IM.jpeg_encoded(rows, "h", "w", "v"), f"file://{tmp_path}") == 1
    got = IM.decoded(spark, f"file://{tmp_path}", ".jpg").first()
    assert (got["height"], got["width"]) == (20, 30) and np.abs(np.array(got["pixels"]) - x.ravel()).mean() < 4
