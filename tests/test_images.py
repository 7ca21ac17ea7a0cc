"""Image files, similarity, draws, chains and checkpoints: hand-computed cases and properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismata.functions import chains as C
from prismata.functions import draws as D
from prismata.functions import images as I
from prismata.operators import checkpoints
from prismata.sources import images as IM


def test_written_pictures_come_back_red_first(spark, tmp_path):
    rows = spark.createDataFrame([("a/x.png", 1, 2, [255, 0, 0, 1, 2, 3]), ("y.png", 2, 1, [0, 255, 0, 7, 8, 9])], "path string, h int, w int, px array<int>")
    assert IM.write_files(IM.encoded(rows, "h", "w", "px"), f"file://{tmp_path}") == 2
    (tmp_path / "broken.png").write_bytes(b"no picture")
    got = {r["path"].rsplit("/", 1)[1]: (r["height"], r["width"], r["pixels"]) for r in IM.decoded(spark, f"file://{tmp_path}").collect()}
    assert got == {"x.png": (1, 2, [255, 0, 0, 1, 2, 3]), "y.png": (2, 1, [0, 255, 0, 7, 8, 9])}


def test_an_image_without_a_caption_is_an_error(spark, tmp_path):
    (tmp_path / "d" / "train").mkdir(parents=True)
    (tmp_path / "d" / "train" / "a.jpg").write_bytes(b"x")
    (tmp_path / "d" / "train" / "b.png").write_bytes(b"x")
    (tmp_path / "d" / "d_train.json").write_text('{"a.jpg": {"web_caption": "one"}, "z.jpg": {"web_caption": "two"}}')
    rows = IM.captioned_sets(spark, str(tmp_path), ["d"], "train").collect()
    assert [tuple(r) for r in rows] == [("d", "a.jpg", "one")]
    (tmp_path / "d" / "train" / "c.jpg").write_bytes(b"x")
    with pytest.raises(Exception, match="no caption"):
        IM.captioned_sets(spark, str(tmp_path), ["d"], "train").collect()


def plain_ssim(a, b):
    n, out = 49, []
    for i in range(a.shape[0] - 6):
        for j in range(a.shape[1] - 6):
            x, y = a[i : i + 7, j : j + 7].ravel(), b[i : i + 7, j : j + 7].ravel()
            c = ((x - x.mean()) * (y - y.mean())).sum() / (n - 1)
            out.append((2 * x.mean() * y.mean() + 1e-4) * (2 * c + 9e-4) / ((x.mean() ** 2 + y.mean() ** 2 + 1e-4) * (x.var(ddof=1) + y.var(ddof=1) + 9e-4)))
    return np.mean(out)


def test_similarity(spark):
    g = np.random.default_rng(3)
    a, b = g.random((9, 12, 3)), g.random((9, 12, 3))
    rows = spark.createDataFrame([(a.ravel().tolist(), b.ravel().tolist()), (a.ravel().tolist(), a.ravel().tolist())], "a array<double>, b array<double>")
    got = [r["s"] for r in rows.select(I.ssim(9, 12, 3)("a", "b").alias("s")).collect()]
    assert got[0] == pytest.approx(np.mean([plain_ssim(a[:, :, c], b[:, :, c]) for c in range(3)])) and got[1] == pytest.approx(1)
    assert rows.where("false").select(I.ssim(9, 12, 3)("a", "b")).count() == 0
    with pytest.raises(ValueError, match="no window"):
        I.ssim(6, 12)


def test_draws_depend_on_seed_and_key_alone(spark):
    rows = spark.range(4000)
    draws = lambda df, seed: {r["id"]: r["u"] for r in df.select("id", D.uniform(seed, "id").alias("u")).collect()}
    first = draws(rows, 1)
    assert first == draws(rows.repartition(7), 1) != draws(rows, 2)
    assert all(0 <= u < 1 for u in first.values()) and abs(np.mean(list(first.values())) - 0.5) < 0.02
    z = np.array([r["z"] for r in rows.select(D.normal(3, "id").alias("z")).collect()])
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05
    assert {r["n"] for r in rows.select(D.whole(F.lit(2), F.lit(4), 5, "id").alias("n")).collect()} == {2, 3, 4}


def test_flip_crop_and_paste(spark):
    v = F.array(*[F.lit(float(k)) for k in range(6)])
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(I.flipped(v, 2, 3)) == [2, 1, 0, 5, 4, 3]
    assert one(I.flipped(v, 1, 3, 2)) == [4, 5, 2, 3, 0, 1]
    assert one(I.cropped(v, 3, F.lit(0), F.lit(1), 2)) == [1, 2, 4, 5]
    assert one(I.pasted(v, 2, 3, F.lit(1), F.lit(0), 3)) == [0, 0, 0, 0, 1, 2, 3, 4, 5]
    assert one(I.to_byte_wrapped(F.lit(257.9))) == 1 and one(I.to_byte_wrapped(F.lit(-1.5))) == 255


def test_an_unknown_loss_is_an_error():
    with pytest.raises(KeyError, match="no loss"):
        C.loss("none", F.lit(1), F.lit(1))


def test_checkpoints_of_runs(spark):
    rows = [("a", 1, 3.0), ("a", 2, 1.0), ("a", 3, 1.0), ("b", 1, 2e9), ("b", 2, float("nan"))]
    got = checkpoints.checkpoint_files(spark.createDataFrame(rows, "run string, epoch int, loss double"), "run", "epoch", "loss", 2)
    assert {tuple(r) for r in got.collect()} == {
        ("a", "epoch_2_model.pth", 2), ("a", "epoch_3_model.pth", 3), ("a", "total_loss1.000.pth", 2), ("a", "latest.pth", 3), ("b", "epoch_2_model.pth", 2), ("b", "latest.pth", 2)}


def test_resizing_keeps_an_image_of_the_same_size_and_a_flat_one(spark):
    v = F.array(*[F.lit(float(k * k)) for k in range(24)])
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    assert one(I.resized(v, 3, 4, 3, 4, 2)) == pytest.approx([float(k * k) for k in range(24)])
    assert one(I.resized(F.array_repeat(F.lit(2.5), 12), 3, 4, 7, 5)) == pytest.approx([2.5] * 35)
    assert len(one(I.resized_positions(v, 2, 2, 3, 4))) == 8 + 36
