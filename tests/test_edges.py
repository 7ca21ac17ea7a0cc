"""Hand-computed edge cases and properties."""

import math

import pytest
from pyspark.sql import functions as F

from prismata.functions import schedules as S
from prismata.functions import vectors as V
from prismata.operators import geometry, ledger, ordered, shard
from prismata.operators import quantize as Q
from prismata.sources import manifest


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("levels", list(Q.FSQ_LEVELS.values()))
def test_fsq_extremes_and_middle(spark, levels):
    low, high = (one(spark, Q.fsq_index(F.array(*[F.lit(s * 50.0)] * len(levels)), levels)) for s in (-1, 1))
    assert (low, high) == (0, math.prod(levels) - 1)
    zero = one(spark, Q.fsq_index(F.array(*[F.lit(0.0)] * len(levels)), levels))
    assert zero == sum(n // 2 * b for n, b in zip(levels, Q.fsq_basis(levels), strict=True))


def test_fsq_codes_give_every_index_back(spark):
    levels = Q.FSQ_LEVELS["4K"]
    rows = spark.range(math.prod(levels)).select("id", Q.fsq_codes(F.col("id"), levels).alias("c"))
    parts = [F.rint(F.get("c", i) * (n // 2)) + n // 2 for i, n in enumerate(levels)]
    back = sum((p * b for p, b in zip(parts, Q.fsq_basis(levels), strict=True)), F.lit(0))
    assert rows.where(back != F.col("id")).count() == 0


def test_time_shift_ends(spark):
    assert one(spark, S.time_shift(F.lit(0.0), F.lit(0.8))) == 0
    assert one(spark, S.time_shift(F.lit(1.0), F.lit(0.8))) == 1


def test_psnr_of_equal_images_is_infinite(spark):
    assert one(spark, V.psnr(V.mse(F.array(F.lit(1.0)), F.array(F.lit(1.0))))) == float("inf")


def test_min_snr_without_signal_is_nan(spark):
    assert math.isnan(one(spark, S.loss_weight("min_snr", F.lit(1.0))))


def test_cosine_ends(spark):
    assert one(spark, S.cosine(F.lit(0.0), 1e-4, 10, 5e-6)) == pytest.approx(1e-4)
    assert one(spark, S.cosine(F.lit(10.0), 1e-4, 10, 5e-6)) == pytest.approx(5e-6)


def test_a_side_that_rounds_to_nothing_is_null(spark):
    assert one(spark, geometry.longest_side(F.lit(500), F.lit(10), 256)[1]) is None


def test_equal_distances_take_the_lower_code(spark):
    book = spark.createDataFrame([(3, [1.0, 0.0]), (1, [1.0, 0.0])], "code int, vec array<double>")
    rows = spark.createDataFrame([(0, [1.0, 0.0])], "id int, v array<double>")
    assert Q.nearest_code(rows, book).first()["code"] == 1
    assert Q.nearest_code_arrow(rows, book).first()["code"] == 1


def test_a_large_codebook_is_refused_in_array_form(spark, monkeypatch):
    monkeypatch.setattr(Q, "ARRAY_LIMIT", 1)
    book = spark.createDataFrame([(3, [1.0, 0.0])], "code int, vec array<double>")
    with pytest.raises(ValueError):
        Q.nearest_code(book.select(F.col("vec").alias("v")), book)


def test_non_finite_vectors(spark):
    for x, ok in ((1.0, True), (float("nan"), False), (float("inf"), False)):
        assert one(spark, V.all_finite(F.array(F.lit(x)))) is ok


def test_pack_and_unpack(spark):
    v = F.array(*[F.lit(float(k)) for k in range(32)])
    assert one(spark, V.patch_unpack(V.patch_pack(v, 2, 4, 4), 2, 4, 4)) == [float(k) for k in range(32)]


def test_shards_have_one_size_and_keep_all_rows(spark):
    rows = spark.range(103)
    for seed in (None, 5):
        s = shard.shards(rows, ["id"], 7, 103, seed)
        assert {r["count"] for r in s.groupBy("rank").count().collect()} == {15}
        assert s.select("id").distinct().count() == 103


def test_batch_does_not_divide():
    with pytest.raises(ValueError):
        shard.per_rank_batch(10, 3)


def test_a_name_in_two_sets_is_an_error(spark):
    a = spark.createDataFrame([("x.jpg",)], "name string")
    with pytest.raises(ValueError):
        manifest.joined_sets({"a": a, "b": a})


def test_edit_without_source_is_ignored(spark):
    rows = spark.createDataFrame([("a_edit.jpg",), ("b.jpg",), ("c.jpg",), ("c_edit.jpg",)], "name string")
    assert [tuple(r) for r in manifest.edit_pairs(rows).collect()] == [("c.jpg", "c_edit.jpg")]


def test_missing_caption_is_an_error(spark):
    images = spark.createDataFrame([("a.jpg",)], "name string")
    with pytest.raises(Exception, match="no caption"):
        manifest.strict_captions(images, images.select("name", F.lit("x").alias("caption")).where("name = ''")).collect()


def test_class_folder(spark, tmp_path):
    for c in ("b", "a"):
        (tmp_path / "train" / c).mkdir(parents=True)
        (tmp_path / "train" / c / "1.jpg").write_bytes(b"x")
    rows = manifest.class_folder(spark, str(tmp_path), "train").orderBy("label").collect()
    assert [(r["class"], r["label"]) for r in rows] == [("a", 0), ("b", 1)]
    (tmp_path / "c.json").write_text('{"1.jpg": {"web_caption": "é"}}', encoding="utf-8")
    assert [tuple(r) for r in manifest.captions(spark, str(tmp_path / "c.json")).collect()] == [("1.jpg", "é")]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id long, v array<double>, ts int, user string, value double")
    book = spark.createDataFrame([(0, [1.0])], "code int, vec array<double>")
    assert Q.nearest_code(none, book).count() == 0
    assert ordered.running_mean(none, "value", "user", ["ts"]).count() == 0
    assert ordered.moving_average(none, "value", "user", ["ts"]).count() == 0
    assert shard.numbered(none, ["id"]).count() == 0


def test_compare_verdicts(spark):
    a = spark.createDataFrame([("w", [1.0]), ("x", [1.0]), ("y", [1.0, 2.0]), ("z", [1.0])], "name string, data array<double>")
    b = spark.createDataFrame([("w", [1.0]), ("x", [3.0]), ("y", [1.0])], "name string, data array<double>")
    assert {r["name"]: r["verdict"] for r in ledger.compare(a, b).collect()} == {"w": "equal", "x": "different", "y": "shape", "z": "missing"}
