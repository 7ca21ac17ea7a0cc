"""Manifests of image folders: listings, captions and edit pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, root: str, suffix: str | None = None) -> DataFrame:
    """``path, name, parent, length`` of all files below ``root``; contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if suffix:
        reader = reader.option("pathGlobFilter", f"*{suffix}")
    return reader.load(root).select("path", "length").withColumns({"name": base_name(F.col("path")), "parent": parent_name(F.col("path"))})


def class_folder(spark: SparkSession, root: str, split: str) -> DataFrame:
    """``path, class, label`` of ``root/split/class/file``; labels follow the order of class names."""
    from ..operators.ordered import class_index

    if split not in ("train", "val"):
        raise ValueError(f"unknown set {split!r}")
    rows = files(spark, f"{root}/{split}").select("path", F.col("parent").alias("class"))
    return rows.join(class_index(rows, "class"), "class").select("path", "class", "label")


def captions(spark: SparkSession, path: str, field: str = "web_caption") -> DataFrame:
    """``name, caption`` of a JSON object keyed by file name."""
    return exploded_captions(spark.read.text(path, wholetext=True), "value", field)


def exploded_captions(rows: DataFrame, column: str, field: str = "web_caption") -> DataFrame:
    held = F.from_json(column, f"map<string,struct<{field}:string>>")
    return rows.select(F.explode(held).alias("name", "v")).select("name", F.col(f"v.{field}").alias("caption"))


def strict_captions(images: DataFrame, named: DataFrame) -> DataFrame:
    """Images with captions; an image without one is an error, surplus captions are not."""
    checked = images.join(named, "name", "left")
    return checked.withColumn("caption", F.when(F.col("caption").isNull(), F.raise_error(F.concat(F.lit("no caption for "), "name"))).otherwise(F.col("caption")))


def uncaptioned(images: DataFrame, named: DataFrame) -> DataFrame:
    return images.join(named.select("name"), "name", "left_anti")


def is_source(name: Column) -> Column:
    return F.endswith(name, F.lit(".jpg")) & ~F.endswith(name, F.lit("_edit.jpg"))


def edit_pairs(rows: DataFrame, name: str = "name") -> DataFrame:
    """``source, edited``: files ``X.jpg`` whose sibling ``X_edit.jpg`` is there as well."""
    left = rows.where(is_source(F.col(name))).select(F.col(name).alias("source"))
    left = left.withColumn("edited", F.replace("source", F.lit(".jpg"), F.lit("_edit.jpg")))
    return left.join(rows.select(F.col(name).alias("edited")), "edited").select("source", "edited")


def joined_sets(sets: dict[str, DataFrame], key: str = "name") -> DataFrame:
    """The union of named sets, with ``dataset``; a key in two rows is an error."""
    whole = None
    for name, rows in sets.items():
        one = rows.withColumn("dataset", F.lit(name))
        whole = one if whole is None else whole.unionByName(one)
    twice = whole.groupBy(key).count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0][key]!r} is in more than one row")
    return whole


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_name(path: Column) -> Column:
    return F.try_element_at(F.split(path, "/"), F.lit(-2))


def prefix(name: Column) -> Column:
    """The name up to its first dot."""
    return F.split_part(name, F.lit("."), F.lit(1))
