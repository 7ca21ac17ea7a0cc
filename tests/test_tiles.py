"""Nearest codes and attention in tiles, and permuted row numbers, against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismata.functions import draws as D
from prismata.operators import quantize as Q
from prismata.operators import shard, tiles
from prismata.plans import registry

from . import oracle


@pytest.mark.parametrize("tile", [5, 64, 1000])
def test_nearest_codes_in_tiles(spark, tile):
    g = np.random.default_rng(1)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (g.standard_normal((300, 6)), g.standard_normal((64, 6))))
    y[40], x[7] = y[11], y[11]  # equal codes: the lower one wins
    rows = spark.createDataFrame([(k % 4, k, v.tolist(), "a") for k, v in enumerate(x)] + [(9, 9, None, "a")], "g int, id long, v array<double>, code string").repartition(5)
    book = spark.createDataFrame([(1000 - k, v.tolist()) for k, v in enumerate(y)], "code long, vec array<double>")
    got = {(r["g"], r["id"]): (r["code"], r["dist"]) for r in tiles.nearest_code(rows, book, ["g", "id"], tile=tile).collect()}
    want = {(r["g"], r["id"]): (r["code"], r["dist"]) for r in Q.nearest_code(rows.drop("code").where("v is not null"), book).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()} and len(got) == 300
    assert got[3, 7] == (1000 - 40, 0.0) and all(abs(got[k][1] - want[k][1]) < 1e-8 for k in got)


def _exchanged(spark):
    context = spark.sparkContext._jsc.sc()
    context.listenerBus().waitUntilEmpty(60_000)
    found = context.statusStore().executorList(False)
    return sum(found.apply(k).totalShuffleWrite() for k in range(found.size()))


def test_more_tiles_exchange_no_more(spark):
    """Rows were copied for each tile of the codebook, so what was exchanged grew with the product of both tables."""
    g = np.random.default_rng(3)
    x = g.standard_normal((800, 16))
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))], "id long, v array<double>")
    book = rows.where("id % 2 = 1").select(F.col("id").alias("code"), F.col("v").alias("vec"))
    written, found = [], []
    for tile in (400, 10):
        before = _exchanged(spark)
        found.append(sorted(map(tuple, tiles.nearest_code(rows, book, ["id"], tile=tile).collect())))
        written.append(_exchanged(spark) - before)
    assert written[1] < 1.5 * written[0], written
    assert len(found[0]) == 800 and [r[:2] for r in found[0]] == [r[:2] for r in found[1]]
    assert np.allclose([r[2] for r in found[0]], [r[2] for r in found[1]])


@pytest.mark.parametrize("block", [12, 1 << 20])
def test_blocks_and_partitions_and_odd_numbers(spark, block, monkeypatch):
    """Equal codes in several tiles and partitions, codes with null or NaN, rows with NaN, and numbers that 32 bits don't hold."""
    monkeypatch.setattr(tiles, "BLOCK", block)
    g = np.random.default_rng(4)
    y = g.standard_normal((60, 4))
    y[10:20], y[55] = y[50], [1e-9, 0, 0, 0]  # equal ones, and one that loses to all others for a far row
    x = np.concatenate([g.standard_normal((80, 4)), y[50:51], [[np.nan, 0, 0, 0]], 1e200 * g.standard_normal((3, 4)), 1e-200 * g.standard_normal((3, 4)), y[:9] + 1e-7])
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, v array<double>").repartition(3)
    codes = [(f"c{k:03}", v.tolist()) for k, v in enumerate(y)] + [("a", None), ("b", [np.nan] * 4), ("z", [np.nan] * 4)]
    book = spark.createDataFrame(codes, "code string, vec array<double>").repartition(4)
    got = {r["id"]: (r["code"], r["dist"]) for r in tiles.nearest_code(rows, book, ["id"], tile=7).collect()}
    assert len(got) == len(x)
    for k, v in enumerate(x):
        if np.isnan(v).any():
            assert got[k][0] == "b" and np.isnan(got[k][1])
            continue
        d = np.round(2 - 2 * y @ v, 9)
        assert got[k][0] == f"c{d.argmin():03}" and np.isclose(got[k][1], d.min(), rtol=1e-12, atol=1e-8), k


def test_vectors_of_several_lengths(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0, 0.0]), (2, [1.0])], "id long, v array<double>").coalesce(1)
    with pytest.raises(Exception, match="lengths|size|mismatch"):
        tiles.nearest_code(rows, rows.where("id = 1").selectExpr("id as code", "v as vec"), ["id"]).collect()


def test_large_codebook_on_odd_rows(spark, sf, tmp_path):
    """Rows and codes without a vector, with NaN, of length 0, and equal ones in several tiles, as SQL has them."""
    con = oracle.connect(sf)
    con.execute(f"""COPY (SELECT vec_id + k * 1000 AS vec_id, label, CASE WHEN vec_id IN (4, 5) THEN NULL WHEN vec_id IN (8, 9) THEN list_concat(['nan'::FLOAT], embedding[2:])
        WHEN vec_id IN (12, 13) THEN list_transform(embedding, lambda x: 0::FLOAT) ELSE embedding END AS embedding FROM embeddings, (SELECT unnest(range(3)) AS k)) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE OR REPLACE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    got = oracle.rows_of(registry.QUERIES["j7_large_codebook"](spark, str(tmp_path)))
    assert got == oracle.rows_of_sql(con, registry.ORACLE_SQL["j7_large_codebook"]) and len(got[1]) == 1500


def test_no_codebook_and_no_rows(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "id long, v array<double>")
    book = spark.createDataFrame([(3, [0.0, 1.0])], "code int, vec array<double>")
    assert tiles.nearest_code(rows, book.where("false"), ["id"]).count() == 0
    assert tiles.nearest_code(rows.where("false"), book, ["id"]).count() == 0
    twice = tiles.nearest_code(rows.union(rows), book, ["id"]).collect()
    assert [tuple(r) for r in twice] == [(1, 3, 2.0)]


@pytest.mark.parametrize("block", [16, 1000])
def test_attention_of_a_hot_sequence(spark, block):
    """One sequence holds half of all tokens; scores are great enough to overflow without a shift."""
    g = np.random.default_rng(2)
    names = ["hot"] * 120 + ["a", "b", "b", None] * 30
    tokens = [(n, k, *(g.standard_normal(4) * s for s in (30, 30, 1))) for k, n in enumerate(names)]
    rows = spark.createDataFrame([(n, k, *(v.tolist() for v in t)) for n, k, *t in tokens] + [("a", 999, None, [1.0] * 4, [1.0] * 4)], "s string, p long, q array<double>, k array<double>, v array<double>").repartition(6)
    got = {(r["sequence"], r["position"]): r["y"] for r in tiles.attention(rows.where("s is not null or p > 0"), "s", "p", scale=0.5, block=block).collect()}
    want = {}
    for name in {"hot", "a", "b"}:
        own = [t for t in tokens if t[0] == name]
        q, k, v = (np.stack([t[i] for t in own]) for i in (2, 3, 4))
        scores = 0.5 * q @ k.T
        w = np.exp(scores - scores.max(1, keepdims=True))
        want |= {(name, t[1]): y for t, y in zip(own, w @ v / w.sum(1, keepdims=True), strict=True)}
    assert {k for k in got if k[0] is not None} == set(want)
    assert all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)


@pytest.mark.parametrize("total", [1, 2, 7, 1000])
def test_permuted_numbers_are_a_permutation(spark, total):
    n = spark.range(total).select("id", D.permuted(F.col("id"), total, 5, 1).alias("a"), D.permuted(F.col("id"), total, 5, 2).alias("b"))
    rows = n.collect()
    for c in "ab":
        assert sorted(r[c] for r in rows) == list(range(total))
    if total == 1000:
        a = np.array([r["a"] for r in rows])
        assert (a == [r["b"] for r in rows]).sum() < 20 and (a == np.arange(total)).sum() < 20
        assert abs(np.corrcoef(a, np.arange(total))[0, 1]) < 0.15 and abs(np.corrcoef(a[1:], a[:-1])[0, 1]) < 0.15
        assert 200 < (np.diff(a) > 0).sum() < 800


def test_shards_of_epochs(spark):
    rows = spark.range(103)
    one, two, again = (shard.shards(rows, ["id"], 7, seed=s, epoch=e).select("id", "rank", "slot") for s, e in ((1, 0), (1, 1), (1, 0)))
    assert one.exceptAll(again).isEmpty() and one.exceptAll(two).count() > 50
    assert {r["count"] for r in one.groupBy("rank").count().collect()} == {15} and one.select("id").distinct().count() == 103
    plan = one._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan  # the rows were dealt once, in their own order
