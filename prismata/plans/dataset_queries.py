"""Queries over the tables as data sets: manifests, ledgers, shards and batches.

A document stands for an image: its source for the class, its label row for the
caption, its id for the file name. Parts stand for tensors of a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ledger as L
from ..operators import ordered as O
from ..operators import shard as H
from ..sources import manifest as M

ENTRIES: dict = {}


def entry(name, sql):
    def add(f):
        ENTRIES[name] = (f, sql)
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@entry("w1_class_index", "SELECT source, (dense_rank() OVER (ORDER BY source) - 1)::INT AS label FROM (SELECT DISTINCT source FROM documents)")
def w1(spark, sf_dir):
    """Contiguous labels of the class names in order."""
    return O.class_index(table(spark, sf_dir, "documents"), "source")


@entry("j3_labelled_rows", "WITH c AS (SELECT source, dense_rank() OVER (ORDER BY source) - 1 AS label FROM (SELECT DISTINCT source FROM documents)) SELECT doc_id, label::INT AS label FROM documents JOIN c USING (source)")
def j3(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.join(O.class_index(d, "source"), "source").select("doc_id", "label")


@entry("a5_set_size", "SELECT count(*) AS n_images, count(DISTINCT source) AS n_classes FROM documents")
def a5(spark, sf_dir):
    return table(spark, sf_dir, "documents").agg(F.count(F.lit(1)).alias("n_images"), F.count_distinct("source").alias("n_classes"))


NAMES = "WITH f AS (SELECT CASE WHEN doc_id % 3 = 1 THEN printf('%06d_edit.jpg', doc_id // 3) WHEN doc_id % 3 = 2 THEN printf('%06d_mask.jpg', doc_id // 3) WHEN doc_id % 7 = 0 THEN printf('%06d.png', doc_id // 3) ELSE printf('%06d.jpg', doc_id // 3) END AS name FROM documents)"


def names(documents):
    """A file name for every document; masks have no edited sibling."""
    i = F.expr("cast(doc_id div 3 as bigint)")
    kind = F.col("doc_id") % 3
    return documents.select(F.when(kind == 1, F.format_string("%06d_edit.jpg", i)).when(kind == 2, F.format_string("%06d_mask.jpg", i)).when(F.col("doc_id") % 7 == 0, F.format_string("%06d.png", i)).otherwise(F.format_string("%06d.jpg", i)).alias("name"))


@entry("j2_edit_pairs", NAMES + " SELECT a.name AS source, b.name AS edited FROM f a JOIN f b ON b.name = replace(a.name, '.jpg', '_edit.jpg') WHERE a.name LIKE '%.jpg' AND NOT ends_with(a.name, '_edit.jpg')")
def j2(spark, sf_dir):
    """Sources with their edited sibling."""
    return M.edit_pairs(names(table(spark, sf_dir, "documents")))


@entry("x1_names", NAMES + " SELECT name, split_part(name, '.', 1) AS prefix, ends_with(name, '.jpg') AND NOT ends_with(name, '_edit.jpg') AS is_source FROM f")
def x1(spark, sf_dir):
    """File names, what stands before their first dot, and whether they are sources."""
    return names(table(spark, sf_dir, "documents")).select("name", M.prefix(F.col("name")).alias("prefix"), M.is_source(F.col("name")).alias("is_source"))


@entry("x1_url_parts", "SELECT page_id, string_split(url, '/')[-1] AS base, string_split(url, '/')[-2] AS parent FROM pages")
def x1_url(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", M.base_name(u).alias("base"), M.parent_name(u).alias("parent"))


CAPTIONS = """WITH c AS (SELECT printf('%06d', doc_id) AS name, 'q' || quality AS caption FROM labels), i AS (SELECT printf('%06d', doc_id) AS name FROM documents)"""


def _images(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.format_string("%06d", "doc_id").alias("name"))


def _captions(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select(F.to_json(F.create_map(F.format_string("%06d", "doc_id"), F.struct(F.concat(F.lit("q"), F.col("quality").cast("string")).alias("web_caption")))).alias("held"))
    return M.exploded_captions(rows, "held")


@entry("j1_captioned", CAPTIONS + " SELECT name, caption FROM i JOIN c USING (name)")
def j1(spark, sf_dir):
    """Images with captions out of JSON (S5, X9, J1), those without left to the next query."""
    named = _captions(spark, sf_dir)
    return M.strict_captions(_images(spark, sf_dir).join(named.select("name"), "name", "left_semi"), named)


@entry("j1_uncaptioned", CAPTIONS + " SELECT name FROM i ANTI JOIN c USING (name)")
def j1_missing(spark, sf_dir):
    return M.uncaptioned(_images(spark, sf_dir), _captions(spark, sf_dir))


@entry("o6_joined_sets", "SELECT 'labels' AS dataset, doc_id AS key FROM labels UNION ALL SELECT 'pages', -1 - page_id FROM pages")
def o6(spark, sf_dir):
    return M.joined_sets({"labels": table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key")),
                          "pages": table(spark, sf_dir, "pages").select((-1 - F.col("page_id")).alias("key"))}, "key").select("dataset", "key")


N = "(SELECT count(*) FROM documents)"


@entry("b1_shards", f"""WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents), p AS (SELECT doc_id, rn FROM n UNION ALL SELECT doc_id, rn + {N} FROM n WHERE rn < (7 - {N} % 7) % 7)
SELECT doc_id, rn % 7 AS rank, rn // 7 AS slot FROM p""")
def b1(spark, sf_dir):
    """Seven shards of one size, filled up from the start (B1)."""
    return H.shards(table(spark, sf_dir, "documents").select("doc_id"), ["doc_id"], 7)


@entry("b1_shards_of_rows", f"""WITH n AS (SELECT doc_id, lang, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS rn FROM documents), p AS (SELECT doc_id, lang, n_chars, rn FROM n UNION ALL SELECT doc_id, lang, n_chars, rn + {N} FROM n WHERE rn < (5 - {N} % 5) % 5)
SELECT doc_id, lang, n_chars, rn % 5 AS rank, rn // 5 AS slot FROM p""")
def b1_rows(spark, sf_dir):
    """Five shards of rows with more columns than the order has."""
    return H.shards(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), ["doc_id"], 5)


_DRAWN = "(('0x' || substr(md5('3:' || epoch || ':' || i), 1, 13))::BIGINT % n - x % n + n) % n"


@entry("b1_shuffled_shards", f"""WITH n AS (SELECT doc_id, epoch, row_number() OVER (PARTITION BY epoch ORDER BY doc_id) - 1 AS rn, count(*) OVER (PARTITION BY epoch) AS n FROM documents, (SELECT unnest(range(2)) AS epoch)),
o AS (SELECT doc_id, epoch, n, list_reduce(range(24), lambda x, i: CASE WHEN substr(md5('3:' || epoch || ':' || i || ':' || greatest(x, {_DRAWN})), 1, 1) >= '8' THEN {_DRAWN} ELSE x END, rn) AS rn FROM n),
p AS (SELECT doc_id, epoch, rn FROM o UNION ALL SELECT doc_id, epoch, rn + n FROM o WHERE rn < (7 - n % 7) % 7)
SELECT epoch::INT AS epoch, doc_id, rn % 7 AS rank, rn // 7 AS slot FROM p""")
def b1_shuffled(spark, sf_dir):
    """Two epochs of the same shards, their row numbers permuted by seed and epoch (B1)."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    one, other = (H.shards(d, ["doc_id"], 7, seed=3, epoch=k).select(F.lit(k).alias("epoch"), "doc_id", "rank", "slot") for k in (0, 1))
    return one.unionByName(other)


@entry("b3_batches", "WITH n AS (SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS rn, count(*) OVER () AS c FROM lineitem) SELECT rn // 64 AS batch_id, count(*) AS n, min(l_orderkey) AS first_key, max(l_orderkey) AS last_key FROM n WHERE rn // 64 < c // 64 GROUP BY 1")
def b3(spark, sf_dir):
    """Batches of 64 without the last, smaller one."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    b = H.batches(li, ["l_orderkey", "l_linenumber"], 64, drop_last=True)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.min("l_orderkey").alias("first_key"), F.max("l_orderkey").alias("last_key"))


@entry("b3_batches_of_rows", "WITH n AS (SELECT *, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS rn FROM lineitem) SELECT rn // 32 AS batch_id, count(*) AS n, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS quantity, count(DISTINCT flag) AS flags FROM (SELECT *, l_returnflag || l_linestatus AS flag FROM n) GROUP BY 1")
def b3_rows(spark, sf_dir):
    """Batches of 32 with the last, of whole rows."""
    b = H.batches(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], 32, drop_last=False)
    return b.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"),
                                     F.count_distinct(F.concat("l_returnflag", "l_linestatus")).alias("flags"))


@entry("a18_parameter_groups", "SELECT p_brand AS decay, p_size AS rate, list(p_name ORDER BY p_name) AS names, count(*) AS n FROM part GROUP BY 1, 2")
def a18(spark, sf_dir):
    """Names of each pair of settings."""
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("decay"), F.col("p_size").alias("rate"), "p_name")
    return L.grouped_parameters(p, "decay", "rate", "p_name")


TENSORS = "WITH t AS (SELECT p_partkey AS k, p_type AS kind, 'block.' || p_partkey || CASE WHEN p_partkey % 5 = 0 THEN '.bias' WHEN p_partkey % 7 = 0 THEN '.norm.weight' ELSE '.weight' END AS name, CASE WHEN p_partkey % 5 = 0 THEN [p_size] ELSE [p_size, 3] END AS shape, [p_retailprice, p_size::DOUBLE] AS data FROM part), m AS (SELECT name, CASE WHEN k % 11 = 0 THEN [1, 1, 1] ELSE shape END AS shape, CASE WHEN k % 13 = 0 THEN [data[1] + 0.5, data[2]] WHEN k % 17 = 0 THEN [data[1]] ELSE data END AS data FROM t WHERE k % 10 <> 3)"


def tensors(spark, sf_dir):
    k = F.col("p_partkey")
    end = F.when(k % 5 == 0, ".bias").when(k % 7 == 0, ".norm.weight").otherwise(".weight")
    size = F.col("p_size")
    t = table(spark, sf_dir, "part").select(
        k.alias("k"), F.concat(F.lit("block."), k.cast("string"), end).alias("name"),
        F.when(k % 5 == 0, F.array(size)).otherwise(F.array(size, F.lit(3))).alias("shape"), F.array("p_retailprice", size.cast("double")).alias("data"))
    d = F.col("data")
    m = t.where("k % 10 <> 3").select(
        "name", F.when(F.col("k") % 11 == 0, F.array(*[F.lit(1)] * 3)).otherwise(F.col("shape")).alias("shape"),
        F.when(F.col("k") % 13 == 0, F.array(d[0] + 0.5, d[1])).when(F.col("k") % 17 == 0, F.array(d[0])).otherwise(d).alias("data"))
    return t, m


@entry("p6_loadable", TENSORS + " SELECT t.name FROM t JOIN m ON t.name = m.name AND t.shape = m.shape WHERE NOT contains(t.name, 'norm')")
def p6(spark, sf_dir):
    """Tensors to load: name and shape as in the model, no excluded part."""
    t, m = tensors(spark, sf_dir)
    return L.loadable(t, m, ["norm"]).select("name")


@entry("j6_missing", TENSORS + " SELECT name FROM t ANTI JOIN m USING (name)")
def j6(spark, sf_dir):
    t, m = tensors(spark, sf_dir)
    return L.missing(m, t).select("name")


@entry("j5_compare", TENSORS + """ SELECT t.name, CASE WHEN m.name IS NULL THEN 'missing' WHEN len(t.data) <> len(m.data) THEN 'shape' WHEN t.data = m.data THEN 'equal' ELSE 'different' END AS verdict,
CASE WHEN len(t.data) = len(m.data) THEN round(greatest(abs(t.data[1] - m.data[1]), abs(t.data[2] - m.data[2])), 6) + 0.0 END AS max_diff FROM t LEFT JOIN m ON t.name = m.name""")
def j5(spark, sf_dir):
    t, m = tensors(spark, sf_dir)
    return L.compare(t, m).select("name", "verdict", (F.round("max_diff", 6) + 0.0).alias("max_diff"))


@entry("a22_equal_count", TENSORS + " SELECT count(*) FILTER (WHERE t.data = m.data) AS n_equal FROM t LEFT JOIN m ON t.name = m.name")
def a22(spark, sf_dir):
    t, m = tensors(spark, sf_dir)
    return L.compare(t, m).agg(F.count_if(F.col("verdict") == "equal").alias("n_equal"))


@entry("p7_parameter_group", TENSORS + " SELECT name, CASE WHEN k % 19 <> 0 THEN CASE WHEN len(shape) >= 2 AND NOT contains(name, 'norm') THEN 'decay' ELSE 'no_decay' END END AS grp FROM t")
def p7(spark, sf_dir):
    t, _ = tensors(spark, sf_dir)
    return t.select("name", L.parameter_group(F.col("name"), F.size("shape"), F.col("k") % 19 != 0, ["norm"]).alias("grp"))


@entry("a21_parameter_count", TENSORS + " SELECT round(sum(list_product(shape)) / 1e9::DOUBLE, 9) + 0.0 AS billions FROM t")
def a21(spark, sf_dir):
    t, _ = tensors(spark, sf_dir)
    return t.agg((F.round(F.sum(L.parameter_count(F.col("shape"))) / F.lit(1e9), 9) + 0.0).alias("billions"))


#: Tensor names and what they become, written out by hand.
RENAMED = {
    "encoder.down_blocks.0.resnets.0.norm1.weight": "encoder.down.0.block.0.norm1.weight",
    "encoder.down_blocks.3.resnets.1.norm1.weight": "encoder.down.3.block.1.norm1.weight",
    "encoder.down_blocks.2.resnets.0.conv_shortcut.bias": "encoder.down.2.block.0.nin_shortcut.bias",
    "encoder.down_blocks.1.downsamplers.0.conv.weight": "encoder.down.1.downsample.conv.weight",
    "encoder.mid_block.resnets.0.conv1.weight": "encoder.mid.block_1.conv1.weight",
    "encoder.mid_block.resnets.1.conv1.weight": "encoder.mid.block_2.conv1.weight",
    "encoder.mid_block.attentions.0.group_norm.weight": "encoder.mid.attn_1.norm.weight",
    "encoder.mid_block.attentions.0.to_q.weight": "encoder.mid.attn_1.q.weight",
    "encoder.mid_block.attentions.0.to_k.bias": "encoder.mid.attn_1.k.bias",
    "encoder.mid_block.attentions.0.to_v.weight": "encoder.mid.attn_1.v.weight",
    "encoder.mid_block.attentions.0.to_out.0.bias": "encoder.mid.attn_1.proj_out.bias",
    "encoder.conv_norm_out.weight": "encoder.norm_out.weight",
    "decoder.mid_block.resnets.1.norm2.bias": "decoder.mid.block_2.norm2.bias",
    "decoder.up_blocks.0.resnets.0.conv2.weight": "decoder.up.3.block.0.conv2.weight",
    "decoder.up_blocks.1.resnets.2.conv2.weight": "decoder.up.2.block.2.conv2.weight",
    "decoder.up_blocks.2.upsamplers.0.conv.bias": "decoder.up.1.upsample.conv.bias",
    "decoder.up_blocks.3.resnets.0.conv_shortcut.weight": "decoder.up.0.block.0.nin_shortcut.weight",
    "decoder.conv_in.weight": "decoder.conv_in.weight",
    "bn.running_mean": "bn.running_mean",
}
_PLAIN = {"quant_conv.weight": "quant_conv.weight", "post_quant_conv.bias": "post_quant_conv.bias"}
_CODERS = {"quant_conv.weight": "encoder.quant_conv.weight", "post_quant_conv.bias": "decoder.post_quant_conv.bias"}


def _named(pairs):
    """Each part with one of the names, and in SQL with what that name becomes."""
    values = ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(pairs.items()))
    return f"SELECT p_partkey, name, renamed FROM part JOIN (VALUES {values}) t(k, name, renamed) ON p_partkey * 7 % {len(pairs)} = k"


def _part_names(spark, sf_dir, pairs):
    at = (F.col("p_partkey") * 7 % len(pairs)).cast("int")
    return table(spark, sf_dir, "part").select("p_partkey", "p_size", F.get(F.array(*map(F.lit, pairs)), at).alias("name"))


@entry("x3_renamed_keys", _named(RENAMED | _CODERS))
def x3(spark, sf_dir):
    """Tensor names in the other layout, stages counted from the other end."""
    return _part_names(spark, sf_dir, RENAMED | _CODERS).select("p_partkey", "name", L.renamed(F.col("name")).alias("renamed"))


@entry("x4_renamed_keys_beside_coders", _named(RENAMED | _PLAIN))
def x4(spark, sf_dir):
    """The same for a layout that has the outer convolutions beside the coders."""
    return _part_names(spark, sf_dir, RENAMED | _PLAIN).select("p_partkey", "name", L.renamed(F.col("name"), quant_under_coders=False).alias("renamed"))


@entry("x5_convolution_shapes", f"""WITH t AS ({_named(RENAMED)}), s AS (SELECT p_partkey, name, CASE WHEN ends_with(name, '.bias') THEN [p_size] ELSE [p_size, 8] END AS shape FROM t JOIN part USING (p_partkey))
SELECT p_partkey, name, CASE WHEN regexp_matches(name, '\\.attentions\\.0\\.(to_q|to_v|group_norm)\\.weight$') THEN list_concat(shape, [1, 1]) ELSE shape END AS shape FROM s""")
def x5(spark, sf_dir):
    """Shapes of tensors where attention matrices become convolutions."""
    bias = F.endswith("name", F.lit(".bias"))
    rows = _part_names(spark, sf_dir, RENAMED).withColumn("shape", F.when(bias, F.array("p_size")).otherwise(F.array("p_size", F.lit(8))))
    return rows.select("p_partkey", "name", L.as_convolution(F.col("name"), F.col("shape")).alias("shape"))


@entry("j11_zip", "SELECT vec_id, round(list_sum(list_transform(list_zip(embedding, list_reverse(embedding)), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)), 6) + 0.0 AS s FROM embeddings")
def j11(spark, sf_dir):
    """Positional join of two arrays."""
    z = F.arrays_zip(F.col("embedding").cast("array<double>").alias("a"), F.reverse(F.col("embedding").cast("array<double>")).alias("b"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", z.alias("z"))
    return e.select("vec_id", (F.round(F.aggregate("z", F.lit(0.0), lambda s, p: s + p["a"] * p["b"]), 6) + 0.0).alias("s"))


@entry("k7_metric_line", "SELECT printf('epoch:%03d, mean:%.4f', 7, sum(value::DECIMAL(18,2))::DOUBLE / count(*)) AS line FROM events")
def k7(spark, sf_dir):
    """A metric as a log line."""
    m = F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count(F.lit(1))
    return table(spark, sf_dir, "events").agg(F.format_string("epoch:%03d, mean:%.4f", F.lit(7), m).alias("line"))
