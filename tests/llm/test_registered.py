"""The registered queries and the pipeline's stages on a table of edge cases, against brute force."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from prismata.llm import columns, entries, media, packing

from .test_audits import plain_codes, plain_divergence, plain_licenses
from .test_models import plain_spans
from .test_near_copies import brute_roots


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def edge_dir(spark, edge, tmp_path_factory):
    """Nulls, empty and very long texts, repeated rows and ids, and columns by the names that operators use."""
    d = str(tmp_path_factory.mktemp("edge"))
    docs = edge.withColumn("n_chars", F.length("text").cast("long"))
    for name in ("_id", "_key", "row_key", "bitmap", "n_lines", "found", "predicted", "length", "component_id", "id", "digest"):
        docs = docs.withColumn(name, F.lit("x"))
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2 if i % 3 else None) for i in range(16)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    vectors = [(k, [((k * 7 + j * 3) % 11) / 11 - 0.4 for j in range(64)], k % 3 or None) for k in range(40)] + [(40, None, 1), (41, [float("nan")] * 64, 1), (3, [0.25] * 64, 2), (3, [0.25] * 64, 2)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").withColumn("code", F.lit("x")).write.parquet(f"{d}/embeddings.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, edge_dir, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("none"))
    for t in ("documents", "labels", "embeddings"):
        spark.read.parquet(f"{edge_dir}/{t}.parquet").where("false").write.parquet(f"{d}/{t}.parquet")
    return d


@pytest.fixture(scope="module")
def rows(edge_rows):
    return [(i, t or "") for i, t, *_ in edge_rows]


def run(spark, name, d):
    return entries.QUERIES[name](spark, d).collect()


@pytest.mark.parametrize("name", sorted(entries.QUERIES))
def test_an_empty_table_gives_an_empty_result(spark, empty_dir, name):
    assert run(spark, name, empty_dir) == []


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_line_dedup", "op4_substring_dedup", "op8_toxicity"])
def test_every_row_has_a_result(spark, edge_dir, rows, name):
    assert Counter(r["doc_id"] for r in run(spark, name, edge_dir)) == Counter(i for i, _ in rows)


def test_op11(spark, edge_dir):
    vectors = spark.read.parquet(f"{edge_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()
    want, digest = plain_codes([(r["vec_id"], r["embedding"], r["label"]) for r in vectors])
    got = run(spark, "op11_vector_codes", edge_dir)
    assert Counter((r["vec_id"], r["code"], r["error"], r["label_error"]) for r in got) == Counter((k, "".join(f"{c:02x}" for c in code), *e) for k, code, *e in want)
    assert {r["codebooks_sha256"] for r in got} == {digest}


def test_op12(spark, edge_dir, edge_rows):
    assert sorted(map(tuple, run(spark, "op12_source_divergence", edge_dir))) == plain_divergence([(t, lang, source) for _, t, lang, source in edge_rows])


def test_op13(spark, edge_dir, rows):
    assert Counter(tuple(r) for r in run(spark, "op13_license_scans", edge_dir)) == Counter((i, *plain_licenses(t)[:7]) for i, t in rows)


def test_op3(spark, edge_dir, rows):
    import tiktoken

    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for i, t in rows:
        ids = enc.encode_ordinary(t)
        want[i, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(t)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in run(spark, "op3_byte_bpe", edge_dir)) == want


def test_op5(spark, edge_dir, rows):
    want = Counter()
    for i, t in rows:
        payload = media.frames_of(t.encode())
        data = media.write_movie(payload)
        want[i, len(t.encode()), len(payload), sha(payload), zlib.crc32(payload[-32:]), len(data), sha(data)] += 1
    got = run(spark, "op5_media_columns", edge_dir)
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["media_bytes"], r["media_sha256"]) for r in got) == want
    for r in got:
        frames = r["payload_bytes"] // 576
        assert [x["start"] for x in r["key_ranges"]] == [r["key_ranges"][0]["start"] + 576 * k for k in range(0, frames, 12)] and r["error"] is None


def test_op6(spark, edge_dir, rows):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in rows:
        n = len(lib.encode(t, add_special_tokens=False).ids)
        want[i, len(t.encode()), n, n > 2048] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in run(spark, "op6_token_counts", edge_dir)) == want


def packed(rows, texts):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = Counter()
    for i, t in texts:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        for p in range(0, len(ids), 4096):
            part = np.array(ids[p : p + 4096], "<u4")
            want[i, p // 4096, p, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in places.values():
        end = 0
        for a, n in sorted(held):
            assert a == end
            end += n
        assert end <= 4096
    return len(places)


def test_op7(spark, edge_dir, rows):
    got = run(spark, "op7_best_fit_packing", edge_dir)
    assert {(r["n_sequences"], r["least_sequences"]) for r in got} == {(packed(got, rows),) * 2}


def test_op8(spark, edge_dir):
    for r in run(spark, "op8_toxicity", edge_dir):
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5)


def test_op9(spark, edge_dir, rows):
    got = run(spark, "op9_ngram_jaccard", edge_dir)
    want = brute_roots([(i, t) for i, t in rows if i is not None], 3, 90, 100)
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == {(i, *v) for i, v in want.items()}
    assert len(got) == len(rows) and all(r["component_id"] is None for r in got if r["doc_id"] is None)


def test_op10(spark, edge_dir, rows):
    want = Counter()
    for i, t in rows:
        base = plain_spans(t)
        kinds = Counter(k for *_, k in base)
        want[i, kinds["assign"], kinds["access"], kinds["hex"], sha(",".join(f"{k}:{a}:{b}" for a, b, k in base))] += 1
    got = run(spark, "op10_secret_scans", edge_dir)
    assert Counter((r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in got) == want
    for r in got:
        held = [s.split(":") for s in r["spans"].split(",") if s]
        assert len([s for s in held if s[0] != "crf"]) == r["n_assign"] + r["n_access"] + r["n_hex"]


@pytest.mark.parametrize("which", ["edge_dir", "empty_dir"])
def test_stages_of_the_pipeline(spark, which, request):
    d = request.getfixturevalue(which)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, d).cache()
        if name != "best_fit_packing":
            assert out.columns == corpus_pipeline.COLUMNS
        after = [(r["doc_id"], r["text"]) for r in out.collect()] if name != "best_fit_packing" else []
        if name == "toxicity":
            assert not Counter(after) - Counter(before)
            assert {r["n_chars"] for r in out.collect()} <= {r["n_chars"] for r in docs.collect()}
        if name == "line_dedup":
            assert {i for i, _ in after} <= {i for i, _ in before} and {i for i, t in before if not t} <= {i for i, _ in after}
            keys = [(i, k) for i, t in after for k in {re.sub("[A-Z]", lambda m: m.group().lower(), x.strip(" \t\n\x0b\x0c\r")) for x in t.split("\n")} if len(k) >= 10]
            assert all(len({i for i, x in keys if x == k}) == 1 for _, k in keys)
        if name == "ngram_jaccard_join":
            roots = brute_roots([(i, t) for i, t in before if i is not None], 5, 80, 100) if len({i for i, _ in before}) == len(before) else None
            assert not Counter(after) - Counter(before)
            if roots:
                assert {i for i, _ in after if i is not None} == {i for i, (_, r) in roots.items() if i == r}
        if name == "secret_scans":
            assert [i for i, _ in sorted(after, key=repr)] == [i for i, _ in sorted(after, key=repr)] and len(after) == len(before)
            assert not any(plain_spans(t or "") for _, t in after)
        if name == "best_fit_packing":
            packed(out.collect(), before)
        else:
            assert all(r["n_chars"] == (len(r["text"]) if r["text"] is not None else r["n_chars"]) for r in out.collect())
        docs = out


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op6_token_counts", "op9_ngram_jaccard"])
def test_hot_keys_give_the_same_result(spark, edge_dir, sf, name, monkeypatch):
    """With every key that two rows have looked up by broadcast."""
    for d in (edge_dir, sf):
        cold = Counter(map(tuple, run(spark, name, d)))
        with monkeypatch.context() as m:
            m.setattr(columns, "HOT_ROWS", 2)
            assert Counter(map(tuple, run(spark, name, d))) == cold


def test_packing_search_cases():
    for counts, least in (({1366: 10, 1: 1500}, 5), ({2049: 20, 1: 3000}, 20), ({3: 13_650_000}, 10_000), ({1365: 10, 1: 1500}, 4), ({7: 10**6, 11: 10**6, 1: 10**6}, None), ({}, 0)):
        found = packing.solve(counts)
        used = Counter()
        for contents, n in found.patterns:
            assert sum(k * t for k, t in contents) <= 4096
            for k, t in contents:
                used[k] += t * n
        assert used == Counter(counts) and found.bound <= found.sequences
        if least is not None:
            assert found.sequences == found.bound == least


def test_packing_search_improves_on_best_fit():
    """Triples that fill sequences exactly: best fit spoils some."""
    import random

    r = random.Random(1)
    better = 0
    for n in (20, 40, 60):
        items = []
        for _ in range(n):
            a = r.randint(1100, 2000)
            b = r.randint(900, 4096 - a - 500)
            items += [a, b, 4096 - a - b]
        counts = Counter(items)
        best_fit = sum(k for _, k in packing.best_fit_decreasing(counts, 4096))
        found = packing.solve(counts)
        assert n == found.bound <= found.sequences <= best_fit
        better += found.sequences < best_fit
    assert better


def broken():
    good = media.write_movie(media.frames_of(b"x" * 3000))
    at = good.index(b"stco")
    yield b""
    yield b"\0\0\0\x40moov"
    yield good[:-9]
    yield good.replace(b"stsz", b"free")
    yield good.replace(b"stco", b"free")
    yield good[: at + 12] + b"\xff\xff\xff\xff" + good[at + 16 :]
    yield good.replace(b"moov", b"moof")
    yield bytes(range(256))


def test_broken_containers_are_rows_with_an_error(spark):
    good = media.write_movie(media.frames_of(b"x" * 3000))
    rows = [(k, 1, x) for k, x in enumerate(broken())] + [(100, 3000, good), (101, None, None)]
    got = {r["doc_id"]: r for r in media.probe(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert all(got[k]["error"] and got[k]["payload_bytes"] is None and got[k]["media_bytes"] == len(x) for k, _, x in rows[:-2])
    assert got[100]["error"] is None and got[100]["payload_bytes"] == 3456 and got[101]["media_bytes"] is None


def test_the_picture_track_is_found_among_several():
    """A sound track before it, and 64-bit chunk offsets."""
    import struct

    payload = media.frames_of(bytes(range(200)) * 20)
    movie = media.write_movie(payload)
    at = movie.index(b"trak") - 4
    size = struct.unpack(">I", movie[at : at + 4])[0]
    track = movie[at : at + size]
    sound = track.replace(b"vide", b"soun").replace(b"raw ", b"mp4a")
    co = track.index(b"stco") - 4
    n = struct.unpack(">I", track[co + 12 : co + 16])[0]
    offsets = struct.unpack(f">{n}I", track[co + 16 : co + 16 + 4 * n])
    wide = struct.pack(">I4sII", 16 + 8 * n, b"co64", 0, n) + struct.pack(f">{n}Q", *offsets)
    picture = track[:co] + wide + track[co + 16 + 4 * n :]
    for kind in (b"trak", b"mdia", b"minf", b"stbl"):  # the boxes around have grown
        p = picture.index(kind) - 4
        picture = picture[:p] + struct.pack(">I", struct.unpack(">I", picture[p : p + 4])[0] + 4 * n) + picture[p + 4 :]
    moov = movie.index(b"moov") - 4
    head = movie[moov + 8 : at]
    both = movie[:moov] + struct.pack(">I", 8 + len(head) + len(sound) + len(picture)) + b"moov" + head + sound + picture
    tracks = media.read_tracks(both)
    assert [t["codec"] for t in tracks] == ["mp4a", "raw"]
    assert media.read_track(both)["codec"] == "raw" and media.payload_of(both, media.read_track(both)) == payload
