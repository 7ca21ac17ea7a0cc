"""Encoding, counting, packing and media against the libraries and against brute force."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from prismata.llm import byte_bpe, media, packing, token_counts
from prismata.llm.word_bpe import Encoder

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
WORDS = P.path("word_bpe_49k.json")

ODD = [*"aAzZ09'’ \t\n\x0b.,!?-_=+<|>©éÉñß", "<|endoftext|>", "<|STARTOFTEXT|>", "'s", "'LL", "́", " ", " ", "İ", "ſ", "K",
       "你", "好", "😀", "‍", "Σ", "ς", "①", "½", "\x1c", "\x85", "aaaa", "0000", "  "]


def odd_texts(seed, n):
    r = random.Random(seed)
    return ["".join(r.choice(ODD) for _ in range(r.randint(0, 25))) for _ in range(n)] + ["a" * 500, "=" * 333, " " * 99, "\n" * 77, ""]


def flat(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORDS)


def tiktoken():
    import tiktoken as T

    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return T.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_word_ids_are_the_librarys():
    texts, lib = odd_texts(1, 3000), library()
    ids, at = Encoder(WORDS).ids(*flat(texts))
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == lib.encode(t, add_special_tokens=False).ids, repr(t)


def test_byte_ids_offsets_and_round_trip(spark, edge, edge_rows, empty):
    texts, enc = odd_texts(2, 400), tiktoken()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = byte_bpe.encode(docs, RANKS, P.PATTERN, with_offsets=True, with_decoded=True).collect()
    for r in got:
        text = texts[r["doc_id"]]
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert ids == enc.encode_ordinary(text), repr(text)
        assert bytes(r["decoded"]) == text.encode()
        for k, (a, b) in enumerate(zip(r["starts"], r["ends"], strict=True)):
            assert enc.decode_single_token_bytes(ids[k]) in text[a:b].encode()
    again = byte_bpe.decode(byte_bpe.encode(edge, RANKS, P.PATTERN), RANKS, P.PATTERN).collect()
    assert Counter(bytes(r["decoded"]) for r in again) == Counter((t or "").encode() for _, t, *_ in edge_rows)
    assert byte_bpe.encode(empty, RANKS, P.PATTERN).count() == 0


def test_counts_and_cache(spark, edge, edge_rows, empty, tmp_path):
    lib, cache = library(), str(tmp_path / "cache")
    want = Counter((i, len((t or "").encode()), len(lib.encode(t or "", add_special_tokens=False).ids)) for i, t, *_ in edge_rows)
    for again in (False, True):
        rows = token_counts.token_counts(edge, WORDS, cache).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in rows) == want
        assert {r["cached"] for r in rows} == {again}
        assert all(r["over_limit"] == (r["n_tokens"] > 2048) for r in rows)
    held = spark.read.parquet(cache)
    assert held.count() == held.select("content_digest").distinct().count()  # only distinct misses were appended
    assert token_counts.token_counts(empty, WORDS, cache).count() == 0


def used(patterns):
    total = Counter()
    for contents, n in patterns:
        for length, times in contents:
            total[length] += times * n
    return total


def fewest(items, capacity):
    items, best = sorted(items, reverse=True), [len(items)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for b in range(len(bins)):
            if bins[b] + items[i] <= capacity and bins[b] not in bins[:b]:
                bins[b] += items[i]
                go(i + 1, bins)
                bins[b] -= items[i]
        go(i + 1, [*bins, items[i]])

    go(0, [])
    return best[0]


def test_bin_completion_is_optimal_on_small_cases():
    r = random.Random(3)
    for _ in range(150):
        capacity = r.choice([10, 20, 50])
        items = [r.randint(1, capacity) for _ in range(r.randint(0, 10))]
        patterns = packing.pack_counts(Counter(items), capacity)
        assert used(patterns) == Counter(items)
        assert all(sum(a * b for a, b in c) <= capacity for c, _ in patterns)
        assert sum(n for _, n in patterns) == fewest(items, capacity)


def test_bin_completion_beats_best_fit_where_that_fails():
    counts = {6: 2, 5: 2, 4: 2, 3: 1, 2: 1}
    assert sum(n for _, n in packing.pack_counts(counts, 10)) == fewest(list(Counter(counts).elements()), 10)


def test_a_length_beyond_the_capacity_is_an_error():
    with pytest.raises(ValueError):
        packing.pack_counts({11: 1}, 10)


def test_pack(edge, edge_rows, empty):
    lib = library()
    rows = packing.pack(edge, WORDS).collect()
    want, total = Counter(), 0
    for i, t, *_ in edge_rows:
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 1]
        total += len(ids)
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
    assert len(places) == -(-total // 4096)
    assert packing.pack(empty, WORDS).count() == 0


@pytest.mark.parametrize("n", [0, 1, 575, 576, 577, 5000, 100_000])
def test_media_round_trip(n):
    text = bytes(i % 251 for i in range(n))
    payload = media.frames_of(text)
    assert payload.startswith(text) and set(payload[n:]) <= {255} and len(payload) % 576 == 0 and payload
    data = media.write_movie(payload)
    track = media.read_track(data)
    assert media.payload_of(data, track) == payload
    assert track["codec"] == "raw" and track["duration"] == len(payload) // 576
    assert all(data[a : a + 576] == payload[576 * k : 576 * (k + 1)] for k, a in enumerate(track["starts"].tolist()))


def test_media_walk_rejects_a_box_that_does_not_fit():
    with pytest.raises(ValueError):
        list(media.walk(memoryview(b"\0\0\0\x40moov")))


def test_media_column(edge, edge_rows, empty):
    rows = media.probe(media.media_column(edge)).collect()
    want = Counter()
    for i, t, *_ in edge_rows:
        raw = (t or "").encode()
        payload = media.frames_of(raw)
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows) == want
    assert rows[0]["key_ranges"] and rows[0]["duration_s"] > 0
    assert media.probe(media.media_column(empty)).count() == 0
    assert media.probe(media.media_column(edge).withColumn("media", F.lit(None).cast("binary"))).where("feature is null").count() == edge.count()
