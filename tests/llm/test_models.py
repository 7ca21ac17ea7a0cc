"""The classifier, the secret scanner and the pipeline."""

import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from prismata.llm import secrets, toxicity


@pytest.fixture(scope="module")
def labelled(spark):
    import random

    r = random.Random(6)
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu", "ra", "te") for b in ("d", "f", "g", "lm", "np", "st")]
    rows = []
    for i in range(600):
        t = [r.choice(words) for _ in range(r.randrange(5, 60))]
        bad = i % 4 == 0
        for _ in range(2 if bad else 0):
            t.insert(r.randrange(len(t)), r.choice(["grobian", "Schuft!", "lump"]))
        rows.append((i, " ".join(t), "en" if i % 2 else "de", int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


@pytest.fixture(scope="module")
def model(labelled):
    return toxicity.train(labelled.drop("toxic"), labelled.select("doc_id", "toxic"))


def test_held_out_accuracy(labelled, model):
    rows = toxicity.score(labelled, model).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum(r["predicted"] == r["toxic"] for r in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)


def test_equal_texts_have_equal_scores(spark, model):
    rows = [(1, "Schuft lump", "en"), (2, "Schuft lump", "de"), (3, "", None), (4, None, "en"), (5, "12 34", "en")]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()}
    assert got[1] == got[2] > 0.5 and got[3] == got[4] == got[5] < 0.5


def test_pooling_is_that_of_each_text_alone():
    m = toxicity.Model()
    g = np.random.default_rng(1)
    m.table = g.normal(size=m.table.shape).astype(np.float32)
    texts = [b"", b"one", b"one two", b"one two three four", b"", b"five one two", b"x"]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    index, words, first = toxicity.hashed_words(data, offsets)
    table = m.table[toxicity.buckets(words)].sum(1)
    got = m.pooled(table, index, first)
    for i in range(len(texts)):
        e = table[index[first[i] : first[i + 1]]]
        want = []
        for taps, bias in zip(m.filters, m.bias, strict=True):
            padded = np.concatenate([e, np.zeros((toxicity.PAD, toxicity.DIM), np.float32)])
            r = [sum(padded[t + j] @ w for j, w in enumerate(taps)) for t in range(len(e))]
            want += list(np.maximum(np.max(r, 0) + bias, 0)) if r else [0.0] * toxicity.FILTERS
        assert np.allclose(got[i], want, atol=1e-4)


def test_without_labels_of_both_classes(edge, empty, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    m = toxicity.train(edge, none)
    assert toxicity.score(edge, m).where("predicted = 1").count() == 0
    assert toxicity.score(empty, m).count() == 0


def plain_spans(text):
    """The base spans, read straight from their definition."""
    out = []
    for kind, pattern, least, group in (
        ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
        ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]+", 24, 0),
    ):
        flags = re.IGNORECASE | re.ASCII if kind == "assign" else 0
        out += [(m.start(), m.end(), kind) for m in re.finditer(pattern, text, flags) if len(m.group(group)) >= least]
    return sorted(out, key=lambda s: (s[0], ("assign", "access", "hex").index(s[2])))


def test_base_spans():
    import random

    r = random.Random(8)
    parts = ["password", "PassWd", "secret", "ſecret", "token", "toKen", "api_key", "APIKEY", "=", ":", " ", '"', "'", "abc", "x1", "AKIA", "ABCDEFGH12345678", "0123456789ab", "deadbeef", "\n", "é😀"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(14)))
        assert secrets.base_spans(text) == plain_spans(text), text
        if plain_spans(text):
            assert re.search(secrets._HINT, text, re.ASCII)


def test_viterbi_by_islands_is_the_best_path():
    g = np.random.default_rng(2)
    field = secrets.Field()
    field.trained = True
    for _ in range(30):
        field.move = g.normal(size=(3, 3))
        lengths = g.integers(0, 6, 5)
        first = np.concatenate([[0], np.cumsum(lengths)])
        score = g.normal(size=(first[-1], 3)) * 6 + np.array([4.0, 0, 0])
        tags = field.tags(score, first)
        value = lambda t, s: sum(s[k, x] for k, x in enumerate(t)) + sum(field.move[a, b] for a, b in itertools.pairwise(t))
        for a, b in itertools.pairwise(first):
            best = max((value(t, score[a:b]) for t in itertools.product(range(3), repeat=int(b - a))), default=0)
            assert value(tags[a:b], score[a:b]) == pytest.approx(best)


def test_expectations_of_the_field():
    g = np.random.default_rng(3)
    field = secrets.Field()
    field.move = g.normal(size=(3, 3))
    score = g.normal(size=(1, 4, 3))
    marginal, pairs = field._expect(score, np.ones((1, 4), bool))
    paths = list(itertools.product(range(3), repeat=4))
    p = np.exp([sum(score[0, k, x] for k, x in enumerate(t)) + sum(field.move[a, b] for a, b in itertools.pairwise(t)) for t in paths])
    p /= p.sum()
    want = np.zeros((4, 3))
    for t, q in zip(paths, p, strict=True):
        for k, x in enumerate(t):
            want[k, x] += q
    assert np.allclose(marginal[0], want) and pairs.sum() == pytest.approx(3)


@pytest.fixture(scope="module")
def scanned(spark):
    import random

    r = random.Random(9)
    rows = []
    for i in range(300):
        w = [r.choice(["alpha", "beta", "gamma", "delta", "2024", "word,"]) for _ in range(40)]
        if i % 3 == 0:
            w.insert(20, f"password={r.randrange(16**12):012x}")
        if i % 3 == 1:
            w.insert(20, "AKIA" + "".join(r.choice("ABCDEFGH23456789") for _ in range(16)))
        rows.append((i, " ".join(w)))
    rows.append((999, "alpha beta passwort=0a1b2c3d4e5f gamma é"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = secrets.train(docs)
    return docs, field, secrets.scan(docs, field)


def test_scan_keeps_base_spans_and_leaves_clean_texts_alone(scanned):
    docs, field, found = scanned
    assert field.trained
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in found.collect():
        base = [(s["start"], s["end"], s["kind"]) for s in r["secrets"] if s["kind"] != "crf"]
        assert base == plain_spans(text[r["doc_id"]])
        if r["doc_id"] < 300 and r["doc_id"] % 3 == 2:
            assert not r["secrets"]


def test_redaction(scanned):
    _, _, found = scanned
    for r in secrets.redact(found).where("doc_id < 300").collect():
        assert not plain_spans(r["text"]) and (r["doc_id"] % 3 == 2) == ("[SECRET]" not in r["text"])
    assert secrets.redacted("abcdef", [(1, 3), (2, 4), (5, 6)], "*") == "a*e*"


def test_scan_edges(edge, empty):
    untrained = secrets.Field()
    rows = secrets.scan(edge, untrained).collect()
    assert len(rows) == edge.count()
    assert {s["kind"] for r in rows if r["doc_id"] == 14 for s in r["secrets"]} == {"assign", "access", "hex"}
    assert secrets.scan(empty, secrets.train(empty)).count() == 0
    assert secrets.redact(secrets.scan(edge, untrained)).where("doc_id = 4 and text is null").count() == 1


def test_pipeline_stages(spark, sf):
    """Each stage against what it should keep of its own input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        out = stage(spark, docs, sf)
        if name != "best_fit_packing":
            assert out.columns == corpus_pipeline.COLUMNS
            out = out.cache()
            after = {r["doc_id"]: r["text"] for r in out.collect()}
            assert set(after) <= set(before)
        if name == "line_dedup":
            seen = set()
            for i in sorted(before):
                keys = [x.strip(" \t\n\x0b\x0c\r") for x in (before[i] or "").split("\n")]
                keys = [re.sub("[A-Z]", lambda m: m.group().lower(), k) for k in keys]
                kept = [x for x, k in zip((before[i] or "").split("\n"), keys, strict=True) if len(k) < 10 or k not in seen]
                seen |= {k for k in keys if len(k) >= 10}
                assert ("\n".join(kept) == after[i]) if kept else i not in after
        if name == "ngram_jaccard_join":
            from .test_dedup import brute_components

            want = brute_components(sorted(before.items()))
            assert set(after) == {i for i in before if want[i][1] == i}
        if name == "secret_scans":
            assert set(after) == set(before) and not any(plain_spans(t or "") for t in after.values())
        if name == "best_fit_packing":
            rows = out.collect()
            assert {r["doc_id"] for r in rows} == set(before)
            total = sum(r["length"] for r in rows)
            assert len({r["sequence_id"] for r in rows}) == -(-total // 4096)
        docs = out


def test_run_counts(spark, sf):
    rows = corpus_pipeline.run(spark, sf)
    assert rows.where(F.col("length") > 4096).count() == 0 and rows.count() > 0


def test_thresholds_are_calibrated_by_language():
    """A language whose scores run higher gets a higher threshold; one with too few rows gets none."""
    g = np.random.default_rng(4)
    m = toxicity.Model()
    labels = np.array([0, 1] * 60 + [0, 1] * 60 + [0, 1] * 3)
    lang = ["en"] * 120 + ["de"] * 120 + ["fr"] * 6
    z = np.where(labels == 1, 2.0, -2.0) + g.normal(0, 0.3, len(labels)) + np.array([0.0] * 120 + [3.0] * 120 + [0.0] * 6)
    m.calibrate(z, labels, np.ones(len(z)), lang)
    assert set(m.thresholds) == {"en", "de"} and m.thresholds["de"] > m.thresholds["en"]


def test_the_field_finds_what_the_patterns_do_not(spark):
    """Key words, separators and formats that neither the patterns nor the training variants have; and no span in clean texts."""
    import random

    r = random.Random(12)
    words = [f"{a}{b}" for a in ("ba", "ke", "lo", "mi", "nu", "ra", "te") for b in ("den", "fir", "gor", "lmi", "nip", "stu")]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    rows = [(i, f"{prose(20)} token = \"{r.randrange(16**40):040x}\" {prose(20)}" if i % 3 == 0 else f"{prose(30)} {r.randrange(10**6)} {prose(10)}, a.{i}@mail.example.com") for i in range(300)]
    forms = (("passwort=", ""), ('"access-key": "', '"'), ("export GH=ghp_", ""), ("passphrase: ", ""), ("client_key = ", ""))
    planted = []
    for k, (before, after) in enumerate(forms * 8):
        value = "".join(r.choices(alnum, k=32))
        head = f"{prose(20)} {before}"
        planted.append((1000 + k, f"{head}{value}{after} {prose(20)}", len(head), 32))
    docs = spark.createDataFrame(rows + [(i, t) for i, t, *_ in planted], "doc_id long, text string")
    field = secrets.train(docs.where("doc_id < 1000"))
    found = {x["doc_id"]: x for x in secrets.scan(docs, field).collect()}
    hits = 0
    for i, text, at, n in planted:
        assert not plain_spans(text)
        covered = {p for s in found[i]["secrets"] if s["kind"] == "crf" for p in range(s["start"], s["end"])}
        hits += len(covered & set(range(at, at + n))) >= 0.9 * n
    assert hits >= 0.85 * len(planted)
    assert sum(bool(found[i]["secrets"]) for i, _ in rows if i % 3) <= 2
    assert "[SECRET]" in secrets.scan(docs.where("doc_id = 1000"), field, mark="[SECRET]").first()["text"]


def test_the_part_of_a_secret_beyond_the_pattern_is_added():
    assert secrets.outside((5, 20), [(0, 10)]) == [(10, 20)]
    assert secrets.outside((5, 20), [(8, 10), (12, 30)]) == [(5, 8), (10, 12)]
    assert secrets.outside((5, 20), [(0, 40)]) == []


def test_training_windows_of_long_unbroken_texts_take_no_longer_than_their_length():
    import time

    for text in ("a" * 1_000_000, "=" * 1_000_000, "1" * 1_000_000, "token" + " " * 1_000_000, 'secret="' + "0f" * 500_000 + '"', "password=hunter22," * 30_000):
        start = time.perf_counter()
        found = secrets._windows(text, 100)
        assert 0 < len(found) <= 100 and time.perf_counter() - start < 20
        assert {k for k, _ in found} <= {k for k, _ in secrets._windows(text, 200)}  # the smallest keys of all
