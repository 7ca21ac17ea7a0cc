"""Vector codes, source divergence and license scans against plain versions, with the cases each has to handle."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismata.llm import divergence as D
from prismata.llm import licenses as L
from prismata.llm import vector_codes as V

# ---- vector codes


def plain_codes(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = [(k, [math.floor(scale * x) for x in v], label) for k, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    distance = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    book = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(parts)]
    nearest = lambda x, p: min((distance(x, e), k) for k, e in enumerate(book[p]))
    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for _, v, _ in kept:
                groups[nearest(cut(v, p), p)[1]].append(cut(v, p))
            for k, own in groups.items():
                book[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = []
    for k, v, label in kept:
        found = [nearest(cut(v, p), p) for p in range(parts)]
        out.append((k, [c for _, c in found], sum(d for d, _ in found), label))
    sums = Counter()
    for _, _, e, label in out:
        sums[label] += e
    text = ",".join(str(x) for p in book for e in p for x in e)
    return sorted(((k, c, e, sums[label]) for k, c, e, label in out), key=repr), hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("seed", [1, 2])
def test_vector_codes_are_those_of_plain_rounds(spark, seed):
    r = random.Random(seed)
    rows = [(k, [r.choice((-1.0, -0.25, 0.1, 0.75)) + (r.random() / 4 if k % 3 else 0.0) for _ in range(16)], k % 3 or None) for k in range(200)]
    rows += [(5, rows[5][1], 9), (7, rows[8][1], 0), (None, rows[9][1], 0), (300, None, 1), (301, [None, *rows[0][1][1:]], 1), (302, [float("nan")] * 16, 1), (303, [float("inf")] * 16, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"code": F.lit(1), "error": F.lit("x"), "sums": F.lit(0)}).repartition(5)
    got, book = V.compress(df)
    want, digest = plain_codes(rows)
    assert sorted(((x["vec_id"], x["code"], x["error"], x["label_error"]) for x in got.collect()), key=repr) == want
    assert V.digest(book) == digest


def test_few_equal_and_odd_vectors(spark):
    one = [0.5] * 8
    rows = [(1, one, 1), (2, one, 1), (3, [0.1] * 4, 1), (4, [1e9] + one[1:], None), (5, [], 2)]
    got, book = V.compress(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert {x["vec_id"]: (x["code"], x["error"], x["label_error"]) for x in got.collect()} == {
        1: ([0] * 8, 0, 0), 2: ([0] * 8, 0, 0), 3: (None, None, 0), 4: (None, None, None), 5: (None, None, None)}
    assert book.shape == (8, 2, 1)
    with pytest.raises(ValueError, match="don't divide"):
        V.compress(spark.createDataFrame([(1, [0.5] * 7, 1)], "vec_id long, embedding array<float>, label int"))
    got, book = V.compress(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int"))
    assert got.count() == 0 and book.shape[1] == 0 and got.columns == ["vec_id", "label", "code", "error", "label_error"]


def test_bounds_leave_out_most_distances_and_decide_no_tie():
    g = np.random.default_rng(4)
    centres = g.integers(-4000, 4000, (16, 8))
    x = np.concatenate([centres[g.integers(0, 16, 4000)] + g.integers(-300, 300, (4000, 8)), np.repeat(centres[:2], 50, 0), (centres[:1] + centres[1:2]) // 2])
    old = centres + g.integers(-200, 200, (16, 8))
    old[3] = old[2]  # two equal entries: the lower one wins
    code, upper, lower = V.assign(x, old)
    entries, total = old.copy(), 0
    for _ in range(5):
        sums = np.array([x[code == k].sum(0) // max(1, (code == k).sum()) if (code == k).any() else entries[k] for k in range(16)])
        upper, lower = V.unpacked(V.packed_up(upper)), V.unpacked(V.packed_down(lower))
        code, upper, lower, n = V.reassign(x, code, upper, lower, entries, sums)
        entries, total = sums, total + n
        want = np.stack([V.squares(x, e) for e in entries], 1)
        assert (code == want.argmin(1)).all()
        assert (upper**2 >= want.min(1)).all() and (lower**2 <= want).all()
    assert total < 5 * len(x) * 4  # of 16 distances each


# ---- source divergence


def plain_divergence(rows, least=10, top=10):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    down = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts, by = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        found = term.findall((text or "").translate(down))
        docs[lang or ""].update(set(found))
        counts[lang or "", source or ""].update(found)
        by[lang or ""].add(source or "")
    out = []
    for lang, sources in by.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        total = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        whole = sum(total.values())
        share = lambda n, of: 1 + 10**9 * (n + 2) // (of + 2 * len(kept))
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for s in sources:
            pairs = [(sum(f(share(counts[lang, s][t], total[s]), share(counts[lang, o][t], total[o])) for t in kept), o) for o in sources if o != s]
            marks = []
            for t in kept:
                p, q = share(counts[lang, s][t], total[s]), share(sum(counts[lang, o][t] for o in sources), whole)
                if counts[lang, s][t] and p > q:
                    marks.append((f(p, q), t))
            for part, found, most in (("pair", pairs, None), ("term", marks, top)):
                for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                    out.append((lang, s, part, item, value, rank))
    return sorted(out)


@pytest.mark.parametrize("slots", [1 << 10, 16])
def test_divergence_is_the_plain_one(spark, monkeypatch, slots):
    monkeypatch.setattr(D, "SOURCES", 2)  # several blocks of sources
    r = random.Random(5)
    words = [f"{c}{w}" for c in "abcdeß" for w in ("lpha", "Eta", "amma", "é", "x_y", "2z")]
    rows = [(" ".join(r.choices(words, k=r.randint(0, 60))), r.choice(("en", "de", None, "")), r.choice(("s1", "s2", "s3", "s4", None))) for _ in range(150)]
    rows += [(None, "fr", "only"), ("", "fr", None), ("1 2 3", "xx", "lone"), ("rare words", "en", "s9"), ("A" * 20_000, "en", "s1"), ("\x00İKK a\x0bb", "en", "s1")] * 2
    df = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "n": F.lit(2), "h": F.lit("x")}).repartition(3)
    assert sorted(tuple(x) for x in D.divergence(df, slots=slots).collect()) == plain_divergence(rows)
    assert D.divergence(df.where("false")).count() == 0


def test_a_sketch_never_underestimates_and_stops_at_the_threshold(spark):
    rows = spark.range(0, 3000, 1, 7).select(F.xxhash64(F.col("id") % 500).alias("h"), (F.col("id") % 4).alias("docs"))
    counters = np.frombuffer(D.sketch(rows, 10, 256), np.uint8)
    assert counters.max() == 10
    want = {x["h"]: x["n"] for x in rows.groupBy("h").agg(F.sum("docs").alias("n")).collect()}
    estimate = counters[D._places(np.array(list(want)), 256)].min(0)
    assert (estimate >= np.minimum(list(want.values()), 10)).all()
    wide = np.frombuffer(D.sketch(rows, 10, 1 << 16), np.uint8)
    exact = wide[D._places(np.array(list(want)), 1 << 16)].min(0) == np.minimum(list(want.values()), 10)
    assert exact.mean() > 0.99


def test_tasks_give_out_their_counts_before_they_hold_too_many(spark, monkeypatch):
    docs = spark.createDataFrame([(f"w{chr(97 + k % 26)} x{chr(97 + k % 7)}", "en", "s") for k in range(200)], "text string, lang string, source string")
    want = {tuple(x) for x in D.counted(docs).where("term is not null").groupBy("term").agg(F.sum("n"), F.sum("docs")).collect()}
    monkeypatch.setattr(D, "HELD", 3)
    found = list(D.terms("a Bßc d"))
    assert found == [b"a", "bßc".encode(), b"d"] and len(want) == 33


# ---- license scans


def plain_licenses(text, templates=None):
    words = L.words_of(text or "")
    base = []
    for phrase, label in L.PHRASES.items():
        p = L.words_of(phrase)
        base += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    met = []
    for label, share, template in templates or L.TEMPLATES:
        t, size = set(L.words_of(template)), L.length_class(len(L.words_of(template)))
        for s in range(0, len(words), size):
            common = len(t & set(words[s : s + 2 * size]))
            if common >= math.ceil(share * len(t) - 1e-9):
                met.append((s, min(2 * size, len(words) - s), label, common / len(t)))
    at = [i for i, _ in base]
    labels = {x for _, x in base}
    return (len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(labels)), ",".join(sorted(labels | {m[2] for m in met})),
            1.0 if base else max((m[3] for m in met), default=0.0), sorted(set(met)))


def license_rows():
    r = random.Random(8)
    filler = lambda n: " ".join(r.choice(("the", "of", "software", "license", "mit", "is", "free", "to", "und", "grün", "a1")) for _ in range(n))
    rows = [(k, filler(r.randint(0, 300))) for k in range(40)]
    for k, (_, share, template) in enumerate(L.TEMPLATES):
        words = template.split()
        for drop in (0, 1, round(0.2 * len(words)), round(0.3 * len(words))):
            own = words.copy()
            for _ in range(drop):
                own[r.randrange(len(own))] = "other"
            rows.append((100 + 10 * k + drop, f"{filler(r.randint(0, 90))}\n{' '.join(own).upper() if k % 2 else ' '.join(own)}\n{filler(r.randint(0, 90))}"))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "MIT License mit license MIT-LICENSE"), (904, "cc by cc by-nc 4.0"), (905, "summit license"), (906, "mit license"),
             (907, "GNU  general\npublic LICENSE"), (None, "the MIT License"), (None, "the MIT License"), (903, "apache license"), (908, "x" * 100_000 + " mit license"), (909, "a b " * 20_000),
             (910, "Released under the KK license mit"), (911, "apache")]
    return rows


def test_licenses_are_those_of_all_blocks(spark):
    rows = license_rows()
    df = spark.createDataFrame([(k, t, "x", 1.0) for k, t in rows], "doc_id long, text string, labels string, score double").repartition(3)
    got = sorted(((x["doc_id"], *x[1:8], sorted((b["start"], b["words"], b["label"], b["containment"]) for b in x["blocks"])) for x in L.scan(df).collect()), key=repr)
    want = sorted(((k, *plain_licenses(t)) for k, t in rows), key=repr)
    assert got == want
    assert {label for x in want for label in x[6].split(",")} >= {label for label, _, _ in L.TEMPLATES}
    assert L.scan(df.where("false")).count() == 0


def test_a_template_is_found_wherever_it_starts(spark):
    label, share, template = L.TEMPLATES[1]
    rows = [(k, " ".join(["word"] * k + L.words_of(template) + ["end"] * (130 - k))) for k in range(0, 130, 3)]
    got = L.scan(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("labels <> 'mit' or score < 1").count() == 0 and got.count() == len(rows)


def test_no_python_in_the_plan_of_license_scans(spark):
    plan = L.scan(spark.createDataFrame(license_rows()[:5], "doc_id long, text string"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


def test_results_hold_together():
    assert len({w for _, _, t in L.TEMPLATES for w in L.words_of(t)}) < 200
    assert all(a != b for a, b in itertools.combinations([t for _, _, t in L.TEMPLATES], 2))


# ---- packing


def _used(patterns):
    out = Counter()
    for contents, n in patterns:
        assert sum(k * t for k, t in contents) <= 4096
        for k, t in contents:
            out[k] += t * n
    return out


def test_packings_of_two_and_three_pieces_come_near_the_least():
    from prismata.llm import packing

    r = random.Random(1)
    counts = Counter(r.randint(1025, 2039) for _ in range(3000))
    found = packing.solve(counts)
    assert found.sequences <= 1180 and found.bound <= found.sequences and _used(found.patterns) == counts
    many = packing.solve({k: 10_000_019 * n for k, n in counts.items()})
    assert many.sequences <= 1180 * 10_000_019 and _used(many.patterns) == {k: 10_000_019 * n for k, n in counts.items()} and len(many.patterns) < 60_000
    for n, most in ((20, 20), (200, 202)):
        triples = Counter()
        for _ in range(n):
            a = r.randint(1100, 1700)
            b = r.randint(1025, 4096 - a - 1025)
            triples.update([a, b, 4096 - a - b])
        found = packing.solve(triples)
        assert n <= found.sequences <= most and _used(found.patterns) == triples


@pytest.mark.parametrize(("low", "high"), [(1, 4096), (820, 1500), (1400, 3000), (4096, 4096), (2049, 2100), (1, 5)])
def test_even_bins_hold_all_pieces(low, high):
    from prismata.llm import packing

    r = random.Random(low)
    counts = Counter(r.randint(low, high) for _ in range(500))
    for most in (2, 3, 6):
        assert _used(packing.balanced(counts, 4096, most)) == counts
    assert packing.balanced({}, 4096, 3) == []
