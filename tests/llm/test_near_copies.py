"""Near copies under other widths and thresholds than those of op9's query, against brute force."""

import random
import re

import corpus_pipeline
import numpy as np
import pytest

from prismata.llm import columns, jaccard, storage


def brute_kept(rows, width, num, den):
    """The smallest id of each component."""
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t.lower())
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} or {tuple(w)}
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return {i for i in sets if root[i] == i}


def test_pipeline_drops_copies_with_text_appended(spark, sf):
    r = random.Random(6)
    rows = []
    for n in (10, 30, 60, 100, 200, 400):
        base = [f"w{r.randrange(5000)}" for _ in range(n)]
        for share in (0, 0.12, 0.18, 0.24, 0.35):
            more = [f"x{r.randrange(10**6)}" for _ in range(int(n * share))]
            rows.append((len(rows) + 1, " ".join(base + more)))
        edited = list(base)
        for k in range(0, n, 50):
            edited[k] = "edited"
        rows.append((len(rows) + 1, " ".join(edited)))
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {x["doc_id"] for x in corpus_pipeline.keep_one_of_near_copies(spark, docs, sf).collect()}
    assert kept == brute_kept(rows, 5, 80, 100) and len(kept) < len(brute_kept(rows, 3, 90, 100))


def test_linked_sets_share_a_prefix_key_at_positions_that_allow_a_link():
    r = np.random.default_rng(5)
    order = jaccard.Order(r.integers(0, 1000, 1 << jaccard.SKETCH_BITS))
    number = lambda n: r.integers(0, 2**64, n, np.uint64)
    for n in [*range(4, 40), 60, 100, 250] * 40:
        low = int(r.integers(-(-n * 8 // 10), n + 1))
        common = number(low)
        most = low * 100 // 80 - low  # Jaccard 0.8 holds with so many others together
        a = int(r.integers(0, most + 1))
        x, y = (np.unique(np.concatenate([common, number(k)])) for k in (a, most - a))
        if len(x) + len(y) - low == low:
            continue
        heads = [np.sort(order.keys(s))[: jaccard.prefix_length(len(s), 80, 100)] for s in (x, y)]
        both, i, j = np.intersect1d(*heads, return_indices=True)
        assert both.size and (i + j).min() <= jaccard.most_different(len(x) + len(y), 80, 100)


def brute_roots(rows, width, num, den):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1)) or frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    order = sorted((i for i in sets if sets[i]), key=lambda i: len(sets[i]))
    for k, a in enumerate(order):
        for b in order[k + 1 :]:
            if num * len(sets[b]) > den * len(sets[a]):
                break
            x, y = find(a), find(b)
            if x != y:
                both = len(sets[a] & sets[b])
                if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("settings", [(3, 90, 100), (5, 80, 100)])
def test_whole_table_against_brute_force(spark, settings, monkeypatch):
    """Also with blocks and parts of lists so small that every list has many."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute_roots([(r["doc_id"], r["text"]) for r in docs.collect()], *settings)
    for small in (False, True):
        if small:
            monkeypatch.setattr(jaccard, "BLOCK", 2)
            monkeypatch.setattr(jaccard, "PART", 1)
        got, _ = jaccard.jaccard_components(docs, *settings)
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == want


def test_chains_whose_ends_do_not_link(spark):
    """Texts that change word by word: heads and known differences must not hide the links between neighbours."""
    r = random.Random(11)
    rows = []
    for chain in range(3):
        words = [f"c{chain}w{k}" for k in range(120)]
        for step in range(40):
            rows.append((1000 * chain + step, " ".join(words)))
            for _ in range(r.choice([1, 2, 3])):
                words[r.randrange(len(words))] = f"x{r.randrange(10**9)}"
    r.shuffle(rows)
    got, links = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == brute_roots(rows, 3, 90, 100)
    assert links.where("100 * common < 90 * total").count() == 0


def test_an_id_with_two_texts_links_by_both(spark):
    r = random.Random(9)
    rows, want = [], {}
    for k in range(12):
        a, b = ([f"w{r.randrange(10**6)}" for _ in range(100)] for _ in range(2))
        i = 10 * k + 5
        rows += [(i, " ".join(a)), (i, " ".join(b)), (i + 1, " ".join([*a, "more"])), (i + 2, " ".join([*b, "more"]))]
        want |= {i: i, i + 1: i, i + 2: i}
    rows += [(1, rows[0][1]), (201, "a b c d"), (202, "e f g h"), (202, "a b c d"), (202, None), (203, "e f g h")]
    want |= {1: 1, 5: 1, 6: 1, 7: 1, 201: 201, 202: 201, 203: 201}
    found, _ = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    held = found.where("n_shingles > 0").collect()
    assert {(x["doc_id"], x["component_id"]) for x in held} == set(want.items())


def test_lists_that_do_not_wait_for_their_end(spark, monkeypatch):
    """Chains again, in batches of a few rows, with lists given out in pieces."""
    monkeypatch.setattr(jaccard, "SEEN", 3)
    monkeypatch.setattr(jaccard, "WAIT", 2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        test_chains_whose_ends_do_not_link(spark)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def shuffled_records(spark):
    sc = spark.sparkContext
    none = sc._jvm.java.util.ArrayList()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, sc._gateway.new_array(sc._jvm.double, 0), none)
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_only_wanted_texts_are_exchanged(spark, monkeypatch):
    """Each round of comparisons once exchanged all texts of the table, even for a few pairs."""
    sent = []

    def watched(df, name):
        before = shuffled_records(spark)
        out = storage.materialize(df, name)
        sent.append((name, shuffled_records(spark) - before))
        return out

    texts = [" ".join(f"w{40 * i + k}" for k in range(30)) for i in range(2000)]
    rows = [*enumerate(texts), *((5000 + i, texts[i] + " more") for i in range(7, 2000, 500)), (7, None), (None, texts[3])]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as where the wanted ids are many
    monkeypatch.setattr(jaccard, "materialize", watched)
    try:
        found, _ = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert {(r["doc_id"], r["component_id"]) for r in found.where("doc_id <> component_id").collect()} == {(5000 + i, i) for i in range(7, 2000, 500)}
    rounds = [n for name, n in sent if name == "jaccard-compared-sets"]
    assert rounds and max(rounds) < 200


def test_likely_rows_hold_all_that_are_wanted(spark, monkeypatch):
    rows = spark.range(-3000, 3000).selectExpr("id", "id % 7 as x")
    table = spark.range(-3000, 9000, 100).unionByName(spark.range(0, 3000, 100))
    for bits in (24, 8):
        monkeypatch.setattr(columns, "LIKELY_BITS", bits)
        got = columns.likely(rows, table, "id")
        ids = [r["id"] for r in got.collect()]
        assert len(ids) == len(set(ids)) and set(range(-3000, 3000, 100)) <= set(ids) and got.columns == ["id", "x"]
        assert bits < 24 or len(ids) < 100
    assert not columns.likely(rows, table.where("false"), "id").count()


@pytest.mark.parametrize("settings", [(90, 100), (80, 100)])
def test_rows_of_lists_with_a_partner(settings):
    r = np.random.default_rng(3)
    num, den = settings
    for _ in range(60):
        lists = np.sort(r.integers(0, r.integers(1, 60), r.integers(1, 200)))
        n = r.integers(5, 80, len(lists))
        n = n[np.lexsort((n, lists))]
        pos = np.array([r.integers(0, max(1, jaccard.prefix_length(int(x), num, den))) for x in n])
        got = jaccard.with_partner(lists, n, pos, num, den)
        low, high = np.minimum.outer(n, n), np.maximum.outer(n, n)
        may = np.equal.outer(lists, lists) & (low * den >= high * num) & (np.add.outer(pos, pos) * (den + num) <= np.add.outer(n, n) * (den - num))
        np.fill_diagonal(may, False)
        short = np.bincount(lists)[lists] <= jaccard.SEEN
        assert (got | ~may.any(1)).all() and (got == may.any(1))[short].all()
    assert not len(jaccard.with_partner(lists[:0], n[:0], pos[:0], num, den))
