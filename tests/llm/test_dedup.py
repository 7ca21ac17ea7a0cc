"""Exact, line, substring and n-gram deduplication against brute force."""

import hashlib
import re

from pyspark.sql import functions as F

from prismata.llm import exact_dedup, jaccard, line_dedup, substring_dedup

SPACE = r"[\x20\x09-\x0D]"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_exact(edge, edge_rows, empty):
    norm = [(i, re.sub(f"{SPACE}+", " ", t or "")) for i, t, *_ in edge_rows]
    want = []
    for i, n in norm:
        ids = [j for j, m in norm if m == n]
        keep = min((j for j in ids if j is not None), default=None)
        want.append((i, keep, len(ids), i == keep, sha(n)))
    for capacity in (1, 50_000):  # with many splits, and with none
        got = exact_dedup.exact_dedup(edge, capacity=capacity)
        assert sorted(map(repr, want)) == sorted(repr(tuple(r)[:5]) for r in got.collect())
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_directory_splits_only_overfull_buckets(spark):
    entries = spark.createDataFrame([(k << 48,) for k in range(200)] + [(-1 - k,) for k in range(3)], "h long")
    directory, depth = exact_dedup.build_directory(entries, 203, 50)
    rows = directory.collect()
    assert len(rows) == 2**depth
    assert len({r["local_depth"] for r in rows}) > 1


def test_lines(edge, edge_rows, empty):
    docs = {}
    for i, t, *_ in edge_rows:
        for line in (t or "").split("\n"):
            key = line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
            docs.setdefault(key, set()).add(i)
    first = {k: min((i for i in v if i is not None), default=None) for k, v in docs.items()}
    want = []
    for i, t, *_ in edge_rows:
        lines = (t or "").split("\n")
        keys = [x.strip(" \t\n\x0b\x0c\r").translate(LOWER) for x in lines]
        kept = [x for x, k in zip(lines, keys, strict=True) if len(k) < 10 or first[k] == i]
        want.append((i, len(lines), len(lines) - len(kept), sha("\n".join(kept))))
    got = line_dedup.dedup_lines(edge).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256)).collect()
    assert sorted(map(repr, want)) == sorted(repr(tuple(r)) for r in got)
    assert line_dedup.dedup_lines(empty).count() == 0


def test_lines_with_hot_keys(spark):
    """A key that spans many ranges gives the same result as in one range."""
    rows = [(i, f"the very same line\nown line number {i}\n" + ("second shared line" if i % 2 else "")) for i in range(60)]
    rows += [(None, "the very same line"), (0, "the very same line\nthe very same line")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out, held = {}, {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    for ranges in ("1", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", ranges)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out[ranges] = sorted(map(repr, line_dedup.dedup_lines(docs).collect()))
        total = line_dedup.dedup_lines(docs).agg(F.sum("n_dropped")).first()[0]
        assert total == 59 + 29 + 1
    for k, v in held.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert out["1"] == out["40"]


def test_extra_columns_with_clashing_names(spark):
    names = ["_key", "_id", "row_key", "bitmap", "bitmap_id", "_row", "_kept", "n_lines", "range", "e", "digest", "slot", "found", "id", "unit_id", "units_kept"]
    docs = spark.createDataFrame([(1, "a shared line here\nalone", *[7] * len(names)), (2, "A shared line here\nother words", *[8] * len(names))],
                                 "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    lines = line_dedup.dedup_lines(docs)
    assert len(set(lines.columns)) == len(lines.columns)
    assert {(r["doc_id"], r["text"], r["n_dropped"]) for r in lines.collect()} == {(1, "a shared line here\nalone", 0), (2, "other words", 1)}
    kept = lines.collect()
    for name in set(names) - {"n_lines"}:
        assert {r[name] for r in kept} == {7, 8}
    passages = substring_dedup.dedup_substrings(docs)
    kept = passages.collect()
    assert passages.columns[:-1] == docs.columns and all({r[n] for r in kept} == {7, 8} for n in names)
    assert exact_dedup.exact_dedup(docs).where("kept").count() == 2
    assert jaccard.jaccard_components(docs)[0].count() == 2


def test_substrings(spark, edge, empty):
    passage = " ".join(f"Word{i}" for i in range(60))
    rows = [(1, f"before it {passage} after it"), (2, f"é other {passage.lower()} tail"), (3, passage.replace(" ", "\n ")), (4, "clean text"), (5, None)]
    got = {r["doc_id"]: r for r in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[1]["removed_spans"] and not got[4]["removed_spans"] and got[5]["text"] is None
    text = rows[1][1]
    for s in got[2]["removed_spans"]:
        assert text[s["start"] : s["end"]].lower() in passage.lower()
    assert sum(s["end"] - s["start"] for s in got[2]["removed_spans"]) > len(passage) / 2
    whole = substring_dedup.dedup_substrings(edge)
    assert whole.count() == edge.count() and substring_dedup.dedup_substrings(empty).count() == 0
    for r in whole.collect():
        if r["doc_id"] in (2, 8, 13):
            assert r["removed_spans"]


def brute_components(rows, num=90, den=100):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(f"{SPACE}+", (t or "").translate(LOWER)) if x]
        sets[i] = frozenset(tuple(w[k : k + 3]) for k in range(len(w) - 2)) if len(w) >= 3 else frozenset([tuple(w)] if w else [])
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b]:
                    both = len(sets[a] & sets[b])
                    if den * both >= num * (len(sets[a]) + len(sets[b]) - both) and root[a] != root[b]:
                        low = min(root[a], root[b])
                        for k, v in list(root.items()):
                            if v in (root[a], root[b]):
                                root[k] = low
                        changed = True
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_jaccard(spark, edge, empty):
    import random

    r = random.Random(4)
    rows = []
    for family in range(8):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([5, 12, 40, 150]))]
        for _ in range(9):
            words = list(base)
            for _ in range(r.randrange(4)):
                words[r.randrange(len(words))] = f"x{r.randrange(1000)}"
            rows.append((len(rows) + 1, " ".join(words)))
    rows += [(900, None), (901, ""), (902, "two words"), (903, "Two  WORDS")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, links = jaccard.jaccard_components(docs)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got.collect()} == brute_components(rows)
    assert links.where("100 * common < 90 * total").count() == 0
    found = {x["doc_id"]: x["component_id"] for x in jaccard.jaccard_components(edge)[0].collect()}
    assert found[2] == 1 and found[8] == 7 and found[10] == 9 and found[None] is None and found[4] == 4
    assert jaccard.jaccard_components(empty)[0].count() == 0
