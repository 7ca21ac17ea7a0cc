"""Whole lines as units of the substring deduplication."""

import random
import re

from prismata.llm import entries, substring_dedup


def test_later_copies_of_a_line_go_whatever_their_neighbours(spark):
    r = random.Random(3)
    words = lambda n: " ".join(f"w{int(r.paretovariate(0.7)) % 3000}" for _ in range(n))
    lines = [words(n) for n in range(10, 61) for _ in range(6)]
    rows, want = [], {}
    for k in range(2):
        for i, line in enumerate(lines):
            a, b = f"{words(30)} a{k}x{i}", f"b{k}x{i} {words(30)}"
            shown = line.upper().replace(" ", "  ") if k else line
            rows.append((len(rows), f"{a}\n {shown}\t\n{b}"))
            want[len(rows) - 1] = (len(a) + 2, len(a) + 2 + len(shown)) if k else None
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    for x in got:
        spans = [(s["start"], s["end"]) for s in x["removed_spans"]]
        assert (want[x["doc_id"]] in spans) if want[x["doc_id"]] else not spans


def test_short_lines_and_lines_within_a_text(spark):
    rows = [(1, "é 345678\nten chars!\nother words here"), (2, "é 345678\nTEN  chars!\nten chars\nsomething else"), (3, "alone here\nbetween\nalone here\nalone HERE\nend"), (4, "ten\nchars!")]
    got = {x["doc_id"]: x for x in substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i]["text"] for i in (1, 2, 3, 4)] == [rows[0][1], "é 345678\n\nten chars\nsomething else", "alone here\nbetween\n\nend", "ten\nchars!"]


def lines_of(text):
    """Start, end and normalised form of each line that has words, in code points."""
    at = 0
    for line in text.split("\n"):
        words = [m for m in re.finditer(r"[^\x20\x09-\x0D]+", line)]
        if words:
            form = re.sub("[A-Z]", lambda m: m.group().lower(), " ".join(m.group() for m in words))
            yield at + words[0].start(), at + words[-1].end(), form
        at += len(line) + 1


def test_line_spans_of_the_registered_query_are_those_of_brute_force(spark, sf):
    """Every later copy of a line of ten characters or more goes, in all documents, and nothing else has the kind of a line."""
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    seen, want = set(), {}
    for i, text in docs:
        spans = []
        last = False
        for a, b, form in lines_of(text):
            again = len(form) >= 10 and form in seen
            if again:
                spans = [*spans[:-1], (spans[-1][0], b)] if last else [*spans, (a, b)]
            last = again
            seen.add(form)
        want[i] = spans
    found = substring_dedup.dedup_substrings(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).collect()
    for r in found:
        assert [(s["start"], s["end"]) for s in r["removed_spans"] if s["kind"] == "line"] == want[r["doc_id"]]
    counts = {r["doc_id"]: r["n_line_spans"] for r in entries.QUERIES["op4_substring_dedup"](spark, sf).collect()}
    assert counts == {i: len(s) for i, s in want.items()} and sum(counts.values()) > 0
