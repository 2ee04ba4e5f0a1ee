from __future__ import annotations

import hashlib
import random
import re

import pytest

from crawlgrain.llm import exchange, substring_dedup, suffix_array
from tests.llm.helpers import docs, random_docs


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def removed(rows, window):
    first: dict[tuple, float] = {}
    big = float("inf")
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            first[key] = min(first.get(key, big), big if i is None else i)
    out = []
    for i, t in rows:
        w = words(t)
        gone = {k + j for k in range(len(w) - window + 1) if first[tuple(w[k : k + window])] < (big if i is None else i) for j in range(window)}
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


@pytest.fixture()
def small_groups(monkeypatch):
    """Several groups and buckets, as a large corpus has."""
    monkeypatch.setattr(exchange, "sizes", lambda d, c: exchange.Sizes(5, 3, 40))


@pytest.mark.parametrize("window", [5, 13])
def test_substring_dedup(spark, small_groups, window):
    rows = [*random_docs(4, 40, vocabulary=6 if window == 5 else 12), (None, "x " * 20), (None, "x " * 20)]
    got = substring_dedup.repeated_words(docs(spark, rows), window).collect()
    assert sorted(map(tuple, got), key=str) == removed(rows, window)


def test_substring_dedup_at_its_own_sizes(spark):
    rows = random_docs(8, 30)
    got = {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.digests(docs(spark, rows)).collect()}
    assert got == {i: (n, m, hashlib.sha256(k.encode()).hexdigest()) for i, n, m, k in removed(rows, 13)}
    assert substring_dedup.digests(docs(spark, [])).collect() == []


def test_levels_double():
    assert substring_dedup.level_lengths(13) == [7, 13]
    assert substring_dedup.level_lengths(50) == [7, 13, 25, 50]


def passages(rows, window):
    """Maximal ranges under windows that another document holds."""
    by: dict[tuple, set] = {}
    for i, t in rows:
        w = words(t)
        for k in range(len(w) - window + 1):
            by.setdefault(tuple(w[k : k + window]), set()).add(i)
    out = []
    for i, t in rows:
        w = words(t)
        on = sorted({k + j for k in range(len(w) - window + 1) if len(by[tuple(w[k : k + window])]) > 1 for j in range(window)})
        runs = []
        for k in on:
            if runs and k == runs[-1][1]:
                runs[-1][1] = k + 1
            else:
                runs.append([k, k + 1])
        out += [(i, a, b - a) for a, b in runs]
    return sorted(out)


@pytest.mark.parametrize("vocabulary", [2, 12])
def test_suffix_array(spark, small_groups, vocabulary):
    rows = random_docs(vocabulary, 60, vocabulary, 90)
    got = sorted(map(tuple, suffix_array.repeated_passages(docs(spark, rows), 20).collect()))
    assert got == passages(rows, 20)


def test_suffix_array_at_its_own_sizes(spark):
    text = " ".join(f"p{k}" for k in range(51))
    rows = [(1, "a b " + text), (2, text + " c"), (3, " ".join(f"p{k}" for k in range(49))), (4, None), (5, "x " * 300), (6, text)]
    assert sorted(map(tuple, suffix_array.repeated_passages(docs(spark, rows)).collect())) == [(1, 2, 51), (2, 0, 51), (6, 0, 51)]
    assert suffix_array.repeated_passages(docs(spark, [])).collect() == []


def test_suffix_array_finds_a_passage_many_times_in_one_document(spark):
    r = random.Random(7)
    passage = " ".join(f"p{k}" for k in range(60))
    other = lambda n: " ".join(f"u{r.randrange(10**9)}" for _ in range(n))
    rows = [(1, " ".join(f"{other(8)} {passage}" for _ in range(100))), (2, f"{other(30)} {passage} {other(30)}")]
    got = sorted(map(tuple, suffix_array.repeated_passages(docs(spark, rows)).collect()))
    assert len(got) == 101 and got == passages(rows, 50)


def test_suffix_array_across_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_array, "PIECE", 20)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    r = random.Random(5)
    rows = []
    # many hold a line; pairs share the words before it and few after it, and others stand between them in right order
    for line in range(12):
        held = [f"l{line}.{k}" for k in range(8)]
        for i in range(80):
            before = [f"b{line}.{i // 2}.{k}" for k in range(11)]
            rows.append((len(rows), " ".join([*before, *held, f"s{line}", *(f"x{r.randrange(10**9)}" for _ in range(12))])))
    want = passages(rows, 20)
    try:
        assert len(want) == len(rows) and sorted(map(tuple, suffix_array.repeated_passages(docs(spark, rows), 20).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
