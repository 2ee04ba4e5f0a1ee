from __future__ import annotations

import random
import re

import numpy as np
import pytest

from crawlgrain.llm import near_copies as N
from tests.llm.helpers import docs


def shingles(text, size=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def greedy(rows, similarity=0.8):
    """Ids that go: in the order of ids, those similar to one that stays."""
    stays, out = [], set()
    for i, t in sorted(rows):
        s = shingles(t)
        if any(len(s & o) >= similarity * len(s | o) - 1e-9 for o in stays):
            out.add(i)
        else:
            stays.append(s)
    return out


def families(seed, n, words=80):
    """Texts and copies of them with a few words changed, more and more of them."""
    r = random.Random(seed)
    out = []
    for k in range(n):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randint(words // 2, words * 2))]
        out.append(base)
        for edits in r.sample(range(12), r.randint(0, 4)):
            copy = list(base)
            for _ in range(edits):
                copy[r.randrange(len(copy))] = f"x{r.randrange(10**6)}"
            out.append(copy)
    r.shuffle(out)
    return [(i, " ".join(t)) for i, t in enumerate(out)]


def kept(spark, rows, p=N.NearCopies()):
    return N.one_of_each(docs(spark, rows), p).collect()


def test_recall_and_nothing_else(spark):
    rows = families(3, 150)
    want = greedy(rows)
    got = {i for i, _ in rows} - {x.doc_id for x in kept(spark, rows)}
    assert len(want) > 60 and len(want & got) >= 0.97 * len(want)
    # whatever goes has a near copy with a smaller id
    by = dict(rows)
    for i in got:
        s = shingles(by[i])
        assert any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for j, t in rows if j < i and (o := shingles(t)))


def test_driver_documents(spark):
    try:
        rows = [(x.doc_id, x.text) for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    except Exception:  # noqa: BLE001
        pytest.skip("no test data")
    want, got = greedy(rows), {i for i, _ in rows} - {x.doc_id for x in kept(spark, rows)}
    assert len(want & got) >= 0.97 * len(want) and not got - want


def test_hot_groups_large_buckets_and_chunks(spark):
    r = random.Random(5)
    base = [f"b{k}" for k in range(200)]
    hot = []
    for _ in range(3000):
        t = list(base)
        t[r.randrange(200)] = f"y{r.randrange(10**9)}"
        hot.append(t)
    other = [[f"z{r.randrange(10**9)}" for _ in range(60)] for _ in range(400)]
    rows = list(enumerate(" ".join(t) for t in [base, *hot, *other]))
    for p in (N.NearCopies(largest=1000), N.NearCopies(largest=500, bucket=64, chunk_bytes=60_000)):
        left = {x.doc_id for x in kept(spark, rows, p)}
        assert left == {0, *range(3001, 3401)}


def test_edges(spark):
    text = " ".join(f"t{k}" for k in range(100))
    rows = [(5, text), (3, text.upper()), (3, text + " more"), (None, text), (None, None), (7, None), (8, ""), (9, " \t "), (10, "one two"), (11, "One  two"), (12, "x " * 60000), (13, "x " * 50000)]
    got = kept(spark, rows)
    assert sorted((x.doc_id is None, x.doc_id or 0) for x in got) == [(False, 3), (False, 7), (False, 10), (False, 12), (True, 0), (True, 0)]
    assert N.one_of_each(docs(spark, rows)).columns == docs(spark, rows).columns
    assert kept(spark, []) == []


def test_beyond_a_broadcast(spark, monkeypatch):
    from crawlgrain.llm import cluster

    monkeypatch.setattr(cluster, "BROADCAST_BYTES", 0)
    rows = families(9, 30)
    want = greedy(rows)
    got = {i for i, _ in rows} - {x.doc_id for x in kept(spark, rows)}
    assert len(want & got) >= 0.95 * len(want)


def test_fingerprints_follow_similarity():
    """Bits differ as the angle between the sets says, for the sampled bits to find pairs."""
    rng, p = np.random.default_rng(0), N.NearCopies()
    differ = []
    for _ in range(300):
        h = rng.integers(0, 2**63, 450, dtype=np.uint64)
        f = N.fingerprints(np.concatenate([h[:400], h[50:]]), np.array([0, 400, 800]))  # 350 of 450 shared
        differ.append(int(np.bitwise_count(f[0] ^ f[1]).sum()))
    share = 2 * 350 / 800
    assert abs(np.mean(differ) / 128 - np.arccos(share) / np.pi) < 0.01
    assert p.distance == 30 and len(p.tables(10**5)) < len(p.tables(10**9))
