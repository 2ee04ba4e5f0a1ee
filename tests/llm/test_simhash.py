from __future__ import annotations

import random

import numpy as np
import xxhash

from crawlgrain.llm import simhash as S
from tests.llm.helpers import docs, random_docs


def plain(text):
    words = [w for w in (text or "").translate({k: k + 32 for k in range(65, 91)}).replace("\n", " ").replace("\t", " ").split(" ") if w]
    shingles = [" ".join(words[k : k + 4]) for k in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(f, distance=4):
    out = {i: i for i in f}

    def find(x):
        while out[x] != x:
            x = out[x]
        return x

    ids = sorted(f)
    for a in ids:
        for b in ids:
            if a < b and (f[a] ^ f[b]).bit_count() <= distance:
                x, y = find(a), find(b)
                out[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_whole_tables(spark):
    rows = [*random_docs(3, 50), (900, "ÀB c D e"), (901, "Àb C d E")]
    got = S.near_duplicates(docs(spark, rows)).collect()
    f = {i: plain(t) for i, t in rows}
    assert {x.doc_id: x.fingerprint % 2**64 for x in got} == f
    assert {x.doc_id: x.component_id for x in got} == components(f)
    assert f[900] == f[901]


def near(r, n):
    centres = [r.getrandbits(64) for _ in range(n)]
    out = {*centres}
    for c in centres:
        for _ in range(r.randint(0, 6)):
            out.add(c ^ sum(1 << b for b in {r.randrange(64) for _ in range(r.randint(1, 6))}))
    return sorted(out)


def test_index_finds_all_near_pairs():
    r = random.Random(2)
    f = np.array(near(r, 80), dtype=np.uint64)
    f = f[np.argsort(S.gray_rank(f))]
    bucket = np.sort(np.array([r.randrange(3) for _ in f]))
    order = np.lexsort((S.gray_rank(f), bucket))
    bucket, f = bucket[order], f[order]
    got = {(int(a), int(b)) for i, j in S.near_pairs(bucket, f[:, None], 4) for a, b in zip(i, j, strict=True)}
    want = {(a, b) for a in range(len(f)) for b in range(a + 1, len(f)) if bucket[a] == bucket[b] and int(f[a] ^ f[b]).bit_count() <= 4}
    assert got == want


def test_gray_rank_orders_neighbours_one_bit_apart():
    codes = np.array([k ^ (k >> 1) for k in range(64)], dtype=np.uint64)
    assert S.gray_rank(codes).tolist() == list(range(64))


def test_full_buckets_are_dealt_again(spark):
    f = near(random.Random(9), 60)
    table = spark.createDataFrame([(k, x - 2**64 if x >= 2**63 else x) for k, x in enumerate(f)], "node long, fingerprint long")
    want = components(dict(enumerate(f)))
    from crawlgrain.llm.components import connected_components

    for size in (2, 20_000):
        got = {k: k for k in range(len(f))} | {x.node: x.component for x in connected_components(S.links(table, bucket_rows=size)).collect()}
        assert got == want


def test_empty_table(spark):
    assert S.near_duplicates(docs(spark, [])).collect() == []
