from __future__ import annotations

import random

from crawlgrain.llm.components import connected_components


def brute(pairs):
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def test_components(spark):
    r = random.Random(5)
    pairs = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(220)]
    pairs += [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2050)]
    rows = [*pairs, (None, 1), (7, None), (5000, 5000), pairs[0]]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(rows, "a long, b long")).collect()}
    assert got == brute([p for p in pairs if p[0] != p[1]])


def test_no_links(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).collect() == []
