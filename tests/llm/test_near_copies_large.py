"""Groups larger than a task are judged as small ones are."""

from __future__ import annotations

import random

import numpy as np

from crawlgrain.llm import near_copies as N
from tests.llm.test_near_copies import greedy, kept


def chains(seed: int, n: int, links: int):
    """Texts of 100 words, each like the next of its chain and no further; ids in any order."""
    r = random.Random(seed)
    out = []
    for c in range(n):
        words = [f"c{c}w{k}" for k in range(100 + 10 * links)]
        out += [" ".join(words[10 * k : 10 * k + 100]) for k in range(links)]
    r.shuffle(out)
    return list(enumerate(out))


def test_results_do_not_depend_on_the_size_of_a_chunk(spark):
    rows = chains(1, 3, 40)
    ids, want = {i for i, _ in rows}, greedy(rows)
    one, many = ({i for i in ids} - {x.doc_id for x in kept(spark, rows, N.NearCopies(chunk_bytes=size))} for size in (8 << 20, 5_000))
    assert one == many and len(want ^ one) <= 0.1 * len(want)


def test_a_document_goes_only_for_one_that_stays(spark):
    rows = chains(2, 1, 3)
    by = sorted(rows, key=lambda x: int(x[1].split()[0].split("w")[1]))
    texts = [t for _, t in by]
    assert {x.doc_id for x in kept(spark, list(enumerate(texts)), N.NearCopies(chunk_bytes=1_000))} == {0, 2}


def test_hot_groups_lose_no_link():
    """What a swept group is linked with beyond its leader's reach stays linked."""
    rng = np.random.default_rng(0)

    def flipped(x, n):
        bits = np.zeros(128, dtype=np.uint8)
        bits[rng.choice(128, n, replace=False)] = 1
        return x ^ np.packbits(bits).view(np.uint64)

    def components(n, pairs):
        to = list(range(n))

        def end(x):
            while to[x] != x:
                to[x] = x = to[to[x]]
            return x

        for a, b in pairs:
            to[end(int(a))] = end(int(b))
        seen = {}
        return [seen.setdefault(end(x), x) for x in range(n)]

    c = rng.integers(0, 2**63, 2, dtype=np.uint64)
    f = np.unique(np.stack([flipped(c, n) for k in range(900) for n in (int(rng.integers(0, 25)), int(rng.integers(28, 50)), 64)]), axis=0)
    f = f[rng.permutation(len(f))]
    near = lambda g: np.argwhere(np.bitwise_count(g[:, None, :] ^ g[None, :, :]).sum(axis=2) <= 30)
    root, left, *links = N._swept(f, 30, 1024)
    assert len(left) < 0.8 * len(f)
    found = [*enumerate(root), *left[near(f[left])], *(x for some in links for a, b in some for x in zip(a, b, strict=True))]
    assert components(len(f), found) == components(len(f), near(f))
