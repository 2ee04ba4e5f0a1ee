from __future__ import annotations

import random
import re

from crawlgrain.llm import decontaminate as D
from tests.llm.helpers import docs


def tokens(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def tiling(a, b, least):
    """Greedy string tiling by definition."""
    in_a, in_b, out = set(), set(), []
    while True:
        best = None
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in in_a and j + n not in in_b:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        i, j, n = best
        in_a |= {*range(i, i + n)}
        in_b |= {*range(j, j + n)}
        out.append(best)


def bench(spark, rows):
    return spark.createDataFrame([(*r, None, None) for r in rows], "item_id long, text string, doc_id long, n int")


def test_against_the_definition(spark):
    r = random.Random(3)
    vocabulary = [f"v{k}" for k in range(9)]
    items = [(k, " ".join(r.choice(vocabulary) for _ in range(r.randint(8, 24)))) for k in range(8)]
    rows = []
    for i in range(60):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 40))]
        if i % 2:
            src = items[i % 8][1].split()
            cut = r.randint(1, len(src) - 1)
            piece = src[cut:] + ["filler"] + src[:cut] if i % 4 == 1 else src
            at = r.randint(0, len(words))
            words[at:at] = piece
        rows.append((i, ", ".join(words).upper() if i % 3 == 0 else " ".join(words)))
    want = {}
    for i, t in rows:
        for j, b in items:
            covered = sum(n for _, _, n in tiling(tokens(t), tokens(b), 5)) / len(tokens(b))
            if covered >= 0.6:
                want[i, j] = round(covered, 9)
    got = {(x.doc_id, x.item_id): round(x.coverage, 9) for x in D.contaminated(docs(spark, rows), bench(spark, items)).collect()}
    assert got == want and len(got) > 20
    kept = D.clean(docs(spark, rows), bench(spark, items))
    assert sorted(x.doc_id for x in kept.collect()) == sorted({i for i, _ in rows} - {i for i, _ in want})
    far = {(x.doc_id, x.item_id): round(x.coverage, 9) for x in D.contaminated(docs(spark, rows), bench(spark, items), part_bytes=100).collect()}
    assert far == want
    kept = D.clean(docs(spark, rows), bench(spark, items), part_bytes=100)
    assert sorted(x.doc_id for x in kept.collect()) == sorted({i for i, _ in rows} - {i for i, _ in want}) and kept.columns == docs(spark, rows).columns


def test_a_run_of_words_in_every_item_is_not_looked_up(spark):
    common = "these are the five words"
    r = random.Random(8)
    other = lambda n: " ".join(f"o{r.randrange(10**6)}" for _ in range(n))
    items = [(k, f"{common} {other(20)}") for k in range(300)]
    rows = [(0, f"{common} " * 3000), (1, items[5][1]), (2, f"{other(9)} {items[7][1]} {common}"), (3, other(50))]
    got = [(x.doc_id, x.item_id) for b in (1 << 20, 100) for x in D.contaminated(docs(spark, rows), bench(spark, items), part_bytes=b).collect()]
    assert sorted(got) == [(1, 5), (1, 5), (2, 7), (2, 7)]
    import pyarrow as pa

    seeds = D.Seeds([k for k, _ in items], pa.array([t for _, t in items]), 5, 0.6)
    assert len(seeds.hits(D.W.windows(D._split(pa.array([common])).hashes()[0], D._split(pa.array([common])).doc, 5)[1])[0]) == 0


def test_edges(spark):
    passage = "one two three four five six seven eight nine ten"
    rows = [(1, passage), (1, passage), (2, None), (3, ""), (None, "x " * 1000 + passage.upper() + "! y"), (4, "one two three four five"), (5, "six seven eight nine ten / one two three four five")]
    items = [(7, passage), (8, None), (9, ""), (10, "too short"), (None, passage)]
    got = sorted(((x.doc_id, x.item_id, len(x.tiles)) for x in D.contaminated(docs(spark, rows), bench(spark, items)).collect()), key=str)
    assert got == sorted([(d, i, 2 if d == 5 else 1) for d in (1, 1, None, 5) for i in (7, None)], key=str)
    far = D.contaminated(docs(spark, rows), bench(spark, items), part_bytes=1)
    assert sorted(((x.doc_id, x.item_id, len(x.tiles)) for x in far.collect()), key=str) == got
    assert D.contaminated(docs(spark, []), bench(spark, items)).collect() == [] == D.contaminated(docs(spark, []), bench(spark, items), part_bytes=1).collect()
    assert D.contaminated(docs(spark, rows), bench(spark, [])).collect() == []
    assert D.clean(docs(spark, rows), bench(spark, [])).count() == len(rows)
