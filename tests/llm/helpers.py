from __future__ import annotations

import random

#: Names that operators use inside, as columns of the input.
CLASHING = "doc_id long, text string, grp int, node long, fingerprint string, bucket string, component_id long, kept_id int, n int, page string, pii string, value string, toxic string, grade string"
NAMES = [x.split()[0] for x in CLASHING.split(", ")]


def docs(spark, rows):
    """A documents table with extra columns of clashing names."""
    return spark.createDataFrame([(i, t, *[None] * (len(NAMES) - 2)) for i, t in rows], CLASHING)


def random_docs(seed: int, n: int, vocabulary: int = 12, longest: int = 60):
    """Texts over few words, with passages copied between them, nulls and empty ones."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    passages = [[r.choice(words) for _ in range(r.randint(10, 70))] for _ in range(4)]
    out = []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(0, longest))]
        if r.random() < 0.6:
            at = r.randint(0, len(text))
            text[at:at] = r.choice(passages)
        out.append((i, " ".join(text)))
    out += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, out[0][1]), (n + 4, out[1][1])]
    r.shuffle(out)
    return out
