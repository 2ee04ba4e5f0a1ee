from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from crawlgrain.llm import packing
from tests.llm.helpers import docs, random_docs

TRICKY = [
    "It's RED, rock'n'roll 's don't!!! ...,,. 'tis we'll",
    "Ünï çödé ÉÀ İı ß ﬁ Å combining é ́x ≠ a̸",
    "tab\tvt\x0bff\x0cfs\x1cgs\x1dnel\x85nbsp\xa0em ls end",
    "special <|endoftext|> <|ENDOFTEXT|> x<|startoftext|>y <|",
    "12345 1,234.5 $$$ %%% word%%%word 漢字かな عربى 🙂🙂 a🙂b",
    "«quoted», “smart” word» word).",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.tokenizer_path())


def held(rows):
    by = defaultdict(list)
    for x in rows:
        by[x.doc_id].append(x)
    return {k: b"".join(x.ids for x in sorted(v, key=lambda x: x.start)) for k, v in by.items()}


def test_ids_are_the_tokenizers(tokenizer):
    import pyarrow as pa

    ids, bounds = packing.WordTokens(packing.tokenizer_path()).encode_all(pa.array(TRICKY))
    for k, t in enumerate(TRICKY):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_generations_lose_nothing(tokenizer, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "_WORDS_KEPT", 3)
    words = packing.WordTokens(packing.tokenizer_path())
    for t in (*TRICKY, *TRICKY, "a b c", "a b c d, e. a"):
        assert words.encode_all(pa.array([t]))[0].tolist() == tokenizer.encode(t, add_special_tokens=False).ids


def test_every_id_lies_in_one_piece_and_no_sequence_is_padded(spark, tokenizer):
    rows = [*random_docs(1, 60), *((1000 + k, t) for k, t in enumerate(TRICKY)), (2000, "long word list " * 9000), (None, "null id")]
    table = docs(spark, rows).repartition(3)
    got = packing.pack_documents(table, packing.Packing(packing.tokenizer_path(), pool_tokens=4096)).collect()
    want = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes() for i, t in rows}
    assert held(got) == want
    sequences = defaultdict(list)
    for x in got:
        assert x.length == len(x.ids) // 4 > 0 and x.doc_tokens == len(want[x.doc_id]) // 4
        sequences[x.sequence_id].append(x)
    for pieces in sequences.values():
        pieces.sort(key=lambda x: x.offset)
        assert [x.offset for x in pieces] == [sum(y.length for y in pieces[:k]) for k in range(len(pieces))]
        n = sum(x.length for x in pieces)
        assert n == pieces[0].sequence_length <= 2048 and n & (n - 1) == 0
        assert len({x.step_group for x in pieces}) == 1
    groups = defaultdict(set)
    for s, pieces in sequences.items():
        groups[pieces[0].step_group].add((s, pieces[0].sequence_length))
    assert all(len({n for _, n in g}) == 1 and sum(n for _, n in g) <= 1 << 14 for g in groups.values())


def test_repeated_rows_and_empty_tables(spark):
    p = packing.Packing(packing.tokenizer_path())
    twice = packing.pack_documents(docs(spark, [(1, "same"), (1, "same")]), p).collect()
    assert sum(x.length for x in twice) == 2 * twice[0].doc_tokens
    assert packing.pack_documents(docs(spark, []), p).collect() == []


def test_other_tokenizers_encode_whole_texts():
    import pyarrow as pa

    path = packing.tokenizer_path("byte_bpe_50k.json")
    words, plain = packing.WordTokens(path), Tokenizer.from_file(path)
    assert not words.by_word and packing.WordTokens(packing.tokenizer_path()).by_word
    ids, bounds = words.encode_all(pa.array([*TRICKY, "", "Upper lower"]))
    for k, t in enumerate([*TRICKY, "", "Upper lower"]):
        assert ids[bounds[k] : bounds[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids


def test_a_task_that_fails_leaves_the_worker_as_it_was(monkeypatch):
    import gc

    import pyarrow as pa

    taken = {}

    class Docs:
        def __getitem__(self, name):
            return self

        def cast(self, kind):
            return self

        def select(self, *columns):
            return self

        def mapInArrow(self, task, schema):  # noqa: N802
            taken["task"] = task

    packing.pack_documents(Docs(), packing.Packing(packing.tokenizer_path()))
    monkeypatch.setattr(packing.WordTokens, "encode_all", lambda self, texts: 1 / 0)
    monkeypatch.setattr("pyspark.TaskContext.get", lambda: type("T", (), {"partitionId": lambda self: 0})())
    with pytest.raises(ZeroDivisionError):
        list(taken["task"](iter([pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["x"])], ["doc_id", "text"])])))
    assert gc.isenabled()
