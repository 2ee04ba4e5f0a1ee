"""Words are encoded many at a time and once each, to the ids that the tokenizer gives the whole text."""

from __future__ import annotations

import random

import pyarrow as pa
from tokenizers import Tokenizer

from crawlgrain.llm import packing

PIECES = [*(chr(c) for c in range(0x21, 0x250) if chr(c).isprintable()), "0", "00", "10", "...", "***", "&&&", "'s", "é", "Σ", "ς", "İ", "漢", "🙂", "ǆ", "ﬁ", "\x85", " ", "<|endoftext|>", "%%", "a.b", "Ünï"]


def texts_of(seed: int, n: int) -> list[str]:
    r = random.Random(seed)
    return [" ".join("".join(r.choices(PIECES, k=r.randint(1, 6))) for _ in range(r.randint(0, 40))) for _ in range(n)]


def test_ids_of_odd_words_are_the_tokenizers(monkeypatch):
    plain = Tokenizer.from_file(packing.tokenizer_path())
    for kept, at_once in ((1_000_000, 8192), (50, 7)):
        monkeypatch.setattr(packing, "_WORDS_KEPT", kept)
        monkeypatch.setattr(packing, "_ENCODED_AT_ONCE", at_once)
        words = packing.WordTokens(packing.tokenizer_path())
        for seed in range(6):
            texts = [*texts_of(seed, 40), "", "...", "x", "***", " .x. ", "É. é, é. ÷. ×,"]
            ids, bounds = words.encode_all(pa.array(texts))
            for k, t in enumerate(texts):
                assert ids[bounds[k] : bounds[k + 1]].tolist() == plain.encode(t, add_special_tokens=False).ids, t
    assert words.encode_all(pa.array([], pa.string()))[1].tolist() == [0]


def test_words_are_not_encoded_one_by_one_nor_twice():
    words, given = packing.WordTokens(packing.tokenizer_path()), []

    class Spy:
        def encode_batch_fast(self, texts, add_special_tokens):
            given.extend(texts)
            return plain.encode_batch_fast(texts, add_special_tokens=add_special_tokens)

    plain, words.tokenizer = words.tokenizer, Spy()
    text = " ".join(f"w{k:x}é, ž{k}" for k in range(1, 2000))
    first = words.encode_all(pa.array([text]))[0].tolist()
    assert first == plain.encode(text, add_special_tokens=False).ids
    assert len(given) < 0.6 * 2 * 2000  # but words with the digit 0
    given.clear()
    assert words.encode_all(pa.array([text]))[0].tolist() == first and not given
