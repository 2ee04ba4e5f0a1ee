"""Hierarchical multi-length packing of tokenised documents.

Each task tokenises the documents of its own input partition and packs them as it
goes, so nothing is shuffled and memory is bounded by the pool, not by the partition:

* windows that a document fills alone are cut off its front;
* what is left goes to the smallest tier (256, 512, 1024, 2048 tokens) that holds it;
* tiers are packed from the longest down; a window's gap takes the largest whole
  piece of the shorter tiers that fits, again and again, and its last few tokens
  come off the front of one further piece;
* what remains at the end of a partition becomes sequences of a power of two.

So every sequence is full at its own length, and no token of padding is left.
Step groups hold sequences of one length, and the same number of tokens each.
"""

from __future__ import annotations

import gc
import json
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from crawlgrain.llm import words as W
from crawlgrain.llm.cluster import tidied

SCHEMA = "doc_id long, start long, length int, ids binary, doc_tokens long, sequence_id long, offset int, sequence_length int, step_group long"
_WORDS_KEPT = 1_000_000
_BYTES_AT_ONCE = 2 << 20
_ENCODED_AT_ONCE = 8192
_MARKS = np.isin(np.arange(256), list(b".,;:!?%$&*#)"))
#: Words that normalising only lower-cases and that stay in one piece; and what a byte-level tokenizer writes for them.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_AS_BYTES = {c: "".join(chr(b) if 0xA1 <= b and b != 0xAD else chr(0x100 + (b - 0x7F + 33 if b != 0xAD else 67)) for b in chr(c).encode()) for c in range(0xC0, 0x100)}


@dataclass(frozen=True)
class Packing:
    """Parameters. pool_tokens bounds what a task holds back; step_tokens is the size of a step group."""

    tokenizer: str
    window: int = 2048
    tiers: tuple[int, ...] = (256, 512, 1024, 2048)
    end_id: int = 1
    pool_tokens: int = 1 << 21
    step_tokens: int = 1 << 14


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _parts_words(settings: dict) -> bool:
    """Whether a tokenizer's settings are those that WordTokens takes apart: lower case, letters, digits and marks apart."""
    steps = lambda part, key: [x for x in [part, *((part or {}).get(key) or ())] if x and "Sequence" != x["type"]]
    normal, cut = steps(settings.get("normalizer"), "normalizers"), steps(settings.get("pre_tokenizer"), "pretokenizers")
    split = [x for x in cut if x["type"] == "Split"]
    apart = len(split) == 1 and split[0]["behavior"] == "Removed" and split[0]["invert"] and split[0]["pattern"].get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    return apart and {x["type"] for x in normal} == {"NFC", "Replace", "Lowercase"} and {x["type"] for x in cut} <= {"Split", "ByteLevel"}


def _stems_and_marks(w: W.Words) -> W.Words:
    """The words, with the marks after a word's last letter as words of their own."""
    mark, ends = _MARKS[w.buf], w.ends
    some = np.flatnonzero(mark[ends - 1])
    runs = np.flatnonzero(mark & ~np.concatenate([[False], mark[:-1]]))
    stem = runs[np.searchsorted(runs, ends[some] - 1, "right") - 1]
    some, stem = some[stem > w.starts[some]], stem[stem > w.starts[some]]
    last, before = w.buf[stem - 1], w.buf[np.maximum(stem - 2, w.starts[some])]
    letter = (97 <= last) & (last <= 122) | (before == 0xC3) & (last >= 0x80) & (last != 0x97) & (last != 0xB7)
    some, stem = some[letter], stem[letter]
    ends = ends.copy()
    ends[some] = stem
    return W.Words(w.buf, np.insert(w.starts, some + 1, stem), np.insert(ends, some + 1, w.ends[some]), np.insert(w.doc, some + 1, w.doc[some]), w.n_docs)


class Known:
    """Ids by 64-bit hash: sorted hashes, and where in `ids` each one's stand."""

    def __init__(self):
        self.hash, self.at, self.size = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int32)
        self.ids = np.zeros(0, dtype="<u4")

    def holds(self, h: np.ndarray) -> np.ndarray:
        if not len(self.hash):
            return np.zeros(len(h), dtype=bool)
        return self.hash[np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)] == h

    def places(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where in ids, how many) of hashes that are known."""
        k = np.searchsorted(self.hash, h)
        return self.at[k], self.size[k].astype(np.int64)

    def of(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many, the ids in a row) of hashes that are known."""
        at, size = self.places(h)
        return size, self.ids[np.repeat(at - (np.cumsum(size) - size), size) + np.arange(size.sum())]

    def add(self, h: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Sorted hashes, none known yet."""
        k = np.searchsorted(self.hash, h)
        self.at = np.insert(self.at, k, len(self.ids) + np.cumsum(size) - size)
        self.size = np.insert(self.size, k, size)
        self.hash = np.insert(self.hash, k, h)
        self.ids = np.concatenate([self.ids, ids])


class WordTokens:
    """Ids of texts as little-endian unsigned 32-bit integers.

    A tokenizer that lower-cases, never joins what white space parts, and parts letters
    from punctuation has a text's ids as those of its words in a row, and a word's ids as
    those of its stem and of the punctuation after it; so each distinct one of these is
    encoded once for as long as it is kept, by its 64-bit hash: two generations of at
    most about _WORDS_KEPT. By other tokenizers whole texts are encoded.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # the two parts' own settings: the whole file, read as JSON, would take some 100 MB
        state = lambda part: json.loads(part.__getstate__()) if part is not None else None
        self.by_word = _parts_words({"normalizer": state(self.tokenizer.normalizer), "pre_tokenizer": state(self.tokenizer.pre_tokenizer)})
        gap = self.tokenizer.encode("0", add_special_tokens=False).ids
        self.gap = gap[0] if len(gap) == 1 else None
        self.model = self.tokenizer.model
        # what _encoded() takes for granted of the tokenizer, tried on every letter
        letters = [chr(c) for c in range(0x100) if _LETTERS.fullmatch(chr(c))]
        tries = [*letters, *(f"e{c}st{c}" for c in letters), "".join(letters)]
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_letters = self.by_word and not any(map(_LETTERS.fullmatch, added)) and all(self._of_letters(x) == self.tokenizer.encode(x, add_special_tokens=False).ids for x in tries)
        self.known, self.older = Known(), Known()

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and where each text's begin."""
        if not self.by_word:
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in lists], dtype=np.int64)])
            return np.fromiter(chain.from_iterable(lists), dtype="<u4", count=bounds[-1]), bounds
        if not pc.any(pc.match_substring(texts, pattern="<|")).as_py():  # special tokens are told by their case
            texts = pc.ascii_lower(texts)
        w = _stems_and_marks(W.split(texts))
        h = w.hashes(5)[0]
        order = np.argsort(h)
        first = np.concatenate([[True], h[order[1:]] != h[order[:-1]]]) if len(h) else np.zeros(0, dtype=bool)
        back = np.empty(len(h), dtype=np.int64)
        back[order] = np.cumsum(first) - 1
        one = order[first]
        if len(self.known.hash) > _WORDS_KEPT:
            self.known, self.older = Known(), self.known
        self._learn(h[one], w, one)
        at, size = self.known.places(h[one])
        n = size[back]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(at[back] - ends[:-1], n) + np.arange(ends[-1])
        return self.known.ids[at], ends[np.searchsorted(w.doc, np.arange(w.n_docs + 1))]

    def _learn(self, h: np.ndarray, w: W.Words, one: np.ndarray) -> None:
        """Makes all hashes (sorted; those of the words `one` of w) known."""
        new = ~self.known.holds(h)
        h, one = h[new], one[new]
        again = self.older.holds(h)
        if again.any():
            self.known.add(h[again], *self.older.of(h[again]))
        h, one, raw = h[~again], one[~again], w.buf.tobytes()
        for lo in range(0, len(h), _ENCODED_AT_ONCE):  # an encoding takes far more memory than its ids
            some = one[lo : lo + _ENCODED_AT_ONCE]
            got = self._encoded([raw[a:b] for a, b in zip(w.starts[some].tolist(), w.ends[some].tolist(), strict=True)])
            size = np.fromiter(map(len, got), dtype=np.int64, count=len(got)) // 4
            self.known.add(h[lo : lo + _ENCODED_AT_ONCE], size, np.frombuffer(b"".join(got), dtype="<u4"))

    def _of_letters(self, word: str) -> list[int]:
        """The ids of a word of _LETTERS, by the model alone."""
        return [x.id for x in self.model.tokenize(word.lower().translate(_AS_BYTES))]

    def _encoded(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word.

        Words of _LETTERS go to the model at once. Others without the digit 0 are encoded
        as one text, with that digit, an id of its own, between them.
        """
        out: list[bytes] = [b""] * len(words)
        row, alone, texts = [], [], [w.decode() for w in words]
        for k, t in enumerate(texts):
            if self.by_letters and _LETTERS.fullmatch(t):
                ids = self._of_letters(t)
                out[k] = struct.pack(f"<{len(ids)}I", *ids)
            else:
                (alone if self.gap is None or "0" in t else row).append(k)
        if row:
            together = self.tokenizer.encode_batch_fast([" 0 ".join([texts[k] for k in row])], add_special_tokens=False)[0].ids
            flat = np.array(together, dtype="<u4")
            at = 4 * np.flatnonzero(flat == self.gap)
            if len(at) == len(row) - 1:
                raw = flat.tobytes()
                for k, a, b in zip(row, [0, *(at + 4).tolist()], [*at.tolist(), len(raw)], strict=True):
                    out[k] = raw[a:b]
            else:
                alone += row
        lists = [e.ids for e in self.tokenizer.encode_batch_fast([texts[k] for k in alone], add_special_tokens=False)]
        for k, ids in zip(alone, lists, strict=True):
            out[k] = struct.pack(f"<{len(ids)}I", *ids)
        return out


_ENCODERS: dict[str, WordTokens] = {}  # of this worker process: later tasks find the words known


def encoder(path: str) -> WordTokens:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordTokens(path)
    return _ENCODERS[path]


class Packer:
    """Packs pieces (doc_id, start, ids, doc_tokens); rows of SCHEMA gather in `rows`."""

    def __init__(self, p: Packing, task: int):
        self.p, self.base, self.n_sequences = p, task << 40, 0
        self.pool: list[list[tuple]] = [[] for _ in range(p.window + 1)]  # by length
        self.lengths = 0  # bit n: there is a piece of n tokens
        self.pooled = 0
        self.filled = {}  # by sequence length: tokens so far, for the step groups
        self.rows: list[tuple] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        w, total = self.p.window, len(ids) // 4
        whole = total - total % w
        for at in range(0, whole, w):
            self._sequence([(doc_id, at, ids[4 * at : 4 * (at + w)], total)], w)
        if total > whole:
            self._put((doc_id, whole, ids[4 * whole :], total))
        if self.pooled >= self.p.pool_tokens:
            self.pack(self.p.pool_tokens // 4)

    def _put(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        self.pool[n].append(piece)
        self.lengths |= 1 << n
        self.pooled += n

    def _take(self, most: int, least: int = 1) -> tuple | None:
        """The longest piece of least to most tokens."""
        n = (self.lengths & ((1 << (most + 1)) - 1)).bit_length() - 1
        if n < least:
            return None
        piece = self.pool[n].pop()
        if not self.pool[n]:
            self.lengths ^= 1 << n
        self.pooled -= n
        return piece

    def _cut(self, piece: tuple, n: int) -> tuple:
        """The first n tokens; the rest goes back to its tier."""
        doc_id, start, ids, total = piece
        self._put((doc_id, start + n, ids[4 * n :], total))
        return doc_id, start, ids[: 4 * n], total

    def pack(self, keep: int = 0) -> None:
        """Packs tier by tier until at most about `keep` tokens, the shortest pieces, are left."""
        tiers = sorted(self.p.tiers, reverse=True)
        for tier, below in zip(tiers, [*tiers[1:], 0], strict=True):
            while self.pooled > max(keep, tier - 1) and (piece := self._take(tier, below + 1)):
                pieces, gap = [piece], tier - len(piece[2]) // 4
                while gap:
                    if piece := self._take(gap):
                        gap -= len(piece[2]) // 4
                    else:  # all that is left is longer than the gap
                        n = (self.lengths & -self.lengths).bit_length() - 1
                        piece, gap = self._cut(self._take(n), gap), 0
                    pieces.append(piece)
                self._sequence(pieces, tier)

    def close(self) -> None:
        self.pack()
        while self.pooled:
            n = 1 << (min(self.pooled, self.p.window).bit_length() - 1)
            pieces, gap = [], n
            while gap:
                piece = self._take(self.p.window)
                if len(piece[2]) // 4 > gap:
                    piece = self._cut(piece, gap)
                gap -= len(piece[2]) // 4
                pieces.append(piece)
            self._sequence(pieces, n)

    def _sequence(self, pieces: list[tuple], length: int) -> None:
        number, offset = self.base + self.n_sequences, 0
        done = self.filled.get(length, 0)
        group = self.base + (length.bit_length() << 34) + done // self.p.step_tokens
        self.filled[length] = done + length
        self.n_sequences += 1
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, ids, total, number, offset, length, group))
            offset += len(ids) // 4

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        columns = list(zip(*self.rows, strict=True)) or [()] * len(names)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def pack_documents(docs: DataFrame, packing: Packing, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per piece: SCHEMA, `ids` as little-endian unsigned 32-bit integers.

    Null and empty texts have the end id alone; a null id stays null; repeated rows are
    packed once each; texts of any length are cut; an empty table gives no rows; other
    columns are ignored. sequence_id and step_group are unique over all tasks and depend
    only on the partition, so a task that runs again makes the same rows.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = encoder(packing.tokenizer)
        packer = Packer(packing, TaskContext.get().partitionId())
        end = packing.end_id.to_bytes(4, "little")
        gc.disable()  # nothing here is cyclic; passes over all known words would only take time
        try:
            for batch in batches:
                texts = pc.fill_null(batch.column(1), "")
                for at, n in W.portions(texts, _BYTES_AT_ONCE):
                    ids, bounds = words.encode_all(texts.slice(at, n))
                    for doc_id, a, b in zip(batch.column(0).slice(at, n).to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
                        packer.add(doc_id, ids[a:b].tobytes() + end)
                    yield packer.batch()
        finally:
            words.older = Known()
            gc.enable()
        packer.close()
        yield packer.batch()

    return docs.select(docs[id_column].cast("long"), docs[text_column].cast("string")).mapInArrow(tidied(task), SCHEMA)
