"""Removal of word windows that an earlier document holds, by level-wise doubling.

Lengths double up to the window asked for (13 words: 7, then 13 as two overlapping
sevens). A window is a candidate at one length only if both of its halves were
repeated at the length before; candidates alone are sent and compared, so once none
survive the lengths after send nothing. The last level compares 96 bits of hash and the
smallest document id of each window. Texts are split and hashed again at each length
rather than kept between them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from crawlgrain.llm import exchange as X
from crawlgrain.llm import words as W

U64 = np.uint64
_SHORTEST = 5
_NO_ID = np.int64(2**63 - 1)


def level_lengths(window: int, shortest: int = _SHORTEST) -> list[int]:
    """Window lengths from the first level to the last, each at most twice the one before."""
    out = [window]
    while -(-out[0] // 2) >= shortest:
        out.insert(0, -(-out[0] // 2))
    return out


class _Level:
    """The windows of one length in one group: candidates, their distinct hashes, what was found."""

    def __init__(self, at: np.ndarray, h: np.ndarray, doc: np.ndarray):
        self.at, order = at, np.argsort(h, kind="stable")
        h = h[order]
        first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, dtype=bool)
        starts = np.flatnonzero(first)
        self.values = h[starts]
        self.back = np.empty(len(h), dtype=np.int64)  # of each window, its distinct hash
        self.back[order] = np.cumsum(first) - 1
        self.order, self.starts = order, starts
        if len(h):
            ids = doc[at[order]]
            self.least, self.most = np.minimum.reduceat(ids, starts), np.maximum.reduceat(ids, starts)
        else:
            self.least = self.most = np.zeros(0, dtype=np.int64)


def _levels(w: W.Words, ids: np.ndarray, lengths: list[int], bits: int, found: Callable[[int, np.ndarray], np.ndarray], upto: int) -> tuple[_Level, np.ndarray, np.ndarray]:
    """The level `upto`, its second hashes (at the last level) and the words' hashes."""
    hw = w.hashes()[0]
    doc = ids[w.doc]
    alive, shorter = None, 0
    for k in range(upto + 1):
        size, last = lengths[k], k == len(lengths) - 1
        at, h = W.windows(hw, w.doc, size)
        if alive is not None:
            both = alive[at] & alive[at + size - shorter]
            at, h = at[both], h[both]
        level = _Level(at, h if last else h >> U64(64 - bits), doc)
        if k == upto:
            check = W.windows(hw, w.doc, size, seed=3)[1] if last else None
            if check is not None:
                check = check[both] if alive is not None else check
                check = (check >> U64(32)).astype(np.uint32)[level.order][level.starts]
            return level, check, hw
        yes = found(k, level.values) | (level.least != level.most)
        alive, shorter = np.zeros(len(hw), dtype=bool), size
        alive[level.at] = yes[level.back]
    raise AssertionError


def _other_groups(table: pa.Table) -> pa.Table:
    """A bit for each hash of a bucket: another group has it too."""
    level, bucket = table.column("level")[0].as_py(), table.column("bucket")[0].as_py()
    heads, arrays = X.read_blocks(table)
    values = np.concatenate([a[0] for a in arrays])
    order = np.sort(values)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    return X.answer_table(X.answers(heads, _member(values, twice), level, bucket))


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def _earlier_group(table: pa.Table) -> pa.Table:
    """A bit for each window of a bucket: another group holds it in a document with a smaller id."""
    level, bucket = table.column("level")[0].as_py(), table.column("bucket")[0].as_py()
    heads, arrays = X.read_blocks(table, np.uint32, np.int64)
    values, check, ids = (np.concatenate([a[k] for a in arrays]) for k in range(3))
    order = np.lexsort((check, values))
    v, c = values[order], check[order]
    first = np.concatenate([[True], (v[1:] != v[:-1]) | (c[1:] != c[:-1])])
    least = np.minimum.reduceat(ids[order], np.flatnonzero(first))
    yes = np.empty(len(values), dtype=bool)
    yes[order] = least[np.cumsum(first) - 1] < ids[order]
    return X.answer_table(X.answers(heads, yes, level, bucket))


def _ids(column: pa.ChunkedArray) -> np.ndarray:
    return column.fill_null(int(_NO_ID)).to_numpy()


def repeated_words(docs: DataFrame, window: int = 13, id_column: str = "doc_id", text_column: str = "text", finish: Callable[[int | None, bytes, np.ndarray, np.ndarray, np.ndarray], tuple] | None = None, schema: pa.Schema | None = None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (its other words joined by one space).

    Removed are the words under a window of `window` words whose word sequence also
    starts in a document with a smaller id; windows are judged on the input. Null
    texts have no words; a null id counts as larger than all others; rows of equal id
    don't remove each other's words; texts of any length are read whole; an empty
    table gives no rows; other columns are ignored. `finish` and `schema` may replace
    what is returned of a document: it gets its id, buffer, word starts, word ends and
    the mask of removed words.
    """
    cut, lengths = X.sizes(docs, text_column), level_lengths(window)
    groups = X.grouped(docs, cut, id_column, text_column).groupBy("grp")
    last, bits = len(lengths) - 1, cut.bits
    finish = finish or _kept
    schema = schema or pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def blocks_of(docs_table: pa.Table, answer: pa.Table | None, k: int) -> pa.Table:
        grp, ids = docs_table.column("grp")[0].as_py(), _ids(docs_table.column("doc_id"))
        level, check, _ = _levels(W.split(docs_table.column("text")), ids, lengths, bits, lambda j, v: X.read_answers(answer, j, v, cut.buckets, bits), k)
        extra = (check, level.least) if k == last else ()
        return X.block_table(X.blocks(grp, k, level.values, cut.buckets, 64 if k == last else bits, extra))

    def sent_at(k: int, told: DataFrame | None) -> DataFrame:
        def first(t: pa.Table) -> pa.Table:
            return blocks_of(t, None, k)

        def later(t: pa.Table, a: pa.Table) -> pa.Table:
            return blocks_of(t, a, k) if t.num_rows else X.block_table([])

        if told is None:
            return groups.applyInArrow(first, X.BLOCK)
        return groups.cogroup(told.groupBy("grp")).applyInArrow(later, X.BLOCK)

    def final(docs_table: pa.Table, answer: pa.Table) -> pa.Table:
        ids = _ids(docs_table.column("doc_id"))
        w = W.split(docs_table.column("text"))
        level, _, _ = _levels(w, ids, lengths, bits, lambda j, v: X.read_answers(answer, j, v, cut.buckets, bits), last)
        earlier = X.read_answers(answer, last, level.values, cut.buckets, 64)
        bad = level.at[earlier[level.back] | (ids[w.doc[level.at]] > level.least[level.back])]
        gone = W.cover(len(w.starts), bad, window)
        bounds = np.searchsorted(w.doc, np.arange(w.n_docs + 1))
        raw = w.buf.tobytes()
        rows = [finish(i, raw, w.starts[a:b], w.ends[a:b], gone[a:b]) for i, a, b in zip(docs_table.column("doc_id").to_pylist(), bounds, bounds[1:], strict=False)]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    told: DataFrame | None = None
    for k in range(last + 1):
        sent = sent_at(k, told)
        part = sent.groupBy("bucket").applyInArrow(_earlier_group if k == last else _other_groups, X.ANSWER)
        told = part if told is None else told.unionByName(part)
    out = ", ".join(f"{f.name} {_NAMES[f.type]}" for f in schema)

    def finished(t: pa.Table, a: pa.Table) -> pa.Table:
        return final(t, a) if t.num_rows else schema.empty_table()

    return groups.cogroup(told.groupBy("grp")).applyInArrow(finished, out)


_NAMES = {pa.int64(): "long", pa.string(): "string"}


def _kept(doc_id: int | None, buf: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> tuple:
    keep = ~gone
    return doc_id, len(starts), int(gone.sum()), b" ".join([buf[a:b] for a, b in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]).decode()


def _digest(doc_id: int | None, buf: bytes, starts: np.ndarray, ends: np.ndarray, gone: np.ndarray) -> tuple:
    *row, kept = _kept(doc_id, buf, starts, ends, gone)
    return *row, hashlib.sha256(kept.encode()).hexdigest()


def digests(docs: DataFrame, window: int = 13) -> DataFrame:
    """repeated_words() with the SHA-256 of the kept words in place of the words themselves."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
    return repeated_words(docs, window, finish=_digest, schema=schema)
