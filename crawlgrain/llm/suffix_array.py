"""Repeated passages by sparse suffix arrays.

Suffixes start at content-selected positions alone: the smallest of the eight-word
grams in every run of `window` words. Equal runs select the same gram, so suffixes
that could match meet. Kept suffixes are those whose gram another document has; they
carry the words that can still belong to a run with the gram, to the right and to the
left. Sorted by gram and right context, and by gram and left context, a suffix is
compared with its nearest of other documents, matches extended in both directions, and
kept if they reach `window` words. Where others might reach further, windows are hashed
and compared. The order is cut by ranges of whole sort keys, so a gram in a third of all
documents is dealt to many tasks; the windows of grams that stand at cuts are compared
by their hashes alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlgrain.llm import exchange as X
from crawlgrain.llm import words as W
from crawlgrain.llm.cluster import durable, parts, tidied
from crawlgrain.llm.substring_dedup import _NO_ID, _ids, _other_groups

U64 = np.uint64
GRAM = 8
WINDOW = 50
#: Suffixes that a task holds at once.
PIECE = 60_000
_SUFFIX = "grp int, sid int, gram long, rightward binary, leftward binary, doc long, full_left int, full_right int, here boolean, members array<struct<row:int,doc_id:long,at:int>>"
_MEMBERS = pa.list_(pa.struct([("row", pa.int32()), ("doc_id", pa.int64()), ("at", pa.int32())]))
_MATCH = "grp int, sid int, leftward int, rightward int"


def _sliding(values: np.ndarray, size: int, f: np.ufunc, fill: int) -> np.ndarray:
    """f over values[i : i + size] for every i, missing ones as `fill`; linear in time."""
    n = len(values)
    padded = np.full(-(-(n + size) // size) * size, fill, dtype=values.dtype)
    padded[:n] = values
    rows = padded.reshape(-1, size)
    ahead = f.accumulate(rows, axis=1).ravel()
    behind = f.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return f(behind[:n], ahead[size - 1 : size - 1 + n]) if size > 1 else values.copy()


class _Suffixes:
    """Selected suffixes of one group of documents."""

    def __init__(self, texts: pa.ChunkedArray, ids: np.ndarray, window: int):
        self.w = w = W.split(texts)
        self.ids, self.window, self.context = ids, window, window - GRAM
        self.hw = w.hashes(6)[0]
        n = len(self.hw)
        self.at = np.zeros(0, dtype=np.int64)
        self.gram = np.zeros(0, dtype=U64)
        if n < window:
            return
        at, h = W.windows(self.hw, w.doc, GRAM)
        grams = np.full(n, ~U64(0))
        grams[at] = h
        least = _sliding(grams, self.context + 1, np.minimum, 2**64 - 1)
        whole = np.zeros(n, dtype=bool)
        whole[: n - window + 1] = w.doc[: n - window + 1] == w.doc[window - 1 :]
        least[~whole] = 0
        # the largest minimum of the windows that a position is in: its own gram if it is one's minimum
        best = _sliding(least[::-1], self.context + 1, np.maximum, 0)[::-1]
        self.at = np.flatnonzero((best == grams) & (grams != ~U64(0)))
        self.gram = grams[self.at]

    def narrowed(self, shared: np.ndarray) -> None:
        self.at, self.gram = self.at[shared], self.gram[shared]

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """Word marks right and left of each gram, big-endian to sort as bytes; zero beyond the document."""
        marks = (self.hw >> U64(48)).astype(np.uint16)
        marks[marks == 0] = 1
        steps = np.arange(self.context)
        doc, n = self.w.doc, len(marks)
        out = []
        for place in (self.at[:, None] + GRAM + steps, self.at[:, None] - 1 - steps):
            inside = (place >= 0) & (place < n)
            place = np.where(inside, place, 0)
            inside &= doc[place] == doc[self.at][:, None]
            out.append(np.where(inside, marks[place], 0).astype(">u2"))
        return out[0], out[1]

    def collapsed(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct (gram, contexts): first row of each, each suffix's number, smallest and largest document id, contexts."""
        right, left = self.contexts()
        p = W.poly(7)
        width = 2 * self.context
        flat = np.concatenate([right, left], axis=1).astype(U64).ravel()
        starts = np.arange(len(self.at)) * width
        key = W.mix(p.ranges(p.prefix(flat), starts, starts + width) ^ self.gram) if len(starts) else self.gram
        order = np.argsort(key, kind="stable")
        first = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if len(key) else np.zeros(0, dtype=bool)
        number = np.empty(len(key), dtype=np.int64)
        number[order] = np.cumsum(first) - 1
        ids = self.ids[self.w.doc[self.at]][order]
        at = np.flatnonzero(first)
        least = np.minimum.reduceat(ids, at) if len(at) else ids
        most = np.maximum.reduceat(ids, at) if len(at) else ids
        return order[first], number, least, most, right, left


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the equal beginnings of rows; a zero ends a row."""
    differ = np.ones((len(a), a.shape[1] + 1), dtype=bool)
    np.logical_or(a != b, a == 0, out=differ[:, :-1])
    return differ.argmax(axis=1)


def _reaches(gram: np.ndarray, right: np.ndarray, left: np.ndarray, doc: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
    """(2, n) each, left then right: the furthest match found, and how far suffixes of other documents reach at most.

    A suffix is compared with the nearest ones of another document on both sides of
    its place in either order. None has a longer equal context on the order's side.
    """
    n = len(gram)
    best, most = np.full((2, n), -1, dtype=np.int64), np.zeros((2, n), dtype=np.int64)
    for side, marks in enumerate((left, right)):
        big = np.ascontiguousarray(marks.astype(">u2")).view(f"S{2 * marks.shape[1]}").ravel()
        order = np.lexsort((big, gram))
        g, d = gram[order], doc[order]
        new = np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]) if n else np.zeros(0, dtype=bool)
        run, starts = np.cumsum(new) - 1, np.flatnonzero(new)
        for other in (starts[run] - 1, np.append(starts[1:], n)[run]):
            at = np.flatnonzero((other >= 0) & (other < n))
            at = at[g[at] == g[other[at]]]
            for lo in range(0, len(at), 50_000):
                p = at[lo : lo + 50_000]
                i, j = order[p], order[other[p]]
                reach = np.stack([_common(left[i], left[j]), _common(right[i], right[j])])
                most[side, i] = np.maximum(most[side, i], reach[side])
                enough = reach.sum(axis=0) >= need
                best[:, i[enough]] = np.maximum(best[:, i[enough]], reach[:, enough])
    return best, most


class _Windows:
    """The hashed windows around suffixes: those that reach at most `most` to the left and right of the gram."""

    def __init__(self, gram: np.ndarray, right: np.ndarray, left: np.ndarray, most: np.ndarray, seed: int = 7):
        need, p = right.shape[1], W.poly(seed)
        first = np.maximum(0, need - most[1])
        count = np.maximum(0, most[0] - first + 1)
        self.row = np.repeat(np.arange(len(gram)), count)
        self.leftward = np.arange(len(self.row)) - np.repeat(np.cumsum(count) - count - first, count)
        self.rightward = need - self.leftward
        self.hash = np.empty(len(self.row), dtype=U64)
        bounds = np.concatenate([[0], np.cumsum(count)])
        for lo in range(0, len(gram), 20_000):
            hi = min(lo + 20_000, len(gram))
            a, b = bounds[lo], bounds[hi]
            flat = np.concatenate([left[lo:hi, ::-1], right[lo:hi]], axis=1).astype(U64).ravel()
            begin = (self.row[a:b] - lo) * 2 * need + need - self.leftward[a:b]
            whole = p.ranges(p.prefix(flat), begin, begin + need)
            self.hash[a:b] = W.mix(W.mix(whole ^ gram.view(U64)[self.row[a:b]]) + self.leftward[a:b].astype(U64))

    def distinct(self, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes, a window of each, the hash's number of every window, and whether documents share the hash."""
        order = np.argsort(self.hash, kind="stable")
        h, ids = self.hash[order], doc[self.row[order]]
        first = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, dtype=bool)
        starts = np.flatnonzero(first)
        back = np.empty(len(h), dtype=np.int64)
        back[order] = np.cumsum(first) - 1
        several = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts) if len(h) else np.zeros(0, dtype=bool)
        return h[starts], order[starts], back, several

    def reach(self, best: np.ndarray, rows: np.ndarray, shared: np.ndarray) -> None:
        """best gets the furthest shared windows; `rows` are the places of the suffixes in it."""
        np.maximum.at(best[0], rows[self.row[shared]], self.leftward[shared])
        np.maximum.at(best[1], rows[self.row[shared]], self.rightward[shared])


def _arrays(table: pa.Table, context: int) -> tuple[np.ndarray, ...]:
    wide = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), dtype=">u2").reshape(-1, context).astype(np.uint16)
    return table.column("gram").to_numpy(), wide("rightward"), wide("leftward"), table.column("doc").to_numpy()


def _found(table: pa.Table, best: np.ndarray) -> pa.Table:
    hit = np.flatnonzero(best[0] >= 0)
    return pa.table({"grp": table.column("grp").take(hit), "sid": table.column("sid").take(hit), "leftward": pa.array(best[0][hit], pa.int32()), "rightward": pa.array(best[1][hit], pa.int32())})


def _matches(table: pa.Table, window: int) -> pa.Table:
    """Matches (_MATCH) among all suffixes of some grams."""
    gram, right, left, doc = _arrays(table, window - GRAM)
    best, most = _reaches(gram, right, left, doc, window - GRAM)
    likely = most.sum(axis=0) >= window - GRAM
    # where the nearest don't reach as far as might be, a window may be shared with one that is near in neither order
    rows = np.flatnonzero(likely & np.isin(gram, gram[likely & (best < most).any(axis=0)]))
    if len(rows):
        w = _Windows(gram[rows], right[rows], left[rows], most[:, rows])
        _, _, back, several = w.distinct(doc[rows])
        w.reach(best, rows, several[back])
    return _found(table, best)


def _held_elsewhere(table: pa.Table) -> pa.Table:
    """A bit for each window of a bucket: another group has it too, by 96 bits of hash."""
    heads, arrays = X.read_blocks(table, np.uint32)
    values, check = (np.concatenate([a[k] for a in arrays]) for k in range(2))
    order = np.lexsort((check, values))
    v, c = values[order], check[order]
    same = (v[1:] == v[:-1]) & (c[1:] == c[:-1])
    yes = np.empty(len(values), dtype=bool)
    yes[order] = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    return X.answer_table(X.answers(heads, yes, table.column("level")[0].as_py(), table.column("bucket")[0].as_py()))


def _neighbours(rows: DataFrame, cut: X.Sizes, window: int) -> DataFrame:
    """Matches of all suffixes. Tasks take ranges of the sorted order in pieces of bounded size.

    A gram at either end of a piece may go on in another. Its suffixes are left to
    the groups, which ask each other for all their windows.
    """
    piece = PIECE

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            held = t if held is None else pa.concat_tables([held, t])
            while held.num_rows >= piece:
                yield from one(held.slice(0, piece).combine_chunks())
                held = held.slice(piece)
        if held is not None and held.num_rows:
            yield from one(held.combine_chunks())

    def one(t: pa.Table) -> Iterator[pa.RecordBatch]:
        gram = t.column("gram").to_numpy()
        ends = (gram == gram[0]) | (gram == gram[-1])
        m, e = _matches(t.filter(pa.array(~ends)), window), t.filter(pa.array(ends))
        none, nothing = pa.nulls(m.num_rows, pa.int64()), pa.nulls(m.num_rows, pa.binary())
        yield from pa.table([*m.columns, none, nothing, nothing, none], names=names).to_batches()
        none = pa.nulls(e.num_rows, pa.int32())
        yield from pa.table([e.column("grp"), e.column("sid"), none, none, *(e.column(c) for c in ("gram", "rightward", "leftward", "doc"))], names=names).to_batches()

    names = ["grp", "sid", "leftward", "rightward", "gram", "r", "l", "doc"]
    schema = "grp int, sid int, leftward int, rightward int, gram long, r binary, l binary, doc long"

    def windows(t: pa.Table, seed: int = 7) -> tuple[_Windows, np.ndarray]:
        gram, right, left, doc = _arrays(t, window - GRAM)
        return _Windows(gram, right, left, np.stack([(left != 0).sum(axis=1), (right != 0).sum(axis=1)]), seed), doc

    def ask(t: pa.Table) -> pa.Table:
        w, doc = windows(t)
        values, one_each, _, _ = w.distinct(doc)
        check = (windows(t, 3)[0].hash[one_each] >> U64(32)).astype(np.uint32)
        return X.block_table(X.blocks(t.column("grp")[0].as_py(), 0, values, cut.buckets, 64, (check,)))

    def told(t: pa.Table, a: pa.Table) -> pa.Table:
        w, doc = windows(t) if t.num_rows else (None, None)
        best = np.full((2, t.num_rows), -1, dtype=np.int64)
        if w is not None:
            values, _, back, several = w.distinct(doc)
            w.reach(best, np.arange(t.num_rows), (X.read_answers(a, 0, values, cut.buckets, 64) | several)[back])
        return _found(t, best)

    order = ["gram", "rightward", "leftward"]
    got = durable(rows.repartitionByRange(parts(rows.sparkSession), *order).sortWithinPartitions(*order).mapInArrow(tidied(task), schema))
    cuts = got.where("leftward is null").select("grp", "sid", "gram", F.col("r").alias("rightward"), F.col("l").alias("leftward"), "doc").groupBy("grp")
    answers = cuts.applyInArrow(ask, X.BLOCK).groupBy("bucket").applyInArrow(_held_elsewhere, X.ANSWER)
    across = cuts.cogroup(answers.groupBy("grp")).applyInArrow(told, _MATCH)
    return got.where("leftward is not null").select("grp", "sid", "leftward", "rightward").unionByName(across)


def repeated_passages(docs: DataFrame, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Maximal word ranges (doc_id, first_word, n_words) under runs of `window` words that other documents hold too.

    Words are runs without white space, unchanged. Null and shorter texts have no
    range; a null id is a document of its own that counts as one with the others of
    null id; rows of equal id aren't compared; texts of any length are read whole; an
    empty table gives no rows; other columns are ignored.
    """
    cut = X.sizes(docs, text_column)
    groups = X.grouped(docs, cut, id_column, text_column).groupBy("grp")
    bits = cut.bits

    def level(s: _Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        values, back = np.unique(s.gram >> U64(64 - bits), return_inverse=True)
        ids = s.ids[s.w.doc[s.at]]
        least, most = np.full(len(values), _NO_ID), np.full(len(values), -(2**63))
        np.minimum.at(least, back, ids)
        np.maximum.at(most, back, ids)
        return values, back, least != most

    def shared(t: pa.Table, a: pa.Table) -> _Suffixes:
        s = _Suffixes(t.column("text"), _ids(t.column("doc_id")), window)
        values, back, here = level(s)
        s.narrowed((X.read_answers(a, 0, values, cut.buckets, bits) | here)[back])
        return s

    def ask(t: pa.Table) -> pa.Table:
        s = _Suffixes(t.column("text"), _ids(t.column("doc_id")), window)
        return X.block_table(X.blocks(t.column("grp")[0].as_py(), 0, level(s)[0], cut.buckets, bits))

    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), _MEMBERS)
    names = [x.split()[0] for x in _SUFFIX.split(", ")]

    def select(t: pa.Table, a: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        s, grp = shared(t, a), t.column("grp")[0].as_py()
        first, number, least, most, right, left = s.collapsed()
        n, width = len(first), 2 * s.context
        raw = lambda x: pa.array(np.ascontiguousarray(x[first]).view(f"V{width}").ravel().tolist() if n else [], pa.binary())
        # a suffix of several documents differs from every other's
        doc = np.where(least != most, -2 - (np.int64(grp) << 32) - np.arange(n), least)
        n_left, n_right = ((x[first] != 0).sum(axis=1) for x in (left, right))
        here = (least != most) & (n_left + n_right >= s.context)
        order = np.argsort(number, kind="stable")
        row, at = s.w.doc[s.at][order], s.at[order]
        begins = np.searchsorted(s.w.doc, np.arange(s.w.n_docs))
        structs = pa.StructArray.from_arrays([pa.array(row, pa.int32()), t.column("doc_id").combine_chunks().take(pa.array(row)), pa.array(at - begins[row], pa.int32())], fields=list(_MEMBERS.value_type))
        bounds = np.searchsorted(number[order], np.arange(n + 1))
        members = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), structs)
        columns = [np.full(n, grp), np.arange(n), s.gram[first].view(np.int64), raw(right), raw(left), doc, n_left, n_right, here, members]
        return pa.table([c if isinstance(c, pa.Array) else pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    answers = groups.applyInArrow(ask, X.BLOCK).groupBy("bucket").applyInArrow(_other_groups, X.ANSWER)
    suffixes = durable(groups.cogroup(answers.groupBy("grp")).applyInArrow(select, _SUFFIX))
    matches = _neighbours(suffixes.select("grp", "sid", "gram", "rightward", "leftward", "doc"), cut, window)
    whole = suffixes.where("here").select("grp", "sid", F.col("full_left").alias("leftward"), F.col("full_right").alias("rightward"))
    reach = matches.unionByName(whole).groupBy("grp", "sid").agg(F.max("leftward").alias("leftward"), F.max("rightward").alias("rightward"))
    spans = suffixes.select("grp", "sid", "members").join(reach, ["grp", "sid"]).select("grp", "leftward", "rightward", F.explode("members").alias("m"))
    spans = spans.select("grp", F.col("m.row").alias("row"), F.col("m.doc_id").alias("doc_id"), (F.col("m.at") - F.col("leftward")).cast("long").alias("a"), (F.col("m.at") + GRAM + F.col("rightward")).cast("long").alias("b"))
    of = Window.partitionBy("grp", "row")
    past = F.max("b").over(of.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.withColumn("new", F.when(F.col("a") <= past, 0).otherwise(1)).withColumn("island", F.sum("new").over(of.orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("grp", "row", "island").agg(F.first("doc_id").alias("doc_id"), F.min("a").alias("first_word"), (F.max("b") - F.min("a")).alias("n_words")).select("doc_id", "first_word", "n_words")
