"""Benchmark decontamination by greedy string tiling over Karp-Rabin seeds.

Seeds are runs of five words, as rolling hashes. An item covered far enough shares so
many seeds with a document that it shares one of its rarest: these alone are looked up,
so a run of words that every item holds costs nothing. Where one is shared, the longest
match whose words are all unmarked is marked in both, again and again, down to the seed
length. The share of the item's words under such tiles is its coverage, in whatever
order the tiles stand. A benchmark of bounded size travels to the documents, which
aren't shuffled; of a larger one a filter does, and what passes it is joined.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crawlgrain.llm import words as W
from crawlgrain.llm.cluster import durable, parted, small, text_bytes, tidied

U64 = np.uint64
SEED_WORDS = 5
#: Share of an item's words that must be found in one document.
COVERAGE = 0.6
#: Benchmark text up to which it travels to the documents whole.
PART_BYTES = 32 << 20
_FILTER_BITS = 22
#: Bits of the filter of a larger benchmark's seeds: 32 MB.
_FAR_BITS = 28
SCHEMA = "doc_id long, item_id long, coverage double, tiles array<struct<doc_word:int,item_word:int,words:int>>"
_TILES = pa.list_(pa.struct([("doc_word", pa.int32()), ("item_word", pa.int32()), ("words", pa.int32())]))


def _split(texts: pa.Array) -> W.Words:
    """Lower-cased words: runs of letters and digits."""
    return W.split(pc.utf8_lower(texts), W.PUNCT)


def _needed(words: np.ndarray, coverage: float, seed: int) -> np.ndarray:
    """Different places of an item at which seeds are shared, at least, if it is covered: its tiles' words over the seed length."""
    return np.maximum(1, np.ceil(np.ceil(coverage * words - 1e-9) / seed - 1e-9)).astype(np.int64)


def _rarest(item: np.ndarray, frequency: np.ndarray, words: np.ndarray, coverage: float, seed: int) -> np.ndarray:
    """Mask of seeds (in the order of items) of which a covered item shares one: all but the most frequent `needed` - 1."""
    order = np.lexsort((frequency, item))
    begin = np.searchsorted(item[order], np.arange(len(words)))
    rank = np.arange(len(item)) - begin[item[order]]
    out = np.zeros(len(item), dtype=bool)
    size = np.bincount(item, minlength=len(words))
    out[order] = rank <= (size - _needed(words, coverage, seed))[item[order]]
    return out


class Seeds:
    """The seeds of some benchmark items: of each item all, by place, and the rarest by hash."""

    def __init__(self, item_ids: list[int | None], texts: pa.Array, seed: int, coverage: float):
        w = _split(texts)
        self.ids, self.words, self.seed = item_ids, w.counts(), seed
        at, h = W.windows(w.hashes()[0], w.doc, seed)
        item = w.doc[at]
        self.all, self.bounds = h, np.searchsorted(item, np.arange(w.n_docs + 1))
        _, back, n = np.unique(h, return_inverse=True, return_counts=True)
        rare = _rarest(item, n[back], self.words, coverage, seed) if len(h) else np.zeros(0, dtype=bool)
        h, item = h[rare], item[rare]
        order = np.argsort(h, kind="stable")
        self.hash, self.item = h[order], item[order]
        self.maybe = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.maybe[self.hash >> U64(64 - _FILTER_BITS)] = True

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into h, item) that share one of the item's rarest seeds."""
        some = np.flatnonzero(self.maybe[h >> U64(64 - _FILTER_BITS)])
        low, high = np.searchsorted(self.hash, h[some]), np.searchsorted(self.hash, h[some], "right")
        n = high - low
        return np.repeat(some, n), self.item[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def shared_places(doc: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in doc, places in item) of all equal seeds of the two."""
    order = np.argsort(doc, kind="stable")
    found = doc[order]
    low, high = np.searchsorted(found, item), np.searchsorted(found, item, "right")
    n = high - low
    return order[np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())], np.repeat(np.arange(len(item)), n)


def covered(doc: np.ndarray, item: np.ndarray, words: int, seed: int, coverage: float) -> tuple[float, list[tuple[int, int, int]]] | None:
    """(coverage, tiles) of an item of so many words, from both sides' seeds, if it is covered far enough."""
    p, q = shared_places(doc, item)
    if not len(q):
        return None
    places = np.unique(q)
    most = int(np.minimum(np.diff(places), seed).sum()) + seed
    if most < coverage * words - 1e-9:
        return None
    found = tiles(p, q, seed)
    share = sum(n for _, _, n in found) / words
    return (share, found) if share >= coverage - 1e-12 else None


def tiles(p: np.ndarray, q: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from the seed hits (document word, item word) of one pair: longest first, then leftmost."""
    order = np.lexsort((p, p - q))
    p, q = p[order], q[order]
    new = np.concatenate([[True], (np.diff(p) != 1) | (np.diff(p - q) != 0)])
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(p))) + seed - 1
    heap = [(-int(n), int(p[i]), int(q[i])) for i, n in zip(first, size, strict=True)]
    heapq.heapify(heap)
    in_doc, in_item, out = set(), set(), []
    while heap:
        n, a, b = heapq.heappop(heap)
        free = [a + k not in in_doc and b + k not in in_item for k in range(-n)]
        if all(free):
            in_doc.update(range(a, a - n))
            in_item.update(range(b, b - n))
            out.append((a, b, -n))
            continue
        at = 0
        while at < -n:  # what is left of it may still be the longest later
            to = at
            while to < -n and free[to]:
                to += 1
            if to - at >= seed:
                heapq.heappush(heap, (at - to, a + at, b + at))
            at = to + 1
    return sorted(out)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED_WORDS, id_column: str = "doc_id", text_column: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """One row per document and benchmark item that it covers to `coverage` or more: SCHEMA.

    Words are lower-cased runs of letters and digits. Items of fewer than `seed` words
    (null and empty ones too) are too short to tell and match nothing, as do null and
    empty documents. Null ids are kept as null; repeated documents or items give
    repeated rows; an empty table on either side gives none; other columns are ignored.
    A benchmark of more than part_bytes isn't brought to one place: see _far().
    """
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    if text_bytes(benchmark, "text") > part_bytes:
        found = _far(rows, benchmark, coverage, seed)
        return rows.select("doc_id", F.xxhash64("text").alias("text_key")).join(found, ["text_key"]).select("doc_id", "item_id", "coverage", "tiles")
    seeds = _seeds(benchmark, seed, coverage)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _match(batch.column(0), batch.column(1), seeds, coverage)

    return rows.mapInArrow(tidied(task), SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED_WORDS, text_column: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """The rows of docs that contaminated() doesn't name, all columns as they are; with a bounded benchmark, without a shuffle."""
    if text_bytes(benchmark, "text") > part_bytes:
        found = durable(_far(docs.select(docs[text_column].cast("string").alias("text")), benchmark, coverage, seed).select("text_key").distinct())
        key = F.xxhash64(docs[text_column].cast("string"))
        if small(found, 32):
            return docs.join(F.broadcast(found), key == found["text_key"], "left_anti")
        safe, some = parted(docs, found, key)
        return safe.unionByName(some.join(found, F.xxhash64(some[text_column].cast("string")) == found["text_key"], "left_anti"))
    seeds = _seeds(benchmark, seed, coverage)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_column)).cast(pa.string())
            hit = _match(pa.array(np.arange(len(texts))), texts, seeds, coverage).column(0).to_numpy()
            keep = np.ones(len(texts), dtype=bool)
            keep[hit] = False
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(tidied(task), docs.schema)


def _seeds(benchmark: DataFrame, seed: int, coverage: float) -> Seeds:
    """All seeds of a benchmark of bounded size."""
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toArrow()
    return Seeds(rows.column(0).to_pylist(), rows.column(1).combine_chunks(), seed, coverage)


def _far(rows: DataFrame, benchmark: DataFrame, coverage: float, seed: int) -> DataFrame:
    """(text_key, item_id, coverage, tiles) for a benchmark of any size; rows: (text, ...).

    Documents send the seeds that a filter of fixed size lets pass; joined with the
    items' rarest seeds they name pairs, whose texts are then compared, pair by pair.
    Equal texts are one, by their 64-bit hash.
    """
    spark = rows.sparkSession
    items = durable(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("item_text")).withColumn("item_key", F.xxhash64("item_text")))
    one = items.dropDuplicates(["item_key"]).select("item_key", "item_text")

    def seeds_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, n) for b in batches for at, n in W.portions(b.column(1))):
            w = _split(batch.column(1))
            at, h = W.windows(w.hashes()[0], w.doc, seed)
            row = pa.array(w.doc[at])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array(h.view(np.int64)), pa.array(w.counts()[w.doc[at]])], ["item_key", "hash", "words"])

    seeds = durable(one.mapInArrow(tidied(seeds_of), "item_key long, hash long, words long"))
    often = seeds.groupBy("hash").agg(F.count("*").alias("n"))
    order = Window.partitionBy("item_key").orderBy("n", "hash")
    ranked = seeds.join(often, "hash").select("item_key", "hash", "words", F.row_number().over(order).alias("rank"), F.count("*").over(Window.partitionBy("item_key")).alias("size"))
    needed = F.greatest(F.lit(1), F.ceil(F.ceil(coverage * F.col("words") - 1e-9) / seed - 1e-9))
    rare = durable(ranked.where(F.col("rank") <= F.col("size") - needed + 1).select("hash", "item_key").distinct())

    bits = rare.select(F.shiftrightunsigned("hash", 64 - _FAR_BITS).alias("bit"))
    pages = bits.groupBy(F.shiftright("bit", 15).alias("page")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(F.lit(32767))).alias("bits")).toArrow()
    maybe = np.zeros((1 << (_FAR_BITS - 15), 4096), dtype=np.uint8)  # 32 MB, whatever the benchmark
    for page, raw in zip(pages.column("page").to_pylist(), pages.column("bits").to_pylist(), strict=True):
        maybe[page] = np.frombuffer(raw, dtype=np.uint8)
    told = spark.sparkContext.broadcast(maybe.ravel())

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = told.value
        for batch in (b.slice(at, n) for b in batches for at, n in W.portions(b.column(1))):
            w = _split(batch.column(1))
            at, h = W.windows(w.hashes()[0], w.doc, seed)
            bit = (h >> U64(64 - _FAR_BITS)).astype(np.int64)
            hit = np.flatnonzero(table[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(w.doc[at[hit]])), pa.array(h[hit].view(np.int64))], ["text_key", "hash"])

    texts = rows.select(F.xxhash64("text").alias("text_key"), "text")
    passed = texts.mapInArrow(tidied(passing), "text_key long, hash long").distinct()
    pairs = durable(passed.join(rare, "hash").select("text_key", "item_key").distinct())
    named = pairs.select("text_key").distinct()
    some = texts.join(F.broadcast(named), "text_key", "left_semi") if small(named, 16) else parted(texts, named, F.col("text_key"))[1].join(named, "text_key", "left_semi")
    both = pairs.join(some.dropDuplicates(["text_key"]), "text_key").join(one, "item_key").select("text_key", "item_key", "text", "item_text")

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1) for b in batches for k in range(b.num_rows)):
            got = Seeds([batch.column(1)[0].as_py()], batch.column(3), seed, coverage)
            yield _match(batch.column(0), batch.column(2), got, coverage)

    found = both.mapInArrow(tidied(compared), SCHEMA).select(F.col("doc_id").alias("text_key"), F.col("item_id").alias("item_key"), "coverage", "tiles")
    return found.join(items.select("item_id", "item_key"), "item_key").select("text_key", "item_id", "coverage", "tiles")


def _match(ids: pa.Array, texts: pa.Array, seeds: Seeds, coverage: float) -> pa.RecordBatch:
    out = [row for at, n in W.portions(texts) for row in _rows(ids.slice(at, n), texts.slice(at, n), seeds, coverage)]
    columns = list(zip(*out, strict=True)) or [()] * 4
    structs = [[{"doc_word": a, "item_word": b, "words": n} for a, b, n in x] for x in columns[3]]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64()), pa.array(structs, _TILES)], ["doc_id", "item_id", "coverage", "tiles"])


def _rows(ids: pa.Array, texts: pa.Array, seeds: Seeds, coverage: float) -> list[tuple]:
    out: list[tuple] = []
    w = _split(texts)
    if not len(w.starts) or not len(seeds.hash):
        return out
    at, h = W.windows(w.hashes()[0], w.doc, seeds.seed)
    i, item = seeds.hits(h)
    bounds = np.searchsorted(w.doc[at], np.arange(w.n_docs + 1))
    for code in np.unique(w.doc[at[i]].astype(np.int64) * len(seeds.ids) + item).tolist():
        d, k = divmod(code, len(seeds.ids))
        found = covered(h[bounds[d] : bounds[d + 1]], seeds.all[seeds.bounds[k] : seeds.bounds[k + 1]], int(seeds.words[k]), seeds.seed, coverage)
        if found:
            out.append((ids[d].as_py(), seeds.ids[k], *found))
    return out
