"""SimHash fingerprints and a Gray-order hierarchical index that finds near ones.

Distinct fingerprints are dealt out by bands: of five bands, two fingerprints that
differ in at most four bits share one. Inside a band's bucket they are sorted by Gray
rank; runs of neighbours become nodes that keep the bits all of them share (mask and
pattern), and nodes in turn are grouped. A search adds up the differences against a
node's shared bits and drops the whole group once there are too many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crawlgrain.llm.cluster import durable, tidied, whole_groups
from crawlgrain.llm.components import connected_components

U64 = np.uint64
BITS = 64
_FANOUT = 8
_BUCKET = 20_000
#: How often a large bucket is dealt out again before it is compared block by block.
_TURNS = 3
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """SimHash of the word shingles, repeats included; ASCII capitals are lower-cased."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= shingle:
        h = np.array([xxhash.xxh64_intdigest(line, 42)], dtype=U64)
    else:
        ends = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32).tolist()
        ends.append(len(line))
        starts = [0, *(e + 1 for e in ends)]
        digest = xxhash.xxh64_intdigest
        h = np.fromiter((digest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])), dtype=U64, count=len(words) - shingle + 1)  # noqa: B905
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(h), 8192):
        part = h[at : at + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(((ones * 2 > len(h)).astype(U64) << np.arange(BITS, dtype=U64)).sum(dtype=U64))


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shingle: int = 4) -> DataFrame:
    """(doc_id, fingerprint as a signed long): null and empty texts have zero."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            f = np.fromiter((fingerprint(t.as_py(), shingle) for t in texts), dtype=U64, count=len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text")).mapInArrow(tidied(task), "doc_id long, fingerprint long")


def gray_rank(f: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the reflected Gray order."""
    f = f.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        f ^= f >> U64(shift)
    return f


def gray_order(bucket: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The order by bucket, then by the Gray ranks of the fingerprints' words."""
    return np.lexsort((*(gray_rank(f[:, k]) for k in range(f.shape[1] - 1, -1, -1)), bucket))


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).sum(axis=1, dtype=np.int64) if x.shape[1] > 1 else np.bitwise_count(x[:, 0])


def near_pairs(bucket: np.ndarray, f: np.ndarray, distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of one bucket with at most `distance` differing bits.

    f has a row of 64-bit words for each fingerprint; both are in gray_order().
    """
    levels = []  # from the leaves: (mask, pattern, first child, child count) of nodes inside one bucket
    group, mask, pattern = bucket, np.full(f.shape, ~U64(0)), f
    while True:
        start = np.concatenate([[True], group[1:] != group[:-1]])
        heads = np.flatnonzero(start)
        rank = np.arange(len(group)) - heads[np.cumsum(start) - 1]
        first = np.flatnonzero(rank % _FANOUT == 0)
        size = np.diff(np.append(first, len(group)))
        ones, zeros = np.bitwise_and.reduceat(pattern & mask, first, axis=0), np.bitwise_and.reduceat(~pattern & mask, first, axis=0)
        group, mask, pattern = group[first], ones | zeros, ones
        levels.append((mask, pattern, first, size))
        if len(np.unique(group)) == len(group):
            break
    top = group
    low = np.searchsorted(top, bucket)  # the root of each fingerprint's bucket
    weight = np.searchsorted(bucket, top, "right") - np.searchsorted(bucket, top)
    chunk = max(1, 2_000_000 // (f.shape[1] * max(1, int(weight.max()))))
    for at in range(0, len(f), chunk):
        q = np.arange(at, min(at + chunk, len(f)))
        node = low[q]
        for mask, pattern, first, size in reversed(levels):
            keep = _bits((f[q] ^ pattern[node]) & mask[node]) <= distance
            q, node = q[keep], node[keep]
            n = size[node]
            q = np.repeat(q, n)
            node = np.repeat(first[node] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        keep = q < node
        q, node = q[keep], node[keep]
        keep = _bits(f[q] ^ f[node]) <= distance
        yield q[keep], node[keep]


def _roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Smallest index linked with each of n indexes."""
    root = np.arange(n)
    for i, j in pairs:
        while True:
            a, b = root[i], root[j]
            differ = a != b
            if not differ.any():
                break
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (root[root] != root).any():
                root = root[root]
    return root


def _band(value: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(value, low).bitwiseAND(F.lit((1 << bits) - 1))


def _bands(rows: DataFrame, first: int, distance: int, trail: str) -> DataFrame:
    """A row for each of distance + 1 bands of the bits from `first` up."""
    n = distance + 1
    cuts = [first + (BITS - first) * k // n for k in range(n + 1)]
    keys = [F.concat(F.col(trail), F.lit(f"{k}:"), F.hex(_band(F.col("fingerprint"), lo, hi - lo)), F.lit("/")) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False))]
    return rows.select("node", "fingerprint", F.explode(F.array(*keys)).alias("bucket"))


def links(distinct: DataFrame, distance: int = 4, bucket_rows: int = _BUCKET) -> DataFrame:
    """Links (a, b) between nodes that join all fingerprints at `distance` or nearer.

    distinct: (node, fingerprint), each fingerprint once. A bucket gives at most one
    link per row, towards the smallest of its group, so nothing grows with the square
    of a group. A bucket of over bucket_rows distinct fingerprints is dealt out again
    by bands of all bits of a rotated copy, which is exact too, until buckets fit.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "bucket", 100_000):
            bucket = t.column("bucket").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            f, node = t.column("fingerprint").to_numpy().view(U64), t.column("node").to_numpy()
            order = gray_order(bucket, f[:, None])
            bucket, f, node = bucket[order], f[order, None], node[order]
            root = _roots(len(f), near_pairs(bucket, f, distance))
            linked = np.flatnonzero(root != np.arange(len(root)))
            yield pa.RecordBatch.from_arrays([pa.array(node[root[linked]]), pa.array(node[linked])], ["a", "b"])

    found, rows, turn = None, distinct.withColumn("trail", F.lit("")), 0
    while True:
        dealt = _bands(rows, 0, distance, "trail")
        sizes = durable(dealt.groupBy("bucket").count().where(F.col("count") > bucket_rows))
        large = None if sizes.isEmpty() else sizes.select("bucket")
        small = dealt if large is None else dealt.join(large, "bucket", "left_anti")
        part = small.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(tidied(task), "a long, b long")
        found = part if found is None else found.unionByName(part)
        if large is None:
            return found
        if turn == _TURNS:
            return found.unionByName(_in_blocks(dealt, sizes, distance, bucket_rows))
        turn += 1
        # every bit moves to another band: bit i goes to 13 i modulo 64, and so on with each turn
        moved = [F.shiftleft(_band(F.col("fingerprint"), i, 1), 13 * i % BITS) for i in range(BITS)]
        value = moved[0]
        for x in moved[1:]:
            value = value.bitwiseOR(x)
        rows = durable(dealt.join(large, "bucket", "left_semi").select("node", value.alias("fingerprint"), F.col("bucket").alias("trail")))


def _in_blocks(dealt: DataFrame, sizes: DataFrame, distance: int, bucket_rows: int) -> DataFrame:
    """Links inside buckets that bands can't cut further: blocks of bounded size, each two of them compared in a task."""
    rows = dealt.join(sizes.select("bucket", F.ceil(F.col("count") / bucket_rows).alias("blocks")), "bucket").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    tasks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("lo"), F.greatest("block", j).alias("hi")))
    rows = rows.select("node", "fingerprint", F.explode(tasks).alias("task"), "bucket")

    def pair(t: pa.Table) -> pa.Table:
        f, node = t.column("fingerprint").to_numpy().view(U64)[:, None], t.column("node").to_numpy()
        order = gray_order(np.zeros(len(f), dtype=np.int64), f)
        f, node = f[order], node[order]
        root = _roots(len(f), near_pairs(np.zeros(len(f), dtype=np.int64), f, distance))
        linked = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array(node[root[linked]], pa.int64()), "b": pa.array(node[linked], pa.int64())})

    return rows.groupBy("bucket", "task").applyInArrow(lambda t: pair(t), "a long, b long")


def near_duplicates(docs: DataFrame, distance: int = 4, shingle: int = 4, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, fingerprint long, component_id): component_id is the smallest doc_id that links reach.

    Texts with equal fingerprints, those without words included, are one node; only
    distinct fingerprints are compared. Rows with a null id get a fingerprint and no
    component; repeated rows stay; an empty table gives no rows; other columns are
    ignored.
    """
    marked = durable(fingerprints(docs, id_column, text_column, shingle))
    distinct = durable(marked.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("node")))
    component = connected_components(links(distinct.select("node", "fingerprint"), distance))
    known = distinct.join(component, "node", "left").select("fingerprint", F.coalesce("component", "node").alias("component_id"))
    out = marked.join(known, "fingerprint", "left")
    return out.select("doc_id", "fingerprint", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
