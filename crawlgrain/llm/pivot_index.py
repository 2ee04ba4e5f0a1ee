"""Near-duplicate vectors by a pivot-permutation index.

Pivots are a bounded sample of the vectors. A vector is described by the permutation of
its nearest pivots, in the order of their distance. Inverted lists are kept for pairs of
the foremost of these: there are enough of them to stay short as the table grows. In a
list, two vectors are retrieved if they share enough pivots at places of their
permutations that are not far apart, and are then verified by their cosine. A pair is
counted in the first of the lists that both are in. Lists of any length are compared
whole: a long one is cut into blocks, and each pair of blocks is a task's work.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgrain.llm.cluster import durable, parts, tidied, whole_groups
from crawlgrain.llm.components import connected_components


@dataclass(frozen=True)
class PivotIndex:
    """Parameters. Pivots are chosen from 8 vectors each, the smallest hashes of their ids, with cosines below `apart`.

    There are `pivots` of them, or the square root of the number of vectors if that is
    more, up to most_pivots. `nearest` of them describe a vector (one more for each
    fourfold of `pivots`), the first `listed` name its lists. Two vectors are retrieved
    if they share `shared` pivots at places at most `places` apart. block is the longest
    list compared at once.
    """

    pivots: int = 256
    most_pivots: int = 8192
    apart: float = 0.6
    nearest: int = 8
    listed: int = 6
    shared: int = 3
    places: int = 5
    threshold: float = 0.95
    block: int = 1500

    def sized(self, n: int) -> PivotIndex:
        """The parameters for n vectors."""
        pivots = max(self.pivots, min(self.most_pivots, math.isqrt(max(n, 1))))
        return replace(self, pivots=pivots, nearest=self.nearest + max(0, round(math.log(pivots / self.pivots, 4))))


def _unit(rows: pa.Array, size: int) -> np.ndarray:
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def valid(vector: str) -> F.Column:
    """Whether a vector has a direction: no null, no component that is null or not finite, not all zero."""
    v = F.col(vector)
    fine = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _spread(sample: np.ndarray, p: PivotIndex) -> np.ndarray:
    """Up to p.pivots vectors of the sample, none near another.

    Pivots inside one dense group would all be at about the same distance from its
    members, and their order mere noise.
    """
    chosen: list[int] = []
    for i in range(len(sample)):
        if len(chosen) == p.pivots:
            break
        if not chosen or (sample[chosen] @ sample[i]).max() < p.apart:
            chosen.append(i)
    return sample[chosen]


def _two(lists: np.ndarray, others: np.ndarray, n_pivots: int) -> np.ndarray:
    """Of each row pair of sorted pivot lists, the first two shared pivots as one key."""
    shared = (lists[:, :, None] == others[:, None, :]).any(axis=2)
    order = np.argsort(~shared, axis=1, kind="stable")[:, :2]
    two = np.take_along_axis(lists, order, axis=1)
    return two[:, 0] * n_pivots + two[:, 1]


def _incidence(lists: np.ndarray) -> np.ndarray:
    """A row for each permutation, with a one for each pivot in it: products of rows count shared pivots."""
    names, at = np.unique(lists, return_inverse=True)
    out = np.zeros((len(lists), len(names)), dtype=np.float32)
    out[np.arange(len(lists))[:, None], at.reshape(lists.shape)] = 1
    return out


def shared_near(a: np.ndarray, b: np.ndarray, places: int) -> np.ndarray:
    """How many pivots each row of a shares with that of b, at most `places` apart in the two permutations."""
    place = np.arange(a.shape[1])
    near = np.abs(place[:, None] - place[None, :]) <= places
    return ((a[:, :, None] == b[:, None, :]) & near).sum(axis=(1, 2))


def _compare(key: int, x: np.ndarray, lists: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, p: PivotIndex) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows left x right that belong to this list: retrieved by their permutations, verified by cosine."""
    out = []
    first, enough = min(left[0], right[0]), min(p.shared, lists.shape[1])
    pivots = None  # most lists are short and hold no pair that would be verified: these are passed over at once
    for at in range(0, len(left), 512):
        some = left[at : at + 512]
        near = x[some] @ x[right].T >= p.threshold
        if same:
            near &= some[:, None] < right[None, :]
        if not near.any():
            continue
        if pivots is None:
            pivots = _incidence(lists[first : max(left[-1], right[-1]) + 1])
        i, j = np.nonzero(near & (pivots[some - first] @ pivots[right - first].T >= enough))
        i, j = some[i], right[j]
        for a in range(0, len(i), 100_000):
            b, c = i[a : a + 100_000], j[a : a + 100_000]
            listed = (np.sort(lists[rows][:, : p.listed], axis=1) for rows in (b, c))
            own = (_two(*listed, p.pivots) == key) & (shared_near(lists[b], lists[c], p.places) >= enough)
            out.append((b[own], c[own]))
    return (np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])) if out else (left[:0], left[:0])


def links(vectors: DataFrame, p: PivotIndex = PivotIndex()) -> DataFrame:
    """(node, n_links, other) from distinct valid vectors (node, copies, embedding).

    Rows add up: n_links counts linked vectors, weighted by copies, and other, where
    not null, is a node linked with this one, directly or through others of its list;
    these links join whatever links join. No list gives more rows than it has members.
    """
    spark = vectors.sparkSession
    size = F.size("embedding")
    out = None
    for row in vectors.select(size.alias("d")).distinct().orderBy("d").collect():  # dimensions; usually one
        mine = vectors.where(size == row["d"])
        part = _links(mine, row["d"], p)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], "node long, n_links long, other long")


def _links(vectors: DataFrame, d: int, p: PivotIndex) -> DataFrame:
    p = p.sized(vectors.count())
    sample = vectors.orderBy(F.xxhash64("node"), "node").limit(8 * p.pivots).select("embedding").toArrow()
    pivots = _spread(_unit(sample.column(0).combine_chunks(), d), p)
    k = min(p.nearest, len(pivots))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(batch.column("embedding"), d)
            near = np.zeros((len(x), k), dtype=np.int32)
            for at in range(0, len(x), 2048):
                cosine = x[at : at + 2048] @ pivots.T
                some = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
                order = np.argsort(-np.take_along_axis(cosine, some, axis=1), axis=1, kind="stable")
                near[at : at + 2048] = np.take_along_axis(some, order, axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("copies"), batch.column("embedding"), pa.array(list(near), pa.list_(pa.int32()))], ["node", "copies", "embedding", "near"])

    kind = vectors.schema["embedding"].dataType.simpleString()
    index = durable(vectors.select("node", "copies", "embedding").mapInArrow(tidied(describe), f"node long, copies long, embedding {kind}, near array<int>"))
    # every two of a vector's foremost pivots, and the first alone where there is only one pivot at all
    n = F.lit(p.pivots)
    listed = F.array_sort(F.slice("near", 1, p.listed))
    keys = F.flatten(F.transform(listed, lambda a, i: F.transform(F.slice(listed, i + 2, F.lit(p.listed)), lambda b: a * n + b))) if k > 1 else F.array(F.col("near")[0] * n)
    dealt = index.withColumn("key", F.explode(keys))
    cuts = dealt.groupBy("key").count().select("key", F.ceil(F.col("count") / p.block).alias("cuts"))
    # a row of block i meets block j in the task of (min, max): it goes to as many tasks as there are blocks
    block = F.pmod(F.xxhash64("node"), F.col("cuts"))
    tasks = F.transform(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1), lambda j: F.struct(F.least(block, j).alias("lo"), F.greatest(block, j).alias("hi")))
    dealt = dealt.join(cuts, "key").select("key", "node", "copies", "embedding", "near", block.alias("block"), F.explode(tasks).alias("task"))
    dealt = dealt.select((F.col("key").cast("long") * (1 << 40) + F.col("task.lo") * (1 << 20) + F.col("task.hi")).alias("work"), "node", "copies", "embedding", "near", (F.col("block") == F.col("task.lo")).alias("low"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "work", 4000):
            work, node, copies = (table.column(c).to_numpy() for c in ("work", "node", "copies"))
            low = table.column("low").to_numpy()
            x = _unit(table.column("embedding").combine_chunks(), d)
            lists = table.column("near").combine_chunks().flatten().to_numpy().reshape(-1, k).astype(np.int64)
            heads = np.flatnonzero(np.concatenate([[True], work[1:] != work[:-1]]))
            nodes, sums, others = [], [], []
            for a, b in zip(heads, [*heads[1:], len(work)], strict=True):
                code = int(work[a])
                key, same, rows = code >> 40, (code >> 20) & 0xFFFFF == code & 0xFFFFF, np.arange(a, b)
                left, right = (rows, rows) if same else (rows[low[a:b]], rows[~low[a:b]])
                if not len(left) or not len(right) or same and len(rows) < 2:
                    continue
                if k > 1:
                    i, j = _compare(key, x, lists, left, right, same, p)
                else:
                    i, j = np.nonzero(x[left] @ x[right].T >= p.threshold)
                    i, j = left[i], right[j]
                    i, j = (i[i < j], j[i < j]) if same else (i, j)
                if not len(i):
                    continue
                count = np.bincount(i - a, weights=copies[j], minlength=b - a) + np.bincount(j - a, weights=copies[i], minlength=b - a)
                root = _roots(b - a, i - a, j - a)
                hit = np.flatnonzero(count)
                nodes.append(node[a:b][hit])
                sums.append(count[hit].astype(np.int64))
                others.append(np.where(root[hit] == hit, -1, node[a:b][root[hit]]))
            if nodes:
                other, none = np.concatenate(others), np.concatenate([o == -1 for o in others])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sums)), pa.array(other, mask=none)], ["node", "n_links", "other"])

    return dealt.repartition(parts(vectors.sparkSession), "work").sortWithinPartitions("work").mapInArrow(tidied(verify), "node long, n_links long, other long")


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Of n rows, the first row that the pairs (i, j) join each with."""
    root = np.arange(n)
    while True:
        a, b = root[i], root[j]
        differ = a != b
        if not differ.any():
            return root
        np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while (root[root] != root).any():
            root = root[root]


def near_duplicates(embeddings: DataFrame, p: PivotIndex = PivotIndex(), id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing and are kept, as are vectors of different lengths with each other. Equal
    vectors are one node with a count; each counts the others as links. Repeated ids
    are rows of their own; a null id has null component and isn't kept; an empty table
    gives no rows; other columns are ignored.
    """
    given = embeddings.schema[vector_column].dataType.simpleString()
    kind = given if given in ("array<float>", "array<double>") else "array<double>"
    rows = embeddings.select(embeddings[id_column].cast("long").alias("vec_id"), embeddings[vector_column].cast(kind).alias("embedding"))
    rows = rows.withColumn("fine", valid("embedding"))
    rows = rows.withColumn("k1", F.when(F.col("fine"), F.xxhash64("embedding"))).withColumn("k2", F.when(F.col("fine"), F.hash("embedding")))
    nodes = durable(rows.where("fine and vec_id is not null").groupBy("k1", "k2").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies"), F.first("embedding").alias("embedding")))
    found = durable(links(nodes.select("node", "copies", "embedding"), p))
    counts = found.groupBy("node").agg(F.sum("n_links").alias("n"))
    component = connected_components(found.where("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    known = nodes.join(counts, "node", "left").join(component, "node", "left")
    known = known.select("k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    out = rows.select("vec_id", "k1", "k2").join(known, ["k1", "k2"], "left")
    alone = F.col("vec_id").isNotNull()
    return out.select("vec_id", F.when(alone, F.coalesce("n_links", F.lit(0))).otherwise(F.lit(0)).alias("n_links"), F.when(alone, F.coalesce("component_id", "vec_id")).alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))
