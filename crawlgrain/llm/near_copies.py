"""Near copies by wide SimHash fingerprints, verified by the similarity of word shingles.

A document's fingerprint has 128 bits over its distinct shingles. Tables of a few
sampled bits each deal fingerprints into buckets, in which the Gray-order index finds
near ones. These join documents into loose groups; inside a group the sets of shingles
are compared. In the order of ids a document goes if it is similar enough to one that
stays: so every document that goes has a near copy that stays, and clean ones are left
alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgrain.llm import words as W
from crawlgrain.llm.cluster import durable, give_back, parted, parts, small, tidied, whole_groups
from crawlgrain.llm.components import connected_components
from crawlgrain.llm.simhash import _roots, gray_order, near_pairs

U64 = np.uint64
BITS = 128


@dataclass(frozen=True)
class NearCopies:
    """Parameters. similarity: Jaccard of the sets of `shingle`-word runs from which documents are near copies.

    miss: the share of pairs at just that similarity that may share no table; bucket:
    fingerprints of unrelated documents that a bucket holds on average; largest: what a
    bucket holds at most before it is dealt again; chunk_bytes: shingles of a group
    compared in one task; results don't depend on it.
    """

    shingle: int = 5
    similarity: float = 0.8
    miss: float = 0.02
    bucket: int = 1024
    largest: int = 50_000
    chunk_bytes: int = 8 << 20

    @property
    def differ(self) -> float:
        """The expected share of differing bits at the similarity."""
        return math.acos(2 * self.similarity / (1 + self.similarity)) / math.pi

    @property
    def distance(self) -> int:
        """Bits that a pair at the similarity differs in at most, but for one in a hundred or so."""
        p = self.differ
        return math.ceil(BITS * p + 2.5 * math.sqrt(BITS * p * (1 - p)))

    def tables(self, n: int) -> np.ndarray:
        """The sampled bits, a row for each table: more bits, and so more tables, for more fingerprints."""
        k = max(4, math.ceil(math.log2(max(1, n) / self.bucket)))
        count = math.ceil(math.log(self.miss) / math.log(1 - (1 - self.differ) ** k))
        rng = np.random.default_rng(7)
        return np.stack([rng.choice(BITS, k, replace=False) for _ in range(count)])


def shingle_sets(texts: pa.Array, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds): the distinct shingles of every text in a row, sorted; A-Z count as a-z.

    A text of fewer words has its whole sequence as its shingle; one without words, none.
    """
    w = W.split(pc.ascii_lower(texts))
    hw = w.hashes(8)[0]
    at, h = W.windows(hw, w.doc, shingle, seed=9)
    count = w.counts()
    few = np.flatnonzero((count > 0) & (count < shingle))
    p, begin = W.poly(10), np.searchsorted(w.doc, np.arange(w.n_docs))
    whole = p.ranges(p.prefix(hw), begin[few], begin[few] + count[few])
    doc, h = np.concatenate([w.doc[at], few]), np.concatenate([h, whole])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])]) if len(h) else np.zeros(0, dtype=bool)
    return h[new], np.searchsorted(doc[new], np.arange(w.n_docs + 1))


def fingerprints(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """(n, 2) words: bit by bit, whether over half of a text's shingles have it set."""
    wide = np.stack([W.mix(h.copy()), W.mix(h ^ U64(0x9E3779B97F4A7C15))], axis=1)
    ones = np.zeros((len(bounds) - 1, BITS), dtype=np.int64)
    for k, (a, b) in enumerate(zip(bounds.tolist(), bounds[1:].tolist(), strict=False)):
        for lo in range(a, b, 8192):
            part = wide[lo : min(lo + 8192, b)].view(np.uint8).reshape(-1, BITS // 8)
            ones[k] += np.add.reduce(np.unpackbits(part, axis=1, bitorder="little"), axis=0, dtype=np.uint16)
    most = ones * 2 > (bounds[1:] - bounds[:-1])[:, None]
    return np.packbits(most, axis=1, bitorder="little").view(U64)


def _marks(batches: Iterator[pa.RecordBatch], p: NearCopies) -> Iterator[pa.RecordBatch]:
    """Of each text: the fingerprint, a hash of the set of its shingles, and their number."""
    for batch in batches:
        for at, n in W.portions(batch.column(1)):
            h, bounds = shingle_sets(batch.column(1).slice(at, n), p.shingle)
            f = fingerprints(h, bounds).view(np.int64)
            sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(W.mix(h ^ U64(0x5851F42D4C957F2D)), dtype=U64)])
            key = (sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(key), pa.array(np.diff(bounds))], ["doc_id", "f1", "f2", "key", "n"])


def _dealt(rows: DataFrame, tables: np.ndarray, prefix: bool = False) -> DataFrame:
    """A row for each table: bucket, node and fingerprint. With prefix, inside the buckets that rows are in already."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = np.stack([batch.column(c).to_numpy() for c in ("f1", "f2")], axis=1).view(U64)
            old = batch.column("bucket").to_numpy().view(U64) if prefix else np.zeros(len(f), dtype=U64)
            for t, bits in enumerate(tables):
                value = np.zeros(len(f), dtype=U64)
                for bit in bits.tolist():
                    value = value << U64(1) | (f[:, bit // 64] >> U64(bit % 64) & U64(1))
                bucket = W.mix(W.mix(value + U64(t << 48)) ^ old)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), *(batch.column(c) for c in ("node", "f1", "f2"))], ["bucket", "node", "f1", "f2"])

    return rows.mapInArrow(tidied(task), "bucket long, node long, f1 long, f2 long")


def _swept(f: np.ndarray, distance: int, least: int = 2048) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """(root of each row, rows left, links): hot groups go at once, each with one pass over the rows.

    Leaders are spread over the rows; a leader takes what is near it if that is at least
    a 64th of the rows, and is linked with each row left that is near any of these.
    Under `least` rows nothing is swept.
    """
    root, left, links = np.arange(len(f)), np.arange(len(f)), []
    for turn in range(64):
        if len(left) < least:
            break
        leader = left[(turn * 2654435761) % len(left)]
        far = np.bitwise_count(f[left] ^ f[leader]).sum(axis=1, dtype=np.int64)
        near = far <= distance
        if near.sum() * 64 >= len(left):
            root[left[near]] = leader
            hit = _reached(f, left[near], far[near], left[~near], far[~near], distance)
            links.append((np.full(len(hit), leader), hit))
            left = left[~near | (left == leader)]
    return root, left, links


def _reached(f: np.ndarray, group: np.ndarray, r: np.ndarray, others: np.ndarray, far: np.ndarray, distance: int, pairs: int = 1 << 18) -> np.ndarray:
    """Those of `others` that are near a row of the group; r, far: how far all these are from the group's leader, which tells most apart."""
    order = np.argsort(r)
    group, r = group[order], r[order]
    some = np.flatnonzero(far <= distance + r[-1])
    some = some[np.argsort(-far[some], kind="stable")]
    out, at = [others[:0]], 0
    while at < len(some):
        n = max(1, pairs // len(group))
        part = some[at : at + n]
        mates = group[np.searchsorted(r, far[part[-1]] - distance) :]
        hit = np.zeros(len(part), dtype=bool)
        for lo in range(0, len(mates), pairs):
            x = f[others[part]][:, None, :] ^ f[mates[lo : lo + pairs]][None, :, :]
            hit |= (np.bitwise_count(x).sum(axis=2, dtype=np.int16) <= distance).any(axis=1)
        out.append(others[part[hit]])
        at += n
    return np.concatenate(out)


def _loose(distinct: DataFrame, p: NearCopies) -> DataFrame:
    """Links (a, b) that join near fingerprints, from distinct ones (node, f1, f2).

    A bucket gives at most one link a row. One of over `largest` rows is first swept, in
    chunks, for groups of many near fingerprints, then what is left of it is dealt again
    by further bits.
    """
    spark, schema = distinct.sparkSession, "a long, b long, bucket long, node long, f1 long, f2 long"
    names = [x.split()[0] for x in schema.split(", ")]
    distance, least = p.distance, min(2048, p.largest // 4)

    def rows_of(t: pa.Table) -> tuple[np.ndarray, ...]:
        f = np.stack([t.column(c).to_numpy() for c in ("f1", "f2")], axis=1).view(U64)
        return t.column("work").to_numpy(), f, t.column("node").to_numpy()

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "work", 20_000):
            work, f, node = rows_of(t)
            order = gray_order(work, f)
            work, f, node = work[order], f[order], node[order]
            bounds = np.flatnonzero(np.concatenate([[True], work[1:] != work[:-1], [True]]))
            swept, stays, links = np.arange(len(f)), np.ones(len(f), dtype=bool), []
            for a, b in zip(bounds, bounds[1:], strict=False):
                if b - a >= least:
                    root, left, more = _swept(f[a:b], distance, least)
                    links += [(a + x, a + y) for x, y in more]
                    swept[a:b] = a + root
                    stays[a:b] = False
                    stays[a + left] = True
            rest = np.flatnonzero(stays)
            roots = np.arange(len(f))
            while (swept[swept] != swept).any():
                swept = swept[swept]
            known = ((np.searchsorted(rest, swept[x]), np.searchsorted(rest, swept[y])) for x, y in links)
            roots[rest] = rest[_roots(len(rest), chain(known, near_pairs(work[rest], f[rest], distance)))]
            to = roots[swept]
            hit = np.flatnonzero(to != np.arange(len(f)))
            yield pa.RecordBatch.from_arrays([pa.array(node[to[hit]]), pa.array(node[hit])], ["a", "b"])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = lambda n: pa.nulls(n, pa.int64())
        for t in whole_groups(batches, "work", 20_000):
            work, f, node = rows_of(t)
            bucket, words = t.column("bucket").to_numpy(), f.view(np.int64)
            bounds = np.flatnonzero(np.concatenate([[True], work[1:] != work[:-1], [True]]))
            for a, b in zip(bounds, bounds[1:], strict=False):
                root, left, links = _swept(f[a:b], distance, least)
                hit, left = a + np.flatnonzero(root != np.arange(b - a)), a + left
                for x, y in links:
                    yield pa.RecordBatch.from_arrays([pa.array(node[a + x]), pa.array(node[a + y]), *[none(len(x))] * 4], names)
                yield pa.RecordBatch.from_arrays([pa.array(node[a + root[hit - a]]), pa.array(node[hit]), *[none(len(hit))] * 4], names)
                yield pa.RecordBatch.from_arrays([none(len(left)), none(len(left)), *map(pa.array, (bucket[left], node[left], words[left, 0], words[left, 1]))], names)

    def sorted_by_work(rows: DataFrame) -> DataFrame:
        return rows.repartition(parts(spark), "work").sortWithinPartitions("work")

    dealt = durable(_dealt(distinct, p.tables(distinct.count())))
    found, further = None, 0
    while True:
        large = durable(dealt.groupBy("bucket").count().where(F.col("count") > p.largest))
        last = large.isEmpty()
        fitting = dealt if last else dealt.join(large, "bucket", "left_anti")
        part = sorted_by_work(fitting.withColumn("work", F.col("bucket"))).mapInArrow(tidied(within), "a long, b long")
        found = part if found is None else found.unionByName(part)
        if last:
            return found
        hot = dealt.join(large, "bucket").withColumn("work", F.xxhash64("bucket", F.pmod(F.xxhash64("node"), F.ceil(F.col("count") / p.largest))))
        got = durable(sorted_by_work(hot).mapInArrow(tidied(sweep), schema))
        found = found.unionByName(got.where("a is not null").select("a", "b"))
        # six choices of four bits: a pair at the similarity misses them all once in a hundred times
        rng = np.random.default_rng(100 + further)
        dealt = durable(_dealt(got.where("a is null").select("bucket", "node", "f1", "f2"), np.stack([rng.choice(BITS, 4, replace=False) for _ in range(6)]), prefix=True))
        further += 1


def _leaders(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set, in order, whether none of those that stay before it is similar enough.

    Sets that are share one of their first hashes (all but so many that the others
    alone could not suffice); only such sets are compared whole.
    """
    stays, index = np.ones(len(sets), dtype=bool), {}
    for k, s in enumerate(sets):
        first = s[: len(s) - math.ceil(similarity * len(s) - 1e-9) + 1].tolist()
        seen = set()
        for x in first:
            for j in index.get(x, ()):
                if j not in seen and stays[k]:
                    seen.add(j)
                    stays[k] = not alike(sets[j], s, similarity)
        if stays[k]:
            for x in first:
                index.setdefault(x, []).append(k)
    return stays


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether the Jaccard similarity of two sorted sets reaches the limit."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = np.sort(np.concatenate([a, b]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared >= similarity * (len(both) - shared) - 1e-9


def _by_id(docs: DataFrame, ids: DataFrame, id_column: str) -> DataFrame:
    """Rows of docs (with the columns of ids) whose id is in ids (node, ...): few by broadcast, else behind a filter."""
    on = docs[id_column].cast("long") == ids["node"]
    if small(ids, 64):
        return docs.join(F.broadcast(ids), on)
    _, some = parted(docs, ids.select("node"), docs[id_column].cast("long"))
    return some.join(ids, some[id_column].cast("long") == ids["node"])


def gone(docs: DataFrame, p: NearCopies = NearCopies(), id_column: str = "doc_id", text_column: str = "text") -> tuple[DataFrame, DataFrame]:
    """((node) ids of documents that go, (node) ids that several rows have).

    Rows of one id are one document, that of the least fingerprint. Texts without words
    are copies of each other; rows of a null id aren't compared.
    """
    rows = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].cast("string").alias("text"))
    marked = durable(rows.where("doc_id is not null").mapInArrow(tidied(lambda batches: _marks(batches, p)), "doc_id long, f1 long, f2 long, key long, n long"))
    mark = F.struct("f1", "f2", "key", "n")
    one = durable(marked.groupBy("doc_id").agg(F.min(mark).alias("m"), F.count("*").alias("rows")).select("doc_id", "m.*", "rows"))
    nodes = durable(one.groupBy("f1", "f2", "key", "n").agg(F.min("doc_id").alias("node")))
    distinct = durable(nodes.groupBy("f1", "f2").agg(F.min("node").alias("node")))
    same = nodes.join(distinct.withColumnRenamed("node", "a"), ["f1", "f2"]).select("a", F.col("node").alias("b"))
    groups = connected_components(_loose(distinct.select("node", "f1", "f2"), p).unionByName(same))
    members = nodes.select("node", "key", "n").join(groups, "node")
    cuts = members.groupBy("component").agg(F.ceil(F.sum(F.col("n") + 8) * 8 / p.chunk_bytes).alias("cuts"))
    members = durable(members.join(cuts, "component"))
    lost = one.join(nodes, ["f1", "f2", "key", "n"]).where("doc_id <> node").select(F.col("doc_id").alias("node"))
    return lost.unionByName(_verified(rows, members, p)), one.where("rows > 1").select(F.col("doc_id").alias("node"))


def _verified(rows: DataFrame, members: DataFrame, p: NearCopies) -> DataFrame:
    """(node) of the members of loose groups that go: members (component, node, key, n, cuts)."""
    shingled = "component long, node long, cuts long, shingles array<long>"

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in W.portions(batch.column("text")):
                b = batch.slice(at, n)
                h, bounds = shingle_sets(b.column("text"), p.shingle)
                arrays = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64)))
                sums = np.concatenate([np.zeros(1, dtype=U64), np.cumsum(W.mix(h ^ U64(0x5851F42D4C957F2D)), dtype=U64)])
                fits = pa.array((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64) == b.column("key").to_numpy())
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("component", "node", "cuts")), arrays], ["component", "node", "cuts", "shingles"]).filter(fits)

    def picked(some: DataFrame) -> DataFrame:
        return _by_id(rows, some, "doc_id").select("component", "node", "cuts", "key", "text").mapInArrow(tidied(sets), shingled)

    def whole(t: pa.Table) -> pa.Table:
        return _judged(t, p).filter(pc.field("stays") == False).select(["node"])  # noqa: E712

    few = picked(members.where("cuts <= 1")).groupBy("component").applyInArrow(lambda t: whole(t), "node long")
    if members.where("cuts > 1").isEmpty():
        return few
    return few.unionByName(_in_order(picked(members.where("cuts > 1")).select("component", "node", "shingles"), p))


def _unpacked(t: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    t = t.sort_by("node")
    flat = t.column("shingles").combine_chunks()
    bounds, values = flat.offsets.to_numpy(), flat.values.to_numpy().view(U64)
    return t.column("node").to_numpy(), [values[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def _judged(t: pa.Table, p: NearCopies) -> pa.Table:
    """The rows of a group with `stays`."""
    node, sets = _unpacked(t)
    stays = dict(zip(node.tolist(), _leaders(sets, p.similarity).tolist(), strict=True))
    if t.nbytes > 1 << 20:
        give_back()
    return t.select(["component", "node", "shingles"]).append_column("stays", pa.array([stays[x] for x in t.column("node").to_pylist()], pa.bool_()))


def _against(t: pa.Table, p: NearCopies) -> pa.Table:
    """The rows that don't lead, with `stays`: whether none that leads is similar enough. Of those that go, without shingles."""
    lead = t.column("lead").combine_chunks()
    (_, leaders), others = _unpacked(t.filter(lead)), t.filter(pc.invert(lead)).sort_by("node")
    first = lambda s: s[: len(s) - math.ceil(p.similarity * len(s) - 1e-9) + 1].tolist()
    index: dict[int, list[int]] = {}
    for k, s in enumerate(leaders):
        for x in first(s):
            index.setdefault(x, []).append(k)
    stays = pa.array([not any(alike(leaders[j], s, p.similarity) for j in {j for x in first(s) for j in index.get(x, ())}) for s in _unpacked(others)[1]], pa.bool_())
    if t.nbytes > 1 << 20:
        give_back()
    shingles = others.column("shingles").combine_chunks()
    return others.select(["component", "node"]).append_column("shingles", pc.if_else(stays, shingles, pa.scalar(None, shingles.type))).append_column("stays", stays)


def _in_order(rows: DataFrame, p: NearCopies) -> DataFrame:
    """(node) of the members that go of groups larger than a chunk: rows (component, node, shingles).

    Turn by turn, the members of the smallest ids that make about a chunk are judged in
    one task, then all others against those of them that stay, in as many tasks as there
    are chunks. So each is judged as in a group of one chunk: by what stays before it.
    """
    schema = "component long, node long, shingles array<long>, stays boolean"
    shares = [0.5**k for k in range(21)]
    rest, lost = durable(rows), None
    while True:
        size = F.sum((F.size("shingles") + 8).cast("long") * 8)
        told = rest.groupBy("component").agg(F.ceil(size / p.chunk_bytes).alias("cuts"), F.percentile_approx("node", shares).alias("ids"))
        upto = F.element_at("ids", F.least(F.ceil(F.log2("cuts")), F.lit(20)).cast("int") + 1)
        told = durable(told.select("component", "cuts", upto.alias("upto")))
        placed = rest.join(told, "component")
        first = durable(placed.where("node <= upto").groupBy("component").applyInArrow(lambda t: _judged(t, p), schema))
        gone_now = first.where("not stays").select("node")
        lost = gone_now if lost is None else lost.unionByName(gone_now)
        if told.where("cuts > 1").isEmpty():
            return lost
        blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1))
        leaders = first.where("stays").join(told, "component").select("component", "node", "shingles", F.lit(True).alias("lead"), blocks.alias("block"))
        later = placed.where("node > upto").select("component", "node", "shingles", F.lit(False).alias("lead"), F.pmod(F.xxhash64("node"), F.col("cuts")).alias("block"))
        judged = durable(leaders.unionByName(later).groupBy("component", "block").applyInArrow(lambda t: _against(t, p), schema))
        lost = lost.unionByName(judged.where("not stays").select("node"))
        rest = judged.where("stays").select("component", "node", "shingles")


def one_of_each(docs: DataFrame, p: NearCopies = NearCopies(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs without near copies, all columns as they are.

    In the order of ids, a document goes if its similarity to one that stays reaches
    p.similarity, however large its group. Rows of a null id stay; where an id is
    repeated, one of its rows stays; null and empty texts are copies of each other; an
    empty table gives no rows.
    """
    lost, repeated = (durable(x) for x in gone(docs, p, id_column, text_column))
    key = docs[id_column].cast("long")
    if small(lost, 32):
        out = docs.join(F.broadcast(lost), key == lost["node"], "left_anti")
    else:
        safe, some = parted(docs, lost, key)
        out = safe.unionByName(some.join(lost, some[id_column].cast("long") == lost["node"], "left_anti"))
    if repeated.isEmpty():
        return out
    again = repeated["node"] == out[id_column].cast("long")
    return out.join(repeated, again, "left_anti").unionByName(out.join(repeated, again, "left_semi").dropDuplicates([id_column]))
