"""Questions about all windows of a corpus, asked in compressed blocks.

Documents are dealt into groups of some megabytes by a hash of their id. A group
hashes its windows at once, keeps each distinct hash once, and sends one block of
sorted, delta-coded hashes to each bucket that it has any for. A bucket compares the blocks of
all groups and answers with one bit per hash. A hot window so costs one entry per
group, however many documents hold it, and buckets are even as hashes are.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgrain.llm.cluster import text_bytes

U64 = np.uint64
BLOCK = "bucket int, grp int, level int, n int, payload binary"
ANSWER = "grp int, level int, bucket int, bits binary"


@dataclass(frozen=True)
class Sizes:
    """How a corpus is cut: groups and buckets are of fixed size, so there are more of them for more bytes."""

    groups: int
    buckets: int
    bits: int  # of a hash that only picks candidates


#: Text of a group, and windows of a bucket.
GROUP_BYTES = 6 << 20
BUCKET_WINDOWS = 2_000_000


def sizes(docs: DataFrame, text_column: str) -> Sizes:
    """Groups and buckets for a corpus.

    Candidate hashes are long enough for one in some thousands to be a false candidate.
    """
    n = text_bytes(docs, text_column)
    words = max(1, n // 5)
    return Sizes(-(-n // GROUP_BYTES) or 1, -(-words // BUCKET_WINDOWS), min(64, words.bit_length() + 13))


def grouped(docs: DataFrame, cut: Sizes, id_column: str, text_column: str) -> DataFrame:
    """(grp, doc_id, text)."""
    doc_id = docs[id_column].cast("long")
    return docs.select(F.pmod(F.xxhash64(doc_id, F.lit("group")), F.lit(cut.groups)).cast("int").alias("grp"), doc_id.alias("doc_id"), docs[text_column].cast("string").alias("text"))


def planes(values: np.ndarray) -> bytes:
    """Byte planes: those that hold zeros alone vanish in the shuffle's compression."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def unplanes(raw: memoryview, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8, count=n * size).reshape(size, n).T).view(kind).ravel()


def deltas(sorted_values: np.ndarray) -> np.ndarray:
    out = sorted_values.copy()
    out[1:] -= sorted_values[:-1]
    return out


def bucket_of(values: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """The bucket of each value below 2 ** bits: equal ranges, told by the first 32 bits."""
    top = values >> U64(bits - 32) if bits > 32 else values << U64(32 - bits)
    return (top * U64(buckets) >> U64(32)).astype(np.int64)


def ranges(values: np.ndarray, buckets: int, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of sorted values, for the buckets that have any."""
    of = bucket_of(values, buckets, bits)
    cuts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1], [True]])).tolist() if len(of) else [0]
    return [(int(of[a]), a, b) for a, b in zip(cuts, cuts[1:], strict=False)]


def blocks(grp: int, level: int, values: np.ndarray, buckets: int, bits: int, extra: tuple[np.ndarray, ...] = ()) -> list[tuple]:
    """Rows of BLOCK for sorted distinct values; `extra` arrays go along, entry by entry."""
    return [(k, grp, level, b - a, b"".join([planes(deltas(values[a:b])), *(planes(x[a:b]) for x in extra)])) for k, a, b in ranges(values, buckets, bits)]


def block_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * 5
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "grp", "level", "n", "payload"])


def answer_table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["grp", "level", "bucket", "bits"])


def read_blocks(table: pa.Table, *kinds: type) -> tuple[list[tuple[int, int]], list[list[np.ndarray]]]:
    """((grp, n) of each block, its arrays): the values first, then the extra ones."""
    heads, arrays = [], []
    for grp, n, payload in zip(table.column("grp").to_pylist(), table.column("n").to_pylist(), table.column("payload"), strict=True):
        raw, at, got = memoryview(payload.as_buffer()), 0, []
        for kind in (U64, *kinds):
            size = n * np.dtype(kind).itemsize
            got.append(unplanes(raw[at : at + size], n, kind))
            at += size
        got[0] = np.cumsum(got[0], dtype=U64)
        heads.append((grp, n))
        arrays.append(got)
    return heads, arrays


def answers(heads: list[tuple[int, int]], yes: np.ndarray, level: int, bucket: int) -> list[tuple]:
    """Rows of ANSWER from one boolean per entry of all blocks in a row; blocks without a yes are left out."""
    out, at = [], 0
    for grp, n in heads:
        bits = yes[at : at + n]
        if bits.any():
            out.append((grp, level, bucket, np.packbits(bits).tobytes()))
        at += n
    return out


def read_answers(table: pa.Table, level: int, values: np.ndarray, buckets: int, bits: int) -> np.ndarray:
    """The boolean of each of a group's sorted distinct values."""
    out = np.zeros(len(values), dtype=bool)
    place = {k: (a, b) for k, a, b in ranges(values, buckets, bits)}
    for lev, k, raw in zip(table.column("level").to_pylist(), table.column("bucket").to_pylist(), table.column("bits"), strict=True):
        if lev == level:
            a, b = place[k]
            out[a:b] = np.unpackbits(np.frombuffer(raw.as_buffer(), dtype=np.uint8), count=b - a)
    return out
