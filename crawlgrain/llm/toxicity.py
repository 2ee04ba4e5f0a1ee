"""Toxicity as severity grades: cumulative-link ordinal regression on sparse text features.

Features are hashed words and word beginnings. P(grade <= k) = logistic(theta_k - w x):
all thresholds share the weights w. Fitting takes a bounded sample of labelled
documents (`sample` of each class, the smallest hashes of doc_id); scoring reads every
word of every document in one pass, without a shuffle.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crawlgrain.llm import words as W
from crawlgrain.llm.cluster import durable, tidied

U64 = np.uint64
HASH_BITS = 20
PREFIXES = (4, 5, 6)
#: Labelled documents of each class that a fit reads at most.
SAMPLE = 4000
SCHEMA = "doc_id long, severity double, p_toxic double, grade int, toxic boolean"
#: Occurrences of toxic features up to which a toxic document is of grade 1, of grade 2; above: 3.
GRADE_CUTS = (2, 5)
#: A document is toxic if P(grade > 0) reaches this.
CUT = 0.4
#: Two labelled documents of a class are near copies if so many of their signatures agree.
_SIGNATURES, _AGREE = 8, 7
_RUN = 3
_SAMPLED = "doc_id long, toxic int, grade int, feats array<int>, counts array<int>, signs array<long>"


def _features(texts: pa.Array) -> tuple[W.Words, list[np.ndarray]]:
    """Words (lower-cased, without punctuation) and their feature ids: the word, then its beginnings (-1: none)."""
    w = W.split(pc.utf8_lower(texts), W.PUNCT)
    hashes = w.hashes(4, PREFIXES)
    ids = [(h >> U64(64 - HASH_BITS)).astype(np.int32) for h in hashes]
    for k, h in enumerate(hashes[1:], 1):
        ids[k][h == 0] = -1
    return w, ids


@dataclass(frozen=True)
class OrdinalModel:
    """Weights by feature id and thresholds in ascending order."""

    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, texts: pa.Array) -> np.ndarray:
        """w x of every text: the sum over its features of weight times 1 + log(count)."""
        parts = [self._scores(texts.slice(at, n)) for at, n in W.portions(texts)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _scores(self, texts: pa.Array) -> np.ndarray:
        w, ids = _features(texts)
        out = np.zeros(w.n_docs)
        docs, found = [], []
        for f in ids:
            hit = np.flatnonzero((f >= 0) & (self.weights[f] != 0))
            docs.append(w.doc[hit])
            found.append(f[hit])
        key, n = np.unique(np.concatenate(docs).astype(np.int64) << HASH_BITS | np.concatenate(found), return_counts=True)
        np.add.at(out, key >> HASH_BITS, self.weights[key & ((1 << HASH_BITS) - 1)] * (1 + np.log(n)))
        return out

    def exceed(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > k) by text and threshold."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -50, 50)))


def fit_ordinal(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, grades: np.ndarray, weight: np.ndarray, n_features: int, n_grades: int, penalty: float = 2e-5, steps: int = 800) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of the cumulative-link model, by gradient ascent with Adam.

    Thresholds are theta_0 plus positive gaps, so they stay ordered.
    """
    n = len(grades)
    w, raw = np.zeros(n_features), np.zeros(n_grades - 1)
    raw[0] = 2.0
    m, v = np.zeros(n_features + n_grades - 1), np.zeros(n_features + n_grades - 1)
    total = weight.sum()
    for t in range(1, steps + 1):
        gaps = np.exp(raw[1:])
        theta = np.concatenate([[raw[0]], raw[0] + np.cumsum(gaps)])
        s = np.bincount(rows, weights=w[cols] * values, minlength=n)
        c = 1 / (1 + np.exp(np.clip(s[:, None] - np.concatenate([[-50.0], theta, [50.0]])[None, :], -50, 50)))
        c[:, 0], c[:, -1] = 0, 1
        d = c * (1 - c)
        at = np.arange(n)
        p = np.maximum(c[at, grades + 1] - c[at, grades], 1e-12)
        up, low = weight * d[at, grades + 1] / p, weight * d[at, grades] / p
        g_theta = np.bincount(grades, weights=up, minlength=n_grades)[:-1] - np.bincount(grades, weights=low, minlength=n_grades)[1:]
        g_s = low - up
        g_w = np.bincount(cols, weights=g_s[rows] * values, minlength=n_features) / total - penalty * w
        tail = np.cumsum(g_theta[::-1])[::-1] / total
        g = np.concatenate([g_w, [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        w, raw = w + step[:n_features], raw + step[n_features:]
    return w, np.concatenate([[raw[0]], raw[0] + np.cumsum(np.exp(raw[1:]))])


def _sample_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each labelled text: distinct features, their counts, signatures of its runs of _RUN words."""
    for batch in (b.slice(at, n) for b in batches for at, n in W.portions(b.column("text"))):
        w, ids = _features(batch.column("text"))
        at, h = W.windows(w.hashes()[0], w.doc, _RUN)
        of = w.doc[at]
        bounds, runs = np.searchsorted(w.doc, np.arange(w.n_docs + 1)), np.searchsorted(of, np.arange(w.n_docs + 1))
        feats, counts, signs = [], [], []
        for d in range(w.n_docs):
            a, b = bounds[d], bounds[d + 1]
            f = np.concatenate([x[a:b] for x in ids])
            f, n = np.unique(f[f >= 0], return_counts=True)
            feats.append(f.astype(np.int32))
            counts.append(n.astype(np.int32))
            x = h[runs[d] : runs[d + 1]]
            signs.append([int(W.mix(x ^ U64(k * 0x9E3779B97F4A7C15 & (2**64 - 1))).min().view(np.int64)) for k in range(_SIGNATURES)] if len(x) else [])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), batch.column("grade"), pa.array(feats, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int32())), pa.array(signs, pa.list_(pa.int64()))], ["doc_id", "toxic", "grade", "feats", "counts", "signs"])


def _copies_once(toxic: np.ndarray, signs: list[list[int]]) -> np.ndarray:
    """Rows without those of which an earlier kept row of the same class is a near copy."""
    kept: list[int] = []
    index: dict[tuple[int, int, int], list[int]] = {}
    for i, mine in enumerate(signs):
        keys = [(int(toxic[i]), k, x) for k, x in enumerate(mine)]
        agree = Counter(j for key in keys for j in index.get(key, ()))
        if max(agree.values(), default=0) < _AGREE:
            kept.append(i)
            for key in keys:
                index.setdefault(key, []).append(i)
    return np.array(kept, dtype=np.int64)


def _feature_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, toxic documents, others) of a partition's documents."""
    total = np.zeros((2, 1 << HASH_BITS), dtype=np.int64)
    for batch in batches:
        feats, toxic = batch.column("feats"), batch.column("toxic").to_numpy()
        cols = feats.flatten().to_numpy()
        of = np.repeat(toxic, pc.list_value_length(feats).to_numpy())
        for k in (0, 1):
            total[k] += np.bincount(cols[of == k], minlength=1 << HASH_BITS)
    hit = np.flatnonzero(total.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(total[1, hit]), pa.array(total[0, hit])], ["feat", "n1", "n0"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, grade_column: str | None = None) -> OrdinalModel:
    """Fits on at most `sample` labelled documents of each class (toxic 1 and 0).

    Near copies in the sample (7 of 8 signatures, within a class) count once, as do
    repeated labels of a doc_id; documents labelled both 1 and 0 are left out, as are
    labels without a document, null labels and null ids. Features are those that stand
    in toxic documents far more often than in others. `grade_column` of labels may hold
    grades from 0 (not toxic) up, of which the largest of a doc_id holds; without one,
    grades are derived: a toxic document is graded by how many of its words have such a
    feature (GRADE_CUTS), so severity then says how much toxic wording there is, not
    how people would grade it. Without documents of both classes the model finds
    nothing toxic. Features are counted on the cluster; the driver gets signatures of
    the sample and the counts of chosen features alone.
    """
    known = labels.where("doc_id is not null and toxic in (0, 1)").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"), (F.col(grade_column) if grade_column else F.lit(None)).cast("int").alias("grade"))
    known = durable(known.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most"), F.max("grade").alias("grade")).where("toxic = most").drop("most"))
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    few = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for k in (0, 1)]
    picked = F.broadcast(few[0].unionByName(few[1]))  # at most 2 * sample rows of three numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(picked, "doc_id").select("doc_id", "text", "toxic", "grade")
    got = durable(texts.mapInArrow(tidied(_sample_task), _SAMPLED).withColumn("row", F.monotonically_increasing_id()))  # rows keep their numbers once cut off
    none = OrdinalModel(np.zeros(1 << HASH_BITS), np.array([50.0]))
    marks = got.select("doc_id", "row", "toxic", "signs").toArrow().sort_by([("doc_id", "ascending"), ("row", "ascending")])
    marks = marks.take(pa.array(_copies_once(marks.column("toxic").to_numpy(), marks.column("signs").to_pylist())))
    toxic = marks.column("toxic").to_numpy()
    n_toxic, n_clean = int((toxic == 1).sum()), int((toxic == 0).sum())
    if not n_toxic or not n_clean:
        return none
    place = {x: k for k, x in enumerate(marks.column("row").to_pylist())}

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([x in place for x in batch.column("row").to_pylist()], pa.bool_()))

    rest = got.mapInArrow(kept, _SAMPLED + ", row long")
    counts = rest.mapInArrow(_feature_counts, "feat long, n1 long, n0 long").groupBy("feat").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    counts = counts.where((F.col("n1") + 0.5) / (n_toxic + 1) >= 8 * (F.col("n0") + 0.5) / (n_clean + 1)).toArrow()  # part of what _telling() asks
    inside = np.zeros((2, 1 << HASH_BITS), dtype=np.int64)
    feat = counts.column("feat").to_numpy()
    inside[1, feat], inside[0, feat] = counts.column("n1").to_numpy(), counts.column("n0").to_numpy()
    chosen = _telling(inside[1], inside[0], n_toxic, n_clean)

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("feats")
            row = np.repeat(np.arange(len(batch)), pc.list_value_length(lists).to_numpy())
            cols, n = lists.flatten().to_numpy(), batch.column("counts").flatten().to_numpy()
            hit = chosen[cols]
            at = pa.array(row[hit])
            yield pa.RecordBatch.from_arrays([batch.column("row").take(at), pa.array(cols[hit]), pa.array(n[hit])], ["row", "feat", "n"])

    found = rest.mapInArrow(told, "row long, feat int, n int").toArrow()
    rows = np.array([place[x] for x in found.column("row").to_pylist()], dtype=np.int64)
    values = found.column("n").to_numpy()
    ids, cols = np.unique(found.column("feat").to_numpy(), return_inverse=True)
    if not len(ids):
        return none
    if grade_column:
        graded = {x["doc_id"]: x["grade"] for x in few[0].unionByName(few[1]).select("doc_id", "grade").collect()}
        grades = np.array([max(0, graded.get(i) or 0) for i in marks.column("doc_id").to_pylist()], dtype=np.int64)
    else:
        # a word and its beginnings are counted once: by the feature kind that it has most of
        hits = np.bincount(rows, weights=values, minlength=len(marks)) / (1 + len(PREFIXES)) * 2
        grades = np.where(toxic == 1, 1 + np.searchsorted(GRADE_CUTS, hits, "left"), 0)
    n_grades = max(2, int(grades.max()) + 1)
    weight = np.where(toxic == 1, sizes.get(1, 0) / n_toxic, sizes.get(0, 0) / n_clean)
    w, thresholds = fit_ordinal(rows, cols, 1 + np.log(values), grades.astype(np.int64), weight / weight.mean(), len(ids), n_grades)
    weights = np.zeros(1 << HASH_BITS)
    weights[ids] = w
    return OrdinalModel(weights, thresholds)


def _telling(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
    """Features whose share among toxic documents is far above that among others, beyond chance."""
    a, b = (toxic + 0.5) / (n_toxic + 1), (clean + 0.5) / (n_clean + 1)
    pooled = (toxic + clean + 1) / (n_toxic + n_clean + 2)
    z = (a - b) / np.sqrt(pooled * (1 - pooled) * (1 / n_toxic + 1 / n_clean))
    return (z >= 5) & (a >= 8 * b)


def score(docs: DataFrame, model: OrdinalModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: SCHEMA. severity is the expected grade; toxic: P(grade > 0) >= CUT.

    Null and empty texts have no feature and get what the thresholds alone say; null
    ids and repeated rows stay; an empty table gives no rows; other columns are ignored.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.exceed(model.scores(batch.column(1)))
            grade = (p >= 0.5).sum(axis=1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.sum(axis=1)), pa.array(p[:, 0]), pa.array(grade), pa.array(p[:, 0] >= CUT)], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(docs[id_column].cast("long"), docs[text_column].cast("string")).mapInArrow(tidied(task), SCHEMA)


def without_toxic(docs: DataFrame, model: OrdinalModel, text_column: str = "text") -> DataFrame:
    """The rows of docs that score() doesn't call toxic, all columns as they are, in one pass."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.names.index(text_column)).cast(pa.string())
            yield batch.filter(pa.array(model.exceed(model.scores(texts))[:, 0] < CUT))

    return docs.mapInArrow(tidied(task), docs.schema)
