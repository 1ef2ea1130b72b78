"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of the weights of its words and
word beginnings (each counted once); the document's is the noisy-or, 1 - prod(1 - p), of the sentences that hold a
telling feature. A sentence without one is no evidence and adds nothing to a score, however many there are; only in
learning it counts by the bias, which plain sentences of clean documents hold down. Weights are learned from document
labels alone: a sentence takes blame for its document in proportion to what it adds to the noisy-or, so that the same
model then locates the offending sentences.

The classifier is fitted on a bounded sample: at most MAX_EACH documents of each label, those with the smallest hash of
their id, one row an id, and of these the texts of at most MAX_BYTES. The ids, a table of bounded size, are broadcast;
features are made and counted on the executors; the driver gets the telling ones and where the sample's sentences hold
them. Every document is scored, row by row and without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolode.llm import _grid
from chronolode.llm._session import checkpoint

MAX_EACH = 3000
MAX_BYTES = 200_000
FEATURE_BITS = 20
PREFIXES = (3, 4, 5, 6, 7, 8)
THRESHOLD = 0.7
SENTENCE_THRESHOLD = 0.5
# Chosen on a fold inside the learning rows, by tests/llm/tune_toxicity.py; held-out rows had no part in it.
# A telling feature is so many times as frequent in documents marked toxic as in the others; copies of a few toxic
# documents alone don't lift the rest of their words that far.
LIFT = 20
# Log odds from which a sentence's telling features start: not so low that a short word, which has few features, can't
# outweigh it. Sentences without any stay out of the noisy-or.
BIAS = (-9.0, -5.0)
_BREAKS = np.zeros(256, bool)
_BREAKS[list(b".!?\n")] = True


def held_out(doc_id: Column) -> Column:
    """True for rows kept apart from learning: crc32 of the id as text leaves 1 when divided by 3; a null id: false."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _letters() -> np.ndarray:
    t = np.zeros(256, np.uint8)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    t[128:] = np.arange(128, 256)
    return t


def _sentences(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> Iterator[tuple[_grid.Words, np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of documents: words, feature rows (0 where absent), each word's sentence, each sentence's document."""
    for w in _grid.words(data, offsets, table):
        a = int(offsets[w.lo])
        raw = data[a : a + len(w.buf)]
        capital = np.flatnonzero((raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[:-1] == 0xC3)) + 1  # U+00C0 to U+00DE
        w.buf[capital] += 0x20
        h = _grid.hash_slices(w.buf, w.starts, w.ends, PREFIXES)
        f = (h >> np.uint64(64 - FEATURE_BITS)).astype(np.int32)
        f[h == 0] = 0
        number = np.searchsorted(np.flatnonzero(_BREAKS[raw]), w.starts)
        doc = w.doc()
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (number[1:] != number[:-1])
        yield w, f, np.cumsum(new) - 1, doc[new]


def _log_miss(x: np.ndarray) -> np.ndarray:
    """log(1 - p) of logits."""
    return -np.logaddexp(0, x)


@dataclass
class Model:
    weights: np.ndarray  # by feature
    bias: float

    def logits(self, f: np.ndarray, sentence: np.ndarray, n: int) -> np.ndarray:
        """Log odds of each of n sentences; -inf without any telling feature."""
        x = np.full(n, -np.inf)
        w = self.weights[f]
        row, word = np.nonzero(w)
        if len(word):  # each feature once a sentence
            key = np.unique((sentence[word].astype(np.int64) << FEATURE_BITS) | f[row, word])
            x[key >> FEATURE_BITS] = self.bias
            np.add.at(x, key >> FEATURE_BITS, self.weights[key & ((1 << FEATURE_BITS) - 1)])
        return x


def _sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, max_each: int) -> DataFrame:
    truth = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = (F.xxhash64(F.lit(11), F.col("doc_id")), F.col("doc_id"))
    chosen = truth.filter("toxic = 1").orderBy(*order).limit(max_each).unionByName(truth.filter("toxic = 0").orderBy(*order).limit(max_each))
    chosen = chosen.select(F.col("doc_id").alias("_tox_id"), F.col("toxic").alias("_tox_label"))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).filter(F.octet_length("text") <= MAX_BYTES).join(F.broadcast(chosen), F.col("_id") == F.col("_tox_id"))
    return rows.groupBy("_tox_id").agg(F.first("_tox_label").alias("_tox_label"), F.min("text").alias("text")).select("_tox_label", "text")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = _letters()
    for batch in batches:
        label = batch.column(0).to_pylist()
        for w, f, sentence, doc in _sentences(*_grid.buffers(batch.column(1)), table):
            row, word = np.nonzero(f)
            key = np.unique((sentence[word].astype(np.int64) << FEATURE_BITS) | f[row, word])
            number, feature = key >> FEATURE_BITS, (key & ((1 << FEATURE_BITS) - 1)).astype(np.int32)
            cut = np.searchsorted(number, np.searchsorted(doc, np.arange(len(w.first))))
            each = [number[a:b] - (number[a] if b > a else 0) for a, b in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.record_batch([
                pa.array(label[w.lo : w.lo + len(each)], pa.int32()),
                pa.array([x.astype("<i4").tobytes() for x in each], pa.binary()),
                pa.array([feature[a:b].astype("<i4").tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()),
            ], ["label", "sentence", "feature"])


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(feature, pos, neg): documents of each label that hold a feature."""
    counts = np.zeros((2, 1 << FEATURE_BITS), np.int32)
    for batch in batches:
        for label, f in zip(batch.column(0).to_pylist(), batch.column(2), strict=True):
            counts[1 - label, np.unique(np.frombuffer(f.as_py(), "<i4"))] += 1
    some = np.flatnonzero(counts.any(axis=0))
    yield pa.record_batch([pa.array(some.astype(np.int32)), *(pa.array(c[some].astype(np.int64)) for c in counts)], ["feature", "pos", "neg"])


def _picked(chosen: np.ndarray):
    """Sentences and places in `chosen` (sorted) of the features that it has, and each document's number of sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sent, feat = [], [], []
            for s, f in zip(batch.column(1), batch.column(2), strict=True):
                s, f = np.frombuffer(s.as_py(), "<i4"), np.frombuffer(f.as_py(), "<i4")
                own = np.isin(f, chosen)
                n.append(int(s[-1]) + 1 if len(s) else 0)
                sent.append(s[own].astype("<i4").tobytes())
                feat.append(np.searchsorted(chosen, f[own]).astype("<i4").tobytes())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int32()), pa.array(sent, pa.binary()), pa.array(feat, pa.binary())], ["label", "n", "sentence", "feature"])

    return run


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", max_each: int = MAX_EACH, steps: int = 400,
        lift: float = LIFT, bias: tuple[float, float] = BIAS) -> Model:
    """Learns from documents that `labels` (doc_id, toxic) marks and that are not held out; null labels, ids and texts
    say nothing; of labels of the same id the largest holds, of its texts the smallest. Without any toxic example the
    model finds nothing."""
    rows = checkpoint(_sample(docs, labels, doc_id, text, max_each).mapInArrow(_features, "label int, sentence binary, feature binary"))
    size = 1 << FEATURE_BITS
    sizes = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos:
        return Model(np.zeros(size, np.float32), -12.0)
    # Of features only those that documents marked toxic hold clearly more often: log odds over their standard error.
    # Only these leave the executors.
    pos, neg = F.col("pos"), F.col("neg")
    odds = F.log((pos + 0.5) / (n_pos - pos + 0.5)) - F.log((neg + 0.5) / (n_neg - neg + 0.5))
    z = odds / F.sqrt(1 / (pos + 0.5) + 1 / (neg + 0.5))
    held = rows.mapInArrow(_holders, "feature int, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    telling = held.withColumn("z", z).filter((F.col("z") > 2.5) & (pos >= 3) & (pos * n_neg >= lift * (neg + 1) * n_pos))
    found = sorted((r["feature"], r["z"]) for r in telling.select("feature", "z").collect())
    chosen, score_z = np.array([f for f, _ in found], np.int64), np.array([v for _, v in found])
    picked = [tuple(r) for r in rows.mapInArrow(_picked(chosen), "label int, n int, sentence binary, feature binary").collect()]
    picked.sort()  # the same sums in every run
    y = np.array([r[0] for r in picked], float)
    n_sent = np.array([r[1] for r in picked])
    first = np.cumsum(n_sent) - n_sent
    bag, base = np.repeat(np.arange(len(picked)), n_sent), int(n_sent.sum())
    sent = np.concatenate([np.frombuffer(r[2], "<i4") + b for r, b in zip(picked, first, strict=True)])
    feat = np.concatenate([np.frombuffer(r[3], "<i4") for r in picked])
    weight = np.where(y > 0, 0.5 / n_pos, 0.5 / max(n_neg, 1))
    w, b, vw, vb = np.zeros(len(chosen)), bias[1], np.zeros(len(chosen)), 0.0
    # Common features of toxic documents start ahead, by how much they tell.
    w += np.clip(2 * (score_z - 2.5), 0, 6)
    for _ in range(steps):
        x = b + np.bincount(sent, w[feat], minlength=base)
        miss = np.minimum(np.bincount(bag, _log_miss(x), minlength=len(y)), -1e-9)
        p = 1 / (1 + np.exp(-x))
        # d loss / d x: for label 1, -p * (1 - P) / P of its bag; for label 0, p.
        g = weight[bag] * np.where(y[bag] > 0, -p * np.exp(miss[bag]) / -np.expm1(miss[bag]), p)
        gw = np.bincount(feat, g[sent], minlength=len(chosen)) + 1e-5 * w
        gb = g.sum()
        vw, vb = 0.9 * vw - 2.0 * gw, 0.9 * vb - 2.0 * gb
        w, b = np.maximum(w + vw, 0), min(max(b + vb, bias[0]), bias[1])
    weights = np.zeros(size, np.float32)
    weights[chosen] = w
    return Model(weights, float(b))


_OUT = [
    T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()),
    T.StructField("sentences", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("p", T.DoubleType())]))),
]


def score(docs: DataFrame, model: Model, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Adds score, predicted and sentences (code points of first and beyond the last word, and probability, of those
    at SENTENCE_THRESHOLD or more) to every row.

    A null or empty text and one without letters has no sentence; its score is the noisy-or of none, 0. Repeated rows
    get the same score; ties cannot arise; columns named like one that is added are replaced.
    """
    keep = [f for f in docs.schema.fields if f.name not in {x.name for x in _OUT}]
    names = [f.name for f in keep]
    column = names.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, m = _letters(), shared.value
        for batch in batches:
            data, offsets = _grid.buffers(batch.column(column))
            total, found = np.zeros(batch.num_rows), [[] for _ in range(batch.num_rows)]
            for w, f, sentence, doc in _sentences(data, offsets, table):
                x = m.logits(f, sentence, len(doc))
                total[w.lo : w.lo + len(w.first) - 1] = np.bincount(doc, _log_miss(x), minlength=len(w.first) - 1)
                bad = np.flatnonzero(x >= np.log(SENTENCE_THRESHOLD / (1 - SENTENCE_THRESHOLD)))
                if not len(bad):
                    continue
                a = int(offsets[w.lo])
                chars = np.cumsum((data[a : a + len(w.buf)] & 0xC0) != 0x80)
                first, last = np.searchsorted(sentence, bad), np.searchsorted(sentence, bad, side="right") - 1
                for i, s, e in zip(bad.tolist(), w.starts[first].tolist(), w.ends[last].tolist(), strict=True):
                    d = int(doc[i])
                    zero = int(offsets[w.lo + d]) - a
                    before = int(chars[zero - 1]) if zero else 0
                    found[w.lo + d].append({"start": int(chars[s]) - 1 - before, "end": int(chars[e - 1]) - before, "p": float(1 / (1 + np.exp(-x[i])))})
            p = -np.expm1(total)
            rows = [*batch.columns[: len(names)], pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])))]
            yield pa.record_batch(rows, [*names, *(f.name for f in _OUT)])

    return docs.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, T.StructType([*keep, *_OUT]))


def classify(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fits on the labelled rows that are not held out and scores every row of docs; see fit() and score()."""
    return score(docs, fit(docs, labels, doc_id=doc_id, text=text), text=text)
