"""SimHash near-duplicates, searched by multi-index hashing.

Fingerprints are cut into two segments of 32 bits. If two fingerprints differ in at most 3 bits, one of the segments
differs in at most 1 (two segments that differ in 2 or more make 4), so a Hamming ball of radius 1 around each
segment finds every pair. Of two values one bit apart one holds the bit and the other one lacks it, so only balls
downwards are enumerated: a value itself and the value with one set bit cleared, 17 probes a segment on average, and
each pair meets once. Matches are verified on all 64 bits within the join. Search runs on distinct fingerprints:
copies never meet each other, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolode.llm import _grid
from chronolode.llm._session import checkpoint, connected_components, hot_join

BITS = 3
SHINGLE = 3
SEED = 42
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    w = text.translate(_LOWER).split()
    if not w:
        return np.zeros(0, np.uint64)
    joined = b" ".join(w)
    n = len(w) - shingle + 1
    if n <= 1:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    size = np.fromiter(map(len, w), np.int64, len(w))
    begin = np.cumsum(size + 1) - size - 1
    stop = (begin + size)[shingle - 1 :]
    parts = map(joined.__getitem__, map(slice, begin[:n].tolist(), stop.tolist()))
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n)


def majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Fingerprint of each run of sizes[i] hashes: the bits set in over half of them; of none: zero.

    Eight sums of byte lanes count all 64 bits; a lane holds 255 hashes, so runs are summed in blocks first.
    """
    out = np.zeros(len(sizes), np.uint64)
    has = np.flatnonzero(sizes)
    if not len(has):
        return out
    n = sizes[has]
    blocks = -(-n // 255)
    first = np.cumsum(blocks) - blocks
    begin = np.cumsum(n) - n
    at = np.repeat(begin - 255 * first, blocks) + 255 * np.arange(blocks.sum())
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & _LANES, at).view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(lanes.astype(np.int64), first, axis=0)
        for k in range(8):
            out[has] |= (2 * counts[:, k] > n).astype(np.uint64) << np.uint64(8 * k + j)
    return out


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, fp long) of every row; text_hash tells rows of the same id apart. Null text: no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = _grid.buffers(batch.column(2))
            found = []
            for lo, hi in _grid.groups(offsets):
                each = [shingle_hashes(data[a:b].tobytes(), shingle) for a, b in zip(offsets[lo:hi].tolist(), offsets[lo + 1 : hi + 1].tolist(), strict=True)]
                found.append(majority(np.concatenate(each), np.array([len(x) for x in each])))
            fp = np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(fp)], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("fp", T.LongType())])
    return rows.mapInArrow(run, schema)


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a, b) of different values of column fp that differ in at most BITS bits."""
    half = F.explode(F.array(
        F.struct(F.lit(0).alias("seg"), F.col("fp").bitwiseAND(0xFFFFFFFF).alias("key")),
        F.struct(F.lit(1).alias("seg"), F.shiftrightunsigned("fp", 32).alias("key")),
    )).alias("s")
    table = fps.select("fp", half).select("fp", "s.seg", "s.key")
    cleared = F.expr("transform(filter(sequence(0, 31), i -> (shiftrightunsigned(key, i) & 1L) = 1L), i -> key - shiftleft(1L, i))")
    probes = table.select(F.col("fp").alias("a"), "seg", F.explode(F.concat(F.array("key"), cleared)).alias("key"), F.col("key").alias("own"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS
    once = (F.col("own") != F.col("key")) | (F.col("a") < F.col("b"))
    return probes.join(table.withColumnRenamed("fp", "b"), ["seg", "key"]).filter(near & once & (F.col("a") != F.col("b"))).select("a", "b")


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, fp, fingerprint, component_id, root): one row for each row of docs.

    component_id is the smallest non-null doc_id among all rows whose fingerprints are linked, over any number of
    steps; root names the component also where no row has an id. Null and empty texts and texts without words have
    fingerprint zero and are linked like any other; rows that repeat are copies; columns that are not named play no
    part. An empty table gives an empty result.
    """
    rows = checkpoint(fingerprints(docs, doc_id=doc_id, text=text))
    fps = checkpoint(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count(F.lit(1)).alias("n")))
    comp = connected_components(links(fps.select("fp")))
    fps = fps.join(comp.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("component", "fp")).drop("component")
    least = fps.groupBy("root").agg(F.min("low").alias("component_id"))
    known = checkpoint(fps.join(least, "root").select("fp", "root", "component_id", "n"))
    return hot_join(rows, known, ["fp"], "n").select("doc_id", "text_hash", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root")


def deduplicate(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs without near-duplicates: of each component the row with the smallest id (null ids last) stays."""
    found = near_duplicates(docs, doc_id=doc_id, text=text).filter("doc_id <=> component_id")
    best = Window.partitionBy("root").orderBy("text_hash")
    keep = found.withColumn("_rank", F.row_number().over(best)).filter("_rank = 1").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
    rows = docs.withColumn("_own", F.xxhash64(text))
    same = Window.partitionBy("_hash", "_id").orderBy(F.lit(1))
    joined = rows.join(keep, (F.col("_own") == F.col("_hash")) & rows[doc_id].eqNullSafe(F.col("_id")))
    return joined.withColumn("_copy", F.row_number().over(same)).filter("_copy = 1").select(*[rows[f"`{c}`"] for c in docs.columns])
