"""Benchmark decontamination: prefix-filtered containment join of documents with benchmark windows.

Every window of WINDOW consecutive item words (an item with fewer words is one window) is a set of word shingles
with positions. Exact containment needs all of them, so a prefix of one shingle is enough: the rarest by its count
over all documents. Documents are joined with the windows on that shingle alone; length and positional bounds drop
starts whose window would leave the document, and what is left is verified word by word.

Both sides are tables, whatever the size of the benchmark. Windows and their shingles are made on the executors. One
pass over the documents counts the benchmark's shingles, one emits the places where a window's rarest shingle stands,
with the words around them; a filter of bits, whose size is bounded (BITS), keeps other shingles out of both shuffles.
The places are joined with the windows, each window in SALTS copies, so that a passage that many documents share is
spread over as many tasks. Whole texts are never shuffled to find hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolode.llm import _grid
from chronolode.llm._session import checkpoint

WINDOW = 13
SHINGLE = 5
#: The filter has 32 bits for each of its hashes, within these bounds (2 ** 27 bits are 16 MB).
BITS = (20, 27)
SALTS = 16
_BUCKET = 1 << 15  # bits in a row of Spark's bitmaps
ADDED = ("n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated")


def text_words(text: str | None) -> list[str]:
    """The words of a text: A-Z lowered; runs of letters, digits and everything from U+0080 on."""
    data = pa.array([text], pa.string())
    return [w.buf[a:b].tobytes().decode() for w in _grid.words(*_grid.buffers(data), _grid.fold_table()) for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]


def _windows(benchmark: DataFrame, window: int, shingle: int) -> DataFrame:
    """(item, s, hashes, words): each window of each item, with the hashes of its shingles of s words in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _grid.fold_table()
        for batch in batches:
            for w in _grid.words(*_grid.buffers(batch.column(1)), table):
                h = w.hashes()
                joined = [w.buf[a:b].tobytes() for a, b in zip(w.starts.tolist(), w.ends.tolist(), strict=True)]
                for d, (lo, hi) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True)):
                    n = min(window, hi - lo)
                    if not n:
                        continue
                    s = min(shingle, n)
                    g = _grid.sequence_hash(h[lo:hi], s).view(np.int64)
                    starts = range(hi - lo - n + 1)
                    yield pa.record_batch([
                        pa.repeat(batch.column(0)[w.lo + d], len(starts)), pa.array([s] * len(starts), pa.int32()),
                        pa.array([g[i : i + n - s + 1] for i in starts], pa.list_(pa.int64())),
                        pa.array([[x.decode("utf-8", "replace") for x in joined[lo + i : lo + i + n]] for i in starts], pa.list_(pa.string())),
                    ], ["item", "s", "hashes", "words"])

    rows = benchmark.select(F.col("item_id").alias("item"), F.col("text").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["item"], T.StructField("s", T.IntegerType()), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("words", T.ArrayType(T.StringType()))]))


class _Filter:
    """Two bits for each of a set of hashes; other hashes pass by chance, in about 4 of 1,000 cases up to the bound."""

    def __init__(self, hashes: DataFrame):
        """hashes(s, h) without repeats."""
        sizes = {r["s"]: r["count"] for r in hashes.groupBy("s").count().collect()}  # at most the shingle size
        n = sum(sizes.values())
        self.power = min(max((32 * n - 1).bit_length() if n else 0, BITS[0]), BITS[1])
        h = F.col("h")
        places = F.explode(F.array(*[F.shiftrightunsigned(x, 64 - self.power) for x in (h, F.shiftleft(h, 28))])).alias("p")
        rows = hashes.select(places).groupBy(F.expr(f"p div {_BUCKET}").alias("b")).agg(F.expr(f"bitmap_construct_agg(p % {_BUCKET})").alias("bits")).collect()  # at most 2 ** 27 bits
        packed = np.zeros((1 << self.power) // 8, np.uint8)
        for r in rows:
            packed[r["b"] * _BUCKET // 8 : (r["b"] + 1) * _BUCKET // 8] = np.frombuffer(r["bits"], np.uint8)
        self.packed = packed
        self.sizes = sorted(sizes)

    def places(self, h: np.ndarray) -> np.ndarray:
        """Positions in h that may be in the set."""
        def on(p: np.ndarray) -> np.ndarray:
            return (self.packed[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1

        shift = np.uint64(64 - self.power)
        at = np.flatnonzero(on(h >> shift))
        return at[on((h[at] << np.uint64(28)) >> shift) > 0]


def _counts(docs: DataFrame, text: str, known: DataFrame) -> DataFrame:
    """(s, h, n): how often the shingles of known(s, h), and some others, stand in the documents."""
    shared = docs.sparkSession.sparkContext.broadcast(_Filter(known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keep = _grid.fold_table(), shared.value
        for batch in batches:
            for w in _grid.words(*_grid.buffers(batch.column(0)), table):
                h, doc = w.hashes(), w.doc()
                for s in keep.sizes:
                    g = _grid.sequence_hash(h, s)
                    at = keep.places(g)
                    own, n = np.unique(g[at[doc[at] == doc[at + s - 1]]], return_counts=True)
                    yield pa.record_batch([pa.array(np.full(len(own), s), pa.int32()), pa.array(own.view(np.int64)), pa.array(n, pa.int64())], ["s", "h", "n"])

    return docs.select(text).mapInArrow(run, "s int, h long, n long").groupBy("s", "h").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, doc_id: str, text: str, anchors: DataFrame, window: int) -> DataFrame:
    """(doc_id, text_hash, s, h, at, before, words): places of the anchors' shingles, the word number of the first of
    `words`, which stand around it within its document, and how many of them come before it."""
    shared = docs.sparkSession.sparkContext.broadcast(_Filter(anchors))
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(f"`{text}`").alias("text"))
    names = ["doc_id", "text_hash", "s", "h", "at", "before", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keep = _grid.fold_table(), shared.value
        for batch in batches:
            for w in _grid.words(*_grid.buffers(batch.column(2)), table):
                h, doc = w.hashes(), w.doc()
                for s in keep.sizes:
                    g = _grid.sequence_hash(h, s)
                    at = keep.places(g)
                    at = at[doc[at] == doc[at + s - 1]]
                    if not len(at):
                        continue
                    d = doc[at]
                    lo = np.maximum(w.first[d], at - (window - s))
                    hi = np.minimum(w.first[d + 1], at + window)
                    around = [[w.buf[x:y].tobytes().decode("utf-8", "replace") for x, y in zip(w.starts[a:b].tolist(), w.ends[a:b].tolist(), strict=True)] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
                    own = pa.array(d + w.lo)
                    yield pa.record_batch([
                        batch.column(0).take(own), batch.column(1).take(own), pa.array(np.full(len(at), s), pa.int32()), pa.array(g[at].view(np.int64)),
                        pa.array(lo - w.first[d], pa.int64()), pa.array(at - lo, pa.int32()), pa.array(around, pa.list_(pa.string())),
                    ], names)

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("text_hash", T.LongType()), T.StructField("s", T.IntegerType()), T.StructField("h", T.LongType()),
                                              T.StructField("at", T.LongType()), T.StructField("before", T.IntegerType()), T.StructField("words", T.ArrayType(T.StringType()))]))


def hits(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, text_hash, n_hit, spans, items) of documents that hold a window: spans are the word positions covered,
    half open and merged; items are the distinct non-null item ids, sorted as strings. Rows that repeat are one."""
    shingle = min(shingle, window)
    found = _windows(benchmark, window, shingle)
    win = F.xxhash64("words")
    wins = checkpoint(found.groupBy(F.col("words")).agg(F.first("s").alias("s"), F.first("hashes").alias("hashes")))
    shingles = wins.select("words", "s", F.posexplode("hashes").alias("pos", "h"))
    known = shingles.select("s", "h").distinct()
    counts = _counts(docs, text, known)
    counted = shingles.join(known.join(counts, ["s", "h"], "left").select("s", "h", F.coalesce("n", F.lit(0)).alias("n")), ["s", "h"])
    # The rarest shingle; of equal counts the smallest hash, which overlapping windows share. One that no document has
    # can't be met, nor can its window.
    anchors = counted.groupBy("words", "s").agg(F.min(F.struct("n", "h", "pos")).alias("a")).filter("a.n > 0").select("s", F.col("a.h").alias("h"), F.col("a.pos").alias("pos"), "words")
    anchors = checkpoint(anchors)
    places = _places(docs, doc_id, text, anchors.select("s", "h").distinct(), window).withColumn("salt", F.pmod(F.xxhash64("text_hash", "at"), F.lit(SALTS)))
    spread = anchors.select("s", "h", "pos", F.col("words").alias("wanted"), F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)")).alias("salt"))
    begin, size = F.col("before") - F.col("pos"), F.size("wanted")
    met = places.join(spread, ["s", "h", "salt"]).filter((begin >= 0) & (begin + size <= F.size("words")))  # length and position
    met = met.filter(F.slice("words", begin + 1, size) == F.col("wanted"))
    start = F.col("at") + begin
    met = checkpoint(met.select("doc_id", "text_hash", start.alias("start"), (start + size).alias("end"), F.xxhash64("wanted").alias("win")).distinct())
    pieces = F.array_sort(F.collect_set(F.struct("start", "end")))
    first = F.struct(F.lit(-1).cast("long").alias("start"), F.lit(-1).cast("long").alias("end"))

    def join(acc, x):
        last = F.element_at(acc, -1)
        apart = x["start"] > last["end"]
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))
        return F.when(apart, F.concat(acc, F.array(x))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer)))

    spans = F.aggregate("pieces", F.array(first), join, lambda acc: F.slice(acc, 2, F.size(acc)))
    covered = met.groupBy("doc_id", "text_hash").agg(pieces.alias("pieces")).withColumn("spans", spans)
    covered = covered.select("doc_id", "text_hash", F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"]).alias("n_hit"), "spans")
    holders = found.filter("item is not null").select(win.alias("win"), "item").distinct()
    items = met.select("doc_id", "text_hash", "win").distinct().join(holders, "win").groupBy("doc_id", "text_hash").agg(F.collect_set("item").alias("items"))
    items = items.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), F.transform(F.array_sort(F.transform("items", lambda x: F.struct(x.cast("string").alias("s"), x.alias("x")))), lambda y: y["x"]).alias("items"))
    out = covered.join(items, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left")
    none = F.array().cast(T.ArrayType(benchmark.schema["item_id"].dataType))
    return out.select("doc_id", "text_hash", "n_hit", "spans", F.coalesce("items", none).alias("items"))


def _with_sizes(docs: DataFrame, text: str) -> DataFrame:
    """docs with n_words."""
    names = docs.columns
    column = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _grid.fold_table()
        for batch in batches:
            n = [np.zeros(0, np.int64), *(np.diff(w.first) for w in _grid.words(*_grid.buffers(batch.column(column)), table))]
            yield pa.record_batch([*batch.columns, pa.array(np.concatenate(n), pa.int64())], [*names, "n_words"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType())]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, shingle: int = SHINGLE,
                  threshold: tuple[int, int] = (1, 20)) -> DataFrame:
    """Adds n_words, n_hit, n_items, items, items_sha256 and contaminated to every row of docs.

    Item ids may be of any type and keep it. A row is a document of its own, whatever its id: repeated rows get equal
    results, null ids and other columns pass through as they are, and a column of docs named like one that is added is
    replaced. A null text, an empty one and one without words have 0 words and are not contaminated. Items that are
    null, empty or without words hit nothing; an item with a null id hits words but has no part in items or n_items;
    rows with the same item_id are one item. An empty benchmark contaminates nothing.
    threshold is an exact fraction (p, q): contaminated is n_hit > 0 and q * n_hit >= p * n_words.
    """
    p, q = threshold
    names = [c for c in docs.columns if c not in ADDED]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    found = hits(rows, benchmark, doc_id=doc_id, text=text, window=window, shingle=shingle)
    found = found.select(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash"), F.col("n_hit").alias("_n_hit"), F.col("items").alias("_hit_items"))
    # The hash apart: where the caller drops the text, it is not shuffled for this join.
    sized = _with_sizes(rows, text).withColumn("_hit_own", F.xxhash64(text))
    same = (F.col("_hit_own") == F.col("_hit_hash")) & sized[doc_id].eqNullSafe(F.col("_hit_id"))
    n_hit = F.coalesce("_n_hit", F.lit(0).cast("long"))
    items = F.coalesce("_hit_items", F.array().cast(found.schema["_hit_items"].dataType))
    listed = F.array_join(F.transform(items, lambda x: x.cast("string")), ",")
    return sized.join(found, same, "left").select(
        *[F.col(f"`{c}`") for c in names], "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"),
        F.sha2(listed, 256).alias("items_sha256"), ((n_hit > 0) & (q * n_hit >= p * F.col("n_words"))).alias("contaminated"))
