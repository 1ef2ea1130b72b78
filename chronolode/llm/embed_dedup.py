"""Embedding near-duplicates by p-stable hashing for Euclidean distance.

Vectors are normalised, so a cosine of at least COSINE is a distance of at most sqrt(2 - 2 COSINE). A table's key is
the cells of WIDTH into which Gaussian projections (the 2-stable law) fall. A label of LABEL classes has HASHES
projections a table; a larger one has more, so that as many unrelated vectors meet in a table as before, and for it as
many more tables as keep the chance to miss a pair at the very threshold below MISS.

Vectors that are equal after normalisation are one class: search and verification run on classes, and members are
counted by joins, so that copies never meet each other. Classes that share a key are compared as blocks of a matrix of
cosines, in double precision. A pair counts in the first table in which it meets, and only sums leave a block: of each
class the number of vectors linked, and a spanning forest of the links for the components. So rows grow with the
classes and tables, not with the pairs of a group; what a large group of near copies costs is arithmetic. A cell of more
than BLOCK classes is cut into parts, and pairs of parts are blocks of their own, so that no cell is gathered in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolode.llm import _grid
from chronolode.llm._session import checkpoint, connected_components, hot_join

COSINE = 0.98
HASHES = 10
LABEL = 10_000
WIDTH = 1.2
MISS = 2e-6
SEED = 7
BLOCK = 512


def _matrix(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows of finite, non-null, non-zero vectors, and those vectors in double precision."""
    rows, found = [], []
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    nulls = np.asarray(flat.is_null()) if flat.null_count else None
    values = np.asarray(flat.fill_null(float("nan")) if nulls is not None else flat, np.float64)
    size = np.asarray(column.value_lengths().fill_null(0), np.int64)
    stop = np.cumsum(size)
    for i, (n, e) in enumerate(zip(size.tolist(), stop.tolist(), strict=True)):
        if n:
            v = values[e - n : e]
            if np.isfinite(v).all() and v.any():
                rows.append(i)
                found.append(v)
    return np.array(rows, np.int64), found


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max()
    return v / math.sqrt(float(v @ v))


def meeting(distance: float, width: float) -> float:
    """Chance that two vectors of this distance fall into the same cell of one projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def shape(classes: int, cosine: float, width: float) -> tuple[int, int]:
    """Projections a table and tables for a label of so many classes; unrelated vectors are a right angle apart."""
    near, far = meeting(math.sqrt(2 - 2 * cosine), width), meeting(math.sqrt(2), width)
    hashes = HASHES + max(0, math.ceil(math.log(classes / LABEL) / -math.log(far)))
    return hashes, math.ceil(math.log(MISS) / math.log1p(-(near**hashes)))


def keys(vectors: np.ndarray, tables: int, hashes: int, width: float, seed: int) -> np.ndarray:
    """64-bit table keys of unit vectors, one row a vector. Projections follow from seed, dimension and numbers."""
    rng = np.random.Generator(np.random.PCG64([seed, vectors.shape[1], hashes]))
    a = rng.standard_normal((vectors.shape[1], tables * hashes))
    b = rng.uniform(0, width, tables * hashes)
    cell = np.floor((vectors @ a + b) / width).astype(np.int64).reshape(len(vectors), tables, hashes)
    h = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64), (len(vectors), tables)).copy()
    for k in range(hashes):
        h = _grid.mix(h * np.uint64(0xD6E8FEB86659FD93) + cell[:, :, k].astype(np.uint64))
    return h.view(np.int64)


def _prepare(df: DataFrame) -> DataFrame:
    """(vec_id, lab, cls, unit) of usable rows; cls hashes the unit vector's bits and the label, lab the label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = _matrix(batch.column(2))
            units = [_unit(v) for v in found]
            at = pa.array(rows)
            yield pa.record_batch([
                batch.column(0).take(at), batch.column(1).take(at),
                pa.array([(np.round(u, 12) + 0.0).tobytes() for u in units], pa.binary()), pa.array([u.tobytes() for u in units], pa.binary()),
            ], ["vec_id", "lab", "bits", "unit"])

    rows = df.filter("label is not null and embedding is not null").select("vec_id", F.xxhash64("label").alias("lab"), "embedding")
    kind = T.StructType([rows.schema["vec_id"], T.StructField("lab", T.LongType()), T.StructField("bits", T.BinaryType()), T.StructField("unit", T.BinaryType())])
    return rows.mapInArrow(run, kind).withColumn("cls", F.xxhash64("bits", "lab")).drop("bits")


def _keyed(classes: DataFrame, cosine: float, width: float, seed: int) -> DataFrame:
    """classes(cls, lab, n, unit, m) with keys, which also depend on the label."""
    names = ["cls", "lab", "n", "unit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lab, unit = batch.column(1).to_numpy().view(np.uint64), batch.column(3).to_pylist()
            kinds = [(*shape(m, cosine, width), len(u)) for m, u in zip(batch.column(4).to_pylist(), unit, strict=True)]
            for hashes, tables, size in sorted(set(kinds)):
                mine = np.array([i for i, x in enumerate(kinds) if x == (hashes, tables, size)])
                k = keys(np.stack([np.frombuffer(unit[i]) for i in mine]), tables, hashes, width, seed)
                k = _grid.mix(k.view(np.uint64) ^ lab[mine][:, None]).view(np.int64)
                yield pa.record_batch([*(batch.column(c).take(pa.array(mine)) for c in range(4)), pa.array(list(k), pa.list_(pa.int64()))], [*names, "keys"])

    return classes.select(*names, "m").mapInArrow(run, "cls long, lab long, n long, unit binary, keys array<long>")


def _forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    new = linked.any(axis=1)
    for root in range(len(linked)):
        if not new[root]:
            continue
        new[root] = False
        front = [root]
        while front:
            at = front.pop()
            found = np.flatnonzero(linked[at] & new)
            new[found] = False
            for x in found.tolist():
                yield at, x
                front.append(x)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[int]]]:
    """Tables of whole blocks of equal (key, i, j), and where each begins; only one block is held over."""
    rest = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table])
        key, i, j = (table.column(c).to_numpy() for c in ("key", "i", "j"))
        new = (np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist()
        if new:
            yield table.slice(0, new[-1]), [0, *new]
            table = table.slice(new[-1])
        rest = table
    if rest is not None and rest.num_rows:
        yield rest, [0, rest.num_rows]


def _compare(cosine: float):
    """Of each block, rows sorted by (key, i, j): (a, b, other), where b is null in sums and other 0 in edges."""

    def block(key: int, within: bool, part: np.ndarray, cls: np.ndarray, n: np.ndarray, unit: np.ndarray, k: np.ndarray) -> tuple[list, list, list]:
        size = np.sqrt(np.einsum("ij,ij->i", unit, unit))
        near = unit @ unit.T / (size[:, None] * size) >= cosine
        np.fill_diagonal(near, False)
        if not within:
            near &= part[:, None] != part[None, :]
        if not near.any():
            return [], [], []
        edges = [(int(cls[x]), int(cls[y])) for x, y in _forest(near)]
        table = int(np.flatnonzero(k[0] == key)[0])
        for t in range(table):  # met before
            near &= k[:, t, None] != k[None, :, t]
        other = near @ n
        some = np.flatnonzero(other)
        return [*cls[some].tolist(), *(x for x, _ in edges)], [*[None] * len(some), *(y for _, y in edges)], [*other[some].tolist(), *[0] * len(edges)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, bounds in _blocks(batches):
            key, i, j, part, cls, lab, n = (table.column(c).to_numpy() for c in ("key", "i", "j", "part", "cls", "lab", "n"))
            unit, own_keys = table.column("unit").to_pylist(), table.column("keys")
            a, b, other = [], [], []
            for begin, stop in zip(bounds[:-1], bounds[1:], strict=True):
                kinds = [(x, len(u)) for x, u in zip(lab[begin:stop].tolist(), unit[begin:stop], strict=True)]
                for kind in set(kinds):  # one, but for keys that agree by chance
                    at = np.array([begin + x for x, y in enumerate(kinds) if y == kind])
                    if len(at) > 1:
                        k = np.array(own_keys.take(pa.array(at)).combine_chunks().flatten()).reshape(len(at), -1)
                        found = block(int(key[begin]), i[begin] == j[begin], part[at], cls[at], n[at], np.stack([np.frombuffer(unit[x]) for x in at]), k)
                        for x, y in zip((a, b, other), found, strict=True):
                            x += y
            yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(other, pa.int64())], ["a", "b", "other"])

    return run


def near_duplicates(vectors: DataFrame, *, cosine: float = COSINE, width: float = WIDTH, seed: int = SEED) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of vectors (vec_id, embedding, label).

    Rows link where labels are equal and not null and the cosine is at least `cosine`. Null, empty and zero vectors,
    and vectors with null or non-finite components, link with nothing, nor do vectors of different length. Rows that
    repeat are vectors of their own, also under one id; a row without an id links like any other but names no
    component (it is kept only where no id is reached). Other columns play no part. An empty table
    gives an empty result.
    """
    rows = checkpoint(_prepare(vectors))
    classes = checkpoint(rows.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("low"), F.first("lab").alias("lab"), F.first("unit").alias("unit")))
    sizes = classes.groupBy("lab").agg(F.count(F.lit(1)).alias("m"))
    keyed = checkpoint(_keyed(hot_join(classes, sizes, ["lab"], "m"), cosine, width, seed))
    cells = keyed.select("cls", F.explode("keys").alias("key"))
    crowded = cells.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    # A cell of more than BLOCK classes: parts by hash, pairs of parts as keys.
    entries = cells.join(crowded, "key").withColumn("parts", F.ceil(F.col("size") / BLOCK).cast("int"))
    entries = entries.withColumn("part", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("parts")).cast("int"))
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: F.struct(F.least("part", x).alias("i"), F.greatest("part", x).alias("j"))))
    entries = entries.select("key", "cls", "part", pair.alias("p")).select("key", "p.i", "p.j", "part", "cls")
    blocks = entries.join(keyed, "cls").select("key", "i", "j", "part", "cls", "lab", "n", "unit", "keys")
    found = checkpoint(blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "cls").mapInArrow(_compare(cosine), "a long, b long, other long"))
    linked = found.filter("b is null").groupBy("a").agg(F.sum("other").alias("other"))
    comp = connected_components(found.filter("b is not null").select("a", "b"))
    known = classes.select("cls", "n", "low").join(linked.withColumnRenamed("a", "cls"), "cls", "left").join(comp.withColumnRenamed("node", "cls"), "cls", "left")
    known = known.withColumn("root", F.coalesce("component", "cls"))
    least = known.groupBy("root").agg(F.min("low").alias("component_id"))
    known = checkpoint(known.join(least, "root").select("cls", "n", (F.col("n") - 1 + F.coalesce("other", F.lit(0))).alias("n_links"), "component_id"))
    found = hot_join(rows.select("vec_id", "cls"), known, ["cls"], "n").select("vec_id", "n_links", "component_id")
    # Rows that link with nothing: those that _prepare left out.
    out = _unusable(vectors).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(out).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))


def _unusable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding")
    usable = F.col("label").isNotNull() & v.isNotNull() & F.exists(v, lambda x: x != 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.filter(~F.coalesce(usable, F.lit(False)))
