"""WARC records and their Merkle fixity audit.

Records are hashed one by one. A node of the tree is a range of offsets of an archive: level 1 covers RANGE bytes, each
further level FANOUT ranges of the one below, up to the whole archive; above, FANOUT archives make a node, up to one
root. A node's hash covers its children's ids and hashes in order, so a difference anywhere shows in every node above
it. Replicas are compared by their roots; only children of nodes that differ are read further, level by level. Records
of the ranges that differ are then aligned by their ids: one that only lies elsewhere, because another one before it
grew, shrank or was lost, is sound, and what remains is altered, missing or additional.

A node has at most FANOUT children, or the records of one range, so no group grows with the input. For trees and audit
page bytes never leave the row they stand in: what is shuffled is a hash and an offset for each record.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolode.llm._session import checkpoint

PER_ARCHIVE = 1024
RANGE = 1 << 16
FANOUT = 16
DATE = "1970-01-01T00:00:00Z"
#: Bytes of records after which a batch goes on.
BATCH = 1 << 24


def _urn(record_id: Column) -> Column:
    m = F.md5(record_id.cast("binary"))
    uuid = F.concat_ws("-", *[F.substring(m, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))


def _record_id(page_id: Column, url: Column) -> Column:
    return _urn(F.concat_ws("\n", page_id.cast("string"), url))


def record(url: Column, body: Column, record_id: Column, date: str = DATE) -> Column:
    """One WARC/1.1 resource record as binary; null url or body count as empty."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit("")).cast("binary")
    head = F.concat(F.lit(f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Date: {date}\r\nWARC-Record-ID: "), _urn(record_id), F.lit("\r\nWARC-Target-URI: "), url,
                    F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def archives(pages: DataFrame, per_archive: int = PER_ARCHIVE) -> int:
    """How many archives of about per_archive records the pages make."""
    return max(1, -(-pages.count() // per_archive))


def _placed(pages: DataFrame, page_id: str, url: str, html: str, n: int, copies: dict[str, tuple[Column, Column]] | None = None) -> DataFrame:
    """(archive, _id, _url, record): the archive goes by a hash of id and url, of the html where both are null. For each
    of copies same_i, whether it holds the same record, and other_i, what it holds instead, null for nothing."""
    rid = F.concat_ws("\n", F.col(page_id).cast("string"), F.col(url))
    named = F.when(F.col(page_id).isNull() & F.col(url).isNull(), F.md5(F.coalesce(F.col(html), F.lit("")).cast("binary"))).otherwise(rid)
    archive = F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long") % n
    more = []
    for i, (body, kept) in enumerate((copies or {}).values()):
        same = F.coalesce(kept, F.lit(False)) & body.eqNullSafe(F.col(html))
        more += [same.alias(f"same_{i}"), F.when(kept & ~same, record(F.col(url), body, rid)).alias(f"other_{i}")]
    return pages.select(archive.alias("archive"), F.col(page_id).alias("_id"), F.col(url).alias("_url"), record(F.col(url), F.col(html), rid).alias("record"), *more)


def manifest(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html", n_archives: int | None = None) -> DataFrame:
    """(archive, start, length, sha, record_id): where write() puts each page's record, and its hash.

    Page ids may be of any type. Records lie in order of id (null first), url and hash. A null url or html counts as
    empty; rows that repeat are records of their own, side by side, and one row until they are placed, so that copies
    never make an archive's window long. Other columns play no part; an empty table gives an empty manifest.
    """
    rows = _placed(pages, page_id, url, html, n_archives or archives(pages))
    rows = rows.select("archive", "_id", "_url", F.octet_length("record").cast("long").alias("length"), F.sha2("record", 256).alias("sha"), _record_id(F.col("_id"), F.col("_url")).alias("record_id"))
    rows = rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("archive").orderBy("_id", "_url", "sha").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("first", F.coalesce(F.sum(F.col("length") * F.col("n")).over(before), F.lit(0)))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return rows.select("archive", (F.col("first") + F.col("copy") * F.col("length")).alias("start"), "length", "sha", "record_id")


def write(pages: DataFrame, path: str, *, page_id: str = "page_id", url: str = "url", html: str = "html", n_archives: int | None = None, copies: dict[str, tuple[Column, Column]] | None = None) -> None:
    """Pages as WARC bytes in Parquet rows (archive, start, record), records of an archive in order; see manifest().

    copies: by name, the html that a copy of the archives holds in place of each page's own, and whether it holds the
    page's record at all. They are written in the same pass, so that page bytes are shuffled once, each with its own
    offsets and its records in the order of the pages; column copy tells them apart, `primary` is the pages' own.
    """
    copies = copies or {}
    rows = _placed(pages, page_id, url, html, n_archives or archives(pages), copies).withColumn("_sha", F.sha2("record", 256))
    names = ["primary", *copies]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, at, held, done = None, [], 0, []

        def out() -> pa.RecordBatch:
            columns = zip(*done, strict=True) if done else ([], [], [], [])
            return pa.record_batch([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["copy", "archive", "start", "record"])

        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                archive, data, *others = (x.as_py() for x in row)
                if archive != current:
                    current, at = archive, [0] * len(names)
                pairs = zip(others[::2], others[1::2], strict=True)
                for i, x in enumerate([data, *(data if same else other for same, other in pairs)]):
                    if x is not None:
                        done.append((names[i], archive, at[i], x))
                        at[i] += len(x)
                        held += len(x)
                if held >= BATCH:
                    yield out()
                    held, done = 0, []
        yield out()

    other = [c for i in range(len(copies)) for c in (f"same_{i}", f"other_{i}")]
    rows = rows.repartition("archive").sortWithinPartitions("archive", "_id", "_url", "_sha").select("archive", "record", *other)
    done = rows.mapInArrow(run, "copy string, archive long, start long, record binary")
    to = (done.write.partitionBy("copy") if copies else done.drop("copy").write).mode("overwrite").option("compression", "zstd")
    to.parquet(path)


def stored(spark: SparkSession, path: str, copy: str | None = None) -> DataFrame:
    """(archive, start, length, sha, record_id, url) of what write() left at path, or of one copy of it, read from the
    records' own bytes.

    Bytes that are no whole record fail with their offset.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, lengths = [], [], []
            for start, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                at, n, headers, _ = next(records(io.BytesIO(data), start))
                if at + n != start + len(data):
                    raise ValueError(f"record at offset {start} ends early")
                ids.append(headers.get("warc-record-id"))
                urls.append(headers.get("warc-target-uri"))
                lengths.append(n)
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lengths, pa.int64()), batch.column(3), pa.array(ids, pa.string()), pa.array(urls, pa.string())], ["archive", "start", "length", "sha", "record_id", "url"])

    rows = spark.read.schema("archive long, start long, record binary" + (", copy string" if copy else "")).parquet(path)
    rows = (rows.filter(F.col("copy") == copy).drop("copy") if copy else rows).withColumn("sha", F.sha2("record", 256))
    return rows.mapInArrow(run, "archive long, start long, length long, sha string, record_id string, url string")


def extent(*manifests: DataFrame) -> tuple[int, int]:
    """Bytes of the longest archive and the highest archive number of any of them, on which the shape of a tree depends."""
    ends = [m.agg(F.max(F.col("start") + F.col("length")), F.max("archive")).first() for m in manifests]
    return max(e[0] or 0 for e in ends), max(e[1] or 0 for e in ends)


def tree(leaves: DataFrame, shape: tuple[int, int] | None = None, *, range_bytes: int = RANGE, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels from the root down, each (archive, node, up_archive, up_node, sha), and last the leaves with theirs.

    Levels are as many as shape needs, the extent of the manifest, or of all replicas that are to be compared. An empty
    manifest has an empty root.
    """
    leaves = checkpoint(leaves)
    widest, highest = shape or extent(leaves)
    archives = max(highest, 0) + 2
    levels = [leaves.withColumns({"up_archive": F.col("archive"), "up_node": F.floor(F.col("start") / range_bytes).cast("long")})]
    spans, across = -(-max(widest, 1) // range_bytes), archives
    entry = F.struct("archive", F.col("start").alias("at"), "sha")
    while True:
        below = levels[-1]
        nodes = below.groupBy(F.col("up_archive").alias("archive"), F.col("up_node").alias("node")).agg(F.array_sort(F.collect_list(entry)).alias("c"))
        text = F.transform("c", lambda x: F.concat_ws(":", x["archive"].cast("string"), x["at"].cast("string"), x["sha"]))
        nodes = nodes.select("archive", "node", F.sha2(F.array_join(text, ","), 256).alias("sha"))
        entry = F.struct("archive", F.col("node").alias("at"), "sha")
        if spans > 1:
            spans = -(-spans // fanout)
            up = {"up_archive": F.col("archive"), "up_node": F.floor(F.col("node") / fanout).cast("long")}
        elif across > 1:
            across = -(-across // fanout)
            up = {"up_archive": F.floor((F.col("archive") + (1 if across == -(-archives // fanout) else 0)) / fanout).cast("long"), "up_node": F.lit(0).cast("long")}
        else:
            levels.append(nodes)
            return levels[::-1]
        levels.append(checkpoint(nodes.withColumns(up)))


def audit(primary: list[DataFrame], replica: list[DataFrame]) -> DataFrame:
    """Records in which two trees of the same shape differ: archive, record_id, status, and start, length and sha in
    each of them (start, length, sha_primary; start_replica, length_replica, sha_replica; null where it has none).

    status: altered (other bytes under the same id), missing (only in the primary) or extra (only in the replica).
    A record that lies elsewhere but is unchanged is no row. Of records that share an id, equal ones are matched first,
    the rest in order. Equal trees give no row.
    """
    if len(primary) != len(replica):
        raise ValueError("trees of different shape; build both with the extent of both")
    bad = None
    for p, r in zip(primary[:-1], replica[:-1], strict=True):
        if bad is not None:  # only children of nodes that differ
            p, r = (x.join(bad, (x["up_archive"] == bad["b_archive"]) & (x["up_node"] == bad["b_node"]), "left_semi") for x in (p, r))
        left, right = (x.select("archive", "node", F.col("sha").alias(name)) for x, name in ((p, "sha_primary"), (r, "sha_replica")))
        both = left.join(right, ["archive", "node"], "full").filter(~F.col("sha_primary").eqNullSafe(F.col("sha_replica")))
        bad = checkpoint(both.select(F.col("archive").alias("b_archive"), F.col("node").alias("b_node")))

    def found(x: DataFrame) -> DataFrame:
        x = x.join(bad, (x["up_archive"] == bad["b_archive"]) & (x["up_node"] == bad["b_node"]), "left_semi").select("archive", "record_id", "sha", "start", "length")
        return x.withColumn("k", F.row_number().over(Window.partitionBy("archive", "record_id", "sha").orderBy("start")))

    def unmatched(x: DataFrame, other: DataFrame, side: str) -> DataFrame:
        x = x.join(other, ["archive", "record_id", "sha", "k"], "left_anti")
        x = x.withColumn("k", F.row_number().over(Window.partitionBy("archive", "record_id").orderBy("start")))
        return x.select("archive", "record_id", "k", F.col("start").alias(f"start{side}"), F.col("length").alias(f"length{side}"), F.col("sha").alias("sha_replica" if side else "sha_primary"))

    left, right = checkpoint(found(primary[-1])), checkpoint(found(replica[-1]))
    both = unmatched(left, right, "").join(unmatched(right, left, "_replica"), ["archive", "record_id", "k"], "full")
    status = F.when(F.col("sha_replica").isNull(), "missing").when(F.col("sha_primary").isNull(), "extra").otherwise("altered")
    return both.select("archive", "record_id", status.alias("status"), "start", "length", "sha_primary", "start_replica", "length_replica", "sha_replica")


def compare(primary: DataFrame, replica: DataFrame, **options: int) -> DataFrame:
    """audit() of the trees of two manifests."""
    primary, replica = checkpoint(primary), checkpoint(replica)
    shape = extent(primary, replica)
    return audit(tree(primary, shape, **options), tree(replica, shape, **options))


def records(stream: BinaryIO, offset: int = 0) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """(offset, length, headers by lower-case name, body) of each record of a WARC stream, one in memory at a time."""
    at = offset
    while first := stream.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record at offset {at}")
        headers, size = {}, len(first)
        while (line := stream.readline()) not in (b"\r\n", b""):
            size += len(line)
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k.strip().lower()] = v.strip()
        n = int(headers.get("content-length", -1))
        body, end = stream.read(max(n, 0)), stream.read(4)
        if n < 0 or len(body) < n or end != b"\r\n\r\n":
            raise ValueError(f"record at offset {at} ends early")
        size += len(line) + n + 4
        yield at, size, headers, body
        at += size


def read(spark: SparkSession, path: str) -> DataFrame:
    """(path, start, length, record_id, type, url, body) of the records of WARC files, plain or gzip, by Spark's readers.

    A file is one row of Spark's binary reader and so at most 2 GB; gzip members are unzipped as they are read, and
    batches go on after about BATCH bytes, so that no file's content is held unzipped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["path", "start", "length", "record_id", "type", "url", "body"]
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, held, types = [], 0, [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
                raw = io.BytesIO(data.as_py())
                zipped = raw.getvalue()[:2] == b"\x1f\x8b"
                for at, n, h, body in records(gzip.GzipFile(fileobj=raw) if zipped else raw):
                    rows.append((file, at, n, h.get("warc-record-id"), h.get("warc-type"), h.get("warc-target-uri"), body))
                    held += n
                    if held >= BATCH or len(rows) == 1000:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, "path string, start long, length long, record_id string, type string, url string, body binary")
