"""Reading version feeds and snapshots: JSON and XML files by Spark's readers, HTTP behind a rate limit."""

from __future__ import annotations

import threading
import time
import urllib.request
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolode.functions import text as tx

# The least time between two requests, in seconds, and a feed's fields.
INTERVAL = 0.34
FEED = "content_versions array<struct<identifier:string,date:string,issue_date:string,removed:boolean,substantive:boolean,name:string,part:string>>"


def version_feed(spark: SparkSession, path: str) -> DataFrame:
    """Version records of JSON feeds: (section, effective_from, issue_date, removed, substantive, name, record_id).

    record_id is the record's place in its feed, which breaks ties as the first one seen.
    """
    feeds = spark.read.schema(FEED).option("multiLine", True).json(path)
    rows = feeds.select(F.posexplode("content_versions").alias("record_id", "r"))
    return rows.select(F.col("r.identifier").alias("section"), F.to_date("r.date").alias("effective_from"), F.to_date("r.issue_date").alias("issue_date"), F.coalesce("r.removed", F.lit(False)).alias("removed"), "r.substantive", "r.name", F.col("record_id").cast("long").alias("record_id"))


def snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """(day, xml) of a folder of point-in-time files named <anything>-YYYY-MM-DD.xml, on any store that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").load(folder)
    day = F.to_date(F.regexp_extract("path", r"(\d{4}-\d{2}-\d{2})\.xml$", 1))
    return files.select(day.alias("day"), F.col("content").cast("string").alias("xml"))


class SnapshotCache:
    """Fetches each snapshot once: files are immutable, written under a temporary name and renamed. Requests are
    INTERVAL apart across threads. For the driver, or one task; the folder is what snapshots() reads."""

    def __init__(self, folder: str, fetch: Callable[[str], bytes] | None = None, interval: float = INTERVAL):
        self.folder, self.interval = Path(folder), interval
        self.fetch = fetch or (lambda url: urllib.request.urlopen(url, timeout=60).read())  # noqa: S310
        self._lock, self._last = threading.Lock(), 0.0
        self.folder.mkdir(parents=True, exist_ok=True)

    def _wait(self) -> None:
        with self._lock:
            pause = self._last + self.interval - time.monotonic()
            if pause > 0:
                time.sleep(pause)
            self._last = time.monotonic()

    def get(self, url: str, title: int, part: int, day: str) -> bytes:
        path = self.folder / f"title-{title}-part-{part}-{day}.xml"
        if not path.exists():
            self._wait()
            data = self.fetch(url)
            partial = path.with_suffix(".part")
            partial.write_bytes(data)
            partial.replace(path)
        return path.read_bytes()


def described(chunks: DataFrame) -> DataFrame:
    """Chunks with char_count, token_count and sha of their text."""
    return chunks.withColumns({"char_count": F.length("text"), "token_count": tx.word_count(F.col("text")), "sha": tx.sha256(F.col("text"))})
