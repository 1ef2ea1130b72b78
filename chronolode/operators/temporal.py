"""Bitemporal operators: as-of reads, version timelines, interval joins.

A version is valid in [effective_from, effective_to), an open end is null; it is known from recorded_at until
superseded_at. The temporal predicate always comes before scoring and limiting.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

When = dt.date | dt.datetime | str
#: Days of a bucket in which overlapping versions meet.
BUCKET = 64


def contains(day: Column, start: Column, end: Column) -> Column:
    """Whether a half-open interval holds a day."""
    return (start <= day) & (end.isNull() | (day < end))


def _date(x: When | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x).cast("date") if not isinstance(x, dt.datetime) else F.lit(x)


def as_of(valid_on: When | Column, known_at: When | Column | None = None, document: str | None = None) -> Column:
    """Versions in force on a day, as known now or at another time, that are not removals; of one document or all."""
    p = contains(_date(valid_on), F.col("effective_from"), F.col("effective_to")) & ~F.col("removed")
    if known_at is None:
        p &= F.col("superseded_at").isNull()
    else:
        k = _date(known_at)
        p &= (F.col("recorded_at") <= k) & (F.col("superseded_at").isNull() | (F.col("superseded_at") > k))
    return p if document is None else (F.col("document_id") == document) & p


def chunks_as_of(versions: DataFrame, chunks: DataFrame, valid_on: When, *, known_at: When | None = None, document: str | None = None, prefix: str | None = None, limit: int | None = None) -> DataFrame:
    """Chunks of the versions in force, by section and ordinal. prefix is a LIKE pattern's beginning, wildcards and
    all; no limit for None and 0. The version filter runs before the join; only ids and texts of its chunks are read."""
    live = versions.filter(as_of(valid_on, known_at, document)).select("version_id", "section", "effective_from", "effective_to")
    out = chunks if prefix is None else chunks.filter(F.col("citation_path").like(f"{prefix}%"))
    out = out.join(live, "version_id").orderBy("section", "ordinal", "id")
    return out.limit(limit) if limit else out


def admissible_ids(versions: DataFrame, chunks: DataFrame, valid_on: When, **kw) -> DataFrame:
    """Ids that every retriever may return as of a date."""
    return chunks_as_of(versions, chunks, valid_on, **kw).select("id")


def count_as_of(versions: DataFrame, chunks: DataFrame, valid_on: When, **kw) -> DataFrame:
    return chunks_as_of(versions, chunks, valid_on, **kw).agg(F.count(F.lit(1)).alias("n"))


def first_issued(records: DataFrame) -> DataFrame:
    """Of records of the same section and effective_from the one issued first; equal ones by the rest of the row."""
    w = Window.partitionBy("section", "effective_from").orderBy("issue_date", "record_id")
    return records.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def timeline(records: DataFrame) -> DataFrame:
    """Closes each version at its section's next one; the last stays open, removals stay as versions."""
    return first_issued(records).withColumn("effective_to", F.lead("effective_from").over(Window.partitionBy("section").orderBy("effective_from")))


def covering(points: DataFrame, versions: DataFrame, day: str = "day") -> DataFrame:
    """Left interval join: each (section, day) with the version that covers it, nulls where none does.

    An equi-join on section with the interval as its condition. AQE splits a section that holds too many rows.
    """
    v = versions.select(F.col("section").alias("v_section"), F.col("effective_from").alias("v_from"), F.col("effective_to").alias("v_to"), F.col("record_id").alias("version"))
    return points.join(v, (F.col("section") == F.col("v_section")) & contains(F.col(day), F.col("v_from"), F.col("v_to")), "left").drop("v_section")


def overlaps(versions: DataFrame) -> DataFrame:
    """Pairs of versions of a section that share a day, both known now: none in a sound store.

    In order of start, a version overlaps an earlier one exactly if it starts before some earlier one ends; only rows
    with such a conflict enter the join that names the pairs. There the other version stands once in each bucket of
    days that it covers, up to the last start in conflict, and meets only the starts in that bucket.
    """
    far = F.coalesce("effective_to", F.lit(dt.date(9999, 12, 31)))
    live = versions.filter(F.col("superseded_at").isNull()).select("section", "version_id", "effective_from", far.alias("until"))
    before = Window.partitionBy("section").orderBy("effective_from", "version_id")
    reach = F.max("until").over(before.rowsBetween(Window.unboundedPreceding, -1))
    late = live.withColumn("reach", reach).filter(F.col("effective_from") < F.col("reach"))
    last = F.lit(late.agg(F.max("effective_from")).first()[0]).cast("date")
    bucket = lambda day: F.floor(F.unix_date(day) / BUCKET)
    early = live.join(late.select("section").distinct(), "section", "left_semi").filter((F.col("effective_from") <= last) & (F.col("until") > F.col("effective_from")))
    covered = F.sequence(bucket(F.col("effective_from")), bucket(F.least(F.date_sub("until", 1), last)))
    early = early.select("section", F.col("version_id").alias("a"), F.col("effective_from").alias("a_from"), F.col("until").alias("a_to"), F.explode(covered).alias("bucket"))
    first = (F.col("a_from") < F.col("effective_from")) | ((F.col("a_from") == F.col("effective_from")) & (F.col("a") < F.col("version_id")))
    return late.withColumn("bucket", bucket(F.col("effective_from"))).join(early, ["section", "bucket"]).filter(first & (F.col("a_to") > F.col("effective_from"))).select("section", "a", F.col("version_id").alias("b"))


def amendments_between(pairs: DataFrame, versions: DataFrame, a: str, b: str) -> DataFrame:
    """Adds how many distinct effective dates lie strictly between two dates. The dates, at most one a day, are a literal."""
    days = [r[0] for r in versions.select("effective_from").distinct().orderBy("effective_from").collect()]
    dates = F.array(*[F.lit(d) for d in days]) if days else F.array().cast("array<date>")
    lo, hi = F.least(a, b), F.greatest(a, b)
    return pairs.withColumn("amendments", F.size(F.filter(dates, lambda d: (d > lo) & (d < hi))))


def horizon(versions: DataFrame) -> DataFrame:
    """Extent of the corpus in valid time."""
    return versions.agg(F.count(F.lit(1)).alias("versions"), F.countDistinct("section").alias("sections"), F.countDistinct("effective_from").alias("dates"), F.min("effective_from").alias("since"), F.max("effective_from").alias("latest"))


def compare_dates(cited: DataFrame, *, as_of: When, since: When, limit: int = 3) -> DataFrame:
    """Dates on which a cited provision read otherwise, newest first: the day before it began, and the day it ended."""
    began = F.when(F.col("effective_from") > _date(since), F.greatest(F.date_sub("effective_from", 1), _date(since)))
    days = cited.select(F.explode(F.array(began, F.col("effective_to"))).alias("day")).filter(F.col("day").isNotNull() & (F.col("day") != _date(as_of)))
    return days.distinct().orderBy(F.desc("day")).limit(limit)


def selectivity(admissible: DataFrame, corpus: DataFrame) -> DataFrame:
    """Admissible ids, corpus size and their ratio, 0 for an empty corpus; in one pass over each."""
    both = admissible.select(F.lit(1).alias("a"), F.lit(0).alias("c")).unionAll(corpus.select(F.lit(0).alias("a"), F.lit(1).alias("c")))
    t = both.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("admissible"), F.coalesce(F.sum("c"), F.lit(0)).alias("corpus"))
    return t.withColumn("selectivity", F.when(F.col("corpus") > 0, F.col("admissible") / F.col("corpus")).otherwise(0.0))
