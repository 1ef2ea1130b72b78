import gzip
import io
from collections import Counter

import pytest
from chronolode.llm import warc
from pyspark.sql import functions as F

PAGE = "page_id long, url string, html string, start int, sha string"


def pages(n=3000):
    return [(i, f"http://h/{i}", f"<p>{'x' * (i % 50)}é{i}</p>", 0, "") for i in range(n)]


def brute(left, right):
    """(status, url) of the records that differ, by id and bytes."""
    out = []
    for side, other, name in ((left, right, "missing"), (right, left, "extra")):
        rest = Counter(other)
        for r in side:
            if rest[r]:
                rest[r] -= 1
            else:
                out.append((name, r[0]))
    urls = Counter(u for s, u in out if s == "missing") & Counter(u for s, u in out if s == "extra")
    for u, n in urls.items():
        for _ in range(n):
            out.remove(("missing", u))
            out.remove(("extra", u))
            out.append(("altered", u))
    return sorted(out)


def test_one_fault_is_one_row_wherever_the_rest_lies(spark, tmp_path):
    a = [*pages(), (None, "n", "x", 1, "s"), (None, None, "y", 1, "s"), (None, None, "z", 1, "s"), (7, "http://h/7", "again", 1, "s"), (7, "http://h/7", "again", 1, "s"), (5000, "", "", 0, ""), (9, "copies", "c", 0, ""), (9, "copies", "c", 0, ""), (9, "copies", "c", 0, "")]
    b = [(i, u, {3: h + "longer", 1500: h[:-1], 1501: h.swapcase(), 2999: ""}.get(i, h), s, t) for i, u, h, s, t in a if i not in (2, 2048)]
    b += [(3, "http://new/3", "new", 0, ""), (7, "http://h/7", "other", 1, "s")]
    b.remove((9, "copies", "c", 0, ""))
    n = warc.archives(spark.createDataFrame(a, PAGE))
    sides = []
    for name, rows in (("a", a), ("b", b)):
        df = spark.createDataFrame(rows, PAGE).repartition(3)
        warc.write(df, str(tmp_path / name), n_archives=n)
        sides.append(warc.stored(spark, str(tmp_path / name)))
        assert sides[-1].drop("url").exceptAll(warc.manifest(df, n_archives=n).select("archive", "start", "length", "sha", "record_id")).count() == 0
    assert sides[0].count() == len(a) and n == 3
    names = {r["record_id"]: r["url"] for s in sides for r in s.collect()}
    got = sorted((r["status"], names[r["record_id"]]) for r in warc.compare(*sides).collect())
    want = brute([(u or "", h) for _, u, h, *_ in a], [(u or "", h) for _, u, h, *_ in b])
    assert got == want and len(want) == 9
    assert warc.compare(sides[0], warc.stored(spark, str(tmp_path / "a"))).count() == 0


def test_ids_of_any_type_and_shapes(spark):
    df = spark.createDataFrame(pages(40), PAGE).withColumn("page_id", F.concat(F.lit("p-"), F.col("page_id").cast("string")))
    m = warc.manifest(df, n_archives=4)
    none = warc.manifest(df.limit(0))
    assert m.count() == 40 and none.count() == 0
    assert warc.compare(none, none).count() == 0
    assert {r["status"] for r in warc.compare(none, m).collect()} == {"extra"} and {r["status"] for r in warc.compare(m, none).collect()} == {"missing"}
    with pytest.raises(ValueError):
        warc.audit(warc.tree(m, (10**9, 3)), warc.tree(m))


def test_broken_records_fail_with_their_offset():
    whole = b"WARC/1.1\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    assert [(a, n, b) for a, n, _, b in warc.records(io.BytesIO(whole * 2))] == [(0, len(whole), b"ab"), (len(whole), len(whole), b"ab")]
    for bad in (whole + whole[:-5], whole + b"junk", whole + b"WARC/1.1\r\n\r\n"):
        with pytest.raises(ValueError, match=f"offset {len(whole)}"):
            list(warc.records(io.BytesIO(bad)))


def test_descends_only_mismatching_branches(spark):
    m = warc.manifest(spark.createDataFrame(pages(), PAGE))
    levels = warc.tree(m)
    assert levels[0].count() == 1 and all(a.count() <= b.count() for a, b in zip(levels, levels[1:], strict=False))
    children = levels[-1].groupBy("up_archive", "up_node").count()
    assert children.agg(F.max("count")).first()[0] <= warc.RANGE // 200 + 1


def test_files_round_trip(spark, tmp_path):
    rows = [(1, "http://a/é", "<p>1</p>"), (2, None, None), (3, "u", "WARC/1.1\r\n\r\nx")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(df, str(tmp_path / "w"))
    data = b"".join(bytes(r["record"]) for r in spark.read.parquet(str(tmp_path / "w")).orderBy("archive", "start").collect())
    (tmp_path / "f").mkdir()
    (tmp_path / "f/a.warc").write_bytes(data)
    (tmp_path / "f/b.warc.gz").write_bytes(gzip.compress(data[:200]) * 0 + gzip.compress(data))
    (tmp_path / "f/empty.warc").write_bytes(b"")
    got = warc.read(spark, str(tmp_path / "f")).collect()
    assert sorted((r["url"], bytes(r["body"]).decode()) for r in got) == sorted([("http://a/é", "<p>1</p>"), ("", ""), ("u", "WARC/1.1\r\n\r\nx")] * 2)
    m = {(r["start"], r["length"]) for r in warc.manifest(df).collect()}
    assert {(r["start"], r["length"]) for r in got} == m


def test_batches_end_between_records(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([*pages(300), (7, "http://h/7", "y" * 5000, 0, "")], PAGE)
    monkeypatch.setattr(warc, "BATCH", 700)
    warc.write(df, str(tmp_path / "w"), n_archives=2)
    got = warc.stored(spark, str(tmp_path / "w")).select("archive", "start", "length", "sha", "record_id")
    want = warc.manifest(df, n_archives=2).select(*got.columns)
    assert got.count() == 301 and got.exceptAll(want).count() == 0


def test_copies_are_written_as_if_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BATCH", 900)
    df = spark.createDataFrame([*pages(300), (None, "n", None, 0, ""), (None, None, "z", 0, "")], PAGE)
    other = F.when(F.col("page_id") == 5, "longer " * 40).when(F.col("page_id") == 6, F.lit(None)).otherwise(F.col("html"))
    kept = F.when(F.col("page_id").isNotNull(), F.col("page_id") % 50 != 3).otherwise(True)
    warc.write(df, str(tmp_path / "w"), n_archives=2, copies={"b": (other, kept), "none": (other, F.lit(None).cast("boolean"))})
    for copy, rows in (("primary", df), ("b", df.filter(kept).withColumn("html", other)), ("none", df.limit(0))):
        got = warc.stored(spark, str(tmp_path / "w"), copy).drop("url")
        want = warc.manifest(rows, n_archives=2).select(*got.columns)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0
    warc.write(df.limit(0), str(tmp_path / "e"), copies={"b": (other, kept)})
    assert warc.compare(warc.stored(spark, str(tmp_path / "e"), "primary"), warc.stored(spark, str(tmp_path / "e"), "b")).count() == 0
