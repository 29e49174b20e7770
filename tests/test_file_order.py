"""Order and headers of files, dates of feeds, merged documents."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from quern import schemas as S
from quern.sources import sheets
from quern.sources.file_order import in_file_order


@pytest.fixture(params=[None, 700])
def splits(spark, request):
    """Whole files, and files cut into small splits that tasks read the largest first."""
    if request.param:
        spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
        spark.conf.set("spark.sql.files.openCostInBytes", 10)
    yield request.param
    for k in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{k}")


def write(folder, sizes, line):
    folder.mkdir()
    n = 0
    for k, size in enumerate(sizes):
        (folder / f"f{k}.txt").write_text("".join(line(n + i) + "\n" for i in range(size)))
        n += size
    return n


def test_lines_in_order(spark, splits, tmp_path):
    n = write(tmp_path / "t", [3, 900, 0, 1, 250], lambda i: f"line {i}")
    rows, none = in_file_order(spark.read.text(str(tmp_path / "t")))
    got = sorted((r["ord"], r["value"]) for r in rows.collect())
    assert none is None and got == [(i, f"line {i}") for i in range(n)]


def test_bitext_folders(spark, splits, tmp_path):
    write(tmp_path / "en", [4, 500, 2], lambda i: f"en {i}" if i % 50 else "")
    write(tmp_path / "sw", [300, 1, 203], lambda i: f"sw {i}")
    got = sheets.read_bitext(spark, str(tmp_path / "en"), str(tmp_path / "sw")).collect()
    assert sorted(tuple(r) for r in got) == [(i + 1, f"en {i}", f"sw {i}") for i in range(504) if i % 50]


def test_sheets_come_back_in_order(spark, splits, tmp_path):
    rows = spark.createDataFrame([(f"i{i}", f"a, \"quoted\"\nline {i}" if i % 3 else "", i) for i in range(400)], "PSA_ID string, English string, at int")
    parts = rows.repartitionByRange(5, F.floor(F.log2(F.col("at") + 1))).sortWithinPartitions("at")
    sheets.write_sheet(parts, str(tmp_path / "s"), S.CORPUS)
    back = {r["ord"]: (r["PSA_ID"], r["English"]) for r in sheets.read_sheet(spark, str(tmp_path / "s"), S.CORPUS).collect()}
    assert back == {r["at"]: (r["PSA_ID"], r["English"] or back[r["at"]][1]) for r in rows.collect()} and not back[0][1]


def test_single_line_sheets_in_splits(spark, splits, tmp_path):
    (tmp_path / "b.csv").write_text("English,PSA_ID\n" + "".join(f"text {i},i{i}\n" for i in range(300, 600)))
    (tmp_path / "a.csv").write_text("﻿PSA_ID,x,English,PSA_ID\n" + "".join(f"i{i},no,text {i},later\n" for i in range(300)))
    (tmp_path / "c.csv").write_text("PSA_ID\n")
    got = sheets.read_sheet(spark, str(tmp_path / "*.csv"), S.CORPUS, multi_line=False).collect()
    assert sorted((r["ord"], r["PSA_ID"], r["English"], r["Source"]) for r in got) == [(i, f"i{i}", f"text {i}", None) for i in range(600)]


def test_parallel_sheets_by_their_own_headers(spark, tmp_path):
    (tmp_path / "1_pairs.csv").write_text("pair_id,source_text,target_text\np1,hello,habari\n")
    (tmp_path / "2_pairs.csv").write_text("target_text,Domain,pair_id\nkwaheri,Health,p2\n,,p3\n")
    got = sheets.read_parallel(spark, str(tmp_path / "*_pairs.csv")).collect()
    assert sorted((r["ord"], r["pair_id"], r["source_text"], r["target_text"], r["Domain"], r["_from_file"]) for r in got) == [
        (0, "p1", "hello", "habari", None, "1_pairs.csv"), (1, "p2", None, "kwaheri", "Health", "2_pairs.csv"), (2, "p3", None, None, None, "2_pairs.csv")
    ]


def test_no_sheet_and_empty_files(spark, tmp_path):
    assert sheets.read_sheet(spark, str(tmp_path / "none.csv"), S.CORPUS).count() == 0
    (tmp_path / "e.csv").write_text("")
    assert sheets.read_sheet(spark, str(tmp_path / "e.csv"), S.CORPUS).columns == [*S.CORPUS.names, "ord"]
    assert sheets.read_sheet(spark, str(tmp_path / "e.csv"), S.CORPUS).count() == 0


@pytest.mark.parametrize("text,moment", [
    ("Wed, 02 Oct 2002 13:00:00 GMT", (2002, 10, 2, 13, 0)), ("02 October 02 13:00 EST", (2002, 10, 2, 18, 0)), ("Mon, 5 Jan 2026 10:00:00 +0300", (2026, 1, 5, 7, 0)), (" 5 jan 99 1:02:03 -01:30", (1999, 1, 5, 2, 32, 3)),
    ("2026-01-05T10:00:00Z", (2026, 1, 5, 10, 0)), ("2026-01-05T10:00:00+0300", (2026, 1, 5, 7, 0)), ("2026-01-05", (2026, 1, 5)), ("Wed, 02 Oct 2002 13:00:00 XYZ", (2002, 10, 2, 13, 0)),
    ("31 Foo 2026 10:00", None), ("30 Feb 2026 10:00", None), ("yesterday", None), ("", None), (None, None),
])
def test_dates_of_feeds(spark, text, moment):
    got = spark.createDataFrame([(text,)], "c string").select(sheets.feed_date("c").cast("string")).first()[0]
    assert got == (str(datetime.datetime(*moment)) if moment else None)


def test_feed_with_odd_dates(spark, tmp_path):
    item = "<item><title>T{0}</title><link>u{0}</link><description>one two three four five six seven eight nine ten {0}</description><pubDate>{1}</pubDate></item>"
    dates = ["Wed, 02 Oct 2002 13:00:00 GMT", "not a date", ""]
    (tmp_path / "f.xml").write_text("<rss><channel>" + "".join(item.format(i, dates[i % 3]) for i in range(70)) + "</channel></rss>")
    got = sheets.read_feed(spark, str(tmp_path / "f.xml"), "s").collect()
    assert [r["title"] for r in got] == [f"T{i}" for i in range(50)]
    assert [r["published_at"] for r in got[:3]] == [datetime.datetime(2002, 10, 2, 13, 0), None, None]


def test_merged_documents_keep_their_kinds(spark):
    merge = lambda a, b: spark.range(1).select(sheets.merge_stats(F.lit(a).cast("string"), F.lit(b).cast("string"))).first()[0]
    assert merge('{"a":{"b":1},"c":[1,"x"],"d":1}', '{"d":{"e":null},"f":2.5}') == '{"a":{"b":1},"c":[1,"x"],"d":{"e":null},"f":2.5}'
    assert merge(None, '{"f":true}') == '{"f":true}' and merge("[1", "3") == "{}"
