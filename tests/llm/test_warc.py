"""WARC archives against a plain list of captures, and the merge of their indexes."""

import base64
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from tracewright.llm import dedup, warc

SCHEMA = "page_id long, url string, html string"
WEB = ["http://a.example.com/x", "https://B.example.com/", "http://a.example.com/x?q=1#f", "no scheme at all", None, "", "http://é.example/ü ß", "ftp://h", "http://a.example.com/\r\nWARC-Type: evil"]


def pages_of(n, seed=0):
    rng = random.Random(seed)
    bodies = [None, "", "<p>same</p>", "<p>ü 日本</p>\r\n\r\n", "WARC/1.1\r\n\r\n"] + [f"<p>{i}</p>" * 30 for i in range(n // 3)]
    rows = [(i, rng.choice(WEB), rng.choice(bodies)) for i in range(n)]
    return rows + [(None, "http://z", "<p>same</p>"), (None, None, "alone"), (3, rows[3][1], rows[3][2]), (3, rows[3][1], rows[3][2]), (-5, "http://m", "x" * 300_000)]


def slow(rows):
    groups = {}
    for i, url, html in rows:
        groups.setdefault((html or "").encode(), []).append((i is None, i, url or ""))
    out = []
    for data, found in groups.items():
        found.sort(key=lambda r: (r[0], r[1] or 0, r[2]))
        for k, (_, i, _) in enumerate(found):
            out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if k else "response", found[0][1] if k else None))
    return sorted(out, key=str)


def told(df):
    return sorted(((r["id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()), key=str)


def test_rows_equal_a_plain_list_and_positions_the_order(spark):
    rows = pages_of(150)
    pages = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("payload", F.lit("clash")).withColumn("position", F.lit(1)).withColumn("copy", F.lit(2))
    index, folder = warc.archive(pages, date=F.timestamp_seconds(F.coalesce("page_id", F.lit(0)) + 1000))
    read = warc.read_records(index, folder, payloads=True)
    assert told(read) == slow(rows)
    order = read.orderBy("position").collect()
    assert [r["position"] for r in order] == list(range(len(rows)))
    keys = [(r["url_key"].encode(), max(0, (r["id"] or 0) + 1000), r["id"] is None, r["id"] or 0) for r in order]
    assert keys == sorted(keys)
    bodies = {(i, (h or "").encode()) for i, _, h in rows}
    assert all((r["id"], bytes(r["payload"])) in bodies for r in order if r["record_type"] == "response")


@pytest.mark.parametrize(("run_lines", "fan_in", "piece", "fence"), [(1, 2, 1, 1), (7, 3, 2, 4), (20, 2, 3, 5), (1000, 64, 256, 1024)])
def test_levels_and_pieces_give_the_same_index(spark, monkeypatch, run_lines, fan_in, piece, fence):
    monkeypatch.setattr(warc, "FENCE", fence)
    monkeypatch.setattr(warc, "BUFFER", 50)
    rows = pages_of(40, seed=fan_in)
    pages = spark.createDataFrame(rows, SCHEMA).repartition(3)
    index, folder = warc.archive(pages, archive_bytes=2000, run_lines=run_lines, fan_in=fan_in, piece=piece)
    assert told(warc.read_records(index, folder)) == slow(rows)
    found = index.orderBy("position").collect()
    assert [r["position"] for r in found] == list(range(len(rows)))
    assert [r["url_key"].encode() for r in found] == sorted(r["url_key"].encode() for r in found)


def test_groups_that_arent_broadcast(spark, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST", 1)
    monkeypatch.setattr(dedup, "HOT", 5)
    monkeypatch.setattr(dedup, "HOT_SHARE", 10)
    rows = pages_of(120, seed=4)
    index, folder = warc.archive(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert told(warc.read_records(index, folder)) == slow(rows)


def test_empty(spark):
    index, folder = warc.archive(spark.createDataFrame([], SCHEMA))
    assert index.count() == 0 and warc.read_records(index, folder).count() == 0


def test_archives_are_gzip_members_that_any_reader_opens(spark, tmp_path):
    warc.archive(spark.createDataFrame(pages_of(20), SCHEMA).coalesce(1), folder=f"file://{tmp_path}", archive_bytes=3000)
    names = [n for n in os.listdir(tmp_path) if n.endswith(".warc.gz")]
    assert len(names) > 1
    whole = b"".join(gzip.open(tmp_path / n).read() for n in names)
    assert whole.count(b"WARC-Record-ID: <urn:uuid:") == 25 and b"\r\nWARC-Type: evil" not in whole


def test_damaged_payload_is_an_error(spark, tmp_path):
    index, folder = warc.archive(spark.createDataFrame([(1, "http://a", "abc")], SCHEMA), folder=f"file://{tmp_path}")
    name = next(n for n in os.listdir(tmp_path) if n.endswith(".warc.gz"))
    data = gzip.open(tmp_path / name).read().replace(b"\r\n\r\nabc", b"\r\n\r\nabd")
    packed = gzip.compress(data)
    (tmp_path / name).write_bytes(packed)
    with pytest.raises(Exception, match="isn't that of its digest"):
        warc.read_records(index.withColumn("length", F.lit(len(packed)).cast("long")), folder).collect()


def test_loser_tree_merges_any_number_of_streams():
    rng = random.Random(2)
    for k in range(12):
        runs = [sorted(b"%d" % rng.randrange(50) for _ in range(rng.randrange(9))) for _ in range(k)]
        assert list(warc.loser_tree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)
