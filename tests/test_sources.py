"""Tensor and folder sinks: what comes back, and that a failed write leaves nothing."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.sources import folders, parts, tensors

LINE = "name string, row long, values array<double>"


def files_under(path):
    return [os.path.join(d, n) for d, _, names in os.walk(path) for n in names if not n.endswith(".crc")]


def lines_of(df):
    return sorted((r["name"], r["row"], tuple(r["values"])) for r in df.collect())


@pytest.mark.parametrize("dtype", ["F64", "F32", "I64", "I16"])
def test_tensors_come_back(spark, tmp_path, dtype):
    rng = np.random.default_rng(1)
    rows = [(f"t{t}", i, [float(x) for x in rng.integers(-99, 99, 3 + t)]) for t in range(4) for i in range(7 * t + 1)]
    path = f"file://{tmp_path}/t"
    tensors.write(spark.createDataFrame(rows, LINE).repartition(3), path, dtype=dtype, shard_bytes="200")
    want = sorted((n, i, tuple(v)) for n, i, v in rows)
    for split in ("1", "100", "1000000"):
        assert lines_of(tensors.read(spark, path, split_bytes=split)) == want
    some = tensors.read(spark, path, names="t1,t3")
    assert lines_of(some) == [x for x in want if x[0] in ("t1", "t3")]
    assert {tuple(r["shape"]) for r in some.collect()} == {(8, 4), (22, 6)}


def test_a_long_tensor_is_read_in_many_splits(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tensors.write(spark.range(5000).select(F.lit("w").alias("name"), F.col("id").alias("row"), F.array(*[F.col("id").cast("double")] * 4).alias("values")), path)
    read = tensors.read(spark, path, split_bytes="1600")
    assert read.rdd.getNumPartitions() == 50 and read.select(F.sum(F.col("values")[3])).first()[0] == 5000 * 4999 / 2


def test_append_overwrite_and_empty(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    one = lambda name: spark.createDataFrame([(name, 0, [1.0])], LINE)
    tensors.write(spark.createDataFrame([], LINE), path)
    assert lines_of(tensors.read(spark, path)) == []
    tensors.write(one("a"), path)
    tensors.write(one("b"), path)
    assert [x[0] for x in lines_of(tensors.read(spark, path))] == ["a", "b"]
    tensors.write(one("c"), path, mode="overwrite")
    assert [x[0] for x in lines_of(tensors.read(spark, path))] == ["c"]
    assert len([f for f in files_under(tmp_path) if f.endswith(".tensors")]) == 1


@pytest.mark.parametrize("bad", [("z", 5, None), ("z", 5, [1.0, None]), (None, 5, [1.0]), ("a", 0, [2.0, 2.0])])
def test_a_write_that_fails_midway_leaves_nothing(spark, tmp_path, bad):
    path = f"file://{tmp_path}/t"
    good = [(f"t{i}", 0, [float(i)] * 2) for i in range(40)]
    tensors.write(spark.createDataFrame(good[:1], LINE), path)
    before, kept = files_under(tmp_path), lines_of(tensors.read(spark, path))
    with pytest.raises(Exception, match="null|repeated"):
        tensors.write(spark.createDataFrame([*good, ("a", 0, [1.0, 1.0]), bad], LINE).repartition(4), path, shard_bytes="16")
    assert files_under(tmp_path) == before and lines_of(tensors.read(spark, path)) == kept


def test_files_of_lost_attempts_are_neither_read_nor_kept(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    writer = parts.PartsWriter(path, False, lambda p, part: tensors.Shards(p, part, "F32", 1000))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"name": ["a"], "row": [0], "values": [[1.0, 2.0]]})
    lost, won = writer.write(iter([batch])), writer.write(iter([batch]))
    assert len(files_under(tmp_path)) == 2 and parts.index_of(path) == {}
    writer.commit([won])
    assert list(parts.index_of(path)) == [won.parts[0][0]] and lost.parts[0][0] not in "".join(files_under(tmp_path))
    assert lines_of(tensors.read(spark, path)) == [("a", 0, (1.0, 2.0))]


def test_a_file_that_ends_early_is_an_error(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    tensors.write(spark.createDataFrame([("a", i, [1.0] * 8) for i in range(9)], LINE), path)
    at = next(f for f in files_under(tmp_path) if f.endswith(".tensors"))
    data = open(at, "rb").read()
    open(at, "wb").write(data[:-4])
    with pytest.raises(Exception, match="ends within a"):
        tensors.read(spark, path).collect()


def test_folder_rows_come_back(spark, tmp_path):
    path = f"file://{tmp_path}/f"
    rows = [(f"r {i}", f"text {i}\nü", None if i % 3 else "x") for i in range(20)]
    folders.write_folder_rows(spark.createDataFrame(rows, "id string, q string, a string"), path, "id")
    got = sorted(tuple(r) for r in folders.read_folder_rows(spark, path, ["q", "a"]).collect())
    assert got == sorted((i, q, a or "") for i, q, a in rows)


@pytest.mark.parametrize("bad", ["a/b", "..", None, "r 3"])
def test_folder_rows_fail_whole(spark, tmp_path, bad):
    path = f"file://{tmp_path}/f"
    rows = [(f"r {i}", "q") for i in range(20)] + [(bad, "q")]
    with pytest.raises(Exception, match="folder"):
        folders.write_folder_rows(spark.createDataFrame(rows, "id string, q string"), path, "id")
    assert files_under(tmp_path) == [] and folders.read_folder_rows(spark, path, ["q"]).count() == 0
