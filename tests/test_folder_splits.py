"""Folder rows are listed and read in tasks; the driver sees an index of parts alone."""

from tracewright.sources import folders, parts


def test_folders_are_listed_in_tasks(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/f"
    rows = [(f"{'_.'[i % 2]}r {i}", f"text {i}\n", None if i % 3 else "x") for i in range(300)]
    folders.write_folder_rows(spark.createDataFrame(rows, "id string, q string, a string"), path, "id")
    told = parts.index_of(path)
    assert len(told) <= 16 and sum(t["rows"] for t in told.values()) == 300
    read = folders.read_folder_rows(spark, path, ["q", "a", "none"])
    assert read.inputFiles() == []  # before, each file's name was listed by the driver
    assert sorted(tuple(r) for r in read.collect()) == sorted((i, q, a or "", None) for i, q, a in rows)
    monkeypatch.setattr(folders, "SPLIT_ROWS", 10)
    reader = folders.FolderReader(path, ["q"])
    splits = reader.partitions()
    assert len(splits) >= 30
    assert sorted(f for s in splits for b in reader.read(s) for f in b.column(0).to_pylist()) == sorted(i for i, *_ in rows)
