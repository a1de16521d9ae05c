import pytest

from millrace import SnapshotFolder
from millrace.__main__ import main, record_version
from millrace.plans.spec import flow
from millrace.streaming.increments import stream_flow

DDL = "id INT, v STRING"


def add(spark, path, data):
    spark.createDataFrame(data, DDL).coalesce(1).write.mode("append").parquet(path)


def test_files_arrive(spark, folder, rows):
    left, sink, check = folder(), folder(), folder()
    spec = (flow("f").source("parquet", path=left, schema=DDL).sql("SELECT id, UPPER(v) AS v FROM temp_table")
            .target("parquet", path=sink, mode="merge", merge_keys=["id"]).spec())
    add(spark, left, [(1, "a"), (2, "b")])
    stream_flow(spark, spec, check).awaitTermination()
    add(spark, left, [(2, "c"), (3, "d")])
    stream_flow(spark, spec, check).awaitTermination()
    stream_flow(spark, spec, check).awaitTermination()        # nothing new
    assert rows(SnapshotFolder(spark, sink).read()) == [(1, "A"), (2, "C"), (3, "D")]
    assert SnapshotFolder(spark, sink).snapshot().id == 2


def test_repeated_batches_change_nothing(spark, folder, rows):
    """A lost checkpoint makes every file arrive again; the dimension stays as it is."""
    left, sink = folder(), folder()
    spec = (flow("f").source("parquet", path=left, schema=DDL)
            .target("parquet", path=sink, scd2={"key_columns": ["id"]}).spec())
    add(spark, left, [(1, "a"), (2, "b")])
    stream_flow(spark, spec, folder(), as_of="2024-01-01 00:00:00").awaitTermination()
    before = rows(SnapshotFolder(spark, sink).read())
    stream_flow(spark, spec, folder(), as_of="2024-02-01 00:00:00").awaitTermination()
    assert rows(SnapshotFolder(spark, sink).read()) == before and len(before) == 2


def test_what_cannot_be_streamed(spark):
    with pytest.raises(ValueError, match="can take a batch twice"):
        stream_flow(spark, flow("f").source("parquet", path="p", schema=DDL).target("parquet", path="q").spec(), "c")
    with pytest.raises(ValueError, match="needs a 'schema'"):
        stream_flow(spark, flow("f").source("parquet", path="p").target("parquet", path="q").spec(), "c")


def test_command_line(spark, folder, rows, tmp_path, capsys):
    left, sink, versions = folder(), folder(), folder()
    add(spark, left, [(1, "a")])
    file = tmp_path / "flow.yaml"
    file.write_text(flow("cli").source("parquet", path=left).target("parquet", path=sink).to_yaml())
    for _ in range(2):
        assert main([str(file), "--versions", versions]) == 0
    assert capsys.readouterr().out.count("specification version 1") == 2
    assert rows(spark.read.parquet(sink)) == [(1, "a"), (1, "a")]
    assert record_version(spark, versions, "cli", "changed") == 2
    with pytest.raises(FileNotFoundError):                     # a failing run is not swallowed
        main([str(tmp_path / "missing.yaml")])
