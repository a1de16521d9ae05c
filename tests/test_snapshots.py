import pytest
from pyspark.sql import functions as F

from millrace import SnapshotFolder, staged_overwrite
from millrace.sinks import snapshots
from millrace.sinks.snapshots import part_keys

DDL = "id INT, kind STRING, v INT"


def frame(spark, data):
    return spark.createDataFrame(data, DDL)


def test_nothing_yet(spark, folder):
    assert SnapshotFolder(spark, folder()).read() is None


def test_overwrite_what_is_being_read(spark, folder, rows):
    path = folder()
    first = staged_overwrite(spark, path, frame(spark, [(1, "a", 1), (2, "b", 2)]))
    second = staged_overwrite(spark, path, first.withColumn("v", F.col("v") * 10))
    assert rows(second) == [(1, "a", 10), (2, "b", 20)]
    assert rows(first) == [(1, "a", 1), (2, "b", 2)]      # a reader of the old state is not disturbed


def test_a_load_that_dies_changes_nothing(spark, folder, rows, monkeypatch):
    path = folder()
    staged_overwrite(spark, path, frame(spark, [(1, "a", 1)]))

    def die(self, state):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(snapshots.SnapshotFolder, "_publish", die)
        with pytest.raises(RuntimeError, match="lost"):
            staged_overwrite(spark, path, frame(spark, [(9, "z", 9)]))
    assert rows(SnapshotFolder(spark, path).read()) == [(1, "a", 1)]
    assert rows(staged_overwrite(spark, path, frame(spark, [(2, "b", 2)]))) == [(2, "b", 2)]


def test_replace_some_partitions(spark, folder, rows):
    target = SnapshotFolder(spark, folder())
    target.commit(frame(spark, [(1, "a", 1), (2, "b", 2), (3, None, 3), (4, "x/y %", 4)]), partition_by=["kind"])
    news = frame(spark, [(5, "b", 5), (6, None, 6), (7, "new", 7)])
    after = target.commit(news, partition_by=["kind"], replace=part_keys(news, ["kind"]))
    assert rows(target.read()) == sorted(
        [(1, "a", 1), (4, "x/y %", 4), (5, "b", 5), (6, None, 6), (7, "new", 7)], key=repr)
    assert target.read().columns == ["id", "kind", "v"]
    assert rows(target.read(part_keys(news, ["kind"]), after)) == sorted(
        [(5, "b", 5), (6, None, 6), (7, "new", 7)], key=repr)
    assert target.retired_folders().count() == 2            # the first 'b' and NULL folders
    names = {f.split("/")[0] for f in after.folders}
    assert len(names) == 2                                  # two loads are live side by side


def test_partition_values_keep_their_type(spark, folder, rows):
    df = spark.sql("SELECT 1 AS id, '007' AS code, DATE '2024-02-03' AS d, TIMESTAMP_NTZ '2024-02-03 04:05:06' AS t, true AS f")
    out = staged_overwrite(spark, folder(), df, partition_by=["code", "d", "t", "f"])
    assert out.dtypes == df.dtypes and rows(out) == rows(df)


def test_layout_must_stay(spark, folder):
    target = SnapshotFolder(spark, folder())
    target.commit(frame(spark, [(1, "a", 1)]), partition_by=["kind"])
    with pytest.raises(ValueError, match="cannot be replaced"):
        target.commit(frame(spark, []), replace=())


def test_two_writers(spark, folder):
    path = folder()
    target = SnapshotFolder(spark, path)
    before = target.commit(frame(spark, [(1, "a", 1)]))
    target.commit(frame(spark, [(2, "b", 2)]), at=before)
    with pytest.raises(RuntimeError, match="another load was committed"):
        target.commit(frame(spark, [(3, "c", 3)]), at=before)


def test_empty_and_csv(spark, folder, rows):
    target = SnapshotFolder(spark, folder())
    target.commit(frame(spark, []), partition_by=["kind"])
    assert rows(target.read()) == [] and target.read().columns == ["id", "kind", "v"]
    out = staged_overwrite(spark, folder(), frame(spark, [(1, "a;b", 1)]), format="CSV", options={"header": True, "sep": ";"})
    assert rows(out) == [(1, "a;b", 1)]


def test_compaction_keeps_the_rows(spark, folder, rows):
    target = SnapshotFolder(spark, folder())
    target.commit(frame(spark, [(1, "a", 1), (2, "b", 2)]), partition_by=["kind"])
    for n in range(3, 6):
        target.commit(frame(spark, [(n, "a", n)]), partition_by=["kind"], replace=())
    before = rows(target.read())
    assert len(target.snapshot().folders) == 5
    after = target.compact(part_keys(frame(spark, [(0, "a", 0)]), ["kind"]))
    assert len(after.folders) == 2 and rows(target.read()) == before
    flat = SnapshotFolder(spark, folder())
    flat.commit(frame(spark, [(1, "a", 1)]))
    flat.commit(frame(spark, [(2, "b", 2)]), replace=())
    assert len(flat.compact().folders) == 1 and rows(flat.read()) == [(1, "a", 1), (2, "b", 2)]


def test_commits_write_what_changed(spark, folder, rows):
    """Twelve appends: every listing but each tenth is one row long, and readers see all rows."""
    target = SnapshotFolder(spark, folder())
    for n in range(12):
        state = target.commit(frame(spark, [(n, "a", n)]), replace=())
    assert rows(target.read(), "id") == sorted([(n,) for n in range(12)], key=repr) and state.id == 12
    assert len(state.listings) == 2                              # the full one at commit 11, and one delta
    sizes = [spark.read.parquet(f"{target.path}/_listings/{name}").count() for name in sorted(target._names(f"{target.path}/_listings"))]
    assert sizes == [1] * 10 + [11, 1]
    assert target.orphans() == [] and target.retired_folders().count() == 0


def test_drops_and_full_listings(spark, folder, rows, monkeypatch):
    """Replaced partitions stay replaced over deltas and full listings alike, whatever their sequence."""
    for every in (1, 2, 10):
        monkeypatch.setattr(snapshots, "FULL_EVERY", every)
        target = SnapshotFolder(spark, folder())
        want = {}
        for n in range(7):
            kinds = ["abc"[n % 3], "abc"[(n * 2 + 1) % 3], None][: 2 + n % 2]
            news = frame(spark, [(10 * n + k, kind, n) for k, kind in enumerate(kinds)])
            parts = part_keys(news, ["kind"]) if n else None
            target.commit(news, partition_by=["kind"], replace=parts)
            want = {kind: v for kind, v in want.items() if kind not in kinds}
            for k, kind in enumerate(kinds):
                want.setdefault(kind, []).append((10 * n + k, kind, n))
        assert rows(target.read()) == sorted((r for rs in want.values() for r in rs), key=repr)


def test_racing_writers_lose_nothing(spark, folder, rows):
    """Both write their rows before either commits; the second commit finds its number taken."""
    path = folder()
    target = SnapshotFolder(spark, path)
    before = target.commit(frame(spark, [(1, "a", 1)]))
    publish, waiting = SnapshotFolder._publish, []
    slow = SnapshotFolder(spark, path)
    slow._publish = waiting.append
    slow.commit(frame(spark, [(2, "slow", 2)]), replace=(), at=before)
    target.commit(frame(spark, [(3, "quick", 3)]), replace=(), at=before)
    with pytest.raises(RuntimeError, match="another load was committed"):
        publish(slow, waiting[0])
    assert rows(target.read()) == [(1, "a", 1), (3, "quick", 3)]
    assert len(target.orphans()) == 1
    target.commit(frame(spark, [(2, "slow", 2)]), replace=())
    assert rows(target.read(), "id") == [(1,), (2,), (3,)]


def test_a_lost_or_stale_hint_is_no_loss(spark, folder, rows):
    target = SnapshotFolder(spark, folder())
    for n in range(3):
        target.commit(frame(spark, [(n, "a", n)]), replace=())
    for text in ("1", "not a number", "77"):
        target._write(f"{target.path}/_commits/_newest", text)
        assert target.snapshot().id == 3


def test_buckets_spread_keys_and_leave_null_ones_alone(spark, folder, rows):
    target = SnapshotFolder(spark, folder())
    buckets = snapshots.Buckets(("id",), 4)
    data = [(n if n % 3 else None, "k", n) for n in range(30)]
    state = target.commit(frame(spark, data), buckets=buckets)
    assert rows(target.read()) == sorted(data, key=repr) and target.read().columns == ["id", "kind", "v"]
    assert {f.split("/")[1] for f in state.folders} == {f"__bucket={k}" for k in (-1, 0, 1, 2, 3)}
    news = frame(spark, [(7, "new", 0), (None, "loose", 0)])
    assert len(buckets.reached(news, state.schema)) == 1
    assert buckets.reached(news.withColumn("id", F.col("id").cast("string")), state.schema) == buckets.reached(news, state.schema)
    with pytest.raises(ValueError, match="cannot be replaced"):
        target.commit(news, replace=())
    with pytest.raises(ValueError, match="positive"):
        snapshots.Buckets(("id",), 0)
