from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace import Scd2Config, closed_rows, current_rows, scd2_changes, scd2_init, scd2_merge

CFG = Scd2Config(keys=("k",), time_type="timestamp_ntz")
DDL = ("k INT, v STRING, valid_from TIMESTAMP_NTZ, valid_to TIMESTAMP_NTZ, is_current BOOLEAN, version INT")
T0, T1, T2, T3 = (datetime(2020 + i, 1, 1) for i in range(4))
BOTH = pytest.mark.parametrize("broadcast", [False, True])


def dim(spark, data):
    return spark.createDataFrame(data, DDL)


def src(spark, data, ddl="k INT, v STRING"):
    return spark.createDataFrame(data, ddl)


def loaded(target, source, now):
    """Brute force type 2 load."""
    out, matched = [], set()
    news = {k: v for k, v in source if k is not None}
    for k, v, start, end, is_open, n in target:
        if is_open and k in news:
            matched.add(k)
            if news[k] != v:
                out += [(k, v, start, now, False, n), (k, news[k], now, None, True, n + 1)]
                continue
        out.append((k, v, start, end, is_open, n))
    for k, v in source:
        if k is None or k not in matched:
            old = max((r[5] for r in target if r[0] == k and k is not None), default=0)
            out.append((k, v, now, None, True, old + 1))
    return sorted(out, key=repr)


CASES = {
    "every kind of row": (
        [(1, "a", T0, None, True, 1), (2, "b", T1, None, True, 2), (2, "x", T0, T1, False, 1),
         (3, "c", T0, None, True, 1), (4, "d", T0, T1, False, 1), (None, "n", T0, None, True, 1)],
        [(1, "A"), (2, "b"), (4, "D"), (5, "e"), (None, "m")]),
    "value to NULL and back": (
        [(1, "a", T0, None, True, 1), (2, None, T0, None, True, 1), (3, None, T0, None, True, 1)],
        [(1, None), (2, "b"), (3, None)]),
    "case matters": ([(1, "a", T0, None, True, 1)], [(1, "A")]),
    "empty source": ([(1, "a", T0, None, True, 1)], []),
    "empty target": ([], [(1, "a"), (None, "b")]),
    "only closed rows": ([(1, "a", T0, T1, False, 1), (1, "b", T1, T2, False, 2)], [(1, "b")]),
}


@BOTH
@pytest.mark.parametrize("case", CASES)
def test_load(spark, rows, case, broadcast):
    target, source = CASES[case]
    out = scd2_merge(dim(spark, target), src(spark, source), CFG, T3, broadcast_source=broadcast)
    assert rows(out) == loaded(target, source, T3)


@BOTH
@pytest.mark.parametrize("case", CASES)
def test_changes_are_the_difference(spark, rows, case, broadcast):
    target, source = CASES[case]
    out = scd2_changes(dim(spark, target), src(spark, source), CFG, T3, broadcast_source=broadcast)
    assert rows(out) == sorted(set(loaded(target, source, T3)) - set(target), key=repr)


@BOTH
def test_unchanged_load_is_a_no_op(spark, rows, broadcast):
    target, source = CASES["every kind of row"]
    source = [s for s in source if s[0] is not None]
    once = scd2_merge(dim(spark, target), src(spark, source), CFG, T2, broadcast_source=broadcast)
    twice = scd2_merge(once, src(spark, source), CFG, T3, broadcast_source=broadcast)
    assert rows(twice) == rows(once)


loads = st.lists(st.dictionaries(st.integers(0, 4), st.sampled_from([None, "a", "b"]), max_size=4),
                 min_size=2, max_size=3)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(loads=loads)
def test_laws(spark, rows, loads):
    """One open row per key, versions counted from 1, no gap and no overlap between them."""
    state, expected = dim(spark, []), []
    for n, load in enumerate(loads):
        now = datetime(2020 + n, 1, 1)
        state = scd2_merge(state, src(spark, list(load.items())), CFG, now, broadcast_source=n % 2 == 1)
        state = spark.createDataFrame(state.collect(), DDL)
        expected = loaded(expected, list(load.items()), now)
    found = rows(state)
    assert found == expected
    for key in {r[0] for r in found}:
        mine = sorted((r for r in found if r[0] == key), key=lambda r: r[5])
        assert [r[5] for r in mine] == list(range(1, len(mine) + 1))
        assert [r[4] for r in mine] == [False] * (len(mine) - 1) + [True]
        assert all(a[3] == b[2] for a, b in zip(mine, mine[1:]))


def test_first_load(spark, rows):
    out = scd2_init(src(spark, [(1, "a"), (None, "b"), (None, "b")]), CFG, T0)
    assert out.columns == ["k", "v", "valid_from", "valid_to", "is_current", "version"]
    assert rows(out) == [(1, "a", T0, None, True, 1), (None, "b", T0, None, True, 1), (None, "b", T0, None, True, 1)]
    assert dict(out.dtypes)["version"] == "int" and dict(out.dtypes)["valid_to"] == "timestamp_ntz"
    assert rows(scd2_merge(dim(spark, []), src(spark, [(1, "a")]), CFG, T0)) == [(1, "a", T0, None, True, 1)]


def test_extra_and_missing_columns(spark, rows):
    target = spark.createDataFrame([(1, "a", "kept", T0, None, True, 1)], DDL.replace("v STRING,", "v STRING, own STRING,"))
    source = src(spark, [(1, "b", 5), (2, "c", 6)], "k INT, v STRING, only_here INT")
    for broadcast in (False, True):
        out = scd2_merge(target, source, CFG, T1, broadcast_source=broadcast)
        assert out.columns == target.columns
        assert rows(out) == sorted([(1, "a", "kept", T0, T1, False, 1), (1, "b", "kept", T1, None, True, 2),
                                    (2, "c", None, T1, None, True, 1)], key=repr)


def test_tracked_columns(spark, rows):
    ddl = DDL.replace("v STRING,", "v STRING, w STRING,")
    target = spark.createDataFrame([(1, "a", "x", T0, None, True, 1), (2, "a", "x", T0, None, True, 1)], ddl)
    source = src(spark, [(1, "a", "y"), (2, "b", "y")], "k INT, v STRING, w STRING")
    cfg = Scd2Config(keys="k", track=("v",), time_type="timestamp_ntz")
    assert rows(scd2_merge(target, source, cfg, T1)) == sorted([
        (1, "a", "x", T0, None, True, 1), (2, "a", "x", T0, T1, False, 1), (2, "b", "y", T1, None, True, 2)], key=repr)


@BOTH
def test_repeated_source_keys(spark, rows, broadcast):
    source = src(spark, [(1, "a", 1), (1, "b", 2)], "k INT, v STRING, at INT")
    with pytest.raises(Exception, match="repeated key in scd2 source: k=1"):
        scd2_merge(dim(spark, []), source, CFG, T0, broadcast_source=broadcast).collect()
    cfg = Scd2Config(keys="k", order_by=["at"], time_type="timestamp_ntz")
    assert rows(scd2_merge(dim(spark, []), source, cfg, T0, broadcast_source=broadcast)) == [(1, "b", T0, None, True, 1)]


@BOTH
def test_two_open_rows_of_a_key(spark, broadcast):
    target = dim(spark, [(1, "a", T0, None, True, 1), (1, "b", T0, None, True, 2)])
    with pytest.raises(Exception, match="repeated key in open rows of the scd2 target"):
        scd2_merge(target, src(spark, [(1, "c")]), CFG, T1, broadcast_source=broadcast, check_target=True).collect()


def test_composite_key_and_own_names(spark, rows):
    cfg = Scd2Config.from_mapping({"enabled": True, "key_columns": ["a", "b"], "effective_date_column": "f",
                                   "end_date_column": "t", "current_flag_column": "c", "version_column": "n"})
    ddl = "a INT, b INT, v INT, f TIMESTAMP_NTZ, t TIMESTAMP_NTZ, c BOOLEAN, n INT"
    target = spark.createDataFrame([(1, 1, 5, T0, None, True, 1), (1, 2, 5, T0, None, True, 1)], ddl)
    out = scd2_merge(target, src(spark, [(1, 2, 6), (2, 1, 7)], "a INT, b INT, v INT"), cfg, T1)
    assert rows(out) == sorted([(1, 1, 5, T0, None, True, 1), (1, 2, 5, T0, T1, False, 1),
                                (1, 2, 6, T1, None, True, 2), (2, 1, 7, T1, None, True, 1)], key=repr)


def test_switch_and_errors(spark):
    assert Scd2Config.from_mapping({"key_columns": ["k"]}) is None
    assert Scd2Config.from_mapping(None) is None
    with pytest.raises(ValueError, match="at least one key"):
        Scd2Config.from_mapping({"enabled": True})
    with pytest.raises(ValueError, match="scd2 target has no column version"):
        scd2_merge(dim(spark, []).drop("version"), src(spark, []), CFG, T0)
    with pytest.raises(ValueError, match="holds a map"):
        target = scd2_init(spark.sql("SELECT 1 AS k, map('a', 1) AS m"), CFG, T0)
        scd2_merge(target, spark.sql("SELECT 1 AS k, map('a', 1) AS m"), CFG, T1)


def test_map_as_untracked_payload(spark):
    cfg = Scd2Config(keys="k", track=("v",), time_type="timestamp_ntz")
    target = scd2_init(spark.sql("SELECT 1 AS k, 'a' AS v, map('a', 1) AS m"), cfg, T0)
    out = scd2_merge(target, spark.sql("SELECT 1 AS k, 'b' AS v, map('b', 2) AS m"), cfg, T1)
    assert {r["version"]: r["m"] for r in out.collect()} == {1: {"a": 1}, 2: {"b": 2}}


def test_one_hot_key_in_history(spark, rows):
    """A third of the dimension is one key's closed history: it never meets a join as rows."""
    hot = spark.range(1, 3001).select(
        F.lit(7).alias("k"), F.col("id").cast("string").alias("v"), F.lit(T0).cast("timestamp_ntz").alias("valid_from"),
        F.lit(T1).cast("timestamp_ntz").alias("valid_to"), F.lit(False).alias("is_current"), F.col("id").cast("int").alias("version"))
    rest = scd2_init(spark.range(1000, 7000).select(F.col("id").cast("int").alias("k"), F.lit("v").alias("v")), CFG, T0)
    target = hot.unionByName(rest)
    for broadcast in (False, True):
        out = scd2_merge(target, src(spark, [(7, "back")]), CFG, T2, broadcast_source=broadcast)
        assert out.count() == 9001
        assert rows(current_rows(out, CFG).filter("k = 7")) == [(7, "back", T2, None, True, 3001)]
        assert closed_rows(out, CFG).count() == 3000
    plan = scd2_merge(target, src(spark, [(7, "back")]), CFG, T2)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max(version" in plan


def test_plans(spark, folder):
    path, new = folder(), folder()
    dim(spark, CASES["every kind of row"][0]).write.partitionBy("is_current").parquet(path)
    src(spark, [(1, "z")]).write.parquet(new)
    source = spark.read.parquet(new)
    with pytest.raises(ValueError, match="must be boolean"):
        scd2_merge(spark.read.parquet(path), source, CFG, T3)
    target = spark.read.schema(DDL).parquet(path)
    plan = scd2_merge(target, source, CFG, T3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FullOuter") == 1 and "Python" not in plan and "CartesianProduct" not in plan
    assert "PartitionFilters: [isnotnull(is_current" in plan
    small = scd2_merge(target, source, CFG, T3, broadcast_source=True)._jdf.queryExecution().executedPlan().toString()
    assert "FullOuter" not in small and "BroadcastHashJoin" in small


@BOTH
def test_open_row_without_a_version(spark, rows, broadcast):
    target = dim(spark, [(1, "a", T0, None, True, None), (1, "z", T0, T0, False, 7)])
    out = scd2_merge(target, src(spark, [(1, "b")]), CFG, T1, broadcast_source=broadcast, check_target=True)
    assert rows(current_rows(out, CFG), "v", "version") == [("b", 1)]


@BOTH
def test_repeated_open_rows_fail_for_loaded_keys_only(spark, rows, broadcast):
    target = dim(spark, [(1, "a", T0, None, True, 1), (1, "b", T0, None, True, 2), (2, "c", T0, None, True, 1)])
    out = scd2_merge(target, src(spark, [(2, "d")]), CFG, T1, broadcast_source=broadcast, check_target=True)
    assert out.count() == 4
    with pytest.raises(Exception, match="repeated key in open rows"):
        scd2_merge(target, src(spark, [(1, "d")]), CFG, T1, broadcast_source=broadcast, check_target=True).collect()


@BOTH
@pytest.mark.parametrize("moment", [T0, T1])
def test_as_of_must_lie_after_what_it_closes(spark, rows, broadcast, moment):
    target = dim(spark, [(1, "a", T1, None, True, 1), (2, "b", T1, None, True, 1)])
    with pytest.raises(Exception, match="as_of is not after"):
        scd2_merge(target, src(spark, [(1, "x"), (2, "b")]), CFG, moment, broadcast_source=broadcast).collect()
    same = scd2_merge(target, src(spark, [(1, "a"), (3, "new")]), CFG, moment, broadcast_source=broadcast)
    assert rows(same) == sorted([tuple(r) for r in target.collect()] + [(3, "new", moment, None, True, 1)], key=repr)


# -- loads dated inside history, and full sources ----------------------------------------------------

LATE = Scd2Config(keys=("k",), time_type="timestamp_ntz", backdated=True)


def in_order(loads):
    """Versions after loads (moment, {key: value}) in the order of their dates."""
    out = {}
    for at, news in sorted(loads, key=lambda x: x[0]):
        for k, v in news.items():
            versions = out.setdefault(k, [])
            if not versions or versions[-1][1] != v:
                if versions:
                    versions[-1][3:5] = [at, False]
                versions.append([k, v, at, None, True, len(versions) + 1])
    return sorted((tuple(r) for rs in out.values() for r in rs), key=repr)


@BOTH
def test_loads_in_any_order(spark, rows, broadcast):
    import random

    from millrace import scd2_backdated

    loads = [(datetime(2020 + n, 1, 1), {k: "ab"[(n * k // 2 + k) % 2] for k in range(1, 6) if (n + k) % 3}) for n in range(6)]
    for seed in range(2):
        shuffled = random.Random(seed).sample(loads, len(loads))
        target = None
        for at, news in shuffled:
            source = src(spark, list(news.items()))
            now = scd2_init(source, LATE, at) if target is None else scd2_backdated(target, source, LATE, at, broadcast_source=broadcast)
            target = spark.createDataFrame(now.collect(), now.schema)       # a short plan
        assert rows(target.drop("confirmed_at")) == in_order(loads)
        again = scd2_backdated(target, src(spark, list(loads[3][1].items())), LATE, loads[3][0])
        assert rows(again) == rows(target)                                  # a load that is repeated changes nothing


def test_backdated_edges(spark, rows):
    from millrace import scd2_backdated

    ddl = DDL + ", confirmed_at ARRAY<TIMESTAMP_NTZ>, own STRING"
    target = spark.createDataFrame([(1, "a", T0, T2, False, 1, [], "kept"), (2, "z", T0, None, True, 1, [], "other"), (None, "n", T0, None, True, 1, [], None)], ddl)
    assert rows(scd2_backdated(target, src(spark, []), LATE, T1)) == rows(target)
    # Inside a version that ended: both halves end, the second where the whole did; a column of the target's own goes along.
    cut = scd2_backdated(target, src(spark, [(1, "b"), (None, "m")]), LATE, T1)
    assert rows(cut, *DDL.replace(",", "").split()[::2], "own") == sorted([
        (1, "a", T0, T1, False, 1, "kept"), (1, "b", T1, T2, False, 2, "kept"), (2, "z", T0, None, True, 1, "other"), (None, "n", T0, None, True, 1, None),
        (None, "m", T1, None, True, 1, None)], key=repr)
    # After the end the key opens again with the next number, and right at the end, too.
    for at in (T2, T3):
        again = scd2_backdated(target, src(spark, [(1, "a")]), LATE, at)
        assert rows(again.filter("k = 1"), "v", "valid_from", "valid_to", "version") == [("a", T0, T2, 1), ("a", at, None, 2)]
    with pytest.raises(Exception, match="two states of one key"):
        scd2_backdated(target, src(spark, [(1, "b")]), LATE, T0).collect()
    with pytest.raises(ValueError, match="no column confirmed_at"):
        scd2_backdated(target.drop("confirmed_at"), src(spark, []), LATE, T1)


@BOTH
def test_full_sources_close_what_they_lack(spark, rows, broadcast):
    full = Scd2Config(keys=("k",), time_type="timestamp_ntz", deletes="close")
    target = dim(spark, [(1, "a", T0, None, True, 1), (2, "b", T0, None, True, 1), (3, "c", T0, T1, False, 1), (None, "n", T0, None, True, 1)])
    source = src(spark, [(1, "A"), (3, "c")])
    out = scd2_merge(target, source, full, T2, broadcast_source=broadcast)
    want = [(1, "a", T0, T2, False, 1), (1, "A", T2, None, True, 2), (2, "b", T0, T2, False, 1), (3, "c", T0, T1, False, 1), (3, "c", T2, None, True, 2),
            (None, "n", T0, None, True, 1)]
    assert rows(out) == sorted(want, key=repr)
    changed = scd2_changes(target, source, full, T2, broadcast_source=broadcast)
    assert rows(changed) == sorted((r for r in want if T2 in r), key=repr)
    with pytest.raises(Exception, match="as_of is not after"):
        scd2_merge(target, src(spark, [(1, "a")]), full, T0, broadcast_source=broadcast).collect()


def test_settings_that_exclude_each_other():
    with pytest.raises(ValueError, match="'keep' or 'close'"):
        Scd2Config(keys=("k",), deletes="drop")
    with pytest.raises(ValueError, match="close no others"):
        Scd2Config(keys=("k",), deletes="close", backdated=True)
