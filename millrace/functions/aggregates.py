"""User-defined aggregates with mergeable states, and user-defined table functions.

An aggregate is three functions on Arrow data and bytes: ``update`` makes a state of some rows, ``merge`` one state of several,
``finish`` the value. Tasks fold their rows into one state per key before anything is shuffled, states of one key are merged in two
levels, so neither the rows nor all states of a hot key ever meet in one task.

A table function is a Python class (``eval`` per row, ``terminate`` per partition) that SQL blocks call as
``SELECT * FROM name(TABLE(temp_table) PARTITION BY k ORDER BY t)``; rows stream through it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.keys import as_keys, require_columns
from millrace.functions.transforms import register_transform

# Keys whose states a task holds before it passes them on; states that are merged at once.
KEYS_HELD, STATES_AT_ONCE = 20_000, 64
# First-level merges per key.
SPREAD = 64

_STATE, _SLOT = "__state", "__slot"


@dataclass(frozen=True)
class Aggregate:
    """``update(columns) -> state``, ``merge(states) -> state``, ``finish(state) -> value`` of type ``returns``; states are bytes.

    ``merge`` must not depend on the order or grouping of states. ``finish(merge([]))`` is never asked for: keys have rows.
    """

    update: Callable[[pa.RecordBatch], bytes]
    merge: Callable[[Sequence[bytes]], bytes]
    finish: Callable[[bytes], object]
    returns: str


_AGGREGATES: dict[str, Aggregate] = {}


def register_aggregate(name: str, aggregate: Aggregate) -> Aggregate:
    """Make an aggregate available to specifications, as ``function: aggregate`` with ``args: {name: ...}``."""
    _AGGREGATES[name] = aggregate
    return aggregate


@register_transform("aggregate")
def aggregate(df: DataFrame, name: str | Aggregate, keys: str | Sequence[str], columns: str | Sequence[str], output: str = "value") -> DataFrame:
    """One row per key: the keys and ``output``. NULL is a key like any other; NULLs in ``columns`` are the aggregate's own business."""
    if isinstance(name, str) and name not in _AGGREGATES:
        raise ValueError(f"no aggregate is registered as {name!r}; known: {sorted(_AGGREGATES)}")
    what = _AGGREGATES[name] if isinstance(name, str) else name
    names, inputs = as_keys(keys), as_keys(columns)
    require_columns(df, [*names, *inputs], "input")
    key_fields = [T.StructField(n, df.schema[n].dataType) for n in names]
    partial = T.StructType([*key_fields, T.StructField(_SLOT, T.IntegerType()), T.StructField(_STATE, T.BinaryType())])
    final = T.StructType([*key_fields, *T.StructType.fromDDL(f"`{output}` {what.returns}").fields])
    rows = df.select(*[F.col(f"`{n}`").alias(f"k{i}") for i, n in enumerate(names)], *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(inputs)])
    states = rows.mapInArrow(_partial(what, names, inputs), partial)
    merged = states.groupBy(*names, _SLOT).applyInArrow(_merged(what, names, None, partial), partial)
    return merged.groupBy(*names).applyInArrow(_merged(what, names, output, final), final)


def _partial(what: Aggregate, names: list[str], inputs: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        slot = TaskContext.get().partitionId() % SPREAD
        held: dict[tuple, list[bytes]] = {}
        schema = None

        def passed_on() -> pa.RecordBatch:
            keys = list(held)
            columns = [pa.array([k[i] for k in keys], schema.field(i).type) for i in range(len(names))]
            states = pa.array([what.merge(held[k]) if len(held[k]) > 1 else held[k][0] for k in keys], pa.binary())
            return pa.RecordBatch.from_arrays([*columns, pa.array([slot] * len(keys), pa.int32()), states], names=[*names, _SLOT, _STATE])

        for batch in batches:
            schema = batch.schema
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch]).append_column("at", pa.array(range(batch.num_rows)))
            groups = table.group_by([f"k{i}" for i in range(len(names))], use_threads=False).aggregate([("at", "list")])
            data = batch.select(range(len(names), batch.num_columns)).rename_columns(inputs)
            keys = zip(*(groups[f"k{i}"].to_pylist() for i in range(len(names))))
            for key, places in zip(keys, groups["at_list"]):
                states = held.setdefault(key, [])
                states.append(what.update(data.take(places.values)))
                if len(states) >= STATES_AT_ONCE:
                    states[:] = [what.merge(states)]
            if len(held) > KEYS_HELD:
                yield passed_on()
                held.clear()
        if held:
            yield passed_on()

    return run


def _merged(what: Aggregate, names: list[str], output: str | None, schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = to_arrow_schema(schema)

    def run(table: pa.Table) -> pa.Table:
        states = table[_STATE].to_pylist()
        while len(states) > 1:
            states = [what.merge(states[s:s + STATES_AT_ONCE]) if len(states[s:s + STATES_AT_ONCE]) > 1 else states[s]
                      for s in range(0, len(states), STATES_AT_ONCE)]
        last = [pa.array([what.finish(states[0])], wanted.field(output).type)] if output else [pa.array([0], pa.int32()), pa.array(states, pa.binary())]
        return pa.Table.from_arrays([*[table[n].slice(0, 1).combine_chunks().cast(wanted.field(n).type) for n in names], *last], schema=wanted)

    return run


def weighted_quantile(q: float) -> Aggregate:
    """The smallest value at which the weights up to it reach the share ``q`` of all; columns: value, weight (a whole number).

    Exact. The state is the weight of each different value, so it is meant for values of a limited domain; rows with a NULL or a weight below 1 do
    not count, and a key without any other row has NULL.
    """
    schema = pa.schema([("v", pa.float64()), ("w", pa.int64())])

    def pack(table: pa.Table) -> bytes:
        summed = table.group_by("v", use_threads=False).aggregate([("w", "sum")]).rename_columns(["v", "w"]).cast(schema)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, schema) as out:
            out.write_table(summed.combine_chunks())
        return sink.getvalue().to_pybytes()

    def unpack(state: bytes) -> pa.Table:
        return pa.ipc.open_stream(state).read_all()

    def update(batch: pa.RecordBatch) -> bytes:
        table = pa.Table.from_arrays([pc.cast(batch.column(0), pa.float64()), pc.cast(batch.column(1), pa.int64())], schema=schema)
        return pack(table.filter(pc.and_kleene(pc.is_valid(table["v"]), pc.greater(table["w"], 0))))

    def finish(state: bytes) -> float | None:
        ordered = unpack(state).sort_by("v")
        total, reached = pc.sum(ordered["w"]).as_py(), 0
        for value, weight in zip(ordered["v"].to_pylist(), ordered["w"].to_pylist()):
            reached += weight
            if reached >= q * total:
                return value
        return None

    return Aggregate(update, lambda states: pack(pa.concat_tables([unpack(s) for s in states])), finish, "double")


def register_table_function(spark: SparkSession, name: str, function: type, returns: str) -> None:
    """Make a Python table function callable from the session's SQL, rows going to Python in Arrow batches."""
    spark.udtf.register(name, F.udtf(function, returnType=returns, useArrow=True))


_TABLE_FUNCTIONS: dict[str, tuple[type, str]] = {}


def table_function(name: str, returns: str):
    """Class decorator: keep a table function by name for specifications (``function: table_function``)."""

    def keep(function: type) -> type:
        _TABLE_FUNCTIONS[name] = (function, returns)
        return function

    return keep


@register_transform("table_function")
def call_table_function(df: DataFrame, name: str, partition_by: str | Sequence[str], order_by: str | Sequence[str] = ()) -> DataFrame:
    """The rows a table function makes of the partitions of ``df``, each in the order given. Names are columns, NULL is a partition of its own."""
    if name not in _TABLE_FUNCTIONS:
        raise ValueError(f"no table function is kept as {name!r}; known: {sorted(_TABLE_FUNCTIONS)}")
    partition, order = as_keys(partition_by), as_keys(order_by) if order_by else []
    require_columns(df, [*partition, *order], "input")
    function, returns = _TABLE_FUNCTIONS[name]
    argument = df.asTable().partitionBy(*partition)
    return F.udtf(function, returnType=returns, useArrow=True)(argument.orderBy(*order) if order else argument)


@table_function("runs", "key STRING, value STRING, first_at TIMESTAMP_NTZ, last_at TIMESTAMP_NTZ, length BIGINT")
class Runs:
    """Gaps and islands: rows (key, value, at) of one partition, in order, to runs of equal values. NULL equals NULL."""

    def __init__(self):
        self.run = None

    def eval(self, row):
        key, value, at = row[0], row[1], row[2]
        if self.run is not None and self.run[1] == value:
            self.run[3], self.run[4] = at, self.run[4] + 1
            return
        done, self.run = self.run, [key, value, at, at, 1]
        if done is not None:
            yield tuple(done)

    def terminate(self):
        if self.run is not None:
            yield tuple(self.run)
