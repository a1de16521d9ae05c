"""Transform steps: SQL blocks and named Python functions, both ``DataFrame -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.sqltext import created_temp_view, split_sql

# Fixed value: the view a SQL block reads.
INPUT_VIEW = "temp_table"

Transform = Callable[[DataFrame], DataFrame]

_REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register_transform(name: str):
    """Make ``fn(df, **args)`` available to specs under ``name``."""

    def keep(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        _REGISTRY[name] = fn
        return fn

    return keep


def registered(name: str) -> Callable[..., DataFrame]:
    if name not in _REGISTRY:
        raise ValueError(f"no transform is registered as {name!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name]


@register_transform("not_null")
def not_null(df: DataFrame, columns: str | Sequence[str] | None = None) -> DataFrame:
    """Rows where every one of ``columns`` has a value; without ``columns``, where every column has."""
    names = df.columns if columns is None else [columns] if isinstance(columns, str) else list(columns)
    return df.dropna(how="any", subset=names)


@contextmanager
def _borrowed_views(spark: SparkSession, names: Sequence[str]) -> Iterator[None]:
    """Give the view names back afterwards: restored if they were in use, dropped otherwise."""
    before = {n: spark.table(f"`{n.replace('`', '``')}`") for n in names if _temp_view_exists(spark, n)}
    try:
        yield
    finally:
        for name in names:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def _temp_view_exists(spark: SparkSession, name: str) -> bool:
    quoted = f"`{name.replace('`', '``')}`"
    return spark.catalog.tableExists(quoted) and spark.catalog.getTable(quoted).isTemporary


def sql_block(df: DataFrame, text: str, view: str = INPUT_VIEW) -> DataFrame:
    """Run the statements of ``text`` in order over ``df`` (seen as ``view``); return the last result.

    Views the block creates live only as long as the block, so blocks can be chained and reuse names.
    """
    statements = split_sql(text)
    if not statements:
        raise ValueError("the SQL block holds no statement")
    spark = df.sparkSession
    created = {created_temp_view(s) for s in statements} - {None}
    with _borrowed_views(spark, sorted(created | {view})):
        df.createOrReplaceTempView(view)
        results = [spark.sql(s) for s in statements]
    if not results[-1].columns:
        raise ValueError("a SQL block must end in a query; its last statement returns no columns")
    return results[-1]


def sql_step(text: str, view: str = INPUT_VIEW) -> Transform:
    return lambda df: sql_block(df, text, view)


def python_step(name: str, args: Mapping | None = None) -> Transform:
    fn = registered(name)
    return lambda df: df.transform(fn, **dict(args or {}))


def chain(df: DataFrame, steps: Sequence[Transform]) -> DataFrame:
    return reduce(lambda acc, step: acc.transform(step), steps, df)
