"""Folders that can be read and replaced in one job.

Spark cannot overwrite files it is reading. Here every load writes its rows to a folder of its own
and then *commits*: it adds a small file that names what makes up the target from now on. A
reader resolves the newest commit first, so a load that dies before it changes
nothing, and rows already being read stay where they are.

A commit may keep folders of earlier loads. That is what makes large targets affordable: closed
history and untouched partitions are carried over and never rewritten.

Layout::

    <path>/_loads/load=<id>-<suffix>/<partition folders>/...    rows
    <path>/_listings/<id>-<suffix>/...                          what a load added and dropped, as rows
    <path>/_commits/<id>.json                                   commits

All names start with ``_``, so a reader that does not know commits finds nothing rather than rows of several loads.

Listings are deltas: the folders a load wrote and the partitions it dropped, written by the job that finds them. Every
``FULL_EVERY``-th one holds the whole state instead, so a commit costs what its load touched, and a reader reads that many listings at
most. A commit file names the listings its state consists of. It is put in place by a rename that fails if the number is taken: of two
writers that start from the same state one fails, and nothing of the other's is lost.

Partitions are named by a *part key*: the values of the partition columns as JSON, ``{}`` without
partitioning. Only the part keys and folders that a reader asks for pass through the driver, as Spark's own file index
keeps them; rows never do.

With *buckets* the rows are also laid out by a hash of their key (a partition column that readers do not see), so an increment
reaches only the buckets of its keys.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Collection, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import unquote

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.keys import as_keys, keyed
from millrace.functions.workspace import no_rows

# A listing row adds a folder (with its part key) or drops what earlier commits had in a partition (all of it without a part key).
_LISTING = "id BIGINT, folder STRING, part STRING"
FULL_EVERY = 10
BUCKET = "__bucket"


@dataclass(frozen=True)
class Buckets:
    """Rows are laid out by a hash of ``keys`` in ``n`` buckets.

    A key that holds NULL equals none, so such rows need not be found again: they have a bucket of their own, -1,
    unless ``null_safe``.
    """

    keys: tuple[str, ...]
    n: int
    null_safe: bool = False

    def __post_init__(self):
        object.__setattr__(self, "keys", tuple(as_keys(self.keys)))
        if self.n < 1:
            raise ValueError(f"buckets must be a positive number, not {self.n}")

    def number(self, types: T.StructType | None = None) -> Column:
        """A row's bucket; with ``types`` its keys are taken as values of those types."""
        values = [F.col(f"`{k}`").cast(types[k].dataType) if types else F.col(f"`{k}`") for k in self.keys]
        bucket = F.pmod(F.xxhash64(*values), F.lit(self.n)).cast("int")
        return bucket if self.null_safe else F.when(keyed(self.keys), bucket).otherwise(F.lit(-1))

    def reached(self, increment: DataFrame, types: T.StructType) -> set[str]:
        """The buckets (as text) that may hold keys of ``increment``; at most ``n``."""
        rows = increment if self.null_safe else increment.filter(keyed(self.keys))
        return {str(r[0]) for r in rows.select(self.number(types).alias(BUCKET)).distinct().collect()}


def part_key(columns: Sequence[str]) -> Column:
    """The part key of a row. Spark keeps NULL and '' in the same partition, so they share a key."""
    if not columns:
        return F.lit("{}")
    return F.to_json(F.struct(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]))


def part_keys(df: DataFrame, columns: Sequence[str]) -> set[str]:
    """The partitions the rows of ``df`` fall into."""
    return {r["part"] for r in df.select(part_key(columns).alias("part")).distinct().collect()}


@dataclass(frozen=True)
class Snapshot:
    """One committed state: how its rows are stored, and in which folders."""

    spark: SparkSession = field(repr=False, compare=False)
    path: str
    id: int
    format: str
    options: Mapping[str, str]
    schema: T.StructType                # without the bucket
    partition_by: tuple[str, ...]       # without the bucket
    listings: tuple[str, ...]           # the last full one and the deltas since
    buckets: Buckets | None = None
    notes: Mapping[str, Any] = field(default_factory=dict)      # what the last writer knows about the rows
    _known: dict = field(default_factory=dict, repr=False, compare=False)

    @property
    def layout(self) -> tuple[str, ...]:
        """All partition columns of the files."""
        return ((BUCKET,) if self.buckets else ()) + self.partition_by

    @property
    def file_schema(self) -> T.StructType:
        return T.StructType([*self.schema.fields, *([T.StructField(BUCKET, T.IntegerType())] if self.buckets else [])])

    def listing(self) -> DataFrame:
        """The live folders as rows (folder, part)."""
        rows = self.spark.read.schema(_LISTING).parquet(*[f"{self.path}/_listings/{name}" for name in self.listings])
        drops = rows.where("folder IS NULL").groupBy("part").agg(F.max("id").alias("dropped"))
        live = rows.where("folder IS NOT NULL").join(drops, "part", "left")
        return live.where("dropped IS NULL OR id >= dropped").select("folder", "part")

    @property
    def folders(self) -> dict[str, str]:
        """Folder name -> part key, read once."""
        if "all" not in self._known:
            self._known["all"] = {r["folder"]: r["part"] for r in self.listing().collect()}
        return self._known["all"]

    def parts(self) -> set[str]:
        return set(self.folders.values())

    def folders_of(self, parts: Collection[str] | None) -> list[str]:
        return [f for f, part in self.folders.items() if parts is None or part in parts]


class SnapshotFolder:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._loads = f"{self.path}/_loads"
        self._commits = f"{self.path}/_commits"
        self._fs = spark.sparkContext._jvm.org.apache.hadoop.fs

    # -- reading ---------------------------------------------------------------------------------

    def snapshot(self) -> Snapshot | None:
        """The newest committed state, None before the first commit."""
        newest = self._newest()
        return self._state(newest) if newest else None

    def read(self, parts: Collection[str] | None = None, at: Snapshot | None = None) -> DataFrame | None:
        """Committed rows, or None before the first commit.

        ``parts`` limits the scan to those partitions; other folders are not even listed. ``at`` is a
        state resolved before, by default the newest.
        """
        state = at or self.snapshot()
        if state is None:
            return None
        chosen = state.folders_of(parts)
        if not chosen:
            return no_rows(self.spark, state.schema)
        return (self.spark.read.format(state.format).options(**state.options)
                .option("basePath", self._loads).schema(state.file_schema)
                .load([f"{self._loads}/{unquote(f)}" for f in chosen])
                .select(*[f"`{f.name}`" for f in state.schema.fields]))

    # -- writing ---------------------------------------------------------------------------------

    def commit(self, df: DataFrame, format: str = "parquet", options: Mapping[str, Any] | None = None,
               partition_by: Sequence[str] = (), replace: Collection[str] | None = None,
               rebalance_by: Sequence[str] | None = None, at: Snapshot | None = None,
               notes: Mapping[str, Any] | None = None, buckets: Buckets | None = None) -> Snapshot:
        """Write ``df`` as a new load and make it current.

        Without ``replace`` it is the whole new contents. With it, only those partitions are replaced
        and every other folder of the current state is kept. ``at`` is the state ``df`` was made from.
        Rows are rebalanced on the partition columns (or ``rebalance_by``) before they are written.
        ``notes`` are what the writer knows about the new contents; without them nothing is known.
        """
        before = at or self.snapshot()
        format = format.lower()
        if replace is not None and before is not None:
            had, has = ((s, tuple(p), b) for s, p, b in ((before.format, before.partition_by, before.buckets), (format, partition_by, buckets)))
            if had != has:
                raise ValueError(f"{self.path} is {had[0]} by {had[1:]}; partitions cannot be replaced as {has[0]} by {has[1:]}")
        number = before.id + 1 if before else 1
        suffix = uuid.uuid4().hex[:12]
        load = f"load={number:06d}-{suffix}"
        listing = f"{number:06d}-{suffix}"
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in df.schema.fields])
        delta = replace is not None and before is not None and len(before.listings) < FULL_EVERY
        state = Snapshot(self.spark, self.path, number, format, {k: str(v) for k, v in dict(options or {}).items()}, schema, tuple(partition_by),
                         (*(before.listings if delta else ()), listing), buckets, dict(notes or {}))

        balance = state.layout if rebalance_by is None else ((BUCKET,) if buckets else ()) + tuple(rebalance_by)
        if buckets:
            df = df.withColumn(BUCKET, buckets.number())
        if balance:
            df = df.hint("rebalance", *balance)
        writer = df.write.format(format).mode("errorifexists").options(**state.options)
        (writer.partitionBy(*state.layout) if state.layout else writer).save(f"{self._loads}/{load}")

        entries = self._written(load, state)
        if delta:
            entries = entries.unionByName(self._drops(replace))
        elif replace is not None and before is not None:
            kept = before.listing()
            entries = entries.unionByName(kept.join(self._drops(replace).select("part"), "part", "left_anti") if replace else kept)
        entries = entries.select(F.lit(number).cast("bigint").alias("id"), "folder", "part")
        (entries if delta and state.layout else entries.coalesce(1)).write.mode("errorifexists").parquet(f"{self.path}/_listings/{listing}")
        self._publish(state)
        return state

    def _written(self, load: str, state: Snapshot) -> DataFrame:
        """Folders just written, with their part keys; a scan of file footers, no columns."""
        if not state.layout:
            return self.spark.range(1).select(F.lit(load).alias("folder"), F.lit("{}").alias("part"))
        rows = (self.spark.read.format(state.format).options(**state.options).schema(state.file_schema)
                .load(f"{self._loads}/{load}"))
        folder = F.regexp_extract("_metadata.file_path", f"({load}.*)/[^/]+$", 1)
        return rows.select(folder.alias("folder"), part_key(state.layout).alias("part")).distinct()

    def _drops(self, parts: Collection[str]) -> DataFrame:
        rows = self.spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(sorted(parts))), "array<string>")).alias("part"))
        return rows.select(F.lit(None).cast("string").alias("folder"), "part")

    def compact(self, parts: Collection[str] | None = None) -> Snapshot:
        """Rewrite partitions as few, evenly sized files. Many small loads leave many small files."""
        state = self.snapshot()
        chosen = state.parts() if parts is None else set(parts)
        rows = self.read(chosen, state)
        if not state.layout:
            rows = rows.hint("rebalance")
        return self.commit(rows, state.format, state.options, state.partition_by, replace=chosen, at=state,
                           notes=state.notes, buckets=state.buckets)

    # -- leftovers -------------------------------------------------------------------------------

    def _every_listing(self) -> DataFrame:
        return self.spark.read.schema(_LISTING).parquet(f"{self.path}/_listings/*").where("folder IS NOT NULL")

    def retired_folders(self) -> DataFrame:
        """Folders that only older commits name; safe to delete once nobody reads those loads."""
        return self._every_listing().select("folder").distinct().join(self.snapshot().listing(), "folder", "left_anti")

    def orphans(self) -> list[str]:
        """Folders of loads that no commit names: loads that died before it, or are still being written."""
        loads, newest = self._names(self._loads), self._newest()
        named = {name.removesuffix(".json") for name in self._names(self._commits)} if newest else set()
        known = {json.loads(self._text(f"{self._commits}/{name}.json"))["listings"][-1] for name in named if name.isdigit()}
        return sorted(name for name in loads if name.startswith("load=") and name.removeprefix("load=") not in known)

    # -- commits ---------------------------------------------------------------------------------

    def _publish(self, state: Snapshot) -> None:
        """Put the commit in place; fails if its number is taken."""
        said = {"format": state.format, "options": dict(state.options), "schema": state.schema.jsonValue(), "partition_by": list(state.partition_by),
                "listings": list(state.listings), "notes": dict(state.notes),
                "buckets": state.buckets and {"keys": list(state.buckets.keys), "n": state.buckets.n, "null_safe": state.buckets.null_safe}}
        final = f"{self._commits}/{state.id:012d}.json"
        written = f"{self._commits}/_{uuid.uuid4().hex}"
        self._write(written, json.dumps(said))
        if not self._rename(written, final, "NONE"):
            raise RuntimeError(f"another load was committed at {self.path} during this one")
        hint = f"{self._commits}/_{uuid.uuid4().hex}"
        self._write(hint, str(state.id))
        self._rename(hint, f"{self._commits}/_newest", "OVERWRITE")

    def _state(self, number: int) -> Snapshot:
        said = json.loads(self._text(f"{self._commits}/{number:012d}.json"))
        buckets = Buckets(tuple(said["buckets"]["keys"]), said["buckets"]["n"], said["buckets"]["null_safe"]) if said["buckets"] else None
        return Snapshot(self.spark, self.path, number, said["format"], said["options"], T.StructType.fromJson(said["schema"]), tuple(said["partition_by"]),
                        tuple(said["listings"]), buckets, said["notes"])

    def _newest(self) -> int:
        """The number of the newest commit, 0 before the first. A hint says where to look; later ones are tried by number."""
        hint = self._text(f"{self._commits}/_newest")
        known = int(hint) if hint and hint.isdigit() else 0
        if not known or not self._exists(f"{self._commits}/{known:012d}.json"):
            numbers = [int(m.group(1)) for m in (re.fullmatch(r"(\d+)\.json", n) for n in self._names(self._commits)) if m]
            known = max(numbers, default=0)
        while self._exists(f"{self._commits}/{known + 1:012d}.json"):
            known += 1
        return known

    # -- the file system, through Hadoop's interfaces --------------------------------------------

    def _store(self, path: str):
        at = self._fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        at, store = self._store(path)
        return store.exists(at)

    def _names(self, path: str) -> list[str]:
        at, store = self._store(path)
        return [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []

    def _write(self, path: str, text: str) -> None:
        at, store = self._store(path)
        out = store.create(at, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _text(self, path: str) -> str | None:
        """The contents of a small file, None if it is not there."""
        at, store = self._store(path)
        if not store.exists(at):
            return None
        source = store.open(at)
        try:
            return bytes(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def _rename(self, source: str, to: str, how: str) -> bool:
        """Rename a file; with ``how`` NONE only if nothing is there. Returns whether it was done."""
        gateway = self.spark.sparkContext._gateway
        rename = getattr(self._fs, "Options$Rename")
        options = gateway.new_array(rename, 1)
        options[0] = getattr(rename, how)
        at, store = self._store(source)
        context = self._fs.FileContext.getFileContext(store.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(at, self._fs.Path(to), options)
            return True
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            store.delete(at, False)
            return False


def staged_overwrite(spark: SparkSession, path: str, df: DataFrame, **how: Any) -> DataFrame:
    """Replace the contents of ``path`` by ``df``, which may read ``path``; return the new contents."""
    folder = SnapshotFolder(spark, path)
    return folder.read(at=folder.commit(df, **how))
