"""Near-duplicate documents: fast similarity sketches, banding, exact verification, connected components.

Sketch (rounds of hashed bin placement): in round i every shingle of a set is hashed to a bin and a value; bins
keep the smallest (round, value). Rounds go on until every bin is filled; from round ``coordinates`` on a round serves
one fixed bin, so after twice that many none is empty. Large sets need two or three rounds, not one hash per
coordinate. Two sets agree in a coordinate with the chance of their similarity. ``ROWS`` coordinates make a band;
a link of 75 % shares no band with a chance of (1 - 0.75^3)^32 = 2e-8.

Exact steps from there on, without ever pairing all members of a bucket:

1. Documents of equal shingle sets are one class; only classes go on.
2. Every bucket draws a centre at random, so a group that meets in many bands gets many centres. Members are
   compared with their centres on full sets.
3. Links give components. A bucket of one component is settled. In any other, the members outside its largest
   component are compared with all members of other components, in cells of bounded size.
4. Components of all links.

Texts are not shuffled. The classes that meet others in a bucket are put in a Bloom filter of fixed size (16 MB, whatever the number of
classes), which goes to all tasks of a second scan; only documents that pass it send their sets, and a join leaves those that are wanted.
A fuller filter lets more sets pass, which costs shuffle, not exactness. Sets travel as sorted 64-bit hashes, once for each centre or cell,
in streams sorted by centre or cell; a hot centre is dealt over many salted copies. A task holds one centre's set, or one
cell, which is bounded in sets and in shingles. Inner tables are deleted when the verdicts are there.

Defined cases: NULL or blank texts have no shingles, are linked with nothing and stay; a text of fewer than five
words has its word sequence as one shingle; a NULL id counts as the largest one; nodes are sets, not ids, so rows without an id are
linked like any others and so is each text of an id that has several; of those, and of groups without any id, the set with the
smallest print is the one that is kept; an empty table gives an empty result. Other columns are not looked at. A task's memory is some thirty times its longest text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from millrace.llm import shingles
from millrace.llm.common import same, scratch, staged
from millrace.llm.components import components

BANDS, ROWS = 32, 3
PERCENT = 75
# Members that are compared with one copy of a centre, and the sides of a cell.
SALTED = 2_000
CELL, CELL_SHINGLES = 1_000, 1_000_000
# Bits of the filter, as a power of two; two are set for each document.
FILTER_BITS = 27
# Columns of a cell's matrix that are multiplied at once.
SLAB = 2_048

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def sketches(values: np.ndarray, counts: np.ndarray, coordinates: int) -> np.ndarray:
    """A row of ``coordinates`` for each set; ``values`` are the sets' hashes, end to end, ``counts`` their sizes."""
    out = np.full(len(counts) * coordinates, _EMPTY)
    owner = np.repeat(np.arange(len(counts)), counts)
    low = np.uint64((1 << 40) - 1)
    for number in range(2 * coordinates):
        if not len(owner):
            break
        hashed = shingles.mixed(values, number + 1)
        if number < coordinates:
            at = ((hashed >> np.uint64(40)) * np.uint64(coordinates) >> np.uint64(24)).astype(np.int64)
        else:
            at = number - coordinates
        np.minimum.at(out, owner * coordinates + at, (np.uint64(number) << np.uint64(40)) | (hashed & low))
        open_sets = (out.reshape(-1, coordinates) == _EMPTY).any(axis=1)
        still = open_sets[owner]
        values, owner = values[still], owner[still]
    return out.reshape(-1, coordinates)


def band_keys(sketch: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key for each band of each row, different bands having different keys."""
    parts = sketch.reshape(len(sketch), -1, rows)
    key = np.broadcast_to(np.arange(parts.shape[1], dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        key = shingles.mixed(key ^ parts[:, :, k], 900 + k)
    return key.view(np.int64)


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start, end, texts in shingles.text_chunks(batch.column(1)):
                values, counts = shingles.shingle_hashes(texts)
                keys = band_keys(sketches(values, counts, bands * rows), rows)
                some = counts > 0
                rows_of_keys = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * bands))), pa.int32()),
                                                        pa.array(keys[some].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(start, end - start), pa.array(counts.astype(np.int64)),
                     pa.array(_prints(values, counts), pa.binary()), rows_of_keys],
                    names=["doc_id", "n_shingles", "set_print", "bands"])

    return run


def _prints(values: np.ndarray, counts: np.ndarray) -> list[bytes | None]:
    """A 128-bit print of each set; an empty one has none."""
    ends = np.cumsum(counts)
    sums, more = (np.concatenate(([np.uint64(0)], np.cumsum(shingles.mixed(values, seed)))) for seed in (501, 502))
    prints = np.stack([sums[ends] - sums[ends - counts], more[ends] - more[ends - counts]], axis=1)
    return [p.tobytes() if n else None for p, n in zip(prints, counts)]


def _bloom(ids: DataFrame) -> np.ndarray:
    """A filter of the numbers of ``ids`` (doc_id): 2^FILTER_BITS bits in 64-bit words, put together by Spark."""
    mask = F.lit((1 << FILTER_BITS) - 1)
    bits = _filter_key("doc_id")
    places = ids.select(F.explode(F.array(bits.bitwiseAND(mask), F.shiftrightunsigned(bits, FILTER_BITS).bitwiseAND(mask))).alias("bit"))
    one = F.expr("shiftleft(1L, int(bit & 63))")
    words = places.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(one).alias("bits")).toArrow()      # at most 2^(FILTER_BITS - 6) rows
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out


def _filter_key(column: str):
    return F.xxhash64(column, F.lit("near"))


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    keys = keys.view(np.uint64)
    mask = np.uint64((1 << FILTER_BITS) - 1)
    found = np.ones(len(keys), bool)
    for place in (keys & mask, (keys >> np.uint64(FILTER_BITS)) & mask):
        found &= (bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)).astype(np.int64)) & 1 == 1
    return found


def _sets(bits):
    """Rows of (doc_id, filter key, text) to (doc_id, set_print, hashes), for rows that pass the filter or have no id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bits.value
        for batch in batches:
            ids = batch.column(0)
            chosen = _passes(words, batch.column(1).to_numpy(zero_copy_only=False)) | ids.is_null().to_numpy(zero_copy_only=False)
            kept = batch.filter(pa.array(chosen))
            for start, end, texts in shingles.text_chunks(kept.column(2)):
                values, counts = shingles.shingle_hashes(texts)
                ends = np.cumsum(counts)
                hashes = [values[e - n:e].tobytes() for e, n in zip(ends, counts)]
                yield pa.RecordBatch.from_arrays([kept.column(0).slice(start, end - start), pa.array(_prints(values, counts), pa.binary()),
                                                  pa.array(hashes, pa.binary())], names=["doc_id", "set_print", "hashes"])

    return run


def _with_print(text_at: int, name: str):
    """Whole rows with their sets' prints as one more column."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(text_at)
            if not (pa.types.is_string(column.type) or pa.types.is_large_string(column.type)):
                column = column.cast(pa.string())
            for start, end, texts in shingles.text_chunks(column):
                prints = pa.array(_prints(*shingles.shingle_hashes(texts)), pa.binary())
                yield pa.RecordBatch.from_arrays([*batch.slice(start, end - start).columns, prints], names=[*batch.schema.names, name])

    return run


def _linked(common: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return (100 * common >= percent * (a + b - common)) & (common > 0)


def _against_centre(percent: int):
    """Rows sorted by (centre, salt, member's NULL first): the centre's own row, then its members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, own = None, None
        for batch in batches:
            a, b = [], []
            ends, data = shingles.stretches(batch.column("hashes"))
            for k, (at, member) in enumerate(zip(batch.column("centre").to_pylist(), batch.column("member").to_pylist())):
                values = np.frombuffer(data[ends[k]:ends[k + 1]], np.uint64)
                if member is None:
                    centre, own = at, values.copy()
                elif centre == at:
                    found = np.searchsorted(own, values)
                    found[found == len(own)] = 0
                    common = int((own[found] == values).sum())
                    if common and 100 * common >= percent * (len(own) + len(values) - common):
                        a.append(member)
                        b.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _cell_links(left: list[tuple], right: list[tuple], percent: int) -> list[tuple[int, int]]:
    """For each row of ``left`` one link to each other component among ``right``; rows are (node, component, hashes)."""
    sets = [[np.frombuffer(h, np.uint64) for _, _, h in side] for side in (left, right)]
    sizes = [np.array([len(s) for s in side]) for side in sets]
    flat = [np.concatenate(side) for side in sets]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    places = []
    for values, n in zip(flat, sizes):
        at = np.searchsorted(shared, values)
        at[at == len(shared)] = 0
        hit = shared[at] == values if len(shared) else np.zeros(len(values), bool)
        places.append((np.repeat(np.arange(len(n)), n)[hit], at[hit]))
    common = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, len(shared), SLAB):
        slabs = []
        for (row, at), n in zip(places, sizes):
            inside = (at >= start) & (at < start + SLAB)
            slab = np.zeros((len(n), SLAB), np.float32)
            slab[row[inside], at[inside] - start] = 1
            slabs.append(slab)
        common += slabs[0] @ slabs[1].T
    ok = _linked(common.astype(np.int64), sizes[0][:, None], sizes[1][None, :], percent)
    part = [np.array([c for _, c, _ in side]) for side in (left, right)]
    ok &= part[0][:, None] != part[1][None, :]
    found: dict[tuple[int, int], tuple[int, int]] = {}
    for i, j in zip(*np.nonzero(ok)):
        found.setdefault((int(i), int(part[1][j])), (left[i][0], right[j][0]))
    return list(found.values())


def _in_cells(percent: int):
    """Rows sorted by cell, its outsiders first; a cell is complete when the next one begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, left, right = None, [], []

        def links() -> pa.RecordBatch:
            pairs = _cell_links(left, right, percent) if left and right else []
            return pa.RecordBatch.from_pandas(pd.DataFrame(pairs, columns=["a", "b"], dtype="int64"), preserve_index=False)

        for batch in batches:
            ends, data = shingles.stretches(batch.column("hashes"))
            rows = zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "side", "node", "component")))
            for k, row in enumerate(rows):
                if row[:3] != cell:
                    if cell is not None:
                        yield links()
                    cell, left, right = row[:3], [], []
                (right if row[3] else left).append((*row[4:], bytes(data[ends[k]:ends[k + 1]])))
        if cell is not None:
            yield links()

    return run


def _partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _star_links(members: DataFrame, buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    pairs = (members.join(buckets.select("key", "centre"), "key").where("node <> centre")
             .select("centre", F.col("node").alias("member")).distinct())
    pairs = staged(pairs, "near-pairs")
    copies = (pairs.groupBy("centre").agg(F.ceil(F.count(F.lit(1)) / SALTED).cast("int").alias("copies")))
    salted = pairs.join(copies, "centre").withColumn("salt", F.pmod(F.xxhash64("member"), F.col("copies")).cast("int")).drop("copies")
    own = copies.select("centre", F.lit(None).cast("bigint").alias("member"),
                        F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    rows = own.unionByName(salted).withColumn("node", F.coalesce("member", "centre")).join(sets, "node").drop("node")
    rows = rows.repartition(_partitions(rows), "centre", "salt").sortWithinPartitions("centre", "salt", F.col("member").asc_nulls_first())
    return rows.select("centre", "member", "hashes").mapInArrow(_against_centre(percent), "a bigint, b bigint")


def _outsider_links(members: DataFrame, groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links that the centres missed, in the buckets that hold members of several components."""
    placed = (members.join(groups.withColumnRenamed("component", "c"), "node", "left")
              .select("key", "node", "n_shingles", F.coalesce("c", "node").alias("component")))
    placed = staged(placed, "near-placed")
    parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))

    def cells(n, s):
        return F.ceil(F.greatest(n / CELL, s / CELL_SHINGLES)).cast("int")

    open_keys = (parts.groupBy("key").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("parts"),
                                          F.max(F.struct("n", "component", "s")).alias("main"))
                 # Two members were compared already: one of them was the centre.
                 .where("parts > 1 AND n > 2")
                 .select("key", F.col("main.component").alias("main"),
                         cells(F.col("n"), F.col("s")).alias("rows"),
                         cells(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("columns")))
    rows = placed.join(staged(open_keys, "near-open"), "key")
    numbered = rows.withColumn("h", F.xxhash64("node"))
    inner = numbered.select("key", F.pmod("h", "rows").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("j"),
                            F.lit(True).alias("side"), "node", "component")
    outer = (numbered.where("component <> main")
             .select("key", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("i"), F.pmod("h", "columns").cast("int").alias("j"),
                     F.lit(False).alias("side"), "node", "component"))
    dealt = outer.unionByName(inner).join(sets, "node")
    dealt = dealt.repartition(_partitions(dealt), "key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
    return dealt.select("key", "i", "j", "side", "node", "component", "hashes").mapInArrow(_in_cells(percent), "a bigint, b bigint")


def _grouped(docs: DataFrame, percent: int, bands: int, rows: int, id_column: str, text_column: str) -> DataFrame:
    """One row per document: doc_id, n_shingles, set_print, component_id, kept; staged tables below it."""
    texts = docs.select(F.col(f"`{id_column}`").cast("bigint").alias("doc_id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    spark = docs.sparkSession
    with scratch(spark):
        signed = staged(texts.mapInArrow(_sign(bands, rows), "doc_id bigint, n_shingles bigint, set_print binary, bands array<bigint>"),
                        "near-signed", lasting=True)
        # A class is a set of shingles, its node a number, its own id the smallest that has it.
        classes = staged(signed.where("n_shingles > 0").groupBy("set_print")
                         .agg(F.min("doc_id").alias("own_id"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
                         .withColumn("node", F.monotonically_increasing_id()), "near-classes")
        members = classes.select("node", "n_shingles", F.explode("bands").alias("key"))
        centre = F.min(F.struct(F.xxhash64("key", "node").alias("drawn"), "node"))
        buckets = staged(members.groupBy("key").agg(centre.alias("c"), F.count(F.lit(1)).alias("n")).where("n > 1")
                         .select("key", F.col("c.node").alias("centre")), "near-buckets")
        members = staged(members.join(buckets.select("key"), "key"), "near-members")
        wanted = staged(classes.join(members.select("node").distinct(), "node", "left_semi")
                        .select("node", "set_print", F.col("own_id").alias("doc_id")), "near-wanted")
        bits = spark.sparkContext.broadcast(_bloom(wanted.where("doc_id IS NOT NULL")))
        nameless = not wanted.where("doc_id IS NULL").isEmpty()
        sent = (texts if nameless else texts.where("doc_id IS NOT NULL")).select("doc_id", _filter_key("doc_id").alias("key"), "text")
        sent = sent.mapInArrow(_sets(bits), "doc_id bigint, set_print binary, hashes binary")
        # Rows that repeat id and text send the same set; they are few, or the join below splits them.
        own = wanted.withColumnRenamed("set_print", "p").withColumnRenamed("doc_id", "d").hint("shuffle_hash")
        sets = sent.join(own, (F.col("set_print") == F.col("p")) & same(F.col("doc_id"), F.col("d"))).select("node", "hashes")
        if nameless or not signed.groupBy("doc_id").count().where("count > 1 AND doc_id IS NOT NULL").isEmpty():
            sets = sets.dropDuplicates(["node"])
        sets = staged(sets, "near-sets")
        bits.unpersist()
        stars = staged(_star_links(members, buckets, sets, percent), "near-links")
        first = staged(components(stars), "near-components")
        links = stars.unionByName(_outsider_links(members, first, sets, percent))
        final = staged(components(links), "near-components")
        placed = staged(classes.drop("bands", "n_shingles").join(final, "node", "left").withColumn("component", F.coalesce("component", "node")),
                        "near-placed", lasting=True)
    tops = (placed.groupBy("component").agg(F.min(F.struct(F.col("own_id").isNull().alias("unnamed"), "own_id", "set_print")).alias("top"))
            .select("component", F.col("top.own_id").alias("top_id"), F.col("top.set_print").alias("top_print")))
    verdicts = placed.join(tops, "component").select("set_print", "top_id", (F.col("set_print") == F.col("top_print")).alias("is_top"))
    ids = signed.drop("bands").join(verdicts, "set_print", "left")
    some = F.col("n_shingles") > 0
    return ids.select("doc_id", "n_shingles", "set_print", F.when(some, F.col("top_id")).otherwise(F.col("doc_id")).alias("component_id"),
                      F.when(some, F.col("is_top") & same(F.col("doc_id"), F.col("top_id"))).otherwise(F.lit(True)).alias("kept"))


def groups(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest id of its group), kept."""
    return _grouped(docs, percent, bands, rows, id_column, text_column).drop("set_print")


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay - the smallest id of each group, rows without shingles all - with all columns as they were.

    Rows without an id, or with a repeated one, are told apart by their sets' prints; of rows that have both in common one stays.
    """
    tag = uuid.uuid4().hex
    kept_id, kept_print, repeated_id, own_print = (f"{name}_{tag}" for name in ("kept_id", "kept_print", "repeated_id", "own_print"))
    found = staged(_grouped(docs, PERCENT, BANDS, ROWS, "doc_id", "text").select("doc_id", "set_print", "kept"), "near-verdicts")
    repeated = staged(found.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
                      .select(F.col("doc_id").alias(repeated_id)), "near-repeated")
    kept = found.where("kept").select(F.col("doc_id").alias(kept_id), F.col("set_print").alias(kept_print))
    number = docs["doc_id"].cast("bigint")
    stay = docs.join(kept.select(kept_id), number == F.col(kept_id), "left_semi")
    unsure = docs.where(docs["doc_id"].isNull())
    if not repeated.isEmpty():
        stay = stay.join(repeated, number == F.col(repeated_id), "left_anti")
        unsure = unsure.unionByName(docs.join(repeated, number == F.col(repeated_id), "left_semi"))
    elif found.where("doc_id IS NULL").isEmpty():
        return stay
    schema = StructType([*docs.schema.fields, StructField(own_print, BinaryType())])
    printed = unsure.mapInArrow(_with_print(docs.columns.index("text"), own_print), schema)
    on = same(F.col("doc_id").cast("bigint"), F.col(kept_id)) & (F.col(own_print) == F.col(kept_print))
    tops = printed.where(F.col(own_print).isNotNull()).join(kept, on, "left_semi").dropDuplicates(["doc_id", own_print])
    return stay.unionByName(tops.drop(own_print)).unionByName(printed.where(F.col(own_print).isNull()).drop(own_print))
