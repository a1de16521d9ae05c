"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document has a virtual finish time: the words its source has sent up to and including it,
divided by the source's weight. The copies of all sources, in the order of their finish times, are the mix;
it ends where the total budget is reached. A source is read through at most ``passes`` times, each time in
the same shuffled order, so it stops at ``passes`` times its size and the others go on by weight: the cut is
the water level of the targets.

Running sums are taken in two steps - within slices of the order, then over the slices' totals - so that
neither a source with a third of the rows nor the global order ever meets in one task. The number of slices
grows with the square root of the rows, like the rows in one slice.

Defined cases: NULL text has no words; a NULL source is a source, the last; rows that repeat id, source and
size are one unit with their number as factor, and each gets the same number of copies; documents without
words are never taken; an empty table gives an empty mix. Other columns are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, same, small, staged, text_of

WEIGHTS = (5, 2, 1)
PASSES = 3


def _slices(rows: int) -> int:
    return max(1, int(rows ** 0.5))


def _units(docs: DataFrame) -> DataFrame:
    size = F.regexp_count(text_of(), F.lit(WORD)).cast("bigint")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       size.alias("size"))
    return (rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("rows"))
            .withColumn("shuffled", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))


def targets(units: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, share: float = 1.0) -> DataFrame:
    """One row per source: source, source_no, weight, source_size, target, level (the finish time of the cut).

    The level is found in one pass over the sources by how early each one runs dry. A source is at its limit if the
    level that it and the later ones would reach lies above the point where it runs dry; the first for which that is
    not so has the level, which is the greatest of those that follow.
    """
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_no") - 1) % len(weights) + 1).cast("int"))
    dry = Window.orderBy(F.col("source_size") * passes / F.col("weight"), "source_no")
    all_sources = Window.partitionBy()
    level = (F.col("budget") - F.col("dry_before")) / F.col("weight_left")
    cut = F.when(level <= F.col("source_size") * passes / F.col("weight"), level)
    return (sizes.withColumn("source_no", F.row_number().over(by_name)).withColumn("weight", weight)
            .withColumn("budget", F.sum("source_size").over(all_sources) * share)
            .withColumn("dry_before", F.sum(F.col("source_size") * passes).over(dry) - F.col("source_size") * passes)
            .withColumn("weight_left", F.sum("weight").over(all_sources) - F.sum("weight").over(dry) + F.col("weight"))
            .withColumn("level", F.max(cut).over(all_sources))
            .withColumn("target", F.when(F.col("level").isNull(), (F.col("source_size") * passes).cast("double"))
                        .otherwise(F.least((F.col("source_size") * passes).cast("double"), F.col("level") * F.col("weight"))))
            .select("source", "source_no", "weight", "source_size", "budget", "level", "target"))


def _running(rows: DataFrame, keys: list[str], slice_by: str, order: list, amount: str, result: str, lead: list[str]) -> DataFrame:
    """``amount`` summed up to and including each row of its ``keys`` group, slice by slice."""
    totals = staged(rows.groupBy(*keys, slice_by).agg(F.sum(amount).alias("slice_sum")), "mix-slices")
    before = Window.partitionBy(*keys).orderBy(slice_by)
    starts = totals.select(*keys, slice_by, (F.sum("slice_sum").over(before) - F.col("slice_sum")).alias("start"))
    inside = Window.partitionBy(*keys, slice_by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("inside", F.sum(amount).over(inside)).join(starts, [*keys, slice_by])
            .withColumn(result, F.col("start") + F.col("inside")).select(*lead, result))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, share: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(copies, sources). ``copies``: a row for each unit and pass: doc_id, source_no, source, size, rows, pass, finish,
    sent (words of the mix up to here) and taken; ``sources`` as from :func:`targets`."""
    units = staged(_units(docs), "mix-units")
    sources = staged(targets(units, weights, passes, share), "mix-sources")
    slices = _slices(units.count())
    known = units.join(small(sources.select(F.col("source").alias("name"), "source_no", "weight", "source_size", "budget", "level")),
                       same(F.col("source"), F.col("name"))).drop("name")
    known = (known.withColumn("words", F.col("size") * F.col("rows"))
             .withColumn("slice", F.floor(F.conv(F.substring("shuffled", 1, 8), 16, 10).cast("bigint") * slices / 2 ** 32)))
    lead = ["doc_id", "source", "source_no", "size", "rows", "words", "shuffled", "weight", "source_size", "budget", "level"]
    sent = _running(known, ["source_no"], "slice", ["shuffled", "doc_id", "size"], "words", "sent_before", lead)
    copies = sent.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    finish = (F.col("pass") * F.col("source_size") + F.col("sent_before")).cast("double") / F.col("weight")
    copies = copies.withColumn("finish", finish)
    # Slices of equal width up to twice the cut, of growing width beyond; either way later finishes have later slices.
    far = F.col("finish") / F.col("level")
    at = F.when(F.col("level") > 0, F.when(far <= 2, F.floor(far * slices)).otherwise(2 * slices + 1 + F.floor(F.log2(far / 2) * slices))
                ).otherwise(F.lit(0))
    copies = copies.withColumn("finish_slice", at.cast("bigint"))
    order = ["finish", "source_no", "shuffled", "doc_id", "size", "pass"]
    lead = ["doc_id", "source", "source_no", "size", "rows", "words", "source_size", "budget", "pass", "finish", "shuffled"]
    copies = _running(copies, [], "finish_slice", order, "words", "sent", lead)
    return copies.withColumn("taken", (F.col("sent") <= F.col("budget")) & (F.col("size") > 0)), sources


def taken(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, share: float = 1.0) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted), copies."""
    copies, sources = plan(docs, weights, passes, share)
    per_unit = (copies.groupBy("doc_id", "source_no", "size", "rows")
                .agg(F.sum(F.col("taken").cast("bigint")).alias("copies")))
    sources = small(sources.select("source_no", "source", "source_size", "target"))
    each = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows")))
    return (per_unit.join(sources, "source_no").withColumn("row", each)
            .select("doc_id", "source", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, passes: int = PASSES, share: float = 1.0) -> DataFrame:
    """The mix itself: whole rows of ``docs``, each as often as it is taken, range-sorted by finish time."""
    copies, _ = plan(docs, weights, passes, share)
    chosen = staged(copies.where("taken").select(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"),
                                                 F.col("size").alias("mix_size"), "finish", "source_no", "shuffled", "pass"), "mix-chosen")
    size = f"size_{uuid.uuid4().hex}"
    rows = docs.withColumn(size, F.regexp_count(text_of(), F.lit(WORD)).cast("bigint"))
    names = [f"`{c}`" for c in docs.columns]
    on = (same(F.col("docs.doc_id").cast("bigint"), F.col("chosen.mix_id")) & same(F.col("docs.source").cast("string"), F.col("chosen.mix_source"))
          & (F.col(f"docs.{size}") == F.col("chosen.mix_size")))
    order = [f"chosen.{c}" for c in ("finish", "source_no", "shuffled", "mix_id", "pass")]
    return rows.alias("docs").join(chosen.alias("chosen"), on).orderBy(*order).select(*[f"docs.{c}" for c in names])
