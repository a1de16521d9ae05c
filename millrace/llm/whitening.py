"""Whitening of embeddings with an exact covariance.

Entries become integers, x = floor(64 c) + 1,000,000, so sums and products of any number of rows are exact: n^2 times the covariance is
an integer matrix, n * sum(x x') - S S', and neither rounding nor the order of summation enters it. Its characteristic
polynomial comes from :mod:`exact_roots`: one Spark task per handful of primes, joined by Chinese remaindering; roots are isolated on the driver, null spaces found in
one task per root. The driver holds the d x d matrix and the polynomial, whatever the number of rows.

Rows travel once: the distinct integer vectors (as 4 or 8 bytes an entry) are shuffled by value, partial distinct first, so copies of one vector
are one row per task. Their products are summed in blocks of ``LIMB`` bits by matrix products that floats hold exactly.
The projection is a scan of the table.

Defined cases: a row goes if its vector is NULL, empty or holds NULL, NaN or infinite entries, or has another length than most (of
several most frequent lengths the largest counts); entries whose integer would not fit 62 bits are taken as the nearest that does. Repeated rows and ids stay and are answered row by row;
repeated vectors count once in the fit. Directions without variance have no component, so a table with one distinct vector,
like an empty table, gives an empty result. Eigenvectors of equal eigenvalues are some orthonormal basis, the same for all rows.
``deviation`` is exact; as a DECIMAL it is NULL above 38 digits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import exact_roots
from millrace.llm.common import staged

# How an entry becomes an integer.
SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 16
# Products of two numbers of LIMB bits, summed over BLOCK rows, stay below 2^53; sums of PASS rows below 2^63.
LIMB, BLOCK, PASS = 20, 4_096, 1 << 21
LIMBS = 4
_LARGEST = 1 << 62
PRIMES_PER_TASK = 8


@dataclass(frozen=True)
class Moments:
    """n distinct vectors; ``sums`` and ``products`` of their entries less SHIFT."""

    n: int
    sums: list[int]
    products: list[list[int]]

    def scatter(self) -> list[list[int]]:
        """n^2 times the covariance: n * sum(y y') - sum(y) sum(y)'."""
        return [[self.n * p - a * b for p, b in zip(row, self.sums)] for row, a in zip(self.products, self.sums)]


@dataclass(frozen=True)
class Whitener:
    n: int
    sums: list[int]                     # of the entries less SHIFT
    weights: np.ndarray                 # (dimensions, components): unit eigenvector over the root of its eigenvalue
    explained: list[float]
    identity_error: float


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(64 c) of finite doubles; SHIFT is left out, as it cancels."""
    return np.clip(np.floor(vectors * float(SCALE)), -float(_LARGEST), float(_LARGEST - 1024)).astype(np.int64)


def _vectors(lists: pa.Array, dimensions: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the usable rows, their vectors as doubles)."""
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(lengths == dimensions)
    flat = lists.take(pa.array(right)).flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(right), dimensions)
    good = np.isfinite(values).all(axis=1)          # NULL entries are NaN here
    return right[good], values[good]


def _packed(dimensions: int):
    """The integer vectors as bytes, 4 an entry if they fit and 8 otherwise, so equal vectors are equal bytes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = integers(_vectors(batch.column(0), dimensions)[1])
            narrow = ((y >= -(1 << 31)) & (y < 1 << 31)).all(axis=1)
            small = y.astype("<i4")
            yield pa.RecordBatch.from_arrays([pa.array([(s if is_narrow else w).tobytes() for is_narrow, s, w in zip(narrow, small, y)], pa.binary())],
                                             names=["vector"])

    return run


def limbs(y: np.ndarray) -> list[np.ndarray]:
    """Signed parts of LIMB bits, lowest first, as doubles; parts that are zero everywhere at the end are left out."""
    out = []
    while len(out) < LIMBS and (not out or y.any()):
        low = y if len(out) == LIMBS - 1 else y & ((1 << LIMB) - 1)
        # Small negative numbers should not need every part.
        low = np.where((low >= 1 << (LIMB - 1)) & (len(out) < LIMBS - 1), low - (1 << LIMB), low)
        out.append(low.astype(np.float64))
        y = (y - low) >> LIMB
    return out


def _products(dimensions: int):
    """Exact sums of a task's vectors: rows (power of two, i, j, total); a vector's last entry is a constant one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = dimensions + 1
        totals = np.zeros((2 * LIMBS - 1, d, d), np.int64)
        seen = 0

        def flushed() -> pa.RecordBatch:
            power, i, j = np.nonzero(totals)
            return pa.RecordBatch.from_arrays([pa.array(power.astype(np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)),
                                               pa.array(totals[power, i, j])], names=["power", "i", "j", "total"])

        for batch in batches:
            packed = batch.column(0).to_pylist()
            for start in range(0, len(packed), BLOCK):
                part = packed[start:start + BLOCK]
                y = np.ones((len(part), d), np.int64)
                for k, vector in enumerate(part):
                    y[k, :-1] = np.frombuffer(vector, "<i4" if len(vector) == 4 * dimensions else "<i8")
                split = limbs(y)
                for a, left in enumerate(split):
                    for b, right in enumerate(split):
                        totals[a + b] += (left.T @ right).astype(np.int64)
                seen += len(part)
                if seen >= PASS:
                    yield flushed()
                    totals[:], seen = 0, 0
        yield flushed()

    return run


def dimensions_of(rows: DataFrame, column: str) -> int:
    """The most frequent length of a vector; 0 if there is none."""
    lengths = rows.groupBy(F.size(f"`{column}`").alias("d")).agg(F.count(F.lit(1)).alias("rows")).where("d > 0")
    found = lengths.orderBy(F.desc("rows"), F.desc("d")).first()
    return found["d"] if found else 0


def moments(rows: DataFrame, column: str, dimensions: int) -> Moments:
    """Exact sums and products of the distinct integer vectors."""
    vectors = rows.select(F.col(f"`{column}`").cast("array<double>").alias("vector")).mapInArrow(_packed(dimensions), "vector binary").distinct()
    sums = vectors.mapInArrow(_products(dimensions), "power int, i int, j int, total bigint")
    sums = sums.groupBy("power", "i", "j").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    full = [[0] * (dimensions + 1) for _ in range(dimensions + 1)]
    for r in sums.collect():                        # at most 7 (d + 1)^2 numbers
        full[r["i"]][r["j"]] += int(r["total"]) << (LIMB * r["power"])
    return Moments(full[-1][-1], full[-1][:-1], [row[:-1] for row in full[:-1]])


def characteristic_polynomial(spark, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(x - matrix), lowest first, for a positive semidefinite integer matrix; a few primes per task."""
    moduli = exact_roots.primes_for(matrix)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mine = [moduli[k] for k in batch.column(0).to_pylist()]
            for start in range(0, len(mine), PRIMES_PER_TASK):
                part = mine[start:start + PRIMES_PER_TASK]
                rows = exact_roots.residues(matrix, part)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(rows.tolist(), pa.list_(pa.int64()))], names=["prime", "residues"])

    tasks = max(1, -(-len(moduli) // PRIMES_PER_TASK))
    found = spark.range(0, len(moduli), 1, tasks).mapInArrow(run, "prime bigint, residues array<bigint>").collect()
    return exact_roots.remaindered([r["prime"] for r in found], [list(r["residues"]) for r in found])


def fit(found: Moments, spark, components: int = COMPONENTS) -> Whitener:
    """The leading components of the exact covariance."""
    matrix = found.scatter()
    factor = exact_roots.common_factor(matrix) if matrix else 1
    reduced = [[x // factor for x in row] for row in matrix]
    trace = sum(reduced[k][k] for k in range(len(reduced)))
    if not trace:
        return Whitener(found.n, found.sums, np.zeros((len(matrix), 0)), [], 0.0)
    roots = exact_roots.top_roots(characteristic_polynomial(spark, reduced), components)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                vectors = exact_roots.null_space(reduced, *roots[k])
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(vectors), pa.int64()), pa.array(range(len(vectors)), pa.int32()),
                                                  pa.array([[str(x) for x in v] for v in vectors], pa.list_(pa.string()))],
                                                 names=["root", "number", "vector"])

    spaces = spark.range(0, len(roots), 1, len(roots)).mapInArrow(run, "root bigint, number int, vector array<string>")
    spaces = spaces.orderBy("root", "number").limit(components).collect()
    with localcontext() as context:
        context.prec = exact_roots.DIGITS
        square = Decimal(found.n) ** 2
        columns, explained = [], []
        for r in spaces:
            numerator, bits, _ = roots[r["root"]]
            value = Decimal(numerator) / Decimal(1 << bits)
            scale = (value * factor / square).sqrt()
            columns.append([float(Decimal(x) / scale) for x in r["vector"]])
            explained.append(float(value / trace))
        # The covariance of what these doubles project to, without further rounding.
        weights = [[Decimal(x) for x in column] for column in columns]
        images = [[sum(x * w for x, w in zip(row, column)) for row in matrix] for column in weights]
        error = max(abs(sum(a * b for a, b in zip(column, image)) / square - (i == j))
                    for i, column in enumerate(weights) for j, image in enumerate(images))
    return Whitener(found.n, found.sums, np.array(columns).T, explained, float(error))


def _deviations(y: np.ndarray, n: int, sums: list[int]) -> list[Decimal | None]:
    """sum((n x - S)^2) of each row, exactly; rows of small numbers as 64-bit integers."""
    largest = max((n * max(abs(int(y.min())), abs(int(y.max()))) if y.size else 0) + max(map(abs, sums), default=0), 1)
    if largest ** 2 * max(1, y.shape[1]) < 1 << 63:
        totals = ((n * y - np.array(sums, np.int64)) ** 2).sum(axis=1).tolist()
    else:
        totals = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in y.tolist()]
    return [Decimal(t) if t < 10 ** 38 else None for t in totals]


def _project(model: Whitener, dimensions: int):
    mean = np.array([s / model.n for s in model.sums])         # of small numbers, correctly rounded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, vectors = _vectors(batch.column(1), dimensions)
            y = integers(vectors)
            # Component by component in one order, so the same vector gives the same doubles in any batch.
            white = ((y - mean)[:, :, None] * model.weights[None]).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(_deviations(y, model.n, model.sums), pa.decimal128(38, 0)),
                 pa.array(list(white), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

    return run


def whiten(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per usable row of ``rows`` and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    spark = rows.sparkSession
    schema = "vec_id bigint, deviation decimal(38,0), whitened array<double>"
    dimensions = dimensions_of(rows, vector_column)
    model = fit(moments(rows, vector_column, dimensions), spark, components) if dimensions else None
    wanted = rows.select(F.col(f"`{id_column}`").cast("bigint").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector"))
    if model is None or not len(model.explained):
        white = spark.createDataFrame([], schema)
        explained, n, error = F.array().cast("array<double>"), 0, 0.0
    else:
        white = wanted.mapInArrow(_project(model, dimensions), schema)
        explained, n, error = F.array(*map(F.lit, model.explained)), model.n, model.identity_error
    return (white.select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
            .select("vec_id", (F.col("k") + 1).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
                    F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error")))
