"""Whitening of embeddings by a covariance in tiles.

Dimensions are cut into column blocks; each pair of them, a tile, is a key. Rows are read in row-blocks, of which
every column block is sent, by a shuffle on row-block and tile, to the tiles that need it; there the two blocks are multiplied. Tiles
are summed within each task, then cell by cell over the tasks, and put together on the driver: a matrix as wide as the vectors,
whatever the table's size, whose eigenvectors are the components. The widths of tiles follow the vectors', so that
a block goes to four tiles at most.

Vectors are whole numbers x = floor(64 * c) + 1000000. Their sums are exact; the mean is a whole part, taken off x without rounding, and
a fraction. The fit list has each vector once. The whitened fit list's own covariance, by the same tiles, gives identity_error.

Null vectors and vectors with null or non-finite entries are left out; null ids stay. Shorter vectors count as padded with entries of zero.
Repeated rows count once in the fit list, and each is returned. Components without variance (all, if the list has one vector) have whitened null
and take no part in identity_error, null where there are no others; explained is null where there is no variance at all. An
entry or a sum that no long holds raises OverflowError; deviation is a decimal, as it outgrows a long near a million vectors
of wide range. Extra columns of any name are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, map_batches

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Least width of a column block; wider vectors have four blocks.
TILE = 32
LIMIT = 1 << 62


def integers(df: DataFrame, scale: int = SCALE, offset: int = OFFSET) -> DataFrame:
    """vec_id and x of the vectors that take part."""
    v, far = F.col("embedding"), F.lit(float(LIMIT))
    fine = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    too_far = F.raise_error("OverflowError: an entry beyond a long").cast("long")
    whole = F.transform(v, lambda c: F.when(F.abs(c.cast("double") * scale) < far, F.floor(c.cast("double") * scale) + offset).otherwise(too_far))
    return df.where(F.coalesce(fine, F.lit(False))).select("vec_id", whole.alias("x"))


def padded(df: DataFrame, width: int, offset: int = OFFSET) -> DataFrame:
    missing = F.array_repeat(F.lit(offset).cast("long"), F.lit(width) - F.size("x"))
    return df.withColumn("x", F.when(F.size("x") < width, F.concat("x", missing)).otherwise(F.col("x")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def column_sums(df: DataFrame, column: str, width: int) -> list:
    """The sum of each place of a column of arrays: first within tasks, then over them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                m = matrix(b.column(0), width)
                if m.dtype.kind == "i" and float(np.abs(m).max(initial=0)) * len(m) + float(np.abs(total).max() if total is not None else 0) >= LIMIT:
                    raise OverflowError("a sum beyond a long")
                total = m.sum(0) if total is None else total + m.sum(0)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(total)], ["at", "s"])

    kind = df.schema[column].dataType.elementType.simpleString()
    found = map_batches(df.select(column), run, f"at long, s {kind}").groupBy("at").agg(F.sum("s").alias("s")).collect()  # a row for each dimension
    return [s for _, s in sorted(map(tuple, found))]


def small_ints(m: np.ndarray) -> np.ndarray:
    """The same numbers in the fewest bytes."""
    most = int(np.abs(m).max(initial=0))
    return m.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if most <= np.iinfo(t).max))


def covariance(df: DataFrame, column: str, width: int, n: int, whole: np.ndarray, rest: np.ndarray, tile: int | None = None) -> np.ndarray:
    """Covariance (divisor n) of an array column around the means whole + rest, each row centred before it is multiplied."""
    tile = tile or max(TILE, -(-width // 4))
    starts = list(range(0, width, tile))

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(row-block, tile, side) -> the rows of a column block less the whole means."""
        first = TaskContext.get().partitionId() << 32
        for k, b in enumerate(batches):
            m = matrix(b.column(0), width) - whole
            cut = [small_ints(m[:, s : s + tile]) if m.dtype.kind == "i" else m[:, s : s + tile] for s in starts]
            for i in range(len(starts)):
                for j in range(i, len(starts)):
                    for side, c in ((0, i), (1, j))[: 1 if i == j else 2]:
                        row = [[first + k], [i], [j], [side], [cut[c].dtype.str], [np.ascontiguousarray(cut[c]).tobytes()]]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary()))],
                            ["row_block", "a", "b", "side", "kind", "data"],
                        )

    def multiply(t: pa.Table) -> pa.Table:
        sides = {}
        a, b = t["a"][0].as_py(), t["b"][0].as_py()
        for side, kind, data in zip(t["side"].to_pylist(), t["kind"].to_pylist(), t["data"]):
            s = starts[b if side else a]
            w = min(tile, width - s)
            sides[side] = np.frombuffer(data.as_buffer(), np.dtype(kind)).reshape(-1, w).astype(np.float64) - rest[s : s + w]
        product = sides[0].T @ sides.get(1, sides[0])
        return pa.table({"a": pa.array([a], pa.int32()), "b": pa.array([b], pa.int32()), "s": pa.array([product.ravel()], pa.list_(pa.float64()))})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The tiles of a task, each once."""
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for a, b, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                m = s.values.to_numpy()
                total[a, b] = total[a, b] + m if (a, b) in total else m.copy()
        for (a, b), m in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([a], pa.int32()), pa.array([b], pa.int32()), pa.array([m], pa.list_(pa.float64()))], ["a", "b", "s"])

    sent = map_batches(df.select(column), blocks, "row_block long, a int, b int, side int, kind string, data binary")
    tiles = map_batches(sent.groupBy("row_block", "a", "b").applyInArrow(multiply, "a int, b int, s array<double>"), summed, "a int, b int, s array<double>")
    cells = tiles.select("a", "b", F.posexplode("s").alias("at", "s")).groupBy("a", "b", "at").agg(F.sum("s").alias("s"))
    cells = cells.groupBy("a", "b").agg(F.array_sort(F.collect_list(F.struct("at", "s"))).getField("s").alias("s"))  # as many as a tile has
    out = np.zeros((width, width))
    for a, b, s in cells.collect():  # all tiles: the vectors' width squared
        i, j = starts[a], starts[b]
        m = np.array(s).reshape(min(tile, width - i), -1)
        out[i : i + m.shape[0], j : j + m.shape[1]] = m
        out[j : j + m.shape[1], i : i + m.shape[0]] = m.T
    return out / n


def deviations(x: np.ndarray, n: int, sums: list[int]) -> pa.Array:
    """For each row the sum over dimensions of (n * x - S)^2, exactly."""
    far = np.abs(n * x.astype(np.float64) - np.array(sums, np.float64))
    if float(np.abs(x).max(initial=0)) * n < LIMIT and float((far**2).sum(1).max(initial=0)) < LIMIT:
        return pa.array(((n * x - np.array(sums, np.int64)) ** 2).sum(1)).cast(pa.decimal128(38, 0))
    return pa.array([Decimal(sum((n * v - s) ** 2 for v, s in zip(row, sums))) for row in x.tolist()], pa.decimal128(38, 0))


def whiten(vectors: DataFrame, components: int = COMPONENTS, tile: int | None = None) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error for each row and component."""
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "whiten")
    rows = scratch.stage(integers(vectors), "rows")
    width = rows.agg(F.max(F.size("x"))).first()[0] or 0
    kind = rows.schema["vec_id"].dataType.simpleString()
    fields = f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not width:
        return spark.createDataFrame([], fields)
    rows = padded(rows, width)
    fit = scratch.stage(rows.select("x").distinct(), "fit")
    n, sums = fit.count(), column_sums(fit, "x", width)
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    v = covariance(fit, "x", width, n, whole, rest, tile)
    values, axes = np.linalg.eigh(v)
    k = min(components, width)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    trace = float(np.trace(v))
    live = values > max(values[0], 0) * width * 2.0**-50
    scale = np.where(live, 1 / np.sqrt(np.where(live, values, 1)), np.nan)

    def project(x: np.ndarray) -> np.ndarray:
        return ((x - whole).astype(np.float64) - rest) @ axes * scale

    def of_fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            z = project(matrix(b.column(0), width))[:, live]
            flat = pa.FixedSizeListArray.from_arrays(pa.array(z.ravel()), z.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([flat], ["z"])

    error = None
    if held := int(live.sum()):
        white = scratch.stage(map_batches(fit, of_fit, "z array<double>"), "white")
        mean = np.array(column_sums(white, "z", held)) / n
        error = float(np.abs(covariance(white, "z", held, n, mean, np.zeros(held), tile) - np.eye(held)).max())
        scratch.drop(white)
    explained = [float(e) / trace if trace > 0 else None for e in values]

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), width)
            m = len(x)
            z = pa.array(project(x).ravel(), mask=np.tile(~live, m))
            each = np.repeat(np.arange(m), k)
            constants = [pa.array([n] * (m * k), pa.int64()), deviations(x, n, sums).take(pa.array(each)), z]
            last = [pa.array(explained * m, pa.float64()), pa.array([error] * (m * k), pa.float64())]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), *constants, *last],
                [f.split()[0] for f in fields.split(", ")],
            )

    return map_batches(rows, of_rows, fields)
