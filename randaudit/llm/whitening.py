"""Whitening of embeddings: singular values of the centred, distributed rows, rescaled to the divisor n.

Each entry c becomes the integer x = floor(64 c) + 1000000. Sums by dimension are exact integers, so rows are centred as
(n x - S) / n, rounded once. MLlib's computeSVD on the centred rows gives the components (the right singular vectors V)
and, from its singular values s, the eigenvalues e = s^2 / n of the covariance. All singular values are asked for, for which MLlib decomposes
the Gram matrix by LAPACK, at double precision, for up to 15,000 dimensions. The total variance is not their sum: it comes from the
exact integer deviations, as sum((n x - S)^2) / n^3. Only what grows with the dimensions (sums, components) is on the driver.

Rows with a null vector, an empty one, or null or non-finite entries drop out, and so do vectors of another length than the most
common one (ties: the longer), which have no place in one covariance. Equal vectors and repeated ids count as often as they occur.
Components without variance (an eigenvalue under 1e-12 of the largest, which is rounding error) can't be whitened and have no rows; so a
single vector, or none, gives no rows. Other columns, whatever their names, are left behind. An integer beyond the range of
a long is an arithmetic error of the job, never a wrong number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STEPS, ORIGIN = 64, 1_000_000
#: Components that the report has at most.
TOP = 32
#: Singular values under this share of the largest are rounding errors: the Gram matrix has squares of them, near the last bits.
LEAST = 1e-6


def scaled(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array of longs) of the vectors that take part."""
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    own = own.where("size(v) > 0 and forall(v, c -> c is not null and not isnan(c) and abs(c) < double('infinity'))")
    length = own.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    own = own.where(F.size("v") == (length.n if length else 0))
    return own.select("vec_id", F.transform("v", lambda c: F.floor(c * STEPS) + ORIGIN).alias("x"))


def sums(own: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and exact sums by dimension: a task adds up its own vectors, of which one row for each dimension is left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            x = _matrix(batch.column("x"), len(batch))
            if len(x):
                n, total = n + len(x), x.sum(axis=0) + (0 if total is None else total)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()], type=pa.list_(pa.int64()))], names=["n", "total"])

    parts = own.select("x").mapInArrow(run, "n long, total array<long>")
    found = parts.select("n", F.posexplode("total").alias("dim", "s")).groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim").collect()
    return (found[0].n, [r.s for r in found]) if found else (0, [])


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


@dataclass(frozen=True)
class Whitening:
    """A fitted whitening: n vectors with sums, components (a column each), their eigenvalues, and the total variance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    variance: float

    @property
    def explained(self) -> np.ndarray:
        return self.eigenvalues / self.variance if len(self.eigenvalues) else self.eigenvalues

    def deviation(self) -> F.Column:
        """Sum over the dimensions of (n x - S)^2, in exact integers."""
        far = F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in self.sums]), lambda x, s: self.n * x - s)
        return F.aggregate(far, F.lit(0).cast("long"), lambda a, d: a + d * d)

    def transform(self, own: DataFrame, top: int | None = None) -> DataFrame:
        """The rows of scaled() with whitened (array of doubles, the first `top` components)."""
        top = len(self.eigenvalues) if top is None else min(top, len(self.eigenvalues))
        n, total, turn = self.n, np.array(self.sums, dtype=np.int64), self.components[:, :top] / np.sqrt(self.eigenvalues[:top])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    white = ((n * _matrix(batch.column("x"), len(batch)) - total) / n) @ turn
                    flat = pa.array(white.ravel())
                    ends = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * top)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, flat)], names=[*batch.schema.names, "whitened"])

        if not top:
            return own.withColumn("whitened", F.array().cast("array<double>"))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields)
        return own.mapInArrow(run, f"{fields}, whitened array<double>")


def _rows(arrays: DataFrame, column: str) -> RowMatrix:
    """A column of arrays as a distributed matrix of MLlib."""
    vectors = arrays.select(array_to_vector(column).alias("row"))
    return RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "row"))


def fit(own: DataFrame) -> Whitening:
    """The whitening of the rows of scaled()."""
    n, total = sums(own)
    empty = Whitening(n, total, np.zeros((len(total), 0)), np.zeros(0), 0.0)
    spread = own.agg(F.sum(empty.deviation().cast("decimal(38,0)")).alias("d")).first().d if n else 0
    if not spread:  # no vectors, or all are equal
        return empty
    middle = F.array(*[F.lit(s).cast("long") for s in total])
    centred = own.select(F.zip_with("x", middle, lambda x, s: (n * x - s) / n).alias("c"))
    found = _rows(centred, "c").computeSVD(len(total), computeU=False, rCond=LEAST)
    return Whitening(n, total, found.V.toArray(), found.s.toArray() ** 2 / n, int(spread) / n**3)


def identity_error(white: DataFrame, k: int, n: int) -> float:
    """Largest absolute entry of the covariance (divisor n) of the whitened rows minus the identity; 0 without components."""
    if not k:
        return 0.0
    gram = _rows(white, "whitened").computeGramianMatrix().toArray() / n
    mean = np.array([r.m for r in white.select(F.posexplode("whitened").alias("k", "w")).groupBy("k").agg((F.sum("w") / n).alias("m")).orderBy("k").collect()])
    return float(np.abs(gram - np.outer(mean, mean) - np.eye(k)).max())


def report(vectors: DataFrame, top: int = TOP) -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained, identity_error for each row and each of its components up to top."""
    own = scaled(vectors)
    model = fit(own)
    k = min(top, len(model.eigenvalues))
    white = model.transform(own.withColumn("deviation", model.deviation()) if model.sums else own.withColumn("deviation", F.lit(0).cast("long")), top)
    error = identity_error(white, k, model.n)
    shares = F.array(*[F.lit(float(e)) for e in model.explained[:k]]).cast("array<double>")
    out = white.select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return out.select(
        "vec_id",
        (F.col("place") + 1).cast("int").alias("component"),
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("place")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
