"""Embedding whitening by the singular values of the centred rows, from Spark MLlib."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import base

#: An entry c counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Up to so many dimensions MLlib decomposes the matrix of products densely, to double precision; its own limit.
DENSE = 15_000
#: Singular values below this share of the largest are rounding errors of a direction without variance.
LEAST = 1e-7
#: Entries whose whole number is larger than this, and sums beyond 2^63, are an error rather than a wrong result.
MOST = 1 << 52


@dataclass(frozen=True)
class Whitening:
    """What the fit list gives: n rows, the dimensions' sums, unit components (dimensions x k) with their eigenvalues, and the trace of the covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def explained(self) -> list[float]:
        return [float(e) / self.trace for e in self.eigenvalues]


def whole_numbers(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, x array<long>) of the rows whose vector is neither null nor empty and holds only finite numbers. An entry that is too large is an error."""
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    good = rows.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.coalesce((F.size("v") > 0) & F.forall("v", finite), F.lit(False)))
    large = F.raise_error(F.lit("an entry is too large for exact sums")).cast("bigint")
    whole = lambda c: F.when(F.abs(c) * SCALE < MOST, F.floor(c * SCALE) + SHIFT).otherwise(large)
    return good.select("id", F.transform("v", whole).alias("x"))


def _matrix(rows: DataFrame, vectors, n: int, columns: int) -> RowMatrix:
    """A distributed matrix of an array column; rows stay in the JVM."""
    return RowMatrix(MLUtils.convertVectorColumnsFromML(rows.select(array_to_vector(vectors).alias("v")), "v"), n, columns)


def _centred(mean: list[float]):
    return F.zip_with("x", F.lit(mean), lambda x, m: x.cast("double") - m)


def fit(x: DataFrame, components: int = COMPONENTS) -> tuple[DataFrame, Whitening] | None:
    """Fit on a stored table of whole_numbers(), all rows. The rows as (id, deviation decimal, whitened array<double>), and the model; None if nothing varies.

    One aggregate gives n and the exact sums by dimension, one the products of centred rows (MLlib's computeSVD: dimensions squared / 2
    doubles in each task and on the driver, whatever the rows). Its singular values s give the eigenvalues s^2 / n. The trace comes
    from the rows' exact deviations, not from s. Components without variance are left out. Vectors of different lengths are an error.
    """
    sums = x.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("decimal(18,0)")).alias("s"), F.max(F.abs("c")).alias("most")).orderBy("i").collect()
    if not sums:
        return None
    n, d = sums[0]["n"], len(sums)
    if any(r["n"] != n for r in sums):
        raise ValueError("vectors of different lengths")
    s, most = [int(r["s"]) for r in sums], max(r["most"] for r in sums)
    mean = [v / n for v in s]
    k = d if d <= DENSE else min(components, d - 1)
    svd = _matrix(x, _centred(mean), n, d).computeSVD(k, rCond=LEAST)
    values = np.array(svd.s.toArray()) ** 2 / n
    k = int(min(components, np.count_nonzero(values > 0)))
    if not k:
        return None
    basis = svd.V.toArray()[:, :k]
    rows = base.stash(_projected(x, n, s, basis / np.sqrt(values[:k]), d * (2 * n * most) ** 2 < 1 << 63))
    total = rows.agg(F.sum(F.col("deviation"))).first()[0]
    return rows, Whitening(n, s, basis, values[:k], float(Decimal(total) / Decimal(n) ** 3))


def _projected(x: DataFrame, n: int, s: list[int], scaled: np.ndarray, fits: bool) -> DataFrame:
    """(id, deviation, whitened). fits: the deviations fit in 64 bits; else they are whole numbers of Python, with the same results."""
    mean = np.array([v / n for v in s])
    kind = np.int64 if fits else object

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at = batch.schema.get_field_index("x")
            rows = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            exact = ((n * rows.astype(kind) - np.array(s, kind)) ** 2).sum(axis=1)
            w = (rows - mean) @ scaled
            offsets = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("id")), pa.array([Decimal(int(v)) for v in exact], pa.decimal128(38, 0)), pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))],
                names=["id", "deviation", "whitened"],
            )

    kind_of_id = x.schema["id"].dataType.simpleString()
    return base.map_arrow(x, run, f"id {kind_of_id}, deviation decimal(38,0), whitened array<double>")


def identity_error(rows: DataFrame, n: int, k: int) -> float:
    """The largest absolute entry of the whitened rows' covariance (divisor n, centred before multiplying) less the identity."""
    mean = rows.agg(*(F.avg(F.get("whitened", F.lit(j))).alias(f"m{j}") for j in range(k))).first()
    centred = F.zip_with("whitened", F.lit([float(m) for m in mean]), lambda w, m: w - m)
    products = _matrix(rows, centred, n, k).computeGramianMatrix().toArray() / n
    return float(np.abs(products - np.eye(k)).max())


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component: id, component, n, deviation (decimal), whitened, explained, identity_error.

    Rows whose vector is null, empty, or holds null or non-finite entries go. Repeated rows and ids count and stay each for itself; a null id
    passes. Without rows, or where no dimension varies, the result is empty; components without variance have no rows. Of components with equal
    eigenvalues any basis may come. What comes to the driver is bounded by the dimensions: sums, and the matrix of products.
    Nothing shuffles but partial sums by dimension. Other columns are not read.
    """
    x = base.stash(whole_numbers(vectors, id_col, vector_col))
    kind = x.schema["id"].dataType.simpleString()
    found = fit(x, components)
    if found is None:
        schema = f"id {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return vectors.sparkSession.createDataFrame([], schema).withColumnRenamed("id", id_col)
    rows, model = found
    error = identity_error(rows, model.n, len(model.eigenvalues))
    out = rows.select("id", "deviation", F.posexplode("whitened").alias("j", "w"))
    return out.select(
        F.col("id").alias(id_col), (F.col("j") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation",
        F.col("w").alias("whitened"), F.element_at(F.lit(model.explained), F.col("j") + 1).alias("explained"), F.lit(error).alias("identity_error"),
    )


@base.query("op13_whitening")
def op13_whitening(spark, sf_dir):
    return whiten(base.table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))
