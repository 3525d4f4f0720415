"""Embedding whitening: Spark sums a centred product for each pair of dimensions, and LAPACK decomposes their covariance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written

#: Steps of the integer grid for each unit of a vector's entry.
STEPS = 256
#: Components kept, those of the greatest eigenvalues.
COMPONENTS = 4
#: Columns of sums in one aggregation, few enough for generated code; beyond 178 dimensions there are several aggregations.
SUMS = 90
#: An eigenvalue under this share of the trace is rounding, and its component has no scale to divide by.
RANK = 1e-12
_LONG = (-(2**63), 2**63 - 1)


@dataclass
class Whitening:
    """What is fitted: rows of the fit list, exact sums by dimension, means, components (a row each) and eigenvalues."""

    n: int
    sums: list[int]
    mean: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float


def total(terms: list[Column]) -> Column:
    """The sum of terms as a balanced tree, so that wide vectors make no deep expression."""
    while len(terms) > 1:
        terms = [a + b for a, b in zip(terms[::2], terms[1::2], strict=False)] + terms[len(terms) & ~1 :]
    return terms[0]


def gridded(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector holds finite numbers only, with the column x: each entry's place on the integer grid."""
    whole = F.col(vector).isNotNull() & ~F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * STEPS).cast("long"))
    return rows.where(F.coalesce(whole, F.lit(False))).withColumn("x", x)


def centred(fit: DataFrame, mean: np.ndarray) -> DataFrame:
    """One double column for each dimension: the entry less the dimension's mean."""
    return fit.select(*[(F.col("x")[i].cast("double") - F.lit(float(m))).alias(f"c{i}") for i, m in enumerate(mean)])


def covariance(fit: DataFrame, mean: np.ndarray, n: int, sums: int = SUMS) -> np.ndarray:
    """The upper triangle as one aggregation of centred products, mirrored.

    Each dimension i has a row of sums, with a column for each distance to a second dimension, up to half way round: the
    product of dimensions i and i + k, which wraps around at the last, so that every pair is in one of the columns. A
    column for every single pair would leave Spark's generated code, at many times the cost.
    """
    d = len(mean)
    whole = centred(fit, mean).select(F.array(*[F.col(f"c{i}") for i in range(d)]).alias("c"))
    rows, out, far = whole.select(F.posexplode("c").alias("i", "ci"), "c"), np.zeros((d, d)), d // 2 + 1
    for first in range(0, far, sums):
        part = range(first, min(first + sums, far))
        for row in rows.groupBy("i").agg(*[F.expr(f"sum(ci * c[(i + {k}) % {d}]) AS s{k}") for k in part]).collect():
            for k in part:
                i, j = row["i"], (row["i"] + k) % d
                out[i, j] = out[j, i] = row[f"s{k}"] / n
    return out


def fit(spark: SparkSession, grid: DataFrame, components: int = COMPONENTS) -> tuple[Whitening, DataFrame] | None:
    """The whitening of the distinct vectors of grid, and those vectors; None without a vector.

    The vectors' length is that which most distinct vectors have (the longer of equals); others take no part.
    """
    distinct = written(spark, grid.groupBy("x").count().select("x"), "vectors")
    width = distinct.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy(F.desc("count"), F.desc("d")).first()
    if width is None:
        return None
    rows, d = distinct.where(F.size("x") == width["d"]), width["d"]
    exact = rows.agg(F.count("*"), *[F.sum(F.col("x")[i].cast("decimal(19,0)")) for i in range(d)]).first()
    n, sums = exact[0], [int(s) for s in exact[1:]]
    mean = np.array([s / n for s in sums])
    values, vectors = np.linalg.eigh(covariance(rows, mean, n))
    order = np.argsort(values)[::-1][:components]
    return Whitening(n, sums, mean, vectors.T[order], values[order], float(values.sum())), rows


def scaled(model: Whitening, k: int, at: list[Column]) -> Column:
    """Component k of the centred entries, divided by its standard deviation; null where that is none."""
    e = float(model.values[k])
    if not e > RANK * model.trace:
        return F.lit(None).cast("double")
    weights = (model.components[k] / np.sqrt(e)).tolist()
    return total([c * F.lit(w) for c, w in zip(at, weights, strict=True)])


def deviation(model: Whitening) -> Column:
    """The exact sum over dimensions of (n*x - S)**2; null where it does not fit a long."""
    if any(not _LONG[0] <= s <= _LONG[1] for s in model.sums):
        return F.lit(None).cast("long")
    parts = [F.try_subtract(F.try_multiply(F.lit(model.n).cast("long"), F.col("x")[i]), F.lit(s).cast("long")) for i, s in enumerate(model.sums)]
    squares = [F.try_multiply(p, p) for p in parts]
    while len(squares) > 1:
        squares = [F.try_add(a, b) for a, b in zip(squares[::2], squares[1::2], strict=False)] + squares[len(squares) & ~1 :]
    return squares[0]


def identity_error(model: Whitening, rows: DataFrame) -> float:
    """The largest absolute entry of the covariance of the fit list's whitened vectors, less the identity.

    Components without a scale are left out; 0 if none has one.
    """
    kept = [k for k, e in enumerate(model.values) if e > RANK * model.trace]
    if not kept:
        return 0.0
    columns = centred(rows, model.mean)
    at = [F.col(c) for c in columns.columns]
    white = columns.select(*[scaled(model, k, at).alias(f"w{k}") for k in kept])
    pairs = [(a, b) for i, a in enumerate(kept) for b in kept[i:]]
    found = white.agg(*[F.covar_pop(f"w{a}", f"w{b}").alias(f"v{a}_{b}") for a, b in pairs]).first()
    return max(abs(v - (a == b)) for v, (a, b) in zip(found, pairs, strict=True))


def whitened(spark: SparkSession, vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """id_, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Vectors that are null, or hold a null, a NaN or an infinite entry, give no rows; neither do empty ones, nor those of
    another length than most distinct vectors have. Entries beyond the integer grid of a long end at its ends. Repeated rows
    give repeated rows, but count once in the fit; a null id stays null. There are as many components as dimensions at
    most. A component without variance has explained 0 and no whitened value (null), and a deviation beyond a long is
    null. An empty table gives no rows. Other columns are not looked at, whatever their names.
    """
    named = vectors.select(F.col(id_).alias("id"), F.col(vector).alias("vector"))
    grid = gridded(named, "vector").select("id", "x")
    schema = f"{id_} {vectors.schema[id_].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    found = fit(spark, grid, components)
    if found is None:
        return spark.createDataFrame([], schema)
    model, rows = found
    error = identity_error(model, rows)
    at = [F.col("x")[i].cast("double") - F.lit(float(m)) for i, m in enumerate(model.mean)]
    share = [max(0.0, float(e)) / model.trace if model.trace > 0 else 0.0 for e in model.values]
    each = [F.struct(F.lit(k + 1).alias("component"), scaled(model, k, at).alias("whitened"), F.lit(share[k]).alias("explained")) for k in range(len(model.values))]
    out = grid.where(F.size("x") == len(model.sums)).select("id", deviation(model).alias("deviation"), F.inline(F.array(*each)))
    return out.select(F.col("id").alias(id_), "component", F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
