"""Least squares by orthogonal factors merged in a tree.

Sums of products square a model's condition number, which costs half the digits
where interactions nearly follow from each other. Here a task reduces its rows
to their count, their means and the triangular factor R of the centred rows. Two
such triples merge exactly: the factors stacked, with one row for the distance
of the means, factored again. Tasks' triples meet in groups of ``FAN`` until one
is left; a triple has the size of the model, whatever it stands for.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from ..session import stored
from .regression import with_p_values

FAN = 64
_ALIASED = 1e-7    # a term with less length of its own than this share of it is aliased
_FACTOR = "part long, n long, means array<double>, factor array<double>"

Factor = tuple[int, np.ndarray, np.ndarray]


def _triangle(rows: np.ndarray, size: int) -> np.ndarray:
    """R of ``rows``, with as many rows as columns and no negative diagonal."""
    r = np.linalg.qr(rows, mode="r")
    r = np.vstack([r, np.zeros((size - len(r), size))]) if len(r) < size else r
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


def factor_of(rows: np.ndarray) -> Factor:
    means = rows.mean(axis=0)
    return len(rows), means, _triangle(rows - means, rows.shape[1])


def merged(a: Factor, b: Factor) -> Factor:
    """The factor of both's rows."""
    n = a[0] + b[0]
    apart = np.sqrt(a[0] * b[0] / n) * (b[1] - a[1])
    return n, a[1] + (b[1] - a[1]) * (b[0] / n), _triangle(np.vstack([a[2], b[2], apart]), len(apart))


def _row(part: int, f: Factor) -> tuple:
    return part, f[0], f[1].tolist(), f[2].ravel().tolist()


def qr_factor(df: DataFrame, response: str, terms: Mapping[str, Column]) -> DataFrame:
    """One row with ``n``, ``means`` and ``factor`` of the terms followed by the response; no row without usable rows.

    Rows lacking any value, or holding a NaN or infinity, are left out.
    """
    columns = [*(f"_t{i}" for i in range(len(terms))), "_y"]
    values = df.select(*(c.cast("double").alias(a) for c, a in zip([*terms.values(), F.col(response)], columns)))
    for c in columns:
        values = values.where(F.abs(c) < F.lit(float("inf")))    # false for NaN, unknown for NULL

    def reduce_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Factor | None = None
        for batch in batches:
            if batch.num_rows:
                rows = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
                found = factor_of(rows) if found is None else merged(found, factor_of(rows))
        if found is not None:
            part, n, means, factor = _row(TaskContext.get().partitionId(), found)
            yield pa.RecordBatch.from_pydict({"part": [part], "n": [n], "means": [means], "factor": [factor]})

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("part")
        size = len(columns)
        found: Factor | None = None
        for n, means, factor in zip(group["n"], group["means"], group["factor"]):
            one = int(n), np.array(means, float), np.array(factor, float).reshape(size, size)
            found = one if found is None else merged(found, one)
        return pd.DataFrame([_row(int(group["part"].iloc[0]) // FAN, found)], columns=["part", "n", "means", "factor"])

    factors = stored(values.mapInArrow(reduce_rows, _FACTOR), "factors")
    many = (factors.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        factors = factors.groupBy(F.floor(F.col("part") / FAN)).applyInPandas(meet, _FACTOR)
        many = -(-many // FAN)
        if many == 1:
            return factors.drop("part")


def solve_factor(n: int, means: np.ndarray, factor: np.ndarray) -> dict[str, np.ndarray | float]:
    """Coefficients and errors; aliased terms get NaN."""
    size = len(means) - 1
    lengths = np.sqrt((factor**2).sum(axis=0))
    scale = np.where(lengths > 0, lengths, 1.0)
    scaled = factor / scale
    kept: list[int] = []
    work = scaled.copy()
    for i in range(size):    # a term stays if the ones before it leave some of it
        basis = _triangle(work[:, [*kept, i]], len(kept) + 1)
        if abs(basis[-1, -1]) > _ALIASED:
            kept.append(i)
    p = len(kept)
    both = _triangle(scaled[:, [*kept, size]], p + 1)
    upper, cross, left = both[:p, :p], both[:p, p], both[p, p]
    inverse = np.linalg.solve(upper, np.eye(p)) if p else np.zeros((0, 0))
    y = scale[size]
    slopes, errors = np.full(size, np.nan), np.full(size + 1, np.nan)
    slopes[kept] = inverse @ cross * y / scale[kept]
    centre = means[kept] / scale[kept]
    df = n - p - 1
    sigma = abs(left) * y / np.sqrt(df) if df > 0 else np.nan
    errors[0] = sigma * np.sqrt(1 / n + ((centre @ inverse) ** 2).sum())
    errors[1 + np.array(kept, dtype=int)] = sigma * np.sqrt((inverse**2).sum(axis=1)) / scale[kept]
    r2 = float(cross @ cross / (cross @ cross + left * left)) if lengths[size] > 0 else np.nan
    return {
        "estimate": np.concatenate([[means[size] - slopes[kept] @ means[kept]], slopes]),
        "std_error": errors,
        "df": df,
        "sigma": sigma,
        "r2": r2,
        "adj_r2": 1 - (1 - r2) * (n - 1) / df if df > 0 else np.nan,
    }


def qr_model(factors: DataFrame, terms: Sequence[str]) -> DataFrame:
    """E10/E11. One row per term with its estimate, error, t and p, and the model's fit quality, as ``linear_model`` gives them."""
    names, numbers = ["intercept", *terms], ["estimate", "std_error", "sigma", "r2", "adj_r2"]
    schema = T.StructType(
        [T.StructField("position", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("n", T.LongType()), T.StructField("df", T.LongType())]
        + [T.StructField(c, T.DoubleType()) for c in numbers]
    )
    size = len(names)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                fit = solve_factor(int(row.n), np.array(row.means, float), np.array(row.factor, float).reshape(size, size))
                yield pd.DataFrame({"position": range(size), "term": names, "n": row.n, **fit})[[f.name for f in schema]]

    fits = factors.mapInPandas(solve, schema)
    known = fits.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in numbers})
    return with_p_values(known.withColumn("t_value", F.try_divide("estimate", "std_error")))
